"""Verification of submitted answers against what the run really computed.

Evidence stays in long form: one row per number a successful execution produced.  A provenance
match asks whether any number of the same run lies inside an interval around the submitted value;
it is answered with equi-joins on cells of a power-of-two grid, so a run with very many numbers and
very many answers never forms all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import extract_numbers, float_text, general_format, literal_decimals
from ..functions.text import NOT_ANSWERABLE, strip
from ..functions.units import canonical_unit, normalize_unit, plausible_limit
from .ordered import running_count, running_sums
from .slices import computed_once

MAX_REJECTIONS = 2  # corrections allowed; the next rejection ends a run


# ------------------------------------------------------------------------------- evidence
def successful(executions: DataFrame) -> DataFrame:
    """Executions that count as evidence."""
    return executions.where(F.col("status") == "ok")


def execution_blob() -> Column:
    """All a result and its output show: value, head, repr and stdout."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("value", "head", "repr", "stdout")]
    return F.concat_ws(" ", *parts)


def shown_numbers(executions: DataFrame, run: Sequence[str]) -> DataFrame:
    """(run.., number): every number in evidence, as often as it is shown.

    ``executions`` has status, type, value (text), is_nan, is_inf, n_missing, head, repr, stdout.
    """
    result = F.when(
        (F.col("type") == "number") & ~F.coalesce("is_nan", F.lit(False)) & ~F.coalesce("is_inf", F.lit(False)),
        F.array(F.col("value").try_cast("double")),
    ).otherwise(F.array().cast("array<double>"))
    both = F.concat(result, extract_numbers(execution_blob()))
    long = successful(executions).select(*run, F.explode(both).alias("number"))
    return long.where(F.col("number").isNotNull())


def evidence_numbers(executions: DataFrame, run: Sequence[str]) -> DataFrame:
    """(run.., number): every distinct number in evidence, combined on the map side."""
    return shown_numbers(executions, run).distinct()


def saw_missing() -> Column:
    bad = F.coalesce("is_nan", F.lit(False)) | F.coalesce("is_inf", F.lit(False))
    return ((F.col("type") == "number") & bad) | (F.coalesce("n_missing", F.lit(0)) > 0)


def evidence_flags(executions: DataFrame, run: Sequence[str]) -> DataFrame:
    """(run.., n_runs, saw_nan): how many executions succeeded and whether one saw missing values."""
    return (
        successful(executions)
        .groupBy(*run)
        .agg(F.count(F.lit(1)).alias("n_runs"), F.max(F.coalesce(saw_missing(), F.lit(False))).alias("saw_nan"))
    )


def outputs(executions: DataFrame, run: Sequence[str], position: str) -> DataFrame:
    """(run.., position, blob): what each successful execution shows, in lower case."""
    return successful(executions).select(*run, position, F.lower(execution_blob()).alias("blob"))


def evidence_text(executions: DataFrame, run: Sequence[str], position: str) -> DataFrame:
    """(run.., position, start, text): the evidence text of a run, one row an execution.

    The text of a run is that of its executions in order of ``position``, joined by a space; ``start`` is
    the place of the first character in it.  The rows in order are the whole text, which is
    never put together: a run may be of any length.
    """
    shown = outputs(executions, run, position).withColumnRenamed("blob", "text")
    ended = running_sums(shown, {"_end": F.length("text") + 1}, position, run, OUTPUTS)
    return ended.select(*run, position, (F.col("_end") - F.length("text") - 1).alias("start"), "text")


def collect_evidence(executions: DataFrame, run: Sequence[str]) -> DataFrame:
    """Per run: successful executions, missing values seen, the spread of its numbers, and the length of its text.

    The numbers themselves are ``evidence_numbers``, the text is ``evidence_text``; gathering them into one
    row per run would put a large run into one row.
    """
    numbers = (
        evidence_numbers(executions, run)
        .groupBy(*run)
        .agg(
            F.count(F.lit(1)).alias("n_numbers"),
            F.min("number").alias("smallest"),
            F.max("number").alias("largest"),
        )
    )
    length = F.sum(F.length(execution_blob()) + 1) - 1
    texts = successful(executions).groupBy(*run).agg(length.alias("n_chars"))
    flags = evidence_flags(executions, run).join(texts, list(run))
    return flags.join(numbers, list(run), "left").fillna(0, ["n_numbers"])


# ------------------------------------------------------------------------------- provenance
def _cell(x: Column, level: Column) -> Column:
    """Index of the cell of width 2^level that holds x; exact, as only the exponent changes."""
    y = x / F.pow(F.lit(2.0), level)
    return F.coalesce(y - F.pmod(y, F.lit(1.0)), F.lit(0.0))


def with_interval(df: DataFrame, value: str, literal: str) -> DataFrame:
    """Add ``lo``, ``hi`` (numbers that round to the value as written) and the grid ``level``.

    A literal with d decimals allows half a unit of the last place, an exponent literal one part in
    a million of the observed number; both allow one part in a billion of the observed number.
    Solving those bounds for the observed number gives the interval.  Cells of a level are at most as
    wide as the interval and at least half as wide, so that it touches at most four of them.
    """
    # Never NULL: otherwise the optimizer would derive null filters and repeat these expressions.
    slack = 1e-9
    tiny = 2.0**-900  # an interval of width zero happens only for 0e0
    half = F.coalesce(0.5 * F.pow(F.lit(10.0), -F.col("_d")), F.lit(0.0))
    relative = F.when(F.col("_d").isNull(), F.lit(1e-6 + slack)).otherwise(F.lit(slack))
    below, above, relative_ = F.col("_below"), F.col("_above"), F.col("_relative")
    zero = F.lit(0.0)
    return (
        df.withColumn("_d", literal_decimals(F.col(literal)))
        .withColumns({"_below": F.col(value) - half, "_above": F.col(value) + half, "_relative": relative})
        .withColumns(
            {
                "lo": F.coalesce(below / (1 + relative_ * F.signum(below)), zero),
                "hi": F.coalesce(above / (1 - relative_ * F.signum(above)), zero),
            }
        )
        .withColumn("level", F.floor(F.log2(F.greatest(F.col("hi") - F.col("lo"), F.lit(tiny))) - 1e-9))
        .withColumn("level", F.coalesce(F.col("level").cast("int"), F.lit(0)))
        .drop("_d", "_relative", "_below", "_above")
    )


def provenance_match(
    answers: DataFrame, numbers: DataFrame, run: Sequence[str], value: str, literal: str
) -> DataFrame:
    """Distinct (run.., value, literal) of ``answers`` for which a number of the run fits.

    Evidence is reduced to its smallest and largest number per cell before it meets the answers,
    for the levels the answers of its run use: a handful of integers.
    """
    run = list(run)
    asked = with_interval(
        answers.select(*run, value, literal).where(F.abs(F.col(value)) < float("inf")).distinct(),
        value,
        literal,
    )
    levels = asked.select(*run, "level").distinct()
    cells = (
        numbers.join(levels, run)
        .withColumn("cell", _cell(F.col("number"), F.col("level")))
        .groupBy(*run, "level", "cell")
        .agg(F.min("number").alias("least"), F.max("number").alias("most"))
    )
    ends = {"_first": _cell(F.col("lo"), F.col("level")), "_last": _cell(F.col("hi"), F.col("level"))}
    steps = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("_first") + i)
    probes = (
        asked.withColumns(ends)
        .withColumn("cell", F.explode(F.filter(steps, lambda c: c <= F.col("_last"))))
        .drop("_first", "_last")
    )
    hits = probes.join(cells, [*run, "level", "cell"]).where(
        # Some number of the cell lies inside when its smallest or its largest does.  A cell that
        # only reaches the start of the interval has its largest inside, and so on.
        F.col("least").between(F.col("lo"), F.col("hi")) | F.col("most").between(F.col("lo"), F.col("hi"))
    )
    return hits.select(*run, value, literal).distinct()


TOGETHER = 256  # texts that are looked for in one pass over an output
OUTPUTS = 1_024  # outputs of a run that are ordered, or searched, in one task
TILE = 16_384  # characters of neighbouring outputs that are searched for texts together
LONG = 256  # characters of an output that is searched with its neighbours only; of a longer one the ends may be


def is_long(reach: str) -> Column:
    """Whether the inside of an output is searched apart from the stretches around its ends."""
    return F.length("blob") > F.greatest(F.col(reach) * 2, F.lit(LONG))


def seams(blobs: DataFrame, run: Sequence[str], position: str, reach: str, keep: Sequence[str] = ()) -> DataFrame:
    """(run.., keep.., text): stretches of the outputs of a run, joined by spaces, around their seams.

    Every text of up to ``reach + 1`` characters in the joined outputs is inside one of them, unless it is inside
    an output that ``is_long``, and each is a piece of the joined text.  Of a long output only
    ``reach`` characters at either end can be part of a text across a seam: it is cut there, its end starts a new
    segment.  A segment is laid out along its characters and covered by tiles that overlap by ``reach``, so neither
    a long output nor a run of very many gathers in one task.  ``keep`` are columns that are the same in all of
    a run, whose keys are not NULL.
    """
    run, keep = list(run), list(keep)
    long = is_long(reach)
    cut = blobs.select(
        *run, *keep, position, F.col(reach).alias("_reach"), long.alias("_long"),
        F.when(long, F.expr(f"left(blob, {reach})")).otherwise(F.col("blob")).alias("_head"),
        F.when(long, F.expr(f"right(blob, {reach})")).otherwise(F.lit("")).alias("_tail"),
    )
    # A space stands before every output; the first of a run has none before it, which ``_at`` tells.
    size = F.length("_head") + F.length("_tail") + 1
    placed = running_sums(cut, {"_end": size, "_breaks": F.col("_long").cast("int")}, position, run, OUTPUTS, nulls=False)
    at = F.col("_end") - size
    head = F.struct(
        (F.col("_breaks") - F.col("_long").cast("int")).alias("segment"), at.alias("at"),
        F.when(at > 0, F.concat(F.lit(" "), "_head")).otherwise(F.col("_head")).alias("text"),
    )
    tail = F.struct(F.col("_breaks").alias("segment"), (at + F.length("_head") + 1).alias("at"), F.col("_tail").alias("text"))
    pieces = placed.select(
        *run, *keep, F.greatest(F.col("_reach") * 4, F.lit(TILE)).alias("_tile_size"), "_reach",
        F.explode(F.when(F.col("_long"), F.array(head, tail)).otherwise(F.array(head))).alias("p"),
    ).select(*run, *keep, "_tile_size", "_reach", "p.*")
    first = F.floor(F.greatest(F.col("at") - F.col("_reach"), F.lit(0)) / F.col("_tile_size"))
    last = F.floor((F.col("at") + F.length("text")) / F.col("_tile_size"))
    tiles = pieces.withColumn("_tile", F.explode(F.sequence(first, last))).groupBy(*run, *keep, "segment", "_tile")
    # At most a tile, its overlap and the pieces at both ends.
    inside = tiles.agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("_pieces"))
    return inside.select(*run, *keep, F.concat_ws("", F.transform("_pieces", lambda p: p["text"])).alias("text"))


def text_match(answers: DataFrame, blobs: DataFrame, run: Sequence[str], needle: str, position: str) -> DataFrame:
    """Distinct (run.., needle) of ``answers`` whose text occurs in the joined outputs of the run.

    ``blobs`` has run.., ``position`` and blob; the outputs of a run are joined by a space in order of position,
    but never put together: a text is looked for in the stretches around their ``seams``, which hold short outputs
    whole, and inside every long output.  An empty text occurs in every run that has an output.

    The distinct texts of a run are dealt into lists of about ``TOGETHER``, its outputs into shares of about
    ``OUTPUTS``; a share meets the lists of its run, so a run with very many outputs is searched by many
    tasks and only lists are repeated.  Nothing grows with the length of an output.
    """
    run = list(run)
    asked = answers.select(*run, needle).where(F.col(needle).isNotNull()).distinct()
    counted = asked.groupBy(*run).agg(
        F.ceil(F.count(F.lit(1)) / TOGETHER).alias("_lists"), (F.greatest(F.max(F.length(needle)), F.lit(1)) - 1).alias("_reach")
    )
    sizes = blobs.groupBy(*run).agg(F.ceil(F.count(F.lit(1)) / OUTPUTS).alias("_shares"))
    per_run = counted.join(sizes, run)
    dealt = (
        asked.join(per_run, run)
        .groupBy(*run, "_shares", F.pmod(F.xxhash64(needle), F.col("_lists")).alias("_list"))
        .agg(F.collect_list(needle).alias("_needles"))
        .select(*run, "_needles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_share"))
    )
    lowered = blobs.select(*run, position, F.lower("blob").alias("blob"))
    inside = lowered.where(F.length("blob") > LONG).join(per_run, run).where(is_long("_reach"))
    around = seams(lowered.join(per_run, run), run, position, "_reach", ["_shares"])
    texts = inside.select(*run, "_shares", F.col("blob").alias("_text")).unionByName(around.withColumnRenamed("text", "_text"))
    texts = texts.withColumn("_share", F.pmod(F.xxhash64("_text"), F.col("_shares"))).drop("_shares")
    held = F.filter("_needles", lambda n: F.contains(F.col("_text"), n))
    return texts.join(dealt, [*run, "_share"]).select(*run, F.explode(held).alias(needle)).distinct()


# ------------------------------------------------------------------------------- checks
def _check(name: str, status: Column, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        status.alias("status"),
        (F.lit("") if detail is None else detail).alias("detail"),
    )


def abstains() -> Column:
    """Exactly the abstention phrase (the grader only looks for it inside the text)."""
    return ~F.col("answer_is_number") & (F.lower(strip(F.col("answer_value"))) == NOT_ANSWERABLE)


def check_type() -> Column:
    bad = F.col("answer_unit").isNotNull() & ~F.col("answer_is_number")
    detail = F.concat(F.lit("a value with a unit ("), F.col("answer_unit"), F.lit(") must be a number"))
    return _check(
        "type", F.when(bad, F.lit("fail")).otherwise(F.lit("pass")), F.when(bad, detail).otherwise(F.lit(""))
    )


def with_units(df: DataFrame) -> DataFrame:
    """Add the normalised units the checks read: ``given`` of the answer, ``planned`` of the plan."""
    return df.withColumns(
        {"given": normalize_unit(F.col("answer_unit")), "planned": canonical_unit(F.col("planned_unit"))}
    )


def check_unit() -> Column:
    canonical = F.col("given.canonical")
    status = (
        F.when(F.col("answer_unit").isNull(), F.lit("skip")).when(canonical.isNull(), F.lit("warn")).otherwise(F.lit("pass"))
    )
    detail = (
        F.when(F.col("answer_unit").isNull(), F.lit("no unit"))
        .when(canonical.isNull(), F.concat(F.lit("unrecognised unit '"), F.col("answer_unit"), F.lit("'")))
        .otherwise(canonical)
    )
    return _check("unit", status, detail)


def check_range() -> Column:
    unit = F.col("given")
    value = F.col("answer_value").try_cast("double")
    limit = plausible_limit(unit["canonical"])
    applies = F.col("answer_is_number") & limit.isNotNull() & ~unit["is_rate"]
    bad = F.isnan(value) | (F.abs(value) > limit)
    detail = F.concat(
        float_text(value), F.lit(" "), unit["canonical"], F.lit(" is implausible (|value| must be ≤ "),
        general_format(limit, 6), F.lit(")"),
    )
    status = F.when(~F.coalesce(applies, F.lit(False)), F.lit("skip")).when(bad, F.lit("fail")).otherwise(F.lit("pass"))
    return _check("range", status, F.when(status == "fail", detail).otherwise(F.lit("")))


def check_provenance() -> Column:
    """Needs n_runs, literal and provenance_found (number or text found in the evidence)."""
    found = F.coalesce("provenance_found", F.lit(False))
    none = F.coalesce("n_runs", F.lit(0)) == 0
    detail = (
        F.when(none, F.lit("no successful run_python call; compute the answer"))
        .when(found, F.lit(""))
        .when(
            F.col("answer_is_number"),
            F.concat(F.col("literal"), F.lit(" does not match any number produced by run_python in this run")),
        )
        .otherwise(F.concat(F.lit("'"), F.col("answer_value"), F.lit("' does not appear in any run_python output of this run")))
    )
    return _check("provenance", F.when(~none & found, F.lit("pass")).otherwise(F.lit("fail")), detail)


def check_silent_nan() -> Column:
    silent = F.coalesce("saw_nan", F.lit(False)) & ~F.lower("method_summary").rlike("nan|missing|null")
    return _check(
        "silent_nan",
        F.when(silent, F.lit("warn")).otherwise(F.lit("pass")),
        F.when(silent, F.lit("NaN/missing values appeared but are not mentioned")).otherwise(F.lit("")),
    )


def check_plan_unit() -> Column:
    """NULL (no check) unless both the plan and the answer name a unit."""
    planned, given = F.col("planned"), F.col("given.canonical")
    differs = planned.isNotNull() & given.isNotNull() & (planned != given)
    detail = F.concat(F.lit("planner expected "), planned, F.lit(", got "), given)
    check = _check(
        "plan_unit",
        F.when(differs, F.lit("warn")).otherwise(F.lit("pass")),
        F.when(differs, detail).otherwise(F.lit("")),
    )
    return F.when(F.col("planned_unit").isNotNull() & F.col("answer_unit").isNotNull(), check)


def attach_evidence(answers: DataFrame, executions: DataFrame, run: Sequence[str], position: str) -> DataFrame:
    """Add n_runs, saw_nan and provenance_found to answers that carry their ``literal``.

    ``position`` is a unique whole number that orders the executions of a run.
    """
    run = list(run)
    number = F.when(F.col("answer_is_number"), F.col("answer_value").try_cast("double"))
    text = F.when(F.col("_number").isNotNull(), F.col("literal")).when(
        ~F.col("answer_is_number"), F.lower(strip(F.col("answer_value")))
    )
    keyed = answers.withColumn("_number", number).withColumn("_text", text)
    by_number = provenance_match(keyed, evidence_numbers(executions, run), run, "_number", "_text")
    texts = keyed.where(~F.col("answer_is_number"))
    by_text = text_match(texts, outputs(executions, run, position), run, "_text", position)
    # What is found, numbers as written and texts, meets the answers in one join; a text has no number.
    found = by_number.unionByName(by_text.withColumn("_number", F.lit(None).cast("double")))
    found = found.select(*[F.col(k).alias(f"_f_{k}") for k in run], F.col("_number").alias("_f_number"), F.col("_text").alias("_f_text"))
    same = [F.col(k) == F.col(f"_f_{k}") for k in run]
    same += [F.col("_number").eqNullSafe(F.col("_f_number")), F.col("_text") == F.col("_f_text")]
    flagged = keyed.join(evidence_flags(executions, run), run, "left")
    return (
        flagged.join(found, same, "left")
        .withColumn("provenance_found", F.col("_f_text").isNotNull())
        .drop("_number", "_text", "_f_number", "_f_text", *[f"_f_{k}" for k in run])
    )


def verify_answers(answers: DataFrame) -> DataFrame:
    """Add ``checks`` and ``ok`` to answers with evidence attached; an abstention passes alone."""
    declined = F.array(_check("not_answerable", F.lit("pass"), F.lit("agent declined to answer")))
    checks = F.array_compact(
        F.array(check_type(), check_unit(), check_range(), check_provenance(), check_silent_nan(), check_plan_unit())
    )
    checked = computed_once(with_units(answers), "checks", F.when(abstains(), declined).otherwise(checks))
    return checked.withColumn("ok", ~F.exists("checks", lambda c: c["status"] == "fail"))


def checks_long(verified: DataFrame, keys: Sequence[str]) -> DataFrame:
    return verified.select(*keys, F.inline("checks"))


def running_rejections(verifications: DataFrame, run: Sequence[str], position: str) -> DataFrame:
    """Each verification with the number of rejections of its run so far, and whether it ends the run."""
    counted = running_count(verifications, ~F.col("ok"), position, run, "rejections")
    return counted.withColumn("ends_run", ~F.col("ok") & (F.col("rejections") == MAX_REJECTIONS + 1))


def rejection_sequence(verifications: DataFrame, run: Sequence[str], max_rejections: int = MAX_REJECTIONS) -> DataFrame:
    """Per run: how many answers were rejected and how it ended."""
    return (
        verifications.groupBy(*run)
        .agg(F.count(F.lit(1)).alias("verifications"), F.count_if(~F.col("ok")).alias("rejections"))
        .withColumn(
            "outcome",
            F.when(F.col("rejections") > max_rejections, F.lit("rejected"))
            .when(F.col("rejections") < F.col("verifications"), F.lit("answered"))
            .otherwise(F.lit("open")),
        )
    )
