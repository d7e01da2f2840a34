"""Grading: generous about form (units, spellings), strict about the value.

``grade`` is a set of column expressions over answers already joined with their questions.  Expected
columns: ``expected`` (text form) and ``expected_is_number``; ``answer_value`` (text form, NULL when
nothing was submitted) and ``answer_is_number``; ``answer_unit``; ``unit`` and ``tolerance`` of the
question.  ``with_grading_inputs`` derives what several rules share (the answer as number and as text,
normalised units, canonical texts) in projections of their own, so no rule repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import answer_key, float_text, general_format, parse_number
from ..functions.text import NOT_ANSWERABLE, canonical_text, squeeze, strip
from ..functions.units import COUNT_UNITS, COUNT_WORDS, canonical_unit, convert_canonical
from .slices import computed_once

def _verdict(
    correct: Column, reason: Column, got: Column | None = None, number: Column | None = None, converted: Column | None = None
) -> Column:
    return F.struct(
        correct.alias("correct"),
        reason.alias("reason"),
        (F.lit(None).cast("string") if got is None else got).alias("got"),
        (F.lit(None).cast("double") if number is None else number).alias("got_number"),
        (F.lit(False) if converted is None else converted).alias("unit_converted"),
    )


INPUTS = ("_number", "_truth", "_text", "_given", "_wanted", "_declined", "_same_text", "_converted")


def with_grading_inputs(df: DataFrame) -> DataFrame:
    """Add the shared inputs of the rules; ``drop(*INPUTS)`` removes them."""
    value, is_number = F.col("answer_value"), F.col("answer_is_number")
    direct = value.try_cast("double")
    e, g = F.col("_e"), F.col("_g")

    def textual(c: Column) -> Column:
        """Only a text truth that is not a number is compared by its canonical form."""
        needed = ~F.col("expected_is_number") & (F.col("_truth").isNull() | F.col("_number").isNull())
        return F.when(needed, canonical_text(c))

    return (
        df.withColumns(
            {
                # A number as it is, a text if it is entirely a number.
                "_number": F.when(is_number, direct).otherwise(parse_number(value)),
                "_truth": F.when(~F.col("expected_is_number"), parse_number(F.col("expected"))),
                "_given": canonical_unit(F.col("answer_unit")),
                "_wanted": canonical_unit(F.col("unit")),
                # A text that contains the abstention phrase.
                "_declined": ~is_number & F.lower(strip(value)).contains(NOT_ANSWERABLE),
            }
        )
        .withColumns(
            {
                "_text": F.when(is_number, float_text(F.col("_number"))).otherwise(value),
                "_converted": convert_canonical(F.col("_number"), F.col("_given"), F.col("_wanted")),
            }
        )
        .withColumns({"_e": textual(F.col("expected")), "_g": textual(F.col("_text"))})
        .withColumn("_same_text", (e == g) | (e.rlike(r"^\d{4}(-\d{2})?\z") & g.startswith(e)))
        .drop("_e", "_g")
    )


def grade_declined() -> Column:
    """Verdict of unanswerable questions and of abstentions; NULL where neither applies."""
    unanswerable = ~F.col("expected_is_number") & (F.col("expected") == NOT_ANSWERABLE)
    declined = F.col("_declined")
    reason = (
        F.when(unanswerable & declined, F.lit("correctly declined"))
        .when(unanswerable, F.lit("answered a question the dataset cannot answer"))
        .otherwise(F.lit("declined an answerable question"))
    )
    number = F.when(F.col("answer_is_number"), F.col("_number"))
    return F.when(unanswerable | declined, _verdict(unanswerable & declined, reason, F.col("_text"), number))


def grade_text() -> Column:
    """Verdict against a text truth: as numbers if both sides are numeric, else by canonical form."""
    number = F.col("_number")
    numeric = F.col("_truth").isNotNull() & number.isNotNull()
    right = F.when(numeric, F.abs(number - F.col("_truth")) <= F.col("tolerance")).otherwise(F.col("_same_text"))
    shown = F.when(numeric, general_format(number, 6)).otherwise(F.col("_text"))
    reason = F.when(right, F.lit("matches")).otherwise(F.concat(F.lit("expected "), F.col("expected"), F.lit(", got "), shown))
    got = F.when(numeric, float_text(number)).otherwise(F.col("_text"))
    return _verdict(right, reason, got, F.when(numeric, number))


def _compare(number: Column, converted: Column) -> Column:
    difference = F.abs(number - F.col("expected").try_cast("double"))
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    close = finite & (difference <= F.col("tolerance"))
    off = F.concat(
        F.lit("off by "), general_format(difference, 4), F.lit(" (tolerance "), general_format(F.col("tolerance"), 6),
        F.lit(" "), F.coalesce(F.col("unit"), F.lit("")), F.lit(")"),
    )
    reason = (
        F.when(~finite, F.lit("answer is not a finite number")).when(close, F.lit("within tolerance")).otherwise(off)
    )
    return _verdict(close, reason, float_text(number), number, converted)


def _is_count() -> Column:
    return F.coalesce(F.col("unit").isin(*COUNT_UNITS), F.lit(False))


def _count_unit_fits() -> Column:
    """No unit, the unit of the question, or a word for records."""
    return (
        F.col("answer_unit").isNull()
        | F.coalesce(F.col("_given") == F.col("unit"), F.lit(False))
        | squeeze(F.col("answer_unit")).isin(*COUNT_WORDS)
    )


def _differs() -> Column:
    """Both sides name a unit and the units are not the same."""
    named = F.col("unit").isNotNull() & F.col("answer_unit").isNotNull()
    return named & ~F.col("_given").eqNullSafe(F.col("_wanted"))


def _grade_value(refusal: Column, rescaled: Column) -> Column:
    """A number either has a unit that is refused, or is compared, rescaled where that applies."""
    value = F.when(rescaled, F.col("_converted")).otherwise(F.col("_number"))
    said = F.concat(F.lit("unit '"), F.col("answer_unit"), F.lit("' "), refusal)
    refused = _verdict(F.lit(False), said, float_text(F.col("_number")), F.col("_number"))
    return F.when(refusal.isNotNull(), refused).otherwise(_compare(value, rescaled))


def _count_refusal() -> Column:
    return F.when(~_count_unit_fits(), F.concat(F.lit("does not count "), F.col("unit")))


def _unit_refusal() -> Column:
    text = F.concat(F.lit("is not convertible to '"), F.col("unit"), F.lit("'"))
    return F.when(_differs() & F.col("_converted").isNull(), text)


def grade_count() -> Column:
    """Verdict of a count: the label has to fit, the value is never rescaled."""
    return _grade_value(_count_refusal(), F.lit(False))


def grade_numeric() -> Column:
    """Verdict of a measured value: converted to the unit of the question, then within tolerance."""
    return _grade_value(_unit_refusal(), _differs())


def grade() -> Column:
    """The whole decision; needs ``with_grading_inputs``."""
    said = F.concat(F.lit("expected a number, got '"), F.col("answer_value"), F.lit("'"))
    unanswerable = ~F.col("expected_is_number") & (F.col("expected") == NOT_ANSWERABLE)
    return (
        F.when(F.col("answer_value").isNull(), _verdict(F.lit(False), F.lit("no answer was submitted")))
        .when(unanswerable | F.col("_declined"), grade_declined())
        .when(~F.col("expected_is_number"), grade_text())
        .when(F.col("_number").isNull(), _verdict(F.lit(False), said, F.col("answer_value")))
        # Counts and measured values share one comparison, which keeps the generated code small.
        .otherwise(
            _grade_value(
                F.when(_is_count(), _count_refusal()).otherwise(_unit_refusal()), ~_is_count() & _differs()
            )
        )
    )


def grade_runs(df: DataFrame, name: str = "verdict") -> DataFrame:
    """Add the verdict struct; a projection without shuffle."""
    return computed_once(with_grading_inputs(df), name, grade()).drop(*INPUTS)


def join_questions(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Runs with the unit, tolerance and traps of their question; unknown ids stay.

    The side to send around is left to adaptive execution, which knows its size at run time.
    """
    wanted = [c for c in ("question_id", "text", "unit", "tolerance", "traps") if c in questions.columns]
    return runs.join(questions.select(*wanted, F.lit(True).alias("question_known")), "question_id", "left")


def regrade(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Apply the current rules to stored runs.

    ``runs`` carries answer_value / answer_is_number (the recorded answer, else what was graded) and
    expected / expected_is_number.  Rows without an answer, with an unknown question or with an
    answer the submission rules would refuse stay as they are.
    """
    joined = join_questions(runs, questions)
    text_ok = F.col("answer_is_number") | (
        (F.length(strip(F.col("answer_value"))) > 0) & (F.length(strip(F.col("answer_value"))) <= 100)
    )
    unit_ok = F.col("answer_unit").isNull() | (F.length(strip(F.col("answer_unit"))) > 0)
    applies = F.col("question_known").isNotNull() & F.col("answer_value").isNotNull() & text_ok & unit_ok
    graded = grade_runs(joined.withColumn("_applies", F.coalesce(applies, F.lit(False))), "_v")
    out = {}
    for name in ("correct", "reason", "got", "got_number", "unit_converted"):
        if name in runs.columns and name != "got_number":
            out[name] = F.when(F.col("_applies"), F.col(f"_v.{name}")).otherwise(F.col(name))
    if "answer_key" in runs.columns:
        key = answer_key(F.col("_v.got_number"), F.col("_v.got"), F.col("tolerance"))
        out["answer_key"] = F.when(F.col("_applies"), key).otherwise(F.col("answer_key"))
    changed = F.col("_applies") & (F.col("_v.correct") != F.col("correct"))
    return graded.withColumn("verdict_changed", F.coalesce(changed, F.lit(False))).select(
        *[out[c].alias(c) if c in out else F.col(c) for c in runs.columns], "verdict_changed"
    )


def regrade_effect(regraded: DataFrame, old: str, new: str) -> DataFrame:
    """How many verdicts changed, and the share correct before and after."""
    return regraded.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col(old) != F.col(new)).alias("changed"),
        F.avg(F.col(old).cast("int")).alias("pass_before"),
        F.avg(F.col(new).cast("int")).alias("pass_after"),
    )
