"""Registered queries over answers: units, text, numbers, grading, evidence, verification, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..functions import units as U
from ..operators import analysis as AN
from ..operators import grading as G
from ..operators import validation as VA
from ..operators import verification as V
from .registry import query
from .views import ANSWER_KEY, MARKER, Tables, pick, r

KEY = ", ".join(ANSWER_KEY)


# ------------------------------------------------------------------------------- units
@query(
    "unit_alias_join",
    """SELECT unit AS answer_unit, CASE WHEN unit IN ('°C', 'celsius') THEN '°C' WHEN unit = 'Kelvin' THEN 'K'
           WHEN unit = ' degF ' THEN '°F' ELSE unit END AS canonical,
         CAST(CASE WHEN unit IN ('°C', 'celsius') THEN 60 WHEN unit = 'Kelvin' THEN 350
           WHEN unit = ' degF ' THEN 140 WHEN unit = 'mm' THEN 20000 END AS DOUBLE) AS plausible_max,
         CAST(count(*) AS BIGINT) AS n
       FROM answers_t GROUP BY unit""",
)
def unit_alias_join(t: Tables):
    joined = U.unit_alias_join(t.answers, "answer_unit")
    return joined.groupBy("answer_unit", "canonical", "plausible_max").agg(F.count(F.lit(1)).alias("n"))


SPELLINGS = (
    "°C", "degC", " Celsius ", "kmh", "m s-1", "mbar", "h", "mm/day", "°C per  decade", "furlongs", "mm/furlong",
)
CANONICAL = ("°C", "°C", "°C", "km/h", "m/s", "hPa", "hours", "mm/day", "°C/decade", None, None)


def sql_case(key: str, values) -> str:
    shown = ["NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + " END"


@query(
    "normalize_unit",
    f"""SELECT {sql_case('l_partkey % 12', SPELLINGS)} AS unit, {sql_case('l_partkey % 12', CANONICAL)} AS canonical,
          l_partkey % 12 IN (7, 8) AS is_rate, CAST(count(*) AS BIGINT) AS n
        FROM lineitem GROUP BY l_partkey % 12""",
)
def normalize_unit(t: Tables):
    unit = pick(F.col("l_partkey"), 12, *SPELLINGS)
    rows = t.lineitem.select(unit.alias("unit"), U.normalize_unit(unit).alias("u"))
    return rows.groupBy("unit", "u.canonical", "u.is_rate").agg(F.count(F.lit(1)).alias("n"))


PAIRS = (
    ("km/h", "m/s"), ("m/s", "km/h"), ("°C", "K"), ("K", "°C"), ("°C", "°F"), ("°F", "°C"), ("hPa", "Pa"),
    ("cm", "mm"), ("degC", "°C"), ("°C", "mm"), ("km/h", "hPa"), ("furlongs", "mm"), ("days", "hours"),
    ("knots", "mph"),
)


@query(
    "convert_unit",
    f"""SELECT {KEY}, round(CASE l_partkey % 14 WHEN 0 THEN l_quantity / 3.6 WHEN 1 THEN l_quantity * 3.6
          WHEN 2 THEN l_quantity + 273.15 WHEN 3 THEN l_quantity - 273.15 WHEN 4 THEN l_quantity * 9 / 5 + 32
          WHEN 5 THEN (l_quantity - 32) * 5 / 9 WHEN 6 THEN l_quantity * 100 WHEN 7 THEN l_quantity * 10
          WHEN 8 THEN l_quantity WHEN 13 THEN l_quantity * 0.514444 / 0.44704 END, 6) + 0.0 AS converted
        FROM lineitem""",
)
def convert_unit(t: Tables):
    source, target = (pick(F.col("l_partkey"), 14, *[p[i] for p in PAIRS]) for i in (0, 1))
    rows = t.lineitem.select(*ANSWER_KEY, "l_quantity", source.alias("source"), target.alias("target"))
    converted = U.convert_unit(F.col("l_quantity"), F.col("source"), F.col("target"))
    return rows.select(*ANSWER_KEY, r(converted, 6).alias("converted"))


# ------------------------------------------------------------------------------- numbers and texts
@query(
    "parse_number",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_totalprice WHEN 1 THEN o_custkey * 1000 + 234
         WHEN 2 THEN o_custkey * 100.0 WHEN 3 THEN -o_custkey END AS number FROM orders""",
)
def parse_number(t: Tables):
    c = F.col("o_custkey").cast("string")
    text = pick(
        F.col("o_orderkey"), 6,
        F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit("\t")),
        F.concat(c, F.lit(",234")),
        F.concat(c, F.lit("E+2")),
        F.concat(F.lit("-"), c),
        F.date_format("time", "yyyy-MM"),
        F.col("o_orderpriority"),
    )
    return t.orders_t.select("o_orderkey", N.parse_number(text).alias("number"))


@query("canonical_text", "SELECT o_orderkey, canonical FROM texts_t")
def canonical_text(t: Tables):
    return t.texts.select("o_orderkey", X.canonical_text(F.col("answer_value")).alias("canonical"))


@query("text_matches", "SELECT o_orderkey, starts_with(canonical, expected) AS matches FROM texts_t")
def text_matches(t: Tables):
    return t.texts.select("o_orderkey", X.text_matches(F.col("expected"), F.col("answer_value")).alias("matches"))


@query(
    "answer_key",
    f"""SELECT {KEY}, CASE WHEN abstains THEN 'not answerable'
          ELSE printf('%.6g', round_even(got / 0.01, 0) * 0.01) END AS answer_key FROM answers_t""",
)
def answer_key(t: Tables):
    key = N.answer_key(F.col("_number"), F.col("answer_value"), F.col("tolerance"))
    return G.with_grading_inputs(t.answers).select(*ANSWER_KEY, key.alias("answer_key"))


NUMBER_SQL = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


@query(
    "extract_numbers",
    f"""SELECT doc_id, CAST(len(n) AS INT) AS n_numbers, n[1] AS first, n[-1] AS last, list_min(n) AS smallest, list_max(n) AS largest FROM (
          SELECT doc_id, list_transform(regexp_extract_all(text, '{NUMBER_SQL}'), lambda x: CAST(x AS DOUBLE)) AS n FROM documents)""",
)
def extract_numbers(t: Tables):
    found = t.documents.select("doc_id", N.extract_numbers(F.col("text")).alias("n"))
    return found.select(
        "doc_id", F.size("n").alias("n_numbers"), F.get("n", F.lit(0)).alias("first"), F.try_element_at("n", F.lit(-1)).alias("last"),
        F.array_min("n").alias("smallest"), F.array_max("n").alias("largest"),
    )


@query(
    "literal_decimals",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN length(split_part(CAST(value AS VARCHAR), '.', 2)) WHEN 1 THEN 0 END AS decimals
       FROM events""",
)
def literal_decimals(t: Tables):
    u = F.col("user_id").cast("string")
    literal = pick(F.col("event_id"), 3, F.col("value").cast("string"), u, F.concat(u, F.lit("E-3")))
    return t.events.select("event_id", N.literal_decimals(literal).alias("decimals"))


@query(
    "submitted_literal_forms",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat(user_id, '.10') WHEN 1 THEN concat('2023-0', user_id % 9 + 1)
         WHEN 2 THEN concat(user_id, '.0') WHEN 3 THEN 'none' WHEN 4 THEN 'none' WHEN 5 THEN concat('-', user_id, 'E-3')
         ELSE concat('a "', user_id, '" b') END AS literal FROM events""",
)
def submitted_literal_forms(t: Tables):
    """Nested and repeated keys, other types, broken JSON and quotes around a number of the row."""
    u = F.col("user_id").cast("string")
    month = F.concat(F.lit('"2023-0'), (F.col("user_id") % 9 + 1).cast("string"), F.lit('"'))
    raw = pick(
        F.col("event_id"), 7,
        F.concat(F.lit('{"value": '), u, F.lit('.10, "meta": {"value": 7.5}}')),
        F.concat(F.lit('{"value": '), u, F.lit(', "unit": null, "value": '), month, F.lit("}")),
        F.concat(F.lit('{"value": '), month, F.lit(', "value": '), u, F.lit(".0}")),
        F.concat(F.lit('{"meta": {"value": '), u, F.lit("}}")),
        F.concat(F.lit('{"value": '), u, F.lit(".10")),
        F.concat(F.lit('{"note": "\\"value\\": 3", "value" : -'), u, F.lit("E-3 }")),
        F.concat(F.lit('{"value": "a \\"'), u, F.lit('\\" b"}')),
    )
    return t.events.select("event_id", N.submitted_literal(raw, F.lit("none")).alias("literal"))


@query(
    "white_space_of_any_kind",
    """SELECT event_id, concat('2023-0', user_id % 9 + 1) AS canonical, CAST(user_id AS DOUBLE) AS number, 'mm' AS unit, TRUE AS blank
       FROM events""",
)
def white_space_of_any_kind(t: Tables):
    """Months, numbers, units and empty texts between and around spaces that are not ASCII."""
    spaces = ["\u00a0", "\u3000", "\u2009\u202f", "\u001f", "\u0085", "\u2028\t"]
    gap = pick(F.col("event_id"), len(spaces), *[F.lit(s) for s in spaces])
    months = [m.capitalize() for m in X.MONTHS[:9]]
    month = F.element_at(F.array(*[F.lit(m) for m in months]), (F.col("user_id") % 9 + 1).cast("int"))
    number = N.parse_number(F.concat(gap, F.col("user_id").cast("string"), gap))
    return t.events.select(
        "event_id",
        X.canonical_text(F.concat(gap, month, gap, F.lit("2023"))).alias("canonical"),
        number.alias("number"),
        U.canonical_unit(F.concat(gap, F.lit("MM"), gap)).alias("unit"),
        X.is_blank(gap).alias("blank"),
    )


@query(
    "submitted_literal",
    "SELECT event_id, CASE event_id % 6 WHEN 4 THEN concat(user_id, '.50') ELSE 'none' END AS literal FROM calls_t",
)
def submitted_literal(t: Tables):
    return t.calls.select("event_id", N.submitted_literal(F.col("raw_arguments"), F.lit("none")).alias("literal"))


@query(
    "truncate_text",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(left(text, 100), '... [truncated, ', length(text) - 100,
         ' more characters]') ELSE text END AS shown FROM documents""",
)
def truncate_text(t: Tables):
    return t.documents.select("doc_id", X.truncate_text(F.col("text"), 100).alias("shown"))


CATEGORY_SQL = """CASE WHEN reason LIKE 'no answer%' THEN 'no_answer' WHEN reason LIKE 'answered a%' THEN 'answered_unanswerable'
    WHEN reason LIKE 'declined%' THEN 'wrongly_declined' WHEN reason LIKE 'off by%' THEN 'wrong_value' ELSE 'other' END"""


@query("categorize_reason", f"SELECT reason, {CATEGORY_SQL} AS category, CAST(count(*) AS BIGINT) AS n FROM runs_t GROUP BY reason")
def categorize_reason(t: Tables):
    counted = t.runs.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("reason", X.categorize_reason(F.col("reason")).alias("category"), "n")


# ------------------------------------------------------------------------------- grading
IN_C = """CASE unit WHEN 'Kelvin' THEN got - 273.15 WHEN ' degF ' THEN (got - 32) * 5 / 9 WHEN 'mm' THEN NULL ELSE got END"""
GRADED = f"""SELECT *, CASE WHEN abstains THEN 'declined an answerable question'
      WHEN unit = 'mm' THEN 'unit ''mm'' is not convertible to ''°C'''
      WHEN abs(({IN_C}) - expected) <= 0.01 THEN 'within tolerance' ELSE 'off by 0.02 (tolerance 0.01 °C)' END AS reason,
    CASE WHEN abstains THEN NULL WHEN unit = 'mm' THEN got ELSE {IN_C} END AS got_c,
    NOT abstains AND coalesce(unit IN ('Kelvin', ' degF '), false) AS converted FROM answers_t"""


def verdict_columns(verdict: Column, digits: int = 6) -> list[Column]:
    return [
        verdict["correct"].alias("correct"),
        verdict["reason"].alias("reason"),
        r(verdict["got_number"], digits).alias("got_number"),
        verdict["unit_converted"].alias("unit_converted"),
    ]


GRADED_OUT = "reason = 'within tolerance' AS correct, reason, round(got_c, 6) + 0.0 AS got_number, converted AS unit_converted"


@query(
    "grade_numeric",
    f"""SELECT {KEY}, CASE WHEN NOT abstains THEN correct END AS correct, CASE WHEN NOT abstains THEN reason END AS reason, got_number,
          CASE WHEN NOT abstains THEN unit_converted END AS unit_converted FROM (SELECT *, {GRADED_OUT.replace("correct, reason,", "correct,")} FROM ({GRADED}))""",
)
def grade_numeric(t: Tables):
    """A verdict for every answer that is a number, none for the others."""
    verdict = F.when(F.col("answer_is_number"), G.grade_numeric())
    return G.with_grading_inputs(t.answers).withColumn("v", verdict).select(*ANSWER_KEY, *verdict_columns(F.col("v")))


COUNT_LABELS = ("hours", "records", " Hourly  Records ", "days", "°C", "rows", None, "hrs")


@query(
    "grade_count",
    f"""SELECT {KEY}, fits AND close AS correct, CASE WHEN NOT fits THEN concat('unit ''', label, ''' does not count hours')
          WHEN close THEN 'within tolerance' ELSE 'off by 1 (tolerance 0.5 hours)' END AS reason,
          l_quantity + plus AS got_number, false AS unit_converted
        FROM (SELECT *, {sql_case('l_linenumber', COUNT_LABELS)} AS label,
                l_linenumber NOT IN (3, 4) AS fits, CAST(l_orderkey % 3 = 0 AS INT) AS plus, l_orderkey % 3 <> 0 AS close
              FROM lineitem)""",
)
def grade_count(t: Tables):
    labels = [F.lit(x).cast("string") for x in COUNT_LABELS]
    rows = t.lineitem.select(
        *ANSWER_KEY,
        F.col("l_quantity").cast("string").alias("expected"),
        F.lit(True).alias("expected_is_number"),
        (F.col("l_quantity") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)).cast("string").alias("answer_value"),
        F.lit(True).alias("answer_is_number"),
        pick(F.col("l_linenumber"), 8, *labels).alias("answer_unit"),
        F.lit("hours").alias("unit"),
        F.lit(0.5).alias("tolerance"),
    )
    return G.with_grading_inputs(rows).withColumn("v", G.grade_count()).select(*ANSWER_KEY, *verdict_columns(F.col("v")))


@query(
    "grade_text",
    """SELECT o_orderkey, starts_with(canonical, expected) AS correct,
         CASE WHEN starts_with(canonical, expected) THEN 'matches' ELSE concat('expected ', expected, ', got ', got) END AS reason
       FROM texts_t""",
)
def grade_text(t: Tables):
    return G.with_grading_inputs(t.texts).withColumn("v", G.grade_text()).select("o_orderkey", "v.correct", "v.reason")


@query(
    "grade_declined",
    f"""SELECT {KEY}, l_linenumber > 3 AND abstains AS correct,
          CASE WHEN l_linenumber > 3 AND abstains THEN 'correctly declined'
               WHEN l_linenumber > 3 THEN 'answered a question the dataset cannot answer'
               ELSE 'declined an answerable question' END AS reason
        FROM answers_t WHERE l_linenumber > 3 OR abstains""",
)
def grade_declined(t: Tables):
    hard = F.col("l_linenumber") > 3
    rows = t.answers.withColumn("expected", F.when(hard, F.lit(X.NOT_ANSWERABLE)).otherwise(F.col("expected")))
    rows = G.with_grading_inputs(rows.withColumn("expected_is_number", ~hard)).withColumn("v", G.grade_declined())
    return rows.where(F.col("v").isNotNull()).select(*ANSWER_KEY, "v.correct", "v.reason")


@query(
    "grade_runs",
    f"""SELECT concat_ws('/', {KEY}) AS id, {GRADED_OUT} FROM ({GRADED})
        UNION ALL
        SELECT CAST(o_orderkey AS VARCHAR), starts_with(canonical, expected),
          CASE WHEN starts_with(canonical, expected) THEN 'matches' ELSE concat('expected ', expected, ', got ', got) END,
          NULL, false FROM texts_t""",
)
def grade_runs(t: Tables):
    price = F.regexp_replace(F.col("l_extendedprice").cast("string"), r"^(.*)E(.*)$", "$1e$2")
    ids = F.concat_ws("/", *[F.col(c).cast("string") for c in ANSWER_KEY[:-1]], price)
    numeric = t.answers.withColumn("id", ids).drop(*ANSWER_KEY)
    both = numeric.unionByName(t.texts.withColumn("id", F.col("o_orderkey").cast("string")).drop("o_orderkey"))
    return G.grade_runs(both).select("id", *verdict_columns(F.col("verdict")))


def stored_answers(t: Tables):
    """Stored runs to regrade: question by part, some without an answer, some of unknown questions."""
    n = F.col("l_partkey") % 30
    answered = F.col("l_orderkey") % 9 != 0
    rows = t.answers.withColumn("question_id", F.concat(F.lit("n"), n.cast("string")))
    rows = rows.withColumn("answer_value", F.when(answered, F.col("answer_value"))).drop("unit", "tolerance")
    return rows.select(
        "*",
        (F.col("l_orderkey") % 2 == 0).alias("correct"),
        F.lit("old").alias("reason"),
        F.lit("x").alias("got"),
        F.lit(False).alias("unit_converted"),
        F.lit("k").alias("answer_key"),
    )


def nation_questions(t: Tables):
    n = F.col("n_nationkey")
    return t.nation.select(
        F.concat(F.lit("n"), n.cast("string")).alias("question_id"), F.lit("°C").alias("unit"), F.lit(0.01).alias("tolerance")
    )


REGRADED = f"""SELECT *, concat('n', l_partkey % 30) AS question_id, l_partkey % 30 < 25 AND l_orderkey % 9 <> 0 AS applies,
    l_orderkey % 2 = 0 AS old FROM ({GRADED})"""


@query(
    "regrade",
    f"""SELECT {KEY}, question_id, CASE WHEN applies THEN reason = 'within tolerance' ELSE old END AS correct,
          CASE WHEN applies THEN reason ELSE 'old' END AS reason,
          CASE WHEN NOT applies THEN 'k' WHEN abstains THEN 'not answerable'
            ELSE printf('%.6g', round_even(got_c / 0.01, 0) * 0.01) END AS answer_key,
          applies AND converted AS unit_converted,
          applies AND (reason = 'within tolerance') <> old AS verdict_changed
        FROM ({REGRADED})""",
)
def regrade(t: Tables):
    out = G.regrade(stored_answers(t), nation_questions(t))
    return out.select(*ANSWER_KEY, "question_id", "correct", "reason", "answer_key", "unit_converted", "verdict_changed")


@query(
    "regrade_effect",
    f"""SELECT CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE fresh <> old) AS BIGINT) AS changed,
          round(avg(CAST(old AS INT)), 6) AS pass_before, round(avg(CAST(fresh AS INT)), 6) AS pass_after
        FROM (SELECT old, CASE WHEN applies THEN reason = 'within tolerance' ELSE old END AS fresh FROM ({REGRADED}))""",
)
def regrade_effect(t: Tables):
    before = stored_answers(t).withColumn("old", F.col("correct"))
    out = G.regrade_effect(G.regrade(before, nation_questions(t)), "old", "correct")
    return out.select("runs", "changed", r("pass_before", 6).alias("pass_before"), r("pass_after", 6).alias("pass_after"))


# ------------------------------------------------------------------------------- verification
RUN = ["user_id"]


def attached(t: Tables):
    rows = t.submissions.withColumn("literal", N.submitted_literal(F.col("raw_arguments"), F.col("answer_value")))
    return V.attach_evidence(rows, t.executions, RUN, "event_id")


@query(
    "collect_evidence",
    """SELECT user_id, CAST(n_runs AS BIGINT) AS n_runs, saw_nan, CAST(max(length(text)) AS BIGINT) AS n_chars,
         CAST(count(number) AS BIGINT) AS n_numbers, min(number) AS smallest, max(number) AS largest
       FROM flags_t JOIN joined_t USING (user_id) LEFT JOIN evidence_t USING (user_id) GROUP BY user_id, n_runs, saw_nan""",
)
def collect_evidence(t: Tables):
    return V.collect_evidence(t.executions, RUN)


@query(
    "evidence_text",
    """SELECT user_id, event_id, CAST(sum(length(text) + 1) OVER (PARTITION BY user_id ORDER BY event_id) - length(text) - 1 AS BIGINT)
         AS start, text FROM outputs_t""",
)
def evidence_text(t: Tables):
    return V.evidence_text(t.executions, RUN, "event_id")


@query(
    "text_over_seams",
    """SELECT event_id, contains(text, needle) AS found FROM needles_t JOIN joined_t USING (user_id)
       UNION ALL SELECT event_id, false FROM needles_t ANTI JOIN joined_t USING (user_id)""",
)
def text_over_seams(t: Tables):
    rows = t.needles
    hits = V.text_match(rows, V.outputs(t.executions, RUN, "event_id"), RUN, "needle", "event_id")
    joined = rows.join(hits.withColumn("found", F.lit(True)), [*RUN, "needle"], "left")
    return joined.select("event_id", F.coalesce("found", F.lit(False)).alias("found"))


@query("evidence_numbers", "SELECT user_id, number FROM evidence_t")
def evidence_numbers(t: Tables):
    return V.evidence_numbers(t.executions, RUN)


@query(
    "provenance_match",
    """SELECT event_id, coalesce(found, false) AS found FROM submissions_t LEFT JOIN found_t USING (event_id)
       WHERE number IS NOT NULL""",
)
def provenance_match(t: Tables):
    rows = t.submissions.where("answer_is_number").withColumn("v", F.col("answer_value").try_cast("double"))
    hits = V.provenance_match(rows, V.evidence_numbers(t.executions, RUN), RUN, "v", "answer_value")
    joined = rows.join(hits.withColumn("found", F.lit(True)), [*RUN, "v", "answer_value"], "left")
    return joined.select("event_id", F.coalesce("found", F.lit(False)).alias("found"))


def status_sql(status: str) -> str:
    return f"SELECT event_id, CASE WHEN kind = 5 THEN 'declined' ELSE {status} END AS status FROM checks_t"


def status_of(check):
    """Of every answer; one that declines to answer is not checked."""
    return F.when(V.abstains(), "declined").otherwise(check["status"]).alias("status")


@query("check_type", status_sql("CASE WHEN type_bad THEN 'fail' ELSE 'pass' END"))
def check_type(t: Tables):
    return t.submissions.select("event_id", status_of(V.check_type()))


@query("check_unit", status_sql("unit_status"))
def check_unit(t: Tables):
    return V.with_units(t.submissions).select("event_id", status_of(V.check_unit()))


@query("check_range", status_sql("range_status"))
def check_range(t: Tables):
    return V.with_units(t.submissions).select("event_id", status_of(V.check_range()))


@query("check_provenance", status_sql("provenance_status"))
def check_provenance(t: Tables):
    return attached(t).select("event_id", status_of(V.check_provenance()))


@query("check_silent_nan", status_sql("nan_status"))
def check_silent_nan(t: Tables):
    flagged = t.submissions.join(V.evidence_flags(t.executions, RUN), RUN, "left")
    return flagged.select("event_id", status_of(V.check_silent_nan()))


@query("check_plan_unit", status_sql("plan_status"))
def check_plan_unit(t: Tables):
    return V.with_units(t.submissions).select("event_id", status_of(V.check_plan_unit()))


@query(
    "verify_answers",
    """SELECT event_id, kind = 5 OR NOT (type_bad OR range_status = 'fail' OR provenance_status = 'fail') AS ok,
         CASE WHEN kind = 5 THEN 'not_answerable=pass' ELSE concat_ws(' ',
           concat('type=', CASE WHEN type_bad THEN 'fail' ELSE 'pass' END), concat('unit=', unit_status),
           concat('range=', range_status), concat('provenance=', provenance_status), concat('silent_nan=', nan_status),
           CASE WHEN plan_status IS NOT NULL THEN concat('plan_unit=', plan_status) END) END AS checks
       FROM checks_t""",
)
def verify_answers(t: Tables):
    shown = F.array_join(F.transform("checks", lambda c: F.concat_ws("=", c["name"], c["status"])), " ")
    return V.verify_answers(attached(t)).select("event_id", "ok", shown.alias("checks"))


@query(
    "verify_checks_long",
    """SELECT name, status, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT 'provenance' AS name, provenance_status AS status FROM checks_t WHERE kind <> 5
         UNION ALL SELECT 'unit', unit_status FROM checks_t WHERE kind <> 5
         UNION ALL SELECT 'range', range_status FROM checks_t WHERE kind <> 5
         UNION ALL SELECT 'silent_nan', nan_status FROM checks_t WHERE kind <> 5
         UNION ALL SELECT 'plan_unit', plan_status FROM checks_t WHERE kind <> 5 AND plan_status IS NOT NULL
         UNION ALL SELECT 'type', CASE WHEN type_bad THEN 'fail' ELSE 'pass' END FROM checks_t WHERE kind <> 5
         UNION ALL SELECT 'not_answerable', 'pass' FROM checks_t WHERE kind = 5) GROUP BY name, status""",
)
def verify_checks_long(t: Tables):
    long = V.checks_long(V.verify_answers(attached(t)), ["event_id"])
    return long.groupBy("name", "status").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------- record validation
STATUS_SQL = """CASE WHEN tool = 'delete_everything' THEN 'unknown_tool' WHEN event_id % 6 = 3 THEN 'invalid_json'
    WHEN tool = 'run_python' AND event_id % 6 = 1 THEN 'ok' WHEN tool = 'run_python' AND event_id % 6 = 2 THEN 'rule_violation'
    WHEN tool = 'submit_answer' AND event_id % 6 = 4 THEN 'ok' ELSE 'schema_violation' END"""


@query("validate_tool_calls", f"SELECT event_id, tool, {STATUS_SQL} AS status FROM calls_t")
def validate_tool_calls(t: Tables):
    return VA.validate_tool_calls(t.calls.drop("status")).select("event_id", "tool", "status")


def _doc(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


# What is made of each row in turn: (outcome, tool); the last tool's name goes on with a number.
CALLS = (
    ("ok", "run_python"),
    ("ok", "submit_answer"),
    ("ok", "describe_dataset"),
    ("invalid_json", "run_python"),
    ("invalid_json", "submit_answer"),
    ("schema_violation", "run_python"),
    ("schema_violation", "submit_answer"),
    ("schema_violation", "submit_answer"),
    ("schema_violation", "describe_dataset"),
    ("schema_violation", "run_python"),
    ("rule_violation", "run_python"),
    ("rule_violation", "submit_answer"),
    ("rule_violation", "submit_answer"),
    ("rule_violation", "submit_answer"),
    ("ok", "submit_answer"),
    ("unknown_tool", "tool_"),
)


def made_arguments(number: Column, word: Column) -> list[Column]:
    """Raw arguments made from a number and a word of a row, one for each of ``CALLS``."""
    n = number.cast("string")
    code = _doc('{"code": "total = ', n, '"}')

    def answer(value: Column | str, unit: str = '"mm"') -> Column:
        return _doc('{"unit": ', unit, ', "value": ', value, ', "method_summary": "sum"}')

    return [
        code,
        answer(_doc(n, ".25")),
        F.lit("{}"),
        F.substring(code, F.lit(1), F.length(code) - 2),  # cut short
        word,
        F.replace(code, F.lit("code"), F.lit("cod")),  # misspelt field
        answer(_doc('{"x": ', n, "}")),
        _doc('{"value": ', n, ', "method_summary": "max"}'),  # no unit
        _doc('{"', word, '": ', n, "}"),
        _doc('"', word, '"'),
        F.lit('{"code": "\\t\u00a0\u3000"}'),  # white space only
        answer('"\u2003"'),
        answer("Infinity"),
        answer(n, '"\\t"'),  # blank unit
        answer(_doc('"2024-0', (number % 9 + 1).cast("string"), '"'), "null"),
        F.lit("{}"),
    ]


def made_tool(number: Column, turn: Column) -> Column:
    name = pick(turn, len(CALLS), *[F.lit(tool) for _, tool in CALLS])
    return F.when(name == "tool_", F.concat(name, number.cast("string"))).otherwise(name)


@query(
    "validate_tool_calls_cases",
    f"""SELECT event_id, {sql_case(f'event_id % {len(CALLS)}', [c[1] for c in CALLS])}
            || CASE WHEN event_id % {len(CALLS)} = {len(CALLS) - 1} THEN CAST(user_id AS VARCHAR) ELSE '' END AS tool,
          {sql_case(f'event_id % {len(CALLS)}', [c[0] for c in CALLS])} AS status FROM events""",
)
def validate_tool_calls_cases(t: Tables):
    turn, number = F.col("event_id"), F.col("user_id")
    raw = pick(turn, len(CALLS), *made_arguments(number, F.col("event_type")))
    rows = t.events.select("event_id", made_tool(number, turn).alias("tool"), raw.alias("raw_arguments"))
    return VA.validate_tool_calls(rows).select("event_id", "tool", "status")


@query(
    "validation_errors_long",
    """WITH e AS (SELECT event_id, tool, event_id % 6 AS k FROM calls_t WHERE tool <> 'delete_everything' AND event_id % 6 <> 3)
       SELECT event_id, 'code' AS path, 'Field required' AS message FROM e WHERE tool = 'run_python' AND k IN (0, 4, 5)
       UNION ALL SELECT event_id, unnest(['value', 'unit', 'method_summary']), 'Field required' FROM e
         WHERE tool = 'submit_answer' AND k IN (0, 1, 2)
       UNION ALL SELECT event_id, 'k', 'Extra inputs are not permitted' FROM e WHERE k = 0
       UNION ALL SELECT event_id, 'code', 'Extra inputs are not permitted' FROM e WHERE tool = 'submit_answer' AND k IN (1, 2)
       UNION ALL SELECT event_id, unnest(['value', 'unit', 'method_summary']), 'Extra inputs are not permitted' FROM e
         WHERE tool = 'run_python' AND k IN (4, 5)
       UNION ALL SELECT event_id, 'code', 'Value error, code is empty or whitespace only' FROM e WHERE tool = 'run_python' AND k = 2
       UNION ALL SELECT event_id, 'value.float', 'Input should be a valid number' FROM e WHERE tool = 'submit_answer' AND k = 5
       UNION ALL SELECT event_id, 'value.str', 'Input should be a valid string' FROM e WHERE tool = 'submit_answer' AND k = 5""",
)
def validation_errors_long(t: Tables):
    return VA.validation_errors_long(VA.validate_tool_calls(t.calls), ["event_id"]).select("event_id", "path", "message")


def made_plan(order: Column, customer: Column) -> Column:
    """A plan document whose faults follow from two numbers; ``PLAN_STATUS`` says the same in SQL."""
    step = lambda tool, i: _doc(f'{{"description": "step ', i.cast("string"), f'", "tool": "{tool}"}}')
    runs = F.when(order % 10 > 0, F.transform(F.sequence(F.lit(1), (order % 10).cast("int")), lambda i: step("run_python", i)))
    steps = F.concat(
        F.when(order % 23 == 0, F.array(step("erase_disk", F.lit(0)))).otherwise(F.array().cast("array<string>")),
        F.coalesce(runs, F.array().cast("array<string>")),
        F.when(customer % 4 > 0, F.array(step("submit_answer", order))).otherwise(F.array().cast("array<string>")),
    )
    notes = F.transform(F.sequence(F.lit(0), (customer % 7).cast("int")), lambda i: _doc('"note ', i.cast("string"), '"'))
    doc = _doc(
        '{"steps": [', F.array_join(steps, ", "), '], "expected_unit": "', F.when(order % 2 == 0, "mm").otherwise("hPa"),
        '", "answerable": ', F.when(order % 3 == 0, "true").otherwise("false"), ', "assumptions": [', F.array_join(notes, ", "),
        '], "interpretation": "', F.when(order % 13 == 0, "").otherwise(_doc("total of ", customer.cast("string"))), '"',
        F.when(order % 19 == 0, ', "mood": 1').otherwise(""), "}",
    )
    return F.when(order % 17 == 0, F.substring(doc, F.lit(1), F.length(doc) - 1)).otherwise(doc)


PLAN_STATUS = """CASE WHEN o_orderkey % 17 = 0 THEN 'invalid_json'
    WHEN o_orderkey % 19 = 0 THEN 'schema_violation'
    -- The steps of a list that is too long are not looked at.
    WHEN o_orderkey % 23 = 0 AND o_orderkey % 10 + CASE WHEN o_custkey % 4 > 0 THEN 1 ELSE 0 END < 8 THEN 'schema_violation'
    WHEN o_orderkey % 23 = 0 OR o_custkey % 4 = 0 OR o_orderkey % 10 > 7 OR o_custkey % 7 > 4 OR o_orderkey % 13 = 0 THEN 'rule_violation' ELSE 'ok' END"""


@query("validate_plans", f"SELECT o_orderkey, {PLAN_STATUS} AS status FROM orders")
def validate_plans(t: Tables):
    raw = made_plan(F.col("o_orderkey"), F.col("o_custkey"))
    return VA.validate_plans(t.orders.select("o_orderkey", raw.alias("raw"))).select("o_orderkey", "status")


@query(
    "plan_errors_long",
    f"""WITH p AS (SELECT o_orderkey, o_orderkey AS k, o_custkey AS c,
           o_orderkey % 10 + CAST(o_orderkey % 23 = 0 AS INT) + CAST(o_custkey % 4 > 0 AS INT) AS n FROM orders WHERE o_orderkey % 17 > 0)
       SELECT o_orderkey, 'mood' AS path, '{VA.FORBIDDEN}' AS message FROM p WHERE k % 19 = 0
       UNION ALL SELECT o_orderkey, 'interpretation', 'String should have at least 1 character' FROM p WHERE k % 13 = 0
       UNION ALL SELECT o_orderkey, 'assumptions', 'List should have at most 5 items' FROM p WHERE c % 7 > 4
       UNION ALL SELECT o_orderkey, 'steps', 'List should have at least 1 item' FROM p WHERE n = 0
       UNION ALL SELECT o_orderkey, 'steps', 'List should have at most 8 items' FROM p WHERE n > 8
       UNION ALL SELECT o_orderkey, 'steps.0.tool', 'Input should be ''describe_dataset'', ''run_python'' or ''submit_answer'''
         FROM p WHERE k % 23 = 0 AND n BETWEEN 1 AND 8
       UNION ALL SELECT o_orderkey, 'steps', 'Value error, the plan must contain exactly one submit_answer step, and it must be last'
         FROM p WHERE k % 23 > 0 AND c % 4 = 0 AND n BETWEEN 1 AND 8""",
)
def plan_errors_long(t: Tables):
    raw = made_plan(F.col("o_orderkey"), F.col("o_custkey"))
    found = VA.validate_plans(t.orders.select("o_orderkey", raw.alias("raw")))
    return VA.validation_errors_long(found, ["o_orderkey"]).select("o_orderkey", "path", "message")


@query(
    "classify_results",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 13 = 0 THEN 'oom_killed'
         WHEN event_id % 5 = 0 AND event_id % 2 = 0 THEN 'docker_error' WHEN event_id % 5 < 2 THEN 'runner_crash'
         WHEN event_id % 5 = 2 THEN 'timeout' WHEN event_id % 5 = 3 THEN 'error' ELSE 'ok' END AS status,
       concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'output_truncated' END,
         CASE WHEN event_id % 11 = 0 THEN 'hard_kill' WHEN event_id % 13 = 0 THEN 'oom'
              WHEN event_id % 5 = 2 THEN 'soft_timeout'
              WHEN event_id % 5 = 3 AND event_id % 7 <> 0 THEN 'output_truncated' END) AS limits,
       CASE WHEN event_id % 11 > 0 AND event_id % 13 > 0 AND event_id % 5 = 4 THEN concat('out ', user_id) END AS stdout
       FROM events""",
)
def classify_results(t: Tables):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    marker = F.concat(F.lit(MARKER), u)
    payload = lambda status, cut: F.concat(
        marker, F.lit('{"status": "' + status + '", "stdout": "out '), u, F.lit(f'", "stdout_truncated": {cut}}}\nrest')
    )
    fake = F.concat(F.lit("glued" + MARKER + 'other{"status": "ok"}\n'), marker, F.lit('{"status": "fake"}\n'))
    stdout = pick(
        i, 5,
        F.lit("no marker at all"),
        F.concat(fake, marker, F.lit("{not json")),
        F.concat(fake, payload("timeout", "false")),
        F.concat(fake, payload("error", "true")),
        F.concat(fake, F.lit("x"), payload("ok", "false")),
    )
    rows = t.events.select(
        "event_id",
        (i % 11 == 0).alias("hard_killed"),
        (i % 13 == 0).alias("oom_killed"),
        (i % 7 == 0).alias("raw_truncated"),
        F.when(i % 2 == 0, 125).otherwise(1).alias("exit_code"),
        F.when(i % 5 == 1, F.lit(1)).otherwise(F.when(i % 2 == 0, 125).otherwise(1)).alias("code"),
        stdout.alias("stdout"),
        marker.alias("marker"),
    ).withColumn("exit_code", F.col("code"))
    out = VA.classify_results(rows)
    shown = F.when(F.col("status") == "ok", F.col("payload.stdout"))
    return out.select("event_id", "status", F.array_join("limits_hit", ",").alias("limits"), shown.alias("stdout"))


# Programs around a number {n} of the row, and the findings in them.
PROGRAMS: tuple[tuple[str, tuple[tuple[str, str, int], ...]], ...] = (
    ("total = sum(range({n}))", ()),
    ("import math, json\nroot = math.sqrt({n})", (("static_import", "import json", 1),)),
    ("n = {n}\nfrom pathlib import Path\nPath(str(n))", (("static_import", "from pathlib import ...", 2),)),
    ("from numpy import arange\narange({n})", ()),
    ("from ..secrets import key_{n}", (("static_import", "from ..secrets import ...", 1),)),
    ("import statistics as s, datetime\ns.mean([{n}])", ()),
    ("f = open\nf('table_{n}')", (("static_forbidden_name", "open", 1),)),
    ("k = type({n})\nprint(k.__mro__)", (("static_forbidden_attr", "__mro__", 2),)),
    (
        "import http.client as c\nsetattr(c, 'n', {n})",
        (("static_import", "import http.client", 1), ("static_forbidden_name", "setattr", 2)),
    ),
    ("text = 'import os; eval({n})'", ()),
    ("if {n}:\n    (lambda: 0).__code__", (("static_forbidden_attr", "__code__", 2),)),
)


def filled_in(template: str, number: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{n}"), number.cast("string"))


@query(
    "scan_code_policy",
    "\nUNION ALL ".join(
        f"SELECT event_id, '{kind}' AS kind, '{detail}' AS detail, {line} AS line FROM events WHERE event_id % {len(PROGRAMS)} = {i}"
        for i, (_, found) in enumerate(PROGRAMS)
        for kind, detail, line in found
    ),
)
def scan_code_policy(t: Tables):
    code = pick(F.col("event_id"), len(PROGRAMS), *[filled_in(c[0], F.col("user_id")) for c in PROGRAMS])
    return VA.scan_code_policy(t.events.select("event_id", code.alias("code")), "code", ["event_id"])


# ------------------------------------------------------------------------------- recorded calls
@query(
    "filter_tool_calls",
    "SELECT event_id, user_id FROM calls_t WHERE tool = 'run_python' AND status = 'ok'",
)
def filter_tool_calls(t: Tables):
    return AN.filter_tool_calls(t.calls).select("event_id", "user_id")


CODE_SQL = """SELECT event_id, user_id, CASE event_id % 6 WHEN 1 THEN concat('result = ', user_id) WHEN 2 THEN '   '
    ELSE raw_arguments END AS code FROM calls_t WHERE tool = 'run_python' AND event_id % 6 IN (1, 2, 3)"""


@query("extract_code_blocks", CODE_SQL)
def extract_code_blocks(t: Tables):
    return AN.extract_code(t.calls).select("event_id", "user_id", "code")


@query(
    "last_two_code_blocks",
    f"""SELECT user_id, event_id, code, CAST(rank AS INT) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM ({CODE_SQL})) WHERE rank <= 2""",
)
def last_two_code_blocks(t: Tables):
    return AN.last_code_blocks(t.calls, RUN, "event_id").select("user_id", "event_id", "code", "rank")
