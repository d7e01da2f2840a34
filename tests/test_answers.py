"""Units, texts, numbers, grading, verification and record validation on typed cases."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as X
from tidemark.functions import units as U
from tidemark.operators import grading as G
from tidemark.operators import validation as VA
from tidemark.operators import verification as V
from tidemark.plans.answer_queries import CALLS, PROGRAMS, made_arguments


def column(spark, values, kind, expr):
    """Evaluate one column expression over a list of values."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_unit(spark):
    cases = {
        "°C": ("°C", False), "degC": ("°C", False), " Celsius ": ("°C", False), "kmh": ("km/h", False),
        "m s-1": ("m/s", False), "mbar": ("hPa", False), "h": ("hours", False), "mm/day": ("mm/day", True),
        "°C per decade": ("°C/decade", True), "furlongs": (None, False), "mm/furlong": (None, False), None: (None, False),
        "KM/H": ("km/h", False), "mm per  day": ("mm/day", True), "km/h/day": (None, False),
    }
    got = column(spark, list(cases), "string", U.normalize_unit)
    assert [(g["canonical"], g["is_rate"]) for g in got] == list(cases.values())


def test_convert_unit(spark):
    cases = [
        (36.0, "km/h", "m/s", 10.0), (10.0, "m/s", "km/h", 36.0), (0.0, "°C", "K", 273.15), (273.15, "K", "°C", 0.0),
        (100.0, "°C", "°F", 212.0), (32.0, "°F", "°C", 0.0), (1013.25, "hPa", "Pa", 101325.0), (2.54, "cm", "mm", 25.4),
        (5.0, "degC", "°C", 5.0), (1.0, "°C", "mm", None), (1.0, "km/h", "hPa", None), (1.0, "furlongs", "mm", None),
        (1.0, "mm", None, None), (1.0, "days", "hours", None), (2.0, "mm/day", "mm per day", 2.0),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v double, a string, b string, want double")
    got = df.withColumn("got", U.convert_unit(F.col("v"), F.col("a"), F.col("b"))).orderBy("i").collect()
    for r in got:
        assert r["got"] == (None if r["want"] is None else pytest.approx(r["want"])), r


def test_canonical_text(spark):
    cases = {
        " July 2023 ": "2023-07", "2023  july": "2023-07", "2023-7": "2023-07", "2022-06-18T19:00:00": "2022-06-18 19:00",
        "2022-06-18 19:00": "2022-06-18 19:00", "2023-7-5": "2023-07-05", "2023-13-45": "2023-13-45", "About Eleven": "about eleven",
        "july": "july", "2023": "2023", "may 2020": "2020-05",
    }
    assert column(spark, list(cases), "string", X.canonical_text) == list(cases.values())


def test_numbers(spark):
    parsed = {"11.31": 11.31, " 1,234.5\n": 1234.5, "-3e2": -300.0, "eleven": None, "1.": None, "+1": None, ".5": None, "1e5 ": 1e5}
    assert column(spark, list(parsed), "string", N.parse_number) == list(parsed.values())
    assert column(spark, ["a 2023-07 b 1.5e3 -2"], "string", N.extract_numbers) == [[2023.0, -7.0, 1500.0, -2.0]]
    assert column(spark, ["11", "11.0", "11.10", "1e3", "True"], "string", N.literal_decimals) == [0, 1, 2, None, None]
    raws = ['{"value": 11.10}', '{"value": 1, "value": 2.50}', '{"value": "a b"}', '{"unit": 1}', '{"unit": "value", "value" : -1E-3}']
    assert column(spark, raws, "string", lambda c: N.submitted_literal(c, F.lit("d"))) == ["11.10", "2.50", "a b", "d", "-1E-3"]


def test_number_formats_equal_python(spark):
    rng = random.Random(4)
    values = [0.0, 1.0, -2.5, 20.0, 123456.0, 1234567.0, 1e-5, 0.0001234, 1e16, 1e22, -1e-300, 8760.0, 12345678.9, 0.02, math.inf, -math.inf]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 18) for _ in range(500)]
    for digits in (4, 6):
        assert column(spark, values, "double", lambda c: N.general_format(c, digits)) == [f"{v:.{digits}g}" for v in values]
    shown = column(spark, values, "double", N.float_text)
    assert shown[:16] == [str(v) for v in values[:16]]
    # Older Java runtimes print some doubles with one digit more than needed.
    assert [float(x) for x in shown] == values and [("e" in x) for x in shown] == [("e" in str(v)) for v in values]


def test_answer_key_rounds_half_even_to_the_grid(spark):
    values = [9.876543210123456, 0.125, 2.675, 8760.0, 20.0, -0.001]
    want = [f"{round(v / 0.01) * 0.01:.6g}" for v in values]
    got = column(spark, values, "double", lambda c: N.number_key(c, F.lit(0.01)))
    assert got == [w.replace("-0", "0") if w == "-0" else w for w in want]


GRADE_CASES = [
    # expected, is number, question unit, tolerance, answer, is number, unit -> correct, part of the reason
    ("11.3139", True, "°C", 0.01, "11.3139", True, "°C", True, "within tolerance"),
    ("11.3139", True, "°C", 0.01, "11.32", True, "°C", True, "within tolerance"),
    ("11.3139", True, "°C", 0.01, "11.30", True, "°C", False, "off by 0.0139 (tolerance 0.01 °C)"),
    ("7.2", True, "km/h", 0.01, "2.0", True, "m/s", True, "within tolerance"),
    ("7.2", True, "km/h", 0.01, "2.5", True, "m/s", False, "off by 1.8"),
    ("7.2", True, "km/h", 0.01, "7.2", True, "mm", False, "unit 'mm' is not convertible to 'km/h'"),
    ("11.3139", True, "°C", 0.01, "11.3139", False, "°C", True, "within tolerance"),
    ("11.3", True, "°C", 0.01, "about eleven", False, "°C", False, "expected a number, got 'about eleven'"),
    ("11.3139", True, "°C", 0.01, "11.3139", True, None, True, "within tolerance"),
    ("2023-07", False, None, 0.01, "2023-7", False, None, True, "matches"),
    ("2023-07", False, None, 0.01, "2023 July", False, None, True, "matches"),
    ("2023-07", False, None, 0.01, "2023-07-15", False, None, True, "matches"),
    ("2023-07", False, None, 0.01, "July", False, None, False, "expected 2023-07, got July"),
    ("2022-06-18 19:00", False, None, 0.01, "2022-06-18T19:00:00", False, None, True, "matches"),
    ("2022-06-18 19:00", False, None, 0.01, "2022-06-18 18:00", False, None, False, "expected 2022"),
    ("2022", False, None, 0.01, "2022", True, None, True, "matches"),
    ("2022", False, None, 0.01, "2021", False, None, False, "expected 2022, got 2021"),
    ("15", False, None, 0.01, "15.0", True, None, True, "matches"),
    ("15", False, None, 0.01, "14", True, None, False, "expected 15, got 14"),
    ("not answerable", False, None, 0.01, "Not answerable.", False, None, True, "correctly declined"),
    ("not answerable", False, None, 0.01, "12", True, "cm", False, "cannot answer"),
    ("11.3", True, "°C", 0.01, "not answerable", False, None, False, "declined an answerable question"),
    ("11.3", True, "°C", 0.01, None, None, None, False, "no answer was submitted"),
    ("8760.0", True, "hours", 0.5, "8760", True, "Hourly  records", True, "within tolerance"),
    ("8760.0", True, "hours", 0.5, "8760", True, "days", False, "unit 'days' does not count hours"),
    ("90.0", True, "days", 0.5, "2160", True, "hours", False, "does not count days"),
    ("8760.0", True, "hours", 0.5, "8000", True, "records", False, "off by 760 (tolerance 0.5 hours)"),
    ("0.5", True, None, 0.005, "0.6", True, "x", False, "off by 0.1 (tolerance 0.005 )"),
]
GRADE_SCHEMA = (
    "i int, expected string, expected_is_number boolean, unit string, tolerance double, answer_value string, "
    "answer_is_number boolean, answer_unit string, want boolean, part string"
)


def test_grading_cases(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(GRADE_CASES)], GRADE_SCHEMA)
    for r in G.grade_runs(df).collect():
        assert r["verdict"]["correct"] is r["want"], r
        assert r["part"] in r["verdict"]["reason"], r


def test_regrade_changes_exactly_what_the_rules_change(spark):
    rows = [
        ("h", "8760.0", True, "8760", True, "records", False, "unit 'records' does not count hours", "8760.0", "8760"),
        ("h", "8760.0", True, "8000", True, "records", False, "off by 760", "8000.0", "8000"),
        ("h", "8760.0", True, None, None, None, False, "no answer was submitted", None, None),
        ("gone", "1.0", True, "1.0", True, None, False, "old", "1.0", "1"),
        ("h", "8760.0", True, " ", False, None, False, "old", " ", "1"),
    ]
    schema = (
        "question_id string, expected string, expected_is_number boolean, answer_value string, answer_is_number boolean, "
        "answer_unit string, correct boolean, reason string, got string, answer_key string"
    )
    questions = spark.createDataFrame([("h", "hours", 0.5)], "question_id string, unit string, tolerance double")
    out = G.regrade(spark.createDataFrame(rows, schema), questions).collect()
    assert sum(r["verdict_changed"] for r in out) == 1 and sum(r["correct"] for r in out) == 1
    assert {r["reason"] for r in out if r["question_id"] == "gone"} == {"old"}
    assert [r["reason"] for r in out if r["answer_value"] == " "] == ["old"]


def test_provenance_equals_brute_force(spark):
    """Random numbers, literals of every precision, one run with most of the rows."""
    rng = random.Random(9)
    numbers, answers = [], []
    for i in range(3000):
        run = "hot" if i % 3 else f"r{i % 40}"
        v = rng.choice([rng.uniform(-100, 100), rng.uniform(-1e6, 1e6), rng.uniform(-1, 1) * 1e-4, float(rng.randint(-50, 50)), 0.0])
        numbers.append((run, v))
        if i % 6 == 0:
            v = v if rng.random() < 0.7 else rng.uniform(-100, 100)
            literal = rng.choice([f"{v:.{rng.randint(0, 9)}f}", repr(v), f"{v:.{rng.randint(1, 9)}e}", f"{v * 1.0000005:.8e}"])
            answers.append((i, run, float(literal), literal))

    def fits(value, literal, observed):
        if "e" in literal.lower():
            tolerance = 1e-6 * abs(observed)
        else:
            tolerance = 0.5 * 10.0 ** -(len(literal.split(".")[1]) if "." in literal else 0)
        return abs(value - observed) <= tolerance + 1e-9 * abs(observed)

    by_run = {}
    for run, v in numbers:
        by_run.setdefault(run, []).append(v)
    want = {i for i, run, v, lit in answers if any(fits(v, lit, o) for o in by_run[run])}
    a = spark.createDataFrame(answers, "i int, run string, v double, literal string")
    n = spark.createDataFrame(numbers, "run string, number double")
    hits = V.provenance_match(a, n, ["run"], "v", "literal")
    got = {r["i"] for r in a.join(hits, ["run", "v", "literal"], "left_semi").collect()}
    assert 100 < len(want) < len(answers) and got == want


def test_an_interval_touches_few_cells_none_wider_than_itself(spark):
    rng = random.Random(3)
    literals = ["0", "1", "10", "0.5", "-3.25", "1e0", "0e0"] + [f"{rng.uniform(-1, 1) * 10 ** rng.randint(-3, 6):.{rng.randint(0, 7)}f}" for _ in range(500)]
    df = V.with_interval(spark.createDataFrame([(float(v), v) for v in literals], "v double, literal string"), "v", "literal")
    ends = df.select("lo", "hi", "level", (V._cell(F.col("hi"), F.col("level")) - V._cell(F.col("lo"), F.col("level"))).alias("n"))
    for r in ends.collect():
        assert r["n"] <= 3 and (2.0 ** r["level"] <= r["hi"] - r["lo"] or r["hi"] == r["lo"])


EXECUTIONS = (
    "run string, status string, type string, value string, is_nan boolean, is_inf boolean, n_missing int, head string, "
    "repr string, stdout string"
)


def verified(spark, executions, answers):
    """answers: (run, value, is number, unit, summary, literal, planned unit) -> {run: row}."""
    ex = spark.createDataFrame([(*e, n) for n, e in enumerate(executions)], f"{EXECUTIONS}, n int")
    an = spark.createDataFrame(
        answers, "run string, answer_value string, answer_is_number boolean, answer_unit string, method_summary string, "
        "literal string, planned_unit string",
    )
    out = V.verify_answers(V.attach_evidence(an, ex, ["run"], "n")).collect()
    return {r["run"]: (r["ok"], {c["name"]: c["status"] for c in r["checks"]}) for r in out}


def test_texts_over_the_seams_of_outputs(spark, monkeypatch):
    """As if the outputs of a run were joined: short, long, empty and very many outputs."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    runs = {f"r{k}": [word(rng.choice([0, 1, 2, 3, 9, 40, 200])) for _ in range(rng.randint(1, 12))] for k in range(60)}
    runs["many"] = [word(rng.choice([0, 1, 2, 12])) for _ in range(3_000)]
    outputs = [(run, 7 * n - 50, text) for run, texts in runs.items() for n, text in enumerate(texts)]
    asked = []
    for run, texts in runs.items():
        joined = " ".join(texts)
        for _ in range(40):
            at, length = rng.randrange(len(joined) + 1), rng.choice([1, 3, 6, 12, 30])
            needle = joined[at : at + length]
            asked += [(run, needle), (run, needle[:-1] + "b"), (run, word(7))]
    asked += [("none", "a"), ("none", ""), ("r1", None), ("r1", ""), ("r2", " ".join(runs["r2"])), ("r2", " ".join(runs["r2"]) + " ")]
    want = {(run, n) for run, n in asked if run in runs and n is not None and n in " ".join(runs[run])}
    blobs = spark.createDataFrame(outputs, "run string, n int, blob string").repartition(4)
    answers = spark.createDataFrame(asked, "run string, needle string")
    for outputs_a_share, tile in ((V.OUTPUTS, V.TILE), (16, 8)):
        monkeypatch.setattr(V, "OUTPUTS", outputs_a_share), monkeypatch.setattr(V, "TILE", tile)
        got = {(r["run"], r["needle"]) for r in V.text_match(answers, blobs, ["run"], "needle", "n").collect()}
        assert got == want and 0 < len(want) < len(set(asked))


def test_a_run_of_very_many_outputs_is_cut(spark):
    many = spark.range(30_000).selectExpr("'r' AS run", "id AS n", "concat('output ', id, ' ', repeat('x', 40)) AS blob", "20 AS reach")
    sizes = [len(r["text"]) for r in V.seams(many, ["run"], "n", "reach").collect()]
    assert len(sizes) > 30 and max(sizes) < V.TILE + 400
    long = spark.createDataFrame([("r", 1, "a" * 500_000), ("r", 2, "b" * 500_000)], "run string, n int, blob string").selectExpr("*", "20 AS reach")
    assert "a" * 20 + " " + "b" * 20 in {r["text"] for r in V.seams(long, ["run"], "n", "reach").collect()}


def test_evidence_text_is_the_joined_text(spark):
    rows = [("r", "ok", "number", "1.5", False, False, 0, "Head", None, f"Out {n}" if n % 3 else None, n) for n in range(50)] + [("r", "error", None, None, None, None, None, None, None, "no", 99)]
    ex = spark.createDataFrame(rows, f"{EXECUTIONS}, n int")
    pieces = sorted((r["start"], r["text"]) for r in V.evidence_text(ex, ["run"], "n").collect())
    whole = " ".join(f"1.5 head  {f'out {n}' if n % 3 else ''}" for n in range(50))
    assert " ".join(t for _, t in pieces) == whole and all(whole[at : at + len(t)] == t for at, t in pieces)
    assert V.collect_evidence(ex, ["run"]).first()["n_chars"] == len(whole)


def test_verification_cases(spark):
    mean = "9.876543210123456"
    number = lambda run, v, **k: (run, k.get("status", "ok"), "number", v, k.get("nan", False), False, 0, None, None, k.get("out"))
    cases = {
        # run: (evidence, answer, ok, {check: status})
        "exact": (mean, (mean, True, "°C", "m", mean, None), True, {"provenance": "pass", "range": "pass"}),
        "rounded": (mean, ("9.9", True, "°C", "m", "9.9", None), True, {}),
        "integer": (mean, ("10.0", True, "°C", "m", "10", None), True, {}),
        "false_precision": (mean, ("10.0", True, "°C", "m", "10.0", None), False, {"provenance": "fail"}),
        "guess": (mean, ("12.5", True, "°C", "m", "12.5", None), False, {"provenance": "fail"}),
        "kelvin": (mean, ("283.03", True, "K", "m", "283.03", None), False, {"provenance": "fail", "range": "pass"}),
        "gross": ("97000.0", ("97000.0", True, "hPa", "m", "97000.0", None), False, {"range": "fail"}),
        "text_unit": ("11.3", ("about eleven", False, "°C", "m", "about eleven", None), False, {"type": "fail"}),
        "unknown_unit": ("4.0", ("4.0", True, "furlongs", "m", "4.0", None), True, {"unit": "warn", "range": "skip"}),
        "rate": ("0.08", ("0.08", True, "°C/year", "m", "0.08", None), True, {"unit": "pass", "range": "skip"}),
        "date": ("2023-07-01T00:00", ("2023-07", False, None, "m", "2023-07", None), True, {"unit": "skip"}),
        "wrong_date": ("2023-07-01T00:00", ("2021-07", False, None, "m", "2021-07", None), False, {"provenance": "fail"}),
        "empty": ("4.0", (" ", False, None, "m", " ", None), True, {"provenance": "pass"}),
        "exponent": ("0.0012345", ("0.0012345", True, "mm", "m", "1.2345e-3", None), True, {}),
        "planned": ("3.0", ("3.0", True, "m/s", "m", "3.0", "km/h"), True, {"plan_unit": "warn"}),
        "planned_alias": ("3.0", ("3.0", True, "°C", "m", "3.0", "degC"), True, {"plan_unit": "pass"}),
        "abstain": (None, ("Not answerable ", False, None, "m", "", None), True, {"not_answerable": "pass"}),
        "nothing_ran": (None, ("1.0", True, None, "m", "1.0", None), False, {"provenance": "fail"}),
    }
    executions = [number(run, c[0]) for run, c in cases.items() if c[0]]
    executions += [number("nan", None, nan=True), number("nan", "5.0"), number("told", None, nan=True), number("told", "5.0")]
    executions += [number("nothing_ran", "1.0", status="error")]
    cases["seam"] = (None, ("Alpha beta ", False, None, "m", "Alpha beta ", None), True, {"provenance": "pass"})
    cases["order"] = (None, ("beta alpha", False, None, "m", "beta alpha", None), False, {"provenance": "fail"})
    for run in ("seam", "order"):
        text = lambda v, run=run, **k: (run, k.get("status", "ok"), "string", v, None, None, None, None, None, k.get("out"))
        executions += [text("x", out="the alpha"), text("lost", status="error"), text("beta of it")]
    answers = [(run, *c[1]) for run, c in cases.items()]
    answers += [("nan", "5.0", True, None, "mean", "5.0", None), ("told", "5.0", True, None, "dropped missing values", "5.0", None)]
    got = verified(spark, executions, answers)
    for run, (_, _, ok, some) in cases.items():
        assert got[run][0] is ok and some.items() <= got[run][1].items(), (run, got[run])
    assert got["nan"] [1]["silent_nan"] == "warn" and got["nan"][0] and got["told"][1]["silent_nan"] == "pass"
    assert set(got["abstain"][1]) == {"not_answerable"}


def test_tool_call_cases(spark):
    long = [
        ("run_python", json.dumps({"code": "x" * 20_001}), "rule_violation"),
        ("submit_answer", json.dumps({"value": 1, "unit": None, "method_summary": "m" * 501}), "rule_violation"),
        ("submit_answer", json.dumps({"value": "v" * 101, "unit": None, "method_summary": "m"}), "rule_violation"),
        ("submit_answer", '{"value": 1, "unit": null, "method_summary": "saw NaN, dropped"}', "ok"),
    ]
    rows = [(i, t, r, s) for i, (t, r, s) in enumerate(long)]
    schema = "i int, tool string, raw_arguments string, want string"
    made = spark.range(1).select(F.array(*made_arguments(F.lit(7), F.lit("click")))).first()[0]
    rows += [(len(rows) + i, tool, raw, want) for i, ((want, tool), raw) in enumerate(zip(CALLS, made, strict=True))]
    out = VA.validate_tool_calls(spark.createDataFrame(rows, schema)).collect()
    for r in out:
        assert r["status"] == r["want"], r
        assert bool(r["errors"]) == (r["status"] in ("schema_violation", "rule_violation"))


def test_plan_limits(spark):
    def plan(**changes):
        steps = [{"tool": "run_python", "description": "load"}, {"tool": "submit_answer", "description": "state it"}]
        doc = {"interpretation": "rain of May", "assumptions": [], "answerable": True, "expected_unit": None, "steps": steps}
        return json.dumps({**doc, **changes})

    submit, run = {"tool": "submit_answer", "description": "d"}, {"tool": "run_python", "description": "d"}
    cases = {
        plan(): "ok",
        plan(answerable="no"): "ok",
        plan(answerable="perhaps"): "schema_violation",
        plan(steps="first load, then answer"): "schema_violation",
        plan(assumptions=[3]): "schema_violation",
        plan(steps=[submit, submit]): "rule_violation",
        plan(steps=[submit, run]): "rule_violation",
        plan(steps=[run] * 7 + [submit]): "ok",
        plan(steps=[{"tool": "submit_answer", "description": "d" * 301}]): "rule_violation",
        plan(assumptions=["\u00a0"]): "rule_violation",
        "[" + plan() + "]": "schema_violation",
    }
    rows = list(cases.items())
    for r in VA.validate_plans(spark.createDataFrame(rows, "raw string, want string")).collect():
        assert r["status"] == r["want"], r


def test_a_plan_has_an_error_for_each_faulty_item(spark):
    run, submit = {"tool": "run_python", "description": "d"}, {"tool": "submit_answer", "description": "d"}
    steps = [run, {"tool": "erase_disk", "description": 3}, "load", {"tool": None, "description": "", "why": 1}, {**run, "description": "d" * 301}, {}, submit]
    doc = {"interpretation": "i", "assumptions": ["a", 3, "b", None], "answerable": True, "expected_unit": None, "steps": steps}
    alone = {**doc, "assumptions": [], "steps": [run, {**run, "description": "d" * 301}, {**submit, "description": ""}]}
    rows = [(1, json.dumps(doc)), (2, json.dumps(alone))]
    out = VA.validate_plans(spark.createDataFrame(rows, "i int, raw string"))
    got = sorted(tuple(r) for r in VA.validation_errors_long(out, ["i"]).collect())
    tool = "Input should be 'describe_dataset', 'run_python' or 'submit_answer'"
    short, long = "String should have at least 1 character", "String should have at most 300 characters"
    want = [
        (1, "schema", "assumptions.1", VA.NOT_STRING), (1, "schema", "assumptions.3", VA.NOT_STRING),
        (1, "schema", "steps.1.tool", tool), (1, "schema", "steps.1.description", VA.NOT_STRING),
        (1, "schema", "steps.2", "Input should be a valid dictionary or instance of PlanStep"),
        (1, "schema", "steps.3.tool", tool), (1, "rule", "steps.3.description", short), (1, "schema", "steps.3.why", VA.FORBIDDEN),
        (1, "rule", "steps.4.description", long), (1, "schema", "steps.5.tool", VA.REQUIRED), (1, "schema", "steps.5.description", VA.REQUIRED),
        (2, "rule", "steps.1.description", long), (2, "rule", "steps.2.description", short),
    ]
    assert got == sorted(want)
    assert {r["i"]: r["status"] for r in out.collect()} == {1: "schema_violation", 2: "rule_violation"}


def test_outcomes_keep_result_and_violations(spark):
    text = '#m#{"status": "error", "result": {"type": "number", "value": 2.5}, "violations": [{"kind": "runtime_import", "detail": "import os"}]}'
    row = spark.createDataFrame([(False, False, False, 0, text, "#m#")], "hard_killed boolean, oom_killed boolean, raw_truncated boolean, exit_code int, stdout string, marker string")
    got = VA.classify_results(row).select("payload.violations", F.to_json("payload.result").alias("result")).first()
    assert [tuple(v) for v in got["violations"]] == [("runtime_import", "import os")]
    assert json.loads(got["result"]) == {"type": "number", "value": 2.5}


def test_code_policy(spark):
    rows = [(i, code.replace("{n}", "1")) for i, (code, _) in enumerate(PROGRAMS)] + [(90, "def f(:"), (91, None), (92, "")]
    found = VA.scan_code_policy(spark.createDataFrame(rows, "i int, code string"), "code", ["i"]).collect()
    for i, (_, want) in enumerate(PROGRAMS):
        assert sorted((r["kind"], r["detail"], r["line"]) for r in found if r["i"] == i) == sorted(want)
    assert [r["kind"] for r in found if r["i"] >= 90] == ["syntax_error"]


def test_outcome_precedence(spark):
    ok = '#m#{"status": "ok", "stdout": "real"}'
    fake = '#m#{"status": "error"}\n#other#{"status": "error"}\n'
    rows = [
        (0, True, True, False, 0, ok), (1, False, True, False, 137, ""), (2, False, False, False, 1, ""), (3, False, False, False, 125, ""),
        (4, False, False, True, 0, fake + "x" * 50 + ok + "\n"), (5, False, False, False, 0, "#m#{not json"), (6, False, False, False, 0, '#m#{"status": "timeout"}'),
    ]
    df = spark.createDataFrame(rows, "i int, hard_killed boolean, oom_killed boolean, raw_truncated boolean, exit_code int, stdout string")
    got = {r["i"]: (r["status"], r["limits_hit"]) for r in VA.classify_results(df.withColumn("marker", F.lit("#m#"))).collect()}
    assert got == {
        0: ("timeout", ["hard_kill"]), 1: ("oom_killed", ["oom"]), 2: ("runner_crash", []), 3: ("docker_error", []),
        4: ("ok", ["output_truncated"]), 5: ("runner_crash", []), 6: ("timeout", ["soft_timeout"]),
    }
