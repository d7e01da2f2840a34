"""Ingest, quality, storage, metrics, failure analysis and streaming on small inputs."""

import datetime as dt
import json
import math
import os
import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidemark.functions.text import REASON_CATEGORIES, categorize_reason
from tidemark.operators import analysis as AN
from tidemark.operators import metrics as M
from tidemark.operators import quality as Q
from tidemark.operators import verification as V
from tidemark.plans import series_queries
from tidemark.plans.catalogue import BY_ID, question_table
from tidemark.plans.registry import QUERIES
from tidemark.schemas import MEASURES, RUNS_STORED
from tidemark.sources import runs as src
from tidemark.sources import series as ser
from tidemark.streaming.runs import key_bucket, stored_keys, stored_runs, stream_new_runs


# ------------------------------------------------------------------------------- ingest
START = dt.datetime(2021, 3, 1)


def document(hours=48, change=None) -> dict:
    """A downloaded document of hourly columns, changed by a function if one is given."""
    columns = {"time": [(START + dt.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M") for h in range(hours)]}
    columns |= {name: [round(math.sin(h / 5) + len(name), 3) for h in range(hours)] for name in MEASURES}
    out = {
        "latitude": 60.1, "longitude": 24.9, "elevation": 12.0, "timezone": "GMT",
        "hourly_units": dict.fromkeys(MEASURES, "unit") | {"time": "iso8601"}, "hourly": columns,
    }
    if change:
        change(out)
    return out


def on_columns(edit):
    """A change made to every column of a document."""
    return lambda d: [edit(column) for column in d["hourly"].values()]


def land(spark, tmp_path, hours=48, change=None):
    path = tmp_path / f"landed-{len(os.listdir(tmp_path))}.json"
    path.write_text(json.dumps(document(hours, change)))
    return ser.parse_payloads(ser.read_payloads(spark, str(path)))


UNITS = {m: "unit" for m in MEASURES}


def test_payload_faults(spark, tmp_path):
    def problems(hours=48, change=None):
        records, rejects = land(spark, tmp_path, hours, change)
        assert rejects.count() == 0
        return Q.validate_series(records, "2021-03-01", "2021-03-02", columns=MEASURES, position="pos").first()

    good = problems()
    assert good["problems"] is None and good["rows"] == good["expected_rows"] == 48
    empty = problems(change=lambda d: d["hourly"][MEASURES[1]].__setitem__(7, None))
    assert empty["nan_counts"][MEASURES[1]] == 1
    assert "1 missing hours, first: 2021-03-01 17:00" in problems(change=on_columns(lambda c: c.pop(17)))["problems"]
    assert "1 duplicated timestamps" in problems(change=on_columns(lambda c: c.append(c[-1])))["problems"]
    assert "6 unexpected timestamps, first: 2021-03-03 00:00" in problems(hours=54)["problems"]
    zone, column = {"timezone": "Asia/Tokyo"}, MEASURES[3]
    for change, part in ((lambda d: d.update(zone), "GMT/UTC"), (lambda d: d["hourly"].pop(column), column)):
        records, rejects = land(spark, tmp_path, change=change)
        assert records.count() == 0 and part in rejects.first()["problem"]


def test_validated_write_manifest_and_tampering(spark, tmp_path):
    records = land(spark, tmp_path)[0]
    out = str(tmp_path / "data")
    span = ("2021-03-01", "2021-03-02")
    assert ser.read_published(spark, out).count() == 0 and ser.check_manifest(spark, out).count() == 0
    ser.write_series_validated(records, out, UNITS, *span, position="pos", request={"place": "here"})
    manifest = ser.read_manifest(spark, out).first()
    assert manifest["rows"] == 48 and manifest["variables"] == UNITS and manifest["timezone"] == "UTC"
    assert manifest["request"] == {"place": "here", "first": span[0], "last": span[1], "freq": "hour"}
    assert manifest["content_sha256"] == Q.content_hash(records, MEASURES).first()["content_sha256"]
    assert ser.check_manifest(spark, out).first()["ok"]
    assert "pos" not in os.listdir(f"{out}/{manifest['folder']}") and ser.read_published(spark, out).count() == 48
    # A second version, of which the first one's files know nothing.
    ser.write_series_validated(records.withColumn(MEASURES[0], F.lit(1.0)), out, UNITS, *span, position="pos")
    assert ser.read_manifest(spark, out).first()["version"] == 1
    assert ser.read_published(spark, out).select(MEASURES[0]).distinct().collect() == [(1.0,)]
    folder = f"{out}/{ser.read_manifest(spark, out).first()['folder']}"
    ser.read_series(spark, folder).limit(1).withColumn("year", F.lit(2021)).write.mode("append").partitionBy("year").parquet(folder)
    row = ser.check_manifest(spark, out).first()
    assert not row["ok"] and "mismatch" in row["message"]


def test_rows_that_differ_when_computed_again_are_stored_as_validated(spark, tmp_path):
    noise = F.udf(lambda: random.random() / 1000, "double").asNondeterministic()
    records = land(spark, tmp_path)[0].withColumn(MEASURES[0], F.col(MEASURES[0]) + noise())
    for _ in range(2):
        ser.write_series_validated(records, str(tmp_path / "data"), UNITS, "2021-03-01", "2021-03-02", position="pos")
        assert ser.check_manifest(spark, str(tmp_path / "data")).first()["ok"]


def test_a_mismatch_of_the_fingerprint_is_a_row_of_the_query(spark, monkeypatch):
    broken = spark.createDataFrame([(False, "content hash mismatch: manifest a..., file b...")], "ok boolean, message string")
    monkeypatch.setattr(series_queries.src, "check_manifest", lambda *_: broken)
    monkeypatch.setattr(series_queries, "stored_series", lambda _: "")
    assert [tuple(r) for r in QUERIES["check_manifest"](spark, "").collect()] == [(False, None)]


def test_the_gate_writes_nothing_of_a_bad_payload(spark, tmp_path):
    span = ("2021-03-01", "2021-03-02")
    good = land(spark, tmp_path)[0]
    short = land(spark, tmp_path, change=on_columns(lambda c: c.pop(3)))[0]
    swapped = land(spark, tmp_path, change=on_columns(lambda c: c.insert(30, c.pop(7))))[0]
    for bad, message in ((short, "1 missing hours"), (swapped, "timestamps are not sorted")):
        with pytest.raises(ValueError, match=message):
            ser.write_series_validated(bad, str(tmp_path / "bad"), UNITS, *span, position="pos")
        assert not (tmp_path / "bad").exists()
    # Without a position the order of the input is not known, and stored records are in order anyway.
    ser.write_series_validated(swapped.drop("pos"), str(tmp_path / "swapped"), UNITS, *span)
    assert ser.check_manifest(spark, str(tmp_path / "swapped")).first()["ok"] and good.count() == 48


def test_a_writer_that_fails_between_its_two_steps_leaves_the_old_version(spark, tmp_path, monkeypatch):
    records, out, span = land(spark, tmp_path)[0], str(tmp_path / "data"), ("2021-03-01", "2021-03-02")
    ser.write_series_validated(records, out, UNITS, *span, position="pos")

    def lost(*_args, **_options):
        raise OSError("the writer is gone")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "json", lost)
        with pytest.raises(OSError):
            ser.write_series_validated(records.withColumn(MEASURES[0], F.lit(9.0)), out, UNITS, *span, position="pos")
    assert len([f for f in os.listdir(out) if f.startswith("series-")]) == 2
    assert ser.read_manifest(spark, out).first()["version"] == 0 and ser.check_manifest(spark, out).first()["ok"]
    ser.write_series_validated(records.withColumn(MEASURES[0], F.lit(2.0)), out, UNITS, *span, position="pos")
    assert ser.read_published(spark, out).select(MEASURES[0]).distinct().collect() == [(2.0,)]


@pytest.mark.parametrize("freq, first, last", [("hour", "2021-02-27", "2021-03-02"), ("day", "2020-12-20", "2022-01-10"), ("month", "2019-11-15", "2023-02-20"), ("year", "2001-02-01", "2020-01-01")])
def test_one_scan_report_equals_the_calendar_joins(spark, freq, first, last):
    grid = [r["time"] for r in Q.expected_times(spark, first, last, freq).collect()]
    rng = random.Random(freq)
    assert Q.grid_size(first, last, freq) == len(grid)
    for kept in (grid, grid[3:], grid[:-2], rng.sample(grid, len(grid) // 2), [], [t for t in grid if t.month != 1]):
        times = sorted(kept + kept[:2]) + [datetime(2025, 5, 5, 5, 5), datetime(1990, 1, 1), None][: rng.randint(0, 3)]
        if rng.random() < 0.5:
            rng.shuffle(times)
        df = spark.createDataFrame([(t, 1.0 if n % 2 else None, n) for n, t in enumerate(times)], "time timestamp, v double, n int")
        got = Q.series_report(df, first, last, freq, position="n").first()
        missing, extra = (f(df, first, last, freq).first() for f in (Q.missing_hours, Q.unexpected_timestamps))
        text = lambda t: t and t.strftime("%Y-%m-%d %H:%M")
        known = [t for t in times if t]
        assert (got["missing"], text(got["first_missing"]) if got["missing"] else None) == tuple(missing)
        assert (got["unexpected"], text(got["first_unexpected"])) == tuple(extra)
        assert got["unsorted"] == (known != sorted(known)) and got["rows"] == len(times)
        assert got["duplicates"] == len(times) - len(set(times)) and got["nan_counts"] == {"v": (len(times) + 1) // 2}


def test_fingerprint_ignores_order_and_sees_changes(spark, tmp_path):
    df = land(spark, tmp_path, change=lambda d: d["hourly"][MEASURES[0]].__setitem__(3, None))[0].drop("pos")
    mark = lambda d: Q.content_hash(d, MEASURES).first()["content_sha256"]
    base = mark(df)
    assert base == mark(df.repartition(7)) == mark(df.orderBy(F.desc("time")))
    assert base != mark(df.withColumn(MEASURES[1], F.col(MEASURES[1]) + 0.000001 * (F.hour("time") == 3).cast("int")))
    assert base != mark(df.unionByName(df.limit(1))) and base != mark(df.where(F.hour("time") > 0))


# ------------------------------------------------------------------------------- metrics
def test_pass_at_k(spark):
    cases = [(n, c, k) for n in (1, 3, 8, 12) for c in range(0, n + 1, 2) for k in (1, 3, 7) if k <= n]
    df = spark.createDataFrame(cases, "n long, c long, k int")
    for k in {c[2] for c in cases}:
        for r in df.where(F.col("k") == k).withColumn("p", M.pass_at_k(F.col("n"), F.col("c"), k)).collect():
            assert r["p"] == pytest.approx(1 - math.comb(r["n"] - r["c"], k) / math.comb(r["n"], k)), r
    with pytest.raises(Exception, match="larger"):
        df.limit(1).select(M.pass_at_k(F.lit(3), F.lit(1), 5)).collect()


# A stored run that succeeded; tests name what differs.
STORED = {
    "config": "plain", "question_id": "wettest_day", "run_index": 0, "category": "selection", "difficulty": "medium", "correct": True,
    "reason": "equal", "got": 4.5, "got_number": 4.5, "answer_key": "4.5", "stop_reason": "answered", "tool_status_counts": {"ok": 2},
    "sandbox_violations": {}, "sandbox_limits": {}, "rejected_answers": [], "input_tokens": 640, "output_tokens": 75, "total_s": 6.5,
}


def run(q="wettest_day", correct=True, i=0, config="plain", **more):
    verdict = {} if correct else {"reason": "off by 3"}
    return STORED | {"question_id": q, "run_index": i, "config": config, "correct": correct} | verdict | more


def load(spark, tmp_path, rows):
    path = tmp_path / f"runs-{len(os.listdir(tmp_path))}.jsonl"
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    return src.read_runs(spark, str(path))


def test_summary_of_hand_made_runs(spark, tmp_path):
    rows = [
        run("wind", True, 0, answer_key="7", got_number=7.0, tool_status_counts={"ok": 1, "rule_violation": 2}),
        run("wind", True, 1, answer_key="7", got_number=7.5, total_s=2.5),
        run("wind", False, 2, answer_key="9", got_number=9.5, stop_reason=None, sandbox_limits={"oom": 2}),
        run("wind", True, 3, answer_key="7", got_number=8.0, tool_status_counts={"schema_violation": 1}, total_s=30.5),
        run("rain", False, 0, answer_key=None, got_number=None, plan_status="late", sandbox_violations={"static_import": 4},
            rejected_answers=[{"value": "x", "was_correct": True, "failed_checks": ["unit"]}] * 2),
    ]
    s = M.summarize_runs(load(spark, tmp_path, rows), ks=(1, 4)).first()
    assert s["runs"] == 5 and s["questions"] == 2 and s["runs_per_question_min"] == 1
    assert s["pass_rate"] == 0.6 and s["pass@1"] == pytest.approx(0.375) and s["pass@4"] is None
    spread = statistics.stdev([7.0, 7.5, 9.5, 8.0])
    assert s["consistency"] == pytest.approx(0.75) and s["answer_spread_median"] == pytest.approx(spread)
    assert s["tool_calls"] == 10 and s["tool_rule_violation_rate"] == 0.2 and s["tool_schema_violation_rate"] == 0.1
    assert s["stop_reasons"] == {"answered": 4, "none": 1} and s["plan_status"] == {"late": 1}
    assert s["sandbox_violations"] == {"static_import": 4} and s["sandbox_limits"] == {"oom": 2}
    assert s["verifier_correct_catches"] == 0 and s["verifier_false_rejections"] == 2
    assert s["median_latency_s"] == 6.5 and s["total_input_tokens"] == 3200


def test_stored_values_keep_whether_they_are_numbers(spark, tmp_path):
    rows = [run(i=0, got=9.876543210123456, expected=8760.0), run(i=1, got="2023-07", expected="2023-07"), run(i=2, got=None), run(i=3, got=2, raw_value="2 ")]
    got = {r["run_index"]: r for r in load(spark, tmp_path, rows).collect()}
    assert [(got[i]["answer_value"], got[i]["answer_is_number"]) for i in range(4)] == [
        ("9.876543210123456", True), ("2023-07", False), (None, False), ("2 ", False),
    ]
    assert got[0]["expected_is_number"] and not got[1]["expected_is_number"]
    assert src.read_runs(spark, str(tmp_path / "nothing")).count() == 0


def test_stored_lines_are_compressed_and_cut(spark, tmp_path, monkeypatch):
    """Rows that differ as little as those of an evaluation take a fifth of their text or less."""
    monkeypatch.setitem(src.LINES, "maxRecordsPerFile", "500")
    rows = spark.range(4_000).coalesce(2).selectExpr("'c' AS config", "concat('q', id % 50) AS question_id", "id AS run_index", "id % 3 = 0 AS correct", "repeat('why ', 20) AS reason")
    text = sum(len(r["j"]) + 1 for r in rows.select(F.to_json(F.struct("*")).alias("j")).collect())
    stores = {"runs": src.append_runs, "regraded": src.write_regraded, "traces": src.write_traces}
    for name, store in stores.items():
        store(rows, str(tmp_path / name))
        parts = [p for p in (tmp_path / name).iterdir() if p.name.startswith("part-")]
        assert len(parts) == 8 and sum(p.stat().st_size for p in parts) < text / 5
    back = src.read_runs(spark, str(tmp_path / "runs")).select(*rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_rankings_break_ties_by_file_order(spark, tmp_path):
    rows = [
        run("easy", True, 0), run("hard", False, 1, reason="off by 5"), run("hard", False, 2, reason="no answer was submitted"),
        run("hard", False, 3, reason="no answer was submitted"), run("mid", False, 4, reason="x"), run("mid", True, 5), run("mid", False, 6, reason="y"),
    ]
    runs = load(spark, tmp_path, rows)
    top = M.hardest_questions(runs, ["run_index"]).collect()
    assert [(r["question_id"], r["top_reason"]) for r in top] == [("hard", "no answer was submitted"), ("mid", "x"), ("easy", None)]
    assert [r["category"] for r in AN.failure_categories_ranked(runs, ["run_index"]).collect()] == ["no_answer", "other", "wrong_value"]
    assert [tuple(r) for r in AN.failed_questions_ranked(runs, ["run_index"]).collect()] == [("hard", 3), ("mid", 2)]
    first = AN.failed_runs_top(runs, ["run_index"]).select("question_id", "run_index").orderBy("run_index").collect()
    assert [tuple(r) for r in first] == [("hard", 1), ("hard", 2), ("mid", 4), ("mid", 6)]
    assert AN.failure_rate(runs).first()["failure_rate"] == "71.4%"


def test_reason_categories(spark):
    # Own wordings; where two phrases meet, the category that is named first in the list decides.
    cases = [
        ("the run ended and No Answer Was Submitted at all", "no_answer"),
        ("harness error: disk full, so no answer was submitted", None),
        ("OFF BY 17.25 (tolerance 2 mm)", "wrong_value"),
        ("unit 'bananas' does not count days", "unit_label"),
        ("expected a number, got 'off by one'", None),
        ("", "other"),
        (None, "other"),
        ("looks fine", "other"),
    ]
    df = spark.createDataFrame([(k, v) for k, v in cases], "reason string, want string").withColumn("got", categorize_reason(F.col("reason")))
    rows = df.collect()
    assert all(r["got"] == r["want"] for r in rows if r["want"])
    order = [c for _, c in REASON_CATEGORIES]
    for r in rows:
        held = [c for phrase, c in REASON_CATEGORIES if phrase in (r["reason"] or "").lower()]
        assert r["got"] == (min(held, key=order.index) if held else "other")


def test_tasks_resume_and_cost(spark):
    questions = question_table(spark, [BY_ID["mean_temp_2023"], BY_ID["snow_depth"]])
    tasks = M.build_tasks(questions, 3)
    assert tasks.count() == 24
    done = spark.createDataFrame([("loop", "snow_depth", 1), ("loop", "snow_depth", 1)], "config string, question_id string, run_index long")
    assert M.resume_todo(tasks, done).count() == 23
    cost = {r["config"]: r["cost"] for r in M.estimate_cost(tasks).collect()}
    assert cost["loop"] == pytest.approx(6 * (3200 * 0.05 + 900 * 0.4) / 1e6)
    ids = spark.createDataFrame([("snow_depth",), ("nope",)], "question_id string")
    assert [r[0] for r in M.unknown_ids(questions, ids).collect()] == ["nope"]


# ------------------------------------------------------------------------------- traces
def test_traces_from_files_and_failure_details(spark, tmp_path):
    doc = {
        "tool_calls": [
            {"tool": "describe_dataset", "status": "ok", "raw_arguments": "{}"},
            {"tool": "run_python", "status": "ok", "raw_arguments": json.dumps({"code": " a = 1 "})},
            {"tool": "run_python", "status": "ok", "raw_arguments": json.dumps({"code": "b"})},
            {"tool": "run_python", "status": "invalid_json", "raw_arguments": "not json"},
        ],
        "llm_calls": [{"purpose": "agent", "input_tokens": 5, "output_tokens": 2}],
        "plan": {"interpretation": "count days"},
        "verifications": [{"ok": False, "answer": {"value": 130.0}, "verdict": {"checks": [{"name": "provenance", "status": "fail", "detail": "x"}]}}],
    }
    folder = tmp_path / "traces" / "loop"
    folder.mkdir(parents=True)
    (folder / "calm_hours_17.json").write_text(json.dumps(doc, indent=1))
    traces = src.read_trace_files(spark, str(tmp_path / "traces"))
    row = AN.run_row_from_trace(traces).first()
    assert (row["config"], row["question_id"], row["run_index"]) == ("loop", "calm_hours", 17)
    assert row["tool_status_counts"] == {"ok": 3, "invalid_json": 1} and row["input_tokens"] == 5
    assert row["rejected_answers"][0]["failed_checks"] == ["provenance"]
    rejected = AN.trace_rejections(traces).first()
    assert float(rejected["value"]) == 130.0 and rejected["failed_checks"] == "provenance"
    codes = AN.extract_code(AN.trace_calls(traces)).orderBy("seq").collect()
    assert [r["code"] for r in codes] == [" a = 1 ", "b", "not json"]
    failed = [("calm_hours", 17), ("mean_wind_2023_ms", 0), ("gone", 1)]
    runs = load(spark, tmp_path, [run(q, False, i, config="loop") for q, i in failed])
    table = {r["question_id"]: r for r in AN.failures_table(runs, question_table(spark), traces, ["run_index"]).collect()}
    assert [(float(v), c) for v, c in table["calm_hours"]["rejected"]] == [(130.0, "provenance")] and table["gone"]["rejected"] is None
    assert table["calm_hours"]["last_codes"] == ["b", "not json"] and table["calm_hours"]["plan_interpretation"] == "count days"
    assert table["mean_wind_2023_ms"]["intended_trap"] == "unit_kmh" and table["gone"]["intended_trap"] is None


def test_trace_files_are_keyed_by_their_path(spark, tmp_path):
    place = str(tmp_path / "files")
    rows = [("loop", "a_b", 3, "x"), ("loop", "c", None, "no run"), ("full", "a_b", 3, "y"), ("full", "long_name_7", 12, "z")]
    made = spark.createDataFrame(rows, "config string, question_id string, run_index long, error string")
    src.write_trace_files(made, place)
    (tmp_path / "files" / "loop").mkdir()
    (tmp_path / "files" / "loop" / "plain_name_4.json").write_text('{"error": "w",\n "turns": 2}')
    (tmp_path / "files" / "loop" / "notes.json").write_text("{}")
    key = lambda df: sorted(tuple(r) for r in df.select("config", "question_id", "run_index", "error").collect())
    assert key(src.read_trace_files(spark, place)) == [("full", "a_b", 3, "y"), ("full", "long_name_7", 12, "z"), ("loop", "a_b", 3, "x"), ("loop", "plain_name", 4, "w")]
    bad = [r["file"].split("/files/")[1] for r in src.trace_file_rejects(spark, place).collect()]
    assert len(bad) == 2 and any(b.startswith("config=loop/trace=c/") for b in bad) and "loop/notes.json" in bad
    only = src.read_trace_files(spark, place, ["loop"])
    assert key(only) == [("loop", "plain_name", 4, "w")] and all("/files/loop/" in f for f in only.inputFiles())


def test_trace_files_of_one_partition_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(64).coalesce(1).selectExpr("concat('c', id % 2) AS config", "'q' AS question_id", "id AS run_index", "concat('e', id) AS error")
    src.write_trace_files(rows, str(tmp_path / "files"))
    names = [n for _, _, found in os.walk(tmp_path / "files") for n in found if n.endswith(".json")]
    assert len(names) == 64 and len({n.split("-")[1] for n in names}) >= spark.sparkContext.defaultParallelism
    good, bad = src.split_trace_files(spark, str(tmp_path / "files"))
    assert sorted((r["config"], r["run_index"], r["error"]) for r in good.collect()) == sorted((f"c{i % 2}", i, f"e{i}") for i in range(64)) and bad.count() == 0


def test_only_traces_of_listed_runs_are_looked_into(spark, tmp_path):
    failed = load(spark, tmp_path, [run("q", False, i) for i in range(9)])
    calls = "array(named_struct('tool', 'run_python', 'status', 'ok', 'raw_arguments', raw, 'sandbox', CAST(NULL AS struct<violations:array<struct<kind:string>>,limits_hit:array<string>>)))"
    none = "CAST(array() AS array<struct<ok:boolean,answer:struct<value:string>,verdict:struct<checks:array<struct<name:string,status:string>>>>>)"
    traces = spark.createDataFrame([("c", "q", i, json.dumps({"code": f" {i}"})) for i in range(50)], "config string, question_id string, run_index long, raw string")
    traces = traces.selectExpr("config", "question_id", "run_index", f"{calls} AS tool_calls", "named_struct('interpretation', raw) AS plan", f"{none} AS verifications")
    table = AN.failures_table(failed, question_table(spark), traces.withColumn("config", F.lit(failed.first()["config"])), ["run_index"])
    assert [r["last_codes"] for r in table.orderBy("run_index").collect()] == [["0"], ["1"]]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("transform(tool_calls") < plan.index("LeftSemi")  # the tree is printed from the top


def test_rejections(spark):
    rows = [("r", 0, False), ("r", 1, False), ("r", 2, False), ("s", 0, False), ("s", 1, True)]
    df = spark.createDataFrame(rows, "run string, seq int, ok boolean")
    out = V.running_rejections(df, ["run"], "seq").orderBy("run", "seq").collect()
    assert [(r["rejections"], r["ends_run"]) for r in out] == [(1, False), (2, False), (3, True), (1, False), (1, False)]
    ends = {r["run"]: r["outcome"] for r in V.rejection_sequence(df, ["run"]).collect()}
    assert ends == {"r": "rejected", "s": "answered"}


# ------------------------------------------------------------------------------- streaming
def test_stream_skips_finished_keys(spark, tmp_path):
    schema = RUNS_STORED.__class__([f for f in RUNS_STORED.fields if f.name in ("config", "question_id", "run_index", "correct")])
    landing, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    batch = lambda ids: spark.createDataFrame([("c", "q", i, True) for i in ids], schema).write.mode("append").json(landing)
    batch([0, 1, 1])
    stream_new_runs(spark, landing, table, progress, schema)
    batch([1, 2])
    stream_new_runs(spark, landing, table, progress, schema)
    stream_new_runs(spark, landing, table, progress, schema)
    stored = lambda: sorted(r["run_index"] for r in stored_runs(spark, table, schema).collect())
    assert stored() == [0, 1, 2]
    # A batch that is run again replaces its own rows: half of them lost, then all progress lost.
    file_of_2 = stored_runs(spark, table, schema).where("run_index = 2").select(F.input_file_name()).first()[0]
    os.remove(file_of_2.removeprefix("file://"))
    last = max(int(f) for f in os.listdir(f"{progress}/commits") if f.isdigit())
    os.remove(f"{progress}/commits/{last}"), os.remove(f"{progress}/commits/.{last}.crc")
    stream_new_runs(spark, landing, table, progress, schema)
    assert stored() == [0, 1, 2]
    stream_new_runs(spark, landing, table, progress + "-new", schema)
    assert stored() == [0, 1, 2]


def test_a_batch_reads_the_buckets_of_its_own_keys_only(spark, tmp_path):
    schema = RUNS_STORED.__class__([f for f in RUNS_STORED.fields if f.name in ("config", "question_id", "run_index", "correct")])
    landing, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    rows = spark.range(2_000).selectExpr("'c' AS config", "concat('q', id % 7) AS question_id", "CAST(id AS INT) AS run_index", "true AS correct")
    rows.write.json(landing)
    stream_new_runs(spark, landing, table, progress, schema)
    few = rows.where("run_index < 3")
    held = sorted({r[0] for r in few.select(key_bucket()).collect()})
    read = stored_keys(spark, table, schema, held)
    assert {f.split("bucket=")[1].split("/")[0] for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {str(b) for b in held}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "ReadSchema: struct<config:string,question_id:string,run_index:" in plan and "correct" not in plan.split("ReadSchema")[1]
    assert 0 < read.count() < 500 and few.join(read, ["config", "question_id", "run_index"]).count() == 3
