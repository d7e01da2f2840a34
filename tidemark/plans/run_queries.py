"""Registered queries over runs: metrics, joins, failure analysis, traces, storage, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import analysis as AN
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import verification as V
from ..operators.grading import join_questions
from ..schemas import COUNTER, REJECTED, RUN_KEY
from ..sources import runs as src
from ..streaming.runs import stored_runs, stream_new_runs
from .answer_queries import CATEGORY_SQL
from .registry import query
from .views import RUN_ORDER, Tables, r

ORDER_SQL = ", ".join(RUN_ORDER)
CONFIGS = ["A", "N", "R"]


def fact(k: int) -> str:
    """SQL of 1 - C(n-c, k) / C(n, k)."""
    return "1.0 - " + " * ".join(f"(CAST(n - c - {i} AS DOUBLE) / (n - {i}))" for i in range(k))


def pass_sql(k: int) -> str:
    return f"CASE WHEN n < {k} THEN NULL WHEN n - c < {k} THEN 1.0 ELSE {fact(k)} END"


PER_QUESTION = """SELECT config, question_id, count(*) AS n, count(*) FILTER (WHERE correct) AS c FROM runs_t GROUP BY 1, 2"""


@query(
    "pass_at_k",
    f"""SELECT config, question_id, round({pass_sql(1)}, 6) AS pass_1, round({pass_sql(5)}, 6) AS pass_5,
          round({pass_sql(10)}, 6) AS pass_10 FROM ({PER_QUESTION})""",
)
def pass_at_k(t: Tables):
    out = M.pass_at_k_by_question(t.runs)
    return out.select("config", "question_id", *[r(f"`pass@{k}`", 6).alias(f"pass_{k}") for k in M.KS])


BREAKDOWN = """SELECT config, '{f}' AS field, {f} AS value, CAST(count(*) AS BIGINT) AS runs,
    CAST(count(DISTINCT question_id) AS BIGINT) AS questions, round(avg(CAST(correct AS INT)), 6) AS pass_rate
    FROM runs_t GROUP BY config, {f}"""


@query("breakdown_by_field", BREAKDOWN.format(f="category") + " UNION ALL " + BREAKDOWN.format(f="difficulty"))
def breakdown_by_field(t: Tables):
    out = M.breakdown_by_field(t.runs)
    return out.select("config", "field", "value", "runs", "questions", r("pass_rate", 6).alias("pass_rate"))


@query(
    "breakdown_pivot",
    "SELECT category, "
    + ", ".join(f"round(avg(CASE WHEN config = '{c}' THEN CAST(correct AS INT) END), 6) AS \"{c}\"" for c in CONFIGS)
    + " FROM runs_t GROUP BY category",
)
def breakdown_pivot(t: Tables):
    out = M.breakdown_pivot(t.runs, "category", CONFIGS)
    return out.select("category", *[r(c, 6).alias(c) for c in CONFIGS])


CONSISTENCY = """SELECT config, avg(modal / n) AS consistency FROM (
    SELECT config, question_id, max(CASE WHEN answer_key IS NOT NULL THEN k END) AS modal, CAST(sum(k) AS DOUBLE) AS n FROM (
      SELECT config, question_id, answer_key, count(*) AS k FROM runs_t GROUP BY 1, 2, 3) GROUP BY 1, 2)
  WHERE modal IS NOT NULL GROUP BY config"""


@query("consistency", f"SELECT config, round(consistency, 6) AS consistency FROM ({CONSISTENCY})")
def consistency(t: Tables):
    return M.consistency(t.runs).select("config", r("consistency", 6).alias("consistency"))


SPREAD = """SELECT config, median(sd) AS spread FROM (
    SELECT config, question_id, stddev_samp(got_number) AS sd FROM runs_t GROUP BY 1, 2 HAVING count(got_number) >= 2) GROUP BY 1"""


@query("answer_spread", f"SELECT config, round(spread, 6) AS answer_spread_median FROM ({SPREAD})")
def answer_spread(t: Tables):
    return M.answer_spread(t.runs).select("config", r("answer_spread_median", 6).alias("answer_spread_median"))


CALLS = "ok_calls + schema_calls + rule_calls"


@query(
    "tool_status_rates",
    f"""SELECT config, CAST(sum({CALLS}) AS BIGINT) AS tool_calls,
          round(sum(schema_calls) / sum({CALLS}), 6) AS tool_schema_violation_rate,
          round(sum(rule_calls) / sum({CALLS}), 6) AS tool_rule_violation_rate, 0.0 AS tool_invalid_json_rate
        FROM runs_t GROUP BY config""",
)
def tool_status_rates(t: Tables):
    out = M.tool_status_rates(t.runs)
    return out.select("config", "tool_calls", *[r(c, 6).alias(c) for c in out.columns if c.endswith("_rate")])


def counted(counter: str, kind: str, n: str = "count(*)", where: str = "true") -> str:
    return f"SELECT config, '{counter}' AS counter, {kind} AS kind, CAST({n} AS BIGINT) AS n FROM runs_t WHERE {where} GROUP BY 1, 3"


COUNTED = " UNION ALL ".join(
    [
        counted("stop_reasons", "stop_reason"),
        counted("plan_status", "plan_status", where="plan_status IS NOT NULL"),
        counted("sandbox_violations", "'runtime_import'", "sum(runtime_import)", "runtime_import > 0"),
        counted("sandbox_violations", "'static_import'", "sum(static_import)", "static_import > 0"),
        counted("sandbox_limits", "'soft_timeout'", "sum(soft_timeout)", "soft_timeout > 0"),
    ]
)
MAPS = "SELECT config, " + ", ".join(
    f"coalesce(string_agg(concat(kind, '=', n), ' ' ORDER BY kind) FILTER (counter = '{c}'), '') AS {c}" for c in M.COUNTERS
) + f" FROM ({COUNTED}) GROUP BY config"


@query("map_counter_totals", COUNTED)
def map_counter_totals(t: Tables):
    return M.map_counter_totals(t.runs)


@query(
    "sandbox_events_table",
    """SELECT unnest(['runtime_import', 'soft_timeout', 'static_import']) AS event,
         unnest([CAST(sum(runtime_import) AS BIGINT), CAST(sum(soft_timeout) AS BIGINT), CAST(sum(static_import) AS BIGINT)]) AS count
       FROM runs_t""",
)
def sandbox_events_table(t: Tables):
    return M.sandbox_events(t.runs)


@query(
    "verifier_catches",
    """SELECT config, CAST(sum(CASE WHEN rejected_right THEN 0 ELSE rejected END) AS BIGINT) AS verifier_correct_catches,
         CAST(sum(CASE WHEN rejected_right THEN rejected ELSE 0 END) AS BIGINT) AS verifier_false_rejections
       FROM runs_t GROUP BY config""",
)
def verifier_catches(t: Tables):
    return M.verifier_catches(t.runs)


@query(
    "latency_token_medians",
    """SELECT config, round(median(total_s), 6) AS median_latency_s, round(median(input_tokens), 2) AS median_input_tokens,
         round(median(output_tokens), 2) AS median_output_tokens,
         CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens
       FROM runs_t GROUP BY config""",
)
def latency_token_medians(t: Tables):
    out = M.latency_token_medians(t.runs)
    return out.select(
        "config", r("median_latency_s", 6).alias("median_latency_s"), r("median_input_tokens", 2).alias("median_input_tokens"),
        r("median_output_tokens", 2).alias("median_output_tokens"), "total_input_tokens", "total_output_tokens",
    )


SUMMARY = f"""SELECT config, CAST(sum(n) AS BIGINT) AS runs, CAST(count(*) AS BIGINT) AS questions,
      CAST(min(n) AS BIGINT) AS runs_per_question_min,
      CAST(sum(c) AS DOUBLE) / sum(n) AS pass_rate,
      {', '.join(f'CASE WHEN min(n) >= {k} THEN avg({pass_sql(k)}) END AS pass_{k}' for k in M.KS)}
    FROM ({PER_QUESTION}) GROUP BY config"""
TOTALS = f"""SELECT config, CAST(sum({CALLS}) AS BIGINT) AS tool_calls, sum(schema_calls) / sum({CALLS}) AS schema_rate,
      sum(rule_calls) / sum({CALLS}) AS rule_rate,
      CAST(sum(CASE WHEN rejected_right THEN 0 ELSE rejected END) AS BIGINT) AS catches,
      CAST(sum(CASE WHEN rejected_right THEN rejected ELSE 0 END) AS BIGINT) AS false_rejections,
      CAST(sum(input_tokens) AS BIGINT) AS tin, CAST(sum(output_tokens) AS BIGINT) AS tout,
      median(total_s) AS latency, median(input_tokens) AS mtin, median(output_tokens) AS mtout
    FROM runs_t GROUP BY config"""
SUMMARY_JOINED = f"""SELECT * FROM ({SUMMARY}) JOIN ({TOTALS}) USING (config) JOIN ({CONSISTENCY}) USING (config)
    JOIN ({SPREAD}) USING (config)"""


@query(
    "summarize_runs",
    f"""SELECT config, runs, questions, runs_per_question_min, round(pass_rate, 6) AS pass_rate, round(pass_1, 6) AS pass_1,
          round(pass_5, 6) AS pass_5, round(pass_10, 6) AS pass_10, round(consistency, 6) AS consistency,
          round(spread, 6) AS answer_spread_median, tool_calls, round(schema_rate, 6) AS schema_rate,
          round(rule_rate, 6) AS rule_rate, catches, false_rejections, tin, tout, round(latency, 6) AS latency,
          round(mtin, 2) AS mtin, round(mtout, 2) AS mtout, {', '.join(M.COUNTERS)}
        FROM ({SUMMARY_JOINED}) JOIN ({MAPS}) USING (config)""",
)
def summarize_runs(t: Tables):
    return shown_summary(M.summarize_runs(t.runs))


def entries(counter: str):
    """A counter map as text, its kinds in order."""
    pairs = F.array_sort(F.map_entries(counter))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ").alias(counter)


def shown_summary(s):
    return s.select(
        "config", "runs", "questions", "runs_per_question_min", r("pass_rate", 6).alias("pass_rate"),
        *[r(f"`pass@{k}`", 6).alias(f"pass_{k}") for k in M.KS],
        r("consistency", 6).alias("consistency"), r("answer_spread_median", 6).alias("answer_spread_median"),
        "tool_calls", r("tool_schema_violation_rate", 6).alias("schema_rate"), r("tool_rule_violation_rate", 6).alias("rule_rate"),
        F.col("verifier_correct_catches").alias("catches"), F.col("verifier_false_rejections").alias("false_rejections"),
        F.col("total_input_tokens").alias("tin"), F.col("total_output_tokens").alias("tout"),
        r("median_latency_s", 6).alias("latency"), r("median_input_tokens", 2).alias("mtin"),
        r("median_output_tokens", 2).alias("mtout"), *[entries(c) for c in M.COUNTERS],
    )


@query(
    "results_table",
    f"""SELECT config, runs, questions, coalesce(printf('%.3f', pass_1), '-') AS pass_1, coalesce(printf('%.3f', pass_5), '-') AS pass_5,
          coalesce(printf('%.3f', pass_10), '-') AS pass_10, printf('%.3f', consistency) AS consistency,
          printf('%.1f', latency) AS median_s, printf('%.0f / %.0f', mtin + 0.001, mtout + 0.001) AS tokens_in_out
        FROM ({SUMMARY_JOINED})""",
)
def results_table(t: Tables):
    return AN.results_table(t.runs)


REASONS = f"""SELECT question_id, reason, count(*) AS k, min(({ORDER_SQL})) AS first FROM runs_t WHERE NOT correct GROUP BY 1, 2"""


@query(
    "hardest_questions",
    f"""SELECT q.question_id, category, difficulty, round(pass_rate, 6) AS pass_rate, runs, top_reason FROM (
          SELECT question_id, min(category) AS category, min(difficulty) AS difficulty, avg(CAST(correct AS INT)) AS pass_rate,
            CAST(count(*) AS BIGINT) AS runs FROM runs_t GROUP BY 1) q
        LEFT JOIN (SELECT question_id, arg_min(reason, (-k, first)) AS top_reason FROM ({REASONS}) GROUP BY 1) USING (question_id)
        ORDER BY q.pass_rate, q.question_id LIMIT 10""",
)
def hardest_questions(t: Tables):
    out = M.hardest_questions(t.runs, RUN_ORDER)
    return out.withColumn("pass_rate", r("pass_rate", 6))


@query(
    "failure_categories_ranked",
    f"SELECT {CATEGORY_SQL} AS category, CAST(count(*) AS BIGINT) AS failed FROM runs_t WHERE NOT correct GROUP BY 1",
)
def failure_categories_ranked(t: Tables):
    return AN.failure_categories_ranked(t.runs, RUN_ORDER)


@query("failed_questions_ranked", "SELECT question_id, CAST(count(*) AS BIGINT) AS failed FROM runs_t WHERE NOT correct GROUP BY 1")
def failed_questions_ranked(t: Tables):
    return AN.failed_questions_ranked(t.runs, RUN_ORDER)


@query("distinct_configs_sorted", "SELECT DISTINCT config FROM runs_t ORDER BY 1")
def distinct_configs_sorted(t: Tables):
    return M.distinct_configs(t.runs)


@query(
    "union_done_and_new",
    "SELECT config, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct FROM runs_t GROUP BY 1",
)
def union_done_and_new(t: Tables):
    both = src.union_done_and_new(t.runs.where("correct"), t.runs.where("NOT correct"))
    return both.groupBy("config").agg(F.count(F.lit(1)).alias("runs"), F.count_if("correct").alias("correct"))


@query(
    "failure_rate",
    """SELECT CAST(count(*) FILTER (WHERE NOT correct) AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS runs,
         printf('%.1f%%', 100.0 * count(*) FILTER (WHERE NOT correct) / count(*)) AS failure_rate FROM runs_t""",
)
def failure_rate(t: Tables):
    return AN.failure_rate(t.runs)


@query(
    "failed_runs_top2_per_question",
    f"""SELECT question_id, config, run_index, l_partkey, CAST(rank AS INT) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {ORDER_SQL}) AS rank FROM runs_t WHERE NOT correct)
        WHERE rank <= 2""",
)
def failed_runs_top2_per_question(t: Tables):
    return AN.failed_runs_top(t.runs, RUN_ORDER).select("question_id", "config", "run_index", "l_partkey", "rank")


# ------------------------------------------------------------------------------- tasks and joins
TASKS = """SELECT config, question_id, CAST(i AS BIGINT) AS run_index, config IN ('planner', 'full') AS plans
    FROM (SELECT unnest(['loop', 'planner', 'verifier', 'full']) AS config), questions_t, range({n}) r(i)"""


@query("build_tasks", f"SELECT config, question_id, run_index, plans FROM ({TASKS.format(n=20)})")
def build_tasks(t: Tables):
    return M.build_tasks(t.questions, 20).select("config", "question_id", "run_index", "plans")


DONE_CONFIG = "CASE l_returnflag WHEN 'A' THEN 'loop' WHEN 'N' THEN 'planner' ELSE 'verifier' END"


@query(
    "resume_todo",
    f"""SELECT config, question_id, run_index FROM ({TASKS.format(n=200)}) WHERE (config, question_id, run_index) NOT IN (
          SELECT ({DONE_CONFIG}, concat('q', l_suppkey), l_orderkey % 200) FROM lineitem)""",
)
def resume_todo(t: Tables):
    done = t.lineitem.select(
        F.expr(DONE_CONFIG).alias("config"),
        F.concat(F.lit("q"), F.col("l_suppkey").cast("string")).alias("question_id"),
        (F.col("l_orderkey") % 200).alias("run_index"),
    )
    return M.resume_todo(M.build_tasks(t.questions, 200), done).select("config", "question_id", "run_index")


@query(
    "estimate_cost",
    f"""SELECT config, CAST(count(*) AS BIGINT) AS tasks, round(sum(CASE WHEN plans THEN 5000 ELSE 3200 END) / 1e6 * 0.05
          + sum(CASE WHEN plans THEN 3800 ELSE 900 END) / 1e6 * 0.4, 6) AS cost
        FROM ({TASKS.format(n=200)}) GROUP BY config""",
)
def estimate_cost(t: Tables):
    return M.estimate_cost(M.build_tasks(t.questions, 200)).withColumn("cost", r("cost", 6))


@query(
    "select_questions",
    """SELECT question_id, pos FROM questions_t WHERE question_id IN (SELECT question_id FROM runs_t WHERE NOT correct)
       ORDER BY pos LIMIT 25""",
)
def select_questions(t: Tables):
    ids = t.runs.where(~F.col("correct")).select("question_id")
    return M.select_questions(t.questions, ids, 25).select("question_id", "pos")


@query("select_questions_unknown", "SELECT DISTINCT question_id FROM runs_t WHERE question_id NOT IN (SELECT question_id FROM asked_t)")
def select_questions_unknown(t: Tables):
    return M.unknown_ids(t.asked, t.runs.select("question_id"))


@query(
    "runs_join_questions",
    """SELECT r.question_id, unit, a.question_id IS NOT NULL AS known, CAST(count(*) AS BIGINT) AS runs
       FROM runs_t r LEFT JOIN asked_t a USING (question_id) GROUP BY 1, 2, 3""",
)
def runs_join_questions(t: Tables):
    joined = join_questions(t.runs, t.asked)
    known = F.col("question_known").isNotNull().alias("known")
    return joined.groupBy("question_id", "unit", known).agg(F.count(F.lit(1)).alias("runs"))


@query(
    "runs_join_truths",
    """SELECT config, CAST(count(*) FILTER (WHERE abs(got_number - truth) <= 10) AS BIGINT) AS near, CAST(count(*) AS BIGINT) AS runs
       FROM runs_t JOIN (SELECT question_id, round(avg(got_number), 4) AS truth FROM runs_t GROUP BY 1) USING (question_id)
       GROUP BY config""",
)
def runs_join_truths(t: Tables):
    truths = t.runs.groupBy("question_id").agg(r(F.avg("got_number")).alias("truth"))
    joined = t.runs.join(truths, "question_id")
    near = F.count_if(F.coalesce(F.abs(F.col("got_number") - F.col("truth")) <= 10, F.lit(False)))
    return joined.groupBy("config").agg(near.alias("near"), F.count(F.lit(1)).alias("runs"))


# ------------------------------------------------------------------------------- traces
KEY = ", ".join(RUN_KEY)


@query(
    "runs_join_traces",
    f"""SELECT config, question_id, run_index, correct, CASE WHEN k IS NOT NULL THEN k % 3 + 1 END AS n_calls
        FROM trace_runs_t LEFT JOIN (SELECT * FROM traces_t WHERE k % 5 <> 0) USING ({KEY})""",
)
def runs_join_traces(t: Tables):
    """Every fifth run has no trace: the missing side is what an outer join is about."""
    joined = AN.runs_join_traces(t.trace_runs, t.traces.where(F.col("run_index") % 5 != 0))
    calls = F.when(F.col("trace").isNotNull(), F.size("trace.tool_calls")).cast("long")
    return joined.select(*RUN_KEY, "correct", calls.alias("n_calls"))


@query(
    "read_traces",
    f"""SELECT {KEY}, k % 3 + 1 AS n_calls, k % 5 AS n_verifications, concat('plan ', k) AS plan, CAST(k AS VARCHAR) AS answer
        FROM traces_t""",
)
def read_traces(t: Tables):
    path = t.fresh("traces")
    src.write_traces(t.traces, path)
    back = src.read_traces(t.spark, path)
    return back.select(
        *RUN_KEY, F.size("tool_calls").cast("long").alias("n_calls"), F.size("verifications").cast("long").alias("n_verifications"),
        F.col("plan.interpretation").alias("plan"), F.col("answer.value").cast("string").alias("answer"),
    )


@query(
    "read_trace_files",
    """SELECT concat('c', s_nationkey % 4) AS config, concat('q', s_suppkey) AS question_id, s_suppkey % 3 AS run_index,
         concat('plan ', s_name) AS plan, CAST(NULL AS BIGINT) AS bad_files FROM supplier WHERE s_nationkey % 4 < 3 AND s_suppkey % 10 > 0
       UNION ALL SELECT NULL, NULL, NULL, NULL, count(*) FROM supplier WHERE s_nationkey % 4 < 3 AND s_suppkey % 10 = 0""",
)
def read_trace_files(t: Tables):
    """A file for each supplier; three of four folders are read, and names without a number are rejected."""
    path = t.fresh("trace-files")
    n = F.col("s_suppkey")
    plan = F.struct(F.concat(F.lit("plan "), F.col("s_name")).alias("interpretation"))
    config, question = F.concat(F.lit("c"), (F.col("s_nationkey") % 4).cast("string")), F.concat(F.lit("q"), n.cast("string"))
    rows = t.supplier.select(config.alias("config"), question.alias("question_id"), F.when(n % 10 > 0, n % 3).alias("run_index"), plan.alias("plan"))
    src.write_trace_files(rows, path)
    read = [f"config=c{k}" for k in range(3)]
    traces, rejects = src.split_trace_files(t.spark, path, read)
    good = traces.select(*RUN_KEY, F.col("plan.interpretation").alias("plan"), F.lit(None).cast("long").alias("bad_files"))
    bad = rejects.agg(F.count(F.lit(1)).alias("bad_files"))
    return good.unionByName(bad, allowMissingColumns=True)


@query(
    "tokens_per_run",
    f"""SELECT {KEY}, 'agent' AS purpose, CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS calls,
          k % 500 + CASE WHEN k % 3 = 0 THEN 0 ELSE k % 50 END AS input_tokens,
          c % 300 + CASE WHEN k % 3 = 0 THEN 0 ELSE c % 30 END AS output_tokens FROM traces_t
        UNION ALL SELECT {KEY}, 'planner', 1, 100, k % 7 FROM traces_t WHERE k % 3 = 2""",
)
def tokens_per_run(t: Tables):
    return AN.tokens_per_run(t.traces)


@query(
    "run_row_from_trace",
    f"""SELECT {KEY}, CAST(k AS VARCHAR) AS raw_value, CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS ok_calls,
          CAST(CASE WHEN k % 3 = 2 THEN 1 END AS BIGINT) AS broken_calls,
          CAST(CASE WHEN k % 3 > 0 AND k % 4 = 0 THEN 1 END AS BIGINT) AS static_import,
          CAST(CASE WHEN k % 3 > 0 AND k % 6 = 0 THEN 1 END AS BIGINT) AS soft_timeout,
          (SELECT coalesce(string_agg(concat(k + i, ':', CASE WHEN k % 3 = 0 THEN 'range,' ELSE '' END, 'provenance'), ' ' ORDER BY i), '')
           FROM range(4) r(i) WHERE i < k % 5 AND (k + i) % 2 = 1) AS rejected,
          k % 500 + CASE WHEN k % 3 > 0 THEN k % 50 ELSE 0 END + CASE WHEN k % 3 = 2 THEN 100 ELSE 0 END AS input_tokens,
          c % 300 + CASE WHEN k % 3 > 0 THEN c % 30 ELSE 0 END + CASE WHEN k % 3 = 2 THEN k % 7 ELSE 0 END AS output_tokens,
          CAST(k % 9 AS INT) AS turns
        FROM traces_t""",
)
def run_row_from_trace(t: Tables):
    rows = AN.run_row_from_trace(t.traces)
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    rejected = F.array_join(
        F.transform("rejected_answers", lambda a: F.concat(a["value"], F.lit(":"), F.array_join(a["failed_checks"], ","))), " "
    )
    return rows.select(
        *RUN_KEY,
        "raw_value",
        get("tool_status_counts", "ok").alias("ok_calls"),
        get("tool_status_counts", "invalid_json").alias("broken_calls"),
        get("sandbox_violations", "static_import").alias("static_import"),
        get("sandbox_limits", "soft_timeout").alias("soft_timeout"),
        rejected.alias("rejected"),
        "input_tokens",
        "output_tokens",
        "turns",
    )


def trace_verifications(t: Tables):
    return t.traces.select(*RUN_KEY, F.posexplode("verifications").alias("seq", "v")).select(*RUN_KEY, "seq", "v.ok")


@query(
    "running_rejections",
    f"""SELECT {KEY}, CAST(seq AS INT) AS seq, ok, CAST(count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY {KEY} ORDER BY seq) AS BIGINT) AS rejections
        FROM verifications_t""",
)
def running_rejections(t: Tables):
    out = V.running_rejections(trace_verifications(t), RUN_KEY, "seq")
    return out.select(*RUN_KEY, "seq", "ok", F.col("rejections").cast("long").alias("rejections"))


@query(
    "running_count_by_user",
    """SELECT user_id, event_id, CAST(count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS errors
       FROM events""",
)
def running_count_by_user(t: Tables):
    rows = t.events.select("user_id", "event_id", "event_type")
    out = O.running_count(rows, F.col("event_type") == "error", "event_id", ["user_id"], "errors")
    return out.select("user_id", "event_id", F.col("errors").cast("long").alias("errors"))


@query(
    "rejection_sequence",
    f"""SELECT {KEY}, CAST(count(*) AS BIGINT) AS verifications, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS rejections,
          CASE WHEN count(*) FILTER (WHERE NOT ok) > 1 THEN 'rejected' WHEN bool_or(ok) THEN 'answered' ELSE 'open' END AS outcome
        FROM verifications_t GROUP BY {KEY}""",
)
def rejection_sequence(t: Tables):
    return V.rejection_sequence(trace_verifications(t), RUN_KEY, max_rejections=1)


@query(
    "failures_table",
    f"""SELECT question_id, config, run_index, reason, expected, got, answer_unit, CAST(rank AS INT) AS rank, a.text AS question_text,
          CASE WHEN a.pos % 2 = 0 THEN 'even, number' WHEN a.pos IS NOT NULL THEN '' END AS intended_trap,
          concat('plan ', t.k) AS plan_interpretation,
          CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN concat('result = ', k)
            ELSE concat('result = ', k, ' | {{"code": "x', k) END AS last_codes,
          (SELECT coalesce(string_agg(concat(k + i, ': ', CASE WHEN k % 3 = 0 THEN 'range, ' ELSE '' END, 'provenance'), ' | ' ORDER BY i), '')
           FROM range(4) r(i) WHERE i < k % 5 AND (k + i) % 2 = 1) AS rejected
        FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY run_index) AS rank FROM trace_runs_t WHERE NOT correct) r
        LEFT JOIN questions_t a USING (question_id) LEFT JOIN traces_t t USING ({KEY}) WHERE rank <= 2""",
)
def failures_table(t: Tables):
    out = AN.failures_table(t.trace_runs, t.questions, t.traces, ["run_index"])
    codes = F.when(F.col("last_codes").isNotNull(), F.array_join("last_codes", " | "))
    rejected = F.transform("rejected", lambda v: F.concat_ws(": ", v["value"], v["failed_checks"]))
    return out.select(
        "question_id", "config", "run_index", "reason", "expected", "got", "answer_unit", "rank", "question_text", "intended_trap",
        "plan_interpretation", codes.alias("last_codes"), F.array_join(rejected, " | ").alias("rejected"),
    )


@query("question_listing", "SELECT question_id, category, difficulty, coalesce(unit, '-') AS unit, left(text, 70) AS text FROM questions_t")
def question_listing(t: Tables):
    return AN.question_listing(t.questions)


@query("question_counts", "SELECT category, CAST(count(*) AS BIGINT) AS questions FROM questions_t GROUP BY 1")
def question_counts(t: Tables):
    return AN.question_counts(t.questions)


# ------------------------------------------------------------------------------- storage
def stored_rows(t: Tables):
    """Runs as they are stored: what was graded is a number in some rows and a text in others."""
    number = F.col("got_number").cast("string")
    token = F.when(F.col("answer_key") == "1", F.concat(F.lit('"k'), F.col("answer_key"), F.lit('"'))).otherwise(number)
    return t.runs.select(*[c for c in t.runs.columns if not c.startswith("l_")], F.parse_json(token).alias("got"))


STORED_OUT = """SELECT config, question_id, run_index, round(total_s, 6) AS total_s,
    CASE WHEN answer_key = '1' THEN 'k1' ELSE CAST(CAST(got_number AS INT) AS VARCHAR) END AS answer_value,
    got_number IS NOT NULL AND answer_key <> '1' AS answer_is_number, CAST(ok_calls AS BIGINT) AS ok_calls FROM runs_t"""


def stored_view(rows):
    value = F.when(
        F.col("answer_is_number"), F.col("answer_value").cast("double").cast("int").cast("string")
    ).otherwise(F.col("answer_value"))
    return rows.select(
        *RUN_KEY, r("total_s", 6).alias("total_s"), value.alias("answer_value"), "answer_is_number",
        F.col("tool_status_counts")["ok"].alias("ok_calls"),
    )


@query("read_runs", STORED_OUT)
def read_runs(t: Tables):
    path = t.fresh("runs")
    src.append_runs(stored_rows(t), path)
    return stored_view(src.read_runs(t.spark, path))


@query("append_runs", STORED_OUT)
def append_runs(t: Tables):
    path = t.fresh("runs")
    for part in ("correct", "NOT correct"):
        src.append_runs(stored_rows(t).where(part), path)
    return stored_view(src.read_runs(t.spark, path))


@query(
    "write_regraded",
    """SELECT config, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS before,
         CAST(count(*) FILTER (WHERE coalesce(got_number > 25, false)) AS BIGINT) AS after FROM runs_t GROUP BY config""",
)
def write_regraded(t: Tables):
    original, target = t.fresh("runs"), t.fresh("regraded")
    src.append_runs(stored_rows(t), original)
    old = src.read_runs(t.spark, original)
    fresh = old.select(*RUN_KEY, F.coalesce(F.col("got_number") > 25, F.lit(False)).alias("correct"))
    src.write_regraded(fresh, target)
    new = t.spark.read.schema("config string, question_id string, run_index bigint, correct boolean").json(target)
    after = new.groupBy("config").agg(F.count_if("correct").alias("after"))
    before = old.groupBy("config").agg(F.count(F.lit(1)).alias("runs"), F.count_if("correct").alias("before"))
    return before.join(after, "config")


@query(
    "write_summary",
    f"""SELECT config, runs, questions, round(pass_1, 6) AS pass_1, round(consistency, 6) AS consistency, {', '.join(M.COUNTERS)}
        FROM ({SUMMARY_JOINED}) JOIN ({MAPS}) USING (config)""",
)
def write_summary(t: Tables):
    path = t.fresh("summary")
    src.write_summary(M.summarize_runs(t.runs), path)
    maps = ", ".join(f"{c} map<string,bigint>" for c in M.COUNTERS)
    back = t.spark.read.schema(f"config string, runs bigint, questions bigint, `pass@1` double, consistency double, {maps}").json(path)
    return back.select(
        "config", "runs", "questions", r("`pass@1`", 6).alias("pass_1"), r("consistency", 6).alias("consistency"),
        *[entries(c) for c in M.COUNTERS],
    )


# ------------------------------------------------------------------------------- streaming
STREAMED = T.StructType(
    [
        T.StructField("config", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("run_index", T.LongType()),
        T.StructField("correct", T.BooleanType()),
        T.StructField("answer_key", T.StringType()),
        T.StructField("got_number", T.DoubleType()),
        T.StructField("tool_status_counts", COUNTER),
        T.StructField("rejected_answers", REJECTED),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("total_s", T.DoubleType()),
    ]
)


@query(
    "stream_runs_metrics",
    """WITH s AS (SELECT o_orderstatus AS config, o_custkey % 100 AS q, o_orderkey % 3 = 0 AS correct, o_orderkey % 5 AS key,
           o_totalprice / 1000 AS total_s, o_orderkey % 700 AS tin FROM orders)
       SELECT config, CAST(count(*) AS BIGINT) AS runs, CAST(count(DISTINCT q) AS BIGINT) AS questions,
         round(avg(CAST(correct AS INT)), 6) AS pass_rate, round(median(total_s), 6) AS median_latency_s,
         CAST(sum(tin) AS BIGINT) AS total_input_tokens FROM s GROUP BY config""",
)
def stream_runs_metrics(t: Tables):
    """Runs land in two steps with overlapping keys; each step streams what is new."""
    k = F.col("o_orderkey")
    rows = t.orders.select(
        *Tables._trace_key(),
        (k % 3 == 0).alias("correct"),
        (k % 5).cast("string").alias("answer_key"),
        (k % 5).cast("double").alias("got_number"),
        F.create_map(F.lit("ok"), F.lit(1).cast("long")).alias("tool_status_counts"),
        F.lit(None).cast(REJECTED).alias("rejected_answers"),
        (k % 700).alias("input_tokens"),
        F.lit(1).cast("long").alias("output_tokens"),
        (F.col("o_totalprice") / 1000).alias("total_s"),
    )
    landing, table, checkpoint = t.fresh("landing"), t.fresh("stored"), t.fresh("progress")
    first, second = F.col("run_index") % 4 < 3, F.col("run_index") % 4 > 1
    for part in (first, second):
        src.append_runs(rows.where(part), landing)
        stream_new_runs(t.spark, landing, table, checkpoint, STREAMED)
    out = M.summarize_runs(stored_runs(t.spark, table, STREAMED), with_maps=False)
    return out.select(
        "config", "runs", "questions", r("pass_rate", 6).alias("pass_rate"), r("median_latency_s", 6).alias("median_latency_s"),
        "total_input_tokens",
    )
