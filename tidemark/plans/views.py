"""How the test tables stand in for the library's inputs.

``Tables`` builds each input with the DataFrame API; ``VIEWS`` states the same input as SQL for the
oracle.  No view numbers rows with a window or gathers a group: keys come from the tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import HUM, PRECIP, PRESS, TEMP, WIND
from ..session import fresh_path, prepare

RUN_ORDER = ["run_index", "l_partkey", "l_suppkey", "l_extendedprice"]
ANSWER_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
MARKER = "#result#"


def r(c: Column | str, digits: int = 4) -> Column:
    """Round for comparison with another engine; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def pick(key: Column, n: int, *texts: Column | str) -> Column:
    """texts[key % n]."""
    out = None
    for i, t in enumerate(texts):
        t = F.lit(t) if isinstance(t, str) else t
        out = F.when(key % n == i, t) if out is None else out.when(key % n == i, t)
    return out


class Tables:
    """The test tables of one folder, and the inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def fresh(self, name: str) -> str:
        return fresh_path(self.spark, name)

    # ---------------------------------------------------------------- series
    @cached_property
    def ticks(self) -> DataFrame:
        """Irregular raw records with a timestamp."""
        return self.events.withColumn("time", F.col("ts").cast("timestamp"))

    @cached_property
    def series_h(self) -> DataFrame:
        return self.ticks.groupBy(F.date_trunc("hour", "time").alias("time")).agg(
            F.avg("value").alias("v"), F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")
        )

    @cached_property
    def orders_t(self) -> DataFrame:
        return self.orders.withColumn("time", F.col("o_orderdate").cast("timestamp"))

    @cached_property
    def series_d(self) -> DataFrame:
        return self.orders_t.groupBy("time").agg(
            F.avg("o_totalprice").alias("v"), F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n")
        )

    @cached_property
    def weather(self) -> DataFrame:
        """An hourly series of five measures with gaps, 2020 to 2026."""
        k, c = F.col("o_orderkey") % 100000, F.col("o_custkey") % 100000
        time = F.col("time") + F.expr("INTERVAL 9131 DAYS") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
        rows = self.orders_t.select(
            time.alias("time"),
            (k * 7919 % 450).alias("a"),
            ((c * 31 + k * 17) % 1000).alias("b"),
            F.when((k * 13 + c) % 8 == 0, k % 37 + 1).otherwise(0).alias("p"),
            (c % 400).alias("w"),
            (k * 11 % 400).alias("q"),
        )
        n = F.count(F.lit(1))
        return rows.groupBy("time").agg(
            (F.sum("a").cast("double") / n / 10 - 10).alias(TEMP),
            (F.sum("b").cast("double") / n / 10).alias(HUM),
            (F.sum("p").cast("double") / 4).alias(PRECIP),
            (F.sum("w").cast("double") / n / 10).alias(WIND),
            (F.sum("q").cast("double") / n / 10 + 940).alias(PRESS),
        )

    # ---------------------------------------------------------------- runs
    @cached_property
    def runs(self) -> DataFrame:
        """Run rows; one per line item, in file order RUN_ORDER."""
        right = F.col("l_linestatus") == "F"
        none = ~right & (F.col("l_linenumber") % 4 == 1)
        reason = F.when(right, F.lit("within tolerance")).otherwise(
            pick(
                F.col("l_linenumber"), 4,
                F.concat(F.lit("off by "), F.col("l_linenumber").cast("string")),
                "no answer was submitted",
                "answered a question the dataset cannot answer",
                "declined an answerable question",
            )
        )
        ok, part = F.col("l_orderkey"), F.col("l_partkey")

        def counter(*pairs: tuple[str, Column]) -> Column:
            entries = [F.struct(F.lit(k).alias("key"), n.cast("long").alias("value")) for k, n in pairs]
            return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0))

        rejected = F.array_repeat(
            F.struct(
                F.lit("1").alias("value"),
                F.lit(None).cast("string").alias("unit"),
                (part % 2 == 0).alias("was_correct"),
                F.array(F.lit("provenance")).alias("failed_checks"),
            ),
            (F.col("l_linenumber") % 3).cast("int"),
        )
        return self.lineitem.select(
            F.col("l_returnflag").alias("config"),
            F.concat(F.lit("q"), F.col("l_suppkey").cast("string")).alias("question_id"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run_index"),
            F.concat(F.lit("c"), (F.col("l_suppkey") % 7).cast("string")).alias("category"),
            pick(F.col("l_suppkey"), 3, "easy", "medium", "hard").alias("difficulty"),
            right.alias("correct"),
            reason.alias("reason"),
            F.when(~none, (F.col("l_quantity").cast("int") % 5).cast("string")).alias("answer_key"),
            F.when(~none, F.col("l_quantity")).alias("got_number"),
            pick(ok, 5, F.lit(None).cast("string"), "max_turns", "answered", "answered", "answered").alias("stop_reason"),
            pick(ok, 4, F.lit(None).cast("string"), "rule_violation", "ok", "ok").alias("plan_status"),
            counter(
                ("ok", F.col("l_linenumber")),
                ("schema_violation", F.when(ok % 11 == 0, 1).otherwise(0)),
                ("rule_violation", F.when(ok % 13 == 0, 1).otherwise(0)),
            ).alias("tool_status_counts"),
            counter(
                ("runtime_import", F.when(ok % 7 == 0, 1).otherwise(0)),
                ("static_import", F.when(part % 9 == 0, 2).otherwise(0)),
            ).alias("sandbox_violations"),
            counter(("soft_timeout", F.when(ok % 17 == 0, 1).otherwise(0))).alias("sandbox_limits"),
            rejected.alias("rejected_answers"),
            (ok % 5000).alias("input_tokens"),
            (part % 2000).alias("output_tokens"),
            (F.col("l_extendedprice") / 1000).alias("total_s"),
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
        )

    @cached_property
    def questions(self) -> DataFrame:
        """The question list: one row per supplier."""
        n = F.col("s_suppkey")
        return self.supplier.select(
            n.alias("pos"),
            F.concat(F.lit("q"), n.cast("string")).alias("question_id"),
            F.concat(F.lit("c"), (n % 7).cast("string")).alias("category"),
            pick(n, 3, "easy", "medium", "hard").alias("difficulty"),
            F.when(n % 4 > 0, F.lit("°C")).alias("unit"),
            F.concat(F.lit("question "), F.repeat(F.col("s_name"), 5)).alias("text"),
            F.lit(0.01).alias("tolerance"),
            F.when(n % 2 == 0, F.array(F.lit("even"), F.lit("number"))).otherwise(F.array().cast("array<string>")).alias("traps"),
        )

    @cached_property
    def asked(self) -> DataFrame:
        """Every second question: the rest of the ids are unknown."""
        return self.questions.where(F.col("pos") % 2 == 0)

    # ---------------------------------------------------------------- answers
    @cached_property
    def answers(self) -> DataFrame:
        """Numeric answers in several units; the truth is in °C with tolerance 0.01."""
        q, n = F.col("l_quantity"), F.col("l_linenumber")
        got = (
            F.when(n == 2, q + 273.15).when(n == 3, q * 9 / 5 + 32).when(n == 4, q + 0.005).when(n == 5, q + 0.02).otherwise(q)
        )
        unit = pick(n, 8, F.lit(None).cast("string"), "°C", "Kelvin", " degF ", "celsius", "°C", "mm", F.lit(None).cast("string"))
        abstains = F.col("l_orderkey") % 7 == 0
        return self.lineitem.select(
            *ANSWER_KEY,
            q.cast("string").alias("expected"),
            F.lit(True).alias("expected_is_number"),
            F.when(abstains, F.lit(" Not Answerable ")).otherwise(got.cast("string")).alias("answer_value"),
            (~abstains).alias("answer_is_number"),
            unit.alias("answer_unit"),
            F.lit("°C").alias("unit"),
            F.lit(0.01).alias("tolerance"),
        )

    @cached_property
    def texts(self) -> DataFrame:
        """Month answers in several spellings."""
        y, m, d = (F.date_format("time", p) for p in ("yyyy", "MM", "dd"))
        got = pick(
            F.col("o_orderkey"), 5,
            F.concat(y, F.lit("-"), F.month("time").cast("string")),
            F.concat(F.lit(" July  "), y, F.lit(" ")),
            F.concat_ws("-", y, m, d),
            F.concat(y, F.lit(" January")),
            F.col("o_orderpriority"),
        )
        return self.orders_t.select(
            "o_orderkey",
            F.concat_ws("-", y, m).alias("expected"),
            F.lit(False).alias("expected_is_number"),
            got.alias("answer_value"),
            F.lit(False).alias("answer_is_number"),
            F.lit(None).cast("string").alias("answer_unit"),
            F.lit(None).cast("string").alias("unit"),
            F.lit(0.01).alias("tolerance"),
        )

    # ---------------------------------------------------------------- recorded calls
    @cached_property
    def calls(self) -> DataFrame:
        """Raw tool calls, valid and broken; run = user_id, order = event_id."""
        u = F.col("user_id").cast("string")
        raw = pick(
            F.col("event_id"), 6,
            F.col("props"),
            F.concat(F.lit('{"code": "result = '), u, F.lit('"}')),
            '{"code": "   "}',
            '{"code": "result = 1"',
            F.concat(F.lit('{"value": '), u, F.lit('.50, "unit": "mm", "method_summary": "m"}')),
            '{"value": [1], "unit": null, "method_summary": "m"}',
        )
        tool = (
            F.when(F.col("event_type") == "error", F.lit("delete_everything"))
            .when(F.col("event_type") == "purchase", F.lit("submit_answer"))
            .otherwise(F.lit("run_python"))
        )
        return self.events.select(
            "event_id", "user_id", tool.alias("tool"), raw.alias("raw_arguments"),
            F.when(F.col("event_id") % 9 == 0, F.lit("rule_violation")).otherwise(F.lit("ok")).alias("status"), "value",
        )

    @cached_property
    def executions(self) -> DataFrame:
        """What each execution produced; run = user_id."""
        i = F.col("event_id")
        nan = i % 50 == 0
        return self.events.select(
            "user_id",
            "event_id",
            F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("ok")).alias("status"),
            F.lit("number").alias("type"),
            F.when(~nan, F.col("value").cast("string")).alias("value"),
            nan.alias("is_nan"),
            F.lit(False).alias("is_inf"),
            F.when(i % 40 == 0, 1).otherwise(0).alias("n_missing"),
            F.lit(None).cast("string").alias("head"),
            F.lit(None).cast("string").alias("repr"),
            F.col("props").alias("stdout"),
        )

    @cached_property
    def submissions(self) -> DataFrame:
        """Answers to verify, one an event: exact, rounded, guessed and text values of the user's own events."""
        i, v = F.col("event_id"), F.col("value")
        tenths = F.floor(v * 10).cast("bigint")
        one = F.concat_ws(".", F.floor(tenths / 10).cast("string"), F.pmod(tenths, F.lit(10)).cast("string"))
        literal = pick(
            i, 6,
            v.cast("string"),
            one,
            F.floor(v).cast("bigint").cast("string"),
            F.concat(F.lit('"k": '), (i % 100).cast("string")),
            F.concat(F.floor(v).cast("bigint").cast("string"), F.lit("e0")),
            "not answerable",
        )
        text = i % 6 == 3
        abstains = i % 6 == 5
        unit = pick(i, 5, "mm", "furlongs", F.lit(None).cast("string"), "mm/day", "°C")
        raw = F.concat(F.lit('{"unit": null, "value": '), F.when(~text & ~abstains, literal).otherwise(F.lit('"x"')), F.lit("}"))
        return self.events.select(
            "user_id",
            "event_id",
            literal.alias("answer_value"),
            (~text & ~abstains).alias("answer_is_number"),
            F.when(~abstains, unit).alias("answer_unit"),
            pick(i, 2, "mean of values", "mean without missing values").alias("method_summary"),
            raw.alias("raw_arguments"),
            F.when(i % 7 == 0, F.lit("degC")).when(i % 7 == 1, F.lit("mm")).alias("planned_unit"),
        )

    @cached_property
    def needles(self) -> DataFrame:
        """Texts to find in a run's outputs, one an event: within an output, over one seam, over two, and none."""
        i = F.col("event_id")
        a, b = (F.lpad(F.pmod(i * f, F.lit(100)).cast("string"), 2, "0") for f in (7, 13))
        one = F.concat(F.substring(a, 2, 1), F.lit('} '), F.floor(F.pmod(F.col("value"), F.lit(40))).cast("string"))
        two = F.concat(F.lit('} '), F.floor(F.col("value") / 4).cast("string"))
        whole = F.concat(F.lit('   {"k": '), a, F.lit('}    {"k": '), F.substring(b, 1, 1))
        needle = pick(i, 5, F.concat(F.lit('"k": '), a), one, two, whole, "")
        return self.events.select("user_id", "event_id", needle.alias("needle"))

    # ---------------------------------------------------------------- traces
    @cached_property
    def trace_runs(self) -> DataFrame:
        """Run rows whose key is unique: one per order."""
        k, off = F.col("o_orderkey"), F.col("o_custkey") % 5
        return self.orders.select(
            *self._trace_key(),
            (k % 3 == 0).alias("correct"),
            F.concat(F.lit("off by "), off.cast("string")).alias("reason"),
            (k % 1000).cast("string").alias("expected"),
            F.when(k % 8 > 0, (k % 1000 + off).cast("string")).alias("got"),
            F.when(k % 4 > 0, F.lit("mm")).alias("answer_unit"),
        )

    @staticmethod
    def _trace_key() -> list[Column]:
        return [
            F.col("o_orderstatus").alias("config"),
            F.concat(F.lit("q"), (F.col("o_custkey") % 100).cast("string")).alias("question_id"),
            F.col("o_orderkey").alias("run_index"),
        ]

    @cached_property
    def traces(self) -> DataFrame:
        """One stored document per order."""
        k = F.col("o_orderkey")
        ks = k.cast("string")
        none = F.lit(None).cast("string")

        def execution(kinds: Column, limits: Column) -> Column:
            return F.struct(F.lit("ok").alias("status"), kinds.alias("violations"), limits.alias("limits_hit"))

        def call(tool: str, status: str, raw: Column, sandbox: Column) -> Column:
            return F.struct(F.lit(tool).alias("tool"), F.lit(status).alias("status"), raw.alias("raw_arguments"), sandbox.alias("sandbox"))

        no_kinds = F.expr("array()").cast("array<struct<kind:string>>")
        no_limits = F.array().cast("array<string>")
        one_kind = F.array(F.struct(F.lit("static_import").alias("kind")))
        kinds = F.when(k % 4 == 0, one_kind).otherwise(no_kinds)
        limits = F.when(k % 6 == 0, F.array(F.lit("soft_timeout"))).otherwise(no_limits)
        calls = F.array(
            call("describe_dataset", "ok", F.lit("{}"), F.lit(None).cast("struct<status:string,violations:array<struct<kind:string>>,limits_hit:array<string>>")),
            call("run_python", "ok", F.concat(F.lit('{"code": "result = '), ks, F.lit('"}')), execution(kinds, limits)),
            call("run_python", "invalid_json", F.concat(F.lit('{"code": "x'), ks), execution(no_kinds, no_limits)),
        )
        models = F.array(
            *[
                F.struct(F.lit(p).alias("purpose"), i.alias("input_tokens"), o.alias("output_tokens"))
                for p, i, o in (
                    ("agent", k % 500, F.col("o_custkey") % 300), ("agent", k % 50, F.col("o_custkey") % 30),
                    ("planner", F.lit(100).cast("long"), k % 7),
                )
            ]
        )

        def check(name: str, bad: Column) -> Column:
            return F.struct(F.lit(name).alias("name"), F.when(bad, F.lit("fail")).otherwise(F.lit("pass")).alias("status"), F.lit("").alias("detail"))

        def answer(v: Column) -> Column:
            return F.struct(F.parse_json(v.cast("string")).alias("value"), F.lit("mm").alias("unit"), F.lit("m").alias("method_summary"))

        def verification(i: int) -> Column:
            bad = (k + i) % 2 == 1
            checks = F.array(check("range", bad & (k % 3 == 0)), check("provenance", bad))
            return F.struct((~bad).alias("ok"), answer(k + i).alias("answer"), F.struct(checks.alias("checks")).alias("verdict"))

        verifications = F.slice(F.array(*[verification(i) for i in range(4)]), F.lit(1), (k % 5).cast("int"))
        return self.orders.select(
            *self._trace_key(),
            F.lit("q?").alias("question"),
            F.lit("m").alias("model"),
            pick(k, 2, "ok", none).alias("plan_status"),
            F.lit("answered").alias("stop_reason"),
            (k % 9).cast("int").alias("turns"),
            (F.col("o_totalprice") / 100000).alias("total_s"),
            none.alias("error"),
            answer(k).alias("answer"),
            F.struct(F.concat(F.lit("plan "), ks).alias("interpretation")).alias("plan"),
            F.slice(calls, F.lit(1), (k % 3 + 1).cast("int")).alias("tool_calls"),
            F.slice(models, F.lit(1), (k % 3 + 1).cast("int")).alias("llm_calls"),
            verifications.alias("verifications"),
        )


# The same inputs as SQL for the oracle.
VIEWS: dict[str, str] = {
    "series_h": """SELECT date_trunc('hour', ts) AS time, avg(value) AS v, sum(value) AS s, count(*) AS n
        FROM events GROUP BY 1""",
    "series_d": """SELECT o_orderdate AS time, avg(o_totalprice) AS v, sum(o_totalprice) AS s, count(*) AS n
        FROM orders GROUP BY 1""",
    "weather_rows": """SELECT o_orderdate + INTERVAL 9131 DAY + to_hours(CAST(o_orderkey % 24 AS INT)) AS time,
          o_orderkey % 100000 AS k, o_custkey % 100000 AS c FROM orders""",
    "weather": """SELECT time,
          CAST(sum(k * 7919 % 450) AS DOUBLE) / count(*) / 10 - 10 AS temperature_2m,
          CAST(sum((c * 31 + k * 17) % 1000) AS DOUBLE) / count(*) / 10 AS relative_humidity_2m,
          CAST(sum(CASE WHEN (k * 13 + c) % 8 = 0 THEN k % 37 + 1 ELSE 0 END) AS DOUBLE) / 4 AS precipitation,
          CAST(sum(c % 400) AS DOUBLE) / count(*) / 10 AS wind_speed_10m,
          CAST(sum(k * 11 % 400) AS DOUBLE) / count(*) / 10 + 940 AS surface_pressure
        FROM weather_rows GROUP BY time""",
    "runs_t": """SELECT l_returnflag AS config, concat('q', l_suppkey) AS question_id,
          l_orderkey * 8 + l_linenumber AS run_index, concat('c', l_suppkey % 7) AS category,
          CASE l_suppkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
          l_linestatus = 'F' AS correct,
          CASE WHEN l_linestatus = 'F' THEN 'within tolerance'
               WHEN l_linenumber % 4 = 0 THEN concat('off by ', l_linenumber)
               WHEN l_linenumber % 4 = 1 THEN 'no answer was submitted'
               WHEN l_linenumber % 4 = 2 THEN 'answered a question the dataset cannot answer'
               ELSE 'declined an answerable question' END AS reason,
          CASE WHEN l_linestatus <> 'F' AND l_linenumber % 4 = 1 THEN NULL
               ELSE CAST(CAST(floor(l_quantity) AS INT) % 5 AS VARCHAR) END AS answer_key,
          CASE WHEN l_linestatus <> 'F' AND l_linenumber % 4 = 1 THEN NULL ELSE l_quantity END AS got_number,
          CASE l_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'max_turns' ELSE 'answered' END AS stop_reason,
          CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'rule_violation' ELSE 'ok' END AS plan_status,
          l_linenumber AS ok_calls, CAST(l_orderkey % 11 = 0 AS INT) AS schema_calls,
          CAST(l_orderkey % 13 = 0 AS INT) AS rule_calls,
          CAST(l_orderkey % 7 = 0 AS INT) AS runtime_import, 2 * CAST(l_partkey % 9 = 0 AS INT) AS static_import,
          CAST(l_orderkey % 17 = 0 AS INT) AS soft_timeout,
          l_linenumber % 3 AS rejected, l_partkey % 2 = 0 AS rejected_right,
          l_orderkey % 5000 AS input_tokens, l_partkey % 2000 AS output_tokens, l_extendedprice / 1000 AS total_s,
          l_partkey, l_suppkey, l_extendedprice
        FROM lineitem""",
    "questions_t": """SELECT s_suppkey AS pos, concat('q', s_suppkey) AS question_id, concat('c', s_suppkey % 7) AS category,
          CASE s_suppkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
          CASE WHEN s_suppkey % 4 > 0 THEN '°C' END AS unit, concat('question ', repeat(s_name, 5)) AS text
        FROM supplier""",
    "asked_t": "SELECT * FROM questions_t WHERE pos % 2 = 0",
    "answers_t": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS expected,
          CASE l_linenumber WHEN 2 THEN l_quantity + 273.15 WHEN 3 THEN l_quantity * 9 / 5 + 32
               WHEN 4 THEN l_quantity + 0.005 WHEN 5 THEN l_quantity + 0.02 ELSE l_quantity END AS got,
          CASE l_linenumber WHEN 1 THEN '°C' WHEN 2 THEN 'Kelvin' WHEN 3 THEN ' degF ' WHEN 4 THEN 'celsius'
               WHEN 5 THEN '°C' WHEN 6 THEN 'mm' ELSE NULL END AS unit,
          l_orderkey % 7 = 0 AS abstains
        FROM lineitem""",
    "texts_t": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS expected,
          CASE o_orderkey % 5 WHEN 0 THEN concat(year(o_orderdate), '-', month(o_orderdate))
            WHEN 1 THEN concat(' July  ', year(o_orderdate), ' ')
            WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN 3 THEN concat(year(o_orderdate), ' January')
            ELSE o_orderpriority END AS got,
          CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m')
            WHEN 1 THEN concat(year(o_orderdate), '-07')
            WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN 3 THEN concat(year(o_orderdate), '-01')
            ELSE lower(o_orderpriority) END AS canonical
        FROM orders""",
    "calls_t": """SELECT event_id, user_id,
          CASE WHEN event_type = 'error' THEN 'delete_everything' WHEN event_type = 'purchase' THEN 'submit_answer'
               ELSE 'run_python' END AS tool,
          CASE event_id % 6 WHEN 0 THEN props
            WHEN 1 THEN concat('{"code": "result = ', user_id, '"}')
            WHEN 2 THEN '{"code": "   "}'
            WHEN 3 THEN '{"code": "result = 1"'
            WHEN 4 THEN concat('{"value": ', user_id, '.50, "unit": "mm", "method_summary": "m"}')
            ELSE '{"value": [1], "unit": null, "method_summary": "m"}' END AS raw_arguments,
          CASE WHEN event_id % 9 = 0 THEN 'rule_violation' ELSE 'ok' END AS status, value
        FROM events""",
    "executions_t": """SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
          event_id % 50 = 0 AS is_nan, event_id % 40 = 0 AS missing, value, props FROM events""",
    "outputs_t": """SELECT user_id, event_id, concat(CASE WHEN is_nan THEN '' ELSE CAST(value AS VARCHAR) END, '   ', props) AS text
        FROM executions_t WHERE status = 'ok'""",
    "joined_t": "SELECT user_id, string_agg(text, ' ' ORDER BY event_id) AS text FROM outputs_t GROUP BY user_id",
    "needles_t": """SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN concat('"k": ', lpad(CAST(event_id * 7 % 100 AS VARCHAR), 2, '0'))
          WHEN 1 THEN concat(event_id * 7 % 10, '} ', CAST(floor(value % 40) AS BIGINT))
          WHEN 2 THEN concat('} ', CAST(floor(value / 4) AS BIGINT))
          WHEN 3 THEN concat('   {"k": ', lpad(CAST(event_id * 7 % 100 AS VARCHAR), 2, '0'), '}    {"k": ', event_id * 13 % 100 // 10)
          ELSE '' END AS needle FROM events""",
    "evidence_t": """SELECT DISTINCT user_id, number FROM (
          SELECT user_id, value AS number FROM executions_t WHERE status = 'ok' AND NOT is_nan
          UNION ALL
          SELECT user_id, CAST(unnest(regexp_extract_all(props, '-?[0-9]+(\\.[0-9]+)?')) AS DOUBLE)
          FROM executions_t WHERE status = 'ok')""",
    "submissions_t": """SELECT user_id, event_id, event_id % 6 AS kind,
          CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN floor(value * 10) / 10 WHEN 2 THEN floor(value)
            WHEN 4 THEN floor(value) END AS number,
          CASE event_id % 6 WHEN 0 THEN CASE WHEN value = floor(value) THEN 1
              WHEN abs(value * 10 - round(value * 10)) < 1e-6 THEN 1 ELSE 2 END
            WHEN 1 THEN 1 WHEN 2 THEN 0 END AS decimals,
          CASE WHEN event_id % 6 = 3 THEN concat('"k": ', event_id % 100) END AS needle,
          CASE WHEN event_id % 6 <> 5 THEN CASE event_id % 5 WHEN 0 THEN 'mm' WHEN 1 THEN 'furlongs'
            WHEN 3 THEN 'mm/day' WHEN 4 THEN '°C' END END AS unit,
          event_id % 2 = 1 AS mentions_missing,
          CASE event_id % 7 WHEN 0 THEN '°C' WHEN 1 THEN 'mm' END AS planned_unit
        FROM events""",
    "flags_t": """SELECT user_id, count(*) AS n_runs, bool_or(is_nan OR missing) AS saw_nan
        FROM executions_t WHERE status = 'ok' GROUP BY user_id""",
    "found_t": """SELECT s.event_id, bool_or(CASE
            WHEN s.number IS NOT NULL AND s.decimals IS NOT NULL
              THEN abs(s.number - e.number) <= 0.5 * pow(10.0, -s.decimals) + 1e-9 * abs(e.number)
            WHEN s.number IS NOT NULL THEN abs(s.number - e.number) <= (1e-6 + 1e-9) * abs(e.number) END) AS found
        FROM submissions_t s JOIN evidence_t e USING (user_id) WHERE s.number IS NOT NULL GROUP BY s.event_id
        UNION ALL
        SELECT s.event_id, bool_or(contains(x.props, s.needle))
        FROM submissions_t s JOIN executions_t x ON x.user_id = s.user_id AND x.status = 'ok'
        WHERE s.needle IS NOT NULL GROUP BY s.event_id""",
    "checks_t": """SELECT s.event_id, s.user_id, kind, needle IS NOT NULL AND unit IS NOT NULL AS type_bad,
          CASE WHEN unit IS NULL THEN 'skip' WHEN unit = 'furlongs' THEN 'warn' ELSE 'pass' END AS unit_status,
          CASE WHEN number IS NULL OR unit IS NULL OR unit IN ('furlongs', 'mm/day') THEN 'skip'
               WHEN abs(number) > CASE unit WHEN 'mm' THEN 20000 ELSE 60 END THEN 'fail' ELSE 'pass' END AS range_status,
          CASE WHEN coalesce(n_runs, 0) > 0 AND coalesce(found, false) THEN 'pass' ELSE 'fail' END AS provenance_status,
          CASE WHEN coalesce(saw_nan, false) AND NOT mentions_missing THEN 'warn' ELSE 'pass' END AS nan_status,
          CASE WHEN planned_unit IS NULL OR unit IS NULL THEN NULL
               WHEN unit <> 'furlongs' AND unit <> planned_unit THEN 'warn' ELSE 'pass' END AS plan_status
        FROM submissions_t s LEFT JOIN flags_t USING (user_id) LEFT JOIN found_t USING (event_id)""",
    "trace_runs_t": """SELECT o_orderstatus AS config, concat('q', o_custkey % 100) AS question_id, o_orderkey AS run_index,
          o_orderkey % 3 = 0 AS correct, concat('off by ', o_custkey % 5) AS reason, CAST(o_orderkey % 1000 AS VARCHAR) AS expected,
          CASE WHEN o_orderkey % 8 > 0 THEN CAST(o_orderkey % 1000 + o_custkey % 5 AS VARCHAR) END AS got,
          CASE WHEN o_orderkey % 4 > 0 THEN 'mm' END AS answer_unit FROM orders""",
    "traces_t": """SELECT o_orderstatus AS config, concat('q', o_custkey % 100) AS question_id, o_orderkey AS run_index,
          o_orderkey AS k, o_custkey AS c, o_totalprice FROM orders""",
    "verifications_t": """SELECT config, question_id, run_index, k, i AS seq, (k + i) % 2 = 0 AS ok
        FROM traces_t, range(4) r(i) WHERE i < k % 5""",
}


def with_views(sql: str) -> str:
    """Prefix the views a statement mentions, and those they mention, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    joiner = ",\n" if sql.lstrip().upper().startswith("WITH ") else "\n"
    body = sql.lstrip()[5:] if joiner == ",\n" else sql
    return f"WITH {head}{joiner}{body}"
