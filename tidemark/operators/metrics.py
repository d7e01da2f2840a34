"""Metrics of evaluation runs: pass@k, consistency, spread, counters, breakdowns, summaries.

Every group-by combines on the map side, so a configuration or question with most of the rows is
reduced where it is read.  File order, which breaks ties, is carried in explicit order columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import exact_medians, exact_quantiles, medians_by_name, named_values

KS = (1, 5, 10)


def pass_at_k(n: Column, correct: Column, k: int) -> Column:
    """Chance that at least one of k runs drawn from n is correct.

    The product form of 1 - C(n-c, k) / C(n, k) over k factors: no factorials.  Asking for more runs
    than there are is an error.
    """
    miss = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda acc, i: acc * ((n - correct - i).cast("double") / (n - i).cast("double")),
    )
    return (
        F.when(F.lit(k) > n, F.raise_error(F.lit(f"k={k} is larger than the number of runs")).cast("double"))
        .when(n - correct < k, F.lit(1.0))
        .otherwise(1.0 - miss)
    )


def per_question(runs: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    return runs.groupBy(*keys, "question_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("correct").alias("correct")
    )


def pass_at_k_by_question(runs: DataFrame, ks: Sequence[int] = KS, keys: Sequence[str] = ("config",)) -> DataFrame:
    """pass@k of each question with at least k runs, NULL otherwise."""
    base = per_question(runs, keys)
    return base.select(
        "*",
        *[F.when(F.col("runs") >= k, pass_at_k(F.col("runs"), F.col("correct"), k)).alias(f"pass@{k}") for k in ks],
    )


def breakdown_by_field(runs: DataFrame, fields: Sequence[str] = ("category", "difficulty"), keys: Sequence[str] = ("config",)) -> DataFrame:
    """Runs, distinct questions and share correct by each field, all fields in one pass.

    First the rows are reduced per question, so the distinct count is a plain count afterwards.
    """
    filled = runs.select(
        *keys, "question_id", "correct", *[F.coalesce(F.col(f), F.lit("?")).alias(f) for f in fields]
    )
    reduced = filled.groupBy(*keys, "question_id", *fields).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c")
    )
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    long = reduced.select(*keys, "question_id", "n", "c", F.inline(cells))
    by_question = long.groupBy(*keys, "field", "value", "question_id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return by_question.groupBy(*keys, "field", "value").agg(
        F.sum("n").alias("runs"),
        F.count(F.lit(1)).alias("questions"),
        (F.sum("c") / F.sum("n")).alias("pass_rate"),
    )


def breakdown_pivot(runs: DataFrame, field: str, configs: Sequence[str]) -> DataFrame:
    """Share correct as a field x configuration matrix; NULL where there are no runs."""
    filled = runs.select("config", F.coalesce(F.col(field), F.lit("?")).alias(field), F.col("correct").cast("int").alias("hit"))
    return filled.groupBy(field).pivot("config", list(configs)).agg(F.avg("hit"))


def agreement(runs: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Per question: share of its runs that give its most common answer; no row without any answer."""
    counted = runs.groupBy(*keys, "question_id", "answer_key").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy(*keys, "question_id").agg(
        F.max(F.when(F.col("answer_key").isNotNull(), F.col("n"))).alias("modal"), F.sum("n").alias("runs")
    )
    return per.where(F.col("modal").isNotNull()).withColumn("share", F.col("modal") / F.col("runs"))


def consistency(runs: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    return agreement(runs, keys).groupBy(*keys).agg(F.avg("share").alias("consistency"))


def answer_spread(runs: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Median over questions of the sample standard deviation of their numeric answers."""
    spread = (
        runs.where(F.col("got_number").isNotNull())
        .groupBy(*keys, "question_id")
        .agg(F.stddev_samp("got_number").alias("sd"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= 2)
    )
    return exact_quantiles(spread, keys, "sd", [0.5]).select(*keys, F.col("`q0.5`").alias("answer_spread_median"))


def _counter(name: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(name), F.lit(key)), F.lit(0))


def _total(name: str) -> Column:
    values = F.coalesce(F.map_values(name), F.array().cast("array<bigint>"))
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def rate(hits: Column, total: Column) -> Column:
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


def tool_status_rates(runs: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Validation failures per tool call; 0 when there are no calls."""
    kinds = ("schema_violation", "rule_violation", "invalid_json")
    sums = runs.groupBy(*keys).agg(
        F.sum(_total("tool_status_counts")).alias("tool_calls"),
        *[F.sum(_counter("tool_status_counts", k)).alias(k) for k in kinds],
    )
    return sums.select(
        *keys,
        "tool_calls",
        *[rate(F.col(k), F.col("tool_calls")).alias(f"tool_{k}_rate") for k in kinds],
    )


def map_counter_totals(runs: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """(keys.., counter, kind, n): stop reasons, plan states, violations and limits in one pass."""
    return runs.select(*keys, F.inline(counter_cells())).groupBy(*keys, "counter", "kind").agg(F.sum("n").alias("n"))


def counter_cells() -> Column:
    """All counters of a run as an array of (counter, kind, n)."""

    def single(counter: str, kind: Column) -> Column:
        return F.transform(
            F.array_compact(F.array(kind)),
            lambda k: F.struct(F.lit(counter).alias("counter"), k.alias("kind"), F.lit(1).cast("long").alias("n")),
        )

    def entries(counter: str) -> Column:
        return F.transform(
            F.coalesce(F.map_entries(counter), F.expr("array()").cast("array<struct<key:string,value:bigint>>")),
            lambda e: F.struct(F.lit(counter).alias("counter"), e["key"].alias("kind"), e["value"].alias("n")),
        )

    stop = F.coalesce(F.when(F.col("stop_reason") != "", F.col("stop_reason")), F.lit("none"))
    plan = F.when(F.col("plan_status") != "", F.col("plan_status"))
    return F.concat(
        single("stop_reasons", stop), single("plan_status", plan), entries("sandbox_violations"), entries("sandbox_limits")
    )


def sandbox_events(runs: DataFrame) -> DataFrame:
    """Violations and limits of all runs merged by name."""
    both = map_counter_totals(runs, []).where(F.col("counter").isin("sandbox_violations", "sandbox_limits"))
    return both.groupBy(F.col("kind").alias("event")).agg(F.sum("n").alias("count")).orderBy("event")


def _rejections(was_correct: bool) -> Column:
    known = F.coalesce(F.col("rejected_answers"), F.expr("array()").cast("array<struct<value:string,unit:string,was_correct:boolean,failed_checks:array<string>>>"))
    return F.size(F.filter(known, lambda r: r["was_correct"] == F.lit(was_correct)))


def verifier_catches(runs: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Rejected answers that were wrong (good catches) and right (false rejections)."""
    return runs.groupBy(*keys).agg(
        F.coalesce(F.sum(_rejections(False)), F.lit(0)).alias("verifier_correct_catches"),
        F.coalesce(F.sum(_rejections(True)), F.lit(0)).alias("verifier_false_rejections"),
    )


MEDIANS = {"total_s": "median_latency_s", "input_tokens": "median_input_tokens", "output_tokens": "median_output_tokens"}


def latency_token_medians(runs: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    medians = exact_medians(runs, keys, list(MEDIANS)).withColumnsRenamed(MEDIANS)
    totals = runs.groupBy(*keys).agg(
        F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens")
    )
    return medians.join(totals, list(keys))


COUNTERS = ("stop_reasons", "plan_status", "sandbox_violations", "sandbox_limits")


def summarize_runs(
    runs: DataFrame, ks: Sequence[int] = KS, keys: Sequence[str] = ("config",), with_maps: bool = True
) -> DataFrame:
    """All metrics, one row per configuration.

    ``pass@1`` is the mean over questions; the share over runs is ``pass_rate``.  pass@k is NULL when
    some question has fewer than k runs.  ``with_maps`` needs the counter columns of the runs.

    Two passes over the runs.  The first one is grouped by question and answer, then by question: everything
    that adds up, the spread of the numbers and the most common answer come from it.  The second one counts
    values of the columns of which medians are wanted and entries of the counters, as rows of one table; the
    spreads of the questions join it, so all medians are looked up together.
    """
    # One key that is never NULL: a join on it puts no filter below one side only, which would read the runs again.
    runs = runs.withColumn("_k", F.struct(*keys))
    kinds = ("schema_violation", "rule_violation", "invalid_json")
    # All sums of a row in one value: both uses of the base keep the same columns, so it is computed once.
    numbers = F.count("got_number")
    sums = F.array(F.struct(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("c"),
        F.sum(_total("tool_status_counts")).alias("calls"),
        *[F.sum(_counter("tool_status_counts", k)).alias(k) for k in kinds],
        F.sum(_rejections(False)).alias("catches"),
        F.sum(_rejections(True)).alias("false_rejections"),
        F.sum("input_tokens").alias("tin"),
        F.sum("output_tokens").alias("tout"),
        numbers.alias("numbers"),
        F.coalesce(F.avg("got_number"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("got_number") * numbers, F.lit(0.0)).alias("squares"),
    ))
    base = runs.groupBy("_k", "question_id", "answer_key").agg(sums.alias("sums"))
    held = F.element_at("sums", 1)
    # The squares of a question's numbers about their mean, from those of its answers.
    question = Window.partitionBy("_k", "question_id")
    mean = F.sum(held["mean"] * held["numbers"]).over(question) / F.greatest(F.sum(held["numbers"]).over(question), F.lit(1))
    away = held["squares"] + held["numbers"] * F.pow(held["mean"] - F.col("_mean"), F.lit(2.0))
    carried = ("n", "c", "calls", *kinds, "catches", "false_rejections", "tin", "tout", "numbers")
    questions = base.withColumn("_mean", mean).groupBy("_k", "question_id").agg(
        *[F.sum(held[c]).alias(c) for c in carried],
        F.sum(away).alias("squares"),
        F.max(F.when(F.col("answer_key").isNotNull(), held["n"])).alias("modal"),
    )
    questions = questions.withColumn("sd", F.when(F.col("numbers") >= 2, F.sqrt(F.col("squares") / (F.col("numbers") - 1))))
    enough = {k: F.when(F.col("n") >= k, pass_at_k(F.col("n"), F.col("c"), k)) for k in ks}
    out = questions.groupBy("_k").agg(
        F.sum("n").alias("runs"),
        F.count(F.lit(1)).alias("questions"),
        F.min("n").alias("runs_per_question_min"),
        (F.sum("c") / F.sum("n")).alias("pass_rate"),
        *[F.when(F.min("n") >= k, F.avg(e)).alias(f"pass@{k}") for k, e in enough.items()],
        F.avg(F.col("modal") / F.col("n")).alias("consistency"),
        F.sum("calls").alias("tool_calls"),
        *[rate(F.sum(k), F.sum("calls")).alias(f"tool_{k}_rate") for k in kinds],
        F.sum("catches").alias("verifier_correct_catches"),
        F.sum("false_rejections").alias("verifier_false_rejections"),
        F.sum("tin").alias("total_input_tokens"),
        F.sum("tout").alias("total_output_tokens"),
    )
    none = F.lit(None).cast("string")
    cells = F.transform(F.array(*named_values(list(MEDIANS))), lambda m: F.struct(m["name"].alias("name"), none.alias("kind"), F.nanvl(m["value"], F.lit(None)).alias("value"), F.lit(1).cast("long").alias("n")))
    if with_maps:
        entries = F.transform(counter_cells(), lambda e: F.struct(e["counter"].alias("name"), e["kind"].alias("kind"), F.lit(None).cast("double").alias("value"), e["n"].alias("n")))
        cells = F.concat(cells, entries)
    spread = questions.select("_k", F.lit("answer_spread_median").alias("name"), none.alias("kind"), F.col("sd").alias("value"), F.lit(1).cast("long").alias("n"))
    long = runs.select("_k", F.inline(cells)).unionByName(spread)
    # Told apart by what was counted, not by a filter on the rows, which would make two scans of one.
    counted = long.groupBy("_k", "name", "kind", "value").agg(F.sum("n").alias("n"), F.count("value").alias("valued"))
    names = [*MEDIANS, "answer_spread_median"]
    medians = medians_by_name(counted.where(F.col("valued") > 0), ["_k"], names).withColumnsRenamed(MEDIANS)
    out = out.join(medians, "_k", "left")
    if with_maps:
        # The kinds of a counter are the states of an enumeration, so the maps stay small.
        pairs = {c: F.collect_list(F.when(F.col("name") == c, F.struct("kind", "n"))) for c in COUNTERS}
        maps = [F.map_from_entries(F.array_sort(p)).alias(c) for c, p in pairs.items()]
        out = out.join(counted.where(F.col("valued") == 0).groupBy("_k").agg(*maps), "_k", "left")
        empty = F.create_map().cast("map<string,bigint>")
        out = out.withColumns({c: F.coalesce(F.col(c), empty) for c in COUNTERS})
    return out.select("_k.*", *[F.col(f"`{c}`") for c in out.columns if c != "_k"])


def hardest_questions(runs: DataFrame, order: Sequence[str], limit: int = 10) -> DataFrame:
    """Questions with the lowest share correct, with the most common reason of failure.

    ``order`` is the file order: it decides which category is shown and which of two equally common
    reasons came first.
    """
    position = F.struct(*order)
    by_reason = runs.groupBy("question_id", F.when(~F.col("correct"), F.col("reason")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("c"),
        F.min_by(F.struct("category", "difficulty"), position).alias("about"),
        F.min(position).alias("first"),
    )
    failed = F.col("reason").isNotNull()
    rows = by_reason.groupBy("question_id").agg(
        F.min_by("about", "first").alias("about"),
        F.sum("n").alias("runs"),
        (F.sum("c") / F.sum("n")).alias("pass_rate"),
        F.min_by(F.when(failed, F.col("reason")), F.when(failed, F.struct(-F.col("n"), F.col("first")))).alias("top_reason"),
    )
    return (
        rows.select(
            "question_id", F.col("about.category").alias("category"), F.col("about.difficulty").alias("difficulty"),
            "pass_rate", "runs", "top_reason",
        )
        .orderBy("pass_rate", "question_id")
        .limit(limit)
    )


# ------------------------------------------------------------------------------- tasks
# Configuration -> (plans first, verifies answers); expected tokens (in, out) of a run.
CONFIGS = {"loop": (False, False), "planner": (True, False), "verifier": (False, True), "full": (True, True)}
TOKENS = {True: (5000, 3800), False: (3200, 900)}


def build_tasks(questions: DataFrame, runs: int, configs: Sequence[str] = tuple(CONFIGS)) -> DataFrame:
    """(config, question_id, run_index, plans, verifies): every combination, generated per question."""
    flags = F.array(
        *[
            F.struct(F.lit(c).alias("config"), F.lit(CONFIGS[c][0]).alias("plans"), F.lit(CONFIGS[c][1]).alias("verifies"))
            for c in configs
        ]
    )
    spread = questions.select("question_id", F.inline(flags))
    return spread.withColumn("run_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))


def resume_todo(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks that have no finished run."""
    return tasks.join(done.select("config", "question_id", "run_index").distinct(), ["config", "question_id", "run_index"], "left_anti")


def estimate_cost(tasks: DataFrame, price_in: float = 0.05, price_out: float = 0.40) -> DataFrame:
    """Expected cost per configuration, in currency per million tokens."""
    tokens = lambda i: F.when(F.col("plans"), TOKENS[True][i]).otherwise(TOKENS[False][i]).cast("long")
    return tasks.groupBy("config").agg(
        F.count(F.lit(1)).alias("tasks"),
        (F.sum(tokens(0)) / 1e6 * price_in + F.sum(tokens(1)) / 1e6 * price_out).alias("cost"),
    )


def select_questions(questions: DataFrame, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The wanted questions in catalogue order; the first ``limit`` of them if given."""
    chosen = questions if ids is None else questions.join(ids.distinct(), "question_id", "left_semi")
    return chosen if limit is None else chosen.orderBy("pos", "question_id").limit(limit)


def unknown_ids(questions: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.distinct().join(questions, "question_id", "left_anti")


def distinct_configs(runs: DataFrame) -> DataFrame:
    return runs.select("config").distinct().orderBy("config")
