"""Failure analysis: categories, ranked questions, recorded code, detail tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import categorize_reason, strip
from ..schemas import RUN_KEY
from . import metrics as M
from .ordered import first_per_group


def failed(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("correct"))


def failure_rate(runs: DataFrame) -> DataFrame:
    """Failed and all runs, and their ratio as a percentage text with one decimal."""
    sums = runs.agg(F.count_if(~F.col("correct")).alias("failed"), F.count(F.lit(1)).alias("runs"))
    share = F.when(F.col("runs") > 0, F.col("failed") / F.col("runs") * 100)
    return sums.withColumn("failure_rate", F.concat(F.format_string("%.1f", share), F.lit("%")))


def failure_categories_ranked(runs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Failures by category, most frequent first; ties in order of first appearance."""
    return (
        failed(runs)
        .groupBy(categorize_reason(F.col("reason")).alias("category"))
        .agg(F.count(F.lit(1)).alias("failed"), F.min(F.struct(*order)).alias("_first"))
        .orderBy(F.desc("failed"), F.asc("_first"))
        .drop("_first")
    )


def failed_questions_ranked(runs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Questions by number of failed runs, most first; ties in order of first appearance."""
    return (
        failed(runs)
        .groupBy("question_id")
        .agg(F.count(F.lit(1)).alias("failed"), F.min(F.struct(*order)).alias("_first"))
        .orderBy(F.desc("failed"), F.asc("_first"))
        .drop("_first")
    )


def failed_runs_top(runs: DataFrame, order: Sequence[str], limit: int = 2) -> DataFrame:
    """The first failed runs of each question in file order."""
    return first_per_group(failed(runs), ["question_id"], [F.col(c) for c in order], limit)


def call_code(tool: Column, raw: Column) -> Column:
    """Code of a recorded run_python call; unparsable arguments as they are; NULL if empty."""
    text = F.coalesce(raw, F.lit(""))
    doc = F.try_parse_json(F.when(text == "", F.lit("{}")).otherwise(text))
    code = F.when(doc.isNull(), text).otherwise(F.coalesce(F.try_variant_get(doc, "$.code", "string"), F.lit("")))
    return F.when((tool == "run_python") & (code != ""), code)


def extract_code(calls: DataFrame, tool: str = "tool", raw: str = "raw_arguments") -> DataFrame:
    """Calls that ran code, with the code."""
    coded = calls.withColumn("code", call_code(F.col(tool), F.col(raw)))
    return coded.where(F.col("code").isNotNull())


def filter_tool_calls(calls: DataFrame) -> DataFrame:
    """Successful run_python records."""
    return calls.where((F.col("tool") == "run_python") & (F.col("status") == "ok"))


def last_code_blocks(calls: DataFrame, run: Sequence[str], position: str, limit: int = 2) -> DataFrame:
    """The last code blocks of each run with their rank from the end."""
    return first_per_group(extract_code(calls), run, [F.desc(position)], limit)


def trace_calls(traces: DataFrame) -> DataFrame:
    """One row per recorded call of a trace, with its position."""
    return traces.select(*RUN_KEY, F.posexplode("tool_calls").alias("seq", "call")).select(
        *RUN_KEY, "seq", "call.tool", "call.status", "call.raw_arguments"
    )


def trace_rejections(traces: DataFrame) -> DataFrame:
    """One row per rejected verification of a trace, with the failed checks."""
    rows = traces.select(*RUN_KEY, F.posexplode("verifications").alias("seq", "v")).where(~F.col("v.ok"))
    names = F.transform(F.filter("v.verdict.checks", lambda c: c["status"] == "fail"), lambda c: c["name"])
    return rows.select(
        *RUN_KEY, "seq", F.col("v.answer.value").cast("string").alias("value"), F.array_join(names, ", ").alias("failed_checks")
    )


def last_codes_of_trace(limit: int = 2) -> Column:
    """The last code blocks of a trace row as ARRAY<STRING>; a trace is one bounded document."""
    codes = F.filter(
        F.transform("tool_calls", lambda c: call_code(c["tool"], c["raw_arguments"])), lambda c: c.isNotNull()
    )
    codes = F.coalesce(codes, F.array().cast("array<string>"))
    return F.slice(codes, F.greatest(F.size(codes) - (limit - 1), F.lit(1)), limit)


def runs_join_traces(runs: DataFrame, traces: DataFrame) -> DataFrame:
    """Each run with its trace, if one was stored."""
    keyed = traces.select(*RUN_KEY, F.struct(*[c for c in traces.columns if c not in RUN_KEY]).alias("trace"))
    return runs.join(keyed, RUN_KEY, "left")


def failures_table(runs: DataFrame, questions: DataFrame, traces: DataFrame, order: Sequence[str], limit: int = 2) -> DataFrame:
    """Detail of the first failed runs per question: question, traps, plan, last code, rejected answers.

    The columns of the run (expected, got, unit, reason) are kept.  Traces are first reduced to those of the
    listed runs, then looked into: no code is parsed of any other, and only they meet the list.
    """
    listed = failed_runs_top(runs, order, limit)
    about = questions.select("question_id", F.col("text").alias("question_text"), F.array_join("traps", ", ").alias("intended_trap"))
    of_listed = traces.join(listed.select(*RUN_KEY).distinct(), RUN_KEY, "left_semi")
    failed_checks = lambda v: F.filter(v["verdict"]["checks"], lambda c: c["status"] == "fail")
    detail = of_listed.select(
        *RUN_KEY,
        F.col("plan.interpretation").alias("plan_interpretation"),
        F.transform(last_codes_of_trace(), strip).alias("last_codes"),
        F.transform(
            F.filter("verifications", lambda v: ~v["ok"]),
            lambda v: F.struct(
                v["answer"]["value"].cast("string").alias("value"),
                F.array_join(F.transform(failed_checks(v), lambda c: c["name"]), ", ").alias("failed_checks"),
            ),
        ).alias("rejected"),
    )
    return listed.join(about, "question_id", "left").join(detail, RUN_KEY, "left")


def tokens_per_run(traces: DataFrame) -> DataFrame:
    """Tokens of each run by purpose of the model call."""
    calls = traces.select(*RUN_KEY, F.inline("llm_calls"))
    return calls.groupBy(*RUN_KEY, "purpose").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def _count_values(values: Column) -> Column:
    """MAP<value, how often> of a small array inside one document."""
    names = F.array_sort(F.array_distinct(values))
    counts = F.transform(names, lambda n: F.size(F.filter(values, lambda x: x == n)).cast("long"))
    return F.map_from_arrays(names, counts)


def run_row_from_trace(traces: DataFrame) -> DataFrame:
    """Flatten trace documents into run rows without a shuffle."""
    empty = F.array().cast("array<string>")
    calls = "tool_calls"
    statuses = F.coalesce(F.transform(calls, lambda c: c["status"]), empty)
    kinds = F.flatten(
        F.transform(calls, lambda c: F.coalesce(F.transform(c["sandbox"]["violations"], lambda v: v["kind"]), empty))
    )
    limits = F.flatten(F.transform(calls, lambda c: F.coalesce(c["sandbox"]["limits_hit"], empty)))
    rejected = F.transform(
        F.filter("verifications", lambda v: ~v["ok"]),
        lambda v: F.struct(
            v["answer"]["value"].cast("string").alias("value"),
            v["answer"]["unit"].alias("unit"),
            F.transform(
                F.filter(v["verdict"]["checks"], lambda c: c["status"] == "fail"), lambda c: c["name"]
            ).alias("failed_checks"),
        ),
    )

    def tokens(name: str) -> Column:
        return F.aggregate("llm_calls", F.lit(0).cast("long"), lambda acc, c: acc + c[name])

    return traces.select(
        *RUN_KEY,
        F.col("answer.value").cast("string").alias("raw_value"),
        F.col("answer.unit").alias("answer_unit"),
        "stop_reason",
        "plan_status",
        "turns",
        _count_values(statuses).alias("tool_status_counts"),
        _count_values(F.coalesce(kinds, empty)).alias("sandbox_violations"),
        _count_values(F.coalesce(limits, empty)).alias("sandbox_limits"),
        rejected.alias("rejected_answers"),
        tokens("input_tokens").alias("input_tokens"),
        tokens("output_tokens").alias("output_tokens"),
        "total_s",
        "model",
        "error",
    )


def results_table(runs: DataFrame) -> DataFrame:
    """The summary as reported: three decimals, medians rounded, a dash where undefined."""
    s = M.summarize_runs(runs, with_maps=False)

    def known(c: str, digits: int) -> Column:
        cell = F.col(f"`{c}`")
        return F.when(cell.isNotNull(), F.format_string(f"%.{digits}f", cell)).otherwise("-")

    return s.select(
        "config",
        "runs",
        "questions",
        *[known(f"pass@{k}", 3).alias(f"pass_{k}") for k in M.KS],
        known("consistency", 3).alias("consistency"),
        known("median_latency_s", 1).alias("median_s"),
        F.concat_ws(" / ", known("median_input_tokens", 0), known("median_output_tokens", 0)).alias("tokens_in_out"),
    ).orderBy("config")


def question_listing(questions: DataFrame, width: int = 70) -> DataFrame:
    return questions.select(
        "question_id", "category", "difficulty", F.coalesce("unit", F.lit("-")).alias("unit"),
        F.substring("text", 1, width).alias("text"),
    )


def question_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("category").agg(F.count(F.lit(1)).alias("questions"))
