"""Run rows, traces and summaries on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RUN_KEY, RUNS_STORED, TRACE


# JSON lines repeat the names of their fields in every row, so they are stored compressed.  A compressed file is
# read by one task: it holds about as many rows as a task reads of plain text.
ROWS_A_FILE = 100_000
LINES = {"compression": "gzip", "maxRecordsPerFile": str(ROWS_A_FILE)}


def _is_number(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"), F.lit(False))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Stored run rows, one JSON document per line; a missing path is an empty table.

    ``expected``, ``got`` and ``raw_value`` are a number or a text: each becomes a text column plus
    ``*_is_number``.  ``answer_value`` is the recorded answer, or what was graded in older rows.
    """
    try:
        raw = spark.read.schema(RUNS_STORED).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], RUNS_STORED)
    return with_answer_columns(raw)


def with_answer_columns(raw: DataFrame) -> DataFrame:
    def present(name: str) -> Column:
        v = F.col(name)
        return F.when(v.isNotNull() & (F.schema_of_variant(v) != "VOID"), v)

    answer = F.coalesce(present("raw_value"), present("got"))
    return (
        raw.withColumn("answer_value", answer.cast("string"))
        .withColumn("answer_is_number", _is_number(answer))
        .withColumn("expected_is_number", _is_number(present("expected")))
        .withColumn("expected", present("expected").cast("string"))
        .withColumn("got", present("got").cast("string"))
        .drop("raw_value")
    )


def append_runs(runs: DataFrame, path: str) -> None:
    """Append finished runs; each task adds its own file, so no lock is needed."""
    runs.write.mode("append").options(**LINES).json(path)


def write_regraded(runs: DataFrame, path: str) -> None:
    """Write regraded rows to a new place; the original is never touched."""
    runs.write.mode("errorifexists").options(**LINES).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON document per configuration."""
    summary.write.mode("overwrite").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Stored traces with their run key; a missing path is an empty table.

    Two layouts: ``<config>/<question>_<run>.json`` with one document per file, whose key is the
    path, read with ``read_trace_files``; and keyed JSON lines, which is what ``write_traces`` makes
    and what scales, since a file per run is a burden for any storage.
    """
    keys = [("config", T.StringType()), ("question_id", T.StringType()), ("run_index", T.LongType())]
    keyed = T.StructType([T.StructField(n, t) for n, t in keys] + TRACE.fields)
    try:
        return spark.read.schema(keyed).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], keyed)


# The key of a trace in its path: <config>/<question>_<run>.json, or the folders of a partitioned writer.
_TRACE_PATH = r"(?:config=)?([^/]+)/(?:(?:trace=)?([^/]+)_(\d+)(?:/[^/]*)?\.json)$"


def _trace_files(spark: SparkSession, path: str, folders: Sequence[str]) -> DataFrame:
    places = [f"{path}/{f}" for f in folders] or [path]
    docs = spark.read.schema(TRACE).option("multiLine", True).option("recursiveFileLookup", True).json(places)
    file = F.col("_metadata.file_path")
    key = [F.regexp_extract(file, _TRACE_PATH, i) for i in (1, 2, 3)]
    return docs.select(
        file.alias("file"), key[0].alias("config"), key[1].alias("question_id"), key[2].try_cast("long").alias("run_index"), "*"
    )


def split_trace_files(spark: SparkSession, path: str, folders: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(traces, rejects) of ``read_trace_files`` and ``trace_file_rejects``, from one listing of the folders."""
    files = _trace_files(spark, path, folders)
    keyed = F.col("run_index").isNotNull()
    return files.where(keyed).drop("file"), files.where(~keyed).select("file").distinct()


def read_trace_files(spark: SparkSession, path: str, folders: Sequence[str] = ()) -> DataFrame:
    """Traces stored as one document per file; the key comes from the path.

    With ``folders`` only these folders of ``path`` are listed and read.  Files whose name tells no key are
    left out; ``trace_file_rejects`` names them.
    """
    return split_trace_files(spark, path, folders)[0]


def trace_file_rejects(spark: SparkSession, path: str, folders: Sequence[str] = ()) -> DataFrame:
    """(file): the files below ``path`` whose name is no key of a trace."""
    return split_trace_files(spark, path, folders)[1]


def write_trace_files(traces: DataFrame, path: str) -> None:
    """Every trace in a file of its own, in folders named by its key.  For a small number of traces.

    Making a file takes a task some ten milliseconds, however small the trace is.  So the keys are dealt over four
    tasks a core whatever the layout of ``traces``, whose size in bytes would put them all into one.
    """
    name = F.concat_ws("_", "question_id", F.col("run_index").cast("string"))
    body = [c for c in traces.columns if c not in RUN_KEY]
    rows = traces.select("config", name.alias("trace"), *body)
    dealt = rows.repartition(4 * traces.sparkSession.sparkContext.defaultParallelism, "config", "trace")
    dealt.write.mode("append").partitionBy("config", "trace").json(path)


def write_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").options(**LINES).json(path)


def union_done_and_new(done: DataFrame, new: DataFrame) -> DataFrame:
    return done.unionByName(new)
