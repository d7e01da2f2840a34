"""Incremental ingest: run rows arrive as files, finished keys are skipped, metrics are recomputed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RUN_KEY

BUCKETS = 16  # folders of each arrival: more for tables that arrive in large batches
LAYOUT = "arrival string, bucket int"  # the folders of the stored table


def key_bucket(buckets: int = BUCKETS) -> Column:
    """Of the run key, whatever the types of its columns."""
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in RUN_KEY]), F.lit(buckets)).cast("int")


def stream_new_runs(
    spark: SparkSession, source: str, table: str, checkpoint: str, schema: T.StructType, buckets: int = BUCKETS
) -> None:
    """Append every run whose key is not stored yet, then stop (trigger available-now).

    The stored table is the state, split by a hash of the key: a batch reads the keys of the buckets its own
    keys fall into, and of no other.  (A set of keys in memory would grow without bound, as rows have no
    event time a watermark could use.)  A batch is stored under the name of the files it came from and does
    not look at that folder, so a batch that is run again replaces what it wrote by the same rows, whether
    the first attempt failed half way or not.  ``buckets`` must stay the same for the life of a table.
    """
    columns = [f.name for f in schema.fields]

    def store(batch: DataFrame, _batch_id: int) -> None:
        # Of rows with one key the first to arrive stays: the oldest file, and the first line of it.
        arrival = F.struct("_written", "_file", "_block", F.monotonically_increasing_id())
        ordered = batch.withColumn("_arrival", arrival)
        first = ordered.groupBy(*RUN_KEY).agg(F.min_by(F.struct(*columns), "_arrival").alias("_row"))
        first = first.select("_row.*").withColumn("bucket", key_bucket(buckets)).persist()
        try:
            held = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # ``buckets`` at most
            if held:
                name = batch.select("_file").distinct().agg(F.hex(F.bit_xor(F.xxhash64("_file")))).first()[0]
                done = stored_keys(batch.sparkSession, table, schema, held).where(F.col("arrival") != f"files-{name}")
                fresh = first.join(done.drop("arrival"), ["bucket", *RUN_KEY], "left_anti")
                target = f"{table}/arrival=files-{name}"
                fresh.select(*columns, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        finally:
            first.unpersist()

    query = (
        spark.readStream.schema(schema)
        .json(source)
        .select(
            "*",
            F.col("_metadata.file_modification_time").alias("_written"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _stored(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType(schema.fields + T._parse_datatype_string(LAYOUT).fields)
    try:
        return spark.read.schema(whole).parquet(table)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], whole)


def stored_keys(spark: SparkSession, table: str, schema: T.StructType, buckets: Sequence[int]) -> DataFrame:
    """(arrival, bucket, key..) of some buckets; only their files are read."""
    return _stored(spark, table, schema).where(F.col("bucket").isin(list(buckets))).select("arrival", "bucket", *RUN_KEY)


def stored_runs(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The rows of the table the stream feeds; empty before the first batch."""
    return _stored(spark, table, schema).select(*[f.name for f in schema.fields])
