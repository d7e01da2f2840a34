"""The hourly series: reading, parsing landed payloads, validated writing, manifest and its check."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import content_hash, problems_of, series_report
from ..operators.slices import TIME
from ..schemas import MANIFEST, MEASURES, SERIES, payload_schema
from ..session import fresh_path


def read_series(spark: SparkSession, path: str, schema: T.StructType = SERIES) -> DataFrame:
    """The stored series; the schema is given, filters and columns are pushed to the scan."""
    return spark.read.schema(schema).parquet(path)


def read_payloads(spark: SparkSession, path: str, variables: tuple[str, ...] = MEASURES, one_per_file: bool = False) -> DataFrame:
    """Landed documents, one per line (or one per file)."""
    return spark.read.schema(payload_schema(variables)).option("multiLine", one_per_file).json(path)


def payload_problem(variables: Sequence[str] = MEASURES) -> Column:
    """Why a document cannot be used, NULL if it can."""
    zone = F.col("timezone")
    absent = F.array_compact(
        F.array(*[F.when(F.col(f"hourly.{v}").isNull(), F.lit(v)) for v in ("time", *variables)])
    )
    lengths = F.lit(True)
    for v in variables:
        lengths = lengths & (F.size(f"hourly.{v}") == F.size("hourly.time"))
    return (
        F.when(
            zone.isNull() | ~zone.isin("GMT", "UTC"),
            F.concat(F.lit("expected timestamps in GMT/UTC, got timezone="), F.coalesce(zone, F.lit("null"))),
        )
        .when(F.size(absent) > 0, F.concat(F.lit("missing hourly fields: "), F.array_join(absent, ", ")))
        .when(~lengths, F.lit("hourly arrays differ in length"))
    )


def parse_payloads(
    payloads: DataFrame, variables: Sequence[str] = MEASURES, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(records, rejects).  Records carry ``pos``, their place in the document's arrays."""
    tagged = payloads.withColumn("problem", payload_problem(variables))
    zipped = F.arrays_zip(*[F.col(f"hourly.{v}").alias(v) for v in ("time", *variables)])
    rows = tagged.where(F.col("problem").isNull()).select(*keep, F.posexplode(zipped).alias("pos", "r"))
    records = rows.select(
        *keep,
        "pos",
        F.to_timestamp(F.col("r.time"), "yyyy-MM-dd'T'HH:mm").alias(TIME),
        *[F.col(f"r.{v}").cast("double").alias(v) for v in variables],
    )
    return records, tagged.where(F.col("problem").isNotNull())


def build_manifest(
    df: DataFrame,
    units: dict[str, str],
    first: str,
    last: str,
    freq: str = "hour",
    time: str = TIME,
    position: str | None = None,
) -> DataFrame:
    """One row that describes exactly which data was stored, from one scan of it.

    ``position`` is the place of a record in the input, for the order check; it is no measure.
    """
    measures = [c for c in df.columns if c not in (time, position)]
    report = series_report(df, first, last, freq, time, measures, position, fingerprint=True)
    named = F.create_map(*[x for m in measures for x in (F.lit(m), F.lit(units.get(m)).cast("string"))])
    return report.select(
        F.lit("UTC").alias("timezone"), named.alias("variables"), "time_range", "rows", "expected_rows",
        "nan_counts", "content_sha256", problems_of(report).alias("problems"),
    )


def write_series_validated(
    df: DataFrame,
    path: str,
    units: dict[str, str],
    first: str,
    last: str,
    freq: str = "hour",
    time: str = TIME,
    partition_by: Sequence[str] = (),
    position: str | None = None,
    request: dict[str, str] | None = None,
) -> None:
    """Validate first; raise and write nothing to ``path`` if there is a structural problem.

    The rows are computed once, into the shared folder, and validated, fingerprinted and stored from there:
    computed again they may differ, as a sum of doubles follows the order in which its parts arrive.

    A version is published in two steps: its records go to a folder of their own, ``path/series-<n>``, then
    its manifest is added to ``path/manifest``.  Readers follow the newest manifest, so until it is there, and
    for ever if the writer fails before, they see the version before.  Records are laid out by
    ranges of time (by year unless told otherwise), whatever their number; ``position`` is not stored.
    ``request`` says what was asked for, such as the place.
    """
    spark = df.sparkSession
    staged = fresh_path(spark, "staged")
    df.write.parquet(staged)
    df = spark.read.schema(df.schema).parquet(staged)
    described = build_manifest(df, units, first, last, freq, time, position)
    row = described.first()  # one row, by construction
    if row["problems"] is not None:
        raise ValueError("dataset failed validation: " + row["problems"])
    newest = read_manifest(spark, path).select("version").first()
    version = newest["version"] + 1 if newest else 0
    # A failed writer may have left a folder of this number; no manifest names it.
    folder = f"series-{version}-{uuid.uuid4().hex[:8]}"
    stored = df.drop(position) if position else df
    stored = stored if partition_by else stored.withColumn("year", F.year(time))
    by = list(partition_by) or ["year"]
    ranged = stored.repartitionByRange(*by, time).sortWithinPartitions(*by, time)
    ranged.write.partitionBy(*by).parquet(f"{path}/{folder}")
    asked = {"first": first, "last": last, "freq": freq} | (request or {})
    manifest = spark.createDataFrame([row], described.schema).drop("problems")
    manifest = manifest.withColumns({
        "version": F.lit(version).cast("long"), "folder": F.lit(folder),
        "request": F.create_map(*[F.lit(x) for kv in asked.items() for x in kv]),
    })
    manifest.write.mode("append").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest, one row; no row if nothing has been published."""
    try:
        every = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        every = spark.createDataFrame([], MANIFEST)
    # Of two writers that took the same number the folder decides, the same for every reader.
    return every.orderBy(F.desc("version"), F.desc("folder")).limit(1)


def read_published(spark: SparkSession, path: str, schema: T.StructType = SERIES) -> DataFrame:
    """The records of the newest version that has a manifest; an empty table if there is none."""
    newest = read_manifest(spark, path).select("folder").first()
    return read_series(spark, f"{path}/{newest['folder']}", schema) if newest else spark.createDataFrame([], schema)


def check_manifest(spark: SparkSession, path: str, schema: T.StructType = SERIES, time: str = TIME) -> DataFrame:
    """(ok, message): recompute the fingerprint of the published series and compare; no row if nothing is published."""
    measures = [f.name for f in schema.fields if f.name != time]
    actual = content_hash(read_published(spark, path, schema), measures, time)
    actual = actual.select(F.col("content_sha256").alias("actual"), F.lit(1).alias("_one"))
    stored = read_manifest(spark, path).select("rows", "content_sha256", F.lit(1).alias("_one"))
    ok = F.col("actual") == F.col("content_sha256")
    message = F.when(
        ok, F.concat(F.lit("ok: "), F.col("rows").cast("string"), F.lit(" rows, content_sha256 "), F.left("actual", F.lit(12)), F.lit("..."))
    ).otherwise(
        F.concat(
            F.lit("content hash mismatch: manifest "), F.left("content_sha256", F.lit(12)), F.lit("..., file "),
            F.left("actual", F.lit(12)), F.lit("..."),
        )
    )
    return stored.join(actual, "_one").select(ok.alias("ok"), message.alias("message"))
