"""Completeness and structure checks of a regular series, its fingerprint and its profile."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .resample import STEPS
from .slices import TIME, known


def expected_times(spark: SparkSession, first: str, last: str, freq: str = "hour", name: str = TIME) -> DataFrame:
    """Every grid time from the start of ``first`` to the end of the day ``last``.

    The grid is the starts of hours, days, months or years in that time.  It is generated year by year, so a
    long or fine grid is not one huge array.
    """
    end = f"TIMESTAMP '{last} 00:00:00' + INTERVAL 1 DAY"
    years = spark.range(int(first[:4]), int(last[:4]) + 1).select(F.col("id").cast("int").alias("y"))
    lo = F.greatest(_first_slot(first, freq), F.make_timestamp("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    hi = F.least(F.expr(end), F.make_timestamp(F.col("y") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    grid = years.where(lo < hi).select(F.explode(F.sequence(lo, hi, F.expr(STEPS[freq]))).alias(name), hi.alias("_hi"))
    return grid.where(F.col(name) < F.col("_hi")).select(name)


def _times(df: DataFrame, time: str) -> DataFrame:
    return df.select(F.col(time).cast("timestamp").alias(time)).distinct()


def missing_times(df: DataFrame, first: str, last: str, freq: str = "hour", time: str = TIME) -> DataFrame:
    """Grid times without a record."""
    return expected_times(df.sparkSession, first, last, freq, time).join(_times(df, time), time, "left_anti")


def unexpected_times(df: DataFrame, first: str, last: str, freq: str = "hour", time: str = TIME) -> DataFrame:
    """Record times that are not on the grid."""
    return _times(df, time).join(expected_times(df.sparkSession, first, last, freq, time), time, "left_anti")


def _report(times: DataFrame, time: str, count: str) -> DataFrame:
    return times.agg(
        F.count(F.lit(1)).alias(count), F.date_format(F.min(time), "yyyy-MM-dd HH:mm").alias("first")
    )


def missing_hours(df: DataFrame, first: str, last: str, freq: str = "hour", time: str = TIME) -> DataFrame:
    return _report(missing_times(df, first, last, freq, time), time, "missing")


def unexpected_timestamps(df: DataFrame, first: str, last: str, freq: str = "hour", time: str = TIME) -> DataFrame:
    return _report(unexpected_times(df, first, last, freq, time), time, "unexpected")


def expected_vs_actual(df: DataFrame, first: str, last: str, freq: str = "hour", time: str = TIME) -> DataFrame:
    """Both differences in one result: (side, time)."""
    lacking = missing_times(df, first, last, freq, time).select(F.lit("missing").alias("side"), time)
    extra = unexpected_times(df, first, last, freq, time).select(F.lit("unexpected").alias("side"), time)
    return lacking.unionByName(extra)


def duplicate_timestamps(df: DataFrame, time: str = TIME, keys: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of their time."""
    per_time = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n"))
    return per_time.groupBy(*keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def is_missing(column: str, kind: str) -> Column:
    c = F.col(column)
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, missing), one row per column, from one aggregation."""
    kinds = dict(df.dtypes)
    columns = list(columns or df.columns)
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(c, kinds[c])).alias(f"_m{i}") for i, c in enumerate(columns)],
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"_m{i}").alias("missing")) for i, c in enumerate(columns)]
    return totals.select(F.inline(F.array(*rows)))


def all_null_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return null_counts(df, columns).where(F.col("missing") == F.col("rows")).select("column", "rows")


# Calendar unit in which a series of a frequency is summarised: some hundred grid times.
BLOCKS = {"hour": "month", "day": "year", "month": "year", "year": "year"}


def grid_size(first: str, last: str, freq: str) -> int:
    """Grid times from the start of ``first`` to the end of the day ``last``."""
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    days = max((b - a).days + 1, 0)
    if freq in ("hour", "day"):
        return days * (24 if freq == "hour" else 1)
    # Starts of months or years: those up to the last day without those before the first.
    months = [12 * d.year + d.month for d in (a - timedelta(days=1), b)]
    return max(months[1] - months[0], 0) if freq == "month" else max(b.year - (a - timedelta(days=1)).year, 0)


def _first_slot(first: str, freq: str) -> Column:
    """The first grid time at or after the start of ``first``."""
    start = F.expr(f"TIMESTAMP '{first} 00:00:00'")
    unit = F.date_trunc(freq, start)
    return F.when(unit == start, start).otherwise(unit + F.expr(STEPS[freq]))


def series_report(
    df: DataFrame,
    first: str,
    last: str,
    freq: str = "hour",
    time: str = TIME,
    columns: Sequence[str] | None = None,
    position: str | None = None,
    fingerprint: bool = False,
) -> DataFrame:
    """One row about a series, from one scan: what ``validate_series`` reports, the time range, and the fingerprint.

    Rows are aggregated by time, times are summarised in order within calendar blocks (first and last grid time,
    first gap, smallest and largest position), and only the block summaries meet.  No calendar is built or
    joined: a gap is a grid time that does not follow the one before it by one step.
    """
    measures = list(columns or [c for c in df.columns if c not in (time, position)])
    kinds = dict(df.dtypes)
    step, start = F.expr(STEPS[freq]), _first_slot(first, freq)
    end = F.expr(f"TIMESTAMP '{last} 00:00:00' + INTERVAL 1 DAY")
    adds = {f"_m{i}": is_missing(c, kinds[c]).cast("long") for i, c in enumerate(measures)}
    if fingerprint:
        digest = F.sha2(row_text(measures, time), 256)
        adds |= {f"_w{i}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)}
    place = F.lit(None).cast("long") if position is None else F.col(position).cast("long")
    rows = df.select(F.col(time).cast("timestamp").alias("_t"), place.alias("_p"), *[v.alias(n) for n, v in adds.items()])
    per_time = rows.groupBy(F.date_trunc(BLOCKS[freq], "_t").alias("_block"), "_t").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_p0"), F.max("_p").alias("_p1"), *[F.sum(n).alias(n) for n in adds]
    )
    t = F.col("_t")
    regular = F.coalesce((F.date_trunc(freq, t) == t) & (t >= start) & (t < end), F.lit(False))
    on_grid = per_time.withColumn("_g", F.when(regular, t))
    order = Window.partitionBy("_block").orderBy("_t")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    previous = F.max("_g").over(before) + step
    walked = on_grid.withColumns({
        "_gap": F.when(previous < F.col("_g"), previous),
        "_back": F.coalesce(F.max("_p1").over(before) > F.col("_p0"), F.lit(False)),
    })
    # A block sums at most some hundred times; words of its rows may pass 64 bits over all of them.
    wide = "decimal(28,0)"
    blocks = walked.groupBy("_block").agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_times"), F.count("_g").alias("_held"),
        F.min("_g").alias("_g0"), F.max("_g").alias("_g1"), F.min("_gap").alias("_gap"),
        F.min(F.when(F.col("_g").isNull(), t)).alias("_odd"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1"),
        F.min("_p0").alias("_p0"), F.max("_p1").alias("_p1"), F.bool_or("_back").alias("_back"),
        *[F.sum(F.col(n).cast(wide)).alias(n) for n in adds],
    )
    # One row a block of the calendar.
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    between = F.max("_g1").over(earlier) + step
    merged = blocks.withColumns({
        "_between": F.when(between < F.col("_g0"), between),
        "_back": F.col("_back") | F.coalesce(F.max("_p1").over(earlier) > F.col("_p0"), F.lit(False)),
    })
    total = merged.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_rows") - F.col("_times")), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("_held"), F.lit(0)).alias("_held"),
        F.coalesce(F.sum(F.col("_times") - F.col("_held")), F.lit(0)).alias("unexpected"),
        F.min("_g0").alias("_g0"), F.max("_g1").alias("_g1"), F.least(F.min("_gap"), F.min("_between")).alias("_gap"),
        F.min("_odd").alias("_odd"), F.min("_t0").alias("_t0"), F.max("_t1").alias("_t1"),
        F.coalesce(F.bool_or("_back"), F.lit(False)).alias("unsorted"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in adds],
    )
    tail = F.col("_g1") + step
    lead = F.when(F.col("_g0").isNull() | (F.col("_g0") > start), start)
    names = F.array(*[F.lit(c) for c in measures]).cast("array<string>")
    missed = F.array(*[F.col(f"_m{i}").cast("long") for i in range(len(measures))]).cast("array<bigint>")
    sums = [F.col(f"_w{i}").cast("string") for i in range(8 if fingerprint else 0)]
    return total.select(
        "rows", F.lit(grid_size(first, last, freq)).cast("long").alias("expected_rows"),
        F.map_from_arrays(names, missed).alias("nan_counts"), "duplicates", "unsorted",
        (F.lit(grid_size(first, last, freq)) - F.col("_held")).cast("long").alias("missing"),
        F.coalesce(lead, F.col("_gap"), F.when(tail < end, tail)).alias("first_missing"),
        "unexpected", F.col("_odd").alias("first_unexpected"), F.array("_t0", "_t1").alias("time_range"),
        *([F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *sums), 256).alias("content_sha256")] if fingerprint else []),
    )


def problems_of(report: DataFrame) -> Column:
    """Every structural problem a ``series_report`` tells, joined by "; "; NULL if there is none."""
    stamped = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    empty = F.map_filter(report["nan_counts"], lambda k, v: v == F.col("rows"))
    found = F.array_compact(
        F.array(
            F.when(F.col("duplicates") > 0, F.format_string("%d duplicated timestamps", "duplicates")),
            F.when(F.col("unsorted"), F.lit("timestamps are not sorted")),
            F.when(F.col("missing") > 0, F.format_string("%d missing hours, first: %s", "missing", stamped("first_missing"))),
            F.when(F.col("unexpected") > 0, F.format_string("%d unexpected timestamps, first: %s", "unexpected", stamped("first_unexpected"))),
            F.when(
                (F.size(empty) > 0) & (F.col("rows") > 0),
                F.concat(F.lit("columns entirely NaN: "), F.array_join(F.map_keys(empty), ", ")),
            ),
        )
    )
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def validate_series(
    df: DataFrame,
    first: str,
    last: str,
    freq: str = "hour",
    time: str = TIME,
    columns: Sequence[str] | None = None,
    position: str | None = None,
) -> DataFrame:
    """One row: rows, expected_rows, nan_counts, and every structural problem joined by "; ".

    ``problems`` is NULL for a valid series.  Missing values are counted, not a problem, unless a
    column holds nothing else.  The order check needs the input ``position``: in its order no time may
    come before an earlier one.
    """
    report = series_report(df, first, last, freq, time, columns, position)
    return report.select("rows", "expected_rows", "nan_counts", problems_of(report).alias("problems"))


def row_text(columns: Sequence[str], time: str = TIME) -> Column:
    """Canonical text of a row: ISO time, then every value with six decimals, missing as empty."""
    stamp = F.date_format(F.col(time).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    values = [F.coalesce(F.format_string("%.6f", known(c)), F.lit("")) for c in columns]
    return F.concat_ws(",", stamp, *values)


def content_hash(df: DataFrame, columns: Sequence[str], time: str = TIME) -> DataFrame:
    """Fingerprint of the content, the same for every order and file layout of the rows.

    An additive multiset hash: the SHA-256 of each row is split into eight 32-bit words, the words
    are summed over all rows, and the row count with the eight sums is hashed again.  Sums combine
    on the map side, so nothing is sorted or gathered.  Repeated rows change the result.
    """
    digest = F.sha2(row_text(columns, time), 256)
    words = [
        F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)").cast("decimal(28,0)"))
        for i in range(8)
    ]
    sums = df.select(digest.alias("_h")).agg(F.count(F.lit(1)).alias("rows"), *[w.alias(f"_w{i}") for i, w in enumerate(words)])
    text = F.concat_ws(",", F.col("rows").cast("string"), *[F.coalesce(F.col(f"_w{i}").cast("string"), F.lit("0")) for i in range(8)])
    return sums.select("rows", F.sha2(text, 256).alias("content_sha256"))


def profile_columns(df: DataFrame, units: dict[str, str], columns: Sequence[str], time: str = TIME) -> DataFrame:
    """Per measure: unit, min, mean, max (three decimals), missing, rows and the time range."""
    kinds = dict(df.dtypes)
    parts = [F.count(F.lit(1)).alias("rows"), F.min(time).alias("_t0"), F.max(time).alias("_t1")]
    for i, c in enumerate(columns):
        value = known(c)
        parts += [
            F.min(value).alias(f"_a{i}"), F.avg(value).alias(f"_b{i}"), F.max(value).alias(f"_c{i}"),
            F.count_if(is_missing(c, kinds[c])).alias(f"_m{i}"),
        ]
    one = df.agg(*parts)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(units.get(c)).cast("string").alias("unit"),
            F.round(F.col(f"_a{i}"), 3).alias("min"),
            F.round(F.col(f"_b{i}"), 3).alias("mean"),
            F.round(F.col(f"_c{i}"), 3).alias("max"),
            F.col(f"_m{i}").alias("missing"),
            F.col("rows"),
            F.date_format("_t0", "yyyy-MM-dd HH:mm").alias("time_from"),
            F.date_format("_t1", "yyyy-MM-dd HH:mm").alias("time_to"),
        )
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*rows)))


def describe_result(df: DataFrame, order: Sequence[str], head: int = 20) -> DataFrame:
    """Shape and missing total of a result table, with its first rows as JSON, one line each.

    The first rows are a top-k, so at most ``head`` rows are ever gathered.
    """
    kinds = dict(df.dtypes)
    missing = F.lit(0).cast("long")
    for c in df.columns:
        missing = missing + F.when(is_missing(c, kinds[c]), 1).otherwise(0)
    shape = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("n_missing"),
    )
    first = df.orderBy(*order).limit(head)
    lines = first.agg(F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*df.columns)).alias("line")))).alias("l"))
    lines = lines.select(F.array_join(F.col("l.line"), "\n").alias("head"))
    one = F.lit(1)
    return shape.withColumn("_one", one).join(lines.withColumn("_one", one), "_one").drop("_one")
