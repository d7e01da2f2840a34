"""Calendar bins with empty bins filled, and what is built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import arg_extreme, stat
from .slices import COMPARE, TIME, known

STEPS = {
    "hour": "INTERVAL 1 HOUR",
    "day": "INTERVAL 1 DAY",
    "month": "INTERVAL 1 MONTH",
    "year": "INTERVAL 1 YEAR",
}
FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:mm"}
HOWS = ("mean", "max", "min", "sum")


def bin_start(freq: str, time: str = TIME) -> Column:
    return F.date_trunc(freq, F.col(time).cast("timestamp"))


def bin_id(bin_column: Column, freq: str) -> Column:
    return F.date_format(bin_column, FORMATS[freq])


def fill_bins(
    bins: DataFrame, freq: str, zero: Sequence[str] = (), keys: Sequence[str] = (), column: str = "bin"
) -> DataFrame:
    """Add the empty bins between the first and the last bin of each series.

    Each bin is stretched up to the next one and exploded, so no spine has to be joined and the
    data is aggregated once.  ``bins`` holds one row per calendar bin, so a series stays small.
    Columns named in ``zero`` are 0 in an empty bin, all others NULL.
    """
    order = Window.partitionBy(*keys).orderBy(column)
    step = F.expr(STEPS[freq])
    last = F.coalesce(F.lead(column).over(order) - step, F.col(column))
    spread = bins.withColumn("_last", last)
    spread = spread.withColumn("_slot", F.explode(F.sequence(F.col(column), F.col("_last"), step)))
    real = F.col("_slot") == F.col(column)
    out = []
    for name in bins.columns:
        if name in keys:
            out.append(F.col(name))
        elif name == column:
            out.append(F.col("_slot").alias(column))
        elif name in zero:
            out.append(F.when(real, F.col(name)).otherwise(F.lit(0)).alias(name))
        else:
            out.append(F.when(real, F.col(name)).alias(name))
    return spread.select(*out)


def resample(
    df: DataFrame,
    freq: str,
    aggregates: dict[str, tuple[str, str]],
    time: str = TIME,
    keys: Sequence[str] = (),
    fill: bool = True,
) -> DataFrame:
    """One row per calendar bin: ``aggregates`` maps an output name to (column, how).

    ``how`` is mean, max, min or sum.  Empty bins between the first and last record are kept: their
    sum is 0 and everything else is NULL.
    """
    for _, how in aggregates.values():
        if how not in HOWS:
            raise ValueError(f"unsupported aggregate {how!r}")
    bins = df.groupBy(*keys, bin_start(freq, time).alias("bin")).agg(
        *[stat(how, column).alias(name) for name, (column, how) in aggregates.items()]
    )
    if not fill:
        return bins
    sums = [name for name, (_, how) in aggregates.items() if how == "sum"]
    return fill_bins(bins, freq, zero=sums, keys=keys)


def extreme_bin(
    df: DataFrame,
    freq: str,
    column: str,
    how: str,
    largest: bool,
    time: str = TIME,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The calendar bin with the extreme aggregate; the earliest bin wins ties."""
    # An empty bin can only win where its value is not NULL, that is for the smallest sum.
    fill = how == "sum" and not largest
    bins = resample(df, freq, {"value": (column, how)}, time, keys, fill)
    return bins.groupBy(*keys).agg(
        arg_extreme(bin_id(F.col("bin"), freq), F.col("value"), F.col("bin"), largest).alias("bin")
    )


def count_days_where(
    df: DataFrame,
    column: str,
    how: str,
    op: str,
    bound: float,
    time: str = TIME,
    keys: Sequence[str] = (),
) -> DataFrame:
    """How many days have an aggregate that passes; an empty day has sum 0."""
    days = resample(df, "day", {"value": (column, how)}, time, keys, fill=how == "sum")
    hit = F.coalesce(COMPARE[op](F.col("value"), F.lit(bound)), F.lit(False))
    return days.groupBy(*keys).agg(F.count_if(hit).alias("days"))


def mean_daily_range(df: DataFrame, column: str, time: str = TIME, keys: Sequence[str] = ()) -> DataFrame:
    days = resample(df, "day", {"hi": (column, "max"), "lo": (column, "min")}, time, keys, fill=False)
    return days.groupBy(*keys).agg(F.avg(F.col("hi") - F.col("lo")).alias("mean_range"))


def two_step_extreme_then_agg(
    df: DataFrame,
    freq: str,
    rank_column: str,
    value_column: str,
    time: str = TIME,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean of one measure inside the bin where the total of another is largest, in one pass."""
    bins = df.groupBy(*keys, bin_start(freq, time).alias("bin")).agg(
        stat("sum", rank_column).alias("total"), stat("mean", value_column).alias("mean")
    )
    winner = F.min_by(F.struct("bin", "mean"), F.struct(-F.col("total"), F.col("bin")))
    picked = bins.groupBy(*keys).agg(winner.alias("w"))
    return picked.select(*keys, bin_id(F.col("w.bin"), freq).alias("bin"), F.col("w.mean").alias("mean"))


def group_by_hour_of_day(df: DataFrame, column: str, time: str = TIME, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.hour(time).alias("hour")).agg(F.avg(known(column)).alias("mean"))
