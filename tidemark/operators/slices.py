"""Time and value predicates.

Periods become half-open ranges on the raw time column, so they reach the scan as pushed filters
and prune files by their min/max statistics; ``year(time) = 2023`` would do neither.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = "time"


def period_bounds(period: str) -> tuple[str, str]:
    """[start, end) of a year ``2023``, month ``2023-07`` or day ``2024-02-29``."""
    parts = [int(p) for p in period.split("-")]
    start = dt.date(*(parts + [1, 1])[:3])
    if len(parts) == 1:
        end = dt.date(start.year + 1, 1, 1)
    elif len(parts) == 2:
        end = (start.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    else:
        end = start + dt.timedelta(days=1)
    return f"{start} 00:00:00", f"{end} 00:00:00"


def in_range(start: str, end: str, time: str = TIME) -> Column:
    return (F.col(time) >= F.lit(start).cast("timestamp")) & (F.col(time) < F.lit(end).cast("timestamp"))


def in_period(period: str, time: str = TIME) -> Column:
    return in_range(*period_bounds(period), time)


def in_dates(first: str, last: str, time: str = TIME) -> Column:
    """Both days fully included; the range may span years."""
    return in_range(period_bounds(first)[0], period_bounds(last)[1], time)


def at_hours(*hours: int, time: str = TIME) -> Column:
    """Hours of the day in UTC.  A set that wraps midnight selects records, not nights."""
    return F.hour(time).isin(*hours)


COMPARE = {
    "<": lambda c, x: c < x,
    "<=": lambda c, x: c <= x,
    ">": lambda c, x: c > x,
    ">=": lambda c, x: c >= x,
}


def known(column: str) -> Column:
    """The value, with NaN turned into NULL: NaN would satisfy ``>`` and poison aggregates."""
    return F.nanvl(F.col(column), F.lit(None).cast("double"))


def passes(column: str, op: str, bound: float) -> Column:
    """A comparison that is never NULL: a missing value fails it."""
    return F.coalesce(COMPARE[op](known(column), F.lit(bound)), F.lit(False))


def period_slice(df: DataFrame, period: str, time: str = TIME) -> DataFrame:
    return df.where(in_period(period, time))


def date_range_inclusive(df: DataFrame, first: str, last: str, time: str = TIME) -> DataFrame:
    return df.where(in_dates(first, last, time))


def hour_of_day_filter(df: DataFrame, *hours: int, time: str = TIME) -> DataFrame:
    return df.where(at_hours(*hours, time=time))


def threshold_filter(df: DataFrame, column: str, op: str, bound: float) -> DataFrame:
    return df.where(passes(column, op, bound))


def column_projection(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed before anything that reads it.

    A filter is pushed through a projection by repeating the projected expression in the filter; with
    decisions built from hundreds of expressions the plan would explode.  A one-row generator is a
    border filters on this column do not cross, while all other filters and column pruning do.  The
    value itself is computed by a projection below the generator, which compiles it.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.withColumn("_once", value).select(*rest, F.explode(F.array("_once")).alias(name))
