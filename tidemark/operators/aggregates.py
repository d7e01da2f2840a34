"""Aggregate expressions over a slice, deterministic arg-extremes, and exact quantiles at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import known, passes


def masked(column: str, where: Column | None = None) -> Column:
    """The known value where the condition holds, NULL elsewhere (aggregates skip NULL)."""
    value = known(column)
    return value if where is None else F.when(where, value)


def stat(how: str, column: str, where: Column | None = None) -> Column:
    """One of mean, max, min, sum, median, std over the rows of a condition.

    The sum of no rows is 0; every other statistic of no rows is NULL.  ``median`` keeps a
    histogram of the group's values: use it where a calendar bounds the group (a period of one
    series) and ``exact_quantiles`` elsewhere.
    """
    value = masked(column, where)
    return {
        "mean": lambda: F.avg(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "sum": lambda: F.coalesce(F.sum(value), F.lit(0.0)),
        "median": lambda: F.median(value),
        "std": lambda: F.stddev_samp(value),
    }[how]()


def quantile(column: str, q: float, where: Column | None = None) -> Column:
    """Exact quantile with linear interpolation, for groups a calendar bounds."""
    return F.percentile(masked(column, where), F.lit(q))


def count_rows(where: Column | None = None) -> Column:
    return F.count(F.lit(1)) if where is None else F.count_if(where)


def count_if(column: str, op: str, bound: float, where: Column | None = None) -> Column:
    test = passes(column, op, bound)
    return F.count_if(test if where is None else where & test)


def share_percent(column: str, op: str, bound: float, where: Column | None = None) -> Column:
    """Percentage of rows passing; rows with a missing value count as failing."""
    hit = F.when(passes(column, op, bound), 100.0).otherwise(0.0)
    return F.avg(hit if where is None else F.when(where, hit))


def corr_pearson(x: str, y: str, where: Column | None = None) -> Column:
    """Pearson correlation over the rows where both values are known."""
    both = known(x).isNotNull() & known(y).isNotNull()
    keep = both if where is None else both & where
    return F.corr(F.when(keep, known(x)), F.when(keep, known(y)))


def mean_difference(column: str, first: Column, second: Column) -> Column:
    """Mean over one condition minus mean over another, in one pass."""
    return stat("mean", column, first) - stat("mean", column, second)


def arg_extreme(label: Column, value: Column, order: Column, largest: bool = True) -> Column:
    """``label`` of the extreme value; the smallest ``order`` wins ties; NULL values are skipped."""
    rank = -value if largest else value
    return F.min_by(F.when(value.isNotNull(), label), F.when(value.isNotNull(), F.struct(rank, order)))


def _quantile_name(q: float) -> str:
    return f"q{q:g}"


# Cells of an octave and a half: values that differ by more than a part in sixteen thousand are in different ones.
_CELLS = 16_384


def _cell(v: Column) -> Column:
    """A nondecreasing cell number of any double: by sign and logarithm."""
    size = F.floor(F.least(F.ln(F.abs(v)), F.lit(1_000.0)) * _CELLS) + 750 * _CELLS  # above zero for every double but zero
    cell = F.when(v == 0, F.lit(0)).otherwise(F.when(v > 0, size).otherwise(-size)).cast("long")
    # Never NULL: a join would filter one side by that and so read the counted values twice.
    return F.coalesce(cell, F.lit(0).cast("long"))


def count_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys.., value, n): how often each value occurs in a group; NULL and NaN are skipped."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    return df.select(*keys, v.alias(value)).where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], n: str = "n") -> DataFrame:
    """``exact_quantiles`` of values that come with their number; rows of one value and group add up."""
    keys = list(keys)
    v = F.col("_v")
    # A struct of keys is never NULL itself and equal where its NULLs are, so it can be joined by.
    group = F.struct(*keys) if keys else F.lit(0)
    dealt = counts.select(group.alias("_k"), F.col(value).cast("double").alias("_v"), F.col(n).alias("_c")).withColumn("_cell", _cell(v))
    upto = F.sum("_c").over(Window.partitionBy("_k", "_cell").orderBy("_v"))  # equal values are peers
    placed = dealt.withColumn("_upto", upto)
    # The cells of a group in order: bounded by their width, whatever the group holds.
    in_order = Window.partitionBy("_k").orderBy("_cell")
    cells = placed.groupBy("_k", "_cell").agg(F.max("_upto").alias("_held"))
    cells = cells.withColumn("_below", F.sum("_held").over(in_order) - F.col("_held")).withColumn("_n", F.sum("_held").over(Window.partitionBy("_k")))
    # Ranks wanted: for each quantile the one below its position and the one above.
    positions = [F.lit(float(q)) * (F.col("_n") - 1) for q in qs]
    ranks = [r.cast("long") for x in positions for r in (F.floor(x), F.ceil(x))]
    held = [F.when((r >= F.col("_below")) & (r < F.col("_below") + F.col("_held")), r - F.col("_below")) for r in ranks]
    targets = [f"_r{t}" for t in range(len(ranks))]
    wanted = cells.select("_k", "_cell", "_n", *[h.alias(t) for h, t in zip(held, targets, strict=True)])
    inside = placed.join(wanted.where(F.coalesce(*targets).isNotNull()), ["_k", "_cell"])
    # A rank is reached by the values with more rows up to them; the smallest of them holds it.
    reached = [F.min(F.when(F.col(f"_r{t}") < F.col("_upto"), v)).alias(f"_v{t}") for t in range(len(ranks))]
    per = inside.groupBy("_k").agg(F.max("_n").alias("_n"), *reached)
    out = []
    for i, (q, x) in enumerate(zip(qs, positions, strict=True)):
        low, high = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        between = low + (high - low) * (x - F.floor(x))
        out.append(F.when(low == high, low).otherwise(between).alias(_quantile_name(q)))
    return per.where(F.col("_n").isNotNull()).select(*[F.col(f"_k.`{k}`").alias(k) for k in keys], *out)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation of groups of any size, one row per group.

    ``percentile`` keeps every distinct value of a group in one task.  Here values are counted (combined on
    the map side) and dealt into cells by their logarithm; values are ordered within a cell only, the sums
    of the cells tell which cell holds a rank, and all ranks are looked up in the same pass.  The counted
    values move twice, however many quantiles are asked for; all else is one row a cell or a group.  There is
    one path for every size, and no keys at all is one group.  NULL and NaN are skipped; a NULL key is a group.
    """
    return quantiles_of_counts(count_values(df, keys, value), keys, value, qs)


def exact_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact medians of several columns in the same pass: one row per group."""
    keys = list(keys)
    long = df.select(*keys, F.inline(F.array(*named_values(columns))))
    return medians_by_name(count_values(long, [*keys, "name"], "value"), keys, columns)


def named_values(columns: Sequence[str]) -> list[Column]:
    return [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]


def medians_by_name(counts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One column per name of ``counts(keys.., name, value, n)``: its median."""
    halves = quantiles_of_counts(counts, [*keys, "name"], "value", [0.5])
    return halves.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == c, F.col("`q0.5`"))).alias(c) for c in columns]
    )
