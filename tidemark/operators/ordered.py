"""Order-dependent operators that never put a whole series into one task.

A plain window over one long series sorts all of it in a single task.  Here a series is cut into
blocks whose size is bounded by construction (a calendar block of a regular series, or a block of
unique positions); each block is summarised in parallel and only the block summaries, thousands of
times fewer, are combined in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import TIME, known

BLOCK = 65_536  # records per block of positions


def _before(window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def with_position(
    df: DataFrame, time: str = TIME, keys: Sequence[str] = (), block: str = "month", name: str = "pos"
) -> DataFrame:
    """Number the records of each series 0, 1, 2.. in time order.

    ``time`` must be unique within a series (the duplicate check finds violations), which bounds a
    calendar block by its number of grid points.  Counts per block give each block its offset.
    """
    rows = df.withColumn("_block", F.date_trunc(block, F.col(time).cast("timestamp")))
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_block")
    offsets = counts.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_block").alias("_o_block"),
        F.coalesce(F.sum("_n").over(_before(order)), F.lit(0)).alias("_offset"),
    )
    same = [rows[k].eqNullSafe(offsets[f"_o_{k}"]) for k in keys] + [rows["_block"] == offsets["_o_block"]]
    inner = Window.partitionBy(*keys, "_block").orderBy(time)
    placed = rows.join(offsets, same).withColumn(name, F.col("_offset") + F.row_number().over(inner) - 1)
    return placed.drop("_block", "_offset", "_o_block", *[f"_o_{k}" for k in keys])


def rolling_sum(
    df: DataFrame,
    column: str,
    size: int = 24,
    time: str = TIME,
    keys: Sequence[str] = (),
    block: str = "month",
    records: int = BLOCK,
) -> DataFrame:
    """Sum over the last ``size`` records; NULL unless all of them exist and are known.

    Records are numbered, cut into blocks of ``records`` and the last ``size - 1`` records of a
    block are copied into the next one, so every frame is complete inside its block.
    """
    records = max(records, size)
    placed = with_position(df.select(*keys, time, column), time, keys, block)
    home = F.floor(F.col("pos") / records)
    in_tail = F.pmod(F.col("pos"), F.lit(records)) >= records - (size - 1)
    copies = F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed.select("*", home.alias("_home"), F.explode(copies).alias("_cell"))
    frame = Window.partitionBy(*keys, "_cell").orderBy("pos").rowsBetween(1 - size, Window.currentRow)
    value = known(column)
    total = F.when(F.count(value).over(frame) == size, F.sum(value).over(frame))
    framed = spread.withColumn("rolling_sum", total)
    return framed.where(F.col("_home") == F.col("_cell")).select(*keys, time, "rolling_sum")


def rolling_sum_max(df: DataFrame, column: str, size: int = 24, **how) -> DataFrame:
    keys = list(how.get("keys", ()))
    return rolling_sum(df, column, size, **how).groupBy(*keys).agg(F.max("rolling_sum").alias("max_sum"))


def longest_run(
    df: DataFrame,
    condition: Column,
    time: str = TIME,
    keys: Sequence[str] = (),
    block: str = "month",
) -> DataFrame:
    """Longest stretch of consecutive records that satisfy a condition; 0 if none does.

    Each calendar block becomes (length, leading run, trailing run, best run); the few block rows
    are merged in order.  A missing value ends a run.
    """
    keys = list(keys)
    flagged = df.select(
        *keys,
        F.col(time),
        F.date_trunc(block, F.col(time).cast("timestamp")).alias("_block"),
        F.coalesce(condition, F.lit(False)).alias("_hit"),
    )
    inner = Window.partitionBy(*keys, "_block").orderBy(time)
    island = F.count_if(~F.col("_hit")).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = (
        flagged.withColumn("_island", island)
        .groupBy(*keys, "_block", "_island")
        .agg(F.count_if("_hit").alias("_run"), F.count(F.lit(1)).alias("_rows"))
    )
    # Island 0 leads the block; the island with the highest number trails it.
    blocks = runs.groupBy(*keys, "_block").agg(
        F.sum("_rows").alias("_len"),
        F.coalesce(F.max(F.when(F.col("_island") == 0, F.col("_run"))), F.lit(0)).alias("_lead"),
        F.max_by("_run", "_island").alias("_trail"),
        F.max("_run").alias("_best"),
    )
    return merge_runs(blocks, keys)


def merge_runs(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge block summaries (_block, _len, _lead, _trail, _best) of each series in order."""
    order = Window.partitionBy(*keys).orderBy("_block")
    full = F.col("_lead") == F.col("_len")
    broken = F.sum(F.when(full, 0).otherwise(1)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    grouped = blocks.withColumn("_full", full).withColumn("_part", broken)
    within = Window.partitionBy(*keys, "_part").orderBy("_block")
    piece = F.when(F.col("_full"), F.col("_len")).otherwise(F.col("_trail"))
    open_run = F.sum(piece).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = grouped.withColumn("_open", open_run)
    joined = F.coalesce(F.lag("_open").over(order), F.lit(0)) + F.col("_lead")
    best = carried.withColumn("_reach", F.greatest("_best", joined))
    return best.groupBy(*keys).agg(F.coalesce(F.max("_reach"), F.lit(0)).alias("longest_run"))


def unsorted_check(
    df: DataFrame, position: str, time: str = TIME, keys: Sequence[str] = (), records: int = BLOCK
) -> DataFrame:
    """How many records are earlier than the record before them in input order.

    ``position`` is a unique input position, which bounds a block.  Blocks are summarised twice
    (records -> blocks -> blocks of blocks) before the last, tiny, ordered pass.
    """
    keys = list(keys)
    rows = df.select(
        *keys, F.col(position).cast("long").alias("_p"), F.col(time).alias("_first"), F.col(time).alias("_last"),
        F.lit(0).cast("long").alias("_bad"),
    )

    def shrink(units: DataFrame, group: Column | None) -> DataFrame:
        """Merge neighbouring units: violations inside plus those between adjacent units."""
        cells = units.withColumn("_cell", F.lit(0).cast("long") if group is None else group)
        order = Window.partitionBy(*keys, "_cell").orderBy("_p")
        edge = F.when(F.lag("_last").over(order) > F.col("_first"), 1).otherwise(0)
        return (
            cells.withColumn("_edge", edge)
            .groupBy(*keys, "_cell")
            .agg(
                F.min_by("_first", "_p").alias("_first"),
                F.max_by("_last", "_p").alias("_last"),
                F.sum(F.col("_bad") + F.col("_edge")).alias("_bad"),
            )
            .withColumnRenamed("_cell", "_p")
        )

    by_block = F.floor(F.col("_p") / records)
    total = shrink(shrink(shrink(rows, by_block), by_block), None)
    return total.select(
        *keys, F.col("_bad").alias("out_of_order"), (F.col("_bad") == 0).alias("is_sorted")
    )


def running_sums(
    df: DataFrame, values: Mapping[str, Column], position: str, keys: Sequence[str], records: int = BLOCK, nulls: bool = True
) -> DataFrame:
    """Running sums of whole numbers, the row itself included, per group in order of ``position``.

    ``values`` maps the name of a sum to what it adds up.  ``position`` must be unique within a group.  A group of
    any size is cut into blocks of positions; the offset of a block is the total of the blocks before it.
    Without ``nulls`` no key is NULL: rows then meet their offsets where they are summed, with one shuffle less.
    """
    keys = list(keys)
    adds = {f"_add_{n}": v.cast("long") for n, v in values.items()}
    rows = df.withColumns(adds).withColumn("_cell", F.floor(F.col(position) / records))
    totals = rows.groupBy(*keys, "_cell").agg(*[F.sum(f"_add_{n}").alias(f"_add_{n}") for n in values])
    order = _before(Window.partitionBy(*keys).orderBy("_cell"))
    offsets = totals.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_cell").alias("_o_cell"),
        *[F.coalesce(F.sum(f"_add_{n}").over(order), F.lit(0)).alias(f"_before_{n}") for n in values],
    )
    alike = [rows[k].eqNullSafe(offsets[f"_o_{k}"]) if nulls else rows[k] == offsets[f"_o_{k}"] for k in keys]
    same = alike + [rows["_cell"] == offsets["_o_cell"]]
    inner = (
        Window.partitionBy(*keys, "_cell")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = rows.join(offsets, same).withColumns({n: F.col(f"_before_{n}") + F.sum(f"_add_{n}").over(inner) for n in values})
    return out.drop("_cell", "_o_cell", *adds, *[f"_before_{n}" for n in values], *[f"_o_{k}" for k in keys])


def running_count(
    df: DataFrame,
    condition: Column,
    position: str,
    keys: Sequence[str],
    name: str = "running",
    records: int = BLOCK,
) -> DataFrame:
    """Running number of rows that satisfy a condition; otherwise as ``running_sums``."""
    return running_sums(df, {name: F.when(condition, 1).otherwise(0)}, position, keys, records)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group in a total order, with their ``rank``.

    Spark applies a rank limit before the shuffle as well, so each task sends at most ``limit`` rows
    of a group, however large the group is.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)
