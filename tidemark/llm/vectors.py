"""Near-duplicate vectors by an inverted multi-index: codebooks of both halves span a grid of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import bounded_ids, checkpointed, fields

COSINE = 0.95
SAMPLE = 20_000  # vectors the codebooks are fitted on
CODES = 64  # of each half, at least; the grid has as many cells as their square
CROWD = 16  # vectors a cell is to hold: codebooks grow with the square root of the vectors
RECALL = 0.995  # of pairs at the threshold itself, which are the hardest to find
PARTNERS = 10_000
BLOCK = 512  # vectors on each side of a comparison


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0.0)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means centres of distinct starting points."""
    x = np.unique(x, axis=0)
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _squares(x, codes).argmin(1)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(codes))
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
    return codes


@dataclass
class Grid:
    """The two codebooks, and how far a traversal of the grid goes."""

    first: np.ndarray
    second: np.ndarray
    reach: float = 0.0

    @property
    def width(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def _depths(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest code, and for each code how far x is from the side of its cell, squared."""
        d = _squares(x, codes)
        near = d.argmin(1)
        apart = np.sqrt(_squares(codes, codes))[near]
        gap = np.where(apart > 0, (d - d.min(1)[:, None]) / (2 * np.where(apart > 0, apart, 1.0)), 0.0)
        return near, gap * gap

    def visit(self, u: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The home cell of each vector, and the cells of its traversal: nearest first, home included.

        The traversal takes a cell with code i of the first half and j of the second in the order of the sum
        of both squared depths, and ends beyond the reach.
        """
        h = self.first.shape[1]
        (a, da), (b, db) = self._depths(u[:, :h], self.first), self._depths(u[:, h:], self.second)
        cells = []
        for x, y in zip(da, db, strict=True):
            i, j = np.flatnonzero(x <= self.reach), np.flatnonzero(y <= self.reach)
            total = x[i][:, None] + y[j]
            r, c = np.nonzero(total <= self.reach)
            order = np.argsort(total[r, c], kind="stable")
            cells.append((i[r] * len(self.second) + j[c])[order])
        return a * len(self.second) + b, cells

    def needed(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The reach at which the traversal of each u comes to the home cell of its v."""
        h = self.first.shape[1]
        (_, da), (_, db) = self._depths(u[:, :h], self.first), self._depths(u[:, h:], self.second)
        (a, _), (b, _) = self._depths(v[:, :h], self.first), self._depths(v[:, h:], self.second)
        r = np.arange(len(u))
        return da[r, a] + db[r, b]


def fit(sample: np.ndarray, codes: int = CODES, recall: float = RECALL, cosine: float = COSINE) -> Grid:
    """Codebooks of a sample of unit vectors; the reach meets the recall on partners made at the threshold.

    Sample vectors get partners in random directions at exactly the given cosine, ``PARTNERS`` in all or one
    each.  A code stands for eight sample vectors or more.
    """
    rng = np.random.default_rng(7)
    h = sample.shape[1] // 2
    codes = min(codes, -(-len(sample) // 8))
    grid = Grid(_codebook(sample[:, :h], codes, rng), _codebook(sample[:, h:], codes, rng))
    needed = []
    for _ in range(-(-PARTNERS // len(sample))):
        noise = rng.standard_normal(sample.shape)
        noise -= (noise * sample).sum(1, keepdims=True) * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        needed.append(grid.needed(sample, cosine * sample + np.sqrt(1 - cosine * cosine) * noise))
    grid.reach = float(np.quantile(np.concatenate(needed), recall)) + 1e-12
    return grid


def one_cell(width: int) -> Grid:
    """For a length so rare that no vector of the sample has it: all in one cell, which is compared in blocks."""
    return Grid(np.zeros((1, width // 2)), np.zeros((1, width - width // 2)))


def _representatives(vectors: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(rows, distinct, type): ``rows(vec_id, v)`` with the bytes of valid vectors, ``distinct(rid, n, v)``."""
    kind = vectors.schema["embedding"].dataType
    number = "<f8" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType) else "<f4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for e in batch["embedding"]:
                x = None if e is None else np.array([np.nan if c is None else c for c in e], number)
                good = x is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
                out.append((x + np.array(0, number)).tobytes() if good else None)  # -0.0 becomes 0.0
            yield batch[["vec_id"]].assign(v=out)

    array = vectors["embedding"].cast("array<double>" if number == "<f8" else "array<float>").alias("embedding")
    bare = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), array)
    rows = checkpointed(bare.mapInPandas(run, fields(vec_id="bigint", v="binary")))
    distinct = rows.where("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rid"), F.count("*").alias("n"))
    return rows, distinct, number


def _compare(number: str):
    """Counts and joins within a block: linked weights of each vector, and the smallest vector it is joined to."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["side"] == 0], block[block["side"] == 1]
        none = pd.DataFrame({"rid": [], "linked": [], "root": []}).astype("int64")
        if not len(left) or not len(right):
            return none
        u = unit(np.stack([np.frombuffer(v, number) for v in left["v"]]))
        w = unit(np.stack([np.frombuffer(v, number) for v in right["v"]]))
        i, j = np.nonzero(u @ w.T >= COSINE)
        a, b = left["rid"].to_numpy()[i], right["rid"].to_numpy()[j]
        home_a, home_b = left["home"].to_numpy()[i], right["home"].to_numpy()[j]
        # A pair may also meet in the home cell of the other one: then it counts in the lower cell only.
        # Two vectors of one cell meet there from both sides and count from the smaller.
        seen = np.array([hb in set(c) for hb, c in zip(home_b, (left["cells"].to_numpy()[k] for k in i), strict=True)], bool)
        once = np.where(home_a == home_b, a < b, ~seen | (home_a < home_b)) & (a != b)
        i, j, a, b = i[once], j[once], a[once], b[once]
        if not len(a):
            return none
        weight_a, weight_b = left["n"].to_numpy()[i], right["n"].to_numpy()[j]
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        linked = np.zeros(len(ids), np.int64)
        np.add.at(linked, at, np.concatenate([weight_b, weight_a]))
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(ids))
        while True:  # the smallest member of each joined group
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            root = root[root]
            if (root == before).all():
                break
        return pd.DataFrame({"rid": ids, "linked": linked, "root": ids[root]})

    return run


def dedup(vectors: DataFrame, codes: int = CODES) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row of ``vectors(vec_id, embedding)``.

    Equal vectors are one representative with a weight.  Every representative lies in its home cell of the
    grid; it visits the nearest cells until the recall is met, and pairs of a home vector and a visitor are
    verified in double precision.  A cell with many vectors is compared in blocks, so none gathers in one
    task; a block gives a count and a root for each of its vectors, never pairs.

    Vectors that are null, empty, zero, or hold a null or a non-finite component link with nothing, and so
    do rows with a null vec_id.  Vectors of different lengths never link; each length has a grid of its own.
    Repeated rows count as copies; labels and other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, distinct, number = _representatives(vectors)
    reps = checkpointed(distinct.withColumn("b", F.length("v")))
    few = reps.join(F.broadcast(bounded_ids(reps, "rid", SAMPLE)), "rid", "left_semi").select("rid", "b", "v").collect()
    few.sort(key=lambda r: r["rid"])
    by_length: dict[int, list[np.ndarray]] = {}
    for r in few:
        by_length.setdefault(r["b"], []).append(np.frombuffer(bytes(r["v"]), number))
    # Lengths that are in the sample: SAMPLE rows at most.
    counted = {r["b"]: r["c"] for r in reps.where(F.col("b").isin(list(by_length))).groupBy("b").agg(F.count("*").alias("c")).collect()}
    wanted = {b: max(codes, math.isqrt(n // CROWD)) for b, n in counted.items()}
    grids = {b: fit(unit(np.stack(x)), wanted[b]) for b, x in by_length.items()}
    shared = spark.sparkContext.broadcast(grids)  # a code for every eight vectors of the sample at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, part in batch.groupby("b"):
                u = unit(np.stack([np.frombuffer(v, number) for v in part["v"]]))
                home, cells = (shared.value.get(b) or one_cell(u.shape[1])).visit(u)
                yield part[["rid", "n", "v", "b"]].assign(home=home, cells=cells)

    schema = fields(rid="bigint", n="bigint", v="binary", b="int", home="bigint", cells="array<bigint>")
    placed = checkpointed(reps.select("rid", "n", "v", "b").mapInPandas(place, schema))
    visits = placed.select("b", F.explode("cells").alias("cell"), (F.col("home") == F.col("cell")).alias("own"))
    sizes = visits.groupBy("b", "cell").agg(
        F.ceil(F.count_if(F.col("own")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.count("*") / BLOCK).cast("int").alias("rights")
    ).where("lefts > 0")
    salt = F.xxhash64("rid", F.lit("salt"))
    members = placed.select("rid", "n", "v", "b", "home", "cells", F.explode("cells").alias("cell")).join(sizes, ["b", "cell"])
    as_left = members.where("home = cell").select(
        "rid", "n", "v", "b", "home", "cells", "cell", F.lit(0).alias("side"),
        F.pmod(salt, F.col("lefts")).cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("r"),
    )
    as_right = members.select(
        "rid", "n", "v", "b", "home", F.array().cast("array<bigint>").alias("cells"), "cell", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), F.pmod(salt, F.col("rights")).cast("int").alias("r"),
    )
    blocks = as_left.unionByName(as_right).groupBy("b", "cell", "l", "r")
    found = checkpointed(blocks.applyInPandas(_compare(number), fields(rid="bigint", linked="bigint", root="bigint")))
    links = found.groupBy("rid").agg(F.sum("linked").alias("linked"))
    groups = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rid")
    known = reps.join(links, "rid", "left").join(groups, "rid", "left").select(
        "v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component_id")
    )
    named = rows.where("vec_id IS NOT NULL AND v IS NOT NULL").join(known, "v", "left")
    alone = rows.where("vec_id IS NULL OR v IS NULL").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    every = named.select("vec_id", "n_links", "component_id").unionByName(alone)
    component = F.coalesce("component_id", "vec_id")
    return every.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
