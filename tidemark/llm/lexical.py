"""Ranked lexical search: a K2-treap over the terms and documents of each block, descended best first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import chunks, words
from .shared import fields, fresh_path

TOP = 50
BLOCK_ROWS = 8_192  # documents of a block at most
BLOCK_BYTES = 6 << 20  # of text of a block; a longer text is a block of its own
WIDTH = 256  # ranges that are opened at once
TERMS = 1 << 20  # terms of the items that are searched for in one pass over the index
SALTS = 32  # parts in which the hits of an item are ranked first

_ONES = np.array([b.bit_count() for b in range(16)], np.uint8)
_BELOW = np.array([[(b & ((1 << q) - 1)).bit_count() for q in range(4)] for b in range(16)], np.uint8)


class Treap:
    """A quadtree over a grid of terms (rows) and documents (columns) with the largest impact of every cell.

    Nodes are in breadth-first order; ``masks`` tells which of its four quarters a node has (bit 2 * lower half + right
    half), and the n-th one bit of all masks is node n, so there are no pointers.  A node stores how far its
    maximum is below that of its parent.
    """

    def __init__(self, height: int, masks: np.ndarray, maxima: np.ndarray):
        """``masks`` of the inner nodes and ``maxima`` of all nodes.  One node without cells stands at the end."""
        self.height, self.none = height, len(maxima)
        self.maxima = np.append(maxima, 0)
        self.masks = np.append(masks, np.zeros(len(self.maxima) - len(masks), np.uint8))
        self.first = 1 + np.cumsum(_ONES[self.masks], dtype=np.int64) - _ONES[self.masks]

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> Treap:
        """Of cells given once each, with positive impacts."""
        if not len(rows):
            return cls(0, np.zeros(0, np.uint8), np.zeros(0, np.int64))
        height = max(int(max(rows.max(), columns.max())).bit_length(), 1)
        code = np.zeros(len(rows), np.int64)
        for bit in range(height):
            code |= ((rows >> bit & 1) << (2 * bit + 1)) | ((columns >> bit & 1) << (2 * bit))
        order = np.argsort(code, kind="stable")
        code, most = code[order], impacts[order]
        maxima, masks = [most], []
        for _ in range(height):
            starts = np.flatnonzero(np.append(True, np.diff(code >> 2) != 0))
            masks.append(np.bitwise_or.reduceat(np.left_shift(1, code & 3), starts).astype(np.uint8))
            most = np.maximum.reduceat(most, starts)
            maxima.append(most)
            code = code[starts] >> 2
        return cls(height, np.concatenate(masks[::-1]), np.concatenate(maxima[::-1]))

    def _levels(self) -> Iterator[tuple[int, int]]:
        """First node of each level and of the next one."""
        at, to = 0, 1
        for _ in range(self.height):
            yield at, to
            at, to = to, int(self.first[to - 1]) + int(_ONES[self.masks[to - 1]])

    def dumps(self) -> bytes:
        """Compressed: two masks a byte, and differences to the parents in planes of bytes."""
        if not self.none:
            return b""
        n_inner = int(np.count_nonzero(self.masks))
        masks = np.append(self.masks[:n_inner], np.zeros(n_inner % 2, np.uint8))
        parents = np.repeat(np.arange(n_inner), _ONES[self.masks[:n_inner]])
        drops = np.append(self.maxima[:1], self.maxima[parents] - self.maxima[1:-1]).astype("<u4")
        planes = drops.view(np.uint8).reshape(-1, 4).T
        head = np.array([self.height, n_inner, len(drops)], "<i8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + (masks[::2] | masks[1::2] << 4).tobytes() + planes.tobytes())

    @classmethod
    def loads(cls, stored: bytes) -> Treap:
        if not stored:
            return cls(0, np.zeros(0, np.uint8), np.zeros(0, np.int64))
        raw = zstandard.ZstdDecompressor().decompress(stored)
        height, n_inner, n_all = (int(v) for v in np.frombuffer(raw, "<i8", 3))
        packed = np.frombuffer(raw, np.uint8, (n_inner + 1) // 2, 24)
        masks = np.stack([packed & 15, packed >> 4], 1).ravel()[:n_inner]
        planes = np.frombuffer(raw, np.uint8, 4 * n_all, 24 + len(packed)).reshape(4, n_all)
        maxima = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        out = cls(height, masks, maxima)
        parents = np.repeat(np.arange(n_inner), _ONES[masks])
        for at, to in out._levels():
            children = slice(int(out.first[at]), int(out.first[to - 1]) + int(_ONES[out.masks[to - 1]]))
            maxima[children] = maxima[parents[children.start - 1 : children.stop - 1]] - maxima[children]
        out.maxima[:-1] = maxima
        return out

    def search(self, rows: np.ndarray, weights: np.ndarray, n_columns: int, top: int = TOP, floor: int = 0, before: int | None = None) -> list[tuple[int, int]]:
        """``(score, column)`` of the ``top`` columns with the largest sum of weight times impact over ``rows``.

        Only scores above ``floor``, or equal to it where the column is less than ``before``; equal scores
        by smaller column.  The paths of all rows go down together: a range of columns has one node a
        row, its bound is the sum of their weighted maxima, and the ranges of the highest bounds
        are opened first, until no bound is left that could still enter the result.
        """
        best: list[tuple[int, int]] = []
        if not len(rows) or not self.none:
            return best
        before = 0 if before is None else before
        weights = weights[:, None]
        limit = floor, -before  # a range counts if (bound, -first column) is above it

        def counting(bounds: np.ndarray, columns: np.ndarray) -> np.ndarray:
            return (bounds > limit[0]) | ((bounds == limit[0]) & (columns < -limit[1]))

        root = np.zeros((len(rows), 1), np.int64)
        bound = (weights * self.maxima[root]).sum(0)
        heap = [(-int(bound[0]), 0, 0, 0, np.zeros(1, np.int64), root, bound)] if counting(bound, np.zeros(1, np.int64))[0] else []
        pushed = 1
        while heap:
            highest, _, _, level, starts, nodes, bounds = heapq.heappop(heap)
            if -highest < limit[0]:
                break
            still = counting(bounds, starts)
            if not still.all():
                starts, nodes, bounds = starts[still], nodes[:, still], bounds[still]
            if not len(starts):
                continue
            if len(starts) > WIDTH:
                rest = starts[WIDTH:], nodes[:, WIDTH:], bounds[WIDTH:]
                heapq.heappush(heap, (-int(rest[2][0]), int(rest[0][0]), pushed, level, *rest))
                pushed += 1
                starts, nodes = starts[:WIDTH], nodes[:, :WIDTH]
            down = self.height - 1 - level
            quarter = (rows >> down & 1)[:, None] * 2
            masks = self.masks[nodes]
            half = 1 << down
            to_nodes, to_bounds = [], []
            for q in (quarter, quarter + 1):
                child = np.where(masks >> q & 1, self.first[nodes] + _BELOW[masks, q], self.none)
                to_nodes.append(child)
                to_bounds.append((weights * self.maxima[child]).sum(0))
            starts = np.append(starts, starts + half)
            nodes, bounds = np.concatenate(to_nodes, 1), np.concatenate(to_bounds)
            good = counting(bounds, starts) & (bounds > 0) & (starts < n_columns)
            starts, bounds = starts[good], bounds[good]
            order = np.lexsort((starts, -bounds))
            if not len(order):
                continue
            if down:
                nodes = nodes[:, good][:, order]
                heapq.heappush(heap, (-int(bounds[order[0]]), int(starts[order[0]]), pushed, level + 1, starts[order], nodes, bounds[order]))
                pushed += 1
            else:
                best += [(int(bounds[i]), int(starts[i])) for i in order[:top]]
                best = sorted(best, key=lambda hit: (-hit[0], hit[1]))[:top]
                if len(best) == top:
                    limit = max(limit, (best[-1][0], -best[-1][1]))
        return best


def _bare(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def totals(docs: DataFrame) -> tuple[int, int]:
    """How many rows hold a term, and how many terms, repeats counted, all rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                held = np.diff(words(part)[2])
                n, terms = n + int((held > 0).sum()), terms + int(held.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "terms": [terms]})

    row = _bare(docs).select("text").mapInArrow(run, fields(n="bigint", terms="bigint")).agg(F.sum("n"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term found ``tf`` times in a document of ``length`` terms counts, before the term's weight."""
    m = 100 - 50 + (50 * length * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """One row a block of documents: ids in ascending order, terms by descending frequency, frequencies, and the treap.

    A block is made of consecutive rows of one partition, so nothing is shuffled; every row of ``docs``
    is in one block.  The index holds all terms, whatever is searched for.
    """
    schema = fields(doc_ids="array<bigint>", terms="array<string>", df="array<bigint>", treap="binary")

    def block(ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
        order = pc.sort_indices(ids, null_placement="at_end")
        known, codes, offsets = words(text.take(order))
        length = np.diff(offsets)
        cells, tf = np.unique(codes * len(text) + np.repeat(np.arange(len(text)), length), return_counts=True)
        term, column = np.divmod(cells, len(text))
        df = np.bincount(term, minlength=len(known))
        by_df = np.argsort(-df, kind="stable")
        place = np.empty_like(by_df)
        place[by_df] = np.arange(len(by_df))
        made = Treap.build(place[term], column, impacts(tf, length[column], n_docs, n_terms))
        lists = ids.take(order), known.take(pa.array(by_df)), pa.array(df[by_df])
        columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
        return pa.RecordBatch.from_arrays([*columns, pa.array([made.dumps()], pa.binary())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array]] = []
        rows = size = 0

        def whole() -> pa.RecordBatch:
            return block(*(pa.concat_arrays(c) for c in zip(*held, strict=True)))

        for batch in batches:
            for at, text in chunks(batch.column(1), BLOCK_BYTES, BLOCK_ROWS):
                more = pc.sum(pc.binary_length(text)).as_py() or 0
                if held and (rows + len(text) > BLOCK_ROWS or size + more > BLOCK_BYTES):
                    yield whole()
                    held, rows, size = [], 0, 0
                held.append((batch.column(0).slice(at, len(text)), text))
                rows, size = rows + len(text), size + more
        if held:
            yield whole()

    return _bare(docs).mapInArrow(run, schema)


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, once each; several rows of one item_id are one item, a null item_id is an item as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(1)):
                known, codes, offsets = words(part)
                owner = pa.array(at + np.repeat(np.arange(len(part)), np.diff(offsets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), known.take(pa.array(codes))], ["item_id", "term"])

    bare = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    return bare.mapInArrow(run, fields(item_id="bigint", term="string")).distinct()


def _hits(blocks: DataFrame, asked: list[tuple[int | None, bytes, int]], top: int) -> DataFrame:
    """``(item_id, doc_id, score, part)``: the best documents of each task for each item of ``asked(item, term, weight)``."""
    terms = sorted({t for _, t, _ in asked})
    at = {t: k for k, t in enumerate(terms)}
    items: dict[int | None, list[tuple[int, int]]] = {}
    for item, term, weight in asked:
        items.setdefault(item, []).append((at[term], weight))
    packed = [(item, np.array([k for k, _ in of]), np.array([w for _, w in of], np.int64)) for item, of in items.items()]
    known = blocks.sparkSession.sparkContext.broadcast((pa.array(terms, pa.binary()), packed))  # TERMS rows at most
    schema = fields(item_id="bigint", doc_id="bigint", score="bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, packed = known.value
        best: list[list[tuple[int, int | None]]] = [[] for _ in packed]
        last = float("inf")  # a null id comes after all others
        for batch in batches:
            for ids, held, stored in zip(*(batch.column(c) for c in ("doc_ids", "terms", "treap")), strict=True):
                treap = Treap.loads(stored.as_py())
                ids = ids.values
                keys = pc.fill_null(ids.cast(pa.float64()), last) if ids.null_count else ids
                found = pc.index_in(wanted, value_set=held.values.cast(pa.binary()))
                row_of = pc.fill_null(found, -1).to_numpy().astype(np.int64)
                for k, (_, of, weights) in enumerate(packed):
                    rows = row_of[of]
                    here = rows >= 0
                    floor, before = 0, None
                    if len(best[k]) == top:
                        floor, id_of_last = best[k][-1]
                        before = int(np.searchsorted(keys.to_numpy(zero_copy_only=False), last if id_of_last is None else id_of_last))
                    for score, column in treap.search(rows[here], weights[here], len(ids), top, floor, before):
                        best[k].append((score, ids[column].as_py()))
                    best[k].sort(key=lambda hit: (-hit[0], last if hit[1] is None else hit[1]))
                    del best[k][top:]
        out = [(item, doc, score) for (item, _, _), of in zip(packed, best, strict=True) for score, doc in of]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema.names)

    return blocks.select("doc_ids", "terms", "treap").mapInArrow(run, schema)


def search(blocks: DataFrame, items: DataFrame, n_docs: int, top: int = TOP, most_terms: int = TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item of ``items(item_id, text)`` in an ``index``.

    Items are taken in as many passes over the index as keep the terms of a pass below ``most_terms``,
    so what is sent to the tasks is bounded; an item with more terms than that has a pass of its own.
    """
    spark = blocks.sparkSession
    path = fresh_path(spark, "lexical-items")
    asked = item_terms(items)
    frequency = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    frequency = frequency.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    asked.join(frequency, "term").select("item_id", "term", weight.alias("weight")).write.parquet(path)
    asked = spark.read.parquet(path)
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-asked.count() // most_terms)))).alias("part")
    hits = None
    for row in asked.groupBy(part).agg(F.count("*")).orderBy("part").collect():
        terms = asked.where(part == row["part"]).select("item_id", F.col("term").cast("binary").alias("term"), "weight").collect()
        found = _hits(blocks, [(r["item_id"], bytes(r["term"]), r["weight"]) for r in terms], top)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], fields(item_id="bigint", rank="int", doc_id="bigint", score="bigint"))
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    first = hits.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order)))
    ranked = first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` rows of ``docs(doc_id, text)`` for each item with a score above 0.

    The index is written to the shared folder.  Equal scores go by ascending doc_id, null last; repeated
    rows are documents of their own.  Null, empty and blank texts hold no term: as documents they are never
    found and do not count, as items they find nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    n_docs, n_terms = totals(docs)
    path = fresh_path(spark, "lexical-index")
    index(docs, n_docs, n_terms).write.parquet(path)
    return search(spark.read.parquet(path), items, n_docs, top)
