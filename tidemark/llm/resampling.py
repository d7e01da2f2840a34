"""Importance resampling towards a target distribution, with the text work in Arrow kernels."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import chunks, words
from .shared import checkpointed, fields

BUCKETS = 10_000
LONGEST = 1  # words of the longest feature
LEAST = 20  # words of a document that can be drawn
PERCENT = 10
SEED = 2024


def _gathered(text: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bucket of each feature, offsets by row)`` for runs of 1, 2, ... ``longest`` words of one chunk.

    Only distinct runs are hashed: a run of n words is the pair of the run of its first n - 1 words and
    its last word, and its checksum goes on from that of the shorter run.
    """
    known, codes, offsets = words(text)
    raw = [w.as_buffer().to_pybytes() for w in known.cast(pa.binary())]
    checks = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))
    runs, of = codes, offsets
    for n in range(1, longest + 1):
        if n > 1:
            # Runs that start at a word: those of n - 1 words, but for the last of every row.
            length = np.maximum(np.diff(of) - 1, 0)
            starts = np.repeat(of[:-1] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
            ends = np.repeat(offsets[:-1] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum()) + n - 1
            pairs, runs = np.unique(runs[starts] * len(raw) + codes[ends], return_inverse=True)
            heads, tails = np.divmod(pairs, max(len(raw), 1))
            checks = np.fromiter((zlib.crc32(b" " + raw[t], int(checks[h])) for h, t in zip(heads, tails, strict=True)), np.int64, len(pairs))
            of = np.append(0, np.cumsum(length))
        yield (checks % buckets)[runs], of


def _texts(table: DataFrame) -> DataFrame:
    return table.select(table["text"].cast("string").alias("text"))


def counts(table: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of all features of ``table(text)``, repeats counted.  One row a task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                for bucket, _ in _gathered(part, longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return _texts(table).mapInArrow(run, fields(bucket="bigint", n="bigint")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket how much likelier the target makes it, in thousandths of a natural logarithm, floored.

    Both sides are smoothed by one feature a bucket.  There are ``buckets`` numbers, whatever the input.
    """
    both = counts(docs, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(counts(target, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of each row: the floored mean of the gains of its features."""
    known = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    schema = fields(doc_id="bigint", n_words="bigint", n_features="bigint", weight="bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(1)):
                n, total, n_words = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), None
                for bucket, offsets in _gathered(part, longest, len(known.value)):
                    sums = np.append(0, np.cumsum(known.value[bucket]))
                    total += sums[offsets[1:]] - sums[offsets[:-1]]
                    n += np.diff(offsets)
                    n_words = np.diff(offsets) if n_words is None else n_words
                mean = np.floor_divide(total, np.maximum(n, 1))
                ids = batch.column(0).slice(at, len(part))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n_words, n, mean))], schema.names)

    bare = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return bare.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored; it depends on the id and the seed only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_features, weight, score, and its rank if it is drawn.

    The highest scores, weight plus noise, are a draw without replacement by importance towards
    ``target(text)``.  Of the documents with ``least`` words or more ``percent`` per cent are drawn, ranked from
    1; equal scores by smaller doc_id, null last.  Null and empty texts have no feature and weight 0.  A
    null doc_id counts as the empty text in the noise.  Repeated rows each have a score and may each be drawn;
    rows of one score and doc_id are ranked by their place in the stored table.  Other columns are ignored.  An
    empty target or corpus is smoothed like any other.

    Scores are whole numbers in a range that does not grow with the data (gains and noise are logarithms
    of 64-bit numbers, in thousandths), so the cut is found in their histogram.  Only the rows above it are
    ordered, by ranges of score, id and row: no range hangs on a single score or id.
    """
    scored = weights(docs, gains(docs, target, longest, buckets), longest)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = checkpointed(scored)
    can = F.col("n_words") >= least
    histogram = sorted(((r["score"], r["n"]) for r in scored.where(can).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in histogram) // 100
    seen, cut = 0, None
    for score, n in histogram:
        if seen >= drawn:
            break
        seen, cut = seen + n, score
    high = can & (F.col("score") >= cut) if cut is not None else F.lit(False)
    rest = scored.where(~high).withColumn("rank", F.lit(None).cast("long"))
    keys = F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")
    # The number of a row counts on from the start of its range, which the upper bits tell.
    ordered = scored.where(high).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ordered = checkpointed(ordered).withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    # One row a partition.
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("at") + 1
    ranked = ordered.join(F.broadcast(starts), "part").withColumn("rank", F.when(place <= drawn, place))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


def draw(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, with all their columns; a null doc_id is never among them."""
    ids = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == F.col("_drawn"), "left_semi")
