"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_ids, checkpointed, fields

SAMPLE = 5_000  # labelled documents of each of the two folds that are learned from
WINDOW = 48  # bytes of a window; it ends at a space where there is one
COMMON = 12_000  # bytes of ordinary text that both dictionaries share
OWN = 1_200  # bytes at most that are only in one of them
CONTRAST = 20.0  # log-likelihood ratio from which a beginning of a word is telling
FEWEST = 4  # toxic documents that have to hold it
PARTS = 4  # of the labelled documents in the calibration
THRESHOLD = 0.7
_BEGINNINGS = range(4, 14)


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in pieces of at most ``size`` bytes, cut before spaces where possible."""
    out, i, n = [], 0, len(text)
    while i < n:
        j = text.rfind(b" ", i + 1, i + size) if i + size < n else n
        if j <= i:
            j = min(n, i + size)
        out.append(text[i:j])
        i = j
    return out


def _plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


@dataclass
class Dictionaries:
    """The two dictionaries: common text, then what is telling for one class."""

    ordinary: bytes
    toxic: bytes

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(
            window_log=16, hash_log=14, chain_log=14, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        known = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(compression_params=how, dict_data=known)

    @cached_property
    def _pair(self) -> tuple:
        return self._compressor(self.ordinary).compress, self._compressor(self.toxic).compress

    def distances(self, text: str | None) -> np.ndarray:
        """For each window the bytes that the toxic dictionary saves against the ordinary one."""
        ordinary, toxic = self._pair
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(_plain(text))], np.int64)

    def features(self, text: str | None) -> list[float]:
        """How many windows save how much: counts, shares, the best windows, the length."""
        d = self.distances(text)
        if not len(d):
            d = np.zeros(1, np.int64)
        n, best = len(d), np.sort(d)[::-1]
        gains = np.array([*((d == k).sum() for k in (1, 2, 3, 4)), (d >= 5).sum(), (d >= 6).sum()])
        losses = np.array([(d <= -1).sum(), (d <= -3).sum()])
        over = np.maximum(d - 2, 0)
        return [
            *np.log1p(gains), *gains / n, *losses / n, float(best[0]), best[:3].mean(), best[:6].mean(), over.mean(),
            float(over.sum()) ** 0.5, math.log(n),
        ]


WIDTH = 20


@dataclass
class Model:
    dictionaries: Dictionaries
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of feature rows."""
        z = ((rows - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bare(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3: fold 1 is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))) % 3


def _beginnings(table: DataFrame) -> list[list[bytes]]:
    """Beginnings of words that toxic documents of ``table(text, toxic, part)`` hold far more often.

    One list for each part, from the documents of the other parts, and one from all of them; the most telling
    come first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count: Counter[tuple[bytes, int, int]] = Counter()
            for text, toxic, part in zip(batch["text"], batch["toxic"], batch["part"], strict=True):
                held = set()
                for word in set(_plain(text).split()):
                    word = b" " + word[: _BEGINNINGS.stop] + b" "
                    held.update(word[:n] for n in _BEGINNINGS if n <= len(word))
                count.update((g, part, toxic) for g in held)
            rows = [(g, part, (1 - toxic) * n, toxic * n) for (g, part, toxic), n in count.items()]
            yield pd.DataFrame(rows, columns=["start", "part", "a", "b"])

    per = {(r["toxic"], r["part"]): r["n"] for r in table.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()}
    counted = table.mapInPandas(run, fields(start="binary", part="bigint", a="bigint", b="bigint")).groupBy("start")
    ways = range(PARTS + 1)  # the last one leaves no part out
    sums = [F.sum(F.when(F.col("part") != k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in ways for c in "ab"]
    rows = counted.agg(*sums)
    for k in ways:
        whole = [sum(n for (toxic, part), n in per.items() if toxic == t and part != k) for t in (0, 1)]
        share = whole[1] / sum(whole) if all(whole) else 1.0
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        ordinary = F.when(a > 0, a * F.log(a / ((a + b) * (1 - share)))).otherwise(0.0) if share < 1 else F.lit(0.0)
        ratio = 2 * (b * F.log(b / ((a + b) * share)) + ordinary)
        rows = rows.withColumn(f"g{k}", F.when((b >= FEWEST) & (b > (a + b) * share) & (ratio > CONTRAST), ratio))
    best = F.greatest(*[F.coalesce(f"g{k}", F.lit(0.0)) for k in ways])
    # OWN bytes hold fewer entries than that: the list is bounded by the size of the dictionaries.
    telling = rows.where(best > 0).orderBy(best.desc(), "start").limit(OWN * len(ways)).collect()
    return [
        [bytes(r["start"]) for r in sorted((r for r in telling if r[f"g{k}"]), key=lambda r: (-r[f"g{k}"], -len(r["start"]), bytes(r["start"])))]
        for k in ways
    ]


def _trained(size: int, samples: list[bytes], **how: int) -> bytes:
    """The content of a trained dictionary; with too few samples for training, the samples."""
    if size <= 0:
        return b""
    try:
        return zstandard.train_dictionary(max(size, 512), samples, **how).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


def _ordinary(table: DataFrame) -> tuple[bytes, bytes]:
    """Dictionary content of ordinary text: the common part, and what fills the place of the toxic part."""
    few = table.where("toxic = 0").select(F.xxhash64("text").alias("h")).orderBy("h").limit(1000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # A thousand documents, evenly spread windows of each: a bounded table.
            cut = [w[:: len(w) // 40 + 1] for w in (windows(_plain(t), 64) for t in batch["text"])]
            yield pd.DataFrame({"w": [x for w in cut for x in w]}, dtype=object)

    chosen = table.where("toxic = 0").join(F.broadcast(few), F.xxhash64("text") == F.col("h"), "left_semi")
    samples = sorted(bytes(r["w"]) for r in chosen.mapInPandas(run, fields(w="binary")).collect())
    np.random.default_rng(1).shuffle(samples)
    return _trained(COMMON, samples, k=64, d=8), _trained(OWN, samples[:20_000], k=16, d=6)


def dictionaries(starts: list[bytes], common: bytes, filler: bytes) -> Dictionaries:
    """Both dictionaries from telling beginnings of words, the most telling first, and ordinary text.

    What the labels tell apart are a few words, so toxic text is taken to be the word beginnings that
    toxic documents hold more often; the most telling stand last, where references are shortest.  The
    ordinary dictionary has ordinary text there.
    """
    own = b""
    for s in starts:
        if s not in own and len(own) + len(s) <= OWN:
            own = s + own
    return Dictionaries(common + (filler[-len(own) :] if own else b""), common + own)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Dictionaries from the labelled documents of folds 0 and 2, and thresholds calibrated on the same.

    ``labels(doc_id, toxic)``; of each fold at most ``sample`` labelled documents are used, the smallest by
    hash of doc_id.  For the calibration the documents are cut into ``PARTS`` by their text, and each part is
    measured with a toxic dictionary made from the others.  Labels other than 0 and 1 are ignored.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("toxic IN (0, 1)").distinct()

    def of(k: int) -> DataFrame:
        of_fold = known.where(fold(F.col("doc_id")) == k)
        few = of_fold.join(F.broadcast(bounded_ids(of_fold, "doc_id", sample)), "doc_id", "left_semi")
        # At most two rows for each of ``sample`` ids are sent around.
        return _bare(docs).join(F.broadcast(few), "doc_id").select("text", "toxic")

    part = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(PARTS)).alias("part")
    # Equal texts count once for each label.
    table = checkpointed(of(0).unionByName(of(2)).select("text", "toxic", part).distinct())
    common, filler = _ordinary(table)
    *made, final = [dictionaries(starts, common, filler) for starts in _beginnings(table)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [made[k].features(t) for k, t in zip(batch["part"], batch["text"], strict=True)]
            yield pd.DataFrame({"toxic": batch["toxic"], "x": x})

    rows = table.mapInPandas(run, fields(toxic="int", x="array<double>")).collect()
    rows.sort(key=lambda r: (r["toxic"], r["x"]))
    x, y = np.array([r["x"] for r in rows]).reshape(-1, WIDTH), np.array([r["toxic"] for r in rows], np.float64)
    return calibrate(final, x, y)


def calibrate(made: Dictionaries, x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> Model:
    """Logistic regression on the features by Newton steps; without both classes the score is the share."""
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        bias = math.log((share + 1e-6) / (1 - share + 1e-6))
        return Model(made, np.zeros(WIDTH), np.ones(WIDTH), np.append(np.zeros(WIDTH), bias))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(WIDTH + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        curve = (z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return Model(made, mean, scale, w)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs(doc_id, text)``; the score is of the text only.

    Null and empty texts get the score of a text without telling windows.  Repeated rows are treated alike,
    a null doc_id is kept and counts as the empty text in the fold; other columns are ignored.
    """
    model_of = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = model_of.value
        return pd.Series(m.scores(np.array([m.dictionaries.features(t) for t in texts]).reshape(-1, WIDTH)))

    scored = _bare(docs).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), of("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
