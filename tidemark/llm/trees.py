"""Quality of a text by gradient-boosted trees over histograms of document statistics."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import repeated_words
from .shared import bounded_ids, fields

SAMPLE = 20_000  # labelled documents that are learned from, at most
BINS = 64
TREES = 120
DEPTH = 4
RATE = 0.1
RIDGE = 1.0  # added to the curvature of a leaf
LEAST = 5.0  # curvature a leaf has to have
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "longest_word", "distinct_words", "most_frequent_word",
    "echoed_words", "repeated_words", "repeated_lines", "log_lines", "line_words", "upper", "lower", "digits", "stops", "marks", "brackets",
    "other_signs", "spaces", "beyond_ascii", "entropy", "compressed", "words_upper", "words_signed", "words_doubly_signed",
)

_CLASSES = np.zeros(256, np.int64)  # of bytes, in the order of the shares from "upper" on
for _k, _held in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:?", b"!\"'-", b"()[]{}<>", b"#$%&*+/=@\\^_`|~", b"\t\n\x0b\x0c\r ", range(128, 256)), 1):
    _CLASSES[list(_held)] = _k
_SIGN_AT_END = re.compile(rb"[!-/:-@\[-`{-~]\s")
_SIGNS_AT_END = re.compile(rb"[!-/:-@\[-`{-~]{2,}\s")
_UPPER_WORD = re.compile(rb"(?<!\S)[^a-z\s\x80-\xff]*[A-Z][^a-z\s\x80-\xff]*(?!\S)")


def statistics(text: str | None) -> list[float]:
    """The numbers of ``STATISTICS`` of a whole text, all finite; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [math.log1p(len(raw))] + [0.0] * (len(STATISTICS) - 1)
    n, size = len(words), len(raw)
    lengths = np.fromiter(map(len, words), np.float64, n)
    count = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    held = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_CLASSES, weights=held, minlength=10)[1:] / size
    seen = held[held > 0] / size
    ended = raw + b" "
    return [
        math.log1p(size), math.log1p(n), lengths.mean(), lengths.std(), math.log1p(lengths.max()), len(count) / n, max(count.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, repeated_words(words) / n, 1 - len(set(lines)) / len(lines), math.log1p(len(lines)), math.log1p(n / len(lines)), *shares,
        float(-(seen * np.log2(seen)).sum()), len(zlib.compress(raw, 1)) / size, len(_UPPER_WORD.findall(raw)) / n,
        len(_SIGN_AT_END.findall(ended)) / n, len(_SIGNS_AT_END.findall(ended)) / n,
    ]


@dataclass
class Forest:
    """All nodes of all trees in flat arrays.

    A row goes from ``node`` to ``left[node]``, or the one after it where its value is above ``cut[node]``.  A leaf has
    an infinite cut and leads to itself, so every row takes ``depth`` steps.
    """

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of ``x`` reaches, in log odds; rows are taken in blocks of bounded size."""
        out = np.full(len(x), self.bias)
        for at in range(0, len(x) if len(self.roots) else 0, 4096):
            part = x[at : at + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = self.left[node] + (part[rows, self.feature[node]] > self.cut[node])
            out[at : at + 4096] += self.value[node].sum(1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each column the values that end its bins: some of those that occur, evenly by rank, never the largest."""
    out = []
    for column in x.T:
        ends = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))
        out.append(ends[ends < column.max()])
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Newton boosting of the logistic loss; every split is the best one between two bins of one column.

    Equal gains go to the first column and the lowest cut.  Without rows, or with one class only, there are
    no trees and the score is the (smoothed) share of ones.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = math.log(share / (1 - share))
    none = np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        return Forest(none, none, np.zeros(0), none, np.zeros(0), bias, depth)
    ends = edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(ends, x.T, strict=True)], 1)
    width, columns = bins, x.shape[1]
    flat = binned + np.arange(columns) * width
    # The last bin of a column has no cut after it.
    can = np.arange(width)[None, :] < np.array([len(e) for e in ends])[:, None]
    roots, feature, cut, left, value = [], [], [], [], []
    margin = np.full(len(y), bias)

    def node() -> int:
        feature.append(0), cut.append(np.inf), left.append(len(left)), value.append(0.0)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - y, p * (1 - p)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)))]
        for level in range(depth + 1):
            following = []
            for at, rows in open_nodes:
                g, h = slope[rows].sum(), curve[rows].sum()
                value[at] = -rate * g / (h + RIDGE)
                if level < depth and h >= 2 * LEAST:
                    keys = flat[rows].ravel()
                    sums = (np.bincount(keys, np.repeat(v[rows], columns), columns * width).reshape(columns, width).cumsum(1) for v in (slope, curve))
                    gl, hl = sums
                    gr, hr = g - gl, h - hl
                    gain = gl * gl / (hl + RIDGE) + gr * gr / (hr + RIDGE) - g * g / (h + RIDGE)
                    gain[~can | (hl < LEAST) | (hr < LEAST)] = 0.0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-9:
                        f, b = divmod(best, width)
                        feature[at], cut[at], left[at] = f, ends[f][b], node()
                        above = binned[rows, f] > b
                        following += [(left[at], rows[~above]), (node(), rows[above])]
                        continue
                margin[rows] += value[at]
            open_nodes = following
    arrays = (np.array(v) for v in (roots, feature, cut, left, value))
    return Forest(*arrays, bias, depth)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5: fold 0 is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))) % 5


def _bare(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees from the labelled documents outside fold 0.

    ``labels(doc_id, quality)``; at most ``sample`` labelled documents are used, the smallest by hash of doc_id, and
    only their statistics come to the driver.  Labels other than 0 and 1 and null ids are ignored; a document
    with both labels counts for each; repeated labels count once; equal statistics of one label count once,
    so that a large group of copies weighs no more than one document.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.where("quality IN (0, 1)").where(fold(F.col("doc_id")) != 0).distinct()
    few = known.join(F.broadcast(bounded_ids(known, "doc_id", sample)), "doc_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"quality": batch["quality"], "x": [statistics(t) for t in batch["text"]]})

    found = _bare(docs).join(F.broadcast(few), "doc_id").select("quality", "text").mapInPandas(run, fields(quality="int", x="array<double>"))
    rows = sorted((r["quality"], tuple(r["x"])) for r in found.distinct().collect())
    return boost(np.array([x for _, x in rows]).reshape(-1, len(STATISTICS)), np.array([q for q, _ in rows], np.float64))


def score(docs: DataFrame, model: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs(doc_id, text)``; the score is of the text only.

    Null, empty and blank texts get the score of their statistics, which are zero but for the length.  Repeated
    rows are treated alike, a null doc_id is kept and counts as the empty text in the fold; other columns are
    ignored.
    """
    model_of = docs.sparkSession.sparkContext.broadcast(model)  # at most TREES * 2 ** (DEPTH + 1) nodes

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
        return pd.Series(model_of.value.scores(x))

    scored = _bare(docs).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), of("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
        return pd.Series(model_of.value.scores(x) >= threshold)

    return docs.where(good(docs["text"].cast("string")))
