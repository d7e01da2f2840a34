"""Quality rules: line frequency across the documents of a host, with counts of words and repetition."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, content, fields

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
# Documents of a host, different in text, that may hold the same line: so many, and this share of the host's (per cent).
LINE_LIMIT = 5
LINE_SHARE = 5
SALTS = 64
# Share of the words of a document that has to remain once frequent lines are removed.
MIN_LEFT = 0.3
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent

_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) % 2**64 | 1 for i in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in an eight-word window occurring twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    ranks = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed += ranks[i : i + n] * _MULTIPLIERS[i]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():  # equal windows have equal sums
        return 0
    # Exact: number the windows of 2, 4 and 8 words by pairs of numbers of half the length.
    level, width = ranks.astype(np.int64), 1
    while width < WINDOW:
        pairs = level[:-width] * (int(level.max()) + 1) + level[width:]
        level, width = np.unique(pairs, return_inverse=True)[1], 2 * width
    again = np.bincount(level)[level] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def line_hash(parts: list[bytes]) -> int:
    """Of a normalised line, given by its lower-cased words; signed as in the tables."""
    h = xxhash.xxh64_intdigest(b" ".join(parts))
    return h - 2**64 if h >= 2**63 else h


def _parts(line: str) -> list[bytes]:
    return line.encode("utf-8", "replace").lower().split()


def without(text: str, removed: Collection[int]) -> str:
    """``text`` without the lines whose hash is in ``removed``; blank lines stay."""
    return "\n".join(line for line in text.split("\n") if not (parts := _parts(line)) or line_hash(parts) not in removed)


def _measure(text: str | None) -> tuple:
    """The base counts, and the distinct normalised lines with their words."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    seen: set[str] = set()
    duplicates = 0
    lines: dict[int, int] = {}
    for line in text.split("\n"):
        parts = _parts(line)
        if not parts:
            continue
        if line in seen:
            duplicates += 1
        else:
            seen.add(line)
        h = line_hash(parts)
        lines[h] = lines.get(h, 0) + len(parts)
    keys = np.fromiter(lines, np.int64, len(lines))
    weights = np.fromiter(lines.values(), np.int64, len(lines))
    return len(words), chars, len(SYMBOLS.findall(text)), duplicates, repeated_words(words), keys, weights


def _host(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def measures(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, content hash, and its lines as arrays ``(hash, words)``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line", "line_words"]
    schema = fields(
        doc_id="bigint", host="string", content="bigint", **dict.fromkeys(names[:5], "bigint"), line="array<bigint>", line_words="array<bigint>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_measure(t) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=names)
            yield pd.concat([batch[["doc_id", "host", "content"]], out], axis=1)

    bare = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        _host(docs).alias("host"),
        content(docs).alias("content"),
        docs["text"].cast("string").alias("text"),
    )
    return bare.mapInPandas(run, schema)


def assess(docs: DataFrame, line_limit: int = LINE_LIMIT, line_share: int = LINE_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: base counts, words left, and the verdict.

    A line is normalised (A-Z lower-cased, white space squeezed) and hashed.  For each host and line the
    documents with different texts are counted; copies of one document count once, so a large group of
    copies is not mistaken for boilerplate.  A line of more than ``line_limit`` such documents, and of more
    than ``line_share`` per cent of all different texts of the host, counts as removed from all of them but
    the first (smallest doc_id) and its copies; ``keep`` removes it.  A document of which less than ``min_left`` of the words remain is rejected, as is one that fails the
    base rules.

    Null and empty texts have no words and fail the base rules.  A null source is the host "".
    A null doc_id is kept as it is; repeated rows get the same verdict.  Other columns are ignored.
    """
    return _judged(docs, line_limit, line_share, min_left).drop("removed")


def _judged(docs: DataFrame, line_limit: int = LINE_LIMIT, line_share: int = LINE_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of ``assess`` with ``removed``, the hashes of the lines a text loses (null if none)."""
    m = checkpointed(measures(docs))
    lines = m.select("doc_id", "host", "content", F.explode(F.arrays_zip("line", "line_words")).alias("l")).select(
        "doc_id", "host", "content", F.col("l.line").alias("line"), F.col("l.line_words").alias("words")
    )
    per_text = lines.groupBy("host", "line", "content").agg(F.min("doc_id").alias("first"))
    # The texts of a host meet its lines in SALTS places, as one host may have most of the lines.
    sizes = m.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("of")).select("*", F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("salt"))
    per_line = (
        per_text.groupBy("host", "line")
        .agg(F.count("*").alias("texts"), F.min(F.struct("first", "content")).alias("first"))
        .where(F.col("texts") > line_limit)
        .withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int"))
        .join(sizes, ["host", "salt"])
        .where(100 * F.col("texts") > line_share * F.col("of"))
        .select("host", "line", F.col("first.content").alias("keeper"))
    )
    # A text's loss depends on its host and words only: repeated rows and copies share one row of it.
    distinct = lines.groupBy("host", "line", "content").agg(F.max("words").alias("words"))
    lost = (
        distinct.join(per_line, ["host", "line"])
        .where(F.col("content") != F.col("keeper"))
        .groupBy("host", "content")
        # Distinct lines of one text: no longer than the text itself.
        .agg(F.sum("words").alias("lost"), F.count("*").alias("n_lines_removed"), F.collect_list("line").alias("removed"))
    )
    out = m.drop("line", "line_words").join(lost, ["host", "content"], "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    return out.select(
        "doc_id",
        "host",
        "content",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.coalesce("n_lines_removed", F.lit(0)).cast("long").alias("n_lines_removed"),
        left.cast("long").alias("n_words_left"),
        base.alias("base_failed"),
        (~base & (left >= min_left * F.col("n_words"))).alias("kept"),
        "removed",
    )


def keep(docs: DataFrame, **rules: float) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns, without the frequent lines.

    Every occurrence of a line that counts as removed is cut from ``text``, and n_chars is brought up to
    date.  A verdict depends on the host and the text only, so it is joined by these: rows of one doc_id
    with different texts are judged apart.
    """
    good = _judged(docs, **rules).where("kept").groupBy("host", "content").agg(F.first("removed").alias("removed"))
    rows = docs.select(F.struct("*").alias("row"), _host(docs).alias("host"), content(docs).alias("content"))
    found = rows.join(good, ["host", "content"])

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without(t, {int(h) for h in r}) for t, r in zip(texts, removed, strict=True)], dtype=object)

    # Only the texts that lose a line go to Python.
    loses = F.col("removed").isNotNull()
    text = F.col("row").getField("text").cast("string")
    out = found.withColumn("_cut", cut(F.when(loses, text), F.col("removed")))
    new = {"text": F.when(loses, F.col("_cut")).otherwise(text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(loses, F.length("_cut").cast(kind)).otherwise(F.col("row").getField("n_chars"))
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
