"""Token counts of a unigram model, computed once for each shared prefix of the words of a batch."""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

from .shared import fields

# How the vocabulary's makers split text before tokens (a fixed value of that vocabulary).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pre-tokens whose counts a worker remembers.
CACHED = 1_000_000
LONG = 256
_POOL = 1_000_000  # characters whose pre-tokens share a trie


class Unigram:
    """Pieces with log probabilities.

    The vocabulary gives ranks, most frequent first, and no probabilities: a piece of rank r is taken to
    have the frequency 1 / (r + 2), scaled to sum to one.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        total = math.log(sum(1 / (r + 2) for r in ranks.values())) if ranks else 0.0
        self.scores = {piece: -math.log(r + 2) - total for piece, r in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.unknown = min(self.scores.values(), default=0.0) - 10.0  # of a byte that is no piece

    def step(self, tail: bytes, best: list[float], count: list[int]) -> tuple[float, int]:
        """Best score up to the end of ``tail``, and the number of pieces; of equal scores the longest last piece.

        ``best`` and ``count`` hold what is known of all positions before the last byte.
        """
        top, n = -math.inf, 0
        size = len(tail)
        for back in range(min(size, self.longest), 0, -1):
            score = self.scores.get(tail[size - back :])
            if score is None:
                if back > 1:
                    continue
                score = self.unknown
            if best[-back] + score > top:
                top, n = best[-back] + score, count[-back] + 1
        return top, n

    def alone(self, word: bytes) -> tuple[int, float]:
        """(pieces, score) of one word."""
        best, count = [0.0], [0]
        for end in range(1, len(word) + 1):
            score, n = self.step(word[max(0, end - self.longest) : end], best, count)
            best.append(score)
            count.append(n)
        return count[-1], best[-1]


def trie(words: list[bytes]) -> dict:
    """Nested nodes by byte; a word ends in a node where the key -1 gives its place in the list."""
    root: dict = {}
    for i, word in enumerate(words):
        node = root
        for byte in word:
            node = node.setdefault(byte, {})
        node[-1] = i
    return root


def forward(words: list[bytes], model: Unigram) -> list[tuple[int, float]]:
    """(pieces, score) of each of the distinct words by dynamic programming down their trie.

    The forward scores of a node serve all words below it; terminal nodes store the counts.  A word longer
    than ``LONG`` bytes has little to share and much to store: it is scored by itself, the same way.
    """
    out: list[tuple[int, float]] = [model.alone(w) if len(w) > LONG else (0, 0.0) for w in words]
    path = bytearray()
    best, count = [0.0], [0]
    # (node, byte that leads to it, depth): depth first, so that the lists hold the scores of one path
    stack: list[tuple[dict, int, int]] = [(trie([w if len(w) <= LONG else b"" for w in words]), -1, 0)]
    while stack:
        node, byte, depth = stack.pop()
        if depth:
            del path[depth - 1 :], best[depth:], count[depth:]
            path.append(byte)
            score, n = model.step(bytes(path[-model.longest :]), best, count)
            best.append(score)
            count.append(n)
        for key, child in node.items():
            if key == -1:
                if depth:
                    out[child] = (count[depth], best[depth])
            else:
                stack.append((child, key, depth + 1))
    return out


@cache
def model(path: str) -> Unigram:
    with open(path, "rb") as f:
        return Unigram({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens, score)`` of each row of ``docs(doc_id, text)``.

    ``vocabulary`` is a file of base64 pieces and ranks on every machine.  A text is split into pre-tokens;
    the distinct ones of a pool of documents go through one trie, and what it finds is remembered up to a
    bound.  Nothing is shuffled.  Null and empty texts have no tokens and score 0; repeated rows are treated
    alike; a null doc_id is kept; other columns are ignored.
    """
    split = regex.compile(SPLIT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, float]] = {}
        unigram = model(vocabulary)
        for batch in batches:
            ids, held, size = [], [], 0
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids.append(doc_id)
                held.append(Counter(split.findall(text or "")))
                size += len(text or "")
                if size >= _POOL:
                    yield rows(ids, held, known, unigram)
                    ids, held, size = [], [], 0
            if ids:
                yield rows(ids, held, known, unigram)

    def rows(ids: list, held: list[Counter], known: dict, unigram: Unigram) -> pd.DataFrame:
        needed = set().union(*held)
        new = sorted(needed.difference(known))
        if len(known) + len(new) > CACHED:
            known.clear()
            new = sorted(needed)
        known.update(zip(new, forward([w.encode("utf-8", "replace") for w in new], unigram), strict=True))
        out = []
        for doc_id, found in zip(ids, held, strict=True):
            tokens, score = 0, 0.0
            for word, n in found.items():
                t, s = known[word]
                tokens += n * t
                score += n * s
            out.append((doc_id, sum(found.values()), tokens, score))
        return pd.DataFrame(out, columns=["doc_id", "n_pretokens", "n_tokens", "score"]).astype({"doc_id": "Int64"})

    bare = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return bare.mapInPandas(run, fields(doc_id="bigint", n_pretokens="bigint", n_tokens="bigint", score="double"))
