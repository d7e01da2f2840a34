"""Packing of token ids into sequences of a fixed length, balanced by estimated attention cost."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import fields

LENGTH = 2048
END = 1  # the id that closes a document
# Tokens that are packed together: bounds the memory of a task, whatever the size of its partition.
POOL = 2_000_000
# Cost of a piece of n tokens: n for the dense layers and n * n / LENGTH for attention.
QUADRATIC = 1.0 / LENGTH
CACHED = 300_000  # words whose ids a worker remembers in each of two generations

# White space of the tokenizer's splitting rule but for space and line end (fixed values: the Unicode
# property White_Space), and pairs of those two.
_OTHER = "\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_DOUBLE = ("  ", " \n", "\n ", "\n\n")
_SPACE = "\n " + _OTHER
# Pieces no token crosses: white space before its last character, then a word with one space before it.
_CHUNK = re.compile(f"[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]+")
# Byte-level vocabularies spell a byte by its own character if that is visible, else by one above 255.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLED = {b: 0x100 + i for i, b in enumerate(sorted(set(range(0x100)) - set(_SEEN)))}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    No token of a byte-level BPE with this splitting rule crosses the start of a word's leading space or a
    line end, so words are encoded once each and remembered, the latest ones of a bounded number.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # by word after a space, or by line end and word
        self.older: dict[str, bytes] = {}
        self.merges = self.tokenizer.model
        self.line_end = self._ids("\n").tobytes()
        self.stops = {c: self._ids(c).tobytes() for c in ".,"}
        # Tokens found in a text before it is split into words.
        whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("(" + "|".join(map(re.escape, whole)) + ")") if whole else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str) -> bytes:
        if self.whole and self.whole.search(text):
            return b"".join(map(self._plain, self.whole.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if any(c in text for c in _OTHER) or any(c in text for c in _DOUBLE) or text[0] in " \n" or text[-1] in " \n":
            return b"".join(self._ids(c).tobytes() for c in _CHUNK.findall(text))
        first, *words = text.replace("\n", " \n").split(" ")
        needed = set(words)
        new = needed.difference(self.known)
        if new:
            if len(self.known) > CACHED:
                self.known, self.older = {}, self.known
                new = needed
            for word in new:
                self.known[word] = self.older.get(word) or self._word(word)
        return self._ids(first).tobytes() + b"".join(map(self.known.__getitem__, words))

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space, or after the line end it starts with.

        A word of letters is one piece of the splitting rule, and so is a full stop or comma behind it; such a
        piece goes straight to the merges.
        """
        if word[0] == "\n":
            return self.line_end + (self._letters(word[1:]) if word[1:].isalpha() else self._ids(word[1:]).tobytes())
        if word.isalpha():
            return self._letters(" " + word)
        if word[-1] in self.stops and word[:-1].isalpha():
            return (self.known.get(word[:-1]) or self._letters(" " + word[:-1])) + self.stops[word[-1]]
        return self._ids(" " + word).tobytes()

    def _letters(self, piece: str) -> bytes:
        spelled = piece.encode("utf-8").decode("latin-1").translate(_SPELLED)
        return np.array([t.id for t in self.merges.tokenize(spelled)], "<u4").tobytes()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def assign(lengths: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents with these token counts.

    There are as many sequences as the tokens need.  The longest rest of a document goes to the sequence
    of lowest cost that has capacity left; what does not fit goes on as a rest of its own.  All sequences
    but at most one are full at the end.  Ties go to the earlier document and sequence.
    """
    total = sum(lengths)
    full, last = divmod(total, LENGTH)
    # (cost, sequence); the last sequence has only the capacity that is needed.
    open_ = [(0.0, k) for k in range(full + (last > 0))]
    room = [LENGTH] * full + [last] * (last > 0)
    size = list(room)
    rests = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(rests)
    out = []
    while rests:
        negative, doc, start = heapq.heappop(rests)
        cost, seq = heapq.heappop(open_)
        n = min(-negative, room[seq])
        out.append((doc, start, n, seq, size[seq] - room[seq]))
        room[seq] -= n
        if room[seq]:
            heapq.heappush(open_, (cost + n + QUADRATIC * n * n, seq))
        if n < -negative:
            heapq.heappush(rests, (negative + n, doc, start + n))
    return out


def pack(docs: DataFrame, tokenizer: str, pool: int = POOL) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: where each run of ids lies in which sequence.

    A document is the ids of its text and then ``END``; a null text is empty.  Each partition is packed in
    pools of about ``pool`` tokens as it streams through, so nothing is shuffled and memory is bounded; a
    pool leaves at most one sequence short.  ``sequence_id`` is the partition number and a running number
    in it: unique in one run, the same when a lost task is repeated.  Repeated rows are packed as often as
    they occur; a null doc_id is kept.  Other columns are ignored; an empty table has no pieces.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = fields(**dict.fromkeys(names, "bigint"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        close = np.array([END], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 32
        waiting: list[tuple[object, bytes]] = []
        tokens = 0

        def flush() -> pd.DataFrame:
            nonlocal base, tokens
            pieces = assign([len(ids) // 4 for _, ids in waiting])
            rows = [
                (doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + seq, offset)
                for d, start, n, seq, offset in pieces
                for doc_id, ids in (waiting[d],)
            ]
            base += -(-tokens // LENGTH)
            tokens = 0
            waiting.clear()
            return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = encode(text or "") + close
                waiting.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= pool:
                    yield flush()
        if waiting:
            yield flush()

    bare = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return bare.mapInPandas(run, schema)
