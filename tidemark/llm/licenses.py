"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from .shared import fields

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-4  # chance that a window with a match shares no band with its template
STEP = 1.5  # ratio of the sizes of neighbouring window classes
MOST = 10_000  # templates: they are held by every task
_POOL = 1_000_000  # words that are hashed together

# Notices as their licences word them (fixed values).
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}

_EDGES = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


def normal(word: bytes) -> bytes:
    """A lower-cased word without ASCII punctuation at its ends; one of punctuation only stays as it is."""
    return _EDGES.sub(b"", word) or word


class _Words(dict):
    """Hash of the normal form of each word seen; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(normal(word))
        return out


_HASHES = _Words()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ words[i : i + n] if n > 0 else out
    return _mixed(out)


@dataclass
class _Class:
    """Templates with shingles of k words that fit in a block of so many shingles, and their bands."""

    k: int
    block: int
    bands: int
    # For each band: which low 16 bits occur, and templates by value.
    marks: np.ndarray
    tables: list[dict[int, list[int]]]


class Index:
    """Templates by the MinHash values of their shingles.

    A template of n shingles belongs to the class of the smallest block C >= n.  A window is two blocks next
    to each other, so every stretch of n shingles lies in one.  If a window holds the share ``CONTAINMENT``
    of a template, its Jaccard similarity is at least 0.8 n / (2 C + 0.2 n); with one value a band, the class
    takes as many bands as make a miss rarer than ``MISS``.
    """

    def __init__(self, templates: dict[str, str]) -> None:
        if len(templates) > MOST:
            raise ValueError(f"at most {MOST} templates")
        self.names = [n for n in templates if words_of(templates[n])]
        self.shingles: list[set[tuple]] = []
        groups: dict[tuple[int, int], list[int]] = {}
        hashes: list[np.ndarray] = []
        for t, name in enumerate(self.names):
            words = words_of(templates[name])
            plain = [normal(w) for w in words]
            k = min(SHINGLE, len(words))
            self.shingles.append({tuple(plain[i : i + k]) for i in range(len(plain) - k + 1)})
            hashes.append(_shingle_hashes(np.array([_HASHES[w] for w in words], np.uint64), k))
            block, n = 1, len(hashes[-1])
            while block < n:
                block = math.ceil(block * STEP)
            groups.setdefault((k, block), []).append(t)
        self.classes = []
        for (k, block), members in sorted(groups.items()):
            least = min(len(self.shingles[t]) for t in members)
            similar = CONTAINMENT * least / (2 * block + (1 - CONTAINMENT) * least)
            bands = math.ceil(math.log(MISS) / math.log(1 - similar))
            marks, tables = np.zeros((bands, 1 << 16), bool), []
            for b in range(bands):
                table: dict[int, list[int]] = {}
                for t in members:
                    value = int(_band(hashes[t], b).min())
                    table.setdefault(value, []).append(t)
                    marks[b, value & 0xFFFF] = True
                tables.append(table)
            self.classes.append(_Class(k, block, bands, marks, tables))

    def scan(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, float, int, int]]:
        """``(text, template, containment, first word, last word)`` of the best window of each match.

        The texts are given as words; of equally good windows the first counts.
        """
        flat = np.fromiter((h for words in texts for h in map(_HASHES.__getitem__, words)), np.uint64)
        lengths = np.array([len(w) for w in texts])
        first_word = np.cumsum(lengths) - lengths
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for c in self.classes:
            n = np.maximum(lengths - c.k + 1, 0)
            if not n.sum():
                continue
            every = _shingle_hashes(flat, c.k)
            start = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(first_word - start, n)
            shingles = every[at]
            blocks = -(-n // c.block)
            owner = np.repeat(np.arange(len(texts)), blocks)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            cuts = start[owner] + number * c.block
            paired = np.append(owner[1:] == owner[:-1], False)
            candidates = set()
            for b in range(c.bands):
                low = np.minimum.reduceat(_band(shingles, b), cuts) if c.block > 1 else _band(shingles, b)
                after = np.append(low[1:], low[-1:])
                value = np.where(paired, np.minimum(low, after), low)
                for w in np.flatnonzero(c.marks[b][(value & np.uint64(0xFFFF)).astype(np.int64)]):
                    for t in c.tables[b].get(int(value[w]), ()):
                        candidates.add((int(w), t))
            for w, t in sorted(candidates):
                doc, i = int(owner[w]), int(number[w]) * c.block
                words = [normal(x) for x in texts[doc][i : i + 2 * c.block + c.k - 1]]
                held = [j for j in range(len(words) - c.k + 1) if tuple(words[j : j + c.k]) in self.shingles[t]]
                share = len({tuple(words[j : j + c.k]) for j in held}) / len(self.shingles[t])
                if share >= CONTAINMENT and share > best.get((doc, t), (0.0,))[0]:
                    best[(doc, t)] = (share, i + held[0], i + held[-1] + c.k - 1)
        for (doc, t), (share, a, z) in sorted(best.items()):
            yield doc, t, share, a, z


def _band(hashes: np.ndarray, b: int) -> np.ndarray:
    """The b-th hash function of shingles."""
    odd = np.uint64((0xD1342543DE82EF95 * (2 * b + 1)) % 2**64 | 1)
    return (hashes ^ np.uint64((0x2545F4914F6CDD1D * (b + 1)) % 2**64)) * odd


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, license, containment, first_word, last_word)``: the templates each row of ``docs`` holds.

    Words are lower-cased and lose punctuation at their ends; a template of fewer than five words is one
    shingle.  A row is a match of ``CONTAINMENT`` or more of a template's distinct shingles within a window
    of up to twice its size, with the span of its words there.  Null and empty texts match nothing; repeated
    rows give repeated results; a null doc_id is kept; other columns are ignored.  Nothing is shuffled: the
    templates, of bounded number, go to the documents.
    """
    known = NOTICES if templates is None else templates
    Index(known)  # a bad set of templates fails here, not in a task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(known)
        for batch in batches:
            texts, ids, size = [], [], 0
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                words = words_of(text)
                texts.append(words)
                ids.append(doc_id)
                size += len(words)
                if size >= _POOL:
                    yield rows(index, texts, ids)
                    texts, ids, size = [], [], 0
            if texts:
                yield rows(index, texts, ids)

    def rows(index: Index, texts: list[list[bytes]], ids: list) -> pd.DataFrame:
        found = [(ids[d], index.names[t], share, a, z) for d, t, share, a, z in index.scan(texts)]
        return pd.DataFrame(found, columns=list(schema.names)).astype({"doc_id": "Int64"})

    schema = fields(doc_id="bigint", license="string", containment="double", first_word="bigint", last_word="bigint")
    bare = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return bare.mapInPandas(run, schema)
