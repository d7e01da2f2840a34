"""Words of whole texts through Arrow kernels, for the operators that count or index them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What stands between words once A-Z are lower-cased: every ASCII character but digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK = 16 << 20  # bytes of text that are split at once; a longer text is a chunk of its own


def chunks(text: pa.Array, most_bytes: int = CHUNK, most_rows: int = 1 << 30) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, rows)`` of consecutive pieces of a column that keep both bounds; no text is cut."""
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(text):
        done = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, done + most_bytes, side="right"))
        to = min(max(to, at + 1), at + most_rows)
        yield at, text.slice(at, to - at)
        at = to


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(distinct words, codes, offsets)``: row r holds ``distinct[codes[offsets[r]:offsets[r + 1]]]``.

    Words are the runs of anything but ``BREAKS`` in the text with A-Z lower-cased; other letters stay as
    they are.  A null text has none.
    """
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(text, "")), BREAKS)
    flat = pc.list_flatten(parts)
    filled = pc.greater(pc.binary_length(flat), 0)  # a break at either end leaves an empty piece
    before = np.append(0, np.cumsum(filled.to_numpy(zero_copy_only=False), dtype=np.int64))
    offsets = before[parts.offsets.to_numpy()]
    coded = pc.dictionary_encode(pc.filter(flat, filled))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), offsets
