"""Words of Arrow texts by array operations: no string is made for a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that part words: ASCII white space.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large_binary array."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(texts: pa.Array, space: np.ndarray = SPACE, changed: np.ndarray | None = None, tail: int = 0) -> tuple[pa.Array, np.ndarray]:
    """(words as large_binary, words of each text): maximal runs of bytes that ``space`` does not mark.  Null is
    empty.  ``changed`` maps each byte; ``tail``: 1 for a space behind every word."""
    data, offsets = spelled(pc.fill_null(texts, "").cast(pa.large_binary()))
    data = data if changed is None else changed[data]
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last)
    ends = np.concatenate([[0], np.cumsum(stop + 1 - begin + tail)]).astype(np.int64)
    out = data[inside]
    if tail:
        spaced, of_word = np.full(int(ends[-1]), 32, np.uint8), np.ones(int(ends[-1]), bool)
        of_word[ends[1:] - 1] = False
        spaced[of_word] = out
        out = spaced
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out))])
    return words, np.diff(np.searchsorted(begin, offsets))
