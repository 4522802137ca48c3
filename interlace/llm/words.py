"""Words of whole batches by array operations over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: White space of the contracts: the bytes 9 to 13 and 32. Words are what lies between.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A to Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of texts that are handled at once; a longer text is handled by itself.
GROUP_BYTES = 8 << 20


def ranges(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to limit at most; a larger one is a range of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield start, stop
        start = stop


def bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts (none null) and where each begins in them, with the end of the last."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def groups(texts: pa.StringArray, limit: int = GROUP_BYTES) -> Iterator[pa.StringArray]:
    """The texts in slices of about limit bytes, nulls as empty texts."""
    texts = pc.fill_null(texts, "")
    if len(texts):
        for a, b in ranges(np.diff(bytes_of(texts)[1]), limit):
            yield texts[a:b]


def word_hashes(texts: pa.StringArray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 (seed 42) of all words of the texts, and where those of each text begin, with the end of the last.

    fold: A to Z count as lower case. Each distinct word is hashed once.
    """
    data, begins = bytes_of(texts)
    if fold:
        data = LOWER[data]
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = begins[:-1][begins[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.append(np.flatnonzero(first[inside]), inside.sum()).astype(np.int32)
    if len(starts) == 1:
        return np.empty(0, np.uint64), np.zeros(len(begins), np.int64)
    words = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data[inside])]).dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, 42) for w in distinct), np.uint64, len(distinct))
    return hashes[words.indices.to_numpy()], np.searchsorted(np.flatnonzero(first), begins)
