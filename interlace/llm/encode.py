"""Exact tokenizer encoding with a cache of segments.

A BPE tokenizer never joins text across the boundary between a word and the white space after it, nor between a letter
or digit and the ASCII punctuation after it, so a text's ids are those of its segments one after another. A batch of
texts is cut into segments by array operations over its bytes, each distinct segment is looked up or encoded once, and
the ids are gathered into place. The ids are the library's own.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WORKER_STATE
from .words import GROUP_BYTES, LOWER, SPACE, bytes_of, groups

#: Segments that a worker's cache holds at most before it starts again, and the longest that is kept (in characters).
CACHE_SEGMENTS, CACHE_CHARS = 1_500_000, 60
#: Segments that one call of the library encodes.
CALL_SEGMENTS = 1000

_ASCII = [chr(c) for c in range(33, 127)]
_CUT, _BEFORE, _LEAD = (np.zeros(256, bool) for _ in range(3))
#: Punctuation that starts a segment after a letter or digit: not the apostrophe, with which contractions begin.
_CUT[[ord(c) for c in _ASCII if not c.isalnum() and c != "'"]] = True
#: What may end a letter or digit: ASCII ones, and the second byte of a letter from U+00C0 to U+00FF.
_BEFORE[[ord(c) for c in _ASCII if c.isalnum()]] = True
_BEFORE[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_LATIN = 0xC3
#: First bytes of characters that a tokenizer may take for white space though no segment is cut there: such texts go whole.
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Ids of texts under one tokenizer file, as unsigned 32-bit numbers."""

    def __init__(self, path: str, drops_space: bool) -> None:
        """drops_space: the tokenizer ignores white space but for splitting at it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drops_space = drops_space
        letters = "".join(map(chr, range(65, 91)))
        self.lowers = bool((self.whole(letters) == self.whole(letters.lower())).all()) if drops_space else False
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.n_ids = np.empty(1 << 16, np.uint32), 0
        self.first, self.n_slots = np.zeros(1 << 15, np.int64), 0  # where the ids of each slot begin, and their end

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, segments: list[str]) -> None:
        """Append the ids of the segments to the store, one slot for each."""
        for lo in range(0, len(segments), CALL_SEGMENTS):
            part = segments[lo : lo + CALL_SEGMENTS]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, sizes = np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(part))
            while self.n_ids + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            while self.n_slots + len(part) >= len(self.first):
                self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.first[self.n_slots + 1 : self.n_slots + len(part) + 1] = self.n_ids + np.cumsum(sizes)
            self.n_ids, self.n_slots = self.n_ids + len(ids), self.n_slots + len(part)

    def _slots(self, segments: list[str]) -> tuple[np.ndarray, tuple[int, int]]:
        """The slot of each of the distinct segments, and the store's size without those that are not kept."""
        slots = np.fromiter(map(self.slot.get, segments, repeat(-1)), np.int64, len(segments))
        missing = np.flatnonzero(slots < 0)
        if len(missing) and len(self.slot) + len(missing) > CACHE_SEGMENTS:
            self._clear()
            missing = np.arange(len(segments))
        short = np.array([len(segments[i]) <= CACHE_CHARS for i in missing.tolist()], bool)
        keep, passing = ([segments[i] for i in at.tolist()] for at in (missing[short], missing[~short]))
        slots[missing[short]] = np.arange(self.n_slots, self.n_slots + len(keep))
        self.slot.update(zip(keep, range(self.n_slots, self.n_slots + len(keep))))
        self._add(keep)
        size = self.n_slots, self.n_ids
        slots[missing[~short]] = np.arange(self.n_slots, self.n_slots + len(passing))
        self._add(passing)
        return slots, size

    def _cut(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where segments begin in the bytes of texts that begin at `begins` (with the end of the last)."""
        space, cut = SPACE[data], np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        at = np.flatnonzero(_CUT[data])
        at = at[at > 1]
        last = data[at - 1]
        cut[at[_BEFORE[last] & ((last < 0x80) | (data[at - 2] == _LATIN))]] = True
        cut[begins] = True
        return np.flatnonzero(cut).astype(np.int32)

    def _group(self, texts: pa.StringArray) -> list[np.ndarray]:
        data, begins = bytes_of(texts)
        if not len(data):
            return [np.empty(0, np.uint32)] * len(texts)
        if self.lowers:
            data = LOWER[data]
        starts = self._cut(data, begins)
        segments = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        slots, (n_slots, n_ids) = self._slots(segments.dictionary.to_numpy(zero_copy_only=False).tolist())
        slots = slots[segments.indices.to_numpy()]
        first = self.first[slots]
        sizes = self.first[slots + 1] - first
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.n_slots, self.n_ids = n_slots, n_ids
        return np.split(ids, np.r_[0, ends][np.searchsorted(starts, begins[1:-1])])

    def encode_array(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids of each text in their order; none for an empty or null one. Long arrays are encoded in groups."""
        for group in groups(texts, GROUP_BYTES):
            if self.drops_space or not _LEAD[bytes_of(group)[0]].any():
                yield from self._group(group)
                continue
            odd = pc.match_substring_regex(group, _ODD)
            plain = iter(self._group(group.filter(pc.invert(odd))))
            yield from (self.whole(t.as_py()) if o else next(plain) for t, o in zip(group, odd.to_pylist()))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers in bytes."""
        return [ids.astype("<u4").tobytes() for ids in self.encode_array(pa.array(texts, pa.string()))]


def worker_encoder(path: str, drops_space: bool) -> Encoder:
    """The encoder of this worker process: Spark gives a process one task after another, and they find a warm cache."""
    held = sys.modules.setdefault(WORKER_STATE, types.ModuleType(WORKER_STATE)).__dict__
    key = ("encoder", path, drops_space)
    if key not in held:
        held[key] = Encoder(path, drops_space)
    return held[key]
