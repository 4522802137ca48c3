import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from interlace.llm import bitplanes, encode, words

from .cases import LONG, documents, empty

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "a  b\n\n c\t\td ", " lead", "trail  ", "a  b  c", "x\x1cy \x85 z", LONG[:3000], "<|endoftext|> It's ÀÉ é ́x 12345 ---", "  \n \n x"]


@pytest.mark.parametrize("path, drops", [(BYTE, False), (WORD, True)])
@pytest.mark.parametrize("limit", [5, 1_000_000])
def test_segments_give_the_ids_of_the_library(path, drops, limit, monkeypatch):
    monkeypatch.setattr(encode, "CACHE_SEGMENTS", limit)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    encoder = encode.Encoder(path, drops)
    for _ in range(2):
        got = encoder.encode([*TEXTS, None])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in TEXTS] + [[]]


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (bitplanes.unpack(bitplanes.pack(ids, mode), n, mode) == ids).all()
    with pytest.raises(ValueError):
        bitplanes.unpack(bitplanes.pack(ids, mode)[1:], n, mode)


@pytest.mark.parametrize("mode, block", [("byte", 1 << 16), ("bit", 50)])
def test_documents_come_back(spark, monkeypatch, mode, block):
    monkeypatch.setattr(bitplanes, "BLOCK_IDS", block)
    docs = documents(spark, "again " * 60)
    tokenizer = Tokenizer.from_file(BYTE)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = bitplanes.documents_of(bitplanes.write(docs, BYTE, mode=mode)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert bitplanes.documents_of(bitplanes.write(empty(spark), BYTE)).count() == 0


@pytest.mark.parametrize("path, drops", [(BYTE, False), (WORD, True)])
@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abIKZsé×÷ÿß€—“’'\"..,;_-(<|>5²½́̊̇ΣКſ 　 \x1c \n\t", max_size=30), max_size=6))
def test_segments_of_odd_texts_give_the_ids_of_the_library(path, drops, texts):
    encoder = encode.worker_encoder(path, drops)
    got = [ids.tolist() for ids in encoder.encode_array(pa.array(texts, pa.string()))]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_segments_are_not_kept(monkeypatch):
    monkeypatch.setattr(encode, "GROUP_BYTES", 50)
    encoder = encode.Encoder(BYTE, False)
    texts = ["a" * 100, "b " * 30, "c" * 61 + " a", "a" * 100, None, ""]
    plain = Tokenizer.from_file(BYTE)
    assert [i.tolist() for i in encoder.encode_array(pa.array(texts))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert max(map(len, encoder.slot)) <= encode.CACHE_CHARS
    assert list(words.ranges(np.array([30, 30, 80, 10, 10]), 50)) == [(0, 1), (1, 2), (2, 3), (3, 5)]


def test_hashes_of_words_follow_their_definition():
    texts = ["", "One  two\n", None, " \t", "É é\x85x Two", "two", "a" * 70, " b"]
    for fold in (False, True):
        hashes, begins = words.word_hashes(pa.array([t or "" for t in texts]), fold)
        assert len(begins) == len(texts) + 1
        for t, a, b in zip(texts, begins, begins[1:]):
            raw = (t or "").encode()
            want = [xxhash.xxh64_intdigest(w, 42) for w in (raw.lower() if fold else raw).split()]
            assert hashes[a:b].tolist() == want
    assert [len(g) for g in words.groups(pa.array(["aa", None, "bbbb", "c"]), 3)] == [2, 1, 1]
