import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from interlace.llm import packing

from .cases import documents, empty

WORD = public_tokenizers.path("word_bpe_49k.json")


def check(docs, pieces, window):
    """Each id in one piece; sequences gapless, at most a window, full or of a power of two."""
    for i, d in enumerate(docs):
        at = 0
        for p in sorted(p for p in pieces if p[0] == i):
            assert p[1] == at and p[2] > 0
            at += p[2]
        assert at == len(d)
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert sequences.get(p[3], 0) == p[4]
        sequences[p[3]] = p[4] + p[2]
    assert all(n == window or n < window and n & (n - 1) == 0 for n in sequences.values())
    return sequences


def test_shards_are_packed_without_padding():
    rng = random.Random(0)
    for trial in range(60):
        docs = [np.array([rng.randrange(50) for _ in range(rng.choice([0, 1, 3, 20, 64, 200]))], np.uint16) for _ in range(rng.randint(0, 30))]
        pieces = packing.pack_shard(docs, 5, 64)
        sequences = check(docs, pieces, 64)
        total = sum(map(len, docs))
        assert len(sequences) == total // 64 + (total % 64).bit_count()


def test_bm25_matches_its_formula():
    rng = random.Random(1)
    docs = [np.array([rng.randrange(30) for _ in range(rng.randint(1, 40))]) for _ in range(12)]
    index, mean = packing.Bm25(docs), sum(map(len, docs)) / 12
    df = {t: sum(t in d for d in docs) for t in range(30)}

    def weight(t, d):
        tf = int((d == t).sum())
        return np.log1p((12 - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))

    for seed, d in enumerate(docs):
        terms = sorted(set(d.tolist()), key=lambda t: (-round(weight(t, d), 9), t))[: packing.QUERY_TERMS]
        unused = np.array([i != seed and i % 5 != 0 for i in range(12)])
        scores = {i: sum(weight(t, e) for t in terms) for i, e in enumerate(docs) if unused[i]}
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == {i for i, s in scores.items() if s > 0}
        assert all(scores[a] >= scores[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_neighbours_of_the_same_topic_share_a_window():
    topics = [np.array([10 * t + i % 7 for i in range(30)]) for t in range(4)]
    docs = [topics[i % 4] for i in range(16)]
    pieces = packing.pack_shard(docs, 0, 60)
    by = {}
    for p in pieces:
        by.setdefault(p[3], set()).add(p[0] % 4)
    assert sum(len(s) == 1 for s in by.values()) >= 6


def test_pieces_hold_all_ids(spark):
    docs = documents(spark, "Upper CASE words " * 900)
    tokenizer = Tokenizer.from_file(WORD)
    rows = packing.packed(docs).collect()
    by = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length
        by.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(by) == set(texts)
    for key, parts in by.items():
        want = [*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 2]
        copies = 2 if key == 4 else 1
        assert sum(len(p[1]) for p in parts) == copies * len(want)
        if copies == 1:
            assert np.concatenate([p[1] for p in sorted(parts, key=lambda p: p[0])]).tolist() == want
            assert all(p[2] == len(want) for p in parts)
    assert packing.packed(empty(spark)).count() == 0


def test_all_terms_of_a_seed_count():
    """The twelve heaviest terms of the seed are its own; what it shares with others are light ones."""
    docs = [np.append(np.arange(40), np.repeat(np.arange(100, 112), 5)), np.arange(40), np.arange(0, 40, 4), np.arange(200, 240)]
    assert packing.Bm25(docs).neighbours(0, np.array([False, True, True, True])).tolist() == [1, 2]


def test_topics_part_vocabularies():
    """Documents over four vocabularies, some words shared: a topic holds documents of one vocabulary."""
    rng = np.random.default_rng(2)
    docs = [np.concatenate([rng.integers(500 * (i % 4), 500 * (i % 4) + 300, 200), rng.integers(3000, 3100, 60)]) for i in range(200)]
    signs = packing.directions(4000)
    assert signs.shape == (4000, packing.TOPIC_DIMENSIONS) and set(np.unique(signs)) == {-1.0, 1.0}
    vectors = np.array([packing.vector(d, signs) for d in docs])
    topics = packing.Topics(vectors[:100])
    by = {}
    for i, v in enumerate(vectors):
        by.setdefault(topics.of(v), []).append(i % 4)
    pure = sum(max(map(kinds.count, range(4))) for kinds in by.values())
    assert pure >= 190 and len(by) >= 4
    assert packing.Topics(np.empty((0, packing.TOPIC_DIMENSIONS), np.float32)).of(vectors[0]) == 0


def test_query_packs_whole_tables(spark):
    """The query's own rows: every id once, gapless pieces and sequences, full or of a power of two; against ids of the tokenizer."""
    sf = "/root/testdata/sf0.001"
    rows = packing.query(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    tokenizer, sequences, by = Tokenizer.from_file(WORD), {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(texts)
    for key, parts in by.items():
        ids = np.array([*tokenizer.encode(texts[key], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sizes = []
    for pieces in sequences.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        sizes.append(end)
    assert all(n == packing.WINDOW or n < packing.WINDOW and n & (n - 1) == 0 for n in sizes)
