import hashlib
import random

import numpy as np
import pytest
import xxhash

from interlace.llm import chunks, simhash

from .cases import LONG, PROSE, documents, empty


def slow_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", PROSE, LONG, "É é A B c d e", "x " * 50])
def test_simhash_follows_its_definition(text):
    assert simhash.simhash(text) == slow_simhash(text)


def test_anchors_cover_all_pairs_within_three_bits():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        rows, keys, homes = simhash.anchors(np.array([a, b], np.uint64))
        home_a = {k for r, k, h in zip(rows, keys, homes) if r == 0 and h}
        assert home_a & {k for r, k in zip(rows, keys) if r == 1}
        assert len(home_a) == 2


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [4096, 8])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(1)
    prints = {}
    for _ in range(20):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 15])):
            prints[len(prints)] = fp
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                fp ^= 1 << bit  # chains, so that roots are far from leaves
    base = rng.getrandbits(64)
    for i in range(60):  # a dense group around one anchor
        prints[len(prints)] = base ^ (1 << (32 + i % 32)) ^ (1 << rng.randrange(32, 64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(v),) for v in set(prints.values())], "fp long")
    roots = {r.fp: r.root for r in simhash.components(simhash.links_of(nodes)).collect()}
    got, seen = {}, {}
    for i in sorted(prints):
        fp = signed(prints[i])
        got[i] = seen.setdefault(roots.get(fp, fp), i)
    assert got == brute_components(prints)


def test_group_takes_odd_rows(spark):
    rows = simhash.group(documents(spark)).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[4].component_id == by[3].component_id == 3 and by[0].fingerprint == "0" * 16 == by[8].fingerprint
    assert by[1].component_id == 0
    assert simhash.group(empty(spark)).count() == 0


def test_gear_hash_is_the_rolling_sum():
    data = np.frombuffer(random.Random(2).randbytes(300), np.uint8)
    h, slow = chunks.gear_hash(data), 0
    for i, b in enumerate(data):
        slow = (slow << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        assert slow == h[i]


def test_chunks_cover_the_text_and_resist_shifts():
    raw = LONG.encode()
    ends = chunks.boundaries(raw)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes.max() <= chunks.MAX_SIZE and sizes[:-1].min() >= chunks.MIN_SIZE
    a, b = chunks.fingerprint(LONG), chunks.fingerprint("inserted words " + LONG)
    assert chunks.containment(a, b) > 0.95 and chunks.containment(a, chunks.fingerprint(PROSE * 9)) < 0.05
    assert chunks.from_string(chunks.to_string(a)) == a and sum(a.values()) == len(raw)


def test_compare_next_matches_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
    want = []
    for r, after in zip(order, order[1:] + order[:1]):
        t, n = r.text or "", len(r.text or "")
        e = t[: n - n // 3] + (after.text or "")[: n // 3]
        f, g = chunks.fingerprint(t), chunks.fingerprint(e)
        want.append((r.doc_id, n, hashlib.sha256(e.encode()).hexdigest(), chunks.to_string(f), chunks.to_string(g), chunks.containment(f, g), chunks.containment(f, chunks.fingerprint(after.text or ""))))
    for buckets in (1, 3, 40):
        got = [tuple(r) for r in chunks.compare_next(docs, buckets=buckets).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert chunks.compare_next(empty(spark)).count() == 0


@pytest.mark.parametrize("buckets", [2, 9])
def test_hot_keys_are_dealt_to_several_ranges(spark, buckets):
    """A third of the rows has one key and a third none: the same rows as in one sequence, over more ranges than keys."""
    rows = [(i if i % 3 == 0 else 50 if i % 3 == 1 else None, f"{PROSE} {i} " * (1 + i % 4)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    order = sorted(order, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    want = [(r.doc_id, chunks.to_string(chunks.fingerprint(r.text)), hashlib.sha256(chunks.edited(r.text, after.text).encode()).hexdigest()) for r, after in zip(order, order[1:] + order[:1])]
    got = chunks.compare_next(docs, buckets=buckets).select("doc_id", "fingerprint", "edited_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    placed = chunks.in_buckets(docs, "doc_id", "text", buckets).filter("not head").groupBy("bucket").count().collect()
    assert max(r["count"] for r in placed) <= (120 if buckets == 2 else 40)
