import hashlib
import random
from collections import Counter

import pytest

from interlace.llm import common, suffixes
from pyspark.sql import functions as F

from .cases import LONG, PROSE, documents, empty


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    n = suffixes.LENGTH
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    """Near copies, shared passages of lengths around the limit, repeats inside a text, and runs of one byte."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(n))
    passage, base = words(120), words(300)
    texts = [words(60) + passage[: 380 + 5 * i] + words(60) for i in range(12)]
    for _ in range(15):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(1)
        texts.append(" ".join(w))
    return [*texts, passage + words(20) + passage, "x" * 1500, "y" + "x" * 900 + "z", "ab" * 700, base, base, passage[:400], passage[:399]]


@pytest.mark.parametrize("batches, group", [(1, 4000), (5, 3)])
def test_removal_matches_brute_force(spark, monkeypatch, batches, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    docs = documents(spark, *corpus())
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, *b) for r, b in zip(rows, brute([r.text for r in rows])))
    got = sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in suffixes.remove(docs, batches=batches).collect())
    assert got == want


def test_a_passage_of_most_texts_is_split(spark, monkeypatch):
    """700 texts share a passage among different neighbours: no group is held whole, no key joined in one piece."""
    monkeypatch.setattr(suffixes, "GROUP", 50)
    monkeypatch.setattr(common, "HOT_ROWS", 60)
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(n))
    passage = words(110)
    texts = [words(20) + " " + passage + " " + words(20) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffixes.remove(docs).orderBy("doc_id").collect()
    assert [tuple(r[1:]) for r in rows] == brute(texts) and min(r.n_removed for r in rows) >= 400


def test_query_shows_what_is_left(spark, monkeypatch, tmp_path):
    """The texts left are those that brute force counts: a passage of 400 bytes goes, one of over 50 words and fewer bytes stays."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rng = random.Random(5)
    words = lambda n, k: " ".join("".join(rng.choices("abcde", k=k)) for _ in range(n))
    short, long = words(60, 5), words(67, 5)  # 359 and 401 bytes
    texts = [words(30, 6) + sign + p + " " + words(30, 7) for p in (short, long) for sign in "é©"]  # signs with the same last byte
    texts += ["copy " * 100] * 7 + ["clean " + words(80, 6), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = suffixes.query(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in rows] == brute(texts)
    assert [r.n_bytes - r.n_removed - len(r.text.encode()) for r in rows[:5]] == [0, 0, 1, 1, 0]  # the first byte of a cut sign is no text
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows[:2] + rows[4:])
    assert [short in r.text for r in rows[:2]] == [True, True] and not any(long in r.text or long[10:-10] in r.text for r in rows)
    assert [r.text for r in rows[4:]] == [""] * 7 + [texts[11], "", ""]


def test_small_pieces_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 333)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r[1:]) for r in suffixes.remove(docs).orderBy("doc_id").collect()] == brute(texts)


def test_family_merges_levels_geometrically(spark):
    texts = spark.createDataFrame([(i, LONG[i * 50 : i * 50 + 1500]) for i in range(7)], "text_id long, text string")
    family = suffixes.SuffixFamily(spark)
    for i in range(7):
        family.add(texts.filter(F.col("text_id") == i))
    assert [size for size, _ in family.levels] == [4, 2, 1]
    assert family.candidates().count() > 0


def test_stage_and_empty_table(spark):
    docs = documents(spark, PROSE * 5, "start " + PROSE * 5)
    out = suffixes.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[11].text == "" and by[12].text.startswith("start") and by[12].n_chars == len(by[12].text) and by[0].text is None
    assert suffixes.remove(empty(spark)).count() == 0


def test_stage_cuts_passages_of_over_fifty_words_whatever_their_bytes(spark):
    """51 words go from both texts and 50 stay, with short words and long ones; white space does not matter."""
    rng = random.Random(11)
    words = lambda n, a, b: ["".join(rng.choices("abcdefgé", k=rng.randint(a, b))) for _ in range(n)]
    texts, want = [], []
    for n in (50, 51, 58, 120):
        for a, b in ((1, 3), (4, 7), (12, 20)):
            passage = words(n, a, b)
            for space in (" ", "\n"):
                before, after = words(30, 9, 11), words(30, 9, 11)
                texts.append(" ".join(before) + " " + space.join(passage) + " " + " ".join(after))
                want.append(texts[-1] if n == 50 else " ".join(before + after))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows = suffixes.stage(spark, docs, "").orderBy("doc_id").collect()
    assert [r.text for r in rows] == want and [r.n_chars for r in rows] == [len(t) for t in want]
