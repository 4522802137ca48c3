"""Language profiles, resampling by importance and fill-in-middle, against brute force and planted odd cases."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from interlace.llm import importance, infill, languages
from interlace.llm.common import materialise, table

from .cases import LONG, PROSE, documents, empty

SF = "/root/testdata/sf0.001"


# --- languages --------------------------------------------------------------------------------------------------------
def slow_grams(text):
    """n-grams of words with marks, as strings."""
    words = ["_" + w + "_" for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
    return [g for w in words for n in range(1, languages.LONGEST + 1) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != "_"]


def number(g):
    """The number of an n-gram; different n-grams have different ones."""
    return sum((languages.MARK if c == "_" else ord(c)) << languages.BITS * i for i, c in enumerate(reversed(g)))


def slow_places(counts, limit=languages.PROFILE):
    """The most frequent n-grams; ties in order of their numbers."""
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:limit]


def slow_answer(text, profiles):
    counts = Counter(slow_grams(text or ""))
    if not counts:
        return "und", 0.0
    mine = slow_places(counts)
    same = {}
    for i, g in enumerate(mine):
        same.setdefault(counts[g], []).append(i)
    far = {}
    for name, theirs in profiles.items():
        at = {g: i for i, g in enumerate(theirs)}
        far[name] = sum(abs(at[g] - sum(same[counts[g]]) / len(same[counts[g]])) if g in at else languages.PROFILE for g in mine)
    first, second = sorted(far.values())[:2]
    return min(far, key=lambda n: (far[n], n)), (second - first) / second


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_grams_match_brute_force(text):
    assert sorted(languages.grams(text).tolist()) == sorted(number(g) for g in slow_grams(text))


def test_whole_query_matches_brute_force(spark):
    rows = table(spark, SF, "documents").collect()
    learned = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            learned.setdefault(r.lang, Counter()).update(slow_grams(r.text or ""))
    profiles = {name: slow_places(c) for name, c in learned.items()}
    want = {r.doc_id: (zlib.crc32(str(r.doc_id).encode()) % 5 == 0, *slow_answer(r.text, profiles)) for r in rows}
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in languages.query(spark, SF).collect()}
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert all(got[i][2] == pytest.approx(want[i][2]) and 0 <= got[i][2] <= 1 for i in want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = languages.query(spark, sf).filter("held_out").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)


def test_languages_of_odd_rows(spark):
    docs = documents(spark).withColumn("language", F.lit(1)).withColumn("p", F.lit(2)).withColumn("held_out", F.lit(3))
    got = {r.doc_id: r for r in languages.identify(docs).collect()}
    assert languages.identify(docs).count() == docs.count()
    assert [got[i].lang_pred for i in (0, 1, 8)] == ["und"] * 3 and got[0].score == 0
    assert got[2].lang_pred == "en" and got[None].held_out
    assert languages.identify(empty(spark)).count() == 0
    nobody = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in languages.identify(nobody).collect()} == {"und"}


def test_the_learned_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('word', id) as text", "if(id % 4 = 0, 'a', if(id % 2 = 0, 'b', 'c')) as lang")
    got = languages.learn(docs, languages=2, rows=50)
    assert {r.language for r in got.collect()} == {"a", "c"}  # the most rows, then the first name
    assert max(r["count"] for r in got.groupBy("language").count().collect()) <= languages.PROFILE


# --- importance -------------------------------------------------------------------------------------------------------
def slow_features(text):
    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % importance.BUCKETS for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def slow_sample(docs, target):
    """{doc_id: (doc_id, n_features, weight, score, rank)} by the definition."""
    found = {i: slow_features(t) for i, t in docs}
    s, t = Counter(), Counter()
    for _, f in found.values():
        s.update(f)
    for x in target:
        t.update(slow_features(x)[1])
    big_s, big_t, b = sum(s.values()), sum(t.values()), importance.BUCKETS
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (big_s + b) / ((s[k] + 1) * (big_t + b))))
    out = {}
    for i, (_, f) in found.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out[i] = (i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((-out[i][3], i) for i in found if found[i][0] >= importance.LEAST_WORDS)
    ranks = {i: n for n, (_, i) in enumerate(able[: 5 * len(able) // 100], 1)}
    return {i: (*row, ranks.get(i)) for i, row in out.items()}


def test_resampling_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = slow_sample(docs, [r.text for r in table(spark, SF, "benchmark").collect()])
    got = {r.doc_id: tuple(r) for r in importance.query(spark, SF).collect()}
    assert got == want and sum(r[4] is not None for r in got.values()) > 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB0é日😀 .~^\n"), max_size=400), max_size=5))
def test_feature_buckets_match_brute_force(texts):
    found, of, n_words = importance.feature_buckets(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        n, want = slow_features(t)
        assert n_words[i] == n and sorted(found[of == i].tolist()) == sorted(want)


def test_checksums_of_long_words():
    words = ["a", "b" * 63, "c" * 64, "d" * 65, "é" * 5000, "f" * 131_077, "g"]
    found, _, _ = importance.feature_buckets(pa.array([" ".join(words)]))
    assert sorted(found.tolist()) == sorted(slow_features(" ".join(words))[1])


def test_selection_finds_every_place(spark):
    rng = random.Random(3)
    values = rng.sample(range(10**6), 700)
    rows = materialise(spark.createDataFrame([(v,) for v in values], "place long"), "values")
    for k in (1, 2, 350, 699, 700):
        assert importance.kth_key(rows, k, len(values), pivots=5) == sorted(values)[k - 1]
    assert importance.kth_key(rows, 0, 700) is None and importance.kth_key(rows, 701, 700) is None


def test_equal_scores_and_odd_rows(spark):
    """A third of all rows are one row: exactly five in a hundred are drawn, and all ranks differ."""
    rows = [(7, PROSE)] * 100 + [(i, f"{PROSE} {i}") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(1)).withColumn("part", F.lit(2))
    got = importance.resample(docs, docs.limit(1)).collect()
    ranks = sorted(r.rank for r in got if r["rank"] is not None)
    assert len(got) == 300 and ranks == list(range(1, 16))
    assert len({(r.weight, r.score) for r in got if r.doc_id == 7}) == 1
    odd = documents(spark)
    assert importance.resample(odd, odd.limit(0)).count() == odd.count()
    nothing = {r.doc_id: r for r in importance.resample(odd, empty(spark)).collect()}
    assert nothing[0].n_features == 0 and nothing[0].weight == 0 and nothing[None].score is not None
    assert importance.resample(empty(spark), odd).count() == 0


# --- fill-in-middle ---------------------------------------------------------------------------------------------------
ODD = [None, "", "<P>", "a<S>b", "x<M>", "<", "a<", "S>x", "P>", "é😀 a b", "\n\n", "ab" * 40, LONG, "ab, " * 50_000, "$1 \\ {2}+", "<<P", "M><"]


def slow_form(key, text, rate=90):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(pre), len(mid), out


def test_infill_of_odd_texts_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("n", F.lit(2)).withColumn("t", F.lit(3))
    out = infill.transform(docs, rate=100)
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {i: slow_form(i, t or "", 100) for i, t in rows}
    assert len({r[1] for r in got.values()}) == 3
    back = {r.doc_id: r.back for r in out.select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("back")).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_infill_sql_agrees_and_odd_rows_are_kept(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, infill.query(spark, SF).collect())) == sorted(con.execute(infill.SQL).fetchall())
    odd = documents(spark)
    got = infill.transform(odd).collect()
    assert len(got) == odd.count() and infill.transform(empty(spark)).count() == 0
    assert [r.form for r in got if r.doc_id is None] and {r.form for r in got if r.doc_id in (0, 1)} == {"plain"}


def test_infill_keeps_its_rates(spark):
    got = {r.form: r["count"] for r in infill.transform(spark.range(4000).selectExpr("id as doc_id", "'some words here' as text")).groupBy("form").count().collect()}
    assert abs(got["plain"] / 4000 - 0.1) < 0.02 and abs(got["spm"] / (4000 - got["plain"]) - 0.2) < 0.03


def test_infill_needs_no_python(spark):
    plan = infill.query(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
