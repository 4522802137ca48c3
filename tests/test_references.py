"""The similarity join of references against all pairs."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from interlace.functions import text as X
from interlace.operators import references as R


def ratio(a, b):
    return max(difflib.SequenceMatcher(None, a, b).ratio(), difflib.SequenceMatcher(None, b, a).ratio())


def all_pairs(texts):
    distinct = sorted({t for t in texts if t})
    return {(a, b): ratio(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if ratio(a, b) >= R.RATIO}


def changed(text, rng, times, letters="AB01"):
    for _ in range(times):
        i = rng.randrange(len(text) + 1)
        text = rng.choice((text[:i] + text[i + 1 :], text[:i] + rng.choice(letters) + text[i:], text[:i] + rng.choice(letters) + text[i + 1 :]))
    return text


def test_any_similar_long_pair_shares_a_gram():
    """From the lengths alone: what two similar strings, one of them long, may lack leaves one gram in common at least."""
    for n in range(R.SHORT + 1, 300):
        for m in range(1, n + 1):
            least = next(k for k in range(math.floor(R.RATIO / 2 * (n + m)), n + 2) if 2 * k / (n + m) >= R.RATIO)
            if least <= m:
                assert n - (R.GRAM - 1) - R.GRAM * (n - least) - (R.GRAM - 1) * (m - least) >= 1


@pytest.mark.parametrize("sizes, times", [((1, 18), 3), ((10, 22), 5), ((30, 60), 9)])
def test_equals_all_pairs(spark, sizes, times):
    rng = random.Random(sizes[0])
    roots = ["".join(rng.choice("AB01") for _ in range(rng.randint(*sizes))) for _ in range(40)]
    texts = roots + [changed(rng.choice(roots), rng, rng.randint(1, times)) for _ in range(160)]
    want = all_pairs(texts)
    got = {(r.a, r.b): r.ratio for r in R.similar(spark.createDataFrame([(t,) for t in texts], "ref string")).collect()}
    assert got == want and len(want) > 30


def test_frequent_keys_are_divided_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    texts = [f"7B0{i:06d}" for i in range(0, 4000, 37)] + [f"LONGER-REFERENCE-{i:05d}" for i in range(0, 3000, 41)]
    got = {(r.a, r.b) for r in R.similar(spark.createDataFrame([(t,) for t in texts], "ref string")).collect()}
    assert got == set(all_pairs(texts))


def test_odd_rows(spark):
    """Nulls and empty strings are similar to nothing, copies are one string, and other columns do not matter."""
    rows = [(None, 1), ("", 2), ("7B0199279A", 3), ("7B0199279", 4), ("A", 5), ("a", 6), ("é" * 40, 7), ("é" * 41, 8), ("x" * 3000, 9), ("x" * 2999 + "y", 10)] + [("7B0199279", 11)] * 50
    frame = spark.createDataFrame(rows, "ref string, key int").withColumn("blocks", F.lit(1)).withColumn("own", F.lit(2))
    want = all_pairs([r[0] for r in rows])
    assert {(r.a, r.b): r.ratio for r in R.similar(frame).collect()} == want and len(want) == 3
    assert R.similar(frame.limit(0)).count() == 0 and R.linked(frame.limit(0)).count() == 0


def test_base_numbers_link_what_the_ratio_leaves_out(spark):
    rows = [("12345XX",), ("12345AB",), ("12345",), ("12346",), ("99999A",)]
    got = {(r.a, r.b): r.score for r in R.linked(spark.createDataFrame(rows, "ref string")).collect()}
    assert got == {("12345", "12345AB"): 0.7, ("12345", "12345XX"): 0.7, ("12345AB", "12345XX"): 0.7}


def test_parts_equal_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    want = set(all_pairs([r.ref for r in R.part_references(spark, sf).collect()]))
    assert {(r.a, r.b) for r in R.similar(R.part_references(spark, sf)).collect()} == want


def test_matching_is_difflibs():
    """The plain search finds the blocks that difflib finds, also where a longer block lies aside."""
    rng = random.Random(3)
    for letters in ("AB", "AB01", "0123456789"):
        for _ in range(2000):
            a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 20)))
            b = changed(a, rng, rng.randint(1, 4), letters)
            assert X.matching(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
            assert a == b or X.greater_ratio(a, b) == ratio(a, b)
    assert X.greater_ratio("x" * 3000, "x" * 2999 + "y") == ratio("x" * 3000, "x" * 2999 + "y")


def test_keys_are_never_broadcast(spark):
    """By the estimates, which know nothing of how many keys a row has, all of them went through the driver (its memory ended at ten times sf0.1)."""
    plan = R.reference_links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "HashedRelationBroadcastMode" not in plan


def test_only_lengths_that_occur_have_keys(spark):
    """Of strings of nine and ten characters, none is cut down for eight or eleven."""
    keys = R.short_keys(spark.createDataFrame([("7B0199279A",), ("7B0199279",)], "ref string")).select("key").collect()
    assert {r.key.rsplit(" ", 1)[0] for r in keys} == {"9 9", "9 10", "10 10"}
