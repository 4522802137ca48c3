"""Phrases in texts against a scan of every text for every phrase."""

import random
import re

from pyspark.sql import functions as F

from interlace.operators import phrases as P


def slow(texts, names):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for key, text in texts:
        have = words(text)
        for name in {n for n in names if n and words(n)}:
            want = words(name)
            at = [i + 1 for i in range(len(have) - len(want) + 1) if have[i : i + len(want)] == want]
            out += [(key, name, len(at), at[0])] if at else []
    return sorted(out, key=repr)


def test_equals_a_scan(spark):
    """Phrases of one to seven words, overlaps, repeats, spellings, nulls, equal keys, an empty list, clashing columns."""
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "c", "Dd", "é9"])
    names = [" ".join(word() for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["A-B", "a b", None, "", "!!", "a a"]
    texts = [(i % 37, rng.choice([" ", ", ", "-"]).join(word() for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(None, "a b"), (5, None), (6, "a a a"), (6, "a a a")]
    frame = spark.createDataFrame(texts, "id int, t string").withColumn("row", F.lit(1)).withColumn("phrase", F.lit("x"))
    known = spark.createDataFrame([(n,) for n in names * 2], "name string").withColumn("all", F.lit(1))
    got = sorted(map(tuple, P.find(frame, known, "id", "t", "name").collect()), key=repr)
    assert got == slow(texts, names)
    assert P.find(frame, known.limit(0), "id", "t", "name").count() == 0 and P.find(frame.limit(0), known, "id", "t", "name").count() == 0


def test_no_text_meets_every_phrase(spark):
    plan = P.part_names_in_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
