"""The inverted file against brute force."""

import numpy as np
from pyspark.sql import functions as F

from interlace.operators import vectors as V


def exact(rows, asked, k):
    ids, found = [r[0] for r in rows], {}
    every = V.unit(np.array([r[1] for r in rows]))
    for key, v in asked:
        near = np.round(every @ V.unit(np.array([v]))[0], V.DECIMALS)
        order = np.lexsort((ids, -near))[:k]
        found[key] = [(ids[i], near[i]) for i in order]
    return found


def test_recall_on_the_tables(spark):
    """Nine tenths of the exact ten neighbours at least, at two sizes."""
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        near = {(r.vec_id, r.neighbour) for r in V.nearest_vectors(spark, sf).collect()}
        true = {(r.vec_id, r.neighbour) for r in V.nearest_vectors_exact(spark, sf).collect()}
        assert len(near & true) >= 0.9 * len(true) > 0


def test_blocks_copies_and_odd_vectors(spark, monkeypatch):
    """A vector that a third of the rows share is one entry; zero and null vectors; blocks of any size give the same."""
    monkeypatch.setattr(V, "BLOCK", 9)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)] + [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(200, 300)] + [(300, [0.0] * 6)]
    frame = spark.createDataFrame([*rows, (301, None), (None, rows[0][1])], "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("copies", F.lit(2))
    asked = frame.filter("vec_id % 50 = 0")
    got = {}
    for r in V.nearest(frame, asked, k=5, recall=None).orderBy("vec_id", "place").collect():
        got.setdefault(r.vec_id, []).append((r.neighbour, r.similarity))
        assert r.copies == (100 if r.neighbour == 200 else 1)
    distinct = rows[:201] + rows[300:]
    assert got == exact(distinct, [r for r in rows if r[0] % 50 == 0], 5)
    assert V.nearest(frame.limit(0), asked).count() == 0 and V.nearest(frame, asked.limit(0)).count() == 0


def test_queries_are_dealt_to_tasks(spark, monkeypatch):
    """Parts of the queries of any size, and a few similarities at a time, give the same (a task held those of all queries at once)."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(V, "ASKED", 7)
    monkeypatch.setattr(V, "HELD", 30)
    got = {}
    for r in V.nearest(frame, frame.filter("vec_id % 3 = 0"), k=4, recall=None).orderBy("vec_id", "place").collect():
        got.setdefault(r.vec_id, []).append((r.neighbour, r.similarity))
    assert got == exact(rows, [r for r in rows if r[0] % 3 == 0], 4)
