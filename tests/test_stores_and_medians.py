"""The keyed store, exact medians, and running reports in which no task holds a group."""

import random
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from interlace.operators import medians as M
from interlace.sources import store

DDL = "part string, id int, v int, at int"


def files(path, partition):
    return {f.name: f.read_bytes() for f in Path(path, f"part={partition}").glob("*.parquet")}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.create(spark.createDataFrame([("a", 1, 10, 0), ("a", 2, 20, 0), ("b", 1, 30, 0), ("c", 1, 40, 0), (None, 1, 50, 0)], DDL), path, "part")
    before = {p: files(path, p) for p in "abc"}
    updates = spark.createDataFrame([("a", 1, 11, 1), ("a", 1, 12, 3), ("a", 1, 13, 2), ("c", 2, 41, 0), (None, 1, 51, 0), ("d", None, 60, 0)], DDL)
    for _ in range(2):  # the same update again changes nothing
        store.upsert(updates, path, ["part", "id"], "part", newest="at")
        got = {(r.part, r.id, r.v) for r in spark.read.schema(DDL).parquet(path).collect()}
        assert got == {("a", 1, 12), ("a", 2, 20), ("b", 1, 30), ("c", 1, 40), ("c", 2, 41), (None, 1, 51), ("d", None, 60)}
    assert files(path, "b") == before["b"] and files(path, "a") != before["a"]


def test_a_failed_update_leaves_the_store(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.create(spark.createDataFrame([("a", 1, 10, 0)], DDL), path, "part")
    before = files(path, "a")
    broken = spark.createDataFrame([("a", 2, 1, 0)], DDL).withColumn("v", F.raise_error("no").cast("int"))
    with pytest.raises(Exception, match="no"):
        store.upsert(broken, path, ["part", "id"], "part")
    assert files(path, "a") == before
    with pytest.raises(ValueError):
        store.upsert(broken, path, ["id"], "part")
    store.upsert(spark.createDataFrame([], DDL), path, ["part", "id"], "part")
    assert files(path, "a") == before


@pytest.mark.parametrize("limit, ranges", [(4, 3), (10_000, 32)])
def test_medians_equal_a_sort(spark, monkeypatch, limit, ranges):
    """Even and odd counts, ties, one value, two values, nulls, a hot group, wide and negative numbers, clashing columns."""
    monkeypatch.setattr(M, "SORTED", limit)
    monkeypatch.setattr(M, "RANGES", ranges)
    rng = random.Random(1)
    groups = {
        "hot": [rng.gauss(0, 100) for _ in range(501)], "even": [rng.randint(0, 9) for _ in range(200)], "same": [5.0] * 77, "one": [3.5], "two": [1.0, 2.0], "halves": [1.0] * 40 + [9.0] * 40,
        "wide": [10.0**i for i in range(-60, 61)], "nulls": [None, None, 4.0], "spike": [0.0] * 90 + [float(i) for i in range(30)], "edge": [1.0] * 39 + [2.0] + [3.0] + [4.0] * 39,
    }
    rows = [(g, None if v is None else float(v), 1) for g, vs in groups.items() for v in vs] + [("none", None, 1), (None, 1.0, 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double, k int").withColumn("lo", F.lit(1)).withColumn("at", F.lit(2))
    got = {r.g: r.median for r in M.medians(frame, "g", "v").collect()}
    assert got == pytest.approx({g: statistics.median(x for x in vs if x is not None) for g, vs in groups.items()})
    assert M.medians(frame.limit(0), "g", "v").count() == 0


def test_no_task_gets_a_whole_partition(spark, tmp_path, monkeypatch):
    """The touched partitions are broadcast; before, the store's rows were shuffled by partition, each into one task."""
    from pyspark.sql import functions as F

    from interlace.sources import store as S

    seen, broadcast = [], F.broadcast
    monkeypatch.setattr(S.F, "broadcast", lambda df: seen.append(df.columns) or broadcast(df))
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), (None, 3, 3)], "p string, k int, v int")
    S.create(rows, f"{tmp_path}/s", "p")
    S.upsert(rows.withColumn("v", F.lit(9)).filter("k <> 1"), f"{tmp_path}/s", ["p", "k"], "p")
    assert seen == [["__partition"]]
    assert sorted((r.k, r.v) for r in spark.read.schema(rows.schema).parquet(f"{tmp_path}/s").collect()) == [(1, 1), (2, 9), (3, 9)]
