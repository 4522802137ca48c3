"""Prefix scans against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from interlace.operators import scans


def slow_delays(flags):
    ok = wrong = 0
    delay, out = 2.0, []
    for bad in flags:
        ok, wrong = (0, wrong + 1) if bad else (ok + 1, 0)
        delay = max(0.5, delay * 0.8) if ok >= 3 else min(3.0, delay * 1.5) if wrong >= 2 else delay
        out.append(delay)
    return out


@pytest.mark.parametrize("steps, stretch", [(4, 7), (256, 10_000)])
def test_delays_equal_a_loop(spark, monkeypatch, steps, stretch):
    """Pieces of any size, a group with most of the rows, ties in time, a null group and null flags, clashing columns."""
    monkeypatch.setattr(scans, "STEPS", steps)
    monkeypatch.setattr(scans, "STRETCH", stretch)
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), i // 3, rng.choice([True, False, False, None])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, g int, t int, bad boolean").withColumn("step", F.lit(1)).withColumn("piece", F.lit(2))
    got = {r.id: r.delay for r in scans.delays(frame, "g", F.col("bad"), ["t", "id"], F.expr("t div 8")).collect()}
    want = {}
    for g in (1, 2, None):
        own = [r for r in rows if r[1] == g]
        want |= dict(zip((r[0] for r in own), slow_delays([bool(r[3]) for r in own])))
    assert got == pytest.approx(want)
    assert scans.delays(frame.limit(0), "g", F.col("bad"), ["t", "id"], F.expr("t div 8")).count() == 0


def test_no_task_holds_a_group(spark):
    plan = scans.adaptive_delays(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan
