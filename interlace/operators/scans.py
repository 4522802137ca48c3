"""Recurrences along ordered rows, computed as parallel prefix scans.

A step takes a value x to "x times a, kept between low and high". Two such steps after each other are again such a step,
so long sequences are cut into pieces, each piece is folded to one step, the pieces' steps are folded in the same way, and
the value before each piece comes back down. No task ever sees more than a piece of a group, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from interlace.operators.windows import placed
from interlace.plans.registry import read, register

#: Rows of a piece.
STEPS = 256
#: Rows between neighbouring places that windows look back over at once.
STRETCH = 10_000


def kept_between(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def then(first: Column, second: Column) -> Column:
    """The step that does the first and then the second; a step is a struct of a, low and high, and its a is above zero."""
    after = lambda x: kept_between(x * second["a"], second["low"], second["high"])
    return F.struct((first["a"] * second["a"]).alias("a"), after(first["low"]).alias("low"), after(first["high"]).alias("high"))


_NOTHING = lambda: F.struct(F.lit(1.0).alias("a"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))


def _pieces(rows: DataFrame, group: str) -> DataFrame:
    """(group, piece, entries in order) from rows (group, pos from 1, a, low, high)."""
    piece = F.expr(f"(pos - 1) div {STEPS}")
    entries = F.array_sort(F.collect_list(F.struct("pos", F.struct("a", "low", "high").alias("step"))))
    return rows.groupBy(group, piece.alias("piece")).agg(entries.alias("entries"))


def clamped_scan(rows: DataFrame, group: str, start: float, longest: int) -> DataFrame:
    """(group, pos, value) for rows (group, pos, a, low, high): the value after each step, from `start` on.

    pos counts the rows of each group from 1 without gaps; longest is the greatest of them. The depth of the recursion is the
    logarithm of longest to the base STEPS. Steps with a of zero or less are not allowed; a null group is a group.
    """
    pieces = _pieces(rows.select(group, "pos", "a", "low", "high"), group)
    if longest <= STEPS:
        started = pieces.withColumn("start", F.lit(float(start)))
    else:
        folded = pieces.select(group, F.aggregate("entries", _NOTHING(), lambda s, e: then(s, e["step"])).alias("step"), (F.col("piece") + 1).alias("pos"))
        ends = clamped_scan(folded.select(group, "pos", "step.*"), group, start, -(-longest // STEPS))
        before = ends.select(F.col(group).alias("__group"), F.col("pos").alias("__piece"), F.col("value").alias("start"))
        started = pieces.join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col("piece") == F.col("__piece")), "left").withColumn("start", F.coalesce("start", F.lit(float(start))))
    none = F.array().cast("array<struct<pos:bigint,value:double>>")
    walk = F.aggregate(
        "entries", F.struct(F.col("start").alias("now"), none.alias("past")),
        lambda s, e: F.struct(
            kept_between(s["now"] * e["step"]["a"], e["step"]["low"], e["step"]["high"]).alias("now"),
            F.array_append(s["past"], F.struct(e["pos"].alias("pos"), kept_between(s["now"] * e["step"]["a"], e["step"]["low"], e["step"]["high"]).alias("value"))).alias("past"),
        ),
        lambda s: s["past"],
    )
    return started.select(group, F.explode(walk).alias("at")).select(group, "at.pos", "at.value")


def delays(events: DataFrame, group: str, failed: Column, order: list[str], bucket: Column, start: float = 2.0) -> DataFrame:
    """events with column delay: what to wait after each event of its group, in the given order.

    Three successes or more in a row shorten the wait to .8 of it, .5 at least; two failures or more lengthen it to 1.5 times,
    3 at most. `failed` null counts as a success. bucket is a coarser order in which no bucket holds much of a large group.
    """
    rows = placed(events.withColumn("__failed", F.coalesce(failed, F.lit(False))), group, bucket, order)
    # The two rows before each: the last rows of a stretch are also laid in front of the next one.
    own = F.expr(f"(pos - 1) div {STRETCH}")
    both = F.when((F.col("pos") - 1) % STRETCH >= STRETCH - 2, F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy(group, "__stretch").orderBy("pos")
    bad = F.col("__failed")
    seen = rows.select(group, "pos", "n", "__failed", own.alias("__own"), F.explode(both).alias("__stretch"))
    fast = ~bad & ~F.lag(bad, 1, True).over(w) & ~F.lag(bad, 2, True).over(w)
    slow = bad & F.lag(bad, 1, False).over(w)
    seen = seen.withColumn("a", F.when(fast, 0.8).when(slow, 1.5).otherwise(1.0)).filter(F.col("__stretch") == F.col("__own"))
    bounds = {"low": F.when(F.col("a") < 1, 0.5).otherwise(float("-inf")), "high": F.when(F.col("a") > 1, 3.0).otherwise(float("inf"))}
    longest = rows.agg(F.max("n")).first()[0] or 0
    found = clamped_scan(seen.withColumns(bounds), group, start, longest)
    found = found.select(F.col(group).alias("__group"), F.col("pos").alias("__pos"), F.col("value").alias("delay"))
    return rows.join(found, F.col(group).eqNullSafe(F.col("__group")) & (F.col("pos") == F.col("__pos"))).drop("__group", "__pos", "__failed", "pos", "n")


_CASE = "CASE WHEN ok >= 3 THEN greatest(0.5::DOUBLE, d.delay * 0.8::DOUBLE) WHEN wrong >= 2 THEN least(3.0::DOUBLE, d.delay * 1.5::DOUBLE) ELSE d.delay END"
_DELAYS = f"""
WITH RECURSIVE e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS session, event_type = 'error' AS bad, row_number() OVER (PARTITION BY CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END ORDER BY ts, event_id) AS pos FROM events),
d(session, pos, event_id, ok, wrong, delay) AS (
  SELECT session, 0::BIGINT, NULL::BIGINT, 0, 0, 2.0::DOUBLE FROM e WHERE pos = 1
  UNION ALL
  SELECT session, pos, event_id, ok, wrong, CASE WHEN ok >= 3 THEN greatest(0.5::DOUBLE, delay * 0.8::DOUBLE) WHEN wrong >= 2 THEN least(3.0::DOUBLE, delay * 1.5::DOUBLE) ELSE delay END
  FROM (SELECT d.session, e.pos, e.event_id, CASE WHEN e.bad THEN 0 ELSE d.ok + 1 END AS ok, CASE WHEN e.bad THEN d.wrong + 1 ELSE 0 END AS wrong, d.delay FROM d JOIN e ON e.session = d.session AND e.pos = d.pos + 1))
SELECT session, event_id, round(delay, 6) AS delay FROM d WHERE pos > 0
"""


@register("adaptive_delays", _DELAYS)
def adaptive_delays(spark: SparkSession, sf: str) -> DataFrame:
    """The wait after each event of each session, errors being failures; one session holds a third of all events."""
    session = F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id"))
    events = read(spark, sf, "events").select("event_id", "ts", "event_type", session.alias("session"))
    out = delays(events, "session", F.col("event_type") == "error", ["ts", "event_id"], F.date_trunc("minute", "ts"))
    return out.select("session", "event_id", F.round("delay", 6).alias("delay"))
