"""Trends and other computations over ordered rows. Windows without a partition run over daily aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from interlace.operators.medians import medians
from interlace.plans.model import chain, match_rows, WITH
from interlace.plans.registry import read, register

#: Rows of a piece of a long group.
PIECE = 10_000
_EV = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


def placed(rows: DataFrame, group: str, bucket: Column, order: list) -> DataFrame:
    """rows with `pos`, the place of each in its group, and `n`, the rows of the group.

    bucket is a coarser order than `order` in which no bucket holds much of a large group: places are counted inside the
    buckets, and only the table of buckets is summed up along a group. Ties of `order` must not cross buckets.
    """
    rows = rows.withColumn("__bucket", bucket)
    sums = rows.groupBy(group, "__bucket").agg(F.count("*").alias("__own"))
    along = Window.partitionBy(group)
    sums = sums.withColumn("__before", F.sum("__own").over(along.orderBy("__bucket")) - F.col("__own")).withColumn("n", F.sum("__own").over(along))
    sums = sums.select(F.col(group).alias("__group"), F.col("__bucket").alias("__at"), "__before", "n")
    inside = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order))
    out = rows.withColumn("__inside", inside).join(sums, F.col(group).eqNullSafe(F.col("__group")) & F.col("__bucket").eqNullSafe(F.col("__at")))
    return out.withColumn("pos", F.col("__before") + F.col("__inside")).drop("__bucket", "__inside", "__group", "__at", "__before")


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their place from the end and from the start in their type, and the number of the type."""
    rows = placed(read(spark, sf, "events"), "event_type", F.date_trunc("hour", "ts"), ["ts", "event_id"])
    return rows.withColumn("back", F.col("n") - F.col("pos") + 1)


def newest(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """The n newest events of each type, with their place from the end: tasks drop what cannot be among them before the shuffle."""
    back = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return read(spark, sf, "events").withColumn("back", back).filter(F.col("back") <= n)


@register("last_n", _EV + " SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS highest, CAST(count_if(value > 150) AS BIGINT) AS slow FROM e WHERE back <= 50 GROUP BY event_type")
def last_n(spark: SparkSession, sf: str, n: int = 50) -> DataFrame:
    """The newest n samples of each stream."""
    return newest(spark, sf, n).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("highest"), F.count_if(F.col("value") > 150).alias("slow"))


def trend_label(slope: Column, n: Column, limit: float = 0.1) -> Column:
    return chain([(n < 2, "insufficient_data"), (slope > limit, "improving"), (slope < -limit, "declining")], "stable")


@register("trend_slope", "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL), x AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i FROM d), s AS (SELECT event_type, count(*) AS n, round(regr_slope(v, i), 6) AS slope FROM x GROUP BY 1) SELECT *, CASE WHEN n < 2 THEN 'insufficient_data' WHEN slope > 0.1 THEN 'improving' WHEN slope < -0.1 THEN 'declining' ELSE 'stable' END AS trend FROM s")
def trend_slope(spark: SparkSession, sf: str) -> DataFrame:
    """Least-squares slope of the daily means against their number, and its label."""
    daily = read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    x = daily.withColumn("i", F.row_number().over(Window.partitionBy("event_type").orderBy("day")) - 1)
    out = x.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.regr_slope("v", "i"), 6).alias("slope"))
    return out.withColumn("trend", trend_label(F.col("slope"), F.col("n")))


@register("improvement_rate", _EV + " , s AS (SELECT event_type, max(n) AS n, avg(value) FILTER (WHERE pos <= 3) AS before, avg(value) FILTER (WHERE back <= 3) AS after FROM e GROUP BY 1) SELECT event_type, n, CASE WHEN n >= 2 AND before > 0 THEN round((after - before) / before * 100, 6) END AS improvement FROM s")
def improvement_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the last three against the first three, in per cent; null without two samples or a positive start."""
    out = numbered(spark, sf).groupBy("event_type").agg(F.max("n").alias("n"), F.avg(F.when(F.col("pos") <= 3, F.col("value"))).alias("before"), F.avg(F.when(F.col("back") <= 3, F.col("value"))).alias("after"))
    return out.select("event_type", "n", F.when((F.col("n") >= 2) & (F.col("before") > 0), F.round((F.col("after") - F.col("before")) / F.col("before") * 100, 6)).alias("improvement"))


_DAILY = "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, avg(o_totalprice) AS v FROM orders GROUP BY 1)"


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("v"))


@register("trailing7", _DAILY + " SELECT day, n, CASE WHEN row_number() OVER (ORDER BY day) >= 7 THEN round(avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) END AS trailing FROM d")
def trailing7(spark: SparkSession, sf: str, days: int = 7) -> DataFrame:
    """Mean of the last seven days once there are seven."""
    w = Window.orderBy("day")
    mean = F.round(F.avg("n").over(w.rowsBetween(1 - days, 0)), 6)
    return daily_orders(spark, sf).select("day", "n", F.when(F.row_number().over(w) >= days, mean).alias("trailing"))


@register("rolling3", _DAILY + " SELECT day, round(v, 6) AS v, CASE WHEN count(*) OVER w = 3 THEN round(avg(v) OVER w, 6) END AS rolling FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling3(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling mean of three, null for the first two."""
    w = Window.orderBy("day").rowsBetween(-2, 0)
    return daily_orders(spark, sf).select("day", F.round("v", 6).alias("v"), F.when(F.count("*").over(w) == 3, F.round(F.avg("v").over(w), 6)).alias("rolling"))


@register("recent_drop", _EV + " SELECT event_type, round(avg(value), 6) AS baseline, round(avg(value) FILTER (WHERE back <= 20), 6) AS recent, avg(value) - avg(value) FILTER (WHERE back <= 20) > 15 AS dropped FROM e GROUP BY 1")
def recent_drop(spark: SparkSession, sf: str) -> DataFrame:
    """The last twenty against all; a drop of more than 15 is flagged."""
    every = read(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("baseline"))
    last = newest(spark, sf, 20).groupBy("event_type").agg(F.avg("value").alias("recent"))
    return every.join(last, "event_type").select("event_type", F.round("baseline", 6).alias("baseline"), F.round("recent", 6).alias("recent"), (F.col("baseline") - F.col("recent") > 15).alias("dropped"))


@register("quartile_drift", _EV + " , s AS (SELECT event_type, max(n) AS n, avg(value) FILTER (WHERE pos <= n // 4) AS first_quarter, avg(value) FILTER (WHERE back <= (n + 3) // 4) AS last_quarter FROM e GROUP BY 1) SELECT event_type, round(first_quarter, 6) AS first_quarter, round(last_quarter, 6) AS last_quarter, n >= 40 AND abs(last_quarter - first_quarter) > 10 AS drifted FROM s")
def quartile_drift(spark: SparkSession, sf: str) -> DataFrame:
    """First quarter (rounded down) against last quarter (rounded up), from forty samples on."""
    first, last = F.avg(F.when(F.expr("pos <= n div 4"), F.col("value"))), F.avg(F.when(F.expr("back <= (n + 3) div 4"), F.col("value")))
    return numbered(spark, sf).groupBy("event_type").agg(F.round(first, 6).alias("first_quarter"), F.round(last, 6).alias("last_quarter"), ((F.max("n") >= 40) & (F.abs(last - first) > 10)).alias("drifted"))


@register("median_shift", _EV + " SELECT event_type, median(value) FILTER (WHERE back > 10) AS baseline, round(avg(value) FILTER (WHERE back <= 10), 6) AS recent, avg(value) FILTER (WHERE back <= 10) > 3 * median(value) FILTER (WHERE back > 10) AS slowdown FROM e GROUP BY 1")
def median_shift(spark: SparkSession, sf: str) -> DataFrame:
    """The last ten against the median of what was before; three times as much is a slowdown."""
    rows = numbered(spark, sf)
    base = medians(rows.filter("back > 10"), "event_type", "value").withColumnRenamed("median", "baseline")
    recent = newest(spark, sf, 10).groupBy("event_type").agg(F.avg("value").alias("recent"))
    return recent.join(base, "event_type", "left").select("event_type", "baseline", F.round("recent", 6).alias("recent"), (F.col("recent") > 3 * F.col("baseline")).alias("slowdown"))


@register("mean_shift", _EV + " SELECT event_type, round(avg(value) FILTER (WHERE back > 10) - avg(value) FILTER (WHERE back <= 10), 6) AS fall, round(stddev_pop(value) FILTER (WHERE back <= 20), 6) AS unrest, coalesce(stddev_pop(value) FILTER (WHERE back <= 20) > 0.2, false) AS unstable FROM e GROUP BY 1")
def mean_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Fall of the mean in the last ten, and the spread of the last twenty."""
    old, new = F.avg(F.when(F.col("back") > 10, F.col("value"))), F.avg(F.when(F.col("back") <= 10, F.col("value")))
    unrest = F.stddev_pop(F.when(F.col("back") <= 20, F.col("value")))
    return numbered(spark, sf).groupBy("event_type").agg(F.round(old - new, 6).alias("fall"), F.round(unrest, 6).alias("unrest"), F.coalesce(unrest > 0.2, F.lit(False)).alias("unstable"))


@register("zscore", "WITH s AS (SELECT l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), a AS (SELECT avg(v) AS mean, stddev_samp(v) AS sd, count(*) AS n FROM s) SELECT l_suppkey AS site, round((v - mean) / nullif(sd, 0), 4) AS z, abs((v - mean) / nullif(sd, 0)) > 2 AND n > 10 AS outlier FROM s CROSS JOIN a")
def zscore(spark: SparkSession, sf: str, limit: float = 2.0) -> DataFrame:
    """Z-scores of site totals over all sites; two numbers join every row, no row meets another."""
    sites = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.sum("l_extendedprice").alias("v"))
    all_sites = sites.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n"))
    z = (F.col("v") - F.col("mean")) / F.nullif("sd", F.lit(0.0))
    return sites.crossJoin(F.broadcast(all_sites)).select("site", F.round(z, 4).alias("z"), ((F.abs(z) > limit) & (F.col("n") > 10)).alias("outlier"))


@register("health_trend", _EV + " , s AS (SELECT event_type, sum(CASE WHEN value < 50 THEN 3 WHEN value < 150 THEN 1 ELSE 0 END) FILTER (WHERE back <= 10) AS recent, sum(CASE WHEN value < 50 THEN 3 WHEN value < 150 THEN 1 ELSE 0 END) FILTER (WHERE back BETWEEN 11 AND 20) AS before FROM e GROUP BY 1) SELECT event_type, CAST(recent AS BIGINT) AS recent, CAST(before AS BIGINT) AS before, CASE WHEN recent > 1.1::DOUBLE * before THEN 'improving' WHEN recent < 0.9::DOUBLE * before THEN 'declining' ELSE 'stable' END AS trend FROM s")
def health_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the last ten checks against the ten before, with ten per cent of slack."""
    points = chain([(F.col("value") < 50, 3), (F.col("value") < 150, 1)], 0)
    out = newest(spark, sf, 20).groupBy("event_type").agg(F.sum(F.when(F.col("back") <= 10, points)).alias("recent"), F.sum(F.when(F.col("back").between(11, 20), points)).alias("before"))
    return out.withColumn("trend", chain([(F.col("recent") > 1.1 * F.col("before"), "improving"), (F.col("recent") < 0.9 * F.col("before"), "declining")], "stable"))


@register("running_cost", "SELECT event_id, CAST(ts AS DATE) AS day, round(sum(value) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id), 4) AS daily_total, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS calls, round(sum(value) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id), 4) >= 4000 AS over_limit FROM events")
def running_cost(spark: SparkSession, sf: str, limit: float = 4000.0) -> DataFrame:
    """Cost so far on each day, calls so far, and whether the day's limit is reached.

    Rows are summed up inside minutes; along a day only the sums of its minutes are.
    """
    rows = read(spark, sf, "events").withColumns({"day": F.to_date("ts"), "minute": F.date_trunc("minute", "ts")})
    along = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = rows.groupBy("day", "minute").agg(F.sum("value").alias("own"), F.count("*").alias("n"))
    before = minutes.select(F.col("minute").alias("__minute"), F.coalesce(F.sum("own").over(along), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    w = Window.partitionBy("day", "minute").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("so_far", F.sum("value").over(w)).withColumn("count", F.count("*").over(w)).join(before, F.col("minute") == F.col("__minute"))
    total = F.round(F.col("cost") + F.col("so_far"), 4)
    return rows.select("event_id", "day", total.alias("daily_total"), (F.col("before") + F.col("count")).cast("long").alias("calls"), (total >= limit).alias("over_limit"))


@register("history_deviation", WITH + ", h AS (SELECT row_number, part_number, skp_part_number, confidence, avg(confidence) OVER (PARTITION BY supplier, part_type, match_result ORDER BY row_number, part_number, skp_part_number ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS mean FROM m WHERE confidence IS NOT NULL AND match_result <> '') SELECT row_number, part_number, skp_part_number, round(mean, 6) AS mean, coalesce(abs(confidence - mean) > 20, false) AS unusual FROM h")
def history_deviation(spark: SparkSession, sf: str, back: int = 50) -> DataFrame:
    """Confidence against the mean of up to fifty earlier rows of the same supplier, part type and verdict."""
    keys, group = ["row_number", "part_number", "skp_part_number"], F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x1e")) for c in ("supplier", "part_type", "match_result")])
    rows = match_rows(spark, sf).filter("confidence is not null and match_result <> ''").select(*keys, "confidence", group.alias("group"))
    rows = placed(rows, "group", F.expr(f"row_number div {PIECE}"), keys)
    # A group is cut into pieces of PIECE places; the last rows of a piece go before the next one, too.
    own = F.expr(f"(pos - 1) div {PIECE}")
    piece = F.when((F.col("pos") - 1) % PIECE >= PIECE - back, F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy("group", "piece").orderBy("pos").rowsBetween(-back, -1)
    mean = F.avg("confidence").over(w)
    rows = rows.withColumn("own", own).withColumn("piece", F.explode(piece)).select(*keys, "own", "piece", F.round(mean, 6).alias("mean"), F.coalesce(F.abs(F.col("confidence") - mean) > 20, F.lit(False)).alias("unusual"))
    return rows.filter("piece = own").select(*keys, "mean", "unusual")


@register("streaks", "WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events), s AS (SELECT user_id, bad, island, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, coalesce(max(n) FILTER (WHERE bad), 0) AS worst, coalesce(max(n) FILTER (WHERE NOT bad), 0) AS best, CAST(count_if(bad AND n >= 2) AS BIGINT) AS slow_downs, CAST(count_if(NOT bad AND n >= 3) AS BIGINT) AS speed_ups FROM s GROUP BY 1")
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of errors and of successes by user: gaps and islands; two errors slow down, three successes speed up."""
    bad = F.col("event_type") == "error"
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").withColumn("bad", bad)
    e = e.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy("ts", "event_id")))
    s = e.groupBy("user_id", "bad", "island").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    return s.groupBy("user_id").agg(
        F.coalesce(F.max(F.when(F.col("bad"), F.col("n"))), zero).alias("worst"), F.coalesce(F.max(F.when(~F.col("bad"), F.col("n"))), zero).alias("best"), F.count_if(F.col("bad") & (F.col("n") >= 2)).alias("slow_downs"), F.count_if(~F.col("bad") & (F.col("n") >= 3)).alias("speed_ups")
    )


@register("ranks", "SELECT o_orderkey, rank() OVER w AS place, dense_rank() OVER w AS dense_place, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS quarter, lag(o_totalprice) OVER v AS before, lead(o_totalprice) OVER v AS after FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE)), v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks by priority, and the neighbours of each order of a customer."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = read(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    # Ranks by day need the days only.
    along = Window.partitionBy("o_orderpriority").orderBy("day")
    days = orders.groupBy("o_orderpriority", "day").agg(F.count("*").alias("n"))
    days = days.select("o_orderpriority", "day", (F.sum("n").over(along) - F.col("n") + 1).alias("place"), F.row_number().over(along).cast("long").alias("dense_place"))
    rows = placed(orders, "o_orderpriority", F.floor(F.col("o_totalprice") / 100), ["o_totalprice", "o_orderkey"])
    rows = rows.join(days, ["o_orderpriority", "day"])
    size, larger = F.expr("n div 4"), F.expr("n % 4")
    quarter = F.when(F.col("pos") <= larger * (size + 1), F.expr("(pos - 1) div (n div 4 + 1) + 1")).otherwise(F.expr("(pos - n % 4 - 1) div greatest(n div 4, 1) + 1"))
    return rows.select("o_orderkey", "place", "dense_place", quarter.cast("long").alias("quarter"), F.lag("o_totalprice").over(own).alias("before"), F.lead("o_totalprice").over(own).alias("after"))
