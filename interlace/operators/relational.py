"""Joins, set operations, de-duplication, and top-k over the part tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from interlace.plans.model import AS_OF, SHEETS, VERDICTS, WITH, chain, flagged, match_rows
from interlace.plans.registry import read, register


@register("parts_with_sources", "SELECT p_brand AS brand, p_partkey AS part, l_suppkey AS site, count(l_orderkey) AS listings, min(l_extendedprice) AS lowest FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 49 GROUP BY ALL ORDER BY brand, part, site NULLS FIRST LIMIT 500")
def parts_with_sources(spark: SparkSession, sf: str, limit: int = 500) -> DataFrame:
    """Parts and their large listings by site, in the order of brand, part and site; a top-k report."""
    parts, rows = read(spark, sf, "part"), read(spark, sf, "lineitem").filter("l_quantity >= 49")
    found = rows.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("listings"), F.min("l_extendedprice").alias("lowest"))
    out = parts.join(found, F.col("p_partkey") == F.col("l_partkey"), "left")
    out = out.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), F.col("l_suppkey").alias("site"), F.coalesce("listings", F.lit(0).cast("long")).alias("listings"), "lowest")
    return out.orderBy("brand", "part", F.asc_nulls_first("site")).limit(limit)


@register("site_performance", f"SELECT s_suppkey AS site, s_name AS name, s_nationkey AS nation, count(l_orderkey) AS attempts, CAST(count_if(l_returnflag <> 'R') AS BIGINT) AS successes, round(avg(l_quantity), 6) AS mean_rows, round(coalesce(sum(l_extendedprice), 0), 2) AS collected FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_shipdate >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND l_shipdate < TIMESTAMP '{AS_OF}' GROUP BY ALL")
def site_performance(spark: SparkSession, sf: str, days: int = 90) -> DataFrame:
    """All sites with what they did in the last days; the time range is a part of the join, so idle sites stay."""
    s, l = read(spark, sf, "supplier"), read(spark, sf, "lineitem")
    now = F.lit(AS_OF).cast("timestamp_ntz")
    recent = (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("l_shipdate") >= now - F.make_dt_interval(F.lit(days))) & (F.col("l_shipdate") < now)
    return s.join(l, recent, "left").groupBy(F.col("s_suppkey").alias("site"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).agg(
        F.count("l_orderkey").alias("attempts"), F.count_if(F.col("l_returnflag") != "R").alias("successes"), F.round(F.avg("l_quantity"), 6).alias("mean_rows"), F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2).alias("collected")
    )


@register("multi_site_summary", "WITH l AS (SELECT l_partkey, nullif(l_extendedprice, 0) AS price, l_suppkey, l_returnflag FROM lineitem), a AS (SELECT l_partkey, count(*) AS sources, min(price) AS lowest, max(price) AS highest, round(avg(price), 6) AS mean, count(DISTINCT l_suppkey) AS sites, CAST(count_if(l_returnflag = 'A') AS BIGINT) AS n_a, CAST(count_if(l_returnflag = 'N') AS BIGINT) AS n_n, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS n_r FROM l GROUP BY 1), n AS (SELECT l_partkey, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR)))[1:8], ',') AS some_sites FROM l GROUP BY 1) SELECT p_partkey AS part, coalesce(sources, 0) AS sources, lowest, highest, mean, coalesce(sites, 0) AS sites, coalesce(n_a, 0) AS n_a, coalesce(n_n, 0) AS n_n, coalesce(n_r, 0) AS n_r, some_sites FROM part LEFT JOIN a ON a.l_partkey = p_partkey LEFT JOIN n ON n.l_partkey = p_partkey")
def multi_site_summary(spark: SparkSession, sf: str) -> DataFrame:
    """For each part its sources: price range (zero is no price), availability counts, the first eight sites."""
    l = read(spark, sf, "lineitem").withColumn("price", F.nullif("l_extendedprice", F.lit(0.0)))
    zero = F.lit(0).cast("long")
    flags = {"n_a": "A", "n_n": "N", "n_r": "R"}
    sums = l.groupBy("l_partkey").agg(
        F.count("*").alias("sources"), F.min("price").alias("lowest"), F.max("price").alias("highest"), F.round(F.avg("price"), 6).alias("mean"), F.size(F.collect_set("l_suppkey")).cast("long").alias("sites"),
        *[F.count_if(F.col("l_returnflag") == v).alias(k) for k, v in flags.items()], F.array_join(F.slice(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), 1, 8), ",").alias("some_sites"),
    )
    out = read(spark, sf, "part").join(sums, F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.select(F.col("p_partkey").alias("part"), F.coalesce("sources", zero).alias("sources"), "lowest", "highest", "mean", F.coalesce("sites", zero).alias("sites"), *[F.coalesce(k, zero).alias(k) for k in flags], "some_sites")


@register("uncached_pairs", WITH + "SELECT DISTINCT part_number, skp_part_number FROM m WHERE NOT EXISTS (SELECT 1 FROM part p WHERE 'P' || p.p_partkey = m.part_number AND p.p_size <= 25)")
def uncached_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose part has no cached image yet (anti join)."""
    cached = read(spark, sf, "part").filter("p_size <= 25").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("part_number"))
    return match_rows(spark, sf).select("part_number", "skp_part_number").distinct().join(cached, "part_number", "left_anti")


@register("with_existing_result", "SELECT p_partkey AS part, p_brand AS brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)")
def with_existing_result(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that have a strong result already (semi join)."""
    strong = read(spark, sf, "lineitem").filter("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf, "part").join(strong, "p_partkey", "left_semi").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))


@register("pair_lookup", "SELECT o_orderkey AS pair, c.c_name AS left_name, s.s_name AS right_name, round(coalesce(c.c_acctbal, 0) - coalesce(s.s_acctbal, 0), 6) AS difference FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN supplier s ON s.s_suppkey = o_orderkey % 997")
def pair_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair looks up both of its observations; a missing one leaves its columns null."""
    o, c, s = (read(spark, sf, t) for t in ("orders", "customer", "supplier"))
    out = o.join(c, o.o_custkey == c.c_custkey, "left").join(s, o.o_orderkey % 997 == s.s_suppkey, "left")
    return out.select(F.col("o_orderkey").alias("pair"), F.col("c_name").alias("left_name"), F.col("s_name").alias("right_name"), F.round(F.coalesce("c_acctbal", F.lit(0.0)) - F.coalesce("s_acctbal", F.lit(0.0)), 6).alias("difference"))


@register("baseline_asof", "WITH b AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline_date FROM orders) SELECT o_orderkey, o_custkey, baseline_date, CAST(date_diff('day', baseline_date, o_orderdate) AS INT) AS days_since FROM b")
def baseline_asof(spark: SparkSession, sf: str) -> DataFrame:
    """For each snapshot the last earlier baseline of the same customer (as-of join as a window)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate")), ignorenulls=True).over(w)
    return read(spark, sf, "orders").withColumn("baseline_date", base).select("o_orderkey", "o_custkey", "baseline_date", F.datediff("o_orderdate", "baseline_date").alias("days_since"))


@register("period_compare", f"WITH o AS (SELECT o_totalprice, CASE WHEN o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 1 ELSE 0 END AS recent FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND o_orderdate < TIMESTAMP '{AS_OF}') SELECT CAST(count_if(recent = 1) AS BIGINT) AS n_recent, CAST(count_if(recent = 0) AS BIGINT) AS n_older, round(avg(o_totalprice) FILTER (WHERE recent = 1), 4) AS mean_recent, round(avg(o_totalprice) FILTER (WHERE recent = 0), 4) AS mean_older, round(avg(o_totalprice) FILTER (WHERE recent = 1) - avg(o_totalprice) FILTER (WHERE recent = 0), 4) AS change FROM o")
def period_compare(spark: SparkSession, sf: str, days: int = 30) -> DataFrame:
    """A period against the one before it; the periods do not overlap."""
    now = F.lit(AS_OF).cast("timestamp_ntz")
    age = F.make_dt_interval(F.lit(days))
    o = read(spark, sf, "orders").filter((F.col("o_orderdate") >= now - age - age) & (F.col("o_orderdate") < now))
    recent = F.col("o_orderdate") >= now - age
    new, old = F.avg(F.when(recent, F.col("o_totalprice"))), F.avg(F.when(~recent, F.col("o_totalprice")))
    return o.agg(F.count_if(recent).alias("n_recent"), F.count_if(~recent).alias("n_older"), F.round(new, 4).alias("mean_recent"), F.round(old, 4).alias("mean_older"), F.round(new - old, 4).alias("change"))


#: Aliases of the brands that the alias join knows; (brand, alias).
ALIASES = (("ACME", "widget"), ("ACME", "small"), ("BOLTON", "bolt"), ("RODNEY", "rod"), ("COLDWELL", "cold"))


@register("brand_alias", "WITH a(brand, alias) AS (VALUES {}) SELECT p_partkey AS part, min(brand) AS brand, count(*) AS hits FROM part JOIN a ON p_name = alias OR contains(p_name, alias) GROUP BY 1".format(", ".join(f"('{b}', '{a}')" for b, a in ALIASES)))
def brand_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that name a brand or one of its aliases; the list of aliases is short and fixed, so it is broadcast."""
    known = spark.createDataFrame(list(ALIASES), "brand string, alias string")
    hit = (F.col("p_name") == F.col("alias")) | F.col("p_name").contains(F.col("alias"))
    return read(spark, sf, "part").join(F.broadcast(known), hit).groupBy(F.col("p_partkey").alias("part")).agg(F.min("brand").alias("brand"), F.count("*").alias("hits"))


@register("fitment_year_range", "WITH r AS (SELECT p_partkey, 1992 + p_size % 6 AS y0, 1992 + p_size % 6 + p_size % 4 AS y1 FROM part), e AS (SELECT p_partkey, unnest(range(y0, y1 + 1)) AS y FROM r), o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1) SELECT y AS model_year, count(*) AS parts, max(coalesce(n, 0)) AS orders FROM e LEFT JOIN o USING (y) GROUP BY 1")
def fitment_year_range(spark: SparkSession, sf: str) -> DataFrame:
    """Year ranges expand to years and join the orders of each year."""
    first = F.lit(1992) + F.col("p_size") % 6
    years = read(spark, sf, "part").select(F.explode(F.sequence(first, first + F.col("p_size") % 4)).alias("model_year"))
    per_year = years.groupBy(F.col("model_year").cast("long").alias("model_year")).agg(F.count("*").alias("parts"))
    orders = read(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("model_year")).agg(F.count("*").alias("orders"))
    return per_year.join(orders, "model_year", "left").withColumn("orders", F.coalesce("orders", F.lit(0).cast("long")))


@register("range_join", "WITH p AS (SELECT c_custkey AS k, c_acctbal AS lo, c_acctbal + 50 AS hi FROM customer) SELECT k, count(s_suppkey) AS n, round(coalesce(sum(s_acctbal), 0), 2) AS total FROM p LEFT JOIN supplier ON s_acctbal >= lo AND s_acctbal < hi GROUP BY k")
def range_join(spark: SparkSession, sf: str, width: float = 50.0) -> DataFrame:
    """Range join by bins: intervals of a fixed width meet at most two bins, so the join is an equality on the bin."""
    points = read(spark, sf, "supplier").select(F.floor(F.col("s_acctbal") / width).alias("bin"), "s_suppkey", "s_acctbal")
    spans = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + width).alias("hi"))
    probe = spans.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))))
    inside = probe.join(points, "bin").filter((F.col("s_acctbal") >= F.col("lo")) & (F.col("s_acctbal") < F.col("hi"))).groupBy("k").agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("total"))
    return spans.select("k").join(inside, "k", "left").select("k", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@register("full_outer_sites", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(nc, 0) AS customers, coalesce(ns, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS nc FROM customer WHERE c_acctbal > 5000 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def full_outer_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers by nation, nations of either side (full outer join)."""
    c = read(spark, sf, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    zero = F.lit(0).cast("long")
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", zero).alias("customers"), F.coalesce("suppliers", zero).alias("suppliers"))


@register("interchange_minus_self", WITH + "SELECT DISTINCT part_number, regexp_replace(upper(skp_part_number), '[ -]', '', 'g') AS other FROM m WHERE regexp_replace(upper(skp_part_number), '[ -]', '', 'g') <> upper(part_number) AND call12 > 45")
def interchange_minus_self(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct normalised counterparts of each part, itself left out."""
    other = F.regexp_replace(F.upper("skp_part_number"), "[ -]", "")
    return match_rows(spark, sf).filter("call12 > 45").select("part_number", other.alias("other")).filter(F.col("other") != F.upper("part_number")).distinct()


@register("sheet_union", WITH + "SELECT 'GMB' AS source, part_number FROM m WHERE sheet_name = 'GMB' AND call12 > 40 UNION ALL SELECT 'SMP', part_number FROM m WHERE sheet_name = 'SMP' AND call12 > 40")
def sheet_union(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two sheets, one after the other."""
    rows = match_rows(spark, sf).filter("call12 > 40")
    return rows.filter("sheet_name = 'GMB'").select(F.lit("GMB").alias("source"), "part_number").unionByName(rows.filter("sheet_name = 'SMP'").select(F.lit("SMP").alias("source"), "part_number"))


@register("sheet_intersect", WITH + "SELECT part_number FROM m WHERE sheet_name = 'GMB' INTERSECT SELECT part_number FROM m WHERE sheet_name = 'Anchor'")
def sheet_intersect(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that both sheets have."""
    rows = match_rows(spark, sf)
    return rows.filter("sheet_name = 'GMB'").select("part_number").intersect(rows.filter("sheet_name = 'Anchor'").select("part_number"))


@register("sheet_except", "WITH e(sheet_name) AS (VALUES {}, ('Master')), a AS (SELECT DISTINCT CASE l_suppkey % 5 WHEN 0 THEN 'GMB' WHEN 1 THEN 'Four Seasons ' WHEN 2 THEN 'SMP' WHEN 3 THEN 'Anchor' ELSE 'Dorman' END AS sheet_name FROM lineitem WHERE l_suppkey % 5 <> 2) (SELECT 'missing' AS problem, sheet_name FROM e EXCEPT SELECT 'missing', sheet_name FROM a) UNION ALL (SELECT 'extra', sheet_name FROM a EXCEPT SELECT 'extra', sheet_name FROM e WHERE sheet_name <> 'Dorman')".format(", ".join(f"('{s}')" for s in SHEETS)))
def sheet_except(spark: SparkSession, sf: str) -> DataFrame:
    """Expected sheets that are missing and found sheets that no one expected."""
    expected = spark.createDataFrame([(s,) for s in (*SHEETS, "Master")], "sheet_name string")
    found = match_rows(spark, sf).filter("sheet_name <> 'SMP'").select("sheet_name").distinct()
    missing = expected.exceptAll(found).select(F.lit("missing").alias("problem"), "sheet_name")
    return missing.unionByName(found.exceptAll(expected.filter("sheet_name <> 'Dorman'")).select(F.lit("extra").alias("problem"), "sheet_name"))


@register("oem_union_distinct", "WITH r AS (SELECT l_partkey, upper(replace(CASE WHEN l_linenumber % 2 = 0 THEN 'ab-' ELSE 'AB' END || CAST(l_suppkey % 40 AS VARCHAR), '-', '')) AS ref FROM lineitem) SELECT l_partkey AS part, count(DISTINCT ref) AS refs, array_to_string(list_sort(list(DISTINCT ref)), ',') AS all_refs FROM r GROUP BY 1")
def oem_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """References of all sources of a part, spelled alike, each once."""
    ref = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "ab-").otherwise("AB"), (F.col("l_suppkey") % 40).cast("string"))
    refs = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.upper(F.replace(ref, F.lit("-"), F.lit(""))).alias("ref"))
    return refs.groupBy("part").agg(F.collect_set("ref").alias("s")).select("part", F.size("s").cast("long").alias("refs"), F.array_join(F.sort_array("s"), ",").alias("all_refs"))


@register("upsert_latest", "SELECT l_partkey AS part, l_suppkey AS site, max(l_shipdate) AS seen, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS price FROM lineitem GROUP BY ALL")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Insert or replace: the newest row of each part and site wins."""
    newest = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("site")).agg(F.max("l_shipdate").alias("seen"), F.max_by("l_extendedprice", newest).alias("price"))


@register("dedup_first", WITH + "SELECT sheet_name, part_number, min(row_number) AS row_number FROM m GROUP BY ALL")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each part in each sheet; an aggregate, so that a hot part is combined before the shuffle."""
    return match_rows(spark, sf).groupBy("sheet_name", "part_number").agg(F.min("row_number").alias("row_number"))


@register("capped_inconsistencies", WITH + "SELECT kind, sheet_name, row_number, part_number, skp_part_number, confidence FROM (SELECT CASE WHEN confidence > 80 THEN 1 ELSE 2 END AS kind, * FROM m WHERE (confidence > 80 AND match_result IN ('NO', 'UNCERTAIN')) OR (confidence < 60 AND confidence <> 0 AND match_result IN ('YES', 'LIKELY'))) ORDER BY kind, sheet_name, row_number, part_number, skp_part_number LIMIT 50")
def capped_inconsistencies(spark: SparkSession, sf: str, cap: int = 50) -> DataFrame:
    """Verdicts that contradict their confidence, over-confident ones first; the report shows `cap` of them."""
    high = F.col("match_result").isin("NO", "UNCERTAIN") & (F.col("confidence") > 80)
    low = F.col("match_result").isin("YES", "LIKELY") & (F.col("confidence") < 60) & (F.col("confidence") != 0)
    rows = match_rows(spark, sf).filter(high | low).withColumn("kind", F.when(F.col("confidence") > 80, 1).otherwise(2))
    keys = ["kind", "sheet_name", "row_number", "part_number", "skp_part_number"]
    return rows.select(*keys, "confidence").orderBy(*keys).limit(cap)


#: Complexity and seconds by part type.
COMPLEXITY = {"ENGINE MOUNT": (0.3, 12.0), "BRAKE PAD": (0.2, 8.0), "FILTER": (0.1, 5.0), "SENSOR": (0.4, 15.0), "BELT": (0.2, 7.0)}
DEFAULT_COMPLEXITY = (0.25, 10.0)


def priority_score(rate: F.Column, trust: F.Column, part_type: F.Column, call12: F.Column, cpu: float, memory: float) -> F.Column:
    """History, simplicity, free resources, sales and expected time, weighted and clamped to 0..1."""
    complexity = chain([(part_type == k, v[0]) for k, v in COMPLEXITY.items()], DEFAULT_COMPLEXITY[0])
    seconds = chain([(part_type == k, v[1]) for k, v in COMPLEXITY.items()], DEFAULT_COMPLEXITY[1])
    sales = F.when(F.coalesce(call12, F.lit(0.0)) == 0, 0.1).otherwise(F.least(call12 / 100, F.lit(1.0)))
    score = rate * trust * 0.30 + (1 - complexity) * 0.20 + F.lit((1 - (0.6 * cpu + 0.4 * memory)) * 0.20) + sales * 0.15 + (1 - seconds / 20) * 0.15
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))


_CX = "CASE part_type " + " ".join(f"WHEN '{k}' THEN {v[0]}::DOUBLE" for k, v in COMPLEXITY.items()) + " ELSE 0.25::DOUBLE END"
_SEC = "CASE part_type " + " ".join(f"WHEN '{k}' THEN {v[1]}::DOUBLE" for k, v in COMPLEXITY.items()) + " ELSE 10.0::DOUBLE END"


@register("priority_topk", WITH + f", h AS (SELECT supplier, count_if(confirmed)::DOUBLE / nullif(count_if(processed), 0) AS rate, least(count_if(processed) / 100.0::DOUBLE, 1) AS trust FROM f GROUP BY supplier), s AS (SELECT row_number, part_number, skp_part_number, round(greatest(0, least(coalesce(rate, 0.5) * coalesce(trust, 0) * 0.30::DOUBLE + (1 - {_CX}) * 0.20::DOUBLE + 0.1::DOUBLE + CASE WHEN call12 = 0 THEN 0.1::DOUBLE ELSE least(call12 / 100, 1) END * 0.15::DOUBLE + (1 - {_SEC} / 20) * 0.15::DOUBLE, 1)), 6) AS score FROM f JOIN h USING (supplier)) SELECT * FROM s ORDER BY score DESC, row_number, part_number, skp_part_number LIMIT 25")
def priority_topk(spark: SparkSession, sf: str, batch: int = 25) -> DataFrame:
    """The next batch: rows with the highest priority, ties in row order."""
    rows = flagged(spark, sf)
    history = rows.groupBy("supplier").agg(F.try_divide(F.count_if("confirmed"), F.count_if("processed")).alias("rate"), F.least(F.count_if("processed") / 100.0, F.lit(1.0)).alias("trust"))
    score = priority_score(F.coalesce("rate", F.lit(0.5)), F.coalesce("trust", F.lit(0.0)), F.col("part_type"), F.col("call12"), cpu=0.5, memory=0.5)
    keys = ["row_number", "part_number", "skp_part_number"]
    return rows.join(history, "supplier").select(*keys, F.round(score, 6).alias("score")).orderBy(F.desc("score"), *keys).limit(batch)


@register("queue_order", "SELECT o_orderkey AS message, o_orderpriority AS priority, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P' ORDER BY priority, created_at DESC, message DESC LIMIT 10")
def queue_order(spark: SparkSession, sf: str, size: int = 10) -> DataFrame:
    """The next messages to deliver: most urgent first, newest first within a priority."""
    rows = read(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("message"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return rows.orderBy("priority", F.desc("created_at"), F.desc("message")).limit(size)


@register("best_and_worst_sheet", WITH + ", r AS (SELECT sheet_name, count_if(confirmed)::DOUBLE / nullif(count_if(processed), 0) AS success, count_if(processed)::DOUBLE / count(*) AS completion FROM f GROUP BY 1) SELECT arg_max(sheet_name, success) AS best_sheet, arg_min(sheet_name, completion) AS least_complete FROM r")
def best_and_worst_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The sheet with the best success rate and the one least complete."""
    rates = flagged(spark, sf).groupBy("sheet_name").agg(F.try_divide(F.count_if("confirmed"), F.count_if("processed")).alias("success"), (F.count_if("processed") / F.count("*")).alias("completion"))
    return rates.agg(F.max_by("sheet_name", "success").alias("best_sheet"), F.min_by("sheet_name", "completion").alias("least_complete"))


@register("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")))
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table."""
    counts = [read(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@register("update_by_key", WITH + "SELECT sheet_name, row_number, part_number, skp_part_number, coalesce(CASE WHEN match_result = 'UNCERTAIN' AND confidence >= 60 THEN 'LIKELY' END, match_result) AS match_result, coalesce(CASE WHEN match_result = 'UNCERTAIN' AND confidence >= 60 THEN 72 END, confidence) AS confidence FROM m WHERE call12 BETWEEN 20 AND 35")
def update_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Upgrades are written back by key: the update where there is one, else the old value."""
    rows = match_rows(spark, sf).filter("call12 between 20 and 35")
    keys = ["row_number", "part_number", "skp_part_number"]
    updates = rows.filter("match_result = 'UNCERTAIN' and confidence >= 60").select(*keys, F.lit("LIKELY").alias("new_result"), F.lit(72).alias("new_confidence")).distinct()
    return rows.join(updates, keys, "left").select("sheet_name", *keys, F.coalesce("new_result", "match_result").alias("match_result"), F.coalesce("new_confidence", "confidence").alias("confidence"))


@register("insert_ignore", "SELECT p_partkey AS part, p_brand AS brand, 'old' AS origin FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_brand, 'new' FROM part WHERE p_size BETWEEN 15 AND 30 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """New parts are appended unless their key is there."""
    part = read(spark, sf, "part")
    there = part.filter("p_size < 20").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.lit("old").alias("origin"))
    more = part.filter("p_size between 15 and 30").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.lit("new").alias("origin"))
    return there.unionByName(more.join(there, "part", "left_anti"))


@register("completion_gaps", WITH + f", v(match_result) AS (VALUES {', '.join(f'''('{v}')''' for v in VERDICTS)}), c(category) AS (SELECT DISTINCT category FROM f), n AS (SELECT category, match_result, count(*) AS n FROM f GROUP BY ALL) SELECT category, match_result, coalesce(n, 0) AS n FROM c CROSS JOIN v LEFT JOIN n USING (category, match_result)")
def completion_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of category and verdict with their rows, pairs without rows included."""
    rows = flagged(spark, sf)
    verdicts = F.explode(F.array(*map(F.lit, VERDICTS))).alias("match_result")
    spine = rows.select("category").distinct().select("category", verdicts)
    counts = rows.groupBy("category", "match_result").agg(F.count("*").alias("n"))
    return spine.join(counts, ["category", "match_result"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@register("point_lookup", "SELECT p_partkey AS part, p_name AS name, p_brand AS brand FROM part WHERE p_partkey = 77")
def point_lookup(spark: SparkSession, sf: str, part: int = 77) -> DataFrame:
    """one part by its number; the predicate reaches the scan."""
    return read(spark, sf, "part").filter(F.col("p_partkey") == part).select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).limit(1)


@register("latest_logs", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def latest_logs(spark: SparkSession, sf: str, n: int = 5) -> DataFrame:
    """The newest log rows."""
    return read(spark, sf, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


@register("least_loaded", "SELECT arg_min(user_id, (n, user_id)) AS session, min(n) AS calls FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)")
def least_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The session with the fewest calls, the first of several."""
    load = read(spark, sf, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return load.agg(F.min_by("user_id", F.struct("n", "user_id")).alias("session"), F.min("n").alias("calls"))


@register("quality_gate", WITH + "SELECT row_number, part_number, skp_part_number, coalesce(confidence >= 80 AND match_result IN ('YES', 'LIKELY', 'UNCERTAIN', 'NO') AND NOT contains(match_reason, 'error'), false) AS passes FROM m")
def quality_gate(spark: SparkSession, sf: str, least: int = 80) -> DataFrame:
    """results without an error, with a valid verdict and a confidence of 80 of 100 or more; the others are retried."""
    ok = (F.col("confidence") >= least) & F.col("match_result").isin(*VERDICTS) & ~F.col("match_reason").contains("error")
    return match_rows(spark, sf).select("row_number", "part_number", "skp_part_number", F.coalesce(ok, F.lit(False)).alias("passes"))


@register("fitment_text", "SELECT p_brand AS brand, substr(array_to_string(list_sort(list(DISTINCT (1990 + p_size % 20) || '-' || (1991 + p_size % 20) || ' ' || upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2))), '; '), 1, 200) AS fits FROM part GROUP BY 1")
def fitment_text(spark: SparkSession, sf: str) -> DataFrame:
    """Vehicles of a brand's parts as distinct texts, cut to 200 characters."""
    y = 1990 + F.col("p_size") % 20
    text = F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string"), F.lit(" "), F.initcap(F.split("p_name", " ")[0]))
    rows = read(spark, sf, "part").select(F.col("p_brand").alias("brand"), text.alias("t"))
    return rows.groupBy("brand").agg(F.substring(F.array_join(F.sort_array(F.collect_set("t")), "; "), 1, 200).alias("fits"))
