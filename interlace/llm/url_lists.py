"""URL filter by dated list entries: validity intervals and an as-of join. DataFrame functions only.

A list feed has rows (host, listed_at, action); 'add' opens an interval and 'remove' closes it. A capture is blocked
if its host or one of its parent domains is inside an interval at the fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_ROWS, HOT_SHARE, table

#: Open end of an interval that no later entry closes.
FOREVER = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty for a null or odd URL."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def suffixes(host: Column) -> Column:
    """The host and all its parent domains of two labels or more."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    take = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    return F.when(n < 2, F.array(host)).otherwise(take)


def intervals(feed: DataFrame) -> DataFrame:
    """(host, valid_from, valid_to): for each host the maximal spans in which it is listed.

    Entries at one instant count as one: 'remove' wins. Repeats of the state that holds already are ignored, so the
    spans of a host are disjoint. Rows with a null host or time, or with another action, are ignored.
    """
    rows = feed.filter(F.col("host").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin("add", "remove"))
    # One row per host and instant before the window: repeated feed rows are combined on the map side.
    rows = rows.groupBy("host", "listed_at").agg(F.min(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("host").orderBy("listed_at")
    rows = rows.withColumn("before", F.lag("on").over(w)).filter(~F.col("on").eqNullSafe(F.col("before")))
    rows = rows.withColumn("valid_to", F.coalesce(F.lead("listed_at").over(w), F.lit(FOREVER).cast("timestamp_ntz")))
    return rows.filter("on").select("host", F.col("listed_at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, feed: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """(key, host, fetched_at, n_hits, listed_host, listed_since, blocked) for every distinct capture (key, host, time).

    listed_host is the longest listed domain at the fetch time. A null fetch time is never blocked. Captures are grouped
    by (host, time) first. The join is as-of: a domain's spans and times are sorted together, and each time takes the
    latest span that starts at or before it; spans of a domain are disjoint, so no other can hold it. A domain with more
    than a HOT_SHARE-th of all times is dealt to pieces, each of which has all its spans.
    """
    rows = captures.select(F.col(key), host_of(F.col(url)).alias("host"), F.col(at).cast("timestamp_ntz").alias("fetched_at")).distinct()
    times = rows.filter(F.col("fetched_at").isNotNull()).select("host", "fetched_at").distinct()
    probe = times.select("host", F.col("fetched_at").alias("at"), F.explode(suffixes(F.col("host"))).alias("domain"))
    limit = max(HOT_ROWS, probe.count() // HOT_SHARE)
    hot = probe.groupBy("domain").count().filter(F.col("count") > limit)  # HOT_SHARE rows at most
    hot = F.broadcast(hot.select("domain", F.ceil(F.col("count") / limit).cast("int").alias("pieces")))
    pieces = F.coalesce("pieces", F.lit(1))
    spans = intervals(feed).withColumnRenamed("host", "domain").join(hot, "domain", "left")
    spans = spans.select("domain", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.col("valid_from").alias("at"), F.struct("valid_from", "valid_to").alias("span"))
    probe = probe.join(hot, "domain", "left").select("domain", F.pmod(F.xxhash64("host", "at"), pieces).cast("int").alias("piece"), "at", "host")
    latest = Window.partitionBy("domain", "piece").orderBy("at", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = spans.unionByName(probe, allowMissingColumns=True).withColumn("span", F.last("span", ignorenulls=True).over(latest))
    found = found.filter(F.col("host").isNotNull() & (F.col("at") < F.col("span.valid_to")))
    hits = found.groupBy("host", F.col("at").alias("fetched_at")).agg(
        F.count("*").alias("n_hits"),
        F.max(F.struct(F.length("domain").alias("n"), F.col("domain"), F.col("span.valid_from"))).alias("best"),
    )
    hits = hits.select("host", "fetched_at", "n_hits", F.col("best.domain").alias("listed_host"), F.col("best.valid_from").alias("listed_since"))
    out = rows.join(hits, ["host", "fetched_at"], "left")
    return out.select(key, "host", "fetched_at", F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"), "listed_host", "listed_since", F.col("listed_host").isNotNull().alias("blocked"))


# The tables hold no fetch times and no list: both are derived from the rows by fixed rules that SQL can repeat.
def fetch_time(page: Column) -> Column:
    """A minute of the year 2024, fixed by the page id."""
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(page * 7919, F.lit(525600)).cast("int"))


def derived_feed(pages: DataFrame) -> DataFrame:
    """Every third domain, by its MD5, is added once and removed later; every ninth is added again, every other host is kept out."""
    base = pages.select(host_of(F.col("url")).alias("whole")).distinct().select(F.array_join(F.slice(F.split("whole", r"\."), -3, 3), ".").alias("host"), F.size(F.split("whole", r"\.")).alias("n"))
    base = base.filter((F.col("n") >= 3)).select("host").distinct()
    number = lambda a: F.conv(F.substring(F.md5("host"), a, 4), 16, 10).cast("int")
    base = base.withColumns({"h": number(1), "first": number(5) % 200, "second": number(9) % 100 + 20, "third": number(13) % 60 + 10})
    day = lambda n: F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(n)
    entries = F.array(
        F.struct(day(F.col("first")).alias("listed_at"), F.lit("add").alias("action"), F.lit(True).alias("real")),
        F.struct(day(F.col("first") + F.col("second")).alias("listed_at"), F.lit("remove").alias("action"), F.lit(True).alias("real")),
        F.struct(day(F.col("first") + F.col("second") + F.col("third")).alias("listed_at"), F.lit("add").alias("action"), (F.col("h") % 9 == 0).alias("real")),
    )
    rows = base.filter(F.col("h") % 3 == 0).select("host", F.explode(entries).alias("e"))
    return rows.filter("e.real").select("host", "e.listed_at", "e.action")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(pages.withColumn("fetched_at", fetch_time(F.col("page_id"))), derived_feed(pages))


SQL = r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
             regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS host,
             TIMESTAMP '2024-01-01' + to_minutes(CAST((page_id * 7919) % 525600 AS BIGINT)) AS fetched_at FROM pages),
rows AS (SELECT DISTINCT page_id, host, fetched_at, string_split(host, '.') AS parts FROM p),
base AS (SELECT DISTINCT array_to_string(parts[-3:], '.') AS host FROM rows WHERE len(parts) >= 3),
num AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INT) AS h, CAST('0x' || substr(md5(host), 5, 4) AS INT) % 200 AS a,
          CAST('0x' || substr(md5(host), 9, 4) AS INT) % 100 + 20 AS b, CAST('0x' || substr(md5(host), 13, 4) AS INT) % 60 + 10 AS c FROM base),
spans AS (SELECT host AS domain, TIMESTAMP '2024-01-01' + to_days(a) AS valid_from, TIMESTAMP '2024-01-01' + to_days(a + b) AS valid_to FROM num WHERE h % 3 = 0
          UNION ALL SELECT host, TIMESTAMP '2024-01-01' + to_days(a + b + c), TIMESTAMP '9999-12-31' FROM num WHERE h % 9 = 0),
dom AS (SELECT DISTINCT host, unnest(list_distinct(list_append(list_transform(range(2, len(parts) + 1), lambda k: array_to_string(parts[-k:], '.')), host))) AS domain FROM rows),
hits AS (SELECT r.page_id, r.host, r.fetched_at, count(*) AS n_hits, max({'n': length(s.domain), 'domain': s.domain, 'valid_from': s.valid_from}) AS best
         FROM rows r JOIN dom USING (host) JOIN spans s USING (domain) WHERE r.fetched_at >= s.valid_from AND r.fetched_at < s.valid_to GROUP BY ALL)
SELECT r.page_id, r.host, r.fetched_at, coalesce(n_hits, 0) AS n_hits, best.domain AS listed_host, best.valid_from AS listed_since, best IS NOT NULL AS blocked
FROM rows r LEFT JOIN hits h ON h.page_id = r.page_id AND h.host = r.host AND h.fetched_at = r.fetched_at
"""
