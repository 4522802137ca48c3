"""Exact medians of groups of any size, by selection: no task holds the values of a large group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from interlace.streaming.windows import stream_dir

#: Values that are sorted at once, and ranges into which the values of a larger group are divided in a round.
SORTED, RANGES = 10_000, 32


def _narrowed(rows: DataFrame, spans: DataFrame, group: str, value: str) -> DataFrame:
    """spans (group, lo, hi, k, k2, n) narrowed to the range of values that holds the two places k and k2 of each.

    Approximate quantiles only say where ranges begin; what lies in each range, and at its bounds, is counted exactly.
    """
    inside = rows.join(spans, group).filter(F.col(value).between(F.col("lo"), F.col("hi")))
    bounds = inside.groupBy(group).agg(F.array_distinct(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000)).alias("bounds"))
    v = F.col(value)
    # Twice the number of bounds below a value, one more if it is a bound: equal values are a range of their own.
    at = 2 * F.size(F.filter("bounds", lambda b: b < v)) + F.array_contains("bounds", v).cast("int")
    counts = inside.join(bounds, group).groupBy(group, at.alias("at")).agg(F.count("*").alias("own"), F.min(value).alias("low"), F.max(value).alias("high"))
    along = Window.partitionBy(group).orderBy("at")
    counts = counts.withColumn("before", F.sum("own").over(along) - F.col("own")).join(spans.select(group, "k", "k2"), group)
    holds = lambda k: (F.col("before") < F.col(k)) & (F.col(k) <= F.col("before") + F.col("own"))
    first = lambda c, k: F.max(F.when(holds(k), F.col(c)))
    found = counts.groupBy(group).agg(
        first("low", "k").alias("lo"), first("high", "k").alias("top"), first("low", "k2").alias("low2"), first("high", "k2").alias("hi"),
        first("before", "k").alias("before"), F.max("k").alias("k"), F.max("k2").alias("k2"), first("own", "k").alias("own"), (first("at", "k") == first("at", "k2")).alias("one"),
    )
    # In two ranges the places are neighbours: the end of the one and the beginning of the other.
    edge = lambda a, b: F.when(F.col("one"), F.col(a)).otherwise(F.col(b))
    place = lambda k, of_two: F.when(F.col("one"), F.col(k) - F.col("before")).otherwise(F.lit(of_two).cast("long")).alias(k)
    left = F.when(F.col("one"), F.col("own")).otherwise(F.lit(2).cast("long")).alias("n")
    return found.select(group, edge("lo", "top").alias("lo"), edge("hi", "low2").alias("hi"), place("k", 1), place("k2", 2), left)


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median) of the values that are not null, for each group that has any and is not null; the mean of the two middle
    ones in a group of even size. Large groups are narrowed round by round; small ones are sorted."""
    spark = rows.sparkSession
    rows = rows.select(group, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    n = F.count("*")
    spans = rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.floor((n + 1) / 2).alias("k"), (F.floor(n / 2) + 1).alias("k2"), n.alias("n"))

    def written(table: DataFrame) -> DataFrame:
        path = stream_dir(spark)
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    spans = written(spans)
    large = lambda: (F.col("n") > SORTED) & (F.col("lo") < F.col("hi"))
    done = spans.filter(~large())
    while not (spans := spans.filter(large())).isEmpty():
        spans = written(_narrowed(rows, spans, group, value))
        done = done.unionByName(spans.filter(~large()))
    # What is left of a group is one value, two neighbours, or few enough rows to sort.
    equal = done.filter("lo = hi").select(group, F.col("lo").alias("median"))
    two = done.filter("lo < hi AND n = 2").select(group, ((F.col("lo") + F.col("hi")) / 2).alias("median"))
    few = rows.join(done.filter("lo < hi AND n > 2"), group).filter(F.col(value).between(F.col("lo"), F.col("hi")))
    few = few.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("all"), F.max("k").alias("k"), F.max("k2").alias("k2"))
    few = few.select(group, ((F.element_at("all", F.col("k").cast("int")) + F.element_at("all", F.col("k2").cast("int"))) / 2).alias("median"))
    return equal.unionByName(two).unionByName(few)
