"""Similarity join of reference numbers: all pairs whose spelling is alike, without comparing all pairs.

The ratio of two strings is 2M/T: M characters in matching blocks of T in both. M is at most the length of a common
subsequence, so a ratio of RATIO or more leaves few characters unmatched, and their number follows from the two lengths.
Short strings meet at what is left when so many characters are deleted from each. Long ones meet at their rarest 3-grams:
an unmatched character destroys three grams at most on its side and two on the other, which bounds how many are shared.
Both ways keep every pair that the ratio keeps; the ratio is then computed for the candidates alone.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.functions import text as X
from interlace.operators.scoring import RATIO, observations
from interlace.plans.registry import register

#: Strings up to this length are short: fewer than 500 strings arise from one by deleting what may be unmatched.
SHORT = 15
#: Letters of the grams of long strings, and how many of the most frequent grams are known when rare ones are put first.
GRAM, FREQUENT = 3, 4096
#: Rows of a key that one task compares with each other at most; a key with more is divided in blocks.
BLOCK = 500


def matched(left: Column, right: Column) -> Column:
    """The least M for which 2M/T reaches RATIO, from the two lengths."""
    total = left + right
    near = F.floor(total * (RATIO / 2)).cast("int")
    return F.when(2.0 * near / total >= RATIO, near).otherwise(near + 1)


def deletions(text: Column, times: int) -> Column:
    """The distinct strings that are left when `times` characters are deleted."""
    once = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.left(s, i - 1), F.substr(s, i + 1)))
    if times == 0:
        return F.array(text)
    return F.array_distinct(once(text) if times == 1 else F.flatten(F.transform(deletions(text, times - 1), once)))


def short_keys(refs: DataFrame) -> DataFrame:
    """(key, side, ref) for short strings: for each length that a similar string may have and that occurs, what deletions leave."""
    least = [min(m for m in range(1, n + 1) if 2 * m >= RATIO * (n + m)) for n in range(1, SHORT + 1)]
    size, most = F.length("ref"), SHORT - math.ceil(RATIO / 2 * (SHORT + least[-1]))
    rows = refs.filter(size.between(1, SHORT)).withColumn("size", size)
    lengths = rows.agg(F.collect_set("size").alias("lengths"))  # one row, SHORT lengths at most
    rows = rows.join(F.broadcast(lengths)).withColumn("other", F.explode(F.filter("lengths", lambda m: matched(F.col("size"), m) <= F.least("size", m))))
    spare = F.col("size") - matched(F.col("size"), F.col("other"))
    left = reduce(lambda c, n: c.when(spare == n, deletions(F.col("ref"), n)), range(1, most + 1), F.when(spare == 0, deletions(F.col("ref"), 0)))
    key = F.concat_ws(" ", F.least("size", "other"), F.greatest("size", "other"), F.col("rest"))
    return rows.withColumn("rest", F.explode(left)).select(key.alias("key"), F.signum(F.col("other") - F.col("size")).cast("int").alias("side"), "ref")


def grams(text: Column) -> Column:
    """The distinct grams of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substr(text, i, F.lit(GRAM))))


def destroyed(own: Column, other: Column) -> Column:
    """How many distinct grams of a string of length `own` a similar string of length `other` may lack, at most."""
    least = matched(own, other)
    return GRAM * (own - least) + (GRAM - 1) * (other - least)


def long_keys(refs: DataFrame) -> DataFrame:
    """(key, side, ref): the rarest grams of strings that are long, or long enough to be similar to a long one.

    One gram more than a similar string may lack: so the first gram in order that both have is among the keys of each. The
    order decides only how many candidates arise, not which pairs are found.
    """
    shortest = min(m for m in range(1, SHORT + 2) if 2 * m >= RATIO * (SHORT + 1 + m))
    size = F.length("ref")
    rows = refs.filter(size >= shortest).withColumn("size", size).withColumn("grams", grams(F.col("ref")))
    counts = rows.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT)
    known = counts.agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("known"))  # one row of FREQUENT entries at most
    ranked = F.array_sort(F.transform("grams", lambda g: F.struct(F.coalesce(F.try_element_at("known", g), F.lit(0)).alias("n"), F.xxhash64(g).alias("h"), g.alias("gram"))))
    # The most grams that any similar string may lack, over all lengths that it may have.
    ends = (F.ceil(F.col("size") * (RATIO / (2 - RATIO))).cast("int"), F.floor(F.col("size") * ((2 - RATIO) / RATIO)).cast("int"))
    worst = F.array_max(F.transform(F.sequence(*ends), lambda m: F.when(matched(F.col("size"), m) <= F.least(F.col("size"), m), destroyed(F.col("size"), m)).otherwise(0)))
    rows = rows.join(F.broadcast(known)).withColumn("ranked", ranked).withColumn("first", F.slice("ranked", 1, worst + 1))
    return rows.select(F.explode("first.gram").alias("key"), F.lit(0).alias("side"), "ref")


def meeting(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, keys: how many they share) of different refs with one key and opposite sides (or both 0), a before b. A key of more than BLOCK rows is divided
    in blocks by hash, and each pair of its blocks is a key of its own, so no task compares more than two blocks.

    The joins are by shuffle in any case: a row has many keys and a key many pairs, which the estimates before a run know nothing
    of, and by these all keys would be broadcast through the driver."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    rows = rows.join(sizes.hint("merge"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = (F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    rows = rows.select("key", *cell, "own", "side", "ref")
    side = lambda name: rows.select("key", "low", "high", F.col("own").alias(f"{name}_own"), F.col("side").alias(f"{name}_side"), F.col("ref").alias(name))
    # In the cell of two blocks only pairs across them count; pairs inside a block belong to its own cell.
    across = (F.col("low") == F.col("high")) | (F.col("a_own") != F.col("b_own"))
    return side("a").join(side("b").hint("merge"), ["key", "low", "high"]).filter((F.col("a") < F.col("b")) & across & (F.col("a_side") == -F.col("b_side"))).groupBy("a", "b").agg(F.count("*").alias("keys"))


def candidates(refs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, keys) of refs, a before b, among them all whose ratio is RATIO or more in either order."""
    short, long = meeting(short_keys(refs)), meeting(long_keys(refs))
    a, b = F.length("a"), F.length("b")
    long = long.filter((F.greatest(a, b) > SHORT) & (matched(a, b) <= F.least(a, b)))
    left, right = grams(F.col("a")), grams(F.col("b"))
    shared = F.size(F.array_intersect(left, right))
    enough = (shared >= F.size(left) - destroyed(a, b)) & (shared >= F.size(right) - destroyed(b, a))
    return short.unionByName(long.filter(once(enough)))


def once(value: Column) -> Column:
    """The value, named so that it stays behind the grouping of the pairs: before it, each would be computed for each key."""
    return F.when(F.col("keys") > 0, value)


def similar(refs: DataFrame, ref: str = "ref") -> DataFrame:
    """(a, b, ratio) for all pairs of different strings in column `ref` with a before b and a ratio of RATIO or more.

    Strings are distinct values: copies are one string, as are its many rows; nulls and empty strings are similar to nothing.
    The ratio depends on the order in rare cases; the greater of both counts. Other columns are not read.
    """
    distinct = refs.select(F.col(ref).alias("ref")).filter(F.length("ref") > 0).distinct()
    return candidates(distinct).withColumn("ratio", once(X.either_ratio("a", "b"))).filter(F.col("ratio") >= RATIO).drop("keys")


def linked(refs: DataFrame, ref: str = "ref") -> DataFrame:
    """(a, b, score) of different normal references: one base number .7, otherwise similar spelling .5 (J06 over all pairs)."""
    distinct = refs.select(F.col(ref).alias("ref")).filter(F.length("ref") > 0).distinct()
    based = distinct.select(X.base_reference(F.col("ref")).alias("key"), F.lit(0).alias("side"), "ref").filter(F.length("key") > 0)
    same = meeting(based).select("a", "b", F.lit(0.7).alias("score"))
    near = similar(distinct).filter(X.base_reference(F.col("a")) != X.base_reference(F.col("b"))).select("a", "b", F.lit(0.5).alias("score"))
    return same.unionByName(near)


def part_references(spark: SparkSession, sf: str) -> DataFrame:
    """(part, ref) with the normal references of the parts; every 50th part also has one with a slip of the pen."""
    refs = observations(spark, sf).select("part", F.explode("refs").alias("ref"), "refs").withColumn("ref", X.normal_reference(F.col("ref")))
    slip = F.concat(F.left("ref", F.lit(3)), F.lit("9"), F.substr("ref", F.lit(5)))
    return refs.withColumn("ref", F.explode(F.when(F.col("part") % 50 == 7, F.array("ref", slip)).otherwise(F.array("ref")))).select("part", "ref")


# DuckDB has no such ratio. All pairs whose edit distance could allow it are compared block by block, as the ratio is defined:
# the longest common block, the first in a and then in b among equals, and so on to its left and right.
_REFS = """
WITH RECURSIVE o AS (SELECT p_partkey AS part, '7B0' || lpad(CAST(p_partkey // 3 AS VARCHAR), 6, '0') || CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS ref FROM part WHERE p_partkey % 11 <> 0),
refs AS (SELECT part, ref FROM o UNION ALL SELECT part, substr(ref, 1, 3) || '9' || substr(ref, 5) FROM o WHERE part % 50 = 7),
d AS (SELECT ref, count(*) AS parts, regexp_replace(ref, '[A-Z]{1,2}$', '') AS base FROM refs GROUP BY ref)
"""
_SQL = _REFS + f"""
, c AS (SELECT x.ref AS a, y.ref AS b, x.base = y.base AS same, x.parts AS a_parts, y.parts AS b_parts FROM d x JOIN d y ON x.ref < y.ref AND (x.base = y.base OR levenshtein(x.ref, y.ref) <= {1 - RATIO} * (length(x.ref) + length(y.ref)) + 0.001)),
way AS (SELECT a AS l, b AS r FROM c WHERE NOT same UNION ALL SELECT b, a FROM c WHERE NOT same),
blocks(l, r, alo, ahi, blo, bhi, got) AS (
  SELECT l, r, 1, length(l) + 1, 1, length(r) + 1, 0 FROM way
  UNION ALL
  SELECT l, r, CASE side WHEN 0 THEN alo ELSE best.i + best.k END, CASE side WHEN 0 THEN best.i ELSE ahi END, CASE side WHEN 0 THEN blo ELSE best.j + best.k END, CASE side WHEN 0 THEN best.j ELSE bhi END, CASE side WHEN 0 THEN best.k ELSE 0 END
  FROM (SELECT l, r, alo, ahi, blo, bhi, list_sort(list_filter(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j:
          {{'nk': -len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: substr(l, i, n) = substr(r, j, n))), 'i': i, 'j': j, 'k': len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: substr(l, i, n) = substr(r, j, n)))}}))), lambda s: s.k > 0))[1] AS best
        FROM blocks WHERE ahi > alo AND bhi > blo) CROSS JOIN (VALUES (0), (1)) AS t(side) WHERE best.k > 0),
ratios AS (SELECT l, r, 2.0::DOUBLE * sum(got) / (length(l) + length(r)) AS ratio FROM blocks GROUP BY l, r),
best AS (SELECT least(l, r) AS a, greatest(l, r) AS b, max(ratio) AS ratio FROM ratios GROUP BY ALL)
SELECT c.a, c.b, CASE WHEN same THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS score, a_parts, b_parts FROM c LEFT JOIN best USING (a, b) WHERE same OR best.ratio >= {RATIO}
"""


@register("reference_links", _SQL)
def reference_links(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of references of all parts that share a base number or are spelled alike, with the parts that have each.

    A row for each pair of different references; parts with one and the same reference are counted, not paired.
    """
    refs = part_references(spark, sf)
    parts = refs.groupBy("ref").agg(F.count("*").alias("parts"))
    side = lambda name: parts.toDF(name, f"{name}_parts")
    return linked(refs).join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "score", "a_parts", "b_parts")
