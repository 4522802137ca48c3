"""The match-result model over the input tables, as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import read

VERDICTS = ("YES", "LIKELY", "UNCERTAIN", "NO")
SHEETS = ("GMB", "Four Seasons ", "SMP", "Anchor", "Dorman")
#: The date that stands for "now" in all queries.
AS_OF = "2000-01-01"

# Part-type categories and their keywords, in the order in which they are tried.
CATEGORIES = {
    "Engine": ("ENGINE MOUNT", "ENGINE", "TIMING", "BELT", "GASKET"),
    "Brake": ("BRAKE", "PAD", "ROTOR", "CALIPER"),
    "Suspension": ("STRUT", "SHOCK", "SPRING", "MOUNT"),
    "Electrical": ("SENSOR", "SWITCH", "RELAY", "ALTERNATOR"),
    "Drivetrain": ("TRANSMISSION", "DRIVESHAFT", "CV", "AXLE"),
}
#: What the input's part nouns stand for.
NOUNS = {"widget": "ENGINE MOUNT", "bolt": "BRAKE PAD", "rod": "STRUT", "gear": "SENSOR", "nut": "CV AXLE"}


def chain(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """CASE WHEN over (condition, value) pairs."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to six places, zero where whole is zero."""
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), 6)


def category_of(part_type: Column) -> Column:
    """The first category with a keyword in the part type (upper case), else Other."""
    kind = F.upper(F.coalesce(part_type, F.lit("")))
    return chain([(F.greatest(*[kind.contains(w) for w in words]), name) for name, words in CATEGORIES.items()], "Other")


def match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each matched pair of parts: sheet, numbers, verdict, confidence, reason, time of the check."""
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    noun = F.substring_index("p_name", " ", -1)
    suppliers = F.element_at(F.array(*map(F.lit, SHEETS)), (F.col("l_suppkey") % 5 + 1).cast("int"))
    verdict = chain(
        [
            ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1), ""),
            (F.col("l_quantity") >= 40, "YES"),
            (F.col("l_quantity") >= 30, "LIKELY"),
            (F.col("l_quantity") >= 18, "UNCERTAIN"),
        ],
        "NO",
    )
    # Every seventh supplier's confidence runs against the verdict, so that the checks have something to find.
    confidence = F.floor(F.least(F.col("l_quantity") * 2 + F.col("l_linenumber"), F.lit(100.0))).cast("int")
    quarter = F.col("l_linenumber") % 4
    reason = chain(
        [(quarter == 0, F.concat(F.lit("Shared OEM reference AB"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"))), (quarter == 1, "no match found, different category"), (quarter == 2, "similar description and specs")],
        "",
    )
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        suppliers.alias("sheet_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"),
        chain([(noun == k, v) for k, v in NOUNS.items()], F.upper(noun)).alias("part_type"),
        F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("supplier"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part_number"),
        F.concat(F.lit("SK"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("skp_part_number"),
        F.col("l_quantity").alias("call12"),
        verdict.alias("match_result"),
        F.when(F.col("l_linenumber") != 7, F.when(F.col("l_suppkey") % 7 == 0, 100 - confidence).otherwise(confidence)).alias("confidence"),
        reason.alias("match_reason"),
        chain([(F.col("l_linenumber") % 3 == 0, "YES"), (F.col("l_linenumber") % 3 == 1, "NO")], "UNKNOWN").alias("fitment_match"),
        chain([(F.col("l_suppkey") % 3 == 0, "YES"), (F.col("l_suppkey") % 3 == 1, "PARTIAL")], "NO").alias("desc_match"),
        F.col("l_shipdate").alias("last_checked"),
    )


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_rows with processed, confirmed, both parts present, and the category."""
    result = F.col("match_result")
    return match_rows(spark, sf_dir).withColumns(
        {
            "processed": result.isin(*VERDICTS),
            "confirmed": result.isin("YES", "LIKELY"),
            "has_both": (F.col("part_number") != "") & (F.col("skp_part_number") != ""),
            "category": category_of(F.col("part_type")),
        }
    )


_NOUN_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOUNS.items())
_CATEGORY_SQL = " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"contains(part_type, '{w}')" for w in words), name) for name, words in CATEGORIES.items())
#: Common table expressions m (match_rows) and f (flagged) for DuckDB.
WITH = f"""
WITH m AS (SELECT CASE l.l_suppkey % 5 WHEN 0 THEN 'GMB' WHEN 1 THEN 'Four Seasons ' WHEN 2 THEN 'SMP' WHEN 3 THEN 'Anchor' ELSE 'Dorman' END AS sheet_name,
  l.l_orderkey * 10 + l.l_linenumber AS row_number,
  CASE split_part(p.p_name, ' ', -1) {_NOUN_SQL} ELSE upper(split_part(p.p_name, ' ', -1)) END AS part_type,
  upper(replace(p.p_brand, '#', '')) AS supplier, 'P' || l.l_partkey AS part_number, 'SK' || l.l_suppkey || '-' || l.l_partkey AS skp_part_number,
  l.l_quantity AS call12,
  CASE WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'O' AND l.l_linenumber = 1 THEN '' WHEN l.l_quantity >= 40 THEN 'YES' WHEN l.l_quantity >= 30 THEN 'LIKELY'
       WHEN l.l_quantity >= 18 THEN 'UNCERTAIN' ELSE 'NO' END AS match_result,
  CASE WHEN l.l_linenumber = 7 THEN NULL WHEN l.l_suppkey % 7 = 0 THEN 100 - CAST(floor(least(l.l_quantity * 2 + l.l_linenumber, 100)) AS INT) ELSE CAST(floor(least(l.l_quantity * 2 + l.l_linenumber, 100)) AS INT) END AS confidence,
  CASE l.l_linenumber % 4 WHEN 0 THEN 'Shared OEM reference AB' || lpad(CAST(l.l_partkey AS VARCHAR), 6, '0') WHEN 1 THEN 'no match found, different category'
       WHEN 2 THEN 'similar description and specs' ELSE '' END AS match_reason,
  CASE l.l_linenumber % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE 'UNKNOWN' END AS fitment_match,
  CASE l.l_suppkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'PARTIAL' ELSE 'NO' END AS desc_match, l.l_shipdate AS last_checked
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
f AS (SELECT *, match_result IN ('YES', 'LIKELY', 'UNCERTAIN', 'NO') AS processed, match_result IN ('YES', 'LIKELY') AS confirmed,
  part_number <> '' AND skp_part_number <> '' AS has_both, CASE {_CATEGORY_SQL} ELSE 'Other' END AS category FROM m)
"""
