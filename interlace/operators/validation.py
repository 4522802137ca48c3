"""Validation of input rows, outputs and results: error and warning lists, and scores from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.plans.model import VERDICTS, WITH, chain, flagged, match_rows
from interlace.plans.registry import register

# Ranges of confidence by verdict (least, most, expected least).
CALIBRATION = {"YES": (80, 100, 85), "LIKELY": (60, 95, 65), "UNCERTAIN": (30, 80, 35), "NO": (0, 60, 10)}
# Patterns of reasons by quality, tried level by level.
REASON_LEVELS = {
    "high_quality": ("shared.*oem.*ref", "identical.*part.*number", "same.*manufacturer", "exact.*match", "confirmed.*fitment"),
    "medium_quality": ("similar.*description", "compatible.*spec", "matching.*category", "cross.*reference"),
}


def found(*cases: tuple[Column, str]) -> Column:
    """The messages of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in cases]))


def row_problems() -> tuple[Column, Column]:
    """Errors and warnings of an input row."""
    n, blank = F.col("skp_part_number"), lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    errors = found((blank("part_type"), "part type is missing"), (blank("supplier"), "brand is missing"), (blank("part_number"), "part number is missing"), (F.length(n) < 2, "part number is too short"), (F.length(n) > 50, "part number is too long"), (F.col("call12") < 0, "sales are negative"))
    warnings = found((F.length("part_type") < 4, "part type is short"), (~n.rlike("^[A-Za-z0-9.-]+$"), "part number has odd characters"), (F.col("call12") > 45, "sales are unusually high"), (F.length(n) > 8, "part number is long"))
    return errors, warnings


@register("validate_rows", WITH + "SELECT row_number, part_number, skp_part_number, CAST(CAST(length(skp_part_number) < 2 AS INT) + CAST(length(skp_part_number) > 50 AS INT) + CAST(call12 < 0 AS INT) AS BIGINT) AS errors, CAST(CAST(length(part_type) < 4 AS INT) + CAST(call12 > 45 AS INT) + CAST(length(skp_part_number) > 8 AS INT) AS BIGINT) AS warnings, round((CASE WHEN length(part_type) < 4 THEN 0.8::DOUBLE ELSE 1 END + 1 + CASE WHEN length(skp_part_number) > 8 THEN 0.8::DOUBLE ELSE 1 END + CASE WHEN call12 > 45 THEN 0.8::DOUBLE ELSE 1 END) / 4, 6) AS score FROM m")
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Errors, warnings and the mean of the field scores (0 with an error, .8 with a warning) of each row."""
    errors, warnings = row_problems()
    has = lambda list_, word: F.exists(list_, lambda m: m.startswith(word))
    rows = match_rows(spark, sf).withColumns({"e": errors, "w": warnings})
    field = lambda word: F.when(has(F.col("e"), word), 0.0).when(has(F.col("w"), word), 0.8).otherwise(1.0)
    score = (field("part type") + field("brand") + field("part number") + field("sales")) / 4
    return rows.select("row_number", "part_number", "skp_part_number", F.size("e").cast("long").alias("errors"), F.size("w").cast("long").alias("warnings"), F.round(score, 6).alias("score"))


@register("validate_outputs", WITH + "SELECT row_number, part_number, skp_part_number, array_to_string(list_filter([CASE WHEN match_result NOT IN ('YES', 'LIKELY', 'UNCERTAIN', 'NO') THEN 'verdict' END, CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 100 THEN 'confidence' END, CASE WHEN match_reason = '' THEN 'reason' END], lambda x: x IS NOT NULL), ',') AS problems FROM m")
def validate_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Which output fields are outside their domain."""
    problems = found((~F.col("match_result").isin(*VERDICTS), "verdict"), (F.col("confidence").isNull() | ~F.col("confidence").between(0, 100), "confidence"), (F.col("match_reason") == "", "reason"), (~F.col("fitment_match").isin("YES", "NO", "UNKNOWN"), "fitment"), (~F.col("desc_match").isin("YES", "NO", "PARTIAL"), "description"))
    return match_rows(spark, sf).select("row_number", "part_number", "skp_part_number", F.array_join(problems, ",").alias("problems"))


def calibration_warning() -> Column:
    """Outside the verdict's range, or below what is expected of it."""
    c, v = F.col("confidence"), F.col("match_result")
    return chain([((v == k) & ~c.between(a, b), "outside") for k, (a, b, _) in CALIBRATION.items()] + [((v == k) & (c < e), "low") for k, (_, _, e) in CALIBRATION.items()], "fits")


def reason_level() -> Column:
    r = F.lower("match_reason")
    return chain([(r.rlike("|".join(p)), level) for level, p in REASON_LEVELS.items()] + [(F.length("match_reason") < 10, "insufficient")], "low_quality")


_CAL = "CASE " + " ".join(f"WHEN match_result = '{k}' AND NOT confidence BETWEEN {a} AND {b} THEN 'outside'" for k, (a, b, _) in CALIBRATION.items()) + " " + " ".join(f"WHEN match_result = '{k}' AND confidence < {e} THEN 'low'" for k, (_, _, e) in CALIBRATION.items()) + " ELSE 'fits' END"
_LEVEL = "CASE " + " ".join("WHEN regexp_matches(lower(match_reason), '{}') THEN '{}'".format("|".join(p), level) for level, p in REASON_LEVELS.items()) + " WHEN length(match_reason) < 10 THEN 'insufficient' ELSE 'low_quality' END"
_RESULTS = WITH + f", v AS (SELECT *, {_CAL} AS calibration, {_LEVEL} AS reason_level, CAST(match_reason = '' AS INT) + CAST(length(match_reason) > 0 AND length(match_reason) < 10 AS INT) + CAST({_LEVEL} = 'low_quality' AS INT) AS reason_warnings, CAST(contains(match_reason, 'OEM') AND match_result = 'NO' AS INT) AS oem_warnings FROM f WHERE processed AND confidence IS NOT NULL), q AS (SELECT *, round(0.3::DOUBLE + 0.3::DOUBLE * CASE calibration WHEN 'low' THEN 0.8::DOUBLE ELSE 1 END + 0.25::DOUBLE * greatest(0, 1 - 0.2::DOUBLE * reason_warnings) + 0.15::DOUBLE * greatest(0, 1 - 0.3::DOUBLE * oem_warnings), 6) AS score FROM v)"


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration, reason level, warnings and the quality score of each result."""
    rows = flagged(spark, sf).filter("processed and confidence is not null").withColumns({"calibration": calibration_warning(), "reason_level": reason_level()})
    warned = lambda *cs: sum((F.coalesce(c, F.lit(False)).cast("int") for c in cs), F.lit(0))
    n = F.length("match_reason")
    rows = rows.withColumns({"reason_warnings": warned(n == 0, (n > 0) & (n < 10), n > 200, F.col("reason_level") == "low_quality"), "oem_warnings": warned(F.col("match_reason").contains("OEM") & (F.col("match_result") == "NO"))})
    score = 0.3 + 0.3 * F.when(F.col("calibration") == "low", 0.8).otherwise(1.0) + 0.25 * F.greatest(F.lit(0.0), 1 - 0.2 * F.col("reason_warnings")) + 0.15 * F.greatest(F.lit(0.0), 1 - 0.3 * F.col("oem_warnings"))
    return rows.withColumn("score", F.round(score, 6))


@register("validate_results", _RESULTS + " SELECT row_number, part_number, skp_part_number, calibration, reason_level, reason_warnings, oem_warnings, score FROM q")
def validate_results(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select("row_number", "part_number", "skp_part_number", "calibration", "reason_level", "reason_warnings", "oem_warnings", "score")


@register("validation_rates", _RESULTS + " SELECT sheet_name, count(*) AS n, round(count_if(calibration = 'outside')::DOUBLE / greatest(1, count(*)), 6) AS error_rate, round(count_if(calibration = 'low' OR reason_warnings + oem_warnings > 0)::DOUBLE / greatest(1, count(*)), 6) AS warning_rate, CASE WHEN count_if(calibration = 'outside')::DOUBLE / greatest(1, count(*)) > 0.1 THEN 'Review the confidence ranges' ELSE 'Results are within range' END AS recommendation FROM q GROUP BY 1")
def validation_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Error and warning rates by sheet, and what follows."""
    outside = F.count_if(F.col("calibration") == "outside") / F.greatest(F.lit(1), F.count("*"))
    warned = F.count_if((F.col("calibration") == "low") | (F.col("reason_warnings") + F.col("oem_warnings") > 0)) / F.greatest(F.lit(1), F.count("*"))
    return results(spark, sf).groupBy("sheet_name").agg(F.count("*").alias("n"), F.round(outside, 6).alias("error_rate"), F.round(warned, 6).alias("warning_rate"), F.when(outside > 0.1, "Review the confidence ranges").otherwise("Results are within range").alias("recommendation"))


@register("batch_consistency", _RESULTS + " SELECT match_result, count(*) AS n, round(avg(score), 6) AS mean_quality, min(score) AS least_quality, max(score) AS best_quality, round(stddev_pop(confidence), 6) AS deviation, stddev_pop(confidence) > 25 AS scattered, avg(length(match_reason)) < 20 AS terse, CAST(count_if(score >= 0.8) AS BIGINT) AS good, CAST(count_if(score >= 0.5 AND score < 0.8) AS BIGINT) AS fair, CAST(count_if(score < 0.5) AS BIGINT) AS poor FROM q GROUP BY 1")
def batch_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Quality bands, population deviation and reason length by verdict."""
    s, sd = F.col("score"), F.stddev_pop("confidence")
    return results(spark, sf).groupBy("match_result").agg(
        F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean_quality"), F.min(s).alias("least_quality"), F.max(s).alias("best_quality"), F.round(sd, 6).alias("deviation"), (sd > 25).alias("scattered"), (F.avg(F.length("match_reason")) < 20).alias("terse"),
        F.count_if(s >= 0.8).alias("good"), F.count_if((s >= 0.5) & (s < 0.8)).alias("fair"), F.count_if(s < 0.5).alias("poor"),
    )


@register("batch_profile", WITH + "SELECT sheet_name, count(DISTINCT supplier) AS brands, count(DISTINCT part_type) AS part_types, CAST(count_if(confidence IS NULL) AS BIGINT) AS missing, round(greatest(0, 1 - count_if(confidence IS NULL)::DOUBLE / count(*)), 6) AS consistency FROM m GROUP BY 1")
def batch_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Variety and gaps of each batch of rows."""
    missing = F.count_if(F.col("confidence").isNull())
    return match_rows(spark, sf).groupBy("sheet_name").agg(F.count_distinct("supplier").alias("brands"), F.count_distinct("part_type").alias("part_types"), missing.alias("missing"), F.round(F.greatest(F.lit(0.0), 1 - missing / F.count("*")), 6).alias("consistency"))
