"""Statistics over match results: counts, rates, histograms, calibration, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.plans.model import VERDICTS, WITH, chain, flagged, percent
from interlace.plans.registry import register


def n_if(condition: str, name: str) -> F.Column:
    return F.count_if(F.expr(condition)).alias(name)


def rates(df: DataFrame) -> DataFrame:
    """Adds success_rate, review_rate and completion_rate to counts total, processed, confirmed, uncertain."""
    c = F.col
    return df.withColumns({"success_rate": percent(c("confirmed"), c("processed")), "review_rate": percent(c("uncertain"), c("processed")), "completion_rate": percent(c("processed"), c("total"))})


COUNTS = lambda: [F.count("*").alias("total"), n_if("processed", "processed"), n_if("confirmed", "confirmed"), n_if("match_result = 'UNCERTAIN'", "uncertain")]
_COUNTS = "count(*) AS total, CAST(count_if(processed) AS BIGINT) AS processed, CAST(count_if(confirmed) AS BIGINT) AS confirmed, CAST(count_if(match_result = 'UNCERTAIN') AS BIGINT) AS uncertain"
_PCT = "round(coalesce(100.0::DOUBLE * {} / nullif({}, 0), 0), 6)".format
_RATES = f"{_PCT('confirmed', 'processed')} AS success_rate, {_PCT('uncertain', 'processed')} AS review_rate, {_PCT('processed', 'total')} AS completion_rate"


@register("verdict_rollup", WITH + f"SELECT coalesce(sheet_name, 'ALL') AS sheet_name, count(*) AS total, {', '.join(f'''CAST(count_if(match_result = '{v}') AS BIGINT) AS n_{v.lower()}''' for v in VERDICTS)}, CAST(count_if(match_result = '') AS BIGINT) AS n_blank, CAST(count_if(processed) AS BIGINT) AS processed FROM f GROUP BY ROLLUP (sheet_name)")
def verdict_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict counts by sheet with a grand total."""
    rows = flagged(spark, sf).rollup("sheet_name").agg(F.count("*").alias("total"), *[n_if(f"match_result = '{v}'", f"n_{v.lower()}") for v in VERDICTS], n_if("match_result = ''", "n_blank"), n_if("processed", "processed"))
    return rows.withColumn("sheet_name", F.coalesce("sheet_name", F.lit("ALL")))


@register("verdict_cube", WITH + "SELECT coalesce(sheet_name, 'ALL') AS sheet_name, coalesce(category, 'ALL') AS category, count(*) AS total, CAST(count_if(confirmed) AS BIGINT) AS confirmed FROM f GROUP BY CUBE (sheet_name, category)")
def verdict_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over all combinations of sheet and category."""
    rows = flagged(spark, sf).cube("sheet_name", "category").agg(F.count("*").alias("total"), n_if("confirmed", "confirmed"))
    return rows.withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ("sheet_name", "category")})


@register("overview", WITH + f", a AS (SELECT {_COUNTS}, count(DISTINCT sheet_name) AS total_sheets FROM f) SELECT *, {_RATES} FROM a")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and rates over all sheets."""
    return rates(flagged(spark, sf).agg(*COUNTS(), F.count_distinct("sheet_name").alias("total_sheets")))


@register("by_sheet", WITH + f", a AS (SELECT sheet_name, {_COUNTS}, round(avg(confidence) FILTER (WHERE processed), 6) AS avg_confidence, count(DISTINCT part_type) AS part_types, count(DISTINCT supplier) AS suppliers, max(last_checked) FILTER (WHERE processed) AS last_processed FROM f GROUP BY sheet_name) SELECT *, {_RATES} FROM a")
def by_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, rates, mean confidence, variety and the last check of each sheet."""
    rows = flagged(spark, sf).groupBy("sheet_name").agg(
        *COUNTS(),
        F.round(F.avg(F.when(F.col("processed"), F.col("confidence"))), 6).alias("avg_confidence"),
        F.count_distinct("part_type").alias("part_types"),
        F.count_distinct("supplier").alias("suppliers"),
        F.max(F.when(F.col("processed"), F.col("last_checked"))).alias("last_processed"),
    )
    return rates(rows)


@register("by_category", WITH + f", a AS (SELECT category, {_COUNTS}, count(DISTINCT sheet_name) AS sheets, round(avg(confidence) FILTER (WHERE processed), 6) AS avg_confidence FROM f WHERE part_type <> '' GROUP BY category) SELECT *, {_RATES} FROM a")
def by_category(spark: SparkSession, sf: str) -> DataFrame:
    """The same by part category, with the mean confidence computed."""
    rows = flagged(spark, sf).filter("part_type <> ''").groupBy("category").agg(*COUNTS(), F.count_distinct("sheet_name").alias("sheets"), F.round(F.avg(F.when(F.col("processed"), F.col("confidence"))), 6).alias("avg_confidence"))
    return rates(rows)


_SUMMARY = "count(confidence) AS n, round(avg(confidence), 6) AS mean, min(confidence) AS lowest, max(confidence) AS highest"
SUMMARY = lambda: [F.count("confidence").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest")]


@register("confidence_summary", WITH + f"SELECT {_SUMMARY}, median(confidence) AS median, round(stddev_samp(confidence), 6) AS deviation FROM f WHERE processed AND confidence IS NOT NULL")
def confidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Number, mean, range, median and sample deviation of the confidences."""
    return flagged(spark, sf).filter("processed and confidence is not null").agg(*SUMMARY(), F.median("confidence").alias("median"), F.round(F.stddev_samp("confidence"), 6).alias("deviation"))


BUCKETS = ("0-20", "21-40", "41-60", "61-80", "81-100")


def bucket_of(confidence: F.Column) -> F.Column:
    return chain([(confidence <= 20 * (i + 1), b) for i, b in enumerate(BUCKETS[:4])], BUCKETS[4])


_BUCKET = "CASE WHEN confidence <= 20 THEN '0-20' WHEN confidence <= 40 THEN '21-40' WHEN confidence <= 60 THEN '41-60' WHEN confidence <= 80 THEN '61-80' ELSE '81-100' END"


@register("confidence_histogram", WITH + f", h AS (SELECT {_BUCKET} AS bucket, count(*) AS n FROM f WHERE processed AND confidence IS NOT NULL GROUP BY 1) SELECT b.bucket, coalesce(n, 0) AS n FROM (VALUES ('0-20'), ('21-40'), ('41-60'), ('61-80'), ('81-100')) b(bucket) LEFT JOIN h USING (bucket)")
def confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Five buckets, those without rows included."""
    found = flagged(spark, sf).filter("processed and confidence is not null").groupBy(bucket_of(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))
    spine = spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return spine.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@register("confidence_grouping_sets", WITH + f"SELECT coalesce(match_result, 'ALL') AS match_result, coalesce(sheet_name, 'ALL') AS sheet_name, {_SUMMARY} FROM f WHERE processed AND confidence IS NOT NULL GROUP BY GROUPING SETS ((match_result), (sheet_name), ())")
def confidence_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence summaries by verdict, by sheet and over all, in one pass."""
    rows = flagged(spark, sf).filter("processed and confidence is not null")
    rows = rows.groupingSets([["match_result"], ["sheet_name"], []], "match_result", "sheet_name").agg(*SUMMARY())
    return rows.withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ("match_result", "sheet_name")})


@register("calibration", WITH + f", b AS (SELECT confidence, confirmed, {_BUCKET} AS bucket FROM f WHERE processed AND confidence BETWEEN 0 AND 100), a AS (SELECT bucket, count(*) AS n, {_PCT('count_if(confirmed)', 'count(*)')} AS actual FROM b GROUP BY bucket) SELECT a.*, expected, round(abs(actual - expected), 6) AS gap FROM a JOIN (VALUES ('0-20', 10.0::DOUBLE), ('21-40', 30.5::DOUBLE), ('41-60', 50.5::DOUBLE), ('61-80', 70.5::DOUBLE), ('81-100', 90.5::DOUBLE)) e(bucket, expected) USING (bucket)")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Share of confirmed rows by confidence bucket against the bucket's middle; empty buckets are left out."""
    rows = flagged(spark, sf).filter("processed and confidence between 0 and 100").groupBy(bucket_of(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"), percent(F.count_if("confirmed"), F.count("*")).alias("actual"))
    rows = rows.withColumn("expected", chain([(F.col("bucket") == b, m) for b, m in zip(BUCKETS, (10.0, 30.5, 50.5, 70.5))], 90.5))
    return rows.withColumn("gap", F.round(F.abs(F.col("actual") - F.col("expected")), 6))


@register("processing_status", WITH + f", a AS (SELECT sheet_name, {_COUNTS} FROM f GROUP BY sheet_name), b AS (SELECT sheet_name, total - processed AS remaining, uncertain, {_PCT('processed', 'total')} AS completion_rate, total FROM a) SELECT sheet_name, remaining, uncertain, completion_rate, CASE WHEN uncertain > 100 THEN 'HIGH' WHEN uncertain > 10 THEN 'MEDIUM' ELSE 'LOW' END AS priority, completion_rate < 10 AND total > 100 AS bottleneck FROM b")
def processing_status(spark: SparkSession, sf: str) -> DataFrame:
    """What is left to do in each sheet, its priority, and whether it is a bottleneck."""
    rows = rates(flagged(spark, sf).groupBy("sheet_name").agg(*COUNTS()))
    priority = chain([(F.col("uncertain") > 100, "HIGH"), (F.col("uncertain") > 10, "MEDIUM")], "LOW")
    return rows.select("sheet_name", (F.col("total") - F.col("processed")).alias("remaining"), "uncertain", "completion_rate", priority.alias("priority"), ((F.col("completion_rate") < 10) & (F.col("total") > 100)).alias("bottleneck"))


@register("part_types", WITH + f", a AS (SELECT sheet_name, part_type, {_COUNTS} FROM f WHERE part_type <> '' GROUP BY ALL) SELECT *, {_RATES} FROM a")
def part_types(spark: SparkSession, sf: str) -> DataFrame:
    """A10: counts and rates of each part type in each sheet."""
    return rates(flagged(spark, sf).filter("part_type <> ''").groupBy("sheet_name", "part_type").agg(*COUNTS()))


@register("confidence_range", WITH + "SELECT sheet_name, match_result, count(*) AS n, round(avg(confidence), 6) AS average, max(confidence) - min(confidence) AS spread FROM f WHERE processed AND confidence IS NOT NULL GROUP BY ALL")
def confidence_range(spark: SparkSession, sf: str) -> DataFrame:
    """Number, mean and spread of confidence by verdict in each sheet."""
    return flagged(spark, sf).filter("processed and confidence is not null").groupBy("sheet_name", "match_result").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("average"), (F.max("confidence") - F.min("confidence")).alias("spread"))


@register("timeline", WITH + "SELECT sheet_name, min(last_checked) AS first_check, max(last_checked) AS last_check, CAST(date_diff('day', min(last_checked), max(last_checked)) AS INT) AS span_days, count(last_checked) AS n, count(DISTINCT CAST(last_checked AS DATE)) AS active_days FROM f WHERE processed GROUP BY sheet_name")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """First and last check, span and active days of each sheet."""
    return flagged(spark, sf).filter("processed").groupBy("sheet_name").agg(
        F.min("last_checked").alias("first_check"), F.max("last_checked").alias("last_check"), F.datediff(F.max("last_checked"), F.min("last_checked")).alias("span_days"),
        F.count("last_checked").alias("n"), F.count_distinct(F.to_date("last_checked")).alias("active_days"),
    )


@register("quality_indicators", WITH + f", a AS (SELECT sheet_name, {_PCT('count_if(length(part_type) > 0 AND length(supplier) > 0 AND has_both)', 'count(*)')} AS completeness, {_PCT('count_if(has_both)', 'count(*)')} AS part_quality, {_PCT('count_if(processed AND length(match_reason) > 0)', 'count_if(processed)')} AS reasons, {_PCT('count_if(processed AND confidence IS NOT NULL)', 'count_if(processed)')} AS confidences FROM f GROUP BY sheet_name) SELECT *, CAST(CAST(completeness < 90 AS INT) + CAST(part_quality < 80 AS INT) + CAST(reasons < 70 AS INT) + CAST(confidences < 70 AS INT) AS BIGINT) AS issues FROM a")
def quality_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Completeness over all rows, reasons and confidences over processed rows, and how many fall short."""
    every = F.count("*")
    rows = flagged(spark, sf).groupBy("sheet_name").agg(
        percent(F.count_if(F.expr("part_type <> '' and supplier <> '' and has_both")), every).alias("completeness"),
        percent(F.count_if("has_both"), every).alias("part_quality"),
        percent(F.count_if(F.expr("processed and match_reason <> ''")), F.count_if("processed")).alias("reasons"),
        percent(F.count_if(F.expr("processed and confidence is not null")), F.count_if("processed")).alias("confidences"),
    )
    limits = {"completeness": 90, "part_quality": 80, "reasons": 70, "confidences": 70}
    return rows.withColumn("issues", sum(((F.col(c) < n).cast("long") for c, n in limits.items()), F.lit(0).cast("long")))


@register("work_estimate", WITH + "SELECT sheet_name, CAST(count_if(match_result = 'UNCERTAIN') AS BIGINT) AS uncertain, round(count_if(match_result = 'UNCERTAIN') * 14.0::DOUBLE / 60, 6) AS minutes_before, round(count_if(match_result = 'UNCERTAIN') * 1.5::DOUBLE / 60, 6) AS minutes_after, CAST(floor(count_if(match_result = 'UNCERTAIN') * 0.67::DOUBLE) AS BIGINT) AS upgrades_before, CAST(floor(count_if(match_result = 'UNCERTAIN') * 0.74::DOUBLE) AS BIGINT) AS upgrades_after FROM f GROUP BY sheet_name")
def work_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Time and upgrades that the uncertain rows would take before and after the faster comparison."""
    rows = flagged(spark, sf).groupBy("sheet_name").agg(n_if("match_result = 'UNCERTAIN'", "uncertain"))
    n = F.col("uncertain")
    return rows.select("sheet_name", n, F.round(n * 14.0 / 60, 6).alias("minutes_before"), F.round(n * 1.5 / 60, 6).alias("minutes_after"), F.floor(n * 0.67).alias("upgrades_before"), F.floor(n * 0.74).alias("upgrades_after"))


@register("wave_progress", WITH + "SELECT sheet_name, CAST(count_if(match_result = 'LIKELY') AS BIGINT) AS likely, greatest(CAST(count_if(match_result = 'LIKELY') AS BIGINT) - 100, 0) AS progress, CASE WHEN count_if(match_result = 'LIKELY') - 100 >= 175 THEN 'COMPLETE' WHEN count_if(match_result = 'LIKELY') > 100 THEN 'IN PROGRESS' ELSE 'PENDING' END AS status, CAST(count_if(match_result = 'LIKELY') AS BIGINT) + 25 AS projected_likely, greatest(CAST(count_if(match_result = 'UNCERTAIN') AS BIGINT) - 25, 0) AS projected_uncertain FROM f GROUP BY sheet_name")
def wave_progress(spark: SparkSession, sf: str, baseline: int = 100, target: int = 175, wave: int = 25) -> DataFrame:
    """Progress of a wave of upgrades over a baseline, and what one more wave would make of it."""
    rows = flagged(spark, sf).groupBy("sheet_name").agg(n_if("match_result = 'LIKELY'", "likely"), n_if("match_result = 'UNCERTAIN'", "uncertain"))
    done, zero = F.col("likely") - baseline, F.lit(0).cast("long")
    status = chain([(done >= target, "COMPLETE"), (done > 0, "IN PROGRESS")], "PENDING")
    return rows.select("sheet_name", "likely", F.greatest(done, zero).alias("progress"), status.alias("status"), (F.col("likely") + wave).alias("projected_likely"), F.greatest(F.col("uncertain") - wave, zero).alias("projected_uncertain"))


@register("summary_report", WITH + f", a AS (SELECT {_COUNTS} FROM f), c AS (SELECT {_SUMMARY} FROM f WHERE processed AND confidence IS NOT NULL) SELECT total, processed, confirmed, uncertain, {_RATES}, n AS n_confidence, mean AS mean_confidence, lowest, highest FROM a CROSS JOIN c")
def summary_report(spark: SparkSession, sf: str) -> DataFrame:
    """The overview and the confidence summary of one pass as one row."""
    scored = F.when(F.col("processed"), F.col("confidence"))
    return rates(flagged(spark, sf).agg(*COUNTS(), F.count(scored).alias("n_confidence"), F.round(F.avg(scored), 6).alias("mean_confidence"), F.min(scored).alias("lowest"), F.max(scored).alias("highest")))


@register("eligible_rows", WITH + "SELECT sheet_name, row_number, part_number, skp_part_number FROM f WHERE upper(trim(supplier)) = 'BRAND13' AND has_both AND (match_result = '' OR match_result = 'UNCERTAIN') AND row_number BETWEEN 100 AND 50000")
def eligible_rows(spark: SparkSession, sf: str, supplier: str = "brand13 ") -> DataFrame:
    """Work-queue scan: one supplier, both numbers, no final verdict yet, a range of rows."""
    wanted = F.upper(F.trim("supplier")) == supplier.strip().upper()
    todo = F.col("match_result").isin("", "UNCERTAIN")
    return flagged(spark, sf).filter(wanted & F.col("has_both") & todo & F.col("row_number").between(100, 50000)).select("sheet_name", "row_number", "part_number", "skp_part_number")


@register("outcome_counts", WITH + f"SELECT sheet_name, CAST(count_if(confidence >= 65) AS BIGINT) AS upgrades, CAST(count_if(confidence < 65) AS BIGINT) AS kept, CAST(count_if(confidence IS NULL) AS BIGINT) AS without_score, {_PCT('count_if(confidence >= 65)', 'count(confidence)')} AS upgrade_rate FROM f WHERE match_result = 'UNCERTAIN' GROUP BY sheet_name")
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Upgrades among the uncertain rows, over those that have a score."""
    return flagged(spark, sf).filter("match_result = 'UNCERTAIN'").groupBy("sheet_name").agg(n_if("confidence >= 65", "upgrades"), n_if("confidence < 65", "kept"), n_if("confidence is null", "without_score"), percent(F.count_if(F.expr("confidence >= 65")), F.count("confidence")).alias("upgrade_rate"))


@register("verdict_pivot", WITH + "SELECT category, CAST(count_if(match_result = 'YES') AS BIGINT) AS yes, CAST(count_if(match_result = 'LIKELY') AS BIGINT) AS likely, CAST(count_if(match_result = 'UNCERTAIN') AS BIGINT) AS uncertain, CAST(count_if(match_result = 'NO') AS BIGINT) AS no FROM f GROUP BY category")
def verdict_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Chart data: verdict counts by category, verdicts as columns."""
    rows = flagged(spark, sf).groupBy("category").pivot("match_result", list(VERDICTS)).count()
    return rows.select("category", *[F.coalesce(v, F.lit(0).cast("long")).alias(v.lower()) for v in VERDICTS])
