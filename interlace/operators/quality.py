"""Data-quality scores over match results: completeness, consistency, accuracy, reliability, anomalies, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from interlace.functions.text import grade
from interlace.plans.model import AS_OF, VERDICTS, WITH, chain, flagged
from interlace.plans.registry import register

# Confidence range that fits each verdict, and words that speak for and against a match.
RANGES = {"YES": (80, 100), "LIKELY": (60, 90), "UNCERTAIN": (30, 70), "NO": (0, 50)}
POSITIVE, NEGATIVE = ("match", "same", "oem", "identical", "equivalent"), ("no match", "different", "incompatible", "mismatch")

ESSENTIAL = ("part_type", "supplier", "part_number", "skp_part_number", "match_reason")


def share(condition: str, among: str = "true", default: float = 0.0):
    """Per cent of the rows `among` that hold, or the default without such rows."""
    return F.coalesce(F.try_divide(F.count_if(F.expr(f"({condition}) and ({among})")) * F.lit(100.0), F.count_if(F.expr(among))), F.lit(default))


_SHARE = lambda condition, among="true", default=0: f"coalesce(100.0::DOUBLE * count_if(({condition}) AND ({among})) / nullif(count_if({among}), 0), {default})"
_IN_RANGE = "CASE match_result " + " ".join(f"WHEN '{v}' THEN confidence BETWEEN {a} AND {b}" for v, (a, b) in RANGES.items()) + " END"
_ANY = lambda words: "(" + " OR ".join(f"contains(lower(match_reason), '{w}')" for w in words) + ")"
_REASON = f"CASE WHEN match_result IN ('YES', 'LIKELY') THEN {_ANY(POSITIVE)} AND NOT {_ANY(NEGATIVE)} WHEN match_result = 'NO' THEN {_ANY(NEGATIVE)} AND NOT {_ANY(POSITIVE)} ELSE match_result = 'UNCERTAIN' END"
_SCORED = "processed AND confidence IS NOT NULL"
_REASONED = "match_reason <> '' AND processed"
_FORMAT = {"spark": "part_number rlike '^[A-Z0-9.-]+$'", "duck": "regexp_matches(part_number, '^[A-Z0-9.-]+$')"}
_NEW = f"last_checked >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"
_NEW_SPARK = f"last_checked >= timestamp_ntz'{AS_OF}' - interval 30 days"


def completeness_score():
    return sum((share(f"{c} <> ''", "processed") for c in ESSENTIAL), F.lit(0.0)) / len(ESSENTIAL)


def consistency_score():
    return (share(_IN_RANGE, _SCORED) + share(_FORMAT["spark"], "part_number <> ''") + share(_REASON, _REASONED)) / 3


_COMPLETE = "(" + " + ".join(_SHARE(f"{c} <> ''", "processed") for c in ESSENTIAL) + f") / {len(ESSENTIAL)}"
_HIGH = lambda s: s("confirmed", f"{_SCORED} AND confidence >= 80", 80)
_OEM = lambda s: s("confirmed", "processed AND contains(lower(match_reason), 'oem')", 70)


@register("completeness", WITH + " UNION ALL ".join(f"SELECT '{c}' AS field, round({_SHARE(f'{c} IS NOT NULL AND CAST({c} AS VARCHAR) <> chr(0)' if c in ('confidence', 'last_checked') else f'length({c}) > 0', 'processed')}, 6) AS filled, {_SHARE(f'{c} IS NOT NULL' if c in ('confidence', 'last_checked') else f'length({c}) > 0', 'processed')} < 80 AS gap FROM f" for c in ("part_type", "supplier", "part_number", "match_reason", "confidence", "last_checked")))
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Q02: how full each field is over processed rows, in one pass; below 80 per cent is a gap."""
    fields = ("part_type", "supplier", "part_number", "match_reason", "confidence", "last_checked")
    one = flagged(spark, sf).agg(*[F.round(share(f"{c} is not null and cast({c} as string) <> ''", "processed"), 6).alias(c) for c in fields])
    return one.unpivot([], list(fields), "field", "filled").withColumn("gap", F.col("filled") < 80)


@register("consistency", WITH + f"SELECT sheet_name, round({_SHARE(_IN_RANGE, _SCORED)}, 6) AS confidence_fits, round({_SHARE(_FORMAT['duck'], 'length(part_number) > 0')}, 6) AS format_fits, round({_SHARE(_REASON, _REASONED)}, 6) AS reason_fits FROM f GROUP BY 1")
def consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Q03: shares of rows whose confidence, part number and reason fit the verdict."""
    return flagged(spark, sf).groupBy("sheet_name").agg(F.round(share(_IN_RANGE, _SCORED), 6).alias("confidence_fits"), F.round(share(_FORMAT["spark"], "part_number <> ''"), 6).alias("format_fits"), F.round(share(_REASON, _REASONED), 6).alias("reason_fits"))


def type_rates(rows: DataFrame) -> DataFrame:
    """Success rate of part types with five processed rows or more."""
    return rows.filter("processed and part_type <> ''").groupBy("part_type").agg(F.count("*").alias("n"), (F.count_if("confirmed") / F.count("*")).alias("rate")).filter("n >= 5")


_TYPES = "t AS (SELECT part_type, count(*) AS n, count_if(confirmed)::DOUBLE / count(*) AS rate FROM f WHERE processed AND part_type <> '' GROUP BY 1 HAVING count(*) >= 5), tt AS (SELECT coalesce(avg(CASE WHEN rate >= 0.7 OR rate <= 0.3 THEN 90.0::DOUBLE ELSE 60.0::DOUBLE END), 70) AS types FROM t)"


@register("accuracy", WITH + f", {_TYPES} SELECT round({_HIGH(_SHARE)}, 6) AS high_confidence, round({_OEM(_SHARE)}, 6) AS with_reference, round(max(types), 6) AS part_types FROM f CROSS JOIN tt")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Q04: how often high confidence and reference matches are confirmed, and how decided part types are."""
    rows = flagged(spark, sf)
    types = type_rates(rows).agg(F.coalesce(F.avg(F.when((F.col("rate") >= 0.7) | (F.col("rate") <= 0.3), 90.0).otherwise(60.0)), F.lit(70.0)).alias("part_types"))
    return rows.agg(F.round(_HIGH(share), 6).alias("high_confidence"), F.round(_OEM(share), 6).alias("with_reference")).crossJoin(types.select(F.round("part_types", 6).alias("part_types")))


_BAD = "match_reason = '' OR contains(lower(match_reason), 'error')"


def reliability_parts(rows: DataFrame) -> DataFrame:
    c = F.when(F.col("processed"), F.col("confidence"))
    mean, sd = F.avg(c), F.stddev_samp(c)
    band = F.when((mean >= 60) & (sd <= 25), 90.0).when((mean >= 40) & (sd <= 35), 70.0).otherwise(50.0)
    return rows.agg(F.round(band, 6).alias("spread"), F.round(share(_NEW_SPARK, "processed and last_checked is not null"), 6).alias("fresh"), F.round(100 - share(_BAD, "processed"), 6).alias("without_error"))


_RELIABLE = f"CASE WHEN avg(confidence) FILTER (WHERE processed) >= 60 AND stddev_samp(confidence) FILTER (WHERE processed) <= 25 THEN 90.0::DOUBLE WHEN avg(confidence) FILTER (WHERE processed) >= 40 AND stddev_samp(confidence) FILTER (WHERE processed) <= 35 THEN 70.0::DOUBLE ELSE 50.0::DOUBLE END AS spread, round({_SHARE(_NEW, 'processed AND last_checked IS NOT NULL')}, 6) AS fresh, round(100 - {_SHARE(_BAD, 'processed')}, 6) AS without_error"


@register("reliability", WITH + f"SELECT {_RELIABLE} FROM f")
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Q05: spread of confidence in bands, share of fresh rows, share of rows without error marks."""
    return reliability_parts(flagged(spark, sf))


@register("quality_overall", WITH + f", {_TYPES}, a AS (SELECT {_COMPLETE} AS completeness, ({_SHARE(_IN_RANGE, _SCORED)} + {_SHARE(_FORMAT['duck'], 'length(part_number) > 0')} + {_SHARE(_REASON, _REASONED)}) / 3 AS consistency, ({_HIGH(_SHARE)} + {_OEM(_SHARE)} + (SELECT types FROM tt)) / 3 AS accuracy, {_RELIABLE} FROM f), b AS (SELECT *, (spread + fresh + without_error) / 3 AS reliability FROM a), s AS (SELECT round(completeness, 4) AS completeness, round(consistency, 4) AS consistency, round(accuracy, 4) AS accuracy, round(reliability, 4) AS reliability, round(0.3::DOUBLE * completeness + 0.2::DOUBLE * consistency + 0.3::DOUBLE * accuracy + 0.2::DOUBLE * reliability, 4) AS score FROM b) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s")
def quality_overall(spark: SparkSession, sf: str) -> DataFrame:
    """Q01, Q16: the four scores, their weighted sum and its grade."""
    rows = flagged(spark, sf)
    first = rows.agg(completeness_score().alias("completeness"), consistency_score().alias("consistency"), _HIGH(share).alias("high"), _OEM(share).alias("oem"))
    types = type_rates(rows).agg(F.coalesce(F.avg(F.when((F.col("rate") >= 0.7) | (F.col("rate") <= 0.3), 90.0).otherwise(60.0)), F.lit(70.0)).alias("types"))
    one = first.crossJoin(types).crossJoin(reliability_parts(rows))
    accuracy_, reliability_ = (F.col("high") + F.col("oem") + F.col("types")) / 3, (F.col("spread") + F.col("fresh") + F.col("without_error")) / 3
    score = F.round(F.col("completeness") * 0.3 + F.col("consistency") * 0.2 + accuracy_ * 0.3 + reliability_ * 0.2, 4)
    return one.select(F.round("completeness", 4).alias("completeness"), F.round("consistency", 4).alias("consistency"), F.round(accuracy_, 4).alias("accuracy"), F.round(reliability_, 4).alias("reliability"), score.alias("score"), grade(score).alias("grade"))


@register("confidence_reliability", WITH + ", s AS (SELECT avg(confidence) AS mean, median(confidence) AS med FROM f WHERE processed AND confidence IS NOT NULL), b AS (SELECT 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM f WHERE processed AND confidence IS NOT NULL GROUP BY CASE WHEN confidence <= 20 THEN 1 WHEN confidence <= 40 THEN 2 WHEN confidence <= 60 THEN 3 WHEN confidence <= 80 THEN 4 ELSE 5 END), d AS (SELECT greatest(0, 100 - 2 * (sum(abs(pct - 20)) + 20 * (5 - count(*))) / 5) AS balance FROM b) SELECT round(mean, 6) AS mean, med AS median, CASE WHEN mean > med + 5 THEN 'right_skewed' WHEN mean < med - 5 THEN 'left_skewed' ELSE 'normal' END AS skewness, round(balance, 6) AS balance FROM s CROSS JOIN d")
def confidence_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Mean against median, and how evenly the five buckets are filled."""
    c = F.col("confidence")
    rows = flagged(spark, sf).filter("processed and confidence is not null")
    buckets = [F.count_if(x) for x in (c <= 20, (c > 20) & (c <= 40), (c > 40) & (c <= 60), (c > 60) & (c <= 80), c > 80)]
    off = sum((F.abs(F.try_divide(b * 100.0, F.count("*")) - 20) for b in buckets), F.lit(0.0)) / 5
    one = rows.agg(F.avg(c).alias("mean"), F.median(c).alias("median"), F.round(F.greatest(F.lit(0.0), 100 - 2 * off), 6).alias("balance"))
    label = chain([(F.col("mean") > F.col("median") + 5, "right_skewed"), (F.col("mean") < F.col("median") - 5, "left_skewed")], "normal")
    return one.select(F.round("mean", 6).alias("mean"), "median", label.alias("skewness"), "balance")


@register("verdict_order", WITH + ", g AS (SELECT match_result, avg(confidence) AS mean, CASE match_result WHEN 'NO' THEN 0 WHEN 'UNCERTAIN' THEN 1 WHEN 'LIKELY' THEN 2 ELSE 3 END AS place FROM f WHERE processed AND confidence IS NOT NULL GROUP BY 1 HAVING count(*) >= 5), l AS (SELECT *, lag(mean) OVER (ORDER BY place) AS before FROM g) SELECT count(*) AS verdicts, CAST(count_if(before >= mean) AS BIGINT) AS breaks, CASE WHEN count(*) >= 3 AND count_if(before >= mean) = 0 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS score FROM l")
def verdict_order(spark: SparkSession, sf: str) -> DataFrame:
    """Q07: whether mean confidence rises from NO to YES; the window runs over the four verdicts."""
    places = F.array_position(F.array(*map(F.lit, reversed(VERDICTS))), F.col("match_result"))
    g = flagged(spark, sf).filter("processed and confidence is not null").groupBy("match_result").agg(F.avg("confidence").alias("mean"), F.count("*").alias("n")).filter("n >= 5")
    g = g.withColumn("before", F.lag("mean").over(Window.orderBy(places)))
    breaks = F.count_if(F.col("before") >= F.col("mean"))
    return g.agg(F.count("*").alias("verdicts"), breaks.alias("breaks"), F.when((F.count("*") >= 3) & (breaks == 0), 0.9).otherwise(0.7).alias("score"))


@register("format_patterns", WITH + ", p AS (SELECT CASE WHEN regexp_matches(skp_part_number, '^[A-Z]+[0-9]+$') THEN 'letters_then_numbers' WHEN regexp_matches(skp_part_number, '^[0-9]+[A-Z]*$') THEN 'numbers_then_letters' WHEN regexp_matches(skp_part_number, '^[A-Z0-9.-]+$') THEN 'alphanumeric_with_separators' ELSE 'other' END AS pattern FROM f WHERE skp_part_number <> '') SELECT pattern, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM p GROUP BY 1")
def format_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Q08: part numbers by the first of four patterns; the largest share is the standardisation score."""
    n = F.col("skp_part_number")
    pattern = chain([(n.rlike("^[A-Z]+[0-9]+$"), "letters_then_numbers"), (n.rlike("^[0-9]+[A-Z]*$"), "numbers_then_letters"), (n.rlike("^[A-Z0-9.-]+$"), "alphanumeric_with_separators")], "other")
    rows = flagged(spark, sf).filter("skp_part_number <> ''").groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@register("cross_sheet", WITH + ", r AS (SELECT count_if(confirmed)::DOUBLE / count_if(processed) AS rate FROM f WHERE processed GROUP BY sheet_name) SELECT count(*) AS sheets, round(stddev_samp(rate), 6) AS deviation, CASE WHEN count(*) < 2 THEN 0.8::DOUBLE WHEN stddev_samp(rate) < 0.2 THEN 0.9::DOUBLE WHEN stddev_samp(rate) < 0.3 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS score FROM r")
def cross_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Q09: spread of the sheets' success rates."""
    r = flagged(spark, sf).filter("processed").groupBy("sheet_name").agg((F.count_if("confirmed") / F.count("*")).alias("rate"))
    sd = F.stddev_samp("rate")
    return r.agg(F.count("*").alias("sheets"), F.round(sd, 6).alias("deviation"), F.when(F.count("*") < 2, 0.8).when(sd < 0.2, 0.9).when(sd < 0.3, 0.7).otherwise(0.5).alias("score"))


@register("reasoning", WITH + f", g AS (SELECT CASE WHEN {_ANY(POSITIVE)} THEN 'positive' WHEN {_ANY(NEGATIVE)} THEN 'negative' ELSE 'neutral' END AS tone, confirmed FROM f WHERE {_REASONED}) SELECT tone, count(*) AS n, round(count_if(confirmed)::DOUBLE / count(*), 6) AS confirmed_rate, CASE WHEN count(*) >= 5 AND count_if(confirmed)::DOUBLE / count(*) > 0.7 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS score FROM g GROUP BY 1")
def reasoning(spark: SparkSession, sf: str) -> DataFrame:
    """Q10: how often reasons of each tone go with a confirmed verdict; positive words are looked for first."""
    tone = F.expr(f"case when {_ANY(POSITIVE)} then 'positive' when {_ANY(NEGATIVE)} then 'negative' else 'neutral' end")
    rate = F.count_if("confirmed") / F.count("*")
    return flagged(spark, sf).filter(_REASONED).groupBy(tone.alias("tone")).agg(F.count("*").alias("n"), F.round(rate, 6).alias("confirmed_rate"), F.when((F.count("*") >= 5) & (rate > 0.7), 0.9).otherwise(0.7).alias("score"))


@register("anomalies", WITH + f", s AS (SELECT avg(confidence) AS mean, stddev_samp(confidence) AS sd, count(confidence) AS n FROM f WHERE {_SCORED}), k AS (SELECT sheet_name, row_number, part_number, skp_part_number, unnest(list_filter([CASE WHEN {_SCORED} AND n > 10 AND abs((confidence - mean) / nullif(sd, 0)) > 1.7 THEN 'confidence_outlier' END, CASE WHEN length(part_number) > 20 THEN 'long_part_number' END, CASE WHEN processed AND last_checked < TIMESTAMP '{AS_OF}' - INTERVAL 1500 DAY THEN 'stale' END, CASE WHEN processed AND length(part_number) = 0 THEN 'without_number' END, CASE WHEN confidence > 90 AND match_result = 'NO' THEN 'confident_no' END], lambda x: x IS NOT NULL)) AS anomaly FROM f CROSS JOIN s) SELECT * FROM k")
def anomalies(spark: SparkSession, sf: str, z: float = 1.7, days: int = 1500) -> DataFrame:
    """Q12: outlying confidence, odd part numbers, stale rows, processed rows without a number, confident refusals."""
    rows = flagged(spark, sf)
    stats = rows.filter(_SCORED).agg(F.avg("confidence").alias("mean"), F.stddev_samp("confidence").alias("sd"), F.count("confidence").alias("cn"))
    out = F.abs((F.col("confidence") - F.col("mean")) / F.nullif("sd", F.lit(0.0))) > z
    found = F.array_compact(
        F.array(
            F.when(F.expr(_SCORED) & (F.col("cn") > 10) & out, "confidence_outlier"),
            F.when(F.length("part_number") > 20, "long_part_number"),
            F.when(F.expr(f"processed and last_checked < timestamp_ntz'{AS_OF}' - interval {days} days"), "stale"),
            F.when(F.expr("processed and part_number = ''"), "without_number"),
            F.when(F.expr("confidence > 90 and match_result = 'NO'"), "confident_no"),
        )
    )
    return rows.crossJoin(F.broadcast(stats)).select("sheet_name", "row_number", "part_number", "skp_part_number", F.explode(found).alias("anomaly"))


@register("format_validation", WITH + "SELECT round(100.0::DOUBLE * count_if(regexp_matches(part_number, '^[A-Z0-9.-]+$')) / nullif(count_if(length(part_number) > 0), 0), 6) AS part_numbers, round(100.0::DOUBLE * count_if(confidence BETWEEN 0 AND 100) / nullif(count(confidence), 0), 6) AS confidences, round(100.0::DOUBLE * count_if(processed) / nullif(count_if(length(match_result) > 0), 0), 6) AS verdicts, round(100.0::DOUBLE * count_if(regexp_matches(skp_part_number, '^SK[0-9]+-[0-9]$')) / nullif(count_if(length(skp_part_number) > 0), 0), 6) AS short_numbers FROM f")
def format_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Q13: pass rates of formats over the values that are there."""
    rate = lambda ok, there: F.round(F.try_divide(F.count_if(F.expr(ok)) * 100.0, F.count_if(F.expr(there))), 6)
    return flagged(spark, sf).agg(rate(_FORMAT["spark"], "part_number <> ''").alias("part_numbers"), rate("confidence between 0 and 100", "confidence is not null").alias("confidences"), rate("processed", "match_result <> ''").alias("verdicts"), rate("skp_part_number rlike '^SK[0-9]+-[0-9]$'", "skp_part_number <> ''").alias("short_numbers"))


@register("sheet_comparison", WITH + f"SELECT sheet_name, count(*) AS total, CAST(count_if(processed) AS BIGINT) AS processed, round({_SHARE('confirmed', 'processed')}, 6) AS success, round(avg(confidence) FILTER (WHERE processed), 6) AS mean_confidence, round({_SHARE('length(match_reason) > 0', 'processed')}, 6) AS with_reason, round({_SHARE(_NEW, 'processed')}, 6) AS fresh, round({_SHARE('has_both')}, 6) AS with_both FROM f GROUP BY 1 HAVING count_if(processed) > 0")
def sheet_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Q14: eight metrics of each sheet that has processed rows."""
    out = flagged(spark, sf).groupBy("sheet_name").agg(
        F.count("*").alias("total"), F.count_if("processed").alias("processed"), F.round(share("confirmed", "processed"), 6).alias("success"), F.round(F.avg(F.when(F.col("processed"), F.col("confidence"))), 6).alias("mean_confidence"),
        F.round(share("match_reason <> ''", "processed"), 6).alias("with_reason"), F.round(share(_NEW_SPARK, "processed"), 6).alias("fresh"), F.round(share("has_both"), 6).alias("with_both"),
    )
    return out.filter("processed > 0")


@register("recommendations", WITH + f", a AS (SELECT sheet_name, {_SHARE('confirmed', 'processed')} AS success, {_SHARE('processed')} AS done, {_SHARE('length(match_reason) > 0', 'processed')} AS reasons FROM f GROUP BY 1), r AS (SELECT sheet_name, list_filter([CASE WHEN success < 50 THEN 'Review the matching rules: few rows are confirmed' END, CASE WHEN done < 95 THEN 'Process the remaining rows' END, CASE WHEN reasons < 90 THEN 'Record a reason for each verdict' END], lambda x: x IS NOT NULL) AS r FROM a) SELECT sheet_name, unnest(CASE WHEN len(r) = 0 THEN ['Nothing to improve'] ELSE r END) AS recommendation FROM r")
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that follow from thresholds, one line each, and a default line."""
    a = flagged(spark, sf).groupBy("sheet_name").agg(share("confirmed", "processed").alias("success"), share("processed").alias("done"), share("match_reason <> ''", "processed").alias("reasons"))
    lines = F.array_compact(F.array(F.when(F.col("success") < 50, "Review the matching rules: few rows are confirmed"), F.when(F.col("done") < 95, "Process the remaining rows"), F.when(F.col("reasons") < 90, "Record a reason for each verdict")))
    return a.select("sheet_name", F.explode(F.when(F.size(lines) == 0, F.array(F.lit("Nothing to improve"))).otherwise(lines)).alias("recommendation"))


@register("oem_tokens", WITH + ", t AS (SELECT unnest(regexp_extract_all(match_reason, '[A-Z0-9]{6,}')) AS token FROM f WHERE processed) SELECT token, count(*) AS n FROM t GROUP BY 1")
def oem_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """References quoted in reasons, by frequency."""
    tokens = F.regexp_extract_all("match_reason", F.lit("[A-Z0-9]{6,}"), F.lit(0))
    return flagged(spark, sf).filter("processed").select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


