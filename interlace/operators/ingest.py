"""Logs, model replies, listings, stock texts, prediction quality, batch sizing, and the catalogue of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.functions import text as X
from interlace.operators.relational import COMPLEXITY, DEFAULT_COMPLEXITY
from interlace.operators.scoring import observations, pairs
from interlace.plans.model import VERDICTS, WITH, chain, flagged
from interlace.plans.registry import read, register

# Phrases of descriptions and the categories they stand for, the most specific first.
PHRASES = (
    ("door lock actuator motor", "DOOR LOCK ACTUATOR MOTOR"), ("door lock motor", "DOOR LOCK ACTUATOR MOTOR"), ("actuator motor", "DOOR LOCK ACTUATOR MOTOR"),
    ("door lock actuator", "DOOR LOCK ACTUATOR"), ("lock actuator", "DOOR LOCK ACTUATOR"), ("door lock", "DOOR LOCK ACTUATOR"),
    ("engine cooling fan", "ENGINE COOLING FAN ASSEMBLY"), ("cooling fan assembly", "ENGINE COOLING FAN ASSEMBLY"), ("radiator fan", "ENGINE COOLING FAN ASSEMBLY"),
    ("cooling fan", "ENGINE COOLING FAN ASSEMBLY"), ("fan assembly", "ENGINE COOLING FAN ASSEMBLY"), ("engine mount", "ENGINE MOUNT"),
    ("motor mount", "ENGINE MOUNT"), ("transmission mount", "ENGINE MOUNT"), ("engine oil pan", "ENGINE OIL PAN"), ("oil pan", "ENGINE OIL PAN"),
    ("valve cover", "ENGINE VALVE COVER"), ("rocker cover", "ENGINE VALVE COVER"), ("water pump", "ENGINE WATER PUMP"), ("coolant pump", "ENGINE WATER PUMP"),
    ("hvac blower motor", "HVAC BLOWER MOTOR"), ("heater blower motor", "HVAC BLOWER MOTOR"), ("blower motor", "HVAC BLOWER MOTOR"),
    ("steering knuckle", "STEERING KNUCKLE"), ("window regulator", "WINDOW REGULATOR"), ("regulator", "WINDOW REGULATOR"),
)


def category_of_description(text: Column) -> Column:
    """The category of the first phrase in the text; null without one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return chain([(low.contains(k), v) for k, v in PHRASES], F.lit(None).cast("string"))


_PHRASE_OF = "list_value(" + ", ".join(f"'New {p} kit'" for p, _ in PHRASES) + ", 'Plain bolt')"


@register("first_category", f"SELECT p_partkey AS part, CASE {' '.join(f'''WHEN contains(lower(d), '{k}') THEN '{v}' ''' for k, v in PHRASES)} END AS category FROM (SELECT p_partkey, {_PHRASE_OF}[p_partkey % {len(PHRASES) + 1} + 1] AS d FROM part)")
def first_category(spark: SparkSession, sf: str) -> DataFrame:
    """K10, E05 over a description for each part."""
    texts = F.array(*[F.lit(f"New {p} kit") for p, _ in PHRASES], F.lit("Plain bolt"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), category_of_description(F.element_at(texts, (F.col("p_partkey") % (len(PHRASES) + 1) + 1).cast("int"))).alias("category"))


@register("log_progress", "WITH l AS (SELECT user_id, '[' || event_id % 495 || '/495] Processing row ' || event_id AS line, ts, event_id FROM events), s AS (SELECT user_id, count(*) AS lines, CAST(regexp_extract(arg_max(line, (ts, event_id)), '\\[([0-9]+)/495\\]', 1) AS INT) AS current FROM l GROUP BY 1) SELECT user_id, lines, current, round(current / 495.0::DOUBLE * 100, 4) AS percent, CAST(floor((495 - current) * 3.5::DOUBLE / 60) AS BIGINT) AS minutes_left FROM s")
def log_progress(spark: SparkSession, sf: str, total: int = 495) -> DataFrame:
    """The last progress mark of each log, and the time that the rest will take."""
    line = F.concat(F.lit("["), (F.col("event_id") % total).cast("string"), F.lit(f"/{total}] Processing row "), F.col("event_id").cast("string"))
    logs = read(spark, sf, "events").select("user_id", line.alias("line"), F.struct("ts", "event_id").alias("at"))
    last = F.regexp_extract(F.max_by("line", "at"), rf"\[(\d+)/{total}\]", 1).cast("int")
    out = logs.groupBy("user_id").agg(F.count("*").alias("lines"), last.alias("current"))
    return out.select("user_id", "lines", "current", F.round(F.col("current") / float(total) * 100, 4).alias("percent"), F.floor((total - F.col("current")) * 3.5 / 60).alias("minutes_left"))


def reply_fields(raw: Column) -> tuple[Column, Column]:
    """Verdict and confidence out of a model's reply: fences and chatter around the first object are left out, odd values mended."""
    body = F.regexp_extract(raw, r"(?s)(\{.*?\})", 1)
    verdict = F.upper(F.coalesce(F.get_json_object(body, "$.match_result"), F.lit("UNCERTAIN")))
    confidence = F.coalesce(F.get_json_object(body, "$.confidence").try_cast("int"), F.lit(0))
    return F.when(verdict.isin(*VERDICTS), verdict).otherwise("UNCERTAIN"), F.greatest(F.lit(0), F.least(F.lit(100), confidence))


@register("model_json", "SELECT p_partkey AS part, CASE WHEN p_size % 4 = 0 THEN 'YES' WHEN p_size % 4 = 1 THEN 'LIKELY' ELSE 'UNCERTAIN' END AS match_result, CASE WHEN p_size % 4 = 3 THEN 0 ELSE CAST(least(p_size * 3, 100) AS INT) END AS confidence FROM part")
def model_json(spark: SparkSession, sf: str) -> DataFrame:
    """C25 over a reply for each part."""
    s = F.col("p_size")
    word = chain([(s % 4 == 0, "yes"), (s % 4 == 1, "LIKELY"), (s % 4 == 2, "perhaps")], "")
    raw = F.when(s % 4 == 3, "I cannot say.").otherwise(F.concat(F.lit('```json\nSure: {"match_result": "'), word, F.lit('", "confidence": '), (s * 3).cast("string"), F.lit("}\n```")))
    verdict, confidence = reply_fields(raw)
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), verdict.alias("match_result"), confidence.alias("confidence"))


@register("listing_fields", "SELECT p_partkey AS part, 'REF' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS refs, '$' || CAST(10 + p_size AS VARCHAR) || '.50' AS price, p_size % 3 = 0 AS popular, p_size % 4 <> 0 AS in_stock, CASE WHEN p_size % 4 <> 0 THEN p_size END AS quantity FROM part")
def listing_fields(spark: SparkSession, sf: str) -> DataFrame:
    """References, price, popularity and stock out of the text of a listing.

    The block starts at brand and number and has 2,000 characters; references stand before the warranty.
    """
    k, s = F.col("p_partkey"), F.col("p_size")
    listing = F.concat(
        F.lit("Search results\nACME P"), k.cast("string"), F.lit(" Oil Pan REF"), F.lpad(k.cast("string"), 6, "0"), F.lit(" SEARCH SK123456 "), F.when(s % 3 == 0, "Popular choice ").otherwise(""),
        F.lit("$"), (10 + s).cast("string"), F.lit(".50 Warranty 24MONTHS "), F.when(s % 4 == 0, "Out of Stock").otherwise(F.concat(F.lit("("), s.cast("string"), F.lit(") In Stock"))),
    )
    rows = read(spark, sf, "part").select(k.alias("part"), listing.alias("text"))
    start = F.instr(F.upper("text"), "ACME P")
    rows = rows.withColumn("block", F.when(start > 0, F.substring("text", start, F.lit(2000))).otherwise(""))
    front = F.substring_index(F.upper(F.substring("block", 1, 500)), "WARRANTY", 1)
    tokens = F.regexp_extract_all(front, F.lit(r"\b([A-Z0-9]{6,})\b"), F.lit(1))
    skip = ("SEARCH", "RESULT", "ANCHOR", "DORMAN", "FILTER", "SORTBY", "VEHICLE", "CATALOG")
    own = F.concat(F.lit("P"), F.col("part").cast("string"))
    refs = F.slice(F.filter(tokens, lambda t: ~t.isin(*skip) & (t != own) & ~t.startswith("SK") & ~t.startswith("POPULAR") & ~t.startswith("CHOICE") & X.is_reference(t)), 1, 8)
    low = F.lower("block")
    return rows.select(
        "part", F.array_join(refs, ",").alias("refs"), F.concat(F.lit("$"), F.regexp_extract("block", r"\$(\d+\.\d{2})", 1)).alias("price"), low.contains("popular").alias("popular"),
        (low.contains("in stock") & ~low.contains("out of stock")).alias("in_stock"), F.nullif(F.regexp_extract("block", r"\((\d+)\)", 1), F.lit("")).cast("int").alias("quantity"),
    )


def field_share(*columns: tuple[Column, int]) -> Column:
    """Weight of the filled fields over the weight of all."""
    return sum((F.when(c, w).otherwise(0) for c, w in columns), F.lit(0)) / float(sum(w for _, w in columns))


@register("prediction_quality", "WITH o AS (SELECT p_partkey AS part, (6 + 1 + CASE WHEN p_partkey % 11 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 <> 0 THEN 1 ELSE 0 END) / 9.0::DOUBLE AS full FROM part), p AS (SELECT a.part AS a_part, b.part AS b_part, round((a.full + b.full) / 2, 6) AS completeness FROM o a JOIN o b ON b.part - a.part BETWEEN 1 AND 4) SELECT *, CASE WHEN (completeness + 0.8::DOUBLE) / 2 > 0.8 THEN 'HIGH' WHEN (completeness + 0.8::DOUBLE) / 2 > 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS quality FROM p")
def prediction_quality(spark: SparkSession, sf: str, reliability: float = 0.8) -> DataFrame:
    """How complete the data of both parts is, required fields counting twice, and what that says of a prediction."""
    def full(p: str) -> Column:
        c = lambda n: F.col(f"{p}_{n}")
        return field_share((c("category") != "", 2), (c("part").isNotNull(), 2), (c("description") != "", 2), (F.size(c("refs")) > 0, 1), (F.size(c("specs")) > 0, 1), (c("brand") != "", 1))

    out = pairs(spark, sf).select("a_part", "b_part", F.round((full("a") + full("b")) / 2, 6).alias("completeness"))
    overall = (F.col("completeness") + reliability) / 2
    return out.withColumn("quality", chain([(overall > 0.8, "HIGH"), (overall > 0.6, "MEDIUM")], "LOW"))


@register("learned_thresholds", WITH + ", r AS (SELECT part_type, count(*) AS n, count_if(confirmed)::DOUBLE / nullif(count_if(processed), 0) AS rate FROM f GROUP BY 1) SELECT part_type, round(rate, 6) AS rate, round(least(n / 100.0::DOUBLE, 1), 6) AS trust, CASE WHEN rate > 0.45 THEN 75 WHEN rate < 0.4 THEN 90 ELSE 80 END AS yes_from, CASE WHEN rate > 0.45 THEN 55 WHEN rate < 0.4 THEN 75 ELSE 60 END AS likely_from, CASE WHEN rate > 0.45 THEN 30 WHEN rate < 0.4 THEN 45 ELSE 35 END AS uncertain_from FROM r")
def learned_thresholds(spark: SparkSession, sf: str, high: float = 0.45, low: float = 0.4) -> DataFrame:
    """Thresholds of a part type from its history: lower where much is confirmed, higher where little is."""
    rows = flagged(spark, sf).groupBy("part_type").agg(F.count("*").alias("n"), F.try_divide(F.count_if("confirmed"), F.count_if("processed")).alias("rate"))
    r = F.col("rate")
    pick = lambda a, b, c: F.when(r > high, a).when(r < low, b).otherwise(c)
    return rows.select("part_type", F.round(r, 6).alias("rate"), F.round(F.least(F.col("n") / 100.0, F.lit(1.0)), 6).alias("trust"), pick(75, 90, 80).alias("yes_from"), pick(55, 75, 60).alias("likely_from"), pick(30, 45, 35).alias("uncertain_from"))


@register("batch_sizes", "SELECT event_id, greatest(10, CASE WHEN value / 2.5 > 80 OR CAST(json_extract_string(props, '$.k') AS DOUBLE) > 80 THEN 25 WHEN value / 2.5 > 60 OR CAST(json_extract_string(props, '$.k') AS DOUBLE) > 60 THEN 37 ELSE 50 END) AS batch_size FROM events")
def batch_sizes(spark: SparkSession, sf: str, base: int = 50) -> DataFrame:
    """Batch size under the load of a sample: all, three quarters or half of the base, ten at least."""
    cpu, memory = F.col("value") / 2.5, F.get_json_object("props", "$.k").cast("double")
    factor = F.when((cpu > 80) | (memory > 80), 0.5).when((cpu > 60) | (memory > 60), 0.75).otherwise(1.0)
    return read(spark, sf, "events").select("event_id", F.greatest(F.lit(10), F.floor(factor * base).cast("int")).alias("batch_size"))


_SEC = "CASE part_type " + " ".join(f"WHEN '{k}' THEN {v[1]}::DOUBLE" for k, v in COMPLEXITY.items()) + f" ELSE {DEFAULT_COMPLEXITY[1]}::DOUBLE END"


@register("time_estimate", WITH + f"SELECT part_type, count(*) AS n, round(sum({_SEC} * 1.25::DOUBLE) / 3600, 6) AS hours FROM f WHERE NOT processed OR match_result = 'UNCERTAIN' GROUP BY 1")
def time_estimate(spark: SparkSession, sf: str, cpu: float = 0.5) -> DataFrame:
    """Time that the open rows of each part type take at a CPU load."""
    seconds = chain([(F.col("part_type") == k, v[1]) for k, v in COMPLEXITY.items()], DEFAULT_COMPLEXITY[1])
    return flagged(spark, sf).filter("not processed or match_result = 'UNCERTAIN'").groupBy("part_type").agg(F.count("*").alias("n"), F.round(F.sum(seconds * (1 + 0.5 * cpu)) / 3600, 6).alias("hours"))


def escalate(rows: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Only UNCERTAIN rows go to `judge`, which adds second_result and second_confidence; it wins where its confidence is over zero."""
    keep = rows.filter("match_result <> 'UNCERTAIN'")
    second = judge(rows.filter("match_result = 'UNCERTAIN'"))
    sure = F.coalesce(F.col("second_confidence") > 0, F.lit(False))
    mended = second.withColumns({"match_result": F.when(sure, F.col("second_result")).otherwise(F.col("match_result")), "confidence": F.when(sure, F.col("second_confidence")).otherwise(F.col("confidence"))})
    return keep.unionByName(mended.select(*rows.columns))


@register("escalation", WITH + "SELECT row_number, part_number, skp_part_number, CASE WHEN match_result = 'UNCERTAIN' AND row_number % 3 > 0 THEN CASE WHEN row_number % 3 = 1 THEN 'LIKELY' ELSE 'NO' END ELSE match_result END AS match_result, CASE WHEN match_result = 'UNCERTAIN' AND row_number % 3 > 0 THEN CAST(50 + row_number % 3 AS INT) ELSE confidence END AS confidence FROM f WHERE processed")
def escalation(spark: SparkSession, sf: str) -> DataFrame:
    """P08 with a rule in place of a language model."""
    third = F.col("row_number") % 3
    judge = lambda d: d.withColumns({"second_result": F.when(third == 1, "LIKELY").otherwise("NO"), "second_confidence": F.when(third > 0, 50 + third).otherwise(0).cast("int")})
    return escalate(flagged(spark, sf).filter("processed").select("row_number", "part_number", "skp_part_number", "match_result", "confidence"), judge)


@register("child_rows", "SELECT p_partkey AS part, 'ref' AS kind, CASE WHEN p_partkey % 3 = 1 THEN '-B' WHEN p_partkey % 3 = 0 THEN 'A' ELSE '' END AS name, '7b0' || lpad(CAST(p_partkey // 3 AS VARCHAR), 6, '0') AS value FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT p_partkey, 'spec', 'Weight ', p_size || ' lb' FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, 'spec', 'material', p_type FROM part WHERE p_partkey % 7 <> 0")
def child_rows(spark: SparkSession, sf: str) -> DataFrame:
    """References and specs of an observation as rows of their own."""
    obs = observations(spark, sf)
    ref = F.col("ref")
    refs = obs.select("part", F.lit("ref").alias("kind"), F.explode("refs").alias("ref")).select("part", "kind", F.regexp_extract(ref, "(-?[A-Z]?)$", 1).alias("name"), F.substring(ref, 1, 9).alias("value"))
    return refs.unionByName(obs.select("part", F.lit("spec").alias("kind"), F.explode("specs").alias("name", "value")))


# The relational schema of parts, their sources and their logs.
TABLES = {
    "parts": "part_id BIGINT, part_number STRING, brand STRING, part_name STRING, category STRING, subcategory STRING, created_at TIMESTAMP",
    "part_sources": "part_id BIGINT, site_name STRING, site_part_number STRING, availability_status STRING, price DECIMAL(10,2), scraped_at TIMESTAMP",
    "part_images": "part_id BIGINT, url STRING, image_type STRING, is_primary BOOLEAN",
    "fitment": "part_id BIGINT, year_start INT, year_end INT, make STRING, model STRING, engine STRING",
    "oem_references": "part_id BIGINT, oem_number STRING, oem_brand STRING, reference_type STRING",
    "part_specs": "part_id BIGINT, spec_name STRING, spec_value STRING",
    "scrape_log": "site_name STRING, search_term STRING, success BOOLEAN, rows_collected INT, duration_seconds DECIMAL(8,2), ts TIMESTAMP",
    "site_configs": "site_name STRING, is_active BOOLEAN, rate_limit_delay DECIMAL(5,2), success_rate DECIMAL(5,2)",
    "processing_sessions": "ts TIMESTAMP, sheet_name STRING, rows_processed INT, duration_seconds DOUBLE, success_count INT, likely_count INT, error_count INT, enhancement_type STRING",
    "daily_summaries": "day DATE, total_rows BIGINT, total_success BIGINT, success_rate DOUBLE, hours DOUBLE, rows_per_hour DOUBLE",
    "performance_metrics": "ts TIMESTAMP, metric_name STRING, value DOUBLE, sheet_name STRING, additional_data STRING",
}


def create_tables(spark: SparkSession, database: str = "interchange") -> None:
    """The tables, made where they are missing and widened where they lack columns."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, ddl in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")
        have = set(spark.table(f"{database}.{name}").columns)
        missing = [c.strip() for c in ddl.split(", ") if c.strip().split()[0] not in have]
        if missing:
            spark.sql(f"ALTER TABLE {database}.{name} ADD COLUMNS ({', '.join(missing)})")


def ask(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """A query with named parameters, which are values and never text of the query."""
    return spark.sql(sql, args=parameters)
