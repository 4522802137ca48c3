"""Sinks and stores as queries: what is written is read back, so that SQL over the input can be held against it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.functions import text as X
from interlace.operators.ingest import COMPLEXITY, DEFAULT_COMPLEXITY, ask, create_tables
from interlace.plans.model import WITH, flagged, match_rows
from interlace.plans.registry import read, register
from interlace.sources import sinks, store
from interlace.sources.xlsx import XlsxDataSource
from interlace.streaming.windows import stream_dir

_COLOUR = "CASE match_result " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sinks.COLOURS.items()) + " ELSE 'FFFFFF' END"


@register("written_results", WITH + f"SELECT row_number, part_number, skp_part_number, sheet_name, match_result, confidence, {_COLOUR} AS colour, strftime(last_checked, '%Y-%m-%d %H:%M') AS checked FROM m")
def written_results(spark: SparkSession, sf: str) -> DataFrame:
    """The results as the result sink writes them."""
    path = stream_dir(spark)
    columns = ["row_number", "part_number", "skp_part_number", "sheet_name", "match_result", "confidence"]
    rows = match_rows(spark, sf).select(*columns, "last_checked")
    sinks.write_results(rows, path)
    return spark.read.schema("row_number long, part_number string, skp_part_number string, match_result string, confidence int, colour string, checked string, sheet_name string").parquet(path).select(*columns, "colour", "checked")


@register("json_reports", WITH + "SELECT row_number, part_number, skp_part_number, confidence, match_reason FROM m WHERE match_result = 'UNCERTAIN'")
def json_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Rows exported as JSON documents, nulls kept, and read back."""
    path = stream_dir(spark)
    rows = match_rows(spark, sf).filter("match_result = 'UNCERTAIN'").select("row_number", "part_number", "skp_part_number", "confidence", "match_reason")
    sinks.export_json(rows, path)
    return spark.read.text(path).select(F.from_json("value", "row_number long, part_number string, skp_part_number string, confidence int, match_reason string").alias("r")).select("r.*")


_COMPARED = "SELECT confidence / 100.0{d} AS cv, coalesce(confidence >= 75, false) AS high, desc_match = 'YES' AND NOT coalesce(confidence >= 75, false) AS seen FROM {m} WHERE sheet_name = 'Anchor' AND match_result = 'UNCERTAIN'"
_SHARE = "round(100.0{d} * count_if(high OR seen) / greatest(count(*), 1), 1)"


@register(
    "text_report",
    WITH + f", c AS ({_COMPARED.format(d='::DOUBLE', m='m')}) SELECT unnest(['Sheet: Anchor', 'Total comparisons: ' || count(*), 'Upgraded to LIKELY: ' || count_if(high OR seen), 'Upgrade rate: ' || {_SHARE.format(d='::DOUBLE')} || '%', 'High CV similarity: ' || count_if(high), 'AI vision analysis: ' || count_if(seen), 'Average CV score: ' || round(coalesce(sum(cv), 0) / greatest(count(*), 1), 3)]) AS line FROM c",
)
def text_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report on the upgrades of a sheet: comparisons, upgrades and their share, by which way, and the mean score."""
    path = stream_dir(spark)
    match_rows(spark, sf).createOrReplaceTempView("rows_to_report")
    lines = ("'Sheet: Anchor'", "concat('Total comparisons: ', count(*))", "concat('Upgraded to LIKELY: ', count_if(high OR seen))", f"concat('Upgrade rate: ', {_SHARE.format(d='D')}, '%')", "concat('High CV similarity: ', count_if(high))", "concat('AI vision analysis: ', count_if(seen))", "concat('Average CV score: ', round(coalesce(sum(cv), 0) / greatest(count(*), 1), 3))")
    sinks.write_report(spark.sql(_COMPARED.format(d="D", m="rows_to_report")), path, *lines)
    return spark.read.text(path).withColumnRenamed("value", "line")


@register("snapshot_rows", "SELECT * FROM supplier")
def snapshot_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A table from its snapshot."""
    return spark.read.parquet(sinks.snapshot(read(spark, sf, "supplier"), stream_dir(spark), "2000-01-01"))


@register("metric_log", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS back FROM events) SELECT event_type AS metric_name, event_id, value FROM e WHERE back <= 20")
def metric_log(spark: SparkSession, sf: str, keep: int = 20) -> DataFrame:
    """Samples appended to a JSON log in two goes, and the newest of each metric loaded from it."""
    path = stream_dir(spark)
    rows = read(spark, sf, "events").select(F.col("event_type").alias("metric_name"), "event_id", "value")
    sinks.append_metrics(rows.filter("event_id % 2 = 0"), path)
    sinks.append_metrics(rows.filter("event_id % 2 = 1"), path)
    return sinks.load_metrics(spark, path, "metric_name string, event_id long, value double", keep, order="event_id")


@register("stored_rows", "SELECT event_type AS metric_name, count(*) AS n, max(value) AS highest FROM events WHERE value >= 50 GROUP BY 1")
def stored_rows(spark: SparkSession, sf: str, least: float = 50.0) -> DataFrame:
    """Tables made and widened, rows appended, and a question with a parameter asked of them."""
    database, path = f"interlace_{uuid.uuid4().hex}", stream_dir(spark)
    spark.sql(f"CREATE DATABASE {database}")
    spark.sql(f"CREATE TABLE {database}.performance_metrics (ts TIMESTAMP, metric_name STRING) USING parquet")
    create_tables(spark, database)
    rows = read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric_name"), "value", F.lit(None).cast("string").alias("sheet_name"), F.col("props").alias("additional_data"))
    sinks.append_rows(rows, f"{database}.performance_metrics")
    ask(spark, f"SELECT metric_name, count(*) AS n, max(value) AS highest FROM {database}.performance_metrics WHERE value >= :least GROUP BY metric_name", least=least).write.parquet(path)
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.read.parquet(path)


_SECONDS = "CASE part_type " + " ".join(f"WHEN '{k}' THEN {v[1]}::DOUBLE" for k, v in COMPLEXITY.items()) + f" ELSE {DEFAULT_COMPLEXITY[1]}::DOUBLE END"


@register("optimization_report", WITH + f"""SELECT 'brand' AS section, supplier AS name, round(count_if(confirmed)::DOUBLE / nullif(count_if(processed), 0), 6) AS value FROM f GROUP BY 2
UNION ALL SELECT 'part type', part_type, round(avg({_SECONDS}), 6) FROM f GROUP BY 2
UNION ALL SELECT 'total', 'brands', count(DISTINCT supplier)::DOUBLE FROM f UNION ALL SELECT 'total', 'part types', count(DISTINCT part_type)::DOUBLE FROM f
UNION ALL SELECT 'total', 'open rows', count_if(NOT processed OR match_result = 'UNCERTAIN')::DOUBLE FROM f
UNION ALL SELECT 'batch', 'recommended size', CASE WHEN avg(value) / 2.5 > 80 THEN 25::DOUBLE WHEN avg(value) / 2.5 > 60 THEN 37 ELSE 50 END FROM events""")
def optimization_report(spark: SparkSession, sf: str) -> DataFrame:
    """Success by brand, seconds by part type, totals, and the batch size under the mean load."""
    rows = flagged(spark, sf)
    seconds = F.coalesce(*[F.when(F.col("part_type") == k, float(v[1])) for k, v in COMPLEXITY.items()], F.lit(float(DEFAULT_COMPLEXITY[1])))
    part = lambda df, section: df.select(F.lit(section).alias("section"), "name", F.col("value").cast("double").alias("value"))
    brands = rows.groupBy(F.col("supplier").alias("name")).agg(F.round(F.try_divide(F.count_if("confirmed"), F.count_if("processed")), 6).alias("value"))
    types = rows.groupBy(F.col("part_type").alias("name")).agg(F.round(F.avg(seconds), 6).alias("value"))
    totals = rows.agg(F.count_distinct("supplier").alias("brands"), F.count_distinct("part_type").alias("part types"), F.count_if(F.expr("not processed or match_result = 'UNCERTAIN'")).alias("open rows"))
    totals = totals.unpivot([], ["brands", "part types", "open rows"], "name", "value")
    load = F.avg("value") / 2.5
    batch = read(spark, sf, "events").agg(F.when(load > 80, 25.0).when(load > 60, 37.0).otherwise(50.0).alias("value")).withColumn("name", F.lit("recommended size"))
    return part(brands, "brand").unionByName(part(types, "part type")).unionByName(part(totals, "total")).unionByName(part(batch, "batch"))


@register("stored_upgrades", WITH + ", u AS (SELECT sheet_name, CASE WHEN match_result = 'UNCERTAIN' AND sheet_name IN ('Anchor', 'Dorman') AND confidence >= 50 THEN 'LIKELY' ELSE match_result END AS match_result, confidence FROM m) SELECT sheet_name, match_result, count(*) AS n, CAST(sum(confidence) AS BIGINT) AS confidence FROM u GROUP BY ALL")
def stored_upgrades(spark: SparkSession, sf: str) -> DataFrame:
    """Upgraded rows of two sheets are written back into a store with a partition for each sheet, twice as after a
    repeated run; counts by sheet and verdict of what the store then holds."""
    rows = match_rows(spark, sf).select("sheet_name", "row_number", "part_number", "skp_part_number", "match_result", "confidence")
    path = stream_dir(spark)
    store.create(rows, path, "sheet_name")
    better = rows.filter("match_result = 'UNCERTAIN' AND sheet_name IN ('Anchor', 'Dorman') AND confidence >= 50").withColumn("match_result", F.lit("LIKELY"))
    for _ in range(2):
        store.upsert(better, path, ["sheet_name", "row_number", "part_number", "skp_part_number"], "sheet_name")
    stored = spark.read.schema(rows.schema).parquet(path)
    return stored.groupBy("sheet_name", "match_result").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"))


_BOOK = ("part_type", "supplier", "part_number", "skp_part_number", "match_result", "confidence", "match_reason", "checked")


def from_workbooks(spark: SparkSession, sf: str) -> DataFrame:
    """The match rows, written as workbooks with a sheet for each sheet name and typed as they are read back: an empty verdict stays
    empty, a missing confidence is null, times become timestamps. The rows of a sheet may be a third of all, so a sheet is written by several tasks."""
    spark.dataSource.register(XlsxDataSource)
    path = stream_dir(spark)
    rows = match_rows(spark, sf).withColumn("checked", F.date_format(F.col("last_checked").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).select("sheet_name", *_BOOK)
    rows.sortWithinPartitions("sheet_name").write.format("xlsx").mode("append").save(path)
    cells = spark.read.format("xlsx").option("columns", len(_BOOK)).load(path).withColumnsRenamed({f"c{i + 1}": c for i, c in enumerate(_BOOK)})
    return cells.withColumns({"confidence": X.parse_confidence(F.col("confidence")), "checked": X.parse_time(F.col("checked")).cast("timestamp_ntz")})


@register("workbook_rows", WITH + f"SELECT sheet_name, {', '.join(c for c in _BOOK[:-1] if c != 'match_reason')}, CAST(last_checked AS TIMESTAMP) AS checked FROM m WHERE match_result = 'UNCERTAIN'")
def workbook_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The uncertain rows of the workbooks, typed."""
    return from_workbooks(spark, sf).filter("match_result = 'UNCERTAIN'").drop("row_number", "match_reason")


@register("workbook_quality", WITH + "SELECT sheet_name, count(*) AS n, CAST(count_if(match_result IN ('YES', 'LIKELY', 'UNCERTAIN', 'NO')) AS BIGINT) AS processed, count(confidence) AS with_confidence, CAST(sum(confidence) AS BIGINT) AS confidence, count(DISTINCT part_number) AS parts, CAST(count_if(match_reason <> '') AS BIGINT) AS with_reason, CAST(max(last_checked) AS TIMESTAMP) AS last_checked FROM m GROUP BY sheet_name")
def workbook_quality(spark: SparkSession, sf: str) -> DataFrame:
    """What the quality report needs of each sheet of the workbooks."""
    return from_workbooks(spark, sf).groupBy("sheet_name").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("match_result").isin("YES", "LIKELY", "UNCERTAIN", "NO")).alias("processed"),
        F.count("confidence").alias("with_confidence"),
        F.sum("confidence").cast("long").alias("confidence"),
        F.count_distinct("part_number").alias("parts"),
        F.count_if(F.col("match_reason") != "").alias("with_reason"),
        F.max("checked").alias("last_checked"),
    )
