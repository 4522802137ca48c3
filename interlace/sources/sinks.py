"""Sinks: results, JSON reports, text reports, snapshots. Spark's committers make each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cell colours by verdict.
COLOURS = {"YES": "C6EFCE", "LIKELY": "DDEBF7", "UNCERTAIN": "FFEB9C", "NO": "FFC7CE"}


def write_results(df: DataFrame, path: str) -> None:
    """Results by sheet, with the colour of the verdict and the time as text."""
    colour = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair]), F.col("match_result")), F.lit("FFFFFF"))
    rows = df.withColumns({"colour": colour, "checked": F.date_format(F.col("last_checked").cast("timestamp"), "yyyy-MM-dd HH:mm")})
    rows.write.mode("overwrite").partitionBy("sheet_name").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """Each row as a JSON document, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, *lines: str) -> None:
    """A text report: SQL expressions over df, evaluated in one pass, a line each."""
    made = df.agg(*[F.expr(x).cast("string").alias(f"l{i}") for i, x in enumerate(lines)])
    made.select(F.explode(F.array(*[f"l{i}" for i in range(len(lines))])).alias("value")).write.mode("overwrite").text(path)


def snapshot(df: DataFrame, path: str, stamp: str) -> str:
    """A copy under a stamp; an earlier one is never overwritten."""
    target = f"{path}/{stamp}"
    df.write.mode("error").parquet(target)
    return target


def append_metrics(df: DataFrame, path: str) -> None:
    """Samples as JSON lines, appended."""
    df.write.mode("append").json(path)


def load_metrics(spark, path: str, schema: str, keep: int, order: str = "ts", by: str = "metric_name") -> DataFrame:
    """The newest `keep` samples of each metric; the schema is given, not guessed."""
    from pyspark.sql.window import Window

    rows = spark.read.schema(schema).json(path)
    newest = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return rows.withColumn("__n", newest).filter(F.col("__n") <= keep).drop("__n")


def append_rows(df: DataFrame, table: str) -> None:
    """Sources and log rows are appended as they come; they have no key to be ignored by."""
    df.write.mode("append").insertInto(table)
