"""A keyed store of partitioned files: updates rewrite only the partitions that they touch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def create(rows: DataFrame, path: str, partition: str) -> None:
    """Write rows as a new store; an existing one is an error. A null partition is a partition."""
    rows.write.partitionBy(partition).parquet(path)


def latest(updates: DataFrame, keys: list[str], newest: str | None) -> DataFrame:
    """One row for each key: the one with the greatest value of `newest`, or any of equal ones."""
    if newest is None:
        return updates.dropDuplicates(keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(newest)))
    return updates.withColumn("__place", place).filter("__place = 1").drop("__place")


def upsert(updates: DataFrame, path: str, keys: list[str], partition: str, newest: str | None = None) -> None:
    """Put updates into the store: a row replaces the one with its keys in its partition, or is added.

    keys must hold the partition. Files of other partitions are neither read nor written. New files are written beside the
    store and take the place of the old ones when all are complete, so a failed or repeated update leaves whole partitions;
    doing the same update twice gives the same rows. Null keys equal each other. No updates change nothing.
    """
    if partition not in keys:
        raise ValueError(f"the keys {keys} lack the partition {partition}")
    spark, updates = updates.sparkSession, latest(updates, keys, newest)
    try:
        old = spark.read.schema(updates.schema).parquet(path)
        old.isEmpty()
    except AnalysisException:  # no store yet
        old = spark.createDataFrame([], updates.schema)
    touched = updates.select(F.col(partition).alias("__partition")).distinct()
    named = updates.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    # Partitions are few, so all rows stay where they were read: a shuffle by the partition would put each of them whole into one task.
    kept = old.join(F.broadcast(touched), F.col(partition).eqNullSafe(F.col("__partition")), "left_semi").join(named, same, "left_anti")
    rows = kept.unionByName(updates)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
