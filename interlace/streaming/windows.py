"""Structured Streaming over the event stream: windows, sessions, de-duplication, late data, and bounded state.

Each query runs its stream to the end of the input (available-now trigger), writes to files in the checkpoint folder with
the stream's own checkpoint beside them, and reads the files back, so a batch query can be held against it.
"""

from __future__ import annotations

import heapq
import itertools
import math
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from interlace.plans.registry import read, register


def stream_dir(spark: SparkSession) -> str:
    """A new folder for a stream's files and checkpoint: in spark.checkpoint.dir, or a temporary one in a local session."""
    known = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{known or tempfile.mkdtemp(prefix='interlace-stream-')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf: str, **options: str) -> DataFrame:
    """The events as a stream, their time as TIMESTAMP, which watermarks need."""
    schema = read(spark, sf, "events").schema
    # As a pattern, for the table may be one file: a stream wants a folder or a pattern.
    return spark.readStream.schema(schema).options(**options).parquet(f"{sf}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame) -> DataFrame:
    """Run an append-mode stream over what is there and read its output back."""
    spark, folder = stream.sparkSession, stream_dir(stream.sparkSession)
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def plain(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


_CLOSED = "(SELECT max(ts) FROM events)"


@register("s_tumbling", f"WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 DAY <= {_CLOSED} - INTERVAL 10 MINUTE")
def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Events and their value by day and type; days behind the watermark."""
    rows = events(spark, sf).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return plain(drain(rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")), "start")


@register("s_sliding", f"WITH s AS (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) SELECT start, count(*) AS n, max(value) AS highest FROM s GROUP BY 1 HAVING start + INTERVAL 2 HOUR <= {_CLOSED} - INTERVAL 10 MINUTE")
def sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Two-hour windows that start each hour."""
    rows = events(spark, sf).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"), F.max("value").alias("highest"))
    return plain(drain(rows.select(F.col("window.start").alias("start"), "n", "highest")), "start")


@register("s_session", f"WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED} - INTERVAL 10 MINUTE")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user, closed by thirty minutes without an event."""
    rows = events(spark, sf).withWatermark("ts", "10 minutes").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return plain(drain(rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")), "start", "stop")


@register("s_dedup", "SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY ALL")
def dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One alert for each user, type and day passes; the state of past days is dropped with the watermark."""
    rows = events(spark, sf).withWatermark("ts", "1 day").withColumn("day", F.date_trunc("day", "ts")).dropDuplicates(["user_id", "event_type", "day"])
    return drain(rows.select("user_id", "event_type", F.to_date("day").alias("day"))).groupBy("user_id", "event_type").agg(F.count("*").alias("days"))


@register("s_daily", f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, round(100.0::DOUBLE * (count(*) - count_if(event_type = 'error')) / count(*), 6) AS success_rate FROM events GROUP BY 1 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {_CLOSED} - INTERVAL 1 HOUR")
def daily(spark: SparkSession, sf: str) -> DataFrame:
    """The daily summary as a stream."""
    errors = F.count_if(F.col("event_type") == "error")
    rows = events(spark, sf).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), errors.alias("errors"), F.round((F.count("*") - errors) * 100.0 / F.count("*"), 6).alias("success_rate"))
    return drain(rows.select(F.to_date("window.start").alias("day"), "n", "errors", "success_rate"))


@register("s_stream_static", "SELECT event_id, user_id, c_mktsegment AS segment FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'")
def stream_static(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases with their customer's segment: a stream joined with a table."""
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    rows = events(spark, sf).filter("event_type = 'purchase'").select("event_id", "user_id")
    return drain(rows.join(customers, "user_id", "left").select("event_id", "user_id", "segment"))


#: Samples that a source's state keeps, and the drop of the recent mean below the whole that counts as an anomaly.
KEEP, RECENT, DROP = 1000, 20, 15.0


def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the last samples of a source; report each batch's mean, the recent mean and whether it fell."""
    kept = [tuple(x) for x in zip(*state.get)] if state.exists else []
    for batch in batches:  # chunks of a group come in any order, so the samples keep their times
        rows = zip(batch["ts"].astype("int64").tolist(), batch["event_id"].tolist(), batch["value"].tolist())
        kept = heapq.nlargest(KEEP, itertools.chain(kept, rows))
    state.update(tuple(map(list, zip(*kept))))
    values = [x[2] for x in kept]  # the newest first
    recent = values[:RECENT]
    mean, late = math.fsum(values) / len(values), math.fsum(recent) / len(recent)
    yield pd.DataFrame({"event_type": [key[0]], "samples": [len(values)], "baseline": [round(mean, 6)], "recent": [round(late, 6)], "dropped": [mean - late > DROP]})


def anomaly_stream(stream: DataFrame) -> DataFrame:
    return stream.groupBy("event_type").applyInPandasWithState(watch, "event_type string, samples long, baseline double, recent double, dropped boolean", "ts array<long>, event_id array<long>, value array<double>", "append", "NoTimeout")


@register("s_anomaly_state", f"WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events) SELECT event_type, count(*) AS samples, round(avg(value), 6) AS baseline, round(avg(value) FILTER (WHERE back <= {RECENT}), 6) AS recent, avg(value) - avg(value) FILTER (WHERE back <= {RECENT}) > {DROP} AS dropped FROM e WHERE back <= {KEEP} GROUP BY event_type")
def anomaly_state(spark: SparkSession, sf: str) -> DataFrame:
    """Anomalies of each stream with bounded state."""
    return drain(anomaly_stream(events(spark, sf).select("event_type", "event_id", "ts", "value")))
