"""Trends by day, costs, tasks, alerts, notifications and health, as batch queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from interlace.plans.model import chain
from interlace.plans.registry import read, register


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Processing sessions: a row for each order, with counts fixed by its row."""
    k, rows = F.col("o_orderkey"), (F.col("o_orderkey") % 50).cast("long")
    return read(spark, sf, "orders").select(
        k.alias("session"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("sheet_name"), rows.alias("rows_processed"), F.expr("o_orderkey % 50 div 2").alias("success_count"), F.expr("o_orderkey % 50 div 5").alias("likely_count"),
        (30.0 + k % 600).alias("duration_seconds"), F.when(k % 3 == 0, "enhanced").otherwise("standard").alias("enhancement"),
    )


_SESSIONS = "WITH s AS (SELECT o_orderkey AS session, o_orderdate AS ts, o_orderpriority AS sheet_name, o_orderkey % 50 AS rows_processed, (o_orderkey % 50) // 2 AS success_count, (o_orderkey % 50) // 5 AS likely_count, 30.0::DOUBLE + o_orderkey % 600 AS duration_seconds, CASE WHEN o_orderkey % 3 = 0 THEN 'enhanced' ELSE 'standard' END AS enhancement FROM orders)"


@register("daily_summary", _SESSIONS + " SELECT CAST(ts AS DATE) AS day, CAST(sum(rows_processed) AS BIGINT) AS n_rows, CAST(sum(success_count + likely_count) AS BIGINT) AS successes, round(sum(duration_seconds) / 3600, 6) AS hours, round(coalesce(sum(success_count + likely_count) * 100.0::DOUBLE / nullif(sum(rows_processed), 0), 0), 6) AS success_rate, round(sum(rows_processed) / (sum(duration_seconds) / 3600), 6) AS rows_per_hour FROM s GROUP BY 1")
def daily_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, successes, hours and speed of each day."""
    n, ok, seconds = F.sum("rows_processed"), F.sum(F.col("success_count") + F.col("likely_count")), F.sum("duration_seconds")
    return sessions(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(n.alias("n_rows"), ok.alias("successes"), F.round(seconds / 3600, 6).alias("hours"), F.round(F.coalesce(F.try_divide(ok * 100.0, n), F.lit(0.0)), 6).alias("success_rate"), F.round(n / (seconds / 3600), 6).alias("rows_per_hour"))


@register("success_by_day", _SESSIONS + " SELECT sheet_name, CAST(ts AS DATE) AS day, round(avg((success_count + likely_count) * 100.0::DOUBLE / nullif(rows_processed, 0)), 6) AS mean_rate FROM s GROUP BY ALL")
def success_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the sessions' success rates by sheet and day; empty sessions have no rate."""
    rate = F.try_divide((F.col("success_count") + F.col("likely_count")) * 100.0, F.col("rows_processed"))
    return sessions(spark, sf).groupBy("sheet_name", F.to_date("ts").alias("day")).agg(F.round(F.avg(rate), 6).alias("mean_rate"))


@register("enhancement_impact", _SESSIONS + ", r AS (SELECT sheet_name, enhancement, (success_count + likely_count) * 100.0::DOUBLE / nullif(rows_processed, 0) AS rate FROM s) SELECT sheet_name, round(avg(rate) FILTER (WHERE enhancement = 'enhanced'), 6) AS enhanced, round(avg(rate) FILTER (WHERE enhancement = 'standard'), 6) AS standard, round(avg(rate) FILTER (WHERE enhancement = 'enhanced') - avg(rate) FILTER (WHERE enhancement = 'standard'), 6) AS difference FROM r GROUP BY 1")
def enhancement_impact(spark: SparkSession, sf: str) -> DataFrame:
    """Mean success rate with and without the enhancement, kinds as columns."""
    rate = F.try_divide((F.col("success_count") + F.col("likely_count")) * 100.0, F.col("rows_processed"))
    wide = sessions(spark, sf).withColumn("rate", rate).groupBy("sheet_name").pivot("enhancement", ["enhanced", "standard"]).agg(F.avg("rate"))
    return wide.select("sheet_name", F.round("enhanced", 6).alias("enhanced"), F.round("standard", 6).alias("standard"), F.round(F.col("enhanced") - F.col("standard"), 6).alias("difference"))


@register("velocity", _SESSIONS + ", h AS (SELECT sheet_name, enhancement, rows_processed, duration_seconds / 3600 AS hours, rows_processed / (duration_seconds / 3600) AS speed FROM s) SELECT sheet_name, round(sum(rows_processed) / sum(hours), 6) AS rows_per_hour, round(max(speed), 6) AS peak, round(avg(speed) / max(speed) * 100, 6) AS steadiness, round((sum(rows_processed) FILTER (WHERE enhancement = 'enhanced') / sum(hours) FILTER (WHERE enhancement = 'enhanced')) / (sum(rows_processed) FILTER (WHERE enhancement <> 'enhanced') / sum(hours) FILTER (WHERE enhancement <> 'enhanced')), 6) AS factor FROM h GROUP BY 1")
def velocity(spark: SparkSession, sf: str) -> DataFrame:
    """Speed as a ratio of sums, its peak and steadiness, and what the enhancement does to it."""
    hours, enhanced = F.col("duration_seconds") / 3600, F.col("enhancement") == "enhanced"
    speed = F.col("rows_processed") / hours
    ratio = lambda c: F.sum(F.when(c, F.col("rows_processed"))) / F.sum(F.when(c, hours))
    return sessions(spark, sf).groupBy("sheet_name").agg(F.round(ratio(F.lit(True)), 6).alias("rows_per_hour"), F.round(F.max(speed), 6).alias("peak"), F.round(F.avg(speed) / F.max(speed) * 100, 6).alias("steadiness"), F.round(ratio(enhanced) / ratio(~enhanced), 6).alias("factor"))


@register("error_mix", "WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) % 4 AS kind, ts FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 50) SELECT kind, count(*) AS n, CAST(count_if(ts >= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR) AS BIGINT) AS last_hour, count(*) = max(count(*)) OVER () AS most_common FROM e GROUP BY kind")
def error_mix(spark: SparkSession, sf: str, last: int = 50) -> DataFrame:
    """The kinds of the last fifty errors (a top-k, so no window over all errors), and those of the last hour."""
    e = read(spark, sf, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    e = e.select((F.get_json_object("props", "$.k").cast("int") % 4).alias("kind"), "ts")
    newest = e.agg(F.max("ts").alias("newest"))
    out = e.crossJoin(F.broadcast(newest)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.col("newest") - F.expr("interval 1 hour")).alias("last_hour"))
    return out.withColumn("most_common", F.col("n") == F.max("n").over(Window.partitionBy(F.lit(1))))


@register("network_stats", "SELECT user_id, count(*) AS requests, round(avg(value), 6) AS mean, CAST(count_if(value > 200) AS BIGINT) AS slow, round(coalesce(count(*) / nullif(date_diff('second', min(ts), max(ts)) / 60.0::DOUBLE, 0), 0), 4) AS per_minute FROM events WHERE event_type = 'view' GROUP BY 1")
def network_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, mean time, slow ones and requests in a minute over the span of each client."""
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", F.min("ts")), F.date_trunc("second", F.max("ts")))
    return read(spark, sf, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("requests"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 200).alias("slow"), F.round(F.coalesce(F.try_divide(F.count("*"), seconds / 60.0), F.lit(0.0)), 4).alias("per_minute"))


# Dollars for a thousand input and output tokens by service.
RATES = {"user": (0.003, 0.0), "assistant": (0.0, 0.015), "system": (0.001, 0.005)}


def token_cost(service: Column, tokens: Column) -> Column:
    """C20: cost of a call by its service's rates; unknown services cost nothing."""
    return chain([(service == k, tokens / 1000.0 * (a + b)) for k, (a, b) in RATES.items()], 0.0)


_CALLS = "WITH c AS (SELECT conv_id, role AS service, len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) AS tokens, DATE '2024-01-01' + CAST(conv_id % 40 AS INT) AS day FROM conversations), d AS (SELECT *, " + "CASE service " + " ".join(f"WHEN '{k}' THEN tokens / 1000.0::DOUBLE * {a + b}" for k, (a, b) in RATES.items()) + " ELSE 0 END AS cost FROM c)"


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """The log of API calls: one for each conversation turn."""
    tokens = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ ]+"), F.lit(0)))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 40).cast("int"))
    return read(spark, sf, "conversations").select("conv_id", F.col("role").alias("service"), tokens.alias("tokens"), day.alias("day")).withColumn("cost", token_cost(F.col("service"), F.col("tokens")))


@register("cost_by_service", _CALLS + " SELECT service, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM d GROUP BY 1")
def cost_by_service(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, tokens and cost of each service."""
    return calls(spark, sf).groupBy("service").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


@register("cost_week", _CALLS + ", w AS (SELECT day, sum(cost) AS cost FROM d WHERE day <> DATE '2024-01-18' GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(DATE '2024-01-15', DATE '2024-01-21', INTERVAL 1 DAY)) AS DATE) AS day) SELECT s.day, round(coalesce(cost, 0), 6) AS cost, CASE WHEN coalesce(cost, 0) >= 0.02 THEN 'over' WHEN coalesce(cost, 0) >= 0.016 THEN 'warning' ELSE 'ok' END AS status FROM s LEFT JOIN w USING (day)")
def cost_week(spark: SparkSession, sf: str, first: str = "2024-01-15", limit: float = 0.02) -> DataFrame:
    """Cost of each of seven days, days without calls included, against the daily limit."""
    found = calls(spark, sf).filter("day <> date'2024-01-18'").groupBy("day").agg(F.sum("cost").alias("cost"))
    spine = spark.range(7).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"))
    cost = F.coalesce("cost", F.lit(0.0))
    return spine.join(found, "day", "left").select("day", F.round(cost, 6).alias("cost"), chain([(cost >= limit, "over"), (cost >= 0.8 * limit, "warning")], "ok").alias("status"))


@register("task_ready", "WITH t AS (SELECT o_orderkey AS task, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RUNNING' ELSE 'COMPLETED' END AS status, o_orderdate AS due, [o_orderkey - 1, o_orderkey - 7] AS deps FROM orders), d AS (SELECT task, due, unnest(deps) AS dep FROM t WHERE status = 'PENDING' AND due <= TIMESTAMP '2000-01-01') SELECT d.task, max(d.due) AS due FROM d LEFT JOIN t ON t.task = d.dep GROUP BY 1 HAVING bool_and(coalesce(t.status, 'COMPLETED') = 'COMPLETED')")
def task_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Due tasks whose dependencies are all completed; a dependency that does not exist holds no one up."""
    status = chain([(F.col("o_orderstatus") == "O", "PENDING"), (F.col("o_orderstatus") == "P", "RUNNING")], "COMPLETED")
    t = read(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), status.alias("status"), F.col("o_orderdate").alias("due"))
    waiting = t.filter((F.col("status") == "PENDING") & (F.col("due") <= F.lit("2000-01-01").cast("timestamp_ntz"))).select("task", "due", F.explode(F.array(F.col("task") - 1, F.col("task") - 7)).alias("dep"))
    state = t.select(F.col("task").alias("dep"), F.col("status").alias("dep_status"))
    done = F.coalesce("dep_status", F.lit("COMPLETED")) == "COMPLETED"
    return waiting.join(state, "dep", "left").groupBy("task").agg(F.max("due").alias("due"), F.bool_and(done).alias("ready")).filter("ready").drop("ready")


@register("task_counts", "SELECT o_orderstatus AS status, CAST(count_if(o_orderpriority = '1-URGENT') AS BIGINT) AS urgent, CAST(count_if(o_orderpriority <> '1-URGENT') AS BIGINT) AS others, count(*) AS n FROM orders GROUP BY 1")
def task_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks by status and kind."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(urgent).alias("urgent"), F.count_if(~urgent).alias("others"), F.count("*").alias("n"))


_ALERTS = "WITH a AS (SELECT event_id, ts, user_id % 20 AS component, CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'warning' ELSE 'info' END AS severity FROM events WHERE event_type = 'error')"


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    severity = chain([(F.col("value") > 200, "critical"), (F.col("value") > 100, "warning")], "info")
    return read(spark, sf, "events").filter("event_type = 'error'").select("event_id", "ts", (F.col("user_id") % 20).alias("component"), severity.alias("severity"))


@register("alerts_dedup", _ALERTS + ", l AS (SELECT *, lag(ts) OVER (PARTITION BY component, severity ORDER BY ts, event_id) AS before FROM a) SELECT event_id, component, severity, ts FROM l WHERE before IS NULL OR ts - before >= INTERVAL 24 HOUR")
def alerts_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """An alert is new if its component and severity had none in the 24 hours before.

    The alert before is looked for inside an hour; for the first one of an hour it is the last one of the hour with any before.
    """
    rows = alerts(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    keys = ["component", "severity"]
    hours = rows.groupBy(*keys, "hour").agg(F.max("ts").alias("last"))
    hours = hours.withColumn("last", F.lag("last").over(Window.partitionBy(*keys).orderBy("hour")))
    inside = F.lag("ts").over(Window.partitionBy(*keys, "hour").orderBy("ts", "event_id"))
    rows = rows.withColumn("inside", inside).join(hours, [*keys, "hour"])
    before = F.coalesce("inside", "last")
    return rows.filter(before.isNull() | (F.col("ts") - before >= F.expr("interval 24 hours"))).select("event_id", *keys, "ts")


@register("alert_summary", _ALERTS + " SELECT component, count(*) AS n, CAST(count_if(severity = 'critical') AS BIGINT) AS critical, CAST(count_if(severity = 'warning') AS BIGINT) AS warning, count(*) - CAST(count_if(severity IN ('critical', 'warning')) AS BIGINT) AS info, CASE WHEN count_if(severity = 'critical') > 0 THEN 'critical' WHEN count_if(severity = 'warning') > 3 THEN 'degraded' WHEN count_if(severity = 'warning') > 0 OR count(*) > 5 THEN 'caution' ELSE 'healthy' END AS health FROM a GROUP BY 1")
def alert_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts by component and the health that follows from them."""
    critical, warning = F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "warning")
    return alerts(spark, sf).groupBy("component").agg(F.count("*").alias("n"), critical.alias("critical"), warning.alias("warning"), (F.count("*") - critical - warning).alias("info"), chain([(critical > 0, "critical"), (warning > 3, "degraded"), ((warning > 0) | (F.count("*") > 5), "caution")], "healthy").alias("health"))


@register("notify_route", _ALERTS + ", r AS (SELECT event_id, severity, unnest(CASE severity WHEN 'critical' THEN ['email', 'webhook', 'console'] WHEN 'warning' THEN ['email', 'console'] ELSE ['file'] END) AS channel FROM a) SELECT event_id, channel, CASE severity WHEN 'critical' THEN 'admin' ELSE 'operator' END AS recipient, CASE severity WHEN 'critical' THEN 4 WHEN 'warning' THEN 3 ELSE 1 END AS priority, 'Alert ' || event_id || ' is ' || severity AS message FROM r")
def notify_route(spark: SparkSession, sf: str) -> DataFrame:
    """Who gets an alert, over which channels, how urgently, and the rendered message."""
    s = F.col("severity")
    channels = F.when(s == "critical", F.array(F.lit("email"), F.lit("webhook"), F.lit("console"))).when(s == "warning", F.array(F.lit("email"), F.lit("console"))).otherwise(F.array(F.lit("file")))
    return alerts(spark, sf).select("event_id", F.explode(channels).alias("channel"), F.when(s == "critical", "admin").otherwise("operator").alias("recipient"), chain([(s == "critical", 4), (s == "warning", 3)], 1).alias("priority"), F.format_string("Alert %d is %s", F.col("event_id"), s).alias("message"))


@register("delivery_stats", "SELECT event_type AS channel, CAST(count_if(value < 180) AS BIGINT) AS delivered, CAST(count_if(value >= 180) AS BIGINT) AS failed, round(100.0::DOUBLE * count_if(value < 180) / count(*), 6) AS rate, CAST(count_if(value >= 180 AND event_id % 4 < 3) AS BIGINT) AS retried FROM events GROUP BY 1")
def delivery_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries by channel; a message is tried three times at most."""
    ok = F.col("value") < 180
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count_if(ok).alias("delivered"), F.count_if(~ok).alias("failed"), F.round(F.count_if(ok) * 100.0 / F.count("*"), 6).alias("rate"), F.count_if(~ok & (F.col("event_id") % 4 < 3)).alias("retried"))


@register("health_check", "WITH s AS (SELECT event_id, value / 2.5::DOUBLE AS cpu, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS memory FROM events) SELECT event_id, CASE WHEN cpu > 90 THEN 'critical' WHEN cpu > 75 THEN 'warning' WHEN memory > 90 THEN 'critical' WHEN memory > 80 THEN 'warning' ELSE 'healthy' END AS health, CASE WHEN cpu / 100 < 0.4 THEN 1.5::DOUBLE WHEN cpu / 100 < 0.8 THEN 1.0::DOUBLE WHEN cpu / 100 < 0.96 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS factor FROM s")
def health_check(spark: SparkSession, sf: str) -> DataFrame:
    """Health of a sample (CPU is looked at before memory) and the factor for the batch size."""
    cpu, memory = F.col("value") / 2.5, F.get_json_object("props", "$.k").cast("double")
    use = cpu / 100
    return read(spark, sf, "events").select("event_id", chain([(cpu > 90, "critical"), (cpu > 75, "warning"), (memory > 90, "critical"), (memory > 80, "warning")], "healthy").alias("health"), chain([(use < 0.4, 1.5), (use < 0.8, 1.0), (use < 0.96, 0.8)], 0.5).alias("factor"))


@register("snapshot", "SELECT user_id, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS current_status, arg_max(value, (ts, event_id)) AS current_value, count(*) AS samples FROM events GROUP BY 1")
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The latest sample of each source."""
    newest = F.struct("ts", "event_id")
    return read(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.max_by("event_type", newest).alias("current_status"), F.max_by("value", newest).alias("current_value"), F.count("*").alias("samples"))


@register("site_seed", "SELECT s_suppkey AS site, s_name AS name, s_acctbal > 0 AS active, CASE WHEN s_nationkey = 7 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS delay FROM supplier WHERE s_acctbal > 0")
def site_seed(spark: SparkSession, sf: str) -> DataFrame:
    """Site settings with one of them updated for some sites, active sites only."""
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("active"), F.lit(1.0).alias("delay"), "s_nationkey")
    return rows.withColumn("delay", F.when(F.col("s_nationkey") == 7, 2.0).otherwise(F.col("delay"))).filter("active").drop("s_nationkey")


@register("trend_block", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_orderkey % 50) AS volume, avg((o_orderkey % 50) / ((30.0::DOUBLE + o_orderkey % 600) / 3600)) FILTER (WHERE o_orderkey % 50 > 0) AS speed FROM orders GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, row_number() OVER (ORDER BY day DESC) AS back FROM d) SELECT CAST(sum(volume) AS BIGINT) AS total, round(avg(volume), 6) AS mean_volume, round(regr_slope(volume, i), 6) AS volume_slope, round(avg(speed), 4) AS mean_speed, round(avg(volume) FILTER (WHERE back <= 7), 6) AS last_week, round((avg(volume) FILTER (WHERE back <= 3) - avg(volume) FILTER (WHERE i < 3)) / nullif(avg(volume) FILTER (WHERE i < 3), 0) * 100, 6) AS improvement FROM x")
def trend_block(spark: SparkSession, sf: str) -> DataFrame:
    """Sum, mean and slope of the daily volume, mean speed, last week, improvement; the window runs over days."""
    speed = F.when(F.col("rows_processed") > 0, F.col("rows_processed") / (F.col("duration_seconds") / 3600))
    d = sessions(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.sum("rows_processed").alias("volume"), F.avg(speed).alias("speed"))
    x = d.withColumns({"i": F.row_number().over(Window.orderBy("day")) - 1, "back": F.row_number().over(Window.orderBy(F.desc("day")))})
    v = F.col("volume")
    first, last = F.avg(F.when(F.col("i") < 3, v)), F.avg(F.when(F.col("back") <= 3, v))
    return x.agg(F.sum(v).alias("total"), F.round(F.avg(v), 6).alias("mean_volume"), F.round(F.regr_slope(v, F.col("i")), 6).alias("volume_slope"), F.round(F.avg("speed"), 4).alias("mean_speed"), F.round(F.avg(F.when(F.col("back") <= 7, v)), 6).alias("last_week"), F.round(F.try_divide(last - first, first) * 100, 6).alias("improvement"))


@register("running_success", "WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS ok FROM orders) SELECT o_orderkey AS session, row_number() OVER w AS n, round(avg(ok) OVER w, 6) AS success_rate, round(least(row_number() OVER w / 100.0::DOUBLE, 1), 6) AS confidence FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running_success(spark: SparkSession, sf: str) -> DataFrame:
    """Success rate so far of each brand (here: customer) and how far it can be trusted."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(w)
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("session"), n.alias("n"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).over(w), 6).alias("success_rate"), F.round(F.least(n / 100.0, F.lit(1.0)), 6).alias("confidence"))


@register("batch_statistics", "WITH b AS (SELECT o_custkey AS batch, o_orderkey, o_orderdate, 10.0::DOUBLE + o_orderkey % 90 AS seconds, 1 + o_orderkey % 25 AS items, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS success FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY o_orderdate DESC, o_orderkey DESC) AS back, items / (seconds / 60) AS speed FROM b), s AS (SELECT batch, round(avg(speed), 6) AS items_per_minute, round(least(1, avg(speed) / 10 * avg(success)), 6) AS efficiency, avg(speed) FILTER (WHERE back <= 5) AS late, avg(speed) FILTER (WHERE back > 5) AS early FROM r WHERE back <= 10 GROUP BY 1) SELECT batch, items_per_minute, efficiency, CASE WHEN late > 1.1::DOUBLE * early THEN 'improving' WHEN late < 0.9::DOUBLE * early THEN 'declining' ELSE 'stable' END AS trend FROM s")
def batch_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Speed, efficiency and trend of the last ten runs of each batch queue."""
    k = F.col("o_orderkey")
    back = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), ((1 + k % 25) / ((10.0 + k % 90) / 60)).alias("speed"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.5).alias("success"), back.alias("back")).filter("back <= 10")
    late, early = F.avg(F.when(F.col("back") <= 5, F.col("speed"))), F.avg(F.when(F.col("back") > 5, F.col("speed")))
    return rows.groupBy("batch").agg(F.round(F.avg("speed"), 6).alias("items_per_minute"), F.round(F.least(F.lit(1.0), F.avg("speed") / 10 * F.avg("success")), 6).alias("efficiency"), chain([(late > 1.1 * early, "improving"), (late < 0.9 * early, "declining")], "stable").alias("trend"))


@register("retention", "SELECT o_orderkey AS task, o_orderstatus = 'O' OR o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 7 DAY AS kept FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'")
def retention(spark: SparkSession, sf: str, days: int = 7) -> DataFrame:
    """Finished tasks are kept for seven days, open ones until they are done."""
    now = F.lit("2000-01-01").cast("timestamp_ntz")
    kept = (F.col("o_orderstatus") == "O") | (F.col("o_orderdate") >= now - F.make_dt_interval(F.lit(days)))
    return read(spark, sf, "orders").filter(F.col("o_orderdate") < now).select(F.col("o_orderkey").alias("task"), kept.alias("kept"))


@register("daily_limit_days", _CALLS + ", t AS (SELECT day, sum(cost) AS cost, count(*) AS calls FROM d GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS days, CAST(count_if(cost >= 0.02) AS BIGINT) AS days_over, round(max(cost), 6) AS highest, round(avg(cost), 6) AS mean FROM t")
def daily_limit_days(spark: SparkSession, sf: str, limit: float = 0.02) -> DataFrame:
    """On how many days the cost limit was reached."""
    per_day = calls(spark, sf).groupBy("day").agg(F.sum("cost").alias("cost"))
    return per_day.agg(F.count("*").alias("days"), F.count_if(F.col("cost") >= limit).alias("days_over"), F.round(F.max("cost"), 6).alias("highest"), F.round(F.avg("cost"), 6).alias("mean"))
