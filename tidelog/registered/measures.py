"""Ingest rates, shares, error rates and latency summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import measure, validate
from tidelog.registered.base import RECORDS_SQL, register
from tidelog.sources.tables import event_table, raw_records, source_events


@register("ingest_rate", """
SELECT date_trunc('minute', ingest_time) AS window_start, count(*) AS count, count(*) / 60.0::DOUBLE AS rate
FROM ev GROUP BY 1""")
def ingest_rate(spark, sf_dir):
    return measure.ingest_rate(event_table(spark, sf_dir))


@register("ingest_rate_by_type", """
SELECT date_trunc('minute', ingest_time) AS window_start, record_type, count(*) AS count,
  count(*) / 60.0::DOUBLE AS rate FROM ev GROUP BY 1, 2""")
def ingest_rate_by_type(spark, sf_dir):
    return measure.ingest_rate(event_table(spark, sf_dir), by="record_type")


@register("ingest_increase", """
SELECT minute - to_minutes(back) AS window_start, record_type, CAST(sum(n) AS BIGINT) AS count
FROM (SELECT date_trunc('minute', ingest_time) AS minute, record_type, count(*) AS n FROM ev GROUP BY 1, 2),
  (SELECT unnest([0, 1, 2, 3, 4]) AS back)
GROUP BY 1, 2""")
def ingest_increase(spark, sf_dir):
    return measure.increase(event_table(spark, sf_dir))


@register("ingest_trend", """
SELECT minute AS window_start, count, CAST(sum(count) OVER (ORDER BY minute) AS BIGINT) AS total
FROM (SELECT date_trunc('minute', ingest_time) AS minute, count(*) AS count FROM ev GROUP BY 1)""")
def ingest_trend(spark, sf_dir):
    return measure.trend(event_table(spark, sf_dir))


@register("type_share", """
SELECT date_trunc('minute', ingest_time) AS window_start, record_type, count(*) AS count,
  count(*) / CAST(sum(count(*)) OVER (PARTITION BY date_trunc('minute', ingest_time)) AS DOUBLE) AS share
FROM ev GROUP BY 1, 2""")
def type_share(spark, sf_dir):
    return measure.type_share(event_table(spark, sf_dir))


@register("write_error_rate", RECORDS_SQL + """
SELECT date_trunc('hour', event_time) AS window_start, count(error) AS failed, count(*) AS count,
  (count(error) / 3600.0::DOUBLE) / greatest(count(*) / 3600.0::DOUBLE, 1e-9) AS error_rate
FROM checked GROUP BY 1""")
def write_error_rate(spark, sf_dir):
    checked = validate.validate(raw_records(spark, sf_dir))
    return measure.error_rate(checked.withColumn("ingest_time", F.col("ingestTime").cast("timestamp")), "1 hour")


def _latency_sql(source: str, group: str, rule: str, digits: bool = True) -> str:
    def rank(p):
        if rule == "floor":
            return f"CAST(least(greatest(floor(n * {p} / 100.0::DOUBLE), 0), n - 1) AS BIGINT)"
        return f"CAST(round_even({p} / 100.0::DOUBLE * (n - 1), 0) AS BIGINT)"

    picks = ", ".join(f"round_even(vs[{rank(p)} + 1], 2) AS p{p}_ms" if digits else f"vs[{rank(p)} + 1] AS p{p}_ms"
                      for p in (50, 95, 99))
    keys = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""
WITH m AS ({source}), g AS (
  SELECT {keys}count(*) AS n, list(v ORDER BY v) AS vs, sum(CAST(v AS DECIMAL(30, 6))) AS s FROM m {by})
SELECT {keys}n AS count, round_even(CAST(s AS DOUBLE) / n, 2) AS avg_ms, {picks} FROM g"""


@register("latency_by_kind", _latency_sql("SELECT event_type, value AS v FROM events", "event_type", "floor"))
def latency_by_kind(spark, sf_dir):
    return measure.latency_summary(source_events(spark, sf_dir), "event_type", "value")


@register("latency_by_kind_rounded", _latency_sql("SELECT event_type, value AS v FROM events", "event_type", "round"))
def latency_by_kind_rounded(spark, sf_dir):
    return measure.latency_summary(source_events(spark, sf_dir), "event_type", "value", rule="round")


@register("latency_overall", _latency_sql("SELECT value AS v FROM events", "", "floor"))
def latency_overall(spark, sf_dir):
    return measure.latency_summary(source_events(spark, sf_dir), value="value")


@register("latency_line_items", _latency_sql(
    "SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem", "l_returnflag", "floor"))
def latency_line_items(spark, sf_dir):
    # A few huge groups of mostly different values.
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    return measure.latency_summary(items, "l_returnflag", "v")


@register("stage_summary", """
WITH m AS (SELECT event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 <> 0 AS ok, value AS v, ts
  FROM events), g AS (
  SELECT stage, count(*) AS n, count(*) FILTER (ok) AS good, list(v ORDER BY v) AS vs,
    greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 1e-9) AS elapsed FROM m GROUP BY stage)
SELECT stage, n AS attempted, good AS ok, n - good AS fail, elapsed AS elapsed_sec, good / elapsed AS throughput,
  good / n::DOUBLE AS success_rate, vs[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1] AS p50_ms,
  vs[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS p95_ms,
  vs[CAST(round_even(0.99 * (n - 1), 0) AS BIGINT) + 1] AS p99_ms FROM g""")
def stage_summary(spark, sf_dir):
    runs = source_events(spark, sf_dir).select(
        F.col("event_type").alias("stage"),
        (F.get_json_object("props", "$.k").cast("bigint") % 10 != 0).alias("ok"),
        F.col("value").alias("latency_ms"), F.col("ts").cast("timestamp").alias("at"))
    return measure.stage_summary(runs)


@register("compare_variants", """
WITH m AS (SELECT event_type AS query, CASE WHEN user_id % 2 = 0 THEN 'map' ELSE 'hot' END AS variant, value AS v
  FROM events), g AS (
  SELECT query, variant, count(*) AS n, list(v ORDER BY v) AS vs, sum(CAST(v AS DECIMAL(30, 6))) AS s
  FROM m GROUP BY ALL), p AS (
  SELECT query, variant, round_even(CAST(s AS DOUBLE) / n, 2) AS a,
    round_even(vs[CAST(floor(n * 50 / 100.0::DOUBLE) AS BIGINT) + 1], 2) AS b,
    round_even(vs[CAST(floor(n * 95 / 100.0::DOUBLE) AS BIGINT) + 1], 2) AS c FROM g)
SELECT query, max(a) FILTER (variant = 'map') AS map_avg_ms, max(b) FILTER (variant = 'map') AS map_p50_ms,
  max(c) FILTER (variant = 'map') AS map_p95_ms, max(a) FILTER (variant = 'hot') AS hot_avg_ms,
  max(b) FILTER (variant = 'hot') AS hot_p50_ms, max(c) FILTER (variant = 'hot') AS hot_p95_ms FROM p GROUP BY query""")
def compare_variants(spark, sf_dir):
    runs = source_events(spark, sf_dir).select(
        F.col("event_type").alias("query"),
        F.when(F.col("user_id") % 2 == 0, "map").otherwise("hot").alias("variant"),
        F.col("value").alias("latency_ms"))
    return measure.compare_variants(runs, ["map", "hot"])


@register("payload_stats", """
WITH m AS (
  SELECT unnest([strlen(p), 1 + CAST(event_type = 'click' AS INTEGER)]) AS v,
    unnest(['payload_bytes', 'custom_fields']) AS metric
  FROM (SELECT event_type, '{"eventId":"' || event_id || '","eventType":"' || event_type || '","userId":"' || user_id
    || '","props":' || '"x"' || CASE WHEN event_type = 'click' THEN ',"value":"' || user_id || '"' ELSE '' END || '}' AS p
    FROM events)), g AS (
  SELECT metric, count(*) AS n, min(v) AS lo, avg(v) AS mean, max(v) AS hi, list(v ORDER BY v) AS vs FROM m GROUP BY metric)
SELECT metric, n AS count, lo AS min_value, mean AS avg_value, hi AS max_value,
  vs[CAST(floor(n * 50 / 100.0::DOUBLE) AS BIGINT) + 1] AS p50, vs[CAST(floor(n * 95 / 100.0::DOUBLE) AS BIGINT) + 1] AS p95
FROM g""")
def payload_stats(spark, sf_dir):
    source = source_events(spark, sf_dir)
    uid = F.col("user_id").cast("string")
    message = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("eventId"), F.col("event_type").alias("eventType"),
        uid.alias("userId"), F.lit("x").alias("props"), F.when(F.col("event_type") == "click", uid).alias("value")))
    return measure.payload_stats(source.select(message.alias("message")))
