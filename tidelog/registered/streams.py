"""Structured Streaming jobs, run to the end of what is there and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import measure
from tidelog.operators.prepare import dedup_stream
from tidelog.registered.base import EVENTS_SQL, RECORDS_SQL, attrs_text, register
from tidelog.session import scratch_path
from tidelog.sources import files
from tidelog.sources.store import EventStore
from tidelog.sources.tables import SOURCE_SCHEMA, adapt, event_table, raw_records, source_events, uuid_of
from tidelog.streaming import ingest


def _topic(spark, sf_dir):
    """The events as message lines; those with k = 23 are cut short, k = 29 have a bad id."""
    events = event_table(spark, sf_dir)
    k = F.unix_timestamp("ingest_time") - F.unix_timestamp("event_time")
    with_ids = events.withColumn(
        "event_id", F.when(k == 29, F.lit("no-uuid")).otherwise(uuid_of(F.col("event_id"))))
    messages = files.to_publish_frame(with_ids)
    cut = F.get_json_object("value", "$.ingest_time").cast("timestamp").cast("bigint") - F.get_json_object(
        "value", "$.event_time").cast("timestamp").cast("bigint") == 23
    path = scratch_path(spark, "topic")
    messages.select(F.when(cut, F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value")).write.text(path)
    return path


def _ingested(spark, sf_dir, shape="rows", source=_topic, **options):
    """The event store after one ingest run."""
    root = scratch_path(spark, "table")
    raw = ingest.read_stream(spark, "text", path=source(spark, sf_dir))
    ingest.finish(ingest.start_ingest(raw, root, scratch_path(spark, "checkpoint"), shape, **options))
    return EventStore(spark, root)


@register("stream_rows_to_table", EVENTS_SQL + """
SELECT printf('00000000-0000-7000-8000-%012x', event_id) AS event_id, event_time, ingest_time, record_type,
  user_id, chat_id, message_id, attrs_text, lang AS attr_lang, CAST(event_time AS DATE) AS event_date
FROM evt WHERE k NOT IN (23, 29)""")
def stream_rows_to_table(spark, sf_dir):
    return _ingested(spark, sf_dir).read().select(
        "event_id", "event_time", "ingest_time", "record_type", "user_id", "chat_id", "message_id",
        attrs_text().alias("attrs_text"), "attr_lang", "event_date")


@register("stream_broken_messages", """
SELECT CASE k WHEN 23 THEN 'broken message' ELSE 'event_id is not a UUID' END AS error,
  CASE k WHEN 23 THEN '{"event_time":"' || strftime(event_time, '%Y-%m-%d %H:%M:%S') || '","ing'
    ELSE user_id || '/' || chat_id || '/' || record_type END AS seen, count(*) AS count
FROM ev WHERE k IN (23, 29) GROUP BY 1, 2""")
def stream_broken_messages(spark, sf_dir):
    # A cut message comes back as it was, one with a bad id as what was read of it.
    parts = [F.get_json_object("value", f"$.{n}") for n in ("user_id", "chat_id", "record_type")]
    seen = F.when(F.col("error") == ingest.BROKEN_MESSAGE, F.col("value")).otherwise(F.concat_ws("/", *parts))
    return _ingested(spark, sf_dir).refused().groupBy("error", seen.alias("seen")).agg(F.count("*").alias("count"))


@register("stream_records_to_table", RECORDS_SQL + """
SELECT CAST(event_time AS DATE) AS event_date, CASE activity WHEN 'REGISTRATION' THEN 'SYSTEM'
    WHEN 'PURCHASE_COMPLETED' THEN 'PURCHASE' WHEN 'MODERATION_FLAG' THEN 'MODERATION' ELSE 'MESSAGE' END
    AS record_type, count(*) AS count FROM checked WHERE error IS NULL GROUP BY 1, 2""")
def stream_records_to_table(spark, sf_dir):
    def lines(spark, sf_dir):
        path = scratch_path(spark, "records")
        raw_records(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
        return path

    table = _ingested(spark, sf_dir, "records", lines).read(["record_type"])
    return table.groupBy("event_date", "record_type").agg(F.count("*").alias("count"))


def _event_stream(spark, sf_dir):
    source_events(spark, sf_dir)  # sets the session's time zone
    # A pattern, since a stream's plain path must be a folder and the table may be one file.
    return adapt(spark.readStream.schema(SOURCE_SCHEMA).parquet(f"{sf_dir}/events[.]parquet"))


@register("stream_publish", """
SELECT event_id, user_id, record_type, event_time, lang FROM ev""")
def stream_publish(spark, sf_dir):
    path = scratch_path(spark, "published")
    ingest.finish([ingest.publish_stream(
        _event_stream(spark, sf_dir), scratch_path(spark, "checkpoint"), "text", {"path": path})])
    rows = ingest.parse(spark.read.text(path))
    return rows.select(F.col("event_id").cast("bigint").alias("event_id"), "user_id", "record_type",
                       F.col("event_time").cast("timestamp").alias("event_time"), F.coalesce(F.col("attrs")["lang"], F.lit("")).alias("lang"))


@register("stream_dedup", """
SELECT user_id, type, date_trunc('day', event_time) AS event_time FROM ev GROUP BY ALL""")
def stream_dedup(spark, sf_dir):
    daily = _event_stream(spark, sf_dir).withColumn("event_time", F.date_trunc("day", "event_time"))
    path = scratch_path(spark, "deduplicated")
    ingest.finish([ingest.write_stream(
        dedup_stream(daily, "40 days"), path, scratch_path(spark, "checkpoint"))])
    return spark.read.parquet(path).select("user_id", F.col("attrs")["type"].alias("type"), "event_time")


def _closed_stream(spark, sf_dir):
    """The events as a stream that one row a day later ends, so that the watermark passes every window of theirs."""
    events = event_table(spark, sf_dir).select("ingest_time", "record_type")
    last = events.agg((F.max("ingest_time") + F.expr("INTERVAL 1 DAY")).alias("ingest_time"), F.lit("END").alias("record_type"))
    path = scratch_path(spark, "closed")
    events.unionByName(last).write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


def _closed_windows(spark, rates):
    path = scratch_path(spark, "rates")
    ingest.finish([ingest.write_stream(rates, path, scratch_path(spark, "checkpoint"))])
    return spark.read.parquet(path)


@register("stream_rate_by_type", """
SELECT date_trunc('minute', ingest_time) AS window_start, record_type, count(*) AS count,
  count(*) / 60.0::DOUBLE AS rate FROM ev GROUP BY 1, 2""")
def stream_rate_by_type(spark, sf_dir):
    return _closed_windows(spark, measure.ingest_rate(_closed_stream(spark, sf_dir), by="record_type", watermark="0 seconds"))


@register("stream_increase", """
SELECT minute - to_minutes(back) AS window_start, record_type, CAST(sum(n) AS BIGINT) AS count
FROM (SELECT date_trunc('minute', ingest_time) AS minute, record_type, count(*) AS n FROM ev GROUP BY 1, 2),
  (SELECT unnest([0, 1, 2, 3, 4]) AS back)
GROUP BY 1, 2""")
def stream_increase(spark, sf_dir):
    return _closed_windows(spark, measure.increase(_closed_stream(spark, sf_dir), watermark="0 seconds"))


@register("stream_trend", """
SELECT minute AS window_start, count, CAST(sum(count) OVER (ORDER BY minute) AS BIGINT) AS total
FROM (SELECT date_trunc('minute', ingest_time) AS minute, count(*) AS count FROM ev GROUP BY 1)""")
def stream_trend(spark, sf_dir):
    path = scratch_path(spark, "trend")
    ingest.finish([measure.trend_stream(_event_stream(spark, sf_dir), path, scratch_path(spark, "checkpoint"))])
    return measure.read_trend(spark, path)
