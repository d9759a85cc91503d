"""Row shapes: stored event table, stream rows, and raw records."""

from __future__ import annotations

from pyspark.sql import types as T

_attrs = T.MapType(T.StringType(), T.StringType())

# Envelope columns of the stored event table, in order.
EVENT_SCHEMA = T.StructType([
    T.StructField("event_time", T.TimestampType()),
    T.StructField("ingest_time", T.TimestampType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("chat_id", T.LongType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("attrs", _attrs),
])

# A record as the API takes it; unknown top-level fields are ignored.
RECORD_SCHEMA = T.StructType([
    T.StructField("activityType", T.StringType()),
    T.StructField("eventTime", T.StringType()),
    T.StructField("ingestTime", T.StringType()),
    T.StructField("eventId", T.StringType()),
    T.StructField("attrs", _attrs),
])

# A row on the event topic: times are still text.
STREAM_SCHEMA = T.StructType([
    T.StructField("event_time", T.StringType()),
    T.StructField("ingest_time", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("chat_id", T.LongType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("attrs", _attrs),
])

# Flat events of the older interface, as NDJSON or CSV.
LEGACY_EVENT_SCHEMA = T.StructType([
    T.StructField("eventId", T.StringType()),
    T.StructField("eventType", T.StringType()),
    T.StructField("userId", T.StringType()),
    T.StructField("sessionId", T.StringType()),
    T.StructField("ipAddress", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("index", T.LongType()),
    T.StructField("timestamp", T.StringType()),
])
