"""Records to stored rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.catalogue import SERVICE, SIMULATOR, Catalogue
from tidelog.functions.attributes import normalize_attrs
from tidelog.functions.identifiers import ensure_event_id
from tidelog.functions.numbers import long_or_zero
from tidelog.functions.records import (
    coarse_record_type, normalize_record_type, parse_activity_type, record_type_of,
)
from tidelog.functions.text import is_blank
from tidelog.functions.times import as_instant, parse_timestamp, to_second


def _instant(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return column if df.schema[name].dataType.typeName() != "string" else parse_timestamp(column)


def with_type_entry(attrs: Column, activity: Column) -> Column:
    """``attrs`` with ``type`` added when absent and the activity is known."""
    missing = activity.isNotNull() & ~F.coalesce(F.map_contains_key(attrs, "type"), F.lit(False))
    return F.when(missing, F.map_concat(attrs, F.create_map(F.lit("type"), activity))).otherwise(attrs)


def to_event_rows(records: DataFrame, as_of=None, catalogue: Catalogue = SERVICE,
                  canonical_flags: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records as rows of the event table.

    Missing times become ``as_of``; ids missing from the attributes become 0;
    an event id that is no UUID is replaced. ``canonical_flags`` also rewrites
    true/false of flag attributes to '1'/'0'. ``keep`` names columns to pass on.
    """
    now = as_instant(as_of)
    empty = F.create_map().cast("map<string,string>")
    attrs = normalize_attrs(F.coalesce(F.col("attrs"), empty))
    if canonical_flags:
        flags = [n for n, a in catalogue.attributes.items() if a.kind == "flag"]
        attrs = F.transform_values(attrs, lambda k, v: F.when(
            k.isin(*flags), F.when(F.lower(v) == "true", "1").when(F.lower(v) == "false", "0").otherwise(v),
        ).otherwise(v))
    staged = records.select(
        to_second(F.coalesce(_instant(records, "eventTime"), now)).alias("event_time"),
        to_second(F.coalesce(_instant(records, "ingestTime"), now)).alias("ingest_time"),
        parse_activity_type(F.col("activityType"), catalogue).alias("_activity"),
        F.col("eventId").alias("_id"),
        attrs.alias("attrs"),
        *keep,
    )
    known = F.coalesce(F.col("_activity"), parse_activity_type(F.col("attrs")["type"], catalogue))
    typed = staged.withColumns({
        "attrs": with_type_entry(F.col("attrs"), F.col("_activity")), "_known": known})
    return typed.select(
        "event_time",
        "ingest_time",
        record_type_of(F.col("_known"), catalogue).alias("record_type"),
        ensure_event_id(F.col("_id"), F.col("event_time")).alias("event_id"),
        long_or_zero(F.col("attrs")["user_id"]).alias("user_id"),
        long_or_zero(F.col("attrs")["chat_id"]).alias("chat_id"),
        long_or_zero(F.col("attrs")["message_id"]).alias("message_id"),
        "attrs",
        *keep,
    )


def to_records(events: DataFrame, catalogue: Catalogue = SERVICE) -> DataFrame:
    """Stored rows as records: user_id back among the attributes, activity from ``attrs.type``."""
    attrs = normalize_attrs(F.col("attrs"))
    staged = events.withColumn("attrs", attrs)
    restore = (F.col("user_id") != 0) & ~F.map_contains_key("attrs", "user_id")
    full = F.when(restore, F.map_concat("attrs", F.create_map(F.lit("user_id"), F.col("user_id").cast("string")))) \
        .otherwise(F.col("attrs"))
    return staged.select(
        parse_activity_type(F.col("attrs")["type"], catalogue).alias("activityType"),
        F.col("event_time").alias("eventTime"),
        F.col("ingest_time").alias("ingestTime"),
        F.col("event_id").cast("string").alias("eventId"),
        F.when(F.size(full) > 0, full).alias("attrs"),
    )


def normalize_envelope(df: DataFrame, as_of=None) -> DataFrame:
    """Older flat events with the blanks of their envelope filled in."""
    now = as_instant(as_of)

    def default(name: str, value: Column) -> Column:
        text = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        return F.when(is_blank(text), value).otherwise(text)

    record_type = F.col("recordType") if "recordType" in df.columns else F.lit(None).cast("string")
    return df.withColumns({
        "eventId": default("eventId", F.expr("uuid()")),
        "eventType": default("eventType", F.lit("unknown")),
        "userId": default("userId", F.lit("anonymous")),
        "timestamp": default("timestamp", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        "recordType": normalize_record_type(record_type),
    })


# Simulator attributes that become fields of their own in an API row.
PROMOTED = ("timestamp", "user_id", "chat_id", "message_id")


def sim_to_api(df: DataFrame, catalogue: Catalogue = SIMULATOR) -> DataFrame:
    """Simulator records (one ``attrs`` map with everything in it) as API rows."""
    attrs = F.col("attrs")
    seconds = F.floor(long_or_zero(attrs["timestamp"]) / 1000).cast("bigint")
    return df.select(
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        coarse_record_type(attrs["type"], attrs, catalogue).alias("recordType"),
        long_or_zero(attrs["user_id"]).alias("userId"),
        long_or_zero(attrs["chat_id"]).alias("chatId"),
        long_or_zero(attrs["message_id"]).alias("messageId"),
        F.map_filter(attrs, lambda k, v: ~k.isin(*PROMOTED)).alias("attrs"),
    )
