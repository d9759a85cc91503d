"""Grouped counts of the event table.

All are hash aggregations with map-side partial results, so a user, source or
type that holds much of the table adds one partial row per task, no more.
Orders end in every group key, which makes the limited results repeatable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.attributes import attribute_equals, attribute_text, lookup_attribute
from tidelog.functions.json_text import check_name
from tidelog.functions.records import normalize_record_type
from tidelog.functions.text import is_blank
from tidelog.functions.times import bucket_start
from tidelog.operators.filters import first_rows, last_days, time_range

# Most ranked keys that are broadcast.
BROADCAST_KEYS = 100_000


def time_buckets(df: DataFrame, interval: str | None = "minute", limit: int | None = None,
                 per_second: bool = False) -> DataFrame:
    """Events per time bucket and record type; ``rate`` is always count / 60."""
    counts = df.groupBy(bucket_start(F.col("event_time"), interval).alias("bucket"), "record_type").agg(
        F.count("*").alias("count"))
    out = counts.withColumn("rate", F.col("count") / F.lit(60.0))
    if per_second:
        seconds = {"second": 1, "hour": 3600, "day": 86400}.get((interval or "").strip().lower(), 60)
        out = out.withColumn("rate_per_sec", F.col("count") / F.lit(float(seconds)))
    if limit is None:
        return out
    return out.orderBy(F.col("bucket").desc(), F.col("count").desc(), "record_type").limit(limit)


def analytics(df: DataFrame, start=None, end=None, interval: str = "minute", limit: int | None = 1000,
              as_of=None, per_second: bool = False) -> DataFrame:
    """Newest time buckets of the range, by default of the last hour."""
    return time_buckets(time_range(df, start, end, hours=1, as_of=as_of), interval,
                        limit, per_second)


def recent_buckets(df: DataFrame, days: int, interval: str, limit: int | None, as_of=None) -> DataFrame:
    """Counts by record type and hour or minute of the last days, newest first."""
    recent = last_days(df, days, as_of)
    counts = recent.groupBy("record_type", bucket_start(F.col("event_time"), interval).alias("bucket")).agg(
        F.count("*").alias("count"))
    return counts.orderBy(F.col("bucket").desc(), "record_type").transform(first_rows, limit)


def group_attr(df: DataFrame, key: str, hot: bool = False) -> DataFrame:
    """Count per value of an attribute, from the map or from its stored column."""
    value = attribute_text(df, check_name(key)) if hot else lookup_attribute(check_name(key))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("count"))


def distinct_count(column: Column, exact: bool) -> Column:
    return F.count_distinct(column) if exact else F.approx_count_distinct(column)


def attr_users(df: DataFrame, lang: str, exact: bool = False) -> DataFrame:
    """Events and users of one language."""
    value = attribute_text(df, "lang")
    return df.filter(attribute_equals(df, "lang", lang)).groupBy(value.alias("lang")).agg(
        F.count("*").alias("count"), distinct_count(F.col("user_id"), exact).alias("users"))


def top_values(df: DataFrame, column: str, n: int = 1) -> DataFrame:
    """Most frequent values of a column."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(
        F.col("count").desc(), F.col(column)).limit(n)


def grouping_key(df: DataFrame, name: str) -> Column:
    """What a request groups by: TIMESTAMP is the hour, USER_ID the column, else an attribute."""
    upper = name.strip().upper()
    if upper == "TIMESTAMP":
        return bucket_start(F.col("event_time"), "hour")
    if upper == "USER_ID":
        return F.col("user_id")
    return attribute_text(df, check_name(name.strip()))


def group_by_attribute(df: DataFrame, name: str, count_only: bool = True) -> DataFrame:
    aggregates = [F.count("*").alias("count")]
    if not count_only:
        aggregates += [F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time")]
    return df.groupBy(grouping_key(df, name).alias("key")).agg(*aggregates)


def top_then_chart(df: DataFrame, select: Callable[[DataFrame], DataFrame] = lambda d: d,
                   top_by: str = "USER_ID", top_n: int | None = 50, chart_by: str = "TIMESTAMP",
                   limit: int | None = 5000) -> DataFrame:
    """The ``top_n`` most frequent keys of the selected events, charted by a second key.

    The table is read once: counts per (key, chart value) feed both the ranking
    and the chart, and Spark reuses their shuffle. That is also why the ranking
    is joined rather than used as a semi-join, which Spark would push below the
    count and so scan the table again. The ranking has at most ``top_n``
    distinct keys; up to ``BROADCAST_KEYS`` they are broadcast, beyond Spark chooses.
    """
    key = grouping_key(df, top_by)
    cells = select(df).filter(key.isNotNull()).groupBy(
        key.alias("key"), grouping_key(df, chart_by).alias("chart"),
    ).agg(F.count("*").alias("events"))
    ranking = cells.groupBy("key").agg(F.sum("events").alias("total"))
    top = first_rows(ranking.orderBy(F.col("total").desc(), "key"), top_n).select("key")
    if top_n is not None and top_n <= BROADCAST_KEYS:
        top = F.broadcast(top)
    return first_rows(cells.join(top, "key").orderBy(F.col("events").desc(), "key", "chart"), limit)


def purchase_totals(df: DataFrame, kind: str = "event_type", amount: str = "amount") -> DataFrame:
    """Sum and count of non-negative purchase amounts; amounts that are no number are skipped."""
    number = F.col(amount).try_cast("double")
    return df.filter((F.lower(F.col(kind)) == "purchase") & (number >= 0)).agg(
        F.coalesce(F.sum(number), F.lit(0.0)).alias("amount"), F.count("*").alias("count"))


def business_counts(df: DataFrame) -> DataFrame:
    """Accepted events by event type and record type."""
    event_type = F.when(is_blank(F.col("event_type")), "unknown").otherwise(F.col("event_type"))
    return df.groupBy(
        event_type.alias("event_type"), normalize_record_type(F.col("record_type")).alias("record_type"),
    ).agg(F.count("*").alias("count"))


# Payload fields that do not count as custom.
ENVELOPE_FIELDS = ("eventId", "eventType", "userId", "timestamp", "recordType")


def custom_fields(payload: Column) -> Column:
    """Number of top-level JSON fields beyond the envelope."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    return F.size(F.array_except(keys, F.array(*[F.lit(f) for f in ENVELOPE_FIELDS])))


def attr_count_report(df: DataFrame) -> DataFrame:
    """Per record type: events, share of all events, and attributes per event."""
    per_type = df.groupBy("record_type").agg(
        F.count("*").alias("count"),
        F.avg(F.size("attrs")).alias("avg_attrs"),
        F.min(F.size("attrs")).alias("min_attrs"),
        F.max(F.size("attrs")).alias("max_attrs"),
    )
    return with_share(per_type, "share_pct", 100.0)


def with_share(counts: DataFrame, name: str, scale: float = 1.0) -> DataFrame:
    """Add each row's share of the total; for a finished count with a row per record type."""
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn(name, F.col("count") * scale / total)
