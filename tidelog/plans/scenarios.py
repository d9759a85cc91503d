"""Named analytic scenarios and the heavy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.attributes import attribute_equals, attribute_in, attribute_text
from tidelog.operators.aggregate import distinct_count, time_buckets, top_then_chart
from tidelog.operators.filters import first_rows, last_days, time_range

# Id, title and goal of each scenario.
SCENARIOS = (
    ("events_by_type_timeseries", "Events by type over time", "traffic dynamics and rate per event_type"),
    ("top_users_by_volume", "Top users by event volume", "identify heavy activity by users"),
    ("flagged_users_spike", "Users with moderation flags spike",
     "detect users with abnormal moderation_flag density"),
    ("attrs_source_lang_breakdown", "Source/Lang breakdown from attrs", "slice traffic by custom attributes"),
    ("record_type_mix", "Record type mix", "distribution by attrs.recordType enum"),
)


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "id string, title string, goal string")


def top_users(df: DataFrame, limit: int | None) -> DataFrame:
    return first_rows(df.groupBy("user_id", "record_type").agg(F.count("*").alias("events_count")).orderBy(
        F.col("events_count").desc(), "user_id", "record_type"), limit)


def flagged_users(df: DataFrame, limit: int | None, least: int = 3) -> DataFrame:
    """Users with at least ``least`` moderation events and those events' share of all of theirs."""
    per_user = df.groupBy("user_id").agg(
        F.count_if(F.col("record_type") == "MODERATION").alias("flags_count"),
        F.count("*").alias("total_events"),
    ).filter(F.col("flags_count") >= least)
    ratio = F.bround(F.col("flags_count") / F.greatest(F.col("total_events"), F.lit(1)), 4)
    return per_user.withColumn("flags_ratio", ratio).orderBy(
        F.col("flags_count").desc(), F.col("flags_ratio").desc(), "user_id").transform(first_rows, limit)


def source_lang(df: DataFrame, limit: int | None) -> DataFrame:
    return df.groupBy(
        attribute_text(df, "source").alias("source"), attribute_text(df, "lang").alias("lang"),
    ).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "source", "lang").transform(first_rows, limit)


def type_mix(df: DataFrame, limit: int | None) -> DataFrame:
    return df.groupBy("record_type").agg(F.count("*").alias("count")).orderBy(
        F.col("count").desc(), "record_type").transform(first_rows, limit)


_RUNNERS = {
    "top_users_by_volume": top_users,
    "flagged_users_spike": flagged_users,
    "attrs_source_lang_breakdown": source_lang,
    "record_type_mix": type_mix,
}


def scenario(df: DataFrame, name: str | None = None, start=None, end=None, limit: int | None = 500,
             as_of=None) -> DataFrame:
    """Run a scenario on a time range, by default the last 24 hours.

    An unknown name runs the time series.
    """
    window = time_range(df, start, end, hours=24, as_of=as_of)
    runner = _RUNNERS.get((name or "").strip().lower())
    return runner(window, limit) if runner else time_buckets(window, "minute", limit)


# Attributes and organisation hashes the heavy query asks for.
HEAVY_FILTERS = {
    "type": "REGISTRATION",
    "terminal_type": "ONEME",
    "user_active_status": "1",
    "gender": "0",
    "user_device_type": "ANDROID",
}
HEAVY_ORG_HASHES = (
    "-7207924629501764854",
    "-4231934642844376041",
    "1136490941434531770",
    "4369003663347448391",
)


def heavy_registrations(df: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    recent = last_days(df, days, as_of).filter(F.col("record_type") == "SYSTEM")
    for key, value in HEAVY_FILTERS.items():
        recent = recent.filter(attribute_equals(recent, key, value))
    return recent.filter(attribute_in(recent, "org_hash", HEAVY_ORG_HASHES))


def heavy_top_users(df: DataFrame, days: int = 90, as_of=None, top_n: int = 50, limit: int | None = 5000) -> DataFrame:
    """Hourly registrations of the users with most matching registrations."""
    chart = top_then_chart(df, lambda d: heavy_registrations(d, days, as_of), "USER_ID", top_n, "TIMESTAMP", limit)
    return chart.select(F.col("key").alias("user_id"), F.col("chart").alias("ts"), "events")


def heavy_hour_lang(df: DataFrame, days: int = 30, as_of=None, exact: bool = False, limit: int | None = 25000) -> DataFrame:
    recent = last_days(df, days, as_of)
    lang = F.coalesce(F.nullif(attribute_text(recent, "lang"), F.lit("")), F.lit("_"))
    return recent.groupBy(
        "record_type", F.date_trunc("hour", "event_time").alias("hour"), lang.alias("lang"),
    ).agg(
        F.count("*").alias("count"),
        distinct_count(F.col("user_id"), exact).alias("users"),
        F.max(F.octet_length(attribute_text(recent, "payload"))).alias("max_payload"),
    ).orderBy(F.col("count").desc(), "record_type", "hour", "lang").transform(first_rows, limit)


def heavy_user_buckets(df: DataFrame, days: int = 30, as_of=None, buckets: int = 256, limit: int | None = 60000) -> DataFrame:
    recent = last_days(df, days, as_of)
    return recent.groupBy(
        F.pmod("user_id", F.lit(buckets)).alias("bucket"), "record_type", F.to_date("event_time").alias("day"),
    ).agg(
        F.count("*").alias("count"),
        F.avg(F.octet_length(attribute_text(recent, "payload"))).alias("avg_payload"),
    ).orderBy(F.col("count").desc(), "bucket", "record_type", "day").transform(first_rows, limit)


def heavy_two_level(df: DataFrame, days: int = 14, as_of=None, limit: int | None = 100000) -> DataFrame:
    """Events per user and type, summed per type."""
    per_user = last_days(df, days, as_of).groupBy("record_type", "user_id").agg(F.count("*").alias("count"))
    return per_user.groupBy("record_type").agg(F.sum("count").alias("total")).orderBy(
        F.col("total").desc(), "record_type").transform(first_rows, limit)
