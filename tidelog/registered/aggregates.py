"""Time buckets, scenarios, heavy queries and other grouped counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import aggregate, sketches
from tidelog.plans import scenarios
from tidelog.registered.base import AS_OF, FROM, ORACLES, TO, register
from tidelog.session import scratch_path
from tidelog.sources.layout import HotColumn, add_hot_columns, write_events
from tidelog.sources.tables import event_table, source_events

_IN_RANGE = "event_time >= TIMESTAMP '2024-01-01 00:00:00' AND event_time <= TIMESTAMP '2024-01-31 00:00:00'"
# Attributes that a table made for the heavy query stores as columns.
HEAVY_HOT = ("type", "terminal_type", "user_active_status", "gender", "user_device_type", "org_hash")


def _buckets(unit: str, limit: int, where: str = _IN_RANGE) -> str:
    return f"""
SELECT date_trunc('{unit}', event_time) AS bucket, record_type, count(*) AS count, count(*) / 60.0::DOUBLE AS rate
FROM ev WHERE {where} GROUP BY ALL ORDER BY bucket DESC, count DESC, record_type LIMIT {limit}"""


@register("analytics_minute", _buckets("minute", 1000))
def analytics_minute(spark, sf_dir):
    return aggregate.analytics(event_table(spark, sf_dir), FROM, TO)


@register("analytics_hour", _buckets("hour", 100_000))
def analytics_hour(spark, sf_dir):
    return aggregate.analytics(event_table(spark, sf_dir), FROM, TO, "HOUR", 100_000)


@register("analytics_second", _buckets("second", 300))
def analytics_second(spark, sf_dir):
    return aggregate.analytics(event_table(spark, sf_dir), FROM, TO, "second", 300)


@register("analytics_per_second_rate", """
SELECT date_trunc('hour', event_time) AS bucket, record_type, count(*) AS count, count(*) / 60.0::DOUBLE AS rate,
  count(*) / 3600.0::DOUBLE AS rate_per_sec FROM ev GROUP BY ALL""")
def analytics_per_second_rate(spark, sf_dir):
    return aggregate.time_buckets(event_table(spark, sf_dir), "hour", per_second=True)


@register("events_by_type_timeseries", _buckets("minute", 5000))
def events_by_type_timeseries(spark, sf_dir):
    return scenarios.scenario(event_table(spark, sf_dir), "no such scenario", FROM, TO, 5000)


@register("top_users_by_volume", f"""
SELECT user_id, record_type, count(*) AS events_count FROM ev WHERE {_IN_RANGE}
GROUP BY ALL ORDER BY events_count DESC, user_id, record_type LIMIT 500""")
def top_users_by_volume(spark, sf_dir):
    return scenarios.scenario(event_table(spark, sf_dir), " Top_Users_By_Volume ", FROM, TO)


@register("flagged_users_spike", f"""
SELECT user_id, flags_count, total_events, round_even(flags_count / greatest(total_events, 1), 4) AS flags_ratio
FROM (SELECT user_id, count(*) FILTER (record_type = 'MODERATION') AS flags_count, count(*) AS total_events
  FROM ev WHERE {_IN_RANGE} GROUP BY user_id)
WHERE flags_count >= 3 ORDER BY flags_count DESC, flags_ratio DESC, user_id LIMIT 500""")
def flagged_users_spike(spark, sf_dir):
    return scenarios.scenario(event_table(spark, sf_dir), "flagged_users_spike", FROM, TO)


@register("attrs_source_lang_breakdown", f"""
SELECT source, lang, count(*) AS count FROM ev WHERE {_IN_RANGE}
GROUP BY ALL ORDER BY count DESC, source, lang LIMIT 500""")
def attrs_source_lang_breakdown(spark, sf_dir):
    return scenarios.scenario(event_table(spark, sf_dir), "attrs_source_lang_breakdown", FROM, TO)


@register("documents_source_lang", """
SELECT source, lang, count(*) AS count FROM documents
GROUP BY ALL ORDER BY count DESC, source, lang LIMIT 5000""", events=False)
def documents_source_lang(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("attrs"))
    return scenarios.source_lang(documents, 5000)


@register("record_type_mix", f"""
SELECT record_type, count(*) AS count FROM ev WHERE {_IN_RANGE}
GROUP BY record_type ORDER BY count DESC, record_type LIMIT 500""")
def record_type_mix(spark, sf_dir):
    return scenarios.scenario(event_table(spark, sf_dir), "record_type_mix", FROM, TO)


@register("recent_hours_by_type", """
SELECT record_type, date_trunc('hour', event_time) AS bucket, count(*) AS count FROM ev
WHERE event_time >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY ALL ORDER BY bucket DESC, record_type LIMIT 40""")
def recent_hours_by_type(spark, sf_dir):
    return aggregate.recent_buckets(event_table(spark, sf_dir), 2, "hour", 40, AS_OF)


@register("recent_minutes_by_type", """
SELECT record_type, date_trunc('minute', event_time) AS bucket, count(*) AS count FROM ev
WHERE event_time >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY ALL ORDER BY bucket DESC, record_type LIMIT 50""")
def recent_minutes_by_type(spark, sf_dir):
    return aggregate.recent_buckets(event_table(spark, sf_dir), 1, "minute", 50, AS_OF)


@register("heavy_top_users", """
, filtered AS (
  SELECT user_id, event_time FROM ev WHERE record_type = 'SYSTEM' AND type = 'REGISTRATION'
  AND terminal_type = 'ONEME' AND user_active_status = '1' AND gender = '0' AND user_device_type = 'ANDROID'
  AND org_hash IN ('-7207924629501764854', '-4231934642844376041', '1136490941434531770', '4369003663347448391')
  AND event_time >= TIMESTAMP '2023-11-02 00:00:00'),
top_users AS (SELECT user_id FROM filtered GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 50)
SELECT user_id, date_trunc('hour', event_time) AS ts, count(*) AS events FROM filtered
WHERE user_id IN (SELECT user_id FROM top_users) GROUP BY ALL ORDER BY events DESC, user_id, ts LIMIT 5000""")
def heavy_top_users(spark, sf_dir):
    return scenarios.heavy_top_users(event_table(spark, sf_dir, HEAVY_HOT), as_of=AS_OF)


@register("top_langs_by_source", """
, top AS (SELECT lang FROM ev GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 4)
SELECT lang AS key, source AS chart, count(*) AS events FROM ev WHERE lang IN (SELECT lang FROM top)
GROUP BY ALL ORDER BY events DESC, key, chart LIMIT 5000""")
def top_langs_by_source(spark, sf_dir):
    return aggregate.top_then_chart(event_table(spark, sf_dir), top_by="LANG", top_n=4, chart_by="source")


@register("heavy_hour_lang", """
SELECT record_type, date_trunc('hour', event_time) AS hour, coalesce(nullif(lang, ''), '_') AS lang,
  count(*) AS count, count(DISTINCT user_id) AS users, CAST(max(strlen(payload)) AS BIGINT) AS max_payload
FROM ev WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00'
GROUP BY ALL ORDER BY count DESC, 1, 2, 3 LIMIT 25000""")
def heavy_hour_lang(spark, sf_dir):
    out = scenarios.heavy_hour_lang(event_table(spark, sf_dir), as_of=AS_OF, exact=True)
    return out.withColumn("max_payload", F.col("max_payload").cast("bigint"))


@register("heavy_user_buckets", """
SELECT user_id % 256 AS bucket, record_type, CAST(event_time AS DATE) AS day, count(*) AS count,
  avg(strlen(payload)) AS avg_payload FROM ev WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00'
GROUP BY ALL ORDER BY count DESC, 1, 2, 3 LIMIT 60000""")
def heavy_user_buckets(spark, sf_dir):
    return scenarios.heavy_user_buckets(event_table(spark, sf_dir), as_of=AS_OF)


@register("heavy_two_level", """
SELECT record_type, CAST(sum(count) AS BIGINT) AS total FROM (
  SELECT record_type, user_id, count(*) AS count FROM ev
  WHERE event_time >= TIMESTAMP '2024-01-17 00:00:00' GROUP BY ALL)
GROUP BY record_type ORDER BY total DESC, record_type LIMIT 100000""")
def heavy_two_level(spark, sf_dir):
    return scenarios.heavy_two_level(event_table(spark, sf_dir), as_of=AS_OF)


@register("group_lang_map", "SELECT lang AS value, count(*) AS count FROM ev GROUP BY lang")
def group_lang_map(spark, sf_dir):
    return aggregate.group_attr(event_table(spark, sf_dir), "lang")


@register("group_lang_hot", "SELECT lang AS value, count(*) AS count FROM ev GROUP BY lang")
def group_lang_hot(spark, sf_dir):
    return aggregate.group_attr(event_table(spark, sf_dir, ("lang",)), "lang", hot=True)


@register("lang_users", """
SELECT lang, count(*) AS count, count(DISTINCT user_id) AS users FROM ev WHERE lang = 'ru' GROUP BY lang""")
def lang_users(spark, sf_dir):
    return aggregate.attr_users(event_table(spark, sf_dir, ("lang",)), "ru", exact=True)


@register("top_chat", """
SELECT chat_id, count(*) AS count FROM ev GROUP BY chat_id ORDER BY count DESC, chat_id LIMIT 1""")
def top_chat(spark, sf_dir):
    return aggregate.top_values(event_table(spark, sf_dir), "chat_id")


@register("heavy_top_users_stored", ORACLES["heavy_top_users"])
def heavy_top_users_stored(spark, sf_dir):
    """On a stored copy, sorted by type, with the asked attributes as columns."""
    path = scratch_path(spark, "heavy")
    hot = tuple(HotColumn("attr_" + k, k) for k in HEAVY_HOT)
    write_events(event_table(spark, sf_dir), path, "by_type", hot=hot)
    return scenarios.heavy_top_users(spark.read.parquet(path), as_of=AS_OF)


@register("top_users_sketched", """
SELECT user_id, count(*) AS count FROM ev GROUP BY user_id ORDER BY count DESC, user_id LIMIT 25""")
def top_users_sketched(spark, sf_dir):
    """From stored sketches per day."""
    events, path = event_table(spark, sf_dir), scratch_path(spark, "frequent")
    sketches.frequent_rollup(events, "user_id").write.partitionBy("event_date").parquet(path)
    return sketches.heavy_hitters(events, "user_id", 25, spark.read.parquet(path))


@register("top_parts_sketched", """
SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY l_partkey ORDER BY count DESC, l_partkey LIMIT 40""", events=False)
def top_parts_sketched(spark, sf_dir):
    """Many values of about the same frequency: the sketch proves nothing, all are counted."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return sketches.heavy_hitters(items, "l_partkey", 40, tracked=500)


_ROLLED = """
, wanted AS (SELECT * FROM ev WHERE {where})
SELECT lang, count(*) AS count, count(DISTINCT user_id) AS exact_users, true AS close FROM wanted GROUP BY lang"""


def _rolled(spark, sf_dir, start, end):
    """Users per language of a range from the stored hourly rollup, next to the exact number."""
    events, path = event_table(spark, sf_dir), scratch_path(spark, "rollup")
    lang = {"lang": F.coalesce(F.col("attrs")["lang"], F.lit(""))}
    sketches.user_rollup(events, lang).write.partitionBy("event_date").parquet(path)
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    rolled = sketches.users_in_range(spark.read.parquet(path), low, high, ["lang"], events, lang)
    exact = events.filter((F.col("event_time") >= low) & (F.col("event_time") < high)).groupBy(lang["lang"].alias("lang")).agg(
        F.count_distinct("user_id").alias("exact_users"))
    off = F.abs(F.col("users") - F.col("exact_users"))
    return rolled.join(exact, "lang").select(
        "lang", "count", "exact_users", (off <= F.greatest(F.lit(1.0), 4 * sketches.STANDARD_ERROR * F.col("exact_users"))).alias("close"))


@register("rollup_users_days", _ROLLED.format(where="event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-20'"))
def rollup_users_days(spark, sf_dir):
    return _rolled(spark, sf_dir, "2024-01-05", "2024-01-20")


@register("rollup_users_cut_hours", _ROLLED.format(
    where="event_time >= TIMESTAMP '2024-01-03 10:20:30' AND event_time < TIMESTAMP '2024-01-28 07:45:01'"))
def rollup_users_cut_hours(spark, sf_dir):
    return _rolled(spark, sf_dir, "2024-01-03 10:20:30", "2024-01-28 07:45:01")


@register("group_by_hour_attribute", """
SELECT date_trunc('hour', event_time) AS key, count(*) AS count FROM ev GROUP BY key""")
def group_by_hour_attribute(spark, sf_dir):
    return aggregate.group_by_attribute(event_table(spark, sf_dir), "TIMESTAMP")


@register("group_by_score_attribute", """
SELECT moderation_score AS key, count(*) AS count, min(event_time) AS first_time, max(event_time) AS last_time
FROM ev GROUP BY key""")
def group_by_score_attribute(spark, sf_dir):
    return aggregate.group_by_attribute(event_table(spark, sf_dir), "Moderation_Score", count_only=False)


@register("purchase_totals", """
SELECT CAST(sum(CASE WHEN k % 10 <> 3 THEN cents END) AS BIGINT) AS cents,
  count(CASE WHEN k % 10 <> 3 THEN cents END) AS count
FROM (SELECT k, CAST(round_even(value * 100, 0) AS BIGINT) AS cents FROM src WHERE event_type = 'purchase' AND k % 7 <> 0)
""")
def purchase_totals(spark, sf_dir):
    # Amounts as text: whole cents, some of them negative or no number.
    source = source_events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    cents = F.bround(F.col("value") * 100).cast("bigint").cast("string")
    events = source.select(
        F.initcap("event_type").alias("event_type"),
        F.when(k % 7 == 0, "n/a").when(k % 10 == 3, F.concat(F.lit("-1"), cents)).otherwise(cents).alias("amount"))
    return aggregate.purchase_totals(events).select(F.col("amount").cast("bigint").alias("cents"), "count")


@register("business_counts", """
SELECT CASE WHEN k % 11 = 0 THEN 'unknown' ELSE event_type END AS event_type,
  CASE WHEN k % 5 = 1 OR event_type = 'signup' THEN 'SYSTEM' WHEN event_type = 'purchase' THEN 'PURCHASE' ELSE 'OTHER' END AS record_type,
  count(*) AS count FROM src GROUP BY 1, 2""")
def business_counts(spark, sf_dir):
    source = source_events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    record_type = F.when(k % 5 == 1, " system ").when(kind == "signup", "SYSTEM").when(
        kind == "purchase", "Purchase").when(kind == "view", "page view")
    return aggregate.business_counts(source.select(
        F.when(k % 11 == 0, "  ").otherwise(kind).alias("event_type"), record_type.alias("record_type")))


@register("attr_count_report", """
SELECT record_type, count(*) AS count, avg(n) AS avg_attrs, min(n) AS min_attrs, max(n) AS max_attrs,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ev) AS share_pct
FROM (SELECT record_type, CAST(len(string_split(attrs_text, ';')) AS INTEGER) AS n FROM evt) GROUP BY record_type""")
def attr_count_report(spark, sf_dir):
    return aggregate.attr_count_report(event_table(spark, sf_dir))


@register("hot_score_buckets", """
SELECT CAST(coalesce(try_cast(nullif(moderation_score, '') AS INTEGER), 0) AS INTEGER) AS attr_score, count(*) AS count
FROM ev GROUP BY 1""")
def hot_score_buckets(spark, sf_dir):
    return add_hot_columns(event_table(spark, sf_dir)).groupBy("attr_score").agg(F.count("*").alias("count"))
