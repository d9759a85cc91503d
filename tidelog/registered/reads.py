"""Searches, point reads, filters and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.json_text import with_parsed
from tidelog.operators import filters, search
from tidelog.operators.pages import RankIndex, page_after
from tidelog.plans.request import query_from_params
from tidelog.registered.base import AS_OF, FROM, TO, flat, register
from tidelog.session import scratch_path
from tidelog.sources.tables import event_table, source_events

_COLUMNS = ("event_time, ingest_time, record_type, event_id, user_id, chat_id, message_id, attrs_text")


@register("scan_events", f"SELECT {_COLUMNS} FROM evt")
def scan_events(spark, sf_dir):
    return flat(event_table(spark, sf_dir))


@register("search_attributes", f"""
SELECT {_COLUMNS} FROM evt WHERE record_type = 'MESSAGE' AND lang = 'ru' AND source = 'mobile'
ORDER BY event_time DESC, event_id DESC LIMIT 100""")
def search_attributes(spark, sf_dir):
    wanted = {"record_type": "message", "LANG": " ru ", "source": "mobile", "chat_id": " ", "": "x"}
    return flat(search.search(event_table(spark, sf_dir), wanted))


@register("search_user", f"""
SELECT {_COLUMNS} FROM evt WHERE user_id = 7 ORDER BY event_time DESC, event_id DESC LIMIT 5000""")
def search_user(spark, sf_dir):
    return flat(search.search(event_table(spark, sf_dir), {"USER_ID": "7"}, 5000))


@register("search_event_id", f"SELECT {_COLUMNS} FROM evt WHERE event_id = 321")
def search_event_id(spark, sf_dir):
    return flat(search.search(event_table(spark, sf_dir), {"event_id": "321"}))


@register("moderation_queue", f"""
SELECT {_COLUMNS} FROM evt WHERE record_type = 'MODERATION' ORDER BY event_time DESC, event_id DESC LIMIT 100""")
def moderation_queue(spark, sf_dir):
    return flat(search.moderation(event_table(spark, sf_dir), "moderation"))


@register("moderation_user_chat", f"""
SELECT {_COLUMNS} FROM evt WHERE record_type = 'MESSAGE' AND user_id = 3 AND chat_id = 12
ORDER BY event_time DESC, event_id DESC LIMIT 20""")
def moderation_user_chat(spark, sf_dir):
    return flat(search.moderation(event_table(spark, sf_dir), "MESSAGE", user_id=3, chat_id=12, limit=20))


@register("moderation_breakdown", """
SELECT record_type, count(*) AS count FROM (
  SELECT * FROM ev WHERE chat_id = 5 ORDER BY event_time DESC, event_id DESC LIMIT 1000) GROUP BY record_type""")
def moderation_breakdown(spark, sf_dir):
    return search.breakdown(search.moderation(event_table(spark, sf_dir), chat_id=5, limit=1000))


@register("count_user_type", "SELECT count(*) AS count FROM ev WHERE user_id = 5 AND record_type = 'MESSAGE'")
def count_user_type(spark, sf_dir):
    return search.count_user_type(event_table(spark, sf_dir), 5, "MESSAGE")


@register("user_summary", """
SELECT count(*) AS count, min(event_time) AS first_time, max(event_time) AS last_time
FROM ev WHERE user_id = 4 AND record_type = 'PURCHASE'""")
def user_summary(spark, sf_dir):
    return search.summary(event_table(spark, sf_dir), user_id=4, record_type="PURCHASE")


@register("chat_summary", """
SELECT count(*) AS count, min(event_time) AS first_time, max(event_time) AS last_time FROM ev WHERE chat_id = 42""")
def chat_summary(spark, sf_dir):
    return search.summary(event_table(spark, sf_dir), chat_id=42)


def _legacy(spark, sf_dir):
    """The older event table: flat columns and a JSON message."""
    source = source_events(spark, sf_dir)
    nested = F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("who"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    message = F.to_json(F.struct(
        F.concat(F.lit("sess-"), (F.col("user_id") % 10).cast("string")).alias("sessionId"),
        k.alias("score"), nested.alias("nested")))
    return source.select("event_id", "event_type", "user_id", "value",
                         F.col("ts").cast("timestamp").alias("created_at"), message.alias("message"))


_LEGACY_SQL = """
WITH legacy AS (
  SELECT event_id, event_type, user_id, ts AS created_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS score
  FROM events)
"""


@register("latest_legacy", _LEGACY_SQL + """
SELECT event_id, event_type, user_id, created_at FROM legacy ORDER BY created_at DESC, event_id DESC LIMIT 9999""")
def latest_legacy(spark, sf_dir):
    return search.latest(_legacy(spark, sf_dir), 9999, time="created_at").select(
        "event_id", "event_type", "user_id", "created_at")


@register("search_json_text", _LEGACY_SQL + """
SELECT event_id, created_at FROM legacy WHERE user_id % 10 = 3 ORDER BY created_at DESC, event_id DESC LIMIT 200""")
def search_json_text(spark, sf_dir):
    return search.search_json(_legacy(spark, sf_dir), "sessionId", "sess-3", 200).select("event_id", "created_at")


@register("search_json_nested", _LEGACY_SQL + """
SELECT event_id, created_at FROM legacy WHERE event_type = 'error' ORDER BY created_at DESC, event_id DESC LIMIT 100""")
def search_json_nested(spark, sf_dir):
    return search.search_json(_legacy(spark, sf_dir), "nested.kind", "error").select("event_id", "created_at")


@register("search_json_number", _LEGACY_SQL + """
SELECT event_id, score AS found FROM legacy WHERE score >= 40 ORDER BY score DESC, event_id DESC LIMIT 500""")
def search_json_number(spark, sf_dir):
    return search.search_json_int(_legacy(spark, sf_dir), "score", 40, 500).select("event_id", "found")


def _parsed(spark, sf_dir):
    """The older events stored with their messages parsed."""
    path = scratch_path(spark, "parsed")
    with_parsed(_legacy(spark, sf_dir)).drop("message").write.parquet(path)
    return spark.read.parquet(path)


@register("search_parsed_text", _LEGACY_SQL + """
SELECT event_id, created_at FROM legacy WHERE user_id % 10 = 3 ORDER BY created_at DESC, event_id DESC LIMIT 200""")
def search_parsed_text(spark, sf_dir):
    return search.search_json(_parsed(spark, sf_dir), "sessionId", "sess-3", 200).select("event_id", "created_at")


@register("search_parsed_number", _LEGACY_SQL + """
SELECT event_id, score AS found FROM legacy WHERE score >= 40 ORDER BY score DESC, event_id DESC""")
def search_parsed_number(spark, sf_dir):
    return search.search_json_int(_parsed(spark, sf_dir), "score", 40, None).select("event_id", "found")


@register("json_number_is_no_text", _LEGACY_SQL + """
SELECT count(*) AS count FROM legacy WHERE score IS NULL""")
def json_number_is_no_text(spark, sf_dir):
    # Equality is on text values only: the number 7 is not the text '7'.
    from tidelog.functions.json_text import json_string

    legacy = _legacy(spark, sf_dir)
    return legacy.filter(json_string(F.col("message"), "score") == "7").agg(F.count("*").alias("count"))


@register("filter_attribute_map", "SELECT event_id, lang FROM ev WHERE lang = 'de'")
def filter_attribute_map(spark, sf_dir):
    from tidelog.functions import lookup_attribute

    return filters.filter_attr(event_table(spark, sf_dir), "lang", "de").select(
        "event_id", lookup_attribute("lang").alias("lang"))


@register("filter_attribute_hot", "SELECT event_id, source AS attr_source FROM ev WHERE source = 'backend'")
def filter_attribute_hot(spark, sf_dir):
    from tidelog.sources.layout import add_hot_columns

    hot = add_hot_columns(event_table(spark, sf_dir))
    return filters.filter_attr(hot, "source", "backend").select("event_id", "attr_source")


@register("time_range_inclusive", """
SELECT event_id, event_time FROM ev
WHERE event_time >= TIMESTAMP '2024-01-05 06:00:00' AND event_time <= TIMESTAMP '2024-01-09 18:30:00'""")
def time_range_inclusive(spark, sf_dir):
    return filters.time_range(event_table(spark, sf_dir), "2024-01-05T09:00:00+03:00", "2024-01-09 18:30:00").select(
        "event_id", "event_time")


@register("time_range_default", """
SELECT event_id, event_time FROM ev
WHERE event_time >= TIMESTAMP '2024-01-30 00:00:00' AND event_time <= TIMESTAMP '2024-01-31 00:00:00'""")
def time_range_default(spark, sf_dir):
    return filters.time_range(event_table(spark, sf_dir), hours=24, as_of=AS_OF).select("event_id", "event_time")


@register("last_minutes", "SELECT event_id FROM ev WHERE event_time >= TIMESTAMP '2024-01-28 00:00:00'")
def last_minutes(spark, sf_dir):
    return filters.last_minutes(event_table(spark, sf_dir), 3 * 1440, AS_OF).select("event_id")


@register("filter_types", "SELECT event_id, type FROM ev WHERE type IN ('REGISTRATION', 'MESSAGE_READ')")
def filter_types(spark, sf_dir):
    return filters.filter_types(event_table(spark, sf_dir), "registration, nonsense ,MESSAGE_READ").select(
        "event_id", F.col("attrs")["type"].alias("type"))


@register("filter_ids_list", "SELECT event_id, record_type FROM ev WHERE event_id IN (1, 3, 5, 700, 901)")
def filter_ids_list(spark, sf_dir):
    return filters.filter_ids(event_table(spark, sf_dir), [1, 3, 5, 700, 901]).select("event_id", "record_type")


@register("filter_ids_long_list", "SELECT event_id, record_type FROM ev WHERE event_id < 3000 AND event_id % 2 = 1")
def filter_ids_long_list(spark, sf_dir):
    ids = [str(i) if i % 3 else i for i in range(1, 3000, 2)]
    return filters.filter_ids(event_table(spark, sf_dir), ids).select("event_id", "record_type")


@register("filter_ids_join", """
SELECT event_id, record_type FROM ev WHERE event_id IN (SELECT o_orderkey FROM orders)""")
def filter_ids_join(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return filters.filter_ids(event_table(spark, sf_dir), keys).select("event_id", "record_type")


@register("filter_query_string", "SELECT event_id FROM ev WHERE terminal_type = 'ONEME'")
def filter_query_string(spark, sf_dir):
    return filters.filter_query_string(event_table(spark, sf_dir), " TERMINAL_TYPE = ONEME").select("event_id")


@register("order_by_column", "SELECT event_id, chat_id FROM ev ORDER BY chat_id, event_id")
def order_by_column(spark, sf_dir):
    return filters.order(event_table(spark, sf_dir).select("event_id", "chat_id"), "chat_id", ascending=True)


@register("page_newest", """
SELECT event_id, event_time FROM ev ORDER BY event_time DESC, event_id DESC LIMIT 50 OFFSET 200""")
def page_newest(spark, sf_dir):
    return search.page(event_table(spark, sf_dir), 200, 50).select("event_id", "event_time")


@register("page_oldest_by_user", """
SELECT event_id, user_id FROM ev ORDER BY user_id, event_id LIMIT 9000 OFFSET 100""")
def page_oldest_by_user(spark, sf_dir):
    return search.page(event_table(spark, sf_dir), 100, 9000, "user_id", ascending=True).select("event_id", "user_id")


@register("page_deep_by_user", """
SELECT event_id, user_id, event_time FROM ev ORDER BY user_id DESC, event_id DESC LIMIT 120 OFFSET 640""")
def page_deep_by_user(spark, sf_dir):
    events = event_table(spark, sf_dir)
    return RankIndex.build(events, "user_id").page(events, 640, 120).select("event_id", "user_id", "event_time")


@register("page_deep_with_nulls", """
SELECT event_id, nullif(lang, '') AS lang FROM ev ORDER BY nullif(lang, '') NULLS FIRST, event_id LIMIT 500 OFFSET 333""")
def page_deep_with_nulls(spark, sf_dir):
    # Many rows without a value and few different ones: the page lies among equal keys.
    events = event_table(spark, sf_dir).withColumn("lang", F.col("attrs")["lang"])
    return RankIndex.build(events, "lang", ascending=True).page(events, 333, 500).select("event_id", "lang")


@register("page_tokens", """
SELECT event_id, event_time, CAST(ceil(rn / 150.0) AS INTEGER) AS page FROM (
  SELECT *, row_number() OVER (ORDER BY event_time DESC, event_id DESC) AS rn FROM ev) WHERE rn <= 450""")
def page_tokens(spark, sf_dir):
    events, token, out = event_table(spark, sf_dir), None, None
    for number in range(1, 4):
        rows = page_after(events, token, 150)
        token = rows.orderBy("event_time", "event_id").first()["page_token"]
        part = rows.select("event_id", "event_time", F.lit(number).alias("page"))
        out = part if out is None else out.unionByName(part)
    return out


@register("request_top_chart", """
, chosen AS (SELECT * FROM ev WHERE type IN ('REGISTRATION', 'MESSAGE_SENT') AND lang = 'en'),
top AS (SELECT user_id FROM chosen GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 200)
SELECT user_id AS key, date_trunc('hour', event_time) AS chart, count(*) AS events FROM chosen
WHERE user_id IN (SELECT user_id FROM top) GROUP BY ALL""")
def request_top_chart(spark, sf_dir):
    return query_from_params(event_table(spark, sf_dir), {
        "types": "REGISTRATION,MESSAGE_SENT", "queryString": "LANG=en", "topBy": "USER_ID",
        "chartBy": "TIMESTAMP", "chunkSize": "200", "minutes": "0"}, AS_OF)


@register("request_top", """
SELECT source AS key, count(*) AS count FROM ev WHERE record_type = 'MESSAGE' GROUP BY source
ORDER BY count DESC, key LIMIT 3""")
def request_top(spark, sf_dir):
    return query_from_params(event_table(spark, sf_dir), {
        "documentTypes": "message", "topBy": "SOURCE", "chunkSize": "3"}, AS_OF)


@register("request_chart", """
SELECT date_trunc('hour', event_time) AS key, count(*) AS count FROM ev
WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY key ORDER BY key LIMIT 9999""")
def request_chart(spark, sf_dir):
    return query_from_params(event_table(spark, sf_dir), {
        "minutes": str(7 * 1440), "chartBy": "TIMESTAMP", "chunkSize": "9999"}, AS_OF)


@register("request_page", """
SELECT event_id, event_time, record_type FROM ev
WHERE type = 'PURCHASE_COMPLETED' AND event_time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'
ORDER BY event_time DESC, event_id DESC LIMIT 40 OFFSET 10""")
def request_page(spark, sf_dir):
    return query_from_params(event_table(spark, sf_dir), {
        "types": "purchase_completed", "timeFrom": FROM, "timeTo": TO, "chunkSize": "40",
        "chunkStartAt": "10"}, AS_OF).select("event_id", "event_time", "record_type")
