"""Synthetic events, deduplication and byte budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import prepare
from tidelog.catalogue import SERVICE, SIMULATOR
from tidelog.registered.base import AS_OF, EVENTS_SQL, register
from tidelog.sources import generate
from tidelog.sources.tables import event_table, source_events

SEED = 42


def _draw(name: str, n: int) -> str:
    """SQL of the seeded draw below ``n`` for ``event_id``."""
    prime, salt = generate.PRIME, generate.salt_of(name, SEED)
    x = f"((event_id % {prime} * 48271 + {salt}) % {prime})"
    x = f"(({x} * {x} + {salt}) % {prime})"
    x = f"(({x} * 16807 + {salt}) % {prime})"
    return f"(({x} * {x} + {salt}) % {prime} % {n})"


def _pick(name: str, values) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"[{listed}][{_draw(name, len(values))} + 1]"


def _ids(spark, sf_dir):
    return source_events(spark, sf_dir).select("event_id")


def _generated_sql(catalogue, extra: int) -> str:
    sizes = " ".join(f"WHEN '{a}' THEN {len(e) + extra}" for a, e in catalogue.extras.items())
    with_lang = ", ".join(f"'{a}'" for a, e in catalogue.extras.items() if "lang" in e)
    with_chat = ", ".join(f"'{a}'" for a, e in catalogue.extras.items() if "chat_id" in e)
    return f"""
WITH g AS (SELECT event_id, {_pick("type", catalogue.activities)} AS activity FROM events)
SELECT CAST(event_id AS VARCHAR) AS event_id, activity,
  TIMESTAMP '2024-01-31 00:00:00' - to_seconds({_draw("timestamp", 86400)}) AS event_time,
  CAST({_draw("user_id", 500000)} + 1 AS VARCHAR) AS user_id,
  CASE WHEN activity IN ({with_lang}) THEN {_pick("lang", catalogue.attributes["lang"].allowed)} END AS lang,
  CASE WHEN activity IN ({with_chat}) THEN CAST({_draw("chat_id", 100000)} + 1 AS VARCHAR) END AS chat_id,
  CASE activity {sizes} END AS attrs FROM g"""


def _generated(spark, sf_dir, catalogue):
    records = generate.generate_events(_ids(spark, sf_dir), SEED, catalogue, AS_OF, "event_id")
    attrs = F.col("attrs")
    return records.select(
        F.col("eventId").alias("event_id"), F.col("activityType").alias("activity"),
        F.col("eventTime").alias("event_time"), attrs["user_id"].alias("user_id"), attrs["lang"].alias("lang"),
        attrs["chat_id"].alias("chat_id"), F.size(attrs).alias("attrs"))


@register("generate_service_events", _generated_sql(SERVICE, 2), events=False)
def generate_service_events(spark, sf_dir):
    return _generated(spark, sf_dir, SERVICE)


@register("generate_simulator_events", _generated_sql(SIMULATOR, 3), events=False)
def generate_simulator_events(spark, sf_dir):
    return _generated(spark, sf_dir, SIMULATOR)


@register("generate_bulk", f"""
SELECT TIMESTAMP '2024-01-31 00:00:00' - to_seconds({_draw("event_time", 86400)}) AS event_time,
  {_pick("record_type", generate.BULK_TYPES)} AS record_type, {_draw("user_id", 500)} + 1 AS user_id,
  {_draw("chat_id", 800)} + 1 AS chat_id, {_pick("lang", generate.BULK_LANGS)} AS lang,
  20 + {_draw("payload", 100)} AS payload, '7' AS id_version FROM events""", events=False)
def generate_bulk(spark, sf_dir):
    rows = generate.generate_bulk(_ids(spark, sf_dir), SEED, AS_OF, "event_id")
    return rows.select("event_time", "record_type", "user_id", "chat_id", F.col("attrs")["lang"].alias("lang"),
                       F.length(F.col("attrs")["payload"]).cast("bigint").alias("payload"),
                       F.substring("event_id", 15, 1).alias("id_version"))


@register("generate_legacy", f"""
WITH g AS (SELECT event_id, {_pick("eventType", generate.LEGACY_TYPES)} AS kind,
  md5(event_id || ':{SEED}') AS d FROM events)
SELECT substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-4' || substr(d, 14, 3) || '-a' || substr(d, 18, 3) || '-'
    || substr(d, 21, 12) AS "eventId", kind AS "eventType", 'user-' || ({_draw("userId", 5000)} + 1) AS "userId",
  'sess-' || ({_draw("sessionId", 100000)} + 1) AS "sessionId",
  '10.' || {_draw("ip2", 256)} || '.' || {_draw("ip3", 256)} || '.' || ({_draw("ip4", 254)} + 1) AS "ipAddress",
  CASE WHEN kind = 'purchase' THEN ({_draw("amount", 499901)} + 100) / 100.0::DOUBLE END AS amount,
  'offline-perf' AS source, event_id AS "index", '2024-01-31T00:00:00+00:00' AS "timestamp" FROM g""", events=False)
def generate_legacy(spark, sf_dir):
    return generate.generate_legacy(_ids(spark, sf_dir), SEED, AS_OF, "event_id")


@register("dedup_first", """
SELECT user_id, type, date_trunc('day', event_time) AS event_time, min(event_id) AS event_id FROM ev GROUP BY 1, 2, 3""")
def dedup_first(spark, sf_dir):
    daily = event_table(spark, sf_dir).withColumn("event_time", F.date_trunc("day", "event_time"))
    return prepare.dedup(daily).select("user_id", F.col("attrs")["type"].alias("type"), "event_time", "event_id")


_SIZED = EVENTS_SQL.rstrip() + """, sized AS (
  SELECT event_id, user_id, event_time,
    length('{"eventTime": "", "recordType": "", "userId": , "chatId": , "messageId": , "attrs": {}}') + 20
    + length(record_type) + length(user_id::VARCHAR) + length(chat_id::VARCHAR) + length(message_id::VARCHAR)
    + length(attrs_text) + 6 * len(string_split(attrs_text, ';')) - 1 AS size,
    row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS rn
  FROM evt)
"""


@register("capacity_trim_strict", _SIZED + """
SELECT event_id, user_id FROM (
  SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY rn) AS used FROM sized) WHERE used <= 4096""")
def capacity_trim_strict(spark, sf_dir):
    return prepare.capacity_trim(event_table(spark, sf_dir), max_bytes=4096).select("event_id", "user_id")


@register("capacity_trim_greedy", _SIZED.replace("WITH src", "WITH RECURSIVE src") + """, walk AS (
  SELECT user_id, event_id, rn, size <= 4096 AS kept, CASE WHEN size <= 4096 THEN size ELSE 0 END AS used
  FROM sized WHERE rn = 1
  UNION ALL
  SELECT s.user_id, s.event_id, s.rn, w.used + s.size <= 4096,
    CASE WHEN w.used + s.size <= 4096 THEN w.used + s.size ELSE w.used END
  FROM walk w JOIN sized s ON s.user_id = w.user_id AND s.rn = w.rn + 1)
SELECT event_id, user_id FROM walk WHERE kept""")
def capacity_trim_greedy(spark, sf_dir):
    return prepare.capacity_trim(event_table(spark, sf_dir), max_bytes=4096, mode="greedy").select("event_id", "user_id")
