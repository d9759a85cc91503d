"""Registry of queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The test events end on 2024-01-30; relative time ranges count back from here.
AS_OF = "2024-01-31 00:00:00"
FROM, TO = "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z"

# The event table of tidelog.sources.tables.adapt, attributes as plain columns ('' if absent).
EVENTS_SQL = """
WITH src AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), ev AS (
  SELECT event_id, user_id, k, value,
    date_trunc('second', ts) AS event_time,
    date_trunc('second', ts) + to_seconds(k) AS ingest_time,
    CASE event_type WHEN 'signup' THEN 'SYSTEM' WHEN 'purchase' THEN 'PURCHASE'
      WHEN 'error' THEN 'MODERATION' ELSE 'MESSAGE' END AS record_type,
    CASE WHEN event_type IN ('click', 'view', 'error') THEN k + 1 ELSE 0 END AS chat_id,
    CASE WHEN event_type IN ('click', 'view', 'error') THEN event_id ELSE 0 END AS message_id,
    CASE event_type WHEN 'signup' THEN 'REGISTRATION' WHEN 'click' THEN 'MESSAGE_SENT'
      WHEN 'view' THEN 'MESSAGE_READ' WHEN 'purchase' THEN 'PURCHASE_COMPLETED'
      WHEN 'error' THEN 'MODERATION_FLAG' END AS type,
    CASE WHEN event_type IN ('signup', 'click', 'error')
      THEN ['ru', 'en', 'de', 'fr', 'zh', 'es'][k % 6 + 1] ELSE '' END AS lang,
    CASE WHEN event_type IN ('click', 'view', 'error')
      THEN ['mobile', 'web', 'backend', 'desktop'][k % 4 + 1] ELSE '' END AS source,
    CASE WHEN event_type = 'error' THEN CAST(k AS VARCHAR) ELSE '' END AS moderation_score,
    CASE WHEN event_type <> 'signup' THEN '' WHEN k % 10 = 0 THEN 'BASIC' ELSE 'ONEME' END AS terminal_type,
    CASE WHEN event_type <> 'signup' THEN '' WHEN k % 5 = 0 THEN '0' ELSE '1' END AS user_active_status,
    CASE WHEN event_type <> 'signup' THEN '' ELSE CAST(k % 2 AS VARCHAR) END AS gender,
    CASE WHEN event_type <> 'signup' THEN '' WHEN user_id % 2 = 0 THEN 'ANDROID' ELSE 'IOS' END AS user_device_type,
    CASE WHEN event_type <> 'signup' THEN '' ELSE ['-7207924629501764854', '-4231934642844376041',
      '1136490941434531770', '4369003663347448391', '9876543210123456789', '1111222233334444555'][k % 6 + 1]
      END AS org_hash,
    CASE WHEN event_type = 'purchase' THEN CAST(CAST(round_even(value * 100, 0) AS BIGINT) AS VARCHAR)
      ELSE '' END AS amount_cents,
    CASE WHEN event_type = 'click' THEN repeat('x', CAST(k % 50 + 20 AS INTEGER)) ELSE '' END AS payload
  FROM src
), evt AS (
  SELECT *, concat_ws(';', 'amount_cents=' || nullif(amount_cents, ''), 'gender=' || nullif(gender, ''),
    'lang=' || nullif(lang, ''), 'moderation_score=' || nullif(moderation_score, ''),
    'org_hash=' || nullif(org_hash, ''), 'payload=' || nullif(payload, ''), 'source=' || nullif(source, ''),
    'terminal_type=' || nullif(terminal_type, ''), 'type=' || type,
    'user_active_status=' || nullif(user_active_status, ''),
    'user_device_type=' || nullif(user_device_type, '')) AS attrs_text
  FROM ev
)
"""

# The incoming records of tidelog.sources.tables.raw_records, attributes as plain columns (null if absent).
RECORDS_SQL = EVENTS_SQL.rstrip() + """, raw AS (
  SELECT s.event_id AS n, s.k, s.event_type, s.user_id AS user_number, e.type AS activity,
    CASE WHEN s.k % 2 = 1 AND s.k <> 7 THEN e.type END AS field_type,
    CASE WHEN s.k = 9 THEN 'LOGOUT' WHEN s.k % 4 = 0 THEN lower(e.type)
      WHEN s.k % 4 = 2 THEN e.type END AS attr_type,
    CASE WHEN s.k % 7 = 0 THEN '' ELSE printf('00000000-0000-7000-8000-%012x', s.event_id) END AS event_id,
    CASE WHEN s.k = 3 THEN ' ' WHEN s.k = 5 THEN 'u-5' ELSE ' ' || s.user_id END AS user_id,
    CASE WHEN s.event_type IN ('click', 'view', 'error') THEN CAST(s.k + 1 AS VARCHAR) END AS chat_id,
    CASE WHEN s.event_type IN ('click', 'view', 'error') THEN CAST(s.event_id AS VARCHAR) END AS message_id,
    CASE WHEN s.event_type = 'click' THEN CASE WHEN s.k = 13 THEN 'long'
      ELSE CAST(s.k + 20 AS VARCHAR) END END AS message_length,
    CASE WHEN s.event_type = 'click' THEN CASE WHEN s.k = 15 THEN 'xx' ELSE e.lang END END AS lang,
    CASE WHEN s.event_type = 'click' THEN CASE WHEN s.k % 3 = 0 THEN 'TRUE' ELSE '0' END END AS is_reply,
    nullif(e.amount_cents, '') AS amount_cents,
    CASE WHEN s.event_type = 'signup' THEN 's-' || s.k END AS session_id,
    CASE WHEN s.event_type = 'signup' AND s.k >= 50 THEN '1' END AS gender,
    nullif(e.moderation_score, '') AS moderation_score,
    e.event_time
  FROM src s JOIN ev e USING (event_id)
), checked AS (
  SELECT *, CASE
    WHEN k = 17 THEN 'attrs required'
    WHEN k = 9 THEN 'activityType and attrs.type mismatch: ' || activity || ' vs LOGOUT'
    WHEN k = 7 THEN 'activity type required (activityType or attrs.type)'
    WHEN k = 11 THEN 'eventTime required'
    WHEN k = 3 THEN 'user_id required in attrs'
    WHEN k = 5 THEN 'user_id must be a number'
    WHEN event_type = 'signup' AND k >= 50 THEN 'Unknown attribute for REGISTRATION: gender'
    WHEN event_type = 'click' AND k = 15 THEN 'Attribute LANG: value ''xx'' not in allowed set'
    WHEN event_type = 'click' AND k = 13 THEN 'Invalid MESSAGE_LENGTH: long'
    WHEN k % 4 = 0 THEN 'Attribute TYPE: value ''' || lower(activity) || ''' not in allowed set'
    END AS error
  FROM raw
)
"""


def register(name: str, sql: str | None = None, events: bool = True):
    """Register a query; ``sql`` is prefixed with the event table unless it starts with WITH."""

    def keep(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: plain_times(build(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            ORACLES[name] = text if text.upper().startswith("WITH") or not events else EVENTS_SQL + text
        return build

    return keep


def plain_times(df: DataFrame) -> DataFrame:
    """Times without zone (they are UTC), which every client shows alike."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in zoned}) if zoned else df


def attrs_text(attrs: Column | str = "attrs") -> Column:
    """The attribute map as sorted ``key=value`` text."""
    entries = F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(entries), ";")


def flat(df: DataFrame) -> DataFrame:
    """``df`` with the attribute map as text."""
    return df.withColumn("attrs_text", attrs_text()).drop("attrs")
