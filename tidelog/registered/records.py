"""Record normalization, checks and typed attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog.functions.records import constant
from tidelog.operators import normalize, validate
from tidelog.catalogue import SERVICE, SIMULATOR
from tidelog.registered.base import AS_OF, EVENTS_SQL, RECORDS_SQL, attrs_text, register
from tidelog.sources.generate import generate_events
from tidelog.sources.tables import event_table, raw_records, source_events, uuid_of

_KEPT_ID = "CASE WHEN event_id = '' THEN 'new' ELSE event_id END"


def _kept(column="event_id"):
    value = F.col(column)
    return F.when(value.startswith("00000000-0000-7000-8000-"), value).otherwise("new").alias("event_id")


@register("normalize_attrs", RECORDS_SQL + """
SELECT event_id, CASE WHEN k <> 17 THEN concat_ws(';', 'amount_cents=' || amount_cents, 'chat_id=' || chat_id, 'gender=' || gender,
  'is_reply=' || is_reply, 'lang=' || lang, 'message_id=' || message_id, 'message_length=' || message_length,
  'moderation_score=' || moderation_score, 'session_id=' || session_id, 'type=' || attr_type,
  'user_id=' || user_id) END AS attrs_text FROM raw""")
def normalize_attrs(spark, sf_dir):
    return raw_records(spark, sf_dir).select(F.col("eventId").alias("event_id"),
                          attrs_text(fn.normalize_attrs(F.col("attrs"))).alias("attrs_text"))


@register("colliding_attr_keys", """
SELECT event_id, 'lang=' || event_type || ';n=;user_id=' || user_id AS attrs_text FROM src""")
def colliding_attr_keys(spark, sf_dir):
    # Keys that collide keep the last value, blank keys go, null values become ''.
    attrs = F.create_map(
        F.lit("LANG"), F.lit("old"), F.lit(" "), F.lit("x"), F.lit("User_Id"), F.col("user_id").cast("string"),
        F.lit("lang"), F.col("event_type"), F.lit("N"), F.lit(None).cast("string"), F.lit(""), F.lit("y"))
    return source_events(spark, sf_dir).select("event_id", attrs_text(fn.normalize_attrs(attrs)).alias("attrs_text"))


@register("activity_types", """
SELECT event_id, CASE WHEN k % 3 = 2 THEN NULL ELSE type END AS activity FROM ev""")
def activity_types(spark, sf_dir):
    events = event_table(spark, sf_dir)
    kind, k = F.col("attrs")["type"], F.unix_timestamp("ingest_time") - F.unix_timestamp("event_time")
    text = F.when(k % 3 == 0, F.concat(F.lit("\t "), F.lower(kind), F.lit(" "))).when(k % 3 == 1, kind).otherwise(
        F.concat(kind, F.lit("S")))
    return events.select("event_id", fn.parse_activity_type(text).alias("activity"))


@register("coarse_record_types", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'OTHER' WHEN event_type = 'signup' THEN 'SYSTEM'
  WHEN event_type = 'click' THEN 'MESSAGE' WHEN event_type = 'purchase' THEN 'PURCHASE' ELSE 'MODERATION' END AS record_type
FROM src""")
def coarse_record_types(spark, sf_dir):
    kind = F.col("event_type")
    activity = constant({"signup": "login", "click": "FILE_DELETED", "view": "SEARCH_PERFORMED"})[kind]
    attrs = F.create_map(F.lit("type"), F.when(kind == "purchase", "purchase_refunded").when(
        kind == "error", " Moderation_Reject"))
    return source_events(spark, sf_dir).select("event_id", fn.coarse_record_type(activity, attrs).alias("record_type"))


@register("normalized_record_types", """
SELECT CASE event_type WHEN 'signup' THEN 'SYSTEM' WHEN 'click' THEN 'MESSAGE' WHEN 'view' THEN 'OTHER'
  WHEN 'purchase' THEN 'PURCHASE' ELSE 'OTHER' END AS record_type, count(*) AS count FROM src GROUP BY 1""")
def normalized_record_types(spark, sf_dir):
    text = constant({"signup": "system", "click": " MESSAGE\n", "view": "views", "purchase": "Purchase"})
    return source_events(spark, sf_dir).groupBy(
        fn.normalize_record_type(text[F.col("event_type")]).alias("record_type")).agg(F.count("*").alias("count"))


@register("ids_from_text", """
SELECT event_id, CASE k % 6 WHEN 0 THEN user_id WHEN 1 THEN user_id ELSE 0 END AS id,
  CAST(CASE k % 6 WHEN 1 THEN user_id ELSE 0 END AS INTEGER) AS score FROM src""")
def ids_from_text(spark, sf_dir):
    source = source_events(spark, sf_dir)
    uid, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k").cast("bigint") % 6
    text = (F.when(k == 0, F.concat(F.lit(" "), uid, F.lit("\n"))).when(k == 1, F.concat(F.lit("+"), uid))
            .when(k == 2, F.concat(uid, F.lit(".5"))).when(k == 3, F.concat(F.lit("u"), uid))
            .when(k == 4, F.concat(F.lit("9999999999999999999"), uid)).otherwise(""))
    return source.select("event_id", fn.long_or_zero(text).alias("id"), fn.int_or_zero(text).alias("score"))


@register("records_to_rows", RECORDS_SQL + f"""
SELECT {_KEPT_ID} AS event_id,
  CASE WHEN k = 11 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE event_time END AS event_time,
  event_time AS ingest_time,
  CASE WHEN k = 7 OR k = 17 AND field_type IS NULL THEN 'OTHER' WHEN activity = 'REGISTRATION' THEN 'SYSTEM'
    WHEN activity = 'PURCHASE_COMPLETED' THEN 'PURCHASE' WHEN activity = 'MODERATION_FLAG' THEN 'MODERATION'
    ELSE 'MESSAGE' END AS record_type,
  CASE WHEN k IN (3, 5, 17) THEN 0 ELSE user_number END AS user_id,
  CASE WHEN k = 17 OR chat_id IS NULL THEN 0 ELSE CAST(chat_id AS BIGINT) END AS chat_id,
  CASE WHEN k = 17 OR message_id IS NULL THEN 0 ELSE CAST(message_id AS BIGINT) END AS message_id,
  CASE WHEN k = 17 THEN 'type=' || field_type ELSE concat_ws(';', 'amount_cents=' || amount_cents,
    'chat_id=' || chat_id, 'gender=' || gender, 'is_reply=' || is_reply, 'lang=' || lang,
    'message_id=' || message_id, 'message_length=' || message_length, 'moderation_score=' || moderation_score,
    'session_id=' || session_id, 'type=' || coalesce(attr_type, field_type), 'user_id=' || user_id) END AS attrs_text
FROM raw""")
def records_to_rows(spark, sf_dir):
    rows = normalize.to_event_rows(raw_records(spark, sf_dir), AS_OF)
    return rows.select(_kept(), "event_time", "ingest_time", "record_type", "user_id", "chat_id", "message_id",
                       attrs_text().alias("attrs_text"))


@register("canonical_flags", RECORDS_SQL + """
SELECT CASE WHEN event_type = 'click' AND k <> 17 THEN CASE WHEN k % 3 = 0 THEN '1' ELSE '0' END END AS is_reply,
  count(*) AS count FROM raw GROUP BY 1""")
def canonical_flags(spark, sf_dir):
    rows = normalize.to_event_rows(raw_records(spark, sf_dir), AS_OF, canonical_flags=True)
    return rows.groupBy(F.col("attrs")["is_reply"].alias("is_reply")).agg(F.count("*").alias("count"))


@register("event_ids_and_times", """
SELECT event_id, date_trunc('milliseconds', ts) AS id_time, '7' AS version, 36 AS length FROM src""")
def event_ids_and_times(spark, sf_dir):
    # Ids that are no UUID are replaced by time-ordered ones that carry the event's millisecond.
    source = source_events(spark, sf_dir).select(
        "event_id", fn.ensure_event_id(F.col("event_type"), F.col("ts").cast("timestamp")).alias("id"))
    return source.select("event_id", fn.uuid7_timestamp(F.col("id")).alias("id_time"),
                         F.substring("id", 15, 1).alias("version"), F.length("id").alias("length"))


@register("given_event_ids", """
SELECT event_id AS n, printf('00000000-0000-7000-8000-%012x', event_id) AS id FROM src""")
def given_event_ids(spark, sf_dir):
    given = uuid_of(F.col("event_id"))
    mixed = F.when(F.col("event_id") % 2 == 0, F.upper(given)).otherwise(
        F.concat(F.lit("0-0-7000-8000-"), F.hex("event_id")))
    return source_events(spark, sf_dir).select(
        F.col("event_id").alias("n"), fn.ensure_event_id(mixed, F.current_timestamp()).alias("id"))


@register("rows_to_records", """
SELECT type AS "activityType", event_time AS "eventTime", ingest_time AS "ingestTime",
  CAST(event_id AS VARCHAR) AS "eventId", attrs_text || CASE WHEN user_id <> 0 THEN ';user_id=' || user_id ELSE '' END
    AS attrs_text FROM evt""")
def rows_to_records(spark, sf_dir):
    return normalize.to_records(event_table(spark, sf_dir)).select(
        "activityType", "eventTime", "ingestTime", "eventId", attrs_text().alias("attrs_text"))


@register("parse_timestamps", """
SELECT event_id, CASE WHEN k % 6 = 5 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM src""")
def parse_timestamps(spark, sf_dir):
    source = source_events(spark, sf_dir)
    t, k = F.col("ts").cast("timestamp"), F.get_json_object("props", "$.k").cast("bigint") % 6
    text = (F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(k == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
            .when(k == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
            .when(k == 3, F.date_format(t + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+03:00'"))
            .when(k == 4, F.unix_timestamp(t).cast("string")).otherwise(F.date_format(t, "HH:mm 'on' yyyy/MM/dd")))
    return source.select("event_id", fn.parse_timestamp(text).alias("parsed"))


@register("typed_attributes", """
SELECT event_id, try_cast(nullif(moderation_score, '') AS BIGINT) AS score,
  CASE WHEN user_active_status <> '' THEN user_active_status = '1' END AS active,
  nullif(lang, '') AS lang, event_time AS at FROM ev""")
def typed_attributes(spark, sf_dir):
    return event_table(spark, sf_dir).select(
        "event_id", fn.read_attribute("MODERATION_SCORE").alias("score"),
        fn.read_attribute("user_active_status").alias("active"), fn.read_attribute("LANG").alias("lang"),
        fn.read_attribute("TIMESTAMP").alias("at"))


@register("attribute_writes", """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '1' ELSE '0' END AS is_reply,
  CAST(k AS VARCHAR) AS message_length, 'en' AS lang FROM ev""")
def attribute_writes(spark, sf_dir):
    events = event_table(spark, sf_dir)
    k = F.unix_timestamp("ingest_time") - F.unix_timestamp("event_time")
    for name, value in (("IS_REPLY", F.col("user_id") % 2 == 0), ("MESSAGE_LENGTH", k), ("LANG", F.lit("en"))):
        events = events.withColumn("attrs", fn.write_attribute(name, value))
    return events.select("event_id", *[F.col("attrs")[n].alias(n) for n in ("is_reply", "message_length", "lang")])


@register("legacy_envelopes", """
SELECT CASE WHEN k % 4 = 0 THEN 'new' ELSE CAST(event_id AS VARCHAR) END AS "eventId",
  CASE WHEN k % 5 = 0 THEN 'unknown' ELSE event_type END AS "eventType",
  CASE WHEN k % 3 = 0 THEN 'anonymous' ELSE CAST(user_id AS VARCHAR) END AS "userId",
  CASE WHEN k % 7 = 0 THEN '2024-01-31T00:00:00.000000Z' ELSE CAST(ts AS VARCHAR) END AS "timestamp",
  CASE WHEN event_type = 'purchase' THEN 'PURCHASE' ELSE 'OTHER' END AS "recordType" FROM src""")
def legacy_envelopes(spark, sf_dir):
    source = source_events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    flat = source.select(
        F.when(k % 4 != 0, F.col("event_id")).alias("eventId"),
        F.when(k % 5 == 0, " ").otherwise(F.col("event_type")).alias("eventType"),
        F.when(k % 3 != 0, F.col("user_id").cast("string")).alias("userId"),
        F.when(k % 7 == 0, "").otherwise(F.col("ts").cast("string")).alias("timestamp"),
        F.col("event_type").alias("recordType"))
    filled = normalize.normalize_envelope(flat, AS_OF)
    return filled.withColumn("eventId", F.when(F.length("eventId") == 36, "new").otherwise(F.col("eventId")))


@register("top_attributes", """
SELECT event_id, CASE type WHEN 'REGISTRATION' THEN concat_ws(';', 'type=' || type, 'lang=' || lang,
    'terminal_type=' || terminal_type, 'user_active_status=' || user_active_status, 'gender=' || gender)
  ELSE concat_ws(';', 'type=' || type, 'lang=' || nullif(lang, ''), 'source=' || nullif(source, ''),
    'payload=' || nullif(payload, ''), 'amount_cents=' || nullif(amount_cents, ''),
    'moderation_score=' || nullif(moderation_score, '')) END AS shown FROM evt""")
def top_attributes(spark, sf_dir):
    entries = F.transform(fn.top_attributes(F.col("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return event_table(spark, sf_dir).select("event_id", F.array_join(entries, ";").alias("shown"))


@register("simulator_api_rows", EVENTS_SQL + """
SELECT strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') AS "eventTime", record_type AS "recordType",
  user_id AS "userId", chat_id AS "chatId", message_id AS "messageId", attrs_text FROM evt""")
def simulator_api_rows(spark, sf_dir):
    events = event_table(spark, sf_dir)
    attrs = F.map_concat("attrs", F.create_map(
        F.lit("timestamp"), F.unix_millis("event_time").cast("string"),
        F.lit("user_id"), F.col("user_id").cast("string"),
        F.lit("chat_id"), F.col("chat_id").cast("string"),
        F.lit("message_id"), F.col("message_id").cast("string")))
    api = normalize.sim_to_api(events.select(attrs.alias("attrs")))
    return api.withColumn("attrs_text", attrs_text()).drop("attrs")


@register("validate_records", RECORDS_SQL + """
SELECT error, count(*) AS count FROM checked GROUP BY error""")
def validate_records(spark, sf_dir):
    checked = validate.validate(raw_records(spark, sf_dir))
    return checked.groupBy("error").agg(F.count("*").alias("count"))


@register("quarantined_records", RECORDS_SQL + """
SELECT event_id, error FROM checked WHERE error IS NOT NULL""")
def quarantined_records(spark, sf_dir):
    return validate.split_valid(raw_records(spark, sf_dir))[1].select(F.col("eventId").alias("event_id"), "error")


@register("accepted_records", RECORDS_SQL + """
SELECT field_type AS "activityType", event_id AS "eventId" FROM checked WHERE error IS NULL""")
def accepted_records(spark, sf_dir):
    good = validate.split_valid(raw_records(spark, sf_dir))[0]
    # Nothing is refused any more, so failing fast passes them all.
    return validate.split_valid(good, mode="failfast")[0].select("activityType", "eventId")


@register("unknown_attributes", EVENTS_SQL + """
SELECT event_id, CASE type WHEN 'REGISTRATION' THEN 'gender;user_active_status' WHEN 'MESSAGE_SENT' THEN 'payload'
  ELSE '' END AS unknown FROM ev""")
def unknown_attributes(spark, sf_dir):
    unknown = validate.unknown_attributes(F.col("attrs")["type"], F.col("attrs"))
    return event_table(spark, sf_dir).select(
        "event_id", F.array_join(F.array_sort(unknown), ";").alias("unknown"))


@register("invalid_values", RECORDS_SQL + """
SELECT event_id, CASE WHEN k <> 17 THEN concat_ws(';', CASE WHEN event_type = 'click' AND k = 15 THEN 'lang=xx' END,
  CASE WHEN event_type = 'click' AND k = 13 THEN 'message_length=long' END,
  CASE WHEN k % 4 = 0 THEN 'type=' || attr_type END, CASE WHEN k = 5 THEN 'user_id=u-5' END) END AS wrong
FROM raw""")
def invalid_values(spark, sf_dir):
    records = raw_records(spark, sf_dir)
    wrong = validate.invalid_values(fn.normalize_attrs(F.col("attrs")))
    return records.select(F.col("eventId").alias("event_id"), attrs_text(wrong).alias("wrong"))


@register("validate_simulator", EVENTS_SQL + """
SELECT CASE WHEN user_id = 0 THEN 'user_id required in attrs'
  WHEN type = 'MESSAGE_SENT' THEN 'Unknown attribute for MESSAGE_SENT: payload'
  WHEN type = 'MESSAGE_READ' THEN 'Unknown attribute for MESSAGE_READ: source'
  WHEN type = 'MODERATION_FLAG' THEN 'Unknown attribute for MODERATION_FLAG: lang' END AS error, count(*) AS count
FROM ev GROUP BY 1""")
def validate_simulator(spark, sf_dir):
    records = normalize.to_records(event_table(spark, sf_dir), SIMULATOR)
    return validate.validate(records, SIMULATOR).groupBy("error").agg(F.count("*").alias("count"))


@register("generated_records_pass", """
SELECT count(*) AS count, 0 AS refused FROM events""", events=False)
def generated_records_pass(spark, sf_dir):
    ids = source_events(spark, sf_dir).select("event_id")
    records = generate_events(ids, seed=7, as_of=AS_OF, id_column="event_id")
    return validate.validate(records, SERVICE).agg(
        F.count("*").alias("count"), F.count("error").cast("int").alias("refused"))
