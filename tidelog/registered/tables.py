"""Writers, readers and layouts, each writing a table to the scratch folder and reading it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import search, validate
from tidelog.operators.aggregate import group_attr
from tidelog.operators.filters import filter_attr, time_range
from tidelog.plans.scenarios import type_mix
from tidelog.registered.base import RECORDS_SQL, attrs_text, flat, register
from tidelog.session import scratch_path
from tidelog.sources import files, layout
from tidelog.sources.store import EventStore
from tidelog.sources.tables import event_table, raw_records, source_events, uuid_of

_COLUMNS = "event_time, ingest_time, record_type, event_id, user_id, chat_id, message_id, attrs_text"


def _stored(spark, sf_dir, label, **options):
    """A freshly written base layout of the event table."""
    path = scratch_path(spark, label)
    layout.write_events(event_table(spark, sf_dir), path, **options)
    return path


@register("daily_partitions", """
SELECT CAST(event_time AS DATE) AS event_date, count(*) AS count, min(event_time) AS first_time,
  max(event_time) AS last_time FROM ev GROUP BY 1""")
def daily_partitions(spark, sf_dir):
    stored = files.read_events(spark, _stored(spark, sf_dir, "daily"))
    return stored.groupBy("event_date").agg(
        F.count("*").alias("count"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))


@register("user_layout", """
SELECT event_id, user_id, record_type, event_time, lang AS attr_lang, source AS attr_source,
  CAST(coalesce(try_cast(nullif(moderation_score, '') AS INTEGER), 0) AS INTEGER) AS attr_score, attrs_text
FROM evt WHERE user_id = 7""")
def user_layout(spark, sf_dir):
    stored = files.read_events(spark, _stored(spark, sf_dir, "by-user"))
    return stored.filter(F.col("user_id") == 7).select(
        "event_id", "user_id", "record_type", "event_time", "attr_lang", "attr_source", "attr_score",
        attrs_text().alias("attrs_text"))


@register("type_layout", """
SELECT event_id, event_time, amount_cents FROM ev WHERE record_type = 'PURCHASE'
  AND event_time >= TIMESTAMP '2024-01-10 00:00:00' AND event_time <= TIMESTAMP '2024-01-12 12:00:00'""")
def type_layout(spark, sf_dir):
    paths = layout.write_layouts(event_table(spark, sf_dir), scratch_path(spark, "layouts"))
    table = layout.read_layout(spark, paths, ("record_type", "event_time"))
    wanted = time_range(table, "2024-01-10", "2024-01-12 12:00:00").filter(F.col("record_type") == "PURCHASE")
    return wanted.select("event_id", "event_time", F.col("attrs")["amount_cents"].alias("amount_cents"))


@register("layout_appends", """
SELECT event_id, event_time, user_id, record_type, attrs_text, CAST(event_time AS DATE) AS event_date, layout, 1 AS copies
FROM evt, (SELECT unnest(['by_user', 'by_type']) AS layout)""")
def layout_appends(spark, sf_dir):
    """Three batches, one of them sent twice, and one that failed before its commit: each layout holds every event once."""
    events, root = event_table(spark, sf_dir), scratch_path(spark, "layouts")
    store = EventStore(spark, root)
    for part in (0, 1, 1, 2):
        store.append(events.filter(F.col("event_id") % 3 == part), f"part-{part}")
    # What a failed batch leaves: files without a commit.
    store.placed(events).write.partitionBy("layout", "event_date").parquet(f"{root}/data/batch=failed")
    both = [store.read(filters).withColumn("layout", F.lit(name)) for name, filters in (
        ("by_user", ["user_id"]), ("by_type", ["record_type"]))]
    columns = ["event_id", "event_time", "user_id", "record_type", "attrs_text", "event_date", "layout"]
    return flat(both[0].unionByName(both[1])).groupBy(*columns).agg(F.count("*").cast("int").alias("copies"))


@register("search_stored", """
SELECT event_id, event_time FROM ev WHERE lang = 'ru' AND source = 'web' ORDER BY event_time DESC, event_id DESC
LIMIT 300""")
def search_stored(spark, sf_dir):
    path = _stored(spark, sf_dir, "search")
    return search.search(files.read_events(spark, path), {"lang": "ru", "source": "web"}, 300).select(
        "event_id", "event_time")


@register("bloom_lookup", """
SELECT count(*) AS count, min(event_time) AS first_time, max(event_time) AS last_time FROM ev WHERE chat_id = 77""")
def bloom_lookup(spark, sf_dir):
    path = _stored(spark, sf_dir, "bloom", bloom={"chat_id": 128})
    return search.summary(files.read_events(spark, path), chat_id=77)


@register("hot_columns", """
SELECT event_id, lang AS attr_lang, source AS attr_source, length(payload) AS payload_length FROM ev""")
def hot_columns(spark, sf_dir):
    specs = (
        layout.HotColumn("attr_lang", "lang"), layout.HotColumn("attr_source", "source"),
        layout.HotColumn("payload_length", "payload", "bigint", "length(coalesce(attrs['payload'], ''))"))
    return layout.add_hot_columns(event_table(spark, sf_dir), specs).select(
        "event_id", "attr_lang", "attr_source", "payload_length")


@register("filter_attribute_stored", """
SELECT event_id, event_time, source FROM ev WHERE lang = 'ru'""")
def filter_attribute_stored(spark, sf_dir):
    table = files.read_events(spark, _stored(spark, sf_dir, "filtered"))
    return filter_attr(table, "lang", "ru").select("event_id", "event_time", F.col("attr_source").alias("source"))


@register("hot_columns_status", """
SELECT unnest(['attr_lang', 'attr_source', 'attr_score', 'attr_gender']) AS name,
  unnest(['lang', 'source', 'moderation_score', 'gender']) AS "sourceKey", unnest([true, true, false, false]) AS exists,
  unnest([count(*) FILTER (lang <> ''), count(*) FILTER (source <> ''), count(*) FILTER (moderation_score <> ''),
    count(*) FILTER (gender <> '')]) AS filled FROM ev""")
def hot_columns_status(spark, sf_dir):
    """Which columns a stored table has, and in how many rows their attribute is given."""
    has = (layout.HotColumn("attr_lang", "lang"), layout.HotColumn("attr_source", "source"))
    asked = (*has, layout.HotColumn("attr_score", "moderation_score", "int"), layout.HotColumn("attr_gender", "gender"))
    table = files.read_events(spark, _stored(spark, sf_dir, "status", hot=has))
    counts = table.agg(F.map_from_arrays(F.array(*[F.lit(c.name) for c in asked]), F.array(*[
        F.count_if(F.coalesce(F.col("attrs")[c.source_key], F.lit("")) != "") for c in asked])).alias("m")).select(
        F.explode("m").alias("name", "filled"))
    return layout.hot_columns_status(table, asked).join(counts, "name").select("name", "sourceKey", "exists", "filled")


@register("apply_hot_columns", """
SELECT type AS value, count(*) AS count, 'attr_type' AS created, 'attr_lang' AS skipped, 1 AS errors
FROM ev GROUP BY type""")
def apply_hot_columns(spark, sf_dir):
    path = _stored(spark, sf_dir, "before", hot=(layout.HotColumn("attr_lang", "lang"),))
    done = layout.apply_hot_columns(spark, path, scratch_path(spark, "after"), (
        layout.HotColumn("attr_lang", "lang"), layout.HotColumn("attr_type", "type"),
        layout.HotColumn("attr_bad", "type", "int", "no_such_column + 1")))
    counts = group_attr(files.read_events(spark, done["path"]), "type", hot=True)
    return counts.withColumns({
        "created": F.lit(",".join(done["created"])), "skipped": F.lit(",".join(done["skipped"])),
        "errors": F.lit(len(done["errors"]))})


def _read_whole(df):
    """Rows, files and bytes as a plain read of the table finds them."""
    files = df.groupBy("_metadata.file_path").agg(F.count("*").alias("n"), F.first("_metadata.file_size").alias("size"))
    return files.agg(F.sum("n").alias("rows"), F.count("*").alias("files"), F.sum("size").alias("bytes"))


@register("file_stats", """
SELECT count(*) AS rows, true AS same_rows, true AS same_files, true AS same_bytes FROM events""", events=False)
def file_stats(spark, sf_dir):
    """Listing and footers against a read of all rows."""
    path = _stored(spark, sf_dir, "stats")
    stats, read = layout.file_stats(spark, path), _read_whole(spark.read.parquet(path)).first()
    return stats.select("rows", *[(F.col(n) == read[n]).alias(f"same_{n}") for n in ("rows", "files", "bytes")])


@register("layout_stats", """
SELECT unnest(['by_user', 'by_type']) AS layout, 2 * (SELECT count(*) FROM events) AS rows, true AS same_files,
  true AS same_bytes""", events=False)
def layout_stats(spark, sf_dir):
    """Two committed batches in two layouts."""
    store = EventStore(spark, scratch_path(spark, "layout-stats"))
    for name in ("first", "second"):
        store.append(event_table(spark, sf_dir), name)
    out = None
    for name in store.layouts:
        read = _read_whole(spark.read.option("basePath", f"{store.root}/data").parquet(*store.paths(name))).first()
        row = store.stats().filter(F.col("layout") == name).select(
            "layout", "rows", *[(F.col(n) == read[n]).alias(f"same_{n}") for n in ("files", "bytes")])
        out = row if out is None else out.unionByName(row)
    return out


@register("latest_rows", """
SELECT event_id, event_time, record_type FROM ev ORDER BY event_time DESC, event_id DESC LIMIT 5""")
def latest_rows(spark, sf_dir):
    return search.latest(event_table(spark, sf_dir)).select("event_id", "event_time", "record_type")


@register("row_count", "SELECT count(*) AS count FROM events", events=False)
def row_count(spark, sf_dir):
    return event_table(spark, sf_dir).agg(F.count("*").alias("count"))


@register("save_batch", RECORDS_SQL + """
SELECT CASE WHEN error IS NOT NULL THEN 'refused' WHEN activity = 'REGISTRATION' THEN 'SYSTEM'
    WHEN activity = 'PURCHASE_COMPLETED' THEN 'PURCHASE' WHEN activity = 'MODERATION_FLAG' THEN 'MODERATION'
    ELSE 'MESSAGE' END AS kind, error, CASE WHEN error IS NULL THEN user_number END AS user_id,
  CASE WHEN error IS NULL THEN event_time END AS event_time, count(*) AS count FROM checked GROUP BY ALL""")
def save_batch(spark, sf_dir):
    root = scratch_path(spark, "batch")
    files.save_batch(raw_records(spark, sf_dir), root)
    store = EventStore(spark, root)
    saved = store.read().select(F.col("record_type").alias("kind"), F.lit(None).cast("string").alias("error"), "user_id", "event_time")
    rejected = store.refused().select(F.lit("refused").alias("kind"), "error", F.lit(None).cast("bigint").alias("user_id"),
                                      F.lit(None).cast("timestamp").alias("event_time"))
    return saved.unionByName(rejected).groupBy("kind", "error", "user_id", "event_time").agg(F.count("*").alias("count"))


@register("bulk_insert", f"""
SELECT {_COLUMNS}, CAST(event_time AS DATE) AS event_date, lang AS attr_lang, 2 AS copies FROM evt""")
def bulk_insert(spark, sf_dir):
    root = scratch_path(spark, "bulk")
    for _ in range(2):
        files.bulk_insert(event_table(spark, sf_dir), root)
    columns = [c.strip() for c in _COLUMNS.split(",")] + ["event_date", "attr_lang"]
    return flat(files.read_events(spark, root)).groupBy(*columns).agg(F.count("*").cast("int").alias("copies"))


@register("json_rows_to_records", RECORDS_SQL + "SELECT event_id, error FROM checked")
def json_rows_to_records(spark, sf_dir):
    path = scratch_path(spark, "json-rows")
    raw_records(spark, sf_dir).withColumn("userId", F.lit(1)).write.json(path)
    return validate.validate(files.read_json_rows(spark, path)).select(F.col("eventId").alias("event_id"), "error")


def _legacy_events(spark, sf_dir, sort=False):
    """The events in the flat shape of the older interface, by id on demand; only purchases have an amount."""
    source = source_events(spark, sf_dir)
    if sort:
        source = source.orderBy(F.asc_nulls_last("event_id"))
    k = F.get_json_object("props", "$.k")
    return source.select(
        uuid_of(F.col("event_id")).alias("eventId"), F.col("event_type").alias("eventType"),
        F.concat(F.lit("user \"é\" "), F.col("user_id").cast("string")).alias("userId"),
        F.concat(F.lit("sess,"), k).alias("sessionId"), F.concat(F.lit("10.0.0."), k).alias("ipAddress"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"), F.lit("replay").alias("source"),
        F.col("event_id").alias("index"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))


_LEGACY = """
SELECT printf('00000000-0000-7000-8000-%012x', event_id) AS "eventId", event_type AS "eventType",
  'user "é" ' || user_id AS "userId", 'sess,' || json_extract_string(props, '$.k') AS "sessionId",
  '10.0.0.' || json_extract_string(props, '$.k') AS "ipAddress",
  CASE WHEN event_type = 'purchase' THEN value END AS amount, 'replay' AS source, event_id AS "index",
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp" FROM events"""


@register("ndjson_round_trip", _LEGACY, events=False)
def ndjson_round_trip(spark, sf_dir):
    path = scratch_path(spark, "ndjson")
    files.write_ndjson(_legacy_events(spark, sf_dir), path)
    return files.read_ndjson(spark, path)


@register("csv_round_trip", _LEGACY, events=False)
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(_legacy_events(spark, sf_dir), path)
    return files.read_csv(spark, path)


@register("replay_first_events", _LEGACY + " ORDER BY event_id LIMIT 750", events=False)
def replay_first_events(spark, sf_dir):
    """The first events of sorted files, as a replay takes them; each task sorts and writes one range of the order."""
    path = scratch_path(spark, "replay")
    files.write_ndjson(_legacy_events(spark, sf_dir, sort=True), path)
    return files.read_ndjson(spark, path, 750)


@register("json_row_output", """
SELECT '{"record_type":"' || record_type || '","count":' || count(*) || '}' AS value FROM ev GROUP BY record_type""")
def json_row_output(spark, sf_dir):
    return files.to_json_rows(type_mix(event_table(spark, sf_dir), 500))


# Attributes in the order in which the adapter puts them.
_ATTRS_JSON = "'{\"type\":\"' || type || '\"' || " + " || ".join(
    f"""coalesce(',"{n}":"' || nullif({n}, '') || '"', '')""" for n in (
        "lang", "source", "payload", "terminal_type", "user_active_status", "gender", "user_device_type", "org_hash",
        "amount_cents", "moderation_score")) + " || '}'"


@register("publish_messages", f"""
SELECT record_type AS key, '{{"event_time":"' || strftime(event_time, '%Y-%m-%d %H:%M:%S') || '","ingest_time":"'
  || strftime(ingest_time, '%Y-%m-%d %H:%M:%S') || '","record_type":"' || record_type || '","event_id":"'
  || event_id || '","user_id":' || user_id || ',"chat_id":' || chat_id || ',"message_id":' || message_id
  || ',"attrs":' || {_ATTRS_JSON} || '}}' AS value FROM ev""")
def publish_messages(spark, sf_dir):
    return files.to_publish_frame(event_table(spark, sf_dir))


@register("discard_output", "SELECT count(*) AS count FROM events", events=False)
def discard_output(spark, sf_dir):
    events = event_table(spark, sf_dir)
    files.run_noop(events)
    return events.agg(F.count("*").alias("count"))
