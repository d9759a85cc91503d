"""Event tables made from the generic ``events`` table (event_id, ts, user_id,
event_type, value, props) that comes with the test data.

The mapping is a fixed rule on ``event_type`` and on ``k``, the number inside
``props``; every query on it reads the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.catalogue import SERVICE
from tidelog.functions.attributes import HOT_PREFIX
from tidelog.functions.records import constant
from tidelog.session import prepare

# Activity type, record type for each source event type.
ACTIVITY_OF = {
    "signup": "REGISTRATION",
    "click": "MESSAGE_SENT",
    "view": "MESSAGE_READ",
    "purchase": "PURCHASE_COMPLETED",
    "error": "MODERATION_FLAG",
}
# Organisation hashes; the first four are the ones the heavy query asks for.
ORG_HASHES = (
    "-7207924629501764854",
    "-4231934642844376041",
    "1136490941434531770",
    "4369003663347448391",
    "9876543210123456789",
    "1111222233334444555",
)

SOURCE_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.schema(SOURCE_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def adapt(source: DataFrame, hot: tuple[str, ...] = ()) -> DataFrame:
    """The stored event table, ids kept as numbers.

    ``hot`` names attributes to give as columns of their own too, as a table
    with materialized hot columns has them.
    """
    kind = F.col("event_type")
    base = source.withColumns({
        "k": F.get_json_object("props", "$.k").cast("bigint"),
        "event_time": F.date_trunc("second", F.col("ts").cast("timestamp")),
    })
    k = F.col("k")
    signup, purchase, error = (kind == x for x in ("signup", "purchase", "error"))
    in_chat = kind.isin("click", "view", "error")
    lang = _pick(SERVICE.attributes["lang"].allowed, k)
    origin = _pick(SERVICE.attributes["source"].allowed, k)
    # Every source event type has a fixed set of attributes.
    attrs = {
        "signup": {
            "lang": lang,
            "terminal_type": F.when(k % 10 == 0, "BASIC").otherwise("ONEME"),
            "user_active_status": F.when(k % 5 == 0, "0").otherwise("1"),
            "gender": (k % 2).cast("string"),
            "user_device_type": F.when(F.col("user_id") % 2 == 0, "ANDROID").otherwise("IOS"),
            "org_hash": _pick(ORG_HASHES, k),
        },
        "click": {"lang": lang, "source": origin, "payload": F.repeat(F.lit("x"), (k % 50 + 20).cast("int"))},
        "view": {"source": origin},
        "purchase": {"amount_cents": F.bround(F.col("value") * 100).cast("bigint").cast("string")},
        "error": {"lang": lang, "source": origin, "moderation_score": k.cast("string")},
    }
    attrs = {name: {"type": F.lit(ACTIVITY_OF[name]), **values} for name, values in attrs.items()}
    attr_map = F
    for name, entries in attrs.items():
        attr_map = attr_map.when(kind == name, F.create_map(*[x for n, v in entries.items() for x in (F.lit(n), v)]))
    record_type = F.when(signup, "SYSTEM").when(purchase, "PURCHASE").when(error, "MODERATION").otherwise("MESSAGE")
    zero = F.lit(0).cast("bigint")
    return base.select(
        "event_time",
        (F.col("event_time") + F.make_dt_interval(secs=k.cast("decimal(18,6)"))).alias("ingest_time"),
        record_type.alias("record_type"),
        "event_id",
        "user_id",
        F.when(in_chat, k + 1).otherwise(zero).alias("chat_id"),
        F.when(in_chat, F.col("event_id")).otherwise(zero).alias("message_id"),
        attr_map.alias("attrs"),
        *[_one_attribute(attrs, key).alias(HOT_PREFIX + key) for key in hot],
    )


def _one_attribute(attrs: dict[str, dict[str, Column]], key: str) -> Column:
    value = F
    for name, entries in attrs.items():
        if key in entries:
            value = value.when(F.col("event_type") == name, entries[key])
    return value.otherwise(F.lit(""))


def event_table(spark: SparkSession, sf_dir: str, hot: tuple[str, ...] = ()) -> DataFrame:
    return adapt(source_events(spark, sf_dir), hot)


def uuid_of(number: Column) -> Column:
    """A UUID text that ends in the number."""
    return F.concat(F.lit("00000000-0000-7000-8000-"), F.lower(F.lpad(F.hex(number), 12, "0")))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as incoming records, with mixed-case keys and a few defects by ``k``.

    The id is a UUID made of the event id, blank if k is a multiple of 7.
    k=3 no user id, k=5 user id is text, k=7 no activity anywhere, k=9 wrong
    activity in attrs, k=11 no event time, k=13 (clicks) a bad message length,
    k=15 (clicks) an unknown language, k=17 no attributes at all.
    """
    source = source_events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    k = F.col("k")
    time_text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # The lambda parses k once per row, wherever Spark moves the map to.
    attrs = F.transform(F.array(F.struct("k", "event_id", "user_id", "event_type", "value")), _messy_attrs)[0]
    return source.select(
        F.when((k % 2 == 1) & (k != 7), constant(ACTIVITY_OF)[F.col("event_type")]).alias("activityType"),
        F.when(k != 11, time_text).alias("eventTime"),
        time_text.alias("ingestTime"),
        F.when(k % 7 == 0, "").otherwise(uuid_of(F.col("event_id"))).alias("eventId"),
        attrs.alias("attrs"),
    )


def _messy_attrs(row: Column) -> Column:
    k, kind = row["k"], row["event_type"]
    activity = constant(ACTIVITY_OF)[kind]
    click, purchase, chat = kind == "click", kind == "purchase", kind.isin("click", "view", "error")
    pairs = {
        "USER_ID": F.when(k == 3, " ").when(k == 5, "u-5").otherwise(
            F.concat(F.lit(" "), row["user_id"].cast("string"))),
        "Type": F.when(k == 9, "LOGOUT").when(k % 4 == 0, F.lower(activity)).when(k % 4 == 2, activity),
        "chat_id": F.when(chat, (k + 1).cast("string")),
        "Message_Id": F.when(chat, row["event_id"].cast("string")),
        "message_length": F.when(click, F.when(k == 13, "long").otherwise((k + 20).cast("string"))),
        "LANG": F.when(click, F.when(k == 15, "xx").otherwise(_pick(SERVICE.attributes["lang"].allowed, k))),
        "is_reply": F.when(click, F.when(k % 3 == 0, "TRUE").otherwise("0")),
        "amount_cents": F.when(purchase, F.bround(row["value"] * 100).cast("bigint").cast("string")),
        "session_id": F.when(kind == "signup", F.concat(F.lit("s-"), k.cast("string"))),
        "gender": F.when((kind == "signup") & (k >= 50), "1"),
        "moderation_score": F.when(kind == "error", k.cast("string")),
    }
    entries = F.map_filter(
        F.create_map(*[x for n, v in pairs.items() for x in (F.lit(n), v)]), lambda n, v: v.isNotNull())
    return F.when(k != 17, entries)
