"""Seeded synthetic events.

Values are hashes of (row id, name, seed), so a row depends on nothing but its
id: tasks share no random state, a retried task makes the same rows, and any id
column, not only a range, can drive the generator. The hash is whole-number
arithmetic that every SQL engine has, which makes the output checkable.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalogue import SERVICE, SIMULATOR, Catalogue
from tidelog.functions.records import constant
from tidelog.functions.times import as_instant
from tidelog.sources.tables import ORG_HASHES

# Smallest value and number of values of each whole-number attribute.
LONG_RANGES = {
    "user_id": (1, 500_000),
    "chat_id": (1, 100_000),
    "message_id": (1, 50_000_000),
    "channel_id": (1, 10_000),
    "thread_id": (1, 5_000_000),
    "source_chat_id": (1, 100_000),
    "other_user_id": (1, 500_000),
    "message_length": (1, 4_096),
    "moderation_score": (0, 101),
    "report_count": (1, 500),
    "amount_cents": (100, 100_000),
    "member_count": (2, 100_000),
    "file_size_kb": (1, 102_400),
    "call_duration_sec": (1, 7_200),
    "participant_count": (2, 100),
    "attachment_count": (1, 10),
    "query_length": (1, 200),
}
# Pools of free-text attributes.
COUNTRY_CODES = ("RU", "US", "DE", "FR", "GB", "CN", "JP")
TIMEZONES = ("Europe/Moscow", "America/New_York", "Europe/Berlin", "Asia/Tokyo", "UTC")
MIME_TYPES = ("image/jpeg", "image/png", "video/mp4", "application/pdf", "audio/mpeg")
# Pools of the bulk rows.
BULK_TYPES = ("MESSAGE", "MODERATION", "PURCHASE", "SYSTEM", "OTHER")
BULK_LANGS = ("ru", "en", "de", "fr")
BULK_SOURCES = ("web", "ios", "android")
LEGACY_TYPES = ("login", "logout", "purchase", "click", "view")


PRIME = 2_147_483_647


def salt_of(name: str, seed: int) -> int:
    """Number that sets the draws of one name apart from those of another."""
    return zlib.crc32(f"{name}:{seed}".encode()) % PRIME


def mixed(row_id: Column, salt: Column) -> Column:
    """A number below PRIME that looks unrelated for neighbouring ids and for other salts.

    Two squarings between linear steps; every product stays below 2**62.
    """
    prime = F.lit(PRIME).cast("bigint")
    x = (F.pmod(row_id.cast("bigint"), prime) * 48_271 + salt) % prime
    x = (x * x + salt) % prime
    x = (x * 16_807 + salt) % prime
    return (x * x + salt) % prime


class Draws:
    """Repeatable draws for one row: each name gives an independent number."""

    def __init__(self, row_id: Column, seed: int):
        self.row_id, self.seed = row_id, seed

    def below(self, name: str, n: int) -> Column:
        return mixed(self.row_id, F.lit(salt_of(name, self.seed)).cast("bigint")) % n

    def pick(self, name: str, values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (self.below(name, len(values)) + 1).cast("int"))

    def digits(self, name: str, low: int, count: int) -> Column:
        return (self.below(name, count) + low).cast("string")


def row_ids(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, partitions) if partitions else spark.range(n)


def _rule(name: str, seed: int, catalogue: Catalogue) -> dict:
    """How an attribute's value is made: one of a pool, or a number behind a prefix."""
    spec = catalogue.attributes[name]
    pools = {
        "org_hash": ORG_HASHES, "country_code": COUNTRY_CODES, "timezone": TIMEZONES, "mime_type": MIME_TYPES,
        "platform_version": [f"{a}.{b}" for a in range(8, 16) for b in range(10)],
        "app_version": [f"3.{a}.{b}" for a in range(10) for b in range(21)],
    }
    rule = {"name": name, "salt": salt_of(name, seed)}
    pool = ("1", "0") if spec.kind == "flag" else spec.allowed or pools.get(name)
    if pool:
        return {**rule, "pool": list(pool), "count": len(pool)}
    if spec.kind == "long":
        prefix, (low, count) = "", LONG_RANGES.get(name, (0, 10_000))
    else:
        prefix, low, count = {"session_id": ("sess-", 100_000, 900_000), "product_id": ("prod-", 1, 200)}.get(
            name, ("val-", 0, 10_000))
    return {**rule, "prefix": prefix, "low": low, "count": count}


def generate_events(ids: DataFrame, seed: int = 42, catalogue: Catalogue = SERVICE, as_of=None,
                    id_column: str = "id") -> DataFrame:
    """Valid records, one per id, uniform over the activities of the catalogue.

    Event times fall in the day before ``as_of``. The attributes of the row's
    own activity are made from constant tables of value rules.
    """
    draw = Draws(F.col(id_column), seed)
    now = as_instant(as_of)
    back = F.make_dt_interval(secs=draw.below("timestamp", 86_400).cast("decimal(18,6)"))
    rules = {activity: [_rule(name, seed, catalogue) for name in extras]
             for activity, extras in catalogue.extras.items()}
    rule_type = "struct<name:string,salt:bigint,pool:array<string>,prefix:string,low:bigint,count:bigint>"

    def value(rule: Column) -> Column:
        number = mixed(F.col("_row"), rule["salt"]) % rule["count"]
        return F.when(rule["pool"].isNotNull(), F.get(rule["pool"], number.cast("int"))).otherwise(
            F.concat(rule["prefix"], (number + rule["low"]).cast("string")))

    staged = ids.select(
        F.col(id_column).alias("_row"), draw.pick("type", catalogue.activities).alias("activityType"),
        F.date_trunc("second", now - back).alias("eventTime"), F.date_trunc("second", now).alias("ingestTime"),
        draw.digits("user_id", *LONG_RANGES["user_id"]).alias("_user"),
    ).withColumn("_rules", constant(rules, f"array<{rule_type}>")[F.col("activityType")])
    fixed = [F.lit("type"), F.col("activityType"), F.lit("user_id"), F.col("_user")]
    if catalogue is SIMULATOR:
        fixed += [F.lit("timestamp"), F.unix_millis("eventTime").cast("string")]
    attrs = F.map_concat(F.create_map(*fixed), F.map_from_arrays(F.col("_rules.name"), F.transform("_rules", value)))
    return staged.select(
        "activityType", "eventTime", "ingestTime", F.col("_row").cast("string").alias("eventId"), attrs.alias("attrs"))


def generate_bulk(ids: DataFrame, seed: int = 42, as_of=None, id_column: str = "id") -> DataFrame:
    """Plain event-table rows with language, source and a payload."""
    from tidelog.functions.identifiers import uuid7

    draw = Draws(F.col("_row"), seed)
    now = as_instant(as_of)
    back = F.make_dt_interval(secs=draw.below("event_time", 86_400).cast("decimal(18,6)"))
    rows = ids.select(F.col(id_column).alias("_row")).select(
        F.date_trunc("second", now - back).alias("event_time"),
        F.date_trunc("second", now).alias("ingest_time"),
        draw.pick("record_type", BULK_TYPES).alias("record_type"),
        (draw.below("user_id", 500) + 1).alias("user_id"),
        (draw.below("chat_id", 800) + 1).alias("chat_id"),
        draw.below("message_id", 10_000_000).alias("message_id"),
        F.create_map(
            F.lit("lang"), draw.pick("lang", BULK_LANGS),
            F.lit("source"), draw.pick("source", BULK_SOURCES),
            F.lit("payload"), F.repeat(F.lit("x"), (draw.below("payload", 100) + 20).cast("int"))).alias("attrs"),
    )
    return rows.withColumn("event_id", uuid7(F.col("event_time"))).select(
        "event_time", "ingest_time", "record_type", "event_id", "user_id", "chat_id", "message_id", "attrs")


def generate_legacy(ids: DataFrame, seed: int = 42, as_of=None, id_column: str = "id") -> DataFrame:
    """Flat nine-field events; only purchases have an amount."""
    draw = Draws(F.col("_row"), seed)
    kind = draw.pick("eventType", LEGACY_TYPES)
    digest = F.md5(F.concat_ws(":", F.col("_row").cast("string"), F.lit(str(seed))))
    event_id = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
                           F.concat(F.lit("4"), F.substring(digest, 14, 3)),
                           F.concat(F.lit("a"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    return ids.select(F.col(id_column).alias("_row")).select(
        event_id.alias("eventId"),
        kind.alias("eventType"),
        F.concat(F.lit("user-"), draw.digits("userId", 1, 5_000)).alias("userId"),
        F.concat(F.lit("sess-"), draw.digits("sessionId", 1, 100_000)).alias("sessionId"),
        F.concat_ws(".", F.lit("10"), draw.digits("ip2", 0, 256), draw.digits("ip3", 0, 256),
                    draw.digits("ip4", 1, 254)).alias("ipAddress"),
        F.when(kind == "purchase", (draw.below("amount", 499_901) + 100) / 100.0).alias("amount"),
        F.lit("offline-perf").alias("source"),
        F.col("_row").cast("bigint").alias("index"),
        F.date_format(as_instant(as_of), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
    )
