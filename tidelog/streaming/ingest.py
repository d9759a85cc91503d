"""Topic to event table with Structured Streaming."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidelog.catalogue import SERVICE, Catalogue
from tidelog.functions.identifiers import canonical_uuid
from tidelog.functions.times import parse_timestamp, to_second
from tidelog.operators.normalize import to_event_rows
from tidelog.operators.validate import ERROR, validate
from tidelog.schema import EVENT_SCHEMA, RECORD_SCHEMA, STREAM_SCHEMA
from tidelog.session import prepare
from tidelog.sources.layout import DEFAULT_HOT_COLUMNS, LAYOUTS
from tidelog.sources.store import EventStore

BROKEN = "_broken"
BROKEN_MESSAGE = "broken message"


def read_stream(spark: SparkSession, fmt: str = "kafka", options: dict[str, str] | None = None,
                path: str | None = None) -> DataFrame:
    """Messages as one text column ``value``, from a topic or from files of lines."""
    reader = prepare(spark).readStream.format(fmt).options(**(options or {}))
    raw = reader.load(path) if path else reader.load()
    return raw.select(F.col("value").cast("string").alias("value"))


def parse(raw: DataFrame, schema: T.StructType = STREAM_SCHEMA) -> DataFrame:
    """Fields of each message, its text as ``value``, and ``error`` if it is not JSON of this shape."""
    shape = T.StructType(schema.fields + [T.StructField(BROKEN, T.StringType())])
    row = F.from_json("value", shape, {"columnNameOfCorruptRecord": BROKEN})
    # Exploding a one-element array parses a message once. As a plain column the parse would be
    # copied into every later filter and field access that Spark moves below it.
    parsed = raw.select("value", F.explode(F.array(row)).alias("row"))
    broken = F.col("row").isNull() | F.col(f"row.{BROKEN}").isNotNull()
    return parsed.select(*[F.col(f"row.`{f.name}`") for f in schema.fields], "value", F.when(broken, BROKEN_MESSAGE).alias(ERROR))


def split_broken(raw: DataFrame, schema: T.StructType = STREAM_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and the text of messages that are not JSON of this shape."""
    parsed = parse(raw, schema)
    return parsed.filter(F.col(ERROR).isNull()).select(*schema.names), parsed.filter(
        F.col(ERROR).isNotNull()).select("value", ERROR)


def cast_rows(rows: DataFrame) -> DataFrame:
    """Topic rows with the types of the event table and ``error`` for those that cannot be cast; value and error are kept."""
    zero = F.lit(0).cast("bigint")
    empty = F.create_map().cast("map<string,string>")
    before = ERROR in rows.columns
    cast = rows.select(
        to_second(parse_timestamp(F.col("event_time"))).alias("event_time"),
        to_second(parse_timestamp(F.col("ingest_time"))).alias("ingest_time"),
        F.coalesce("record_type", F.lit("")).alias("record_type"),
        canonical_uuid(F.col("event_id")).alias("event_id"),
        F.coalesce("user_id", zero).alias("user_id"),
        F.coalesce("chat_id", zero).alias("chat_id"),
        F.coalesce("message_id", zero).alias("message_id"),
        F.coalesce("attrs", empty).alias("attrs"),
        *(["value", F.col(ERROR).alias("_before")] if before else []),
    )
    reason = (
        F.when(F.col("event_time").isNull(), "event_time is not a time")
        .when(F.col("ingest_time").isNull(), "ingest_time is not a time")
        .when(F.col("event_id").isNull(), "event_id is not a UUID")
    )
    return cast.withColumn(ERROR, F.coalesce("_before", reason) if before else reason).drop("_before")


def classify(raw: DataFrame, shape: str = "rows", catalogue: Catalogue = SERVICE, as_of=None) -> DataFrame:
    """Each message as an event row, or with ``value`` and ``error`` if it is refused; one pass, messages parsed once.

    ``shape="rows"`` takes finished event rows, ``"records"`` API records, which
    are also checked against the catalogue. A refused message that could be parsed is given as JSON of what was read.
    """
    if shape == "rows":
        checked = cast_rows(parse(raw, STREAM_SCHEMA))
        read, rows = EVENT_SCHEMA.names, checked
    elif shape == "records":
        parsed = parse(raw, RECORD_SCHEMA).withColumnRenamed(ERROR, "_broken_as")
        checked = validate(parsed, catalogue).withColumn(ERROR, F.coalesce("_broken_as", ERROR))
        read = RECORD_SCHEMA.names
        rows = to_event_rows(checked.select(*read, F.struct(*read).alias("_read"), "value", ERROR), as_of, catalogue,
                             keep=("_read", "value", ERROR))
    else:
        raise ValueError(f"unknown shape: {shape}")
    shown = F.to_json(F.struct(*read) if shape == "rows" else F.col("_read"))
    value = F.when(F.col(ERROR) == BROKEN_MESSAGE, F.col("value")).when(F.col(ERROR).isNotNull(), shown)
    return rows.select(*EVENT_SCHEMA.names, value.alias("value"), ERROR)


def event_rows(raw: DataFrame, shape: str = "rows", catalogue: Catalogue = SERVICE,
               as_of=None) -> tuple[DataFrame, DataFrame]:
    """Messages to event rows and refused messages (value, error)."""
    classified = classify(raw, shape, catalogue, as_of)
    good = classified.filter(F.col(ERROR).isNull()).select(*EVENT_SCHEMA.names)
    return good, classified.filter(F.col(ERROR).isNotNull()).select("value", ERROR)


def start_ingest(raw: DataFrame, root: str, checkpoint: str, shape: str = "rows", max_broken: int | None = None,
                 trigger: dict | None = None, hot=DEFAULT_HOT_COLUMNS, catalogue: Catalogue = SERVICE,
                 as_of=None, layouts=tuple(LAYOUTS), name: str | None = None) -> list[StreamingQuery]:
    """Append a stream of messages to the event store at ``root``: all layouts, and the refused messages.

    Every micro-batch is one batch of the store, named after the stream and its number, written in one pass and committed
    once, so that a restart from the checkpoint, or a replay, writes each message once. With ``max_broken`` the stream
    stops with an error at a micro-batch that holds more refused messages than that, and nothing of it is committed.
    ``name`` tells streams into one store apart; by default it comes from the checkpoint's path.
    """
    store = EventStore(raw.sparkSession, root, layouts, hot)
    stream = name or hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(classify(batch, shape, catalogue, as_of), f"{stream}-{batch_id:012d}", max_broken)

    return [raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()]


def finish(queries: list[StreamingQuery]) -> None:
    """Wait for bounded queries; if one fails, stop the others and raise its error."""
    try:
        for query in queries:
            query.awaitTermination()
    finally:
        for query in queries:
            if query.isActive:
                query.stop()


def write_stream(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                 partition_by: list[str] | None = None) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()


def publish_stream(events: DataFrame, checkpoint: str, fmt: str = "kafka", options: dict[str, str] | None = None,
                   trigger: dict | None = None) -> StreamingQuery:
    """Publish a stream of event rows as topic messages."""
    from tidelog.sources.files import to_publish_frame

    messages = to_publish_frame(events)
    if fmt == "text":
        messages = messages.select("value")
    return messages.writeStream.format(fmt).options(**(options or {})).outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
