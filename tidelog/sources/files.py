"""Batch readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import EVENT_SCHEMA, LEGACY_EVENT_SCHEMA, RECORD_SCHEMA
from tidelog.session import prepare


def read_events(spark: SparkSession, path: str, extra: list[T.StructField] | None = None) -> DataFrame:
    """The stored event table: the committed rows of an event store, or a folder of files.

    The partition column and the hot columns are found in the files; pass
    ``extra`` to name them and skip schema discovery on a table of many files.
    """
    from tidelog.sources.store import EventStore, is_store

    if is_store(prepare(spark), path):
        return EventStore(spark, path).read()
    if extra is not None:
        return spark.read.schema(T.StructType(EVENT_SCHEMA.fields + extra)).parquet(path)
    return spark.read.parquet(path)


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Records from files of one JSON object per line; unknown fields are ignored."""
    return prepare(spark).read.schema(RECORD_SCHEMA).json(path)


def read_ndjson(spark: SparkSession, path: str, max_events: int | None = None,
                schema: T.StructType = LEGACY_EVENT_SCHEMA) -> DataFrame:
    """Older events from NDJSON, blank lines skipped, at most ``max_events`` of them.

    These are the first ones, by file name and then by place in the file, whatever task reads them.
    """
    lines = prepare(spark).read.text(path).filter(F.trim("value") != "")
    if max_events is not None:
        # A task reads its pieces of files from their start on, so that within a piece the row number is the order.
        place = {"_name": "_metadata.file_name", "_file": "_metadata.file_path", "_at": "_metadata.file_block_start"}
        lines = lines.select("value", *[F.col(c).alias(n) for n, c in place.items()],
                             F.monotonically_increasing_id().alias("_row")).orderBy(*place, "_row").limit(max_events)
    # Exploded from a one-element array, so that the limit stays at its order: a top-k, not a sort of all lines.
    return lines.select(F.explode(F.array(F.from_json("value", schema))).alias("e")).select("e.*")


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    # A missing amount is written as null, like every other field.
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = LEGACY_EVENT_SCHEMA) -> DataFrame:
    return prepare(spark).read.schema(schema).option("header", True).csv(path)


def save_batch(records: DataFrame, root: str, batch: str | None = None, batch_size: int | None = None,
               refuse: str = "quarantine", max_refused: int | None = None, as_of=None) -> dict | None:
    """Check records and append them to the event store at ``root`` as one batch: good ones to all layouts, the others as refused.

    Records are checked once, in the pass that writes them. Rows of a day come together before the write, a large day in
    several tasks, so files are few whatever the
    number of tasks. ``batch_size``, if given, caps the rows of a file. With ``refuse="failfast"`` one bad
    record fails the whole batch and nothing is written.
    """
    from tidelog.operators.normalize import to_event_rows
    from tidelog.operators.validate import ERROR, split_valid, validate
    from tidelog.sources.store import EventStore

    if refuse == "failfast":
        rows = to_event_rows(split_valid(records, mode=refuse)[0], as_of)
    elif refuse == "quarantine":
        checked = validate(records).withColumn(
            "value", F.when(F.col(ERROR).isNotNull(), F.to_json(F.struct(*records.columns))))
        rows = to_event_rows(checked, as_of, keep=("value", ERROR))
    else:
        raise ValueError(f"unknown mode: {refuse}")
    return EventStore(records.sparkSession, root).append(rows, batch, max_refused, rows_per_file=batch_size)


def bulk_insert(rows: DataFrame, root: str, batch: str | None = None) -> dict | None:
    """Append finished event rows to all layouts of the event store at ``root``."""
    from tidelog.sources.store import EventStore

    return EventStore(rows.sparkSession, root).append(rows, batch)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd HH:mm:ss",
                                               "ignoreNullFields": "false"}).alias("value"))


def to_publish_frame(events: DataFrame) -> DataFrame:
    """Event rows as topic messages: the record type as key, the JSON row as value."""
    row = F.struct(
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        F.date_format("ingest_time", "yyyy-MM-dd HH:mm:ss").alias("ingest_time"),
        "record_type", F.col("event_id").cast("string").alias("event_id"),
        "user_id", "chat_id", "message_id", "attrs")
    return events.select(F.col("record_type").alias("key"), F.to_json(row).alias("value"))


def publish(events: DataFrame, fmt: str = "kafka", options: dict[str, str] | None = None) -> None:
    """Write messages to a topic, or as text lines for tests and replays."""
    messages = to_publish_frame(events)
    if fmt == "text":
        messages = messages.select("value")
    messages.write.format(fmt).options(**(options or {})).save()


def run_noop(df: DataFrame) -> None:
    """Run the whole query and throw the output away."""
    df.write.format("noop").mode("overwrite").save()
