"""Point reads, searches and pages of the event table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.json_text import PARSED, document_of, json_int, variant_int, variant_string
from tidelog.operators.filters import first_rows, newest_first, order, search_predicates
from tidelog.operators.pages import RankIndex


def search(df: DataFrame, filters: Mapping[str, str] | None, limit: int | None = 100) -> DataFrame:
    """Newest events for which every filter holds."""
    for predicate in search_predicates(df, filters):
        df = df.filter(predicate)
    return newest_first(df, limit)


def moderation(df: DataFrame, record_type: str | None = None, user_id: int | None = None,
               chat_id: int | None = None, message_id: int | None = None, limit: int | None = 100) -> DataFrame:
    """Newest events of a record type, user, chat or message."""
    if record_type and record_type.strip():
        df = df.filter(F.col("record_type") == record_type.upper())
    for name, value in (("user_id", user_id), ("chat_id", chat_id), ("message_id", message_id)):
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value).cast("bigint"))
    return newest_first(df, limit)


def breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("record_type").agg(F.count("*").alias("count"))


def count_user_type(df: DataFrame, user_id: int, record_type: str) -> DataFrame:
    return df.filter((F.col("user_id") == user_id) & (F.col("record_type") == record_type)).agg(
        F.count("*").alias("count"))


def summary(df: DataFrame, user_id: int | None = None, record_type: str | None = None,
            chat_id: int | None = None) -> DataFrame:
    """Count, first and last event time of one user and type, or of one chat."""
    for name, value in (("user_id", user_id), ("record_type", record_type), ("chat_id", chat_id)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df.agg(
        F.count("*").alias("count"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
    )


def latest(df: DataFrame, limit: int | None = 5, time: str = "event_time") -> DataFrame:
    return newest_first(df, limit, time=time)


def search_json(df: DataFrame, path: str, value: str, limit: int | None = 100) -> DataFrame:
    """Older JSON events whose text at ``path`` equals ``value``, newest first; parsed messages are used where stored."""
    matched = df.filter(variant_string(document_of(df), path) == ("" if value is None else value))
    return newest_first(matched, limit, time="created_at")


def search_json_int(df: DataFrame, path: str, minimum: int, limit: int | None = 100) -> DataFrame:
    """Older JSON events with a whole number of at least ``minimum`` at ``path``, largest first."""
    number = variant_int(F.col(PARSED), path) if PARSED in df.columns else json_int(F.col("message"), path)
    found = df.withColumn("found", number).filter(F.col("found") >= minimum)
    return first_rows(found.orderBy(F.col("found").desc(), F.col("event_id").desc()), limit)


# Up to this many rows deep a page is a top-k, kept per task in a heap of offset + limit rows.
TOP_K_ROWS = 100_000


def page(df: DataFrame, offset: int = 0, limit: int | None = 100, column: str | None = None,
         ascending: bool = False) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` in a total order.

    A shallow page is a top-k. For a deep one a ``RankIndex`` of the order is built, asked and dropped; keep an index, or
    go on from page tokens (``page_after``), to read many pages.
    """
    if offset < 0:
        raise ValueError(f"offset must not be negative: {offset}")
    if limit is None and not offset or limit is not None and offset + limit <= TOP_K_ROWS:
        return first_rows(order(df, column, ascending).offset(offset), limit)
    index = RankIndex.build(df, column, ascending)
    rows = index.page(df, offset, limit)
    index.drop()
    return rows
