"""Row filters and ordering on the event table.

Every filter is a plain column predicate, so Spark can push it to the Parquet
scan; predicates on event time are repeated on the ``event_date`` partition
column where the table has one, which is what prunes whole days.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.attributes import attribute_equals, attribute_in
from tidelog.functions.json_text import check_name
from tidelog.functions.records import normalize_record_type
from tidelog.functions.times import as_instant
from tidelog.catalogue import SERVICE, Catalogue

PARTITION = "event_date"


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows, all if it is None."""
    if limit is None:
        return df
    if int(limit) < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    return df.limit(int(limit))


def newest_first(df: DataFrame, limit: int | None, time: str = "event_time", tie: str = "event_id") -> DataFrame:
    return first_rows(df.orderBy(F.col(time).desc(), F.col(tie).desc()), limit)


def since(df: DataFrame, start: Column) -> DataFrame:
    out = df.filter(F.col("event_time") >= start)
    return out.filter(F.col(PARTITION) >= F.to_date(start)) if PARTITION in df.columns else out


def until(df: DataFrame, end: Column) -> DataFrame:
    out = df.filter(F.col("event_time") <= end)
    return out.filter(F.col(PARTITION) <= F.to_date(end)) if PARTITION in df.columns else out


def time_range(df: DataFrame, start=None, end=None, hours: int = 24, as_of=None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; a missing bound falls back on ``as_of``.

    Without ``start`` the range opens ``hours`` before ``as_of``.
    """
    now = as_instant(as_of)
    low = as_instant(start) if start else now - F.make_dt_interval(hours=F.lit(hours))
    high = as_instant(end) if end else now
    return until(since(df, low), high)


def last_days(df: DataFrame, days: int, as_of=None) -> DataFrame:
    return since(df, as_instant(as_of) - F.make_dt_interval(days=F.lit(days)))


def last_minutes(df: DataFrame, minutes: int | None, as_of=None) -> DataFrame:
    if not minutes or minutes <= 0:
        return df
    return since(df, as_instant(as_of) - F.make_dt_interval(mins=F.lit(minutes)))


def filter_attr(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(attribute_equals(df, check_name(key), value))


def filter_query_string(df: DataFrame, text: str | None) -> DataFrame:
    """``key=value``, split at the first ``=``; anything else filters nothing."""
    if not text or "=" not in text:
        return df
    key, value = text.split("=", 1)
    return filter_attr(df, key.strip(), value.strip())


def filter_types(df: DataFrame, names: str | Iterable[str] | None, catalogue: Catalogue = SERVICE) -> DataFrame:
    """Rows of the named activities; unknown names are dropped, no name at all filters nothing."""
    parts = names.split(",") if isinstance(names, str) else list(names or [])
    if not any(p.strip() for p in parts):
        return df
    known = [p.strip().upper() for p in parts if p.strip().upper() in catalogue.record_type_of]
    return df.filter(attribute_in(df, "type", known)) if known else df.filter(F.lit(False))


def filter_ids(df: DataFrame, ids: Iterable | DataFrame, column: str = "event_id") -> DataFrame:
    """Rows whose id is listed, with the columns in their order.

    A Python list of any length is one predicate, its ids read as the column's type; ids that are no such value match
    nothing. Lists too long for the driver come as a DataFrame, whose first column is semi-joined.
    """
    if isinstance(ids, DataFrame):
        listed = ids.select(F.col(ids.columns[0]).alias("_listed"))
        return df.join(listed, F.col(column) == F.col("_listed"), "left_semi")
    whole = df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    values = []
    for i in ids:
        if i is None or whole and isinstance(i, float) and not i.is_integer():
            continue
        try:
            values.append(int(i) if whole else str(i))
        except (ValueError, OverflowError):
            continue
    return df.filter(F.col(column).isin(*values)) if values else df.filter(F.lit(False))


def filter_record_type(df: DataFrame, name: str | None) -> DataFrame:
    return df.filter(F.col("record_type") == normalize_record_type(F.lit(name)))


def search_predicates(df: DataFrame, filters: Mapping[str, str] | None) -> list[Column]:
    """One equality per filter entry; entries with a blank key or value are skipped."""
    out = []
    for raw_key, raw_value in (filters or {}).items():
        if raw_key is None or raw_value is None:
            continue
        key, value = str(raw_key).strip(), str(raw_value).strip()
        if not key or not value:
            continue
        upper = key.upper()
        if upper == "USER_ID":
            try:
                out.append(F.col("user_id") == F.lit(int(value)).cast("bigint"))
            except ValueError:
                raise ValueError(f"USER_ID must be a number: {value}") from None
        elif upper == "RECORD_TYPE":
            out.append(F.col("record_type") == value.upper())
        elif upper == "EVENT_ID":
            kind = df.schema["event_id"].dataType
            out.append(F.col("event_id") == F.lit(value).cast(kind))
        else:
            out.append(attribute_equals(df, check_name(key), value))
    return out


def order(df: DataFrame, column: str | None = None, ascending: bool = False, tie: str = "event_id") -> DataFrame:
    name = column or "event_time"
    keys = [name] if name == tie else [name, tie]
    return df.orderBy(*[F.col(k).asc() if ascending else F.col(k).desc() for k in keys])
