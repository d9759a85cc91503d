from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date, optional time of day (T or space), optional fraction, optional zone;
# the cast that follows does the trimming.
_TIMESTAMP_SHAPE = (
    r"\A[\x00-\x20]*[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?[\x00-\x20]*\z"
)
_EPOCH_SECONDS = r"\A[\x00-\x20]*[0-9]{9,10}[\x00-\x20]*\z"


def to_second(value: Column) -> Column:
    return F.date_trunc("second", value)


def bucket_start(value: Column, interval: str | None = "minute") -> Column:
    """Start of the second, minute, hour or day; any other name means minute."""
    unit = (interval or "minute").strip().lower()
    if unit not in ("second", "minute", "hour", "day"):
        unit = "minute"
    return F.date_trunc(unit, value)


def parse_timestamp(value: Column) -> Column:
    """ISO instant, ``yyyy-MM-dd HH:mm:ss``, its T form, or epoch seconds; else null."""
    return (
        F.when(value.rlike(_TIMESTAMP_SHAPE), value.try_cast("timestamp"))
        .when(value.rlike(_EPOCH_SECONDS), F.timestamp_seconds(value.try_cast("bigint")))
    )


def as_instant(value) -> Column:
    """A point in time given by the caller: column, text, datetime, or None for now."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.timezone.utc)
        micros = (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
        return F.timestamp_micros(F.lit(micros))
    return parse_timestamp(F.lit(str(value)))
