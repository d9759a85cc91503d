from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.text import trimmed

_CANONICAL = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
# Five hexadecimal groups; short groups are padded with zeros.
_UUID_SHAPE = r"(?i)\A([0-9a-f]{1,8})-([0-9a-f]{1,4})-([0-9a-f]{1,4})-([0-9a-f]{1,4})-([0-9a-f]{1,12})\z"
_UUID_GROUPS = (8, 4, 4, 4, 12)


def uuid7(instant: Column) -> Column:
    """Time-ordered UUID: 48 bits of milliseconds, then random bits.

    The random tail comes from Spark's ``uuid()``, whose seed is fixed per plan
    and partition, so a retried task writes the same ids again.
    """
    millis = F.lower(F.lpad(F.hex(F.unix_millis(instant)), 12, "0"))
    tail = F.substring(F.expr("uuid()"), 16, 21)  # 12 bits, then variant and 62 bits
    return F.concat(F.substring(millis, 1, 8), F.lit("-"), F.substring(millis, 9, 4), F.lit("-7"), tail)


def canonical_uuid(value: Column) -> Column:
    """Lower-case, zero-padded UUID text, or null if it is not one."""
    parts = [
        F.lpad(F.regexp_extract(value, _UUID_SHAPE, i + 1), width, "0")
        for i, width in enumerate(_UUID_GROUPS)
    ]
    return F.when(value.rlike(_CANONICAL), value).when(
        value.rlike(_UUID_SHAPE), F.lower(F.concat_ws("-", *parts)))


def ensure_event_id(value: Column, instant: Column) -> Column:
    """The given UUID if it is one, else a new time-ordered UUID for ``instant``."""
    return F.coalesce(canonical_uuid(value), uuid7(instant))


def uuid7_timestamp(value: Column) -> Column:
    millis = F.conv(F.substring(F.regexp_replace(trimmed(value), "-", ""), 1, 12), 16, 10)
    return F.timestamp_millis(millis.cast("bigint"))
