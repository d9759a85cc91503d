"""Text to whole numbers.

A plain cast is too generous (it takes ``'1.5'``), so the shape is checked
first; out-of-range values fall through ``try_cast``, which also does the
trimming.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE_NUMBER = r"\A[+-]?[0-9]+\z"
WHOLE_NUMBER_WITH_BLANKS = r"\A[\x00-\x20]*[+-]?[0-9]+[\x00-\x20]*\z"


def long_or_null(value: Column) -> Column:
    return F.when(value.rlike(WHOLE_NUMBER_WITH_BLANKS), value.try_cast("bigint"))


def long_or_zero(value: Column) -> Column:
    return F.coalesce(long_or_null(value), F.lit(0).cast("bigint"))


def int_or_zero(value: Column) -> Column:
    return F.coalesce(F.when(value.rlike(WHOLE_NUMBER), value.try_cast("int")), F.lit(0))
