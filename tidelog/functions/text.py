from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a trim removes: every code point up to the space.
TRIMMED_CHARS = "".join(chr(code) for code in range(0x21))


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(TRIMMED_CHARS))


def is_blank(value: Column) -> Column:
    """Null, empty or only white space."""
    return value.isNull() | value.rlike(r"\A\p{javaWhitespace}*\z")
