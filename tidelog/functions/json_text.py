"""Values inside a JSON text column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.numbers import long_or_zero

_SEGMENT = re.compile(r"[A-Za-z0-9_]+")


def check_name(name: str) -> str:
    """An attribute name the caller may search by, lower-cased."""
    if not _SEGMENT.fullmatch(name):
        raise ValueError(f"Invalid attribute name: {name}")
    return name.lower()


def check_path(path: str | None) -> list[str]:
    """Segments of a dotted field path, each of letters, digits and underscores."""
    if path is None or not path.strip():
        raise ValueError("field must not be empty")
    segments = path.split(".")
    while segments and segments[-1] == "":
        segments.pop()  # trailing dots name nothing
    if not segments or not all(_SEGMENT.fullmatch(s) for s in segments):
        raise ValueError(f"invalid field name: {path}")
    return segments


def _variant_path(path: str) -> str:
    return "$" + "".join(f"['{s}']" for s in check_path(path))


# Name of a stored, parsed form of the message column.
PARSED = "message_parsed"


def with_parsed(df: DataFrame, document: str = "message") -> DataFrame:
    """``df`` with its documents parsed once, as a VARIANT column to be stored.

    It is null where a document is malformed or repeats a key, which then reads as if nothing were in it.
    """
    return df.withColumn(PARSED, F.try_parse_json(document))


def document_of(df: DataFrame, document: str = "message") -> Column:
    """The stored parsed documents if the table has them, else its text, parsed when read."""
    return F.col(PARSED) if PARSED in df.columns else F.try_parse_json(document)


def variant_string(document: Column, path: str) -> Column:
    """Text at ``path`` of a parsed document; '' if it is missing, not a string, or the document is null."""
    found = F.try_variant_get(document, _variant_path(path), "variant")
    is_text = F.schema_of_variant(found) == "STRING"
    return F.coalesce(F.when(is_text, F.try_variant_get(found, "$", "string")), F.lit(""))


def variant_int(document: Column, path: str) -> Column:
    """Whole number at ``path`` of a parsed document, also as text; 0 if it is missing or not one."""
    found = F.try_variant_get(document, _variant_path(path), "variant")
    whole = F.schema_of_variant(found).isin("BIGINT", "STRING")
    return long_or_zero(F.when(whole, F.try_variant_get(found, "$", "string")))


def json_string(document: Column, path: str) -> Column:
    """Text at ``path``; '' if it is missing, not a string, or the document is malformed."""
    return variant_string(F.try_parse_json(document), path)


def json_int(document: Column, path: str) -> Column:
    """Whole number at ``path``; 0 if it is missing or not one."""
    return long_or_zero(F.get_json_object(document, _variant_path(path)))
