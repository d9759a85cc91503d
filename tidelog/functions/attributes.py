"""Reading and writing the attribute map of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.catalogue import SERVICE, Catalogue
from tidelog.functions.numbers import long_or_null
from tidelog.functions.text import is_blank, trimmed

HOT_PREFIX = "attr_"


def normalize_attrs(attrs: Column) -> Column:
    """Lower-case keys (the last of colliding ones wins), no blank keys, null values as ''."""
    named = F.map_filter(attrs, lambda k, v: ~is_blank(k))
    filled = F.transform_values(named, lambda k, v: F.coalesce(v, F.lit("")))
    return F.transform_keys(filled, lambda k, v: F.lower(k))


def lookup_attribute(key: str, attrs: Column | None = None) -> Column:
    """Attribute text; a missing key reads as ''."""
    source = F.col("attrs") if attrs is None else attrs
    return F.coalesce(source[key], F.lit(""))


def attribute_text(df: DataFrame, key: str) -> Column:
    """Attribute text of ``df``, from the hot column when the table stores one.

    Reading the stored column lets Parquet skip the map and push the filter down.
    """
    hot = HOT_PREFIX + key
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if fields.get(hot) == "string":
        return F.coalesce(F.col(hot), F.lit(""))
    return lookup_attribute(key)


def attribute_equals(df: DataFrame, key: str, value: str) -> Column:
    """Whether the attribute's text is ``value``.

    On a stored column this is the plain comparison that Parquet can be asked for; only the empty text, which also
    stands for a missing one, needs the null check.
    """
    return attribute_in(df, key, [value])


def attribute_in(df: DataFrame, key: str, values) -> Column:
    """Whether the attribute's text is one of ``values``; see ``attribute_equals``."""
    values = list(values)
    stored = df.schema[HOT_PREFIX + key].dataType.simpleString() if HOT_PREFIX + key in df.columns else None
    if stored != "string":
        return lookup_attribute(key).isin(*values)
    column = F.col(HOT_PREFIX + key)
    listed = column == values[0] if len(values) == 1 else column.isin(*values)
    return column.isNull() | listed if "" in values else listed


def flag_value(text: Column) -> Column:
    return (text == "1") | (F.lower(text) == "true")


def read_attribute(name: str, catalogue: Catalogue = SERVICE) -> Column:
    """Typed value: long, boolean, timestamp (the event time) or text; null if absent."""
    key = name.lower()
    kind = catalogue.attributes[key].kind
    if key == "timestamp":
        return F.col("event_time")
    raw = F.col("attrs")[key]
    if kind == "long":
        return long_or_null(raw)
    if kind == "flag":
        return flag_value(raw)
    return raw


def write_attribute(name: str, value: Column, catalogue: Catalogue = SERVICE) -> Column:
    """The attribute map with one typed value set; flags are stored as '1' and '0'.

    A null value is stored as ''. Values outside the attribute's type or allowed
    set fail the row, as the typed setter does.
    """
    key = name.lower()
    spec = catalogue.attributes[key]
    if spec.kind == "date":
        raise ValueError(f"{name} is the event time; set the event_time column instead")
    text = value.cast("string")
    if spec.kind == "long":
        good = value.isNull() | long_or_null(text).isNotNull()
    elif spec.kind == "flag":
        # true/false and 1/0 are the only texts a flag has
        lowered = F.lower(trimmed(text))
        good = value.isNull() | lowered.isin("true", "false", "1", "0")
        text = F.when(lowered.isin("true", "1"), F.lit("1")).when(value.isNotNull(), F.lit("0"))
    elif spec.allowed:
        good = value.isNull() | text.isin(*spec.allowed)
    else:
        good = F.lit(True)
    problem = F.concat(
        F.lit(f"Attribute {spec.name.upper()}: value '"), value.cast("string"),
        F.lit("' not in allowed set"),
    )
    checked = F.when(good, F.coalesce(text, F.lit(""))).otherwise(F.raise_error(problem).cast("string"))
    current = F.map_filter(F.coalesce(F.col("attrs"), F.create_map().cast("map<string,string>")),
                           lambda k, v: k != key)
    return F.map_concat(current, F.create_map(F.lit(key), checked))


def top_attributes(attrs: Column, n: int = 5) -> Column:
    """First ``n`` entries of the map, in stored order."""
    return F.slice(F.map_entries(attrs), 1, n)
