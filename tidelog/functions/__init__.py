"""Column expressions; all are built-in Spark functions, no Python UDFs."""

from tidelog.functions.attributes import (
    attribute_text, flag_value, lookup_attribute, normalize_attrs, read_attribute,
    top_attributes, write_attribute,
)
from tidelog.functions.identifiers import ensure_event_id, uuid7, uuid7_timestamp
from tidelog.functions.json_text import check_path, json_int, json_string
from tidelog.functions.numbers import int_or_zero, long_or_null, long_or_zero
from tidelog.functions.records import coarse_record_type, normalize_record_type, parse_activity_type
from tidelog.functions.text import is_blank, trimmed
from tidelog.functions.times import as_instant, bucket_start, parse_timestamp, to_second

__all__ = [
    "as_instant", "attribute_text", "bucket_start", "check_path", "coarse_record_type",
    "ensure_event_id", "flag_value", "int_or_zero", "is_blank", "json_int", "json_string",
    "long_or_null", "long_or_zero", "lookup_attribute", "normalize_attrs",
    "normalize_record_type", "parse_activity_type", "parse_timestamp", "read_attribute",
    "to_second", "top_attributes", "trimmed", "uuid7", "uuid7_timestamp", "write_attribute",
]
