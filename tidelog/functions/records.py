from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.catalogue import RECORD_TYPES, SERVICE, Catalogue
from tidelog.functions.text import is_blank, trimmed


def constant(table: dict, kind: str = "string") -> Column:
    """A lookup table from names to values of type ``kind`` that Spark folds to one literal.

    Written as JSON so that it is one small expression to build and to analyse.
    """
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>")


def parse_activity_type(value: Column, catalogue: Catalogue = SERVICE) -> Column:
    """Known activity name whatever its case and outer blanks, else null."""
    name = F.upper(trimmed(value))
    return F.when(name.isin(*catalogue.activities), name)


def record_type_of(activity: Column, catalogue: Catalogue = SERVICE) -> Column:
    """Record type of a known activity, OTHER for null."""
    return F.coalesce(constant(catalogue.record_type_of)[activity], F.lit("OTHER"))


def coarse_record_type(activity: Column, attrs: Column, catalogue: Catalogue = SERVICE) -> Column:
    """Record type of the activity, of ``attrs.type`` if there is none, else OTHER."""
    known = F.coalesce(parse_activity_type(activity, catalogue), parse_activity_type(attrs["type"], catalogue))
    return record_type_of(known, catalogue)


def normalize_record_type(value: Column) -> Column:
    name = F.upper(trimmed(value))
    return F.when(~is_blank(value) & name.isin(*RECORD_TYPES), name).otherwise(F.lit("OTHER"))
