"""Record checks: one column with the first reason a record is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.catalogue import SERVICE, Catalogue
from tidelog.functions.numbers import long_or_null
from tidelog.functions.records import constant, parse_activity_type
from tidelog.functions.text import is_blank, trimmed

ERROR = "error"


# A flag value, blanks around it allowed.
_FLAG = r"(?i)\A[\x00-\x20]*(1|0|true|false)[\x00-\x20]*\z"


def _value_is_wrong(key: Column, value: Column, catalogue: Catalogue) -> Column:
    """Whether a value does not fit its attribute; null and blank values fit.

    Runs once per attribute of every record, so the cheap tests on the value as
    it is come first and trimming is left to the few that fail them.
    """
    by_kind: dict[str, list[str]] = {}
    for name, spec in catalogue.attributes.items():
        by_kind.setdefault(spec.kind, []).append(name)
    enums = {n: a.allowed for n, a in catalogue.attributes.items() if a.allowed}
    allowed = constant(enums, "array<string>")[key]
    wrong = (
        F.when(key.isin(*by_kind["long"]), long_or_null(value).isNull())
        .when(key.isin(*enums),
              ~(F.array_contains(allowed, value) | F.array_contains(allowed, trimmed(value))))
        .when(key.isin(*by_kind["flag"]), ~value.rlike(_FLAG))
        .otherwise(F.lit(False))
    )
    return value.isNotNull() & wrong & (trimmed(value) != "")


def _let(body, **values: Column) -> Column:
    """``body`` of a struct of values, each computed once.

    Spark copies a column's expression to every place that uses it when it
    pushes filters down; a lambda argument is computed once and stays put.
    """
    bound = F.struct(*[v.alias(n) for n, v in values.items()])
    return F.transform(F.array(bound), body)[0]


def refusal(activity: Column, event_time: Column, attrs: Column, catalogue: Catalogue = SERVICE) -> Column:
    """First reason the record is refused, null for a good one.

    Attribute keys count as lower-cased, colliding keys as their last value.
    Several bad attributes: the alphabetically first one is named.
    """
    allowed_by_type = constant({a: catalogue.allowed_keys(a) for a in catalogue.activities}, "array<string>")
    enum_names = [n for n, a in catalogue.attributes.items() if a.allowed]

    def with_types(r: Column) -> Column:
        return _let(
            with_bad_key,
            attrs=r["attrs"], time=r["time"], field=r["field"], uid=r["attrs"]["user_id"],
            attr=parse_activity_type(r["attrs"]["type"], catalogue))

    def with_bad_key(r: Column) -> Column:
        known = F.coalesce(r["field"], r["attr"])

        def bad_key(s: Column) -> Column:
            return F.array_min(F.map_keys(F.map_filter(
                s["attrs"],
                lambda k, v: ~F.array_contains(s["allowed"], k) | _value_is_wrong(k, v, catalogue))))

        checked = _let(
            lambda s: _let(
                attribute_reason, attrs=s["attrs"], type=s["type"], allowed=s["allowed"], bad=bad_key(s)),
            attrs=r["attrs"], type=known, allowed=allowed_by_type[known])
        return (
            F.when(r["attrs"].isNull(), F.lit("attrs required"))
            .when(r["field"] != r["attr"], F.concat(
                F.lit("activityType and attrs.type mismatch: "), r["field"], F.lit(" vs "), r["attr"]))
            .when(known.isNull(), F.lit("activity type required (activityType or attrs.type)"))
            .when(r["time"].isNull(), F.lit("eventTime required"))
            .when(is_blank(r["uid"]), F.lit("user_id required in attrs"))
            .when(long_or_null(r["uid"]).isNull(), F.lit("user_id must be a number"))
            .otherwise(checked)
        )

    def attribute_reason(s: Column) -> Column:
        bad, value = s["bad"], s["attrs"][s["bad"]]
        return (
            F.when(s["allowed"].isNull(), F.concat(F.lit("no schema for activity type: "), s["type"]))
            .when(bad.isNull(), F.lit(None).cast("string"))
            .when(~F.array_contains(s["allowed"], bad),
                  F.concat(F.lit("Unknown attribute for "), s["type"], F.lit(": "), bad))
            .when(bad.isin(*enum_names), F.concat(
                F.lit("Attribute "), F.upper(bad), F.lit(": value '"), trimmed(value),
                F.lit("' not in allowed set")))
            .otherwise(F.concat(F.lit("Invalid "), F.upper(bad), F.lit(": "), value))
        )

    return _let(with_types, attrs=F.transform_keys(attrs, lambda k, v: F.lower(k)), time=event_time,
                field=parse_activity_type(activity, catalogue))


def validate(records: DataFrame, catalogue: Catalogue = SERVICE) -> DataFrame:
    """Add ``error``: null for a good record, else the first reason it is refused."""
    reason = refusal(F.col("activityType"), F.col("eventTime"), F.col("attrs"), catalogue)
    # Exploded from a one-element array, so that a filter on the reason does not work it out again.
    return records.select("*", F.explode(F.array(reason)).alias(ERROR))


def unknown_attributes(activity: Column, attrs: Column, catalogue: Catalogue = SERVICE) -> Column:
    """Attribute keys the activity may not carry."""
    allowed = constant({a: catalogue.allowed_keys(a) for a in catalogue.activities}, "array<string>")[activity]
    return F.array_except(F.transform(F.map_keys(attrs), F.lower), allowed)


def invalid_values(attrs: Column, catalogue: Catalogue = SERVICE) -> Column:
    """Entries whose value does not fit the attribute's type or allowed set."""
    return F.map_filter(attrs, lambda k, v: _value_is_wrong(F.lower(k), v, catalogue))


def split_valid(records: DataFrame, catalogue: Catalogue = SERVICE,
                mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Good records, and refused ones with their ``error``.

    ``mode="failfast"`` instead stops the job at the first refused record.
    """
    checked = validate(records, catalogue)
    if mode == "failfast":
        passed = F.when(F.col(ERROR).isNull(), F.lit(True)).otherwise(
            F.raise_error(F.col(ERROR)).cast("boolean"))
        good = checked.filter(passed).drop(ERROR)
        return good, checked.filter(F.lit(False))
    if mode != "quarantine":
        raise ValueError(f"unknown mode: {mode}")
    return checked.filter(F.col(ERROR).isNull()).drop(ERROR), checked.filter(F.col(ERROR).isNotNull())
