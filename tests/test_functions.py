import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog.functions.json_text import check_name, check_path


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("out")).first()["out"]


@pytest.mark.parametrize("text, expected", [
    ("", 0), (" 5 ", 5), ("+5", 5), ("-7", -7), ("1.5", 0), ("abc", 0), ("99999999999", 99999999999),
    ("9223372036854775808", 0), ("\t8\n", 8), (None, 0), ("5 6", 0),
])
def test_long_or_zero(spark, text, expected):
    assert one(spark, fn.long_or_zero(F.col("v")), text) == expected


@pytest.mark.parametrize("text, expected", [("7", 7), ("99999999999", 0), (" 7", 0), ("1.5", 0), ("", 0), ("-3", -3)])
def test_int_or_zero(spark, text, expected):
    assert one(spark, fn.int_or_zero(F.col("v")), text) == expected


@pytest.mark.parametrize("text, expected", [
    ("2026-03-21T10:00:00Z", dt.datetime(2026, 3, 21, 10)),
    ("2026-03-21 10:00:00", dt.datetime(2026, 3, 21, 10)),
    ("2026-03-21T13:00:00+03:00", dt.datetime(2026, 3, 21, 10)),
    (" 2026-03-21T10:00:00 ", dt.datetime(2026, 3, 21, 10)),
    ("2026-03-21", dt.datetime(2026, 3, 21)),
    ("1774087200", dt.datetime(2026, 3, 21, 10)),
    ("10:00:00", None), ("2026-13-01 00:00:00", None), ("soon", None), ("", None), (None, None),
])
def test_parse_timestamp(spark, text, expected):
    assert one(spark, fn.parse_timestamp(F.col("v")).cast("timestamp_ntz"), text) == expected


@pytest.mark.parametrize("text, expected", [
    ("login", "LOGIN"), (" Message_Sent\n", "MESSAGE_SENT"), ("nope", None), ("", None), (None, None)])
def test_activity_type(spark, text, expected):
    assert one(spark, fn.parse_activity_type(F.col("v")), text) == expected


@pytest.mark.parametrize("text, expected", [
    ("system", "SYSTEM"), (" PURCHASE ", "PURCHASE"), ("x", "OTHER"), (" ", "OTHER"), (None, "OTHER")])
def test_record_type(spark, text, expected):
    assert one(spark, fn.normalize_record_type(F.col("v")), text) == expected


def test_attribute_keys(spark):
    attrs = F.create_map(F.lit("A"), F.lit("1"), F.lit("a"), F.lit("2"), F.lit(" "), F.lit("x"),
                         F.lit("N"), F.lit(None).cast("string"))
    assert one(spark, fn.normalize_attrs(attrs), "") == {"a": "2", "n": ""}


def test_event_ids(spark):
    at = F.timestamp_millis(F.lit(1_700_000_000_123))
    make = fn.ensure_event_id(F.col("v"), at)
    kept = "0190c8d1-7b2a-4cde-8f00-0123456789ab"
    assert one(spark, make, kept.upper()) == kept
    assert one(spark, make, "1-2-3-4-5") == "00000001-0002-0003-0004-000000000005"
    for bad in ("", "nope", None, kept + "0"):
        made = one(spark, make, bad)
        assert made[14] == "7" and made[19] in "89ab" and len(made) == 36
        assert int(made.replace("-", "")[:12], 16) == 1_700_000_000_123
    assert one(spark, F.unix_millis(fn.uuid7_timestamp(make)), "") == 1_700_000_000_123


def test_new_ids_differ(spark):
    ids = spark.range(10000).select(fn.ensure_event_id(F.lit(None), F.current_timestamp()).alias("i"))
    assert ids.distinct().count() == 10000


@pytest.mark.parametrize("document, text, number", [
    ('{"a":{"b":"x"}}', "x", 0), ('{"a":{"b":5}}', "", 5), ('{"a":{"b":"5"}}', "5", 5), ('{"a":1}', "", 0),
    ("{bad", "", 0), (None, "", 0), ('{"a":{"b":""}}', "", 0), ('{"a":{"b":1.5}}', "", 0)])
def test_json(spark, document, text, number):
    assert one(spark, fn.json_string(F.col("v"), "a.b"), document) == text
    assert one(spark, fn.json_int(F.col("v"), "a.b"), document) == number


def test_names_are_checked():
    assert check_name("LANG_2") == "lang_2"
    assert check_path("a.b.") == ["a", "b"]
    for bad in ("a b", "a'b", ""):
        with pytest.raises(ValueError):
            check_name(bad)
    for bad in (None, " ", "a..b", "a.'", "."):
        with pytest.raises(ValueError):
            check_path(bad)


def test_flags_and_typed_values(spark):
    for text, expected in (("1", True), ("TRUE", True), ("true", True), ("0", False), ("yes", False), (None, None)):
        assert one(spark, fn.flag_value(F.col("v")), text) is expected
    frame = spark.createDataFrame([({"lang": "ru"},)], "attrs map<string,string>")
    written = frame.select(fn.write_attribute("IS_REPLY", F.lit(True)).alias("attrs"))
    assert written.first()["attrs"] == {"lang": "ru", "is_reply": "1"}
    with pytest.raises(Exception, match="LANG"):
        frame.select(fn.write_attribute("LANG", F.lit("xx"))).collect()
    with pytest.raises(ValueError):
        fn.write_attribute("TIMESTAMP", F.lit("x"))


def test_bucket_names(spark):
    at = F.lit("2026-03-21 10:11:12.5").cast("timestamp")
    for name, expected in (("hour", dt.datetime(2026, 3, 21, 10)), ("SECOND", dt.datetime(2026, 3, 21, 10, 11, 12)),
                           (None, dt.datetime(2026, 3, 21, 10, 11)), ("week", dt.datetime(2026, 3, 21, 10, 11))):
        assert one(spark, fn.bucket_start(at, name).cast("timestamp_ntz"), "") == expected


def test_parsed_documents_read_like_text(spark, tmp_path):
    from tidelog.functions import json_text
    from tidelog.operators import search

    documents = ['{"a": {"b": "x", "n": 7}, "s": "42", "big": 99999999999999999999}', '{"a": {"b": 5}, "s": 42.0, "n": 1e3}',
                 '{"a": "x"}', '{"a": [1, 2], "s": null}', "[1]", '"x"', "{broken", "", None, '{"s": 43, "s": 44}', '{"s": " 45 "}',
                 '{"s": true, "a": {"b": ""}}', '{"s": -8}']
    rows = [(i, d) for i, d in enumerate(documents)]
    plain = spark.createDataFrame(rows, "event_id int, message string").withColumn("created_at", F.timestamp_seconds("event_id"))
    path = str(tmp_path / "parsed")
    json_text.with_parsed(plain).write.parquet(path)
    stored = spark.read.parquet(path)
    for field in ("a.b", "a", "s", "a.n", "missing"):
        for value in ("x", "", "42", None):
            ids = [[r.event_id for r in search.search_json(t, field, value).collect()] for t in (stored.drop("message"), plain)]
            assert ids[0] == ids[1], (field, value)
    # A document with a repeated key is not parsed, so it has no number either; its text form gives the first.
    assert 9 not in [r.event_id for r in search.search_json_int(stored, "s", 43).collect()]
    stored, plain = stored.filter("event_id <> 9"), plain.filter("event_id <> 9")
    for field in ("s", "a.n", "big", "n", "missing"):
        for least in (-10, 1, 40):
            found = [[(r.event_id, r.found) for r in search.search_json_int(t, field, least).collect()] for t in (stored.drop("message"), plain)]
            assert found[0] == found[1], (field, least)
    plan = search.search_json(stored, "a.b", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(name in plan.lower() for name in ("parsejson", "parse_json", "get_json", "from_json"))
    assert "parsejson" in search.search_json(plain, "a.b", "x")._jdf.queryExecution().optimizedPlan().toString().lower()
