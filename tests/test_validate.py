import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidelog.catalogue import SERVICE, SIMULATOR
from tidelog.operators.normalize import to_event_rows, to_records
from tidelog.operators.validate import split_valid, validate
from tidelog.schema import RECORD_SCHEMA
from tidelog.sources.generate import generate_events, row_ids

NOW = "2026-03-21T10:00:00Z"
OK = {"user_id": "5"}
CASES = [
    ("LOGIN", NOW, OK, None),
    (None, NOW, {**OK, "type": "LOGIN"}, None),
    ("LOGIN", NOW, None, "attrs required"),
    ("LOGIN", NOW, {**OK, "type": "logout"}, "activityType and attrs.type mismatch: LOGIN vs LOGOUT"),
    (None, NOW, OK, "activity type required (activityType or attrs.type)"),
    ("DANCED", NOW, OK, "activity type required (activityType or attrs.type)"),
    ("LOGIN", None, OK, "eventTime required"),
    ("LOGIN", NOW, {}, "user_id required in attrs"),
    ("LOGIN", NOW, {"user_id": " "}, "user_id required in attrs"),
    ("LOGIN", NOW, {"user_id": "5x"}, "user_id must be a number"),
    ("LOGIN", NOW, {"user_id": " 5 "}, None),
    ("LOGIN", NOW, {**OK, "gender": "1"}, "Unknown attribute for LOGIN: gender"),
    ("LOGIN", NOW, {**OK, "": "1"}, "Unknown attribute for LOGIN: "),
    ("LOGIN", NOW, {**OK, "type": "login"}, "Attribute TYPE: value 'login' not in allowed set"),
    ("LOGIN", NOW, {**OK, "Lang": "ru", "APP_VERSION": "anything"}, None),
    ("LOGIN", NOW, {**OK, "lang": " ru "}, None),
    ("LOGIN", NOW, {**OK, "lang": ""}, None),
    ("LOGIN", NOW, {**OK, "lang": None}, None),
    ("LOGIN", NOW, {**OK, "lang": "RU"}, "Attribute LANG: value 'RU' not in allowed set"),
    ("MESSAGE_SENT", NOW, {**OK, "is_reply": "maybe"}, "Invalid IS_REPLY: maybe"),
    ("MESSAGE_SENT", NOW, {**OK, "is_reply": "FALSE", "is_forwarded": "1"}, None),
    ("MESSAGE_SENT", NOW, {**OK, "chat_id": "1.5"}, "Invalid CHAT_ID: 1.5"),
    ("MESSAGE_SENT", NOW, {**OK, "chat_id": "99999999999999999999"}, "Invalid CHAT_ID: 99999999999999999999"),
    ("MESSAGE_SENT", NOW, {**OK, "timestamp": "whenever"}, None),
]


def records(spark, rows):
    return spark.createDataFrame([(a, t, None, None, attrs) for a, t, attrs in rows], RECORD_SCHEMA)


def test_reasons(spark):
    frame = records(spark, [c[:3] for c in CASES]).coalesce(1)
    assert [r["error"] for r in validate(frame).collect()] == [c[3] for c in CASES]


def test_split_and_failfast(spark):
    frame = records(spark, [c[:3] for c in CASES])
    good, bad = split_valid(frame)
    assert good.count() == sum(c[3] is None for c in CASES)
    assert bad.count() == sum(c[3] is not None for c in CASES)
    assert split_valid(good, mode="failfast")[0].count() == good.count()
    with pytest.raises(Exception, match="required|mismatch|Unknown|Invalid|allowed|number"):
        split_valid(frame, mode="failfast")[0].collect()


@pytest.mark.parametrize("catalogue", [SERVICE, SIMULATOR], ids=lambda c: c.name)
def test_generated_records_pass(spark, catalogue):
    made = generate_events(row_ids(spark, 3000), seed=3, catalogue=catalogue, as_of="2026-01-01")
    checked = validate(made, catalogue)
    assert checked.filter("error IS NOT NULL").count() == 0
    assert made.select("activityType").distinct().count() == 30


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000), st.sampled_from(sorted(SERVICE.activities)))
def test_one_change_is_refused(spark, seed, activity):
    made = generate_events(row_ids(spark, 300), seed=seed, as_of="2026-01-01").filter(F.col("activityType") == activity)
    spoiled = made.withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("no_such_key"), F.lit("1"))))
    errors = {r["error"] for r in validate(spoiled).collect()}
    assert errors <= {f"Unknown attribute for {activity}: no_such_key"}


def test_rows_and_back(spark):
    made = generate_events(row_ids(spark, 500), seed=9, as_of="2026-01-01").cache()
    back = to_records(to_event_rows(made, "2026-01-01"))
    key = ["activityType", "eventTime", F.array_sort(F.map_entries("attrs")).alias("a")]
    assert back.select(*key).exceptAll(made.select(*key)).count() == 0


def test_times_ids_and_types_of_rows(spark):
    frame = spark.createDataFrame([
        ("LOGIN", None, None, "nope", {"USER_ID": "12", "Chat_Id": "x"}),
        (None, "2026-03-21 10:00:00", "bad", None, None),
        (None, "2026-03-21T10:00:00.750Z", None, None, {"type": "call_ended", "message_id": "7"}),
    ], RECORD_SCHEMA).coalesce(1)
    a, b, c = to_event_rows(frame, "2026-01-01T00:00:01.9Z").collect()
    assert (a.record_type, a.user_id, a.chat_id, a.attrs["type"], str(a.event_time)) == (
        "SYSTEM", 12, 0, "LOGIN", "2026-01-01 00:00:01")
    assert (b.record_type, b.user_id, b.attrs, str(b.ingest_time)) == ("OTHER", 0, {}, "2026-01-01 00:00:01")
    assert (c.record_type, c.message_id, str(c.event_time)) == ("SYSTEM", 7, "2026-03-21 10:00:00")
    assert to_event_rows(frame, catalogue=SIMULATOR).collect()[2].record_type == "MESSAGE"
