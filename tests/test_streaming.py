import json
import os

import pytest

from tidelog.operators import measure
from tidelog.operators.prepare import dedup_stream
from tidelog.schema import EVENT_SCHEMA
from tidelog.sources import files
from tidelog.sources.layout import DEFAULT_HOT_COLUMNS, HotColumn
from tidelog.sources.store import EventStore
from tidelog.streaming import ingest


def message(i, **changes):
    row = {"event_time": f"2026-03-{1 + i % 3:02d} 10:00:00", "ingest_time": "2026-03-05 00:00:00",
           "record_type": "MESSAGE", "event_id": f"00000000-0000-7000-8000-{i:012x}", "user_id": i, "chat_id": 1,
           "message_id": 2, "attrs": {"lang": "ru"}}
    return json.dumps({**row, **changes})


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as out:
        out.write("\n".join(lines))


def run(spark, tmp_path, **options):
    raw = ingest.read_stream(spark, "text", path=str(tmp_path / "topic"))
    ingest.finish(ingest.start_ingest(raw, str(tmp_path / "table"), str(tmp_path / "checkpoint"), **options))
    return files.read_events(spark, str(tmp_path / "table"))


def refused(spark, tmp_path):
    return EventStore(spark, str(tmp_path / "table")).refused().collect()


def test_restart_writes_each_message_once(spark, tmp_path):
    put(tmp_path / "topic", "a", [message(i) for i in range(10)])
    assert run(spark, tmp_path).count() == 10
    put(tmp_path / "topic", "b", [message(i) for i in range(10, 15)] + ["{broken", message(99, event_id="no")])
    table = run(spark, tmp_path)
    assert table.count() == 15 and table.select("event_id").distinct().count() == 15
    assert {str(r[0]) for r in table.select("event_date").distinct().collect()} == {
        "2026-03-01", "2026-03-02", "2026-03-03"}
    assert sorted(r["error"] for r in refused(spark, tmp_path)) == ["broken message", "event_id is not a UUID"]
    assert run(spark, tmp_path).count() == 15


def test_replayed_and_failed_batches_are_seen_once_in_every_layout(spark, tmp_path, monkeypatch):
    put(tmp_path / "topic", "a", [message(i) for i in range(10)] + ["{"])
    commit = EventStore._commit

    def dies(self, batch, facts):
        raise OSError("the driver is gone")

    monkeypatch.setattr(EventStore, "_commit", dies)
    with pytest.raises(Exception, match="the driver is gone"):
        run(spark, tmp_path)
    store = EventStore(spark, str(tmp_path / "table"))
    # All files are there, no commit: no layout shows them.
    assert os.listdir(tmp_path / "table" / "data") and store.batches() == []
    assert store.read(["user_id"]).count() == store.read(["record_type"]).count() == store.refused().count() == 0

    def dies_after(self, batch, facts):
        commit(self, batch, facts)
        raise OSError("the driver is gone")

    # Committed, but the stream did not hear of it: the replay must not write again.
    monkeypatch.setattr(EventStore, "_commit", dies_after)
    with pytest.raises(Exception, match="the driver is gone"):
        run(spark, tmp_path)
    monkeypatch.setattr(EventStore, "_commit", commit)
    assert run(spark, tmp_path).count() == 10
    for filters in (["user_id"], ["record_type"]):
        assert sorted(r[0] for r in store.read(filters).select("user_id").collect()) == list(range(10))
    assert store.refused().count() == 1 and len(store.batches()) == 1
    assert [tuple(r)[1:3] for r in store.commits().collect()] == [(10, 1)]


def test_store_reads_its_source_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    put(tmp_path / "topic", "a", [message(i) for i in range(20)] + ["{"])
    raw = spark.read.text(str(tmp_path / "topic")).mapInArrow(seen, "value string")
    store = EventStore(spark, str(tmp_path / "store"))
    assert store.append(ingest.classify(raw), "one") == {"rows": 20, "refused": 1, "layouts": ["by_user", "by_type"]}
    assert reads.value == 21
    assert store.append(ingest.classify(raw), "one") is None and reads.value == 21


def test_empty_and_wholly_refused_batches(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    nothing = {"rows": 0, "refused": 0, "layouts": ["by_user", "by_type"]}
    assert store.append(spark.createDataFrame([], EVENT_SCHEMA), "empty") == nothing
    assert store.append(spark.createDataFrame([], EVENT_SCHEMA), "empty") is None
    put(tmp_path / "topic", "a", ["{", "["])
    raw = spark.read.text(str(tmp_path / "topic"))
    assert store.append(ingest.classify(raw.filter("value = 'x'")), "filtered") == nothing
    assert store.append(ingest.classify(raw), "refused") == {**nothing, "refused": 2}
    assert store.read().count() == 0 and store.refused().count() == 2 and len(store.batches()) == 3
    assert [tuple(r)[1:3] for r in store.stats().collect()] == [(0, 0), (0, 0)]


def test_store_sweeps_and_refuses_names(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.read().columns == store.schema().names and store.commits().count() == 0
    put(tmp_path / "topic", "a", [message(i) for i in range(5)])
    rows = ingest.classify(spark.read.text(str(tmp_path / "topic")))
    store.append(rows, "good")
    store.placed(rows).write.partitionBy("layout", "event_date").parquet(f"{store.root}/data/batch=left")
    assert store.read().count() == 5 and store.sweep() == ["left"] and store.read(["record_type"]).count() == 5
    for name in ("a/b", "../x", "_x", "."):
        with pytest.raises(ValueError):
            store.append(rows, name)
    with pytest.raises(ValueError):
        EventStore(spark, "x", ["by_nothing"])
    assert files.read_events(spark, store.root).columns == store.read().columns
    # A later batch with one more hot column: null in the rows before.
    wider = EventStore(spark, store.root, hot=(*DEFAULT_HOT_COLUMNS, HotColumn("attr_type", "type")))
    wider.append(rows, "wider")
    assert [tuple(r) for r in store.read().groupBy("attr_type").count().orderBy("attr_type").collect()] == [(None, 5), ("", 5)]


def test_late_rows_land_in_their_day(spark, tmp_path):
    put(tmp_path / "topic", "a", [message(1)])
    run(spark, tmp_path)
    put(tmp_path / "topic", "b", [message(2, event_time="2020-01-01 00:00:00")])
    days = {str(r[0]) for r in run(spark, tmp_path).select("event_date").collect()}
    assert "2020-01-01" in days


def test_too_many_broken_messages_stop_the_stream(spark, tmp_path):
    put(tmp_path / "topic", "a", [message(1)] + ["nope"] * 10)
    assert run(spark, tmp_path, max_broken=10).count() == 1
    put(tmp_path / "topic", "b", ["nope"] * 11)
    put(tmp_path / "topic", "c", [message(2)])
    for _ in range(2):
        with pytest.raises(Exception, match="11 refused messages"):
            run(spark, tmp_path, max_broken=10)
        # Nothing of that batch is seen, neither its good row nor the refused ones.
        assert files.read_events(spark, str(tmp_path / "table")).count() == 1 and len(refused(spark, tmp_path)) == 10
    assert run(spark, tmp_path, max_broken=11).count() == 2 and len(refused(spark, tmp_path)) == 21


def test_defaults_and_odd_messages(spark, tmp_path):
    put(tmp_path / "topic", "a", [
        json.dumps({"event_time": "2026-03-01 10:00:00", "ingest_time": "2026-03-01 10:00:01",
                    "record_type": "OTHER", "event_id": "00000000-0000-7000-8000-000000000001", "extra": 1}),
        message(2, user_id="text"), message(3, event_time="soon"), "", "[]", "null"])
    rows = run(spark, tmp_path).collect()
    assert len(rows) == 1 and (rows[0].user_id, rows[0].attrs, rows[0].attr_lang) == (0, {}, "")


def test_stream_equals_batch(spark, tmp_path):
    put(tmp_path / "topic", "a", [message(i) for i in range(50)] + ["{x"])
    streamed = run(spark, tmp_path)
    good, refused = ingest.event_rows(spark.read.text(str(tmp_path / "topic")))
    columns = [c for c in EVENT_SCHEMA.names if c != "attrs"]
    assert streamed.select(*columns).exceptAll(good.select(*columns)).count() == 0
    assert good.count() == streamed.count() == 50 and refused.count() == 1


def test_record_stream_checks_records(spark, tmp_path):
    lines = [json.dumps({"activityType": "LOGIN", "eventTime": "2026-03-01T10:00:00Z", "userId": 5,
                         "attrs": {"USER_ID": 5, "Lang": "ru"}}),
             json.dumps({"activityType": "LOGIN", "eventTime": "2026-03-01T10:00:00Z", "attrs": {"chat_id": "1"}}),
             "{"]
    put(tmp_path / "topic", "a", lines)
    rows = run(spark, tmp_path, shape="records").collect()
    assert len(rows) == 1 and rows[0].user_id == 5 and rows[0].attr_lang == "ru" and rows[0].record_type == "SYSTEM"
    errors = {r["error"] for r in refused(spark, tmp_path)}
    assert errors == {"broken message", "user_id required in attrs"}


def test_duplicates_and_rates_on_a_stream(spark, tmp_path):
    put(tmp_path / "topic", "a", [message(i % 5) for i in range(20)])
    raw = ingest.read_stream(spark, "text", path=str(tmp_path / "topic"))
    good, _ = ingest.event_rows(raw)
    ingest.finish([ingest.write_stream(dedup_stream(good, "10 days"), str(tmp_path / "once"), str(tmp_path / "c1"))])
    assert spark.read.parquet(str(tmp_path / "once")).count() == 5

    put(tmp_path / "topic", "b", [message(1, ingest_time="2026-03-06 00:00:00")])
    rates = measure.ingest_rate(good, by="record_type", watermark="1 minute")
    ingest.finish([ingest.write_stream(rates, str(tmp_path / "rates"), str(tmp_path / "c2"))])
    row = spark.read.parquet(str(tmp_path / "rates")).collect()
    assert [(r["count"], round(r["rate"], 4)) for r in row] == [(20, 0.3333)]


def test_failfast_batch_writes_nothing(spark, tmp_path):
    from tidelog.schema import RECORD_SCHEMA

    rows = [("LOGIN", "2026-03-01T10:00:00Z", None, None, {"user_id": str(i)}) for i in range(20)]
    good = spark.createDataFrame(rows, RECORD_SCHEMA)
    files.save_batch(good, str(tmp_path / "t"), refuse="failfast")
    mixed = good.unionByName(spark.createDataFrame([("LOGIN", None, None, None, {})], RECORD_SCHEMA))
    with pytest.raises(Exception, match="eventTime required"):
        files.save_batch(mixed, str(tmp_path / "t"), refuse="failfast")
    assert files.read_events(spark, str(tmp_path / "t")).count() == 20


def test_running_totals_over_restarts(spark, tmp_path):
    def total(lines):
        put(tmp_path / "topic", f"f{len(os.listdir(tmp_path / 'topic')) if (tmp_path / 'topic').exists() else 0}", lines)
        good, _ = ingest.event_rows(ingest.read_stream(spark, "text", path=str(tmp_path / "topic")))
        ingest.finish([measure.trend_stream(good, str(tmp_path / "trend"), str(tmp_path / "c"))])
        return [(str(r.window_start), r["count"], r.total) for r in measure.read_trend(spark, str(tmp_path / "trend")).orderBy("window_start").collect()]

    at = "2026-03-0{} 00:0{}:00".format
    assert total([message(i, ingest_time=at(5, 1)) for i in range(3)] + ["{"]) == [(at(5, 1), 3, 3)]
    # Later rows, of a new day, of a known minute, and of one before it.
    assert total([message(1, ingest_time=at(6, 0)), message(2, ingest_time=at(5, 1)), message(3, ingest_time=at(5, 0))]) == [
        (at(5, 0), 1, 1), (at(5, 1), 4, 5), (at(6, 0), 1, 6)]
    # What a broken-off batch leaves is not read.
    (tmp_path / "trend" / "batch=99").mkdir()
    assert len(measure.read_trend(spark, str(tmp_path / "trend")).collect()) == 3
