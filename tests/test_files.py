"""Readers and writers of files: order and number of tasks."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog.operators.normalize import to_event_rows
from tidelog.operators.validate import validate
from tidelog.registered import load, tables
from tidelog.sources import files
from tidelog.sources.store import EventStore


@pytest.fixture
def setting(spark):
    kept = {}

    def put(name, value):
        kept.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in kept.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("piece", ["128m", "2k"])
def test_first_lines_go_by_file_and_place(spark, tmp_path, setting, piece):
    at = 0
    for n, size in enumerate((5, 40, 400)):  # tasks read larger files first
        lines = [json.dumps({"eventId": str(at + i), "index": at + i}) for i in range(size)]
        lines.insert(2, "  ")
        (tmp_path / f"part-{n}.json").write_text("\n".join(lines) + "\n")
        at += size
    setting("spark.sql.files.maxPartitionBytes", piece)
    for n in (0, 3, 30, 300, 445, 1000):
        got = [r["index"] for r in files.read_ndjson(spark, str(tmp_path), n).collect()]
        assert got == list(range(min(n, at)))
    plan = files.read_ndjson(spark, str(tmp_path), 30)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=30" in plan


def test_replay_is_sorted_and_written_by_many_tasks(spark, tmp_path, setting, monkeypatch):
    setting("spark.sql.adaptive.enabled", "false")
    monkeypatch.setattr(tables, "scratch_path", lambda *_: str(tmp_path / "replay"))
    got = [r["index"] for r in load()[0]["replay_first_events"](spark, "/root/testdata/sf0.001").collect()]
    parts = sorted((tmp_path / "replay").glob("part-*.json"))
    written = [[json.loads(line)["index"] for line in p.read_text().splitlines()] for p in parts]
    assert len(parts) > 2 and max(map(len, written)) < sum(map(len, written)) / 2
    assert sum(written, []) == sorted(sum(written, []))
    assert got == sum(written, [])[:750]


def test_rows_are_shuffled_once_for_all_layouts(spark, tmp_path):
    records = tables.raw_records(spark, "/root/testdata/sf0.001")
    store = EventStore(spark, str(tmp_path / "store"))
    checked = validate(records).withColumn("value", F.lit("text"))
    plan = store.placed(to_event_rows(checked, keep=("value", "error")))._jdf.queryExecution().executedPlan().toString()
    dealt = next(i for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line)
    copied = next(i for i, line in enumerate(plan.splitlines()) if "explode(CASE" in line)
    assert copied < dealt  # above the exchange
    done = files.save_batch(records, store.root)
    assert done["rows"] + done["refused"] == records.count() and done["rows"] and done["refused"]
    assert {r["rows"] for r in store.stats().collect()} == {done["rows"]}
    # Only refused records are kept as text.
    assert all(json.loads(r["value"])["ingestTime"] and r["error"] for r in store.refused().collect())
