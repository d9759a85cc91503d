import collections
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import sketches
from tidelog.session import scratch_path


def plain(values, n):
    counts = collections.Counter(values)
    return sorted(counts.items(), key=lambda c: (-c[1], c[0] is not None, c[0]))[:n]


def got(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(8)
    values = [int(rng.paretovariate(0.7)) for _ in range(20_000)] + [None] * 700 + [3] * 5_000
    days = [f"2024-01-0{1 + i % 3}" for i in range(len(values))]
    return values, spark.createDataFrame(list(zip(values, days)), "v long, d string").select("v", F.to_date("d").alias("event_date"))


def test_frequent_values_are_proved(spark, skewed, monkeypatch):
    values, frame = skewed
    assert got(sketches.heavy_hitters(frame, "v", 12)) == plain(values, 12)
    path = scratch_path(spark, "frequent-test")
    sketches.frequent_rollup(frame, "v").write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 3
    frequent = sketches.heavy_hitters(frame, "v", 12, stored)
    assert got(frequent) == plain(values, 12)
    # The values are recounted behind a broadcast semi-join, not all grouped.
    assert "LeftSemi" in frequent._jdf.queryExecution().executedPlan().toString()


def test_values_that_no_sketch_tells_apart(spark, skewed):
    values, frame = skewed
    everything = len(set(values))
    assert got(sketches.heavy_hitters(frame, "v", everything + 5)) == plain(values, everything + 5)
    even = list(range(3_000)) * 2 + [5]
    table = spark.createDataFrame([(v,) for v in even], "v long")
    assert got(sketches.heavy_hitters(table, "v", 30, tracked=100)) == plain(even, 30)
    words = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "w string")
    assert got(sketches.heavy_hitters(words, "w", 2)) == [("b", 2), (None, 1)]
    assert got(sketches.heavy_hitters(words.limit(0), "w", 2)) == []
    with pytest.raises(ValueError):
        sketches.heavy_hitters(words, "w", 0)


def test_more_frequent_values_than_candidates(spark, monkeypatch):
    monkeypatch.setattr(sketches, "CANDIDATES", 5)
    values = [v for v in range(40) for _ in range(100 - v // 2)]
    table = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (3, 5, 8):
        assert got(sketches.heavy_hitters(table, "v", n)) == plain(values, n)


@pytest.mark.parametrize("cut", [("2024-01-01 03:00:00", "2024-01-03 00:00:00"), ("2024-01-01 03:10:00", "2024-01-03 00:59:59"),
                                 ("2024-01-01 05:10:00", "2024-01-01 05:20:00"), ("2023-01-01 00:00:00", "2023-01-02 00:00:00")])
def test_users_of_a_range(spark, cut):
    rng = random.Random(3)
    base = 1_704_067_200  # 2024-01-01
    rows = [(base + rng.randint(0, 3 * 86_400), rng.choice(["ru", "en", None]), rng.randint(1, 3_000)) for _ in range(20_000)]
    events = spark.createDataFrame(rows, "s long, lang string, user_id long").withColumn(
        "event_time", F.timestamp_seconds("s")).withColumn("event_date", F.to_date("event_time"))
    path = scratch_path(spark, "rollup-test")
    sketches.user_rollup(events, {"lang": F.col("lang")}).write.partitionBy("event_date").parquet(path)
    rollup = spark.read.parquet(path)
    low, high = (F.lit(t).cast("timestamp") for t in cut)
    out = {r["lang"]: r for r in sketches.users_in_range(rollup, low, high, ["lang"], events).collect()}
    seconds = [int(r) for r in spark.range(1).select(low.cast("long"), high.cast("long")).first()]
    inside = [r for r in rows if seconds[0] <= r[0] < seconds[1]]
    assert set(out) == {r[1] for r in inside}
    for lang, row in out.items():
        mine = [r for r in inside if r[1] == lang]
        users = len({r[2] for r in mine})
        assert row["count"] == len(mine) and abs(row["users"] - users) <= max(1, 4 * sketches.STANDARD_ERROR * users)


def test_a_rollup_alone_takes_whole_hours(spark):
    events = spark.createDataFrame([(1_704_067_200, 1), (1_704_067_300, 2)], "s long, user_id long").withColumn(
        "event_time", F.timestamp_seconds("s"))
    rollup = sketches.user_rollup(events, {})
    hour = [F.lit(t).cast("timestamp") for t in ("2024-01-01 00:00:00", "2024-01-01 01:00:00")]
    assert [tuple(r) for r in sketches.users_in_range(rollup, *hour, []).collect()] == [(2, 2)]
    with pytest.raises(ValueError, match="needs the events"):
        sketches.users_in_range(rollup, F.lit("2024-01-01 00:10:00").cast("timestamp"), hour[1], []).collect()
