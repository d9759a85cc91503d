"""Hot keys, byte budgets and percentiles against brute force."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import measure, pages, percentiles, prepare, search
from tidelog.operators.percentiles import exact_percentiles, order_key
from tidelog.session import scratch_path, scratch_root


def brute_percentile(values, p, rule):
    values = sorted(values)
    n = len(values)
    if rule == "floor":
        return values[min(max(int(n * p / 100), 0), n - 1)]
    return values[int(round(p / 100.0 * (n - 1)))]


WANTED = {"p0": 0.0, "p50": 50.0, "p95": 95.0, "p100": 100.0}


@pytest.mark.parametrize("rule", ["floor", "round"])
def test_percentiles(spark, rule):
    rng = random.Random(1)
    groups = {
        "one": [5.0], "two": [1.0, 2.0], "hundred": [float(i) for i in range(100)],
        "copies": [7.0] * 20_000 + [rng.random() for _ in range(3_000)],
        "skewed": [round(rng.lognormvariate(3, 2), 3) for _ in range(30_000)], None: [3.0, 1.0, 2.0],
        "signs": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2_000)],
        "close": [1.0 + i * 2.0 ** -52 for i in range(500)] + [1.0 - i * 2.0 ** -53 for i in range(500)],
        "tiny": [i * 5e-324 for i in range(-300, 300)] + [2.0 ** -1022, 2.0 ** -1022 * 0.75, -0.0],
        "ends": [math.inf, -math.inf, 0.0, 1.7976931348623157e308, -1.7976931348623157e308],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("empty", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    out = {r["k"]: r for r in exact_percentiles(frame, ["k"], "v", WANTED, rule).collect()}
    for k, vs in groups.items():
        assert [out[k][n] for n in WANTED] == [brute_percentile(vs, p, rule) for p in WANTED.values()], k
    assert "empty" not in out
    alone = exact_percentiles(frame, [], "v", WANTED, rule).collect()
    assert [tuple(r) for r in alone] == [tuple(brute_percentile([v for _, v in rows if v is not None], p, rule) for p in WANTED.values())]


def test_bins_never_fall(spark):
    rng = random.Random(6)
    doubles = sorted({rng.choice([-1, 1]) * rng.choice([2.0 ** rng.randint(-1074, 1023), rng.random() * 2.0 ** rng.randint(-1060, 1023)])
                      for _ in range(3_000)} | {0.0, math.inf, -math.inf, 2.0 ** 1023 * 1.5}) + [math.nan]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(doubles)], "i int, v double")
    bins = [r[0] for r in frame.orderBy("i").select(percentiles.first_bin(F.col("v"), True)).collect()]
    assert bins == sorted(bins) and len(set(bins)) > 2_000
    for low, high in ((-math.inf, -1e308), (1e308, math.inf), (1.0, 1.0 + 2 ** -52), (5e-324, 1e-323), (1.0, 1.04)):
        inside = [low, *[low + (high - low) * k / 999 for k in range(1000) if math.isfinite(high - low)], high]
        frame = spark.createDataFrame([(i, v, low, high) for i, v in enumerate(inside)], "i int, _k double, _lo double, _hi double")
        bins = [r[0] for r in frame.orderBy("i").select(percentiles.next_bin(True)).collect()]
        assert bins == sorted(bins) and bins[0] < bins[-1]


@pytest.mark.parametrize("kind, values", [
    ("bigint", [-2**63, 2**63 - 1, 0, -1, 5, 5]), ("int", [3, -3, 7]), ("decimal(10,3)", ["-0.500", "12.345", "0.001"]),
    ("date", ["2024-01-01", "1969-12-31", "2024-02-01"]), ("timestamp", ["2024-01-01 00:00:00.000001", "1960-01-01 00:00:00"]),
    ("float", [0.1, -0.1, 3.0e38]),
])
def test_percentiles_of_types(spark, kind, values):
    frame = spark.createDataFrame([(str(v),) for v in values], "t string").select(F.col("t").cast(kind).alias("v"))
    ordered = [r[0] for r in frame.orderBy("v").collect()]
    got = exact_percentiles(frame, [], "v", {"low": 0.0, "mid": 50.0, "high": 100.0})
    assert tuple(got.first()) == (ordered[0], ordered[len(ordered) // 2], ordered[-1])
    assert got.schema["mid"].dataType.simpleString() == kind
    with pytest.raises(TypeError):
        exact_percentiles(frame.select(F.lit("x").alias("v")), [], "v", {"p": 1.0})


def test_percentile_passes_move_no_rows_for_their_group(spark, monkeypatch):
    passes = []
    inside = percentiles._inside

    def kept(keyed, ranges, keys):
        passes.append((keyed, ranges))
        return inside(keyed, ranges, keys)

    monkeypatch.setattr(percentiles, "_inside", kept)
    rng = random.Random(3)
    frame = spark.createDataFrame([("k", rng.lognormvariate(3, 2)) for _ in range(20_000)], "k string, v double")
    exact_percentiles(frame, ["k"], "v", WANTED).collect()
    assert 1 <= len(passes) <= 5
    keyed = frame.select("k", F.col("v").alias("_v"), order_key(F.col("v"), frame.schema["v"].dataType).alias("_k"))
    ranges = spark.createDataFrame([("k", 0, 5, 0.0, 1e18)], "k string, _i int, _rank long, _lo double, _hi double")
    for limit in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        plan = inside(keyed, ranges, ["k"])._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert "Window" not in plan and dealt
        rows = [line for line in dealt if "_salt" in line or "_bin" in line]
        assert len(rows) == len(dealt) and any("_bin" in line for line in rows)


def test_summary_of_nothing(spark):
    assert measure.latency_summary(spark.createDataFrame([], "latency_ms double")).count() == 0


def brute_trim(rows, budget, greedy):
    kept = []
    for user in {r[0] for r in rows}:
        used = 0
        for r in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2]), reverse=True):
            if used + r[3] <= budget:
                used += r[3]
                kept.append(r[2])
            elif not greedy:
                break
    return sorted(kept)


@pytest.mark.parametrize("mode", ["strict", "greedy"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_capacity_trim(spark, mode, seed):
    rng = random.Random(seed)
    # User 1 has a third of the rows; many rows share a second; some rows exceed the whole budget.
    rows = [(1 if rng.random() < 0.33 else rng.randint(2, 9), rng.randint(0, 20_000) // 7 * 7, i,
             rng.choice([60, 100, 250, 900, 5_000])) for i in range(600)]
    frame = spark.createDataFrame(rows, "user_id bigint, s bigint, event_id bigint, bytes bigint").withColumn(
        "event_time", F.timestamp_seconds("s"))
    out = prepare.capacity_trim(frame, max_bytes=4096, mode=mode, size=F.col("bytes"))
    assert sorted(r["event_id"] for r in out.select("event_id").collect()) == brute_trim(rows, 4096, mode == "greedy")


@pytest.mark.parametrize("sizes", [
    [x for i in range(300) for x in (1, 1000 - i)], [700] * 5 + [200, 90] * 50, [2 ** k for k in range(10, -1, -1)] * 3,
    [1] * 1500, [1000, 1, 1, 1, 999] * 3,
])
def test_greedy_phases_are_bounded_by_the_budget(spark, monkeypatch, sizes):
    phases = []
    running = prepare._running
    monkeypatch.setattr(prepare, "_running", lambda *a: phases.append(1) or running(*a))
    rows = [(key, -i, -i, s) for key in (1, 2, None) for i, s in enumerate(sizes[key or 0:])]
    frame = spark.createDataFrame(rows, "user_id bigint, s bigint, event_id bigint, bytes bigint").withColumn(
        "event_time", F.timestamp_seconds("s"))
    before = set(os.listdir(scratch_root(spark)))
    got = prepare.capacity_trim(frame, max_bytes=1000, mode="greedy", size=F.col("bytes"))
    assert sorted((r["user_id"] or 0, r["event_id"]) for r in got.collect()) == sorted(
        (key or 0, e) for key in (1, 2, None) for e in brute_trim([r for r in rows if r[0] == key], 1000, True))
    assert len(phases) <= 11
    # All that is left is what the result still reads.
    new = set(os.listdir(scratch_root(spark))) - before
    assert [n.rsplit("-", 1)[0] for n in new if os.listdir(os.path.join(scratch_root(spark), n))] == ["trim-kept"]


def test_exact_fit_and_oversized_newest(spark):
    rows = [(1, 10, 1, 100), (1, 20, 2, 100), (1, 30, 3, 500), (2, 10, 4, 100), (2, 20, 5, 100)]
    frame = spark.createDataFrame(rows, "user_id bigint, s bigint, event_id bigint, bytes bigint").withColumn(
        "event_time", F.timestamp_seconds("s"))

    def kept(mode):
        out = prepare.capacity_trim(frame, max_bytes=200, mode=mode, size=F.col("bytes"))
        return sorted(r["event_id"] for r in out.collect())

    assert kept("strict") == [4, 5]
    assert kept("greedy") == [1, 2, 4, 5]


def test_json_size_matches_a_plain_dump(spark):
    import json

    attrs = {"a": "x", "b": 'quote " and \\', "c": "Привет", "d": "😀!"}
    frame = spark.createDataFrame([("2026-03-21T10:00:00Z", "MESSAGE", 1, 22, 333, attrs),
                                   ("2026-03-21T10:00:00Z", "OTHER", 1, 0, 0, {})],
                                  "eventTime string, recordType string, userId bigint, chatId bigint, "
                                  "messageId bigint, attrs map<string,string>")
    sizes = frame.select("*", prepare.api_json_bytes(F.struct("*")).alias("size")).collect()
    for row in sizes:
        plain = {k: row[k] for k in row.asDict() if k != "size"}
        assert row["size"] == len(json.dumps(plain).encode())


def test_dedup_of_a_hot_record(spark):
    copies = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("user_id"),
        F.create_map(F.lit("type"), F.lit("LOGIN")).alias("attrs"),
        F.timestamp_seconds(F.lit(0)).alias("event_time"), F.col("id").alias("event_id"))
    first = prepare.dedup(copies)
    assert first.count() == copies.select("user_id").distinct().count()
    assert first.filter("user_id = 1").first()["event_id"] == 0
    assert prepare.dedup(copies, "last").filter("user_id = 1").first()["event_id"] == 29_997
    # Whole rows pass a semi-join only.
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Aggregate" not in plan and "Window" not in plan


def test_dedup_of_nulls_and_equal_ids(spark):
    rows = [(1, "a", 5, "x"), (1, "a", 5, "x"), (1, "a", 6, "y"), (None, "a", 2, "n"), (None, "a", 1, "m"), (None, "a", None, "o"),
            (3, None, None, "p"), (3, None, None, "q"), (4, "z", None, "r"), (4, "z", 9, "s")]
    frame = spark.createDataFrame(rows, "k int, t string, event_id int, v string")
    for keep, want in (("first", {(1, "a", 5, "x"), (None, "a", 1, "m"), (4, "z", 9, "s")}),
                       ("last", {(1, "a", 6, "y"), (None, "a", 2, "n"), (4, "z", 9, "s")})):
        got = [tuple(r) for r in prepare.dedup(frame, keep, ("k", "t")).collect()]
        assert len(got) == 4 and want < set(got) and {r[3] for r in got if r[0] == 3} <= {"p", "q"}
    assert prepare.dedup(frame.limit(0), keys=("k",)).collect() == []
    with pytest.raises(ValueError):
        prepare.dedup(frame, "any", ("k",))


def paged(rows, column, ascending):
    """Ids in the order of pages: column, then id, nulls first when ascending."""
    key = lambda r: (r[column] is not None, r[column] if r[column] is not None else 0, r["event_id"])
    return [r["event_id"] for r in sorted(rows, key=key, reverse=not ascending)]


@pytest.fixture(scope="module")
def page_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(0, 3 * 86_400, 6_000)]), rng.choice([None, 7, 7, 7, rng.randint(0, 50)]), i // 2 * 2 if i < 40 else i)
            for i in range(1_000)]
    frame = spark.createDataFrame(rows, "s bigint, user_id bigint, event_id bigint").withColumn(
        "event_time", F.timestamp_seconds("s")).withColumn("event_date", F.to_date("event_time"))
    return [{"event_time": s, "user_id": u, "event_id": i} for s, u, i in rows], frame.cache()


@pytest.mark.parametrize("ascending", [False, True])
@pytest.mark.parametrize("column", ["event_time", "user_id", "event_id"])
def test_deep_pages(spark, page_rows, monkeypatch, column, ascending):
    rows, frame = page_rows
    frame = frame.drop("event_date") if column == "event_time" else frame
    whole = paged(rows, column, ascending)
    index = pages.RankIndex.build(frame, column, ascending, tasks=7)
    assert index.total == len(rows) and len(index.starts) > 1
    for offset, limit in ((0, 30), (15, 1), (499, 77), (990, 30), (5_000, 30), (700, None), (3, 0)):
        got = [r["event_id"] for r in index.page(frame, offset, limit).collect()]
        assert got == whole[offset:None if limit is None else offset + limit], (offset, limit)
    plan = index.page(frame, 640, 50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=5" in plan
    before = set(os.listdir(scratch_root(spark)))
    monkeypatch.setattr(search, "TOP_K_ROWS", 20)
    got = [r["event_id"] for r in search.page(frame, 811, 30, column, ascending).collect()]
    assert got == whole[811:841] and set(os.listdir(scratch_root(spark))) == before
    with pytest.raises(ValueError):
        index.page(frame, -1, 10)


@pytest.mark.parametrize("ascending", [False, True])
def test_pages_of_a_stored_table_read_their_days_only(spark, page_rows, ascending):
    rows, frame = page_rows
    dated = frame.filter("event_time IS NOT NULL")
    path = scratch_path(spark, "paged")
    dated.write.partitionBy("event_date").parquet(path)
    stored = spark.read.parquet(path)
    whole = paged([r for r in rows if r["event_time"] is not None], "event_time", ascending)
    got = pages.RankIndex.build(stored, ascending=ascending).page(stored, 300, 40)
    assert [r["event_id"] for r in got.collect()] == whole[300:340]
    assert "event_date" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("ascending", [False, True])
@pytest.mark.parametrize("column", ["event_time", "user_id"])
def test_page_tokens(spark, page_rows, column, ascending):
    rows, frame = page_rows
    rows, frame = [r for r in rows if r["event_id"] >= 40], frame.filter("event_id >= 40")
    whole, token, got = paged(rows, column, ascending), None, []
    for _ in range(6):
        page = pages.page_after(frame, token, 170, column, ascending).collect()
        got += [r["event_id"] for r in page]
        token = page[-1]["page_token"]
    assert got == whole
    assert pages.page_after(frame, token, 170, column, ascending).collect() == []
    plan = pages.page_after(frame, token, 170, column, ascending)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=170" in plan
    with pytest.raises(ValueError):
        pages.page_after(frame, "[1]", 10)


def test_running_total_and_windows(spark):
    frame = spark.range(5_000).select(F.timestamp_seconds(F.col("id") * 97).alias("ingest_time"),
                                      F.lit("A").alias("record_type"))
    last = measure.trend(frame).orderBy(F.col("window_start").desc()).first()
    assert last["total"] == 5_000
    sliding = measure.increase(frame, "5 minutes", slide="1 minute")
    assert sliding.agg(F.sum("count")).first()[0] == 5 * 5_000
    with pytest.raises(ValueError):
        measure.seconds_of("five minutes")
    assert math.isclose(measure.ingest_rate(frame).agg(F.sum("rate")).first()[0], 5_000 / 60)
