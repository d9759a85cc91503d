"""Headline timings; prints one JSON line.

BENCH_SF_DIR    tables to read (default /root/testdata/sf0.1)
BENCH_CPUS      local cores (default 8)
BENCH_ROWS      if set, also time a table of that many rows, copies of the events
BENCH_REPEATS   timed runs per query after one warm-up (default 3, the median counts)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from tidelog.operators import aggregate, measure, prepare, search, sketches, validate  # noqa: E402
from tidelog.operators.filters import filter_attr  # noqa: E402
from tidelog.operators.normalize import to_event_rows  # noqa: E402
from tidelog.operators.pages import RankIndex  # noqa: E402
from tidelog.plans import scenarios  # noqa: E402
from tidelog.registered.aggregates import HEAVY_HOT  # noqa: E402
from tidelog.registered.base import AS_OF, FROM, TO  # noqa: E402
from tidelog.sources import files, layout  # noqa: E402
from tidelog.sources.tables import adapt, raw_records, source_events  # noqa: E402
from tidelog.streaming import ingest  # noqa: E402


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidelog-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run, repeats: int) -> float:
    run()
    times = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 4)


def table_queries(by_user, by_type) -> dict:
    """Reads of a stored table: the user layout for points, the type layout for the rest."""
    return {
        "point_count": lambda: search.count_user_type(by_user, 42, "MESSAGE").collect(),
        "chat_summary": lambda: search.summary(by_user, chat_id=42).collect(),
        "moderation_queue": lambda: search.moderation(by_type, "MODERATION").collect(),
        "analytics_hour": lambda: aggregate.analytics(by_type, FROM, TO, "hour", 5000).collect(),
        "events_by_type_timeseries": lambda: scenarios.scenario(by_type, None, FROM, TO).collect(),
        "top_users_by_volume": lambda: scenarios.scenario(by_type, "top_users_by_volume", FROM, TO).collect(),
        "flagged_users_spike": lambda: scenarios.scenario(by_type, "flagged_users_spike", FROM, TO).collect(),
        "record_type_mix": lambda: scenarios.scenario(by_type, "record_type_mix", FROM, TO).collect(),
        "recent_hours_by_type": lambda: aggregate.recent_buckets(by_type, 2, "hour", 40, AS_OF).collect(),
        "group_lang_map": lambda: aggregate.group_attr(by_type, "lang").collect(),
        "group_lang_hot": lambda: aggregate.group_attr(by_type, "lang", hot=True).collect(),
        "filter_lang_map": lambda: filter_attr(by_type.drop("attr_lang"), "lang", "ru").agg(F.count("*")).collect(),
        "filter_lang_hot": lambda: filter_attr(by_type, "lang", "ru").agg(F.count("*")).collect(),
        "heavy_top_users": lambda: files.run_noop(scenarios.heavy_top_users(by_type, as_of=AS_OF)),
        "heavy_hour_lang": lambda: files.run_noop(scenarios.heavy_hour_lang(by_type, as_of=AS_OF)),
        "heavy_user_buckets": lambda: files.run_noop(scenarios.heavy_user_buckets(by_type, as_of=AS_OF)),
        "heavy_two_level": lambda: files.run_noop(scenarios.heavy_two_level(by_type, as_of=AS_OF)),
        "ingest_rate_by_type": lambda: files.run_noop(measure.ingest_rate(by_type, by="record_type")),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = session()
    work = tempfile.mkdtemp(prefix="tidelog-bench-")
    seconds: dict[str, float] = {}
    rows_per_sec: dict[str, float] = {}

    def load(name: str, rows: int, run, warm: bool = True) -> None:
        """Time a job that writes to a folder of its own; ``run`` takes the folder."""
        if warm:
            run(f"{work}/{name}-warm")
        start = time.perf_counter()
        run(f"{work}/{name}")
        seconds[name] = round(time.perf_counter() - start, 4)
        rows_per_sec[name] = round(rows / seconds[name])

    source = source_events(spark, sf_dir)
    events = adapt(source)
    rows = events.count()
    hot = layout.DEFAULT_HOT_COLUMNS + tuple(layout.HotColumn("attr_" + k, k) for k in HEAVY_HOT)
    for name in layout.LAYOUTS:
        load(f"write_{name}", rows, lambda path: layout.write_events(events, path, name, hot=hot))
    tables = {n: files.read_events(spark, f"{work}/write_{n}") for n in layout.LAYOUTS}
    for name, run in table_queries(tables["by_user"], tables["by_type"]).items():
        seconds[name] = timed(run, repeats)

    seconds["page_deep"] = timed(lambda: files.run_noop(RankIndex.build(events, "user_id").page(events, rows // 2, 100)), repeats)
    seconds["capacity_trim_greedy"] = timed(lambda: files.run_noop(prepare.capacity_trim(events, mode="greedy")), repeats)
    seconds["dedup"] = timed(lambda: files.run_noop(prepare.dedup(events)), repeats)
    seconds["heavy_hitters"] = timed(lambda: sketches.heavy_hitters(events, "user_id", 25).collect(), repeats)
    seconds["latency_by_kind"] = timed(
        lambda: measure.latency_summary(source, "event_type", "value").collect(), repeats)

    # The events as incoming records, some of them refused: checks and normalization, then the same through JSON and a stream.
    records = raw_records(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism).cache()
    records.count()
    load("validate_records", rows, lambda path: files.run_noop(validate.validate(records)))
    load("records_to_rows", rows, lambda path: files.run_noop(to_event_rows(records, AS_OF)))
    load("save_batch", rows, lambda path: files.save_batch(records, path, as_of=AS_OF))
    load("bulk_insert", rows, lambda path: files.bulk_insert(events, path))
    records.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{work}/topic")
    load("stream_ingest", rows, lambda path: ingest.finish(ingest.start_ingest(
        ingest.read_stream(spark, "text", path=f"{work}/topic"), f"{path}/table", f"{path}/checkpoint",
        "records", as_of=AS_OF)))

    result = {
        "metric": "event_analytics_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rows_per_sec, "rows": rows,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }

    if os.environ.get("BENCH_ROWS"):
        n = int(os.environ["BENCH_ROWS"])
        tasks = max(8, n // 500_000)
        big = {"rows": n}
        # The events as often as needed, each copy for other users.
        copies = -(-n // rows)
        base = events.repartition(tasks).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(
            "user_id", F.col("user_id") + F.col("_copy") * 1_000_000).drop("_copy").limit(n)
        load("big_bulk_insert", n, lambda path: files.bulk_insert(base, path), warm=False)
        base = files.read_events(spark, f"{work}/big_bulk_insert").drop("event_date")
        for name in layout.LAYOUTS:
            load(f"big_write_{name}", n, lambda path: layout.write_events(base, path, name, tasks=tasks), warm=False)
        for name, run in table_queries(
                *[files.read_events(spark, f"{work}/big_write_{name}") for name in layout.LAYOUTS]).items():
            big[name] = timed(run, repeats)
        for name in [k for k in seconds if k.startswith("big_")]:
            big[name] = seconds.pop(name)
            big[f"{name}_rows_per_sec"] = rows_per_sec.pop(name)
        result["big"] = big
    print(json.dumps(result))


if __name__ == "__main__":
    main()
