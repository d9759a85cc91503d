import os

import pytest
from pyspark.sql import functions as F

from tidelog.operators import aggregate, search
from tidelog.operators.filters import time_range
from tidelog.plans import scenarios
from tidelog.registered.aggregates import HEAVY_HOT
from tidelog.session import scratch_path
from tidelog.sources import files, layout
from tidelog.sources.tables import event_table

SF_DIR = "/root/testdata/sf0.001"
AS_OF = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def paths(spark):
    hot = layout.DEFAULT_HOT_COLUMNS + tuple(layout.HotColumn("attr_" + k, k) for k in HEAVY_HOT)
    return layout.write_layouts(event_table(spark, SF_DIR), scratch_path(spark, "test-layouts"), hot=hot,
                                bloom={"chat_id": 128})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_range_prunes_days(spark, paths):
    table = files.read_events(spark, paths["by_user"])
    day = time_range(table, "2024-01-10", "2024-01-10 23:59:59")
    partition_filters = plan_of(day).split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in partition_filters and ">=" in partition_filters
    files_read = {f for r in day.select("_metadata.file_path").distinct().collect() for f in [r[0]]}
    assert all("event_date=2024-01-10" in f for f in files_read)


def test_point_read_is_pushed_down(spark, paths):
    plan = plan_of(search.count_user_type(files.read_events(spark, paths["by_user"]), 7, "MESSAGE"))
    assert "EqualTo(user_id,7)" in plan and "EqualTo(record_type,MESSAGE)" in plan
    assert "attrs" not in plan.split("ReadSchema")[1]


def test_hot_column_replaces_the_map(spark, paths):
    table = files.read_events(spark, paths["by_type"])
    hot = plan_of(aggregate.group_attr(table, "lang", hot=True))
    cold = plan_of(aggregate.group_attr(table, "lang"))
    assert "attrs:map" not in hot and "attrs:map" in cold
    assert sorted(map(tuple, aggregate.group_attr(table, "lang", hot=True).collect())) == sorted(
        map(tuple, aggregate.group_attr(table, "lang").collect()))


def test_heavy_query_scans_once(spark, paths):
    heavy = scenarios.heavy_top_users(files.read_events(spark, paths["by_type"]), as_of=AS_OF)
    heavy.collect()
    plan = plan_of(heavy)
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final and "BroadcastHashJoin" in final and "TakeOrderedAndProject" in final
    assert "attrs#" not in final


def test_search_keeps_a_bounded_top(spark, paths):
    plan = plan_of(search.search(files.read_events(spark, paths["by_type"]), {"RECORD_TYPE": "message"}))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_choose_layout():
    assert layout.choose_layout(["user_id"]) == "by_user"
    assert layout.choose_layout(["record_type", "event_time"]) == "by_type"
    assert layout.choose_layout(["user_id", "record_type"]) == "by_user"
    assert layout.choose_layout(["lang"]) == "by_user"
    assert layout.choose_layout(["record_type"], ["by_user"]) == "by_user"


def test_days_are_sorted_within_files(spark, paths):
    table = files.read_events(spark, paths["by_user"])
    keyed = table.select("_metadata.file_path", "user_id", F.monotonically_increasing_id().alias("row"))
    ranges = keyed.groupBy("file_path").agg(F.collect_list("user_id").alias("users")).collect()
    assert all(r["users"] == sorted(r["users"]) for r in ranges)


def test_hot_column_status(spark):
    events = layout.add_hot_columns(event_table(spark, SF_DIR), layout.DEFAULT_HOT_COLUMNS[:1])
    status = {r["name"]: r for r in layout.hot_columns_status(events).collect()}
    assert status["attr_lang"]["exists"] and not status["attr_score"]["exists"]
    assert status["attr_source"]["expression"] == "attrs['source']"


def test_scenario_list(spark):
    assert [r["id"] for r in scenarios.scenarios(spark).collect()] == [
        "events_by_type_timeseries", "top_users_by_volume", "flagged_users_spike",
        "attrs_source_lang_breakdown", "record_type_mix"]


def test_bad_search_filters(spark):
    events = event_table(spark, SF_DIR)
    with pytest.raises(ValueError, match="USER_ID must be a number"):
        search.search(events, {"user_id": "seven"})
    with pytest.raises(ValueError, match="Invalid attribute name"):
        search.search(events, {"la ng": "ru"})
    quoted = search.search(events, {"lang": "ru' OR '1'='1"})
    assert quoted.count() == 0


def test_hot_filters_are_pushed(spark, tmp_path):
    from tidelog.operators import filters
    from tidelog.plans.scenarios import heavy_registrations
    from tidelog.registered.base import AS_OF
    from tidelog.sources.tables import event_table

    path = str(tmp_path / "pushed")
    layout.write_events(event_table(spark, "/root/testdata/sf0.001"), path,
                        hot=tuple(layout.HotColumn("attr_" + k, k) for k in HEAVY_HOT))
    table = spark.read.parquet(path)

    def pushed(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("PushedFilters"):].split("\n")[0]

    assert "EqualTo(attr_gender,0)" in pushed(filters.filter_attr(table, "gender", "0"))
    assert "EqualTo(attr_gender,1)" in pushed(filters.filter_query_string(table, "gender=1"))
    assert "attr_type" in pushed(filters.filter_types(table, "MESSAGE_SENT,REGISTRATION"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    heavy = pushed(heavy_registrations(table, as_of=AS_OF))
    assert all(f"attr_{key}" in heavy for key in ("type", "gender") if f"attr_{key}" in table.columns)


def test_writers_bring_days_together(spark, tmp_path):
    """Files follow days, not tasks times days."""
    events = event_table(spark, SF_DIR).repartition(16)
    files.bulk_insert(events, str(tmp_path / "bulk"))
    stored = files.read_events(spark, str(tmp_path / "bulk"))
    days = stored.select("event_date").distinct().count()
    assert stored.count() == events.count()
    assert days <= len(stored.inputFiles()) <= 2 * days


def test_stats_read_footers_only(spark, paths, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = plan_of(layout.footer_count(own, [paths["by_user"]]))
    assert "PushedAggregation: [COUNT(*)]" in plan
    stats = layout.file_stats(spark, paths["by_user"]).first()
    assert stats.rows == event_table(spark, SF_DIR).count()
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(paths["by_user"].removeprefix("file:"))
             for f in names if f.endswith(".parquet")]
    assert (stats.files, stats.bytes) == (len(sizes), sum(sizes)) and stats.bytes_per_row == sum(sizes) / stats.rows
    (tmp_path / "empty").mkdir()
    assert tuple(layout.file_stats(spark, str(tmp_path / "empty")).first()) == (0, 0, 0, 0.0)
    assert [tuple(r)[:3] for r in layout.layout_stats(spark, {"none": []}).collect()] == [("none", 0, 0)]


def test_listed_ids_and_no_limit(spark):
    from tidelog.operators import filters

    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "event_id long, t string")
    listed = [1.9, None, "2", 3.0, "x", float("nan"), float("inf"), 10**30]
    got = filters.filter_ids(table, listed[:-1])
    assert sorted(r[0] for r in got.collect()) == [2, 3]
    assert [r[0] for r in filters.filter_ids(table, ["a", None, 5], "t").collect()] == [1]
    events = event_table(spark, SF_DIR)
    for name in ("top_users_by_volume", "flagged_users_spike", "attrs_source_lang_breakdown", "record_type_mix", None):
        every = scenarios.scenario(events, name, "2024-01-01", "2024-01-31", None).count()
        assert scenarios.scenario(events, name, "2024-01-01", "2024-01-31", every + 1).count() == every > 3
    assert aggregate.recent_buckets(events, 30, "hour", None, AS_OF).count() > 40
    assert scenarios.heavy_hour_lang(events, as_of=AS_OF, limit=None).count() > 0
