"""Mergeable sketches: distinct users per hour, merged for any range; frequent values, recounted exactly.

Both are kept in rollup tables, a small row per group, and answer a range without reading the events again, but for what
is told to be exact.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.filters import PARTITION
from tidelog.operators.percentiles import null_safe_join

# Size of a distinct-count sketch: 2^LG_K registers, relative standard error about 1.04 / sqrt(2^LG_K).
LG_K = 12
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)


def user_rollup(df: DataFrame, by: Mapping[str, Column], users: str = "user_id") -> DataFrame:
    """Per hour and group: events and a sketch of their users; store it by ``event_date``, read it with ``users_in_range``."""
    return df.groupBy(F.date_trunc("hour", "event_time").alias("hour"), *[c.alias(n) for n, c in by.items()]).agg(
        F.count("*").alias("count"), F.hll_sketch_agg(users, LG_K).alias("users"),
    ).withColumn(PARTITION, F.to_date("hour"))


def users_in_range(rollup: DataFrame, start: Column, end: Column, by: list[str], events: DataFrame | None = None,
                   cut: Mapping[str, Column] | None = None, users: str = "user_id") -> DataFrame:
    """Events and approximate distinct users per group from ``start`` (included) to ``end`` (excluded).

    Whole hours come from the rollup, whose sketches are merged; the hours that the range cuts from ``events``, grouped by
    ``cut`` as the rollup was. Without ``events`` a range has to begin and end on the hour.
    """
    first = F.date_trunc("hour", start)
    first = F.when(first < start, first + F.expr("INTERVAL 1 HOUR")).otherwise(first)
    last = F.date_trunc("hour", end)
    days = F.col(PARTITION).between(F.to_date(first), F.to_date(last))
    parts = rollup.filter(days & (F.col("hour") >= first) & (F.col("hour") < last)).select(*by, "count", "users")
    if events is None:
        if not rollup.sparkSession.range(1).select((first == start) & (last == end)).first()[0]:
            raise ValueError("a range that cuts hours needs the events")
    else:
        time = F.col("event_time")
        edge = (time >= start) & (time < end) & ((time < first) | (time >= last))
        edges = events.filter(edge)
        if PARTITION in events.columns:
            edges = edges.filter(F.col(PARTITION).isin(F.to_date(start), F.to_date(end)))
        rows = user_rollup(edges, cut or {n: F.col(n) for n in by}, users)
        parts = parts.unionByName(rows.select(*by, "count", "users"))
    merged = parts.groupBy(*by).agg(F.sum("count").alias("count"), F.hll_union_agg("users").alias("users"))
    return merged.withColumn("users", F.hll_sketch_estimate("users"))


# Frequent-value sketches: values tracked, and candidates taken from them.
TRACKED = 100_000
CANDIDATES = 1_000
# A sketch tracks in a table of at least TRACKED / 0.75 places and is off by at most 3.5 / places of all rows; a value that
# it does not list may have twice that.
UNLISTED_SHARE = 2 * 3.5 * 0.75


def frequent_rollup(df: DataFrame, column: str, by: list[str] | None = None, tracked: int = TRACKED) -> DataFrame:
    """Per group (by default the day): rows and a sketch of the frequent values of ``column``."""
    keys = [PARTITION] if by is None else by
    rows = df if PARTITION in df.columns or by is not None else df.withColumn(PARTITION, F.to_date("event_time"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.expr(f"approx_top_k_accumulate(`{column}`, {int(tracked)})").alias("frequent"))


def heavy_hitters(df: DataFrame, column: str, n: int, rollup: DataFrame | None = None, tracked: int = TRACKED) -> DataFrame:
    """The ``n`` most frequent values of a column with their exact counts, ties to the smaller value (null first).

    The merged sketch names at most ``CANDIDATES`` values, which are recounted exactly: what is shuffled is bounded by the
    sketches and the candidates, not by the number of values. The recount also proves that nothing else can be among the
    first ``n``: a value not listed has no more rows than the sketch can be off. Where that proof fails, as with values
    that are all about as frequent, all values are counted. ``rollup`` may hold sketches of the same rows, from
    ``frequent_rollup``. Runs a job or two before it returns.
    """
    if n < 1:
        raise ValueError(f"n must be positive: {n}")
    sketches = frequent_rollup(df, column, [], tracked) if rollup is None else rollup
    merged = sketches.agg(F.sum("rows").alias("rows"), F.expr(f"approx_top_k_combine(frequent, {int(tracked)})").alias("s")).select(
        "rows", F.expr(f"approx_top_k_estimate(s, {min(CANDIDATES, tracked)})").alias("top")).first()
    ranked = [F.col("count").desc(), F.col(column).asc()]
    if merged["rows"]:
        listed = df.sparkSession.createDataFrame(
            [(t["item"],) for t in merged["top"]], df.select(column).schema)
        # At most CANDIDATES rows.
        counts = null_safe_join(df.select(column), F.broadcast(listed), [column], "left_semi").groupBy(column).agg(
            F.count("*").alias("count"))
        first = counts.orderBy(*ranked).limit(n)
        least = [r["count"] for r in first.collect()]
        unlisted = UNLISTED_SHARE / tracked * merged["rows"]
        if len(merged["top"]) == min(CANDIDATES, tracked):
            unlisted = max(unlisted, merged["top"][-1]["count"])
        if len(least) == n and least[-1] > unlisted:
            return first
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(*ranked).limit(n)
