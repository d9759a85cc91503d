"""Rates over ingest time and summaries of measurements.

The windowed rates take batches and streams. On a batch, sliding windows are
built from per-slide counts, so that rows are counted before they are copied
into every window they belong to.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.percentiles import exact_percentiles, null_safe_join

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds_of(duration: str) -> int:
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", duration)
    if not found:
        raise ValueError(f"not a duration: {duration}")
    return int(found[1]) * _UNITS[found[2]]


def windowed_counts(df: DataFrame, window: str, slide: str | None = None, by: list[str] | None = None,
                    time: str = "ingest_time", watermark: str | None = None) -> DataFrame:
    """Count per time window (and group) as window_start, groups, count."""
    by = by or []
    if df.isStreaming:
        rows = df.withWatermark(time, watermark) if watermark else df
        counts = rows.groupBy(F.window(time, window, slide).alias("w"), *by).agg(F.count("*").alias("count"))
    elif slide and seconds_of(slide) != seconds_of(window) and seconds_of(window) % seconds_of(slide) == 0:
        steps = df.groupBy(F.window(time, slide).alias("s"), *by).agg(F.count("*").alias("n"))
        counts = steps.withColumn("at", F.col("s.start")).groupBy(
            F.window("at", window, slide).alias("w"), *by).agg(F.sum("n").alias("count"))
    else:
        counts = df.groupBy(F.window(time, window, slide).alias("w"), *by).agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("window_start"), *by, "count")


def ingest_rate(df: DataFrame, window: str = "1 minute", by: str | None = None, slide: str | None = None,
                time: str = "ingest_time", watermark: str | None = None) -> DataFrame:
    """Events per second in each window, overall or per ``by``."""
    counts = windowed_counts(df, window, slide, [by] if by else [], time, watermark)
    return counts.withColumn("rate", F.col("count") / F.lit(float(seconds_of(window))))


def increase(df: DataFrame, window: str = "5 minutes", by: str = "record_type", slide: str = "1 minute",
             time: str = "ingest_time", watermark: str | None = None) -> DataFrame:
    """Events added within each sliding window, per type."""
    return windowed_counts(df, window, slide, [by], time, watermark)


def trend(df: DataFrame, time: str = "ingest_time") -> DataFrame:
    """Events per minute and the running total up to each minute.

    Days carry the running total over, so the one window that is not
    partitioned sees a row per day only.
    """
    return running_totals(df.groupBy(F.date_trunc("minute", time).alias("window_start")).agg(F.count("*").alias("count")))


def trend_stream(df: DataFrame, path: str, checkpoint: str, time: str = "ingest_time", trigger: dict | None = None):
    """``trend`` of a stream, as a started query; read the newest state with ``read_trend``.

    The state keeps one count per minute, however many rows came; each micro-batch writes all totals anew to a folder of
    its own, ``batch=<number>``, so that a replay writes the same again and readers never see half of one.
    """
    counts = df.groupBy(F.date_trunc("minute", time).alias("window_start")).agg(F.count("*").alias("count"))

    def write(minutes: DataFrame, batch_id: int) -> None:
        running_totals(minutes).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return counts.writeStream.outputMode("complete").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_trend(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the newest finished micro-batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [str(f.getPath().getName()) for f in fs.listStatus(folder)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    newest = max(done, key=lambda name: int(name.removeprefix("batch=")))
    return spark.read.parquet(f"{path}/{newest}")


def running_totals(counts: DataFrame) -> DataFrame:
    """Counts per minute with the total up to each."""
    minutes = counts.withColumn("_day", F.to_date("window_start"))
    days = minutes.groupBy("_day").agg(F.sum("count").alias("_n")).withColumn("_all", F.lit(1))
    before = Window.partitionBy("_all").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_day").orderBy("window_start")
    return minutes.join(carried, "_day").select(
        "window_start", "count", (F.col("_before") + F.sum("count").over(within)).alias("total"))


def type_share(df: DataFrame, window: str = "1 minute", by: str = "record_type",
               time: str = "ingest_time") -> DataFrame:
    """Each type's share of the window's events."""
    counts = windowed_counts(df, window, None, [by], time)
    whole = Window.partitionBy("window_start")
    return counts.withColumn("share", F.col("count") / F.sum("count").over(whole))


def error_rate(checked: DataFrame, window: str = "1 minute", time: str = "ingest_time", error: str = "error",
               watermark: str | None = None) -> DataFrame:
    """Refused records over all records, per window; ``checked`` are records with an ``error`` where refused, checked once."""
    rows = checked.withWatermark(time, watermark) if checked.isStreaming and watermark else checked
    counts = rows.groupBy(F.window(time, window).alias("w")).agg(
        F.count(F.col(error)).alias("failed"), F.count("*").alias("count"))
    # The guard acts on rates per second, as clamp_min(success + failure, 1e-9) does.
    seconds = float(seconds_of(window))
    rate = (F.col("failed") / seconds) / F.greatest(F.col("count") / seconds, F.lit(1e-9))
    return counts.select(F.col("w.start").alias("window_start"), "failed", "count", rate.alias("error_rate"))


def latency_summary(df: DataFrame, by: str | list[str] | None = None, value: str = "latency_ms",
                    rule: str = "floor", percents=(50, 95, 99), digits: int | None = 2,
                    approximate: bool = False) -> DataFrame:
    """Count, average and percentiles per group.

    ``rule`` picks the rank (see ``rank_index``). ``approximate`` trades exact
    ranks for one aggregation pass.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    names = {f"p{p}_ms": float(p) for p in percents}

    def shown(column: Column) -> Column:
        return column if digits is None else F.bround(column, digits)

    basics = {
        "count": F.count("_v"),
        "avg_ms": shown(F.sum(F.col("_v").cast("decimal(30,6)")).cast("double") / F.count("_v")),
    }
    if approximate:
        rows = df.select(*keys, F.col(value).alias("_v"))
        return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in basics.items()], *[
            shown(F.percentile_approx("_v", p / 100.0, 10000)).alias(n) for n, p in names.items()])
    ranked = exact_percentiles(df, keys, value, names, rule, basics)
    return ranked.select(*keys, *basics, *[shown(F.col(n)).alias(n) for n in names])


def stage_summary(df: DataFrame, stage: str = "stage", ok: str = "ok", time: str = "at",
                  duration_sec: float | None = None, rule: str = "round") -> DataFrame:
    """Attempts, outcomes, throughput and latency of each load stage.

    Elapsed time is ``duration_sec``, else the span of ``time`` in the stage.
    """
    span = F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))
    elapsed = F.lit(float(duration_sec)) if duration_sec else span / F.lit(1e6)
    totals = df.groupBy(stage).agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col(ok)).alias("ok"),
        F.count_if(~F.col(ok)).alias("fail"),
        F.greatest(elapsed, F.lit(1e-9)).alias("elapsed_sec"),
    ).withColumns({
        "throughput": F.col("ok") / F.col("elapsed_sec"),
        "success_rate": F.col("ok") / F.col("attempted"),
    })
    latency = latency_summary(df, stage, "latency_ms", rule, digits=None).drop("count", "avg_ms")
    return null_safe_join(totals, latency, [stage])


def compare_variants(df: DataFrame, variants: list[str], by: str = "query", variant: str = "variant",
                     value: str = "latency_ms") -> DataFrame:
    """avg, p50 and p95 of each variant side by side, one row per compared query."""
    summary = latency_summary(df, [by, variant], value, percents=(50, 95))
    out = []
    for v in variants:
        for metric in ("avg_ms", "p50_ms", "p95_ms"):
            out.append(F.max(F.when(F.col(variant) == v, F.col(metric))).alias(f"{v}_{metric}"))
    return summary.groupBy(by).agg(*out)


def payload_stats(df: DataFrame, payload: str = "message") -> DataFrame:
    """Distribution of payload bytes and of custom fields: count, min, avg, max, p50, p95."""
    from tidelog.operators.aggregate import custom_fields

    sizes = df.select(F.octet_length(F.col(payload)).cast("bigint").alias("payload_bytes"),
                      custom_fields(F.col(payload)).cast("bigint").alias("custom_fields"))
    long = sizes.select(F.explode(F.create_map(
        F.lit("payload_bytes"), F.col("payload_bytes"), F.lit("custom_fields"), F.col("custom_fields"),
    )).alias("metric", "v")).filter(F.col("v").isNotNull())
    return exact_percentiles(long, ["metric"], "v", {"p50": 50.0, "p95": 95.0}, store=True, extras={
        "count": F.count("_v"), "min_value": F.min("_v"), "avg_value": F.avg("_v"), "max_value": F.max("_v")})
