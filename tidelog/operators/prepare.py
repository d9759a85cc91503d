"""Deduplication and byte budgets on records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.percentiles import null_safe_join
from tidelog.session import Scratch, materialize

DUPLICATE_KEYS = ("user_id", "type", "event_time")


def dedup(df: DataFrame, keep: str = "first", keys: tuple[str, ...] | None = None,
          order_by: str = "event_id") -> DataFrame:
    """One row per user, activity and event time: the one with the lowest (or highest) id.

    Only keys and ids are aggregated, with partial counts in every task, so one record repeated across a third of the
    table shuffles one narrow row per task; whole rows are then taken by a semi-join on the chosen ids. Null keys are a
    group like any other. A row without id comes after all others, and is kept where its group has no id. Of rows with
    the same keys and id one is kept. Runs a job before it returns.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"unknown choice: {keep}")
    columns = df.columns
    if keys is None:
        rows = df.withColumn("_type", F.coalesce(F.col("attrs")["type"], F.lit("")))
        keys = ("user_id", "_type", "event_time")
    else:
        rows = df
    names = [*keys, order_by]
    cells = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    pick = F.min if keep == "first" else F.max
    picked = cells.groupBy(*keys).agg(pick(order_by).alias("_id"))
    chosen = materialize(null_safe_join(cells, picked, list(keys)).filter(
        F.col(order_by).eqNullSafe(F.col("_id"))).select(*names, "_n"), "chosen")

    def taken(wanted: DataFrame) -> DataFrame:
        return null_safe_join(rows, wanted.select(*names), names, "left_semi")

    single = taken(chosen.filter("_n = 1")).select(*columns)
    repeated = chosen.filter("_n > 1")
    if repeated.isEmpty():
        return single
    whole = F.struct(*[F.col(c) for c in columns])
    one = taken(repeated).groupBy(*names).agg(F.first(whole).alias("_row")).select("_row.*")
    return single.unionByName(one)


def dedup_stream(df: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Streaming form: the first arrival within the watermark is kept, which bounds the state."""
    typed = df.withColumn("_type", F.coalesce(F.col("attrs")["type"], F.lit("")))
    return typed.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(
        ["user_id", "_type", "event_time"]).drop("_type")


def api_json_bytes(row: Column) -> Column:
    """Bytes of an API row as JSON text with ``", "`` and ``": "`` separators, non-ASCII escaped."""
    text = F.to_json(row)
    entries = F.size(row["attrs"])
    spaces = F.lit(11) + F.when(entries > 0, 2 * entries - 1).otherwise(0)  # six fields: 6 + 5
    special = F.regexp_replace(text, r"[\x00-\x7F]", "")
    beyond_bmp = F.length(F.regexp_replace(special, r"[^\x{10000}-\x{10FFFF}]", ""))
    escaped = F.octet_length(text) - F.octet_length(special) + 6 * (F.length(special) + beyond_bmp)
    ascii_only = F.octet_length(text) == F.length(text)
    return (F.when(ascii_only, F.octet_length(text)).otherwise(escaped) + spaces).cast("bigint")


def event_json_bytes() -> Column:
    """Bytes of an event-table row in its API form."""
    return api_json_bytes(F.struct(
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        F.col("record_type").alias("recordType"),
        F.col("user_id").alias("userId"),
        F.col("chat_id").alias("chatId"),
        F.col("message_id").alias("messageId"),
        F.map_filter("attrs", lambda k, v: ~k.isin("timestamp", "user_id", "chat_id", "message_id")).alias("attrs"),
    ))


def capacity_trim(df: DataFrame, key: str = "user_id", max_bytes: int = 4096, mode: str = "strict",
                  size: Column | None = None, time: str = "event_time", tie: str = "event_id") -> DataFrame:
    """Newest rows of each key within a byte budget.

    ``strict`` stops at the first row that does not fit. ``greedy`` skips it and
    goes on to older rows that still fit. ``tie`` orders rows of the same time
    and must tell them apart; sizes are at least 1. Row sizes are worked out once and stored, so this
    runs jobs before it returns.

    A running sum over a whole key would order a hot key in one task. Rows are
    range-partitioned in their order instead, which spreads a hot key, even a
    hot second of it, over many parts, and stored with the number of their part.
    """
    if mode not in ("strict", "greedy"):
        raise ValueError(f"unknown mode: {mode}")
    scratch = Scratch(df.sparkSession, "trim")
    newest = [F.col("_time").desc(), F.col("_tie").desc()]
    parts = scratch.put(df.select(
        F.col(key).alias("_key"), F.col(time).alias("_time"), F.col(tie).alias("_tie"),
        (event_json_bytes() if size is None else size).cast("bigint").alias("_size"),
    ).repartitionByRange(F.col("_key"), *newest).withColumn("_part", F.spark_partition_id()), "parts")
    if mode == "strict":
        cut = materialize(_cutoffs(parts, max_bytes), "trim-cut")
        scratch.close()
        rows = df.join(cut, F.col(key).eqNullSafe(F.col("_key")), "left")
        newer = F.struct(F.col(time).alias("t"), F.col(tie).alias("i")) > F.col("_cut")
        return rows.filter(F.col("_cut").isNull() | newer).select(*[df[c] for c in df.columns])
    kept = materialize(_greedy(scratch, parts, max_bytes), "trim-kept")
    scratch.close()
    same = (F.col(key).eqNullSafe(F.col("_key")) & (F.col(time) == F.col("_time")) & (F.col(tie) == F.col("_tie")))
    return df.join(kept, same, "left_semi")


def _position() -> Column:
    return F.struct(F.col("_time").alias("t"), F.col("_tie").alias("i"))


def _running(rows: DataFrame, amount: str) -> DataFrame:
    """``rows`` with _used, the sum of ``amount`` of its key from the newest row down to each: sums per part first, then rows of a part."""
    sums = rows.groupBy("_key", "_part").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_key", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_key", "_part").orderBy(F.col("_time").desc(), F.col("_tie").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    return null_safe_join(rows, bases, ["_key", "_part"]).withColumn("_used", F.col("_base") + F.sum(amount).over(within))


def _cutoffs(parts: DataFrame, budget: int) -> DataFrame:
    """Per key the newest row that no longer fits, for keys that have one."""
    over = _running(parts, "_size").filter(F.col("_used") > budget)
    return over.groupBy("_key").agg(F.max(_position()).alias("_cut"))


def _greedy(scratch: Scratch, parts: DataFrame, budget: int) -> DataFrame:
    """Rows kept when those that do not fit are skipped, in at most as many phases as the budget has binary digits.

    What is carried per key is the budget left and the place reached. A phase starts with R bytes left and takes L, half of
    that, or the largest row still to come if that is less. Rows of at most L bytes surely fit while more than L is left, so
    their running sum alone tells what is left anywhere before; of the larger ones, the first that fits ends the phase as
    well. Either event leaves at most R/2. So each phase is one running sum over the parts and the newest event of each
    key, and the budget halves at least, whatever the order of sizes.
    """
    state = None
    kept = None
    for phase in range(budget.bit_length() + 1):
        if state is None:
            rows = parts.withColumns({"_left": F.lit(budget).cast("bigint")}).filter(F.col("_size") <= budget)
        else:
            older = state["_at"].isNull() | (F.struct(rest["_time"].alias("t"), rest["_tie"].alias("i")) < state["_at"])
            rows = rest.join(state, rest["_key"].eqNullSafe(state["_key"]) & older & (rest["_size"] <= state["_left"])).select(
                *[rest[c] for c in parts.columns], state["_left"])
        largest = rows.groupBy("_key").agg(F.max("_size").alias("_most"))
        limited = null_safe_join(rows, largest, ["_key"]).withColumn(
            "_limit", F.least("_most", F.floor(F.col("_left") / 2))).drop("_most")
        small = F.col("_size") <= F.col("_limit")
        placed = scratch.put(_running(limited.withColumn("_sure", F.when(small, F.col("_size")).otherwise(0)), "_sure").withColumns({
            "_small": small, "_event": F.when(small, F.col("_used") + F.col("_limit") >= F.col("_left")).otherwise(
                F.col("_size") <= F.col("_left") - F.col("_used"))}), f"placed-{phase}")
        if placed.isEmpty():
            break
        spent = F.col("_used") + F.when(F.col("_small"), 0).otherwise(F.col("_size"))
        events = scratch.put(placed.filter("_event").groupBy("_key").agg(F.max(F.struct(
            _position().alias("at"), (F.col("_left") - spent).alias("left"))).alias("_e")).select(
            "_key", F.col("_e.at").alias("_at"), F.col("_e.left").alias("_left")), "events")
        met = null_safe_join(placed, events.withColumnRenamed("_left", "_next"), ["_key"], "left")
        reached = F.col("_at").isNull() | (_position() > F.col("_at"))
        taken = met.filter(reached & F.col("_small") | (_position() == F.col("_at")))
        picked = scratch.put(taken.select("_key", "_time", "_tie"), "kept")
        kept = picked if kept is None else kept.unionByName(picked)
        # Keys without an event are done: all their rows have been passed.
        rest, state = placed.select(*parts.columns), events.filter(F.col("_left") > 0)
        scratch.drop(f"placed-{phase - 1}")
    return kept if kept is not None else parts.select("_key", "_time", "_tie").limit(0)
