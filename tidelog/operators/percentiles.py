"""Exact order statistics per group by iterated histogram selection.

One pass counts the values of each group in coarse ranges: doubles by sign and sixteenth of a binade, whole numbers by
their upper bits. The range that holds a wanted rank is narrowed to the smallest and largest value counted in it and split
evenly in ``BINS`` for the next pass, until it holds one value. Each pass is a partial aggregation in every task, so what
meets is a bounded number of counts per group and wanted rank, however many rows a group has; no rows are moved for their
group. Every pass tells the smallest value of a range from its largest, and a range of the first pass spans less than 2^52
different numbers, so that passes are few whatever the values.

The ranges of a pass are stored and joined to the rows on group and a salt, so that even where Spark does not broadcast
them a group's rows spread over ``SALTS`` tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import Scratch, materialize

BINS = 4096
SALTS = 16
# The first pass counts whole numbers by the bits above these, doubles by this part of a power of two.
UPPER_BITS = 52
PER_BINADE = 16


def rank_index(total: Column, p: float, rule: str) -> Column:
    """Zero-based rank of percentile ``p`` among ``total`` values.

    ``floor``: whole part of n*p/100, at most n-1. ``round``: p/100*(n-1)
    rounded half to even.
    """
    if rule == "floor":
        rank = F.floor(total * F.lit(float(p)) / 100)
    elif rule == "round":
        rank = F.bround(F.lit(p / 100.0) * (total - 1), 0)
    else:
        raise ValueError(f"unknown rule: {rule}")
    return F.greatest(F.least(rank.cast("bigint"), total - 1), F.lit(0).cast("bigint"))


def order_key(value: Column, kind: T.DataType) -> Column:
    """A long or double that orders values of this type as Spark does; equal for equal values only."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value.cast("double")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return F.replace(value.cast("string"), F.lit("."), F.lit("")).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    raise TypeError(f"no percentiles of {kind.simpleString()}")


def first_bin(key: Column, double: bool) -> Column:
    """A whole number that never falls as the key grows."""
    if not double:
        return F.shiftright(key, UPPER_BITS)
    # Positive for any size but zero.
    size = F.least(F.floor(F.log2(F.abs(key)) * PER_BINADE), F.lit(1025 * PER_BINADE)) + 1100 * PER_BINADE
    return F.when(F.isnan(key), F.lit(1 << 20)).when(key == 0, 0).when(key < 0, -size).otherwise(size)


def next_bin(double: bool) -> Column:
    """The number of the even part of _lo .. _hi, of ``BINS``, that holds _k; monotone, and not the same for _lo and _hi."""
    if double:
        part = F.floor((F.col("_k") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)
        # Next to infinity, which no division reaches.
        return F.coalesce(F.when(F.col("_hi") == float("inf"), F.when(F.col("_k") == F.col("_hi"), 1).otherwise(0)).when(
            F.col("_lo") == float("-inf"), F.when(F.col("_k") == F.col("_lo"), 0).otherwise(1)).otherwise(part), F.lit(0))
    return F.expr(f"(_k - _lo) DIV ((_hi - _lo) DIV {BINS} + 1)")


def exact_percentiles(df: DataFrame, by: list[str], value: str, percents: dict[str, float],
                      rule: str = "floor", extras: dict[str, Column] | None = None, store: bool = False) -> DataFrame:
    """One row per group with a column per entry of ``percents`` (name -> percentile).

    ``extras`` are further aggregates of the group, over its value column ``_v``. Null values are not counted. ``df`` is
    read once per pass; ``store`` writes groups and values to scratch first, for sources that are costly to make. Runs
    jobs before it returns.
    """
    spark, keys = df.sparkSession, by or ["_all"]
    scratch = Scratch(spark, "percentiles")
    source = df.select(*by, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    if not by:
        source = source.withColumn("_all", F.lit(True))
    if store:
        source = scratch.put(source, "values")
    keyed = source.withColumn("_k", order_key(F.col("_v"), source.schema["_v"].dataType))
    double = isinstance(keyed.schema["_k"].dataType, T.DoubleType)

    cells = _counted(keyed.withColumn("_bin", first_bin(F.col("_k"), double)), [*keys, "_bin"])
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), rank_index(F.col("_total"), p, rule).alias("_rank")) for i, p in enumerate(percents.values())]))
    whole = Window.partitionBy(*keys)  # of a group's bins, not of its rows
    ranked = cells.withColumn("_total", F.sum("_n").over(whole)).select(*keys, "_bin", "_n", "_lo", "_hi", "_x", wanted.alias("_w"))
    ranges = scratch.put(_reached(ranked.select("*", "_w.*").drop("_w"), keys), "ranges")
    found = ranges.filter("_lo = _hi")
    while not (open_ranges := ranges.filter("_lo < _hi")).isEmpty():
        ranges = scratch.put(_reached(_inside(keyed, open_ranges, keys), keys), "ranges")
        found = found.unionByName(ranges.filter("_lo = _hi"))

    picked = found.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_i") == i, F.col("_x"))).alias(name) for i, name in enumerate(percents)],
        F.count("*").alias("_found"))
    checked = picked.filter(F.when(F.col("_found") == len(percents), True).otherwise(
        F.raise_error("a rank lies in no range: the values changed between passes").cast("boolean"))).drop("_found")
    if extras:
        checked = null_safe_join(source.groupBy(*keys).agg(*[c.alias(n) for n, c in extras.items()]), checked, keys)
    out = materialize(checked if by else checked.drop("_all"), "percentiles")
    scratch.close()
    return out


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"), F.min("_v").alias("_x"))


def _reached(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of the bins of each group and wanted rank, in order, the one that holds the rank; and the rank within it."""
    up_to = Window.partitionBy(*keys, "_i").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("_n").over(up_to) - F.col("_n")
    return cells.withColumn("_start", start).filter(
        (F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_start") + F.col("_n"))).select(
        *keys, "_i", (F.col("_rank") - F.col("_start")).alias("_rank"), "_lo", "_hi", "_x")


def _inside(keyed: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The ranges split in ``BINS`` and counted over all rows inside."""
    double = isinstance(keyed.schema["_k"].dataType, T.DoubleType)
    salted = ranges.select(*keys, "_i", "_rank", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = keyed.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    here = null_safe_join(dealt, salted, [*keys, "_salt"]).filter(F.col("_k").between(F.col("_lo"), F.col("_hi")))
    # One rank per group and number, so grouping by it changes nothing and carries it along.
    return _counted(here.select(*keys, "_i", "_rank", "_k", "_v", next_bin(double).alias("_bin")), [*keys, "_i", "_rank", "_bin"])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null group keys meet each other."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])
