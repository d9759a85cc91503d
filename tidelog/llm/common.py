"""What the operators of this subpackage share: words, bindings in expressions, scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.session import Scratch, materialize

__all__ = ["BLANKS", "BLANK_RUN", "Scratch", "let", "lower_ascii", "materialize", "parted", "pick", "ranked", "read", "running",
           "words"]

# The six ASCII blanks that separate words; Python's bytes.split() cuts at the same ones.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda uses it for each element."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words(text: Column) -> Column:
    """Array of maximal runs of characters other than blanks; empty for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input cannot clash with new ones."""
    return df.select(*[df[n] for n in names])


def parted(scratch: Scratch, df: DataFrame, key: str, order: list[Column], name: str = "parted") -> DataFrame:
    """``df``, stored, with _part, a range of the order within keys, and _tie, which tells equal rows apart.

    The ranges spread a hot key, and even equal rows, over many tasks. ``key`` has no nulls.
    """
    return scratch.put(
        df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(F.col(key), *order, F.col("_tie"))
        .withColumn("_part", F.spark_partition_id()), name)


def ranked(parts: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``parted`` rows with _rank, the row's number (from 1) within its key.

    Rows are numbered within key and range, from what the ranges before hold, so that no task orders a whole hot key.
    """
    numbered = running(parts.withColumn("_one", F.lit(1).cast("long")), key, [*order, F.col("_tie")], {"_rank": "_one"})
    return numbered.drop("_one", "_total")


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums (new column -> summed column) within the key in ascending _part, then ``order``; also _total, rows of the key."""
    per_part = df.groupBy(key, "_part").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select(
        key, "_part", F.sum("_n").over(Window.partitionBy(key)).alias("_total"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums])
    within = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(bases, [key, "_part"]).withColumns(
        {n: F.col(f"_base_{n}") + F.sum(c).over(within) for n, c in sums.items()}).drop(*[f"_base_{n}" for n in sums])
