"""Pages of any column's order: by a rank index, or onward from a page token.

Order: the column, then ``tie``, both ascending (nulls first) or both descending (nulls last).
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.filters import PARTITION, first_rows, order
from tidelog.session import delete, scratch_path

# monotonically_increasing_id holds the number of the task above these bits and the row within it below.
_ROW_BITS = 33


def _after(column: str, value: Any, ascending: bool) -> Column:
    """Rows whose column comes after ``value`` in this order."""
    c = F.col(column)
    if ascending:
        return c.isNotNull() if value is None else c > value
    return F.lit(False) if value is None else (c < value) | c.isNull()


def _same(column: str, value: Any) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == value


def from_key(keys: Mapping[str, Any], ascending: bool, inclusive: bool) -> Column:
    """Rows that come after the key (column -> value, in order of weight), or at it if ``inclusive``.

    Before it: the same with ``ascending`` reversed.
    """
    out = F.lit(inclusive)
    for column, value in reversed(keys.items()):
        out = _after(column, value, ascending) | (_same(column, value) & out)
    return out


def _between(df: DataFrame, low: Mapping[str, Any], high: Mapping[str, Any] | None, ascending: bool, inclusive: bool = True) -> DataFrame:
    """Rows from ``low`` to ``high`` in the given order; repeated on the day where the table is stored by day."""
    out = df.filter(from_key(low, ascending, inclusive))
    if high is not None:
        out = out.filter(from_key(high, not ascending, True))
    if PARTITION in df.columns and "event_time" in low:
        # Rows without a time have no day: they lie within unless both ends have times, or the first has and none precede it.
        first, last = low["event_time"], (high or {}).get("event_time")
        early, late = (first, last) if ascending else (last, first)
        if first is not None and last is not None:
            out = out.filter(F.col(PARTITION).between(F.to_date(early), F.to_date(late)))
        elif first is not None and ascending:
            out = out.filter(F.col(PARTITION) >= F.to_date(first))
    return out


class RankIndex:
    """The keys of a table in order, stored in ranges, with the number of rows of each range.

    A rank is found by the counts, one row per range, and one row of the index; rows of the table are fetched between the
    first and the last key of a page. So no task keeps more than a page of rows, however deep the page. The index is a
    snapshot of its table.
    """

    def __init__(self, spark: SparkSession, path: str, column: str, ascending: bool, tie: str, counts: list[tuple[int, int]]):
        self.spark, self.path, self.column, self.ascending, self.tie = spark, path, column, ascending, tie
        self.starts, total = [], 0
        for part, rows in counts:
            self.starts.append((total, part))
            total += rows
        self.total = total

    @classmethod
    def build(cls, df: DataFrame, column: str | None = None, ascending: bool = False, tie: str = "event_id",
              path: str | None = None, tasks: int | None = None) -> RankIndex:
        column = column or "event_time"
        names = list(dict.fromkeys([column, tie]))
        keys = [F.col(c).asc() if ascending else F.col(c).desc() for c in names]
        narrow = df.select(*names)
        ranged = narrow.repartitionByRange(tasks, *keys) if tasks else narrow.repartitionByRange(*keys)
        path = path or scratch_path(df.sparkSession, "rank-index")
        ranged.sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
        part = F.shiftright("_row", _ROW_BITS)
        counts = df.sparkSession.read.parquet(path).groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part")
        return cls(df.sparkSession, path, column, ascending, tie, [tuple(r) for r in counts.collect()])

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def key_at(self, rank: int) -> dict[str, Any]:
        """Column and tie, as literals, of the row with this rank (from 0)."""
        start, part = max(s for s in self.starts if s[0] <= rank)
        names = list(dict.fromkeys([self.column, self.tie]))
        rows = self._rows()
        found = rows.filter(F.col("_row") == (part << _ROW_BITS) + rank - start).select(
            *[F.col(n).cast("string").alias(n) for n in names]).first()
        # As text and back, so that times are not read in the driver's zone.
        return {n: None if found[n] is None else F.lit(found[n]).cast(rows.schema[n].dataType) for n in names}

    def _rank_of(self, key: Mapping[str, Any]) -> int:
        """Rank of the first row with this key."""
        same = F.lit(True)
        for name, value in key.items():
            same = same & _same(name, value)
        row = self._rows().filter(same).agg(F.min("_row")).first()[0]
        return dict((p, s) for s, p in self.starts)[row >> _ROW_BITS] + (row & ((1 << _ROW_BITS) - 1))

    def page(self, df: DataFrame, offset: int, limit: int | None) -> DataFrame:
        """Rows ``offset`` .. ``offset + limit`` of ``df``, the table that was indexed, in order."""
        if offset < 0 or limit is not None and limit < 0:
            raise ValueError(f"offset and limit must not be negative: {offset}, {limit}")
        if offset >= self.total or limit == 0:
            return order(df.filter(F.lit(False)), self.column, self.ascending, self.tie)
        low = self.key_at(offset)
        high = None if limit is None or offset + limit >= self.total else self.key_at(offset + limit - 1)
        rows = order(_between(df, low, high, self.ascending), self.column, self.ascending, self.tie)
        # Equal keys before the page's first row.
        skipped = offset - self._rank_of(low)
        return first_rows(rows.offset(skipped) if skipped else rows, limit)

    def drop(self) -> None:
        delete(self.spark, self.path)


def with_tokens(df: DataFrame, column: str | None = None, tie: str = "event_id") -> DataFrame:
    """Rows with ``page_token``: the place of each, to go on from with ``page_after``."""
    column = column or "event_time"
    return df.withColumn("page_token", F.to_json(F.struct(
        F.col(column).cast("string").alias("c"), F.col(tie).cast("string").alias("t"))))


def page_after(df: DataFrame, token: str | None, limit: int | None = 100, column: str | None = None,
               ascending: bool = False, tie: str = "event_id") -> DataFrame:
    """The ``limit`` rows that come after the token's row, the first ones without a token; each with its own token.

    A top-k of ``limit`` rows behind a filter that reaches the scan, at any depth. Rows added meanwhile do not shift pages.
    """
    column = column or "event_time"
    if token:
        place = json.loads(token)
        if not isinstance(place, dict) or not set(place) <= {"c", "t"}:
            raise ValueError(f"not a page token: {token}")
        key = {n: None if place.get(k) is None else F.lit(place[k]).cast(df.schema[n].dataType)
               for n, k in ((column, "c"), (tie, "t"))}
        df = _between(df, key, None, ascending, inclusive=False)
    return with_tokens(first_rows(order(df, column, ascending, tie), limit), column, tie)
