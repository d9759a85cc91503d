"""Nearest neighbours by cosine with a vantage-point tree per shard.

Vectors are scaled to length one, where cosine orders like distance, and dealt to shards. Each shard's task builds a
tree: a vantage point splits its rows at the median distance into a near and a far half, down to small leaves. A
search goes to the half a query lies in and visits the other one only if the query's distance to the border is within
``factor`` times the distance of its k-th best so far. Factor one is the triangle inequality and gives exact results;
smaller factors prune more and may miss some. Queries are searched block by block: a block is at most ``BLOCK``
vectors, sent to all shards, which search it together; the best k of each shard are merged per query.

Equal vectors and exact multiples of one vector are one point of a tree with the lowest ids it needs, so a large group
of copies is no deep branch. Scores are taken from whole numbers: cosines that are equal give the same double whatever
the lengths and shards, and all points within a margin of the k-th place are compared in this way, however many.

Vectors that are null, zero, or hold null or non-finite parts take no part, nor do rows without an id; vectors of
different length are never neighbours. Rows equal in id and vector count once. Ties go to the smaller id. Empty tables
give empty results; further columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, pick

K = 5
FACTOR = 1.0
# Rows of a shard, queries of a block, points of a leaf.
SHARD_ROWS = 20_000
BLOCK = 20_000
LEAF = 64
# Scores this close may change places by rounding; they are all kept until the exact comparison.
_SLACK = 1e-9
# Rows of a query beyond which they are compared exactly at once; new rows of all queries before old ones are looked over.
MANY = 64
FRESH = 1 << 20


def usable(vector: Column) -> Column:
    """Not null, not zero, all parts finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Tree:
    """Points in a vantage-point tree; ``unit`` has a row of length one for each point."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF):
        self.unit, self.leaf = unit, leaf
        self.draw = np.random.default_rng(11)
        self.root = self._build(np.arange(len(unit)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        at = rows[self.draw.integers(len(rows))]
        far = _distance(self.unit[rows] @ self.unit[at])
        border = float(np.median(far))
        inside = far <= border
        if inside.all():  # all at one distance: nothing to split
            return rows
        return at, border, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, queries: np.ndarray, k: int, factor: float, cut=None) -> "_Best":
        """Rows met for each query, a superset of its k best among the visited ones; ``cut`` as in ``_Best``."""
        found = _Best(len(queries), k, cut)
        self._visit(self.root, np.arange(len(queries)), queries, factor, found)
        found.compact()
        return found

    def _visit(self, node, active: np.ndarray, queries: np.ndarray, factor: float, found: "_Best") -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            found.offer(active, node, queries[active] @ self.unit[node].T)
            return
        at, border, near, far = node
        gap = _distance(queries[active] @ self.unit[at]) - border
        inner, outer = active[gap <= 0], active[gap > 0]
        self._visit(near, inner, queries, factor, found)
        self._visit(far, outer, queries, factor, found)
        # The other half only where the border is not farther than the k-th best, relaxed.
        reach = factor * _distance(found.kth[active] - _SLACK) + 1e-7
        self._visit(far, active[(gap <= 0) & (-gap <= reach)], queries, factor, found)
        self._visit(near, active[(gap > 0) & (gap <= reach)], queries, factor, found)


def _distance(cosine: np.ndarray) -> np.ndarray:
    """Distance of unit vectors with this cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class _Best:
    """The best rows of each query so far, and all others that come within the margin of the k-th.

    Where a query holds more than ``MANY`` rows, ``cut`` (query, rows) gives its k best by the exact comparison.
    """

    def __init__(self, n: int, k: int, cut=None):
        self.k, self.cut = k, cut
        self.top = np.full((n, k), -2.0)
        self.kth = np.full(n, -2.0)
        self.query, self.row, self.score = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))
        self.fresh, self.n_fresh = [], 0

    def offer(self, active: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        both = np.concatenate([self.top[active], scores], axis=1)
        self.top[active] = -np.partition(-both, self.k - 1, axis=1)[:, :self.k]
        self.kth[active] = self.top[active].min(axis=1)
        q, r = np.nonzero(scores >= (self.kth[active] - _SLACK)[:, None])
        self.fresh.append((active[q], rows[r], scores[q, r]))
        self.n_fresh += len(q)
        if self.n_fresh > max(FRESH, len(self.query)):
            self.compact()

    def compact(self) -> None:
        """Leave out what the k-th places have passed since, and cut long lists."""
        q, r, s = (np.concatenate([old, *new]) for old, new in zip(
            (self.query, self.row, self.score), zip(*self.fresh) if self.fresh else ((), (), ())))
        near = np.flatnonzero(s >= self.kth[q] - _SLACK)
        near = near[np.argsort(q[near], kind="stable")]
        q, r, s = q[near], r[near], s[near]
        many = np.flatnonzero(np.bincount(q, minlength=len(self.kth)) > max(MANY, self.k)) if self.cut else ()
        if len(many):
            keep = np.ones(len(q), dtype=bool)
            for i in many:
                a, b = np.searchsorted(q, [i, i + 1])
                keep[a:b] = np.isin(r[a:b], self.cut(i, r[a:b]))
            q, r, s = q[keep], r[keep], s[keep]
        self.query, self.row, self.score, self.fresh, self.n_fresh = q, r, s, [], 0

    def rows_of(self, query: int) -> np.ndarray:
        """After ``compact``."""
        a, b = np.searchsorted(self.query, [query, query + 1])
        return self.row[a:b]


def _whole(vectors: np.ndarray) -> list[list[int]]:
    """Each vector as its shortest multiple of whole numbers, the same for all positive multiples of a vector."""
    part, power = np.frexp(vectors)
    odd = (part * 2.0 ** 53).astype(np.int64)
    low = np.where(odd != 0, odd & -odd, 1)
    odd, power = odd // low, np.where(odd != 0, power + np.log2(low).astype(np.int64), 1 << 20)
    shift = np.where(odd != 0, power - power.min(axis=1)[:, None], 0)
    fits = ((np.log2(np.maximum(np.abs(odd), 1)) + shift).max(axis=1) < 61)
    small = np.where(fits[:, None], odd << np.where(fits[:, None], shift, 0), 1)
    small //= np.gcd.reduce(small, axis=1)[:, None]
    out = small.tolist()
    for i in np.flatnonzero(~fits):
        whole = [int(x) << int(n) for x, n in zip(odd[i], shift[i])]
        common = math.gcd(*whole)
        out[i] = [x // common for x in whole]
    return out


def _dot(a: list[int], b: list[int]) -> int:
    return sum(map(mul, a, b))


class _Exact:
    """Points by direction, with their ids, and their cosines: equal ones as the same double."""

    def __init__(self, points: np.ndarray, members: list, most: int):
        whole, place = _whole(points), {}
        for i, w in enumerate(whole):
            place.setdefault(tuple(w), []).append(i)
        self.first = np.array([rows[0] for rows in place.values()], dtype=np.int64)
        self.members = [sorted(m for i in rows for m in members[i])[:most] for rows in place.values()]
        self.whole, self.square = [whole[i] for i in self.first], {}

    def score(self, asked: list[int], square: int, point: int) -> float:
        """Cosine by a quotient of whole numbers, which Python rounds correctly."""
        p = self.whole[point]
        if point not in self.square:
            self.square[point] = _dot(p, p)
        dot = _dot(p, asked)
        return math.copysign(math.sqrt(dot * dot / (self.square[point] * square)), dot)

    def best(self, asked: list[int], square: int, points: np.ndarray, k: int) -> list[int]:
        """The k best by score, then by lowest id."""
        return sorted(points.tolist(), key=lambda p: (-self.score(asked, square, p), self.members[p][0]))[:k]


def _shard(pdf, queries: list[tuple], k: int, factor: float):
    """(query_id, vec_id, score) of the k best of one shard for every query; classes of equal vectors are points."""
    out = []
    for dim in sorted({len(v) for v in pdf["vector"]}):
        part = pdf[[len(v) == dim for v in pdf["vector"]]]
        asked = [(q, v) for q, v in queries if len(v) == dim]
        if not asked:
            continue
        points = np.stack(part["vector"].to_list()).astype(np.float64)
        ids = [int(q) for q, _ in asked]
        wanted = np.array([v for _, v in asked], dtype=np.float64)
        # So many more than k as rows of a query's own id may be among them.
        times = Counter(int(m) for ms in part["members"] for m in ms)
        most = k + max(times[q] for q in ids)
        exact = _Exact(points, [[int(m) for m in ms] for ms in part["members"]], most)
        points = points[exact.first]
        whole = _whole(wanted)
        squares = [_dot(w, w) for w in whole]
        unit, own = (v / np.sqrt((v * v).sum(axis=1))[:, None] for v in (points, wanted))
        found = Tree(unit).search(own, most, factor, lambda i, rows: exact.best(whole[i], squares[i], rows, most))
        for i, q in enumerate(ids):
            scores = [(-exact.score(whole[i], squares[i], p), p) for p in found.rows_of(i).tolist()]
            best = sorted((s, m) for s, p in scores for m in exact.members[p] if m != q)[:k]
            out += [(q, m, -s) for s, m in best]
    return out


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
           factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query``, its k nearest other rows."""
    rows = pick(vectors.withColumn("__q", is_query), id_col, vector_col, "__q").toDF("id", "vector", "q")
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn(
        "vector", F.col("vector").cast("array<double>"))
    rows = materialize(rows, "ann-rows")
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    # Equal vectors are one point with the ids that can be among the k best of anyone, itself left out.
    points = rows.select("vector", "id").distinct().groupBy("vector").agg(
        F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("members"))
    shards = max(1, -(-n // shard_rows))
    points = materialize(points.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards))), "ann-points")
    best = None
    blocks = max(1, -(-2 * n_queries // block))
    for number in range(blocks):
        asked = rows.filter("q").filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).select("id", "vector")
        queries = [(r["id"], r["vector"]) for r in asked.distinct().collect()]
        sent = rows.sparkSession.sparkContext.broadcast(queries)

        def one_shard(table: pa.Table) -> pa.Table:
            found = _shard(table.select(["vector", "members"]).to_pandas(), sent.value, k, factor)
            return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()),
                             "vec_id": pa.array([f[1] for f in found], pa.int64()),
                             "score": pa.array([f[2] for f in found], pa.float64())})

        part = points.groupBy("shard").applyInArrow(one_shard, "query_id bigint, vec_id bigint, score double")
        part = materialize(part, "ann-found")
        best = part if best is None else best.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
