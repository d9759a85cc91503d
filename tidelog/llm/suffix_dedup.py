"""Exact removal of repeated byte strings with a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Not every suffix is sorted, only
those at anchors: each window of ``LENGTH`` bytes chooses the ``GRAM``-byte string with the least hash in it, leftmost
first, as its anchor, so equal windows have equal anchors at equal places, and about one suffix in ``LENGTH - GRAM``
over two is an anchor. An anchor whose string occurs once in the corpus belongs to no repeated window and is left out.

The other suffixes, cut where no window of the anchor reaches, are sorted in runs by the tasks that read the texts. A
run is front-coded: of each suffix only what follows its common prefix with the one before is kept. Runs are exchanged,
and combined by loser trees that compare two suffixes only from the length of the prefix they are known to share. In
the merged order suffixes with a common prefix of ``GRAM`` bytes are neighbours and form a group. Of each member of a
group the windows around its anchor that also stand around another one, at the same offset, are found by hashes of the
windows; together they are one stretch of bytes, which is removed.

Nulls and empty texts have no bytes. Rows equal in id and text are documents of their own and repeat each other. Texts
of any length are read whole, an empty table gives an empty result, further columns play no part. Suffixes that are
equal within a task, with equal bytes before, are sent once and known to be repeated.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, pick

LENGTH = 400
GRAM = 100
# Bytes before an anchor that its windows reach.
BEFORE = LENGTH - GRAM
# Suffixes that meet in one task, apart from those of one group.
PART = 40_000
# Anchors of one hash beyond which they are not joined in one task; there are few such hashes, and each task gets them all.
OFTEN = 40_000

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Grams:
    """Hashes of all ``GRAM``-byte strings of a text, and anchors; tables of powers grow as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def anchors(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors of a text."""
        n = len(raw)
        if n < LENGTH:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_BACK, 2 * n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[np.frombuffer(raw, dtype=np.uint8)] * self.up[:n], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * self.down[:n - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        # Least hash of each window, the place in the low bits: running minima of blocks from either side.
        width, bits = BEFORE + 1, np.uint64((1 << n.bit_length()) - 1)
        keyed = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
        pad = -len(keyed) % width
        blocks = np.concatenate([keyed, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:len(h) - width + 1], ahead[width - 1:len(h)])
        at = np.unique(least & bits).astype(np.int64)
        return at, h[at]


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, at least ``start`` of which is known."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    step = 32
    while a[start:start + step] == b[start:start + step]:
        start += step
    while a[start] == b[start]:
        start += 1
    return start


def front_code(suffixes: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A run of sorted (suffix, bytes before, key, place), each suffix without its common prefix with the last."""
    shared, tails, before = [], [], []
    last = b""
    for suffix, left, _, _ in suffixes:
        n = _common(last, suffix, 0)
        shared.append(n)
        tails.append(suffix[n:])
        before.append(left)
        last = suffix
    numbers = np.array([[n, len(t), len(b), k, p] for n, t, b, (_, _, k, p) in zip(shared, tails, before, suffixes)],
                       dtype=np.int64)
    body = numbers.T.tobytes() + b"".join(tails) + b"".join(before)
    return len(suffixes).to_bytes(8, "little") + zlib.compress(body, 1)


def _run(packed: bytes):
    """Yields (suffix, shared with the one before, bytes before, key, place) of a front-coded run."""
    n = int.from_bytes(packed[:8], "little")
    body = zlib.decompress(packed[8:])
    shared, tail, left, key, place = np.frombuffer(body, dtype=np.int64, count=5 * n).reshape(5, n).tolist()
    at, back = 40 * n, 40 * n + sum(tail)
    last = b""
    for i in range(n):
        last = last[:shared[i]] + body[at:at + tail[i]]
        yield last, shared[i], body[back:back + left[i]], key[i], place[i]
        at += tail[i]
        back += left[i]


class LoserTree:
    """Merges front-coded runs. Every waiting head knows how much it shares with the last suffix put out; of two heads
    the one that shares more comes first, and only heads that share the same are compared, from there on."""

    def __init__(self, runs: list[bytes]):
        self.runs = [_run(r) for r in runs]
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.head: list = [next(r, None) for r in self.runs] + [None] * (self.size - len(runs))
        self.share = [0] * self.size
        self.loser = [0] * self.size
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, self.loser[node] = self._match(a, b)
        return win

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's share becomes what it has in common with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.share[a] != self.share[b]:
            return (a, b) if self.share[a] > self.share[b] else (b, a)
        n = _common(x[0], y[0], self.share[a])
        first = x[0][n:n + 1] <= y[0][n:n + 1]
        win, lose = (a, b) if first else (b, a)
        self.share[lose] = n
        return win, lose

    def __iter__(self):
        while self.head[self.winner] is not None:
            w = self.winner
            suffix, _, left, key, place = self.head[w]
            yield suffix, self.share[w], left, key, place
            self.head[w] = following = next(self.runs[w], None)
            self.share[w] = following[1] if following else 0
            node = (w + self.size) // 2
            while node:
                w, self.loser[node] = self._match(w, self.loser[node])
                node //= 2
            self.winner = w


def _windows(suffixes: list[bytes], lefts: list[bytes]):
    """Yields (offset, numbers, hashes) of the windows that start so far before an anchor, ascending.

    Numbers are those of the anchors around which the window lies within the text. Sums roll along, so that of an
    anchor only its bytes are held.
    """
    n = len(suffixes)
    text = np.zeros((n, BEFORE + LENGTH), dtype=np.uint8)
    before, after = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, (suffix, left) in enumerate(zip(suffixes, lefts)):
        before[i], after[i] = len(left), len(suffix)
        text[i, BEFORE - len(left):BEFORE] = np.frombuffer(left, dtype=np.uint8)
        text[i, BEFORE:BEFORE + len(suffix)] = np.frombuffer(suffix, dtype=np.uint8)
    text = np.ascontiguousarray(text.T)
    up, down = _powers(_BASE, BEFORE + LENGTH), _powers(_BACK, BEFORE + LENGTH)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(BEFORE, BEFORE + LENGTH):
        total += _BYTE[text[i]] * up[i]
    for offset in range(BEFORE + 1):
        start = BEFORE - offset
        if offset:
            total += _BYTE[text[start]] * up[start]
            total -= _BYTE[text[start + LENGTH]] * up[start + LENGTH]
        which = np.flatnonzero((before >= offset) & (after >= LENGTH - offset))
        h = total[which] * down[start]
        yield offset, which, (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def _stretches(members: list[tuple[bytes, bytes, int, int]], groups: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, start, stop) covered by windows that another member of the group has at the same offset."""
    n = len(members)
    low, high = np.full(n, LENGTH), np.full(n, -1)
    for o, fits, h in _windows([m[0] for m in members], [m[1] for m in members]):
        if len(fits) < 2:
            continue
        h = h + groups[fits]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(fits), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = fits[again]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = np.maximum(high[hit], o)
    return [(members[i][2], members[i][3] - int(high[i]), members[i][3] - int(low[i]) + LENGTH)
            for i in np.flatnonzero(high >= 0)]


def _merged(runs: list[bytes], room: int = 20_000):
    """Stretches of all groups in the merged order of the runs, by batches of whole groups."""
    held: list = []
    marks: list = []
    group: list = []
    number = 0

    def close():
        nonlocal number
        if len(group) > 1:
            held.extend(group)
            marks.extend([number] * len(group))
            number += 1
        group.clear()

    for suffix, shared, left, key, place in LoserTree(runs):
        if shared < GRAM:
            close()
            if len(held) >= room:
                yield _stretches(held, _mixed(marks))
                held.clear()
                marks.clear()
        group.append((suffix, left, key, place))
    close()
    if held:
        yield _stretches(held, _mixed(marks))


def _mixed(marks: list[int]) -> np.ndarray:
    return np.array(marks, dtype=np.uint64) * np.uint64(_BASE)


def _rows(keys: list, starts: list, stops: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, stops)],
                                      names=["key", "start", "stop"])


def _again(rows: DataFrame, on: str) -> DataFrame:
    """Rows whose value of ``on`` occurs more than once; rows of a value that occurs often stay where they are."""
    counts = materialize(rows.groupBy(on).agg(F.count("*").alias("n")).filter("n > 1"), "dedup-counts")
    often = F.broadcast(counts.filter(F.col("n") > OFTEN).select(on))
    others = rows.join(often, on, "left_anti").join(counts.filter(F.col("n") <= OFTEN).select(on), on, "left_semi")
    return rows.join(often, on, "left_semi").unionByName(others)


def repeated(docs: DataFrame) -> DataFrame:
    """(key, start, stop): stretches of repeated bytes of documents (key, text)."""

    def anchors(parts):
        grams = _Grams()
        for part in parts:
            keys, places, hashes = [], [], []
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                at, h = grams.anchors((text or "").encode())
                keys.append(np.full(len(at), key, dtype=np.int64))
                places.append(at)
                hashes.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)) for x in (keys, places, hashes)],
                names=["key", "place", "h"])

    found = materialize(docs.mapInArrow(anchors, "key bigint, place bigint, h bigint"), "dedup-anchors")
    live = materialize(_again(found, "h").groupBy("key").agg(
        F.collect_set(F.struct("place", "h")).alias("anchors")), "dedup-live")
    total = live.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    n_parts = max(1, -(-total // PART))

    def runs(parts):
        for part in parts:
            by_part: dict[int, dict] = {}
            for key, text, anchors_ in zip(*(part.column(c).to_pylist() for c in ("key", "text", "anchors"))):
                raw = text.encode()
                for a in anchors_:
                    p = a["place"]
                    entry = (raw[p:p + LENGTH], raw[max(0, p - BEFORE):p])
                    by_part.setdefault(a["h"] % n_parts, {}).setdefault(entry, []).append((key, p))
            out_part, out_run, sure = [], [], ([], [], [])
            for number, entries in by_part.items():
                run = []
                for (suffix, left), owners in entries.items():
                    run.append((suffix, left, *owners[0]))
                    # Equal bytes around: all windows that fit are repeated, if any fits.
                    if len(owners) > 1 and len(left) + len(suffix) >= LENGTH:
                        for key, p in owners:
                            sure[0].append(key)
                            sure[1].append(p - len(left))
                            sure[2].append(p + len(suffix))
                run.sort()
                out_part.append(number)
                out_run.append(front_code(run))
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([*out_part, -1], pa.int64()), pa.array([*out_run, None], pa.binary()),
                 *[pa.array([*[None] * len(out_part), x], kinds) for x in sure]],
                names=["part", "run", "keys", "starts", "stops"])

    kind = "part bigint, run binary, keys array<bigint>, starts array<bigint>, stops array<bigint>"
    sent = materialize(docs.join(live, "key").mapInArrow(runs, kind), "dedup-runs")

    def combine(table: pa.Table) -> pa.Table:
        out = [s for batch in _merged(table.column("run").to_pylist()) for s in batch]
        return pa.Table.from_batches([_rows(*map(list, zip(*out))) if out else _rows([], [], [])])

    met = sent.filter("part >= 0").select("part", "run").groupBy("part").applyInArrow(
        combine, "key bigint, start bigint, stop bigint")
    sure = sent.filter("part < 0").select(F.explode(F.arrays_zip("keys", "starts", "stops")).alias("s")).select(
        F.col("s.keys").alias("key"), F.col("s.starts").alias("start"), F.col("s.stops").alias("stop"))
    return met.unionByName(sure)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) of each row."""
    docs = pick(docs, id_col, text_col).toDF("id", "text")
    docs = docs.withColumn("key", F.xxhash64("id", F.coalesce("text", F.lit(""))))
    spans = repeated(docs.select("key", "text")).groupBy("key").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"))
    kind = docs.schema["id"].dataType.simpleString()

    def cut(parts):
        for part in parts:
            rows = []
            for text, spans_ in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                raw = (text or "").encode()
                kept, at, n = [], 0, 0
                for s in sorted(spans_ or [], key=lambda s: (s["start"], s["stop"])):
                    if s["start"] > at or not n:
                        kept.append(raw[at:s["start"]])
                        n += 1
                    at = max(at, s["stop"])
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((len(raw), len(raw) - len(left), n, left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.join(spans, "key", "left").select("id", "text", "spans").mapInArrow(
        cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id_col)
