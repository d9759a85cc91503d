"""Byte-level BPE encoding and decoding.

A word is a match of the tokenizer's pattern. Merges are folded over the bytes of each distinct word: at each step the
adjacent pair with the lowest rank, leftmost first, becomes one piece, until no pair has a rank. A word that is a token
itself needs no merge. Each worker keeps the ids of the words it has met, up to ``CACHE_BYTES``, so that a word is
folded once and looked up from then on. Decoding looks up the bytes of each id and concatenates the pieces. Both are
column functions over Arrow batches, and ``round_trip`` does both in one pass: no shuffle, and no state beyond the cache.

Null texts count as empty and give no ids; null id arrays decode to no bytes, and null ids in an array are left out.
Repeated rows are encoded alike, an empty table stays empty, further columns are left alone. Texts and words may be of any length: words over ``LONG`` bytes are
merged with a heap, in n log n.
"""

from __future__ import annotations

import base64
import heapq
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes that a Python worker's cache of words may take, and about what an entry takes beside word and ids.
CACHE_BYTES = 128 << 20
_ENTRY = 200
# Bytes of text that are worked on at once; more only where one text is longer.
RUN = 4 << 20
# Texts of up to this many characters are split into a list of words, longer ones word by word.
WHOLE = 1 << 20
LONG = 400
_NONE = 1 << 30


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    pieces = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i:i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == _NONE:
            break
        at = pairs.index(best)
        pieces[at:at + 2] = [pieces[at] + pieces[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(pieces[at - 1] + pieces[at], _NONE)
        if at < len(pairs):
            pairs[at] = ranks.get(pieces[at] + pieces[at + 1], _NONE)
    return [ranks[p] for p in pieces]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs; a piece is known by the place of its first byte."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at a place
    heap: list[tuple[int, int, int]] = []

    def push(a: int) -> None:
        if a >= 0 and end[a] < n and (rank := ranks.get(word[a:end[end[a]]])) is not None:
            heapq.heappush(heap, (rank, a, end[end[a]]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, a, stop = heapq.heappop(heap)
        if end[a] < 0 or end[a] >= n or end[end[a]] != stop or end[a] == stop:
            continue  # one of the two has been merged meanwhile
        gone = end[a]
        end[gone], end[a] = -1, stop
        if stop < n:
            before[stop] = a
        push(a)
        push(before[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a:end[a]]])
        a = end[a]
    return out


class _Words(dict):
    """Packed ids by word, filled as words come."""

    def __init__(self, path: str):
        super().__init__()
        self.ranks, self.room = read_ranks(path), CACHE_BYTES

    def __missing__(self, word: str) -> bytes:
        ids = merge(word.encode(), self.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        size = _ENTRY + 4 * len(word) + len(packed)
        if size <= min(self.room, LONG * 8):
            self.room -= size
            self[word] = packed
        return packed


@lru_cache(maxsize=4)
def _words_of(path: str) -> _Words:
    return _Words(path)


@lru_cache(maxsize=4)
def _pieces_of(path: str) -> pa.Array:
    ranks = read_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.binary())


def _offsets(lengths) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths, dtype=np.int64)])


def _ids(texts: list, known: _Words, pattern) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the offsets of each text in it."""
    packed = []
    for text in texts:
        if not text:
            packed.append(b"")
        elif len(text) <= WHOLE:
            packed.append(b"".join([known[w] for w in pattern.findall(text)]))
        else:
            packed.append(b"".join(known[m.group()] for m in pattern.finditer(text)))
    return np.frombuffer(b"".join(packed), dtype="<u4"), _offsets([len(p) // 4 for p in packed])


def _binary(values: bytes | pa.Buffer, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def _bytes_of(ids: np.ndarray, offsets: np.ndarray, pieces: pa.Array) -> pa.Array:
    """The pieces of each text's ids, concatenated."""
    taken = pieces.take(pa.array(ids.astype(np.int64)))
    places = _offsets(pc.binary_length(taken).to_numpy())
    values = taken.buffers()[2]
    return _binary(values if values is not None else b"", places[offsets])


def _flat(arrays: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all arrays in one, without nulls, and the offsets of each array in it."""
    offsets, values = _offsets(pc.fill_null(pc.list_value_length(arrays), 0).to_numpy()), arrays.flatten()
    if values.null_count:
        offsets = _offsets(values.is_valid().to_numpy(zero_copy_only=False))[offsets]
    return values.drop_null().to_numpy(), offsets


def _slices(texts: pa.Array):
    """(start, texts) of runs of rows with about ``RUN`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    runs = np.cumsum(sizes, dtype=np.int64) // RUN
    starts = np.flatnonzero(np.diff(runs, prepend=-1))
    for start, end in zip(starts, np.append(starts[1:], len(sizes))):
        yield int(start), texts.slice(start, end - start)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Array of token ids of a text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        known, compiled = _words_of(path), regex.compile(pattern)
        parts = [pa.array([], pa.list_(pa.int32()))]
        for _, some in _slices(texts):
            values, offsets = _ids(some.to_pylist(), known, compiled)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int32))))
        return pa.concat_arrays(parts)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Bytes of an array of token ids."""

    @F.arrow_udf("binary")
    def texts(arrays: pa.Array) -> pa.Array:
        return _bytes_of(*_flat(arrays), _pieces_of(path))

    return texts(ids)


def pack(ids: Column) -> Column:
    """The ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def packed(arrays: pa.Array) -> pa.Array:
        values, offsets = _flat(arrays)
        return _binary(values.astype("<u4").tobytes(), offsets * 4)

    return packed(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, packed, decoded): the ids of each text as ``pack`` gives them, and the bytes that they decode to.

    A text is encoded once, and its ids are decoded in the same pass. Rows go through in runs of about ``RUN`` bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def runs(parts):
        known, compiled, pieces = _words_of(path), regex.compile(pattern), _pieces_of(path)
        for part in parts:
            for start, some in _slices(part.column(1)):
                values, offsets = _ids(some.to_pylist(), known, compiled)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(start, len(some)), _binary(values.tobytes(), offsets * 4),
                     _bytes_of(values, offsets, pieces)], names=["id", "packed", "decoded"])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return slim.mapInArrow(runs, f"id {kind}, packed binary, decoded binary").withColumnRenamed("id", id_col)
