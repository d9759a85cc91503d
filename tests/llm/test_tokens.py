"""Byte-level BPE against tiktoken, token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import byte_bpe, queries, token_files
from tidelog.session import scratch_path

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ROWS = [(1, "Hello, the world's  end\n\n x1234"), (2, None), (3, ""), (3, ""), (4, "ab" * 900),
        (5, "naïve Straße ÑANDÚ é ΑΣ <|endoftext|> 漢字 x \U0001f600"), (6, " \t\n "), (7, "word. word, 'tis a.b.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, ids string")


def test_encode_equals_library_and_decodes(docs):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    ids = byte_bpe.encode(F.col("text"), RANKS, P.PATTERN)
    for row in docs.select("text", ids.alias("got"), byte_bpe.decode(ids, RANKS).alias("back")).collect():
        assert list(row["got"]) == library.encode_ordinary(row["text"] or "")
        assert bytes(row["back"]).decode() == (row["text"] or "")


@pytest.mark.parametrize("run, whole", [(4 << 20, 1 << 20), (1, 1), (40, 5)])
def test_round_trip_in_runs_of_any_size(docs, run, whole, monkeypatch):
    """Ids and bytes do not depend on where a batch is cut; clashing columns are left alone."""
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    monkeypatch.setattr(byte_bpe, "RUN", run)
    monkeypatch.setattr(byte_bpe, "WHOLE", whole)
    known, compiled, pieces = byte_bpe._words_of(RANKS), regex.compile(P.PATTERN), byte_bpe._pieces_of(RANKS)
    texts = pa.array([t for _, t in ROWS], pa.string())
    ids, back = [], []
    for _, some in byte_bpe._slices(texts):
        values, offsets = byte_bpe._ids(some.to_pylist(), known, compiled)
        ids += [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        back += byte_bpe._bytes_of(values, offsets, pieces).to_pylist()
    assert ids == [library.encode_ordinary(t or "") for _, t in ROWS]
    assert back == [(t or "").encode() for _, t in ROWS]
    rows = byte_bpe.round_trip(docs.withColumn("packed", F.lit(1)), RANKS, P.PATTERN).collect()
    assert sorted((r["doc_id"], bytes(r["packed"]), bytes(r["decoded"])) for r in rows) == sorted(
        (i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in ROWS)


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 1000)
    known = byte_bpe._Words(RANKS)
    packed = {w: known[w] for w in ("alpha", "beta", "gamma", "delta", "epsilon", "z" * 5000)}
    assert 0 < len(known) < 5 and "z" * 5000 not in known
    assert all(known[w] == p for w, p in packed.items())


def test_decode_and_pack_leave_out_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [5, None, 7]), (4, [9])], "k int, a array<int>")
    got = rows.select("k", byte_bpe.pack(F.col("a")).alias("p"), byte_bpe.decode(F.col("a"), RANKS).alias("d")).collect()
    piece = byte_bpe._pieces_of(RANKS).to_pylist()
    want = {1: [], 2: [], 3: [5, 7], 4: [9]}
    for row in got:
        ids = want[row["k"]]
        assert bytes(row["p"]) == np.array(ids, "<u4").tobytes() and bytes(row["d"]) == b"".join(piece[i] for i in ids)


def test_merges_of_long_words():
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    draw = random.Random(3)
    for n in (1, 2, 399, 400, 401, 2500):
        for letters in ("ab", "thereandis", "abcdefghijklmnopqrstuvwxyzäöü"):
            word = "".join(draw.choice(letters) for _ in range(n))
            assert byte_bpe.merge(word.encode(), byte_bpe.read_ranks(RANKS)) == library.encode_ordinary(word)


def test_token_files_round_trip(spark, docs):
    folder = scratch_path(spark, "tokens")
    token_files.write(docs, folder, WORDS, end_id=1)
    got = token_files.digest(token_files.read_ids(spark, folder)).orderBy("start", "n_tokens").collect()
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    start = 0
    for row, (doc, text) in zip(got, ROWS):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert tuple(row) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = token_files.read_ids(spark, folder, wanted=[5]).collect()
    assert [r["doc_id"] for r in one] == [5]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert none.select(byte_bpe.encode(F.col("text"), RANKS, P.PATTERN)).count() == 0
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    folder = scratch_path(spark, "tokens")
    token_files.write(none, folder, WORDS, end_id=1)
    assert token_files.read_ids(spark, folder).count() == 0


ADDED = ["a <|endoftext|> b", "a<|endoftext|>b. <|ENDOFTEXT|> x<|startoftext|>,", "\u0130stanbul x\u0130y \u0130", "\u0130. x\u0130, \u0130.a",
         "na\u00efve, Stra\u00dfe. \u0391\u03a3. \u6f22,"]


def test_token_files_of_added_tokens(spark, tmp_path):
    """The query's ids are those of the library at its defaults."""
    spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_token_files(spark, str(tmp_path)).orderBy("doc_id").collect()
    library = Tokenizer.from_file(WORDS)
    for row, text in zip(rows, ADDED, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        assert (row["n_tokens"], row["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
