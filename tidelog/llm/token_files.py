"""Token ids in compressed blocks with one shared zstandard dictionary.

Documents are put in order of id by a range partition, encoded, and stored in blocks: rows of a Parquet table, so that
the files live wherever Spark can write. A block holds at most ``BLOCK_DOCS`` documents or about ``BLOCK_BYTES`` bytes
(a longer document stands alone). Its payload is the documents' compressed frames, one after another; ``offsets`` says
where each starts, so one short document is read by decompressing its own frame only. Ids are serialized as
little-endian 16-bit numbers where the vocabulary allows, else 32-bit. Every block carries the hash of the dictionary
its frames need; the dictionary is trained once, on the ids of at most ``SAMPLE`` documents (those with the lowest
hash of their id), and stored in a table beside the blocks. The sample only affects how well things compress.

The number of ids before a document is the sum over the partitions before its own (one row per partition), over the
blocks before its own in that partition, and over the documents before it in the block.

With ``added`` the strings of the tokenizer's added tokens get those tokens' ids, as in the library's default; without it
they are ordinary text.

Nulls: a null text is an empty document, a null id sorts first. Rows equal in id are ordered by a hash of their text.
Texts of any length are encoded whole. An empty table gives an empty table of blocks. Further columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import pick

BLOCK_DOCS = 1024
BLOCK_BYTES = 4 << 20
# Documents of the training sample, and bytes of the dictionary.
SAMPLE = 1500
DICTIONARY_BYTES = 64 << 10
# Words whose ids a Python worker keeps.
CACHE = 1_000_000

BLOCKS = ("part int, block int, dict_hash string, width int, doc_ids array<bigint>, n_tokens array<bigint>, "
          "offsets array<bigint>, payload binary")


class _Words(dict):
    """Packed ids by word. White space only separates in these tokenizers, so words are encoded on their own."""

    def __init__(self, path: str, added: bool = False):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.merge = self.tokenizer.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # The model's spelling of letters up to U+024F whose lower case is one letter; that of U+0130 is an i and a mark.
        self.spelling = {ord(c): level.pre_tokenize_str(c.lower())[0][0]
                         for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if len(text) > 1 and text[-1] in ".," and text[-2].isalpha() and text[-2] != "\u0130":
            packed = self[word[:-1]] + self[word[-1:]]  # letters and punctuation are never one piece
        else:
            # One piece: what the library does after splitting.
            if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
                ids = [t.id for t in self.merge(text.translate(self.spelling))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            packed = np.asarray(ids, dtype="<u4").tobytes()
        if len(self) < CACHE:
            self[word] = packed
        return packed


@lru_cache(maxsize=2)
def _words_of(path: str, added: bool) -> _Words:
    return _Words(path, added)


def _ids(text: str | None, known: _Words, end_id: int) -> np.ndarray:
    packed = b"".join([known[w] for w in (text or "").encode().split()])
    return np.append(np.frombuffer(packed, dtype="<u4"), np.uint32(end_id))


def _train(docs: DataFrame, path: str, end_id: int, width: int, added: bool) -> bytes:
    """A dictionary from the ids of a bounded sample; empty if there is too little to train on."""
    chosen = [r[0] for r in docs.select("id").filter("id is not null").orderBy(F.xxhash64("id"), "id")
              .limit(SAMPLE).collect()]
    known = _words_of(path, added)
    rows = docs.filter(F.col("id").isin(chosen)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toLocalIterator()
    samples = [_ids(r["text"], known, end_id).astype(f"<u{width}").tobytes() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, threads=1).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, folder: str, path: str, end_id: int, width: int = 2, id_col: str = "doc_id",
          text_col: str = "text", added: bool = False) -> None:
    """Tokenize ``docs`` by the tokenizer file ``path`` and write ``folder``/dictionary and ``folder``/blocks.

    ``width`` is the bytes of an id: 2 for vocabularies up to 65536 ids, else 4. ``added``: find the added tokens in texts.
    """
    docs = pick(docs, id_col, text_col).toDF("id", "text")
    spark = docs.sparkSession
    trained = _train(docs, path, end_id, width, added)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, trained)], "dict_hash string, dictionary binary").write.parquet(f"{folder}/dictionary")
    tie = F.xxhash64("text")
    ordered = docs.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def blocks(batches):
        known, shared = _words_of(path, added), zstandard.ZstdCompressionDict(trained) if trained else None
        frame = zstandard.ZstdCompressor(level=3, dict_data=shared, write_dict_id=False).compress
        held, size, number = [], 0, 0
        for batch in batches:
            for doc, text, part in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "part"))):
                ids = _ids(text, known, end_id)
                held.append((doc, len(ids), frame(ids.astype(f"<u{width}").tobytes()), part))
                size += len(held[-1][2])
                if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield _block(held, number, name, width)
                    held, size, number = [], 0, number + 1
        if held:
            yield _block(held, number, name, width)

    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{folder}/blocks")


def _block(held: list, number: int, name: str, width: int) -> pa.RecordBatch:
    offsets = np.cumsum([0] + [len(h[2]) for h in held])
    row = {"part": held[0][3], "block": number, "dict_hash": name, "width": width, "doc_ids": [h[0] for h in held],
           "n_tokens": [h[1] for h in held], "offsets": offsets.tolist(), "payload": b"".join(h[2] for h in held)}
    kinds = {"part": pa.int32(), "block": pa.int32(), "dict_hash": pa.string(), "width": pa.int32(),
             "doc_ids": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64()), "offsets": pa.list_(pa.int64()),
             "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], names=list(kinds))


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    """The one row of the dictionary's table."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    return row["dict_hash"], bytes(row["dictionary"])


def read_ids(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids packed as 32-bit little-endian) of all documents, or of those ``wanted``.

    ``start`` is the number of ids of all documents before.
    """
    name, trained = _dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = blocks.select("part", "block", F.aggregate(
        "n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("block", "n"))).alias("each"))
    # One row per partition of the write, which bounds this table.
    rows = totals.select("part", "n").orderBy("part").collect()
    before, seen = {}, 0
    for part, n in rows:
        before[part], seen = seen, seen + n
    base = spark.createDataFrame(list(before.items()), "part int, base bigint")
    starts = totals.select("part", "each").join(base, "part")
    at = F.posexplode("each").alias("k", "e")
    starts = starts.select("part", "base", "each", at).select("part", F.col("e.block").alias("block"), (
        F.col("base") + F.aggregate(F.slice("each", 1, F.col("k")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    ).alias("start"))
    if wanted is not None:
        blocks = blocks.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(w)) for w in wanted])))

    def documents(batches):
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        unpack = zstandard.ZstdDecompressor(dict_data=shared).decompress
        for batch in batches:
            for b in batch.to_pylist():
                if b["dict_hash"] != name:
                    raise ValueError(f"block needs dictionary {b['dict_hash']}, found {name}")
                starts = b["start"] + np.cumsum([0] + b["n_tokens"])
                some = [i for i, d in enumerate(b["doc_ids"]) if wanted is None or d in wanted]
                packed = [np.frombuffer(unpack(b["payload"][b["offsets"][i]:b["offsets"][i + 1]]), f"<u{b['width']}")
                          .astype("<u4").tobytes() for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["doc_ids"][i] for i in some], pa.int64()),
                     pa.array([int(starts[i]) for i in some], pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "start", "ids"])

    return blocks.join(starts, ["part", "block"]).mapInArrow(documents, "doc_id bigint, start bigint, ids binary")


def digest(ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the packed ids."""
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.crc32("ids").alias("ids_crc32"))
