"""One query per operator, over the whole test tables, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import (
    byte_bpe, gru_lm, jaccard_join, mixing, pii, prefix_trie, quality, structure_repair, suffix_dedup, token_files, toxicity,
    url_filter, vp_tree,
)
from tidelog.llm.common import pick, read
from tidelog.llm.sql import ORACLES  # noqa: F401
from tidelog.session import scratch_path

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_tree.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = toxicity.train(docs, labels.filter(~held_out))
    return toxicity.tag(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    path = public_tokenizers.path(WORD_BPE)
    token_files.write(read(spark, sf_dir, "documents"), folder, path, end_id=1, added=True)
    return token_files.digest(token_files.read_ids(spark, folder))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read(spark, sf_dir, "documents"), n_words=3, percent=90)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"), prefix_trie.share_heads)


# The longest rule that fits decides.
URL_RULES = (
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return structure_repair.repair(structure_repair.damage(conversations), conversations)


QUERIES = {f.__name__: f for f in (
    op1_repeated_bytes, op2_nearest_vectors, op3_mix_sources, op4_personal_data, op5_token_files, op6_toxicity,
    op7_quality_rules, op8_byte_bpe, op9_language_model, op10_jaccard_join, op11_prefix_trie, op12_url_filter,
    op13_structure_repair)}
