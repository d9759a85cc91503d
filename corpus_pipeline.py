"""From raw documents to token ids: quality rules, near duplicates, personal data, mix of sources, byte-level BPE.

Each stage takes what the one before kept, written as Parquet in the shared scratch folder, and all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import byte_bpe, jaccard_join, mixing, pii, quality
from tidelog.llm.common import materialize, read

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word shingles of similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, n_words=5, percent=80)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, source and token ids of each document."""
    ids = byte_bpe.encode(docs["text"], public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)
    return docs.select("doc_id", "source", ids.alias("ids"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("personal data", hide_personal_data),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

# The stages on sets of shingles, learned patterns and merges are beyond SQL; tests compare them with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
