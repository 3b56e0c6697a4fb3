"""Stages of the training corpus pipeline, each written as Parquet and read again by the next.

Quality rules drop documents, the Jaccard join keeps the document of least doc_id in each group of near
copies, suffix dedup cuts repeated passages out of the texts, decontamination drops documents that hold
benchmark passages, and byte-level BPE encodes what is left and decodes it again.

Rows that repeat a doc_id, null texts and clashing extra columns: each stage keeps or drops rows by the
results of its operator; columns of any name pass until the last stage. Rows without a doc_id are kept by the
join and the suffix stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, jaccard_join, quality_rules, scratch, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that whose doc_id names the group."""
    return jaccard_join.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that earlier documents hold; a document of which nothing is left goes.

    n_chars is set to the new text's length where a text changed. A character that loses some of its
    bytes goes whole.
    """
    return suffix_dedup.shortened(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of each remaining text, their number, and the digest of the bytes they decode to."""
    return bpe.encode_checked(docs, *bpe.public_ranks())


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_copies),
    ("suffix_dedup", passages),
    ("decontamination", decontaminated),
    ("byte_bpe", tokens),
]

#: SQL can express neither the components of near copies nor the merges of BPE; tests hold run() against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage wrote goes when the next one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = scratch.stored(stage(spark, docs, sf_dir))
        if k:
            scratch.free(docs)
        docs = out
    return docs
