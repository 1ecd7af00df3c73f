"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from covera.llm import kn_quality, mixing, secret_forest, simhash, unigram_pieces
from covera.llm.common import table
from covera.session import ensure_checkpoint_dir, lineage_scope, release


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    return kn_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    return simhash.keep_one(docs, shingle=3, reach=3)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secret_forest.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_ids, n_chars, exact of every document."""
    import public_tokenizers
    pieces = unigram_pieces.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram_pieces.encode_documents(docs, pieces, ("doc_id", "lang", "source"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: SQL has no language model, forest or trie; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        # A stage's own tables go when its output is written, and so does the output it has read.
        with lineage_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            release(spark, [before])
        docs, before = spark.read.parquet(path), path
    return docs
