"""A training corpus from raw documents, in stages that each read what the one before has written.

quality classifier -> SimHash near-dedup -> PII -> mixing sources to target weights -> byte-level BPE
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom.llm import bpe, mixing, pii, quality, simhash
from siteloom.session import checkpoint_dir

#: Words of a shingle in the near-dedup stage.
SHINGLE_WORDS = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject; empty ones carry nothing and go."""
    return quality.kept(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the row with the smallest id (of rows that share it, one)."""
    return simhash.first_of_groups(docs, words=SHINGLE_WORDS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind and n_chars counted anew."""
    out = pii.redacted(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources repeated as their weights ask for."""
    return mixing.mix(docs, max_repeats=mixing.MAX_REPEATS).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digests of every row."""
    ranks, pattern = bpe.vocabulary_file()
    return bpe.bpe_encode(docs, ranks, pattern, ["doc_id", "source"], with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding", bpe_stage),
]

#: SQL can't express the stages; tests/llm/ holds near-dedup, PII and BPE against plain computations; quality by label accuracy only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
