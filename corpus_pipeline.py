"""The corpus pipeline: from documents to token ids, in five stages that each work on all that the one before kept.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. Between stages the rows are written as Parquet and read again, so every stage's input is a
table scan; run() writes to the shared folder (spark.checkpoint.dir). An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafpress.llm import byte_bpe, exact_dedup, mixing, near, quality
from leafpress.llm.common import written

#: SQL can express neither the classifier's fit nor byte-level BPE; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from all labels of the documents here."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, one stays."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard similarity of at least 0.8, the one with the smallest id stays; SimHash with Golay codewords proposes them."""
    return near.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources by name weigh 1, 2, 3, repeating."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, their byte offsets and the digest of the text decoded from them, of every row: the result of the pipeline."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mix", mixing_stage), ("byte_bpe", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
