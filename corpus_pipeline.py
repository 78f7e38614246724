"""From raw documents to packed sequences: five stages, each reading what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actflow.llm import decontaminate, line_dedup, near_dup, packing, quality
from actflow.llm.common import SPACE, materialize, scratch, table

TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being sound, under the ordinal model, is at least a half."""
    return quality.select_documents(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that has lost all its words goes too."""
    out, n = line_dedup.dedupe_lines(docs, n_chars="n_chars")
    emptied = (F.col(n) > 0) & ~F.col("text").rlike(f"[^{SPACE}]")
    return out.filter(~F.coalesce(emptied, F.lit(False))).drop(n)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Trained and hashed stages are beyond SQL: tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage wrote for itself is deleted once its result is written; within a
    ``scratch`` block, stages' results and the last stage's own tables are deleted at its end."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage{i}", outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
