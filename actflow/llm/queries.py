"""The queries of the training-data operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, lm, near_dup, packing, pii, quality, toxicity, warc, weak_rules
from .common import held_out, table
from .oracles import ORACLES

TOKENIZER = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), warc.new_archive_path(spark))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(table(spark, sf_dir, "documents")).drop("posterior")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("spans", "char_spans", "item_ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = line_dedup.dedupe_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col(n).cast("long").alias("n_deleted"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 5, 0)  # not learnt from, as in op1
    return quality.score_quality(docs, quality.fit_on(docs, labels, train=~held)).withColumn("held_out", held)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_spans(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_near_duplicates, op4_quality_rules, op5_decontamination, op6_packing, op7_line_dedup, op8_lm_scores, op9_quality, op10_pii)}
