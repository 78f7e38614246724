"""run() and each stage on a small table, against the operators' brute-force versions."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from actflow.llm import quality
from actflow.llm.common import scratch, shared_dir

from test_operators import brute_classes, brute_lines, sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder of tables: some of the smallest documents, with nulls, an empty text, repeated rows, and shared passages."""
    at = tmp_path_factory.mktemp("corpus")
    src = "/root/testdata/sf0.001"
    d = sample(spark, src).limit(70)
    passage = " ".join(f"shared{i} word" for i in range(40)) + "."
    extra = [(10**6 + i, f"The first line {i} is of the text itself.\n{passage}", "en", "s", 0) for i in range(3)] + [(10**6 + 9, None, "en", None, None), (10**6 + 10, "", "en", "s", 0), (None, "no id but some words.", None, "s", 3)]
    item = sample(spark, src, "benchmark").filter("text is not null").first().text
    extra += [(10**6 + 20, f"This text holds {item} and goes on.", "en", "s", 0)] * 2
    d = d.unionByName(spark.createDataFrame(extra, d.schema)).withColumn("n_chars", F.length("text").cast(d.schema["n_chars"].dataType))
    d = d.withColumn("keep_id", F.lit(1)).withColumn("tails", F.lit("x")).withColumn("run_doc", F.lit(2))
    d.write.parquet(f"file://{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        sample(spark, src, t).write.parquet(f"file://{at}/{t}.parquet")
    return f"file://{at}"


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    # Quality classifier: the rows whose tail probability reaches a half, with all their columns.
    model = quality.fit_on(docs, spark.read.parquet(f"{made}/labels.parquet"))
    feats, all_rows = quality.Features(), docs.collect()
    want = [r for r in all_rows if model.tails(*feats.of_text(r.text or ""))[0] >= 0.5]
    good = stages["quality classifier"](spark, docs, made)
    assert rows(good) == sorted(map(str, want)) and good.columns == docs.columns and 0 < len(want) < len(all_rows)
    # Line dedup: on all documents, so that its rule for emptied texts is met too.
    empty = spark.createDataFrame([(10**6 + 30, " ".join(f"shared{i} word" for i in range(40)) + ".", "en", "s", 0, 1, "x", 2)], docs.schema)
    full = docs.unionByName(empty)
    once = {(r.doc_id, r.text) for r in full.collect() if r.text is not None and r.doc_id is not None}
    lines = brute_lines(sorted(once))
    out = stages["line dedup"](spark, full, made)
    got = {r.doc_id: r for r in out.collect()}
    gone = {i for i, t in lines.items() if not WORD.search(t) and WORD.search(dict(once)[i])}
    assert 10**6 + 30 in gone and out.columns == docs.columns
    assert {i: got[i].text for i in lines if i not in gone} == {i: t for i, t in lines.items() if i not in gone} and not gone & set(got)
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None) and got[10**6 + 9].text is None
    # Near-dedup: one of each class, and of repeated rows.
    left = stages["MinHash near-dedup"](spark, docs, made)
    classes = brute_classes(sorted({(r.doc_id, r.text) for r in all_rows if r.doc_id is not None}, key=lambda x: x[0]))
    kept = [r.doc_id for r in left.collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(classes.values())) and kept.count(None) == 1 and left.columns == docs.columns
    # Decontamination: no text that holds the planted item.
    clean = stages["benchmark decontamination"](spark, docs, made)
    assert clean.columns == docs.columns and {r.doc_id for r in all_rows} - {r.doc_id for r in clean.collect()} >= {10**6 + 20}
    # Packing: all pieces of all documents.
    packed = stages["best-fit packing"](spark, docs, made).collect()
    assert len({r.doc_id for r in packed}) == len({r.doc_id for r in all_rows}) and max(r.offset + r.length for r in packed) <= 2048


def test_run(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, made)
    pieces = lambda df: Counter((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    folder = shared_dir(spark).removeprefix("file://") + "/actflow"
    before = set(os.listdir(folder))
    with scratch(spark):
        assert pieces(corpus_pipeline.run(spark, made)) == pieces(docs)
        assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"stage0", "stage1", "stage2", "stage3", "pieces"}
    assert set(os.listdir(folder)) == before


def test_stages_on_an_empty_table(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, made)
        assert docs.count() == 0
