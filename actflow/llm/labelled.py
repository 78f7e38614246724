"""A bounded sample of labelled texts, as classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], train: Column, per_class: int, max_chars: int, doc_id: str = "doc_id", text: str = "text") -> tuple[list, dict]:
    """Rows (the targets, text) to fit on, and how many labelled rows each class has.

    ``targets`` are columns made of the labels' columns; their values together are the class. Of every
    class the ``per_class`` ids with the least hashes are taken, as long as their texts together have at
    most the class's part of ``max_chars`` characters: whole texts. One that doesn't fit is passed over; if
    none fits, the shortest is taken. ``train`` is a condition on doc_id. Rows with a null id or target are left out; of an id that is labelled twice, the greatest
    targets count; of an id with several texts, the least text.
    """
    names = list(targets)
    rows = labels.select(col(doc_id).alias("doc_id"), *(c.alias(k) for k, c in targets.items())).filter(train).dropna()
    rows = rows.groupBy("doc_id").agg(F.max(F.struct(*names)).alias("t")).select("doc_id", "t.*")
    sizes = {tuple(r[k] for k in names): r["n"] for r in rows.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    picked = None
    for values in sorted(sizes):
        part = rows.filter(" and ".join(f"{k} = {v}" for k, v in zip(names, values))).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return [], {}
    texts = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    # per_class ids at most for each class: a bound that holds at every size.
    found = materialize(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text")), "sample")
    share = max_chars // max(1, len(sizes))
    # Only ids and lengths are gathered, of per_class texts a class.
    one = F.struct(order.alias("o"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    lists = found.groupBy(*names).agg(F.array_sort(F.collect_list(one)).alias("xs"))
    none = F.array().cast(f"array<{found.schema['doc_id'].dataType.simpleString()}>")
    fit = lambda a, x: F.when(a["used"] + x["n"] <= share, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a)
    ids = F.aggregate("xs", F.struct(F.lit(0).cast("long").alias("used"), none.alias("ids")), fit, lambda a: a["ids"])
    shortest = F.array_min(F.transform("xs", lambda x: F.struct(x["n"], x["o"], x["id"].alias("id"))))["id"]
    taken = lists.select("xs", ids.alias("ids")).select(F.explode(F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array(shortest))).alias("doc_id"))
    kept = found.join(F.broadcast(taken), "doc_id", "left_semi")
    return kept.select(*names, "text").orderBy(order, "doc_id").collect(), sizes


def class_weights(rows: list, names: list[str], sizes: dict) -> list[float]:
    """Weights that give the sample the classes' shares of all labelled rows."""
    taken: dict = {}
    for r in rows:
        k = tuple(r[n] for n in names)
        taken[k] = taken.get(k, 0) + 1
    total = sum(sizes[k] for k in taken)
    return [sizes[k] / total * len(rows) / taken[k] for k in (tuple(r[n] for n in names) for r in rows)]
