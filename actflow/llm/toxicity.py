"""Toxicity: a character n-gram linear classifier with naive Bayes features.

A feature is the presence of a character n-gram (3 to 5 characters of the
lower-cased text, hashed). Its value is the log ratio of its smoothed rates in
toxic and other training texts; a logistic regression is fitted on these
values. Only the text is read for a score.

The classifier is fitted on the driver on a bounded sample of labelled rows:
``per_class`` texts of each class and ``max_chars`` characters at most. Of the
2 ** 18 hashed n-grams it uses the ``n_features`` whose log ratio is greatest
for its error, among those in ``min_texts`` texts of the sample or more. A score
reads the whole text.

Nulls: a null text is scored as the empty text, a null id counts as held out.
Repeated rows get a row each. Extra columns are ignored. With no labelled rows
of one of the two classes the score is the smoothed share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, held_out
from .labelled import class_weights, labelled_sample

BITS = 18


def gram_buckets(text: str, sizes: tuple[int, ...] = (3, 4, 5), bits: int = BITS) -> list[np.ndarray]:
    """Buckets of all character n-grams of the lower-cased text with a space on either side."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h, out = c * np.uint32(0x9E3779B1), []
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(c) < n:
                break
            h = (h[:-1] ^ c[n - 1 :]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        if n in sizes:
            out.append(((h + np.uint32(n)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits))
    return out


@dataclass
class Model:
    weights: np.ndarray  # by bucket, 0 where not selected
    bias: float

    def score(self, text: str) -> float:
        total, seen = self.bias, []
        for b in gram_buckets(text):
            seen.append(b[self.weights[b] != 0])
        if seen:
            total += float(self.weights[np.unique(np.concatenate(seen))].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def fit(texts: list[str], toxic: list[int], weight: list[float], n_features: int = 16384, min_texts: int = 3, l2: float = 3e-3, rounds: int = 300) -> Model:
    y, sw = np.array(toxic, np.float64), np.array(weight, np.float64)
    none = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        share = (float((y * sw).sum()) + 1) / (float(sw.sum()) + 2)
        return Model(none, float(np.log(share / (1 - share))))
    rows = [np.unique(np.concatenate(gram_buckets(t) or [np.zeros(0, np.uint32)])) for t in texts]
    counts = np.zeros((2, 1 << BITS))
    for ids, label in zip(rows, toxic):
        counts[label, ids] += 1
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio -= np.log((y == 1).sum() / p.sum()) - np.log((y == 0).sum() / q.sum())  # rates among the texts of a class
    strength = np.abs(ratio) / np.sqrt(1 / p + 1 / q) * (counts.sum(0) >= min_texts)
    keep = np.argsort(-strength, kind="stable")[:n_features]
    keep = keep[strength[keep] > 0]
    place = np.full(1 << BITS, -1)
    place[keep] = np.arange(len(keep))
    cols = [place[ids][place[ids] >= 0] for ids in rows]
    lengths = np.array([len(c) for c in cols])
    flat, owner = np.concatenate(cols), np.repeat(np.arange(len(cols)), lengths)
    r = ratio[keep]
    w, b = np.zeros(len(keep)), float(np.log((sw * y).sum() / (sw * (1 - y)).sum()))
    # Adam on the whole sample; the penalty is on the weights of the scaled features.
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(owner, (w * r)[flat], len(cols)) + b
        g = sw * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / sw.sum()
        gw, gb = np.bincount(flat, g[owner], len(keep)) * r + l2 * w / len(keep) ** 0.5, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        step = 0.03 * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (vb**0.5 + 1e-8)
    none[keep] = (w * r).astype(np.float32)
    return Model(none, b)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, fold: int = 0, per_class: int = 2000, max_chars: int = 24_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; the fold that is held out is not learnt from."""
    rows, sizes = labelled_sample(docs, labels, {"toxic": (col(label) > 0).cast("int")}, ~held_out(F.col("doc_id"), folds, fold), per_class, max_chars, doc_id, text)
    model = fit([r.text for r in rows], [r.toxic for r in rows], class_weights(rows, ["toxic"], sizes))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            s = [m.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = narrow.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
