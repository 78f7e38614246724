"""Quality: ordinal cumulative-link regression on graded ratings.

A text has grade 0 (poor), 1 (sound but toxic) or 2 (sound). One weight vector
over hashed text features gives a latent score s, and ordered thresholds
t1 < t2 give P(grade >= k) = sigmoid(s - tk). The expected grade is the sum of
these tail probabilities; documents are selected by one of them.

Features, hashed: lower-cased words, the shapes of words (case, digits, signs),
the class of each sign, and pairs of equal neighbours. Of a very long word each
run of letters, digits or signs is a word, or each few characters of it. A text's feature values
are the roots of the features' shares, so that length alone counts for nothing.

The regression is fitted on the driver on a bounded sample: ``per_class`` texts
of each combination of labels and ``max_chars`` characters at most.

Nulls: a null text is the empty text. Repeated rows get a row each. Extra
columns are kept by ``select_documents`` and ignored by ``score_quality``. With
no labelled rows all tail probabilities are 1: nothing is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_parts, col, fresh, with_fields
from .labelled import class_weights, labelled_sample

BITS, GRADES = 17, 3
_RUN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Runs and characters of a word that is a feature as a whole, and the size of a longer run's pieces.
_WORD_RUNS, _WORD_SIZE, _PIECE = 12, 64, 4
#: Words a worker remembers at most.
CACHE_WORDS = 200_000


def shape(word: str) -> str:
    """The word's runs of letters (by case), digits and other signs: of a run of three signs or more, which they are."""
    out = []
    for run in _RUN.findall(word):
        if run[0].isalpha():
            out.append("a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "Aa" if run.istitle() or run[0].isupper() else "aA")
        else:
            out.append("0" if run[0].isdigit() else run if len(run) < 3 else "".join(sorted(set(run))) + "+")
    return "".join(out)


def pieces(word: str) -> list[str]:
    """The word, or all its runs if it is long; long runs, as of a script without spaces, are cut."""
    runs = _RUN.findall(word)
    if len(runs) <= _WORD_RUNS and len(word) <= _WORD_SIZE:
        return [word]
    return [run[i : i + size] for run in runs for size in (_PIECE if len(run) > _WORD_SIZE else len(run),) for i in range(0, len(run), size)]


class Features:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        """The numbers of the word and of its shape, in one."""
        if (got := self.known.get(word)) is None:
            of, shaped = (zlib.crc32(f"{k}{v}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for k, v in (("w ", word.lower()), ("s ", shape(word))))
            got = of << BITS | shaped
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = got
        return got

    def of_text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature numbers and their values."""
        words = text.split()
        if not words:
            return np.array([zlib.crc32(b"empty") & ((1 << BITS) - 1)]), np.ones(1)
        if len(max(words, key=len)) > _WORD_RUNS:
            words = [p for w in words for p in (pieces(w) if len(w) > _WORD_RUNS else (w,))]
        pairs = Counter(words)
        ids = np.fromiter(map(self.of_word, pairs), np.int64, len(pairs))
        n = np.array(list(pairs.values()), np.float64)
        repeats = sum(map(str.__eq__, words, words[1:]))
        distinct = len(pairs)
        flat = np.concatenate([ids >> BITS, ids & ((1 << BITS) - 1), _RATIO_IDS])
        share = np.concatenate([n, n, [repeats, distinct]]) / len(words)
        unique, place = np.unique(flat, return_inverse=True)
        return unique, np.sqrt(np.bincount(place, share))


_RATIO_IDS = np.array([zlib.crc32(k) & ((1 << BITS) - 1) for k in (b"r repeats", b"r distinct")])


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one below each grade but the lowest

    def tails(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        s = float(self.weights[ids] @ values)
        return 1 / (1 + np.exp(-np.clip(s - self.thresholds, -35, 35)))


def fit(texts: list[str], grades: list[int], weight: list[float], l2: float = 1e-4, rounds: int = 400) -> Model:
    if not texts:
        return Model(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, -35.0))
    feats = Features()
    rows = [feats.of_text(t) for t in texts]
    flat, vals = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    used, flat = np.unique(flat, return_inverse=True)
    g, sw = np.array(grades), np.array(weight) / sum(weight)
    w, k = np.zeros(len(used)), np.arange(1, GRADES)
    # thresholds as the first one and the logs of the gaps keep their order
    share = np.clip([(sw * (g >= j)).sum() for j in k], 1e-3, 1 - 1e-3)
    t = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * k)
    theta = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    x = np.concatenate([w, theta])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for it in range(1, rounds + 1):
        w, theta = x[: len(used)], x[len(used) :]
        t = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        s = np.bincount(owner, w[flat] * vals, len(rows))
        tail = np.column_stack([np.ones(len(s)), 1 / (1 + np.exp(-np.clip(s[:, None] - t, -35, 35))), np.zeros(len(s))])
        at = np.arange(len(s))
        p = np.maximum(tail[at, g] - tail[at, g + 1], 1e-9)
        slope = tail * (1 - tail)
        upper, lower = slope[at, g] / p, slope[at, g + 1] / p
        gs = -sw * (upper - lower)
        gt = np.zeros(GRADES - 1)
        for j in range(GRADES - 1):  # threshold j is below grade j + 1
            gt[j] = (sw * (upper * (g == j + 1) - lower * (g == j))).sum()
        gtheta = np.concatenate([[gt.sum()], np.exp(theta[1:]) * np.cumsum(gt[::-1])[::-1][1:]])
        grad = np.concatenate([np.bincount(flat, gs[owner] * vals, len(used)) + l2 * w / len(used) ** 0.5, gtheta])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * min(1.0, 2 * (rounds - it + 1) / rounds)  # the second half settles
        x = x - step * (1 - 0.99**it) ** 0.5 / (1 - 0.9**it) * m / (np.sqrt(v) + 1e-8)
    w, theta = x[: len(used)], x[len(used) :]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def fit_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = 1500, max_chars: int = 24_000_000, train=None, l2: float = 1e-2) -> Model:
    """``l2`` was chosen by 3-fold cross-validation on the rows that op9 learns from (sf0.1)."""
    targets = {"quality": (F.col("quality") > 0).cast("int"), "toxic": (F.coalesce(F.col("toxic"), F.lit(0)) > 0).cast("int")}
    rows, sizes = labelled_sample(docs, labels, targets, F.lit(True) if train is None else train, per_class, max_chars, doc_id, text)
    grades = [r.quality * (2 - r.toxic) for r in rows]
    return fit([r.text for r in rows], grades, class_weights(rows, ["quality", "toxic"], sizes), l2)


def with_tails(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and a column with the array P(grade >= 1), P(grade >= 2); its name."""
    name, at, n = fresh(docs, "tails"), docs.columns.index(text), len(docs.columns)
    schema = with_fields(docs.schema, (name, T.ArrayType(T.DoubleType())))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        m, feats = sent.value, Features()

        def score(batch: pa.RecordBatch) -> pa.RecordBatch:
            tails = [m.tails(*feats.of_text(t or "")).tolist() for t in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(tails, pa.list_(pa.float64()))], names=schema.names)

        return score

    return docs.mapInArrow(by_parts("quality", start), schema), name


def score_quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", min_grade: int = 1, min_probability: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_sound (>= 1), p_best (>= 2), kept: the tail probability of ``min_grade`` reaches ``min_probability``."""
    out, tails = with_tails(docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")), model)
    p = F.col(tails)
    return out.select("doc_id", (p[0] + p[1]).alias("expected_grade"), p[0].alias("p_sound"), p[1].alias("p_best"), (p[min_grade - 1] >= min_probability).alias("kept"))


def select_documents(docs: DataFrame, model: Model, text: str = "text", min_grade: int = 1, min_probability: float = 0.5) -> DataFrame:
    """The documents that ``score_quality`` keeps, with the columns they had."""
    out, tails = with_tails(docs, model, text)
    return out.filter(F.col(tails)[min_grade - 1] >= min_probability).select(*map(col, docs.columns))
