"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The model predicts a symbol from the ``order`` before it. Symbols are the
``n_words`` most frequent words, the end of a text, ``n_groups`` groups of other
words by their last two characters, and one for all others; a word of a group
has its add-one share of the group. With context symbols x1, x2, ... the
prediction is r = R[x1] C1 + R[x2] C2 + ... Symbols in order of their numbers
make classes of ``class_size``, and a symbol's probability is that of its class
given r times that of the symbol in its class given r; both are normalised
exactly, over the classes and over one class, by batched matrix products. So the
cost of a token grows with the root of the vocabulary.

Training covers every token of all training documents. One pass over the texts
turns all documents into symbols, written once as 16-bit numbers; training and
scoring both read these. A round takes each token of the training documents as
an example once, in ``stride`` turns: a turn has every ``stride``-th token of a
text, from a place that depends on the text, and the turns together have all.
In every turn each task trains the model on its examples in numpy by
noise-contrastive estimation, classes against classes drawn by frequency,
symbols against others of their class. Noise isn't drawn: as the sums over all
classes, and over all symbols of a class, are matrix products, its part of the
estimate is the expectation. The tasks' vectors are then averaged row by row,
weighted by how often a task has used them. Only the model goes to and from the
driver; its size is set by the parameters.

Counts of frequent words (``head`` words, a fixed bound) are sent to the
executors; all other words of a document meet their counts in a shuffled join.

The base score is that of add-one unigrams with one unknown word.

Nulls: a null text is empty (one end token); a null id counts as held out.
Repeated rows get a row each. Extra columns are ignored. With no training
documents N and V are 0 and all symbols of a class are equally likely.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, held_out, materialize

END, OTHER, SUFFIX = 0, 1, 2
#: Tokens whose windows are held together; of these, tokens whose scores are one product; examples of one shuffle.
BLOCK, PART, CHUNK = 1 << 18, 1 << 13, 1 << 20
#: Distinct words a counting task holds before it hands them on.
FLUSH = 400_000
#: Bytes of text whose words are looked up together.
SLICE = 1 << 23
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def count_words(texts: DataFrame) -> DataFrame:
    """word, c of a table with one column of texts, pre-aggregated in every task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(words_of(t))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return texts.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What a task needs to turn words into symbols; its sizes are fixed bounds."""

    index: dict[bytes, int]  # head words
    symbol: np.ndarray  # of head words; the last entry is for words outside
    log_count: np.ndarray  # log10(c + 1) of head words, 0 for the last
    suffixes: dict[str, int]  # symbols of word endings
    log_room: np.ndarray  # by symbol: log10(tokens + words + 1) of a group, 0 for words and the end
    counts: np.ndarray  # tokens by symbol

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Head places (len(index) if outside) and symbols of the words, and the words outside."""
        out = len(self.index)
        place = np.fromiter(map(self.index.get, words, repeat(out)), np.int64, len(words))
        sym, beyond = self.symbol[place], np.flatnonzero(place == out)
        outside = [words[i].decode("utf-8", "surrogatepass") for i in beyond.tolist()]
        sym[beyond] = [self.suffixes.get(w[-SUFFIX:], OTHER) for w in outside]
        return place, sym, outside


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts, with where they start, of about ``SLICE`` bytes."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
        yield at, texts.slice(at, to - at)
        at = to


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``words_of`` as strings, and the text that each is of."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, of = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves empty ones
    return words.filter(some), of[some.to_numpy(zero_copy_only=False)]


def build_lexicon(counts: DataFrame, n_docs: int, head: int, n_words: int, n_groups: int) -> Lexicon:
    """counts: word, c (a written table)."""
    n_symbols = 2 + n_words + n_groups
    if n_symbols >= 1 << 15:
        raise ValueError("symbols are 16-bit numbers")
    top = counts.orderBy(F.desc("c"), "word").limit(max(head, n_words)).select("word", "c").toArrow()  # columns, not row objects
    words, often = top["word"].to_pylist(), top["c"].to_numpy()
    own = top.slice(0, n_words)
    # Words with a symbol of their own: those above the last one in the order.
    last = (int(often[n_words - 1]), words[n_words - 1]) if len(words) >= n_words else None
    inside = F.lit(True) if last is None else (F.col("c") > last[0]) | ((F.col("c") == last[0]) & (F.col("word") <= last[1]))
    rest = counts.filter(~inside)
    suffix = F.substring("word", -SUFFIX, SUFFIX)
    ends = [r.s for r in rest.groupBy(suffix.alias("s")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "s").limit(n_groups).collect()]
    suffixes = {s: 2 + n_words + i for i, s in enumerate(ends)}
    of_word = F.when(suffix.isin(ends), suffix) if ends else F.lit(None).cast("string")
    room, tokens = np.zeros(n_symbols), np.zeros(n_symbols)
    for r in rest.groupBy(of_word.alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        group = OTHER if r.s is None else suffixes[r.s]
        room[group], tokens[group] = np.log10(r.n + r.v + 1), r.n
    tokens[END] = n_docs
    tokens[2 : 2 + len(own)] = own["c"].to_numpy()
    symbol = [2 + i if i < n_words else suffixes.get(w[-SUFFIX:], OTHER) for i, w in enumerate(words)]
    index = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(words)}
    return Lexicon(index, np.array([*symbol, OTHER], np.int64), np.log10(np.append(often + 1.0, 1.0)), suffixes, room, tokens)


def padded(sym: np.ndarray, order: int, start: int) -> np.ndarray:
    """The symbols of a text with its start before and its end after them, as 16-bit numbers."""
    return np.concatenate([np.full(order, start), sym, [END]]).astype("<i2")


def dealt(text: np.ndarray, order: int, stride: int, turn: int) -> np.ndarray:
    """The examples that a ``padded`` text has in a turn: the symbols before a token, nearest last, and its own."""
    n, wide = len(text) - order, text.itemsize
    first = min((turn + zlib.crc32(text)) % stride, n)
    return np.ndarray((-(-(n - first) // stride), order + 1), text.dtype, text, first * wide, (stride * wide, wide))


def examples(texts: DataFrame, lexicon, order: int, start: int, stride: int) -> DataFrame:
    """n, codes: the examples of a round, every token's once, a row for a text's share in each of ``stride`` turns."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_text = [padded(lexicon.value.symbols(words_of(t))[1], order, start) for t in batch.column(0).to_pylist()]
            rows = [dealt(x, order, stride, turn) for x in of_text for turn in range(stride)]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in rows], pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["n", "codes"])

    return texts.mapInArrow(pick, "n long, codes binary")


def _sums(index: np.ndarray, columns: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` numbers occur, and the sum of the columns of each as a row."""
    met, rank = np.flatnonzero(np.bincount(index, minlength=n)), np.empty(n, np.int64)
    rank[met] = np.arange(len(met))
    at = rank[index]
    return met, np.array([np.bincount(at, c) for c in columns], np.float32).T


def _ahead(r: np.ndarray, part: np.ndarray, bias: bool, met: np.ndarray | None = None) -> np.ndarray:
    """What context symbols add to a prediction from one place, of those met there; one place adds the one for the bias."""
    out = np.empty((len(r), r.shape[1] + 1), np.float32)
    out[:, -1] = bias
    if met is None:
        out[:, :-1] = r @ part
    else:
        met = np.flatnonzero(np.bincount(met, minlength=len(r)))
        out[met, :-1] = r[met] @ part
    return out


@dataclass
class LogBilinear:
    """The parameters: rows of four matrices; a last column of the output vectors is their bias."""

    r: np.ndarray  # vectors of context symbols, the start of a text last
    c: np.ndarray  # one matrix a context place, one below the other
    q: np.ndarray  # vectors of predicted symbols
    k: np.ndarray  # vectors of classes
    class_size: int

    @classmethod
    def new(cls, counts: np.ndarray, order: int, size: int, class_size: int, seed: int = 7) -> LogBilinear:
        """Small random vectors; biases are the logs of the symbols' shares in their class and of the classes' shares."""
        rng, n = np.random.default_rng(seed), len(counts)
        n_classes = -(-n // class_size)
        full = np.zeros(n_classes * class_size)
        full[:n] = counts + 0.5
        by_class = full.reshape(n_classes, class_size)
        share = by_class.sum(axis=1)
        bias = np.log(np.maximum(by_class, 1e-30) / share[:, None]).ravel()[:n]
        some = lambda rows: rng.normal(0, 0.1, (rows, size))
        return cls(some(n + 1), np.concatenate([np.eye(size) / order] * order), np.column_stack([some(n) * 0.1, bias]), np.column_stack([some(n_classes) * 0.1, np.log(share / share.sum())]), class_size)

    def matrices(self) -> list[np.ndarray]:
        return [self.r, self.c, self.q, self.k]

    def _by_class(self, x: np.ndarray, ahead: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Windows in the order of their classes: that order, columns, predictions with a one for the bias, classes, the rows of each class met."""
        of = (x[:, -1] // self.class_size).astype(np.int16)
        order = np.argsort(of, kind="stable")
        x, of = np.ascontiguousarray(x[order].T), of[order]
        r1 = ahead[0].take(x[0], axis=0)
        for table, mine in zip(ahead[1:], x[1:]):
            r1 += table.take(mine, axis=0)
        edges = np.searchsorted(of, np.arange(len(self.k) + 1)).tolist()
        return order, x, r1, of, [(i, slice(a, b)) for i, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]

    def _padded(self, q: np.ndarray, bias: float) -> np.ndarray:
        """The vectors of each class, the last class filled up with vectors of that bias only."""
        out = np.zeros((len(self.k) * self.class_size, q.shape[1]), np.float32)
        out[:, -1] = bias
        out[: len(q)] = q
        return out.reshape(len(self.k), self.class_size, -1)

    def log10_probability(self, codes: np.ndarray) -> np.ndarray:
        """Of each window: the class's probability times the symbol's in its class."""
        size, size_k = self.r.shape[1], self.class_size
        r, c, q, k = (m.astype(np.float32) for m in self.matrices())
        ahead, out = [_ahead(r, c[j * size : (j + 1) * size], j == 0) for j in range(codes.shape[1] - 1)], np.empty(len(codes))
        longest = np.sqrt(max((m**2).sum(axis=1).max() for m in (q, k)))
        q, inner = self._padded(q, -1e30), np.empty((PART, size_k), np.float32)

        for at in range(0, len(codes), PART):
            order, x, r1, of, met = self._by_class(codes[at : at + PART], ahead)
            large = np.sqrt(np.einsum("ij,ij->i", r1, r1).max()) * longest > 80  # no score is above this product

            def log_softmax_at(scores: np.ndarray, at: np.ndarray, large=large) -> np.ndarray:
                if large:
                    scores -= scores.max(axis=1, keepdims=True)
                mine = scores[np.arange(len(at)), at]
                return mine - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32))

            log_p = log_softmax_at(r1 @ k.T, of).astype(np.float64)
            for i, rows in met:
                np.dot(r1[rows], q[i].T, out=inner[rows])
            log_p += log_softmax_at(inner[: len(of)], x[-1] - of * size_k)
            out[at + order] = log_p / np.log(10)
        return out

    def train(self, codes: np.ndarray, counts: np.ndarray, rate: float, rng: np.random.Generator, noise: int = 8, square: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """One pass of noise-contrastive estimation with Adagrad over the examples, in place; how often each row was used.

        With a score s and noise of expected number m, an item's gradient is m e^s / (e^s + m), less 1 in all
        for the target: 1 / (e^-s + 1/m), for the target times 1 - e^-s. ``square`` has Adagrad's sums and is added to.
        """
        size, order, n, size_k, n_classes = self.r.shape[1], codes.shape[1] - 1, len(self.q), self.class_size, len(self.k)
        share = (counts + 0.5) / (counts + 0.5).sum()
        of_symbol = np.arange(n) // size_k
        class_share = np.bincount(of_symbol, share)
        rare, rare_class = np.full(n_classes * size_k, np.inf, np.float32), (1 / (noise * class_share)).astype(np.float32)
        rare[:n] = class_share[of_symbol] / (noise * share)  # what fills the last class has no gradient
        rare = rare.reshape(n_classes, size_k)
        model = r, c, q, k = [m.astype(np.float32) for m in self.matrices()]
        square = [np.ones_like(m) for m in model] if square is None else square
        batch = min(max(len(codes) // 128, 1024), 8192)
        # Written over in each batch: what is as large as the model or the batch isn't allocated again.
        row, outer, inner, within, gr, gc, gq = np.arange(batch), *(np.empty((batch, w), np.float32) for w in (n_classes, size_k, size + 1)), *(np.empty_like(m) for m in model[:2]), np.empty((n_classes, size_k, size + 1), np.float32)

        def gradient(minus: np.ndarray, rare: list[tuple[slice, np.ndarray]], target: np.ndarray) -> np.ndarray:
            """Of negative scores, in place."""
            np.exp(np.minimum(minus, 30, out=minus), out=minus)
            at = row[: len(target)], target
            mine = 1 - minus[at]
            for rows, x in rare:
                minus[rows] += x
            np.reciprocal(minus, out=minus)
            minus[at] *= mine
            return minus

        codes = codes.take(rng.permutation(len(codes)), axis=0)
        for at in range(0, len(codes), batch):
            parts = [c[j * size : (j + 1) * size] for j in range(order)]
            x = codes[at : at + batch]
            _, x, r1, of, met = self._by_class(x, [_ahead(r, part, j == 0, x[:, j]) for j, part in enumerate(parts)])
            m = len(of)
            g = gradient(np.dot(r1, -k.T, out=outer[:m]), [(slice(m), rare_class)], of)
            back, gk = g @ k, g.T @ r1
            by_class = self._padded(q, 0)
            minus_q = -by_class
            for i, rows in met:
                np.dot(r1[rows], minus_q[i].T, out=inner[rows])
            g = gradient(inner[:m], [(rows, rare[i]) for i, rows in met], x[-1] - of * size_k)
            gq.fill(0)
            for i, rows in met:
                np.dot(g[rows], by_class[i], out=within[rows])
                np.dot(g[rows].T, r1[rows], out=gq[i])
            back += within[:m]
            columns = back[:, :-1].T.astype(np.float64, order="C")
            gr.fill(0)
            for j, part in enumerate(parts):
                met_r, g = _sums(x[j], columns, len(r))
                gr[met_r] += g @ part.T
                gc[j * size : (j + 1) * size] = r[met_r].T @ g
            for m, sq, g in zip(model, square, (gr, gc, gq.reshape(-1, size + 1)[:n], gk)):
                sq += g**2
                g *= rate
                g /= np.sqrt(sq)
                m -= g
        for mine, m in zip(self.matrices(), model):
            mine[:] = m
        target = np.bincount(codes[:, -1], minlength=n).astype(float)
        met = target + noise * np.bincount(of_symbol, target)[of_symbol] * share / class_share[of_symbol]
        return [np.bincount(codes[:, :-1].ravel(), minlength=len(r)).astype(float), np.full(len(c), float(len(codes))), met, np.full(n_classes, float(len(codes)))]


def average(trained: DataFrame, partitions: int) -> DataFrame:
    """key, used, sums of the rows (key, used, vector), each vector counted as often as it was used."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[int, float] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, n, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums[key] = sums.get(key, 0) + n * np.frombuffer(v, "<f4").astype(np.float64)
                used[key] = used.get(key, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(used), pa.int64()), pa.array(list(used.values()), pa.float64()), pa.array([(sums[k] / used[k]).astype("<f8").tobytes() for k in used], pa.binary())], names=["key", "used", "vector"])

    return trained.repartition(partitions, "key").mapInArrow(add, "key long, used double, vector binary")


def fit(table: DataFrame, counts: np.ndarray, order: int, size: int, class_size: int, rounds: int, stride: int, rate: float, seed: int = 7) -> LogBilinear:
    """The model, from a written table of ``padded`` texts: turns of training in all tasks and averaging."""
    spark, model = table.sparkSession, LogBilinear.new(counts, order, size, class_size, seed)
    for turn in range(rounds * stride):
        sent = spark.sparkContext.broadcast((model, counts))

        def train(batches: Iterator[pa.RecordBatch], turn=turn, sent=sent) -> Iterator[pa.RecordBatch]:
            mine, n = sent.value
            mine = LogBilinear(*(m.copy() for m in mine.matrices()), mine.class_size)
            used, square = [np.zeros(len(m)) for m in mine.matrices()], [np.ones(m.shape, np.float32) for m in mine.matrices()]
            kept: list[np.ndarray] = []

            def learn() -> None:
                x = np.concatenate(kept)
                kept.clear()
                rng = np.random.default_rng([seed, turn, len(x), zlib.crc32(x.tobytes())])
                for total, now in zip(used, mine.train(x, n, rate / (turn + 1), rng, square=square)):
                    total += now

            held = 0
            for batch in batches:
                for text in batch.column(0):
                    kept.append(dealt(np.frombuffer(text.as_buffer(), "<i2"), order, stride, turn))
                    held += len(kept[-1])
                    if held >= CHUNK:
                        learn()
                        held = 0
            if held:
                learn()
            for i, (m, u) in enumerate(zip(mine.matrices(), used)):
                rows = np.flatnonzero(u)
                yield pa.RecordBatch.from_arrays([pa.array(rows + (i << 40)), pa.array(u[rows]), pa.array([m[j].astype("<f4").tobytes() for j in rows], pa.binary())], names=["key", "used", "vector"])

        trained = materialize(table.mapInArrow(train, "key long, used double, vector binary"), "trained")
        mean = average(trained, 12).toArrow()  # as many rows as the model has
        parts = [m.copy() for m in model.matrices()]
        for key, v in zip(mean["key"].to_pylist(), mean["vector"].to_pylist()):
            parts[key >> 40][key & ((1 << 40) - 1)] = np.frombuffer(v, "<f8")
        model = LogBilinear(*parts, class_size)
        sent.unpersist()
    return model


def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, head: int = 100_000, n_words: int = 3966, n_groups: int = 128,
    order: int = 3, size: int = 32, class_size: int = 64, stride: int = 4, rounds: int = 1, rate: float = 0.2,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    narrow = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"), held_out(col(doc_id), folds, fold).alias("held_out"))
    learn = narrow.filter("not held_out").select("text")
    counts = materialize(count_words(learn), "words")
    words, n_docs = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first(), learn.count()
    total, distinct = words.n + n_docs, words.v + (n_docs > 0)
    known = build_lexicon(counts, n_docs, head, n_words, n_groups)
    lexicon, start = spark.sparkContext.broadcast(known), len(known.counts)
    log_all, log_end = float(np.log10(total + distinct + 1)), float(np.log10(n_docs + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, part, nth = lexicon.value, TaskContext.get().partitionId(), 0
        out, heads = len(lex.index), pa.array([w.decode("utf-8", "surrogatepass") for w in lex.index], pa.string())
        ends, of_end = pa.array(list(lex.suffixes), pa.string()), np.array([*lex.suffixes.values(), OTHER], np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.int64()), pa.binary())
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                words, of = split(texts)
                n, sums = len(texts), lambda x, of=of, n=len(texts): np.bincount(of, x, n)
                place = pc.fill_null(pc.index_in(words, value_set=heads), out).to_numpy(zero_copy_only=False)
                sym, beyond = lex.symbol[place], np.flatnonzero(place == out)
                others = words.take(pa.array(beyond))
                sym[beyond] = of_end[pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(others, -SUFFIX), value_set=ends), len(ends)).to_numpy(zero_copy_only=False)]
                logs, room = lex.log_count[place], lex.log_room[sym]
                n_words, n_others = np.bincount(of, minlength=n), np.bincount(of[beyond], minlength=n)
                base = sums(logs) + log_end - (n_words + 1) * log_all
                shared = sums(np.where(room > 0, logs, 0)) - sums(room)  # of words in their groups
                outside, edges, marks = others.to_pylist(), np.cumsum([0, *n_others]).tolist(), np.cumsum([0, *n_words]).tolist()
                tallies = [list(Counter(outside[i:j]).items()) for i, j in zip(edges, edges[1:])]
                codes = [padded(sym[i:j], order, start).tobytes() for i, j in zip(marks, marks[1:])]
                cols = ((part << 40) + nth + np.arange(n), n_words + 1, n_words - n_others + (n_docs > 0), base, shared, tallies, codes)
                nth += n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(2).slice(at, n), *(pa.array(v, k) for v, k in zip(cols, kinds))], names=names)

    names = ["doc_id", "held_out", "row", "n_tokens", "known", "base", "shared", "outside", "symbols"]
    kind = narrow.schema["doc_id"].dataType.simpleString()
    plain = f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, base double"
    encoded = materialize(narrow.mapInArrow(encode, f"{plain}, shared double, outside map<string,bigint>, symbols binary"), "encoded")
    model = fit(encoded.filter("not held_out").select("symbols"), known.counts, order, size, class_size, rounds, stride, rate)
    fitted = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            waiting: list[np.ndarray] = []  # windows of documents whose scores are computed together

            def add_model(found=found, waiting=waiting) -> None:
                first = np.cumsum([0, *map(len, waiting[:-1])])
                found.append(np.add.reduceat(fitted.value.log10_probability(np.concatenate(waiting)), first))
                waiting.clear()

            held = 0
            for text in batch.column(7):
                waiting.append(dealt(np.frombuffer(text.as_buffer(), "<i2"), order, 1, 0))
                held += len(waiting[-1])
                if held >= BLOCK:
                    add_model()
                    held = 0
            if held:
                add_model()
            of_model = np.concatenate([*found, np.zeros(0)]) + batch.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(of_model)], names=[*names[:6], "model"])

    rows = materialize(encoded.drop("outside").mapInArrow(score, f"{plain}, model double"), "scored")
    # Words outside the head: those never seen add nothing, so that an inner join does.
    outside = encoded.select("row", F.explode("outside").alias("word", "tf")).join(counts, "word")
    added = outside.groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return rows.join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
