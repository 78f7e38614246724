"""Tokenising documents and packing them by vector best-fit.

A document is its token ids and one end id. Documents over the capacity are cut
into pieces of exactly the capacity, and the last piece may be shorter. Pieces
go into sequences with three residual capacities: tokens, documents (pieces)
and attention cost (the sum of squared lengths). Pieces are taken from the
longest down; each goes to the open sequence, among those that hold it under
every constraint, that has the least weighted residual norm once it is in
("norm"), or the greatest weighted dot product of residual and demand ("dot").
If none holds it, a sequence is opened.

All pieces of a length are alike, so the choice is made on counts: the driver
sees one count per length (``capacity`` at most, whatever the corpus) and keeps
sequences with equal contents as one pattern with a count. Pieces then find
their places by their number within their length. That number is the piece's
place in its partition plus the count of that length in earlier partitions, so
no length, however common, meets in one task.

Nulls: a null text is empty (the end id alone), null ids are kept. Repeated rows
are packed as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, filterfalse, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, kept, materialize

#: Words, and words without case and closing stop, that a worker remembers at most; the longest of them;
#: characters of text whose unknown words are looked for together; texts taken from a batch, and words encoded, at once.
CACHE_WORDS, CACHE_CORES, CACHE_CHARS, GROUP_CHARS = 400_000, 400_000, 48, 1_000_000
TEXTS, WORDS = 512, 2048


class Words(dict[str, bytes]):
    """Ids of the remembered words; those of others come from ``more``."""

    more: dict[str, bytes]

    def __missing__(self, word: str) -> bytes:
        return self.more[word]


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, word by word.

    The tokenizer drops white space before it splits, and none of its rules reach across it, so the ids
    of a text are those of its words in turn. Only spaces, tabs and line feeds are split at here. The
    tokenizer also ignores case, and splits letters from other signs: a word of Latin letters with a full
    stop or comma after it has the ids of the lower-case letters and those of the sign. Words that are
    remembered first stay: frequent ones come early.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words({"": b""})
        self.cores: dict[str, bytes] = self.plain([".", ","])

    def plain(self, words: list[str]) -> dict[str, bytes]:
        parts = (words[i : i + WORDS] for i in range(0, len(words), WORDS))  # an encoding is many times larger than its ids
        return {w: array("I", e.ids).tobytes() for part in parts for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))}

    @staticmethod
    def split(word: str) -> tuple[str, str]:
        """The part that is looked up, and the sign after it."""
        sign = word[-1] if word[-1] in ".," else ""
        core = word[:-1] if sign else word
        return (core.lower(), sign) if core.isalpha() and max(core) < "\u0100" else (word, "")

    def add(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of unknown words; those for which there is room are remembered."""
        parts = {w: self.split(w) for w in missing}
        new = self.plain(list({c for c, _ in parts.values() if c not in self.cores}))
        room = CACHE_CORES - len(self.cores)
        if room > 0:
            self.cores.update((c, i) for c, i in islice(new.items(), room) if len(c) <= CACHE_CHARS)
        got = {w: (new[c] if c in new else self.cores[c]) + (self.cores[s] if s else b"") for w, (c, s) in parts.items()}
        room = CACHE_WORDS - len(self.words)
        if room > 0:
            self.words.update((w, i) for w, i in islice(got.items(), room) if len(w) <= CACHE_CHARS)
        return got

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and (not group or chars < GROUP_CHARS):
                t = texts[at] or ""
                group.append(t.replace("\n", " ").replace("\t", " ").split(" "))
                chars += len(t)
                at += 1
            missing: set[str] = set()
            for words in group:
                missing.update(filterfalse(self.words.__contains__, words))
            self.words.more = self.add(missing) if missing else {}
            found = [b"".join(map(self.words.__getitem__, words)) for words in group]
            self.words.more = {}
            yield from found


def encoder(path: str) -> Encoder:
    encoders = kept("packing")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids_crc32, part, nth (of this length in this partition), ids if asked for."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, end = encoder(tokenizer), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        counts = [0] * (capacity + 1)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            texts = (batch.column(1).slice(i, TEXTS).to_pylist() for i in range(0, batch.num_rows, TEXTS))
            for d, ids in zip(batch.column(0).to_pylist(), chain.from_iterable(map(enc.encode, texts))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    for values, v in zip(rows, (d, k, at // 4, n, zlib.crc32(cut), counts[n])):
                        values.append(v)
                    if with_ids:
                        rows[6].append(cut)
                    counts[n] += 1
            arrays = [pa.array(rows[i], pa.int64() if i != 1 else pa.int32()) for i in range(6)]
            arrays.insert(5, pa.array([part] * len(rows[0]), pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(rows[6], pa.binary())] * with_ids, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text")).mapInArrow(pieces, schema)


def plan_patterns(counts: dict[int, int], capacity: int, max_docs: int, max_attention: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.1, 0.1)) -> list[tuple[tuple[int, ...], int]]:
    """Vector best-fit decreasing over counts by length: (lengths of a sequence, how many such sequences)."""
    caps = np.array([capacity, max_docs, max_attention], np.float64)
    w = np.array(weights)
    size, used = 1024, 0
    residual, number, contents = np.zeros((size, 3)), np.zeros(size, np.int64), [()] * size

    def put(res: np.ndarray, n: int, lengths: tuple[int, ...]) -> None:
        nonlocal size, residual, number, contents, used
        if used == size:  # drop what is empty, then grow
            live = np.flatnonzero(number > 0)
            size = max(1024, 2 * len(live))
            residual, number = np.vstack([residual[live], np.zeros((size - len(live), 3))]), np.concatenate([number[live], np.zeros(size - len(live), np.int64)])
            contents, used = [contents[i] for i in live] + [()] * (size - len(live)), len(live)
        residual[used], number[used], contents[used] = res, n, lengths
        used += 1

    for length in sorted(counts, reverse=True):
        left, demand = counts[length], np.array([length, 1, length * length], np.float64)
        if length > capacity or length**2 > max_attention or max_docs < 1:
            raise ValueError(f"no sequence holds a piece of {length} tokens")
        while left:
            after = residual[:used] - demand
            fits = (number[:used] > 0) & (after.min(axis=1, initial=np.inf) >= 0)
            if fits.any():
                if rule == "norm":
                    score = -((after / caps) ** 2 @ w)
                else:
                    score = (residual[:used] / caps) @ (w * demand / caps)
                best = int(np.argmax(np.where(fits, score, -np.inf)))
                res, n, lengths = residual[best].copy(), int(number[best]), contents[best]
            else:
                best, res, n, lengths = -1, caps, left, ()
            fit = int((res // demand).min()) if rule == "norm" or best < 0 else 1
            each = min(fit, left)
            bins = min(n, left // each)
            if best >= 0:
                number[best] -= bins
            put(res - each * demand, bins, lengths + (length,) * each)
            left -= bins * each
    return [(contents[i], int(number[i])) for i in range(used) if number[i]]


def pack(pieces: DataFrame, capacity: int = 2048, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.1, 0.1)) -> DataFrame:
    """Adds sequence_id and offset to the pieces of a written table (see ``tokenize``)."""
    by_part = pieces.groupBy("part", "length").count()
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # `capacity` rows at most
    patterns = plan_patterns(counts, capacity, max_docs or capacity, max_attention or capacity**2, rule, weights)
    # For each length the slots that patterns offer, in order: slot s of a pattern is in sequence base + s // copies.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    base, seen = 0, dict.fromkeys(counts, 0)
    for lengths, n in patterns:
        at = 0
        for length in dict.fromkeys(lengths):
            copies = lengths.count(length)
            slots.setdefault(length, []).append((seen[length], base, copies, at))
            seen[length] += copies * n
            at += copies * length
        base += n
    table = {k: np.array(v, np.int64) for k, v in slots.items()}
    earlier = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = by_part.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        lengths, at = length.to_numpy(), nth.to_numpy()
        seq, off = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            have = table[int(n)]
            i = np.searchsorted(have[:, 0], at[rows], "right") - 1
            s = at[rows] - have[i, 0]
            seq[rows] = have[i, 1] + s // have[i, 2]
            off[rows] = have[i, 3] + s % have[i, 2] * n
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = pieces.join(before, ["part", "length"]).withColumn("place", place("length", F.col("before") + F.col("nth")))
    return out.drop("part", "nth", "before").select("*", "place.*").drop("place")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    pieces = materialize(tokenize(docs, tokenizer, capacity, end_id, with_ids=with_ids), "pieces")
    out = pack(pieces, capacity, **options)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
