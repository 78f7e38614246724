"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte by byte: A to Z become lower case, every other ASCII
character that is no letter or digit becomes a space. Bytes keep their places,
so a hit's offsets hold in the original. A window is ``window`` consecutive
words of an item; an item with fewer words (but not none) is one window. All
windows go into one automaton, which reads each document once. A document word
inside any occurrence of a window is hit.

The windows are sent to the executors. Their size is checked first: a benchmark
of over ``max_block_chars`` characters is dealt into blocks below that size,
which are scanned one after another, with a written table between them.

Nulls: a null text has no words; an item with a null id or text is ignored.
Repeated rows give a row each. Extra columns are kept by ``decontaminate`` and
ignored by ``find_leaks``. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_parts, col, fresh, materialize, with_fields

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def normalise(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def windows_of(text: str, size: int) -> set[bytes]:
    """The windows of an item, each with a space before and after every word."""
    words = normalise(text).split()
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))}


class Scanner:
    def __init__(self, items: list[tuple[int, str]], window: int):
        owners: dict[bytes, list[int]] = {}
        for item, text in items:
            for w in windows_of(text, window):
                owners.setdefault(w, []).append(item)
        self.automaton = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.automaton.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, tuple(ids)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
        """Number of words, merged runs of hit words [first, last + 1), ids of items found."""
        if text is None:
            return 0, [], []
        words = normalise(text).split()
        if self.empty or not words:
            return len(words), [], []
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        after = np.searchsorted(spaces, [end for end, _ in found])  # the closing space's number is the number of words before it
        runs: list[tuple[int, int]] = []
        for a, b in sorted((int(e) - n, int(e)) for e, (_, (_, n, _)) in zip(after, found)):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
        return len(words), runs, sorted({i for _, (_, _, ids) in found for i in ids})


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as character offsets of the original text, end exclusive."""
    raw = normalise(text)
    inside = np.frombuffer(b" " + raw + b" ", np.uint8) != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    # Characters before each byte: bytes that don't go on with a character.
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)])
    return [(int(before[starts[a]]), int(before[ends[b - 1]])) for a, b in runs]


def _blocks(benchmark: DataFrame, item_id: str, text: str, max_block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about ``max_block_chars`` at most."""
    items = benchmark.select(col(item_id).cast("long").alias("i"), col(text).cast("string").alias("t")).filter("i is not null and t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // max_block_chars) * 2 if total > max_block_chars else 1
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, r.t) for r in part.collect()]


def scan_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_block_chars: int = 8_000_000) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns for the number of words, the runs of hit words, the items, and the runs as offsets of the text; and their names."""
    names = {k: fresh(docs, f"leak_{k}") for k in ("words", "runs", "items", "chars")}
    out, n_before = docs, len(docs.columns)
    at = docs.columns.index(text)
    schema = with_fields(docs.schema, (names["words"], T.LongType()), (names["runs"], HITS), (names["items"], T.ArrayType(T.LongType())), (names["chars"], HITS))
    spark = docs.sparkSession
    for block, items in enumerate(_blocks(benchmark, item_id, item_text, max_block_chars)):
        sent = spark.sparkContext.broadcast(items)

        def start(sent=sent, later=block > 0) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            scanner = Scanner(sent.value, window)

            def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
                n_words, runs, found, chars = [], [], [], []
                old = zip(batch.column(n_before + 1).to_pylist(), batch.column(n_before + 2).to_pylist()) if later else None
                for t in batch.column(at).to_pylist():
                    n, r, f = scanner.scan(t)
                    if later:
                        r0, f0 = next(old)
                        r, f = merge([(x["start"], x["end"]) for x in r0], r), sorted({*f0, *f})
                    n_words.append(n)
                    runs.append([{"start": a, "end": b} for a, b in r])
                    chars.append([{"start": a, "end": b} for a, b in char_spans(t, r)] if r else [])
                    found.append(f)
                cols = [batch.column(i) for i in range(n_before)]
                return pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(runs, _RUNS), pa.array(found, pa.list_(pa.int64())), pa.array(chars, _RUNS)], names=schema.names)

            return scan

        out = (materialize(out, "leaks") if block else out).mapInArrow(by_parts("decontaminate", start), schema)
    return out, names


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (words), char_spans (of the original text), item_ids."""
    narrow = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    out, names = scan_leaks(narrow, benchmark, **options)
    runs, items = F.col(names["runs"]), F.col(names["items"])
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    joined = F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id",
        F.col(names["words"]).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.size(runs) > 0).alias("contaminated"),
        runs.alias("spans"),
        F.col(names["chars"]).alias("char_spans"),
        items.alias("item_ids"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a hit word, with the columns they had."""
    out, names = scan_leaks(docs, benchmark, text=text, **options)
    return out.filter(F.size(names["runs"]) == 0).select(*map(col, docs.columns))


def items_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
