"""Near-duplicates with DartMinHash signatures and banded joining.

A document is the weighted set of its word shingles (five words; fewer words
make one shingle), a shingle's weight being how often it occurs. Each element
owns the region [0, weight) of a line of its own. Darts are thrown at these
lines by hashing: on every unit of a line they arrive as a Poisson process in
rank, with a hashed place in the unit, and a dart hits if its place is below
the weight. Only ranks below a threshold that yields enough darts for all
coordinates are looked at, so the work is one hash an element and a few hundred
darts a document. Every dart names one of the signature's coordinates; the
earliest dart of a coordinate is its value. Two documents agree in a coordinate
with the probability of their weighted Jaccard similarity. Texts with few
shingles have the first darts of each line drawn at once, so many that more are
wanted about once in 10 ** 14 lines; longer texts draw dart by dart.

Texts with equal words are one node. Bands of the signature put nodes into
buckets, and the nodes of a bucket are joined as follows. All similarities are
exact, on 64-bit hashes of shingles.

1. Every node is compared with one leader: of the leaders of its buckets, the
   one with the greatest degree. A node's degree is the size of all its buckets,
   a bucket's leader its member of greatest degree. An original has more in
   common with its copies than these have with one another, so it leads.
2. Links merge groups. In buckets whose members still stand in several groups,
   this is done once more for members outside their leader's group.
3. What is left is settled without loss. Shingles that members of such buckets
   have in common across groups are ordered from rare to frequent. If two sets
   of sizes n and m are similar, they share a shingle among the first
   n - ceil(threshold n) + 1 of the one and as many of the other, so only nodes
   of different groups that share one of these first shingles are compared,
   and only if enough stands behind it in both sets.

Pairs are as many as nodes in the first two steps. In the third, unlike texts
that share a passage, however many, meet only if their rarest shingles are
shared too. Groups are connected components, contracted after every step: new
links are joined between the groups' roots, and one root a node is kept.

Nulls: a null text, like one without words, is a class of its own for each row;
a null id sorts last. Rows that repeat an id belong to the class of their text.
Extra columns are ignored, and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_parts, col, fresh, materialize, with_fields

#: Words a worker remembers at most.
CACHE_WORDS = 300_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D, with A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], hashes: WordHashes, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w)
    if n == 0:
        return w, np.zeros(0, np.int64)
    if n < size:
        h = np.zeros(1, np.uint64)
        for x in w:
            h = mix(h * _G + x)
        return h, np.ones(1, np.int64)
    h, odd = np.zeros(n - size + 1, np.uint64), mix(np.arange(1, size + 1, dtype=np.uint64) * _G) | np.uint64(1)
    for i in range(size):
        h += w[i : n - size + 1 + i] * odd[i]
    return np.unique(mix(h), return_counts=True)


def _arrivals(cells: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """Hash of each cell's dart of that number."""
    return mix(cells + _G * (np.atleast_1d(np.asarray(number, np.uint64)) + np.uint64(1)))


def _gaps(h: np.ndarray) -> np.ndarray:
    return -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def darts(elements: np.ndarray, weights: np.ndarray, below: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ranks of all darts that hit, of rank below a limit."""
    units = np.maximum(np.ceil(weights), 1).astype(np.int64)
    if len(units) and units.max() > 1:
        owner = np.repeat(np.arange(len(units)), units)
        unit = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
        cells, room = mix(elements[owner] + unit.astype(np.uint64) * _B), weights[owner] - unit
    else:
        cells, room = mix(elements), np.asarray(weights, np.float64)
    found_h, found_t = [], []
    part = bool(len(room)) and room.min() < 1  # elements that don't fill their last unit

    def take(h: np.ndarray, t: np.ndarray, r: np.ndarray) -> None:
        hit = (mix(h ^ _B) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < r if part else slice(None)
        found_h.append(h[hit])
        found_t.append(t[hit])

    if len(cells) < 64:
        m = int(below + 8 * below**0.5 + 20)
        h = _arrivals(cells[:, None], np.arange(m)[None, :])
        t = np.cumsum(_gaps(h), axis=1)
        early = t < below
        take(h[early], t[early], np.broadcast_to(np.asarray(room, np.float64)[:, None], t.shape)[early])
    else:
        h = _arrivals(cells, 0)
        # most cells have no dart this early; the bound on the hash is a little generous
        near = np.flatnonzero(h > np.uint64(min(max(np.exp(-below) * 2.0**64 - 2.0**14, 0), 2.0**64 - 2.0**20)))
        cells, room, h, t, j = cells[near], room[near], h[near], _gaps(h[near]), 0
        while True:
            early = t < below
            cells, room, h, t = cells[early], room[early], h[early], t[early]
            if not len(cells):
                break
            take(h, t, room)
            j += 1
            h = _arrivals(cells, j)
            t = t + _gaps(h)
    return np.concatenate(found_h), np.concatenate(found_t)


def signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The earliest dart of each of ``size`` coordinates."""
    below = size * (np.log(size) + 2) / float(np.sum(weights))
    while True:
        h, t = darts(elements, weights, below)
        late_first = np.argsort(t)[::-1]
        best = np.full(size, -1)
        best[(mix(h ^ _A) % np.uint64(size)).astype(np.int64)[late_first]] = late_first  # the earliest is written last
        if best.min() >= 0:
            return h[best]
        below *= 2


def band_coordinates(size: int, bands: int, rows: int) -> np.ndarray:
    """Which coordinates make up each band: slices of fixed permutations, so that all are used about equally often."""
    rng = np.random.default_rng(11)
    each = size // rows
    order = [rng.permutation(size)[: each * rows].reshape(each, rows) for _ in range(-(-bands // each))]
    return np.concatenate(order)[:bands]


def band_hashes(sig: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    out = np.arange(1, len(coordinates) + 1, dtype=np.uint64) * _G
    for r in range(coordinates.shape[1]):
        out = mix(out * _A + sig[coordinates[:, r]])
    return out.view(np.int64)


def with_signatures(docs: DataFrame, text: str, coordinates: int, bands: int, rows: int, size: int) -> tuple[DataFrame, str, str, str]:
    """``docs`` with a key of its words (null if there are none), the number of its shingles and its bands; their names."""
    key, number, band = fresh(docs, "words_key"), fresh(docs, "n_shingles"), fresh(docs, "bands")
    at, n = docs.columns.index(text), len(docs.columns)
    schema = with_fields(docs.schema, (key, T.BinaryType()), (number, T.LongType()), (band, T.ArrayType(T.LongType())))

    places = band_coordinates(coordinates, bands, rows)

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        hashes = WordHashes()

        def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sizes, found = [], [], []
            for t in batch.column(at).to_pylist():
                words = words_of(t or "")
                elements, weights = shingles(words, hashes, size)
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                sizes.append(int(weights.sum()))
                found.append(band_hashes(signature(elements, weights, coordinates), places) if words else [])
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=schema.names)

        return sign

    return docs.mapInArrow(by_parts("near_dup", start), schema), key, number, band


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """node, text -> node, elements: each shingle as a 64-bit number, one for each time it occurs, sorted."""

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        hashes = WordHashes()

        def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in batch.column(1).to_pylist():
                h, n = shingles(words_of(t), hashes, size)
                if n.max(initial=1) > 1:
                    owner = np.repeat(np.arange(len(n)), n)
                    h = mix(h[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64) * _B)
                out.append(np.sort(h.astype("<u8")).tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "elements"])

        return sets

    return texts.mapInArrow(by_parts("near_dup", start), "node long, elements binary")


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Of two multisets of occurrences (see ``shingle_sets``)."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b).

    Each round takes the least label among a node and its neighbours, and from the third round on that
    label's own label, which halves long chains.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), F.col("a").alias("old"), "root"), label)
    turn = 1
    while not labels.filter("old <> root").isEmpty():
        turn += 1
        known = labels.select("node", "root")
        near = both.join(known, both.b == known.node).select(F.col("a").alias("node"), F.lit(None).cast("long").alias("old"), "root")
        new = near.unionByName(labels.select("node", F.col("root").alias("old"), "root")).groupBy("node").agg(F.max("old").alias("old"), F.min("root").alias("root"))
        if turn > 2:
            jump = known.select(F.col("node").alias("root"), F.col("root").alias("up"))
            new = new.join(jump, "root", "left").select("node", "old", F.least("root", "up").alias("root"))
        labels = materialize(new, label)
    return labels.select("node", "root")


def merge_groups(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root after new links (a, b): links between roots are joined, and each node keeps one root. Single nodes have no row."""
    if groups is None:
        return components(links)
    a, b = (groups.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in ("a", "b"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    raised = components(ends.filter("a <> b").distinct())
    old = groups.join(raised.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    # Nodes that had no link before, and roots, which have a row of their own already.
    new = raised.join(groups.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new.select("node", "root")), "groups")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, coordinates: int = 400, bands: int = 50, rows: int = 8, size: int = 5) -> DataFrame:
    """doc_id, class_id, text_hash, kept of every row: class_id is the least doc_id of its class, kept marks one document of each class."""
    narrow = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    signed, key, number, band = with_signatures(narrow, "text", coordinates, bands, rows, size)
    signed = materialize(signed.select("doc_id", text_hash("text").alias("text_hash"), F.col(key).alias("key"), F.col(number).alias("n"), F.col(band).alias("bands")), "signatures")
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    nodes = signed.filter("key is not null").groupBy("key").agg(F.min(name).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("node", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialize(entries.join(shared, "bucket"), "buckets")
    groups = _groups(members, _sets(narrow, nodes, members, size), threshold)
    named = nodes.select("key", "node", "least")
    if groups is None:
        named = named.withColumn("root", F.col("node"))
    else:
        named = named.join(groups.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("least").alias("first"))
    by_key = named.join(classes, "root").select("key", "first")
    alone = F.col("key").isNull()
    return signed.drop("bands", "n").join(by_key, "key", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("class_id"),
        "text_hash",
        (alone | (name == F.col("first"))).alias("kept"),
    )


def text_hash(text: str) -> Column:
    return F.xxhash64(col(text).cast("string"))


def _sets(narrow: DataFrame, nodes: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """node, elements of the nodes that share a bucket. A node's text is that of its least row, found by id and hash."""
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("least.id").alias("id"), F.col("least.h").alias("h"))
    texts = narrow.withColumn("text_hash", text_hash("text"))
    found = texts.join(wanted, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("node").agg(F.first("text").alias("text"))
    return materialize(shingle_sets(found, size), "shingles")


def _groups(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """node, root: components of the similar pairs among the members (bucket, node, n, size) of a bucket; None if there are none."""

    def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        return batch.select([0, 1]).filter(pa.array([weighted_jaccard(x, y) >= threshold - 1e-9 for x, y in zip(a, b)], pa.bool_()))

    left, right = (sets.select(F.col("node").alias(k), F.col("elements").alias(f"{k}_set")) for k in ("a", "b"))

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar."""
        met = pairs.join(right, "b").join(left, "a").select("a", "b", "a_set", "b_set")
        return materialize(met.mapInArrow(by_parts("near_dup", lambda: similar), "a long, b long"), "links")

    weight = members.groupBy("node").agg(F.sum("size").alias("degree"))
    # Equal degrees are told apart by a hash, so that one number orders the nodes.
    weighed = materialize(members.join(weight, "node").select("bucket", "node", "n", (F.col("degree") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))).alias("weight")), "members")
    groups, compared = None, None
    for _ in range(2):
        known = weighed.withColumn("root", F.col("node")) if groups is None else _mixed(weighed, groups)
        if groups is not None:
            known = materialize(known, "mixed")
        pairs = materialize(_leader_pairs(known, threshold, compared), "pairs")
        compared = pairs if compared is None else compared.unionByName(pairs)
        new = links(pairs)
        if new.isEmpty():
            if groups is None:
                groups = members.sparkSession.createDataFrame([], "node long, root long")
            break
        groups = merge_groups(groups, new)
    rest = materialize(_mixed(weighed, groups).select("node", "root", "n").distinct(), "rest")
    if rest.isEmpty():
        return groups
    pairs = materialize(_prefix_pairs(rest, sets, threshold).join(compared, ["a", "b"], "left_anti"), "pairs")
    new = links(pairs)
    return groups if new.isEmpty() else merge_groups(groups, new)


def _mixed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of buckets with several groups, with their roots."""
    known = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
    return known.join(mixed, "bucket")


def _similar_sizes(n: Column, m: Column, threshold: float) -> Column:
    return F.least(n, m) >= threshold * F.greatest(n, m) - 1e-6


def _leader_pairs(members: DataFrame, threshold: float, compared: DataFrame | None) -> DataFrame:
    """a < b: each member with one of its buckets' leaders, that of greatest weight, if that one is of another group and wasn't met before."""
    top = lambda c: F.max_by(c, "weight")
    leaders = members.groupBy("bucket").agg(top("node").alias("leader"), top("root").alias("leader_root"), top("n").alias("leader_n"), F.max("weight").alias("leader_weight"))
    met = members.join(leaders, "bucket").filter((F.col("root") != F.col("leader_root")) & _similar_sizes(F.col("n"), F.col("leader_n"), threshold))
    met = met.select("node", "leader", "leader_weight", F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    if compared is not None:
        met = met.join(compared, ["a", "b"], "left_anti")
    best = met.groupBy("node").agg(F.max_by("leader", "leader_weight").alias("leader"))
    return best.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _prefix_pairs(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a < b: nodes of different groups that share one of their rarest shingles (see the module's text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [np.frombuffer(e, "<i8") for e in part.column(1).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *(part.column(i).take(owner) for i in (0, 2, 3))], names=["h", "node", "root", "n"])

    rows = materialize(sets.join(rest, "node").select("node", "elements", "root", "n").mapInArrow(each, "h long, node long, root long, n int"), "occurrences")
    # A shingle of one group only can't be shared across groups: it stands before all others and needs no row.
    # Written, so that a frequent shingle's rows can be split in the join.
    across = materialize(rows.groupBy("h").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("h", "c"), "across")
    known = rows.join(across, "h").groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "h"))).alias("common"))
    # Places in the order: shingles shared with nobody stand first. The small number keeps exact products whole.
    alone = F.col("n") - F.size("common")
    first = F.col("n") - F.ceil(threshold * F.col("n") - 1e-6) + 1 - alone
    heads = known.filter(first > 0).select("node", "root", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), first.cast("int"))["h"]).alias("i", "h"))
    heads = materialize(heads.select("h", "node", "root", "n", (F.col("alone") + F.col("i") + 1).alias("place")), "first")
    # Of two nodes in different groups one at least is outside the largest group that has the shingle.
    largest = heads.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("root", "c").alias("largest"))
    outside = heads.join(largest, "h").filter(F.col("root") != F.col("largest")).select("h", *(F.col(c).alias(f"x_{c}") for c in ("node", "root", "n", "place")))
    # If this is the first shingle that two sets share, they have it and what stands behind it in both in common at most.
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("x_n") - F.col("x_place"))
    enough = most >= threshold / (1 + threshold) * (F.col("n") + F.col("x_n")) - 1e-6
    met = heads.join(outside, "h").filter((F.col("root") != F.col("x_root")) & enough)
    return met.select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, that with the least id, with the columns it had.

    Rows that repeat an id and a text are one document, of which one row stays: that with the least hash of all its columns.
    """
    i, k, h = fresh(docs, "keep_id"), fresh(docs, "keep_hash"), fresh(docs, "text_hash")
    kept = materialize(near_duplicate_classes(docs, doc_id, text, **options).filter("kept").select(F.col("doc_id").alias(i), F.col("text_hash").alias(k)), "kept")
    out = docs.withColumn(h, text_hash(text))
    out = out.join(kept.distinct(), col(doc_id).eqNullSafe(F.col(i)) & F.col(h).eqNullSafe(F.col(k)), "left_semi")
    if not kept.groupBy(i, k).count().filter("count > 1").isEmpty():
        row, low = fresh(out, "row_hash"), fresh(out, "least_hash")
        out = out.withColumn(row, F.xxhash64(F.to_json(F.struct(*map(col, docs.columns)))))
        least = out.groupBy(col(doc_id).alias(i), F.col(h).alias(k)).agg(F.min(row).alias(low))
        out = out.join(least, col(doc_id).eqNullSafe(F.col(i)) & F.col(h).eqNullSafe(F.col(k)) & (F.col(row) == F.col(low)), "left_semi")
        out = out.dropDuplicates([doc_id, h])
    return out.select(*map(col, docs.columns))
