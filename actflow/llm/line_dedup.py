"""Line deduplication by a suffix array over line-ID sequences, in DataFrame functions only.

A document is the sequence of its lines that have a word; a line's ID is a
128-bit hash. Suffixes are ranked by prefix doubling: ranks by the first line,
then by 2, 4, 8, ... lines, each from two ranks of the step before. Ranks are
given by a distributed sort of the distinct pairs, so they are in suffix order.
Suffixes whose prefix occurs once leave the race at every step.

A repeated run counts from ``min_words`` words on, and a line has a word at
least, so prefixes of ``min_words`` lines are deep enough. At that depth the
suffixes that share their first lines with ``min_words`` words or more are an
interval of the suffix array whose longest common prefix has as many. Prefix
lengths of neighbours aren't computed: an interval is named by its common ranks,
and its members are grouped by that name, which needs no ordered pass. The
interval's first member in (doc_id, line) order is the original; the lines of
later members that the run covers are deleted. A run's last lines are covered by
the same rule for runs that end at a line. Together these cover exactly the
maximal runs: a line goes if and only if it is in a run of at least
``min_words`` words with an earlier occurrence that it does not overlap.

Such a prefix of m lines is named by two ranks, those of its first and its last
2 ** k lines, the greatest power of two within m.

Nulls: a null text stays null; null ids sort first. Rows that repeat an id and a
text are one document: they lose the same lines. Lines without words are deleted
inside a deleted run and otherwise kept. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, col, fresh, materialize

DOC = ["d", "th"]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit("text"), text)


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d, th, ord (among lines with words), pos (among all lines), h1, h2, nw of every line with a word."""
    t = col(text).cast("string")
    all_lines = F.transform(F.split(t, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    worded = F.filter(all_lines, lambda s: s["line"].rlike(f"[^{SPACE}]"))
    rows = docs.select(col(doc_id).alias("d"), text_hash(t).alias("th"), F.posexplode(worded).alias("ord", "s"))
    line = F.col("s.line")
    return rows.select(
        "d", "th", "ord", F.col("s.pos").alias("pos"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"), F.regexp_count(line, F.lit(WORD)).alias("nw")
    )


def repeated_islands(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines found twice or more, in stretches (isl) of at least ``min_words`` words, with the words before them (before) in the stretch."""
    # Written, so that a very common line's rows can be split in the join.
    repeated = materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "repeated-lines")
    # One row for each line of documents that are repeated rows.
    found = lines.join(repeated, ["h1", "h2"]).dropDuplicates([*DOC, "ord"])
    doc = Window.partitionBy(*DOC).orderBy("ord")
    found = found.withColumn("isl", F.col("ord") - F.row_number().over(doc))
    island = Window.partitionBy(*DOC, "isl").orderBy("ord")
    found = found.withColumn("upto", F.sum("nw").over(island)).withColumn("words", F.sum("nw").over(Window.partitionBy(*DOC, "isl")))
    return found.filter(F.col("words") >= min_words).withColumn("before", F.col("upto") - F.col("nw"))


def rank_pairs(rows: DataFrame, r1: str, r2: str) -> DataFrame:
    """The pairs that occur twice or more, ranked in their order: r1, r2, r."""
    pairs = rows.groupBy(r1, r2).agg(F.count("*").alias("n")).filter("n > 1").select(r1, r2)
    return pairs.orderBy(r1, r2).withColumn("r", F.monotonically_increasing_id())


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """d, th, isl, ord, k, r: the rank of the 2 ** k lines from a line on, where these occur elsewhere too."""
    step = materialize(lines.join(rank_pairs(lines, "h1", "h2"), ["h1", "h2"]).select(*DOC, "isl", "ord", F.lit(0).alias("k"), "r"), "ranks")
    out, k = step, 0
    while 2 ** (k + 1) <= depth:
        gap = 2**k
        ahead = Window.partitionBy(*DOC, "isl").orderBy("ord").rangeBetween(gap, gap)
        pairs = step.withColumnRenamed("r", "r1").withColumn("r2", F.max("r1").over(ahead)).filter("r2 is not null")
        k += 1
        step = materialize(pairs.join(rank_pairs(pairs, "r1", "r2"), ["r1", "r2"]).select(*DOC, "isl", "ord", F.lit(k).alias("k"), "r"), "ranks")
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out


def short_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of ``min_words`` words or more that start, or that end, at each line: d, th, isl, a, b (ord)."""
    part = Window.partitionBy(*DOC, "isl")
    # A run from line i ends before the first line j with before[j] >= before[i] + min_words, or with its stretch.
    after = F.min("ord").over(part.orderBy(F.col("before").desc()).rangeBetween(Window.unboundedPreceding, -min_words))
    end = F.when(after.isNotNull(), after - 1).when(F.col("words") - F.col("before") >= min_words, F.max("ord").over(part))
    # A run to line j starts after the last line i with upto[i] <= upto[j] - min_words, or with its stretch.
    until = F.max("ord").over(part.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    start = F.when(until.isNotNull(), until + 1).when(F.col("upto") >= min_words, F.min("ord").over(part))
    found = lines.select(*DOC, "isl", "ord", end.alias("end"), start.alias("start"))
    both = F.array(F.struct(F.col("ord").alias("a"), F.col("end").alias("b")), F.struct(F.col("start").alias("a"), F.col("ord").alias("b")))
    return found.select(*DOC, "isl", F.inline(both)).filter("a is not null and b is not null").distinct()


def deleted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """d, th, first, last: the line numbers (from 0, all lines count) between which a document's lines are deleted; runs may overlap."""
    lines = materialize(repeated_islands(materialize(line_table(docs, doc_id, text), "lines"), min_words), "repeated")
    ranks = suffix_ranks(lines, min_words)
    runs = short_runs(lines, min_words).withColumn("m", F.col("b") - F.col("a") + 1)
    runs = runs.withColumn("k", F.floor(F.log2(F.col("m") + 0.5)).cast("int")).withColumn("a2", (F.col("b") + 1 - F.pow(F.lit(2), F.col("k"))).cast("int"))
    head = ranks.select(*DOC, "k", F.col("ord").alias("a"), F.col("r").alias("ra"))
    tail = ranks.select(*DOC, "k", F.col("ord").alias("a2"), F.col("r").alias("rb"))

    def join(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        y = y.select(*(F.col(c).alias(f"{c}_") if c in keys else F.col(c) for c in y.columns))
        return x.join(y, [x[c].eqNullSafe(y[f"{c}_"]) for c in keys]).drop(*(f"{c}_" for c in keys))

    named = materialize(join(join(runs, head, [*DOC, "k", "a"]), tail, [*DOC, "k", "a2"]).select(*DOC, "a", "b", "m", "ra", "rb"), "runs")
    # Written, so that the members of a very common run can be split in the join.
    first = materialize(named.groupBy("m", "ra", "rb").agg(F.min(F.struct("d", "th", "a")).alias("f"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first-runs")
    elsewhere = ~(F.col("d").eqNullSafe(F.col("f.d")) & (F.col("th") == F.col("f.th")))
    later = named.join(first, ["m", "ra", "rb"]).filter(elsewhere | (F.col("a") >= F.col("f.a") + F.col("m")))
    place = lines.select(*DOC, F.col("ord"), F.col("pos"))
    out = join(later.select(*DOC, "a", "b"), place.select(*DOC, F.col("ord").alias("a"), F.col("pos").alias("first")), [*DOC, "a"])
    return join(out, place.select(*DOC, F.col("ord").alias("b"), F.col("pos").alias("last")), [*DOC, "b"]).select(*DOC, "first", "last")


def kept_ranges(deleted: DataFrame) -> DataFrame:
    """d, th, kept: what is left between the deleted runs, as (start, length) with lines from 1; a length of -1 goes to the end."""
    order = Window.partitionBy(*DOC).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # A gap of one line or more before a run: it ends at the run, and starts after all runs before.
    gaps = deleted.withColumn("from", F.coalesce(reach, F.lit(-1)) + 1)
    gap = F.when(F.col("first") > F.col("from"), F.struct((F.col("from") + 1).alias("s"), (F.col("first") - F.col("from")).alias("n")))
    return gaps.groupBy(*DOC).agg(F.sort_array(F.collect_list(gap)).alias("gaps"), F.max("last").alias("end")).select(
        *DOC, F.col("gaps"), (F.col("end") + 2).alias("rest")
    )


def dedupe_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, n_chars: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with later copies of repeated runs taken out of the text, and the name of a column with the number of deleted lines.

    ``n_chars`` names a column to be set to the length of the new text.
    """
    names = {}
    for k in ("run_doc", "run_hash", "run_gaps", "run_rest", "text_hash", "text_parts", "n_deleted"):
        names[k] = fresh(docs, k)
    d, th, gaps, rest_at, h, parts_at, n = names.values()
    left = kept_ranges(deleted_runs(docs, doc_id, text, min_words))
    left = left.select(F.col("d").alias(d), F.col("th").alias(th), F.col("gaps").alias(gaps), F.col("rest").alias(rest_at))
    out = docs.withColumn(h, text_hash(col(text).cast("string")))
    out = out.join(left, col(doc_id).eqNullSafe(F.col(d)) & (F.col(h) == F.col(th)), "left")
    lines = F.split(col(text), "\n")
    rest = F.col(rest_at)
    tail = F.when(rest <= F.size(lines), F.slice(lines, rest, F.size(lines))).otherwise(F.array().cast("array<string>"))
    # slices are put together in order; nothing is looked up line by line
    parts = F.concat(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["s"], g["n"]))), tail)
    touched = rest.isNotNull()
    out = out.withColumn(parts_at, F.when(touched, parts)).withColumn(n, F.when(touched, F.size(lines) - F.size(parts_at)).otherwise(F.lit(0)))
    new = F.when(touched, F.array_join(parts_at, "\n")).otherwise(col(text))
    shown = [new.alias(c) if c == text else F.when(touched, F.length(new)).otherwise(col(c)).cast(docs.schema[c].dataType).alias(c) if c == n_chars else col(c) for c in docs.columns]
    return out.select(*shown, n), n
