"""Personal data, and terms that disclose it, in DataFrame functions only.

Base spans are matched by pattern, leftmost and non-overlapping for each kind,
and checked (parts of addresses, check digits, numbers of digits). A failing
match is dropped without another try.

Information-theoretic sanitisation adds spans. The entity protected is the value
of a base span, a term a run of letters and digits, lower-cased. A term in one
of the ``reach`` words of the text on either side of a mention (other matches
included) may disclose the entity: with N documents, n(e) that hold the entity,
n(t) that hold the term and n(e, t) that hold the term near the entity, the
pointwise mutual information log(N n(e, t) / (n(e) n(t))) is how much the term
tells of the entity, out of the entity's own information log(N / n(e)).

A term discloses the entity if that share reaches ``threshold``, and if they
meet more often than by chance: by Chernoff's bound, the chance that so many
different texts (k) have them together, where n(e) n(t) / N are expected, is
exp(-(k log(k / expected) - k + expected)) at most, which, times the number of
pairs that are tested, must not exceed ``alpha``. So a single sighting tells
nothing in a large corpus, and two or three do. ``support`` is a least number of
different texts besides; copies of a text are one sighting.

Disclosing terms are spans of kind "term" wherever they stand, in all documents,
unless they are part of a base span. ``sanitise`` generalises base spans to
their kind and removes such terms.

Counts cover all documents and whole texts, repeated rows included. Terms are
counted by 64-bit hashes. Of a run that a span is a part of, what stands outside
the span is a term near it.

Nulls: a null text is empty, a null id is kept. Rows that repeat an id and a
text have the same spans. Extra columns are ignored by ``find_spans`` and kept
by ``sanitise``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, fresh, materialize

#: Kinds in order. Patterns: where a class of characters runs on, a match that fails from the start of a
#: run fails from inside it too, so that a search starts at run starts or where the last match ended, and
#: possessive quantifiers keep it linear; none of this changes what is matched.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that any text with a match passes.
HINTS = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
TERM = r"[\p{L}\p{N}]+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the end, every second digit counts double."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _byte(part: Column) -> Column:
    n = F.ltrim(part, F.lit("0"))
    return (F.length(n) <= 2) | ((F.length(n) == 3) & (n <= "255"))


def valid(kind: Column, m: Column) -> Column:
    n = F.length(_digits(m))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(F.split(m, r"\."), _byte))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False)))
        .otherwise(n.between(9, 15))
    )


def _matches(text: str) -> Column:
    """Array of (kind, number, gap before, match, words that begin in the gap and in the match, whether a word goes on behind it), all kinds."""
    t = F.col(text)
    begun = lambda x: x.rlike(rf"^{WORD}")

    def of(k: int, kind: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))
        gaps = F.split(t, PATTERNS[kind], -1)
        one = lambda m, i: F.struct(
            F.lit(k).alias("kind"), i.alias("i"), m.alias("m")
        )
        pairs = F.arrays_zip(F.transform(found, one).alias("f"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), F.slice(gaps, F.lit(2), F.size(found)).alias("then"))
        # Matches begin and end with characters of words: a piece that begins inside a word has one word less of its own.
        in_gap = lambda p: F.regexp_count(p["gap"], F.lit(WORD)) - ((p["f"]["i"] > 0) & begun(p["gap"])).cast("int")
        inside = lambda p: F.when(p["gap"] == "", p["f"]["i"] > 0).otherwise(p["gap"].rlike(rf"{WORD}\z"))
        in_match = lambda p: F.regexp_count(p["f"]["m"], F.lit(WORD)) - inside(p).cast("int")
        row = F.transform(
            pairs,
            lambda p: F.struct(
                p["f"]["kind"].alias("kind"), p["f"]["i"].alias("i"), F.length(p["gap"]).alias("gap"), p["f"]["m"].alias("m"), in_gap(p).alias("in_gap"), in_match(p).alias("in_match"), begun(p["then"]).alias("open")
            ),
        )
        none = F.array().cast("array<struct<kind:int,i:int,gap:int,m:string,in_gap:int,in_match:int,open:boolean>>")
        return F.when(t.rlike(HINTS[kind]), row).otherwise(none)

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def base_spans(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys of all rows (d, th); the valid matches of each key: row (a number of the key), d, th, copies (how many rows the key has),
    kind, s, e, m, and how many words begin before s (before) and before e and don't go on behind it (after); texts that have any: row, t.
    """
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(col(doc_id).alias("d"), t.alias("t"))
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    matched = rows.select("d", F.xxhash64("t").alias("th"), "t", _matches("t").alias("found"))
    any_valid = F.exists("found", lambda x: valid(kind(x["kind"]), x["m"]))
    found = materialize(matched.select("d", "th", F.when(any_valid, F.col("t")).alias("t"), "found"), "matches")
    one = found.filter("t is not null").groupBy("d", "th").agg(F.first("found").alias("found"), F.first("t").alias("t"), F.count("*").alias("copies"))
    one = materialize(one.withColumn("row", F.monotonically_increasing_id()), "rows")
    each = one.select("row", "d", "th", "copies", F.inline("found"))
    n, order = F.length("m"), Window.partitionBy("row", "kind").orderBy("i")
    begun = F.sum(F.col("in_gap") + F.col("in_match")).over(order)
    # Behind a match with no gap stands the next one, if any.
    going_on = F.col("open") | F.coalesce(F.lead("gap").over(order) == 0, F.lit(False))
    placed = each.select(
        "row", "d", "th", "copies", "kind", "m", F.sum(F.col("gap") + n).over(order).cast("long").alias("e"), (begun - F.col("in_match")).alias("before"), (begun - going_on.cast("int")).alias("after")
    ).withColumn("s", F.col("e") - n)
    return found.select("d", "th"), materialize(placed.filter(valid(kind(F.col("kind")), F.col("m"))), "spans"), one.select("row", "t")


def _entity() -> Column:
    return F.xxhash64("kind", F.lower("m"))


def _terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))


def context_terms(spans: DataFrame, texts: DataFrame, reach: int) -> DataFrame:
    """Terms within ``reach`` words of a span: row, th, copies, entity, term (hash), once for each row."""
    # Words with the spaces that come before: their lengths add up to places.
    pieces = texts.select("row", F.posexplode(F.regexp_extract_all("t", F.lit(rf"[\x20\x09-\x0D]*({WORD})"), F.lit(0))).alias("i", "w"))
    end = F.sum(F.length("w")).over(Window.partitionBy("row").orderBy("i"))
    words = pieces.select("row", "i", end.alias("end"), F.ltrim(F.translate("w", "\t\n\x0b\x0c\r", "     ")).alias("w"))
    k = F.explode(F.sequence(F.lit(0), F.lit(reach)))
    steps = spans.select("row", "th", "copies", _entity().alias("entity"), F.col("s").alias("from"), F.col("e").alias("to"), "before", "after", k.alias("k")).filter("k > 0")
    side = lambda i, left: F.struct(i.cast("int").alias("i"), F.lit(left).alias("left"))
    sides = F.array(side(F.col("before") - F.col("k"), True), side(F.col("after") + F.col("k") - 1, False))
    wanted = steps.select("row", "th", "copies", "entity", "from", "to", F.inline(sides)).filter("i >= 0")
    # A word that the span is a part of counts with its part before or behind the span.
    at = F.col("end") - F.length("w")
    cut = F.when(F.col("left"), F.substring("w", F.lit(1), (F.least("end", "from") - at).cast("int"))).otherwise(F.substring("w", (F.greatest(at, "to") - at + 1).cast("int"), F.length("w")))
    return wanted.join(words, ["row", "i"]).select("row", "th", "copies", "entity", F.explode(_terms(cut)).alias("term")).distinct()


def document_terms(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d, th, term (hash): the distinct terms of every row."""
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    return docs.select(col(doc_id).alias("d"), F.xxhash64(t).alias("th"), F.explode(_terms(t)).alias("term"))


def all_places(docs: DataFrame, terms: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every place of the given terms (hashes) in any document: d, th, s, e."""
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    holding = document_terms(docs, doc_id, text).join(terms, "term").select(F.col("d").alias("hd"), F.col("th").alias("hh")).distinct()
    rows = docs.select(col(doc_id).alias("d"), F.xxhash64(t).alias("th"), t.alias("t"))
    held = rows.join(holding, F.col("d").eqNullSafe(F.col("hd")) & (F.col("th") == F.col("hh")), "left_semi")
    # Rows that repeat an id and a text are one.
    once = materialize(held.groupBy("d", "th").agg(F.first("t").alias("t")).withColumn("row", F.monotonically_increasing_id()), "holding")
    words, gaps = F.regexp_extract_all("t", F.lit(TERM), F.lit(0)), F.split("t", TERM, -1)
    piece = lambda w, gap: F.struct(F.xxhash64(F.lower(w)).alias("term"), F.length(w).alias("n"), F.length(gap).alias("gap"))
    each = once.select("row", "d", "th", words.alias("w"), gaps.alias("g")).select("row", "d", "th", F.zip_with("w", F.slice("g", F.lit(1), F.size("w")), piece).alias("p"))
    each = each.select("row", "d", "th", F.posexplode("p").alias("i", "p")).select("row", "d", "th", "i", "p.*")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row").orderBy("i"))
    return each.withColumn("e", end.cast("long")).join(terms, "term").select("d", "th", (F.col("e") - F.col("n")).alias("s"), "e")


def apart(terms: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans of ``terms`` (d, th, s, e) that share no character with base spans, which go as a whole anyway."""
    every = terms.select("d", "th", "s", "e", F.lit(False).alias("base")).unionByName(spans.select("d", "th", "s", "e", F.lit(True).alias("base")))
    of_row = Window.partitionBy("d", "th")
    before = F.max(F.when(F.col("base"), F.col("e"))).over(of_row.orderBy("s", F.desc("base")).rowsBetween(Window.unboundedPreceding, 0))
    behind = F.min(F.when(F.col("base"), F.col("s"))).over(of_row.orderBy(F.desc("s"), F.desc("base")).rowsBetween(Window.unboundedPreceding, 0))
    free = (F.coalesce("before", "s") <= F.col("s")) & (F.coalesce("behind", "e") >= F.col("e"))
    return every.withColumn("before", before).withColumn("behind", behind).filter(~F.col("base") & free).select("d", "th", "s", "e")


def disclosing_terms(docs: DataFrame, spans: DataFrame, near: DataFrame, doc_id: str, text: str, threshold: float, support: int, alpha: float) -> DataFrame:
    """entity, term, n_docs, n_e, n_t, n_et, texts: pairs in which the term discloses the entity."""
    by_text = near.groupBy("entity", "term", "th").agg(F.sum("copies").alias("n"))
    pairs = materialize(by_text.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("texts")), "pairs")
    n_docs, tested = float(docs.count()), float(max(1, pairs.count()))
    holders = spans.select("row", "copies", _entity().alias("entity")).distinct()
    entities = holders.groupBy("entity").agg(F.sum("copies").alias("n_e"))
    counts = document_terms(docs, doc_id, text).groupBy("term").agg(F.count("*").alias("n"))
    joined = pairs.filter(F.col("texts") >= support).join(entities, "entity").join(counts, "term").withColumn("n_docs", F.lit(n_docs))
    # A term that only stands glued to spans has no count of its own there.
    known = joined.withColumn("n_t", F.greatest("n", "n_et"))
    info = F.log(F.col("n_docs") / F.col("n_e"))
    mutual = F.log(F.col("n_docs") * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    k, expected = F.col("texts"), F.col("n_e") * F.col("n_t") / F.col("n_docs")
    chance = F.when(k > expected, k - expected - k * F.log(k / expected)).otherwise(0.0) + F.log(F.lit(tested))
    found = known.filter((info > 0) & (mutual >= threshold * info) & (chance <= F.log(F.lit(alpha))))
    return found.select("entity", "term", "n_docs", "n_e", "n_t", "n_et", "texts")


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = 8, threshold: float = 0.9, support: int = 1, alpha: float = 0.05) -> DataFrame:
    """doc_id, th, spans (array of start, kind number, end) of every row."""
    keys, spans, texts = base_spans(docs, doc_id, text)
    near = materialize(context_terms(spans, texts, reach), "near")
    disclosing = materialize(disclosing_terms(docs, spans, near, doc_id, text, threshold, support, alpha), "disclosing")
    # What tells of the entity tells of it wherever it stands.
    terms = apart(all_places(docs, disclosing.select("term").distinct(), doc_id, text), spans)
    every = spans.select("d", "th", "kind", "s", "e").unionByName(terms.withColumn("kind", F.lit(len(KINDS))))
    span = F.struct(F.col("s"), F.col("kind"), F.col("e"))
    grouped = every.groupBy(F.col("d").alias("gd"), F.col("th").alias("gh")).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    out = keys.join(grouped, F.col("d").eqNullSafe(F.col("gd")) & (F.col("th") == F.col("gh")), "left")
    none = F.array().cast("array<struct<s:bigint,kind:int,e:bigint>>")
    return out.select(F.col("d").alias("doc_id"), "th", F.coalesce("spans", none).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans as text, and how many they are."""
    names = F.array(*map(F.lit, (*KINDS, "term")))
    label = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] < len(KINDS))
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    digest = F.sha2(F.array_join(F.transform(base, label), ",").cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), F.array_join(F.transform("spans", label), ",").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with base spans replaced by <KIND> and disclosing terms removed from the text. Of overlapping spans the first counts."""
    d, h, spans = fresh(docs, "span_doc"), fresh(docs, "span_hash"), fresh(docs, "spans")
    found = find_spans(docs, doc_id, text, **options).select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("spans").alias(spans)).filter(F.size(spans) > 0).distinct()
    t = col(text).cast("string")
    th = fresh(docs, "text_hash")
    out = docs.withColumn(th, F.xxhash64(F.coalesce(t, F.lit(""))))
    out = out.join(found, col(doc_id).eqNullSafe(F.col(d)) & (F.col(th) == F.col(h)), "left")
    mark = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS), F.lit(""))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda a, x: F.when(x["s"] < a["at"], a).otherwise(
        F.struct(
            x["e"].alias("at"), F.concat(a["parts"], F.array(F.substring(t, (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int")), F.element_at(mark, x["kind"] + 1))).alias("parts")
        )
    )
    new = F.aggregate(F.col(spans), zero, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))
    changed = F.when(F.col(spans).isNotNull(), new).otherwise(t)
    return out.select(*(changed.alias(c) if c == text else col(c) for c in docs.columns))
