"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes 1 (sound), 0 (poor) or abstains, by counts of the text. How
often rules are right is not known beforehand: expectation-maximisation
estimates each rule's rates of votes for sound and for poor documents, and the
share of sound documents, from all documents' votes. The posterior probability
of a sound document takes the place of "passes every rule".

Three things tell the classes apart. Rules overlap, so that a defect shows in
several votes. Documents that fail the base test are known to be poor: their
responsibility stays 0. And a rule's rate of "poor" votes on poor documents is
held at or above that on sound ones. Beliefs about rates weigh ``strength``
documents, whatever the corpus. All rules abstain on documents of fewer than 50
words, which fail the base test and take no part in the estimate.

Documents with equal votes are alike to this estimate, so it runs on the counts
of vote patterns: 3 to the power of the number of rules at most, whatever the
corpus. All steps are one ``aggregate`` expression over these counts. Each
document then looks its pattern's posterior up.

Words are ``[^\\x20\\x09-\\x0D]+``. A word is repeated if it is in a 3-word window
that the text has twice or more. Windows are compared by 64-bit hashes.

Nulls: a null text has no words. Repeated rows get a row each and count each.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, col, materialize

#: Characters counted as symbols. Fixed values.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and further counts for the rules.

    n_signs: characters that are no letter, digit or space. n_tails: words that end in two signs. n_ends: words
    that end in a letter and a full stop, question or exclamation mark. n_small: words of one to three letters.
    n_echo: words equal to the one before.

    Each step is a projection of its own, so that a lambda finds the array it looks into computed.
    """
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    words = docs.select(col(doc_id).alias("doc_id"), t.alias("t"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    n, end = F.size("w"), f"(?![^{SPACE}])"
    starts = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    counted = words.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("t", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("t", rf"[\p{{L}}\p{{N}}{SPACE}]+", "")).cast("long").alias("n_signs"),
        F.regexp_count("t", F.lit(rf"[^\p{{L}}\p{{N}}{SPACE}]{{2}}{end}")).cast("long").alias("n_tails"),
        F.regexp_count("t", F.lit(rf"\p{{L}}[.!?]{end}")).cast("long").alias("n_ends"),
        F.regexp_count("t", F.lit(rf"(?<![^{SPACE}])\p{{L}}{{1,3}}{end}")).cast("long").alias("n_small"),
        F.size(F.filter("w", lambda x, i: x == F.get("w", i - 1))).cast("long").alias("n_echo"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.transform(starts, lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2))).alias("h"),
    )
    # Only texts with a window that occurs twice go on to sort theirs: equal windows become neighbours.
    pairs = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = counted.select(
        "*",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).otherwise(none).alias("s"),
    ).drop("lines", "h")
    twin = lambda x, k: (F.get("s", k)["h"] == x["h"])
    found = ordered.select("*", F.filter("s", lambda x, k: F.coalesce(twin(x, k - 1), F.lit(False)) | F.coalesce(twin(x, k + 1), F.lit(False))).alias("r")).drop("s")
    # Windows from sorted places: each adds 3 words less those that the one before covers.
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.sort_array(F.transform("r", lambda x: x["i"])),
        zero,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return found.select("*", covered.alias("n_repeat_words")).drop("r")


def failed() -> Column:
    """The base test: too few words, or over half of them repeated."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> dict[str, Column]:
    """The rules: 1 sound, 0 poor, -1 abstains."""

    def vote(poor: Column, sound: Column) -> Column:
        return F.when(F.col("n_words") < MIN_WORDS, -1).when(poor, 0).when(sound, 1).otherwise(-1)

    c = F.col
    return {
        "symbols": vote(10 * c("n_symbols") > c("n_words"), 50 * c("n_symbols") <= c("n_words")),
        "signs": vote(2 * c("n_signs") > c("n_words"), 10 * c("n_signs") <= 3 * c("n_words")),
        "letters": vote(100 * c("n_letters") < 75 * c("word_chars"), 10 * c("n_letters") >= 9 * c("word_chars")),
        "tails": vote(5 * c("n_tails") > c("n_words"), 50 * c("n_tails") <= c("n_words")),
        "capitals": vote(10 * c("n_upper") > 4 * c("n_letters"), 10 * c("n_upper") <= 2 * c("n_letters")),
        "sentences": vote(100 * c("n_ends") < c("n_words"), 40 * c("n_ends") >= c("n_words")),
        "small_words": vote(10 * c("n_small") < c("n_words"), 5 * c("n_small") >= c("n_words")),
        "repeats": vote(3 * c("n_repeat_words") > c("n_words"), 10 * c("n_repeat_words") <= c("n_words")),
        "echoes": vote(10 * c("n_echo") > c("n_words"), 20 * c("n_echo") <= c("n_words")),
        "variety": vote(10 * c("n_distinct") < c("n_words"), 10 * c("n_distinct") >= 4 * c("n_words")),
    }


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def posterior(votes: Column, state: Column, n_rules: int) -> Column:
    """P(sound | votes). state: prior, sound (rates of vote 1 in sound documents that are voted on), poor (rates of vote 0 in poor ones)."""
    prior = F.log(state["prior"] / (1 - state["prior"]))

    def ratio(r: Column) -> Column:
        v, s, p = F.get(votes, r), F.get(state["sound"], r), F.get(state["poor"], r)
        return F.when(v == 1, F.log(s / (1 - p))).when(v == 0, F.log((1 - s) / p)).otherwise(0.0)

    logit = F.aggregate(F.sequence(F.lit(0), F.lit(n_rules - 1)), prior, lambda a, r: a + ratio(r))
    return 1 / (1 + F.exp(-logit))


def majority(votes: Column) -> Column:
    """The share of votes that are for sound."""
    n = lambda test: F.size(F.filter(votes, test))
    return n(lambda v: v == 1) / n(lambda v: v >= 0)


def em(patterns: Column, n_rules: int, rounds: int, start: Callable[[Column], Column] = majority, sound: float = 0.9, poor: float = 0.5, strength: float = 2.0) -> Column:
    """Expectation-maximisation over counted vote patterns (votes, failed, n): prior, sound, poor.

    ``start`` gives the first responsibilities from the votes. ``sound`` and ``poor`` are beliefs about the
    rates that weigh ``strength`` documents. Patterns without a vote don't take part.
    """
    each = F.sequence(F.lit(0), F.lit(n_rules - 1))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    used = F.filter(patterns, lambda p: F.exists(p["votes"], lambda v: v >= 0))

    def rate(shares: Column, key: str, value: int, belief: float, r: Column) -> Column:
        right = total(shares, lambda x: F.when(F.get(x["votes"], r) == value, x[key]).otherwise(0.0))
        voted = total(shares, lambda x: F.when(F.get(x["votes"], r) >= 0, x[key]).otherwise(0.0))
        return (right + strength * belief) / (voted + strength)

    def rates(x: Column) -> Column:
        """New state from each pattern's sound (s) and poor (p) documents."""
        n_sound, n_poor = total(x, lambda y: y["s"]), total(x, lambda y: y["p"])
        return let(
            F.transform(each, lambda r: rate(x, "s", 1, sound, r)),
            lambda s: F.struct(((n_sound + 1) / (n_sound + n_poor + 2)).alias("prior"), s.alias("sound"), F.transform(each, lambda r: F.greatest(rate(x, "p", 0, poor, r), 1 - F.get(s, r))).alias("poor")),
        )

    def shares(q) -> Column:
        known = lambda p: F.when(p["failed"], 0.0).otherwise(q(p["votes"]))
        return F.transform(used, lambda p: let(known(p), lambda s: F.struct(p["votes"].alias("votes"), (p["n"] * s).alias("s"), (p["n"] * (1 - s)).alias("p"))))

    first = let(shares(start), rates)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda state, _: let(shares(lambda v: posterior(v, state, n_rules)), rates))


def estimate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: dict[str, Column] | None = None, rounds: int = 40, **beliefs) -> tuple[DataFrame, DataFrame, int]:
    """Documents with base counts, base_failed and the number of their vote pattern (code); one row with state and patterns; how many rules."""
    rules = rules or default_rules()
    votes = F.array(*rules.values())
    code = sum(((v + 1) * 3**i for i, v in enumerate(rules.values())), failed().cast("int") * 3 ** len(rules))
    counts = base_counts(docs, doc_id, text).withColumn("base_failed", failed())
    rows = materialize(counts.select("*", code.cast("long").alias("code"), votes.alias("votes")), "votes")
    by_pattern = rows.groupBy("code").agg(F.any_value("votes").alias("votes"), F.any_value("base_failed").alias("failed"), F.count("*").cast("double").alias("n"))
    gathered = by_pattern.agg(F.array_sort(F.collect_list(F.struct("code", "votes", "failed", "n"))).alias("patterns"))  # 2 * 3 ** rules at most
    return rows, gathered.select("patterns", em(F.col("patterns"), len(rules), rounds, **beliefs).alias("state")), len(rules)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: dict[str, Column] | None = None, rounds: int = 40, min_posterior: float = 0.5, **beliefs) -> DataFrame:
    """doc_id, the base counts, base_failed, posterior, kept of every document."""
    rows, fitted, n_rules = estimate(docs, doc_id, text, rules, rounds, **beliefs)
    table = fitted.select("state", F.explode("patterns").alias("p")).select(F.col("p.code").alias("code"), posterior(F.col("p.votes"), F.col("state"), n_rules).alias("posterior"))
    out = rows.join(F.broadcast(table), "code")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= min_posterior)).alias("kept")
    )
