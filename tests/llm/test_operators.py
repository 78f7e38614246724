"""Each operator against a brute-force version, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from actflow.llm import decontaminate, labelled, line_dedup, lm, near_dup, packing, pii, quality, toxicity, warc, weak_rules
from actflow.llm.queries import ORACLES, QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls, empty, blank and long texts, a repeated row, a null id, columns with clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 30000), (5, "same words here"), (5, "same words here"), (None, "no id"), (6, "é😀 ünï\n\nçode")]
    return spark.createDataFrame([(i, t, "x", 1, "y", 0) for i, t in rows], "doc_id long, text string, n string, th long, kept string, key int")


def sample(spark, sf, table="documents"):
    return spark.read.parquet(f"{sf}/{table}.parquet")


# --- 1 toxicity
def test_toxicity_held_out(spark, sf):
    d, labels = sample(spark, "/root/testdata/sf0.01"), sample(spark, "/root/testdata/sf0.01", "labels")
    rows = toxicity.score_toxicity(d, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (5, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd(spark), labels).count() == 8
    none = toxicity.score_toxicity(odd(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score_toxicity(odd(spark).limit(0), labels).count() == 0


# --- 2 WARC
def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u", "<p>é"), (1, "v", "<p>é"), (2, "w", None), (4, None, ""), (7, "x", "a\r\n\r\nb WARC/1.1\r\n"), (None, "n", "only"), (8, "r", "twin"), (8, "r", "twin")]
    p = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_pages(p, f"file://{tmp_path}/a").collect()
    assert len(got) == 8
    by = {r.page_id: r for r in got if r.page_id != 8}
    assert (by[1].record_type, by[3].record_type, by[3].refers_to, by[1].refers_to) == ("response", "revisit", 1, None)
    assert (by[2].record_type, by[4].refers_to, by[2].payload_bytes) == ("response", 2, 0)
    assert Counter(r.record_type for r in got if r.page_id == 8) == {"response": 1, "revisit": 1}
    for i, _, html in rows:
        data = (html or "").encode()
        assert by.get(i, got[-1]).payload_bytes == len(data) or i == 8
        if i in by:
            assert by[i].payload_digest == warc.sha1_base32(data)
    records = warc.read_archive(spark, f"file://{tmp_path}/a")
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == 5
    warc.write_warc_files(records, f"file://{tmp_path}/files")
    parsed = [x for f in tmp_path.glob("files/part-*") for x in warc.parse_warc(f.read_bytes())]
    want = [(bytes(r.header), bytes(r.block)) for r in records.collect()]
    assert Counter(parsed) == Counter(want)
    short = warc.archive_pages(p, f"file://{tmp_path}/b", min_revisit_bytes=100).collect()
    assert {r.record_type for r in short} == {"response"}
    assert warc.archive_pages(p.limit(0), f"file://{tmp_path}/c").count() == 0


def test_warc_wrong_payload(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(), bytearray(b"y"))], "digest string, payload binary").write.mode("overwrite").parquet(f"file://{tmp_path}/a/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, f"file://{tmp_path}/a").collect()


# --- 3 near-duplicates
def brute_classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = near_dup.words_of(t or "")
        grams = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        sets[i] = Counter(grams)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = sum((sets[a] & sets[b]).values())
            if both and both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, sf):
    d = sample(spark, sf)
    got = near_dup.near_duplicate_classes(d).collect()
    want = brute_classes([(r.doc_id, r.text) for r in d.collect()])
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.kept} == set(want.values())


def test_near_duplicate_chains(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    texts = [list(words)]
    for _ in range(30):  # each differs a little from the one before, and much from the first
        t = list(texts[-1])
        t[rng.integers(200)] = f"x{rng.integers(10**6)}"
        texts.append(t)
    texts = [" ".join(t) for t in texts] + ["one two three", "one two three", "ONE two three", "one two four"]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(docs(spark, texts)).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def test_dart_signatures_estimate_similarity():
    agree, true = [], []
    for k in range(200):
        rng = np.random.default_rng(k)
        n = int(rng.integers(1, 300))
        a, w = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(1, 4, n).astype(float) * rng.choice([1, 0.5])
        keep = rng.random(n) < 0.8
        keep[0] = True
        both = w[keep].sum()
        agree.append((near_dup.signature(a, w, 64) == near_dup.signature(a[keep], w[keep], 64)).mean())
        true.append(both / w.sum())
    assert abs(np.mean(agree) - np.mean(true)) < 0.02


def test_near_duplicates_odd(spark):
    got = near_dup.near_duplicate_classes(odd(spark)).collect()
    assert len(got) == 8 and {r.class_id for r in got if r.doc_id == 5} == {5}
    left = near_dup.drop_near_duplicates(odd(spark))
    assert left.columns == odd(spark).columns and Counter(r.doc_id for r in left.collect())[5] == 1 and left.count() == 7
    assert near_dup.near_duplicate_classes(odd(spark).limit(0)).count() == 0


def counted_pairs(monkeypatch):
    """Rows of every table of pairs that are compared."""
    seen, write = [], near_dup.materialize

    def watch(df, label):
        out = write(df, label)
        if label == "pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "materialize", watch)
    return seen


def test_unlike_members_of_a_bucket_are_not_paired(spark, monkeypatch):
    seen, n = counted_pairs(monkeypatch), 2000
    common = " ".join(f"c{i}" for i in range(80))
    texts = [f"{common} " + " ".join(f"u{k}_{i}" for i in range(20)) for k in range(n)]  # similarity 0.66: most meet in a bucket
    texts += [t + " more" for t in texts[:20]]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(docs(spark, texts)).collect()}
    assert got == {i: i - n if i >= n else i for i in range(n + 20)}
    assert n / 2 < sum(seen) < 4 * n


def test_edits_of_one_text_are_linked_exactly(spark, monkeypatch):
    seen, rng = counted_pairs(monkeypatch), np.random.default_rng(4)
    base, few = [f"w{i}" for i in range(60)], [f"x{i}" for i in range(6)]
    texts = {tuple(base)}
    while len(texts) < 500:  # one to four edits: copies of copies are similar, others are near the threshold or below
        t = list(base)
        for at in rng.choice(60, rng.integers(1, 5), replace=False):
            t[at] = few[rng.integers(6)]
        texts.add(tuple(t))
    texts = [" ".join(t) for t in sorted(texts)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(docs(spark, texts)).collect()}
    assert got == brute_classes(list(enumerate(texts)))
    assert sum(seen) < 10 * len(texts)


def test_near_duplicates_clashing_names_and_repeats(spark):
    names = ["keep_id", "keep_hash", "text_hash", "words_key", "bands", "n_shingles", "node", "row_hash", "least_hash", "a", "b", "class_id"]
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words stand here now"), (2, "A b c  d e f"), (None, "a b c d e f"), (None, None), (None, None), (3, None)]
    d = spark.createDataFrame([(i, t, *([k] * len(names))) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{x} int" for x in names))
    first = near_dup.drop_near_duplicates(d).collect()
    assert near_dup.drop_near_duplicates(d.repartition(5)).columns == d.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in first) == sorted([("1", rows[0][1]), ("1", rows[2][1]), ("None", "None"), ("3", "None")])
    assert sorted(map(str, near_dup.drop_near_duplicates(d.orderBy(F.desc("a"))).collect())) == sorted(map(str, first))


def test_quality_uses_the_whole_of_long_words():
    of = lambda t: dict(zip(*(x.tolist() for x in quality.Features().of_text(t))))
    assert quality.shape("a1" * 12 + "B-") != quality.shape("a1" * 12)
    head = "a1" * 20
    junk = of(head + "###" + "spam" + "9")
    assert of("spam").keys() <= of(head + "###spam9").keys() and not of("spam").keys() <= of(head).keys()
    assert junk != of(head + "###" + "good" + "9")
    script = "\u6587\u5b57" * 40  # one word, no spaces
    assert len(of(script).keys() & of(script + "\u4e2d" * 8).keys()) >= 3
    for w in ("x", "a1" * 6, "y" * 64, "a1" * 7 + "." + "z" * 100, "_" * 70):
        assert "".join(quality.pieces(w)) == w
    assert quality.pieces("a1" * 6) == ["a1" * 6] and quality.pieces("y" * 64) == ["y" * 64]


# --- labelled sample
def test_sample_passes_over_long_texts(spark):
    n = 60
    d = docs(spark, ["short text " + str(i) for i in range(n)] + ["y" * 50, "x" * 70])
    order = [r.doc_id for r in d.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").collect()]
    long = order[0]  # stands before all others
    d = d.withColumn("text", F.when(F.col("doc_id") == long, F.repeat(F.lit("z"), 5000)).otherwise(F.col("text")))
    labels = d.select("doc_id", (F.col("doc_id") >= 0).cast("int").alias("q"))
    take = lambda most: labelled.labelled_sample(d, labels, {"q": F.col("q")}, F.lit(True), n + 2, most)[0]
    texts = [r.text for r in take(2000)]
    assert len(texts) == n + 1 and "z" * 5000 not in texts
    assert [len(r.text) for r in take(5)] == [12]  # none fits: the shortest
    assert len(take(10**6)) == n + 2


def test_sample_settles_repeated_ids(spark):
    rows = [(1, "b"), (1, "a"), (2, "c"), (1, "b")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, q int")
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        assert sorted(r.text for r in labelled.labelled_sample(d, labels, {"q": F.col("q")}, F.lit(True), 5, 100)[0]) == ["a", "c"]


def test_toxicity_ratios_against_brute_force():
    texts, toxic = ["you fool fool", "kind words here", "fool again", "kind fool"], [1, 0, 1, 0]
    grams = [{(n, f" {t} "[i : i + n]) for n in (3, 4, 5) for i in range(len(t) + 3 - n)} for t in texts]
    for t, g in zip(texts, grams):
        assert len(set(np.concatenate(toxicity.gram_buckets(t)).tolist())) == len(g)  # nothing collides here
    model = toxicity.fit(texts, toxic, [1.0] * 4, min_texts=1, rounds=3)
    p, q = Counter(x for g, y in zip(grams, toxic) if y for x in g), Counter(x for g, y in zip(grams, toxic) if not y for x in g)
    for t in texts:
        c = f" {t} "
        for n, b in zip((3, 4, 5), toxicity.gram_buckets(t)):
            for i, bucket in enumerate(b.tolist()):
                ratio = math.log((p[n, c[i : i + n]] + 1) / (q[n, c[i : i + n]] + 1))  # classes of equal size
                w = float(model.weights[bucket])
                assert w == 0 if abs(ratio) < 1e-9 else w * ratio > 0 or w == 0


def test_quality_gradient():
    """The fitted thresholds and weights can't be bettered by small steps: the likelihood is flat in every direction."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["good", "fine", "well", "bad", "junk", "##"], 12, p=p)) for p in ([0.3, 0.3, 0.3, 0.05, 0.03, 0.02], [0.15, 0.2, 0.15, 0.2, 0.15, 0.15], [0.02, 0.03, 0.05, 0.3, 0.3, 0.3]) for _ in range(30)]
    grades = [2] * 30 + [1] * 30 + [0] * 30
    model = quality.fit(texts, grades, [1.0] * 90, rounds=3000)
    feats = [quality.Features().of_text(t) for t in texts]

    def loss(w, t):
        total = 0.0
        for (ids, v), g in zip(feats, grades):
            tail = [1, *(1 / (1 + np.exp(-(w[ids] @ v - t)))), 0]
            total -= math.log(max(tail[g] - tail[g + 1], 1e-12))
        used = np.unique(np.concatenate([i for i, _ in feats]))
        return total / 90 + 1e-4 * (w[used] ** 2).sum() / 2 / len(used) ** 0.5

    w, t = model.weights.astype(float), model.thresholds
    at = loss(w, t)
    assert t[0] < t[1] and at < loss(w * 0, t)
    for k in range(2):
        for e in (-0.05, 0.05):
            assert loss(w, t + e * np.eye(2)[k]) > at - 1e-5
    for i in np.unique(np.concatenate([i for i, _ in feats]))[:12]:
        for e in (-0.05, 0.05):
            moved = w.copy()
            moved[i] += e
            assert loss(moved, t) > at - 1e-4


# --- 4 quality rules
def brute_base(t):
    ws = WORD.findall(t or "")
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_weak_rules(spark, sf):
    d = sample(spark, sf).select("doc_id", "text").union(odd(spark).filter("doc_id is not null").select(F.col("doc_id") + 10**6, "text"))
    got = {r.doc_id: r for r in weak_rules.judge(d).collect()}
    for i, t in [(r.doc_id, r.text) for r in d.collect()]:
        r, b = got[i], brute_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.base_failed and r.kept)
    assert weak_rules.judge(odd(spark)).count() == 8 and weak_rules.judge(odd(spark).limit(0)).count() == 0


def test_weak_rules_agree_with_labels(spark):
    d, labels = (sample(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = weak_rules.judge(d).join(labels, "doc_id").filter("n_words >= 50").collect()
    good = [r for r in rows if r.quality]
    assert sum(r.kept for r in good) / len(good) > 0.97
    assert sum(r.kept for r in rows if not r.quality) <= 0.1 * sum(not r.quality for r in rows)


def brute_em(patterns, n_rules, rounds, start):
    used = [p for p in patterns if max(p[0]) >= 0]
    q = [0 if f else start(v) for v, f, _ in used]
    for k in range(rounds + 1):
        if k:
            z = [math.log(prior / (1 - prior)) + sum(math.log(g[r] / (1 - b[r])) if x == 1 else math.log((1 - g[r]) / b[r]) if x == 0 else 0 for r, x in enumerate(v)) for v, _, _ in used]
            q = [0 if f else 1 / (1 + math.exp(-x)) for (_, f, _), x in zip(used, z)]
        s, p = [n * x for (_, _, n), x in zip(used, q)], [n * (1 - x) for (_, _, n), x in zip(used, q)]
        at = lambda w, r, test: sum(x for x, (v, _, _) in zip(w, used) if test(v[r]))
        prior = (sum(s) + 1) / (sum(s) + sum(p) + 2)
        g = [(at(s, r, lambda v: v == 1) + 1.8) / (at(s, r, lambda v: v >= 0) + 2) for r in range(n_rules)]
        b = [max((at(p, r, lambda v: v == 0) + 1) / (at(p, r, lambda v: v >= 0) + 2), 1 - g[r]) for r in range(n_rules)]
    return prior, g, b


def test_em_against_python(spark):
    patterns = [([1, 1, 1], False, 800.0), ([0, 1, 1], False, 60.0), ([1, 0, 0], True, 40.0), ([0, 0, -1], False, 20.0), ([-1, -1, 1], False, 30.0), ([-1, -1, -1], True, 9.0)]
    df = spark.createDataFrame([(patterns,)], "p array<struct<votes:array<int>,failed:boolean,n:double>>")
    for rounds in (1, 10):
        s = df.select(weak_rules.em(F.col("p"), 3, rounds).alias("s")).first().s
        prior, g, b = brute_em(patterns, 3, rounds, lambda v: v.count(1) / sum(x >= 0 for x in v))
        assert s.prior == pytest.approx(prior) and s.sound == pytest.approx(g) and s.poor == pytest.approx(b)


def test_em_learns_rates(spark):
    d, labels = (sample(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    cautious = lambda v: F.when(F.exists(v, lambda x: x == 0), 0.1).otherwise(0.9)
    rows, fitted, n = weak_rules.estimate(d)
    a = fitted.first().state
    b = weak_rules.estimate(d, start=cautious)[1].first().state
    for x, y in ((a.sound, b.sound), (a.poor, b.poor), ([a.prior], [b.prior])):
        assert x == pytest.approx(y, abs=0.02)
    assert max(abs(p - 0.5) for p in a.poor) > 0.3 and all(s > 0.9 for s in a.sound)  # far from the beliefs
    voted = rows.join(labels, "doc_id").filter("n_words >= 50").collect()
    for r in range(n):
        poor = [x.votes[r] == 0 for x in voted if not x.quality and x.votes[r] >= 0]
        sound = [x.votes[r] == 1 for x in voted if x.quality and x.votes[r] >= 0]
        # 63 labelled documents are poor: three standard errors of a rate are under 0.2
        assert abs(np.mean(sound) - a.sound[r]) < 0.03 and abs(np.mean(poor) - a.poor[r]) < 0.2


# --- 5 decontamination
def test_leaks(spark):
    text = "The Quick, brown fox; jumps over the lazy dog and then some more words follow"
    bench = spark.createDataFrame([(1, text), (10, "short Item"), (2, None), (3, "..."), (None, "x y"), (11, "quick brown fox jumps over the lazy dog and then")], "item_id long, text string")
    d = docs(spark, [None, "", "nothing here", f"É {text.upper()}!", "a short-item b", "short items", "quick brown fox jumps over the lazy dog and", text + " " + text])
    want = {0: (0, 0, []), 1: (0, 0, []), 2: (2, 0, []), 3: (16, 15, [1, 11]), 4: (4, 2, [10]), 5: (2, 0, []), 6: (9, 0, []), 7: (30, 30, [1, 11])}
    for chars in (8_000_000, 40):  # in one block, and in several
        for r in decontaminate.find_leaks(d, bench, max_block_chars=chars).collect():
            n, hit, items = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated, r.items_sha256) == (n, hit, len(items), items, hit > 0, decontaminate.items_digest(items))
    left = decontaminate.decontaminate(d, bench)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 5, 6]
    assert decontaminate.find_leaks(odd(spark), bench.limit(0)).filter("n_hit = 0").count() == 8
    assert decontaminate.char_spans("É a, B", [(1, 3)]) == [(2, 6)]


def test_leak_offsets_against_brute_force(spark, sf):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    bench = sample(spark, sf, "benchmark")
    windows = set()
    for r in bench.collect():
        ws = word.findall(lower(r.text))
        windows |= {tuple(ws[i : i + 10]) for i in range(max(1, len(ws) - 9))} if ws else set()
    item = bench.first().text
    made = docs(spark, [f"É😀, {item.upper()}!", f"{item}\n{item} é", "nothing"], 10**6).select("doc_id", "text")
    d = sample(spark, sf).select("doc_id", "text").union(made)
    texts, n = {r.doc_id: r.text or "" for r in d.collect()}, 0
    for chars in (8_000_000, 20_000):
        for r in decontaminate.find_leaks(d, bench, max_block_chars=chars).collect():
            t = texts[r.doc_id]
            places = [(m.start(), m.end()) for m in word.finditer(lower(t))]
            ws, hit = word.findall(lower(t)), set()
            for size in {len(w) for w in windows}:
                for i in range(len(ws) - size + 1):
                    if tuple(ws[i : i + size]) in windows:
                        hit |= set(range(i, i + size))
            want = [(places[i][0], places[i][1]) for i in sorted(hit)]
            inside = [p for p in places if any(a <= p[0] and p[1] <= b for a, b in r.char_spans)]
            assert inside == want and r.n_hit == len(hit)
            assert all(a in {p[0] for p in want} and b in {p[1] for p in want} for a, b in r.char_spans)
            n += len(r.char_spans)
    assert n > 4


# --- 6 packing
def test_packing(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    d = sample(spark, sf).select("doc_id", "text").union(odd(spark).select(-F.col("doc_id"), "text"))
    rows = packing.pack_documents(d, TOKENIZER, with_ids=True).collect()
    whole = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32 and r.start == 2048 * r.piece
        if r.doc_id != -5:
            whole[r.doc_id].append((r.piece, ids.tolist()))
    for r in d.collect():
        if r.doc_id != -5:
            assert sum((x for _, x in sorted(whole[r.doc_id])), []) == tok.encode(r.text or "", add_special_tokens=False).ids + [0]
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 2048) * 1.05 + 1
    assert packing.pack_documents(odd(spark).limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_respects_every_capacity(rule):
    rng = np.random.default_rng(3)
    counts = Counter(rng.integers(1, 101, 5000).tolist())
    plan = packing.plan_patterns(counts, 100, 4, 10000, rule)
    packed = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 100 and len(lengths) <= 4 and sum(x * x for x in lengths) <= 10000
        for x in lengths:
            packed[x] += n
    assert packed == counts
    with pytest.raises(ValueError):
        packing.plan_patterns({100: 1}, 100, 4, 4000, rule)


def test_packing_encodes_few_words_at_once():
    texts = [" ".join(f"Wort{i}x{j}" for j in range(300)) for i in range(40)]
    enc, sizes = packing.Encoder(TOKENIZER), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, words, **options):
            sizes.append(len(words))
            return self.tokenizer.encode_batch_fast(words, **options)

    enc.tokenizer = Counted(enc.tokenizer)
    got = list(enc.encode(texts))
    assert sum(sizes) == 12_000 and max(sizes) <= 2048
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_workers_drop_what_another_operator_kept_and_work_by_parts(spark, monkeypatch):
    run = {}
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: run.update(f=f) or self)
    texts = [f"some words of text {i} and more of them to make a shingle or two" for i in range(1500)]
    d = docs(spark, texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts), pa.array(["en"] * 1500), pa.array(["s"] * 1500), pa.array(map(len, texts), pa.int64())], names=d.columns)
    operators = [
        lambda: quality.with_tails(d, quality.fit([], [], [])),
        lambda: near_dup.with_signatures(d, "text", 400, 50, 8, 5),
        lambda: near_dup.shingle_sets(d.select("doc_id", "text"), 5),
        lambda: decontaminate.scan_leaks(d, spark.createDataFrame([(1, texts[0])], "item_id long, text string")),
    ]
    for operator in operators:
        kept = weakref.ref(packing.encoder(TOKENIZER))
        assert packing.encoder(TOKENIZER) is kept()  # from task to task
        operator()
        out = list(run["f"](iter([batch])))
        assert kept() is None
        assert max(x.num_rows for x in out) <= 512 and sum(x.num_rows for x in out) == 1500


# --- 7 line dedup
def brute_lines(rows, min_words=50):
    runs, lines_of = defaultdict(list), {}
    for d, t in rows:
        lines = [(i, x, len(WORD.findall(x))) for i, x in enumerate(t.split("\n")) if WORD.search(x)]
        lines_of[d] = lines
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(x[2] for x in lines[i : j + 1]) >= min_words:
                    runs[tuple(x[1] for x in lines[i : j + 1])].append((d, i, j))
    gone = defaultdict(set)
    for found in runs.values():
        d0, i0, j0 = min(found)
        for d, i, j in found:
            if d != d0 or i > j0:
                gone[d].update(range(lines_of[d][i][0], lines_of[d][j][0] + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def test_line_dedup(spark):
    rng = np.random.default_rng(5)
    line = lambda k: " ".join(f"w{k}_{i}" for i in range(1 + k * 7 % 23))
    for trial in range(2):
        texts = []
        for _ in range(25):
            parts = []
            for _ in range(rng.integers(1, 5)):
                at = int(rng.integers(0, 30))
                parts += [line(k) for k in range(at, at + int(rng.integers(1, 12)))] + [""] * int(rng.integers(0, 2))
            texts.append("\n".join(parts))
        texts += ["\n".join(["x y z"] * 60), "\n".join([line(3)] * 9)]
        d = docs(spark, texts)
        out, n = line_dedup.dedupe_lines(d, n_chars="n_chars")
        got = {r.doc_id: r for r in out.collect()}
        want = brute_lines(list(enumerate(texts)))
        assert {k: r.text for k, r in got.items()} == want
        assert all(r.n_chars == len(r.text) for r in got.values())


def test_line_dedup_odd(spark):
    out, n = line_dedup.dedupe_lines(odd(spark))
    assert out.count() == 8 and out.columns == [*odd(spark).columns, n]
    assert Counter(r.text for r in out.collect()) == Counter(r.text for r in odd(spark).collect())
    assert line_dedup.dedupe_lines(odd(spark).limit(0))[0].count() == 0


def test_line_dedup_clashing_names(spark):
    names = ["_af_h", "_af_d", "run_doc", "run_hash", "run_gaps", "run_rest", "text_hash", "text_parts", "n_deleted", "d", "th", "pos"]
    passage = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(i, f"own {i}\n{passage}", *([i] * len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{x} int" for x in names))
    out, n = line_dedup.dedupe_lines(d)
    assert out.columns == [*d.columns, n]
    for r in out.collect():
        assert r.text == f"own {r.doc_id}" + (f"\n{passage}" if r.doc_id == 0 else "") and {r[x] for x in names} == {r.doc_id} and r[n] == int(r.doc_id > 0)


# --- 8 language model
def brute_score(model, lex, words, counts):
    """log10 probability of one text, symbol by symbol."""
    sym = []
    for w in words:
        i = lex.index.get(w)
        sym.append(int(lex.symbol[i]) if i is not None else lex.suffixes.get(w.decode("utf-8", "surrogatepass")[-2:], lm.OTHER))
    order, size, total = len(model.c) // model.r.shape[1], model.r.shape[1], 0.0
    before = [len(lex.counts)] * order + sym
    for at, t in enumerate([*sym, lm.END]):
        r = sum(model.r[before[at + j]] @ model.c[j * size : (j + 1) * size] for j in range(order))
        of, n = t // model.class_size, model.class_size
        for table, mine in ((model.k, of), (model.q[of * n : (of + 1) * n], t % n)):
            s = table[:, :-1] @ r + table[:, -1]
            total += (s[mine] - np.log(np.exp(s - s.max()).sum()) - s.max()) / math.log(10)
    for w, x in zip(words, sym):
        if lex.log_room[x] > 0:
            total += math.log10(counts[w.decode()] + 1) - lex.log_room[x]
    return total


def test_lm_scores(spark, sf, monkeypatch):
    d = sample(spark, sf).select("doc_id", "text").union(odd(spark).select(-F.col("doc_id"), "text"))
    rows = d.collect()
    tokens = lambda t: [w.decode() for w in lm.words_of(t)]
    train = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    c = Counter(w for r in train for w in tokens(r.text))
    n, v = sum(c.values()) + len(train), len(c) + 1
    made = {}
    for name in ("fit", "build_lexicon"):
        monkeypatch.setattr(lm, name, lambda *a, f=getattr(lm, name), name=name: made.setdefault(name, f(*a)))
    got = lm.score_texts(d, head=500, n_words=300, n_groups=40, class_size=20, stride=4).collect()
    model, lex = made["fit"], made["build_lexicon"]
    assert len(got) == len(rows)
    texts = {r.doc_id: r.text for r in rows}
    for i, r in enumerate(got):
        ws = tokens(texts[r.doc_id])
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(w in c for w in ws) + 1, n) and r.base_score == pytest.approx(base)
        if i % 3 == 0 or len(ws) < 50:
            assert r.score == pytest.approx(brute_score(model, lex, lm.words_of(texts[r.doc_id]), c), rel=1e-4)
    held = [r for r in got if r.held_out]
    tokens_held = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens_held > sum(r.base_score for r in held) / tokens_held + 0.1  # a tenth of a digit a token
    # What was counted into groups: their words' shares and the unknown word's make up the whole.
    for group in np.flatnonzero(lex.log_room > 0):
        mine = [w for w in c if (lex.symbol[lex.index[w.encode()]] if w.encode() in lex.index else lex.suffixes.get(w[-2:], lm.OTHER)) == group]
        assert sum(c[w] + 1 for w in mine) + 1 == pytest.approx(10 ** lex.log_room[group]) and lex.counts[group] == sum(c[w] for w in mine)
    assert lm.score_texts(d.limit(0)).count() == 0


def test_lm_examples_grow_with_the_corpus(spark):
    texts = ["a b c d e f g h"] * 40 + [None, "", "x"]
    lex = spark.sparkContext.broadcast(lm.Lexicon({w: i for i, w in enumerate(b"a b c d e f g h".split())}, np.array([*range(2, 10), 1]), np.zeros(9), {}, np.zeros(12), np.ones(12)))
    for copies in (1, 5):
        d = docs(spark, texts * copies).select("text")
        rows = lm.examples(d, lex, 3, 12, 1).collect()
        found = Counter(tuple(x) for r in rows for x in np.frombuffer(r.codes, "<i2").reshape(-1, 4).tolist())
        assert sum(r.n for r in rows) == (40 * 9 + 4) * copies and found[12, 12, 12, 2] == 40 * copies and found[7, 8, 9, 0] == 40 * copies and found[12, 12, 12, 0] == 2 * copies


def test_lm_trains_on_every_token(spark, sf, monkeypatch):
    lex = spark.sparkContext.broadcast(lm.Lexicon({w: i for i, w in enumerate(b"a b c".split())}, np.array([2, 3, 4, 1]), np.zeros(4), {}, np.zeros(5), np.ones(5)))
    d = docs(spark, ["a b c a", "", "c", None, "b " * 50]).select("text")
    windows = lambda stride: Counter(tuple(x) for r in lm.examples(d, lex, 2, 5, stride).collect() for x in np.frombuffer(r.codes, "<i2").reshape(-1, 3).tolist())
    assert windows(1).total() == 5 + 1 + 2 + 1 + 51 and windows(4) == windows(16) == windows(1)
    # What all tasks used the first class for, in all turns, is every token of the training texts.
    trained = []
    monkeypatch.setattr(lm, "materialize", lambda df, label, f=lm.materialize: [t := f(df, label), trained.append(t) if label == "trained" else None][0])
    got = lm.score_texts(sample(spark, sf).select("doc_id", "text"), head=500, n_words=300, n_groups=40, class_size=20).collect()
    used = sum(t.filter(F.col("key") == 3 << 40).agg(F.sum("used")).first()[0] for t in trained)
    assert used == sum(r.n_tokens for r in got if not r.held_out) == got[0].train_tokens


def test_lm_reads_texts_to_count_and_to_encode_only(spark, tmp_path, monkeypatch):
    docs(spark, ["a b c a", "", "c", None] * 5).write.parquet(f"file://{tmp_path}/d")
    read = []
    monkeypatch.setattr(lm, "materialize", lambda df, label, f=lm.materialize: [f(df, label), read.append(label) if any(str(tmp_path) in x for x in df.inputFiles()) else None][0])
    assert lm.score_texts(spark.read.parquet(f"file://{tmp_path}/d")).count() == 20 and read == ["words", "encoded"]


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 50, 70).astype(float)
    model = lm.LogBilinear.new(counts, 2, 8, 16)
    every = lambda a, b: np.array([[a, b, t] for t in range(70)])
    share = 10 ** model.log10_probability(every(3, 4))
    assert share.sum() == pytest.approx(1, abs=1e-5)
    a, b = rng.integers(0, 71, 30_000), rng.integers(0, 71, 30_000)
    codes = np.column_stack([a, b, (a + 7 * (b % 2)) % 70])  # what follows is settled by the two before
    before = model.log10_probability(codes).mean()
    for turn in range(3):
        used = model.train(codes, np.bincount(codes[:, 2], minlength=70).astype(float), 0.3, rng)
    assert model.log10_probability(codes).mean() > before + 0.7 and used[0].sum() == 60_000 and used[3][0] == 30_000
    for a, b in ((3, 4), (70, 70), (70, 1)):
        assert (10 ** model.log10_probability(every(a, b))).sum() == pytest.approx(1, abs=1e-5)


def test_lm_splits_as_word_by_word(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [None, "", " ", " a", "A\x00b ", *("".join(rng.choice(list(" \t\n\x0b\x0c\r\x1c\x85\xa0AZbÉß中😀"), 30)) for _ in range(300))]
    words, of = lm.split(pa.array(texts, pa.string()))
    found = [[] for _ in texts]
    for w, i in zip(words.to_pylist(), of):
        found[i].append(w.encode())
    assert found == [lm.words_of(t) for t in texts]
    monkeypatch.setattr(lm, "SLICE", 100)
    assert [t for _, part in lm.slices(pa.array(texts, pa.string())) for t in part.to_pylist()] == texts and not list(lm.slices(pa.array([], pa.string())))


def test_lm_classes_are_computed_together(monkeypatch):
    """A batch, or a part of the scores, takes one exponential over the classes and one within them, however many classes there are."""
    rng = np.random.default_rng(0)
    counts, codes = rng.integers(1, 50, 70).astype(float), rng.integers(0, 70, (3000, 3)).astype("<i2")
    calls = []
    monkeypatch.setattr(np, "exp", lambda *a, f=np.exp, **k: [calls.append(1), f(*a, **k)][1])
    for class_size in (4, 16):
        model = lm.LogBilinear.new(counts, 2, 8, class_size)
        calls.clear()
        model.train(codes, counts, 0.1, rng)
        assert len(calls) == 2 * 3  # batches of 1024
        calls.clear()
        model.log10_probability(codes)
        assert len(calls) == 2 * -(-len(codes) // lm.PART)


def test_lm_batch_against_single_examples():
    rng, size, size_k, noise, rate = np.random.default_rng(0), 8, 16, 8, 0.1
    counts, codes = rng.integers(1, 50, 70).astype(float), rng.integers(0, 70, (900, 3)).astype("<i2")  # one batch; the last class has 6 symbols
    model = lm.LogBilinear.new(counts, 2, size, size_k)
    r, c, q, k = (m.copy() for m in model.matrices())
    share = (counts + 0.5) / (counts + 0.5).sum()
    grads = [np.zeros(m.shape) for m in (r, c, q, k)]
    for a, b, t in codes.tolist():
        ahead, of = r[a] @ c[:size] + r[b] @ c[size:], t // size_k
        mine = np.arange(of * size_k, min((of + 1) * size_k, 70))
        expected = np.bincount(np.arange(70) // size_k, share), share[mine] / share[mine].sum()
        back = np.zeros(size)
        for table, grad, rows, at, m in ((k, grads[3], np.arange(len(k)), of, noise * expected[0]), (q, grads[2], mine, t % size_k, noise * expected[1])):
            e = np.exp(table[rows, :-1] @ ahead + table[rows, -1])
            g = m * e / (e + m)
            g[at] -= m[at] / (e[at] + m[at])
            grad[rows] += np.outer(g, [*ahead, 1])
            back += g @ table[rows, :-1]
        for j, x in enumerate((a, b)):
            grads[0][x] += c[j * size : (j + 1) * size] @ back
            grads[1][j * size : (j + 1) * size] += np.outer(r[x], back)
    model.train(codes, counts, rate, rng)
    for was, now, g in zip((r, c, q, k), model.matrices(), grads):
        assert now == pytest.approx(was - rate * g / np.sqrt(1 + g**2), abs=1e-5)


def test_lm_average_weighs_by_use(spark):
    row = lambda k, n, *v: (k, float(n), bytearray(np.array(v, "<f4").tobytes()))
    d = spark.createDataFrame([row(1, 1, 2, 4), row(1, 3, 6, 8), row(7, 5, 1, 1)], "key long, used double, vector binary")
    got = {r.key: (r.used, np.frombuffer(r.vector, "<f8").tolist()) for r in lm.average(d, 3).collect()}
    assert got == {1: (4, [5, 7]), 7: (5, [1, 1])}


# --- 9 quality
def test_quality_held_out(spark):
    d, labels = (sample(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality.fit_on(d, labels, train=F.col("doc_id") % 3 != 0)
    assert model.thresholds[0] < model.thresholds[1]
    rows = quality.score_quality(d, model).join(labels, "doc_id").filter("doc_id % 3 = 0").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.95
    for r in rows:
        assert r.p_best <= r.p_sound and r.expected_grade == pytest.approx(r.p_sound + r.p_best)


def test_quality_odd(spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, None), (4, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit_on(odd(spark), labels)
    assert quality.score_quality(odd(spark), model).count() == 8
    none = quality.fit_on(odd(spark), labels.limit(0))
    assert quality.select_documents(odd(spark), none).count() == 8
    assert quality.select_documents(odd(spark), model).columns == odd(spark).columns


# --- 10 personal data
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            n = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda n=n: 12 <= len(n) <= 19 and luhn(n), "phone": lambda n=n: 9 <= len(n) <= 15}[kind]()
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


CASES = [
    "a@b.c%x@d.e.f", "1.2.3.4.5.6.7.8 1.2.3.400.5.6 0001.002.3.255 999.1.1.1.1 00000000000000000000001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1111 4111  1111 41111111111111111111111", "+1 (2) 3-4.5 6789 +123456789 +1+2+3 +12345678901234567 +123 456 789 -",
    "é😀 x@y.zz 😀+49 (30) 1234567, a@@b.c a@b a.b@c..d é@x.y", "1 " * 20000, None, "", "x" * 5000 + "@" + "y" * 500, "." * 30000, "1." * 9000, "+" + "1-" * 9000,
]


def test_pii_base(spark, sf):
    d = docs(spark, CASES, 10**6).select("doc_id", "text").union(sample(spark, sf).select("doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    for r in pii.report(pii.find_spans(d)).collect():
        want = brute_spans(texts[r.doc_id])
        label = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == label
        assert r.base_sha256 == hashlib.sha256(label.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in PATTERNS]


TERM = re.compile(r"[^\W_]+")


def brute_terms(rows, reach=8, threshold=0.9, support=1, alpha=0.05):
    """For (id, text) rows: counts of the pairs near each other, disclosing terms, and all spans of every row."""
    term_list = lambda t: [(m.start(), m.end(), m[0].lower()) for m in TERM.finditer(t)]
    texts = [t or "" for _, t in rows]
    n_e, n_t, n_et, kinds = Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        spans = brute_spans(t)
        n_e.update({(k, t[a:b].lower()) for a, _, b, k in spans})
        n_t.update({x for _, _, x in term_list(t)})
        pairs = set()
        for a, _, b, k in spans:
            left, right = WORD.findall(t[:a])[-reach:], WORD.findall(t[b:])[:reach]
            pairs |= {((k, t[a:b].lower()), x) for w in left + right for _, _, x in term_list(w)}
        n_et.update(pairs)
        for p in pairs:
            kinds[p].add(t)
    n, found = len(rows), set()
    for (e, x), both in n_et.items():
        k = len(kinds[e, x])
        if k < support or not n_t[x]:
            continue
        often = max(n_t[x], both)
        info, mutual, mean = math.log(n / n_e[e]), math.log(n * both / (n_e[e] * often)), n_e[e] * often / n
        chance = (k - mean - k * math.log(k / mean) if k > mean else 0) + math.log(len(n_et))
        if info > 0 and mutual >= threshold * info and chance <= math.log(alpha):
            found.add((e, x, n_e[e], often, both, k))
    marked = {f[1] for f in found}
    out = []
    for t in texts:
        base = brute_spans(t)
        terms = [(a, 4, b, "term") for a, b, x in term_list(t) if x in marked and not any(a < e and s < b for s, _, e, _ in base)]
        out.append(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base + terms)))
    return n_et, found, out


def counted(spark, d, **options):
    _, spans, texts = pii.base_spans(d, "doc_id", "text")
    near = pii.context_terms(spans, texts, 8)
    options = {"threshold": 0.9, "support": 1, "alpha": 0.05} | options
    return near, pii.disclosing_terms(d, spans, near, "doc_id", "text", **options)


FILLER = "some common words stand in every text of this corpus and tell nothing"
LONG = "y" * 200
MENTIONS = [
    "card 4111 1111 1111 1111 exp 12/28 Zorblax", "zed@x.com b@y.org zed@x.com, Alpha c@z.net beta", f"Early {LONG} {LONG} {LONG}\tzed@x.com {LONG} {LONG} Later",
    "name:zed@x.com:tail +49 (30) 1234567 12 4111 1111 1111 1111x", "zed@x.comzed@x.com 1.2.3.4.5.6.7.8 end", "one two three four five six seven eight nine 1.2.3.4 one two three four five six seven eight nine",
]


def planted(n=6):
    texts = [f"{FILLER} v{i} Alias,\tZorblax! AKIA99ZZTOP12 {LONG} mail zed@x.com (Quuxville) {FILLER} then ZORBLAX, (quuxville)-road zorblax@y.com v{i}" for i in range(n)]
    return texts + ["Only the name: zorblax.", "İzorblax zorblax1 stay"] + [f"{FILLER} number {i}" for i in range(60)]


def test_pii_against_brute_force(spark, sf):
    real = [(r.doc_id, r.text) for r in sample(spark, sf).select("doc_id", "text").collect()]
    made = [(10**6 + i, t) for i, t in enumerate(CASES + MENTIONS + planted() + [MENTIONS[0], planted()[0]])]
    for rows in (real + made + made[-9:], [(i, t) for i, t in enumerate(MENTIONS)]):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        n_et, found, spans = brute_terms(rows)
        near, pairs = counted(spark, d)
        by_pair = near.groupBy("entity", "term").agg(F.sum("copies").alias("n")).collect()
        assert sorted(r.n for r in by_pair) == sorted(n_et.values())
        h = spark.createDataFrame([(list(PATTERNS).index(k), m, x, *n) for (k, m), x, *n in found], "k int, m string, x string, n_e long, n_t long, n_et long, texts long")
        want = h.select(F.xxhash64("k", "m").alias("entity"), F.xxhash64("x").alias("term"), "n_e", "n_t", "n_et", "texts").collect()
        assert sorted(map(tuple, want)) == sorted((r.entity, r.term, r.n_e, r.n_t, r.n_et, r.texts) for r in pairs.collect())
        got = pii.report(pii.find_spans(d)).collect()
        assert Counter((r.doc_id, r.spans, r.n_spans) for r in got) == Counter((i, x, len(x.split(",")) if x else 0) for (i, _), x in zip(rows, spans))


def test_pii_terms_are_marked_everywhere(spark):
    texts = planted()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id, Zorblax"), (6, texts[6])]
    names = ["span_doc", "span_hash", "spans", "text_hash", "th", "d", "row", "kind"]
    d = spark.createDataFrame([(*r, *([1] * len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = pii.sanitise(d, threshold=0.7)
    clean = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == d.columns and len(clean) == len(rows)
    for i, t in clean:  # also far from the mention, in documents without it, and terms with digits
        assert t == texts[i] if i is not None and i >= 7 else not re.search(r"(?i)zorblax|quuxville|akia99|alias", t)
    assert all(t.count("<EMAIL>") == 2 for i, t in clean if i is not None and i < 6)
    assert Counter(clean)[6, "Only the name: ."] == 2


def test_pii_chance_neighbours_stay(spark):
    texts = [f"{FILLER} word{i} mail{i}@x.com other{i}" for i in range(50)] + [f"{FILLER} w{i}" for i in range(50)]  # one sighting each
    assert all("term" not in r.spans for r in pii.report(pii.find_spans(docs(spark, texts))).collect())
    assert pii.report(pii.find_spans(odd(spark))).count() == 8 and pii.find_spans(odd(spark).limit(0)).count() == 0


# --- queries
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    r = con.execute(ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert Counter(tuple(x[i] for i in order) for x in r.fetchall()) == Counter(map(tuple, df.collect()))


def test_ten_operators_are_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES] == list(range(1, 11))
