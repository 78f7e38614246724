"""DuckDB SQL for the queries that SQL can express."""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(digest: str) -> str:
    five = lambda g: f"('0x' || substr({digest}, {1 + 5 * g}, 5))::BIGINT"
    return " || ".join(f"substr('{_BASE32}', ((({five(g)}) >> {s}) & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))


WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, {_base32("h")} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

# Windows of the benchmark's lengths; a document's windows of the same lengths; hit words are those inside any.
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: list_slice(w, i, i + least(len(w), 10) - 1))) AS win FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
docs AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
dwins AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM dwins) d JOIN wins x ON d.n = x.n AND d.win = x.win),
places AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, p.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN places p USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

# Votes of the rules from the counts, patterns of votes, 40 rounds of expectation-maximisation over them, posteriors.
_VOTED = (
    ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("2 * n_signs > n_words", "10 * n_signs <= 3 * n_words"),
    ("100 * n_letters < 75 * word_chars", "10 * n_letters >= 9 * word_chars"),
    ("5 * n_tails > n_words", "50 * n_tails <= n_words"),
    ("10 * n_upper > 4 * n_letters", "10 * n_upper <= 2 * n_letters"),
    ("100 * n_ends < n_words", "40 * n_ends >= n_words"),
    ("10 * n_small < n_words", "5 * n_small >= n_words"),
    ("3 * n_repeat_words > n_words", "10 * n_repeat_words <= n_words"),
    ("10 * n_echo > n_words", "20 * n_echo <= n_words"),
    ("10 * n_distinct < n_words", "10 * n_distinct >= 4 * n_words"),
)
_RULES = f"range(1, {len(_VOTED) + 1})"
_RATIO = "CASE {v} WHEN 1 THEN ln({s} / (1 - {p})) WHEN 0 THEN ln((1 - {s}) / {p}) ELSE 0 END"
_LOGIT = f"ln(e.prior / (1 - e.prior)) + list_sum(list_transform({_RULES}, lambda r: " + _RATIO.format(v="{votes}[r]", s="e.sound[r]", p="e.poor[r]") + "))"
_SHARE = "CASE WHEN p.failed THEN 0 ELSE 1 / (1 + exp(-(" + _LOGIT.format(votes="p.v") + "))) END"
_MAJORITY = "CASE WHEN p.failed THEN 0 ELSE len(list_filter(p.v, lambda x: x = 1)) / len(list_filter(p.v, lambda x: x >= 0)) END"


def _split(share: str) -> str:
    return f"list_transform(ps, lambda p: {{'v': p.v, 's': p.n * ({share}), 'p': p.n * (1 - ({share}))}})"


def _rate(key: str, vote: int, belief: float) -> str:
    total = lambda test: f"coalesce(list_sum(list_transform(q, lambda x: CASE WHEN x.v[r] {test} THEN x.{key} ELSE 0 END)), 0)"
    return f"({total(f'= {vote}')} + 2 * {belief}) / ({total('>= 0')} + 2)"


def _step(source: str) -> str:
    """A row i, prior, sound, poor from a row i, q."""
    sums = "coalesce(list_sum(list_transform(q, lambda x: x.{})), 0)".format
    poor = f"list_transform({_RULES}, lambda r: greatest({_rate('p', 0, 0.5)}, 1 - ({_rate('s', 1, 0.9)})))"
    return f"SELECT i, ({sums('s')} + 1) / ({sums('s')} + {sums('p')} + 2) AS prior, list_transform({_RULES}, lambda r: {_rate('s', 1, 0.9)}) AS sound, {poor} AS poor FROM ({source})"


_VOTES = ", ".join(f"CASE WHEN n_words < 50 THEN -1 WHEN {poor} THEN 0 WHEN {sound} THEN 1 ELSE -1 END" for poor, sound in _VOTED)
_HAS = r"len(list_filter(w, lambda x: regexp_matches(x, '{}')))::BIGINT".format
QUALITY_RULES = rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
wins AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, win FROM wins GROUP BY ALL HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM wins JOIN twice USING (doc_id, win)) GROUP BY doc_id),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper, length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters,
  length(regexp_replace(t, '[\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g')) AS n_signs, {_HAS(r"[^\p{L}\p{N}]{2}$")} AS n_tails, {_HAS(r"\p{L}[.!?]$")} AS n_ends, {_HAS(r"^\p{L}{1,3}$")} AS n_small,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echo, len(list_distinct(w)) AS n_distinct, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeated USING (doc_id)),
voted AS (SELECT *, [{_VOTES}] AS v, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
patterns AS (SELECT coalesce(list({{'v': v, 'failed': base_failed, 'n': n}}), []) AS ps FROM (SELECT v, base_failed, count(*)::DOUBLE AS n FROM voted WHERE n_words >= 50 GROUP BY v, base_failed) WHERE list_max(v) >= 0),
em AS (
  {_step("SELECT 0 AS i, " + _split(_MAJORITY) + " AS q FROM patterns")}
  UNION ALL
  {_step("SELECT e.i + 1 AS i, " + _split(_SHARE) + " AS q FROM em e, patterns WHERE e.i < 40")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({_LOGIT.format(votes="voted.v")}))) >= 0.5 AS kept
FROM voted, em e WHERE e.i = 40
"""

# Shortest runs of 50 words from and to each line with a word; of equal runs all but the first go, unless they overlap it.
LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, pos, ls[pos] AS line, len(regexp_extract_all(ls[pos], '[^\x20\x09-\x0D]+')) AS nw FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM l)),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM x WHERE nw > 0),
d AS (SELECT doc_id, list(line ORDER BY ord) AS lines, list(pos ORDER BY ord) AS p FROM y GROUP BY doc_id),
enough AS (SELECT a.doc_id, a.ord AS i, b.ord AS j FROM y a JOIN y b ON a.doc_id = b.doc_id AND b.ord >= a.ord AND b.upto - a.upto + a.nw >= 50),
runs AS (SELECT doc_id, i, min(j) AS j FROM enough GROUP BY doc_id, i UNION SELECT doc_id, max(i), j FROM enough GROUP BY doc_id, j),
named AS (SELECT r.doc_id, i, j, p, list_slice(lines, i, j) AS run FROM runs r JOIN d USING (doc_id)),
first AS (SELECT run, min({'d': doc_id, 'i': i}) AS f FROM named GROUP BY run HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT place) AS gone FROM (SELECT doc_id, unnest(range(p[i], p[j] + 1)) AS place FROM named JOIN first USING (run) WHERE doc_id <> f.d OR i >= f.i + len(run)) GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda k: NOT list_contains(gone, k)), lambda k: ls[k]), chr(10)) END AS text,
  coalesce(len(gone), 0)::BIGINT AS n_deleted
FROM l LEFT JOIN gone USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_warc": WARC, "op7_line_dedup": LINE_DEDUP, "op4_quality_rules": QUALITY_RULES, "op5_decontamination": DECONTAMINATION}
