"""DuckDB SQL for the corpus queries that SQL can express on whole tables.

Not expressed: op4 (its hash function), op5 and op9 (fitted models); these are tested against
brute force and held-out rows.
"""

from __future__ import annotations

from cloakwork.llm.decontamination import SLOP
from cloakwork.llm.licenses import DIGESTS, DROPPED, NOT_WORD, NOTICE_HINT, NOTICES, SPELLINGS, known, known_licenses
from cloakwork.llm.mixing import BLOCK_WORDS, MOST_PASSES, WEIGHTS
from cloakwork.llm.secrets import BASE_RULES, MORE_RULES
from cloakwork.llm.url_filters import PATH_RULES, PATTERN_RULES, URL

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ascii_lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


# --- op1 ---------------------------------------------------------------------


def _spans(order: int, rule) -> str:
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern
    part = f"regexp_extract(value, {q(pattern)}, {rule.part})"
    return f"""
    SELECT rid, '{rule.kind}' AS kind, {order} AS ord, place AS s, place + len(value) AS e FROM (
      SELECT rid, m[i] AS value, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS place
      FROM (SELECT rid, regexp_extract_all(t, {q(pattern)}) AS m, regexp_split_to_array(t, {q(pattern)}) AS g FROM d WHERE regexp_matches(t, {q(pattern)})) z,
           unnest(range(1, len(m) + 1)) AS u(i)) y WHERE len({part}) >= {rule.least}"""


_RULES = (*BASE_RULES, *MORE_RULES)
_BASE = ", ".join(q(r.kind) for r in BASE_RULES)
OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(_RULES))}),
j AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, ord) FILTER (kind IN ({_BASE})) AS base,
  string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, ord) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (rid)"""

# --- op2 ---------------------------------------------------------------------

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({ascii_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
sh AS (SELECT DISTINCT doc_id, list_slice(l, i, i + 3) AS s FROM w, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS u(i) WHERE len(l) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id"""

# --- op3 ---------------------------------------------------------------------

_WEIGHT = "CASE (rk - 1) % 3 " + " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS)) + " END"
OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS s,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(concat('mixture:', doc_id, ':', md5(coalesce(text, '')))) AS k FROM documents),
src AS (SELECT s, CAST(sum(size) AS BIGINT) AS w FROM d GROUP BY s),
rk AS (SELECT *, row_number() OVER (ORDER BY s) AS rk, CAST(sum(w) OVER () AS BIGINT) AS t, count(*) OVER () AS ns FROM src),
wt AS (SELECT *, {_WEIGHT} AS g FROM rk),
-- Reshare again and again: each round caps the sources that stand above their most.
fill AS (SELECT 0 AS round, list({{'s': s, 'w': w, 'g': g, 'c': false}}) AS l, any_value(t) AS t FROM wt
  UNION ALL
  SELECT round + 1, list_transform(l, lambda e: {{'s': e.s, 'w': e.w, 'g': e.g, 'c': e.c OR e.g * lv > {MOST_PASSES} * e.w}}), t
  FROM (SELECT *, (t - coalesce(list_sum(list_transform(list_filter(l, lambda e: e.c), lambda e: {MOST_PASSES} * e.w)), 0)) / list_sum(list_transform(list_filter(l, lambda e: NOT e.c), lambda e: e.g)) AS lv FROM fill) q
  WHERE round < len(l)),
fin AS (SELECT l, (t - coalesce(list_sum(list_transform(list_filter(l, lambda e: e.c), lambda e: {MOST_PASSES} * e.w)), 0)) / list_sum(list_transform(list_filter(l, lambda e: NOT e.c), lambda e: e.g)) AS lv FROM fill ORDER BY round DESC LIMIT 1),
tg AS (SELECT e.s AS s, CASE WHEN e.c THEN CAST({MOST_PASSES} * e.w AS DOUBLE) ELSE e.g * lv END AS target FROM (SELECT unnest(l) AS e, lv FROM fin) q),
b AS (SELECT *, {BLOCK_WORDS} AS b FROM wt JOIN tg USING (s)),
seats AS (SELECT s, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, s, k) AS place, t // b AS blocks FROM b, unnest(range(0, CAST(target / b + ns + 2 AS BIGINT))) AS u(k)),
won AS (SELECT s, h, count(*) AS q FROM seats, unnest(range(0, 8)) AS v(h) WHERE place <= blocks * (h + 1) // 8 GROUP BY s, h),
parts AS (SELECT s, w, target, h, least(coalesce(lag(q) OVER (PARTITION BY s ORDER BY h), 0) * b, {MOST_PASSES} * w) AS low, least(coalesce(q, 0) * b, {MOST_PASSES} * w) AS high
  FROM (SELECT * FROM b, unnest(range(0, 8)) AS v(h)) bh LEFT JOIN won USING (s, h)),
laid AS (SELECT row_number() OVER () AS rid, d.*, w, coalesce(sum(size) OVER (PARTITION BY s ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN src USING (s)),
took AS (SELECT rid, h, CAST(sum(greatest(0, least(high, start + p * laid.w + size) - greatest(low, start + p * laid.w))) AS BIGINT) AS words
  FROM laid JOIN parts USING (s), unnest(range(0, {MOST_PASSES})) AS v(p) GROUP BY rid, h),
summed AS (SELECT rid, CAST(sum(words) AS BIGINT) AS taken, string_agg(concat(h, ':', words), ',' ORDER BY h) FILTER (words > 0) AS shards FROM took GROUP BY rid)
SELECT doc_id, size, laid.w AS source_size, target, taken, coalesce(shards, '') AS shards FROM laid JOIN summed USING (rid) JOIN tg USING (s)"""

# --- op6 ---------------------------------------------------------------------


_SPELLED = "CASE w " + " ".join(f"WHEN {q(one)} THEN {q(other)}" for one, other in SPELLINGS) + " ELSE w END"


def _canonical(text: str) -> str:
    """Word by word, unlike the Spark expression."""
    words = f"list_filter(regexp_split_to_array(regexp_replace({ascii_lower(text)}, {q(DROPPED)}, ' ', 'g'), {q(NOT_WORD)}), lambda w: w <> '')"
    return f"array_to_string(list_transform({words}, lambda w: {_SPELLED}), ' ')"


_WHOLE = known(NOTICES) | known_licenses() | DIGESTS
_VALUES = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(_WHOLE.items()))
_BY_LINE = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(known(NOTICES).items()))
OP6 = f"""
WITH k(digest, license) AS (VALUES {_VALUES}), n(digest, notice) AS (VALUES {_BY_LINE}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT rid, sha256({_canonical("t")}) AS digest FROM d),
l AS (SELECT rid, sha256({_canonical("line")}) AS digest FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) x WHERE regexp_matches(line, {q(NOTICE_HINT)})),
f AS (SELECT rid, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices, count(*) AS c FROM l JOIN n USING (digest) GROUP BY rid)
SELECT doc_id, h.digest AS text_sha256, license, coalesce(notices, '') AS notices, coalesce(c, 0) AS n_notices
FROM d JOIN h USING (rid) LEFT JOIN k ON k.digest = h.digest LEFT JOIN f ON f.rid = d.rid"""

# --- op7 ---------------------------------------------------------------------

_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({ascii_lower("coalesce(text, '')")}, {_WORD}) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({ascii_lower("coalesce(text, '')")}, {_WORD}) AS w FROM benchmark),
win AS (SELECT DISTINCT item, list_slice(w, i, i + 9) AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT len(g) AS n FROM win),
pos AS (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS g FROM d, size, unnest(range(1, len(w) - n + 2)) AS u(i)),
occ AS (SELECT rid, i, n, item FROM pos JOIN win USING (g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) x GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY rid),
til AS (SELECT DISTINCT item, list_slice(w, least(i, greatest(len(w) - 9, 1)), least(i, greatest(len(w) - 9, 1)) + 9) AS g FROM b, unnest(range(1, len(w) + 1, 10)) AS u(i)),
tile AS (SELECT g, row_number() OVER () AS tile, len(g) AS n, CASE WHEN len(g) < 10 THEN len(g) ELSE 8 END AS need FROM (SELECT DISTINCT g FROM til) x),
term AS (SELECT tile, n, need, place, g[place] AS word FROM tile, unnest(range(1, n + 1)) AS u(place)),
post AS (SELECT rid, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p) WHERE w[p] IN (SELECT word FROM term)),
st AS (SELECT rid, tile, n, need, place, p, p - place AS s FROM post JOIN term USING (word) QUALIFY count(*) OVER (PARTITION BY rid, tile) >= need),
around AS (SELECT rid, tile, n, need, list(place) OVER f AS places, list(p) OVER f AS ps FROM st
  WINDOW f AS (PARTITION BY rid, tile ORDER BY s RANGE BETWEEN CURRENT ROW AND {SLOP} FOLLOWING)),
near AS (SELECT rid, tile, max(held / n) AS share FROM (SELECT rid, tile, n, need, least(len(list_distinct(places)), len(list_distinct(ps))) AS held FROM around) x WHERE held >= need GROUP BY ALL),
nits AS (SELECT rid, max(share) AS share, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM near JOIN tile USING (tile) JOIN til USING (g) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
  sha256(coalesce(its.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(share, CAST(0 AS DOUBLE)) AS near_share, coalesce(nits.n_items, 0) AS n_near_items, sha256(coalesce(nits.items, '')) AS near_items_sha256,
  share IS NOT NULL AS near_contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid) LEFT JOIN nits USING (rid)"""

# --- op8 ---------------------------------------------------------------------

_CRC_TABLE = []
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC_TABLE.append(_c)
OP8 = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS c),
d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS s,
  coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT rid, xor(4294967295::BIGINT, coalesce(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(range(1, len(h) + 1, 2), lambda i: CAST(concat('0x', substr(h, i, 2)) AS BIGINT))),
  lambda a, x: xor(a >> 8, c[CAST(xor(a, x) & 255 AS INT) + 1]::BIGINT)), 4294967295)) AS crc FROM d, tab),
e AS (SELECT *, md5(concat('interleave:', doc_id, ':', crc)) AS k FROM d JOIN crc USING (rid)),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id, crc) - 1 AS a, count(*) OVER (PARTITION BY s) AS n FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY (2 * a + 1) / (2 * n), s, k, doc_id, crc) - 1 AS g, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(strlen(t) + 16 AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(g * 40 // total AS INT) AS shard,
  g - ((g * 40 // total) * total + 39) // 40 AS slot, CAST(NULL AS INT) AS grown_shard FROM g"""

# --- op10 --------------------------------------------------------------------

_PATHS = ", ".join(f"({q(r.name)}, {q(r.verdict)}, {q(r.host)}, {q(r.prefix)})" for r in PATH_RULES)
_PATTERNS = ", ".join(f"({q(r.name)}, {q(r.verdict)}, {q(r.regex)})" for r in PATTERN_RULES)
OP10 = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, {ascii_lower(f"coalesce(regexp_extract(url, {q(URL)}, 1), '')")} AS host, coalesce(regexp_extract(url, {q(URL)}, 2), '') AS path FROM pages),
r(rule, verdict, h, b) AS (VALUES {_PATHS}), x(name, verdict, regex) AS (VALUES {_PATTERNS}),
best AS (SELECT rid, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS v FROM p JOIN r ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, b) GROUP BY rid),
pat AS (SELECT rid, min(name) AS pattern_rule, arg_min(verdict, name) AS v FROM p JOIN x ON regexp_matches(concat(host, path), regex) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(best.v, pat.v, 'allow') AS verdict, pattern_rule FROM p LEFT JOIN best USING (rid) LEFT JOIN pat USING (rid)"""

ORACLES = {
    "op1_secret_automaton": OP1,
    "op2_hyperminhash_groups": OP2,
    "op3_source_mix": OP3,
    "op6_license_digests": OP6,
    "op7_benchmark_hits": OP7,
    "op8_interleaved_shards": OP8,
    "op10_url_rules": OP10,
}
