"""SQL twins of the queries that SQL can express (DuckDB).

The others have none: edit distances over all lines, a trained classifier, alignments,
seeded draws and shuffles, boosted trees, and a tokenizer.  They are tested against brute force.
"""

from __future__ import annotations

from parlance.llm import conv_trie, minhash, periodic, quality, secrets, url_cascade
from parlance.llm.common import LOWER, SPACE, UPPER

ORACLE: dict[str, str] = {}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WORDS = f"regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')"

_rules = sorted(url_cascade.RULES, key=lambda r: -len(r[1] + r[2]))
_fits = [(f"(host = {lit(h)} OR ends_with(host, {lit('.' + h)})) AND starts_with(path, {lit(p)})", h + p, v) for v, h, p in _rules]
ORACLE["op1_url_filters"] = f"""
WITH cut AS (SELECT page_id, coalesce(html, '') AS html,
    CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
listed AS (SELECT DISTINCT host, path FROM parts
    WHERE host <> '' AND (length(html) - length(replace(html, '<p>', ''))) / 3 <= {url_cascade.THIN_PARAGRAPHS})
SELECT page_id, host, path, CASE {' '.join(f"WHEN {c} THEN {lit(r)}" for c, r, _ in _fits)} END AS rule,
  CASE {' '.join(f"WHEN {c} THEN {lit(v)}" for c, _, v in _fits)}
    WHEN EXISTS (SELECT 1 FROM listed l WHERE l.host = parts.host AND l.path = parts.path) THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""

_n = minhash.WORDS
ORACLE["op2_minhash_near_dedup"] = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{SPACE}]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {_n} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {_n} + 2), lambda i: array_to_string(w[i:i + {_n} - 1], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {minhash.NUMER} * (any_value(a.n) + any_value(b.n) - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.c, s.doc_id)) AS component_id,
  s.doc_id <= coalesce(m.c, s.doc_id) AS kept
FROM sets s LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON s.doc_id = m.a"""

_sql = {
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "bang_ratio": "(length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) / greatest(n_words, 1)",
    "upper_ratio": r"(length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) / greatest(length(t), 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "same_word_ratio": "1 - n_distinct / greatest(n_words, 1)",
    "long_word": "word_chars / greatest(n_words, 1)",
    "few_words": "CAST(-n_words AS DOUBLE)",
}
_p = quality.ALPHA
_first = "CASE " + " ".join(f"WHEN {m} > {c!r} THEN {i}" for i, (m, c) in enumerate(quality.PATH, 1)) + " END"
ORACLE["op6_quality_rules"] = f"""
WITH w AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
runs AS (SELECT doc_id, unnest(range(1, len(w) - {quality.WINDOW} + 2)) AS i, w FROM w WHERE len(w) >= {quality.WINDOW}),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW} - 1], ' ') AS x FROM runs),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM keyed) WHERE c > 1),
repeated AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS at FROM again, range({quality.WINDOW}) r(j)) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM
    (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^{SPACE}]') GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(list_distinct(w)) AS n_distinct
  FROM w LEFT JOIN repeated ON w.doc_id = repeated.doc_id LEFT JOIN line ON w.doc_id = line.doc_id),
m AS (SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {', '.join(f'{e} AS {k}' for k, e in _sql.items())} FROM c),
holdout AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
firsts AS (SELECT stratum, {_first} AS step FROM holdout),
tested AS (SELECT f.stratum, i, count(*) AS n, count(*) FILTER (step <= i) AS k FROM firsts f, range(1, {len(quality.PATH) + 1}) r(i) GROUP BY ALL),
failed AS (SELECT stratum, i FROM tested
  WHERE NOT (k < n * {_p!r} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({_p!r}) + (n - i) * ln(1 - {_p!r})))) <= {quality.DELTA!r} / (SELECT count(DISTINCT stratum) FROM holdout))),
passed AS (SELECT stratum, count(*) AS steps FROM tested t WHERE i < coalesce((SELECT min(i) FROM failed f WHERE f.stratum = t.stratum), 1000000) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({_first} > (SELECT steps FROM passed p WHERE p.stratum = m.stratum), true) AS kept
FROM m"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string: each byte enters once and is shifted out in eight steps."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    once = f"xor(xor(c, x) >> 1, CAST({0xEDB88320} AS UBIGINT) * (xor(c, x) & 1))"
    return f"xor(list_reduce(list_prepend(CAST({0xFFFFFFFF} AS UBIGINT), {steps}), lambda c, x: {once}), CAST({0xFFFFFFFF} AS UBIGINT))"


def _matches(pattern: str) -> str:
    """(rid, s, e, v) of the matches in ``d``; starts from the pieces between them."""
    p = lit(pattern)
    return f"""SELECT rid, s, s + length(v) AS e, v FROM (SELECT rid, v, sum(length(gap)) OVER o + coalesce(sum(length(v)) OVER (
      PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
        SELECT rid, unnest(range(len(vs))) AS i, unnest(vs) AS v, unnest(gaps[1:len(vs)]) AS gap FROM (
          SELECT rid, regexp_extract_all(t, {p}) AS vs, string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})))
      WINDOW o AS (PARTITION BY rid ORDER BY i))"""


_base = " UNION ALL ".join(
    f"SELECT rid, s, e, {k} AS k, {secrets.BASE_ROLES[k]} AS r FROM ({_matches(p)}) WHERE {c}" for k, (p, c) in enumerate((
        (secrets.ASSIGN, f"length(regexp_extract(v, {lit(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_LEAST}"),
        ("AKIA[A-Z0-9]+", "length(v) >= 16"), ("[0-9a-f]{2,}", "length(v) >= 32"))))
_mixed = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND (regexp_matches(v, '[A-Z]') OR regexp_full_match(v, '[0-9a-f]+'))"
_weak = " UNION ALL ".join(
    f"SELECT rid, e - length(regexp_extract(v, {lit(p)}, 1)) AS s, e, {g} AS g, {r} AS r FROM ({_matches(p)}) WHERE "
    + (_mixed if g == len(secrets.GENERATORS) - 1 else "true") for g, (r, p) in enumerate(secrets.GENERATORS))
_kinds = "[" + ", ".join(lit(k) for k in (*secrets.BASE, *secrets.ROLES)) + "]"
_near = " AND ".join(f"""({secrets.ROLES.index(a)} <> f.r OR EXISTS (SELECT 1 FROM parts p WHERE p.rid = f.rid AND p.r = {b} AND abs(p.s - f.s) <= {secrets.SCOPE}
    AND NOT EXISTS (SELECT 1 FROM breaks x WHERE x.rid = f.rid AND x.s >= least(p.s, f.s) AND x.s < greatest(p.s, f.s))))""" for a, b in (
        ("identifier", secrets.SECRET), ("secret", secrets.IDENTIFIER), ("endpoint", secrets.IDENTIFIER), ("endpoint", secrets.SECRET)))
ORACLE["op11_secret_scans"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_base}),
weak AS ({_weak}),
alone AS (SELECT w.* FROM weak w WHERE NOT EXISTS (SELECT 1 FROM weak x WHERE x.rid = w.rid AND x.g < w.g AND x.s < w.e AND w.s < x.e)
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s <= w.s AND b.e >= w.e)),
grown AS (SELECT * FROM alone w WHERE EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s < w.e AND w.s < b.e)),
free AS (SELECT * FROM alone EXCEPT SELECT * FROM grown),
parts AS (SELECT rid, s, r FROM base UNION ALL SELECT rid, s, r FROM free),
breaks AS ({_matches(secrets.EMPTY_LINE)}),
spanned AS (SELECT rid, s, k, e FROM base UNION ALL SELECT rid, s, {len(secrets.BASE)} + r, e FROM grown
  UNION ALL SELECT rid, s, {len(secrets.BASE)} + r, e FROM free f WHERE {_near}),
named AS (SELECT rid, k, s, e, {_kinds}[k + 1] || ':' || s || ':' || e AS name FROM spanned),
joined AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(name, ',' ORDER BY s, k) FILTER (k < {len(secrets.BASE)}) AS base, string_agg(name, ',' ORDER BY s, k, e) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined ON d.rid = joined.rid"""

_h = crc32("CAST(c AS VARCHAR)")
ORACLE["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
    coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % {conv_trie.HUNDRED} AS b, {_h} % {conv_trie.HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
turns AS (SELECT ids.c, t.pos, t.r, t.x, 0 AS own FROM ids JOIN t ON t.c = ids.b AND t.pos < h
  UNION ALL SELECT ids.c, t.pos, t.r, t.x, 1 FROM ids JOIN t ON t.c = ids.c AND t.pos >= h),
seqs AS (SELECT ids.c, coalesce(q.s, []) AS s FROM ids LEFT JOIN (
  SELECT c, list({{'r': r, 'x': x}} ORDER BY own, pos) AS s FROM turns GROUP BY c) q ON q.c = ids.c),
pre AS (SELECT c, d, len(s) AS n, md5(CAST(to_json(s[1:d]) AS VARCHAR)) AS key, CASE WHEN d > 0 THEN length(s[d].x) ELSE 0 END AS chars
  FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM seqs)),
node AS (SELECT key, d, min(c) AS c, count(*) AS n_convs, any_value(chars) AS chars,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM pre GROUP BY key, d),
linked AS (SELECT node.*, up.key AS above FROM node LEFT JOIN pre up ON up.c = node.c AND up.d = node.d - 1),
kids AS (SELECT above, count(*) AS n FROM linked WHERE above IS NOT NULL GROUP BY above),
sums AS (SELECT up.key, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((v.n_convs - 1) * v.chars) AS saved
  FROM node v JOIN pre up ON up.c = v.c AND up.d <= v.d LEFT JOIN kids ON kids.above = v.key GROUP BY up.key)
SELECT l.c AS conv_id, CAST(l.d AS BIGINT) AS depth, p.c AS parent_conv_id, l.n_convs, coalesce(kids.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(l.ends) AS ends_sha256
FROM linked l JOIN sums ON sums.key = l.key LEFT JOIN kids ON kids.above = l.key LEFT JOIN node p ON p.key = l.above"""

_k = periodic.CONTEXT
ORACLE["op13_periodic_runs"] = f"""
WITH hashed AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w, {crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents),
placed AS (SELECT *, CAST(h // 10 AS BIGINT) AS g, CAST(h // 10 % greatest(len(w), 1) AS BIGINT) AS a FROM hashed),
texts AS (SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i:
    w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) ELSE i END]) ELSE w END AS w FROM placed),
word AS (SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS x FROM texts),
gram AS (SELECT rid, i, array_to_string(w[i + 1:i + {_k}], ' ') AS x FROM (SELECT rid, w, unnest(range(len(w) - {_k - 1})) AS i FROM texts WHERE len(w) >= {_k})),
pair AS (SELECT b.rid, b.i, b.i - a.i AS q FROM gram a JOIN gram b ON a.rid = b.rid AND a.x = b.x AND a.i < b.i),
matched AS (SELECT rid, q, min(i) - q AS s, max(i) + {_k} AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pair)
  GROUP BY rid, q, island),
run AS (SELECT * FROM matched r WHERE e - s >= greatest({periodic.LEAST}, {periodic.TIMES} * q)
  AND NOT EXISTS (SELECT 1 FROM matched o WHERE o.rid = r.rid AND o.q < r.q AND o.s <= r.s AND o.e >= r.e)),
best AS (SELECT rid, arg_min({{'s': s, 'l': e - s, 'q': q}}, (-(e - s) / q, s, q)) AS r, count(*) AS n,
  string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, e)) AS i FROM run),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(best.n, 0) AS n_runs, r.s AS start, r.l AS length, r.q AS period, 1000 * r.l // r.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM texts LEFT JOIN best ON best.rid = texts.rid LEFT JOIN kept ON kept.rid = texts.rid"""
