"""SQL twins of the registered queries, in DuckDB's dialect.

Written independently of the DataFrame code: set-at-a-time joins where the
engine uses row-local expressions, RE2 patterns where it uses Java ones.  Only
rule data is shared.
"""

from __future__ import annotations

import re

from parlance.plans import views as V
from parlance.rules import corpus as C
from parlance.rules import language as L
from parlance.rules import safety as R
from parlance.rules import sessions as S
from parlance.rules import sets as RS
from parlance.rules import tags as T


def lit(s: str) -> str:
    """SQL string literal; control characters are spelled with chr()."""
    out = "'" + s.replace("'", "''") + "'"
    return out.replace("\n", "' || chr(10) || '") if "\n" not in s else "(" + out.replace("\n", "' || chr(10) || '") + ")"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def rows(pairs) -> str:
    return ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in p) + ")" for p in pairs)


CTE: dict[str, str] = {}


def sql(body: str) -> str:
    """Prefix ``body`` with the common table expressions it needs."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTE[name])
                if name not in need:
                    need.append(name)

    visit(body)
    if not need:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in need) + "\n" + body


def plain(text: str, **names: str) -> str:
    for k in ("events", "documents", "benchmark", "conversations", "labels", "chat"):
        text = text.replace("{" + k + "}", names.get(k, k))
    return text


# ---- derived inputs ---------------------------------------------------------
CTE["chat_base"] = plain(V.CHAT_EVENTS)
CTE["chat"] = """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, message_id) - 1 AS turn FROM chat_base"""
CTE["texts"] = plain(V.TEXTS)
CTE["conv"] = plain(V.CONVERSATION_TURNS)
CTE["sheet"] = plain(V.TAG_SHEET)
CTE["existing_in"] = plain(V.EXISTING_TAGS)
CTE["feedback_in"] = plain(V.FEEDBACK)
CTE["rules_in"] = f"SELECT * FROM (VALUES {rows(T.DEFAULT_TAG_RULES)}) r(keyword, tag)"
CTE["official_in"] = f"SELECT * FROM (VALUES {rows([(t,) for t in T.DEFAULT_OFFICIAL_TAGS])}) o(tag)"
CTE["conflicts_in"] = f"SELECT * FROM (VALUES {rows(T.CONFLICTS)}) c(winner, loser)"
CTE["rule_tags_in"] = """SELECT DISTINCT r.keyword, o.tag FROM rules_in r JOIN official_in o ON lower(r.tag) = lower(o.tag)
WHERE NOT starts_with(lower(r.tag), 'language:')"""


# ---- screening --------------------------------------------------------------
def hit_expr(text: str, rules=R.INJECTION_RULES) -> str:
    parts = []
    for label, p in rules:
        pat = lit(("(?im)" if label in R.MULTILINE_RULES else "(?i)") + p)
        parts.append(f"CASE WHEN regexp_matches({text}, {pat}) THEN {{'label': '{label}', "
                     f"'snippet': substr(regexp_extract({text}, {pat}, 0), 1, {R.INJECTION_SNIPPET_CHARS})}} END")
    return "list_filter([" + ",\n".join(parts) + "], lambda h: h IS NOT NULL)"


def nsfw_expr(text: str) -> str:
    parts = [f"CASE WHEN regexp_matches({text}, {lit('(?i)' + p)}) THEN '{c}' END" for c, p in R.NSFW_RULES]
    return "list_filter([" + ",\n".join(parts) + "], lambda c: c IS NOT NULL)"


def strip(x: str) -> str:
    return f"replace(replace(replace({x}, chr(2), ''), chr(3), ''), chr(4), '+')"


def pii_step(i: int, rule) -> tuple[str, str, str]:
    """(values, gaps, masked) expressions over m{i-1}.

    RE2 has no look-around.  Digit runs are fenced with control characters to
    express "not next to a digit"; a plus sign that may not start a match is
    swapped for a control character.
    """
    kind, pattern, token = rule
    m = f"m{i - 1}"
    if "(?<!" in pattern:
        src = rf"regexp_replace(regexp_replace({m}, '(\d)\+', '\1' || chr(4), 'g'), '(\d+)', chr(2) || '\1' || chr(3), 'g')"
        pattern = r"\x02(?:0[5-7]\d{8}|00212[5-7]\d{8})\x03|\+\x02212(?:[5-7]\d{8}\x03|\x03[\s\-]\x02[5-7]\d{8}\x03)"
        fix = strip
    elif "(?!212)" in pattern:
        src = f"replace({m}, '+212', chr(4) || '212')"
        pattern = pattern.replace("(?!212)", "")
        fix = strip
    else:
        src, fix = m, (lambda x: x)
    p = lit(pattern)
    values = f"list_transform(regexp_extract_all({src}, {p}, 0), lambda x: {fix('x')})"
    gaps = f"list_transform(string_split_regex({src}, {p}), lambda x: length({fix('x')}))"
    return values, gaps, fix(f"regexp_replace({src}, {p}, {lit(token)}, 'g')")


def pii_chain(prefix: str, source: str, keys: str, text: str, where: str = "true", rules=R.PII_RULES) -> str:
    """Register CTEs ``{prefix}0..n`` and ``{prefix}_m`` (one row per match)."""
    CTE[f"{prefix}0"] = f"SELECT {keys}, CASE WHEN {where} THEN {text} END AS m0 FROM {source}"
    vals = ""
    for i, rule in enumerate(rules, 1):
        v, g, m = pii_step(i, rule)
        vals += f", v{i}, g{i}"
        CTE[f"{prefix}{i}"] = f"SELECT * , {v} AS v{i}, {g} AS g{i}, {m} AS m{i} FROM {prefix}{i - 1}"
    last = len(rules)
    parts = []
    for i, (kind, _, _) in enumerate(rules, 1):
        parts.append(
            f"SELECT {keys}, {i} AS ord, '{kind}' AS pii_type, k - 1 AS ordinal, v{i}[k] AS value, "
            f"coalesce(list_sum(g{i}[1:k]), 0) + coalesce(list_sum(list_transform(v{i}[1:k - 1], lambda x: length(x))), 0) AS pos "
            f"FROM {prefix}{last}, unnest(range(1, len(v{i}) + 1)) u(k)")
    CTE[f"{prefix}_m"] = (
        f"SELECT {keys}, ord, pii_type, ordinal, value, substr(sha256(value), 1, {R.FINGERPRINT_CHARS}) AS value_hash, "
        f"CAST(pos AS BIGINT) AS \"start\", CAST(pos + length(value) AS BIGINT) AS \"end\" FROM ("
        + " UNION ALL ".join(parts) + ")")
    return f"{prefix}{last}"


def screen(prefix: str, source: str, keys: str, injection=R.INJECTION_RULES, pii=R.PII_RULES) -> None:
    """CTE ``{prefix}``: verdict columns for every row of ``source``."""
    k = keys.split(", ")
    CTE[f"{prefix}_a"] = f"SELECT *, {hit_expr('text', injection)} AS hits FROM {source}"
    CTE[f"{prefix}_b"] = (f"SELECT *, CASE WHEN len(hits) >= {R.INJECTION_BLOCK_THRESHOLD} THEN [] "
                          f"ELSE {nsfw_expr('text')} END AS cats FROM {prefix}_a")
    CTE[f"{prefix}_c"] = (f"SELECT *, CASE WHEN len(hits) >= {R.INJECTION_BLOCK_THRESHOLD} THEN 'injection' "
                          f"WHEN len(cats) > 0 THEN 'nsfw' ELSE '' END AS block_layer FROM {prefix}_b")
    end = pii_chain(f"{prefix}p", f"{prefix}_c", keys, "text", "block_layer = ''", pii)
    CTE[f"{prefix}_t"] = (
        f"SELECT {keys}, count(*) AS pii_count, string_agg(DISTINCT pii_type, '|' ORDER BY pii_type) AS pii_types "
        f"FROM {prefix}p_m GROUP BY ALL")
    on = " AND ".join(f"c.{x} = {{o}}.{x}" for x in k)
    hit_text = "list_transform(hits, lambda h: h.label || ':''' || h.snippet || '''')"
    CTE[prefix] = f"""
SELECT c.* EXCLUDE (hits, cats),
  CASE block_layer WHEN 'injection' THEN {lit(R.BLOCKED_INJECTION_TEXT)} WHEN 'nsfw' THEN {lit(R.BLOCKED_NSFW_TEXT)}
    ELSE m.m{len(pii)} END AS masked_text,
  block_layer <> '' AS is_blocked,
  CASE block_layer WHEN 'injection' THEN {lit(R.INJECTION_REASON)} || array_to_string({hit_text}, ', ')
    WHEN 'nsfw' THEN {lit(R.NSFW_REASON)} || array_to_string(cats, ', ') ELSE '' END AS block_reason,
  array_to_string(list_transform(hits, lambda h: h.label), '|') AS injection_labels,
  array_to_string({hit_text}, '|') AS injection_hits,
  array_to_string(cats, '|') AS nsfw_categories,
  coalesce(t.pii_types, '') AS pii_types, coalesce(t.pii_count, 0) AS pii_count
FROM {prefix}_c c JOIN {end} m ON {on.format(o='m')} LEFT JOIN {prefix}_t t ON {on.format(o='t')}"""


screen("sx", "texts", "text_id, origin")
screen("sc", "chat", "message_id")
_more = sorted([*RS.BASE_ROWS, *RS.EXTENDED_ROWS], key=lambda r: (r[1], r[2]))
screen("se", "texts", "text_id, origin", [(r[3], r[4]) for r in _more if r[1] == "injection"], [r[3:6] for r in _more if r[1] == "pii"])
pii_chain("px", "texts", "text_id, origin", "text")
pii_chain("pu", "chat", "message_id, user_id, ts", "text")


# ---- language and tags ------------------------------------------------------
def language(t: str) -> str:
    ar = r"'[\x{0600}-\x{06ff}]'"
    mixed = f"string_split_regex(lower({t}), '[^a-z0-9]+')"
    w = f"string_split_regex(lower({t}), '[^a-z'']+')"
    accents = "[" + L.FRENCH_ACCENTS + "]"
    return f"""CASE WHEN regexp_matches({t}, {ar})
    THEN CASE WHEN len(list_intersect({mixed}, {arr(L.DARIJA_WORDS)})) > 0 THEN 'darija' ELSE 'arabic' END
  WHEN len(list_intersect({w}, {arr(L.DARIJA_MARKERS)})) > 0 THEN 'darija'
  WHEN len(list_intersect({w}, {arr(L.FRENCH_WORDS)}))
    + CASE WHEN regexp_matches({t}, '{accents}') THEN {L.FRENCH_ACCENT_WEIGHT} ELSE 0 END
    >= len(list_intersect({w}, {arr(L.ENGLISH_WORDS)})) THEN 'french' ELSE 'english' END"""


def script_tag(t: str) -> str:
    darija = " OR ".join(f"contains(lower({t}), {lit(w)})" for w in L.DARIJA_TAG_SUBSTRINGS)
    return (f"CASE WHEN {darija} THEN '{T.TAG_DARIJA}' WHEN len(regexp_extract_all({t}, '[\\x{{0600}}-\\x{{06ff}}]')) > "
            f"{L.ARABIC_TAG_MIN_CHARS} THEN '{T.TAG_ARABIC}' ELSE '' END")


def tag_ctes(prefix: str, source: str, keys: str, text: str, extra: str = "") -> None:
    """``{prefix}_k`` keyword tags, ``{prefix}_r`` all lower-cased candidate tags, ``{prefix}_f`` final tags."""
    CTE[f"{prefix}_k"] = (f"SELECT DISTINCT {keys}, r.tag FROM {source} s JOIN rule_tags_in r "
                          f"ON contains(lower(s.{text}), r.keyword)")
    CTE[f"{prefix}_s"] = f"SELECT {keys}, tag FROM (SELECT {keys}, {script_tag(text)} AS tag FROM {source}) WHERE tag <> ''"
    CTE[f"{prefix}_r"] = (f"SELECT DISTINCT {keys}, lower(tag) AS tag FROM (SELECT * FROM {prefix}_k UNION ALL "
                          f"SELECT * FROM {prefix}_s {extra})")
    k = " AND ".join(f"w.{x} = r.{x}" for x in keys.split(", "))
    CTE[f"{prefix}_f"] = (f"SELECT * FROM {prefix}_r r WHERE NOT EXISTS (SELECT 1 FROM conflicts_in c JOIN {prefix}_r w "
                          f"ON w.tag = c.winner WHERE c.loser = r.tag AND {k})")
    CTE[f"{prefix}_j"] = f"SELECT {keys}, string_agg(tag, '|' ORDER BY tag) AS tags FROM {prefix}_f GROUP BY ALL"


def exploded(col: str, sep: str) -> str:
    return f"unnest(string_split({col}, '{sep}'))"


tag_ctes("tx", "texts", "text_id, origin", "text")
tag_ctes("te", "existing_in", "message_id", "text")
tag_ctes("tm", "chat", "message_id", "text",
         f"UNION ALL SELECT * FROM (SELECT message_id, {exploded('model_tags', '|')} AS tag FROM chat) WHERE tag <> ''")
CTE["sc_open"] = "SELECT * FROM sc WHERE NOT is_blocked"
tag_ctes("ts", "sc_open", "message_id", "masked_text",
         f"UNION ALL SELECT * FROM (SELECT message_id, {exploded('model_tags', '|')} AS tag FROM sc_open) WHERE tag <> ''")
# Screened chat turns with language and tags.
CTE["turns"] = f"""
SELECT s.*, CASE WHEN is_blocked THEN coalesce(lang_hint, 'unknown') ELSE {language('masked_text')} END AS lang,
  coalesce(j.tags, '') AS tags
FROM sc s LEFT JOIN ts_j j ON s.message_id = j.message_id"""

# What each screening was given: the reply after a message that was let pass has the message's intent, tags, language.
CTE["calls"] = """
SELECT t.*, CASE WHEN p.role IS NOT NULL THEN p.intent ELSE '' END AS call_intent, coalesce(p.tags, '') AS call_tags,
  CASE WHEN p.role IS NOT NULL THEN p.lang WHEN t.role = 'user' THEN coalesce(t.lang_hint, 'unknown') ELSE 'unknown' END AS call_lang
FROM turns t LEFT JOIN turns p ON p.session_id = t.session_id AND p.turn = t.turn - 1 AND t.role = 'assistant' AND p.role = 'user'
  AND NOT p.is_blocked"""

ORACLE: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    ORACLE[name] = sql(body)


# ---- sources and sinks ------------------------------------------------------
oracle("turn_source", "SELECT session_id, turn, user_id, role, text, lang_hint FROM conv")
oracle("turn_quarantine", f"""
SELECT doc_id, source AS user_id, length(text) AS chars,
  CASE WHEN text IS NULL OR length(text) < {S.MESSAGE_CHARS[0]} THEN 'message_empty'
       WHEN length(text) > {S.MESSAGE_CHARS[1]} THEN 'message_too_long'
       WHEN source IS NULL OR length(source) < {S.USER_ID_CHARS[0]} THEN 'user_id_empty'
       WHEN length(source) > {S.USER_ID_CHARS[1]} THEN 'user_id_too_long' ELSE 'accepted' END AS status
FROM documents""")
oracle("labelled_source", """
SELECT d.doc_id, d.text AS user_msg, d.lang AS intent,
  (CASE WHEN l.quality = 1 THEN 'quality:high' ELSE 'quality:low' END)
  || (CASE WHEN l.toxic = 1 THEN ',toxic' ELSE '' END) AS tag
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL AND d.lang IS NOT NULL""")
oracle("official_tags", """
SELECT lower(tag) AS tag_lower, arg_max(tag, first_row) AS tag FROM (
  SELECT trim(tag) AS tag, min(row_no) AS first_row FROM sheet WHERE trim(tag) <> '' GROUP BY trim(tag)) GROUP BY lower(tag)""")
_AUDIT = """
SELECT epoch_us(ts) AS ts_us, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_human, user_id, session_id, {role} AS role, {lang} AS lang, {intent} AS intent,
  {tags} AS tags, {text} AS content_masked, block_layer = 'injection' AS injection_blocked, injection_hits AS injection_labels,
  block_layer = 'nsfw' AS nsfw_blocked, nsfw_categories, pii_types AS pii_detected, pii_count, is_blocked,
  block_reason, block_layer, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM calls"""
AUDIT = (_AUDIT.format(role="role", lang="call_lang", intent="call_intent", tags="call_tags", text="masked_text") + " UNION ALL "
         + _AUDIT.format(role="'intent'", lang="lang", intent="intent", tags="tags", text="''") + " WHERE role = 'user' AND NOT is_blocked")
oracle("audit_log", AUDIT)
oracle("stream_guardrail", AUDIT)
oracle("pii_vault", """
SELECT epoch_us(ts) AS ts_us, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_human, user_id, session_id, v.pii_count, v.pii_raw,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date
FROM sc JOIN (SELECT message_id, count(*) AS pii_count, string_agg(pii_type || '=' || value, '|' ORDER BY ord, ordinal) AS pii_raw
              FROM scp_m GROUP BY ALL) v ON sc.message_id = v.message_id""")
oracle("feedback_log", f"""
SELECT epoch_us(ts) AS ts_us, session_id, message_index, rating, comment FROM feedback_in
WHERE rating BETWEEN {S.RATING_RANGE[0]} AND {S.RATING_RANGE[1]}""")

# ---- safety -----------------------------------------------------------------
oracle("injection_matches", """
SELECT text_id, origin, h.label AS label, h.snippet AS snippet FROM (SELECT text_id, origin, unnest(hits) AS h FROM sx_a)""")
oracle("injection_blocked", f"""
SELECT text_id, origin, len(hits) >= {R.INJECTION_BLOCK_THRESHOLD} AS is_injection, len(hits) AS n_hits,
  array_to_string(list_transform(hits, lambda h: h.label), '|') AS labels,
  CASE WHEN len(hits) >= {R.INJECTION_BLOCK_THRESHOLD} THEN {lit(R.INJECTION_REASON)} ||
    array_to_string(list_transform(hits, lambda h: h.label || ':''' || h.snippet || ''''), ', ') ELSE '' END AS block_reason
FROM sx_a""")
oracle("nsfw_matches", f"""
SELECT text_id, origin, {lit(R.NSFW_REASON)} || array_to_string(cats, ', ') AS block_reason, unnest(cats) AS category
FROM (SELECT *, {nsfw_expr('text')} AS cats FROM texts)""")
oracle("guardrail_verdict", """
SELECT text_id, origin, is_blocked, block_layer, block_reason, masked_text, injection_labels, nsfw_categories, pii_types, pii_count
FROM sx""")
oracle("guardrail_extended", """
SELECT text_id, origin, is_blocked, block_layer, block_reason, masked_text, injection_labels, nsfw_categories, pii_types, pii_count
FROM se""")
oracle("pii_matches", 'SELECT text_id, origin, pii_type, ordinal, value_hash, "start", "end" FROM px_m')
oracle("pii_masked", f"SELECT text_id, origin, m{len(R.PII_RULES)} AS masked_text FROM px{len(R.PII_RULES)}")
oracle("pii_type_summary", """
SELECT origin, pii_type, count(DISTINCT text_id) AS texts, count(*) AS matches, count(DISTINCT value_hash) AS distinct_values
FROM px_m GROUP BY ALL""")
oracle("pii_fingerprints", """
SELECT pii_type, value_hash, count(DISTINCT text_id) AS texts, count(*) AS matches FROM px_m GROUP BY ALL
HAVING count(DISTINCT text_id) >= 2""")
oracle("pii_user_fingerprints", """
SELECT user_id, pii_type, value_hash, count(*) AS n, arg_min(message_id, (ts, message_id)) AS first_message
FROM pu_m GROUP BY ALL""")
oracle("response_leaks", """
SELECT role, count(*) AS turns, count(*) FILTER (is_blocked) AS blocked, count(*) FILTER (pii_count > 0) AS with_pii,
  round(count(*) FILTER (is_blocked) / count(*), 6) AS block_rate,
  round(count(*) FILTER (pii_count > 0) / count(*), 6) AS leak_rate FROM sc GROUP BY role""")

# ---- tags and language ------------------------------------------------------
oracle("keyword_tags", "SELECT text_id, origin, tag FROM tx_k")
oracle("keyword_tags_indexed", """
SELECT DISTINCT text_id, origin, tag FROM texts t JOIN (
  SELECT DISTINCT k AS keyword, 'Word:' || substr(k, 1, 2) AS tag FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS k FROM benchmark)) r
ON contains(lower(t.text), r.keyword)""")
oracle("script_tags", f"SELECT text_id, origin, {script_tag('text')} AS script_tag FROM texts")
oracle("tag_precedence", f"""
SELECT e.message_id, e.existing, coalesce(v.tags, replace(j.tags, '|', ', '), '{T.UNTAGGED}') AS tags FROM existing_in e
LEFT JOIN (SELECT message_id, string_agg(part, ', ' ORDER BY pos) AS tags FROM (
    SELECT message_id, regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS part, pos FROM (
      SELECT message_id, unnest(string_split(lower(existing), ',')) AS p,
             unnest(range(len(string_split(existing, ',')))) AS pos FROM existing_in))
  WHERE part IN (SELECT lower(tag) FROM official_in) GROUP BY message_id) v ON e.message_id = v.message_id
LEFT JOIN te_j j ON e.message_id = j.message_id""")
CTE["txk_l"] = "SELECT DISTINCT text_id, origin, lower(tag) AS tag FROM tx_k"
oracle("tag_conflicts", """
SELECT t.text_id, t.origin, coalesce(a.tags, '') AS tags, coalesce(b.n, 0) AS before FROM texts t
LEFT JOIN (SELECT text_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM txk_l r
   WHERE NOT EXISTS (SELECT 1 FROM conflicts_in c JOIN txk_l w ON w.tag = c.winner WHERE c.loser = r.tag AND w.text_id = r.text_id)
   GROUP BY text_id) a ON t.text_id = a.text_id
LEFT JOIN (SELECT text_id, count(*) AS n FROM tx_k GROUP BY text_id) b ON t.text_id = b.text_id""")
oracle("tag_merge", "SELECT c.message_id, coalesce(j.tags, '') AS tags FROM chat c LEFT JOIN tm_j j ON c.message_id = j.message_id")
oracle("language_id", f"SELECT text_id, origin, {language('text')} AS lang FROM texts")
oracle("language_profile", f"""
SELECT declared, detected, n, round(n / sum(n) OVER (PARTITION BY declared), 6) AS share
FROM (SELECT lang AS declared, {language('text')} AS detected, count(*) AS n FROM documents GROUP BY ALL)""")
oracle("language_resolved", "SELECT message_id, lang_hint, lang FROM turns")
CTE["tag_vocab"] = f"""
SELECT tag, n, round(n / (SELECT count(*) FROM texts), 6) AS share, row_number() OVER (ORDER BY n DESC, tag) - 1 AS tag_index
FROM (SELECT tag, count(*) AS n FROM tx_f GROUP BY tag) WHERE n >= {C.MIN_TAG_FREQ}"""
oracle("tag_frequency", "SELECT tag, n, share, tag_index FROM tag_vocab")
oracle("tag_multi_hot", """
SELECT t.text_id, t.origin, string_agg(CASE WHEN f.tag IS NULL THEN '0' ELSE '1' END, '' ORDER BY v.tag_index) AS vector
FROM texts t CROSS JOIN tag_vocab v LEFT JOIN tx_f f ON f.text_id = t.text_id AND f.tag = v.tag GROUP BY ALL""")
oracle("intent_auto_tags", f"""
SELECT c.message_id, c.intent, coalesce(a.tags, '') AS auto_tags FROM chat_base c
LEFT JOIN (VALUES {rows([(i, '|'.join(t)) for i, t in T.INTENT_TAGS])}) a(intent, tags) ON c.intent = a.intent""")

# ---- text features and corpus ----------------------------------------------
FOLDED = (f"lower(CASE WHEN regexp_matches(text, '[\\x{{0600}}-\\x{{06ff}}]') THEN "
          f"translate(text, {lit(C.ARABIC_FOLD_FROM + C.ARABIC_DROP)}, {lit(C.ARABIC_FOLD_TO)}) ELSE text END)")
WORDS = rf"regexp_extract_all({FOLDED}, '[\x{{0600}}-\x{{06ff}}]+|[a-z0-9][a-z0-9''\-]*')"
CTE["doc_words"] = f"SELECT doc_id, lang, {WORDS} AS words FROM documents"
CTE["doc_tokens"] = """
SELECT doc_id, lang, list_concat(words, list_transform(flatten(list_transform(words,
  lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))), lambda s: '#' || s)) AS toks FROM doc_words"""
CTE["tok"] = "SELECT doc_id, lang, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM doc_tokens"
CTE["tok_counts"] = "SELECT token, count(*) AS n FROM tok GROUP BY token"
CTE["voc"] = f"""
SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + {C.RESERVED_IDS - 1} AS id
FROM tok_counts ORDER BY n DESC, token LIMIT {C.VOCAB_SIZE - C.RESERVED_IDS}"""
oracle("tokens", "SELECT doc_id, pos, token FROM tok")
oracle("vocab", "SELECT token, n, id FROM voc")
oracle("vocab_coverage", """
SELECT count(*) AS tokens, count(v.id) AS covered, round(count(v.id) / count(*), 6) AS coverage
FROM tok_counts t LEFT JOIN voc v ON t.token = v.token""")
oracle("encoded_sequences", f"""
SELECT d.doc_id, array_to_string(list_concat([{C.BOS}], coalesce(e.ids, []), [{C.EOS}],
    list_transform(range({C.SEQ_LEN - 2} - len(coalesce(e.ids, []))), lambda i: {C.PAD})), ',') AS ids
FROM documents d LEFT JOIN (SELECT doc_id, list(coalesce(v.id, {C.UNK}) ORDER BY pos) AS ids FROM tok t
  LEFT JOIN voc v ON t.token = v.token WHERE pos < {C.SEQ_LEN - 2} GROUP BY doc_id) e ON d.doc_id = e.doc_id""")


def bits(*key: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8)) AS UBIGINT)"


def uni(*key: str) -> str:
    return f"(CAST({bits(*key)} AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def choose(options, u: str) -> str:
    return f"({arr(options)})[CAST(floor({u} * {len(options)}) AS INT) + 1]"


def _d(purpose: str) -> str:
    return uni("doc_id", "copy", lit(purpose))


CTE["aug_in"] = f"""
SELECT doc_id, text, lang, copy, {_d('branch')} AS r, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w
FROM documents, range({C.AUG_FACTOR + 1}) t(copy)"""
CTE["aug_i"] = f"""
SELECT *, len(w) AS n, CAST(floor({_d('drop')} * len(w)) AS INT) AS cut, CAST(floor({_d('swap')} * (len(w) - 1)) AS INT) AS sw,
  greatest(2, CAST(floor(len(w) * (CAST(0.6 AS DOUBLE) + CAST(0.3 AS DOUBLE) * {_d('keep')})) AS INT)) AS keep FROM aug_in"""
oracle("augmented_corpus", f"""
SELECT doc_id, lang AS intent, copy, CAST({bits('doc_id', 'copy', lit('order'))} AS BIGINT) AS shuffle_key,
  CASE WHEN copy = 0 THEN text
    WHEN r < 0.15 AND n > 4 THEN array_to_string(list_concat(w[1:cut], w[cut + 2:]), ' ')
    WHEN r < 0.28 THEN regexp_replace(text, '[{C.AUG_TRAILING}]+$', '') || {choose(C.AUG_SUFFIXES, _d('suffix'))}
    WHEN r < 0.40 THEN lower(text)
    WHEN r < 0.52 AND n > 2 THEN array_to_string(list_concat(w[1:sw], [w[sw + 2], w[sw + 1]], w[sw + 3:]), ' ')
    WHEN r < 0.64 THEN text || ' ' || {choose(C.AUG_POLITE, _d('polite'))}
    WHEN r < 0.78 AND n > 3 THEN array_to_string(w[1:keep], ' ')
    ELSE text END AS user_msg
FROM aug_i""")
CTE["doc_split"] = """
SELECT doc_id, lang AS intent, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)))
  <= (count(*) OVER (PARTITION BY lang) * 10 + 50) // 100 THEN 'eval' ELSE 'train' END AS split FROM documents"""
oracle("stratified_split", "SELECT doc_id, intent, split FROM doc_split")
oracle("intent_index", """
SELECT intent, row_number() OVER (ORDER BY intent) - 1 AS intent_index, n
FROM (SELECT intent, count(*) AS n FROM chat_base GROUP BY intent)""")

# ---- intent scoring and evaluation -----------------------------------------
CTE["lab"] = """
SELECT d.doc_id, d.lang AS intent, s.split, coalesce(l.quality, 0) = 1 AS q, coalesce(l.toxic, 0) = 1 AS x
FROM documents d JOIN doc_split s ON d.doc_id = s.doc_id LEFT JOIN labels l ON d.doc_id = l.doc_id"""
# Every document is one row per head: its intent, and yes/no per tag.
CTE["lab_heads"] = """
SELECT doc_id, split, 'intent' AS head, intent AS class FROM lab
UNION ALL SELECT doc_id, split, 'tag:quality:high', CASE WHEN q THEN 'yes' ELSE 'no' END FROM lab
UNION ALL SELECT doc_id, split, 'tag:toxic', CASE WHEN x THEN 'yes' ELSE 'no' END FROM lab"""
CTE["tok_doc"] = "SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL"
CTE["tvoc"] = f"""
SELECT token FROM (SELECT token, sum(t.n) AS n FROM tok_doc t JOIN lab ON t.doc_id = lab.doc_id WHERE split = 'train' GROUP BY token)
ORDER BY n DESC, token LIMIT {C.VOCAB_SIZE - C.RESERVED_IDS}"""
CTE["tok_voc"] = "SELECT t.doc_id, t.token, t.n FROM tok_doc t JOIN tvoc v ON t.token = v.token"
CTE["head_docs"] = "SELECT head, class, count(*) AS docs FROM lab_heads WHERE split = 'train' GROUP BY ALL"
CTE["head_tok"] = """
SELECT h.head, h.class, t.token, sum(t.n) AS n FROM lab_heads h JOIN tok_voc t ON h.doc_id = t.doc_id
WHERE h.split = 'train' GROUP BY ALL"""
CTE["head_w"] = """
SELECT g.head, g.class, g.token, ln((coalesce(h.n, 0) + 1) / (sum(coalesce(h.n, 0)) OVER w + count(*) OVER w)) AS wt
FROM (SELECT head, class, token FROM head_docs CROSS JOIN tvoc) g
LEFT JOIN head_tok h ON g.head = h.head AND g.class = h.class AND g.token = h.token WINDOW w AS (PARTITION BY g.head, g.class)"""
CTE["head_s"] = """
SELECT t.doc_id, w.head, w.class, sum(t.n * w.wt) AS s FROM tok_voc t JOIN head_w w ON t.token = w.token GROUP BY ALL"""
CTE["head_z"] = """
SELECT l.doc_id, d.head, d.class, coalesce(s.s, 0) + ln((d.docs + 1) / ((SELECT count(*) FROM lab WHERE split = 'train') + 1)) AS z
FROM lab l CROSS JOIN head_docs d LEFT JOIN head_s s ON s.doc_id = l.doc_id AND s.head = d.head AND s.class = d.class"""
CTE["head_p"] = """
SELECT doc_id, head, class, e / sum(e) OVER (PARTITION BY doc_id, head) AS p
FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY doc_id, head)) AS e FROM head_z)"""
CTE["pred"] = f"""
SELECT doc_id, arg_max(class, p) FILTER (head = 'intent') AS guess, max(p) FILTER (head = 'intent') AS confidence,
  coalesce(string_agg(substr(head, 5), '|' ORDER BY head) FILTER (head <> 'intent' AND class = 'yes' AND p > {C.TAG_THRESHOLD}), '') AS tags
FROM head_p GROUP BY doc_id"""
oracle("intent_scores", f"""
SELECT lab.doc_id, lab.split, {language('d.text')} AS lang, p.guess AS intent, round(p.confidence, 4) AS confidence, p.tags
FROM lab JOIN documents d ON lab.doc_id = d.doc_id LEFT JOIN pred p ON lab.doc_id = p.doc_id""")
oracle("intent_model", """
SELECT split, count(*) AS n, count(DISTINCT intent) AS classes, true AS above_majority,
  (SELECT CAST(bool_or(q) AND NOT bool_and(q) AS BIGINT) + CAST(bool_or(x) AND NOT bool_and(x) AS BIGINT) FROM lab WHERE split = 'train') AS tag_heads
FROM lab GROUP BY split""")
CTE["pairs"] = "SELECT lab.doc_id, split, intent AS truth, q, x, guess, coalesce(tags, '') AS tags FROM lab LEFT JOIN pred ON lab.doc_id = pred.doc_id"
oracle("eval_intent_accuracy", """
SELECT split, count(*) AS n, count(*) FILTER (truth = guess) AS correct, round(count(*) FILTER (truth = guess) / count(*), 6) AS accuracy
FROM pairs GROUP BY split""")
CTE["votes"] = """
SELECT split, 'quality:high' AS tag, q AS t, list_contains(string_split(tags, '|'), 'quality:high') AS g FROM pairs
UNION ALL SELECT split, 'toxic', x, list_contains(string_split(tags, '|'), 'toxic') FROM pairs"""
CTE["f1s"] = """
SELECT split, tag, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM (
  SELECT split, tag, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn
  FROM votes WHERE t OR g GROUP BY ALL)"""
oracle("eval_tag_macro_f1", """
SELECT split, count(*) AS tags, round(avg(2 * p * r / greatest(p + r, CAST(1e-9 AS DOUBLE))), 6) AS macro_f1 FROM f1s GROUP BY split""")
CTE["per_class"] = """
SELECT c.split, c.intent, count(truth) AS n, count(truth) FILTER (truth = guess) AS correct
FROM (SELECT DISTINCT lang AS intent, s.split FROM documents, (VALUES ('train'), ('eval')) s(split)) c
LEFT JOIN pairs p ON p.truth = c.intent AND p.split = c.split GROUP BY ALL"""
oracle("eval_per_intent", """
SELECT 'intent' AS scope, split, intent, n, correct, CASE WHEN n > 0 THEN round(correct / n, 6) END AS accuracy,
  coalesce(n > 0 AND correct / n < 0.5, false) AS warn, n > 5 AND correct = 0 AS collapse FROM per_class
UNION ALL SELECT 'overall', split, NULL, CAST(sum(n) AS BIGINT), CAST(sum(correct) AS BIGINT),
  CASE WHEN sum(n) > 0 THEN round(sum(correct) / sum(n), 6) END, false, false FROM per_class GROUP BY split""")

# ---- sessions and users -----------------------------------------------------
AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"


def profile_ctes(p: str, source: str, matches: str, keys: list[str]) -> None:
    """``{p}``: profiles by ``keys`` over the calls in ``source``; ``matches`` are its personal-data matches by message."""
    k, on = ", ".join(keys), lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    CTE[f"{p}_tags"] = f"""
SELECT {k}, tag, min((ts, message_id)) AS first FROM (
  SELECT {k}, ts, message_id, unnest(string_split(call_tags, '|')) AS tag FROM {source} WHERE call_tags <> '')
GROUP BY ALL"""
    CTE[f"{p}_intents"] = f"""
SELECT {k}, call_intent AS intent, min((ts, message_id)) AS first FROM {source} WHERE call_intent <> '' GROUP BY ALL"""
    CTE[f"{p}_pii"] = f"""
SELECT {', '.join('s.' + x for x in keys)}, m.pii_type, min((s.ts, s.message_id)) AS first, count(DISTINCT m.value_hash) AS vals
FROM {matches} m JOIN {source} s ON m.message_id = s.message_id GROUP BY ALL"""
    CTE[p] = f"""
SELECT {', '.join('t.' + x for x in keys)}, arg_min(session_id, (ts, message_id)) AS session_id, arg_min(call_lang, (ts, message_id)) AS lang,
  epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us, count(*) AS message_count,
  count(*) FILTER (is_blocked OR pii_count > 0) AS flagged_count, count(*) FILTER (block_layer = 'injection') AS injection_attempts,
  count(*) FILTER (block_layer = 'nsfw') AS nsfw_attempts,
  coalesce(any_value(i.v), '') AS intents_seen, coalesce(any_value(g.v), '') AS tags_seen, coalesce(any_value(p.v), '') AS pii_types_seen,
  CAST(coalesce(any_value(p.vals), 0) AS BIGINT) AS pii_values
FROM {source} t
LEFT JOIN (SELECT {k}, string_agg(intent, '|' ORDER BY first, intent) AS v FROM {p}_intents GROUP BY {k}) i ON {on('t', 'i')}
LEFT JOIN (SELECT {k}, string_agg(tag, '|' ORDER BY first, tag) AS v FROM {p}_tags GROUP BY {k}) g ON {on('t', 'g')}
LEFT JOIN (SELECT {k}, string_agg(pii_type, '|' ORDER BY first, pii_type) AS v, sum(vals) AS vals FROM {p}_pii GROUP BY {k}) p
  ON {on('t', 'p')}
GROUP BY {', '.join('t.' + x for x in keys)}"""


profile_ctes("profile", "calls", "scp_m", ["user_id"])
oracle("user_profile", "SELECT * FROM profile")
for name, n in (("session_history", S.HISTORY_TURNS), ("session_history_3", 3)):
    oracle(name, f"""
SELECT session_id, user_id, turn, role, masked_text FROM sc
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= {n}""")
oracle("context_window", f"""
SELECT a.session_id, a.turn, CASE WHEN a.call_intent = '' THEN '' ELSE {lit(S.INTENT_HINT[0])} || a.call_intent || {lit(S.INTENT_HINT[1])}
  || replace(a.call_tags, '|', ', ') || {lit(S.INTENT_HINT[2])} END AS hint,
  coalesce((SELECT string_agg(b.role || ': ' || b.masked_text, chr(10) ORDER BY b.turn) FROM turns b
    WHERE b.session_id = a.session_id AND b.turn BETWEEN a.turn - {S.CONTEXT_TURNS} AND a.turn - 1), '') AS context
FROM calls a WHERE a.role = 'assistant'""")
def segments(state: str, hours: int) -> str:
    return f"""
SELECT '{state}' AS state, user_id, segment, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS turns,
  min(ts) <= {AS_OF} AND {AS_OF} < max(ts) + INTERVAL {hours} HOUR AS live
FROM (SELECT user_id, ts, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (
  SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL {hours} HOUR THEN 0 ELSE 1 END AS new
  FROM events)) GROUP BY user_id, segment"""


oracle("session_segments", segments("session", 24) + " UNION ALL " + segments("summary", 168))
oracle("stream_sessions", f"""
SELECT concat('u', CAST(user_id AS VARCHAR)) AS user_id, started_us, ended_us, turns FROM ({segments('session', 24)})""")
oracle("session_erase", """
SELECT message_id, session_id, role FROM chat_base
WHERE session_id NOT IN (SELECT session_id FROM chat_base WHERE intent = 'harmful')""")
oracle("session_view", f"""
SELECT s.user_id, s.session_id, s.history_preview, s.preview_turns, p.lang, p.message_count, p.intents_seen, p.tags_seen,
  p.pii_types_seen, p.flagged_count
FROM (SELECT user_id, session_id, string_agg(role || ': ' || masked_text, chr(10) ORDER BY turn) AS history_preview,
        count(*) AS preview_turns FROM (
        SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= {S.PREVIEW_TURNS})
      GROUP BY ALL) s JOIN profile p ON s.user_id = p.user_id""")
# The same over sessions that run out: three long ones for each user, cut by silences of 24 hours.
_NEW = "CASE WHEN ts < lag(ts) OVER ({w}) + INTERVAL 24 HOUR THEN 0 ELSE 1 END"
_by = {k: f"PARTITION BY {k} ORDER BY ts, message_id" for k in ("user_id", "session_id")}
CTE["long_turns"] = f"""
SELECT * EXCLUDE (n_s, n_u), sum(n_s) OVER ({_by['session_id']} ROWS UNBOUNDED PRECEDING) AS s_segment,
  sum(n_u) OVER ({_by['user_id']} ROWS UNBOUNDED PRECEDING) AS segment,
  row_number() OVER ({_by['session_id']}) - 1 AS turn FROM (
  SELECT *, {_NEW.format(w=_by['session_id'])} AS n_s, {_NEW.format(w=_by['user_id'])} AS n_u FROM (
    SELECT * EXCLUDE (session_id, turn), user_id || '-' || message_id % 3 AS session_id FROM turns))"""
CTE["long_calls"] = CTE["calls"].replace("turns", "long_turns")
profile_ctes("long_profile", "long_calls", "scp_m", ["user_id", "segment"])
oracle("user_profile_segments", "SELECT * REPLACE (CAST(segment AS BIGINT) AS segment) FROM long_profile")
CTE["user_calls"] = f"""
SELECT *, sum(n_u) OVER ({_by['user_id']} ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT *, {_NEW.format(w=_by['user_id'])} AS n_u FROM calls)"""
profile_ctes("user_segments", "user_calls", "scp_m", ["user_id", "segment"])
oracle("stream_user_profile", "SELECT * REPLACE (CAST(segment AS BIGINT) AS segment) FROM user_segments")
oracle("user_hashes_segments", """
SELECT t.user_id, CAST(t.segment AS BIGINT) AS segment, pii_type, value_hash, count(*) AS n, arg_min(m.message_id, (m.ts, m.message_id)) AS first_message
FROM pu_m m JOIN long_turns t ON m.message_id = t.message_id GROUP BY ALL""")


def live(key: str, segment: str) -> str:
    """Turns that the state of ``key`` holds at the instant; what comes later cannot change the segments before it."""
    return f"""SELECT * FROM (SELECT *, max({segment}) OVER (PARTITION BY {key}) AS last_one, max(ts) OVER (PARTITION BY {key}) AS last_ts
  FROM long_calls WHERE ts <= {AS_OF}) WHERE {segment} = last_one AND {AS_OF} < last_ts + INTERVAL 24 HOUR"""


CTE["live_users"], CTE["live_sessions"] = live("user_id", "segment"), live("session_id", "s_segment")
profile_ctes("live_profile", "live_users", "scp_m", ["user_id"])
oracle("user_profile_live", "SELECT * FROM live_profile")
oracle("session_history_live", f"""
SELECT session_id, user_id, turn, role, masked_text FROM live_sessions
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= {S.HISTORY_TURNS}""")
oracle("context_window_segments", f"""
SELECT a.session_id, CAST(a.s_segment AS BIGINT) AS segment, a.turn, CASE WHEN a.call_intent = '' THEN '' ELSE {lit(S.INTENT_HINT[0])} || a.call_intent
  || {lit(S.INTENT_HINT[1])} || replace(a.call_tags, '|', ', ') || {lit(S.INTENT_HINT[2])} END AS hint,
  coalesce((SELECT string_agg(b.role || ': ' || b.masked_text, chr(10) ORDER BY b.turn) FROM long_turns b
    WHERE b.session_id = a.session_id AND b.s_segment = a.s_segment AND b.turn BETWEEN a.turn - {S.CONTEXT_TURNS} AND a.turn - 1), '') AS context
FROM long_calls a WHERE a.role = 'assistant'""")
oracle("session_view_live", f"""
SELECT s.user_id, s.session_id, coalesce(h.history_preview, '') AS history_preview, coalesce(h.preview_turns, 0) AS preview_turns, p.lang,
  p.message_count, p.intents_seen, p.tags_seen, p.pii_types_seen, p.flagged_count
FROM (SELECT DISTINCT user_id, session_id FROM long_calls WHERE ts <= {AS_OF}) s JOIN live_profile p ON s.user_id = p.user_id
LEFT JOIN (SELECT session_id, string_agg(role || ': ' || masked_text, chr(10) ORDER BY turn) AS history_preview, count(*) AS preview_turns FROM (
    SELECT * FROM live_sessions QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= {S.PREVIEW_TURNS}) GROUP BY session_id) h
  ON s.session_id = h.session_id""")
CTE["rep_words"] = r"""
SELECT session_id, turn, text, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w
FROM conv WHERE role = 'assistant'"""
CTE["rep"] = f"""
SELECT a.session_id, a.turn, CASE WHEN p.n IS NULL OR (p.n = 1 AND p.chars = 0) THEN CAST(0 AS DOUBLE) WHEN len(a.w) = 0 THEN CAST(1 AS DOUBLE)
   ELSE len(list_intersect(a.w, p.seen)) / len(a.w) END AS repetition
FROM rep_words a LEFT JOIN (
  SELECT a.session_id, a.turn, flatten(list(b.w)) AS seen, count(*) AS n, sum(length(b.text)) AS chars
  FROM rep_words a JOIN rep_words b ON a.session_id = b.session_id AND b.turn BETWEEN a.turn - {S.HISTORY_TURNS} AND a.turn - 1
  GROUP BY ALL) p ON a.session_id = p.session_id AND a.turn = p.turn"""
CTE["long_words"] = r"""
SELECT session_id, s_segment, turn, masked_text AS text, list_distinct(list_filter(string_split_regex(lower(masked_text), '\s+'), lambda w: w <> '')) AS w
FROM long_turns WHERE role = 'assistant'"""
oracle("repetition_score_segments", f"""
SELECT a.session_id, CAST(a.s_segment AS BIGINT) AS segment, a.turn, round(CASE WHEN p.n IS NULL OR (p.n = 1 AND p.chars = 0) THEN CAST(0 AS DOUBLE)
   WHEN len(a.w) = 0 THEN CAST(1 AS DOUBLE) ELSE len(list_intersect(a.w, p.seen)) / len(a.w) END, 6) AS repetition
FROM long_words a LEFT JOIN (
  SELECT a.session_id, a.turn, flatten(list(b.w)) AS seen, count(*) AS n, sum(length(b.text)) AS chars FROM long_words a JOIN long_words b
    ON a.session_id = b.session_id AND a.s_segment = b.s_segment AND b.turn BETWEEN a.turn - {S.HISTORY_TURNS} AND a.turn - 1
  GROUP BY ALL) p ON a.session_id = p.session_id AND a.turn = p.turn""")
oracle("repetition_score", "SELECT session_id, turn, round(repetition, 6) AS repetition FROM rep")
for name, t in (("repetition_flags", S.REPETITION_THRESHOLD), ("repetition_flags_10", 0.1)):
    oracle(name, f"""
SELECT CASE WHEN grouping(session_id) = 1 THEN 'overall' ELSE 'session' END AS scope, session_id, count(*) AS replies,
  count(*) FILTER (repetition > CAST({t} AS DOUBLE)) AS flagged,
  round(count(*) FILTER (repetition > CAST({t} AS DOUBLE)) / count(*), 6) AS rate FROM rep GROUP BY ROLLUP (session_id)""")

# ---- summaries and risk -----------------------------------------------------
oracle("conversation_stats", """
SELECT session_id, count(*) AS total_turns, count(*) FILTER (role = 'user') AS user_turns,
  count(*) FILTER (role = 'assistant') AS assistant_turns,
  round(coalesce(avg(length(text)) FILTER (role = 'user'), 0), 6) AS avg_user_msg_len FROM conv GROUP BY session_id""")
CTE["intent_n"] = "SELECT session_id, intent, count(*) AS n, min(turn) AS first FROM chat WHERE intent <> '' GROUP BY ALL"
CTE["first_intent"] = """
SELECT session_id, intent AS primary_intent, n AS mentions FROM intent_n
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) = 1"""
oracle("primary_intent", "SELECT session_id, primary_intent, mentions FROM first_intent")


def summary_ctes(p: str, source: str) -> None:
    """``{p}``: summary records over the screened turns in ``source``."""
    CTE[f"{p}_i"] = f"""SELECT session_id, string_agg(DISTINCT intent, '|' ORDER BY intent) AS all_intents,
  count(DISTINCT intent) AS n_intents FROM {source} WHERE intent <> '' GROUP BY session_id"""
    CTE[f"{p}_n"] = f"SELECT session_id, intent, count(*) AS n, min(turn) AS first FROM {source} WHERE intent <> '' GROUP BY ALL"
    CTE[f"{p}_p"] = f"""SELECT session_id, intent AS primary_intent FROM {p}_n
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) = 1"""
    CTE[f"{p}_g"] = f"""SELECT session_id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS all_tags FROM (
  SELECT session_id, unnest(string_split(tags, '|')) AS tag FROM {source} WHERE tags <> '') GROUP BY session_id"""
    CTE[f"{p}_y"] = f"""SELECT session_id, string_agg(DISTINCT y, '|' ORDER BY y) AS pii FROM (
  SELECT session_id, unnest(string_split(pii_types, '|')) AS y FROM {source} WHERE pii_types <> '') GROUP BY session_id"""
    CTE[f"{p}_b"] = f"""
SELECT t.session_id, arg_min(user_id, turn) AS user_id, arg_max(lang, turn) AS lang, max(ts) AS created_at, count(*) AS total_turns,
  count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns,
  round(coalesce(avg(length(masked_text)) FILTER (role = 'user'), 0), 6) AS avg_user_msg_len, bool_or(is_blocked) AS was_blocked
FROM {source} t GROUP BY t.session_id"""
    has = lambda col, v: f"list_contains(string_split(coalesce({col}, ''), '|'), '{v}')"
    CTE[f"{p}_r"] = f"""
SELECT b.*, coalesce(pi.primary_intent, '{S.DEFAULT_INTENT}') AS primary_intent, coalesce(i.all_intents, '') AS all_intents,
  coalesce(i.n_intents, 0) AS n_intents, coalesce(g.all_tags, '') AS all_tags, coalesce(y.pii, '') AS pii_types_detected,
  CASE WHEN {has('i.all_intents', 'harmful')} OR {has('g.all_tags', 'security_risk')} THEN 'critical'
       WHEN {has('i.all_intents', 'sensitive')} AND {has('g.all_tags', 'requires_human')} THEN 'high'
       WHEN y.pii IS NOT NULL OR coalesce(i.n_intents, 0) > 2 THEN 'medium' ELSE 'low' END AS risk_level
FROM {p}_b b LEFT JOIN {p}_i i ON b.session_id = i.session_id LEFT JOIN {p}_p pi ON b.session_id = pi.session_id
LEFT JOIN {p}_g g ON b.session_id = g.session_id LEFT JOIN {p}_y y ON b.session_id = y.session_id"""
    actions = f"""coalesce(nullif(concat_ws('|',
    CASE WHEN {has('all_intents', 'harmful')} THEN {lit('|'.join(S.ACTIONS_HARMFUL))} END,
    CASE WHEN {has('all_intents', 'sensitive')} THEN {lit(S.ACTION_SENSITIVE)} END,
    CASE WHEN pii_types_detected <> '' THEN {lit(S.ACTION_PII)} END), ''), {lit(S.ACTION_DEFAULT)})"""
    CTE[p] = f"""
SELECT session_id, user_id, lang, epoch_us(created_at) AS created_us,
  {lit(S.TEXT_TURNS[0])} || total_turns || {lit(S.TEXT_TURNS[1])} || {lit(S.TEXT_INTENT[0])} || primary_intent || {lit(S.TEXT_INTENT[1])}
  || CASE WHEN pii_types_detected <> '' THEN {lit(S.TEXT_PII)} ELSE '' END
  || CASE WHEN {has('all_intents', 'emergency')} OR risk_level = 'critical' THEN {lit(S.TEXT_EMERGENCY)} ELSE '' END
  || {lit(S.TEXT_RISK[0])} || risk_level || {lit(S.TEXT_RISK[1])} AS summary_text,
  '{S.SUMMARY_LANGUAGE}' AS summary_lang, primary_intent, all_intents, all_tags, total_turns, user_turns, assistant_turns,
  avg_user_msg_len, risk_level, pii_types_detected, was_blocked, {actions} AS recommended_actions,
  risk_level IN ('high', 'critical') AS needs_human_takeover,
  CASE WHEN risk_level = 'critical' THEN {lit(S.ESCALATION_CRITICAL)} ELSE '' END AS escalation_reason
FROM {p}_r"""


CTE["opening"] = "SELECT * FROM turns QUALIFY 2 * turn < count(*) OVER (PARTITION BY session_id)"
summary_ctes("summ", "turns")
summary_ctes("summ0", "opening")
oracle("conversation_summary", "SELECT * FROM summ")
oracle("stream_summaries", "SELECT * FROM summ")
CTE["stored"] = "SELECT 'full' AS run_id, * FROM summ UNION ALL SELECT 'half' AS run_id, * FROM summ0"
oracle("summary_sink", "SELECT *, CAST(CAST(make_timestamp(created_us) AS DATE) AS VARCHAR) AS event_date FROM stored")
oracle("summary_lookup", """
SELECT session_id, summary_text, primary_intent, all_intents, all_tags, risk_level, recommended_actions, needs_human_takeover,
  escalation_reason FROM stored
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_us DESC, total_turns DESC) = 1""")
oracle("session_risk", "SELECT session_id, risk_level, n_intents AS intents FROM summ_r")
oracle("recommended_actions", "SELECT session_id, recommended_actions FROM summ")
oracle("transcript", f"""
SELECT session_id, string_agg('[' || upper(role) || ']: ' || substr(text, 1, {S.TRANSCRIPT_CHARS}), chr(10) ORDER BY turn) AS transcript,
  count(*) AS turns FROM (SELECT * FROM conv QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= {S.HISTORY_TURNS})
GROUP BY session_id""")
CTE["exch"] = """
SELECT u.*, a.masked_text AS reply, coalesce(a.is_blocked, false) AS reply_blocked FROM turns u
LEFT JOIN turns a ON a.session_id = u.session_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"""
CTE["exch_risk"] = """
SELECT *, CASE WHEN is_blocked OR intent = 'harmful' OR reply_blocked THEN 'critical'
  WHEN pii_count > 0 OR list_contains(string_split(tags, '|'), 'requires_human') OR intent = 'sensitive' THEN 'high'
  ELSE 'low' END AS risk_level FROM exch"""
oracle("turn_risk", "SELECT session_id, turn, risk_level FROM exch_risk")
oracle("turn_decisions", f"""
SELECT session_id, turn, user_id, CASE WHEN is_blocked THEN {lit(S.REFUSAL_PREFIX)} || block_reason ELSE reply END AS response,
  CASE WHEN is_blocked THEN 'blocked' ELSE intent END AS intent, CASE WHEN is_blocked THEN 'blocked' ELSE tags END AS tags, lang,
  CASE WHEN is_blocked THEN CAST(1 AS DOUBLE) ELSE confidence END AS confidence, pii_count > 0 AS pii_detected, pii_types,
  is_blocked AS was_blocked, risk_level FROM exch_risk""")

# ---- corpus generation ------------------------------------------------------
CTE["plan_in"] = f"""
SELECT doc_id AS plan_id, {choose(C.TOPICS, uni('doc_id', lit('topic')))} AS topic,
  {choose(C.STYLES, uni('doc_id', lit('style')))} AS style FROM documents"""
_b, _r = C.PROMPT_FORMAT.split("{topic}")
CTE["plan"] = f"SELECT *, {lit(_b)} || topic || {lit(_r.split('{style}')[0])} || style AS prompt FROM plan_in"
oracle("generation_plan", "SELECT plan_id, topic, style, prompt FROM plan")
CTE["gen_in"] = """
SELECT doc_id AS plan_id, 'requested ' || lang AS requested_topic, doc_id % 10 AS kind,
  to_json({'topic': source, 'conversation': [{'role': 'user', 'content': 'about ' || source}, {'role': 'assistant', 'content': text}]}) AS f,
  to_json({'conversation': [{'role': 'user', 'content': 'about ' || source}, {'role': 'assistant', 'content': text}]}) AS b,
  to_json({'topic': source, 'conversation': [{'role': 'user', 'content': text}]}) AS s, source FROM documents"""
CTE["gen_raw"] = """
SELECT plan_id, requested_topic, CASE kind WHEN 0 THEN CAST(f AS VARCHAR) WHEN 1 THEN '```json' || chr(10) || f || chr(10) || '```'
  WHEN 2 THEN 'Sure! ' || b || ' Done.' WHEN 3 THEN CAST(s AS VARCHAR) WHEN 4 THEN '{"topic": ' || f
  WHEN 5 THEN 'no json: ' || source WHEN 6 THEN f || ' and {"x": 1}' WHEN 7 THEN replace(CAST(f AS VARCHAR), '"role":"assistant",', '')
  WHEN 8 THEN '{"topic":"t","conversation":[{"role":"user","content":null},{"role":"assistant","content":"ok"}]}' ELSE '```' || chr(10) || b || '```' END AS raw FROM gen_in"""
CTE["gen_body"] = """
SELECT *, regexp_extract(CASE WHEN contains(raw, '```') THEN CASE WHEN starts_with(string_split(raw, '```')[2], 'json')
  THEN substr(string_split(raw, '```')[2], 5) ELSE string_split(raw, '```')[2] END ELSE raw END, '(?s)\\{.*\\}', 0) AS body FROM gen_raw"""
CTE["gen"] = f"""
SELECT *, CASE WHEN body = '' THEN 'no_braces' WHEN NOT json_valid(body) THEN 'broken_json'
  WHEN json_extract(body, '$.conversation') IS NULL THEN 'no_conversation'
  WHEN json_array_length(body, '$.conversation') < {C.MIN_GENERATED_TURNS} THEN 'too_few_turns'
  WHEN len(list_filter(range(json_array_length(body, '$.conversation')::BIGINT), lambda i: json_extract_string(body, '$.conversation[' || i || '].role') IS NULL
    OR json_extract_string(body, '$.conversation[' || i || '].content') IS NULL)) > 0 THEN 'broken_turn' END AS reason FROM gen_body"""
CTE["gen_turns"] = """
SELECT plan_id, i, json_extract_string(body, '$.conversation[' || i || '].role') AS role,
  json_extract_string(body, '$.conversation[' || i || '].content') AS content
FROM gen, range(20) r(i) WHERE reason IS NULL AND i < json_array_length(body, '$.conversation')"""
oracle("generations_parsed", """
SELECT g.plan_id, g.reason, CASE WHEN g.reason IS NULL THEN json_extract_string(body, '$.topic') END AS topic, c.conversation
FROM gen g LEFT JOIN (SELECT plan_id, string_agg(role || ': ' || content, chr(10) ORDER BY i) AS conversation FROM gen_turns GROUP BY plan_id) c
  ON g.plan_id = c.plan_id""")
CTE["chatml"] = f"""
SELECT g.plan_id, '{C.CHATML_START}system' || chr(10) || {lit(C.TRAINING_SYSTEM)} || '{C.CHATML_END}' || c.body_text AS text,
  coalesce(json_extract_string(body, '$.topic'), requested_topic) AS topic
FROM gen g JOIN (SELECT plan_id, string_agg(chr(10) || '{C.CHATML_START}' || role || chr(10) || content || '{C.CHATML_END}', '' ORDER BY i) AS body_text
  FROM gen_turns GROUP BY plan_id) c ON g.plan_id = c.plan_id WHERE g.reason IS NULL"""
oracle("chatml_corpus", "SELECT plan_id, text, topic FROM chatml")
oracle("corpus_resume", "SELECT plan_id, topic, style, prompt FROM plan WHERE plan_id NOT IN (SELECT plan_id FROM chatml)")
CTE["cut"] = f"""
SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(CAST(plan_id AS VARCHAR))) <= count(*) OVER () * {C.TRAIN_RATIO_PERCENT} // 100
  THEN 'train' ELSE 'eval' END AS split FROM chatml"""
oracle("corpus_split", "SELECT plan_id, topic, split FROM cut")
oracle("corpus_sink", "SELECT text, topic, split FROM cut")
oracle("stream_history", f"""
SELECT session_id, message_id, role, masked_text FROM (
  SELECT *, max(CASE WHEN epoch_us(next_ts) - epoch_us(ts) >= {S.SESSION_TTL_SECONDS * 1_000_000} THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_id ORDER BY rn) AS gone FROM (
    SELECT *, row_number() OVER w AS rn, coalesce(lag(ts) OVER w, {AS_OF}) AS next_ts FROM sc WHERE ts <= {AS_OF}
    WINDOW w AS (PARTITION BY session_id ORDER BY ts DESC, message_id DESC)) WHERE rn <= 3)
WHERE gone = 0""")
