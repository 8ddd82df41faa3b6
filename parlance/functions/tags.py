"""Tag columns: keyword rules, script tags, precedence and conflicts.

Rules are configuration, read when the plan is built; they become one narrow
expression over the text, so tagging needs no join and no shuffle.  Builders
take column names or SQL expressions and return SQL text (``*_sql``) or Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import sqltext as Q
from parlance.rules import language as L
from parlance.rules import tags as T

NONE = "cast(array() as array<string>)"
RULES = T.DEFAULT_TAG_RULES
OFFICIAL = T.DEFAULT_OFFICIAL_TAGS


def canonical_tags(official: list[str]) -> dict[str, str]:
    """Lower-case name -> official spelling; a later spelling replaces an earlier one."""
    return {t.lower(): t for t in official}


def keyword_tags_sql(text: str, rules=RULES, official=OFFICIAL) -> str:
    names = canonical_tags(official)
    by_tag: dict[str, list[str]] = {}
    for keyword, tag in rules:
        low = tag.lower()
        if not low.startswith(T.LANGUAGE_PREFIX) and low in names:
            by_tag.setdefault(names[low], []).append(keyword)
    if not by_tag:
        return NONE
    hits = ", ".join("CASE WHEN " + " OR ".join(f"contains(_low, {Q.text(k)})" for k in kws) + f" THEN {Q.text(tag)} END"
                     for tag, kws in by_tag.items())
    found = Q.let(f"lower({text})", "_low", f"array({hits})")
    return f"array_sort(filter({found}, _t -> _t IS NOT NULL))"


def script_tags_sql(text: str) -> str:
    darija = " OR ".join(f"contains(_low, {Q.text(w)})" for w in L.DARIJA_TAG_SUBSTRINGS)
    chars = f"length(regexp_replace({text}, {Q.regex('[^' + L.ARABIC_BLOCK + ']+')}, ''))"
    return Q.let(f"lower({text})", "_low",
                 f"CASE WHEN {darija} THEN array('{T.TAG_DARIJA}') "
                 f"WHEN {chars} > {L.ARABIC_TAG_MIN_CHARS} THEN array('{T.TAG_ARABIC}') ELSE {NONE} END")


def resolve_conflicts_sql(tags: str) -> str:
    losers = ", ".join(f"CASE WHEN array_contains(_set, {Q.text(w)}) THEN {Q.text(lo)} END" for w, lo in T.CONFLICTS)
    lowered = f"array_distinct(transform({tags}, _t -> lower(_t)))"
    return "array_sort(" + Q.let(lowered, "_set", f"array_except(_set, array({losers}))") + ")"


def rule_tags_sql(text: str, rules=RULES, official=OFFICIAL) -> str:
    return resolve_conflicts_sql(f"concat({script_tags_sql(text)}, {keyword_tags_sql(text, rules, official)})")


def keyword_tags(text: str, rules=RULES, official=OFFICIAL) -> Column:
    """Sorted distinct official tags with a keyword inside the lower-cased text."""
    return F.expr(keyword_tags_sql(text, rules, official))


def script_tags(text: str) -> Column:
    """At most one language tag, from Darija substrings or Arabic script."""
    return F.expr(script_tags_sql(text))


def resolve_conflicts(tags: str) -> Column:
    """Lower-cased sorted set without the weaker tag of each opposed pair."""
    return F.expr(resolve_conflicts_sql(tags))


def rule_tags(text: str, rules=RULES, official=OFFICIAL) -> Column:
    """Script and keyword tags after conflicts."""
    return F.expr(rule_tags_sql(text, rules, official))


#: White space of any kind at either end.
OUTER_SPACE = r"(?U)^\s+|\s+$"


def enrich(text: str, existing: str, rules=RULES, official=OFFICIAL) -> Column:
    """Valid existing tags (lower-cased, in order) win, else rule tags, else
    ``untagged``; ', '-joined."""
    parts = f"transform(split(lower(coalesce({existing}, '')), ','), _t -> regexp_replace(_t, {Q.regex(OUTER_SPACE)}, ''))"
    names = Q.texts(sorted(set(canonical_tags(official)) - set(T.EMPTY_TAGS)))
    valid = f"filter({parts}, _t -> array_contains({names}, _t))"
    found = Q.let(f"array_join({rule_tags_sql(text, rules, official)}, ', ')", "_f",
                  f"CASE WHEN _f <> '' THEN _f ELSE '{T.UNTAGGED}' END")
    return F.expr(Q.let(valid, "_v", f"CASE WHEN size(_v) > 0 THEN array_join(_v, ', ') ELSE {found} END"))


def merge_tags(model_tags: str, text: str, rules=RULES, official=OFFICIAL) -> Column:
    """Model tags (an array) and rule tags of the text, conflicts dropped."""
    return F.expr(resolve_conflicts_sql(f"concat({model_tags}, {rule_tags_sql(text, rules, official)})"))


def split_list_sql(value: str, sep: str = "|") -> str:
    """Array of the non-empty items of a delimited string."""
    return f"filter(split(coalesce({value}, ''), {Q.regex('[' + sep + ']')}), _t -> _t <> '')"
