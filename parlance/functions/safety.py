"""Screening columns: injection hits, unsafe categories, personal data.

Builders take a column name or SQL expression for the text.  Patterns stay
literal so that Spark compiles each one once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import sqltext as Q
from parlance.functions.rulesets import BASE, CASED, Rule, RuleSet
from parlance.rules import safety as R

HIT_TYPE = "array<struct<label:string,snippet:string,matched:string>>"
PII_TYPE = "array<struct<pii_type:string,ordinal:bigint,value:string,start:bigint,end:bigint>>"
NO_PII = f"cast(array() as {PII_TYPE})"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folded(text: str) -> str:
    for a, b in R.FOLD_EXTRA:
        text = f"replace({text}, {Q.text(a)}, {Q.text(b)})"
    return f"lower({text})"


def _matches(rule: Rule, text: str) -> str:
    found = f"regexp_like({text}, {Q.regex(rule.pattern)})"
    return f"{rule.possible} AND {found}" if rule.possible else found


def injection_hits_sql(text: str, rules: RuleSet = BASE) -> str:
    items = []
    for rule in rules.injection:
        hit = Q.let(f"regexp_extract({text}, {Q.regex(rule.pattern)}, 0)", "_v", f"named_struct('label', '{rule.label}', 'snippet', "
                    f"substring(_v, 1, {R.INJECTION_SNIPPET_CHARS}), 'matched', _v)")
        items.append(f"CASE WHEN {_matches(rule, text)} THEN {hit} END")
    hits = Q.let(_folded(text), "_low", "array(" + ", ".join(items) + ")")
    return f"cast(filter({hits}, _h -> _h IS NOT NULL) as {HIT_TYPE})" if items else f"cast(array() as {HIT_TYPE})"


def injection_hits(text: str, rules: RuleSet = BASE) -> Column:
    """Labels that fire, in rule order, with the first match, whole and cut to 40 characters."""
    return F.expr(injection_hits_sql(text, rules))


def nsfw_categories_sql(text: str, rules: RuleSet = BASE) -> str:
    items = [f"CASE WHEN {_matches(rule, text)} THEN '{rule.label}' END" for rule in rules.nsfw]
    cats = Q.let(_folded(text), "_low", "array(" + ", ".join(items) + ")")
    return f"cast(filter({cats}, _c -> _c IS NOT NULL) as array<string>)" if items else "cast(array() as array<string>)"


def nsfw_categories(text: str, rules: RuleSet = BASE) -> Column:
    """Categories that fire, in rule order."""
    return F.expr(nsfw_categories_sql(text, rules))


def injection_reason(hits: str) -> Column:
    shown = f"transform({hits}, _h -> concat(_h.label, ':\\'', _h.snippet, '\\''))"
    return F.expr(f"concat({Q.text(R.INJECTION_REASON)}, array_join({shown}, ', '))")


def nsfw_reason(categories: str) -> Column:
    return F.concat(F.lit(R.NSFW_REASON), F.array_join(categories, ", "))


def fingerprint(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, R.FINGERPRINT_CHARS)


def _masked(rule: Rule, text: str) -> str:
    """One replacement, run only on texts that can hold a match."""
    replaced = f"regexp_replace({text}, {Q.regex(CASED + rule.pattern)}, {Q.text(rule.mask)})"
    return f"CASE WHEN regexp_like({text}, {Q.regex('(?U)' + rule.possible)}) THEN {replaced} ELSE {text} END" if rule.possible else replaced


def _gated(text: str, rules: RuleSet, found: str, other: str) -> str:
    return f"CASE WHEN regexp_like({text}, {Q.regex('(?U)' + rules.pii_any)}) THEN {found} ELSE {other} END" if rules.pii_any else found


def mask_pii_sql(text: str, rules: RuleSet = BASE) -> str:
    out = text
    for i, rule in enumerate(rules.pii):
        out = Q.let(out, f"_m{i}", _masked(rule, f"_m{i}"))
    return _gated(text, rules, out, text)


def mask_pii(text: str, rules: RuleSet = BASE) -> Column:
    """Masked text only (no match table)."""
    return F.expr(mask_pii_sql(text, rules))


def _located(pii_type: str, before: str, pattern: str) -> str:
    """Matches of one rule with offsets into the text that rule scanned.

    The pieces between matches come from ``split``; a match starts where all
    earlier pieces and matches end.
    """
    p = Q.regex(pattern)
    steps = (f"zip_with(regexp_extract_all({before}, {p}, 0), split({before}, {p}, -1), "
             f"(_v, _g) -> named_struct('value', _v, 'gap', _g))")
    first = f"named_struct('pos', 0L, 'items', {NO_PII})"
    start = "_a.pos + length(_x.gap)"
    end = f"{start} + length(_x.value)"
    item = (f"named_struct('pii_type', '{pii_type}', 'ordinal', cast(size(_a.items) as bigint), 'value', _x.value, "
            f"'start', {start}, 'end', {end})")
    step = f"named_struct('pos', {end}, 'items', concat(_a.items, array({item})))"
    return (f"aggregate({steps}, {first}, (_a, _x) -> CASE WHEN _x.value IS NULL THEN _a ELSE {step} END, "
            f"_a -> _a.items)")


def pii_scan_sql(text: str, rules: RuleSet = BASE) -> str:
    """struct(masked, items): rule i reads the text masked by rules 1..i-1.

    Matches are extracted only where a rule's replacement changed the text.
    """
    none = f"named_struct('masked', {text}, 'items', {NO_PII})"
    state = none
    for i, rule in enumerate(rules.pii):
        s, r = f"_s{i}", f"_r{i}"
        found = _located(rule.label, f"{s}.masked", CASED + rule.pattern)
        after = f"named_struct('masked', {r}, 'items', CASE WHEN {r} <> {s}.masked THEN concat({s}.items, {found}) ELSE {s}.items END)"
        state = Q.let(state, s, Q.let(_masked(rule, f"{s}.masked"), r, after))
    return _gated(text, rules, state, none)


def scan_pii(df: DataFrame, text: str, where: str = "true", rules: RuleSet = BASE) -> DataFrame:
    """Add ``pii`` (matches) and ``masked_text``; rows outside ``where`` stay unscanned."""
    none = f"named_struct('masked', {text}, 'items', {NO_PII})"
    return (df.withColumn("_scan", F.expr(f"CASE WHEN {where} THEN {pii_scan_sql(text, rules)} ELSE {none} END"))
            .withColumns({"pii": F.col("_scan.items"), "masked_text": F.col("_scan.masked")})
            .drop("_scan"))


def pii_types(matches: str) -> Column:
    """Distinct types, sorted (the record keeps them as a set)."""
    return F.expr(f"array_sort(array_distinct(transform({matches}, _p -> _p.pii_type)))")
