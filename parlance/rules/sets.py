"""Screening rules as table rows: the built-in ones and our own additions."""

from __future__ import annotations

from parlance.rules import safety as R

LAYERS = ("injection", "nsfw", "pii")

#: Rows of the built-in rules: (set, layer, place, label, pattern, mask, multiline).
BASE_ROWS = [
    *[("base", "injection", 10.0 * i, label, p, None, label in R.MULTILINE_RULES) for i, (label, p) in enumerate(R.INJECTION_RULES, 1)],
    *[("base", "nsfw", 10.0 * i, label, p, None, False) for i, (label, p) in enumerate(R.NSFW_RULES, 1)],
    *[("base", "pii", 10.0 * i, kind, p, mask, False) for i, (kind, p, mask) in enumerate(R.PII_RULES, 1)],
]
#: Our own additions for gaps of the base set, off unless asked for: they scan before the base rules that would take part of a value.
EXTENDED_ROWS = [
    ("extended", "pii", 1.0, "passport", r"\b[A-Z]{2}[0-9]{7}\b", "[PASSEPORT_MASQUÉ]", False),
    ("extended", "pii", 21.0, "credit_card", r"\b3[47]\d{2}[\s\-]?\d{6}[\s\-]?\d{5}\b", "[CARTE_MASQUÉE]", False),
    ("extended", "pii", 22.0, "phone_intl", r"\+1[\s\-.]?\(?\d{3}\)?[\s\-.]\d{3}[\s\-.]?\d{4}\b", "[TEL_MASQUÉ]", False),
    ("extended", "pii", 61.0, "phone_intl", r"\+(?!212)[1-9]\d{1,2}(?:[\s\-.]\d{1,4}){3,6}\b", "[TEL_MASQUÉ]", False),
    ("extended", "injection", 165.0, "de_override", r"(ignoriere\s+(alle\s+)?(vorherigen\s+)?(anweisungen|regeln)|vergiss\s+(alle\s+)?(deine|eure)\s+anweisungen)", None, False),
    ("extended", "injection", 166.0, "es_override", r"(ignora\s+(todas\s+)?(las\s+)?(instrucciones|reglas)|olvida\s+(todas\s+)?(tus|sus)\s+instrucciones)", None, False),
]
COLUMNS = "rule_set string, layer string, place double, label string, pattern string, mask string, multiline boolean"
