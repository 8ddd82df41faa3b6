"""Rule sets: screening rules, built in or from a table, with the condition under which each can match."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from parlance.functions import sqltext as Q
from parlance.functions.conditions import run_condition, word_clauses
from parlance.rules import safety as R
from parlance.rules import sets as RS

#: What a rule that ignores case, and one that does not, is compiled with.  U: Unicode classes and boundaries, d: only "\n" ends a line.
CASELESS, MULTILINE, CASED = "(?iUd)", "(?imUd)", "(?Ud)"


@dataclass(frozen=True)
class Rule:
    """``possible`` is SQL over the case-folded text ``_low``, or for personal data a pattern; None: every text can match."""

    label: str
    pattern: str
    possible: str | None
    mask: str = ""


@dataclass(frozen=True)
class RuleSet:
    """Rules of the three layers in scan order."""

    injection: tuple[Rule, ...]
    nsfw: tuple[Rule, ...]
    pii: tuple[Rule, ...]

    @property
    def pii_any(self) -> str | None:
        """A pattern that every text with personal data contains; None if some rule has no condition."""
        needs = [r.possible for r in self.pii]
        if [r.label for r in self.pii] == list(R.PII_NEEDS) and needs == list(R.PII_NEEDS.values()):
            return R.PII_ANY
        return "|".join(f"(?:{p})" for p in dict.fromkeys(needs)) if needs and all(needs) else None


def _words(clauses: list[list[str]]) -> str | None:
    return " AND ".join("(" + " OR ".join(f"contains(_low, {Q.text(w)})" for w in c) + ")" for c in clauses) or None


def _tuned(label: str) -> str:
    """The condition that the built-in rule ``label`` comes with."""
    either = [" AND ".join(f"contains(_low, {Q.text(w)})" for w in alt.split("&")) for alt in R.RULE_NEEDS[label]]
    return "(" + " OR ".join(f"({e})" for e in either) + ")"


def rule_set(rows: Iterable[tuple]) -> RuleSet:
    """A rule set from rows (set, layer, place, label, pattern, mask, multiline); conditions are derived from the patterns.

    Built-in rules keep the conditions that they come with.
    """
    built_in = {(layer, label): pattern for _, layer, _, label, pattern, _, _ in RS.BASE_ROWS}
    layers: dict[str, list[Rule]] = {layer: [] for layer in RS.LAYERS}
    for _, layer, _, label, pattern, mask, multiline in sorted(rows, key=lambda r: (r[1], r[2])):
        known = built_in.get((layer, label)) == pattern
        if layer == "pii":
            layers[layer].append(Rule(label, pattern, R.PII_NEEDS[label] if known else run_condition(pattern), mask))
        else:
            flags = MULTILINE if multiline else CASELESS
            layers[layer].append(Rule(label, flags + pattern, _tuned(label) if known else _words(word_clauses(pattern))))
    return RuleSet(*[tuple(layers[layer]) for layer in RS.LAYERS])


BASE = rule_set(RS.BASE_ROWS)
EXTENDED = rule_set([*RS.BASE_ROWS, *RS.EXTENDED_ROWS])
