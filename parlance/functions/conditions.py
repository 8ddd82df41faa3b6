"""Cheap necessary conditions of patterns, derived from the patterns.

A pattern is costly to run on every text, and most texts cannot match.  What every match must contain is read off the
pattern's parse tree: words, for patterns that ignore case, or a short run of characters.  A condition that holds decides
nothing; one that fails proves that there is no match.  Where nothing can be derived there is no condition.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

#: Words shorter than this are in most texts.
SHORTEST = 2
#: Alternatives of one clause; a longer list is no longer cheap.
WIDEST = 40


def _tree(pattern: str, flags: int = 0):
    """The parse tree, or None where this syntax is not understood; the pattern is then run on every text."""
    try:
        return _parser.parse(pattern, flags)
    except (re.error, OverflowError, RecursionError):
        return None


def _plain(code: int) -> str | None:
    """The character folded to lower case, or None if case folding might change more than its case."""
    c = chr(code)
    low = c.lower()
    return low if len(low) == 1 and (c.isascii() or (low == c and c.upper() == c)) else None


def _best(clauses: list[list[str]]) -> list[str] | None:
    """The most telling clause: that whose shortest word is longest, of equals the narrowest."""
    good = [c for c in clauses if c and len(c) <= WIDEST and min(map(len, c)) >= SHORTEST]
    return max(good, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _clauses(items) -> list[list[str]]:
    """Clauses (lists of words, one of which must occur) that all hold for each match of the sequence ``items``."""
    out: list[list[str]] = []
    run = ""

    def cut() -> None:
        nonlocal run
        if run:
            out.append([run])
        run = ""

    for op, arg in items:
        if op is K.LITERAL and _plain(arg) is not None:
            run += _plain(arg)
            continue
        if op is K.SUBPATTERN and not any(o in (K.BRANCH, K.MAX_REPEAT, K.MIN_REPEAT, K.IN, K.ANY) for o, _ in arg[3]):
            inner = _clauses(arg[3])
            if len(inner) == 1 and all(o is K.LITERAL for o, _ in arg[3]):
                run += inner[0][0]
                continue
        if op is K.AT:
            continue  # takes no character
        cut()
        if op is K.SUBPATTERN:
            out += _clauses(arg[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1:
            out += _clauses(arg[2])
        elif op is K.BRANCH:
            parts = [_best(_clauses(b)) for b in arg[1]]
            if all(parts):
                out.append(sorted({w for p in parts for w in p}))
        elif op is K.ATOMIC_GROUP:
            out += _clauses(arg)
    cut()
    return out


def word_clauses(pattern: str) -> list[list[str]]:
    """Clauses of lower-case words for a pattern that ignores case: of each, one must be in the case-folded text."""
    tree = _tree(pattern, re.IGNORECASE)
    if tree is None:
        return []
    kept: list[list[str]] = []
    for clause in _clauses(tree):
        words = [w for w in clause if not any(o != w and o in w for o in clause)]  # a word that holds another adds nothing
        if clause and len(words) <= WIDEST and min(map(len, words)) >= SHORTEST and words not in kept:
            kept.append(words)
    return kept


_CLASS = {K.CATEGORY_DIGIT: r"\d", K.CATEGORY_NOT_DIGIT: r"\D", K.CATEGORY_SPACE: r"\s", K.CATEGORY_NOT_SPACE: r"\S",
          K.CATEGORY_WORD: r"\w", K.CATEGORY_NOT_WORD: r"\W"}


def _char(code: int) -> str:
    return rf"\x{{{code:x}}}" if not (chr(code).isascii() and chr(code).isalnum()) else chr(code)


def _one(op, arg) -> str | None:
    """A pattern for one character."""
    if op is K.LITERAL:
        return _char(arg)
    if op is not K.IN:
        return None
    out = ""
    for o, a in arg:
        if o is K.NEGATE:
            out += "^"
        elif o is K.LITERAL:
            out += _char(a)
        elif o is K.RANGE:
            out += f"{_char(a[0])}-{_char(a[1])}"
        elif o is K.CATEGORY and a in _CLASS:
            out += _CLASS[a]
        else:
            return None
    return f"[{out}]"


def _runs(items) -> list[tuple[int, str]]:
    """(weight, pattern) of runs of characters that follow one another in each match; the heavier, the rarer."""
    out: list[tuple[int, str]] = []
    run, weight = "", 0

    def cut() -> None:
        nonlocal run, weight
        if run:
            out.append((weight, run))
        run, weight = "", 0

    def value(op, one: str) -> int:
        return 4 if op is K.LITERAL and not chr(one_code).isalnum() else 2 if "^" not in one and r"\s" not in one and r"\S" not in one else 0

    for op, arg in items:
        if op is K.AT:
            continue
        if op in (K.ASSERT, K.ASSERT_NOT):
            continue  # takes no character
        one_code = arg if op is K.LITERAL else 0x61
        one = _one(op, arg)
        if one is not None:
            run, weight = run + one, weight + value(op, one)
            continue
        if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1 and len(arg[2]) == 1:
            inner_op, inner = arg[2][0]
            one_code = inner if inner_op is K.LITERAL else 0x61
            one = _one(inner_op, inner)
            if one is not None:
                run, weight = run + f"{one}{{{arg[0]}}}", weight + arg[0] * value(inner_op, one)
                if arg[1] == arg[0]:
                    continue
                cut()  # more of them may follow
                continue
        if op is K.SUBPATTERN:
            inside = _runs(arg[3])
            cut()
            out += inside
            continue
        cut()
        if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1:
            out += _runs(arg[2])
        elif op is K.BRANCH:
            parts = [max(_runs(b), default=None) for b in arg[1]]
            if all(parts) and len(parts) <= WIDEST:
                out.append((min(w for w, _ in parts), "(?:" + "|".join(p for _, p in parts) + ")"))
    cut()
    return out


def run_condition(pattern: str) -> str | None:
    """A pattern, without boundaries and loops, that every match of a case-sensitive ``pattern`` contains; None without any."""
    tree = _tree(pattern)
    best = max(_runs(tree), default=None) if tree is not None else None
    return best[1] if best and best[0] > 0 else None
