"""Text features: normalisation, tokens and augmentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.hashing import pick, uniform
from parlance.functions.language import has_arabic
from parlance.functions.safety import let
from parlance.rules import corpus as C

STRINGS = "array<string>"


def normalise(text: Column) -> Column:
    """Fold Arabic spellings, drop tatweel and diacritics, lower-case."""
    folded = F.translate(text, C.ARABIC_FOLD_FROM + C.ARABIC_DROP, C.ARABIC_FOLD_TO)
    return F.lower(F.when(has_arabic(text), folded).otherwise(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(normalise(text), F.lit(C.WORD_PATTERN), F.lit(0))


def shingles(word: Column) -> Column:
    """'#' + every 3-character piece of a word of three or more characters."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.concat(F.lit("#"), F.substr(word, i, F.lit(3))))
    return F.when(F.length(word) >= 3, pieces).otherwise(F.array().cast(STRINGS))


def tokens(word_list: Column) -> Column:
    """All words, then all their shingles."""
    return F.concat(word_list, F.flatten(F.transform(word_list, shingles)))


def head_tokens(text: Column, n: int) -> Column:
    """First ``n`` tokens, without shingling words that cannot contribute."""
    return let(F.slice(words(text), 1, n), lambda w: F.slice(tokens(w), 1, n))


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def augment(text: Column, *key: Column) -> Column:
    """One variant of ``text``; all draws come from md5 of ``key``."""

    def draw(purpose: str) -> Column:
        return uniform(*key, F.lit(purpose))

    def variant(w: Column) -> Column:
        n = F.size(w)
        cut = F.floor(draw("drop") * n).cast("int")
        dropped = F.concat(F.slice(w, F.lit(1), cut), F.slice(w, cut + 2, n))
        at = F.floor(draw("swap") * (n - 1)).cast("int")
        swapped = F.concat(
            F.slice(w, F.lit(1), at), F.array(F.get(w, at + 1), F.get(w, at)), F.slice(w, at + 3, n))
        keep = F.greatest(F.lit(2), F.floor(n * (F.lit(0.6) + F.lit(0.3) * draw("keep"))).cast("int"))
        bare = F.regexp_replace(text, f"[{C.AUG_TRAILING}]+\\z", "")
        r = draw("branch")
        return (
            F.when((r < 0.15) & (n > 4), F.array_join(dropped, " "))
            .when(r < 0.28, F.concat(bare, pick(C.AUG_SUFFIXES, draw("suffix"))))
            .when(r < 0.40, F.lower(text))
            .when((r < 0.52) & (n > 2), F.array_join(swapped, " "))
            .when(r < 0.64, F.concat(text, F.lit(" "), pick(C.AUG_POLITE, draw("polite"))))
            .when((r < 0.78) & (n > 3), F.array_join(F.slice(w, F.lit(1), keep), " "))
            .otherwise(text)
        )

    return let(whitespace_words(text), variant)
