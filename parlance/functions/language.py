"""Language identification from scripts and word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import sqltext as Q
from parlance.rules import language as L


def has_arabic(text: Column) -> Column:
    return text.rlike(f"[{L.ARABIC_BLOCK}]")


def detect_language_sql(text: str) -> str:
    def hits(listed) -> str:
        return f"size(array_intersect(_w, {Q.texts(listed)}))"

    accent = f"CASE WHEN regexp_like({text}, {Q.regex('[' + L.FRENCH_ACCENTS + ']')}) THEN {L.FRENCH_ACCENT_WEIGHT} ELSE 0 END"
    latin = (f"CASE WHEN arrays_overlap(_w, {Q.texts(L.DARIJA_MARKERS)}) THEN 'darija' "
             f"WHEN {hits(L.FRENCH_WORDS)} + {accent} >= {hits(L.ENGLISH_WORDS)} THEN 'french' ELSE 'english' END")
    mixed = f"arrays_overlap(split(lower({text}), '[^a-z0-9]+'), {Q.texts(L.DARIJA_WORDS)})"
    arabic = Q.regex("[" + L.ARABIC_BLOCK + "]")
    words = f"split(lower({text}), {Q.regex('''[^a-z']+''')})"
    return (f"CASE WHEN regexp_like({text}, {arabic}) THEN CASE WHEN {mixed} THEN 'darija' ELSE 'arabic' END "
            f"ELSE {Q.let(words, '_w', latin)} END")


def detect_language(text: str) -> Column:
    """arabic, darija, french or english.

    Texts with Arabic script are Arabic unless a listed Latin word marks them
    as Darija.  Others are Darija on a marker word, else French or English by
    distinct list words (accents count for French, ties go to French).
    """
    return F.expr(detect_language_sql(text))


def resolve_language(detected: Column, hint: Column) -> Column:
    """Detected language, else the caller's hint, else French."""
    known = F.when(detected != "unknown", detected)
    return F.coalesce(known, F.when(hint != "", hint), F.lit(L.DEFAULT_LANGUAGE))
