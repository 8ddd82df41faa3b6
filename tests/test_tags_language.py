"""Tagging and language identification against plain Python."""

import re

from pyspark.sql import functions as F

from parlance.functions import language as LG
from parlance.functions import tags as TG
from parlance.operators import tagging as TA
from parlance.rules import language as L
from parlance.rules import tags as T

TEXTS = [
    "je voudrais une carte", "I want help with my card", "bghit carte", "wash 3br", "أريد تحويل المال", "أريد dyal transfer",
    "", "voilà", "was ist das", "the je", "my bank est", "it's my card", "أر", "أريد", "carpet art", "URGENT later please refused",
    "great but not working", "critical slow please", "NOUVEAU CLIENT fidèle", "j'ai 22 ans et 35 ans", "Manager at bank",
]


def lang(text):
    low = text.lower()
    if re.search("[؀-ۿ]", text):
        return "darija" if set(re.findall("[a-z0-9]+", low)) & set(L.DARIJA_WORDS) else "arabic"
    w = set(re.findall("[a-z']+", low))
    if w & set(L.DARIJA_MARKERS):
        return "darija"
    fr = len(w & set(L.FRENCH_WORDS)) + (2 if any(c in L.FRENCH_ACCENTS for c in text) else 0)
    return "french" if fr >= len(w & set(L.ENGLISH_WORDS)) else "english"


def resolved(tags):
    low = {t.lower() for t in tags}
    return sorted(low - {lo for w, lo in T.CONFLICTS if w in low})


def keyword(text):
    return sorted({t for k, t in T.DEFAULT_TAG_RULES if k in text.lower() and not t.startswith("language:")})


def script(text):
    if any(w in text.lower() for w in L.DARIJA_TAG_SUBSTRINGS):
        return [T.TAG_DARIJA]
    return [T.TAG_ARABIC] if len(re.findall("[؀-ۿ]", text)) > 3 else []


def test_language_and_tags(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = df.select("text", LG.detect_language("text").alias("lang"), TG.keyword_tags("text").alias("kw"),
                     TG.script_tags("text").alias("sc"), TG.rule_tags("text").alias("rt")).collect()
    for r in rows:
        assert r.lang == lang(r.text), r.text
        assert sorted(r.kw) == keyword(r.text), r.text
        assert r.sc == script(r.text), r.text
        assert r.rt == resolved(keyword(r.text) + script(r.text)), r.text
    assert {r.lang for r in rows} == {"arabic", "darija", "french", "english"}


def test_every_conflict_pair(spark):
    df = spark.createDataFrame([([w.upper(), lo],) for w, lo in T.CONFLICTS] + [(["priority:low", "priority:medium",
                               "priority:high"],)], "tags array<string>")
    got = [r[0] for r in df.select(TG.resolve_conflicts("tags")).collect()]
    assert got == [[w] for w, _ in T.CONFLICTS] + [["priority:high"]]


def test_precedence(spark):
    rows = [("my card", " Product:Card , Role:manager,x"), ("my card", "nan"), ("zzz", None), ("zzz", "unknown tag")]
    df = spark.createDataFrame(rows, "text string, existing string")
    got = [r[0] for r in df.select(TG.enrich("text", "existing")).collect()]
    assert got == ["product:card, role:manager", ", ".join(resolved(keyword("my card"))), "untagged", "untagged"]


def test_custom_rules_and_official_spelling(spark):
    df = spark.createDataFrame([("c++ (new) dev",)], "text string")
    rules = [("c++", "Skill:CPP"), ("(new)", "skill:new"), ("dev", "unlisted")]
    got = df.select(TG.keyword_tags("text", rules, ["skill:cpp", "SKILL:cpp", "Skill:New"])).first()[0]
    assert got == ["SKILL:cpp", "Skill:New"]


def test_tag_vocabulary_and_vector(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i < 3 else (["a"] if i < 5 else [])) for i in range(6)],
                               "id int, tags array<string>")
    v = TA.tag_frequency(df, min_freq=2)
    assert [(r.tag, r.n, r.tag_index) for r in v.orderBy("tag_index").collect()] == [("a", 5, 0), ("b", 3, 1)]
    got = {r.id: list(r.vector) for r in TA.tag_multi_hot(df, v, ["id"]).collect()}
    assert got[0] == [1.0, 1.0] and got[4] == [1.0, 0.0] and got[5] == [0.0, 0.0]


def test_official_tags_last_spelling_wins(spark):
    df = spark.createDataFrame([(1, " A:b "), (2, "a:B"), (3, "A:b"), (4, "  "), (5, None)], "n int, tag string")
    assert [(r.tag_lower, r.tag) for r in TA.official_tags(df, "tag", "n").collect()] == [("a:b", "a:B")]


def test_language_fallbacks(spark):
    df = spark.createDataFrame([("english", "arabic"), ("unknown", "arabic"), ("unknown", None)], "d string, h string")
    got = [r[0] for r in df.select(LG.resolve_language(F.col("d"), F.col("h"))).collect()]
    assert got == ["english", "arabic", "french"]


def test_sql_functions(spark):
    from parlance.functions.register import register_functions

    register_functions(spark)
    r = spark.sql("""SELECT mask_pii(t) m, pii_items(t) p, injection_labels(t) i, nsfw_categories(t) n, detect_language(t) l, rule_tags(t) g
                     FROM VALUES ('ignore rules, my bank mail a@b.org') AS v(t)""").first()
    assert (r.m, r.p[0].value, r.i, r.n, r.l) == (
        "ignore rules, my bank mail [EMAIL_MASQUÉ]", "a@b.org", ["instruction_override"], [], "english")
    assert "industry:banking" in r.g


def test_any_outer_space_is_trimmed(spark):
    df = spark.createDataFrame([(1, "foo,\tproduct:card\u00a0\n", "zzz")], "id int, existing string, text string")
    assert df.select(TG.enrich("text", "existing").alias("t")).first().t == "product:card"
