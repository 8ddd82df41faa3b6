"""What the review of round 3 found: each test failed before its change."""

import math
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.functions import tags as TG
from parlance.functions import text as X
from parlance.llm import common, minhash, periodic
from parlance.operators import corpus as CO
from parlance.operators import intent as I
from parlance.operators import tagging as TA
from parlance.plans.queries import QUERIES
from parlance.session import materialise
from parlance.streaming import jobs

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@given
def test_lookup_finds_every_stored_session(spark):
    found = {r.session_id for r in QUERIES["summary_lookup"](spark, SF).select("session_id").collect()}
    assert found == {r.session_id for r in QUERIES["summary_sink"](spark, SF).select("session_id").distinct().collect()}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_indexed_tags_shuffle_found_tags_only(spark, monkeypatch):
    df = spark.createDataFrame([(0, "a forgotten password"), (1, "word by word"), (2, "pass"), (3, None), (4, "x" * 50), (5, "ab é日本語c")], "id long, text string")
    rules = spark.createDataFrame([("password", "A"), ("word", "B"), ("pass", "A"), ("日本語", "C"), ("xx", "D"), ("é", "B"), ("", "D")], "keyword string, tag string")
    index = TA.keyword_index(rules, rules.select("tag").distinct(), df)
    want = {(0, "A"), (0, "B"), (1, "B"), (2, "A"), (4, "D"), (5, "B"), (5, "C")}
    found = TA.indexed_tags(df, index, ["id"])
    assert _plan(found).count("Exchange hashpartitioning") == 1  # texts and candidates stay where they are
    assert {(r.id, r.tag) for r in found.collect()} == want
    monkeypatch.setattr(TA, "INDEX_BYTES", 0)
    assert {(r.id, r.tag) for r in TA.indexed_tags(df, index, ["id"]).collect()} == want


def test_keywords_are_found_by_long_pieces(spark):
    df = spark.createDataFrame([(0, "abcdef")], "id long, text string")
    rules = spark.createDataFrame([("abcdefgh", "A"), ("abcd", "B"), ("ab", "C")], "keyword string, tag string")
    pieces = {r.keyword: r.piece for r in TA.keyword_index(rules, rules.select("tag").distinct(), df).collect()}
    assert {k: len(p) for k, p in pieces.items()} == {"abcdefgh": 6, "abcd": 3, "ab": 2}


@given
def test_texts_are_tagged_once_for_vectors(spark):
    df = QUERIES["tag_multi_hot"](spark, SF)
    plan = _plan(df)
    assert "rule-tags" in plan and "lower(text" not in plan  # no text is tagged in this plan


def test_script_tags_count_characters_between_others(spark):
    texts = ["", "abc", "ا ب", "ا1ب2ت3", "ا1ب2ت3ث", "xxاxxxبxxتxxثxx", "bghit", "éاé日بتث"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.n for r in df.select("id", F.size(TG.script_tags("text")).alias("n")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1}
    assert "]+" in TG.script_tags_sql("text")  # runs, not single characters, are replaced


def test_texts_are_read_once_for_vocabulary_and_model(spark):
    df = spark.createDataFrame([("pay the card card", "a", ["x"]), ("the card", "b", []), (None, "b", ["x", "y"]), ("pay it", "a", ["y"])],
                               "text string, intent string, tags array<string>")
    words = materialise(CO.word_counts(df, ["intent", "tags"]), "words")
    counts = lambda d: {r.token: r.n for r in d.collect()}
    assert counts(CO.token_counts(df, words=words)) == counts(CO.token_counts(df))
    v = materialise(CO.vocab(CO.token_counts(df, words=words)), "vocab")
    model = lambda m: {(r["head"], r["class"], r.token): round(r.w, 9) for r in m.collect()}
    assert model(I.linear_model(df, v, words=words)) == model(I.linear_model(df, v))


def test_scorer_counts_tokens_from_words(spark):
    texts = ["card's card", "ab abc abcd", "بطاقة البنك", "", None, "a b c", "zzz" * 40, "abc" * 30 + " abc"]
    df = spark.createDataFrame([(i, t, "a" if i % 2 else "b", ["x"] if i % 3 else []) for i, t in enumerate(texts)],
                               "id long, text string, intent string, tags array<string>")
    v = materialise(CO.vocab(CO.token_counts(df)), "vocab")
    model = materialise(I.linear_model(df, v), "model")
    w, bias = {}, {}
    for r in model.collect():
        (bias if r.token is None else w.setdefault(r["class"], {}))[r["class"] if r.token is None else r.token] = r.w
    scores = I.linear_scores(df, model, ["id"])
    assert "transform" not in _plan(scores)  # words leave the row, not their shingles
    for r in df.select("id", F.coalesce(X.tokens(X.words(F.col("text"))), F.array()).alias("tokens")).join(scores, "id").collect():
        z = {c: bias[c] + sum(w[c].get(t, 0) for t in r.tokens) for c in ("a", "b")}
        top = max(z.values())
        assert abs(r.confidence - 1 / sum(math.exp(x - top) for x in z.values())) < 1e-9


def test_model_is_fitted_on_written_vectors(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(I, "materialise", lambda df, purpose: seen.append((purpose, df.columns)) or materialise(df, purpose))
    df = spark.createDataFrame([(f"{w} {i}", w, [w] if i % 2 else []) for i in range(8) for w in ("red", "blue")], "text string, intent string, tags array<string>")
    model = I.train_intent_model(df, tags="tags", features=64)
    assert len(seen) == 1 and "features" in seen[0][1] and "tokens" not in seen[0][1]
    guess = I.apply_intent_model(model, df.withColumnRenamed("intent", "truth"), ["truth"])
    assert guess.where("truth = intent").count() == 16


def test_periodic_runs_are_sought_in_small_slices():
    texts = [" ".join(str((i * k) % 997) for i in range(20_000)) for k in range(1, 31)]
    whole = pa.record_batch([pa.array(range(30)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(periodic._search(iter([whole])))
    sizes = [sum(len(t) for t in texts[p.column("doc_id")[0].as_py():p.column("doc_id")[-1].as_py() + 1]) for p in parts]
    assert len(parts) > 1 and max(sizes) <= periodic.SLICE + max(map(len, texts))
    alone = [next(periodic._search(iter([whole.slice(i, 1)]))) for i in range(30)]
    assert [r for p in parts for r in p.to_pylist()] == [r for p in alone for r in p.to_pylist()]


@given
def test_profile_stream_writes_what_it_counts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(jobs, "materialise", lambda df, purpose: seen.setdefault(purpose, df.schema) and materialise(df, purpose))
    assert QUERIES["stream_user_profile"](spark, SF).count() > 0
    assert not {"nsfw_categories", "block_reason", "confidence", "model_tags"} & set(seen["stream-screened"].names)
    assert seen["stream-pairs"]["pii"].dataType.elementType.names == ["pii_type", "value"]


def test_copies_with_too_many_edits_are_not_paired(spark):
    # each edit is made in three copies, so that no copy has a shingle of its own
    def copy(i):
        return " ".join(f"edit{j}x{k}" if j in {i, (i + 1) % 16, (i + 2) % 16} and k < 8 else f"base{j}x{k}" for j in range(16) for k in range(13))

    texts = spark.createDataFrame([(i, copy(i)) for i in range(16)], "doc_id long, text string")
    crowded = texts.select(F.lit(7).cast("long").alias("bucket"), F.col("doc_id").alias("rep"))
    sets = [set(zip(*(copy(i).split()[k:] for k in range(5)))) for i in range(16)]
    sizes = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "rep long, n long")
    rows = minhash._shared(crowded, texts, sizes).join(sizes, "rep")
    met = rows.alias("x").join(rows.alias("y"), F.expr(f"x.bucket = y.bucket AND x.rep < y.rep AND ({minhash.FITS})"))
    fit = {(r.a, r.b) for r in met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).collect()}
    links = {(i, j) for i in range(16) for j in range(i + 1, 16) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(links) == 16 and fit == links  # all 120 pairs before


def test_buckets_with_the_same_members_are_compared_once(spark, monkeypatch):
    # ten crowds of the same lines, one bucket that holds one more, and one of a single member
    rows = [(b, r) for b in range(10) for r in range(20)] + [(10, r) for r in range(21)] + [(11, 5)]
    buckets = spark.createDataFrame(rows, "bucket long, rep long")
    kept = {tuple(r) for r in common.distinct_buckets(buckets).collect()}
    assert kept == {(0, 20, 10), (10, 21, 1)}
    states = []

    def counted(df, purpose):
        out = materialise(df, purpose)
        if purpose == "pairs-open":
            states.append(out.count())
        return out

    monkeypatch.setattr(common, "materialise", counted)
    found = common.bucket_components(buckets, lambda rows: rows, "true", lambda pairs: pairs.where("a % 7 = b % 7"))
    assert {tuple(r) for r in found.collect()} == {(r, r % 7) for r in range(7, 21)}
    assert states[0] == 41  # 221 before
