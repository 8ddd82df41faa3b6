"""Corpus preparation against plain Python."""

import hashlib
import json
import re
from collections import Counter

from pyspark.sql import functions as F

from parlance.operators import corpus as CO
from parlance.operators import intent as I
from parlance.operators.blocks import hash_cut
from parlance.rules import corpus as C

TEXTS = ["Hello hello world-wide it's 2nd", "إلى المدرسةِ مـرحبا", "Café au lait", "", "a ab abc abcd", "x " * 120, "w0rd " * 50]


def toks(text):
    table = {ord(a): b for a, b in zip(C.ARABIC_FOLD_FROM, C.ARABIC_FOLD_TO)} | {ord(c): None for c in C.ARABIC_DROP}
    words = re.findall(C.WORD_PATTERN, text.translate(table).lower())
    return words + ["#" + w[i:i + 3] for w in words for i in range(len(w) - 2)]


def test_tokens_vocab_and_encoding(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {}
    for r in CO.tokens(df, ["id"]).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.token)
    assert got == {i: toks(t) for i, t in enumerate(TEXTS) if toks(t)}

    counts = Counter(t for text in TEXTS for t in toks(text))
    assert {r.token: r.n for r in CO.token_counts(df).collect()} == counts
    ranked = sorted(counts, key=lambda t: (-counts[t], t))[:16]
    v = CO.vocab(CO.token_counts(df), 20)
    ids = {r.token: r.id for r in v.collect()}
    assert ids == {t: i + 4 for i, t in enumerate(ranked)}

    for r in CO.encoded_sequences(df, v, ["id"]).collect():
        body = [ids.get(t, C.UNK) for t in toks(TEXTS[r.id])[:94]]
        want = [C.BOS] + body + [C.EOS]
        assert r.ids == want + [C.PAD] * (96 - len(want))
    cov = CO.vocab_coverage(CO.token_counts(df), v).first()
    assert (cov.tokens, cov.covered) == (len(counts), 16)


def test_augmentation_shapes(spark):
    text = "one two three four five six seven?!"
    df = spark.range(400).select("id", F.lit(text).alias("text"), F.lit("x").alias("intent"))
    rows = CO.augmented_corpus(df, "id", "text").collect()
    assert len(rows) == 400 * 5 and all(r.text == text for r in rows if r.copy == 0)
    n = Counter(len(r.text.split()) for r in rows if r.copy > 0)
    share = {k: c / 1600 for k, c in n.items()}
    assert 0.2 < share[6] + share[5] + share[4] < 0.36  # one word dropped, or a 60-90 % head
    again = {(r.id, r.copy): r.text for r in CO.augmented_corpus(df, "id", "text").collect()}
    assert again == {(r.id, r.copy): r.text for r in rows}


def test_generation_parsing(spark):
    conv = {"topic": "t", "conversation": [{"role": "user", "content": "hi \"x\" é"}, {"role": "assistant", "content": "yo\n{ok}"}]}
    full, bare = json.dumps(conv), json.dumps({"conversation": conv["conversation"]}, ensure_ascii=False)
    raw = [full, f"```json\n{full}\n```", f"Sure {bare} bye", f"```\n{bare}\n``` trailing {{", json.dumps({**conv, "conversation": conv["conversation"][:1]}),
           '{"topic": ' + full, "nothing", "{'topic': 'x', 'conversation': []}", '{"topic": "x"}', "}{",
           full + ' and {"x": 1}', full + "," + full, full + "] " + full, '{"conversation": [{"role": "user"}, {"role": "a", "content": "b"}]}',
           '{"conversation": [{"role": "user", "content": null}, {"role": "a", "content": "b"}]}']
    df = spark.createDataFrame(list(enumerate(raw)), "plan_id int, raw string").withColumn("asked", F.lit("asked"))
    parsed = CO.parse_generations(df)
    reasons = {r.plan_id: r.reason for r in parsed.collect()}
    assert reasons == {0: None, 1: None, 2: None, 3: None, 4: "too_few_turns", 5: "broken_json", 6: "no_braces", 7: "broken_json",
                       8: "no_conversation", 9: "no_braces", 10: "broken_json", 11: "broken_json", 12: "broken_json", 13: "broken_turn",
                       14: "broken_turn"}
    out = {r.plan_id: r for r in CO.chatml_corpus(parsed, ["plan_id"], "asked").collect()}
    assert set(out) == {0, 1, 2, 3} and out[0].topic == "t" and out[2].topic == "asked"
    assert out[0].text == (f"<|im_start|>system\n{C.TRAINING_SYSTEM}<|im_end|>\n<|im_start|>user\nhi \"x\" é<|im_end|>\n"
                           "<|im_start|>assistant\nyo\n{ok}<|im_end|>")
    plan = CO.generation_plan(df, "plan_id")
    assert {r.plan_id for r in CO.corpus_resume(plan, spark.createDataFrame([(0,), (3,)], "plan_id int")).collect()} == {
        1, 2, *range(4, 15)}
    r = plan.first()
    assert r.topic in C.TOPICS and r.style in C.STYLES and r.prompt == C.PROMPT_FORMAT.format(topic=r.topic, style=r.style)


def test_splits_are_exact(spark):
    df = spark.range(997).withColumn("intent", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot"))
    got = {(r.intent, r.split): r["count"] for r in CO.stratified_split(df, "id", "intent").groupBy("intent", "split").count().collect()}
    assert got == {("hot", "eval"): 90, ("hot", "train"): 807, ("rare", "eval"): 10, ("rare", "train"): 90}
    got = {r.split: r["count"] for r in CO.corpus_split(df, "id").groupBy("split").count().collect()}
    assert got == {"train": 897, "eval": 100}


def test_cut_leaves_wide_rows_where_they_are(spark):
    df = spark.range(2000).withColumns({"g": F.when(F.col("id") % 3 > 0, "x"), "text": F.lit("long")})
    out = hash_cut(df, F.col("id"), F.floor(F.col("n") / 10), ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    got = [(r.g, r.id) for r in out.where("selected").collect()]
    for g in ("x", None):
        ids = sorted((i for i in range(2000) if ("x" if i % 3 else None) == g), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert {i for k, i in got if k == g} == set(ids[: len(ids) // 10])


def test_linear_model_learns_and_metrics(spark):
    rows = [(i, "transfer money bank now", "pay", ["urgent"]) for i in range(8)] + [
        (i + 8, "weather sunny rain today", "chat", []) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, text string, intent string, tags array<string>").cache()
    v = CO.vocab(CO.token_counts(df))
    model = I.linear_model(df, v).cache()
    new = spark.createDataFrame([(1, "bank transfer"), (2, "rain"), (3, "zzz")], "id int, text string")
    got = {r.id: r for r in I.linear_scores(new, model, ["id"]).collect()}
    assert got[1].intent == "pay" and got[1].tags == ["urgent"] and got[1].confidence > 0.9
    assert got[2].intent == "chat" and got[2].tags == [] and abs(got[3].confidence - 0.5) < 1e-9

    pred = spark.createDataFrame(
        [("val", "a", "a", ["x"], ["x"]), ("val", "a", "b", ["x"], ["y"]), *[("val", "b", "a", [], [])] * 6],
        "split string, truth string, guess string, true_tags array<string>, tags array<string>")
    assert I.intent_accuracy(pred, ["split"]).first().accuracy == 0.125
    f1 = {r.tag: r.f1 for r in I.tag_f1(pred, ["split"]).collect()}
    assert abs(f1["x"] - 2 / 3) < 1e-9 and f1["y"] == 0
    listed = spark.createDataFrame([("a", "val"), ("b", "val"), ("c", "val")], "intent string, split string")
    rep = {(r.scope, r.intent): r for r in I.per_intent(pred, listed, ["split"]).collect()}
    assert rep["intent", "a"].accuracy == 0.5 and not rep["intent", "a"].warn
    assert rep["intent", "b"].collapse and rep["intent", "b"].warn
    assert rep["intent", "c"].n == 0 and rep["intent", "c"].accuracy is None and not rep["intent", "c"].warn
    assert rep["overall", None].n == 8 and not rep["overall", None].warn


def test_trained_model_scores(spark):
    rows = [(i, "send money transfer", "pay") for i in range(10)] + [(i + 10, "sunny rain weather", "chat") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, text string, intent string")
    m = I.train_intent_model(df, features=256)
    got = {r.id: r.intent for r in I.apply_intent_model(m, df, ["id"]).collect()}
    assert got == {i: "pay" if i < 10 else "chat" for i in range(20)}
