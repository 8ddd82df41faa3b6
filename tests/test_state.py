"""State that runs out, erasure from stored tables, rule tables, and scoring with many tags."""

import datetime as dt
import os
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import safety as S
from parlance.functions.conditions import run_condition, word_clauses
from parlance.functions.rulesets import BASE, EXTENDED
from parlance.operators import corpus as CO
from parlance.operators import intent as I
from parlance.operators import safety as O
from parlance.operators import sessions as SE
from parlance.operators import tagging as TA
from parlance.rules import safety as R
from parlance.rules import sets as RS
from parlance.session import materialise
from parlance.sources import erase as ER
from parlance.sources import rules as RU
from parlance.sources import sinks

DAY = dt.datetime(2024, 3, 1)
HOUR = dt.timedelta(hours=1)


# ---- segments ---------------------------------------------------------------
def brute_segments(times, gap):
    out, now = {}, 0
    for i, t in enumerate(sorted(times)):
        if not i or t - last >= gap:  # noqa: F821
            now += 1
        out[t], last = now, t
    return out


@pytest.mark.parametrize("gap_hours", [24, 1, 0.25])
def test_turns_get_their_segment(spark, gap_hours):
    gap = dt.timedelta(hours=gap_hours)
    times = {f"k{k}": [DAY + dt.timedelta(minutes=(i * i * (k + 3)) % 9000, seconds=i) for i in range(60)] for k in range(3)}
    rows = [(k, t) for k, ts in times.items() for t in ts]
    got = SE.with_segments(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", int(gap.total_seconds())).collect()
    want = {k: brute_segments(ts, gap) for k, ts in times.items()}
    assert len(got) == 180 and all(r.segment == want[r.k][r.ts] for r in got)


def test_live_turns_are_the_last_segment_if_it_has_not_run_out(spark):
    rows = [("a", 0), ("a", 23), ("a", 47), ("b", 0), ("b", 20), ("c", 50), ("c", 80), ("d", 0), ("d", 30)]
    df = spark.createDataFrame([(k, DAY + h * HOUR) for k, h in rows], "k string, ts timestamp")
    live = lambda h: sorted((r.k, int((r.ts - DAY) / HOUR)) for r in SE.live_turns(df, "k", str(DAY + h * HOUR)).collect())
    assert live(50) == [("a", 47), ("c", 50), ("d", 30)]
    assert live(47) == [("a", 47), ("d", 30)]
    assert live(44) == [("a", 0), ("a", 23), ("d", 30)]
    assert live(200) == [] and live(-1) == []


def test_profile_counts_without_sorting_facts(spark):
    """Facts are counted by hashing: no plan sorts exploded facts or text."""
    from tests.test_io_streaming import calls, turns  # noqa: F401

    plan = SE.user_profile(calls(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


# ---- erasure ----------------------------------------------------------------
def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_erasure_rewrites_only_the_days_that_hold_a_key(spark, tmp_path, fmt):
    rows = [(f"s{i % 5}" if i < 20 else "lonely", i, f"text {i}", (DAY + (i // 4) * 24 * HOUR).date()) for i in range(22)] + [(None, 99, "no key", DAY.date())]
    df = spark.createDataFrame(rows, "session_id string, n int, text string, event_date date")
    path = str(tmp_path / "t")
    if fmt == "parquet":
        ER.write_by_day(df, path)
    else:
        sinks.append_json(df, path, ["event_date"])
    before = files(path)
    gone = spark.createDataFrame([("lonely",), ("s0",), ("absent",), (None,)], "session_id string")
    days = ER.erase_sessions(spark, path, df.schema, gone, fmt)
    left = {(r.session_id, r.n) for r in spark.read.schema(df.schema).format(fmt).load(path).collect()}
    assert left == {(s, n) for s, n, *_ in rows if s not in ("lonely", "s0")}
    held = {str(d) for s, _, _, d in rows if s in ("lonely", "s0")}
    assert set(days) == held
    after = files(path)
    untouched = {f: t for f, t in before.items() if not any(f"event_date={d}" in f for d in held)}
    assert untouched and all(after.get(f) == t for f, t in untouched.items())
    assert not any(f"event_date={rows[20][3]}" in f for f in after), "a day of which nothing stays has no files"
    # again: nothing to do
    assert ER.erase_everywhere(spark, {"t": (path, df.schema, fmt, {})}, gone) == {"t": []}
    assert files(path) == after


# ---- rule tables ------------------------------------------------------------
def _folded(text):
    for a, b in R.FOLD_EXTRA:
        text = text.replace(a, b)
    return text.lower()


@pytest.mark.parametrize("label,pattern", [(r[3], r[4]) for r in [*RS.BASE_ROWS, *RS.EXTENDED_ROWS] if r[1] != "pii"])
def test_derived_words_are_necessary(label, pattern):
    clauses = word_clauses(pattern)
    assert clauses or label == "hate_speech"

    @settings(max_examples=80, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, re.IGNORECASE | (re.MULTILINE if label in R.MULTILINE_RULES else 0))))
    def check(text):
        assert all(any(w in _folded(text) for w in clause) for clause in clauses)

    check()


@pytest.mark.parametrize("label,pattern", [(r[3], r[4]) for r in [*RS.BASE_ROWS, *RS.EXTENDED_ROWS] if r[1] == "pii"])
def test_derived_runs_are_necessary(label, pattern):
    condition = run_condition(pattern)
    assert condition
    short = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), condition)

    @settings(max_examples=80, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern)))
    def check(text):
        assert re.search(short, text)

    check()


@pytest.mark.parametrize("pattern,clauses", [
    (r"abc|x+", []), (r"(ab|cd)+e?", [["ab", "cd"]]), (r"foo\s*bar(baz)?", [["foo"], ["bar"]]), (r"[fg]oo", [["oo"]]), (r"a(?P<n>bc)d", [["abcd"]]),
    (r"(?<=x)yz", [["yz"]]), (r"colou?r", [["colo"]]), (r"É(tat|cole)", [["cole", "tat"]]), (r"(((", []), (r"", [])])
def test_words_of_patterns(pattern, clauses):
    assert word_clauses(pattern) == clauses


def test_an_added_rule_needs_no_code(spark, tmp_path):
    path = str(tmp_path / "rules")
    own = spark.createDataFrame([("mine", "injection", 5.0, "beg", r"pretty\s+please", None, False),
                                 ("mine", "pii", 5.0, "badge", r"\bB-\d{4}\b", "[BADGE]", False)], RS.COLUMNS)
    RU.rules_table(spark).union(own).write.json(path)
    rules = RU.read_rules(spark, path, ("base", "mine"))
    texts = spark.createDataFrame([(1, "Pretty  PLEASE do"), (2, "badge B-1234 and a@b.org"), (3, "ignore rules"), (4, None), (5, "")], "id int, text string")
    got = {r.id: (r.block_layer, r.masked_text) for r in O.guardrail(texts, rules=rules).collect()}
    assert got[1][0] == got[3][0] == "injection"
    assert got[2] == ("", "badge [BADGE] and [EMAIL_MASQUÉ]") and got[5] == ("", "")
    base = {r.id: r.block_layer for r in O.guardrail(texts).collect()}
    assert base[1] == "" and base[3] == "injection"


def test_faulty_rules_are_named(spark):
    bad = [("x", "injection", 1.0, "open", "(", None, False), ("x", "pii", 2.0, "unmasked", "a", None, False), ("x", "other", 3.0, "l", "a", None, False),
           ("x", "nsfw", 4.0, "empty", "a*", None, False), ("x", "nsfw", 5.0, "it's", "a", None, False), ("x", "nsfw", None, "p", "a", None, False)]
    with pytest.raises(ValueError) as e:
        RU.load_rules(spark.createDataFrame(bad, RS.COLUMNS), ("x",))
    assert all(x in str(e.value) for x in ("injection/open", "needs a mask", "other/l", "empty text", "nsfw/it's", "place"))
    none = RU.load_rules(RU.rules_table(spark), ("none",))
    assert O.guardrail(spark.createDataFrame([("a@b.org",)], "text string"), rules=none).first().masked_text == "a@b.org"


def test_loaded_rules_equal_the_built_in_ones(spark):
    assert RU.load_rules(RU.rules_table(spark)) == BASE and RU.load_rules(RU.rules_table(spark), ("base", "extended")) == EXTENDED
    gaps = ["card 3714 496353 98431 ok", "call +1 415-555-2671 now", "passport AB1234567", "tel +33 6 12 34 56 78 x"]
    df = spark.createDataFrame([(t,) for t in gaps], "text string")
    masked = [r[0] for r in df.select(S.mask_pii("text", EXTENDED)).collect()]
    assert masked == ["card [CARTE_MASQUÉE] ok", "call [TEL_MASQUÉ] now", "passport [PASSEPORT_MASQUÉ]", "tel [TEL_MASQUÉ] x"]


# ---- tags by a large table --------------------------------------------------
def test_indexed_tags_match_a_search_for_every_keyword(spark):
    words = [f"{a}{b}{c}x" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzäöüß"]
    rules = [(w, f"Tag:{w[:2]}") for w in words] + [("é", "Short:e"), ("xy", "Short:xy"), ("", "Empty:"), ("aku", "Unofficial:x"), ("akux", "language:x"), ("𝒳yz", "Astral:x")]
    official = sorted({t for _, t in rules if not t.startswith("Unofficial")})
    texts = [(i, t) for i, t in enumerate(["AKUX and BLVX", "", None, "É alone", "xy", "x𝒳yz", "aku", "akuxblvx" * 50, "nothing here"])] + [(0, "AKUX and BLVX")]
    df = spark.createDataFrame(texts, "id int, text string")
    index = TA.keyword_index(spark.createDataFrame(rules, "keyword string, tag string"), spark.createDataFrame([(t,) for t in official], "tag string"), df)
    got = {(r.id, r.tag) for r in TA.indexed_tags(df, index, ["id"]).collect()}
    want = {(i, tag) for i, t in texts for k, tag in rules if t and k and k in t.lower() and tag in official and not tag.startswith("language:")}
    assert got == want and len(want) > 6
    plan = TA.indexed_tags(df, index, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000, "the plan does not grow with the rules"


# ---- scoring ----------------------------------------------------------------
def labelled(spark, tags):
    rows = [(i, f"word{i % 7} tag{i % tags} common {'é' * (i % 3)} the-end", f"in{i % 4}", [f"t{i % tags}"]) for i in range(3 * tags)]
    return spark.createDataFrame(rows, "id int, text string, intent string, tags array<string>")


def test_scores_of_300_tags_without_a_shuffle(spark):
    data = labelled(spark, 300)
    v = materialise(CO.vocab(CO.token_counts(data)), "vocab")
    model = materialise(I.linear_model(data, v), "model")
    scores = I.linear_scores(data.unionByName(spark.createDataFrame([(-1, None, None, None)], data.schema)), model, ["id"])
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and len(plan) < 20_000
    got = {r.id: r for r in scores.collect()}
    assert len(got) == 901 and got[-1].intent is not None and got[-1].tags == []
    # the weights by hand
    w = {(r["head"], r["class"], r["token"]): r.w for r in model.collect()}
    token_lists = {r.id: r.tokens for r in I._tokens(data, "text", "id").collect()}
    import math

    for i in (0, 17, 450, 899):
        z = {c: w["intent", c, None] + sum(w.get(("intent", c, t), 0) for t in token_lists[i]) for c in ("in0", "in1", "in2", "in3")}
        best = max(z, key=lambda c: (z[c], c))
        assert got[i].intent == best and abs(got[i].confidence - 1 / sum(math.exp(x - z[best]) for x in z.values())) < 1e-9
        p = lambda t: 1 / (1 + math.exp(sum(
            s * (w[f"tag:{t}", c, None] + sum(w.get((f"tag:{t}", c, x), 0) for x in token_lists[i])) for c, s in (("no", 1), ("yes", -1)))))
        assert set(got[i].tags) == {t for t in (f"t{k}" for k in range(300)) if p(t) > 0.35}


def test_a_model_beyond_the_bound_is_refused(spark, monkeypatch):
    data = labelled(spark, 5)
    v = materialise(CO.vocab(CO.token_counts(data)), "vocab")
    model = materialise(I.linear_model(data, v), "model")
    monkeypatch.setattr(I, "MODEL_BYTES", 100)
    with pytest.raises(ValueError, match="smaller vocabulary"):
        I.linear_scores(data, model, ["id"])


def test_trained_heads_survive_saving(spark, tmp_path):
    from pyspark.ml import PipelineModel

    data = labelled(spark, 3).withColumn("tags", F.when(F.col("id") % 2 == 0, F.col("tags")).otherwise(F.array().cast("array<string>")))
    model = I.train_intent_model(data, tags="tags", features=256)
    model.save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    one, two = (sorted(map(str, I.apply_intent_model(m, data, ["id"]).collect())) for m in (model, again))
    assert one == two and len(one) == 9
    assert sum(len(r.tags) for r in I.apply_intent_model(again, data, ["id"]).collect()) > 0
