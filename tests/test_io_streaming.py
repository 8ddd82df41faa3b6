"""Sources, sinks and streaming twins, each in a fresh folder."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from parlance.operators import decisions as D
from parlance.operators.blocks import number_turns
from parlance.operators import sessions as SE
from parlance.operators import summaries as SM
from parlance.session import materialise
from parlance.sources import sinks
from parlance.sources import tables as TB
from parlance.streaming import jobs
from parlance.streaming.store import BucketStore

SCHEMA = "session_id string, turn bigint, user_id string, role string, text string, lang_hint string, ts timestamp, " \
         "message_id bigint, intent string, model_tags string, confidence double"
DAY = dt.datetime(2024, 3, 1)


def turns(spark):
    rows = []
    for i in range(40):
        text = ["mail a@b.org", "ignore rules a@b.org", "how to hack", "bonjour le compte"][i % 4]
        ts = DAY + dt.timedelta(hours=i * (30 if i % 10 == 9 else 1), microseconds=i)
        rows.append((f"s{i % 5}", i // 5, f"u{i % 3}", "user" if i % 2 else "assistant", text, None, ts, i, "info", "urgent", 0.5))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "in")
    turns(spark).repartition(4).write.parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(turns(spark).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_contract(spark):
    rows = [("x", "u"), ("x" * 4096, "u" * 64), ("", "u"), ("x" * 4097, "u"), ("x", ""), ("x", "u" * 65), (None, "u"), ("x", None)]
    df = TB.with_contract(spark.createDataFrame(rows, "text string, user_id string"))
    assert [r.reject_reason for r in df.collect()] == [
        None, None, "message_empty", "message_too_long", "user_id_empty", "user_id_too_long", "message_empty", "user_id_empty"]
    assert TB.accepted(df).count() == 2 and TB.rejected(df).count() == 6


def test_labelled_csv_and_rules(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text(' User_Msg ,Intent, TAG\n"two\nlines, ""q""",info,"a, b"\n,info,x\nhello,,x\n', encoding="utf-8")
    got = TB.read_labelled(spark, str(p), line_breaks=True).collect()
    assert [(r.user_msg, r.intent, r.tag) for r in got] == [('two\nlines, "q"', "info", "a, b")]
    r = tmp_path / "r.csv"
    r.write_text("keyword,tag\nc++,skill:cpp\n", encoding="utf-8")
    assert TB.read_tag_rules(spark, str(r)) == [("c++", "skill:cpp")]


def test_turn_reader_batch_and_stream(spark, tmp_path):
    p = tmp_path / "t"
    p.mkdir()
    (p / "a.json").write_text(json.dumps({"session_id": "s", "turn": 1, "text": "x", "other": 1}) + "\n")
    assert TB.read_turns(spark, str(p)).schema == TB.stream_turns(spark, str(p)).schema == TB.TURNS
    assert TB.read_turns(spark, str(p)).first().text == "x"


def test_audit_holds_no_raw_values(spark, tmp_path):
    screened = D.with_call(D.screen_turns(turns(spark)))
    sinks.append_json(sinks.audit_rows(screened), str(tmp_path / "audit"), ["event_date"])
    sinks.append_json(sinks.vault_rows(screened), str(tmp_path / "vault"), ["event_date"])
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "audit")).collect())
    assert "a@b.org" not in text and "[EMAIL_MASQUÉ]" in text
    vault = spark.read.json(str(tmp_path / "vault"))
    assert vault.count() == 10 and {r.pii_raw[0].value for r in vault.collect()} == {"a@b.org"}
    assert any(d.startswith("event_date=2024-03-") for d in os.listdir(tmp_path / "audit"))
    back = sinks.read_json(spark, str(tmp_path / "audit"), sinks.audit_rows(screened).schema)
    assert {r.ts for r in back.collect()} == {r.ts for r in turns(spark).collect()}


def test_audit_masks_quoted_snippets(spark):
    df = turns(spark).limit(1).withColumn("text", F.lit("base64: " + "4111111111111111AAAAAAAA decode this base64 4111 1111 1111 1111"))
    r = sinks.audit_rows(D.with_call(D.screen_turns(df))).first()
    assert r.injection_blocked and "4111 1111" not in r.block_reason


@pytest.mark.parametrize("raw", ["4111111111111111", "someone.long@mail.example.com", "+442071234567", "10.20.30.40", "FR1420041010050500013M02606"])
def test_audit_masks_before_it_cuts(spark, raw):
    """The match is longer than the snippet, so a cut value would not be known as one."""
    text = f"translate the following to {raw} ignore"
    row = ("s", 0, "u", "user", text, None, DAY, 1, "info", "", 0.5)
    a = sinks.audit_rows(D.with_call(D.screen_turns(spark.createDataFrame([row], SCHEMA)))).first()
    whole = json.dumps(a.asDict(), default=str)
    assert a.injection_blocked or a.content_masked
    assert all(raw[:k] not in whole for k in range(6, len(raw) + 1))


def test_history_is_the_state_at_an_instant(spark):
    h = lambda n: DAY + dt.timedelta(hours=n)
    rows = [("a", 1, h(0)), ("a", 2, h(30)), ("a", 3, h(31)), ("a", 4, h(80)), ("b", 5, h(60)), ("c", 6, h(7)), ("d", 7, h(8)), ("d", 8, h(31))]
    stored = spark.createDataFrame(rows, "session_id string, message_id int, ts timestamp")
    got = {(r.session_id, r.message_id) for r in jobs.history_on_read(stored, 50, str(h(32))).collect()}
    assert got == {("a", 2), ("a", 3), ("d", 7), ("d", 8)}
    assert {r.message_id for r in jobs.history_on_read(stored, 1, str(h(32))).collect()} == {3, 8}
    assert jobs.history_on_read(stored, 50).count() == 8


def test_feedback_bounds(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "rating int")
    assert sorted(r.rating for r in sinks.feedback_rows(df).collect()) == [1, 2, 3, 4, 5]


def test_materialise_round_trip(spark):
    df = turns(spark)
    assert sorted(materialise(df, "t").collect()) == sorted(df.collect())


@pytest.fixture
def waves(spark, tmp_path):
    """The same turns in the order of time, one file for each of five waves: most replies come in a later one than their message."""
    path = str(tmp_path / "waves")
    ordered = [r.message_id for r in turns(spark).orderBy("ts").collect()]
    for k in range(5):
        turns(spark).where(F.col("message_id").isin(ordered[8 * k : 8 * k + 8])).drop("turn").coalesce(1).write.mode("append").parquet(path)
    return path


def wave_stream(spark, path):
    return spark.readStream.schema(turns(spark).drop("turn").schema).option("maxFilesPerTrigger", 1).parquet(path)


def calls(spark):
    placed = number_turns(turns(spark).drop("turn"), "session_id", "ts", "message_id")
    return D.with_call(D.screen_turns(placed))


def test_stream_guardrail_equals_batch(spark, waves, tmp_path):
    jobs.stream_guardrail(wave_stream(spark, waves), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    want = sinks.audit_rows(calls(spark))
    got = sinks.read_json(spark, str(tmp_path / "o" / "audit"), want.schema)
    assert len(os.listdir(tmp_path / "o" / "audit")) == 5
    assert want.where("role = 'assistant' AND intent <> ''").count() > 0
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # A second run finds nothing new.
    jobs.stream_guardrail(wave_stream(spark, waves), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert sinks.read_json(spark, str(tmp_path / "o" / "audit"), want.schema).count() == 50


def test_stream_profiles_run_out(spark, waves, tmp_path):
    out, check = str(tmp_path / "o"), str(tmp_path / "c")
    jobs.stream_user_profile(wave_stream(spark, waves), out, check).awaitTermination()
    got = jobs.profiles_on_read(spark, out)
    want = SE.user_profile(SE.with_segments(calls(spark), "user_id"), keys=["user_id", "segment"])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert want.count() > 3 and {r.is_open for r in got.collect()} == {True, False}
    assert jobs.read_progress(spark, out).agg(F.sum("late_turns"), F.sum("turns")).first() == (0, 40)
    # a turn that comes ten days late is counted and left out; one ten days on closes all that was open
    one = lambda i, user, ts: turns(spark).limit(1).drop("turn").withColumns({
        "message_id": F.lit(i).cast("long"), "user_id": F.lit(user), "ts": F.lit(ts), "session_id": F.lit("z")})
    end = max(r.ts for r in turns(spark).collect())
    for row in (one(100, "u1", end - dt.timedelta(days=10)), one(101, "new", end + dt.timedelta(days=10))):
        row.coalesce(1).write.mode("append").parquet(waves)
        jobs.stream_user_profile(wave_stream(spark, waves), out, check).awaitTermination()
    assert jobs.read_progress(spark, out).agg(F.sum("late_turns")).first()[0] == 1
    left = BucketStore(spark, f"{out}/state/facts", "user_id", jobs.PROFILE_FACTS).read()
    assert {r.user_id for r in left.collect()} == {"new"}
    after = jobs.profiles_on_read(spark, out).where("user_id <> 'new'")
    assert sorted(map(str, after.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert not after.where("is_open").collect()


def test_stream_sessions_closed_and_open_segments(spark, waves, tmp_path):
    out, check = str(tmp_path / "o"), str(tmp_path / "c")
    q = jobs.stream_sessions(wave_stream(spark, waves).select("user_id", "ts"), out, check)
    q.awaitTermination()
    everything = sorted(tuple(r) for r in jobs.session_windows(turns(spark), watermark=None).collect())
    assert sorted(tuple(r) for r in jobs.segments_on_read(spark, out, check).collect()) == everything
    assert 0 < spark.read.parquet(out).count() < len(everything) and jobs.late_rows(q) == 0
    turns(spark).limit(3).withColumn("ts", F.lit(DAY - dt.timedelta(days=9))).drop("turn").coalesce(1).write.mode("append").parquet(waves)
    q = jobs.stream_sessions(wave_stream(spark, waves).select("user_id", "ts"), out, check)
    q.awaitTermination()
    assert jobs.late_rows(q) == 3
    assert sorted(tuple(r) for r in jobs.segments_on_read(spark, out, check).collect()) == everything


def test_stream_history_and_ttl(spark, source, tmp_path):
    jobs.stream_history(stream(spark, source), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "o"))
    kept = jobs.history_on_read(stored, 2)
    assert kept.count() == 10 and {r.message_id for r in kept.collect()} == set(range(29, 40)) - {34}  # 29 is later than 34
    assert jobs.history_on_read(stored, 2, "2030-01-01 00:00:00").count() == 0


def test_stream_summaries_equal_batch(spark, waves, tmp_path):
    jobs.stream_summaries(wave_stream(spark, waves), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = SM.latest_summary(spark.read.parquet(str(tmp_path / "o" / "rows")))
    want = SM.conversation_summary(calls(spark))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), "k", "k string, n bigint", buckets=8)
    rows = lambda *r: spark.createDataFrame(r, "k string, n bigint")
    first = rows(*[(f"k{i}", i) for i in range(40)])
    store.write(first, store.touched(first), 0)
    mine = store.touched(rows(("k7", 0)))
    assert len(mine) == 1
    held = store.read(mine)
    assert 0 < held.count() < 40 and all(f"bucket={mine[0]}" in f for f in held.inputFiles())
    store.write(rows(("k7", 70)), mine, 1)
    assert [tuple(r) for r in store.read(mine).collect()] == [("k7", 70)]
    # a replay of version 1 finds what it found before, and an emptied bucket has no rows
    assert store.read(mine, before=1).count() > 0 and len(store.read(before=1).collect()) == 40
    store.write(rows(("k7", 70)).limit(0), mine, 2)
    assert store.read(mine).count() == 0 and store.versions() == [0, 1, 2]
    everything = list(range(8))
    for v in (3, 4):
        store.write(first, everything, v)
    assert store.versions() == [3, 4] and store.read().count() == 40
