"""One callable per registered query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import language as LG
from parlance.functions import tags as TG
from parlance.operators import corpus as CO
from parlance.operators import decisions as D
from parlance.operators import intent as I
from parlance.operators import safety as SF
from parlance.operators import sessions as SE
from parlance.operators import summaries as SM
from parlance.operators import tagging as TA
from parlance.operators.blocks import number_turns
from parlance.plans import views as V
from parlance.session import materialise, work_dir
from parlance.sources import erase as ER
from parlance.sources import rules as RU
from parlance.sources import sinks
from parlance.sources import tables as TB
from parlance.streaming import jobs

QUERIES: dict = {}
KEY = ["text_id", "origin"]
AS_OF = "2024-01-20 12:00:00"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def bar(c: Column | str) -> Column:
    return F.array_join(c, "|")


def us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


# ---- sources and sinks ------------------------------------------------------
@query
def turn_source(spark: SparkSession, sf: str) -> DataFrame:
    t = V.conversation_turns(spark, sf)
    return TB.as_turns(t, **{c: F.col(c) for c in t.columns}).select(
        "session_id", "turn", "user_id", "role", "text", "lang_hint")


@query
def turn_quarantine(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("user_id"))
    out = TB.with_contract(d)
    return out.select("doc_id", "user_id", F.length("text").cast("bigint").alias("chars"),
                      F.coalesce("reject_reason", F.lit("accepted")).alias("status"))


@query
def labelled_source(spark, sf):
    """Written as CSV with untidy headers, then read as a user would."""
    path = work_dir(spark, "labelled")
    V.labelled_raw(spark, sf).write.option("header", True).option("escape", '"').option("lineSep", "\n").csv(path)
    return TB.read_labelled(spark, path, line_breaks=True).withColumn("doc_id", F.col("doc_id").cast("long"))


@query
def official_tags(spark, sf):
    return TA.official_tags(V.tag_sheet(spark, sf), "tag", "row_no")


def _flat_audit(df):
    return df.select(
        us("ts").alias("ts_us"), "ts_human", "user_id", "session_id", "role", "lang", "intent", bar("tags").alias("tags"),
        "content_masked", "injection_blocked", bar("injection_labels").alias("injection_labels"), "nsfw_blocked",
        bar("nsfw_categories").alias("nsfw_categories"), bar("pii_detected").alias("pii_detected"), "pii_count",
        "is_blocked", "block_reason", "block_layer", F.col("event_date").cast("string").alias("event_date"))


@query
def audit_log(spark, sf):
    """Append to the day-partitioned sink, then read it back."""
    rows = sinks.audit_rows(D.with_call(V.screened_chat(spark, sf)))
    path = work_dir(spark, "audit")
    sinks.append_json(rows, path, ["event_date"])
    return _flat_audit(sinks.read_json(spark, path, rows.schema))


def _flat_vault(df):
    raw = F.transform("pii_raw", lambda p: F.concat(p["type"], F.lit("="), p["value"]))
    return df.select(us("ts").alias("ts_us"), "ts_human", "user_id", "session_id", "pii_count", bar(raw).alias("pii_raw"),
                     F.col("event_date").cast("string").alias("event_date"))


@query
def pii_vault(spark, sf):
    rows = sinks.vault_rows(SF.guardrail(V.chat_events(spark, sf)))
    path = work_dir(spark, "vault")
    sinks.append_json(rows, path, ["event_date"])
    return _flat_vault(sinks.read_json(spark, path, rows.schema))


def _flat_summary(df, *more):
    return df.select(
        *more, "session_id", "user_id", "lang", us("created_at").alias("created_us"), "summary_text", "summary_lang",
        "primary_intent", bar("all_intents").alias("all_intents"), bar("all_tags").alias("all_tags"), "total_turns",
        "user_turns", "assistant_turns", F.round("avg_user_msg_len", 6).alias("avg_user_msg_len"), "risk_level",
        bar("pii_types_detected").alias("pii_types_detected"), "was_blocked",
        bar("recommended_actions").alias("recommended_actions"), "needs_human_takeover", "escalation_reason")


def _summaries(spark, sf):
    return SM.conversation_summary(V.screened_chat(spark, sf))


def _two_appends(spark, sf):
    """Summary sink after two appends: one of the first half of each session's
    turns, one of all turns, as background refreshes leave them."""
    turns = materialise(V.screened_chat(spark, sf).select(
        "session_id", "turn", "ts", "user_id", "role", "lang", "intent", "tags", "pii", "is_blocked", "masked_text"),
        "screened")
    path = work_dir(spark, "summaries")
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("n"))
    half = turns.join(sizes, "session_id").where("2 * turn < n").drop("n")
    for run, part in (("half", half), ("full", turns)):
        rows = sinks.summary_rows(SM.conversation_summary(part), run)
        sinks.append_json(rows, path, ["event_date"])
    return sinks.read_json(spark, path, rows.schema)


@query
def summary_sink(spark, sf):
    return _flat_summary(_two_appends(spark, sf), "run_id", F.col("event_date").cast("string").alias("event_date"))


@query
def summary_lookup(spark, sf):
    """The latest stored summary of every session."""
    v = SM.summary_view(_two_appends(spark, sf))
    for c in ("all_intents", "all_tags", "recommended_actions"):
        v = v.withColumn(c, bar(c))
    return v


@query
def feedback_log(spark, sf):
    rows = sinks.feedback_rows(V.feedback(spark, sf)).withColumn("event_date", F.to_date("ts"))
    path = work_dir(spark, "feedback")
    sinks.append_json(rows, path, ["event_date"])
    return sinks.read_json(spark, path, rows.schema).select(
        us("ts").alias("ts_us"), "session_id", "message_index", "rating", "comment")


# ---- safety -----------------------------------------------------------------
@query
def injection_matches(spark, sf):
    return SF.injection_matches(V.all_texts(spark, sf), KEY)


@query
def injection_blocked(spark, sf):
    return SF.injection_blocked(V.all_texts(spark, sf), KEY)


@query
def nsfw_matches(spark, sf):
    return SF.nsfw_matches(V.all_texts(spark, sf), KEY)


@query
def guardrail_verdict(spark, sf):
    return SF.verdict_columns(SF.guardrail(V.all_texts(spark, sf)), KEY)


def _loaded_rules(spark):
    """All rules, base and extended, from the table a user would edit."""
    path = work_dir(spark, "rules")
    RU.rules_table(spark).write.json(path)
    return RU.read_rules(spark, path, ("base", "extended"))


@query
def guardrail_extended(spark, sf):
    """Verdicts by a rule table: the base rules and our additions."""
    return SF.verdict_columns(SF.guardrail(V.all_texts(spark, sf), rules=_loaded_rules(spark)), KEY)


@query
def pii_matches(spark, sf):
    return SF.pii_matches(V.all_texts(spark, sf), KEY).drop("value")


@query
def pii_masked(spark, sf):
    return SF.pii_masked(V.all_texts(spark, sf), KEY)


@query
def pii_type_summary(spark, sf):
    return SF.pii_type_summary(SF.pii_matches(V.all_texts(spark, sf), KEY), ["origin"])


@query
def pii_fingerprints(spark, sf):
    return SF.pii_linkage(SF.pii_matches(V.all_texts(spark, sf), KEY), ["text_id"])


@query
def pii_user_fingerprints(spark, sf):
    m = SF.pii_matches(V.chat_events(spark, sf), ["user_id", "ts", "message_id"])
    out = SF.user_fingerprints(m, "user_id", ["ts", "message_id"])
    return out.select("user_id", "pii_type", "value_hash", "n", F.col("first_seen.message_id").alias("first_message"))


@query
def response_leaks(spark, sf):
    return SF.leak_rates(SF.guardrail(V.chat_events(spark, sf)))


# ---- tags and language ------------------------------------------------------
@query
def keyword_tags(spark, sf):
    t = V.all_texts(spark, sf)
    return t.select(*KEY, F.explode(TG.keyword_tags("text")).alias("tag"))


@query
def keyword_tags_indexed(spark, sf):
    """Tags by a rule table that grows with the data: every long word of the benchmark is a keyword for its first two letters."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    rules = V.table(spark, sf, "benchmark").select(words.alias("keyword")).distinct().withColumn(
        "tag", F.concat(F.lit("Word:"), F.substring("keyword", 1, 2)))
    texts = V.all_texts(spark, sf)
    index = TA.keyword_index(rules, rules.select("tag").distinct(), texts)
    return TA.indexed_tags(texts, index, KEY)


@query
def script_tags(spark, sf):
    return V.all_texts(spark, sf).select(*KEY, bar(TG.script_tags("text")).alias("script_tag"))


@query
def tag_precedence(spark, sf):
    t = V.existing_tags(spark, sf)
    return t.select("message_id", "existing", TG.enrich("text", "existing").alias("tags"))


@query
def tag_conflicts(spark, sf):
    t = V.all_texts(spark, sf)
    t = t.withColumn("raw", TG.keyword_tags("text"))
    return t.select(*KEY, bar(TG.resolve_conflicts("raw")).alias("tags"), F.size("raw").cast("bigint").alias("before"))


@query
def tag_merge(spark, sf):
    t = V.chat_events(spark, sf)
    return t.select("message_id", bar(TG.merge_tags(TG.split_list_sql("model_tags"), "text")).alias("tags"))


@query
def language_id(spark, sf):
    return V.all_texts(spark, sf).select(*KEY, LG.detect_language("text").alias("lang"))


@query
def language_profile(spark, sf):
    d = V.texts_of(spark, sf, "documents", "lang", "text").select(F.col("lang").alias("declared"),
                                                                  LG.detect_language("text").alias("detected"))
    return TA.language_profile(d, "declared", "detected")


@query
def language_resolved(spark, sf):
    t = D.screen_turns(V.chat_events(spark, sf))
    return t.select("message_id", "lang_hint", "lang")


@query
def tag_frequency(spark, sf):
    t = V.all_texts(spark, sf).select(TG.rule_tags("text").alias("tags"))
    return TA.tag_frequency(t)


@query
def tag_multi_hot(spark, sf):
    """Texts are tagged once: the written tags are counted, then turned into vectors."""
    t = materialise(V.all_texts(spark, sf).select(*KEY, TG.rule_tags("text").alias("tags")), "rule-tags")
    hot = TA.tag_multi_hot(t, TA.tag_frequency(t), KEY)
    return hot.select(*KEY, F.array_join(F.transform("vector", lambda v: v.cast("int").cast("string")), "").alias("vector"))


@query
def intent_auto_tags(spark, sf):
    t = TA.intent_auto_tags(V.chat_events(spark, sf))
    return t.select("message_id", "intent", bar("auto_tags").alias("auto_tags"))


# ---- text features and corpus ----------------------------------------------
@query
def tokens(spark, sf):
    return CO.tokens(V.texts_of(spark, sf, "documents", "doc_id", "text"), ["doc_id"])


def _counts(spark, sf):
    return CO.token_counts(V.texts_of(spark, sf, "documents", "text"))


@query
def vocab(spark, sf):
    return CO.vocab(_counts(spark, sf))


@query
def vocab_coverage(spark, sf):
    counts = _counts(spark, sf)
    return CO.vocab_coverage(counts, materialise(CO.vocab(counts), "vocab"))


@query
def encoded_sequences(spark, sf):
    v = materialise(CO.vocab(_counts(spark, sf)), "vocab")
    out = CO.encoded_sequences(V.texts_of(spark, sf, "documents", "doc_id", "text"), v, ["doc_id"])
    return out.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query
def augmented_corpus(spark, sf):
    d = V.texts_of(spark, sf, "documents", "doc_id", "text", "lang").select(
        "doc_id", F.col("text").alias("user_msg"), F.col("lang").alias("intent"))
    return CO.augmented_corpus(d, "doc_id", "user_msg")


@query
def stratified_split(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("intent"))
    return CO.stratified_split(d, "doc_id", "intent")


@query
def intent_index(spark, sf):
    return CO.intent_index(V.chat_events(spark, sf))


def _labelled(spark, sf):
    """All documents: intent is the language, tags come from the labels."""
    d, lab = V.texts_of(spark, sf, "documents", "doc_id", "text", "lang"), V.table(spark, sf, "labels")
    t = d.select("doc_id", "text", F.col("lang").alias("intent")).join(lab, "doc_id", "left")
    tags = F.filter(F.array(F.when(F.col("quality") == 1, "quality:high"), F.when(F.col("toxic") == 1, "toxic")),
                    lambda t: t.isNotNull())
    ids = V.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("intent"))
    split = CO.stratified_split(ids, "doc_id", "intent")
    return t.select("doc_id", "text", "intent", tags.alias("true_tags")).join(
        split.select("doc_id", "split"), "doc_id")


def _scored(spark, sf):
    data = materialise(_labelled(spark, sf), "labelled")
    train = data.where(F.col("split") == "train")
    words = materialise(CO.word_counts(train, ["intent", "true_tags"]), "word-counts")
    v = materialise(CO.vocab(CO.token_counts(train, words=words)), "vocab")
    model = materialise(I.linear_model(train, v, tags="true_tags", words=words), "model")
    scores = I.linear_scores(data, model, ["doc_id"])
    return data, scores


@query
def intent_scores(spark, sf):
    data, scores = _scored(spark, sf)
    out = data.select("doc_id", "split", LG.detect_language("text").alias("lang")).join(scores, "doc_id", "left")
    return out.select("doc_id", "split", "lang", "intent", F.round("confidence", 4).alias("confidence"),
                      bar("tags").alias("tags"))


@query
def intent_model(spark, sf):
    """The trained model, saved and loaded: by split, its rows and classes and whether it beats the commonest class."""
    data = materialise(_labelled(spark, sf), "labelled")
    path = work_dir(spark, "intent-model")
    I.train_intent_model(data.where(F.col("split") == "train"), tags="true_tags").save(path)
    model = PipelineModel.load(path)
    guess = I.apply_intent_model(model, data.withColumnRenamed("intent", "truth"), ["doc_id", "split", "truth"])
    heads = sum(isinstance(s, LogisticRegressionModel) for s in model.stages) - 1
    return I.above_majority(guess.withColumnRenamed("intent", "guess"), ["split"]).withColumn("tag_heads", F.lit(heads).cast("long"))


def _predictions(spark, sf):
    data, scores = _scored(spark, sf)
    return data.select("doc_id", "split", "true_tags", F.col("intent").alias("truth")).join(
        scores.select("doc_id", F.col("intent").alias("guess"), "tags"), "doc_id", "left")


@query
def eval_intent_accuracy(spark, sf):
    return I.intent_accuracy(_predictions(spark, sf), ["split"])


@query
def eval_tag_macro_f1(spark, sf):
    p = _predictions(spark, sf).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return I.tag_macro_f1(I.tag_f1(p, ["split"]), ["split"])


@query
def eval_per_intent(spark, sf):
    d = V.table(spark, sf, "documents")
    listed = CO.intent_index(d, "lang").select("intent", F.explode(F.array(F.lit("train"), F.lit("eval"))).alias("split"))
    return I.per_intent(_predictions(spark, sf), listed, ["split"])


# ---- sessions and users -----------------------------------------------------
@query
def user_profile(spark, sf):
    return _flat_profile(SE.user_profile(D.with_call(V.screened_chat(spark, sf).drop("text", "masked_text"))))


def _masked_turns(spark, sf):
    t = SF.guardrail(V.chat_events(spark, sf)).select("message_id", "session_id", "user_id", "ts", "role", "masked_text")
    return number_turns(t, "session_id", "ts", "message_id").drop("ts", "message_id")


@query
def session_history(spark, sf):
    return SE.session_history(_masked_turns(spark, sf))


@query
def session_history_3(spark, sf):
    return SE.session_history(_masked_turns(spark, sf), 3)


@query
def context_window(spark, sf):
    out = SE.context_window(D.with_call(V.screened_chat(spark, sf).drop("text")))
    lines = F.transform("context", lambda c: F.concat(c["role"], F.lit(": "), c["content"]))
    return out.select("session_id", "turn", "hint", F.array_join(lines, "\n").alias("context"))


@query
def session_segments(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = None
    for name, seconds in (("session", 86_400), ("summary", 7 * 86_400)):
        s = SE.session_segments(e, "user_id", "ts", seconds, AS_OF).withColumn("state", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out.select("state", "user_id", "segment", us("started").alias("started_us"), us("ended").alias("ended_us"),
                      "turns", "live")


@query
def session_erase(spark, sf):
    """Stored history after the sessions with a harmful message are erased from it: their days are rewritten."""
    turns = materialise(V.chat_events(spark, sf).select("message_id", "session_id", "role", "intent", F.to_date("ts").alias("event_date")), "history")
    path = work_dir(spark, "history")
    ER.write_by_day(turns, path)
    ER.erase_sessions(spark, path, turns.schema, turns.where(F.col("intent") == "harmful"))
    return spark.read.schema(turns.schema).parquet(path).select("message_id", "session_id", "role")


@query
def session_view(spark, sf):
    t = materialise(V.screened_chat(spark, sf).drop("hits", "text"), "screened")
    return SE.session_view(t, SE.user_profile(D.with_call(t)))


def _long_calls(spark, sf):
    """Turns of long sessions with what each screening was given, written once."""
    return materialise(D.with_call(V.long_chat(spark, sf)), "long-calls")


def _flat_profile(p):
    return p.withColumn("created_us", us("created_at")).withColumn("updated_us", us("updated_at")).drop("created_at", "updated_at")


@query
def user_profile_segments(spark, sf):
    """Profiles that run out: one for each run of a user's activity without a silence of 24 hours."""
    return _flat_profile(SE.user_profile(SE.with_segments(_long_calls(spark, sf), "user_id"), keys=["user_id", "segment"]))


@query
def user_hashes_segments(spark, sf):
    """The hashes by type that each of those profiles holds, one row each."""
    t = SE.with_segments(V.as_long_sessions(V.chat_events(spark, sf)), "user_id")
    m = SF.pii_matches(t, ["user_id", "segment", "ts", "message_id"])
    out = SF.user_fingerprints(m, "user_id", ["ts", "message_id"], ["segment"])
    return out.select("user_id", "segment", "pii_type", "value_hash", "n", F.col("first_seen.message_id").alias("first_message"))


@query
def user_profile_live(spark, sf):
    """Profiles as they stand at an instant."""
    return _flat_profile(SE.user_profile(SE.live_turns(_long_calls(spark, sf), "user_id", AS_OF)))


@query
def session_history_live(spark, sf):
    """Stored turns as they stand at an instant."""
    t = SE.live_turns(V.long_chat(spark, sf), "session_id", AS_OF).select("session_id", "user_id", "turn", "role", "masked_text")
    return SE.session_history(t)


@query
def context_window_segments(spark, sf):
    t = SE.with_segments(_long_calls(spark, sf), "session_id")
    out = SE.context_window(t, keys=["session_id", "segment"])
    lines = F.transform("context", lambda c: F.concat(c["role"], F.lit(": "), c["content"]))
    return out.select("session_id", "segment", "turn", "hint", F.array_join(lines, "\n").alias("context"))


@query
def repetition_score_segments(spark, sf):
    t = SE.with_segments(V.long_chat(spark, sf), "session_id")
    out = SE.repetition_score(t, "masked_text", keys=["session_id", "segment"])
    return out.withColumn("repetition", F.round("repetition", 6))


@query
def session_view_live(spark, sf):
    return SE.session_view_live(_long_calls(spark, sf), AS_OF)


def _repetition(spark, sf):
    return SE.repetition_score(V.conversation_turns(spark, sf))


@query
def repetition_score(spark, sf):
    return _repetition(spark, sf).withColumn("repetition", F.round("repetition", 6))


@query
def repetition_flags(spark, sf):
    return SE.repetition_flags(_repetition(spark, sf))


@query
def repetition_flags_10(spark, sf):
    return SE.repetition_flags(_repetition(spark, sf), 0.1)


# ---- summaries and risk -----------------------------------------------------
@query
def conversation_stats(spark, sf):
    return SM.conversation_stats(V.conversation_turns(spark, sf)).withColumn(
        "avg_user_msg_len", F.round("avg_user_msg_len", 6))


@query
def primary_intent(spark, sf):
    return SM.primary_intent(V.chat_turns(spark, sf))


@query
def session_risk(spark, sf):
    f = SM.session_facts(V.screened_chat(spark, sf))
    risk = SM.risk_level(F.col("all_intents"), F.col("all_tags"), F.col("pii_types_detected"))
    return f.select("session_id", risk.alias("risk_level"), F.size("all_intents").cast("bigint").alias("intents"))


@query
def recommended_actions(spark, sf):
    f = SM.session_facts(V.screened_chat(spark, sf))
    return f.select("session_id", bar(SM.recommended_actions(F.col("all_intents"), F.col("pii_types_detected"))).alias(
        "recommended_actions"))


@query
def conversation_summary(spark, sf):
    return _flat_summary(_summaries(spark, sf))


@query
def transcript(spark, sf):
    return SM.transcript(V.conversation_turns(spark, sf))


@query
def turn_risk(spark, sf):
    return D.turn_risk(V.screened_chat(spark, sf))


@query
def turn_decisions(spark, sf):
    d = D.turn_decisions(V.screened_chat(spark, sf))
    return d.withColumn("tags", bar("tags")).withColumn("pii_types", bar("pii_types"))


# ---- corpus generation ------------------------------------------------------
@query
def generation_plan(spark, sf):
    return CO.generation_plan(V.table(spark, sf, "documents"), "doc_id")


def _parsed(spark, sf):
    return CO.parse_generations(V.raw_generations(spark, sf))


@query
def generations_parsed(spark, sf):
    flat = F.transform("conversation", lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    return _parsed(spark, sf).select("plan_id", "reason", F.col("generated_topic").alias("topic"),
                                     F.array_join(flat, "\n").alias("conversation"))


def _corpus(spark, sf):
    return CO.chatml_corpus(_parsed(spark, sf), ["plan_id"], "requested_topic")


@query
def chatml_corpus(spark, sf):
    return _corpus(spark, sf)


@query
def corpus_resume(spark, sf):
    plan = CO.generation_plan(V.table(spark, sf, "documents"), "doc_id")
    return CO.corpus_resume(plan, _corpus(spark, sf))


@query
def corpus_split(spark, sf):
    """The corpus is written once; the cut then reads two of its columns."""
    return CO.corpus_split(materialise(_corpus(spark, sf), "corpus").select("plan_id", "topic"), "plan_id")


@query
def corpus_sink(spark, sf):
    path = work_dir(spark, "corpus")
    sinks.write_corpus(CO.corpus_split(materialise(_corpus(spark, sf), "corpus"), "plan_id"), path)
    return sinks.read_json(spark, path, "text string, topic string, split string")


# ---- streaming --------------------------------------------------------------
def _event_stream(spark, sf):
    """The events file as a stream, turned into chat messages."""
    schema = V.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return spark.sql(V.CHAT_EVENTS, events=events).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query
def stream_guardrail(spark, sf):
    out = work_dir(spark, "stream-guardrail")
    _drained(jobs.stream_guardrail(_event_stream(spark, sf), f"{out}/rows", f"{out}/checkpoint"))
    schema = sinks.audit_rows(D.with_call(V.screened_chat(spark, sf))).schema
    return _flat_audit(sinks.read_json(spark, f"{out}/rows/audit", schema))


@query
def stream_user_profile(spark, sf):
    """All profiles, closed and open ones, with all their fields."""
    out = work_dir(spark, "stream-profile")
    _drained(jobs.stream_user_profile(_event_stream(spark, sf), f"{out}/rows", f"{out}/checkpoint"))
    return _flat_profile(jobs.profiles_on_read(spark, f"{out}/rows").drop("is_open"))


@query
def stream_sessions(spark, sf):
    """All segments: closed ones from the sink and those that are still open."""
    out = work_dir(spark, "stream-sessions")
    _drained(jobs.stream_sessions(_event_stream(spark, sf).select("user_id", "ts"), f"{out}/rows", f"{out}/checkpoint"))
    rows = jobs.segments_on_read(spark, f"{out}/rows", f"{out}/checkpoint")
    return rows.select("user_id", us("started").alias("started_us"), us("ended").alias("ended_us"), "turns")


@query
def stream_history(spark, sf):
    out = work_dir(spark, "stream-history")
    _drained(jobs.stream_history(_event_stream(spark, sf), f"{out}/rows", f"{out}/checkpoint"))
    h = jobs.history_on_read(spark.read.parquet(f"{out}/rows"), 3, AS_OF)
    return h.select("session_id", "message_id", "role", "masked_text")


@query
def stream_summaries(spark, sf):
    out = work_dir(spark, "stream-summaries")
    _drained(jobs.stream_summaries(_event_stream(spark, sf), f"{out}/rows", f"{out}/checkpoint"))
    return _flat_summary(SM.latest_summary(spark.read.parquet(f"{out}/rows/rows")))
