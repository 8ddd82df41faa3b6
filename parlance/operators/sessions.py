"""Per-user and per-session state as grouped and windowed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions import safety as S
from parlance.functions import text as X
from parlance.operators import blocks as B
from parlance.rules import sessions as R

FACT = "array<struct<kind:string,value:string>>"
#: Joins the parts of one fact's value; control characters are not part of ids and language names.
PARTS = "\x01"


def _facts(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def _one(kind: str, when: Column) -> Column:
    return F.when(when, F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("value")))).otherwise(
        F.array().cast(FACT))


def moment(turns: DataFrame, ts: str, tie: str) -> Column:
    """One orderable value of (ts, tie): a number of fixed width where the tie is a whole number, so that its minimum is found by hashing."""
    if turns.schema[tie].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct(ts, tie)
    return (F.unix_micros(ts).cast("decimal(18,0)") * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + F.col(tie).cast("decimal(20,0)")).cast("decimal(38,0)")


def seen_in_order(kind: str) -> Column:
    """'|'-joined values of one kind by first appearance; bounded by the label set."""
    items = F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("first"), F.col("value"))))
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["value"]), "|")


def count_kind(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))


def profile_facts(calls: DataFrame, order: list[str] = ["ts", "message_id"], keys: list[str] = ["user_id"]) -> DataFrame:
    """(keys, kind, value, n, first, since, last): what a profile is folded from, counted with map-side combine.

    ``calls`` are screened turns with what each screening was given (``decisions.with_call``).  Facts of several
    sets of turns are brought together by ``merge_facts``.
    """
    blocked, injected = F.col("is_blocked"), F.col("block_layer") == "injection"
    facts = F.concat(
        _facts("origin", F.array(F.concat_ws(PARTS, F.col("session_id").cast("string"), F.coalesce("call_lang", F.lit(""))))),
        _one("message", F.lit(True)),
        _one("flagged", blocked | (F.size("pii") > 0)),
        _one("injection", injected),
        _one("nsfw", F.col("block_layer") == "nsfw"),
        F.when(F.col("call_intent") != "", _facts("intent", F.array("call_intent"))).otherwise(F.array().cast(FACT)),
        _facts("tag", F.col("call_tags")),
        _facts("pii", F.array_distinct(F.transform("pii", lambda p: p["pii_type"]))),
        _facts("hash", F.array_distinct(F.transform("pii", lambda p: F.concat(
            p["pii_type"], F.lit(":"), S.fingerprint(p["value"]))))),
    )
    rows = calls.select(*keys, F.col(order[0]).alias("at"), moment(calls, *order).alias("moment"), F.explode(facts).alias("f"))
    return rows.groupBy(*keys, F.col("f.kind").alias("kind"), F.col("f.value").alias("value")).agg(
        F.count("*").alias("n"), F.min("moment").alias("first"), F.min("at").alias("since"), F.max("at").alias("last"))


def merge_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys, "kind", "value").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.min("since").alias("since"), F.max("last").alias("last"))


def fold_profile(facts: DataFrame, keys: list[str] = ["user_id"]) -> DataFrame:
    """One profile for each of ``keys`` from its facts, one row a (kind, value)."""
    origin = F.when(F.col("kind") == "origin", F.col("first"))
    out = facts.groupBy(*keys).agg(
        F.split(F.min_by("value", origin), PARTS).alias("origin"),
        F.min("since").alias("created_at"),
        F.max("last").alias("updated_at"),
        count_kind("message").alias("message_count"),
        count_kind("flagged").alias("flagged_count"),
        count_kind("injection").alias("injection_attempts"),
        count_kind("nsfw").alias("nsfw_attempts"),
        seen_in_order("intent").alias("intents_seen"),
        seen_in_order("tag").alias("tags_seen"),
        seen_in_order("pii").alias("pii_types_seen"),
        F.sum(F.when(F.col("kind") == "hash", 1).otherwise(0)).alias("pii_values"),
    )
    return out.select(
        *keys, F.col("origin")[0].alias("session_id"), F.col("origin")[1].alias("lang"), "created_at", "updated_at", "message_count",
        "flagged_count", "injection_attempts", "nsfw_attempts", "intents_seen", "tags_seen", "pii_types_seen", "pii_values")


def user_profile(turns: DataFrame, order: list[str] = ["ts", "message_id"], keys: list[str] = ["user_id"]) -> DataFrame:
    """One row per user from screened turns with what each screening was given (``decisions.with_call``).

    Each turn becomes a few (kind, value) facts; these are counted per
    (user, kind, value) with map-side combine and only then folded per user, so
    a user with most of the traffic is spread and no raw turn is gathered.
    Distinct personal-data hashes are counted here; ``user_fingerprints``
    lists them, one row each.  Intents and tags are those that a reply's screening was given, the
    language is the one given to the user's first call.  ``keys`` may add the
    user's segment (``with_segments``): a profile lives for a fixed time after each write.
    """
    return fold_profile(profile_facts(turns, order, keys), keys)


def session_history(turns: DataFrame, n: int = R.HISTORY_TURNS, keys: list[str] = ["session_id"]) -> DataFrame:
    """Newest ``n`` turns per session, or per segment of a session.

    ``row_number() <= n`` is applied before the shuffle as well as after it
    (window group limit), so a task sends at most ``n`` rows of a session.
    """
    w = W.partitionBy(*keys).orderBy(F.col("turn").desc())
    return turns.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def context_window(turns: DataFrame, content: str = "masked_text", n: int = R.CONTEXT_TURNS,
                   keys: list[str] = ["session_id"]) -> DataFrame:
    """For every assistant turn, the up to ``n`` turns before it and the hint of the message's intent and tags.

    ``keys`` may add the session's segment: turns before a silence that ended the session's state are not seen."""
    w = B.block_window(keys, "turn", n)
    item = F.struct(F.col("turn"), F.col("role"), F.col(content).alias("content"))
    rows = B.with_blocks(turns.select(*keys, "turn", "role", content, "call_intent", "call_tags"), "turn", n)
    out = B.own_rows(rows.withColumn("context", F.collect_list(item).over(w)), "turn").where(F.col("role") == "assistant")
    pre, mid, post = R.INTENT_HINT
    hint = F.concat(F.lit(pre), F.col("call_intent"), F.lit(mid), F.array_join("call_tags", ", "), F.lit(post))
    return out.select(*keys, "turn", "context", F.when(F.col("call_intent") != "", hint).otherwise("").alias("hint"))


def span_of(ts: str, gap_seconds: int = R.SESSION_TTL_SECONDS) -> Column:
    """Number of the span that ``ts`` lies in: an hour, or the gap if that is shorter.  Events of one span are in one segment."""
    return F.floor(F.unix_micros(ts) / (min(3600, gap_seconds) * 1_000_000))


def mark_spans(spans: DataFrame, key: str, gap_seconds: int = R.SESSION_TTL_SECONDS) -> DataFrame:
    """Add ``segment`` to a key's spans (key, _hour, _lo, _hi): a silence of ``gap_seconds`` between two of them starts a new one."""
    if gap_seconds < 1:
        raise ValueError("gap_seconds must be positive")
    w = W.partitionBy(key).orderBy("_hour")
    gap = F.unix_micros("_lo") - F.unix_micros(F.lag("_hi").over(w))
    marked = spans.withColumn("_new", F.when(gap.isNull() | (gap >= gap_seconds * 1_000_000), 1).otherwise(0))
    return marked.withColumn("segment", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def _marked(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, _hour, _lo, _hi, _n, segment): a key's spans with activity; the window sees these, not events."""
    return mark_spans(df.groupBy(key, span_of(ts, max(1, gap_seconds)).alias("_hour")).agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count("*").alias("_n")), key, gap_seconds)


def session_segments(df: DataFrame, key: str, ts: str, gap_seconds: int = R.SESSION_TTL_SECONDS,
                     as_of: str | None = None) -> DataFrame:
    """Runs of activity ended by ``gap_seconds`` of silence.

    State lives for a fixed time after each write, so a segment is a run of
    events closer than that.
    """
    out = _marked(df, key, ts, gap_seconds).groupBy(key, "segment").agg(
        F.min("_lo").alias("started"), F.max("_hi").alias("ended"), F.sum("_n").alias("turns"))
    if as_of is not None:
        now = F.lit(as_of).cast("timestamp")
        alive = (F.col("started") <= now) & (F.unix_micros(now) < F.unix_micros("ended") + gap_seconds * 1_000_000)
        out = out.withColumn("live", alive)
    return out


def with_segments(turns: DataFrame, key: str, ts: str = "ts", gap_seconds: int = R.SESSION_TTL_SECONDS, name: str = "segment") -> DataFrame:
    """Add the number of the segment of ``key`` that each turn lies in.

    Turns meet their segment by (key, span), a join of rows with one small row for each span with activity: no
    session is sorted, and a session with most of the turns is dealt by hours.
    """
    spans = _marked(turns, key, ts, gap_seconds).select(key, "_hour", F.col("segment").alias(name))
    return turns.withColumn("_hour", span_of(ts, gap_seconds)).join(spans, [key, "_hour"]).drop("_hour")


def live_turns(turns: DataFrame, key: str, as_of: str, ts: str = "ts", gap_seconds: int = R.SESSION_TTL_SECONDS) -> DataFrame:
    """The turns that the state of ``key`` still holds at the instant ``as_of``: those of its last segment, if that has not run out.

    Later turns are not there yet."""
    now = F.lit(as_of).cast("timestamp")
    seen = turns.where(F.col(ts) <= now)
    spans, all_ = _marked(seen, key, ts, gap_seconds), W.partitionBy(key)
    live = spans.withColumns({"_last": F.max("segment").over(all_), "_end": F.max("_hi").over(all_)}).where(
        (F.col("segment") == F.col("_last")) & (F.unix_micros(now) < F.unix_micros("_end") + gap_seconds * 1_000_000))
    return seen.withColumn("_hour", span_of(ts, gap_seconds)).join(live.select(key, "_hour"), [key, "_hour"], "left_semi").drop("_hour")


def session_erase(history: DataFrame, erasures: DataFrame) -> DataFrame:
    """History without the listed sessions; ``sources.erase.erase_sessions`` does so to stored tables."""
    return history.join(erasures.select("session_id").distinct(), "session_id", "left_anti")


VIEW_FACTS = ["user_id", "lang", "message_count", "intents_seen", "tags_seen", "pii_types_seen", "flagged_count"]


def history_preview(turns: DataFrame, n: int = R.PREVIEW_TURNS) -> DataFrame:
    """(user_id, session_id, history_preview, preview_turns) from the newest ``n`` turns of each session."""
    last = session_history(turns.select("session_id", "user_id", "turn", "role", "masked_text"), n)
    preview = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "masked_text"))),
        lambda t: F.concat(t["role"], F.lit(": "), t["masked_text"]))
    return last.groupBy("user_id", "session_id").agg(
        F.array_join(preview, "\n").alias("history_preview"), F.count("*").alias("preview_turns"))


def session_view(turns: DataFrame, profile: DataFrame, n: int = R.PREVIEW_TURNS) -> DataFrame:
    """Profile facts with the newest ``n`` turns of each of the user's sessions."""
    return history_preview(turns, n).join(profile.select(*VIEW_FACTS), "user_id")


def session_view_live(calls: DataFrame, as_of: str, n: int = R.PREVIEW_TURNS) -> DataFrame:
    """The view at the instant ``as_of``, for every session of a user whose profile has not run out.

    Profile and histories run out on their own, so a session of a live user may have no turns left to show.
    ``calls`` are screened turns with what each screening was given (``decisions.with_call``)."""
    profile = user_profile(live_turns(calls, "user_id", as_of)).select(*VIEW_FACTS)
    sessions = calls.where(F.col("ts") <= F.lit(as_of).cast("timestamp")).select("user_id", "session_id").distinct()
    shown = history_preview(live_turns(calls, "session_id", as_of), n)
    return sessions.join(profile, "user_id").join(shown, ["user_id", "session_id"], "left").withColumns(
        {"history_preview": F.coalesce("history_preview", F.lit("")), "preview_turns": F.coalesce("preview_turns", F.lit(0)).cast("long")})


def repetition_score(turns: DataFrame, text: str = "text", history_text: str | None = None,
                     n: int = R.HISTORY_TURNS, keys: list[str] = ["session_id"]) -> DataFrame:
    """Share of each assistant turn's distinct words already used by assistant
    turns among the ``n`` turns before it, in the session or in its segment."""
    past_text = F.col(history_text or text)
    reply = F.col("role") == "assistant"
    rows = turns.select(
        *keys, "turn", "role",
        F.when(reply, F.array_distinct(X.whitespace_words(F.lower(text)))).alias("_new"),
        F.when(reply, F.array_distinct(X.whitespace_words(F.lower(past_text)))).alias("_past"),
        F.when(reply, F.length(past_text)).alias("_len"))
    w = B.block_window(keys, "turn", n)
    rows = B.with_blocks(rows, "turn", n).select(
        "*", F.flatten(F.collect_list("_past").over(w)).alias("_seen"),
        F.count("_len").over(w).alias("_replies"), F.sum("_len").over(w).alias("_chars"))
    out = B.own_rows(rows, "turn").where(F.col("role") == "assistant")
    # Earlier replies are joined with blanks: two of them are never empty.
    has_past = (F.col("_replies") >= 2) | (F.col("_chars") > 0)
    overlap = F.size(F.array_intersect("_new", "_seen")) / F.size("_new")
    score = F.when(~F.coalesce(has_past, F.lit(False)), 0.0).when(F.size("_new") == 0, 1.0).otherwise(overlap)
    return out.select(*keys, "turn", score.alias("repetition"))


def repetition_flags(scores: DataFrame, threshold: float = R.REPETITION_THRESHOLD) -> DataFrame:
    """Replies above the threshold and their rate, per session and overall.

    The grand total is a second grouping set of the same aggregate."""
    out = scores.rollup("session_id").agg(
        F.count("*").alias("replies"),
        F.sum((F.col("repetition") > threshold).cast("bigint")).alias("flagged"),
        F.grouping("session_id").alias("_total"))
    return out.select(
        F.when(F.col("_total") == 1, "overall").otherwise("session").alias("scope"), "session_id", "replies", "flagged",
        F.round(F.col("flagged") / F.col("replies"), 6).alias("rate"))
