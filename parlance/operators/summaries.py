"""Conversation statistics, risk, actions and summary records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.operators.sessions import FACT, _facts, _one, session_history
from parlance.rules import sessions as R


def conversation_stats(turns: DataFrame, content: str = "text") -> DataFrame:
    """Turn counts by role and the mean length of user messages."""
    user = F.col("role") == "user"
    return turns.groupBy("session_id").agg(
        F.count("*").alias("total_turns"),
        F.sum(user.cast("bigint")).alias("user_turns"),
        F.sum((F.col("role") == "assistant").cast("bigint")).alias("assistant_turns"),
        F.coalesce(F.avg(F.when(user, F.length(content))), F.lit(0.0)).alias("avg_user_msg_len"))


def turn_facts(turns: DataFrame, content: str = "masked_text", place: Column | str = "turn") -> DataFrame:
    """(session_id, kind, value, n, first, last, ...): what a summary is folded from, counted with map-side combine.

    ``place`` orders the turns of a session.  Text is reduced to its length first.  Facts of several sets of turns are
    brought together by ``merge_facts``.
    """
    user = F.col("role") == "user"
    facts = F.concat(
        _one("turn", F.lit(True)),
        _facts("user", F.array("user_id")),
        _facts("lang", F.array("lang")),
        F.when(F.col("intent") != "", _facts("intent", F.array("intent"))).otherwise(F.array().cast(FACT)),
        _facts("tag", F.array_distinct("tags")),
        _facts("pii", F.array_distinct(F.transform("pii", lambda p: p["pii_type"]))),
    )
    rows = turns.select(
        "session_id", (F.col(place) if isinstance(place, str) else place).alias("place"), "ts", F.explode(facts).alias("f"), "is_blocked",
        F.when(user, F.length(content)).alias("user_len"),
        (F.col("role") == "assistant").cast("bigint").alias("reply"))
    return rows.groupBy("session_id", F.col("f.kind").alias("kind"), F.col("f.value").alias("value")).agg(
        F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.max("ts").alias("last_ts"),
        F.count("user_len").alias("user_turns"), F.sum("user_len").alias("user_chars"),
        F.sum("reply").alias("replies"), F.max("is_blocked").alias("was_blocked"))


def merge_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("session_id", "kind", "value").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("last_ts").alias("last_ts"),
        F.sum("user_turns").alias("user_turns"), F.sum("user_chars").alias("user_chars"), F.sum("replies").alias("replies"),
        F.max("was_blocked").alias("was_blocked"))


def fold_facts(facts: DataFrame) -> DataFrame:
    """Everything a summary needs, one row per session, from its facts."""
    turn = F.col("kind") == "turn"

    def names(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))

    return facts.groupBy("session_id").agg(
        F.min_by("value", F.when(F.col("kind") == "user", F.col("first"))).alias("user_id"),
        F.max_by("value", F.when(F.col("kind") == "lang", F.col("last"))).alias("lang"),
        F.max(F.when(turn, F.col("last_ts"))).alias("created_at"),
        F.sum(F.when(turn, F.col("n"))).alias("total_turns"),
        F.sum(F.when(turn, F.col("user_turns"))).alias("user_turns"),
        F.sum(F.when(turn, F.col("replies"))).alias("assistant_turns"),
        F.coalesce(F.sum(F.when(turn, F.col("user_chars"))) / F.sum(F.when(turn, F.col("user_turns"))), F.lit(0.0))
        .alias("avg_user_msg_len"),
        F.max(F.when(turn, F.col("was_blocked"))).alias("was_blocked"),
        F.coalesce(
            F.max_by(F.when(F.col("kind") == "intent", F.col("value")),
                     F.when(F.col("kind") == "intent", F.struct(F.col("n"), (-F.col("first")).alias("early")))),
            F.lit(R.DEFAULT_INTENT)).alias("primary_intent"),
        names("intent").alias("all_intents"),
        names("tag").alias("all_tags"),
        names("pii").alias("pii_types_detected"))


def session_facts(turns: DataFrame, content: str = "masked_text") -> DataFrame:
    """Everything a summary needs, one row per session, from screened turns.

    Turns are reduced to counts per (session, kind, value) with map-side
    combine, then folded per session.
    """
    return fold_facts(turn_facts(turns, content))


def primary_intent(turns: DataFrame) -> DataFrame:
    """Most frequent intent per session, ties to the one seen first."""
    counts = turns.where(F.col("intent") != "").groupBy("session_id", "intent").agg(
        F.count("*").alias("n"), F.min("turn").alias("first"))
    return counts.groupBy("session_id").agg(
        F.max_by("intent", F.struct(F.col("n"), -F.col("first"))).alias("primary_intent"), F.max("n").alias("mentions"))


def risk_level(intents: Column, tags: Column, pii_types: Column) -> Column:
    """Session risk from its distinct intents, tags and personal-data types."""
    return (
        F.when(F.array_contains(intents, "harmful") | F.array_contains(tags, "security_risk"), "critical")
        .when(F.array_contains(intents, "sensitive") & F.array_contains(tags, "requires_human"), "high")
        .when((F.size(pii_types) > 0) | (F.size(F.array_distinct(intents)) > 2), "medium")
        .otherwise("low"))


def recommended_actions(intents: Column, pii_types: Column) -> Column:
    harmful = F.array_contains(intents, "harmful")
    steps = [F.when(harmful, F.lit(a)) for a in R.ACTIONS_HARMFUL] + [
        F.when(F.array_contains(intents, "sensitive"), F.lit(R.ACTION_SENSITIVE)),
        F.when(F.size(pii_types) > 0, F.lit(R.ACTION_PII)),
    ]
    listed = F.filter(F.array(*steps), lambda a: a.isNotNull())
    return F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(R.ACTION_DEFAULT)))


def summary_text(turns: Column, primary: Column, pii_types: Column, intents: Column, risk: Column) -> Column:
    emergency = F.array_contains(intents, "emergency") | (risk == "critical")
    return F.concat(
        F.lit(R.TEXT_TURNS[0]), turns.cast("string"), F.lit(R.TEXT_TURNS[1]),
        F.lit(R.TEXT_INTENT[0]), primary, F.lit(R.TEXT_INTENT[1]),
        F.when(F.size(pii_types) > 0, R.TEXT_PII).otherwise(""),
        F.when(emergency, R.TEXT_EMERGENCY).otherwise(""),
        F.lit(R.TEXT_RISK[0]), risk, F.lit(R.TEXT_RISK[1]))


def conversation_summary(turns: DataFrame, content: str = "masked_text") -> DataFrame:
    """Full summary record per session."""
    return summary_records(session_facts(turns, content))


def summary_records(f: DataFrame) -> DataFrame:
    """Summary records from ``session_facts``."""
    intents, tags, pii = F.col("all_intents"), F.col("all_tags"), F.col("pii_types_detected")
    f = f.withColumn("risk_level", risk_level(intents, tags, pii))
    risk = F.col("risk_level")
    return f.select(
        "session_id", "user_id", "lang", "created_at",
        summary_text(F.col("total_turns"), F.col("primary_intent"), pii, intents, risk).alias("summary_text"),
        F.lit(R.SUMMARY_LANGUAGE).alias("summary_lang"), "primary_intent", "all_intents", "all_tags",
        "total_turns", "user_turns", "assistant_turns", "avg_user_msg_len", "risk_level", "pii_types_detected",
        "was_blocked", recommended_actions(intents, pii).alias("recommended_actions"),
        risk.isin("high", "critical").alias("needs_human_takeover"),
        F.when(risk == "critical", R.ESCALATION_CRITICAL).otherwise("").alias("escalation_reason"))


def latest_summary(summaries: DataFrame, as_of: str | None = None, ttl_seconds: int = R.SUMMARY_TTL_SECONDS) -> DataFrame:
    """Latest stored summary per session.

    With ``as_of`` it is what a lookup finds at that instant: summaries written later are not there, and one
    runs out ``ttl_seconds`` after it was written.  Only the day folders in between are read, where there are such."""
    if as_of is not None:
        now = F.lit(as_of).cast("timestamp")
        age = F.unix_micros(now) - F.unix_micros("created_at")
        summaries = summaries.where((age >= 0) & (age < ttl_seconds * 1_000_000))
        if "event_date" in summaries.columns:
            summaries = summaries.where(F.col("event_date").between(F.to_date(now - F.expr(f"INTERVAL {ttl_seconds} SECOND")), F.to_date(now)))
    w = W.partitionBy("session_id").orderBy(F.col("created_at").desc(), F.col("total_turns").desc())
    return summaries.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def summary_view(summaries: DataFrame, as_of: str | None = None) -> DataFrame:
    """Nine-field projection of the latest summaries."""
    return latest_summary(summaries, as_of).select(
        "session_id", "summary_text", "primary_intent", "all_intents", "all_tags", "risk_level",
        "recommended_actions", "needs_human_takeover", "escalation_reason")


def transcript(turns: DataFrame, content: str = "text") -> DataFrame:
    """Readable text of each session's stored history (its newest turns)."""
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.substring(content, 1, R.TRANSCRIPT_CHARS))
    kept = session_history(turns.select("session_id", "turn", line.alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"])
    return kept.groupBy("session_id").agg(F.array_join(lines, "\n").alias("transcript"), F.count("*").alias("turns"))
