"""Per-exchange decisions: a user turn, the reply after it, and their risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions import language as LG
from parlance.functions import safety as S
from parlance.functions import tags as TG
from parlance.operators import blocks as B
from parlance.operators.safety import guardrail
from parlance.rules import sessions as R


def screen_turns(turns: DataFrame) -> DataFrame:
    """Verdict, tags and language for every turn; narrow, no shuffle.

    ``tags`` are the model's tags merged with rule tags of the masked text.
    ``lang`` is the resolved language of the masked text.
    """
    t = guardrail(turns)
    detected = F.when(~F.col("is_blocked"), LG.detect_language("masked_text")).otherwise("unknown")
    return (
        t.withColumn("lang", F.when(F.col("is_blocked"), F.coalesce("lang_hint", F.lit("unknown")))
                     .otherwise(LG.resolve_language(detected, F.col("lang_hint"))))
        .withColumn("tags", F.when(F.col("is_blocked"), F.array().cast("array<string>"))
                    .otherwise(TG.merge_tags(TG.split_list_sql("model_tags"), "masked_text"))))


def with_call(screened: DataFrame) -> DataFrame:
    """Add what the screening of each turn was given: ``call_intent``, ``call_tags``, ``call_lang``.

    A message is screened before it is classified, so it is given its language hint alone.  The reply
    right after a message that was let pass is given that message's intent, tags and language,
    whatever its own text says.  Needs ``turn``; sessions are cut into blocks, never gathered.
    """
    before = F.struct("role", "is_blocked", "intent", "tags", "lang")
    window = W.partitionBy("session_id", "_block").orderBy("turn")
    rows = B.own_rows(B.with_blocks(screened, "turn", 1).withColumn("_before", F.lag(before).over(window)), "turn")
    reply = (F.col("role") == "assistant") & (F.col("_before.role") == "user") & ~F.col("_before.is_blocked")
    return rows.withColumns({
        "call_intent": F.when(reply, F.col("_before.intent")).otherwise(""),
        "call_tags": F.when(reply, F.col("_before.tags")).otherwise(F.array().cast("array<string>")),
        "call_lang": F.when(reply, F.col("_before.lang")).when(F.col("role") == "user", F.coalesce("lang_hint", F.lit("unknown"))).otherwise("unknown"),
    }).drop("_before")


def exchanges(screened: DataFrame) -> DataFrame:
    """Pair each user turn with an assistant turn right after it.

    Both sides carry the user turn's number, and one aggregate per
    (session, number) joins them: one pass over the screened turns, at most two
    rows per group, whatever the size of a session.
    """
    user = F.col("role") == "user"
    fields = ["is_blocked", "block_reason", "masked_text", "intent", "tags", "lang", "lang_hint", "confidence", "pii",
              "user_id"]
    rows = screened.where(F.col("role").isin("user", "assistant")).select(
        "session_id", F.when(user, F.col("turn")).otherwise(F.col("turn") - 1).alias("turn"), user.alias("is_user"),
        F.struct(*fields).alias("r"))
    side = lambda want: F.first(F.when(F.col("is_user") == want, F.col("r")), ignorenulls=True)
    return rows.groupBy("session_id", "turn").agg(side(True).alias("u"), side(False).alias("a")).where(
        F.col("u").isNotNull())


def exchange_risk(u: str = "u", a: str = "a") -> Column:
    """Exchange risk; ``medium`` cannot occur because personal data is already high."""
    reply_blocked = F.coalesce(F.col(f"{a}.is_blocked"), F.lit(False))
    return (
        F.when(F.col(f"{u}.is_blocked") | (F.col(f"{u}.intent") == "harmful") | reply_blocked, "critical")
        .when((F.size(F.col(f"{u}.pii")) > 0) | F.array_contains(F.col(f"{u}.tags"), "requires_human")
              | (F.col(f"{u}.intent") == "sensitive"), "high")
        .otherwise("low"))


def turn_risk(screened: DataFrame) -> DataFrame:
    return exchanges(screened).select("session_id", "turn", exchange_risk().alias("risk_level"))


def turn_decisions(screened: DataFrame) -> DataFrame:
    """Full response record of each exchange."""
    blocked = F.col("u.is_blocked")
    return exchanges(screened).select(
        "session_id", "turn", F.col("u.user_id").alias("user_id"),
        F.when(blocked, F.concat(F.lit(R.REFUSAL_PREFIX), F.col("u.block_reason")))
        .otherwise(F.col("a.masked_text")).alias("response"),
        F.when(blocked, "blocked").otherwise(F.col("u.intent")).alias("intent"),
        F.when(blocked, F.array(F.lit("blocked"))).otherwise(F.col("u.tags")).alias("tags"),
        F.col("u.lang").alias("lang"),
        F.when(blocked, 1.0).otherwise(F.col("u.confidence")).alias("confidence"),
        (F.size("u.pii") > 0).alias("pii_detected"),
        S.pii_types("u.pii").alias("pii_types"),
        blocked.alias("was_blocked"), exchange_risk().alias("risk_level"))
