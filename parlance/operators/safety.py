"""Screening operators over any table that has a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import safety as S
from parlance.functions.rulesets import BASE, RuleSet
from parlance.rules import safety as R


def injection_matches(df: DataFrame, keys: list[str], text: str = "text", rules: RuleSet = BASE) -> DataFrame:
    """One row per (text, rule that fires): label and snippet.  Narrow, no shuffle.

    ``rules`` here and below are the built-in ones or a table's (``sources.rules.read_rules``)."""
    hits = df.select(*keys, F.explode_outer(S.injection_hits(text, rules)).alias("h")).where("h IS NOT NULL")
    return hits.select(*keys, F.col("h.label").alias("label"), F.col("h.snippet").alias("snippet"))


def injection_blocked(df: DataFrame, keys: list[str], text: str = "text",
                      threshold: int = R.INJECTION_BLOCK_THRESHOLD, rules: RuleSet = BASE) -> DataFrame:
    """Blocked flag, labels and reason per text."""
    out = df.select(*keys, S.injection_hits(text, rules).alias("hits"))
    blocked = F.size("hits") >= threshold
    return out.select(
        *keys,
        blocked.alias("is_injection"),
        F.size("hits").cast("bigint").alias("n_hits"),
        F.array_join(F.transform("hits", lambda h: h["label"]), "|").alias("labels"),
        F.when(blocked, S.injection_reason("hits")).otherwise("").alias("block_reason"),
    )


def nsfw_matches(df: DataFrame, keys: list[str], text: str = "text", rules: RuleSet = BASE) -> DataFrame:
    """One row per (text, category that fires) with the text's whole reason line.

    One generator gives both, and is an outer one, so that no pattern is tested again in a filter below it."""
    both = S.let(S.nsfw_categories(text, rules), lambda cats: F.transform(
        cats, lambda c: F.struct(c.alias("category"), F.concat(F.lit(R.NSFW_REASON), F.array_join(cats, ", ")).alias("block_reason"))))
    out = df.select(*keys, F.explode_outer(both).alias("h")).where("h IS NOT NULL")
    return out.select(*keys, "h.block_reason", "h.category")


def guardrail(df: DataFrame, text: str = "text", rules: RuleSet = BASE) -> DataFrame:
    """Layered verdict: injection, then unsafe content, then personal data.

    A later layer is evaluated only for rows the earlier ones let pass, and
    blocked rows carry no personal-data matches.  Adds ``injection_hits``,
    ``nsfw_categories``, ``pii``, ``masked_text``, ``is_blocked``,
    ``block_layer`` and ``block_reason``; narrow, no shuffle.
    """
    df = df.withColumn("injection_hits", S.injection_hits(text, rules))
    injected = F.size("injection_hits") >= R.INJECTION_BLOCK_THRESHOLD
    df = df.withColumn(
        "nsfw_categories",
        F.when(injected, F.array().cast("array<string>")).otherwise(S.nsfw_categories(text, rules)))
    unsafe = F.size("nsfw_categories") > 0
    df = df.withColumn("block_layer", F.when(injected, "injection").when(unsafe, "nsfw").otherwise(""))
    df = S.scan_pii(df, text, where="block_layer = ''", rules=rules)
    layer = F.col("block_layer")
    return (
        df.withColumn("masked_text", F.when(layer == "injection", R.BLOCKED_INJECTION_TEXT)
                      .when(layer == "nsfw", R.BLOCKED_NSFW_TEXT).otherwise(F.col("masked_text")))
        .withColumn("is_blocked", layer != "")
        .withColumn("block_reason", F.when(layer == "injection", S.injection_reason("injection_hits"))
                    .when(layer == "nsfw", S.nsfw_reason("nsfw_categories")).otherwise(""))
    )


def verdict_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Flat view of :func:`guardrail` output."""
    return df.select(
        *keys, "is_blocked", "block_layer", "block_reason", "masked_text",
        F.array_join(F.transform("injection_hits", lambda h: h["label"]), "|").alias("injection_labels"),
        F.array_join("nsfw_categories", "|").alias("nsfw_categories"),
        F.array_join(S.pii_types("pii"), "|").alias("pii_types"),
        F.size("pii").cast("bigint").alias("pii_count"),
    )


def pii_matches(df: DataFrame, keys: list[str], text: str = "text", rules: RuleSet = BASE) -> DataFrame:
    """One row per match: type, ordinal within type, value, hash, offsets."""
    scanned = S.scan_pii(df.select(*keys, text), text, rules=rules)
    out = scanned.select(*keys, F.explode_outer("pii").alias("p")).where(F.col("p").isNotNull())
    return out.select(*keys, "p.pii_type", "p.ordinal", F.col("p.value").alias("value"),
                      S.fingerprint(F.col("p.value")).alias("value_hash"), "p.start", "p.end")


def pii_masked(df: DataFrame, keys: list[str], text: str = "text", rules: RuleSet = BASE) -> DataFrame:
    return df.select(*keys, S.mask_pii(text, rules).alias("masked_text"))


def pii_type_summary(matches: DataFrame, by: list[str]) -> DataFrame:
    """Rows affected, matches and distinct values per type (and ``by``).

    Two aggregations, each combined before its shuffle: first per value, so a
    type that holds most matches is spread over its values, then per type.
    A text has exactly one match with ordinal 0 per type, which counts texts
    without a distinct.
    """
    per_value = matches.groupBy(*by, "pii_type", "value_hash").agg(
        F.count("*").alias("n"), F.sum(F.expr("CASE WHEN ordinal = 0 THEN 1 ELSE 0 END")).alias("first"))
    return per_value.groupBy(*by, "pii_type").agg(
        F.sum("first").alias("texts"), F.sum("n").alias("matches"), F.count("*").alias("distinct_values"))


def pii_linkage(matches: DataFrame, keys: list[str], min_texts: int = 2) -> DataFrame:
    """Values seen in at least ``min_texts`` texts.

    Deduplicates on (type, hash, text) first so that a value repeated across
    most of the table is counted from partial sums, not gathered.
    """
    once = matches.groupBy("pii_type", "value_hash", *keys).agg(F.count("*").alias("n"))
    return (once.groupBy("pii_type", "value_hash")
            .agg(F.count("*").alias("texts"), F.sum("n").alias("matches"))
            .where(F.col("texts") >= min_texts))


def user_fingerprints(matches: DataFrame, user: str, order: list[str], segment: list[str] = []) -> DataFrame:
    """Distinct hashes per user (and segment) and type, with the moment each was first seen."""
    return matches.groupBy(user, *segment, "pii_type", "value_hash").agg(
        F.min(F.struct(*order)).alias("first_seen"), F.count("*").alias("n"))


def leak_rates(verdicts: DataFrame, role: str = "role") -> DataFrame:
    """Turns, blocked turns and turns with personal data per role."""
    out = verdicts.groupBy(role).agg(
        F.count("*").alias("turns"),
        F.sum(F.col("is_blocked").cast("bigint")).alias("blocked"),
        F.sum((F.size("pii") > 0).cast("bigint")).alias("with_pii"))
    return (out.withColumn("block_rate", F.round(F.col("blocked") / F.col("turns"), 6))
            .withColumn("leak_rate", F.round(F.col("with_pii") / F.col("turns"), 6)))
