"""Partitioned sinks: audit log, vault, summaries, feedback, corpus.

All sinks append files below one folder; day folders play the part of one log
file per day and prune reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import safety as S
from parlance.rules import safety as R_SAFE
from parlance.rules import sessions as R


def audit_rows(screened: DataFrame) -> DataFrame:
    """One row per screened turn, and one of role ``intent`` for every message that was let pass.

    A turn's row has the intent, tags and language that its screening was given
    (``decisions.with_call``); the ``intent`` row has those that the classifier found, and no text.  Never holds raw text: block reasons quote the
    message, so the whole match is masked first and then cut; a cut value would not be known any more."""
    snippet = f"substring({S.mask_pii_sql('_h.matched')}, 1, {R_SAFE.INJECTION_SNIPPET_CHARS})"
    labels = F.expr(f"transform(injection_hits, _h -> concat(_h.label, ':\\'', {snippet}, '\\''))")
    safe_reason = (F.when(F.col("block_layer") == "injection", F.concat(F.lit(R_SAFE.INJECTION_REASON), F.array_join(labels, ", ")))
                   .when(F.col("block_layer") == "nsfw", F.col("block_reason")).otherwise(""))
    call = F.struct("role", F.col("call_lang").alias("lang"), F.col("call_intent").alias("intent"), F.col("call_tags").alias("tags"),
                    F.col("masked_text").alias("content_masked"))
    found = F.struct(F.lit("intent").alias("role"), "lang", "intent", "tags", F.lit("").alias("content_masked"))
    classified = (F.col("role") == "user") & ~F.col("is_blocked")
    rows = screened.withColumn("_row", F.explode(F.when(classified, F.array(call, found)).otherwise(F.array(call))))
    return rows.select(
        F.col("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_human"), "user_id", "session_id", "_row.*",
        (F.col("block_layer") == "injection").alias("injection_blocked"), labels.alias("injection_labels"),
        (F.col("block_layer") == "nsfw").alias("nsfw_blocked"), "nsfw_categories",
        S.pii_types("pii").alias("pii_detected"), F.size("pii").cast("bigint").alias("pii_count"),
        "is_blocked", safe_reason.alias("block_reason"), "block_layer",
        F.to_date("ts").alias("event_date"))


def vault_rows(screened: DataFrame) -> DataFrame:
    """One row per turn with personal data: its raw values.  Keep the folder restricted.

    Turns without any go behind an outer generator: a filter, or one inferred from a plain
    generator, would be pushed below the screening and run it twice."""
    raw = F.transform("pii", lambda p: F.struct(p["pii_type"].alias("type"), p["value"].alias("value")))
    some = F.when(F.size("pii") > 0, F.array(F.struct(F.size("pii").cast("bigint").alias("pii_count"), raw.alias("pii_raw"))))
    rows = screened.select("ts", "user_id", "session_id", F.explode_outer(some).alias("v")).where("v IS NOT NULL")
    return rows.select(
        F.col("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_human"), "user_id", "session_id",
        "v.pii_count", "v.pii_raw", F.to_date("ts").alias("event_date"))


def summary_rows(summaries: DataFrame, run_id: str) -> DataFrame:
    """Summaries as they are stored: with the day they were written and the run that wrote them."""
    return summaries.withColumns({"run_id": F.lit(run_id), "event_date": F.to_date("created_at")})


def feedback_rows(df: DataFrame) -> DataFrame:
    """Feedback with a rating inside the allowed range."""
    return df.where(F.col("rating").between(*R.RATING_RANGE))


# JSON keeps timestamps to the microsecond (the writer's default is milliseconds).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append_json(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "append") -> None:
    """Append JSON lines, one folder per partition value.

    Rows of a day are brought together into files of the advised size first; large days are split."""
    writer = (df.hint("rebalance", *partition) if partition else df).write.mode(mode).option("ignoreNullFields", "false").option("timestampFormat", TS_FORMAT)
    (writer.partitionBy(*partition) if partition else writer).json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", TS_FORMAT).json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """Text and topic lines below ``split=train`` and ``split=eval``."""
    df.select("text", "topic", "split").write.mode("append").partitionBy("split").json(path)
