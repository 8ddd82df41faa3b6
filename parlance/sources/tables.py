"""Input tables: chat turns, labelled messages, rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.rules import sessions as R

TURNS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("turn", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang_hint", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])


def read_turns(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Chat turns with the fixed schema (JSON lines, Parquet or CSV)."""
    return spark.read.format(fmt).schema(TURNS).load(path)


def stream_turns(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Streaming twin of :func:`read_turns`."""
    return spark.readStream.format(fmt).schema(TURNS).load(path)


def as_turns(df: DataFrame, **columns: Column) -> DataFrame:
    """Project any table to the turn schema; missing columns become NULL."""
    return df.select(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TURNS.fields])


def contract_reason(message: Column, user_id: Column) -> Column:
    """Why a message breaks the contract, NULL if it does not."""
    (m_lo, m_hi), (u_lo, u_hi) = R.MESSAGE_CHARS, R.USER_ID_CHARS
    return (
        F.when(message.isNull() | (F.length(message) < m_lo), "message_empty")
        .when(F.length(message) > m_hi, "message_too_long")
        .when(user_id.isNull() | (F.length(user_id) < u_lo), "user_id_empty")
        .when(F.length(user_id) > u_hi, "user_id_too_long"))


def with_contract(df: DataFrame, message: str = "text", user_id: str = "user_id") -> DataFrame:
    return df.withColumn("reject_reason", contract_reason(F.col(message), F.col(user_id)))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNotNull())


def clean_labelled(df: DataFrame) -> DataFrame:
    """Trim and lower column names; drop rows without message or intent."""
    return df.toDF(*[c.strip().lower() for c in df.columns]).na.drop(subset=["user_msg", "intent"])


def read_labelled(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Labelled messages from CSV with a header.

    ``line_breaks`` allows them inside quoted fields; a file is then read by one task, so
    convert large ones to Parquet once."""
    raw = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
    return clean_labelled(raw)


def read_tag_rules(spark: SparkSession, path: str, fmt: str = "csv") -> list[tuple[str, str]]:
    """(keyword, tag) rules, all of them, read when the plan is built: they become expressions."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).schema("keyword string, tag string")
    rows = reader.load(path).select("keyword", "tag").collect()
    return [(r.keyword, r.tag) for r in rows]
