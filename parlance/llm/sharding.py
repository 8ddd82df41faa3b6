"""Sharding by key, and a two-pass external shuffle within the shards.

Law ``key``: a row's shard is the one with the highest hash of (shard, doc_id), so doc_id and
the number of shards decide, and one more shard takes rows only into itself.

Pass one scatters the rows of a shard by a seeded hash into buckets of about
``bucket_bytes`` and writes each bucket as one array.  Pass two reads the
buckets, shuffles each with Fisher and Yates' method, and numbers the slots of
a shard through, bucket after bucket.  Both passes run on SQL functions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.common import fresh
from parlance.session import materialise

SHARDS = 24
#: Bytes of texts that are shuffled as one array.  A task holds all arrays of its partition, so each bucket is a partition.
BUCKET_BYTES = 4 << 20
SEED = 20_24


def with_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` among ``shards`` and ``grown_shard`` among one more."""
    draws = F.array(*[F.xxhash64("doc_id", F.lit(j)) for j in range(shards)])
    extra = F.xxhash64("doc_id", F.lit(shards))
    name, most = fresh(docs, "_shard_draws"), fresh(docs, "_shard_most")
    return (
        docs.withColumn(name, draws)
        .withColumn(most, F.array_max(name))
        .withColumn("shard", (F.array_position(name, F.col(most)) - 1).cast("int"))
        .withColumn("grown_shard", F.when(extra > F.col(most), shards).otherwise(F.col("shard")).cast("int"))
        .drop(name, most)
    )


def with_digests(docs: DataFrame) -> DataFrame:
    """``size`` (UTF-8 bytes of the text plus 8) and ``text_crc32`` (unsigned; of no bytes for a null text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8"))})


def shard_rows(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with ``law``, ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard``.

    ``docs`` needs doc_id, and ``size`` and ``text_crc32`` of ``with_digests``; other columns travel along,
    and own columns of the names added are replaced.  Rows with a null doc_id share one
    shard; the law leaves no choice.  Repeated rows keep a slot each.  Empty tables give empty results.
    Buckets depend on doc_id and text, so only wholly equal rows have to meet in one.
    """
    docs = docs.drop("law", "shard", "slot", "grown_shard")
    names = docs.columns
    total = docs.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    placed = with_shards(docs, shards)
    order = F.xxhash64("doc_id", "text_crc32", F.lit(seed))
    scattered = placed.select(
        "shard", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(seed + 1)), F.lit(buckets)).alias("bucket"),
        F.struct(order.alias("order"), "grown_shard", F.struct(*[F.col(f"`{n}`") for n in names]).alias("own")).alias("row"))
    parts = shards * buckets
    gathered = scattered.repartition(parts, "shard", "bucket").groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    written = materialise(gathered, "shuffle-buckets")
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = materialise(written.select("shard", "bucket", F.size("rows").alias("n")).withColumn(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "bucket", "start"), "shuffle-starts")
    # shuffle() draws from the seed and the partition's number: fixed partitions in a fixed order make it repeatable.
    fixed = written.join(starts, ["shard", "bucket"]).repartition(parts, "shard", "bucket").sortWithinPartitions("shard", "bucket")
    mixed = fixed.select("shard", "start", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "row"))
    return mixed.select("row.own.*", F.lit("key").alias("law"), "shard",
                        (F.col("start") + F.col("at")).cast("long").alias("slot"), F.col("row.grown_shard").alias("grown_shard"))
