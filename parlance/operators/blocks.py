"""Skew-safe building blocks for per-session order.

A session may hold any share of the table, so nothing here sorts or gathers a
whole session in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.session import materialise

BLOCK = 4096


def number_turns(df: DataFrame, session: str, ts: str, tie: str) -> DataFrame:
    """Add ``turn``: 0-based position in the session by (ts, tie).

    Rows are ranked inside (session, minute); counts per minute, combined
    before their shuffle, give each minute's offset.
    """
    df = df.withColumn("_minute", F.expr(f"unix_seconds({ts}) div 60"))
    sizes = df.groupBy(session, "_minute").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(session).orderBy("_minute").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(session, "_minute", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(session, "_minute").orderBy(ts, tie)
    return (df.join(offsets, [session, "_minute"])
            .withColumn("turn", F.col("_offset") + F.row_number().over(inside) - 1)
            .drop("_minute", "_offset"))


def with_blocks(df: DataFrame, turn: str, before: int) -> DataFrame:
    """Cut sessions into blocks of turns; a turn also appears in every later block
    that begins within ``before`` turns after it, so a frame of that many rows is complete."""
    return df.withColumn("_block", F.explode(F.expr(f"sequence({turn} div {BLOCK}, ({turn} + {before}) div {BLOCK})")))


def block_window(keys: list[str], turn: str, before: int):
    return W.partitionBy(*keys, "_block").orderBy(turn).rowsBetween(-before, -1)


def own_rows(df: DataFrame, turn: str) -> DataFrame:
    """Drop the repeated rows and the block column."""
    return df.where(F.col("_block") == F.expr(f"{turn} div {BLOCK}")).drop("_block")


def hash_cut(df: DataFrame, key: Column, quota: Column, group: list[str]) -> DataFrame:
    """Add ``selected``: the ``quota`` rows of each group with the smallest md5.

    ``quota`` is an expression over ``n`` (group size).  Exact without sorting
    a group: counts per 16-bit hash slot find the slot the cut falls in, the hashes of
    that slot alone are ranked to find the last one taken, and every row is then
    compared with the last hash of its group: one small table, known in size when the
    rows are planned.  Rows of equal keys are taken or left together.
    """
    df = df.withColumn("_md5", F.md5(key.cast("string")))
    slim = df.select(*group, "_md5").withColumn("_slot", F.substring("_md5", 1, 4))
    sizes = slim.groupBy(*group, "_slot").agg(F.count("*").alias("_c"))
    by_group = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    upto = by_group.orderBy("_slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    slots = (sizes.withColumn("n", F.sum("_c").over(by_group))
             .withColumn("_upto", F.sum("_c").over(upto))
             .withColumn("_room", quota - (F.col("_upto") - F.col("_c"))))
    # the last slot that is taken at least in part; "g" sorts behind every hash of the slot
    last = slots.where("_room > 0").groupBy(*group).agg(F.max(F.struct("_slot", "_room", "_c")).alias("_s")).select(*group, "_s.*")
    last = materialise(last, "hash-slots")

    def same(left: str, right: str, names: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}")) for g in names], F.lit(True))

    cut = slim.alias("x").join(last.where("_room < _c").alias("y"), same("x", "y", [*group, "_slot"])).select(
        *[F.col(f"x.{g}").alias(g) for g in group], "x._slot", "_md5", "_room")
    inside = W.partitionBy(*group, "_slot").orderBy("_md5")
    cut = cut.withColumn("_rank", F.row_number().over(inside)).where("_rank = _room").select(*group, F.col("_md5").alias("_end"))
    ends = materialise(last.where("_room >= _c").select(*group, F.concat("_slot", F.lit("g")).alias("_end")).union(cut), "hash-ends")
    if not group:
        end = ends.first()
        return df.withColumn("selected", F.col("_md5") <= end[0] if end else F.lit(False)).drop("_md5")
    out = df.alias("x").join(ends.alias("y"), same("x", "y", group), "left")
    return out.select("x.*", F.coalesce(F.col("_md5") <= F.col("_end"), F.lit(False)).alias("selected")).drop("_md5")
