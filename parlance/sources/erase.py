"""Erasure of sessions from stored, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import materialise


def write_by_day(df: DataFrame, path: str, key: str = "session_id", day: str = "event_date") -> None:
    """Append as Parquet, one folder a day, sorted by ``key``: the statistics of a row group then tell which keys it can hold."""
    df.hint("rebalance", day).sortWithinPartitions(day, key).write.mode("append").partitionBy(day).parquet(path)


def held_days(stored: DataFrame, erasures: DataFrame, key: str = "session_id", day: str = "event_date") -> list[str]:
    """The days whose folder holds a listed key; reads two columns.  One short string a day."""
    held = stored.select(key, day).join(erasures.select(key).distinct(), key, "left_semi").select(F.col(day).cast("string").alias("d")).distinct()
    return sorted(r.d for r in held.collect())


def erase_sessions(spark: SparkSession, path: str, schema, erasures: DataFrame, fmt: str = "parquet", key: str = "session_id",
                   day: str = "event_date", options: dict[str, str] | None = None) -> list[str]:
    """Remove all rows of the listed keys from the table at ``path``; returns the days that were rewritten.

    Only folders of days that hold one are read whole and replaced; the others keep their files, and a second run finds
    no such day.  What stays of a day is written to the shared folder before its own folder is replaced, so a
    run that is lost midway can be repeated.  A day of which nothing stays loses its folder.  Rows without a key or day stay.
    """
    options = options or {}
    stored = spark.read.schema(schema).options(**options).format(fmt).load(path)
    days = held_days(stored, erasures, key, day)
    if not days:
        return []
    rest = stored.where(F.col(day).cast("string").isin(days)).join(erasures.select(key).distinct(), key, "left_anti").select(*stored.columns)
    kept = materialise(rest, "erase-rest")
    kept.hint("rebalance", day).sortWithinPartitions(day, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(
        **options).partitionBy(day).format(fmt).save(path)
    left = {r.d for r in kept.select(F.col(day).cast("string").alias("d")).distinct().collect()}
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d in days:
        if d not in left:
            fs.delete(at(f"{path.rstrip('/')}/{day}={d}"), True)
    return days


def erase_everywhere(spark: SparkSession, tables: dict[str, tuple[str, object, str, dict]], erasures: DataFrame) -> dict[str, list[str]]:
    """``erase_sessions`` for each table: name -> (path, schema, format, reader and writer options); returns the rewritten days by name."""
    return {name: erase_sessions(spark, path, schema, erasures, fmt, options=options) for name, (path, schema, fmt, options) in tables.items()}
