"""State of streaming jobs as a bucketed table in a shared folder.

A job that has to carry rows from one micro-batch to the next keeps them here by key.  A batch reads and rewrites
only the buckets that its own keys fall into, so the bytes it moves follow the batch and not the store.  Every batch
writes a version of its own and reads only versions before it: a batch that is replayed finds what it found the first
time.  Versions that no bucket needs any more are deleted, and the version before the last is kept for a replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketStore:
    """Rows of ``schema`` (a DDL string) by ``key`` in ``buckets`` buckets below ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``: at most ``buckets`` numbers."""
        return sorted(r.bucket for r in rows.select(self.bucket()).distinct().collect())

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path
        return at, at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions whose manifest is whole."""
        at, fs = self._files()
        if not fs.exists(at(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(at(f"{self.path}/{n}/manifest/_SUCCESS")))

    def places(self, before: int | None = None) -> dict[int, tuple[int, int]]:
        """For each bucket the last version that wrote it and its number of rows there."""
        wanted = [v for v in self.versions() if before is None or v < before]
        if not wanted:
            return {}
        manifests = self.spark.read.schema("version long, bucket int, rows long").parquet(*[f"{self.path}/v={v}/manifest" for v in wanted])
        last = manifests.groupBy("bucket").agg(F.max(F.struct("version", "rows")).alias("x"))
        return {r.bucket: (r.x.version, r.x.rows) for r in last.collect()}

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of ``buckets`` (all, if None) as the versions below ``before`` (all, if None) left them."""
        folders = [f"{self.path}/v={v}/rows/bucket={b}" for b, (v, rows) in sorted(self.places(before).items())
                   if rows and (buckets is None or b in buckets)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, rows: DataFrame, buckets: list[int], version: int) -> None:
        """Replace the rows of ``buckets``; those of other buckets stay where they are."""
        folder = f"{self.path}/v={version}"
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows")
        found = {}
        if buckets:
            written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{folder}/rows")
            found = {r.bucket: r.n for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        listed = [(version, b, found.get(b, 0)) for b in buckets]
        self.spark.createDataFrame(listed, "version long, bucket int, rows long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
        self._clean(version)

    def _clean(self, version: int) -> None:
        needed = {v for v, _ in self.places().values()} | {v for v, _ in self.places(version).values()} | {version}
        at, fs = self._files()
        for v in self.versions():
            if v not in needed:
                fs.delete(at(f"{self.path}/v={v}"), True)
