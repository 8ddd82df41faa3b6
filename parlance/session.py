"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
#: Setting: partitions for expression-heavy scans of files that cannot be split.
SPREAD = "spark.parlance.spreadPartitions"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the given one."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("parlance")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config(SPREAD, str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared checkpoint folder, deleted when the session's JVM ends.

    ``spark.checkpoint.dir`` names that folder; where it is unset, the warehouse folder is used.
    """
    base = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    path = f"{base.rstrip('/')}/parlance/{purpose}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, purpose: str) -> str:
    """The new folder below the shared one that ``df`` is written to."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives the planner
    the table's true size for its broadcast decision.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, purpose))
