"""Helpers that several training-data operators share: words, hashes, bounded Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.session import materialise, written

#: White space that separates words, as a character class of a Java pattern.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes that a task works on at a time.
SLICE_BYTES = 4 << 20


#: Where the package lies; added to the path of Python workers, who may have been started elsewhere.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [env.get("PYTHONPATH")])])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The runs of non-space characters of ``text``; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each word, words) of whole texts; nulls have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    full = pc.not_equal(pc.binary_length(flat), 0)
    return rows[full.to_numpy(zero_copy_only=False)], flat.filter(full)


#: What separates words of letters and digits.
NO_WORD = r"[^\p{L}\p{N}]+"


def letter_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each word, lower-cased words of letters and digits) of whole texts; nulls have none."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), NO_WORD)
    rows, flat = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)
    full = pc.not_equal(pc.binary_length(flat), 0)
    return rows[full.to_numpy(zero_copy_only=False)], flat.filter(full)


def hash_words(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once."""
    coded = flat.dictionary_encode()
    h = xxhash.xxh3_64_intdigest
    own = np.fromiter((h(w, seed) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word's index, hash) of the runs of ``n`` words within one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, np.uint64)
    acc = hashes[:m].copy()
    for k in range(1, n):
        acc = mix64(acc + np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k : k + m]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return rows[at], at, mix64(acc[at])


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``n`` lower-cased words.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    rows, flat = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = hash_words(flat)
    counts = np.bincount(rows, minlength=len(texts)) if len(rows) else np.zeros(len(texts), np.int64)
    row, _, h = grams(rows, hashes, n)
    ends = np.cumsum(np.bincount(row, minlength=len(texts))) if len(row) else np.zeros(len(texts), np.int64)
    starts_w = np.cumsum(counts) - counts
    begin = 0
    for i in range(len(texts)):
        end = int(ends[i])
        if 0 < counts[i] < n:
            acc = np.uint64(counts[i])
            for x in hashes[starts_w[i] : starts_w[i] + counts[i]]:
                acc = mix64(np.array([acc], np.uint64))[0] ^ x
            yield mix64(np.array([acc], np.uint64))
        else:
            yield np.unique(h[begin:end])
        begin = end


#: Rows of small intermediate tables that a task is given.
ROWS_A_TASK = 100_000


def sized_session(spark: SparkSession, rows: int) -> SparkSession:
    """A session like ``spark`` whose shuffles have no more partitions than ``rows`` rows fill.

    Steps that are repeated over small tables cost mostly tasks without rows where the planner does not bring
    partitions together.  Only the number of partitions differs, and it is never raised.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(usual, rows // ROWS_A_TASK + 1)
    if wanted == usual:
        return spark
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return own


def fold_min(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (a, b long): (node, component), component the smallest node.

    Large-star and small-star steps by turns until every node hangs on its component's
    smallest one (which itself has no row).  Every step is a shuffle of the edges, written
    to the shared folder, so no group is gathered anywhere.
    """
    cur = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
        cur = materialise(small.where("u <> v").distinct(), purpose)
        # done if no node has two parents and no parent has one: counted for each node in one aggregate
        ends = cur.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
        seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("down"))
        if seen.where("ups > 1 OR ups = 1 AND down = 0").isEmpty():
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))


def with_component(df: DataFrame, components: DataFrame | None, column: str, name: str) -> DataFrame:
    """Add the component of ``column``, itself where it has none."""
    if components is None:
        return df.withColumn(name, F.col(column))
    own = components.select(F.col("node").alias(column), F.col("component").alias(name))
    return df.join(own, column, "left").withColumn(name, F.coalesce(name, column))


#: A bucket with more members than this is refined before any of them are compared.
CROWD = 8


def distinct_buckets(buckets: DataFrame) -> DataFrame:
    """(bucket, size, copies) of one bucket for each set of two members or more; ``copies`` is how many buckets have that set.

    Sets are told apart by their sizes and 128 bits of hashes.
    """
    sets = buckets.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("s1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("s2")).where("size > 1")
    return sets.groupBy("size", "s1", "s2").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("copies")).select("bucket", "size", "copies")


def bucket_components(buckets: DataFrame, refine: Callable[[DataFrame], DataFrame], fits: str,
                      confirm: Callable[[DataFrame], DataFrame], measures: DataFrame | None = None, once: bool = True) -> DataFrame | None:
    """Components (node, component) of all confirmed pairs of ``buckets`` (bucket long, rep long, ...); None without any.

    ``refine`` takes the rows of crowded buckets and returns rows like them that still hold every link of theirs: members
    that can have no link are gone, or buckets are split; columns that it adds are null in the other buckets.  ``fits`` is a condition on the other columns of two members, as x.name and
    y.name, that all links meet, ``measures`` may bring such columns by rep; ``confirm`` keeps the pairs (a, b) that are links.

    Of buckets with the same members one is looked at if ``once``.
    No bucket emits all its pairs: in each round its first members (1, 16, 256, ...) meet
    the others, then leave it, and a bucket whose members lie in one component is finished.
    So every pair of a bucket that fits is confirmed or refuted, or lies in one component already.
    First comes the one that meets most others over all buckets: the text that copies were made from is
    closer to each of them than they are to one another.  No bucket is sorted whole: its first members
    are found by a limit before the shuffle as well as behind it, and joined to the rest.
    """
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    crowds = materialise(sizes.where(F.col("size") > CROWD).select("bucket"), "pairs-crowds")
    refined = refine(buckets.join(crowds, "bucket", "left_semi"))
    spark, schema = buckets.sparkSession, refined.schema
    path = written(refined.unionByName(buckets.join(crowds, "bucket", "left_anti"), allowMissingColumns=True), "pairs-refined")
    small = sized_session(spark, spark.read.schema(schema).parquet(path).count())
    buckets = small.read.schema(schema).parquet(path)
    sizes = distinct_buckets(buckets) if once else buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.lit(1).alias("copies")).where("size > 1")
    sized = buckets.join(sizes, "bucket")
    turns = sized.groupBy("rep").agg((-F.sum(F.col("size") * F.col("copies"))).alias("turn"))
    if measures is not None:
        turns = turns.join(measures, "rep")
    columns = [*buckets.columns, *(measures.columns[1:] if measures is not None else [])]
    buckets = sized.join(turns, "rep").select(*columns, F.struct("turn", F.xxhash64("rep").alias("h"), "rep").alias("turn"))
    components = None
    # with no link known every bucket is open
    open_ = materialise(with_component(buckets, components, "rep", "component"), "pairs-open")
    pivots = 1
    while not open_.isEmpty():
        first = W.partitionBy("bucket").orderBy("turn")
        heads = open_.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= pivots).drop("rank")
        met = heads.alias("x").join(open_.alias("y"), F.expr(f"x.bucket = y.bucket AND x.turn < y.turn AND x.component <> y.component AND ({fits})"))
        near = met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
        found = materialise(confirm(near), "pairs-links")
        if not found.isEmpty():
            # the components so far stand for their links
            components = fold_min(found if components is None else found.union(components), "pairs-components")
        buckets = open_.join(heads.select("bucket", "rep"), ["bucket", "rep"], "left_anti").select(*columns, "turn")
        state = materialise(with_component(buckets, components, "rep", "component"), "pairs-state")
        mixed = state.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        open_ = materialise(state.join(mixed, "bucket", "left_semi"), "pairs-open")
        pivots *= 16
    return components


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
