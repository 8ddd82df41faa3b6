"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Circulant MinHash takes two permutations of D places: the first moves a shingle
to its place, the second, read at that place plus k, gives coordinate k of the signature,
so one table serves all coordinates.  ``BANDS`` bands of ``ROWS`` coordinates
name a document's buckets.  At a similarity of 0.75 a pair shares no bucket with a
probability of some 1e-7.

Documents with equal shingle sets form a class first, and only one of each
class goes on.  Members of crowded buckets are refined exactly: a shingle that no other member of any
crowded bucket has lies in no intersection, so a document with more than a quarter of such shingles has no link there, and two that have some
can share no more than the rest.  Documents that meet only over a very common passage go this way.  Those who stay carry the parities
of their other shingles in 512 classes: each class where two differ has a shingle that one of them lacks, so copies of one text
whose edits are too many for a link are never paired.
Then a bucket never emits all its pairs.  In each round its first
members (1, 16, 256, ...; those that meet most others first) are compared with the others, then leave it; a bucket whose
remaining members lie in one component is finished.  Rounds go on until no
bucket is left, so no pair of a bucket with different components stays unchecked.
Pairs are confirmed on the full shingle sets of their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.common import bucket_components, fresh, mix64, shingle_sets, slices
from parlance.session import materialise

WORDS = 5
#: A link: NUMER / 100 of the union at least is shared.
NUMER = 75
ROWS, BANDS = 7, 112
#: Places of the permutations.
PLACES = 1 << 20
SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"


@lru_cache(2)
def _table(coordinates: int, seed: int) -> np.ndarray:
    """Row i: the second permutation at places i, i + 1, ... (circular), as a view of one array."""
    second = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
    wound = np.concatenate([second, second[:coordinates]])
    return np.lib.stride_tricks.sliding_window_view(wound, coordinates)


def signature(shingles: np.ndarray, coordinates: int = ROWS * BANDS, seed: int = 1) -> np.ndarray:
    """The coordinates of a non-empty set of shingle hashes."""
    table = _table(coordinates, seed)
    # the first permutation: a keyed bijection of the hash, cut to the places
    places = (mix64(shingles + np.uint64(seed)) >> np.uint64(44)).astype(np.int64)
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(places), 2048):
        np.minimum(out, table[places[a : a + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    at = sig.reshape(BANDS, ROWS).astype(np.uint64)
    acc = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    for k in range(ROWS):
        acc = mix64(acc ^ at[:, k]) + np.uint64(k)
    return mix64(acc)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                        ("bands", pa.list_(pa.int64()))])
    for batch in slices(batches):
        sizes, s1, s2, bands = [], [], [], []
        for s in shingle_sets(batch.column("text"), WORDS):
            sizes.append(len(s))
            s1.append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)) if len(s) else 0)
            s2.append(int(mix64(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            bands.append(band_keys(signature(s)).view(np.int64) if len(s) else np.empty(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
        yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()),
                               pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands): s1 and s2 are a 128-bit digest of the set."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sign, SIGNED)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b, ta, tb) of similar texts."""
    for whole in batches:
        for batch in slices(iter([whole]), "tb"):
            ta = batch.column("ta").dictionary_encode()
            known = list(shingle_sets(ta.dictionary, WORDS))
            good = []
            for i, other in zip(ta.indices.to_pylist(), shingle_sets(batch.column("tb"), WORDS)):
                own = known[i]
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(both > 0 and 100 * both >= NUMER * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar; ``texts`` has doc_id and text of every member."""
    joined = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = list(shingle_sets(batch.column("text"), WORDS))
        ids = batch.column("rep").take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
        yield pa.record_batch([ids, pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "shingle"])


#: Words of 64 bits of a member's marks.
LANES = 8
_APART = " + ".join(f"bit_count(x.p{k} ^ y.p{k})" for k in range(LANES))
#: Two members fit if what either can share, c of its n shingles where that is known, is enough for a link, and
#: if it still is without the classes of shingles that only one of them can have an odd number of.
FITS = (f"{100 + NUMER} * least(coalesce(x.c, x.n), coalesce(y.c, y.n)) >= {NUMER} * (x.n + y.n) AND "
        f"coalesce({100 + NUMER} * (x.c + y.c - ({_APART})) >= {2 * NUMER} * (x.n + y.n), true)")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit b of word k of a text: whether it has an odd number of shingles of class 64 * k + b, the hash's lowest bits."""
    for batch in slices(batches):
        marks = np.zeros((batch.num_rows, LANES), np.uint64)
        for own, s in zip(marks, shingle_sets(batch.column("text"), WORDS)):
            np.bitwise_xor.at(own, ((s >> np.uint64(6)) % np.uint64(LANES)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
        yield pa.record_batch([batch.column("rep"), *[pa.array(marks[:, k].view(np.int64)) for k in range(LANES)]],
                              names=["rep", *[f"p{k}" for k in range(LANES)]])


def _shared(crowded: DataFrame, texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of crowded buckets without those who share too few shingles with the others for a link.

    c counts the shingles that another member has, p0, p1, ... hold the parities of their numbers by class of hash.  Each class
    in which two members differ has a shingle that only one of them has.
    """
    reps = crowded.select("rep").distinct()
    members = texts.withColumnRenamed("doc_id", "rep").join(reps, "rep", "left_semi").select("rep", "text")
    held = members.mapInArrow(_shingles, "rep long, shingle long")
    marks = members.mapInArrow(_marks, "rep long, " + ", ".join(f"p{k} long" for k in range(LANES)))
    alone = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("rep")).where("k = 1")
    lane, bit = F.expr(f"shiftright(shingle, 6) & {LANES - 1}"), F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    own = alone.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"), *[F.bit_xor(F.when(lane == k, bit)).alias(f"q{k}") for k in range(LANES)])
    left = materialise(
        sizes.join(marks, "rep").join(own, "rep", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0))).where(f"100 * c >= {NUMER} * n")
        .select("rep", "c", *[F.expr(f"p{k} ^ coalesce(q{k}, 0L)").alias(f"p{k}") for k in range(LANES)]), "minhash-shared")
    return crowded.join(left, "rep").select("bucket", *left.columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text, ...).

    Documents without words have an empty set and are linked with nothing, so they
    are kept, and so is a row with a null doc_id (its component_id is null).  Rows that repeat a doc_id are
    judged by it: their sets join one class.  Empty tables give empty results; other columns are ignored.
    """
    signs = materialise(signed(docs), "minhash-signs")
    full = signs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "minhash-classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    # one deal by bucket serves the count and the join
    dealt = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("bucket")).repartition("bucket")
    many = dealt.groupBy("bucket").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("bucket")
    open_ = materialise(dealt.join(many, "bucket").distinct(), "minhash-buckets")
    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"))
    wanted = open_.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                        .join(wanted, "doc_id").dropDuplicates(["doc_id"]), "minhash-texts")
    components = bucket_components(open_, lambda rows: _shared(rows, texts, sizes), FITS, lambda pairs: _confirmed(pairs, texts), sizes, once=False)
    own = full.select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", "rep").distinct()
    return _labelled(signs, own, components)


def _labelled(signs: DataFrame, own: DataFrame, components: DataFrame | None) -> DataFrame:
    """The digest of every row: ``own`` has the class of a document, ``components`` that of a class."""
    if components is not None:
        own = own.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    ids = own.groupBy("doc_id").agg(F.min("rep").alias("component_id"))
    return (
        signs.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "n_shingles", "component_id", "kept")
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of ``near_duplicates``: that of the smallest doc_id, one of the rows that repeat it.

    Rows with a null doc_id stay.  Of different rows under one doc_id the first in the order of all columns but maps stays.
    """
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    first = W.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    turn = fresh(docs, "_turn")
    one = named.withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(turn)
    return one.unionByName(docs.where("doc_id IS NULL"))
