"""Line deduplication by a segment-partition edit join.

Two lines are alike if they differ by at most one edit for every ``EDIT_CHARS`` characters of the shorter, and
``EDITS`` at most; below ``EDIT_CHARS`` characters only equal lines are.  A line with a bound of e edits is cut
into e + 1 segments.  If two lines differ by at most e edits, one segment of the shorter is a substring of the longer, at a place and for a
length that can be told beforehand.  So each line probes a few substrings for each length it may
be matched with (its own segments among them), and the lines that meet under
one (length, segment, substring) are candidates.  They are verified on their whole texts by
a bit-parallel edit distance that works on a band of 2 * e + 1 diagonals.

Equal lines of any length are one line from the start.  Where many lines meet under one substring, the rest of them is looked at
before any are compared.  What lies before the segment and behind it is cut into pieces that are at least two more than
the edits, so that linked lines share two of them, each at a place told by a line's end, by the segment or up to one character
beside; such a group is dealt again by each choice of pieces that may be shared.  And each line carries the parities of its
characters, and twice of its pairs of neighbours, in 64 classes each: an edit changes two and four of them at most, so that lines whose
parities differ more are never paired.
Groups never emit all their pairs (see
``bucket_components``); lines that are linked, directly or over others, form a class, and the first
line of a class stays.  Line ids are 64-bit hashes: among ten thousand million lines
some three pairs can be expected to share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import bucket_components, fresh, slices
from parlance.session import materialise

EDITS = 2
#: Characters of the shorter line for each edit.
EDIT_CHARS = 10
#: Code points without outer white space: only empty lines are left alone.
LEAST_CHARS = 1
BLANKS = " \t\n\x0b\x0c\r"


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, size) of the even partition; the last segments are one longer where needed."""
    base, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        size = base + (i > edits - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(matched length, segment, start, size) of the substrings that a line of ``length`` probes.

    A start is far enough from the segment's own place only if the edits before
    it, or those after it, could still be within the bound.
    """
    out = []
    for other in range(max(edits + 1, length - edits), length + 1):
        shift = length - other
        for i, (at, size) in enumerate(segments(other, edits)):
            low = max(0, at - i, at + shift - (edits - i))
            high = min(length - size, at + i, at + shift + (edits - i))
            out += [(other, i, p, size) for p in range(low, high + 1)]
    return out


def bound(length: int) -> int:
    """The edits by which a line of ``length`` may differ from one as long or longer."""
    return min(EDITS, length // EDIT_CHARS)


def bounded_probes(length: int) -> list[tuple[int, int, int, int]]:
    """The probes of ``length`` with the bound of each matched length; none where only equal lines are alike."""
    return [p for e in range(1, EDITS + 1) for p in probes(length, e) if bound(p[0]) == e]


def within_edits(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most ``edits``: common ends are cut, the rest goes through the band."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid :] == b[len(b) - mid :] else (lo, mid - 1)
    return band_distance(a[: len(a) - lo], b[: len(b) - lo], edits) <= edits


def band_distance(a: str, b: str, edits: int) -> int:
    """The edit distance of ``a`` and ``b`` if it is at most ``edits``, else edits + 1.

    One word of 2 * edits + 1 bits holds the vertical differences of a column's band;
    bit k is row column - edits + k, so the word slides down one row with each column.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return edits + 1
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    # before the first column rows 1 .. edits + 1 hold rising differences
    plus, minus = full ^ ((1 << edits) - 1), 0
    rows = len(a)
    score = min(edits, rows)
    for j, c in enumerate(b):
        first = j - edits
        same = places.get(c, 0)
        same = (same >> first if first >= 0 else same << -first) & full
        diagonal = ((((same & plus) + plus) ^ plus) | same | minus) & full
        up = (minus | ~(diagonal | plus)) & full
        down = diagonal & plus
        last = j + edits + 1  # the band's lowest row
        if last <= rows:
            score += not diagonal & top
        else:
            bit = 1 << (rows - 1 - first)
            score += bool(up & bit) - bool(down & bit)
        plus = (down | ~((diagonal >> 1) | up)) & full
        minus = (diagonal >> 1) & up
    # columns may end before the band reaches the last row
    short = rows - (len(b) + edits)
    return score if short <= 0 and score <= edits else edits + 1


def _lines(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, line number, trimmed line) of the lines that are not empty."""
    lists = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
    rows, flat = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.ascii_trim(pc.list_flatten(lists), BLANKS)
    starts = np.searchsorted(rows, np.arange(batch.num_rows), "left")
    number = np.arange(len(rows)) - starts[rows]
    keep = pc.greater_equal(pc.utf8_length(flat), LEAST_CHARS)
    at = keep.to_numpy(zero_copy_only=False)
    return rows[at], number[at], flat.filter(keep)


def _ids(names: list[str]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for x in names), np.uint64, len(names)).view(np.int64)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, number, flat = _lines(batch)
        coded = flat.dictionary_encode()
        ids = _ids(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
        yield pa.record_batch([batch.column("doc_id").take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(ids)], names=["doc_id", "line", "id"])


def cuts(length: int, pieces: int) -> list[int]:
    """The ends of an even partition of ``length`` into ``pieces``, from 0."""
    return [length * k // pieces for k in range(pieces + 1)]


def shared_pieces(x: str, a: int, b: int, length: int, before: int, edits: int) -> list[str]:
    """What a line ``x`` that has a segment of a line of ``length`` at [a, b) may share with it besides, one string a choice.

    ``before`` is where the segment is in that line.  Of what lies before and behind it, in two halves each, all pieces but ``edits`` are
    untouched, and each half is fixed to a line's end or to the segment.  If there is nothing on one side, the other is cut into
    ``edits`` + 2 pieces, two of which are untouched; one within may have been moved by an edit beside it.
    """
    behind, n = length - before - (b - a), len(x)
    if before and behind:
        x1, y1 = before // 2, behind // 2
        x2, y2 = before - x1, behind - y1
        p = (x[:x1], x[max(0, a - x2) : a], x[b : b + y1], x[max(b, n - y2) :])
        return [f"{i}\n" + "\n".join(p[k] for k in kept) for i, kept in enumerate(combinations(range(4), 4 - edits))]
    lo, hi = (0, a) if before else (b, n)
    size = before or behind
    c = cuts(size, edits + 2)

    def left(i: int, j: int, shift: int = 0) -> str:  # pieces i to j, by their distance from the left
        return x[max(lo, lo + c[i] + shift) : min(hi, lo + c[j] + shift)]

    def right(i: int) -> str:  # pieces from i on, by their distance from the right
        return x[max(lo, hi - (size - c[i])) : hi]

    if edits == 1:
        return [f"0\n{left(0, 2)}", f"1\n{right(1)}", f"2\n{left(0, 1)}\n{right(2)}"]
    out = [f"0\n{left(0, 2)}", f"1\n{right(2)}", f"2\n{left(0, 1)}\n{right(3)}"]
    for shift in (-1, 0, 1):
        out += [f"3\n{left(0, 1)}\n{left(2, 3, shift)}", f"4\n{left(1, 2, shift)}\n{right(3)}", f"5\n{left(1, 3, shift)}"]
    return out


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def parities(x: str) -> tuple[int, int, int]:
    """Bit k of the first: whether the number of characters of class k is odd; of the others: that of pairs of neighbours, in classes of two kinds."""
    ones = twos = more = 0
    before = 0
    for code in map(ord, x):
        ones ^= 1 << (code * 0x9E3779B97F4A7C15 >> 58 & 63)
        if before:
            mixed = (before * 0xC2B2AE3D27D4EB4F + code * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            twos ^= 1 << (mixed >> 58)
            more ^= 1 << ((mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 >> 40 & 63)
        before = code
    return _signed(ones), _signed(twos), _signed(more)


class _Plans(dict):
    """By length: (start, end, seed, matched length, place of the segment in it, edits) of each probe of a line."""

    def __missing__(self, n: int) -> list[tuple]:
        plan = []
        for length, i, a, size in bounded_probes(n):
            plan.append((a, a + size, length * 8 + i, length, segments(length, bound(length))[i][0], bound(length)))
        self[n] = plan
        return plan


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h, plans = xxhash.xxh3_64_intdigest, _Plans()
    for batch in slices(batches):
        names = _lines(batch)[2].unique().to_pylist()
        keys, counts = [], []
        for x in names:
            plan = plans[len(x)]
            keys += [h(x[p[0] : p[1]], p[2]) for p in plan]
            counts.append(len(plan))
        yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(_ids(names), counts))], names=["bucket", "rep"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each probe of a line the keys of what it may share besides."""
    h, plans = xxhash.xxh3_64_intdigest, _Plans()
    for batch in slices(batches, "line"):
        owners, keys, finer, ends = [], [], [], [0]
        for rep, x in zip(batch.column("id").to_pylist(), batch.column("line").to_pylist()):
            for a, b, seed, length, before, edits in plans[len(x)]:
                key = h(x[a:b], seed)
                owners.append(rep)
                keys.append(key)
                finer += [h(piece, key) for piece in shared_pieces(x, a, b, length, before, edits)]
                ends.append(len(finer))
        yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(owners, pa.int64()),
                               pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(finer, np.uint64).view(np.int64)))],
                              names=["bucket", "rep", "finer"])


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "line"):
        odd = [parities(x) for x in batch.column("line").to_pylist()]
        yield pa.record_batch([batch.column("id"), pc.utf8_length(batch.column("line")), *[pa.array([o[k] for o in odd], pa.int64()) for k in (0, 1, 2)]],
                              names=["rep", "n", "ones", "twos", "more"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        names = _lines(batch)[2].unique()
        yield pa.record_batch([pa.array(_ids(names.to_pylist())), names], names=["id", "line"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [within_edits(x, y, bound(min(len(x), len(y)))) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


_BOUND = f"least({EDITS}, least(x.n, y.n) div {EDIT_CHARS})"
#: Lines as long as a link allows, and with as many equal parities.
FITS = f"abs(x.n - y.n) <= {_BOUND} AND bit_count(x.ones ^ y.ones) <= 2 * {_BOUND} AND bit_count(x.twos ^ y.twos) <= 4 * {_BOUND} AND bit_count(x.more ^ y.more) <= 4 * {_BOUND}"


def line_classes(slim: DataFrame) -> DataFrame | None:
    """(node, component) of the line ids that are linked with another, but for the smallest of each class; ``slim`` has the text."""
    slim = slim.select("text")
    dealt = slim.mapInArrow(_keys, "bucket long, rep long").repartition("bucket")
    many = dealt.groupBy("bucket").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("bucket")
    buckets = materialise(dealt.join(many, "bucket").distinct(), "lines-buckets")
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    texts = materialise(slim.mapInArrow(_texts, "id long, line string").join(wanted, "id").dropDuplicates(["id"]), "lines-texts")

    def refine(crowded: DataFrame) -> DataFrame:
        lines = texts.join(crowded.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
        probed = lines.mapInArrow(_finer, "bucket long, rep long, finer array<long>")
        return probed.join(crowded.select("bucket").distinct(), "bucket", "left_semi").select(F.explode("finer").alias("bucket"), "rep").distinct()

    def confirm(pairs: DataFrame) -> DataFrame:
        return pairs.join(texts.select(F.col("id").alias("b"), F.col("line").alias("tb")), "b").join(
            texts.select(F.col("id").alias("a"), F.col("line").alias("ta")), "a").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long")

    measures = materialise(texts.mapInArrow(_measures, "rep long, n int, ones long, twos long, more long"), "lines-measures")
    return bucket_components(buckets, refine, FITS, confirm, measures)


def _report(slim: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_near, first_docs, drop_lines) of the documents of ``slim`` (doc_id, text), which have lines; doc_id is of any ordered type."""
    kind = slim.schema["doc_id"].dataType.simpleString()
    seen = materialise(slim.mapInArrow(_occurrences, f"doc_id {kind}, line int, id long"), "lines-seen")
    linked = line_classes(slim)
    if linked is None:
        own = seen.withColumns({"class": F.col("id"), "near": F.lit(False)})
    else:
        tops = linked.select(F.col("component").alias("id"), "component").distinct()
        own = seen.join(linked.withColumnRenamed("node", "id").union(tops), "id", "left").select(
            "doc_id", "line", F.coalesce("component", "id").alias("class"), F.col("component").isNotNull().alias("near"))
    # one row for each class and document first, so that a common line meets as many rows as it has documents
    held = materialise(own.groupBy("class", "doc_id").agg(
        F.sort_array(F.collect_set("line")).alias("lines"), F.sum(F.col("near").cast("int")).alias("near")), "lines-held")
    first = held.groupBy("class").agg(F.min("doc_id").alias("first_doc"))
    cut = held.join(first, "class").select(
        "doc_id", "near", "first_doc", F.size("lines").alias("n"),
        F.when(F.col("doc_id") == F.col("first_doc"), F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines")).alias("drop"))
    return cut.groupBy("doc_id").agg(
        F.sum("n").alias("n_lines"), F.sum("near").alias("n_near"), F.array_sort(F.collect_set("first_doc")).alias("first_docs"),
        F.array_sort(F.flatten(F.collect_list("drop"))).alias("drop_lines"))


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_near, first_docs, drop_lines) of every document with a doc_id.

    n_lines counts all lines that are not empty; n_near those of them whose class has a different line.
    drop_lines are the numbers (from 0, in the text's split at line ends) of the lines that are not the first of their
    class, first_docs the smallest doc_ids of the classes of its lines.  "First" is the smallest doc_id, then line number.
    Null and empty texts have no lines; rows with a null doc_id are left out; rows that repeat a doc_id
    count as one document (``dedup_lines`` tells them apart).  Empty tables give empty results; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return slim.select("doc_id").distinct().join(_report(slim), "doc_id", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
        F.coalesce("drop_lines", F.array().cast("array<int>")).alias("drop_lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that repeat one that comes before; all columns stay, whatever their names.

    "Before" is the smaller doc_id, of rows with one doc_id the smaller hash of the text, then line number: rows that repeat a doc_id
    with another text are documents of their own, so that a line of either that is the first of its class stays.  Rows equal in
    doc_id and text are one document and come out alike.  Rows with a null doc_id and null texts stay as they are.
    """
    key, drops = fresh(docs, "_key"), fresh(docs, "_drop")
    text = F.col("text").cast("string")
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text"))))
    slim = keyed.select(F.col(key).alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL")
    cut = _report(slim).select(F.col("doc_id").alias(key), F.col("drop_lines").alias(drops))
    lines = F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains(F.coalesce(drops, F.array().cast("array<int>")), k))
    return keyed.join(cut, key, "left").withColumn("text", F.array_join(lines, "\n")).select(*docs.columns)
