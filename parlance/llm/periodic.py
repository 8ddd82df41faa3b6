"""Periodic runs of words by an online sparse diagonal dynamic program.

A run is a maximal stretch of words with smallest period q that is at least max(LEAST, TIMES * q) words long.
On the diagonal of lag q it is a stretch of words that each equal the word q before.  Scanning
the words, an earlier occurrence at lag q lengthens the match of that diagonal by one; a diagonal that is
not lengthened ends, and is a run if it was long enough.

Not every earlier occurrence has to be looked at.  A word is taken with the k words that end in it, for k = 8, 16,
32, ..., and of each such context only the *nearest* earlier occurrence counts.  For periods up to k that loses nothing:
if a context of k >= q words inside a run of smallest period q occurred again at a lag d < q, the
stretch over both would have the periods q and d and at least q + d words, hence also their greatest common divisor, and
q would not be the smallest.  So inside a run each context of k words, q <= k, has its nearest
occurrence exactly q words back, and on the other side a stretch of contexts whose nearest occurrences
all lie q back and that is long enough is a whole run of smallest period q: a longer stretch or a smaller
period would have shown as nearer occurrences.  A word therefore lengthens one diagonal for each context
length, log2(n) at most, and "a a a ..." costs no more than prose.  Contexts are told
apart exactly: those of 8 words by hashes whose links are compared word by word, longer ones by pairs of the names of their halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import mix64, slices, split_words

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Words of the shortest context.  A run matches LEAST - q or (TIMES - 1) * q words at its lag, never fewer than twice this.
CONTEXT = 8
#: Bytes of text that a task judges at a time: some 30 times as much is held meanwhile.
SLICE = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
FOUND = f"n_words bigint, runs {RUNS}, collapsed string"


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name of each key, index of the nearest earlier equal key or -1); a name is the index of the key's first occurrence."""
    order = np.argsort(keys, kind="stable")
    again = np.empty(len(keys), bool)
    again[:1] = False
    np.equal(keys[order][1:], keys[order][:-1], out=again[1:])
    before = np.full(len(keys), -1, np.int64)
    at = np.flatnonzero(again)
    before[order[at]] = order[at - 1]
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(keys))))
    names = np.empty(len(keys), np.int64)
    names[order] = order[first]
    return names, before


def _contexts(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, name, nearest earlier occurrence's first word or -1) of the contexts of CONTEXT words, exactly.

    ``words`` are numbers of words, ``rows`` the texts they belong to.
    """
    m = len(words) - CONTEXT + 1
    at = np.flatnonzero(rows[: max(m, 0)] == rows[CONTEXT - 1 :]) if m > 0 else np.empty(0, np.int64)
    seed = 0
    while True:
        acc = mix64(rows.astype(np.uint64) + np.uint64(seed << 40))[: max(m, 0)]
        for k in range(CONTEXT):
            acc = mix64(acc ^ words[k : k + max(m, 0)].astype(np.uint64)) + np.uint64(k)
        names, before = _names(acc[at])
        linked = np.flatnonzero(before >= 0)
        here, there = at[linked], at[before[linked]]
        same = rows[here] == rows[there]
        for k in range(CONTEXT):
            same &= words[here + k] == words[there + k]
        if same.all():
            return at, names, np.where(before >= 0, at[before], -1) if len(at) else before
        seed += 1  # two contexts shared a hash


def find_runs(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs in texts laid end to end, by first word, then period.

    ``words`` are equal where the words are equal; ``rows`` are the ascending numbers of their texts.
    """
    found = []
    at, names, before = _contexts(rows, words)
    k = CONTEXT
    while (before >= 0).any():
        lag = np.where(before >= 0, at - before, 0)
        # diagonals: neighbouring contexts that lengthen the same lag
        edge = np.flatnonzero((np.diff(lag) != 0) | (np.diff(at) != 1) | (np.diff(rows[at]) != 0)) + 1
        lo = np.concatenate([[0], edge])
        hi = np.concatenate([edge, [len(at)]])
        q, matched = lag[lo], hi - lo + k - 1
        wanted = (q > (0 if k == CONTEXT else k // 2)) & (q <= k) & (matched + q >= np.maximum(LEAST, TIMES * q))
        found.append(np.stack([at[lo] - q, matched + q, q])[:, wanted])
        # contexts of twice the words: pairs of names; where the first half never came before or again, neither does the whole
        where = np.full(len(words) + 1, -1, np.int64)
        where[at] = np.arange(len(at))
        second = where[np.minimum(at + k, len(words))]
        often = np.bincount(names, minlength=len(at))[names] > 1
        keep = np.flatnonzero((second >= 0) & (rows[np.minimum(at + k, len(words) - 1)] == rows[at]) & often)
        pairs = (names[keep].astype(np.uint64) << np.uint64(32)) | names[second[keep]].astype(np.uint64)
        at = at[keep]
        names, near = _names(pairs)
        before = np.where(near >= 0, at[near], -1) if len(at) else near
        k *= 2
    if not found:
        e = np.empty(0, np.int64)
        return e, e, e
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for whole in batches:
        for batch in slices(iter([whole]), limit=SLICE):
            rows, flat = split_words(batch.column("text"))
            rows = rows.astype(np.int64)
            coded = flat.dictionary_encode()
            words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.empty(0, np.int64)
            start, length, period = find_runs(rows, words)
            counts = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
            first = np.cumsum(counts) - counts
            owner = rows[start] if len(start) else np.empty(0, np.int64)
            # a word stays unless a run covers it behind its first period
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, start + period, 1)
            np.add.at(depth, start + length, -1)
            stays = np.cumsum(depth[:-1]) == 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows[stays], minlength=batch.num_rows))]).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(stays, pa.bool_())))
            of_row = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(of_row), pa.StructArray.from_arrays(
                [pa.array(start - first[owner]), pa.array(length), pa.array(period)], fields=list(item)))
            others = [n for n in batch.schema.names if n != "text"]
            yield pa.record_batch([*[batch.column(n) for n in others], pa.array(counts), runs, pc.binary_join(kept, " ")],
                                  names=[*others, "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text, ...).

    ``runs`` is array<struct<start, length, period>> in words from 0, by start, then period; ``collapsed`` the
    text's words, joined by one blank, without those that a run covers behind its first period.  Null and empty texts
    have no words, no runs and an empty ``collapsed``.  Rows that repeat are judged alike; ids
    of any type pass through, null ones too; other columns are ignored, so none can clash.  An empty table gives none.
    Nothing is shuffled: a text is judged whole, within its row, in time n log n and memory of some 200 bytes a word.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_search, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest exact length / period, of equals the first by start, then period; null without any."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
