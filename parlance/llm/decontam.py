"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The words of the benchmark are counted in the whole corpus.  A run of ``SEED_WORDS``
words of an item is a seed if its words together are rare, so that chance
meetings are few; an item always has its rarest ``LEAST_SEEDS`` runs.  How often a whole
passage was copied does not count, so passages that many documents share keep their seeds.
Where a document holds a seed, the words around it are aligned with the item's: local
alignment with ``MATCH``, ``MISMATCH`` and ``GAP``, over the best score the item can have.
Edited and paraphrased copies keep a high share of it.

An item of fewer than ``LEAST_WORDS`` words cannot be told from chance by a share of its score: its
whole sequence is its seed, and a document holds it if the sequence is there word for word.
Each character of a script without spaces (``UNSPACED``) is a word here; two of them count as one towards ``LEAST_WORDS``.

The benchmark is worked on in parts of at most ``PART_WORDS`` words, each broadcast in turn, so its
size is bounded; the corpus is read, never moved.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import grams, hash_words, letter_words, slices

SEED_WORDS, LEAST_SEEDS = 3, 5
#: A run is rare if the product of its words' shares of the corpus is at most this.
RARE = 1e-8
#: Items of fewer words are found as a whole only.
LEAST_WORDS = 8
#: A character of a script that is written without spaces between words.
UNSPACED = "[" + "".join(rf"\p{{{x}}}" for x in (
    "Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar",
    "Tai_Le", "New_Tai_Lue", "Tai_Tham", "Javanese", "Balinese")) + "]"
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best possible score from which a document is contaminated.
THRESHOLD = 0.5
PART_WORDS = 1_000_000


def item_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``letter_words`` with each character of unspaced scripts as a word."""
    if pc.any(pc.match_substring_regex(texts, UNSPACED)).as_py():
        texts = pc.replace_substring_regex(texts, f"({UNSPACED})", r" \1 ")
    return letter_words(texts)


def is_short(flat: pa.Array) -> bool:
    """Whether an item of these words is found as a whole only."""
    single = pc.sum(pc.match_substring_regex(flat, UNSPACED)).as_py() or 0
    return len(flat) - single / 2 < LEAST_WORDS


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(best local score, index after the last aligned word) of Smith and Waterman's alignment."""
    row, best, end = np.zeros(len(words) + 1, np.int32), 0, 0
    slope = np.arange(len(words) + 1, dtype=np.int32) * -GAP
    for w in item:
        step = np.maximum(0, row + GAP)
        np.maximum(step[1:], row[:-1] + np.where(words == w, MATCH, MISMATCH), out=step[1:])
        # a gap in the item is a running maximum along the row
        row = np.maximum.accumulate(step + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def locate(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """(share of the best possible score, first word, word after the last)."""
    best, end = align(item, words)
    if not best:
        return 0.0, 0, 0
    _, back = align(item[::-1], words[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


@dataclass(frozen=True)
class Part:
    """Items of a part and their seeds, sorted by hash: the item and the offset of each; short items by their number of words."""

    ids: tuple[int, ...]
    items: tuple[np.ndarray, ...]
    seeds: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    #: number of words -> (hashes of whole items, sorted; their ids)
    short: dict[int, tuple[np.ndarray, tuple[int, ...]]]

    def hits(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item id, score, first word, end word) of every text and item that reach ``threshold``."""
        rows, flat = item_words(texts)
        hashes = hash_words(flat)
        begins = np.searchsorted(rows, np.arange(len(texts) + 1), "left")
        out = self._whole(rows, hashes, begins) if threshold <= 1 else []
        row, at, h = grams(rows, hashes, SEED_WORDS)
        low = np.searchsorted(self.seeds, h, "left")
        count = np.searchsorted(self.seeds, h, "right") - low
        found = np.flatnonzero(count)
        spots: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for i in found:
            for k in range(low[i], low[i] + count[i]):
                spots[int(row[i]), int(self.owner[k])].append((int(at[i]), int(self.offset[k])))
        for (r, owner), seeds in spots.items():
            item, best = self.items[owner], (0.0, 0, 0)
            size, slack = len(item), len(item) // 2
            windows: list[list[int]] = []
            for p, o in sorted(seeds):
                a, b = max(int(begins[r]), p - o - slack), min(int(begins[r + 1]), p - o + size + slack)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], b)
                else:
                    windows.append([a, b])
            for a, b in windows:
                score, x, y = locate(item, hashes[a:b])
                best = max(best, (score, a - int(begins[r]) + x, a - int(begins[r]) + y))
            if best[0] >= threshold:
                out.append((r, self.ids[owner], *best))
        return out

    def _whole(self, rows: np.ndarray, hashes: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """The hits of short items: the first place of each in each text."""
        out = []
        for n, (seeds, ids) in self.short.items():
            row, at, h = grams(rows, hashes, n)
            low = np.searchsorted(seeds, h, "left")
            count = np.searchsorted(seeds, h, "right") - low
            found = np.repeat(np.arange(len(h)), count)
            k = np.arange(len(found)) - np.repeat(np.cumsum(count) - count - low, count)
            _, first = np.unique(row[found] * len(seeds) + k, return_index=True)
            for r, p, i in zip(row[found[first]].tolist(), at[found[first]].tolist(), k[first].tolist()):
                a = p - int(begins[r])
                out.append((r, ids[i], 1.0, a, a + n))
        return out


def _word_counts(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    known, total = held.value, 0
    counts = np.zeros(len(known), np.int64)
    for batch in slices(batches):
        h = hash_words(item_words(batch.column("text"))[1])
        total += len(h)
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        if len(known):
            counts += np.bincount(at[known[at] == h], minlength=len(known))
    yield pa.record_batch([pa.array([-1, *range(len(known))], pa.int64()), pa.array([total, *counts.tolist()], pa.int64())], names=["word", "n"])


def parts(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> Iterator[Part]:
    """The benchmark in parts, with seeds by the word counts of all ``docs``."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("text").cast("string").alias("text"))
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # a word has three bytes at least, be it a character of an unspaced script, but for few short ones
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 3 / part_words))
    for p in range(n):
        own = sorted({(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p).toLocalIterator()})
        items, whole = [], defaultdict(list)
        for i, t in own:
            flat = item_words(pa.array([t]))[1]
            h = hash_words(flat)
            if not is_short(flat):
                items.append((i, h))
            elif len(h):
                whole[len(h)].append((grams(np.zeros(len(h), np.int64), h, len(h))[2][0], i))
        short = {m: (np.array([g for g, _ in sorted(v)], np.uint64), tuple(i for _, i in sorted(v))) for m, v in whole.items()}
        if not items:
            if short:
                none = np.empty(0, np.int64)
                yield Part((), (), np.empty(0, np.uint64), none, none, short)
            continue
        known = np.unique(np.concatenate([h for _, h in items]))
        held = sc.broadcast(known)
        counted = texts.mapInArrow(lambda it, held=held: _word_counts(it, held), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        n_of = {r.word: r.n for r in counted}
        share = np.log(np.array([max(1, n_of.get(i, 0)) for i in range(len(known))]) / max(1, n_of.get(-1, 0)))
        seeds, owner, offset = [], [], []
        for k, (_, h) in enumerate(items):
            _, at, g = grams(np.zeros(len(h), np.int64), h, SEED_WORDS)
            word = share[np.searchsorted(known, h)]
            rarity = sum(word[j : j + len(g)] for j in range(SEED_WORDS))
            take = rarity <= math.log(RARE)
            take[np.argsort(rarity, kind="stable")[:LEAST_SEEDS]] = True
            seeds.append(g[take])
            owner.append(np.full(int(take.sum()), k))
            offset.append(at[take])
        seeds, owner, offset = map(np.concatenate, (seeds, owner, offset))
        order = np.argsort(seeds, kind="stable")
        yield Part(tuple(i for i, _ in items), tuple(h for _, h in items), seeds[order], owner[order], offset[order], short)


def _find(batches: Iterator[pa.RecordBatch], held, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        got = held.value.hits(batch.column("text"), threshold)
        ids = batch.column("doc_id").to_pylist()
        cols = list(zip(*got)) if got else [[]] * 5
        yield pa.record_batch([
            pa.array([ids[r] for r in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
            pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["doc_id", "item_id", "score", "first_word", "end_word"])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): one row for each document and item that align to ``threshold`` or more.

    The span is that of the best alignment, in words of letters and digits (characters, of unspaced scripts); of an item
    of few words, the first place that holds it whole.  Items without letters and digits match nothing.  Rows with null texts or items match
    nothing; a null doc_id passes through; rows that repeat give a row each; items that repeat under one id count as one item each.
    """
    sc = docs.sparkSession.sparkContext
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    out = None
    for part in parts(docs, benchmark, part_words):
        held = sc.broadcast(part)
        found = slim.mapInArrow(lambda it, held=held: _find(it, held, threshold), schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _clean(batches: Iterator[pa.RecordBatch], held, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keep = np.ones(batch.num_rows, bool)
        keep[[h[0] for h in held.value.hits(batch.column("text"), threshold)]] = False
        yield batch.filter(pa.array(keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of ``docs`` that align with no item; all columns stay and no row moves."""
    sc, out = docs.sparkSession.sparkContext, docs
    for part in parts(docs, benchmark, part_words):
        held = sc.broadcast(part)
        out = out.mapInArrow(lambda it, held=held: _clean(it, held, threshold), out.schema)
    return out
