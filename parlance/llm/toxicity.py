"""Toxicity classifier with counterfactual regularisation.

Features are the lower-cased words of a text and their prefixes; a few thousand are
selected by how they differ between labelled toxic and other documents.  A logistic regression
is fitted on them with two penalties: the usual one on weights, and one on the change of the
score between two versions of each labelled sentence.  In the second version every identity term is swapped for another
of its language; a sentence that names no group gets a neutral mention, of one group in the first version and of another in the
second.  Both versions are described whole, so repeated terms and words that share a prefix with one count as they do in a score.  So a
neutral mention of a group cannot carry a score, whatever the labels say.

The fit sees at most ``SAMPLE_ROWS`` labelled rows, the first in the order of a hash; the
statistics of that sample are counted by Spark, and only the indices of selected
features come to the driver.  Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import letter_words, slices
from parlance.session import materialise

#: Bounds of the fit: labelled rows, and features kept.
SAMPLE_ROWS, FEATURES = 20_000, 3_000
#: Characters of the shortest and longest prefix that is a feature.
PREFIX = (3, 8)
#: Terms that name groups of people, by language; any two of one language can be swapped for one another.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "en": ("women", "men", "gay", "straight", "lesbian", "transgender", "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu",
           "buddhist", "atheist", "black", "white", "asian", "african", "european", "latino", "arab", "immigrants", "refugees", "disabled", "blind",
           "deaf", "elderly", "young", "poor", "rich"),
    "fr": ("femmes", "hommes", "gays", "lesbiennes", "musulmans", "chrétiens", "juifs", "bouddhistes", "athées", "noirs", "blancs", "asiatiques",
           "africains", "européens", "arabes", "immigrés", "réfugiés", "handicapés", "aveugles", "sourds", "jeunes", "pauvres", "riches"),
    "de": ("frauen", "männer", "schwule", "lesben", "muslime", "christen", "juden", "buddhisten", "atheisten", "schwarze", "weiße", "asiaten",
           "afrikaner", "europäer", "araber", "einwanderer", "flüchtlinge", "behinderte", "blinde", "gehörlose", "rentner", "arme", "reiche"),
    "es": ("mujeres", "hombres", "gais", "lesbianas", "musulmanes", "cristianos", "judíos", "budistas", "ateos", "negros", "blancos", "asiáticos",
           "africanos", "europeos", "árabes", "inmigrantes", "refugiados", "discapacitados", "ciegos", "sordos", "ancianos", "pobres", "ricos"),
}
L2, PAIR_PENALTY, STEPS = 1e-4, 1.0, 400
#: The features of the terms themselves; they are always selected.
ALL_TERMS = tuple(dict.fromkeys(f"{t}$" for terms in IDENTITY_TERMS.values() for t in terms))
#: Empty clean texts that the fit sees beside the labelled ones: without evidence a text is not toxic.
CLEAN = 8
#: The bias of a model without examples of both labels: a score near 0.
UNTAUGHT = -7.0


def _features(word: str) -> list[str]:
    """A word's features: itself, marked, and its prefixes."""
    a, b = PREFIX
    return [f"{word}$", *(word[:k] for k in range(a, min(b, len(word)) + 1))]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, documents) of a task's labelled texts."""
    totals: tuple[Counter, Counter] = (Counter(), Counter())
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])

    def flush():
        for label, c in enumerate(totals):
            names = list(c)
            for a in range(0, len(names), 100_000):
                part = names[a : a + 100_000]
                yield pa.record_batch([pa.array(part, pa.string()), pa.array([label] * len(part), pa.int32()),
                                       pa.array([c[x] for x in part], pa.int64())], schema=schema)
            c.clear()

    for batch in slices(batches):
        rows, flat = letter_words(batch.column("text"))
        coded = flat.dictionary_encode()
        known = [_features(w) for w in coded.dictionary.to_pylist()]
        codes, toxic = coded.indices.to_numpy(zero_copy_only=False), batch.column("toxic").to_pylist()
        ends = np.searchsorted(rows, np.arange(batch.num_rows), "right")
        begin = 0
        for i, end in enumerate(ends):
            totals[toxic[i]].update({f for c in set(codes[begin:end].tolist()) for f in known[c]})
            begin = end
        if sum(map(len, totals)) > 400_000:
            yield from flush()
    yield from flush()


@dataclass(frozen=True)
class Model:
    """Weights of the features and the bias; ``score`` needs nothing else."""

    features: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, cols, vals = indices(texts, self.features)
        z = np.full(len(texts), self.bias)
        np.add.at(z, rows, self.weights[cols] * vals)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def indices(texts: pa.Array, features: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, 1 + log(count)) of the known features of whole texts."""
    at = {f: i for i, f in enumerate(features)}
    rows, flat = letter_words(texts)
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    coded = flat.dictionary_encode()
    found = [[at[f] for f in _features(w) if f in at] for w in coded.dictionary.to_pylist()]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts, pool = np.cumsum(lengths) - lengths, np.fromiter((i for x in found for i in x), np.int64, int(lengths.sum()))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    hit = lengths[codes] > 0
    rows, codes = rows[hit].astype(np.int64), codes[hit]
    n = lengths[codes]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    keys, counts = np.unique(np.repeat(rows, n) * len(features) + pool[np.repeat(starts[codes], n) + within], return_counts=True)
    return keys // len(features), keys % len(features), 1 + np.log(counts)


def select_features(sample: DataFrame, features: int = FEATURES) -> tuple[str, ...]:
    """The features that differ most (signed root of the chi-squared statistic), ties by name; identity terms are always in."""
    counts = sample.select("text", "toxic").mapInArrow(_counts, "feature string, toxic int, n long")
    both = counts.groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
                                         F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")).where("a + b >= 3")
    n1, n0 = sample.agg(F.sum(F.col("toxic")), F.sum(1 - F.col("toxic"))).first()
    n1, n0 = float(n1 or 0), float(n0 or 0)
    n = n1 + n0
    if not n1 or not n0:
        return ALL_TERMS
    all_ = F.col("a") + F.col("b")
    gap = F.col("a") / n1 - F.col("b") / n0
    strength = F.abs(gap) / F.sqrt(all_ / n * (1 - all_ / n + 1 / n) * (1 / n1 + 1 / n0))
    top = both.select("feature", strength.alias("s")).orderBy(F.desc("s"), "feature").limit(features).collect()
    return tuple(dict.fromkeys([*(r.feature for r in top), *ALL_TERMS]))


def _swap_pattern(languages: dict[str, tuple[str, ...]]) -> re.Pattern:
    words = sorted({t for terms in languages.values() for t in terms}, key=lambda t: (-len(t), t))
    return re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")(?![^\W_])", re.IGNORECASE)


def versions(text: str, languages: dict[str, tuple[str, ...]] = IDENTITY_TERMS, pattern: re.Pattern | None = None) -> tuple[str, str]:
    """The two versions of a labelled sentence that must score alike.

    The first is the sentence, the second has every identity term swapped for another of its language, repeated terms for the same one.
    Without any term, both get a neutral mention behind the sentence; the text's length chooses which.
    """
    pattern = pattern or _swap_pattern(languages)
    size, homes = len(text), {t: terms for terms in languages.values() for t in terms}

    def other(m: re.Match) -> str:
        own = m.group().lower()
        terms = homes.get(own)
        if terms is None:
            return m.group()
        i = terms.index(own)
        return terms[(i + 1 + size % (len(terms) - 1)) % len(terms)]

    swapped, n = pattern.subn(other, text)
    if n:
        return text, swapped
    listed = list(languages.values())
    terms = listed[size % len(listed)]
    i = size // len(listed) % len(terms)
    return f"{text} {terms[i]}", f"{text} {terms[(i + 1 + size % (len(terms) - 1)) % len(terms)]}"


def changes(texts: pa.Array, features: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, difference) of the features of the two versions of each text, where they differ."""
    pattern = _swap_pattern(IDENTITY_TERMS)
    both = [versions(t or "", pattern=pattern) for t in texts.to_pylist()]
    keys, vals = [], []
    for side, sign in ((0, 1.0), (1, -1.0)):
        rows, cols, v = indices(pa.array([x[side] for x in both], pa.string()), features)
        keys.append(rows * len(features) + cols)
        vals.append(sign * v)
    flat, at = np.unique(np.concatenate(keys), return_inverse=True)
    gap = np.bincount(at, np.concatenate(vals), len(flat)) if len(flat) else np.empty(0)
    kept = np.abs(gap) > 1e-12
    return flat[kept] // len(features), flat[kept] % len(features), gap[kept]


SAMPLED = "doc_id long, toxic int, cols array<int>, vals array<float>, pair_cols array<int>, pair_vals array<float>"


def _rows(batches: Iterator[pa.RecordBatch], features: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lists = []
        for rows, cols, vals in (indices(batch.column("text"), features), changes(batch.column("text"), features)):
            ends = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1), "left").astype(np.int32))
            lists += [pa.ListArray.from_arrays(ends, pa.array(cols.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(vals.astype(np.float32)))]
        yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), *lists], names=["doc_id", "toxic", "cols", "vals", "pair_cols", "pair_vals"])


def fit_weights(n: int, rows, cols, vals, y, pairs, l2: float = L2, pair_penalty: float = PAIR_PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam; ``pairs`` is (row, col, val) of the feature differences between the versions of each row."""
    w, b = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + CLEAN)))
    pr, pcol, pv = pairs
    m = len(y) if len(pr) else 0
    moment, square = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols] * vals, len(y))
        r = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        grad = np.bincount(cols, r[rows] * vals, n) + 2 * l2 * w
        if m:
            change = np.bincount(pr, w[pcol] * pv, m)
            grad += pair_penalty * 2 * np.bincount(pcol, change[pr] * pv, n) / m
        g = np.append(grad, r.sum() + CLEAN / (1 + np.exp(-b)) / len(y))
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = 0.05 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Model:
    """A model from the labelled rows of ``docs``; ``labels`` has doc_id and toxic (0 or 1; other values and nulls do not count).

    Without examples of both labels nothing is learned, and the model rejects nothing.
    """
    own = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = own.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(sample_rows)
    sample = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                         .join(picked.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").where("text IS NOT NULL"), "toxicity-sample")
    names = select_features(sample, features)
    got = sample.mapInArrow(lambda it: _rows(it, names), SAMPLED)
    y, parts = [], {k: ([], []) for k in ("", "pair_")}
    lengths: dict[str, list[int]] = {k: [] for k in parts}
    for r in got.orderBy("doc_id").toLocalIterator():
        y.append(r.toxic)
        for k, (cols, vals) in parts.items():
            lengths[k].append(len(r[f"{k}cols"]))
            cols.append(np.array(r[f"{k}cols"], np.int32))
            vals.append(np.array(r[f"{k}vals"], np.float32))
    if not y or len(set(y)) < 2:
        return Model(names, np.zeros(len(names)), UNTAUGHT)
    own, pairs = ((np.repeat(np.arange(len(y)), lengths[k]), np.concatenate(cols), np.concatenate(vals).astype(float)) for k, (cols, vals) in parts.items())
    w, b = fit_weights(len(names), *own, np.array(y, float), pairs)
    return Model(names, w, b)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [model.value.score(x.column("text")) for x in slices(iter([batch]))]
        yield batch.drop_columns(["text"]).append_column("score", pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64()))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``: score is 0 to 1, predicted 1 from 0.5 on.

    Null and empty texts score by the bias alone.  Ids, null ones too, pass through; repeated rows score alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(lambda it: _score(it, held), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _calm(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield batch.filter(pa.array(model.value.score(batch.column("text")) < 0.5))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model scores below 0.5; all columns stay and no row moves."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _calm(it, held), docs.schema)
