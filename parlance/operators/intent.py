"""Intent and tag scoring with linear heads, model training and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions import text as X
from parlance.functions.safety import let
from parlance.operators import corpus as CO
from parlance.rules import corpus as C
from parlance.session import materialise


def linear_model(labelled: DataFrame, vocabulary: DataFrame, text: str = "text", intent: str = "intent",
                 tags: str = "tags", words: DataFrame | None = None) -> DataFrame:
    """Closed-form linear heads: rows (head, class, token, w), NULL token = bias.

    One softmax head over intents and one yes/no head per tag, with add-one
    smoothed log likelihoods.  Words are counted by the labels of their texts, (intent, tags), so a text
    is never expanded by its heads; counts per (head, class, token) come from
    the distinct words, and a tag's "no" side is the total minus its "yes" side.
    ``words`` are the written ``corpus.word_counts`` by these two columns, where they are at hand.  Fitting runs jobs (it writes the
    counts to the shared folder); the weights themselves stay lazy.
    """
    head = F.concat(
        F.array(F.struct(F.lit("intent").alias("head"), F.col(intent).alias("class")),
                F.struct(F.lit("all").alias("head"), F.lit("all").alias("class"))),
        F.transform(tags, lambda t: F.struct(F.concat(F.lit("tag:"), t).alias("head"), F.lit("yes").alias("class"))))
    docs = labelled.select(F.explode(head).alias("h")).groupBy("h.head", "h.class").agg(F.count("*").alias("docs"))
    # Words first, shingles from the distinct words of each class.
    counted = CO.word_counts(labelled, [intent, tags], text) if words is None else words
    per_word = counted.select(F.explode(head).alias("h"), "word", "n").groupBy("h.head", "h.class", "word").agg(F.sum("n").alias("n"))
    parts = per_word.select("head", "class", "n",
                            F.explode(F.concat(F.array("word"), X.shingles(F.col("word")))).alias("token"))
    known = F.broadcast(vocabulary.select("token"))
    counts = parts.join(known, "token").groupBy("head", "class", "token").agg(F.sum("n").alias("n"))
    # Both are read several times below; written once, the texts are scanned twice in all.
    counts, docs = materialise(counts, "head-counts"), materialise(docs, "head-docs")

    # Classes and heads are label-set sized; they are joined, never collected.
    classes = docs.where(F.col("head") != "all")
    heads = classes.groupBy("head").agg(F.sum("docs").alias("head_docs"))
    total = docs.where(F.col("head") == "all").select(F.col("docs").alias("all_docs"))
    no_docs = heads.where(F.col("head") != "intent").withColumn("all_docs", total.scalar()).select(
        "head", F.lit("no").alias("class"), (F.col("all_docs") - F.col("head_docs")).alias("docs"))
    classes = classes.unionByName(no_docs).withColumn("all_docs", total.scalar())

    # Dense weights: every vocabulary token gets every class, from one array of
    # the (label-set sized) classes.
    listed = classes.agg(F.collect_list(F.struct("head", "class")).alias("c"))
    grid = counts.where(F.col("head") == "all").select("token", F.col("n").alias("all_n")).withColumn(
        "c", listed.scalar()).select("token", "all_n", F.inline("c"))
    own = F.when(F.col("class") == "no", "yes").otherwise(F.col("class"))
    seen = counts.where(F.col("head") != "all").select(
        "head", F.col("class").alias("own"), "token", F.col("n").alias("seen_n"))
    full = grid.withColumn("own", own).join(seen, ["head", "own", "token"], "left")
    n = F.when(F.col("class") == "no", F.col("all_n") - F.coalesce("seen_n", F.lit(0))).otherwise(
        F.coalesce("seen_n", F.lit(0)))
    full = full.select("head", "class", "token", n.alias("n"))
    sizes = full.groupBy("head", "class").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    weights = full.join(sizes, ["head", "class"]).select(
        "head", "class", "token", F.ln((F.col("n") + 1) / (F.col("size") + F.col("terms"))).alias("w"))
    bias = classes.select("head", "class", F.lit(None).cast("string").alias("token"),
                          F.ln((F.col("docs") + 1) / (F.col("all_docs") + 1)).alias("w"))
    return weights.unionByName(bias)


#: Bound of the weights that are broadcast: tokens of the vocabulary x classes of all heads x 8 bytes.
MODEL_BYTES = 256 << 20
#: Cells (texts x tokens) of the count matrix that a task multiplies at a time.
CELLS = 4 << 20
SCORED = "intent string, confidence double, tags array<string>"


def _weights(model: DataFrame) -> tuple[list[tuple[str, str]], np.ndarray, list[str], np.ndarray]:
    """(classes by head and name, their bias, tokens, weights token x class); checked against MODEL_BYTES before any weight is read."""
    bias = model.where(F.col("token").isNull()).select("head", "class", "w").orderBy("head", "class").collect()
    classes = [(b["head"], b["class"]) for b in bias]
    tokens = model.where(F.col("token").isNotNull()).select("token").distinct().count()
    if tokens * len(classes) * 8 > MODEL_BYTES:
        raise ValueError(f"{tokens} tokens x {len(classes)} classes are more than {MODEL_BYTES} bytes: use a smaller vocabulary")
    place = {c: i for i, c in enumerate(classes)}
    known = F.create_map(*[x for (h, c), i in place.items() for x in (F.concat_ws("\x01", F.lit(h), F.lit(c)), F.lit(i))])
    rows = model.where(F.col("token").isNotNull()).select("token", known[F.concat_ws("\x01", "head", "class")].alias("at"), "w").toArrow()
    coded = rows.column("token").combine_chunks().dictionary_encode()
    matrix = np.zeros((len(coded.dictionary), len(classes)))
    matrix[coded.indices.to_numpy(zero_copy_only=False), rows.column("at").to_numpy()] = rows.column("w").to_numpy()
    return classes, np.array([b["w"] for b in bias]), coded.dictionary.to_pylist(), matrix


def _scorer(classes: list[tuple[str, str]], shared, threshold: float, width: int) -> Callable:
    """Scores Arrow batches whose last column holds the words of a text; shingles are cut once from a batch's distinct words."""
    intents = [i for i, (h, _) in enumerate(classes) if h == "intent"]
    heads = sorted({h for h, _ in classes if h != "intent"})
    yes, no = ([classes.index((h, c)) for h in heads] for c in ("yes", "no"))
    names = pa.array([h.removeprefix("tag:") for h in heads], pa.string())

    def codes_of(text: str) -> np.ndarray:
        """One number for each three characters in a row."""
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        return c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]

    def listed(tokens: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(tokens, codes of the shingles among them in order, their places)."""
        places = np.array([i for i, t in enumerate(tokens) if len(t) == 4 and t[0] == "#"], np.int64)
        codes = np.array([codes_of(tokens[i][1:])[0] for i in places], np.uint64)
        order = np.argsort(codes)
        return pa.array(tokens, pa.string()), codes[order], places[order]

    def known_tokens(words: pa.Array, vocabulary: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(borders, token): the places of each word's known tokens, itself and its shingles, end to end."""
        tokens, codes, places = vocabulary
        own = pc.fill_null(pc.index_in(words, value_set=tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        word, found = np.flatnonzero(own >= 0), own[own >= 0]
        if len(codes) and lengths.sum() >= 3:
            owner = np.repeat(np.arange(len(words)), lengths)
            cut = codes_of("".join(words.to_pylist()))
            at = np.minimum(np.searchsorted(codes, cut), len(codes) - 1)
            hit = (codes[at] == cut) & (owner[:-2] == owner[2:])
            word, found = np.concatenate([word, owner[:-2][hit]]), np.concatenate([found, places[at[hit]]])
        order = np.argsort(word, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]), found[order]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, tokens, matrix = shared.value
        vocabulary = listed(tokens)
        rows_at_once = max(1, CELLS // max(1, len(tokens)))
        for batch in batches:
            lists = batch.column(width)
            coded = pc.list_flatten(lists).dictionary_encode()
            borders, known = known_tokens(coded.dictionary, vocabulary)
            words = coded.indices.to_numpy(zero_copy_only=False)
            of_row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                lo, hi = np.searchsorted(of_row, [at, at + part.num_rows])
                word, row = words[lo:hi], of_row[lo:hi] - at
                n = borders[word + 1] - borders[word]
                tokens_at = np.repeat(borders[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
                cells = np.repeat(row, n) * len(tokens) + known[tokens_at]
                counts = np.bincount(cells, minlength=part.num_rows * len(tokens)).reshape(part.num_rows, len(tokens))
                z = counts.astype(np.float64) @ matrix + bias
                own = z[:, intents]
                # of equal scores the last class wins
                best = len(intents) - 1 - np.argmax(own[:, ::-1], axis=1)
                top = own[np.arange(len(own)), best]
                confidence = 1 / np.exp(own - top[:, None]).sum(axis=1)
                fired = 1 / (1 + np.exp(np.minimum(z[:, no] - z[:, yes], 700))) > threshold
                ends = np.concatenate([[0], np.cumsum(fired.sum(axis=1))]).astype(np.int32)
                tags = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.nonzero(fired)[1])))
                labels = pa.array([classes[i][1] for i in intents], pa.string()).take(pa.array(best))
                yield pa.record_batch([*part.columns[:width], labels, pa.array(confidence), tags],
                                      names=[*part.schema.names[:width], "intent", "confidence", "tags"])

    return score


def linear_scores(df: DataFrame, model: DataFrame, keys: list[str], text: str = "text",
                  threshold: float = C.TAG_THRESHOLD) -> DataFrame:
    """Best intent with its confidence, and the tags above the threshold, from whole texts.

    Pass the model as a written table: its class list (label-set sized) and its weights, whose
    bound is checked, are read when the plan is built.  Words leave the row; their tokens are counted against the fixed vocabulary
    in the same task and multiplied by the weights of all classes at once, a block of texts a time: nothing is
    shuffled, however many tags there are.  A null text has no tokens and is scored by the bias alone.
    """
    classes, bias, tokens, matrix = _weights(model)
    shared = df.sparkSession.sparkContext.broadcast((bias, tokens, matrix))
    rows = df.select(*keys, F.coalesce(X.words(F.col(text)), F.array().cast("array<string>")).alias("_words"))
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [SCORED])
    return rows.mapInArrow(_scorer(classes, shared, threshold, len(keys)), schema)


def _tokens(df: DataFrame, text: str, *columns: str) -> DataFrame:
    return df.select(*columns, F.coalesce(let(X.words(F.col(text)), X.tokens), F.array().cast("array<string>")).alias("tokens"))


def train_intent_model(labelled: DataFrame, text: str = "text", intent: str = "intent", tags: str | None = None,
                       features: int = 1 << 14) -> PipelineModel:
    """Logistic regressions over hashed token counts: one over the intents, and one yes/no head for each tag.

    One ``PipelineModel``, so that ``save`` and ``PipelineModel.load`` keep all of it; the tags' names are those of an
    indexer among its stages.  A tag that all labelled texts have, or none, has no head.
    """
    names: list[str] = []
    if tags is not None:
        n = labelled.count()
        held = labelled.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").count().orderBy("tag").collect()
        names = [r["tag"] for r in held if r["count"] < n]
    flags = [F.array_contains(tags, t).cast("double").alias(f"is_{i}") for i, t in enumerate(names)]
    hashing = HashingTF(inputCol="tokens", outputCol="features", numFeatures=features)
    tokens = _tokens(labelled.select(text, intent, *flags), text, intent, *[f"is_{i}" for i in range(len(names))])
    # all heads are fitted on the written vectors: texts are cut and hashed once
    vectors = materialise(hashing.transform(tokens).drop("tokens"), "intent-vectors")
    index = StringIndexer(inputCol=intent, outputCol="label", stringOrderType="alphabetAsc").fit(vectors)
    intents = LogisticRegression(maxIter=10, regParam=0.01, family="multinomial").fit(index.transform(vectors))
    heads = [
        LogisticRegression(maxIter=10, regParam=0.01, family="binomial", labelCol=f"is_{i}", rawPredictionCol=f"raw_{i}",
                           probabilityCol=f"tag_{i}", predictionCol=f"has_{i}").fit(vectors)
        for i in range(len(names))]
    listed = [StringIndexerModel.from_labels(names, inputCol="tag", outputCol="tag_index")] if names else []
    return PipelineModel([index, hashing, intents, *listed, *heads])


def apply_intent_model(model: PipelineModel, df: DataFrame, keys: list[str], text: str = "text",
                       threshold: float = C.TAG_THRESHOLD) -> DataFrame:
    """(keys, intent, confidence, tags) by a model of ``train_intent_model``; narrow."""
    intents, *others = model.stages
    names = F.array(*[F.lit(v) for v in intents.labels])
    data, tags = _tokens(df, text, *keys), []
    for stage in others:
        if isinstance(stage, StringIndexerModel):
            tags = list(stage.labels)
        else:
            data = stage.transform(data)
    fired = F.filter(F.array(*[F.when(vector_to_array(f"tag_{i}")[1] > threshold, F.lit(t)) for i, t in enumerate(tags)])
                     if tags else F.array().cast("array<string>"), lambda t: t.isNotNull())
    return data.select(
        *keys, F.element_at(names, F.col("prediction").cast("int") + 1).alias("intent"),
        F.array_max(vector_to_array("probability")).alias("confidence"), fired.alias("tags"))


def above_majority(pred: DataFrame, by: list[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """(by, n, classes, above_majority): rows, classes among them, and whether more rows are right than the commonest class has."""
    per = pred.groupBy(*by, truth).agg(F.count("*").alias("n"), F.sum((F.col(truth) == F.col(guess)).cast("long")).alias("right"))
    return per.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count("*").alias("classes"), (F.sum("right") > F.max("n")).alias("above_majority"))


def intent_accuracy(pred: DataFrame, by: list[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    hit = (F.col(truth) == F.col(guess)).cast("bigint")
    return pred.groupBy(*by).agg(F.count("*").alias("n"), F.sum(hit).alias("correct")).withColumn(
        "accuracy", F.round(F.col("correct") / F.col("n"), 6))


def tag_f1(pred: DataFrame, by: list[str], truth: str = "true_tags", guess: str = "tags") -> DataFrame:
    """Per-tag counts and F1.  Each row votes once per tag it has on either
    side, so no join of true and predicted rows is needed."""
    either = F.array_union(truth, guess)
    votes = pred.select(*by, F.explode(F.transform(either, lambda t: F.struct(
        t.alias("tag"), F.array_contains(F.col(truth), t).alias("t"), F.array_contains(F.col(guess), t).alias("g")))
    ).alias("v"))
    tally = lambda c: F.sum(c.cast("bigint"))
    t, g = F.col("v.t"), F.col("v.g")
    out = votes.groupBy(*by, F.col("v.tag").alias("tag")).agg(
        tally(t & g).alias("tp"), tally(~t & g).alias("fp"), tally(t & ~g).alias("fn"))
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return out.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))


def tag_macro_f1(per_tag: DataFrame, by: list[str]) -> DataFrame:
    return per_tag.groupBy(*by).agg(F.count("*").alias("tags"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def per_intent(pred: DataFrame, intents: DataFrame, by: list[str], truth: str = "truth", guess: str = "guess"
               ) -> DataFrame:
    """Accuracy per intent with warning flags and an overall row.

    ``intents`` lists every class (per ``by``); classes without examples are kept.  The
    overall row is a second grouping set of the same aggregate.
    """
    hit = (F.col(truth) == F.col(guess)).cast("bigint")
    per = pred.groupBy(*by, F.col(truth).alias("intent")).agg(F.count("*").alias("n"), F.sum(hit).alias("correct"))
    listed = intents.select("intent", *by).join(per, ["intent", *by], "left")
    out = listed.rollup(*by, "intent").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
        F.grouping_id().alias("_level"))
    keep = F.col("_level") <= 1
    acc = F.when(F.col("n") > 0, F.round(F.col("correct") / F.col("n"), 6))
    out = out.where(keep).withColumn("accuracy", acc)
    one = F.col("_level") == 0
    return out.select(
        F.when(one, "intent").otherwise("overall").alias("scope"), *by, "intent", "n", "correct", "accuracy",
        F.coalesce(one & (F.col("accuracy") < 0.5), F.lit(False)).alias("warn"),
        F.coalesce(one & (F.col("accuracy") == 0) & (F.col("n") > 5), F.lit(False)).alias("collapse"))
