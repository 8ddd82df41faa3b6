"""Quality rules with risk-controlled cutoffs.

Each rule rejects documents whose measure passes a cutoff.  ``PATH`` is a fixed sequence of steps, each of which makes one rule
stricter (or brings it in); a policy is all steps up to some place, so the policies are nested from lax to strict.  For every
stratum the policies are tested one after the other by an exact binomial test on the labelled good documents: may
more than ``alpha`` of good documents be lost by *all its rules together*?  The first policy that is not certified ends the
sequence, and the one before is used.  The order is written down before any label is seen, and testing in a fixed order until
the first failure needs no correction for the number of steps or rules; the strata share ``delta``.  So with probability
1 - delta no stratum loses more than ``alpha`` of its good documents to these rules.  What the base rules (too few words, too many
repeated ones) reject is not part of that bound.  A stratum with too few labels certifies nothing and keeps its documents:
with the values below and four strata it takes 436 good documents without a rejection.

SQL functions only: measures are computed within the row, labels meet them in
one narrow join, and the final verdict joins the small table of cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.common import SPACE, words
from parlance.session import materialise

WINDOW = 5
ALPHA, DELTA = 0.01, 0.05
#: The steps: (measure, cutoff), a document is rejected if its measure is above the cutoff.  First what speaks of junk in any language,
#: down to a moderate cutoff, then every rule in turn, a notch stricter each time.
PATH: tuple[tuple[str, float], ...] = (
    *[("symbol_ratio", c) for c in (2.0, 1.2, 0.8, 0.5, 0.3, 0.2)],
    *[("bang_ratio", c) for c in (2.0, 1.2, 0.8, 0.5)],
    *[("upper_ratio", c) for c in (0.5, 0.4, 0.3)],
    ("same_word_ratio", 0.9), ("same_word_ratio", 0.8), ("long_word", 40.0), ("long_word", 20.0), ("dup_line_ratio", 0.5),
    ("symbol_ratio", 0.1), ("bang_ratio", 0.3), ("upper_ratio", 0.2), ("same_word_ratio", 0.7), ("long_word", 15.0), ("dup_line_ratio", 0.3),
    ("few_words", -15.0), ("repeat_ratio", 0.15),
    ("symbol_ratio", 0.05), ("bang_ratio", 0.2), ("upper_ratio", 0.12), ("same_word_ratio", 0.65), ("long_word", 12.0), ("dup_line_ratio", 0.2),
    ("few_words", -20.0), ("repeat_ratio", 0.1),
    ("symbol_ratio", 0.02), ("bang_ratio", 0.1), ("upper_ratio", 0.08), ("same_word_ratio", 0.6), ("long_word", 10.0), ("dup_line_ratio", 0.1),
    ("few_words", -30.0), ("repeat_ratio", 0.05),
)
MEASURES = ("symbol_ratio", "bang_ratio", "upper_ratio", "repeat_ratio", "dup_line_ratio", "same_word_ratio", "long_word", "few_words")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, and MEASURES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    i = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    runs = F.when(F.col("n_words") >= WINDOW, F.transform(i, lambda k: F.xxhash64(*[F.get("_w", k + j) for j in range(WINDOW)])))
    # positions of windows whose hash occurs again: neighbours once (hash, position) are sorted
    pairs = F.array_sort(F.transform("_runs", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    at = F.array_sort(F.transform(F.filter("_pairs", lambda p, k: (p["h"] == F.get("_pairs", k - 1)["h"]) | (p["h"] == F.get("_pairs", k + 1)["h"])),
                                  lambda p: p["k"]))
    covered = F.aggregate("_at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]
    repeats = (F.col("_runs").isNotNull()) & (F.size(F.array_distinct("_runs")) < F.size("_runs"))
    words_or_1 = F.greatest("n_words", F.lit(1))
    return (
        docs.withColumn("_t", text)
        .withColumns({"_w": words(F.col("_t")), "_l": lines})
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumns({
            "word_chars": (F.length("_t") - count_of(F.col("_t"), " \t\n\x0b\x0c\r")).cast("long"),
            "n_symbols": count_of(F.col("_t"), "#*$%&|<>").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_n_lines": F.size("_l"), "_n_distinct": F.size(F.array_distinct("_w")), "_runs": runs,
        })
        .withColumn("_pairs", F.when(repeats, pairs))
        .withColumn("_at", at)
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumns({
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbol_ratio": F.col("n_symbols") / words_or_1,
            "bang_ratio": count_of(F.col("_t"), "!?") / words_or_1,
            "upper_ratio": (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}", ""))) / F.greatest(F.length("_t"), F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / words_or_1,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
            "same_word_ratio": 1 - F.col("_n_distinct") / words_or_1,
            "long_word": F.col("word_chars") / words_or_1,
            "few_words": -F.col("n_words").cast("double"),
        })
        .drop("_t", "_w", "_l", "_n_lines", "_n_distinct", "_runs", "_pairs", "_at")
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of the binomial distribution (n, p), 1 for k >= n * p; in logarithms, for any n."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("log_w"), (n * F.log1p(F.lit(-p))).alias("top"), F.lit(1.0).alias("sum"))
    odds = p / (1 - p)

    def step(a: Column, i: Column) -> Column:
        log_w = a["log_w"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(a["top"], log_w)
        return F.struct(log_w.alias("log_w"), top.alias("top"), (a["sum"] * F.exp(a["top"] - top) + F.exp(log_w - top)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    last = F.aggregate(terms, start, step)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(last["top"] + F.log(last["sum"])))


def first_step(path: tuple[tuple[str, float], ...] = PATH) -> Column:
    """The first step (from 1) that rejects a row with the measures; 0 if none does."""
    return F.array_position(F.array(*[F.coalesce(F.col(m) > c, F.lit(False)) for m, c in path]), F.lit(True))


def certified_cutoffs(labelled: DataFrame, path: tuple[tuple[str, float], ...] = PATH, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, n, steps, one column a measure): how many steps are certified and the strictest cutoff among them, null where none is.

    ``labelled`` has stratum (not null) and the measures of good documents that pass the base rules.
    """
    measures = list(dict.fromkeys(m for m, _ in path))
    lost = labelled.select("stratum", first_step(path).alias("_first")).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_first").between(1, i).cast("long")).alias(f"_k{i}") for i in range(1, len(path) + 1)])
    listed = F.posexplode(F.array(*[F.col(f"_k{i}") for i in range(1, len(path) + 1)]))
    rows = lost.withColumn("strata", F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))).select("stratum", "n", "strata", listed.alias("at", "k"))
    passed = rows.withColumn("passed", binomial_tail(F.col("k"), F.col("n"), alpha) <= F.lit(delta) / F.col("strata"))
    tested = passed.groupBy("stratum", "n").agg(F.coalesce(F.min(F.when(~F.col("passed"), F.col("at"))), F.lit(len(path))).cast("int").alias("steps"))
    return tested.select("stratum", "n", "steps", *[
        F.array_min(F.array(*[F.when(F.col("steps") > i, F.lit(float(c))) for i, (x, c) in enumerate(path) if x == m])).alias(m) for m in measures])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", path: tuple[tuple[str, float], ...] = PATH,
          alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, stratum, counts, base_failed, the measures, failed_rules, kept) of every row of ``docs``.

    ``labels`` has doc_id and quality; rows of quality 1 are the holdout of good documents
    (a doc_id counts once; null ids and null qualities do not count).  A null stratum is one of its own.
    Null texts have no words and so fail the base rules.  Repeated rows are judged alike;
    without labels nothing but the base rules rejects.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    slim = with_counts(docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), stratum), F.lit("")).alias("stratum")))
    measured = materialise(slim.select("doc_id", "stratum", *counts, "base_failed", *MEASURES), "quality-measures")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    holdout = measured.where("NOT base_failed").join(good, "doc_id", "left_semi")
    cutoffs = materialise(certified_cutoffs(holdout, path, alpha, delta), "quality-cutoffs")
    measures = list(dict.fromkeys(m for m, _ in path))
    cut = cutoffs.select("stratum", *[F.col(m).alias(f"_cut_{m}") for m in measures])
    failed = F.array_compact(F.array(*[F.when(F.col(m) > F.col(f"_cut_{m}"), F.lit(m)) for m in measures]))
    return (
        measured.join(cut, "stratum", "left")
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .select("doc_id", "stratum", *counts, "base_failed", *MEASURES, "failed_rules", "kept")
    )
