"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (arrow_ids, conv_trie, decontam, lines, minhash, mixing, periodic, pii, quality, secrets, sharding, toxicity,
                          url_cascade)
from parlance.llm.common import table, words


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; the block list is the thin pages."""
    pages = table(spark, sf_dir, "pages")
    judged = url_cascade.filter_urls(pages.select("page_id", "url"), url_cascade.thin_pages(pages), url_cascade.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


#: Labels of rows with this remainder are for testing only.
FOLDS, HELD_OUT = 5, 0


def fold(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of the held-out fold are not read by the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id")) != HELD_OUT))
    out = toxicity.scores(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents alone, with the items they hold."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).drop("passes")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = sharding.with_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return sharding.shard_rows(slim)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.Detector(spark).detect(table(spark, sf_dir, "documents")).drop("found")


#: The tokenizer's file; None takes the installed public one.
TOKENIZER: str | None = None


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to Arrow files and read back."""
    path = TOKENIZER
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return arrow_ids.round_trip(table(spark, sf_dir, "documents"), path)


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.trie_nodes(*conv_trie.rebuilt(table(spark, sf_dir, "conversations")))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of one doc_id in ten (by hash) made periodic from some word on; other texts stay as they are.

    With h = crc32(decimal doc_id) and g = h div 10, where h ends in 0 and the text has n > 0 words: word i from a = g % n on
    becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).  Words are then joined by one blank.  A null doc_id has no hash.
    """
    w, g = F.col("_w"), F.floor(F.col("_h") / 10)
    n, a = F.size("_w"), (g % F.size("_w")).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.transform(F.slice(w, a + 1, n - a), lambda x, i: F.get(w, a + i % p))
    hashed = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn(
        "_w", F.when(F.col("_h") % 10 == 0, words(F.col("text"))))
    return hashed.withColumn("text", F.when(F.size("_w") > 0, F.array_join(F.concat(F.slice(w, 1, a), tail), " ")).otherwise(F.col("text"))).drop("_h", "_w")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents with repeated tails: their number, the most repeated one, digests of all and of the collapsed text."""
    docs = with_repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(docs).withColumn("best", periodic.most_repeated(F.col("runs")))
    lines_ = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines_, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_pii": op9_pii,
    "op10_token_ids": op10_token_ids,
    "op11_secret_scans": op11_secret_scans,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}
