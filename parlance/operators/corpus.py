"""Corpus preparation: vocabulary, encoding, augmentation, splits, generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions import text as X
from parlance.functions.hashing import hash_bits, pick, uniform
from parlance.functions.safety import let
from parlance.operators.blocks import hash_cut
from parlance.rules import corpus as C

GENERATION = "topic:string, conversation:array<struct<role:string,content:string>>"
WRAPPED = f"value struct<{GENERATION}>, _end int, _corrupt string"


def tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Long token table: words, then shingles, with positions from 0."""
    toks = let(X.words(F.col(text)), X.tokens)
    return df.select(*keys, F.posexplode(toks).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


def word_counts(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, word, n): occurrences of every word in the texts of each group, counted with map-side combine."""
    return df.select(*by, F.explode(X.words(F.col(text))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


def token_counts(df: DataFrame, text: str = "text", words: DataFrame | None = None) -> DataFrame:
    """Corpus frequency of every token.

    Words are counted first; shingles are then cut from the distinct words and
    weighted, so they are never generated per occurrence.  ``words`` are the ``word_counts`` of ``df`` by any
    columns, where they are at hand: the texts are then not read again.
    """
    per_word = word_counts(df, [], text) if words is None else words.groupBy("word").agg(F.sum("n").alias("n"))
    parts = per_word.select(F.explode(F.concat(F.array("word"), X.shingles(F.col("word")))).alias("token"), "n")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def vocab(counts: DataFrame, size: int = C.VOCAB_SIZE) -> DataFrame:
    """Most frequent tokens with dense ids from 4; ties go to the smaller token.

    A top-k over partitions keeps ``size - 4`` rows; only these are ranked.
    """
    top = counts.orderBy(F.col("n").desc(), "token").limit(size - C.RESERVED_IDS)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "token"))
    return top.select("token", "n", (rank + C.RESERVED_IDS - 1).cast("bigint").alias("id"))


def vocab_coverage(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct tokens, how many have an id, and the share.

    The vocabulary holds at most its fixed size (10,000 by default), hence the
    broadcast."""
    known = F.broadcast(vocabulary.select("token", "id"))
    out = counts.join(known, "token", "left").agg(
        F.count("*").alias("tokens"), F.count("id").alias("covered"))
    return out.select("tokens", "covered", F.round(F.col("covered") / F.col("tokens"), 6).alias("coverage"))


def encoded_sequences(df: DataFrame, vocabulary: DataFrame, keys: list[str], text: str = "text",
                      seq_len: int = C.SEQ_LEN) -> DataFrame:
    """BOS + ids of the first ``seq_len - 2`` tokens + EOS, padded.

    The broadcast join is against at most 10,000 rows.  All tokens of a text
    stay in its partition, so the partial collect leaves one small id array
    per text before the shuffle on the key.
    """
    heads = df.select(*keys, F.posexplode_outer(X.head_tokens(F.col(text), seq_len - 2)).alias("pos", "token"))
    known = F.broadcast(vocabulary.select("token", F.col("id").cast("int").alias("_token_id")))
    rows = heads.join(known, "token", "left")
    item = F.when(F.col("token").isNotNull(), F.struct(F.col("pos"), F.coalesce("_token_id", F.lit(C.UNK)).alias("id")))
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    ids = F.concat(F.array(F.lit(C.BOS)), F.transform("items", lambda s: s["id"]), F.array(F.lit(C.EOS)))
    padded = let(ids, lambda a: F.concat(a, F.array_repeat(F.lit(C.PAD), F.lit(seq_len) - F.size(a))))
    return out.select(*keys, padded.alias("ids"))


def augmented_corpus(df: DataFrame, key: str, text: str, factor: int = C.AUG_FACTOR) -> DataFrame:
    """Originals (copy 0) and ``factor`` variants of each row, with a shuffle key.

    Narrow: write it with ``repartitionByRange("shuffle_key")`` to shuffle."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(factor).cast("bigint"))))
    k = [F.col(key), F.col("copy")]
    changed = F.when(F.col("copy") == 0, F.col(text)).otherwise(X.augment(F.col(text), *k))
    return copies.withColumn(text, changed).withColumn("shuffle_key", hash_bits(*k, F.lit("order")))


def stratified_split(df: DataFrame, key: str, label: str, percent: int = 10) -> DataFrame:
    """Exact hold-out of ``percent`` of every label, chosen by md5 of the key."""
    quota = F.expr(f"(n * {percent} + 50) div 100")
    out = hash_cut(df, F.col(key), quota, [label])
    return out.withColumn("split", F.when(F.col("selected"), "eval").otherwise("train")).drop("selected")


def corpus_split(df: DataFrame, key: str, percent: int = C.TRAIN_RATIO_PERCENT) -> DataFrame:
    """Exact train/eval cut at int(percent of n), in md5 order."""
    out = hash_cut(df, F.col(key), F.expr(f"n * {percent} div 100"), [])
    return out.withColumn("split", F.when(F.col("selected"), "train").otherwise("eval")).drop("selected")


def intent_index(df: DataFrame, intent: str = "intent") -> DataFrame:
    """Distinct intents in sorted order with a dense index and counts; the
    ranking task sees one row per intent."""
    counts = df.groupBy(intent).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(intent))
    return counts.select(F.col(intent).alias("intent"), (rank - 1).cast("bigint").alias("intent_index"), "n")


def generation_plan(seeds: DataFrame, key: str) -> DataFrame:
    """One prompt request per seed row: topic, style and prompt text."""
    k = F.col(key)
    out = seeds.select(
        k.alias("plan_id"), pick(C.TOPICS, uniform(k, F.lit("topic"))).alias("topic"),
        pick(C.STYLES, uniform(k, F.lit("style"))).alias("style"))
    before, rest = C.PROMPT_FORMAT.split("{topic}")
    middle = rest.split("{style}")[0]
    return out.withColumn("prompt", F.concat(F.lit(before), "topic", F.lit(middle), "style"))


def _json_body(raw: Column) -> Column:
    """Inside of the first code fence if there is one, then first '{' to last '}'."""
    fenced = F.split(raw, "```", -1)[1]
    inner = F.when(F.contains(raw, F.lit("```")),
                   F.when(F.startswith(fenced, F.lit("json")), F.substring(fenced, 5, 2147483647)).otherwise(fenced)
                   ).otherwise(raw)
    return F.regexp_extract(inner, r"(?s)\{.*\}", 0)


def parse_generations(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Parse raw model output; ``reason`` is NULL for usable conversations.

    The text from the first brace to the last must be one JSON value (the parser alone would
    overlook what follows it, so it is parsed inside another object), and every turn needs a role and a content.
    Row-local: the conversation is an array inside one row, so no shuffle."""
    options = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}

    def outcome(body: Column) -> Column:
        whole = F.from_json(F.concat(F.lit('{"value":'), body, F.lit(',"_end":1}')), WRAPPED, options)
        broken = lambda t: t.isNull() | t["role"].isNull() | t["content"].isNull()
        return let(whole, lambda w: F.struct(
            F.when(body == "", "no_braces")
            .when(w["_corrupt"].isNotNull() | w["_end"].isNull(), "broken_json")
            .when(w["value"]["conversation"].isNull(), "no_conversation")
            .when(F.size(w["value"]["conversation"]) < C.MIN_GENERATED_TURNS, "too_few_turns")
            .when(F.exists(w["value"]["conversation"], broken), "broken_turn").alias("reason"),
            w["value"]["conversation"].alias("conversation"), w["value"]["topic"].alias("generated_topic")))

    df = raw.withColumn("_p", let(_json_body(F.col(text)), outcome))
    good = F.col("_p.reason").isNull()
    return df.withColumns({
        "reason": F.col("_p.reason"), "conversation": F.when(good, F.col("_p.conversation")),
        "generated_topic": F.when(good, F.col("_p.generated_topic"))}).drop("_p")


def chatml_corpus(parsed: DataFrame, keys: list[str], requested_topic: str) -> DataFrame:
    """ChatML text per usable conversation; the topic falls back to the requested one.

    Rejects are dropped by an empty generator, not a filter, which the optimizer
    would push below the parse and so parse every text twice."""
    turn = lambda role, content: F.concat(
        F.lit(C.CHATML_START), role, F.lit("\n"), content, F.lit(C.CHATML_END))
    system = turn(F.lit("system"), F.lit(C.TRAINING_SYSTEM))
    lines = F.concat(F.array(system), F.transform("conversation", lambda t: turn(t["role"], t["content"])))
    row = F.struct(F.array_join(lines, "\n").alias("text"), F.coalesce("generated_topic", requested_topic).alias("topic"))
    kept = parsed.select(*keys, F.explode(F.when(F.col("reason").isNull(), F.array(row))).alias("r"))
    return kept.select(*keys, "r.text", "r.topic")


def corpus_resume(plan: DataFrame, finished: DataFrame) -> DataFrame:
    """Plan rows that have no finished row yet."""
    return plan.join(finished.select("plan_id"), "plan_id", "left_anti")
