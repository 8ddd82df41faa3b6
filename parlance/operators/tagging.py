"""Tag and language roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions.safety import let
from parlance.rules import corpus as C
from parlance.rules import tags as T
from parlance.session import materialise

#: Lengths of the pieces that keywords are found by, the longest that fits, and texts whose pieces tell how rare each is.
PIECES, SAMPLE_TEXTS = (6, 3), 2_000
#: Bytes of an index that is broadcast; a larger one is shuffled to the texts' pieces.
INDEX_BYTES = 64 << 20


def tag_frequency(df: DataFrame, tags: str = "tags", min_freq: int = C.MIN_TAG_FREQ) -> DataFrame:
    """Tag vocabulary: count, share of rows and index of tags seen often enough.

    A NULL marker per row counts the rows in the same pass; after the
    aggregate only the tag vocabulary is left, which one task ranks.
    """
    rows = df.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(tags))).alias("tag"))
    counts = rows.groupBy("tag").agg(F.count("*").alias("n"))
    total = F.max(F.when(F.col("tag").isNull(), F.col("n"))).over(W.partitionBy(F.lit(0)))
    kept = counts.withColumn("rows", total).where(F.col("tag").isNotNull() & (F.col("n") >= min_freq))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "tag"))
    return kept.select("tag", "n", F.round(F.col("n") / F.col("rows"), 6).alias("share"),
                       (rank - 1).cast("bigint").alias("tag_index"))


def tag_multi_hot(df: DataFrame, vocabulary: DataFrame, keys: list[str], tags: str = "tags") -> DataFrame:
    """0/1 vector over the tag vocabulary.

    The vocabulary is folded to one array by a scalar subquery; its size is
    bounded by the rule table, and rows are not shuffled.
    """
    ordered = vocabulary.agg(F.array_sort(F.collect_list(F.struct("tag_index", "tag"))).alias("v"))
    df = df.withColumn("_vocab", ordered.scalar())
    hot = let(F.col(tags), lambda own: F.transform(
        "_vocab", lambda v: F.when(F.array_contains(own, v["tag"]), 1).otherwise(0)))
    return df.select(*keys, hot.cast("array<float>").alias("vector"))


def language_profile(df: DataFrame, declared: str, detected: str) -> DataFrame:
    """Counts and shares of detected languages per declared value."""
    counts = df.groupBy(declared, detected).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(declared)), 6))


def intent_auto_tags(df: DataFrame, intent: str = "intent") -> DataFrame:
    """Add the default tags of the row's intent (a six-row table, as an expression)."""
    out = F.array().cast("array<string>")
    for name, tags in T.INTENT_TAGS:
        listed = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
        out = F.when(F.col(intent) == name, listed).otherwise(out)
    return df.withColumn("auto_tags", out)


def _pieces(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters: a look-ahead that takes no character matches at each place, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def keyword_index(rules: DataFrame, official: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """(piece, keyword, tag) of a rule table of any size, written to the shared folder: one rare piece for each keyword.

    ``rules`` has (keyword, tag), ``official`` the tags that may be given, whose spelling is used; ``language:`` rules are
    left out.  How rare a piece is comes from the first SAMPLE_TEXTS texts at hand, and matters for speed alone.
    A keyword shorter than all PIECES is its own piece; an empty one is in no text.
    """
    names = official.select(F.lower("tag").alias("low"), "tag").groupBy("low").agg(F.max("tag").alias("tag"))
    known = rules.where(F.length("keyword") > 0).select("keyword", F.lower("tag").alias("low")).where(
        ~F.col("low").startswith(T.LANGUAGE_PREFIX)).join(names, "low").select("keyword", "tag").distinct()
    pieces = F.array("keyword")
    for size in sorted(PIECES):
        pieces = F.when(F.length("keyword") >= size, _pieces(F.col("keyword"), size)).otherwise(pieces)
    each = known.select("keyword", F.explode(pieces).alias("piece")).distinct()
    sample = texts.select(F.lower(text).alias("t")).limit(SAMPLE_TEXTS)
    seen = sample.select(F.explode(F.concat(*[_pieces(F.col("t"), n) for n in PIECES])).alias("piece")).groupBy("piece").count()
    rarest = each.join(seen, "piece", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "piece"))["piece"].alias("piece"))
    return materialise(rarest.join(known, "keyword").select("piece", "keyword", "tag"), "keyword-index")


def indexed_tags(texts: DataFrame, index: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, tag): the distinct tags with a keyword inside the lower-cased text, by a ``keyword_index``.

    The distinct pieces of a text probe the index; a piece brings the keywords that have it as their rare one, and these
    alone are looked for in the text.  An index of at most INDEX_BYTES is broadcast, so a keyword is looked for where its
    text lies and only tags that were found leave the scan's partition; a larger one meets the pieces in a shuffle, and the keywords
    their texts in another.  No expression grows with the rules.  Rows without a text have no tags; rows that repeat ``keys`` are one text.
    """
    low = texts.select(*keys, F.lower(text).alias("_low"))
    held = index.agg(F.sort_array(F.collect_set(F.length("piece"))).alias("sizes"),
                     F.sum(F.octet_length("piece") + F.octet_length("keyword") + F.octet_length("tag")).alias("bytes")).first()
    probes = F.concat(F.array().cast("array<string>"), *[_pieces(F.col("_low"), n) for n in held.sizes])
    inside = F.col("_low").contains(F.col("keyword"))
    # an outer generator: no filter below it cuts the pieces a second time
    if (held.bytes or 0) <= INDEX_BYTES:
        pieces = low.select(*keys, "_low", F.explode_outer(probes).alias("piece"))
        return pieces.join(F.broadcast(index), "piece").where(inside).select(*keys, "tag").distinct()
    found = low.select(*keys, F.explode_outer(probes).alias("piece")).join(index, "piece").select(*keys, "keyword", "tag").distinct()
    return low.join(found, keys).where(inside).select(*keys, "tag").distinct()


def official_tags(sheet: DataFrame, tag: str, order: str) -> DataFrame:
    """Tag dimension: trimmed non-blank names, one official spelling per lower-case
    name; of several spellings the one that first appears last wins."""
    rows = sheet.select(F.regexp_replace(tag, r"(?U)^\s+|\s+\z", "").alias("tag"), order).where(F.col("tag") != "")
    spelled = rows.groupBy("tag").agg(F.min(order).alias("_first"))
    return spelled.groupBy(F.lower("tag").alias("tag_lower")).agg(F.max_by("tag", "_first").alias("tag"))
