"""Mix sources to target weights by a multivariate hypergeometric splitting tree.

Every source's rows are dealt by hash to blocks.  A source whose target is r
times its size gives floor(r) full passes over its blocks and a part of one
more.  A draw is one block in one pass.  The tree halves the output shards
again and again; at each node the draws of all sources are split between the
halves by an exact multivariate hypergeometric draw, so the leaves hold exact
quotas of every source.  Each source's draws, in an order permuted for each
pass, then fill the quotas one shard after another: no draw is used twice.
Inside a shard rows are ordered by a seeded hash.

Only counts of blocks and sources go through the tree.  Rows meet it in one
join on (source, block); the plan says for each block which passes take it, into
which shard, and up to which hash (for the one block of a source that is cut).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.common import SPACE
from parlance.session import materialise

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and the most that a source may give, in times its size.
SHARE, MOST = 1.5, 2.0
#: Rows of a block on average, at least; all sources together have some MAX_BLOCKS blocks at most, larger ones then.
BLOCK_ROWS, MAX_BLOCKS = 128, 1 << 20
SHARDS = 16
SEED = 7
ALL = (1 << 63) - 1


def words_of(text: str = "text") -> Column:
    """The number of words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long").alias("size")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, rows, source_size, target) from ``sizes`` (key, rows, source_size): one row a source.

    Sources in the order of their keys weigh ``weights``, repeating.  The level L of
    the solution is where sources with most * size / weight below L stop, and the others get weight * L.
    """
    one = W.partitionBy(F.lit(0))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(pattern, F.pmod(F.row_number().over(one.orderBy("key")) - 1, F.lit(len(weights)))))
    by_ratio = one.orderBy("ratio", "key")
    level = (
        ranked.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
        .withColumn("_stopped", F.coalesce(F.sum(most * F.col("source_size")).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(one))
        .withColumn("_level", (share * F.col("_all") - F.col("_stopped")) / F.col("_open"))
        # the first source that the level does not fill; later ones give lower levels
        .withColumn("level", F.max(F.when(F.col("_level") <= F.col("ratio"), F.col("_level"))).over(one))
    )
    cut = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), most * F.col("source_size")).otherwise(
        F.col("weight") * F.col("level"))
    return level.select("key", "rows", "source_size", cut.alias("target"))


def _steps(lo: Column, hi: Column, good: Column, bad: Column, draws: Column, start: Column, fold) -> Column:
    """Fold over k = lo..hi with the logarithm of the unnormalised probability of k."""

    def step(acc: Column, k: Column) -> Column:
        j = (k - 1).cast("double")
        ratio = F.log(((good - j) * (draws - j)) / (k * (bad - draws + k)))
        log_w = F.when(k == lo, F.lit(0.0)).otherwise(acc["log_w"] + ratio)
        return fold(acc, k, log_w)

    return F.aggregate(F.sequence(lo, hi), start, step)


def hypergeometric(good: Column, bad: Column, draws: Column, uniform: Column) -> Column:
    """An exact draw by inversion: how many of ``draws`` from good + bad items are good.

    One pass finds the logarithm of the sum of the probabilities, a second the
    point where their running sum passes ``uniform``; both take as many steps as there are outcomes.
    """
    lo, hi = F.greatest(F.lit(0).cast("long"), draws - bad), F.least(good, draws)

    def add(acc: Column, k: Column, log_w: Column) -> Column:
        top = F.greatest(acc["top"], log_w)
        return F.struct(log_w.alias("log_w"), top.alias("top"),
                        (acc["sum"] * F.exp(acc["top"] - top) + F.exp(log_w - top)).alias("sum"))

    zero = F.struct(F.lit(0.0).alias("log_w"), F.lit(-1e300).alias("top"), F.lit(0.0).alias("sum"))
    total = _steps(lo, hi, good, bad, draws, zero, add)

    def find(whole: Column) -> Column:
        goal = uniform * whole["sum"]

        def seek(acc: Column, k: Column, log_w: Column) -> Column:
            run = acc["run"] + F.exp(log_w - whole["top"])
            return F.struct(log_w.alias("log_w"), run.alias("run"),
                            F.when(acc["at"] >= 0, acc["at"]).when(run >= goal, k).otherwise(F.lit(-1).cast("long")).alias("at"))

        none = F.struct(F.lit(0.0).alias("log_w"), F.lit(0.0).alias("run"), F.lit(-1).cast("long").alias("at"))
        at = _steps(lo, hi, good, bad, draws, none, seek)["at"]
        return F.when(at < 0, hi).otherwise(at)

    return F.get(F.transform(F.array(total), find), F.lit(0))


def _unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def split_node(counts: Column, draws: Column, seed: Column) -> Column:
    """How many of each source's ``counts`` go left, ``draws`` in all: a multivariate hypergeometric draw."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    start = F.struct(total.alias("pop"), draws.cast("long").alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        rest = acc["pop"] - x["n"]
        got = hypergeometric(x["n"], rest, acc["left"], _unit(seed, x["key"]))
        return F.get(F.transform(F.array(got), lambda g: F.struct(
            rest.alias("pop"), (acc["left"] - g).alias("left"), F.concat(acc["out"], F.array(g)).alias("out"))), F.lit(0))

    return F.aggregate(counts, start, step)["out"]


def shard_quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(key, shard, n) from ``draws`` (key, n): leaves of the splitting tree; shards get equal numbers of draws, give or take one."""
    root = draws.groupBy().agg(F.sort_array(F.collect_list(F.struct("key", F.col("n").cast("long").alias("n")))).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    nodes = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), total.alias("total"), "counts")

    def room(a: Column, b: Column) -> Column:
        return F.floor(b * F.col("total") / shards) - F.floor(a * F.col("total") / shards)

    for _ in range(max(0, (shards - 1).bit_length())):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halved = nodes.withColumn("mid", mid).withColumn(
            "left", F.when(F.col("hi") - F.col("lo") > 1, split_node(F.col("counts"), room(F.col("lo"), F.col("mid")),
                                                                      F.xxhash64("lo", "hi", F.lit(seed)))))
        take = F.zip_with("counts", "left", lambda x, g: F.struct(x["key"].alias("key"), g.alias("n")))
        keep = F.zip_with("counts", "left", lambda x, g: F.struct(x["key"].alias("key"), (x["n"] - g).alias("n")))
        kids = F.when(F.col("left").isNull(), F.array(F.struct("lo", "hi", "counts"))).otherwise(F.array(
            F.struct("lo", F.col("mid").alias("hi"), take.alias("counts")), F.struct(F.col("mid").alias("lo"), "hi", keep.alias("counts"))))
        nodes = halved.select("total", F.explode(kids).alias("kid")).select("kid.lo", "kid.hi", "total", "kid.counts")
    return nodes.select(F.col("lo").alias("shard"), F.explode("counts").alias("c")).select("c.key", "shard", "c.n")


def row_columns(seed: int) -> list[Column]:
    """``_key``, ``_hash`` and ``size`` of a row; equal rows have equal hashes."""
    return [source_key(F.col("source")).alias("_key"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_hash"), words_of()]


def with_block(keyed: DataFrame, blocks: DataFrame) -> DataFrame:
    return keyed.join(blocks, "_key").withColumn("_block", F.pmod("_hash", F.col("blocks")))


def mix_plan(slim: DataFrame, shards: int, seed: int, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST):
    """(sources, plan): per source rows, size, target, blocks; per (source, block) the draws pass, shard and largest hash.

    ``slim`` has _key, _hash and size of every row.
    """
    sizes = slim.groupBy(F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    block = F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.sum("rows").over(W.partitionBy(F.lit(0))) / MAX_BLOCKS))
    sources = materialise(targets(sizes, weights, share, most).select(
        F.col("key").alias("_key"), "source_size", "target", F.ceil(F.col("rows") / block).cast("long").alias("blocks"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("full")), "mix-sources")
    blocked = with_block(slim, sources.select("_key", "blocks"))
    sized = blocked.groupBy("_key", "_block").agg(F.sum("size").alias("words"))
    in_part = W.partitionBy("_key").orderBy("_draw", "_block").rowsBetween(W.unboundedPreceding, -1)
    # the partial pass: its blocks in permuted order, with the words that are still to come at each
    part = (
        sized.join(sources, "_key")
        .withColumn("_draw", F.xxhash64("_block", "full", F.lit(seed)))
        .withColumn("_rest", F.col("target") - F.col("full") * F.col("source_size") - F.coalesce(F.sum("words").over(in_part), F.lit(0)))
    )
    part = materialise(part.where("_rest > 0.5").select("_key", "_block", "words", "full", "_draw", "_rest"), "mix-part")
    # the one block of a source that is cut: rows in hash order up to the quota
    in_block = W.partitionBy("_key", "_block").orderBy("_hash")
    cut = (
        blocked.join(part.where("_rest < words").select("_key", "_block", "_rest"), ["_key", "_block"])
        .withColumn("_before", F.sum("size").over(in_block) - F.col("size"))
        .where(F.col("_before") + F.col("size") / 2 <= F.col("_rest"))
        .groupBy("_key", "_block").agg(F.max("_hash").alias("cut"))
    )
    partial = part.join(cut, ["_key", "_block"], "left").select(
        "_key", "_block", F.col("full").cast("int").alias("pass"), "_draw",
        F.when(F.col("_rest") >= F.col("words"), F.lit(ALL)).otherwise(F.col("cut")).alias("upto")).where("upto IS NOT NULL")
    whole = sources.where("full > 0 AND blocks > 0").select(
        "_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_block"), "full").select(
        "_key", "_block", F.explode(F.expr("sequence(0, cast(full AS int) - 1)")).alias("pass")).select(
        "_key", "_block", "pass", F.xxhash64("_block", "pass", F.lit(seed)).alias("_draw"), F.lit(ALL).alias("upto"))
    draws = whole.unionByName(partial)
    ordered = W.partitionBy("_key").orderBy("pass", "_draw", "_block")
    draws = materialise(draws.withColumn("_at", F.row_number().over(ordered) - 1), "mix-draws")
    quotas = shard_quotas(draws.groupBy(F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("n")), shards, seed).where("n > 0")
    upto = F.sum("n").over(W.partitionBy("key").orderBy("shard"))
    # a source's draw number _at belongs to the last shard that starts at or before it
    starts = materialise(quotas.select(F.col("key").alias("_key"), "shard", (upto - F.col("n")).alias("_at")), "mix-quotas")
    line = W.partitionBy("_key").orderBy("_at", F.col("shard").isNull()).rowsBetween(W.unboundedPreceding, 0)
    placed = (
        draws.withColumn("shard", F.lit(None).cast("int")).unionByName(starts, allowMissingColumns=True)
        .withColumn("_shard", F.last("shard", True).over(line)).where("pass IS NOT NULL")
    )
    plan = placed.groupBy("_key", "_block").agg(F.sort_array(F.collect_list(F.struct("pass", F.col("_shard").alias("shard"), "upto"))).alias("draws"))
    return sources, materialise(plan, "mix-plan")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        most: float = MOST) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) mixed: each row as often as it is taken (0 to 2 times), with ``mix_pass``, ``mix_shard``, ``mix_order``.

    Write it partitioned by mix_shard and sorted by mix_order within.  Null sources are one source,
    the last; null texts have no words and go with their block; equal rows stay together.  Where no text has a
    word nothing is taken.  Own columns of the names added are replaced.  Runs on the same rows agree.
    """
    docs = docs.drop("mix_pass", "mix_shard", "mix_order")
    # a row travels as one value, so that none of its columns can meet one of the plan's
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_columns(seed))
    slim = materialise(keyed.select("_key", "_hash", "size"), "mix-rows")
    sources, plan = mix_plan(slim, shards, seed, weights, share, most)
    # the plan has MAX_BLOCKS rows and one more a source at most, so that texts need not be shuffled
    rows = with_block(keyed.select("_row", "_key", "_hash"), sources.select("_key", "blocks")).join(F.broadcast(plan), ["_key", "_block"])
    drawn = rows.withColumn("_draw", F.explode("draws")).where("_hash <= _draw.upto")
    return drawn.select("_row.*", F.col("_draw.pass").alias("mix_pass"), F.col("_draw.shard").alias("mix_shard"),
                        F.xxhash64("_hash", "_draw.pass", F.lit(seed + 1)).alias("mix_order"))


def write_mix(mixed: DataFrame, path: str) -> None:
    """Write what ``mix`` gives: one folder for each output shard, its rows shuffled by their order."""
    mixed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)


def mix_report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, passes, mix_shards) of every row of ``docs``: how often the mix takes it, in words,
    and the output shards that the splitting tree gives these copies to, by pass."""
    slim = materialise(docs.select("doc_id", *row_columns(seed)), "mix-rows")
    sources, plan = mix_plan(slim, shards, seed)
    rows = with_block(slim, sources.select("_key", "blocks", "source_size", "target")).join(plan, ["_key", "_block"], "left")
    own = F.coalesce(F.filter("draws", lambda d: F.col("_hash") <= d["upto"]), F.array().cast("array<struct<pass:int,shard:int,upto:bigint>>"))
    return rows.withColumn("_own", own).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("_own")).alias("taken"), F.size("_own").alias("passes"),
        F.array_join(F.transform("_own", lambda d: d["shard"].cast("string")), ",").alias("mix_shards"))
