"""Prefix tries of conversations as double arrays.

A node is a distinct sequence of first turns; conversations that begin with it are its members.  Turns become
digests of (role, text) in the scan, so texts are never moved, and a prefix is told by the xor
of the digests of its (place, turn) pairs, 128 bits that can be summed over blocks of turns: no task sorts a whole conversation.

1. Nodes with more than ``SHARD_TURNS`` turns at or below them, and the root, are *upper* nodes.
   The subtrees right below them are whole in one prefix shard, many small ones in each.
2. A shard numbers its distinct turns densely and packs its trie into BASE and CHECK: the child of node s by turn
   x is slot BASE[s] + x if CHECK there is s.  Its sequences traverse the arrays, all of them one turn a step; the slots gather
   members, children, leaves, ends and what sharing saves.
3. Upper nodes, which many shards share, are merged globally by key: members from partial counts, children and sums
   below from the shards' subtrees, then sums over upper nodes by pointer doubling in log2(depth) rounds.  Copies of one
   conversation, however many, make upper nodes and meet as counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.session import materialise

#: Turns that a shard is made for.
SHARD_TURNS = 1 << 16
#: Turns of a conversation that are put in order at a time, and ids of one piece of a list of ends.
BLOCK = 4096
#: Places that are tried for the children of a node before they go behind the last slot.
TRIES = 64
KEY = ["p1", "p2"]


def digest_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, chars) of the rows with a conv_id: 128 bits tell (role, text), nulls are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), F.length(role), role, text).alias("t1"), F.xxhash64(F.lit(2), text, role, F.length(role)).alias("t2"),
        F.length(text).cast("long").alias("chars"))


def number_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``turns`` with ``pos`` in place of ``turn``, conversations with their number of turns ``n``).

    ``pos`` is the place from 0 in the order of turns, null first; equal ones by digest.  Turns are ranked inside
    (conversation, BLOCK turn numbers); only conversations over several blocks need the counts of the blocks before.
    """
    dealt = turns.withColumn("b", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = W.partitionBy("conv_id", "b").orderBy(F.asc_nulls_first("turn"), "t1", "t2")
    ranked = materialise(dealt.withColumn("pos", (F.row_number().over(inside) - 1).cast("long")).drop("turn"), "trie-turns")
    sizes = materialise(ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi")), "trie-sizes")
    blocks = ranked.join(sizes.where("lo < hi").select("conv_id"), "conv_id", "left_semi").groupBy("conv_id", "b").agg(F.count(F.lit(1)).alias("k"))
    before = W.partitionBy("conv_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialise(blocks.select("conv_id", "b", F.sum("k").over(before).alias("offset")).where("offset > 0"), "trie-offsets")
    placed = ranked.join(offsets, ["conv_id", "b"], "left").withColumn("pos", F.col("pos") + F.coalesce("offset", F.lit(0)))
    return placed.select("conv_id", "pos", "t1", "t2", "chars"), sizes.select("conv_id", "n")


def with_prefixes(turns: DataFrame) -> DataFrame:
    """Add the key (p1, p2) of the prefix that ends with each turn, that of its parent (q1, q2), and the turns ``left`` from it on.

    Blocks of turns are summed by themselves; only conversations over several blocks need the sums of the blocks before.
    """
    keyed = turns.withColumns({"h1": F.xxhash64(F.lit(3), "pos", "t1", "t2"), "h2": F.xxhash64(F.lit(4), "t2", "t1", "pos"),
                               "b": F.floor(F.col("pos") / BLOCK)})
    block = W.partitionBy("conv_id", "b").orderBy("pos")
    upto, from_ = block.rowsBetween(W.unboundedPreceding, W.currentRow), block.rowsBetween(W.currentRow, W.unboundedFollowing)
    inside = materialise(keyed.withColumns({
        "p1": F.bit_xor("h1").over(upto), "p2": F.bit_xor("h2").over(upto), "left": F.count(F.lit(1)).over(from_)}), "trie-blocks")
    # conversations with a second block: their length, and for each block what the full blocks before it sum to
    lengths = inside.where((F.col("pos") >= BLOCK) & (F.col("pos") % BLOCK == 0)).groupBy("conv_id").agg(F.max(F.col("pos") + F.col("left")).alias("len"))
    so_far = W.partitionBy("conv_id").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
    full = inside.where(F.col("pos") % BLOCK == BLOCK - 1).select(
        "conv_id", (F.col("b") + 1).alias("b"), *[F.bit_xor(f"p{i}").over(so_far).alias(f"o{i}") for i in (1, 2)])
    zero = F.lit(0).cast("long")
    behind = full.join(lengths, "conv_id").union(lengths.select("conv_id", zero, zero, zero, "len"))
    behind = materialise(behind.toDF("conv_id", "b", "o1", "o2", "len"), "trie-behind")
    both = inside.join(behind, ["conv_id", "b"], "left")
    p = {i: F.col(f"p{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0))) for i in (1, 2)}
    return both.select("conv_id", "pos", "t1", "t2", "chars", F.coalesce(F.col("len") - F.col("pos"), "left").alias("left"),
                       *[p[i].alias(f"p{i}") for i in (1, 2)], *[p[i].bitwiseXOR(F.col(f"h{i}")).alias(f"q{i}") for i in (1, 2)])


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, comma-joined, as they stream by: a list of any length needs no memory."""
    key, digest = None, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for p1, p2, piece in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "piece"))):
            if (p1, p2) == key:
                digest.update(b"," + piece.encode())
            else:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (p1, p2), hashlib.sha256(piece.encode())
        yield _ends_batch(out)
    if key is not None:
        yield _ends_batch([(*key, digest.hexdigest())])


def _ends_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], schema=schema)


def ends_of(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256): the digest of the conv_ids that end at each prefix, ascending and comma-joined."""
    pieces = ends.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("at")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = pieces.select(*KEY, "at", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("piece"))
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "at").select(*KEY, "piece").mapInArrow(
        _digest_ends, "p1 long, p2 long, ends_sha256 string")


class DoubleArray:
    """A trie over dense labels, packed while it is built level by level; slot 0 is the root.

    ``check`` holds the parent's slot (-1: free), ``base`` what is added to a label to find the child's slot.
    """

    def __init__(self, labels: int):
        size = 2 * labels + 16
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.check[0] = 0
        self._next = list(range(size + 1))  # the first free slot from here on, by path halving
        self._next[0] = 1
        self.end = 1

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self._next += range(len(self._next), len(self._next) + more)

    def _free(self, at: int) -> int:
        follow = self._next
        while follow[at] != at:
            follow[at] = follow[follow[at]]
            at = follow[at]
        return at

    def place(self, slot: int, labels: list[int]) -> None:
        """Give ``slot`` the children ``labels`` (ascending): the first base at which all their slots are free."""
        low, high = labels[0], labels[-1]
        self._grow(max(self.end, low + 1) + high + 2)
        at = self._free(low + 1)
        for _ in range(TRIES):
            self._grow(at - low + high + 2)
            if len(labels) == 1 or all(self.check[at - low + x] < 0 for x in labels):
                break
            at = self._free(at + 1)
        else:
            at = max(self.end, low + 1)
            self._grow(at - low + high + 2)
        self.base[slot] = at - low
        for x in labels:
            self.check[at - low + x] = slot
            self._next[at - low + x] = at - low + x + 1
        self.end = max(self.end, at - low + high + 1)

    def step(self, slots: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The children of ``slots`` by ``labels``, which must be there."""
        to = self.base[slots] + labels
        if not (self.check[to] == slots).all():
            raise ValueError("no such child")
        return to


def build(sequences: np.ndarray, starts: np.ndarray, ends: np.ndarray, labels: int) -> tuple[DoubleArray, np.ndarray]:
    """The trie of the sequences [starts, ends) of ``sequences``, and the slot that each of their turns reaches."""
    trie = DoubleArray(labels)
    reached = np.zeros(len(sequences), np.int64)
    live, slots, depth = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0
    while True:
        more = starts[live] + depth < ends[live]
        live, slots = live[more], slots[more]
        if not len(live):
            return trie, reached
        label = sequences[starts[live] + depth]
        edges = np.unique(np.stack([slots, label]), axis=1)
        cuts = np.flatnonzero(np.diff(edges[0])) + 1
        groups = sorted(((len(part), int(edges[0][lo]), part.tolist()) for lo, part in zip(
            np.concatenate([[0], cuts]), np.split(edges[1], cuts))), reverse=True)
        for _, slot, children in groups:
            trie.place(slot, children)
        slots = trie.step(slots, label)
        reached[starts[live] + depth] = slots
        depth += 1


NODE = ("q1 long, q2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "top boolean, ends_sha256 string")
_SCHEMA = pa.schema([(n, {"top": pa.bool_(), "ends_sha256": pa.string()}.get(n, pa.int64())) for n in [x.split()[0] for x in NODE.split(", ")]])
NOTHING = hashlib.sha256(b"").hexdigest()


def _shard_nodes(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """All nodes of one shard; ``rows`` are its sequences' turns by (conv_id, pos)."""
    conv = rows["conv_id"]
    first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    last = np.concatenate([first[1:], [len(conv)]])
    seq = np.repeat(np.arange(len(first)), last - first)
    # the first turn of a sequence here is told with all the turns before it: subtrees of several parents lie side by side
    begins = np.zeros(len(conv), bool)
    begins[first] = True
    pairs = np.stack([np.where(begins, rows["p1"], rows["t1"]), np.where(begins, rows["p2"], rows["t2"])])
    order = np.lexsort((pairs[1], pairs[0], begins))
    fresh = np.concatenate([[True], (np.diff(pairs[:, order]) != 0).any(axis=0) | np.diff(begins[order])])
    dense = np.empty(len(conv), np.int64)
    dense[order] = np.cumsum(fresh) - 1
    trie, slot = build(dense, first, last, int(fresh.sum()))
    size = len(trie.base)
    n_convs, smallest = np.bincount(slot, minlength=size), np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(smallest, slot, conv)
    # one row that reached each slot names it
    nodes, named = np.unique(slot, return_index=True)
    depth = np.zeros(size, np.int64)
    depth[nodes] = rows["pos"][named] + 1
    level = np.zeros(size, np.int64)
    level[nodes] = named - first[seq[named]] + 1
    parent = trie.check[nodes]
    children = np.bincount(parent, minlength=size)
    leaves = np.zeros(size, np.int64)
    leaves[nodes] = children[nodes] == 0
    saved = np.zeros(size, np.int64)
    saved[nodes] = (n_convs[nodes] - 1) * rows["chars"][named]
    by_level = nodes[np.argsort(-level[nodes], kind="stable")]
    cuts = np.flatnonzero(np.diff(level[by_level])) + 1
    for part in np.split(by_level, cuts):  # from the deepest level up
        up = trie.check[part]
        np.add.at(leaves, up, np.where(up > 0, leaves[part], 0))
        np.add.at(saved, up, np.where(up > 0, saved[part], 0))
    # conversations that end at each slot; they come in ascending order
    ends: dict[int, list[str]] = {}
    for at, c in zip(slot[last - 1].tolist(), conv[first].tolist()):
        ends.setdefault(at, []).append(str(c))
    digests = [hashlib.sha256(",".join(ends[at]).encode()).hexdigest() if at in ends else NOTHING for at in nodes.tolist()]
    top = parent == 0
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (rows["q1"][named], rows["q2"][named], depth[nodes], smallest[nodes])]
        + [pa.array(smallest[parent], pa.int64(), mask=top)]
        + [pa.array(x) for x in (n_convs[nodes], children[nodes], leaves[nodes], saved[nodes], top)] + [pa.array(digests, pa.string())], schema=_SCHEMA)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard after the other: rows come by (shard, conv_id, pos)."""
    held: list[pa.RecordBatch] = []

    def finish() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        held.clear()
        return _shard_nodes({c: whole.column(c).to_numpy() for c in whole.column_names if c != "shard"})

    now = None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            if held and shard[a] != now:
                yield finish()
            now = shard[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield finish()


def _sums_below(upper: DataFrame) -> DataFrame:
    """Add to ``leaves`` and ``saved`` of each upper node those of all upper nodes below it.

    After k rounds a node holds the sums of the nodes fewer than 2^k levels below it and the key of its ancestor 2^k levels up.
    """
    state = upper.select(*KEY, F.col("q1").alias("a1"), F.col("q2").alias("a2"), "leaves", "saved")
    while not state.where("a1 IS NOT NULL").isEmpty():
        given = state.where("a1 IS NOT NULL").groupBy("a1", "a2").agg(F.sum("leaves").alias("more"), F.sum("saved").alias("extra")).select(
            F.col("a1").alias("p1"), F.col("a2").alias("p2"), "more", "extra")
        above = state.select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        state = materialise(state.join(given, KEY, "left").join(above, ["a1", "a2"], "left").select(
            *KEY, F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("extra", F.lit(0))).alias("saved")), "trie-upper")
    return state.select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie_nodes(turns: DataFrame, turnless: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``turns`` has (conv_id, pos, t1, t2, chars), see ``digest_turns``, with the places 0, 1, ... of each conversation;
    ``turnless`` the conv_id of each conversation without turns, which are members of the root.  conv_id is a
    node's smallest member and names it together with its depth.  Without conversations there is no node, not even the root.
    """
    rows = with_prefixes(turns)
    heavy = materialise(rows.groupBy(*KEY).agg(F.sum("left").alias("w")).where(F.col("w") > shard_turns).select(*KEY), "trie-heavy")
    zero = F.lit(0).cast("long")
    above = heavy.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    below = rows.join(heavy, KEY, "left_anti")
    tops = below.join(above.union(above.sparkSession.range(1).select(zero.alias("q1"), zero.alias("q2"))), ["q1", "q2"], "left_semi").select(
        "conv_id", F.col("p1").alias("r1"), F.col("p2").alias("r2"))
    shards = rows.count() // shard_turns + 1
    dealt = below.join(tops, "conv_id").select(
        F.pmod(F.xxhash64("r1", "r2"), F.lit(shards)).alias("shard"), "conv_id", "pos", "t1", "t2", "chars", *KEY, "q1", "q2")
    lower = materialise(dealt.repartition(min(shards, 1 << 16), "shard").sortWithinPartitions("shard", "conv_id", "pos").mapInArrow(_shards, NODE), "trie-nodes")
    # upper nodes are merged from all turns that reach them, the root from all conversations
    none = F.lit(None).cast("long")
    shared = rows.join(heavy, KEY, "left_semi")
    counted = shared.groupBy(*KEY, "q1", "q2", "pos", "chars").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).select(
        *KEY, "q1", "q2", (F.col("pos") + 1).alias("depth"), "conv_id", "n_convs", "chars")
    root = rows.where("pos = 0").select("conv_id").union(turnless.select("conv_id")).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("chars"))
    ends = ends_of(shared.where("left = 1").select("conv_id", *KEY).union(turnless.select("conv_id", zero, zero)))
    upper = materialise(counted.union(root).join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "trie-upper")
    children = lower.where("top").select("q1", "q2", "n_leaves", "saved_tokens").union(
        upper.where("q1 IS NOT NULL").select("q1", "q2", zero, zero)).groupBy("q1", "q2").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).select(
        F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_children", "l", "s")
    own = materialise(upper.join(children, KEY, "left").select(
        *KEY, "q1", "q2", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "ends_sha256",
        F.coalesce("l", F.lit(1)).alias("leaves"), (F.coalesce("s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-upper")
    parents = own.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    summed = own.drop("leaves", "saved").join(_sums_below(own), KEY)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    joints = lower.where("top").drop("parent_conv_id").unionByName(summed.withColumn("top", F.lit(True)).drop(*KEY))
    return joints.join(parents, ["q1", "q2"], "left").withColumnRenamed("parent", "parent_conv_id").select(*out).union(
        lower.where("NOT top").select(*out))


#: A rebuilt conversation takes a number of turns below this from the first conversation of its hundred.
HEADS, HUNDRED = 6, 100


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, turnless) for ``trie_nodes`` of the rebuilt conversations.

    Conversation c gets the first h turns of conversation c - c % 100 (all if it has fewer, none if it is absent), then its own behind its
    first h; h = crc32(decimal c) % 6.  Rows with a null conv_id are left out; rows that repeat are turns of their own; turns
    with equal or null numbers come in the order of their digests.
    """
    own, sizes = number_turns(digest_turns(conversations))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    known = materialise(sizes.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.least("n", F.lit(HEADS - 1)).alias("n_base")), "trie-bases")
    k = F.least("h", F.coalesce("n_base", F.lit(0)))
    ids = sizes.select("conv_id", "n", base.alias("base"), h.alias("h")).join(known, "base", "left").withColumn("k", k)
    behind = own.withColumns({"base": base, "h": h}).where("pos >= h").join(known, "base", "left").select(
        "conv_id", (F.col("pos") - F.col("h") + k).alias("pos"), "t1", "t2", "chars")
    heads = materialise(own.where((F.col("conv_id") % HUNDRED == 0) & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv_id", "base"), "trie-heads")
    taken = ids.where("k > 0").select("conv_id", "base", "k").join(heads, "base").where("pos < k").select("conv_id", "pos", "t1", "t2", "chars")
    return behind.union(taken), ids.where("k = 0 AND n <= h").select("conv_id")
