"""The prefix trie of conversations, rolled up by pointer jumping.

Turns are ordered by range partitions and numbered across them, so a
conversation of any length is shared by tasks. A node's key is a digest of its
sequence of turns: the sum, in two lanes of 60 bits, of a hash of each turn and
its place. Sums need no order, so the running sum over a long conversation is
made of blocks of _BLOCK turns and the sums of the blocks before. Nodes are one
grouping of all (conversation, depth) by that key, with the key one turn shorter
as the edge to the parent.

Leaves and savings go up by doubling: in round k a node's pointer leads to its
ancestor 2^k above, and its values are those of its subtree down to 2^k - 1
below. Values are summed by pointer into that ancestor, then pointers jump to
their pointer's pointer; only nodes deeper than 2^k take part. So as many rounds
are run as the depth has binary digits, and each is one grouping and two joins.

Ids of the conversations that end at a node are joined to text in stretches of
_IDS values; where a node has several, they are hashed in order as they stream
through a task, which holds a batch of them.

Defined cases: null turns come first, equal turns of a conversation are taken by
role, then text, in code point order, and repeated rows each count; a null role
or text is empty; rows of null conv_id belong to no conversation; a turnless
rebuilt conversation ends at the root; turn numbers may have gaps and be
negative; very long texts are hashed whole; an empty table gives an empty
result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small

#: A conversation takes up to HEADS - 1 turns of the one at the last multiple of FAMILY.
HEADS, FAMILY = 6, 100
_BLOCK, _IDS = 4096, 4096
_ORDER = ["conv_id", "turn", "role", "text", "_tie"]
_NUM = "decimal(38,0)"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, hash, chars, n): each turn's place in its conversation from
    0, the hash of role and text, the text's code points, and the conversation's
    number of turns."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"), F.monotonically_increasing_id().alias("_tie"))
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.select("conv_id", F.sha2(content, 256).alias("hash"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("id")), "trie-turns")
    part = F.shiftright("id", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranks = placed.withColumn("part", part).join(F.broadcast(shifts), "part").withColumn("rank", F.col("shift") + F.col("id").bitwiseAND((1 << 33) - 1))
    convs = materialize(ranks.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "trie-conversations")
    return ranks.join(convs, "conv_id").select("conv_id", (F.col("rank") - F.col("first")).alias("at"), "hash", "chars", "n")


def rebuilt(turns: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """(conv_id, depth, hash, chars, ends): turns from `numbered` as the rebuilt
    conversations have them, and a row of depth 0 for each; ends marks the last."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    convs = turns.filter("at = 0").select("conv_id", "n", head, (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    opening = materialize(turns.filter(F.col("at") < heads - 1), "trie-openings")
    bases = opening.filter("at = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = materialize(known.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "taken", "size"), "trie-plans")
    last = (F.col("depth") == F.col("size")).alias("ends")
    root = known.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("hash"), F.lit(0).cast("long").alias("chars"), "size")
    lent = opening.select(F.col("conv_id").alias("base"), "at", "hash", "chars").join(known.filter("taken > 0"), "base").filter(F.col("at") < F.col("taken"))
    own = turns.drop("n").join(known, "conv_id").filter(F.col("at") >= F.col("h"))
    kinds = [root, lent.withColumn("depth", F.col("at") + 1), own.withColumn("depth", F.col("taken") + F.col("at") - F.col("h") + 1)]
    return reduce(DataFrame.unionByName, [k.select("conv_id", "depth", "hash", "chars", "size") for k in kinds]).select("conv_id", "depth", "hash", "chars", last)


def _key(a: Column, b: Column, depth: Column) -> Column:
    return F.substr(F.sha2(F.concat_ws(",", depth.cast("string"), a.cast("string"), b.cast("string")), 256), F.lit(1), F.lit(32))


def keyed(steps: DataFrame) -> DataFrame:
    """steps with ``node`` and ``parent`` (null at the root) instead of hash."""
    salted = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "hash"), 256)
    lane = lambda i: F.when(F.col("depth") == 0, 0).otherwise(F.conv(F.substr("_s", F.lit(15 * i + 1), F.lit(15)), 16, 10).cast(_NUM)).cast(_NUM)
    held = materialize(steps.withColumn("_s", salted).withColumns({"a": lane(0), "b": lane(1), "block": F.floor(F.col("depth") / _BLOCK).cast("long")}).drop("_s", "hash"), "trie-steps")
    # Blocks before a block; conversations within one block have none.
    long_ones = held.filter("block > 0").select("conv_id").distinct()
    sums = held.join(small(materialize(long_ones, "trie-long")), "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.sum("a").cast(_NUM).alias("a0"), F.sum("b").cast(_NUM).alias("b0"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(materialize(sums.select("conv_id", "block", F.sum("a0").over(before).cast(_NUM).alias("a0"), F.sum("b0").over(before).cast(_NUM).alias("b0")).filter("a0 is not null"), "trie-offsets"))
    run = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sofar = held.join(offsets, ["conv_id", "block"], "left")
    total = lambda c: (F.sum(c).over(run) + F.coalesce(F.col(c + "0"), F.lit(0).cast(_NUM))).cast(_NUM)
    summed = sofar.select("conv_id", "depth", "chars", "ends", "a", "b", total("a").alias("x"), total("b").alias("y"))
    return summed.select("conv_id", "depth", "chars", "ends", _key(F.col("x"), F.col("y"), F.col("depth")).alias("node"), F.when(F.col("depth") > 0, _key(F.col("x") - F.col("a"), F.col("y") - F.col("b"), F.col("depth") - 1)).alias("parent"))


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(node, conv_id) of conversations, each in one row -> (node, ends_sha256):
    of their ids in ascending order, joined by commas."""
    stretch = F.floor(F.col("conv_id") / _IDS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = materialize(ends.groupBy("node", stretch.alias("stretch")).agg(ids.alias("ids")), "trie-ends")
    many = materialize(texts.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "trie-long-ends")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        out = lambda: pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == node:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    yield out()
                node, state = key, hashlib.sha256(ids.encode())
        if state:
            yield out()

    held = small(many.select("node"))
    single = texts.join(held, "node", "left_anti").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    streamed = texts.join(held, "node", "left_semi").repartition("node").sortWithinPartitions("node", "stretch").select("node", "ids")
    return single.unionByName(streamed.mapInArrow(hashed, "node string, ends_sha256 string"))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """nodes with node, parent, depth, leaves and saved -> (node, n_leaves,
    saved_tokens) summed over subtrees, in one round for each binary digit of the
    depth."""
    values = ["leaves", "saved"]
    live = materialize(nodes.filter("depth > 0").select("node", "depth", F.col("parent").alias("up"), *values), "trie-live-1")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    gains = [nodes.select("node", *values)]
    reach = 1
    while reach <= deepest:
        gain = materialize(live.groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(v) for v in values]), f"trie-gain-{reach}")
        gains.append(gain)
        if 2 * reach <= deepest:
            deeper = live.filter(F.col("depth") >= 2 * reach)
            more = gain.select("node", *[F.col(v).alias(f"more_{v}") for v in values])
            jumps = live.select(F.col("node").alias("up"), F.col("up").alias("next"))
            grown = deeper.join(more, "node", "left").join(jumps, "up")
            after = materialize(grown.select("node", "depth", F.col("next").alias("up"), *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]), f"trie-live-{2 * reach}")
            discard(live)
            live = after
        reach *= 2
    return reduce(DataFrame.unionByName, gains).groupBy("node").agg(F.sum("leaves").cast("long").alias("n_leaves"), F.sum("saved").cast("long").alias("saved_tokens"))


def trie(conversations: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 for each node."""
    steps = materialize(keyed(rebuilt(materialize(numbered(conversations), "trie-numbered"), heads, family)), "trie-keyed")
    nodes = materialize(steps.groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "trie-nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = materialize(known.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "trie-known")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = known.join(rolled_up(known), "node").join(ends_hashes(steps.filter("ends").select("node", "conv_id")), "node", "left").join(parents, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
