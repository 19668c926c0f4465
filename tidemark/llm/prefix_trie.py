"""A trie of all prefixes of conversations, from partial tries that are merged by key.

Each partition turns its conversations, turn after turn, into nodes: a node's key is a running digest of its
turns, so equal prefixes have equal keys wherever they are met. Nodes are combined inside the partition
before they leave it. The partial tables are merged by node key in rounds, at most ``FAN`` partial rows of a node
at a time: members are summed, lists of ended conversations united. A list is held in blocks of neighbouring
ids, so a node at which a third of all conversations end has many bounded rows and no long one.
Sums over subtrees go bottom up by doubling: after round k a node holds the sums of the descendants
nearer than 2^k, and adds those its descendants at exactly that distance hold. The rounds grow with the
logarithm of the longest conversation.

Defined cases: turns are ordered by turn (null first), then role, then the SHA-256 of role and text; rows that
repeat are turns each. A null role or text counts as empty. Rows without a conversation id take no part. Without
a conversation there is no node, not even the root. ``forked`` divides negative ids as SQL does, towards zero.
Long conversations are read by one task in order, with constant state. Columns other than the named ones are
ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.folds import fold_groups
from tidemark.plans.shipping import ship
from tidemark.plans.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
#: Conversation ids of a block of an end list share all but this many bits.
BLOCK_BITS = 16
#: Partial rows of a node that a round of merging brings together, at most.
FAN = 32
#: Nodes and ends that a task combines before it passes them on.
HELD = 50_000
PARTIAL = "node binary, parent binary, depth int, words long, n long, least long, block long, ids array<long>"


def turn_keys(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns without their texts: conv, pos (from 1), key (digest of role and text), words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    return slim.select("conv", F.row_number().over(order).alias("pos"), "key", "words")


def forked(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``turn_keys`` rows of rebuilt conversations, and one row with pos 0 and no key for each conversation.

    Conversation c takes its first h turns from the first of its family (c - c % family), h = crc32(c) % most,
    and its own turns from then on. At most ``family`` conversations on either side of 0 share such a source.
    """
    numbered = stage(turns, "turns")
    convs = numbered.where("pos = 1").select("conv", (F.crc32(F.col("conv").cast("string")) % most).alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    first = numbered.where((F.col("pos") < most) & (F.col("conv") % family == 0)).select(F.col("conv").alias("base"), "pos", "key", "words")
    borrowed = convs.join(first, "base").where("pos <= h").select("conv", "pos", "key", "words")
    own = numbered.where(F.col("pos") > F.crc32(F.col("conv").cast("string")) % most)
    return borrowed.unionByName(own).unionByName(convs.select("conv", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words")))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the conversations that pass by, combined as far as ``HELD`` allows."""
    nodes: dict[bytes, list] = {}
    ends: dict[tuple[bytes, int], list[int]] = {}
    ended, conv, node, depth = 0, None, ROOT, 0
    names = ["node", "parent", "depth", "words", "n", "least", "block", "ids"]
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def made() -> pa.RecordBatch:
        rows = [(k, *v, None, None) for k, v in nodes.items()] + [(k, None, None, None, None, None, b, sorted(v)) for (k, b), v in ends.items()]
        nodes.clear()
        ends.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def seen(parent: bytes | None, words: int) -> None:
        known = nodes.get(node)
        if known is None:
            nodes[node] = [parent, depth, words, 1, conv]
        else:
            known[3] += 1
            known[4] = min(known[4], conv)

    for batch in batches:
        for c, key, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if c != conv:
                if conv is not None:
                    ends.setdefault((node, conv >> BLOCK_BITS), []).append(conv)
                    ended += 1
                conv, node, depth = c, ROOT, 0
                seen(None, 0)
            if key is not None:
                above, node, depth = node, hashlib.sha256(node + key).digest()[:16], depth + 1
                seen(above, words)
            if len(nodes) + ended >= HELD:
                yield made()
                ended = 0
    if conv is not None:
        ends.setdefault((node, conv >> BLOCK_BITS), []).append(conv)
    if nodes or ends:
        yield made()


def merged(partial: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and blocks of end lists, one row each, from partial tables (with ``part``, the task they are from)."""
    nodes, ends = partial.where("block is null"), partial.where("block is not null")
    tasks = (partial.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // FAN)
        of = (F.col("part") / FAN).cast("int").alias("part")
        nodes = nodes.groupBy("node", of).agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.sum("n").alias("n"), F.min("least").alias("least"))
        ends = ends.groupBy("node", "block", of).agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
        if tasks == 1:
            return stage(nodes.drop("part"), "trie-nodes"), stage(ends.drop("part"), "trie-ends")


def _hashed(state: list, ids: list[int]) -> list:
    text = ",".join(map(str, ids))
    state[0].update((("," if state[1] else "") + text).encode())
    state[1] = True
    return state


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ended conversations in order; a node's blocks pass by one after the other."""
    return fold_groups(ends, ["node"], ["block"], ["ids"], lambda: [hashlib.sha256(), False], _hashed, lambda state: [(state[0].hexdigest(),)], "ends_sha256 string")


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """node, leaves and saved of each node's subtree, from ``leaf`` and ``saving`` of the nodes themselves."""
    state = nodes.select("node", "depth", F.col("parent").alias("up"), F.col("leaf").alias("leaves"), F.col("saving").alias("saved"))
    reach = 1
    while reach <= deepest:
        below = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        sums = state.join(below, "node", "left").withColumn("leaves", F.col("leaves") + F.coalesce("more", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        sums = sums.select("node", "depth", "up", "leaves", "saved")
        # The ancestor twice as far up: none, the root (of which a third of all rows may be children), or looked up.
        far = sums.where(F.col("depth") > 2 * reach).join(state.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").withColumn("up", F.col("next")).drop("next")
        near = sums.where(F.col("depth") <= 2 * reach).withColumn("up", F.when(F.col("depth") == 2 * reach, F.lit(ROOT)))
        state = stage(near.unionByName(far.select(*near.columns)), "rollup")
        reach *= 2
    return state.select("node", "leaves", "saved")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row a node of the trie over ``paths`` (rows of ``turn_keys`` or ``forked``)."""
    ship(paths.sparkSession)
    ordered = paths.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "key", "words")
    partial = stage(ordered.mapInArrow(_partial, PARTIAL).withColumn("part", F.spark_partition_id()), "partial-tries")
    nodes, ends = merged(partial)
    top = nodes.agg(F.max("depth").alias("deepest"), F.min("least").alias("least")).first()
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = stage(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saving", (F.col("n") - 1) * F.col("words")), "trie")
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    shallow = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top["least"])).cast("long"))
    named = shallow.unionByName(nodes.where("depth > 1").join(above, "parent").select(*shallow.columns))
    whole = named.join(rolled_up(nodes, top["deepest"] or 0), "node").join(ends_digests(ends), "node", "left")
    return whole.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
