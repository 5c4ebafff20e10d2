"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

A turn is known by the SHA-256 of its role and text, so texts are read once and never moved. A
prefix is known by running sums of the hashes of (position, turn), which are added up slice by
slice: a conversation may hold any share of the rows. Nodes are the different prefixes. Totals
over subtrees come from contracting the tree in join rounds: a round rakes all leaves into their
parents, then splices an independent set of nodes with one child out of their chains; so star and
chain alike are gone after a number of rounds logarithmic in the nodes. Expanding the rounds in
reverse gives the total of every node that was spliced out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cuespan.llm.common import discard, lookup_join, materialize

#: Conversations that begin alike are numbered FAMILY by FAMILY; a conversation takes fewer than MOST turns from the first one.
FAMILY, MOST = 5, 9
#: Running sums of so many 32-bit hashes tell prefixes apart.
LANES = [f"_s{i}" for i in range(4)]


def running_totals(rows: DataFrame, part: str, order: list[str], values: list[str]) -> DataFrame:
    """Each value becomes its sum over the rows of `part` up to this one by `order`.

    Rows are dealt by ranges of (part, order), so a part is spread over as many tasks as its rows need;
    each task sums its own, and the sums of earlier ranges of the same part are added. Those are
    one row per range at most.
    """
    placed = materialize(rows.repartitionByRange(part, *order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(part, "_range").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(part, "_range", F.count("*").over(earlier).alias("_n"), *[F.sum(f"_{v}").over(earlier).alias(f"_{v}") for v in values])
    carried = F.broadcast(carried.where("_n > 0").drop("_n"))
    inside = Window.partitionBy(part, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(carried, [part, "_range"], "left")
    return out.select(*[c for c in rows.columns if c not in values], *[(F.sum(v).over(inside) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, *values) of a forest (node, parent, *values): each value summed over the node's subtree, itself included.

    Roots have a null parent. A node may have any number of children and a chain any length: children are
    summed before they are shuffled, and joins are on nodes only. Tables of a round are written to
    the shared folder, so a lost executor costs one round at most.
    """
    over = [f"_over_{v}" for v in values]  # what was spliced out between a node and its parent
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    live = tree.join(kids, "node", "left").select("node", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *values, *[F.lit(0).cast("bigint").alias(o) for o in over])
    live, rounds = materialize(live), []
    while True:
        leaves = live.where("kids = 0 and parent is not null").groupBy(F.col("parent").alias("node"))
        raked = leaves.agg(F.count("*").alias("_n"), *[F.sum(F.col(v) + F.col(o)).alias(f"_add_{v}") for v, o in zip(values, over)])
        grown = [(F.col(v) + F.coalesce(f"_add_{v}", F.lit(0))).alias(v) for v in values]
        left = materialize(live.where("kids > 0").join(raked, "node", "left").select("node", "parent", (F.col("kids") - F.coalesce("_n", F.lit(0))).alias("kids"), *grown, *over))
        if left.isEmpty():
            discard(left)
            rounds.append((live, None))
            break
        # Nodes of one child, none next to another: heads whose only child is not a head of one child.
        head = lambda node: F.pmod(F.xxhash64(node, F.lit(len(rounds))), F.lit(2)) == 1  # noqa: E731, B023
        only = left.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_n"), F.min(F.struct(F.col("node"), F.col("kids"), *over)).alias("_child")).where("_n = 1")
        chain = left.where((F.col("kids") == 1) & F.col("parent").isNotNull() & head(F.col("node"))).join(only, "node").where(~((F.col("_child.kids") == 1) & head(F.col("_child.node"))))
        added = {v: F.col(v) + F.col(f"_child.{o}") for v, o in zip(values, over)}
        spliced = materialize(chain.select("node", F.col("_child.node").alias("child"), "parent", *[a.alias(f"_add_{v}") for v, a in added.items()], *[(added[v] + F.col(o)).alias(o) for v, o in zip(values, over)]))
        moved = spliced.select(F.col("child").alias("node"), F.col("parent").alias("_parent"), *[F.col(o).alias(f"_new{o}") for o in over])
        rest = left.join(spliced.select("node"), "node", "left_anti").join(moved, "node", "left")
        rest = materialize(rest.select("node", F.coalesce("_parent", "parent").alias("parent"), "kids", *values, *[F.coalesce(f"_new{o}", o).alias(o) for o in over]))
        discard(left)
        rounds.append((live, spliced))
        live = rest
    totals = None
    for live, spliced in reversed(rounds):
        found = live.where("kids = 0").select("node", *values)
        if spliced is not None:
            below = totals.select(F.col("node").alias("child"), *[F.col(v).alias(f"_{v}") for v in values])
            fresh = spliced.join(below, "child").select("node", *[(F.col(f"_add_{v}") + F.col(f"_{v}")).alias(v) for v in values])
            found = found.union(totals).union(fresh)
        before, totals = totals, materialize(found)
        discard(live, *[t for t in (spliced, before) if t is not None])
    return totals


def joined_hashes(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the hash of each node's ids in ascending order, joined by commas.

    Ids are sorted by ranges of (node, id) and joined to strings of a batch of rows each; only those
    strings of a node come together, and are hashed one after another.
    """

    def join_ids(batches):
        for batch in batches:
            if batch.num_rows:
                node, ids = batch.column("node"), batch.column("conv_id")
                new = np.flatnonzero(np.append(True, [a != b for a, b in zip(node[1:].to_pylist(), node[:-1].to_pylist())]))
                text = [",".join(map(str, ids[lo:hi].to_pylist())) for lo, hi in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows])]
                at = pa.array(new)
                yield pa.RecordBatch.from_arrays([node.take(at), ids.take(at), pa.array(text, pa.string())], ["node", "low", "ids"])

    def hash_ids(batches):
        last, digest = None, None
        for batch in batches:
            nodes, sums = [], []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node == last:
                    digest.update(f",{ids}".encode())
                    continue
                if last is not None:
                    nodes.append(last)
                    sums.append(digest.hexdigest())
                last, digest = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sums, pa.string())], ["node", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])

    runs = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join_ids, "node binary, low long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "low").mapInArrow(hash_ids, "node binary, ends_sha256 string")


def node_key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[c.cast("string") for c in lanes]).cast("binary")))


def rebuilt_turns(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, at, turn, bytes) of the rebuilt conversations.

    `turns` are the original ones, numbered by `at` from 0, `convs` (conv_id, n, base, head) say how many turns a
    conversation has, which one it begins like, and for how many turns.
    """
    heads = convs.select("conv_id", F.col("base").alias("_base"), "head").join(turns.where(F.col("at") < MOST).withColumnRenamed("conv_id", "_base"), "_base")
    heads = heads.where("at < head").select("conv_id", "at", "turn", "bytes")
    # Own turns move up where the first conversation has fewer than `head`.
    first = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    moved = convs.join(first, "base", "left").withColumn("_up", F.expr("head - least(head, coalesce(_n, 0))"))
    moved = materialize(moved.where("_up > 0").select(F.col("conv_id").cast("string").alias("_conv"), "n", "_up"))
    own = turns.where(F.col("at") >= head_turns()).withColumn("_conv", F.col("conv_id").cast("string"))
    own = lookup_join(own, moved, "_conv", "n", "at")
    return heads.union(own.select("conv_id", (F.col("at") - F.coalesce("_up", F.lit(0))).alias("at"), "turn", "bytes"))


def head_turns() -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per different prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c has the first h turns of conversation c - c % 5 (the remainder has the sign of c), then its own after
    its first h; h is crc32(c as decimal text) % 9. Turns are in the order of `turn`, null first;
    those of the same turn in that of the SHA-256 of "length of role in bytes:role text". Null roles and
    texts are empty; a repeated row is a turn of its own. Rows without a conv_id belong to no
    conversation and are left out. The root has the depth 0, all conversations as members and a null
    parent_conv_id; a conversation without turns ends there. conv_id is the smallest member.
    saved_tokens sums (n_convs - 1) times the bytes of a node's last text over its subtree, n_leaves the childless
    nodes; both count the node itself. An empty table gives no rows; other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("order"), turn.alias("turn"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("at"),
    ).where("conv_id is not null")
    # Equal rows are apart by a number of their own; their order makes no difference.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    turns = running_totals(rows, "conv_id", ["order", "turn", "_row"], ["at"])
    turns = materialize(turns.select("conv_id", (F.col("at") - 1).alias("at"), "turn", "bytes"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = materialize(convs.select("conv_id", "n", F.expr(f"conv_id - conv_id % {FAMILY}").alias("base"), head_turns().alias("head")))

    rebuilt = rebuilt_turns(turns, convs)
    digest = F.sha2(F.concat(F.col("at").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("turn")), 256)
    rebuilt = rebuilt.select("conv_id", "at", "bytes", digest.alias("_hash"))
    lane = lambda i: F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("bigint")
    rebuilt = rebuilt.select("conv_id", "at", "bytes", *[lane(i).alias(s) for i, s in enumerate(LANES)], *[lane(i).alias(f"_own{i}") for i in range(len(LANES))])
    prefixes = running_totals(rebuilt, "conv_id", ["at"], LANES)
    lanes = [F.col(s) for s in LANES]
    prefixes = materialize(prefixes.select(
        "conv_id", (F.col("at") + 1).alias("depth"), "bytes", node_key(F.col("at") + 1, lanes).alias("node"),
        node_key(F.col("at"), [s - F.col(f"_own{i}") for i, s in enumerate(lanes)]).alias("parent"),
    ))

    root = node_key(F.lit(0), [F.lit(0)] * len(LANES))
    nodes = prefixes.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), F.any_value("parent").alias("parent"), F.any_value("bytes").alias("bytes"))
    top = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    top = top.select(root.alias("node"), "n_convs", "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("bytes"))
    nodes = materialize(nodes.union(top))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    weights = nodes.select("node", "parent", F.expr("bigint(n_children = 0)").alias("n_leaves"), F.expr("(n_convs - 1) * bytes").alias("saved_tokens"))
    totals = subtree_totals(weights, ["n_leaves", "saved_tokens"])
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("_last")).select("conv_id", "_last.node")
    ends = joined_hashes(convs.select("conv_id").join(last, "conv_id", "left").select(F.coalesce("node", root).alias("node"), "conv_id"))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_kids"))
    out = lookup_join(nodes, materialize(parents), "parent", "_kids", "node").drop("_kids")
    out = out.join(totals, "node").join(ends, "node", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
