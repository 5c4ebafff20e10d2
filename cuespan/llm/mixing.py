"""Mixing sources to target weights from fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cuespan.llm.common import hash60, materialize, running_before
from cuespan.llm.sharding import stratum

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeated as often as needed.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Words of a text as BIGINT; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str, int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str, float]:
    """Words to take of each source: `share` of all words split by weight, no source above `most` times its words.

    What a source cannot take is shared again among the others by weight. Keys are strata, which
    sort as sources do with null ('n') last.
    """
    order = sorted(sizes, key=lambda s: (s == "n", s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


def draw_shards(quota: np.ndarray, slots: int, seed: int) -> Iterator[np.ndarray]:
    """Source counts of one output shard after another: multinomial draws by what is left of each quota.

    A draw beyond a quota is clipped and its surplus drawn again, so all shards together take
    exactly the quotas.
    """
    rng, left = np.random.default_rng(seed), quota.astype(np.int64).copy()
    while (total := int(left.sum())) > 0:
        want, count = min(slots, total), np.zeros_like(left)
        while (short := want - int(count.sum())) > 0:
            rest = left - count
            count = np.minimum(left, count + rng.multinomial(short, rest / rest.sum()))
        left -= count
        yield count


def permute(index: np.ndarray, size: np.ndarray, key: int) -> np.ndarray:
    """Pseudo-random permutation of 0..size-1 applied to `index`: a four-round Feistel network with cycle walking."""
    half = np.uint64(max(1, (int(size - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def once(x):
        a, b = x >> half, x & mask
        for r in range(4):
            z = (b + np.uint64((key * 4 + r) % (1 << 62))) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((z ^ (z >> np.uint64(32))) & mask)
        return (a << half) | b

    x = once(index.astype(np.uint64))
    while (out := x >= size).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


SLOT_SCHEMA = "_stratum string, shard long, slot long, block long, epoch long"


def drawn_slots(names: list[str], quota: np.ndarray, blocks: np.ndarray, slots: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: the slots of the output shards whose numbers it is given.

    A shard's draw depends on those before, so each task draws them all, which takes less than a
    second, and fills its own; no list of draws goes through the driver.
    """

    def expand(batches):
        wanted = {n for batch in batches for n in batch.column(0).to_pylist()}
        drawn = np.zeros(len(names), dtype=np.int64)
        for shard, count in enumerate(draw_shards(quota, slots, seed)):
            if not wanted:
                return
            if shard in wanted:
                wanted.discard(shard)
                starts, width = np.cumsum(count) - count, int(count.sum())
                for i in np.nonzero(count)[0]:
                    for lo in range(0, int(count[i]), 1 << 16):
                        n = min(int(count[i]) - lo, 1 << 16)
                        j = drawn[i] + np.arange(lo, lo + n, dtype=np.int64)
                        at = starts[i] + np.arange(lo, lo + n, dtype=np.int64)
                        yield pa.RecordBatch.from_pydict({
                            "_stratum": pa.repeat(pa.scalar(names[i]), n), "shard": np.full(n, shard),
                            "slot": permute(at, width, seed + 7919 * (shard + 1)),
                            "block": permute(j % blocks[i], blocks[i], seed + 104729 * (int(i) + 1)), "epoch": j // blocks[i],
                        })
            drawn += count

    return expand


def mix(docs: DataFrame, block: int = 64, seed: int = 42, slots: int = 4096, max_shards: int = 4096, weights=WEIGHTS, share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> dict[str, DataFrame]:
    """Mixes the sources: `slots` (the mixture), `pieces` (words of documents in blocks) and `documents`.

    The words of each source, its documents in a seeded random order, are cut into blocks of
    `block` words. Each output shard draws how many blocks it takes of each source; the j-th
    block drawn of a source with n blocks is number permutation(j mod n), so all blocks serve
    once before one serves twice. slots: _stratum, shard, slot, block, epoch. pieces: doc_id,
    _stratum, block, words (how many of its words the block holds), first (of its words).
    documents: doc_id, size, source_size, target, taken, source, one row per row of the input.

    A null source is a source of its own, last in order. Null, empty and blank texts have size 0
    and are never taken. A repeated row is a document of its own. The number of sources is taken
    for small: one row of totals each goes to the driver. An empty table gives empty results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), stratum(source_col).alias("_stratum"))
    base = materialize(rows.withColumn("_key", hash60(seed, "doc_id")))
    totals = {r["_stratum"]: r["n"] for r in base.groupBy("_stratum").agg(F.sum("size").alias("n")).collect()}
    goal = targets(totals, weights, share)
    names = [s for s in sorted(totals, key=lambda s: (s == "n", s))]
    blocks = np.array([-(-totals[s] // block) for s in names], dtype=np.int64)
    quota = np.array([min(2 * b, int(goal[s] / totals[s] * b + 0.5)) if b else 0 for s, b in zip(names, blocks)], dtype=np.int64)
    slots = max(slots, -(-int(quota.sum()) // max_shards))
    shards = -(-int(quota.sum()) // slots)
    mixture = spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInArrow(drawn_slots(names, quota, blocks, slots, seed), SLOT_SCHEMA)

    placed = running_before(base, "_stratum", "_key", ["doc_id", "size"], "size", "_start")
    filled = placed.where("size > 0").select(
        "doc_id", "source", "size", "_stratum", "_start",
        F.explode(F.expr(f"sequence(_start div {block}, (_start + size - 1) div {block})")).alias("block"),
    )
    pieces = filled.withColumn("first", F.greatest(F.lit(0), F.col("block") * block - F.col("_start")))
    pieces = pieces.withColumn("words", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("_start")) - F.col("first"))

    # Few numbers of shards become many slots and blocks, which Spark doesn't foresee: the join is told to merge, so that none goes through the driver.
    uses = mixture.groupBy("_stratum", "block").agg(F.count("*").alias("_uses")).hint("merge")
    taken = pieces.join(uses, ["_stratum", "block"], "left").groupBy("doc_id", "source", "size", "_stratum", "_start")
    taken = taken.agg(F.coalesce(F.sum(F.col("words") * F.col("_uses")), F.lit(0)).alias("taken"))
    taken = taken.select("doc_id", "source", "size", "_stratum", "taken")
    bare = base.where("size = 0").select("doc_id", "source", "size", "_stratum", F.lit(0).cast("bigint").alias("taken"))
    facts = spark.createDataFrame([(s, int(totals[s]), float(goal[s])) for s in names], "_stratum string, source_size long, target double")
    out = taken.union(bare).join(F.broadcast(facts), "_stratum")  # one row per source
    return {"slots": mixture, "pieces": pieces.select("doc_id", "_stratum", "block", "first", "words"), "documents": out.select("doc_id", "size", "source_size", "target", "taken", "source")}
