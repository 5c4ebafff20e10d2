"""Embedding near-deduplication by a pivot-permutation index.

A bounded sample of the vectors serves as reference points (pivots). Each vector is described by
its NEAREST nearest pivots in order. Inverted lists by label and pivot hold the vectors whose first
POSTED pivots name it; two vectors of a list are candidates when at least SHARED of their nearest
pivots agree, and count in the first list that both are in. Candidates are then verified by
cosine in double precision. Pivots grow with the square root of the vectors, so lists do too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuespan.llm.chunks import ragged
from cuespan.llm.common import components, hash60, materialize

#: Pivots: as many as PIVOT_RATE times the square root of the vectors, within bounds; the sample they come from has 16 times as many.
LEAST_PIVOTS, MOST_PIVOTS, PIVOT_RATE = 96, 2048, 0.4
#: Pivots that describe a vector, those it is posted under, and how many two vectors must share.
NEAREST, POSTED, SHARED = 6, 3, 3
#: Pivots have a cosine below this.
APART = 0.9
#: Rows of a list compared at a time; larger lists are split into pairs of blocks.
BLOCK = 512
TASK_ROWS = 1 << 14
COSINE = 0.98


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def usable(rows: DataFrame) -> DataFrame:
    """Rows of (vec_id, label, vector) that may link: a label, and a vector that is finite and not zero."""
    fine = F.expr("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)


def fit_pivots(rows: DataFrame, pivots: int | None = None, seed: int = 42) -> np.ndarray:
    """`pivots` vectors at most of the most frequent length, from a pseudo-random sample by id of 16 times as many.

    That sample is all the driver ever holds: 16 * MOST_PIVOTS vectors unless `pivots` says else. Vectors close to a pivot chosen before are passed
    over: a large group of copies would else bring many pivots whose order means nothing.
    """
    size = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return np.zeros((0, 0))
    pivots = pivots or int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PIVOT_RATE * size["n"] ** 0.5)))
    sample = rows.where(F.size("vector") == size["d"]).select("vector", hash60(seed, "vec_id").alias("k")).orderBy("k", "vector").limit(16 * pivots)
    vectors = unit_rows(np.array([r["vector"] for r in sample.collect()], np.float64))
    chosen: list[int] = []
    for i in range(len(vectors)):
        if len(chosen) < pivots and (not chosen or (vectors[chosen] @ vectors[i]).max() < APART):
            chosen.append(i)
    return vectors[chosen]


def postings(rows: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """(vec_id, label, pivots): the numbers of the vector's nearest pivots, nearest first.

    Vectors of another length than the pivots have -length alone, so they only meet their like.
    """
    own = rows.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most

    def run(batches):
        p = own.value
        for batch in batches:
            vectors = [v.as_py() for v in batch.column("vector")]
            near = [[-len(v)] for v in vectors]
            fit = [i for i, v in enumerate(vectors) if len(v) == p.shape[1]]
            if fit:
                x = unit_rows(np.array([vectors[i] for i in fit], np.float64))
                order = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, : min(nearest, len(p))]
                for i, o in zip(fit, order.tolist()):
                    near[i] = o
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(near, pa.list_(pa.int64()))], ["vec_id", "label", "pivots"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, "vec_id long, label string, pivots array<long>")


def group_pairs(vectors: np.ndarray, near: np.ndarray, begin: np.ndarray, stop: np.ndarray, split: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within groups begin..stop that share enough of their pivots `near` and have at least the cosine.

    A group of one block (split = begin) compares all its rows, one of two blocks those before
    `split` with those from it on. Large groups go by matrix products, small ones all together.
    """
    large = stop - begin > 48
    for lo, mid, hi in zip(begin[large], split[large], stop[large]):
        a, b = (np.arange(lo, hi),) * 2 if mid == lo else (np.arange(lo, mid), np.arange(mid, hi))
        _, code = np.unique(near[lo:hi], return_inverse=True)
        holds = np.zeros((hi - lo, int(code.max()) + 1), np.float32)
        holds[np.arange(hi - lo)[:, None], code.reshape(hi - lo, -1)] = 1
        for at in range(0, len(a), BLOCK):
            shared = holds[a[at : at + BLOCK] - lo] @ holds[b - lo].T
            i, j = np.nonzero((shared >= min(SHARED, near.shape[1])) & (vectors[a[at : at + BLOCK]] @ vectors[b].T >= cosine))
            i, j = a[at + i], b[j]
            yield i[i < j], j[i < j]
    begin, stop, split = begin[~large], stop[~large], split[~large]
    one = split == begin
    first = np.where(one, stop - begin, split - begin)  # rows that have partners behind them
    row = ragged(begin, first)
    group = np.repeat(np.arange(len(begin)), first)
    partner = np.where(one[group], row + 1, split[group])
    count = stop[group] - partner
    for at in range(0, len(row), 2048):
        c = count[at : at + 2048]
        i, j = np.repeat(row[at : at + 2048], c), ragged(partner[at : at + 2048], c)
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            shared = (near[x][:, :, None] == near[y][:, None, :]).sum(axis=(1, 2)) >= min(SHARED, near.shape[1])
            x, y = x[shared], y[shared]
            close = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= cosine
            yield x[close], y[close]


def compare_blocks(cosine: float):
    """Compares the blocks of many lists; a pair counts in the smallest list that both are in."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("label", "list", "x", "y", "side", "vec_id")]).combine_chunks()
        column = lambda c: table.column(c).chunk(0) if table.column(c).num_chunks else table.column(c).combine_chunks()
        size = np.diff(np.asarray(column("vector").offsets))  # one length has one number of pivots
        out = [one_length(table.filter(pa.array(size == n)), int(n)) for n in np.unique(size)]
        return pa.concat_tables(out)

    def one_length(table: pa.Table, width: int) -> pa.Table:
        table = table.combine_chunks()
        ids, side, here = (table.column(c).to_numpy() for c in ("vec_id", "side", "list"))
        vectors = unit_rows(table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        near = np.array(table.column("pivots").to_pylist(), np.int64)
        posted = near[:, :POSTED]
        keys = [table.column("label").combine_chunks().dictionary_encode().indices.to_numpy(), here, table.column("x").to_numpy(), table.column("y").to_numpy()]
        new = np.ones(len(ids), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(ids))
        split = begin + np.add.reduceat((side == 0).astype(np.int64), begin)
        split = np.where(split == stop, begin, split)
        found = [np.zeros((2, 0), np.int64)]
        for i, j in group_pairs(vectors, near, begin, stop, split, cosine):
            for at in range(0, len(i), 4096):
                x, y = i[at : at + 4096], j[at : at + 4096]
                both = (posted[x][:, :, None] == posted[y][:, None, :]).any(axis=2)
                own = np.where(both, posted[x], np.iinfo(np.int64).max).min(axis=1) == here[x]
                found.append(np.stack([x[own], y[own]]))
        pairs = np.concatenate(found, axis=1)
        links = np.bincount(pairs.ravel(), minlength=len(ids))
        root = np.arange(len(ids))
        while pairs.size:  # smallest row reachable within the block
            low = root.copy()
            np.minimum.at(low, pairs[0], root[pairs[1]])
            np.minimum.at(low, pairs[1], root[pairs[0]])
            low = low[low]
            if (low == root).all():
                break
            root = low
        full = np.flatnonzero(links)
        return pa.table({"vec_id": ids[full], "root": ids[root[full]], "links": links[full]})

    return run


def embedding_links(rows: DataFrame, cosine: float = COSINE, pivots: int | None = None, seed: int = 42) -> DataFrame:
    """(vec_id, root, links): per block compared, how many links a vector has there and the smallest vector they lead to.

    `rows` are (vec_id, label, vector). Lists of one member are dropped; a list of over BLOCK
    members is cut into blocks by a hash of the id, and each pair of blocks is a task's work, so
    no task holds a list. Every list in full: there is no limit on members or partners.
    """
    index = materialize(postings(rows, fit_pivots(rows, pivots, seed)))
    members = index.select("vec_id", "label", F.explode(F.slice("pivots", 1, POSTED)).alias("list"))
    sizes = materialize(members.groupBy("label", "list").agg(F.count("*").alias("n")).where("n > 1"))
    total = sizes.agg(F.sum(F.col("n") * F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))).first()[0] or 0
    members = members.join(sizes, ["label", "list"]).withColumn("blocks", F.expr(f"int((n + {BLOCK - 1}) div {BLOCK})"))
    members = members.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    # Block b meets every block c: as the first of the pair when b <= c, else as the second.
    met = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("vec_id", "label", "list", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.expr("int(block > other)").alias("side"))
    full = rows.select("vec_id", "label", "vector").join(index.select("vec_id", "pivots"), "vec_id")
    met = met.join(full.drop("label"), "vec_id")
    # Most lists are short, so a task takes many of them: a bucket holds TASK_ROWS rows or so.
    met = met.withColumn("bucket", F.pmod(F.xxhash64("label", "list", "x", "y"), F.lit(total // TASK_ROWS + 1)))
    grouped = met.select("vec_id", "label", "list", "x", "y", "side", "vector", "pivots", "bucket").groupBy("bucket")
    return grouped.applyInArrow(compare_blocks(cosine), "vec_id long, root long, links long")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, pivots: int | None = None, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of the same label, not null, are compared. Null, empty and zero vectors, and
    those with null or non-finite components, link with nothing, nor do rows without an id;
    vectors of different lengths never link. Rows that repeat an id are one vector if they agree
    in label and vector; if not, the smallest of them stands for the id. Every row comes back
    with its id's result. An empty table gives no rows.
    """
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    unique = materialize(usable(rows).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select("vec_id", "v.*"))
    found = materialize(embedding_links(unique, cosine, pivots, seed))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = rows.select("vec_id").join(counts, "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
