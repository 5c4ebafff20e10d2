"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cuespan.llm.common import hash60, materialize, running_before

#: Slices of the fractional rank; each is ranked by one task.
SLICES = 4096


def stratum(col: str):
    """The source as a key that is never null: 's' + source, or 'n' for null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(col).cast("string")), F.lit("n"))


def interleave_shards(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, source, n_source.

    Law `rows`: shard sizes in rows differ by one at most. Rows of a source are ranked in a seeded
    random order; rank k of n gets the fraction (2k+1)/(2n); all rows are sorted by fraction
    (then source and random key) and cut into equal runs, so every shard has every source's share
    of rows, to one row or so. Null sources are a source of their own. A null text has size 1 and
    checksum 0 like an empty one. Equal texts have no influence on each other, and repeated rows
    get a place each. grown_shard is null: it belongs to another law. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        stratum(source_col).alias("_stratum"),
    )
    rows = materialize(rows.withColumn("_key", hash60(seed, "doc_id")).withColumn("_one", F.lit(1).cast("bigint")))
    ranked = running_before(rows, "_stratum", "_key", ["doc_id", "size", "text_crc32"], "_one", "_rank")
    counts = rows.groupBy("_stratum").agg(F.count("*").alias("n_source"))
    # One row per source: a table of the size of a dimension, joined as Spark's own size check decides.
    ranked = materialize(
        ranked.join(counts, "_stratum")
        .withColumn("_f", (2 * F.col("_rank") + 1) / (2 * F.col("n_source")))
        .withColumn("_slice", F.floor(F.col("_f") * SLICES).cast("int"))
        .drop("_rank", "_one")
    )
    every = Window.orderBy("_slice")
    slices = ranked.groupBy("_slice").agg(F.count("*").alias("_n"))
    slices = slices.select(  # SLICES rows at most
        "_slice",
        F.coalesce(F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    inside = Window.partitionBy("_slice").orderBy("_f", "_stratum", "_key", "doc_id", "size", "text_crc32")
    placed = ranked.join(F.broadcast(slices), "_slice").withColumn("_at", F.col("_before") + F.row_number().over(inside) - 1)
    placed = placed.withColumn("shard", F.expr(f"int(_at * {shards} div _all)"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"_at - (shard * _all + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source", "n_source",
    )
