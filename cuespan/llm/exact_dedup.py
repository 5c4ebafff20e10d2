"""Exact deduplication on a persistent digest index, with DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuespan.llm.common import lookup_join, materialize, remove_folder, scratch

#: Rows of a batch, about, and digests of a bucket.
BATCH_ROWS, BUCKET_ROWS = 1 << 26, 1 << 22
#: Batches of a call at least, so that all but the first meet an index that holds rows.
BATCHES = 4
#: Buckets of an index of its own at least.
LEAST_BUCKETS = 16


class DigestIndex:
    """SHA-256 digests of the texts seen so far: a table bucketed and sorted by digest.

    One row per different text: digest and keep_id (the row that stays). The files are Parquet in
    `path` and outlive the session; opening the same path again, with the same bucket count,
    continues the index. Without a path it is a scratch table, which `close` deletes.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.own, self.path, self.buckets = spark, path is None, path or scratch(spark), buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, batch: DataFrame) -> None:
        """Adds the (digest, keep_id) rows whose digest is new, by sort-merge anti-join."""
        new = batch.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))  # as the table has it: one file a bucket, however many partitions
        new.select("digest", "keep_id").repartition(self.buckets, bucket).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forgets the table; its files stay if they have a path of their own."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if self.own:
            remove_folder(self.spark, self.path)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text's UTF-8 bytes, no normalisation; null counts as empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"))


def id_ranges(rows: DataFrame, batches: int) -> list[str]:
    """Conditions that split the rows into about equal batches, the largest ids first and null ids last."""
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02)), reverse=True) if batches > 1 else []
    cuts = [int(c) for c in cuts]
    if not cuts:
        return ["true"]
    between = [f"doc_id <= {high} and doc_id > {low}" for high, low in zip(cuts, cuts[1:])]
    return [f"doc_id > {cuts[0]}", *between, f"doc_id <= {cuts[-1]} or doc_id is null"]


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The rows come to the index in batches of descending ids, each deduplicated against what is
    there and appended; so of equal texts the row with the largest id stays, and a text that was
    in the index before keeps the row that brought it, and nothing of these rows. group_size
    counts the rows of this table with the text. Null and empty texts are one group. A repeated
    row is marked like its twin. A null id stays only when no row of the group has an id. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = materialize(digests(docs, id_col, text_col))
    n = rows.count()
    own = DigestIndex(docs.sparkSession, buckets=max(LEAST_BUCKETS, n // BUCKET_ROWS + 1)) if index is None else None
    index = index or own
    for where in id_ranges(rows, max(batches, n // BATCH_ROWS + 1)):
        index.append(rows.where(where).groupBy("digest").agg(F.max("doc_id").alias("keep_id")))
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = materialize(sizes.join(index.rows(), "digest"))
    if own:
        own.close()
    out = lookup_join(rows, groups, "digest", "group_size", "doc_id")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
