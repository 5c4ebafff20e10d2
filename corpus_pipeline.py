"""A training-data pipeline over documents: five stages, each one operator of cuespan.llm.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, and read no
others. They decide by row: ids may be null, repeat, or clash between different texts. Null and
empty texts, texts of any length and empty tables pass through every stage; each says what
becomes of them. A stage's result reads scratch tables, which `run` deletes once it is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cuespan.llm.common import discard, hash60, kept_tables, materialize
from cuespan.llm.exact_dedup import DigestIndex, exact_dedup
from cuespan.llm.language_id import UNKNOWN, fit, predict
from cuespan.llm.minhash_dedup import near_groups
from cuespan.llm.mixing import mix
from cuespan.llm.pieces import encode_pieces, id_checksums

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIECES = "piece_bpe_32k.model"
#: Documents whose best language has a smaller share of the likelihood go.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language: no text, no letter, or no language clearly likelier than the rest.

    Each row is judged by its whole text; null, repeated and clashing ids make no difference, and
    repeated rows stay or go together. An empty table gives none.
    """
    path = public_tokenizers.path(PIECES)
    scored = predict(docs.select(*COLUMNS), fit(docs, path), path)
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts, the one with the largest doc_id; null ids are smaller than all others.

    Of rows that share doc_id and text the one with the least (lang, source, n_chars) stays, nulls
    first. Rows that share only the doc_id are judged by their texts, each for itself. Null and
    empty texts are equal, so one row of them stays.
    """
    key = lambda digest: F.unhex(F.sha2(F.concat_ws(":", digest, F.col("doc_id").cast("string")).cast("binary"), 256))
    index = DigestIndex(spark)
    marked = materialize(exact_dedup(docs, index))
    index.close()
    kept = marked.where("kept").select(key(F.col("text_sha256")).alias("_key")).distinct()
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = docs.groupBy(key(digest).alias("_key")).agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("_row"))
    return rows.join(kept, "_key", "left_semi").select(*[f"_row.{c}" for c in COLUMNS])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, the one with the smallest doc_id; null ids are larger than all others.

    Rows are grouped by a key of their own, so rows that share a doc_id are near-duplicates only
    if their texts are; of those that share the smallest doc_id of a group any one stays, by a hash of the text.
    Rows without a word (null, empty and blank texts) are no near-duplicates, not even of each other, and all stay.
    """
    rows = materialize(docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row")))
    groups = near_groups(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "_row"))
    kept = groups.join(rows.select("_row", "doc_id", "_hash"), "_row").groupBy("component_id").agg(first.alias("_first")).select("_first._row")
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes its words; rows it doesn't take go.

    A fraction is rounded up with its own chance, by a hash of the row, so a source's words still
    come near its target. Null and clashing ids are rows like all others; rows equal in all
    columns come as often as the mix takes them together. Rows without a word have no size and go.
    A null source is a source of its own.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*[F.col(c).isNull() for c in COLUMNS], *COLUMNS).alias("_id"))
    share = hash60(7, "doc_id") / float(1 << 60)  # the mix's doc_id is _id
    taken = mix(rows, id_col="_id")["documents"].where("taken > 0").groupBy("doc_id").agg((F.sum("taken") / F.max("size")).alias("_share"))
    taken = materialize(taken.select(F.col("doc_id").alias("_id"), F.floor(F.col("_share") + share).cast("int").alias("_times")).where("_times > 0"))
    # A set, though nearly always of one row: different rows may share a hash.
    # Compressed, the table looks small enough to go through the driver, so the join is told to merge.
    rows = rows.groupBy("_id").agg(F.collect_set(F.struct(*COLUMNS)).alias("_rows")).join(taken.hint("merge"), "_id")
    rows = rows.select("_times", F.explode("_rows").alias("_row")).withColumn("_copy", F.explode(F.expr("sequence(1, _times)")))
    return rows.select(*[f"_row.{c}" for c in COLUMNS])


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every whole text: doc_id, source, piece_ids, n_pieces and ids_crc32. One row per row, whatever its id.

    A null text is empty; an empty one has no pieces and the checksum 0.
    """
    encoded = encode_pieces(docs.select("doc_id", "source", "text"), public_tokenizers.path(PIECES)).drop("text")
    return id_checksums(encoded)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("pieces", pieces_stage)]

#: Models, MinHash signatures and tokenizers cannot be put in SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each written before the next begins."""
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        made: list[DataFrame] = []
        with kept_tables(made):
            result = stage(spark, docs, sf_dir)
        docs = materialize(result)
        discard(*left, *made)
        left = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
