"""Helpers the operators share: shared scratch tables, skew-proof lookups, running sums, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so fewer than HOT_SHARE keys are.
HOT_SHARE = 2000
#: Width of the pseudo-random keys of `hash60`.
KEY_BITS = 60


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir.

    Only a local master may run without that setting; it then gets a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("cuespan.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("cuespan.scratch", base)
    return f"{base.rstrip('/')}/cuespan-{uuid.uuid4().hex}"


#: Folder of each table that `materialize` returned and `discard` has not deleted.
_FOLDERS: dict[int, tuple[DataFrame, str]] = {}


def materialize(df: DataFrame, **options) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: lineage ends here."""
    path = scratch(df.sparkSession)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[id(out)] = (out, path)
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are done: it does so when the driver finds that nothing refers to them.

    Worth asking for after a table was written whose making shuffled whole texts; nothing is lost.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` returned. What still reads them must have been written before."""
    for table in tables:
        _, path = _FOLDERS.pop(id(table), (None, None))
        if path:
            remove_folder(table.sparkSession, path)


@contextmanager
def kept_tables(made: list[DataFrame]) -> Iterator[None]:
    """Puts the tables into `made` that `materialize` returns within and that are not discarded there."""
    before = set(_FOLDERS)
    try:
        yield
    finally:
        made += [table for key, (table, _) in _FOLDERS.items() if key not in before]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches hold `rows` rows at most: rows here are whole texts, and each copy of a batch counts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


def hash60(seed: int, *cols) -> Column:
    """A pseudo-random BIGINT in [0, 2^60) that any SQL engine can compute: the first 15 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def lookup_join(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """Left join of rows with one row per key, where a few keys may hold most rows.

    `size` in `groups` counts the rows of the key. Keys above 1/HOT_SHARE of the total are
    fewer than HOT_SHARE, so they are broadcast; the other rows meet in a sort-merge join, and
    rows already served get a key of their own there, made from `spread`, to stay spread out.
    Keys are strings, binary values, or numbers that are not negative.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    cut = total // HOT_SHARE + 1
    values = [c for c in groups.columns if c != key]
    served = F.struct(*values)
    hot = groups.where(F.col(size) > cut).select(key, served.alias("_hot"))
    cold = groups.where(F.col(size) <= cut).select(F.col(key).alias("_key"), served.alias("_cold"))
    kind = dict(groups.dtypes)[key]
    if kind == "bigint":
        own = -1 - F.shiftrightunsigned(F.xxhash64(spread), 1)
    else:
        own = F.sha2(F.concat(F.lit("row "), F.coalesce(F.col(spread).cast("string"), F.lit(""))), 256)
        own = F.unhex(own) if kind == "binary" else own
    out = rows.join(F.broadcast(hot), key, "left")
    out = out.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(own)).join(cold, "_key", "left")
    found = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[found[c].alias(c) for c in values])


def running_before(df: DataFrame, part: str, key: str, order: list[str], value: str, out: str, bits: int = 10) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of `part` before this one by (key, order).

    `key` is uniform in [0, 2^60). No task holds a whole part: its top `bits` cut each part into
    equal slices, whose sums are few; rows are only ranked within their slice.
    """
    df = df.withColumn("_slice", F.shiftright(F.col(key), KEY_BITS - bits))
    sums = df.groupBy(part, "_slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(part, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(part, "_slice").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(sums.hint("merge"), [part, "_slice"])  # rows are sorted by slice after that anyway, and compressed ones look small enough to be broadcast
    df = df.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return df.drop("_slice", "_before")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links: (node, component), component = smallest node reachable.

    Each round every node points to the smallest node it touches, pointers are followed once
    more, and the graph is contracted along them; a round at least halves what is left, so
    `rounds` suffice for 2^60 nodes. Tables of each round are written to the shared folder, so a
    lost executor costs one round at most, and are deleted when the next round has been written.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialize(both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")))
        if point.isEmpty():
            discard(point)
            break
        second = point.select(F.col("a").alias("to"), F.col("to").alias("root"))
        root = materialize(point.join(second, "to").select(F.col("a").alias("node"), "root"))
        before = labels
        if labels is None:
            labels = materialize(root.select("node", F.col("root").alias("component")))
        else:
            step = root.select(F.col("node").alias("component"), "root")
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
            discard(before)
        ends, last = edges, edges
        for end in ("a", "b"):
            ends = ends.join(root.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        ends = ends.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        edges = materialize(ends.where("a <> b").distinct())
        discard(last, point, root)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    discard(edges)
    return labels
