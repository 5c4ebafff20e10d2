"""Tables written between steps, below the folder that executors share, and running totals over keys of any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: The folder of local masters without a shared one.
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that executors share, spark.checkpoint.dir; only a local master may do without."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


#: Folder of each table that `written` returned and `dropped` has not deleted.
_FOLDERS: dict[int, tuple[DataFrame, str]] = {}


def written(df: DataFrame) -> DataFrame:
    """The frame written as Parquet and read back: lineage ends here, and a lost executor costs no earlier step."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[id(out)] = (out, path)
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` returned, once nothing reads them any more."""
    for table in tables:
        _, path = _FOLDERS.pop(id(table), (None, None))
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def running_totals(rows: DataFrame, part: str, order: list[str], values: list[str]) -> DataFrame:
    """Each value becomes its sum over the rows of `part` up to this one by `order`.

    Rows are dealt by ranges of (part, order), so a part is spread over as many tasks as its rows need;
    each task sums its own, and the sums of earlier ranges of the same part are added. Those are
    one row per range at most.
    """
    placed = written(rows.repartitionByRange(part, *order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(part, "_range").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(part, "_range", F.count("*").over(earlier).alias("_n"), *[F.sum(f"_{v}").over(earlier).alias(f"_{v}") for v in values])
    carried = F.broadcast(carried.where("_n > 0").drop("_n"))
    inside = Window.partitionBy(part, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(carried, [part, "_range"], "left")
    return out.select(*[c for c in rows.columns if c not in values], *[(F.sum(v).over(inside) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
