"""Readers of captions, words, JSON documents, boards and sound as DataFrames, and writers of captions and snapshots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from cuespan.functions.text import format_time_ms, parse_time_ms, strip_markup
from cuespan.operators.tables import written

TIME = r"\d+:\d{1,2}:\d{1,2}[,.]\d{1,3}"
CLOCK = r"(?:\d+:)?\d{1,2}:\d{1,2}[,.]\d{1,3}"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files, byte order marks and carriage returns out."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return df.withColumn("value", F.regexp_replace(F.regexp_replace("value", r"^\x{FEFF}+", ""), r"\r\n?", "\n"))


def parse_srt(files: DataFrame, mode: str = "tolerant") -> DataFrame:
    """Cues (path, cue_no, start_ms, end_ms, text, rule_id) of (path, value) subtitle texts.

    `tolerant` keeps every block with two times, also without text. `compose` drops blocks without text. `strict`
    needs exact times, keeps line breaks, and names in rule_id empty texts, bad ranges and overlaps.
    """
    blocks = files.select("path", F.posexplode(F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), r"\n\s*\n")).alias("i", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    arrow = F.lit("-->") if mode == "tolerant" else F.lit(" --> ")
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, arrow)), F.lit(True)).cast("int")
    df = blocks.withColumn("lines", lines).withColumn("at", at).where("at > 0").withColumn("t", F.regexp_extract_all(F.element_at("lines", F.col("at")), F.lit(f"({TIME})"), F.lit(1))).where("size(t) >= 2")
    sep = "\n" if mode == "strict" else " "
    body = F.trim(F.array_join(F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines"), F.lit(1))), sep))
    df = df.select("path", "i", parse_time_ms(F.col("t")[0]).alias("start_ms"), parse_time_ms(F.col("t")[1]).alias("end_ms"), body.alias("text"))
    if mode == "compose":
        df = df.where("text <> ''")
    w = Window.partitionBy("path").orderBy("i")
    rule = F.when(F.col("text") == "", "empty-text").when(F.col("end_ms") <= F.col("start_ms"), "bad-range").when(F.col("start_ms") < F.lag("end_ms").over(w), "overlap") if mode == "strict" else F.lit(None).cast("string")
    return df.select("path", F.row_number().over(w).alias("cue_no"), "start_ms", "end_ms", "text", rule.alias("rule_id"))


def read_srt(spark: SparkSession, path: str, mode: str = "tolerant") -> DataFrame:
    return parse_srt(texts(spark, path), mode)


def parse_vtt(files: DataFrame) -> DataFrame:
    """Cues (path, cue_no, start_ms, end_ms, text) of (path, value) WebVTT texts: tags out, entities read, blanks collapsed, empty ones dropped."""
    found = F.regexp_extract_all("value", F.lit(rf"(?m)^[ \t]*({CLOCK}[ \t]*-->[ \t]*{CLOCK}[^\n]*(?:\n[ \t]*\S[^\n]*)*)"), F.lit(1))
    df = files.select("path", F.posexplode(found).alias("i", "cue")).withColumn("t", F.regexp_extract_all("cue", F.lit(f"({CLOCK})"), F.lit(1)))
    text = strip_markup(F.regexp_replace("cue", r"^[^\n]*\n?", ""))
    df = df.select("path", "i", parse_time_ms(F.col("t")[0]).alias("start_ms"), parse_time_ms(F.col("t")[1]).alias("end_ms"), text.alias("text")).where("text <> ''")
    return df.select("path", F.row_number().over(Window.partitionBy("path").orderBy("i")).alias("cue_no"), "start_ms", "end_ms", "text")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    return parse_vtt(texts(spark, path))


JSON3 = ("events array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>")


def read_json3_captions(spark: SparkSession, path: str) -> DataFrame:
    """Cues (path, cue_no, start_ms, end_ms, text) of JSON caption feeds; 1 ms long at least, empty ones dropped."""
    df = spark.read.schema(JSON3).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode("events").alias("i", "e"))
    text = strip_markup(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start, length = F.coalesce("e.tStartMs", F.lit(0)), F.greatest(F.lit(1), F.coalesce("e.dDurationMs", F.lit(1)))
    df = df.select("path", "i", start.alias("start_ms"), (start + length).alias("end_ms"), text.alias("text")).where("text <> ''")
    return df.select("path", F.row_number().over(Window.partitionBy("path").orderBy("i")).alias("cue_no"), "start_ms", "end_ms", "text")


WORDS = ("project_id string, duration_ms bigint, words array<struct<id:string,text:string,start_ms:bigint,end_ms:bigint>>")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Word rows (path, project_id, idx, word_id, text, start_ms, end_ms) of word files."""
    df = spark.read.schema(WORDS).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "project_id", F.posexplode("words").alias("idx", "w"))
    return df.select("path", "project_id", F.col("idx").cast("bigint").alias("idx"), F.col("w.id").alias("word_id"), "w.text", "w.start_ms", "w.end_ms")


def normalize_word_events(events: DataFrame, provider: str) -> DataFrame:
    """Words (project_id, idx, text, start_ms, end_ms) of a provider's feed; boundaries of punctuation and other kinds are dropped.

    ticks: project_id, seq, kind, text, offset, duration (100 ns). arrays: project_id, characters,
    starts, ends (seconds), a row per text.
    """
    if provider == "ticks":
        ms = lambda c: F.bround(F.col(c) / F.lit(10000.0)).cast("bigint")
        df = events.where((F.col("kind") == "WordBoundary") & F.regexp_like("text", F.lit(r"[\p{L}\p{N}_]"))).select("project_id", "seq", "text", ms("offset").alias("start_ms"), ms("duration").alias("_d"))
        df = df.withColumn("end_ms", F.greatest(F.col("start_ms") + 1, F.col("start_ms") + F.col("_d")))
        return df.select("project_id", (F.row_number().over(Window.partitionBy("project_id").orderBy("seq")) - 1).alias("idx"), "text", "start_ms", "end_ms")
    if provider == "arrays":
        df = events.select("project_id", F.posexplode(F.arrays_zip("characters", "starts", "ends")).alias("seq", "z")).where(F.regexp_like("z.characters", F.lit(r"[\p{L}\p{N}_]")))
        ms = lambda c: F.bround(F.col(c) * 1000.0).cast("bigint")
        df = df.select("project_id", "seq", F.col("z.characters").alias("text"), ms("z.starts").alias("start_ms"), ms("z.ends").alias("end_ms")).withColumn("end_ms", F.greatest(F.col("start_ms") + 1, F.col("end_ms")))
        return df.select("project_id", (F.row_number().over(Window.partitionBy("project_id").orderBy("seq")) - 1).alias("idx"), "text", "start_ms", "end_ms")
    raise ValueError(f"unknown provider {provider!r}")


def parse_documents_json(files: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(path, doc) rows and (path, reason) rejects of (path, value) JSON texts: corrupt, with repeated top-level keys, or not finite."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    df = files.withColumn("doc", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "true"}))
    keys = F.json_object_keys("value")
    odd = F.regexp_like("value", F.lit(r"[:\[,]\s*-?(?:NaN|Infinity|INF)\b"))
    reason = F.when(odd, "not-finite").when(F.col("doc._corrupt").isNotNull() | keys.isNull(), "corrupt").when(F.size(keys) != F.size(F.array_distinct(keys)), "duplicate-key")
    df = df.withColumn("reason", reason)
    return df.where("reason is null").select("path", F.struct(*[F.col("doc")[f.name].alias(f.name) for f in schema.fields]).alias("doc")), df.where("reason is not null").select("path", "reason")


def read_documents_json(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    return parse_documents_json(texts(spark, path), schema)


#: Pixels that are compared at once; a larger image is one block.
PIXELS_AT_ONCE = 1 << 17


def board_runs(images: DataFrame, threshold: int = 42) -> tuple[DataFrame, DataFrame]:
    """Foreground runs (board_id, y, x0, x1) and corner samples (board_id, r, g, b) of images (board_id, width, height, channels, data BGR).

    A pixel is foreground if its colour is further than `threshold` from the median of the corners
    (squares of a fiftieth of the shorter side, 4 pixels at least). Images are decoded once, many of one size together:
    both results read their own column of one table in the shared folder, which has a row per image.
    """

    def lists(rows, sizes, names):
        values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i], dtype=np.int32)) for i in range(3)], names)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

    def decoded(ids, height, width, channels, data):
        px = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), height, width, channels)[:, :, :, 2::-1]
        k = max(4, min(width, height) // 50)
        n, planes = len(px), px.shape[3]
        corners = np.concatenate([c.reshape(n, -1, planes) for c in (px[:, :k, :k], px[:, :k, -k:], px[:, -k:, :k], px[:, -k:, -k:])], axis=1)
        far = np.zeros((n, height, width), np.float64)
        for i, middle in enumerate(np.median(corners, axis=1).T):
            far += np.square(px[:, :, :, i] - middle[:, None, None])
        on = np.pad(np.sqrt(far) > threshold, ((0, 0), (0, 0), (1, 1)))
        edge = np.flatnonzero(on[:, :, 1:] != on[:, :, :-1])  # a row's edges are starts and ends in turn
        row, (a, b) = edge[::2] // (width + 1), (edge % (width + 1)).reshape(-1, 2).T
        runs = np.stack([row % height, a, b], axis=1)
        samples = corners.reshape(-1, planes)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), lists(runs, np.bincount(row // height, minlength=n), ["y", "x0", "x1"]), lists(samples, np.full(n, corners.shape[1]), ["r", "g", "b"])], ["board_id", "runs", "corners"])

    def both(batches):
        for batch in batches:
            ids, data = batch.column("board_id").to_pylist(), batch.column("data").to_pylist()
            sizes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width", "channels")], axis=1)
            for size in np.unique(sizes, axis=0):
                own, step = np.nonzero((sizes == size).all(axis=1))[0], max(1, PIXELS_AT_ONCE // max(1, int(size[0] * size[1])))
                for at in range(0, len(own), step):
                    part = own[at : at + step]
                    yield decoded([ids[i] for i in part], *map(int, size), [data[i] for i in part])

    src = images.select(F.col("board_id").cast("string").alias("board_id"), "width", "height", "channels", "data")
    found = written(src.mapInArrow(both, "board_id string, runs array<struct<y:int,x0:int,x1:int>>, corners array<struct<r:int,g:int,b:int>>"))
    rows = lambda c: found.select("board_id", F.explode(c).alias("_r")).select("board_id", "_r.*")
    return rows("runs"), rows("corners")


def read_board_runs(spark: SparkSession, path: str, threshold: int = 42) -> tuple[DataFrame, DataFrame]:
    df = spark.read.format("image").load(path).select(F.col("image.origin").alias("board_id"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")
    return board_runs(df, threshold)


def pcm_chunks(files: DataFrame, chunk: int = 48000, rate: int = 48000) -> DataFrame:
    """(clip_id, chunk_no, samples, reason) of WAV contents (clip_id, content): 16-bit PCM at `rate`, stereo averaged; others have a reason."""

    def unpack(batches):
        for batch in batches:
            for clip, raw in zip(batch.column("clip_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                at = raw.find(b"fmt ")
                fmt = np.frombuffer(raw[at + 8 : at + 24], "<u2") if raw[:4] == b"RIFF" and at >= 0 else None
                data = raw.find(b"data", at + 8)
                if fmt is None or len(fmt) < 8 or data < 0:
                    rows.append((clip, 0, None, "not-wav"))
                elif fmt[0] != 1 or fmt[7] != 16 or int(np.frombuffer(raw[at + 12 : at + 16], "<u4")[0]) != rate:
                    rows.append((clip, 0, None, "format"))
                else:
                    size = int(np.frombuffer(raw[data + 4 : data + 8], "<u4")[0])
                    x = np.frombuffer(raw[data + 8 : data + 8 + size // (2 * int(fmt[1])) * 2 * int(fmt[1])], "<i2").reshape(-1, int(fmt[1])).astype(np.float32).mean(axis=1) / np.float32(32768)
                    rows += [(clip, i // chunk, x[i : i + chunk], None) for i in range(0, len(x), chunk)]
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.list_(pa.float32())), pa.array(c[3], pa.string())], ["clip_id", "chunk_no", "samples", "reason"])

    return files.select(F.col("clip_id").cast("string").alias("clip_id"), "content").mapInArrow(unpack, "clip_id string, chunk_no int, samples array<float>, reason string")


def read_pcm_chunks(spark: SparkSession, path: str, chunk: int = 48000) -> DataFrame:
    return pcm_chunks(spark.read.format("binaryFile").load(path).select(F.col("path").alias("clip_id"), "content"), chunk)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of all files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def _block(sep: str, arrow_from: Column, number: Column | None) -> Column:
    head = F.concat(number.cast("string"), F.lit("\n")) if number is not None else F.lit("")
    return F.concat(head, format_time_ms("start_ms", sep), F.lit(" --> "), format_time_ms("end_ms", sep), F.lit("\n"), F.col("text"))


def render_srt(cues: DataFrame) -> DataFrame:
    """(project_id, block): each project's cues as one subtitle text, numbered from 1."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("cue_no"))
    df = cues.withColumn("_n", n).withColumn("_b", _block(",", F.col("start_ms"), F.col("_n")))
    return df.groupBy("project_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_b"))), lambda x: x["_b"]), "\n\n"), F.lit("\n")).alias("block"))


def render_vtt(cues: DataFrame) -> DataFrame:
    """(project_id, block): as WebVTT."""
    df = cues.withColumn("_b", _block(".", F.col("start_ms"), None))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", "_b"))), lambda x: x["_b"]), "\n\n")
    return df.groupBy("project_id").agg(F.concat(F.lit("WEBVTT\n\n"), body, F.lit("\n")).alias("block"))


def write_captions(blocks: DataFrame, path: str) -> None:
    """One text file per project below `path`/project_id=…"""
    blocks.repartition("project_id").write.mode("overwrite").partitionBy("project_id").text(path)


def write_caption_bundle(blocks: DataFrame, path: str, files: int = 64) -> None:
    """All projects' captions (project_id, block) as `files` Parquet files at most, each sorted by project, however many projects there are."""
    blocks.select("project_id", "block").repartition(files, "project_id").sortWithinPartitions("project_id").write.mode("overwrite").parquet(path)


def read_caption_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of a bundle, as the parsers of captions take them; `path` is the project."""
    return spark.read.parquet(path).select(F.col("project_id").cast("string").alias("path"), F.col("block").alias("value"))


def canonical_json(df: DataFrame) -> DataFrame:
    """(value): each row as JSON with its keys sorted and nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_canonical_json(df: DataFrame, path: str) -> None:
    canonical_json(df).write.mode("overwrite").text(path)


def write_snapshot(df: DataFrame, path: str, bucket_by: str, buckets: int = 64) -> None:
    """A Parquet snapshot partitioned by a bucket of the project, for pruned reads."""
    df.withColumn("bucket", F.pmod(F.xxhash64(bucket_by), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
