"""Aggregations over timelines, audio chunks, runs and violations; all combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cuespan.functions.text import char_class_counts, norm_text
from cuespan.operators.joins import interval_join
from cuespan.operators.windows import hand_violations


def plan_summary(shots: DataFrame) -> DataFrame:
    """Per project: shots, sections, share of each mode, exceptions. shots: project_id, shot_id, section, mode, excepted."""
    a, n = F.count_if(F.col("mode") == "a-roll"), F.count("*")
    return shots.groupBy("project_id").agg(n.alias("shot_count"), F.count_distinct("section").alias("section_count"), a.alias("a_roll_shots"), (n - a).alias("b_roll_shots"), F.bround(a / n, 3).alias("a_roll_ratio"), F.sort_array(F.collect_list(F.when(F.col("excepted"), F.col("shot_id")))).alias("exceptions"))


def template_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def audio_levels(chunks: DataFrame, sample_rate: int = 48000, silent: float = 0.0005) -> DataFrame:
    """(clip_id, samples, rms, peak, duration_ms, non_silent) of chunks (clip_id, samples ARRAY<FLOAT>): partial sums per chunk, then per clip."""
    part = chunks.select("clip_id", F.size("samples").cast("bigint").alias("n"), F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("q"), F.array_max(F.transform("samples", F.abs)).cast("double").alias("p"))
    df = part.groupBy("clip_id").agg(F.sum("n").alias("samples"), F.sum("q").alias("_q"), F.coalesce(F.max("p"), F.lit(0.0)).alias("peak"))
    rms = F.sqrt(F.col("_q") / F.greatest(F.col("samples"), F.lit(1)))
    return df.select("clip_id", "samples", F.round(rms, 6).alias("rms"), F.round("peak", 6).alias("peak"), F.bround(F.col("samples") / sample_rate * 1000).cast("bigint").alias("duration_ms"), (rms >= silent).alias("non_silent"))


def transcript_metrics(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """Per project: cues, letter classes, words a minute, share of the duration covered. durations: project_id, duration_ms."""
    df = cues.withColumn("_c", char_class_counts("text")).groupBy("project_id").agg(F.count("*").alias("cue_count"), F.sum("_c.cjk").alias("cjk"), F.sum("_c.latin").alias("latin"), F.sum("_c.words").alias("words"), F.min("start_ms").alias("_a"), F.max("end_ms").alias("_b")).join(durations, "project_id")
    minutes = F.greatest(F.col("duration_ms") / 60000.0, F.lit(1 / 60))
    return df.select("project_id", "cue_count", "cjk", "latin", "words", F.round(F.col("words") / minutes, 4).alias("words_per_minute"), F.round(F.greatest(F.lit(0), F.col("_b") - F.col("_a")) / F.greatest("duration_ms", F.lit(1)), 4).alias("span_ratio"))


def repeat_ratio(cues: DataFrame, least: int = 6, share: float = 0.35) -> DataFrame:
    """(project_id, keys, repeated, flagged) of cues that say the same, letters and digits compared."""
    df = cues.select("project_id", norm_text("text", "casefold").alias("k")).where("k <> ''").groupBy("project_id").agg(F.count("*").alias("keys"), (F.count("*") - F.count_distinct("k")).alias("repeated"))
    return df.withColumn("flagged", (F.col("keys") >= least) & (F.col("repeated") / F.col("keys") > share))


def thirds_language(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """(project_id, third, cjk, latin): letters of the cues whose middle is in each third of the duration."""
    third = F.greatest(F.col("duration_ms") / 3.0, F.lit(1.0))
    df = cues.join(durations, "project_id").withColumn("third", F.floor((F.col("start_ms") + F.col("end_ms")) / 2 / third).cast("int")).where("third between 0 and 2")
    return df.withColumn("_c", char_class_counts("text")).groupBy("project_id", "third").agg(F.sum("_c.cjk").alias("cjk"), F.sum("_c.latin").alias("latin"))


def pacing_stats(scenes: DataFrame) -> DataFrame:
    """(project_id, n, avg_ms, min_ms, max_ms, cuts_per_minute)."""
    d = F.col("end_ms") - F.col("start_ms")
    df = scenes.groupBy("project_id").agg(F.count("*").alias("n"), F.bround(F.avg(d)).cast("bigint").alias("avg_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), F.max("end_ms").alias("_t"))
    return df.select("project_id", "n", "avg_ms", "min_ms", "max_ms", F.round(F.greatest(F.lit(0), F.col("n") - 1) / (F.greatest(F.col("_t"), F.lit(1)) / 60000.0), 4).alias("cuts_per_minute"))


def robust_threshold(motion: DataFrame, least: float = 12.0) -> DataFrame:
    """(video_id, threshold): the largest of `least`, the 90th percentile, and the median and 4 deviations; first samples left out."""
    first = F.min("time_ms").over(Window.partitionBy("video_id"))
    df = motion.withColumn("_f", first).where("time_ms > _f")
    mid = df.groupBy("video_id").agg(F.expr("percentile(score, 0.5)").alias("m"), F.expr("percentile(score, 0.9)").alias("p90"))
    mad = df.join(mid, "video_id").groupBy("video_id").agg(F.expr("percentile(abs(score - m), 0.5)").alias("mad"), F.first("m").alias("m"), F.first("p90").alias("p90"))
    value = F.greatest(F.lit(least), "p90", F.col("m") + 4.0 * F.greatest(F.lit(1.0), 1.4826 * F.col("mad")))
    return motion.select("video_id").distinct().join(mad, "video_id", "left").select("video_id", F.round(F.coalesce(value, F.lit(least)), 4).alias("threshold"))


def motion_class(motion: DataFrame, scenes: DataFrame, skip_ms: int = 250) -> DataFrame:
    """Scenes (video_id, scene_no, start_ms, end_ms) with their mean score, the first `skip_ms` left out, and class."""
    spans = scenes.select("video_id", "scene_no", (F.col("start_ms") + skip_ms).alias("span_start_ms"), F.col("end_ms").alias("span_end_ms")).where("span_start_ms < span_end_ms")
    hits = interval_join(motion.select("video_id", "score", F.col("time_ms").alias("start_ms"), F.col("time_ms").alias("end_ms")), spans, "video_id", how="start_inside")
    mean = hits.groupBy("video_id", "scene_no").agg(F.avg("score").alias("s"))
    df = scenes.join(mean, ["video_id", "scene_no"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    kind = F.when(F.col("s") < 1.5, "low-frame-difference").when(F.col("s") < 4.5, "subtle-motion").otherwise("active-motion")
    return df.select(*scenes.columns, F.round("s", 4).alias("score"), kind.alias("motion_type"))


def hand_motion_summary(frames: DataFrame, short_edge: int = 1080) -> DataFrame:
    """One row per hand: frames, steps and counts per kind of violation, in one pass over the frames."""
    kind = lambda k: F.count_if(F.exists("found", lambda h: h["kind"] == k))
    df = hand_violations(frames, short_edge).groupBy("key").agg(
        F.count("*").alias("frames"), F.count_if("shown").alias("visible_frames"), F.round(F.coalesce(F.max("step"), F.lit(0.0)), 5).alias("max_step"),
        F.round(F.coalesce(F.expr("percentile(step, 0.95)"), F.lit(0.0)), 5).alias("p95_step"), F.round(F.coalesce(F.max("delta"), F.lit(0.0)), 5).alias("max_delta"),
        kind("hold-then-jump").alias("hold_then_jump"), kind("single-frame-gap").alias("single_frame_gap"), kind("abrupt-disappearance").alias("abrupt"), F.sum(F.size("found")).alias("violations"))
    return df.withColumn("status", F.when(F.col("violations") == 0, "passed").otherwise("failed"))


def foreground_bbox(runs: DataFrame) -> DataFrame:
    """(board_id, x0, y0, x1, y1) of runs (board_id, y, x0, x1), ends beyond."""
    return runs.groupBy("board_id").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"))


def corner_background(pixels: DataFrame) -> DataFrame:
    """(board_id, r, g, b): medians of corner samples."""
    return pixels.groupBy("board_id").agg(*[F.median(c).alias(c) for c in "rgb"])


def max_pairwise_distance(vectors: DataFrame, group: str, limit: float = 35.0) -> DataFrame:
    """(group, distance, flagged): the largest Euclidean distance within a group of a few vectors (group, id, v)."""
    a, b = vectors.alias("a"), vectors.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.id") < F.col("b.id")))
    d = F.sqrt(F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    return pairs.groupBy(F.col(f"a.{group}").alias(group)).agg(F.round(F.max(d), 4).alias("distance")).withColumn("flagged", F.col("distance") > limit)


def qa_rollup(violations: DataFrame) -> DataFrame:
    """Errors and warnings per scene, project and in all (level 0, 1, 3). violations: project_id, scene_id, severity."""
    df = violations.rollup("project_id", "scene_id").agg(F.grouping_id().cast("int").alias("level"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return df.withColumn("ok", F.col("errors") == 0)


def issue_report(violations: DataFrame) -> DataFrame:
    """(project_id, report): all problems of a project, numbered. violations: project_id, scene_id, message."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("scene_id", "message"))
    rows = violations.withColumn("_n", n).withColumn("_line", F.concat(F.col("_n").cast("string"), F.lit(". "), F.col("message")))
    return rows.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n").alias("report"))


def duration_plan(scenes: DataFrame, words: DataFrame, audio: DataFrame) -> DataFrame:
    """Per project: ends of timeline, words and audio, the duration to aim at and how far the tail is extended."""
    df = scenes.groupBy("project_id").agg(F.max("end_ms").alias("timeline_end_ms")).join(words.groupBy("project_id").agg(F.max("end_ms").alias("words_end_ms")), "project_id").join(audio, "project_id", "left")
    target = F.greatest("timeline_end_ms", "words_end_ms", F.coalesce("audio_ms", F.lit(0)))
    measured = F.when(F.coalesce("audio_ms", F.lit(0)) == 0, F.col("words_end_ms")).otherwise(F.col("audio_ms"))
    return df.select("project_id", "timeline_end_ms", "words_end_ms", measured.alias("audio_duration_ms"), target.alias("target_duration_ms"), F.greatest(F.lit(0), target - F.col("timeline_end_ms")).alias("tail_extension_ms"))


def map_checksum(runs: DataFrame) -> DataFrame:
    """(board_id, sha256) over the board's owner runs (board_id, element_id, y, x0, x1) in order."""
    line = F.concat_ws(",", "y", "x0", "x1", "element_id")
    key = F.struct("y", "x0", "x1", "element_id", line.alias("line"))
    return runs.groupBy("board_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"]), ";").cast("binary"), 256).alias("sha256"))


def dominant_group(groups: DataFrame) -> DataFrame:
    """Groups (board_id, group_id, area, w, h) ranked by area; the largest is the subject, flat or thin ones text, the rest contour."""
    w = Window.partitionBy("board_id").orderBy(F.desc("area"), "group_id")
    df = groups.withColumn("rank", F.row_number().over(w))
    flat = (F.col("w") / F.greatest("h", F.lit(1)) >= 2.5) | (F.col("h") / F.greatest("w", F.lit(1)) >= 2.5)
    return df.withColumn("kind", F.when(F.col("rank") == 1, "subject").when(flat, "text").otherwise("contour"))


def largest_remainder(items: DataFrame, total: int, weight: str, partition: str, order: str) -> DataFrame:
    """Adds units: `total` shared by weight within a partition, each item one at least, remainders to the largest fractions."""
    part = Window.partitionBy(partition)
    spare = F.greatest(F.lit(0), total - F.count("*").over(part))
    df = items.withColumn("_raw", spare * F.col(weight) / F.sum(weight).over(part))
    df = df.withColumns({"_add": F.floor("_raw"), "_spare": spare})
    nth = F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(F.col("_raw") - F.col("_add")), order))
    df = df.withColumns({"_nth": nth, "_left": F.col("_spare") - F.sum("_add").over(part)})
    return df.withColumn("units", (1 + F.col("_add") + (F.col("_nth") <= F.col("_left")).cast("int")).cast("bigint")).drop("_raw", "_add", "_spare", "_nth", "_left")
