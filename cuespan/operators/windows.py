"""Window operators over timelines: each runs within one key (project, scene, video), so work spreads over keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

# Fixed values, in milliseconds or as shares.
MIN_ERASE_MS, MAX_ERASE_MS, CLEAN_CANVAS_MS, MAX_ACTIVE_TRANSITION_MS = 240, 420, 60, 500
PRE_ACTION_MS, POST_ACTION_HOLD_MS = 100, 250
PACING_RATIO, PACING_MIN_MS, PACING_MAX_MS, PACING_HOLD_MS = 0.92, 1500, 25000, 250
OPENING_ANCHOR_START_MS = 100
# Largest step of a hand by state, as shares of the short edge, and what counts as hold, jump and uneven step.
STEP_LIMITS = {"draw": 0.018, "travel": 0.022, "color": 0.022}
OTHER_STEP_LIMIT, HOLD_STEP, JUMP_STEP, STEP_DELTA, OPAQUE = 0.022, 0.0015, 0.012, 0.0055, 0.35
FAST_STATES = ("fast-draw", "fast-color")


def _w(part, order):
    return Window.partitionBy(*part).orderBy(*order)


def _up_to(part, order, last=0):
    return _w(part, order).rowsBetween(Window.unboundedPreceding, last)


def monotone_clamp(intervals: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Starts at or after the end before, every interval 1 ms long at least, as one running maximum.

    The recurrence end = max(start, end before) + 1 or the own end has a closed form: the running
    maximum of (own end - position), plus the position.
    """
    i = F.row_number().over(_w(partition, order))
    own = F.greatest(F.col("start_ms") + 1, F.col("end_ms"))
    df = intervals.withColumns({"_i": i, "_own": own})
    df = df.withColumn("_end", F.col("_i") + F.greatest(F.lit(0), F.max(F.col("_own") - F.col("_i")).over(_up_to(partition, order))))
    start = F.greatest(F.coalesce(F.lag("_end").over(_w(partition, order)), F.lit(0)), F.col("start_ms"))
    return df.withColumns({"start_ms": start, "end_ms": F.col("_end")}).drop("_i", "_own", "_end")


def fill_zero_durations(words: DataFrame, audio: DataFrame | None = None, partition=("project_id",), order=("idx",)) -> DataFrame:
    """A word without length ends where the next starts, the last one at audio_ms; all are 1 ms long at least."""
    part = list(partition)
    df = words.join(audio, part, "left") if audio is not None else words.withColumn("audio_ms", F.lit(0))
    nxt = F.coalesce(F.lead("start_ms").over(_w(part, order)), F.col("audio_ms"), F.lit(0))
    end = F.when((F.col("end_ms") <= F.col("start_ms") + 1) & (nxt > F.col("start_ms")), nxt).otherwise(F.col("end_ms"))
    return df.withColumn("end_ms", F.greatest(F.col("start_ms") + 1, end)).drop("audio_ms")


def transition_plan(words: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row per neighbouring scenes: the pause between their words, split into hold, erasing and clean canvas.

    Words (project_id, scene_id, start_ms, end_ms) are those already matched to scenes. Pauses
    that are too short, and scenes without words, have a violation and null intervals.
    """
    spans = words.groupBy("project_id", "scene_id").agg(F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))
    df = scenes.select("project_id", "scene_id", "seq").join(spans, ["project_id", "scene_id"], "left")
    w = _w(["project_id"], ["seq"])
    df = df.select("project_id", F.col("scene_id").alias("from_scene"), F.lead("scene_id").over(w).alias("to_scene"), F.col("last_ms").alias("previous_end_ms"), F.lead("first_ms").over(w).alias("next_start_ms"))
    df = df.where("to_scene is not null").withColumn("gap_ms", F.col("next_start_ms") - F.col("previous_end_ms"))
    ready = F.col("gap_ms") >= MIN_ERASE_MS + CLEAN_CANVAS_MS
    erase = F.least(F.lit(MAX_ERASE_MS), F.least("gap_ms", F.lit(MAX_ACTIVE_TRANSITION_MS)) - CLEAN_CANVAS_MS)
    hold = F.col("gap_ms") - erase - CLEAN_CANVAS_MS
    return df.withColumns({
        "hold_ms": F.when(ready, hold), "erase_ms": F.when(ready, erase), "erase_start_ms": F.when(ready, F.col("previous_end_ms") + hold),
        "clean_start_ms": F.when(ready, F.col("previous_end_ms") + hold + erase),
        "rule_id": F.when(F.col("gap_ms").isNull(), "missing-words").when(~ready, "short-gap"),
    })


def adaptive_pacing(elements: DataFrame, scenes: DataFrame, ratio=PACING_RATIO, min_ms=PACING_MIN_MS, max_ms=PACING_MAX_MS, min_hold_ms=PACING_HOLD_MS) -> DataFrame:
    """Reveal durations from the time until the next start; if a start of a scene is missing, all get default ones.

    elements (scene_id, seq, start_ms, dur_ms), scenes (scene_id, duration_ms). Adds new_start_ms, new_dur_ms.
    """
    part, w = Window.partitionBy("scene_id"), _w(["scene_id"], ["seq"])
    df = elements.join(scenes.select("scene_id", "duration_ms"), "scene_id")
    n, i = F.count("*").over(part), F.row_number().over(w) - 1
    step = F.greatest(F.lit(500), F.floor((F.col("duration_ms") - 200) / n))
    valid = F.count("start_ms").over(part) == n
    df = df.withColumns({"new_start_ms": F.when(valid, F.col("start_ms")).otherwise(100 + i * step).cast("bigint")})
    nxt = F.lead("new_start_ms").over(w)
    # A next start of 0 counts as not given.
    df = df.withColumns({"_last": nxt.isNull(), "_room": F.greatest(F.lit(0), F.coalesce(F.when(nxt != 0, nxt), F.col("duration_ms")) - F.col("new_start_ms"))})
    room, hold, reserve = F.col("_room"), min_hold_ms, max(min_hold_ms * 2, 450)

    def target(share):
        return F.greatest(F.lit(min_ms), F.least(F.bround(room * F.lit(float(share))).cast("bigint"), F.lit(max_ms)))

    inner, last = target(ratio), target(max(0.60, ratio - 0.02))
    inner = F.when(room > min_ms + hold, F.least(inner, room - hold)).when(room > 350, F.greatest(F.lit(300), room - 50)).otherwise(F.greatest(F.lit(100), room))
    last = F.when(room > min_ms + reserve, F.least(last, room - reserve)).when(room > min_ms + hold, F.least(last, room - hold)).when(room > 350, F.greatest(F.lit(300), room - hold)).otherwise(F.greatest(F.lit(100), room))
    return df.withColumn("new_dur_ms", F.when(F.col("_last"), last).otherwise(inner).cast("bigint")).drop("_last", "_room", "duration_ms")


def interpolate_gaps(chars: DataFrame, bounds: DataFrame, partition=("project_id",), order=("pos",)) -> DataFrame:
    """Fills runs of null timings evenly between the neighbours' times; `bounds` has first_ms and last_ms for runs at the ends."""
    part, order = list(partition), list(order)
    # What follows is read backwards: a frame to the end would be evaluated anew for each row.
    w, before, after = _w(part, order), _up_to(part, order, -1), _up_to(part, [F.desc(c) for c in order], -1)
    df = chars.join(bounds, part).withColumns({
        "_left": F.coalesce(F.last("end_ms", True).over(before), F.col("first_ms")), "_right": F.coalesce(F.last("start_ms", True).over(after), F.col("last_ms")),
        "_run": F.count("start_ms").over(_up_to(part, order)), "_null": F.col("start_ms").isNull(),
    })
    run = Window.partitionBy(*part, "_run", "_null")
    n, k = F.count("*").over(run), F.row_number().over(run.orderBy(*order)) - 1
    df = df.withColumns({"_n": n, "_k": k}).withColumn("_span", F.greatest(F.col("_n"), F.col("_right") - F.col("_left")))
    at = lambda k: F.bround(F.col("_left") + F.col("_span") * k / F.col("_n")).cast("bigint")
    start, end = at(F.col("_k")), at(F.col("_k") + 1)
    return df.withColumns({"start_ms": F.coalesce("start_ms", start), "end_ms": F.when(F.col("_null"), F.greatest(start + 1, end)).otherwise(F.col("end_ms"))}).select(*chars.columns)


def effect_window(elements: DataFrame, scenes: DataFrame, concurrent: bool = False) -> DataFrame:
    """Free time behind an element until the next start, the narration's end and the erasing.

    scenes: scene_id, duration_ms, erase_ms and narration_ms (relative, may be null).
    """
    w = _w(["scene_id"], ["seq"])
    df = elements.join(scenes, "scene_id").withColumns({"element_end_ms": F.col("start_ms") + F.col("dur_ms"), "next_start_ms": F.coalesce(F.lead("start_ms").over(w), F.col("duration_ms")), "_more": F.lead("seq").over(w).isNotNull()})
    bound = F.least("duration_ms", *([] if concurrent else ["next_start_ms"]), "erase_ms", "narration_ms")
    df = df.withColumns({"boundary_ms": bound, "action_start_ms": F.col("element_end_ms") + PRE_ACTION_MS}).withColumn("action_end_ms", F.col("boundary_ms") - POST_ACTION_HOLD_MS)
    df = df.withColumns({"budget_ms": F.greatest(F.lit(0), F.col("action_end_ms") - F.col("action_start_ms")), "concurrent": F.lit(concurrent) & F.col("_more") & (F.col("action_end_ms") > F.col("next_start_ms"))})
    return df.drop("_more", "duration_ms", "erase_ms", "narration_ms")


def local_peaks(motion: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Samples at or above the video's threshold and both neighbours; the first and last have only one and never count."""
    w = _w(["video_id"], ["time_ms"])
    df = motion.withColumns({"_b": F.lag("score").over(w), "_a": F.lead("score").over(w)}).join(thresholds, "video_id")
    return df.where("score >= threshold and score >= _b and score >= _a").drop("_a", "_b", "threshold")


def frame_render_plan(scenes: DataFrame, targets: DataFrame, fps: int = 30) -> DataFrame:
    """Whole frames of scenes that add up to the video's length; broken rules in rule_id. targets: project_id, target_ms."""
    w = _w(["project_id"], ["seq"])
    frames = lambda ms: F.ceil(ms * fps / 1000)
    df = scenes.join(targets, "project_id").withColumn("render_end_ms", F.coalesce(F.lead("start_ms").over(w), F.col("target_ms")))
    df = df.withColumns({"start_frame": frames(F.col("start_ms")), "end_frame": frames(F.col("render_end_ms"))})
    df = df.withColumn("_before", F.coalesce(F.lag("end_frame").over(w), F.lit(0)))
    df = df.withColumns({"lead_frames": F.greatest(F.lit(0), F.col("start_frame") - F.col("_before")), "target_frames": F.col("end_frame") - F.col("_before")})
    ms = lambda n: F.bround(n * 1000 / F.lit(float(fps))).cast("bigint")
    total = ms(F.col("lead_frames")) + F.col("end_ms") - F.col("start_ms") + F.greatest(F.lit(0), ms(F.col("end_frame")) - F.col("end_ms"))
    rule = F.when(F.col("render_end_ms") < F.col("end_ms"), "narration-beyond-window").when(F.col("target_frames") <= 0, "empty-frame-range").when(F.col("lead_frames") >= F.col("target_frames"), "no-content-frames")
    return df.withColumns({"total_ms": total, "rule_id": rule}).select("project_id", "scene_id", "start_frame", "end_frame", "lead_frames", "target_frames", "total_ms", "rule_id")


def hand_steps(frames: DataFrame, short_edge: int = 1080) -> DataFrame:
    """Adds to frames of a hand: shown, step (share of the short edge, null at the start of a visible run), step_before and delta."""
    w = _w(["key"], ["frame"])
    df = frames.withColumn("shown", F.col("visible") & (F.col("opacity") > 0))
    df = df.withColumns({"_shown_b": F.coalesce(F.lag("shown").over(w), F.lit(False))})
    shown, opened = F.col("shown"), ~F.col("_shown_b")
    step = F.when(shown & ~opened, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / short_edge)
    df = df.withColumns({"step": step, "fast": F.col("state").isin(*FAST_STATES) | F.coalesce(F.lag("state").over(w).isin(*FAST_STATES), F.lit(False))})
    df = df.withColumn("step_before", F.when(F.col("step").isNotNull(), F.coalesce(F.lag("step").over(w), F.lit(0.0))))
    return df.withColumn("delta", F.when(~F.col("fast"), F.abs(F.col("step") - F.col("step_before")))).drop("_shown_b")


def hand_violations(frames: DataFrame, short_edge: int = 1080) -> DataFrame:
    """`hand_steps` with `found`, an array of (kind, value): what is unsteady at each frame. Fast drawing is exempt from step rules."""
    w = _w(["key"], ["frame"])
    df = hand_steps(frames, short_edge)
    limit = F.coalesce(*[F.when(F.col("state") == s, F.lit(v)) for s, v in STEP_LIMITS.items()], F.lit(OTHER_STEP_LIMIT))
    back = lambda c, n: F.lag(c, n).over(w)
    known = F.col("step").isNotNull() & ~F.col("fast")
    no = F.lit(None).cast("double")
    rules = {
        "abrupt-disappearance": (~F.col("shown") & F.coalesce(back("shown", 1), F.lit(False)) & (back("opacity", 1) > OPAQUE), no),
        "single-frame-gap": (F.col("shown") & ~F.coalesce(back("shown", 1), F.lit(True)) & F.coalesce(back("shown", 2), F.lit(False)) & (back("opacity", 2) > OPAQUE) & (F.col("opacity") > OPAQUE), no),
        "max-step": (known & (F.col("step") > limit + 1e-9), F.col("step")),
        "hold-then-jump": (known & (F.col("step_before") <= HOLD_STEP) & (F.col("step") > JUMP_STEP), F.col("step")),
        "step-delta": (known & (F.col("delta") > STEP_DELTA), F.col("delta")),
    }
    hits = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(k).alias("kind"), F.round(v, 5).alias("value"))) for k, (ok, v) in rules.items()]))
    return df.withColumn("found", hits)


def hand_motion_qa(frames: DataFrame, short_edge: int = 1080) -> DataFrame:
    """(key, frame, kind, value) of unsteady hand motion."""
    return hand_violations(frames, short_edge).select("key", "frame", F.explode("found").alias("h")).select("key", "frame", "h.kind", "h.value")


def adjacent_repeat(df: DataFrame, cols: list[str], n: int, partition: list[str], order: list[str]) -> DataFrame:
    """Rows whose columns equal those of each of the n - 1 rows before."""
    w = _w(partition, order)
    same = F.lit(True)
    for c in cols:
        for k in range(1, n):
            same = same & (F.col(c) == F.lag(c, k).over(w))
    return df.withColumn("_s", same).where("_s").drop("_s")


def longest_static_gap(markers: DataFrame, words: DataFrame) -> DataFrame:
    """(project_id, gap_ms): the longest time between different markers, the words' ends included."""
    ends = words.groupBy("project_id").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    w = _w(["project_id"], ["at"])
    df = markers.select("project_id", "at").distinct().withColumns({"_b": F.lag("at").over(w), "_a": F.lead("at").over(w)}).join(ends, "project_id", "right")
    gap = F.greatest(F.coalesce(F.col("at") - F.coalesce("_b", "lo"), F.col("hi") - F.col("lo")), F.when(F.col("_a").isNull() & F.col("at").isNotNull(), F.col("hi") - F.col("at")))
    return df.groupBy("project_id").agg(F.max(gap).alias("gap_ms"))


def overlap_check(intervals: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Intervals that start before the latest end so far."""
    return intervals.withColumn("latest_end_ms", F.max("end_ms").over(_up_to(partition, order, -1))).where("start_ms < latest_end_ms")


def opening_anchor(beats: DataFrame, shots: DataFrame) -> DataFrame:
    """The first beat of each shot moved near the shot's start; its own window is kept in trigger_*."""
    first = F.row_number().over(_w(["shot_id"], ["beat_no"])) == 1
    df = beats.join(shots, "shot_id").withColumns({"_first": first, "_anchor": F.least(F.col("shot_start_ms") + OPENING_ANCHOR_START_MS, F.greatest(F.col("shot_start_ms"), F.col("shot_end_ms") - 1))})
    end = F.greatest("end_ms", F.least(F.col("shot_end_ms"), F.col("_anchor") + 50))
    end = F.when(end <= F.col("_anchor"), F.least(F.col("shot_end_ms"), F.col("_anchor") + 1)).otherwise(end)
    on = lambda a, b: F.when(F.col("_first"), a).otherwise(b)
    return df.select("shot_id", "beat_no", on(F.col("_anchor"), F.col("start_ms")).alias("start_ms"), on(end, F.col("end_ms")).alias("end_ms"), F.when(F.col("_first"), F.col("start_ms")).alias("trigger_start_ms"), F.when(F.col("_first"), F.col("end_ms")).alias("trigger_end_ms"))


def proportional_slice(df: DataFrame, n: int, partition: list[str], order: list[str]) -> DataFrame:
    """Rows with the slices 0..n-1 they are in: equal shares by position; an empty share takes the row at its left end."""
    i, total = F.row_number().over(_w(partition, order)) - 1, F.count("*").over(Window.partitionBy(*partition))
    df = df.withColumns({"_i": i, "_n": total})
    left = lambda s: F.floor(s * F.col("_n") / n)
    # A row is in few slices: those whose share holds it, or are empty and begin at it.
    own = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: ((left(s) <= F.col("_i")) & (F.col("_i") < left(s + 1))) | ((left(s) >= left(s + 1)) & (F.col("_i") == F.least(left(s), F.col("_n") - 1))))
    return df.withColumn("slice", F.explode(own)).drop("_i", "_n")


def path_length(points: DataFrame) -> DataFrame:
    """Adds cum_len, the length of the path (key, frame, x, y) up to each point."""
    w = _w(["key"], ["frame"])
    df = points.withColumn("_d", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0)))
    return df.withColumn("cum_len", F.sum("_d").over(_up_to(["key"], ["frame"]))).drop("_d")


def path_resample(points: DataFrame, spacing: float) -> DataFrame:
    """(key, i, x, y): points at equal distances along each path; paths shorter than `spacing` keep their ends."""
    w = _w(["key"], ["frame"])
    df = path_length(points).withColumns({"_total": F.max("cum_len").over(Window.partitionBy("key")), "_lo": F.lag("cum_len").over(w), "_x": F.lag("x").over(w), "_y": F.lag("y").over(w), "_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("key"))})
    n = F.greatest(F.lit(2), F.bround(F.col("_total") / spacing).cast("int"))
    df = df.withColumn("_k", n)
    # Target i lies in the segment with the first cumulative length that reaches it.
    target = lambda i: F.when(i == F.col("_k"), F.col("_total")).otherwise(F.col("_total") * i / F.col("_k"))
    low, high = F.floor(F.col("_lo") / F.col("_total") * F.col("_k")) - 1, F.ceil(F.col("cum_len") / F.col("_total") * F.col("_k")) + 1
    near = F.sequence(F.greatest(F.lit(0), low.cast("int")), F.least(F.col("_k"), high.cast("int")))
    inside = F.filter(near, lambda i: (target(i) <= F.col("cum_len")) & (target(i) > F.col("_lo")))
    own = F.when(F.col("_i") == 1, F.array(F.lit(0))).otherwise(inside)
    t = F.when(F.col("_i") == 1, F.lit(1.0)).when(F.col("cum_len") > F.col("_lo"), (target(F.col("i")) - F.col("_lo")) / (F.col("cum_len") - F.col("_lo"))).otherwise(0.0)
    long = df.where((F.col("_n") >= 2) & (F.col("_total") >= spacing)).withColumn("i", F.explode(own))
    lerp = lambda a, b: F.when(F.col("_i") == 1, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t)
    long = long.select("key", "i", lerp("_x", "x").alias("x"), lerp("_y", "y").alias("y"))
    short = df.where((F.col("_n") < 2) | (F.col("_total") < spacing)).where("_i = 1 or _i = _n")
    return long.union(short.select("key", F.when(F.col("_i") == 1, 0).otherwise(1).alias("i"), "x", "y"))


def concurrent_subjects(beats: DataFrame, limit: int = 2, shot: tuple[str, ...] = ("shot_id",)) -> DataFrame:
    """(shot_id, left_ms, right_ms, subjects) of elementary intervals with more than `limit` moving subjects.

    beats: shot_id, subject, start_ms, end_ms; `shot` names the columns of a shot's key. Beats that are dealt by their shot stay in place.
    """
    moves = F.coalesce(F.col("end_ms") > F.col("start_ms"), F.lit(False))
    # A subject's overlapping moves count as one, from the first start to the latest end; then one sweep per shot adds starts and takes ends away.
    own = _w([*shot, "subject", "_moves"], ["start_ms", "end_ms"])
    df = beats.withColumn("_moves", moves).withColumn("_reach", F.max("end_ms").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_first", F.coalesce(F.col("start_ms") > F.col("_reach"), F.lit(True))).withColumn("_last", F.coalesce(F.lead("_first").over(own), F.lit(True)))
    step = lambda at, n: F.struct(at.alias("left_ms"), n.alias("n"))
    some = lambda on, n: F.when(F.col("_moves") & on, F.lit(n)).otherwise(F.lit(0))
    ends = F.array(step(F.col("start_ms"), some(F.col("_first"), 1)), step(F.col("end_ms"), F.lit(0)), step(F.greatest("_reach", "end_ms"), some(F.col("_last"), -1)))
    steps = df.select(*shot, F.explode(ends).alias("_s")).groupBy(*shot, "_s.left_ms").agg(F.sum("_s.n").alias("n"))
    w = _w([*shot], ["left_ms"])
    df = steps.select(*shot, "left_ms", F.lead("left_ms").over(w).alias("right_ms"), F.sum("n").over(w).alias("subjects"))
    return df.where(F.col("right_ms").isNotNull() & (F.col("subjects") > limit))


def idle_ratio(elements: DataFrame, scenes: DataFrame, least_ms: int = 3000, share: Decimal | float = Decimal("0.55")) -> DataFrame:
    """Elements drawn for less than `share` of a window of `least_ms` or more; a Decimal is exact, a float is multiplied in doubles. scenes: scene_id, duration_ms."""
    nxt = F.lead("start_ms").over(_w(["scene_id"], ["seq"]))
    df = elements.join(scenes, "scene_id").withColumn("available_ms", F.coalesce(nxt - F.col("start_ms"), F.greatest(F.lit(0), F.col("duration_ms") - F.col("start_ms"))))
    return df.where((F.col("available_ms") >= least_ms) & (F.col("dur_ms") < F.col("available_ms") * F.lit(share))).drop("duration_ms")


def stable_hold(elements: DataFrame, scenes: DataFrame, hold_ms: int = 250, clean_ms: int = 60, final_ms: int = 450) -> DataFrame:
    """(scene_id, rule_id, value): too short a hold before erasing, too short a clean canvas, too short a final hold.

    scenes: scene_id, duration_ms, erase_start_ms, erase_end_ms, clean_end_ms (relative; null without a transition).
    """
    ends = elements.groupBy("scene_id").agg(F.max(F.col("start_ms") + F.col("dur_ms")).alias("end_ms"))
    df = scenes.join(ends, "scene_id", "left").withColumn("end_ms", F.coalesce("end_ms", F.lit(0)))
    hold = F.greatest(F.lit(0), F.coalesce("erase_start_ms", "duration_ms") - F.col("end_ms"))
    clean = F.greatest(F.lit(0), F.col("clean_end_ms") - F.col("erase_end_ms"))
    moved = F.col("erase_start_ms").isNotNull()
    hit = lambda ok, rule, value: F.when(ok, F.struct(F.lit(rule).alias("rule_id"), value.alias("value")))
    rules = F.array_compact(F.array(hit(moved & (hold < hold_ms), "short-hold", hold), hit(moved & (clean < clean_ms), "short-clean", clean), hit(~moved & (hold < final_ms), "short-final-hold", hold)))
    return df.select("scene_id", F.explode(rules).alias("r")).select("scene_id", "r.rule_id", "r.value")


def path_smooth(points: DataFrame, iterations: int = 1) -> DataFrame:
    """Corner cutting: each segment replaced by the points at its quarters, both ends kept. points: key, i, x, y."""
    df = points.select("key", "i", "x", "y")
    for _ in range(iterations):
        w = _w(["key"], ["i"])
        df = df.withColumns({"_x": F.lead("x").over(w), "_y": F.lead("y").over(w), "_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("key"))})
        at = lambda t: F.struct((F.col("x") * (1 - t) + F.col("_x") * t).alias("x"), (F.col("y") * (1 - t) + F.col("_y") * t).alias("y"))
        own = F.struct("x", "y")
        none = F.array().cast("array<struct<x:double,y:double>>")
        cut = F.when(F.col("_n") < 3, F.array(own)).otherwise(F.concat(F.when(F.col("_r") == 1, F.array(own)).otherwise(none), F.when(F.col("_x").isNotNull(), F.array(at(0.25), at(0.75))).otherwise(F.array(own))))
        df = df.select("key", "_r", F.posexplode(cut).alias("_p", "p")).select("key", (F.row_number().over(_w(["key"], ["_r", "_p"])) - 1).alias("i"), "p.x", "p.y")
    return df
