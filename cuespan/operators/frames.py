"""Scene, frame and geometry projections; infeasible rows get a reason instead of an error."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


# Milliseconds of the hand's release, frames of colour at least, and the safe frame as shares of the canvas.
HAND_RELEASE_MS, MIN_COLOR_FRAMES = 180, 8
# Shares of a budget for the frames before colour, the finish and the texture.
BEFORE_SHARE, FINISH_SHARE, TEXTURE_SHARE = 0.20, 0.04, 0.15
PRE_ACTION_MS, POST_ACTION_HOLD_MS, LEAVE_MS = 100, 250, 80
PIXEL_EFFECTS = ("contour-indicate", "highlight-wash", "passing-flash")


def half_even(c: Column) -> Column:
    return F.rint(c.cast("double")).cast("bigint")


def frame_span(start: Column, dur: Column, fps: int | Column) -> Column:
    """Frames that [start, start + dur) covers; null if it has no length."""
    at = lambda x: half_even(x * fps / F.lit(1000.0))
    return F.when(dur > 0, at(start + dur) - at(start))


def phase_frames(total: Column, original: Column, has_texture: Column, fps: int | Column) -> Column:
    """STRUCT<recognition, base_color, texture, finalize, reason>: a frame budget shared among drawing phases.

    Recognition and base colour are protected: what a shorter budget lacks is taken from the
    finish, then from texture.
    """
    before = F.when(original < 8, F.lit(1)).otherwise(F.greatest(F.lit(3), half_even(original * BEFORE_SHARE)))
    release = F.greatest(F.lit(2), half_even(F.lit(fps * HAND_RELEASE_MS / 1000) if isinstance(fps, int) else fps * HAND_RELEASE_MS / 1000))
    base = F.greatest(F.lit(MIN_COLOR_FRAMES), before)
    finish = F.greatest(release, half_even(original * FINISH_SHARE))
    texture = F.when(has_texture, half_even(original * TEXTURE_SHARE)).otherwise(F.lit(0))
    recognition = original - before - finish - texture
    # What colour takes and what the budget lacks come out of the finish, then out of texture. A budget without length takes all.
    extra, spare = base - before, finish - release + texture
    taken = F.coalesce(extra + original - total, spare)
    reason = F.when((total < 1) | (original < total), "invalid-budget").when((recognition < 1) | (extra > spare), "window-too-short").when(taken > spare, "protected-phases")
    value = lambda c: F.when(reason.isNull(), c).cast("bigint")
    return F.struct(value(recognition).alias("recognition"), value(base).alias("base_color"), value(F.least(texture, spare - taken)).alias("texture"), value(F.greatest(release, finish - taken)).alias("finalize"), reason.alias("reason"))


def compile_budget(elements: DataFrame, fps: int = 30) -> DataFrame:
    """Elements (start_ms, dur_ms, original_ms) with their frames, the phases of both budgets and why not."""
    total, original = frame_span(F.col("start_ms"), F.col("dur_ms"), fps), frame_span(F.col("start_ms"), F.col("original_ms"), fps)
    df = elements.withColumns({"total_frames": total, "original_frames": original})
    yes = F.lit(True)
    return df.withColumns({"baseline": phase_frames(F.col("original_frames"), F.col("original_frames"), yes, fps), "phases": phase_frames(F.col("total_frames"), F.col("original_frames"), yes, fps)})


def fits_all_fps(start: np.ndarray, dur: np.ndarray, original: np.ndarray, low: int, high: int) -> np.ndarray:
    """Whether the `phase_frames` of textured elements have no reason at any frame rate from `low` to `high`."""
    out, left = np.zeros(len(start), bool), np.flatnonzero(original > 0)
    for fps in range(low, high + 1):
        # Only elements that fitted so far go on.
        s, d, timed = start[left], dur[left], dur[left] > 0
        first = np.rint(s * fps / 1000.0)
        o, t = np.rint((s + original[left]) * fps / 1000.0) - first, np.rint((s + d) * fps / 1000.0) - first
        before = np.where(o < 8, 1, np.maximum(3, np.rint(o * BEFORE_SHARE)))
        release = max(2, round(fps * HAND_RELEASE_MS / 1000))
        finish, texture = np.maximum(release, np.rint(o * FINISH_SHARE)), np.rint(o * TEXTURE_SHARE)
        taken = np.maximum(MIN_COLOR_FRAMES - before, 0) + np.where(timed, o - t, 0)
        left = left[(~timed | ((t >= 1) & (o >= t))) & (o - before - finish - texture >= 1) & (taken <= finish - release + texture)]
    out[left] = True
    return out


def feasible_all_fps(elements: DataFrame, low: int = 8, high: int = 60) -> DataFrame:
    """Elements (start_ms, dur_ms, original_ms) with `feasible`: whether the phases fit at every frame rate from `low` to `high`."""

    @F.pandas_udf("boolean")
    def fits(start: pd.Series, dur: pd.Series, original: pd.Series) -> pd.Series:
        return pd.Series(fits_all_fps(start.to_numpy(), dur.to_numpy(), original.to_numpy(), low, high))

    length = lambda c: F.when(F.col("start_ms").isNotNull(), F.col(c)).cast("double")
    given = [F.coalesce(c, F.lit(0.0)) for c in (F.col("start_ms").cast("double"), length("dur_ms"), length("original_ms"))]
    return elements.withColumn("feasible", fits(*given))


def effective_reveal(elements: DataFrame, reservations: DataFrame, fps: int = 30) -> DataFrame:
    """Applies timing reservations (scene_id, element_id, original_ms, revised_ms) once; adds rule_id where one may not be.

    elements: scene_id, element_id, seq, start_ms, dur_ms, reserved_from_ms (null unless already applied).
    """
    one = reservations.groupBy("scene_id", "element_id").agg(F.count("*").alias("_n"), F.min("original_ms").alias("_o"), F.min("revised_ms").alias("_r"))
    df = elements.join(one, ["scene_id", "element_id"], "left")
    again = (F.col("dur_ms") == F.col("_r")) & F.col("reserved_from_ms").eqNullSafe(F.col("_o"))
    frames = phase_frames(frame_span(F.col("start_ms"), F.col("_r"), fps), frame_span(F.col("start_ms"), F.col("_o"), fps), F.lit(True), fps)["reason"]
    rule = (
        F.when(F.col("_n").isNull() & F.col("reserved_from_ms").isNotNull(), "reservation-outside-plan").when(F.col("_n") > 1, "duplicate-target")
        .when((F.col("dur_ms") != F.col("_o")) & ~again, "stale-base").when(~((F.col("_r") > 0) & (F.col("_r") < F.col("_o"))), "invalid-duration").when(F.col("_n").isNotNull() & frames.isNotNull(), "infeasible-budget")
    )
    apply = F.col("_n").isNotNull() & F.col("_rule").isNull()
    df = df.withColumn("_rule", rule)
    return df.select("scene_id", "element_id", "seq", "start_ms", F.when(apply, F.col("_r")).otherwise(F.col("dur_ms")).alias("dur_ms"), F.when(apply, F.col("_o")).otherwise(F.col("reserved_from_ms")).alias("reserved_from_ms"), F.col("_rule").alias("rule_id"))


def plan_phases(events: DataFrame) -> DataFrame:
    """(event_id, phase, start_ms, end_ms) of events (event_id, start_ms, budget_ms, effect, has_path)."""
    s, e = F.col("start_ms"), F.col("start_ms") + F.col("budget_ms")
    ready = F.least(e, s + PRE_ACTION_MS)
    rest = F.greatest(F.lit(0), e - ready)
    limit = lambda lo, hi, x: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    phase = lambda name, a, b: F.struct(F.lit(name).alias("phase"), a.cast("bigint").alias("start_ms"), b.cast("bigint").alias("end_ms"))

    def held(name, hold):
        done = F.least(e, ready + limit(400, 650, rest - hold - LEAVE_MS))
        leave = F.least(e, F.greatest(done + hold, e - LEAVE_MS))
        return F.array(phase("prepare", s, ready), phase(name, ready, done), phase("hold", done, leave), phase("leave", leave, e))

    drawn = F.least(e, ready + limit(200, 650, rest - 400 - 400 - LEAVE_MS))
    moved = F.least(e, drawn + limit(400, 550, e - drawn - 400 - LEAVE_MS))
    kept = F.least(e, moved + 400)
    push = F.array(phase("prepare", s, ready), phase("draw", ready, drawn), phase("camera", drawn, moved), phase("hold", moved, F.greatest(moved, kept)), phase("leave", kept, e))
    begin = s + PRE_ACTION_MS
    end = F.greatest(begin + 1, e - POST_ACTION_HOLD_MS - LEAVE_MS)
    leave = F.greatest(end, e - LEAVE_MS)
    plain = F.array(phase("prepare", s, begin), phase("draw", begin, end), phase("hold", end, leave), phase("leave", leave, e))
    effect = F.col("effect")
    all_ = F.when(effect.isin(*PIXEL_EFFECTS), held("accent", POST_ACTION_HOLD_MS)).when((effect == "focus-push") & ~F.col("has_path"), held("camera", 400)).when(effect == "focus-push", push).otherwise(plain)
    return events.select("event_id", F.explode(all_).alias("p")).select("event_id", "p.phase", "p.start_ms", "p.end_ms")


def clamp_geometry(elements: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """Boxes rounded to whole pixels and kept on the canvas."""
    at = lambda c, most: F.least(F.greatest(half_even(F.col(c)), F.lit(0)), F.lit(max(0, most - 1)))
    df = elements.withColumns({"_x": at("x", width), "_y": at("y", height)})
    size = lambda c, p, most: F.least(F.greatest(F.lit(1), half_even(F.col(c))), F.greatest(F.lit(1), most - F.col(p)))
    return df.withColumns({"w": size("w", "_x", width), "h": size("h", "_y", height)}).withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y")


def transform_region(elements: DataFrame, scale: Column, dx: Column, dy: Column, width: int = 1920, height: int = 1080) -> DataFrame:
    """Boxes scaled and moved, kept on the canvas, 1 pixel large at least."""
    def span(p, s, d, most):
        a = F.greatest(F.lit(0), F.least(F.lit(most - 1), half_even(F.col(p) * scale + d)))
        return a, F.greatest(a + 1, F.least(F.lit(most), half_even((F.col(p) + F.col(s)) * scale + d)))

    (x0, x1), (y0, y1) = span("x", "w", dx, width), span("y", "h", dy, height)
    return elements.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1}).withColumns({"x": F.col("_x0"), "y": F.col("_y0"), "w": F.col("_x1") - F.col("_x0"), "h": F.col("_y1") - F.col("_y0")}).drop("_x0", "_x1", "_y0", "_y1")


def time_shift(timeline: DataFrame, offsets: DataFrame) -> DataFrame:
    """Points (project_id, at_ms) moved by the project's prefix_ms and kept within duration_ms."""
    moved = F.greatest(F.lit(0), F.least(F.col("duration_ms") - 1, F.col("at_ms") + F.col("prefix_ms")))
    return timeline.join(offsets, "project_id").withColumn("at_ms", moved).drop("prefix_ms", "duration_ms")


def char_timing(words: DataFrame) -> DataFrame:
    """(project_id, idx, pos, char, start_ms, end_ms): a word's time spread evenly over its letters and digits."""
    # Empty words go only when they are letters: a filter before that would split each word once more to see if it is empty.
    df = words.select("project_id", "idx", "start_ms", "end_ms", F.split(F.regexp_replace("text", r"[^\p{L}\p{N}_]", ""), "").alias("_l"))
    df = df.withColumn("_n", F.size("_l")).withColumn("_span", F.greatest(F.col("start_ms") + F.col("_n"), F.col("end_ms")) - F.col("start_ms"))
    df = df.select("project_id", "idx", "start_ms", "_n", "_span", F.posexplode_outer("_l").alias("pos", "char")).where("char <> ''")
    at = lambda i: half_even(F.col("start_ms") + F.col("_span") * i / F.col("_n"))
    return df.select("project_id", "idx", "pos", F.lower("char").alias("char"), at(F.col("pos")).alias("start_ms"), F.greatest(at(F.col("pos")) + 1, at(F.col("pos") + 1)).alias("end_ms"))
