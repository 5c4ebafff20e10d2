"""Top-k, sampling, ordered picks and set operations, all with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cuespan.operators.folds import suppress_near
from cuespan.operators.frames import POST_ACTION_HOLD_MS, PRE_ACTION_MS, feasible_all_fps

# Milliseconds and confidence an effect needs, the bounds of the time kept free for one, and what it adds to a candidate's priority.
EFFECT_MIN_MS = {"focus-push": 1200}
LEAST_RESERVE_MS, MOST_RESERVE_MS = 900, 1200
EFFECT_CONFIDENCE, OTHER_CONFIDENCE = {"focus-push": 0.75}, 0.65
EFFECT_BONUS = {"focus-push": 0.8, "passing-flash": 0.7, "highlight-wash": 0.6, "contour-indicate": 0.5}


def top_event_per_scene(candidates: DataFrame) -> DataFrame:
    """Candidates (scene_id, seq, effect, confidence, budget_ms, action_start_ms, is_last) with priority, and why not chosen.

    One viable candidate of a scene is chosen: the highest priority, the earliest on a tie.
    """
    bonus = F.coalesce(*[F.when(F.col("effect") == e, F.lit(v)) for e, v in EFFECT_BONUS.items()], F.lit(0.0))
    priority = F.col("confidence") * 3.0 + F.least(F.lit(2.0), F.col("budget_ms") / 1800) + F.when(F.col("is_last"), 1.0).otherwise(0.0) + bonus
    need = F.coalesce(*[F.when(F.col("effect") == e, F.lit(v)) for e, v in EFFECT_CONFIDENCE.items()], F.lit(OTHER_CONFIDENCE))
    room = F.coalesce(*[F.when(F.col("effect") == e, F.lit(v)) for e, v in EFFECT_MIN_MS.items()])
    reason = F.when(room.isNull(), "effect-not-offered").when(F.col("confidence") < need, "low-confidence").when(F.col("budget_ms") < room, "window-too-short")
    df = candidates.withColumns({"priority": F.round(priority, 6), "reason": reason})
    nth = F.row_number().over(Window.partitionBy("scene_id", F.col("reason").isNull()).orderBy(F.desc("priority"), "action_start_ms", "seq"))
    df = df.withColumn("_nth", nth)
    return df.withColumn("reason", F.coalesce("reason", F.when(F.col("_nth") > 1, "lower-priority"))).drop("_nth")


def top3_rules(scored: DataFrame, default: list[str]) -> DataFrame:
    """(doc_id, winner, candidates): rules by score, then by their order; documents without hits take the default. scored: doc_id, rule_no, rule_id, score (0 allowed)."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "rule_no")
    ranked = scored.withColumn("n", F.row_number().over(w)).where("n <= 3")
    lists = ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("score") > 0, F.struct("n", "rule_id")))), lambda x: x["rule_id"]).alias("c"))
    c = F.when(F.size("c") > 0, F.col("c")).otherwise(F.array(*map(F.lit, default)))
    return lists.select("doc_id", c[0].alias("winner"), c.alias("candidates"))


def worst_events(violations: DataFrame, n: int = 5) -> DataFrame:
    """The n largest values of each key, ties by frame and kind."""
    w = Window.partitionBy("key").orderBy(F.desc(F.coalesce("value", F.lit(0.0))), "frame", "kind")
    return violations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pick_caption_track(tracks: DataFrame, language: Column) -> DataFrame:
    """One track per video (video_id, lang, ext, url, source): native before automatic, original first, json3 before vtt."""
    tag = F.lower("lang")
    fits = (F.split_part(F.replace(tag, F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)) == language) & F.col("ext").isin("json3", "vtt") & (F.col("url") != "")
    rank = F.struct((F.col("source") != "native").alias("a"), (~F.endswith(tag, F.lit("-orig"))).alias("b"), F.col("lang").alias("c"), (F.col("ext") != "json3").alias("d"), F.col("url").alias("e"))
    best = tracks.where(fits).groupBy("video_id").agg(F.min_by(F.struct("lang", "url", "ext", "source"), rank).alias("t"))
    return best.select("video_id", "t.*")


def ordered_events(events: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Adds ordinal, the place in a total order."""
    return events.withColumn("ordinal", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def even_sample(df: DataFrame, k: int, partition: list[str], order: list[str]) -> DataFrame:
    """k rows of a partition at even ranks, the first and the last included; all rows if there are k or fewer."""
    w = Window.partitionBy(*partition)
    df = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    if k <= 1:
        return df.where("_i = 0" if k == 1 else "false").drop("_i", "_n")
    step = (F.col("_n") - 1) / F.lit(float(k - 1))
    near = F.floor(F.col("_i") / step)
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):  # the sample number that rounds to this rank is next to rank / step
        hit = hit | ((near + d >= 0) & (near + d <= k - 1) & (F.bround((near + d) * (F.col("_n") - 1) / F.lit(float(k - 1))) == F.col("_i")))
    return df.where((F.col("_n") <= k) | hit).drop("_i", "_n")


def pick_keyframes(scenes: DataFrame, k: int = 20, opening=(0, 1000, 2000, 3000), grid_ms: int = 5000) -> DataFrame:
    """(video_id, time_ms): the opening seconds and an even sample of scene middles and a grid, k in all."""
    ends = scenes.groupBy("video_id").agg(F.max("end_ms").alias("end"))
    first = ends.select("video_id", "end", F.explode(F.array(*[F.lit(t).cast("bigint") for t in opening[:k]])).alias("time_ms")).where("time_ms < end").select("video_id", "time_ms")
    middle = scenes.select("video_id", F.expr("(start_ms + end_ms) div 2").alias("time_ms"))
    grid = ends.where(F.col("end") > grid_ms).select("video_id", F.explode(F.sequence(F.lit(grid_ms).cast("bigint"), F.col("end") - 1, F.lit(grid_ms).cast("bigint"))).alias("time_ms"))
    rest = middle.union(grid).distinct().join(first, ["video_id", "time_ms"], "left_anti")
    used = first.groupBy("video_id").agg((k - F.count("*")).alias("_k"))
    w = Window.partitionBy("video_id")
    rest = rest.join(used, "video_id").withColumns({"_i": F.row_number().over(w.orderBy("time_ms")) - 1, "_n": F.count("*").over(w)})
    ranks = F.transform(F.sequence(F.lit(0), F.col("_k").cast("int") - 1), lambda i: F.bround(i * (F.col("_n") - 1) / (F.col("_k") - 1).cast("double")))
    kept = rest.where((F.col("_n") <= F.col("_k")) | ((F.col("_k") > 1) & F.array_contains(ranks, F.col("_i").cast("double"))) | ((F.col("_k") == 1) & (F.col("_i") == 0)))
    return first.union(kept.select("video_id", "time_ms")).distinct()


def feasible_first(candidates: DataFrame, low: int = 8, high: int = 60) -> DataFrame:
    """The reveal to shorten in each scene where no effect has room: one row (scene_id, seq, effect, original_ms, dur_ms, reserved_ms, compressed_ms).

    candidates: scene_id, seq, effect, confidence, start_ms, dur_ms, boundary_ms (up to where there is room), budget_ms (what there is
    already). Only effects that may be planned count, with a target sure enough. A scene with one that has room
    keeps its times. Else candidates come by confidence, later ones first; the first whose drawing, ended early enough for the effect, is
    shorter than now and still has its protected phases at every frame rate is shortened. Scene and sound stay as they are.
    """
    least = F.coalesce(*[F.when(F.col("effect") == e, F.lit(ms)) for e, ms in EFFECT_MIN_MS.items()])
    sure = F.coalesce(*[F.when(F.col("effect") == e, F.lit(c)) for e, c in EFFECT_CONFIDENCE.items()])
    df = candidates.withColumn("_least", least).where(F.col("_least").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= sure))
    roomy = df.where(F.col("budget_ms") >= F.col("_least")).select("scene_id").distinct()
    df = df.join(roomy, "scene_id", "left_anti").withColumn("reserved_ms", F.greatest(F.lit(LEAST_RESERVE_MS), F.least(F.lit(MOST_RESERVE_MS), "_least")))
    df = df.withColumn("original_ms", F.col("dur_ms")).withColumn("dur_ms", F.col("boundary_ms") - POST_ACTION_HOLD_MS - F.col("reserved_ms") - PRE_ACTION_MS - F.col("start_ms"))
    df = feasible_all_fps(df.where("dur_ms < original_ms and dur_ms > 0"), low, high).where("feasible")
    first = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("confidence"), F.desc("seq")))
    df = df.withColumn("_n", first).where("_n = 1").withColumn("compressed_ms", F.col("original_ms") - F.col("dur_ms"))
    return df.select("scene_id", "seq", "effect", "original_ms", "dur_ms", "reserved_ms", "compressed_ms")


def id_set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids in one table only."""
    x, y = a.select(F.col(key).alias("key")), b.select(F.col(key).alias("key"))
    return x.subtract(y).select("key", F.lit("missing").alias("side")).union(y.subtract(x).select("key", F.lit("unexpected")))


def dedupe_keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def multiset_equal(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that one table has more often than the other; none if they are equal."""
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).withColumn("side", F.lit("left")).union(y.exceptAll(x).withColumn("side", F.lit("right")))


def sfx_plan(parts: list[DataFrame], scenes: DataFrame) -> DataFrame:
    """Sound events of several sources, in order of preference: clipped to their scene, the first of a scene and effect kept.

    parts: scene_id, effect, start_ms, end_ms, repeatable; scenes: scene_id, scene_start_ms, scene_end_ms.
    """
    all_ = None
    for rank, part in enumerate(parts):
        part = part.select("scene_id", "effect", "start_ms", "end_ms", "repeatable", F.lit(rank).alias("source"))
        all_ = part if all_ is None else all_.unionByName(part)
    df = all_.join(scenes, "scene_id").withColumns({"start_ms": F.greatest("start_ms", "scene_start_ms"), "end_ms": F.least("end_ms", "scene_end_ms")}).where("end_ms > start_ms")
    w = Window.partitionBy("scene_id", "effect").orderBy("source", "start_ms", "end_ms")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1 or repeatable").select("scene_id", "effect", "source", "start_ms", "end_ms")


# Fixed values of the review: frames at most, and kinds that are always kept; offsets in milliseconds.
REVIEW_FRAMES, REVIEW_ANCHORS, NEAR_MS = 48, ("first", "last", "caption-mid"), 35
AFTER_ELEMENT_MS, BEFORE_END_MS, BEFORE_ERASE_MS, BEFORE_LAST_MS = 40, 80, 125, 40


def review_targets(projects: DataFrame, scenes: DataFrame, elements: DataFrame, events: DataFrame, transitions: DataFrame, cues: DataFrame, cap: int = REVIEW_FRAMES) -> DataFrame:
    """(project_id, time_ms, kind, label): the frames to look at, in order, none within 35 ms of the one kept before, `cap` at most.

    projects: project_id, duration_ms, prefix_ms; scenes: project_id, scene_id, start_ms, end_ms;
    elements: scene_id, seq, element_id, start_ms, dur_ms, of which each scene's last counts;
    events: project_id, event_id, start_ms, end_ms, of which each project's longest counts;
    transitions: scene_id, to_scene, erase_start_ms, erase_end_ms, next_word_ms; cues: project_id,
    cue_no, start_ms, end_ms. Beyond the cap, frames of REVIEW_ANCHORS stay and an even sample of the others.
    """
    target = lambda at, kind, label: F.struct(at.cast("bigint").alias("raw_ms"), F.lit(kind).alias("kind"), label.alias("label"))
    say = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    c = F.col
    last = elements.groupBy("scene_id").agg(F.max_by(F.struct("seq", "element_id", F.col("start_ms").alias("s"), F.col("dur_ms").alias("d")), F.struct("seq", "element_id")).alias("e"))
    df = scenes.join(last, "scene_id", "left").join(transitions, "scene_id", "left")
    mark = say(c("scene_id"), "-", c("e.seq"), "-", c("e.element_id"))
    stable = F.greatest(c("start_ms"), F.when(c("erase_start_ms").isNotNull(), c("erase_start_ms") - BEFORE_ERASE_MS).otherwise(c("end_ms") - BEFORE_END_MS))
    half = F.greatest(F.lit(1), F.floor((c("erase_end_ms") - c("erase_start_ms")) / 2))
    of_scene = F.array(
        F.when(c("e").isNotNull(), target(c("start_ms") + c("e.s") + F.floor(c("e.d") / 2), "hand-drawn-mid", say(mark, "-mid"))),
        F.when(c("e").isNotNull(), target(F.least(c("end_ms") - 1, c("start_ms") + c("e.s") + c("e.d") + AFTER_ELEMENT_MS), "element-end", say(mark, "-complete"))),
        target(stable, "scene-end", say(c("scene_id"), "-end")),
        F.when(c("erase_start_ms").isNotNull(), target(c("erase_start_ms") + half, "eraser-mid", say(c("scene_id"), "-eraser-mid"))),
        F.when(c("erase_start_ms").isNotNull(), target(c("next_word_ms"), "next-scene-first-word", say(c("to_scene"), "-first-word"))),
    )
    parts = [df.select("project_id", F.explode(F.array_compact(of_scene)).alias("t"))]
    length = F.greatest(F.lit(1), c("end_ms") - c("start_ms"))
    longest = events.groupBy("project_id").agg(F.max(F.struct(length.alias("n"), c("start_ms").alias("s"), c("end_ms").alias("z"), c("event_id").cast("string").alias("id"))).alias("v"))
    parts.append(longest.select("project_id", F.explode(F.array(
        target(c("v.s"), "animation-start", say(c("v.id"), "-start")), target(c("v.s") + F.floor(c("v.n") / 2), "animation-mid", say(c("v.id"), "-mid")), target(c("v.z"), "animation-complete", say(c("v.id"), "-complete")),
    )).alias("t")))
    w = Window.partitionBy("project_id")
    placed = cues.withColumns({"_i": F.row_number().over(w.orderBy("cue_no")) - 1, "_n": F.count("*").over(w)})
    placed = placed.where("_i = least(_n - 1, _n div 3) or _i = least(_n - 1, (2 * _n) div 3)")
    parts.append(placed.select("project_id", target(F.floor((c("start_ms") + c("end_ms")) / 2), "caption-mid", say("caption-", F.when(c("_i") < 9, "0").otherwise(""), c("_i") + 1)).alias("t")))
    parts.append(projects.select("project_id", F.explode(F.array(target(F.lit(0), "first", F.lit("first-frame")), target(F.greatest(F.lit(0), c("duration_ms") - BEFORE_LAST_MS), "last", F.lit("last-frame")))).alias("t")))
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.union(part)
    df = all_.select("project_id", "t.*").join(projects, "project_id").withColumn("raw_ms", c("raw_ms") + F.coalesce("prefix_ms", F.lit(0)))
    time = F.greatest(F.lit(0), F.least(c("duration_ms") - 1, "raw_ms"))
    kept = suppress_near(df.select("project_id", time.alias("at_ms"), F.struct("raw_ms", "kind", "label").alias("label")), NEAR_MS)
    kept = kept.select("project_id", c("at_ms").alias("time_ms"), "label.kind", "label.label")
    anchor = c("kind").isin(*REVIEW_ANCHORS)
    kept = kept.withColumns({"_all": F.count("*").over(w), "_room": cap - F.sum(anchor.cast("int")).over(w), "_anchor": anchor})
    free = Window.partitionBy("project_id", "_anchor")
    kept = kept.withColumns({"_i": F.row_number().over(free.orderBy("time_ms", "kind", "label")) - 1, "_n": F.count("*").over(free)})
    ranks = F.transform(F.sequence(F.lit(0), F.greatest(c("_room"), F.lit(1)) - 1), lambda i: F.bround(i * ((c("_n") - 1) / F.greatest(F.lit(1), c("_room") - 1))).cast("int"))
    sampled = (c("_room") > 0) & ((c("_n") <= c("_room")) | F.array_contains(ranks, c("_i").cast("int")))
    return kept.where((c("_all") <= cap) | c("_anchor") | sampled).select("project_id", "time_ms", "kind", "label")
