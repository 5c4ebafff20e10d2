"""Greedy segmentation: state depends on the decision before, so each key's rows are folded in order inside Catalyst.

A fold holds the rows of one key in one array. Where the state surely resets, as at a long pause,
keys are cut there first and the parts are folded, so only a part must fit and a key may be of any
size. `group_scenes` and `suggest_composition` have no such place: the one doubles jumps from scene to
scene, the other puts maps from choice to choice together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cuespan.functions.text import CAPTION_PUNCTUATION, visible_length
from cuespan.operators.tables import dropped, running_totals, written

# Letters that end a clause, those that end a sentence first.
MAJOR, MINOR = "。！？!?；;\n", "，,、：:"


def ordered_rows(df: DataFrame, key: str | list[str], fields: list[str]) -> DataFrame:
    """(key, rows): each key's rows as structs, sorted by their fields in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))


def parts_from(df: DataFrame, partition: list[str], order: list[str], begins: Column) -> DataFrame:
    """Adds _part: rows from one that begins a part up to the next, within each key."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_begins", F.coalesce(begins, F.lit(True)).cast("int")).withColumn("_part", F.sum("_begins").over(w)).drop("_begins")


#: Width of the time slots in which cue ends are looked up.
SLOT_MS = 60_000


def first_ends(cues: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project_id, i, kind, j): the first cue j whose end is not before `at` of (project_id, i, kind, at), null if there is none.

    cues: project_id, i, end_ms, and ends do not fall with i. Ends and wanted times are sorted together
    within slots of time; where a slot has no answer, the first end of a later slot is it.
    """
    slot = lambda c: F.floor(F.col(c) / SLOT_MS)
    no = F.lit(None).cast("bigint")
    both = cues.select("project_id", slot("end_ms").alias("slot"), F.col("end_ms").alias("at"), F.lit(0).alias("kind"), no.alias("i"), F.col("i").alias("j"))
    both = both.union(wanted.select("project_id", slot("at"), "at", "kind", "i", no))
    later = Window.partitionBy("project_id").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = both.groupBy("project_id", "slot").agg(F.min("j").alias("_j")).withColumn("_later", F.min("_j").over(later)).drop("_j")
    inside = Window.partitionBy("project_id", "slot").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("j", F.min("j").over(inside)).where("kind > 0").join(slots, ["project_id", "slot"])
    return found.select("project_id", "i", "kind", F.coalesce("j", "_later").alias("j"))


def group_scenes(cues: DataFrame, target_s: float = 30, min_s: float = 25, max_s: float = 35) -> DataFrame:
    """(project_id, scene_no, start_ms, end_ms, first_cue, last_cue): cues joined until a scene is long enough.

    For each cue it is looked up where a scene that begins there ends, and so where the next one
    begins. The scenes that come about from the first cue are then found by doubling: the jumps over 1, 2, 4, ...
    scenes, each made of the one before. No task holds a project. Projects in which a cue ends before an
    earlier one did, as no well-formed file has, are folded whole.
    """
    rows = cues.select("project_id", "cue_no", "start_ms", "end_ms", F.lit(1).cast("bigint").alias("i"))
    ranked = written(running_totals(rows, "project_id", ["cue_no", "start_ms", "end_ms"], ["i"]))
    follow = ranked.select("project_id", (F.col("i") + 1).alias("i"), F.col("end_ms").alias("_before"))
    odd = written(ranked.join(follow, ["project_id", "i"]).where("end_ms < _before").select("project_id").distinct())
    even = ranked.join(odd, "project_id", "left_anti")

    full, most = math.ceil(max(target_s, min_s) * 1000), math.floor(max_s * 1000)
    wanted = even.select("project_id", "i", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("start_ms") + after).alias("at")) for k, after in ((1, full), (2, most + 1))])).alias("w"))
    ends = first_ends(even, wanted.select("project_id", "i", "w.kind", "w.at")).groupBy("project_id", "i").agg(F.max(F.when(F.col("kind") == 1, F.col("j"))).alias("full"), F.max(F.when(F.col("kind") == 2, F.col("j"))).alias("over"))
    # A cue that is too long on its own still belongs to its scene.
    over = F.greatest("over", F.when(F.col("over").isNotNull(), F.col("i") + 1))
    cut = F.col("full").isNotNull() & (over.isNull() | (F.col("full") < over))
    ends = written(ends.select("project_id", "i", F.when(cut, F.col("full") + 1).otherwise(over).alias("next")))

    exists = even.select("project_id", F.col("i").alias("next"))
    jump = written(ends.where("next is not null").join(exists, ["project_id", "next"], "left_semi").select("project_id", "i", "next"))
    begins, first = written(even.where("i = 1").select("project_id", "i")), jump
    while not jump.isEmpty():
        more = begins.join(jump, ["project_id", "i"]).select("project_id", F.col("next").alias("i"))
        twice = jump.join(jump.select("project_id", F.col("i").alias("next"), F.col("next").alias("_next")), ["project_id", "next"]).select("project_id", "i", F.col("_next").alias("next"))
        old, begins = begins, written(begins.union(more))
        last, jump = jump, written(twice)
        dropped(old, *([last] if last is not first else []))
    dropped(jump)

    # A scene reaches to the cue before the next one's first, or to the last cue.
    size = even.groupBy("project_id").agg(F.max("i").alias("_n"))
    scenes = begins.join(ends, ["project_id", "i"], "left").join(size, "project_id").select("project_id", "i", F.least(F.col("next") - 1, "_n").alias("last"))
    head = even.select("project_id", "i", "start_ms", F.col("cue_no").alias("first_cue"))
    tail = even.select("project_id", F.col("i").alias("last"), "end_ms", F.col("cue_no").alias("last_cue"))
    scenes = scenes.join(head, ["project_id", "i"]).join(tail, ["project_id", "last"])
    scenes = scenes.withColumn("scene_no", F.row_number().over(Window.partitionBy("project_id").orderBy("i")))
    columns = ["project_id", "scene_no", "start_ms", "end_ms", "first_cue", "last_cue"]
    return scenes.select(*columns).union(fold_scenes(cues.join(odd, "project_id", "left_semi"), target_s, min_s, max_s).select(*columns))


def fold_scenes(cues: DataFrame, target_s: float, min_s: float, max_s: float) -> DataFrame:
    """What `group_scenes` gives, by a fold over all cues of a project."""
    rows = ordered_rows(cues, "project_id", ["cue_no", "start_ms", "end_ms"])
    kind = "struct<a:bigint,b:bigint,f:bigint,l:bigint>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))

    def scene(a, b, f, last):
        return F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), f.cast("bigint").alias("f"), last.cast("bigint").alias("l"))

    def fold(state, c):
        o = state["open"]
        long = o.isNotNull() & (c["end_ms"] - o["a"] > max_s * 1000)
        done = F.when(long, F.concat(state["done"], F.array(o))).otherwise(state["done"])
        now = F.when(long | o.isNull(), scene(c["start_ms"], c["end_ms"], c["cue_no"], c["cue_no"])).otherwise(scene(o["a"], c["end_ms"], o["f"], c["cue_no"]))
        full = (now["b"] - now["a"] >= target_s * 1000) & (now["b"] - now["a"] >= min_s * 1000)
        return F.struct(F.when(full, F.concat(done, F.array(now))).otherwise(done).alias("done"), F.when(~full, now).alias("open"))

    out = F.aggregate("rows", start, fold, lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    df = rows.select("project_id", F.posexplode(out).alias("i", "s"))
    return df.select("project_id", (F.col("i") + 1).alias("scene_no"), F.col("s.a").alias("start_ms"), F.col("s.b").alias("end_ms"), F.col("s.f").alias("first_cue"), F.col("s.l").alias("last_cue"))


def clean_length(text: Column) -> Column:
    return F.char_length(F.trim(F.translate(text, CAPTION_PUNCTUATION, "")))


def pack_words(words: DataFrame, max_chars: int = 18, max_ms: int = 3600, pause_ms: int = 420, sep: str = "") -> DataFrame:
    """(project_id, cue_no, start_ms, end_ms, text): words packed into captions by letters, length and pauses."""
    pause = F.col("start_ms") - F.lag("end_ms").over(Window.partitionBy("project_id").orderBy("idx")) > pause_ms
    rows = ordered_rows(parts_from(words, ["project_id"], ["idx"], pause), ["project_id", "_part"], ["idx", "text", "start_ms", "end_ms"])
    kind = "struct<a:bigint,b:bigint,t:string>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))
    cue = lambda a, b, t: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), t.alias("t"))

    def fold(state, w):
        o = state["open"]
        joined = F.concat(o["t"], F.lit(sep), w["text"])
        cut = (clean_length(joined) > max_chars) | (w["end_ms"] - o["a"] > max_ms) | (w["start_ms"] - o["b"] > pause_ms)
        fresh = cue(w["start_ms"], w["end_ms"], w["text"])
        return (
            F.when(o.isNull(), F.struct(state["done"].alias("done"), fresh.alias("open")))
            .when(cut, F.struct(F.concat(state["done"], F.array(o)).alias("done"), fresh.alias("open")))
            .otherwise(F.struct(state["done"].alias("done"), cue(o["a"], w["end_ms"], joined).alias("open")))
        )

    out = F.aggregate("rows", start, fold, lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    clean = F.transform(out, lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.trim(F.translate(c["t"], CAPTION_PUNCTUATION, "")).alias("t")))
    df = rows.select("project_id", "_part", F.posexplode(F.filter(clean, lambda c: c["t"] != "")).alias("i", "c"))
    number = F.row_number().over(Window.partitionBy("project_id").orderBy("_part", "i"))
    return df.select("project_id", number.alias("cue_no"), F.col("c.a").alias("start_ms"), F.col("c.b").alias("end_ms"), F.col("c.t").alias("text"))


def clause_atoms(scripts: DataFrame) -> DataFrame:
    """(project_id, atom_no, text, start_idx, end_idx, major): clauses at authored punctuation, with offsets in letters and digits.

    Clauses without any are left out, and what they lack does not move the offsets; the last clause ends a sentence.
    """
    ends = "".join(f"\\x{{{ord(c):x}}}" for c in MAJOR + MINOR)
    raw = F.regexp_extract_all("text", F.lit(f"([^{ends}]*[{ends}]|[^{ends}]+$)"), F.lit(1))
    df = scripts.select("project_id", F.posexplode(raw).alias("i", "raw")).withColumn("_n", visible_length("raw"))
    w = Window.partitionBy("project_id").orderBy("i")
    df = df.withColumn("end_idx", F.sum("_n").over(w)).where("_n > 0")
    last = F.lead("i").over(w).isNull()
    major = F.right("raw", F.lit(1)).isin(*MAJOR) | last
    return df.select("project_id", (F.row_number().over(w) - 1).alias("atom_no"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text"), (F.col("end_idx") - F.col("_n")).alias("start_idx"), "end_idx", major.alias("major"))


def suppress_near(df: DataFrame, gap_ms: int = 35, partition: str = "project_id", at: str = "at_ms", tie: str = "label") -> DataFrame:
    """Rows at least `gap_ms` behind the last one kept; of rows at one time the one with the least `tie`.

    A row that far behind the row before it is surely kept, so keys are cut there and only what lies close is folded.
    """
    df = df.groupBy(partition, at).agg(F.min(tie).alias(tie))
    far = F.col(at) - F.lag(at).over(Window.partitionBy(partition).orderBy(at)) >= gap_ms
    rows = ordered_rows(parts_from(df, [partition], [at], far), [partition, "_part"], [at, tie])
    start = F.array().cast(rows.schema["rows"].dataType)
    fold = lambda kept, r: F.when((F.size(kept) == 0) | (r[at] - F.element_at(kept, -1)[at] >= gap_ms), F.concat(kept, F.array(r))).otherwise(kept)
    return rows.select(partition, F.explode(F.aggregate("rows", start, fold)).alias("r")).select(partition, f"r.{at}", f"r.{tie}")


def detect_cuts(peaks: DataFrame, durations: DataFrame, min_scene_ms: int = 500) -> DataFrame:
    """(video_id, scene_no, start_ms, end_ms): scenes between peaks that keep `min_scene_ms` from the cut before and the end.

    peaks: video_id, time_ms; durations: video_id, duration_ms, a row per video.
    """
    cand = peaks.join(durations, "video_id").where((F.col("duration_ms") - F.col("time_ms") >= min_scene_ms) & (F.col("time_ms") >= min_scene_ms)).select("video_id", F.col("time_ms").cast("bigint").alias("at_ms"))
    starts = cand.union(durations.select("video_id", F.lit(0).cast("bigint"))).withColumn("label", F.lit(""))
    df = suppress_near(starts, min_scene_ms, "video_id").join(durations, "video_id")
    w = Window.partitionBy("video_id").orderBy("at_ms")
    return df.select("video_id", F.row_number().over(w).alias("scene_no"), F.col("at_ms").alias("start_ms"), F.coalesce(F.lead("at_ms").over(w), F.col("duration_ms")).alias("end_ms"))


def state_runs(frames: DataFrame, state: str = "state") -> DataFrame:
    """(key, run, state, start, end, length): longest runs of equal state and the path length within each."""
    w = Window.partitionBy("key").orderBy("frame")
    new = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    df = frames.withColumns({"_d": F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), "_new": new}).withColumn("run", F.sum("_new").over(w))
    return df.groupBy("key", "run").agg(F.first(state).alias("state"), F.min("frame").alias("start"), F.max("frame").alias("end"), F.coalesce(F.sum(F.when(F.col("_new") == 0, F.col("_d"))), F.lit(0.0)).alias("length"))


#: Scenes whose choices are followed in one array.
BLOCK = 256


def _state_before(maps: DataFrame) -> DataFrame:
    """Maps (project_id, i, k, a, b, …), i from 0, with what was chosen `before` each; what else a map has goes with it.

    A map takes the choice before it to `a` if that is `k`, else to `b`. Two maps one after another are such a map
    again, so BLOCK of them are put together at a time, and blocks of blocks, as long as there is more than one.
    """
    then = lambda m, x: F.when(x == m["k"], m["a"]).otherwise(m["b"])
    blocks = maps.withColumn("block", F.floor(F.col("i") / BLOCK)).groupBy("project_id", "block").agg(F.array_sort(F.collect_list(F.struct("i", *[c for c in maps.columns if c not in ("project_id", "i")]))).alias("rows"))
    if (maps.agg(F.max("i")).first()[0] or 0) < BLOCK:
        blocks = blocks.withColumn("before", F.lit(""))
    else:
        first = F.struct(*[F.col("rows")[0][c].alias(c) for c in ("i", "k", "a", "b")])
        one = F.aggregate(F.expr("slice(rows, 2, size(rows))"), first, lambda m, x: F.struct(m["i"].alias("i"), m["k"].alias("k"), then(x, m["a"]).alias("a"), then(x, m["b"]).alias("b")))
        whole = written(blocks.select("project_id", F.col("block").alias("i"), one.alias("m")).select("project_id", "i", "m.k", "m.a", "m.b"))
        blocks = blocks.join(_state_before(whole).select("project_id", F.col("i").alias("block"), "before").hint("merge"), ["project_id", "block"])
    steps = F.aggregate("rows", F.array(F.col("before")), lambda done, m: F.concat(done, F.array(then(m, F.element_at(done, -1)))))
    out = blocks.select("project_id", F.explode(F.arrays_zip("rows", F.slice(steps, F.lit(1), F.size("rows")).alias("before"))).alias("z"))
    return out.select("project_id", "z.rows.*", "z.before")


def _choices(scenes: DataFrame, rules: list[tuple[str, list[str]]], fallbacks: list[str], *keep: str) -> DataFrame:
    """(project_id, seq, i, composition, suggested, *keep) of `suggest_composition`; i is the scene's place in its project, from 0."""
    hits = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains("text", t)), F.lit(name)) for name, terms in rules]))
    given = F.nullif(F.trim("composition"), F.lit("")) if "composition" in scenes.columns else F.lit(None).cast("string")
    # Written first, so that the ranges are found by reading these rows and not by making the scenes once more.
    placed = written(scenes.select("project_id", "seq", hits.alias("hits"), given.alias("given"), F.lit(1).cast("bigint").alias("i"), *keep))
    rows = running_totals(placed, "project_id", ["seq"], ["i"]).withColumn("i", F.col("i") - 1)
    n, all_ = len(fallbacks), F.array(*map(F.lit, fallbacks))
    turn = (F.col("i") % n).cast("int")
    order = F.concat("hits", F.slice(all_, turn + 1, F.lit(n)), F.slice(all_, F.lit(1), turn))
    rows = rows.withColumn("_first", F.coalesce("given", order[0]))
    second = F.coalesce("given", F.get(F.filter(order, lambda c: c != F.col("_first")), F.lit(0)), F.lit(fallbacks[0]))
    rows = written(rows.select("project_id", "i", F.col("_first").alias("k"), second.alias("a"), F.col("_first").alias("b"), "seq", F.col("given").isNull().alias("suggested"), *keep))
    dropped(placed)
    return _state_before(rows).select("project_id", "seq", "i", F.when(F.col("before") == F.col("k"), F.col("a")).otherwise(F.col("b")).alias("composition"), "suggested", *keep)


def suggest_composition(scenes: DataFrame, rules: list[tuple[str, list[str]]], fallbacks: list[str]) -> DataFrame:
    """(project_id, seq, composition, suggested): the first class whose terms occur and that is not the scene before's, else a rotating one.

    scenes: project_id, seq, text, and where given composition, which stays unless it is blank. What a scene takes is a
    map from what the one before took, with two values at most; maps are put together block by block,
    so no array holds a project.
    """
    return _choices(scenes, rules, fallbacks).drop("i")


def compile_draft(scenes: DataFrame, elements: DataFrame, rules: list[tuple[str, list[str]]], fallbacks: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Draft scenes and elements with what they lack filled in, and the changes (project_id, seq, element_no, change, value).

    scenes: project_id, seq, scene_id, text, composition; elements: project_id, seq, element_no, element_id, trigger_text, and the
    aliases triggerText and narrationEvidence. A missing scene id counts from 01, an element id goes by its scene and place,
    a blank trigger text takes the first alias that is not blank.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    two = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(c.cast("string"))), F.lit("0"))
    keys = ["project_id", "seq"]
    missing = F.coalesce("scene_id", F.lit("")) == ""
    scene_id = F.when(missing, F.concat(F.lit("scene-"), two(F.col("i") + 1))).otherwise(F.trim("scene_id"))
    chosen = written(_choices(scenes, rules, fallbacks, "scene_id").select(*keys, scene_id.alias("scene_id"), "composition", "suggested", missing.alias("_new")))
    # Written tables look small to Spark, as they are compressed; without the hint it would send them whole through the driver.
    filled = scenes.drop("scene_id", "composition").join(chosen.hint("merge"), keys)
    filled = filled.select(*keys, *[c for c in scenes.columns if c not in (*keys, "composition")], "composition")

    alias = F.when(~blank("triggerText"), F.lit("triggerText")).when(~blank("narrationEvidence"), F.lit("narrationEvidence"))
    # What can be told without the scene is told before the join, so that one text of an element is shuffled and not three.
    own = elements.withColumns({"_new": blank("element_id"), "_from": F.when(blank("trigger_text"), alias)})
    own = own.withColumn("trigger_text", F.when(F.col("_from") == "triggerText", F.trim("triggerText")).when(F.col("_from") == "narrationEvidence", F.trim("narrationEvidence")).otherwise(F.col("trigger_text")))
    own = own.join(chosen.select(*keys, "scene_id").hint("merge"), keys)
    own = own.withColumn("element_id", F.when(F.col("_new"), F.concat("scene_id", F.lit("-e"), two(F.col("element_no")))).otherwise(F.col("element_id")))

    def changes(df, no, *said):
        found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(change).alias("change"), value.alias("value"))) for when, change, value in said]))
        return df.select(*keys, no.cast("bigint").alias("element_no"), F.explode(found).alias("c")).select(*keys, "element_no", "c.*")

    told = changes(chosen, F.lit(None), (F.col("_new"), "generated-scene-id", F.col("scene_id")), (F.col("suggested"), "selected-composition", F.col("composition")))
    told = told.union(changes(own.where("_new or _from is not null"), F.col("element_no"), (F.col("_new"), "generated-element-id", F.col("element_id")), (F.col("_from").isNotNull(), "trigger-text-from", F.col("_from"))))
    return filled, own.drop("_new", "_from"), told
