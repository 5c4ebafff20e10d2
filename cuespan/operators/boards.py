"""Boards as relations: masks as runs of pixels in rows, boxes, points; no image is ever one row per pixel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cuespan.functions.text import compact
from cuespan.operators.joins import placed_in
from cuespan.operators.tables import dropped, written

# The safe frame as shares of the canvas, and of it what a board may fill.
SAFE = {"left": 0.04, "top": 0.04, "right": 0.96, "bottom": 0.82}
FILL = 0.94
#: Rows of a board that are joined together.
ROW_BUCKET = 64
#: Groups of boxes that are compared without more ado, and how often a round's pointers are followed.
CROWD, JUMPS = 64, 2


def mask_ownership(runs: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owner runs (board_id, y, x0, x1, element_id or null, claims) and counts per element (board_id, element_id, pixels, contested).

    runs: board_id, y, x0, x1 of foreground; selections: board_id, element_id, area, y, x0, x1, the
    rows of each element's mask. Of overlapping selections the smaller region owns a pixel, then the
    smaller id. Rows are split at all ends of runs and selections, so pieces have one set of claims.
    """
    # A claim begins with what it is ranked by, so that the least one owns.
    claim = F.struct("area", "element_id", "x0", "x1").alias("c")
    both = runs.select("board_id", "y", F.struct("x0", "x1").alias("f")).unionByName(selections.select("board_id", "y", claim), allowMissingColumns=True)
    # A row of pixels at a time: all its runs and claims are in two arrays, and no piece is joined with anything.
    rows = both.groupBy("board_id", "y").agg(F.collect_list("f").alias("fg"), F.collect_list("c").alias("claims")).where("size(fg) > 0")
    rows = rows.withColumn("ends", F.sort_array(F.array_distinct(F.concat("fg.x0", "fg.x1", "claims.x0", "claims.x1"))))
    pieces = F.arrays_zip(F.slice("ends", F.lit(1), F.size("ends") - 1).alias("x0"), F.slice("ends", F.lit(2), F.size("ends") - 1).alias("x1"))
    over = lambda x: (x["x0"] <= F.col("p.x0")) & (F.col("p.x1") <= x["x1"])
    rows = rows.select("board_id", "y", "fg", "claims", F.explode_outer(pieces).alias("p")).where(F.exists("fg", over))
    rows = rows.select("board_id", "y", "p.x0", "p.x1", F.filter("claims", over).alias("hit"))
    owned = rows.select("board_id", "y", "x0", "x1", F.array_min("hit")["element_id"].alias("element_id"), F.size(F.array_distinct("hit.element_id")).alias("claims"))
    size = F.col("x1") - F.col("x0")
    counts = owned.groupBy("board_id", "element_id").agg(F.sum(size).alias("pixels"), F.sum(F.when(F.col("claims") > 1, size).otherwise(0)).alias("contested"))
    return owned, counts


def mask_risk(owned: DataFrame, elements: DataFrame, band: int = 6, least: int = 12) -> DataFrame:
    """(board_id, element_id, side, inside, outside): edges of regions with foreground in the band on both sides, so cut through.

    owned: board_id, y, x0, x1; elements: board_id, element_id, x, y, w, h.
    """
    x, y, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    bands = {
        "left": ((x, x + band, y, y1), (x - band, x, y, y1)), "right": ((x1 - band, x1, y, y1), (x1, x1 + band, y, y1)),
        "top": ((x, x1, y, y + band), (x, x1, y - band, y)), "bottom": ((x, x1, y1 - band, y1), (x, x1, y1, y1 + band)),
    }
    # Elements meet the rows they reach by buckets of rows, as a board may hold many of both; the bands are told apart only then.
    rows = owned.select("board_id", F.expr(f"floor(y / {ROW_BUCKET})").alias("_slot"), F.col("y").alias("ry"), F.col("x0").alias("rx0"), F.col("x1").alias("rx1"))
    df = elements.select("board_id", "element_id", "x", "y", "w", "h", F.explode(F.sequence(F.floor((F.least(y, y1) - band) / ROW_BUCKET), F.floor((F.greatest(y, y1) + band - 1) / ROW_BUCKET))).alias("_slot"))
    near = (F.col("rx0") < F.greatest(x, x1) + band) & (F.col("rx1") > F.least(x, x1) - band) & (F.col("ry") >= F.least(y, y1) - band) & (F.col("ry") < F.greatest(y, y1) + band)
    hit = df.join(rows, ["board_id", "_slot"]).where(near)
    n = lambda a, b, c, d: F.sum(F.when((F.col("ry") >= c) & (F.col("ry") < d) & (F.col("rx0") < b) & (F.col("rx1") > a), F.least("rx1", b) - F.greatest("rx0", a)))
    sums = hit.groupBy("board_id", "element_id").agg(*[n(*b).alias(f"{side}_{i}") for side, both in bands.items() for i, b in enumerate(both)])
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_0").alias("inside"), F.col(f"{side}_1").alias("outside")) for side in bands])
    out = sums.select("board_id", "element_id", F.explode(sides).alias("_b")).select("board_id", "element_id", "_b.*").where("inside is not null or outside is not null")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("inside", "outside")})
    return out.where((F.col("inside") >= least) & (F.col("outside") >= least))


def nearest_centroid(points: DataFrame, least: int) -> DataFrame:
    """(point_id, group_id): points (board_id, point_id, group_id, x, y); groups of fewer than `least` join the large group with the nearest centre.

    Without a large group all stay as they are.
    """
    sizes = points.groupBy("board_id", "group_id").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    large = sizes.where(F.col("n") >= least).select("board_id", F.col("group_id").alias("to"), F.col("cx").alias("lx"), F.col("cy").alias("ly"))
    near = sizes.where(F.col("n") < least).join(large, "board_id")
    d = (F.col("cx") - F.col("lx")) * (F.col("cx") - F.col("lx")) + (F.col("cy") - F.col("ly")) * (F.col("cy") - F.col("ly"))
    moved = near.groupBy("board_id", "group_id").agg(F.min_by("to", F.struct(F.round(d, 6), "to")).alias("to"))
    return points.join(moved, ["board_id", "group_id"], "left").select("point_id", F.coalesce("to", "group_id").alias("group_id"))


def _nearest_touched(hulls: DataFrame, margin: int, leaders: bool) -> DataFrame:
    """(board_id, component_id, to): the smallest component whose box touches this one, if it is smaller.

    Boxes are posted in a grid whose cells are as wide as they are, so in four cells at most, and looked up in
    all grids of their board that are as coarse or coarser. With `leaders` only the largest box of a cell is
    looked up: that joins a heap of boxes without comparing all of its pairs.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1)) + margin
    boxes = hulls.withColumn("_level", F.ceil(F.log2(side)).cast("int"))
    grids = boxes.groupBy("board_id").agg(F.array_sort(F.collect_set("_level")).alias("_levels"))  # one per power of two
    cells = lambda lo, hi, level: F.sequence(F.floor((F.col(lo) - margin) / F.pow(F.lit(2.0), F.col(level))), F.floor((F.col(hi) + margin) / F.pow(F.lit(2.0), F.col(level))))

    def posted(df: DataFrame, level: str) -> DataFrame:
        return df.withColumn("_cx", F.explode(cells("x0", "x1", level))).withColumn("_cy", F.explode(cells("y0", "y1", level)))

    key = ["board_id", "_level", "_cx", "_cy"]
    held = posted(boxes, "_level").select(*key, F.struct("component_id", "x0", "y0", "x1", "y1", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")).alias("b"))
    if leaders:
        held = held.groupBy(*key).agg(F.max_by("b", F.struct("b.area", "b.component_id")).alias("b"))
    asked = boxes.join(grids, "board_id").withColumn("_level", F.explode(F.expr("filter(_levels, l -> l >= _level)")))
    hit = posted(asked, "_level").join(held.hint("merge"), key)
    touch = F.col("component_id") != F.col("b.component_id")
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        touch = touch & (F.col(lo) <= F.col(f"b.{hi}") + margin) & (F.col(f"b.{lo}") <= F.col(hi) + margin)
    hit = hit.where(touch).select("board_id", F.least("component_id", "b.component_id").alias("to"), F.greatest("component_id", "b.component_id").alias("component_id"))
    return hit.groupBy("board_id", "component_id").agg(F.min("to").alias("to"))


#: Groups of a board that are compared with one another, without a grid.
FEW = 16


def _nearest_of_few(hulls: DataFrame, margin: int) -> DataFrame:
    """What `_nearest_touched` gives, for boards of FEW groups at most: they lie in one array, so no cell is shuffled."""
    boards = hulls.groupBy("board_id").agg(F.collect_list(F.struct("component_id", "x0", "y0", "x1", "y1")).alias("all"))

    def smaller(b: Column) -> Column:
        out = b["component_id"] < F.col("a.component_id")
        for lo, hi in (("x0", "x1"), ("y0", "y1")):
            out = out & (F.col(f"a.{lo}") <= b[hi] + margin) & (b[lo] <= F.col(f"a.{hi}") + margin)
        return out

    to = F.array_min(F.transform(F.filter("all", smaller), lambda b: b["component_id"]))
    return boards.select("board_id", "all", F.explode("all").alias("a")).select("board_id", "a.component_id", to.alias("to")).where("to is not null")


def box_components(boxes: DataFrame, margin: int = 2) -> DataFrame:
    """(board_id, box_id, component_id): boxes that touch are one group, whose own box then may touch others, until nothing changes.

    boxes: board_id, box_id, x0, y0, x1, y1, whole numbers; ids are not null and unique on their board. A round points each
    group's box at the smallest group it touches and follows the pointers on, so the groups of a
    board that still touch are halved at least. A board where nothing touches is done and leaves. Boards of more than CROWD
    groups look at the largest box of a cell alone as long as that joins any. Rounds are written to the
    shared folder; component_id is the smallest box_id of the group.
    """
    live = written(boxes.select("board_id", "box_id", "x0", "y0", "x1", "y1", F.col("box_id").alias("component_id")))
    done = []
    while True:
        # Dealt by board once, so that the groups and their number need no other shuffle.
        hulls = live.repartition("board_id").groupBy("board_id", "component_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        hulls = written(hulls.withColumn("n", F.count("*").over(Window.partitionBy("board_id"))))
        few, many = _nearest_of_few(hulls.where(F.col("n") <= FEW), margin), hulls.where(F.col("n") > FEW)
        crowded = written(many.where(F.col("n") > CROWD).select("board_id").distinct())
        if many.isEmpty():
            quick, step = None, written(few)
        elif crowded.isEmpty():
            quick, step = None, written(few.union(_nearest_touched(many, margin, leaders=False)))
        else:
            quick = written(_nearest_touched(many.join(crowded.hint("merge"), "board_id", "left_semi"), margin, leaders=True))
            rest = many.join(quick.select("board_id").distinct().hint("merge"), "board_id", "left_anti")
            step = written(few.union(quick).union(_nearest_touched(rest, margin, leaders=False)))
        # Written tables look small to Spark, as they are compressed; without the hint it would send them whole through the driver.
        moving = step.select("board_id").distinct().hint("merge")
        done.append(written(live.join(moving, "board_id", "left_anti").select("board_id", "box_id", "component_id")))
        if step.isEmpty():
            dropped(live, hulls, crowded, quick, step)
            break
        root = step
        for _ in range(JUMPS):
            again = root.select("board_id", F.col("component_id").alias("to"), F.col("to").alias("_to"))
            root = root.join(again.hint("merge"), ["board_id", "to"], "left").select("board_id", "component_id", F.coalesce("_to", "to").alias("to"))
        moved = live.join(moving, "board_id", "left_semi").join(root.hint("merge"), ["board_id", "component_id"], "left")
        before, live = live, written(moved.select("board_id", "box_id", "x0", "y0", "x1", "y1", F.coalesce("to", "component_id").alias("component_id")))
        dropped(before, hulls, crowded, quick, step)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


#: How often a layout that keeps its centre may shrink, and by what.
SHRINKS, SHRINK = 240, 0.995


def fit_safe_area(boards: DataFrame, keep_layout: bool = False) -> DataFrame:
    """(board_id, applied, scale, dx, dy, reason): how to scale and place a board so that its foreground fits the safe frame.

    boards: board_id, width, height (source), tw, th (target), x0, y0, x1, y1 (foreground, null if none). The foreground is centred in
    the frame; with `keep_layout` the canvas keeps its centre and shrinks step by step until the foreground fits.
    """
    edge = lambda size, side: F.bround(F.col(size) * SAFE[side]).cast("bigint")
    df = boards.withColumns({"l": edge("tw", "left"), "t": edge("th", "top"), "r": edge("tw", "right"), "b": edge("th", "bottom")})
    bw, bh = F.greatest(F.lit(1), F.col("x1") - F.col("x0")), F.greatest(F.lit(1), F.col("y1") - F.col("y0"))
    whole = F.least(F.col("tw") / F.col("width"), F.col("th") / F.col("height"))
    scale = F.least(whole, (F.col("r") - F.col("l")) * FILL / bw, (F.col("b") - F.col("t")) * FILL / bh)
    safe = (F.col("tw") == F.col("width")) & (F.col("th") == F.col("height")) & (F.col("x0") >= F.col("l")) & (F.col("y0") >= F.col("t")) & (F.col("x1") <= F.col("r")) & (F.col("y1") <= F.col("b"))
    df = df.withColumn("s", scale).withColumn("reason", F.when(F.col("x0").isNull(), "no-foreground").when(safe & (F.col("s") >= 0.985), "already-safe"))
    nearest = lambda c: F.bround(c).cast("bigint")
    if keep_layout:
        names = ["tw", "th", "width", "height", "x0", "y0", "x1", "y1", "l", "t", "r", "b", "whole"]

        def shrunk(batches):
            # Boards of a batch shrink together, step by step as one by one; those that fit are left alone.
            for batch in batches:
                v = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names])
                s, place = v[-1].copy(), np.full((2, len(batch)), np.nan)
                live = np.flatnonzero(batch.column("reason").is_null().to_numpy(zero_copy_only=False))
                for _ in range(SHRINKS):
                    if not len(live):
                        break
                    tw, th, width, height, x0, y0, x1, y1, left, top, right, bottom, _ = v[:, live]
                    k = s[live]
                    dx, dy = np.rint((tw - width * k) / 2), np.rint((th - height * k) / 2)
                    place[:, live] = dx, dy
                    inside = (np.rint(x0 * k + dx) >= left) & (np.rint(y0 * k + dy) >= top) & (np.rint(x1 * k + dx) <= right) & (np.rint(y1 * k + dy) <= bottom)
                    live = live[~inside]
                    s[live] *= SHRINK
                out = [pa.array(s, mask=np.isnan(s)), *(pa.array(np.nan_to_num(c).astype(np.int64), mask=np.isnan(c)) for c in place)]
                yield pa.RecordBatch.from_arrays([batch.column("board_id"), *out, batch.column("reason")], ["board_id", "s", "dx", "dy", "reason"])

        key = df.schema["board_id"].dataType.simpleString()
        df = df.withColumn("whole", whole.cast("double")).select("board_id", "reason", *names).mapInArrow(shrunk, f"board_id {key}, s double, dx bigint, dy bigint, reason string")
        scale, dx, dy = F.col("s"), F.col("dx"), F.col("dy")
    else:
        shift = lambda lo, hi, a, b: nearest((F.col(lo) + F.col(hi)) / 2 - (F.col(a) + F.col(b)) / 2 * F.col("s"))
        scale, dx, dy = F.col("s"), shift("l", "r", "x0", "x1"), shift("t", "b", "y0", "y1")
    on = lambda c: F.when(F.col("reason").isNull(), c)
    return df.select("board_id", F.col("reason").isNull().alias("applied"), F.round(on(scale), 6).alias("scale"), on(dx).alias("dx"), on(dy).alias("dy"), "reason")


def reconcile_ids(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(scene_id, place, actual_id, element_id, rule_id): which planned element each drawn one is.

    actual: scene_id, place, actual_id, source_ids, label, trigger; expected: scene_id, place, element_id, label, trigger.
    In order of place an element takes its own id or the first of its source ids that is planned and free; then, again in
    order, one that shares its label, or else its trigger, with exactly one planned element that is free takes that.
    Others are `unresolved`. A scene with another number of elements than planned is `count-differs`, one
    that plans an id twice `repeated-id`; nothing is matched there. A scene's elements, those of one drawing, are folded as an array.
    """
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    drawn = actual.select("scene_id", F.struct("place", F.coalesce("actual_id", F.lit("")).alias("id"), F.coalesce("source_ids", F.array().cast("array<string>")).alias("sources"), text("label").alias("label"), text("trigger").alias("trigger")).alias("r"))
    planned = expected.select("scene_id", F.struct("place", F.col("element_id").alias("id"), text("label").alias("label"), text("trigger").alias("trigger")).alias("r"))
    lists = lambda df, name: df.groupBy("scene_id").agg(F.array_sort(F.collect_list("r")).alias(name))
    df = lists(drawn, "a").join(lists(planned, "p"), "scene_id")
    df = df.withColumn("ids", F.transform("p", lambda x: x["id"]))
    df = df.withColumn("rule", F.when(F.size("a") != F.size("p"), "count-differs").when(F.size(F.array_distinct("ids")) != F.size("ids"), "repeated-id"))

    def take(state: Column, pick: Column) -> Column:
        free = F.when(pick.isNull(), state["free"]).otherwise(F.array_remove(state["free"], F.coalesce(pick, F.lit(""))))
        return F.struct(free.alias("free"), F.concat(state["got"], F.array(pick)).alias("got"))

    def direct(state: Column, e: Column) -> Column:
        own = F.concat(F.array(e["id"]), F.filter(e["sources"], lambda x: x != ""))
        return take(state, F.get(F.filter(own, lambda x: F.array_contains(state["free"], x)), F.lit(0)))

    def alike(state: Column, e: Column) -> Column:
        same = lambda x: ((e["a"]["label"] != "") & (x["label"] == e["a"]["label"])) | ((e["a"]["trigger"] != "") & (x["trigger"] == e["a"]["trigger"]))
        found = F.array_distinct(F.transform(F.filter(F.col("p"), lambda x: same(x) & F.array_contains(state["free"], x["id"])), lambda x: x["id"]))
        return take(state, F.when(e["got"].isNotNull(), F.lit(None)).when(F.size(found) == 1, found[0]))

    none = F.array().cast("array<string>")
    df = df.withColumn("one", F.aggregate("a", F.struct(F.col("ids").alias("free"), none.alias("got")), direct))
    pairs = F.arrays_zip(F.col("a"), F.col("one.got").alias("got"))
    df = df.withColumn("two", F.aggregate(pairs, F.struct(F.col("one.free").alias("free"), none.alias("got")), alike))
    df = df.select("scene_id", "rule", F.explode(F.arrays_zip(F.col("a"), F.col("one.got").alias("x"), F.col("two.got").alias("y"))).alias("z"))
    found = F.when(F.col("rule").isNull(), F.coalesce("z.x", "z.y"))
    return df.select("scene_id", "z.a.place", F.col("z.a.id").alias("actual_id"), found.alias("element_id"), F.coalesce("rule", F.when(found.isNull(), "unresolved")).alias("rule_id"))


def resolve_beat_anchor(beats: DataFrame, words: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """Beats with the word they begin at: anchor_id, start_ms and rule_id.

    beats: project_id, scene_id, beat_no, word_id, phrase; words: project_id, scene_id, word_id, text, start_ms, end_ms. A word id of the
    project decides, and must lie in the beat's scene (`outside-scene`); if there is no such word, the phrase does, wherever it
    stands in the scene's words, across their borders, if it stands there once (`no-anchor`). White space and case make no difference.
    A scene that is not in `scenes` (without: of no word) is `unknown-scene`.
    """
    # Beats and words meet as rows of one table, by word and then by scene, so that words which lie by project stay where they are and are made once.
    scene = "project_id", "scene_id"
    known = F.col("project_id").isNotNull() & F.col("word_id").isNotNull()
    word = F.struct(F.col("word_id").alias("idx"), compact("text").alias("token"), "start_ms", "end_ms").alias("_w")
    rows = beats.select(*scene, "word_id", F.struct("beat_no", "phrase").alias("_b")).unionByName(words.select(*scene, "word_id", word, F.when(known, F.struct("scene_id", "start_ms")).alias("_own")), allowMissingColumns=True)
    rows = rows.withColumn("_own", F.max("_own").over(Window.partitionBy("project_id", "word_id"))).where("_b is not null or project_id is not null and scene_id is not null")
    phrase = F.when(F.col("_own").isNull(), F.col("_b.phrase"))
    asked = F.struct(*scene, F.col("_b.beat_no").alias("beat_no"), "word_id", "_own", phrase.alias("phrase"), compact(phrase).alias("_needle"))
    rows = rows.select(*scene, F.when(F.col("_b").isNotNull(), asked).alias("_p"), "_w")
    if scenes is not None:
        rows = rows.unionByName(scenes.dropna(subset=scene).select(*scene).distinct().withColumn("_in", F.lit(True)), allowMissingColumns=True)
    df = placed_in(rows, [*scene, "beat_no", "word_id", "_own", "phrase"], scene, (F.max("_in") if scenes is not None else F.max(F.when(F.col("_w").isNotNull(), 1))).isNotNull())
    own, inside = F.col("_own").isNotNull(), F.col("_own.scene_id") == F.col("scene_id")
    anchor = F.when(~F.col("known"), F.lit(None)).when(~own, F.col("idx")).when(inside, F.col("word_id"))
    rule = F.when(~F.col("known"), "unknown-scene").when(own & ~inside, "outside-scene").when(anchor.isNull(), "no-anchor")
    start = F.when(anchor.isNotNull(), F.when(own, F.col("_own.start_ms")).otherwise(F.col("start_ms")))
    return df.select("project_id", "scene_id", "beat_no", anchor.alias("anchor_id"), start.alias("start_ms"), rule.alias("rule_id"))


# Boxes of the preset layouts as shares of the canvas, the preset by number of elements, and a title card's share.
LAYOUTS = {
    "single": [(0.05, 0.07, 0.90, 0.72)],
    "side-by-side": [(0.05, 0.07, 0.43, 0.72), (0.52, 0.07, 0.43, 0.72)],
    "three-step": [(0.05, 0.07, 0.27, 0.72), (0.365, 0.07, 0.27, 0.72), (0.68, 0.07, 0.27, 0.72)],
    "hero-side": [(0.05, 0.07, 0.54, 0.72), (0.63, 0.07, 0.32, 0.34), (0.63, 0.45, 0.32, 0.34)],
    "grid-2x2": [(x, y, 0.43, 0.34) for y in (0.07, 0.45) for x in (0.05, 0.52)],
    "grid-3x2": [(x, y, 0.27, 0.34) for y in (0.07, 0.45) for x in (0.05, 0.365, 0.68)],
}
LAYOUT_OF_COUNT = {1: "single", 2: "side-by-side", 3: "three-step", 4: "grid-2x2", 5: "grid-3x2", 6: "grid-3x2"}
CONTENT_TOP, CONTENT_BOTTOM, CARD_TOP = 0.07, 0.79, 0.16
# Fixed values of focus targets: share kept on each side, margin, where captions start, and the fewest pixels.
FOCUS_LOW, FOCUS_HIGH, FOCUS_MARGIN, LEAST_MARGIN, CAPTIONS_TOP = 0.02, 0.98, 0.02, 14, 0.84
FEW_PIXELS, FEW_SHARE = 25, 0.00035


def layout_allocate(elements: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes (shot_id, element_id, template, x, y, w, h) by the preset for the number of elements, and violations (shot_id, rule_id).

    elements: shot_id, element_id, seq, template (null: by number); cards: shot_id of shots with a
    title card, whose boxes are pressed below it. Shots without 1 to 6 different elements, or with
    a template of another size, have no boxes.
    """
    spark = elements.sparkSession
    scale = (CONTENT_BOTTOM - CARD_TOP) / (CONTENT_BOTTOM - CONTENT_TOP)
    slots = []
    for name, boxes in LAYOUTS.items():
        for i, (x, y, w, h) in enumerate(boxes, 1):
            slots += [(name, i, False, x, y, w, h), (name, i, True, x, round(CARD_TOP + (y - CONTENT_TOP) * scale, 4), w, round(h * scale, 4))]
    slots = spark.createDataFrame(slots, "template string, _i int, _card boolean, x double, y double, w double, h double")
    per_shot = Window.partitionBy("shot_id")
    own = F.coalesce(*[F.when(F.col("_n") == n, F.lit(t)) for n, t in LAYOUT_OF_COUNT.items()])
    size = F.coalesce(*[F.when(F.col("template") == t, F.lit(len(b))) for t, b in LAYOUTS.items()])
    df = elements.withColumns({"_n": F.count("*").over(per_shot), "_i": F.row_number().over(per_shot.orderBy("seq")), "_twice": F.count("*").over(Window.partitionBy("shot_id", "element_id")) > 1})
    df = df.withColumn("template", F.coalesce("template", own)).join(cards.select("shot_id").distinct().withColumn("_has", F.lit(True)), "shot_id", "left").withColumn("_card", F.coalesce("_has", F.lit(False)))
    fits = (size == F.col("_n")) | ((F.col("template") == "grid-3x2") & (F.col("_n") == 5))
    df = df.withColumn("_bad", F.when(~F.col("_n").between(1, 6), "element-count").when(F.max("_twice").over(per_shot), "repeated-element").when(~F.coalesce(fits, F.lit(False)), "template-size"))
    boxes = df.where("_bad is null").join(F.broadcast(slots), ["template", "_i", "_card"])  # the presets: a few dozen rows
    return boxes.select("shot_id", "element_id", "template", "x", "y", "w", "h"), df.where("_bad is not null").select("shot_id", F.col("_bad").alias("rule_id")).distinct()


def focus_target(runs: DataFrame, elements: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """`focus_of_masks` of runs (board_id, element_id, y, x0, x1), the rows of pixels an element owns; elements: board_id, element_id, x, y, w, h."""
    key = ["board_id", "element_id"]
    return focus_of_masks(elements.join(runs.groupBy(*key).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("runs")), key, "left"), width, height)


def focus_of_masks(elements: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """(board_id, element_id, x, y, w, h, confidence, source): the box that holds the middle 96 % of an element's own pixels each way.

    elements: board_id, element_id, x, y, w, h and runs, an array of (y, x0, x1): the rows of pixels it owns, so nothing is shuffled.
    Pixels are clipped to the region and to what captions leave free. Too
    few pixels, or no room within the margins, give the region itself with little confidence.
    """
    safe = max(1, int(height * CAPTIONS_TOP))
    box = elements.select("board_id", "element_id", F.col("x").alias("rx0"), F.col("y").alias("ry0"), (F.col("x") + F.col("w")).alias("rx1"), (F.col("y") + F.col("h")).alias("ry1"), "runs")
    clip = lambda c, lo, hi: F.greatest(F.lit(lo) if isinstance(lo, int) else lo, F.least(F.lit(hi), c))
    box = box.withColumns({"cx0": clip(F.col("rx0"), 0, width - 1), "cy0": clip(F.col("ry0"), 0, height - 1)})
    box = box.withColumns({"cx1": clip(F.least("rx1", F.lit(width)), F.col("cx0") + 1, width), "cy1": clip(F.least("ry1", F.lit(safe)), F.col("cy0") + 1, height)})
    whole = ["rx0", "ry0", "rx1", "ry1", "cx0", "cy0", "cx1", "cy1"]
    stats = ["xl", "xh", "yl", "yh"]
    shares = FOCUS_LOW, FOCUS_HIGH

    def percentiles(batches):
        for batch in batches:
            runs = batch.column("runs")
            own = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
            y, x0, x1 = (c.to_numpy(zero_copy_only=False) for c in runs.flatten().flatten())
            cx0, cy0, cx1, cy1 = (batch.column(c).to_numpy(zero_copy_only=False)[own] for c in whole[4:])
            a, b = np.maximum(x0, cx0), np.minimum(x1, cx1)
            keep = (y >= cy0) & (y < cy1) & (a < b)
            own, y, a, b = (c[keep].astype(np.int64) for c in (own, y, a, b))
            # Columns: ends of runs in order, and how many runs there are from each to the next; rows: the runs themselves.
            ends = np.concatenate([own * (width + 1) + a, own * (width + 1) + b])
            order = np.argsort(ends, kind="stable")
            ends, deep = ends[order], np.cumsum(np.where(order < len(own), 1, -1))[:-1]
            some = (deep > 0) & (ends[1:] > ends[:-1])
            first = np.argsort(own * (height + 1) + y, kind="stable")
            columns = ends[:-1][some] % (width + 1), deep[some], (deep * np.diff(ends))[some]
            rows = y[first], (b - a)[first], (b - a)[first]
            total = np.bincount(own, weights=b - a, minlength=len(batch)).astype(np.int64)
            before, none, out = np.cumsum(total) - total, total == 0, []
            for at, n, size in (columns, rows):
                upto = np.cumsum(size)

                def held(k):
                    i = np.minimum(np.searchsorted(upto, before + k, side="right"), len(upto) - 1)
                    return at[i] + (before + k - (upto - size)[i]) // n[i] if len(upto) else np.zeros(len(batch))

                for share in shares:
                    rank = np.maximum(total - 1, 0)
                    low = np.floor(rank * share).astype(np.int64)
                    value = held(low)
                    out.append(pa.array(value + (held(np.minimum(low + 1, rank)) - value) * (rank * share - low), pa.float64(), mask=none))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("board_id", "element_id", *whole)), *out, pa.array(total, mask=none)], ["board_id", "element_id", *whole, *stats, "n"])

    key = ", ".join(f"{c} {box.schema[c].dataType.simpleString()}" for c in ("board_id", "element_id"))
    df = box.select("board_id", "element_id", *[F.col(c).cast("bigint").alias(c) for c in whole], "runs")
    df = df.mapInArrow(percentiles, f"{key}, {', '.join(f'{c} bigint' for c in whole)}, {', '.join(f'{c} double' for c in stats)}, n bigint")
    margin = max(LEAST_MARGIN, round(min(width, height) * FOCUS_MARGIN))
    whole = lambda c: F.bround(c).cast("bigint")
    df = df.withColumns({
        "bx0": F.greatest(F.col("rx0"), F.lit(margin), whole(F.col("xl")) - margin), "by0": F.greatest(F.col("ry0"), F.lit(margin), whole(F.col("yl")) - margin),
        "bx1": F.least(F.col("rx1"), F.lit(width - margin), whole(F.col("xh") + 1) + margin), "by1": F.least(F.col("ry1"), F.lit(safe - 2), whole(F.col("yh") + 1) + margin),
        "area": F.greatest(F.lit(1), (F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))),
    })
    enough = F.coalesce((F.col("n") >= F.greatest(F.lit(FEW_PIXELS), F.bround(F.col("area") * FEW_SHARE))) & (F.col("bx1") > F.col("bx0")) & (F.col("by1") > F.col("by0")), F.lit(False))
    density = F.col("n") / F.col("area")
    sure = F.least(F.lit(0.99), 0.55 + F.least(F.lit(0.28), density * 5.0) + F.least(F.lit(0.16), (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")) / F.lit(float(width * height))))
    on = lambda a, b: F.when(enough, a).otherwise(b)
    return df.select(
        "board_id", "element_id", on(F.col("bx0"), F.col("cx0")).alias("x"), on(F.col("by0"), F.col("cy0")).alias("y"), on(F.col("bx1") - F.col("bx0"), F.col("cx1") - F.col("cx0")).alias("w"), on(F.col("by1") - F.col("by0"), F.col("cy1") - F.col("cy0")).alias("h"),
        F.round(on(sure, F.lit(0.12)), 4).alias("confidence"), on(F.lit("foreground-pixels"), F.lit("annotation-region-low-confidence")).alias("source"),
    )
