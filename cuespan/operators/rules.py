"""Keyword classes and data-quality rules. Rules return violations: keys, rule_id, severity, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cuespan.functions.text import casefold, char_class_counts, compact, has_punct, norm_text, normalize_language, safe_id, visible_length

# Words of labels that name a connector, and relations one may stand for.
CONNECTOR_LABELS = ("箭头", "关系线", "连接线", "流程线", "指向线", "arrow")
RELATIONS = ("direction", "causal", "process", "flow", "distance", "comparison", "trend")
# Fixed values of annotations: what a drawing plan may say, and the bounds of its numbers.
DRAWING = {
    "mode": ("layered", "legacy"), "stroke_planner": ("semantic-v2", "reading-bands-v1"), "color_schedule": ("object-progressive-v1", "scene-final-v1"),
    "pixel_ownership": ("semantic-masks-v1", "semantic-exclusive-v2", "semantic-exclusive-v1", "exclusive-nearest-v1", "later-sequence-v1"),
}
COLOR_RESERVE, LEAST_COLOR_MS, DURATION_TOLERANCE_MS, LATEST_OPENING_MS = (0.18, 0.45), 240, 250, 500
# Compositions that tell a process, and the time a gesture needs in full.
PROCESS_COMPOSITIONS, FULL_GESTURE_MS = ("causal-chain", "timeline", "vertical-layers"), 1600
# Enumerations and limits of title cards and manifests.
CARD_POSITIONS, CARD_STYLES = ("top-left",), ("outlined-label-v1",)


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column], severity: str = "error", values: dict[str, Column] | None = None) -> DataFrame:
    """(keys, rule_id, severity, value): one row per rule that a row breaks; a null predicate breaks nothing."""
    values = values or {}
    # Exploded with its nulls, which are left out after that: a filter of the array would be interpreted, and run twice more to see if it is empty.
    hits = F.array(*[F.when(cond, F.struct(F.lit(r).alias("rule_id"), values.get(r, F.lit(None)).cast("string").alias("value"))) for r, cond in rules.items()])
    return df.select(*keys, F.explode_outer(hits).alias("v")).where("v is not null").select(*keys, "v.rule_id", F.lit(severity).alias("severity"), "v.value")


def score_rules(docs: DataFrame, rules: list[tuple[str, list[str]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule_no, rule_id, matched, score): which keywords of each rule a text holds, cases folded."""
    docs, text = docs.withColumn("_text", casefold(text_col)), F.col("_text")  # folded once, not for each keyword
    scored = F.array(*[
        F.struct(F.lit(i).alias("rule_no"), F.lit(r).alias("rule_id"), F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(text, casefold(k))).alias("matched")) for i, (r, words) in enumerate(rules)
    ])
    return docs.select(id_col, F.explode(scored).alias("s")).select(id_col, "s.*", F.size("s.matched").alias("score"))


def classify(text: Column, rules: list[tuple[str, list[str]]], default: str, conditions: dict[str, Column] | None = None) -> Column:
    """The first class any of whose terms occurs, or whose structural condition holds; compiled to one CASE."""
    out = None
    for name, terms in rules:
        test = F.lit(False)
        for t in terms:
            test = test | F.contains(text, F.lit(t))
        if conditions and name in conditions:
            test = test | conditions[name]
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def core_conclusion(text: Column, terms: list[str]) -> Column:
    """Whether any term occurs."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def motion_role(elements: DataFrame, rules: list[tuple[str, list[str]]], default: str, vocabulary: list[str]) -> DataFrame:
    """Adds role and its evidence: an explicit role of the vocabulary wins, else the first class of the text."""
    own = F.when(F.col("explicit").isin(*vocabulary), F.col("explicit"))
    return elements.withColumns({"role": F.coalesce(own, classify(F.col("text"), rules, default)), "evidence": F.when(own.isNotNull(), "explicit").otherwise("text")})


def sfx_cue(items: DataFrame, templates: dict[str, str], rules: list[tuple[str, list[str]]], vocabulary: list[str]) -> DataFrame:
    """Adds cue (explicit, by template, by terms, or null) and rule_id for unknown explicit cues."""
    by_template = F.coalesce(*[F.when(F.col("template") == t, F.lit(c)) for t, c in templates.items()])
    terms = classify(F.col("text"), rules, "")
    known = F.col("explicit").isin(*vocabulary)
    cue = F.when(known, F.col("explicit")).when(F.col("explicit").isNull(), F.coalesce(by_template, F.nullif(terms, F.lit(""))))
    return items.withColumns({"cue": cue, "rule_id": F.when(F.col("explicit").isNotNull() & ~known, "unknown-cue")})


def simplify_effect(effect: Column, budget: Column) -> Column:
    """The effect that fits the time there is: cheaper ones below the limits, `skip` below 700 ms."""
    short = F.when(budget >= 700, "gesture-underline").otherwise("skip")
    return F.when((effect == "focus-push") & (budget < 1200), short).when(effect.isin("gesture-arc", "gesture-bracket") & (budget < 1100), short).when(budget < 700, "skip").otherwise(effect)


def legacy_effect(elements: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """(scene_id, seq, wanted, effect, fallback): the effect that older plans choose for an element, and what is left of it in its time.

    elements: scene_id, seq, composition, text (label, roles, trigger and subtitle), budget_ms. rules: terms of `identity`, `process`, `relation`
    and `action`. fallback says why it is not played in full: `cheaper`, `skipped` or `simplified`.
    """
    has = lambda kind: F.exists(F.array(*map(F.lit, rules[kind])), lambda t: F.contains("text", t)) if rules.get(kind) else F.lit(False)
    last = F.lead("seq").over(Window.partitionBy("scene_id").orderBy("seq")).isNull()
    wanted = F.when(last & has("identity"), "focus-push").when(F.col("composition").isin(*PROCESS_COMPOSITIONS) & has("process"), "gesture-arrow").when(has("relation"), "gesture-bracket")
    wanted = wanted.when(has("identity"), "gesture-underline").when(has("action"), "gesture-arc").when(last, "gesture-underline").otherwise("gesture-arc")
    df = elements.withColumn("wanted", wanted)
    df = df.withColumn("effect", simplify_effect(F.col("wanted"), F.col("budget_ms")))
    fallback = F.when(F.col("effect") == "skip", "skipped").when(F.col("effect") != F.col("wanted"), "cheaper").when(F.col("budget_ms") < FULL_GESTURE_MS, "simplified")
    return df.select("scene_id", "seq", "wanted", "effect", fallback.alias("fallback"))


def check_words(words: DataFrame, durations: DataFrame) -> DataFrame:
    """Empty text, bad times, wrong order, overlap, and durations that end too early. durations: project_id, duration_ms."""
    w = Window.partitionBy("project_id").orderBy("idx")
    df = words.withColumns({"_s": F.lag("start_ms").over(w), "_e": F.lag("end_ms").over(w), "_last": F.lead("idx").over(w).isNull()}).join(durations, "project_id", "left")
    return violations(df, ["project_id", "idx"], {
        "empty-text": F.trim(F.coalesce("text", F.lit(""))) == "", "bad-time": F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")),
        "unordered": F.col("start_ms") < F.col("_s"), "overlap": F.col("start_ms") < F.col("_e"), "duration-too-short": F.col("_last") & (F.col("duration_ms") < F.col("end_ms")),
    })


def check_storyboard(scenes: DataFrame, elements: DataFrame, compositions: list[str]) -> DataFrame:
    """(project_id, scene_id, rule_id, …): ids, times, 1 to 6 elements, known compositions, none twice in a row."""
    count = elements.groupBy("scene_id").agg(F.count("*").alias("_n"), F.count_distinct("element_id").alias("_d"))
    w = Window.partitionBy("project_id").orderBy("seq")
    df = scenes.join(count, "scene_id", "left").withColumns({"_prev": F.lag("composition").over(w), "_end": F.lag("end_ms").over(w), "_twice": F.count("*").over(Window.partitionBy("project_id", "scene_id")) > 1})
    return violations(df, ["project_id", "scene_id"], {
        "unsafe-id": ~safe_id(F.col("scene_id").cast("string")), "duplicate-id": F.col("_twice"), "bad-time": F.col("end_ms") <= F.col("start_ms"), "overlap": F.col("start_ms") < F.col("_end"),
        "no-elements": F.col("_n").isNull(), "too-many-elements": F.col("_n") > 6, "duplicate-elements": F.col("_d") < F.col("_n"), "unknown-composition": ~F.col("composition").isin(*compositions), "repeated-composition": F.col("composition") == F.col("_prev"),
    })


def check_annotations(elements: DataFrame, scenes: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """(scene_id, seq, rule_id, …): boxes on the canvas, times within the scene, contiguous sequence, early opening, no overlap in time."""
    w = Window.partitionBy("scene_id").orderBy("seq")
    end = F.col("start_ms") + F.col("dur_ms")
    df = elements.join(scenes, "scene_id").withColumns({"_i": F.row_number().over(w), "_prev": F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return violations(df, ["scene_id", "seq"], {
        "off-canvas": (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > width) | (F.col("y") + F.col("h") > height), "beyond-scene": end > F.col("duration_ms") + 250,
        "sequence-gap": F.col("_i") != F.col("seq"), "late-opening": (F.col("_i") == 1) & (F.col("start_ms") > 500), "overlap": F.col("start_ms") < F.col("_prev"),
    })


def check_storyboard_elements(scenes: DataFrame, elements: DataFrame, characters: DataFrame, new_style: bool = True) -> DataFrame:
    """(project_id, scene_id, seq, rule_id, …): narration, labels, ids, triggers, connectors and characters; seq is null for a scene's own.

    scenes: project_id, scene_id, narration, has_beats, character_ids (array); elements: scene_id, seq,
    element_id, label, trigger, relation, from_id, to_id, evidence; characters: project_id, character_id.
    With `new_style` a connector is no element at all; without, it needs a whole relation whose evidence is in the narration.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    df = elements.join(scenes.select("project_id", "scene_id", "narration", "has_beats"), "scene_id")
    label = casefold(F.coalesce("label", F.lit("")))
    connector = F.lit(False)
    for word in CONNECTOR_LABELS:
        connector = connector | F.contains(label, F.lit(word))
    whole = F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False)) & ~blank("from_id") & ~blank("to_id") & ~blank("evidence")
    rules = {"empty-label": blank("label"), "no-id": blank("element_id"), "no-trigger": F.lit(new_style) & blank("trigger") & ~F.coalesce("has_beats", F.lit(False))}
    if new_style:
        rules["connector"] = connector
    else:
        rules |= {"connector-relation": connector & ~whole, "connector-evidence": connector & whole & ~F.contains(F.coalesce("narration", F.lit("")), "evidence")}
    keys = ["project_id", "scene_id", "seq"]
    out = violations(df, keys, rules)
    own = scenes.withColumn("seq", F.lit(None).cast(dict(elements.dtypes)["seq"]))
    used = own.select(*keys, F.explode("character_ids").alias("character_id")).join(characters, ["project_id", "character_id"], "left_anti")
    undeclared = used.select(*keys, F.lit("undeclared-character").alias("rule_id"), F.lit("error").alias("severity"), F.col("character_id").cast("string").alias("value")).distinct()
    return out.union(violations(own, keys, {"no-narration": blank("narration")})).union(undeclared)


def check_annotation_records(annotations: DataFrame, elements: DataFrame, planned: DataFrame) -> DataFrame:
    """(scene_id, seq, rule_id, …): canvas, durations, drawing plan and status of annotations; ids, boxes, times and numbering of their elements; ids against the storyboard.

    annotations: scene_id, width, height, duration_ms, scene_ms, status, mode, stroke_planner,
    color_schedule, pixel_ownership, color_reserve, least_color_ms (null where not given); elements:
    scene_id, seq, element_id, source_ids (array or null), x, y, w, h, start_ms, dur_ms; planned: scene_id, element_id.
    """
    keys = ["scene_id", "seq"]
    kind = dict(elements.dtypes)["seq"]
    count = elements.groupBy("scene_id").agg(F.count("*").alias("_n"), F.collect_set("seq").alias("_seqs"), F.count_if(F.coalesce("element_id", F.lit("")) == "").alias("_blank"), F.count_distinct("element_id").alias("_ids"))
    sides = elements.select("scene_id", "element_id", F.lit(1).alias("_a"), F.lit(0).alias("_p")).union(planned.select("scene_id", "element_id", F.lit(0), F.lit(1)))
    sides = sides.groupBy("scene_id", "element_id").agg(F.max("_a").alias("_a"), F.max("_p").alias("_p")).groupBy("scene_id").agg(F.count_if(F.col("_a") != F.col("_p")).alias("_differ"), F.max("_p").alias("_has_plan"))
    df = annotations.join(count, "scene_id", "left").join(sides, "scene_id", "left").withColumn("seq", F.lit(None).cast(kind))
    rules = {
        "canvas": ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "duration": ~F.coalesce(F.col("duration_ms") > 0, F.lit(False)), "scene-duration": F.abs(F.col("duration_ms") - F.col("scene_ms")) > DURATION_TOLERANCE_MS,
        "draft": F.col("status") == "draft", "no-elements": F.coalesce("_n", F.lit(0)) == 0, "ids": (F.col("_blank") > 0) | (F.col("_ids") < F.col("_n")), "ids-differ-from-plan": (F.col("_has_plan") == 1) & (F.col("_differ") > 0) & (F.col("_n") > 0),
        "numbering": (F.size("_seqs") != F.col("_n")) | (F.array_min("_seqs") != 1) | (F.array_max("_seqs") != F.col("_n")), "color-reserve": ~F.col("color_reserve").between(*COLOR_RESERVE), "least-color": F.col("least_color_ms") < LEAST_COLOR_MS,
    } | {c.replace("_", "-"): ~F.col(c).isin(*allowed) for c, allowed in DRAWING.items()}
    w = Window.partitionBy("scene_id").orderBy("seq")
    end = F.col("start_ms") + F.col("dur_ms")
    each = elements.join(annotations.select("scene_id", "width", "height", "duration_ms"), "scene_id").withColumns({"_prev": F.lag(end).over(w), "_first": F.row_number().over(w) == 1})
    return violations(df, keys, rules).union(violations(each, keys, {
        "late-opening": F.col("_first") & (F.col("start_ms") > LATEST_OPENING_MS), "regrouped": F.col("source_ids").isNotNull() & ~F.col("source_ids").eqNullSafe(F.array("element_id")),
        "region": ~F.coalesce((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") > 0) & (F.col("h") > 0), F.lit(False)), "off-canvas": (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height")),
        "times": ~F.coalesce((F.col("start_ms") >= 0) & (F.col("dur_ms") > 0), F.lit(False)), "overlap": F.col("start_ms") < F.col("_prev"), "beyond-scene": end > F.col("duration_ms"),
    }))


def check_captions(cues: DataFrame, max_chars: int = 18, max_ms: int = 3600) -> DataFrame:
    """(project_id, cue_no, rule_id, …): one line, no punctuation, short enough, in order."""
    w = Window.partitionBy("project_id").orderBy("cue_no")
    df = cues.withColumn("_e", F.lag("end_ms").over(w))
    return violations(df, ["project_id", "cue_no"], {
        "several-lines": F.contains("text", F.lit("\n")), "punctuation": has_punct("text"), "too-many-letters": visible_length("text") > max_chars, "too-long": F.col("end_ms") - F.col("start_ms") > max_ms, "overlap": F.col("start_ms") < F.col("_e"),
    })


def check_timeline(words: DataFrame, cues: DataFrame, audio: DataFrame, tolerance_ms: int = 250) -> DataFrame:
    """(project_id, rule_id, value …): ends of words, cues and audio that differ by more than the tolerance."""
    df = words.groupBy("project_id").agg(F.max("end_ms").alias("w")).join(cues.groupBy("project_id").agg(F.max("end_ms").alias("c")), "project_id", "full").join(audio, "project_id", "left")
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    return violations(df, ["project_id"], {"cues-end": gap("w", "c") > tolerance_ms, "audio-end": gap("w", "audio_ms") > tolerance_ms, "no-words": F.col("w").isNull()}, values={"cues-end": gap("w", "c"), "audio-end": gap("w", "audio_ms")})


def check_background(boards: DataFrame, styles: DataFrame) -> DataFrame:
    """(board_id, rule_id, …): luma out of the style's range, or colour too far from its own.

    boards: board_id, style_id, r, g, b; styles: style_id, luma_lo, luma_hi, br, bg, bb, max_distance.
    """
    df = boards.join(styles, "style_id").withColumns({"_l": F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722, "_d": F.sqrt(F.pow(F.col("r") - F.col("br"), 2) + F.pow(F.col("g") - F.col("bg"), 2) + F.pow(F.col("b") - F.col("bb"), 2))})
    return violations(df, ["board_id"], {"luma-range": (F.col("_l") < F.col("luma_lo")) | (F.col("_l") > F.col("luma_hi")), "colour-distance": F.col("_d") > F.col("max_distance")})


def check_manifest(rows: DataFrame) -> DataFrame:
    """(path, rule_id, …) of manifest rows (part, n, path, sha256, bytes): paths, digests, sizes, repeats, and order within a part."""
    w = Window.partitionBy("part").orderBy("n")
    df = rows.withColumns({"_prev": F.lag("path").over(w), "_times": F.count("*").over(Window.partitionBy("path"))})
    return violations(df, ["path"], {
        "file-path": (F.col("path") == "") | F.contains("path", F.lit("\\")) | F.startswith("path", F.lit("/")), "duplicate": F.col("_times") > 1,
        "file-sha256": ~F.regexp_like("sha256", F.lit("^[0-9a-f]{64}$")), "file-bytes": F.col("bytes") < 0, "file-order": F.col("path") < F.col("_prev"),
    })


def check_title_cards(scenes: DataFrame, palette: list[str], max_chars: int = 18, required: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cards (project_id, seq, text, accent by rotation) and violations. scenes: project_id, seq, text, position, style."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    i = F.row_number().over(Window.partitionBy("project_id").orderBy("seq")) - 1
    df = scenes.withColumns({"text": text, "accent": F.element_at(F.array(*map(F.lit, palette)), (i % len(palette) + 1).cast("int"))})
    has = F.col("text") != ""
    bad = violations(df, ["project_id", "seq"], {"missing-text": ~has & F.lit(required), "position": has & ~F.col("position").isin(*CARD_POSITIONS), "style": has & ~F.col("style").isin(*CARD_STYLES), "too-long": F.char_length("text") > max_chars})
    return df.where(has).select("project_id", "seq", "text", "accent"), bad


def check_pronunciation(overrides: DataFrame, docs: DataFrame) -> DataFrame:
    """(project_id, n, rule_id, …) of overrides (project_id, n, written, spoken, reason, approved) against texts (project_id, text)."""
    earlier = F.row_number().over(Window.partitionBy("project_id", "written").orderBy("n")) > 1
    df = overrides.withColumn("_again", earlier).join(docs, "project_id", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return violations(df, ["project_id", "n"], {
        "invalid": blank("written") | blank("spoken") | (F.col("written") == F.col("spoken")), "repeated": F.col("_again"), "unused": ~F.contains("text", "written"), "no-reason": blank("reason"), "not-approved": ~F.coalesce("approved", F.lit(False)),
    })


def check_immutable(old: DataFrame, new: DataFrame, key: str, protected: list[str]) -> DataFrame:
    """(key, rule_id, …): protected columns that differ between snapshots; rows only in one are none of its business."""
    df = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in protected]).join(new.select(key, *protected), key)
    return violations(df, [key], {f"changed-{c}": ~F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in protected})


def check_transitions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(from_scene, rule_id, …): two copies of transitions must agree, and derived fields must add up."""
    fields = ["hold_ms", "erase_ms", "erase_start_ms", "clean_start_ms"]
    df = left.alias("l").join(right.alias("r"), "from_scene", "full")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    one = F.col("l.gap_ms").isNull() | F.col("r.gap_ms").isNull()
    return violations(df, ["from_scene"], {
        "one-copy": one, "copies-differ": ~one & ~same, "sum": F.col("l.hold_ms") + F.col("l.erase_ms") + 60 != F.col("l.gap_ms"),
        "erase-start": F.col("l.erase_start_ms") != F.col("l.previous_end_ms") + F.col("l.hold_ms"), "clean-start": F.col("l.clean_start_ms") != F.col("l.erase_start_ms") + F.col("l.erase_ms"),
    })


# What recognisers make up in silence, letters without spaces; limits of transcripts.
PROMOTION = ("点赞", "订阅", "转发", "打赏", "likeandsubscribe")
LEAST_PROBABILITY, LONG_MS, MS_PER_CUE, LEAST_UNITS, SHORT_UNITS = 0.5, 30_000, 45_000, 8, 40
COVERED, WELL_COVERED, REPEATED, REPEAT_CUES = 0.35, 0.60, 0.35, 6
FOREIGN, FOREIGN_THIRD, FOREIGN_LETTERS, LATIN_LETTERS = 0.15, 0.35, 4, 20
LANGUAGE_ALIASES = {"zh-cn": "zh", "zh-hans": "zh", "zh-hant": "zh", "zh-tw": "zh", "en-us": "en", "en-gb": "en"}


def transcript_gate(cues: DataFrame, tracks: DataFrame) -> DataFrame:
    """(project_id, rule_id, severity, value) of transcripts that can't be trusted.

    cues: project_id, cue_no, start_ms, end_ms, text; tracks: project_id, duration_ms, language, probability (null if not known).
    Rules: language not known or not sure; Chinese letters in English, none in Chinese, as a whole or in
    a third of the time; for 30 seconds and more too few cues, too little said or covered (a warning where it
    is only thin); cues that repeat; words of promotion in a short transcript. Chinese is counted by letters, all else by words.
    A project has one track at most. Cues are read once and grouped by project; no transcript is put together.
    """
    tracks = tracks.select("project_id", "duration_ms", normalize_language("language", LANGUAGE_ALIASES).alias("language"), "probability", F.lit(True).alias("_track"))
    df = cues.join(tracks, "project_id", "left")
    # A phrase may run over several cues, each of a letter at least: as many before as its letters may matter, and of each its last ones.
    most = max(map(len, PROMOTION)) - 1
    df = df.withColumns({"_t": compact("text"), "_k": norm_text("text", "casefold"), "_c": char_class_counts("text")}).withColumns({"_blank": F.col("_t") == "", "_tail": F.right("_t", F.lit(most))})
    earlier = F.collect_list("_tail").over(Window.partitionBy("project_id", "_blank").orderBy("cue_no", "_t").rowsBetween(-most, -1))
    third = F.floor((F.col("start_ms") + F.col("end_ms")) / 2 / F.greatest(F.col("duration_ms") / 3.0, F.lit(1.0)))
    df = df.select(
        "project_id", "cue_no", "start_ms", "end_ms", "duration_ms", "language", "probability", "_track", F.nullif("_k", F.lit("")).alias("_k"), "_c.cjk", "_c.latin", "_c.words", third.alias("_third"),
        F.concat(F.right(F.array_join(earlier, ""), F.lit(most)), "_t").alias("_spoken"),
    ).withColumn("_promotes", F.exists(F.array(*map(F.lit, PROMOTION)), lambda m: F.contains("_spoken", m)))

    # Cues that say the same are counted first, then projects.
    sums = {"cjk": F.col("cjk"), "latin": F.col("latin"), "words": F.col("words")}
    sums |= {f"_{c}{i}": F.when(F.col("_third") == i, F.col(c)) for i in range(3) for c in ("cjk", "latin")}
    of_track = ["duration_ms", "language", "probability", "_track"]
    same = df.groupBy("project_id", "_k").agg(
        F.count("*").alias("n"), *[F.sum(v).alias(c) for c, v in sums.items()], F.min("cue_no").alias("_first"), F.max("cue_no").alias("_last"), F.min_by("start_ms", "cue_no").alias("_a"), F.max_by("end_ms", "cue_no").alias("_b"),
        F.max("_promotes").alias("_promotes"), *[F.max(c).alias(c) for c in of_track])
    df = same.groupBy("project_id").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums], F.min_by("_a", "_first").alias("_a"), F.max_by("_b", "_last").alias("_b"), F.max("_promotes").alias("_promotes"),
        F.sum(F.when(F.col("_k").isNotNull(), F.col("n"))).alias("_keys"), F.count("_k").alias("_different"), *[F.max(c).alias(c) for c in of_track])
    df = df.withColumns({"units": F.when(F.col("language") == "zh", F.col("cjk")).otherwise(F.col("words")), "share": F.greatest(F.lit(0), F.col("_b") - F.col("_a")) / F.col("duration_ms")})

    long = F.col("duration_ms") >= LONG_MS
    english, chinese = F.col("language") == "en", F.col("language") == "zh"
    of = lambda c, i: F.col(f"_{c}{i}" if i else c)
    foreign = lambda share, i="": of("cjk", i) > F.greatest(F.lit(FOREIGN_LETTERS), F.bround(of("latin", i) * share))
    only_latin = lambda i="": (of("cjk", i) == 0) & (of("latin", i) >= LATIN_LETTERS)
    rate = F.col("units") / F.greatest(F.col("duration_ms") / 60000.0, F.lit(1 / 60))
    found = [
        ("unknown-language", F.col("language") == "auto"), ("low-probability", F.col("probability") < LEAST_PROBABILITY), ("foreign-letters", english & foreign(FOREIGN)), ("no-chinese", chinese & only_latin()),
        ("few-cues", long & (F.col("n") < F.greatest(F.lit(2), F.bround(F.col("duration_ms") / float(MS_PER_CUE))))), ("few-units", long & (rate < LEAST_UNITS)), ("low-coverage", long & (F.col("share") < COVERED)),
        ("thin-coverage", long & (F.col("share") >= COVERED) & (F.col("share") < WELL_COVERED)), ("repeats", (F.col("_keys") >= REPEAT_CUES) & ((F.col("_keys") - F.col("_different")) / F.col("_keys") > REPEATED)),
        ("promotion", F.col("_track") & (F.col("units") < SHORT_UNITS) & F.col("_promotes")),
    ]
    row = lambda rule, severity="error", value=None: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(value).cast("string").alias("value"))
    hits = [F.when(cond, row(rule, "warning" if rule == "thin-coverage" else "error")) for rule, cond in found]
    for i in range(3):
        hits += [F.when(english & foreign(FOREIGN_THIRD, str(i)), row("third-foreign", value=str(i + 1))), F.when(chinese & only_latin(str(i)), row("third-no-chinese", value=str(i + 1)))]
    return df.select("project_id", F.explode(F.array_compact(F.array(*hits))).alias("v")).select("project_id", "v.*")
