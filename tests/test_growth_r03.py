"""Findings by growth of the third review: what a plan may send through the driver or shuffle, and equal results."""

import random
import re

from cuespan.operators import boards, folds, joins, rules
from cuespan.plans import all_queries, fixtures  # noqa: F401  registers the queries
from cuespan.plans.registry import QUERIES
from tests.test_loops import rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_f7_f24_drafts_send_no_table_through_the_driver(spark):
    scenes = spark.range(600).selectExpr("cast(id % 2 as int) as project_id", "cast(id as int) as seq", "if(id % 3 = 0, ' s', null) as scene_id", "if(id % 5 = 0, 'x', 'y') as text", "cast(null as string) as composition")
    elements = scenes.selectExpr("project_id", "seq", "1 as element_no", "if(seq % 2 = 0, null, 'e') as element_id", "'' as trigger_text", "text as triggerText", "text as narrationEvidence")
    filled, own, changes = folds.compile_draft(scenes, elements, [("b", ["x"])], ["a", "b", "c"])
    assert all("Broadcast" not in plan(df) for df in (filled, own, changes))
    assert filled.columns == scenes.columns and own.columns == [*elements.columns, "scene_id"]
    assert (filled.count(), own.where("trigger_text = triggerText").count()) == (600, 600)
    counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    assert counts == {"generated-scene-id": 400, "selected-composition": 600, "generated-element-id": 300, "trigger-text-from": 600}
    ids = {(r.project_id, r.seq): r.scene_id for r in filled.where("seq in (1, 598)").collect()}
    assert ids == {(1, 1): "scene-01", (0, 598): "scene-300"}


def shuffles(df) -> list[str]:
    """The columns of each exchange in the plan, one that is reused counted each time."""
    return re.findall(r"Exchange \w+\((\w+)#", plan(df))


def test_f9_f33_words_of_a_project_stay_in_place(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "DOCS_A_TASK", 50)
    # Texts are dealt once by document; words, beats and phrases are not shuffled after that.
    for name in ("resolve_beat_anchor", "match_trigger"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert set(shuffles(df)) == {"doc_id"}, name


def test_f33_phrases_without_words_or_scene(spark):
    words = spark.createDataFrame([("a", 0, "The", 0, 9), ("a", 1, "cat", 10, 19), (None, 0, "cat", 5, 6)], "scene_key string, idx int, text string, start_ms bigint, end_ms bigint")
    phrases = spark.createDataFrame([("a", "THE cat"), ("a", "c"), ("a", "t"), ("a", None), ("b", "cat"), (None, "cat")], "scene_key string, phrase string")
    got = {(r.scene_key, r.phrase): tuple(r)[2:] for r in joins.match_trigger(phrases, words).collect()}
    none = (None, None, None, None, "scene-window-no-words")
    assert got == {("a", "THE cat"): (0, 1, 0, 19, "exact-trigger-text"), ("a", "c"): (1, 1, 10, 19, "exact-trigger-text"), ("a", "t"): (None, None, 0, 19, "unresolved-semantic-trigger"), ("a", None): (None, None, 0, 19, "unresolved-semantic-trigger"), ("b", "cat"): none, (None, "cat"): none}


def test_f21_promotion_over_many_cues_without_the_whole_text(spark):
    words = "So, Like And Sub scribe now"
    cues = [(1, 2 * i, i * 100, i * 100 + 90, c) for i, c in enumerate(words)] + [(1, 2 * i + 1, 5, 6, " ") for i in range(len(words))]
    cues += [(2, 1, 0, 90, "like and sub"), (2, 2, 100, 190, "so"), (2, 3, 200, 290, "scribe")]
    cues += [(3, 1, 0, 90, "请点"), (3, 2, 100, 190, None), (3, 3, 200, 290, "赞" * 50), (4, 1, 0, 90, "打赏")]
    df = spark.createDataFrame(cues, "project_id int, cue_no int, start_ms bigint, end_ms bigint, text string").repartition(4)
    tracks = spark.createDataFrame([(1, 9_000, "de", 0.9), (2, 9_000, "de", 0.9), (3, 9_000, "de", 0.9)], "project_id int, duration_ms bigint, language string, probability double")
    gate = rules.transcript_gate(df, tracks)
    got = [(r.project_id, r.rule_id) for r in gate.collect() if r.rule_id != "repeats"]
    assert sorted(got) == [(1, "promotion"), (3, "promotion")]
    # Cues are read and tracks are read, each once; nothing else is.
    seen = plan(QUERIES["transcript_gate"](spark, "/root/testdata/sf0.001"))
    assert seen.count("FileScan parquet") == 2


def test_f32_few_groups_of_a_board_meet_without_a_grid(spark, monkeypatch):
    rng = random.Random(4)
    data = [(b, i, x, y, x + rng.choice([5, 60, 300]), y + rng.choice([5, 60, 300])) for b in range(40) for i in range(rng.choice([1, 7, 16, 17, 40])) for x, y in [(rng.randrange(900), rng.randrange(900))]]
    df = spark.createDataFrame(data, "board_id int, box_id int, x0 int, y0 int, x1 int, y1 int")
    got = rows(boards.box_components(df), "board_id", "box_id", "component_id")
    monkeypatch.setattr(boards, "FEW", 0)
    assert len(got) == len(data) and got == rows(boards.box_components(df), "board_id", "box_id", "component_id")


def test_f32_step_of_few_is_one_shuffle(spark):
    hulls = spark.createDataFrame([(1, 1, 0, 0, 5, 5), (1, 2, 7, 0, 9, 5), (1, 3, 12, 0, 15, 5), (2, 1, 7, 0, 9, 5)], "board_id int, component_id int, x0 int, y0 int, x1 int, y1 int")
    step = boards._nearest_of_few(hulls, 2)
    assert shuffles(step) == ["board_id"]
    assert rows(step, "board_id", "component_id", "to") == [(1, 2, 1)]
