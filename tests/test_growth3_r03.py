"""Findings by growth of the third review, third pass: what is shuffled, what is run once, and equal results on odd rows."""

import random

from pyspark.sql import functions as F

from cuespan.operators import boards, captions, frames, joins, plan_rules, rules
from cuespan.plans import all_queries, fixtures  # noqa: F401  registers the queries
from cuespan.plans.registry import QUERIES
from tests.test_growth_r03 import plan, shuffles
from tests.test_loops import rows

SMALL = "/root/testdata/sf0.001"


def test_f29_f36_words_and_scenes_meet_in_place(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "DOCS_A_TASK", 50)
    for name in ("scene_words", "scene_words_contain", "word_coverage"):
        df = QUERIES[name](spark, SMALL)
        # Texts and orders are dealt once; no word is shuffled and no scene broadcast.
        assert set(shuffles(df)) <= {"doc_id", "o_custkey", "project_id"} and len(shuffles(df)) <= 3 and "Broadcast" not in plan(df), name


def test_f29_f36_odd_words_and_scenes(spark):
    rng = random.Random(7)
    t = lambda: rng.choice([None, *range(0, 200_000, 777)])
    words = [(rng.choice([1, 1, 2, None]), rng.choice([i, i, i, None, 3]), f"w{i}", a, a if a is None else rng.choice([a, a + 40, a + 70_000])) for i in range(250) for a in [t()]]
    scenes = [(rng.choice([1, 1, 2, None]), i, i, a, a if a is None else rng.choice([a, a + 50, a + 9_000, a + 90_000])) for i in range(60) for a in [t()]]
    w = spark.createDataFrame(words, "project_id int, idx int, text string, start_ms bigint, end_ms bigint")
    s = spark.createDataFrame(scenes, "project_id int, scene_id int, seq int, start_ms bigint, end_ms bigint")
    known = lambda *x: None not in x
    over = [(p, c, i, x) for p, i, x, a, b in words for q, c, _, u, v in scenes if known(p, a, u) and p == q and a < v and b > u]
    within = [(p, c, i, x) for p, i, x, a, b in words for q, c, _, u, v in scenes if known(p, a, u) and p == q and a >= u and b <= v]
    key = lambda r: tuple(str(x) for x in r)
    got = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=key)
    assert got(joins.scene_words(w, s), "project_id", "scene_id", "idx", "text") == sorted(over, key=key)
    assert got(joins.scene_words(w, s, "contain"), "project_id", "scene_id", "idx", "text") == sorted(within, key=key)
    n = {}
    for p, _, i, _ in over:
        n[p, i] = n.get((p, i), 0) + (i is not None)
    want = [(p, i, "missing" if not n.get((p, i)) else "duplicate") for p, i, *_ in words if n.get((p, i), 0) != 1]
    assert got(joins.word_coverage(w, s), "project_id", "idx", "rule_id") == sorted(want, key=key)


def test_f35_f37_events_stay_by_scene_and_rules_run_once(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 600)
    df = QUERIES["check_plan_events"](spark, SMALL)
    assert "target_id" not in " ".join(shuffles(df))
    # A filter of the array of rules ran each of them twice more to see if it was empty.
    broken = rules.violations(spark.range(4), ["id"], {"a": F.col("id") % 2 == 0, "b": F.col("id") > 2})
    assert "isnotnull(lambda" not in plan(broken) and plan(broken).count("WHEN") == 2
    assert rows(broken, "id", "rule_id") == [(0, "a"), (2, "a"), (3, "b")]


def test_f27_words_and_beats_of_shots_stay_in_place(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "DOCS_A_TASK", 50)
    # Words were shuffled by first and last word, beats by shot; now only the shots are, once.
    found = shuffles(QUERIES["check_shots"](spark, SMALL))
    assert found.count("doc_id") == 3 and len(found) <= 4


def test_f27_shots_twice_and_beyond_their_words(spark):
    words = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 900) for i in range(20)] + [(None, 0, 0, 900)], "project_id int, idx int, start_ms bigint, end_ms bigint")
    look = ("a_host", "a_host", None, True, "focus", "text-card")
    shot = lambda no, f, z, a, b, p=1: (p, no, f"s{no}", *look, f, z, a, b, False, True, 1, "native")
    data = [shot(1, 0, 13, 0, 13_900), shot(1, 0, 13, 0, 13_900), shot(2, 14, 25, 14_000, 25_900), shot(3, None, 19, 1, 2), shot(4, 0, 0, 0, 900, None), shot(5, 0, 1, 0, 3000, 9)]
    shots = spark.createDataFrame(data, "project_id int, shot_no int, shot_id string, requested_type string, shot_type string, fallback_type string, has_assets boolean, template string, composition string, first_idx int, last_idx int, start_ms bigint, end_ms bigint, short_allowed boolean, planned boolean, regions int, mode string")
    beats = spark.createDataFrame([(1, 1, 1, "opening-anchor", 700), (1, 1, 2, "word", 800), (None, 4, 1, "opening-anchor", 900), (1, 7, 1, "word", 5)], "project_id int, shot_no int, beat_no int, mapping string, start_ms bigint")
    got = sorted((str(r.project_id), r.shot_no, r.rule_id) for r in plan_rules.check_shots(shots, words, beats).collect() if r.rule_id in ("late-opening", "long-without-beat", "bad-range", "not-at-words", "duplicate-id"))
    assert got == sorted([("1", 1, "late-opening")] * 2 + [("1", 1, "duplicate-id")] * 2 + [("1", 2, "bad-range"), ("1", 3, "bad-range"), ("None", 4, "bad-range"), ("9", 5, "bad-range")])


def test_f26_words_are_split_once(spark):
    words = spark.createDataFrame([(1, 0, "aß!", 0, 10), (1, 1, "--", 10, 20), (1, 2, None, 20, 30), (1, 3, "", 30, 40), (1, 4, "𝒳y", 40, 50)], "project_id int, idx int, text string, start_ms bigint, end_ms bigint")
    timed = frames.char_timing(words)
    assert plan(timed).count("regexp_replace") == 1
    assert rows(timed, "idx", "pos", "char", "start_ms", "end_ms") == [(0, 0, "a", 0, 5), (0, 1, "ß", 5, 10), (4, 0, "𝒳", 40, 45), (4, 1, "y", 45, 50)]


def test_f30_pieces_are_made_once_and_ranked_as_before(spark):
    runs = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 12, 12), (1, 1, 5, 5)], "board_id int, y int, x0 int, x1 int")
    claims = spark.createDataFrame([(1, "b", 9, 0, 0, 6), (1, "a", 9, 0, 4, 11), (1, "c", 3, 0, 5, 6), (1, "c", 3, 0, 5, 7)], "board_id int, element_id string, area int, y int, x0 int, x1 int")
    owned, counts = boards.mask_ownership(runs, claims)
    assert "array_sort" not in plan(counts)
    assert rows(owned, "x0", "x1", "element_id", "claims") == [(0, 4, "b", 1), (4, 5, "a", 2), (5, 6, "c", 3), (6, 7, "c", 2), (7, 10, "a", 1)]
    assert rows(counts, "element_id", "pixels", "contested") == [("a", 4, 1), ("b", 4, 0), ("c", 2, 2)]


def test_f23_cues_and_scripts_of_a_project_stay_in_place(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "DOCS_A_TASK", 50)
    found = shuffles(QUERIES["caption_contract"](spark, SMALL))
    assert set(found) == {"doc_id"}
    cues = spark.createDataFrame([(1, 1, "a 的 b"), (1, 2, None), (None, 1, "的 x")], "project_id int, cue_no int, text string")
    scripts = spark.createDataFrame([(1, "a，的b"), (None, "的，x"), (2, None)], "project_id int, text string")
    assert sorted((str(r.project_id), r.cue_no, r["at"]) for r in captions.caption_space_check(cues, scripts).collect()) == [("1", 1, 2), ("None", 1, 1)]
