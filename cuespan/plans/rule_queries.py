"""Queries of picks, set operations, keyword classes, rules and project state."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.operators import aggs, picks as P, rules as R, state as S
from cuespan.operators.joins import scene_words
from cuespan.operators.windows import hand_motion_qa, transition_plan
from cuespan.plans.agg_queries import WORDS
from cuespan.plans.fixtures import COMPOSITIONS, table, v_art_new, v_art_old, v_asr, v_cues, v_elements, v_frames, v_scenes, v_words, with_views, words_and_scenes
from cuespan.plans.frame_queries import _EVERY_RATE, phases_sql
from cuespan.plans.registry import query
from cuespan.plans.window_queries import _LENGTHS, _PAIRS, HAND_SQL, lengths

KEYWORDS = [("history", ["the ", "tion"]), ("nature", ["der ", "und", "and "]), ("craft", ["de ", "la "]), ("science", ["xyzzy"])]
_SCORED = """_s AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS rule_no, unnest(['history', 'nature', 'craft', 'science']) AS rule_id, unnest([contains(t, 'the ')::INT + contains(t, 'tion')::INT, contains(t, 'der ')::INT + contains(t, 'und')::INT + contains(t, 'and ')::INT, contains(t, 'de ')::INT + contains(t, 'la ')::INT, contains(t, 'xyzzy')::INT]) AS score FROM (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents))"""


@query(f"WITH {_SCORED} SELECT doc_id, rule_no, rule_id, score FROM _s")
def score_rules(spark, sf):
    return R.score_rules(table(spark, sf, "documents"), KEYWORDS).drop("matched")


@query(f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rule_no) AS n FROM _s), c AS (SELECT doc_id, string_agg(rule_id, ',' ORDER BY n) FILTER (score > 0 AND n <= 3) AS c FROM r GROUP BY doc_id) SELECT doc_id, split_part(coalesce(c, 'craft,history'), ',', 1) AS winner, coalesce(c, 'craft,history') AS candidates FROM c")
def top3_rules(spark, sf):
    return P.top3_rules(R.score_rules(table(spark, sf, "documents"), KEYWORDS), ["craft", "history"]).withColumn("candidates", F.array_join("candidates", ","))


_CASE = "CASE WHEN contains(text, 'tionthe') THEN 'timeline' WHEN contains(text, 'shthe') OR length(text) > 9000 THEN 'layers' WHEN contains(text, 'die ') THEN 'relation' ELSE 'plain' END"
_CLASSES = [("timeline", ["tionthe"]), ("layers", ["shthe"]), ("relation", ["die "])]


@query(f"SELECT doc_id, {_CASE} AS template FROM documents")
def classify_template(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.classify(F.col("text"), _CLASSES, "plain", {"layers": F.char_length("text") > 9000}).alias("template"))


@query("SELECT doc_id, contains(text, 'tionthe') OR contains(text, 'shthe') AS core FROM documents")
def core_conclusion(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.core_conclusion(F.col("text"), ["tionthe", "shthe"]).alias("core"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'pulse' ELSE {_CASE.replace(' OR length(text) > 9000', '')} END AS role, CASE WHEN doc_id % 5 = 0 THEN 'explicit' ELSE 'text' END AS evidence FROM documents")
def motion_role(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "text", "case doc_id % 5 when 0 then 'pulse' when 1 then 'bogus' end as explicit")
    return R.motion_role(rows, _CLASSES, "plain", ["pulse", "plain"]).select("doc_id", "role", "evidence")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'click' WHEN doc_id % 5 = 1 THEN NULL WHEN doc_id % 5 = 2 THEN 'whoosh' ELSE CASE WHEN contains(text, 'tionthe') THEN 'reveal' WHEN contains(text, 'shthe') THEN 'warning' END END AS cue, CASE WHEN doc_id % 5 = 1 THEN 'unknown-cue' END AS rule_id FROM documents")
def sfx_cue(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "text", "case doc_id % 5 when 0 then 'click' when 1 then 'bogus' end as explicit", "if(doc_id % 5 = 2, 'swipe', null) as template")
    return R.sfx_cue(rows, {"swipe": "whoosh"}, [("reveal", ["tionthe"]), ("warning", ["shthe"])], ["click", "whoosh"]).select("doc_id", "cue", "rule_id")


@query(with_views("v_elements", select="+ _e AS (SELECT scene_id, seq, dur_ms AS b, ['focus-push', 'gesture-arc', 'gesture-bracket', 'gesture-underline'][seq % 4 + 1] AS e FROM v_elements)\n=\nSELECT scene_id, seq, CASE WHEN e = 'focus-push' AND b < 1200 THEN CASE WHEN b >= 700 THEN 'gesture-underline' ELSE 'skip' END WHEN e IN ('gesture-arc', 'gesture-bracket') AND b < 1100 THEN CASE WHEN b >= 700 THEN 'gesture-underline' ELSE 'skip' END WHEN b < 700 THEN 'skip' ELSE e END AS effect FROM _e"))
def legacy_effect(spark, sf):
    effect = F.element_at(F.array(*map(F.lit, ("focus-push", "gesture-arc", "gesture-bracket", "gesture-underline"))), (F.col("seq") % 4 + 1).cast("int"))
    return v_elements(spark, sf).select("scene_id", "seq", R.simplify_effect(effect, F.col("dur_ms")).alias("effect"))


@query(with_views("v_elements", select="""+ _c AS (SELECT scene_id, seq, CASE WHEN seq % 4 = 0 THEN 'contour-indicate' ELSE 'focus-push' END AS effect, (x % 100) / 100.0::DOUBLE AS confidence, dur_ms AS budget_ms, start_ms AS action_start_ms, lead(seq) OVER (PARTITION BY scene_id ORDER BY seq) IS NULL AS is_last FROM v_elements),
_p AS (SELECT *, round(confidence * 3.0::DOUBLE + least(2.0::DOUBLE, budget_ms / 1800.0::DOUBLE) + CASE WHEN is_last THEN 1 ELSE 0 END + CASE WHEN effect = 'focus-push' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END, 6) AS priority, CASE WHEN effect <> 'focus-push' THEN 'effect-not-offered' WHEN confidence < 0.75 THEN 'low-confidence' WHEN budget_ms < 1200 THEN 'window-too-short' END AS r FROM _c)
=
SELECT scene_id, seq, priority, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY scene_id, r IS NULL ORDER BY priority DESC, action_start_ms, seq) > 1 THEN 'lower-priority' END) AS reason FROM _p"""))
def top_event_per_scene(spark, sf):
    from pyspark.sql.window import Window

    last = F.lead("seq").over(Window.partitionBy("scene_id").orderBy("seq")).isNull()
    rows = v_elements(spark, sf).withColumn("is_last", last).selectExpr("scene_id", "seq", "if(seq % 4 = 0, 'contour-indicate', 'focus-push') as effect", "(x % 100) / 100D as confidence", "dur_ms as budget_ms", "start_ms as action_start_ms", "is_last")
    return P.top_event_per_scene(rows).select("scene_id", "seq", "priority", "reason")


@query(with_views("v_frames", select="+ " + HAND_SQL + "\n=\nSELECT key, frame, kind, value, row_number() OVER (PARTITION BY key ORDER BY coalesce(value, 0) DESC, frame, kind)::INT AS rank FROM _v QUALIFY rank <= 5"))
def worst_events(spark, sf):
    return P.worst_events(hand_motion_qa(v_frames(spark, sf)))


@query("""WITH t AS (SELECT c_custkey % 300 AS video_id, CASE c_custkey % 7 WHEN 0 THEN 'en-orig' WHEN 1 THEN 'en-US' WHEN 2 THEN 'fr' ELSE 'en' END AS lang, CASE WHEN c_custkey % 3 = 0 THEN 'json3' WHEN c_custkey % 3 = 1 THEN 'vtt' ELSE 'ttml' END AS ext, 'u' || c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN 'native' ELSE 'automatic' END AS source FROM customer)
SELECT video_id, lang, url, ext, source FROM t WHERE split_part(lang, '-', 1) = 'en' AND ext <> 'ttml' QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY source <> 'native', NOT lang LIKE '%-orig', lang, ext <> 'json3', url) = 1""")
def pick_caption_track(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey % 300 as video_id", "case c_custkey % 7 when 0 then 'en-orig' when 1 then 'en-US' when 2 then 'fr' else 'en' end as lang", "case c_custkey % 3 when 0 then 'json3' when 1 then 'vtt' else 'ttml' end as ext", "concat('u', c_custkey) as url", "if(c_custkey % 2 = 0, 'native', 'automatic') as source")
    return P.pick_caption_track(rows, F.lit("en"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS ordinal FROM events")
def ordered_events(spark, sf):
    return P.ordered_events(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ordinal")


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT DISTINCT user_id, round_even(j * (n - 1) / 11.0::DOUBLE, 0)::BIGINT AS i FROM (SELECT DISTINCT user_id, n FROM e), range(12) r(j))
SELECT e.user_id, event_id FROM e LEFT JOIN k ON k.user_id = e.user_id AND k.i = e.i WHERE n <= 12 OR k.i IS NOT NULL""")
def even_sample(spark, sf):
    return P.even_sample(table(spark, sf, "events"), 12, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query(with_views("v_scenes", select="""+ _e AS (SELECT project_id AS video_id, max(end_ms) AS e FROM v_scenes GROUP BY project_id), _o AS (SELECT video_id, t AS time_ms FROM _e, (VALUES (0), (1000), (2000), (3000)) v(t) WHERE t < e),
_r AS (SELECT project_id AS video_id, (start_ms + end_ms) // 2 AS time_ms FROM v_scenes UNION SELECT video_id, unnest(range(5000, e, 5000)) FROM _e), _x AS (SELECT * FROM _r EXCEPT SELECT * FROM _o),
_n AS (SELECT x.video_id, time_ms, row_number() OVER (PARTITION BY x.video_id ORDER BY time_ms) - 1 AS i, count(*) OVER (PARTITION BY x.video_id) AS n, 20 - k AS k FROM _x x JOIN (SELECT video_id, count(*) AS k FROM _o GROUP BY video_id) USING (video_id))
=
SELECT * FROM _o UNION SELECT video_id, time_ms FROM _n WHERE n <= k OR list_contains(list_transform(range(k), lambda j: round_even(j * (n - 1) / (k - 1)::DOUBLE, 0)::BIGINT), i)"""))
def pick_keyframes(spark, sf):
    return P.pick_keyframes(v_scenes(spark, sf).withColumnRenamed("project_id", "video_id"))


# Drawings of 2 to 8 seconds; the scene goes on for up to 1.5 seconds after an element's end.
_RESERVE = """_c0 AS (SELECT scene_id, seq, CASE WHEN seq % 5 = 4 THEN 'passing-flash' ELSE 'focus-push' END AS effect, (x % 100) / 100.0::DOUBLE AS confidence, start_ms, 2000 + dur_ms * 2 AS original_ms, start_ms + 2000 + dur_ms * 2 + y * 37 % CASE WHEN scene_id % 3 = 0 THEN 1700 ELSE 1500 END AS boundary_ms FROM v_elements),
_c1 AS (SELECT *, greatest(0, boundary_ms - 250 - (start_ms + original_ms + 100)) AS budget_ms FROM _c0 WHERE effect = 'focus-push' AND confidence >= 0.75),
_c2 AS (SELECT *, boundary_ms - 250 - 1200 - 100 - start_ms AS dur_ms FROM _c1 WHERE scene_id NOT IN (SELECT scene_id FROM _c1 WHERE budget_ms >= 1200)), _c3 AS (SELECT * FROM _c2 WHERE dur_ms < original_ms AND dur_ms > 0)"""


@query(with_views("v_elements", select="+ " + _RESERVE + ", " + phases_sql(_EVERY_RATE.format("_c3")) + """, _f AS (SELECT scene_id, seq FROM _ok GROUP BY ALL HAVING bool_and(fits))
=
SELECT scene_id, seq, effect, original_ms, dur_ms, 1200 AS reserved_ms, original_ms - dur_ms AS compressed_ms FROM _c3 JOIN _f USING (scene_id, seq) QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY confidence DESC, seq DESC) = 1"""))
def feasible_first(spark, sf):
    df = v_elements(spark, sf).selectExpr("scene_id", "seq", "if(seq % 5 = 4, 'passing-flash', 'focus-push') as effect", "(x % 100) / 100D as confidence", "start_ms", "2000 + dur_ms * 2 as dur_ms", "y * 37 % if(scene_id % 3 = 0, 1700, 1500) as room")
    df = df.withColumn("boundary_ms", F.expr("start_ms + dur_ms + room")).withColumn("budget_ms", F.expr("greatest(0, room - 350)"))
    return P.feasible_first(df)


_CHOICES = {"identity": ["the "], "process": ["and ", "und "], "relation": ["la "], "action": ["tion", "der "]}


@query(with_views("v_cues", select="""+ _e AS (SELECT project_id, cue_no, text, [""" + ", ".join(f"'{c}'" for c in COMPOSITIONS) + """][project_id % 6 + 1] AS c, (cue_no * 131 + project_id * 17) % 2000 AS b, lead(cue_no) OVER (PARTITION BY project_id ORDER BY cue_no) IS NULL AS last FROM v_cues),
_w AS (SELECT *, CASE WHEN last AND contains(text, 'the ') THEN 'focus-push' WHEN c IN ('causal-chain', 'timeline', 'vertical-layers') AND (contains(text, 'and ') OR contains(text, 'und ')) THEN 'gesture-arrow' WHEN contains(text, 'la ') THEN 'gesture-bracket'
  WHEN contains(text, 'the ') THEN 'gesture-underline' WHEN contains(text, 'tion') OR contains(text, 'der ') THEN 'gesture-arc' WHEN last THEN 'gesture-underline' ELSE 'gesture-arc' END AS wanted FROM _e),
_x AS (SELECT *, CASE WHEN wanted = 'focus-push' AND b < 1200 OR wanted IN ('gesture-arc', 'gesture-bracket') AND b < 1100 THEN CASE WHEN b >= 700 THEN 'gesture-underline' ELSE 'skip' END WHEN b < 700 THEN 'skip' ELSE wanted END AS effect FROM _w)
=
SELECT project_id AS scene_id, cue_no AS seq, wanted, effect, CASE WHEN effect = 'skip' THEN 'skipped' WHEN effect <> wanted THEN 'cheaper' WHEN b < 1600 THEN 'simplified' END AS fallback FROM _x"""))
def legacy_effect(spark, sf):
    name = F.element_at(F.array(*map(F.lit, COMPOSITIONS)), F.expr("int(project_id % 6 + 1)"))
    rows = v_cues(spark, sf).select(F.col("project_id").alias("scene_id"), F.col("cue_no").alias("seq"), "text", name.alias("composition"), F.expr("(cue_no * 131 + project_id * 17) % 2000").alias("budget_ms"))
    return R.legacy_effect(rows, _CHOICES)


@query("""WITH l AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN l_orderkey ELSE -l_orderkey - l_partkey % 5 END AS k FROM lineitem)
SELECT o_orderkey AS key, 'missing' AS side FROM (SELECT o_orderkey FROM orders EXCEPT SELECT k FROM l) UNION ALL SELECT k, 'unexpected' FROM (SELECT k FROM l EXCEPT SELECT o_orderkey FROM orders)""")
def id_set_diff(spark, sf):
    return P.id_set_diff(table(spark, sf, "orders").selectExpr("o_orderkey as k"), table(spark, sf, "lineitem").selectExpr("if(l_partkey % 3 = 0, l_orderkey, -l_orderkey - l_partkey % 5) as k"), "k")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def dedupe_keep_first(spark, sf):
    return P.dedupe_keep_first(table(spark, sf, "documents").selectExpr("doc_id", "sha2(text, 256) as digest"), ["digest"], ["doc_id"])


@query("SELECT l_partkey, 'left' AS side FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber <= 2 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_linenumber >= 3) UNION ALL SELECT l_partkey, 'right' FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber >= 3 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_linenumber <= 2)")
def multiset_equal(spark, sf):
    rows = table(spark, sf, "lineitem")
    return P.multiset_equal(rows.where("l_linenumber <= 2"), rows.where("l_linenumber >= 3"), ["l_partkey"])


@query(with_views("v_scenes", "v_elements", select="+ " + _LENGTHS + """,
_a AS (SELECT scene_id, 'pen' AS effect, start_ms AS s, start_ms + dur_ms AS e, FALSE AS r, 0 AS source FROM v_elements UNION ALL SELECT scene_id, 'chime', start_ms + 500, start_ms + 900, seq % 2 = 0, 1 FROM v_elements UNION ALL SELECT scene_id, 'pen', duration_ms - 300, duration_ms + 500, FALSE, 2 FROM _len),
_c AS (SELECT scene_id, effect, r, source, greatest(s, 0) AS start_ms, least(e, duration_ms) AS end_ms FROM _a JOIN _len USING (scene_id)), _n AS (SELECT *, row_number() OVER (PARTITION BY scene_id, effect ORDER BY source, start_ms, end_ms) AS n FROM _c WHERE end_ms > start_ms)
=
SELECT scene_id, effect, source, start_ms, end_ms FROM _n WHERE n = 1 OR r"""))
def sfx_plan(spark, sf):
    elements, scenes = v_elements(spark, sf), lengths(spark, sf)
    parts = [
        elements.selectExpr("scene_id", "'pen' as effect", "start_ms", "start_ms + dur_ms as end_ms", "false as repeatable"), elements.selectExpr("scene_id", "'chime' as effect", "start_ms + 500 as start_ms", "start_ms + 900 as end_ms", "seq % 2 = 0 as repeatable"),
        scenes.selectExpr("scene_id", "'pen' as effect", "duration_ms - 300 as start_ms", "duration_ms + 500 as end_ms", "false as repeatable"),
    ]
    return P.sfx_plan(parts, scenes.selectExpr("scene_id", "0L as scene_start_ms", "duration_ms as scene_end_ms"))


def broken(keys: str, source: str, *rules: tuple[str, str], with_: str = "") -> str:
    """SQL of violations: one SELECT per rule."""
    return with_ + " UNION ALL ".join(f"SELECT {keys}, '{rule}' AS rule_id, 'error' AS severity, NULL::VARCHAR AS value FROM {source} WHERE {cond}" for rule, cond in rules)


@query(with_views("v_words", "v_asr", select="+ _w AS (SELECT *, lag(start_ms) OVER p AS ps, lag(end_ms) OVER p AS pe, lead(idx) OVER p IS NULL AS last FROM (SELECT project_id, idx, CASE WHEN idx % 31 = 0 THEN ' ' ELSE text END AS text, start_ms - idx % 17 * 40 AS start_ms, CASE WHEN idx % 41 = 0 THEN start_ms - 700 ELSE end_ms END AS end_ms FROM v_asr) WINDOW p AS (PARTITION BY project_id ORDER BY idx))\n=\n" + broken("project_id, idx", "_w", ("empty-text", "trim(text) = ''"), ("bad-time", "start_ms < 0 OR end_ms <= start_ms"), ("unordered", "start_ms < ps"), ("overlap", "start_ms < pe"), ("duration-too-short", "last AND end_ms > 60000"))))
def check_words(spark, sf):
    words = v_asr(spark, sf).selectExpr("project_id", "idx", "if(idx % 31 = 0, ' ', text) as text", "start_ms - idx % 17 * 40 as start_ms", "if(idx % 41 = 0, start_ms - 700, end_ms) as end_ms")
    return R.check_words(words, words.select("project_id").distinct().withColumn("duration_ms", F.lit(60000)))


@query(with_views("v_scenes", "v_elements", select="+ _n AS (SELECT scene_id, count(*) AS n, count(DISTINCT element_id) AS d FROM v_elements GROUP BY scene_id), _s AS (SELECT s.*, n, d, lag(composition) OVER p AS pc, lag(end_ms) OVER p AS pe FROM v_scenes s LEFT JOIN _n USING (scene_id) WINDOW p AS (PARTITION BY project_id ORDER BY seq))\n=\n" + broken("project_id, scene_id", "_s", ("overlap", "start_ms < pe"), ("no-elements", "n IS NULL"), ("too-many-elements", "n > 6"), ("duplicate-elements", "d < n"), ("unknown-composition", "composition = 'timeline'"), ("repeated-composition", "composition = pc"))))
def check_storyboard(spark, sf):
    return R.check_storyboard(v_scenes(spark, sf), v_elements(spark, sf), [c for c in COMPOSITIONS if c != "timeline"])


@query(with_views("v_scenes", "v_elements", select="+ " + _LENGTHS + ", _e AS (SELECT e.*, duration_ms, row_number() OVER p AS i, max(start_ms + dur_ms) OVER (PARTITION BY scene_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM (SELECT * FROM v_elements WHERE scene_id % 9 <> 0 OR seq <> 2) e JOIN _len USING (scene_id) WINDOW p AS (PARTITION BY scene_id ORDER BY seq))\n=\n" + broken("scene_id, seq", "_e", ("off-canvas", "x + w > 1920 OR y + h > 1080"), ("beyond-scene", "start_ms + dur_ms > duration_ms + 250"), ("sequence-gap", "i <> seq"), ("late-opening", "i = 1 AND start_ms > 500"), ("overlap", "start_ms < pe"))))
def check_annotations(spark, sf):
    return R.check_annotations(v_elements(spark, sf).where("scene_id % 9 <> 0 or seq <> 2"), lengths(spark, sf))


@query(with_views("v_cues", select="+ _c AS (SELECT *, lag(end_ms) OVER (PARTITION BY project_id ORDER BY cue_no) AS pe FROM v_cues)\n=\n" + broken("project_id, cue_no", "_c", ("several-lines", "contains(text, chr(10))"), ("punctuation", "regexp_matches(text, '\\p{P}')"), ("too-many-letters", "length(regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g')) > 18"), ("too-long", "end_ms - start_ms > 3600"), ("overlap", "start_ms < pe"))))
def check_captions(spark, sf):
    return R.check_captions(v_cues(spark, sf))


@query(with_views("v_words", "v_cues", select="+ _j AS (SELECT w.project_id, w, c, w + (w.project_id % 5 - 2) * 200 AS a FROM (SELECT project_id, max(end_ms) AS w FROM v_words GROUP BY project_id) w JOIN (SELECT project_id, max(end_ms + project_id % 4 * 150) AS c FROM v_cues GROUP BY project_id) USING (project_id))\n=\nSELECT project_id, 'cues-end' AS rule_id, 'error' AS severity, abs(w - c)::VARCHAR AS value FROM _j WHERE abs(w - c) > 250 UNION ALL SELECT project_id, 'audio-end', 'error', abs(w - a)::VARCHAR FROM _j WHERE abs(w - a) > 250"))
def check_timeline(spark, sf):
    words = v_words(spark, sf)
    audio = words.groupBy("project_id").agg((F.max("end_ms") + (F.col("project_id") % 5 - 2) * 200).alias("audio_ms"))
    return R.check_timeline(words, v_cues(spark, sf).withColumn("end_ms", F.expr("end_ms + project_id % 4 * 150")), audio)


@query(with_views("v_elements", select="+ _b AS (SELECT scene_id AS board_id, scene_id % 2 AS st, median(x % 256)::DOUBLE AS r, median(y % 256)::DOUBLE AS g, median(h % 256)::DOUBLE AS b FROM v_elements GROUP BY scene_id), _l AS (SELECT *, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS l, sqrt((r - (CASE st WHEN 0 THEN 250 ELSE 20 END)) ** 2 + (g - (CASE st WHEN 0 THEN 250 ELSE 40 END)) ** 2 + (b - (CASE st WHEN 0 THEN 245 ELSE 30 END)) ** 2) AS d FROM _b)\n=\n" + broken("board_id", "_l", ("luma-range", "CASE st WHEN 0 THEN l < 200 ELSE l > 90 END"), ("colour-distance", "d > CASE st WHEN 0 THEN 60 ELSE 120 END"))))
def check_background(spark, sf):
    boards = aggs.corner_background(v_elements(spark, sf).selectExpr("scene_id as board_id", "x % 256 as r", "y % 256 as g", "h % 256 as b")).withColumn("style_id", F.col("board_id") % 2)
    styles = spark.createDataFrame([(0, 200.0, 255.0, 250, 250, 245, 60.0), (1, 0.0, 90.0, 20, 40, 30, 120.0)], "style_id bigint, luma_lo double, luma_hi double, br int, bg int, bb int, max_distance double")
    return R.check_background(boards, styles)


@query(with_views("v_art_old", select="+ _m AS (SELECT doc_id // 1000 AS part, doc_id AS n, CASE WHEN doc_id % 50 = 0 THEN '/abs' WHEN doc_id % 51 = 0 THEN 'twice' ELSE doc_id || '.txt' END AS path, CASE WHEN doc_id % 60 = 0 THEN 'bad' ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 70 = 0 THEN -1 ELSE strlen(text)::BIGINT END AS bytes FROM documents), _w AS (SELECT *, lag(path) OVER (PARTITION BY part ORDER BY n) AS pp, count(*) OVER (PARTITION BY path) AS k FROM _m)\n=\n" + broken("path", "_w", ("file-path", "path LIKE '/%'"), ("duplicate", "k > 1"), ("file-sha256", "NOT regexp_full_match(sha256, '[0-9a-f]{64}')"), ("file-bytes", "bytes < 0"), ("file-order", "path < pp"))))
def check_manifest(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id div 1000 as part", "doc_id as n", "case when doc_id % 50 = 0 then '/abs' when doc_id % 51 = 0 then 'twice' else concat(doc_id, '.txt') end as path", "if(doc_id % 60 = 0, 'bad', sha2(text, 256)) as sha256", "if(doc_id % 70 = 0, -1L, cast(octet_length(text) as bigint)) as bytes")
    return R.check_manifest(rows)


def cards(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey % 40 as project_id", "p_partkey as seq", "if(p_partkey % 9 = 0, '  ', p_name) as text", "if(p_partkey % 11 = 0, 'bottom', 'top-left') as position", "if(p_partkey % 13 = 0, 'neon', 'outlined-label-v1') as style")


_CARDS = "_c AS (SELECT p_partkey % 40 AS project_id, p_partkey AS seq, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE trim(regexp_replace(p_name, '\\s+', ' ', 'g')) END AS text, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) - 1 AS i FROM part)"


@query(f"WITH {_CARDS} SELECT project_id, seq, text, CASE WHEN i % 2 = 0 THEN '#356AE6' ELSE '#43A85B' END AS accent FROM _c WHERE text <> ''")
def compile_title_cards(spark, sf):
    return R.check_title_cards(cards(spark, sf), ["#356AE6", "#43A85B"])[0]


@query(broken("project_id, seq", "_c", ("missing-text", "text = ''"), ("position", "text <> '' AND seq % 11 = 0"), ("style", "text <> '' AND seq % 13 = 0"), ("too-long", "length(text) > 18"), with_=f"WITH {_CARDS} "))
def check_title_cards(spark, sf):
    return R.check_title_cards(cards(spark, sf), ["#356AE6", "#43A85B"])[1]


@query(broken("project_id, n", "_w", ("invalid", "written = spoken"), ("repeated", "r > 1"), ("unused", "NOT contains(text, written)"), ("no-reason", "n = 2 AND project_id % 3 = 0"), ("not-approved", "n = 3 AND project_id % 4 = 0"),
    with_="WITH o AS (SELECT doc_id AS project_id, text, unnest([1, 2, 3]) AS n, unnest(['the', 'and', CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE 'xyzzy' END]) AS written, unnest(['thee', CASE WHEN doc_id % 5 = 0 THEN 'and' ELSE 'und' END, 'foo']) AS spoken FROM documents), _w AS (SELECT *, row_number() OVER (PARTITION BY project_id, written ORDER BY n) AS r FROM o) "))
def check_pronunciation(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id as project_id", "text")
    rows = docs.selectExpr("project_id", "stack(3, 1, 'the', 'thee', 'x', true, 2, 'and', if(project_id % 5 = 0, 'and', 'und'), if(project_id % 3 = 0, ' ', 'x'), true, 3, if(project_id % 2 = 0, 'the', 'xyzzy'), 'foo', 'x', project_id % 4 <> 0) as (n, written, spoken, reason, approved)")
    return R.check_pronunciation(rows, docs)


@query(broken("o_orderkey", "_j", ("changed-o_orderstatus", "o_orderkey % 10 = 0 AND o_orderstatus <> 'X'"), ("changed-o_totalprice", "o_orderkey % 15 = 0"), with_="WITH _j AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) "))
def check_immutable(spark, sf):
    old = table(spark, sf, "orders")
    new = old.where("o_orderkey % 7 <> 0").withColumns({"o_orderstatus": F.expr("if(o_orderkey % 10 = 0, 'X', o_orderstatus)"), "o_totalprice": F.expr("if(o_orderkey % 15 = 0, o_totalprice + 1, o_totalprice)")})
    return R.check_immutable(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(with_views("v_words", "v_scenes", select="+ " + _PAIRS + ", _r AS (SELECT * FROM _g WHERE from_scene % 10 <> 0)\n=\nSELECT from_scene, 'one-copy' AS rule_id, 'error' AS severity, NULL::VARCHAR AS value FROM _g WHERE gap_ms IS NULL OR from_scene % 10 = 0 UNION ALL SELECT from_scene, 'copies-differ', 'error', NULL FROM _r WHERE gap_ms >= 300 AND from_scene % 3 = 0"))
def check_transitions(spark, sf):
    words, scenes = words_and_scenes(spark, sf)
    plan = transition_plan(scene_words(words, scenes), scenes)
    return R.check_transitions(plan, plan.where("from_scene % 10 <> 0").withColumn("hold_ms", F.expr("if(from_scene % 3 = 0, hold_ms + 1, hold_ms)")))


_LANGUAGES = ("en", "en_US", "EN-gb", "zh", "zh-Hant", " zh_CN ", "de", "auto", "", None)
_TRACK_CUES = "CASE WHEN project_id % 11 = 0 AND cue_no % 2 = 0 THEN '今天我们讲一个故事' WHEN project_id % 13 = 0 THEN 'Like and' || CASE WHEN cue_no % 2 = 0 THEN ' ' ELSE chr(160) || 'subscribe' END WHEN project_id % 17 = 0 AND cue_no > 3 THEN text || ' 中文' WHEN project_id % 19 = 0 THEN text || ' 请点 赞' ELSE text END"


def gate_cues(spark, sf):
    """Cues with Chinese, promotion and repeats put in, and up to three cues of every fifth project only."""
    cues = v_cues(spark, sf).where("project_id % 5 <> 0 or cue_no < 3")
    return cues.withColumn("text", F.expr(_TRACK_CUES.replace("chr(160)", "'\u00a0'")))


def gate_tracks(spark, sf):
    end = v_cues(spark, sf).groupBy("project_id").agg(F.max("end_ms").alias("e"))
    language = F.element_at(F.array(*map(F.lit, _LANGUAGES)), F.expr("int(project_id % 10 + 1)"))
    return end.select("project_id", F.expr("(e + 1000) * (1 + project_id % 4 * 7)").alias("duration_ms"), language.alias("language"), F.expr("if(project_id % 7 = 3, null, project_id % 9 / 8D)").alias("probability"))


# The rules in the order a reader meets them, letters counted one by one.
@query(with_views("v_cues", select=f"""+ _c AS (SELECT project_id, cue_no, start_ms, end_ms, {_TRACK_CUES} AS text FROM v_cues WHERE project_id % 5 <> 0 OR cue_no < 3),
_k AS (SELECT project_id, max(end_ms) + 1000 AS e FROM v_cues GROUP BY project_id),
_tr AS (SELECT project_id, e * (1 + project_id % 4 * 7) AS d, CASE WHEN project_id % 10 < 3 THEN 'en' WHEN project_id % 10 < 6 THEN 'zh' WHEN project_id % 10 = 6 THEN 'de' ELSE 'auto' END AS lang, CASE WHEN project_id % 7 = 3 THEN NULL ELSE project_id % 9 / 8 END AS p FROM _k),
_le AS (SELECT *, len(list_filter(string_split(text, ''), lambda x: ord(x) BETWEEN 13312 AND 40959)) AS cjk,
  len(list_filter(string_split(text, ''), lambda x: ord(x) BETWEEN 65 AND 90 OR ord(x) BETWEEN 97 AND 122)) AS latin, {WORDS} AS words FROM _c),
_s AS (SELECT project_id, count(*) AS n, sum(cjk) AS cjk, sum(latin) AS latin, sum(words) AS words, max_by(end_ms, cue_no) - min_by(start_ms, cue_no) AS span FROM _le GROUP BY project_id),
_f AS (SELECT *, CASE WHEN lang = 'zh' THEN cjk ELSE words END AS units, span / d AS share FROM _tr JOIN _s USING (project_id)),
_p AS (SELECT project_id, lang, i + 1 AS third, sum(l.cjk) AS cjk, sum(l.latin) AS latin FROM _tr JOIN _le l USING (project_id), range(3) r(i) WHERE (l.start_ms + l.end_ms) / 2 >= i * (d / 3) AND (l.start_ms + l.end_ms) / 2 < (i + 1) * (d / 3) GROUP BY ALL),
_r AS (SELECT project_id, count(*) AS keys, count(DISTINCT k) AS different FROM (SELECT project_id, replace(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), 'ß', 'ss') AS k FROM _c) WHERE k <> '' GROUP BY project_id),
_w AS (SELECT project_id, lower(replace(replace(string_agg(text, '' ORDER BY cue_no), ' ', ''), chr(160), '')) AS w FROM _c GROUP BY project_id)
=
SELECT project_id, unnest(list_filter([CASE WHEN lang = 'auto' THEN 'unknown-language' END, CASE WHEN p < 0.5 THEN 'low-probability' END, CASE WHEN lang = 'en' AND cjk > greatest(4, round_even(latin * 0.15, 0)) THEN 'foreign-letters' END,
  CASE WHEN lang = 'zh' AND cjk = 0 AND latin >= 20 THEN 'no-chinese' END, CASE WHEN d >= 30000 AND n < greatest(2, round_even(d / 45000, 0)) THEN 'few-cues' END, CASE WHEN d >= 30000 AND units / greatest(d / 60000, 1 / 60) < 8 THEN 'few-units' END,
  CASE WHEN d >= 30000 AND share < 0.35 THEN 'low-coverage' END], lambda x: x IS NOT NULL)) AS rule_id, 'error' AS severity, NULL::VARCHAR AS value FROM _f
UNION ALL SELECT project_id, 'thin-coverage', 'warning', NULL FROM _f WHERE d >= 30000 AND share >= 0.35 AND share < 0.60
UNION ALL SELECT project_id, 'third-foreign', 'error', third::VARCHAR FROM _p WHERE lang = 'en' AND cjk > greatest(4, round_even(latin * 0.35, 0))
UNION ALL SELECT project_id, 'third-no-chinese', 'error', third::VARCHAR FROM _p WHERE lang = 'zh' AND cjk = 0 AND latin >= 20
UNION ALL SELECT project_id, 'repeats', 'error', NULL FROM _r WHERE keys >= 6 AND (keys - different) / keys > 0.35
UNION ALL SELECT project_id, 'promotion', 'error', NULL FROM _w JOIN _f USING (project_id) WHERE units < 40 AND (contains(w, '点赞') OR contains(w, '订阅') OR contains(w, '转发') OR contains(w, '打赏') OR contains(w, 'likeandsubscribe'))"""))
def transcript_gate(spark, sf):
    return R.transcript_gate(gate_cues(spark, sf), gate_tracks(spark, sf))


@query("SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 17 = 0 THEN 'prepare-script' WHEN o_orderkey % 13 = 0 THEN 'await-script-style-approval' WHEN o_orderkey % 11 = 0 THEN 'prepare-script-voice' WHEN o_orderkey % 7 = 0 THEN 'await-script-voice-approval' WHEN o_orderkey % 5 >= 3 OR o_orderkey % 6 = 0 THEN 'prepare-boards' WHEN o_orderkey % 4 = 0 THEN 'await-boards-approval' WHEN o_orderstatus = 'O' THEN 'ready-to-render' WHEN o_custkey % 3 = 0 THEN 'complete' WHEN o_custkey % 3 = 1 THEN 'fix-required' ELSE 'await-final-qa' END AS stage FROM orders")
def derive_stage(spark, sf):
    return S.derive_stage(stage_flags(spark, sf))


def stage_flags(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as project_id", "o_orderkey % 17 <> 0 as has_script", "o_orderkey % 13 <> 0 as style_ok", "o_orderkey % 11 <> 0 as has_voice", "o_orderkey % 7 <> 0 as voice_ok", "3 as scenes", "if(o_orderkey % 5 >= 3, 2, 3) as boards", "o_orderkey % 6 <> 0 as plan_ready",
        "o_orderkey % 4 <> 0 as boards_ok", "o_orderstatus <> 'O' as final_current", "o_custkey % 3 = 0 as qa_current", "if(o_custkey % 3 = 1, false, null) as qa_ok")


@query(with_views("v_art_old", "v_art_new", select="SELECT n.path AS scene_id, CASE WHEN o.path IS NULL THEN 'no_prior_cache' WHEN o.sha256 <> n.sha256 THEN 'image_modified' WHEN n.bytes % 9 = 0 THEN 'frame_plan_modified' END AS reason FROM v_art_new n LEFT JOIN v_art_old o USING (path)"))
def invalidation_reason(spark, sf):
    old = v_art_old(spark, sf).selectExpr("path as scene_id", "sha256 as image_sha256", "bytes as frame_plan")
    new = v_art_new(spark, sf).selectExpr("path as scene_id", "sha256 as image_sha256", "if(bytes % 9 = 0, bytes + 1, bytes) as frame_plan")
    return S.invalidation_reason(old, new, ["frame_plan", "image_sha256"])


@query(with_views("v_art_old", "v_art_new", select="+ _s AS (SELECT o.path FROM v_art_old o LEFT JOIN v_art_new n ON o.path = n.path WHERE o.sha256 IS DISTINCT FROM n.sha256)\n=\nSELECT doc_id * 2 + k AS scene_id, doc_id || '.txt' AS source, s.path IS NOT NULL AS stale, s.path IS NULL AND k = 0 AS approved FROM documents CROSS JOIN (VALUES (0), (1)) v(k) LEFT JOIN _s s ON s.path = doc_id || '.txt'"))
def stale_cascade(spark, sf):
    from cuespan.operators.joins import stale_artifacts

    changed = stale_artifacts(v_art_old(spark, sf), v_art_new(spark, sf)).selectExpr("path as source")
    boards = table(spark, sf, "documents").selectExpr("doc_id", "explode(array(0, 1)) as k").selectExpr("doc_id * 2 + k as scene_id", "concat(doc_id, '.txt') as source", "k = 0 as approved")
    return S.stale_cascade(changed, boards)


@query(with_views("v_art_old", "v_art_new", select="SELECT (o.bytes % 50)::BIGINT AS project_id, bool_and(coalesce(o.sha256 = n.sha256, FALSE)) AS current FROM v_art_old o LEFT JOIN v_art_new n ON n.path = o.path AND n.bytes % 50 = o.bytes % 50 GROUP BY o.bytes % 50"))
def qa_current(spark, sf):
    reports, finals = (f(spark, sf).selectExpr("bytes % 50 as project_id", "path as name", "sha256") for f in (v_art_old, v_art_new))
    return S.qa_current(reports, finals)


@query(with_views("v_scenes", select="+ _f AS (SELECT project_id, min_by(scene_id, seq) AS scene_id FROM v_scenes WHERE scene_id NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY project_id), _p AS (SELECT DISTINCT project_id FROM v_scenes)\n=\nSELECT project_id, CASE WHEN f.scene_id IS NULL THEN 'render' ELSE 'add-board' END AS action, f.scene_id FROM _p LEFT JOIN _f f USING (project_id)"))
def next_action(spark, sf):
    scenes, boards = v_scenes(spark, sf), table(spark, sf, "lineitem").selectExpr("l_orderkey as scene_id").distinct()
    lacking = scenes.join(boards, "scene_id", "left_anti").select("project_id").distinct().withColumn("stage", F.lit("prepare-boards"))
    stages = scenes.select("project_id").distinct().join(lacking, "project_id", "left").withColumn("stage", F.coalesce("stage", F.lit("ready-to-render")))
    return S.next_action(stages, scenes, boards)
