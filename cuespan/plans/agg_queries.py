"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.operators import aggs as A
from cuespan.plans.fixtures import table, v_cues, v_elements, v_frames, v_motion, v_scenes, v_words, with_views
from cuespan.plans.registry import query
from cuespan.plans.window_queries import HAND_SQL

LATIN = "len(regexp_extract_all(text, '[A-Za-z]'))"
CJK = "len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}]'))"
WORDS = "len(regexp_extract_all(regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g'), '\\b[A-Za-z]+(?:[''’-][A-Za-z]+)*\\b'))"
_DURATION = "_dur AS (SELECT project_id, max(end_ms) + 1000 AS duration_ms FROM v_cues GROUP BY project_id)"


def durations(cues):
    return cues.groupBy("project_id").agg((F.max("end_ms") + 1000).alias("duration_ms"))


@query("SELECT user_id AS project_id, count(*) AS shot_count, count(DISTINCT event_id % 7) AS section_count, count(*) FILTER (event_type = 'view') AS a_roll_shots, count(*) FILTER (event_type <> 'view') AS b_roll_shots, round_even(count(*) FILTER (event_type = 'view') / count(*)::DOUBLE, 3) AS a_roll_ratio, coalesce(string_agg(event_id, ',' ORDER BY event_id) FILTER (event_type = 'error'), '') AS exceptions FROM events GROUP BY user_id")
def plan_summary(spark, sf):
    shots = (table(spark, sf, "events").selectExpr("user_id as project_id", "event_id as shot_id", "event_id % 7 as section", "if(event_type = 'view', 'a-roll', 'b-roll') as mode", "event_type = 'error' as excepted"))
    return A.plan_summary(shots).withColumn("exceptions", F.array_join("exceptions", ","))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def template_counts(spark, sf):
    return A.template_counts(table(spark, sf, "events"), "event_type")


@query("""WITH c AS (SELECT label AS clip_id, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS q, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE AS p FROM embeddings),
g AS (SELECT clip_id, sum(n)::BIGINT AS samples, sum(q) AS q, max(p) AS peak FROM c GROUP BY clip_id)
SELECT clip_id, samples, round(sqrt(q / samples), 6) AS rms, round(peak, 6) AS peak, round_even(samples / 48000.0::DOUBLE * 1000, 0)::BIGINT AS duration_ms, sqrt(q / samples) >= 0.0005 AS non_silent FROM g""")
def audio_levels(spark, sf):
    return A.audio_levels(table(spark, sf, "embeddings").select(F.col("label").alias("clip_id"), F.col("embedding").alias("samples")))


@query(with_views("v_cues", select=f"""+ {_DURATION}, _c AS (SELECT project_id, count(*) AS cue_count, sum({CJK})::BIGINT AS cjk, sum({LATIN})::BIGINT AS latin, sum({WORDS})::BIGINT AS words, min(start_ms) AS a, max(end_ms) AS b FROM v_cues GROUP BY project_id)
=
SELECT project_id, cue_count, cjk, latin, words, round(words / greatest(duration_ms / 60000.0::DOUBLE, 1 / 60.0::DOUBLE), 4) AS words_per_minute, round((b - a) / duration_ms::DOUBLE, 4) AS span_ratio FROM _c JOIN _dur USING (project_id)"""))
def transcript_metrics(spark, sf):
    cues = v_cues(spark, sf)
    return A.transcript_metrics(cues, durations(cues))


@query(with_views("v_cues", select="""+ _k AS (SELECT project_id, replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g')), 'ß', 'ss') AS k FROM v_cues)
=
SELECT project_id, count(*) AS keys, count(*) - count(DISTINCT k) AS repeated, count(*) >= 6 AND (count(*) - count(DISTINCT k)) / count(*)::DOUBLE > 0.35 AS flagged FROM _k WHERE k <> '' GROUP BY project_id"""))
def repeat_ratio(spark, sf):
    return A.repeat_ratio(v_cues(spark, sf))


@query(with_views("v_cues", select=f"""+ {_DURATION}, _c AS (SELECT project_id, floor((start_ms + end_ms) / 2.0::DOUBLE / greatest(duration_ms / 3.0::DOUBLE, 1))::INT AS third, text FROM v_cues JOIN _dur USING (project_id))
=
SELECT project_id, third, sum({CJK})::BIGINT AS cjk, sum({LATIN})::BIGINT AS latin FROM _c WHERE third BETWEEN 0 AND 2 GROUP BY ALL"""))
def thirds_language(spark, sf):
    cues = v_cues(spark, sf)
    return A.thirds_language(cues, durations(cues))


@query(with_views("v_scenes", select="SELECT project_id, count(*) AS n, round_even(avg(end_ms - start_ms), 0)::BIGINT AS avg_ms, min(end_ms - start_ms) AS min_ms, max(end_ms - start_ms) AS max_ms, round((count(*) - 1) / (max(end_ms) / 60000.0::DOUBLE), 4) AS cuts_per_minute FROM v_scenes GROUP BY project_id"))
def pacing_stats(spark, sf):
    return A.pacing_stats(v_scenes(spark, sf))


_THRESHOLD = """_x AS (SELECT * FROM v_motion QUALIFY time_ms > min(time_ms) OVER (PARTITION BY video_id)), _m AS (SELECT video_id, quantile_cont(score, 0.5) AS m, quantile_cont(score, 0.9) AS p FROM _x GROUP BY video_id),
_d AS (SELECT video_id, any_value(m) AS m, any_value(p) AS p, quantile_cont(abs(score - m), 0.5) AS mad FROM _x JOIN _m USING (video_id) GROUP BY video_id),
_h AS (SELECT v.video_id, round(coalesce(greatest(12, p, m + 4 * greatest(1, 1.4826::DOUBLE * mad)), 12), 4) AS threshold FROM (SELECT DISTINCT video_id FROM v_motion) v LEFT JOIN _d USING (video_id))"""


@query(with_views("v_motion", select="+ " + _THRESHOLD + "\n=\nSELECT * FROM _h"))
def robust_threshold(spark, sf):
    return A.robust_threshold(v_motion(spark, sf))


@query(with_views("v_motion", select="""+ _s AS (SELECT video_id, time_ms // 4000 AS scene_no, min(time_ms) AS start_ms, max(time_ms) + 250 AS end_ms FROM v_motion GROUP BY ALL),
_j AS (SELECT s.*, coalesce(avg(score), 0) AS s FROM _s s LEFT JOIN v_motion m ON m.video_id = s.video_id AND m.time_ms >= start_ms + 250 AND m.time_ms < end_ms GROUP BY ALL)
=
SELECT video_id, scene_no, start_ms, end_ms, CASE WHEN s < 1.5 THEN 'low-frame-difference' WHEN s < 4.5 THEN 'subtle-motion' ELSE 'active-motion' END AS motion_type FROM _j"""))
def motion_class(spark, sf):
    motion = v_motion(spark, sf)
    scenes = motion.withColumn("scene_no", F.expr("time_ms div 4000")).groupBy("video_id", "scene_no").agg(F.min("time_ms").alias("start_ms"), (F.max("time_ms") + 250).alias("end_ms"))
    return A.motion_class(motion, scenes).drop("score")


@query(with_views("v_frames", select="+ " + HAND_SQL + """,
_a AS (SELECT key, count(*) AS frames, count(*) FILTER (shown) AS visible_frames, round(coalesce(max(step), 0), 5) AS max_step, round(coalesce(quantile_cont(step, 0.95), 0), 5) AS p95_step, round(coalesce(max(delta), 0), 5) AS max_delta FROM _q GROUP BY key),
_b AS (SELECT key, count(*) FILTER (kind = 'hold-then-jump') AS hold_then_jump, count(*) FILTER (kind = 'single-frame-gap') AS single_frame_gap, count(*) FILTER (kind = 'abrupt-disappearance') AS abrupt, count(*) AS violations FROM _v GROUP BY key)
=
SELECT key, frames, visible_frames, max_step, p95_step, max_delta, coalesce(hold_then_jump, 0) AS hold_then_jump, coalesce(single_frame_gap, 0) AS single_frame_gap, coalesce(abrupt, 0) AS abrupt, coalesce(violations, 0) AS violations, CASE WHEN coalesce(violations, 0) = 0 THEN 'passed' ELSE 'failed' END AS status FROM _a LEFT JOIN _b USING (key)"""))
def hand_motion_summary(spark, sf):
    return A.hand_motion_summary(v_frames(spark, sf))


@query(with_views("v_elements", select="SELECT scene_id AS board_id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y) + 1 AS y1 FROM v_elements GROUP BY scene_id"))
def foreground_bbox(spark, sf):
    return A.foreground_bbox(v_elements(spark, sf).selectExpr("scene_id as board_id", "y", "x as x0", "x + w as x1"))


@query(with_views("v_elements", select="SELECT scene_id AS board_id, median(x % 256)::DOUBLE AS r, median(y % 256)::DOUBLE AS g, median(h % 256)::DOUBLE AS b FROM v_elements GROUP BY scene_id"))
def corner_background(spark, sf):
    return A.corner_background(v_elements(spark, sf).selectExpr("scene_id as board_id", "x % 256 as r", "y % 256 as g", "h % 256 as b"))


@query("""WITH v AS (SELECT vec_id // 10 AS grp, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.grp, round(max(list_distance(a.v, b.v)), 4) AS distance, round(max(list_distance(a.v, b.v)), 4) > 35 AS flagged FROM v a JOIN v b ON a.grp = b.grp AND a.id < b.id GROUP BY a.grp""")
def max_pairwise_distance(spark, sf):
    return A.max_pairwise_distance(table(spark, sf, "embeddings").selectExpr("vec_id div 10 as grp", "vec_id as id", "embedding as v"), "grp")


_ISSUES = "_v AS (SELECT o_custkey AS project_id, l_orderkey AS scene_id, CASE WHEN l_quantity > 25 THEN 'error' ELSE 'warning' END AS severity, 'part ' || l_partkey || ' line ' || l_linenumber AS message FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def issues(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.selectExpr("o_custkey as project_id", "l_orderkey as scene_id", "if(l_quantity > 25, 'error', 'warning') as severity", "concat('part ', l_partkey, ' line ', l_linenumber) as message")


@query(f"WITH {_ISSUES} SELECT project_id, scene_id, grouping(project_id, scene_id)::INT AS level, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS ok FROM _v GROUP BY ROLLUP (project_id, scene_id)")
def qa_rollup(spark, sf):
    return A.qa_rollup(issues(spark, sf))


@query(f"WITH {_ISSUES}, _n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scene_id, message) AS n FROM _v) SELECT project_id, string_agg(n || '. ' || message, chr(10) ORDER BY n) AS report FROM _n GROUP BY project_id")
def issue_report(spark, sf):
    return A.issue_report(issues(spark, sf))


@query(with_views("v_words", "v_scenes", select="""+ _j AS (SELECT s.project_id, t, w, CASE WHEN s.project_id % 3 = 0 THEN NULL ELSE w + 700 END AS a FROM (SELECT project_id, max(end_ms) AS t FROM v_scenes GROUP BY project_id) s JOIN (SELECT project_id, max(end_ms) AS w FROM v_words GROUP BY project_id) USING (project_id))
=
SELECT project_id, t AS timeline_end_ms, w AS words_end_ms, coalesce(a, w) AS audio_duration_ms, greatest(t, w, coalesce(a, 0)) AS target_duration_ms, greatest(t, w, coalesce(a, 0)) - t AS tail_extension_ms FROM _j"""))
def duration_plan(spark, sf):
    words = v_words(spark, sf)
    audio = words.groupBy("project_id").agg(F.expr("if(project_id % 3 = 0, null, max(end_ms) + 700)").alias("audio_ms"))
    return A.duration_plan(v_scenes(spark, sf), words, audio)


@query(with_views("v_elements", select="SELECT scene_id AS board_id, sha256(string_agg(y || ',' || x || ',' || (x + w) || ',' || element_id, ';' ORDER BY y, x, x + w, element_id)) AS sha256 FROM v_elements GROUP BY scene_id"))
def map_checksum(spark, sf):
    return A.map_checksum(v_elements(spark, sf).selectExpr("scene_id as board_id", "element_id", "y", "x as x0", "x + w as x1"))


@query(with_views("v_elements", select="""+ _r AS (SELECT scene_id AS board_id, seq AS group_id, w * h AS area, w, h, row_number() OVER (PARTITION BY scene_id ORDER BY w * h DESC, seq)::INT AS rank FROM v_elements)
=
SELECT *, CASE WHEN rank = 1 THEN 'subject' WHEN w / h::DOUBLE >= 2.5 OR h / w::DOUBLE >= 2.5 THEN 'text' ELSE 'contour' END AS kind FROM _r"""))
def dominant_group(spark, sf):
    return A.dominant_group(v_elements(spark, sf).selectExpr("scene_id as board_id", "seq as group_id", "w * h as area", "w", "h"))


@query(with_views("v_elements", select="""+ _w AS (SELECT scene_id, seq, dur_ms, (240 - count(*) OVER p) * dur_ms / (sum(dur_ms) OVER p)::DOUBLE AS raw, 240 - count(*) OVER p AS spare FROM v_elements WINDOW p AS (PARTITION BY scene_id)),
_n AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY raw - floor(raw) DESC, seq) AS nth, spare - sum(floor(raw)) OVER (PARTITION BY scene_id) AS rest FROM _w)
=
SELECT scene_id, seq, (1 + floor(raw) + CASE WHEN nth <= rest THEN 1 ELSE 0 END)::BIGINT AS units FROM _n"""))
def largest_remainder(spark, sf):
    return A.largest_remainder(v_elements(spark, sf), 240, "dur_ms", "scene_id", "seq").select("scene_id", "seq", "units")
