"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.operators import windows as W
from cuespan.operators.joins import scene_words
from cuespan.plans.fixtures import table, v_cues, v_elements, v_frames, v_motion, v_scenes, v_words, with_views, words_and_scenes
from cuespan.plans.registry import query

#: Scene lengths by scene, for elements.
_LENGTHS = "_len AS (SELECT scene_id, end_ms - start_ms AS duration_ms FROM v_scenes)"


def lengths(spark, sf):
    return v_scenes(spark, sf).selectExpr("scene_id", "end_ms - start_ms as duration_ms")


@query(with_views("v_cues", recursive=True, select="""+ _s AS (SELECT project_id, cue_no, row_number() OVER (PARTITION BY project_id ORDER BY cue_no) AS i, start_ms - 900 * (cue_no % 3) AS s, end_ms - 1500 * (cue_no % 2) AS e FROM v_cues),
_r AS (SELECT project_id, cue_no, i, greatest(0, s) AS s, greatest(greatest(0, s) + 1, e) AS e FROM _s WHERE i = 1
UNION ALL SELECT n.project_id, n.cue_no, n.i, greatest(_r.e, n.s), greatest(greatest(_r.e, n.s) + 1, n.e) FROM _r JOIN _s n ON n.project_id = _r.project_id AND n.i = _r.i + 1)
=
SELECT project_id, cue_no, s AS start_ms, e AS end_ms FROM _r"""))
def monotone_clamp(spark, sf):
    cues = v_cues(spark, sf).selectExpr("project_id", "cue_no", "start_ms - 900 * (cue_no % 3) as start_ms", "end_ms - 1500 * (cue_no % 2) as end_ms")
    return W.monotone_clamp(cues, ["project_id"], ["cue_no"])


@query(with_views("v_words", select="""+ _w AS (SELECT project_id, idx, start_ms, CASE WHEN idx % 3 = 0 THEN start_ms ELSE end_ms END AS end_ms FROM v_words),
_n AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY project_id ORDER BY idx), 10000000) AS n FROM _w)
=
SELECT project_id, idx, start_ms, greatest(start_ms + 1, CASE WHEN end_ms <= start_ms + 1 AND n > start_ms THEN n ELSE end_ms END) AS end_ms FROM _n"""))
def fill_zero_durations(spark, sf):
    words = v_words(spark, sf).selectExpr("project_id", "idx", "start_ms", "if(idx % 3 = 0, start_ms, end_ms) as end_ms")
    audio = words.select("project_id").distinct().withColumn("audio_ms", F.lit(10000000))
    return W.fill_zero_durations(words, audio)


_PAIRS = """_s AS (SELECT s.project_id, s.scene_id, s.seq, min(w.start_ms) AS f, max(w.end_ms) AS l FROM v_scenes s LEFT JOIN v_words w ON w.project_id = s.project_id AND w.start_ms < s.end_ms AND w.end_ms > s.start_ms GROUP BY ALL),
_p AS (SELECT project_id, scene_id AS from_scene, lead(scene_id) OVER p AS to_scene, l AS previous_end_ms, lead(f) OVER p AS next_start_ms FROM _s WINDOW p AS (PARTITION BY project_id ORDER BY seq)),
_g AS (SELECT *, next_start_ms - previous_end_ms AS gap_ms, least(420, least(next_start_ms - previous_end_ms, 500) - 60) AS er FROM _p WHERE to_scene IS NOT NULL)"""


@query(with_views("v_words", "v_scenes", select="+ " + _PAIRS + """
=
SELECT project_id, from_scene, to_scene, previous_end_ms, next_start_ms, gap_ms, CASE WHEN gap_ms >= 300 THEN gap_ms - er - 60 END AS hold_ms, CASE WHEN gap_ms >= 300 THEN er END AS erase_ms,
CASE WHEN gap_ms >= 300 THEN next_start_ms - 60 - er END AS erase_start_ms, CASE WHEN gap_ms >= 300 THEN next_start_ms - 60 END AS clean_start_ms,
CASE WHEN gap_ms IS NULL THEN 'missing-words' WHEN gap_ms < 300 THEN 'short-gap' END AS rule_id FROM _g"""))
def transition_plan(spark, sf):
    words, scenes = words_and_scenes(spark, sf)
    return W.transition_plan(scene_words(words, scenes), scenes)


_PACED = """+ _e AS (SELECT e.*, l.duration_ms, CASE WHEN scene_id % 50 = 0 AND seq = 1 THEN NULL ELSE start_ms END AS s0 FROM v_elements e JOIN _len l USING (scene_id)),
_v AS (SELECT *, CASE WHEN count(s0) OVER p = count(*) OVER p THEN s0 ELSE 100 + (seq - 1) * greatest(500, (duration_ms - 200) // count(*) OVER p) END AS s FROM _e WINDOW p AS (PARTITION BY scene_id)),
_n AS (SELECT *, lead(s) OVER (PARTITION BY scene_id ORDER BY seq) AS n FROM _v),
_a AS (SELECT *, greatest(0, coalesce(nullif(n, 0), duration_ms) - s) AS a FROM _n),
_t AS (SELECT *, greatest(1500, least(round_even(a * CASE WHEN n IS NULL THEN 0.9::DOUBLE ELSE 0.92::DOUBLE END, 0)::BIGINT, 25000)) AS t FROM _a)
=
SELECT scene_id, seq, s AS new_start_ms, CASE WHEN n IS NOT NULL THEN CASE WHEN a > 1750 THEN least(t, a - 250) WHEN a > 350 THEN greatest(300, a - 50) ELSE greatest(100, a) END
ELSE CASE WHEN a > 2000 THEN least(t, a - 500) WHEN a > 1750 THEN least(t, a - 250) WHEN a > 350 THEN greatest(300, a - 250) ELSE greatest(100, a) END END AS new_dur_ms FROM _t"""


@query(with_views("v_scenes", "v_elements", select=_PACED.replace("+ ", "+ " + _LENGTHS + ", ", 1)))
def adaptive_pacing(spark, sf):
    elements = v_elements(spark, sf).withColumn("start_ms", F.expr("if(scene_id % 50 = 0 and seq = 1, null, start_ms)"))
    return W.adaptive_pacing(elements, lengths(spark, sf)).select("scene_id", "seq", "new_start_ms", "new_dur_ms")


@query(with_views("v_scenes", "v_elements", select="+ " + _LENGTHS + """,
_e AS (SELECT e.scene_id, e.seq, e.start_ms + e.dur_ms AS element_end_ms, coalesce(lead(e.start_ms) OVER w, duration_ms) AS next_start_ms, duration_ms, duration_ms - 400 AS er, CASE WHEN scene_id % 2 = 0 THEN duration_ms - 900 END AS na FROM v_elements e JOIN _len USING (scene_id) WINDOW w AS (PARTITION BY scene_id ORDER BY seq)),
_b AS (SELECT *, least(duration_ms, next_start_ms, er, coalesce(na, er)) AS boundary_ms FROM _e)
=
SELECT scene_id, seq, element_end_ms, next_start_ms, boundary_ms, element_end_ms + 100 AS action_start_ms, boundary_ms - 250 AS action_end_ms, greatest(0, boundary_ms - 350 - element_end_ms) AS budget_ms FROM _b"""))
def effect_window(spark, sf):
    scenes = lengths(spark, sf).selectExpr("*", "duration_ms - 400 as erase_ms", "if(scene_id % 2 = 0, duration_ms - 900, null) as narration_ms")
    return W.effect_window(v_elements(spark, sf), scenes).select("scene_id", "seq", "element_end_ms", "next_start_ms", "boundary_ms", "action_start_ms", "action_end_ms", "budget_ms")


@query(with_views("v_motion", select="SELECT video_id, time_ms, score FROM v_motion QUALIFY score >= 20 AND score >= lag(score) OVER (PARTITION BY video_id ORDER BY time_ms) AND score >= lead(score) OVER (PARTITION BY video_id ORDER BY time_ms)"))
def local_peaks(spark, sf):
    motion = v_motion(spark, sf)
    return W.local_peaks(motion, motion.select("video_id").distinct().withColumn("threshold", F.lit(20.0)))


@query(with_views("v_scenes", select="""+ _t AS (SELECT project_id, max(end_ms) + 500 AS target_ms FROM v_scenes GROUP BY project_id),
_e AS (SELECT s.*, coalesce(lead(start_ms) OVER (PARTITION BY project_id ORDER BY seq), target_ms) AS re FROM v_scenes s JOIN _t USING (project_id)),
_f AS (SELECT *, ceil(start_ms * 30 / 1000.0::DOUBLE)::BIGINT AS start_frame, ceil(re * 30 / 1000.0::DOUBLE)::BIGINT AS end_frame FROM _e),
_b AS (SELECT *, coalesce(lag(end_frame) OVER (PARTITION BY project_id ORDER BY seq), 0) AS b FROM _f),
_l AS (SELECT *, greatest(0, start_frame - b) AS lead_frames, end_frame - b AS target_frames FROM _b)
=
SELECT project_id, scene_id, start_frame, end_frame, lead_frames, target_frames,
round_even(lead_frames * 1000 / 30.0::DOUBLE, 0)::BIGINT + end_ms - start_ms + greatest(0, round_even(end_frame * 1000 / 30.0::DOUBLE, 0)::BIGINT - end_ms) AS total_ms,
CASE WHEN re < end_ms THEN 'narration-beyond-window' WHEN target_frames <= 0 THEN 'empty-frame-range' WHEN lead_frames >= target_frames THEN 'no-content-frames' END AS rule_id FROM _l"""))
def frame_render_plan(spark, sf):
    scenes = v_scenes(spark, sf)
    return W.frame_render_plan(scenes, scenes.groupBy("project_id").agg((F.max("end_ms") + 500).alias("target_ms")))


HAND_SQL = """_h AS (SELECT *, visible AND opacity > 0 AS shown FROM v_frames),
_s AS (SELECT *, CASE WHEN shown AND coalesce(lag(shown) OVER w, FALSE) THEN sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) / 1080 END AS step, state IN ('fast-draw', 'fast-color') OR coalesce(lag(state) OVER w IN ('fast-draw', 'fast-color'), FALSE) AS fast,
coalesce(lag(shown) OVER w, FALSE) AS b1, lag(opacity) OVER w AS o1, coalesce(lag(shown, 2) OVER w, FALSE) AS b2, lag(opacity, 2) OVER w AS o2, lag(shown) OVER w AS raw1 FROM _h WINDOW w AS (PARTITION BY key ORDER BY frame)),
_d AS (SELECT *, CASE WHEN step IS NOT NULL THEN coalesce(lag(step) OVER (PARTITION BY key ORDER BY frame), 0) END AS sb FROM _s),
_q AS (SELECT *, CASE WHEN NOT fast THEN abs(step - sb) END AS delta, CASE state WHEN 'draw' THEN 0.018 ELSE 0.022 END AS lim FROM _d),
_v AS (SELECT key, frame, 'abrupt-disappearance' AS kind, NULL::DOUBLE AS value FROM _q WHERE NOT shown AND b1 AND o1 > 0.35
UNION ALL SELECT key, frame, 'single-frame-gap', NULL FROM _q WHERE shown AND NOT coalesce(raw1, TRUE) AND b2 AND o2 > 0.35 AND opacity > 0.35
UNION ALL SELECT key, frame, 'max-step', round(step, 5) FROM _q WHERE NOT fast AND step > lim + 1e-9
UNION ALL SELECT key, frame, 'hold-then-jump', round(step, 5) FROM _q WHERE NOT fast AND sb <= 0.0015 AND step > 0.012
UNION ALL SELECT key, frame, 'step-delta', round(delta, 5) FROM _q WHERE delta > 0.0055)"""


@query(with_views("v_frames", select="+ " + HAND_SQL + "\n=\nSELECT * FROM _v"))
def hand_motion_qa(spark, sf):
    return W.hand_motion_qa(v_frames(spark, sf))


@query("SELECT user_id, event_id FROM events QUALIFY event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND event_type = lag(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def adjacent_repeat(spark, sf):
    return W.adjacent_repeat(table(spark, sf, "events"), ["event_type"], 3, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query(with_views("v_words", "v_scenes", select="""+ _m AS (SELECT DISTINCT project_id, start_ms AS m FROM v_scenes), _e AS (SELECT project_id, min(start_ms) AS lo, max(end_ms) AS hi FROM v_words GROUP BY project_id),
_g AS (SELECT project_id, m - lag(m) OVER (PARTITION BY project_id ORDER BY m) AS g FROM _m
UNION ALL SELECT e.project_id, coalesce(min(m) - any_value(lo), any_value(hi) - any_value(lo)) FROM _e e LEFT JOIN _m ON _m.project_id = e.project_id GROUP BY e.project_id
UNION ALL SELECT e.project_id, any_value(hi) - max(m) FROM _e e JOIN _m ON _m.project_id = e.project_id GROUP BY e.project_id)
=
SELECT project_id, max(g) AS gap_ms FROM _g JOIN _e USING (project_id) GROUP BY project_id"""))
def longest_static_gap(spark, sf):
    return W.longest_static_gap(v_scenes(spark, sf).select("project_id", F.col("start_ms").alias("at")), v_words(spark, sf))


@query(with_views("v_elements", select="SELECT scene_id, seq, start_ms, latest_end_ms FROM (SELECT scene_id, seq, start_ms, max(start_ms + dur_ms + seq % 3 * 400) OVER (PARTITION BY scene_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_end_ms FROM v_elements) WHERE start_ms < latest_end_ms"))
def overlap_check(spark, sf):
    rows = v_elements(spark, sf).selectExpr("scene_id", "seq", "start_ms", "start_ms + dur_ms + seq % 3 * 400 as end_ms")
    return W.overlap_check(rows, ["scene_id"], ["seq"]).select("scene_id", "seq", "start_ms", "latest_end_ms")


@query(with_views("v_scenes", "v_elements", select="+ " + _LENGTHS + """, _b AS (SELECT scene_id AS shot_id, seq AS beat_no, e.start_ms, e.start_ms + dur_ms AS end_ms, least(100, greatest(0, duration_ms - 1)) AS a, duration_ms AS d FROM v_elements e JOIN _len USING (scene_id))
=
SELECT shot_id, beat_no, CASE WHEN beat_no = 1 THEN a ELSE start_ms END AS start_ms, CASE WHEN beat_no > 1 THEN end_ms WHEN greatest(end_ms, least(d, a + 50)) <= a THEN least(d, a + 1) ELSE greatest(end_ms, least(d, a + 50)) END AS end_ms,
CASE WHEN beat_no = 1 THEN start_ms END AS trigger_start_ms, CASE WHEN beat_no = 1 THEN end_ms END AS trigger_end_ms FROM _b"""))
def opening_anchor(spark, sf):
    beats = v_elements(spark, sf).selectExpr("scene_id as shot_id", "seq as beat_no", "start_ms", "start_ms + dur_ms as end_ms")
    return W.opening_anchor(beats, lengths(spark, sf).selectExpr("scene_id as shot_id", "0L as shot_start_ms", "duration_ms as shot_end_ms"))


@query(with_views("v_elements", select="""+ _i AS (SELECT scene_id, seq, seq - 1 AS i, count(*) OVER (PARTITION BY scene_id) AS n FROM v_elements), _s AS (SELECT *, unnest(range(5)) AS slice FROM _i)
=
SELECT scene_id, seq, slice FROM _s WHERE (slice * n // 5 <= i AND i < (slice + 1) * n // 5) OR (slice * n // 5 >= (slice + 1) * n // 5 AND i = least(slice * n // 5, n - 1))"""))
def proportional_slice(spark, sf):
    return W.proportional_slice(v_elements(spark, sf), 5, ["scene_id"], ["seq"]).select("scene_id", "seq", F.col("slice").cast("bigint").alias("slice"))


@query(with_views("v_frames", select="SELECT key, frame, round(sum(coalesce(d, 0)) OVER (PARTITION BY key ORDER BY frame), 4) AS cum_len FROM (SELECT key, frame, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM v_frames WINDOW w AS (PARTITION BY key ORDER BY frame))"))
def path_length(spark, sf):
    return W.path_length(v_frames(spark, sf)).select("key", "frame", F.round("cum_len", 4).alias("cum_len"))


@query(with_views("v_frames", select="""+ _f AS (SELECT key, frame, x, y, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM v_frames WINDOW w AS (PARTITION BY key ORDER BY frame)),
_c AS (SELECT *, sum(d) OVER (PARTITION BY key ORDER BY frame) AS c FROM _f), _t AS (SELECT *, max(c) OVER (PARTITION BY key) AS t, lag(c) OVER w AS lo, lag(x) OVER w AS px, lag(y) OVER w AS py FROM _c WINDOW w AS (PARTITION BY key ORDER BY frame)),
_n AS (SELECT key, any_value(t) AS t, greatest(2, round_even(any_value(t) / 300, 0)::INT) AS n FROM _t GROUP BY key), _g AS (SELECT key, n, i, CASE WHEN i = n THEN t ELSE t * i / n END AS at FROM (SELECT key, t, n, unnest(range(n + 1)) AS i FROM _n))
=
SELECT g.key, g.i::INT AS i, round(CASE WHEN g.i = 0 THEN x ELSE px + (x - px) * (g.at - lo) / (c - lo) END, 3) AS x, round(CASE WHEN g.i = 0 THEN y ELSE py + (y - py) * (g.at - lo) / (c - lo) END, 3) AS y
FROM _g g JOIN _t t ON t.key = g.key AND ((g.i = 0 AND t.frame = 0) OR (g.i > 0 AND lo < g.at AND c >= g.at))"""))
def path_resample(spark, sf):
    return W.path_resample(v_frames(spark, sf), 300.0).select("key", "i", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(with_views("v_elements", select="""+ _b AS (SELECT scene_id AS shot_id, element_id AS subject, start_ms, start_ms + dur_ms * 3 AS end_ms FROM v_elements), _p AS (SELECT shot_id, start_ms AS l FROM _b UNION SELECT shot_id, end_ms FROM _b),
_i AS (SELECT shot_id, l AS left_ms, lead(l) OVER (PARTITION BY shot_id ORDER BY l) AS right_ms FROM _p)
=
SELECT i.shot_id, left_ms, right_ms, count(DISTINCT subject) AS subjects FROM _i i JOIN _b b ON b.shot_id = i.shot_id AND start_ms <= left_ms AND end_ms >= right_ms GROUP BY ALL HAVING count(DISTINCT subject) > 2"""))
def concurrent_subjects(spark, sf):
    return W.concurrent_subjects(v_elements(spark, sf).selectExpr("scene_id as shot_id", "element_id as subject", "start_ms", "start_ms + dur_ms * 3 as end_ms"))


@query(with_views("v_scenes", "v_elements", select="+ " + _LENGTHS + """, _a AS (SELECT e.scene_id, seq, dur_ms, coalesce(lead(e.start_ms) OVER (PARTITION BY e.scene_id ORDER BY seq) - e.start_ms, greatest(0, duration_ms - e.start_ms)) AS available_ms FROM v_elements e JOIN _len USING (scene_id))
=
SELECT * FROM _a WHERE available_ms >= 3000 AND dur_ms < available_ms * 0.55"""))
def idle_ratio(spark, sf):
    return W.idle_ratio(v_elements(spark, sf), lengths(spark, sf)).select("scene_id", "seq", "dur_ms", "available_ms")


@query(with_views("v_scenes", "v_elements", select="+ " + _LENGTHS + """, _e AS (SELECT scene_id, max(start_ms + dur_ms) AS e FROM v_elements GROUP BY scene_id),
_h AS (SELECT scene_id, scene_id % 3 <> 0 AS m, greatest(0, CASE WHEN scene_id % 3 <> 0 THEN duration_ms - 480 ELSE duration_ms END - coalesce(e, 0)) AS hold, scene_id % 90 AS clean FROM _len LEFT JOIN _e USING (scene_id))
=
SELECT scene_id, 'short-hold' AS rule_id, hold AS value FROM _h WHERE m AND hold < 250 UNION ALL SELECT scene_id, 'short-clean', clean FROM _h WHERE m AND clean < 60 UNION ALL SELECT scene_id, 'short-final-hold', hold FROM _h WHERE NOT m AND hold < 450"""))
def stable_hold(spark, sf):
    scenes = lengths(spark, sf).selectExpr("*", "if(scene_id % 3 <> 0, duration_ms - 480, null) as erase_start_ms", "if(scene_id % 3 <> 0, duration_ms - 60, null) as erase_end_ms", "if(scene_id % 3 <> 0, duration_ms - 60 + scene_id % 90, null) as clean_end_ms")
    return W.stable_hold(v_elements(spark, sf), scenes)


@query(with_views("v_frames", select="""+ _p AS (SELECT key, frame, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER (PARTITION BY key) AS n FROM v_frames WINDOW w AS (PARTITION BY key ORDER BY frame)),
_c AS (SELECT key, frame, 0 AS p, x, y FROM _p WHERE n < 3 OR frame = 0 UNION ALL SELECT key, frame, 1, x * 0.75 + nx * 0.25, y * 0.75 + ny * 0.25 FROM _p WHERE n >= 3 AND nx IS NOT NULL UNION ALL SELECT key, frame, 2, x * 0.25 + nx * 0.75, y * 0.25 + ny * 0.75 FROM _p WHERE n >= 3 AND nx IS NOT NULL UNION ALL SELECT key, frame, 3, x, y FROM _p WHERE n >= 3 AND nx IS NULL)
=
SELECT key, (row_number() OVER (PARTITION BY key ORDER BY frame, p) - 1)::INT AS i, x::DOUBLE AS x, y::DOUBLE AS y FROM _c"""))
def path_smooth(spark, sf):
    return W.path_smooth(v_frames(spark, sf).selectExpr("key", "frame as i", "x", "y"))


@query(with_views("v_words", select="""+ _c AS (SELECT project_id, idx AS pos, CASE WHEN idx % 4 = 1 OR idx % 7 = 2 THEN NULL ELSE start_ms END AS s, CASE WHEN idx % 4 = 1 OR idx % 7 = 2 THEN NULL ELSE end_ms END AS e FROM v_words),
_b AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 99999999) AS r,
count(s) OVER (PARTITION BY project_id ORDER BY pos) AS g FROM _c),
_k AS (SELECT *, count(*) OVER (PARTITION BY project_id, g, s IS NULL) AS n, row_number() OVER (PARTITION BY project_id, g, s IS NULL ORDER BY pos) - 1 AS k FROM _b), _u AS (SELECT *, greatest(n, r - l) AS span FROM _k)
=
SELECT project_id, pos, coalesce(s, round_even(l + span * k / n::DOUBLE, 0)::BIGINT) AS start_ms, coalesce(e, greatest(round_even(l + span * k / n::DOUBLE, 0)::BIGINT + 1, round_even(l + span * (k + 1) / n::DOUBLE, 0)::BIGINT)) AS end_ms FROM _u"""))
def interpolate_gaps(spark, sf):
    chars = v_words(spark, sf).selectExpr("project_id", "idx as pos", "if(idx % 4 = 1 or idx % 7 = 2, null, start_ms) as start_ms", "if(idx % 4 = 1 or idx % 7 = 2, null, end_ms) as end_ms")
    bounds = chars.select("project_id").distinct().selectExpr("project_id", "0L as first_ms", "99999999L as last_ms")
    return W.interpolate_gaps(chars, bounds)
