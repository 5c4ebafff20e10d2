"""Queries of frame and geometry projections and of the ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuespan.functions.text import CAPTION_PUNCTUATION
from cuespan.operators import folds as D, frames as C
from cuespan.operators.windows import local_peaks
from cuespan.plans.fixtures import COMPOSITIONS, table, v_cues, v_elements, v_frames, v_motion, v_words, with_views
from cuespan.plans.registry import query

_R = "round_even({}, 0)::BIGINT"


def budgets(spark, sf):
    return v_elements(spark, sf).withColumn("original_ms", F.col("dur_ms")).withColumn("dur_ms", F.expr("dur_ms - seq % 4 * 120"))


def _span(start, dur, fps=30):
    return f"({_R.format(f'({start} + {dur}) * {fps} / 1000.0::DOUBLE')} - {_R.format(f'{start} * {fps} / 1000.0::DOUBLE')})"


@query(with_views("v_elements", select=f"SELECT scene_id, seq, {_span('start_ms', 'dur_ms')} AS frames FROM v_elements"))
def frame_span(spark, sf):
    return v_elements(spark, sf).select("scene_id", "seq", C.frame_span(F.col("start_ms"), F.col("dur_ms"), 30).alias("frames"))


_PHASES = f"""_b AS (SELECT scene_id, seq, {_span('start_ms', '(dur_ms - seq % 4 * 120)')} AS t, {_span('start_ms', 'dur_ms')} AS o FROM v_elements),
_p AS (SELECT *, CASE WHEN o < 8 THEN 1 ELSE greatest(3, {_R.format('o * 0.2::DOUBLE')}) END AS pb, greatest(5, {_R.format('o * 0.04::DOUBLE')}) AS f0, {_R.format('o * 0.15::DOUBLE')} AS x0 FROM _b),
_q AS (SELECT *, o - pb - f0 - x0 AS rec, greatest(8, pb) AS base, greatest(8, pb) - pb AS ex FROM _p), _t AS (SELECT *, least(ex, f0 - 5) AS t1 FROM _q), _u AS (SELECT *, least(ex - t1, x0) AS t2, f0 - t1 AS f1 FROM _t),
_v AS (SELECT *, x0 - t2 AS x1, least(o - t, f1 - 5) AS c1 FROM _u), _w AS (SELECT *, least(o - t - c1, x1) AS c2 FROM _v),
_z AS (SELECT *, CASE WHEN t < 1 OR o < t THEN 'invalid-budget' WHEN rec < 1 OR ex - t1 - t2 > 0 THEN 'window-too-short' WHEN o - t - c1 - c2 > 0 THEN 'protected-phases' END AS reason FROM _w)"""


@query(with_views("v_elements", select="+ " + _PHASES + "\n=\nSELECT scene_id, seq, CASE WHEN reason IS NULL THEN rec END AS recognition, CASE WHEN reason IS NULL THEN base END AS base_color, CASE WHEN reason IS NULL THEN x1 - c2 END AS texture, CASE WHEN reason IS NULL THEN f1 - c1 END AS finalize, reason FROM _z"))
def phase_frames(spark, sf):
    return C.compile_budget(budgets(spark, sf), 30).select("scene_id", "seq", "phases.*")


@query(with_views("v_elements", select="+ " + _PHASES + "\n=\nSELECT scene_id, seq, t AS total_frames, o AS original_frames, reason IS NULL AS feasible_30 FROM _z"))
def compile_budget(spark, sf):
    return C.compile_budget(budgets(spark, sf), 30).selectExpr("scene_id", "seq", "total_frames", "original_frames", "phases.reason is null as feasible_30")


def phases_sql(rows: str, rate: str = "fps") -> str:
    """CTEs from `rows` (…, t, o, fps) up to _ok, which has them with `fits`."""
    return f"""_k0 AS ({rows}), _k1 AS (SELECT *, greatest(2, {_R.format(f'{rate} * 180 / 1000.0::DOUBLE')}) AS rel, CASE WHEN o < 8 THEN 1 ELSE greatest(3, {_R.format('o * 0.2::DOUBLE')}) END AS pb, {_R.format('o * 0.15::DOUBLE')} AS tx FROM _k0),
_k2 AS (SELECT *, greatest(rel, {_R.format('o * 0.04::DOUBLE')}) AS fin, greatest(8, pb) - pb AS more FROM _k1), _k3 AS (SELECT *, least(more, fin - rel) AS a1 FROM _k2), _k4 AS (SELECT *, least(more - a1, tx) AS a2 FROM _k3),
_ok AS (SELECT *, t >= 1 AND o >= t AND o - pb - fin - tx >= 1 AND more - a1 - a2 = 0 AND o - t <= (fin - a1 - rel) + (tx - a2) AS fits FROM _k4)"""


_EVERY_RATE = f"SELECT e.*, r.fps, {_span('start_ms', 'dur_ms', 'r.fps')} AS t, {_span('start_ms', 'original_ms', 'r.fps')} AS o FROM {{}} e, (SELECT unnest(range(8, 61)) AS fps) r"


@query(with_views("v_elements", select="+ _e0 AS (SELECT scene_id, seq, start_ms, dur_ms AS original_ms, dur_ms - seq % 4 * 120 AS dur_ms FROM v_elements), " + phases_sql(_EVERY_RATE.format("_e0")) + """
=
SELECT scene_id, seq, bool_and(fits) AS feasible FROM _ok GROUP BY scene_id, seq"""))
def feasible_all_fps(spark, sf):
    return C.feasible_all_fps(budgets(spark, sf)).select("scene_id", "seq", "feasible")


@query(with_views("v_elements", select="+ " + _PHASES + """
=
SELECT scene_id, e.seq, element_id || '-' || e.seq AS element_id, CASE WHEN e.seq % 2 = 0 AND scene_id % 11 <> 0 AND e.seq % 6 <> 0 AND e.seq % 4 <> 0 AND reason IS NULL THEN dur_ms - e.seq % 4 * 120 ELSE dur_ms END AS dur_ms,
CASE WHEN e.seq % 2 = 1 THEN NULL WHEN scene_id % 11 = 0 THEN 'duplicate-target' WHEN e.seq % 6 = 0 THEN 'stale-base' WHEN e.seq % 4 = 0 THEN 'invalid-duration' WHEN reason IS NOT NULL THEN 'infeasible-budget' END AS rule_id FROM v_elements e JOIN _z USING (scene_id, seq)"""))
def effective_reveal(spark, sf):
    elements = v_elements(spark, sf).withColumn("element_id", F.expr("element_id || '-' || seq"))
    reservations = elements.where("seq % 2 = 0").selectExpr("scene_id", "element_id", "if(seq % 6 = 0, dur_ms + 1, dur_ms) as original_ms", "dur_ms - seq % 4 * 120 as revised_ms")
    reservations = reservations.union(reservations.where("scene_id % 11 = 0"))
    return C.effective_reveal(elements.withColumn("reserved_from_ms", F.lit(None).cast("bigint")), reservations, 30).select("scene_id", "seq", "element_id", "dur_ms", "rule_id")


@query(with_views("v_elements", select="""+ _e AS (SELECT scene_id * 100 + seq AS event_id, start_ms AS s, start_ms + dur_ms AS e, ['contour-indicate', 'focus-push', 'gesture-arc'][seq % 3 + 1] AS fx, seq % 2 = 0 AS path FROM v_elements),
_r AS (SELECT *, least(e, s + 100) AS pe, greatest(0, e - least(e, s + 100)) AS rest FROM _e),
_a AS (SELECT *, CASE WHEN fx = 'contour-indicate' THEN 250 ELSE 400 END AS hold, fx = 'contour-indicate' OR (fx = 'focus-push' AND NOT path) AS held FROM _r),
_h AS (SELECT *, least(e, pe + least(650, greatest(400, rest - hold - 80))) AS ae FROM _a WHERE held), _h2 AS (SELECT *, least(e, greatest(ae + hold, e - 80)) AS ls FROM _h),
_f AS (SELECT *, least(e, pe + least(650, greatest(200, rest - 880))) AS de FROM _a WHERE fx = 'focus-push' AND path), _f2 AS (SELECT *, least(e, de + least(550, greatest(400, e - de - 480))) AS ce FROM _f),
_g AS (SELECT *, s + 100 AS ds, greatest(s + 101, e - 330) AS de FROM _a WHERE fx = 'gesture-arc')
=
SELECT event_id, unnest(['prepare', CASE WHEN hold = 250 THEN 'accent' ELSE 'camera' END, 'hold', 'leave']) AS phase, unnest([s, pe, ae, ls])::BIGINT AS start_ms, unnest([pe, ae, ls, e])::BIGINT AS end_ms FROM _h2
UNION ALL SELECT event_id, unnest(['prepare', 'draw', 'camera', 'hold', 'leave']), unnest([s, pe, de, ce, least(e, ce + 400)])::BIGINT, unnest([pe, de, ce, greatest(ce, least(e, ce + 400)), e])::BIGINT FROM _f2
UNION ALL SELECT event_id, unnest(['prepare', 'draw', 'hold', 'leave']), unnest([s, ds, de, greatest(de, e - 80)])::BIGINT, unnest([ds, de, greatest(de, e - 80), e])::BIGINT FROM _g"""))
def plan_phases(spark, sf):
    return C.plan_phases(v_elements(spark, sf).selectExpr("scene_id * 100 + seq as event_id", "start_ms", "dur_ms as budget_ms", "element_at(array('contour-indicate', 'focus-push', 'gesture-arc'), cast(seq % 3 + 1 as int)) as effect", "seq % 2 = 0 as has_path"))


@query(with_views("v_elements", select="""+ _c AS (SELECT scene_id, seq, least(greatest(round_even((x - 100) * 1.3::DOUBLE, 0)::BIGINT, 0), 1919) AS x, least(greatest(round_even((y - 50) * 1.7::DOUBLE, 0)::BIGINT, 0), 1079) AS y, w, h FROM v_elements)
=
SELECT scene_id, seq, x, y, least(greatest(1, w), greatest(1, 1920 - x)) AS w, least(greatest(1, h), greatest(1, 1080 - y)) AS h FROM _c"""))
def clamp_geometry(spark, sf):
    return C.clamp_geometry(v_elements(spark, sf).selectExpr("scene_id", "seq", "(x - 100) * 1.3D as x", "(y - 50) * 1.7D as y", "w", "h"))


@query(with_views("v_elements", select="""+ _t AS (SELECT scene_id, seq, greatest(0, least(1919, round_even(x * 0.85::DOUBLE + 30, 0)::BIGINT)) AS x0, greatest(0, least(1079, round_even(y * 0.85::DOUBLE - 20, 0)::BIGINT)) AS y0, round_even((x + w) * 0.85::DOUBLE + 30, 0)::BIGINT AS x1, round_even((y + h) * 0.85::DOUBLE - 20, 0)::BIGINT AS y1 FROM v_elements)
=
SELECT scene_id, seq, x0 AS x, y0 AS y, greatest(x0 + 1, least(1920, x1)) - x0 AS w, greatest(y0 + 1, least(1080, y1)) - y0 AS h FROM _t"""))
def transform_region(spark, sf):
    return C.transform_region(v_elements(spark, sf).select("scene_id", "seq", "x", "y", "w", "h"), F.lit(0.85), F.lit(30), F.lit(-20))


@query(with_views("v_cues", select="SELECT project_id, cue_no, greatest(0, least(max(end_ms) OVER (PARTITION BY project_id) + 2000 - 1, start_ms + 3000)) AS at_ms FROM v_cues"))
def time_shift(spark, sf):
    cues = v_cues(spark, sf)
    offsets = cues.groupBy("project_id").agg((F.max("end_ms") + 2000).alias("duration_ms")).withColumn("prefix_ms", F.lit(3000))
    return C.time_shift(cues.selectExpr("project_id", "cue_no", "start_ms as at_ms"), offsets)


@query(with_views("v_words", select="""+ _l AS (SELECT project_id, idx, start_ms, end_ms, list_filter(string_split(text, ''), lambda c: regexp_matches(c, '[\\p{L}\\p{N}_]')) AS l FROM v_words),
_s AS (SELECT *, len(l) AS n, greatest(start_ms + len(l), end_ms) - start_ms AS span FROM _l WHERE len(l) > 0), _c AS (SELECT project_id, idx, start_ms, n, span, unnest(range(n)) AS pos, unnest(l) AS ch FROM _s)
=
SELECT project_id, idx, pos::INT AS pos, lower(ch) AS char, round_even(start_ms + span * pos / n::DOUBLE, 0)::BIGINT AS start_ms, greatest(round_even(start_ms + span * pos / n::DOUBLE, 0)::BIGINT + 1, round_even(start_ms + span * (pos + 1) / n::DOUBLE, 0)::BIGINT) AS end_ms FROM _c WHERE project_id % 4 = 0 OR TRUE""".replace("_l AS", "_ls AS", 1).replace("FROM _l WHERE", "FROM _ls WHERE").replace(" WHERE project_id % 4 = 0 OR TRUE", "")))
def char_timing(spark, sf):
    return C.char_timing(v_words(spark, sf))


@query(with_views("v_cues", recursive=True, select="""+ _n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY cue_no) AS i FROM v_cues),
_f AS (SELECT project_id, i, cue_no, start_ms AS a, end_ms AS b, cue_no AS f, 1 AS g, end_ms - start_ms >= 30000 AS closed FROM _n WHERE i = 1
UNION ALL SELECT n.project_id, n.i, n.cue_no, CASE WHEN _f.closed OR n.end_ms - _f.a > 35000 THEN n.start_ms ELSE _f.a END, n.end_ms, CASE WHEN _f.closed OR n.end_ms - _f.a > 35000 THEN n.cue_no ELSE _f.f END, CASE WHEN _f.closed OR n.end_ms - _f.a > 35000 THEN _f.g + 1 ELSE _f.g END,
n.end_ms - CASE WHEN _f.closed OR n.end_ms - _f.a > 35000 THEN n.start_ms ELSE _f.a END >= 30000 FROM _f JOIN _n n ON n.project_id = _f.project_id AND n.i = _f.i + 1)
=
SELECT project_id, g AS scene_no, min(a) AS start_ms, max(b) AS end_ms, min(f) AS first_cue, max(cue_no) AS last_cue FROM _f GROUP BY project_id, g"""))
def group_scenes(spark, sf):
    return D.group_scenes(v_cues(spark, sf))


_CLEAN = f"trim(translate({{}}, '{CAPTION_PUNCTUATION}', ''))"


@query(with_views("v_words", recursive=True, select="""+ _f AS (SELECT project_id, idx, start_ms AS a, end_ms AS b, text AS t, 1 AS g FROM v_words WHERE idx = 0
UNION ALL SELECT w.project_id, w.idx, CASE WHEN c THEN w.start_ms ELSE w.a END, w.end_ms, CASE WHEN c THEN w.text ELSE w.t || w.text END, CASE WHEN c THEN w.g + 1 ELSE w.g END FROM (
SELECT n.*, _f.a, _f.t, _f.g, length(""" + _CLEAN.format("_f.t || n.text") + """) > 18 OR n.end_ms - _f.a > 3600 OR n.start_ms - _f.b > 420 AS c FROM _f JOIN v_words n ON n.project_id = _f.project_id AND n.idx = _f.idx + 1) w),
_l AS2 (SELECT project_id, g, min(a) AS start_ms, max(b) AS end_ms, """.replace("_l AS2", "_p AS") + _CLEAN.format("max_by(t, idx)") + """ AS text FROM _f GROUP BY project_id, g)
=
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY g)::INT AS cue_no, start_ms, end_ms, text FROM _p WHERE text <> ''"""))
def pack_words(spark, sf):
    return D.pack_words(v_words(spark, sf))


@query("""WITH r AS (SELECT doc_id AS project_id, regexp_extract_all(text, '([^。！？!?；;\\n，,、：:]*[。！？!?；;\\n，,、：:]|[^。！？!?；;\\n，,、：:]+$)') AS l FROM documents), u AS (SELECT project_id, unnest(range(len(l))) AS i, unnest(l) AS raw FROM r),
n AS (SELECT *, length(regexp_replace(raw, '[^\\p{L}\\p{N}_]', '', 'g')) AS n FROM u), s AS (SELECT *, sum(n) OVER (PARTITION BY project_id ORDER BY i)::BIGINT AS end_idx FROM n)
SELECT project_id, (row_number() OVER w - 1)::INT AS atom_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text, end_idx - n AS start_idx, end_idx, contains('。！？!?；;' || chr(10), right(raw, 1)) OR lead(i) OVER w IS NULL AS major FROM s WHERE n > 0 WINDOW w AS (PARTITION BY project_id ORDER BY i)""")
def clause_atoms(spark, sf):
    return D.clause_atoms(table(spark, sf, "documents").select(F.col("doc_id").alias("project_id"), "text"))


@query("""WITH RECURSIVE n AS (SELECT user_id AS project_id, event_id * 7 % 20000 AS at_ms, event_id::VARCHAR AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7 % 20000, event_id::VARCHAR) AS i FROM events),
f AS (SELECT project_id, at_ms, label, i, at_ms AS last, TRUE AS kept FROM n WHERE i = 1 UNION ALL SELECT n.project_id, n.at_ms, n.label, n.i, CASE WHEN n.at_ms - f.last >= 135 THEN n.at_ms ELSE f.last END, n.at_ms - f.last >= 135 FROM f JOIN n ON n.project_id = f.project_id AND n.i = f.i + 1)
SELECT project_id, at_ms, label FROM f WHERE kept""")
def suppress_near(spark, sf):
    return D.suppress_near(table(spark, sf, "events").selectExpr("user_id as project_id", "event_id * 7 % 20000 as at_ms", "cast(event_id as string) as label"), 135)


@query(with_views("v_motion", recursive=True, select="""+ _d AS (SELECT video_id, max(time_ms) + 250 AS duration_ms FROM v_motion GROUP BY video_id),
_k AS (SELECT video_id, time_ms FROM v_motion QUALIFY score >= 8 AND score >= lag(score) OVER (PARTITION BY video_id ORDER BY time_ms) AND score >= lead(score) OVER (PARTITION BY video_id ORDER BY time_ms)),
_n AS (SELECT k.video_id, time_ms, row_number() OVER (PARTITION BY k.video_id ORDER BY time_ms) AS i FROM _k k JOIN _d USING (video_id) WHERE duration_ms - time_ms >= 1500),
_f AS (SELECT video_id, 0::BIGINT AS t, 0 AS i, 0::BIGINT AS last, TRUE AS kept FROM _d UNION ALL SELECT n.video_id, n.time_ms, n.i, CASE WHEN n.time_ms - _f.last >= 1500 THEN n.time_ms ELSE _f.last END, n.time_ms - _f.last >= 1500 FROM _f JOIN _n n ON n.video_id = _f.video_id AND n.i = _f.i + 1)
=
SELECT f.video_id, row_number() OVER w::INT AS scene_no, t AS start_ms, coalesce(lead(t) OVER w, duration_ms) AS end_ms FROM _f f JOIN _d USING (video_id) WHERE kept WINDOW w AS (PARTITION BY f.video_id ORDER BY t)""".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT")))
def detect_cuts(spark, sf):
    motion = v_motion(spark, sf)
    durations = motion.groupBy("video_id").agg((F.max("time_ms") + 250).alias("duration_ms"))
    peaks = local_peaks(motion, motion.select("video_id").distinct().withColumn("threshold", F.lit(8.0)))
    return D.detect_cuts(peaks.select("video_id", "time_ms"), durations, 1500)


@query(with_views("v_frames", select="""+ _s AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w OR frame = 0 THEN 1 ELSE 0 END AS n, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM v_frames WINDOW w AS (PARTITION BY key ORDER BY frame)), _r AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY frame)::BIGINT AS run FROM _s)
=
SELECT key, run, any_value(state) AS state, min(frame) AS start, max(frame) AS "end", round(coalesce(sum(d) FILTER (n = 0), 0), 4) AS length FROM _r GROUP BY key, run"""))
def state_runs(spark, sf):
    return D.state_runs(v_frames(spark, sf)).withColumn("length", F.round("length", 4))


_RULES = [("before-after", ["the ", "de la"]), ("timeline", ["and ", "der "]), ("causal-chain", ["tion"])]


_HITS = "list_filter([CASE WHEN contains(text, 'the ') OR contains(text, 'de la') THEN 'before-after' END, CASE WHEN contains(text, 'and ') OR contains(text, 'der ') THEN 'timeline' END, CASE WHEN contains(text, 'tion') THEN 'causal-chain' END], lambda x: x IS NOT NULL)"
_NAMES = ", ".join(f"'{c}'" for c in COMPOSITIONS)
# Scenes of drafts: every fifth has a composition, every seventh an id.
_DRAFT = f"""_h AS (SELECT project_id, cue_no AS seq, row_number() OVER (PARTITION BY project_id ORDER BY cue_no) - 1 AS i, {_HITS} AS hits, [{_NAMES}] AS fb, CASE WHEN cue_no % 5 = 3 THEN [{_NAMES}][cue_no % 6 + 1] END AS given FROM v_cues),
_o AS (SELECT *, hits || fb[(i % 6 + 1):6] || fb[1:(i % 6)] AS o FROM _h),
_f AS (SELECT project_id, seq, i, coalesce(given, o[1]) AS c, given IS NULL AS s FROM _o WHERE i = 0 UNION ALL SELECT n.project_id, n.seq, n.i, coalesce(n.given, CASE WHEN n.o[1] <> _f.c THEN n.o[1] WHEN n.o[2] <> _f.c THEN n.o[2] ELSE n.o[3] END), n.given IS NULL FROM _f JOIN _o n ON n.project_id = _f.project_id AND n.i = _f.i + 1)"""
_PLACED = """_sc AS (SELECT project_id, seq, c, s, seq % 7 <> 1 AS new, CASE WHEN seq % 7 = 1 THEN 's' || seq ELSE 'scene-' || CASE WHEN i < 9 THEN '0' ELSE '' END || (i + 1) END AS scene_id FROM _f),
_el AS (SELECT w.project_id, line_no AS seq, row_number() OVER (PARTITION BY w.project_id, line_no ORDER BY idx) AS no, idx, text FROM v_words w),
_e AS (SELECT e.*, scene_id, idx % 4 = 0 AS new, CASE WHEN idx % 3 = 0 THEN CASE WHEN idx % 2 = 0 THEN 'triggerText' WHEN idx % 5 <> 0 THEN 'narrationEvidence' END END AS alias FROM _el e JOIN _sc USING (project_id, seq))"""
_ELEMENT_ID = "CASE WHEN new THEN scene_id || '-e' || CASE WHEN no < 10 THEN '0' ELSE '' END || no ELSE 'w' || idx END"


def draft(spark, sf):
    cues = v_cues(spark, sf)
    name = F.element_at(F.array(*map(F.lit, COMPOSITIONS)), F.expr("int(cue_no % 6 + 1)"))
    scenes = cues.select("project_id", F.col("cue_no").alias("seq"), "text", F.when(F.col("cue_no") % 5 == 3, name).otherwise(F.when(F.col("cue_no") % 2 == 0, F.lit(" "))).alias("composition"), F.expr("if(cue_no % 7 = 1, concat(' s', cue_no, ' '), if(cue_no % 2 = 0, '', null))").alias("scene_id"))
    no = F.row_number().over(Window.partitionBy("project_id", "line_no").orderBy("idx"))
    elements = v_words(spark, sf).select("project_id", F.col("line_no").alias("seq"), no.alias("element_no"), F.expr("if(idx % 4 = 0, ' ', concat('w', idx))").alias("element_id"), F.expr("if(idx % 3 = 0, if(idx % 2 = 0, null, ' '), text)").alias("trigger_text"), F.expr("if(idx % 2 = 0, concat(text, ' '), ' ')").alias("triggerText"), F.expr("if(idx % 5 = 0, null, concat(text, '!'))").alias("narrationEvidence"))
    return scenes, elements


@query(with_views("v_cues", recursive=True, select=f"+ {_DRAFT}\n=\nSELECT project_id, seq, c AS composition, s AS suggested FROM _f"))
def suggest_composition(spark, sf):
    return D.suggest_composition(draft(spark, sf)[0], _RULES, list(COMPOSITIONS))


@query(with_views("v_words", "v_cues", recursive=True, select=f"""+ {_DRAFT}, {_PLACED}
=
SELECT project_id, seq, no AS element_no, scene_id, {_ELEMENT_ID} AS element_id, CASE WHEN alias = 'triggerText' THEN text WHEN alias IS NOT NULL THEN text || '!' WHEN idx % 3 = 0 THEN ' ' ELSE text END AS trigger_text FROM _e"""))
def draft_elements(spark, sf):
    elements = D.compile_draft(*draft(spark, sf), _RULES, list(COMPOSITIONS))[1]
    return elements.select("project_id", "seq", "element_no", "scene_id", "element_id", "trigger_text")


@query(with_views("v_words", "v_cues", recursive=True, select=f"""+ {_DRAFT}, {_PLACED}
=
SELECT project_id, seq, NULL::BIGINT AS element_no, 'generated-scene-id' AS change, scene_id AS value FROM _sc WHERE new UNION ALL SELECT project_id, seq, NULL, 'selected-composition', c FROM _sc WHERE s
UNION ALL SELECT project_id, seq, no, 'generated-element-id', {_ELEMENT_ID} FROM _e WHERE new UNION ALL SELECT project_id, seq, no, 'trigger-text-from', alias FROM _e WHERE alias IS NOT NULL"""))
def draft_changes(spark, sf):
    return D.compile_draft(*draft(spark, sf), _RULES, list(COMPOSITIONS))[2]
