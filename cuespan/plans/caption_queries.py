"""Queries of captions made from scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.operators import captions as C
from cuespan.plans.fixtures import v_asr, v_cues, v_docs, with_views
from cuespan.plans.registry import query

_LETTER = "regexp_matches({}, '[\\p{{L}}\\p{{N}}_]')"
#: Letters of scripts and of recognised words, and the runs in which they agree.
_ALIGN = f"""_sc AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY i) - 1 AS pos, c AS text, lower(c) AS key FROM (
  SELECT doc_id AS project_id, unnest(range(len(l))) AS i, unnest(l) AS c FROM (SELECT doc_id, string_split(text, '') AS l FROM documents)) WHERE {_LETTER.format("c")}),
_rw AS (SELECT project_id, idx, start_ms, end_ms, list_filter(string_split(text, ''), lambda c: {_LETTER.format("c")}) AS l FROM v_asr),
_rn AS (SELECT *, len(l) AS n, greatest(start_ms + len(l), end_ms) - start_ms AS span FROM _rw WHERE len(l) > 0),
_rx AS (SELECT project_id, idx, start_ms, n, span, unnest(range(n)) AS p, lower(unnest(l)) AS key FROM _rn),
_re AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY idx, p) - 1 AS pos, key, round_even(start_ms + span * p / n, 0)::BIGINT AS start_ms,
  greatest(round_even(start_ms + span * p / n, 0)::BIGINT + 1, round_even(start_ms + span * (p + 1) / n, 0)::BIGINT) AS end_ms FROM _rx),
_gs AS (SELECT project_id, g, min(pos) AS i FROM (SELECT project_id, pos, string_agg(key, '') OVER w AS g, count(*) OVER w AS n FROM _sc WINDOW w AS (PARTITION BY project_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) WHERE n = 12 GROUP BY ALL HAVING count(*) = 1),
_gr AS (SELECT project_id, g, min(pos) AS j FROM (SELECT project_id, pos, string_agg(key, '') OVER w AS g, count(*) OVER w AS n FROM _re WINDOW w AS (PARTITION BY project_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) WHERE n = 12 GROUP BY ALL HAVING count(*) = 1),
_an AS (SELECT project_id, i, j - i AS d FROM _gs JOIN _gr USING (project_id, g)),
_ar AS (SELECT project_id, d, i - row_number() OVER (PARTITION BY project_id, d ORDER BY i) AS run, i FROM _an),
_ru AS (SELECT project_id, d, min(i) AS i0, max(i) AS i1 FROM _ar GROUP BY project_id, d, run),
_rm AS (SELECT *, median(d) OVER (PARTITION BY project_id ORDER BY i0 ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM _ru),
_rk AS (SELECT *, max(i1 + d) OVER (PARTITION BY project_id ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef, min(i0 + d) OVER (PARTITION BY project_id ORDER BY i0 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS beh FROM _rm WHERE abs(d - near) <= 40),
_ro AS (SELECT project_id, i0, i1 + 11 AS e, d FROM _rk WHERE coalesce(i0 + d > bef, TRUE) AND coalesce(i1 + d < beh, TRUE)),
_mj AS (SELECT s.project_id, s.pos, s.text, s.key, CASE WHEN s.pos <= o.e THEN s.pos + o.d END AS j FROM _sc s ASOF LEFT JOIN _ro o ON o.project_id = s.project_id AND o.i0 <= s.pos),
_mt AS (SELECT m.*, r.start_ms AS s, r.end_ms AS e, b.a0, b.b0, b.n AS most, count(m.j) OVER (PARTITION BY m.project_id ORDER BY m.pos) AS run,
  max(m.j) OVER (PARTITION BY m.project_id ORDER BY m.pos) AS lj, min(m.j) OVER (PARTITION BY m.project_id ORDER BY m.pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rj
  FROM _mj m JOIN (SELECT project_id, min(start_ms) AS a0, max(end_ms) AS b0, max(pos) + 1 AS n FROM _re GROUP BY project_id) b ON b.project_id = m.project_id LEFT JOIN _re r ON r.project_id = m.project_id AND r.pos = m.j),
_mo AS (SELECT *, count(*) OVER (PARTITION BY project_id, run, j IS NULL) AS n, row_number() OVER (PARTITION BY project_id, run, j IS NULL ORDER BY pos) - 1 AS k FROM _mt),
_mg AS (SELECT o.*, CASE WHEN coalesce(rj, most) - coalesce(lj, -1) > 1 THEN coalesce(x.start_ms, a0) ELSE coalesce(l.end_ms, a0) END AS a,
  CASE WHEN coalesce(rj, most) - coalesce(lj, -1) > 1 THEN coalesce(y.end_ms, b0) ELSE coalesce(r.start_ms, b0) END AS b FROM _mo o
  LEFT JOIN _re l ON l.project_id = o.project_id AND l.pos = lj LEFT JOIN _re x ON x.project_id = o.project_id AND x.pos = lj + 1 LEFT JOIN _re r ON r.project_id = o.project_id AND r.pos = rj LEFT JOIN _re y ON y.project_id = o.project_id AND y.pos = rj - 1),
_mf AS (SELECT project_id, pos, text, key, coalesce(s, round_even(a + greatest(n, b - a) * k / n, 0)::BIGINT) AS s, coalesce(e, greatest(round_even(a + greatest(n, b - a) * k / n, 0)::BIGINT + 1, round_even(a + greatest(n, b - a) * (k + 1) / n, 0)::BIGINT)) AS e FROM _mg),
_mz AS (SELECT *, pos + 1 + greatest(0, max(greatest(s + 1, e) - pos - 1) OVER (PARTITION BY project_id ORDER BY pos)) AS z FROM _mf),
_al AS (SELECT project_id, pos, text, key, greatest(coalesce(lag(z) OVER (PARTITION BY project_id ORDER BY pos), 0), s) AS start_ms, z AS end_ms FROM _mz)"""

_ATOMS = """_ax AS (SELECT doc_id AS project_id, regexp_extract_all(text, '([^。！？!?；;\\n，,、：:]*[。！？!?；;\\n，,、：:]|[^。！？!?；;\\n，,、：:]+$)') AS l FROM documents),
_ay AS (SELECT *, length(regexp_replace(raw, '[^\\p{L}\\p{N}_]', '', 'g')) AS n FROM (SELECT project_id, unnest(range(len(l))) AS i, unnest(l) AS raw FROM _ax)),
_az AS (SELECT *, sum(n) OVER (PARTITION BY project_id ORDER BY i)::BIGINT AS end_idx FROM _ay),
_at AS (SELECT project_id, (row_number() OVER w - 1)::INT AS atom_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text, end_idx - n AS start_idx, end_idx, contains('。！？!?；;' || chr(10), right(raw, 1)) OR lead(i) OVER w IS NULL AS major FROM _az WHERE n > 0 WINDOW w AS (PARTITION BY project_id ORDER BY i))"""

#: Pieces: from each start the best end, one after another.
_SPLIT = """_fx AS (SELECT a.*, s.start_ms AS s0, e.end_ms AS e0 FROM _at a JOIN _al s ON s.project_id = a.project_id AND s.pos = a.start_idx JOIN _al e ON e.project_id = a.project_id AND e.pos = a.end_idx - 1),
_fl AS (SELECT * FROM _fx WHERE NOT (end_idx - start_idx <= 18 AND e0 - s0 <= 3600)),
_fk AS (SELECT f.project_id, f.atom_no, f.start_idx, f.end_idx, list(l.start_ms ORDER BY l.pos) AS ss, list(l.end_ms ORDER BY l.pos) AS es, string_agg(l.key, '' ORDER BY l.pos) AS plain FROM _fl f JOIN _al l ON l.project_id = f.project_id AND l.pos >= f.start_idx AND l.pos < f.end_idx GROUP BY ALL),
_fr AS (SELECT project_id, atom_no, 0 AS piece_no, 0::BIGINT AS a, (SELECT 0::BIGINT) AS b FROM _fk
UNION ALL SELECT project_id, atom_no, piece_no + 1, a, CASE WHEN far >= n THEN n ELSE list_max(list_transform(range(least(far, a + 6), far + 1), lambda b: {'gain': 3 * (ss[b + 1] - es[b]) + (CASE WHEN len(list_filter(['但是', '不过', '所以', '因此', '同时', '而且', '然后', '另外', '其实', '也可能', '或者', '再加上', '想停'], lambda w: starts_with(plain[b + 1:], w))) > 0 THEN 900 ELSE 0 END) - 12 * (far - b), 'at': b})).at END
FROM (SELECT r.project_id, r.atom_no, r.piece_no, r.b AS a, k.ss, k.es, k.plain, len(k.ss)::BIGINT AS n, list_max(list_filter(range(r.b + 1, least(len(k.ss), r.b + 18) + 1), lambda f: f = r.b + 1 OR k.es[f] - k.ss[r.b + 1] <= 3600)) AS far FROM _fr r JOIN _fk k ON k.project_id = r.project_id AND k.atom_no = r.atom_no WHERE r.b < len(k.ss))),
_fv AS (SELECT project_id, atom_no, list_filter(range(1, length(text) + 1), lambda i: regexp_matches(text[i], '[\\p{L}\\p{N}_]')) AS v FROM _fl),
_pc AS (SELECT project_id, atom_no, 0 AS piece_no, text, start_idx, end_idx, major FROM _fx WHERE end_idx - start_idx <= 18 AND e0 - s0 <= 3600
UNION ALL SELECT f.project_id, f.atom_no, r.piece_no - 1, regexp_replace(f.text[(CASE WHEN r.a = 0 THEN 1 ELSE v.v[r.a + 1] END):(CASE WHEN r.b >= f.end_idx - f.start_idx THEN length(f.text) ELSE v.v[r.b] END)], '^\\s+|\\s+$', '', 'g'), f.start_idx + r.a, f.start_idx + r.b, f.major AND r.b = f.end_idx - f.start_idx
FROM _fr r JOIN _fl f USING (project_id, atom_no) JOIN _fv v USING (project_id, atom_no) WHERE r.piece_no > 0)"""

_PACK = """_pk AS (SELECT p.*, s.start_ms, e.end_ms, length(regexp_replace(p.text, '[^\\p{L}\\p{N}_]', '', 'g')) AS n, regexp_matches(p.text, '[：:]\\s*$') AS colon,
  coalesce(sum(major::INT) OVER (PARTITION BY p.project_id ORDER BY p.start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence, row_number() OVER (PARTITION BY p.project_id ORDER BY p.start_idx) AS i
  FROM _pc p JOIN _al s ON s.project_id = p.project_id AND s.pos = p.start_idx JOIN _al e ON e.project_id = p.project_id AND e.pos = p.end_idx - 1),
_pr AS (SELECT project_id, i, sentence, i AS g, start_idx AS gs, start_ms AS ga, end_idx AS ge, colon FROM _pk WHERE i = 1
UNION ALL SELECT k.project_id, k.i, k.sentence, CASE WHEN t THEN g ELSE k.i END, CASE WHEN t THEN gs ELSE k.start_idx END, CASE WHEN t THEN ga ELSE k.start_ms END, k.end_idx, k.colon
FROM (SELECT k.*, r.g, r.gs, r.ga, k.sentence = r.sentence AND (r.ge - r.gs < 5 OR k.end_idx - k.start_idx < 4) AND NOT r.colon AND k.end_idx - r.gs <= 18 AND k.end_ms - r.ga <= 3600 AS t FROM _pr r JOIN _pk k ON k.project_id = r.project_id AND k.i = r.i + 1) k),
_pg AS (SELECT k.project_id, r.g, min(k.start_ms) AS start_ms, max(k.end_ms) AS end_ms, string_agg(k.text, '' ORDER BY k.i) AS text FROM _pk k JOIN _pr r ON r.project_id = k.project_id AND r.i = k.i GROUP BY ALL)"""


def letters(spark, sf):
    return C.align_texts(scripts(spark, sf), v_asr(spark, sf))


def scripts(spark, sf):
    # Dealt as the words are, so that a project's script and cues lie in one task.
    return v_docs(spark, sf).selectExpr("doc_id as project_id", "text")


@query(with_views("v_asr", select=f"+ {_ALIGN}\n=\nSELECT project_id, pos, text, start_ms, end_ms FROM _al"))
def align_script(spark, sf):
    return letters(spark, sf).drop("key")


@query(with_views("v_asr", recursive=True, select=f"+ {_ALIGN}, {_ATOMS}, {_SPLIT}\n=\nSELECT project_id, atom_no, piece_no, text, start_idx, end_idx, major FROM _pc"))
def split_long_atoms(spark, sf):
    return C.script_pieces(scripts(spark, sf), v_asr(spark, sf)).drop("start_ms", "end_ms")


@query(with_views("v_asr", recursive=True, select=f"+ {_ALIGN}, {_ATOMS}, {_SPLIT}, {_PACK}\n=\n" + "SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY g) AS cue_no, start_ms, end_ms, trim(regexp_replace(trim(translate(text, '，。！？；：、,.!?;:《》“”‘’（）()【】[]—…', '')), '[ \\t]+', ' ', 'g')) AS text FROM _pg"))
def build_cues(spark, sf):
    return C.build_cues(scripts(spark, sf), v_asr(spark, sf))


_SPACES = """_bo AS (SELECT DISTINCT project_id, spot FROM (SELECT project_id, sum(length(regexp_replace(p, '[^\\p{L}\\p{N}_]', '', 'g'))) OVER (PARTITION BY project_id ORDER BY i) AS spot, lead(i) OVER (PARTITION BY project_id ORDER BY i) AS more FROM (
  SELECT doc_id AS project_id, unnest(range(len(l))) AS i, unnest(l) AS p FROM (SELECT doc_id, regexp_split_to_array(text, '[^\\P{P}_]') AS l FROM documents))) WHERE more IS NOT NULL AND spot > 0),
_bs AS (SELECT project_id, cue_no, string_split_regex(text, '\\s') AS l, coalesce(sum(length(regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g'))) OVER (PARTITION BY project_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM v_cues),
_bp AS (SELECT project_id, cue_no, s, unnest(range(len(l))) AS i, unnest(l) AS p FROM _bs),
_bn AS (SELECT *, s + sum(length(regexp_replace(p, '[^\\p{L}\\p{N}_]', '', 'g'))) OVER w AS spot, lead(p) OVER w AS nx FROM _bp WINDOW w AS (PARTITION BY project_id, cue_no ORDER BY i)),
_bv AS (SELECT project_id, cue_no, spot::BIGINT AS spot FROM _bn b WHERE nx IS NOT NULL AND NOT (regexp_matches(p, '[A-Za-z0-9]$') AND regexp_matches(nx, '^[A-Za-z0-9]')) AND NOT EXISTS (SELECT 1 FROM _bo o WHERE o.project_id = b.project_id AND o.spot = b.spot))"""


@query(with_views("v_cues", select=f"""+ {_SPACES}
=
SELECT project_id, cue_no, spot AS "at", 'blank-without-punctuation' AS rule_id FROM _bv"""))
def caption_space_check(spark, sf):
    return C.caption_space_check(v_cues(spark, sf), scripts(spark, sf))


_CUE = "CASE WHEN (project_id + cue_no) % 37 = 0 THEN text || ' 的' WHEN (project_id + cue_no) % 41 = 0 THEN '和 ' || text WHEN (project_id + cue_no) % 43 = 0 THEN text || chr(10) ELSE text END"


@query(with_views("v_cues", select=f"""+ _k AS (SELECT project_id, cue_no, {_CUE} AS text FROM v_cues), {_SPACES.replace("FROM v_cues", "FROM _k")},
_w AS (SELECT project_id, cue_no, text, trim(replace(text, chr(10), '')) AS c, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS n FROM _k)
=
SELECT doc_id AS project_id, NULL::BIGINT AS cue_no, 'text-differs' AS rule_id, 'error' AS severity FROM documents d JOIN (SELECT project_id, string_agg(replace(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), 'ß', 'ss'), '' ORDER BY cue_no) AS s FROM _k GROUP BY project_id) ON project_id = doc_id WHERE replace(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), 'ß', 'ss') <> s
UNION ALL SELECT project_id, cue_no, 'several-lines', 'error' FROM _w WHERE contains(text, chr(10)) UNION ALL SELECT project_id, cue_no, 'punctuation', 'error' FROM _w WHERE regexp_matches(text, '\\p{{P}}')
UNION ALL SELECT project_id, cue_no, 'ends-in-particle', 'warning' FROM _w WHERE right(c, 1) = '的' UNION ALL SELECT project_id, cue_no, 'starts-with-particle', 'warning' FROM _w WHERE left(c, 1) = '和'
UNION ALL SELECT project_id, cue_no, 'too-many-letters', 'warning' FROM _w WHERE n > 18 UNION ALL SELECT DISTINCT project_id, cue_no, 'blank-without-punctuation', 'error' FROM _bv"""))
def caption_contract(spark, sf):
    cues = v_cues(spark, sf).withColumn("text", F.expr(_CUE.replace("chr(10)", "char(10)")))
    return C.caption_contract(cues, scripts(spark, sf))
