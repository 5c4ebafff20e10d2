"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.operators import joins as J
from cuespan.plans.fixtures import table, v_art_new, v_art_old, v_cues, v_elements, v_scenes, v_words, with_views, words_and_scenes
from cuespan.plans.registry import query


@query(with_views("v_words", "v_scenes", select="SELECT w.project_id, scene_id, seq, idx, text, w.start_ms, w.end_ms FROM v_words w JOIN v_scenes s ON s.project_id = w.project_id AND w.start_ms < s.end_ms AND w.end_ms > s.start_ms"))
def scene_words(spark, sf):
    return J.scene_words(*words_and_scenes(spark, sf))


@query(with_views("v_words", "v_scenes", select="SELECT w.project_id, scene_id, idx FROM v_words w JOIN v_scenes s ON s.project_id = w.project_id AND w.start_ms >= s.start_ms AND w.end_ms <= s.end_ms"))
def scene_words_contain(spark, sf):
    return J.scene_words(*words_and_scenes(spark, sf), "contain").select("project_id", "scene_id", "idx")


@query(with_views("v_words", "v_scenes", select="""+ _n AS (SELECT w.project_id, w.idx, count(s.scene_id) AS n, min(s.seq) AS least, max(s.seq) AS most FROM v_words w LEFT JOIN v_scenes s ON s.project_id = w.project_id AND w.start_ms < s.end_ms AND w.end_ms > s.start_ms GROUP BY ALL),
_c AS (SELECT project_id, idx, least, max(most) OVER (PARTITION BY project_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM _n)
=
SELECT project_id, idx, CASE WHEN n = 0 THEN 'missing' ELSE 'duplicate' END AS rule_id FROM _n WHERE n <> 1 UNION ALL SELECT project_id, idx, 'crossing' FROM _c WHERE least < reach"""))
def word_coverage(spark, sf):
    return J.word_coverage(*words_and_scenes(spark, sf), in_order=True)


@query(with_views("v_cues", "v_scenes", select="+ _h AS (SELECT p.project_id, p.start_ms AS at_ms, min(cue_no) AS cue_no FROM v_scenes p JOIN v_cues c ON c.project_id = p.project_id AND p.start_ms BETWEEN c.start_ms AND c.end_ms GROUP BY ALL)\n=\nSELECT p.project_id, p.scene_id, p.start_ms AS at_ms, h.cue_no, md5(c.text) AS text FROM v_scenes p LEFT JOIN _h h ON h.project_id = p.project_id AND h.at_ms = p.start_ms LEFT JOIN v_cues c ON c.project_id = h.project_id AND c.cue_no = h.cue_no"))
def caption_at(spark, sf):
    points = v_scenes(spark, sf).selectExpr("project_id", "scene_id", "start_ms as at_ms")
    return J.caption_at(points, v_cues(spark, sf)).withColumn("text", F.md5(F.col("text").cast("binary")))


@query(with_views("v_cues", "v_scenes", select="SELECT c.project_id, c.cue_no, c.start_ms AS at_ms, s.scene_id FROM v_cues c LEFT JOIN v_scenes s ON s.project_id = c.project_id AND c.start_ms >= s.start_ms AND c.start_ms < s.end_ms"))
def scene_at(spark, sf):
    return J.scene_at(v_cues(spark, sf).selectExpr("project_id", "cue_no", "start_ms as at_ms"), v_scenes(spark, sf))


_TOKEN = "replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g')), 'ß', 'ss')"


@query(with_views("v_words", select=f"""+ _k AS (SELECT project_id || '-' || line_no AS scene_key, idx, text, start_ms, end_ms, {_TOKEN} AS tok, row_number() OVER (PARTITION BY project_id, line_no ORDER BY idx) - 1 AS i FROM v_words),
_o AS (SELECT *, coalesce(sum(length(tok)) OVER (PARTITION BY scene_key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM _k),
_s AS (SELECT scene_key, string_agg(tok, '' ORDER BY idx) AS whole, min(start_ms) AS s0, max(end_ms) AS e0, string_agg(text, ' ' ORDER BY idx) FILTER (i IN (1, 2)) AS phrase FROM _o GROUP BY scene_key),
_n AS (SELECT *, {_TOKEN.replace('text', 'phrase')} AS needle FROM _s WHERE phrase IS NOT NULL), _f AS (SELECT *, instr(whole, needle) AS at FROM _n),
_u AS (SELECT *, needle <> '' AND at > 0 AND instr(substr(whole, at + 1), needle) = 0 AS one FROM _f)
=
SELECT u.scene_key, a.i::INT AS word_start, z.i::INT AS word_end, coalesce(a.start_ms, s0) AS start_ms, coalesce(z.end_ms, e0) AS end_ms, CASE WHEN one THEN 'exact-trigger-text' ELSE 'unresolved-semantic-trigger' END AS mapping
FROM _u u LEFT JOIN _o a ON one AND a.scene_key = u.scene_key AND a.b < at AND at <= a.b + length(a.tok) LEFT JOIN _o z ON one AND z.scene_key = u.scene_key AND z.b < at + length(needle) - 1 AND at + length(needle) - 1 <= z.b + length(z.tok)""".replace(" at ", " pos ").replace(" AS at FROM", " AS pos FROM").replace("at + ", "pos + ").replace("AND at ", "AND pos ").replace("< at", "< pos")))
def match_trigger(spark, sf):
    words = v_words(spark, sf)
    first = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda w: w["text"])
    phrases = words.groupBy("project_id", "line_no").agg(first.alias("w")).where("size(w) > 1").select("project_id", "line_no", F.array_join(F.slice("w", 2, 2), " ").alias("phrase"))
    found = J.match_trigger(phrases, words, scene=("project_id", "line_no"))
    return found.select(F.concat_ws("-", "project_id", "line_no").alias("scene_key"), "word_start", "word_end", "start_ms", "end_ms", "mapping")


@query(with_views("v_elements", select="""+ _b AS (SELECT scene_id, seq AS beat_no, CASE seq % 3 WHEN 0 THEN element_id WHEN 1 THEN (seq + 1)::VARCHAR ELSE 'L' || x END AS target FROM v_elements)
=
SELECT e.scene_id, e.seq, min(b.beat_no) AS beat_no FROM v_elements e LEFT JOIN _b b ON b.scene_id = e.scene_id AND (b.target = e.element_id OR b.target = 'L' || e.x OR b.target = e.seq::VARCHAR) GROUP BY e.scene_id, e.seq"""))
def match_any_key(spark, sf):
    elements = v_elements(spark, sf).withColumn("label", F.expr("concat('L', x)"))
    beats = elements.selectExpr("scene_id", "seq as beat_no", "case seq % 3 when 0 then element_id when 1 then cast(seq + 1 as string) else label end as target")
    return J.match_any_key(elements, beats, ["element_id", "label", "seq"]).select("scene_id", "seq", "beat_no")


@query(with_views("v_elements", select="""+ _c AS (SELECT scene_id, seq AS cue_no, CASE WHEN seq % 2 = 0 THEN element_id ELSE substr(element_id, 2) END AS target FROM v_elements),
_k AS (SELECT DISTINCT scene_id, seq, start_ms + dur_ms AS e, unnest([element_id, 'l' || x]) AS k FROM v_elements),
_x AS (SELECT c.scene_id, c.cue_no, k.seq, k.e FROM _c c JOIN _k k ON k.scene_id = c.scene_id AND k.k = c.target),
_p AS (SELECT c.scene_id, c.cue_no, k.seq, k.e FROM _c c JOIN _k k ON k.scene_id = c.scene_id AND (contains(k.k, c.target) OR contains(c.target, k.k)) WHERE length(c.target) >= 2 AND NOT EXISTS (SELECT 1 FROM _x WHERE _x.scene_id = c.scene_id AND _x.cue_no = c.cue_no)),
_h AS (SELECT scene_id, cue_no, min(e) AS e FROM (SELECT DISTINCT * FROM (SELECT * FROM _x UNION ALL SELECT * FROM _p)) GROUP BY ALL HAVING count(*) = 1)
=
SELECT c.scene_id, c.cue_no, h.e AS reveal_end_ms FROM _c c LEFT JOIN _h h USING (scene_id, cue_no)"""))
def reveal_end_for_target(spark, sf):
    elements = v_elements(spark, sf).withColumn("label", F.expr("concat('L', x)"))
    cues = elements.selectExpr("scene_id", "seq as cue_no", "if(seq % 2 = 0, element_id, substr(element_id, 2)) as target")
    return J.reveal_end_for_target(cues, elements, ["element_id", "label"]).select("scene_id", "cue_no", "reveal_end_ms")


@query("""SELECT c_custkey, coalesce(n.id, '0') AS id FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN c_nationkey::VARCHAR WHEN 2 THEN 'nation ' || c_nationkey ELSE (SELECT any_value(n_name) FROM nation WHERE n_nationkey = c_nationkey) END AS v FROM customer) c
LEFT JOIN (SELECT n_nationkey::VARCHAR AS id, unnest([n_nationkey::VARCHAR, lower(n_name), 'nation ' || n_nationkey]) AS a FROM nation) n ON n.a = lower(v)""")
def resolve_alias(spark, sf):
    nation = table(spark, sf, "nation")
    registry = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.expr("concat('Nation ', n_nationkey)")).alias("aliases"))
    rows = table(spark, sf, "customer").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    rows = rows.selectExpr("c_custkey", "case c_custkey % 4 when 0 then 'unknown' when 1 then cast(c_nationkey as string) when 2 then concat(' NATION ', c_nationkey) else n_name end as v")
    return J.resolve_alias(rows, registry, "v", "0").select("c_custkey", "id")


@query("SELECT 'no-child' AS side, o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10) UNION ALL SELECT DISTINCT 'no-parent', l_orderkey FROM lineitem WHERE l_quantity > 10 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def missing_children(spark, sf):
    return J.missing_children(table(spark, sf, "orders").selectExpr("o_orderkey as k"), table(spark, sf, "lineitem").where("l_quantity > 10").selectExpr("l_orderkey as k"), "k")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS part FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)")
def declared_refs(spark, sf):
    return J.declared_refs(table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey as part"), table(spark, sf, "part").where("p_partkey % 7 <> 0").selectExpr("p_partkey as part"), "part").select("l_orderkey", "l_linenumber", "part")


@query(with_views("v_art_old", "v_art_new", select="""+ _d AS (SELECT replace(coalesce(o.path, n.path), '.txt', '')::BIGINT // 100 AS grp, coalesce(o.path, n.path) AS path, o.path AS op, n.path AS np, o.sha256 <> n.sha256 OR o.bytes <> n.bytes AS ch FROM v_art_old o FULL JOIN v_art_new n ON o.path = n.path)
=
SELECT grp, coalesce(string_agg(path, ',' ORDER BY path) FILTER (op IS NULL), '') AS added, coalesce(string_agg(path, ',' ORDER BY path) FILTER (np IS NULL), '') AS removed, coalesce(string_agg(path, ',' ORDER BY path) FILTER (ch), '') AS changed, count(op) AS before_count, count(np) AS after_count
FROM _d GROUP BY grp HAVING count(*) FILTER (op IS NULL OR np IS NULL OR ch) > 0"""))
def keyed_diff(spark, sf):
    old, new = (f(spark, sf).withColumn("grp", F.expr("cast(replace(path, '.txt', '') as bigint) div 100")) for f in (v_art_old, v_art_new))
    return J.keyed_diff(old, new, "grp", "path").withColumns({c: F.array_join(c, ",") for c in ("added", "removed", "changed")})


@query(with_views("v_art_old", "v_art_new", select="SELECT coalesce(o.path, n.path) AS scene_id FROM v_art_old o FULL JOIN v_art_new n ON o.path = n.path WHERE o.sha256 IS DISTINCT FROM n.sha256"))
def plan_diff(spark, sf):
    return J.plan_diff(*(f(spark, sf).selectExpr("path as scene_id", "sha256 as payload") for f in (v_art_old, v_art_new)))


@query(with_views("v_art_old", "v_art_new", select="""+ _d AS (SELECT coalesce(o.path, n.path) AS path, o.path AS op, n.path AS np, o.sha256 <> n.sha256 AS s, o.bytes <> n.bytes AS b FROM v_art_old o FULL JOIN v_art_new n ON o.path = n.path)
=
SELECT path, 'missing' AS problem FROM _d WHERE op IS NULL UNION ALL SELECT path, 'stale' FROM _d WHERE np IS NULL UNION ALL SELECT path, 'different' FROM _d WHERE s UNION ALL SELECT path, 'different-bytes' FROM _d WHERE b"""))
def manifest_diff(spark, sf):
    return J.manifest_diff(v_art_old(spark, sf), v_art_new(spark, sf))


@query(with_views("v_art_old", "v_art_new", select="SELECT o.path FROM v_art_old o LEFT JOIN v_art_new n ON o.path = n.path WHERE o.sha256 IS DISTINCT FROM n.sha256"))
def stale_artifacts(spark, sf):
    return J.stale_artifacts(v_art_old(spark, sf), v_art_new(spark, sf))


_OVERLAP = """_o AS (SELECT a.scene_id, a.seq AS a, b.seq AS b, (greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))::BIGINT AS area, a.w * a.h + b.w * b.h AS both_area FROM v_elements a JOIN v_elements b ON a.scene_id = b.scene_id AND a.seq < b.seq)"""


@query(with_views("v_elements", select="+ " + _OVERLAP + "\n=\nSELECT scene_id, a, b, area, round(area / (both_area - area)::DOUBLE, 6) AS iou FROM _o WHERE area > 0"))
def region_overlap(spark, sf):
    return J.region_overlap(v_elements(spark, sf))


@query(with_views("v_elements", select="+ " + _OVERLAP + """, _r AS (SELECT * FROM v_elements WHERE seq % 5 <> 0), _e AS (SELECT scene_id, CASE WHEN seq % 7 = 0 THEN 'z' || seq ELSE element_id END AS element_id FROM v_elements)
=
SELECT scene_id, 'no-region' AS rule_id, element_id AS key FROM (SELECT scene_id, element_id FROM _e EXCEPT ALL SELECT scene_id, element_id FROM _r)
UNION ALL SELECT scene_id, 'no-element', element_id FROM (SELECT scene_id, element_id FROM _r EXCEPT ALL SELECT scene_id, element_id FROM _e)
UNION ALL SELECT scene_id, 'repeated-id', element_id FROM _r GROUP BY scene_id, element_id HAVING count(*) > 1
UNION ALL SELECT scene_id, 'overlap', a || '-' || b FROM _o WHERE area > 0 AND a % 5 <> 0 AND b % 5 <> 0
UNION ALL SELECT scene_id, 'reserved-box', element_id FROM _r WHERE x < 400 AND x + w > 0 AND y < 100 AND y + h > 0"""))
def allocation_check(spark, sf):
    elements = v_elements(spark, sf)
    named = elements.selectExpr("scene_id", "if(seq % 7 = 0, concat('z', seq), element_id) as element_id")
    reserved = elements.select("scene_id").distinct().selectExpr("scene_id", "0 as x", "0 as y", "400 as w", "100 as h")
    return J.allocation_check(elements.where("seq % 5 <> 0"), named, reserved)


@query("""WITH c AS (SELECT p_partkey AS id, 300 + p_partkey * 37 % 1700 AS width, 300 + p_partkey * 91 % 1500 AS height FROM part), p(i, w, h) AS (VALUES (0, 1920, 1080), (1, 1080, 1920), (2, 1440, 1080), (3, 1080, 1440), (4, 1080, 1080)),
d AS (SELECT id, width, height, w, h, abs(width / height::DOUBLE - w / h::DOUBLE) / (w / h::DOUBLE) AS d, row_number() OVER (PARTITION BY id ORDER BY abs(width / height::DOUBLE - w / h::DOUBLE) / (w / h::DOUBLE), i) AS r FROM c, p)
SELECT id, CASE WHEN d <= 0.10::DOUBLE AND greatest(width, height) >= 400 THEN w ELSE width END AS w, CASE WHEN d <= 0.10::DOUBLE AND greatest(width, height) >= 400 THEN h ELSE height END AS h FROM d WHERE r = 1""")
def nearest_profile(spark, sf):
    return J.nearest_profile(table(spark, sf, "part").selectExpr("p_partkey as id", "300 + p_partkey * 37 % 1700 as width", "300 + p_partkey * 91 % 1500 as height"))


@query("WITH u AS (SELECT l_partkey AS asset, l_suppkey % 9 AS used_by FROM lineitem) SELECT asset, CASE WHEN asset % 6 = 0 THEN 'missing' ELSE 'available' END AS status, string_agg(DISTINCT used_by::VARCHAR, ',' ORDER BY used_by::VARCHAR) AS used_by FROM u GROUP BY asset")
def asset_usage(spark, sf):
    uses = table(spark, sf, "lineitem").selectExpr("l_partkey as asset", "cast(l_suppkey % 9 as string) as used_by")
    return J.asset_usage(uses, table(spark, sf, "part").where("p_partkey % 6 <> 0").selectExpr("p_partkey as asset")).withColumn("used_by", F.array_join("used_by", ","))


@query("""WITH s AS (SELECT doc_id AS scene_id, 'b' || doc_id AS stem, CASE WHEN doc_id % 3 = 0 THEN 'own' || doc_id END AS link FROM documents), f AS (SELECT 'b' || doc_id || '.png' AS path, 'b' || doc_id AS stem, 1 AS r FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'b' || doc_id || '.jpg', 'b' || doc_id, 2 FROM documents WHERE doc_id % 5 <> 1),
m AS (SELECT stem, min_by(path, r) AS path FROM f GROUP BY stem)
SELECT scene_id, coalesce(link, path) AS link, link IS NULL AND path IS NOT NULL AS recovered FROM s LEFT JOIN m USING (stem)""")
def recover_links(spark, sf):
    docs = table(spark, sf, "documents")
    files = docs.where("doc_id % 2 = 0").selectExpr("concat('b', doc_id, '.png') as path").union(docs.where("doc_id % 5 <> 1").selectExpr("concat('b', doc_id, '.jpg')"))
    return J.recover_links(docs.selectExpr("doc_id as scene_id", "concat('b', doc_id) as stem", "if(doc_id % 3 = 0, concat('own', doc_id), null) as link"), files, ["png", "jpg", "jpeg", "webp"])


_CHANGES = """_c AS (SELECT doc_id // 4 AS set_id, CASE WHEN doc_id % 37 = 0 THEN '../x' ELSE doc_id || '.txt' END AS path, CASE WHEN doc_id % 29 = 0 THEN 'old' ELSE sha256(text) END AS before_sha256, 'new ' || doc_id AS after_content FROM documents),
_b AS (SELECT set_id, bool_or(path = '../x') AS bad, bool_or(before_sha256 IS DISTINCT FROM sha256) AS stale FROM _c LEFT JOIN v_art_old USING (path) GROUP BY set_id)"""


@query(with_views("v_art_old", select="+ " + _CHANGES + "\n=\nSELECT o.path, CASE WHEN b.bad OR b.stale OR b.set_id IS NULL THEN o.sha256 ELSE sha256(c.after_content) END AS sha256 FROM v_art_old o LEFT JOIN _c c USING (path) LEFT JOIN _b b USING (set_id)"))
def apply_changes(spark, sf):
    return J.apply_changes(v_art_old(spark, sf).select("path", "sha256"), changes(spark, sf), r"^\d+\.txt$")[0]


@query(with_views("v_art_old", select="+ " + _CHANGES + "\n=\nSELECT c.set_id, c.path, 'conflict' AS outcome FROM _c c JOIN _b b USING (set_id) WHERE stale AND NOT bad UNION ALL SELECT c.set_id, c.path, 'unknown-path' FROM _c c JOIN _b b USING (set_id) WHERE bad"))
def apply_changes_refused(spark, sf):
    _, conflicts, rejects = J.apply_changes(v_art_old(spark, sf).select("path", "sha256"), changes(spark, sf), r"^\d+\.txt$")
    return conflicts.select("set_id", "path", F.lit("conflict").alias("outcome")).union(rejects)


def changes(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id div 4 as set_id", "if(doc_id % 37 = 0, '../x', concat(doc_id, '.txt')) as path", "if(doc_id % 29 = 0, 'old', sha2(text, 256)) as before_sha256", "concat('new ', doc_id) as after_content")


@query(with_views("v_art_old", "v_art_new", select="SELECT n.path AS id, CASE WHEN n.bytes % 2 = 0 THEN 'ledger' ELSE 'state' END AS path FROM v_art_new n JOIN v_art_old o ON o.path = n.path AND o.sha256 = n.sha256"))
def cache_lookup(spark, sf):
    old = v_art_old(spark, sf)
    candidates = old.where("bytes % 2 = 0").selectExpr("path as id", "cast(bytes as string) as key", "sha256", "0 as priority", "'ledger' as path").union(old.selectExpr("path", "cast(bytes as string)", "sha256", "1", "'state'"))
    hits, _ = J.cache_lookup(v_art_new(spark, sf).selectExpr("path as id", "cast(bytes as string) as key", "sha256"), candidates)
    return hits.select("id", "path")
