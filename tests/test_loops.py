"""Window and fold forms against plain loops on random rows; golden cases written by hand; streams against batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cuespan.functions import text as T
from cuespan.operators import aggs, boards, captions, folds, picks, rules, tables, windows
from cuespan.sources import readers
from cuespan.streaming import streams


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_monotone_clamp_is_the_loop(spark):
    rng = random.Random(1)
    data = [(k, i, rng.randint(-50, 400), rng.randint(-50, 500)) for k in range(6) for i in range(rng.randint(1, 30))]
    want = []
    for k in range(6):
        end = 0
        for _, i, s, e in [r for r in data if r[0] == k]:
            s = max(end, s)
            end = max(s + 1, e)
            want.append((k, i, s, end))
    df = spark.createDataFrame(data, "project_id int, cue_no int, start_ms bigint, end_ms bigint")
    assert rows(windows.monotone_clamp(df, ["project_id"], ["cue_no"]), "project_id", "cue_no", "start_ms", "end_ms") == sorted(want)


def test_suppress_near_is_the_loop(spark):
    rng = random.Random(2)
    data = sorted({(rng.randint(0, 3), rng.randint(0, 900), str(rng.randint(0, 9))) for _ in range(200)})
    want, last = [], {}
    for k, t, label in data:
        if k not in last or t - last[k] >= 35:
            last[k] = t
            want.append((k, t, label))
    df = spark.createDataFrame(data, "project_id int, at_ms bigint, label string")
    assert rows(folds.suppress_near(df), "project_id", "at_ms", "label") == want


@pytest.mark.parametrize("limits", [(18, 3600), (7, 900)])
def test_pack_words_is_the_loop(spark, limits):
    rng, data, t = random.Random(3), [], 0
    for i in range(120):
        t += rng.choice([0, 20, 420, 421, 600])
        data.append((1, i, rng.choice(["ab", "c,", "def.", "。", "g"]), t, t + 150))
        t += 150
    clean = lambda s: s.translate(str.maketrans("", "", T.CAPTION_PUNCTUATION)).strip()
    want, cur = [], []
    for w in data:
        if cur and (len(clean("".join(x[2] for x in cur) + w[2])) > limits[0] or w[4] - cur[0][3] > limits[1] or w[3] - cur[-1][4] > 420):
            want.append((cur[0][3], cur[-1][4], clean("".join(x[2] for x in cur))))
            cur = []
        cur.append(w)
    want.append((cur[0][3], cur[-1][4], clean("".join(x[2] for x in cur))))
    df = spark.createDataFrame(data, "project_id int, idx int, text string, start_ms bigint, end_ms bigint")
    got = rows(folds.pack_words(df, *limits), "start_ms", "end_ms", "text")
    assert got == [w for w in want if w[2]]


def test_folds_of_long_keys(spark):
    """A key is cut where its state resets, so its length is no matter."""
    df = spark.range(20000).selectExpr("1 as project_id", "id * 20 + id div 5 * 100 as at_ms", "'' as label")
    want, last = 0, None
    for i in range(20000):
        at = i * 20 + i // 5 * 100
        if last is None or at - last >= 35:
            want, last = want + 1, at
    assert folds.suppress_near(df).count() == want


def test_pacing_of_two_elements(spark):
    elements = spark.createDataFrame([(1, 1, 100, 1200), (1, 2, 5000, 1200)], "scene_id int, seq int, start_ms bigint, dur_ms bigint")
    scenes = spark.createDataFrame([(1, 10000)], "scene_id int, duration_ms bigint")
    assert rows(windows.adaptive_pacing(elements, scenes), "seq", "new_start_ms", "new_dur_ms") == [(1, 100, 4508), (2, 5000, 4500)]


def test_even_sample_of_few_rows(spark):
    df = spark.range(3).selectExpr("1 as k", "id")
    assert rows(picks.even_sample(df, 5, ["k"], ["id"]), "id") == [(0,), (1,), (2,)]
    assert rows(picks.even_sample(spark.range(10).selectExpr("1 as k", "id"), 4, ["k"], ["id"]), "id") == [(0,), (3,), (6,), (9,)]


def test_markdown(spark):
    source = "---\ntitle: x\n---\n# Head\n\nOne *two* [three](http://x)\n\n\n> quote\n- item `code`\n```\nhidden\n```\n![img](y)\nlast"
    df = spark.createDataFrame([(source,)], "t string").select(T.markdown_to_narration("t").alias("t"))
    assert df.first().t == "One two three\n\nquote\nitem code\n\nlast"


def test_time_parsing(spark):
    df = spark.createDataFrame([("00:00:01,500",), ("1:02.5",), ("x",), (None,)], "t string").select(T.parse_time_ms("t").alias("t"))
    assert [r.t for r in df.collect()] == [1500, 62500, None, None]


def test_srt_modes(spark):
    value = "﻿1\r\n00:00:00,000 --> 00:00:01,000\r\nHi\r\nyou\r\n\r\n\r\n2\r\n00:00:00,500 --> 00:00:02,000\r\nover\r\n\r\nnoise\r\n\r\n3\r\n00:00:03,000 --> 00:00:02,000\r\n"
    files = spark.createDataFrame([("a", value.replace("\r\n", "\n").lstrip("﻿"))], "path string, value string")
    assert rows(readers.parse_srt(files), "cue_no", "start_ms", "end_ms", "text") == [(1, 0, 1000, "Hi you"), (2, 500, 2000, "over"), (3, 3000, 2000, "")]
    assert rows(readers.parse_srt(files, "compose"), "cue_no", "text") == [(1, "Hi you"), (2, "over")]
    assert rows(readers.parse_srt(files, "strict").na.fill(""), "cue_no", "text", "rule_id") == [(1, "Hi\nyou", ""), (2, "over", "overlap"), (3, "", "empty-text")]


def test_files_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1, 0, 900, "a b"), (1, 2, 1000, 1500, "c"), (2, 1, 5, 6, "d")], "project_id int, cue_no int, start_ms bigint, end_ms bigint, text string")
    readers.write_captions(readers.render_srt(cues), str(tmp_path / "srt"))
    back = readers.read_srt(spark, str(tmp_path / "srt/*/*.txt"))
    assert rows(back, "start_ms", "end_ms", "text") == [(0, 900, "a b"), (5, 6, "d"), (1000, 1500, "c")]
    (tmp_path / "c.json").write_text('{"events": [{"tStartMs": 10, "dDurationMs": 0, "segs": [{"utf8": "a &amp; b"}, {"utf8": "\\n c"}]}, {"tStartMs": 20}]}')
    assert rows(readers.read_json3_captions(spark, str(tmp_path / "c.json")), "start_ms", "end_ms", "text") == [(10, 11, "a & b c")]
    (tmp_path / "w.json").write_text('{"project_id": "p", "words": [{"id": "w1", "text": "hi", "start_ms": 1, "end_ms": 2}]}')
    assert rows(readers.read_words(spark, str(tmp_path / "w.json")), "project_id", "idx", "word_id", "text", "start_ms") == [("p", 0, "w1", "hi", 1)]
    readers.write_snapshot(cues, str(tmp_path / "snap"), "project_id", 4)
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 3
    assert readers.file_inventory(spark, str(tmp_path / "c.json")).first().bytes == (tmp_path / "c.json").stat().st_size


def test_board_runs(spark):
    px = bytearray([250] * (20 * 10 * 3))
    for x in range(8, 12):
        px[(5 * 20 + x) * 3 : (5 * 20 + x) * 3 + 3] = b"\0\0\0"
    df = spark.createDataFrame([("b", 20, 10, 3, bytes(px))], "board_id string, width int, height int, channels int, data binary")
    runs, corners = readers.board_runs(df)
    assert rows(runs, "board_id", "y", "x0", "x1") == [("b", 5, 8, 12)]
    assert corners.count() == 64


def stream(spark, tmp_path, df, name):
    df.write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def run_to_memory(out, name, mode):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.table(name)


def test_stream_cues_equal_batch(spark, tmp_path):
    data = [(1, t, i, f"w{i}", 100) for i, t in enumerate([0, 200, 720, 1241, 5000])]
    df = spark.createDataFrame(data, "project_id int, ms bigint, idx int, text string, dur_ms bigint").select("project_id", F.timestamp_millis("ms").alias("ts"), "idx", "text", "dur_ms")
    batch = rows(streams.stream_cues(df, watermark=None), "start_ms", "end_ms", "n_words", "text")
    assert batch == [(0, 820, 3, "w0 w1 w2"), (1241, 1341, 1, "w3"), (5000, 5100, 1, "w4")]
    live = run_to_memory(streams.stream_cues(stream(spark, tmp_path, df, "cues")), "cues_out", "complete")
    assert rows(live, "start_ms", "end_ms", "n_words", "text") == batch


def test_stream_downsample_equals_batch(spark, tmp_path):
    hour = 3_600_000
    rng = random.Random(2)
    data = [(v, hour + t, rng.randint(0, 99)) for v, n in ((1, 1200), (2, 5_000_000)) for t in sorted(rng.randrange(n) for _ in range(60))] + [(1, hour - 5, 1), (1, hour + 1200, 1)]
    ms = lambda df, c: df.withColumn(c, F.timestamp_millis(c))
    frames = ms(spark.createDataFrame(data, "video_id bigint, ts bigint, score bigint"), "ts")
    videos = ms(spark.createDataFrame([(1, hour, 1200), (2, hour, 5_000_000)], "video_id bigint, start bigint, duration_ms bigint"), "start")
    assert [r[0] for r in videos.select(streams.sample_interval_ms("duration_ms")).collect()] == [250, 1050]
    want = rows(streams.downsample(frames, videos), "video_id", "slot_ms", "score")
    first = {}
    for v, t, x in data:
        if 0 <= t - hour < {1: 1200, 2: 5_000_000}[v]:
            key = (v, (t - hour) // {1: 250, 2: 1050}[v] * {1: 250, 2: 1050}[v])
            first[key] = min(first.get(key, (t, x)), (t, x))
    assert want == sorted((*k, x) for k, (_, x) in first.items())
    path, end = str(tmp_path / "frames"), ms(spark.createDataFrame([(9, hour * 9, 0)], "video_id bigint, ts bigint, score bigint"), "ts")
    for part in (frames.where("unix_millis(ts) < 3700000"), frames.where("unix_millis(ts) >= 3700000"), end, end.withColumn("ts", F.timestamp_millis(F.lit(hour * 10)))):
        part.coalesce(1).write.mode("append").parquet(path)
        out = streams.stream_downsample(spark.readStream.schema(frames.schema).parquet(path), videos.union(ms(spark.createDataFrame([(9, hour, 10**9)], videos.schema.simpleString()[7:-1].replace("timestamp", "bigint")), "start")), watermark="2 minutes")
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).where("video_id < 9"), "video_id", "slot_ms", "score") == want


def test_stream_duplicates(spark, tmp_path):
    df = spark.createDataFrame([(1, t, t) for t in (0, 100, 249, 250, 600)], "video_id int, ms bigint, score bigint").select("video_id", F.timestamp_millis("ms").alias("ts"), "score")
    df = df.withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))  # at the epoch itself a row is late at once
    again = run_to_memory(streams.stream_dedupe(stream(spark, tmp_path, df.union(df), "twice"), ["video_id", "score"]), "twice_out", "append")
    assert again.count() == 5


def test_late_rows_are_counted(spark, tmp_path):
    late, path, minute = streams.LateRows(), str(tmp_path / "events"), 60_000
    spark.streams.addListener(late)
    schema = "video_id int, ts timestamp, score bigint"
    try:
        ids = set()
        for part in ([1000, 1001], [1030], [1000, 1001, 1002, 1029, 1025], [1100], [1050, 1051, 1099]):  # minutes; watermark 10 minutes
            spark.createDataFrame([(1, m * minute, m) for m in part], "video_id int, ms bigint, score bigint").select("video_id", F.timestamp_millis("ms").alias("ts"), "score").coalesce(1).write.mode("append").parquet(path)
            feed = streams.stream_dedupe(streams.observed(spark.readStream.schema(schema).parquet(path)), ["score"])
            q = feed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
            q.awaitTermination()
            ids.add(str(q.id))
        for _ in range(100):
            if sum(late.rows.values()) >= 12:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(late)
    assert len(ids) == 1 and late.rows[ids.copy().pop()] == 12 and late.late[ids.pop()] == 5
    assert sorted(r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1000, 1001, 1025, 1029, 1030, 1099, 1100]


LEDGER = "scene_id int, version int, state string"


def test_stream_ledger_survives_restart(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], LEDGER).write.parquet(src)
    read = lambda: spark.readStream.schema(LEDGER).parquet(src)
    streams.stream_ledger(read(), out, check).awaitTermination()
    spark.createDataFrame([(1, 2, "c"), (2, 0, "old"), (3, 1, "d")], LEDGER).write.mode("append").parquet(src)
    streams.stream_ledger(read(), out, check).awaitTermination()
    assert rows(streams.read_ledger(spark, out, LEDGER), "scene_id", "version", "state") == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_keyed_table_after_a_crash_and_compaction(spark, tmp_path, monkeypatch):
    table = streams.ledger_table(spark, str(tmp_path / "t"), LEDGER)
    table.buckets = 8
    batch = lambda *r: spark.createDataFrame(list(r), LEDGER)
    streams.put_results(table, batch(*[(i, 1, "a") for i in range(100)]), 0)
    before = rows(table.rows(), "scene_id", "version", "state")

    def crash(*_):
        raise RuntimeError

    # The data of batch 1 are written but not its list: nothing has happened, and the batch can run again.
    monkeypatch.setattr(type(spark), "createDataFrame", crash)
    with pytest.raises(RuntimeError):
        table.put(1, {3}, table.rows({b: v for b, v in table.places().items() if b == 3}).limit(0))
    monkeypatch.undo()
    assert rows(table.rows(), "scene_id", "version", "state") == before
    for v in range(1, 6):
        streams.put_results(table, batch((5, v, f"v{v}"), (200 + v, 1, "new")), v)
    want = sorted([r for r in before if r[0] != 5] + [(5, 5, "v5")] + [(200 + v, 1, "new") for v in range(1, 6)])
    assert rows(table.rows(), "scene_id", "version", "state") == want
    streams.put_results(table, batch((5, 5, "v5 again"), (205, 1, "new")), 5)  # batch 5 runs again
    assert rows(table.rows().where("scene_id = 5"), "version", "state") == [(5, "v5 again")]
    # Only buckets that someone still reads are there, not one set of files a batch.
    kept = [p for p in (tmp_path / "t" / "data").glob("v=*/bucket=*")]
    assert len(table.versions()) == 2 and len(kept) <= 2 * 8 + 2


def test_stream_hand_qa_equals_batch_over_batches(spark, tmp_path):
    rng = random.Random(5)
    states = ["draw", "travel", "hidden", "fast-draw"]
    data = [(k, i, rng.random() * 60, rng.random() * 60, rng.choice([0.0, 0.3, 0.9]), s, s != "hidden") for k in range(3) for i in range(60) for s in [rng.choice(states)]]
    df = spark.createDataFrame(data, "key long, frame long, x double, y double, opacity double, state string, visible boolean")
    want, sums = rows(windows.hand_motion_qa(df), "key", "frame", "kind", "value"), aggs.hand_motion_summary(df)
    names = ["key", "frames", "visible_frames", "max_step", "p95_step", "max_delta", "hold_then_jump", "single_frame_gap", "abrupt", "violations"]
    timed = df.withColumn("ts", F.timestamp_millis(3_600_000 + F.col("frame") * 1000))
    end = timed.where("key = 0 and frame = 0").withColumn("key", F.lit(99).cast("bigint"))
    path = str(tmp_path / "frames")
    parts = [timed.where("frame < 20"), timed.where("frame = 20"), timed.where("frame > 20 or frame = 15"), *[end.withColumn("ts", F.timestamp_millis(F.lit(3_600_000 * h))) for h in (2, 3)]]
    for part in parts:  # one file a batch; the third repeats a frame that is too late; the last ones only move the watermark on
        part.coalesce(1).write.mode("append").parquet(path)
        out = streams.stream_hand_qa(spark.readStream.schema(timed.schema).parquet(path))
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("key < 99")
    assert rows(got.where("kind <> 'summary'"), "key", "frame", "kind", "value") == want
    assert rows(got.where("kind = 'summary'"), *names) == rows(sums, *names) and {r.late for r in got.where("kind = 'summary'").collect()} == {1}
    # The state of keys that fell silent is gone.
    left = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "last").load()
    assert {r.key.key for r in left.select("key").collect()} <= {99}


def test_stream_changes(spark, tmp_path):
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    schema = "set_id int, path string, before_sha256 string, after_content string"
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    files = [("a.txt", sha("a")), ("b.txt", sha("b"))] + [(f"f{i}.txt", sha(str(i))) for i in range(500)]
    streams.first_snapshot(spark.createDataFrame(files, "path string, sha256 string"), out)
    feed = lambda: spark.readStream.schema(schema).parquet(src)
    for batch in ([(1, "a.txt", sha("a"), "a1"), (2, "b.txt", sha("x"), "b1")], [(3, "a.txt", sha("a1"), "a2"), (4, "evil.sh", sha("a"), "z")], [(5, "a.txt", sha("a1"), "late")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        streams.stream_changes(feed(), out, check, r"^[a-z]\.txt$").awaitTermination()
    assert rows(streams.read_changes(spark, out).where("length(path) = 5"), "path", "sha256") == [("a.txt", sha("a2")), ("b.txt", sha("b"))]
    assert streams.read_changes(spark, out).count() == 502
    assert rows(streams.read_changes(spark, out, "conflicts"), "set_id", "path") == [(2, "b.txt"), (5, "a.txt")]
    assert rows(streams.read_changes(spark, out, "rejects"), "set_id", "reason") == [(4, "unknown-path")]
    # A batch wrote the buckets of its own paths, not the snapshot.
    written = list((tmp_path / "out" / "snapshot" / "data").glob("v=[0-9]*/bucket=*"))
    assert 0 < len(written) <= 4


def test_late_rows_of_a_stream_are_left_out(spark, tmp_path):
    """Append mode: a window is given out once the watermark has passed, and what comes for it later is dropped."""
    path, hour = str(tmp_path / "late"), 3_600_000
    schema = "video_id int, ts timestamp, score bigint"
    for part in ([(1, 0, 5), (1, 10, 7)], [(1, 2 * hour, 1)], [(1, 20, 100), (1, 2 * hour + 5, 2)], [(1, 4 * hour, 0)], [(1, 6 * hour, 0)]):
        spark.createDataFrame(part, "video_id int, ms bigint, score bigint").select("video_id", F.timestamp_millis(F.col("ms") + 10 * hour).alias("ts"), "score").coalesce(1).write.mode("append").parquet(path)
        out = streams.stream_tumbling(spark.readStream.schema(schema).parquet(path), "1 hour", watermark="10 minutes")
        q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "res"))
        q.awaitTermination()
    got = {r.start_ms // hour - 10: (r.n, r.score) for r in spark.read.parquet(str(tmp_path / "res")).collect()}
    assert got[0] == (2, 12) and got[2] == (2, 3)


def test_concurrent_subjects_are_the_intervals(spark):
    rng = random.Random(8)
    data = [(s, rng.choice("abcd"), a, a + rng.randint(0, 12)) for s in range(4) for a in [rng.randint(0, 60) for _ in range(25)]]
    got = rows(windows.concurrent_subjects(spark.createDataFrame(data, "shot_id int, subject string, start_ms int, end_ms int")), "shot_id", "left_ms", "right_ms", "subjects")
    want = []
    for shot in range(4):
        own = [d for d in data if d[0] == shot]
        ends = sorted({t for d in own for t in d[2:]})
        for a, b in zip(ends, ends[1:]):
            n = len({d[1] for d in own if d[2] <= a and d[3] >= b})
            want += [(shot, a, b, n)] * (n > 2)
    assert got == want and want


def test_running_totals_of_one_large_key(spark):
    df = spark.range(20000).selectExpr("if(id < 15000, 1, id % 50) as p", "id", "id % 11 as v").repartition(16)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the key lies in several ranges
    try:
        got = {r.id: r.v for r in tables.running_totals(df, "p", ["id"], ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    sums = {}
    for i in range(20000):
        p = 1 if i < 15000 else i % 50
        sums[p] = sums.get(p, 0) + i % 11
        assert got[i] == sums[p]


def scene_loop(cues, target, least, most):
    """Cues (no, start, end) joined as a reader of captions would, one after another."""
    scenes, open_ = [], []
    for c in cues:
        if open_ and c[2] - open_[0][1] > most * 1000:
            scenes.append(open_)
            open_ = []
        open_ = [*open_[:1], c] if len(open_) > 1 else [*open_, c]
        span = open_[-1][2] - open_[0][1]
        if span >= target * 1000 and span >= least * 1000:
            scenes.append(open_)
            open_ = []
    scenes += [open_] if open_ else []
    return [(i, s[0][1], s[-1][2], s[0][0], s[-1][0]) for i, s in enumerate(scenes, 1)]


@pytest.mark.parametrize("limits", [(30, 25, 35), (10, 12, 12), (4, 1, 20)])
def test_group_scenes_is_the_loop(spark, limits):
    rng = random.Random(3)
    data = []
    for project in range(8):
        at = 0
        for i in range(rng.choice([1, 2, 60, 300])):
            length = rng.choice([0, 500, 3000, 9000, 50_000])
            data.append((project, 7 * i, at, at + length))
            at += rng.choice([0, length, length + 400, length + 70_000])
        if project == 5:  # ends that fall, as overlapping cues may have
            data += [(project, 7 * 400, 1000, 2000), (project, 7 * 401, 500, 90_000)]
    df = spark.createDataFrame(data, "project_id int, cue_no int, start_ms bigint, end_ms bigint")
    want = [(p, *s) for p in range(8) for s in scene_loop([r[1:] for r in data if r[0] == p], *limits)]
    assert rows(folds.group_scenes(df, *limits), "project_id", "scene_no", "start_ms", "end_ms", "first_cue", "last_cue") == sorted(want)
    assert folds.group_scenes(df.where("false")).count() == 0


def test_group_scenes_of_a_million_cues(spark):
    df = spark.range(1_000_000).selectExpr("1 as project_id", "id as cue_no", "id * 1700 + id % 13 * 50 as start_ms", "id * 1700 + id % 13 * 50 + 900 + id % 7 * 100 as end_ms")
    cues = [(i, i * 1700 + i % 13 * 50, i * 1700 + i % 13 * 50 + 900 + i % 7 * 100) for i in range(1_000_000)]
    assert rows(folds.group_scenes(df), "scene_no", "start_ms", "end_ms", "first_cue", "last_cue") == scene_loop(cues, 30, 25, 35)


def test_suggest_composition_is_the_loop(spark):
    rng = random.Random(4)
    rules, names = [("b", ["x"]), ("c", ["y", "z"])], ["a", "b", "c", "d"]
    data = [(p, i, "".join(rng.choice("xyzuvw") for _ in range(2)), rng.choice([None, None, " ", "a", "q"])) for p, n in ((1, 700), (2, 1), (3, 256), (4, 257)) for i in range(n)]
    want = []
    for p in (1, 2, 3, 4):
        before = ""
        for i, (_, seq, text, given) in enumerate(r for r in data if r[0] == p):
            suggested = not (given or "").strip()
            order = [n for n, terms in rules if any(t in text for t in terms)] + names[i % 4 :] + names[: i % 4]
            before = next(c for c in order if c != before) if suggested else given.strip()
            want.append((p, seq, before, suggested))
    df = spark.createDataFrame(data, "project_id int, seq int, text string, composition string")
    assert rows(folds.suggest_composition(df, rules, names), "project_id", "seq", "composition", "suggested") == sorted(want)


def test_compile_draft(spark):
    scenes = spark.createDataFrame([(1, 5, None, "x", None), (1, 6, " own ", "u", "kept")], "project_id int, seq int, scene_id string, text string, composition string")
    elements = spark.createDataFrame([(1, 5, 1, " ", "", " said ", "other"), (1, 5, 12, None, None, " ", " proof "), (1, 6, 1, "e", "t", "u", None)], "project_id int, seq int, element_no int, element_id string, trigger_text string, triggerText string, narrationEvidence string")
    a, b, changes = folds.compile_draft(scenes, elements, [("b", ["x"])], ["a", "b"])
    assert rows(a, "scene_id", "composition") == [("own", "kept"), ("scene-01", "b")]
    assert rows(b, "element_id", "trigger_text") == [("e", "t"), ("scene-01-e01", "said"), ("scene-01-e12", "proof")]
    assert rows(changes.na.fill(0), "seq", "element_no", "change", "value") == [(5, 0, "generated-scene-id", "scene-01"), (5, 0, "selected-composition", "b"), (5, 1, "generated-element-id", "scene-01-e01"), (5, 1, "trigger-text-from", "triggerText"), (5, 12, "generated-element-id", "scene-01-e12"), (5, 12, "trigger-text-from", "narrationEvidence")]


def test_box_components_are_the_fixpoint(spark):
    rng = random.Random(9)
    data = [(board, i, x, y, x + rng.choice([1, 5, 60, size]), y + rng.choice([1, 5, 60, size])) for board, n, size in ((1, 40, 9), (2, 90, 30), (3, 1, 5), (4, 60, 400)) for i in range(n) for x, y in [(rng.randrange(1900), rng.randrange(1000))]]
    data += [(5, i, 7 * i, 0, 7 * i + 5, 5) for i in range(200)]  # a chain, each two apart
    data += [(6, i, i % 20, i // 20, i % 20 + 1, i // 20 + 1) for i in range(400)]  # a heap
    data += [(7, 0, 0, 0, 10, 10), (7, 1, 90, 90, 100, 100), (7, 2, 11, 11, 95, 12), (7, 3, 50, 50, 51, 51)]  # joined only by a grown box
    want = []
    for board in range(1, 8):
        groups = {b[1]: (b[2:], [b[1]]) for b in data if b[0] == board}
        changed = True
        while changed:
            changed = False
            for a in sorted(groups):
                for b in sorted(groups):
                    if a < b and a in groups and b in groups:
                        (ax, ay, ar, ab), (bx, by, br, bb) = groups[a][0], groups[b][0]
                        if ax <= br + 2 and bx <= ar + 2 and ay <= bb + 2 and by <= ab + 2:
                            groups[a] = ((min(ax, bx), min(ay, by), max(ar, br), max(ab, bb)), groups[a][1] + groups.pop(b)[1])
                            changed = True
        want += [(board, i, a) for a, (_, own) in groups.items() for i in own]
    df = spark.createDataFrame(data, "board_id int, box_id int, x0 int, y0 int, x1 int, y1 int")
    assert rows(boards.box_components(df), "board_id", "box_id", "component_id") == sorted(want)
    assert boards.box_components(df.where("false")).count() == 0


def test_transcript_gate(spark):
    english = "This is a long enough sentence about nothing at all"
    tracks = [(1, 60_000, "en-US", None), (2, 60_000, "zh_CN", 0.4), (3, 60_000, None, 0.9), (4, 90_000, "en", 0.5), (5, 20_000, "de", 0.6)]
    cues = [(1, 1, 0, 20_000, english), (1, 2, 20_000, 25_000, "这是一个中文" + english)]
    cues += [(2, i, i * 10_000, i * 10_000 + 9_000, english) for i in range(6)]
    cues += [(3, 1, 0, 10_000, "Please LIKE and"), (3, 2, 11_000, 20_000, " sub scribe")]
    cues += [(4, i, i * 1_000, i * 1_000 + 900, english + str(i)) for i in range(40)]
    cues += [(5, 1, 0, 100, "请订 阅")]
    df = spark.createDataFrame(cues, "project_id int, cue_no int, start_ms bigint, end_ms bigint, text string")
    got = rules.transcript_gate(df, spark.createDataFrame(tracks, "project_id int, duration_ms bigint, language string, probability double"))
    assert rows(got.na.fill(""), "project_id", "rule_id", "severity", "value") == sorted(
        [(1, "thin-coverage", "warning", "")] + [(2, r, "error", "") for r in ("low-probability", "no-chinese", "few-units", "repeats")] + [(2, "third-no-chinese", "error", t) for t in "123"]
        + [(3, "few-units", "error", ""), (3, "low-coverage", "error", ""), (3, "promotion", "error", ""), (3, "unknown-language", "error", "")] + [(4, "thin-coverage", "warning", "")] + [(5, "promotion", "error", "")])


def test_reconcile_ids(spark):
    expected = [("s", i, e, lab, t) for i, (e, lab, t) in enumerate([("a", "A", "ta"), ("b", "B", "tb"), ("c", "C", "tc"), ("d", "C", "td")])]
    # 1 takes b by its source before 2, which is b, can; 2 then goes by its trigger; 3 by id; the label of 4 is left once c is taken.
    drawn = [("s", 1, "x", ["zz", "b"], "Q", None), ("s", 2, "b", None, "Q", " ta "), ("s", 3, "c", [], None, None), ("s", 4, None, [""], "C", "tc")]
    drawn += [("t", 1, "a", [], "A", None)]
    expected += [("t", 1, "a", "A", None), ("t", 2, "b", "A", None)]
    a = spark.createDataFrame(drawn, "scene_id string, place int, actual_id string, source_ids array<string>, label string, trigger string")
    b = spark.createDataFrame(expected, "scene_id string, place int, element_id string, label string, trigger string")
    got = {(r.scene_id, r.place): (r.element_id, r.rule_id) for r in boards.reconcile_ids(a, b).collect()}
    assert got == {("s", 1): ("b", None), ("s", 2): ("a", None), ("s", 3): ("c", None), ("s", 4): ("d", None), ("t", 1): (None, "count-differs")}


def test_resolve_beat_anchor(spark):
    words = spark.createDataFrame([(1, s, i, t, i * 100, i * 100 + 90) for s, i, t in [("a", 0, "The big"), ("a", 1, "Cat"), ("a", 2, "sat."), ("b", 3, "the"), ("b", 4, "the")]], "project_id int, scene_id string, word_id int, text string, start_ms bigint, end_ms bigint")
    beats = spark.createDataFrame([(1, "a", 1, 2, None), (1, "a", 2, 3, "cat"), (1, "a", 3, 99, "BIG cat SAT."), (1, "b", 4, None, "the"), (1, "b", 5, None, "the the"), (1, "z", 6, None, "the"), (1, "a", 7, None, " ")], "project_id int, scene_id string, beat_no int, word_id int, phrase string")
    got = {r.beat_no: (r.anchor_id, r.start_ms, r.rule_id) for r in boards.resolve_beat_anchor(beats, words, words).collect()}
    assert got == {1: (2, 200, None), 2: (None, None, "outside-scene"), 3: (0, 0, None), 4: (None, None, "no-anchor"), 5: (3, 300, None), 6: (None, None, "unknown-scene"), 7: (None, None, "no-anchor")}


def test_split_of_one_very_long_clause(spark):
    rng = random.Random(1)
    n = 100_000
    text = "".join(rng.choice("abcdefgh") for _ in range(n))
    atoms = spark.createDataFrame([(1, 0, text, 0, n, True)], "project_id int, atom_no int, text string, start_idx int, end_idx int, major boolean")
    letters = spark.createDataFrame([(1, i, c, i * 100, i * 100 + 80) for i, c in enumerate(text)], "project_id int, pos int, key string, start_ms bigint, end_ms bigint")
    got = captions.split_long_atoms(atoms, letters).orderBy("piece_no").collect()
    assert "".join(r.text for r in got) == text and all(1 <= r.end_idx - r.start_idx <= 18 for r in got)
    assert all(a.end_idx == b.start_idx for a, b in zip(got, got[1:])) and [r.major for r in got] == [False] * (len(got) - 1) + [True]
