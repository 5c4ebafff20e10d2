"""Structured Streaming forms of the incremental consumers; each equals its batch form once the watermark has passed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from cuespan.operators.joins import apply_changes
from cuespan.operators.windows import FAST_STATES, HOLD_STEP, JUMP_STEP, OPAQUE, OTHER_STEP_LIMIT, STEP_DELTA, STEP_LIMITS, hand_motion_qa
from cuespan.streaming.keyed import KeyedTable


def stream_cues(words: DataFrame, pause_ms: int = 420, watermark: str | None = "10 seconds") -> DataFrame:
    """Cues closed by a pause: (project_id, start, end, n_words, text) of word events (project_id, ts, idx, text, dur_ms).

    A session window with a gap of the word's own length and the pause. A session also takes a row
    that starts right at its end, so a pause of exactly `pause_ms` does not close a cue.
    """
    src = words.withWatermark("ts", watermark) if watermark else words
    gap = F.concat((F.col("dur_ms") + pause_ms).cast("string"), F.lit(" milliseconds"))
    out = src.groupBy("project_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "idx", "text"))), lambda x: x["text"]), " ").alias("text"), F.max(F.unix_millis("ts") + F.col("dur_ms")).alias("end_ms"))
    return out.select("project_id", F.unix_millis("w.start").alias("start_ms"), "end_ms", "n_words", "text")


#: Samples of a video at most, the shortest interval, and what intervals are a multiple of.
MOST_SAMPLES, LEAST_INTERVAL_MS, INTERVAL_STEP_MS = 4800, 250, 50


def sample_interval_ms(duration_ms: str | Column) -> Column:
    """The interval at which a video of this length is sampled: it grows so that there are MOST_SAMPLES at most."""
    d = F.col(duration_ms) if isinstance(duration_ms, str) else duration_ms
    return F.greatest(F.lit(LEAST_INTERVAL_MS), F.ceil(d / float(MOST_SAMPLES) / INTERVAL_STEP_MS) * INTERVAL_STEP_MS).cast("bigint")


def nearest_millis(ts: str | Column) -> Column:
    """A time as the nearest whole millisecond, half away from 1970."""
    return F.round(F.unix_micros(ts) / 1000).cast("bigint")


def _slots(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Frames (video_id, ts, score) within their video with its interval and their slot, which count from the video's own start.

    Slots go by times to the nearest millisecond; whether a frame is within its video, by the times as they are.
    """
    at, since = nearest_millis("ts") - nearest_millis("start"), F.unix_micros("ts") - F.unix_micros("start")
    df = frames.join(videos.select("video_id", "start", "duration_ms"), "video_id")
    df = df.withColumn("interval_ms", sample_interval_ms("duration_ms")).withColumn("slot", F.floor(at / F.col("interval_ms")).cast("bigint"))
    return df.where((since >= 0) & (since < F.col("duration_ms") * 1000))


def downsample(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """The first sample of each slot: (video_id, slot_ms, score), slot_ms from the video's start. videos: video_id, start, duration_ms."""
    out = _slots(frames, videos).groupBy("video_id", "slot", "interval_ms").agg(F.min_by("score", F.struct("ts", "score")).alias("score"))
    return out.select("video_id", (F.col("slot") * F.col("interval_ms")).alias("slot_ms"), "score")


class _FirstOfSlot(StatefulProcessor):
    """Keeps the earliest sample of each slot that the watermark has not passed; the timer of its end gives it out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "ends long", "slot_ms long, ts long, score double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(rows)
        frames["at"] = frames["ts"].astype("datetime64[us]").astype("int64")
        for ends, slot in frames.sort_values(["at", "score"]).groupby("ends", sort=True):
            first, end = slot.iloc[0], (int(ends),)
            new = (int(first["slot_ms"]), int(first["at"]), float(first["score"]))
            if not self.slots.containsKey(end):
                self.handle.registerTimer(int(ends))
                self.slots.updateValue(end, new)
            elif new[1:] < tuple(self.slots.getValue(end))[1:]:
                self.slots.updateValue(end, new)
        yield pd.DataFrame({"video_id": [], "slot_ms": [], "score": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = (expiredTimerInfo.getExpiryTimeInMs(),)
        slot_ms, _, score = self.slots.getValue(end)
        self.slots.removeKey(end)
        yield pd.DataFrame({"video_id": [key[0]], "slot_ms": [slot_ms], "score": [score]})

    def close(self) -> None:
        pass


def stream_downsample(frames: DataFrame, videos: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """`downsample` of a feed: (video_id, slot_ms, score), each slot once the watermark has passed its end.

    A key's state is its open slots, and goes with them.
    """
    df = _slots(frames, videos).withWatermark("ts", watermark)
    ends = nearest_millis("start") + (F.col("slot") + 1) * F.col("interval_ms")
    df = df.select("video_id", "ts", F.col("score").cast("double").alias("score"), (F.col("slot") * F.col("interval_ms")).alias("slot_ms"), ends.alias("ends"))
    out = df.groupBy("video_id").transformWithStateInPandas(_FirstOfSlot(), "video_id long, slot_ms long, score double", "Append", "EventTime")
    return out.withColumn("score", F.col("score").cast(dict(frames.dtypes)["score"]))


def stream_tumbling(samples: DataFrame, size: str = "1 minute", slide: str | None = None, watermark: str | None = "10 minutes") -> DataFrame:
    """Counts and mean score per window: (video_id, start, n, score) of samples (video_id, ts, score); with `slide` windows overlap."""
    src = samples.withWatermark("ts", watermark) if watermark else samples
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = src.groupBy("video_id", w.alias("w")).agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return out.select("video_id", F.unix_millis("w.start").alias("start_ms"), "n", "score")


def stream_dedupe(stream: DataFrame, key: list[str], watermark: str = "10 minutes") -> DataFrame:
    """Rows with a key not seen within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(key)


class LateRows(StreamingQueryListener):
    """Counts per query what `stream_dedupe` left out as later than the watermark, and what came in at all.

    A listener of the session: `spark.streams.addListener(late)`. Rows in are observed on the stream itself; rows late are
    those that Spark's deduplication turned away, one by one. After `query.processAllAvailable()` or the end of
    the query both are complete but for the events still on their way.
    """

    ROWS = "rows_in"

    def __init__(self) -> None:
        self.late: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.late.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name, progress = str(event.progress.id), event.progress
        for operator in progress.stateOperators:
            if operator.operatorName.startswith("dedupe"):
                self.late[name] = self.late.get(name, 0) + operator.numRowsDroppedByWatermark
        if (seen := progress.observedMetrics.get(self.ROWS)) is not None:
            self.rows[name] = self.rows.get(name, 0) + seen["n"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))


def observed(stream: DataFrame) -> DataFrame:
    """The stream, with the number of its rows in each progress report for `LateRows`."""
    return stream.observe(LateRows.ROWS, F.count(F.lit(1)).alias("n"))


LEDGER_KEYS = ("scene_id",)


def put_results(table: KeyedTable, batch: DataFrame, batch_id: int, version: str = "version") -> None:
    """Upserts a batch: of each key the row with the highest version stays, of equal ones that of the later batch."""
    keys, rest = table.keys, [c for c in batch.columns if c not in table.keys]
    touched, before = table.touched(batch, batch_id)
    both = before.select(*keys, *rest, F.lit(0).alias("_new")).union(batch.select(*keys, *rest, F.lit(1)))
    table.put(batch_id, touched, both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new", *rest)).alias("r")).select(*keys, "r.*"))


def ledger_table(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = LEDGER_KEYS) -> KeyedTable:
    return KeyedTable(spark, path, schema, keys)


def stream_ledger(results: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = LEDGER_KEYS) -> StreamingQuery:
    """Upserts finished scenes into a ledger by key as they come, so a later failure loses none.

    A batch reads and rewrites the buckets of its own keys only; one that runs again after a failure replaces what it wrote.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in results.dtypes)

    def put(batch: DataFrame, batch_id: int) -> None:
        put_results(ledger_table(batch.sparkSession, path, schema, keys), batch, batch_id)

    return results.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ledger(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = LEDGER_KEYS) -> DataFrame:
    """The latest version of each key; what is read follows the live keys, not how often they changed."""
    return ledger_table(spark, path, schema, keys).rows()


#: What a key's state holds of its last two frames: frame, place, opacity, whether shown, whether drawn fast, step.
HAND_STATE = "n int, frame long, x double, y double, opacity double, shown boolean, fast boolean, step double, opacity2 double, shown2 boolean"
HAND_SUMS = "frames long, visible_frames long, max_step double, max_delta double, hold_then_jump long, single_frame_gap long, abrupt long, violations long, late long"
HAND_OUTPUT = "key long, frame long, kind string, value double, frames long, visible_frames long, max_step double, p95_step double, max_delta double, hold_then_jump long, single_frame_gap long, abrupt long, violations long, late long"
#: The kind of the row that sums a trace up.
SUMMARY = "summary"


def hand_violations(frames: pd.DataFrame, before: tuple | None, short_edge: int) -> tuple[pd.DataFrame, tuple, np.ndarray, np.ndarray, int]:
    """Violations of a key's frames, in order, given what is known of the two before; the same of the last two; steps, their changes, and frames shown."""
    n0, frame, x0, y0, o1, s1, f1, step0, o2, s2 = before or (0, -1, 0.0, 0.0, 0.0, False, False, None, 0.0, False)
    frames = frames.sort_values("frame")
    x, y = np.append(x0, frames["x"]), np.append(y0, frames["y"])
    opacity = np.concatenate([[o2, o1], frames["opacity"]])
    shown = np.concatenate([[s2, s1], frames["visible"] & (frames["opacity"] > 0)]).astype(bool)
    fast = np.append(f1, frames["state"].isin(FAST_STATES)).astype(bool)
    step = np.where(shown[2:] & shown[1:-1], np.hypot(np.diff(x), np.diff(y)) / short_edge, np.nan)
    before_step = np.nan_to_num(np.append(np.nan if step0 is None else step0, step[:-1]))
    fast_pair, limit = fast[1:] | fast[:-1], frames["state"].map(STEP_LIMITS).fillna(OTHER_STEP_LIMIT).to_numpy()
    known, delta = ~np.isnan(step) & ~fast_pair, np.abs(step - before_step)
    one, two = np.arange(len(step)) + n0 >= 1, np.arange(len(step)) + n0 >= 2  # whether there is such a frame before
    none = np.full(len(step), np.nan)
    rules = {
        "abrupt-disappearance": (~shown[2:] & shown[1:-1] & (opacity[1:-1] > OPAQUE), none),
        "single-frame-gap": (shown[2:] & one & ~shown[1:-1] & two & shown[:-2] & (opacity[:-2] > OPAQUE) & (opacity[2:] > OPAQUE), none),
        "max-step": (known & (step > limit + 1e-9), step), "hold-then-jump": (known & (before_step <= HOLD_STEP) & (step > JUMP_STEP), step), "step-delta": (known & (delta > STEP_DELTA), delta),
    }
    found = [pd.DataFrame({"key": frames["key"][ok], "frame": frames["frame"][ok], "kind": kind, "value": np.round(value[ok], 5)}) for kind, (ok, value) in rules.items()]
    last = frames.iloc[-1]
    after = (min(n0 + len(step), 2), int(last["frame"]), float(x[-1]), float(y[-1]), float(opacity[-1]), bool(shown[-1]), bool(fast[-1]), None if np.isnan(step[-1]) else float(step[-1]), float(opacity[-2]), bool(shown[-2]))
    return pd.concat(found), after, step[~np.isnan(step)], delta[known], int(shown[2:].sum())


class _HandQa(StatefulProcessor):
    """A key's last two frames, sums and steps; its timer, put off by each frame, sums the trace up and clears them."""

    def __init__(self, short_edge: int, idle_ms: int) -> None:
        self.short_edge, self.idle_ms = short_edge, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", HAND_STATE)
        self.sums = handle.getValueState("sums", HAND_SUMS)
        self.steps = handle.getListState("steps", "step double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(rows)
        before = tuple(self.last.get()) if self.last.exists() else None
        n, seen, most, change, hold, gap, abrupt, bad, late = self.sums.get() if self.sums.exists() else (0, 0, 0.0, 0.0, 0, 0, 0, 0, 0)
        fresh = frames[frames["frame"] > (before[1] if before else -1)]
        late += len(frames) - len(fresh)
        found = pd.DataFrame({"key": [], "frame": [], "kind": [], "value": []})
        if len(fresh):
            found, after, step, delta, shown = hand_violations(fresh, before, self.short_edge)
            self.last.update(after)
            if len(step):
                self.steps.appendList([(float(x),) for x in step])
            kinds = found["kind"].value_counts()
            n, seen, bad = n + len(fresh), seen + shown, bad + len(found)
            most, change = max(most, *step.tolist(), 0.0), max(change, *delta.tolist(), 0.0)
            hold, gap, abrupt = (a + int(kinds.get(k, 0)) for a, k in ((hold, "hold-then-jump"), (gap, "single-frame-gap"), (abrupt, "abrupt-disappearance")))
        self.sums.update((n, seen, float(most), float(change), hold, gap, abrupt, bad, late))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = pd.to_datetime(frames["ts"]).max().value // 1_000_000 + self.idle_ms
        self.handle.registerTimer(max(ends, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._out(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, seen, most, change, hold, gap, abrupt, bad, late = self.sums.get()
        steps = [x[0] for x in self.steps.get()] if self.steps.exists() else []
        p95 = float(np.percentile(steps, 95)) if steps else 0.0
        for state in (self.last, self.sums, self.steps):
            state.clear()
        row = {"key": key[0], "kind": SUMMARY, "frames": n, "visible_frames": seen, "max_step": most, "p95_step": p95, "max_delta": change, "hold_then_jump": hold, "single_frame_gap": gap, "abrupt": abrupt, "violations": bad, "late": late}
        yield self._out(pd.DataFrame([row]))

    @staticmethod
    def _out(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        names = [c.split()[0] for c in HAND_OUTPUT.split(", ")]
        types = dict(c.split() for c in HAND_OUTPUT.split(", "))
        kinds = {"long": "Int64", "double": "float64", "string": "object"}
        return pd.DataFrame({c: rows[c].astype(kinds[types[c]]) if c in rows else pd.Series([None] * len(rows), dtype=kinds[types[c]]) for c in names})

    def close(self) -> None:
        pass


def stream_hand_qa(frames: DataFrame, short_edge: int = 1080, watermark: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Unsteady hand motion in one pass over frames (key, ts, frame, x, y, opacity, state, visible).

    Rows (key, frame, kind, value) are those of `hand_motion_qa`. When the watermark is `idle_ms` past a key's last
    frame, one more of the kind SUMMARY has what `hand_motion_summary` has, and `late`, the frames behind one seen before, which are left out;
    then nothing is kept of the key. Until then its state is the last two frames, sums, and the steps, which the
    percentile needs. Frames of a key must come in order from batch to batch.
    """
    out = frames.withWatermark("ts", watermark).groupBy("key").transformWithStateInPandas(_HandQa(short_edge, idle_ms), HAND_OUTPUT, "Append", "EventTime")
    five = lambda c: F.round(F.when(~F.isnan(c), F.col(c)), 5).alias(c)
    return out.select(*[five(c) if c in ("value", "max_step", "p95_step", "max_delta") else c for c in out.columns])


def hand_qa_batch(frames: DataFrame, short_edge: int = 1080) -> DataFrame:
    """The violations that `stream_hand_qa` gives over a whole table, by windows."""
    return hand_motion_qa(frames, short_edge)


def snapshot_table(spark: SparkSession, path: str, buckets: int = 256) -> KeyedTable:
    return KeyedTable(spark, f"{path}/snapshot", "path string, sha256 string", ("path",), buckets)


def first_snapshot(files: DataFrame, path: str, buckets: int = 256) -> None:
    """Writes (path, sha256) as what the first batch of changes meets."""
    table = snapshot_table(files.sparkSession, path, buckets)
    table.put(-1, set(range(buckets)), files.select("path", "sha256"))


def put_changes(spark: SparkSession, batch: DataFrame, batch_id: int, path: str, allow: str) -> None:
    """Applies a batch of change sets to the snapshot: the buckets of its paths are read and rewritten, no others."""
    table = snapshot_table(spark, path)
    touched, now = table.touched(batch, batch_id)
    new, conflicts, rejects = apply_changes(now, batch, allow)
    for name, df in (("conflicts", conflicts), ("rejects", rejects)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/v={batch_id}")
    table.put(batch_id, touched, new)


def stream_changes(changes: DataFrame, path: str, checkpoint: str, allow: str) -> StreamingQuery:
    """Applies change sets (set_id, path, before_sha256, after_content) to the snapshot below `path`, batch by batch.

    Conflicts and rejects of a batch lie under its number. A batch that runs again after a failure replaces what it
    wrote. `first_snapshot` puts the first snapshot there.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        put_changes(batch.sparkSession, batch, batch_id, path, allow)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, path: str, name: str = "snapshot") -> DataFrame:
    """The latest snapshot, or all conflicts or rejects."""
    return snapshot_table(spark, path).rows() if name == "snapshot" else spark.read.parquet(f"{path}/{name}").drop("v")
