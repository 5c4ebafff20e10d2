"""Removal of repeated word windows by level-wise doubling.

Windows of a quarter of the wanted length come first. Those that occur once are done with: no
longer window at that place can be repeated. Only places whose window is repeated, and whose
second half is too, are looked at again with windows twice as long (the last step below the wanted
length overlaps), and so on past the wanted length until no candidate survives. Words covered by a
repeated window of the wanted length go; the longest length that a document still repeats comes
along.

Texts are written once, to files that tasks read from the shared folder. Per level a file sends
each of its different window hashes to a bucket, packed in one row per bucket, and gets back one
bit for each: whether it occurs again, in this file or in another. So no task holds all places of
a frequent window, and no text moves. Below the wanted length 32 bits of a hash and its bucket are
enough, as a wrong answer only leaves a candidate more; from there on 64 bits and the bucket,
which come from two independent hashes, decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from cuespan.llm.chunks import column_bytes, give_back, ragged
from cuespan.llm.common import discard, drop_shuffles, materialize, scratch
from cuespan.llm.minhash_dedup import M1, mix64, powers

#: Words of a window that must not be repeated.
WORDS = 35
#: Text bytes of a file, about, and files per bucket.
FILE_BYTES = 5 << 20
FILES_PER_BUCKET = 2
#: Bytes whose words are hashed at a time; a longer word has a hash of its own kind.
RUN_BYTES = 1 << 18
#: What a file carries from level to level comes as answers of these buckets: the rows that have candidates and the
#: candidates among their words; the same of what is repeated at the wanted length; and each row's longest length.
ROWS, CANDIDATES, REPEATED_ROWS, REPEATED, LONGEST = -5, -4, -3, -2, -1


def levels(words: int):
    """Window lengths: a quarter of `words`, half of it, `words` itself, then doubled without end."""
    length = -(-words // 4)
    while True:
        yield length
        length = 2 * length if length >= words else min(2 * length, words)


class WordFile:
    """One written file of (doc_id, text), or those of its rows whose bits are set, as words: runs of bytes other than space and 0x09-0x0D."""

    def __init__(self, uri: str, rows: bytes | None = None):
        store, name = pafs.FileSystem.from_uri(uri)
        with store.open_input_file(name) as file:
            table = pq.read_table(file, columns=["doc_id", "text"])
        self.rows = np.ones(table.num_rows, bool) if rows is None else unpacked(rows, table.num_rows)
        table = table.filter(pa.array(self.rows)) if rows is not None else table
        self.ids = table.column("doc_id")
        self.data, offsets = column_bytes(table.column("text"))
        n = len(self.data)
        word = np.ones(256, bool)
        word[[0x20, *range(0x09, 0x0E)]] = False
        word = word[self.data]
        start, stop = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        heads, tails = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
        start[heads] |= word[heads]
        stop[tails] |= word[tails]
        self.starts, self.stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        #: Each row's first word, and for each word how many its row has from there on.
        self.first = np.searchsorted(self.starts, offsets)
        self.ahead = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))
        self._hashes: np.ndarray | None = None
        self._sums: dict[int, np.ndarray] = {}

    def _words(self) -> np.ndarray:
        out, i = np.empty(len(self.starts), np.uint64), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.stops, self.starts[i] + RUN_BYTES, "right")))
            a, b = self.starts[i], self.stops[j - 1]
            if b - a > RUN_BYTES:
                out[i] = int.from_bytes(hashlib.blake2b(self.data[a:b].tobytes(), digest_size=8).digest(), "little")
            else:
                up, down = powers(RUN_BYTES + 1)
                total = np.zeros(b - a + 1, np.uint64)
                np.cumsum((self.data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
                s, e = self.starts[i:j] - a, self.stops[i:j] - a
                out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * M1)
            i = j
        return out

    def windows(self, at: np.ndarray, length: int, lane: int) -> np.ndarray:
        """Hashes of the windows of `length` words from the words `at` on; lanes are independent of each other."""
        up, down = powers(len(self.starts) + 1)
        if lane not in self._sums:
            self._hashes = self._words() if self._hashes is None else self._hashes
            self._sums[lane] = np.zeros(len(self._hashes) + 1, np.uint64)
            np.cumsum(mix64(self._hashes + np.uint64(lane) * M1) * up[:-1], out=self._sums[lane][1:])
        total = self._sums[lane]
        return mix64((total[at + length] - total[at]) * down[at])

    def distinct(self, at: np.ndarray, length: int, buckets: int, exact: bool):
        """Different windows from `at` on by (bucket, key): buckets, keys, whether each is there twice, and the places of `at` among them."""
        lane = self.windows(at, length, 0)
        bucket = (lane >> np.uint64(32)) % np.uint64(buckets)
        keys = self.windows(at, length, 1) if exact else lane.astype(np.uint32)
        # Half of an exact key is sorted by: should two keys that agree in it alternate, one is sent several times, and so is counted as often.
        order = np.argsort(bucket << np.uint64(32) | (keys >> np.uint64(32) if exact else keys))
        bucket, keys = bucket[order].astype(np.int64), keys[order]
        new = np.ones(len(at), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(new)
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(new) - 1
        return bucket[first], keys[first], np.diff(np.append(first, len(at))) > 1, place

    def found(self, bits: bytes) -> np.ndarray:
        return np.flatnonzero(unpacked(bits, len(self.starts)))

    def bits(self, at: np.ndarray) -> bytes:
        out = np.zeros(len(self.starts), bool)
        out[at] = True
        return np.packbits(out).tobytes()

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        """The rows read that the words are in."""
        return np.searchsorted(self.first, at, "right") - 1

    def words_of(self, rows: np.ndarray) -> np.ndarray:
        """The words of the rows read that are set."""
        return np.flatnonzero(np.repeat(rows, np.diff(self.first)))


def unpacked(bits: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)


def bucket_runs(bucket: np.ndarray):
    """(bucket, from, to) of equal neighbours."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(bucket[lo]), int(lo), int(hi)) for lo, hi in zip(np.concatenate([[0], cut]), np.append(cut, len(bucket))) if hi > lo]


def survivors(text: WordFile, state: dict[int, bytes], length: int, buckets: int, exact: bool) -> np.ndarray:
    """The candidates of a level that its answers call repeated."""
    at = text.found(state[CANDIDATES])
    if not len(at):
        return at
    bucket, keys, _, place = text.distinct(at, length, buckets, exact)
    again = np.zeros(len(keys), bool)
    for b, lo, hi in bucket_runs(bucket):
        again[lo:hi] = np.unpackbits(np.frombuffer(state[b], np.uint8), count=hi - lo)
    return at[again[place]]


def find_repeated(exact: bool):
    """Which of a bucket's keys are sent by two files or twice by one."""

    def run(table: pa.Table) -> pa.Table:
        files, bucket = table.column("file"), table.column("bucket")
        if bucket[0].as_py() < 0:
            return pa.table({"file": files, "bucket": bucket, "answer": table.column("keys"), "alive": pa.array([0] * len(table), pa.int64())})
        keys = [np.frombuffer(x, np.uint64 if exact else np.uint32) for x in table.column("keys").to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("twice").to_pylist(), keys)])
        _, back, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        np.add.at(count, back[twice > 0], 1)
        parts = np.split((count > 1)[back], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"file": files, "bucket": bucket, "answer": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()), "alive": pa.array([int(p.sum()) for p in parts], pa.int64())})

    return run


def repeated_windows(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, n_spans, longest.

    A word goes when a window of `words` words covers it whose word sequence also starts anywhere
    else, in the same document or another; windows are judged on the input and never cross
    documents. kept_sha256 is of the words that stay, joined by one space. n_spans counts the
    maximal removed runs; longest is the largest window length tried (words times a power of two)
    that is repeated in the document, 0 if none is. Null, empty and blank texts have no words and
    the empty string's hash; texts of fewer than `words` words stay whole. Ids have no part in the
    decision: rows that repeat an id, or have none, are documents like others, so equal rows
    remove each other. Texts and words may have any length. An empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_files = int(total // file_bytes) + 1
    buckets = n_files // FILES_PER_BUCKET + 1
    path = scratch(spark)
    rows.repartition(n_files, F.xxhash64("doc_id", "text")).write.option("compression", "zstd").parquet(path)
    drop_shuffles(spark)
    files = materialize(spark.read.schema("doc_id long, text string").parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct())

    def send(before: int | None, length: int):
        """Answers of the level before to the candidates of the next."""

        def run(batches):
            for batch in batches:
                for uri, answers in zip(batch.column("file").to_pylist(), batch.column("answers").to_pylist()):
                    state = {a["bucket"]: a["answer"] for a in answers or []}
                    yield from one_file(uri, state)
                    give_back()

        def one_file(uri: str, state: dict[int, bytes]):
            kept = {b: state[b] for b in (REPEATED_ROWS, REPEATED, LONGEST) if b in state}
            if before is not None and not any(state[ROWS]):
                return [message(uri, b, x) for b, x in (kept | {ROWS: state[ROWS], CANDIDATES: b""}).items()]
            text = WordFile(uri, state.get(ROWS))
            if before is None:
                at = np.flatnonzero(text.ahead >= length)
            else:
                alive = survivors(text, state, before, buckets, before >= words)
                if before == words:
                    kept |= {REPEATED_ROWS: state[ROWS], REPEATED: text.bits(alive)}
                if before >= words:
                    longest = np.frombuffer(kept.get(LONGEST, bytes(8 * len(text.rows))), np.int64).copy()
                    longest[np.flatnonzero(text.rows)[text.rows_of(alive)]] = before
                    kept[LONGEST] = longest.tobytes()
                flag = np.zeros(len(text.starts) + length, bool)
                flag[alive] = True
                at = alive[flag[alive + length - before] & (text.ahead[alive] >= length)]
            bucket, keys, twice, _ = text.distinct(at, length, buckets, length >= words) if len(at) else (at, at, at, at)
            out = [message(uri, b, keys[lo:hi].tobytes(), np.packbits(twice[lo:hi]).tobytes()) for b, lo, hi in bucket_runs(bucket)]
            # The next level reads the rows that still have candidates.
            with_some = np.zeros(len(text.ids), bool)
            with_some[text.rows_of(at)] = True
            rows = text.rows.copy()
            rows[text.rows] = with_some
            here = np.zeros(len(text.starts), bool)
            here[at] = True
            kept |= {ROWS: np.packbits(rows).tobytes(), CANDIDATES: np.packbits(here[text.words_of(with_some)]).tobytes()}
            return out + [message(uri, b, x) for b, x in kept.items()]

        return run

    def message(uri: str, bucket: int, keys: bytes, twice: bytes = b"") -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "file": [uri], "keys": pa.array([keys], pa.binary()), "twice": pa.array([twice], pa.binary())})

    def cut_out(batches):
        for batch in batches:
            for uri, answers in zip(batch.column("file").to_pylist(), batch.column("answers").to_pylist()):
                yield removed(WordFile(uri), {a["bucket"]: a["answer"] for a in answers or []})
                give_back()

    def removed(text: WordFile, state: dict[int, bytes]) -> pa.RecordBatch:
        n = len(text.starts)
        edge = np.zeros(n + 1, np.int64)
        at = np.zeros(0, np.int64)
        if REPEATED in state:  # among the words of the rows that were read then
            among = text.words_of(unpacked(state[REPEATED_ROWS], len(text.ids)))
            at = among[unpacked(state[REPEATED], len(among))]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + words, -1)
        gone = np.cumsum(edge[:n]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = text.first[:-1][text.first[:-1] < n]
        begins[heads] |= gone[heads]
        up = lambda x: np.concatenate([[0], np.cumsum(x)])[text.first]
        n_gone, n_begins = up(gone), up(begins)
        # The words that stay, each with the space behind it.
        stay = np.flatnonzero(~gone)
        size = text.stops[stay] - text.starts[stay] + 1
        ends = np.concatenate([[0], np.cumsum(size)])
        kept = np.append(text.data, np.uint8(0x20))[np.minimum(ragged(text.starts[stay], size), len(text.data))] if len(stay) else text.data[:0]
        kept[ends[1:] - 1] = 0x20
        bounds = ends[text.first - n_gone]
        sums = [hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
        longest = np.frombuffer(state.get(LONGEST, bytes(8 * len(text.ids))), np.int64)
        return pa.RecordBatch.from_arrays([
            text.ids.combine_chunks() if text.ids.num_chunks != 1 else text.ids.chunk(0), pa.array(np.diff(text.first).astype(np.int64)), pa.array(np.diff(n_gone).astype(np.int64)),
            pa.array(sums, pa.string()), pa.array(np.diff(n_begins).astype(np.int64)), pa.array(longest),
        ], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans", "longest"])

    def known(answers: DataFrame | None) -> DataFrame:
        if answers is None:
            return files.withColumn("answers", F.lit(None).cast("array<struct<bucket:bigint,answer:binary>>"))
        lists = answers.groupBy("file").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))  # one a bucket
        return files.join(lists, "file", "left")

    answers, before = None, None
    for length in levels(words):
        sent = known(answers).repartition(n_files, "file").mapInArrow(send(before, length), "bucket long, file string, keys binary, twice binary")
        # What a file carries along has a bucket of its own, so that it stays spread out.
        key = F.when(F.col("bucket") < 0, F.xxhash64("file", "bucket")).otherwise(F.col("bucket")).alias("_to")
        got = materialize(sent.groupBy(key, "bucket").applyInArrow(find_repeated(length >= words), "file string, bucket long, answer binary, alive long"))
        if answers is not None:
            discard(answers)
        answers, before = got, length
        if not got.agg(F.sum("alive")).first()[0]:
            break
    return known(answers).repartition(n_files, "file").mapInArrow(cut_out, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long, longest long")
