"""SentencePiece encoding and decoding by suffix-array matching.

A batch's different words stand in one text with a suffix array; each piece of the vocabulary is
looked up by binary search and gives the range of its occurrences. Occurrences are edges of a
graph over text positions; sorted by where they end, they are relaxed in one sweep. The
vocabulary is one of merges, so the path wanted is not the likeliest but the one that merging by
rank gives: position p keeps its last piece t, and an edge with piece u from p holds only if
merging the text of t and u on its own gives exactly t, u. One edge holds at each position.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cuespan.llm.chunks import Memo, column_bytes, pair_cuts, ragged, slices, split_chunks
from cuespan.llm.common import small_batches

NORMAL, BYTE = 1, 6
META = "▁"
START, NOT_REACHED = -2, -1
#: Bytes of different words matched at a time.
MATCH_BYTES = 1 << 17
#: Words a worker remembers the pieces of.
MEMO_WORDS = 200_000


class SuffixMatcher:
    """Finds all occurrences of a fixed set of byte strings (none with a zero byte) in many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.words = max(1, -(-int(self.size.max()) // 8))
        pad = lambda fill: np.frombuffer(b"".join(p.ljust(8 * self.words, fill) for p in pieces), ">u8").astype(np.uint64).reshape(-1, self.words)
        self.low, self.high = pad(b"\0"), pad(b"\xff")

    def suffixes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Eight bytes from each position on as a number, and the positions sorted by their first 8 * words bytes."""
        n = len(data)
        key = np.zeros(n + 8 * self.words + 8, np.uint64)
        key[:n] = data
        for step in (1, 2, 4):
            key[:-step] = (key[:-step] << np.uint64(8 * step)) | key[step:]
        order = np.argsort(key[:n])
        depth, value = 8, key
        while depth < 8 * self.words:
            sorted_value = value[order]
            rank = np.zeros(n + 8 * self.words, np.uint64)
            rank[order] = np.cumsum(np.concatenate([[1], sorted_value[1:] != sorted_value[:-1]])).astype(np.uint64)
            value = (rank[:n] << np.uint64(32)) | rank[depth : n + depth]
            order = np.argsort(value)
            depth *= 2
        return key, order

    def _bound(self, key, order, lo, hi, word, value, right):
        """Binary search of `value` for the word-th eight bytes behind order[lo..hi]."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            found = key[order[np.minimum(mid, len(order) - 1)] + 8 * word]
            less = open_ & ((found <= value) if right else (found < value))
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, start) of every occurrence."""
        key, order = self.suffixes(data)
        front = key[order]
        lo, hi = np.searchsorted(front, self.low[:, 0], "left"), np.searchsorted(front, self.high[:, 0], "right")
        for word in range(1, self.words):
            long = np.flatnonzero((self.size > 8 * word) & (lo < hi))
            if not len(long):
                break
            a = self._bound(key, order, lo[long], hi[long], word, self.low[long, word], False)
            hi[long] = self._bound(key, order, lo[long], hi[long], word, self.high[long, word], True)
            lo[long] = a
        count = hi - lo
        return np.repeat(np.arange(len(count)), count), order[ragged(lo, count)]


class PieceTables:
    """What encoding and decoding need of a SentencePiece merge model, as arrays to broadcast."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces:
            raise ValueError("only merge models with the identity normaliser are supported")
        self.prefix = norm.add_dummy_prefix
        self.text = [p.piece.replace(META, " ") for p in proto.pieces]
        kind = np.array([p.type for p in proto.pieces])
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(kind == BYTE):
            self.byte_id[int(self.text[i][1:-1], 16)] = i
        self.is_byte = kind == BYTE
        scores = np.array([p.score for p in proto.pieces])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64) + 1
        known = {self.text[i]: int(i) for i in np.flatnonzero(kind == NORMAL)}
        self._spines(known, rank)
        self.matched = np.array(sorted(i for i in known.values() if self.reachable[i]), np.int32)
        self.strings = [self.text[i].encode() for i in self.matched]
        chars = {c for t in known for c in t}
        if missing := {c for c in chars if c not in known}:
            raise ValueError(f"{len(missing)} letters of pieces are no pieces themselves")
        inside = np.zeros((256, 256), bool)
        for t in known:
            b = np.frombuffer(t.encode(), np.uint8)
            inside[b[:-1], b[1:]] = True
        inside[:, 0x80:0xC0] = True  # never inside a letter
        self.breaks = ~inside.ravel()
        self.output = [bytes([int(t[1:-1], 16)]) if b else t.encode() if k == NORMAL else b"" for t, b, k in zip(self.text, self.is_byte, kind, strict=True)]

    def _spines(self, known: dict[str, int], rank: np.ndarray) -> None:
        """How each piece arises from its letters: its states at either end, and when each state begins."""
        n, depth = len(rank), 0
        self.reachable = np.zeros(n, bool)
        left, right, pairs = {}, {}, {}
        for text, i in known.items():
            for k in range(1, len(text)):
                if (a := known.get(text[:k])) is not None and (b := known.get(text[k:])) is not None:
                    pairs[a * 65536 + b] = rank[i]
            parts = [(c, 0) for c in text]
            l_spine, r_spine, now = [parts[0]], [parts[-1]], 0
            while len(parts) > 1:
                found = [(rank[known[a[0] + b[0]]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a[0] + b[0] in known]
                if not found:
                    break
                r, k = min(found)
                now = max(now, int(r))
                parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], now)]
                if k == 0:
                    l_spine.append(parts[0])
                if k == len(parts) - 1:
                    r_spine.append(parts[-1])
            if len(parts) == 1 and all(t in known for t, _ in l_spine + r_spine):
                self.reachable[i] = True
                left[i], right[i] = l_spine, r_spine
                depth = max(depth, len(l_spine), len(r_spine))
        never = np.iinfo(np.int64).max // 2
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key], np.int64)
        for name, spines in (("left", left), ("right", right)):
            state, begin = np.zeros((n, depth + 1), np.int64), np.full((n, depth + 1), never)
            for i, spine in spines.items():
                state[i] = i
                state[i, : len(spine)] = [known[t] for t, _ in spine]
                begin[i, : len(spine)] = [t for _, t in spine]
            setattr(self, f"{name}_state", state.astype(np.int32))
            setattr(self, f"{name}_begin", begin)


class PieceEncoder:
    """A worker's encoder: words to piece ids, remembered."""

    def __init__(self, tables: PieceTables):
        self.t, self.matcher = tables, SuffixMatcher(tables.strings)
        self.is_letter = np.array([len(tables.text[i]) == 1 for i in tables.matched])
        self.known_pair = np.full(1 << 21, -1, np.int64)
        self.known_fits = np.zeros(1 << 21, bool)
        self.memo = Memo(self.encode_words, MEMO_WORDS)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a, b stay apart when their joint text is merged."""
        key = a.astype(np.int64) * 65536 + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        new = np.flatnonzero(self.known_pair[slot] != key)
        out = self.known_fits[slot]
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            fresh = self._fits(keys >> 16, keys & 65535)
            out[new] = fresh[back]
            self.known_pair[slot[new]], self.known_fits[slot[new]] = key[new], out[new]
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t, never = self.t, np.iinfo(np.int64).max // 2
        good, live = np.ones(len(a), bool), np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(live):
            x, y = t.right_state[a[live], i[live]].astype(np.int64), t.left_state[b[live], j[live]].astype(np.int64)
            key = x * 65536 + y
            at = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
            meet = np.where(t.pair_key[at] == key, t.pair_rank[at], never)
            next_x, next_y = t.right_begin[a[live], i[live] + 1], t.left_begin[b[live], j[live] + 1]
            crossed = (meet < never) & (meet < next_x) & (meet <= next_y)
            good[live[crossed]] = False
            left = next_x <= next_y
            more = ~crossed & (np.minimum(next_x, next_y) < never)
            i[live[more & left]] += 1
            j[live[more & ~left]] += 1
            live = live[more]
        return good

    def graph(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text, word starts and ends, and edges (piece index, start, end) sorted by their end in the word.

        Letters without a piece get an edge for each of their bytes, with index -1.
        """
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        piece, at = self.matcher.edges(data)
        covered = np.zeros(len(data), bool)
        covered[at[self.is_letter[piece]]] = True
        head = (data & 0xC0) != 0x80
        covered = covered[np.flatnonzero(head)][np.cumsum(head) - 1]
        covered[ends] = True
        bare = np.flatnonzero(~covered)
        piece, at = np.concatenate([piece, np.full(len(bare), -1)]), np.concatenate([at, bare])
        end = at + np.where(piece < 0, 1, self.matcher.size[piece])
        offset = end - starts[np.searchsorted(starts, at, "right") - 1]
        order = np.argsort(offset.astype(np.uint16) if len(offset) and offset.max() < 65536 else offset, kind="stable")
        return data, starts, ends, piece[order], at[order], end[order], offset[order]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words, one after another, and how many each has."""
        flat, counts, group, size = [], [], [], 0
        for w in words:
            group.append(w)
            size += len(w)
            if size >= MATCH_BYTES:
                self._encode(group, flat, counts)
                group, size = [], 0
        if group:
            self._encode(group, flat, counts)
        return np.concatenate(flat), np.concatenate(counts)

    def _encode(self, words, flat, counts) -> None:
        data, starts, ends, piece, at, end, offset = self.graph(words)
        token = np.where(piece < 0, self.t.byte_id[data[at]], self.t.matched[piece])
        last, back = np.full(len(data) + 1, NOT_REACHED, np.int64), np.zeros(len(data) + 1, np.int64)
        last[starts] = START
        cuts = np.flatnonzero(np.diff(offset)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.append(cuts, len(offset))):
            before = last[at[lo:hi]]
            pick = np.flatnonzero(before != NOT_REACHED)
            before, here = before[pick], token[lo:hi][pick]
            apart = (before == START) | self.t.is_byte[here] | self.t.is_byte[np.maximum(before, 0)]
            both = np.flatnonzero(~apart)
            apart[both] = self.fits(before[both], here[both])
            pick = pick[apart] + lo
            taken = (last[end[pick]] != NOT_REACHED).any()
            last[end[pick]], back[end[pick]] = token[pick], at[pick]
            if taken or (last[end[pick]] != token[pick]).any():
                raise RuntimeError("two pieces end in one place")
        place, word, found = ends.copy(), np.arange(len(words)), []
        while len(word):
            open_ = place[word] > starts[word]
            word = word[open_]
            tokens = last[place[word]]
            if (tokens < 0).any():
                raise RuntimeError("a position that no piece reaches")
            found.append((word, tokens))
            place[word] = back[place[word]]
        which, tokens = np.concatenate([w for w, _ in found]), np.concatenate([t for _, t in found])
        order = np.argsort(which[::-1], kind="stable")
        flat.append(tokens[::-1][order].astype(np.int32))
        counts.append(np.bincount(which, minlength=len(words)))

    def cut(self, column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """A text column as words no piece reaches across, with the dummy space in front; null is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if pc.any(pc.match_substring(column, META)).as_py():
            column = pc.replace_substring(column, META, " ")
        if self.t.prefix:
            column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
        data, offsets = column_bytes(column)
        return split_chunks(data, offsets, pair_cuts(data, self.t.breaks))


_ENCODERS: dict[int, PieceEncoder] = {}


def encoder(tables) -> PieceEncoder:
    """The worker's encoder for broadcast tables, kept from task to task."""
    value = tables.value
    key = zlib.crc32("\n".join(value.text).encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(value)
    return _ENCODERS[key]


def broadcast_tables(docs: DataFrame, model_path: str):
    """The model's tables (their size is the vocabulary's) on every executor."""
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(PieceTables(Path(model_path).read_bytes()))


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """Adds `ids_col`, the piece ids of each whole text, to the rows.

    Null and empty texts have no pieces. A column already named `ids_col` is replaced; all other
    columns stay as they are, repeated rows too. An empty table stays empty.
    """
    tables = broadcast_tables(docs, model_path)
    docs = docs.drop(ids_col)
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{ids_col}` array<int>"])

    def encode(batches):
        own = encoder(tables)
        for batch in batches:
            for part in slices(batch, text_col):
                ids, bounds = own.memo.rows(*own.cut(part.column(text_col)))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids_col])

    return docs.mapInArrow(encode, schema)


def decoded(lists: pa.ListArray, pieces: pa.Array, prefix: bool) -> list[str | None]:
    """Texts of lists of piece ids, given the bytes of each piece."""
    bounds = np.asarray(lists.offsets)
    flat = pieces.take(lists.values.cast(pa.int32()))
    _, offsets, data = flat.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(flat) + 1]
    data = memoryview(data) if data is not None else b""
    texts = [bytes(data[ends[a] : ends[b]]).decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
    texts = [x[1:] if prefix and x[:1] == " " else x for x in texts]
    return [None if null else x for x, null in zip(texts, lists.is_null().to_pylist())]


def checksums(lists: pa.ListArray) -> pa.Array:
    """CRC-32 of each list's ids as little-endian unsigned 32-bit integers."""
    bounds, values = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())


def decode_pieces(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """Adds `text_col`, the text of each row's piece ids: pieces in a row, bytes put together, the dummy space removed.

    Null ids give null. Ids of control pieces stand for nothing. Bytes that are no UTF-8 become U+FFFD.
    """
    tables = broadcast_tables(rows, model_path)
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{text_col}` string"])

    def decode(batches):
        pieces = pa.array(tables.value.output, pa.large_binary())
        for batch in batches:
            texts = decoded(batch.column(ids_col), pieces, tables.value.prefix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return rows.mapInArrow(decode, schema)


def id_checksums(rows: DataFrame, ids_col: str = "piece_ids") -> DataFrame:
    """Adds n_pieces and ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit integers; null ids count as none."""
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + ["n_pieces long", "ids_crc32 long"])

    def sums(batches):
        for batch in batches:
            lists = batch.column(ids_col)
            sizes = pa.array(np.diff(np.asarray(lists.offsets)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, checksums(lists)], [*batch.schema.names, "n_pieces", "ids_crc32"])

    return rows.mapInArrow(sums, schema)


def piece_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text in one pass: doc_id, n_pieces, ids_crc32, decoded_crc32, round_trip.

    round_trip says whether the decoded text equals the original with U+2581 read as a space,
    which is what the model itself does; null counts as empty.
    """
    tables = broadcast_tables(docs, model_path)

    def report(batches):
        own, pieces = encoder(tables), pa.array(tables.value.output, pa.large_binary())
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = own.memo.rows(*own.cut(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                texts = decoded(lists, pieces, tables.value.prefix)
                same = [a == (b or "").replace(META, " ") for a, b in zip(texts, part.column("text").to_pylist())]
                crc = [zlib.crc32(x.encode()) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), checksums(lists), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(report, "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
