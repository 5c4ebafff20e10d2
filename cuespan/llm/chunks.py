"""Cutting texts into chunks that tokenizers treat independently, and remembering results by chunk.

Most chunks of a batch repeat (they are words), so each different one is worked on once.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at a time in one task.
SLICE_BYTES = 4 << 20
#: Different chunks remembered by a worker before it forgets them all.
MEMO_CHUNKS = 800_000


def give_back() -> None:
    """Returns memory that Arrow and the C library hold for later: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if (libc := ctypes.util.find_library("c")) and hasattr(lib := ctypes.CDLL(libc), "malloc_trim"):
        lib.malloc_trim(0)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes of a text column and the rows' offsets; null counts as empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `most` text bytes; a longer text stands alone."""
    _, offsets = column_bytes(batch.column(text_col))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def pair_cuts(data: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where a byte y follows a byte x with breaks[256 x + y]."""
    cut = np.zeros(len(data), bool)
    cut[1:] = breaks[data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]]
    return cut


def split_chunks(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Cuts the rows where `cut` is set and between rows; the number of each row's first chunk comes second."""
    if not len(data):
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(offsets), np.int64)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(data)).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return chunks.dictionary_encode(), np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + counts[i] - 1 for all i, one after another."""
    total = int(counts.sum())
    shift = starts - (np.cumsum(counts) - counts)
    return np.repeat(shift, counts) + np.arange(total, dtype=np.int64)


class Memo:
    """Ids of chunks, computed once by `encode(list of bytes) -> (flat ids, counts)`."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = MEMO_CHUNKS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def slots(self, chunks: pa.Array) -> np.ndarray:
        """Slot of each of the different chunks in `chunks`."""
        if len(self.slot) > self.most:
            self.clear()
        values, get = chunks.to_pylist(), self.slot.get
        out = np.fromiter((get(v, -1) for v in values), np.int64, len(values))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [values[i] for i in missing]
            flat, counts = self.encode(new)
            base = len(self.slot)
            self.slot.update(zip(new, range(base, base + len(new))))
            self._room("flat", self.used + len(flat))
            self.flat[self.used : self.used + len(flat)] = flat
            for name in ("start", "count"):
                self._room(name, base + len(new))
            self.start[base : base + len(new)] = self.used + np.cumsum(counts) - counts
            self.count[base : base + len(new)] = counts
            self.used += len(flat)
            out[missing] = np.arange(base, base + len(new))
        return out

    def rows(self, chunks: pa.DictionaryArray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and each row's offsets into them."""
        slots = self.slots(chunks.dictionary)
        if not len(slots):
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        slots = slots[chunks.indices.to_numpy(zero_copy_only=False)]
        counts = self.count[slots]
        ids = self.flat[ragged(self.start[slots], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[first]
