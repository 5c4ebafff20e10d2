"""Letters of many projects at once as arrays: a script's letters on recognised times, and clauses cut at pauses.

Spark deals and sorts the rows by project; here whole projects are taken together, some MB at a time,
so that no letter is a row before it is a result. Times are doubles within, so that one may be missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of rows that are worked on together; a larger project stands alone. Arrays of their letters are some 60 times as large.
BYTES_TOGETHER = 2 << 20
#: Letters in one batch of results.
LETTERS_OUT = 50_000
#: What rows of a project are, in this order.
SCRIPT, SPOKEN, CLAUSE = 0, 1, 2
#: Factors of the hash of neighbouring letters; the next is taken if different letters share a hash.
FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def whole_projects(batches: Iterable[pa.RecordBatch], most: int = BYTES_TOGETHER) -> Iterator[pa.Table]:
    """Rows sorted by project_id as tables of whole projects."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, most
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = pc.index(table["project_id"], table["project_id"][-1]).as_py()
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        size = sum(b.nbytes for b in held)
        enough = max(most, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Alphabet:
    """Numbers of different letters, and of each the number of its lower case."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.lower: list[int] = []

    def add(self, letter: str) -> int:
        if letter not in self.number:
            at = self.number[letter] = len(self.number)
            self.lower.append(at)
            self.lower[at] = self.add(letter.lower())
        return self.number[letter]

    def spell(self, texts: pa.Array, split: bool) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the letters, and how many each text has; a text is one letter without `split`."""
        texts = pc.fill_null(texts, "")
        if not split:
            encoded = texts.dictionary_encode()
            table = np.array([self.add(x) for x in encoded.dictionary.to_pylist()], np.int64)
            return table[encoded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.int64), np.ones(len(texts), np.int64)
        codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        table, found = np.zeros(0x110000, np.int64), np.flatnonzero(seen)
        table[found] = [self.add(chr(c)) for c in found]
        return table[codes], pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)

    def letters(self) -> pa.Array:
        return pa.array(list(self.number), pa.string())


class Projects:
    """The rows of whole projects: which project each belongs to, and its columns by kind."""

    def __init__(self, table: pa.Table):
        self.table, ids = table, table["project_id"].combine_chunks()
        changes = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
        self.ids, self.n = ids.take(pa.array(starts)), len(starts)
        self.own = np.repeat(np.arange(self.n), np.diff(np.append(starts, len(ids))))
        self.kind = table["_kind"].to_numpy()

    def of(self, kind: int, *columns: str) -> tuple:
        rows = np.flatnonzero(self.kind == kind)
        part = self.table.select(columns).take(pa.array(rows))
        return self.own[rows], *[part[c].combine_chunks() for c in columns]


def doubles(column: pa.Array) -> np.ndarray:
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False) if column.null_count == 0 else pc.fill_null(pc.cast(column, pa.float64()), float("nan")).to_numpy(zero_copy_only=False)


def places(own: np.ndarray, n: int) -> np.ndarray:
    """Where each project's letters begin, and where the last one's end."""
    return np.searchsorted(own, np.arange(n + 1))


def spread(first: np.ndarray, last: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words' letters: a word's time evenly, a millisecond at least."""
    n = np.repeat(count, count)
    i = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
    a, span = np.repeat(first, count), np.repeat(np.fmax(first + count, last) - first, count)
    start = np.rint(a + span * i / n)
    return start, np.fmax(start + 1, np.rint(a + span * (i + 1) / n))


def shared_once(own: np.ndarray, keys: np.ndarray, own2: np.ndarray, keys2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and j at which the same k letters begin, where they stand once in the project's script and once in its recognition."""
    both, projects = np.concatenate([keys, keys2]), np.concatenate([own, own2])
    valid = np.zeros(len(both), bool)
    for lo, part in ((0, own), (len(own), own2)):
        if len(part) >= k:
            valid[lo : lo + len(part) - k + 1] = part[: len(part) - k + 1] == part[k - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    letters = both.astype(np.uint64) + np.uint64(1)
    for factor in FACTORS:
        total, power = projects[at].astype(np.uint64), 1
        for n in range(k):
            power = power * factor % (1 << 64)
            total += letters[at + n] * np.uint64(power)
        total ^= total >> np.uint64(29)
        order = np.argsort(total)
        total, place = total[order], at[order]
        same = np.flatnonzero(total[1:] == total[:-1])
        x, y = place[same], place[same + 1]
        equal = projects[x] == projects[y]
        for n in range(k):
            equal &= both[x + n] == both[y + n]
        if equal.all():
            break
    else:
        raise ValueError("different letters share a hash by every factor")
    starts = np.concatenate([[0], np.flatnonzero(total[1:] != total[:-1]) + 1])
    pairs = starts[np.diff(np.append(starts, len(total))) == 2]
    x, y = np.minimum(place[pairs], place[pairs + 1]), np.maximum(place[pairs], place[pairs + 1])
    ok = (x < len(own)) & (y >= len(own))
    to = np.full(len(own), -1)
    to[x[ok]] = y[ok] - len(own)
    i = np.flatnonzero(to >= 0)
    return i, to[i]


def anchored(own: np.ndarray, keys: np.ndarray, own2: np.ndarray, keys2: np.ndarray, n: int, k: int, slack: int) -> np.ndarray:
    """For each script letter the recognised letter it is, or -1: letters in runs whose k letters stand once in both.

    Runs further than `slack` from the median shift of their neighbours, and runs that cross others, are left out.
    """
    to = np.full(len(own), -1)
    i, j = shared_once(own, keys, own2, keys2, k)
    if not len(i):
        return to
    shift = (j - places(own2, n)[own[i]]) - (i - places(own, n)[own[i]])
    first = np.concatenate([[0], np.flatnonzero((i[1:] != i[:-1] + 1) | (shift[1:] != shift[:-1]) | (own[i[1:]] != own[i[:-1]])) + 1])
    i0, i1, j0, d, p = i[first], i[np.append(first[1:], len(i)) - 1], j[first], shift[first], own[i[first]]
    near = np.arange(len(first))[:, None] + np.arange(-10, 11)
    inside = (near >= 0) & (near < len(first))
    near = np.clip(near, 0, len(first) - 1)
    inside &= p[near] == p[:, None]
    sorted_, many = np.sort(np.where(inside, d[near], np.inf), axis=1), inside.sum(axis=1)
    rows = np.arange(len(first))
    median = (sorted_[rows, (many - 1) // 2] + sorted_[rows, many // 2]) / 2
    near = np.abs(d - median) <= slack
    i0, i1, j0 = i0[near], i1[near], j0[near]
    j1 = j0 + i1 - i0
    before = np.concatenate([[-1], np.maximum.accumulate(j1)[:-1]])[: len(j1)]
    behind = np.concatenate([np.minimum.accumulate(j0[::-1])[::-1][1:], [len(own2)]])[: len(j1)]
    apart = (j0 > before) & (j1 < behind)
    i0, i1, j0 = i0[apart], i1[apart], j0[apart]
    if not len(i0):
        return to
    run = np.zeros(len(own), np.int64)
    run[i0] = np.arange(1, len(i0) + 1)
    run = np.maximum.accumulate(run) - 1
    at = np.arange(len(own))
    on = (run >= 0) & (at <= i1[run] + k - 1)
    to[on] = at[on] + (j0 - i0)[run[on]]
    return to


def aligned(projects: Projects, split: bool, k: int, slack: int) -> tuple[Alphabet, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An alphabet, and of each script letter its project, number, start and end. Projects without recognised letters have none.

    Letters without a recognised one are spread evenly over the recognised letters between their
    neighbours', or if there are none over the time between them. Then starts and ends never go back.
    """
    alphabet = Alphabet()
    own, texts = projects.of(SCRIPT, "text")
    ids, count = alphabet.spell(texts, split)
    own = np.repeat(own, count)
    own2, texts, a, b = projects.of(SPOKEN, "text", "a", "b")
    ids2, count = alphabet.spell(texts, split)
    own2, a, b = np.repeat(own2, count), doubles(a), doubles(b)
    start2, end2 = spread(a, b, count) if split else (a, b)
    heard = np.bincount(own2, minlength=projects.n) > 0
    ids, own = ids[heard[own]], own[heard[own]]
    if not len(ids):
        return alphabet, own, ids, ids, ids
    lower, size = np.array(alphabet.lower), len(ids)
    to = anchored(own, lower[ids], own2, lower[ids2], projects.n, k, slack)
    at, on, from_, from2 = np.arange(size), to >= 0, places(own, projects.n), places(own2, projects.n)
    start, end = np.where(on, start2[to], np.nan), np.where(on, end2[to], np.nan)
    open_ = np.flatnonzero(~on | np.isnan(start))
    p = own[open_]
    left = np.concatenate([[-1], np.maximum.accumulate(np.where(on, at, -1))[:-1]])[open_]
    right = np.append(np.minimum.accumulate(np.where(on, at, size)[::-1])[::-1][1:], size)[open_]
    has_left, has_right = left >= from_[p], right < from_[p + 1]
    lj, rj = np.where(has_left, to[left], from2[p] - 1), np.where(has_right, to[np.minimum(right, size - 1)], from2[p + 1])
    first, final = start2[from2[p]], end2[from2[p + 1] - 1]
    value = lambda times, j, known: np.where(known, times[np.clip(j, 0, len(times) - 1)], np.nan)
    or_ = lambda x, y: np.where(np.isnan(x), y, x)
    between = rj - lj > 1
    low = or_(np.where(between, value(start2, lj + 1, has_left & (lj + 1 < from2[p + 1])), value(end2, lj, has_left)), first)
    high = or_(np.where(between, value(end2, rj - 1, has_right & (rj - 1 >= from2[p])), value(start2, rj, has_right)), final)
    begin, stop = np.maximum(left + 1, from_[p]), np.minimum(right, from_[p + 1])
    alone = on[open_]
    n, i = np.where(alone, 1, stop - begin), np.where(alone, 0, open_ - begin)
    span = np.fmax(n, high - low)
    start[open_] = np.rint(low + span * i / n)
    own_end = np.fmax(start[open_] + 1, np.rint(low + span * (i + 1) / n))
    end[open_] = np.where(alone, end[open_], own_end)
    # The running maximum of monotone_clamp, project by project.
    place = at - from_[own] + 1
    least = np.fmax(start + 1, end)
    over = np.maximum(np.where(np.isnan(least), place, least).astype(np.int64) - place, 0)
    step = own * (over.max() + 1)
    until = place + np.maximum.accumulate(over + step) - step
    before = np.concatenate([[0], until[:-1]])
    before[from_[:-1][np.diff(from_) > 0]] = 0
    return alphabet, own, ids, np.fmax(before, start).astype(np.int64), until


def align_rows(batches: Iterable[pa.RecordBatch], split: bool, k: int, slack: int) -> Iterator[pa.RecordBatch]:
    """project_id, pos, text, key, start_ms, end_ms."""
    for table in whole_projects(batches):
        projects = Projects(table)
        alphabet, own, ids, start, end = aligned(projects, split, k, slack)
        letters, lower, pos = alphabet.letters(), np.array(alphabet.lower, np.int64), np.arange(len(own)) - places(own, projects.n)[own]
        for lo in range(0, len(own), LETTERS_OUT):
            s = slice(lo, lo + LETTERS_OUT)
            columns = [projects.ids.take(pa.array(own[s])), pa.array(pos[s].astype(np.int32)), letters.take(pa.array(ids[s])), letters.take(pa.array(lower[ids[s]])), pa.array(start[s]), pa.array(end[s])]
            yield pa.RecordBatch.from_arrays(columns, ["project_id", "pos", "text", "key", "start_ms", "end_ms"])


def joints(keys: pa.Array, connectors: tuple[str, ...]) -> np.ndarray:
    """Whether a connector begins at each letter. keys: the letters in lower case, an empty one between clauses stands for a border."""
    _, offsets, data = keys.buffers()
    offsets, data = np.frombuffer(offsets, np.int32)[keys.offset : keys.offset + len(keys) + 1], data.to_pybytes()
    out = np.zeros(len(keys), bool)
    for word in map(str.encode, connectors):
        place = data.find(word)
        while place >= 0:
            at = int(np.searchsorted(offsets, place, "right")) - 1
            if at < len(out) and offsets[at] == place:
                out[at] = True
            place = data.find(word, place + 1)
    return out


def cuts(lo: np.ndarray, n: np.ndarray, start: np.ndarray, end: np.ndarray, joint: np.ndarray, max_chars: int, max_ms: int, worth: tuple[int, int, int]) -> tuple[np.ndarray, ...]:
    """Clause, piece number, first letter and end of each piece; clause c has the n[c] letters from lo[c] on.

    All clauses go on by one piece at a time. A piece ends where pause, connector and length together are worth most, the later place on a tie.
    """
    pause, connector, short = worth
    fits = (n <= max_chars) & (end[lo + n - 1] - start[lo] <= max_ms)
    live = np.flatnonzero(~fits)
    found = [(np.flatnonzero(fits), np.zeros(int(fits.sum()), np.int64), np.zeros(int(fits.sum()), np.int64), n[fits])]
    s, step, last = np.zeros(len(live), np.int64), 0, len(start) - 1
    while len(live):
        at, left = lo[live] + s, n[live] - s
        far = np.ones(len(live), np.int64)
        for f in range(2, max_chars + 1):
            far = np.where((left >= f) & (end[np.minimum(at + f - 1, last)] - start[at] <= max_ms), f, far)
        nearest = np.minimum(far, max(4, max_chars // 3))
        best, gain = far.copy(), np.full(len(live), np.iinfo(np.int64).min)
        for b in range(1, int(far.max()) + 1):
            x = np.minimum(at + b, last)
            value = pause * (start[x] - end[x - 1]) + connector * joint[x] - short * (far - b)
            better = (b >= nearest) & (b <= far) & (value >= gain)
            best, gain = np.where(better, b, best), np.where(better, value, gain)
        size = np.where(far >= left, left, best)
        found.append((live, np.full(len(live), step), s, s + size))
        go = size < left
        live, s, step = live[go], (s + size)[go], step + 1
    return tuple(np.concatenate(x) for x in zip(*found))


def pieces(projects: Projects, own: np.ndarray, pos: np.ndarray, keys: pa.Array, start: np.ndarray, end: np.ndarray, max_chars: int, max_ms: int, connectors: tuple[str, ...], worth: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Pieces of the projects' clauses whose letters are all there: project_id, atom_no, piece_no, text, start_idx, end_idx, major, start_ms, end_ms."""
    clause_of, number, text, marks, a, b, major = projects.of(CLAUSE, "_i", "text", "marks", "a", "b", "major")
    a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    far = np.int64(1) << 40
    place = own * far + pos
    lo, hi = np.searchsorted(place, clause_of * far + a), np.searchsorted(place, clause_of * far + b)
    whole = np.flatnonzero((hi - lo == b - a) & (hi > lo))
    if not len(whole):
        return
    lo, n, a = lo[whole], (hi - lo)[whole], a[whole]
    # Connectors lie within a clause, so clauses are looked at one behind another, with a border after each.
    index = np.repeat(lo - np.concatenate([[0], np.cumsum(n + 1)[:-1]]), n + 1) + np.arange(int((n + 1).sum()))
    border = np.zeros(len(index), bool)
    border[np.cumsum(n + 1) - 1] = True
    spelled = pc.if_else(pa.array(border), pa.scalar("\0"), keys.take(pa.array(np.minimum(index, len(keys) - 1))))
    joint = np.zeros(len(start), bool)
    joint[index[~border]] = joints(spelled, connectors)[~border]
    c, no, s, e = cuts(lo, n, start, end, joint, max_chars, max_ms, worth)
    order = np.lexsort((no, c))
    c, no, s, e = c[order], no[order], s[order], e[order]
    text, marks = text.take(pa.array(whole)).to_pylist(), marks.take(pa.array(whole)).to_pylist()
    said, known, seen = [], -1, None
    for i, lo_, hi_, size in zip(c.tolist(), s.tolist(), e.tolist(), n[c].tolist()):
        if lo_ == 0 and hi_ >= size:
            said.append(text[i])
            continue
        if i != known:
            known, seen = i, np.flatnonzero(np.frombuffer(marks[i].encode("utf-32-le"), np.uint32)).tolist()
        said.append(text[i][0 if lo_ == 0 else seen[lo_] : len(text[i]) if hi_ >= size else seen[hi_ - 1] + 1])
    at = pa.array(whole[c])
    ends = pc.and_(major.take(at), pa.array(e == n[c]))
    columns = [
        projects.ids.take(pa.array(clause_of[whole][c])), number.take(at).cast(pa.int32()), pa.array(no.astype(np.int32)), pa.array(said, pa.string()), pa.array(a[c] + s), pa.array(a[c] + e), ends,
        pa.array(start[lo[c] + s]), pa.array(end[lo[c] + e - 1]),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["project_id", "atom_no", "piece_no", "text", "start_idx", "end_idx", "major", "start_ms", "end_ms"])


def script_piece_rows(batches: Iterable[pa.RecordBatch], k: int, slack: int, **how) -> Iterator[pa.RecordBatch]:
    """Pieces of clauses on the times of the script's letters."""
    for table in whole_projects(batches):
        projects = Projects(table)
        alphabet, own, ids, start, end = aligned(projects, True, k, slack)
        keys = alphabet.letters().take(pa.array(np.array(alphabet.lower, np.int64)[ids]))
        yield from pieces(projects, own, np.arange(len(own)) - places(own, projects.n)[own], keys, start, end, **how)


def piece_rows(batches: Iterable[pa.RecordBatch], **how) -> Iterator[pa.RecordBatch]:
    """Pieces of clauses on the times of the letters that are rows."""
    for table in whole_projects(batches):
        projects = Projects(table)
        own, pos, keys, a, b = projects.of(SPOKEN, "_i", "text", "a", "b")
        times = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
        yield from pieces(projects, own, pos.to_numpy(zero_copy_only=False), keys, *times, **how)
