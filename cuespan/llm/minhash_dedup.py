"""MinHash near-deduplication by a signature-coordinate inverted join.

Documents with the same shingle set are one class. Each class has a signature of COORDINATES
minima; every coordinate-value pair is a posting list. A pair of classes is a candidate when it
collides in at least MATCHES lists. Lists of one class are dropped and the frequent ones of a
class are skipped: two classes that collide often enough meet in the prefix of their rarest
lists. The members of a list are compared in one task, many lists at a time: collisions are
counted, and a pair that met in an earlier list of both prefixes is skipped, so each pair is
counted once. Candidates are confirmed on the full shingle sets in the same task, and what leaves
it are the components that the links made, never pairs. A long list is dealt in blocks; after
the blocks' own links are known, only members in different components are compared across blocks.

MATCHES misses a pair at a similarity of exactly 0.75 about once in 100,000, if no third class
joins it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cuespan.llm.chunks import column_bytes, give_back, ragged, slices
from cuespan.llm.common import components, discard, drop_shuffles, kept_tables, lookup_join, materialize, small_batches

WORDS = 5
#: A link: 100 * intersection >= SHARE * union.
SHARE = 75
#: Coordinates posted. At a similarity of 0.75 a coordinate agrees with that chance: 48 of 64 are due.
COORDINATES = 64
MATCHES = 31
#: Members and shingles of a block of a list at most, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Pairs counted at a time, and candidates from which all intersections of a group are counted together.
PAIRS, MANY = 1 << 16, 512
SLICE = 1 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    x = (x ^ (x >> np.uint64(29))) * M1
    return x ^ (x >> np.uint64(32))


#: Odd base of the polynomial word hash and its inverse modulo 2^64.
BASE = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every row's word shingles, row after row, and the rows' offsets into them.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; a row of fewer
    than WORDS words has its whole sequence as one shingle, a row without words has none.
    """
    n = len(data)
    data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    start = ~blank
    start[1:] &= blank[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    start[heads] |= ~blank[heads]
    stop = ~blank
    stop[:-1] &= blank[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    stop[tails] |= ~blank[tails]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    words = mix64((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64) * M1)
    first = np.searchsorted(starts, offsets)  # each row's first word
    count = np.diff(first)
    shingles = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    at = ragged(first[:-1], shingles)
    length = np.repeat(np.minimum(count, WORDS), shingles)
    out = np.full(len(at), np.uint64(0x51ED270B))
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        out = np.where(k < length, mix64((out ^ padded[at + k]) * M1 + np.uint64(k)), out)
    return mix64(out + length.astype(np.uint64)), np.concatenate([[0], np.cumsum(shingles)])


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's different hashes in ascending order."""
    rows = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return (np.concatenate(rows) if rows else hashes), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def signature_keys(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def signatures(hashes: np.ndarray, bounds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """[row, coordinate] 32-bit minima; rows without shingles hold the largest value."""
    out = np.full((len(bounds) - 1, len(keys)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for i, key in enumerate(keys):
            value = hashes * key
            value = ((value ^ (value >> np.uint64(32))) * M2) >> np.uint64(32)
            out[full, i] = np.minimum.reduceat(value, bounds[full])
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, signature): set_id is 128 bits that tell shingle sets apart."""
    keys = signature_keys(seed)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, bounds = distinct(*shingle_hashes(*column_bytes(part.column("text"))))
                sig = signatures(hashes, bounds, keys)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(bounds)), set_ids(hashes, bounds),
                    pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * COORDINATES), pa.array(sig.astype(np.int32).ravel())),
                ], ["doc_id", "n_shingles", "set_id", "signature"])
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, signature array<int>")


def set_ids(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Two sums of the hashes of each row's set, as 16 bytes."""
    ids = np.zeros((len(bounds) - 1, 2), np.uint64)
    rows = np.repeat(np.arange(len(ids)), np.diff(bounds))
    np.add.at(ids[:, 0], rows, hashes)
    np.add.at(ids[:, 1], rows, mix64(hashes + M1))
    at = np.arange(len(ids) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(ids)])


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, mask, signature, hashes) of (node, mask, signature, set_id, text): the different shingle hashes, ascending, as 8-byte numbers.

    A row whose text has another set than set_id says goes.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, bounds = distinct(*shingle_hashes(*column_bytes(part.column("text"))))
                sets = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(hashes)])
                mine = pc.equal(set_ids(hashes, bounds), part.column("set_id"))
                along = ["node", "mask", "signature"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in along], sets], [*along, "hashes"]).filter(mine)
        give_back()

    return docs.mapInArrow(run, "node long, mask long, signature array<int>, hashes binary")


def overlaps(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[row, row] sizes of the intersections of sets: frequent values by matrix products, the others pair by pair."""
    m = len(bounds) - 1
    _, code, count = np.unique(hashes, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), np.diff(bounds))
    out = np.zeros((m, m), np.float32)
    often = count > max(1, m // 8)
    column = np.cumsum(often) - 1
    at, col = row[often[code]], column[code[often[code]]]
    for lo in range(0, int(often.sum()), 4096):
        here = (col >= lo) & (col < lo + 4096)
        table = np.zeros((m, 4096), np.float32)
        table[at[here], col[here] - lo] = 1
        out += table @ table.T
    rare = ((count > 1) & ~often)[code]
    order = np.argsort(code[rare], kind="stable")
    row, code = row[rare][order], code[rare][order]
    behind = np.searchsorted(code, code, "right") - np.arange(len(code)) - 1  # rows with the same value that follow
    pair = np.zeros(m * m, np.int64)
    cut = np.searchsorted(np.cumsum(behind), np.arange(0, int(behind.sum()) + 1, 1 << 21))
    for lo, hi in zip(cut, np.append(cut[1:], len(code))):
        n = behind[lo:hi]
        pair += np.bincount(np.repeat(row[lo:hi], n) * m + row[ragged(np.arange(lo, hi) + 1, n)], minlength=m * m)
    pair = pair.reshape(m, m)
    return out.astype(np.int64) + pair + pair.T


class Comparison:
    """Links between the members of groups: collisions are counted, then the full sets are compared.

    A pair is counted in the first list of both members' prefixes only (it skips all later ones), and
    only while its members are in different components.
    """

    def __init__(self, table: pa.Table):
        number = lambda c: table.column(c).to_numpy()
        self.node, self.size, self.home = number("node"), number("size"), number("home")
        self.list, self.side = number("list"), number("side")
        self.group = np.cumsum(np.concatenate([[0], (np.diff(self.list) != 0) | (np.diff(number("x")) != 0) | (np.diff(number("y")) != 0)]).astype(np.int64))
        self.mask = number("mask").astype(np.int64).view(np.uint64)
        self.signature = table.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        data, offsets = column_bytes(table.column("hashes"))
        self.hashes, self.bounds = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
        _, self.part = np.unique(number("component"), return_inverse=True)
        self.up = np.arange(int(self.part.max(initial=-1)) + 1)

    def roots(self) -> None:
        while (self.up != (up := self.up[self.up])).any():
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Puts the components of linked rows together."""
        x, y = self.up[self.part[a]], self.up[self.part[b]]
        while (x != y).any():
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
            self.roots()
            x, y = self.up[self.part[a]], self.up[self.part[b]]

    def candidates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        keep = (self.up[self.part[a]] != self.up[self.part[b]]) & (100 * small >= SHARE * large) & ((self.home[a] < 0) | (self.home[a] != self.home[b]))
        a, b = a[keep], b[keep]
        equal = np.packbits(self.signature[a] == self.signature[b], axis=1, bitorder="little").view(np.uint64).ravel()
        met = equal & self.mask[a] & self.mask[b]
        here = np.uint64(1) << (self.list[a] >> 32).astype(np.uint64)
        keep = (np.bitwise_count(equal) >= MATCHES) & ((met & (~met + np.uint64(1))) == here)
        return a[keep], b[keep]

    def set_of(self, row: int) -> np.ndarray:
        return self.hashes[self.bounds[row] : self.bounds[row + 1]]

    def one_by_one(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            if self.up[self.part[x]] == self.up[self.part[y]]:
                continue
            both = np.concatenate([self.set_of(x), self.set_of(y)])
            n = len(both)
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            if 100 * same >= SHARE * (n - same):
                self.join(np.array([x]), np.array([y]))

    def small_groups(self, starts: np.ndarray, ends: np.ndarray) -> None:
        """All pairs of the groups' rows, in runs of PAIRS."""
        rows = ragged(starts, ends - starts)
        follow = np.repeat(ends, ends - starts) - rows - 1
        cut = np.searchsorted(np.cumsum(follow), np.arange(0, int(follow.sum()) + 1, PAIRS))
        for lo, hi in zip(cut, np.append(cut[1:], len(rows))):
            a, b = np.repeat(rows[lo:hi], follow[lo:hi]), ragged(rows[lo:hi] + 1, follow[lo:hi])
            across = (self.side[a] != self.side[b]) | (self.side[a] < 0)
            self.one_by_one(*self.candidates(a[across], b[across]))

    def large_group(self, lo: int, hi: int) -> None:
        """A few rows against all others, then more at a time; once many pairs are candidates, all intersections are counted together."""
        rows = np.arange(lo, hi)
        ends = [rows, rows] if self.side[lo] < 0 else [rows[self.side[lo:hi] == 0], rows[self.side[lo:hi] == 1]]
        shared, done, step = None, 0, 1
        while done < len(ends[0]):
            mine = ends[0][done : done + step]
            done, step = done + step, min(2 * step, max(1, PAIRS // len(rows)))
            a, b = np.repeat(mine, len(ends[1])), np.tile(ends[1], len(mine))
            ahead = (a < b) | (self.side[a] >= 0)
            a, b = self.candidates(a[ahead], b[ahead])
            if shared is None and len(a) > MANY:
                head, tail = min(len(a), 64), len(a)
                self.one_by_one(a[:head], b[:head])
                a, b = a[head:tail], b[head:tail]
                apart = self.up[self.part[a]] != self.up[self.part[b]]
                a, b = a[apart], b[apart]
                if len(a) > MANY:
                    shared = overlaps(self.hashes[self.bounds[lo] : self.bounds[hi]], self.bounds[lo : hi + 1] - self.bounds[lo])
            if shared is None:
                self.one_by_one(a, b)
            elif len(a):
                same = shared[a - lo, b - lo]
                linked = 100 * same >= SHARE * (self.size[a] + self.size[b] - same)
                self.join(a[linked], b[linked])

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a component that was joined and the smallest one in it, by one node of each."""
        starts = np.flatnonzero(np.diff(self.group, prepend=-1))
        ends = np.append(starts[1:], len(self.group))
        few = ends - starts <= 64
        self.small_groups(starts[few], ends[few])
        for lo, hi in zip(starts[~few].tolist(), ends[~few].tolist()):
            self.large_group(lo, hi)
        some = np.zeros(len(self.up), np.int64)
        some[self.part] = self.node
        self.roots()
        moved = np.flatnonzero(self.up != np.arange(len(self.up)))
        return some[self.up[moved]], some[moved]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables in which rows with equal keys, neighbours in the batches, stay together."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        new = np.ones(batch.num_rows, bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        new[0] = last is not None and bool((key[:, 0] != last).any())
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut or new[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            held = []
        held.append(batch.slice(cut))
        last = key[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def compare_groups(members: DataFrame) -> DataFrame:
    """(a, b) links of groups (list, x, y) of members; all rows of a group are compared, or side 0 with side 1."""

    def run(batches):
        for table in whole_groups(batches, ["list", "x", "y"]):
            a, b = Comparison(table).run()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        give_back()

    dealt = members.repartition("list", "x", "y").sortWithinPartitions("list", "x", "y")
    return dealt.select("list", "x", "y", "side", "home", "node", "component", "size", "mask", "signature", "hashes").mapInArrow(run, "a long, b long")


def blocks_of(n: str, weight: str) -> Column:
    """Blocks of at most about BLOCK members and BLOCK_SHINGLES shingles."""
    return F.expr(f"int(greatest(({n} + {BLOCK - 1}) div {BLOCK}, ({weight} + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES}, 1))")


def across_blocks(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Members of lists of several blocks and components, once for each block that they are to be compared with.

    The largest component of a list needs no comparison with itself: its blocks (x = -1 - block)
    meet those of all other members only, and those meet each other.
    """
    placed = members.where("blocks > 1")
    if placed.isEmpty():
        return None
    placed = materialize(placed.join(labels, "node", "left").select("node", "list", "size", F.col("x").alias("home"), F.coalesce("component", "node").alias("component")))
    parts = placed.groupBy("list", "component").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    lists = parts.groupBy("list").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("weight").alias("weight"),
        F.max(F.struct("n", "component", "weight")).alias("best"),
    ).where("parts > 1")
    lists = lists.select("list", "n", F.col("best.component").alias("largest"), F.expr("n - best.n").alias("n_other"), F.expr("weight - best.weight").alias("w_other"), F.col("best.n").alias("n_best"), F.col("best.weight").alias("w_best"))
    lists = materialize(lists.withColumns({"others": blocks_of("n_other", "w_other"), "bests": blocks_of("n_best", "w_best")}).select("list", "n", "largest", "others", "bests"))
    mixed = lookup_join(placed, lists, "list", "n", "node").where("n is not null")
    other = F.expr("component <> largest")
    mixed = mixed.withColumn("block", F.pmod(F.xxhash64("node"), F.when(other, F.col("others")).otherwise(F.col("bests"))).cast("int"))
    meets = F.expr("if(component <> largest, concat(transform(sequence(1, bests), i -> -i), sequence(0, others - 1)), sequence(0, others - 1))")
    met = mixed.withColumn("met", F.explode(meets)).withColumn("own", F.expr("if(component <> largest, block, -1 - block)"))
    met = met.select("node", "list", "size", "home", "component", F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y"), F.expr("if(own = met, -1, int(own > met))").alias("side"))
    return met.join(sets, "node")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id, class_size.

    class_id is the smallest doc_id with the same shingle set, component_id the smallest reachable
    by links between sets, itself included; kept marks it. Documents without words (null, empty or
    blank texts) have 0 shingles and are linked with nothing, not with each other. Rows that
    repeat an id and text are copies of each other; rows that share an id only are linked by their
    texts, each for itself. A null id is a class member but never a representative; a class of null
    ids alone has null class and component. An empty table gives no rows; other columns are not read.
    """
    rows = materialize(sketch(docs, id_col, text_col, seed))
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("set_id").agg(F.min("doc_id").alias("low"), F.count("*").alias("class_size"), F.any_value("signature").alias("signature"), F.any_value("n_shingles").alias("size"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))

    # Posting lists of two classes or more, and each class's rarest lists that a partner must share one of.
    posts = classes.select("node", F.posexplode("signature").alias("i", "v")).select("node", F.expr("shiftleft(cast(i as bigint), 32) | (cast(v as bigint) & 4294967295)").alias("list"))
    lists = materialize(posts.groupBy("list").agg(F.count("*").alias("df")).where("df > 1"))
    shared = lookup_join(posts, lists, "list", "df", "node").where("df is not null")
    own = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "list"))).alias("lists"))  # COORDINATES at most
    own = own.where(F.size("lists") >= MATCHES).select("node", F.expr(f"transform(slice(lists, 1, size(lists) - {MATCHES - 1}), x -> x.list)").alias("lists"))
    bits = F.expr("aggregate(lists, 0L, (m, x) -> m | shiftleft(1L, int(shiftright(x, 32))))")
    own = materialize(own.join(classes.select("node", "size", "set_id", "low", "signature"), "node").withColumn("mask", bits))
    discard(lists)

    # A list with the same members as another tells nothing more; the first stays.
    prefix = own.select("node", "size", F.explode("lists").alias("list"))
    kept = prefix.groupBy("list").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")).where("n > 1")
    kept = kept.groupBy("n", "h1", "h2").agg(F.min("list").alias("list"), F.any_value("weight").alias("weight"))
    kept = materialize(kept.select("list", "n", blocks_of("n", "weight").alias("blocks")))
    members = lookup_join(prefix, kept, "list", "n", "node").where("n is not null")
    members = materialize(members.withColumn("x", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    discard(kept)

    texts = docs.select(F.col(id_col).cast("bigint").alias("low"), F.col(text_col).cast("string").alias("text"))
    wanted = own.join(members.select("node").distinct(), "node", "left_semi").select("low", "node", "set_id", "mask", "signature")
    sets = shingle_sets(texts.join(wanted, "low").select("node", "mask", "signature", "set_id", "text"))
    if not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").isEmpty():
        sets = sets.dropDuplicates(["node"])  # sets are shuffled only where rows share an id
    sets = materialize(sets)
    discard(own)
    drop_shuffles(docs.sparkSession)

    within = members.select("node", "list", "size", F.lit(-1).alias("home"), F.col("node").alias("component"), "x", F.col("x").alias("y"), F.lit(-1).alias("side"))
    links = materialize(compare_groups(within.join(sets, "node")))
    labels = components(links)
    placed: list[DataFrame] = []
    with kept_tables(placed):
        across = across_blocks(members, labels, sets)
    if across is not None:
        more = materialize(compare_groups(across))
        discard(labels)
        labels = components(links.union(more))
        discard(more)
    discard(links, members, sets, *placed)

    # Components by their smallest doc_id.
    found = labels.join(classes.select("node", "low"), "node").select("node", "component", "low")
    lowest = materialize(found.groupBy("component").agg(F.count("*").alias("n"), F.min("low").alias("component_id")))
    found = lookup_join(found, lowest, "component", "n", "node").select("node", "component_id")
    marked = classes.join(found, "node", "left").select("set_id", "class_size", F.col("low").alias("class_id"), F.coalesce("component_id", "low").alias("component_id"))
    marked = materialize(marked)
    discard(classes, labels, lowest)
    drop_shuffles(docs.sparkSession)
    out = lookup_join(rows, marked, "set_id", "class_size", "doc_id")
    alone = F.col("n_shingles") == 0
    out = out.withColumn("class_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")))
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id", F.when(alone, F.lit(1)).otherwise(F.col("class_size")).alias("class_size"))
