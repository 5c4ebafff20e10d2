"""The trie of conversations, repeated word windows and whitening against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespan.llm import whitening
from cuespan.llm.conversation_trie import conversation_trie, joined_hashes, running_totals, subtree_totals
from cuespan.llm.doubling_dedup import levels, repeated_windows

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members = {}
    for c, v in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 9, abs(c) % 5 * (1 if c >= 0 else -1)
        rebuilt = own.get(c - rest, [])[:h] + v[h:]
        for d in range(len(rebuilt) + 1):
            members.setdefault(tuple(rebuilt[:d]), []).append((c, d == len(rebuilt)))
    kids, leaves, saved, out = {}, {}, {}, []
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c, last in m if last)))
        parent = min(members[k[:-1]])[0] if k else None
        out.append((min(m)[0], len(k), parent, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_conversation_trie(spark):
    rng = random.Random(5)
    rows = [(c, t if t else None, rng.choice(["u", "a", None]), rng.choice(["x", "yé", None, "", "long " * 5000])) for c in [*range(-12, 60), None] for t in range(rng.randint(0, 12))]
    rows += rows[:9] + [(100, 3, "u", "only the second turn on")] * 3  # repeated rows, and a family without its first conversation
    df = spark.createDataFrame(rows, TURNS)
    for c in ("node", "parent", "at", "order", "_range", "bytes", "head", "n"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted(map(tuple, conversation_trie(df).collect()), key=str) == plain_trie(rows)
    assert conversation_trie(df.where("false")).count() == conversation_trie(df.where("conv_id is null")).count() == 0


def test_hot_first_turn_and_chain(spark):
    rows = [(10 + 5 * i, 0, "u", "same") for i in range(400)] + [(5, i, "u", f"t{i}") for i in range(60)] + [(6, i, "u", f"t{i}") for i in range(45)]
    assert sorted(map(tuple, conversation_trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == plain_trie(rows)


def test_subtree_totals(spark):
    rng = random.Random(3)
    parent = {0: None, 1: 0}
    for i in range(2, 400):  # a star, a chain and twigs
        parent[i] = 1 if i < 150 else i - 1 if i < 250 else rng.randrange(i)
    parent[1000] = None  # a tree of one node
    total = {i: i % 7 for i in parent}
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    df = spark.createDataFrame([(i, p, i % 7) for i, p in parent.items()], "node bigint, parent bigint, v bigint")
    assert dict(map(tuple, subtree_totals(df, ["v"]).collect())) == total
    assert subtree_totals(df.where("false"), ["v"]).count() == 0


def test_running_totals_of_one_large_part(spark):
    df = spark.range(20000).selectExpr("if(id < 15000, 1, id % 50) as p", "id", "id % 11 as v").repartition(16)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.v for r in running_totals(df, "p", ["id"], ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    sums = {}
    for i in range(20000):
        p = 1 if i < 15000 else i % 50
        sums[p] = sums.get(p, 0) + i % 11
        assert got[i] == sums[p]


def test_joined_hashes_of_one_large_node(spark):
    df = spark.range(25000).selectExpr("cast(if(id % 3 = 0, 'a', string(id % 7)) as binary) as node", "id - 5000 as conv_id").repartition(8)
    want = {}
    for i in range(25000):
        want.setdefault(("a" if i % 3 == 0 else str(i % 7)).encode(), []).append(str(i - 5000))
    assert {bytes(r.node): r.ends_sha256 for r in joined_hashes(df).collect()} == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def plain_windows(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    times = {}
    for w in words:
        for i in range(len(w) - length + 1):
            times[tuple(w[i : i + length])] = times.get(tuple(w[i : i + length]), 0) + 1
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if times[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        yield i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), sum(b and not a for a, b in zip([False, *gone], gone))


@pytest.mark.parametrize("length", [1, 3, 20, 35])
def test_repeated_windows(spark, length):
    rng = random.Random(length)
    line = " ".join(f"w{rng.randint(0, 50)}" for _ in range(20))
    rows = [(None, None), (1, ""), (2, " \n\v"), (3, "a " * 100), (4, "x" * (1 << 19) + " " + line), (5, "x" * (1 << 19) + " " + line + "\t" + line)]
    for i in range(6, 60):
        rows.append((i, " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 80))) + " " + (line if i % 3 else "") + ("" if i % 5 else " é ß 日本")))
    rows += [rows[7], (None, rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("file", "bucket", "answers", "keys"):
        df = df.withColumn(c, F.lit("x"))
    got = repeated_windows(df, length, file_bytes=40_000).collect()
    key = lambda r: str(r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(plain_windows(rows, length), key=key)
    assert all((r.longest > 0) == (r.n_removed > 0) for r in got)


def test_repeated_windows_doubles_until_nothing_is_left(spark):
    text = " ".join(f"a{i}" for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, "b " + text[: text.index("a300")]), (3, "c d e")], "doc_id bigint, text string")
    assert {r.doc_id: r.longest for r in repeated_windows(df).collect()} == {1: 280, 2: 280, 3: 0}
    assert repeated_windows(df.where("false")).count() == 0
    steps = levels(35)
    assert [next(steps) for _ in range(6)] == [9, 18, 35, 70, 140, 280]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")


def check_whitening(df, vectors_, ids, components=32):
    x = np.floor(64 * vectors_).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-10 * e[0]).sum()))
    got = whitening.whiten(df, components).toPandas().set_index(["vec_id", "component"]).sort_index()
    assert len(got) == n * k and (got.n == n).all()
    order = np.argsort(ids)
    want, mine = (centred @ u[:, :k] / np.sqrt(e[:k]))[order], got.whitened.to_numpy().reshape(n, k)
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-7
    assert (got.deviation.to_numpy().reshape(n, k) == ((n * x - total) ** 2).sum(axis=1)[order][:, None]).all()
    assert np.allclose(got.explained.to_numpy().reshape(n, k), e[:k] / e.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    p = df.toPandas()
    check_whitening(df, np.stack(p.embedding).astype(np.float64), p.vec_id.to_numpy())
    x = np.random.default_rng(2).normal(size=(9, 12)) * 3
    x[:, 3], x[:, 4] = x[:, 2], 1  # no variance in some directions, and more dimensions than vectors
    check_whitening(vectors(spark, x), x, np.arange(9))
    check_whitening(vectors(spark, x), x, np.arange(9), components=3)


def test_whitening_of_equal_eigenvalues(spark):
    x = np.concatenate([np.eye(40), -np.eye(40)]) * 10
    got = whitening.whiten(vectors(spark, x)).toPandas()
    assert len(got) == 80 * 32 and got.identity_error.max() < 1e-9 and np.allclose(got.explained, 1 / 40)


def test_whitening_of_hard_rows(spark):
    rows = lambda *r: whitening.whiten(spark.createDataFrame(r, "vec_id bigint, embedding array<double>").withColumn("x", F.lit(1)).withColumn("n", F.lit(1))).collect() if r else whitening.whiten(vectors(spark, np.zeros((1, 1))).where("false")).collect()
    assert rows() == rows((1, [1.0, 2.0])) == rows((1, [1.0, 2.0]), (2, [1.0, 2.0])) == []
    assert rows((1, None), (2, []), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0])) == []
    got = rows((1, [1.0]), (2, [3.0]), (None, [2.0]), (2, [3.0]), (3, [1.0, 2.0]), (4, None))  # the vector of two goes
    assert sorted((str(r.vec_id), r.n, r.deviation) for r in got) == [("1", 4, 320**2), ("2", 4, 192**2), ("2", 4, 192**2), ("None", 4, 64**2)]
    assert all(r.deviation is None for r in rows((1, [1e12]), (2, [2e12])))


def test_inertia():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 30):
        for _ in range(20):
            a = rng.normal(size=(n, n))
            a = a + a.T
            if rng.random() < 0.3:
                np.fill_diagonal(a, 0)
            s = rng.normal()
            assert whitening.negative_pivots(a - s * np.eye(n))[0] == (np.linalg.eigvalsh(a) < s).sum()


def test_feast_finds_what_the_inertia_counts():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    value = np.array([*np.linspace(0, 1, 24), 2, 2 + 1e-9, 2 + 2e-9, 3, 4, 5])
    a = q @ np.diag(value) @ q.T
    found = whitening.feast(a, 1.5, 2.5, 3, 5.0)
    assert found.shape == (3, 30) and np.allclose(found @ found.T, np.eye(3)) and np.allclose(a @ found.T, 2 * found.T, atol=1e-8)
    with pytest.raises(ArithmeticError):
        whitening.feast(a, 1.5, 2.5, 4, 5.0)
