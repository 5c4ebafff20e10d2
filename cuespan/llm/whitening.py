"""Whitening of embeddings by their leading principal components, found by FEAST contour integration.

Sums and the covariance are gathered in two passes over all vectors, a small matrix per task. Its
spectrum is then cut into intervals: counts of eigenvalues below a shift, by the inertia of an
LDL' factorisation, narrow the intervals down until each holds a few. For an interval, quadrature
nodes on a circle around it give complex shifted solves, which together project a block of random
vectors onto the interval's eigenvectors; Rayleigh-Ritz extracts the pairs. An interval is done
when as many pairs lie in it as the inertia counted. Shifts, and intervals, are rows that Spark
deals to tasks; a last pass projects all vectors on the components, another measures how far the
result is from white.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

COMPONENTS = 32
#: Each entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: A covariance of more dimensions is refused: each task and the driver hold one.
MOST_DIMENSIONS = 2048
#: Components whose variance is at most this share of the largest are rounding errors.
LEAST_VARIANCE = 1e-10
#: Eigenvalues of an interval at most, if they can be told apart; shifts of a round; narrowest interval by the largest eigenvalue.
FEW, SHIFTS, NARROW = 8, 64, 1e-8
#: Quadrature nodes on a half circle, passes at most, and the residual by the largest eigenvalue at which an interval is done.
NODES, PASSES, RESIDUAL = 8, 12, 1e-14
#: Vectors worked on at a time.
ROWS = 2048
#: Numbers up to here are whole in double precision.
WHOLE = 1 << 52


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of (vec_id, vector): x = floor(SCALE * c) + SHIFT.

    Vectors that are null, empty, or hold null, non-finite or over-large entries (above WHOLE) go; so do
    those of another length than most have, the shorter one on a tie.
    """
    fine = F.expr(f"forall(vector, c -> c is not null and not isnan(c) and abs(c) < {WHOLE // (2 * SCALE)}d) and size(vector) > 0")
    rows = rows.where(F.col("vector").isNotNull() & fine)
    size = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return rows.select("vec_id", F.expr("cast(array() as array<bigint>)").alias("x"))
    if size["d"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors have over {MOST_DIMENSIONS} dimensions")
    return rows.where(F.size("vector") == size["d"]).select("vec_id", F.expr(f"transform(vector, c -> floor({SCALE} * c) + {SHIFT}L)").alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension of x, exact."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                part = [int(v) for v in x.sum(axis=0, dtype=np.int64)] if abs(x).max() < 1 << 40 else [sum(int(v) for v in c) for c in x.T]
                n, total = n + len(x), part if total is None else [a + b for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[Decimal(v) for v in total]], pa.list_(pa.decimal128(38, 0)))], ["n", "s"])

    parts = rows.select("x").mapInArrow(run, "n long, s array<decimal(38,0)>")
    sums = parts.select("n", F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("s")).orderBy("i").collect()
    return (sums[0]["n"], [int(r["s"]) for r in sums]) if sums else (0, [])


def gram(rows: DataFrame, width: int, centred: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of y'y over all rows y that `centred` makes of a batch, followed by the sum of y: [width + 1, width]."""

    def run(batches):
        total = np.zeros((width + 1, width))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = centred(batch.slice(at, ROWS))
                total[:width] += y.T @ y
                total[width] += y.sum(axis=0)
        at = np.arange(width + 2, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.ListArray.from_arrays(pa.array(at), pa.array(total.ravel()))], ["i", "v"])

    parts = rows.mapInArrow(run, "i long, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    sums = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # a matrix of the vectors' width
    out = np.zeros((width + 1, width))
    out[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    return out


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of x with divisor n. Entries lose their mean before they are multiplied.

    They lose its whole part first, so that products are whole numbers and their sums do not depend
    on the order; what is left of the mean is below one half and is taken off in the end.
    """
    whole = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - n * int(w)) / n for s, w in zip(sums, whole)])
    total = gram(rows.select("x"), len(sums), lambda batch: (matrix(batch.column("x")) - whole).astype(np.float64))
    out = total[:-1] / n - np.outer(rest, rest)
    return (out + out.T) / 2


def negative_pivots(a: np.ndarray) -> tuple[int, float]:
    """Negative eigenvalues of a symmetric matrix: those of D in its LDL' factorisation, whose pivots have one or two rows.

    The smallest pivot in absolute value comes second.
    """
    a, n, k, count, least = a.copy(), len(a), 0, 0, np.inf
    while k < n:
        rest = abs(a[k:, k:])
        best, (i, j) = int(rest.diagonal().argmax()), divmod(int(rest.argmax()), n - k)
        order = [best] if rest[best, best] >= 0.64 * rest[i, j] else sorted((i, j))
        for at, row in enumerate(order, k):  # ascending, so no swap moves the next one
            a[[at, row + k]] = a[[row + k, at]]
            a[:, [at, row + k]] = a[:, [row + k, at]]
        end = k + len(order)
        pivot, side = a[k:end, k:end], a[end:, k:end]
        values = np.linalg.eigvalsh(pivot)
        count, least = count + int((values < 0).sum()), min(least, float(abs(values).min()))
        if least == 0:
            break
        a[end:, end:] -= side @ np.linalg.solve(pivot, side.T)
        k = end
    return count, least


def below(spark: SparkSession, v, dims: int, top: float, shifts: list[float]) -> list[tuple[float, int]]:
    """For each shift how many eigenvalues are smaller. A shift that meets an eigenvalue is moved a little."""

    def run(batches):
        for batch in batches:
            at, counts = batch.column("shift").to_pylist(), []
            for k in range(len(at)):
                count, least = negative_pivots(v.value - at[k] * np.eye(dims))
                while least < 1e-13 * top:
                    at[k] += 0.618e-11 * top
                    count, least = negative_pivots(v.value - at[k] * np.eye(dims))
                counts.append(count)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(at, pa.float64()), pa.array(counts, pa.int64())], ["k", "shift", "n"])

    rows = spark.createDataFrame(list(enumerate(shifts)), "k int, shift double").repartition(min(len(shifts), 16), "k")
    return [(r["shift"], r["n"]) for r in sorted(rows.mapInArrow(run, "k int, shift double, n long").collect())]


def cut_spectrum(spark: SparkSession, v, dims: int, top: float, components: int) -> list[tuple[float, float, int]]:
    """Disjoint intervals (low, high, eigenvalues within), highest first, that hold the `components` largest eigenvalues.

    Intervals of more than FEW are cut again, unless they are too narrow: then their eigenvalues are one cluster.
    """
    parts = [(-1e-6 * top, top * (1 + 1e-6), dims)]
    while True:
        above = np.cumsum([0] + [p[2] for p in parts])
        parts = [p for p, n in zip(parts, above) if n < components]
        wide = [p for p in parts if p[2] > FEW and p[1] - p[0] > NARROW * top][: SHIFTS // 2]
        if not wide:
            return parts
        cuts = [np.linspace(low, high, SHIFTS // len(wide) + 2).tolist() for low, high, _ in wide]
        counts = below(spark, v, dims, top, [s for c in cuts for s in c])
        parts = [p for p in parts if p not in wide]
        for c in cuts:
            mine, counts = counts[: len(c)], counts[len(c) :]
            parts += [(low, high, b - a) for (low, a), (high, b) in zip(mine, mine[1:]) if b > a]
        parts.sort(reverse=True)


def feast(v: np.ndarray, low: float, high: float, count: int, top: float, seed: int = 42) -> np.ndarray:
    """The `count` unit eigenvectors of v in (low, high), as rows: the number is known from the inertia."""
    dims = len(v)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angle = -np.pi / 2 * (nodes - 1)
    mid, half = (low + high) / 2, (high - low) / 2
    size, rng = min(dims, count + count // 2 + 2), np.random.default_rng(seed)
    while True:
        y = rng.normal(size=(dims, size))
        for _ in range(PASSES):
            if size < dims:
                q = np.zeros((dims, size))
                for t, w in zip(angle, weights):
                    turn = half * np.exp(1j * t)
                    q += w / 2 * np.real(turn * np.linalg.solve((mid + turn) * np.eye(dims) - v, y))
            else:
                q = y  # the whole space needs no projection
            q, _ = np.linalg.qr(q)
            value, turn = np.linalg.eigh(q.T @ v @ q)
            y = q @ turn
            inside = (value > low) & (value < high)
            found = y[:, inside]
            residual = np.abs(v @ found - found * value[inside]).max(initial=0)
            if inside.sum() == count and residual <= RESIDUAL * top * dims:
                return found.T
        if size == dims:
            raise ArithmeticError(f"{int(inside.sum())} eigenvalues found in an interval of {count}")
        size = min(dims, 2 * size)


def leading_components(spark: SparkSession, whole: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, as rows, of the `components` largest above LEAST_VARIANCE of the largest.

    The sign of an eigenvector is such that its largest entry is positive.
    """
    dims = len(whole)
    top = float(np.abs(whole).sum(axis=1).max())  # no eigenvalue is larger
    if not top > 0:
        return np.zeros(0), np.zeros((0, dims))
    v = spark.sparkContext.broadcast(whole)  # MOST_DIMENSIONS squared at most
    parts = cut_spectrum(spark, v, dims, top, min(components, dims))

    def run(batches):
        for batch in batches:
            for k, low, high, count in zip(*(c.to_pylist() for c in batch.columns)):
                found = feast(v.value, low, high, count, top)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k] * count, pa.int32()), "vector": pa.array(found.tolist(), pa.list_(pa.float64()))})

    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(parts)], "k int, low double, high double, count int")
    found = rows.repartition(len(parts), "k").mapInArrow(run, "k int, vector array<double>").collect()
    # Intervals know nothing of each other: one more Rayleigh-Ritz step over all makes their vectors orthogonal.
    q, _ = np.linalg.qr(np.array([r["vector"] for r in sorted(found)]).T)
    value, turn = np.linalg.eigh(q.T @ whole @ q)
    value, vectors = value[::-1][:components], (q @ turn).T[::-1][:components]
    keep = value > LEAST_VARIANCE * value[0]
    value, vectors = value[keep], vectors[keep]
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return value, vectors * sign[:, None]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue.

    x are the vectors' entries as whole numbers, V their covariance over all of them, with divisor n.
    `component` counts V's eigenvectors from 1 by falling eigenvalue; `whitened` is x without its
    mean, projected on the component, over the root of the eigenvalue; `deviation` the sum over
    dimensions of (n * x - sum)^2, exact, null where it is too large for a long; `explained` the
    eigenvalue's share of V's trace; `identity_error` the largest entry of the covariance of `whitened`
    minus the identity, measured on the rows given back.

    Vectors that are null, empty or hold null, non-finite or over-large entries (above 2^45) are
    left out, as are those of another length than most vectors have (the shorter of two as frequent).
    Components of no variance (at most 1e-10 of the largest) have no row: there are fewer
    when vectors have fewer dimensions, are few, or agree; equal vectors alone, one vector or an
    empty table give no rows. Ids may be null or repeat: each row stands for itself. Equal eigenvalues
    leave the choice of their components open; it is the same for all rows. Other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    n, sums = column_sums(rows)
    if n == 0:
        return spark.createDataFrame([], schema)
    v = covariance(rows, n, sums)
    value, vectors = leading_components(spark, v, components)
    k = len(value)
    if k == 0:
        return spark.createDataFrame([], schema)
    whole = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = [s - n * int(w) for s, w in zip(sums, whole)]
    mean = np.array([r / n for r in rest])
    scaled = vectors / np.sqrt(value)[:, None]
    plan = spark.sparkContext.broadcast((whole, rest, mean, scaled))  # components by dimensions

    def project(batch: pa.RecordBatch) -> np.ndarray:
        whole, _, mean, scaled = plan.value
        return ((matrix(batch.column("x")) - whole) - mean) @ scaled.T

    total = gram(rows.select("x"), k, project)
    centre = total[-1] / n
    error = float(np.abs(total[:-1] / n - np.outer(centre, centre) - np.eye(k)).max())
    explained = value / np.trace(v)

    def deviations(x: np.ndarray) -> pa.Array:
        whole, rest, *_ = plan.value
        y = x - whole
        far = n * (int(np.abs(y).max(initial=0)) + 1)
        if far * far * len(rest) < 1 << 63:
            return pa.array(((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1))
        exact = [sum((n * int(c) - r) ** 2 for c, r in zip(row, rest)) for row in y]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m, every = part.num_rows, np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    deviations(matrix(part.column("x"))).take(pa.array(every)), pa.array(project(part).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)), pa.array(np.tile(value, m)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    return rows.mapInArrow(run, schema)
