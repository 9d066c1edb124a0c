"""Embedding whitening by LOBPCG: the leading eigenvectors of a covariance that is never formed.

Each step multiplies the covariance by a block of directions in one pass: every task multiplies its centred rows by the
block and adds up the products, whose size depends on the dimension alone. The driver does the Rayleigh-Ritz step on the span
of the iterate, its residuals and the directions of the step before. The result counts only if the residuals of a fresh product
certify it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.common import partitions, ship_package, written

SCALE, SHIFT = 64, 1_000_000
#: Directions beyond those asked for, which hasten the last of them; most steps; residuals against the largest eigenvalue: what is
#: aimed at, and what counts if rounding allows no less; eigenvalues below that share of the largest count as zero.
GUARD, MOST_STEPS, AIM, CERTIFIED, ZERO = 8, 200, 1e-13, 1e-9, 1e-12
#: Vectors that a task holds at once.
ROWS = 4096
DEVIATION = T.DecimalType(38, 0)


class NotCertified(RuntimeError):
    """The residuals did not reach what certifies the eigenvectors."""


@dataclass(frozen=True)
class Fit:
    """What the fit list says: n vectors with sums by dimension (of x less SHIFT), eigenvalues, eigenvectors as columns, trace and residuals."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray


def integers(vectors: DataFrame, keep: tuple[str, ...], embedding: str) -> DataFrame:
    """The columns ``keep`` and x, an array of long: floor(SCALE * entry), SHIFT left out (it cancels in all that follows). Vectors that are
    null, empty or hold null or non-finite entries are left out, and so are those of another length than most (the least such)."""
    named = vectors.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keep)), F.col(embedding).cast("array<double>").alias("_v"))
    sound = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = named.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & sound)
    return written(rows.select(*(f"_{i}" for i in range(len(keep))), F.transform("_v", lambda c: F.floor(c * SCALE).cast("long")).alias("x")))


def usual_length(rows: DataFrame) -> int:
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return sizes["d"] if sizes else 0


def matrices(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            column = batch.slice(i, ROWS).column(at)
            yield column.flatten().to_numpy().reshape(len(column), -1)


def sums_of(rows: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Number of rows, sums by dimension and the sum of all squares, exact: each task's own, then added up by dimension."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, [0] * d, [0] * d
        for x in matrices(batches):
            small = max(abs(int(x.max())), abs(int(x.min()))) ** 2 * len(x) < 1 << 62
            y = x if small else x.astype(object)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, y.sum(axis=0), strict=True)]
            squares = [a + int(b) for a, b in zip(squares, (y * y).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d)), pa.array([n] * d), pa.array(list(map(str, total))), pa.array(list(map(str, squares)))], names=["i", "n", "s", "q"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            for i, n, s, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, t, r = at.get(i, (0, 0, 0))
                at[i] = m + n, t + int(s), r + int(q)
        columns = [list(at), *([f(v[k]) for v in at.values()] for k, f in enumerate((int, str, str)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["i", "n", "s", "q"])

    schema = "i long, n long, s string, q string"
    parts = rows.select("x").mapInArrow(own, schema).repartition(partitions(rows.sparkSession), "i")
    by = sorted(parts.mapInArrow(together, schema).collect(), key=lambda r: r["i"])
    return by[0]["n"], [int(r["s"]) for r in by], sum(int(r["q"]) for r in by)


def summed(rows: DataFrame, compute: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum of compute(x) over all rows, matrices of ``height`` x ``width``: each task adds up its own, then the rows of these are
    added up by their number, in order of the tasks, so that reruns agree."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for x in matrices(batches):
            total += compute(x)
        task = np.full(height, TaskContext.get().partitionId())
        ends = pa.array(np.arange(0, height * width + 1, width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height)), pa.array(task), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], names=["i", "task", "v"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, width), strict=True):
                at[i] = at[i] + v if i in at else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([v.tolist() for v in at.values()], pa.list_(pa.float64()))], names=["i", "v"])

    parts = rows.select("x").mapInArrow(own, "i long, task long, v array<double>")
    parts = parts.repartition(partitions(rows.sparkSession), "i").sortWithinPartitions("i", "task").select("i", "v")
    out = np.zeros((height, width))
    for r in parts.mapInArrow(together, "i long, v array<double>").collect():
        out[r["i"]] = r["v"]
    return out


def covariance_times(rows: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """W -> V W for the covariance V of the rows, by one pass over them."""

    def times(block: np.ndarray) -> np.ndarray:
        def compute(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return summed(rows, compute, *block.shape) / n

    return times


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``block`` add to the span of ``against`` (orthonormal); nearly dependent ones go."""
    for _ in range(3):
        block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * s[0]]
    room = against.shape[0] - against.shape[1]
    return block[:, :room]


def lobpcg(times: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, norms of residuals) of the ``k`` largest eigenvalues, falling, of a symmetric matrix that is only
    known by its products. Stops once residuals reach AIM, or have reached CERTIFIED and don't get smaller; raises NotCertified
    if they don't get there. The residuals are those of a fresh product."""
    width = min(d, k + GUARD)
    x = np.linalg.qr(np.random.default_rng(7).standard_normal((d, width)))[0]
    ax, before = times(x), np.zeros((d, 0))
    best, idle = np.inf, 0
    for _ in range(MOST_STEPS):
        e, c = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        x, ax, e = x @ c[:, ::-1], ax @ c[:, ::-1], e[::-1]
        residual = ax - x * e
        worst = np.linalg.norm(residual[:, :k], axis=0).max() / max(abs(e[0]), np.finfo(float).tiny)
        idle = 0 if worst < best / 2 else idle + 1
        best = min(best, worst)
        if worst <= AIM or (best <= CERTIFIED and idle >= 2):
            x = np.linalg.qr(x)[0]
            ax = times(x)
            e, c = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
            x, ax, e = x @ c[:, ::-1], ax @ c[:, ::-1], e[::-1]
            sizes = np.linalg.norm(ax - x * e, axis=0)[:k]
            if sizes.max() <= CERTIFIED * max(e[0], 0.0):
                return e[:k], x[:, :k], sizes
            before = np.zeros((d, 0))
            residual = ax - x * e
        more = orthonormal(np.hstack([residual, before]), x)
        if not more.shape[1]:
            more = orthonormal(np.random.default_rng(11).standard_normal((d, width)), x)
        if not more.shape[1]:  # the block spans the whole space: the Ritz vectors are exact up to rounding
            sizes = np.linalg.norm(residual, axis=0)[:k]
            if sizes.max() <= CERTIFIED * max(e[0], 0.0):
                return e[:k], x[:, :k], sizes
            break
        amore = times(more)
        basis, abasis = np.hstack([x, more]), np.hstack([ax, amore])
        _, c = np.linalg.eigh((basis.T @ abasis + abasis.T @ basis) / 2)
        c = c[:, ::-1][:, :width]
        old = x.shape[1]
        x, ax, before = basis @ c, abasis @ c, more @ c[old:]
    raise NotCertified(f"residuals reached {best:.1e} of the largest eigenvalue, not {CERTIFIED:.0e}")


def fit(rows: DataFrame, components: int = 32) -> Fit | None:
    """Fits rows of integers(), all of one length; None if no direction has a variance."""
    ship_package(rows.sparkSession)
    d = usual_length(rows)
    n, sums, squares = sums_of(rows, d) if d else (0, [], 0)
    trace = Fraction(squares * n - sum(s * s for s in sums), n * n) if n else Fraction(0)
    if not trace:
        return None
    mean = np.array([float(Fraction(s, n)) for s in sums])
    values, vectors, residuals = lobpcg(covariance_times(rows, mean, n), d, min(components, d))
    sound = values > ZERO * values[0]
    return Fit(n, tuple(sums), values[sound], vectors[:, sound], float(trace), residuals[sound])


def identity_error(rows: DataFrame, found: Fit) -> float:
    """The largest entry, in absolute value, of the covariance of the whitened rows less the identity, by a pass over them."""
    mean, k = np.array([float(Fraction(s, found.n)) for s in found.sums]), len(found.values)
    by = found.vectors / np.sqrt(found.values)
    centre = summed(rows, lambda x: ((x - mean) @ by).sum(axis=0, keepdims=True), 1, k)[0] / found.n

    def compute(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ by - centre
        return z.T @ z

    return float(np.abs(summed(rows, compute, k, k) / found.n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 32, keep: tuple[str, ...] = ("vec_id",), embedding: str = "embedding") -> DataFrame:
    """For each sound vector and each component: the columns ``keep``, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty or hold null or non-finite entries are dropped, and those of another length than most vectors have.
    All others are fitted on and whitened, repeated rows as often as they come. There are as many components as there are
    directions with a variance, ``components`` at most: none for an empty table, a single vector or equal vectors.
    deviation is decimal(38,0), exact, and null where it doesn't fit. Other columns, whatever their names, have no influence.
    """
    rows = integers(vectors, keep, embedding)
    d = usual_length(rows)
    rows = rows.where(F.size("x") == d)
    found = fit(rows, components)
    own = T.StructType([T.StructField(f"_{i}", vectors.schema[k].dataType) for i, k in enumerate(keep)])
    outer = T.StructType([*own, *T.StructType.fromDDL("deviation string, whitened array<double>")])
    if found is None:
        empty = rows.where("false").select(*own.names, F.lit(None).cast("string").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return _by_component(empty, keep, 0, [], 0.0)
    error = identity_error(rows, found)
    n, sums = found.n, found.sums
    mean, by = np.array([float(Fraction(s, n)) for s in sums]), found.vectors / np.sqrt(found.values)
    flat = np.array(sums, dtype=object)

    def deviations(x: np.ndarray) -> list[str]:
        most = float(np.abs(x - mean).max()) * n
        if most * most * d < 2.0**62 and most < 2.0**61 and max(map(abs, sums)) < 1 << 62 and float(np.abs(x).max()) * n < 2.0**62:
            away = n * x - flat.astype(np.int64)
            return [str(v) for v in (away * away).sum(axis=1).tolist()]
        away = n * x.astype(object) - flat
        return [str(v) for v in (away * away).sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = next(matrices(iter([part]), len(keep)))
                z = (x - mean) @ by
                ends = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(deviations(x)), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=outer.names)

    return _by_component(rows.select(*own.names, "x").mapInArrow(run, outer), keep, n, (found.values / found.trace).tolist(), error)


def _by_component(rows: DataFrame, keep: tuple[str, ...], n: int, explained: list[float], error: float) -> DataFrame:
    share = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    rows = rows.select(*(f"_{i}" for i in range(len(keep))), "deviation", F.posexplode("whitened").alias("c", "whitened"))
    return rows.select(
        *(F.col(f"_{i}").alias(k) for i, k in enumerate(keep)), (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast(DEVIATION).alias("deviation"),
        "whitened", F.get(share, F.col("c")).alias("explained"), F.lit(error).alias("identity_error"),
    )
