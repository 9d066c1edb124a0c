"""Near-duplicate vectors through a product-quantised inverted index.

A coarse k-means deals unit vectors into lists. What is left of a vector after its list's centre, the residual, is cut into
subspaces and coded by the nearest of each subspace's centres. A query visits its own list and each list whose boundary with
its own lies no further off than half of what partners are apart at most: of two partners on both sides of a boundary, one is
so near it, whatever the direction, as their distances from it add up to no more than that between them. Where both are, the
pair counts in the earlier list. In a list, one table of distances from the query's residual to
all subspace centres turns each stored code into a distance by additions alone; with the stored length of the coding
error this bounds the true distance from below, so that no partner in a visited list is lost. What remains is compared
exactly, as cosines in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.cells import cells_of, in_cells, roots, with_group_rows
from codeweft.llm.common import dealt, ship_package, written
from codeweft.llm.links import PARTIAL, linked_classes

#: The index is fitted on about so many vectors at most; every vector is indexed.
FIT_VECTORS = 8192
SUBSPACES, CODES, ITERATIONS = 8, 256, 8
LEAST_LISTS, MOST_LISTS, LIST_ROWS = 64, 1024, 1000
BLOCK_ROWS = 1500
PAIRS_AT_ONCE = 1 << 18


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ITERATIONS):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], len(centres))
            centres[n > 0, d] = total[n > 0] / n[n > 0]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


@dataclass
class Index:
    """Coarse centres, and for each subspace its slice of the dimensions and its centres."""

    coarse: np.ndarray
    parts: list[tuple[int, int, np.ndarray]]
    reach: float

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what the codes leave."""
        codes = np.stack([nearest(residual[:, a:b], c) for a, b, c in self.parts], 1)
        left = sum((((residual[:, a:b] - c[codes[:, m]]) ** 2).sum(1) for m, (a, b, c) in enumerate(self.parts)), np.zeros(len(residual)))
        return codes, np.sqrt(left)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances from each residual to all centres of each subspace."""
        return np.stack([np.pad(((residual[:, None, a:b] - c) ** 2).sum(2), ((0, 0), (0, CODES - len(c)))) for a, b, c in self.parts], 1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each unit vector, and a matrix of the lists that it visits, its own included."""
        d = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        own = d.argmin(1)
        apart = np.sqrt(np.maximum(((self.coarse[:, None] - self.coarse) ** 2).sum(2), 1e-18))
        to_boundary = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart[own])
        return own, to_boundary <= self.reach / 2


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors whose greatest component lies between 1/2 and 1, scaled by powers of two: no digit is lost, and no sum of squares
    overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one table in double precision, the shorter filled up with zeros."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    n = np.asarray(column.value_lengths())
    if (n == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def fit_index(sample: np.ndarray, rows: int, cosine: float) -> Index:
    coarse = k_means(sample, min(MOST_LISTS, max(LEAST_LISTS, rows // LIST_ROWS)), 0)
    residual = sample - coarse[nearest(sample, coarse)]
    width = sample.shape[1]
    ends = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int).tolist()
    parts = [(a, b, k_means(residual[:, a:b], CODES, 1 + m)) for m, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    reach = math.sqrt(2 - 2 * cosine) + 1e-6
    return Index(coarse, parts, reach)


def links_in(t: pa.Table, index: Index, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a cell that link: one of its two blocks with the other, or all within one, at least one at home."""
    width = index.coarse.shape[1]
    vectors = scaled(matrix(t.column("vector").chunk(0), width))
    x = unit(vectors)
    home, side = t.column("home").to_numpy(), t.column("side").to_numpy()
    here = t.column("list")[0].as_py()
    centre = index.coarse[here]
    own = t.column("own").to_numpy()
    seen = np.frombuffer(b"".join(t.column("seen").to_pylist()), np.uint8).reshape(len(own), -1)
    stored = np.flatnonzero(home)
    codes, left = index.code(x[stored] - centre)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, min(256, PAIRS_AT_ONCE // max(len(stored), 1)))
    for at in range(0, len(x), step):
        q = np.arange(at, min(at + step, len(x)))
        table = index.tables(x[q] - centre)
        far = np.zeros((len(q), len(stored)))
        for m in range(len(index.parts)):
            far += table[:, m][:, codes[:, m]]
        i, j = np.nonzero(far <= (index.reach + left) ** 2)
        i, j = q[i], stored[j]
        # a pair within one block comes once: a visitor with a stored row, or the earlier of two stored rows with the later
        ok = (home[i] & (i < j) | ~home[i]) if side[0] < 0 else (side[i] != side[j]) & (~home[i] | (side[i] < side[j]))
        # a pair of two lists each of whose rows visits the other's comes once, in the earlier list
        ok &= home[i] | (own[i] > here) | (seen[j, own[i] // 8] >> (7 - own[i] % 8) & 1 == 0)
        i, j = i[ok], j[ok]
        for k in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
            u, v = vectors[a], vectors[b]
            keep = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v))) >= cosine
            found.append((a[keep], b[keep]))
    return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (np.zeros(0, int),) * 2


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", fit_vectors: int = FIT_VECTORS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have as many components and their cosine is ``cosine`` at least.
    A vector that is null, empty or zero, or has a null or non-finite component, or a null label, links with nothing.
    Equal vectors of a label are one class in the index; each still counts as a link of the others. component_id is the
    smallest vec_id reachable; ids that are null come after all others, and repeated ids are vectors of their own.
    kept is vec_id = component_id, null equalling null. An empty table gives an empty result.
    """
    v = F.col(vector)
    sound = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))) & F.exists(v, lambda c: c != 0)
    usable = F.coalesce(sound, F.lit(False)) & F.col(label).isNotNull()
    key = [F.col(label), v]
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), v.alias("vector"), F.when(usable, F.xxhash64(*key)).alias("k1"), F.when(usable, F.xxhash64(F.lit(7), *key)).alias("k2"))
    classes = written(rows.where("k1 is not null").groupBy("k1", "k2", "label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    alone = rows.where("k1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if size["n"] < 2:
        found = rows.where("k1 is not null").join(classes.select("k1", "k2", "n", F.col("id").alias("component_id")), ["k1", "k2"]).select("id", (F.col("n") - 1).alias("n_links"), "component_id")
    else:
        share = fit_vectors / size["n"]
        sample = classes.where(F.pmod(F.col("k1"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))) if share < 1 else classes
        drawn = pa.array([r["vector"] for r in sample.orderBy("k1", "k2").select("vector").collect()], pa.list_(pa.float64()))
        index = fit_index(unit(matrix(drawn, size["width"])), size["n"], cosine)
        result = linked_classes(classes.select("k1", "k2", "id", "n"), partial_links(classes, index, cosine))
        found = rows.select("id", "k1", "k2").where("k1 is not null").join(dealt(result), ["k1", "k2"]).select("id", "n_links", "component_id")
    out = found.union(alone)
    return out.select(F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def partial_links(classes: DataFrame, index: Index, cosine: float) -> DataFrame:
    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own, to = index.visits(unit(matrix(part.column("vector"), index.coarse.shape[1])))
                row, at_list = np.nonzero(to)
                seen = np.packbits(to, axis=1)
                for k in range(0, len(row), 2048):
                    r, li = row[k : k + 2048], at_list[k : k + 2048]
                    taken = part.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(li.astype(np.int32)), pa.array(li == own[r]), pa.array(own[r].astype(np.int32)), pa.array([x.tobytes() for x in seen[r]], pa.binary())], names=[*taken.schema.names, "list", "home", "own", "seen"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells_of(batches):
            a, b = links_in(cell, index, cosine)
            if not len(a):
                continue
            k1, k2, n = (cell.column(c).to_numpy() for c in ("k1", "k2", "n"))
            links = np.zeros(len(k1), np.int64)
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            root, some = roots(len(k1), a, b), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[some], k2[some], links[some], k1[root[some]], k2[root[some]])], names=["k1", "k2", "links", "r1", "r2"])

    ship_package(classes.sparkSession)
    kind, numbers = (classes.schema[c].dataType.simpleString() for c in ("label", "vector"))
    visiting = classes.select("k1", "k2", "label", "n", F.col("vector")).mapInArrow(visits, f"k1 long, k2 long, label {kind}, n long, vector {numbers}, list int, home boolean, own int, seen binary")
    visiting = written(visiting.withColumn("width", F.size("vector")))
    group = ["label", "width", "list"]
    return written(in_cells(with_group_rows(visiting, group), group, F.col("k1"), BLOCK_ROWS).mapInArrow(compare, PARTIAL))
