"""Whitening of embeddings with components found by contour integration (FEAST).

Sums and the centred covariance come from the rows in blocks, one small matrix
per task. The eigenvalues wanted are cut into intervals by inertia counts: the
number of negative pivots of the shifted matrix is the number of eigenvalues
below the shift. For each interval a quadrature along a circle through its ends
solves complex shifted systems, which projects a random block onto the
interval's eigenvectors; Rayleigh-Ritz extracts them, and the block is projected
again until the residuals are at rounding level. An interval is done only when
it gives as many pairs as the inertia counts say. Intervals are Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.core import local_table
from timberline.llm.common import table

SCALE, SHIFT = 64, 1_000_000  # fixed values: c -> floor(64 c) + 1000000
PER_INTERVAL = 8
NODES = 8
ROUNDS = 30
BINS = 256
EPS = float(np.finfo(float).eps)


# --- eigenpairs of a symmetric matrix ------------------------------------

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and next diagonal of an orthogonally similar matrix, by Householder reflections."""
    a = np.array(v, float)
    for k in range(len(a) - 2):
        u = a[k + 1:, k].copy()
        top = -np.copysign(np.linalg.norm(u), u[0])
        if top == 0:
            continue
        u[0] -= top
        u /= np.linalg.norm(u)
        p = a[k + 1:, k + 1:] @ u
        w = p - (u @ p) * u
        a[k + 1:, k + 1:] -= 2 * (np.outer(u, w) + np.outer(w, u))
        a[k + 1, k] = top
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(diagonal: np.ndarray, beside: np.ndarray, x: float) -> int:
    """Inertia: how many eigenvalues lie below ``x``, from the signs of the pivots of the shifted matrix."""
    least = EPS * EPS * max(1.0, float(np.max(beside * beside, initial=0.0)))
    count, pivot = 0, 1.0
    for d, e in zip(diagonal - x, np.concatenate([[0.0], beside * beside])):
        pivot = d - e / pivot
        if abs(pivot) < least:
            pivot = -least
        count += pivot < 0
    return count


def intervals(v: np.ndarray, wanted: int, most: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """``(low, high, eigenvalues inside)`` from the top until ``wanted`` eigenvalues above rounding level are covered."""
    diagonal, beside = tridiagonal(v)
    reach = np.abs(diagonal) + np.concatenate([[0.0], np.abs(beside)]) + np.concatenate([np.abs(beside), [0.0]])
    norm = float(reach.max(initial=0.0))
    floor = 4 * len(v) * EPS * norm
    if norm == 0:
        return []
    top = norm * (1 + 1e-6)
    out, covered = [], 0
    stack = [(floor, top, below(diagonal, beside, floor), len(v))]
    while stack and covered < wanted:
        low, high, under, to = stack.pop()
        if to == under:
            continue
        middle = None
        if to - under > most and high - low > 1e-9 * norm:
            gap = (high - low) * 1e-3
            for share in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7):  # a border with no eigenvalue next to it
                x = low + share * (high - low)
                n = below(diagonal, beside, x)
                middle = (x, n) if middle is None else middle
                if below(diagonal, beside, x - gap) == n == below(diagonal, beside, x + gap):
                    middle = (x, n)
                    break
        if middle is None:
            out.append((low, high, to - under))
            covered += to - under
        else:
            stack += [(low, middle[0], under, middle[1]), (middle[0], high, middle[1], to)]
    return out


def contour_pairs(v: np.ndarray, low: float, high: float, count: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in ``[low, high)`` and their vectors."""
    n = len(v)
    norm = float(np.abs(v).sum(axis=1).max())
    tol = 16 * EPS * norm * max(8.0, np.sqrt(n))
    x, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - x))
    center, radius = (low + high) / 2, (high - low) / 2
    rng, width = np.random.default_rng(seed), min(n, count + max(4, count // 2))
    block = rng.normal(size=(n, width))
    for k in range(ROUNDS):
        projected = np.zeros_like(block)
        for t, w in zip(turn, weights):
            shifted = (center + radius * t) * np.eye(n) - v
            projected += 0.5 * w * (radius * t * np.linalg.solve(shifted, block)).real
        basis, size, _ = np.linalg.svd(projected, full_matrices=False)
        basis = basis[:, size > EPS * size[0]]
        value, inner = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ inner
        inside = (value >= low) & (value < high)
        rest = np.linalg.norm(v @ block[:, inside] - block[:, inside] * value[inside], axis=0)
        if inside.sum() == count and rest.max(initial=0.0) <= tol:
            return value[inside], block[:, inside]
        if k % 6 == 5 and block.shape[1] < n:  # too narrow a block for its neighbourhood
            more = min(n - block.shape[1], block.shape[1])
            block = np.concatenate([block, rng.normal(size=(n, more))], axis=1)
    raise ArithmeticError(f"{count} eigenvalues in [{low}, {high}): not found after {ROUNDS} projections")


def leading_pairs(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above rounding level, falling, and their unit vectors as columns."""
    parts = intervals(v, wanted)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for r in g.itertuples():
                value, vector = contour_pairs(v, r.low, r.high, int(r.n))
                yield pd.DataFrame({"value": value, "vector": list(vector.T)})

    schema = pa.schema([("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64())])
    rows = [{"low": a, "high": b, "n": n} for a, b, n in parts]
    found = local_table(spark, rows, schema).repartition(len(rows)).mapInPandas(solve, "value double, vector array<double>").toPandas()
    if len(found) != sum(n for _, _, n in parts):
        raise ArithmeticError("the intervals do not give as many eigenvalues as their inertia counts")
    basis, _ = np.linalg.qr(np.stack(found["vector"].to_numpy()).T)  # a last Rayleigh-Ritz step across the intervals
    value, inner = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-value)[:wanted]
    return value[order], (basis @ inner)[:, order]


# --- passes over the rows -------------------------------------------------

def sound(vector: Column) -> Column:
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def whole_numbers(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of ``floor(64 c) + 1000000``."""
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0.0) > 2.0 ** 62:
        raise OverflowError("a component does not fit into 64 bits")
    return (flat.astype(np.int64) + SHIFT).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``dim, n, sums`` of a task, exact: high and low halves are added apart."""
    held: dict[int, list] = {}
    for batch in batches:
        length = batch.column(0).value_lengths().to_numpy()
        for dim in np.unique(length):
            x = whole_numbers(batch.column(0).filter(pa.array(length == dim)))
            total = held.setdefault(int(dim), [0, np.zeros((2, dim), np.int64)])
            total[0] += len(x)
            total[1] += np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
    for dim, (n, (high, low)) in held.items():
        sums = [Decimal((int(a) << 32) + int(b)) for a, b in zip(high, low)]
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.decimal128(38, 0)))],
                                         ["dim", "n", "sums"])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit integers where they fit, else Python integers."""
    if n * max(1, int(np.abs(x).max(initial=0))) < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _gram(rows_of):
    """Rows ``i, bin, row`` of the Gram matrix of all rows of a task; row vectors come from ``rows_of(batch)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = None
        for batch in batches:
            if batch.num_rows:
                y = rows_of(batch)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, TaskContext.get().partitionId() % BINS, np.int32)),
                                              pa.array(list(total), pa.list_(pa.float64()))], ["i", "bin", "row"])
    return run


def _added(g: pa.Table) -> pa.Table:
    rows = g.column("row").combine_chunks()
    total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
    return pa.table({"i": g.column("i").slice(0, 1), "bin": g.column("bin").slice(0, 1), "row": pa.array([total], pa.list_(pa.float64()))})


def gram(vectors: DataFrame, rows_of) -> np.ndarray:
    """Sum of outer products over all rows: a matrix per task, added by row in at most ``BINS`` groups, then once more."""
    ddl = "i int, bin int, row array<double>"
    parts = vectors.mapInArrow(_gram(rows_of), ddl).groupBy("i", "bin").applyInArrow(_added, ddl).groupBy("i").applyInArrow(_added, ddl)
    rows = parts.select("i", "row").collect()  # dimension x dimension numbers
    return np.stack([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with the exact sums ``sums``; ``values`` and ``components`` are eigenpairs of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, column: pa.Array) -> np.ndarray:
        return deviations(whole_numbers(column), self.n, self.sums).astype(np.float64) / self.n

    def whiten(self, column: pa.Array) -> np.ndarray:
        return self.centred(column) @ self.components / np.sqrt(self.values)

    def squared(self, column: pa.Array) -> list[int | None]:
        """Sum of squared deviations of each vector; None where it does not fit into 64 bits."""
        d = deviations(whole_numbers(column), self.n, self.sums)
        if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 2.0 ** 62:
            d = d.astype(object)
        return [s if abs(s) < 1 << 63 else None for s in map(int, (d * d).sum(axis=1))]


def of_dimension(vectors: DataFrame, dim: int, vector: str) -> DataFrame:
    return vectors.where(sound(F.col(f"`{vector}`")) & (F.size(F.col(f"`{vector}`")) == dim))


def fit(vectors: DataFrame, components: int = 32, vector: str = "embedding") -> Whitening | None:
    """Whitening by the ``components`` leading components; fewer when the covariance has fewer above rounding level.

    NULL and empty vectors and those with NULL or non-finite entries are left out, and so are vectors of another
    length than most have (ties: the longer). Equal rows count each. None when nothing is left. The driver gets sums,
    one covariance matrix and the components.
    """
    spark, col = vectors.sparkSession, F.col(f"`{vector}`").alias("v")
    per = vectors.where(sound(F.col(f"`{vector}`"))).select(col).mapInArrow(_sums, "dim long, n long, sums array<decimal(38,0)>")
    sizes = per.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return None
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    at = per.where(F.col("dim") == dim).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(at, key=lambda r: r["i"])]
    rows = of_dimension(vectors, dim, vector).select(col)
    whole = Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), np.zeros(0), 0.0)
    cov = gram(rows, lambda batch: whole.centred(batch.column(0))) / n
    cov = (cov + cov.T) / 2
    values, pairs = leading_pairs(spark, cov, min(components, dim))
    model = Whitening(n, sums, values, pairs, values / np.trace(cov) if len(values) else values, 0.0)
    if not len(values):
        return model
    # measured on the rows: a column of ones gives the means
    moments = gram(rows, lambda batch: np.concatenate([np.ones((batch.num_rows, 1)), model.whiten(batch.column(0))], axis=1)) / n
    spread = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:])
    return Whitening(n, sums, values, pairs, model.explained, float(np.abs(spread - np.eye(len(values))).max()))


def whitened(vectors: DataFrame, model: Whitening | None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, deviation, whitened`` of every vector the model can take; other rows and columns are left out."""
    kind = vectors.schema[id].dataType.simpleString()
    dim = len(model.sums) if model else -1
    rows = of_dimension(vectors, dim, vector).select(F.col(f"`{id}`").alias(id), F.col(f"`{vector}`").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.squared(batch.column(1)), pa.int64()),
                                                  pa.array(list(model.whiten(batch.column(1))), pa.list_(pa.float64()))], [id, "deviation", "whitened"])
    return rows.mapInArrow(run, f"`{id}` {kind}, deviation long, whitened array<double>")


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """All ``embeddings``, whitened by up to 32 components; one row per vector and component."""
    vectors = table(spark, sf, "embeddings")
    model = fit(vectors)
    long = whitened(vectors, model).select("vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation")
    shares = local_table(spark, [{"at": i, "explained": float(x)} for i, x in enumerate(model.explained if model else [])],
                         pa.schema([("at", pa.int32()), ("explained", pa.float64())]))
    return long.join(F.broadcast(shares), "at").select(  # at most 32 rows
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(model.identity_error if model else 0.0).alias("identity_error"))
