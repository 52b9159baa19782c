"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows X (whole numbers, centred by their exact mean) stay on Spark, in blocks. With orthonormal right vectors V and
left vectors U the method builds X V = U B, a vector of each per step:

1. Xv: the next right vector v is multiplied by all rows; its part along the earlier left vectors is taken off.
2. X'u: the new left vector is multiplied back; its part along all earlier right vectors is taken off (twice, as one
   pass leaves rounding errors), and what is left is the next right vector.

A left vector has a number for each row. It is a combination of the columns of X, so u = X p is kept as the
short p, and a task computes X p and X'(X p) for its blocks one after the other: a scan per step, with a row of
dimension + 1 sums for each task, added up on Spark. U'Xv is (X'u)'v, which is known, so both sides are
reorthogonalised in full without a further scan. B is bidiagonal; where a Krylov space is used up (equal deviations
appear in it once) or has converged, the next right vector is a random one, and its column of B is filled.
It ends when all dimensions are used, or when the wanted deviations have converged again after such a restart.
The singular values of the small B give the deviations, its right singular vectors the components.

Rows whose vector is null, empty, or has null or non-finite components take no part, nor do rows whose dimension is not the
most frequent one (the smaller one of equally frequent ones). Repeated rows count each; a null vec_id is carried along.
Directions with less than `RANK` of the largest deviation count as empty and have no component; fewer than the
wanted number of components may remain, and none without rows or with equal rows only. A component beyond 2^40
after scaling fails the job. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuetrace.llm.jobs import arrow_map, store
from cuetrace.llm.vectors import finite, matrix, slices, whole

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
RANK = 1e-6
EMPTY = 1e-12  # of the largest deviation: a vector that short is rounding error
CONVERGED = 1e-11  # residual that changes a component by rounding error only
CHECK_EVERY = 8
SEED = 11

BLOCKS = "ids array<long>, x binary"
WHITENED = "vec_id long, deviation decimal(38,0), whitened array<double>"


@dataclass
class Rows:
    """The stored blocks, their dimension, and the rows' number and exact sums."""

    blocks: DataFrame
    dim: int
    n: int
    sums: np.ndarray

    def __post_init__(self):
        self.near = (2 * self.sums + self.n) // (2 * self.n) if self.n else self.sums  # the mean, rounded
        self.rest = self.sums - self.n * self.near

    def totals(self, function: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
        """Sum over all blocks of a vector computed from the block, here of a long matrix less `near`."""
        dim, near = self.dim, self.near

        def run(batches):
            total = None
            for batch in batches:
                for x in batch.column("x"):
                    part = function(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dim) - near)
                    total = part if total is None else total + part
            if total is not None:
                yield {"at": np.arange(len(total)), "part": total}

        found = arrow_map(self.blocks.select("x"), run, f"at int, part {kind}").groupBy("at").agg(F.sum("part").alias("s"))
        found = sorted((r["at"], r["s"]) for r in found.collect())  # one row for each place of the vector
        return np.array([s for _, s in found], np.int64 if kind == "long" else float)

    def centring(self) -> Callable[[np.ndarray], np.ndarray]:
        """Takes the rest of the mean off; a function that tasks can have without this object's table."""
        shift = self.rest / self.n
        return lambda x: x - shift


@dataclass
class Whitening:
    """Unit eigenvectors as columns, by falling deviation, and what they explain."""

    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float


def read_rows(vectors: DataFrame) -> Rows:
    """Store the usable rows in blocks of about 1 MB."""
    rows = vectors.filter(finite(F.col("embedding"))).select(
        "vec_id", whole(F.col("embedding"), SCALE, OFFSET).alias("x"))
    dims = vectors.filter(finite(F.col("embedding")) & (F.size("embedding") > 0)).groupBy(
        F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = dims[0]["dim"] if dims else 0

    def pack(batches):
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            for begin, end in slices(len(x), dim):
                yield {"ids": pa.array([batch.column("vec_id")[begin:end].to_pylist()], pa.list_(pa.int64())),
                       "x": [x[begin:end].tobytes()]}

    blocks = store(arrow_map(rows.filter(F.size("x") == dim), pack, BLOCKS), "vector-blocks") if dim else None
    found = Rows(blocks, dim, dims[0]["n"] if dims else 0, np.zeros(dim, np.int64))
    if dim:
        found.near = np.zeros(dim, np.int64)
        found = Rows(blocks, dim, found.n, found.totals(lambda x: x.sum(axis=0), "long"))
    return found


def bidiagonalise(product: Callable[[np.ndarray], tuple[float, np.ndarray]], dim: int, wanted: int,
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Components (columns) and singular values of X, given p -> (|X p|, X'X p)."""
    random = np.random.default_rng(SEED)
    v_all, p_all, z_all = (np.zeros((dim, 0)) for _ in range(3))
    b = np.zeros((dim, dim))
    largest, settled = 0.0, None

    def fresh() -> np.ndarray:
        v = random.normal(size=dim)
        for _ in range(2):
            v -= v_all @ (v_all.T @ v)
        return v / np.linalg.norm(v)

    v = fresh()
    for k in range(dim):
        v_all = np.column_stack([v_all, v])
        p, along = v.copy(), np.zeros(k)
        for _ in range(2):
            part = z_all.T @ p  # U'Xp
            p -= p_all @ part
            along += part
        alpha, z = product(p)
        largest = max(largest, alpha)
        if alpha <= EMPTY * largest:
            alpha, p, z = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            p, z = p / alpha, z / alpha
        b[:k, k], b[k, k] = along, alpha
        p_all, z_all = np.column_stack([p_all, p]), np.column_stack([z_all, z])
        if k + 1 == dim:
            break
        v = z - v_all @ (v_all.T @ z)
        v -= v_all @ (v_all.T @ v)
        beta = float(np.linalg.norm(v))
        restart = beta <= EMPTY * largest
        if k + 1 >= wanted and (k + 1) % CHECK_EVERY == 0:
            own = b[:k + 1, :k + 1]
            left, values, _ = np.linalg.svd(own)
            left_over = np.linalg.norm((z_all - v_all @ own.T) @ left[:, :wanted], axis=0)
            if (left_over <= CONVERGED * values[0]).all():
                if settled is not None and np.allclose(settled, values[:wanted], rtol=1e-11, atol=EMPTY * values[0]):
                    break
                settled, restart = values[:wanted], True
        v = fresh() if restart else v / beta
    steps = v_all.shape[1]
    _, values, right = np.linalg.svd(b[:steps, :steps])
    return v_all @ right.T, values


def fit(rows: Rows, components: int = COMPONENTS) -> Whitening:
    none = Whitening(np.zeros((rows.dim, 0)), np.zeros(0), np.zeros(0), 0.0)
    if not rows.n:
        return none
    centre = rows.centring()
    total = float(rows.totals(lambda x: np.array([(centre(x) ** 2).sum()])).sum())
    if not total:
        return none

    def product(p: np.ndarray) -> tuple[float, np.ndarray]:
        def both(x):
            x = centre(x)
            y = x @ p
            return np.append(x.T @ y, y @ y)

        sums = rows.totals(both)
        return float(np.sqrt(sums[-1])), sums[:-1]

    vectors, values = bidiagonalise(product, rows.dim, components)
    kept = np.flatnonzero(values[:components] > RANK * values[0])
    vectors, values = vectors[:, kept], values[kept]
    deviations = values / np.sqrt(rows.n)
    scaled = vectors / deviations

    def second(x):
        w = centre(x) @ scaled
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    sums = rows.totals(second) / rows.n
    k = len(kept)
    covariance = sums[:k * k].reshape(k, k) - np.outer(sums[k * k:], sums[k * k:])
    return Whitening(vectors, deviations, values ** 2 / total, float(np.abs(covariance - np.eye(k)).max()))


def squared_length(x: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Exact sum of (n x - rest)^2 for each row."""
    far = n * int(np.abs(x).max(initial=0)) + int(np.abs(rest).max(initial=0))
    if far * far * max(1, x.shape[1]) < 1 << 62:
        off = n * x - rest
        return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
    off = n * x.astype(object) - rest.astype(object)
    return pa.array([Decimal(s) for s in (off * off).sum(axis=1).tolist()], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening, int]:
    """(vec_id, deviation, whitened) for each usable row, the fitted components, and the number of rows."""
    rows = read_rows(vectors)
    model = fit(rows, components)
    if not rows.n or not len(model.deviations):
        return vectors.sparkSession.createDataFrame([], WHITENED), model, rows.n
    dim, n, near, rest = rows.dim, rows.n, rows.near, rows.rest
    scaled, k, centre = model.components / model.deviations, len(model.deviations), rows.centring()

    def run(batches):
        for batch in batches:
            for ids, x in zip(batch.column("ids"), batch.column("x")):
                x = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dim) - near
                w = centre(x) @ scaled
                ends = pa.array(np.arange(0, w.size + 1, k, dtype=np.int32))
                yield {"vec_id": ids.values, "deviation": squared_length(x, n, rest),
                       "whitened": pa.ListArray.from_arrays(ends, pa.array(w.ravel()))}

    return arrow_map(rows.blocks, run, WHITENED), model, rows.n
