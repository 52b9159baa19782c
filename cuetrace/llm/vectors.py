"""Vectors as whole numbers, in blocks of rows that fit a matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Entries from here on fail the job: sums and products of whole numbers would not be exact.
LIMIT = 2.0 ** 40


def finite(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def whole(vector: Column, factor: int, offset: int = 0) -> Column:
    """floor(factor * component as double) + offset, as long."""
    def entry(x: Column) -> Column:
        scaled = F.lit(float(factor)) * x.cast("double")
        return F.when(F.abs(scaled) < LIMIT, F.floor(scaled) + F.lit(offset).cast("long")).otherwise(
            F.raise_error(F.lit("a vector has a component too large for exact sums")).cast("long"))

    return F.transform(vector, entry)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow column of lists of `dim` whole numbers as a matrix."""
    return pa.array(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def slices(rows: int, dim: int, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts of `rows` rows such that each has about `size` bytes, or one row."""
    step = max(1, size // (8 * max(1, dim)))
    for begin in range(0, rows, step):
        yield begin, min(rows, begin + step)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 1 << 56:
        raise ValueError("inner products do not fit in a long")
    if most < 1 << 53:  # doubles are exact, and much faster
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
