"""Column functions for means and for statistics that may lack a denominator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def complete(x: Column) -> Column:
    """True if no row of the group has a NULL `x`."""
    return F.count(x) == F.count(F.lit(1))


def strict_mean(x: Column) -> Column:
    """Mean that is NULL as soon as one value of the group is NULL (`avg` would skip it)."""
    return F.when(complete(x), F.avg(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def check_all(ok: Column, value: Column, message: str) -> Column:
    """`value`, failing the job where `ok` does not hold."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))
