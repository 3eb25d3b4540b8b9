"""Missing values and small numeric helpers as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: str | Column) -> Column:
    """NaN as null: aggregates skip nulls but are spoilt by NaN."""
    return F.nanvl(col(x), F.lit(None).cast("double"))


def null_to_nan(x: str | Column) -> Column:
    return F.coalesce(col(x), F.lit(float("nan")))


def ratio(a: str | Column, b: str | Column, default: float | None = 0.0) -> Column:
    """a / b, and ``default`` where b is zero or null."""
    return F.when(F.coalesce(col(b), F.lit(0.0)) != 0, col(a) / col(b)).otherwise(F.lit(default).cast("double"))


def clip(x: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def sigmoid(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def sign(x: str | Column) -> Column:
    return F.signum(col(x))


def total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def plogp(p: Column) -> Column:
    """-p ln p, 0 at p = 0."""
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)


def zscore(x: str | Column, mean: Column, std: Column, default: float = 0.0) -> Column:
    return F.when(std > 1e-10, (col(x) - mean) / std).otherwise(F.lit(default))
