"""Vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    """A constant array of doubles: one literal, however long."""
    return F.lit(np.asarray(values, dtype="float64"))


def dot(x: Column, w: Column) -> Column:
    """Inner product in double precision, left to right."""
    products = F.zip_with(x, w, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def matrix_times(matrix: Sequence[Sequence[float]], x: Column) -> Column:
    rows = F.array(*[literal(row) for row in matrix])
    return F.transform(rows, lambda row: dot(x, row))


def linear(x: Column, weights: Column, intercept: Column) -> Column:
    return dot(x, weights) + intercept
