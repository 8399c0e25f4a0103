"""Row-level functions that Spark lacks or defines otherwise."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign(x: Column) -> Column:
    """-1 below zero, else 1 (also at zero)."""
    return F.when(x < 0, -1).when(x.isNotNull(), 1)


def step(x: Column) -> Column:
    """0 below zero, else 1."""
    return F.when(x < 0, 0).when(x.isNotNull(), 1)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) if x is not None else None


def piecewise_sigmoid(x: Column) -> Column:
    """0 below -1/2, 1 from 1/2, x + 1/2 between."""
    return F.when(x < -0.5, 0.0).when(x >= 0.5, 1.0).otherwise(x + 0.5)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    """Product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def max_pool(image: Column, width: int, size: int, stride: int) -> Column:
    """Largest value of each size x size window of an image, an array of rows of ``width`` values one after the other."""
    rows = (F.size(image) / width).cast("int")
    down = F.sequence(F.lit(0), rows - size, F.lit(stride))
    across = F.sequence(F.lit(0), F.lit(width - size), F.lit(stride))
    inside = [(i, j) for i in range(size) for j in range(size)]
    top = lambda r, c: F.greatest(*(F.get(image, (r + i) * width + c + j) for i, j in inside)) if len(inside) > 1 else F.get(image, r * width + c)
    return F.flatten(F.transform(down, lambda r: F.transform(across, lambda c: top(r, c))))


def total(columns: Iterable[Column]) -> Column:
    """Sum of columns, missing values as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])


def matrix_product(row: Column, matrix: list[list[float]]) -> Column:
    """A row vector times a matrix that the driver holds."""
    return F.array(*(dot(row, F.array(*(F.lit(float(r[j])) for r in matrix))) for j in range(len(matrix[0]))))


def power_of_two_rank(x: Column) -> Column:
    """How often 1 must be doubled (or halved, negative) to lie above |x| and not above twice it: |x| / 2**rank is in [1/2, 1). 0 has none."""
    return F.when(x != 0, (F.floor(F.log2(F.abs(x))) + 1).cast("int"))


def parts(x: Column, separator: str = "####") -> Column:
    """A text split at a separator that is taken as it is."""
    return F.split(x, "\\Q" + separator + "\\E", -1)


def json_value(x: Column, name: str, kind: str = "string") -> Column:
    """A field of a JSON object as a type."""
    return F.get(F.array(F.from_json(x, f"`{name}` {kind}")), F.lit(0))[name]


def histogram_bucket(x: Column, low: float, high: float, bins: int) -> Column:
    """Number (from 0) of the equal step between low and high that a value lies in; high belongs to the last one, values beyond have none."""
    at = F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int") - 1
    return F.when(x == high, bins - 1).when((x >= low) & (x < high), at)
