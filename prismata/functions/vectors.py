"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v over its norm, which counts as 1e-12 at least."""
    return F.transform(F.arrays_zip(doubles(v).alias("x"), F.array_repeat(F.greatest(norm(v), F.lit(TINY)), F.size(v)).alias("n")), lambda z: z["x"] / z["n"])


def affine(v: Column, weights: Column, bias: Column) -> Column:
    """W v + b for an array of rows."""
    return F.zip_with(F.transform(weights, lambda row: dot(row, v)), doubles(bias), lambda x, y: x + y)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def class_weight(n: Column) -> Column:
    return 1 / F.ln(1 + F.greatest(n, F.lit(1)))


def temperature_grid(t: float, points: int = 25) -> list[float]:
    """Log-spaced from max(0.01, t / 10) to min(100, 10 t), each value once."""
    low, high = max(0.01, t / 10), min(100.0, 10 * t)
    return sorted({low * (high / low) ** (i / (points - 1)) for i in range(points)})


def steps(start: float, stop: float, step: float) -> list[float]:
    """From start to stop, both included, rounded to ten decimals."""
    return [round(start + i * step, 10) for i in range(int((stop - start) / step + 1e-9) + 1)]


def temperatures(t: Column, points: int = 25) -> Column:
    """`temperature_grid` of a column, as an array (equal values stay)."""
    low, high = F.greatest(F.lit(0.01), t / 10), F.least(F.lit(100.0), t * 10)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low * F.pow(high / low, i / F.lit(float(points - 1))))


def points(start: Column, stop: Column, step: float) -> Column:
    """`steps` between two columns, as an array."""
    return F.transform(F.sequence(F.lit(0), F.floor((stop - start) / step + 1e-9).cast("int")), lambda i: F.round(start + i * F.lit(float(step)), 10))
