"""Gamma functions as JVM expressions: recurrence up to ``SHIFT``, then the asymptotic series
(absolute error below 1e-11 for positive arguments)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8


def _above(x: Column) -> Column:
    return x + SHIFT


def lgamma(x: Column) -> Column:
    z = _above(x)
    r = 1 / (z * z)
    series = (1 / z) * (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188))))
    product = x
    for i in range(1, SHIFT):
        product = product * (x + i)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(product)


def digamma(x: Column) -> Column:
    z = _above(x)
    r = 1 / (z * z)
    out = F.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    for i in range(SHIFT):
        out = out - 1 / (x + i)
    return out


def trigamma(x: Column) -> Column:
    z = _above(x)
    r = 1 / (z * z)
    out = 1 / z + r / 2 + (r / z) * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))
    for i in range(SHIFT):
        out = out + 1 / ((x + i) * (x + i))
    return out
