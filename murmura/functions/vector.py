"""Arithmetic on ``array<double>`` columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def v_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def v_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def v_scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda p: p * factor)


def v_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, p: acc + p)


def v_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, v_sum(a) / F.size(a))


def v_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, p: acc + p * p))


def v_unit(a: Column, length: Column | None = None) -> Column:
    """``a / |a|``; NULL for the zero vector."""
    size = v_norm(a) if length is None else length
    return F.when(size > 0, F.transform(a, lambda p: p / size))


def v_is_finite(a: Column) -> Column:
    return a.isNotNull() & F.forall(
        a, lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf")))
    )


def distance(a: Column, b: Column, dims: int | None = None) -> Column:
    """Euclidean distance; a known ``dims`` unrolls the loop over coordinates."""
    if dims is None:
        return F.sqrt(F.aggregate(
            F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, p: acc + p
        ))
    total = None
    for i in range(dims):
        gap = F.get(a, i) - F.get(b, i)
        total = gap * gap if total is None else total + gap * gap
    return F.sqrt(total)
