"""Distances between two array columns, in double precision, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import EPSILON, Metric


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(a), lambda x: x * x)))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def cosine(a: Column, b: Column) -> Column:
    """1 - similarity, the similarity kept to [-1, 1]; 1 if a norm is practically zero."""
    size = norm(a) * norm(b)
    near = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.when(size < EPSILON, F.lit(1.0)).otherwise(size)))
    return F.when(size < EPSILON, F.lit(1.0)).otherwise(F.lit(1.0) - near)


def inner_product(a: Column, b: Column) -> Column:
    """Negative inner product, so that smaller is nearer; may be negative."""
    return -dot(a, b)


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def hamming(a: Column, b: Column) -> Column:
    """Number of places with different values."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: F.when(x != y, F.lit(1.0)).otherwise(F.lit(0.0))))


DISTANCE = {Metric.L2: l2, Metric.COSINE: cosine, Metric.IP: inner_product, Metric.L1: l1, Metric.HAMMING: hamming}


def distance(metric: Metric, a: Column, b: Column) -> Column:
    return DISTANCE[metric](a, b)

