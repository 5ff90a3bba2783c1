"""Scalar quantisation to bytes: one global range for each component."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..types import Metric
from .topk import scan

FLAT = 1e-10


def stats(rows: DataFrame) -> DataFrame:
    """(pos, vmin, vmax): combined in each task before the shuffle, a row a component."""
    x = rows.select(F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "x"))
    return x.groupBy("pos").agg(F.min("x").alias("vmin"), F.max("x").alias("vmax"))


def ranges(rows: DataFrame) -> tuple[list[float], list[float]]:
    got = sorted(stats(rows).collect(), key=lambda r: r["pos"])
    return [r["vmin"] for r in got], [r["vmax"] for r in got]


def encode(rows: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """(id, codes): 0-255 of each component; 128 where the range is flat."""
    lo, hi = F.lit(low), F.lit(high)
    span = F.zip_with(hi, lo, lambda a, b: a - b)
    part = F.zip_with(F.col("vector").cast("array<double>"), lo, lambda x, a: x - a)

    def code(x: F.Column, s: F.Column) -> F.Column:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / F.when(s < FLAT, F.lit(1.0)).otherwise(s)))
        return F.when(s < FLAT, F.lit(128)).otherwise(F.floor(share * 255 + 0.5).cast("int"))

    return rows.select("id", F.zip_with(part, span, code).alias("codes"))


def decode(codes: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """(id, vector) that the codes stand for."""
    step = [(b - a) / 255 for a, b in zip(low, high)]
    up = F.zip_with(F.col("codes"), F.lit(step), lambda c, s: c * s)
    return codes.select("id", F.zip_with(F.lit(low), up, lambda a, x: a + x).alias("vector"))


def search(queries: DataFrame, codes: DataFrame, low: list[float], high: list[float], k: int, metric: Metric = Metric.L2, most: int | None = None) -> DataFrame:
    """Exact distances to what the codes stand for, over all codes; `most` is a number that theirs doesn't exceed."""
    base, step = np.array(low), (np.array(high) - np.array(low)) / 255
    return scan(queries, codes, k, metric, lambda b: base + kernels.matrix(b["codes"]) * step, ["id", "codes"], most)
