"""Lloyd's k-means over a DataFrame.

Seeds are the rows of the lowest ids (reproducible in any engine) or k-means++ on a bounded sample.  Each round assigns in the tasks, which
send one sum a centroid and component; the driver holds the centroids only.  A centroid without rows stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..types import Invalid

DIGITS = 6
SEED_SAMPLE = 20_000
#: Tasks whose sums the driver adds up itself, without a shuffle.
FEW_TASKS = 64


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid by squared L2, rounded first; the smaller index on ties."""
    return np.round(kernels.l2_squared(x, centroids), DIGITS).argmin(1) if len(x) else np.zeros(0, dtype=np.int64)


def first_rows(rows: DataFrame, k: int) -> np.ndarray:
    got = rows.select("id", "vector").orderBy("id").limit(k).collect()
    if len(got) < k:
        raise Invalid(f"{k} centroids need as many rows; there are {len(got)}")
    return np.array([r["vector"] for r in got], dtype=np.float64)


def plus_plus(rows: DataFrame, k: int, seed: int = 90) -> np.ndarray:
    """k-means++ on a hash sample of at most `SEED_SAMPLE` rows."""
    x = kernels.matrix(rows.select("id", "vector").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(SEED_SAMPLE, k)).toPandas()["vector"])
    if len(x) < k:
        raise Invalid(f"{k} centroids need as many rows; there are {len(x)}")
    return spread_rows(x, k, seed)


def spread_rows(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows drawn one by one with a chance in proportion to the squared distance from those that are drawn."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    d = kernels.l2_squared(x, x[chosen[:1]])[:, 0]
    while len(chosen) < k:
        total = d.sum()
        chosen.append(int(rng.choice(len(x), p=d / total)) if total > 0 else int(rng.integers(len(x))))
        d = np.minimum(d, kernels.l2_squared(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def step(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centroids, rows of each) after one round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for b in batches:
            x = kernels.matrix(b["vector"], centroids.shape[1])
            cell = nearest(x, centroids)
            np.add.at(total, cell, x)
            n += np.bincount(cell, minlength=len(centroids))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"cell": at, "n": n[at], "total": pd.Series(total[at].tolist(), dtype=object)})

    part = rows.select("vector").mapInPandas(run, "cell long, n long, total array<double>")
    if part.rdd.getNumPartitions() <= FEW_TASKS:  # a row for each task and centroid
        got, count, total = part.toPandas(), np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        for cell, n, x in zip(got["cell"], got["n"], got["total"]):
            count[cell] += n
            total[cell] += x
        return np.where(count[:, None] > 0, np.round(total / np.maximum(count, 1)[:, None], DIGITS), centroids), count
    sums = part.select("cell", "n", F.posexplode("total").alias("pos", "x")).groupBy("cell", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out, count = centroids.copy(), np.zeros(len(centroids), dtype=np.int64)
    for r in sums.collect():  # a row for each centroid and component
        out[r["cell"], r["pos"]] = round(r["x"] / r["n"], DIGITS)
        count[r["cell"]] = r["n"]
    return out, count


def lloyd(rows: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Up to `rounds` rounds, fewer if nothing moves."""
    if not rounds:
        return centroids
    rows = rows.select("vector").persist()  # else each round makes them anew
    try:
        for _ in range(rounds):
            new, _ = step(rows, centroids)
            if np.array_equal(new, centroids):
                break
            centroids = new
    finally:
        rows.unpersist()
    return centroids


def local_lloyd(x: np.ndarray, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The same on a matrix."""
    for _ in range(rounds):
        cell = nearest(x, centroids)
        new = centroids.copy()
        for c in np.unique(cell):
            new[c] = np.round(x[cell == c].mean(0), DIGITS)
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids
