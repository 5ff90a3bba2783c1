"""Locality-sensitive hashing: several tables of buckets, candidates by equi-join on (table, bucket), exact ranking.

Projections are floored into buckets of width w for L2 and L1, and reduced to their sign for the other metrics; the
values of a table are folded by FNV-1a.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..types import Metric
from .inverted import nearest_vectors, probe_join
from .topk import ranked

# FNV-1a, 32 bits.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619


@dataclass
class Lsh:
    planes: np.ndarray  # (tables, functions, components)
    bias: np.ndarray  # (tables, functions)
    width: float
    metric: Metric

    @classmethod
    def gaussian(cls, dim: int, metric: Metric = Metric.L2, tables: int = 10, functions: int = 8, width: float = 10.0, seed: int = 58) -> Lsh:
        rng = np.random.default_rng(seed)
        planes = rng.standard_normal((tables, functions, dim))
        if metric not in (Metric.L2, Metric.L1):
            planes /= np.linalg.norm(planes, axis=2, keepdims=True)
        return cls(planes, rng.random((tables, functions)) * width, width, metric)

    @classmethod
    def integer(cls, dim: int, metric: Metric = Metric.L2, tables: int = 4, functions: int = 8, width: float = 1.0) -> Lsh:
        """Projections by integer arithmetic, so that any engine can compute them."""
        t, f, d = np.meshgrid(np.arange(tables), np.arange(functions), np.arange(dim), indexing="ij")
        planes = ((t * 7919 + f * 104729 + d * 1299709 + t * f * d * 31) % 2001 - 1000) / 500.0
        bias = ((t[:, :, 0] * 31 + f[:, :, 0] * 17) % 100) / 100.0 * width
        return cls(planes, bias, width, metric)

    @property
    def buckets(self) -> int:
        return 1 << min(self.planes.shape[1], 16)

    def hash(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket numbers."""
        p = np.einsum("nd,tfd->ntf", x, self.planes)
        if self.metric in (Metric.L2, Metric.L1):
            value = np.floor(np.round((p + self.bias) / self.width, 9)).astype(np.int64)
        else:
            value = (p >= 0).astype(np.int64)
        h = np.full(value.shape[:2], FNV_OFFSET, dtype=np.uint64)
        for f in range(value.shape[2]):
            h = ((h ^ (value[:, :, f] & 0xFFFFFFFF).astype(np.uint64)) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
        return (h % np.uint64(self.buckets)).astype(np.int64)

    def _hashed(self, rows: DataFrame, id: str, vector: str) -> DataFrame:
        """(id, vector, tbl, bucket), a row for each table."""

        @F.pandas_udf("array<long>")
        def hashed(v: pd.Series) -> pd.Series:
            return pd.Series(list(self.hash(kernels.matrix(v, self.planes.shape[2])))) if len(v) else pd.Series([], dtype=object)

        return rows.select(id, vector, F.posexplode(hashed(vector)).alias("tbl", "bucket"))

    def postings(self, rows: DataFrame, keep_vector: bool = False) -> DataFrame:
        """(id, tbl, bucket[, vector])."""
        return self._hashed(rows, "id", "vector").select("id", "tbl", "bucket", *["vector"] * keep_vector)

    def search(self, queries: DataFrame, k: int, postings: DataFrame) -> DataFrame:
        """All rows that share a bucket with a query, ranked by their exact distance; `postings` hold the vectors.

        A bucket's queries and rows meet in its tasks, large buckets in several, which return the k best of each query: the best of
        all candidates are among those, so neither pairs nor vectors move again.
        """
        cell = (F.col("tbl") * self.buckets + F.col("bucket")).cast("int").alias("cell")
        asked = self._hashed(queries, "query_id", "query").select("query_id", "query", cell)
        found = probe_join(asked, postings.select("id", "vector", cell), nearest_vectors(self.metric, k), ["id", "vector"])
        best = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
        return ranked(best, k).select("query_id", "rank", "id", "distance")
