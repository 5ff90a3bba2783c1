"""Inverted files: flat, product-quantised, and with anisotropic residuals and reranking.

Rows get a cell, that of the nearest centroid by L2 whatever the metric.  A query probes its nearest cells and joins on the cell, so
storage that is partitioned by cell is pruned.  Large cells are dealt over several tasks by a salt on the id; each
task keeps the k best of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..types import Invalid, Metric
from . import kmeans
from .topk import DIGITS, FOUND, ranked

#: Rows of a cell that one task takes.
CELL_ROWS = 50_000
#: Rows of a cell for which its queries are dealt to one task more.
ASK_ROWS = 4_000
#: Rows of a query, in each part of a cell, that are sent to be ranked again at most.
SENT = 256
#: Rows that codebooks are trained on at most (a hash sample beyond it).
TRAIN_ROWS = 100_000


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds `cell`."""

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(kmeans.nearest(kernels.matrix(v, centroids.shape[1]), centroids).astype(np.int32))

    return rows.withColumn("cell", cell("vector"))


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """(query_id, query, cell) for the nearest cells of each query."""
    n = max(1, min(nprobe, len(centroids)))

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        d = np.round(kernels.l2_squared(kernels.matrix(v, centroids.shape[1]), centroids), DIGITS)
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32))) if len(v) else pd.Series([], dtype=object)

    return queries.select("query_id", "query", F.explode(cells("query")).alias("cell"))


Best = Callable[[int, np.ndarray, pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray]]


def nearest_vectors(metric: Metric, k: int) -> Best:
    """The k nearest by the vectors themselves."""
    return lambda _cell, q, x: kernels.nearest(metric, q, kernels.matrix(x["vector"]), x["id"].to_numpy(), k, DIGITS)


def by_cell(asked: DataFrame, rows: DataFrame, meet: Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame], ask_columns: list[str], columns: list[str], schema: str) -> DataFrame:
    """`meet((cell, ...), queries, rows)` for each dealt part of a cell's rows and of its queries, where there are both.

    Rows are dealt so that a task takes `CELL_ROWS` of them at most; queries so that cells with many rows make several tasks.
    """
    n = F.count("*")
    sizes = rows.groupBy("cell").agg(F.ceil(n / CELL_ROWS).cast("int").alias("spread"), F.least(F.lit(64), F.ceil(n / ASK_ROWS)).cast("int").alias("asks"))  # a row a cell
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda id, c: F.pmod(F.xxhash64(id), F.col(c)).cast("int")
    left = asked.join(F.broadcast(sizes), "cell").withColumn("salt", each("spread")).withColumn("ask", dealt("query_id", "asks"))
    right = rows.join(F.broadcast(sizes), "cell").withColumn("salt", dealt("id", "spread")).withColumn("ask", each("asks"))
    keys, names = ["cell", "salt", "ask"], [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return meet(key, q, x) if len(q) and len(x) else pd.DataFrame({c: [] for c in names})

    return left.select(*keys, *ask_columns).groupBy(*keys).cogroup(right.select(*keys, *columns).groupBy(*keys)).applyInPandas(run, schema)


def probe_join(asked: DataFrame, rows: DataFrame, best: Best, columns: list[str], more: dict[str, Callable[..., np.ndarray]] | None = None) -> DataFrame:
    """(query_id, id, distance, ...): the best of each query in each dealt part of its cells.

    `best(cell, queries, rows of the cell)` gives (query, row, distance) of those; each function of `more` a further column, from the
    same arguments and the two numbers.
    """
    more = more or {}

    def meet(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        asking = kernels.matrix(q["query"])
        i, j, d = best(int(key[0]), asking, x)
        out = pd.DataFrame({"query_id": q["query_id"].to_numpy()[i], "id": x["id"].to_numpy()[j], "distance": d})
        for name, f in more.items():
            out[name] = f(int(key[0]), asking, x, i, j)
        return out

    return by_cell(asked, rows, meet, ["query_id", "query"], columns, ", ".join([FOUND, *(f"{c} double" for c in more)]))


def of_pairs(metric: Metric, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, squared: bool = False) -> np.ndarray:
    """Rounded distances of the rows i of a to the rows j of b."""
    step = 1 << 14
    parts = [kernels.pairwise(metric, a[i[lo : lo + step]], b[j[lo : lo + step]], squared) for lo in range(0, len(i), step)]
    return np.round(np.concatenate(parts), DIGITS) if parts else np.empty(0)


@dataclass
class InvertedFile:
    """Flat inverted file."""

    centroids: np.ndarray

    @classmethod
    def train(cls, rows: DataFrame, nlist: int, rounds: int = 100, seeds: str = "plus_plus") -> InvertedFile:
        first = kmeans.first_rows(rows, nlist) if seeds == "lowest" else kmeans.plus_plus(rows, nlist)
        return cls(kmeans.lloyd(rows, first, rounds))

    def encode(self, rows: DataFrame) -> DataFrame:
        return assign(rows, self.centroids)

    def search(self, queries: DataFrame, encoded: DataFrame, k: int, metric: Metric = Metric.L2, nprobe: int = 8) -> DataFrame:
        found = probe_join(probes(queries, self.centroids, nprobe), encoded, nearest_vectors(metric, k), ["id", "vector"])
        return ranked(found, k).select("query_id", "rank", "id", "distance")


def stretched(x: np.ndarray, residual: np.ndarray, eta: float) -> np.ndarray:
    """Residuals with their share along the vector's own direction weighted by 1 + eta; as they are for eta = 0 and tiny vectors."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(size < 1e-9, 1.0, size)
    along = (residual * unit).sum(1, keepdims=True)
    return residual + np.where(size < 1e-9, 0.0, max(eta, 0.0)) * along * unit


@dataclass
class ProductQuantizer:
    """Inverted file whose rows are codes of their residuals; `eta` > 0 makes it anisotropic."""

    centroids: np.ndarray
    codebooks: np.ndarray  # (subspaces, codes, components)
    eta: float = 0.0

    @classmethod
    def train(cls, rows: DataFrame, nlist: int, m: int = 8, nbits: int = 8, rounds: int = 30, eta: float = 0.0, seeds: str = "plus_plus") -> ProductQuantizer:
        first = rows.select(F.size("vector").alias("d")).limit(1).collect()
        dim = first[0]["d"] if first else 0
        if not dim or dim % m:
            raise Invalid(f"{dim} components don't fall into {m} subspaces")
        if nbits not in (4, 8):
            raise Invalid("codes have 4 or 8 bits")
        coarse = InvertedFile.train(rows, nlist, rounds, seeds).centroids
        codes, sub = 1 << nbits, dim // m
        order = [F.col("id")] if seeds == "lowest" else [F.xxhash64("id", F.lit(m)), F.col("id")]
        limit = codes if seeds == "lowest" and not rounds else TRAIN_ROWS
        sample = rows.select("id", "vector").orderBy(*order).limit(limit)

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = kernels.matrix(b["vector"], dim)
                residual = np.round(stretched(x, x - coarse[kmeans.nearest(x, coarse)], eta), kmeans.DIGITS)
                for s in range(m):
                    yield pd.DataFrame({"sub": s, "id": b["id"], "part": list(residual[:, s * sub : (s + 1) * sub])})

        def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = kernels.matrix(pdf.sort_values("id", kind="stable")["part"])
            if len(x) < codes:
                return pd.DataFrame({"sub": [key[0]], "rows": [len(x)], "book": [None]})
            first = x[:codes].copy() if seeds == "lowest" else kmeans.spread_rows(x, codes, int(key[0]))
            return pd.DataFrame({"sub": [key[0]], "rows": [len(x)], "book": [kmeans.local_lloyd(x, first, rounds).ravel()]})

        # a task for each subspace, of at most TRAIN_ROWS rows; a codebook for each comes back
        got = sample.mapInPandas(parts, "sub int, id long, part array<double>").groupBy("sub").applyInPandas(fit, "sub int, rows long, book array<double>").collect()
        if any(r["book"] is None for r in got):
            raise Invalid(f"{codes} codes need as many rows; there are {got[0]['rows']}")
        return cls(coarse, np.stack([np.array(r["book"]).reshape(codes, sub) for r in sorted(got, key=lambda r: r["sub"])]), eta)

    def _codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        sub = self.codebooks.shape[2]
        residual = stretched(x, x - self.centroids[cell], self.eta)
        return np.column_stack([kmeans.nearest(residual[:, s * sub : (s + 1) * sub], book) for s, book in enumerate(self.codebooks)])

    def encode(self, rows: DataFrame, keep_vector: bool = False) -> DataFrame:
        """(id, cell, codes[, vector])."""

        @F.pandas_udf("array<int>")
        def codes(v: pd.Series, cell: pd.Series) -> pd.Series:
            return pd.Series(list(self._codes(kernels.matrix(v), cell.to_numpy()).astype(np.int32))) if len(v) else pd.Series([], dtype=object)

        return assign(rows, self.centroids).select("id", "cell", codes("vector", "cell").alias("codes"), *["vector"] * keep_vector)

    def asked(self, cell: int, q: np.ndarray) -> np.ndarray:
        """The queries' residuals, which are held against those that the codes stand for."""
        return stretched(q, q - self.centroids[cell], self.eta)

    def meant(self, rows: pd.DataFrame) -> np.ndarray:
        """The residuals that the rows' codes stand for; squared L2 to them is the sum of a query's table entries that the codes name."""
        codes = kernels.matrix(rows["codes"]).astype(np.int64)
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(self.codebooks)], axis=1)

    def nearest_codes(self, k: int) -> Best:
        return lambda cell, q, x: kernels.nearest(Metric.L2, self.asked(cell, q), self.meant(x), x["id"].to_numpy(), k, DIGITS, squared=True)

    def search(self, queries: DataFrame, encoded: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        """By approximate squared L2, whatever the metric."""
        found = probe_join(probes(queries, self.centroids, nprobe), encoded, self.nearest_codes(k), ["id", "codes"])
        return ranked(found, k).select("query_id", "rank", "id", "distance")

    def search_reranked(self, queries: DataFrame, encoded: DataFrame, k: int, metric: Metric = Metric.L2, nprobe: int = 32, rerank_k: int = 100) -> DataFrame:
        """The best max(rerank_k, k) by codes, ranked again by their exact distance; `encoded` holds the vectors.

        If that many are all rows, the codes leave none out; if they are more than `SENT`, they aren't sent (`_by_places`).
        """
        m = max(rerank_k if rerank_k > 0 else 100, k)
        if m > SENT:
            if m < encoded.count():
                return self._by_places(queries, encoded, k, metric, nprobe, m)
            found = probe_join(probes(queries, self.centroids, nprobe), encoded, nearest_vectors(metric, k), ["id", "vector"])
            return ranked(found, k).select("query_id", "rank", "id", "distance")
        exact = lambda _cell, q, x, i, j: of_pairs(metric, q, kernels.matrix(x["vector"]), i, j)
        found = probe_join(probes(queries, self.centroids, nprobe), encoded, self.nearest_codes(m), ["id", "codes", "vector"], {"exact": exact})
        best = ranked(found, m).select("query_id", "id", F.col("exact").alias("distance"))
        return ranked(best, k).select("query_id", "rank", "id", "distance")

    def _by_places(self, queries: DataFrame, encoded: DataFrame, k: int, metric: Metric, nprobe: int, m: int) -> DataFrame:
        """The same from the other end: the nearest by exact distance, of which those stay whose place by codes is among the first m.

        A place is the number of rows of the probed cells that codes put before; tasks count them.  Queries that keep fewer than k are
        asked again for four times as many, until they keep k or have seen all their rows.  A query never sends more than that.
        """
        code = lambda cell, q, x, i, j: of_pairs(Metric.L2, self.asked(cell, q), self.meant(x), i, j, squared=True)

        def places(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            asking, meant, ids, got = self.asked(int(key[0]), kernels.matrix(q["query"])), self.meant(x), x["id"].to_numpy(), []
            centre = meant.mean(0)
            a, b = asking - centre, meant - centre
            qa, xb = (a * a).sum(1), (b * b).sum(1)
            a32, b32 = np.hstack([a, np.ones((len(a), 1))]).astype(np.float32), np.hstack([-2 * b, xb[:, None]]).astype(np.float32)
            error = (a.shape[1] + 8) * 2.0**-23 * (qa + 2 * xb.max()) + 2e-6
            step = max(1, 4_000_000 // len(x))
            for lo in range(0, len(q), step):
                rough = a32[lo : lo + step] @ b32.T  # squares without that of the query, off by less than its error
                for n, (row, inorder, own, codes, qid) in enumerate(zip(rough, np.sort(rough, axis=1), q["ids"].iloc[lo:], q["codes"].iloc[lo:], q["query_id"].iloc[lo:]), lo):
                    low, high = (codes - qa[n] - error[n]).astype(np.float32), (codes - qa[n] + error[n]).astype(np.float32)
                    before = np.searchsorted(inorder, low)
                    for t in np.flatnonzero(np.searchsorted(inorder, high, "right") > before):  # too near to tell: exactly; ties go to the smaller id
                        near = np.flatnonzero((row >= low[t]) & (row <= high[t]))
                        d = np.round(((asking[n] - meant[near]) ** 2).sum(1), DIGITS)
                        before[t] += ((d < codes[t]) | ((d == codes[t]) & (ids[near] < own[t]))).sum()
                    got.append((qid, own, before))
            return pd.DataFrame({"query_id": np.repeat([g[0] for g in got], [len(g[1]) for g in got]), "id": np.concatenate([g[1] for g in got]), "n": np.concatenate([g[2] for g in got])})

        queries, wanted, out = queries.select("query_id", "query"), 2 * k, None
        while True:
            asked = probes(queries, self.centroids, nprobe)
            first = ranked(probe_join(asked, encoded, nearest_vectors(metric, wanted), ["id", "codes", "vector"], {"code": code}), wanted).drop("rank").checkpoint()
            lists = first.groupBy("query_id").agg(F.collect_list(F.struct("id", "code")).alias("held")).select("query_id", F.col("held.id").alias("ids"), F.col("held.code").alias("codes"))
            counts = by_cell(asked.join(lists, "query_id"), encoded, places, ["query_id", "query", "ids", "codes"], ["id", "codes"], "query_id long, id long, n long")
            place = counts.groupBy("query_id", "id").agg(F.sum("n").alias("n"))
            kept = first.join(place, ["query_id", "id"]).withColumn("stays", F.col("n") < m).checkpoint()
            full = kept.groupBy("query_id").agg(((F.count_if("stays") >= k) | (F.count("*") < wanted)).alias("full"))
            done = kept.where("stays").join(full.where("full"), "query_id", "left_semi").select("query_id", "id", "distance")
            out = done if out is None else out.unionByName(done)
            short = full.where(~F.col("full")).select("query_id")
            if short.isEmpty():
                return ranked(out, k).select("query_id", "rank", "id", "distance")
            queries, wanted = queries.join(short, "query_id", "left_semi"), 4 * wanted
