"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order and posted, with the place, in each of those pivots'
inverted files.  A query's own ordered pivots name the files to read; the postings give the footrule distance of the
two orders (a missing pivot counts as one place beyond the last), and the best by footrule are reranked exactly.

Largest inner products reduce to smallest angles with one more coordinate, sqrt(longest^2 - |v|^2), which is used to
order pivots only; scores are inner products of the original vectors in double precision.

The vectors are dealt at random into blocks of bounded size, each with inverted files of its own, and the queries
into blocks that meet each vector block once; a block's best are reranked there, so only the k best of each block move.
The rerank takes a fixed share of every block, so the work is the same for each query and block, and what ties with the
last of it.  Equal vectors of a block are posted once with all their ids, so copies neither crowd the share nor are cut by it.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; a query's candidates are the
vectors of its own length (each length is a pass of its own); with fewer candidates than k, all are returned; equal
scores go to the smaller id; repeated ids are candidates each, except the query's own id, which is never one; an id that is
null takes no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

PIVOTS = 256
KEPT_PIVOTS = 64
#: Share of a block's vectors that is reranked, and the least number.
RERANK_SHARE = 0.15
RERANK_LEAST = 400
#: Vectors of a block, queries of a block, and the numbers that either holds at most.
BLOCK = 8192
QUERY_BLOCK = 4096
BLOCK_FLOATS = 1 << 22
SEED = 11
#: Rows of the hash sample that pivots are chosen from, and the cosine above which two would see the same.
PIVOT_SAMPLE = 4096
PIVOT_COSINE = 0.5


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v): rows of `vec_id`, `embedding` whose vectors can take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors whose angles to a query order as inner products with it do."""
    rest = np.sqrt(np.maximum(longest * longest - (x * x).sum(1), 0.0))
    return np.column_stack([x, rest]) / longest


def ordered_pivots(x: np.ndarray, pivots: np.ndarray, kept: int) -> np.ndarray:
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :kept]


def spread_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` of the rows, taken in order but those first that are not close to a taken one: a large group
    of near copies would else be most of the pivots and tell the rest apart badly."""
    taken, passed = np.zeros(0, dtype=np.int64), []
    for i in range(len(x)):
        if len(taken) == count:
            break
        if len(taken) and (x[taken] @ x[i]).max() > PIVOT_COSINE:
            passed.append(i)
        else:
            taken = np.append(taken, i)
    return x[np.concatenate([taken, np.array(passed, dtype=np.int64)])[:count]]


class InvertedFiles:
    """Postings of one block: for each pivot, the vectors that have it among their nearest, and at which place."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, kept: int):
        orders = ordered_pivots(x, pivots, kept)
        self.kept, self.n = orders.shape[1], len(x)
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        self.owner = (by // self.kept).astype(np.int32)
        self.gain = (by % self.kept).astype(np.int32)
        self.bounds = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def nearest(self, order: np.ndarray, m: int, ties: bool = False) -> np.ndarray:
        """The m vectors of least footrule distance to a query's ordered pivots; with `ties`, all that tie with the m-th too."""
        k = self.kept
        # all distances but for a constant: what each shared pivot saves against both sides missing it
        saved = np.zeros(self.n, dtype=np.int32)
        for place, p in enumerate(order.tolist()):
            a, b = self.bounds[p], self.bounds[p + 1]
            at = self.gain[a:b]
            saved[self.owner[a:b]] += (k - place) + (k - at) - np.abs(at - place)
        if m >= self.n:
            return np.arange(self.n)
        return np.flatnonzero(saved >= np.partition(saved, self.n - m)[self.n - m]) if ties else np.argpartition(-saved, m - 1)[:m]


class Nodes:
    """The different vectors of a block, each with its rows in order of id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        """`x` in order of `ids`."""
        self.ids = ids
        # adding zero makes -0.0 equal to 0.0
        self.of, first = pd.factorize(np.array([r.tobytes() for r in x + 0.0], dtype=object))
        self.rows = np.argsort(self.of, kind="stable")
        self.size = np.bincount(self.of, minlength=len(first))
        self.start = np.cumsum(self.size) - self.size
        self.x = x[self.rows[self.start]]

    def best(self, c: np.ndarray, q: np.ndarray, qid: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k rows of largest inner product with `q` among the nodes `c`, rows of the query's own id left out."""
        own = self.of[np.searchsorted(self.ids, qid, "left") : np.searchsorted(self.ids, qid, "right")]
        left = self.size[c] - (own[:, None] == c[None, :]).sum(0)
        c = c[left > 0]
        # summed row by row: equal vectors score alike in whatever block and place
        s = (self.x[c] * q).sum(1)
        if len(c) > k:
            # everything that ties with the k-th stays until ids decide
            top = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
            c, s = c[top], s[top]
        take = np.minimum(self.size[c], k + len(own))
        rows = self.rows[np.repeat(self.start[c] - (np.cumsum(take) - take), take) + np.arange(take.sum())]
        ids, s = self.ids[rows], np.repeat(s, take)
        ids, s = ids[ids != qid], s[ids != qid]
        at = np.lexsort((ids, -s))[:k]
        return ids[at], s[at]


def search(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = PIVOTS, kept: int = KEPT_PIVOTS, share: float = RERANK_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`."""
    rows = materialise(usable(vectors), "permutation")
    norm = F.sqrt(F.max(F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * double(x))")))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), norm.alias("longest"), F.count_if(F.col("id") % every == 0).alias("asks")).orderBy("dim").collect()
    passes = [_search_length(rows.where(F.size("v") == r["dim"]), r, k, every, pivots, kept, share) for r in sizes]
    if not passes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = reduce(DataFrame.unionByName, passes)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_length(rows: DataFrame, size: Row, k: int, every: int, pivots: int, kept: int, share: float) -> DataFrame:
    """(query_id, vec_id, score): the k best of every block for each query, among vectors of one length."""
    longest, schema = size["longest"], "query_id long, vec_id long, score double"
    most = max(1, BLOCK_FLOATS // size["dim"])
    sample = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(PIVOT_SAMPLE).select("v").toPandas()["v"]
    piv = spread_pivots(lift(stacked(sample), longest), pivots)
    n_blocks, q_blocks = max(1, -(-size["n"] // min(BLOCK, most))), max(1, -(-size["asks"] // min(QUERY_BLOCK, most)))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).cast("int")
    q_block = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(q_blocks)).cast("int")
    data = rows.select("id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"), F.lit(False).alias("asks"))
    asks = rows.where(F.col("id") % every == 0).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), q_block.alias("q_block"), F.lit(True).alias("asks"))

    def meet(_key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asking = pdf["asks"].to_numpy()
        queries, mine = pdf[asking], pdf[~asking].sort_values("id", kind="stable")
        out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(queries) or not len(mine):
            return out
        x, q = stacked(mine["v"]), stacked(queries["v"])
        nodes = Nodes(x, mine["id"].to_numpy())
        files = InvertedFiles(lift(nodes.x, longest), piv, kept)
        orders = ordered_pivots(np.column_stack([q, np.zeros(len(q))]), piv, kept)
        m = max(RERANK_LEAST, 4 * k, int(share * len(x)))
        got = []
        for qid, qv, order in zip(queries["id"].to_numpy(), q, orders):
            best, s = nodes.best(files.nearest(order, m, ties=True), qv, qid, k)
            got.append((np.full(len(best), qid), best, s))
        return pd.DataFrame({name: np.concatenate(col) for name, col in zip(out.columns, zip(*got))})

    return data.unionByName(asks).groupBy("block", "q_block").applyInPandas(meet, schema)
