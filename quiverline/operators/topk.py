"""Exact k nearest neighbours, for one query or many.

Queries are `(query_id, query)`, rows `(id, vector)`, results `(query_id, rank, id, distance)`, nearest first, ties to the
smaller id.  Distances are rounded to `DIGITS` places before they rank, so that engines agree on ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels, metrics
from ..types import Metric

DIGITS = 6
#: Numbers that a block of queries, or of the rows that several such blocks meet, holds at most.
BLOCK_FLOATS = 4_000_000
#: Queries from which the rows are dealt anew to all cores.
MANY_QUERIES = 500
#: Pairs of a query and a row that the form in built-in expressions takes at most.
SQL_PAIRS = 1_000_000
FOUND = "query_id long, id long, distance double"


def ranked(found: DataFrame, k: int, by: str = "distance") -> DataFrame:
    """The k best rows of each query, none for k <= 0; Spark limits each task to k a query before it shuffles."""
    if k <= 0:
        return found.withColumn("rank", F.lit(0)).limit(0)
    w = Window.partitionBy("query_id").orderBy(F.col(by), F.col("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 0))


def random_query(dim: int, seed: int | None = None) -> list[float]:
    """A unit vector of a random direction."""
    x = np.random.default_rng(seed).standard_normal(dim)
    return (x / max(float(np.linalg.norm(x)), 1e-9)).tolist()


def knn_sql(queries: DataFrame, rows: DataFrame, k: int, metric: Metric = Metric.L2) -> DataFrame:
    """The readable form, in built-in expressions; the queries are the broadcast side, so more than a block of them take the fast form.

    So do more than `SQL_PAIRS` pairs: lambdas over arrays are interpreted, and take 20 microseconds a pair.
    """
    q_blocks, n = blocks(queries, "query")
    if q_blocks > 1 or n * rows.count() > SQL_PAIRS:
        return knn(queries, rows, k, metric)
    pairs = rows.select("id", "vector").join(F.broadcast(queries.select("query_id", "query")))
    d = F.round(metrics.distance(metric, F.col("query"), F.col("vector")), DIGITS)
    return ranked(pairs.select("query_id", "id", d.alias("distance")), k).select("query_id", "rank", "id", "distance")


def blocks(rows: DataFrame, vector: str) -> tuple[int, int]:
    """(blocks of at most `BLOCK_FLOATS` numbers or so that the rows make, the rows' number)."""
    n, d = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    return -(-n * max(1, d or 1) // BLOCK_FLOATS), n


def dealt(rows: DataFrame, id: str, n: int, name: str) -> DataFrame:
    """`rows` with the number of the block that the id falls to."""
    return rows.withColumn(name, F.pmod(F.xxhash64(id), F.lit(max(1, n))).cast("int"))


def in_each(rows: DataFrame, n: int, name: str) -> DataFrame:
    """A copy of `rows` for each of n blocks."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1))))


def spread(rows: DataFrame, n: int) -> list[int]:
    """n numbers that Spark's hash deals to n partitions, one to each, so that n groups are n tasks of which none has two."""
    asked = rows.sparkSession.range(0, 64 * n, 1, 1).select(F.col("id").cast("int").alias("key"))
    first: dict[int, int] = {}
    for r in asked.select("key", F.pmod(F.hash("key"), F.lit(n)).alias("at")).collect():
        first.setdefault(r["at"], r["key"])
    # no partition is ever left out, or else some other has two
    return [first.get(at, 64 * n + at) for at in range(n)]


def scan(queries: DataFrame, rows: DataFrame, k: int, metric: Metric, vectors: Callable[[pd.DataFrame], np.ndarray], columns: list[str], most: int | None = None) -> DataFrame:
    """Queries against all rows: each task keeps the k best of its rows for each query, and only those move.

    `vectors(batch)` gives the vectors of a batch with `columns`, `id` and another.  One block of queries goes with the tasks,
    which pass over the rows once.  More of them are dealt to blocks, as are the rows, and each pair of blocks is a task; neither
    side is gathered.  There are a few tasks a core at least, as many for each.  `most` is a number of rows that is known to be no
    smaller than theirs, and saves counting them.
    """

    def best(q: np.ndarray, qid: np.ndarray, batch: pd.DataFrame) -> pd.DataFrame:
        i, j, d = kernels.nearest(metric, q, vectors(batch), batch["id"].to_numpy(), k, DIGITS)
        return pd.DataFrame({"query_id": qid[i], "id": batch["id"].to_numpy()[j], "distance": d})

    queries, rows = queries.select("query_id", "query"), rows.select(*columns)
    q_blocks, n = blocks(queries, "query")
    if not n:
        return ranked(rows.sparkSession.createDataFrame([], FOUND), k).select("query_id", "rank", "id", "distance")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if q_blocks <= 1:
        block = queries.toPandas()
        q, qid = kernels.matrix(block["query"]), block["query_id"].to_numpy()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            for b in batches:
                if len(b):
                    new = best(q, qid, b)
                    held = new if held is None else pd.concat([held, new]).sort_values(["query_id", "distance", "id"]).groupby("query_id").head(k)
            if held is not None:
                yield held

        if n > MANY_QUERIES:  # few files would be few tasks
            rows = rows.repartition(2 * cores, "id")
        found = rows.mapInPandas(run, FOUND)
    else:
        # as many numbers a row as a query
        r_blocks = max(1, blocks(rows, next(c for c in columns if c != "id"))[0] if most is None else -(-q_blocks * most // n))
        more = max(1, -(-3 * cores // (q_blocks * r_blocks)))  # smaller blocks of queries if the pairs would be few
        while q_blocks * r_blocks * more % cores and q_blocks * r_blocks * more < 6 * cores:
            more += 1
        q_blocks, pairs = q_blocks * more, q_blocks * more * r_blocks

        def meet(ask: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(ask) or not len(x):
                return pd.DataFrame({"query_id": [], "id": [], "distance": []})
            return best(kernels.matrix(ask["query"]), ask["query_id"].to_numpy(), x)

        pair = F.get(F.lit(spread(rows, pairs)), F.col("q_block") * r_blocks + F.col("r_block")).alias("pair")
        left = in_each(dealt(queries, "query_id", q_blocks, "q_block"), r_blocks, "r_block").select(pair, "query_id", "query").repartition(pairs, "pair")
        right = in_each(dealt(rows, "id", r_blocks, "r_block"), q_blocks, "q_block").select(pair, *columns).repartition(pairs, "pair")
        found = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(meet, FOUND)
    return ranked(found, k).select("query_id", "rank", "id", "distance")


def knn(queries: DataFrame, rows: DataFrame, k: int, metric: Metric = Metric.L2, most: int | None = None) -> DataFrame:
    """The fast form: one pass over the rows, told apart by matrix products."""
    return scan(queries, rows, k, metric, lambda b: kernels.matrix(b["vector"]), ["id", "vector"], most)


def knn_single(rows: DataFrame, query: list[float], k: int, metric: Metric = Metric.L2) -> DataFrame:
    """One query: Spark keeps the k best of each task and merges them, without a shuffle of the rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = F.round(metrics.distance(metric, q, F.col("vector")), DIGITS)
    best = rows.select("id", d.alias("distance")).orderBy("distance", "id").limit(max(k, 0))
    return best.select(F.row_number().over(Window.orderBy("distance", "id")).alias("rank"), "id", "distance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact neighbours that were found."""
    hits = found.select("query_id", "id").withColumn("hit", F.lit(1))
    both = exact.select("query_id", "id").join(hits, ["query_id", "id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
