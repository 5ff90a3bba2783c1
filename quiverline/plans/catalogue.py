"""The registered queries of the vector engine and, for each, the SQL that another engine runs on the same tables.

Every query covers its whole table.  Searches ask with every vector of the table; single-query forms ask with the vector
of the smallest id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import cache, graph, inverted, kmeans, lsh, sq, topk
from ..operators.collection import Collection, DataType, Field, Schema
from ..operators.inverted import stretched
from ..sources import files
from ..sources.store import VectorTable
from ..streaming import ingest
from ..types import Index, Metric, VectorError

Query = Callable[[SparkSession, str], DataFrame]
K = 10
NLIST, NPROBE, TRAINED_PROBES = 16, 4, 12
PQ_M, PQ_BITS = 8, 4
ETA, RERANK = 0.2, 50
LRU_TEXTS, LRU_USERS = 100, 40


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))


def _asks(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def _bits(rows: DataFrame) -> DataFrame:
    """Signs as 0 and 1, which the Hamming distance is for."""
    return rows.withColumn("vector", F.transform("vector", lambda x: F.when(x >= 0, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float")))


def _first(rows: DataFrame) -> list[float]:
    return list(rows.orderBy("id").select("vector").first()["vector"])


def _out(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "distance")


def _place(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{files.shared_dir(spark)}/table-{uuid.uuid4().hex}"


def _digest(rows: DataFrame) -> DataFrame:
    """A live view in comparable columns."""
    return rows.select(F.col("id"), "label", F.round(metrics._sum(metrics.as_double(F.col("vector"))), 5).alias("total"))


# -- scalar functions -------------------------------------------------------------------------------------------------


def _metric(name: str) -> Query:
    f = {"l2sq": metrics.l2_squared, "l2": metrics.l2, "cosine": metrics.cosine, "ip": metrics.inner_product, "l1": metrics.l1, "hamming": metrics.hamming, "dot": metrics.dot}[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _rows(spark, sf_dir)
        rows = _bits(rows) if name == "hamming" else rows
        one = F.lit(_first(rows))
        return rows.select(F.col("id").alias("vec_id"), F.round(f(one, F.col("vector")), 6).alias("value"))

    return query


def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(metrics.norm(F.col("vector")), 6).alias("value"))


# -- exact search -----------------------------------------------------------------------------------------------------


def _knn(metric: Metric) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _rows(spark, sf_dir)
        rows = _bits(rows) if metric == Metric.HAMMING else rows
        return _out(topk.knn(_asks(rows), rows, K, metric))

    return query


def knn_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form in built-in expressions."""
    rows = _rows(spark, sf_dir)
    return _out(topk.knn_sql(_asks(rows), rows, K, Metric.L2))


def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    found = topk.knn_single(rows, _first(rows), K, Metric.COSINE)
    return found.select(F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "distance")


def knn_k_exceeds_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    found = topk.knn_single(rows, _first(rows), 1_000_000, Metric.L2)
    return found.select(F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "distance")


def knn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(Metric.L2)(spark, sf_dir).select("query_id", "vec_id")


def knn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to the found rows only."""
    rows = _rows(spark, sf_dir)
    found = topk.knn(_asks(rows), rows, K, Metric.COSINE)
    return _out(found).join(rows.select(F.col("id").alias("vec_id"), "label"), "vec_id")


# -- scalar quantisation ----------------------------------------------------------------------------------------------


def sq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.stats(_rows(spark, sf_dir)).select(F.col("pos").cast("int").alias("pos"), "vmin", "vmax")


def sq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    codes = sq.encode(rows, *sq.ranges(rows))
    return codes.select(F.col("id").alias("vec_id"), F.posexplode("codes").alias("pos", "code"))


def sq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    low, high = sq.ranges(rows)
    back = sq.decode(sq.encode(rows, low, high), low, high)
    return back.select(F.col("id").alias("vec_id"), F.posexplode("vector").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def sq_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    low, high = sq.ranges(rows)
    return _out(sq.search(_asks(rows), sq.encode(rows, low, high), low, high, K, Metric.L2))


# -- inverted files ---------------------------------------------------------------------------------------------------


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    new, n = kmeans.step(rows, kmeans.first_rows(rows, NLIST))
    data = [(c, int(n[c]), d, float(new[c, d])) for c in range(NLIST) if n[c] for d in range(new.shape[1])]
    return spark.createDataFrame(data, "cell int, n long, pos int, x double")


def _flat(rows: DataFrame) -> inverted.InvertedFile:
    return inverted.InvertedFile.train(rows, NLIST, rounds=0, seeds="lowest")


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _flat(rows).encode(rows).select(F.col("id").alias("vec_id"), "cell")


def ivf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    ivf = _flat(rows)
    return _out(ivf.search(_asks(rows), ivf.encode(rows), K, Metric.L2, NPROBE))


def ivf_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells probed: equals the exact search."""
    rows = _rows(spark, sf_dir)
    ivf = _flat(rows)
    return _out(ivf.search(_asks(rows), ivf.encode(rows), K, Metric.COSINE, NLIST))


def _product(rows: DataFrame, eta: float = 0.0) -> inverted.ProductQuantizer:
    return inverted.ProductQuantizer.train(rows, NLIST, PQ_M, PQ_BITS, rounds=0, eta=eta, seeds="lowest")


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _product(rows).encode(rows).select(F.col("id").alias("vec_id"), F.posexplode("codes").alias("sub", "code"))


def pq_adc_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    pq = _product(rows)
    return _out(pq.search(_asks(rows), pq.encode(rows), K, NPROBE))


def aq_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    ivf = _flat(rows)

    @F.pandas_udf("array<double>")
    def moved(v: pd.Series, cell: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(list(stretched(x, x - ivf.centroids[cell.to_numpy()], ETA)))

    out = ivf.encode(rows).select(F.col("id").alias("vec_id"), F.posexplode(moved("vector", "cell")).alias("pos", "x"))
    return out.select("vec_id", "pos", F.round("x", 6).alias("x"))


def aq_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    aq = _product(rows, ETA)
    return _out(aq.search_reranked(_asks(rows), aq.encode(rows, keep_vector=True), K, Metric.L2, NPROBE, RERANK))


def aq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained codebooks, three quarters of the cells and a tenth of the rows reranked (200 at least), against the exact search."""
    rows = _rows(spark, sf_dir)
    aq = inverted.ProductQuantizer.train(rows, NLIST, PQ_M, PQ_BITS, rounds=10, eta=ETA)
    found = aq.search_reranked(_asks(rows), aq.encode(rows, keep_vector=True), K, Metric.L2, TRAINED_PROBES, max(200, rows.count() // 10))
    return topk.recall(found, topk.knn(_asks(rows), rows, K))


def pq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained codebooks of 8 bits, ranked by codes alone, against the exact search."""
    rows = _rows(spark, sf_dir)
    pq = inverted.ProductQuantizer.train(rows, NLIST, 2 * PQ_M, 8, rounds=10)
    return topk.recall(pq.search(_asks(rows), pq.encode(rows), K, TRAINED_PROBES), topk.knn(_asks(rows), rows, K))


def sq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    low, high = sq.ranges(rows)
    return topk.recall(sq.search(_asks(rows), sq.encode(rows, low, high), low, high, K), topk.knn(_asks(rows), rows, K))


def ivf_trained_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means++ and Lloyd until nothing moves, three quarters of the cells probed, against the exact search."""
    rows = _rows(spark, sf_dir)
    ivf = inverted.InvertedFile.train(rows, NLIST)
    return topk.recall(ivf.search(_asks(rows), ivf.encode(rows), K, Metric.L2, TRAINED_PROBES), topk.knn(_asks(rows), rows, K))


# -- hashing ----------------------------------------------------------------------------------------------------------


def _hash(rows: DataFrame) -> lsh.Lsh:
    return lsh.Lsh.integer(len(_first(rows)), Metric.L2, tables=4, functions=4, width=2.0)


def lsh_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _hash(rows).postings(rows).select(F.col("id").alias("vec_id"), "tbl", "bucket")


def lsh_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    index = _hash(rows)
    return _out(index.search(_asks(rows), K, index.postings(rows, keep_vector=True)))


def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random planes and buckets wide enough for this recall, against the exact search."""
    rows = _rows(spark, sf_dir)
    index = lsh.Lsh.gaussian(len(_first(rows)), Metric.L2, tables=16, functions=4, width=4.0)
    return topk.recall(index.search(_asks(rows), K, index.postings(rows, keep_vector=True)), topk.knn(_asks(rows), rows, K))


# -- graphs -----------------------------------------------------------------------------------------------------------


def hnsw_full_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam as wide as a part reaches all of a connected graph: equals the exact search."""
    rows = _rows(spark, sf_dir)
    index = graph.build_small_world(rows, Metric.L2, 16, 100, part_rows=250)
    return _out(graph.search(_asks(rows), index, K, width=1000))


def vamana_full_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    index = graph.build_pruned_flat(rows, Metric.L2, 32, 100, 1.2, part_rows=250)
    return _out(graph.search(_asks(rows), index, K, width=1000))


def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    index = graph.build_small_world(rows, Metric.COSINE, 16, 200)
    return topk.recall(graph.search(_asks(rows), index, K, width=50), topk.knn(_asks(rows), rows, K, Metric.COSINE))


def vamana_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    index = graph.build_pruned_flat(rows, Metric.COSINE)
    return topk.recall(graph.search(_asks(rows), index, K, width=100), topk.knn(_asks(rows), rows, K, Metric.COSINE))


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the deterministic inverted file against the exact search."""
    rows = _rows(spark, sf_dir)
    ivf = _flat(rows)
    found = ivf.search(_asks(rows), ivf.encode(rows), K, Metric.L2, NPROBE)
    return topk.recall(found, topk.knn(_asks(rows), rows, K)).select("query_id", F.round("recall", 6).alias("recall"))


# -- tables, transactions, collections --------------------------------------------------------------------------------


def _filled(spark: SparkSession, sf_dir: str) -> VectorTable:
    return VectorTable.from_rows(spark, _place(spark), _rows(spark, sf_dir))


def crud_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_filled(spark, sf_dir).live())


def crud_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _filled(spark, sf_dir)
    t.change_rows(_rows(spark, sf_dir).where("id % 7 = 0").select("id"), "D")
    return _digest(t.live())


def crud_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New vectors keep their rows' labels."""
    t = _filled(spark, sf_dir)
    t.change_rows(_rows(spark, sf_dir).where("id % 11 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector")), "U")
    return _digest(t.live())


def crud_get_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _filled(spark, sf_dir)
    t.delete(3)
    vector, label = t.get(5)
    return spark.createDataFrame([(5, label, round(sum(vector), 5), t.count())], "id long, label string, total double, n long")


def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_filled(spark, sf_dir).page(1, 200))


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted, compacted, opened anew."""
    t = _filled(spark, sf_dir)
    t.change_rows(_rows(spark, sf_dir).where("id % 7 = 0").select("id"), "D")
    t.compact()
    t.close()
    return _digest(VectorTable.open(spark, t.path).live())


def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _filled(spark, sf_dir)
    zero = [0.0] * t.dim
    with t.begin() as x:
        x.delete(0)
        x.insert(1_000_001, zero, "new")
        x.update(1_000_001, [1.0] * t.dim)
        x.update(1, zero)
    return _digest(t.live())


def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit that fails on its last operation leaves nothing behind."""
    t = _filled(spark, sf_dir)
    x = t.begin()
    x.delete(0)
    x.insert(1_000_001, [0.0] * t.dim, "new")
    x.delete(2_000_000)
    try:
        x.commit()
    except VectorError:
        pass
    return _digest(t.live())


def _collection(spark: SparkSession, sf_dir: str, auto: bool = False) -> Collection:
    """Keys are the ids and one; `auto` keys come to the same, as the file is in order of the ids."""
    rows = _rows(spark, sf_dir)
    dim = len(_first(rows))
    schema = Schema((Field("pk", DataType.INT64, is_primary=True, auto_id=auto), Field("name", DataType.VARCHAR, max_length=32), Field("grp", DataType.INT32), Field("vec", DataType.FLOAT_VECTOR, dim=dim)))
    c = Collection.create(spark, _place(spark), schema, Metric.COSINE, Index.LINEAR)
    c.insert_frame(rows.select(*[(F.col("id") + 1).alias("pk")] * (not auto), F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), F.col("label").cast("int").alias("grp"), F.col("vector").alias("vec")))
    return c


def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collection(spark, sf_dir)
    found = c.search(c.rows().select(F.col("pk").alias("query_id"), F.col("vec").alias("query")), 5, output_fields=["name", "grp"])
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("pk"), "distance", "name", "grp")


def collection_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collection(spark, sf_dir)
    gone = c.delete([1, 2, 3, 10_000_000])
    return c.rows().select("pk", "name", "grp", F.lit(gone).alias("gone"))


def collection_auto_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys follow on from the largest."""
    c = _collection(spark, sf_dir, auto=True)
    c.insert([{"name": "a", "grp": 7, "vec": [1.0] * c.table.dim}, {"name": "b", "vec": [0.5] * c.table.dim}])
    return c.rows().select("pk", "name", "grp")


# -- indexes that follow their tables ---------------------------------------------------------------------------------


def _after_changes(index: Index, params: dict) -> Query:
    """Trained on four fifths of the rows; then the rest is inserted, a seventh deleted and an eleventh updated, without another
    training.  Everything is probed, with beams wider than any part, so the result is that of an exact search (of an exact search of the codes, for SQ)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _rows(spark, sf_dir)
        t = VectorTable.from_rows(spark, _place(spark), rows.where("id % 5 <> 0"), Metric.L2, index, params)
        access = t.access().train()
        t.insert_rows(rows.where("id % 5 = 0"))
        t.change_rows(rows.where("id % 7 = 0").select("id"), "D")
        t.change_rows(rows.where("id % 11 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector")), "U")
        return _out(access.search(_asks(rows), K, nprobe=NLIST, width=2 * graph.PART_ROWS))

    return query


# -- cache ------------------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("seq"), F.md5("text").alias("key"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", F.col("user_id").cast("string").alias("key"))
    from .ids import with_ids

    return with_ids(events.withColumn("o", F.struct("ts", "event_id")), 0, "o").select(F.col("id").alias("seq"), "key")


def cache_hits_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.replay(_texts(spark, sf_dir), LRU_TEXTS).select("seq", "key", "hit")


def cache_hits_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.replay(_users(spark, sf_dir), LRU_USERS).select("seq", "key", "hit")


def cache_lru_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.lru_state(_users(spark, sf_dir), LRU_USERS)


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cache.replay(_users(spark, sf_dir), LRU_USERS)
    return out.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count("evicted").alias("evictions"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def embed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different text meets the model once; the embedding here is the length in 4 numbers."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def model(t: pd.Series) -> pd.Series:
        return pd.Series([[float(len(x) % m) for m in (7, 11, 13, 17)] for x in t])

    empty = spark.createDataFrame([], "text string, embedding array<float>")
    out, _ = cache.embed(texts, empty, model)
    return out.select("doc_id", F.round(metrics._sum(metrics.as_double(F.col("embedding"))), 5).alias("total"))


# -- ingest -----------------------------------------------------------------------------------------------------------


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table with one id that repeats another's, one that is negative, and one short vector."""
    rows = _rows(spark, sf_dir)
    bad = spark.createDataFrame([(-5, "neg", [0.0] * 64), (9_000_000, "short", [1.0])], "id long, label string, vector array<float>")
    twice = rows.where("id = 4").withColumn("label", F.lit("again"))
    return rows.select("id", "label", "vector").unionByName(bad).unionByName(twice.select("id", "label", "vector"))


def batch_ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = VectorTable.create(spark, _place(spark), 64)
    _, rejects = ingest.bulk(_arrivals(spark, sf_dir), t)
    return rejects.select("id", "label", "reason")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of Parquet files into a table: its final state."""
    place = _place(spark)
    rows = _rows(spark, sf_dir).select("id", "label", "vector")
    rows.repartition(4, "id").write.parquet(f"{place}/source")
    t = VectorTable.create(spark, f"{place}/table", 64)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/source")
    ingest.start(stream, t, f"{place}/progress", f"{place}/rejects").stop()
    return _digest(t.live())


QUERIES: dict[str, Query] = {
    **{f"metric_{m}": _metric(m) for m in ("l2sq", "l2", "cosine", "ip", "l1", "hamming")},
    "vec_dot": _metric("dot"),
    "vec_norm": vec_norm,
    **{f"knn_{m.name.lower()}": _knn(m) for m in Metric},
    **{f.__name__: f for f in (
        knn_expressions, knn_single, knn_k_exceeds_n, knn_ids, knn_labels, sq_stats, sq_encode, sq_decode, sq_knn, kmeans_step, ivf_assign, ivf_knn,
        ivf_full_probe, ivf_recall, pq_encode, pq_adc_knn, aq_transform, aq_knn, aq_recall, lsh_hash, lsh_knn, hnsw_full_width, vamana_full_width,
        hnsw_recall, vamana_recall, crud_insert, crud_delete, crud_update, crud_get_count, browse_page, snapshot_roundtrip, txn_commit, txn_rollback,
        collection_search, collection_delete, collection_auto_id, cache_hits_texts, cache_hits_users, cache_lru_state, cache_stats, embed_dedupe,
        batch_ingest_rejects, stream_ingest,
        lsh_recall, pq_recall, sq_recall, ivf_trained_recall,
    )},
    "linear_after_changes": _after_changes(Index.LINEAR, {}),
    "sq_after_changes": _after_changes(Index.SQ, {}),
    "ivf_after_changes": _after_changes(Index.IVF, {"ivf_nlist": NLIST}),
    "aq_after_changes": _after_changes(Index.ANISOTROPIC, {"aq_nlist": NLIST, "aq_bits": PQ_BITS, "aq_rerank_k": 100_000}),
    "hnsw_after_changes": _after_changes(Index.HNSW, {}),
    "vamana_after_changes": _after_changes(Index.VAMANA, {}),
}

# -- SQL --------------------------------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_ONE = "one AS (SELECT v AS q FROM e ORDER BY vec_id LIMIT 1)"
_SIGNS = "e AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM embeddings)"
_COS = "1 - greatest(-1, least(1, list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))))"
_DIST = {
    "l2sq": "power(list_distance({a}, {b}), 2)",
    "l2": "list_distance({a}, {b})",
    "cosine": _COS,
    "ip": "-list_inner_product({a}, {b})",
    "dot": "list_inner_product({a}, {b})",
    "l1": "list_sum(list_transform(generate_series(1, len({a})), lambda i: abs({a}[i] - {b}[i])))",
    "hamming": "list_sum(list_transform(generate_series(1, len({a})), lambda i: CASE WHEN {a}[i] <> {b}[i] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))",
}


def _metric_sql(m: str) -> str:
    return f"WITH {_SIGNS if m == 'hamming' else _E}, {_ONE} SELECT vec_id, round({_DIST[m].format(a='q', b='v')}, 6) AS value FROM e, one"


def _top(pairs: str, ctes: str, columns: str = "query_id, rank, vec_id, distance", k: int = K) -> str:
    """The k best of each query of `pairs`, which has query_id, vec_id, distance."""
    return f"WITH {ctes}, pairs AS ({pairs}), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM pairs) SELECT {columns} FROM top WHERE rank <= {k}"


def _knn_sql(m: str, columns: str = "query_id, rank, vec_id, distance") -> str:
    d = _DIST[m].format(a="a.v", b="b.v")
    return _top(f"SELECT a.vec_id AS query_id, b.vec_id, round({d}, 6) AS distance, b.label FROM e a, e b", _SIGNS if m == "hamming" else _E, columns)


_CHANGED = "l AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN list_transform(v, lambda y: -y) ELSE v END AS v FROM e WHERE vec_id % 7 <> 0)"
_AFTER = _top("SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(a.v, b.v), 6) AS distance FROM e a, l b", f"{_E}, {_CHANGED}")


def _single_sql(m: str, k: int) -> str:
    d = _DIST[m].format(a="q", b="v")
    return f"WITH {_E}, {_ONE}, d AS (SELECT vec_id, round({d}, 6) AS distance FROM e, one), r AS (SELECT *, CAST(row_number() OVER (ORDER BY distance, vec_id) AS INT) AS rank FROM d) SELECT rank, vec_id, distance FROM r WHERE rank <= {k}"


_X = "x AS (SELECT vec_id, CAST(i - 1 AS INT) AS pos, v[i] AS x FROM (SELECT vec_id, v, unnest(generate_series(1, len(v))) AS i FROM e))"
_STATS = f"{_X}, s AS (SELECT pos, min(x) AS vmin, max(x) AS vmax FROM x GROUP BY pos)"
_CODES = f"{_STATS}, c AS (SELECT vec_id, pos, CASE WHEN vmax - vmin < 1e-10 THEN 128 ELSE CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x - vmin) / (vmax - vmin))) * 255 + 0.5::DOUBLE) AS INT) END AS code, vmin, vmax FROM x JOIN s USING (pos))"
_BACK = f"{_CODES}, y AS (SELECT vec_id, pos, vmin + code * ((vmax - vmin) / 255) AS x FROM c)"
_UNNESTED = "SELECT vec_id, CAST(i - 1 AS INT) AS pos, v[i] AS x FROM (SELECT vec_id, v, unnest(generate_series(1, len(v))) AS i FROM {})"
_SQ_AFTER = _top(
    "SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(a.v, b.w), 6) AS distance FROM e a, z b",
    f"{_E}, {_CHANGED}, s AS (SELECT pos, min(x) AS vmin, max(x) AS vmax FROM ({_UNNESTED.format('e WHERE vec_id % 5 <> 0')}) GROUP BY pos), "
    f"c AS (SELECT vec_id, pos, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x - vmin) / (vmax - vmin))) * 255 + 0.5::DOUBLE) AS code, vmin, vmax FROM ({_UNNESTED.format('l')}) JOIN s USING (pos)), "
    "z AS (SELECT vec_id, list(vmin + code * ((vmax - vmin) / 255) ORDER BY pos) AS w FROM c GROUP BY vec_id)",
)
_CELLS = f"cents AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS cell, v AS c FROM (SELECT * FROM e ORDER BY vec_id LIMIT {NLIST}))"
_NEAR = f"{_CELLS}, near AS (SELECT vec_id, v, cell, c, row_number() OVER (PARTITION BY vec_id ORDER BY round(power(list_distance(v, c), 2), 6), cell) AS r FROM e, cents), cells AS (SELECT * FROM near WHERE r = 1), probes AS (SELECT vec_id AS query_id, v AS q, cell, c FROM near WHERE r <= {NPROBE})"
_SUB = 64 // PQ_M


def _residual(eta: float, v: str, c: str) -> str:
    r = f"list_transform(generate_series(1, 64), lambda i: {v}[i] - {c}[i])"
    if not eta:
        return r
    along = f"(list_inner_product({r}, {v}) / list_inner_product({v}, {v}))"
    return f"list_transform(generate_series(1, 64), lambda i: {v}[i] - {c}[i] + {eta}::DOUBLE * {along} * {v}[i])"


def _pq(eta: float) -> str:
    """Residuals, codebooks of the first ids, codes, and each query's table."""
    k = 1 << PQ_BITS
    return f"""{_NEAR},
    res AS (SELECT vec_id, cell, {_residual(eta, 'v', 'c')} AS r FROM cells),
    subs AS (SELECT vec_id, cell, s, list_transform(r[s * {_SUB} + 1 : s * {_SUB} + {_SUB}], lambda x: x) AS r FROM res, (SELECT unnest(generate_series(0, {PQ_M - 1})) AS s)),
    book AS (SELECT s, CAST(row_number() OVER (PARTITION BY s ORDER BY vec_id) - 1 AS INT) AS code, list_transform(r, lambda x: round(x, 6)) AS w FROM subs WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {k})),
    codes AS (SELECT vec_id, cell, CAST(s AS INT) AS sub, arg_min(code, {{'d': round(power(list_distance(r, w), 2), 6), 'c': code}}) AS code FROM subs JOIN book USING (s) GROUP BY vec_id, cell, s),
    qres AS (SELECT query_id, cell, {_residual(eta, 'q', 'c')} AS r FROM probes),
    lut AS (SELECT query_id, cell, CAST(s AS INT) AS sub, code, power(list_distance(r[s * {_SUB} + 1 : s * {_SUB} + {_SUB}], w), 2) AS d FROM qres, book),
    adc AS (SELECT query_id, codes.vec_id, round(sum(d), 6) AS distance FROM lut JOIN codes USING (cell, sub, code) GROUP BY query_id, codes.vec_id)"""


_LIVE = "SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings"
_USERS = "a AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, CAST(user_id AS VARCHAR) AS key FROM events)"
_DOCS = "a AS (SELECT doc_id AS seq, md5(text) AS key FROM documents)"


def _replay_sql(stream: str, capacity: int) -> str:
    # an access between two of a key is some other key's last one before the second if it has no later one before it
    return f"""{stream},
    p AS (SELECT seq, key, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS next FROM a),
    n AS (SELECT x.seq, count(DISTINCT y.key) AS others FROM p x JOIN a y ON y.seq > x.prev AND y.seq < x.seq WHERE x.prev IS NOT NULL GROUP BY x.seq),
    h AS (SELECT p.seq, p.key, p.prev IS NOT NULL AND coalesce(others, 0) < {capacity} AS hit FROM p LEFT JOIN n ON n.seq = p.seq)"""


def _lsh_sql() -> str:
    """Hash values from integer arithmetic: the planes as a table, the fold as four steps."""
    steps = []
    for f in range(4):
        last = "2166136261::UBIGINT" if f == 0 else f"h{f - 1}"
        steps.append(f"b{f} AS (SELECT *, ((xor({last}, (b[{f + 1}] & 4294967295)::UBIGINT)) * 16777619) % 4294967296 AS h{f} FROM {'grid' if f == 0 else f'b{f - 1}'})")
    return f"""{_X},
    planes AS (SELECT t, f, d, ((t * 7919 + f * 104729 + d * 1299709 + t * f * d * 31) % 2001 - 1000) / 500.0::DOUBLE AS w FROM range(4) a(t), range(4) b(f), range(64) c(d)),
    proj AS (SELECT vec_id, t, f, sum(x * w) AS p FROM x JOIN planes ON d = pos GROUP BY vec_id, t, f),
    vals AS (SELECT vec_id, t, f, CAST(floor(round((p + ((t * 31 + f * 17) % 100) / 100.0::DOUBLE * 2.0::DOUBLE) / 2.0::DOUBLE, 9)) AS BIGINT) AS val FROM proj),
    grid AS (SELECT vec_id, t, list(val ORDER BY f) AS b FROM vals GROUP BY vec_id, t),
    {', '.join(steps)},
    hashed AS (SELECT vec_id, CAST(t AS INT) AS tbl, CAST(h3 % 16 AS BIGINT) AS bucket FROM b3)"""


ORACLES: dict[str, str] = {
    **{f"metric_{m}": _metric_sql(m) for m in ("l2sq", "l2", "cosine", "ip", "l1", "hamming")},
    "vec_dot": _metric_sql("dot"),
    "vec_norm": f"WITH {_E} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS value FROM e",
    **{f"knn_{m}": _knn_sql(m) for m in ("l2", "cosine", "ip", "l1", "hamming")},
    "knn_expressions": _knn_sql("l2"),
    "knn_single": _single_sql("cosine", K),
    "knn_k_exceeds_n": _single_sql("l2", 1_000_000),
    "knn_ids": _knn_sql("l2", "query_id, vec_id"),
    "knn_labels": _knn_sql("cosine", "query_id, rank, vec_id, distance, CAST(label AS VARCHAR) AS label"),
    "sq_stats": f"WITH {_E}, {_STATS} SELECT pos, vmin, vmax FROM s",
    "sq_encode": f"WITH {_E}, {_CODES} SELECT vec_id, pos, code FROM c",
    "sq_decode": f"WITH {_E}, {_BACK} SELECT vec_id, pos, round(x, 6) AS x FROM y",
    "sq_knn": _top("SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(a.v, b.w), 6) AS distance FROM e a, z b", f"{_E}, {_BACK}, z AS (SELECT vec_id, list(x ORDER BY pos) AS w FROM y GROUP BY vec_id)"),
    "kmeans_step": f"WITH {_E}, {_NEAR}, m AS (SELECT cell, CAST(i - 1 AS INT) AS pos, v[i] AS x FROM (SELECT cell, v, unnest(generate_series(1, 64)) AS i FROM cells)) SELECT cell, count(*) AS n, pos, round(avg(x), 6) AS x FROM m GROUP BY cell, pos",
    "ivf_assign": f"WITH {_E}, {_NEAR} SELECT vec_id, cell FROM cells",
    "ivf_knn": _top("SELECT query_id, cells.vec_id, round(list_distance(q, cells.v), 6) AS distance FROM probes JOIN cells USING (cell)", f"{_E}, {_NEAR}"),
    "ivf_full_probe": _knn_sql("cosine"),
    "ivf_recall": f"WITH {_E}, {_NEAR}, f AS (SELECT query_id, cells.vec_id, round(list_distance(q, cells.v), 6) AS d FROM probes JOIN cells USING (cell)), fr AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM f) WHERE r <= {K}), g AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 6), b.vec_id) AS r FROM e a, e b) SELECT g.query_id, round(count(fr.vec_id) / count(*), 6) AS recall FROM g LEFT JOIN fr ON fr.query_id = g.query_id AND fr.vec_id = g.vec_id WHERE r <= {K} GROUP BY g.query_id",
    "pq_encode": f"WITH {_E}, {_pq(0)} SELECT vec_id, sub, code FROM codes",
    "pq_adc_knn": _top("SELECT * FROM adc", f"{_E}, {_pq(0)}"),
    "aq_transform": f"WITH {_E}, {_pq(ETA)} SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(r[i], 6) AS x FROM (SELECT vec_id, r, unnest(generate_series(1, 64)) AS i FROM res)",
    "aq_knn": _top("SELECT query_id, c.vec_id, round(list_distance(a.v, b.v), 6) AS distance FROM cand c JOIN e a ON a.vec_id = c.query_id JOIN e b ON b.vec_id = c.vec_id", f"{_E}, {_pq(ETA)}, cand AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM adc) WHERE r <= {RERANK})"),
    "lsh_hash": f"WITH {_E}, {_lsh_sql()} SELECT vec_id, tbl, bucket FROM hashed",
    "lsh_knn": _top("SELECT c.query_id, c.vec_id, round(list_distance(a.v, b.v), 6) AS distance FROM cand c JOIN e a ON a.vec_id = c.query_id JOIN e b ON b.vec_id = c.vec_id", f"{_E}, {_lsh_sql()}, cand AS (SELECT DISTINCT p.vec_id AS query_id, q.vec_id FROM hashed p JOIN hashed q USING (tbl, bucket))"),
    "hnsw_full_width": _knn_sql("l2"),
    "vamana_full_width": _knn_sql("l2"),
    "crud_insert": _LIVE,
    "crud_delete": f"SELECT * FROM ({_LIVE}) WHERE id % 7 <> 0",
    "crud_update": f"SELECT id, label, CASE WHEN id % 11 = 0 THEN -total ELSE total END AS total FROM ({_LIVE})",
    "crud_get_count": f"SELECT id, label, total, (SELECT count(*) - 1 FROM embeddings) AS n FROM ({_LIVE}) WHERE id = 5",
    "browse_page": f"SELECT * FROM ({_LIVE}) ORDER BY id LIMIT 200 OFFSET 200",
    "snapshot_roundtrip": f"SELECT * FROM ({_LIVE}) WHERE id % 7 <> 0",
    "txn_commit": f"SELECT id, label, CASE WHEN id = 1 THEN 0 ELSE total END AS total FROM ({_LIVE}) WHERE id <> 0 UNION ALL SELECT 1000001, 'new', 64.0::DOUBLE",
    "txn_rollback": _LIVE,
    "collection_search": f"SELECT query_id + 1 AS query_id, rank, vec_id + 1 AS pk, distance, 'v' || vec_id AS name, label AS grp FROM ({_knn_sql('cosine', 'query_id, rank, vec_id, distance, label')}) WHERE rank <= 5",
    "collection_delete": "SELECT vec_id + 1 AS pk, 'v' || vec_id AS name, label AS grp, 3 AS gone FROM embeddings WHERE vec_id + 1 > 3",
    "collection_auto_id": "SELECT vec_id + 1 AS pk, 'v' || vec_id AS name, label AS grp FROM embeddings UNION ALL SELECT max(vec_id) + 2, 'a', 7 FROM embeddings UNION ALL SELECT max(vec_id) + 3, 'b', NULL FROM embeddings",
    "cache_hits_texts": f"WITH {_replay_sql(_DOCS, LRU_TEXTS)} SELECT seq, key, hit FROM h",
    "cache_hits_users": f"WITH {_replay_sql(_USERS, LRU_USERS)} SELECT seq, key, hit FROM h",
    "cache_lru_state": f"WITH {_USERS} SELECT key, max(seq) AS last_seq FROM a GROUP BY key ORDER BY last_seq DESC LIMIT {LRU_USERS}",
    "cache_stats": f"WITH {_replay_sql(_USERS, LRU_USERS)} SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, greatest(count(*) FILTER (NOT hit) - {LRU_USERS}, 0) AS evictions, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate FROM h",
    "embed_dedupe": "SELECT doc_id, (length(text) % 7 + length(text) % 11 + length(text) % 13 + length(text) % 17)::DOUBLE AS total FROM documents",
    "batch_ingest_rejects": "SELECT -5 AS id, 'neg' AS label, 'bad id' AS reason UNION ALL SELECT 9000000, 'short', 'bad dimension' UNION ALL SELECT 4, 'again', 'repeated id' UNION ALL SELECT vec_id, CAST(label AS VARCHAR), 'repeated id' FROM embeddings WHERE vec_id = 4",
    "stream_ingest": _LIVE,
    **{f"{m}_after_changes": _AFTER for m in ("linear", "ivf", "aq", "hnsw", "vamana")},
    "sq_after_changes": _SQ_AFTER,
}
