import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverline.functions import kernels
from quiverline.operators import graph, inverted, kmeans, lsh, sq, topk
from quiverline.types import Invalid, Metric

DIM, N, NQ, K = 16, 400, 20, 10


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(99)
    x, q = rng.normal(size=(N, DIM)).astype(np.float32) * rng.uniform(0.5, 3, (N, 1)).astype(np.float32), rng.normal(size=(NQ, DIM)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(4).cache()
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, query array<float>").cache()
    return rows, asks, x.astype(float), q.astype(float)


def truth(metric, x, q, k=K):
    d = np.round(kernels.distances(metric, q, x), 6)
    return {i: np.lexsort((np.arange(len(x)), d[i]))[:k].tolist() for i in range(len(q))}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def recall(df, want):
    got = found(df)
    return np.mean([len(set(got.get(i, [])) & set(w)) / len(w) for i, w in want.items()])


@pytest.mark.parametrize("metric", list(Metric))
def test_exact_search(data, metric):
    rows, asks, x, q = data
    want = truth(metric, x, q)
    assert found(topk.knn(asks, rows, K, metric)) == want
    assert found(topk.knn_sql(asks, rows, K, metric)) == want


def test_single_query_and_bounds_of_k(data):
    rows, asks, x, q = data
    got = [r["id"] for r in topk.knn_single(rows, q[0].tolist(), K, Metric.L1).orderBy("rank").collect()]
    assert got == truth(Metric.L1, x, q)[0]
    assert topk.knn(asks, rows, 0).count() == 0
    assert topk.knn_single(rows, q[0].tolist(), 10_000).count() == N
    assert topk.knn(asks.limit(0), rows, 3).count() == 0
    assert topk.knn(asks, rows.limit(0), 3).count() == 0


def test_queries_in_several_blocks(data, monkeypatch):
    rows, asks, x, q = data
    monkeypatch.setattr(topk, "BLOCK_FLOATS", DIM * 7)
    assert topk.blocks(asks, "query")[0] > 1
    assert found(topk.knn(asks, rows, K)) == found(topk.knn_sql(asks, rows, K)) == truth(Metric.L2, x, q)
    index = graph.build_small_world(rows, Metric.L2, 16, 64, part_rows=150)
    assert found(graph.search(asks, index, K, 1000)) == truth(Metric.L2, x, q)
    low, high = sq.ranges(rows)
    assert recall(sq.search(asks, sq.encode(rows, low, high), low, high, K), truth(Metric.L2, x, q)) >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, [1.0]) for i in (5, 3, 9)], "id long, vector array<float>")
    asks = spark.createDataFrame([(0, [1.0])], "query_id long, query array<float>")
    assert found(topk.knn(asks, rows, 2)) == {0: [3, 5]}


def test_scalar_quantisation(data):
    rows, asks, x, q = data
    low, high = sq.ranges(rows)
    codes = sq.encode(rows, low, high)
    back = np.array([r["vector"] for r in sq.decode(codes, low, high).orderBy("id").collect()])
    assert np.abs(back - x).max() <= (np.array(high) - np.array(low)).max() / 255 / 2 + 1e-6
    assert found(sq.search(asks, codes, low, high, K)) == truth(Metric.L2, back, q)


def test_flat_range_is_the_middle_code(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "id long, vector array<float>")
    assert [r["codes"] for r in sq.encode(rows, *sq.ranges(rows)).orderBy("id").collect()] == [[128, 0], [128, 255]]


def test_inverted_file(data, monkeypatch):
    rows, asks, x, q = data
    monkeypatch.setattr(inverted, "CELL_ROWS", 25)  # large cells are dealt over several tasks
    ivf = inverted.InvertedFile.train(rows, 8, 10)
    enc = ivf.encode(rows)
    want = truth(Metric.COSINE, x, q)
    assert found(ivf.search(asks, enc, K, Metric.COSINE, 8)) == want
    assert recall(ivf.search(asks, enc, K, Metric.COSINE, 4), want) >= 0.5


def test_kmeans_keeps_centroids_without_rows(spark):
    rows = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "id long, vector array<float>")
    new, n = kmeans.step(rows, np.array([[0.4], [50.0]]))
    assert new.tolist() == [[0.5], [50.0]] and n.tolist() == [2, 0]
    with pytest.raises(Invalid):
        kmeans.first_rows(rows, 3)


@pytest.mark.parametrize("eta", [0.0, 0.2])
def test_product_codes_and_rerank(data, eta):
    rows, asks, x, q = data
    pq = inverted.ProductQuantizer.train(rows, 8, 4, 4, rounds=10, eta=eta)
    enc = pq.encode(rows, keep_vector=True).cache()
    want = truth(Metric.L2, x, q)
    assert recall(pq.search(asks, enc, K, 8), want) >= 0.3
    assert recall(pq.search_reranked(asks, enc, K, Metric.L2, 8, 100), want) >= 0.8
    with pytest.raises(Invalid):
        inverted.ProductQuantizer.train(rows, 8, 5, 4)


def test_hashing(data):
    rows, asks, x, q = data
    for metric in (Metric.L2, Metric.COSINE):
        index = lsh.Lsh.gaussian(DIM, metric, tables=10, functions=4, width=10.0)
        assert recall(index.search(asks, K, index.postings(rows, keep_vector=True)), truth(metric, x, q)) >= 0.5


@pytest.mark.parametrize("make", [graph.build_small_world, graph.build_pruned_flat])
def test_graphs(data, make):
    rows, asks, x, q = data
    index = make(rows, Metric.L2, 16, 64, part_rows=150)
    assert index.count() >= 2
    want = truth(Metric.L2, x, q)
    assert recall(graph.search(asks, index, K, 64), want) >= 0.9
    assert found(graph.search(asks, index, K, 1000)) == want
    assert graph.search(asks, index, 0).count() == 0


def test_graphs_pass_over_rows_that_are_gone(data, spark):
    rows, asks, x, q = data
    left = np.flatnonzero(np.arange(N) % 3 != 0)
    want = {i: [int(left[j]) for j in got] for i, got in truth(Metric.L2, x[left], q).items()}
    for make in (graph.build_small_world, graph.build_pruned_flat):
        index = make(rows, Metric.L2, 16, 64, part_rows=150)
        gone = rows.where("id % 3 = 0").select("id")
        assert found(graph.search(asks, index, K, 1000, gone)) == want
        assert recall(graph.search(asks, index, K, 32, gone), want) >= 0.9
        assert graph.search(asks, index, K, 32, rows.select("id")).count() == 0


def test_links_of_graphs(data):
    """Links below full width: every node is reached on the ground, lists keep their bounds."""
    rows, _, x, _ = data
    small, flat = graph.small_world(np.arange(N), x, Metric.L2, 8, 64), graph.pruned_flat(np.arange(N), x, Metric.L2, 16, 64)
    for g, most in ((small, 16), (flat, 16)):
        links = g.layers[0]
        assert max(map(len, links.values())) <= most and all(n not in out for n, out in links.items())
        seen, todo = {g.entry}, [g.entry]
        while todo:
            new = [m for m in links.get(todo.pop(), ()) if m not in seen]
            seen.update(new)
            todo += new
        assert len(seen) >= 0.99 * N


def test_training_lowers_the_error(data):
    rows, _, x, _ = data
    error = lambda c: kernels.l2_squared(x, c).min(1).mean()
    first = kmeans.plus_plus(rows, 8)
    trained = kmeans.lloyd(rows, first, 100)
    assert error(trained) < error(first) and len(np.unique(first, axis=0)) == 8
    assert np.abs(kmeans.step(rows, trained)[0] - trained).max() < 1e-5
    coarse = inverted.ProductQuantizer.train(rows, 4, 4, 4, rounds=0)
    fine = inverted.ProductQuantizer.train(rows, 4, 4, 4, rounds=20)

    def lost(pq):
        cell = kmeans.nearest(x, pq.centroids)
        codes = pq._codes(x, cell)
        return ((x - pq.centroids[cell] - np.concatenate([pq.codebooks[s][codes[:, s]] for s in range(4)], axis=1)) ** 2).sum(1).mean()

    assert lost(fine) < lost(coarse)


def test_random_query_is_of_length_one():
    a, b = topk.random_query(9, 1), topk.random_query(9, 2)
    assert abs(np.linalg.norm(a) - 1) < 1e-6 and a != b and a == topk.random_query(9, 1)


def test_recall_report(data):
    rows, asks, *_ = data
    exact = topk.knn(asks, rows, K)
    assert topk.recall(exact, exact).agg(F.min("recall")).first()[0] == 1.0
    assert topk.recall(exact.limit(0), exact).agg(F.max("recall")).first()[0] == 0.0


@pytest.mark.parametrize("metric", list(Metric))
def test_screened_search_equals_all_distances(metric):
    """Vectors far from the origin, copies, zeros and huge values: the same rows as all exact distances give."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x = (x > 0).astype(float) if metric == Metric.HAMMING else x
    ids = rng.permutation(len(x))
    for q, rows, k in ((x[:90], x, 10), (x[:90] + 1000, x + 1000, 10), (x[:30], np.repeat(x[:30], 100, 0), 7), (x[:9], np.zeros_like(x), 3), (x[:9] * 1e20, x * 1e20, 5), (x[:9], x[:20], 50)):
        i, j, d = kernels.nearest(metric, q, rows, ids[: len(rows)], k, topk.DIGITS)
        all_d = np.round(kernels.distances(metric, q, rows), topk.DIGITS)
        a, b = kernels.top_k(all_d, ids[: len(rows)], k)
        assert i.tolist() == a.tolist() and j.tolist() == b.tolist() and np.allclose(d, all_d[a, b], rtol=1e-9, atol=2e-6)


def test_many_reranked_rows_are_not_sent(data, monkeypatch):
    """Places by codes counted in the tasks, several rounds of them, give what sending all m rows gives."""
    rows, asks, *_ = data
    pq = inverted.ProductQuantizer.train(rows, 8, 4, 4, rounds=10, eta=0.2)
    enc = pq.encode(rows, keep_vector=True).cache()
    monkeypatch.setattr(inverted, "ASK_ROWS", 10)
    for m in (15, 60):
        monkeypatch.setattr(inverted, "SENT", 256)
        want = found(pq.search_reranked(asks, enc, K, Metric.L2, 6, m))
        monkeypatch.setattr(inverted, "SENT", 10)
        assert found(pq.search_reranked(asks, enc, K, Metric.L2, 6, m)) == want
    assert found(pq.search_reranked(asks, enc, K, Metric.L2, 8, 100_000)) == found(topk.knn(asks, rows, K))


def test_many_pairs_leave_the_form_in_expressions(data, monkeypatch):
    rows, asks, x, q = data
    monkeypatch.setattr(topk, "SQL_PAIRS", 100)
    plan = topk.knn_sql(asks, rows, K)._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and found(topk.knn_sql(asks, rows, K)) == truth(Metric.L2, x, q)


def test_full_width_over_many_small_parts(data):
    """Several parts a task and several blocks of queries; builds keep every node within reach."""
    rows, asks, x, q = data
    for make in (graph.build_small_world, graph.build_pruned_flat):
        index = make(rows, Metric.L2, 4, 16, part_rows=20)
        assert found(graph.search(asks, index, K, 1000)) == truth(Metric.L2, x, q)
    for g in (graph.small_world(np.arange(N), x, Metric.L2, 3), graph.pruned_flat(np.arange(N), x, Metric.L2, 4, 16)):
        assert len(g.reached()) == N


def test_pairs_of_blocks_are_a_task_each(spark):
    """The numbers that pairs of blocks get fall to as many partitions, so no task has two pairs."""
    for n in (1, 7, 24):
        keys = spark.createDataFrame([(k,) for k in topk.spread(spark.range(1), n)], "pair int")
        parts = keys.repartition(n, "pair").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts == n == keys.count()


def test_a_known_number_of_rows_is_not_counted(data, monkeypatch):
    """Codes that are dealt to blocks by a known bound of their number give the same result, and aren't read for it."""
    rows, asks, _, _ = data
    low, high = sq.ranges(rows)
    codes, counted, count = sq.encode(rows, low, high), [], topk.blocks
    want = found(sq.search(asks, codes, low, high, K))
    monkeypatch.setattr(topk, "BLOCK_FLOATS", DIM * 10)
    monkeypatch.setattr(topk, "blocks", lambda rows, vector: counted.append(vector) or count(rows, vector))
    assert found(sq.search(asks, codes, low, high, K, most=2 * N // 20)) == want and counted == ["query"]
