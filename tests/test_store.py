import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverline.operators.cache import CachedEmbedder, EmbeddingCache, lru_state, replay, replay_sql
from quiverline.operators.collection import Collection, DataType, Field, Schema
from quiverline.plans.access import Access
from quiverline.plans.ids import with_ids
from quiverline.sources import files
from quiverline.sources.store import VectorTable
from quiverline.streaming import ingest
from quiverline.types import AlreadyExists, Corrupt, Index, Invalid, Metric, NotFound, NotTrained, Params, VectorError


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/t"


def live(t):
    return {r["id"]: (r["label"], list(r["vector"])) for r in t.live().collect()}


def test_point_operations(spark, place):
    with VectorTable.open(spark, place, 2, Metric.COSINE) as t:
        t.insert(1, [1, 0], "a")
        t.insert(2, [0, 1], "é" * 200)
        t.update(1, [0.5, 0.5])
        with pytest.raises(AlreadyExists):
            t.insert(1, [1, 1])
        with pytest.raises(Invalid):
            t.insert(3, [1, 1, 1])
        with pytest.raises(Invalid):
            t.insert(-1, [1, 1])
        with pytest.raises(NotFound):
            t.update(9, [1, 1])
        assert live(t) == {1: ("a", [0.5, 0.5]), 2: ("é" * 127, [0.0, 1.0])}
        t.delete(2)
        with pytest.raises(NotFound):
            t.delete(2)
        with pytest.raises(NotFound) as e:
            t.get(2)
        assert e.value.code == -4 and t.last_error
        t.insert(2, [1, 1], "back")
        assert t.get(2) == ([1.0, 1.0], "back") and t.count() == 2 and t.next_id == 3
    again = VectorTable.open(spark, place, 2, Metric.L2)
    assert again.metric == Metric.COSINE and again.count() == 2
    with pytest.raises(Invalid):
        VectorTable.open(spark, place, 3)
    with pytest.raises(Invalid):
        VectorTable.open(spark, place, read_only=True).insert(7, [0, 0])


def test_batches_compaction_and_corruption(spark, place):
    rows = spark.createDataFrame([([float(i), 1.0],) for i in range(10)], "vector array<float>")
    t = VectorTable.from_rows(spark, place, rows)
    assert sorted(live(t)) == list(range(1, 11))
    with pytest.raises(AlreadyExists):
        t.insert_rows(spark.createDataFrame([(20, [0.0, 0.0]), (3, [0.0, 0.0])], "id long, vector array<float>"))
    assert t.count() == 10
    assert t.change_rows(spark.createDataFrame([(1,), (2,), (99,)], "id long"), "D") == 2
    before = live(t)
    t.compact()
    assert live(VectorTable.open(spark, place)) == before and len(t.manifest["batches"]) == 1
    assert [r["id"] for r in t.page(1, 3).collect()] == [6, 7, 8]
    stale = VectorTable.open(spark, place)
    t.insert(50, [0, 0])
    for change in (lambda: stale.insert(51, [0, 0]), stale.compact, VectorTable.open(spark, place, read_only=True).compact):
        with pytest.raises(VectorError):
            change()
    old = live(stale)
    t.compact()
    assert live(stale) == old and live(t) == old | {50: ("", [0.0, 0.0])}
    plan = t.live()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    t.close()
    with pytest.raises(Invalid):
        t.compact()
    files.replace_text(spark, f"{place}/manifest.json", json.dumps({"body": "{}", "crc32": 1}))
    with pytest.raises(Corrupt):
        VectorTable.open(spark, place, 2)


def test_null_and_bad_rows_are_rejected_with_reasons(spark, place):
    t = VectorTable.create(spark, place, 2)
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 3.0]), (None, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 0.0])], "id long, vector array<float>")
    n, bad = t.insert_valid(rows)
    assert n == 1 and sorted(r["reason"] for r in bad.collect()) == ["bad dimension", "bad dimension", "bad id", "null component", "repeated id", "repeated id"]


def test_transactions(spark, place):
    t = VectorTable.create(spark, place, 2)
    with t.begin() as x:
        x.insert(1, [0, 0], "one")
        x.update(1, [1, 1])
        x.insert(2, [2, 2])
        assert x.op_count == 3
    assert live(t) == {1: ("one", [1.0, 1.0]), 2: ("", [2.0, 2.0])}
    with pytest.raises(RuntimeError, match="boom"), t.begin() as x:
        x.delete(1)
        raise RuntimeError("boom")
    for ops, error in (
        ([("insert", 5, [0, 0]), ("insert", 5, [0, 0])], AlreadyExists), ([("delete", 1), ("insert", 2, [0, 0])], AlreadyExists), ([("delete", 1), ("delete", 1)], NotFound), ([("update", 7, [0, 0])], NotFound),
    ):
        x = t.begin()
        for name, *args in ops:
            getattr(x, name)(*args)
        with pytest.raises(error):
            x.commit()
        assert x.op_count == 0 and x.last_error and t.count() == 2
    with t.begin() as x:
        x.delete(1)
        x.insert(1, [9, 9], "again")
    assert live(t)[1] == ("again", [9.0, 9.0])


@pytest.mark.parametrize("index", list(Index))
def test_access_methods_on_a_table(spark, place, index):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), f"v{i}") for i, v in enumerate(x)], "id long, vector array<float>, label string")
    params = {"ivf_nlist": 8, "ivf_nprobe": 8, "pq_m": 4, "pq_nbits": 4, "aq_nlist": 8, "aq_nprobe": 8, "aq_m": 4, "aq_bits": 4, "aq_rerank_k": 40}
    t = VectorTable.from_rows(spark, place, rows, Metric.L2, index, params)
    if index != Index.LINEAR:
        with pytest.raises(NotTrained):
            Access(t).load()
    Access(t).train()
    again = Access(VectorTable.open(spark, place))
    got = again.search_one(x[17].tolist(), 5)
    assert len(got) == 5 and got == sorted(got, key=lambda r: r[1])
    assert 17 in [r[0] for r in got]
    if index not in (Index.IVF_PQ, Index.SQ):
        assert got[0][0] == 17 and got[0][2] == "v17"
    with pytest.raises(Invalid):
        again.search_one([1.0], 5)
    # the index follows the table: here, in a handle opened later, after a compaction, and after a saved refresh
    far = [9.0] * 8
    t.delete(17)
    t.insert(500, far, "far")
    t.update(3, [8.0] * 8)
    t.insert(17, [7.0] * 8, "back")
    steps = ("live", "opened", "compacted", "refreshed", "compacted again") if index in (Index.IVF, Index.HNSW) else ("live",)
    for step in steps:
        if step.startswith("compacted"):
            t.compact()
        if step == "refreshed":
            Access(t).load().refresh()
        a = Access(t) if step != "opened" else Access(VectorTable.open(spark, place))
        got = a.search_one(far, 3)
        # codes don't tell the three apart, and hashing may miss some
        order = sorted if index in (Index.IVF_PQ, Index.SQ) else list
        want = [(500, "far"), (3, "v3"), (17, "back")][: 1 if index == Index.LSH else 3]
        assert order((r[0], r[2]) for r in got[: len(want)]) == order(want), step
    if index != Index.LINEAR:
        files.replace_text(spark, f"{place}/{json.loads(json.loads(files.read_text(spark, f'{place}/index/current.json'))['body'])['folder']}/model.json", "{}")
        with pytest.raises(Corrupt):
            Access(t).load()


def test_product_codes_refuse_other_metrics(spark, place):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i), 0.0]) for i in range(40)], "id long, vector array<float>")
    t = VectorTable.from_rows(spark, place, rows, Metric.COSINE, Index.IVF_PQ, {"ivf_nlist": 2, "pq_m": 2, "pq_nbits": 4})
    a = Access(t).train()
    with pytest.raises(Invalid):
        a.search_one([1.0, 1.0, 1.0, 1.0], 3)
    with pytest.raises(Invalid):
        Params(pq_nbits=5)


def schema(auto=True):
    return Schema((Field("pk", DataType.INT64, is_primary=True, auto_id=auto), Field("name", DataType.VARCHAR, max_length=5), Field("n", DataType.INT8), Field("doc", DataType.JSON), Field("v", DataType.FLOAT_VECTOR, dim=2)), "d")


def test_schema_rules():
    assert Schema.from_dict(schema().to_dict()) == schema()
    v = Field("v", DataType.FLOAT_VECTOR, dim=2)
    for make in (
        lambda: Field("v", DataType.FLOAT_VECTOR), lambda: Field("s", DataType.VARCHAR, max_length=0), lambda: Field("k", DataType.INT32, is_primary=True), lambda: Field("k", DataType.INT64, auto_id=True),
        lambda: Schema((v,)), lambda: Schema((Field("v", DataType.INT64, is_primary=True), v)), lambda: Schema((Field("k", DataType.INT64, is_primary=True), v, Field("w", DataType.FLOAT_VECTOR, dim=1))),
    ):
        with pytest.raises(Invalid):
            make()


def test_collection(spark, place):
    c = Collection.create(spark, place, schema())
    with pytest.raises(AlreadyExists):
        Collection.create(spark, place, schema())
    assert c.insert([{"name": "a", "n": 1, "doc": {"x": [1]}, "v": [0, 1]}, {"v": [1, 0]}]) == [1, 2]
    assert c.insert({"name": ["b"], "v": [[1, 1]]}) == [3]
    with pytest.raises(Invalid):
        c.insert_frame(spark.createDataFrame([(9, [0.0, 0.0])], "pk long, v array<float>"))
    for bad in ({"v": [1]}, {"v": [0, 0], "zzz": 1}, {"name": "toolong", "v": [0, 0]}, {"n": 300, "v": [0, 0]}, {"pk": 10, "v": [0, 0]}, {"name": "x"}, {"doc": {1, 2}, "v": [0, 0]}):
        with pytest.raises(Invalid):
            c.insert([{"name": "ok", "v": [0, 0]}, bad])
    given = Collection.create(spark, place + "-keys", schema(auto=False))
    assert given.insert([{"pk": 10, "v": [0, 0]}, {"pk": 2, "v": [0, 1]}]) == [10, 2]
    for error, row in ((AlreadyExists, {"pk": 10, "v": [0, 0]}), (Invalid, {"pk": 0, "v": [0, 0]}), (Invalid, {"v": [0, 0]})):
        with pytest.raises(error):
            given.insert([row])
    assert c.num_entities == 3 and c.get(1)["doc"] == '{"x": [1]}' and c.get(2)["name"] is None
    best = c.hits([0.0, 1.0], 2, ["name"])[0]
    assert best[0].id == 1 and best[0]["name"] == best[0].entity.get("name") == "a" and best[0].get("zzz", 5) == 5 and best[0].to_dict()["distance"] == 0
    c.export_json(place + "-json")
    copy = Collection.import_json(spark, place + "-copy", place + "-json")
    assert sorted(map(tuple, copy.rows().collect()), key=str) == sorted(map(tuple, c.rows().collect()), key=str) and copy.insert([{"v": [2, 2]}]) == [4]
    hits = [tuple(r) for r in c.search([[0.0, 1.0], [1.0, 0.0]], 1, output_fields=["name", "pk"]).orderBy("query_id").collect()]
    assert [(h[0], h[2], h[4], h[5]) for h in hits] == [(0, 1, "a", 1), (1, 2, None, 2)]
    with pytest.raises(Invalid):
        c.search([[0.0, 1.0]], 1, output_fields=["zzz"])
    with pytest.raises(Invalid):
        c.search([[0.0, 1.0]], 1, field="name")
    assert c.delete([1, 77]) == 1
    with pytest.raises(NotFound):
        c.get(1)
    c.compact()
    again = Collection.load(spark, place)
    assert {tuple(r)[:2] for r in again.rows().select("pk", "name").collect()} == {(2, None), (3, "b")} and again.description == "d"
    with pytest.raises(NotFound):
        Collection.load(spark, place + "x")


def test_cache_order_and_counts(spark, place):
    c = EmbeddingCache(spark, place, 2, 3)
    for k in "abc":
        c.put(k, [1, 2])
    assert c.get("a") == [1.0, 2.0] and c.get("zz") is None
    c.put("d", [0, 0])
    assert not c.contains("b") and c.contains("a") and (c.stats.hits, c.stats.misses, c.stats.evictions) == (1, 1, 1) and c.stats.hit_rate == 0.5
    assert c.evict("c") and not c.evict("c") and c.stats.evictions == 1
    c.save()
    again = EmbeddingCache(spark, place, 2, 3)
    assert list(again.entries) == ["a", "d"] and again.stats == c.stats
    assert EmbeddingCache(spark, place, 5).count == 0
    with pytest.raises(Invalid):
        c.put("x", [1])
    calls = []
    e = CachedEmbedder(lambda t: calls.append(t) or [len(t), 0], EmbeddingCache(spark, None, 2))
    assert e.embed_batch(["x", "yy", "x"]) == [[1.0, 0.0], [2.0, 0.0], [1.0, 0.0]] and calls == ["x", "yy"]


def test_replays_agree(spark):
    rng = np.random.default_rng(5)
    stream = spark.createDataFrame([(i, str(k)) for i, k in enumerate(rng.integers(0, 12, 300).tolist())], "seq long, key string")
    a = {tuple(r) for r in replay(stream, 5).select("seq", "key", "hit").collect()}
    assert a == {tuple(r) for r in replay_sql(stream, 5).collect()}
    assert lru_state(stream, 5).count() == 5


def test_dense_ids(spark):
    rows = spark.range(1000).withColumn("o", F.xxhash64("id")).drop("id").repartition(7)
    got = [r["id"] for r in with_ids(rows, 5, "o").orderBy("o").collect()]
    assert got == list(range(5, 1005))


def test_stream(spark, place):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)] + [(3, [0.0, 0.0]), (99, [1.0])], "id long, vector array<float>")
    rows.repartition(3).write.parquet(f"{place}/in")
    t = VectorTable.create(spark, f"{place}/t", 2)
    run = ingest.start(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in"), t, f"{place}/c", f"{place}/r")
    assert run.flush() == run.errors >= 2 and run.flush() == 0
    run.stop()
    assert t.count() == run.inserted and t.count() >= 39
    # a batch that comes again changes neither rows nor counts
    n, bad, rejected = run.inserted, run.errors, spark.read.parquet(f"{place}/r").count()
    run.take(rows, 0)
    again = ingest.Ingest(VectorTable.open(spark, f"{place}/t"), f"{place}/r", f"{place}/c")
    again.take(rows, 2)
    assert (run.inserted, run.errors, again.errors, t.count(), spark.read.parquet(f"{place}/r").count()) == (n, bad, 0, n, rejected)


def test_inserts_and_labels_leave_vectors_where_they_are(spark, place):
    """A batch is written once, checked as it lies there and gone if it fails; ids and labels are read without vectors."""
    folder = Path(place.removeprefix("file://")) / "log"
    t = VectorTable.from_rows(spark, place, spark.range(20).select("id", F.array(F.col("id").cast("float"), F.lit(0.0)).alias("vector"), F.lit("a").alias("label")))
    schema = "id long, vector array<float>"
    for bad, kind in (([(30, [1.0, 2.0]), (30, [1.0, 2.0])], AlreadyExists), ([(5, [1.0, 2.0]), (30, [1.0, 2.0])], AlreadyExists), ([(30, [1.0])], Invalid), ([(31, [1.0, None])], Invalid), ([(None, [1.0, 2.0])], Invalid)):
        with pytest.raises(kind):
            t.insert_rows(spark.createDataFrame(bad, schema))
        assert t.count() == 20 and len(list(folder.iterdir())) == 1
    assert t.insert_rows(spark.createDataFrame([], schema)) == 0
    assert t.change_rows(spark.createDataFrame([(77,)], "id long"), "D") == 0 and len(list(folder.iterdir())) == 1
    t.insert_rows(spark.createDataFrame([(22, [1.0, 2.0]), (21, [1.0, 2.0])], schema))
    t.change_rows(spark.createDataFrame([(3, [9.0, 9.0]), (3, [9.0, 9.0])], schema), "U")
    t.change_rows(spark.createDataFrame([(4,)], "id long"), "D")
    assert t.count() == 21 == t.live(vectors=False).count() and t.get(3) == ([9.0, 9.0], "a")
    plan = t.live(vectors=False)._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan
    assert sorted(map(tuple, t.live(vectors=False).collect())) == sorted((r["id"], r["label"]) for r in t.live().collect())
