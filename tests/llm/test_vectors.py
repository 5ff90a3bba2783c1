"""Permutation index and cover tree against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverline.llm import covertree, permutation

SCHEMA = "vec_id long, embedding array<float>, label int, n_links long, score double"
ODD = [(None, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0]), (20, [1.0, 1.0]), (40, [2.0, 2.0]), (41, [2.0, 2.0]), (42, [-1.0, 0.5])]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, -1, 0.0) for i, v in rows], SCHEMA)


def test_search_on_odd_rows(spark):
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in permutation.search(table(spark, ODD)).collect()}
    assert got == {(20, 1): (40, 4.0), (20, 2): (41, 4.0), (20, 3): (42, -0.5), (40, 1): (41, 8.0), (40, 2): (20, 4.0), (40, 3): (42, -1.0)}
    assert permutation.search(table(spark, [])).count() == 0


def test_duplicates_on_odd_rows(spark):
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in covertree.near_duplicates(table(spark, ODD)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 42)]
    assert got == sorted([(None, 0, None, False), *alone, (20, 2, 20, True), (40, 2, 20, False), (41, 2, 20, False)], key=str)
    assert covertree.near_duplicates(table(spark, [])).count() == 0
    assert covertree.near_duplicates(table(spark, [(3, None)])).first()["kept"]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(700, 16))
    x = np.concatenate([x, x[:80] + 0.1 * rng.normal(size=(80, 16)), np.repeat(x[:3], 20, axis=0), x[5] + 0.15 * rng.normal(size=(60, 16))]).astype(np.float32)
    return x * rng.uniform(0.2, 4, (len(x), 1)).astype(np.float32)


def test_recall_of_search(spark, cloud, monkeypatch):
    monkeypatch.setattr(permutation, "BLOCK", 300)
    monkeypatch.setattr(permutation, "QUERY_BLOCK", 20)
    monkeypatch.setattr(permutation, "RERANK_LEAST", 100)
    rows = permutation.search(table(spark, [(i, v.tolist()) for i, v in enumerate(cloud)])).collect()
    x, hit, n = cloud.astype(float), 0, 0
    for q in range(0, len(x), 20):
        got = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        s = x @ x[q]
        s[q] = -np.inf
        least = np.sort(s)[-20]
        assert [r["rank"] for r in got] == list(range(1, 21)) and all(r["vec_id"] != q for r in got)
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in got)
        assert [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        hit, n = hit + sum(r["score"] >= least - 1e-12 for r in got), n + 20
    assert hit / n >= 0.9


def test_copies_are_ranked_by_id(spark, monkeypatch):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    copies = np.sort(rng.permutation(2000)[:667])
    x[copies] = 3 * x[0]
    for block in (permutation.BLOCK, 700):
        monkeypatch.setattr(permutation, "BLOCK", block)
        rows = permutation.search(table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
        for q in copies[copies % 20 == 0]:
            got = [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])]
            assert got == [i for i in copies if i != q][:20]


def test_footrule_of_the_postings():
    rng = np.random.default_rng(14)
    x, p = rng.normal(size=(50, 5)), rng.normal(size=(12, 5))
    files, orders = permutation.InvertedFiles(x, p, 6), permutation.ordered_pivots(x, p, 6)
    q = permutation.ordered_pivots(rng.normal(size=(1, 5)), p, 6)[0]

    def footrule(a, b):
        at = lambda o, v: list(o).index(v) if v in o else 6
        return sum(abs(at(a, v) - at(b, v)) for v in range(12))

    d = np.array([footrule(q, o) for o in orders])
    got = files.nearest(q, 10)
    assert sorted(d[got]) == sorted(d)[:10]


@pytest.mark.parametrize("block", [64, 4096])
def test_all_links_as_by_hand(spark, cloud, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK_FLOATS", block * 16)
    got = {r["vec_id"]: r for r in covertree.near_duplicates(table(spark, [(i + 5, v.tolist()) for i, v in enumerate(cloud)])).collect()}
    u = covertree.unit(cloud.astype(float))
    m = u @ u.T >= 0.9
    np.fill_diagonal(m, False)
    a, b = np.nonzero(m)
    label = covertree.forest(len(u), a, b, np.arange(len(u)))
    for i in range(len(u)):
        r = got[i + 5]
        assert (r["n_links"], r["component_id"], r["kept"]) == (m[i].sum(), label[i] + 5, label[i] == i)


def radii(tree, x):
    leaf = tree.leaves(x)
    return leaf, tree.radii(leaf, tree.distances(x, leaf))


def test_pruning_is_safe():
    rng = np.random.default_rng(15)
    centre = covertree.unit(rng.normal(size=(12, 8)))
    x = covertree.unit(np.repeat(centre, 60, axis=0) + 0.05 * rng.normal(size=(720, 8)))
    y = covertree.unit(np.repeat(centre[:5], 40, axis=0) + 0.05 * rng.normal(size=(200, 8)))
    for other in (x, y):
        a, b = covertree.Tree(x), covertree.Tree(other[:50])
        (la, ra), (lb, rb) = radii(a, x), radii(b, other)
        meet, visited = covertree.dual_traversal(a, ra, b, rb, 0.3)
        i, j = np.nonzero(((x[:, None] - other[None]) ** 2).sum(2) <= 0.09)
        assert meet[la[i], lb[j]].all() and visited > 1
        assert meet.sum() < len(np.unique(la)) * len(np.unique(lb)) / 2


def test_levels_grow_with_the_sample():
    rng = np.random.default_rng(17)
    centre = covertree.unit(rng.normal(size=(400, 64)))
    x = covertree.unit(np.repeat(centre, 3, axis=0) + 0.005 * rng.normal(size=(1200, 64)))
    tree = covertree.Tree(x)
    assert len(tree.levels) > 1 and len(tree.levels[-1]) >= 400
    leaf, r = radii(tree, x)
    ok, _ = covertree.dual_traversal(tree, r, tree, r, 0.2)
    a, b = np.nonzero(x @ x.T >= 0.98)
    assert ok[leaf[a], leaf[b]].all()
    assert ok.sum() < 0.1 * len(np.unique(leaf)) ** 2


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_links_of_wide_vectors(spark, monkeypatch, kind):
    """As production vectors are: 64 components, over several blocks; clusters are pruned, isotropic vectors hardly."""
    monkeypatch.setattr(covertree, "BLOCK_FLOATS", 200 * 64)
    monkeypatch.setattr(covertree, "SAMPLE", 256)
    rng = np.random.default_rng(18)
    x = rng.normal(size=(1500, 64))
    if kind == "clustered":
        x = np.repeat(rng.normal(size=(150, 64)), 10, axis=0) + 0.2 * x
    x = np.concatenate([x, x[:50] + 0.3 * rng.normal(size=(50, 64))]).astype(np.float32)
    rows = table(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    u = covertree.unit(x.astype(float))
    m = u @ u.T >= 0.9
    np.fill_diagonal(m, False)
    label = covertree.forest(len(u), *np.nonzero(m), np.arange(len(u)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.near_duplicates(rows).collect()}
    assert got == {i: (m[i].sum(), label[i]) for i in range(len(u))} and m.any()
    told = covertree.report(rows)
    assert told["visited"] > 1 and told["total"] >= len(u) ** 2 / 2
    assert told["compared"] < told["total"] / 3 or kind == "isotropic"


def test_repeated_ids_lengths_and_the_threshold(spark):
    edge = [0.9, (1 - 0.81) ** 0.5]
    rows = [(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 3.0, 0.0]), (5, [3.0, 0.0, 0.0, 0.0]), (6, [1.0, 0.6]), (7, edge)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in covertree.near_duplicates(table(spark, rows)).collect())
    u = covertree.unit(np.array([[1, 0], edge, [1.0, 0.6]], dtype=np.float32).astype(float))
    m = u @ u.T >= 0.9
    near = [int(m[0, 1]) * 3 + int(m[1, 2]), int(m[0, 2]) * 3 + int(m[1, 2])]
    first = 2 + int(m[0, 1]) + int(m[0, 2])
    assert got[:3] == [(1, first, 1), (1, first, 1), (2, first, 1)] and got[3:6] == [(3, 1, 3), (4, 1, 3), (5, 0, 5)]
    assert [x[1] for x in got[6:]] == near[::-1]
    # a query's candidates have its length; equal scores go to the smaller id, repeated ids are candidates each
    found = [(r["query_id"], r["rank"], r["vec_id"]) for r in permutation.search(table(spark, [(20, [1.0, 1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [9.0, 9.0, 9.0])])).collect()]
    assert sorted(found) == [(20, 1, 2), (20, 2, 3), (20, 3, 3)]
