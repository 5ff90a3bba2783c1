import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiverline.functions import kernels, metrics
from quiverline.types import Metric

PAIRS = [([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([3.0, -4.0], [1.5, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0, 0.0], [1.0, 0.0, 0.0]), ([2.0], [2.0])]


def plain(metric, a, b):
    a, b = np.array(a), np.array(b)
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return {
        Metric.L2: np.sqrt(((a - b) ** 2).sum()), Metric.L1: np.abs(a - b).sum(), Metric.HAMMING: float((a != b).sum()), Metric.IP: -(a @ b),
        Metric.COSINE: 1.0 if size < 1.2e-7 else 1 - max(-1, min(1, a @ b / size)),
    }[metric]


@pytest.mark.parametrize("metric", list(Metric))
def test_expressions_and_kernels_agree(spark, metric):
    df = spark.createDataFrame(PAIRS, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(metrics.distance(metric, F.col("a"), F.col("b"))).collect()]
    for value, (a, b) in zip(got, PAIRS):
        assert value == pytest.approx(plain(metric, a, b), abs=1e-9)
        assert kernels.distances(metric, np.array([a]), np.array([b]))[0, 0] == pytest.approx(value, abs=1e-9)


def test_norm_and_dot(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert df.select(metrics.norm(F.col("a")), metrics.dot(F.col("a"), F.col("b")), metrics.l2_squared(F.col("a"), F.col("b"))).first() == (5.0, 11.0, 8.0)


def test_close_vectors_keep_their_digits():
    x = np.full((1, 8), 1000.0)
    assert kernels.l2_squared(x, x + 1e-4)[0, 0] == pytest.approx(8e-8, rel=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=30), st.integers(0, 12))
def test_top_k_is_the_sorted_head(values, k):
    d, ids = np.array([values], dtype=float).reshape(1, -1), np.arange(len(values))[::-1].copy()
    _, cols = kernels.top_k(d, ids, k)
    want = sorted(range(len(values)), key=lambda i: (values[i], ids[i]))[:k]
    assert cols.tolist() == want
