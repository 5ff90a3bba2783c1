"""Registered queries against their SQL on the small tables."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from quiverline.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings events".split()


@pytest.fixture(scope="module")
def db():
    if not Path(SF).exists():
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    def one(x):
        if x is None or x is pd.NA or (np.isscalar(x) and pd.isna(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, bool) else str(x)

    return sorted(repr(tuple(map(one, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_recall_of_the_rest(spark, db):
    for name, least in (("hnsw_recall", 0.9), ("vamana_recall", 0.9), ("aq_recall", 0.9), ("ivf_trained_recall", 0.9), ("lsh_recall", 0.9), ("sq_recall", 0.9), ("pq_recall", 0.3)):
        assert QUERIES[name](spark, SF).toPandas()["recall"].mean() >= least
