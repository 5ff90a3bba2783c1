"""Registered queries against SQL, and the pipeline stage by stage."""

import os
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from quiverline.llm import langid, linededup, packing, pieces, quality, queries, simhash

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("pages", "documents"):
        db.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).map(lambda x: int(x) if isinstance(x, float) else x).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_there_is_a_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]


def test_held_out_languages(spark):
    got = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out AND lang IS NOT NULL")
    assert held.where("lang = lang_pred").count() / held.count() >= 0.95


def test_ids_decode_to_the_texts(spark):
    got = queries.op4_sentencepiece(spark, SF).cache()
    assert got.where("round_trip").count() > 0 and got.where("size(ids) <> n_ids").count() == 0
    texts = {r["doc_id"]: (r["text"] or "").replace(pieces.MARK, " ") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pieces.decode(got.where("round_trip").select("doc_id", "ids")).collect():
        assert r["text"] == texts[r["doc_id"]]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = {r["doc_id"] for r in quality.classify(docs, labels).where("kept").collect()}
    one = corpus_pipeline.STAGES[0][1](spark, docs, SF).cache()
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    two = corpus_pipeline.STAGES[1][1](spark, one, SF).cache()
    predict = langid.Predictor(langid.fit(one.where(~langid.held_out(one["doc_id"]))))
    told = one.toPandas()
    got = predict(told["text"].tolist())
    rejected = set(told["doc_id"][(got["lang_pred"] == "und") | ((got["n_grams"] >= 200) & (got["score"] < 0.05))])
    assert {r["doc_id"] for r in two.collect()} == kept - rejected
    three = corpus_pipeline.STAGES[2][1](spark, two, SF).cache()
    assert {(r["doc_id"], r["text"]) for r in three.collect()} == {(r["doc_id"], r["text"]) for r in linededup.dedup_lines(two).collect()}
    four = corpus_pipeline.STAGES[3][1](spark, three, SF).cache()
    assert sorted(r["doc_id"] for r in four.collect()) == sorted(r["doc_id"] for r in simhash.near_duplicates(three).where("doc_id = component_id").collect())
    five = corpus_pipeline.STAGES[4][1](spark, four, SF)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in four.collect()}
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg({"length": "sum"}).first()[0] == packing.pack(four).agg({"length": "sum"}).first()[0]


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", None, "s", 15), (3, "some words here", "en", None, 15), (3, "some words here", "en", None, 15)]
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS component_id", "'x' AS _gone_")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (full, full.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.collect()
