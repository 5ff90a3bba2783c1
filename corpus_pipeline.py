"""The corpus pipeline: quality, language, repeated lines, near copies, packing, in that order.

Each stage works on all rows that its predecessor kept, and is written as Parquet and read again before the next.
Rows that the quality classifier or language ID rejects go; repeated lines leave the texts; one document of each group of
near copies stays; what is left is packed.  Nulls and repeated rows follow the operators' own rules: empty texts
are rejected at the first stage, a null id is kept until packed with a null id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverline.llm import langid, linededup, packing, quality, simhash
from quiverline.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model, _ = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return langid.keep(docs, langid.fit(docs.where(~langid.held_out(F.col("doc_id")))))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.rewrite(docs.select(*COLUMNS)).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_copy_stage),
    ("packing", packing_stage),
]

#: Hashed n-gram models, hypervectors and byte-pair ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
