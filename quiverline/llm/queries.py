"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, langid, licenses, linededup, packing, permutation, pieces, quality, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    prototypes = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(docs, prototypes)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.search(_table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_warc_round_trip": op1_warc_round_trip,
        "op2_language_id": op2_language_id,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality_resampling": op5_quality_resampling,
        "op6_packing": op6_packing,
        "op7_permutation_ann": op7_permutation_ann,
        "op8_license_scan": op8_license_scan,
        "op9_line_dedup": op9_line_dedup,
        "op10_cover_tree": op10_cover_tree,
    }


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM p LEFT JOIN w USING (payload_digest)
"""


#: Lines by place, sets of lower-cased words, an exact prefix join in order of the words' true frequency, and the lines that stay.
LINES_SQL = """
lines AS (
  SELECT doc_id, i AS place, string_split(text, chr(10))[i] AS line,
    list_sort(list_distinct(list_filter(string_split_regex(lower(string_split(text, chr(10))[i]), '\\s+'), lambda w: w <> ''))) AS words
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM {docs} WHERE text IS NOT NULL)
), sets AS (
  SELECT words, len(words) AS n, min({{'d': doc_id, 'p': place}}) AS seq FROM lines WHERE len(words) > 0 GROUP BY words
), tokens AS (
  SELECT seq, n, unnest(words) AS w FROM sets
), freq AS (
  SELECT w, count(*) AS f FROM tokens GROUP BY w
), ranked AS (
  SELECT seq, n, w, row_number() OVER (PARTITION BY seq ORDER BY f, w) AS r FROM tokens JOIN freq USING (w)
), prefix AS (
  SELECT seq, n, w FROM ranked WHERE r <= n // 5 + 1
), pairs AS (
  SELECT DISTINCT x.seq AS x, y.seq AS y, x.n AS xn, y.n AS yn FROM prefix x JOIN prefix y USING (w)
  WHERE x.seq < y.seq AND x.n * 5 >= y.n * 4 AND y.n * 5 >= x.n * 4
), near AS (
  SELECT DISTINCT y FROM pairs JOIN sets a ON a.seq = x JOIN sets b ON b.seq = y
  WHERE len(list_intersect(a.words, b.words)) * 9 >= (xn + yn) * 4
), kept AS (
  SELECT l.doc_id, l.place, l.line, len(l.words) > 0 AND (near.y IS NOT NULL OR {{'d': l.doc_id, 'p': l.place}} > s.seq) AS gone
  FROM lines l LEFT JOIN sets s ON l.words = s.words LEFT JOIN near ON near.y = s.seq
), deduped AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text, count(*) AS n_lines,
    count(*) FILTER (gone) AS n_removed
  FROM kept GROUP BY doc_id
)"""

OP9_SQL = f"""
WITH {LINES_SQL.format(docs="documents")}
SELECT doc_id, text, n_lines, n_removed FROM deduped
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_round_trip": OP1_SQL, "op9_line_dedup": OP9_SQL}
