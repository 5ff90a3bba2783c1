"""Quality classifier by importance resampling.

Two hashed n-gram models, multinomials over buckets of word unigrams and bigrams: the target from texts labelled
good, the raw one from the whole corpus.  A document's log weight is the sum over its n-grams of log(target / raw).
Documents are sampled without replacement in proportion to their weights by Gumbel top-k: each gets the key
log weight + Gumbel noise (drawn from a hash of its id) and the k largest keys are kept.

The weight is tilted by a constant per n-gram, `cut`: the mean log ratio that all but `CLEAN_LOSS` of the good labelled
documents reach, less `SLACK`.  So a document at the edge of the good ones has weight about 1 whatever its length, and
k, the number of documents of weight 1 or more, follows the corpus, however much of it is junk.

Defined results: null and empty texts have no n-gram, log weight -infinity, and are never kept; rows with one doc_id
draw the same noise; keys that tie at the threshold are kept together; with no good label at all, every document
with a word is kept (there is nothing to tell it by); null ids are scored like any other; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BUCKETS = 1 << 16
SEED = 7
#: Bound on labelled rows that the target model and the calibration use (a hash sample beyond it).
MAX_FIT_ROWS = 60_000
CLEAN_LOSS = 0.002
#: Nats per n-gram below that quantile that still count as good.
SLACK = 0.05
#: N-grams' worth of the raw model that smooth the target.
PRIOR = float(BUCKETS)
_CHARS = 1 << 22

_KIND = np.ones(256, dtype=np.uint8)  # 1: letters, digits and bytes over 127
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 2
_POWERS = np.empty(64, dtype=np.uint64)
_POWERS[0] = 1
for _k in range(1, 64):
    _POWERS[_k] = (int(_POWERS[_k - 1]) * 0x100000001B3 + 0) % (1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def ngrams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, number of n-grams of each text): runs of word characters or of marks, alone and in pairs."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    doc_end = np.cumsum([len(x) + 1 for x in raw])
    kind = _KIND[flat]
    first = np.empty(len(flat), dtype=bool)
    first[:1] = kind[:1] > 0
    first[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0)
    start = np.flatnonzero(first)
    if not len(start):
        return np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    word = np.cumsum(first) - 1
    inside = kind > 0
    place = np.arange(len(flat)) - start[np.maximum(word, 0)]
    value = np.where(inside, (flat.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], np.uint64(0))
    h = _mix(np.add.reduceat(value, start))
    doc = np.searchsorted(doc_end, start, side="right")
    pair = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[doc[:-1] == doc[1:]]
    both = np.concatenate([h, pair]) & np.uint64(buckets - 1)
    owner = np.concatenate([doc, doc[:-1][doc[:-1] == doc[1:]]])
    order = np.argsort(owner, kind="stable")
    return both[order].astype(np.int64), np.bincount(owner, minlength=len(texts))


def blocks(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `_CHARS` characters, so that memory doesn't grow with the batch."""
    size, lo = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if isinstance(t, str) else 0
        if size >= _CHARS:
            yield lo, i + 1
            size, lo = 0, i + 1
    if lo < len(texts):
        yield lo, len(texts)


def _counts(df: DataFrame) -> np.ndarray:
    """N-grams by bucket, over all rows: summed in each task, then by bucket; the driver gets `BUCKETS` numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for lo, hi in blocks(b["text"]):
                total += np.bincount(ngrams(b["text"].iloc[lo:hi].tolist())[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(BUCKETS)
    got = df.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def fit(docs: DataFrame, good: DataFrame, max_rows: int = MAX_FIT_ROWS) -> np.ndarray | None:
    """Log ratio of each bucket.  `good`: texts of the target (bounded); `docs`: the raw corpus, all of it."""
    target = _counts(good)
    if not target.sum():
        return None
    raw = _counts(docs)
    q = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    # where the target has seen little, the raw model speaks for it
    p = (target + PRIOR * q) / (target.sum() + PRIOR)
    return np.log(p) - np.log(q)


def _noise(seed: int) -> F.Column:
    """52 random bits from the id."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), F.lit(seed)), 12)


def _weigh(texts: list[str | None], noise: np.ndarray, ratio: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of n-grams, log weight, Gumbel noise) of each text."""
    ids, n = ngrams(texts)
    w = np.zeros(len(n))
    if len(ids) and ratio is not None:
        has = n > 0
        w[has] = np.add.reduceat(ratio[ids], (np.cumsum(n) - n)[has])
    w[n == 0] = -np.inf
    return n, w, -np.log(-np.log((noise + 0.5) / (1 << 52)))


def score(docs: DataFrame, ratio: np.ndarray | None, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel): the noise depends on the id and the seed only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in blocks(b["text"]):
                part = b.iloc[lo:hi]
                n, w, gumbel = _weigh(part["text"].tolist(), part["noise"].to_numpy(dtype=np.float64), ratio)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "n_grams": n, "log_weight": w, "gumbel": gumbel})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", _noise(seed).alias("noise"))
    return rows.mapInPandas(run, "doc_id long, n_grams long, log_weight double, gumbel double")


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest finite value: histograms, each within the last one's bin, until a bin holds one value.

    The driver gets `bins` counts a round.  k <= 0: infinity; k beyond the rows: -infinity.
    """
    x = F.col(column)
    rows = df.where(x.isNotNull() & (x > float("-inf")) & (x < float("inf")))
    lo, hi, n = rows.agg(F.min(x), F.max(x), F.count(x)).first()
    if k <= 0:
        return math.inf
    if k > n:
        return -math.inf
    while lo < hi:
        width = (hi - lo) / bins
        inside = rows.where((x >= lo) & (x <= hi))
        if width == 0 or lo + width == lo:
            break
        bin_of = F.least(F.lit(bins - 1), F.floor((x - lo) / width))
        above = 0
        for r in sorted(inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                k, lo, hi = k - above, r["lo"], r["hi"]
                break
            above += r["n"]
    return hi if lo == hi else float(rows.where((x >= lo) & (x <= hi)).groupBy(x.alias("x")).count().orderBy(F.desc("x")).limit(1).first()["x"])


@dataclass(frozen=True)
class Model:
    """What a decision needs: log ratios (None: nothing was labelled good), tilt, least key kept, seed of the noise."""

    ratio: np.ndarray | None
    cut: float
    least: float
    seed: int


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, clean_loss: float = CLEAN_LOSS, seed: int = SEED) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, n_grams, log_weight, sample_key) of every row of `docs`."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_g")).where("_g IS NOT NULL").distinct()
    n = good.count()
    if n > max_rows:
        good = good.where(F.pmod(F.xxhash64("_g", F.lit(seed)), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    # at most about `max_rows` ids, so every task can hold them and no text moves
    good = F.broadcast(good)
    ratio = fit(docs, docs.select(F.col("doc_id").alias("_g"), "text").join(good, "_g", "left_semi"))
    scores = materialise(score(docs, ratio, seed), "quality-scores")
    cut = None
    if ratio is not None:
        mean = F.col("log_weight") / F.col("n_grams")
        known = scores.join(good, scores["doc_id"] == good["_g"], "left_semi").where("n_grams > 0")
        cut = known.agg(F.percentile_approx(mean, F.lit(clean_loss), F.lit(10_000)).alias("c")).first()["c"]
    cut = -1.0 if cut is None else cut - SLACK
    weighed = scores.select("doc_id", "n_grams", (F.col("log_weight") - F.col("n_grams") * F.lit(cut)).alias("log_weight"), "gumbel")
    k = weighed.where("log_weight >= 0").count()
    keyed = weighed.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") + F.col("gumbel")).alias("sample_key"))
    return Model(ratio, cut, kth_largest(keyed, "sample_key", k), seed), keyed


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, n_grams, log_weight, sample_key, kept), one row per row of `docs`."""
    model, keyed = train(docs, labels, **options)
    return keyed.withColumn("kept", F.col("sample_key") >= F.lit(model.least))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, that the model keeps: decided where they lie, so no text moves."""

    @F.pandas_udf("boolean")
    def kept(text: pd.Series, noise: pd.Series) -> pd.Series:
        out = np.zeros(len(text), dtype=bool)
        for lo, hi in blocks(text):
            n, w, gumbel = _weigh(text.iloc[lo:hi].tolist(), noise.iloc[lo:hi].to_numpy(dtype=np.float64), model.ratio)
            out[lo:hi] = (w - n * model.cut) + gumbel >= model.least
        return pd.Series(out)

    return docs.where(kept(F.col("text"), _noise(model.seed)))
