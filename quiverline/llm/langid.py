"""Language identification with hyperdimensional profiles.

Every letter class has a random +-1 vector.  A letter trigram is bound from its letters' vectors, each rolled
(permuted) by its place, and multiplied; a text is the bundle (sum) of its trigram vectors; a language's prototype
is the bundle of its training texts.  A document gets the language whose prototype has the largest cosine.

Defined results: a text that is null or holds no letter is `und` with score 0, as is every text when nothing was
learned; equal cosines go to the smaller language name; repeated rows are predicted alike; a null doc_id stays null;
whole texts are read, in pieces, so a long text costs no more memory than a short one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letter classes: 0 is the gap between words, 1-26 are a-z, other letters share the rest by their code point.
CLASSES = 48
DIM = 512
SEED = 20240607
#: Bound on labelled rows that the prototypes are fitted on (a hash sample of the training rows beyond it).
MAX_FIT_ROWS = 60_000
_PIECE = 1 << 20


def letter_table() -> np.ndarray:
    """Code point -> class, for the basic plane; code points above it fall into classes by arithmetic."""
    t = np.zeros(0x10000, dtype=np.uint8)
    t[97:123] = np.arange(1, 27)
    t[65:91] = np.arange(1, 27)
    for cp in range(0xAA, 0x10000):
        if not 0xD800 <= cp < 0xE000 and (ch := chr(cp)).isalpha():
            low = ord(ch.lower()[0])
            t[cp] = t[low] if low < 128 and t[low] else 27 + (low * 2654435761 >> 7) % (CLASSES - 27)
    return t


class Encoder:
    """Counts letter trigrams and bundles them into hypervectors."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.table = letter_table()
        self.dim = dim
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), (CLASSES, dim))
        letters[0] = np.random.default_rng(seed + 1).choice(np.array([-1, 1], dtype=np.int8), dim)
        self.place = [np.roll(letters, k, axis=1) for k in (2, 1, 0)]

    def classes(self, text: str) -> np.ndarray:
        cp = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        c = self.table[np.minimum(cp, 0xFFFF)]
        if (high := cp > 0xFFFF).any():
            c[high] = [27 + (x * 2654435761 >> 7) % (CLASSES - 27) if chr(x).isalpha() else 0 for x in cp[high].tolist()]
        return c

    def trigrams(self, text: str | None) -> np.ndarray:
        """Ids of the trigrams, gaps between words taken as one; whole text, a piece at a time."""
        if not text:
            return np.empty(0, dtype=np.int32)
        c = np.concatenate([[0], *(self.classes(text[i : i + _PIECE]) for i in range(0, len(text), _PIECE)), [0]])
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c = c[keep].astype(np.int32)
        if len(c) < 3:
            return np.empty(0, dtype=np.int32)
        ids = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        return ids[(c[:-2] != 0) | (c[1:-1] != 0)]

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hypervectors, number of trigrams) of the texts."""
        grams = [self.trigrams(t) for t in texts]
        sizes = np.array([len(g) for g in grams])
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for lo in range(0, len(texts), 64):
            part = grams[lo : lo + 64]
            flat = np.concatenate(part) if part else np.empty(0, dtype=np.int32)
            if not len(flat):
                continue
            used = np.flatnonzero(np.bincount(flat, minlength=CLASSES**3))
            column = np.zeros(CLASSES**3, dtype=np.int32)
            column[used] = np.arange(len(used))
            counts = np.zeros((len(part), len(used)), dtype=np.float32)
            for k, g in enumerate(part):
                counts[k] = np.bincount(column[g], minlength=len(used)) if len(g) else 0
            a, b, c = used // CLASSES**2, used // CLASSES % CLASSES, used % CLASSES
            vectors = self.place[0][a] * self.place[1][b] * self.place[2][c]
            out[lo : lo + 64] = counts @ vectors.astype(np.float32)
        return out, sizes


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """crc32 of the id as text, mod `folds`, is `fold`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, max_rows: int = MAX_FIT_ROWS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes from `text`, `lang` of rows with both; beyond `max_rows` labelled rows, from a hash sample of about that many."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sums = Encoder(), {}
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                v, n = enc.bundle(part["text"].tolist())
                for lang in set(part["lang"]):
                    at = (part["lang"] == lang).to_numpy() & (n > 0)
                    # each text counts alike: otherwise a few very long ones would be the prototype
                    v1 = v[at] / np.maximum(np.linalg.norm(v[at], axis=1, keepdims=True), 1e-9)
                    sums[lang] = sums.get(lang, 0) + v1.sum(0, dtype=np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.tolist() if np.ndim(x) else [0.0] * DIM for x in sums.values()]})

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0).tolist()]})

    parts = rows.mapInPandas(run, "lang string, v array<double>")
    # at most one vector for each language and partition of the bounded sample
    got = parts.groupBy("lang").applyInPandas(total, "lang string, v array<double>").collect()
    return {r["lang"]: np.array(r["v"]) for r in sorted(got, key=lambda r: r["lang"])}


class Predictor:
    """Compares texts with prototypes."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        live = {k: v for k, v in prototypes.items() if np.linalg.norm(v) > 0}
        self.names = sorted(live)
        self.p = np.array([live[k] / np.linalg.norm(live[k]) for k in self.names], dtype=np.float32) if live else np.zeros((0, DIM), dtype=np.float32)
        self.enc: Encoder | None = None

    def __call__(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score (the best cosine, at least 0), margin (its lead over the second), n_grams."""
        self.enc = self.enc or Encoder()
        v, n = self.enc.bundle(texts)
        lang = np.full(len(n), "und", dtype=object)
        score, margin = np.zeros(len(n)), np.zeros(len(n))
        if self.names and len(n):
            cos = (v @ self.p.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            best, top, ok = cos.argmax(1), np.sort(cos, axis=1), n > 0
            lang[ok] = np.array(self.names, dtype=object)[best[ok]]
            score[ok] = np.clip(top[ok, -1], 0, 1)
            margin[ok] = top[ok, -1] - top[ok, -2] if len(self.names) > 1 else score[ok]
        return pd.DataFrame({"lang_pred": lang, "score": score.astype(float), "margin": margin.astype(float), "n_grams": n})


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, margin), one row per row of `docs`."""
    predictor = Predictor(prototypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["doc_id"].astype("Int64")
            for lo in range(0, len(b), 256):
                out = predictor(b["text"].iloc[lo : lo + 256].tolist())
                out.insert(0, "doc_id", ids.iloc[lo : lo + 256].to_numpy(dtype=object, na_value=None))
                yield out.drop(columns="n_grams")

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, margin double")


#: A text of this many trigrams is rejected if it resembles no learned language this much (far above the encoding's noise,
#: 0.044 of a cosine) and its letters come about equally often.  Languages that were not learned score no better than random
#: letters, but in none are the letters even: two letters of a text agree by chance in 0.05 or more, of random ones in 0.039.
REJECT_GRAMS, REJECT_SCORE, EVEN_LETTERS = 200, 0.25, 0.045


def agreement(classes: np.ndarray) -> float:
    """Chance that two letters of a text are of one class (1 with fewer than two letters)."""
    n = np.bincount(classes, minlength=CLASSES)[1:].astype(np.float64)
    return float((n * (n - 1)).sum() / (n.sum() * (n.sum() - 1))) if n.sum() > 1 else 1.0


def keep(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """The rows of `docs`, all columns, that are in some language: not `und`, and not long, like none of them, and of even letters."""
    predictor = Predictor(prototypes)

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        parts = [predictor(text.iloc[lo : lo + 256].tolist()) for lo in range(0, len(text), 256)]
        out = pd.concat(parts) if parts else predictor([])
        ok = (out["lang_pred"] != "und").to_numpy(dtype=bool)
        for i in np.flatnonzero(ok & (out["n_grams"] >= REJECT_GRAMS).to_numpy() & (out["score"] < REJECT_SCORE).to_numpy()):
            t = text.iloc[i]
            ok[i] = agreement(np.concatenate([predictor.enc.classes(t[lo : lo + _PIECE]) for lo in range(0, len(t), _PIECE)])) >= EVEN_LETTERS
        return pd.Series(ok)

    return docs.where(known(F.col("text")))
