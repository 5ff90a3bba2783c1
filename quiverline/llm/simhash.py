"""SimHash near-duplicate detection with pigeonring filtering.

The 64 bits are cut into 5 segments in a ring.  If two fingerprints differ in at most 4 bits, then from some segment
on every chain of l consecutive segments differs in at most floor(4 l / 5) bits: 0 in the first, at most 1 in two,
2 in three, 3 in four.  Candidates must share segment i and meet the next within one bit, which an equi-join finds:
one side probes with its own two segments, the other is posted under every one-bit variant of the second.  Longer
chains prune the candidates inside the join, and what they leave is checked by the whole distance.  Equal fingerprints are one node.

Defined results: null and empty texts, and texts of white space only, have fingerprint 0 and link like any other; a very long
text is read whole, its shingles hashed a chunk at a time;
repeated rows repeat in the result; rows with a null doc_id get a fingerprint but link nothing and have a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise

SEGMENTS = (13, 13, 13, 13, 12)
MAX_BITS = 4
SHINGLE = 4
HASH_SEED = 42
_CHUNK = 1 << 14


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of one text; whole text, shingles hashed a chunk at a time."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - width + 1)
    stops = ends.tolist()[min(width, len(words)) - 1 :]
    xx, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _CHUNK):
        h = np.array([xx(joined[a:b], HASH_SEED) for a, b in zip(starts[lo : min(lo + _CHUNK, n)], stops[lo : lo + _CHUNK])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "fp": np.array([fingerprint(t, width) for t in b["text"]], dtype=np.int64)})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def _layout() -> list[tuple[int, int]]:
    """(shift, width) of each segment, from the highest bits."""
    out, top = [], 64
    for w in SEGMENTS:
        top -= w
        out.append((top, w))
    return out


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): all pairs of different fingerprints of `nodes(fp)` that differ in at most 4 bits, each once or more."""
    lay, m = _layout(), len(SEGMENTS)
    seg = [F.shiftrightunsigned(F.col("fp"), s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in lay]

    def key(i: int, second) -> F.Column:
        w2 = lay[(i + 1) % m][1]
        return F.shiftleft(F.shiftleft(F.lit(i).cast("long"), 13).bitwiseOR(seg[i]), w2).bitwiseOR(second)

    probe = nodes.select("fp", F.explode(F.array(*(key(i, seg[(i + 1) % m]) for i in range(m)))).alias("key"))
    posts = []
    for i in range(m):
        nxt, w2 = seg[(i + 1) % m], lay[(i + 1) % m][1]
        posts += [key(i, nxt)] + [key(i, nxt.bitwiseXOR(F.lit(1 << b).cast("long"))) for b in range(w2)]
    index = nodes.select(F.col("fp").alias("other"), F.explode(F.array(*posts)).alias("key"))
    masks = [((1 << w) - 1) << s for s, w in lay]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    diff = F.col("fp").bitwiseXOR(F.col("other"))

    def chain(i: int, length: int) -> F.Column:
        """Segment i and those that follow it, `length` in all, keep to their budget."""
        mask = 0
        for k in range(length):
            mask |= masks[(i + k) % m]
        return F.bit_count(diff.bitwiseAND(F.lit(signed(mask)))) <= MAX_BITS * length // m

    # the ring's longer chains from the segment that the key names, shortest first; the whole distance is for what they leave
    ring = F.lit(False)
    for i in range(m):
        w2 = lay[(i + 1) % m][1]
        ring = ring | ((F.shiftrightunsigned(F.col("key"), 13 + w2) == i) & chain(i, 3) & chain(i, 4))
    # both sides are much larger than the tables that they are unfolded from, which sizes estimated for a broadcast don't show
    met = probe.hint("merge").join(index, "key").where(ring).where(F.bit_count(diff) <= MAX_BITS).where(F.col("fp") < F.col("other"))
    return met.select(F.col("fp").alias("a"), F.col("other").alias("b"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, one row per row of `docs`."""
    fps = materialise(fingerprints(docs, width), "simhash")
    nodes = materialise(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    left = nodes.select(F.col("fp").alias("a"), F.col("rep").alias("ra"))
    right = nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))
    found = materialise(links(nodes.select("fp")).distinct(), "simhash-links")
    edges = found.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    comp = connected_components(edges)
    rep = nodes.join(comp, nodes["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("c"))
    out = fps.join(rep, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))


def representatives(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each component: that of its smallest doc_id (of rows that repeat it, the least by `columns`); rows with a null id stay."""
    first = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in columns if c != "doc_id"]
    chosen = docs.select(*columns).join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r"))
    return chosen.select("doc_id", *(f"r.{c}" for c in rest)).select(*columns).unionByName(docs.where("doc_id IS NULL").select(*columns))
