"""Graph indexes: a layered small-world graph and a pruned flat graph.

Rows are dealt into parts of bounded size, each part gets a graph of its own, and a query searches every part and merges
the k best.  A built index is a DataFrame of `(part, graph)`, a graph being one binary value, so it is saved, read and
searched like any table, and parts are rebuilt or searched apart.  Rows that go after the build are passed over by the search.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..types import Metric
from . import topk
from .topk import DIGITS, FOUND, ranked

#: Rows of a part.
PART_ROWS = 20_000


class Graph:
    """Vectors of one part, and neighbours by layer: `layers[l]` maps a node to its neighbours."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, metric: Metric):
        self.ids, self.x, self.metric = ids, x, metric
        self.layers: list[dict[int, list[int]]] = []
        self.entry = 0

    def near(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return kernels.distances(self.metric, q[None, :], self.x[nodes])[0]

    def beam(self, q: np.ndarray, start: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """Best-first search that keeps the `width` nearest; sorted by distance."""
        links = self.layers[layer]
        seen = set(start)
        d = self.near(q, start)
        open_ = [(float(a), n) for a, n in zip(d, start)]
        heapq.heapify(open_)
        best = [(-a, -n) for a, n in open_]
        heapq.heapify(best)
        while open_:
            a, n = heapq.heappop(open_)
            if len(best) >= width and a > -best[0][0]:
                break
            todo = [m for m in links.get(n, ()) if m not in seen]
            if not todo:
                continue
            seen.update(todo)
            for b, m in zip(self.near(q, todo).tolist(), todo):
                if len(best) < width or b < -best[0][0]:
                    heapq.heappush(open_, (b, m))
                    heapq.heappush(best, (-b, -m))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-a, -n) for a, n in best)

    def reached(self) -> np.ndarray:
        """Nodes that the entry reaches on the ground: what a beam finds that is as wide as the part."""
        links = self.layers[0] if self.layers else {}
        seen = np.zeros(len(self.ids), dtype=bool)
        todo = [self.entry] if len(self.ids) else []
        while todo:
            n = todo.pop()
            if not seen[n]:
                seen[n] = True
                todo += links.get(n, [])
        return np.flatnonzero(seen)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays: dict[str, np.ndarray] = {"ids": self.ids, "x": self.x.astype(np.float32), "head": np.array([self.entry, int(self.metric), len(self.layers)])}
        for l, links in enumerate(self.layers):
            nodes = np.array(sorted(links), dtype=np.int32)
            arrays[f"n{l}"] = nodes
            arrays[f"s{l}"] = np.array([len(links[int(n)]) for n in nodes], dtype=np.int32)
            arrays[f"t{l}"] = np.array([m for n in nodes for m in links[int(n)]], dtype=np.int32)
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as z:
            entry, metric, n = (int(v) for v in z["head"])
            g = cls(z["ids"], z["x"].astype(np.float64), Metric(metric))
            g.entry = entry
            for l in range(n):
                ends = np.cumsum(z[f"s{l}"])
                g.layers.append({int(a): part.tolist() for a, part in zip(z[f"n{l}"], np.split(z[f"t{l}"], ends[:-1]))})
        return g

    def search(self, q: np.ndarray, k: int, width: int, gone: frozenset[int] = frozenset()) -> list[tuple[float, int]]:
        """(distance, id) of the nearest found, nearest first; nodes that are `gone` lead on, but are not found.

        The beam widens until k are found that are not gone, or it holds the whole graph.
        """
        if not len(self.ids):
            return []
        at = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = [self.beam(q, at, 1, layer)[0][1]]
        width = max(width, k)
        while True:
            found = [(a, int(self.ids[n])) for a, n in self.beam(q, at, width, 0)]
            left = [x for x in found if x[1] not in gone]
            if len(left) >= k or len(left) == len(found) or width >= len(self.ids):
                return left[:k]
            width *= 2


def earlier(x: np.ndarray, metric: Metric, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, earlier row, distance) of each row's k nearest earlier rows, nearest first: matrix products over the part."""
    out = []
    for lo in range(1, len(x), 256):
        hi = min(lo + 256, len(x))
        d = kernels.distances(metric, x[lo:hi], x[: hi - 1])
        d[np.arange(hi - 1)[None, :] >= np.arange(lo, hi)[:, None]] = np.inf
        i, j = kernels.top_k(d, np.arange(hi - 1), k)
        real = d[i, j] < np.inf
        out.append((i[real] + lo, j[real], d[i, j][real]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def connect(g: Graph, layer: int, most: int) -> None:
    """Links to the nodes that the entry doesn't reach, from the nearest that it reaches, in place of a far link that no node needs."""
    links, needed = g.layers[layer], {}
    seen = np.zeros(len(g.ids), dtype=bool)

    def walk(start: int) -> None:
        seen[start], todo = True, [start]
        while todo:
            n = todo.pop()
            for b in links.get(n, ()):
                if not seen[b]:
                    seen[b] = True
                    needed.setdefault(n, set()).add(b)
                    todo.append(b)

    walk(g.entry)
    for n in sorted(links):
        if seen[n]:
            continue
        reached = np.flatnonzero(seen)
        for p in reached[np.argsort(g.near(g.x[n], reached), kind="stable")].tolist():
            out, keep = links.setdefault(p, []), needed.setdefault(p, set())
            if len(out) >= most:
                spare = [b for b in out if b not in keep]
                if not spare:
                    continue
                out.remove(spare[int(g.near(g.x[p], spare).argmax())])
            out.append(n)
            keep.add(n)
            break
        walk(n)


def small_world(ids: np.ndarray, x: np.ndarray, metric: Metric, m: int = 16, ef: int = 200, seed: int = 20) -> Graph:
    """Layered graph: nodes rise to a layer with geometric chance and link to their m nearest earlier nodes, and those back to them, 2m on the ground.

    Parts are small, so the nearest earlier nodes come from matrix products over the part: those that a beam of any width `ef` looks for.
    """
    m = min(max(m, 2), 1024)
    g, rng = Graph(ids, x, metric), np.random.default_rng(seed)
    top = np.minimum((-np.log(np.maximum(rng.random(len(ids)), 1e-12)) / math.log(m)).astype(int), 47)
    if not len(ids):
        return g
    g.entry = int(top.argmax())
    for layer in range(int(top.max()) + 1):
        nodes, most = np.flatnonzero(top >= layer), 2 * m if layer == 0 else m
        i, j, d = earlier(x[nodes], metric, m)
        a, b, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
        order = np.lexsort((b, d, a))
        a, b = a[order], b[order]
        kept = np.arange(len(a)) - np.searchsorted(a, a) < most
        ends = np.searchsorted(a[kept], np.arange(1, len(nodes)))
        g.layers.append({int(n): out.tolist() for n, out in zip(nodes, np.split(nodes[b[kept]], ends))})
        connect(g, layer, most)
    return g


def robust_prune(g: Graph, n: int, nodes: list[int], alpha: float, r: int) -> list[int]:
    """Nearest first; a candidate goes if an accepted one is alpha times nearer to it than the node is."""
    c = np.array(sorted(set(nodes) - {n}), dtype=np.int64)
    if not len(c):
        return []
    far = kernels.distances(g.metric, g.x[np.append(c, n)], g.x[c])
    order = np.argsort(far[-1], kind="stable")
    live, kept = np.ones(len(c), dtype=bool), []
    for p in order:
        if live[p]:
            kept.append(int(c[p]))
            if len(kept) == r:
                break
            live &= alpha * far[p] > far[-1]
    return kept


def pruned_flat(ids: np.ndarray, x: np.ndarray, metric: Metric, r: int = 32, l: int = 100, alpha: float = 1.2, seed: int = 31) -> Graph:
    """Flat graph searched from the row nearest to the mean; each node's links are pruned for spread, twice over."""
    l, alpha = max(l, r), alpha if alpha >= 1 else 1.2
    g = Graph(ids, x, metric)
    if not len(ids):
        g.layers = [{}]
        return g
    g.entry = int(kernels.l2_squared(x.mean(0)[None, :], x)[0].argmin())
    order = np.random.default_rng(seed).permutation(len(ids))
    order = np.concatenate([[g.entry], order[order != g.entry]])
    links: dict[int, list[int]] = {n: [] for n in range(len(ids))}
    g.layers = [links]
    for again in (False, True):
        # candidates: the nearest of the nodes that come before in a random order, which gives long links; then the nearest of all
        if again:
            i, j, _ = kernels.nearest(metric, x, x, np.arange(len(ids)), l + 1, DIGITS)
        else:
            i, j, _ = earlier(x[order], metric, l)
            i, j = order[i], order[j]
        by = np.argsort(i, kind="stable")
        near = np.split(j[by], np.searchsorted(i[by], np.arange(1, len(ids))))
        for n, c in enumerate(near):
            links[n] = robust_prune(g, n, c.tolist() + links[n], alpha, r)
        back: dict[int, list[int]] = {}
        for n, out in list(links.items()):
            for b in out:
                back.setdefault(b, []).append(n)
        for n, c in back.items():
            both = list(dict.fromkeys(links[n] + c))
            links[n] = robust_prune(g, n, both, alpha, r) if len(both) > r else both
    connect(g, 0, r)
    return g


def build(rows: DataFrame, make, part_rows: int = PART_ROWS) -> DataFrame:
    """(part, parts, graph): one of `parts` parts of about `part_rows` rows; `make(ids, x)` builds one."""
    parts = max(1, -(-rows.count() // part_rows))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        g = make(pdf["id"].to_numpy(), kernels.matrix(pdf["vector"]))
        return pd.DataFrame({"part": [key[0]], "parts": [parts], "graph": [g.to_bytes()]})

    return topk.dealt(rows.select("id", "vector"), "id", parts, "part").groupBy("part").applyInPandas(run, "part int, parts int, graph binary")


def build_small_world(rows: DataFrame, metric: Metric = Metric.L2, m: int = 16, ef_construction: int = 200, part_rows: int = PART_ROWS) -> DataFrame:
    return build(rows, lambda ids, x: small_world(ids, x, metric, m, ef_construction), part_rows)


def build_pruned_flat(rows: DataFrame, metric: Metric = Metric.L2, r: int = 32, l: int = 100, alpha: float = 1.2, part_rows: int = PART_ROWS) -> DataFrame:
    return build(rows, lambda ids, x: pruned_flat(ids, x, metric, r, l, alpha), part_rows)


def search(queries: DataFrame, index: DataFrame, k: int, width: int = 50, gone: DataFrame | None = None) -> DataFrame:
    """Every part is searched with a beam of max(width, k); the k best of all parts are returned.

    `gone(id)` are rows that are no longer there; each part gets those that were dealt to it.  One block of queries goes with the
    tasks; more are dealt to blocks, and each pair of a block and a part is a task.
    """
    queries = queries.select("query_id", "query")
    first = index.select("parts").limit(1).collect()
    q_blocks, n = topk.blocks(queries, "query")
    if not n or not first or k <= 0:
        return ranked(queries.sparkSession.createDataFrame([], FOUND), k).select("query_id", "rank", "id", "distance")
    parts = first[0]["parts"]
    none = F.array().cast("array<long>")
    index = index.select("part", "graph")
    if gone is None:
        index = index.withColumn("gone", none)
    else:
        lists = topk.dealt(gone.select("id"), "id", parts, "part").groupBy("part").agg(F.collect_set("id").alias("gone"))
        index = index.join(lists, "part", "left").withColumn("gone", F.coalesce("gone", none))

    def found_in(graphs: pd.DataFrame, q: np.ndarray, qid: np.ndarray) -> pd.DataFrame:
        got, wide = [], []
        for raw, missing in zip(graphs["graph"], graphs["gone"]):
            g, away = Graph.from_bytes(raw), frozenset(int(i) for i in missing)
            if max(width, k) >= len(g.ids):  # nothing that is reached leaves such a beam
                nodes = g.reached()
                nodes = nodes[~np.isin(g.ids[nodes], list(away))] if away else nodes
                wide.append((g.metric, g.ids[nodes], g.x[nodes]))
            else:
                rows = [(i, x, round(a, DIGITS)) for i, v in zip(qid, q) for a, x in g.search(v, k, width, away)]
                got.append(pd.DataFrame(rows, columns=["query_id", "id", "distance"]))
        if wide and sum(len(w[1]) for w in wide):
            ids = np.concatenate([w[1] for w in wide])
            i, j, d = kernels.nearest(wide[0][0], q, np.concatenate([w[2] for w in wide]), ids, k, DIGITS)
            got.append(pd.DataFrame({"query_id": qid[i], "id": ids[j], "distance": d}))
        return pd.concat(got) if got else pd.DataFrame({"query_id": [], "id": [], "distance": []})

    cores = queries.sparkSession.sparkContext.defaultParallelism
    groups = max(min(parts, 2 * cores), -(-parts // 64))  # a task takes several small parts, and sends the best of each only if they are searched by beams
    q_blocks = max(q_blocks, 1) if n <= topk.MANY_QUERIES else max(q_blocks, -(-3 * cores // groups))
    if q_blocks <= 1:
        block = queries.toPandas()
        q, qid = kernels.matrix(block["query"]), block["query_id"].to_numpy()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield found_in(b, q, qid)

        found = index.select("graph", "gone").mapInPandas(run, FOUND)
    else:

        def meet(ask: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(ask) or not len(x):
                return pd.DataFrame({"query_id": [], "id": [], "distance": []})
            return found_in(x, kernels.matrix(ask["query"]), ask["query_id"].to_numpy())

        pair, pairs = (F.col("q_block") * groups + F.col("grp")).alias("pair"), q_blocks * groups
        left = topk.in_each(topk.dealt(queries, "query_id", q_blocks, "q_block"), groups, "grp").select(pair, "query_id", "query").repartition(pairs, "pair")
        right = topk.in_each(index.withColumn("grp", F.col("part") % groups), q_blocks, "q_block").select(pair, "graph", "gone").repartition(pairs, "pair")
        found = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(meet, FOUND)
    return ranked(found, k).select("query_id", "rank", "id", "distance")
