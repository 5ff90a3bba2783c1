"""Near-duplicate vectors: cover trees traversed against each other.

Unit vectors, so that a cosine of at least c is a distance of at most sqrt(2 - 2c).  A tree has nested levels of centres with
halving radii; every vector descends to the nearest centre below the one it is under, and the covering radius of each
node is measured over all vectors below it.  Two nodes are farther apart than their centres' distance less both radii,
which prunes pairs of nodes from the roots down.  What survives at the leaves is compared exactly, in double precision.

The upper tree's centres come from a bounded sample, its radii from all rows.  Its leaves, in order, are dealt to blocks of
bounded size (a large leaf to several), and pairs of blocks with surviving leaves are compared by one task each.  A task
grows the lower levels: a tree of its own for either block, traversed against each other in the same way.  Equal vectors
are one node with a count, so copies are never compared with each other.  A task returns, for each vector, how many
vectors it links to, and a spanning forest of its links; pairs never leave it.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing: no links, their own
component, kept; vectors of different lengths don't link (each length is a pass of its own); a null id has no component
and is not kept; rows that repeat an id link with each other if their vectors do; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise
from .permutation import stacked, usable

COSINE = 0.9
#: Vectors of the sample that the upper tree's centres are taken from, and those of a task's block that its tree's are.
SAMPLE, LOCAL = 2048, 512
#: Numbers that a block holds at most, and the least blocks that a table of some size is cut into.
BLOCK_FLOATS, LEAST_BLOCKS, LEAST_ROWS = 1 << 20, 4, 1024
SEED = 5
_ROWS = 512


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


class Tree:
    """Levels of centres with halving radii: `levels[l]` are unit vectors, `parent[l]` their nodes one level up."""

    def __init__(self, sample: np.ndarray):
        self.levels: list[np.ndarray] = [sample[:1]]
        self.parent: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
        radius, at = 2.0, np.zeros(len(sample), dtype=np.int64)
        while radius > 0.05 and len(self.levels[-1]) < len(sample):
            radius /= 2
            centres, parents = [], []
            for up in range(len(self.levels[-1])):
                # greedy net of the sample vectors under one node: its own centre first, then whatever is left uncovered
                todo = np.concatenate([self.levels[-1][up : up + 1], sample[at == up]])
                while len(todo):
                    centres.append(todo[0].copy())
                    parents.append(up)
                    todo = todo[((todo - todo[0]) ** 2).sum(1) > radius * radius]
            self.levels.append(np.stack(centres))
            self.parent.append(np.array(parents))
            at = self._descend(sample, at, len(self.levels) - 1)

    def _descend(self, x: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """Node of each vector at a level: the nearest centre under `at`, its node above."""
        # children of a node stand together, its own centre first
        first = np.searchsorted(self.parent[level], np.arange(len(self.levels[level - 1]) + 1))
        out = first[at]
        by = np.argsort(at, kind="stable")
        ups, starts = np.unique(at[by], return_index=True)
        for up, rows in zip(ups.tolist(), np.split(by, starts[1:])):
            if first[up + 1] - first[up] > 1:
                below = self.levels[level][first[up] : first[up + 1]]
                for lo in range(0, len(rows), _ROWS):
                    part = rows[lo : lo + _ROWS]
                    out[part] = first[up] + (x[part] @ below.T).argmax(1)
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(1, len(self.levels)):
            at = self._descend(x, at, level)
        return at

    def ancestors(self) -> list[np.ndarray]:
        """Of each leaf, its node at every level."""
        out = [np.arange(len(self.levels[-1]))]
        for l in range(len(self.levels) - 1, 0, -1):
            out.append(self.parent[l][out[-1]])
        return out[::-1]

    def distances(self, x: np.ndarray, leaf: np.ndarray) -> list[np.ndarray]:
        """Of each vector, that to its node's centre at every level."""
        return [np.sqrt(((x - self.levels[l][anc[leaf]]) ** 2).sum(1)) if len(x) else np.zeros(0) for l, anc in enumerate(self.ancestors())]

    def radii(self, leaf: np.ndarray, far: list[np.ndarray]) -> list[np.ndarray]:
        """Covering radius of every node, by level; -1 where nothing is below it."""
        out = []
        for l, anc in enumerate(self.ancestors()):
            r = np.full(len(self.levels[l]), -1.0)
            np.maximum.at(r, anc[leaf], far[l])
            out.append(r)
        return out


def dual_traversal(a: Tree, ra: list[np.ndarray], b: Tree, rb: list[np.ndarray], reach: float) -> tuple[np.ndarray, int]:
    """(matrix of the leaves of a and b that may hold a pair within `reach` of each other, node pairs visited)."""
    meet, visited = np.ones((1, 1), dtype=bool), 1
    for l in range(1, max(len(a.levels), len(b.levels))):
        la, lb = min(l, len(a.levels) - 1), min(l, len(b.levels) - 1)
        up = [t.parent[k] if k == l else np.arange(len(t.levels[k])) for t, k in ((a, la), (b, lb))]
        meet = meet[np.ix_(*up)] & (ra[la] >= 0)[:, None] & (rb[lb] >= 0)[None, :]
        visited += int(meet.sum())
        for lo in range(0, len(meet), _ROWS):
            d = np.sqrt(np.maximum(2 - 2 * a.levels[la][lo : lo + _ROWS] @ b.levels[lb].T, 0))
            meet[lo : lo + _ROWS] &= d - ra[la][lo : lo + _ROWS, None] - rb[lb][None, :] <= reach + 1e-9
    return meet, visited


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links (a, b), starting from what `label` already joins."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


class Block:
    """The vectors of a block under a tree of its own."""

    def __init__(self, x: np.ndarray):
        self.x, self.tree = x, Tree(x[:LOCAL])
        self.leaf = self.tree.leaves(x)
        self.radius = self.tree.radii(self.leaf, self.tree.distances(x, self.leaf))


def compare(x: Block, y: Block, least: float, reach: float, stats: dict[str, int]):
    """Links of x's rows to y's (each pair once if they are the same block): yields index arrays, exact in double precision."""
    meet, visited = dual_traversal(x.tree, x.radius, y.tree, y.radius, reach)
    stats["visited"] += visited
    stats["total"] += len(x.x) * len(y.x)
    if meet[x.leaf].sum(0)[y.leaf].sum() * 2 > len(x.x) * len(y.x):
        # most pairs survive: whole rows are quicker than picking them
        todo = [(np.arange(lo, min(lo + _ROWS, len(x.x))), slice(None)) for lo in range(0, len(x.x), _ROWS)]
    else:
        todo = [(rows, np.flatnonzero(meet[leaf][y.leaf])) for leaf in np.unique(x.leaf) for rows in [np.flatnonzero(x.leaf == leaf)]]
        todo = [(rows[lo : lo + _ROWS], cols) for rows, cols in todo if len(cols) for lo in range(0, len(rows), _ROWS)]
    for rows, cols in todo:
        z = y.x[cols]
        stats["compared"] += len(rows) * len(z)
        i, j = np.nonzero(x.x[rows] @ z.T >= least)
        i, j = rows[i], j if isinstance(cols, slice) else cols[j]
        yield (i[i < j], j[i < j]) if x is y else (i, j)


def _block_pairs(spark, ok: np.ndarray, size: np.ndarray, rows: int) -> tuple[DataFrame, DataFrame]:
    """((leaf, first, spread): a leaf's blocks; (a, b): pairs of blocks with surviving leaves, a <= b).

    Leaves in order fill a block of about `rows` vectors, a larger one has several blocks to itself: that is a group.  Pairs of groups
    are at most half the square of the upper tree's leaves, a bound that the sample sets; those of blocks, which grow with the
    table, are unfolded by the executors.
    """
    live = np.flatnonzero(size)
    group, first, spread, room = [], [], [], 0
    for n in size[live].tolist():
        if n > room:
            first.append(first[-1] + spread[-1] if first else 0)
            spread.append(max(1, -(-n // rows)))
            room = rows if spread[-1] == 1 else 0
        room = max(0, room - n) if spread[-1] == 1 else 0
        group.append(len(first) - 1)
    where = pd.DataFrame({"leaf": live, "first": np.array(first, dtype=np.int64)[group], "spread": np.array(spread, dtype=np.int64)[group]})
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    meets = np.logical_or.reduceat(np.logical_or.reduceat(ok[np.ix_(live, live)], starts, axis=0), starts, axis=1)
    i, j = np.nonzero(np.triu(meets))
    f, s = np.array(first), np.array(spread)
    groups = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "fi": f[i], "si": s[i], "fj": f[j], "sj": s[j]}))
    pairs = groups.select("i", "j", "fj", "sj", F.explode(F.sequence("fi", F.col("fi") + F.col("si") - 1)).alias("a"))
    pairs = pairs.select("a", F.explode(F.sequence("fj", F.col("fj") + F.col("sj") - 1)).alias("b")).where("a <= b")
    return spark.createDataFrame(where), pairs


def _links(nodes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(rid, links, joined, visited, compared, total) of the nodes (v, rid, copies), all of one length.

    A row for each vector of a task that has links; and one without `rid` for each task, with its counts.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    tree = Tree(unit(stacked(nodes.orderBy(F.xxhash64("v", F.lit(SEED)), "rid").limit(SAMPLE).select("v").toPandas()["v"])))

    def place(batches):
        for b in batches:
            u = unit(stacked(b["v"]))
            leaf = tree.leaves(u) if len(u) else np.zeros(0, dtype=np.int64)
            out = b[["rid", "copies"]].copy()
            out["leaf"] = leaf
            out["u"] = [r.tobytes() for r in u]
            for l, d in enumerate(tree.distances(u, leaf)):
                out[f"r{l}"] = d
            yield out

    far = [f"r{l}" for l in range(len(tree.levels))]
    placed = materialise(nodes.mapInPandas(place, "rid long, copies long, leaf long, u binary, " + ", ".join(f"{c} double" for c in far)), "cover-nodes")
    stats = placed.groupBy("leaf").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in far)).toPandas()
    radius = tree.radii(stats["leaf"].to_numpy(), [stats[c].to_numpy() for c in far])
    ok, visited = dual_traversal(tree, radius, tree, radius, reach)
    size = np.zeros(len(ok), dtype=np.int64)
    size[stats["leaf"].to_numpy()] = stats["n"].to_numpy()
    rows = min(max(1, BLOCK_FLOATS // dim), max(LEAST_ROWS, -(-int(size.sum()) // LEAST_BLOCKS)))
    where, pairs = _block_pairs(nodes.sparkSession, ok | ok.T, size, rows)
    sides = pairs.select(F.col("a").alias("block"), "a", "b", F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select(F.col("b").alias("block"), "a", "b", F.lit(1).alias("side")))
    # a row for each leaf of the upper tree
    dealt = placed.select("rid", "copies", "leaf", "u").join(F.broadcast(where), "leaf").select("rid", "copies", "u", (F.col("first") + F.pmod(F.xxhash64("rid"), "spread")).alias("block"))

    def meet(_key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "rid"], kind="stable")
        u = np.frombuffer(b"".join(pdf["u"]), dtype=np.float64).reshape(len(pdf), -1)
        copies, rid = pdf["copies"].to_numpy(), pdf["rid"].to_numpy()
        k = int((pdf["side"] == 0).sum())
        x = Block(u[:k])
        y = Block(u[k:]) if k < len(u) else x
        found, label, count = np.zeros(len(u), dtype=np.int64), np.arange(len(u)), {"visited": 0, "compared": 0, "total": 0}
        for i, j in compare(x, y, cosine, reach, count):
            j = j if y is x else j + k
            np.add.at(found, i, copies[j])
            np.add.at(found, j, copies[i])
            label = forest(len(u), i, j, label) if len(i) else label
        at = np.flatnonzero(found)
        out = pd.DataFrame({"rid": pd.array([*rid[at], None], dtype="Int64"), "links": [*found[at], 0], "joined": [*rid[label[at]], 0]})
        for name, n in count.items():
            out[name] = [0] * len(at) + [n]
        return out

    schema = "rid long, links long, joined long, visited long, compared long, total long"
    got = dealt.join(sides, "block").groupBy("a", "b").applyInPandas(meet, schema)
    upper = nodes.sparkSession.createDataFrame([(None, 0, 0, visited, 0, 0)], schema)
    return materialise(got.unionByName(upper), "cover-links")


def _found(vectors: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame] | None:
    """(nodes (v, rid, id, copies), their links), or None without a vector that takes part."""
    good = materialise(usable(vectors), "cover-rows")
    nodes = good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    # rows of one id may hold several vectors, so a node has a number of its own
    nodes = materialise(nodes.withColumn("rid", F.monotonically_increasing_id()), "cover-vectors")
    lengths = sorted(r["d"] for r in good.select(F.size("v").alias("d")).distinct().collect())
    passes = [_links(nodes.where(F.size("v") == d), d, cosine) for d in lengths]
    return (nodes, reduce(DataFrame.unionByName, passes)) if passes else None


def report(vectors: DataFrame, cosine: float = COSINE) -> dict[str, int]:
    """Node pairs visited, vector pairs compared, and vector pairs in all, of the tasks' blocks and the upper tree."""
    found = _found(vectors, cosine)
    return {k: int(v or 0) for k, v in found[1].where("rid IS NULL").agg(*(F.sum(c).alias(c) for c in ("visited", "compared", "total"))).first().asDict().items()} if found else {}


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors`."""
    found = _found(vectors, cosine)
    if found is None:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    nodes, got = found[0], found[1].where("rid IS NOT NULL").select("rid", "links", "joined")
    comp = connected_components(got.select(F.col("rid").alias("a"), F.col("joined").alias("b")).distinct())
    comp = comp.withColumnRenamed("node", "rid").join(nodes.select("rid", "id"), "rid")
    least = comp.groupBy("component").agg(F.min("id").alias("least"))
    links = got.groupBy("rid").agg(F.sum("links").alias("links"))
    per_node = (
        nodes.join(links, "rid", "left")
        .join(comp.select("rid", "component").join(least, "component"), "rid", "left")
        .select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    )
    row = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull(), F.col("embedding")).alias("_v"))
    out = row.join(per_node, "_v", "left")
    comp_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))
