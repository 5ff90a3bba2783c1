"""The same distances between all rows of two matrices, for Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd

from ..types import EPSILON, Metric


def matrix(column: pd.Series, dim: int | None = None) -> np.ndarray:
    """Rows of an array column as doubles."""
    if not len(column):
        return np.zeros((0, dim or 1))
    return np.stack(column.to_numpy()).astype(np.float64)


def l2_squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * (q @ x.T)
    # differences of large squares lose digits when vectors are close: those are taken again, directly
    scale = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
    i, j = np.nonzero(d < 1e-6 * scale)
    if len(i):
        for lo in range(0, len(i), 1 << 16):
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            d[a, b] = ((q[a] - x[b]) ** 2).sum(1)
    return np.maximum(d, 0.0)


def _pairwise(q: np.ndarray, x: np.ndarray, f) -> np.ndarray:
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        out[i] = f(row, x)
    return out


def distances(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, rows) distances; an unknown metric is L2."""
    if metric == Metric.COSINE:
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        near = np.clip((q @ x.T) / np.where(size < EPSILON, 1.0, size), -1.0, 1.0)
        return np.where(size < EPSILON, 1.0, 1.0 - near)
    if metric == Metric.IP:
        return -(q @ x.T)
    if metric == Metric.L1:
        return _pairwise(q, x, lambda a, b: np.abs(b - a).sum(1))
    if metric == Metric.HAMMING:
        return _pairwise(q, x, lambda a, b: (b != a).sum(1).astype(float))
    return np.sqrt(l2_squared(q, x))


def top_k(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k smallest, by value, then id."""
    rows, cols = [], []
    for i, row in enumerate(d):
        if 0 < k < len(row):
            at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
        else:
            at = np.arange(len(row)) if k > 0 else np.empty(0, dtype=np.int64)
        best = at[np.lexsort((ids[at], row[at]))[: max(k, 0)]]
        rows.append(np.full(len(best), i))
        cols.append(best)
    if not rows:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(cols)


#: Pairs whose exact distance is taken in one go, rows of a tile of rough distances, and pairs of a block of queries from which all distances are taken exactly.
_PAIRS, _TILE, _ASKS, _DENSE = 1 << 14, 1 << 14, 256, 1 << 21
_U = 2.0**-23  # a rounding in single precision is at most half of this


def pairwise(metric: Metric, a: np.ndarray, b: np.ndarray, squared: bool = False) -> np.ndarray:
    """Distance of each row of a to the same row of b; `squared` is for L2."""
    if metric == Metric.COSINE:
        size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return np.where(size < EPSILON, 1.0, 1.0 - np.clip((a * b).sum(1) / np.where(size < EPSILON, 1.0, size), -1.0, 1.0))
    if metric == Metric.IP:
        return -(a * b).sum(1)
    if metric == Metric.L1:
        return np.abs(b - a).sum(1)
    if metric == Metric.HAMMING:
        return (b != a).sum(1).astype(float)
    d = ((a - b) ** 2).sum(1)
    return d if squared else np.sqrt(d)


class _Rough:
    """Values that order rows like their distances, each off by at most `error` of its query: products in single precision."""

    def __init__(self, a: np.ndarray, b: np.ndarray, error: np.ndarray, margin):
        self.a, self.b, self.error, self.margin = a.astype(np.float32), b.astype(np.float32), error, margin

    def values(self, q: slice, x: slice) -> np.ndarray:
        return self.a[q] @ self.b[x].T


class _RoughL1(_Rough):
    """Sums of differences between components in whole steps, so small that a sum fits 16 bits; what rounding to steps adds is known."""

    def __init__(self, a: np.ndarray, b: np.ndarray, margin):
        low = min(a.min(), b.min())
        self.step = max(max(a.max(), b.max()) - low, 1e-30) / (65_000 // a.shape[1])
        whole = [np.rint((y - low) / self.step) for y in (a, b)]
        lost_a, lost_b = (np.abs(y - low - w * self.step).sum(1) for y, w in zip((a, b), whole))
        self.a, self.b = (w.astype(np.int16) for w in whole)
        self.error, self.margin = (lost_a + lost_b.max() + a.shape[1] * self.step * 1e-4) * 1.001, margin

    def values(self, q: slice, x: slice) -> np.ndarray:
        a, b = self.a[q], np.ascontiguousarray(self.b[x].T)
        out, gap = np.zeros((len(a), b.shape[1]), np.uint16), np.empty(b.shape[1], np.int16)
        for row, total in zip(a, out):
            for one, column in zip(row, b):
                np.subtract(column, one, out=gap)
                np.abs(gap, out=gap)
                np.add(total, gap.view(np.uint16), out=total)
        return out * np.float32(self.step)


def _rough(metric: Metric, q: np.ndarray, x: np.ndarray, squared: bool) -> _Rough | None:
    """None where single precision can't tell the rows apart safely."""
    top = max(np.abs(q).max(initial=0.0), np.abs(x).max(initial=0.0))
    if not top < 1e15:  # also if not a number
        return None
    p, flat = q.shape[1] + 8, lambda s, i: np.full(len(i), 2e-6)
    norm = lambda y: np.linalg.norm(y, axis=1)
    if metric == Metric.COSINE:
        nq, nx = norm(q), norm(x)
        least = min(nq[nq > 0], default=1.0) * min(nx[nx > 0], default=1.0)
        if least < EPSILON:
            return None
        return _Rough(q / np.where(nq > 0, nq, 1.0)[:, None], -x / np.where(nx > 0, nx, 1.0)[:, None], np.full(len(q), p * _U), flat)
    if metric == Metric.IP:
        return _Rough(q, -x, p * _U * (norm(q) * norm(x).max() + 1e-30), flat)
    if metric == Metric.HAMMING:
        two = np.unique(x[:64])[:2]
        if len(two) < 2 or not (((q == two[0]) | (q == two[1])).all() and ((x == two[0]) | (x == two[1])).all()):
            return None
        sign = lambda y: np.where(y == two[1], 1.0, -1.0)
        return _Rough(sign(q), -sign(x), np.full(len(q), 0.25), flat)
    centre = x.mean(0)
    a, b = q - centre, x - centre
    if metric == Metric.L1:
        return _RoughL1(a, b, flat) if q.shape[1] <= 256 else None
    qa, xb = (a * a).sum(1), (b * b).sum(1)
    error = p * _U * (qa + 2 * xb.max()) + 1e-30
    one = np.ones((len(a), 1))

    def margin(s: np.ndarray, i: np.ndarray) -> np.ndarray:
        """What two millionths of the distance are in the values, which are squares without that of the query."""
        return np.full(len(i), 2e-6) if squared else 4e-6 * np.sqrt(np.maximum(s + qa[i] + error[i], 0.0)) + 1e-11

    return _Rough(np.hstack([a, one]), np.hstack([-2 * b, xb[:, None]]), error, margin)


def nearest(metric: Metric, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, digits: int, squared: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest, by the distance rounded to `digits` (six or more), then id; nearest first.

    Rows are told apart by single-precision values with a bound on their error; the distances of all that may be among the k are
    taken exactly.  So the result is that of exact distances to all rows, whatever the bound lets through.
    """
    k = min(k, len(x))
    if k <= 0 or not len(q):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    rough = _rough(metric, q, x, squared) if len(x) > max(64, 2 * k) else None
    got = [_screened(metric, q, x, ids, k, digits, squared, rough, lo, min(lo + _ASKS, len(q))) for lo in range(0, len(q), _ASKS)]
    i, j, d = (np.concatenate(c) for c in zip(*got))
    return i, j, d


def _dense(metric: Metric, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, digits: int, squared: bool, at: int, to: int):
    out, step = [], max(1, 4_000_000 // len(x))
    for lo in range(at, to, step):
        part = q[lo : min(lo + step, to)]
        d = np.round(l2_squared(part, x) if squared else distances(metric, part, x), digits)
        i, j = top_k(d, ids, k)
        out.append((i + lo, j, d[i, j]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _screened(metric: Metric, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, digits: int, squared: bool, rough: _Rough | None, at: int, to: int):
    if rough is None:
        return _dense(metric, q, x, ids, k, digits, squared, at, to)
    rows, where, tile = np.arange(at, to), slice(at, to), max(_TILE, 2 * k)
    limit, held, n = np.full(to - at, np.inf), [], 0

    def drawn_in() -> None:
        """Limits from what is held, which shrinks to that."""
        nonlocal limit, held, n
        i, j, s = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((s, i))
        i, j, s = i[order], j[order], s[order]
        start = np.searchsorted(i, np.arange(to - at))
        full = np.searchsorted(i, np.arange(to - at), "right") - start >= k
        kth = s[np.minimum(start + k - 1, len(s) - 1)].astype(np.float64)
        now = kth + 2 * rough.error[rows] + rough.margin(kth, rows)
        limit = np.where(full, np.minimum(limit, now), limit)
        keep = s <= limit[i]
        held, n = [(i[keep], j[keep], s[keep])], int(keep.sum())

    for lo in range(0, len(x), tile):
        s = rough.values(where, slice(lo, lo + tile))
        if not lo:
            kth = np.partition(s[:, : max(4096, 2 * k)], k - 1, axis=1)[:, k - 1].astype(np.float64)
            limit = kth + 2 * rough.error[rows] + rough.margin(kth, rows)
        i, j = np.divmod(np.flatnonzero(s <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]), s.shape[1])
        held.append((i, j + lo, s[i, j]))
        n += len(i)
        if n > 40 * k * (to - at):
            drawn_in()
        if n > _DENSE:
            return _dense(metric, q, x, ids, k, digits, squared, at, to)
    drawn_in()
    i, j, _ = held[0]
    d = np.concatenate([pairwise(metric, q[i[lo : lo + _PAIRS] + at], x[j[lo : lo + _PAIRS]], squared) for lo in range(0, len(i), _PAIRS)])
    d = np.round(d, digits)
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best] + at, j[best], d[best]
