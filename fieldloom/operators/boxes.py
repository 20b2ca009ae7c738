"""Median splits, boxes and nearest points of arrays, for one batch or one leaf."""

from __future__ import annotations

import numpy as np

#: Points that are compared with a target one by one; more are parted by medians. Distances of one round, which a core's cache holds.
DIRECT, AT_ONCE = 4096, 1 << 17
#: Groups, at least, whose least distances bound the k-th one; no distance is greater than the last of these.
GROUPS, FINITE = 64, np.finfo(float).max


def splits(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) by node of a complete binary tree (children of i at 2i + 1 and 2i + 2) with ``leaves`` leaves or more:
    each node is cut at the median of its widest dimension; what equals the value goes to the left."""
    depth = max(1, int(np.ceil(np.log2(leaves))))
    dims, values = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    parts = {0: sample}
    for node in range(2**depth - 1):
        x = parts.pop(node)
        if len(x):
            d = int((x.max(0) - x.min(0)).argmax())
            v = np.median(x[:, d])
            dims[node], values[node] = d, v
        left = x[:, dims[node]] <= values[node] if len(x) else np.zeros(0, bool)
        parts[2 * node + 1], parts[2 * node + 2] = x[left], x[~left]
    return dims, values


def descend(tree: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of each point, from 0."""
    dims, values = tree
    node = np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(len(dims) + 1))):
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > values[node])
    return (node - len(dims)).astype(np.int32)


def distances(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes): squared distance to each box, 0 inside; a little less than exact, so that rounding shuts nothing out."""
    out = np.zeros((len(x), len(low)))
    for i in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, i] - x[:, None, i], x[:, None, i] - high[None, :, i]), 0.0)
        out += gap * gap
    return out * (1 - 1e-12)


def about(x: np.ndarray, low: np.ndarray, high: np.ndarray, bound: float = -np.inf, nearest: int = 0, open_: np.ndarray | None = None, most: float = np.inf) -> np.ndarray:
    """Numbers of the boxes among which each of the points ``x`` has all that lie no farther than the root of ``bound``, and the
    ``nearest`` boxes as far as the root of ``most``: what the points' own box tells. ``open_``: boxes that count for all of them."""
    a, b = x.min(0), x.max(0)
    gap = np.maximum(np.maximum(low - b, a - high), 0.0)
    least = (gap * gap).sum(1)
    if nearest:
        gap = np.maximum(np.maximum(low - a, b - high), 0.0)
        reach = (gap * gap).sum(1)
        reach = reach if open_ is None else reach[open_]
        bound = max(bound, min(most, np.partition(reach, nearest - 1)[nearest - 1] if len(reach) >= nearest else np.inf))
    return np.flatnonzero(least * (1 - 1e-9) <= bound)


def farthest(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes): squared distance to each box's farthest corner."""
    out = np.zeros((len(x), len(low)))
    for i in range(x.shape[1]):
        gap = np.maximum(np.abs(x[:, None, i] - low[None, :, i]), np.abs(x[:, None, i] - high[None, :, i]))
        out += gap * gap
    return out


def _room(x: np.ndarray, s: np.ndarray) -> tuple[int, np.ndarray]:
    """Points of a round, and the room that all rounds use again for their distances."""
    step = max(1, AT_ONCE // max(1, len(s)))
    return step, np.empty((2, min(step, len(x)), len(s)))


def _squares(x: np.ndarray, s: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    out, gap = np.empty((2, len(x), len(s))) if room is None else room[:, : len(x)]
    x, s = np.ascontiguousarray(x.T), np.ascontiguousarray(s.T)
    for i in range(len(x)):
        part = gap if i else out
        np.subtract(x[i][:, None], s[i][None], out=part)
        np.multiply(part, part, out=part)
        if i:
            np.add(out, gap, out=out)
    return out


def _bound(d2: np.ndarray, k: int) -> np.ndarray:
    """For each row a number that k of its distances do not exceed: the k-th of the least of groups, which is near the k-th of all."""
    groups = max(GROUPS, 8 * k)
    if d2.shape[1] >= 2 * groups:
        size = d2.shape[1] // groups
        d2 = d2[:, : size * groups].reshape(len(d2), size, groups).min(1)
    return np.partition(d2, k - 1, 1)[:, k - 1]


def parts(s: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows of ``s`` in leaves of about ``size``, and the leaves' boxes."""
    leaf = descend(splits(s[:: max(1, len(s) // 65_536)], -(-len(s) // size)), s)
    order = np.argsort(leaf, kind="stable")
    members = np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1)
    return members, *(np.array([f(s[m], 0) for m in members]) for f in (np.min, np.max))


def inside(x: np.ndarray, s: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, squared distance) of all points of ``s`` no farther from ``x`` than the root of ``bound``."""
    out = []
    step, room = _room(x, s)
    for at in range(0, len(x), step):
        d2 = _squares(x[at : at + step], s, room)
        rows, cols = np.nonzero(d2 <= bound[at : at + step, None])
        out.append((rows + at, cols, d2[rows, cols]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def count(x: np.ndarray, s: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of ``s`` lie no farther from each of ``x``; parts wholly inside are counted as they are."""
    members, low, high = parts(s, 256) if len(s) > 512 else ([np.arange(len(s))], *(f(s, 0, keepdims=True) for f in (np.min, np.max)))
    sizes, out = np.array([len(m) for m in members]), np.zeros(len(x), np.int64)
    for at in range(0, len(x), 1024):
        some = slice(at, at + 1024)
        whole = farthest(x[some], low, high) <= bound[some, None]
        cut = (distances(x[some], low, high) <= bound[some, None]) & ~whole
        out[some] += whole @ sizes
        for m in np.flatnonzero(cut.any(0)):
            rows = np.flatnonzero(cut[:, m]) + at
            out[rows] += (_squares(x[rows], s[members[m]]) <= bound[rows, None]).sum(1)
    return out


def _first(rows: np.ndarray, d2: np.ndarray, cols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each row by distance, then by column."""
    order = np.lexsort((cols, d2, rows))
    rows, d2, cols = rows[order], d2[order], cols[order]
    start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))[: len(rows)]
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
    return rows[rank < k], cols[rank < k], d2[rank < k]


def _direct(x: np.ndarray, s: np.ndarray, k: int, bound: np.ndarray, before) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = []
    step, room = _room(x, s)
    for at in range(0, len(x), step):
        some = slice(at, at + step)
        d2 = _squares(x[some], s, room)
        if before is not None and before[1].max(initial=-1) >= before[0][some].min():
            np.copyto(d2, np.inf, where=before[1][None] >= before[0][some, None])
        limit = np.minimum(bound[some], FINITE)
        if len(s) > k:
            limit = np.minimum(limit, _bound(d2, k))
        hits = np.flatnonzero(d2 <= limit[:, None])
        out.append(_first(hits // max(1, len(s)) + at, d2.ravel()[hits], hits % max(1, len(s)), k))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(x: np.ndarray, s: np.ndarray, k: int, bound: np.ndarray, before=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, squared distance) of the k points of ``s`` nearest to each of ``x``, no farther than the root of ``bound``;
    ties by column. ``before``: places of both in a path; only earlier ones count. Of many points, leaves are visited: the
    nearest first, then those that reach nearer than what was found."""
    if len(s) <= DIRECT:
        return _direct(x, s, k, bound, before)
    members, low, high = parts(s, DIRECT // 4)
    out = []
    for at in range(0, len(x), 1024):
        some = np.arange(at, min(at + 1024, len(x)))
        near, limit, got = distances(x[some], low, high), bound[some].copy(), []
        best = near.argmin(1)
        go = np.zeros(near.shape, bool)
        go[np.arange(len(some)), best] = near[np.arange(len(some)), best] <= limit
        for _ in range(2):
            for m in np.flatnonzero(go.any(0)):
                rows = np.flatnonzero(go[:, m])
                r, c, v = _direct(x[some[rows]], s[members[m]], k, limit[rows], None if before is None else (before[0][some[rows]], before[1][members[m]]))
                got.append((some[rows[r]], members[m][c], v))
                many = np.bincount(r, minlength=len(rows)) == k
                farthest = np.zeros(len(rows))
                np.maximum.at(farthest, r, v)
                limit[rows[many]] = np.minimum(limit[rows[many]], farthest[many])
            seen = go
            go = (near <= limit[:, None]) & ~seen
        if got:
            rows, cols, d2 = (np.concatenate(c) for c in zip(*got))
            out.append(_first(rows, d2, cols, k))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
