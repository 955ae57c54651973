"""Exact Lloyd assignment of integer points to entries by two trees.

One tree halves the points, one the entries, each node along the widest side of its box.
Pairs of nodes are walked from both roots down: a pair goes when the least distance between
its boxes is greater than the greatest distance from the point node's box to some entry node's
box. A point node left with one entry is assigned whole, by its cached sum and count; what
reaches the leaves with several entries is told apart by the distances themselves. Bounds and
distances are integers, so nothing is rounded, and only strictly farther entries are pruned,
so ties go to the lower index as in plain search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 4


@dataclass
class Tree:
    points: np.ndarray  # in the tree's order
    order: np.ndarray  # place in the tree -> row
    bounds: list[np.ndarray]  # per level: where its nodes begin, and the end
    low: list[np.ndarray]  # per level: node by dimension
    high: list[np.ndarray]
    total: np.ndarray  # prefix sums of the points: a node's cached sum is a difference

    @property
    def last(self) -> int:
        return len(self.bounds) - 1


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A balanced tree of ``points`` (rows by dimensions, integers, one row or more); a level's
    nodes are equal shares of the order, node k's halves are 2k and 2k + 1 below it."""
    n, dims = points.shape
    depth = 0
    while -(-n >> depth) > leaf:  # a leaf's size, rounded up
        depth += 1
    order = np.arange(n)
    bounds, low, high = [], [], []
    for level in range(depth + 1):
        at = (n * np.arange((1 << level) + 1)) >> level
        here = points[order]
        low.append(np.minimum.reduceat(here, at[:-1], axis=0))
        high.append(np.maximum.reduceat(here, at[:-1], axis=0))
        bounds.append(at)
        if level < depth and dims:
            node = np.repeat(np.arange(1 << level), np.diff(at))
            widest = (high[-1] - low[-1]).argmax(1)
            order = order[np.lexsort((here[np.arange(n), widest[node]], node))]
    ordered = points[order]
    total = np.zeros((n + 1, dims), np.int64)
    np.cumsum(ordered, axis=0, out=total[1:])
    return Tree(ordered, order, bounds, low, high, total)


def _below(nodes: np.ndarray, deeper: bool) -> np.ndarray:
    return np.stack([2 * nodes, 2 * nodes + 1], 1) if deeper else nodes[:, None]


@dataclass
class Assignment:
    entry: np.ndarray  # per row
    sums: np.ndarray  # per entry by dimension
    counts: np.ndarray  # per entry
    whole: int  # rows that were assigned with a whole node


def assign(points: np.ndarray, entries: np.ndarray, leaf: int = LEAF) -> Assignment:
    """Each row of ``points`` to its nearest row of ``entries`` (ties: the lower index)."""
    n, dims = points.shape
    chosen = np.zeros(n, np.int64)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    if not n:
        return Assignment(chosen, sums, counts, 0)
    if not dims:
        counts[0] = n
        return Assignment(chosen, sums, counts, n)
    # of equal entries only the first can be nearest
    _, firsts = np.unique(entries, axis=0, return_index=True)
    p, e = build(points, leaf), build(entries[firsts], 1)
    names = firsts[e.order]
    done = np.zeros(n, np.int64)  # in the tree's order
    at_p = at_e = 0
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    reach = np.full(1, np.iinfo(np.int64).max)  # per point node: some entry is this near to all of it
    whole = 0
    while len(a):
        gap = np.maximum(0, np.maximum(p.low[at_p][a] - e.high[at_e][b], e.low[at_e][b] - p.high[at_p][a]))
        span = np.maximum(p.high[at_p][a] - e.low[at_e][b], e.high[at_e][b] - p.low[at_p][a])
        np.minimum.at(reach, a, (span * span).sum(1))
        left = (gap * gap).sum(1) <= reach[a]
        a, b = a[left], b[left]
        leaves = at_e == e.last
        if leaves:
            alone = np.bincount(a, minlength=len(reach))[a] == 1
            start, end = p.bounds[at_p][a[alone]], p.bounds[at_p][a[alone] + 1]
            one = names[e.bounds[at_e][b[alone]]]
            np.add.at(sums, one, p.total[end] - p.total[start])
            np.add.at(counts, one, end - start)
            size = end - start
            rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            done[rows] = np.repeat(one, size)
            whole += int(size.sum())
            a, b = a[~alone], b[~alone]
            if at_p == p.last:
                _decide(p, a, names[e.bounds[at_e][b]], entries, done, sums, counts)
                break
        deeper_p, deeper_e = at_p < p.last, not leaves
        kids_a, kids_b = _below(a, deeper_p), _below(b, deeper_e)
        a = np.repeat(kids_a, kids_b.shape[1], axis=1).ravel()
        b = np.tile(kids_b, (1, kids_a.shape[1])).ravel()
        if deeper_e:  # levels of unlike sizes: an entry node may be empty at the bottom
            size = np.diff(e.bounds[at_e + 1])
            a, b = a[size[b] > 0], b[size[b] > 0]
        if deeper_p:
            reach = np.repeat(reach, 2)
        at_p, at_e = at_p + deeper_p, at_e + deeper_e
    chosen[p.order] = done
    return Assignment(chosen, sums, counts, whole)


def _decide(p: Tree, node: np.ndarray, entry: np.ndarray, entries: np.ndarray, done: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Uncertain leaves: integer distances of their points to the entries left for them."""
    if not len(node):
        return
    start, size = p.bounds[-1][node], np.diff(p.bounds[-1])[node]
    rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    entry = np.repeat(entry, size)
    off = p.points[rows] - entries[entry]
    best = np.lexsort((entry, (off * off).sum(1), rows))
    best = best[np.concatenate([[True], rows[best][1:] != rows[best][:-1]])]
    done[rows[best]] = entry[best]
    np.add.at(sums, entry[best], p.points[rows[best]])
    np.add.at(counts, entry[best], 1)
