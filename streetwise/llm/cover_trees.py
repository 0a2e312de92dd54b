"""Cover trees over integer vectors, as arrays, and the walk over two of them.

A node has a centre, which is one of its points, and the points within its cover
radius; its children's radii are smaller by BASE, their centres farther from one
another than that. Points are put in order of the tree, so a node is a run of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Radius of a node to that of its children, and points that a leaf may hold.
BASE, LEAF = 1.3, 16
#: Components are below this in size: squared distances in up to 128 dimensions fit 64 bits.
LARGEST = 1 << 27
#: Slack of a comparison of two distances: they are square roots of exact integers.
SLACK = 1e-9


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of y (long)."""
    top = int(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:  # every sum is exact in doubles
        a, b = x.astype(np.float64), y.astype(np.float64)
        out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        return out.astype(np.int64)
    a, b = x.astype(np.int64), y.astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


@dataclass
class Tree:
    order: np.ndarray  # rows of the points, in order of the tree
    centre: np.ndarray  # of each node: its centre's place in that order
    radius: np.ndarray  # the largest distance of a point of it to the centre
    start: np.ndarray  # its points: start to stop, in that order
    stop: np.ndarray
    child: np.ndarray  # its children: child to child + children; none for a leaf
    children: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over rows of integers (at least one). Its levels are wide where points
    are about equally far from one another, as in many dimensions."""
    n = len(points)
    far = np.sqrt(squared(points, points).astype(np.float64))
    order = np.arange(n)
    nodes: list[list] = [[0, float(far[0].max()), 0, n, 0, 0]]  # centre (a row), radius, start, stop, child, children
    at = 0
    while at < len(nodes):
        centre, radius, start, stop, _, _ = nodes[at]
        if stop - start > leaf and radius > 0:
            mine, cover, next_centre, place = order[start:stop], radius / BASE, centre, start
            nodes[at][4], runs = len(nodes), []
            while len(mine):
                d = far[next_centre, mine]
                near = d <= cover
                runs.append(mine[near])
                nodes.append([int(next_centre), float(d[near].max()), place, place + len(runs[-1]), 0, 0])
                place += len(runs[-1])
                mine = mine[~near]
                next_centre = mine[0] if len(mine) else -1
            order[start:stop] = np.concatenate(runs)
            nodes[at][5] = len(nodes) - nodes[at][4]
        at += 1
    centre, radius, start, stop, child, children = (np.array(c) for c in zip(*nodes, strict=True))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return Tree(order, place[centre], radius.astype(np.float64), start, stop, child, children)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each entry, as many as its count."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count - first, count)


def nearest(tree: Tree, points: np.ndarray, others: Tree, targets: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """The nearest target of each point (ties: the smallest number); ``points`` and
    ``targets`` are the rows of the trees, points in order of the tree, targets by number.

    Both trees are walked down together, level by level. A pair of nodes goes when no
    point of the one can be as near to a target of the other as it surely is to some
    target. Returns (node, target) where a whole node has one target left, and for the
    rows of all other points: their places, targets, and squared distances."""
    best = others.order[others.centre]  # the target that is a node's centre
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    limit = np.full(len(tree.centre), np.inf)
    whole: list[tuple[int, int]] = []
    rows, targets_of, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(q):
        # Pairs are sorted by q. One distance for each node and target that a pair names.
        heads = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        names, column = np.unique(best[r], return_inverse=True)
        row = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(q))))
        d = np.sqrt(squared(points[tree.centre[q[heads]]], targets[names]).astype(np.float64))[row, column]
        own = tree.radius[q]
        np.minimum.at(limit, q, d + own)
        live = d - own - others.radius[r] <= limit[q] * (1 + SLACK) + SLACK
        q, r = q[live], r[live]
        heads = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        count = np.diff(np.append(heads, len(q)))
        width = others.stop[r] - others.start[r]
        left = np.add.reduceat(width, heads)
        last = np.add.reduceat((others.children[r] == 0).astype(np.int64), heads) == count
        # A node with one target left is decided; a leaf whose pairs are all leaves is compared.
        for h in np.flatnonzero(left == 1):
            whole.append((int(q[heads[h]]), int(others.order[others.start[r[heads[h]]]])))
        for h in np.flatnonzero((left > 1) & (tree.children[q[heads]] == 0) & last):
            node, mine = q[heads[h]], r[heads[h] : heads[h] + count[h]]
            some = np.sort(others.order[_spread(others.start[mine], others.stop[mine] - others.start[mine])])
            place = np.arange(tree.start[node], tree.stop[node])
            far = squared(points[place], targets[some])
            found = far.argmin(axis=1)
            rows.append(place)
            targets_of.append(some[found])
            distances.append(far[np.arange(len(place)), found])
        done = np.repeat((left == 1) | ((tree.children[q[heads]] == 0) & last), count)
        q, r = q[~done], r[~done]
        # The others go on with the children of both; a leaf stays as it is.
        n_r = np.maximum(others.children[r], 1)
        q, r = np.repeat(q, n_r), _spread(np.where(others.children[r] > 0, others.child[r], r), n_r)
        n_q = np.where(tree.children[q] > 0, tree.children[q], 1)
        parent, first = q, np.where(tree.children[q] > 0, tree.child[q], q)
        q = _spread(first, n_q)
        limit[q] = np.minimum(limit[q], np.repeat(limit[parent], n_q))
        r = np.repeat(r, n_q)
        by = np.lexsort((r, q))
        q, r = q[by], r[by]
    return whole, np.concatenate(rows), np.concatenate(targets_of), np.concatenate(distances)
