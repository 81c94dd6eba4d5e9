"""BK-trees over bit fingerprints, many trees at a time, in numpy.

A node's children are keyed by their Hamming distance to it. All trees of a chunk are built level
by level: the first fingerprint of each group becomes a node and the rest fall into groups by
distance. Queries walk down the same way and follow only edges within the radius of their own
distance to the node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Walks that a task follows at once.
FRONT = 1 << 16


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows of two (n, words) arrays of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Forest:
    """One BK-tree for each value of ``group`` (sorted) over the rows of ``bits``."""

    def __init__(self, bits: np.ndarray, group: np.ndarray) -> None:
        self.bits, self.span = bits, 64 * bits.shape[1] + 1
        first = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
        members = np.arange(len(group))
        self.root = members[first][np.cumsum(first) - 1]
        edges, children = [], []
        while len(members):
            node = members[first][np.cumsum(first) - 1][~first]
            members = members[~first]
            edge = node * self.span + distance(bits[members], bits[node])
            order = np.argsort(edge, kind="stable")
            members, edge = members[order], edge[order]
            first = np.concatenate(([True], edge[1:] != edge[:-1])) if len(edge) else np.zeros(0, bool)
            edges.append(edge[first])
            children.append(members[first])
        edge, child = np.concatenate(edges or [np.zeros(0, np.int64)]), np.concatenate(children or [np.zeros(0, np.int64)])
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def pairs(self, radius: int, above: int = -1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of ``(i, j, distance)``, i > j, of all rows of one group more than ``above`` and at most ``radius`` apart."""
        front = [(np.arange(len(self.root)), self.root)]
        while front:
            query, node = front.pop()
            if len(query) > FRONT:
                half = len(query) // 2
                front += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = distance(self.bits[query], self.bits[node])
            hit = (d <= radius) & (d > above) & (query > node)
            if hit.any():
                yield query[hit], node[hit], d[hit]
            low = np.searchsorted(self.edge, node * self.span + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge, node * self.span + np.minimum(d + radius, self.span - 1), "right")
            n = high - low
            if n.any():
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                front.append((np.repeat(query, n), self.child[at]))


class Links:
    """Gathers pairs, keeping what connects: a spanning forest, and each row's ``nearest`` partners."""

    def __init__(self, n: int, nearest: int = 0) -> None:
        self.parent, self.kept = np.arange(n), set()
        self.best = np.full((n, nearest), np.iinfo(np.int64).max)

    def _find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _approach(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        """Takes partners that are nearer than those known so far; ties go to the smaller row."""
        n, k = self.best.shape
        own, value = np.concatenate((i, j)), np.concatenate((d * n + j, d * n + i))
        rows = np.unique(own)
        own, value = np.concatenate((own, np.repeat(rows, k))), np.concatenate((value, self.best[rows].ravel()))
        order = np.lexsort((value, own))
        own, value = own[order], value[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        self.best[rows] = value[place < k].reshape(-1, k)

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        if self.best.shape[1]:
            self._approach(i, j, d)
        while (up := self.parent[self.parent] != self.parent).any():
            self.parent[up] = self.parent[self.parent[up]]
        apart = self.parent[i] != self.parent[j]
        order = np.argsort(d[apart], kind="stable")
        for a, b in zip(i[apart][order].tolist(), j[apart][order].tolist()):
            x, y = self._find(a), self._find(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.kept.add((a, b))

    def edges(self) -> np.ndarray:
        """(m, 2) rows."""
        row, place = np.nonzero(self.best < np.iinfo(np.int64).max)
        near = self.best[row, place] % max(len(self.best), 1)
        kept = self.kept | set(zip(np.maximum(row, near).tolist(), np.minimum(row, near).tolist()))
        return np.array(sorted(kept), np.int64).reshape(-1, 2)
