"""Suffix trees of whole-number sequences by Ukkonen's algorithm, and constant-time longest common extensions."""

from __future__ import annotations

import numpy as np


def _grown(symbols: list[int], size: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Where the edge into each node begins and ends, and the child of (node * size + symbol); node 0 is the root.

    A leaf's edge ends at len(symbols). The tree grows by one symbol at a time; ``node``, ``edge``
    and ``length`` say where the longest suffix that is not yet a leaf ends.
    """
    n = len(symbols)
    first, last, link, go = [0], [0], [0], {}
    node = edge = length = waiting = 0
    for i, symbol in enumerate(symbols):
        waiting += 1
        unlinked = 0
        while waiting:
            if not length:
                edge = i
            here = node * size + symbols[edge]
            below = go.get(here)
            if below is None:
                go[here] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                start = first[below]
                span = last[below] - start
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if symbols[start + length] == symbol:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                middle = len(first)
                first += (start, i)
                last += (start + length, n)
                link += (0, 0)
                go[here] = middle
                go[middle * size + symbol] = middle + 1
                go[middle * size + symbols[start + length]] = below
                first[below] = start + length
                if unlinked:
                    link[unlinked] = middle
                unlinked = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return first, last, go


class Extensions:
    """Longest common extensions of the suffixes of a sequence whose last symbol occurs only there.

    An Euler tour of the tree visits the leaves in the order of their suffixes; between two
    neighbours it turns round at their lowest common ancestor. The lowest common ancestor of any two leaves is
    the shallowest turn between them, which a table of minima over powers of two gives in constant time.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        first, last, go = _grown(symbols.tolist(), size)
        keys = np.fromiter(go.keys(), np.int64, len(go))
        order = np.argsort(keys)
        child = np.fromiter(go.values(), np.int64, len(go))[order].tolist()
        # Children of node k, by their first symbol: child[bounds[k] : bounds[k + 1]].
        bounds = np.searchsorted(keys[order] // size, np.arange(len(first) + 1)).tolist()
        leaves, turns, turn = [], [], n
        stack = [(c, 0) for c in reversed(child[bounds[0] : bounds[1]])]
        while stack:
            node, depth = stack.pop()
            if depth < turn:
                turn = depth
            end = last[node]
            below = depth + end - first[node]
            if end == n:
                leaves.append(n - below)
                turns.append(turn)
                turn = n
            else:
                stack += [(c, below) for c in reversed(child[bounds[node] : bounds[node + 1]])]
        self.n = n
        self.rank = np.empty(n + 1, np.int64)
        self.rank[leaves] = np.arange(n)
        self.rank[n] = -1
        least = np.array(turns, np.int32)
        self.least = [least]
        width = 1
        while 2 * width <= n:
            least = np.minimum(least[:-width], least[width:])
            self.least.append(least)
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes from ``i`` and from ``j`` share at their start; i != j, the end of the sequence is a suffix too."""
        out = np.zeros(len(i), np.int64)
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        inside = low > 0
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        for p in np.unique(power[inside]).tolist():
            mine = np.flatnonzero(inside & (power == p))
            table = self.least[p]
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << p)])
        return out
