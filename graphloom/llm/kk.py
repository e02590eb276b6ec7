"""Karmarkar-Karp multiway differencing.

A partial partition is a row of m sums with the node that hangs in each slot.  The two partial partitions with the
largest spread are combined slot by slot in opposite order, largest sum to smallest, until one is left.
"""

from __future__ import annotations

import heapq

import numpy as np


class Forest:
    """Trees of items, built while slots are merged.  Nodes below `leaves` are items, the others have two children."""

    def __init__(self, leaves: int):
        self.leaves, self.left, self.right = leaves, [], []

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot by slot the node of both (-1: none)."""
        out = np.where(a < 0, b, a)
        for i in np.flatnonzero((a >= 0) & (b >= 0)):
            out[i] = self.leaves + len(self.left)
            self.left.append(int(a[i]))
            self.right.append(int(b[i]))
        return out

    def items(self, node: int) -> list[int]:
        found, todo = [], [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < self.leaves:
                found.append(x)
            else:
                todo += (self.left[x - self.leaves], self.right[x - self.leaves])
        return found


def difference(sums: list[np.ndarray], nodes: list[np.ndarray], forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (sums falling, one array of slots each) into one; ties go to the one that came first."""
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]  # minus the spread
    heapq.heapify(heap)
    sums, nodes = list(sums), list(nodes)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        s = sums[a] + sums[b][::-1]
        n = forest.join(nodes[a], nodes[b][::-1])
        order = np.argsort(-s, kind="stable")
        sums[a], nodes[a], sums[b], nodes[b] = s[order], n[order], None, None
        heapq.heappush(heap, (int(sums[a][-1] - sums[a][0]), a))
    return sums[heap[0][1]], nodes[heap[0][1]]


def split(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal items into m slots of near-equal sums: (slot of each item, sum of each slot), the largest slot first.

    Whole rounds of equal m-tuples would start from single items; m items at a time, sorted, are a partial partition of
    their own (the same that differencing makes of equal sizes), which keeps the merges at n/m.
    """
    order = np.argsort(-sizes, kind="stable")
    forest = Forest(len(sizes))
    sums, nodes = [], []
    for at in range(0, len(order), m):
        own = order[at : at + m]
        s, n = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        s[: len(own)], n[: len(own)] = sizes[own], own
        sums.append(s)
        nodes.append(n)
    if not sums:
        return np.zeros(0, np.int64), np.zeros(m, np.int64)
    total, roots = difference(sums, nodes, forest)
    slot = np.empty(len(sizes), np.int64)
    for j, root in enumerate(roots):
        slot[forest.items(int(root))] = j
    return slot, total
