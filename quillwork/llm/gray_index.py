"""An index of 64-bit fingerprints in Gray order whose upper nodes hold the bit patterns that all below them share."""

from __future__ import annotations

import numpy as np

LEAF = 32
FAN_OUT = 8


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence; neighbours in that order differ in few bits."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class Forest:
    """Disjoint sets of 0..n-1 with the smallest member as root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = int(parent[k])
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while ((up := self.parent[self.parent]) != self.parent).any():
            self.parent = up
        return self.parent


class GrayIndex:
    """Levels of nodes over codes in Gray order. A node has a mask of the bits that agree below it, and their values."""

    def __init__(self, codes: np.ndarray) -> None:
        """codes: distinct uint64 in Gray order."""
        self.codes = codes
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # mask, value, codes in a node
        width, every, some = LEAF, codes, codes
        step = LEAF
        while True:
            cuts = np.arange(0, len(every), step)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            self.levels.append((~(every ^ some), every, width))
            if len(cuts) == 1:
                break
            step, width = FAN_OUT, width * FAN_OUT

    def pairs_of_leaves(self, most: int, other: GrayIndex | None = None):
        """Pairs of leaves (a <= b within one index) that the bits shared so far don't hold more than ``most`` apart.

        Both sides go down a level at a time: a pair of nodes whose shared bits differ too often goes with all below.
        """
        other_levels = (other or self).levels
        depth = max(len(self.levels), len(other_levels))
        mine = self.levels + [self.levels[-1]] * (depth - len(self.levels))
        theirs = other_levels + [other_levels[-1]] * (depth - len(other_levels))
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(depth - 1, -1, -1):
            (mask_a, value_a, _), (mask_b, value_b, _) = mine[level], theirs[level]
            apart = np.bitwise_count((value_a[a] ^ value_b[b]) & mask_a[a] & mask_b[b])
            a, b = a[apart <= most], b[apart <= most]
            if not level:
                return a, b
            grown = [self._below(nodes, len(levels[level][0]), len(levels[level - 1][0])) for nodes, levels in ((a, mine), (b, theirs))]
            (first_a, n_a), (first_b, n_b) = grown
            count = n_a * n_b
            pair = np.repeat(np.arange(len(a)), count)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            a, b = first_a[pair] + k // n_b[pair], first_b[pair] + k % n_b[pair]
            if other is None:
                a, b = a[a <= b], b[a <= b]

    @staticmethod
    def _below(nodes: np.ndarray, here: int, lower: int) -> tuple[np.ndarray, np.ndarray]:
        if here == lower:  # the shorter of two indexes waits at its root
            return nodes, np.ones(len(nodes), np.int64)
        first = nodes * FAN_OUT
        return first, np.minimum(FAN_OUT, lower - first)


def link_within(codes: np.ndarray, most: int, forest: Forest, at: int = 0) -> None:
    """Joins in ``forest`` (whose members from ``at`` on are ``codes``, in Gray order) all codes up to ``most`` bits apart."""
    _link(GrayIndex(codes), None, codes, codes, most, forest, at, at)


def link_between(left: np.ndarray, right: np.ndarray, most: int, forest: Forest, at_left: int, at_right: int) -> None:
    _link(GrayIndex(left), GrayIndex(right), left, right, most, forest, at_left, at_right)


def _link(index: GrayIndex, other: GrayIndex | None, left: np.ndarray, right: np.ndarray, most: int, forest: Forest, at_left: int, at_right: int) -> None:
    tight = [np.bitwise_count(~mask) <= most for mask, _, _ in (index.levels[0], (other or index).levels[0])]
    for a, b in zip(*index.pairs_of_leaves(most, other), strict=True):
        x, y = left[a * LEAF : (a + 1) * LEAF], right[b * LEAF : (b + 1) * LEAF]
        i0, j0 = at_left + int(a) * LEAF, at_right + int(b) * LEAF
        if other is None and a == b and tight[0][a]:  # all within reach of each other
            for k in range(1, len(x)):
                forest.join(i0, i0 + k)
            continue
        near = np.bitwise_count(x[:, None] ^ y[None, :]) <= most
        if other is None and a == b:
            near &= np.tri(len(x), k=-1, dtype=bool)
        for i, j in zip(*np.nonzero(near), strict=True):
            forest.join(i0 + int(i), j0 + int(j))
