"""A signature tree over token sets and its dual traversal (runs inside one task, over one bounded bin of documents)."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np

LEAF, FANOUT = 48, 6
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Node:
    """``members`` are positions; a node knows the OR of their bitmaps, their size range and the most tokens that share a bit with an earlier one."""

    __slots__ = ("children", "excess", "high", "low", "members", "union")

    def __init__(self, members, children, union, low, high, excess):
        self.members, self.children, self.union, self.low, self.high, self.excess = members, children, union, low, high, excess


class SignatureTree:
    def __init__(self, sets: list[np.ndarray], largest: int):
        """``largest``: the size of the largest set that this tree meets; it sets the length of the bitmaps."""
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.bits = 1 << min(16, max(9, (largest * 8 - 1).bit_length()))
        self.maps = np.zeros((len(sets), self.bits // 8), np.uint8)
        for row, s in zip(self.maps, sets):
            bit = (s >> np.uint64(40)).astype(np.int64) & (self.bits - 1)
            np.bitwise_or.at(row, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        self.excess = self.sizes - _ONES[self.maps].sum(1)
        order = np.lexsort(([int(s[0] >> np.uint64(1)) for s in sets], self.sizes))
        nodes = [self._leaf(order[i : i + LEAF]) for i in range(0, len(order), LEAF)]
        while len(nodes) > 1:
            nodes = [self._inner(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        self.root = nodes[0]

    def _leaf(self, m: np.ndarray) -> Node:
        return Node(m, (), np.bitwise_or.reduce(self.maps[m]), self.sizes[m].min(), self.sizes[m].max(), self.excess[m].max())

    @staticmethod
    def _inner(c: list[Node]) -> Node:
        return Node(np.concatenate([x.members for x in c]), tuple(c), np.bitwise_or.reduce([x.union for x in c]), min(x.low for x in c), max(x.high for x in c), max(x.excess for x in c))


def _possible(a: Node, b: Node, num: int, den: int) -> bool:
    """Whether some pair can reach num/den: by the size ranges, then by the largest overlap the OR-combined bitmaps allow."""
    if den * min(a.high, b.high) < num * max(a.low, b.low):
        return False
    most = min(int(_ONES[a.union & b.union].sum()) + min(a.excess, b.excess), a.high, b.high)
    return most * (num + den) >= num * (a.low + b.low)


class Linked:
    """Union-find with the smallest label as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def one(self, members: np.ndarray) -> bool:
        first = self.find(members[0])
        return all(self.find(x) == first for x in members[1:])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def traverse(left: SignatureTree, right: SignatureTree, same: bool, num: int, den: int, linked: Linked, shift: int) -> Iterator[tuple[int, int]]:
    """Pairs (position on the left, on the right) with Jaccard >= num/den that join two components; pairs inside one component need no check.

    ``shift`` is added to a right position for its place in ``linked``.
    """
    stack = [(left.root, right.root)]
    while stack:
        a, b = stack.pop()
        if not _possible(a, b, num, den):
            continue
        own = same and a is b
        if linked.find(a.members[0]) == linked.find(b.members[0] + shift) and linked.one(a.members) and (own or linked.one(b.members + shift)):
            continue
        if own and a.children:
            c = a.children
            stack += [(c[i], c[j]) for i in range(len(c)) for j in range(i, len(c))]
        elif a.children and (not b.children or len(a.members) >= len(b.members)):
            stack += [(c, b) for c in a.children]
        elif b.children:
            stack += [(a, c) for c in b.children]
        else:
            yield from _leaves(left, right, a.members, b.members, own, num, den, linked, shift)


def _leaves(left, right, m, n, own, num, den, linked, shift):
    x = np.unpackbits(left.maps[m], axis=1).astype(np.float32)
    y = x if own else np.unpackbits(right.maps[n], axis=1).astype(np.float32)
    most = (x @ y.T).astype(np.int64) + np.minimum(left.excess[m][:, None], right.excess[n][None, :])
    a, b = left.sizes[m][:, None], right.sizes[n][None, :]
    ok = (most * (num + den) >= num * (a + b)) & (den * np.minimum(a, b) >= num * np.maximum(a, b))
    if own:
        ok = np.triu(ok, 1)
    for i, j in zip(*np.nonzero(ok)):
        i, j = int(m[i]), int(n[j])
        if linked.find(i) == linked.find(j + shift):
            continue
        s, t = left.sets[i], right.sets[j]
        both = overlap(s, t)
        if both * den >= num * (len(s) + len(t) - both):
            linked.join(i, j + shift)
            yield i, j


def size_bands(top: int, ratio: float = 1.5) -> np.ndarray:
    """Upper ends of the size bands."""
    ends = [1]
    while ends[-1] < top:
        ends.append(max(ends[-1] + 1, ceil(ends[-1] * ratio)))
    return np.array(ends, np.int64)
