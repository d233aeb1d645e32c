"""Signature trees over sets of 64-bit hashes, for Jaccard joins inside a task.

A set of n hashes has a bitmap of the next power of two of 2 n bits, a bit for each hash. A
leaf of a tree is a set; a node holds up to ``FAN`` neighbours of the level below with the OR of
their bitmaps, the range of their sizes and the most hashes by which one of them exceeds its
bits. Two nodes cannot hold sets that share enough when their ranges of sizes do not fit, or when
the bits they have in common, and that excess, come to less than the overlap that the smallest
sizes need. Two trees are walked at once from the pair of their roots; pairs of children are
dropped by these bounds. Many trees, one for each group of sets, are built and walked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 4
LEAST_BITS = 64
# Bytes of bitmaps handled at once while walking.
WALK_BYTES = 4 << 20


def width(size: int) -> int:
    """Bits of the bitmap of a set of ``size`` hashes."""
    return max(LEAST_BITS, 1 << (2 * size - 1).bit_length()) if size else LEAST_BITS


def bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(width(len(hashes)), np.uint8)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Level:
    """Nodes of one level: group, range of sizes, excess, bitmap and the range of children."""

    def __init__(self, group, low, high, excess, bits, first, end) -> None:
        self.group, self.low, self.high, self.excess = group, low, high, excess
        self.bits, self.first, self.end = bits, first, end

    def __len__(self) -> int:
        return len(self.group)

    def above(self) -> "Level":
        n = len(self)
        change = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))
        place = np.arange(n) - np.repeat(change, np.diff(np.append(change, n)))
        first = np.flatnonzero(place % FAN == 0)
        return Level(
            self.group[first], np.minimum.reduceat(self.low, first), np.maximum.reduceat(self.high, first),
            np.maximum.reduceat(self.excess, first), np.bitwise_or.reduceat(self.bits, first, axis=0),
            first, np.append(first[1:], n))


def tree(group: np.ndarray, size: np.ndarray, excess: np.ndarray, bits: np.ndarray) -> list[Level]:
    """The levels of the trees of sets sorted by group, leaves first, up to one root a group."""
    at = np.arange(len(group))
    levels = [Level(group, size, size, excess, bits, at, at + 1)]
    while len(levels[-1]) > len(np.unique(levels[-1].group)):
        levels.append(levels[-1].above())
    return levels


def raised(levels: list[Level], height: int) -> list[Level]:
    """The same trees with their roots repeated up to ``height`` levels."""
    while len(levels) < height:
        levels = [*levels, levels[-1].above()]
    return levels


def may_link(a: Level, i: np.ndarray, b: Level, j: np.ndarray, over: int, under: int) -> np.ndarray:
    """Whether nodes ``i`` and ``j`` may hold sets that share ``over / under`` of their union."""
    both, rest = over + under, under
    fits = (rest * a.high[i] >= over * b.low[j]) & (rest * b.high[j] >= over * a.low[i])
    i, j = i[fits], j[fits]
    most = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(a.excess[i], b.excess[j])
    fits[fits] = both * np.minimum(most, np.minimum(a.high[i], b.high[j])) >= over * (a.low[i] + b.low[j])
    return fits


def walk(a: list[Level], b: list[Level], over: int, under: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves of the trees of the same group that may be linked, in parts.

    With ``a`` and ``b`` the same list, each pair of different leaves comes once.
    """
    own = a is b
    height = max(len(a), len(b))
    a = raised(a, height)
    b = a if own else raised(b, height)
    top = height - 1
    groups, i, j = np.intersect1d(a[top].group, b[top].group, return_indices=True)
    step = max(1, WALK_BYTES // max(1, a[0].bits.shape[1] * 8))
    waiting = [(top, i, j)]
    while waiting:
        level, i, j = waiting.pop()
        if len(i) > step:
            waiting += [(level, i[at : at + step], j[at : at + step]) for at in range(0, len(i), step)][::-1]
            continue
        fits = may_link(a[level], i, b[level], j, over, under)
        i, j = i[fits], j[fits]
        if level == 0:
            if own:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        left, right = a[level].end[i] - a[level].first[i], b[level].end[j] - b[level].first[j]
        times = left * right
        which = np.repeat(np.arange(len(i)), times)
        place = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        ci = a[level].first[i][which] + place // right[which]
        cj = b[level].first[j][which] + place % right[which]
        if own:
            ci, cj = ci[ci <= cj], cj[ci <= cj]
        if len(ci):
            waiting.append((level - 1, ci, cj))


def candidate_pairs(
    group: np.ndarray, size: np.ndarray, order: np.ndarray, bits: list[bytes], over: int, under: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of one group that the bounds leave, in parts.

    Trees are built for each group and width of bitmaps, neighbours being alike in ``order``;
    sets that may be linked differ in width by a factor of two at most, where the wider bitmap is
    folded.
    """
    wide = np.fromiter(map(len, bits), np.int64, len(bits))
    trees: dict[int, tuple] = {}
    for w in np.unique(wide):
        at = np.flatnonzero(wide == w)
        at = at[np.lexsort((size[at], order[at], group[at]))]
        matrix = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), w // 8)
        excess = size[at] - np.bitwise_count(matrix).sum(axis=1, dtype=np.int64)
        trees[w] = at, tree(group[at], size[at], excess, matrix)
    for w, (at, levels) in trees.items():
        for i, j in walk(levels, levels, over, under):
            yield at[i], at[j]
        if 2 * w in trees:
            other = trees[2 * w][0]
            leaves = trees[2 * w][1][0]
            half = leaves.bits.shape[1] // 2
            matrix = leaves.bits[:, :half] | leaves.bits[:, half:]
            excess = size[other] - np.bitwise_count(matrix).sum(axis=1, dtype=np.int64)
            for i, j in walk(levels, tree(group[other], size[other], excess, matrix), over, under):
                yield at[i], other[j]


class Labels:
    """Disjoint sets of positions; ``label`` holds the root of each as of the last call of ``settle``."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.label = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart before."""
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def settle(self) -> None:
        label = np.array(self.parent)
        while True:
            above = label[label]
            if np.array_equal(above, label):
                break
            label = above
        self.label = label
