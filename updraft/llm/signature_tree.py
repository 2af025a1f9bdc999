"""Signature trees over sets: OR-combined token bitmaps and size ranges, traversed in pairs.

A tree's leaves hold a few sets each; every node has the OR of its sets' bitmaps and
their smallest and largest size. A traversal takes a pair of nodes and drops it if the
sizes are too far apart, if the bitmaps' common bits allow no pair of sets an overlap as
large as the threshold asks, or if all their sets are in one component already; else
it goes on to the children. Pairs of leaves are settled set by set: first by bitmap, then by
exact intersection.

Only tokens that two sets share take a bit. If there are no more of them than bits, bitmap
overlaps are exact; beyond that several tokens share a bit and the bounds stay upper bounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

LEAF = 16
FANOUT = 4
MOST_BITS = 1 << 13
MOST_CELLS = 1 << 24


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap with 100 * overlap >= percent * (total - overlap)."""
    return -(-percent * total // (100 + percent))


class Union:
    """Components as one label for each set; the label is the smallest position."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)


@dataclass
class Node:
    first: int
    last: int
    bits: np.ndarray
    least: int
    most: int
    slack: int
    children: tuple[Node, ...]


class SignatureTree:
    """``sets``: sorted distinct tokens of each set, in an order that puts like sets side by side."""

    def __init__(self, sets: Sequence[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, index, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = counts > 1
        number = np.cumsum(shared) - 1
        # Many sets make do with fewer bits each, so the bitmaps stay within MOST_CELLS.
        width = int(min(max(64, shared.sum()), MOST_BITS, max(64, MOST_CELLS // max(1, len(sets)))))
        width = -(-width // 64) * 64
        self.exact = int(shared.sum()) <= width
        keep = shared[index]
        owner, bit = owner[keep], number[index[keep]] % width
        flat = np.zeros((len(sets), width), dtype=np.uint8)
        flat[owner, bit] = 1
        self.bits = np.packbits(flat, axis=1).view(np.uint64)
        self.held = np.bincount(owner, minlength=len(sets))
        # Tokens of a set beyond its bits: what a bitmap overlap may miss.
        self.slack = self.held - flat.sum(axis=1, dtype=np.int64)
        self.root = self.build(0, len(sets))

    def build(self, first: int, last: int) -> Node:
        children: tuple[Node, ...] = ()
        if last - first > LEAF:
            step = -(-(last - first) // FANOUT)
            children = tuple(self.build(i, min(i + step, last)) for i in range(first, last, step))
        return Node(
            first, last, np.bitwise_or.reduce(self.bits[first:last], axis=0), int(self.sizes[first:last].min()),
            int(self.sizes[first:last].max()), int(self.slack[first:last].max()), children,
        )

    def join(self, percent: int, labels: np.ndarray) -> np.ndarray:
        """Labels after all links of at least ``percent`` hundredths of Jaccard similarity."""
        union = Union(labels)
        todo = [(self.root, self.root)]
        while todo:
            x, y = todo.pop()
            if not self.possible(x, y, percent, union):
                continue
            if not x.children and not y.children:
                self.leaves(x, y, percent, union)
            elif x is y:
                pairs = [(a, b) for i, a in enumerate(x.children) for b in x.children[i:]]
                # Nodes with themselves come first, so that later pairs find components joined.
                todo.extend(sorted(pairs, key=lambda p: p[0] is p[1]))
            elif x.children and (not y.children or x.last - x.first >= y.last - y.first):
                todo.extend((a, y) for a in x.children)
            else:
                todo.extend((x, b) for b in y.children)
        return union.label

    def possible(self, x: Node, y: Node, percent: int, union: Union) -> bool:
        if 100 * min(x.most, y.most) < percent * max(x.least, y.least):
            return False
        overlap = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.slack, y.slack)
        if overlap < least_overlap(x.least + y.least, percent):
            return False
        label = union.label[x.first]
        return bool((union.label[x.first : x.last] != label).any() or (union.label[y.first : y.last] != label).any())

    def leaves(self, x: Node, y: Node, percent: int, union: Union) -> None:
        common = np.bitwise_count(self.bits[x.first : x.last, None] & self.bits[None, y.first : y.last]).sum(axis=2, dtype=np.int64)
        if not self.exact:
            common += np.minimum(self.slack[x.first : x.last, None], self.slack[None, y.first : y.last])
        total = self.sizes[x.first : x.last, None] + self.sizes[None, y.first : y.last]
        near = common >= least_overlap(total, percent)
        for i, j in zip(*np.nonzero(near)):
            a, b = x.first + i, y.first + j
            if a != b and union.label[a] != union.label[b] and self.linked(a, b, percent):
                union.join(a, b)

    def linked(self, a: int, b: int, percent: int) -> bool:
        overlap = len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True))
        return bool(overlap >= least_overlap(self.sizes[a] + self.sizes[b], percent))


def like_order(sets: Sequence[np.ndarray]) -> np.ndarray:
    """Positions in an order by size class and smallest tokens: like sets come close together."""
    least = [tuple(s[:3].tolist()) for s in sets]
    return np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]).bit_length(), least[i], len(sets[i]))), dtype=np.int64)
