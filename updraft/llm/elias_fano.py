"""Elias-Fano sequences and an n-gram trie of them, queried in bulk.

A monotone sequence of n numbers below u keeps the low bits of each number packed and its
high part as a run-length bit vector, about 2 + log2(u / n) bits a number. A level of
the trie holds the words of all contexts one after another; each context's words
are raised by a base that grows from context to context, so the level is one monotone sequence. The
pointers where contexts begin are monotone as well. A query raises its word by the
context's base and looks for the successor, which can only lie in that context's range.
Probabilities are quantised to steps of QUANTUM in log10, 16 bits each.

All levels lie in one block of bytes that can be memory-mapped and is only viewed when read.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

U64 = np.uint64
QUANTUM = 1 / 2048
PACKED = 1 << 16
BYTE_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)
# SELECT[b, k]: place of the k-th one (from 0) of byte b.
SELECT = np.zeros((256, 8), dtype=np.int64)
for _k in range(8):
    SELECT[:, _k] = [([i for i in range(8) if b >> i & 1] + [0] * 8)[_k] for b in range(256)]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after another, in 64-bit words."""
    words = np.zeros(len(values) * width // 64 + 2, U64)
    mask = U64((1 << width) - 1)
    for begin in range(0, len(values), PACKED):
        part = values[begin : begin + PACKED] & mask
        bit = np.arange(begin, begin + len(part), dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(U64)
        # Bits of different values never meet, so adding a word's pieces up is an OR of them.
        for place, piece in ((word, part << shift), (word + 1, np.where(shift > 0, part >> ((U64(64) - shift) & U64(63)), U64(0)))):
            first = np.flatnonzero(np.diff(place, prepend=-1))
            words[place[first]] |= np.bitwise_or.reduceat(piece, first)
    return words


def unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(len(at), U64)
    bit = at.astype(U64) * U64(width)
    word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
    return (low | high) & U64((1 << width) - 1)


class EliasFano:
    """A strictly or weakly rising sequence; ``to_bytes`` and ``view`` keep it as is."""

    def __init__(self, n: int, universe: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.width, self.low, self.high = n, universe, width, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(high) + 1) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(U64)
        n = len(values)
        width = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = pack(values, width) if width else np.zeros(1, U64)
        tops = (values >> U64(width)).astype(np.int64)
        bits = np.zeros(-(-(n + (universe >> width) + 2) // 64) * 64, np.uint8)
        bits[tops + np.arange(n)] = 1
        return cls(n, universe, width, low, np.packbits(bits, bitorder="little").view(U64))

    def select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Place in the high bits of the one, or zero, of each rank."""
        before = self.ones if ones else self.zeros
        word = np.searchsorted(before, rank, side="right") - 1
        left = rank - before[word]
        bits = self.high[word] if ones else ~self.high[word]
        place = word * 64
        done = np.zeros(len(rank), dtype=bool)
        for i in range(8):
            byte = ((bits >> U64(8 * i)) & U64(255)).astype(np.int64)
            here = BYTE_ONES[byte]
            hit = ~done & (left < here)
            place[hit] += 8 * i + SELECT[byte[hit], left[hit]]
            done |= hit
            left = np.where(done, left, left - here)
        return place

    def access(self, at: np.ndarray) -> np.ndarray:
        top = self.select(at, ones=True) - at
        return (top.astype(U64) << U64(self.width)) | unpack(self.low, at, self.width)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first number not below each x (n if there is none), and whether it is x."""
        x = x.astype(U64)
        top = (x >> U64(self.width)).astype(np.int64)
        # Numbers with the same high part lie between two zeros of the bit vector.
        begin = np.where(top > 0, self.select(np.maximum(top - 1, 0), ones=False) - top + 1, 0)
        end = self.select(top, ones=False) - top
        low = x & U64((1 << self.width) - 1)
        at, stop = begin.copy(), end.copy()
        while True:
            open_ = at < stop
            if not open_.any():
                break
            middle = (at + stop) // 2
            less = np.zeros(len(x), dtype=bool)
            less[open_] = unpack(self.low, middle[open_], self.width) < low[open_]
            at = np.where(open_ & less, middle + 1, at)
            stop = np.where(open_ & ~less, middle, stop)
        # Past the run of its high part the successor is larger than x.
        equal = at < end
        equal[equal] = unpack(self.low, at[equal], self.width) == low[equal]
        return at, equal

    def to_bytes(self) -> bytes:
        head = struct.pack("<5q", self.n, self.universe, self.width, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def view(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        n, universe, width, low, high = struct.unpack("<5q", data[:40])
        words = np.frombuffer(data[40 : 40 + 8 * (low + high)], U64)
        return cls(n, universe, width, words[:low], words[low:]), data[40 + 8 * (low + high) :]


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-log10 / QUANTUM), 65535).astype("<u2")


class Trie:
    """N-grams of one order and more, each level under its contexts.

    ``levels``: for each order, the word sequence, the pointers into the next level's words, the
    base of each range, and the quantised log10 probabilities.
    """

    def __init__(self, vocabulary: int, levels: list[tuple[EliasFano, EliasFano | None, np.ndarray]]):
        self.vocabulary, self.levels = vocabulary, levels

    @classmethod
    def of(cls, grams: list[np.ndarray], log10: list[np.ndarray], vocabulary: int) -> Trie:
        """``grams[k]``: distinct sorted rows of k + 1 word numbers, each row's prefix being in ``grams[k - 1]``."""
        levels = []
        parent = np.zeros(len(grams[0]), dtype=np.int64)
        for k, rows in enumerate(grams):
            # Range r is raised by r * vocabulary: bases rise, and words of two ranges never mix.
            values = parent.astype(U64) * U64(vocabulary) + rows[:, k].astype(U64)
            ranges = 1 if k == 0 else len(grams[k - 1])
            sequence = EliasFano.of(values, max(1, ranges * vocabulary))
            pointers = None
            if k + 1 < len(grams):
                below = grams[k + 1][:, : k + 1]
                fresh = np.flatnonzero(np.concatenate([[True], (below[1:] != below[:-1]).any(axis=1)])) if len(below) else np.empty(0, np.int64)
                keyed = {tuple(r): i for i, r in enumerate(rows.tolist())} if k else None
                place = np.searchsorted(rows[:, 0], below[fresh, 0]) if keyed is None else np.array([keyed[tuple(r)] for r in below[fresh].tolist()], dtype=np.int64)
                own = np.zeros(len(rows), dtype=np.int64)
                own[place] = np.diff(np.append(fresh, len(below)))
                pointers = EliasFano.of(np.concatenate([[0], np.cumsum(own)]), len(below) + 1)
                parent = np.repeat(np.arange(len(rows)), own)
            levels.append((sequence, pointers, quantised(log10[k])))
        return cls(vocabulary, levels)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Position of each row in the level of its length, or -1."""
        at = np.zeros(len(grams), dtype=np.int64)
        for k in range(grams.shape[1]):
            at = self.child(k, at, grams[:, k])
        return at

    def child(self, k: int, parent: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Position in level k of each word below its parent's position in level k - 1, or -1."""
        out = np.full(len(words), -1, dtype=np.int64)
        asked = np.flatnonzero(parent >= 0)
        if k and len(asked):
            pointers = self.levels[k - 1][1]
            parents, each = np.unique(parent[asked], return_inverse=True)
            asked = asked[(pointers.access(parents) < pointers.access(parents + 1))[each]]
        if len(asked):
            base = parent[asked].astype(U64) * U64(self.vocabulary) if k else U64(0)
            place, equal = self.levels[k][0].successor(base + words[asked].astype(U64))
            out[asked[equal]] = place[equal]
        return out

    def quanta(self, order: int, at: np.ndarray) -> np.ndarray:
        """Negative log10 probabilities in steps of QUANTUM."""
        return self.levels[order - 1][2][at].astype(np.int64)

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<qq", self.vocabulary, len(self.levels))]
        for sequence, pointers, codes in self.levels:
            parts += [sequence.to_bytes(), struct.pack("<q", pointers is not None), pointers.to_bytes() if pointers else b""]
            parts += [struct.pack("<q", len(codes)), codes.tobytes(), bytes(-2 * len(codes) % 8)]
        return b"".join(parts)

    @classmethod
    def view(cls, data: memoryview) -> Trie:
        vocabulary, orders = struct.unpack("<qq", data[:16])
        data, levels = data[16:], []
        for _ in range(orders):
            sequence, data = EliasFano.view(data)
            has, data = struct.unpack("<q", data[:8])[0], data[8:]
            pointers, data = EliasFano.view(data) if has else (None, data)
            n, data = struct.unpack("<q", data[:8])[0], data[8:]
            levels.append((sequence, pointers, np.frombuffer(data[: 2 * n], "<u2")))
            data = data[2 * n + -2 * n % 8 :]
        return cls(vocabulary, levels)

    def mapped(self) -> Trie:
        """The same trie, read from an anonymous memory map."""
        data = self.to_bytes()
        memory = mmap.mmap(-1, len(data))
        memory[:] = data
        return Trie.view(memoryview(memory))
