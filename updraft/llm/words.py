"""Vectorised word hashes and shingles over batches of UTF-8 texts.

A word is a run of bytes other than space and 0x09-0x0D, after A-Z became a-z.
Its hash is a polynomial over its bytes modulo 2**64, taken from running sums,
so a batch costs a few passes over its bytes whatever the number of words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = U64(0xD6E8FEB86659FD93)
GROUP_BYTES = 1 << 20
ROWS = 512
LOWER = bytes(range(256)).lower()
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True

_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def give_back() -> None:
    """Memory that Arrow and, with glibc, the allocator keep for later goes back to the system, while the worker waits."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n; kept up to about twice GROUP_BYTES."""
    up, down = _powers["up"], _powers["down"]
    if len(up) < n:
        size = max(n, 2 * GROUP_BYTES + 2)
        up, down = np.full(size, BASE, U64), np.full(size, INVERSE, U64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size <= 2 * GROUP_BYTES + 2:
            _powers.update(up=up, down=down)
    return up[:n], down[:n]


def buffer_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of ``data``, which is lower case already."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, U64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~GAP[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def cuts(data: bytes, most: int) -> Iterator[bytes]:
    """``data`` in pieces of about ``most`` bytes, cut between words only."""
    raw, at = np.frombuffer(data, np.uint8), 0
    while len(data) - at > most:
        gap, to = -1, at + most
        while gap < 0 and to < len(data):
            found = np.flatnonzero(GAP[raw[to : to + most]])
            gap, to = (to + int(found[0]), to) if len(found) else (-1, to + most)
        if gap < 0:
            break
        yield data[at:gap]
        at = gap
    yield data[at:]


def scan(texts: pa.Array | Sequence[bytes | None], fold: bytes = LOWER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each range of texts: its first index, the words in each text, all word hashes in order.

    ``fold`` is a translation table applied to the bytes first. A range holds about
    GROUP_BYTES; an Arrow array is turned into bytes a few rows at a time.
    """
    part: list[bytes] = []
    first, size = 0, 0
    for at in range(0, len(texts), ROWS):
        rows = texts[at : at + ROWS]
        for text in rows.to_pylist() if isinstance(rows, (pa.Array, pa.ChunkedArray)) else rows:
            part.append((text or b"").translate(fold))
            size += len(part[-1]) + 1
            if size >= GROUP_BYTES:
                yield first, *words_of(part)
                first, part, size = first + len(part), [], 0
    if part:
        yield first, *words_of(part)


def words_of(part: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words in each text and all their hashes; a long text is scanned between its words in pieces."""
    if sum(map(len, part)) > 2 * GROUP_BYTES:
        each = [np.concatenate([buffer_hashes(x)[1] for x in cuts(t, GROUP_BYTES)]) for t in part]
        return np.array([len(h) for h in each]), np.concatenate(each)
    begin = np.cumsum([0, *(len(t) + 1 for t in part)])
    start, hashes = buffer_hashes(b"\n".join(part))
    return np.diff(np.searchsorted(start, begin)), hashes


def sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * STEP + hashes[j : j + n]
    return mix(out + U64(k))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; with fewer words, the whole sequence as one."""
    if len(hashes) == 0:
        return hashes
    return np.unique(sequences(hashes, min(k, len(hashes))))
