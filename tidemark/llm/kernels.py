"""Array work on the bytes of a batch of texts: words, polynomial hashes and their windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that part words: space and tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are worked on at a time: arrays of eight bytes a byte stay small beside a worker's other memory.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 bounds of texts. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    column = column.fill_null("" if kind == pa.large_string() else b"") if column.null_count else column
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts that together hold at most size bytes, or one longer text."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, j
        i = j


class Hasher:
    """Prefix sums of a polynomial in an odd base modulo 2**64 over fixed random numbers for bytes,
    so the hash of any range takes constant time."""

    def __init__(self, seed: int, lower: bool = False):
        rng = np.random.default_rng(seed)
        self.of = rng.integers(0, 2**63, 256, np.uint64) * U(2) + U(1)
        if lower:
            self.of[65:91] = self.of[97:123]
        self.base = int(rng.integers(0, 2**61)) * 8 + 5
        self.up = self.down = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = _powers(self.base, n)
                self.down = _powers(pow(self.base, -1, 2**64), n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Takes eight bytes a byte, and the powers that stay take sixteen: for pieces, not for whole texts."""
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, U)
        np.cumsum(self.of[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U))

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Of every range of width bytes, without the final mix."""
        n = max(0, len(prefix) - width)
        return (prefix[width:] - prefix[:n]) * self.down[:n]

    def of_ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of ascending ranges that don't overlap, as ranges() gives them, over a piece of data at a time."""
        if len(data) <= PIECE:
            return self.ranges(self.prefix(data), start, end)
        out, i = np.zeros(len(start), U), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
            a, z = int(start[i]), int(end[j - 1])
            if z - a <= PIECE:
                out[i:j] = self.ranges(self.prefix(data[a:z]), start[i:j] - a, end[i:j] - a)
            else:  # one range longer than a piece: the sum of its pieces' sums, each moved to its place
                total = sum(int(self.prefix(data[k : min(z, k + PIECE)])[-1]) * pow(self.base, k - a, 2**64) for k in range(a, z, PIECE))
                out[i] = mix(np.array([(total + z - a) % 2**64], U))[0]
            i = j
        return out

    def each_window(self, data: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """First place and mixed hashes of all windows, a piece at a time."""
        for k in range(0, len(data) - width + 1, PIECE):
            yield k, mix(self.windows(self.prefix(data[k : k + PIECE + width - 1]), width))


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, U), 1
    while k < n:  # base**(i + k) from base**i
        out[k : 2 * k] = out[: min(k, n - k)] * U(pow(base, k, 2**64))
        k *= 2
    return out


@lru_cache
def hasher(seed: int, lower: bool = False) -> Hasher:
    return Hasher(seed, lower)


@lru_cache
def _apart() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(SPACES)] = True
    return out


def words(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and text number of every word; bounds of texts part words as well. apart: for each byte
    whether it parts words, by default SPACES."""
    inside = ~(_apart() if apart is None else apart)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First rows and sizes of the runs of rows that agree in all keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(new)))


def couples(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows of a run: those k apart, for all runs at once, for each k."""
    for k in range(1, int(size.max(initial=0))):
        live = size > k
        start, size = start[live], size[live]
        n = size - k
        a = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield a, a + k
