"""Vectorised scanning of Arrow string columns.

A string column is one run of UTF-8 bytes plus offsets, so words, lines and hashes of whole
batches come from numpy passes over that run, with no Python object per word.  Batches are cut
into chunks of about a megabyte at row boundaries: memory follows the chunk (or the longest single
text), not the batch.

Words are ``[^\\x20\\x09-\\x0D]+``: only ASCII white space separates them.  Null texts are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (the SplitMix64 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), CHUNK_BYTES + 4096)
            grown = []
            for b in (self.base, self.inverse):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                grown.append(np.cumprod(x, dtype=np.uint64))
            self.up, self.down = grown
        return self.up, self.down


class Hasher:
    """Hashes of any segments of a sequence from one prefix sum: equal segments hash alike wherever they stand."""

    def __init__(self, seed: int, base: int):
        self.seed = np.uint64(seed)
        self.powers = Powers(base)
        self.of_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.seed)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: bytes, or 64-bit hashes of words."""
        up, _ = self.powers.get(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        terms = self.of_byte[values] if values.dtype == np.uint8 else values * (self.seed | np.uint64(1))
        np.cumsum(terms * up[: len(values)], out=out[1:])
        return out

    def segments(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self.powers.get(len(prefix) + 1)
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * self.seed)


FIRST = Hasher(0x243F6A8885A308D3, 0x9E3779B97F4A7C15 * 4 + 5 & (1 << 64) - 1)
SECOND = Hasher(0x13198A2E03707344, 0xC2B2AE3D27D4EB4F * 8 + 3 & (1 << 64) - 1)


class Scan:
    """Some consecutive texts of a column: ``data`` their bytes, ``off`` where each starts and ends."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int = 0):
        self.data, self.off, self.first, self.n = data, off, first, len(off) - 1
        self._words = self._hash = self._prefix = None

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many positions of the mask are set within each text."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    def runs(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of positions that are no breaks and lie in one text."""
        solid = ~breaks
        full = self.off[:-1] < self.off[1:]
        before = np.ones(len(breaks), bool)
        before[1:] = breaks[:-1]
        before[self.off[:-1][full]] = True
        after = np.ones(len(breaks), bool)
        after[:-1] = breaks[1:]
        after[self.off[1:][full] - 1] = True
        return np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        if self._words is None:
            self._words = self.runs(SPACE[self.data])
        return self._words

    @property
    def word_off(self) -> np.ndarray:
        """Where the words of each text start and end in ``words``."""
        return np.searchsorted(self.words[0], self.off)

    @property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_off))

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = FIRST.prefix(self.data)
        return self._prefix

    @property
    def word_hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = FIRST.segments(self.prefix, *self.words)
        return self._hash

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each line; a text of n line feeds has n + 1 lines."""
        at = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.off[:-1], at + 1]), kind="stable")
        end = np.sort(np.concatenate([self.off[1:], at]), kind="stable")
        per = self.count(self.data == 10) + 1
        return start, end, np.repeat(np.arange(self.n), per)


def column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string (or binary) column; nulls are empty."""
    a = batch.column(name) if isinstance(name, str) else name
    if a.null_count:
        a = a.fill_null(b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else "")
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def scans(batch: pa.RecordBatch, name: str = "text", *, lower: bool = False, limit: int = CHUNK_BYTES, rows: int = 1 << 16):
    """The chunks of a column, each with whole texts, at most so many."""
    data, off = column(batch, name)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1), i + rows)
        part = data[off[i] : off[j]]
        yield Scan(LOWER[part] if lower else part, off[i : j + 1] - off[i], i)
        i = j


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (or the sum of its weights)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(weights[order].astype(np.int64), at)
