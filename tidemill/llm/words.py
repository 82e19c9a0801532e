"""Words of whole texts as 64-bit hashes, computed with numpy over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 500_000

_P = np.uint64(2**31 - 1)
_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 2**31 - 1, 256, dtype=np.uint64)
_BASES = (1_222_333_445, 948_120_331)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _folded(x: np.ndarray) -> np.ndarray:
    """x (below 2^63) modulo the prime 2^31 - 1."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of a base and of its inverse modulo the prime, grown to the longest text seen."""

    def __init__(self, base: int) -> None:
        self.steps = base, pow(base, -1, int(_P))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            up, down = (np.uint64(pow(x, len(self.up), int(_P))) for x in self.steps)
            self.up, self.down = np.concatenate([self.up, _folded(self.up * up)]), np.concatenate([self.down, _folded(self.down * down)])
        return self.up, self.down


_powers = [_Powers(base) for base in _BASES]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, then memory that it no longer needs goes back to the machine, as the worker stays for other tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    """Gives memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about size bytes (one text at least): first row, row after the last, bytes, offsets from 0. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Line:
    """The bytes of many texts with hashes of any of their runs: polynomials in two bases over a prime field."""

    def __init__(self, data: np.ndarray) -> None:
        self.lanes = []
        for powers in _powers:
            up, down = powers.upto(len(data) + 1)
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_folded(_BYTE[data] * up[: len(data)]), out=sums[1:], dtype=np.uint64)
            self.lanes.append((sums, down))

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte run [start, end)."""
        high, low = (_folded(_folded(sums[ends] - sums[starts]) * down[starts]) for sums, down in self.lanes)
        return mix(((high << np.uint64(32)) | low) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are no ASCII white space), and where each text's begin (one more than texts)."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and where each text's begin."""
    starts, ends, at = bounds(data, offsets)
    return Line(LOWER[data] if lower else data).runs(starts, ends), at
