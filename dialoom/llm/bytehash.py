"""Vectorised hashing for batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from .common import ship_by_value

ship_by_value(__name__)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit numbers."""
    return mixed(np.arange(n, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


_LOW = (np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1)
#: Longer ranges get a cryptographic hash one by one.
_LONG = 256


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): eight bytes at a time go into a bijective mixer, which begins with the length.

    So ranges of one to eight bytes never collide with others of their length, and longer ones by chance alone.
    """
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    size = ends - starts
    out = mixed(size.astype(np.uint64))
    todo, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(todo):
        value = eight[starts[todo] + at]
        rest = size[todo] - at
        part = rest < 8
        value[part] &= _LOW[rest[part]]
        out[todo] = mixed(out[todo] ^ value)
        at += 8
        todo = todo[rest > 8]
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def blocks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes come to about ``most`` at most; a longer text is a block of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function``, after which the worker, which lives on for other tasks, gives the memory of this one back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run
