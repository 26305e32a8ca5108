"""Numpy kernels over Arrow text columns: whole texts, as bytes, in chunks of bounded size.

A chunk holds whole documents up to ``CHUNK_BYTES``; a longer document is a chunk of its own, so memory is bounded by
the larger of the two. All hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
# Words of decontamination: digits, letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def give_back() -> None:
    """What Arrow and numpy have freed goes back to the machine: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes. Null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, end, data[off[first]:off[end]], (off[first:end + 1] - off[first])
        first = end
    give_back()


def word_spans(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets per document) of maximal runs of ``member`` bytes; runs end with their document."""
    inside = member[data]
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = off[1:-1]
    left = edge[edge < len(data)]
    begin[left] = inside[left]
    right = edge[edge > 0] - 1
    stop[right] = inside[right]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """One 64-bit hash per word of the (lower-cased) bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    total = np.cumsum(_BYTE[LOWER[data] if lower else data] * up)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix((total[ends - 1] - before) * down[starts])


def shingle_hashes(h: np.ndarray, woff: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets per document) of word runs; a document of fewer words, but not none, is one shingle."""
    words = np.diff(woff)
    counts = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    soff = np.concatenate([[0], np.cumsum(counts)])
    total = int(soff[-1])
    if total == 0:
        return np.zeros(0, np.uint64), soff
    at = np.repeat(woff[:-1] - soff[:-1], counts) + np.arange(total)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for j in range(width):
        out += padded[at + j] * _MIX[j % 8] + np.uint64(j)
    short = np.flatnonzero((words > 0) & (words < width))
    for d in short:
        part = h[woff[d]:woff[d + 1]]
        with np.errstate(over="ignore"):
            acc = np.uint64(0xD6E8FEB86659FD93) * np.uint64(len(part))
            for j, x in enumerate(part):
                acc = acc + x * _MIX[j % 8] + np.uint64(j)
        out[soff[d]] = acc
    return mix(out), soff


def sorted_sets(hashes: np.ndarray, soff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes per document, concatenated, with their offsets."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(soff[:-1], soff[1:])]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), off


def run_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each run ``off[i]:off[i+1]``; empty runs give 0."""
    out = np.zeros(len(off) - 1, values.dtype)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full])
    return out
