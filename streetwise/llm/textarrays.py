"""Words and shingles of UTF-8 texts as numpy arrays, without Python strings."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_LIBC = ctypes.CDLL(None)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII white space, \x20 and \x09-\x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = _U(0x100000001B3)
_power = np.ones(1, dtype=_U)
#: Bytes of text looked at in one go: about 40 bytes of arrays for each.
CHUNK = 1 << 18


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        steps = np.full(max(n, 2 * len(_power)), _BASE, dtype=_U)
        steps[0] = 1
        _power = np.cumprod(steps, dtype=_U)
    return _power[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two rounds of xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


#: What a worker keeps from task to task, by its purpose.
kept: dict[str, object] = {}
_last_trim = 0.0


def trimmed(purpose: str = "") -> None:
    """Drops what is kept for other purposes, and gives memory that is free back to the
    machine (once a second): a worker lives on from stage to stage."""
    global _last_trim
    others = [name for name in kept if name != purpose]
    for name in others:
        del kept[name]
    if others or time.monotonic() - _last_trim >= 1:
        pa.default_memory_pool().release_unused()
        if trim := getattr(_LIBC, "malloc_trim", None):
            trim(0)
        _last_trim = time.monotonic()


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``size`` bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _LOWER, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts between the offsets: a 64-bit hash of each word, its start (from the
    first offset) and length in bytes, and the words' bounds by text. Bytes are folded
    first (by default A-Z lower-cased), then split where ``blank`` (by default at ASCII
    white space)."""
    low, high = int(offsets[0]), int(offsets[-1])
    data = fold[raw[low:high]]
    at = offsets - low
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, _U), none, none, np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    opens = np.zeros(n + 1, dtype=bool)
    opens[at[at < n]] = True
    before = np.concatenate(([False], inside[:-1])) & ~opens[:n]
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        return np.zeros(0, _U), none, none, np.zeros(len(offsets), np.int64)
    body = np.flatnonzero(inside).astype(np.int32)  # a run has less than 2 GB
    first = np.searchsorted(body, start.astype(np.int32))
    length = np.diff(np.append(first, len(body)))
    place = np.arange(len(body), dtype=np.int32)
    place -= np.repeat(first.astype(np.int32), length)
    value = data[body].astype(_U)
    value += _U(1)
    value *= _powers(int(length.max()))[place]
    hashes = mix(np.add.reduceat(value, first) + length.astype(_U))
    return hashes, start, length, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _LOWER, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and bounds of word_spans()."""
    hashes, _, _, at = word_spans(raw, offsets, fold, blank)
    return hashes, at


def pair_shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 2-word shingles; a single word is one shingle."""
    if len(hashes) < 2:
        return mix(hashes + _U(0x632BE59BD9B4E019))
    return np.unique(mix(hashes[:-1] * _U(0x9FB21C651E98DF25) + (hashes[1:] ^ (hashes[1:] >> _U(17)))))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The 2-word shingle set of each text, in order."""
    raw, offsets = utf8(column)
    for first, last in chunks(offsets):
        hashes, at = word_hashes(raw, offsets[first : last + 1])
        for i in range(last - first):
            yield pair_shingles(hashes[at[i] : at[i + 1]])
