"""Words and word hashes of many texts at once, as numpy arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z
lower-cased. Its hash is a multilinear hash of the bytes, so that hashing a block
of texts takes a fixed number of passes over one byte array and no loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 2 << 20
SPACES = b"\t\n\x0b\x0c\r "
_SPAN = 1 << 12

_VALUE = np.arange(1, 257, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = _VALUE[_LOWER]
_VALUE[list(SPACES)] = 0
_IN_WORD = _VALUE > 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_MULTIPLIERS = _odd(_SPAN, 1)
_FAR = np.uint64(0xD6E8FEB86659FD93)


def give_back() -> None:
    """Hand freed memory of this process back to the system: idle workers are kept for other stages, a driver goes on to others, and both would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over record batches that gives its memory back at the end of each task."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def text_groups(batch: pa.RecordBatch, column: str = "text", size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``size`` bytes: at least one row each, and 2048 at most."""
    offsets = text_bytes(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, min(start + 2048, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1))
        yield start, stop
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each text; a null is an empty text."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = texts.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    bounds = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(wide) else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and for each text the number of words before it."""
    raw, offsets = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = _starts(raw, offsets)[0]
    before = np.searchsorted(starts, offsets)
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + GROUP_BYTES)))
        stop = starts[b] if b < len(starts) else len(raw)
        local = starts[a:b] - starts[a]
        place = np.arange(stop - starts[a], dtype=np.int64)
        place -= np.repeat(local, np.diff(np.append(local, stop - starts[a])))
        times = _MULTIPLIERS[place & (_SPAN - 1)]
        if place.max() >= _SPAN:
            times = times * (((place >> 12).astype(np.uint64) * _FAR) | np.uint64(1))
        hashes[a:b] = np.add.reduceat(_VALUE[raw[starts[a] : stop]] * times, local)
        a = b
    return mix(hashes), before


def _starts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and of the last byte of each word."""
    inside = _IN_WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    return starts, np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False]))))


def word_endings(texts: pa.Array, n_bytes: int = 3) -> np.ndarray:
    """Hashes of the last bytes of the words, in the order of ``word_hashes``."""
    raw, offsets = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.uint64)
    starts, last = _starts(raw, offsets)
    ending = np.zeros(len(starts), np.uint64)
    for k in range(n_bytes):
        at = last - k
        ending = ending * np.uint64(257) + np.where(at >= starts, _VALUE[raw[np.maximum(at, 0)]], 0).astype(np.uint64)
    return mix(ending)


def shingle_sets(hashes: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of runs of ``width`` words for each text, and the bounds of each set.

    A text of fewer words has its whole sequence as its only run; one without words has none.
    """
    times = _odd(width, 77)
    n = np.diff(before)
    runs = np.zeros(len(hashes), np.uint64)
    for j in range(width):
        runs[: len(hashes) - j] += hashes[j:] * times[j]
    sets = []
    for i, count in enumerate(n):
        start = before[i]
        if count >= width:
            one = mix(runs[start : before[i + 1] - width + 1])
            one.sort()
            sets.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
        elif count:
            whole = (hashes[start : before[i + 1]] * times[:count]).sum(dtype=np.uint64)
            sets.append(mix(np.array([whole ^ np.uint64(count)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds
