"""Word shingles of whole batches of texts, hashed in bulk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; of a longer text, which stands alone, so many and the rest of the last word.
CHUNK_BYTES, PART_BYTES = 1 << 20, 1 << 23

_ODD = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
#: A random number for each byte; A to Z share those of a to z.
_VALUES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, np.uint64)[_LOWER]
_STEPS = np.random.default_rng(7).integers(1, 1 << 63, 16, np.uint64) | np.uint64(1)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = (n + 0x10000) & ~0xFFFF
            cls.up, cls.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, x, np.uint64))) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; nulls are empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.fill_null(b"" if binary else "").cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text stands alone."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def _word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and for each text where its words begin (one more at the end)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    blank = np.concatenate([[True], _SPACE[data], [True]])
    word = ~blank[1:-1]
    starts = np.flatnonzero(word & (blank[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (blank[2:] | edge[1:])) + 1
    up, down = Powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def _long_text_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all words of one very long text, part by part, which end where words do."""
    found, at = [], 0
    while at < len(data):
        to = min(len(data), at + PART_BYTES)
        while to < len(data) and not _SPACE[data[to - 1]]:
            blank = np.flatnonzero(_SPACE[data[to : to + PART_BYTES]])
            to = to + int(blank[0]) + 1 if len(blank) else min(len(data), to + PART_BYTES)
        found.append(_word_hashes(np.array([0, to - at]), data[at:to])[0])
        at = to
    return np.concatenate(found)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of so many words as sorted 64-bit hashes.

    Words are runs of other bytes than space and \\t to \\r, A to Z in lower
    case. A text of fewer words is one shingle, one without words has none. A
    text takes some 50 bytes of memory a word besides itself, however long.
    """
    offsets, data = utf8(column)
    for a, b in chunks(offsets, CHUNK_BYTES):
        if b - a == 1 and offsets[b] - offsets[a] > PART_BYTES:
            hashes = _long_text_hashes(data[offsets[a] : offsets[b]])
            first = np.array([0, len(hashes)])
        else:
            hashes, first = _word_hashes(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
        long = np.full(max(0, len(hashes) - words + 1), words, np.uint64)
        for j in range(words):
            long += hashes[j : len(hashes) - words + 1 + j] * _STEPS[j]
        long = mix(long)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= words:
                yield np.unique(long[s : e - words + 1])
            elif e > s:
                yield mix(np.array([int(e - s)], np.uint64) + (hashes[s:e] * _STEPS[: e - s]).sum(dtype=np.uint64))
            else:
                yield np.empty(0, np.uint64)
