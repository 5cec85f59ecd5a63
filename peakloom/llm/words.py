"""Words of whole batches of texts as Arrow arrays, piece by piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .shingles import utf8

#: Bytes of text looked at together; a longer text is cut between words.
PIECE_BYTES = 1 << 20

#: Says of each byte of some UTF-8 whether it belongs to a word, from it and the byte before.
Inside = Callable[[np.ndarray], np.ndarray]


def pieces(column: pa.Array, inside: Inside) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of texts, offsets, bytes) of a column in pieces of about PIECE_BYTES: whole texts, or a part of one that ends where a word does."""
    offsets, data = utf8(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        if offsets[to] - offsets[at] <= PIECE_BYTES:
            yield np.arange(at, to), offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        else:
            low, end = int(offsets[at]), int(offsets[to])
            while low < end:
                high = min(end, low + PIECE_BYTES)
                # a word's byte tells by itself and the one before it
                while high < end and not (gap := ~inside(data[high - 2 : min(end, high + PIECE_BYTES)])[1:])[0]:
                    high = high + int(gap.argmax()) if gap.any() else min(end, high + PIECE_BYTES)
                yield np.array([at]), np.array([0, high - low]), data[low:high]
                low = high
        at = to


def words(offsets: np.ndarray, data: np.ndarray, word: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words, runs of bytes in `word` that no text's end cuts, as binary values, and the place of each one's text among the offsets."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    out = np.concatenate([[True], ~word, [True]])
    starts = np.flatnonzero(word & (out[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (out[2:] | edge[1:])) + 1
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[word]))])
    return found, np.searchsorted(offsets, starts, "right") - 1
