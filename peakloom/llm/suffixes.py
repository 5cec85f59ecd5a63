"""Two-stage suffix sorting of a block of bytes, to a limited depth.

Stage one sorts directly only suffixes that are smaller than their successors;
stage two scans the buckets of first bytes in ascending order and puts every
other suffix, greater than its successor, behind those of its bucket already
there, in the order in which the successors come by.
"""

from __future__ import annotations

import numpy as np


def ascends(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than its successor; the last one isn't."""
    n = len(text)
    change = np.append(text[:-1] != text[1:], True)
    at = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
    less = np.append(text[:-1] < text[1:], False)
    return less[at]


def sorted_suffixes(text: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes (a mask) in order of their first `depth` bytes at least.

    Besides them only those are placed from which they are induced: the ones up
    to the next suffix that is sorted directly.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    up = ascends(t)
    next_up = np.minimum.accumulate(np.where(up, np.arange(n), n)[::-1])[::-1]
    live = np.zeros(n + 1, np.int32)
    starts = np.flatnonzero(wanted)
    np.add.at(live, starts, 1)
    np.add.at(live, np.minimum(next_up[starts], n - 1) + 1, -1)
    live = np.cumsum(live[:n]) > 0

    direct = np.flatnonzero(live & up)
    pair = t[direct].astype(np.uint16) << 8 | t[np.minimum(direct + 1, n - 1)]
    direct = direct[np.argsort(pair, kind="stable")]
    pair = np.sort(pair, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]])) if len(pair) else np.array([0])
    as_str = text.decode("latin-1")
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:
            own = direct[a:b]
            prefixes = [as_str[i : i + depth] for i in own.tolist()]
            direct[a:b] = own[sorted(range(b - a), key=prefixes.__getitem__)]
    first = np.searchsorted(t[direct], np.arange(257))

    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and live[n - 1] and not up[n - 1]:
        induced[t[n - 1]].append(np.array([n - 1]))
    drops = live & ~up
    order = []
    for c in range(256):
        frontier = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        behind = [frontier]
        while len(frontier):
            before = frontier - 1
            before = before[before >= 0]
            frontier = before[drops[before] & (t[before] == c)]
            behind.append(frontier)
        bucket = np.concatenate([*behind, direct[first[c] : first[c + 1]]])
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[drops[before] & (t[before] > c)]
        head = t[before]
        before = before[np.argsort(head, kind="stable")]
        for d, part in zip(*_runs(np.sort(head), before), strict=True):
            induced[d].append(part)
    whole = np.concatenate(order) if order else np.empty(0, np.int64)
    return whole[wanted[whole]]


def _runs(heads: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(heads):
        return [], []
    cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
    return heads[np.concatenate([[0], cuts])].tolist(), np.split(values, cuts)


def common_prefixes(text: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it, counted up to `most`; 0 for the first."""
    padded = np.frombuffer(text + b"\0" * (most + 8), np.uint8).astype(np.uint64)
    words = np.zeros(len(padded) - 7, np.uint64)
    for j in range(8):
        words = words << np.uint64(8) | padded[j : len(padded) - 7 + j]
    shared = np.zeros(len(order), np.int64)
    at, a, b = np.arange(1, len(order)), order[:-1], order[1:]
    for done in range(0, most, 8):
        differ = words[a + done] ^ words[b + done]
        same = differ == 0
        for k in range(1, 8):
            shared[at] += differ < (np.uint64(1) << np.uint64(64 - 8 * k))
        shared[at[same]] += 1
        at, a, b = at[same], a[same], b[same]
        if not len(at):
            break
    return np.minimum(shared, most)
