"""Averaged peaks of clusters: all their spectra's peaks in order of m/z, cut at gaps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Peaks that are worked on together; a cluster's peaks always are.
PEAKS_AT_ONCE = 1 << 20


@dataclass
class Cut:
    """Peaks of n clusters by cluster and m/z, nulls first, NaN last; known tells nulls of both values, which are 0."""

    n: int
    cluster: np.ndarray
    mz: np.ndarray
    intensity: np.ndarray
    known: tuple[np.ndarray, np.ndarray]
    segment: np.ndarray


def _values(lists: pa.Array, use: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = lists.filter(use).flatten().cast(pa.float64())
    return flat.fill_null(0.0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)


def cut(mz: pa.ListArray, intensity: pa.ListArray, gap: float, merge_tail: bool) -> Cut:
    """Segments of each cluster's peaks, given its spectra's lists: a peak `gap` and more above the one before it opens the next.

    Spectra without either list have no peaks. A null is at no distance, a NaN at any.
    """
    lists = [a.flatten() for a in (mz, intensity)]
    use = pc.and_(*(a.is_valid() for a in lists))
    sizes = [pc.list_value_length(a).filter(use).to_numpy(zero_copy_only=False) for a in lists]
    if not np.array_equal(*sizes):
        raise ValueError("m/z and intensity arrays differ in length")
    (m, m_known), (i, i_known) = (_values(a, use) for a in lists)
    spectra = pc.list_value_length(mz).to_numpy(zero_copy_only=False)
    cluster = np.repeat(np.repeat(np.arange(len(mz)), spectra)[use.to_numpy(zero_copy_only=False)], sizes[0])
    order = np.lexsort((i, i_known, m, m_known, cluster))
    cluster, m, i, m_known, i_known = (v[order] for v in (cluster, m, i, m_known, i_known))
    same = cluster[1:] == cluster[:-1]
    with np.errstate(invalid="ignore"):
        opens = np.concatenate([[False], same & m_known[1:] & m_known[:-1] & ~(np.diff(m) < gap)])[: len(m)]
    first = np.flatnonzero(np.concatenate([[True], ~same])[: len(m)])
    count = np.diff(np.append(first, len(m)))
    segment = np.cumsum(opens)
    segment -= np.repeat(segment[first], count)
    if merge_tail:
        last = np.repeat(segment[first + count - 1], count)
        segment -= (segment == last) & (last >= 2)
    return Cut(len(mz), cluster, m, i, (m_known, i_known), segment)


def averaged(peaks: Cut, size: np.ndarray, fraction: float, dyn_range: float, weighted: bool) -> pa.StructArray:
    """mz_array and intensity_array of each cluster of so many spectra, by m/z: means of segments with enough peaks and within the dynamic range.

    A segment without intensity has a null m/z.
    """
    c, (m_known, i_known) = peaks.cluster, peaks.known
    first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (peaks.segment[1:] != peaks.segment[:-1])])[: len(c)])
    add = lambda v: np.add.reduceat(v, first) if len(first) else np.zeros(0)
    n, total, summed = np.diff(np.append(first, len(c))), add(peaks.intensity), add(i_known.astype(np.int64)) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        if weighted:
            both = m_known & i_known
            mz, has_mz = add(np.where(both, peaks.mz * peaks.intensity, 0.0)) / total, (add(both.astype(np.int64)) > 0) & (total != 0)
        else:
            known = add(m_known.astype(np.int64))
            mz, has_mz = add(peaks.mz) / known, known > 0
        c = c[first]
        kept = summed & (n >= size[c] * fraction)
        mean = total / size[c]
        most = np.full(peaks.n, -np.inf)
        np.maximum.at(most, c[kept], mean[kept])  # a NaN stays
        kept &= np.isnan(mean) | (mean >= most[c] / dyn_range)
    c, mz, mean, has_mz = (v[kept] for v in (c, mz, mean, has_mz))
    mz = np.where(has_mz, mz, 0.0)
    order = np.lexsort((mean, mz, has_mz, c))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(c, minlength=peaks.n))]), pa.int32())
    values = pa.array(mz[order], pa.float64(), mask=~has_mz[order]), pa.array(mean[order], pa.float64())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, v) for v in values], ["mz_array", "intensity_array"])


def _pieces(mz: pa.ListArray, intensity: pa.ListArray):
    """Both lists in runs of clusters with some PEAKS_AT_ONCE peaks."""
    sizes = pc.list_value_length(mz.flatten()).fill_null(0).to_numpy(zero_copy_only=False)
    spectra = pc.list_value_length(mz).to_numpy(zero_copy_only=False)
    done = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(spectra)]
    run = done // PEAKS_AT_ONCE
    starts = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(mz)]]) if len(mz) else [0, 0]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield mz.slice(a, b - a), intensity.slice(a, b - a)


def _lists(spectra: Column) -> tuple[Column, Column]:
    return tuple(spectra[f].cast("array<array<double>>") for f in ("mz_array", "intensity_array"))


def averaged_peaks(spectra: Column, gap: float, fraction: float, dyn_range: float, weighted: bool, merge_tail: bool) -> Column:
    """averaged() of a cluster's spectra, structs with mz_array and intensity_array."""

    @F.arrow_udf("mz_array array<double>, intensity_array array<double>")
    def average(mz: pa.Array, intensity: pa.Array) -> pa.Array:
        made = [averaged(cut(m, i, gap, merge_tail), pc.list_value_length(m).to_numpy(zero_copy_only=False), fraction, dyn_range, weighted) for m, i in _pieces(mz, intensity)]
        return pa.concat_arrays(made)

    return average(*_lists(spectra))


def cut_peaks(spectra: Column, gap: float, merge_tail: bool) -> Column:
    """Structs (segment, mz, intensity) of all peaks of a cluster's spectra, by m/z."""

    @F.arrow_udf("array<struct<segment: bigint, mz: double, intensity: double>>")
    def segments(mz: pa.Array, intensity: pa.Array) -> pa.Array:
        made = []
        for p in (cut(m, i, gap, merge_tail) for m, i in _pieces(mz, intensity)):
            values = [pa.array(v, pa.float64(), mask=~known) for v, known in zip((p.mz, p.intensity), p.known, strict=True)]
            rows = pa.StructArray.from_arrays([pa.array(p.segment, pa.int64()), *values], ["segment", "mz", "intensity"])
            made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(p.cluster, minlength=p.n))]), pa.int32()), rows))
        return pa.concat_arrays(made)

    return segments(*_lists(spectra))
