"""Similarity of spectra: peaks match one to one within a tolerance, lowest first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Residue masses in Da, and of water.
RESIDUES = {
    "A": 71.03711, "R": 156.10111, "N": 114.04293, "D": 115.02694, "C": 103.00919, "E": 129.04259, "Q": 128.05858, "G": 57.02146, "H": 137.05891, "I": 113.08406,
    "L": 113.08406, "K": 128.09496, "M": 131.04049, "F": 147.06841, "P": 97.05276, "S": 87.03203, "T": 101.04768, "W": 186.07931, "Y": 163.06333, "V": 99.06841,
}
WATER, PROTON = 18.01056, 1.00727646677
#: Left peaks matched at once.
PEAKS_AT_ONCE = 1 << 20


class Spectra:
    """Peak lists of a batch, end to end: m/z in order within each spectrum, intensities at Euclidean length 1 (all zero if there are none)."""

    def __init__(self, mz: pa.ListArray, intensity: pa.ListArray):
        sizes = pc.fill_null(pc.list_value_length(mz), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not np.array_equal(sizes, pc.fill_null(pc.list_value_length(intensity), 0).to_numpy(zero_copy_only=False)):
            raise ValueError("m/z and intensity arrays differ in length")
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        spectrum = np.repeat(np.arange(len(sizes)), sizes)
        values = [a.flatten().to_numpy(zero_copy_only=False).astype(float) for a in (mz, intensity)]
        order = np.lexsort((values[0], spectrum))
        self.mz, weight = (v[order] for v in values)
        norm = np.sqrt(np.bincount(spectrum, weight * weight, len(sizes)))
        self.weight = weight / np.where(norm > 0, norm, 1)[spectrum]
        # every m/z by its rank among all, so that (spectrum, m/z) is one exact integer
        self.ranked, rank = np.unique(self.mz, return_inverse=True)
        self.keys = spectrum * (len(self.ranked) + 1) + rank


def _reach(spectra: Spectra, x: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranks from and below which an m/z is within the tolerance of x."""
    values, top = np.append(spectra.ranked, np.inf), len(spectra.ranked)
    low, high = np.searchsorted(values, x - tolerance), np.searchsorted(values[:-1], x + tolerance, "right")
    while (off := (low < top) & (x - values[low] > tolerance)).any():  # x - tolerance was rounded down
        low += off
    while (off := (low > 0) & (x - values[low - 1] <= tolerance)).any():  # or up
        low -= off
    while (off := (high > 0) & (values[high - 1] - x > tolerance)).any():
        high -= off
    while (off := (high < top) & (values[high] - x <= tolerance)).any():
        high += off
    return low, high


def _lowest_free(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What each of some takers gets, in order: the lowest free place from its low to below its high, else -1; both never fall.

    With v the next place that the first n takers leave, less n, a taker turns v
    into max(v, low - n), or, if v is not below high - n, into v - 1, which is
    high - n - 1 as v is never above. So every taker clamps v to a range, and
    clamps in a row are one clamp: doubling steps give those of all beginnings.
    """
    n = np.arange(len(low))
    least, most = low - n, high - n - 1
    before = np.maximum.accumulate(least) if len(low) else least
    if (before <= most).all():  # nobody goes without
        return before + n
    floor, ceiling, step = least.copy(), most.copy(), 1
    while step < len(low):
        # clamps that others come before are those others' first, then their own
        below, above = floor[:-step], ceiling[:-step]
        floor[step:], ceiling[step:] = np.clip(below, floor[step:], ceiling[step:]), np.clip(above, floor[step:], ceiling[step:])
        step *= 2
    v = np.concatenate([least[:1], floor[:-1]])
    return np.where(v <= most, np.maximum(v, least) + n, -1)


def _matched_products(spectra: Spectra, left: np.ndarray, right: np.ndarray, tolerance: float) -> np.ndarray:
    sizes = spectra.first[left + 1] - spectra.first[left]
    pair = np.repeat(np.arange(len(left)), sizes)
    peak = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + spectra.first[left][pair]
    low, high = _reach(spectra, spectra.mz[peak], tolerance)
    base = right[pair] * (len(spectra.ranked) + 1)
    low, high = np.searchsorted(spectra.keys, base + low), np.searchsorted(spectra.keys, base + high)
    live = np.flatnonzero(low < high)
    taken = _lowest_free(low[live] + pair[live] * (span := len(spectra.keys) + 1), high[live] + pair[live] * span)
    live, taken = live[taken >= 0], taken[taken >= 0]
    taken = taken - pair[live] * span
    return np.bincount(pair[live], spectra.weight[peak[live]] * spectra.weight[taken], len(left))


def dot_products(spectra: Spectra, left: np.ndarray, right: np.ndarray, tolerance: float) -> np.ndarray:
    """Sums of products of matched peaks for pairs of spectra.

    Peaks match one to one: by ascending m/z each peak of the left spectrum
    takes the lowest one of the right that is free and within the tolerance.
    """
    ends = np.cumsum(spectra.first[left + 1] - spectra.first[left])
    out, at = [np.zeros(0)], 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PEAKS_AT_ONCE, "right")))
        out.append(_matched_products(spectra, left[at:to], right[at:to], tolerance))
        at = to
    return np.concatenate(out)


#: Similarities by name: (spectra, left numbers, right numbers, tolerance) -> a number for each pair.
SIMILARITIES: dict[str, Callable] = {"dot": dot_products}


def pair_function(measure: Callable, tolerance: float) -> Callable:
    """A measure of SIMILARITIES as a function of four columns, (mz, intensity, other mz, other intensity), arrays of double; null if any is."""

    @F.arrow_udf(T.DoubleType())
    def measured(a: pa.Array, x: pa.Array, b: pa.Array, y: pa.Array) -> pa.Array:
        known = pc.and_(pc.and_(a.is_valid(), x.is_valid()), pc.and_(b.is_valid(), y.is_valid()))
        a, x, b, y = (v.filter(known).cast(pa.list_(pa.float64())) for v in (a, x, b, y))
        n = len(a)
        found = measure(Spectra(pa.concat_arrays([a, b]), pa.concat_arrays([x, y])), np.arange(n), np.arange(n, 2 * n), tolerance)
        out = np.full(len(known), np.nan)
        here = known.to_numpy(zero_copy_only=False)
        out[here] = found
        return pa.array(out, mask=~here)

    return measured


def similarity(mz: Column, intensity: Column, other_mz: Column, other_intensity: Column, tolerance: float = 0.02, sim: str = "dot") -> Column:
    """Similarity of two spectra in a row; null if any array is."""
    return pair_function(SIMILARITIES[sim], tolerance)(mz, intensity, other_mz, other_intensity)


def similarity_sums(spectra: Column, tolerance: float = 0.02, sim: str = "dot") -> Column:
    """For an array of struct<..., mz_array, intensity_array> each one's summed similarity to all, itself included.

    The earlier spectrum of a pair is always the left one; sums are rounded to
    9 digits. Null peak lists count as empty.
    """
    measure = SIMILARITIES[sim]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def summed(mz: pa.Array, intensity: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(mz), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        flat = Spectra(mz.flatten(), intensity.flatten())
        # every spectrum with itself and those after it in its cluster
        number = np.arange(first[-1])
        after = np.repeat(first[1:], sizes) - number
        left = np.repeat(number, after)
        right = left + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        found = measure(flat, left, right, tolerance)
        apart = left != right
        sums = np.bincount(left, found, len(number)) + np.bincount(right[apart], found[apart], len(number))
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sums.round(9)))

    lists = lambda name: F.transform(spectra, lambda s: F.coalesce(s[name].cast("array<double>"), F.array().cast("array<double>")))
    return summed(lists("mz_array"), lists("intensity_array"))


#: Mass of the residue that each byte stands for; NaN if none.
_MASS = np.full(256, np.nan)
_MASS[[ord(r) for r in RESIDUES]] = list(RESIDUES.values())


def _within(spectrum: np.ndarray, mz: np.ndarray, of: np.ndarray, value: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether any of some values (of spectra `of`) of a peak's own spectrum is within the tolerance of it."""
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    ranked = np.unique(value)
    keys = of * (len(ranked) + 1) + np.searchsorted(ranked, value)
    at = np.searchsorted(keys, spectrum * (len(ranked) + 1) + np.searchsorted(ranked, mz))
    near = np.zeros(len(mz), bool)
    for side in (at - 1, at):  # the last value below the peak, and the first one not below
        there = np.flatnonzero((side >= 0) & (side < len(of)))
        here = side[there]
        near[there] |= (of[here] == spectrum[there]) & (np.abs(mz[there] - value[here]) <= tolerance)
    return near


def explained_shares(sequence: pa.Array, charge: np.ndarray, precursor_mz: np.ndarray, mz: pa.ListArray, intensity: pa.ListArray, tolerance: float) -> np.ndarray:
    """For each spectrum the share of intensity on singly charged b and y ions (and more highly charged, below the precursor's charge) once the precursor's peaks are gone.

    0 without a sequence, peaks or intensity; NaN if a residue's mass isn't
    known. Ladders and peaks of all spectra are worked on together.
    """
    n = len(sequence)
    known = pc.and_(mz.is_valid(), intensity.is_valid()).to_numpy(zero_copy_only=False)
    letters = sequence.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(letters.buffers()[1], np.int64)[letters.offset : letters.offset + n + 1]
    mass = _MASS[np.frombuffer(letters.buffers()[2] or b"", np.uint8)]
    length = np.where(known, np.diff(offsets), 0)
    spectrum = np.repeat(np.arange(n), length)
    place = np.arange(len(spectrum)) - np.repeat(np.cumsum(length) - length, length)
    sums = mass[np.repeat(offsets[:-1], length) + place] if len(mass) else np.zeros(0)
    first = np.cumsum(length) - length
    for k in range(1, int(length.max(initial=0))):  # residue by residue, as a sum from the left is rounded
        at = first[length > k] + k
        sums[at] += sums[at - 1]
    whole = np.zeros(n)
    whole[length > 0] = sums[(first + length - 1)[length > 0]]
    inner = place < length[spectrum] - 1
    fragments = np.concatenate([sums[inner], whole[spectrum[inner]] - sums[inner] + WATER])
    of = np.tile(spectrum[inner], 2)

    def charged(of: np.ndarray, mass: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each mass at charges 1 to `most` of its spectrum."""
        each = np.repeat(np.arange(len(of)), np.maximum(most[of], 0))
        z = np.arange(len(each)) - np.repeat(np.cumsum(np.maximum(most[of], 0)) - np.maximum(most[of], 0), np.maximum(most[of], 0)) + 1
        return of[each], mass[each] / z + PROTON

    ions = charged(of, fragments, np.maximum(charge - 1, 1))
    precursors = charged(np.arange(n), (precursor_mz - PROTON) * charge, charge)
    sizes = np.where(known & (length > 0), pc.fill_null(pc.list_value_length(mz), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    other = np.where(known & (length > 0), pc.fill_null(pc.list_value_length(intensity), 0).to_numpy(zero_copy_only=False), 0)
    if not np.array_equal(sizes, other):
        raise ValueError("m/z and intensity arrays differ in length")
    use = pa.array(sizes > 0)
    values = [a.filter(use).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for a in (mz, intensity)]
    peak_of = np.repeat(np.arange(n), sizes)
    keep = ~_within(peak_of, values[0], *precursors, tolerance)
    peak_of, values = peak_of[keep], [v[keep] for v in values]
    total = np.bincount(peak_of, values[1], n)
    near = _within(peak_of, values[0], *ions, tolerance)
    share = np.bincount(peak_of[near], values[1][near], n) / np.where(total != 0, total, 1)
    return np.where(np.isnan(whole), np.nan, np.where(total != 0, share, 0.0))


def fraction_by(sequence: Column, charge: Column, precursor_mz: Column, mz: Column, intensity: Column, tolerance: float = 0.02) -> Column:
    """explained_shares() of a row's spectrum; null for unknown residues, charges and precursors."""

    @F.arrow_udf(T.DoubleType())
    def share(s: pa.Array, z: pa.Array, p: pa.Array, m: pa.Array, i: pa.Array) -> pa.Array:
        known = pc.and_(z.is_valid(), p.is_valid()).to_numpy(zero_copy_only=False)
        charges, precursors = (v.fill_null(1).to_numpy(zero_copy_only=False) for v in (z, p))
        found = explained_shares(s, charges.astype(np.int64), precursors.astype(float), m, i, tolerance)
        return pa.array(found, mask=np.isnan(found) | ~known)

    return share(sequence, charge.cast("int"), precursor_mz.cast("double"), mz.cast("array<double>"), intensity.cast("array<double>"))
