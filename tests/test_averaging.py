"""Averaged peaks of many clusters at once against the rules in plain Python, nulls and NaN included."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakloom.functions import averaging
from peakloom.functions.averaging import averaged, cut
from peakloom.operators.routing import routed
from peakloom.plans import AverageSpectrumStrategy


def order(value):
    return (value is not None, value is not None and math.isnan(value), 0.0 if value is None or math.isnan(value) else value)


def segments(spectra, gap, merge_tail) -> list[list]:
    """Peaks (m/z, intensity) of each segment."""
    peaks = sorted((p for m, i in spectra if m is not None and i is not None for p in zip(m, i, strict=True)), key=lambda p: (order(p[0]), order(p[1])))
    found = []
    for k, (m, i) in enumerate(peaks):
        before = peaks[k - 1][0] if k else None
        if not k or (m is not None and before is not None and not m - before < gap):
            found.append([])
        found[-1].append((m, i))
    if merge_tail and len(found) > 2:
        found[-2:] = [found[-2] + found[-1]]
    return found


def plain(spectra, gap=0.01, fraction=0.5, dyn_range=1000.0, weighted=True, merge_tail=True) -> list[tuple]:
    kept = []
    for s in segments(spectra, gap, merge_tail):
        intensities, both, mzs = [i for _, i in s if i is not None], [(m, i) for m, i in s if m is not None and i is not None], [m for m, _ in s if m is not None]
        if len(s) >= len(spectra) * fraction and intensities:
            total = sum(intensities)
            mz = (sum(m * i for m, i in both) / total if both and total != 0 else None) if weighted else (sum(mzs) / len(mzs) if mzs else None)
            kept.append((mz, total / len(spectra)))
    most = max((i for _, i in kept), key=order, default=0.0)
    return sorted((p for p in kept if math.isnan(p[1]) or p[1] >= most / dyn_range), key=lambda p: (order(p[0]), order(p[1])))


def clusters(rng, n, odd=0.1):
    """Spectra, as (m/z, intensity) lists, of n clusters; some lists and values missing, repeated or no numbers."""
    some = lambda v: rng.choice([None, math.nan]) if rng.random() < odd / 5 else v
    made = []
    for _ in range(n):
        spectra = []
        for _ in range(rng.integers(1, 11)):
            k = rng.integers(0, 6)
            mz, intensity = [some(float(100 + rng.integers(0, 40) / 128)) for _ in range(k)], [some(float(rng.integers(0, 4) * 16 ** rng.integers(0, 4))) for _ in range(k)]
            spectra.append((None if rng.random() < odd / 3 else mz, None if rng.random() < odd / 3 else intensity))
        made.append(spectra)
    return made


def lists(made):
    return [pa.array([[s[k] for s in c] for c in made], pa.list_(pa.list_(pa.float64()))) for k in (0, 1)]


def same(found, expected):
    flat = lambda peaks: [v for p in peaks for v in p]
    assert len(found) == len(expected)
    for f, e in zip(found, expected, strict=True):
        assert len(f) == len(e) and all((a is None) == (b is None) and (a is None or a == pytest.approx(b, nan_ok=True)) for a, b in zip(flat(f), flat(e), strict=True)), (f, e)


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("merge_tail", [True, False])
@pytest.mark.parametrize("odd", [0, 0.1, 1.0])
def test_batches_follow_the_rules(weighted, merge_tail, odd):
    made = clusters(np.random.default_rng(5), 300, odd)
    pieces = lists(made)
    for start in (0, 40):  # a slice of a batch too
        mz, intensity = (p.slice(start) for p in pieces)
        found = averaged(cut(mz, intensity, 0.01, merge_tail), np.array([len(c) for c in made[start:]]), 0.5, 1000.0, weighted).to_pylist()
        same([list(zip(r["mz_array"], r["intensity_array"], strict=True)) for r in found], [plain(c, weighted=weighted, merge_tail=merge_tail) for c in made[start:]])


@pytest.mark.parametrize("other", [(math.nan, None), (None, math.nan), (None, None), (None, 4.0)])
def test_a_null_takes_its_peak_out_of_weighted_sums(other):
    made = [[([100.0, 150.0, other[0]], [1.0, 2.0, other[1]])]]
    found = averaged(cut(*lists(made), 0.01, True), np.array([1]), 0.5, 1000.0, True).to_pylist()[0]
    same([list(zip(found["mz_array"], found["intensity_array"], strict=True))], [plain(made[0])])


def test_unlike_lengths_are_an_error():
    with pytest.raises(ValueError, match="differ in length"):
        cut(*lists([[([1.0, 2.0], [1.0])]]), 0.01, True)


def test_no_clusters_and_no_peaks():
    for made in ([], [[]], [[([], [])], [(None, [])]]):
        found = averaged(cut(*lists(made), 0.01, True), np.array([len(c) for c in made], int), 0.5, 1000.0, True)
        assert found.to_pylist() == [{"mz_array": [], "intensity_array": []}] * len(made)


def test_averages_need_one_shuffle_and_no_rows_of_peaks(spark, monkeypatch):
    made = clusters(np.random.default_rng(7), 60)
    rows = [(f"c{k:02d}", f"u{k:02d}{j}", 500.0, 2, m, i, 0.1, j / 100) for k, c in enumerate(made) for j, (m, i) in enumerate(c)]
    schema = "cluster_accession string, usi string, pepmass double, charge int, mz_array array<double>, intensity_array array<double>, posterior_error_probability double, global_qvalue double"
    consensus, _ = AverageSpectrumStrategy().consensus_spectrum_aggregation(spark.createDataFrame(rows, schema))
    plan = consensus._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange"), plan.count("Window"), plan.count("Generate"), plan.count("Join")) == (1, 0, 0, 0)
    found = {r.cluster_accession: list(zip(r.mz_array, r.intensity_array, strict=True)) for r in consensus.collect()}
    expected = {f"c{k:02d}": plain(c) for k, c in enumerate(made) if len(c) > 1}
    same([found[c] for c in sorted(found)], [expected[c] for c in sorted(expected)])
    cuts = AverageSpectrumStrategy().segments(routed(spark.createDataFrame(rows, schema))).groupBy("cluster_accession", "segment").agg(F.count(F.lit(1)).alias("n")).collect()
    counted = {(f"c{k:02d}", n): len(s) for k, c in enumerate(made) for n, s in enumerate(segments(c, 0.01, True))}
    assert {(r.cluster_accession, r.segment): r.n for r in cuts} == counted


def test_batches_are_worked_on_in_pieces(monkeypatch):
    made = clusters(np.random.default_rng(9), 50)
    whole = list(averaging._pieces(*lists(made)))
    monkeypatch.setattr(averaging, "PEAKS_AT_ONCE", 20)
    pieces = list(averaging._pieces(*lists(made)))
    assert (len(whole), len(pieces) > 10) == (1, True)
    for k in (0, 1):
        assert str(pa.concat_arrays([p[k] for p in pieces]).to_pylist()) == str(lists(made)[k].to_pylist())  # NaN reads nan
