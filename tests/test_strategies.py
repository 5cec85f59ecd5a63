"""Hand-worked clusters for every strategy, and plain versions of the rules."""

from __future__ import annotations

import math
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakloom.functions.similarity import RESIDUES, WATER, Spectra, _lowest_free, dot_products, explained_shares, fraction_by, similarity, similarity_sums
from peakloom.operators.routing import cluster_counts, routed, singles, sized_top
from peakloom.plans import AverageSpectrumStrategy, BestSpectrumStrategy, BinningStrategy, MostSimilarStrategy, strategy
from peakloom.schemas import CONSENSUS

SCHEMA = (
    "cluster_accession string, usi string, pepmass double, charge int, mz_array array<double>, intensity_array array<double>,"
    " posterior_error_probability double, global_qvalue double"
)


def cluster(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def row(c, usi, mz=(150.0,), intensity=(1.0,), pepmass=500.0, charge=2, pep=0.1, q=0.01):
    return (c, usi, pepmass, charge, None if mz is None else list(mz), None if intensity is None else list(intensity), pep, q)


def by_cluster(df):
    return {r.cluster_accession: r for r in df.collect()}


def test_routing_by_size(spark):
    sizes = {"a": 1, "b": 2, "c": 10, "d": 11}
    df = cluster(spark, *(row(c, f"u{i:02d}", q=i / 100) for c, n in sizes.items() for i in range(n)), row(None, "x"))
    assert {r.cluster_accession: r.Nreps for r in cluster_counts(df).collect()} == sizes
    kept = routed(df).groupBy("cluster_accession").agg(F.count("*").alias("n"), F.max("Nreps").alias("r"), F.max("usi").alias("last"))
    assert {r.cluster_accession: (r.n, r.r, r["last"]) for r in kept.collect()} == {"a": (1, 1, "u00"), "b": (2, 2, "u01"), "c": (10, 10, "u09"), "d": (10, 11, "u09")}
    assert [r.cluster_accession for r in singles(routed(df)).collect()] == ["a"]


def test_ties_nulls_and_nan_rank_last(spark):
    df = cluster(spark, row("a", "u3", q=0.5), row("a", "u2", q=0.5), row("a", "u1", q=None), row("a", "u0", q=float("nan")))
    assert [r.usi for r in sized_top(df, "global_qvalue", 3).orderBy(F.col("global_qvalue"), "usi").collect()] == ["u2", "u3", "u0"]


@pytest.mark.parametrize("held", [1, 7, 1 << 15])
def test_top_rows_and_sizes_in_one_pass(spark, tmp_path, held):
    rng = np.random.default_rng(3)
    rows = [row(f"c{min(rng.integers(0, 40), rng.integers(0, 40))}", f"u{i:04d}", q=[None, float("nan"), *rng.integers(0, 6, 6).astype(float).tolist()][rng.integers(0, 8)]) for i in range(900)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    place = lambda r: (r[7] is None, r[7] is not None and math.isnan(r[7]), 0.0 if r[7] is None or math.isnan(r[7]) else r[7], r[1])
    groups = defaultdict(list)
    for r in sorted(rows, key=place):
        groups[r[0]].append(r[1])
    found = sized_top(df, "global_qvalue", 4, held_rows=held)
    assert sorted((r.cluster_accession, r.usi, r.Nreps) for r in found.collect()) == sorted((c, u, len(us)) for c, us in groups.items() for u in us[:4])
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1  # the rows are read once


def test_rank_column_decides_order(spark):
    df = cluster(spark, row("a", "u1", q=0.1), row("a", "u2", q=0.2)).withColumn("rank", F.when(F.col("usi") == "u2", 0).otherwise(1))
    assert {r.usi: r.rk for r in routed(df).collect()} == {"u2": 1, "u1": 2}


@pytest.mark.parametrize("name", ["best", "most", "bin", "average"])
def test_one_schema_and_empty_input(spark, name):
    for part in strategy(name).consensus_spectrum_aggregation(spark.createDataFrame([], SCHEMA)):
        assert tuple(part.columns) == CONSENSUS
        assert part.count() == 0


@pytest.mark.parametrize("name", ["best", "most", "bin", "average"])
def test_every_cluster_comes_out_once(spark, name):
    df = cluster(spark, *(row(f"c{i % 7}", f"u{i}", q=i / 50, mz=(100 + i / 64, 200.0)[:2], intensity=(1.0, 2.0)) for i in range(23)), row("one", "solo"))
    many, one = strategy(name).consensus_spectrum_aggregation(df)
    assert many.select("cluster_accession").distinct().count() == many.count() == 7
    assert [r.cluster_accession for r in one.collect()] == ["one"]
    assert many.agg(F.sum("Nreps")).first()[0] == 23


def test_best_prefers_metric_then_usi(spark):
    df = cluster(spark, row("a", "u2", q=0.1, pep=0.9), row("a", "u1", q=0.1, pep=0.8), row("a", "u0", q=0.3, pep=0.0))
    assert by_cluster(BestSpectrumStrategy().consensus_spectrum_aggregation(df)[0])["a"].usi == "u1"
    assert by_cluster(BestSpectrumStrategy().consensus_spectrum_aggregation(df, "posterior_error_probability")[0])["a"].usi == "u0"


def test_unknown_names_fail_first():
    for bad in (lambda: strategy("none"), lambda: MostSimilarStrategy(sim="none"), lambda: AverageSpectrumStrategy(pepmass="none"), lambda: BinningStrategy(peak_quorum=0)):
        with pytest.raises(ValueError):
            bad()


def test_bin_last_peak_of_a_spectrum_counts(spark):
    df = cluster(spark, row("a", "u1", mz=(150.001, 150.002), intensity=(5.0, 7.0)), row("a", "u2", mz=(150.003,), intensity=(9.0,), q=0.02))
    r = by_cluster(BinningStrategy().consensus_spectrum_aggregation(df)[0])["a"]
    assert r.intensity_array == [8.0]
    assert r.mz_array == pytest.approx([150.0025])


def test_bin_edges_of_the_range(spark):
    df = cluster(spark, row("a", "u1", mz=(99.99, 100.0, 2000.0), intensity=(1.0, 2.0, 3.0)), row("a", "u2", mz=(100.0,), intensity=(4.0,), q=0.2))
    assert by_cluster(BinningStrategy().consensus_spectrum_aggregation(df)[0])["a"].mz_array == [100.0]


def test_bin_split_peak_merges_and_chain_loses_the_third(spark):
    s = BinningStrategy(min_mz=0, max_mz=100, bin_size=1.0, peak_quorum=0.1, edge_case_threshold=0.8)
    bins = spark.createDataFrame([("a", 10, 1, 1.0, 10.5), ("a", 11, 1, 2.0, 11.1), ("a", 12, 1, 4.0, 12.9)], "cluster_accession string, bin long, n long, intensity double, mz double")
    assert [(r.bin, r.n, r.intensity) for r in s.merged(bins).orderBy("bin").collect()] == [(10, 2, 3.0), (12, 1, 4.0)]
    chain = spark.createDataFrame([("a", 10, 1, 1.0, 10.5), ("a", 11, 1, 2.0, 11.1), ("a", 12, 1, 4.0, 12.0 - 0.2)], bins.schema)
    # means 10.5, 11.1 and 11.8 stand for three close neighbours: the third is gone with its intensity
    assert [(r.bin, r.intensity) for r in s.merged(chain).orderBy("bin").collect()] == [(10, 3.0)]


def test_duplicate_usi_keeps_last_value_at_first_place(spark):
    df = cluster(spark, row("a", "u1", q=0.1, pepmass=100.0, charge=2), row("a", "u2", q=0.2, pepmass=300.0, charge=3), row("a", "u1", q=0.3, pepmass=200.0, charge=4))
    r = by_cluster(BinningStrategy().precursors(routed(df)))["a"]
    assert (r.pepmass, r.charge) == (250.0, 4)
    consensus = by_cluster(BinningStrategy().consensus_spectrum_aggregation(df)[0])["a"]
    assert (consensus.usi, consensus.Nreps) == ("u1;u2;u1", 3)


@pytest.mark.parametrize(
    ("mz", "segments"),
    [((150.0, 150.001, 150.002), {0: 3}), ((150.0, 150.001, 160.0), {0: 2, 1: 1}), ((150.0, 160.0, 170.0), {0: 1, 1: 2}), ((150.0, 160.0, 170.0, 180.0), {0: 1, 1: 1, 2: 2})],
)
def test_average_segments_without_and_with_gaps(spark, mz, segments):
    rows = routed(cluster(spark, row("a", "u1", mz=mz, intensity=[1.0] * len(mz)), row("b", "u2", mz=(1.0,))))
    found = AverageSpectrumStrategy().segments(rows.filter("cluster_accession = 'a'"))
    assert {r.segment: r["count"] for r in found.groupBy("segment").count().collect()} == segments


def test_average_tail_can_stay_apart(spark):
    rows = routed(cluster(spark, row("a", "u1", mz=(150.0, 160.0, 170.0), intensity=(1.0, 1.0, 1.0))))
    assert AverageSpectrumStrategy(merge_tail=False).segments(rows).agg(F.max("segment")).first()[0] == 2


def test_average_without_intensity_has_no_mz(spark):
    df = cluster(spark, row("a", "u1", mz=(150.0,), intensity=(0.0,)), row("a", "u2", mz=(150.0,), intensity=(0.0,)))
    assert by_cluster(AverageSpectrumStrategy().consensus_spectrum_aggregation(df)[0])["a"].mz_array == [None]


def test_precursor_modes(spark):
    rows = routed(cluster(spark, *(row("a", f"u{i}", pepmass=400.0 + 100 * i, charge=z, q=i / 10) for i, z in enumerate((2, 3, 2, 3)))))
    assert by_cluster(AverageSpectrumStrategy(pepmass="neutral_average").precursors(rows))["a"].charge == 2  # 2.5 rounds to even
    low = by_cluster(AverageSpectrumStrategy(pepmass="lower_median").precursors(rows))["a"]
    assert (round(low.pepmass, 6), low.charge) == (600.0, 2)  # masses 798, 1497, 1198, 2097: the second of four
    with pytest.raises(Exception, match="differ in charge"):
        AverageSpectrumStrategy(pepmass="naive_average").precursors(rows).collect()


def test_most_similar_takes_the_first_of_equals(spark):
    df = cluster(spark, row("a", "u1", q=0.2), row("a", "u0", q=0.3), row("a", "u2", mz=(900.0,), q=0.1))
    assert by_cluster(MostSimilarStrategy().consensus_spectrum_aggregation(df)[0])["a"].usi == "u1"


def product(a, x, b, y, tol=0.02):
    """dot_products() of two lists with their lengths put back."""
    spectra = Spectra(pa.array([a, b], pa.list_(pa.float64())), pa.array([x, y], pa.list_(pa.float64())))
    return dot_products(spectra, np.array([0]), np.array([1]), tol)[0] * math.hypot(*x) * math.hypot(*y)


def lowest_free(a, x, b, y, tol=0.02):
    """The rule itself: a peak at a time, from the set of free ones."""
    free, total = set(range(len(b))), 0.0
    for m, w in sorted(zip(a, x, strict=True)):
        near = [k for k in free if abs(m - b[k]) <= tol]
        if near:
            k = min(near, key=lambda k: b[k])
            free.remove(k)
            total += w * y[k]
    return total


@given(st.lists(st.integers(0, 60), max_size=12, unique=True), st.lists(st.integers(0, 60), max_size=12, unique=True), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_matching_against_the_rule(left, right, reach):
    a, b = ([100 + k / 128 for k in v] for v in (left, right))
    x, y = ([1.0 + k % 7 for k in v] for v in (left, right))
    assert product(a, x, b, y, reach / 128) == pytest.approx(lowest_free(a, x, b, y, reach / 128))


def test_matching_many_pairs_at_once():
    rng = np.random.default_rng(3)
    lists = [100 + np.cumsum(rng.random(rng.integers(0, 40)) * step) for step in (0.005, 0.02, 0.5) for _ in range(15)]
    weights = [rng.random(len(a)) for a in lists]
    spectra = Spectra(pa.array(lists, pa.list_(pa.float64())), pa.array(weights, pa.list_(pa.float64())))
    left, right = (v.ravel() for v in np.meshgrid(np.arange(45), np.arange(45)))
    unit = [w / max(np.linalg.norm(w), 1e-300) for w in weights]
    want = [lowest_free(lists[i], unit[i], lists[j], unit[j]) for i, j in zip(left, right, strict=True)]
    assert dot_products(spectra, left, right, 0.02) == pytest.approx(want)


def test_matching_at_the_edge_of_the_tolerance():
    for x in np.random.default_rng(1).random(500) * 1000:
        for y in (x + 0.02, x - 0.02, np.nextafter(x + 0.02, 0), np.nextafter(x + 0.02, 2000)):
            assert product([x], [1.0], [y], [1.0]) == pytest.approx(float(abs(x - y) <= 0.02))


def test_similarity_columns_take_nulls_unsorted_and_empty_lists(spark):
    df = spark.createDataFrame([(1, [200.0, 100.0], [4.0, 3.0], [100.0], [5.0]), (2, None, None, [100.0], [1.0]), (3, [], [], [], [])], "i int, a array<double>, x array<double>, b array<double>, y array<double>")
    assert [r[0] for r in df.select("i", similarity(*(F.col(c) for c in "axby")).alias("s")).orderBy("i").select("s").collect()] == [0.6, None, 0.0]
    spectra = F.array(*(F.struct(F.col(m).alias("mz_array"), F.col(i).alias("intensity_array")) for m, i in ("ax", "by")))
    assert [r[0] for r in df.select("i", similarity_sums(spectra).alias("s")).orderBy("i").select("s").collect()] == [[1.6, 1.6], [0.0, 1.0], [0.0, 0.0]]
    with pytest.raises(Exception, match="differ in length"):
        df.select(similarity(F.col("a"), F.col("b"), F.col("a"), F.col("x"))).collect()


def free_places(low, high):
    """Each taker in turn goes through the places from its low on and takes the first that nobody has."""
    taken, out = set(), []
    for a, b in zip(low, high, strict=True):
        out.append(next((x for x in range(a, b) if x not in taken), -1))
        taken.add(out[-1])
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 5)), max_size=40))
def test_places_are_taken_in_order(steps):
    low = np.cumsum([a for a, _ in steps], dtype=np.int64)
    high = np.maximum.accumulate(np.array([x + b for x, (_, b) in zip(low.tolist(), steps, strict=True)], np.int64)) if steps else low
    assert _lowest_free(low, high).tolist() == free_places(low.tolist(), high.tolist())


def test_matching_close_peaks_takes_time_in_proportion():
    def seconds(n):
        rng = np.random.default_rng(n)
        mz = [np.sort(rng.random(n)) * n / 2000 + 100 for _ in range(2)]  # some 80 peaks within the tolerance of each
        lists = [pa.array([m.tolist() for m in mz], pa.list_(pa.float64())), pa.array([[1.0] * n] * 2, pa.list_(pa.float64()))]
        start = time.perf_counter()
        dot_products(Spectra(*lists), np.array([0]), np.array([1]), 0.02)
        return time.perf_counter() - start

    assert min(seconds(80_000) for _ in range(3)) < 20 * min(seconds(10_000) for _ in range(3)) + 0.2


def share(sequence, charge, precursor, mz, intensity):
    kind = pa.list_(pa.float64())
    return explained_shares(pa.array([sequence], pa.string()), np.array([charge]), np.array([precursor]), pa.array([mz], kind), pa.array([intensity], kind), 0.02)[0]


def test_explained_share_of_a_dipeptide():
    b1, y1 = 57.02146 + 1.00727646677, 71.03711 + 18.01056 + 1.00727646677
    assert share("GA", 1, 147.08, [b1, y1, 120.0], [1.0, 2.0, 1.0]) == pytest.approx(0.75)
    assert share(None, 1, 147.08, [b1], [1.0]) == 0.0
    assert share("GA", 1, 147.08, None, None) == 0.0
    assert math.isnan(share("GXA", 1, 147.08, [b1], [1.0]))  # X has no mass


def test_explained_share_of_higher_charges_and_without_the_precursor():
    mass = 57.02146 + 71.03711 + 128.09496 + 18.01056  # GAK
    b2, precursor = 57.02146 + 71.03711, (mass + 3 * 1.00727646677) / 3
    mz = [b2 / 2 + 1.00727646677, b2 + 1.00727646677, mass / 2 + 1.00727646677, 500.0]
    # at charge 3 doubly charged ions count, and the precursor's peak at charge 2 is gone
    assert share("GAK", 3, precursor, mz, [1.0, 2.0, 50.0, 3.0]) == pytest.approx(0.5)
    assert share("GAK", 2, (mass + 2 * 1.00727646677) / 2, mz, [1.0, 2.0, 50.0, 3.0]) == pytest.approx(2 / 6)


def explained_by_rule(sequence, charge, precursor, mz, intensity):
    """One ladder step and one peak at a time."""
    if not sequence or mz is None or intensity is None:
        return 0.0
    proton, ions, total, part = 1.00727646677, [], 0.0, 0.0
    for cut in range(1, len(sequence)):
        for mass in (sum(RESIDUES[r] for r in sequence[:cut]), sum(RESIDUES[r] for r in sequence[cut:]) + WATER):
            ions += [mass / z + proton for z in range(1, max(2, charge))]
    neutral = (precursor - proton) * charge
    for m, i in zip(mz, intensity, strict=True):
        if all(abs(m - (neutral / z + proton)) > 0.02 for z in range(1, charge + 1)):
            total += i
            part += i * any(abs(m - ion) <= 0.02 for ion in ions)
    return part / total if total else 0.0


def test_explained_shares_of_a_batch_against_the_rule(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        sequence, charge = "".join(rng.choice(list("GASPVTLKR"), rng.integers(0, 12))), int(rng.integers(1, 5))
        mz = None if k % 9 == 0 else sorted((rng.random(rng.integers(0, 60)) * 900 + 50).tolist() + [57.02146 + 1.00727646677])
        rows.append((k, sequence or None, charge, 300.0 + k, mz, None if mz is None else (rng.integers(0, 9, len(mz)) * 1.0).tolist()))
    rows += [(60, "GUA", 2, 300.0, [100.0], [1.0]), (61, "GA", None, 300.0, [100.0], [1.0]), (62, "GA", 2, 300.0, [], [])]
    df = spark.createDataFrame(rows, "k int, s string, z int, p double, m array<double>, i array<double>").repartition(3)
    found = {r.k: r.x for r in df.select("k", fraction_by(*(F.col(c) for c in "szpmi")).alias("x")).collect()}
    assert found == {r[0]: None if r[0] in (60, 61) else pytest.approx(explained_by_rule(*r[1:])) for r in rows}


def binned_by_rule(spectra, low=100.0, high=2000.0, width=0.02, quorum=0.25, threshold=0.5):
    """The rules, a bin at a time, over distinct spectra given as (mz, intensity): {bin: [peaks]} with a spectrum's last peak in each bin."""
    members = defaultdict(list)
    for peaks in spectra:
        last = {math.floor((m - low) / width): (m, i) for m, i in zip(*peaks, strict=True) if low <= m < high}
        for k, peak in last.items():
            members[k].append(peak)
    mean = {k: sum(m for m, _ in v) / len(v) for k, v in members.items()}
    split = {k for k in mean if k + 1 in mean and 0 < mean[k + 1] - mean[k] < width * threshold}
    whole = {k: v + (members[k + 1] if k in split else []) for k, v in members.items() if k - 1 not in split}
    kept = [whole[k] for k in sorted(whole) if len(whole[k]) >= len(spectra) * quorum]
    return [sum(m for m, _ in v) / len(v) for v in kept], [sum(i for _, i in v) / len(v) for v in kept]


def test_bin_against_the_rules(spark):
    rng = np.random.default_rng(5)
    data = {f"c{c}": [(np.sort(rng.choice(3000, 30, replace=False) / 1000 + 100), rng.integers(1, 50, 30).astype(float)) for _ in range(rng.integers(2, 9))] for c in range(6)}
    df = cluster(spark, *(row(c, f"{c}u{j}", mz=m.tolist(), intensity=i.tolist(), q=j / 10) for c, s in data.items() for j, (m, i) in enumerate(s)))
    found = by_cluster(BinningStrategy().consensus_spectrum_aggregation(df)[0])
    for c, spectra in data.items():
        mz, intensity = binned_by_rule(spectra)
        assert found[c].mz_array == pytest.approx(mz)
        assert found[c].intensity_array == pytest.approx(intensity)
