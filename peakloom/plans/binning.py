"""Peaks are averaged in bins of fixed width."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.peaks import bin_count, bin_index, peaks
from .common import Strategy, clusters_of, distinct_spectra, last_of_each, mean, with_peaks


class BinningStrategy(Strategy):
    """Only occupied bins exist, as rows. A spectrum counts once per bin, with its last peak there."""

    def __init__(self, min_mz: float = 100.0, max_mz: float = 2000.0, bin_size: float = 0.02, peak_quorum: float = 0.25, edge_case_threshold: float = 0.5):
        if peak_quorum <= 0:
            raise ValueError("peak_quorum must be above 0")
        self.min_mz, self.max_mz, self.bin_size = float(min_mz), float(max_mz), float(bin_size)
        self.quorum, self.threshold = float(peak_quorum), float(edge_case_threshold)

    def binned(self, spectra: DataFrame) -> DataFrame:
        """(cluster_accession, bin, n, intensity, mz): sums over the spectra of a cluster. m/z from min_mz to below max_mz."""
        peak = spectra.select("cluster_accession", "usi", F.posexplode(peaks(F.col("mz_array"), F.col("intensity_array"))).alias("pos", "p"))
        peak = peak.filter((F.col("p.mz") >= self.min_mz) & (F.col("p.mz") < self.max_mz)).withColumn("bin", bin_index(F.col("p.mz"), self.min_mz, self.bin_size))
        last = peak.groupBy("cluster_accession", "usi", "bin").agg(F.max_by("p", "pos").alias("p"))
        return last.groupBy("cluster_accession", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("p.intensity").alias("intensity"), F.sum("p.mz").alias("mz"))

    def merged(self, bins: DataFrame) -> DataFrame:
        """Neighbouring bins whose mean m/z are close become the lower one; every bin that is close to the one before it goes.

        Of three in a row the third is lost with what it held.
        """
        w = Window.partitionBy("cluster_accession").orderBy("bin")
        mean = F.col("mz") / F.col("n")
        gap = F.when(F.lead("bin").over(w) == F.col("bin") + 1, F.lead(mean).over(w) - mean)
        close = (gap > 0) & (gap < F.lit(self.bin_size) * F.lit(self.threshold)) & (F.col("bin") < bin_count(self.min_mz, self.max_mz, self.bin_size) - 2)
        marked = bins.withColumn("close", F.coalesce(close, F.lit(False)))
        gone = F.coalesce(F.lag("close").over(w) & (F.lag("bin").over(w) == F.col("bin") - 1), F.lit(False))
        add = lambda c: F.col(c) + F.when(F.col("close"), F.lead(c).over(w)).otherwise(F.lit(0).cast(bins.schema[c].dataType))
        return marked.select("cluster_accession", "bin", *(add(c).alias(c) for c in ("n", "intensity", "mz")), gone.alias("gone")).filter("not gone").drop("gone")

    def consensus_peaks(self, rows: DataFrame) -> DataFrame:
        """(cluster_accession, mz, intensity): means of the bins that enough spectra have a peak in."""
        clusters = clusters_of(rows)
        spectra = distinct_spectra(clusters)
        sizes = clusters.select("cluster_accession", F.ceil(F.size(F.array_distinct("spectra.usi")) * F.lit(self.quorum)).alias("quorum"))
        kept = self.merged(self.binned(spectra)).join(sizes, "cluster_accession").filter("n >= quorum")
        return kept.select("cluster_accession", (F.col("mz") / F.col("n")).alias("mz"), (F.col("intensity") / F.col("n")).alias("intensity"))

    def precursors(self, rows: DataFrame) -> DataFrame:
        """Each cluster's header with pepmass, the mean precursor m/z, and charge, the first spectrum's."""
        last = last_of_each(F.col("spectra"))
        first = F.filter(last, lambda s: s["usi"] == F.element_at("spectra.usi", 1))
        return clusters_of(rows).select(
            "cluster_accession", "Nreps", "posterior_error_probability", "usi", mean(last["pepmass"]).alias("pepmass"), F.element_at(first, 1)["charge"].alias("charge")
        )

    def consensus(self, rows: DataFrame) -> DataFrame:
        return with_peaks(self.precursors(rows), self.consensus_peaks(rows))
