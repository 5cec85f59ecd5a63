"""What the strategies share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.routing import KEPT, routed, singles
from ..schemas import CONSENSUS
from ..session import written


def as_consensus(df: DataFrame, single: bool) -> DataFrame:
    return df.withColumn("is_singleton", F.lit(single)).select(*CONSENSUS)


class Strategy:
    """Clusters of two and more reduce to one spectrum each; the rest are passed on.

    A cluster row has cluster_accession, usi, pepmass, charge, mz_array,
    intensity_array, posterior_error_probability and the metric's column.
    """

    kept = KEPT

    def consensus(self, rows: DataFrame) -> DataFrame:
        """One row per cluster from routed rows."""
        raise NotImplementedError

    def consensus_spectrum_aggregation(self, clusters: DataFrame, filter_metrics: str = "global_qvalue") -> tuple[DataFrame, DataFrame]:
        """(consensus spectra, spectra alone in their cluster), both in one schema.

        Rows are routed once, when this is called, into a table in the shared
        folder with at most `kept` rows a cluster, from which both are read.
        session.removed() of either deletes it, when both have been used.
        """
        rows = written(routed(clusters, filter_metrics, self.kept), "routed")
        return as_consensus(self.consensus(rows.filter("Nreps > 1")), False), as_consensus(singles(rows), True)


def clusters_of(rows: DataFrame) -> DataFrame:
    """One row per cluster of routed rows: Nreps, least posterior_error_probability, joined usi, and its spectra, ten at most, in order.

    Header and peaks both start here, so that one shuffle serves both.
    """
    fields = F.struct("rk", "usi", "pepmass", "charge", "mz_array", "intensity_array")
    return rows.groupBy("cluster_accession").agg(
        F.first("Nreps").alias("Nreps"), F.min("posterior_error_probability").alias("posterior_error_probability"), F.array_sort(F.collect_list(fields)).alias("spectra")
    ).withColumn("usi", F.array_join("spectra.usi", ";"))


def last_of_each(spectra: Column) -> Column:
    """Of spectra with one usi the last, at its place."""
    n = F.size(spectra)
    return F.filter(spectra, lambda s, i: ~F.array_contains(F.slice(spectra["usi"], i + 2, n), s["usi"]))


def distinct_spectra(clusters: DataFrame) -> DataFrame:
    """A row per cluster and usi: the last one's values, rk of the first."""
    first = F.array_position("spectra.usi", F.col("s.usi")).cast("int")
    return (
        clusters.withColumn("s", F.explode(last_of_each(F.col("spectra"))))
        .select("cluster_accession", "s.usi", F.element_at("spectra.rk", first).alias("rk"), "s.pepmass", "s.charge", "s.mz_array", "s.intensity_array")
    )


def mean(values: Column) -> Column:
    """Mean of an array without its nulls."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda total, v: total + v), F.size(known))


def header(rows: DataFrame) -> DataFrame:
    """Nreps, least posterior_error_probability and the joined usi of each cluster, repeats included."""
    return clusters_of(rows).select("cluster_accession", "Nreps", "posterior_error_probability", "usi")


def listed_peaks(peaks: DataFrame) -> DataFrame:
    """mz_array and intensity_array of each cluster from rows (cluster_accession, mz, intensity)."""
    both = peaks.groupBy("cluster_accession").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    return both.select("cluster_accession", F.col("p.mz").alias("mz_array"), F.col("p.intensity").alias("intensity_array"))


def with_peaks(head: DataFrame, peaks: DataFrame) -> DataFrame:
    """Clusters with their peaks; one left without any has empty arrays."""
    none = F.array().cast("array<double>")
    return head.join(listed_peaks(peaks), "cluster_accession", "left").withColumns({c: F.coalesce(c, none) for c in ("mz_array", "intensity_array")})
