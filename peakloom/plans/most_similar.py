"""The spectrum most like all others stands for its cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import SIMILARITIES, similarity, similarity_sums
from .common import Strategy, clusters_of, distinct_spectra, last_of_each


class MostSimilarStrategy(Strategy):
    def __init__(self, sim: str = "dot", fragment_mz_tolerance: float = 0.02):
        if sim not in SIMILARITIES:
            raise ValueError(f"unknown similarity {sim!r}; known are {', '.join(SIMILARITIES)}")
        self.sim, self.tolerance = sim, fragment_mz_tolerance

    def winners(self, rows: DataFrame) -> DataFrame:
        """(cluster_accession, usi, total) of each cluster's first spectrum with the greatest summed similarity."""
        lists = clusters_of(rows).select("cluster_accession", "spectra", last_of_each(F.col("spectra")).alias("last"))
        first = lambda s: F.array_position("spectra.usi", s["usi"])
        placed = F.array_sort(F.transform("last", lambda s: F.struct(first(s).alias("place"), s["usi"].alias("usi"), s["mz_array"].alias("mz_array"), s["intensity_array"].alias("intensity_array"))))
        summed = lists.select("cluster_accession", placed.alias("s")).withColumn("sums", similarity_sums(F.col("s"), self.tolerance, self.sim))
        at = F.array_position("sums", F.array_max("sums")).cast("int")
        return summed.select("cluster_accession", F.element_at("s.usi", at).alias("usi"), F.array_max("sums").alias("total"))

    def consensus(self, rows: DataFrame) -> DataFrame:
        """All rows with the winning usi."""
        return rows.join(self.winners(rows).select("cluster_accession", "usi"), ["cluster_accession", "usi"])


def pair_similarities(rows: DataFrame, tolerance: float = 0.02, sim: str = "dot") -> DataFrame:
    """(cluster_accession, usi_a, usi_b, similarity) of the spectra of routed rows, earlier ones left, each with itself too."""
    one = distinct_spectra(clusters_of(rows)).select("cluster_accession", "usi", "rk", "mz_array", "intensity_array")
    a = one.select("cluster_accession", *(F.col(c).alias(f"{c}_a") for c in one.columns[1:]))
    b = one.select("cluster_accession", *(F.col(c).alias(f"{c}_b") for c in one.columns[1:]))
    pairs = a.join(b, "cluster_accession").filter("rk_a <= rk_b")
    measured = similarity(F.col("mz_array_a"), F.col("intensity_array_a"), F.col("mz_array_b"), F.col("intensity_array_b"), tolerance, sim)
    return pairs.select("cluster_accession", "usi_a", "usi_b", measured.alias("similarity"))


def average_similarity(representatives: DataFrame, rows: DataFrame, tolerance: float = 0.02, sim: str = "dot") -> DataFrame:
    """(cluster_accession, avg_dot): mean similarity of a cluster's representative to its rows."""
    rep = representatives.select("cluster_accession", F.col("mz_array").alias("mz_r"), F.col("intensity_array").alias("int_r"))
    both = rows.select("cluster_accession", "mz_array", "intensity_array").join(rep, "cluster_accession")
    measured = both.withColumn("d", similarity(F.col("mz_r"), F.col("int_r"), F.col("mz_array"), F.col("intensity_array"), tolerance, sim))
    return measured.groupBy("cluster_accession").agg(F.avg("d").alias("avg_dot"))
