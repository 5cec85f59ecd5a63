"""Peaks of all spectra are cut at gaps and averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.averaging import averaged_peaks, cut_peaks
from ..functions.peaks import PROTON, neutral_mass
from .common import Strategy, clusters_of, mean

PRECURSORS = ("naive_average", "neutral_average", "lower_median")
AVERAGES = ("naive", "weighted")


class AverageSpectrumStrategy(Strategy):
    """merge_tail: with two gaps and more, what is on both sides of the last one is one segment (the established output)."""

    def __init__(self, diff_thresh: float = 0.01, dyn_range: float = 1000.0, min_fraction: float = 0.5, pepmass: str = "lower_median", msms_avg: str = "weighted", merge_tail: bool = True):
        for value, known in ((pepmass, PRECURSORS), (msms_avg, AVERAGES)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")
        if not dyn_range:
            raise ValueError("dyn_range must not be 0")
        self.gap, self.range, self.fraction = float(diff_thresh), float(dyn_range), float(min_fraction)
        self.pepmass, self.msms_avg, self.merge_tail = pepmass, msms_avg, merge_tail

    def segments(self, rows: DataFrame) -> DataFrame:
        """(cluster_accession, segment, mz, intensity) for every peak of a cluster's spectra. Without a gap all is segment 0."""
        cut = cut_peaks(F.col("spectra"), self.gap, self.merge_tail)
        return clusters_of(rows).select("cluster_accession", F.inline(cut)).select("cluster_accession", "mz", "intensity", "segment")

    def averaged(self) -> Column:
        """mz_array and intensity_array of a cluster's segments with enough peaks and within the dynamic range. A segment without intensity has a null m/z."""
        return averaged_peaks(F.col("spectra"), self.gap, self.fraction, self.range, self.msms_avg == "weighted", self.merge_tail)

    def precursor(self) -> tuple[Column, Column]:
        """Precursor m/z and charge from a cluster's spectra, in the chosen way."""
        charges = F.col("spectra.charge")
        masses = F.transform("spectra", lambda s: neutral_mass(s["pepmass"], s["charge"]))
        if self.pepmass == "naive_average":
            mixed = F.raise_error(F.lit("spectra of a cluster differ in charge: their precursor m/z can't be averaged")).cast("int")
            return mean(F.col("spectra.pepmass")), F.when(F.array_min(charges) != F.array_max(charges), mixed).otherwise(F.array_min(charges))
        if self.pepmass == "neutral_average":
            z = F.bround(mean(charges)).cast("int")
            return (mean(masses) + z * PROTON) / z, z
        by_mass = F.array_sort(F.transform("spectra", lambda s: F.struct(neutral_mass(s["pepmass"], s["charge"]).alias("m"), s["rk"].alias("rk"), s["charge"].alias("z"))))
        middle = F.element_at(by_mass, (F.floor((F.size("spectra") - 1) / 2) + 1).cast("int"))
        return (middle["m"] + middle["z"] * PROTON) / middle["z"], middle["z"]

    def precursors(self, rows: DataFrame) -> DataFrame:
        """Each cluster's header with pepmass and charge."""
        pepmass, charge = self.precursor()
        return clusters_of(rows).select("cluster_accession", "Nreps", "posterior_error_probability", "usi", pepmass.alias("pepmass"), charge.alias("charge"))

    def consensus(self, rows: DataFrame) -> DataFrame:
        """Header and peaks of a cluster from one row: one shuffle, and no row for a peak."""
        pepmass, charge = self.precursor()
        clusters = clusters_of(rows).withColumns({"pepmass": pepmass, "charge": charge, "averaged": self.averaged()})
        return clusters.withColumns({c: F.col("averaged")[c] for c in ("mz_array", "intensity_array")}).drop("spectra", "averaged")
