"""Expressions over peak lists and precursors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mass of a proton in Da.
PROTON = 1.00727646677


def peaks(mz: Column, intensity: Column) -> Column:
    """array<struct<mz, intensity>> by ascending m/z; unlike lengths are an error."""
    unlike = F.raise_error(F.lit("m/z and intensity arrays differ in length"))
    zipped = F.zip_with(mz.cast("array<double>"), intensity.cast("array<double>"), lambda m, i: F.struct(m.alias("mz"), i.alias("intensity")))
    return F.when(F.size(mz) != F.size(intensity), unlike).otherwise(F.array_sort(zipped))


def l2_normalised(values: Column) -> Column:
    """Values over their Euclidean norm; of a zero vector, nulls."""
    doubles = values.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(doubles, lambda v: v / F.nullif(norm, F.lit(0.0)))


def bin_index(mz: Column, min_mz: float, bin_size: float) -> Column:
    return F.floor((mz - F.lit(float(min_mz))) / F.lit(float(bin_size))).cast("long")


def bin_count(min_mz: float, max_mz: float, bin_size: float) -> int:
    return math.ceil((max_mz - min_mz) / bin_size)


def neutral_mass(mz: Column, charge: Column) -> Column:
    return mz * charge - charge * F.lit(PROTON)
