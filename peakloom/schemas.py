"""Schemas of what is read and returned."""

from __future__ import annotations

from pyspark.sql import types as T

_ARRAY = T.ArrayType(T.DoubleType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


#: Identified spectra, as far as the MGF layout needs them.
SPECTRUM = _struct(
    reference_file_name=T.StringType(), scan_number=T.StringType(), sequence=T.StringType(), mz_array=_ARRAY, intensity_array=_ARRAY,
    charge=T.IntegerType(), exp_mass_to_charge=T.DoubleType(),
)
#: The same with the two scores that consensus spectra rank by.
SCORED_SPECTRUM = T.StructType([*SPECTRUM, *_struct(posterior_error_probability=T.DoubleType(), global_qvalue=T.DoubleType())])
#: Cluster assignments, a headerless table.
ASSIGNMENT = _struct(mgf_path=T.StringType(), mgf_order=T.LongType(), cluster_accession=T.StringType())
#: What all strategies return.
CONSENSUS = (
    "cluster_accession", "pepmass", "Nreps", "posterior_error_probability", "usi", "charge", "mz_array", "intensity_array", "is_singleton",
)
#: What a cluster reduces to in SQL's table functions.
REDUCED = _struct(
    cluster_accession=T.StringType(), usi=T.StringType(), pepmass=T.DoubleType(), charge=T.IntegerType(), Nreps=T.LongType(), posterior_error_probability=T.DoubleType(),
    mz_array=_ARRAY, intensity_array=_ARRAY,
)
