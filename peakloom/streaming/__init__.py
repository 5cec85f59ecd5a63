"""Spectra that arrive over time: the row-wise MGF text as a Structured Streaming source's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import SPECTRUM


def stream_blocks(spark: SparkSession, path: str, dataset: str, files_per_trigger: int = 16) -> DataFrame:
    """A streaming frame (usi, block) of the Parquet files that appear in path. Positions in MGF files need whole files and stay with convert()."""
    rows = spark.readStream.schema(SPECTRUM).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    usi = text.usi(F.lit(dataset), *(F.col(c) for c in ("reference_file_name", "scan_number", "sequence", "charge")))
    block = text.mgf_block(usi, F.col("exp_mass_to_charge"), F.col("charge"), F.col("mz_array"), F.col("intensity_array"))
    return rows.select(usi.alias("usi"), block.alias("block"))
