"""Spectra and cluster assignments from files."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import ASSIGNMENT, SCORED_SPECTRUM, SPECTRUM

#: Only Parquet files right inside a directory of this name hold spectra.
SPECTRA_DIRECTORY = "parquet_files"
#: The columns of a sample sheet that are used.
SAMPLE_COLUMNS = ("comment[data file]", "characteristics[organism]", "comment[instrument]")


def find_spectra(spark: SparkSession, folder: str) -> list[str]:
    """Parquet files right inside a directory named parquet_files anywhere below a folder, in order of paths, with characters of patterns escaped."""
    listed = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").format("binaryFile").load(folder)
    found = listed.filter(F.col("path").rlike(f"/{SPECTRA_DIRECTORY}/[^/]+$")).select("path").collect()
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in sorted(found)]


def read_spectra(spark: SparkSession, path: str, scored: bool = False, discover: bool = False) -> DataFrame:
    """Spectra of all Parquet files at path, with file_path, file_stem, dataset and row_index, their position in the file.

    With discover, files are sought in all directories below path first, and
    only those in one named parquet_files are ever opened; none is an error.
    Numbers of other widths are cast.
    """
    schema = SCORED_SPECTRUM if scored else SPECTRUM
    paths = find_spectra(spark, path) if discover else [path]
    if not paths:
        raise FileNotFoundError(f"no Parquet file in a directory {SPECTRA_DIRECTORY} below {path}")
    rows = spark.read.parquet(*paths)
    name = F.col("_metadata.file_name")
    return rows.select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema),
        F.col("_metadata.file_path").alias("file_path"), text.stem(name).alias("file_stem"), text.dataset_id(name).alias("dataset"), F.col("_metadata.row_index").alias("row_index"),
    )


def with_usi(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("usi", text.usi(*(F.col(c) for c in ("dataset", "reference_file_name", "scan_number", "sequence", "charge"))))


def find_sample_sheet(spark: SparkSession, folder: str) -> str:
    """The first *.sdrf.tsv below a folder in order of paths."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sdrf.tsv").format("binaryFile").load(folder).agg(F.min("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no *.sdrf.tsv below {folder}")
    return found


def sample_table(rows: DataFrame) -> DataFrame:
    """(reference_file_name, organism, instrument) from (line, data_file, organism, instrument): the last line of a file counts."""
    parsed = rows.select("line", text.stem(F.col("data_file")).alias("reference_file_name"), "organism", text.instrument_name(F.col("instrument")).alias("instrument"))
    last = F.row_number().over(Window.partitionBy("reference_file_name").orderBy(F.desc("line")))
    return parsed.withColumn("_n", last).filter("_n = 1").select("reference_file_name", "organism", "instrument")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_table() of one sample sheet, a tab-separated file with a header; a sheet is small and read whole."""
    content = spark.read.text(path, wholetext=True).first()
    rows = list(csv.reader((content[0] if content else "").splitlines(), delimiter="\t"))
    missing = [c for c in SAMPLE_COLUMNS if c not in (rows[0] if rows else [])]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    at = [rows[0].index(c) for c in SAMPLE_COLUMNS]
    listed = [(i, *(r[j] for j in at)) for i, r in enumerate(rows[1:]) if len(r) > max(at)]
    return sample_table(spark.createDataFrame(listed, "line long, data_file string, organism string, instrument string"))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Cluster assignments from headerless tab-separated files; lines with an empty field are dropped. rank orders lines by file and place."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", at.alias("rank"))
    fields = F.split("value", "\t")
    rows = lines.select(*(F.nullif(F.get(fields, F.lit(i)), F.lit("")).cast(f.dataType).alias(f.name) for i, f in enumerate(ASSIGNMENT)), "rank")
    return rows.na.drop("any", subset=ASSIGNMENT.names)
