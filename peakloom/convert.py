"""The two jobs: spectra to MGF files, and clusters to an MSP library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators.layout import BUCKETS, CAPACITY, attach_samples, join_clusters, keep_placed, kept_spectra, place_in_files
from .plans import strategy
from .session import removed, ship_package
from .sources.sinks import write_blocks
from .sources.spectra import find_sample_sheet, read_assignments, read_samples, read_spectra, with_usi

#: Files that a library is dealt to.
FILES = 8
#: What of assigned spectra goes on to strategies.
CLUSTERED = ("cluster_accession", "rank", "usi", "pepmass", "charge", "mz_array", "intensity_array", "posterior_error_probability", "global_qvalue")


def mgf_blocks(placed: DataFrame) -> DataFrame:
    """(file_path, ordinal, block) of spectra with usi, mgf_path and mgf_order."""
    block = text.mgf_block(F.col("usi"), F.col("exp_mass_to_charge"), F.col("charge"), F.col("mz_array"), F.col("intensity_array"))
    return placed.select(F.col("mgf_path").alias("file_path"), F.col("mgf_order").alias("ordinal"), block.alias("block"))


def msp_blocks(consensus: DataFrame, strategy_type: str) -> DataFrame:
    """(is_singleton, cluster_accession, usi, block) of consensus rows."""
    name = text.joined_names(F.col("usi")) if strategy_type in ("bin", "average") else text.library_name(F.col("usi"))
    block = text.msp_block(name, *(F.col(c) for c in ("usi", "pepmass", "Nreps", "posterior_error_probability", "mz_array", "intensity_array")))
    return consensus.select("is_singleton", "cluster_accession", "usi", block.alias("block"))


def convert(spark: SparkSession, parquet_dir: str, output: str | None = None, spectra_capacity: int = CAPACITY, mode: str = "append", keep: str | None = None, buckets: int = BUCKETS) -> None:
    """MGF files organism/instrument/charge<z>/mgf files/<stem>_<k>.mgf below output (mgf_output in parquet_dir by default).

    With keep, a path, the placed spectra stay there in buckets, so that msp() need not lay them out and move them again.
    """
    ship_package(spark)
    samples = read_samples(spark, find_sample_sheet(spark, parquet_dir))
    spectra = attach_samples(with_usi(read_spectra(spark, parquet_dir, scored=keep is not None, discover=True)), samples)
    placed = place_in_files(spectra, spectra_capacity)
    if keep:
        keep_placed(placed, keep, buckets)
        placed = kept_spectra(spark, keep, buckets)
    write_blocks(mgf_blocks(placed), output or f"{parquet_dir}/mgf_output", "mgf", mode)


def clustered(spark: SparkSession, path_parquet: str, path_sdrf: str, path_cluster_tsv: str, spectra_capacity: int = CAPACITY, kept: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The assigned spectra, as strategies want them. An assignment to a place without a spectrum (as under another capacity) is an error.

    With kept, where convert() kept them, spectra are read from there and only assignments move.
    """
    if kept:
        placed = kept_spectra(spark, kept, buckets)
    else:
        spectra = attach_samples(with_usi(read_spectra(spark, path_parquet, scored=True)), read_samples(spark, path_sdrf))
        placed = place_in_files(spectra, spectra_capacity)
    placed = placed.withColumnRenamed("exp_mass_to_charge", "pepmass")
    missing = F.raise_error(F.concat(F.lit("no spectrum at "), "mgf_path", F.lit(" "), F.col("mgf_order").cast("string"))).cast("string")
    joined = join_clusters(read_assignments(spark, path_cluster_tsv), placed.withColumn("found", F.lit(True)))
    return joined.withColumn("usi", F.when(F.col("found").isNull(), missing).otherwise(F.col("usi"))).select(*CLUSTERED)


def msp(spark: SparkSession, path_parquet: str, path_sdrf: str, path_cluster_tsv: str, output: str, strategy_type: str = "best", mode: str = "append", files: int = FILES, spectra_capacity: int = CAPACITY, kept: str | None = None, **options) -> None:
    """Reduce clusters to a library of consensus spectra, then single ones.

    Clusters are dealt to files <stem>_<k>.msp; with files=1 the file output holds all, which is one task's work.
    """
    chosen = strategy(strategy_type, **options)
    ship_package(spark)
    clusters = clustered(spark, path_parquet, path_sdrf, path_cluster_tsv, spectra_capacity, kept)
    consensus, single = chosen.consensus_spectrum_aggregation(clusters)
    folder, _, name = output.rpartition("/")
    part = (F.pmod(F.xxhash64("cluster_accession"), F.lit(files)) + 1).cast("string")
    path = F.lit(name) if files == 1 else F.concat(F.lit(f"{name.removesuffix('.msp')}_"), part, F.lit(".msp"))
    blocks = msp_blocks(consensus.unionByName(single), strategy_type).withColumn("file_path", path)
    write_blocks(blocks, folder or ".", "msp", mode, ("is_singleton", "cluster_accession", "usi"))
    removed(single)  # the routed rows, which both were read from
