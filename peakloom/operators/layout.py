"""Where spectra stand in MGF files, and how clusters find them there."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import if_small

#: Spectra in a file.
CAPACITY = 1_000_000
#: Positions of a source file that are numbered together.
STRETCH = 1 << 16
#: What tells a spectrum's place, and the buckets of places in kept tables.
PLACE, BUCKETS = ("mgf_path", "mgf_order"), 200


def attach_samples(spectra: DataFrame, samples: DataFrame) -> DataFrame:
    """Add organism and instrument by reference_file_name. A file without a sample is an error.

    Samples are a small sheet per project; sheets beyond if_small()'s bound are joined by shuffle.
    """
    known = samples.select("reference_file_name", "organism", "instrument", F.lit(True).alias("_known"))
    joined = spectra.join(if_small(known), "reference_file_name", "left")
    missing = F.raise_error(F.concat(F.lit("no sample for file "), F.coalesce("reference_file_name", F.lit("null")))).cast("string")
    return joined.withColumn("organism", F.when(F.col("_known").isNull(), missing).otherwise(F.col("organism"))).drop("_known")


def place_in_files(spectra: DataFrame, capacity: int = CAPACITY, order: str = "row_index", file: str = "file_stem", stretch: int = STRETCH) -> DataFrame:
    """Add group_path, file_index (from 1), mgf_path and mgf_order (from 0): running positions by the whole numbers in `order` within a source file and group.

    A prefix scan in stretches of `order`: rows of each stretch are counted, the
    counts, a small table, are summed up, and rows are numbered inside their
    stretch, from which their file's earlier stretches move them on. So a file's
    rows are many tasks' work. Two source files (column file_path, if there is
    one) of the same name would claim the same places: an error. A spectrum
    without a group has no place.
    """
    known = ["file_path"] if "file_path" in spectra.columns else []
    grouped = spectra.withColumn("group_path", text.group_path(F.col("organism"), F.col("instrument"), F.col("charge")))
    cut = grouped.withColumn("_stretch", F.floor(F.col(order) / stretch))
    part = [file, "group_path", "_stretch"]
    counts = cut.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), *(F.min(c).alias("_low") for c in known), *(F.max(c).alias("_high") for c in known))
    whole = Window.partitionBy(file, "group_path")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if known:
        same = F.min("_low").over(whole) == F.max("_high").over(whole)
        before = F.when(same, before).otherwise(F.raise_error(F.concat(F.lit("two files are named "), F.col(file))).cast("long"))
    numbered = cut.withColumn("_inside", F.row_number().over(Window.partitionBy(*part).orderBy(order)) - 1)
    return (
        numbered.join(counts.select(*part, before.alias("_before")), part, "left")
        .withColumn("_at", F.col("_before") + F.col("_inside"))
        .withColumn("file_index", (F.floor(F.col("_at") / capacity) + 1).cast("long"))
        .withColumn("mgf_order", F.col("_at") % capacity)
        .withColumn("mgf_path", F.concat("group_path", F.lit("/"), text.mgf_file_name(F.col(file), F.col("file_index"))))
        .select(*grouped.columns, "file_index", "mgf_order", "mgf_path")
    )


def keep_placed(placed: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write placed spectra at path in buckets of their places, a file each, for kept_spectra()."""
    name = f"kept_{hashlib.md5(path.encode()).hexdigest()}"
    dealt = placed.repartition(buckets, *PLACE)
    dealt.write.format("parquet").bucketBy(buckets, *PLACE).sortBy(*PLACE).option("path", path).mode("overwrite").saveAsTable(name)


def kept_spectra(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The table of keep_placed(), in any session: a join on its place moves only the other side."""
    name = f"kept_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        place = ", ".join(PLACE)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by ({place}) sorted by ({place}) into {buckets} buckets location '{path}'")
    return spark.table(name)


def join_clusters(assignments: DataFrame, spectra: DataFrame) -> DataFrame:
    """Assignments (mgf_path, mgf_order, cluster_accession, ...) with the spectra at their places; unknown places keep nulls."""
    return assignments.join(spectra.drop("cluster_accession"), [*PLACE], "left")
