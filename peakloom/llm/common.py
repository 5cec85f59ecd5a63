"""What the operators share: the given tables, and written tables and size-checked joins from the session module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import if_small, new_path, removed, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
