"""The best-scoring spectrum stands for its cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Strategy


class BestSpectrumStrategy(Strategy):
    kept = 1

    def consensus(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("rk") == 1)
