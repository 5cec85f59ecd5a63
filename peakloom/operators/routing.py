"""Clusters: sizes, best rows, and which rows a strategy reduces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spectra kept of a larger cluster.
KEPT = 10
#: Rows and bytes that a task holds before it looks which to keep.
HELD_ROWS, HELD_BYTES = 1 << 15, 1 << 26


def cluster_counts(df: DataFrame) -> DataFrame:
    """(cluster_accession, Nreps); rows without a cluster don't count."""
    return df.filter("cluster_accession is not null").groupBy("cluster_accession").agg(F.count(F.lit(1)).alias("Nreps"))


def sized_top(df: DataFrame, metric: str, n: int, by: str = "cluster_accession", held_rows: int = HELD_ROWS) -> DataFrame:
    """The n rows with the smallest metric of each group, nulls and NaN last, ties by usi; with Nreps, the group's full size. Rows without a group go.

    One pass: each task keeps n rows and a count of every group that it has
    seen, so a hot group sends n rows a task (n more each time that a task
    passes on what it holds), and one shuffle merges them.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_rows", T.LongType())])

    def reduced(held: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(held).combine_chunks()
        usi = rows.column("usi")
        keys = pa.table([rows.column(by), rows.column(metric), usi.is_valid(), usi], ["by", "metric", "named", "usi"])
        order = pc.sort_indices(keys, sort_keys=[(k, "ascending") for k in keys.column_names])
        group = rows.column(by).take(order).combine_chunks()
        first = np.flatnonzero(np.concatenate([[True], pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)]))
        size = np.diff(np.append(first, len(group)))
        counts = np.add.reduceat(rows.column("_rows").to_numpy()[order.to_numpy()], first)
        kept = np.minimum(size, n)
        place = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
        table = rows.take(order.take(pa.array(np.repeat(first, kept) + place)))
        return table.set_column(table.schema.get_field_index("_rows"), "_rows", pa.array(np.where(place == 0, np.repeat(counts, kept), 0)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b.append_column("_rows", pa.array(np.ones(b.num_rows, np.int64))))
            if sum(h.num_rows for h in held) >= held_rows or sum(h.nbytes for h in held) >= HELD_BYTES:
                held = reduced(held).to_batches()
                if sum(h.num_rows for h in held) >= held_rows // 2 or sum(h.nbytes for h in held) >= HELD_BYTES // 2:
                    yield from held
                    held = []
        if held:
            yield from reduced(held).to_batches()

    partial = df.filter(F.col(by).isNotNull()).mapInArrow(task, schema)
    group = Window.partitionBy(by)
    place = F.row_number().over(group.orderBy(F.col(metric).asc_nulls_last(), "usi"))
    merged = partial.withColumn("Nreps", F.sum("_rows").over(group)).withColumn("_place", place)
    return merged.filter(F.col("_place") <= n).drop("_place", "_rows")


def routed(df: DataFrame, metric: str = "global_qvalue", n: int = KEPT) -> DataFrame:
    """Rows that strategies look at, at most n a cluster: all of a cluster up to n rows, else its n best; with Nreps, the full size, and rk, the order.

    The order is that of a column `rank`, where there is one, else by metric and usi.
    """
    first = [F.col("rank")] if "rank" in df.columns else []
    order = Window.partitionBy("cluster_accession").orderBy(*first, F.col(metric).asc_nulls_last(), "usi")
    return sized_top(df, metric, n).withColumn("rk", F.row_number().over(order))


def singles(rows: DataFrame) -> DataFrame:
    """Routed rows that are alone in their cluster."""
    return rows.filter("Nreps = 1").drop("rk")
