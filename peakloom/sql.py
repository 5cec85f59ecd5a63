"""What SQL text can use of this library: names, similarities and consensus of clusters, as functions of a session.

    register(spark)
    spark.sql("select library_name(usi), dot_similarity(a.mz, a.intensity, b.mz, b.intensity) from ...")
    spark.sql("select * from most_similar(table(routed) partition by cluster_accession order by rk)")
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from .functions.similarity import SIMILARITIES, Spectra, pair_function
from .operators.routing import KEPT
from .schemas import REDUCED
from .session import ship_package

#: Functions that SQL itself can express: (parameters, result, expression).
EXPRESSIONS = {
    "library_name": ("usi string", "string", "split_part(usi, ':', -1)"),
    "joined_names": ("usis string", "string", "array_join(transform(split(usis, ';'), u -> split_part(u, ':', -1)), ';')"),
    "dataset_id": ("file_name string", "string", "split_part(file_name, '-', 1)"),
    "neutral_mass": ("mz double, charge int", "double", "mz * charge - charge * 1.00727646677D"),
}

#: (a cluster's rows, in order) -> the row that stands for it, with the columns of REDUCED.
Reducer = Callable[[list[Row]], dict]


def register_similarity(spark: SparkSession, name: str, measure: Callable, tolerance: float = 0.02) -> None:
    """A similarity by name: for strategies as `sim`, and in SQL as <name>_similarity(mz, intensity, other_mz, other_intensity), arrays of double.

    measure: (Spectra, left numbers, right numbers, tolerance) -> a number for each pair.
    """
    ship_package(spark)
    SIMILARITIES[name] = measure
    spark.udf.register(f"{name}_similarity", pair_function(measure, tolerance))


def register_reducer(spark: SparkSession, name: str, reduce: Reducer, kept: int = KEPT) -> None:
    """A strategy of one's own as a table function: name(table(...) partition by cluster_accession order by ...).

    The table has cluster_accession, usi and what `reduce` looks at, and is best
    routed first: of a larger cluster only the first `kept` rows are held. Each
    cluster gives one row of REDUCED; columns that `reduce` leaves out are null,
    but for cluster_accession and Nreps, the number of rows that came.
    """

    class Reduced:
        def __init__(self) -> None:
            self.rows: list[Row] = []
            self.came = 0

        def eval(self, row: Row):
            self.came += 1
            if len(self.rows) < kept:
                self.rows.append(row)

        def terminate(self):
            if self.rows:
                found = {"cluster_accession": str(self.rows[0]["cluster_accession"]), "Nreps": self.came} | reduce(self.rows)
                yield tuple(found.get(c) for c in REDUCED.names)

    ship_package(spark)
    spark.udtf.register(name, F.udtf(Reduced, returnType=REDUCED))


def most_similar(rows: list[Row], measure: Callable | None = None, tolerance: float = 0.02) -> dict:
    """The row with the greatest summed similarity to all (9 digits; ties to the first); of rows with one usi the last counts, at the first one's place."""
    rows = list({r["usi"]: r for r in rows}.values())
    n = len(rows)
    spectra = Spectra(*(pa.array([list(r[c] or []) for r in rows], pa.list_(pa.float64())) for c in ("mz_array", "intensity_array")))
    left, right = np.triu_indices(n)
    found = (measure or SIMILARITIES["dot"])(spectra, left, right, tolerance)
    apart = left != right
    sums = np.bincount(left, found, n) + np.bincount(right[apart], found[apart], n)
    best = rows[int(sums.round(9).argmax())].asDict()
    return {c: best[c] for c in REDUCED.names if c in best and c not in ("cluster_accession", "Nreps")}


def register(spark: SparkSession) -> None:
    """All functions of this module in a session: EXPRESSIONS, the known similarities and the table function most_similar."""
    for name, (parameters, result, expression) in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {expression}")
    for name, measure in list(SIMILARITIES.items()):
        register_similarity(spark, name, measure)
    register_reducer(spark, "most_similar", most_similar)
