"""Spectra derived from order tables: orders are spectra, customers clusters, line items peaks. The SQL reads the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.similarity import PROTON, WATER
from .functions.similarity import RESIDUES as MASSES

PSM = """
select o_orderkey as scan_number, o_custkey as cluster_accession,
  cast(2 + o_custkey % 2 as integer) as charge, cast(2 + o_orderkey % 2 as integer) as charge_mixed,
  cast(o_totalprice as double) as pepmass,
  ((o_orderkey*7919) % 100003)/cast(100003 as double) as global_qvalue,
  ((o_orderkey*104729) % 100003)/cast(100003 as double) as posterior_error_probability,
  concat('run', cast(o_orderkey % 7 as string)) as reference_file_name,
  replace(o_orderpriority,' ','') as sequence,
  concat('mzspec:PXD000001:run', cast(o_orderkey % 7 as string), ':scan:',
         cast(o_orderkey as string), ':', replace(o_orderpriority,' ',''), '/',
         cast(2 + o_custkey % 2 as string)) as usi
from orders where o_orderkey in (select l_orderkey from lineitem)
"""
#: m/z on a 1/128 grid and whole intensities, so sums are exact in any order.
PEAKS = """
select l_orderkey as scan_number,
  100 + ((l_suppkey % 16)*256 + (l_linenumber-1))/cast(128 as double) as mz,
  cast(sum(l_quantity) as double) as intensity
from lineitem group by 1,2
"""
#: Peaks 2.0 apart, shifted by 0 to 4/128: greedy matching and a range join agree.
SPACED = """
select l_orderkey as scan_number,
  100 + 2*(l_suppkey % 16) + (l_orderkey % 5)/cast(128 as double) as mz,
  cast(sum(l_quantity) as double) as intensity
from lineitem group by 1,2
"""
#: Peaks 1/128 and more apart, closer than the tolerance: who takes which peak matters.
DENSE = """
select l_orderkey as scan_number,
  100 + ((l_suppkey % 4)*6 + (l_linenumber-1) + (l_orderkey % 3))/cast(128 as double) as mz,
  cast(sum(l_quantity) as double) as intensity
from lineitem group by 1,2
"""
#: The n-th residue of an order's peptide of seven, as a place in RESIDUES.
_PLACE = "cast((o_orderkey * 7919 + n * n * 104729 + n * 31) % 20 as integer)"
RESIDUES = "ARNDCEQGHILKMFPSTWYV"
_MASSES = ", ".join(f"({i}, '{r}', cast({MASSES[r]} as double))" for i, r in enumerate(RESIDUES))
#: residues: a row per order and place n of its peptide, with the residue's letter and mass and the mass up to it.
PEPTIDES = f"""
numbers as (select * from (values (1), (2), (3), (4), (5), (6), (7)) as t(n)), masses as (select * from (values {_MASSES}) as t(place, letter, mass)),
residues as (select o_orderkey as scan_number, cast(2 + o_orderkey % 2 as integer) as charge, n, letter, sum(mass) over (partition by o_orderkey order by n) as upto,
  sum(mass) over (partition by o_orderkey) + cast({WATER} as double) as whole
  from orders cross join numbers join masses on place = {_PLACE})
"""
#: A line item's peak: a b ion of its order's peptide, a y ion (of charge 1), the precursor, or 0.25 beside a b ion.
FRAGMENTS = f"""
select scan_number, mz, cast(sum(l_quantity) as double) as intensity from (
  select l_orderkey as scan_number, l_quantity, case l_suppkey % 4 when 0 then upto + cast({PROTON} as double) when 1 then whole - upto + cast({PROTON} as double)
    when 2 then whole / charge + cast({PROTON} as double) else upto + cast({PROTON} as double) + cast(0.25 as double) end as mz
  from lineitem join residues on scan_number = l_orderkey and n = least(l_linenumber, 6)
) as f group by 1, 2
"""
#: A sample sheet; the second line for run0 counts.
SAMPLES = """
select * from (values
  (0, 'run0.raw', 'Mus musculus', 'NT=Old'), (1, 'run0.raw', 'Homo sapiens', 'AC=MS:1001911;NT=Q Exactive'),
  (2, 'run1.raw', 'Mus musculus', 'NT=Orbitrap Fusion;AC=MS:1002416'), (3, 'run2.raw', 'Homo sapiens', 'AC=MS:1001911;NT=Q Exactive'),
  (4, 'run3.raw', 'Mus musculus', 'NT=Orbitrap Fusion;AC=MS:1002416'), (5, 'run4.raw', 'Homo sapiens', 'AC=MS:1001911;NT=Q Exactive'),
  (6, 'run5.raw', 'Mus musculus', 'NT=Orbitrap Fusion;AC=MS:1002416'), (7, 'run6.raw', 'Homo sapiens', 'AC=MS:1001911;NT=Q Exactive')
) as s(line, data_file, organism, instrument)
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")}
    for name, frame in tables.items():
        sql = sql.replace(f"from {name}", f"from {{{name}}}")
    used = {n: f for n, f in tables.items() if f"{{{n}}}" in sql}
    return spark.sql(sql, **used)


def spectra(spark: SparkSession, sf_dir: str, peaks: str = PEAKS) -> DataFrame:
    """psm with mz_array and intensity_array."""
    lists = view(spark, sf_dir, peaks).groupBy("scan_number").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    lists = lists.select("scan_number", F.col("p.mz").alias("mz_array"), F.col("p.intensity").alias("intensity_array"))
    return view(spark, sf_dir, PSM).join(lists, "scan_number")
