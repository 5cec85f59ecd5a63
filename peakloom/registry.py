"""Queries over the derived spectra, one per operator or strategy, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cli, sql
from . import fixtures as fx
from .convert import mgf_blocks, msp_blocks
from .functions import text
from .functions.peaks import bin_index, l2_normalised
from .functions.similarity import PROTON, fraction_by
from .operators.layout import attach_samples, join_clusters, keep_placed, kept_spectra, place_in_files
from .operators.routing import cluster_counts, routed, singles, sized_top
from .plans import AverageSpectrumStrategy, BestSpectrumStrategy, BinningStrategy, MostSimilarStrategy
from .plans.common import clusters_of, distinct_spectra, header
from .plans.most_similar import average_similarity, pair_similarities
from .session import new_path
from .sources.sinks import write_blocks
from .sources.spectra import SAMPLE_COLUMNS, read_spectra, sample_table, with_usi

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_PSM = f"with psm as ({fx.PSM})"
_ROUTED = f"""{_PSM},
ranked as (select *, count(*) over (partition by cluster_accession) as nreps, row_number() over (partition by cluster_accession order by global_qvalue, usi) as rk from psm),
routed as (select * from ranked where rk <= 10),
many as (select * from routed where nreps > 1)"""
_BINS = f"""{_ROUTED}, peaks as ({fx.PEAKS}),
peak as (select cluster_accession, usi, mz, intensity, cast(floor((mz - cast(100 as double)) / cast(0.02 as double)) as bigint) as bin from many join peaks using (scan_number) where mz >= 100 and mz < 2000),
last as (select *, row_number() over (partition by cluster_accession, usi, bin order by mz desc) as r from peak),
bins as (select cluster_accession, bin, count(*) as n, sum(intensity) as intensity, sum(mz) as mz from last where r = 1 group by 1, 2)"""
_MERGED = f"""{_BINS},
gaps as (select *, case when lead(bin) over w = bin + 1 then lead(mz / n) over w - mz / n end as gap, lead(n) over w as n2, lead(intensity) over w as i2, lead(mz) over w as m2
  from bins window w as (partition by cluster_accession order by bin)),
close as (select *, coalesce(gap > 0 and gap < cast(0.02 as double) * cast(0.5 as double) and bin < 94998, false) as c from gaps),
gone as (select *, coalesce(lag(c) over w and lag(bin) over w = bin - 1, false) as g from close window w as (partition by cluster_accession order by bin)),
merged as (select cluster_accession, bin, n + case when c then n2 else 0 end as n, intensity + case when c then i2 else 0 end as intensity, mz + case when c then m2 else 0 end as mz from gone where not g)"""
_SEGMENTS = f"""{_ROUTED}, peaks as ({fx.PEAKS}),
peak as (select cluster_accession, mz, intensity from many join peaks using (scan_number)),
opened as (select *, case when mz - lag(mz) over (partition by cluster_accession order by mz, intensity) >= cast(0.01 as double) then 1 else 0 end as o from peak),
numbered as (select *, sum(o) over (partition by cluster_accession order by mz, intensity rows unbounded preceding) as s from opened),
lasts as (select *, max(s) over (partition by cluster_accession) as top from numbered),
segments as (select cluster_accession, mz, intensity, cast(case when s = top and top >= 2 then s - 1 else s end as bigint) as segment from lasts),
sizes as (select cluster_accession, count(*) as k from many group by 1)"""
_PAIRS = f"""{_ROUTED}, peaks as ({fx.SPACED}),
norms as (select scan_number, sqrt(sum(intensity * intensity)) as norm from peaks group by 1),
unit as (select p.scan_number, mz, intensity / norm as w from peaks p join norms using (scan_number)),
pair as (select a.cluster_accession, a.usi as usi_a, b.usi as usi_b, a.scan_number as sa, b.scan_number as sb, a.rk as ra, b.rk as rb from many a join many b on a.cluster_accession = b.cluster_accession and a.rk <= b.rk),
lists as (select scan_number, list({{'mz': mz, 'w': w}} order by mz) as p from unit group by 1),
product as (select sa, sb, list_sum(flatten(list_transform(x.p, lambda a: list_transform(list_filter(y.p, lambda b: abs(a.mz - b.mz) <= cast(0.02 as double)), lambda b: a.w * b.w)))) as d
  from pair join lists x on x.scan_number = sa join lists y on y.scan_number = sb),
dots as (select pair.*, coalesce(d, 0) as similarity from pair left join product using (sa, sb)),
sums as (select cluster_accession, usi, rk, round(sum(similarity), 9) as total from (
  select cluster_accession, usi_a as usi, ra as rk, similarity from dots union all select cluster_accession, usi_b, rb, similarity from dots where ra < rb) group by 1, 2, 3),
winners as (select * from (select *, row_number() over (partition by cluster_accession order by total desc, rk) as r from sums) where r = 1)"""
_SAMPLES = f"""{_PSM}, sheet as ({fx.SAMPLES}),
lines as (select line, split_part(data_file, '.', 1) as reference_file_name, organism, regexp_extract(instrument, '(^|;)NT=([^;]*)', 2) as instrument from sheet),
samples as (select * from (select *, row_number() over (partition by reference_file_name order by line desc) as n from lines) where n = 1),
placed as (select p.*, organism, instrument, concat(organism, '/', instrument, '/charge', cast(charge as varchar), '/mgf files') as group_path,
  row_number() over (partition by organism, instrument, charge order by scan_number) - 1 as place from psm p join samples using (reference_file_name)),
positions as (select *, place // 100 + 1 as file_index, place % 100 as mgf_order, concat(group_path, '/PXD000001_', cast(place // 100 + 1 as varchar), '.mgf') as mgf_path from placed)"""
_UUID = """concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), concat('5', substr(h, 14, 3)),
  concat(substr('89ab', cast(1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 as bigint), 1), substr(h, 18, 3)), substr(h, 21, 12))"""
_NAMESPACE = f"unhex('{text.URL_NAMESPACE}')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(value: Column, digits: int) -> Column:
    """round() as the SQL has it: halves of the product with a power of ten go away from zero. Spark's own takes halves of the shortest decimal."""
    return F.round(value * 10.0**digits) / 10.0**digits


def _psm(spark, sf_dir) -> DataFrame:
    return fx.view(spark, sf_dir, fx.PSM)


def _many(spark, sf_dir, peaks=fx.PEAKS) -> DataFrame:
    return routed(fx.spectra(spark, sf_dir, peaks)).filter("Nreps > 1")


@query(f'{_PSM} select cluster_accession, count(*) as "Nreps" from psm group by 1')
def cluster_sizes(spark, sf_dir):
    return cluster_counts(_psm(spark, sf_dir))


@query(f'{_ROUTED} select cluster_accession, usi, nreps as "Nreps" from routed where nreps = 1')
def route_single(spark, sf_dir):
    return singles(routed(_psm(spark, sf_dir))).select("cluster_accession", "usi", "Nreps")


@query(f'{_ROUTED} select cluster_accession, usi, nreps as "Nreps" from routed where nreps between 2 and 10')
def route_mid(spark, sf_dir):
    return routed(_psm(spark, sf_dir)).filter("Nreps between 2 and 10").select("cluster_accession", "usi", "Nreps")


@query(f'{_ROUTED} select cluster_accession, usi, nreps as "Nreps" from routed where nreps > 10')
def route_large(spark, sf_dir):
    return routed(_psm(spark, sf_dir)).filter("Nreps > 10").select("cluster_accession", "usi", "Nreps")


@query(f'{_ROUTED} select cluster_accession, usi, global_qvalue from ranked where nreps > 10 and rk <= 10')
def top10_large(spark, sf_dir):
    return sized_top(_psm(spark, sf_dir), "global_qvalue", 10).filter("Nreps > 10").select("cluster_accession", "usi", "global_qvalue")


@query(f'{_ROUTED} select cluster_accession, usi, nreps as "Nreps", cast(rk as integer) as rk from many')
def routed_union(spark, sf_dir):
    return routed(_psm(spark, sf_dir)).filter("Nreps > 1").select("cluster_accession", "usi", "Nreps", "rk")


_BEST = ("cluster_accession", "usi", "pepmass", "charge", "Nreps", "posterior_error_probability", "is_singleton")


@query(f'{_ROUTED} select cluster_accession, usi, pepmass, charge, nreps as "Nreps", posterior_error_probability, false as is_singleton from many where rk = 1')
def best_consensus(spark, sf_dir):
    return BestSpectrumStrategy().consensus_spectrum_aggregation(fx.spectra(spark, sf_dir))[0].select(*_BEST)


@query(f'{_ROUTED} select cluster_accession, usi, pepmass, charge, nreps as "Nreps", posterior_error_probability, nreps = 1 as is_singleton from routed where rk = 1')
def best_with_singletons(spark, sf_dir):
    consensus, single = BestSpectrumStrategy().consensus_spectrum_aggregation(fx.spectra(spark, sf_dir))
    return consensus.unionByName(single).select(*_BEST)


@query(f"with peaks as ({fx.PEAKS}) select scan_number, mz, cast(floor((mz - cast(100 as double)) / cast(0.02 as double)) as bigint) as bin from peaks")
def peak_bins(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.PEAKS).select("scan_number", "mz", bin_index(F.col("mz"), 100, 0.02).alias("bin"))


@query(f"{_BINS} select * from bins")
def bin_sums(spark, sf_dir):
    return BinningStrategy().binned(distinct_spectra(clusters_of(_many(spark, sf_dir))))


@query(f"{_MERGED} select * from merged")
def bin_merge(spark, sf_dir):
    s = BinningStrategy()
    return s.merged(s.binned(distinct_spectra(clusters_of(_many(spark, sf_dir)))))


@query(f"""{_MERGED}, sizes as (select cluster_accession, ceil(count(distinct usi) * cast(0.25 as double)) as q from many group by 1)
select cluster_accession, mz / n as mz, intensity / n as intensity from merged join sizes using (cluster_accession) where n >= q""")
def bin_consensus_peaks(spark, sf_dir):
    clusters = fx.spectra(spark, sf_dir)
    consensus, _ = BinningStrategy().consensus_spectrum_aggregation(clusters)
    peaks = F.inline(F.arrays_zip(F.col("mz_array").alias("mz"), F.col("intensity_array").alias("intensity")))
    return consensus.select("cluster_accession", peaks).toDF("cluster_accession", "mz", "intensity")


@query(f"""{_ROUTED} select cluster_accession, round(avg(pepmass), 6) as pepmass, min(charge) as charge, max(nreps) as "Nreps",
min(posterior_error_probability) as posterior_error_probability, string_agg(usi, ';' order by rk) as usi from many group by 1""")
def bin_header(spark, sf_dir):
    return BinningStrategy().precursors(_many(spark, sf_dir)).withColumn("pepmass", F.round("pepmass", 6))


@query(f"{_SEGMENTS} select cluster_accession, segment, count(*) as n, sum(intensity) as total from segments group by 1, 2")
def avg_segments(spark, sf_dir):
    found = AverageSpectrumStrategy().segments(_many(spark, sf_dir))
    return found.groupBy("cluster_accession", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("total"))


_AVERAGED = """{segments}, sums as (select cluster_accession, segment, count(*) as n, sum(intensity) as total, {mz} as mz from segments group by 1, 2),
kept as (select cluster_accession, mz, total / k as intensity from sums join sizes using (cluster_accession) where n >= k * cast(0.5 as double)),
ranged as (select *, max(intensity) over (partition by cluster_accession) as most from kept)
select cluster_accession, round(mz, 9) as mz, intensity from ranged where intensity >= most / 1000"""


def _averaged(spark, sf_dir, **options) -> DataFrame:
    consensus, _ = AverageSpectrumStrategy(**options).consensus_spectrum_aggregation(fx.spectra(spark, sf_dir))
    peaks = F.inline(F.arrays_zip(F.col("mz_array").alias("mz"), F.col("intensity_array").alias("intensity")))
    return consensus.select("cluster_accession", peaks).toDF("cluster_accession", "mz", "intensity").withColumn("mz", _rounded(F.col("mz"), 9))


@query(_AVERAGED.format(segments=_SEGMENTS, mz="sum(mz * intensity) / sum(intensity)"))
def avg_weighted(spark, sf_dir):
    return _averaged(spark, sf_dir)


@query(_AVERAGED.format(segments=_SEGMENTS, mz="sum(mz) / count(*)"))
def avg_naive(spark, sf_dir):
    return _averaged(spark, sf_dir, msms_avg="naive", pepmass="naive_average")


@query(f"{_ROUTED} select cluster_accession, round(avg(pepmass), 6) as pepmass, min(charge) as charge from many group by 1")
def pep_naive(spark, sf_dir):
    return AverageSpectrumStrategy(pepmass="naive_average").precursors(_many(spark, sf_dir)).select("cluster_accession", F.round("pepmass", 6).alias("pepmass"), "charge")


_MASS = "pepmass * charge_mixed - charge_mixed * cast(1.00727646677 as double)"


@query(f"""{_ROUTED}, m as (select cluster_accession, avg({_MASS}) as m, cast(round_even(avg(charge_mixed), 0) as integer) as charge from many group by 1)
select cluster_accession, round((m + charge * cast(1.00727646677 as double)) / charge, 6) as pepmass, charge from m""")
def pep_neutral(spark, sf_dir):
    rows = _many(spark, sf_dir).withColumn("charge", F.col("charge_mixed"))
    return AverageSpectrumStrategy(pepmass="neutral_average").precursors(rows).select("cluster_accession", F.round("pepmass", 6).alias("pepmass"), "charge")


@query(f"""{_ROUTED}, m as (select cluster_accession, {_MASS} as m, charge_mixed as charge, rk from many),
o as (select *, row_number() over (partition by cluster_accession order by m, rk) as r, count(*) over (partition by cluster_accession) as k from m)
select cluster_accession, round((m + charge * cast(1.00727646677 as double)) / charge, 6) as pepmass, charge from o where r = (k - 1) // 2 + 1""")
def pep_lower_median(spark, sf_dir):
    rows = _many(spark, sf_dir).withColumn("charge", F.col("charge_mixed"))
    return AverageSpectrumStrategy(pepmass="lower_median").precursors(rows).select("cluster_accession", F.round("pepmass", 6).alias("pepmass"), "charge")


@query(f"""{_ROUTED}, peaks as ({fx.SPACED}), norms as (select scan_number, sqrt(sum(intensity * intensity)) as norm from peaks group by 1),
unit as (select scan_number, mz, floor((mz - 99) / 2) as grid, intensity / norm as w from peaks join norms using (scan_number)),
a as (select cluster_accession as c, usi, rk, grid, mz, w from many join unit using (scan_number)),
found as (select a.c, a.usi as usi_a, b.usi as usi_b, sum(a.w * b.w) as d from a join a b on a.c = b.c and a.grid = b.grid and a.rk <= b.rk and abs(a.mz - b.mz) <= cast(0.02 as double) group by all)
select a.cluster_accession, a.usi as usi_a, b.usi as usi_b, round(coalesce(d, 0), 9) as similarity
from many a join many b on a.cluster_accession = b.cluster_accession and a.rk <= b.rk left join found on c = a.cluster_accession and usi_a = a.usi and usi_b = b.usi""")
def pair_dot(spark, sf_dir):
    """Peaks 2.0 apart, so the SQL joins those of one place on the grid."""
    return pair_similarities(_many(spark, sf_dir, fx.SPACED)).withColumn("similarity", F.round("similarity", 9))


@query(f"""with recursive {_ROUTED.removeprefix("with ")}, peaks as ({fx.DENSE}),
norms as (select scan_number, sqrt(sum(intensity * intensity)) as norm from peaks group by 1),
lists as (select scan_number, list({{'mz': mz, 'w': intensity / norm}} order by mz) as p from peaks join norms using (scan_number) group by 1),
pair as (select a.cluster_accession, a.usi as usi_a, b.usi as usi_b, x.p as p, y.p as q from many a join many b on a.cluster_accession = b.cluster_accession
  join lists x on x.scan_number = a.scan_number join lists y on y.scan_number = b.scan_number where a.rk < b.rk),
walk as (select cluster_accession, usi_a, usi_b, p, q, cast(0 as double) as similarity from pair
  union all select cluster_accession, usi_a, usi_b, p[2:], case when k is null then q else list_concat(q[:k - 1], q[k + 1:]) end, similarity + case when k is null then 0 else p[1].w * q[k].w end
  from (select *, list_position(list_transform(q, lambda b: abs(p[1].mz - b.mz) <= cast(0.02 as double)), true) as k from walk where len(p) > 0))
select cluster_accession, usi_a, usi_b, round(similarity, 9) as similarity from walk where len(p) = 0""")
def pair_dot_dense(spark, sf_dir):
    """Peaks closer than the tolerance; the SQL takes the left peaks one by one and removes what they take."""
    pairs = pair_similarities(_many(spark, sf_dir, fx.DENSE)).filter("usi_a <> usi_b")
    return pairs.withColumn("similarity", F.round("similarity", 9))


@query(f'{_PAIRS} select m.cluster_accession, m.usi, m.nreps as "Nreps" from many m join winners w on m.cluster_accession = w.cluster_accession and m.usi = w.usi')
def most_consensus(spark, sf_dir):
    consensus, _ = MostSimilarStrategy().consensus_spectrum_aggregation(fx.spectra(spark, sf_dir, fx.SPACED))
    return consensus.select("cluster_accession", "usi", "Nreps")


@query(f'{_PAIRS} select cast(m.cluster_accession as varchar) as cluster_accession, m.usi, split_part(m.usi, \':\', -1) as name, least(m.nreps, 10) as rows_held, round(w.total, 6) as total from many m join winners w on m.cluster_accession = w.cluster_accession and m.usi = w.usi')
def most_by_sql(spark, sf_dir):
    """The most similar spectrum of each cluster in SQL text alone: a table function over routed rows, and its summed similarity by the scalar one."""
    sql.register(spark)
    fx.spectra(spark, sf_dir, fx.SPACED).createOrReplaceTempView("clustered_spectra")
    return spark.sql("""
        with ranked as (select *, row_number() over (partition by cluster_accession order by global_qvalue, usi) as rk, count(*) over (partition by cluster_accession) as n from clustered_spectra),
        routed as (select * from ranked where rk <= 10 and n > 1),
        best as (select * from most_similar(table(select cluster_accession, usi, rk, pepmass, charge, posterior_error_probability, mz_array, intensity_array from routed) partition by cluster_accession order by rk)),
        pairs as (select b.cluster_accession, b.usi, b.Nreps, case when r.rk < s.rk then dot_similarity(r.mz_array, r.intensity_array, s.mz_array, s.intensity_array)
            else dot_similarity(s.mz_array, s.intensity_array, r.mz_array, r.intensity_array) end as d
          from best b join routed s on cast(s.cluster_accession as string) = b.cluster_accession and s.usi = b.usi join routed r on r.cluster_accession = s.cluster_accession)
        select cluster_accession, usi, library_name(usi) as name, Nreps as rows_held, round(sum(d), 6) as total from pairs group by all""")


@query(f"""{_PAIRS}, mirrored as (select cluster_accession, usi_a as a, usi_b as b, similarity from dots union all select cluster_accession, usi_b, usi_a, similarity from dots where ra < rb)
select b.cluster_accession, round(avg(similarity), 9) as avg_dot from mirrored b join ranked r on r.cluster_accession = b.cluster_accession and r.usi = b.a and r.rk = 1 group by 1""")
def avg_dot(spark, sf_dir):
    clusters = fx.spectra(spark, sf_dir, fx.SPACED)
    best, _ = BestSpectrumStrategy().consensus_spectrum_aggregation(clusters)
    return average_similarity(best, routed(clusters).filter("Nreps > 1")).withColumn("avg_dot", F.round("avg_dot", 9))


@query(f"""with {fx.PEPTIDES}, peaks as ({fx.FRAGMENTS}),
ions as (select scan_number, upto / z + cast({PROTON} as double) as ion from residues cross join (values (1), (2)) as t(z) where n < 7 and z < charge
  union all select scan_number, (whole - upto) / z + cast({PROTON} as double) from residues cross join (values (1), (2)) as t(z) where n < 7 and z < charge),
kept as (select * from peaks p where not exists (select 1 from residues r cross join (values (1), (2), (3)) as t(z)
  where r.scan_number = p.scan_number and n = 7 and z <= charge and abs(mz - (whole / z + cast({PROTON} as double))) <= cast(0.02 as double))),
near as (select distinct k.scan_number, k.mz, intensity from kept k join ions i on i.scan_number = k.scan_number and abs(k.mz - ion) <= cast(0.02 as double)),
totals as (select scan_number, sum(intensity) as total from kept group by 1), found as (select scan_number, sum(intensity) as part from near group by 1)
select scan_number, round(case when total > 0 then coalesce(part, 0) / total else 0 end, 9) as fraction
from (select distinct scan_number from peaks) left join totals using (scan_number) left join found using (scan_number)""")
def explained_by_fragments(spark, sf_dir):
    """Peptides derived from keys, whose line items are fragments, precursors or neither."""
    peptides = fx.view(spark, sf_dir, f"with {fx.PEPTIDES} select * from residues")
    letters = F.array_join(F.array_sort(F.collect_list(F.struct("n", "letter"))).getField("letter"), "")
    named = peptides.groupBy("scan_number").agg(letters.alias("peptide"), F.first("charge").alias("charge"), F.first("whole").alias("whole"))
    peaks = fx.view(spark, sf_dir, f"with {fx.PEPTIDES} {fx.FRAGMENTS}").groupBy("scan_number").agg(F.collect_list(F.struct("mz", "intensity")).alias("p"))
    share = fraction_by(F.col("peptide"), F.col("charge"), F.col("whole") / F.col("charge") + PROTON, F.col("p.mz"), F.col("p.intensity"))
    return named.join(peaks, "scan_number").select("scan_number", F.round(share, 9).alias("fraction"))


@query("""select vec_id, cast(i as integer) as pos, round(v / norm, 6) as value from (
select vec_id, unnest(range(0, len(embedding))) as i, cast(unnest(embedding) as double) as v, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm from embeddings)""")
def l2_norm(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.posexplode(l2_normalised(F.col("embedding"))).alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"{_PSM} select scan_number, usi from psm")
def spectrum_usi(spark, sf_dir):
    psm = _psm(spark, sf_dir).drop("usi").withColumn("dataset", F.lit("PXD000001"))
    return psm.select("scan_number", text.usi(*(F.col(c) for c in ("dataset", "reference_file_name", "scan_number", "sequence", "charge"))).alias("usi"))


@query(f"{_PSM} select scan_number, split_part(usi, ':', -1) as name from psm")
def usi_name(spark, sf_dir):
    return _psm(spark, sf_dir).select("scan_number", text.library_name(F.col("usi")).alias("name"))


@query(f"{_ROUTED} select cluster_accession, string_agg(split_part(usi, ':', -1), ';' order by rk) as name from many group by 1")
def name_join(spark, sf_dir):
    return header(_many(spark, sf_dir)).select("cluster_accession", text.joined_names(F.col("usi")).alias("name"))


@query(f"{_PSM}, hashed as (select scan_number, sha1({_NAMESPACE} || encode(usi)) as h from psm) select scan_number, {_UUID} as uuid from hashed")
def cluster_uuid(spark, sf_dir):
    return _psm(spark, sf_dir).select("scan_number", text.cluster_uuid(F.col("usi")).alias("uuid"))


_FILE_NAME = "concat('PXD', cast(cluster_accession as string), '-', cast(scan_number as string), '.part.parquet')"


@query(f"{_PSM} select scan_number, split_part({_FILE_NAME}, '-', 1) as dataset, split_part({_FILE_NAME}, '.', 1) as stem from psm")
def dataset_id(spark, sf_dir):
    name = F.expr(_FILE_NAME)
    return _psm(spark, sf_dir).select("scan_number", text.dataset_id(name).alias("dataset"), text.stem(name).alias("stem"))


def _positions(spark, sf_dir) -> DataFrame:
    spectra = attach_samples(_psm(spark, sf_dir), sample_table(spark.sql(fx.SAMPLES))).withColumn("file_stem", F.lit("PXD000001"))
    return place_in_files(spectra, 100, order="scan_number")


@query(f"{_SAMPLES} select scan_number, organism, instrument from placed")
def sdrf_lookup(spark, sf_dir):
    return attach_samples(_psm(spark, sf_dir), sample_table(spark.sql(fx.SAMPLES))).select("scan_number", "organism", "instrument")


@query(f"{_SAMPLES} select scan_number, mgf_path, mgf_order from positions")
def mgf_ordinal(spark, sf_dir):
    return _positions(spark, sf_dir).select("scan_number", "mgf_path", "mgf_order")


@query(f"{_SAMPLES} select mgf_path, max(file_index) as file_index, count(*) as spectra from positions group by 1")
def mgf_file_index(spark, sf_dir):
    return _positions(spark, sf_dir).groupBy("mgf_path").agg(F.max("file_index").alias("file_index"), F.count(F.lit(1)).alias("spectra"))


@query(f"""{_SAMPLES} select cluster_accession, mgf_path, mgf_order, usi, pepmass from positions""")
def cluster_join(spark, sf_dir):
    placed = _positions(spark, sf_dir)
    assigned = placed.select("mgf_path", "mgf_order", "cluster_accession")
    return join_clusters(assigned, placed).select("cluster_accession", "mgf_path", "mgf_order", "usi", "pepmass")


@query(SQL["cluster_join"])
def cluster_join_kept(spark, sf_dir):
    """The same from spectra kept in buckets of their places: only the assignments move."""
    placed = _positions(spark, sf_dir).join(fx.spectra(spark, sf_dir).select("scan_number", "mz_array", "intensity_array"), "scan_number")
    path = new_path(spark, "kept-spectra")
    keep_placed(placed, path)
    assigned = _positions(spark, sf_dir).select("mgf_path", "mgf_order", "cluster_accession")
    return join_clusters(assigned, kept_spectra(spark, path)).select("cluster_accession", "mgf_path", "mgf_order", "usi", "pepmass")


_LINES = "string_agg(concat(cast(mz as varchar), ' ', cast(intensity as varchar)), chr(10) order by mz)"


_MGF_TEXT = f"""{_SAMPLES}, peaks as ({fx.PEAKS}), listed as (select scan_number, {_LINES} as peak_lines from peaks group by 1),
blocks as (select mgf_path, mgf_order, concat_ws(chr(10), 'BEGIN IONS', concat('TITLE=id=', usi), concat('PEPMASS=', cast(pepmass as varchar)),
  concat('CHARGE=', cast(charge as varchar), '+'), peak_lines, 'END IONS') as block from positions p join listed l on l.scan_number = p.scan_number)"""
_MSP = f"""concat_ws(chr(10), concat('Name: ', name), concat('MW: ', cast(pepmass as varchar)),
  concat('Comment: clusterID=', {_UUID}, ' Nreps=', cast(nreps as varchar), ' PEP=', cast(pep as varchar)), concat('Num peaks: ', cast(n as varchar)), peak_lines)"""


def _msp_best(usi: str) -> str:
    """Blocks of the best spectra under identifiers given as SQL."""
    return f"""{_ROUTED}, peaks as ({fx.PEAKS}), listed as (select scan_number, count(*) as n, {_LINES} as peak_lines from peaks group by 1),
hashed as (select *, sha1({_NAMESPACE} || encode({usi})) as h, split_part(usi, ':', -1) as name, posterior_error_probability as pep from routed where rk = 1),
blocks as (select cluster_accession, {_MSP} as block from hashed r join listed l on l.scan_number = r.scan_number)"""


def _msp_joined(peaks: str, pepmass: str) -> str:
    """Blocks of consensus spectra from SQL for their peaks (cluster_accession, mz, intensity) and precursors."""
    return f"""{peaks}, listed as (select cluster_accession, count(*) as n, {_LINES} as peak_lines from consensus group by 1),
heads as (select cluster_accession, {pepmass} as pepmass, max(nreps) as nreps, min(posterior_error_probability) as pep, string_agg(usi, ';' order by rk) as usi,
  string_agg(split_part(usi, ':', -1), ';' order by rk) as name from many group by 1),
hashed as (select *, sha1({_NAMESPACE} || encode(usi)) as h from heads)
select cluster_accession, {_MSP} as block from (select cluster_accession, name, pepmass, nreps, pep, h, coalesce(n, 0) as n, coalesce(peak_lines, '') as peak_lines from hashed left join listed using (cluster_accession))"""


@query(f"{_MGF_TEXT} select mgf_path as file_path, mgf_order as ordinal, block from blocks")
def mgf_block(spark, sf_dir):
    placed = _positions(spark, sf_dir).withColumnRenamed("pepmass", "exp_mass_to_charge")
    arrays = fx.spectra(spark, sf_dir).select("scan_number", "mz_array", "intensity_array")
    return mgf_blocks(placed.join(arrays, "scan_number"))


@query(f"{_msp_best('usi')} select * from blocks")
def msp_block(spark, sf_dir):
    consensus, single = BestSpectrumStrategy().consensus_spectrum_aggregation(fx.spectra(spark, sf_dir))
    return msp_blocks(consensus.unionByName(single), "best").select("cluster_accession", "block")


@query(_msp_joined(f"""{_MERGED}, sizes as (select cluster_accession, ceil(count(distinct usi) * cast(0.25 as double)) as q from many group by 1),
consensus as (select cluster_accession, mz / n as mz, intensity / n as intensity from merged join sizes using (cluster_accession) where n >= q)""",
    "list_reduce(list(pepmass order by rk), lambda a, b: a + b) / count(*)"))
def msp_block_bin(spark, sf_dir):
    consensus, _ = BinningStrategy().consensus_spectrum_aggregation(fx.spectra(spark, sf_dir))
    return msp_blocks(consensus, "bin").select("cluster_accession", "block")


@query(_msp_joined(f"""{_SEGMENTS}, sums as (select cluster_accession, segment, count(*) as n, sum(intensity) as total, sum(mz * intensity) / sum(intensity) as mz from segments group by 1, 2),
kept as (select cluster_accession, mz, total / k as intensity from sums join sizes using (cluster_accession) where n >= k * cast(0.5 as double)),
consensus as (select cluster_accession, mz, intensity from (select *, max(intensity) over (partition by cluster_accession) as most from kept) where intensity >= most / 1000)""",
    "list_reduce(list(pepmass order by rk), lambda a, b: a + b) / count(*)"))
def msp_block_average(spark, sf_dir):
    consensus, _ = AverageSpectrumStrategy(pepmass="naive_average").consensus_spectrum_aggregation(fx.spectra(spark, sf_dir))
    return msp_blocks(consensus, "average").select("cluster_accession", "block")


def _blocks_in(spark, folder: str, kind: str) -> DataFrame:
    """(path, block) of all files of a kind below a folder; an empty line ends a block, the last line end its file."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").option("lineSep", "\n\n").text(folder)
    path = F.substring_index(F.url_decode(F.col("_metadata.file_path")), f"{folder.rsplit('/', 1)[1]}/", -1)
    return found.select(path.alias("path"), F.regexp_replace("value", r"\n$", "").alias("block"))


def _blocks_in_order(spark, file: str) -> DataFrame:
    """(block, place) of one file, place from 0. Parts of the file are many tasks' work; only their counts are summed up in one place."""
    found = spark.read.option("lineSep", "\n\n").text(file)
    found = found.select(F.col("value").alias("block"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"))
    counts = found.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(counts.select("part", "low", before.alias("before")))
    return found.join(parts, "part").select("block", (F.col("before") + F.col("id") - F.col("low")).alias("place"))


@query(f"{_MGF_TEXT} select mgf_path, block from blocks")
def mgf_files(spark, sf_dir):
    """Spectra through the MGF sink and back from the files' text."""
    folder = new_path(spark, "mgf-files")
    write_blocks(mgf_block(spark, sf_dir), folder, "mgf")
    return _blocks_in(spark, folder, "mgf").withColumnRenamed("path", "mgf_path")


@query(f"""{_PSM}, peaks as ({fx.PEAKS}), counted as (select scan_number, count(*) as n from peaks group by 1)
select replace(usi, 'PXD000001', 'PXD7') as usi, charge, pepmass, global_qvalue, n from psm join counted using (scan_number)""")
def scanned_spectra(spark, sf_dir):
    """Spectra written as Parquet files in a directory parquet_files and found there again."""
    folder = new_path(spark, "spectra-files")
    named = fx.spectra(spark, sf_dir).withColumnRenamed("pepmass", "exp_mass_to_charge")
    named.write.parquet(f"{folder}/parquet_files")
    found = with_usi(read_spectra(spark, folder, scored=True, discover=True).withColumn("dataset", F.lit("PXD7")))
    return found.select("usi", "charge", F.col("exp_mass_to_charge").alias("pepmass"), "global_qvalue", F.size("mz_array").cast("long").alias("n"))


@query(SQL["scanned_spectra"])
def scanned_beside_strays(spark, sf_dir):
    """Spectra in two directories parquet_files among Parquet files that are none: beside them, above them and in a directory inside."""
    folder = new_path(spark, "spectra-strays")
    named = fx.spectra(spark, sf_dir).withColumnRenamed("pepmass", "exp_mass_to_charge")
    for k, place in enumerate(("aa/parquet_files", "b [1]/c/parquet_files")):
        named.filter(F.col("scan_number") % 2 == k).write.parquet(f"{folder}/{place}")
    stray = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    for place in ("aa/0", "aa/parquet_files/0", "zz"):
        stray.coalesce(1).write.parquet(f"{folder}/{place}")
    found = with_usi(read_spectra(spark, folder, scored=True, discover=True).withColumn("dataset", F.lit("PXD7")))
    return found.select("usi", "charge", F.col("exp_mass_to_charge").alias("pepmass"), "global_qvalue", F.size("mz_array").cast("long").alias("n"))


def _project(spark, sf_dir, *given: str) -> str:
    """A folder with spectra in parquet_files, a sample sheet and, from `convert`, MGF files of 100 spectra at most."""
    folder = new_path(spark, "project")
    fx.spectra(spark, sf_dir).withColumnRenamed("pepmass", "exp_mass_to_charge").write.parquet(f"{folder}/parquet_files")
    rows = spark.sql(fx.SAMPLES).orderBy("line")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.concat_ws("\t", "data_file", "organism", "instrument").alias("text")))), lambda r: r["text"]), "\n")
    sheet = rows.agg(F.concat(F.lit("\t".join(SAMPLE_COLUMNS) + "\n"), lines).alias("block")).select(F.lit("samples.sdrf.tsv").alias("file_path"), F.lit(0).alias("ordinal"), "block")
    write_blocks(sheet, folder, "mgf")
    cli.main(["convert", "-p", folder, "-c", "100", *given])
    return folder


@query(f"{_MGF_TEXT} select replace(block, 'PXD000001', 'part') as block from blocks")
def convert_command(spark, sf_dir):
    """Spectra and sample sheet from files to MGF text by the command line; Spark's file names make the dataset `part`."""
    return _blocks_in(spark, f"{_project(spark, sf_dir)}/mgf_output", "mgf").select("block")


def _library(spark, sf_dir, *given: str) -> str:
    """A folder with a library made by both commands from spectra, sample sheet and assignments in files, some lines of the assignments without a cluster."""
    folder = _project(spark, sf_dir, "--keep", kept := new_path(spark, "kept-spectra"))
    titles = F.regexp_extract("block", r":scan:(\d+):", 1).cast("long")
    placed = kept_spectra(spark, kept).select(F.col("scan_number").cast("long").alias("scan_number"), "mgf_path", "mgf_order")
    made = _blocks_in(spark, f"{folder}/mgf_output", "mgf").select(F.col("path").alias("made_path"), titles.alias("scan_number"))
    assigned = placed.join(made, "scan_number").filter("made_path = mgf_path").join(_psm(spark, sf_dir).select("scan_number", "cluster_accession"), "scan_number")
    both = F.explode(F.array(F.col("cluster_accession").cast("string"), F.lit(None).cast("string")))
    assigned.select("mgf_path", "mgf_order", both.alias("cluster")).write.option("sep", "\t").csv(f"{folder}/clusters")
    paths = ["--path_parquet", f"{folder}/parquet_files", "--path_sdrf", f"{folder}/samples.sdrf.tsv", "--path_cluster_tsv", f"{folder}/clusters"]
    cli.main(["msp", *paths, "--output", f"{folder}/library/all.msp", "-c", "100", *given])
    return f"{folder}/library"


@query(f"""{_msp_best("replace(usi, 'PXD000001', 'part')")} select block from blocks""")
def msp_command(spark, sf_dir):
    return _blocks_in(spark, _library(spark, sf_dir), "msp").select("block")


def _headed(blocks: str) -> str:
    """Lines that tell library blocks of these data apart: all but the cluster's UUID, which goes by the order of rows in the files, and the precursor's last digits."""
    return f"""select regexp_extract(block, 'Nreps=([0-9]+)', 1) as nreps, regexp_extract(block, 'PEP=(.*)', 1) as pep, regexp_extract(block, 'Num peaks: ([0-9]+)', 1) as peaks,
  len(string_split(regexp_extract(block, 'Name: (.*)', 1), ';')) as names, rtrim(split_part(block, 'Num peaks: ', 2), chr(10)) as lines from ({blocks})"""


def _heads(blocks: DataFrame) -> DataFrame:
    part = lambda pattern: F.regexp_extract("block", pattern, 1)
    return blocks.select(
        part("Nreps=([0-9]+)").alias("nreps"), part("PEP=(.*)").alias("pep"), part("Num peaks: ([0-9]+)").alias("peaks"),
        F.size(F.split(part("Name: (.*)"), ";")).cast("long").alias("names"), F.rtrim(F.split_part("block", F.lit("Num peaks: "), F.lit(2)), F.lit("\n")).alias("lines"),
    )


_SINGLE_BLOCKS = f"""select {_MSP} as block from (select *, sha1({_NAMESPACE} || encode(usi)) as h, split_part(usi, ':', -1) as name, posterior_error_probability as pep from routed where nreps = 1) r
  join (select scan_number, count(*) as n, {_LINES} as peak_lines from peaks group by 1) l on l.scan_number = r.scan_number"""


def _with_singles(sql: str) -> str:
    """SQL of consensus blocks, with those of single spectra."""
    head, last = sql.rsplit("\nselect ", 1)
    return f"{head}, blocks as (select {last}) {_headed(f'select block from blocks union all {_SINGLE_BLOCKS}')}"


@query(_with_singles(SQL["msp_block_bin"]))
def msp_bin_command(spark, sf_dir):
    """A library of binned spectra from files by the command line."""
    return _heads(_blocks_in(spark, _library(spark, sf_dir, "--strategy_type", "bin"), "msp"))


@query(_with_singles(SQL["msp_block_average"]))
def msp_average_command(spark, sf_dir):
    """A library of averaged spectra, precursors averaged too."""
    return _heads(_blocks_in(spark, _library(spark, sf_dir, "--strategy_type", "average", "--pepmass", "naive_average"), "msp"))


@query(f"""{_MGF_TEXT} select mgf_path, split_part(split_part(block, 'TITLE=id=', 2), chr(10), 1) as title, mgf_order as place from blocks""")
def mgf_file_order(spark, sf_dir):
    """Titles of written MGF files by their place in the file's text."""
    folder = new_path(spark, "mgf-files")
    write_blocks(mgf_block(spark, sf_dir), folder, "mgf")
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.mgf").text(folder, wholetext=True)
    path = F.substring_index(F.url_decode(F.col("_metadata.file_path")), f"{folder.rsplit('/', 1)[1]}/", -1)
    placed = found.select(path.alias("mgf_path"), F.posexplode(F.regexp_extract_all("value", F.lit(r"TITLE=id=([^\n]*)"), 1)).alias("place", "title"))
    return placed.select("mgf_path", "title", F.col("place").cast("long").alias("place"))


@query(f"""{_ROUTED}, placed as (select cast(cluster_accession as varchar) as c, usi, nreps, nreps = 1 as single from routed where rk = 1)
select split_part(usi, ':', -1) as name, replace(usi, 'PXD000001', 'part') as usi, row_number() over (order by single, c, usi) - 1 as place from placed""")
def msp_file_order(spark, sf_dir):
    """A library of one file: consensus spectra by cluster, then single ones, as their names and UUIDs stand in its text."""
    blocks = _blocks_in_order(spark, f"{_library(spark, sf_dir, '--files', '1')}/all.msp")
    head = F.regexp_extract("block", r"Name: ([^\n]*\n[^\n]*\nComment: clusterID=[0-9a-f-]*)", 1)
    heads = blocks.select("place", F.split_part(head, F.lit("\n"), F.lit(1)).alias("name"), F.split_part(head, F.lit("clusterID="), F.lit(2)).alias("uuid"))
    known = _psm(spark, sf_dir).select(F.regexp_replace("usi", "PXD000001", "part").alias("usi"))
    return heads.join(known.withColumn("uuid", text.cluster_uuid(F.col("usi"))), "uuid").select("name", "usi", "place")
