"""Text, sources, sinks and the two commands."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom import cli, sql
from peakloom.functions import text
from peakloom.functions.peaks import l2_normalised, peaks
from peakloom.functions.similarity import SIMILARITIES
from peakloom.operators.layout import attach_samples, join_clusters, keep_placed, kept_spectra, place_in_files
from peakloom.plans import strategy
from peakloom.session import if_small
from peakloom.sources import sinks
from peakloom.sources.sinks import write_blocks
from peakloom.sources.spectra import find_sample_sheet, find_spectra, read_assignments, read_samples, read_spectra, sample_table
from peakloom.streaming import stream_blocks


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n][0] for n in names)], ", ".join(f"{n} {values[n][1]}" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "kind", "said"), [(1e-05, "double", "1e-05"), (12345678.0, "double", "12345678.0"), (0.1, "float", "0.10000000149011612"), (None, "double", None)])
def test_float_text(spark, value, kind, said):
    assert one(spark, text.float_text(F.col("v").cast("double")), v=(value, kind)) == said


def test_float_text_is_that_of_python():
    rng = np.random.default_rng(2)
    bits = np.frombuffer(rng.bytes(8 * 50_000), float)
    values = np.concatenate([
        bits, 10.0 ** rng.uniform(-9, 20, 50_000) * rng.choice([-1, 1], 50_000), np.round(rng.uniform(0, 2000, 20_000), 4), rng.integers(0, 10**17, 20_000).astype(float),
        10.0 ** np.arange(-30, 30), [0.0, -0.0, np.inf, -np.inf, np.nan, 5e-324, 1e16, 9999999999999998.0, 999999999999999.9, 0.0001, 0.00009999999],
    ])
    assert text.decimals(pa.array(values)).to_pylist() == [repr(v) for v in values.tolist()]


def test_peak_text(spark):
    t = text.peak_text(F.col("m"), F.col("i"))
    assert one(spark, t, m=([1.0, 2.5], "array<double>"), i=([3.0, 1e-7], "array<double>")) == "1.0 3.0\n2.5 1e-07"
    assert one(spark, t, m=(None, "array<double>"), i=([3.0], "array<double>")) == ""
    with pytest.raises(Exception, match="differ in length"):
        one(spark, t, m=([1.0], "array<double>"), i=([3.0, 4.0], "array<double>"))
    with pytest.raises(Exception, match="differ in length"):
        one(spark, peaks(F.col("m"), F.col("i")), m=([1.0], "array<double>"), i=([3.0, 4.0], "array<double>"))


@pytest.mark.parametrize("name", ["mzspec:PXD1:f:scan:1:PEPTIDE/2", "", "ünïcode;a:b"])
def test_uuid_is_that_of_the_standard_library(spark, name):
    assert one(spark, text.cluster_uuid(F.col("n")), n=(name, "string")) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_names(spark):
    assert one(spark, text.joined_names(F.col("u")), u=("a:b:PEP/2;c:d:TIDE/3", "string")) == "PEP/2;TIDE/3"
    assert one(spark, text.dataset_id(F.col("u")), u=("PXD008467-2.parquet", "string")) == "PXD008467"
    assert one(spark, text.dataset_id(F.col("u")), u=("plain.parquet", "string")) == "plain.parquet"
    assert one(spark, text.instrument_name(F.col("u")), u=("NT=First;AC=1;NT=Q=E", "string")) == "Q=E"
    with pytest.raises(Exception, match="no NT= item"):
        one(spark, text.instrument_name(F.col("u")), u=("AC=1; NT=X", "string"))


def test_zero_vector_has_no_direction(spark):
    assert one(spark, l2_normalised(F.col("v")), v=([0.0, 0.0], "array<double>")) == [None, None]
    assert one(spark, l2_normalised(F.col("v")), v=([3.0, 4.0], "array<double>")) == [0.6, 0.8]


def test_samples_last_line_wins_and_unknown_files_fail(spark):
    sheet = spark.createDataFrame([(0, "a.raw", "Old", "NT=X"), (1, "a.mzML", "New", "NT=Y")], "line long, data_file string, organism string, instrument string")
    samples = sample_table(sheet)
    assert [tuple(r) for r in samples.collect()] == [("a", "New", "Y")]
    with pytest.raises(Exception, match="no sample for file b"):
        attach_samples(spark.createDataFrame([("b",)], "reference_file_name string"), samples).collect()


@pytest.mark.parametrize(("n", "files"), [(0, 0), (3, 1), (4, 2), (7, 3)])
def test_capacity_rolls_files(spark, n, files):
    rows = spark.createDataFrame([(i, "f", "Homo sapiens", "QE", 2) for i in range(n)], "row_index long, file_stem string, organism string, instrument string, charge int")
    placed = place_in_files(rows, 3).collect()
    assert len({r.mgf_path for r in placed}) == files
    assert all(r.mgf_order == r.row_index % 3 and r.mgf_path.endswith(f"charge2/mgf files/f_{r.row_index // 3 + 1}.mgf") for r in placed)


@pytest.mark.parametrize("stretch", [1, 4, 50, 1 << 16])
def test_positions_by_stretches_are_those_of_one_window(spark, stretch):
    rng = np.random.default_rng(stretch)
    at = np.cumsum(rng.integers(1, 9, 400)).tolist()  # with holes
    rows = [(i, f"f{rng.integers(0, 3)}", "Homo sapiens", "QE", int(rng.integers(1, 4))) for i in at]
    df = spark.createDataFrame(rows, "row_index long, file_stem string, organism string, instrument string, charge int").repartition(7)
    whole = Window.partitionBy("file_stem", "charge").orderBy("row_index")
    placed = place_in_files(df.withColumn("place", F.row_number().over(whole) - 1), 30, stretch=stretch)
    assert placed.filter("place <> (file_index - 1) * 30 + mgf_order").count() == 0 and placed.count() == 400
    assert place_in_files(df, 30, stretch=stretch).columns == [*df.columns, "group_path", "file_index", "mgf_order", "mgf_path"]


def test_kept_spectra_stay_where_they_are(spark, tmp_path):
    placed = spark.range(500).select((F.col("id") % 7).cast("string").alias("mgf_path"), "id", F.col("id").alias("mgf_order"), F.array(F.lit(1.0)).alias("mz_array"))
    keep_placed(placed, str(tmp_path / "kept"), 6)
    assigned = placed.select("mgf_path", "mgf_order", F.lit("c").alias("cluster_accession")).unionByName(spark.createDataFrame([("9", 9, "none")], "mgf_path string, mgf_order long, cluster_accession string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as the size of real tables rules it out
    try:
        joined = join_clusters(assigned, kept_spectra(spark, str(tmp_path / "kept"), 6))
        assert joined.count() == 501 and joined.filter("id is null").count() == 1
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan.index("FileScan")
    assert "Bucketed: true" in plan[scan:] and plan.count("Exchange") == plan[:scan].count("Exchange") == 1  # the assignments' only


def test_files_of_one_name_are_an_error(spark):
    rows = spark.createDataFrame([(0, f"{d}/f.parquet", "f", "Homo sapiens", "QE", 2) for d in "ab"], "row_index long, file_path string, file_stem string, organism string, instrument string, charge int")
    assert place_in_files(rows.filter("file_path like 'a%'")).count() == 1
    with pytest.raises(Exception, match="two files are named f"):
        place_in_files(rows).collect()


def test_a_large_sheet_is_not_broadcast(spark):
    samples = spark.range(5).select(F.concat(F.lit("f"), "id").alias("reference_file_name"), F.lit("o").alias("organism"), F.lit("i").alias("instrument"))
    small, large = if_small(samples, 5), if_small(samples, 4)
    other = spark.range(3).select(F.concat(F.lit("f"), "id").alias("reference_file_name"))
    assert other.join(small, "reference_file_name").count() == other.join(large, "reference_file_name").count() == 3
    assert "SortMergeJoin" in other.join(large, "reference_file_name")._jdf.queryExecution().simpleString()


def test_assignments_drop_incomplete_lines(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a.mgf\t0\tc1\n\na.mgf\t1\t\na.mgf\t2\tc2\n")
    assert [(r.mgf_path, r.mgf_order, r.cluster_accession) for r in read_assignments(spark, str(tmp_path / "c.tsv")).orderBy("rank").collect()] == [("a.mgf", 0, "c1"), ("a.mgf", 2, "c2")]


def test_sink_separates_blocks_and_guards_files(spark, tmp_path):
    blocks = spark.createDataFrame([("x/a.mgf", 1, "two"), ("x/a.mgf", 0, "one"), ("b.mgf", 0, "b")], "file_path string, ordinal long, block string")
    write_blocks(blocks, str(tmp_path), "mgf")
    assert (tmp_path / "x/a.mgf").read_text() == "one\n\ntwo\n"
    with pytest.raises(Exception, match="exists"):
        write_blocks(blocks, str(tmp_path), "mgf")
    write_blocks(blocks.filter("ordinal = 0"), str(tmp_path), "mgf", "overwrite")
    assert (tmp_path / "x/a.mgf").read_text() == "one\n"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.mgf", "b.mgf"]


def _files(folder) -> dict[str, str]:
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


def _written(writer, names, block):
    return [writer.write(iter([pa.RecordBatch.from_pydict({"file_path": [n], "block": [block]})])) for n in names]


@pytest.mark.parametrize("overwrite", [False, True])
def test_a_commit_that_stops_half_way_is_settled_by_the_next_write(spark, tmp_path, monkeypatch, overwrite):
    names = [f"d{k}/f{k}.mgf" for k in range(6)]
    if overwrite:
        write_blocks(spark.createDataFrame([(n, 0, "old") for n in names], "file_path string, ordinal long, block string"), str(tmp_path), "mgf")
    writer = sinks.BlockWriter(str(tmp_path), overwrite)
    messages, move = _written(writer, names, "new"), sinks.Commit._move
    monkeypatch.setattr(sinks.Commit, "_move", lambda self, pair: move(self, pair) if not pair[1].endswith(("f2.mgf", "f4.mgf")) else (_ for _ in ()).throw(OSError("gone")))
    monkeypatch.setattr(sinks.Commit, "undone", lambda self: (_ for _ in ()).throw(OSError("the driver died")))
    with pytest.raises(OSError):
        writer.commit(messages)
    writer.abort(messages)  # as Spark does after a failed commit; what the manifest names stays
    monkeypatch.undo()
    left = _files(tmp_path)
    assert sum(t == "new\n" for t in left.values()) == 6 and any(n.startswith(".commit-") for n in left)
    sinks.settled(str(tmp_path))
    assert _files(tmp_path) == ({n: "new\n" for n in names} if overwrite else {})
    write_blocks(spark.createDataFrame([(n, 0, "again") for n in names], "file_path string, ordinal long, block string"), str(tmp_path), "mgf", "overwrite" if overwrite else "append")
    assert _files(tmp_path) == {n: "again\n" for n in names}


def test_a_path_may_be_relative(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    write_blocks(spark.createDataFrame([("a.msp", 0, "x")], "file_path string, ordinal long, block string"), ".", "msp")
    assert _files(tmp_path) == {"a.msp": "x\n"}


def test_a_commit_that_fails_leaves_nothing_in_append(spark, tmp_path, monkeypatch):
    writer = sinks.BlockWriter(str(tmp_path), False)
    messages, move = _written(writer, ["a.mgf", "b.mgf"], "new"), sinks.Commit._move
    monkeypatch.setattr(sinks.Commit, "_move", lambda self, pair: move(self, pair) if not pair[1].endswith("b.mgf") else (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        writer.commit(messages)
    writer.abort(messages)
    assert _files(tmp_path) == {}


def test_existing_files_are_found_before_any_text_is_made(spark, tmp_path):
    (tmp_path / "b.mgf").write_text("there")
    failing = F.when(F.col("file_path").isNotNull(), F.raise_error(F.lit("made")).cast("string"))
    blocks = spark.createDataFrame([("a.mgf", 0), ("b.mgf", 0)], "file_path string, ordinal long").withColumn("block", failing)
    with pytest.raises(FileExistsError, match="b.mgf exists"):
        write_blocks(blocks, str(tmp_path), "mgf")
    assert _files(tmp_path) == {"b.mgf": "there"}


def test_spectra_are_found_among_strays(spark, project):
    stray = spark.range(3).toDF("other")
    for place in ("aa/0.parquet", "parquet_files/inner/0.parquet", "zz.parquet"):
        (project / place).parent.mkdir(parents=True, exist_ok=True)
        stray.coalesce(1).write.parquet(str(project / f"{place}.d"))
        next((project / f"{place}.d").glob("part-*.parquet")).rename(project / place)
    assert [p.rsplit("/", 1)[1] for p in find_spectra(spark, str(project))] == ["PXD1-0.parquet"]
    assert read_spectra(spark, str(project), discover=True).count() == 5
    with pytest.raises(FileNotFoundError, match="parquet_files"):
        read_spectra(spark, str(project / "other"), discover=True)


def test_functions_in_sql(spark):
    sql.register(spark)
    sql.register_similarity(spark, "shared", lambda spectra, left, right, tolerance: np.minimum(np.diff(spectra.first)[left], np.diff(spectra.first)[right]).astype(float))
    sql.register_reducer(spark, "longest", lambda rows: {"usi": max(rows, key=lambda r: len(r["mz_array"]))["usi"], "pepmass": 1.5})
    rows = [("a", f"p:q:S{i}/2", i, [100.0 + j for j in range(i + 1)], [1.0] * (i + 1)) for i in range(4)] + [("b", "p:q:T/3", 0, [1.0], [2.0]), ("b", "p:q:U/3", 1, None, None)]
    spark.createDataFrame(rows, "cluster_accession string, usi string, rk int, mz_array array<double>, intensity_array array<double>").createOrReplaceTempView("some_spectra")
    said = spark.sql("select library_name(usi) as n, shared_similarity(mz_array, intensity_array, array(1.0D, 2.0D), array(1.0D, 1.0D)) as s from some_spectra order by usi").collect()
    assert [tuple(r) for r in said] == [("S0/2", 1.0), ("S1/2", 2.0), ("S2/2", 2.0), ("S3/2", 2.0), ("T/3", 1.0), ("U/3", None)]
    assert spark.sql("select joined_names('a:b:X/1;c:Y/2') as n, dataset_id('PXD1-3.parquet') as d").first() == ("X/1;Y/2", "PXD1")
    found = spark.sql("select cluster_accession, usi, Nreps, pepmass, charge from longest(table(select * from some_spectra where mz_array is not null) partition by cluster_accession order by rk)")
    assert sorted(tuple(r) for r in found.collect()) == [("a", "p:q:S3/2", 4, 1.5, None), ("b", "p:q:T/3", 1, 1.5, None)]
    assert strategy("most", sim="shared").sim == "shared"
    SIMILARITIES.pop("shared")


@pytest.fixture
def project(spark, tmp_path):
    """Two spectra files with five spectra each, a sample sheet, and a decoy outside parquet_files."""
    rows = [(f"run{i % 2}", str(i), "PEPTIDE", [100.0 + i, 200.0], [1.0, 2.0], 2, 500.0 + i, 0.1, 0.01 * i) for i in range(10)]
    schema = "reference_file_name string, scan_number string, sequence string, mz_array array<double>, intensity_array array<double>, charge int, exp_mass_to_charge double, posterior_error_probability double, global_qvalue double"
    for k in (0, 1):
        spark.createDataFrame(rows[5 * k : 5 * k + 5], schema).coalesce(1).write.parquet(str(tmp_path / f"out{k}"))
        target = tmp_path / "project" / ("parquet_files" if k == 0 else "other") / f"PXD1-{k}.parquet"
        target.parent.mkdir(parents=True)
        next((tmp_path / f"out{k}").glob("part-*.parquet")).rename(target)
    (tmp_path / "project/s.sdrf.tsv").write_text(
        "comment[data file]\tcharacteristics[organism]\tcomment[instrument]\nrun0.raw\tHomo sapiens\tNT=QE\nrun1.raw\tMus musculus\tAC=1;NT=Fusion\n"
    )
    return tmp_path / "project"


def test_discovery(spark, project):
    found = read_spectra(spark, str(project), discover=True)
    assert (found.count(), found.select("file_stem", "dataset").distinct().collect()) == (5, [("PXD1-0", "PXD1")])
    assert find_sample_sheet(spark, str(project)).endswith("s.sdrf.tsv")
    with pytest.raises(FileNotFoundError):
        find_sample_sheet(spark, str(project / "other"))
    (project / "bad.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        read_samples(spark, str(project / "bad.tsv"))


@pytest.mark.parametrize("name", ["best", "most", "bin", "average"])
def test_commands_from_spectra_to_library(spark, project, name):
    cli.main(["convert", "-p", str(project), "-c", "2"])
    made = {str(p.relative_to(project / "mgf_output")): p.read_text() for p in (project / "mgf_output").rglob("*.mgf")}
    assert sorted(made) == [
        "Homo sapiens/QE/charge2/mgf files/PXD1-0_1.mgf", "Homo sapiens/QE/charge2/mgf files/PXD1-0_2.mgf", "Mus musculus/Fusion/charge2/mgf files/PXD1-0_1.mgf",
    ]
    assert sum(t.count("BEGIN IONS") for t in made.values()) == 5
    first = made["Homo sapiens/QE/charge2/mgf files/PXD1-0_1.mgf"].split("\n\n")[0]
    assert first == "BEGIN IONS\nTITLE=id=mzspec:PXD1:run0:scan:0:PEPTIDE/2\nPEPMASS=500.0\nCHARGE=2+\n100.0 1.0\n200.0 2.0\nEND IONS"

    human = "Homo sapiens/QE/charge2/mgf files/PXD1-0_{}.mgf"
    lines = [f"{human.format(1)}\t0\t7", f"{human.format(1)}\t1\t7", f"{human.format(2)}\t0\t8"]
    (project / "clusters.tsv").write_text("\n".join(lines) + "\n")
    args = ["msp", "--path_parquet", str(project / "parquet_files/PXD1-0.parquet"), "--path_sdrf", str(project / "s.sdrf.tsv"), "--path_cluster_tsv", str(project / "clusters.tsv")]
    with pytest.raises(Exception, match="no spectrum at"):
        cli.main([*args, "--output", str(project / "lib.msp"), "--strategy_type", name])
    cli.main([*args, "--output", str(project / "lib.msp"), "--strategy_type", name, "-c", "2", "--files", "1"])
    blocks = (project / "lib.msp").read_text().rstrip("\n").split("\n\n")
    assert len(blocks) == 2
    assert re.match(r"Name: PEPTIDE/2(;PEPTIDE/2)?\nMW: \d+\.\d+\nComment: clusterID=[0-9a-f-]{36} Nreps=2 PEP=0\.1\nNum peaks: \d", blocks[0])
    assert "Nreps=1 " in blocks[1] and "MW: 504.0" in blocks[1]


@pytest.mark.parametrize(
    ("name", "given", "options"),
    [
        ("best", [], {}),
        ("most", ["--sim", "dot", "--fragment_mz_tolerance", "0.5"], {"sim": "dot", "fragment_mz_tolerance": 0.5}),
        ("bin", ["--min_mz", "50", "--max_mz", "900", "--bin_size", "0.1", "--peak_quorum", "0.5", "--edge_case_threshold", "0.9"],
         {"min_mz": 50.0, "max_mz": 900.0, "bin_size": 0.1, "peak_quorum": 0.5, "edge_case_threshold": 0.9}),
        ("average", ["--diff_thresh", "0.2", "--dyn_range", "10", "--min_fraction", "0.1", "--pepmass", "naive_average", "--msms_avg", "naive"],
         {"diff_thresh": 0.2, "dyn_range": 10.0, "min_fraction": 0.1, "pepmass": "naive_average", "msms_avg": "naive"}),
    ],
)
def test_options_reach_the_strategy(spark, monkeypatch, name, given, options):
    seen = {}
    monkeypatch.setattr(cli.jobs, "msp", lambda *a, **k: seen.update(args=a, options=k))
    paths = [x for p in ("path_parquet", "path_sdrf", "path_cluster_tsv", "output") for x in (f"--{p}", p)]
    cli.main(["msp", *paths, "--strategy_type", name, "-c", "7", "--files", "3", "--mode", "overwrite", "--kept", "k", *given])
    assert seen["args"][1:] == ("path_parquet", "path_sdrf", "path_cluster_tsv", "output", name, "overwrite", 3, 7, "k")
    assert seen["options"] == options
    held = set(vars(strategy(name, **options)).values())
    assert held >= set(options.values())


def test_stream_reads_arriving_files(spark, project, tmp_path):
    query = stream_blocks(spark, str(project / "parquet_files"), "PXD1").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert spark.table("arrived").count() == 5
