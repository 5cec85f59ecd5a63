"""Command line: convert and msp."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import convert as jobs
from .operators.layout import CAPACITY
from .plans import STRATEGIES
from .plans.average import AVERAGES, PRECURSORS

#: Options of each strategy, by their names on the command line.
OPTIONS = {
    "best": {}, "most": {"sim": "sim", "fragment_mz_tolerance": "fragment_mz_tolerance"},
    "bin": {k: k for k in ("min_mz", "max_mz", "bin_size", "peak_quorum", "edge_case_threshold")},
    "average": {k: k for k in ("diff_thresh", "dyn_range", "min_fraction", "pepmass", "msms_avg")},
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="peakloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert", help="spectra in Parquet to MGF files")
    c.add_argument("-p", "--parquet_dir", required=True)
    c.add_argument("-o", "--output")
    c.add_argument("-b", "--batch_size", type=int, default=100_000, help="taken for compatibility; Spark sizes its own batches")
    c.add_argument("-t", "--task_parallel", type=int, default=1, help="taken for compatibility; Spark's master decides")
    c.add_argument("-k", "--keep", help="keep the placed spectra at this path, for --kept of msp")
    m = commands.add_parser("msp", help="clusters to an MSP library")
    for name in ("path_parquet", "path_sdrf", "path_cluster_tsv", "output"):
        m.add_argument(f"--{name}", required=True)
    m.add_argument("--strategy_type", default="best", choices=list(STRATEGIES))
    m.add_argument("--sim", default="dot")
    for name, value in (
        ("fragment_mz_tolerance", 0.02), ("min_mz", 100.0), ("max_mz", 2000.0), ("bin_size", 0.02), ("peak_quorum", 0.25), ("edge_case_threshold", 0.5),
        ("diff_thresh", 0.01), ("dyn_range", 1000.0), ("min_fraction", 0.5),
    ):
        m.add_argument(f"--{name}", type=float, default=value)
    m.add_argument("--pepmass", default="lower_median", choices=PRECURSORS)
    m.add_argument("--msms_avg", default="weighted", choices=AVERAGES)
    m.add_argument("--files", type=int, default=jobs.FILES, help="deal the library to so many files; 1: the file output itself")
    m.add_argument("--kept", help="where convert kept the placed spectra; they are read from there, not laid out again")
    for p in (c, m):
        p.add_argument("-c", "--spectra_capacity", type=int, default=CAPACITY, help="spectra in an MGF file; the same for both commands")
        p.add_argument("--mode", default="append", choices=("append", "overwrite"))
    return top


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    spark = SparkSession.builder.appName("peakloom").getOrCreate()
    if given.command == "convert":
        jobs.convert(spark, given.parquet_dir, given.output, given.spectra_capacity, given.mode, given.keep)
    else:
        options = {k: getattr(given, v) for k, v in OPTIONS[given.strategy_type].items()}
        jobs.msp(spark, given.path_parquet, given.path_sdrf, given.path_cluster_tsv, given.output, given.strategy_type, given.mode, given.files, given.spectra_capacity, given.kept, **options)


if __name__ == "__main__":
    main()
