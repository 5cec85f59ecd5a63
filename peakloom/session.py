"""What sessions share: the folder that all executors see, tables written there, and this package's sources."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session (tests) names no folder.
LOCAL_FOLDER = "file:///tmp/checkpoints"

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_FOLDER


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run has."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows up to which a narrow table (at most some 50 bytes a row) is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


#: Bytes of an Arrow batch for whole texts; Spark's own bound is 64 MB, which the executor and its Python worker hold in several copies.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python batches of BATCH_BYTES, unless it was given a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete a table of written() that nothing will read again: all that came from it has been written."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not re.search("/[a-z-]+-[0-9a-f]{32}$", path):  # as new_path() names them
            raise ValueError(f"{path} is no written table")
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def if_small(df: DataFrame, most: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """A broadcast hint for a narrow table, cheap to count, of at most `most` rows, or of so many items in an array column.

    Beyond that the table keeps out of broadcasts and the join is a shuffle.
    """
    if items:
        size = df.agg(F.sum(F.size(items) + 1)).first()[0] or 0
    else:
        size = df.limit(most + 1).count()
    return F.broadcast(df) if size <= most else df.hint("merge")


def ship_package(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="peakloom-")) / "peakloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shipping(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query whose tasks can import this package wherever they run."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        ship_package(spark)
        return query(spark, *args, **options)

    return run
