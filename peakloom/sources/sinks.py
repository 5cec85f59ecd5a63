"""MGF and MSP files under exact names, through Spark's Python data source API.

Rows are (file_path, block). One task owns a file and writes it under a
temporary name beside its own. A commit has two phases: a manifest that names
all of a job's files is written, and then they are renamed, many at once. A
manifest that is left over tells the next write what an interrupted commit had
done: in mode overwrite it is completed, in mode append undone.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Files renamed, looked for or deleted at once.
AT_ONCE = 32
#: Names of manifests begin so.
MANIFEST = ".commit-"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def _each(work: Callable, items: Iterable) -> list:
    """work of each item, some at once; the first failure is raised when all have been tried."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        tried = [pool.submit(work, item) for item in items]
    return [t.result() for t in tried]


def _gone(store, path: str) -> None:
    if _there(store, path):
        store.delete_file(path)


class Commit:
    """The renaming of a job's files, known by its manifest from before the first to after the last."""

    def __init__(self, store, manifest: str, overwrite: bool, files: list[tuple[str, str]]):
        self.store, self.manifest, self.overwrite, self.files = store, manifest, overwrite, files

    @classmethod
    def begun(cls, store, root: str, overwrite: bool, files: list[tuple[str, str]]) -> Commit:
        """A new commit, whose manifest appears under its name when it is whole."""
        store.create_dir(root, recursive=True)
        new = cls(store, f"{root}/{MANIFEST}{uuid.uuid4().hex}", overwrite, files)
        with store.open_output_stream(f"{new.manifest}.part", compression=None) as out:
            out.write(json.dumps({"overwrite": overwrite, "files": files}).encode())
        store.move(f"{new.manifest}.part", new.manifest)
        return new

    @classmethod
    def left_over(cls, store, root: str) -> Iterator[Commit]:
        from pyarrow import fs

        for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if found.base_name.startswith(MANIFEST) and not found.base_name.endswith(".part"):
                with store.open_input_stream(found.path, compression=None) as lines:
                    said = json.loads(lines.read())
                yield cls(store, found.path, said["overwrite"], [tuple(f) for f in said["files"]])

    def _move(self, pair: tuple[str, str]) -> None:
        if _there(self.store, pair[0]):  # else it has been moved
            self.store.move(*pair)

    def completed(self) -> None:
        _each(self._move, self.files)
        self.store.delete_file(self.manifest)

    def undone(self) -> None:
        """Only for files that were not there before: what has been moved and what has not goes."""

        def back(pair: tuple[str, str]) -> None:
            if _there(self.store, pair[0]):
                self.store.delete_file(pair[0])
            else:
                _gone(self.store, pair[1])

        _each(back, self.files)
        self.store.delete_file(self.manifest)


def settled(path: str) -> None:
    """Complete or undo commits below path that were interrupted, as their manifests say."""
    store, root = _store(path.rstrip("/"))
    for commit in Commit.left_over(store, root):
        commit.completed() if commit.overwrite else commit.undone()


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.root)
        out, at, files = None, None, []
        for path, block in (row for b in iterator for row in zip(b.column(0).to_pylist(), b.column(1), strict=True)):
            if path != at:
                if out is not None:
                    out.write(b"\n")
                    out.close()
                at = path
                target = f"{root}/{at}"
                folder, _, name = target.rpartition("/")
                store.create_dir(folder, recursive=True)
                files.append((f"{folder}/.{name}.{uuid.uuid4().hex}", target))
                out = store.open_output_stream(files[-1][0], compression=None)
            else:
                out.write(b"\n\n")
            out.write(block.as_buffer())
        if out is not None:
            out.write(b"\n")
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.root)
        files = [f for m in messages if m for f in m.files]
        if not self.overwrite and any(_each(lambda f: _there(store, f[1]), files)):  # one that came during the write
            there = next(t for _, t in files if _there(store, t))
            self.abort(messages)
            raise FileExistsError(f"{there} exists; use mode overwrite")
        commit = Commit.begun(store, root, self.overwrite, files)
        try:
            commit.completed()
        except Exception:
            if not self.overwrite:
                commit.undone()
            raise

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what tasks have written, unless a commit still needs it."""
        store, root = _store(self.root)
        needed = {f for commit in Commit.left_over(store, root) for f, _ in commit.files}
        _each(lambda f: _gone(store, f), [f for m in messages if m for f, _ in m.files if f not in needed])


class _Blocks(DataSource):
    def schema(self) -> str:
        return "file_path string, block string"

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"], overwrite)


class MgfDataSource(_Blocks):
    @classmethod
    def name(cls) -> str:
        return "mgf"


class MspDataSource(_Blocks):
    @classmethod
    def name(cls) -> str:
        return "msp"


def register(spark: SparkSession) -> None:
    for source in (MgfDataSource, MspDataSource):
        spark.dataSource.register(source)


def _refuse_existing(blocks: DataFrame, path: str) -> None:
    """An error if a file that rows name is there; each task looks for its own, before any text is made."""
    names = blocks.select("file_path").distinct()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path.rstrip("/"))
        for b in batches:
            targets = [f"{root}/{p}" for p in b.column(0).to_pylist()]
            there = [t for t, found in zip(targets, _each(lambda t: _there(store, t), targets), strict=True) if found]
            yield pa.RecordBatch.from_pydict({"file_path": pa.array(there, pa.string())})

    found = names.mapInArrow(task, "file_path string").first()
    if found:
        raise FileExistsError(f"{found[0]} exists; use mode overwrite")


def write_blocks(blocks: DataFrame, path: str, kind: str, mode: str = "append", order: tuple[str, ...] = ("ordinal",)) -> None:
    """Write rows with file_path and block as files of a kind, mgf or msp, below path, each in the order of columns.

    Mode append adds files and fails, before it writes, if one is there;
    overwrite replaces those of the same names. What an interrupted write left
    is settled first; of two writes to one path at a time neither is safe.
    """
    from pyarrow import fs

    register(blocks.sparkSession)
    if not re.match("[a-z0-9]+:|/", path):
        path = os.path.abspath(path)  # tasks may work in other folders
    settled(path)
    store, root = _store(path.rstrip("/"))
    if mode == "append" and store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        _refuse_existing(blocks, path)
    rows = blocks.repartition("file_path").sortWithinPartitions("file_path", *order).select("file_path", "block")
    rows.write.format(kind).mode(mode).save(path)
