"""Token counts from flat token files: documents end with a separator id and there is no index.

Blocks of a file are searched for separators on their own; a running sum and a
running maximum over the blocks' few figures stitch documents that cross them.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, written
from .files import created, opened

#: Where the public vocabularies lie, and the one to use: 50,256 ids, so that 50256 is free to end documents.
TOKENIZERS, VOCABULARY, SEPARATOR = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken", 50256
#: Tokens are little-endian 16-bit numbers; a file is closed at FILE_TOKENS, a block has BLOCK_TOKENS.
WIDTH, FILE_TOKENS, BLOCK_TOKENS = np.dtype("<u2"), 32 << 20, 1 << 20
#: The pattern that splits text before byte pairs are merged in this family of vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def _encoding(path: str):
    import tiktoken

    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens_of(text: str, tokenizers: str = TOKENIZERS) -> list[int]:
    return _encoding(f"{tokenizers}/{VOCABULARY}").encode_ordinary(text)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """Encode every text into flat files: (files: path, n_tokens) and (documents: doc_id, path, ordinal).

    Null text: no tokens, only a separator. The second table is known only to
    whoever wrote the files; counting needs the first alone.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = uri = None
        ordinal = size = 0
        end = np.array([SEPARATOR], WIDTH).tobytes()
        for b in batches:
            ids, places = [], []
            for at, text in enumerate(b.column(1).to_pylist()):
                if out is None:
                    (uri, out), ordinal, size = created(folder, ".tokens"), 0, 0
                tokens = np.array(tokens_of(text or "", tokenizers), WIDTH)
                out.write(tokens.tobytes() + end)
                ids.append(at)
                places.append((uri, ordinal, None))
                ordinal, size = ordinal + 1, size + len(tokens) + 1
                if size >= FILE_TOKENS:
                    out.close()
                    places[-1] = (uri, ordinal - 1, size)
                    out = None
            paths, ordinals, sizes = zip(*places, strict=True) if places else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(ordinals, pa.int64()), pa.array(sizes, pa.int64())], names)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, b.column(0).type), pa.array([uri]), pa.array([-1], pa.int64()), pa.array([size], pa.int64())], names)

    names = ["doc_id", "path", "ordinal", "n_tokens"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    places = written(rows.mapInArrow(task, f"doc_id {kind}, path string, ordinal long, n_tokens long"), "token-files")
    return places.filter("n_tokens is not null").select("path", "n_tokens"), places.filter("ordinal >= 0").select("doc_id", "path", "ordinal")


def count_tokens(files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, ordinal, n_tokens) for every document of the flat files (path, n_tokens).

    A document is what lies between separators; one that the file's end cuts off
    counts too, an empty one has 0 tokens, an empty file has none, nor has one
    of null size. A file that is listed twice is counted twice. Every block
    is read by range on its own, so one large file is spread over all tasks.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, block, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                first = block * block_tokens
                with opened(path) as source:
                    source.seek(first * WIDTH.itemsize)
                    tokens = np.frombuffer(source.read(min(block_tokens, size - first) * WIDTH.itemsize), WIDTH)
                ends = np.flatnonzero(tokens == separator) + first
                if first + len(tokens) == size and len(tokens) and tokens[-1] != separator:
                    ends = np.append(ends, size)
                yield pa.RecordBatch.from_pydict({"path": [path], "block": pa.array([block], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int64()))})

    blocks = files.filter("n_tokens > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.lit(block_tokens)).cast("long"))).alias("block"), "n_tokens"
    )
    parts = 4 * files.sparkSession.sparkContext.defaultParallelism
    found = written(blocks.repartition(parts).mapInArrow(task, "path string, block long, ends array<long>"), "token-ends")
    # the scan over blocks needs two numbers of each, so that a file of very many is no load for its task
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("path", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last")).select(
        "path", "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("last_end"),
    )
    stitched = found.join(if_small(written(scanned, "token-scan")), ["path", "block"])
    starts = F.concat(F.array("last_end"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    return (
        stitched.filter(F.size("ends") > 0)
        .select("path", "before", F.posexplode(F.arrays_zip(F.col("ends"), starts.alias("starts"))).alias("i", "span"))
        .select("path", (F.col("before") + F.col("i")).alias("ordinal"), (F.col("span.ends") - F.col("span.starts") - 1).alias("n_tokens"))
    )


def document_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id and n_tokens of every document, counted from token files that this writes under folder.

    Null and empty texts have 0 tokens. Repeated and null ids give a row each.
    No documents: no rows. Columns other than the two named play no part.
    """
    files, places = write_token_files(docs, folder, id_col, text_col, tokenizers)
    return places.hint("merge").join(count_tokens(files), ["path", "ordinal"]).select("doc_id", "n_tokens")
