"""Lempel-Ziv phrase fingerprints: the hashed phrases of an LZ78 parse, kept as a bottom-k minimum-hash signature."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import Powers

#: Hashes kept of each phrase set.
KEPT = 64
#: Key ranges per shuffle partition: several small ones even out what a partition gets.
RANGES = 8

def _parse(data: bytes, node: dict, root: dict, grown: list[dict], ends: list[int], at: int) -> dict:
    """Go on with the parse: node is where it stands in the phrase trie; new phrases end at the positions put into ends."""
    for at, byte in enumerate(data, at):
        below = node.get(byte)
        if below is None:
            node[byte] = {}
            grown.append(node)
            ends.append(at + 1)
            node = root
        else:
            node = below
    return node


def _signature(data: bytes, ends: list[int]) -> np.ndarray:
    """The KEPT smallest 32-bit hashes of the phrases data[ends[i-1]:ends[i]], ascending."""
    if not ends:
        return np.empty(0, np.uint32)
    up, down = Powers.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    to = np.array(ends)
    since = np.concatenate([[0], to[:-1]])
    h = (sums[to] - sums[since]) * down[since]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h >> np.uint64(32)).astype(np.uint32)
    h = np.unique(np.partition(h, KEPT - 1)[:KEPT] if len(h) > KEPT else h)
    return h


def fingerprints(text: str, tail: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Signatures of a text, and of the text whose last len(tail) characters give way to tail.

    Both share their beginning, which is parsed once; the trie's later growth is undone between them.
    """
    cut = len(text) - len(tail or "")
    kept, rest = text[:cut].encode("utf-8", "surrogatepass"), text[cut:].encode("utf-8", "surrogatepass")
    root: dict = {}
    ends: list[int] = []
    node = _parse(kept, root, root, [], ends, 0)
    shared, grown = len(ends), []
    # each entry of grown gained one branch: the byte before the phrase's end
    _parse(rest, node, root, grown, ends, len(kept))
    whole = kept + rest
    own = _signature(whole, ends)
    if tail is None:
        return own, None
    for parent, end in zip(grown, ends[shared:], strict=True):
        del parent[whole[end - 1]]
    del ends[shared:]
    other = tail.encode("utf-8", "surrogatepass")
    _parse(other, node, root, [], ends, len(kept))
    return own, _signature(kept + other, ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate from two signatures: of the KEPT smallest hashes of both, the share that both have. Two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:KEPT]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _range_of(key: Column, splits: list) -> Column:
    """The number of splits (in order) at or below key; null: 0. A binary search in one array, which the plan holds as a single constant."""
    if not splits:
        return F.lit(0)
    kind = "array<long>" if isinstance(splits[0], int) else "array<double>" if isinstance(splits[0], float) else "array<string>"
    known = F.from_json(F.lit(json.dumps(splits)), kind)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(splits).bit_length()))))
    further = lambda at, step: (at + step <= len(splits)) & F.coalesce(F.get(known, at + step - 1) <= key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def with_successor(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Rows (bucket, ghost, id, text) dealt and sorted so that each document's successor follows it.

    The successor is the next lower id, and the highest for the lowest. Ids are
    cut into ranges by quantiles; the first row of a range also stands, as
    ghost, at the end of the range above it. Whole texts are shuffled once.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * RANGES
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    quantiles = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0]
    bucket = _range_of(F.col("id"), sorted(set(quantiles or [])))
    heads = sorted(rows.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("id")).collect())
    if not heads:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("ghost"), "id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    above = [(h.id, heads[(i + 1) % len(heads)].bucket) for i, h in enumerate(heads)]
    goes_to = spark.createDataFrame(above, f"head {kind}, bucket int")
    ghosts = rows.join(F.broadcast(goes_to), F.col("id").eqNullSafe(F.col("head"))).select("bucket", F.lit(True).alias("ghost"), "id", "text")
    both = rows.select(bucket.cast("int").alias("bucket"), F.lit(False).alias("ghost"), "id", "text").unionByName(ghosts)
    return both.repartition(n // RANGES, "bucket").sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("id"), F.xxhash64("text"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    A document's edited text has its last half replaced by as much of its
    successor's beginning. Null text counts as empty; an empty text has an
    empty fingerprint, alike only to another. Rows that share an id stand in the
    order of a hash of their texts. A lone document follows itself. Null ids come last.

    A parse keeps its phrases in memory, some 250 bytes each: about 20 MB for a
    text of 1 MB, for as long as the text is parsed.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(id, text, next text) for each row that is no ghost."""
        last = None
        for b in batches:
            for bucket, ghost, key, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None and last[0] == bucket:
                    yield last[1], last[2], text
                last = None if ghost else (bucket, key, text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # a row that waits for the next one's signature, with the text of which that is
        for key, text, after in runs(batches):
            half = len(text) // 2
            tail = after[:half]
            edited = text[: len(text) - half] + tail
            own, other = _both(text, half, tail)
            if held is not None:
                out.append((*held[0], likeness(held[1], own if held[2] == text else fingerprints(held[2])[0])))
            row = (key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), likeness(own, other))
            held = row, own, after
            if len(out) >= 2000:
                yield _batch(out, id_kind)
                out = []
        if held is not None:
            out.append((*held[0], likeness(held[1], fingerprints(held[2])[0])))
        if out:
            yield _batch(out, id_kind)

    rows = with_successor(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    id_kind = pa.int64() if kind == "bigint" else None
    return rows.mapInArrow(task, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _both(text: str, half: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of text and of its edited form; a successor too short to fill the half leaves a shorter text."""
    if len(tail) == half:
        own, other = fingerprints(text, tail)
        return own, other
    return fingerprints(text)[0], fingerprints(text[: len(text) - half] + tail)[0]


def _batch(rows: list[tuple], id_kind: pa.DataType | None) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [id_kind, pa.int64(), None, None, None, pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
