"""Removal of byte strings that occur more than once, found by suffix sorting.

A string of LENGTH bytes is filed under the least hash among its GRAM-byte
substrings, so equal strings are filed together wherever they are. Neighbouring
strings of a text mostly share that hash: a text is cut into contexts, runs of
such starts with the bytes they span. Equal contexts are counted before
anything moves; the different contexts of a hash are suffix-sorted together.
If these are too many for one task, each is cut by the distance of its starts
from that least substring, and filed anew under what all strings of a stretch of
distances have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, written
from .shingles import Powers, chunks, mix, utf8
from .suffixes import common_prefixes, sorted_suffixes

#: Bytes of a repeated string, and of the substrings that file it; bytes from which a repeat counts as a shared passage (some 42 words).
LENGTH, GRAM, PASSAGE = 400, 48, 256
#: Bytes sorted at once; contexts of one hash with more bytes than that are filed anew by stretches of so many distances, in turn.
BLOCK_BYTES, STRETCHES = 2 << 20, (32, 1)
#: Bytes of text looked at at once, which leave 40 bits of a hash beside a place; a longer text is cut into overlapping parts.
PART_BYTES = (1 << 24) - (1 << 16)
#: Cuts and spans (some 70 bytes each) that are broadcast together.
BROADCAST_SPANS = 1_200_000

_VALUES = np.random.default_rng(31).integers(1, 1 << 63, 256, np.uint64)


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all `gram`-byte substrings."""
    n = len(data)
    up, down = Powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def _least_grams(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """_grams(), and for each start where the least (the leftmost of equal ones) is in the `length` bytes from there.

    Hashes compare by their 40 high bits, so that the others can hold the place; equal strings agree in both.
    """
    h = _grams(data, gram)
    width = length - gram + 1
    rows = -(-len(h) // width)
    place = np.uint64((1 << 24) - 1)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(h)] = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(h) - width + 1
    return h, (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & place).astype(np.int64)


def contexts(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first start in data, starts, hash) of the contexts of some texts.

    Equal strings have the place of their least gram at the same distance, so
    no two starts of one context begin equal strings.
    """
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    hashes, place = _least_grams(data, length, gram)
    begin = np.concatenate([[True], place[1:] != place[:-1]])
    texts = np.flatnonzero(np.diff(offsets) >= length)
    heads, stops = offsets[texts], offsets[texts + 1] - length + 1
    begin[heads] = True
    edges = np.zeros(len(place) + 1, np.int32)
    np.add.at(edges, heads, 1)
    np.add.at(edges, stops, -1)
    first = np.flatnonzero(begin & (np.cumsum(edges[:-1]) > 0))
    text = texts[np.searchsorted(heads, first, "right") - 1]
    stop = np.minimum(np.append(first[1:], len(place)), offsets[text + 1] - length + 1)
    return text, first, stop - first, hashes[place[first]]


def _parts(offsets: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, bytes of it left out before, offsets, bytes) of groups of texts, or of parts of a very long text that share length - 1 bytes."""
    for lo, hi in chunks(offsets):
        size = int(offsets[hi] - offsets[lo])
        if size <= PART_BYTES:
            yield lo, 0, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
            continue
        for base in range(0, size - length + 1, PART_BYTES):
            part = data[offsets[lo] + base : offsets[lo] + min(size, base + PART_BYTES + length - 1)]
            yield lo, base, np.array([0, len(part)]), part


def _key(text: Column) -> list[Column]:
    whole = F.coalesce(text.cast("binary"), F.lit(b""))
    return [F.xxhash64(whole).alias("text_a"), F.hash(whole).alias("text_b")]


def _context_rows(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(doc_id, text_a, text_b, at, starts, hash, context_a, context_b): every context of every text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(3))
            for lo, base, own, part in _parts(offsets, data, length):
                text, first, starts, least = contexts(own, part, length, min(GRAM, length))
                view = memoryview(part)
                digests = b"".join([xxhash.xxh3_128_digest(view[s : s + n + length - 1]) for s, n in zip(first.tolist(), starts.tolist(), strict=True)])
                pair = np.frombuffer(digests, "<i8").reshape(-1, 2)
                rows = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).take(rows) for i in range(3)), pa.array((first - own[text] + base).astype(np.int32)), pa.array(starts.astype(np.int32)),
                     pa.array(least.view(np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                    ["doc_id", "text_a", "text_b", "at", "starts", "hash", "context_a", "context_b"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), *_key(F.col(text_col)), F.col(text_col).alias("text")).filter(F.octet_length("text") >= length)
    return rows.mapInArrow(task, f"doc_id {kind}, text_a long, text_b int, at int, starts int, hash long, context_a long, context_b long")


def _with_bytes(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """Add the bytes of contexts, each cut from one text that has it."""
    by_text = distinct.select("of.*", "hash", "context_a", "context_b", "times").groupBy("doc_id", "text_a", "text_b").agg(
        F.collect_list(F.struct("at", "starts", "hash", "context_a", "context_b", "times")).alias("cuts")
    )
    rows = docs.select(F.col(id_col).alias("own_id"), *(c.alias(f"own_{n}") for n, c in zip("ab", _key(F.col(text_col)), strict=True)), F.col(text_col).alias("text"))
    joined = rows.join(
        if_small(written(by_text, "suffix-cuts"), BROADCAST_SPANS, "cuts"),
        F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_a") == F.col("text_a")) & (F.col("own_b") == F.col("text_b")),
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "context_a", "context_b", "starts", "times", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            offsets, data = utf8(b.column(0))
            out, size = [], 0
            for i, cuts in enumerate(b.column(1).to_pylist()):
                for c in cuts:
                    at = offsets[i] + c["at"]
                    piece = data[at : at + c["starts"] + length - 1].tobytes()
                    out.append((c["hash"], c["context_a"], c["context_b"], c["starts"], c["times"], piece))
                    size += len(piece)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "hash long, context_a long, context_b long, starts int, times long, data binary"
    return joined.select("text", "cuts").mapInArrow(task, schema)


def repeated_starts(pieces: list[bytes], starts: list[int], times: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context the starts whose string occurs more than once; a context counts as often as it was seen."""
    text = b"".join(pieces)
    first = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])[:-1]
    wanted = np.zeros(len(text), bool)
    weight = np.zeros(len(text), np.int64)
    for f, n, t in zip(first.tolist(), starts, times, strict=True):
        wanted[f : f + n] = True
        weight[f : f + n] = t
    order = sorted_suffixes(text, wanted, length)
    group = np.cumsum(common_prefixes(text, order, length) < length)
    often = np.zeros(len(text), bool)
    often[order] = np.bincount(group, weight[order])[group] > 1
    return [np.flatnonzero(often[f : f + n]) for f, n in zip(first.tolist(), starts, strict=True)]


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate([[0], cuts + 1])].tolist(), at[np.append(cuts, len(at) - 1)].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _sorted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """(context_a, context_b, spans): the repeated starts of each context, from suffix sorting the contexts of each hash together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(block: list[tuple]) -> pa.RecordBatch:
            _, a, b, starts, times, data = zip(*block, strict=True)
            spans = [[{"low": x, "high": y} for x, y in _runs(at)] for at in repeated_starts(data, starts, times, length)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(spans, _SPANS)], ["context_a", "context_b", "spans"])

        block, group, size = [], [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if group and row[0] != group[0][0]:
                    if size > BLOCK_BYTES // 4:
                        yield found(block + group)
                        block, size = [], 0
                    else:
                        block += group
                    group = []
                if group and row[1:3] == group[-1][1:3]:
                    continue  # wholly equal rows cut the same context
                group.append(row)
                size += len(row[5])
        if group:
            yield found(block + group)

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select("hash", "context_a", "context_b", "starts", "times", "data").repartition(parts, "hash").sortWithinPartitions("hash", "context_a", "context_b")
    return rows.mapInArrow(task, "context_a long, context_b long, spans array<struct<low: int, high: int>>")


def _refiled(pieces: DataFrame, length: int, stretch: int) -> DataFrame:
    """Contexts cut by distance from their least gram, in stretches: (hash, context_a, context_b, starts, times, data, place, of_a, of_b, low).

    place is where the gram is, given for contexts that were cut before.
    All strings of a stretch have length - stretch + 1 bytes in common, whose
    hash, with the stretch, is the new one. In stretches of 1 that is the whole
    string, so no bytes are needed any more.
    """
    gram = min(GRAM, length)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "context_a", "context_b", "starts", "times", "data", "place", "of_a", "of_b", "low"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        for b in batches:
            out = []
            for least, of_a, of_b, starts, times, data, place in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if place is None:
                    place = int(np.flatnonzero(_grams(np.frombuffer(data, np.uint8), gram).view(np.int64) == least)[0])
                view = memoryview(data)
                for k in range((place - starts + 1) // stretch, place // stretch + 1):
                    low, high = max(0, place - (k + 1) * stretch + 1), min(starts - 1, place - k * stretch)
                    common = view[place - k * stretch : place - (k + 1) * stretch + 1 + length]
                    part = view[low : high + length]
                    digest = np.frombuffer(xxhash.xxh3_128_digest(part), "<i8").tolist()
                    key = np.uint64(xxhash.xxh3_64_intdigest(common, seed=k)).view(np.int64)
                    out.append((int(key), *digest, high - low + 1, times, bytes(part) if stretch > 1 else b"", place - low, of_a, of_b, low))
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "hash long, context_a long, context_b long, starts int, times long, data binary, place int, of_a long, of_b long, low int"
    return pieces.select("hash", "context_a", "context_b", "starts", "times", "data", "place").mapInArrow(task, schema)


def _spans(pieces: DataFrame, length: int, stretches: tuple[int, ...] = STRETCHES) -> DataFrame:
    """(context_a, context_b, spans): the repeated starts of each of the different contexts of hashes, (hash, context_a, context_b, starts, times, data, place)."""
    hot = pieces.groupBy("hash").agg(F.sum(F.octet_length("data")).alias("n")).filter(F.col("n") > BLOCK_BYTES).select("hash")
    hot = written(hot, "suffix-hot")
    few = _sorted_spans(pieces.join(if_small(hot), "hash", "left_anti"), length)
    if hot.isEmpty():
        return few
    stretch, *shorter = stretches
    many = pieces.join(if_small(hot), "hash", "left_semi").dropDuplicates(["hash", "context_a", "context_b"])
    parts = written(_refiled(many, length, stretch), "suffix-refiled")
    # in stretches of 1 a context is a string, so those under one hash are told apart by themselves
    group = ["hash", "context_a", "context_b"] if stretch == 1 else ["hash"]
    differ = (F.min("context_a") < F.max("context_a")) | (F.min("context_b") < F.max("context_b"))
    shared = written(parts.groupBy(*group).agg(F.sum("times").alias("n"), differ.alias("several")).filter("n > 1").drop("n"), "suffix-hashes")
    again = written(parts.join(if_small(shared), group), "suffix-shared")
    found = again.filter("not several").select("of_a", "of_b", F.struct("low", (F.col("low") + F.col("starts") - 1).alias("high")).alias("s"))
    if shorter:
        distinct = again.filter("several").groupBy("hash", "context_a", "context_b").agg(
            F.first("starts").alias("starts"), F.sum("times").alias("times"), F.first("data").alias("data"), F.first("place").alias("place")
        )
        inner = written(_spans(written(distinct, "suffix-distinct"), length, tuple(shorter)), "suffix-inner")
        within = again.filter("several").join(inner, ["context_a", "context_b"]).select("of_a", "of_b", "low", F.explode("spans").alias("t"))
        found = found.unionByName(within.select("of_a", "of_b", F.struct((F.col("low") + F.col("t.low")).alias("low"), (F.col("low") + F.col("t.high")).alias("high")).alias("s")))
    return few.unionByName(found.groupBy(F.col("of_a").alias("context_a"), F.col("of_b").alias("context_b")).agg(F.collect_list("s").alias("spans")))


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """(text_a, text_b, spans): for every text with repeated strings, spans of starts (low to high) of such strings."""
    rows = written(_context_rows(docs, id_col, text_col, length), "suffix-contexts")
    differ = (F.min("context_a") < F.max("context_a")) | (F.min("context_b") < F.max("context_b"))
    shared = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), differ.alias("several")).filter("n > 1").select("hash", "several")
    again = written(rows.join(if_small(written(shared, "suffix-hashes")), "hash"), "suffix-shared")
    distinct = again.filter("several").groupBy("hash", "context_a", "context_b").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "text_a", "text_b", "at", "starts")).alias("of")
    )
    pieces = written(_with_bytes(docs, written(distinct, "suffix-distinct"), id_col, text_col, length), "suffix-pieces")
    spans = written(_spans(pieces.withColumn("place", F.lit(None).cast("int")), length), "suffix-spans")

    where = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    whole = again.filter("not several").select("text_a", "text_b", where(F.col("at"), F.col("at") + F.col("starts") - 1).alias("span"))
    parts = (
        again.filter("several").select("text_a", "text_b", "at", "context_a", "context_b").distinct()
        .join(spans, ["context_a", "context_b"])
        .select("text_a", "text_b", "at", F.explode("spans").alias("s"))
        .select("text_a", "text_b", where(F.col("at") + F.col("s.low"), F.col("at") + F.col("s.high")).alias("span"))
    )
    found = whole.unionByName(parts).groupBy("text_a", "text_b").agg(F.collect_set("span").alias("spans"))
    return found.mapInArrow(_merged, found.schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of starts that touch become one; a text that repeats as a whole keeps a single one."""
    for b in batches:
        spans = [[{"low": x, "high": y - 1} for x, y in _joined(found, 1)] for found in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _SPANS)], ["text_a", "text_b", "spans"])


def _inside(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, shorter: int, length: int) -> DataFrame:
    """repeated_spans() for a length, from those for a shorter one.

    A repeated string lies in one run of bytes that shorter repeated strings
    cover, so only such runs, where they are long enough, are looked at again.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for row, (data, spans) in enumerate(zip(b.column(3), b.column(4).to_pylist(), strict=True)):
                view = memoryview(data.as_buffer())
                for low, high in _joined(spans, shorter):
                    if high - low >= length:
                        out.append((row, low, bytes(view[low:high])))
                        size += high - low
                if size > 8 << 20:
                    yield made(b, out)
                    out, size = [], 0
            if out:
                yield made(b, out)

    def made(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        row, low, text = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in range(3)), pa.array(low, pa.int32()), pa.array(text, pa.binary())], ["doc_id", "of_a", "of_b", "low", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), *_key(F.col(text_col)), F.col(text_col).cast("binary").alias("text"))
    rows = rows.join(if_small(found, BROADCAST_SPANS, "spans"), ["text_a", "text_b"]).select("doc_id", "text_a", "text_b", "text", "spans")
    runs = written(rows.mapInArrow(task, f"doc_id {kind}, of_a long, of_b int, low int, text binary"), "suffix-runs")
    again = written(repeated_spans(runs, "doc_id", "text", length), "suffix-texts")
    places = runs.select("of_a", "of_b", "low", *_key(F.col("text"))).distinct()
    moved = F.transform("spans", lambda s: F.struct((s["low"] + F.col("low")).alias("low"), (s["high"] + F.col("low")).alias("high")))
    placed = places.join(if_small(again, BROADCAST_SPANS, "spans"), ["text_a", "text_b"]).select("of_a", "of_b", moved.alias("spans"))
    return placed.groupBy(F.col("of_a").alias("text_a"), F.col("of_b").alias("text_b")).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, and n_shared, on request) of every document.

    Removed is every byte covered by a string of `length` bytes that starts
    anywhere else too, in another document or the same one. Null text counts as
    empty; texts shorter than `length` lose nothing. Copies of a whole text
    remove each other. Kept bytes need not be valid UTF-8 where a span cuts a
    character, hence binary. With a passage, shorter than length, n_shared has
    the bytes that repeated strings of so many bytes cover, which stay.
    """
    spans = written(repeated_spans(docs, id_col, text_col, passage or length), "suffix-texts")
    shared = spans.withColumnRenamed("spans", "shared")
    if passage:
        spans = written(_inside(docs, spans, id_col, text_col, passage, length), "suffix-texts")
    rows = docs.select(F.col(id_col).alias("doc_id"), *_key(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    joined = rows.join(if_small(spans, BROADCAST_SPANS, "spans"), ["text_a", "text_b"], "left")
    joined = joined.join(if_small(shared, BROADCAST_SPANS, "shared"), ["text_a", "text_b"], "left") if passage else joined.withColumn("shared", F.col("spans"))
    joined = joined.select("doc_id", "data", "spans", "shared")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, found, more in zip(b.column(1), b.column(2), b.column(3), strict=True):
                text = data.as_buffer()
                n, removed, runs, at, kept = text.size, 0, 0, 0, []
                view = memoryview(text)
                for low, high in _joined(found.as_py() or [], length):
                    kept.append(view[at:low])
                    removed, runs, at = removed + high - low, runs + 1, high
                kept = b"".join([*kept, view[at:]]) if runs else view
                extra = [sum(high - low for low, high in _joined(more.as_py() or [], passage))] if passage else []
                out.append((n, removed, runs, hashlib.sha256(kept).hexdigest(), *extra, *([bytes(kept)] if with_text else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.int64()] if passage else []), pa.binary()]
            columns = zip(*out, strict=True) if out else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_shared"] if passage else []), *(["kept"] if with_text else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(task, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_shared long" * bool(passage) + ", kept binary" * with_text)


def _joined(spans: list[dict], length: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of bytes (from, to) that the strings at the spans' starts cover."""
    last = None
    for low, high in sorted((s["low"], s["high"] + length) for s in spans):
        if last is not None and low <= last[1]:
            last = last[0], max(last[1], high)
        else:
            if last is not None:
                yield last
            last = low, high
    if last is not None:
        yield last
