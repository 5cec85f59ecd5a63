"""Exact join of documents whose word-shingle sets overlap: 100 * intersection >= 85 * union.

Shingles hash into groups; a document's group counts are a point, and the sum
of coordinate minima of two points bounds their overlap. Points are indexed in
packed R-trees, one for each part of the index, and a tree joined with itself
gives the pairs that the bound leaves, which alone are compared exactly.

Points of random documents of like size are near each other in any number of
dimensions, so a single tree would open nearly all of its nodes. The index is
therefore cut into parts by keys of which no two linked sets can differ in all:
sets that link differ in at most d = floor(15/185 * (size + size)) shingles.
With shingles hashed into d + 1 + z parts, at least 1 + z parts are equal in
both; so one is that isn't empty, unless both have more than z empty parts, and
such sets are hashed anew. Each equal, filled part is a key.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, removed, written
from .components import components
from .shingles import mix, shingle_sets

#: Words in a shingle; the similarity in hundredths.
WORDS, SIMILAR = 4, 85
#: Coordinates of a document's point, a power of two.
GROUPS = 256
#: Sizes are cut into classes, each reaching to GROWTH times the last one's end.
GROWTH = 1.4
#: Hashings tried until few parts are empty.
SEEDS = 6
#: Entries in a node of a tree, pairs bounded at once, and points in a tree; larger parts of the index are several trees.
FANOUT, PAIRS, TILE = 16, 1 << 14, 512
#: Points of small trees that are joined side by side.
FOREST = 1 << 12
#: Documents whose keys are looked at together.
SLICE = 1 << 10
#: Keys of a set whose parts are searched first.
HEADS = 4
#: Bytes of a key, keys that are counted together, and keys that a task brings in order at once (some 100 bytes of memory each).
KEY_BYTES, BUCKET_KEYS, SEND_KEYS = 6, 1 << 21, 1 << 18
#: Bits of the filter of shared keys for each of them, and of the whole filter at most; a fuller one lets more rows through.
FILTER_SHARE, FILTER_MOST = 12, 28
#: Points (some 200 bytes each, with what goes along) that are broadcast together.
POINT_ROWS = 150_000
#: Comparisons with one document that a task makes.
STAR_ROWS = 256

_SEED = np.random.default_rng(11).integers(1, 1 << 63, SEEDS, np.uint64) | np.uint64(1)
_SET = "struct<hi: long, lo: long>"


def most_apart(sizes: int, similar: int = SIMILAR) -> int:
    """Shingles in one set only, at most, if sets of so many together link."""
    return (100 - similar) * sizes // (100 + similar)


def least_common(sizes, similar: int = SIMILAR):
    """Shingles in common, at least, if sets of so many together link."""
    return -(-similar * sizes // (100 + similar))


@functools.cache
def _size_class(i: int, similar: int) -> tuple[int, int, int]:
    """(largest size, groups, empty groups allowed) of class i. Class 0 holds the sizes at which only equal sets link."""
    if i == 0:
        top = 1
        while most_apart(2 * top + 1, similar) == 0:
            top += 1
        return top, 0, 0
    low = _size_class(i - 1, similar)[0]
    top = max(low + 1, int(low * GROWTH))
    apart = most_apart(2 * top, similar)
    least = max(1, (low + 1) * similar // 100)
    empty = (apart + 1) * math.exp(-least / (apart + 1))
    allowed = math.ceil(empty + 1.5 * math.sqrt(empty))
    return top, apart + 1 + allowed, allowed


def block_keys(hashes: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """The keys of a set (sorted hashes)."""
    n, i = len(hashes), 0
    while _size_class(i, similar)[0] < n:
        i += 1
    classes = [i] if n * 100 // similar <= _size_class(i, similar)[0] else [i, i + 1]
    keys = []
    for c in classes:
        if c == 0:
            continue
        _, groups, allowed = _size_class(c, similar)
        for seed in range(SEEDS):
            h = hashes if seed == 0 else np.sort(mix(hashes * _SEED[seed]))
            group = ((h >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sums = np.add.reduceat(mix(h + np.uint64(1)), starts)
            place = np.uint64((c * SEEDS + seed) << 32)
            keys.append(mix(sums + (group[starts] + place) * np.uint64(0x9E3779B97F4A7C15)))
            if groups - len(starts) <= allowed:
                break
            if seed == SEEDS - 1:
                none = np.setdiff1d(np.arange(groups, dtype=np.uint64), group[starts])
                keys.append(mix((none + place) * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def point(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many shingles of a set fall into each group; of half as many groups, each has two neighbours' shingles."""
    return np.bincount((hashes >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def fine_point(hashes: np.ndarray) -> bytes:
    """A point with one or two shingles a group, GROUPS groups at least, behind the number of groups and of shingles.

    Over GROUPS groups any two sets of some thousand shingles look alike.
    """
    groups = max(GROUPS, 1 << (len(hashes) // 2 - 1).bit_length())
    return np.array([groups, len(hashes)], np.int64).tobytes() + packed(point(hashes, groups))


def fine_counts(data: bytes) -> tuple[int, np.ndarray]:
    """Size and counts of a fine_point()."""
    groups, size = np.frombuffer(data, np.int64, 2).tolist()
    flat = np.frombuffer(data, np.uint8, offset=16)
    if len(flat) == groups // 2:
        return size, np.stack([flat & 15, flat >> 4], axis=1).ravel().astype(np.int64)
    return size, (flat if len(flat) == groups else flat.view(np.uint32)).astype(np.int64)


def may_link(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], similar: int = SIMILAR) -> bool:
    """Whether the summed minima of two points, over the groups of the coarser one, reach the overlap that the sets need."""
    groups = min(len(a[1]), len(b[1]))
    x, y = (counts.reshape(groups, -1).sum(1) for _, counts in (a, b))
    return int(np.minimum(x, y).sum()) >= least_common(a[0] + b[0], similar)


def do_link(a: np.ndarray, b: np.ndarray, similar: int = SIMILAR) -> bool:
    """Whether two sets (sorted hashes) link."""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common * 100 >= similar * (len(a) + len(b) - common)


def packed(counts: np.ndarray) -> bytes:
    """Half a byte a coordinate where that is enough, else one, else four."""
    most = counts.max()
    if most < 16:
        return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return counts.astype(np.uint8 if most < 256 else np.uint32).tobytes()


def unpacked(column: pa.Array) -> np.ndarray:
    """Points as rows of numbers."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)
    width = np.diff(offsets)
    out = np.zeros((len(column), GROUPS), np.int32 if (width > GROUPS).any() else np.int16)
    half, whole = np.flatnonzero(width == GROUPS // 2), np.flatnonzero(width == GROUPS)
    two = data[offsets[half][:, None] + np.arange(GROUPS // 2)]
    out[half[:, None], np.arange(0, GROUPS, 2)], out[half[:, None], np.arange(1, GROUPS, 2)] = two & 15, two >> 4
    out[whole] = data[offsets[whole][:, None] + np.arange(GROUPS)]
    for i in np.flatnonzero(width > GROUPS).tolist():
        out[i] = data[offsets[i] : offsets[i + 1]].view(np.uint32)
    return out


class Forest:
    """Packed R-trees, side by side: points of each tree in order of size and of their first coordinates, nodes of FANOUT entries, level upon level.

    A node has the greatest coordinates and the least and greatest size of what
    is in it, and its label if all have the same, else -1.
    """

    def __init__(self, trees: np.ndarray, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((*points[:, :3].T, sizes, trees))
        tree = trees[self.order]
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order], labels[self.order])]
        #: of each level but the lowest where each node's entries begin in the level below, and one more
        self.entries: list[np.ndarray] = []
        while len(tree) > 1 and (tree[1:] == tree[:-1]).any():
            corner, low, high, label = self.levels[-1]
            first = np.searchsorted(tree, tree)
            at = np.flatnonzero((np.arange(len(tree)) - first) % FANOUT == 0)
            least, most = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            self.levels.append((np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.where(least == most, least, -1)))
            self.entries.append(np.append(at, len(tree)))
            tree = tree[at]

    def joined(self, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bound) of the pairs within trees and of unlike labels whose summed minima reach the overlap that they need."""
        i = j = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            if depth < len(self.levels) - 1:
                i, j = self._children(self.entries[depth], i, j)
            parts = [self._near(self.levels[depth], i[k : k + PAIRS], j[k : k + PAIRS], depth == 0, similar) for k in range(0, len(i), PAIRS)]
            i, j, bound = (np.concatenate([part[c] for part in parts]) if parts else np.empty(0, np.int64) for c in range(3))
        return self.order[i], self.order[j], bound

    @staticmethod
    def _children(entries: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of entries of paired nodes, each once."""
        a, b = entries[i + 1] - entries[i], entries[j + 1] - entries[j]
        pair = np.repeat(np.arange(len(i)), a * b)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(a * b) - a * b, a * b)
        i, j = entries[i][pair] + at // b[pair], entries[j][pair] + at % b[pair]
        keep = i <= j
        return i[keep], j[keep]

    @staticmethod
    def _near(level: tuple, i: np.ndarray, j: np.ndarray, points: bool, similar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        corner, low, high, label = level
        keep = ((label[i] == -1) | (label[i] != label[j])) & (low[j] * similar <= high[i] * 100) & (low[i] * similar <= high[j] * 100)
        if points:
            keep &= i < j
        i, j = i[keep], j[keep]
        bound = np.minimum(corner[i], corner[j]).sum(1, dtype=np.int64)
        keep = bound >= least_common(low[i] + low[j], similar)
        return i[keep], j[keep], bound[keep]


def document_sets(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, text_a, n_shingles, set_id, point, keys): what the index needs of every document, without its shingles.

    set_id has the sums of two hashes over the set, so it stands for the set; text_a is a hash of the text; keys are KEY_BYTES each.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, high, low, points, keys = [], [], [], [], []
            for h in shingle_sets(b.column(2), words):
                sizes.append(len(h))
                high.append(mix(h * _SEED[1]).sum(dtype=np.uint64))
                low.append(mix(h * _SEED[2]).sum(dtype=np.uint64))
                points.append(packed(point(h)))
                keys.append(block_keys(h, similar).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), _sets(_signed(np.array(high, np.uint64)), _signed(np.array(low, np.uint64))),
                 pa.array(points, pa.binary()), pa.array(keys, pa.binary())],
                ["doc_id", "text_a", "n_shingles", "set_id", "point", "keys"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_a"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"doc_id {kind}, text_a long, n_shingles long, set_id {_SET}, point binary, keys binary")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _sets(high: np.ndarray, low: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["hi", "lo"])


def _halves(column: pa.StructArray) -> np.ndarray:
    """Set ids as rows of two numbers."""
    return np.stack([v.to_numpy(zero_copy_only=False) for v in column.flatten()], axis=1)


def _block_keys(column: pa.BinaryArray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of packed keys: a key's bucket in the high half of a number, 32 of its other bits in the low one."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    wide = np.zeros((len(flat) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = flat.reshape(-1, KEY_BYTES)
    whole = wide.view(np.uint64).ravel()
    n = np.uint64(buckets)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // KEY_BYTES), (whole % n) << np.uint64(32) | (whole // n) & np.uint64(0xFFFFFFFF)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most, for a row has hundreds of keys."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _shared_keys(sets: DataFrame, buckets: int) -> DataFrame:
    """(key): all keys that more than one set has.

    Tasks send a bucket's keys as numbers of 32 bits of the key and of a hash of
    set and key, so that two sets do not look like one in all of their keys; of
    a key with several sets among SEND_KEYS, once, marked as shared (0). So a
    bucket holds about BUCKET_KEYS of them, whatever sets are alike.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            key, of = (np.concatenate(v) for v in zip(*held, strict=True))
            key, of = _once(key, of)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)]))
            pair = key << np.uint64(32) | of
            return pa.RecordBatch.from_arrays(
                [pa.array((key[starts] >> np.uint64(32)).astype(np.int64)), pa.array([x.tobytes() for x in np.split(pair, starts[1:])], pa.binary())], ["bucket", "pairs"]
            )

        held, count = [], 0
        for b in _slices(batches):
            row, key = _block_keys(b.column(1), buckets)
            if len(key):
                tag = mix(_halves(b.column(0))[:, 0].view(np.uint64)[row] ^ key) >> np.uint64(32)
                held.append((key, np.maximum(tag, np.uint64(1)).astype(np.uint32)))
                count += len(key)
            if count >= SEND_KEYS:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: int, packed_pairs: list[bytes]) -> pa.RecordBatch:
            pair = np.sort(np.frombuffer(b"".join(packed_pairs), np.uint64))
            first = np.append(True, pair[1:] >> np.uint64(32) != pair[:-1] >> np.uint64(32))
            least, most = pair[first], pair[np.append(first[1:], True)]
            key = least[(least != most) | (least & np.uint64(0xFFFFFFFF) == 0)] >> np.uint64(32)
            return pa.RecordBatch.from_arrays([pa.array((key | np.uint64(bucket << 32)).view(np.int64))], ["key"])

        at, held = None, []
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and bucket != at:
                    yield found(at, held)
                    held = []
                at = bucket
                held.append(data)
        if held:
            yield found(at, held)

    sent = sets.filter("n_shingles > 0").select("set_id", "keys").mapInArrow(send, "bucket long, pairs binary")
    parts = max(buckets, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "key long")


def _once(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every key once, in order, with its set, or 0 if it has several."""
    order = np.lexsort((of, key))
    key, of = key[order], of[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(key)) - 1
    return key[starts], np.where(of[starts] == of[ends], of[starts], 0).astype(np.uint32) if len(key) else of


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that a key sets."""
    h = mix(keys.astype(np.uint64))
    return h & np.uint64((1 << bits) - 1), h >> np.uint64(64 - bits)


def _key_filter(shared: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the keys and its size in bits as a power of two; executors put it together word by word."""
    bits = min(FILTER_MOST, max(16, math.ceil(math.log2(FILTER_SHARE * shared.count() + 1))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column(0).to_numpy(), bits)))
            word, starts = np.unique(at >> np.uint64(6), return_index=True)
            ones = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(_signed(ones))], ["word", "ones"])

    words = shared.mapInArrow(task, "word long, ones long").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["ones"].to_numpy()
    return out.view(np.uint8), bits


def _members(sets: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(key, set_id, n_shingles, point): keys of sets, less most of those that only one set has.

    The point is there for the HEADS smallest keys of a set, which like sets
    mostly have in common; their parts of the index are searched first. A task
    sends a set's keys once, however many copies of it there are.
    """
    found, bits = _key_filter(shared)
    known = sets.sparkSession.sparkContext.broadcast(found)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, seen = known.value, set()
        for b in _slices(batches):
            before = len(seen)
            new = [i for i, s in enumerate(map(tuple, _halves(b.column(0)).tolist())) if s not in seen and not seen.add(s)]
            if len(seen) == before:
                continue
            b = b.take(pa.array(new))
            row, key = _block_keys(b.column(3), buckets)
            keep = np.ones(len(key), bool)
            for place in _places(key, bits):
                keep &= (ones[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            row, key = row[keep], key[keep]
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            begin = np.searchsorted(row, row)
            points = b.column(2).take(pa.array(row, mask=np.arange(len(row)) - begin >= HEADS))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(key)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), points], ["key", "set_id", "n_shingles", "point"])

    rows = sets.filter("n_shingles > 0").select("set_id", "n_shingles", "point", "keys")
    return rows.mapInArrow(task, f"key long, set_id {_SET}, n_shingles long, point binary")


def shared_parts(members: DataFrame) -> DataFrame:
    """(key, set_id, head, n) of the parts with several sets, n of them; head: whether the key is one of the set's first.

    Rows travel once, by key: copies of a row, sets of a part and single sets are all found where they arrive.
    """
    rows = members.select("key", "set_id", F.col("point").isNotNull().alias("head")).repartition("key")
    once = rows.groupBy("key", "set_id").agg(F.max("head").alias("head"))
    return once.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")


def _paired_texts(docs: DataFrame, pairs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set_id, to, text) of each set in some of the distinct pairs (a, b): `to` are the places (a, salt, role) where it is compared.

    A set b (role 1) goes to its partner a, which is there itself (role 0) for
    every STAR_ROWS partners, so a set in very many pairs is spread over tasks.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR_ROWS)).cast("int").alias("salts"))
    roles = (
        pairs.join(salts, "a")
        .select(F.col("b").alias("set_id"), F.struct("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role")).alias("to"))
        .unionByName(salts.select(F.col("a").alias("set_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
                     .select("set_id", F.struct(F.col("set_id").alias("a"), "salt", F.lit(0).alias("role")).alias("to")))
        .groupBy("set_id", F.pmod(F.hash("to.a"), F.lit(64)).alias("part")).agg(F.collect_list("to").alias("to"))
    )
    wanted = written(roles.join(classes, "set_id").select("set_id", "first", "to"), "join-wanted")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_a"), F.col(text_col).alias("text"))
    rows = rows.join(if_small(wanted, items="to"), F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_a") == F.col("first.text_a")))
    return rows.select("set_id", "to", "text")


def _compared(rows: DataFrame, values, kept) -> DataFrame:
    """Pairs (a, b) of rows (set_id, to, data) of which `kept` says so, given what `values` makes of both data."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, own = None, None
        for b in batches:
            out = []
            for i, (a, salt, role, value) in enumerate(zip(map(tuple, _halves(b.column(0)).tolist()), b.column(1).to_pylist(), b.column(2).to_pylist(), values(b.column(4)), strict=True)):
                if role == 0:
                    star, own = (a, salt), value
                elif (a, salt) == star and kept(own, value):
                    out.append(i)
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out)), b.column(3).take(pa.array(out))], ["a", "b"])

    sent = rows.select("data", "set_id", F.explode("to").alias("to")).select("to.a", "to.salt", "to.role", "set_id", "data")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(compare, f"a {_SET}, b {_SET}").distinct()


def likely(docs: DataFrame, pairs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """Of distinct pairs (a, b) of set ids, those that their fine points leave, which are a tenth or less of their texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = pa.array([fine_point(h) for h in shingle_sets(b.column(2), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fine], ["set_id", "to", "data"])

    rows = _paired_texts(docs, pairs, classes, id_col, text_col)
    rows = rows.mapInArrow(task, f"set_id {_SET}, to array<struct<a: {_SET}, salt: int, role: int>>, data binary")
    return _compared(rows, lambda column: map(fine_counts, column.to_pylist()), functools.partial(may_link, similar=similar))


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """Of distinct pairs (a, b) of set ids, those whose sets link, compared exactly.

    Only texts in some pair are shingled again, where they are compared: they
    are shorter than their shingles' hashes.
    """
    rows = _paired_texts(docs, pairs, classes, id_col, text_col).withColumnRenamed("text", "data")
    return _compared(rows, functools.partial(shingle_sets, words=words), functools.partial(do_link, similar=similar))


def _tree_pairs(rows: DataFrame, part: list[str], found, schema: str, similar: int) -> DataFrame:
    """What `found` makes of the self-join of each part's tree: of (first columns of part, set ids, sizes, i, j, bounds, extra).

    Rows are (*part, set_id, label, n_shingles, point, extra).
    """
    width = len(part)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def searched(t: pa.Table) -> Iterator[pa.RecordBatch]:
            number = np.cumsum(_changes(t))
            several = np.flatnonzero(np.bincount(number)[number] > 1)
            if not len(several):
                return
            number = number[several]
            keys = t.column(0).to_numpy()[several]
            ids, labels, sizes, points, extra = (t.column(width + k).combine_chunks().take(pa.array(several)) for k in range(5))
            ids = _halves(ids)
            labels = np.unique(np.ascontiguousarray(_halves(labels)).view("V16").ravel(), return_inverse=True)[1]
            sizes = sizes.to_numpy(zero_copy_only=False)
            i, j, bound = Forest(number, unpacked(points), sizes, labels).joined(similar)
            if len(i):
                yield found(keys, ids, sizes, i, j, bound, extra)

        def _changes(t: pa.Table) -> np.ndarray:
            """Where a part begins."""
            change = np.zeros(t.num_rows, bool)
            for k in range(width):
                v = t.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            return change

        held = None
        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows >= FOREST:
                begins = np.flatnonzero(_changes(held))
                if len(begins):
                    yield from searched(held.slice(0, begins[-1]))
                    held = held.slice(begins[-1])
        if held is not None and held.num_rows:
            yield from searched(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*part, "set_id", "label", "n_shingles", "point", "extra"]
    return rows.select(*columns).repartition(parts, *part).sortWithinPartitions(*part).mapInArrow(task, schema)


def nearest_partners(inside: DataFrame, points: DataFrame, similar: int) -> DataFrame:
    """(a, b): for every set, by the trees of its first keys' parts, the set with the greatest bound and the likeliest centre of its group.

    A part's centre is its member with the most neighbours over all its parts:
    the text that a group of near copies was made from, if it is there. Parts
    with more than TILE sets are several trees, each with the centre in it.
    """
    scores = inside.groupBy("set_id").agg(F.sum("n").alias("score"))
    heads = written(inside.filter("head").join(scores, "set_id").select("key", "set_id", "score"), "join-heads")
    centres = heads.groupBy("key").agg(F.max_by("set_id", F.struct("score", "set_id")).alias("middle"), F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("tiles"))
    centres = written(centres, "join-centres")
    members = heads.join(if_small(centres), "key").filter(F.col("set_id") != F.col("middle"))
    members = members.select("key", F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int").alias("tile"), "set_id", F.lit(False).alias("extra"))
    middles = centres.select("key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("middle").alias("set_id"), F.lit(True).alias("extra"))
    rows = members.unionByName(middles).join(if_small(points, POINT_ROWS), "set_id").withColumn("label", F.col("set_id"))

    def found(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray, extra: pa.Array) -> pa.RecordBatch:
        centre = extra.to_numpy(zero_copy_only=False)
        of, to = np.concatenate([i, j]), np.concatenate([j, i])
        like = np.tile(bound / (sizes[i] + sizes[j] - bound), 2)
        middle = centre[to]
        order = np.lexsort((to, like, middle, of))
        of, to, like, middle = of[order], to[order], like[order], middle[order]
        last = np.concatenate([(of[1:] != of[:-1]) | (middle[1:] != middle[:-1]), [True]])
        of, to = of[last], to[last]
        return pa.RecordBatch.from_arrays([_sets(*ids[of].T), _sets(*ids[to].T), pa.array(middle[last]), pa.array(like[last])], ["b", "a", "centre", "like"])

    found_rows = _tree_pairs(rows, ["key", "tile"], found, f"b {_SET}, a {_SET}, centre boolean, like double", similar)
    ties = found_rows.groupBy("b", "centre", "a").agg(F.count(F.lit(1)).alias("n"), F.max("like").alias("like"))
    best = ties.groupBy("b", "centre").agg(F.max_by("a", F.struct(F.when(F.col("centre"), F.col("n")), "like", "a")).alias("a"))
    return best.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "centre", "a", "b").groupBy("x", "y").agg(F.max_by(F.struct("a", "b"), "centre").alias("p")).select("p.a", "p.b")


def pairing_parts(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(key): the parts of rows (key, set_id) that may have pairs of their own, with heads (set_id, heads) the first keys of each set.

    If all sets of a part have the same key, of a lower number, at one place of
    their heads, unlike_pairs() makes every pair of them in another part.
    """
    each = rows.join(if_small(heads), "set_id").select("key", *(F.element_at("heads", i + 1).alias(f"h{i}") for i in range(HEADS)))
    ends = each.groupBy("key").agg(*(f(f"h{i}").alias(f"{f.__name__}{i}") for i in range(HEADS) for f in (F.min, F.max)))
    elsewhere = functools.reduce(Column.__or__, ((F.col(f"min{i}") == F.col(f"max{i}")) & (F.col(f"max{i}") < F.col("key")) for i in range(HEADS)))
    return ends.filter(~elsewhere).select("key")


def unlike_pairs(rows: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of unlike components that the trees leave, from rows (key, set_id, label, n_shingles, point, heads, tiles).

    heads are the first keys of a set among all rows. Two sets that have some of
    those in common are a pair only in the part of the first of them.
    """
    tile = F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, tile).alias("low"), F.greatest(t, tile).alias("high")))
    dealt = rows.select("key", F.explode(both).alias("t"), "set_id", "label", "n_shingles", "point", F.col("heads").alias("extra")).select("key", "t.low", "t.high", "*").drop("t")

    def found(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray, extra: pa.Array) -> pa.RecordBatch:
        heads = extra.flatten().to_numpy().reshape(-1, HEADS)
        keep = []
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            common = (heads[a][:, :, None] == heads[b][:, None, :]) & (heads[a] < keys[a][:, None])[:, :, None]
            keep.append(~common.any((1, 2)))
        keep = np.concatenate(keep)
        i, j = i[keep], j[keep]
        number = np.unique(np.ascontiguousarray(ids).view("V16").ravel(), return_inverse=True)[1]
        once = np.unique(np.minimum(number[i], number[j]) * len(ids) + np.maximum(number[i], number[j]), return_index=True)[1]
        i, j = i[once], j[once]
        return pa.RecordBatch.from_arrays([_sets(*ids[i].T), _sets(*ids[j].T)], ["a", "b"])

    pairs = _tree_pairs(dealt, ["key", "low", "high"], found, f"a {_SET}, b {_SET}", similar)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, text_a, n_shingles, comp) of every row: a set id for its component of links, null for texts without words; text_a is a hash of the text.

    Null and wordless texts have no shingles and link with nothing. Rows with
    equal sets are in one component, whatever their number and ids, and stand as
    one set from there on; rows that share an id but not their text may be in
    two. No link is lost: no two linked sets differ in all keys, no part of the
    index is capped, and every pair that may join two components is compared
    exactly.

    Round one takes each set's nearest partner and its centre by the trees of
    its first keys; what then lies in one component needs no more. Round two
    joins the trees of all other parts that hold unlike components; few of its
    pairs link, so their fine points are compared before their texts.
    """
    sets = written(document_sets(docs, id_col, text_col, words, similar), "join-sets")
    classes = written(sets.filter("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "text_a")).alias("first")), "join-classes")
    keys = sets.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    buckets = max(1, -(-keys // (KEY_BYTES * BUCKET_KEYS)))
    shared = written(_shared_keys(sets, buckets), "join-shared")
    members = written(_members(sets, shared, buckets), "join-members")
    keyed, sets = sets, written(sets.drop("keys"), "join-sets")
    removed(keyed)
    inside = written(shared_parts(members), "join-inside")
    points = members.filter("point is not null").groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("point").alias("point"))
    points = written(points, "join-points")
    removed(members)
    first = written(nearest_partners(inside, points, similar), "join-pairs")
    edges = written(verified(docs, first, classes, id_col, text_col, words, similar), "join-links")
    comps = components(edges)

    placed = inside.select("key", "set_id").join(if_small(comps), F.col("set_id") == F.col("node"), "left").select("key", "set_id", F.coalesce("comp", "set_id").alias("label"))
    placed = written(placed, "join-placed")
    removed(inside)
    unlike = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    unlike = written(unlike.filter("low < high").select("key", F.ceil(F.col("n") / F.lit(TILE)).cast("int").alias("tiles")), "join-unlike")
    mixed = written(placed.join(if_small(unlike), "key"), "join-mixed")
    removed(placed)
    first_keys = F.slice(F.concat(F.array_sort(F.collect_list("key")), F.array_repeat(F.lit((1 << 63) - 1), HEADS)), 1, HEADS)
    heads = written(mixed.groupBy("set_id").agg(first_keys.alias("heads")), "join-mixed-sets")
    every, mixed = mixed, written(mixed.join(if_small(written(pairing_parts(mixed, heads), "join-open")), "key"), "join-mixed")
    removed(every)
    heads = heads.join(if_small(written(mixed.select("set_id").distinct(), "join-mixed-sets")), "set_id")
    points = sets.join(if_small(heads), "set_id").groupBy("set_id").agg(*(F.first(c).alias(c) for c in ("n_shingles", "point", "heads")))
    points = written(points, "join-points")
    pairs = written(unlike_pairs(mixed.join(if_small(points, POINT_ROWS), "set_id"), similar), "join-pairs")
    removed(mixed)
    pairs = written(likely(docs, pairs, classes, id_col, text_col, words, similar), "join-likely")
    more = written(verified(docs, pairs, classes, id_col, text_col, words, similar), "join-links")
    comps = written(components(edges.unionByName(more)), "join-comps")
    return sets.select("doc_id", "text_a", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id")).join(
        if_small(comps), F.col("set_id") == F.col("node"), "left"
    ).select("doc_id", "text_a", "n_shingles", F.coalesce("comp", "set_id").alias("comp"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id in its component, by jaccard_groups().

    Texts without words are components of their own. A null id takes part and
    gets the component of what it links to. No rows: no rows.
    """
    found = written(jaccard_groups(docs, id_col, text_col, words, similar), "join-groups")
    least = found.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return found.join(if_small(written(least, "join-least")), "comp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
