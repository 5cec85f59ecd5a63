from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from peakloom.llm import shingles as shingles_of
from peakloom.llm.components import components
from peakloom.llm import ngramjoin
from peakloom.llm.ngramjoin import GROUPS, HEADS, Forest, block_keys, jaccard_components, least_common, pairing_parts, point

from .conftest import ODD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, words=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(docs, words=4, similar=85):
    """Component of every id, from all pairs."""
    ids = sorted({d[0] for d in docs if d[0] is not None})
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(d[0], shingles(d[1], words)) for d in docs if d[0] is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= similar * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i in ids}


def near_copies():
    rng = random.Random(4)
    docs, n = [], 0
    for base in range(25):
        words = prose(rng.choice([3, 4, 5, 9, 14, 40, 80, 200]), base + 500).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            docs.append((n, " ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)))
            n += 1
    shared = prose(50, 77)
    docs += [(n + i, prose(rng.randint(5, 60), 900 + i) + " " + shared) for i in range(40)]
    chain = prose(100, 78).split()
    docs += [(n + 100 + i, " ".join(chain[i : i + 90])) for i in range(11)]
    return docs


def test_against_all_pairs(docs_of):
    docs = [*near_copies(), *((None if d[0] is None else d[0] + 5000, *d[1:]) for d in ODD)]
    rows = jaccard_components(docs_of(docs)).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == brute(docs)
    sizes = {(d[0], len(shingles(d[1]))) for d in docs}
    assert {(r.doc_id, r.n_shingles) for r in rows} == sizes
    assert {r.component_id for r in rows if r.doc_id is None and r.n_shingles} == {5007}


def test_very_long_texts_are_hashed_in_parts(monkeypatch):
    texts = pa.array([prose(3000, 5), "x" * 5000 + " y  \n" + "z" * 700, "", None, " " * 999 + "a b c d e"])
    whole = [s.tolist() for s in shingles_of.shingle_sets(texts, 4)]
    for most in (1, 7, 100, 4096):
        monkeypatch.setattr(shingles_of, "CHUNK_BYTES", 1)
        monkeypatch.setattr(shingles_of, "PART_BYTES", most)
        assert [s.tolist() for s in shingles_of.shingle_sets(texts, 4)] == whole


def test_empty(none):
    assert jaccard_components(none).count() == 0


def test_linked_sets_always_share_a_block():
    rng = np.random.default_rng(8)
    for n in [*range(1, 40), 57, 99, 100, 101, 180, 400, 999]:
        for _ in range(12):
            base = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            cut = rng.integers(0, max(1, int(0.16 * n)) + 1)
            more = rng.integers(0, 1 << 63, rng.integers(0, max(1, int(0.16 * n)) + 1), np.uint64)
            other = np.unique(np.concatenate([rng.permutation(base)[cut:], more]))
            common = len(np.intersect1d(base, other))
            if common and 100 * common >= 85 * (len(base) + len(other) - common) and not np.array_equal(base, other):
                assert len(np.intersect1d(block_keys(base), block_keys(other))), n


@pytest.mark.parametrize("trees", [1, 5, 70])
def test_the_trees_lose_no_pair(trees):
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(20, 200), np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[: len(s) - 2], rng.integers(0, 1 << 63, 2, np.uint64)])) for s in sets]
    points, sizes = np.stack([point(s) for s in sets]).astype(np.int64), np.array([len(s) for s in sets])
    tree = rng.integers(0, trees, len(sets)) if trees > 1 else np.zeros(len(sets), int)
    for labels in (np.arange(len(sets)), np.arange(len(sets)) % 60 // 2):
        forest = Forest(tree, points, sizes, labels)
        found = [(*sorted((int(x), int(y))), int(n)) for x, y, n in zip(*forest.joined(), strict=True)]
        overlap = {(x, y): int(np.minimum(points[x], points[y]).sum()) for y in range(len(sets)) for x in range(y) if labels[x] != labels[y] and tree[x] == tree[y]}
        assert sorted(found) == sorted((x, y, n) for (x, y), n in overlap.items() if n >= least_common(sizes[x] + sizes[y]))
        assert len(forest.levels) == (2 if trees == 70 else 3)
    assert points.shape[1] == GROUPS


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(9, i) for i in range(30)] + [(100, 101), (101, 102)]])
def test_components(spark, edges):
    parent = {n: n for e in edges for n in e}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {n: top(n) for n in parent}


def test_points_of_all_widths_come_back():
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, most, ngramjoin.GROUPS) for most in (2, 16, 17, 256, 257, 100_000, 1)]
    for some in (rows, rows[:2], rows[2:4], rows[:1]):
        assert np.array_equal(ngramjoin.unpacked(pa.array([ngramjoin.packed(r) for r in some], pa.binary())), np.stack(some))
    assert [len(ngramjoin.packed(r)) for r in rows] == [128, 128, 256, 256, 1024, 1024, 128]


def test_parts_whose_pairs_are_made_elsewhere(spark):
    """Sets that share an earlier head, at one place, leave no pair to a later part; one set without it does."""

    def kept(rows):
        frame = spark.createDataFrame([(k, s) for s, keys in rows.items() for k in keys], "key long, set_id long")
        heads = spark.createDataFrame([(s, (sorted(keys) + [(1 << 63) - 1] * HEADS)[:HEADS]) for s, keys in rows.items()], "set_id long, heads array<long>")
        return {r.key for r in pairing_parts(frame, heads).collect()}

    assert kept({1: [5, 9], 2: [5, 9], 3: [5, 9]}) == {5}
    assert kept({1: [5, 9], 2: [5, 9], 3: [5, 9], 4: [9]}) == {5, 9}
    assert kept({1: [2, 7, 9], 2: [3, 7, 9]}) >= {7} and 9 not in kept({1: [2, 7, 9], 2: [3, 7, 9]})
    assert kept({1: [-4, 9], 2: [9], 3: [-4, 9]}) >= {9, -4}


def test_fine_points_bound_the_overlap_of_long_texts():
    """Unlike sets of thousands pass over GROUPS groups, which sent their whole texts; over fine ones they don't, and no link is lost."""
    rng = np.random.default_rng(12)
    for n in (1, 3, 300, 900, 3000, 9000):
        base = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for share in (0.0, 0.5, 0.8, 0.9, 0.95, 1.0):
            other = np.unique(np.concatenate([base[rng.random(len(base)) < share], rng.integers(0, 1 << 63, round(n * (1 - share)), np.uint64)]))
            if not len(other):
                continue
            a, b = (ngramjoin.fine_counts(ngramjoin.fine_point(h)) for h in (base, other))
            assert (a[0], b[0]) == (len(base), len(other)) and (a[1].sum(), b[1].sum()) == (a[0], b[0])
            groups = min(len(a[1]), len(b[1]))
            bound = np.minimum(*(c.reshape(groups, -1).sum(1) for _, c in (a, b))).sum()
            assert bound >= len(np.intersect1d(base, other))
            assert ngramjoin.may_link(a, b, 80) >= ngramjoin.do_link(base, other, 80)
            if n == 9000 and share <= 0.5:
                assert np.minimum(point(base), point(other)).sum() >= least_common(len(base) + len(other), 80)
                assert not ngramjoin.may_link(a, b, 80)
    crowded = np.arange(40_000, dtype=np.uint64)  # all in one group: four bytes a coordinate
    assert ngramjoin.fine_counts(ngramjoin.fine_point(crowded))[1].tolist()[:2] == [40_000, 0]
    assert ngramjoin.may_link(*[ngramjoin.fine_counts(ngramjoin.fine_point(h)) for h in (crowded, crowded[:35_000])])


def test_of_pairs_of_long_texts_only_likely_ones_are_compared_whole(docs_of, monkeypatch):
    """Of a star with more partners than STAR_ROWS, the one that links comes through, and so does a copy under another id."""
    monkeypatch.setattr(ngramjoin, "STAR_ROWS", 2)
    words = prose(6000, 50).split()
    texts = [" ".join(words), " ".join([*words[:5900], *prose(100, 51).split()]), *(" ".join([*words[:2000], *prose(4000, 60 + i).split()]) for i in range(4)), " ".join(words)]
    docs = docs_of([(i, t) for i, t in enumerate(texts)])
    sets = ngramjoin.document_sets(docs, "doc_id", "text")
    classes = sets.groupBy("set_id").agg(ngramjoin.F.min(ngramjoin.F.struct("doc_id", "text_a")).alias("first"))
    names = {r.set_id: r.first.doc_id for r in classes.collect()}
    star = next(k for k, v in names.items() if v == 0)
    pairs = docs.sparkSession.createDataFrame([(star, s) for s in names if s != star], f"a {ngramjoin._SET}, b {ngramjoin._SET}")
    assert pairs.count() == 5
    left = ngramjoin.likely(docs, pairs, classes, "doc_id", "text")
    assert [(names[r.a], names[r.b]) for r in left.collect()] == [(0, 1)]
    whole = [(names[r.a], names[r.b]) for r in ngramjoin.verified(docs, pairs, classes, "doc_id", "text").collect()]
    assert whole == [(0, 1)] == [(0, i) for i in range(1, 6) if 100 * len(shingles(texts[0]) & shingles(texts[i])) >= 85 * len(shingles(texts[0]) | shingles(texts[i]))]


def test_rows_of_the_keys_travel_once(spark):
    """Copies, single sets and sizes of parts are told apart behind one shuffle; it took three, which grew faster than the input."""
    rows = [(5, (1, 1), 9, b"p"), (5, (1, 1), 9, None), (5, (2, 2), 9, None), (6, (1, 1), 9, b"p"), (6, (1, 1), 9, b"p"), (7, (3, 3), 9, None), (-1, (2, 2), 9, b"p"), (-1, (3, 3), 9, b"p"), (-1, (4, 4), 9, None)]
    found = ngramjoin.shared_parts(spark.createDataFrame(rows, f"key long, set_id {ngramjoin._SET}, n_shingles long, point binary"))
    assert sorted((r.key, r.set_id.hi, r["head"], r.n) for r in found.collect()) == [(-1, 2, True, 3), (-1, 3, True, 3), (-1, 4, False, 3), (5, 1, True, 2), (5, 2, False, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan.split("Initial Plan")[-1])) == 1 and "Join" not in plan


def test_keys_are_sent_in_bounded_memory(spark, monkeypatch):
    """The keys that sets share are those of a plain count, however few keys are brought in order at once; two million at once took some 200 MB of each worker."""
    assert ngramjoin.SEND_KEYS <= ngramjoin.BUCKET_KEYS // 8
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 600, 40, np.uint64) for _ in range(12)]
    rows = [((i + 1, i), 40, bytearray(k.view(np.uint8).reshape(-1, 8)[:, : ngramjoin.KEY_BYTES].tobytes())) for i, k in enumerate(keys)] + [((1, 0), 40, bytearray(keys[0].view(np.uint8).reshape(-1, 8)[:, : ngramjoin.KEY_BYTES].tobytes()))]
    sets = spark.createDataFrame(rows, f"set_id {ngramjoin._SET}, n_shingles long, keys binary").repartition(2)
    number = np.concatenate([np.unique(k) for k in keys])
    values, counts = np.unique(number, return_counts=True)
    for buckets in (1, 5):
        wanted = sorted(int(v) % buckets << 32 | int(v) // buckets for v in values[counts > 1])
        for most in (1, 90, 1 << 18):
            monkeypatch.setattr(ngramjoin, "SEND_KEYS", most)
            monkeypatch.setattr(ngramjoin, "SLICE", 1 if most == 1 else 1 << 10)
            assert sorted(r.key for r in ngramjoin._shared_keys(sets, buckets).collect()) == wanted
