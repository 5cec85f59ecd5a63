from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from peakloom.llm.mixing import mix, source_targets
from peakloom.llm.sharding import build_map, grow_map, load_map, rebalance_map, shard, store_map

from .conftest import ODD, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_every_row_has_a_place(odd):
    rows = shard(odd, 3).collect()
    want = Counter((d[0], len((d[1] or "").encode()) + 1, None if d[1] is None else zlib.crc32(d[1].encode())) for d in ODD)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_bytes_are_even_and_only_the_new_shard_gains(docs_of):
    docs = docs_of([(i, prose(5 + i % 90, i)) for i in range(3000)])
    rows = shard(docs, 16).collect()
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in rows) * 2
    assert {r.next_map_shard for r in rows if r.next_map_shard != r.shard} == {16}
    assert sorted((r.doc_id, r.shard, r.slot) for r in shard(docs.repartition(7), 16).collect()) == sorted((r.doc_id, r.shard, r.slot) for r in rows)


def test_map_against_a_plain_fold(spark):
    loads = [(i, (i * 7919) % 101, 1) for i in range(50)]
    frame = spark.createDataFrame(loads, "vslot int, bytes long, rows long")
    full, want = [0] * 4, {}
    for b, v, _ in sorted(((b, v, r) for v, b, r in loads), reverse=True):
        at = full.index(min(full))
        want[v], full[at] = at, full[at] + b
    built = build_map(frame, 4)
    assert {r.vslot: r.shard for r in built.collect()} == want
    grown = grow_map(built, 4)
    assert {r.version for r in grown.collect()} == {2}
    assert all(r.shard in (want[r.vslot], 4) for r in grown.collect())


def test_maps_are_kept_by_version(spark, tmp_path):
    first = build_map(spark.createDataFrame([(i, i, 1) for i in range(20)], "vslot int, bytes long, rows long"), 2)
    store_map(first, f"{tmp_path}/maps")
    store_map(grow_map(load_map(spark, f"{tmp_path}/maps"), 2), f"{tmp_path}/maps")
    assert {v: load_map(spark, f"{tmp_path}/maps", v).select("shard").distinct().count() for v in (1, 2)} == {1: 2, 2: 3}
    with pytest.raises(Exception, match="(?i)already exists"):
        store_map(first, f"{tmp_path}/maps")


def test_drift_moves_few_slots(spark, tmp_path):
    slots, shards = 512, 8
    loads = lambda f: spark.createDataFrame([(i, f(i), 1) for i in range(slots)], "vslot int, bytes long, rows long")
    store_map(build_map(loads(lambda i: 100 + i % 7), shards), str(tmp_path))
    first = load_map(spark, str(tmp_path))
    hot = {r.vslot for r in first.collect() if r.shard == 3}
    store_map(rebalance_map(first, loads(lambda i: (300 if i in hot else 100) + i % 7), shards), str(tmp_path))
    was, now = ({r.vslot: r.shard for r in load_map(spark, str(tmp_path), v).collect()} for v in (1, 2))
    moved = {v for v in was if was[v] != now[v]}
    assert was.keys() == now.keys() and 0 < len(moved) < len(hot) and moved <= hot
    bytes_of = Counter()
    for v, s in now.items():
        bytes_of[s] += (300 if v in hot else 100) + v % 7
    assert max(bytes_of.values()) <= sum(bytes_of.values()) / shards + 306
    again = rebalance_map(load_map(spark, str(tmp_path)), loads(lambda i: 0), shards)
    assert {r.vslot: r.shard for r in again.collect()} == now and again.first().version == 3


def plain_targets(sizes):
    """Shared by weight, capped, and the excess shared again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left, free = left - sum(target[s] for s in over), free - set(over)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 1000, "c": 50, None: 3}, {"a": 0, "b": 0}, {"b": 5, "a": 100, "é": 7, "Z": 1, "c": 900, None: 0}])
def test_targets(spark, sizes):
    rows = [("1" if s is None else "0" + s, n) for s, n in sizes.items()]
    found = {r.src: r.target for r in source_targets(spark.createDataFrame(rows, "src string, source_size long")).collect()}
    assert found == pytest.approx({("1" if s is None else "0" + s): t for s, t in plain_targets(sizes).items()})


@pytest.mark.parametrize("docs", [ODD, [(i, prose(i % 40, i), "en", f"s{0 if i % 3 else i % 7}") for i in range(600)]])
def test_budgets_are_met_exactly(docs_of, docs):
    size = {}
    per = defaultdict(int)
    for d in docs:
        size[d[0], d[1]] = len(WORDS.findall(d[1] or ""))
        per[d[3]] += size[d[0], d[1]]
    frame = docs_of(docs)
    rows = mix(frame.withColumn("target", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d[0], size[d[0], d[1]]) for d in docs)
    taken = Counter()
    for r in rows:
        taken[r.source_size, r.target] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.copies * r["size"] >= r.taken
    goals = Counter()
    for s, t in plain_targets(dict(per)).items():
        goals[per[s], t] += int(t + 1e-9)
    assert {k: v for k, v in taken.items() if v} == {k: pytest.approx(v, abs=1) for k, v in goals.items() if v}
    again = mix(frame.repartition(5)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in again) == Counter((r.doc_id, r["size"], r.taken) for r in rows)


def test_empty(none):
    assert shard(none).count() == 0
    assert mix(none).count() == 0
