"""The stages against plain versions of themselves, on a small corpus, and through run()."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import corpus_pipeline as p
import numpy as np
import pyarrow as pa
import pytest

from peakloom.llm.langid import UNDETERMINED
from peakloom.llm.ngramjoin import block_keys

from .conftest import CLASHING, ODD, SCHEMA, prose, rows_of
from .test_decontaminate import ITEM_ROWS, ITEMS, planted
from .test_decontaminate import brute as leaks
from .test_ngramjoin import brute as groups
from .test_ngramjoin import near_copies
from .test_sharding_mixing import WORDS, plain_targets


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [*near_copies(), *((d[0] + 10_000, *d[1:]) for d in planted() if d[1] != "another row of this id"), *((None if d[0] is None else d[0] + 20_000, *d[1:]) for d in ODD)]
    rows = [(d[0], d[1], (*d, None, None)[2] if len(d) > 2 else "en", f"s{(d[0] or 0) % 5}") for d in docs]
    spark.createDataFrame(rows_of(rows), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*i, "x", "y") for i in ITEM_ROWS], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages_take_effect_and_keep_the_columns(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = p.language_id(spark, docs, folder)
    assert Counter(r.doc_id for r in first.collect()) == Counter(r[0] for r in left)
    assert first.columns == docs.columns and len(CLASHING) == len(docs.columns) - 5

    second = p.ngram_jaccard_join(spark, first, folder)
    comp = groups(left)
    named = {r.doc_id for r in second.collect()} - {None}
    assert named == set(comp.values())
    assert second.columns == docs.columns and max(Counter(r.doc_id for r in second.collect() if r.doc_id is not None).values()) == 1

    third = p.benchmark_decontamination(spark, second, folder)
    leaky = {k[0] for k in leaks([r for r in left if r[0] in named], ITEM_ROWS)}
    assert {r.doc_id for r in third.collect()} - {None} == named - leaky

    fourth = p.source_mixing(spark, third, folder)
    assert fourth.columns == docs.columns
    assert max(Counter((r.doc_id, r.text) for r in fourth.collect()).values()) <= 3


def close(a, b, words, similar):
    a, b = (frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) for w in (a.split(), b.split()))
    return 100 * len(a & b) >= similar * len(a | b)


def test_the_join_stage_takes_five_words_and_four_fifths(spark, docs_of):
    base, apart = prose(100, 31).split(), prose(100, 32).split()
    two, three = list(base), list(apart)
    two[30], two[60] = "changed", "again"
    three[25], three[50], three[75] = "changed", "again", "more"
    texts = [" ".join(x) for x in (base, two, apart, three)]
    assert close(texts[0], texts[1], 5, 80) and not close(texts[0], texts[1], 4, 85) and not close(texts[2], texts[3], 5, 80)
    docs = docs_of(enumerate(texts, 1))
    left = dict(p.STAGES)["ngram_jaccard_join"](spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4] and left.columns == docs.columns


def test_linked_sets_share_a_block_at_four_fifths():
    rng = np.random.default_rng(12)
    linked = 0
    for n in [*range(1, 40), 57, 96, 100, 180, 400, 999]:
        for _ in range(12):
            base = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            more = rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 5) + 1), np.uint64)
            other = np.unique(np.concatenate([rng.permutation(base)[rng.integers(0, max(1, n // 5) + 1) :], more]))
            common = len(np.intersect1d(base, other))
            if common and 100 * common >= p.NEAR_SIMILAR * (len(base) + len(other) - common) and not np.array_equal(base, other):
                linked += 1
                assert len(np.intersect1d(block_keys(base, p.NEAR_SIMILAR), block_keys(other, p.NEAR_SIMILAR))), n
    assert linked > 100


def plain_copies(rows):
    """How often the mix takes each (id, text), from sorted lists."""
    size = lambda r: len(WORDS.findall(r[1] or ""))
    sources = {s: [r for r in rows if r[3] == s] for s in {r[3] for r in rows}}
    targets = plain_targets({s: sum(map(size, v)) for s, v in sources.items()})
    out = {}
    for s, own in sources.items():
        whole = sum(map(size, own))
        epochs, left = divmod(int(targets[s] + 1e-9), whole)
        for r in sorted(own, key=lambda r: (hashlib.md5(f"42:{r[0]}:{size(r)}".encode()).hexdigest(), r[0])):
            out[r[0], r[1]] = epochs + (min(size(r), left) > 0)
            left = max(0, left - size(r))
    return out


def test_run_against_plain_stages(spark, corpus):
    folder, rows = corpus
    left = list({(r[0], r[1]): r for r in rows if any(c.isalpha() for c in r[1] or "")}.values())
    comp = groups(left, p.NEAR_WORDS, p.NEAR_SIMILAR)
    left = [r for r in left if r[0] is not None and comp[r[0]] == r[0]]
    leaky = leaks(left, ITEM_ROWS)
    want = plain_copies([r for r in left if not any(k[0] == r[0] for k in leaky)])
    found = p.run(spark, folder).collect()
    text = {r[0]: r[1] for r in left}
    assert Counter(r.doc_id for r in found) == Counter({k[0]: n for k, n in want.items() if n})
    assert {r.doc_id: (r["size"], r.text_crc32) for r in found} == {r.doc_id: (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode())) for r in found}
    loads = Counter()
    for r in found:
        loads[r.shard] += r["size"]
    assert set(loads) <= set(range(p.SHARDS))
    for s in range(p.SHARDS):
        own = sorted(r.slot for r in found if r.shard == s)
        assert own == list(range(len(own)))


def test_join_stage_loses_no_text(spark, docs_of):
    """Rows of one id: equal texts are one document, other texts others; a copy goes whatever its id, and null ids are told apart by text."""
    a, b, c = prose(50, 61), prose(50, 62), prose(50, 63)
    docs = docs_of([(1, a), (2, a), (2, b), (2, b), (3, None), (3, ""), (None, c), (None, c), (None, b), (None, prose(50, 64)), (None, None)])
    left = dict(p.STAGES)["ngram_jaccard_join"](spark, docs, "")
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert got == Counter([(1, a), (2, b), (3, None), (3, ""), (None, c), (None, prose(50, 64)), (None, None)])
    assert left.columns == docs.columns


def test_mixing_stage_deals_copies_of_equal_rows(spark, docs_of):
    docs = docs_of([(None, prose(20, i), "en", "a") for i in range(6)] + [(1, prose(30, 9), "en", "a")] * 3 + [(2, prose(900, 10), "en", "b")])
    got = Counter((r.doc_id, r.text) for r in p.source_mixing(spark, docs, "").collect())
    assert set(got) == {(r.doc_id, r.text) for r in docs.collect()} and got[2, prose(900, 10)] == 1
    assert all(n <= 3 for k, n in got.items() if k[0] is None) and 3 <= got[1, prose(30, 9)] <= 9


def test_nothing_left(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_constants():
    assert [name for name, _ in p.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    assert UNDETERMINED == "und" and prose(3, 1) == prose(3, 1)


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """A partition of 24 MB came as one batch, which executor and worker held in several copies."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(p, "jaccard_groups", lambda docs, **_: docs.mapInArrow(lambda bs: (pa.record_batch([pa.array([b.nbytes])] * 3, ["doc_id", "text_a", "comp"]) for b in bs), "doc_id long, text_a long, comp long"))
    monkeypatch.setattr(p, "written", lambda df, label: pytest.fail(f"{max(r.comp for r in df.collect())}"))
    docs = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('abcdefghij', 600) as text")
    spark.conf.unset(bound)
    with pytest.raises(pytest.fail.Exception) as most:
        p.ngram_jaccard_join(spark, docs, "")
    assert 1 << 20 < int(str(most.value)) < 5 << 20
    spark.conf.set(bound, "9m")  # what a session was given stays
    p.small_batches(spark)
    assert spark.conf.get(bound) == "9m"
    spark.conf.unset(bound)
