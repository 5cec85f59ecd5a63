from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from peakloom.llm import ranked
from peakloom.llm.ranked import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, best=10):
    """Every document's score for every item, in integers."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    full = [b for _, b in bags if b]
    n, total = len(full), sum(sum(b.values()) for b in full)
    df = Counter(t for b in full for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        scores = []
        for doc, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in words if bag[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["Größe", "東京", "B2b", "éa"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda k: rng.choice([" ", "-", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(vocabulary, weights, k=k))
    docs = [(i, text(rng.choice([1, 3, 10, 60, 300]))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(30)] + [(None, docs[8][1]), (None, None), (n + 40, None), (n + 41, ""), (n + 42, " .,- "), (5, docs[9][1])]
    items = [(i, text(rng.choice([1, 2, 6, 20]))) for i in range(25)] + [(25, None), (26, ""), (27, "nowhere"), (None, text(5)), (3, text(4)), (28, docs[7][1])]
    return docs, items


@pytest.mark.parametrize(("bucket", "at_once", "block"), [(512, 4096, 1 << 19), (7, 9, 70)])
def test_against_all_scores(spark, docs_of, bucket, at_once, block, monkeypatch):
    docs, items = corpus(1)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    monkeypatch.setattr(ranked, "TERMS_AT_ONCE", at_once)
    found = search(docs_of(docs), queries, block_terms=block)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items)


def test_buckets_leave_out_nothing_that_counts():
    import numpy as np

    rng = np.random.default_rng(6)
    weights = rng.integers(0, 9000, 50)
    picks = [np.unique(rng.integers(0, 50, 12)) for _ in range(20)]
    q = ranked.Queries(np.concatenate([[0], np.cumsum([len(p) for p in picks])]), np.concatenate(picks), weights)
    impacts = rng.integers(1, 10**6, (40, 50)) * (rng.random((40, 50)) < 0.3)
    doc, term = np.nonzero(impacts)
    bucket = ranked.Bucket(doc, term, impacts[doc, term], np.sqrt((weights * impacts.astype(float) ** 2).sum(1)))
    exact = np.stack([(impacts[:, p] * weights[p]).sum(1) for p in picks], axis=1)
    least = np.sort(exact, axis=0)[-5]  # what the fifth best has
    d, query, score = bucket.scored(q, 0, least)
    good = score >= least[query]
    assert {(a, b, s) for a, b, s in zip(d[good].tolist(), query[good].tolist(), score[good].tolist(), strict=True)} == {(a, b, int(exact[a, b])) for a, b in zip(*np.nonzero(exact >= least), strict=True)}
    assert len(d) < exact.size / 2


def test_long_texts_are_cut_between_words(docs_of, spark, monkeypatch):
    docs = [(1, "alpha " * 300_000 + "größe"), (2, "x" * 3_000_000), (3, "größe alpha")]
    items = [(0, "größe"), (1, "alpha"), (2, "x" * 3_000_000)]
    found = search(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items)


def test_odd_rows_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "word 12"), (2, "Größe")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in search(odd, items).collect()), key=repr) == brute(rows, [(1, "word 12"), (2, "Größe")])
    assert search(none, items).collect() == [] and search(odd, items.limit(0)).collect() == []
    assert search(odd, items).columns == ["item_id", "rank", "doc_id", "score"]
    with pytest.raises(ValueError, match="different terms"):
        search(odd, items, block_terms=1)
