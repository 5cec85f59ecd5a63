from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from peakloom.llm import suffixdedup
from peakloom.llm.shingles import chunks
from peakloom.llm.suffixdedup import without_repeats
from peakloom.llm.suffixes import ascends, common_prefixes, sorted_suffixes

from .conftest import ODD, prose


def brute(docs, length):
    texts = [(d[0], (d[1] or "").encode()) for d in docs]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        covered = np.cumsum(gone[:-1]) > 0 if len(t) else np.zeros(0, bool)
        runs = int(covered[:1].sum() + (np.diff(covered.astype(int)) == 1).sum()) if len(t) else 0
        kept = np.frombuffer(t, np.uint8)[~covered].tobytes()
        out.append((doc_id, len(t), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages():
    shared, other = prose(120, 70), prose(70, 71)
    return [
        (20, prose(50, 1) + shared + prose(60, 2)), (21, shared[30:] + prose(20, 3)), (22, prose(30, 4) + other + shared[:450] + other), (23, "ab" * 300), (24, "a" * 401), (25, "a" * 400),
        (26, "ñ" * 260), (27, prose(90, 5)), (28, prose(90, 5) + "x"), (29, shared[:399]), (30, (prose(6, 6) + " ") * 40),
    ]


@pytest.mark.parametrize("length", [400, 60])
def test_against_all_strings(docs_of, length):
    docs = [*passages(), *ODD]
    rows = without_repeats(docs_of(docs), length=length, with_text=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == brute(docs, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in rows)


@pytest.mark.parametrize("most", [3000, 600, 1])
def test_large_groups_are_filed_anew(docs_of, monkeypatch, most):
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", most)
    docs = [(i, prose(60, i) + prose(100, 99) + prose(60, 50 + i)) for i in range(12)]
    docs += [(20 + i, prose(9, i % 3) + prose(70, 98)[: 380 + 9 * i] + prose(9, i % 2)) for i in range(12)] + docs[:2]
    rows = without_repeats(docs_of(docs)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == brute(docs, 400)


def test_very_long_texts_are_cut_into_parts(docs_of, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PART_BYTES", 1000)
    monkeypatch.setattr(suffixdedup, "chunks", lambda offsets: chunks(offsets, 900))
    docs = [*passages(), (40, prose(500, 7)), (41, "x" + prose(500, 7)), (42, prose(30, 8) + prose(500, 7)[700:3000])]
    rows = without_repeats(docs_of(docs)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == brute(docs, 400)


@pytest.mark.parametrize(("length", "passage"), [(400, 256), (60, 50), (400, 60)])
def test_shared_passages_stay_but_are_told(docs_of, length, passage):
    docs = [*passages(), *ODD, (40, prose(60, 1) + prose(45, 72)), (41, prose(45, 72) + prose(60, 2))]
    rows = without_repeats(docs_of(docs), length=length, passage=passage, with_text=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == brute(docs, length)
    assert Counter((r.doc_id, r.n_bytes, r.n_shared) for r in rows) == sum((Counter({k[:3]: n}) for k, n in brute(docs, passage).items()), Counter())


def test_empty(none):
    assert without_repeats(none).count() == without_repeats(none, passage=256).count() == 0


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(300):
        text = bytes(rng.integers(97, 99 + trial % 3, rng.integers(1, 60)).astype(np.uint8))
        up = ascends(np.frombuffer(text, np.uint8))
        assert up.tolist() == [text[i:] < text[i + 1 :] for i in range(len(text))]
        wanted = rng.random(len(text)) < 0.6
        order = sorted_suffixes(text, wanted, 1000)
        assert order.tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i:])  # noqa: B023
        for a, b, n in zip(order[:-1], order[1:], common_prefixes(text, order, 16)[1:], strict=True):
            same = next((k for k in range(16) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text)), 16)
            assert n >= same
