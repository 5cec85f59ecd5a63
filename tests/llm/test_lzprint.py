from __future__ import annotations

import hashlib

import numpy as np
import pytest

from peakloom.llm.lzprint import fingerprint, fingerprints, likeness

from .conftest import ODD, prose


def phrases(data: bytes) -> set[bytes]:
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def test_likeness_estimates_the_phrase_sets_overlap():
    texts = [prose(400, s) for s in range(6)]
    texts += [texts[0][: len(texts[0]) // 2] + texts[1][: len(texts[1]) // 2]]
    true, found = [], []
    for a in texts:
        for b in texts:
            x, y = phrases(a.encode()), phrases(b.encode())
            true.append(len(x & y) / len(x | y))
            found.append(likeness(fingerprints(a)[0], fingerprints(b)[0]))
    assert np.abs(np.subtract(true, found)).max() < 0.25
    assert np.abs(np.subtract(true, found)).mean() < 0.07


@pytest.mark.parametrize("text", ["", "a", "abab" * 50, prose(200, 5), "ñ東" * 30])
@pytest.mark.parametrize("tail", ["", "zz", "other words"])
def test_a_forked_parse_is_a_parse(text, tail):
    tail = tail[: len(text)]
    own, other = fingerprints(text, tail)
    assert own.tolist() == fingerprints(text)[0].tolist()
    assert other.tolist() == fingerprints(text[: len(text) - len(tail)] + tail)[0].tolist()


def check(rows, docs):
    """Against the plain definition; rows that share an id may follow each other in any order."""
    found = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in rows), key=repr)
    assert len(rows) == len(docs)
    order = sorted((d for d in docs if d[0] is not None), key=lambda d: -d[0]) + [d for d in docs if d[0] is None]
    unique = len({d[0] for d in docs}) == len(docs)
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = "".join(f"{h:08x}" for h in fingerprints(text)[0])
        assert any(f[0] == doc_id and f[1] == len(text) and f[3] == own for f in found)
        if unique:
            r = next(r for r in rows if r.doc_id == doc_id)
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.near_edited == pytest.approx(likeness(fingerprints(text)[0], fingerprints(edited)[0]))
            assert r.near_next == pytest.approx(likeness(fingerprints(text)[0], fingerprints(after)[0]))


def test_odd_rows(odd):
    check(fingerprint(odd).collect(), ODD)


@pytest.mark.parametrize("n", [1, 2, 400])
def test_successors_across_ranges(docs_of, n):
    docs = [(i * i, prose(10 + i % 30, i)) for i in range(n)]
    check(fingerprint(docs_of(docs)).collect(), docs)


def test_empty_and_only_null_ids(none, docs_of):
    assert fingerprint(none).count() == 0
    assert fingerprint(docs_of([(None, "a"), (None, "b")])).count() == 2
