from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakloom.llm import spelling
from peakloom.llm.spelling import Acceptor, near_words, variants


def near(words):
    """For each word those that agree with it once one place of one or of both is left out."""
    holes, out = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].add(w)
    for (_, rest), some in holes.items():
        for w in some:
            out[w] |= some - {w}
            if rest in words:
                out[w].add(rest)
                out[rest].add(w)
    return out


def vocabulary(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    return {w: c for w, c in n.items() if c >= 5}


def brute(docs):
    n = vocabulary(docs)
    others = near(n)
    form = {}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(others[w]), form[w], form[w] and n[form[w]], root))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(60)] + ["ÀÉÎÕÜÿ", "Straße", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abcdefghijklmnopqrstuvwxyz" * 30]
    words += [w[:i] + rng.choice("abé") + w[i + rng.randint(0, 1) :] for w in words for i in (1, len(w) - 1)]
    weights = [rng.choice([1, 1, 2, 8, 60]) for _ in words]
    return [(i, rng.choice([" ", "1", "東"]).join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=rng.choice([0, 5, 80])))) for i in range(300)]


@pytest.mark.parametrize("most", [1 << 15, 3])
def test_against_brute_force(docs_of, monkeypatch, most):
    monkeypatch.setattr(spelling, "STATE_MOST", most)  # few words under a state: hot ones are cut again and again
    docs = [*corpus(1), (None, None), (None, "aaaaaa " * 7), (1, ""), (1, "aaaaab " * 9), (1, "aaaaab " * 9), (2, "chaina " * 5 + "chainb " * 30 + "chainbc " * 160)]
    found = variants(docs_of(docs))
    assert sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect()), key=repr) == sorted(brute(docs), key=repr)
    assert found.filter("root <> word and root <> form").count() > 0


def test_near_words_of_random_letters(spark):
    rng = random.Random(9)
    n = {"".join(rng.choices("abcdefg", k=rng.randint(6, 7))): rng.randint(5, 50) for _ in range(5000)}
    found = {r.word: (r.near, r.best_n, r.best) for r in near_words(spark.createDataFrame(list(n.items()), "word string, n long").repartition(6)).collect()}
    want = {}
    for w, others in near(n).items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            want[w] = (len(others), n[best], best)
    assert found == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2), st.text("abc", max_size=6)), min_size=1, max_size=40))
def test_composition_gives_every_pair_once(words):
    words = sorted(words)
    first = np.concatenate([[0], np.cumsum([len(w) for _, w in words])])
    left, right, last = Acceptor(np.frombuffer("".join(w for _, w in words).encode(), np.uint8), first, np.array([g for g, _ in words])).pairs()
    pairs = [tuple(sorted((a, b))) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    want = []
    for g in range(3):
        mine = {w for k, w in words if k == g}
        want += [(words.index((g, a)), words.index((g, b))) for a, some in near(mine).items() for b in some if words.index((g, a)) < words.index((g, b))]
    assert sorted(pairs) == sorted(want)
    assert all(e == (words[a][1][:-1] == words[b][1]) for a, b, e in zip(left.tolist(), right.tolist(), last.tolist(), strict=True))


def test_acceptor_is_minimal():
    words = sorted(f"{a}{b}ing" for a in "abcd" for b in "xyz")
    a = Acceptor(np.frombuffer("".join(words).encode(), np.uint8), np.arange(13) * 5, np.zeros(12, np.int64))
    assert len(a.count) == 6  # one state for each length of what is left


def test_odd_rows_and_empty_tables(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in variants(odd).collect()), key=repr) == sorted(brute(rows), key=repr)
    assert variants(none).collect() == [] and variants(none).columns == ["word", "n", "n_near", "form", "form_n", "root"]
