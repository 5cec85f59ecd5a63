from __future__ import annotations

import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakloom.llm import langid
from peakloom.llm.langid import ORDERS, RIDGE, SHARPNESS, UNDETERMINED, identify, training_sample

from .conftest import ODD, prose

ALPHABETS = {"en": "abcdefgh", "de": "fghijklmn", "fr": "mnopqrstu"}


def corpus():
    return [(i, prose(5 + i % 60, i, ALPHABETS[lang]), lang, "s") for i in range(240) for lang in [list(ALPHABETS)[i % 3]]]


def test_held_out_accuracy(docs_of):
    docs = corpus()
    rows = identify(docs_of(docs)).collect()
    assert {r.doc_id: r.held_out for r in rows} == {d[0]: zlib.crc32(str(d[0]).encode()) % 4 == 2 for d in docs}
    lang = {d[0]: d[2] for d in docs}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_only_text_decides(docs_of):
    docs = docs_of(corpus())
    moved = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "fr").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    before, after = ({r.doc_id: (r.lang_pred, r.score) for r in identify(d).collect()} for d in (docs, moved))
    assert before == after


def test_odd_rows(odd):
    rows = identify(odd, carry=("source", "score")).collect()
    assert len(rows) == len(ODD)
    und = {d[0] for d in ODD if d[0] is not None and not any(c.isalpha() for c in d[1] or "")}
    assert {r.doc_id for r in rows if r.lang_pred == UNDETERMINED and r.doc_id is not None} == und
    assert all(r[3] == 0.0 for r in rows if r.lang_pred == UNDETERMINED)


def test_sample_is_bounded(docs_of):
    sample = training_sample(docs_of(corpus()), "doc_id", "text", "lang", rows=5)
    assert sample.groupBy("lang").count().agg(F.max("count")).first()[0] <= 5


def grams(text):
    """The spectrum as strings: letters in lower case, a space for each run of others and at both ends."""
    plain = " " + re.sub(r"[^\W\d_]+|.", lambda m: m[0].lower() if m[0][0].isalpha() else " ", text, flags=re.S) + " "
    plain = re.sub(" +", " ", plain)
    return {plain[i : i + n] for n in ORDERS for i in range(len(plain) - n + 1)}


def test_against_plain_kernel_ridge(docs_of):
    """Kernel values from sets of n-grams, a plain solve, no folding; 40 texts, so that few hashes fall together."""
    docs = [(i, prose(6 + i % 9, i, ALPHABETS[lang]), lang, "s") for i in range(40) for lang in [list(ALPHABETS)[i % 3]]]
    df = docs_of(docs)
    rows = identify(df).collect()
    learnt = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    x = [grams(d[1]) for d in learnt]
    langs = sorted(ALPHABETS)
    y = np.array([[1.0 if d[2] == c else -1.0 for c in langs] for d in learnt])
    k = np.array([[kernel(a, b) for b in x] for a in x])  # every row is a landmark
    weights = np.linalg.solve(k.T @ k + RIDGE * len(x) * (k + 1e-6 * np.eye(len(x))), k.T @ y)
    for r in rows:
        own = grams(docs[r.doc_id][1])
        values = np.array([kernel(own, b) for b in x]) @ weights
        odds = np.exp(SHARPNESS * (values - values.max()))
        assert r.lang_pred == langs[int(values.argmax())]
        assert abs(r.score - odds.max() / odds.sum()) < 0.02


def test_too_many_languages(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        identify(docs_of(corpus()))


def test_nothing_to_learn_from(none, docs_of):
    assert identify(none).count() == 0
    assert [r.lang_pred for r in identify(docs_of([(1, "text", None, "s")])).collect()] == [UNDETERMINED]


def test_long_texts_in_parts_have_the_same_n_grams(monkeypatch):
    rng = random.Random(3)
    for _ in range(100):
        text = pa.array(["".join(rng.choices("ab  é.1ß東", k=rng.randint(0, 400)))])
        whole = np.unique(next(langid._spectra(text)))
        with monkeypatch.context() as m:
            m.setattr(langid, "PART", rng.randint(1, 50))
            assert np.array_equal(np.unique(next(langid._spectra(text))), whole)


def test_a_block_of_long_texts_takes_bounded_memory():
    """64 texts of 1 MB in a process of its own; all their n-grams at once took 2.5 GB."""
    code = """
import resource, pyarrow as pa
from peakloom.llm import langid
texts = pa.array([("lorem ipsum dolor " * 60_000)[: 1 << 20]] * 64)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
x, found = langid._presence(langid._spectra(texts), 64)
assert found.all()
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(langid.__file__).parents[2])
    assert int(grown.stdout) < 400_000  # KB
