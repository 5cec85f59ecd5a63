from __future__ import annotations

import re
from collections import Counter

import pytest

from peakloom.llm.decontaminate import clean, contaminated

from .conftest import ODD, prose

SPLIT = re.compile(r"[^\w]+|_")
ITEMS = "item_id long, text string, n_words string, start string"


def words(text):
    return [w for w in SPLIT.split((text or "").lower()) if w]


def grams(ws, n):
    return Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))


def brute(docs, items):
    """Every window of an item's size, exactly."""
    out = {}
    for doc_id, text, *_ in docs:
        ws = words(text)
        for item_id, item in items:
            iw = words(item)
            n = min(5, len(iw))
            if not iw or not grams(iw, n).keys() & grams(ws, n).keys():
                continue
            for at in range(max(1, len(ws) - len(iw) + 1)) if iw and len(ws) >= n else ():
                a, b = grams(ws[at : at + len(iw)], n), grams(iw, n)
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8 and s > out.get((doc_id, item_id), (0,))[0]:
                    out[doc_id, item_id] = s, at
    return out


ITEM_ROWS = [(i, prose(20 + i, 1000 + i)) for i in range(12)] + [(20, None), (21, " ,"), (22, "rare phrase"), (23, prose(20, 1000)), (24, ("echo " * 30).strip())]


def planted():
    at = lambda i: ITEM_ROWS[i][1]
    last = at(5).split()
    return [
        (100, prose(40, 1) + " " + at(0) + " " + prose(40, 2)), (101, at(1).upper().replace(" ", ",  ")), (102, prose(9, 3) + "\n" + at(2) + "."), (102, "another row of this id"),
        (103, " ".join(at(3).split()[:10]) + " " + prose(50, 4)), (104, prose(10, 5) + " " + " ".join([*last[:-1], "changed"]) + " " + prose(10, 6)), (105, "a RARE-phrase here"),
        (106, "echo " * 200), (107, " ".join(at(6).split()[:-2])), (108, at(0) + " " + at(0)), (109, prose(40, 1) + " " + at(0) + " " + prose(40, 2)), (110, " ".join(at(11).split()[2:])),
        (111, prose(5, 8) + " " + " ".join(at(11).split()[:15] + at(11).split()[16:]) + " " + prose(5, 9)),
    ]


def test_against_all_windows(docs_of, spark):
    docs = [*planted(), *ODD]
    items = spark.createDataFrame([(*i, "x", "y") for i in ITEM_ROWS], ITEMS)
    found = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs_of(docs), items).collect() if r.doc_id is not None}
    want = {k: v[0] for k, v in brute(docs, ITEM_ROWS).items() if k[0] is not None}
    assert {k: pytest.approx(v) for k, v in want.items()} == found
    left = clean(docs_of(docs), items)
    assert sorted((r.doc_id for r in left.collect() if r.doc_id is not None)) == sorted(d[0] for d in docs if d[0] is not None and not any(k[0] == d[0] for k in brute([d], ITEM_ROWS)))
    assert left.columns == docs_of(docs).columns


def test_recall_of_the_hamming_blocks(docs_of, spark):
    """Windows at a similarity of 0.8 to 0.85, the hardest to find: of 200 at least nine in ten; above that all."""
    rows = [(i, prose(60 + i % 50, 3000 + i)) for i in range(200)]
    docs = []
    for i, text in rows:
        w = text.split()
        for k in range(1 + i % 2):  # one or two changes spoil up to five shingles each
            w[20 + 25 * k] = "changed"
        docs.append((i, f"{prose(7, 4000 + i)} {' '.join(w)} {prose(7, 5000 + i)}"))
    items = spark.createDataFrame([(*i, "x", "y") for i in rows], ITEMS)
    found = {(r.doc_id, r.item_id) for r in contaminated(docs_of(docs), items).collect()}
    want = {}
    for (i, item), (_, text) in zip(rows, docs, strict=True):
        want |= brute([(i, text)], [(i, item)])
    close = {k for k, v in want.items() if v[0] < 0.85}
    assert found <= want.keys() and want.keys() - close <= found
    assert len(close) > 30 and len(close & found) >= 0.9 * len(close)


def test_empty_sides(docs_of, none, spark):
    items = spark.createDataFrame([(*i, "x", "y") for i in ITEM_ROWS], ITEMS)
    assert contaminated(none, items).count() == 0
    assert contaminated(docs_of(planted()), items.limit(0)).count() == 0
    assert clean(docs_of(planted()), items.limit(0)).count() == len(planted())


def test_windows_between_two_alignments(docs_of, spark):
    item, shorter = prose(100, 2001).split(), prose(60, 2002).split()
    rows = [(1, " ".join(item)), (2, " ".join(shorter))]
    docs = [
        (1, " ".join(item[3:50] + prose(6, 2003).split() + item[50:97])), (2, prose(30, 2004) + " " + " ".join(item[3:50] + prose(6, 2005).split() + item[50:97]) + " " + prose(30, 2006)),
        (3, prose(8, 2007) + " " + " ".join(shorter[:-2]) + " " + prose(8, 2008)), (4, " ".join(item[:80] + prose(30, 2009).split())),
    ]
    items = spark.createDataFrame([(*i, "x", "y") for i in rows], ITEMS)
    found = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in contaminated(docs_of(docs), items).collect()}
    want = brute(docs, rows)
    assert want.keys() == {(1, 1), (2, 1), (3, 2)} and want[1, 1][0] == pytest.approx(86 / 106)
    assert {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()} == found
    assert [r.doc_id for r in clean(docs_of(docs), items).collect()] == [4]
