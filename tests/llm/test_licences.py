from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakloom.llm.licences import FAMILY, NEGATED, TEMPLATES, TITLE, Template, Templates, context, document_counts, inherit, licences, scan, words_of

FILES = "path string, text string, dir string, licence string, own_licence string"


def files(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FILES).select("path", "text", "dir", "licence").repartition(2)


def wrapped(text, mark, width=9):
    """A text as a comment of so many words a line."""
    w = text.split()
    return "\n".join(f"{mark} {' '.join(w[i : i + width])}" for i in range(0, len(w), width))


def test_every_template_finds_itself_however_it_stands(spark):
    forms = lambda x: (x.upper(), f"  {x}  ", wrapped(x, "#"), wrapped(x, " *", 5), x.replace(" ", "\n"))
    rows = [(f"{k}/{i}", form if len(words_of(t.text)) < TITLE else f"first line\n{form}\nlast, but least") for i, t in enumerate(TEMPLATES) for k, form in enumerate(forms(t.text))]
    found = {r.path: r for r in scan(files(spark, rows)).collect()}
    for path, r in found.items():
        t = TEMPLATES[int(path.split("/")[1])]
        assert r.own_licence == (t.family if t.telling == ("$^",) else t.name), path
        assert r.similarity == pytest.approx(1.0)


def header(name, version, subject="program"):
    return next(t.text for t in TEMPLATES if f"{name} as published" in t.text).replace(re.search("version [0-9.]+", next(t.text for t in TEMPLATES if f"{name} as published" in t.text))[0], f"version {version}").replace("program", subject)


#: Notices near others' templates, and what they may be named.
NOTICES = [
    (header("GNU General Public License", "2"), "GPL-2.0"), (header("GNU Affero General Public License", "3"), "AGPL-3.0"), (header("GNU Lesser General Public License", "2.1", "library"), "LGPL-2.1"),
    (header("GNU General Public License", "4"), "GPL-family"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "MPL-1.1"),
    ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/', "MPL-1.1"),
    ("This is not licensed under the Apache License, Version 2.0.", None), ("It was never licensed under CC BY 4.0.", None), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"), ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"), ("Released under the MIT-0 License.", "MIT-0"), ("MIT License", "MIT"), ("The MIT License", "MIT"),
    ("the work is compatible with the MIT License and says no more", None), ("This is not the GPL. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
]


@pytest.mark.parametrize(
    ("documents", "containing"),
    [(10_000, lambda w: 10), (10**6, lambda w: 300_000), (100, lambda w: 0), (10**6, lambda w: 10**6), (51_282, lambda w: 50 if len(w) > 3 else 20_000), (10**9, lambda w: 5), (51_282, lambda w: 20_000 if len(w) > 6 else 3)],
)
def test_notices_are_not_misnamed_whatever_the_counts(documents, containing):
    known = Templates(TEMPLATES, documents, {w: containing(w) for t in TEMPLATES for w in words_of(t.text)})
    for (text, name), (found, _) in zip(NOTICES, known.best(pa.array([n for n, _ in NOTICES]), 0.8), strict=True):
        families = {t.family for t in TEMPLATES if t.name == name}
        assert found in {name, None, *families}, text
        if documents == 10_000:
            assert found == name, text


def test_whole_licence_files(spark):
    full = {name: max((t.text for t in TEMPLATES if t.name == name), key=len) for name in ("MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "Apache-1.1", "Zlib", "Unlicense")}
    rows = [(f"{name}/LICENSE", f"The {name} Licence\n\nCopyright (c) 2020 Some Body\n\n{wrapped(t, '')}\n") for name, t in full.items()]
    rows += [(f"{name}/sub/x.c", f"/*\n{wrapped(' '.join(t.split()[:9] + ['somebody'] + t.split()[10:]), ' *')}\n */\nint main") for name, t in full.items()]
    found = {r.path: (r.own_licence, r.licence, r.licence_dir) for r in licences(files(spark, rows)).collect()}
    assert found == {p: (p.split("/")[0], p.split("/")[0], None) for p, _ in rows}


def brute(rows, templates, similar):
    """The cosine of every window, from the definition."""
    texts = [re.findall("[a-z0-9]+", (t or "").lower()) for _, t in rows]
    vocabulary = {w for t in templates for w in re.findall("[a-z0-9]+", t.text.lower())}
    idf = lambda w: math.log((1 + len(rows)) / (1 + (sum(w in t for t in texts) if w in vocabulary else 0))) + 1
    idf = {w: idf(w) for t in [*texts, vocabulary] for w in set(t)}
    out = []
    for (path, _), words in zip(rows, texts, strict=True):
        found = []
        for number, t in enumerate(templates):
            b = Counter(re.findall("[a-z0-9]+", t.text.lower()))
            n = min(sum(b.values()), len(words))
            for i in range(len(words) - n + 1) if words else ():
                a = Counter(words[i : i + n])
                dot = sum(a[w] * b[w] * idf[w] ** 2 for w in a)
                cosine = dot / math.sqrt(sum((k * idf[w]) ** 2 for w, k in a.items())) / math.sqrt(sum((k * idf[w]) ** 2 for w, k in b.items()))
                if round(cosine, 9) >= similar:
                    shown = context(words[max(0, i - 2) : i], words[i : i + n])
                    found.append((-round(cosine, 9), t.name, i, number, n, t, shown, all(re.search(p, shown) for p in t.telling)))
        found.sort(key=lambda x: x[:4])
        over = lambda x, y: x[2] < y[2] + y[4] and y[2] < x[2] + x[4]
        shown = [x for x in found if x[7] or len(words_of(x[5].text)) >= TITLE]
        back = [x for x in shown if re.search(NEGATED, x[6])]
        first = next((x for x in shown if x not in back and re.search(FAMILY.get(x[5].family, ""), x[6]) and not any(over(x, y) and y[:4] < x[:4] for y in back)), None)
        told = next((x for x in found if first and x[7] and x[5].family == first[5].family and over(x, first)), None)
        out.append((path, *((told[1], round(-told[0], 6)) if told else (first[5].family, round(-first[0], 6)) if first else (None, None))))
    return out


def test_against_every_window(spark):
    templates = (
        Template("A", "RG", "red green blue red", ("green",)), Template("B", "BY", "green blue yellow"), Template("C", "BY", "yellow blue green", ("^\\^",)),
        Template("D", "D", "one two three four five six seven", ("six", "! |[|] one")), Template("E", "D", "one two three four not six seven", ("not",)),
    )
    rng = random.Random(5)
    words = "red green blue yellow not one two three four five six seven other more".split()
    rows = [(f"p{i}", " ".join(rng.choices(words[: rng.choice([4, 5, 9, 14])], k=rng.choice([1, 2, 3, 5, 9, 40])))) for i in range(60)]
    rows += [("ties", "yellow green blue"), ("ties", "yellow green blue"), (None, "green blue yellow"), ("n", None), ("e", ""), ("w", "\u6771\u4eac ..."), ("long", "filler words " * 20_000 + "Red GREEN-blue\nred")]
    for similar in (0.8, 0.5):
        got = [(r.path, r.own_licence, r.similarity and round(r.similarity, 6)) for r in scan(files(spark, rows), templates=templates, similar=similar).collect()]
        assert Counter(got) == Counter(brute(rows, templates, similar))


def test_odd_rows_and_clashing_names(spark, odd):
    clashing = odd.withColumns({c: F.lit("x") for c in ("similarity", "depth", "word", "n", "dir", "own", "from", "files", "carry_0", "dir_licence")})
    got = licences(clashing.withColumn("path", F.concat(F.lit("a/"), F.col("doc_id"))), carry=("doc_id", "lang"))
    assert got.columns == ["path", "doc_id", "lang", "own_licence", "similarity", "licence", "licence_dir"]
    assert got.count() == odd.count() and got.filter("licence is not null").count() == 0


def test_other_text_names_no_licence(spark):
    rows = [("a", None), ("b", ""), ("c", "the work of the terms"), ("d", "word " * 20000), ("e", "Released under the sea by a crab with nine other words around it")]
    assert [r.own_licence for r in scan(files(spark, rows)).collect()] == [None] * 5


def test_counts_cover_all_texts(spark):
    n, counts = document_counts(files(spark, [("a", "MIT mit"), ("b", "the license"), ("c", None)]), "text")
    assert (n, counts["mit"], counts["license"], counts.get("apache")) == (3, 1, 1, None)
    assert Templates(TEMPLATES, n, counts).best(pa.array(["nothing known", None]), 0.8) == [(None, None)] * 2


def test_nearest_directory_wins(spark):
    mit, gpl = (next(t.text for t in TEMPLATES if t.name == name and len(words_of(t.text)) >= TITLE) for name in ("MIT", "GPL-3.0"))
    rows = [("LICENSE", gpl), ("a/LICENSE.txt", mit), ("a/b/c/x.py", "code"), ("a/b/own.py", gpl), ("z/y.py", "code"), ("a/copying", gpl), ("a/b/NOTICED", mit), (None, "code"), ("a/b/c/x.py", "code")]
    got = sorted(((r.path, r.licence, r.licence_dir) for r in licences(files(spark, rows)).collect()), key=repr)
    assert got == sorted([
        ("LICENSE", "GPL-3.0", None), ("a/LICENSE.txt", "MIT", None), ("a/b/c/x.py", "MIT", "a"), ("a/b/c/x.py", "MIT", "a"), ("a/b/own.py", "GPL-3.0", None), ("z/y.py", "GPL-3.0", ""),
        ("a/copying", "GPL-3.0", None), ("a/b/NOTICED", "MIT", None), (None, None, None),
    ], key=repr)


def test_empty(spark):
    assert inherit(scan(files(spark, []))).count() == 0
