"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory above.

A template is compared with every run of as many words of a text, so it does
not matter how a notice is wrapped, commented or set into other text, and a
licence file is compared as a whole with the full text of a licence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import Powers, chunks, mix, utf8

#: Cosine from which a window names a licence.
SIMILAR = 0.8
#: Names of files that license their directory and all below it.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
#: Words are runs of ASCII letters and digits, in lower case; all else, letters of other scripts too, is between words.
WORD = re.compile(r"[a-z0-9]+")
#: A word before a notice that takes it back, in what `context` gives.
NEGATED = r"(^| )(not|never|neither|nor|no longer)( [a-z0-9]+)? \|"

#: Without the words that tell its licences apart, a family is named only where this is found in the window; other families, always.
FAMILY = {
    "GPL-family": "gnu general public license", "LGPL-family": "(lesser|library) general public license", "AGPL-family": "affero general public license",
    "Apache-family": "apache (software )?license", "MPL-family": "mozilla public license", "CC-family": "( cc | creative commons )", "CC0-family": "( cc0 | waived all copyright )",
    "MIT-family": "( mit |permission is hereby granted)",
}
#: Windows of fewer words, titles, count only if their telling patterns are found.
TITLE = 4


@dataclass(frozen=True)
class Template:
    """A text by which a licence is declared, its licence (SPDX) and family, and what tells it from its family's others.

    telling: patterns that all have to be found in the words of the window, two
    words before it and a bar, as `context` gives them ("^" for words before the text).
    """

    name: str
    family: str
    text: str
    telling: tuple[str, ...] = ()


#: Texts by which licences are usually declared. Placeholders for names are left out.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_FOUR = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
    "4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_ONE = (
    '3. The end-user documentation included with the redistribution, if any, must include the following acknowledgment: "This product includes software developed by the Apache Software Foundation '
    '(http://www.apache.org/)." Alternately, this acknowledgment may appear in the software itself, if and wherever such third-party acknowledgments normally appear. '
    '4. The names "Apache" and "Apache Software Foundation" must not be used to endorse or promote products derived from this software without prior written permission. '
    'For written permission, please contact apache@apache.org. 5. Products derived from this software may not be called "Apache", nor may "Apache" appear in their name, '
    "without prior written permission of the Apache Software Foundation."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_IF = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_IF = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = (
    '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
    "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
)
#: Licences of one wording: (SPDX, name in full) and their versions.
_GNU_NAMES = (("GPL", "General Public License", ("1", "2", "3")), ("LGPL", "Library General Public License", ("2",)), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("1", "3")))
_CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _plain(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def _gnu() -> Iterator[Template]:
    for short, name, versions in _GNU_NAMES:
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            telling = (rf"gnu {_plain(name)}", rf"version {_plain(v)}( |$)")
            yield Template(spdx, f"{short}-family", f"This work is licensed under the GNU {name}, version {v}.", telling)
            yield Template(spdx, f"{short}-family", _GNU.format(name, v, name), (telling[0], rf"version {_plain(v)} of the license"))


def _creative_commons() -> Iterator[Template]:
    for kind, name in _CC_KINDS.items():
        for v in _CC_VERSIONS:
            spdx = f"CC-{kind}-{v}"
            yield Template(spdx, "CC-family", f"Licensed under CC {kind} {v}.", (rf" cc {_plain(kind)} {_plain(v)}$",))
            yield Template(spdx, "CC-family", f"This work is licensed under a Creative Commons {name} {v} License.", (rf"creative commons {_plain(name)} {_plain(v)} ",))
    yield Template("CC0-1.0", "CC0-family", "Licensed under CC0 1.0.", (" cc0 1 0$",))
    yield Template("CC0-1.0", "CC0-family", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.")


TEMPLATES = (
    *(Template(f"Apache-{v}", "Apache-family", f"Licensed under the Apache {s}License, Version {v}.", (rf"apache {s.lower()}license version {_plain(v)}",)) for v, s in (("1.0", ""), ("1.1", ""), ("1.1", "Software "), ("2.0", ""))),
    Template("Apache-1.1", "BSD-family", _BSD + _APACHE_ONE, ("apache software foundation",)),
    Template("Apache-2.0", "Apache-family", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
     'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache license version 2 0",)),
    Template("BSD-2-Clause", "BSD-family", _BSD + _BSD_END, ("provided with the distribution this software is provided",)),
    Template("BSD-3-Clause", "BSD-family", _BSD + _BSD_THREE + _BSD_END, ("provided with the distribution (3 )?neither the name",)),
    Template("BSD-4-Clause", "BSD-family", _BSD + _BSD_FOUR + _BSD_END, ("all advertising materials",)),
    Template("BSD", "BSD-family", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ("$^",)),
    *_creative_commons(),
    *_gnu(),
    Template("0BSD", "ISC-family", _ISC + _ISC_END, ("is hereby granted the software",)),
    Template("ISC", "ISC-family", _ISC + _ISC_IF, ("provided that the above copyright notice",)),
    Template("ISC", "ISC-family", _ISC + _ISC_IF + _ISC_END, ("provided that the above copyright notice",)),
    *(Template(spdx, "MIT-family", f"Released under the {title} License.", (rf"the {_plain(title)} license",)) for spdx, title in (("MIT", "MIT"), ("MIT-0", "MIT-0"), ("MIT-0", "MIT No Attribution"))),
    Template("MIT", "MIT-family", "MIT License", (r"^\^ (\^|the) \| mit license$",)),
    Template("MIT-0", "MIT-family", "MIT No Attribution", (r"^\^ (\^|the) \| mit no attribution$",)),
    Template("MIT", "MIT-family", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("$^",)),
    Template("MIT-0", "MIT-family", _MIT + ". " + _MIT_END, ("furnished to do so the software is provided",)),
    Template("MIT", "MIT-family", _MIT + _MIT_IF + _MIT_END, ("this permission notice shall be included",)),
    *(Template(f"MPL-{v}", "MPL-family", f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.", (rf"mozilla public license v(ersion)? {_plain(v)}",)) for v in ("1.0", "1.1", "2.0")),
    Template("MPL-2.0", "MPL-family", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", (r"mozilla public license v(ersion)? 2 0",)),
    *(Template(f"MPL-{v}", "MPL-family", f'The contents of this file are subject to the Mozilla Public License Version {v} (the "License"); you may not use this file except in compliance with the License. '
     'You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. '
     "See the License for the specific language governing rights and limitations under the License.", (rf"mozilla public license v(ersion)? {_plain(v)}",)) for v in ("1.0", "1.1")),
    Template("Unlicense", "Unlicense-family", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
     "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("Zlib", "Zlib-family", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
     "3. This notice may not be removed or altered from any source distribution."),
)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_BYTES = np.arange(256)
_IN_WORD = ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 48) & (_BYTES <= 57))
_VALUES = np.random.default_rng(77).integers(1, 1 << 63, 256, np.uint64)[np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER))


def _spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of some texts begin and end, their hashes, and for each text the number of its first word (one more at the end)."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = _IN_WORD[data]
    out = np.concatenate([[True], ~word, [True]])
    starts = np.flatnonzero(word & (out[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (out[2:] | edge[1:])) + 1
    up, down = Powers.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def _hashes(words: list[str]) -> np.ndarray:
    data = "".join(words).encode()
    return _spans(np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64), np.frombuffer(data, np.uint8))[2]


def context(before: list[str], window: list[str]) -> str:
    """What patterns that tell licences apart look at."""
    return " ".join([*["^"] * (2 - len(before)), *before, "|", *window])


class Templates:
    """The templates' unit vectors under given document counts."""

    def __init__(self, templates: tuple[Template, ...], documents: int, containing: dict[str, int]):
        self.templates = templates
        self.unseen = math.log(1 + documents) + 1
        self.idf = {w: math.log((1 + documents) / (1 + containing.get(w, 0))) + 1 for t in templates for w in words_of(t.text)}
        self.vectors = []
        for t in templates:
            tf = Counter(words_of(t.text))
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in sorted(tf.items())))
            self.vectors.append((sum(tf.values()), {w: n * self.idf[w] ** 2 / norm for w, n in tf.items()}))
        known = sorted(self.idf)
        hashes = _hashes(known)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        # by place in hashes, and last for any other word
        self.squares = np.array([self.idf[known[i]] ** 2 for i in order] + [self.unseen**2])
        self.weights = [np.array([v.get(known[i], 0.0) for i in order] + [0.0]) for _, v in self.vectors]
        # what each word has of a template's squared length
        self.shares = np.stack([(w / np.sqrt(self.squares)) ** 2 for w in self.weights]) if templates else np.zeros((0, len(known) + 1))

    def cosine(self, template: int, words: list[str]) -> float:
        tf = Counter(words)
        norm = math.sqrt(sum((n * self.idf.get(w, self.unseen)) ** 2 for w, n in tf.items()))
        vector = self.vectors[template][1]
        return sum(n * vector[w] for w, n in tf.items() if w in vector) / norm

    def told(self, near: list[tuple[float, int, int, int]], text: list[str]) -> tuple[str | None, float | None]:
        """The licence of a text and its cosine, from its windows (cosine, template, first word, end) that are near a template.

        By falling cosine (9 digits; then by name and place), the first window
        counts that has its family's words, that no word before it takes back,
        and that overlaps none before it that is taken back. The licence is that
        of the first template of its family that overlaps it and whose telling
        patterns its own window holds; without one, the family is all that is
        known.
        """
        ranked = sorted(near, key=lambda x: (-round(x[0], 9), self.templates[x[1]].name, x[2], x[1]))
        seen = [context(text[max(0, at - 2) : at], text[at:end]) for _, _, at, end in ranked]
        tells = [all(re.search(p, c) for p in self.templates[x[1]].telling) for x, c in zip(ranked, seen, strict=True)]
        gone: list[tuple[int, int]] = []
        for (cosine, number, at, end), words, told in zip(ranked, seen, tells, strict=True):
            t = self.templates[number]
            if self.vectors[number][0] < TITLE and not told:
                continue
            if re.search(NEGATED, words):
                gone.append((at, end))
                continue
            if any(at < b and a < end for a, b in gone) or not re.search(FAMILY.get(t.family, ""), words):
                continue
            for x, good in zip(ranked, tells, strict=True):
                other = self.templates[x[1]]
                if good and other.family == t.family and x[2] < end and at < x[3]:
                    return other.name, x[0]
            return t.family, cosine
        return None, None

    def best(self, column: pa.Array, similar: float) -> list[tuple[str | None, float | None]]:
        """For each text its licence, as told() by the windows with a cosine of `similar` and more to a template, and the cosine; none if there are no such windows.

        A window has as many words as the template, or all of a shorter text's.
        A text is looked at for a template if the words that it has of it could
        reach the cosine. A window's vector is at least as long as if its words
        were all different, which bounds the cosine; only windows that the bound
        leaves are looked at word by word.
        """
        out: list[tuple[str | None, float | None]] = [(None, None)] * len(column)
        offsets, data = utf8(column)
        for lo, hi in chunks(offsets):
            part = data[offsets[lo] : offsets[hi]]
            starts, ends, hashes, first = _spans(offsets[lo : hi + 1] - offsets[lo], part)
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            place = np.where(self.hashes[place] == hashes, place, len(self.hashes))
            text_of = np.repeat(np.arange(hi - lo), np.diff(first))
            held = np.zeros((hi - lo, len(self.hashes) + 1))
            held[text_of, place] = 1
            held[:, -1] = 0
            looked = held @ self.shares.T >= (similar - 1e-6) ** 2
            for i in np.flatnonzero(looked.any(1)).tolist():
                a, b = int(first[i]), int(first[i + 1])
                here, near = place[a:b], []
                squares = np.concatenate([[0.0], np.cumsum(self.squares[here])])
                text: list[str] | None = None
                for t in np.flatnonzero(looked[i]).tolist():
                    n = min(self.vectors[t][0], b - a)
                    weights = np.concatenate([[0.0], np.cumsum(self.weights[t][here])])
                    dots = weights[n:] - weights[:-n]
                    for at in np.flatnonzero(dots >= (similar - 1e-6) * np.sqrt(np.maximum(squares[n:] - squares[:-n], 0))).tolist():
                        text = text or words_of(bytes(part[starts[a] : ends[b - 1]]).decode())
                        cosine = self.cosine(t, text[at : at + n])
                        if cosine >= similar - 1e-9:
                            near.append((cosine, t, at, at + n))
                if near:
                    out[lo + i] = self.told(near, text)
        return out


def document_counts(files: DataFrame, text_col: str, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """How many texts there are, and how many hold each word of the templates: a table as small as the templates."""
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    hashes = _hashes(vocabulary)
    order = np.argsort(hashes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts = np.zeros(len(order), np.int64), 0
        for b in batches:
            texts += len(b.column(0))
            offsets, data = utf8(b.column(0))
            for lo, hi in chunks(offsets):
                _, _, h, first = _spans(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
                place = np.minimum(np.searchsorted(hashes[order], h), len(order) - 1)
                here = np.flatnonzero(hashes[order][place] == h)
                text_of = np.searchsorted(first, here, "right") - 1
                pairs = np.unique(text_of * len(order) + place[here])
                found += np.bincount(pairs % len(order), minlength=len(order))
        counts = {vocabulary[i]: n for i, n in zip(order, found.tolist(), strict=True) if n} | {"": texts}
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = files.select(text_col).mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in rows}
    return counts.pop("", 0), counts


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", carry: tuple[str, ...] = (), templates=TEMPLATES, similar: float = SIMILAR) -> DataFrame:
    """path, the columns in carry, own_licence and similarity of every file: by its window most like a template, null below `similar`.

    own_licence is an SPDX identifier if the words that tell the licences of a
    family apart are there, else the family (as `BSD-family`). A notice that
    "not" or the like takes back is none.

    Whole texts are read. Null, empty and wordless texts have no licence. Of
    equal cosines (to 9 digits) the licence first in order counts. Rows that
    repeat and null paths are judged like others; no rows: no rows. Columns of
    files other than these may have any names; carried ones must not be called
    path, own_licence or similarity.
    """
    known = Templates(templates, *document_counts(files, text_col, templates))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = zip(*known.best(b.column(1), similar), strict=True) if len(b.column(1)) else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], columns)

    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    columns = ["path", *rows.columns[2:], "own_licence", "similarity"]
    kinds = [rows.schema[c].dataType.simpleString() for c in columns[:-2]]
    schema = ", ".join(f"{c} {k}" for c, k in zip(columns, [*kinds, "string", "double"], strict=True))
    return rows.mapInArrow(task, schema).toDF("path", *carry, "own_licence", "similarity")


def inherit(scanned: DataFrame) -> DataFrame:
    """Add licence and licence_dir: a file's own licence (null directory), or that of the nearest directory at or above it.

    A directory's licence is that of its licence file first in path order.
    Directories, not files, are resolved against their ancestors. A null path
    inherits nothing; the root directory is the empty string.
    """
    parts = F.split("path", "/")
    placed = scanned.withColumn("dir", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    name = F.element_at(parts, -1)
    licensed = placed.filter(F.col("own_licence").isNotNull() & name.rlike(LICENCE_FILE)).groupBy("dir").agg(F.min_by("own_licence", F.struct("path", "own_licence")).alias("dir_licence"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(F.when(n == 0, "").otherwise(F.array_join(F.slice(steps, 1, n), "/")).alias("licence_dir"), n.alias("depth")))
    dirs = placed.filter("dir is not null").groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    ancestors = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.licence_dir", "a.depth")
    nearest = (
        ancestors.join(licensed.withColumnRenamed("dir", "licence_dir"), "licence_dir")
        .groupBy("dir").agg(F.max_by(F.struct("licence_dir", "dir_licence"), "depth").alias("from"))
    )
    own = F.col("own_licence").isNotNull()
    return placed.join(nearest, "dir", "left").select(
        *scanned.columns,
        F.coalesce("own_licence", "from.dir_licence").alias("licence"),
        F.when(~own, F.col("from.licence_dir")).alias("licence_dir"),
    )


def licences(files: DataFrame, path_col: str = "path", text_col: str = "text", carry: tuple[str, ...] = (), templates=TEMPLATES, similar: float = SIMILAR) -> DataFrame:
    """path, the columns in carry, own_licence, similarity, licence and licence_dir of every file, by scan() and inherit().

    A file without a path or a licensed directory above it, and without a
    licence of its own, has null in all four.
    """
    return inherit(written(scan(files, path_col, text_col, carry, templates, similar), "licence-scan"))
