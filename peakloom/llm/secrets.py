"""Secret scan: an Aho-Corasick prefilter, anchored patterns at its hits, and checksums that some secrets carry inside.

Two automata read every text once: one finds the words that announce a secret,
in any case, the other finds runs of hexadecimal digits in a copy of the text
where every such digit is the same letter. A pattern is only ever tried at a hit.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import utf8

#: Patterns of each kind and the least characters of what must be long enough (group 2 of assign, else all of a match).
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Tokens of 30 characters and a checksum of 6 behind these prefixes; digits of the checksum.
GITHUB, NPM = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("npm_",)
TOKEN = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6,})")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3

_DIGIT = np.isin(np.arange(256), list(b"0123456789abcdef"))
_SAME = bytes(ord("h") if d else ord(".") for d in _DIGIT)


def checksum(body: bytes) -> str:
    """CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = DIGITS[digit] + out
    return out


def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """For words that announce secrets, in lower case: (number of the kind, length); for hexadecimal runs, in the copy of one letter."""
    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, listed in enumerate((ASSIGN_WORDS, ("akia",), (), GITHUB, NPM)):
        for word in listed:
            words.add_word(word, (kind, len(word)))
    runs.add_word("h" * HEX_LEAST, HEX_LEAST)
    words.make_automaton()
    runs.make_automaton()
    return words, runs


def spans_of(data: bytes, words: ahocorasick.Automaton, runs: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of every secret in a text's UTF-8, in order.

    Of each kind matches are leftmost and don't overlap; one that is too short
    still covers its characters, as it does for a search of the pattern alone.
    """
    found = []
    hits = sorted((end - n + 1, kind) for end, (kind, n) in words.iter(data.lower().decode("latin-1")))
    after = [0] * len(KINDS)
    for start, kind in hits:
        if start < after[kind]:
            continue
        match = (ASSIGN, ACCESS, None, TOKEN, TOKEN)[kind].match(data, start)
        if match is None:
            continue
        after[kind] = match.end()
        if kind == 0:
            good = match.end(2) - match.start(2) >= ASSIGN_LEAST
        elif kind == 1:
            good = match.end() - start >= ACCESS_LEAST
        else:
            good = checksum(match[1]) == match[2].decode()
        if good:
            found.append((start, kind, match.end()))
    covered = 0
    for end, n in runs.iter(data.translate(_SAME).decode("latin-1")):
        if end >= covered:  # the first hit in a run ends with its 24th digit
            covered = HEX.match(data, end - n + 1).end()
            found.append((end - n + 1, 2, covered))
    return sorted(found)


def listed(data: np.ndarray, spans: list[tuple[int, int, int]], kinds: range) -> str:
    """kind:start:end of spans of some kinds, in code points, joined by commas."""
    if not spans:
        return ""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return ",".join(f"{KINDS[k]}:{lead[a]}:{lead[b]}" for a, k, b in spans if k in kinds)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_checked, base_sha256, spans) of every row's whole text.

    spans lists every secret as kind:start:end (code points, end exclusive) by
    start; base_sha256 is the SHA-256 of that list for the kinds assign, access
    and hex alone. Kinds github and npm are tokens whose checksum is right
    (n_checked of them); one may lie inside a base span. Null and empty texts
    have none. Repeated rows and null ids are scanned like any other; an empty
    table gives an empty one. Other columns don't matter, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs = automata()
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = data[a:b]
                spans = spans_of(text.tobytes(), words, runs)
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(BASE)]
                base = hashlib.sha256(listed(text, spans, range(BASE)).encode()).hexdigest()
                out.append((*counts, len(spans) - sum(counts), base, listed(text, spans, range(len(KINDS)))))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")


#: The same in DuckDB (a run that is too short holds no longer one): pieces between matches and matches in turn give the places; the checksum is CRC-32 bit by bit.
_PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "github": r"gh[pousr]_[A-Za-z0-9]{36,}", "npm": r"npm_[A-Za-z0-9]{36,}",
}
_VALUE = r"""^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?"""
ORACLE_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
kinds as (select * from (values {', '.join(f"({i}, '{k}')" for i, k in enumerate(KINDS))}) as v(k, kind)),
cut as ({' union all '.join(f"select r, {i} as k, regexp_extract_all(text, '{_PATTERNS[k]}') as ms, regexp_split_to_array(text, '{_PATTERNS[k]}') as ps from d" for i, k in enumerate(KINDS))}),
placed as (select r, k, unnest(ms) as m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0))) as a from cut where len(ms) > 0),
codes as (select r, k, a, list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(range(5, 35), lambda i: cast(ord(m[i]) as bigint))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [cast(0 as bigint) for j in range(0, 8)]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as inverse from placed where k >= {BASE} and length(m) = 40),
sums as (select r, k, a, array_to_string(list_transform(range(5, -1, -1), lambda i: substr('{DIGITS}', cast(1 + (xor(inverse, 4294967295) // cast(62 ** i as bigint)) % 62 as bigint), 1)), '') as s from codes),
good as (select r, k, cast(a as bigint) as a, cast(a + length(m) as bigint) as b from placed left join sums using (r, k, a)
  where case k when 0 then length(regexp_replace(m, '{_VALUE}', '')) >= {ASSIGN_LEAST} when 1 then length(m) >= {ACCESS_LEAST} when 2 then length(m) >= {HEX_LEAST} else right(m, 6) = s end),
lists as (select r, count(*) filter (k = 0) as x, count(*) filter (k = 1) as y, count(*) filter (k = 2) as z, count(*) filter (k >= {BASE}) as c,
  string_agg(concat(kind, ':', a, ':', b), ',' order by a, k) filter (k < {BASE}) as base, string_agg(concat(kind, ':', a, ':', b), ',' order by a, k) as spans from good join kinds using (k) group by 1)
select doc_id, coalesce(x, 0) as n_assign, coalesce(y, 0) as n_access, coalesce(z, 0) as n_hex, coalesce(c, 0) as n_checked, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join lists using (r)
"""
