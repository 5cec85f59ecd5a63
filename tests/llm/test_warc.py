from __future__ import annotations

import hashlib
import struct

import pytest

from peakloom.llm.common import new_path
from peakloom.llm.warc import DICTIONARY_MAGIC, read_archives, revisits, write_archives

PAGES = "page_id long, url string, html string, digest string, first string, refers_to string"


def expected(pages):
    out = {}
    for page_id, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        first = min(same) if len(data) >= 100 and same and sum((h or "") == (html or "") for *_, h in pages) > 1 else None
        kind = "revisit" if first is not None and page_id != first else "response"
        out.setdefault((None if page_id is None else str(page_id), len(data), hashlib.sha256(data).hexdigest(), kind, str(first) if kind == "revisit" else None), []).append(1)
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize(
    "pages",
    [
        [],
        [(1, "http://a/", "x" * 100), (2, "http://b/ c\r\nd", "x" * 100), (3, None, None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (None, "u", "x" * 100), (1, "http://a/", "x" * 100)],
        [(None, "u", "y" * 200), (None, "u", "y" * 200), (7, "u", "é" * 50), (8, "u", "é" * 50), (9, "u", "z" * 3_000_000), (10, "u", "\r\n\r\nWARC/1.1\r\n")],
        [(i, f"http://h/{i}", f"<p>{i % 40} " + "lorem ipsum " * (i % 17)) for i in range(400)],
    ],
)
def test_round_trip(spark, pages):
    df = spark.createDataFrame([(*p, "d", "f", "r") for p in pages], PAGES).repartition(3)
    manifest = write_archives(revisits(df), new_path(spark, "warc-test"))
    records = read_archives(manifest, with_payload=True).collect()
    found = {}
    for r in records:
        key = (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
        found[key] = found.get(key, 0) + 1
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    assert found == expected(pages)
    assert sum(m.records for m in manifest.collect()) == len(pages)


def test_any_text_is_an_id(spark):
    ids = ["None", "", "a>b", "x\r\nWARC-Type: revisit", "ü%41", "page", None]
    df = spark.createDataFrame([(i, "u", "same text " * 20, "", "", "") for i in ids], PAGES.replace("page_id long", "page_id string"))
    rows = read_archives(write_archives(revisits(df), new_path(spark, "warc-test"))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows if r.page_id is not None) == sorted((i, "revisit" if i else "response", "" if i else None) for i in ids if i is not None)
    assert [(r.record_type, r.refers_to) for r in rows if r.page_id is None] == [("revisit", "")]


def test_archives_start_with_a_dictionary_frame(spark):
    df = spark.createDataFrame([(i, "u", "some page text " * 30 + str(i), "", "", "") for i in range(300)], PAGES)
    for m in write_archives(revisits(df), new_path(spark, "warc-test")).collect():
        path = m.path.removeprefix("file://")
        with open(path, "rb") as f:
            magic, size = struct.unpack("<II", f.read(8))
            assert (magic, size > 0) == (DICTIONARY_MAGIC, True)
            f.seek(size, 1)
            assert f.read(4) == bytes.fromhex("28b52ffd")
