"""WARC archives compressed record by record with a Zstandard dictionary.

Each archive is a .warc.zst file: a leading skippable frame holds a dictionary
built from the archive's first records, then every record is a frame of its own
compressed with that dictionary.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import if_small, written
from .files import created, opened

#: Fixed values of the .warc.zst format: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Records of so many bytes are held back to build an archive's dictionary, which takes DICTIONARY_BYTES at most.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
#: Digests of repeated payloads (some 100 bytes each) that are broadcast together.
FIRST_ROWS = 500_000
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 64 << 20

MANIFEST = "path string, records long, bytes long"
RECORD = T.StructType([
    T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
])


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses.

    Of pages with equal payloads of at least REVISIT_BYTES bytes, the smallest
    page_id is the response. Null html is an empty payload. Rows that repeat the
    smallest id are all responses, and so are groups whose ids are all null; a
    null id beside others revisits. Only the first ids of repeated payloads are
    gathered, and broadcast if few, so that pages need not move; beyond that a
    hot payload is split by the adaptive skew join.
    """
    rows = pages.select(
        F.col(id_col).cast("string").alias("page_id"), F.col(id_col).alias("id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = (
        rows.filter(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", "first")
    )
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(if_small(written(firsts, "warc-firsts"), FIRST_ROWS), "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(revisit, F.col("first")).cast("string").alias("refers_to")
    )


def _name(page_id: str | None) -> str:
    """A page's identifier in a record's head; a null id has none."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def _id_in(name: str) -> str | None:
    return None if name == "<urn:page>" else unquote(name.removeprefix("<urn:page:")[:-1])


def _record(page_id, url, html, digest, refers_to) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; with too few to train on, their own first bytes."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 8)), records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _write(records: Iterator[bytes], folder: str) -> Iterator[tuple[str, int, int]]:
    """Archives of at most about ARCHIVE_BYTES; holds SAMPLE_BYTES of records at a time."""
    more = True
    while more:
        held, size = [], 0
        while size < SAMPLE_BYTES and (more := (record := next(records, None)) is not None):
            held.append(record)
            size += len(record)
        if not held:
            return
        words = _dictionary(held)
        uri, out = created(folder, ".warc.zst")
        with out:
            content = words.as_bytes()
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
            frames, n, done = zstandard.ZstdCompressor(dict_data=words, write_content_size=True), 0, len(content) + 8
            for record in held:
                done += out.write(frames.compress(record))
                n += 1
            while done < ARCHIVE_BYTES and more and (more := (record := next(records, None)) is not None):
                done += out.write(frames.compress(record))
                n += 1
        yield uri, n, done


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the rows of revisits() as WARC records under folder; the manifest (path, records, bytes) is kept there too."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True))
        for path, n, size in _write((_record(*row) for row in rows), folder):
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return written(pages.mapInArrow(task, MANIFEST), "warc-manifest")


def _read(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of one archive, streamed."""
    with opened(uri) as raw:
        magic, size = struct.unpack("<II", raw.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{uri} does not start with a dictionary frame")
        words = zstandard.ZstdCompressionDict(raw.read(size))
        text = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(raw, read_across_frames=True), 1 << 20)
        while version := text.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"{uri}: {version[:40]!r} is not the start of a record")
            head = {}
            while (line := text.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            block = text.read(int(head["Content-Length"]))
            if text.read(4) != b"\r\n\r\n":
                raise ValueError(f"{uri}: a record does not end as it should")
            yield head, block


def _parsed(head: dict[str, str], block: bytes) -> tuple:
    """One row of RECORD and the payload (None for revisits); the digest of a response is computed from what was read."""
    http, _, payload = block.partition(b"\r\n\r\n")
    page_id = _id_in(head["WARC-Record-ID"])
    n = int(http.rpartition(b"Content-Length: ")[2])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    refers_to = _id_in(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
    if refers_to is None and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"page {page_id}: the payload read back differs from the one written")
    row = (page_id, head.get("WARC-Target-URI"), head["WARC-Type"], refers_to, digest, n)
    return row, payload if refers_to is None else None


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives in the manifest, a row each; payload (binary) on request. Archives are dealt out one by one."""
    schema = T.StructType([*RECORD, *([T.StructField("payload", T.BinaryType())] if with_payload else [])])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64()] + [pa.binary()] * with_payload
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, size = [], 0
                for record in _read(path):
                    row, payload = _parsed(*record)
                    rows.append((*row, payload) if with_payload else row)
                    size += len(payload or b"") * with_payload + 200
                    if size > 8 << 20:
                        yield _batch(rows, schema, kinds)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema, kinds)

    parts = max(1, min(manifest.count(), 8 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path").repartition(parts).mapInArrow(task, schema)


def _batch(rows: list[tuple], schema: T.StructType, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)
