"""WARC archives: write with an index, read back by coalesced byte ranges.

Method. Every page becomes one record, a gzip member of its own, in archive files of at most about ``roll_bytes``. The index
is written with it: archive, offset, length, URL and digest of each record. Reading begins with the index: the
records wanted are picked there, sorted by archive and offset, neighbouring ranges (gaps up to ``gap``) are coalesced
into reads of at most ``read_bytes``, and each record is cut out of its read, inflated and checked against its digest. The rows picked are
dealt by range of archive and offset and sorted, so whatever their order was, a task reads on in few files; it holds at
most ``read_bytes`` of payloads (one record at least).

Of records with equal payloads (same SHA-1 and length) of at least ``dedup_bytes`` bytes, the one with the smallest
page id is a response and holds the payload; the others are revisits that name it, by its URL (WARC-Refers-To-Target-URI and -Date), which other
readers follow, and by its page id. Each archive begins with a warcinfo record, which no index row names. The table of payloads that occur more
than once is broadcast up to a checked size and joined by a shuffle beyond it.

A writer that is retried leaves a file that no index names; nothing reads it. Archives go where ``folder`` says, through
Arrow's file systems (file, hdfs, s3, gs), so all executors must reach it; archives and index are plain files.

Defined results: a null html is an empty payload; a null URL is written as ``urn:page:ID`` and stays null in the index. Rows
that repeat both smallest id and payload are all responses. A null id sorts last, and records without an id come
back without one. White space and control characters in a URL are percent-encoded in the record, not in the index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, sized, staged, store

_INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"


def _header_url(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{'' if page_id is None else page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record(kind: str, headers: list[tuple[str, object]], body: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(body)}"]
    return "\r\n".join([*head, "", ""]).encode("utf-8", "surrogateescape") + body + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, content) of one inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record ends early or late")
    return headers, rest[:size]


def _writer(folder: str, roll_bytes: int, level: int, date: str):
    def run(batches):
        files, top = store(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                ids, urls, html, first, first_url = (b.column(k) for k in range(5))
                rows = []
                for i in range(b.num_rows):
                    page_id, url, payload, least = ids[i].as_py(), urls[i].as_py(), html[i].as_py() or b"", first[i].as_py()
                    again = least is not None and page_id != least
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    headers = [("WARC-Date", date), ("WARC-Target-URI", _header_url(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "text/html"), ("X-Page-ID", page_id)]
                    if again:
                        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", _header_url(first_url[i].as_py(), least)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", least)]
                    member = _member(_record("revisit" if again else "response", headers, b"" if again else payload), level)
                    if out is None or at + len(member) > roll_bytes and at:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{top}/{name}", compression=None)
                        info = _member(_record("warcinfo", [("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level)
                        out.write(info)
                        at = len(info)
                    out.write(member)
                    rows.append((page_id, url, name, at, len(member), digest, len(payload), "revisit" if again else "response", least if again else None))
                    at += len(member)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, folder: str, dedup_bytes: int = 0, roll_bytes: int = 32 << 20, level: int = 4, date: str | None = None) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) below folder/archives and returns the index, written below folder/index.

    date: when the pages were fetched, as 2000-01-31T00:00:00Z; by default now.
    """
    spark = pages.sparkSession
    files, top = store(folder)
    files.create_dir(f"{top}/archives", recursive=True)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    digests = pages.select("page_id", "url", F.sha1(html).alias("_sha1"), F.octet_length(html).alias("_size"))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    again = digests.where(F.col("_size") >= dedup_bytes).groupBy("_sha1", "_size").agg(F.min(named).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = sized(staged(again.select("_sha1", "_size", F.col("_first.page_id").alias("_first"), F.col("_first.url").alias("_first_url")), "repeated-payloads"), 200_000)
    rows = pages.select("page_id", "url", html.alias("_html"), F.sha1(html).alias("_sha1"), F.octet_length(html).alias("_size"))
    rows = rows.join(again, ["_sha1", "_size"], "left").select("page_id", "url", "_html", "_first", "_first_url")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows.mapInArrow(_writer(f"{folder}/archives", roll_bytes, level, date), _INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def _reader(folder: str, gap: int, read_bytes: int):
    """Rows (archive, offset, length, payload bytes), sorted, become records."""

    def read(source, archive: str, rows: list[tuple[int, int]]):
        """The records of one read: neighbouring rows (offset, length) of an archive."""
        lo, out = rows[0][0], []
        block = memoryview(source.read_at(max(o + n for o, n in rows) - lo, lo))
        for offset, length in rows:
            headers, payload = parse_record(zlib.decompress(block[offset - lo : offset - lo + length], 31))
            digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{archive} at {offset}: the payload does not have its digest")
            number = lambda h: int(headers[h]) if h in headers else None  # noqa: E731, B023
            out.append((number("x-page-id"), number("x-payload-length") if kind == "revisit" else len(payload), digest, kind, number("x-refers-to-page"), headers["warc-target-uri"], payload))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"])

    def run(batches):
        files, top = store(folder)
        opened, source, rows, size = None, None, [], 0
        for b in batches:
            for archive, offset, length, payload in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if rows and (archive != opened or offset - sum(rows[-1]) > gap or size + max(length, payload) > read_bytes):
                    yield read(source, opened, rows)
                    rows, size = [], 0
                if archive != opened:
                    if source is not None:
                        source.close()
                    opened, source = archive, files.open_input_file(f"{top}/{archive}")
                rows.append((offset, length))
                size += max(length, payload)
        if rows:
            yield read(source, opened, rows)
        if source is not None:
            source.close()

    return run


def read(index: DataFrame, folder: str, gap: int = 64 << 10, read_bytes: int = 8 << 20) -> DataFrame:
    """The records that index (or rows picked from it) names: page_id, payload_bytes, payload_digest, record_type,
    refers_to, target_uri and payload (empty for revisits; their length is that of the full payload)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"
    held = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    picked = index.select("archive", "offset", "length", held.alias("held"))
    parts = max(1, (picked.agg(F.sum("length")).first()[0] or 0) // (4 * read_bytes))
    ordered = picked.repartitionByRange(int(max(parts, index.sparkSession.sparkContext.defaultParallelism)), "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(_reader(f"{folder}/archives", gap, read_bytes), schema)


def round_trip(pages: DataFrame, dedup_bytes: int = 0) -> DataFrame:
    """Writes pages to a fresh folder of the workspace and reads all records back; payloads are left out."""
    folder = new_folder(pages.sparkSession, "warc")
    index = write(pages, folder, dedup_bytes)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
