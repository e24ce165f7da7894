"""WARC archives of pages with an index of byte ranges.

Writing: of records with equal payloads of at least ``MIN_REVISIT`` bytes the one
with the largest page_id is a response and the others revisit it; equality is
that of SHA-1 and length, found by an aggregation, so a hot payload costs one
row.  Each task writes its pages as one archive of single gzip members and
returns the index: file, offset, length, URL, digest and type of each record.

Reading: the index rows that are wanted are sorted by file and offset, and
neighbouring ranges are coalesced into one read.  Every payload is checked
against the digest in its header.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh_path, saved, sized, slices
from sparkloom.llm.files import Input, Output, coalesced, reading_tasks

MIN_REVISIT = 1000
#: Archives are closed at this size; reads are joined over this gap, up to this length.
FILE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 4 << 20
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string, refers_to long"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One gzip member; a revisit has no payload of its own, its size is kept in a header."""
    place = "" if url is None else "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": _DATE, "WARC-Target-URI": place, "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}", "X-Payload-Length": str(len(payload))}
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": _PROFILE}
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html; other columns are ignored) and return the index, itself a table in the shared folder.

    Null html is an empty payload, a null url an empty one.  Rows without
    page_id are always responses.  Of rows that repeat a page_id and a payload,
    all are responses if the id is the largest.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    keyed = rows.select("page_id", F.sha1(raw).alias("sha"), F.octet_length("html").alias("bytes")).where(F.col("page_id").isNotNull() & (F.col("bytes") >= MIN_REVISIT))
    # Written first, so that a payload of very many pages is a join key that Spark can split.
    first = saved(keyed.groupBy("sha", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "bytes", "first"), "first-pages")
    revisits = saved(keyed.join(sized(first), ["sha", "bytes"]).where("page_id != first").select("page_id", F.col("first").alias("refers_to"), F.col("sha").alias("of")).distinct(), "revisits")
    # A page_id may repeat with another payload: only the payload meant is a revisit, the others stay responses.
    revisits = revisits.withColumnRenamed("page_id", "_page")
    meant = (F.col("page_id") == F.col("_page")) & (F.col("sha") == F.col("of"))
    joined = rows.withColumn("sha", F.sha1(raw)).join(sized(revisits), meant, "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in slices(batches, 200):
            found: list[tuple] = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                digest = hashlib.sha1(payload).digest()
                member = _record(page_id, url, payload, digest, refers_to)
                if out is None or out.size + len(member) > FILE_BYTES:
                    if out:
                        out.close()
                    out = Output(folder, ".warc.gz")
                found.append((page_id, url, out.path, out.write(member), len(member), digest.hex(), "response" if refers_to is None else "revisit", refers_to))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "file", "offset", "length", "digest", "record_type", "refers_to"])
        if out:
            out.close()

    return saved(joined.mapInArrow(write, _INDEX), "warc-index")


def read_warc(index: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the records that the rows of ``index`` name.

    payload is null for revisits; their size and digest are those that the
    archive gives for the payload they revisit.  A payload that differs from its
    digest is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, path = None, None
        for batch in slices(batches, 500):
            names, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if names[lo] != path:
                    if held:
                        held.close()
                    held, path = Input(names[lo]), names[lo]
                ranges = list(zip(offsets[lo:hi], lengths[lo:hi], strict=True))
                for at, length, first, last in coalesced(ranges, GAP_BYTES, READ_BYTES):
                    data = held.read(at, length)
                    rows = []
                    for offset, n in ranges[first:last]:
                        head, payload = _parsed(data[offset - at : offset - at + n])
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:"))
                        response = head["WARC-Type"] == "response"
                        if response and (hashlib.sha1(payload).digest() != digest or len(payload) != int(head["X-Payload-Length"])):
                            raise ValueError("a payload differs from its digest")
                        number = head["WARC-Record-ID"][len("<urn:page:") : -1]
                        rows.append((int(number) if number else None, head["WARC-Target-URI"], head["WARC-Type"], None if response else int(head["WARC-Refers-To"][len("<urn:page:") : -1]), int(head["X-Payload-Length"]), digest.hex(), payload if response else None))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        if held:
            held.close()

    wanted = index.select("file", "offset", "length").repartitionByRange(reading_tasks(index), "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
