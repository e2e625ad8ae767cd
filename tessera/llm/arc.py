"""Legacy archives: ARC writer, version-specific ARC parser, ARC to WARC conversion, WARC reader.

An ARC file starts with a version block whose last line names the header fields: five in version 1 (URL, IP-address,
Archive-date, Content-type, Archive-length), ten in version 2 (with Result-code, Checksum, Location, Offset and
Filename).  Each record is a header line of those fields, split from the right because URLs may hold spaces, and as many bytes as
the declared length.  The converter synthesises for each record a WARC identifier (UUID version 5 of the record's key,
or of URL, date and digest), the date in ISO form, the type (warcinfo, response for HTTP blocks, resource for the rest,
revisit where the payload has been seen), and SHA-1 digests in base 32 of block and payload.

Duplicates are known before conversion: digests are grouped with map-side combination, and only digests that occur
more than once are joined back (broadcast if few, otherwise by a shuffle whose hot keys Spark splits).

Archives are written through Spark's text source, whose row separator is the blank lines that end a WARC record,
gzipped, into the shared folder; so a lost task is written again and only committed files are read back.  A file holds
``records_per_file`` records of at most 64 KB, 60 of at most 1 MB, or one larger record, and 100 records or 16 MB are
converted at a time, so memory follows the largest payload, whatever the mixture.

Defined results: null payloads are empty; empty payloads are records like others.  Of records with equal payloads of
at least ``min_bytes`` bytes the smallest key's is the response (repeated rows of that key all are), the others are revisits;
smaller ones are all responses.  A payload is held whole, so it is bounded by a task's memory and by 2 GB.  A null key is never the smallest unless all are null (then all are responses).  A null
URL is written as ``-``; white space and control characters in URLs are percent-encoded.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_dir, frugal, groups_by_bytes

FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
KEY, REFERS = "X-Record-Key", "X-Refers-To-Key"
SEPARATOR = "\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"


# --- ARC ----------------------------------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tessera\n{' '.join(FIELDS[version])}\n\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, *, offset: int = 0, name: str = "-", status: int = 200) -> bytes:
    extra = "" if version == 1 else f"{status} - - {offset} {name} "
    return f"\n{url} 0.0.0.0 {date} {mime} {extra}{len(block)}\n".encode() + block


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """All records, the version block first.  Fields come from the file's own field line; lengths are believed."""
    at, names = 0, FIELDS[1]
    version = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if version == 0:
            length = int(line.rsplit(" ", 1)[1])
            body = data[end + 1 : end + 1 + length]
            lines = body.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            names = tuple(lines[1].split())
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"bad ARC header: {line[:200]!r}")
        fields = dict(zip(names, parts, strict=True))
        start, length = end + 1, int(fields["Archive-length"])
        if start + length > len(data):
            raise ValueError(f"ARC record cut short: {line[:200]!r}")
        yield ArcRecord(version, fields, data[start : start + length])
        at = start + length


# --- WARC ---------------------------------------------------------------------------------------------------------


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload."""
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (b"", block)


def http_headers(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def iso_date(arc_date: str) -> str:
    d = (re.sub(r"\D", "", arc_date) + "19700101000000"[len(re.sub(r"\D", "", arc_date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(rec: ArcRecord, first: str | None = None) -> bytes:
    """A WARC record without the blank lines at its end.  ``first``: key of the earlier record with this payload."""
    f, block = rec.fields, rec.block
    url = f["URL"]
    http = block.startswith(b"HTTP/")
    head, payload = split_http(block) if http else (b"", block)
    key = http_headers(head).get(KEY.lower())
    digest = sha1_base32(payload)
    kind = "response" if http else "warcinfo" if url.startswith("filedesc:") else "resource"
    lines = [("WARC-Record-ID", record_id(f"key:{key}" if key is not None else f"{url} {f['Archive-date']} {digest}"))]
    if first is not None and kind == "response":
        kind, block = "revisit", head
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(f"key:{first}")), (REFERS, first)]
    kinds = {"warcinfo": "application/warc-fields", "response": "application/http;msgtype=response", "revisit": "application/http;msgtype=response"}
    lines += [("WARC-Type", kind), ("WARC-Date", iso_date(f["Archive-date"]))]
    lines += [("WARC-Filename", url.removeprefix("filedesc://"))] if kind == "warcinfo" else [("WARC-Target-URI", url)]
    if f.get("IP-address", "0.0.0.0") != "0.0.0.0":
        lines.append(("WARC-IP-Address", f["IP-address"]))
    if kind != "warcinfo":
        lines.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    lines += [("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", kinds.get(kind, f["Content-type"])), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = field(repr=False)


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"bad WARC record: {first[:80]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        start, length = end + 4, int(headers["content-length"])
        if data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError("WARC record not ended where declared")
        yield WarcRecord(headers, data[start : start + length])
        at = start + length + 4


# --- DataFrames ---------------------------------------------------------------------------------------------------


def http_block(key: str, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{KEY}: {key}\r\n\r\n".encode() + payload


def with_first(pages: DataFrame, *, min_bytes: int, broadcast_rows: int) -> DataFrame:
    """pages (key, url, payload) with ``first``: the smallest key of an equal payload, null where that is its own."""
    digest = F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload"))
    many = checkpoint(pages.select("key", digest.alias("d")).where("d is not null").groupBy("d").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first"))
    few = many.count() <= broadcast_rows
    joined = pages.withColumn("d", digest).join(F.broadcast(many) if few else many, "d", "left").drop("d")
    return joined.withColumn("first", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")))


def convert(pages: DataFrame, folder: str, *, key: str, url: str, payload: str, version: int = 2, date: str = "20000101000000", min_bytes: int = 0, records_per_file: int = 1000, broadcast_rows: int = 100_000) -> None:
    """Archives pages as ARC, converts that to WARC and writes WARC files to ``folder``."""
    rows = pages.select(F.col(key).cast("string").alias("name"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    ready = with_first(rows, min_bytes=min_bytes, broadcast_rows=broadcast_rows).select("name", "url", "payload", F.col("first").cast("string").alias("first"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(rb.column(2)).to_numpy(zero_copy_only=False))])
            for i, n in ((k, min(100, b - k)) for a, b in groups_by_bytes(sizes, 16 << 20) for k in range(a, b, 100)):
                names, urls, payloads, firsts = (c.to_pylist() for c in rb.slice(i, n).columns)
                arc, offset, name = [arc_head(version, "part.arc", date)], 0, "part.arc"
                for n, u, p in zip(names, urls, payloads, strict=True):
                    offset += len(arc[-1])
                    arc.append(arc_record(version, safe_url(u), date, "text/html", http_block("" if n is None else n, p), offset=offset, name=name))
                records = parse_arc(b"".join(arc))
                next(records)  # the version block
                yield pa.RecordBatch.from_arrays([pa.array([to_warc(r, f) for r, f in zip(records, firsts, strict=True)], pa.binary())], names=["record"])

    size = F.octet_length("payload")
    most = rows.agg(F.max(size).alias("most")).first().most or 0
    for low, high, records in ((-1, 1 << 16, records_per_file), (1 << 16, 1 << 20, 60), (1 << 20, 1 << 31, 1)):
        if low < most or low < 0:
            text = ready.where((size > low) & (size <= high)).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
            text.write.mode("append").option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", records).text(folder)


def read_warc(spark, folder: str, *, key_type: str = "bigint") -> DataFrame:  # noqa: ANN001
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every record but warcinfo, digests verified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("content")
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for content in rb.column(0):
                rows = []
                for r in parse_warc(gzip.decompress(content.as_py())):
                    h = r.headers
                    if h["warc-type"] == "warcinfo":
                        continue
                    if f"sha1:{sha1_base32(r.block)}" != h["warc-block-digest"]:
                        raise ValueError(f"block digest differs: {h['warc-record-id']}")
                    head, payload = split_http(r.block)
                    told = http_headers(head)
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"payload digest differs: {h['warc-record-id']}")
                    rows.append((told.get(KEY.lower()) or None, int(told.get("content-length", len(payload))), digest, h["warc-type"], h.get(REFERS.lower())))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(cols)], names=names)

    raw = files.mapInArrow(run, "key string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return raw.withColumns({"key": F.col("key").cast(key_type), "refers_to": F.col("refers_to").cast(key_type)})


def archive_and_read(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None, **how: object) -> DataFrame:
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    convert(pages, folder, key=key, url=url, payload=payload, **how)
    return read_warc(spark, folder, key_type=pages.schema[key].dataType.simpleString()).withColumnRenamed("key", key)
