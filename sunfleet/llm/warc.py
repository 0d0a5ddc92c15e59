"""WARC archives of captures, and the assembly of transactions from their records.

A capture is a request record, a response or revisit record and a metadata record; the first and the last name the
response in WARC-Concurrent-To. Archives are WARC files of bounded size in the shared folder, each record a gzip member of its
own, so that reading holds one record at a time. A table names the archives that count: those of a task that ran twice, or
was lost, are in no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfleet.llm.shared import new_path, salted_join, stored

DATE = "2026-01-01T00:00:00Z"
#: Bytes after which an archive ends.
ARCHIVE_BYTES = 1 << 26
_LEVEL, _READ = 4, 1 << 20
_END = "\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(kind: str, key: str) -> str:
    x = hashlib.md5(f"{kind} {key}".encode()).hexdigest()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def _record(kind: str, record_id: str, fields: dict[str, str], block: str) -> str:
    size = len(block.encode())
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in fields.items()], f"Content-Length: {size}"]
    return "\r\n".join(lines) + _END + block


def _line(text: str | None) -> str:
    """A header's value: percent signs, blanks and control characters of a URL are written as %XX."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c in "%\x7f" else c for c in text or "")


def _unline(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text[i] == "%":
            out.append(chr(int(text[i + 1 : i + 3], 16)))
            i += 3
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def records_of(url: str | None, page: int | None, html: str | None, first: int | None, row: int | None = None) -> list[str]:
    """The three records of a capture; it revisits the capture `first` of an equal payload if that is another page. Record ids
    name page, payload and `row`; the capture to which others refer has no row."""
    html = html or ""
    payload = html.encode()
    digest = "sha1:" + base32_sha1(payload)
    uri, key = _line(url), f"{page} {digest}" if row is None else f"{page} {digest} {row}"
    own, target = _id("response", key), {"WARC-Target-URI": uri} if uri else {}
    if page is None or first == page:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{_END}"
        main = _record("response", own, target | {"WARC-Payload-Digest": digest, "Content-Type": "application/http;msgtype=response"}, head + html)
    else:
        fields = target | {
            "WARC-Payload-Digest": digest, "WARC-Refers-To": _id("response", f"{first} {digest}"),
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Type": "application/http;msgtype=response",
        }
        main = _record("revisit", own, fields, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{_END}")
    joint = target | {"WARC-Concurrent-To": own}
    request = _record("request", _id("request", key), joint | {"Content-Type": "application/http;msgtype=request"}, f"GET {uri or '/'} HTTP/1.1{_END}")
    metadata = _record("metadata", _id("metadata", key), joint | {"Content-Type": "application/warc-fields"}, f"pageId: {page}\r\nfetchTimeMs: 0\r\n")
    return [request, main, metadata]


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes page_id, url, html to WARC files in the folder `path`, which all executors share; returns file, n_records, bytes.

    Of equal payloads that with the smallest page_id is a response, the others are revisits of it. A null html is an empty
    payload; a page without an id is a response of its own. Each row is a capture with record ids of its own, equal rows too.
    Where the row to which others refer has equal ones, one is picked by its place: `pages` is read twice, in the same order.
    An empty table gives no archive. No payload, however often it is there, is dealt to one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("row", F.monotonically_increasing_id())
    copies = rows.groupBy("digest", "page_id", "url").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    firsts = copies.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "row", "n"))).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        file, out, n, size = "", None, 0, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n]), pa.array([size])], ["file", "n_records", "bytes"])
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64).to_pydict()
                for row in zip(part["url"], part["page_id"], part["html"], part["first"], part["row"], strict=True):
                    if out is None:
                        file, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{folder}/{file}", compression=None)
                    for record in records_of(*row):
                        size += out.write(member(record))
                        n += 1
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield done()
        if out is not None:
            out.close()
            yield done()

    # the last join is the one shuffle of payloads; its partitions, cut by size, are the archives
    joined = salted_join(rows, firsts, "digest", F.col("row"))
    named = (F.col("page_id") == F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & ((F.col("first.n") == 1) | (F.col("row") == F.col("first.row")))
    joined = joined.select("page_id", "url", "html", F.col("first.page_id").alias("first"), F.when(~F.coalesce(named, F.lit(False)), F.col("row")).alias("row"))
    return stored(joined.mapInArrow(write, "file string, n_records long, bytes long"), "archives")


def member(record: str) -> bytes:
    """A record and the two line breaks that end it, as a gzip member."""
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress((record + _END).encode()) + packer.flush()


def members(source: BinaryIO) -> Iterator[bytes]:
    """The content of each gzip member of a stream; one is in memory at a time."""
    data, unpacker, parts = source.read(_READ), None, []
    while data:
        unpacker = unpacker or zlib.decompressobj(31)
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = None, []
        data = data or source.read(_READ)
    if unpacker is not None:
        raise ValueError("an archive ends within a record")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record in `data`, framed by Content-Length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        begin = stop + 4
        at = begin + int(fields["Content-Length"])
        yield fields, data[begin:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {at}")
        at += 4


RECORDS = "record_id string, type string, concurrent_to string, refers_to string, uri string, stated_digest string, page_id long, payload_bytes long, payload_digest string, payload binary, request string, fields string"


def read_records(archives: DataFrame, path: str, keep_payload: bool = False) -> DataFrame:
    """RECORDS of the archives in the folder `path` that a table of write_archives() names. Digests and sizes are of the payloads
    as read; a record whose payload has another digest than it states is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        kinds = [{"long": pa.int64(), "binary": pa.binary()}.get(x.split(" ")[1], pa.string()) for x in RECORDS.split(", ")]
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        kinds = [{"long": pa.int64(), "binary": pa.binary()}.get(x.split(" ")[1], pa.string()) for x in RECORDS.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for file in (f for batch in batches for f in batch.column("file").to_pylist()):
            rows, held = [], 0
            with store.open_input_stream(f"{folder}/{file}", compression=None) as source:
                for fields, block in (x for content in members(source) for x in parse(content)):
                    rows.append(_row(fields, block, keep_payload))
                    held += len(block) * keep_payload + 500
                    if held > 1 << 20:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return archives.select("file").repartition("file").mapInArrow(read, RECORDS)


def _row(fields: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    """A row of RECORDS."""
    kind, payload, page, request, meta = fields["WARC-Type"], None, None, None, None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
    elif kind == "request":
        request = block.decode()
    elif kind == "metadata":
        meta = block.decode()
        value = dict(x.split(": ", 1) for x in meta.split("\r\n") if x)["pageId"]
        page = None if value == "None" else int(value)
    digest = base32_sha1(payload) if payload is not None else None
    stated = fields.get("WARC-Payload-Digest", "")[5:] or None
    if digest and digest != stated:
        raise ValueError(f"{fields['WARC-Record-ID']}: payload {digest}, stated {stated}")
    uri = fields.get("WARC-Target-URI")
    size = None if payload is None else len(payload)
    return (
        fields["WARC-Record-ID"], kind, fields.get("WARC-Concurrent-To"), fields.get("WARC-Refers-To"), None if uri is None else _unline(uri),
        stated, page, size, digest, payload if keep_payload else None, request, meta,
    )


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, uri, record_type, payload_bytes, payload_digest, refers_to, request, response,
    metadata.

    Record ids name a row. Request and metadata records join the response or revisit record that they name as concurrent; a
    revisit takes size and digest from the response to which it refers, and has nulls there if that is not among the records.
    A capture without a request or metadata record has nulls there. No records give no rows.
    """
    main = records.where("type IN ('response', 'revisit')").groupBy("record_id").agg(
        *[F.first(c).alias(c) for c in ("type", "refers_to", "uri", "stated_digest", "payload_bytes", "payload_digest", "payload")]
    )
    beside = records.where("type IN ('request', 'metadata') AND concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.max(F.when(F.col("type") == "request", F.struct(F.col("record_id").alias("id"), "request"))).alias("request"),
        F.max(F.when(F.col("type") == "metadata", F.struct(F.col("record_id").alias("id"), F.col("fields").alias("fields"), "page_id"))).alias("metadata"),
    )
    whole = main.join(beside, "record_id", "left").select("*", F.col("metadata.page_id").alias("page_id"))
    response = F.struct(F.col("record_id").alias("id"), F.col("stated_digest").alias("digest"), "payload").alias("response")
    columns = ["page_id", "uri", F.col("type").alias("record_type")], ["request", response, "metadata"]
    own = whole.where("type = 'response' OR refers_to IS NULL").select(*columns[0], "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"), *columns[1])
    revisits = whole.where("type = 'revisit' AND refers_to IS NOT NULL").drop("payload_bytes", "payload_digest")
    asked = revisits.select("refers_to").distinct()
    seen = whole.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page"), "payload_bytes", "payload_digest")
    again = salted_join(revisits, asked.join(seen, "refers_to", "left"), "refers_to", F.col("record_id"))
    return own.unionByName(again.select(*columns[0], "payload_bytes", "payload_digest", F.col("first_page").alias("refers_to"), *columns[1]))


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = stored(read_records(archives, path), "records")
    return assemble(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_page FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM f
"""
