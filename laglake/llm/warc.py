"""WARC archives: a writer with revisit records, and a sequential reader.

Writer: rows with equal payloads (SHA-1) of at least ``least`` bytes keep one full ``response``, the one with the
largest id; the others become ``revisit`` records that refer to it and hold only the HTTP headers. Each
record is a gzip member of its own; a task starts a new archive at ``archive_bytes``.
Reader: a stream of blocks goes through incremental zlib decompression, a member at a time; the record is
framed by its Content-Length, what follows must be the closing blank lines and the member's end, and block
and payload digests are computed again and compared.

Defined results: a null payload is empty; null ids are written as ``null`` and read back as null; among equal
payloads null ids come after all others, and rows that share the largest id are all responses. Null or odd URLs
are left out or percent-encoded. An empty table writes no archive and reads back no rows. A damaged archive raises ValueError.

Scale: the largest id per payload aggregates map-side. Its join back is by (digest, salt), so that a payload
held by a third of all rows spreads over ``salts`` tasks. Archives go to the shared folder through pyarrow's file
systems under names that no other attempt uses; only the archives that finished tasks report are
listed in the written manifest, so lost executors and repeated attempts do no harm. Memory: one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laglake.session import materialize, scratch_path

from .common import table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
MANIFEST = "uri string, records long, bytes long"
RECORD = ("page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, "
          "verified boolean, payload binary")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, not yet compressed."""
    name = "null" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{name}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def marked(pages: DataFrame, least: int = 0, salts: int = 64, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, revisit, refers_to."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    same = (rows.where(F.octet_length("html") >= least).groupBy("digest")
            .agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1 AND last IS NOT NULL"))
    same = same.select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    out = rows.join(same, ["digest", "salt"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_warc(rows: DataFrame, folder: str, archive_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of ``marked`` as archives under ``folder`` (a URI or path that all executors see);
    returns the written manifest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = place(folder)
        where.create_dir(path, recursive=True)
        out, uri, n, size, listed = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                listed.append((uri, n, size))
                out = None

        for b in batches:
            for i in range(b.num_rows):
                page, url, html, revisit, refers = (b.column(c)[i].as_py() for c in range(5))
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(page, url, html.encode("utf-8", "surrogatepass"), refers, revisit, date)) + packer.flush()
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    uri, n, size = f"{folder}/{name}", 0, 0
                    out = where.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in listed], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["uri", "records", "bytes"])

    return materialize(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def records(stream, block: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of one gzip member after another."""
    pending, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        data = pending or stream.read(block)
        pending = b""
        if not data:
            break
        try:
            parts.append(unpack.decompress(data))
        except zlib.error as e:
            raise ValueError(f"damaged gzip member: {e}") from e
        if unpack.eof:
            pending = unpack.unused_data
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a gzip member")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(member: bytes) -> dict:
    """Frames a record by its content length, checks its digests and returns the columns of ``RECORD``."""
    at = member.find(b"\r\n\r\n")
    if at < 0 or not member.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    head = fields(member[:at])
    start, n = at + 4, int(head["content-length"])
    block = member[start:start + n]
    if len(block) != n or member[start + n:] != b"\r\n\r\n":
        raise ValueError("the record's length differs from its Content-Length")
    cut = block.index(b"\r\n\r\n") + 4
    payload, said = block[cut:], head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    known = lambda name: None if (v := head[name][1 + len(ID):-1]) == "null" else int(v)
    length = int(fields(block[:cut - 4])["content-length"])
    good = head["warc-block-digest"].removeprefix("sha1:") == digest(block) and (
        not payload if revisit else len(payload) == length and digest(payload) == said)
    return {"page_id": known("warc-record-id"), "record_type": head["warc-type"], "url": head.get("warc-target-uri"),
            "refers_to": known("warc-refers-to") if revisit else None, "payload_bytes": length, "payload_digest": said,
            "verified": good, "payload": None if revisit else payload}


def read_warc(manifest: DataFrame, with_payload: bool = True, batch_rows: int = 256) -> DataFrame:
    """The records of all archives of a manifest, an archive per task as far as there are tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                where, path = place(uri)
                rows = []
                with where.open_input_stream(path, compression=None) as stream:
                    for member in records(stream):
                        row = parse(member)
                        rows.append(row if with_payload else row | {"payload": None})
                        if len(rows) >= batch_rows:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    archives = max(1, manifest.count())
    return manifest.select("uri").repartition(archives).mapInArrow(run, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are written to archives in the shared folder and read back."""
    folder = scratch_path(spark, "warc")
    manifest = write_warc(marked(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    return read_warc(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


#: DuckDB has no base32; the digest's 40 hex digits are turned, five at a time (20 bits), into four letters.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM p),
e AS (SELECT *, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, i * 5 + 1, 5))::BIGINT >> s) & 31)::BIGINT + 1, 1)), 'string_agg', '')),
        'string_agg', '') AS payload_digest,
      max(page_id) OVER (PARTITION BY hex) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to, true AS verified FROM e
"""
