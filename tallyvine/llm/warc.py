"""WARC archives: one gzip member per record, a sequential reader, revisit records for repeated payloads."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvine.llm.common import staged
from tallyvine.session import shared_folder

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task starts a new archive beyond so many bytes.
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 20
RECORD = (
    "archive string, offset long, page_id long, record_type string, url string, refers_to long,"
    " payload_bytes long, payload_digest string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id) -> str:
    return "<urn:page:" + ("none" if page_id is None else str(page_id)) + ">"


def _page(uri: str | None) -> int | None:
    return None if uri in (None, "<urn:page:none>") else int(uri[len("<urn:page:") : -1])


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP header block only; its length field keeps the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, digest, first``: of equal payloads of at least ``least_bytes``, ``first`` is the largest page_id.

    The largest id per digest is a partial aggregate; only digests of several rows are
    joined back, so that a digest with very many pages is a skewed join, not a group.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    again = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    again = again.where("n > 1 and first is not null").select("digest", "first")
    return rows.join(again, "digest", "left").select("page_id", "url", "html", "digest", "first")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html, digest, first)``; returns ``(archive, records, bytes)``, one row per archive.

    Archives get a name of their own for every attempt of a task, and only the ones that
    a finished task names are read; a lost executor's files are never seen.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, digest, first in zip(batch.page_id, batch.url, batch.html, batch.digest, batch["first"], strict=True):
                page_id, first = (None if pd.isna(x) else int(x) for x in (page_id, first))
                payload = (html or "").encode("utf-8", "surrogatepass")
                revisit = first is not None and page_id != first
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                member = _gzip_member(record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), first, revisit))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    return staged(pages.mapInPandas(write, "archive string, records long, bytes long"), "warc-manifest")


def members(stream, size: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """``(offset, content)`` of every gzip member, inflated as it is read; memory holds one record."""
    offset, held, at_end = 0, b"", False
    while True:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not held:
                held = stream.read(size)
                if not held:
                    at_end = True
                    break
            parts.append(unpacker.decompress(held))
            used += len(held) - len(unpacker.unused_data)
            held = unpacker.unused_data
        if at_end:
            if used:
                raise ValueError(f"archive ends inside the record at {offset}")
            return
        yield offset, b"".join(parts)
        offset += used


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(content: bytes) -> tuple:
    """``(page_id, record_type, url, refers_to, payload_bytes, payload_digest, payload)``; raises on wrong framing or digest."""
    end = content.index(b"\r\n\r\n")
    head = _fields(content[:end])
    length = int(head["content-length"])
    block = content[end + 4 : end + 4 + length]
    if len(block) != length or content[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError(f"record {head['warc-record-id']}: wrong length")
    if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"record {head['warc-record-id']}: wrong block digest")
    cut = block.index(b"\r\n\r\n")
    size, payload = int(_fields(block[:cut])["content-length"]), block[cut + 4 :]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {head['warc-record-id']}: wrong payload digest")
    revisit = head["warc-type"] == "revisit"
    return (_page(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"], _page(head.get("warc-refers-to")) if revisit else None, size, digest, None if revisit else payload)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives that ``manifest(archive)`` names, read in sequence, one archive a task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        for batch in batches:
            for name in batch.archive:
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}") as stream:
                    for offset, content in members(stream):
                        rows.append((name, offset, *parse(content)))
                        if not payloads:
                            rows[-1] = (*rows[-1][:-1], None)
                        held += len(content) if payloads else 500
                        if held > 8 << 20:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    # An explicit count: rows of some bytes each, which adaptive execution would merge into one task.
    archives = max(1, manifest.count())
    return manifest.select("archive").repartitionByRange(archives, "archive").mapInPandas(read, RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` under the shared folder and read the records back.

    Null html is an empty payload, null url an empty target. Rows that share the largest
    page_id of a payload are all responses. Null page ids are never referred to: they
    revisit a row with an id, and are responses where none has one. An empty table gives
    no archive and no record. Other columns are not looked at.
    """
    folder = f"{shared_folder(spark)}/llm-warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + os.path.abspath(folder)
    folder = folder.replace("file:///", "file:/").replace("file:/", "file:///")
    return read_archives(write_archives(marked(pages, least_bytes), folder), folder, payloads=False)


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SQL = f"""
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM rows),
bits AS (
  SELECT hex, string_agg(substr('{_B32}', 1 + ((('0x' || substr(hex, 1 + 10 * g, 10))::BIGINT >> (35 - 5 * k)) & 31)::INT, 1), '' ORDER BY g, k) AS payload_digest
  FROM (SELECT DISTINCT hex FROM hashed), range(4) a(g), range(8) b(k) GROUP BY hex),
firsts AS (SELECT hex, max(page_id) AS first FROM hashed GROUP BY hex HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM hashed JOIN bits USING (hex) LEFT JOIN firsts USING (hex)
"""
