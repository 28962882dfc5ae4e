"""WARC archives: writing with payload dedup, and a sequential reader.

Every record is a gzip member of its own. Of records with equal payloads (of at least ``min_bytes`` bytes)
the one with the smallest id is a ``response``; the others are ``revisit`` records that carry the HTTP head,
the payload digest and a reference, but no payload.

A writing task streams its rows into one file of the target folder, under a name of its own attempt, and
returns the name; the manifest of names that committed attempts returned is the archive list, so a task that
is run again or lost leaves at most a file that nobody reads. The folder must be reachable by all executors
and by Arrow's file systems (local or shared paths, hdfs, s3, gs).

The reader goes through a file once: it inflates member by member with bounded input, frames the header and
the block by Content-Length and checks the digest of each payload that it sees.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

LEVEL = 6
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record; ``refers_to`` makes it a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>")
        lines.append(f"X-Refers-To-Page: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n")


def member(raw: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(source) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    pending, inflate, parts = b"", None, []
    while True:
        if not pending:
            pending = source.read(READ_BYTES)
            if not pending:
                if inflate is not None:
                    raise ValueError("the archive ends inside a record")
                return
        if inflate is None:
            inflate, parts = zlib.decompressobj(31), []
        parts.append(inflate.decompress(pending))
        pending = inflate.unused_data
        if inflate.eof:
            inflate = None
            yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record; raises where framing or a digest is wrong."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(headers["Content-Length"])
    block, tail = raw[end + 4 : end + 4 + size], raw[end + 4 + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the block")
    if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    head, _, payload = block.partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
        raise ValueError("payload digest differs")
    return headers, head, payload


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) and returns the manifest (file, records, bytes), as a table.

    A null html is an empty payload, a null url an empty target. A page without an id is always a response
    and never referred to. Rows that repeat the id and payload of the response are responses too. An empty
    table gives an empty manifest.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("sha", F.sha1("html"))
    first = own.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"))
    own = own.join(first, "sha", "left").select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches):
        place, root = _place(folder)
        place.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        records = size = 0
        out = None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    out = place.open_output_stream(f"{root}/{name}", compression=None)
                packed = member(record(row[0], row[1], row[2].encode(), row[3]))
                out.write(packed)
                records, size = records + 1, size + len(packed)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})

    return cut_lineage(own.mapInArrow(run, "file string, records long, bytes long"))


def read(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, html]) of every record, in file order within a file.

    ``payload_bytes`` comes from the HTTP head, so revisits have it; their html is null. Fails on a record
    that is cut off, badly framed or whose digest differs, and on a file with fewer records than the manifest says.
    """

    def run(batches):
        place, root = _place(folder)
        for batch in batches:
            for name, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen, held = [], 0, 0
                with place.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for raw in members(source):
                        headers, head, payload = parse(raw)
                        length = int(next(v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:]) if k == "Content-Length"))
                        whole = headers["WARC-Type"] == "response"
                        rows.append(
                            {
                                "page_id": int(headers["X-Page-Id"]) if headers["X-Page-Id"] else None,
                                "url": headers["WARC-Target-URI"],
                                "payload_bytes": length,
                                "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                                "record_type": headers["WARC-Type"],
                                "refers_to": int(headers["X-Refers-To-Page"]) if not whole else None,
                            }
                            | ({"html": payload.decode() if whole else None} if with_payload else {})
                        )
                        seen, held = seen + 1, held + len(payload)
                        if len(rows) >= 4096 or (with_payload and held > 8 << 20):
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{name}: {seen} records, {expected} were written")
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    arrow = pa.schema(fields + [("html", pa.string())] * with_payload)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * with_payload
    spread = manifest.repartition(max(1, manifest.count()), "file")
    return spread.mapInArrow(run, schema)


def archive(pages: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes ``pages`` to a new folder beside the session's checkpoints and reads the archives back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes), folder, with_payload)
