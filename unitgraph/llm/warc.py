"""WARC archives: writing pages, rewriting whole-file gzip as one member per record, and reading back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitgraph.llm.common import join_counted
from unitgraph.plans.durable import durable, shared_dir

CHUNK = 1 << 20
#: Bytes of records after which a writer starts another archive.
ROLL = 256 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"


def _open(uri: str, mode: str) -> pa.NativeFile:
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    if mode == "w":
        where.create_dir(path.rpartition("/")[0], recursive=True)
        return where.open_output_stream(path, compression=None)
    return where.open_input_file(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit that names another page's response.

    A revisit keeps the HTTP head, and with it the payload's length, but not the payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or f"urn:page:{page_id}")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def read_head(stream: BinaryIO) -> tuple[bytes, dict[str, str]] | None:
    """The next record's head, as bytes and as fields; None at the end."""
    raw, line = b"", stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields: dict[str, str] = {}
    while line not in (b"\r\n", b"\n", b""):
        raw += line
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
        line = stream.readline()
    return raw + b"\r\n", fields


def number(urn: str | None) -> int | None:
    """The page's number in ``<urn:page:N>``."""
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def with_references(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` with ``_refers``: the page whose response has the same payload, null for responses.

    Payloads are compared by SHA-1 and length. A payload that many pages share has its winner broadcast,
    so its pages are not dealt to one task.
    """
    rows = pages.withColumn("_sha1", F.sha1("_body")).withColumn("_bytes", F.octet_length("_body").cast("long"))
    best = durable(rows.groupBy("_sha1", "_bytes").agg(F.max("_page").alias("_best"), F.count(F.lit(1)).alias("_pages")))
    refers = F.when((F.col("_bytes") >= min_bytes) & (F.col("_page") < F.col("_best")), F.col("_best"))
    return join_counted(rows, best, ["_sha1", "_bytes"], "_pages").select("_page", "_url", "_body", refers.alias("_refers"))


def write_archives(pages: DataFrame, directory: str) -> DataFrame:
    """Archives as crawlers often leave them: all records of a file in one gzip stream. Returns (path, records).

    Each attempt of a task writes files of its own; only those it reports count, so a task run twice
    after an executor is lost leaves no double records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, gz, n, size = "", None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

        for b in batches:
            for page, target, body, refers in zip(b.column("_page").to_pylist(), b.column("_url").to_pylist(), b.column("_body").to_pylist(), b.column("_refers").to_pylist(), strict=True):
                if out is None:
                    path = f"{directory}/raw/{uuid.uuid4().hex}.warc.gz"
                    out, gz, n, size = _open(path, "w"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                data = record(page, target, (body or "").encode(), refers)
                out.write(gz.compress(data))
                n, size = n + 1, size + len(data)
                if size > ROLL:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return durable(pages.mapInArrow(run, "path string, records long"))


def normalise_file(path: str, target: str) -> list[tuple[int, int, str, str]]:
    """Inflate ``path`` once, front to back, and write every record to ``target`` as a gzip member.

    Also writes the sidecar index ``target``.idx, a JSON line for each record. Returns its rows: offset,
    length, record type, record id. Bodies are copied in chunks, so memory does not grow with a record.
    """
    rows, at = [], 0
    with _open(path, "r") as raw, gzip.GzipFile(fileobj=raw) as stream, _open(target, "w") as out:
        while (head := read_head(stream)) is not None:
            gz, start = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), at
            left, data = int(head[1]["content-length"]), head[0]
            while True:
                packed = gz.compress(data)
                out.write(packed)
                at += len(packed)
                if not left:
                    break
                data = stream.read(min(CHUNK, left))
                if not data:
                    raise ValueError(f"{path} ends within a record")
                left -= len(data)
            packed = gz.compress(b"\r\n\r\n") + gz.flush()
            out.write(packed)
            at += len(packed)
            rows.append((start, at - start, head[1]["warc-type"], head[1]["warc-record-id"]))
    with _open(f"{target}.idx", "w") as out:
        out.write("".join(json.dumps({"offset": o, "length": n, "type": t, "id": i}) + "\n" for o, n, t, i in rows).encode())
    return rows


def normalise(archives: DataFrame, directory: str) -> DataFrame:
    """The offset index of all rewritten archives: (path, offset, length, type, record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                target = f"{directory}/records/{uuid.uuid4().hex}.warc.gz"
                rows = normalise_file(path, target)
                if rows:
                    offset, length, kind, name = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([target] * len(rows)), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(kind), pa.array(name)], names=["path", "offset", "length", "type", "record"])

    # A file is one task's work; dealing them out evenly keeps all executors busy.
    n = max(1, archives.count())
    spread = archives.select("path").repartitionByRange(n, "path")
    return durable(spread.mapInArrow(run, "path string, offset long, length long, type string, record string"))


def read_record(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Page, payload length, payload digest, type and reference of one gzip member."""
    import io

    stream = io.BytesIO(gzip.decompress(data))
    _, fields = read_head(stream)
    body = stream.read(int(fields["content-length"]))
    head, _, payload = body.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if base32_sha1(payload) != digest:
            raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
        size = len(payload)
    else:
        size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))


def read_records(index: DataFrame) -> DataFrame:
    """Records by their offsets: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, file = None, None
        for b in batches:
            out = []
            for path, offset, length in zip(b.column("path").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True):
                if path != open_path:
                    if file is not None:
                        file.close()
                    open_path, file = path, _open(path, "r")
                file.seek(offset)
                out.append(read_record(file.read(length)))
            if out:
                page, size, digest, kind, refers = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(kind), pa.array(refers, pa.int64())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("path", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, directory: str | None = None, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write all pages as WARC, normalise the files, and return (index, records read back by offset).

    Files go to ``directory``, by default a new folder in the cluster's shared one. Of pages with equal
    payloads of ``min_bytes`` or more, the one with the largest id is a response and the others revisit
    it; the rest are responses. A null payload is empty; a null url names the page; rows with one id and
    one payload are alike, both responses if it is the largest; a null id comes back as null and is a
    response. Very long payloads are copied in chunks. An empty table writes nothing. Other columns of
    ``pages`` play no part, whatever their names.
    """
    directory = directory or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).cast("long").alias("_page"), F.col(url).alias("_url"), F.coalesce(F.col(payload), F.lit("")).alias("_body"))
    index = normalise(write_archives(with_references(rows, min_bytes), directory), directory)
    return index, read_records(index)
