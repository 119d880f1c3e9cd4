"""WARC archives, index first: what was written where is a table, and reads follow it in coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import materialize, shuffle_partitions

INDEX_SCHEMA = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
_FIELDS = ["file", "offset", "length", "page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to"]
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _filesystem(uri: str):
    """(filesystem, path). Local and shared folders by Python's own files, other stores by pyarrow."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        from pyarrow.fs import LocalFileSystem

        return LocalFileSystem(), unquote(u.path)
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """A target that fits in a header line: blanks and control characters are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in url or "") or "about:blank"


def info_bytes(place: str, date: str) -> bytes:
    """The record at the head of each file."""
    body = b"software: larkspan\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, place: str, date: str) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to`` given) holds the HTTP header only. ``place``, the file and offset, makes the record's own id."""
    http = _HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, the HTTP header's Content-Length) of one record, plain or gzip; a malformed one is an error."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    end = raw.find(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    if raw[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record ends where its length does not say")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return head, payload, size


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_bytes: int = 1 << 30, compress: bool = True, date: str | None = None) -> DataFrame:
    """Write one record per row under ``folder``, after a ``warcinfo`` record in each file, and return the index, a table in the shared folder.

    Payloads are the column in UTF-8, null as empty. Of rows with equal payloads of at least ``least_bytes`` bytes those
    with the smallest id are responses, the others revisits that refer to it; without any id in such a group all are
    responses. Null ids and URLs, repeated rows and odd characters in URLs are written; other columns are ignored.
    ``compress`` makes each record a gzip member of its own, so that a record can still be read alone; offsets and lengths are
    those of the members.

    A task's files bear a name of its own, and only files of tasks that ended well are in the index, so that
    repeated and lost tasks leave nothing that a reader sees.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    src = src.withColumn("sha", F.sha1(F.encode("payload", "UTF-8")))
    firsts = src.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    rows = src.join(firsts, "sha", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, base = _filesystem(folder)
        out, name, at, k = None, "", 0, 0
        try:
            for b in batches:
                index = []
                for page_id, url, payload, sha, first, first_url in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "first", "first_url"))):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at, k = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{k:04d}-{uuid.uuid4().hex[:8]}.warc{'.gz' if compress else ''}", 0, k + 1
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        info = info_bytes(name, date)
                        info = gzip.compress(info, 3, mtime=0) if compress else info
                        out.write(info)
                        at = len(info)
                    data, digest = payload.encode(), base64.b32encode(bytes.fromhex(sha)).decode()
                    refers = first if first is not None and first != page_id else None
                    raw = record_bytes(page_id, url, data, digest, refers, first_url, f"{name}#{at}", date)
                    raw = gzip.compress(raw, 3, mtime=0) if compress else raw
                    out.write(raw)
                    index.append((f"{folder}/{name}", at, len(raw), page_id, url, digest, len(data), "response" if refers is None else "revisit", refers))
                    at += len(raw)
                yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, x)) for x in index], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return materialize(rows.select("page_id", "url", "payload", "sha", "first", "first_url").mapInArrow(write, INDEX_SCHEMA), "warc-index")


_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_warc(index: DataFrame, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """The records that ``index`` (all of it, or rows selected from it) names, as
    ``(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload)``; a revisit has a null payload.

    Index rows are ordered by file and offset; records with at most ``gap`` bytes between them are read at once, up to
    ``most`` bytes. A payload whose SHA-1 is not the recorded one is an error. Values come from the archive, not from the index.
    """
    spark = index.sparkSession
    order = index.select("file", "offset", "length").repartitionByRange(shuffle_partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for b in batches:
            todo = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))
            i = 0
            while i < len(todo):
                file, start, length = todo[i]
                j, end = i + 1, start + length
                while j < len(todo) and todo[j][0] == file and todo[j][1] - end <= gap and todo[j][1] + todo[j][2] - start <= most:
                    end = max(end, todo[j][1] + todo[j][2])
                    j += 1
                if file != name:
                    if opened is not None:
                        opened.close()
                    fs, path = _filesystem(file)
                    opened, name = fs.open_input_file(path), file
                raw = opened.read_at(end - start, start)
                rows = []
                for _, o, n in todo[i:j]:
                    head, payload, size = parse_record(raw[o - start : o - start + n])
                    digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
                    if not revisit and sha1_base32(payload) != digest:
                        raise ValueError(f"payload digest differs at {file}:{o}")
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                    rows.append((page and int(page), head["WARC-Target-URI"], head["WARC-Type"], digest, size, refers and int(refers), None if revisit else payload))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _READ.types)], schema=_READ)
                i = j
        if opened is not None:
            opened.close()

    return order.mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
