"""Monolithic gzip WARC files, rewritten with one gzip member a record and a sidecar offset index.

A monolithic file is one deflate stream: nothing in it can be read without inflating all that comes
before. ``normalise`` inflates such a file once, as a stream, writes every record as a member of its
own and, beside the new file, an index of members, one JSON object a line. ``read_records`` then
reads any records by offset.

What isn't a record (no ``WARC/`` line, no blank line within HEAD bytes, no plain Content-Length, or one
that doesn't end at the record's end) gives one index row of status ``malformed`` without offset, and
reading goes on at the next line that begins with ``WARC/1.``; a stream that ends within a record or
its gzip trailer gives a row of status ``truncated``. All other records are kept. Files of many members
are accepted too. A file without records gives an empty file and index. URIs are kept as they stand;
where a header line can't hold one (line breaks, blanks at an end) the exact one is in ``X-Original-URI``. A
page id that is no number is null. A null payload is a record of length 0 marked null and comes back
null, as do null keys and URLs. Repeated rows give repeated records. Payloads may be of any length.
"""

from __future__ import annotations

import hashlib
import json
import math
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column, file_system, scratch_path, written

LEVEL = 6
READ = 1 << 20
#: Bytes of a record's header lines, at most.
HEAD = 1 << 20
#: Bytes of members that a task reads back, about.
TASK_BYTES = 16 << 20
INDEX = "file string, record_id string, page_id bigint, uri string, offset bigint, length bigint, payload_bytes bigint, digest string, status string"


def record(page_id: int | None, uri: str | None, payload: bytes | None) -> bytes:
    """One WARC/1.0 record; the id follows from what the record holds, so a task run again writes the same bytes."""
    body = payload or b""
    digest = hashlib.sha1(body).hexdigest()
    shown = uri if uri is None or (uri == uri.strip() and uri.isprintable()) else quote(uri, safe="/:?#[]@!$&'()*+,;=%~")
    head = {
        "WARC-Type": "resource",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri} {digest}')}>",
        "WARC-Target-URI": shown,
        "X-Original-URI": None if shown == uri else quote(uri, safe=""),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "text/html",
        "X-Page-Id": page_id,
        "X-Null-Payload": "1" if payload is None else None,
        "Content-Length": len(body),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _uri(headers: dict[str, str]) -> str | None:
    exact = headers.get("x-original-uri")
    return headers.get("warc-target-uri") if exact is None else unquote(exact)


def _number(text: str | None, most: int = (1 << 63) - 1) -> int | None:
    """A whole number in ASCII digits, or None."""
    n = int(text) if text is not None and re.fullmatch("-?[0-9]{1,19}", text, re.ASCII) else None
    return n if n is not None and abs(n) <= most else None


def inflated(stream) -> Iterator[bytes]:
    """What a gzip stream of one or more members holds; EOFError if it ends early."""
    z, fresh = zlib.decompressobj(31), True
    while data := stream.read(READ):
        while data:
            fresh = False
            out = z.decompress(data, READ)
            if out:
                yield out
            if z.eof:
                data, z, fresh = z.unused_data, zlib.decompressobj(31), True
            else:
                data = z.unconsumed_tail
    if not fresh:
        raise EOFError("the gzip stream is truncated")


def parsed(parts: Iterator[bytes]) -> Iterator[tuple[bytes | None, dict[str, str], int, str]]:
    """Each record's bytes, headers, payload length and status, of a stream of records; rows without bytes for what is none."""
    buffer, broken, open_ = bytearray(), None, True

    def more() -> bool:
        nonlocal broken, open_
        try:
            buffer.extend(next(parts))
        except StopIteration:
            open_ = False
        except (EOFError, zlib.error) as e:
            open_, broken = False, "truncated" if isinstance(e, EOFError) else "malformed"
        return open_

    def blank_line() -> int:
        """Where the header ends, or -1."""
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen, HEAD)) < 0 and len(buffer) < HEAD and open_:
            seen = max(len(buffer) - 3, 0)
            more()
        return end

    def next_record() -> bool:
        """Drops all before the next line that begins a record; False if the stream has none."""
        while (at := buffer.find(b"\nWARC/1.")) < 0:
            if not open_:
                return False
            del buffer[: max(len(buffer) - 7, 0)]
            more()
        del buffer[: at + 1]
        return True

    while buffer or (open_ and more()):
        end = blank_line()
        headers = _headers(bytes(buffer[:end])) if end >= 0 and buffer.startswith(b"WARC/") else {}
        payload = _number(headers.get("content-length"))
        if payload is not None and payload >= 0:
            total = end + 4 + payload + 4
            while len(buffer) < total and open_:
                more()
            if buffer[total - 4 : total] == b"\r\n\r\n":
                yield bytes(buffer[:total]), headers, payload, "ok"
                del buffer[:total]
                continue
        cut = buffer.startswith(b"WARC/") and (payload >= 0 if payload is not None else end < 0 and len(buffer) < HEAD)
        if not next_record():
            yield None, {}, 0, broken or ("truncated" if cut else "malformed")
            return
        yield None, {}, 0, "malformed"
    if broken:
        yield None, {}, 0, broken


def write_monolithic(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", level: int = LEVEL) -> DataFrame:
    """Each partition of ``pages`` as one WARC file of a single gzip stream; the files' paths as a written table."""
    rows = column(column(column(pages, key, "bigint"), uri, "string"), payload, "string").select(F.col(f"`{key}`").alias("k"), F.col(f"`{uri}`").alias("u"), F.col(f"`{payload}`").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        attempt = f"{at}/.{name}.{uuid.uuid4().hex}"
        z, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        with fs.open_output_stream(attempt, compression=None) as f:
            for batch in batches:
                for k, u, p in zip(batch["k"], batch["u"], batch["p"], strict=True):
                    p = p.as_py()
                    f.write(z.compress(record(k.as_py(), u.as_py(), None if p is None else p.encode())))
                    n += 1
            f.write(z.flush())
        fs.move(attempt, f"{at}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

    return written(rows.mapInArrow(run, "file string, n_records bigint"), "warc-files")


def normalise(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites each file that ``files`` names in column ``file`` and returns the index as a written table, a row for each record."""
    n = max(1, files.count())
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)  # without any files its index is empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["file"].to_pylist():
                yield from one(path)

    def one(path: str) -> Iterator[pa.RecordBatch]:
        source, inner = file_system(path)
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        name = f"{hashlib.sha1(path.encode()).hexdigest()[:12]}-{posixpath.basename(inner)}"
        attempt, offset, rows = uuid.uuid4().hex, 0, []
        to = f"{folder}/{name}"
        with source.open_input_stream(inner, compression=None) as f, fs.open_output_stream(f"{at}/.{attempt}.gz", compression=None) as out, fs.open_output_stream(f"{at}/.{attempt}.idx", compression=None) as idx:
            for data, head, payload, status in parsed(inflated(f)):
                row = {"file": to, "record_id": head.get("warc-record-id"), "page_id": _number(head.get("x-page-id")), "uri": _uri(head), "offset": None, "length": None, "payload_bytes": None, "digest": head.get("warc-payload-digest"), "status": status}
                if data is not None:
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(data) + z.flush()
                    out.write(member)
                    row |= {"offset": offset, "length": len(member), "payload_bytes": payload}
                    offset += len(member)
                idx.write(json.dumps(row).encode() + b"\n")
                rows.append(row)
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows = []
        fs.move(f"{at}/.{attempt}.gz", f"{at}/{name}")
        fs.move(f"{at}/.{attempt}.idx", f"{at}/{name}.idx")
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return written(files.select("file").repartitionByRange(n, "file").mapInArrow(run, INDEX), "warc-index")


SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "bigint": pa.int64()}[x.split()[1]]) for x in INDEX.split(", ")])


def read_index(spark, folder: str) -> DataFrame:
    """The sidecar indexes of a folder of rewritten files."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)


def read_records(index: DataFrame) -> DataFrame:
    """The records of the rows of an index, each read by itself at its offset; rows without offset have none. Tasks are as many as their bytes need, whatever the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            got = {"page_id": [], "url": [], "html": [], "html_bytes": []}
            for path, offset, length in zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
                if path != name:
                    fs, inner = file_system(path)
                    name, f = path, fs.open_input_file(inner)
                data = zlib.decompress(f.read_at(length, offset), 31)
                end = data.index(b"\r\n\r\n")
                head = _headers(data[:end])
                body = None if "x-null-payload" in head else data[end + 4 : end + 4 + int(head["content-length"])].decode("utf-8", "replace")
                for k, v in (("page_id", _number(head.get("x-page-id"))), ("url", _uri(head)), ("html", body), ("html_bytes", int(head["content-length"]))):
                    got[k].append(v)
            yield pa.RecordBatch.from_pydict(got, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("html_bytes", pa.int64())]))

    found = index.filter("offset IS NOT NULL").select("file", "offset", "length")
    tasks = math.ceil((found.agg(F.sum("length")).first()[0] or 1) / TASK_BYTES)
    return found.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, "page_id bigint, url string, html string, html_bytes bigint")


def normalised_pages(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as monolithic WARC files, rewrites them, and reads every record back through the sidecar index."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    normalise(write_monolithic(pages, f"{folder}/monolithic"), f"{folder}/members")
    return read_records(read_index(spark, f"{folder}/members"))


SQL = "SELECT page_id, url, html, CAST(strlen(html) AS BIGINT) AS html_bytes FROM pages"
