"""WARC derivatives: for each response record a linked metadata record and a plain-text conversion record.

Both refer to the response by ``WARC-Refers-To`` and carry its target, date and payload digest (as
``WARC-Refers-To-Payload-Digest``, if it has one). The metadata record (``application/warc-fields``) preserves the source's HTTP
status and headers, and all headers of its record as ``source-<name>``, in their order, repeated ones each; the conversion record
(``text/plain``) holds the visible text of an HTML payload, laid out by ``html_text``, or a text payload. Digests are SHA-1 in base 32, new for the new blocks; a
source digest that does not fit its block is reported as ``digest-fits: no`` in the metadata.

Records are read from and written to files with one gzip member per record, by tasks that hold one record at a time. A file is
written under a name of its own and then moved to its place, so that repeated tasks leave whole files only. Where records are
made from rows or files and written, or read and turned into columns, a task does both in one pass (``make``).

Defined results: a null page or url is an empty payload or target; records other than responses are passed over; a response
without a readable HTTP head has an empty status and counts as payload as a whole; other media give a metadata record only;
repeated pages give records with equal identifiers; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.llm.html_text import visible_text
from arborlens.llm.tables import hold

FILE_BYTES = 1 << 26
DATE = "1970-01-01T00:00:00Z"  # of records made from pages, which carry no date
Make = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs of RFC 4122


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # of base 32
_PAIRS = [a + b for a in _LETTERS for b in _LETTERS]


def digest(data: bytes) -> str:
    """SHA-1 in base 32, two letters for every ten bits."""
    number = int.from_bytes(hashlib.sha1(data).digest(), "big")
    return "sha1:" + "".join([_PAIRS[(number >> shift) & 1023] for shift in range(150, -1, -10)])


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value) if "\n" in value or "\r" in value else value


def response(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page as a response record."""
    url, payload = _one_line(url or ""), (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n"
    block, part = http.encode() + payload, digest(payload)
    name = uuid.uuid5(_NAMES, f"{page_id} {url} {part}")
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", part), ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response")], block)


def parse(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers in their order (names in lower case, continued lines joined, repeated ones each) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip().lower(), value.strip()))
    length = first(headers, "content-length") or ""
    return headers, rest[:int(length)] if length.isdigit() else rest.removesuffix(b"\r\n\r\n")


def first(headers: list[tuple[str, str]], name: str) -> str | None:
    """The first header of a name."""
    return next((v for k, v in headers if k == name), None)


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload; all is payload if there is no HTTP head."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not mark:
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = [(k.strip(), v.strip()) for k, m, v in (x.partition(":") for x in lines) if m]
    return status, pairs, payload


def derive(raw: bytes) -> list[bytes]:
    """The derivatives of a record; none if it is not a response."""
    source, block = parse(raw)
    if first(source, "warc-type") != "response":
        return []
    status, headers, payload = _http(block)
    name, whole, part = (first(source, x) for x in ("warc-record-id", "warc-block-digest", "warc-payload-digest"))
    linked = [("WARC-Refers-To", name or ""), ("WARC-Date", first(source, "warc-date") or DATE),
              ("WARC-Target-URI", first(source, "warc-target-uri") or "")]
    if part is not None:
        linked.append(("WARC-Refers-To-Payload-Digest", part))
    fits = whole in (None, digest(block)) and part in (None, digest(payload))
    fields = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in headers), *((f"source-{k}", v) for k, v in source),
              ("digest-fits", "yes" if fits else "no")]

    def made(kind: str, media: str, body: bytes) -> bytes:
        sum_of = digest(body)
        own = uuid.uuid5(_NAMES, f"{kind} {name or ''} {sum_of}")
        return record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{own}>"), *linked,
                       ("WARC-Block-Digest", sum_of), ("Content-Type", media)], body)

    out = [made("metadata", "application/warc-fields", "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode())]
    media = next((v for k, v in headers if k.lower() == "content-type"), "").lower()
    charset = re.search(r"charset=\"?([\w-]+)", media)
    if "html" in media or media.startswith("text/plain"):
        try:
            text = payload.decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            text = payload.decode("utf-8", "replace")
        out.append(made("conversion", "text/plain; charset=utf-8", (visible_text(text) if "html" in media else text).encode("utf-8", "replace")))
    return out


def _from_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array([response(*r) for r in rows], pa.large_binary())], names=["record"])


def _typed(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))


def responses(pages: DataFrame) -> DataFrame:
    """Pages ``(page_id, url, html)`` as response records, ``record`` each."""
    return _typed(pages).mapInArrow(_from_pages, "record binary")


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, size = [], 0
        for raw in batch.column("record"):
            made += derive(raw.as_py())
            size += len(made[-1]) if made else 0
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.large_binary())], names=["record"])
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.large_binary())], names=["record"])


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses in ``record``."""
    return records.select("record").mapInArrow(_derive, "record binary")


def write_files(rows: DataFrame, folder: str, prefix: str, file_bytes: int = FILE_BYTES, make: Make | None = None) -> DataFrame:
    """Write records to ``.warc.gz`` files; the manifest ``file, n_records`` as a table.

    The records are the column ``record``, or what ``make`` turns the batches of rows into.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        partition, written, out, size, count, draft = TaskContext.get().partitionId(), [], None, 0, 0, ""

        def finish() -> None:
            name = f"{prefix}-{partition:08d}-{len(written):08d}.warc.gz"
            out.close()
            system.move(draft, posixpath.join(root, name))
            written.append((name, count))

        for batch in make(batches) if make else batches:
            for raw in batch.column("record"):
                if out is None:
                    draft, size, count = posixpath.join(root, f".{uuid.uuid4().hex}"), 0, 0
                    out = system.open_output_stream(draft, compression=None)
                member = gzip.compress(raw.as_py(), 1, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        if written:
            names, counts = zip(*written)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], names=["file", "n_records"])

    return hold((rows if make else rows.select("record")).mapInArrow(write, "file string, n_records bigint"), "manifest")


def members(stream, size: int = 1 << 15) -> Iterator[bytes]:
    """The content of each gzip member of a stream."""
    pending = b""
    while True:
        pending = pending or stream.read(size)
        if not pending:
            return
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not pending:
                pending = stream.read(size)
                if not pending:
                    raise ValueError("a record ends early")
            parts.append(unzip.decompress(pending))
            pending = unzip.unused_data
        yield b"".join(parts)


def _reader(folder: str) -> Make:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    rows, size = [], 0
                    for raw in members(stream):
                        rows.append(raw)
                        size += len(raw)
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(rows, pa.large_binary())], names=["file", "record"])
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(rows, pa.large_binary())], names=["file", "record"])

    return read


def _by_file(manifest: DataFrame) -> DataFrame:
    """A task for each file."""
    return manifest.select("file").repartition(max(1, manifest.count()))


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``file, record`` of the files of a manifest."""
    return _by_file(manifest).mapInArrow(_reader(folder), "file string, record binary")


def write_responses(pages: DataFrame, folder: str, prefix: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages ``(page_id, url, html)`` as response records; the manifest."""
    return write_files(_typed(pages), folder, prefix, file_bytes, _from_pages)


def write_derivatives(manifest: DataFrame, folder: str, prefix: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the derivatives of the files of a manifest to the same folder; their manifest."""
    read = _reader(folder)
    return write_files(_by_file(manifest), folder, prefix, file_bytes, lambda batches: _derive(read(batches)))


_FIELDS = ("record_id", "type", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "block")


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ("warc-record-id", "warc-type", "warc-refers-to", "warc-target-uri", "warc-date", "content-type")
    for batch in batches:
        rows = []
        for raw in batch.column("record"):
            headers, block = parse(raw.as_py())
            named = dict(reversed(headers))  # of repeated headers the first counts
            rows.append((*map(named.get, keys), len(block), named.get("warc-block-digest"), block.decode("utf-8", "replace")))
        columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if n == "content_length" else pa.large_string() if n == "block" else pa.string())
             for n, c in zip(_FIELDS, columns)], names=list(_FIELDS))


_COLUMNS = ", ".join(f"{n} {'bigint' if n == 'content_length' else 'string'}" for n in _FIELDS)


def fields(records: DataFrame) -> DataFrame:
    """Headers and block of each record as columns."""
    return records.select("record").mapInArrow(_fields, _COLUMNS)


def file_fields(manifest: DataFrame, folder: str) -> DataFrame:
    """The same of the records in the files of a manifest."""
    read = _reader(folder)
    return _by_file(manifest).mapInArrow(lambda batches: _fields(read(batches)), _COLUMNS)
