"""Token ids in files of bit planes.

Documents are dealt out by ranges of their ids, and each task writes its documents, in ascending order, to files of at
most about ``FILE_IDS`` ids. The ids of a file are one sequence of unsigned 32-bit integers in blocks of ``BLOCK``. A
block is transposed: plane ``k`` holds bit ``k`` of every id. Each plane is compressed with zstandard by itself; high bits
that no id has cost nothing, and low ones are met by the compressor without the others between them. A file ends with an
index: for each chunk (block) its ids and the bytes of its planes, and for each document its id and token count.

File: ``PLANES01``, the planes of each block in order, the index (zstandard, JSON), its length (8 bytes, little-endian),
``PLANES01``. Any block, and so any document, can be read by itself: see ``read_ids``.

A file is written under a name of its own and then moved to its place, so that a repeated or speculative task leaves whole
files only. Names ascend with the documents: partition and number. The manifest is a table of one row per file.

Defined results: a null or empty text is the end token alone; repeated ids follow each other, in the order of their texts;
rows without an id come first; extra columns are ignored; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlens.llm.tables import hold
from arborlens.llm.tokens import blocks, encoder

BLOCK = 1 << 16
FILE_IDS = 1 << 25
REMEMBERED = 1 << 19  # parts of a generation of the encoder, as a task here holds little else: about 100 MB
MAGIC = b"PLANES01"


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The 32 bit planes of a block, each compressed; a plane without ones is empty."""
    used = int(np.bitwise_or.reduce(ids, initial=0))
    press = zstandard.ZstdCompressor(level=3)
    return [press.compress(np.packbits((ids & np.uint32(1 << k)).astype(bool))) if used >> k & 1 else b"" for k in range(32)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    ids, press = np.zeros(count, np.uint32), zstandard.ZstdDecompressor()
    for k, plane in enumerate(planes):
        if plane:
            ids |= np.unpackbits(np.frombuffer(press.decompress(plane), np.uint8), count=count).astype(np.uint32) << np.uint32(k)
    return ids


class _Writer:
    """One file; blocks go out as they fill."""

    def __init__(self, folder: str, name: str):
        self.system, root = fs.FileSystem.from_uri(folder)
        self.name = name
        self.place, self.draft = posixpath.join(root, name), posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
        self.out = self.system.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.chunks: list[list] = []
        self.docs: list[tuple[int | None, int]] = []
        self.waiting: list[np.ndarray] = []
        self.waits = self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.waits += len(ids)
        self.ids += len(ids)
        if self.waits >= BLOCK:
            rows = np.concatenate(self.waiting)
            whole = len(rows) // BLOCK * BLOCK
            for start in range(0, whole, BLOCK):
                self._block(rows[start:start + BLOCK])
            self.waiting, self.waits = [rows[whole:]], len(rows) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = to_planes(ids)
        self.chunks.append([len(ids), [len(p) for p in planes]])
        self.out.write(b"".join(planes))

    def close(self) -> tuple[str, int, int]:
        if self.waits:
            self._block(np.concatenate(self.waiting))
        index = zstandard.ZstdCompressor().compress(json.dumps({"chunks": self.chunks, "docs": self.docs}).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.system.move(self.draft, self.place)
        return self.name, len(self.docs), self.ids


def absolute(folder: str) -> str:
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return folder if "://" in folder else "file://" + posixpath.abspath(folder)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files to an existing or new folder and return the manifest ``file, n_docs, n_ids`` as a table."""
    folder = absolute(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, written = encoder(tokenizer, remembered=REMEMBERED), None, []
        partition = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in blocks(texts):
                for doc_id, ids in zip(doc_ids[low:high], encode(texts[low:high])):
                    if writer is not None and writer.ids >= file_ids:
                        written.append(writer.close())
                        writer = None
                    if writer is None:
                        writer = _Writer(folder, f"ids-{partition:08d}-{len(written):08d}.planes")
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            written.append(writer.close())
        if written:
            names, counts, ids = zip(*written)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(counts, pa.int64()), pa.array(ids, pa.int64())], names=["file", "n_docs", "n_ids"])

    # Rows of one id are in the order of their hashes; the row's number spreads rows that are alike.
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    return hold(dealt.select("doc_id", "text").mapInArrow(write, "file string, n_docs bigint, n_ids bigint"), "manifest")


def _index(file) -> dict:
    size = file.size()
    file.seek(size - 16)
    length = int.from_bytes(file.read(8), "little")
    if file.read(8) != MAGIC:
        raise ValueError("not a file of bit planes")
    file.seek(size - 16 - length)
    return json.loads(zstandard.ZstdDecompressor().decompress(file.read(length)))


def _blocks(file, index: dict) -> Iterator[np.ndarray]:
    file.seek(len(MAGIC))
    for count, sizes in index["chunks"]:
        yield from_planes([file.read(n) for n in sizes], count)


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``file, place, doc_id, n_tokens, ids`` of every document of the files; ``ids`` little-endian, ``place`` within the file.

    A task reads a file block by block and holds one document at a time.
    """
    folder = absolute(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        names = ["file", "place", "doc_id", "n_tokens", "ids"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            with system.open_input_file(posixpath.join(root, name)) as file:
                index = _index(file)
                stream, rest, rows, size, place = _blocks(file, index), np.empty(0, np.uint32), [], 0, 0
                for doc_id, length in index["docs"]:
                    parts, have = [rest], len(rest)
                    while have < length:
                        parts.append(next(stream))
                        have += len(parts[-1])
                    rest = np.concatenate(parts) if len(parts) > 1 else rest
                    rows.append((name, place, doc_id, length, rest[:length].astype("<u4").tobytes()))
                    rest, place, size = rest[length:], place + length, size + length
                    if size > 1 << 18:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(
        read, "file string, place bigint, doc_id bigint, n_tokens bigint, ids binary")


def starts(manifest: DataFrame) -> DataFrame:
    """Ids in all files before each file; one row per file, so the window over all of them is small."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
