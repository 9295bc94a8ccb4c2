"""Packing token ids into windows by best fit, longest first.

A document is encoded once, where its text lies. Overlong documents are cut into full windows first; each of these is a
sequence of its own. What remains of each document (less than a window) is packed by best-fit decreasing: in descending
length, each piece goes to the open window with the least room that still takes it. A segment tree over the room left
(0 to the window) finds that window in ``log(window)`` steps.

Only the short pieces are shuffled, dealt evenly into groups of about ``GROUP`` documents, each packed by itself, so no
task sees more than its group, however many documents share a source. The loss against one packing of all is at most the
few windows of each group that stay partly open.

Defined results: a null or empty text is the end token alone; repeated rows are packed like any others; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.tables import hold
from arborlens.llm.tokens import blocks, encoder

WINDOW = 1024
GROUP = 8192


class Rooms:
    """Open windows by the room left, in a segment tree of counts."""

    def __init__(self, window: int):
        self.base = 1
        while self.base <= window:
            self.base *= 2
        self.count = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, step: int) -> None:
        node = self.base + room
        while node:
            self.count[node] += step
            node //= 2

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return ``(room, window)`` with the least room of at least ``size``."""
        node = self.base + size
        if not self.count[node]:
            while node > 1 and (node % 2 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.base
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; the pieces must come in descending length."""
    rooms, opened = Rooms(window), 0
    places, offsets = [], []
    for length in lengths:
        found = rooms.take(length)
        if found is None:
            found = (window, opened)
            opened += 1
        room, place = found
        places.append(place)
        offsets.append(window - room)
        if room > length:
            rooms.put(room - length, place)
    return places, offsets


_PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, remembered: int | None = None) -> DataFrame:
    """Full windows and the rest of every document; ``ids`` are little-endian unsigned 32-bit integers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, remembered=remembered)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in blocks(texts):
                rows = []
                for doc_id, ids in zip(doc_ids[low:high], encode(texts[low:high])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start:start + window]
                        rows.append((doc_id, start, len(piece), len(ids), piece.tobytes()))
                names = ["doc_id", "start", "length", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in zip(names, zip(*rows))], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, _PIECE)


def _packer(window: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        places, offsets = best_fit(table["length"].to_pylist(), window)
        first = key[0].as_py() << 32
        return table.drop_columns("group").append_column(
            "sequence_id", pa.array([2 * (first + p) for p in places], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, group: int = GROUP,
         remembered: int | None = None) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids, sequence_id, offset``: every piece and its place.

    ``remembered`` is the encoder's; about 300 MB a worker at 1 << 20, where tasks have that to spare.
    """
    if window < 1 or group < 1:
        raise ValueError("window and group must be positive")
    groups = max(1, -(-docs.count() // group))
    cut = hold(pieces(docs, tokenizer, end_id, window, remembered), "pieces", compression="zstd")
    full = cut.filter(F.col("length") == window).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn(
        "offset", F.lit(0).cast("bigint"))
    # The row's number spreads rows that are alike.
    short = cut.filter(F.col("length") < window).withColumn("row", F.monotonically_increasing_id())
    short = short.withColumn("group", F.pmod(F.xxhash64("doc_id", "ids", "row"), F.lit(groups))).drop("row")
    return full.unionByName(
        short.groupBy("group").applyInArrow(_packer(window), _PIECE + ", sequence_id bigint, offset bigint"))
