"""The trie of conversations' turns, by ternary search trees over ranges of sorted conversations.

A turn is 20 bytes: 128 bits of the hash of its role and text, and the number of code points of the text. A conversation is
its turns' bytes in order, so that conversations sorted by these bytes have all members of a trie node side by side. They are
dealt out by ranges of (bytes, id): a group of equal conversations, however large, spans as many shards as it needs. Texts are
hashed where they lie; only the 20 bytes move.

A shard goes through its sorted conversations in runs of at most ``RUN`` turns. Each run numbers its distinct turns in order
(a dictionary) and inserts its distinct sequences into a ternary search tree, the median first, so that siblings make balanced
trees. Nodes lie in order of creation, parents before children; one walk backwards adds up members, leaves and savings. A node
may go on beyond its run only if it lies on the path that the run's first sequence shares with the conversation before, or the
last one with the conversation after; all others are finished. Open nodes (known by 128 bits of the hash of their path) are merged
within the shard as runs follow each other, and those on a shard's first and last path are merged between neighbouring shards,
``FAN`` at a time, until one group is left. The ids of conversations that end at an open node go on in packed pieces, in order, and
are hashed one after the other.

Defined results: null roles and texts are empty; rows without a conversation id are left out; turns of equal number are in the
order of their hashes; repeated rows are turns of their own; extra columns are ignored; an empty table has no node. A conversation
becomes one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.tables import hold

RUN = 50_000
SHARD = 400_000  # turns of a shard, about
FAN = 64
RECORD = 20
BLOCK = 100  # conversations that share a source
HEAD = 6  # the head has fewer turns than this

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
# kind 0: a finished node. 1: an open node. 2: ids that end at an open node, packed.
_PART = f"kind int, shard int, {_NODE}, path binary, parent binary, chars bigint, left boolean, right boolean, ends string, ids binary"
_COLUMNS = [x.split() for x in _PART.split(", ")]
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
_NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, seq``: every conversation, rebuilt on the head of its block's source."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, RECORD * 2 - 8)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.concat(hashed, F.lpad(F.hex(F.length(text)), 8, "0")).alias("record"))
    own = turns.groupBy("conv_id").agg(F.unhex(F.array_join(F.sort_array(F.collect_list(F.struct("turn", "record")))["record"], "")).alias("own"))
    own = hold(own, "conversations")
    source = F.col("conv_id") - F.col("conv_id") % BLOCK
    heads = own.filter(F.col("conv_id") == source).select(F.col("conv_id").alias("source"), F.substring("own", 1, RECORD * (HEAD - 1)).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int") * RECORD
    joined = own.withColumn("source", source).join(heads, "source", "left")
    first = F.substring(F.coalesce("head", F.lit(b"")), F.lit(1), taken)
    return joined.select("conv_id", F.concat(first, F.substring("own", taken + 1, F.octet_length("own"))).alias("seq"))


class Tree:
    """Ternary search tree over sequences of numbers. Node 0 is the root; a node's parent comes before it."""

    def __init__(self):
        self.turn, self.low, self.high, self.down, self.parent, self.depth = [-1], [0], [0], [0], [-1], [0]

    def _node(self, turn: int, parent: int) -> int:
        for column, value in ((self.turn, turn), (self.low, 0), (self.high, 0), (self.down, 0), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, sequence: list[int]) -> int:
        """The node where the sequence ends."""
        node = 0
        for turn in sequence:
            at, links, before = self.down[node], self.down, node
            while at and self.turn[at] != turn:
                links, before = (self.low, at) if turn < self.turn[at] else (self.high, at)
                at = links[at]
            if not at:
                at = links[before] = self._node(turn, node)
            node = at
        return node

    def fill(self, sorted_sequences: list[list[int]]) -> list[int]:
        """Insert all, the median of each range first; their end nodes, in the given order."""
        ends, ranges = [0] * len(sorted_sequences), [(0, len(sorted_sequences))]
        while ranges:
            low, high = ranges.pop()
            if low < high:
                middle = (low + high) // 2
                ends[middle] = self.insert(sorted_sequences[middle])
                ranges += [(middle + 1, high), (low, middle)]
        return ends


def _shared(a: bytes | None, b: bytes | None) -> int:
    """Turns that two conversations have in common from the first on."""
    if a is None or b is None:
        return 0
    n = min(len(a), len(b)) // RECORD
    x, y = (np.frombuffer(s, np.uint8, n * RECORD).reshape(n, RECORD) for s in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _paths(seq: bytes, depth: int) -> list[bytes]:
    """Names of the nodes along a sequence, from the root to ``depth``."""
    out = [b"root"]
    for i in range(depth):
        out.append(hashlib.blake2b(out[-1] + seq[i * RECORD:(i + 1) * RECORD], digest_size=16).digest())
    return out


def _hash_ids(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else _NOBODY


def _as_numbers(raw: np.ndarray) -> np.ndarray:
    """Records as rows of numbers in the order of their bytes."""
    return np.ascontiguousarray(raw).view(">u4").reshape(-1, RECORD // 4).astype(np.uint32)


def run_nodes(rows: list[tuple[int, bytes]], left: int, right: int) -> Iterator[dict]:
    """Nodes of one run of sorted ``(conv_id, seq)``. The first ``left`` turns of the first sequence, and the first ``right``
    ones of the last, lie on paths that may go on outside the run; the root always does."""
    groups = [(seq, [r[0] for r in same]) for seq, same in groupby(rows, key=lambda r: r[1])]
    raw = np.frombuffer(b"".join(seq for seq, _ in groups), np.uint8).reshape(-1, RECORD)
    _, first, number = np.unique(_as_numbers(raw), axis=0, return_index=True, return_inverse=True)
    chars_of = [int.from_bytes(raw[i, 16:].tobytes(), "big") for i in first]
    numbers, parts, start = number.reshape(-1).tolist(), [], 0
    for seq, _ in groups:
        parts.append(numbers[start:start + len(seq) // RECORD])
        start += len(seq) // RECORD
    tree = Tree()
    ends = tree.fill(parts)
    n = len(tree.turn)
    members, least, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    over: dict[int, list[int]] = {}
    for node, (_, ids) in zip(ends, groups):
        over[node] = ids
        members[node], least[node] = len(ids), ids[0]
    opened: dict[int, tuple[bytes, bytes | None, bool, bool]] = {}
    for seq, end, depth, is_left in ((groups[0][0], ends[0], left, True), (groups[-1][0], ends[-1], right, False)):
        names, node = _paths(seq, depth), end
        while node >= 0:
            d = tree.depth[node]
            if d <= depth:
                was = opened.get(node, (None, None, False, False))
                opened[node] = (names[d], names[d - 1] if d else None, was[2] or is_left, was[3] or not is_left)
            node = tree.parent[node]
    chars = [0] + [chars_of[t] for t in tree.turn[1:]]
    for node in range(n - 1, 0, -1):
        parent = tree.parent[node]
        members[parent] += members[node]
        least[parent] = least[node] if least[parent] is None else min(least[parent], least[node])
        if node not in opened:
            leaves[node] = leaves[node] or 1
            saved[node] += (members[node] - 1) * chars[node]
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    for node in range(n):
        row = {"conv_id": least[node], "depth": tree.depth[node], "n_convs": members[node], "n_children": children[node],
               "n_leaves": leaves[node], "saved_tokens": saved[node]}
        if node in opened:
            path, parent, to_left, to_right = opened[node]
            yield row | {"kind": 1, "path": path, "parent": parent, "chars": chars[node], "left": to_left, "right": to_right}
            if node in over:
                yield {"kind": 2, "path": path, "conv_id": over[node][0], "ids": np.array(over[node], "<i8").tobytes()}
        else:
            above = opened.get(tree.parent[node])
            yield row | {"kind": 0, "parent_conv_id": None if above else least[tree.parent[node]], "parent": above and above[0],
                         "ends": _hash_ids(over.get(node, []))}


class Open:
    """Open nodes of runs (or shards) that follow each other, merged by path."""

    def __init__(self):
        self.nodes: dict[bytes, dict] | None = None

    def add(self, rows: list[dict]) -> Iterator[dict]:
        """Merge the open nodes of the next run; those that can go on neither to the left of all runs nor to the right end here."""
        first = self.nodes is None
        self.nodes = self.nodes or {}
        for node in self.nodes.values():
            node["right"] = False  # unless the coming run has it too
        for row in rows:
            node = self.nodes.get(row["path"])
            if node is None:
                self.nodes[row["path"]] = dict(row, left=row["left"] and first)
                continue
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[name] += row[name]
            node["conv_id"], node["right"] = min(node["conv_id"], row["conv_id"]), row["right"]
        yield from self.finish([r for r in self.nodes.values() if not (r["left"] or r["right"])])

    def finish(self, done: list[dict]) -> Iterator[dict]:
        """End nodes after their sums have gone up to their parents."""
        for row in sorted(done, key=lambda r: -r["depth"]):
            row["n_leaves"] = row["n_leaves"] or 1
            row["saved_tokens"] += (row["n_convs"] - 1) * row["chars"]
            above = self.nodes.get(row["parent"])
            if above is not None:
                above["n_children"] += 1
                above["n_leaves"] += row["n_leaves"]
                above["saved_tokens"] += row["saved_tokens"]
            yield dict(row, kind=3)
        for row in done:
            del self.nodes[row["path"]]


def _batch(rows: list[dict], shard: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(rows) if name == "shard" else [r.get(name) for r in rows], _TYPES[kind]) for name, kind in _COLUMNS],
        names=[name for name, _ in _COLUMNS])


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple[int, bytes]]]:
    rows, turns = [], 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if rows and turns + len(row[1]) // RECORD >= limit:
                yield rows
                rows, turns = [], 0
            rows.append(row)
            turns += len(row[1]) // RECORD + 1
    if rows:
        yield rows


def _shard(limit: int):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, opened, runs = TaskContext.get().partitionId(), Open(), _runs(batches, limit)
        before, run = None, next(runs, None)
        while run is not None:
            after = next(runs, None)
            left = len(run[0][1]) // RECORD if before is None else _shared(before, run[0][1])
            right = len(run[-1][1]) // RECORD if after is None else _shared(run[-1][1], after[0][1])
            rows = list(run_nodes(run, left, right))
            ended = list(opened.add([r for r in rows if r["kind"] == 1]))
            yield _batch([r for r in rows if r["kind"] != 1] + ended, shard)
            before, run = run[-1][1], after
        if opened.nodes:
            yield _batch(list(opened.nodes.values()), shard)

    return nodes


def _merge(last: bool):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows, opened, out = sorted(table.to_pylist(), key=lambda r: r["shard"]), Open(), []
        for _, same in groupby(rows, key=lambda r: r["shard"]):
            out += opened.add(list(same))
        if last:
            out += opened.finish(list(opened.nodes.values()))
        return pa.Table.from_batches([_batch(out + list(opened.nodes.values()), key[0].as_py())])

    return merge


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by path and first id: one hash per path, however many pieces it has."""
    path = digest = None
    for batch in batches:
        done = []
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if at != path:
                if digest:
                    done.append((path, digest.hexdigest()))
                path, digest, lead = at, hashlib.sha256(), ""
            digest.update((lead + ",".join(map(str, np.frombuffer(ids, "<i8").tolist()))).encode())
            lead = ","
        if done:
            yield pa.RecordBatch.from_pylist([{"path": p, "ends": e} for p, e in done])
    if digest:
        yield pa.RecordBatch.from_pylist([{"path": path, "ends": digest.hexdigest()}])


def trie(conversations: DataFrame, run: int = RUN, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """A row per node: its least member, depth, its parent's least member, members, children, leaves, savings, ends' hash."""
    spark = conversations.sparkSession
    rows = hold(sequences(conversations), "sequences")
    size = rows.agg(F.count("*"), F.sum(F.octet_length("seq"))).first()
    shards = max(spark.sparkContext.defaultParallelism, (size[0] + (size[1] or 0) // RECORD) // shard + 1)
    dealt = rows.repartitionByRange(shards, "seq", "conv_id")
    found = hold(dealt.sortWithinPartitions("seq", "conv_id").mapInArrow(_shard(run), _PART), "nodes")
    opened, ended = found.filter("kind = 1"), found.filter("kind = 3")
    while True:
        shards = -(-shards // fan)
        merged = hold(opened.groupBy(F.floor(F.col("shard") / fan).cast("int").alias("group")).applyInArrow(_merge(shards == 1), _PART), "merged")
        opened, ended = merged.filter("kind = 1"), ended.union(merged.filter("kind = 3"))
        if shards == 1:
            break
    pieces = found.filter("kind = 2").select("path", "conv_id", "ids").repartition("path").sortWithinPartitions("path", "conv_id")
    hashes = pieces.select("path", "ids").mapInArrow(_hash_pieces, "path binary, ends string")
    columns = [x.split()[0] for x in _NODE.split(", ")]
    open_nodes = ended.select(*columns, "path", "parent").join(hashes, "path", "left").select(
        *columns, "parent", F.coalesce("ends", F.lit(_NOBODY)).alias("ends"))
    inner = found.filter("kind = 0").select(*columns, "parent", "ends")
    above = ended.select(F.col("path").alias("parent"), F.col("conv_id").alias("up"))
    hanging = inner.filter(F.col("parent").isNotNull()).union(open_nodes).join(above, "parent", "left").withColumn(
        "parent_conv_id", F.col("up")).select(*columns, "ends")
    return inner.filter(F.col("parent").isNull()).select(*columns, "ends").union(hanging).withColumnRenamed("ends", "ends_sha256")
