"""Near-duplicate groups by a MinHash LSH forest.

Every distinct shingle set gets ``TREES`` keys of ``DEPTH`` minimum hashes. For each tree all sets are put in the order
of their keys, dealt out by ranges of ``(tree, key, doc_id)``, so that even equal keys spread. A set's candidates are the
sets next to it with the longest common prefix: in sparse regions of an order a short prefix is enough, in dense ones
the neighbours share long ones. Two sets of similarity 0.75 share the shortest accepted prefix (``LEAST``) in no tree
with probability (1 - 0.75^2)^16 = 2e-6.

A region (equal prefix) wider than the neighbours looked at is *crowded*. After the links between neighbours are known,
crowded regions that still hold several groups are compared in full, in blocks: all sets outside the region's largest
group against all sets of the region; such a block has the full sets at hand and gives one confirmed link for each set and
other group that it meets, no pairs. The depth of such a region adapts: it is the first prefix length that leaves at
most ``OUTSIDERS`` sets outside the largest group, or the whole key.

Going deeper splits a region, and pairs that fall apart there may meet in no tree. So all sets of split regions are joined
exactly afterwards, between different groups: of the shingles in order of their frequency, two similar sets share one at
the beginning, with enough shingles left behind it in both for the similarity (prefix, size and place filter in one).

Neighbours pass a check of the signatures first (estimate >= ``ESTIMATE``; at a true similarity of 0.75 that misses by
chance once in 10^7) and are then confirmed on full sets; equal signatures stand for nothing by themselves. Pairs inside
one group already need no confirmation, so that large groups cost a few confirmations per member, not all pairs.

Inside, a set goes by the smallest 64-bit hash of its texts (``doc_id`` in the tables below), so that ids may be null or stand
for several texts.

Defined results: null or blank texts have empty sets and are linked with nothing; each row is grouped by its own text, also
where an id is null or has other texts too, and repeated rows give a row each; a group is named by its smallest id, null if
it has none; extra columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.llm.components import components, merge
from arborlens.llm.shingles import mix, sets_of
from arborlens.llm.tables import free, hold

TREES = 16
DEPTH = 8
LEAST = 2
NEIGHBOURS = 3
ESTIMATE = 0.55
OUTSIDERS = 2048
QUERY_BLOCK = 256
DATA_BLOCK = 1024
PREFIX_BLOCK = 1024  # sets with one shingle that are joined at a time
BROADCAST_IDS = 2_000_000  # 16 bytes each
HASHES = TREES * DEPTH

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_XOR = _SEEDS[:HASHES].astype(np.uint32)
_TIMES = _SEEDS[HASHES:].astype(np.uint32) | np.uint32(1)
_CHUNK = 1 << 16


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes of non-empty sets, a row each."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    halves = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((halves[k % 2] ^ _XOR[k]) * _TIMES[k], starts)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        counts, keys, signatures = [], [], []
        waiting: list[np.ndarray] = []

        def settle() -> None:
            if waiting:
                signatures.extend(row.tobytes() for row in _minima(waiting))
                waiting.clear()

        size = 0
        for values in sets_of(text.as_py() for text in batch.column(2)):
            counts.append(len(values))
            keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
            if not len(values):
                settle()
                signatures.append(None)
                continue
            waiting.append(values)
            size += len(values)
            if size > _CHUNK:
                settle()
                size = 0
        settle()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "set_key", "signature"])


def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key, signature`` of whole texts."""
    return docs.select(F.col("doc_id").cast("bigint"), text_key().alias("text_key"), F.col("text").cast("string")).mapInArrow(
        _sign, "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, signature binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _matrix(batch.column(1), 4 * HASHES).view("<u4").astype(">u4").view(np.uint8)
        for tree in range(TREES):
            part = rows[:, 4 * DEPTH * tree:4 * DEPTH * (tree + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), tree, np.int32)), pa.array([r.tobytes() for r in part], pa.binary()), batch.column(0)],
                names=["tree", "key", "doc_id"])


PAIR, CROWDED, EDGE = 0, 1, 2
_FOUND = "kind int, tree int, key binary, a bigint, b bigint"


def _found(kind: int, tree: np.ndarray, key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    keys = [None] * len(a) if key is None else [k.tobytes() for k in key]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(tree), pa.array(keys, pa.binary()), pa.array(a),
         pa.array([None] * len(a), pa.int64()) if b is None else pa.array(b)],
        names=["kind", "tree", "key", "a", "b"])


def _near(tree: np.ndarray, key: np.ndarray, ids: np.ndarray, fresh: int) -> Iterator[pa.RecordBatch]:
    """Neighbours in sorted rows, where the second one is at ``fresh`` or later."""
    for step in range(1, NEIGHBOURS + 2):
        low = np.arange(max(0, fresh - step), len(ids) - step)
        if not len(low):
            continue
        same = (tree[low] == tree[low + step]) & (key[low, :4 * LEAST] == key[low + step, :4 * LEAST]).all(1)
        low = low[same]
        if step <= NEIGHBOURS:
            yield _found(PAIR, tree[low], None, np.minimum(ids[low], ids[low + step]), np.maximum(ids[low], ids[low + step]))
        else:
            both = np.unique(np.r_[low, low + step])
            yield _found(CROWDED, tree[both], key[both], ids[both], None)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within a partition, and its first and last rows for those across the borders."""
    keep = NEIGHBOURS + 1
    tree, key, ids = np.empty(0, np.int32), np.empty((0, 4 * DEPTH), np.uint8), np.empty(0, np.int64)
    given = 0  # first rows given out so far
    for batch in batches:
        old = len(ids)
        tree = np.r_[tree, batch.column(0).to_numpy(zero_copy_only=False)]
        key = np.concatenate([key, _matrix(batch.column(1), 4 * DEPTH)])
        ids = np.r_[ids, batch.column(2).to_numpy(zero_copy_only=False)]
        if given < keep:
            more = slice(old, old + keep - given)
            yield _found(EDGE, tree[more], key[more], ids[more], None)
            given += len(ids[more])
        yield from _near(tree, key, ids, old)
        tree, key, ids = tree[-keep:], key[-keep:], ids[-keep:]
    yield _found(EDGE, tree, key, ids, None)


def _across(table: pa.Table) -> pa.Table:
    """Neighbours among the border rows of a tree."""
    ids = table.column("a").to_numpy()
    rows = np.array(sorted({(k, i) for k, i in zip(table.column("key").to_pylist(), ids.tolist())}), dtype=object).reshape(-1, 2)
    key = np.frombuffer(b"".join(rows[:, 0]), np.uint8).reshape(-1, 4 * DEPTH)
    tree = np.full(len(rows), table.column("tree")[0].as_py(), np.int32)
    return pa.Table.from_batches(_near(tree, key, rows[:, 1].astype(np.int64), 0), schema=_found(PAIR, tree[:0], None, ids[:0], None).schema)


def neighbours(signed: DataFrame) -> DataFrame:
    """Pairs of neighbours and crowded rows in all orders, of ``(doc_id, signature)`` with one row per set."""
    orders = signed.select("doc_id", "signature").mapInArrow(_plant, "tree int, key binary, doc_id bigint")
    dealt = orders.repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    found = hold(dealt.mapInArrow(_walk, _FOUND), "neighbours")
    borders = found.filter(F.col("kind") == EDGE).groupBy("tree").applyInArrow(_across, _FOUND)
    return hold(found.filter(F.col("kind") != EDGE).union(borders).distinct(), "candidates")


def _agreement(least: float):
    def agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2), HASHES) == _matrix(batch.column(3), HASHES)).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], names=["a", "b", "estimate"]).filter(
                pa.array(same >= least))

    return agreement


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r.tobytes() for r in _matrix(batch.column(1), 4 * HASHES)[:, ::4]], pa.binary())],
            names=["doc_id", "sketch"])


def _rooted(deepest: int):
    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sketches, and for each tree a 64-bit hash of the first ``deepest`` whole hashes of the key."""
        for batch in batches:
            rows = _matrix(batch.column(1), 4 * HASHES)
            keys = rows.view("<u4").reshape(-1, TREES, DEPTH).astype(np.uint64)
            roots = np.zeros(keys.shape[:2], np.uint64)
            for k in range(deepest):
                roots = mix((roots << np.uint64(32) | roots >> np.uint64(32)) ^ keys[:, :, k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows[:, ::4]], pa.binary()), pa.array([r.tobytes() for r in roots], pa.binary())],
                names=["doc_id", "sketch", "roots"])

    return rooted


def _likely(pairs: DataFrame, sketches: DataFrame, least: float = ESTIMATE) -> DataFrame:
    """Pairs whose sketches agree enough, with the estimate."""
    left = sketches.toDF("a", "sketch_a")
    right = sketches.toDF("b", "sketch_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(
        _agreement(least), "a bigint, b bigint, estimate double")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [v.view(np.int64) for v in sets_of(text.as_py() for text in batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def _full_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    return _sets_for(docs, pairs.select("a").union(pairs.select("b")).toDF("doc_id"))


def _sets_for(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Full sets by the keys of their texts; the keys go to the texts while there are few enough, else both are shuffled."""
    wanted = hold(ids.distinct(), "wanted")
    count = wanted.count()
    wanted = F.broadcast(wanted) if count <= BROADCAST_IDS else wanted
    texts = docs.select(text_key().alias("doc_id"), F.col("text").cast("string")).join(wanted, "doc_id", "left_semi")
    sets = hold(texts.mapInArrow(_gather, "doc_id bigint, shingles array<bigint>"), "sets")
    return sets if sets.count() == count else hold(sets.dropDuplicates(["doc_id"]), "sets")  # more rows: texts that stand several times


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    common = F.size(F.array_intersect("left_set", "right_set")).cast("bigint")
    return (
        pairs.select("a", "b").join(sets.toDF("a", "left_set"), "a").join(sets.toDF("b", "right_set"), "b")
        .select("a", "b", common.alias("common"), (F.size("left_set") + F.size("right_set")).cast("bigint").alias("total"))
        .filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common")))
        .select("a", "b"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one group yet."""
    first, second = labels.toDF("a", "la"), labels.toDF("b", "lb")
    return pairs.join(first, "a", "left").join(second, "b", "left").filter(
        F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("la", "lb")


def _link(docs: DataFrame, pairs: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Labels after confirming candidate pairs: first the best and the lowest partner of each, then what is still apart."""
    sets = _full_sets(docs, pairs)
    ends = pairs.select("a", "b", "estimate").union(pairs.select("b", "a", "estimate")).toDF("node", "other", "estimate")
    best = ends.groupBy("node").agg(
        F.max(F.struct("estimate", (-F.col("other")).alias("other"))).alias("top"), F.min("other").alias("lowest"))
    picked = best.select("node", F.explode(F.array(-F.col("top.other"), F.col("lowest"))).alias("other")).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = hold(_confirmed(picked, sets, percent), "links")
    labels = components(links) if labels is None else merge(labels, links)
    rest = hold(_apart(pairs, labels), "rest")
    if rest.isEmpty():
        return labels
    return merge(labels, hold(_confirmed(rest, sets, percent), "links"))


def _comparer(percent: int):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        """Confirmed links of the block's queries, one for each query and other group.

        A pair with equal roots in an earlier tree has been together in a region of that tree.
        """
        tree = key[0].as_py()
        query = table.column("query").to_numpy()
        ids, comps = table.column("doc_id").to_numpy(), table.column("comp").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
        roots = np.frombuffer(b"".join(table.column("roots").to_pylist()), np.uint64).reshape(-1, TREES)
        lists = table.column("shingles").combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        values, sizes = lists.flatten().to_numpy().view(np.uint64), np.diff(np.r_[0, ends])
        data, a, b = np.flatnonzero(~query), [], []
        for q in np.flatnonzero(query):
            low, high = np.minimum(sizes[data], sizes[q]), np.maximum(sizes[data], sizes[q])
            other = data[(comps[data] != comps[q]) & (100 * low >= percent * high)]
            agree = sketch[other] == sketch[q]
            fresh = (agree.mean(1) >= ESTIMATE) & ~(roots[other, :tree] == roots[q, :tree]).any(1)
            other, agree = other[fresh], agree[fresh]
            own, linked = values[ends[q] - sizes[q]:ends[q]], set()
            for o in other[np.argsort(-agree.sum(1), kind="stable")]:
                if comps[o] in linked:
                    continue
                theirs = values[ends[o] - sizes[o]:ends[o]]
                common = int((own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs).sum())
                if 100 * common >= percent * (len(own) + len(theirs) - common):
                    linked.add(comps[o])
                    a.append(min(ids[o], ids[q]))
                    b.append(max(ids[o], ids[q]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _crowded(docs: DataFrame, rows: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Confirmed links between groups that meet in crowded regions, and the sets of regions that were split, if any."""
    todo = hold(rows.join(labels.toDF("doc_id", "label"), "doc_id", "left").select(
        "tree", "key", "doc_id", F.coalesce("label", "doc_id").alias("comp")), "crowded")
    members, deepest, split = None, LEAST, None
    for depth in range(LEAST, DEPTH + 1):
        at = todo.withColumn("region", F.expr(f"substring(key, 1, {4 * depth})"))
        groups = at.groupBy("tree", "region", "comp").agg(F.count("*").alias("n"))
        regions = hold(
            groups.groupBy("tree", "region").agg(F.sum("n").alias("total"), F.max(F.struct("n", "comp")).alias("top"))
            .select("tree", "region", "total", F.col("top.comp").alias("largest"), (F.col("total") - F.col("top.n")).alias("outside"))
            .filter("outside > 0"), "regions")
        fits = F.lit(depth == DEPTH) | (F.col("outside") <= OUTSIDERS)
        part = at.join(regions.filter(fits), ["tree", "region"]).select(
            "tree", "region", "doc_id", "comp", "largest",
            F.ceil(F.col("outside") / QUERY_BLOCK).cast("int").alias("rows"), F.ceil(F.col("total") / DATA_BLOCK).cast("int").alias("columns"))
        members, deepest = part if members is None else members.union(part), depth
        deeper = regions.filter(~fits)
        if deeper.isEmpty():
            break
        todo = hold(at.join(deeper.select("tree", "region"), ["tree", "region"]).select("tree", "key", "doc_id", "comp"), "crowded")
        split = todo.select("doc_id") if split is None else split  # those of deeper levels are among them
    members = hold(members, "members")
    sketches = sets.mapInArrow(_rooted(deepest), "doc_id bigint, sketch binary, roots binary")
    full = members.join(sketches, "doc_id").join(_sets_for(docs, members.select("doc_id")), "doc_id")
    spot = F.xxhash64("doc_id")
    last = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    keep = ["tree", "region", "doc_id", "comp", "sketch", "roots", "shingles"]
    data = full.select(*keep, F.lit(False).alias("query"), F.explode(last("rows")).alias("r"), F.pmod(spot, F.col("columns")).cast("int").alias("c"))
    queries = full.filter("comp <> largest").select(
        *keep, F.lit(True).alias("query"), F.pmod(spot, F.col("rows")).cast("int").alias("r"), F.explode(last("columns")).alias("c"))
    return hold(data.union(queries).groupBy("tree", "region", "r", "c").applyInArrow(_comparer(percent), "a bigint, b bigint"), "links"), split


def _prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs ``a, b`` of different groups that can be similar enough.

    Shingles of one group only come first in the order and are counted, not joined; the others follow by frequency. All that
    two sets have in common lies at or behind their first common shingle.
    """
    rows = sets.join(labels.toDF("doc_id", "label"), "doc_id", "left").select(
        "doc_id", F.coalesce("label", "doc_id").alias("comp"), F.size("shingles").cast("bigint").alias("n"), F.explode("shingles").alias("shingle"))
    several = F.min("comp") != F.max("comp")
    met = rows.groupBy("shingle").agg(F.count("*").alias("seen"), several.alias("several")).filter("several").drop("several")
    ordered = rows.join(met, "shingle").groupBy("doc_id", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "shingle"))).alias("order"))
    # Of a pair, the larger set shares at least percent of its own shingles, and the smaller one (equal sizes: the one with the
    # larger id) 2 percent / (100 + percent): a shorter prefix, in which a passage that many sets share does not come up.
    prefix = hold(
        ordered.select("doc_id", "comp", "n", F.size("order").alias("size"), F.posexplode("order").alias("at", "next"))
        .select(F.col("next.shingle").alias("shingle"), "doc_id", "comp", "n", (F.col("size") - F.col("at")).cast("bigint").alias("left"))
        .filter(100 * F.col("left") >= percent * F.col("n"))
        .withColumn("short", (100 + percent) * F.col("left") >= 2 * percent * F.col("n")), "prefix")
    blocks = prefix.groupBy("shingle").agg(F.ceil(F.count("*") / PREFIX_BLOCK).cast("int").alias("blocks"), several.alias("several"),
                                           F.max("short").alias("any_short")).filter("several and any_short")
    dealt = prefix.join(blocks.select("shingle", "blocks"), "shingle").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    larger = dealt.select("shingle", F.col("own").alias("r"), every.alias("c"), *(F.col(x).alias(x + "_a") for x in ("doc_id", "comp", "n", "left")))
    smaller = dealt.filter("short").select("shingle", every.alias("r"), F.col("own").alias("c"), *(F.col(x).alias(x + "_b") for x in ("doc_id", "comp", "n", "left")))
    return larger.join(smaller, ["shingle", "r", "c"]).filter(
        ((F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_id_a") < F.col("doc_id_b"))))
        & (F.col("comp_a") != F.col("comp_b"))
        & ((100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b")))
    ).select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()


def _rejoin(docs: DataFrame, split: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Labels after the exact join of the sets of split regions; the estimate decides on the order of the pairs only."""
    pairs = hold(_prefix_pairs(_sets_for(docs, split), labels, percent), "pairs")
    return labels if pairs.isEmpty() else _link(docs, hold(_likely(pairs, sketches, 0.0), "likely"), labels, percent)


def grouped(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, text_key, n_shingles, group`` of each row; no group for empty sets."""
    signed = hold(signatures(docs), "signatures")
    full = signed.filter("n_shingles > 0")
    owners = hold(full.groupBy("set_key").agg(F.min("text_key").alias("owner")), "owners")
    distinct = full.join(owners.select(F.col("owner").alias("text_key")), "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = hold(distinct.select(F.col("text_key").alias("doc_id"), "signature"), "distinct")
    sketches = sets.mapInArrow(_shorten, "doc_id bigint, sketch binary")
    found = neighbours(sets)
    pairs = hold(_likely(found.filter(F.col("kind") == PAIR).select("a", "b").distinct(), sketches), "likely")
    labels = _link(docs, pairs, None, percent)
    crowded = found.filter(F.col("kind") == CROWDED).select("tree", "key", F.col("a").alias("doc_id"))
    links, split = _crowded(docs, crowded, labels, sets, percent)
    if not links.isEmpty():
        labels = merge(labels, links)
    if split is not None:
        labels = _rejoin(docs, split, labels, sketches, percent)
    named = signed.filter("n_shingles > 0").select("doc_id", "text_key", "n_shingles", "set_key").join(owners, "set_key").join(
        labels.toDF("owner", "label"), "owner", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("label", "owner").alias("group"))
    none = signed.filter("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("bigint").alias("group"))
    return hold(named.union(none), "grouped")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: groups of documents linked by ``100 * common >= percent * united``."""
    rows = grouped(docs, percent)
    names = rows.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("first"))
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return rows.join(names, "group", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group, that with the smallest id (null last); all rows without words but repeated ones with an id.

    The marks are written first and counted: up to ``BROADCAST_IDS`` they are sent to the texts, which then stay where they
    are. Of repeated rows only their own texts meet.
    """
    rows = grouped(docs, percent)
    ranked = rows.filter("group is not null").withColumn("rank", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    firsts = ranked.groupBy("group").agg(F.min("rank").alias("first"))
    copies = ranked.join(firsts, "group").filter(F.col("rank") != F.col("first")).select("doc_id", "text_key", F.lit(True).alias("copy")).distinct()
    repeated = rows.filter("doc_id is not null or group is not null").groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_key", F.lit(False).alias("copy"))
    names = free(docs.columns, "marked_id", "marked_key", "copy", "key")
    an_id, a_key, copy, key = names
    marks = hold(copies.union(repeated).groupBy("doc_id", "text_key").agg(F.max("copy").alias("copy")).toDF(an_id, a_key, copy), "marks")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(an_id)) & (text_key() == F.col(a_key))
    marked = docs.join(marks, same, "left").withColumn(key, text_key())
    once = marked.filter(~F.col(copy)).dropDuplicates(["doc_id", key])
    return marked.filter(F.col(copy).isNull()).union(once).drop(*names)
