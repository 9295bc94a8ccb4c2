"""Centroid clustering of integer vectors with scalar look-up tables.

Vectors become blocks of at most ``BLOCK`` rows. Of each dimension a block holds the values that occur in it, once, and for
every vector the place of its value. Per round and block, the squared differences between each occurring value and each
centroid are tabulated; the distances of all vectors are gathered from these tables and added up. The sums for new centroids
come from the same places: values times how often each occurs per cluster. A task adds up its blocks, so that a round
shuffles a few numbers per task, whatever the size of a cluster; only a row per cluster and dimension reaches the driver.

All numbers are exact: 64-bit integers while the sums are known to fit, else Python's integers. Sums cross tasks in limbs of
32 bits, so that they cannot overflow.

Defined results: a vector takes part if it has exactly ``dims`` components, none null, not a number or infinite, also not
after the multiplication by ``SCALE``. A vector without an id takes part, and is a first centroid only after all others.
Repeated rows are vectors of their own; of equal hashes, the vector with the smaller components (before the floor) is a centroid first.
With fewer vectors than ``k`` there are as many centroids as vectors. Sums and distances beyond 64 bits are null. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.tables import hold

DIMS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024.0
BLOCK = 4096
LIMB = 32

_BLOCKS = "vec_ids array<bigint>, places binary, sizes array<int>, occurring array<double>"
_RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def usable(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """``vec_id, v``: SCALE x of the vectors that take part; ``_encode`` takes the floor."""
    values = F.transform(F.col("embedding"), lambda x: x.cast("double") * SCALE)
    fine = ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter((F.size("embedding") == dims) & fine).select(F.col("vec_id").cast("bigint"), values.alias("v"))


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays([0, len(values)], values)


def _encode(dims: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), BLOCK):
                part = batch.slice(low, BLOCK)
                rows = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                occurring, places = zip(*(np.unique(rows[:, d], return_inverse=True) for d in range(dims)))
                yield pa.RecordBatch.from_arrays([
                    _one(part.column(0)), pa.array([np.stack(places).astype("<u2").tobytes()]),
                    _one(pa.array([len(x) for x in occurring], pa.int32())), _one(pa.array(np.concatenate(occurring))),
                ], names=["vec_ids", "places", "sizes", "occurring"])

    return encode


class Tables:
    """One block: occurring values per dimension, and the tables of their differences to centroids."""

    def __init__(self, places: bytes, sizes: list[int], occurring: np.ndarray):
        self.places = np.frombuffer(places, "<u2").reshape(len(sizes), -1)
        self.values = np.split(occurring, np.cumsum(sizes)[:-1])
        self.widest = max((abs(float(x)) for v in self.values for x in (v[0], v[-1])), default=0.0)

    def _exact(self, values: np.ndarray, small: bool) -> np.ndarray:
        return values.astype(np.int64) if small else np.array([int(x) for x in values], object)

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each vector; of equal distances the smaller number wins."""
        reach = self.widest + max(abs(x) for c in centroids for x in c)
        small = len(self.values) * reach * reach < 2.0 ** 62
        total = np.zeros((self.places.shape[1], len(centroids)), np.int64 if small else object)
        for d, (values, place) in enumerate(zip(self.values, self.places)):
            own = np.array([c[d] for c in centroids], np.int64 if small else object)
            table = (self._exact(values, small)[:, None] - own[None, :]) ** 2
            total += table[place]
        cluster = np.argmin(total, axis=1) if small else np.array([int(min(range(len(r)), key=r.__getitem__)) for r in total], np.int64)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> list[list[int]]:
        """Per cluster, the sum of each dimension."""
        small = self.widest * len(cluster) < 2.0 ** 62
        out = []
        for values, place in zip(self.values, self.places):
            times = np.bincount(cluster * len(values) + place, minlength=k * len(values)).reshape(k, len(values))
            exact = self._exact(values, small)
            out.append([int(x) for x in (times.astype(exact.dtype) @ exact)])
        return [list(row) for row in zip(*out)]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Tables]]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.column(0)[i].values, Tables(
                batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].values.to_numpy(zero_copy_only=False))


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A number as parts of 32 bits, the last of which has the sign."""
    place = 0
    while not -(1 << 62) < value < 1 << 62 or place == 0:
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    yield place, value


def _totals(rows: DataFrame, centroids: list[list[int]], of: str) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """Sizes of the clusters, and exact sums by cluster and dimension: of the components, or (``of`` "distance") of distances."""
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, sums = [0] * k, {}
        for _, block in _tables(batches):
            cluster, distance = block.nearest(centroids)
            for c, n in enumerate(np.bincount(cluster, minlength=k).tolist()):
                sizes[c] += n
            if of == "distance":
                small = len(distance) * int(max(distance)) < 1 << 62
                parts = [[int((distance if small else distance.astype(object))[cluster == c].sum())] for c in range(k)]
            else:
                parts = block.sums(cluster, k)
            for c, part in enumerate(parts):
                for d, x in enumerate(part):
                    sums[c, d] = sums.get((c, d), 0) + x
        out = [(c, -1, 0, n) for c, n in enumerate(sizes)] + [(c, d, j, x) for (c, d), s in sums.items() for j, x in _limbs(s)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "dim", "limb", "part"])

    found = rows.mapInArrow(add, "cluster int, dim int, limb int, part bigint").groupBy("cluster", "dim", "limb").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    sizes, sums = {}, {}
    for r in found.collect():  # a row per cluster, dimension and limb
        if r["dim"] < 0:
            sizes[r["cluster"]] = int(r["part"])
        else:
            sums[r["cluster"], r["dim"]] = sums.get((r["cluster"], r["dim"]), 0) + (int(r["part"]) << (LIMB * r["limb"]))
    return sizes, sums


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return [[int(np.floor(x)) for x in r["v"]] for r in chosen]


def _fits(value: int) -> int | None:
    return value if -(1 << 63) <= value < 1 << 63 else None


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3, dims: int = DIMS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` after ``rounds`` rounds and one more assignment."""
    rows = usable(vectors, dims)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    blocks = hold(rows.mapInArrow(_encode(dims), _BLOCKS), "blocks")
    for _ in range(rounds):
        sizes, sums = _totals(blocks, centroids, "components")
        moved = [[sums[c, d] // sizes[c] for d in range(dims)] if sizes[c] else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break  # further rounds would change nothing
        centroids = moved
    _, inertia = _totals(blocks, centroids, "distance")
    per_cluster = [_fits(inertia[c, 0]) for c in range(len(centroids))]
    whole = _fits(sum(inertia.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _tables(batches):
            cluster, distance = block.nearest(centroids)
            at = pa.array(cluster)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(cluster.astype(np.int32)), pa.array([_fits(int(x)) for x in distance], pa.int64()),
                pa.array(per_cluster, pa.int64()).take(at), pa.array([whole] * len(cluster), pa.int64()), pa.array(names).take(at),
            ], names=[x.split()[0] for x in _RESULT.split(", ")])

    return blocks.mapInArrow(assign, _RESULT)
