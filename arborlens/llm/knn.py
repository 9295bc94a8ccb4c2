"""Exact top-k inner products by a Voronoi join.

Pivots, a bounded sample of the vectors, part the space into cells; every vector belongs to its nearest pivot. A cell is
summed up by its size and radius. Queries are grouped by their cells too. A first pass solves each query in its own cell
(and, should that hold fewer than k others, has no bound), which gives a score that its k-th best cannot be below. With pivot
p and radius r, no vector of a cell scores more than ``<q,p> + |q| r``. A cell is needed by a group of queries if for some
query of it that is not below the query's bound. Data goes only to the groups that need its cell, in blocks of at most
``DATA_BLOCK`` vectors by hash, so that a cell with a third of all vectors is many tasks; each block is solved locally and
gives k rows a query, and the best k of these are kept.

Scores are exact: components are integers, products are formed in doubles while all sums stay below 2^53, else in Python's
integers; beyond 64 bits they count as the nearest number of 64 bits. The bounds have a margin for the rounding of distances.

Defined results: vectors that are null, empty, or hold a component that is null or not finite (times 1024) take no part; of vectors with
different lengths the shorter ones count as filled up with zeros; ties go to the smaller id; repeated ids are vectors of
their own, but one query (the least of the vectors), and a query is not matched with rows of its own id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.llm.tables import hold

PIVOTS = 64
DATA_BLOCK = 4096
QUERY_BLOCK = 1024
SCALE = 1024.0
MARGIN = 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: floor(1024 x) of sound vectors, as doubles."""
    def whole(x: Column) -> Column:  # beyond 2^52 a double has no fraction
        return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)

    values = F.transform(F.transform(F.col("embedding"), lambda x: x.cast("double") * SCALE), whole)
    sound = F.size("embedding").cast("int") > 0
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * SCALE) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & sound & fine).select(F.col("vec_id").cast("bigint"), values.alias("v"))


def _rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _cell_of(pivots: np.ndarray):
    width = pivots.shape[1]
    norms = (pivots * pivots).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(1), width)
            cell = np.argmin(norms - 2 * rows @ pivots.T, axis=1)
            away = np.sqrt(((rows - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(away)], names=["vec_id", "v", "cell", "away"])

    return assign


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if most < 2 ** 53:
        return (queries @ data.T).astype(np.int64)
    whole = [np.array([int(x) for x in rows.flat], object).reshape(rows.shape) for rows in (queries, data)]
    return np.clip(whole[0] @ whole[1].T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> pa.Table:
    """The best k of the data for each query."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    out_q, out_v, out_s = [], [], []
    for low in range(0, len(queries), 64):
        scores = _products(queries[low:low + 64], data)
        for q, row in zip(query_ids[low:low + 64], scores):
            at = np.flatnonzero(ids != q)
            if len(at) > k:
                own = row[at]
                at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
            at = at[np.argsort(-row[at], kind="stable")[:k]]
            out_q.append(np.full(len(at), q))
            out_v.append(ids[at])
            out_s.append(row[at])
    none = [np.empty(0, np.int64)]
    return pa.table({"query_id": np.concatenate(out_q or none), "vec_id": np.concatenate(out_v or none), "score": np.concatenate(out_s or none)})


def _solver(width: int, k: int):
    def solve(table: pa.Table) -> pa.Table:
        asks = table["query"].to_numpy()
        ids, rows = table["vec_id"].to_numpy(), _rows(table["v"], width)
        return _best(ids[asks], rows[asks], ids[~asks], rows[~asks], k)

    return solve


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _need(pivots: np.ndarray, radius: np.ndarray, width: int):
    norms = np.sqrt((pivots * pivots).sum(1)) + radius

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(1), width)
            length = np.sqrt((rows * rows).sum(1))[:, None]
            upper = rows @ pivots.T + length * radius
            bound = batch.column(2).to_numpy(zero_copy_only=False).astype(float)[:, None]
            wanted = (upper + MARGIN * (1 + length * norms) >= bound) | np.isnan(bound)
            wanted &= radius >= 0
            q, cell = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(q)), pa.array(cell.astype(np.int32))], names=["part", "cell"])

    return need


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best k of all other vectors for those whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()  # at most that many vectors
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    centres = np.unique(np.array([r["v"] + [0.0] * (width - len(r["v"])) for r in sample]), axis=0)
    held = hold(rows.mapInArrow(_cell_of(centres), "vec_id bigint, v array<double>, cell int, away double"), "cells")
    summary = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row per pivot
    radius, count = np.full(len(centres), -1.0), {}
    for row in summary:
        radius[row["cell"]], count[row["cell"]] = row["radius"], row["n"]
    blocks = F.create_map(*[F.lit(int(x)) for c, n in sorted(count.items()) for x in (c, -(-n // DATA_BLOCK))])
    asked = held.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("one")).select("vec_id", "one.*")
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    data = held.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), blocks[F.col("cell")]).cast("int").alias("block"))
    # Queries of one cell are put together: groups follow the cells' order.
    part = F.floor((F.col("cell") * F.lit(2 ** 20) + F.pmod(F.xxhash64("vec_id"), F.lit(2 ** 20))) * groups / (len(centres) * 2 ** 20)).cast("int")
    asked = hold(asked.select("vec_id", "v", "cell", part.alias("part")), "queries")
    solve = _solver(width, k)

    home = asked.select("part", "cell").distinct()
    first = _solved(data, asked, home, blocks, solve, own_cell=True)
    first = hold(_top(first, k), "home")
    bound = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bounded = asked.join(bound, asked["vec_id"] == bound["query_id"], "left").select(
        "vec_id", "v", F.when(F.col("n") >= k, F.col("low")).cast("double").alias("bound"), "part")
    wanted = hold(bounded.mapInArrow(_need(centres, radius, width), "part int, cell int").distinct(), "needed")
    rest = _solved(data, asked, wanted, blocks, solve, own_cell=False)
    found = rest.select("query_id", "vec_id", "score")
    return _top(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _solved(data: DataFrame, asked: DataFrame, wanted: DataFrame, blocks, solve, own_cell: bool) -> DataFrame:
    """Local results of all (group, cell) in ``wanted``; each query goes to all blocks of the cell."""
    to = data.join(wanted, "cell").select("part", "cell", "block", "vec_id", "v", F.lit(False).alias("query"))
    asks = asked.select("part", "cell", "vec_id", "v") if own_cell else asked.drop("cell").join(wanted, "part")
    asks = asks.select("part", "cell", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)).alias("block"), "vec_id", "v",
                       F.lit(True).alias("query"))
    return to.union(asks.select(*to.columns)).groupBy("part", "cell", "block").applyInArrow(solve, _FOUND)
