"""Nearest vectors of many queries at once, exact, by a table of distances to pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.storage import stored

#: Pivots are chosen, each the furthest from those before, among this many vectors of the smallest hash.
SAMPLE = 2000
PIVOTS = 24
#: Vectors of a cell, and queries, that meet in one group at most, but for the spread of a hash.
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 1024
#: Distances are compared with this much room, relative to their size, for rounding.
ROOM = 1e-9


def pivots_of(vectors: DataFrame, key: str, column: str, most: int = PIVOTS) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(F.transform(column, lambda x: x.cast("double")).alias("v")).toArrow()
    at = np.array(rows.column("v").to_pylist(), float)
    if not len(at):
        return np.zeros((0, 0))
    chosen, gap = [0], np.linalg.norm(at - at[0], axis=1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(at - at[chosen[-1]], axis=1))
    return at[chosen]


def placed(vectors: DataFrame, key: str, column: str, pivots: np.ndarray) -> DataFrame:
    """(key, vector, to: distances to the pivots, cell: the nearest pivot)."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.transform(column, lambda x: x.cast("double")).alias("vector"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                to = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(pivots), pa.int32()), pa.array(to.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat, pa.array(to.argmin(axis=1), pa.int32())], names=["key", "vector", "to", "cell"])

    return rows.mapInArrow(run, "key long, vector array<double>, to array<double>, cell int")


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _met(queries: DataFrame, vectors: DataFrame, limit: int, pairs: DataFrame) -> DataFrame:
    """(query, key, distance, looked): the `limit` best of each block of a cell for the queries that pairs (query,
    cell, reach) sends there, and in `looked`, on a query's first row of a block, how many vectors were measured.
    A row without a key only carries that number."""
    asked = queries.select(F.col("key").alias("query"), F.col("vector").alias("_v"), F.col("to").alias("_t")).join(pairs, "query")
    sizes = vectors.groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK_VECTORS).cast("long").alias("parts"))
    loads = pairs.groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK_QUERIES).cast("long").alias("turns"))
    shape = F.broadcast(sizes.join(loads, "cell"))  # a row for each pivot at most
    left = asked.join(shape, "cell").select("cell", F.pmod(F.xxhash64("query"), F.col("turns")).alias("turn"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "query", "_v", "_t", "reach")
    right = vectors.join(shape, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), "key", "vector", "to")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if a.num_rows and b.num_rows:
            x, to, key = _matrix(b.column("vector")), _matrix(b.column("to")), b.column("key").to_numpy()
            for query, v, t, reach in zip(a.column("query").to_pylist(), _matrix(a.column("_v")), _matrix(a.column("_t")), a.column("reach").to_pylist()):
                room = ROOM * (1 + t.max() + to.max())
                near = np.flatnonzero(np.abs(to - t).max(axis=1) <= reach + room)
                near = near[key[near] != query]
                d = np.linalg.norm(x[near] - v, axis=1)
                best = np.lexsort((key[near], d))[:limit]
                best = best[d[best] <= reach + room]
                n = max(1, len(best))
                out[0] += [query] * n
                out[1] += key[near[best]].tolist() or [None]
                out[2] += d[best].tolist() or [None]
                out[3] += [len(near)] + [0] * (n - 1)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query", "key", "distance", "looked"])

    by = ["cell", "turn", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "query long, key long, distance double, looked long")


def _best(rows: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy("distance", "key")
    return rows.where("key is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, key: str = "id", column: str = "embedding", limit: int = 20, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The `limit` nearest vectors (Euclid) of every query but itself, (query, rank, key, distance), ties to the
    smaller key; and (query, looked): how many vectors each query was measured against.

    Each vector belongs to the cell of its nearest pivot. A query first meets its own cell; the distance of the
    last of its best is its reach. By the triangle inequality it then needs only cells whose range of distances
    to each pivot comes within reach, and of these only vectors that do: whatever is passed over is further
    away, so the result is exact. Cells and queries are dealt out in blocks, none of them in one task. Keys are
    longs; vectors and queries that are null, hold null or non-finite components, or are not of the first's
    size by hash take no part; a vector's key counts as often as it occurs, and of a repeated query's the least
    vector asks."""

    def sound(df: DataFrame) -> DataFrame:
        c = F.col(column)
        finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        return df.where(F.col(key).isNotNull() & c.isNotNull() & (F.size(c) > 0) & finite)

    have = sound(vectors)
    head = have.orderBy(F.xxhash64(key), key).select(F.size(column)).first()
    size = head[0] if head else 0
    have, asked = (sound(df).where(F.size(column) == size) for df in (vectors, queries))
    asked = asked.groupBy(key).agg(F.min(column).alias(column))
    centres = pivots_of(have, key, column, pivots)
    table = stored(placed(have, key, column, centres))
    wanted = stored(placed(asked, key, column, centres))
    own = wanted.select(F.col("key").alias("query"), "cell", F.lit(float("inf")).alias("reach"))
    first = stored(_met(wanted, table, limit, own))
    last = _best(first, limit).groupBy("query").agg(F.max("rank").alias("n"), F.max("distance").alias("d"))
    reach = wanted.select(F.col("key").alias("query"), F.col("cell").alias("own"), "to").join(last, "query", "left").withColumn("reach", F.when(F.col("n") == limit, F.col("d")).otherwise(F.lit(float("inf"))))
    spans = table.select("cell", F.posexplode("to").alias("i", "t")).groupBy("cell", "i").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    boxes = spans.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("box"))  # a row for each pivot
    every = boxes.agg(F.collect_list(F.struct("cell", "box")).alias("cells"))
    near = reach.crossJoin(F.broadcast(every)).select("query", "own", "reach", "to", F.explode("cells").alias("c"))  # every: one row
    apart = F.array_max(F.zip_with("to", "c.box", lambda t, b: F.greatest(b["low"] - t, t - b["high"], F.lit(0.0))))
    room = F.lit(ROOM) * (1 + F.array_max("to"))
    others = stored(near.where((F.col("c.cell") != F.col("own")) & (apart <= F.col("reach") + room)).select("query", F.col("c.cell").alias("cell"), "reach"))
    both = stored(first.unionByName(_met(wanted, table, limit, others)))
    return _best(both, limit).select("query", "rank", "key", "distance"), both.groupBy("query").agg(F.sum("looked").alias("looked"))
