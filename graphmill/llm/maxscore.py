"""Exact top-k inner products by MaxScore.

A query's terms are the vector's dimensions. In a shard of candidates each dimension has a posting list of the
candidates with a value other than 0 there, and bounds: dimension d adds between lb and ub of q[d] times its
values. ub - lb is the term's largest impact, and terms are ordered by it. With the k-th best score so far as
threshold, the non-essential terms are the tail whose impacts together cannot lift a candidate from the lower
bound to the threshold. The essential terms' postings are traversed; the others are probed only for candidates
that can still compete. Where most values are 0, a candidate in no essential posting is never looked at. Each
shard gives its best k for each query, and the shards' lists are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components of a shard of candidates and of a block of queries, at most about: what a task holds of either.
#: Each shard's rows are copied to every block and each block's to every shard, so that both are large.
SHARD_CELLS = 1 << 22
BLOCK_CELLS = 1 << 19
#: Rows of a shard at least, where the input is small and the shards should be many.
SHARD = 4096
#: Candidates scored in full to begin with, for a threshold.
SEED = 256
#: Candidates whose essential terms are added up at a time, where postings are dense.
STEP = 1024
#: Non-essential terms probed between two looks at the threshold.
PROBE = 8


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id, v: floor(scale * x) of each component; vectors that are null or hold null or non-finite components
    are left out, as are null ids."""
    x = F.transform(F.col(vector_col), lambda e: F.floor(F.lit(scale) * e.cast("double")))
    fine = F.forall(F.col(vector_col), lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


class Shard:
    """Candidates in order of id, the postings of each dimension, and its bounds."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        some = v != 0
        self.sparse = v.size > 0 and some.mean() < 0.25
        self.postings = [np.flatnonzero(some[:, d]) for d in range(v.shape[1])] if self.sparse else []
        self.hi, self.lo = (v.max(axis=0), v.min(axis=0)) if v.size else (v, v)

    def top(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The best k (id, score) for a query, ties to smaller ids."""
        v, ids = self.v, self.ids
        cand = np.flatnonzero(ids != own)
        if not len(cand) or not len(q):
            return [(int(i), 0) for i in ids[cand[:k]]]
        ub, lb = np.maximum(q * self.hi, q * self.lo), np.minimum(q * self.hi, q * self.lo)
        order = np.argsort(lb - ub, kind="stable")  # largest impact first
        tail = np.concatenate([np.cumsum((ub - lb)[order][::-1])[::-1], [0]])  # impacts from a place on
        top_tail = np.concatenate([np.cumsum(ub[order][::-1])[::-1], [0]])
        seed, rest = cand[:SEED], cand[SEED:]
        found, scores = seed, v[seed] @ q
        theta = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
        if self.sparse and np.isfinite(theta):
            # terms whose upper bounds, or 0 for a value of 0, together stay below the threshold are no reason
            # to look at a candidate
            above = np.maximum(ub, 0)[order]
            reach = np.concatenate([np.cumsum(above[::-1])[::-1], [0]])
            essential = int(np.searchsorted(-reach, -theta, "right"))
            if essential < len(q):
                acc = np.zeros(len(ids), bool)
                for d in order[:essential]:
                    if q[d]:
                        acc[self.postings[d]] = True
                acc[seed] = acc[ids == own] = False
                rest = np.flatnonzero(acc)
        while len(rest):
            theta = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
            essential = max(int(np.searchsorted(-tail, -(theta - lb.sum()), "right")), 1) if np.isfinite(theta) else len(q)
            block, rest = rest[:STEP], rest[STEP:]
            part = v[block][:, order[:essential]] @ q[order[:essential]]
            at = essential
            while True:
                keep = part + top_tail[at] >= theta
                block, part = block[keep], part[keep]
                if at >= len(q) or not len(block):
                    break
                terms = order[at : at + PROBE]
                part = part + v[block][:, terms] @ q[terms]
                at = min(at + PROBE, len(q))
            found, scores = np.concatenate([found, block]), np.concatenate([scores, part])
            if len(scores) > 4 * k:
                best = np.lexsort((ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
        best = np.lexsort((ids[found], -scores))[:k]
        return [(int(ids[found[i]]), int(scores[i])) for i in best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all vectors.

    Both frames are (id, v) with integer components. Candidates with the query's id are its own and left
    out; repeated candidate rows are candidates each; equal query rows count once. Only vectors of the
    query's length are compared. Queries without candidates give no row. Candidates are dealt into shards
    of about SHARD_CELLS components (on small inputs into more, so that all cores work), queries into blocks of
    about BLOCK_CELLS, and each block meets each shard once, so that no task holds more than one of either,
    however many rows share an id. An empty table gives no row."""
    n, cells = vectors.agg(F.count("*"), F.sum(F.size("v"))).first()
    asked_cells = queries.agg(F.sum(F.size("v"))).first()[0]
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-(cells or 0) // SHARD_CELLS), min(2 * cores, -(-n // SHARD)))
    blocks = max(1, -(-(asked_cells or 0) // BLOCK_CELLS))
    dim = F.size("v").alias("dim")
    # the row's place in its partition spreads rows that share an id
    spread = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    cands = vectors.select(dim, spread.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asked = queries.distinct().select(dim, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.xxhash64("id", "v").alias("q"), "id", "v")

    def meet(c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(c) and len(a):
            c = c.sort_values("id", kind="stable")
            ids = c["id"].to_numpy()
            v, q = np.array(c["v"].tolist(), np.int64).reshape(len(c), -1), np.array(a["v"].tolist(), np.int64).reshape(len(a), -1)
            if v.size and q.size and float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < 2**52:
                v, q = v.astype(np.float64), q.astype(np.float64)  # exact, and faster
            shard = Shard(ids, v)
            for key, own, x in zip(a["q"], a["id"], q):
                out += [(key, own, i, s) for i, s in shard.top(x, own, k)]
        return pd.DataFrame(out, columns=["q", "query_id", "vec_id", "score"])

    best = (
        cands.groupBy("dim", "shard", "block")
        .cogroup(asked.groupBy("dim", "shard", "block"))
        .applyInPandas(meet, "q long, query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
