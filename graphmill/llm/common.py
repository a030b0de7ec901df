"""Helpers shared by the operators: Arrow text buffers, shared storage, bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.storage import drop_stored, scratch, stored  # noqa: F401

#: Rows and bytes of one Arrow batch: a batch of long texts must fit a Python worker.
BATCH_ROWS = 256
BATCH_BYTES = 32 << 20
#: Text bytes that one vectorised step takes at a time (temporaries are some tens of times that).
SLICE_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers by rows and bytes. The settings are the same for every
    operator, so that it doesn't matter which plan was made last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: A key is hot if it has over one in HOT_SHARE of all rows; so at most HOT_SHARE keys are.
HOT_SHARE = 2000


def join_skewed(left: DataFrame, right: DataFrame, on: list[str], total: int, count: str = "m", how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key and, in `count`, how many rows of left have it.

    Keys of over total / HOT_SHARE rows, HOT_SHARE at most, are broadcast, so that no task gets all rows of
    a hot key; the others are joined as Spark chooses. `left` is read twice. how: inner, or left (null keys
    and keys that right lacks keep their rows)."""
    least = max(total // HOT_SHARE, 1000)
    hot, rest = right.where(F.col(count) > least), right.where(F.col(count) <= least)
    warm = left.join(F.broadcast(hot), on, "inner")
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return warm.unionByName(cold)


def smallest_hashes(count: float, most: int) -> int:
    """Of `count` rows with 63-bit hashes, a bound below which at least `most` lie, but for a chance of some
    1e-9, and not many more. It never falls to zero: beyond any count the share stays a positive number."""
    want = most + 7 * most**0.5 + 40
    return (1 << 63) - 1 if want >= count else max(1, int((1 << 63) * (want / count)))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string or binary column without a copy; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:  # null slots may have any extent
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offs, np.int64 if large else np.int32, n + 1, col.offset * (8 if large else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each; a longer text is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def rows_text(col: pa.Array) -> list[str]:
    """The column as str, null as empty."""
    return [x or "" for x in col.to_pylist()]


#: A Bloom filter has 16 bits for each id, up to 16 MB whatever the number of ids.
BLOOM_MOST_BITS = 1 << 27


def bloom_filter(ids: DataFrame):
    """A function from a column of long ids to whether the frame's one column of ids may hold them.

    Only the bit array, at most 16 MB, reaches the driver and the executors. It passes over rows that a
    join needn't see; beyond some 10 million ids it passes more and more, and the join does the rest. Null
    ids give false."""
    spark = ids.sparkSession
    ids = ids.toDF("id")
    bits = 1 << 16
    n = ids.count()
    while bits < min(16 * n, BLOOM_MOST_BITS):
        bits *= 2

    def places(col: Column) -> list[Column]:
        h = F.xxhash64(col)
        return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]

    words = ids.where("id is not null").select(F.explode(F.array(*places(F.col("id")))).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def held(p: pa.Array, q: pa.Array) -> pa.Array:
        t = sent.value
        a, b = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (p, q))
        return pa.array(((t[a >> 5] >> (a & 31).astype(np.uint32)) & (t[b >> 5] >> (b & 31).astype(np.uint32)) & 1).astype(bool))

    return lambda col: col.isNotNull() & held(*places(col))
