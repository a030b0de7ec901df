"""Token counts of flat unindexed token files by a separator scan.

A token file is a plain sequence of fixed-width ids in which an end-of-document id closes each document;
nothing tells where documents begin. Files are taken in blocks of fixed size. Each block is searched for the
separator in one numpy comparison, which gives the documents that lie wholly in it, the tokens before its
first separator and those after its last. A prefix scan over the blocks' summaries, in partitions and then
over partitions, stitches the documents that cross blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.llm import bpe
from graphmill.llm.common import bounded_batches, rows_text, stored

BLOCK_TOKENS = 1 << 17
#: Blocks of a file that are scanned one after another; files of more are scanned in groups of so many.
GROUP_BLOCKS = 64


def file_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, payload of flat files below path, each read once and cut where it is read. Spark reads a
    file as one value, up to 2 GB, and raises beyond; longer sequences come as several files in order of name,
    or as blocks."""
    size = width * block_tokens
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.cast("long").alias("block"), F.substring(F.col("content"), k * size + 1, F.lit(size)).alias("payload")))
    return files.select(F.col("path").alias("file"), F.explode(cut).alias("x")).select("file", "x.block", "x.payload")


def scan_block(ids: np.ndarray, separator: int) -> tuple[int, int, np.ndarray]:
    """Tokens before the first separator, tokens after the last, and the lengths of documents from the second
    separator on. Without a separator all tokens are before, and after is -1."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return len(ids), -1, np.zeros(0, np.int64)
    return int(at[0]), int(len(ids) - at[-1] - 1), np.diff(at) - 1


def scan(blocks: DataFrame, separator: int, dtype: str = "<u2", keep_open: bool = True) -> DataFrame:
    """file, ordinal, n_tokens (without the separator) of every document of blocks (file, block, payload).

    Blocks of a file are numbered from 0 and in any order; an empty file has no document; tokens after the
    last separator are a document if keep_open and there are any. Null payloads are empty blocks; a payload
    that is no whole number of ids raises. Only summaries and lengths, not tokens, are shuffled."""
    bounded_batches(blocks.sparkSession)
    width = np.dtype(dtype).itemsize

    def run(batches):
        for b in batches:
            head, tail, inner = [], [], []
            for payload in b.column(2).to_pylist():
                payload = payload or b""
                if len(payload) % width:
                    raise ValueError("a block is no whole number of ids")
                h, t, own = scan_block(np.frombuffer(payload, dtype), separator)
                head.append(h)
                tail.append(t)
                inner.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], names=["file", "block", "head", "tail", "inner"])

    parts = stored(blocks.select("file", F.col("block").cast("long").alias("block"), "payload").mapInArrow(run, "file string, block long, head long, tail long, inner array<long>"))
    # level 1: runs of GROUP_BLOCKS blocks, each one summary as if it were a block
    grouped = parts.withColumn("g", F.floor(F.col("block") / GROUP_BLOCKS))
    closed = F.col("tail") >= 0
    w = Window.partitionBy("file", "g").orderBy("block")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)

    # sums of heads up to and with each block, within its group
    sums = grouped.withColumn("s", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("docs", F.when(closed, F.size("inner") + 1).otherwise(0).cast("long"))
    # at a block with a separator the open document is its tail: remembered as s - tail
    sums = sums.withColumn("mark", F.when(closed, F.col("s") - F.col("tail")))
    last = F.last("mark", True).over(upto)
    inside = sums.select("file", "g", "block", "head", "tail", "inner", "docs", last.alias("before"), (F.coalesce(F.lag("s").over(w), F.lit(0)) - F.coalesce(last, F.lit(0))).alias("open"), F.coalesce(F.sum("docs").over(upto), F.lit(0)).alias("done"))
    ends = (
        sums.groupBy("file", "g")
        .agg(F.max_by("s", "block").alias("s"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("block"))).alias("mark"), F.sum("docs").alias("docs"))
        .select("file", "g", "docs", (F.col("s") - F.coalesce("mark", F.lit(0))).alias("open"), F.col("mark").isNotNull().alias("closed"))
    )
    # level 2: over the groups of a file
    v = Window.partitionBy("file").orderBy("g")
    e = ends.withColumn("t", F.sum(F.when(~F.col("closed"), F.col("open")).otherwise(0)).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("m", F.when(F.col("closed"), F.col("t") - F.col("open")))
    earlier = v.rowsBetween(Window.unboundedPreceding, -1)
    lifts = e.select("file", "g", (F.coalesce(F.lag("t").over(v), F.lit(0)) - F.coalesce(F.last("m", True).over(earlier), F.lit(0))).alias("lift"), F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("skip"))
    placed = inside.join(lifts, ["file", "g"])
    first = F.col("head") + F.col("open") + F.when(F.col("before").isNull(), F.col("lift")).otherwise(0)
    docs = placed.where("tail >= 0").select("file", (F.col("skip") + F.col("done")).alias("from"), F.posexplode(F.concat(F.array(first), F.col("inner"))).alias("pos", "n_tokens")).select("file", (F.col("from") + F.col("pos")).alias("ordinal"), "n_tokens")
    if keep_open:
        rest = e.groupBy("file").agg(F.max_by(F.struct("t"), "g").alias("z"), F.max_by("m", F.when(F.col("m").isNotNull(), F.col("g"))).alias("m"), F.sum("docs").alias("docs"))
        rest = rest.select("file", F.col("docs").alias("ordinal"), (F.col("z.t") - F.coalesce("m", F.lit(0))).alias("n_tokens")).where("n_tokens > 0")
        docs = docs.unionByName(rest)
    return docs


def two_bytes(ids: np.ndarray) -> bytes:
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError(f"id {ids.max()} does not fit two bytes")
    return ids.astype("<u2").tobytes()


def token_blocks(docs: DataFrame, vocabulary: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Flat token files of documents, one for each partition, as (blocks, owners).

    blocks: file, block, payload (ids as little-endian uint16, each document followed by the separator);
    owners: file, ordinal, id. Separators in a text are ids of its own and would close it, so an added
    token's string is encoded as ordinary text. Blocks are cut wherever their size is reached. A third of
    all rows in one partition is no trouble: files are as long as they are. Ids and the separator must fit two
    bytes: others raise."""
    spark = docs.sparkSession
    two_bytes(np.array([separator]))
    bounded_batches(spark)
    load = bpe.loader(spark, vocabulary)
    rows = docs.select(F.col(id_col).cast("long"), text_col)

    def run(batches):
        from pyspark import TaskContext

        coder = load()
        name = f"part-{TaskContext.get().partitionId():06d}"
        end = np.uint16(separator).tobytes()
        held, size, block, ordinal = [], 0, 0, 0
        step = 2 * block_tokens
        for b in batches:
            ids = [two_bytes(np.frombuffer(x, "<u4")) + end for x in coder.encode_ordinary_batch(rows_text(b.column(1)))]
            yield _rows([name], [ordinal], [None], [b.column(0).to_pylist()])
            ordinal += len(ids)
            held += ids
            size += sum(map(len, ids))
            if size >= step:
                flat = b"".join(held)
                cuts = range(0, len(flat) - step + 1, step)
                for i in cuts:
                    yield _rows([name], [block], [flat[i : i + step]], [None])
                    block += 1
                held = [flat[len(cuts) * step :]]
                size = len(held[0])
        if size:
            yield _rows([name], [block], [b"".join(held)], [None])

    both = stored(rows.mapInArrow(run, "file string, at long, payload binary, ids array<long>"))
    blocks = both.where("payload is not null").select("file", F.col("at").alias("block"), "payload")
    owners = both.where("ids is not null").select("file", "at", F.posexplode("ids").alias("pos", "id")).select("file", (F.col("at") + F.col("pos")).alias("ordinal"), "id")
    return blocks, owners


def _rows(file, at, payload, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(payload, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["file", "at", "payload", "ids"])


def document_tokens(docs: DataFrame, vocabulary: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens per document row, counted in its flat token file. Null and empty texts have 0 tokens;
    very long texts cross blocks; null ids stay null; repeated rows give a row each; an empty table gives an
    empty result; other columns are not read."""
    blocks, owners = token_blocks(docs, vocabulary, separator, id_col, text_col)
    counts = scan(blocks, separator, "<u2", keep_open=False)
    return owners.join(counts, ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
