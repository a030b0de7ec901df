"""A stored positional full-text index: build, refresh, query and merge are steps of their own.

Layout below the index's path:
  postings/part=<p>/bucket=<b>/  (term, key, positions, len): sorted by term within a file. A term's bucket is a hash of it,
                                 and its postings lie in a file of that bucket for each task that wrote the part, so
                                 that a frequent term is neither one task's work nor one file
  documents/part=<p>/            (key, len): every document, those without words too
  dead/part=<p>/                 (key, len): documents that counted before and whose postings in earlier parts don't any more
  state/<n>.json                 the parts in order, and the number of documents and words that count

A build or a refresh writes one part, which counts from the moment the next state is in place; a merge puts parts
together as one without their dead rows. Postings are written where they are made or read: as rows they take several
times the bytes of the texts, and their files about as many, so a shuffle would be most of a build. What a crash leaves behind is in no state, and clean_up() deletes it. A
query reads the buckets of its terms only (part and bucket are partition columns, term is pushed down), and no
other table: corpus numbers are in the state, a document's length stands in each of its postings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators.retrieval import bm25_score, query_tokens, tokens
from graphmill.storage import Files

KEPT_STATES = 3
POSTINGS = "term string, key long, positions array<int>, len int, part int, bucket int"
#: The bucket that holds a row for each document, of which the documents table is made.
DOCUMENTS = -1
#: Bytes of one Arrow batch of words.
BATCH_BYTES = 32 << 20
#: Bytes of files that a writing task reads at most, if they can be cut: as rows some 20 times as many, sorted in memory.
SPLIT_BYTES = 16 << 20
#: A merge that would write more files than this shuffles its rows, so that a bucket has fewer and larger ones.
MOST_FILES = 20_000
#: Dead documents up to this many are broadcast to a merge, some 100 MB; with more, postings and they are joined by a shuffle.
BROADCAST_DEAD = 2_000_000


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, key, positions, len) of (key, words): a row for each term of a document, and one of the empty term for itself."""
    for b in batches:
        if not len(b):
            continue
        keys, lists = b.column(0).to_numpy(), b.column(1)
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = lists.flatten().dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy()
        doc = np.repeat(np.arange(len(b)), np.diff(at))
        pos = np.arange(len(code)) - at[doc]
        full = code != terms.index("").as_py()  # the gaps between columns are no words
        doc, code, pos = doc[full], code[full].astype(np.int64), pos[full].astype(np.int32)
        size = np.bincount(doc, minlength=len(b)).astype(np.int32)
        group = doc * len(terms) + code
        order = np.argsort(group, kind="stable")  # so positions stay ascending
        group, pos = group[order], pos[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        of, term = group[first] // len(terms), terms.take(pa.array(group[first] % len(terms)))
        ends = np.append(first, len(pos)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([term.cast(pa.string()), pa.array(keys[of]), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos)), pa.array(size[of])], names=["term", "key", "positions", "len"])
        none = pa.ListArray.from_arrays(pa.array(np.zeros(len(b) + 1, np.int32)), pa.array([], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([""] * len(b)), pa.array(keys), none, pa.array(size)], names=["term", "key", "positions", "len"])


class FullText:
    """An index over `columns` of documents with unique long ids `key`.

    buckets: how many a part's terms are spread over; a query reads one for each of its terms. slices: pieces of
    a bucket, by a hash of the document, at least, where a merge gathers many small files. A corpus of 100 TB wants
    some thousands of buckets, so that one holds some GB."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], key: str = "id", buckets: int = 64, slices: int = 4):
        self.spark, self.path, self.columns, self.key = spark, path.rstrip("/"), list(columns), key
        self.buckets, self.slices = buckets, slices
        self.files = Files(spark, self.path)

    # --- state

    def state(self) -> dict:
        for name in reversed(self.files.names("state")):
            text = self.files.read(f"state/{name}")
            if text:
                own = json.loads(text) | {"number": int(name.removesuffix(".json"))}
                if (own["columns"], own["key"]) != (self.columns, self.key):
                    raise ValueError(f"the index is over {own['key']} and {own['columns']}")
                self.buckets = own["buckets"]
                return own
        return {"parts": [], "documents": 0, "words": 0, "dead": 0, "next": 1, "number": 0}

    def _save(self, state: dict, **changes) -> None:
        new = state | changes | {"columns": self.columns, "key": self.key, "buckets": self.buckets}
        n = new.pop("number") + 1
        if not self.files.add(f"state/{n:09d}.json", json.dumps(new, sort_keys=True)):
            raise RuntimeError("another writer changed the full-text index")

    def clean_up(self) -> None:
        """Delete old states, and parts that no state names that is left. For a time without writers."""
        names = self.files.names("state")
        for old in names[:-KEPT_STATES]:
            self.files.delete(f"state/{old}")
        live = {p for n in names[-KEPT_STATES:] for p in json.loads(self.files.read(f"state/{n}"))["parts"]}
        for table in ("postings", "documents", "dead"):
            for own in self.files.names(table):
                if own.startswith("part=") and int(own.removeprefix("part=")) not in live:
                    self.files.delete(f"{table}/{own}")

    # --- writing

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _put(self, df: DataFrame, table: str, part: int) -> None:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("bucket") if table == "postings" else writer).parquet(f"{self.path}/{table}/part={part}")

    @contextmanager
    def _small_splits(self) -> Iterator[None]:
        """Files are read in pieces of SPLIT_BYTES at most in here."""
        key = "spark.sql.files.maxPartitionBytes"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, str(SPLIT_BYTES))
        try:
            yield
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    def _write_part(self, docs: DataFrame, part: int) -> tuple[int, int]:
        """Write the postings and documents of docs; gives the numbers of documents and words. Texts are cut into words
        once. A document's words are put together where it is read, and written from there: nothing is shuffled, and each task
        writes a file for each bucket."""
        gap = F.array(F.lit(""))  # so that no phrase reaches from one column into the next
        words = F.concat(*[x for c in self.columns for x in (tokens(F.coalesce(c, F.lit(""))), gap)])
        own = docs.select(F.col(self.key).cast("long").alias("key"), words.alias("words")).where("key is not null")
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        held = own.mapInArrow(_postings, "term string, key long, positions array<int>, len int")
        # a document itself is the row of the empty term, in a bucket of its own
        held = held.select(F.when(F.col("term") == "", DOCUMENTS).otherwise(self._bucket(F.col("term"))).alias("bucket"), "term", "key", "positions", "len")
        with self._small_splits():
            self._put_postings(held, part)
        mine = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").where((F.col("part") == part) & (F.col("bucket") == DOCUMENTS))
        self._put(mine.select("key", "len"), "documents", part)
        row = self.table("documents", [part]).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        return row[0], row[1]

    def _put_postings(self, rows: DataFrame, part: int) -> None:
        self._put(rows.sortWithinPartitions("bucket", "term", "key").select("bucket", "term", "key", "positions", "len"), "postings", part)

    def build(self, docs: DataFrame) -> None:
        """Index docs as the only part. A null text has no words; a null id is not indexed; ids are unique."""
        state = self.state()
        n, words = self._write_part(docs, state["next"])
        self._save(state, parts=[state["next"]], documents=n, words=words, dead=0, next=state["next"] + 1)

    def refresh(self, current: DataFrame, gone: DataFrame | None = None) -> None:
        """A new part with the documents of current, in place of what was indexed under their ids, and without
        those of gone (key)."""
        state = self.state()
        part = state["next"]
        n, words = self._write_part(current, part)
        ids = current.select(F.col(self.key).cast("long").alias("key"))
        if gone is not None:
            ids = ids.unionByName(gone.select(F.col(self.key).cast("long").alias("key")))
        before = self._live(self.table("documents", state["parts"]), state).join(ids, "key", "left_semi")
        self._put(before.select("key", "len"), "dead", part)
        lost = self.spark.read.schema("key long, len int").parquet(f"{self.path}/dead/part={part}").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        self._save(state, parts=[*state["parts"], part], documents=state["documents"] + n - lost[0], words=state["words"] + words - lost[1], dead=state["dead"] + 1, next=part + 1)

    def merge(self, last: int | None = None) -> None:
        """Put the newest `last` parts, or all, together as one, without rows that are dead."""
        state = self.state()
        parts = state["parts"]
        first = 0 if last is None else max(0, len(parts) - last)
        own, part = parts[first:], state["next"]
        if len(own) < 2 and not (own and state["dead"] and first == 0):
            return
        self._put(self._live(self.table("documents", own), state).select("key", "len"), "documents", part)
        few = self.table("dead", parts).count() <= BROADCAST_DEAD
        rows = self._live(self.table("postings", own), state, few)
        if sum(self.files.bytes(f"postings/part={p}") for p in own) / SPLIT_BYTES * self.buckets > MOST_FILES:
            rows = rows.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(self.slices))).hint("rebalance", F.col("bucket"), F.col("slice"))
        with self._small_splits():
            self._put_postings(rows, part)
        if first:  # the dead of these parts may lie in earlier ones
            self._put(self.table("dead", own).select("key").distinct(), "dead", part)
        self._save(state, parts=[*parts[:first], part], dead=1 if first else 0, next=part + 1)

    # --- reading

    def table(self, name: str, parts: list[int]) -> DataFrame:
        """(part, ...) of a table's parts; empty where there are none."""
        schema = {"postings": POSTINGS, "documents": "key long, len int, part int", "dead": "key long, part int"}[name]
        have = {int(x.removeprefix("part=")) for x in self.files.names(name) if x.startswith("part=")} & set(parts)
        if not have:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("part").isin(sorted(have)))
        return rows.where(F.col("bucket") != DOCUMENTS) if name == "postings" else rows

    def _live(self, rows: DataFrame, state: dict, few: bool = False) -> DataFrame:
        """rows (part, key, ...) without those that a later part has declared dead; few: the dead may be broadcast."""
        if not state["dead"]:
            return rows
        order = {p: k for k, p in enumerate(state["parts"])}
        place = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), c)
        dead = self.table("dead", state["parts"]).groupBy("key").agg(F.max(place(F.col("part"))).alias("until"))
        return rows.join(F.broadcast(dead) if few else dead, "key", "left").where(F.col("until").isNull() | (F.col("until") <= place(F.col("part")))).drop("until")

    def matches(self, query: str) -> DataFrame:
        """(key, f, len): the documents that have the query as a phrase, how often, and their length."""
        state, want = self.state(), query_tokens(query)
        hits = None
        buckets = self.spark.range(1).select(*[self._bucket(F.lit(t)) for t in want]).first()  # known, so that they prune
        for k, term in enumerate(want):
            own = self.table("postings", state["parts"]).where((F.col("bucket") == buckets[k]) & (F.col("term") == term))
            at = F.transform("positions", lambda p: p - k).alias(f"p{k}")
            if hits is None:
                hits = self._live(own, state).select("key", "len", at)
            else:
                hits = hits.join(self._live(own, state).select("key", at), "key")
        if hits is None:
            return self.table("documents", []).select("key", F.lit(0).alias("f"), "len")
        places = F.col("p0")
        for k in range(1, len(want)):
            places = F.array_intersect(places, F.col(f"p{k}"))
        return hits.select("key", F.size(places).alias("f"), "len").where("f > 0")

    def search(self, query: str, limit: int | None = 20, within: DataFrame | None = None) -> DataFrame:
        """(key, score) as bm25() gives them for the documents that count now: the query as one phrase, scores
        negative, best first, ties by key. within: ids (key) to which the results are limited; the corpus numbers,
        and so the scores, stay those of the whole index."""
        state, found = self.state(), self.matches(query)
        df = found.agg(F.count("len").alias("df"))  # never null; so it needs the columns of found, and their shuffle is made once
        rows = found.crossJoin(F.broadcast(df))  # one row
        if within is not None:
            rows = rows.join(within.select(F.col(self.key).cast("long").alias("key")).distinct(), "key", "left_semi")
        n, avg = F.lit(state["documents"]), F.lit(state["words"] / max(state["documents"], 1))
        out = rows.select(F.col("key").alias(self.key), bm25_score(n, F.col("df"), F.col("f"), F.col("len"), avg).alias("score"))
        return out.orderBy("score", self.key).limit(limit) if limit else out
