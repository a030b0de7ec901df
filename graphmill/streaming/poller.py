"""Polling a source tree: listings of paths as a stream, what changed between them as keyed state with timers, and
updates with retries and a rebuild after a quiet time."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from graphmill.sources import files as W
from graphmill.storage import Files

LISTING = "path string, modified long, last_hash string"
CHANGES = "path string, change string"
log = logging.getLogger(__name__)


class PathStates(StatefulProcessor):
    """Changes of each path from its listings (path, modified, last_hash).

    State is the last modification time and hash. A path without state is created; one whose time differs is
    changed, but for the first listing of a path that the index had (initial state, of its hash), which is changed
    if the hash is another. Each listing sets the path's timer anew; a path that no listing names for `absent_ms` is deleted when it runs out."""

    def __init__(self, absent_ms: int) -> None:
        self.absent_ms = absent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "modified long, last_hash string")

    def _wait(self, now: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now + self.absent_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.last.update((None, initialState["last_hash"]))
        self._wait(timerValues.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kind = None
        for r in sorted(rows, key=lambda r: r["modified"]):
            if not self.last.exists():
                kind = kind or "created"
            else:
                modified, digest = self.last.get()
                if r["last_hash"] != digest if modified is None else r["modified"] != modified:
                    kind = kind or "changed"
            self.last.update((r["modified"], r["last_hash"]))
        self._wait(timerValues.getCurrentProcessingTimeInMs())
        if kind:
            yield Row(path=key[0], change=kind)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        yield Row(path=key[0], change="deleted")

    def close(self) -> None:
        pass


def polled(listings: DataFrame, absent_ms: int = 15_000, known: DataFrame | None = None) -> DataFrame:
    """A stream of listings as changes (path, change): created, changed or deleted. known: what the index has
    (path, last_hash), with which the first batch is compared. Paths that repeat their state give nothing."""
    start = known.select("path", "last_hash").groupBy("path") if known is not None else None
    return listings.select("path", "modified", "last_hash").groupBy("path").transformWithState(PathStates(absent_ms), CHANGES, "update", "ProcessingTime", start)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, last_hash) of a source tree now."""
    return W.walk(spark, root).select("path", F.unix_millis("modified").alias("modified"), "last_hash")


class Poller:
    """Keeps an index up to date with a tree: update(changed paths) for each batch, rebuild() after a quiet time.

    The paths of an update that fails are kept as a table, and go to the next batch's update as well. rebuild() is
    called when `quiet_ms` have passed since the last change; if it fails, it is due again after as long. What is due
    lies in small files below `path`, numbered by the stream's batches, so a restart goes on from there, and a batch
    that is delivered again is not applied twice. Listings go through the folder `path`/listings."""

    def __init__(self, spark: SparkSession, path: str, update: Callable[[DataFrame], object], rebuild: Callable[[], object] | None = None, quiet_ms: int = 10_000, absent_ms: int = 15_000, known: Callable[[], DataFrame] | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.update, self.rebuild, self.quiet_ms, self.absent_ms, self.known, self.clock = update, rebuild, quiet_ms, absent_ms, known, clock

    def state(self) -> dict:
        for name in reversed(self.files.names("state")):
            text = self.files.read(f"state/{name}")
            if text:
                return json.loads(text) | {"number": int(name.removesuffix(".json"))}
        return {"batch": -1, "retry": None, "pending": 0, "last": 0, "number": 0}

    def _save(self, state: dict) -> None:
        n = state["number"] + 1
        if not self.files.add(f"state/{n:09d}.json", json.dumps({k: v for k, v in state.items() if k != "number"})):
            raise RuntimeError("another poller is at work")
        for old in self.files.names("state")[:-2]:
            self.files.delete(f"state/{old}")

    def step(self, changes: DataFrame, batch: int) -> None:
        """One batch of the stream: update with its paths and those to retry."""
        state = self.state()
        if batch <= state["batch"]:
            return
        paths = changes.select("path")
        if state["retry"] is not None:
            paths = paths.unionByName(self.spark.read.schema("path string").parquet(f"{self.path}/retry/batch={state['retry']}"))
        at = f"{self.path}/retry/batch={batch}"
        paths.distinct().write.mode("overwrite").parquet(at)  # computed once, and kept if the update fails
        todo = self.spark.read.schema("path string").parquet(at)
        n = todo.count()
        retry = None
        if n:
            try:
                self.update(todo)
            except Exception:
                log.exception("update of %d paths failed", n)
                retry = batch
        state |= {"batch": batch, "retry": retry}
        if n:
            state |= {"pending": state["pending"] + n, "last": int(self.clock() * 1000)}
        self._save(state)
        for old in self.files.names("retry"):
            if old != f"batch={retry}":
                self.files.delete(f"retry/{old}")
        self.rest()

    def rest(self) -> bool:
        """Rebuild if changes are pending and the quiet time is over; gives whether it was done."""
        state, now = self.state(), int(self.clock() * 1000)
        if self.rebuild is None or not state["pending"] or now - state["last"] < self.quiet_ms:
            return False
        try:
            self.rebuild()
        except Exception:
            log.exception("rebuild failed")
            self._save(state | {"last": now})
            return False
        self._save(state | {"pending": 0})
        return True

    def list(self, root: str) -> None:
        """Add a listing of the tree to the stream's folder."""
        listing(self.spark, root).write.mode("append").parquet(f"{self.path}/listings")

    def start(self, interval: str | None = None) -> StreamingQuery:
        """The stream over the listings; without an interval, one batch takes what there is, and timers that have
        run out (with timers, batches without data follow one another for ever, so nothing else would end). The
        state store is RocksDB's, which timers need."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        self.files.fs.mkdirs(self.files.path("listings"))
        listings = self.spark.readStream.schema(LISTING).parquet(f"{self.path}/listings")
        known = self.known() if self.known else None
        writer = polled(listings, self.absent_ms, known).writeStream.outputMode("update").foreachBatch(self.step).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(once=True)).start()

    def poll(self, root: str) -> None:
        """List the tree, apply what changed, and rebuild if that is due."""
        self.list(root)
        query = self.start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        self.rest()
