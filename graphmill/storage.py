"""Materialising frames in the shared folder, and the generation store of an index.

Layout of an index: <root>/tables/<table>/layer=<l>/generation=<g>/*.parquet. A generation's folder is written
once. The state (promoted generations, dirty paths, meta data) is one small file for each change,
<root>/state/<number>.json: readers take the one of the highest number, and a writer adds the next one by a
rename, which fails where another writer was first. So a reader, or a crash at any point, sees the old state or
the new one. Overlay batches are folders of their own (generation 0 and up of the overlay layer), with a table of
their dirty paths, <root>/dirty/batch=<n>; the state names the batches that count, and the last batch of each
stream, so that one that is delivered again is recognised. What a crash leaves has a number that no state names, and
the next batch takes that number and overwrites it.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill import schema


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Only a local session, as in tests, may leave it unset: it
    then has a folder in its warehouse. On a cluster that would be no shared folder, so it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return root.rstrip("/")


def scratch(spark: SparkSession, suffix: str = "") -> str:
    """A new path below the shared folder, deleted at the end of the application at the latest."""
    path = f"{checkpoint_root(spark)}/graphmill-{uuid.uuid4().hex}{suffix}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: How Spark is told of the sizes that it can't see: rows take several times the bytes of their files and shuffled blocks.
SIZES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.sources.fileCompressionFactor": "8"}


def small_tasks(spark: SparkSession) -> None:
    """Let Spark join shuffle partitions up to 8 MB only, not 64, and take tables for 8 times their files, so that it doesn't
    broadcast those whose rows fill a task's memory. A session that has set a value keeps it."""
    for key, value in SIZES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*frames: DataFrame | None) -> None:
    """Delete the files behind frames that stored() returned, once nothing will read them any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: States that stay beside the newest, for readers that have just listed them.
KEPT_STATES = 5


class Files:
    """Small files of an index through Hadoop's file system, so that any store works."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]

    def add(self, name: str, text: str) -> bool:
        """Put a new file in place by a rename, whole or not at all; false if there is one of the name."""
        if self.exists(name):
            return False
        tmp = self.path(f"tmp-{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        done = not self.exists(name) and self.fs.rename(tmp, self.path(name))
        if not done:
            self.fs.delete(tmp, False)
        return done

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)

    def bytes(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []


class Index:
    """A stored index. Layered tables are written by generation, promoted by one pointer for each branch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("state") if n.endswith(".json"))

    def state(self) -> dict:
        """The state of the highest number; `number` is that number, 0 for an index without any."""
        for n in reversed(self._numbers()):
            text = self.files.read(f"state/{n:012d}.json")
            if text:
                return json.loads(text) | {"number": n}
        return {"version": schema.VERSION, "promoted": {}, "overlays": [], "streams": {}, "meta": {}, "sequence": 0, "batches": 0, "number": 0}

    def _save(self, state: dict) -> None:
        """Add the state that follows `state`; raises where another writer has added one since it was read."""
        n = state["number"] + 1
        if not self.files.add(f"state/{n:012d}.json", json.dumps({k: v for k, v in state.items() if k != "number"}, sort_keys=True)):
            raise RuntimeError("another writer changed the index")
        state["number"] = n
        for old in self._numbers()[:-KEPT_STATES]:
            self.files.delete(f"state/{old:012d}.json")

    def acquire(self, owner: str) -> int:
        """Claim the writer's lease and its fencing number; fails while another owner holds it."""
        if not self.files.add("writer.lock", owner) and self.files.read("writer.lock") != owner:
            raise RuntimeError("another writer holds the index")
        state = self.state()
        state["writer"] = state.get("writer", 0) + 1
        self._save(state)
        return state["writer"]

    def check_fence(self, number: int) -> None:
        if self.state().get("writer", 0) != number:
            raise RuntimeError("the writer's lease was taken over")

    def release(self) -> None:
        self.files.delete("writer.lock")

    def reserve(self, branch: str) -> int:
        """A generation above every one promoted, stored or reserved before."""
        state = self.state()
        stored_ = [int(g.partition("=")[2]) for t in self.files.names("tables") for g in self.files.names(f"tables/{t}/layer=baseline") if g.startswith("generation=")]
        state["sequence"] = max([0, state["sequence"], *state["promoted"].values(), *stored_]) + 1
        self._save(state)
        return state["sequence"]

    def write(self, table: str, df: DataFrame, layer: str = "baseline", generation: int = 0) -> None:
        own = schema.conform(df.withColumns({"layer": F.lit(layer), "generation": F.lit(generation)}), table).drop("layer", "generation")
        own.write.mode("overwrite").parquet(f"{self.root}/tables/{table}/layer={layer}/generation={generation}")

    def raw(self, table: str) -> DataFrame:
        """All baseline generations and the overlay batches that the state names, or an empty frame."""
        if not self.files.exists(f"tables/{table}"):
            return schema.empty(self.spark, table)
        want = schema.struct(table)
        df = self.spark.read.schema(want).option("basePath", f"{self.root}/tables/{table}").parquet(f"{self.root}/tables/{table}")
        own = sorted({n for n, _ in self.state()["overlays"]})
        # by partition columns, so files of other batches, which may be overwritten, are never opened
        return df.where((F.col("layer") != "overlay") | (F.col("generation").isin(own) if own else F.lit(False))).select(*[f.name for f in want])

    def promote(self, branch: str, generation: int, meta: dict | None = None) -> bool:
        """Move a branch to a generation, clear its dirty paths and publish meta data; only ever forward."""
        state = self.state()
        if generation <= state["promoted"].get(branch, -1):
            return False
        state["promoted"][branch] = generation
        state["overlays"] = [[n, b] for n, b in state["overlays"] if b != branch]
        state["meta"] |= meta or {}
        self._save(state)
        return True

    def mark_dirty(self, paths: DataFrame | list[str], branch: str, now: int, batch: int = 0, stream: tuple[str, int] | None = None) -> None:
        """The paths' overlay rows are those of the batch, from now on. The paths are a table of the batch; a state
        has one number for each batch since the last promotion. stream: name and batch number of the stream that delivered them."""
        rows = paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")
        rows.select("path", F.lit(branch).alias("branch"), F.lit(now).cast("long").alias("dirty_since")).write.mode("overwrite").parquet(f"{self.root}/dirty/batch={batch}")
        self._advance(branch, batch, stream)

    def _advance(self, branch: str, batch: int | None, stream: tuple[str, int] | None) -> None:
        state = self.state()
        if batch is not None:
            state["overlays"] = [x for x in state["overlays"] if x != [batch, branch]] + [[batch, branch]]
            state["batches"] = max(state["batches"], batch)
        if stream:
            state["streams"][stream[0]] = stream[1]
        self._save(state)

    def delivered(self, stream: tuple[str, int] | None) -> bool:
        """Whether this batch of a stream is in the index already."""
        return stream is not None and self.state()["streams"].get(stream[0], -1) >= stream[1]

    def next_batch(self) -> int:
        """The number of the next overlay batch: the same until a state has that batch."""
        return self.state()["batches"] + 1

    def baseline_generations(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.state()["promoted"].items()), schema.struct("baseline_generations"))

    def dirty_files(self) -> DataFrame:
        """(path, branch, dirty_since, overlay_gen): a path counts from its first batch, its rows are those of its last."""
        own = sorted({n for n, _ in self.state()["overlays"]})
        want = schema.struct("dirty_files")
        if not own:
            return self.spark.createDataFrame([], want)
        rows = self.spark.read.schema("path string, branch string, dirty_since long, batch int").parquet(f"{self.root}/dirty").where(F.col("batch").isin(own))
        return rows.groupBy("path", "branch").agg(F.min("dirty_since").alias("dirty_since"), F.max("batch").cast("long").alias("overlay_gen"))

    def clean_up(self, keep: set[int] | None = None) -> list[str]:
        """Delete generations that no branch has promoted, but those to keep; gives what was deleted."""
        state = self.state()
        live = {*state["promoted"].values(), *(keep or set())}
        used = {n for n, _ in state["overlays"]}
        gone = []
        for t in self.files.names("tables"):
            for g in self.files.names(f"tables/{t}/layer=baseline"):
                if g.startswith("generation=") and int(g.partition("=")[2]) not in live:
                    self.files.delete(f"tables/{t}/layer=baseline/{g}")
                    gone.append(f"{t}/{g}")
            for g in self.files.names(f"tables/{t}/layer=overlay"):
                if g.startswith("generation=") and int(g.partition("=")[2]) not in used:
                    self.files.delete(f"tables/{t}/layer=overlay/{g}")
                    gone.append(f"{t}/overlay/{g}")
        for g in self.files.names("dirty"):
            if g.startswith("batch=") and int(g.partition("=")[2]) not in used:
                self.files.delete(f"dirty/{g}")
        return gone

    def freshness(self, now: int | None = None) -> dict:
        """source (baseline, or mixed with dirty paths), age of the oldest dirty path, their number."""
        row = self.dirty_files().agg(F.count("*"), F.min("dirty_since")).first()
        now = int(time.time()) if now is None else now
        return {"source": "mixed" if row[0] else "baseline", "age_seconds": now - row[1] if row[0] else 0, "dirty_files": row[0]}


def open_index(spark: SparkSession, root: str) -> Index:
    """An index for reading; its version and tables must be current."""
    index = Index(spark, root)
    state = index.state()
    found = {t: index.raw(t).schema for t in index.files.names("tables")}
    status = schema.inspect(found | {t: schema.struct(t) for t in schema.TABLES if t not in found}, state["version"] if state["number"] else None)
    if status != "current":
        raise RuntimeError(f"index is {status}")
    return index


def replace(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: new rows take the place of existing ones of the same key."""
    return existing.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def ignore(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert only rows whose key is not there; the first of repeated new rows by all columns stays."""
    first = new.groupBy(*key).agg(F.min(F.struct(*[c for c in new.columns if c not in key])).alias("_v")).select(*key, "_v.*") if len(key) < len(new.columns) else new.distinct()
    return existing.unionByName(first.select(*existing.columns).join(existing.select(*key), key, "left_anti").select(*existing.columns))
