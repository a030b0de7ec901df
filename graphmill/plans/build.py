"""Building an index: stages over a dict of frames, run provenance, and promotion of the result."""

from __future__ import annotations

import json
import re
import time
import tomllib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill import schema
from graphmill.operators import edges as E
from graphmill.operators import ingest as N
from graphmill.operators import resolve as R
from graphmill.operators import retrieval as S
from graphmill.operators import visibility as V
from graphmill.operators.fulltext import FullText
from graphmill.operators.health import Policy, report
from graphmill.sources import files as W
from graphmill.sources import texts as T
from graphmill.storage import Index, drop_stored, replace, stored
from graphmill.streaming import changes as X

Tables = dict[str, DataFrame]


class Stage(Protocol):
    name: str

    def run(self, tables: Tables) -> Tables: ...


class Step:
    """A stage of a plain function."""

    def __init__(self, name: str, run: Callable[[Tables], Tables]):
        self.name, self.run = name, run


def local_crates(manifest: str) -> set[str]:
    """Crates that a Cargo manifest puts inside the project, as code names them: its own package and library, and
    the dependencies that it has by path, under the names that it gives them, in every kind of dependency table."""
    try:
        m = tomllib.loads(manifest)
    except tomllib.TOMLDecodeError:
        return set()
    table = lambda x: x if isinstance(x, dict) else {}
    names = {table(m.get(t)).get("name") for t in ("package", "lib")}
    owners = [m, table(m.get("workspace")), *map(table, table(m.get("target")).values())]
    for own in owners:
        for kind in ("dependencies", "dev-dependencies", "build-dependencies"):
            names |= {name for name, d in table(own.get(kind)).items() if "path" in table(d)}
    return {n.replace("-", "_") for n in names if isinstance(n, str)}


@dataclass(frozen=True)
class Project:
    """What a project's own files say about its imports."""

    root: str = ""
    go_module: str | None = None
    crates: tuple[str, ...] = ()

    @classmethod
    def of(cls, files: DataFrame, root: str = "") -> Project:
        """From the manifests (path, source) at the root and, for crates, anywhere below."""
        own = {r["path"]: r["source"] or "" for r in files.where(F.col("path").rlike(r"(^|/)(go\.mod|Cargo\.toml)$")).select("path", "source").orderBy("path").toLocalIterator()}
        at = f"{root}/go.mod" if root else "go.mod"
        module = re.search(r"^module\s+(\S+)", own.get(at, ""), re.M)
        crates = {c for p, text in own.items() if p.endswith("Cargo.toml") for c in local_crates(text)}
        return cls(root, module[1] if module else None, tuple(sorted(crates)))


def scan_imports(files: DataFrame) -> DataFrame:
    """Literal includes of C and C++ sources as unresolved imports; ids come from file and place."""
    own = files.where("language in ('c', 'cpp')").select(F.col("id").alias("file_id"), "source")
    got = T.parsed(own, T.c_includes, ["source"], ["file_id"], "position int, raw_import string")
    return schema.conform(got.select(F.abs(F.xxhash64("file_id", "position")).alias("id"), "file_id", "raw_import"), "file_imports")


def scanned(spark, root: str, branch: str, now: int) -> DataFrame:
    """The files table of a source tree; ids come from branch and path."""
    own = W.walk(spark, root)
    return schema.conform(own.select(F.abs(F.xxhash64(F.lit(branch), "path")).alias("id"), "path", F.lit(branch).alias("branch"), "language", "size_bytes", "last_hash", "source", F.lit(now).alias("indexed_at")), "files")


def manifests(spark, root: str) -> DataFrame:
    """(path, source) of the manifests below a source tree."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{go.mod,Cargo.toml}").load(root)
    at = root.rstrip("/").split(":", 1)[-1].strip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + W._quoted("/" + at) + "/", "")
    return raw.select(rel.alias("path"), F.make_valid_utf8(F.expr("cast(content as string)")).alias("source"))


def ingest_occurrences(occurrences: DataFrame, infos: DataFrame, files: DataFrame) -> Tables:
    """Symbols, calls, type uses, imports and relationships of an index's occurrences (file_id, range, symbol,
    symbol_roles, enclosing_range, syntax_kind) and its infos, with targets by symbol string; ids come from symbol
    and place. Relationships need the file_id and relationships of infos."""
    defs = N.definitions(occurrences, infos)
    made = defs.withColumn("id", F.abs(F.xxhash64("file_id", "scip_symbol", "start_line", "start_character")))
    first = stored(N.canonical(made, files))
    main = first.select(F.col("scip_symbol").alias("symbol"), F.col("id").alias("target"), F.col("name").alias("target_name"))
    parents = main.select(F.col("symbol").alias("parent_symbol"), F.col("target").alias("parent_symbol_id"))
    symbols = schema.conform(made.join(parents, "parent_symbol", "left").withColumns({"signature": F.coalesce("signature", F.lit("")), "is_exported": F.lit(True)}), "symbols")
    refs = N.references(occurrences, symbols).join(main, "symbol", "left").where("caller_id is not null")
    shown = F.coalesce("target_name", F.regexp_replace(F.regexp_extract("symbol", r"([^/#.:]+)[#.:]*$", 1), r"\(.*$", ""))
    method = F.when(F.col("target").isNotNull(), "scip_definition").otherwise("external_definition")
    calls = refs.where("kind = 'call'").select(F.abs("point_id").alias("id"), "caller_id", "file_id", F.col("target").alias("callee_id"), shown.alias("callee_name"), F.col("line").alias("call_line"), F.col("character").alias("call_character"), F.lit("direct").alias("call_kind"), method.alias("resolution_method"))
    types = refs.where("kind = 'type'").select(F.abs("point_id").alias("id"), "file_id", F.col("caller_id").alias("symbol_id"), F.col("target").alias("type_id"), shown.alias("type_name"), shown.alias("type_name_bare"), F.lit("other").alias("ref_kind"), F.col("line").alias("ref_line"), F.col("character").alias("ref_character"), method.alias("resolution_method"))
    imports = N.stated_imports(occurrences, first).withColumn("id", F.abs(F.xxhash64("file_id", "raw_import")))
    out = {"symbols": symbols, "symbol_refs": schema.conform(calls, "symbol_refs"), "type_refs": schema.conform(types, "type_refs"), "file_imports": schema.conform(imports, "file_imports")}
    if {"file_id", "relationships"} <= set(infos.columns):
        related = N.related(infos, made, first, files).withColumn("id", F.abs(F.xxhash64("file_id", "own", "symbol", "relationship_type")))
        out["symbol_relationships"] = schema.conform(related, "symbol_relationships")
    return out


def build_sources(index: Index, root: str, branch: str, occurrences: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, units: DataFrame | None = None, clock: Callable[[], float] = time.time, policy: Policy | None = None) -> dict:
    """Build a generation from a source tree: files, includes, the project's manifests, and what `occurrences`
    gives for the files table, if there is an index of compiler facts (occurrences and infos). units (path,
    includes) are those of a compilation database."""
    spark = index.spark
    files = stored(scanned(spark, root, branch, int(clock())))
    tables: Tables = {"files": files, "file_imports": scan_imports(files)}
    if occurrences is not None:
        tables = _with_facts(tables, ingest_occurrences(*occurrences(files), files))
    project = Project.of(manifests(spark, root))
    lists = R.include_lists(units, files) if units is not None else None
    return build(index, tables, branch, policy=policy, clock=clock, stages=[Step("imports", lambda t: ingest_imports(t, project, lists)), *STAGES[1:], Step("search", search_tables)])


def refresh_sources(index: Index, root: str, branch: str, occurrences: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, units: DataFrame | None = None, clock: Callable[[], float] = time.time, policy: Policy | None = None, text: FullText | None = None) -> dict:
    """Bring an index up to a source tree: a build where the branch has none; else an overlay batch of the paths
    whose content differs from what readers see, and of those that are gone, with their symbols, calls, types and
    imports resolved against all files. text is the full-text index of the symbols, which follows. Gives mode
    (build, update or none) and how many paths changed. After a crash at any point the next call does the same again, with
    the same rows and ids, as the batch's number stays free until the index has it."""
    spark = index.spark
    project, now = Project.of(manifests(spark, root)), int(clock())
    if branch not in index.state()["promoted"]:
        row = build_sources(index, root, branch, occurrences, units, clock, policy)
        files = index.raw("files").where((F.col("branch") == branch) & (F.col("generation") == row["generation"]))
        if text is not None and row["status"] == "success":
            text.build(S.documents(V.effective(index.raw("symbols"), files)))
        return {"mode": "build", "changed": files.count(), "status": row["status"]}
    tree = stored(scanned(spark, root, branch, now))
    seen = X.visible(index).where(F.col("branch") == branch)
    changed = stored(W.changes(seen, tree))
    batch = changed.join(tree.select("path", "language", "source", "last_hash"), "path", "left").select("path", "language", "source", "last_hash", (F.col("change") == "deleted").alias("deleted"), F.lit(index.next_batch()).alias("seq"))

    def apply(index: Index, files: DataFrame, number: int) -> None:
        rest = seen.join(changed.select("path"), "path", "left_anti")
        every = schema.conform(rest, "files").drop("layer", "generation").unionByName(schema.conform(files, "files").drop("layer", "generation"))
        t: Tables = {"files": every, "file_imports": scan_imports(files)}
        made = ingest_occurrences(*occurrences(files), files) if occurrences is not None else {}
        lists = R.include_lists(units, every) if units is not None else None
        if made:
            t["file_imports"] = t["file_imports"].unionByName(made["file_imports"])
        out = ingest_imports(t, project, lists)
        if made:
            own = stored(made["symbols"])
            old = V.effective(index.raw("symbols"), rest)
            whole = {"symbols": old.unionByName(schema.conform(own, "symbols")), "files": every, "dirty_files": schema.empty(spark, "dirty_files"), "symbol_relationships": schema.empty(spark, "symbol_relationships")} | {k: v for k, v in made.items() if k not in ("symbols", "file_imports")}
            done = resolve_symbols(whole)
            out |= {"symbols": own} | {k: done[k] for k in ("symbol_refs", "type_refs", "symbol_relationships")}
            if text is not None:
                text.refresh(S.documents(own), V.effective(index.raw("symbols"), seen.join(changed.select("path"), "path", "left_semi")).select("id"))
        for name, df in out.items():
            index.write(name, df, "overlay", number)

    n = X.update_overlay(index, batch, branch, now, apply)
    drop_stored(tree, changed)
    return {"mode": "update" if n else "none", "changed": n}


def _with_facts(tables: Tables, facts: Tables) -> Tables:
    """Tables with those of an index: the imports of its files join those that were scanned."""
    return tables | facts | {"file_imports": tables["file_imports"].unionByName(facts["file_imports"])}


def search_tables(t: Tables) -> Tables:
    """Full-text rows of the symbols."""
    return {"symbols_fts": S.documents(t["symbols"])}


def ingest_imports(t: Tables, project: Project | None = None, include_paths: DataFrame | None = None) -> Tables:
    own = project or Project.of(t["files"])
    return {"file_imports": R.resolve_imports(t["file_imports"], t["files"], own.root, own.go_module, list(own.crates), include_paths)}


def resolve_symbols(t: Tables) -> Tables:
    s, f, d = t["symbols"], t["files"], t["dirty_files"]
    return {"symbol_refs": R.resolve_calls(t["symbol_refs"], s, f, d), "type_refs": R.resolve_types(t["type_refs"], s, f, d), "symbol_relationships": R.resolve_relationships(t["symbol_relationships"], s, f, d)}


def dispatch(t: Tables) -> Tables:
    made = E.virtual_dispatch(t["symbol_refs"], E.overrides(t["symbol_relationships"], t["symbols"]))
    rows = made.withColumns({"id": F.xxhash64("caller_id", "callee_id", "call_line", "call_character"), "resolution_method": F.lit("scip_definition"), "call_kind": F.lit("virtual")})
    return {"symbol_refs": schema.conform(t["symbol_refs"], "symbol_refs").unionByName(schema.conform(rows, "symbol_refs"))}


def reverse(t: Tables) -> Tables:
    return {"reverse_deps": E.reverse_deps(t["file_imports"], t["symbol_refs"], t["symbols"])}


STAGES: list[Stage] = [Step("imports", ingest_imports), Step("symbols", resolve_symbols), Step("dispatch", dispatch), Step("reverse_deps", reverse)]


def run_stages(tables: Tables, stages: list[Stage] | None = None) -> Tables:
    """Apply the stages in order; what each gives is stored, so that later ones don't compute it again."""
    tables = dict(tables)
    for s in STAGES if stages is None else stages:
        tables |= {k: stored(v) for k, v in s.run(tables).items()}
    return tables


def build(index: Index, tables: Tables, branch: str, mode: str = "build", policy: Policy | None = None, clock: Callable[[], float] = time.time, stages: list[Stage] | None = None) -> dict:
    """Build a generation from raw tables, check it, and promote it if it is healthy. A failed run leaves its
    provenance but no data. Gives the run's row."""
    spark = index.spark
    fence = index.acquire(run := str(uuid.uuid4()))
    generation = index.reserve(branch)
    row = {"id": run, "mode": mode, "root_dir": index.root, "branch": branch, "layer": "baseline", "generation": generation, "started_at": int(clock()), "completed_at": None, "status": "running", "fallback_degraded": False, "error": None, "config_json": json.dumps({"profile": (policy or Policy()).profile})}
    try:
        full = {t: schema.empty(spark, t) for t in ("files", "symbols", "symbol_refs", "type_refs", "symbol_relationships", "file_imports", "dirty_files")} | {t: schema.conform(df, t) for t, df in tables.items()}
        done = run_stages(full, stages)
        check = report(done, policy)
        if not check["healthy"]:
            row |= {"status": "rejected", "error": json.dumps([i["code"] for i in check["issues"]])}
        else:
            for t, df in done.items():
                if t in schema.TABLES and "generation" in [f.name for f in schema.struct(t)]:
                    index.write(t, df, "baseline", generation)
            index.check_fence(fence)
            index.promote(branch, generation, {f"run:{branch}": run})
            index.clean_up()
            row["status"] = "success"
    except Exception as x:
        row |= {"status": "failed", "error": f"{type(x).__name__}: {x}"[:500]}
        raise
    finally:
        row["completed_at"] = int(clock())
        index.files.add(f"runs/{generation:012d}-{run}.json", json.dumps(row))
        index.release()
    return row


def runs(index: Index) -> list[dict]:
    """The rows of all runs, in the order of their generations."""
    return [json.loads(index.files.read(f"runs/{n}")) for n in index.files.names("runs")]


def ingest_summary(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """Summaries with the new ones in place of those of the same symbol."""
    return replace(summaries, new, ["symbol_id"])


def new_commits(commits: DataFrame, known: DataFrame) -> DataFrame:
    """Commits of a log (text rows already parsed) that are not known yet."""
    return commits.join(known.select("sha"), "sha", "left_anti")


def known_refs(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """Refs in full, of known commits only."""
    return refs.join(commits.select(F.col("sha").alias("commit_sha")), "commit_sha", "left_semi")
