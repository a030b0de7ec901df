"""The tools over an effective index: each takes arguments and gives a JSON-ready dict with its freshness."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.columns import line_slice
from graphmill.operators import commits as C
from graphmill.operators import edges as E
from graphmill.operators import graph as G
from graphmill.operators import lookups as L
from graphmill.operators import retrieval as R
from graphmill.operators.fulltext import FullText

LINES = ("line", "start_line", "end_line", "call_line", "ref_line", "selection_line", "start_character", "end_character", "call_character")


def shown(df: DataFrame, limit: int = L.MOST_ROWS) -> list[dict]:
    """Rows for readers: coordinates one-based, layers left out."""
    own = [F.col(c) + 1 if c in LINES else F.col(c) for c in df.columns if c not in ("layer", "generation", "source")]
    names = [c for c in df.columns if c not in ("layer", "generation", "source")]
    return [r.asDict(recursive=True) for r in df.select(*[c.alias(n) for c, n in zip(own, names)]).limit(limit).collect()]


@dataclass
class Engine:
    """Effective tables by name, vectors if there are any, the query embedder, and the stored full-text index of
    the symbols, without which a search scans them."""

    tables: dict[str, DataFrame]
    freshness: Callable[[], dict] = lambda: {"source": "baseline", "age_seconds": 0, "dirty_files": 0}
    vectors: DataFrame | None = None
    commit_vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    text: FullText | None = None
    observers: list[Callable[[dict], None]] = field(default_factory=list)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def call_edges(self) -> DataFrame:
        return self.symbol_refs.where("callee_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.col("call_line").alias("line"), F.col("resolution_method").alias("method"))

    def import_edges(self) -> DataFrame:
        return self.file_imports.where("resolved_id is not null").select(F.col("file_id").alias("src"), F.col("resolved_id").alias("dst"), F.lit(None).cast("int").alias("line"), F.col("resolution_method").alias("method"))

    def inheritance_edges(self) -> DataFrame:
        own = self.symbol_relationships.where("target_symbol_id is not null and relationship_type in ('extends', 'implements')")
        return own.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), "line", F.col("resolution_method").alias("method"))

    def type_edges(self) -> DataFrame:
        return self.type_refs.where("type_id is not null").select(F.col("symbol_id").alias("src"), F.col("type_id").alias("dst"), F.col("ref_line").alias("line"), F.col("resolution_method").alias("method"))

    def one_symbol(self, name: str, **filters) -> dict:
        """The only symbol of a name, else an error with the candidates."""
        found = L.symbols_by_name(self.symbols, self.files, name, limit=20, **filters).select("id", "name", "kind", "file_path", "start_line", "end_line", "file_id").collect()
        if len(found) != 1:
            raise LookupError(json.dumps({"error": "missing" if not found else "ambiguous", "name": name, "candidates": [r.asDict() for r in found]}))
        return found[0].asDict()


def lookup(e: Engine, symbol: str | None = None, file: str | None = None, match: str = "exact", mode: str = "exact", limit: int = 20, **filters) -> dict:
    if file is not None:
        return {"files": shown(L.files_by_prefix(e.files, file, limit=limit))}
    if not symbol:
        return {"symbols": shown(L.list_symbols(e.symbols, e.files, limit, **filters))}
    exact = L.symbols_by_name(e.symbols, e.files, symbol, match, limit, **filters)
    out = {"symbols": shown(exact)}
    if mode in ("semantic", "fused") and e.vectors is not None and e.embed:
        own = e.vectors.join(L.with_context(e.symbols, e.files).where(L.symbol_filter(**filters)).select("id"), "id", "left_semi")
        near = R.nearest(own, e.embed(symbol), limit=limit)
        ranked = L.with_context(e.symbols, e.files).join(near, "id")
        found = shown(ranked.orderBy("distance", "id"))
        first, second = (found, out["symbols"]) if mode == "semantic" else (out["symbols"], found)
        seen = {r["id"] for r in first}
        out["symbols"] = (first + [r for r in second if r["id"] not in seen])[:limit]
    if match == "exact" and not {"path_prefix", "language"} & set(filters) and "external_symbols" in e.tables:
        out["external"] = shown(L.external_by_name(e.external_symbols, symbol))
    return out


def search(e: Engine, query: str, mode: str = "structural", limit: int = 20, **filters) -> dict:
    began = time.time()
    context = L.with_context(e.symbols, e.files).where(L.symbol_filter(**filters))
    docs = R.documents(context)
    vectors = e.vectors.join(context.select("id"), "id", "left_semi") if e.vectors is not None else None
    found, used = R.search(docs, vectors, query, e.embed(query) if e.embed and vectors is not None and mode != "structural" else None, mode, limit, e.text)
    rows = shown(context.join(found, "id").orderBy(F.desc("score") if used == "fused" else F.col("score"), "id"))
    out = {"results": rows, "mode_used": used}
    for o in e.observers:
        o({"query": query, "mode_used": used, "results": len(rows), "seconds": time.time() - began})
    return out


def snippet(e: Engine, path: str | None = None, start_line: int | None = None, end_line: int | None = None, symbol: str | None = None, branch: str | None = None) -> dict:
    if symbol is not None:
        s = e.one_symbol(symbol, branch=branch)
        path, start_line, end_line = s["file_path"], s["start_line"] + 1, s["end_line"] + 1
    file = L.file_by_path(e.files, path, branch)
    n = F.size(F.split("source", "\n"))
    first, last = max(1, start_line or 1), end_line or 2**31 - 2
    row = file.select("id", "path", n.alias("lines"), line_slice("source", first, last).alias("text")).first()
    if row is None:
        raise LookupError(json.dumps({"error": "missing", "path": path}))
    last = min(last, row["lines"])
    point = e.files.sparkSession.createDataFrame([(0, row["id"], first - 1)], "point_id long, file_id long, line int")
    around = L.narrowest(point, e.symbols).join(e.symbols.select(F.col("id").alias("symbol_id"), "name", "kind"), "symbol_id").select("symbol_id", "name", "kind").collect()
    return {"path": row["path"], "start_line": first, "end_line": last, "text": row["text"], "symbol": around[0].asDict() if around else None}


def semantic_nodes(e: Engine, query: str | None, limit: int, most: float | None, branch: str | None) -> tuple[list[dict], str]:
    """Symbols near a query's vector, of a branch if it is given, and the mode used."""
    if not query or e.embed is None:
        return [], "structural (fallback: missing query_vector)"
    if e.vectors is None:
        return [], "structural (fallback: no embeddings)"
    own = L.with_context(e.symbols, e.files).where(L.symbol_filter(branch=branch))
    near = R.nearest(e.vectors.join(own.select("id"), "id", "left_semi"), e.embed(query), limit=max(1, limit), most=most)
    rows = own.join(near, "id").select(F.lit("symbol").alias("node_type"), "id", "name", "branch", F.col("distance").alias("score"), "kind", "file_path")
    return [r.asDict() for r in rows.orderBy("score", "id").collect()], "semantic"


def graph(e: Engine, kind: str = "call", source: str | None = None, target: str | None = None, hops: int = 1, limit: int = 1000, mode: str = "structural", query: str | None = None, semantic_limit: int | None = None, semantic_max_distance: float | None = None, branch: str | None = None) -> dict:
    """Edges of a kind, all, between two names, or around one, and in semantic mode the symbols near a query."""
    edges = {"call": e.call_edges, "import": e.import_edges, "inheritance": e.inheritance_edges, "type_dependency": e.type_edges}[kind]()
    nodes = (e.files.select("id", F.col("path").alias("name")) if kind == "import" else e.symbols.select("id", "name"))

    def ids(name: str) -> DataFrame:
        return nodes.where(F.col("name") == name).select(F.col("id").alias("node"))

    live = nodes.select(F.col("id").alias("dst"))
    edges = edges.join(live, "dst", "left_semi")
    if (source is None) == (target is None):  # none or both: direct edges
        depth = 5 if source is not None else 1
        if source is not None:
            edges = edges.join(ids(source).withColumnRenamed("node", "src"), "src", "left_semi").join(ids(target).withColumnRenamed("node", "dst"), "dst", "left_semi")
        out = edges.select("src", "dst", "line", "method").orderBy("src", "dst", "line").limit(limit)
    else:
        depth = max(1, min(hops, 5))
        out = G.bfs_edges(edges, ids(source or target), depth, limit, backward=target is not None) if depth > 1 else edges.join(ids(source or target).withColumnRenamed("node", "src" if source else "dst"), "src" if source else "dst", "left_semi").select("src", "dst", "line", "method").orderBy("src", "dst", "line").limit(limit)
    name = nodes.select(F.col("id"), F.col("name"))
    out = out.join(name.withColumnsRenamed({"id": "src", "name": "src_name"}), "src").join(name.withColumnsRenamed({"id": "dst", "name": "dst_name"}), "dst").orderBy("src", "dst")
    rows = shown(out)
    done = {"edges": rows, "mode_used": "structural", "depth_used": depth, "truncated": len(rows) >= limit}
    if mode == "semantic":
        found, used = semantic_nodes(e, query, semantic_limit or min(limit, 20), semantic_max_distance, branch)
        done |= {"semantic_nodes": found, "mode_used": used}
    return done


def dependents(e: Engine, symbol: str | None = None, path: str | None = None, depth: int = 5, limit: int = 1000) -> dict:
    spark = e.symbols.sparkSession
    if symbol is not None:
        s = e.one_symbol(symbol)
        seed = spark.createDataFrame([(s["id"],)], "node long")
        name = e.symbols.select(F.col("id").alias("node"), "name", "file_id")
        out = {"symbol": s}
        for key, edges in (("callers", e.call_edges()), ("subclasses", e.inheritance_edges())):
            out[key] = shown(G.dependents(edges, seed, depth).join(name, "node").orderBy("depth", "node").limit(limit))
        out["type_users"] = shown(e.type_edges().where(F.col("dst") == s["id"]).join(name.withColumnRenamed("node", "src"), "src").orderBy("src", "line").limit(limit))
        total = sum(len(v) for k, v in out.items() if k != "symbol")
    else:
        f = L.file_by_path(e.files, path).first()
        if f is None:
            raise LookupError(json.dumps({"error": "missing", "path": path}))
        seed = spark.createDataFrame([(f["id"],)], "node long")
        own = e.symbols.where(F.col("file_id") == f["id"]).select(F.col("id").alias("dst"))
        callers = e.call_edges().join(own, "dst", "left_semi").join(e.symbols.select(F.col("id").alias("src"), "name", "file_id"), "src").where(F.col("file_id") != f["id"])
        out = {"file": f["path"], "importers": shown(G.dependents(e.import_edges(), seed, depth).join(e.files.select(F.col("id").alias("node"), "path"), "node").orderBy("depth", "node").limit(limit)), "callers": shown(callers.orderBy("src", "line").limit(limit))}
        total = len(out["importers"]) + len(out["callers"])
    return out | {"truncated": total >= limit}


def trace(e: Engine, entry: str, to: str | None = None, depth: int = 5, max_lines: int = 50) -> dict:
    start = e.one_symbol(entry)["id"]
    if to is not None:
        path = G.shortest_path(e.call_edges(), start, e.one_symbol(to)["id"], depth)
        if not path:
            raise LookupError(json.dumps({"error": "no path", "depth": depth}))
        steps, truncated = [{"symbol_id": n, "depth": i} for i, n in enumerate(path)], False
    else:
        steps, truncated = G.trace(e.call_edges(), start, depth)
    ids = e.symbols.sparkSession.createDataFrame([(s["symbol_id"],) for s in steps], "id long")
    src = F.split("source", "\n")
    own = e.symbols.join(ids, "id", "left_semi").join(e.files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "source"), "file_id")
    body = F.slice(src, F.col("start_line") + 1, F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(max_lines)))
    more = F.col("end_line") - F.col("start_line") + 1 - max_lines
    text = F.concat(F.array_join(body, "\n"), F.when(more > 0, F.format_string("\n// ... (%d more lines)", more)).otherwise(""))
    facts = {r["id"]: r.asDict() for r in own.select("id", "name", "kind", "file_path", (F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"), "signature", text.alias("source")).collect()}
    return {"steps": [s | facts[s["symbol_id"]] for s in steps if s["symbol_id"] in facts], "truncated": truncated}


def history(e: Engine, mode: str = "recent", value: str | None = None, limit: int = 20) -> dict:
    limit = max(1, min(limit, 200))
    if mode == "semantic":
        if e.commit_vectors is None or e.embed is None:
            return history(e, "recent", limit=limit) | {"mode_used": "recent (no vectors)"}
        near = R.nearest(e.commit_vectors, e.embed(value), key="sha", limit=limit)
        return {"commits": shown(e.commits.join(near, "sha").orderBy("distance", F.desc("timestamp"), "sha")), "mode_used": mode}
    found = {
        "recent": lambda: C.recent(e.commits, limit),
        "file": lambda: C.by_file(e.commits, e.commit_files, value, limit),
        "commit": lambda: C.by_sha(e.commits, value),
        "author": lambda: C.by_author(e.commits, value, limit),
        "ref": lambda: C.by_ref(e.commits, e.commit_refs, value, limit),
    }[mode]()
    return {"commits": shown(C.with_details(found, e.commit_files, e.commit_refs).orderBy(F.desc("timestamp"), "sha")), "mode_used": mode}


def blame(e: Engine, lines: DataFrame, mode: str = "blame", start_line: int = 1, end_line: int = 2**31 - 1, now: int | None = None) -> dict:
    """Of blamed lines (line one-based, sha, author, author_email, timestamp, text) the lines, or who owns them
    with risk signals of their commits; or the history of a range with its commits' files and refs."""
    if mode == "history":  # lines are then the entries of a line history (sha, ..., patch), newest first
        known = C.with_details(e.commits, e.commit_files, e.commit_refs).select("sha", "files", "refs")
        rows = lines.join(known, "sha", "left").orderBy(F.desc("timestamp"), "sha")
        return {"history": [r.asDict(recursive=True) for r in rows.collect()]}
    own = lines.where((F.col("line") >= start_line) & (F.col("line") <= end_line))
    if mode == "blame":
        return {"lines": [r.asDict() for r in own.orderBy("line").collect()]}
    shas = own.select("sha").distinct()
    commits = e.commits.join(shas, "sha", "left_semi")
    return {"ownership": [r.asDict() for r in C.ownership(own).collect()], "risk": C.risk(commits, e.commit_files.join(shas.withColumnRenamed("sha", "commit_sha"), "commit_sha", "left_semi"), int(time.time()) if now is None else now).first().asDict()}


def diff(e: Engine, old: str, new: str | None = None, limit: int = 50) -> dict:
    limit = max(1, min(limit, 500))
    if new is None:
        row = e.files.where(F.col("branch") != old).groupBy("branch").agg(F.max("indexed_at").alias("t")).orderBy(F.desc("t"), "branch").first()
        new = row["branch"] if row else old
    out: dict = {"old_branch": old, "new_branch": new}
    for name, df in zip(("added", "removed", "changed"), E.diff(e.symbols, e.files, old, new)):
        out[name] = {"total": df.count(), "symbols": shown(df.orderBy("path", "name", "kind", "ordinal"), limit)}
        out[name]["truncated"] = out[name]["total"] > limit
    return out


def cohesion(e: Engine, depth: int = 2, limit: int = 20) -> dict:
    return {"directories": shown(E.cohesion(e.symbol_refs, e.symbols, e.files, depth, limit))}


def structure(e: Engine, depth: int = 2, limit: int = 20, branch: str | None = None) -> dict:
    g = E.directory_graph(e.file_imports, e.files, depth, branch)
    return {"cycles": G.directory_cycles(g, limit), "layer_violations": G.layer_violations(g, limit), "outliers": shown(E.outliers(g, limit))}


def metrics(e: Engine, least: int = 0, limit: int = 20) -> dict:
    return {"symbols": shown(L.metrics(e.symbol_metrics, e.symbols, e.files, least, limit))}


TOOLS: dict[str, Callable[..., dict]] = {f.__name__: f for f in (lookup, search, snippet, graph, dependents, trace, history, blame, diff, cohesion, structure, metrics)}


def call(e: Engine, tool: str, **arguments) -> str:
    """One tool's result as JSON text, with the index's freshness."""
    if tool not in TOOLS:
        raise KeyError(tool)
    try:
        out = TOOLS[tool](e, **arguments)
    except LookupError as x:
        out = {"error": json.loads(str(x)) if str(x).startswith("{") else str(x)}
    return json.dumps(out | {"freshness": e.freshness()}, default=str)
