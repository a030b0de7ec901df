"""Edges between symbols and files: lists, directory aggregates and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.columns import directory_prefix, leading_segments, ratio

RESOLVED = ("scip_definition", "lsp_definition", "name_same_file", "name_unique", "name_single_file", "filesystem_exact", "compilation_database", "include_basename_unique", "include_basename_nearest", "include_suffix_unique", "include_suffix_nearest")
UNRESOLVED = ("unresolved", "ambiguous_definition", "overlay_stale", "external_definition")
MOST_EDGES = 100_000


def _ends(symbols: DataFrame, files: DataFrame, side: str) -> DataFrame:
    s = symbols.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("file_id").alias("_f"))
    f = files.select(F.col("id").alias("_f"), F.col("path").alias(f"{side}_path"), F.col("branch").alias(f"{side}_branch"))
    return s.join(f, "_f").withColumnRenamed("_f", f"{side}_file_id")


def listed(edges: DataFrame, symbols: DataFrame, files: DataFrame, source: str, target: str, order: str, resolved_only: bool = False, file_id: int | None = None, branch: str | None = None, methods: list[str] | None = None, limit: int | None = MOST_EDGES) -> DataFrame:
    """Edges with both ends' names and paths; those whose target is set but not effective are left out. Without
    a limit they come unordered and whole."""
    src = _ends(symbols, files, "source").withColumnRenamed("source_id", source)
    dst = _ends(symbols, files, "target").withColumnRenamed("target_id", target)
    out = edges
    if methods is not None:
        out = out.where(F.col("resolution_method").isin(methods))
    if resolved_only:
        out = out.where(F.col(target).isNotNull())
    if file_id is not None:
        out = out.where(F.col("file_id") == file_id)
    out = out.drop("layer", "generation").join(src, source).join(dst, target, "left").where(F.col(target).isNull() | F.col("target_name").isNotNull())
    if branch is not None:
        out = out.where(F.col("source_branch") == branch)
    return out if limit is None else out.orderBy(source, order, "id").limit(limit)


def calls(edges: DataFrame, symbols: DataFrame, files: DataFrame, **options) -> DataFrame:
    return listed(edges, symbols, files, "caller_id", "callee_id", "call_line", **options)


def type_uses(edges: DataFrame, symbols: DataFrame, files: DataFrame, **options) -> DataFrame:
    return listed(edges, symbols, files, "symbol_id", "type_id", "ref_line", **options)


def relationships(edges: DataFrame, symbols: DataFrame, files: DataFrame, relationship_type: str | None = None, **options) -> DataFrame:
    if relationship_type is not None:
        edges = edges.where(F.col("relationship_type") == relationship_type)
    return listed(edges, symbols, files, "source_symbol_id", "target_symbol_id", "line", **options)


def symbol_edges(calls: DataFrame, types: DataFrame, relationships: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = ("call", "type"), methods: tuple[str, ...] | None = None) -> DataFrame:
    """Resolved edges (src, dst, kind, method) of the wanted kinds whose two ends are effective."""
    parts = {
        "call": calls.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.lit("call").alias("kind"), F.col("resolution_method").alias("method")),
        "type": types.select(F.col("symbol_id").alias("src"), F.col("type_id").alias("dst"), F.lit("type").alias("kind"), F.col("resolution_method").alias("method")),
        "inheritance": relationships.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), F.lit("inheritance").alias("kind"), F.col("resolution_method").alias("method")),
    }
    out = None
    for k in kinds:
        out = parts[k] if out is None else out.unionByName(parts[k])
    if methods is not None:
        out = out.where(F.col("method").isin(*methods))
    ids = symbols.select("id")
    out = out.where("src is not null and dst is not null")
    return out.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind", "method")


def _call_paths(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    ends = symbols.select(F.col("id").alias("s"), "file_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("s", "path")
    return (
        calls.where("callee_id is not null")
        .select("caller_id", "callee_id")
        .join(ends.withColumnsRenamed({"s": "caller_id", "path": "src"}), "caller_id")
        .join(ends.withColumnsRenamed({"s": "callee_id", "path": "dst"}), "callee_id")
        .select("src", "dst")
    )


def cohesion(calls: DataFrame, symbols: DataFrame, files: DataFrame, depth: int = 2, limit: int = 20) -> DataFrame:
    """Per directory (of `depth` leading segments) its internal, inbound and outbound calls, distinct files,
    cohesion and instability, the least cohesive first. All calls count: there is no cap."""
    depth = max(1, depth)
    e = _call_paths(calls, symbols, files).select("src", "dst", leading_segments("src", depth).alias("a"), leading_segments("dst", depth).alias("b"))
    inner = (F.col("a") == F.col("b")).cast("int")
    rows = e.select(F.explode(F.array(F.struct(F.col("a").alias("directory"), F.col("src").alias("path"), inner.alias("i"), F.lit(0).alias("n"), (1 - inner).alias("o")), F.struct(F.col("b").alias("directory"), F.col("dst").alias("path"), F.lit(0).alias("i"), (1 - inner).alias("n"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    per = rows.groupBy("directory").agg(F.countDistinct("path").alias("file_count"), F.sum("i").alias("internal_edges"), F.sum("n").alias("external_inbound"), F.sum("o").alias("external_outbound"))
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return per.withColumns({"cohesion": share("internal_edges", "external_outbound"), "instability": share("external_outbound", "external_inbound")}).orderBy("cohesion", "directory").limit(max(1, min(limit, 200)))


def directory_graph(imports: DataFrame, files: DataFrame, depth: int = 2, branch: str | None = None) -> DataFrame:
    """(from_dir, to_dir, count, sample_files): imports between different directories, with the first three
    distinct samples by file ids."""
    from pyspark.sql import Window

    a = files.select(F.col("id").alias("file_id"), directory_prefix("path", depth).alias("from_dir"), "branch")
    if branch is not None:
        a = a.where(F.col("branch") == branch)
    b = files.select(F.col("id").alias("resolved_id"), directory_prefix("path", depth).alias("to_dir"))
    e = imports.where("resolved_id is not null").select("file_id", "resolved_id").join(a.drop("branch"), "file_id").join(b, "resolved_id").where("from_dir <> to_dir")
    # samples: the three smallest pairs of files, cut down before the shuffle, and only then their paths
    w = Window.partitionBy("from_dir", "to_dir").orderBy("file_id", "resolved_id")
    top = e.withColumn("r", F.dense_rank().over(w)).where("r <= 3").select("from_dir", "to_dir", "r", "file_id", "resolved_id").distinct()
    path = lambda key, name: files.select(F.col("id").alias(key), F.col("path").alias(name))
    top = top.join(path("file_id", "src"), "file_id").join(path("resolved_id", "dst"), "resolved_id").select("from_dir", "to_dir", "r", F.concat_ws(" → ", "src", "dst").alias("sample"))
    top = top.groupBy("from_dir", "to_dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "sample"))), lambda x: x["sample"]).alias("sample_files"))
    return e.groupBy("from_dir", "to_dir").agg(F.count("*").alias("count")).join(top, ["from_dir", "to_dir"])


def outliers(graph: DataFrame, limit: int = 20) -> DataFrame:
    """Directory edges with fewer imports than mean less deviation (1 at least), with the reverse count."""
    stats = graph.agg(F.avg("count").alias("_m"), F.stddev_pop("count").alias("_s"))
    cut = F.when(F.col("_s") > 0, F.greatest(F.lit(1.0), F.col("_m") - F.col("_s")))
    back = graph.select(F.col("to_dir").alias("from_dir"), F.col("from_dir").alias("to_dir"), F.col("count").alias("_r"))
    return (
        graph.crossJoin(F.broadcast(stats))  # one row
        .where(F.col("count") < cut)
        .join(back, ["from_dir", "to_dir"], "left")
        .select("from_dir", "to_dir", F.col("count").alias("edge_count"), F.coalesce("_r", F.lit(0)).alias("reverse_edge_count"), "sample_files")
        .orderBy("edge_count", "from_dir", "to_dir")
        .limit(limit)
    )


def _tally(edges: DataFrame, target: str, prefix: str) -> DataFrame:
    ext = F.col("resolution_method").isin("external_definition", "external_dependency")
    return edges.groupBy("file_id").agg(F.count("*").alias(f"{prefix}_total"), F.sum(F.col(target).isNotNull().cast("int")).alias(f"{prefix}_resolved"), F.sum((F.col(target).isNull() & ext).cast("int")).alias(f"{prefix}_external"))


def file_coverage(files: DataFrame, symbols: DataFrame, calls: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Per effective file its symbols and, of calls, type uses and imports, all, resolved and external ones."""
    parts = [symbols.groupBy("file_id").agg(F.count("*").alias("symbols")), _tally(calls, "callee_id", "calls"), _tally(types, "type_id", "types"), _tally(imports, "resolved_id", "imports")]
    out = files.select(F.col("id").alias("file_id"), "path", "language")
    for p in parts:
        out = out.join(p, "file_id", "left")
    return out.select("file_id", "path", "language", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for p in parts for c in p.columns if c != "file_id"))


def coverage_groups(coverage: DataFrame) -> DataFrame:
    """Totals and rates over everything, by language and by extension (grouping sets). A rate is null without
    references; external ones count as classified, up to the total."""
    view = coverage.withColumn("extension", F.regexp_extract("path", r"(\.[^./]+)$", 1))
    view.createOrReplaceTempView("_coverage")
    names = [f"{p}_{k}" for p in ("calls", "types", "imports") for k in ("total", "resolved", "external")]
    sums = ", ".join(f"sum({n}) AS {n}" for n in ["symbols", *names])
    got = coverage.sparkSession.sql(f"SELECT grouping(language) AS gl, grouping(extension) AS ge, language, extension, count(*) AS files, {sums} FROM _coverage GROUP BY GROUPING SETS ((), (language), (extension))")
    scope = F.when((F.col("gl") == 0), "language").when(F.col("ge") == 0, "extension").otherwise("all")
    rate = lambda p: ratio(F.least(F.col(f"{p}_total"), F.col(f"{p}_resolved") + F.col(f"{p}_external")), F.col(f"{p}_total")).alias(f"{p}_rate")
    return got.select(scope.alias("scope"), F.coalesce("language", "extension", F.lit("")).alias("value"), "files", "symbols", *names, *(rate(p) for p in ("calls", "types", "imports")))


def resolution_methods(calls: DataFrame, types: DataFrame, relationships: DataFrame, imports: DataFrame) -> DataFrame:
    """Per kind of edge and method its number and share of the kind."""
    from pyspark.sql import Window

    parts = None
    for name, df in (("call", calls), ("type", types), ("relationship", relationships), ("import", imports)):
        one = df.groupBy("resolution_method").agg(F.count("*").alias("count")).select(F.lit(name).alias("entity"), F.col("resolution_method").alias("method"), "count")
        parts = one if parts is None else parts.unionByName(one)
    return parts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("entity")))


def duplicate_paths(files: DataFrame) -> DataFrame:
    return files.groupBy("path", "branch").agg(F.count("*").alias("count")).where("count > 1")


def duplicate_symbols(symbols: DataFrame) -> DataFrame:
    keys = ["file_id", "name", "kind", "start_line", "start_character", "end_line", "end_character", "selection_line", "selection_character", "parent_symbol_id", "signature"]
    return symbols.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def reverse_deps(imports: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (file_id, dependent_id, dep_kind): a file and one that imports it or refers to its symbols."""
    a = imports.where("resolved_id is not null").select(F.col("resolved_id").alias("file_id"), F.col("file_id").alias("dependent_id"), F.lit("import").alias("dep_kind"))
    own = symbols.select(F.col("id").alias("_s"), F.col("file_id").alias("_f"))
    b = calls.where("callee_id is not null").join(own, F.col("callee_id") == F.col("_s")).select(F.col("_f").alias("file_id"), F.col("file_id").alias("dependent_id"), F.lit("ref").alias("dep_kind"))
    return a.unionByName(b).where("file_id <> dependent_id").distinct()


def refreshed_reverse_deps(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """old with the rows that touch a changed file (column id) taken from new."""
    ids = changed.select("id").distinct()
    touch = lambda df: df.join(ids, (F.col("file_id") == F.col("id")), "left_semi").unionByName(df.join(ids, F.col("dependent_id") == F.col("id"), "left_semi")).distinct()
    keep = old.join(ids, F.col("file_id") == F.col("id"), "left_anti").join(ids, F.col("dependent_id") == F.col("id"), "left_anti")
    return keep.unionByName(touch(new))


def virtual_dispatch(calls: DataFrame, overrides: DataFrame) -> DataFrame:
    """Calls of an interface's method as calls of each method that overrides it (interface_id, concrete_id),
    unless the caller has that call at the place already; nulls in places are equal."""
    pairs = overrides.select("interface_id", "concrete_id").distinct()
    # a call may be made again if its callee is an interface's method, and stand in the way if it overrides one; others go no further
    roles = pairs.select(F.col("interface_id").alias("_t"), F.col("concrete_id").alias("_to"), F.lit(True).alias("_made")).unionByName(pairs.select(F.col("concrete_id").alias("_t"), F.col("concrete_id").alias("_to"), F.lit(False).alias("_made")).distinct())
    met = calls.where("callee_id is not null").join(roles.where("_t is not null"), F.col("callee_id") == F.col("_t"))
    place = ["caller_id", "_callee", "call_line", "call_character"]
    per = met.withColumnRenamed("_to", "_callee").groupBy(*place).agg(F.collect_set(F.when(F.col("_made"), F.struct("callee_name", "file_id"))).alias("made"), F.max(~F.col("_made")).alias("have"))
    free = per.where(~F.col("have") | F.col("caller_id").isNull() | F.col("_callee").isNull() | F.col("call_line").isNull()).withColumn("x", F.explode("made"))
    return free.select("caller_id", F.col("_callee").alias("callee_id"), "x.callee_name", "call_line", "call_character", "x.file_id")


def overrides(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """(interface_id, concrete_id): methods of the same descriptor in a type and one that implements it."""
    m = symbols.where("kind in ('method', 'function')").select(F.col("id").alias("m"), F.col("parent_symbol_id").alias("p"), "name")
    r = relationships.where("target_symbol_id is not null and relationship_type in ('implements', 'extends')").select(F.col("source_symbol_id").alias("sub"), F.col("target_symbol_id").alias("sup")).distinct()
    return r.join(m.withColumnsRenamed({"m": "interface_id", "p": "sup"}), "sup").join(m.withColumnsRenamed({"m": "concrete_id", "p": "sub"}), ["sub", "name"]).select("interface_id", "concrete_id").distinct()


def diff(symbols: DataFrame, files: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exported symbols added, removed and changed between two branches, matched by path, name, kind and place
    among those of a file with their name and kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("name", "kind", "file_id").orderBy("start_line", "id")
    f = files.select(F.col("id").alias("file_id"), "path", "branch")

    def side(branch: str) -> DataFrame:
        own = f.where(F.col("branch") == branch).drop("branch")
        return symbols.where("is_exported").join(own, "file_id").withColumn("ordinal", F.row_number().over(w)).select("path", "name", "kind", "ordinal", "signature", "start_line")

    a, b, key = side(old), side(new), ["path", "name", "kind", "ordinal"]
    both = a.withColumnsRenamed({"signature": "old_signature", "start_line": "old_line"}).join(b.withColumnRenamed("signature", "new_signature"), key)
    changed = both.where(F.coalesce("old_signature", F.lit("")) != F.coalesce("new_signature", F.lit(""))).select(*key, "old_signature", "new_signature", "start_line")
    return b.join(a.select(*key), key, "left_anti"), a.join(b.select(*key), key, "left_anti"), changed
