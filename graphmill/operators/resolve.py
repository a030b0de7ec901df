"""Resolution of raw names and definition positions into edges, as a cascade of passes.

Each pass takes a full edge table and gives it back with more targets; it only touches rows that are still
`unresolved`. Edges are normalised to (id, file_id, target, name, method, definition_path, definition_line,
definition_character) by `generic` and put back by `specific`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.columns import bare_type, member_name, segments
from graphmill.storage import stored

NOT_ACROSS_FILES = ("macro", "constant", "enum_member")


def generic(edges: DataFrame, target: str, name: str) -> DataFrame:
    return edges.withColumnsRenamed({target: "target", name: "name", "resolution_method": "method"})


def specific(edges: DataFrame, target: str, name: str) -> DataFrame:
    return edges.withColumnsRenamed({"target": target, "name": name, "method": "resolution_method"})


def branched(df: DataFrame) -> DataFrame:
    """df with its branch; a frame without one is all one branch."""
    return df if "branch" in df.columns else df.withColumn("branch", F.lit(""))


def _put(edges: DataFrame, found: DataFrame) -> DataFrame:
    """edges with target and method from found (id, t, m) where it has the id."""
    return edges.join(found, "id", "left").withColumns({"target": F.coalesce("t", "target"), "method": F.coalesce("m", "method")}).select(*edges.columns)


def by_definition(edges: DataFrame, symbols: DataFrame, files: DataFrame, dirty: DataFrame, normal: Column | None = None) -> DataFrame:
    """Resolve by definition position. Candidates are symbols of the definition's file with the edge's name or
    its normalised name. The first tier that has any decides: exact selection point, exact start, position
    within the span (end included), line within the span. The narrowest wins; a tie is ambiguous; a path that
    is not indexed is stale if dirty, else external."""
    normal = F.col("name") if normal is None else normal
    files, dirty = branched(files), branched(dirty)
    open_ = edges.where("target is null and method = 'unresolved' and definition_path is not null and definition_line is not null")
    open_ = open_.select("id", "file_id", F.col("name").alias("n"), normal.alias("nn"), "definition_path", F.col("definition_line").alias("l"), F.col("definition_character").alias("c"))
    # a definition lies in the edge's own branch
    own = files.select(F.col("id").alias("file_id"), F.col("branch").alias("_b"))
    here = files.groupBy(F.col("path").alias("definition_path"), F.col("branch").alias("_b")).agg(F.max("id").alias("f"))
    known = open_.join(own, "file_id", "left").join(here, ["definition_path", "_b"], "left")
    stale = dirty.select(F.col("path").alias("definition_path"), F.col("branch").alias("_b")).distinct().withColumn("d", F.lit(True))
    outside = known.where("f is null").join(stale, ["definition_path", "_b"], "left").select("id", F.lit(None).cast("long").alias("t"), F.when(F.col("d"), "overlay_stale").otherwise("external_definition").alias("m"))
    names = known.where("f is not null").withColumn("sname", F.explode(F.array_distinct(F.filter(F.array("n", "nn"), lambda x: x.isNotNull() & (x != "")))))
    s = symbols.select(F.col("id").alias("t"), F.col("file_id").alias("f"), F.col("name").alias("sname"), F.col("start_line").alias("s0"), F.col("end_line").alias("s1"), F.col("start_character").alias("c0"), F.col("end_character").alias("c1"), F.col("selection_line").alias("p0"), F.col("selection_character").alias("p1"))
    met = names.join(s, ["f", "sname"])
    within = (F.col("l") >= F.col("s0")) & (F.col("l") <= F.col("s1"))
    before = (F.col("l") == F.col("s0")) & (F.col("c") < F.col("c0"))
    after = (F.col("l") == F.col("s1")) & (F.col("c") > F.col("c1"))
    no = F.lit(False)
    tier = (
        F.when((F.col("p0") == F.col("l")) & (F.col("p1") == F.col("c")), 1)
        .when((F.col("s0") == F.col("l")) & (F.col("c0") == F.col("c")), 2)
        .when(F.col("c").isNotNull() & within & ~F.coalesce(before, no) & ~F.coalesce(after, no), 3)
        .when(within, 4)
    )
    one_line = (F.col("s0") == F.col("s1")) & F.col("c0").isNotNull() & F.col("c1").isNotNull()
    chars = F.when(F.col("tier") == 4, 0).when(one_line, F.col("c1") - F.col("c0")).otherwise(2**31 - 1)
    met = met.withColumn("tier", tier).where("tier is not null").select("id", "t", F.struct("tier", (F.col("s1") - F.col("s0")).alias("w"), chars.alias("k")).alias("rank")).repartition("id").distinct()
    # the best rank, how many candidates share it, and the smallest id: all where the edge's candidates are
    per = met.groupBy("id", "rank").agg(F.count("*").alias("n"), F.min("t").alias("t"))
    best = per.groupBy("id").agg(F.min(F.struct("rank", "n", "t")).alias("b"))
    inside = best.select("id", F.when(F.col("b.n") == 1, F.col("b.t")).alias("t"), F.when(F.col("b.n") == 1, "lsp_definition").otherwise("ambiguous_definition").alias("m"))
    return _put(edges, inside.unionByName(outside))


def by_name(edges: DataFrame, symbols: DataFrame, normal: Column | None = None, files: DataFrame | None = None) -> DataFrame:
    """Resolve by name: the only such symbol of the edge's file; else the only one of its branch that is no
    macro, constant or enum member; else the first of several in one file. The normalised name, an expression of the
    column name, counts where no symbol of the branch has the name itself, so a pass by names alone before this one
    would change nothing. Without files, all is one branch."""
    # edges that are settled pass by
    columns = edges.columns
    is_open = F.coalesce(F.col("target").isNull() & (F.col("method") == "unresolved"), F.lit(False))
    open_, closed = edges.where(is_open).withColumn("_k", F.col("name")), edges.where(~is_open)
    if files is None:
        open_, symbols = open_.withColumn("_b", F.lit("")), symbols.withColumn("_b", F.lit(""))
    else:
        of = branched(files).select(F.col("id").alias("file_id"), F.col("branch").alias("_b"))
        open_, symbols = open_.join(of, "file_id", "left"), symbols.join(of, "file_id")
    across = ~F.col("kind").isin(*NOT_ACROSS_FILES)
    every = symbols.groupBy("_b", "name").agg(
        F.sum(across.cast("int")).alias("n"),
        F.min(F.when(across, F.col("id"))).alias("first"),
        F.min(F.when(across, F.col("file_id"))).alias("f0"),
        F.max(F.when(across, F.col("file_id"))).alias("f1"),
    )
    # what an edge takes along: whether the name is there, the symbol if one file has it, and whether that is the only one
    every = every.select("_b", F.col("name").alias("_k"), F.col("n").isNotNull().alias("_has"), F.when((F.col("n") >= 1) & (F.col("f0") == F.col("f1")), F.col("first")).alias("first"), (F.col("n") == 1).alias("_one"))
    own = symbols.groupBy("file_id", "name").agg(F.count("*").alias("k"), F.min("id").alias("own")).where("k = 1").select("file_id", F.col("name").alias("_k"), "own")
    # an edge meets both tables on its way and is not joined with itself again
    if normal is not None:
        # an edge's name that normalising changes can only be that of a symbol whose name it changes too, and few have such
        # names: stored, so that their number is known
        odd = stored(symbols.where(~normal.eqNullSafe(F.col("name"))).select("_b", F.col("name").alias("_k")).distinct()).withColumn("_odd", F.lit(True))
        open_ = open_.withColumn("_n", normal).join(odd, ["_b", "_k"], "left").withColumn("_k", F.when(F.col("_odd") | (F.col("_n") == ""), F.col("name")).otherwise(F.col("_n"))).drop("_n", "_odd")
    met = open_.join(every, ["_b", "_k"], "left").join(own, ["file_id", "_k"], "left")
    t = F.when(F.col("_has"), F.coalesce("own", "first"))
    m = F.when(F.col("own").isNotNull(), "name_same_file").when(F.col("_one"), "name_unique").otherwise("name_single_file")
    met = met.withColumn("_t", t).withColumns({"target": F.coalesce("_t", "target"), "method": F.when(F.col("_t").isNotNull(), m).otherwise(F.col("method"))})
    return met.select(*columns).unionByName(closed)


def resolve_calls(calls: DataFrame, symbols: DataFrame, files: DataFrame, dirty: DataFrame) -> DataFrame:
    e = generic(calls, "callee_id", "callee_name")
    e = by_definition(e, symbols, files, dirty, member_name("name"))
    e = by_name(e, symbols, member_name("name"), files)
    return specific(e, "callee_id", "callee_name")


def resolve_types(types: DataFrame, symbols: DataFrame, files: DataFrame, dirty: DataFrame) -> DataFrame:
    e = generic(types, "type_id", "type_name")
    e = by_definition(e, symbols, files, dirty, bare_type("name"))
    e = by_name(e, symbols, bare_type("name"), files)
    return specific(e, "type_id", "type_name")


def resolve_relationships(relationships: DataFrame, symbols: DataFrame, files: DataFrame, dirty: DataFrame) -> DataFrame:
    e = generic(relationships, "target_symbol_id", "target_symbol_name")
    e = by_name(by_definition(e, symbols, files, dirty, bare_type("name")), symbols, bare_type("name"), files)
    return specific(e, "target_symbol_id", "target_symbol_name")


def suffixes(path: Column) -> Column:
    """All ends of a path by whole segments, the path itself among them."""
    s = segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(s)), lambda n: F.array_join(F.slice(s, n, F.size(s)), "/"))


def ancestors(path: Column) -> Column:
    """(depth, dir) of all directories above a path, from the root, depth 0 and an empty name, to its own."""
    s = segments(F.ltrim(path, F.lit("/")))
    return F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(s, F.lit(1), n), "/").alias("dir")))


def by_include(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Includes still open against all indexed paths that end with them: the only one, else the only one in
    the deepest directory of the including file that has any of them below it. (id, t, m); `..` never matches.

    imports are (id, path of the including file, raw). Includes and files of a name never meet one by one: files
    are counted by ending and directory above, and each directory of an include's own path asks for one such
    count, once for all includes of the directory. So 10^5 includes and 10^5 files of one name are 10^5 rows of
    either side times their depth."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.col("raw"), "\\", "/"), r'^[<"]|[>"]$', ""), r"^(\./)+|/+$", "")
    one = F.lit("")
    want = imports.select("id", (F.col("b") if "b" in imports.columns else one).alias("b"), directory(F.ltrim("path", F.lit("/"))).alias("at"), plain.alias("suffix")).where("suffix <> ''").where(~F.array_contains(F.split("suffix", "/"), ".."))
    asked = want.select("b", "suffix").distinct()
    target = files.select(F.col("id").alias("t"), (F.col("branch") if "b" in imports.columns else one).alias("b"), "path", F.explode(suffixes(F.ltrim(F.col("path"), F.lit("/")))).alias("suffix"))
    below = target.join(asked, ["b", "suffix"], "left_semi").select("b", "suffix", "t", F.explode(ancestors(F.col("path"))).alias("x"))
    counts = below.groupBy("b", "suffix", F.col("x.dir").alias("dir")).agg(F.count("*").alias("k"), F.min("t").alias("t"))
    places = want.select("b", "suffix", "at").distinct()
    met = places.select("*", F.explode(ancestors(F.concat("at", F.when(F.col("at") == "", "").otherwise("/"), F.lit("x")))).alias("x")).select("b", "suffix", "at", "x.depth", "x.dir").join(counts, ["b", "suffix", "dir"])
    best = met.groupBy("b", "suffix", "at").agg(F.max(F.struct("depth", "k", "t")).alias("best"), F.max("k").alias("n"))  # the root's count is that of all
    kind = F.when(F.col("suffix").contains("/"), "include_suffix_").otherwise("include_basename_")
    found = best.where("best.k = 1").select("b", "suffix", "at", F.col("best.t").alias("t"), F.concat(kind, F.when(F.col("n") == 1, "unique").otherwise("nearest")).alias("m"))
    return want.join(found, ["b", "suffix", "at"]).select("id", "t", "m")


# fixed values: what an import of a script may mean, in order
JS_PROBES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")
JS_TO_TS = ((".js", ".ts"), (".jsx", ".tsx"), (".mjs", ".mts"), (".cjs", ".cts"))


def normal_path(path: Column) -> Column:
    """A path without `.` and with `..` taken up, segment by segment."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(done, "/"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def candidates(language: str, raw: Column, path: Column, root: str, go_module: str | None) -> Column:
    """Paths that an import of a language may mean, in order of preference."""
    at = lambda base, rest: normal_path(F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest)))
    none = F.array().cast("array<string>")
    if language in ("typescript", "javascript"):
        base = at(directory(path), raw)
        probes = [F.concat(base, F.lit(p)) for p in JS_PROBES]
        swaps = [F.when(raw.endswith(a), F.concat(F.regexp_replace(base, a.replace(".", r"\.") + "$", ""), F.lit(b))) for a, b in JS_TO_TS]
        return F.when(raw.startswith("."), F.filter(F.array(*probes, *swaps), lambda x: x.isNotNull())).otherwise(none)
    if language == "python":
        dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
        rest = F.translate(F.regexp_replace(raw, r"^\.+", ""), ".", "/")
        up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
        base = F.when(dots > 0, at(directory(path), F.concat(up, rest))).otherwise(at(F.lit(root), rest))
        return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    if language == "java":
        rel = F.concat(F.translate(raw, ".", "/"), F.lit(".java"))
        return F.array(*[at(F.lit(f"{root}/{s}".strip("/") if not root else f"{root}/{s}".rstrip("/")), rel) for s in ("src/main/java", "src", "")])
    if language in ("c", "cpp"):
        quoted = ~raw.startswith("<")
        return F.when(quoted, F.array(at(directory(path), raw), at(F.lit(root), raw))).otherwise(none)
    return none


LANGUAGES = ("typescript", "javascript", "python", "java", "c", "cpp")


def external(language: Column, raw: Column, go_module: str | None, crates: list[str]) -> Column:
    """Whether an import that no file answers lies outside the project."""
    relative = raw.startswith(".")
    rust_own = raw.rlike("^(crate|self|super)::")
    if crates:
        rust_own = rust_own | F.substring_index(raw, "::", 1).isin(crates)
    return F.when(language.isin("typescript", "javascript", "python"), ~relative).when(language == "rust", ~rust_own).when(language.isin("c", "cpp"), raw.startswith("<")).otherwise(F.lit(True))


def resolve_imports(imports: DataFrame, files: DataFrame, root: str = "", go_module: str | None = None, crates: list[str] | None = None, include_paths: DataFrame | None = None) -> DataFrame:
    """imports with resolved_id and method: candidate paths by language against the indexed paths, then C
    include paths (file_id, position, dir), then ends of indexed paths, then external."""
    files = branched(files)
    f = files.select(F.col("id").alias("_f"), F.col("path").alias("_p"), "language", F.col("branch").alias("b"))
    open_ = imports.where("resolved_id is null and resolution_method = 'unresolved'").join(f, F.col("file_id") == F.col("_f")).select("id", "file_id", "b", F.col("_p").alias("path"), "language", F.col("raw_import").alias("raw"))
    cand = F.array().cast("array<string>")
    for lang in LANGUAGES:
        cand = F.when(F.col("language") == lang, candidates(lang, F.col("raw"), F.col("path"), root, go_module)).otherwise(cand)
    paths = files.groupBy(F.col("path").alias("c"), F.col("branch").alias("b")).agg(F.max("id").alias("t"))
    probed = open_.select("id", "b", F.posexplode(cand).alias("pos", "c")).join(paths, ["c", "b"]).groupBy("id").agg(F.min(F.struct("pos", "t")).alias("b")).select("id", F.col("b.t").alias("t"), F.lit("filesystem_exact").alias("m"))
    found = probed
    if go_module:
        inside = (F.col("raw") == go_module) | F.col("raw").startswith(go_module + "/")
        go = open_.where((F.col("language") == "go") & inside).select("id", "b", F.expr(f"substring(raw, {len(go_module) + (1 if root else 2)})").alias("below")).select("id", "b", F.concat(F.lit(root), "below").alias("dir"))
        first = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select(directory(F.col("path")).alias("dir"), F.col("branch").alias("b"), "path", "id").groupBy("dir", "b").agg(F.min(F.struct("path", "id")).alias("x"))
        found = found.unionByName(go.join(first.select("dir", "b", F.col("x.id").alias("t")), ["dir", "b"]).select("id", "t", F.lit("filesystem_exact").alias("m")))
    c = open_.where("language in ('c', 'cpp')").join(found.select("id"), "id", "left_anti")
    bare = F.regexp_replace("raw", r'^[<"]|[>"]$', "")
    if include_paths is not None:
        via = c.join(include_paths, "file_id").select("id", "b", "position", normal_path(F.concat("dir", F.lit("/"), bare)).alias("c")).join(paths, ["c", "b"]).groupBy("id").agg(F.min(F.struct("position", "t")).alias("b")).select("id", F.col("b.t").alias("t"), F.lit("compilation_database").alias("m"))
        found = found.unionByName(via)
        c = c.join(via.select("id"), "id", "left_anti")
    found = found.unionByName(by_include(c, files))
    rest = open_.join(found.select("id"), "id", "left_anti").where(external(F.col("language"), F.col("raw"), go_module, crates or [])).select("id", F.lit(None).cast("long").alias("t"), F.lit("external_dependency").alias("m"))
    e = imports.withColumnsRenamed({"resolved_id": "target", "resolution_method": "method"})
    return _put(e, found.unionByName(rest)).withColumnsRenamed({"target": "resolved_id", "method": "resolution_method"})


def include_lists(units: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, position, dir): include paths of a compilation database for each file. units are (path,
    includes). A file that is a unit has its own; another has those of the deepest directory it shares with
    any unit, if all units below agree, else none."""
    ups = lambda p: F.transform(F.sequence(F.lit(0), F.size(F.split(p, "/")) - 2), lambda n: F.array_join(F.slice(F.split(p, "/"), F.lit(1), n + 1), "/"))
    own = files.select("id", "path").join(units, "path").select(F.col("id").alias("file_id"), "includes")
    agree = units.withColumn("dir", F.explode(ups(F.col("path")))).groupBy("dir").agg(F.countDistinct("includes").alias("n"), F.min("includes").alias("includes"))
    other = files.select("id", "path").join(units.select("path"), "path", "left_anti").withColumn("dir", F.explode(ups(F.col("path")))).join(agree, "dir")
    best = other.groupBy("id").agg(F.max_by(F.struct("n", "includes"), F.length("dir")).alias("b")).where("b.n = 1").select(F.col("id").alias("file_id"), F.col("b.includes").alias("includes"))
    return own.unionByName(best).select("file_id", F.posexplode("includes").alias("position", "dir"))


def _levels(spans: DataFrame, begin: str, end: str) -> int:
    """Levels of halving that spans [begin, end) need."""
    longest = spans.agg(F.max(F.col(end) - F.col(begin))).first()[0]
    return max(int(longest or 0), 1).bit_length()


def _cover(begin: Column, end: Column, levels: int) -> Column:
    """(level, place) of the aligned stretches of 2^level that make up [begin, end): two of a level at most."""
    odd = lambda c: c.bitwiseAND(F.lit(1).cast("long")) == 1

    def of_level(k: int) -> Column:
        first, last = F.shiftright(begin + ((1 << k) - 1), k), F.shiftright(end, k)
        some = first < last
        if k == levels - 1:  # longer stretches would only be fewer
            places = F.when(some, F.sequence(first, last - 1)).otherwise(F.array().cast("array<long>"))
        else:
            places = F.filter(F.array(F.when(some & odd(first), first), F.when(some & odd(last), last - 1)), lambda x: x.isNotNull())
        return F.transform(places, lambda p: F.struct(F.lit(k).alias("level"), p.alias("place")))

    return F.flatten(F.array(*map(of_level, range(levels))))


def smallest_holding(points: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, end: str, value: str) -> DataFrame:
    """points with the smallest `value` of the spans of their keys that hold `at`, begin included, end not.

    Each span becomes the aligned stretches that make it up, at most two of each length 1, 2, 4 ..., of which the
    smallest value is kept; a point asks for one stretch of each length. So points and spans meet by equality,
    with one row on the side of the spans, however many of them overlap in one place."""
    spans = spans.where(F.col(begin) < F.col(end))
    n = _levels(spans, begin, end)
    made = spans.select(*keys, value, F.explode(_cover(F.col(begin).cast("long"), F.col(end).cast("long"), n)).alias("x"))
    least = made.groupBy(*keys, "x.level", "x.place").agg(F.min(value).alias(value))
    asked = points.select(*keys, at).distinct()
    up = asked.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col(at).cast("long"), k).alias("place")) for k in range(n)])).alias("x")).select(*keys, at, "x.level", "x.place")
    found = up.join(least, [*keys, "level", "place"]).groupBy(*keys, at).agg(F.min(value).alias(value))
    return points.join(found, [*keys, at], "left")


def nearest_occurrence(points: DataFrame, occurrences: DataFrame, most: int = 5) -> DataFrame:
    """For each point (point_id, file_id, line, character) an occurrence (occ_id, start_line, start_character,
    end_line, end_character): one that holds it, else the nearest start on its line within `most` characters,
    else a longer one of several lines that spans it; the smallest occ_id of equal ones.

    The three are found by themselves, each by equality of keys, and points at one place are asked for once:
    work grows with points and occurrences, not with their product in a file or a line."""
    p = points.select("point_id", "file_id", "line", "character").where("line is not null")
    o = occurrences.select("file_id", "occ_id", "start_line", "start_character", "end_line", "end_character")
    single = o.where("start_line = end_line").select("file_id", F.col("start_line").alias("line"), "start_character", "end_character", "occ_id")
    holding = smallest_holding(p.select("file_id", "line", "character").distinct().where("character is not null"), single, ["file_id", "line"], "character", "start_character", "end_character", "occ_id").where("occ_id is not null").withColumn("rank", F.lit(0))
    starts = o.where("start_line <= end_line").groupBy("file_id", F.col("start_line").alias("line"), F.col("start_character").alias("start")).agg(F.min("occ_id").alias("occ_id"))
    reach = p.select("file_id", "line", "character").distinct().withColumn("start", F.explode(F.sequence(F.col("character") - most, F.col("character") + most)))
    near = reach.join(starts, ["file_id", "line", "start"]).select("file_id", "line", "character", "occ_id", (F.abs(F.col("character") - F.col("start")) + 1).alias("rank"))
    long = o.where("start_line < end_line").select("file_id", "start_line", (F.col("end_line") + 1).alias("after"), "occ_id")
    spanned = smallest_holding(p.select("file_id", "line").distinct(), long, ["file_id"], "line", "start_line", "after", "occ_id").where("occ_id is not null")
    by_place = holding.select("file_id", "line", "character", "rank", "occ_id").unionByName(near).groupBy("file_id", "line", "character").agg(F.min(F.struct("rank", "occ_id")).alias("x"))
    out = p.join(by_place, ["file_id", "line", "character"], "left").join(spanned.withColumnRenamed("occ_id", "_s"), ["file_id", "line"], "left")
    return out.select("point_id", F.coalesce("x.occ_id", "_s").alias("occ_id")).where("occ_id is not null")


def first_per_key(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def header_language(files: DataFrame, includes: DataFrame) -> DataFrame:
    """(path, language) of headers: what C and C++ units reach them by includes (src, dst), c, cpp or mixed;
    else the sources of the nearest directory above that has any, c, cpp or ambiguous; else unknown."""
    from graphmill.operators.graph import reachable

    unit = files.where("path not like '%.h'").where("language in ('c', 'cpp')").select("path", "language")
    heads = files.where("path like '%.h'").select("path")
    out = None
    for lang in ("c", "cpp"):
        got = reachable(includes, unit.where(F.col("language") == lang).select(F.col("path").alias("node"))).select(F.col("node").alias("path")).withColumn(lang, F.lit(True))
        out = got if out is None else out.join(got, "path", "full_outer")
    reached = heads.join(out, "path", "left").select("path", F.when(F.col("c") & F.col("cpp"), "mixed").when(F.col("c"), "c").when(F.col("cpp"), "cpp").alias("by_include"))
    ups = lambda p: F.transform(F.sequence(F.lit(0), F.size(F.split(p, "/")) - 2), lambda n: F.array_join(F.slice(F.split(p, "/"), F.lit(1), n + 1), "/"))
    near = unit.select(F.explode(ups(F.col("path"))).alias("dir"), "language").groupBy("dir").agg(F.min("language").alias("a"), F.max("language").alias("b"))
    above = heads.withColumn("dir", F.explode(ups(F.col("path")))).join(near, "dir").groupBy("path").agg(F.max_by(F.struct("a", "b"), F.length("dir")).alias("x"))
    return reached.join(above, "path", "left").select("path", F.coalesce("by_include", F.when(F.col("x.a") == F.col("x.b"), F.col("x.a")).when(F.col("x").isNotNull(), "ambiguous"), F.lit("unknown")).alias("language"))


