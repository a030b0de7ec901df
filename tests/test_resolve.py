import random

from pyspark.sql import functions as F


from graphmill.operators import resolve as R

EDGE = "id long, file_id long, target long, name string, method string, definition_path string, definition_line int, definition_character int"
SYM = "id long, file_id long, name string, kind string, start_line int, start_character int, end_line int, end_character int, selection_line int, selection_character int"


def edge(id, name, line=None, char=None, path=None, file=1):
    return (id, file, None, name, "unresolved", path, line, char)


def test_definition_tiers(spark):
    symbols = spark.createDataFrame(
        [(1, 2, "f", "function", 0, 0, 50, 0, None, None), (2, 2, "f", "function", 10, 0, 20, 1, 10, 4), (3, 2, "f", "function", 12, 0, 14, 9, None, None), (4, 2, "g", "function", 5, 0, 8, 0, None, None), (5, 2, "g", "function", 5, 0, 8, 0, None, None)], SYM
    )
    files = spark.createDataFrame([(1, "a.c"), (2, "b.c")], "id long, path string")
    dirty = spark.createDataFrame([("d.c",)], "path string")
    rows = [edge(1, "f", 10, 4, "b.c"), edge(2, "f", 12, 0, "b.c"), edge(3, "f", 13, 2, "b.c"), edge(4, "f", 30, None, "b.c"), edge(5, "g", 5, 0, "b.c"), edge(6, "f", 1, 0, "d.c"), edge(7, "f", 1, 0, "e.c"), edge(8, "h", 1, 0, "b.c"), edge(9, "const f*", 13, 2, "b.c"), edge(10, "f", 99, 0, "b.c")]
    from graphmill.functions.columns import bare_type

    got = {r.id: (r.target, r.method) for r in R.by_definition(spark.createDataFrame(rows, EDGE), symbols, files, dirty, bare_type("name")).collect()}
    d = "lsp_definition"
    assert got == {1: (2, d), 2: (3, d), 3: (3, d), 4: (1, d), 5: (None, "ambiguous_definition"), 6: (None, "overlay_stale"), 7: (None, "external_definition"), 8: (None, "unresolved"), 9: (3, d), 10: (None, "unresolved")}


def test_name_tiers(spark):
    symbols = spark.createDataFrame([(1, 1, "own", "function"), (2, 2, "own", "function"), (3, 2, "one", "class"), (4, 2, "MAX", "macro"), (5, 3, "over", "method"), (6, 3, "over", "method"), (7, 2, "two", "function"), (8, 3, "two", "function"), (9, 2, "mix", "macro"), (10, 3, "mix", "function")], "id long, file_id long, name string, kind string")
    rows = [edge(i, n) for i, n in enumerate(["own", "one", "MAX", "over", "two", "mix", "none", "x.one"], 1)]
    from graphmill.functions.columns import member_name

    e = R.by_name(spark.createDataFrame(rows, EDGE), symbols)
    got = {r.id: (r.target, r.method) for r in R.by_name(e, symbols, member_name("name")).collect()}
    assert got == {1: (1, "name_same_file"), 2: (3, "name_unique"), 3: (None, "unresolved"), 4: (5, "name_single_file"), 5: (None, "unresolved"), 6: (10, "name_unique"), 7: (None, "unresolved"), 8: (3, "name_unique")}


def test_includes_by_suffix(spark):
    files = spark.createDataFrame([(1, "src/a/x.h"), (2, "src/b/x.h"), (3, "lib/u.h"), (4, "src/a/deep/y.h"), (5, "lib/deep/y.h")], "id long, path string")
    imp = spark.createDataFrame([(1, "src/a/m.c", "x.h"), (2, "src/z/m.c", "x.h"), (3, "src/z/m.c", "u.h"), (4, "lib/q.c", "deep/y.h"), (5, "src/a/m.c", "../x.h"), (6, "q.c", "none.h")], "id long, path string, raw string")
    got = {r.id: (r.t, r.m) for r in R.by_include(imp, files).collect()}
    assert got == {1: (1, "include_basename_nearest"), 3: (3, "include_basename_unique"), 4: (5, "include_suffix_nearest")}


def test_imports_by_language(spark):
    paths = ["/r/src/a.ts", "/r/src/b/index.ts", "/r/src/c.tsx", "/r/pkg/m.py", "/r/pkg/n/__init__.py", "/r/src/main/java/p/Q.java", "/r/go/z_test.go", "/r/go/b.go", "/r/go/a.go", "/r/k.c", "/r/k.h", "/r/main.rs", "/r/src/x.java", "/r/cmd/go.go"]
    lang = {"ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "go": "go", "c": "c", "h": "c", "rs": "rust"}
    files = spark.createDataFrame([(i, p, lang[p.rsplit(".", 1)[1]]) for i, p in enumerate(paths)], "id long, path string, language string")
    at = {p: i for i, p in enumerate(paths)}
    cases = [
        ("/r/src/a.ts", "./b", at["/r/src/b/index.ts"], "filesystem_exact"),
        ("/r/src/a.ts", "./c.js", None, "unresolved"),
        ("/r/src/c.tsx", "./a.js", at["/r/src/a.ts"], "filesystem_exact"),
        ("/r/src/a.ts", "react", None, "external_dependency"),
        ("/r/pkg/m.py", ".n", at["/r/pkg/n/__init__.py"], "filesystem_exact"),
        ("/r/pkg/n/__init__.py", "..m", at["/r/pkg/m.py"], "filesystem_exact"),
        ("/r/pkg/m.py", "pkg.n", at["/r/pkg/n/__init__.py"], "filesystem_exact"),
        ("/r/pkg/m.py", "os", None, "external_dependency"),
        ("/r/src/x.java", "p.Q", at["/r/src/main/java/p/Q.java"], "filesystem_exact"),
        ("/r/cmd/go.go", "ex.org/m/go", at["/r/go/a.go"], "filesystem_exact"),
        ("/r/cmd/go.go", "fmt", None, "external_dependency"),
        ("/r/k.c", "k.h", at["/r/k.h"], "filesystem_exact"),
        ("/r/k.c", "<stdio.h>", None, "external_dependency"),
        ("/r/k.c", "made.h", None, "unresolved"),
        ("/r/main.rs", "crate::x", None, "unresolved"),
        ("/r/main.rs", "serde::De", None, "external_dependency"),
    ]
    imports = spark.createDataFrame([(i, at[p], raw, None, "unresolved") for i, (p, raw, _, _) in enumerate(cases)], "id long, file_id long, raw_import string, resolved_id long, resolution_method string")
    got = {r.id: (r.resolved_id, r.resolution_method) for r in R.resolve_imports(imports, files, "/r", "ex.org/m").collect()}
    assert got == {i: (t, m) for i, (_, _, t, m) in enumerate(cases)}


def test_compilation_database_lists(spark):
    units = spark.createDataFrame([("/r/a/x.c", ["/i1"]), ("/r/a/y.c", ["/i1"]), ("/r/b/z.c", ["/i2"])], "path string, includes array<string>")
    files = spark.createDataFrame([(1, "/r/a/x.c"), (2, "/r/a/n.c"), (3, "/r/m.c"), (4, "/r/b/sub/q.c")], "id long, path string")
    got = {r.file_id: r.dir for r in R.include_lists(units, files).collect()}
    assert got == {1: "/i1", 2: "/i1", 4: "/i2"}


def test_nearest_occurrence(spark):
    p = spark.createDataFrame([(1, 1, 5, 10), (2, 1, 5, 18), (3, 1, 7, 0), (4, 1, 9, 0)], "point_id long, file_id long, line int, character int")
    o = spark.createDataFrame([(1, 1, 5, 8, 5, 12), (2, 1, 5, 20, 5, 22), (3, 1, 6, 0, 8, 1)], "occ_id long, file_id long, start_line int, start_character int, end_line int, end_character int")
    got = {r.point_id: r.occ_id for r in R.nearest_occurrence(p, o.withColumnRenamed("file_id", "file_id")).collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def brute_nearest(points, occurrences, most=5):
    out = {}
    for pid, file, line, char in points:
        ranks = []
        for oid, f, l0, c0, l1, c1 in occurrences:
            if f != file or not l0 <= line <= l1:
                continue
            if l0 == l1 and c0 <= char < c1:
                ranks.append((0, oid))
            elif line == l0 and abs(char - c0) <= most:
                ranks.append((abs(char - c0) + 1, oid))
            elif l0 < l1:
                ranks.append((most + 2, oid))
        if ranks:
            out[pid] = min(ranks)[1]
    return out


def test_nearest_occurrence_equals_brute_force(spark):
    rng = random.Random(4)
    points = [(i, rng.randrange(3), rng.randrange(30), rng.randrange(60)) for i in range(500)]
    occurrences = []
    for i in range(400):
        line, char = rng.randrange(30), rng.randrange(60)
        more = rng.choice([0, 0, 0, 0, 1, 3, 17])
        occurrences.append((rng.randrange(10**6), rng.randrange(3), line, char, line + more, rng.randrange(60) if more else char + rng.choice([0, 1, 2, 5, 30, -3])))
    p = spark.createDataFrame(points + [(1000, 1, None, None), (1001, None, 1, 1)], "point_id long, file_id long, line int, character int")
    o = spark.createDataFrame(occurrences + [(5, 1, None, 1, 1, 1), (6, None, 1, 1, 1, 1)], "occ_id long, file_id long, start_line int, start_character int, end_line int, end_character int")
    assert {r.point_id: r.occ_id for r in R.nearest_occurrence(p, o).collect()} == brute_nearest(points, occurrences)
    assert R.nearest_occurrence(p, o.limit(0)).collect() == [] == R.nearest_occurrence(p.limit(0), o).collect()


def test_a_large_file_of_points_and_occurrences_makes_no_product(spark):
    n = 200_000  # all in one file, a half on one line
    k = F.col("id")
    line = F.when(k % 2 == 0, 0).otherwise(k).cast("int")
    p = spark.range(n).select(k.alias("point_id"), F.lit(1).cast("long").alias("file_id"), line.alias("line"), (k * 4 + 1).cast("int").alias("character"))
    o = spark.range(n).select(k.alias("occ_id"), F.lit(1).cast("long").alias("file_id"), line.alias("start_line"), (k * 4).cast("int").alias("start_character"), line.alias("end_line"), (k * 4 + 3).cast("int").alias("end_character"))
    assert R.nearest_occurrence(p, o).where("point_id <> occ_id").count() == 0 and R.nearest_occurrence(p, o).count() == n


def brute_include(imports, files):
    out = {}
    for id_, src, raw in imports:
        ends = [(t, p) for t, p in files if ("/" + p.lstrip("/")).endswith("/" + raw)]
        here = src.lstrip("/").split("/")[:-1]

        def depth(p):
            n = 0
            for a, b in zip(here, p.lstrip("/").split("/")[:-1]):
                if a != b:
                    break
                n += 1
            return n

        best = max((depth(p) for _, p in ends), default=None)
        top = [t for t, p in ends if depth(p) == best]
        if len(top) == 1:
            out[id_] = (top[0], f"include_{'suffix' if '/' in raw else 'basename'}_{'unique' if len(ends) == 1 else 'nearest'}")
    return out


def test_includes_equal_brute_force(spark):
    rng = random.Random(9)
    path = lambda name: rng.choice(["", "/"]) + "/".join([rng.choice("abc") for _ in range(rng.randint(0, 4))] + [name])
    files = [(i, path(rng.choice(["x.h", "y.h", "z.h"]))) for i in range(120)]
    imports = [(i, path(f"m{i % 7}.c"), "/".join([rng.choice("abc") for _ in range(rng.choice([0, 0, 1, 2]))] + [rng.choice(["x.h", "y.h", "none.h"])])) for i in range(200)]
    got = R.by_include(spark.createDataFrame(imports, "id long, path string, raw string"), spark.createDataFrame(files, "id long, path string"))
    assert {r.id: (r.t, r.m) for r in got.collect()} == brute_include(imports, files)


def test_many_files_of_one_name_make_no_product(spark):
    n = 50_000
    d = F.concat(F.lit("src/d"), (F.col("id") % 300).cast("string"), F.lit("/e"), F.col("id").cast("string"))
    files = spark.range(n).select("id", F.concat(d, F.lit("/index.h")).alias("path"))
    imports = spark.range(n).select("id", F.concat(d, F.lit("/m.c")).alias("path"), F.lit('"index.h"').alias("raw"))
    got = R.by_include(imports, files)
    assert got.where("id = t and m = 'include_basename_nearest'").count() == n


def test_local_crates():
    from graphmill.plans.build import local_crates

    text = """[package]
name = "my-app"
[lib]
name = "my_lib"
[dependencies]
serde = "1"
local = { path = "../l", version = "1" }
[target.'cfg(unix)'.dev-dependencies]
unix-only = { path = "u" }
[workspace.dependencies]
shared-core = { path = "core" }
"""
    assert local_crates(text) == {"my_app", "my_lib", "local", "unix_only", "shared_core"}
    assert local_crates("not [ toml") == set() == local_crates("package = 1")
