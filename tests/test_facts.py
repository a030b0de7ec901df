"""Supplements, header languages, diagnostics, polling, scopes and index files."""

from pyspark.sql import functions as F

from graphmill.operators import commits as C
from graphmill.operators import health as H
from graphmill.operators import ingest as I
from graphmill.operators import resolve as R
from graphmill.operators import retrieval as S
from graphmill.sources import scip
from graphmill.streaming import changes as X

SYM = "id long, file_id long, name string, kind string, start_line int, start_character int, end_line int, end_character int, selection_line int, selection_character int"


def put(k, v):
    def n(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(v, int):
        return n(k << 3) + n(v)
    v = v.encode() if isinstance(v, str) else v
    return n(k << 3 | 2) + n(len(v)) + v


def test_index_files(spark, tmp_path):
    occ = put(1, bytes([2, 4, 7])) + put(2, "s m p v f().") + put(3, 1) + put(7, bytes([2, 0, 9, 1]))
    info = put(1, "s m p v f().") + put(3, "doc") + put(4, put(1, "i") + put(3, 1)) + put(5, 17)
    doc = put(1, "a.c") + put(2, occ) + put(3, info) + put(4, "C") + put(5, "text")
    (tmp_path / "index.scip").write_bytes(put(1, put(1, 0)) + put(2, doc) + put(2, put(1, "b" * 200)))
    docs = scip.documents(spark, str(tmp_path))
    a = {r.path: r for r in docs.collect()}
    assert a["a.c"].occurrences[0].range == [2, 4, 7] and a["a.c"].symbols[0].relationships[0].is_implementation and len(a) == 2
    files = spark.createDataFrame([(1, "a.c")], "id long, path string")
    assert I.definitions(scip.occurrences(docs, files), scip.informations(docs)).first().end_line == 9
    p = spark.createDataFrame([("/i/index.scip",), ("/i/go.scip",), ("/j/go.scip",)], "path string")
    assert [r.path for r in scip.precomputed(p, "/i", ["go"]).collect()] == ["/i/index.scip"]
    assert [r.path for r in scip.precomputed(p, "/j", ["go"]).collect()] == ["/j/go.scip"]


def test_header_languages(spark):
    files = spark.createDataFrame([("a/x.c", "c"), ("a/x.h", "c"), ("b/y.cpp", "cpp"), ("b/y.h", "c"), ("b/both.h", "c"), ("a/near.h", "c"), ("c/lone.h", "c")], "path string, language string")
    inc = spark.createDataFrame([("a/x.c", "a/x.h"), ("a/x.h", "b/both.h"), ("b/y.cpp", "b/y.h"), ("b/y.cpp", "b/both.h")], "src string, dst string")
    got = {r.path: r.language for r in R.header_language(files, inc).collect()}
    assert got == {"a/x.h": "c", "b/y.h": "cpp", "b/both.h": "mixed", "a/near.h": "c", "c/lone.h": "unknown"}


def test_supplements(spark):
    files = spark.createDataFrame([(1, "b", "c"), (2, "a", "c"), (3, "c", "c"), (4, "d", "c")], "id long, path string, language string")
    symbols = spark.createDataFrame([(1, 1, "f", "function", 1, 0, 1, 0, 1, 0), (2, 4, "g", "function", 1, 0, 5, 0, 1, 2)], SYM)
    sourced = spark.createDataFrame([("a",), ("b",), ("d",)], "path string")
    assert [(r.path, r.reason) for r in I.supplement_plan(files, symbols, sourced).collect()] == [("c", 0), ("a", 1), ("b", 2)]
    served = spark.createDataFrame([(10, 4, "g", "function", 4, 0, 9, 0, 4, 1), (11, 4, "g", "function", 8, 0, 9, 0, 8, 1), (12, 4, "h", "function", 1, 0, 5, 0, 1, 2)], SYM)
    assert sorted(r.id for r in I.supplements(served, symbols).collect()) == [11, 12]
    points = spark.createDataFrame([(1, "d", "m", "g", "function", 1, 2), (2, "d", "m", "g", "function", 1, 0), (3, "d", "m", "g", "function", 2, 0)], "point_id long, path string, branch string, name string, kind string, line int, character int")
    assert sorted(tuple(r) for r in I.exact_callee(points, symbols, files.withColumn("branch", F.lit("m"))).collect()) == [(1, 2), (2, 2)]


def test_enrichment_and_declarations(spark):
    rows = spark.createDataFrame([(1, "unresolved", None), (2, "unresolved", "p"), (3, "name_unique", None)], "id long, resolution_method string, definition_path string")
    facts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, definition_path string")
    assert {r.id: r.definition_path for r in I.enriched(rows, facts, ["definition_path"], only_open=True).collect()} == {1: "x", 2: "p", 3: None}
    refs = spark.createDataFrame([(1, 5, "a.h", 3, "f"), (2, 5, "a.h", 8, "f"), (3, 6, "a.c", 3, "f")], "point_id long, file_id long, path string, line int, symbol string")
    fn = spark.createDataFrame([("f", 9)], "symbol string, id long")
    bodies = spark.createDataFrame([(5, 7, 9)], "file_id long, start_line int, end_line int")
    assert [r.point_id for r in I.header_declarations(refs, fn, bodies).collect()] == [1]
    macros = spark.createDataFrame([(5, "A", 0, 1, []), (5, "B", 3, 3, ["defined(X)"]), (5, "C", 4, 4, ["defined(X)"])], "file_id long, name string, line int, end_line int, conditions array<string>")
    served = spark.createDataFrame([(7, 5, "B", 3)], "id long, file_id long, name string, start_line int")
    assert sorted((r.name, r.origin) for r in I.macro_symbols(macros, served).collect()) == [("A", "text"), ("B", "matched")]


def test_diagnostics_and_scope(spark):
    log = spark.createDataFrame([("a.c:3:4: error: bad",), ("a.c:5: warning: meh",), ("7 errors generated.",), ("failed to index b.c",), ("ok",)], "value string")
    tally, samples = H.diagnostics(log)
    assert tuple(tally.first()) == (7, 1, 0, 1) and samples.count() == 2
    scoped = spark.createDataFrame([("a", "c"), ("b", "go")], "path string, language string")
    cover = spark.createDataFrame([("a", "c", "success", "baseline", True), ("b", "go", "failed", "baseline", True)], "path string, language string, status string, layer string, current boolean")
    prov = spark.createDataFrame([("c", "x")], "language string, provider string")
    assert H.scope_issues(scoped, None, cover, prov) == ["SCIP_SCOPE_PROVENANCE_MISSING"]
    assert H.scope_issues(scoped, scoped.limit(1), cover, prov) == ["SCIP_SCOPE_MISMATCH", "SCIP_SCOPE_UNCOVERED_FILES", "SCIP_SCOPE_INDEXER_MISSING"]
    one = H.scope(scoped, None, [], ["b"]).collect()
    assert len(one) == 1 and one[0].digest == H.scope(scoped, ["c"], [], []).first().digest


def test_risk_and_cosine(spark):
    commits = spark.createDataFrame([("1", "a", "a@", 1_000_000, "m"), ("2", "b", "b@", 1_100_000, "m")], "sha string, author string, author_email string, timestamp long, message string")
    files = spark.createDataFrame([("1", "f", 100, None), ("2", "f", 60, -5)], "commit_sha string, file_path string, insertions long, deletions long")
    r = C.risk(commits, files, 1_100_000 + 30 * 86400).first()
    assert (r.churn, r.recency, r.dispersion, r.churn_level, r.overall) == (160, "medium", "high", "medium", "high")
    v = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "id long, embedding array<float>")
    assert [(x.id, round(x.distance, 6)) for x in S.nearest(v, [1.0, 0.0], metric="cosine").collect()] == [(1, 0.0), (2, 1.0)]
    assert [x.id for x in S.nearest(v, [1.0, 0.0], most=1.2).collect()] == [1]


def test_query_cache_forgets():
    now, asked = [0.0], []
    cache = S.QueryCache(lambda t: asked.append(t) or [1.0], lambda: now[0], most=2, age=10)
    for t in ("a", "a", "b", "c", "a"):
        cache(t)
    now[0] = 11
    cache("a")
    assert asked == ["a", "b", "c", "a", "a"]


def test_a_build_keeps_stated_relationships_and_imports(spark, tmp_path):
    from graphmill.plans import build as B
    from graphmill.storage import Index

    root = tmp_path / "src"
    root.mkdir()
    for name in ("a.ts", "b.ts"):
        (root / name).write_text("class X {\n m() {}\n}\n")
    occ = "path string, range array<int>, symbol string, symbol_roles int, enclosing_range array<int>, syntax_kind int"
    rows = [
        ("a.ts", [0, 6, 7], "s m v lib A#", 1, [0, 0, 2, 1], 0), ("a.ts", [1, 1, 2], "s m v lib A#m().", 1, [1, 0, 1, 7], 0),
        ("b.ts", [0, 6, 7], "s m v lib B#", 1, [0, 0, 2, 1], 0), ("b.ts", [1, 1, 2], "s m v lib B#m().", 1, [1, 0, 1, 7], 0),
        ("b.ts", [0, 9, 10], "s m v lib A#", 2, [], 0), ("b.ts", [0, 20, 21], "lone", 2, [], 0), ("b.ts", [1, 3, 4], "s m v lib A#m().", 0, [], 15),
    ]
    info = "path string, symbol string, documentation array<string>, display_name string, kind int, relationships array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean>>"
    infos = [("a.ts", "s m v lib A#", ["interface A"], "", 0, []), ("b.ts", "s m v lib B#", ["class B"], "", 0, [("s m v lib A#", True, True, False, False), ("", False, True, False, False)])]

    def facts(files):
        own = files.select(F.col("id").alias("file_id"), "path")
        return tuple(spark.createDataFrame(r, s).join(own, "path").drop("path") for r, s in ((rows, occ), (infos, info)))

    index = Index(spark, str(tmp_path / "index"))
    assert B.build_sources(index, str(root), "main", occurrences=facts, clock=lambda: 1)["status"] == "success"
    names = {r.id: r.name for r in index.raw("symbols").collect()}
    rel = index.raw("symbol_relationships").collect()
    assert [(names[r.source_symbol_id], names[r.target_symbol_id], r.relationship_type, r.definition_path) for r in rel] == [("B", "A", "implements", "a.ts")]
    paths = {r.id: r.path for r in index.raw("files").collect()}
    assert {(paths[r.file_id], r.raw_import, paths.get(r.resolved_id)) for r in index.raw("file_imports").collect()} == {("b.ts", "lib", "a.ts"), ("b.ts", "lone", None)}
    calls = {(names[r.caller_id], names[r.callee_id], r.call_kind) for r in index.raw("symbol_refs").collect()}
    assert ("m", "m", "virtual") in calls  # dispatch follows from the relationship
