import json

import pytest
from pyspark.sql import functions as F

from graphmill import schema
from graphmill.operators import health as H
from graphmill.operators import retrieval as R
from graphmill.plans import build as B
from graphmill.plans import tools as T
from graphmill.storage import Index, ignore, open_index, replace
from graphmill.streaming import changes as X

SRC = "def main():\n    helper()\n    MAX\n\ndef helper():\n    pass\n"


def tables(spark):
    def make(table, rows):
        cols = [f.name for f in schema.struct(table)]
        return schema.conform(spark.createDataFrame([{c: r.get(c) for c in cols if c in r} for r in rows], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.struct(table) if f.name in rows[0])), table)

    return {
        "files": make("files", [{"id": 1, "path": "app/a.py", "branch": "main", "language": "python", "source": SRC, "indexed_at": 5}, {"id": 2, "path": "lib/b.py", "branch": "main", "language": "python", "source": "x = 1\n", "indexed_at": 5}]),
        "symbols": make("symbols", [{"id": 1, "file_id": 1, "name": "main", "kind": "function", "start_line": 0, "end_line": 2, "is_exported": True, "signature": "def main()"}, {"id": 2, "file_id": 1, "name": "helper", "kind": "function", "start_line": 4, "end_line": 5, "is_exported": True, "signature": "def helper()"}, {"id": 3, "file_id": 2, "name": "MAX", "kind": "constant", "start_line": 0, "end_line": 0, "is_exported": False, "signature": "x = 1"}]),
        "symbol_refs": make("symbol_refs", [{"id": 1, "caller_id": 1, "file_id": 1, "callee_name": "helper", "call_line": 1}, {"id": 2, "caller_id": 1, "file_id": 1, "callee_name": "MAX", "call_line": 2}]),
        "file_imports": make("file_imports", [{"id": 1, "file_id": 1, "raw_import": "lib.b"}, {"id": 2, "file_id": 1, "raw_import": "os"}]),
    }


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, str(tmp_path / "index"))


def test_build_promotes_and_overlay_updates(spark, index):
    run = B.build(index, tables(spark), "main", clock=lambda: 100)
    assert run["status"] == "success" and index.state()["promoted"] == {"main": 1}
    open_index(spark, index.root)
    refs = {r.id: (r.callee_id, r.resolution_method) for r in index.raw("symbol_refs").collect()}
    assert refs == {1: (2, "name_same_file"), 2: (None, "unresolved")}
    imports = {r.raw_import: (r.resolved_id, r.resolution_method) for r in index.raw("file_imports").collect()}
    assert imports == {"lib.b": (2, "filesystem_exact"), "os": (None, "external_dependency")}
    change = spark.createDataFrame([("app/a.py", "python", "new\n", False, 1), ("app/a.py", "python", "newer\n", False, 2), ("lib/b.py", "python", None, True, 1), ("lib/c.py", "python", "c\n", False, 1)], X.CHANGE)
    assert X.update_overlay(index, change, "main", 200) == 3
    assert sorted(r.path for r in index.dirty_files().collect()) == ["app/a.py", "lib/b.py", "lib/c.py"]
    assert {r.path: r.source for r in X.visible(index).collect()} == {"app/a.py": "newer\n", "lib/c.py": "c\n"}
    assert X.update_overlay(index, change.where("path = 'lib/c.py'"), "main", 300) == 0
    assert index.freshness(250) == {"source": "mixed", "age_seconds": 50, "dirty_files": 3}
    again = B.build(index, tables(spark), "main", clock=lambda: 400)
    assert again["generation"] == 2 and index.freshness()["source"] == "baseline"
    assert {r.generation for r in index.raw("files").collect()} == {2}
    assert not index.promote("main", 1)


def test_rejected_and_failed_builds_change_nothing(spark, index):
    run = B.build(index, {"files": tables(spark)["files"]}, "main", policy=H.Policy.of(required_globs=("src/**",)))
    assert run["status"] == "rejected" and "REQUIRED_GLOB_UNMATCHED" in run["error"] and index.state()["promoted"] == {}

    def fail(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        B.build(index, tables(spark), "main", stages=[B.Step("x", fail)])
    assert [r["status"] for r in B.runs(index)] == ["rejected", "failed"]
    index.acquire("me")
    with pytest.raises(RuntimeError):
        index.acquire("you")


def test_crashes_leave_the_old_or_the_new_state(spark, index, monkeypatch):
    B.build(index, tables(spark), "main", clock=lambda: 100)
    change = spark.createDataFrame([("app/a.py", "python", "new\n", False, 1)], X.CHANGE)
    old = {r.path: r.source for r in X.visible(index).collect()}
    whole = [(Index, "write"), (Index, "mark_dirty"), (Index, "_save"), (type(index.files), "add")]
    for owner, name in whole:  # each step fails before it does anything
        with monkeypatch.context() as m:
            m.setattr(owner, name, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                X.update_overlay(index, change, "main", 200)
        assert {r.path: r.source for r in X.visible(index).collect()} == old
    X.update_overlay(index, change, "main", 200)
    new = {r.path: (r.id, r.source) for r in X.visible(index).collect()}
    assert new["app/a.py"][1] == "new\n" and new.keys() == old.keys()
    assert X.update_overlay(index, change, "main", 201) == 0  # delivered again
    assert {r.path: (r.id, r.source) for r in X.visible(index).collect()} == new
    stale = index.state()
    index.mark_dirty(["x"], "main", 1)
    with pytest.raises(RuntimeError, match="another writer"):
        index._save(stale)


def test_build_from_sources(spark, index, tmp_path):
    root = tmp_path / "src"
    for path, text in {"go.mod": "module example.org/m\n", "pkg/a.go": "package a\n", "main.go": "package main\n", "c/a.c": '#include "x.h"\n#include <lib.h>\n', "c/x.h": "int f();\n", "inc/lib.h": "int g();\n", "bad.py": b"caf\xe9\n", "r/Cargo.toml": '[package]\nname = "my-crate"\n', "node_modules/n.py": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())
    units = spark.createDataFrame([("c/a.c", ["/inc"])], "path string, includes array<string>")
    assert B.build_sources(index, str(root), "main", units=units, clock=lambda: 9)["status"] == "success"
    f = {r.path: r for r in index.raw("files").collect()}
    assert set(f) == {"pkg/a.go", "main.go", "c/a.c", "c/x.h", "inc/lib.h", "bad.py"} and f["bad.py"].source == "caf\ufffd\n"
    got = {r.raw_import: (r.resolved_id, r.resolution_method) for r in index.raw("file_imports").collect()}
    assert got["x.h"] == (f["c/x.h"].id, "filesystem_exact") and got["<lib.h>"][0] == f["inc/lib.h"].id
    p = B.Project.of(B.manifests(spark, str(root)))
    assert p.go_module == "example.org/m" and p.crates == ("my_crate",)
    imports = schema.conform(spark.createDataFrame([(1, f["main.go"].id, "example.org/m/pkg"), (2, f["main.go"].id, "fmt")], "id long, file_id long, raw_import string"), "file_imports")
    t = B.ingest_imports({"files": index.raw("files"), "file_imports": imports}, p)["file_imports"]
    assert {r.raw_import: (r.resolved_id, r.resolution_method) for r in t.collect()} == {"example.org/m/pkg": (f["pkg/a.go"].id, "filesystem_exact"), "fmt": (None, "external_dependency")}


def test_stream_of_changes(spark, index, tmp_path):
    B.build(index, tables(spark), "main")
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"path":"n.py","language":"python","source":"n","deleted":false,"seq":1}\n')
    q = X.follow(index, X.change_files(spark, str(inbox)), "main", str(tmp_path / "cp"), lambda: 7)
    q.awaitTermination(120)
    assert q.exception() is None and "n.py" in {r.path for r in X.visible(index).collect()}


def test_tools(spark):
    t = B.run_stages({k: schema.empty(spark, k) for k in schema.TABLES} | tables(spark))
    provider = R.HashingProvider(16)
    vectors = R.embedded(R.symbol_texts(t["symbols"]), provider)
    e = T.Engine(t, vectors=vectors, embed=lambda q: provider.embed([q])[0].tolist())
    out = json.loads(T.call(e, "lookup", symbol="MAIN"))
    assert out["symbols"][0]["start_line"] == 1 and out["freshness"]["source"] == "baseline"
    assert T.call(e, "snippet", symbol="helper") and json.loads(T.call(e, "snippet", symbol="helper"))["text"] == "def helper():\n    pass"
    assert [s["name"] for s in json.loads(T.call(e, "trace", entry="main"))["steps"]] == ["main", "helper"]
    assert [c["name"] for c in json.loads(T.call(e, "dependents", symbol="helper"))["callers"]] == ["main"]
    assert [(x["src_name"], x["dst_name"]) for x in json.loads(T.call(e, "graph", source="main", hops=2))["edges"]] == [("main", "helper")]
    for mode in ("structural", "semantic", "fused"):
        r = json.loads(T.call(e, "search", query="helper", mode=mode))
        assert r["mode_used"] == mode and r["results"][0]["name"] == "helper"
    assert json.loads(T.call(e, "lookup", symbol="nothing"))["symbols"] == []
    assert "error" in json.loads(T.call(e, "trace", entry="nothing"))
    assert set(json.loads(T.call(e, "structure"))) >= {"cycles", "outliers"}
    assert json.loads(T.call(e, "cohesion"))["directories"][0]["internal_edges"] == 1


def test_health_report(spark):
    t = B.run_stages({k: schema.empty(spark, k) for k in schema.TABLES} | tables(spark))
    r = H.report(t)
    assert r["healthy"] and r["numbers"]["symbols"] == 3 and r["numbers"]["internal_unresolved"] == 1 and r["numbers"]["calls_rate"] == 0.5
    strict = H.report(t, H.Policy.of("strict", minima={"minCallResolutionRate": 0.9, "minTypeResolutionRate": 0.1}, required_symbols=(("app/a.py", "main"), ("app/a.py", "gone")), required_calls=(("main", "helper"),)))
    assert not strict["healthy"] and {i["code"] for i in strict["issues"]} >= {"THRESHOLD_MIN_CALL_RESOLUTION_RATE", "THRESHOLD_MIN_TYPE_RESOLUTION_RATE", "REQUIRED_SYMBOL_MISSING"} and "REQUIRED_CALL_MISSING" not in {i["code"] for i in strict["issues"]}


def test_span_rules(spark):
    rows = [(None, None, 1, None, None, None), (-1, None, 1, None, None, None), (2, 0, 1, 0, None, None), (1, 5, 1, 2, None, None), (0, None, 9, None, None, None), (0, 4, 1, 0, None, None), (0, 0, 1, 1, 5, None), (0, 0, 1, 1, None, 2), (0, 1, 1, 1, 0, 0), (0, 0, 1, 1, 1, 1), (0, 0, 1, 1, 0, 1)]
    df = spark.createDataFrame([(i, *r, [3, 1]) for i, r in enumerate(rows)], "i int, start_line int, start_character int, end_line int, end_character int, selection_line int, selection_character int, lengths array<int>")
    got = [r.w for r in df.withColumn("w", H.span_reason()).orderBy("i").collect()]
    assert got == ["missing line coordinate", "negative line coordinate", "end precedes start", "end character precedes start", "line coordinate is outside the stored source snapshot", "start character is outside the UTF-16 line length", "selection line is outside the symbol span", "selection character has no selection line", "selection character precedes the symbol span", None, None]


def test_upserts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "z"), (3, "z2")], "k int, v string")
    assert sorted(map(tuple, replace(a, b.where("v <> 'z2'"), ["k"]).collect())) == [(1, "x"), (2, "new"), (3, "z")]
    assert sorted(map(tuple, ignore(a, b, ["k"]).collect())) == [(1, "x"), (2, "y"), (3, "z")]


def test_phrases_and_fusion(spark):
    docs = spark.createDataFrame([(1, "read_file", "read file read file", "f"), (2, "file_read", "file", "f"), (3, "x", "Readfile", "f"), (4, "read", "a file", "f")], "id long, name string, signature string, kind string")
    got = [r.id for r in R.bm25(docs, "Read File", ["name", "signature", "kind"]).collect()]
    assert got == [1] and R.bm25(docs, "!!", ["name"]).collect() == []
    a = spark.createDataFrame([(1, -3.0), (2, -2.0)], "id long, score double")
    b = spark.createDataFrame([(2, 0.1), (3, 0.2)], "id long, distance double")
    assert [r.id for r in R.fused(a, b).collect()] == [2, 1, 3]
    assert R.batches_by_tokens([5, 5, 20, 1], 10, 3) == [(0, 2), (2, 3), (3, 4)]


def test_embeddings_are_kept(spark):
    t = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "")], "id long, text string")
    first = R.embedded(t, R.HashingProvider(8))
    known = spark.createDataFrame([(r.id, [9.0] * 8, r.content_hash) for r in first.collect()], "id long, embedding array<float>, content_hash string")
    got = {r.id: r.embedding[0] for r in R.embedded(t.withColumn("text", F.when(F.col("id") == 2, "delta").otherwise(F.col("text"))), R.HashingProvider(8), known).collect()}
    assert got[1] == 9.0 and got[2] != 9.0 and 3 not in got


def test_schema_status():
    full = {t: schema.struct(t) for t in schema.TABLES}
    assert schema.inspect(full, schema.VERSION) == "current" and schema.inspect(full, 99) == "newer" and schema.inspect({}, None) == "missing"
    assert schema.inspect(full | {"commits": schema.struct("files")}, schema.VERSION) == "outdated"


def test_files_by_prefix_gives_all_files_without_a_limit(spark):
    from graphmill.operators import lookups as L

    f = spark.range(1500).select("id", F.concat(F.lit("/a/"), F.col("id").cast("string")).alias("path"), F.lit("main").alias("branch"))
    assert L.files_by_prefix(f, "/a/").count() == 1500 and L.files_by_prefix(f, "/a", limit=20).count() == 20


def test_line_lengths_are_never_broadcast(spark):
    rows = spark.range(4).select("id", F.col("id").alias("file_id"), F.col("id").cast("int").alias("start_line"), F.lit(0).alias("start_character"), F.col("id").cast("int").alias("end_line"), F.lit(3).alias("end_character"), *(F.lit(None).cast("int").alias(c) for c in ("selection_line", "selection_character")))
    files = spark.range(4).select("id", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("abc\n"), 3)).otherwise(F.repeat(F.lit("é😀\n"), 3)).alias("source"))
    got = H.invalid_spans(rows, files)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in got.orderBy("id").collect()] == [3]


def test_line_lengths_go_only_to_rows_with_characters(spark):
    none = F.lit(None).cast("int")
    files = spark.range(6).select("id", F.when(F.col("id") < 4, F.repeat(F.lit("ab\n"), 3)).alias("source"))  # the others have no source
    plain = spark.range(8).select("id", F.col("id").alias("file_id"), (F.col("id") * 2).cast("int").alias("start_line"), none.alias("start_character"), (F.col("id") * 2).cast("int").alias("end_line"), none.alias("end_character"), none.alias("selection_line"), none.alias("selection_character"))
    got = H.invalid_spans(plain, files)
    assert "transform" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.id for r in got.orderBy("id").collect()] == [2, 3, 4, 5, 6, 7]
    with_ends = plain.withColumn("end_character", F.when(F.col("id") == 1, 5).when(F.col("id") == 0, 2))
    assert [(r.id, r.reason[:13]) for r in H.invalid_spans(with_ends, files).where("id < 3").orderBy("id").collect()] == [(1, "end character"), (2, "line coordina")]
