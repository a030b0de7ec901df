"""Steps whose shuffles or tasks once grew faster than their tables: results on odd rows, and the plans that keep them small."""

import os

import pytest
from pyspark.sql import functions as F

from graphmill import adapters as A
from graphmill.operators import edges as E
from graphmill.operators import lookups as L
from graphmill.operators import resolve as R
from graphmill.operators import visibility as V

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_resolved_calls_are_not_joined_with_themselves(spark):
    assert optimized(A.calls(spark, SF)).count("Join") == 4  # a count, the caller's file, the names, the file's names


def test_settled_and_unknown_names(spark):
    edges = spark.createDataFrame([(1, 1, None, "a", "unresolved"), (2, 1, 9, "a", "given"), (3, 1, None, "a", None), (4, 1, None, None, "unresolved"), (5, 1, None, "b", "unresolved"), (6, 8, None, "a", "unresolved"), (7, 1, None, "zz", "unresolved")], "id long, file_id long, target long, name string, method string")
    symbols = spark.createDataFrame([(10, 1, "a", "function"), (11, 2, "b", "function"), (12, 2, "b", "class")], "id long, file_id long, name string, kind string")
    files = spark.createDataFrame([(1, "/1", "m"), (2, "/2", "m"), (3, "/3", "n")], "id long, path string, branch string")
    want = [(1, 10, "name_same_file"), (2, 9, "given"), (3, None, None), (4, None, "unresolved"), (5, 11, "name_single_file"), (6, None, "unresolved"), (7, None, "unresolved")]
    assert rows(R.by_name(edges, symbols, files=files).select("id", "target", "method")) == want
    assert rows(R.by_name(edges, symbols, F.col("name"), files).select("id", "target", "method")) == want


def test_overridden_calls_read_calls_once(spark, tmp_path):
    calls = [(1, 5, "f", 3, None, 1), (1, 6, "g", 3, None, 1), (2, 5, "f", 4, 1, 1), (2, 6, "g", 4, 2, 1), (3, 5, "f", None, None, 2), (3, 6, "g", None, None, 2), (3, None, "h", 1, 1, 2), (4, 7, "k", 1, 1, 2), (2, 5, "f", 4, 1, 1)]
    path = str(tmp_path / "calls")
    spark.createDataFrame(calls, "caller_id long, callee_id long, callee_name string, call_line int, call_character int, file_id long").write.parquet(path)
    over = spark.createDataFrame([(5, 6), (5, 7), (5, 6), (5, None), (6, 5)], "interface_id long, concrete_id long")
    got = E.virtual_dispatch(spark.read.parquet(path), over)
    want = set()
    for c, t, n, l, h, f in calls:
        for i, k in {(5, 6), (5, 7), (5, None), (6, 5)}:
            if i == t and not any(x[0] == c and x[1] == k and l is not None and x[3] == l and x[4] == h for x in calls if k is not None):
                want.add((c, k, n, l, h, f))
    assert rows(got) == sorted(want, key=str)
    assert optimized(got).count("caller_id#") and optimized(got).count("callee_name#") and optimized(got).split("Relation [").__len__() == 2


def test_edges_without_a_path_do_not_look_for_it(spark):
    edges = spark.createDataFrame([(1, 1, 7, "x", None), (2, 1, 8, "x", None), (3, 1, None, "overlay_stale", "/1"), (4, 1, None, "overlay_stale", "/gone"), (5, 1, None, "overlay_stale", None), (6, 1, None, None, "/1")], "id long, file_id long, callee_id long, resolution_method string, definition_path string")
    files = spark.createDataFrame([(1, "/1", "m")], "id long, path string, branch string")
    got = V.reconcile(edges, "callee_id", spark.createDataFrame([(7,)], "id long"), files)
    assert rows(got.select("id", "callee_id", "resolution_method")) == [(1, 7, "x"), (2, None, "unresolved"), (3, None, "unresolved"), (4, None, "overlay_stale"), (5, None, "overlay_stale"), (6, None, None)]
    assert "isnotnull(definition_path" in optimized(got)


def test_samples_of_directories_after_the_cut(spark):
    files = spark.createDataFrame([(i, f"/{'ab'[i % 2]}/{i}.py", "m") for i in range(10)], "id long, path string, branch string")
    imports = spark.createDataFrame([(0, 1), (0, 1), (0, 1), (0, 3), (0, 5), (0, 7), (2, 1), (1, 3), (4, None)], "file_id long, resolved_id long")
    got = E.directory_graph(imports, files, 2)
    assert [(r["from_dir"], r["to_dir"], r["count"], r["sample_files"]) for r in got.collect()] == [("/a", "/b", 7, ["/a/0.py → /b/1.py", "/a/0.py → /b/3.py", "/a/0.py → /b/5.py"])]
    plan = optimized(got)
    assert plan.index("concat_ws") < plan.index("dense_rank")


def test_ranges_of_names_are_not_sorted(spark):
    symbols = spark.createDataFrame([(1, 1, "a", 1, 2, None, "f"), (2, 1, "B", 3, None, None, "f"), (3, 1, "b", 5, 6, None, "f")], "id long, file_id long, name string, start_line int, end_line int, parent_symbol_id long, kind string")
    files = spark.createDataFrame([(1, "/1", "m", "py")], "id long, path string, branch string, language string")
    names = spark.createDataFrame([("A",), ("b",), ("c",), (None,)], "name string")
    got = L.symbol_ranges(symbols, files, names)
    assert rows(got) == [("A", "resolved", 1, 1, "/1", 1, 2), ("b", "ambiguous", 2, None, None, None, None), ("c", "missing", 0, None, None, None, None), (None, "missing", 0, None, None, None, None)]
    assert "SortAggregate" not in got.select("name", "outcome", "candidates", "id")._jdf.queryExecution().executedPlan().toString()


def test_task_size_of_the_session_stays(spark):
    from graphmill import storage

    before = {k: spark.conf.get(k, None) for k in storage.SIZES}
    try:
        for k in storage.SIZES:
            spark.conf.unset(k)
        storage.small_tasks(spark)
        assert {k: spark.conf.get(k) for k in storage.SIZES} == storage.SIZES
        for k in storage.SIZES:
            spark.conf.set(k, "3")
        storage.small_tasks(spark)
        assert {spark.conf.get(k) for k in storage.SIZES} <= {"3", "3.0", "3b"}
    finally:
        for k, v in before.items():
            spark.conf.unset(k)
            if v is not None:
                spark.conf.set(k, v)


def test_candidates_of_an_edge_are_dealt_once(spark):
    s = "id long, file_id long, name string, start_line int, end_line int, start_character int, end_character int, selection_line int, selection_character int"
    symbols = spark.createDataFrame([(1, 1, "a", 0, 9, 0, 0, None, None), (2, 1, "a", 2, 3, 0, 0, None, None), (2, 1, "a", 2, 3, 0, 0, None, None)], s)
    files = spark.createDataFrame([(1, "/1", "m")], "id long, path string, branch string")
    edges = spark.createDataFrame([(7, 1, None, "a", "unresolved", "/1", 2, None), (8, 1, None, "a", "unresolved", "/0", 2, None)], "id long, file_id long, target long, name string, method string, definition_path string, definition_line int, definition_character int")
    got = R.by_definition(edges, symbols, files, files.select("path", "branch").limit(0))
    assert rows(got.select("id", "target", "method")) == [(7, 2, "lsp_definition"), (8, None, "external_definition")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rank#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_a_name_and_its_normal_form_are_looked_up_in_one_pass(spark, tmp_path):
    from graphmill.functions.columns import member_name

    names, path = ["a", "b", "x.a", "x.b", "x.c", "c", None, "x.", "", "y. c"], str(tmp_path / "calls")
    calls = [(10 * f + i, f, 99 if (i + f) % 7 == 0 else None, n, "given" if (i + f) % 7 == 0 else "unresolved", None, None, None) for f in range(1, 6) for i, n in enumerate(names)]
    spark.createDataFrame(calls, "id long, file_id long, callee_id long, callee_name string, resolution_method string, definition_path string, definition_line int, definition_character int").write.parquet(path)
    symbols = spark.createDataFrame([(1, 1, "a", "function"), (2, 1, "a", "macro"), (3, 2, "a", "class"), (4, 2, "x.b", "function"), (5, 3, "b", "function"), (6, 3, "b", "function"), (7, 4, "c", "constant"), (8, 4, "x.c", "macro"), (9, 2, "c", None), (10, 5, "", "class")], "id long, file_id long, name string, kind string")
    symbols = symbols.withColumns({c: F.lit(None).cast("int") for c in ("start_line", "end_line", "start_character", "end_character", "selection_line", "selection_character")})
    files = spark.createDataFrame([(1, "/1", "m"), (2, "/2", "m"), (3, "/3", "m"), (4, "/4", "n")], "id long, path string, branch string")
    got = R.resolve_calls(spark.read.parquet(path), symbols, files, files.select("path", "branch").limit(0))
    e = R.generic(spark.read.parquet(path), "callee_id", "callee_name")
    want = R.by_name(R.by_name(e, symbols, files=files), symbols, member_name("name"), files)
    assert rows(got.select("id", "callee_id", "resolution_method")) == rows(want.select("id", "target", "method"))
    assert {r[0] for r in got.select("resolution_method").distinct().collect()} >= {"name_same_file", "name_unique", "name_single_file", "unresolved", "given"}
    once = R.by_name(e, symbols, member_name("name"), files)
    assert optimized(once).count("Join") <= 6  # the edge's file, symbols' files twice, odd names, names, the file's names
