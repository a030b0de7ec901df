"""An overlay that replaces a target file and adds a caller: nothing effective may point at hidden rows."""

import pytest

from graphmill.operators import resolve as R
from graphmill.operators import visibility as V

FILES = "id long, path string, branch string, layer string, generation long"
CALLS = "id long, file_id long, caller_id long, callee_id long, callee_name string, definition_path string, definition_line int, definition_character int, resolution_method string"


@pytest.fixture
def world(spark):
    files = spark.createDataFrame([(1, "src/core/target.ts", "main", "baseline", 1), (2, "src/app/caller.ts", "main", "baseline", 1), (3, "src/lib/helper.ts", "main", "baseline", 1), (4, "src/app/overlay.ts", "main", "overlay", 0), (11, "src/core/target.ts", "main", "overlay", 0), (20, "src/old.ts", "main", "baseline", 0)], FILES)
    dirty = spark.createDataFrame([("src/app/overlay.ts", "main"), ("src/core/target.ts", "main")], "path string, branch string")
    promoted = spark.createDataFrame([("main", 1)], "branch string, generation long")
    symbols = spark.createDataFrame([(1, 1, "targetFn", "function", 1, 5), (20, 2, "callerFn", "function", 1, 9), (30, 3, "helper", "function", 1, 3), (40, 4, "overlayCaller", "function", 1, 9), (101, 11, "targetFn", "function", 2, 6)], "id long, file_id long, name string, kind string, start_line int, end_line int")
    from pyspark.sql import functions as F

    symbols = symbols.withColumns({c: F.lit(None).cast("int") for c in ("start_character", "end_character", "selection_line", "selection_character")})
    calls = spark.createDataFrame([(1, 2, 20, 1, "targetFn", "src/core/target.ts", 3, None, "scip_definition"), (2, 4, 40, 1, "targetFn", None, None, None, "lsp_definition"), (3, 1, 1, 20, "callerFn", None, None, None, "scip_definition"), (4, 11, 101, 30, "helper", None, None, None, "lsp_definition"), (5, 2, 20, None, "gone", "src/away.ts", 1, None, "unresolved")], CALLS)
    imports = spark.createDataFrame([(1, 2, 1, "scip"), (2, 4, 1, "scip"), (3, 2, 20, "scip")], "id long, file_id long, resolved_id long, resolution_method string")
    return files, dirty, promoted, symbols, calls, imports


def test_effective_files(world):
    files, dirty, promoted, *_ = world
    assert sorted(r.id for r in V.effective_files(files, dirty, promoted).collect()) == [2, 3, 4, 11]
    assert [r.id for r in V.effective_files(files, dirty, promoted, ("main", 0)).collect()] == [20]
    assert sorted(r.id for r in V.effective_files(files.where("id <> 11"), dirty, promoted).collect()) == [2, 3, 4]
    assert V.effective_files(files, dirty, promoted.limit(0)).where("layer = 'baseline'").collect() == []


def test_reconcile_and_resolve_leave_no_dangling_target(world):
    files, dirty, promoted, symbols, calls, imports = world
    eff = V.effective_files(files, dirty, promoted)
    s = V.effective(symbols, eff)
    c = V.reconcile(V.effective(calls, eff), "callee_id", s, eff)
    assert {r.id: r.callee_id for r in c.collect()} == {1: None, 2: None, 4: 30, 5: None}
    done = {r.id: (r.callee_id, r.resolution_method) for r in R.resolve_calls(c, s, eff, dirty).collect()}
    assert done == {1: (101, "lsp_definition"), 2: (101, "name_unique"), 4: (30, "lsp_definition"), 5: (None, "external_definition")}
    i = {r.id: (r.resolved_id, r.resolution_method) for r in V.reconcile_imports(imports, files, eff).collect()}
    assert i == {1: (11, "scip"), 2: (11, "scip"), 3: (None, "overlay_stale")}


def test_stale_edges_come_back(world, spark):
    files, dirty, promoted, symbols, _, _ = world
    eff = V.effective_files(files, dirty, promoted)
    e = spark.createDataFrame([(9, 2, 20, None, "targetFn", "src/core/target.ts", 3, None, "overlay_stale"), (10, 2, 20, None, "x", "src/none.ts", 3, None, "overlay_stale")], CALLS)
    got = {r.id: r.resolution_method for r in V.reconcile(e, "callee_id", V.effective(symbols, eff), eff).collect()}
    assert got == {9: "unresolved", 10: "overlay_stale"}
