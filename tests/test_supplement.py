from graphmill.operators import supplement as U

SYMBOL = "id long, file_id long, name string, kind string, start_line int, start_character int, end_line int, end_character int, selection_line int, selection_character int, signature string, parent_symbol_id long"
SERVED = "file_id long, position long, parent_position long, depth int, name string, kind string, start_line int, start_character int, end_line int, end_character int, selection_line int, selection_character int, signature string, doc_comment string"


def test_change_set(spark):
    indexed = [
        (1, 10, "A", "class", 5, None, 5, None, None, None, None, None),  # flat: updated
        (2, 10, "x", "variable", 7, None, 7, None, None, None, None, 1),  # filled
        (3, 20, "f", "function", 0, 0, 0, 9, 0, 4, None, None),  # its file has no index: kept
        (4, 10, "m", "method", 6, 0, 8, 0, 6, 3, None, 1),
    ]
    served = [
        (10, 0, None, 0, "A", "class", 5, 0, 9, 1, 5, 6, None, None),
        (10, 1, 0, 1, "x", "variable", 7, 2, 7, 5, 7, 2, None, None),
        (10, 2, 0, 1, "m", "method", 6, 0, 8, 0, 6, 3, None, None),
        (10, 3, 0, 1, "m", "method", 6, 0, 8, 0, 6, 3, None, None),  # repeats the symbol before
        (10, 4, None, 0, "B", "class", 20, 0, 30, 0, 20, 6, "class B", "says"),
        (10, 5, 4, 1, "n", "method", 21, 0, 22, 0, None, None, None, None),
        (10, 6, 4, 1, "n", "method", 22, 0, 23, 0, None, None, None, None),  # meets the one before
        (10, 7, 5, 2, "deep", "function", 21, 0, 21, 5, 21, 0, None, None),
        (10, 8, 6, 2, "deep", "function", 21, 0, 21, 5, 21, 0, None, None),  # same owner by repetition
        (20, 0, None, 0, "f", "function", 0, 0, 3, 1, 0, 4, None, None),
        (20, 1, 0, 1, "g", "function", 1, 0, 2, 1, 1, 4, None, None),
    ]
    a = spark.createDataFrame(indexed, SYMBOL)
    b = spark.createDataFrame(served, SERVED)
    changes = U.change_set(a, b, spark.createDataFrame([(10,), (10,)], "file_id long"))
    got = {(r.file_id, r.position): r for r in changes.collect()}
    assert {k: r.action for k, r in got.items()} == {
        (10, 0): "update", (10, 1): "fill", (10, 2): "fill", (10, 3): "drop", (10, 4): "insert", (10, 5): "insert",
        (10, 6): "drop", (10, 7): "insert", (10, 8): "drop", (20, 0): "keep", (20, 1): "insert",
    }
    assert got[10, 3].id == 4 and got[10, 6].id == got[10, 5].id and got[10, 8].id == got[10, 7].id
    assert got[10, 5].parent_symbol_id == got[10, 4].id and got[10, 8].parent_symbol_id == got[10, 5].id and got[20, 1].parent_symbol_id == 3
    again = {(r.file_id, r.position): r.id for r in U.change_set(a, b, spark.createDataFrame([(10,)], "file_id long")).collect()}
    assert again == {k: r.id for k, r in got.items()}

    after = {r.name: r for r in U.applied(a, changes).collect()}
    assert len(after) == 8
    assert tuple(after["A"])[4:10] == (5, 0, 9, 1, 5, 6) and tuple(after["x"])[4:10] == (7, 2, 7, 5, 7, 2)
    assert tuple(after["f"])[4:10] == (0, 0, 0, 9, 0, 4) and after["B"].signature == "class B"

    files = spark.createDataFrame([(10, "/r/a.c", "main"), (20, "/r/b.c", "main")], "id long, path string, branch string")
    calls = spark.createDataFrame(
        [
            (20, 0, "B", "class", "/r/a.c", "file:///r/a.c", 20, 6, [(1, 2), (1, 2), (2, 0)]),
            (20, 1, "no", "function", "/r/z.c", "u", 1, 1, [(5, 5)]),
            (20, 1, "out", "function", "/usr/z.h", "u", 1, 1, [(6, 5)]),
            (10, 2, "out", "function", "/usr/z.h", "u", 1, 1, [(6, 5)]),  # of a sourced file
        ],
        "file_id long, position long, name string, kind string, path string, uri string, line int, character int, ranges array<struct<line:int,character:int>>",
    )
    rows = sorted((r.caller_id == 3, r.callee_name, r.callee_id, r.call_line, r.resolution_method) for r in U.outgoing_calls(changes, calls, U.applied(a, changes), files, "/r").collect())
    assert rows == [(False, "no", None, 5, "unresolved"), (False, "out", None, 6, "external_definition"), (True, "B", after["B"].id, 1, "lsp_definition"), (True, "B", after["B"].id, 2, "lsp_definition")]


def test_empty_change_set(spark):
    none = U.change_set(spark.createDataFrame([], SYMBOL), spark.createDataFrame([], SERVED), spark.createDataFrame([], "file_id long"))
    assert none.collect() == [] and U.applied(spark.createDataFrame([], SYMBOL), none).collect() == []


def test_two_languages_through_one_call(spark):
    import pytest
    from pyspark.errors import AnalysisException

    from graphmill.functions import supplements as P

    def python_constants(source):
        for n, line in enumerate(source.split("\n")):
            name, eq, value = line.partition(" = ")
            if eq and name.isupper():
                yield {"name": name, "kind": "constant", "start_line": n, "end_line": n, "value": value, "quoted": value.startswith('"')}

    P.register(spark, {**P.PROVIDERS, "python": P.Provider("value string, quoted boolean", python_constants)})
    rows = [(1, "c", "#define A 1\n#ifdef X\n#define B(x) \\\n  x\n#endif"), (2, "python", 'a = 1\nLIMIT = 5\nNAME = "n"'), (3, "go", "const A = 1"), (4, "c", None), (5, "cpp", "")]
    spark.createDataFrame(rows, "id long, language string, source string").createOrReplaceTempView("supplement_sources")
    got = spark.sql("SELECT * FROM language_supplements(TABLE(supplement_sources)) ORDER BY id, start_line")
    assert got.columns == ["id", "language", "name", "kind", "start_line", "end_line", "conditions", "value", "quoted"]
    found = got.collect()
    assert [tuple(r) for r in (found[0], *found[2:])] == [
        (1, "c", "A", "macro", 0, 0, [], "1", None),
        (2, "python", "LIMIT", "constant", 1, 1, None, "5", False),
        (2, "python", "NAME", "constant", 2, 2, None, '"n"', True),
    ]
    b = found[1]
    assert (b.name, b.start_line, b.end_line, b.conditions, b.quoted) == ("B", 2, 3, ["defined(X)"], None)
    one = spark.sql("SELECT * FROM language_supplements(TABLE(supplement_sources), 'python')")
    assert one.columns == ["id", "language", "name", "kind", "start_line", "end_line", "value", "quoted"] and one.count() == 2
    for bad in ("language_supplements(TABLE(supplement_sources), 'cobol')", "language_supplements(TABLE(SELECT id FROM supplement_sources))"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {bad}").collect()
