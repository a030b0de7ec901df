import json

from graphmill.operators import ingest as I
from graphmill.sources import files as F
from graphmill.sources import texts as X

LOG = "COMMIT_SEP\nabc\nAnn\na@x\n100\np1 p2\nMerge\n\n3\t1\tsrc/{a => b}/f\n-\t-\tlogo.png\nCOMMIT_SEP\ndef\nBob\nb@x\n90\n\nInit\n\n5\t0\tf.c\n"


def test_git_log(spark):
    rows = X.git_log(LOG)
    assert [r["sha"] for r in rows] == ["abc", "def"] and json.loads(rows[0]["parents"]) == ["p1", "p2"]
    assert rows[0]["files"][0]["change_type"] == "renamed" and rows[0]["files"][1]["insertions"] is None
    df = X.parsed(spark.createDataFrame([(1, LOG), (2, None)], "id long, text string"), X.git_log, ["text"], ["id"], X.GIT_LOG)
    assert [(r.id, r.sha, len(r.files)) for r in df.collect()] == [(1, "abc", 2), (1, "def", 1)]
    assert X.git_refs("s1 refs/heads/main\ns2 refs/tags/v1\ns3 refs/x")[1] == {"commit_sha": "s2", "ref_name": "v1", "ref_type": "tag"}


def test_blame():
    text = f"{'a' * 40} 1 1 1\nauthor Ann\nauthor-mail <a@x>\nauthor-time 5\nsummary S\n\tint x;\n{'b' * 40} 2 2\nauthor Bob\nauthor-mail <b@x>\nauthor-time 6\nsummary T\n\t\n"
    rows = X.blame(text)
    assert [(r["line"], r["author"], r["author_email"], r["timestamp"], r["text"]) for r in rows] == [(1, "Ann", "a@x", 5, "int x;"), (2, "Bob", "b@x", 6, "")]


def test_config():
    assert X.config(".env", "export A='x y'\n# c\nB=3 # n\n") == [{"key": "A", "value": "x y", "type": "string"}, {"key": "B", "value": "3", "type": "number"}]
    assert {r["key"]: r["value"] for r in X.config("a.json", '{"a":{"b":[1,true]},"c":null}')} == {"a.b.0": "1", "a.b.1": "true", "c": None}
    assert {r["key"]: r["value"] for r in X.config("a.toml", 't = 1\n[s]\nk = "v"\n')} == {"t": "1", "s.k": "v"}
    assert {r["key"]: r["value"] for r in X.config("a.yml", "a:\n  b: 1\n  l:\n    - x\n    - y\nc: 'q'\n")} == {"a.b": "1", "a.l.0": "x", "a.l.1": "y", "c": "q"}
    assert X.config("a.json", "{") == [] and X.config(None, None) == []


def test_c_sources():
    src = '#include <a.h>\n// #include "no.h"\n/* #include "no2.h" */\n#  include "b.h"\nchar *s = "#include \\"c.h\\"";\n#inc\\\nlude "d.h"\n#include <a.h>\n'
    assert [r["raw_import"] for r in X.c_includes(src)] == ["<a.h>", "b.h", "d.h"]
    m = X.c_macros("#define A 1\n#ifdef X\n#define F(a,b) a \\\n  + b\n#else\n#define G\n#endif\n")
    assert [(r["name"], r["parameters"], r["line"], r["end_line"], r["conditions"]) for r in m] == [("A", None, 0, 0, []), ("F", "(a,b)", 2, 3, ["defined(X)"]), ("G", None, 5, 5, ["!(defined(X))"])]


def test_compile_commands():
    rows = X.compile_commands(json.dumps([{"directory": "/r/b", "file": "../a.cc", "command": "g++ -I inc -isystem /s -Iinc ../a.cc"}, {"file": "x"}]))
    assert rows[0] == {"path": "/r/a.cc", "language": "cpp", "includes": ["/r/b/inc", "/s"], "status": "valid"} and rows[1]["status"] == "incomplete"


def test_language_server_answers():
    r = {"start": {"line": 0, "character": 0}, "end": {"line": 9, "character": 0}}
    rows = X.lsp_symbols(json.dumps([{"name": "m", "kind": 2, "range": r, "children": [{"name": "C", "kind": 5, "range": r, "selectionRange": r, "children": [{"name": "f", "kind": 6, "range": r}]}]}]))
    assert [(x["name"], x["kind"], x["parents"]) for x in rows] == [("C", "class", []), ("f", "method", ["class:C"])]
    assert X.hover_text([{"language": "c", "value": "```c\nint x\n```"}, "doc"]) == "int x\ndoc"
    assert X.definition_of([{"targetUri": "u", "targetRange": r, "targetSelectionRange": {"start": {"line": 3, "character": 4}}}]) == {"uri": "u", "line": 3, "character": 4}


def test_walk_and_changes(spark, tmp_path):
    for p, t in (("a.py", "x"), ("sub/b.C", "y"), ("node_modules/c.py", "z"), (".hid/d.py", "z"), ("e.txt", "z")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.path: r.language for r in F.walk(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "python", "sub/b.C": "cpp"}
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, last_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, last_hash string")
    assert {r.path: r.change for r in F.changes(old, new).collect()} == {"b": "changed", "c": "deleted", "d": "created"}
    paths = spark.createDataFrame([("go.mod",), ("src/a.py",), ("x/y/z.rs",), ("node_modules/q.js",)], "path string")
    assert {r.language for r in F.project_languages(paths).collect()} == {"go", "python"}


def test_symbol_strings():
    p = I.symbol_parts("scip-ts npm pkg 1.0 src/`a.ts`/C#m().")
    assert (p["name"], p["kind"], p["parent"], p["method"]) == ("m", "method", "scip-ts npm pkg 1.0 src/`a.ts`/C#", "m")
    assert I.symbol_parts("s m p v f().")["kind"] == "function" and I.symbol_parts("s m p v C#")["kind"] == "class"
    assert I.symbol_parts("s m p v C#m().(x)")["parent"] == "s m p v C#m()." and I.symbol_parts("s m p v N/`x y`#")["name"] == "x y"


def test_definitions_and_references(spark):
    occ = spark.createDataFrame([(1, [2, 4, 7], "s m p v f().", 1, [2, 0, 9, 1], 0), (1, [5, 2, 3], "s m p v g().", 0, [], 0), (2, [0, 0, 1], "s m p v f().", 1, [], 0), (1, [6, 0, 2], "s m p v T#", 0, [], 0)], "file_id long, range array<int>, symbol string, symbol_roles int, enclosing_range array<int>, syntax_kind int")
    infos = spark.createDataFrame([("s m p v f().", ["```c\nint f()\n```", "doc"], "", 0)], "symbol string, documentation array<string>, display_name string, kind int")
    d = I.definitions(occ, infos)
    rows = {(r.file_id, r.is_forward): r for r in d.collect()}
    assert rows[1, False].signature == "int f()" and (rows[1, False].start_line, rows[1, False].end_line) == (2, 9) and (2, True) in rows
    files = spark.createDataFrame([(1, "z.c"), (2, "a.h")], "id long, path string")
    assert [r.file_id for r in I.canonical(d, files).collect()] == [1]
    syms = spark.createDataFrame([(10, 1, 2, 9)], "id long, file_id long, start_line int, end_line int")
    assert sorted((r.line, r.kind, r.caller_id) for r in I.references(occ, syms).collect()) == [(5, "call", 10), (6, "type", 10)]


def test_stable_matching(spark):
    base = {"kind": "method", "start_character": 0, "selection_line": None, "selection_character": None, "parent_name": None}
    a = [dict(base, id=1, name="f", start_line=1, end_line=5, signature="f(int)"), dict(base, id=2, name="f", start_line=8, end_line=9, signature="f(str) ;")]
    b = [dict(base, id=7, name="f", start_line=8, end_line=9, signature="f( str )"), dict(base, id=8, name="f", start_line=2, end_line=5, signature="f(int)")]
    assert [(x, y) for x, y, _ in I.stable_pairs(a, b)] == [(1, 8), (2, 7)]
    schema = "file_id long, id long, name string, kind string, start_line int, start_character int, end_line int, selection_line int, selection_character int, signature string, parent_name string"
    frame = lambda rows: spark.createDataFrame([{**r, "file_id": 3} for r in rows], schema)
    assert sorted((r.indexed_id, r.served_id) for r in I.matched(frame(a), frame(b)).collect()) == [(1, 8), (2, 7)]


def test_spans_by_braces():
    assert I.brace_span("int f(int a) {\n  if (x) { }\n  s = \"}\";\n}\nint g();\n", 0) == (0, 3)
    assert I.brace_span("int g();\nint f() {}\n", 0) is None
    assert I.brace_span("C::C() : a{1}, b(2) {\n  x;\n}\n", 0) == (0, 2)
    assert I.macro_span("#define A \\\n 1 \\\n 2\nint x;", 0) == (0, 2)


def test_columns_of_encodings():
    assert I.converted_column("a😀b", 5, "utf-8") == 3 and I.converted_column("a😀b", 2, "utf-32") == 3 and I.converted_column("abc", 9, "utf-8") == 3


def test_merged_documents(spark):
    s = "path string, occurrences array<struct<range:array<int>,symbol:string,symbol_roles:int,enclosing_range:array<int>,syntax_kind:int>>, symbols array<struct<symbol:string,documentation:array<string>,relationships:array<string>>>"
    df = spark.createDataFrame([("p", [([1, 2, 3], "a", 1, [], 0)], [("a", [], [])]), ("p", [([1, 2, 3], "a", 1, [0, 0, 5, 0], 0), ([4, 0, 1], "b", 0, [], 0)], [("a", ["doc"], [])])], s)
    r = F.merged_documents(df).first()
    assert len(r.occurrences) == 2 and r.occurrences[0].enclosing_range == [0, 0, 5, 0] and r.symbols[0].documentation == ["doc"]
