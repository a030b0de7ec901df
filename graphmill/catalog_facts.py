"""Registered queries of parsers, lookups, ingest, resolution and graph functions, with their SQL.

Inputs are made of the driver's tables row by row, so that SQL states the expected rows by the same rule that
made the input, without the operator under test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill import adapters as A
from graphmill.catalog import _call_edges, _sparse, query, r6
from graphmill.functions import columns as K
from graphmill.operators import commits as C
from graphmill.operators import edges as E
from graphmill.operators import graph as G
from graphmill.operators import health as H
from graphmill.operators import ingest as N
from graphmill.operators import lookups as L
from graphmill.operators import resolve as R
from graphmill.operators import retrieval as S
from graphmill.plans import build as B
from graphmill.sources import files as W
from graphmill.sources import texts as T
from graphmill.storage import ignore, replace
from graphmill.streaming import changes as X


def numbers(spark, d) -> DataFrame:
    """k: the order keys, which are 0 to n - 1."""
    return A.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"))


KEYS = "WITH RECURSIVE o AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)"


def text(k: str, *parts: str) -> F.Column:
    """Parts side by side; `@` stands for column k."""
    return F.concat(*[F.col(k).cast("string") if p == "@" else F.lit(p) for q in parts for p in _cut(q)])


def _cut(part: str) -> list[str]:
    out = []
    for i, p in enumerate(part.split("@")):
        out += ["@"] * bool(i) + [p]
    return out


# --- parsers


@query("""SELECT sha, author, author_email, timestamp, message, '["p1", "p2"]' AS parents, file_path, CASE WHEN file_path IS NULL THEN NULL WHEN contains(file_path, ' => ') THEN 'renamed' ELSE 'modified' END AS change_type, insertions, deletions
    FROM commits LEFT JOIN (SELECT * FROM commit_files WHERE length(file_path) % 5 <> 0) ON commit_sha = sha""")
def git_log_parse(spark, d):
    f = A.commit_files(spark, d).where("length(file_path) % 5 <> 0").groupBy("commit_sha").agg(F.array_sort(F.collect_list(F.struct("file_path", "insertions", "deletions"))).alias("fs"))
    line = F.transform("fs", lambda x: F.concat_ws("\t", F.coalesce(x["insertions"].cast("string"), F.lit("-")), x["deletions"].cast("string"), x["file_path"]))
    c = A.commits(spark, d).join(f, F.col("sha") == F.col("commit_sha"), "left")
    log = c.select(F.concat_ws("\n", F.lit("COMMIT_SEP"), "sha", "author", "author_email", F.col("timestamp").cast("string"), F.lit("p1 p2"), "message", F.lit(""), F.coalesce(F.array_join(line, "\n"), F.lit(""))).alias("text"))
    return T.parsed(log, T.git_log, ["text"], [], T.GIT_LOG).select("sha", "author", "author_email", "timestamp", "message", "parents", F.explode_outer("files").alias("f")).select("sha", "author", "author_email", "timestamp", "message", "parents", "f.*")


@query("SELECT commit_sha, ref_name, ref_type FROM commit_refs")
def git_refs_parse(spark, d):
    r = A.commit_refs(spark, d)
    line = F.concat(F.col("commit_sha"), F.when(F.col("ref_type") == "branch", " refs/heads/").otherwise(" refs/tags/"), F.col("ref_name"))
    block = F.floor(F.col("commit_sha").cast("long") / 5000)  # a text is a listing of 5000 lines at most, so that no row grows with the tables
    texts = r.groupBy("ref_name", block.alias("block")).agg(F.array_join(F.collect_list(line), "\n").alias("text")).select("text")
    return T.parsed(texts, T.git_refs, ["text"], [], "commit_sha string, ref_name string, ref_type string")


@query("SELECT lpad(sha, 40, '0') AS sha, 7 AS line, author, author_email, timestamp, message AS summary, 'code ' || sha AS text FROM commits")
def blame_parse(spark, d):
    c = A.commits(spark, d)
    rows = c.select(F.concat(F.lpad("sha", 40, "0"), F.lit(" 3 7 1\nauthor "), "author", F.lit("\nauthor-mail <"), "author_email", F.lit(">\nauthor-time "), F.col("timestamp").cast("string"), F.lit("\nsummary "), "message", F.lit("\nfilename x.py\n\tcode "), "sha", F.lit("\n")).alias("t"))
    return T.parsed(rows, T.blame, ["t"], [], "sha string, line int, author string, author_email string, timestamp long, summary string, text string")


@query("SELECT sha, author, timestamp, message, '@@ -1 +1 @@' || chr(10) || '+' || sha AS patch FROM commits")
def line_history_parse(spark, d):
    c = A.commits(spark, d)
    rows = c.select(F.concat_ws("\n", F.lit("COMMIT_SEP"), "sha", "author", "author_email", F.col("timestamp").cast("string"), F.lit("p"), "message", F.lit(""), F.lit("@@ -1 +1 @@"), F.concat(F.lit("+"), "sha"), F.lit("")).alias("t"))
    return T.parsed(rows, T.line_history, ["t"], [], "sha string, author string, timestamp long, message string, patch string")


@query(KEYS + """ SELECT k, 'C' || k AS name, 'class' AS kind, CAST(k % 50 AS INTEGER) AS start_line, CAST(k % 50 + 9 AS INTEGER) AS end_line, CAST(k % 50 AS INTEGER) AS selection_line, '' AS parents, 0 AS position FROM o
    UNION ALL SELECT k, 'm' || k, 'method', CAST(k % 50 + 1 AS INTEGER), CAST(k % 50 + 2 AS INTEGER), NULL, 'class:C' || k, 1 FROM o""", raw=True)
def lsp_symbols_parse(spark, d):
    at = lambda n, c: F.concat(F.lit('{"line":'), (F.col("k") % 50 + n).cast("string"), F.lit(f',"character":{c}}}'))
    span = lambda a, b: F.concat(F.lit('{"start":'), at(a, 0), F.lit(',"end":'), at(b, 1), F.lit("}"))
    method = F.concat(text("k", '{"name":"m@","kind":6,"range":'), span(1, 2), F.lit("}"))
    own = F.concat(text("k", '[{"name":"mod","kind":2,"range":'), span(0, 40), text("k", ',"children":[{"name":"C@","kind":5,"range":'), span(0, 9), F.lit(',"selectionRange":'), span(0, 0), F.lit(',"children":['), method, F.lit("]}]}]"))
    got = T.parsed(numbers(spark, d).select("k", own.alias("t")), T.lsp_symbols, ["t"], ["k"], "name string, kind string, start_line int, end_line int, selection_line int, parents array<string>, position int")
    return got.withColumn("parents", F.array_join("parents", "/"))


@query(KEYS + """ SELECT k, 'M_' || k AS name, '(a)' AS parameters, CAST(k AS VARCHAR) AS value, 4 AS line, 5 AS end_line, 'defined(X)' AS conditions FROM o UNION ALL SELECT k, 'N_' || k, NULL, '7', 7, 7, '' FROM o""", raw=True)
def macro_extract(spark, d):
    t = text("k", "/* a\n#define HIDDEN 1\n*/\n#ifdef X\n#define M_@(a) \\\n @\n#endif\n#define N_@ 7 // c\n")
    got = T.parsed(numbers(spark, d).select("k", t.alias("t")), T.c_macros, ["t"], ["k"], "name string, parameters string, value string, line int, end_line int, conditions array<string>")
    return got.withColumn("conditions", F.array_join("conditions", "&"))


@query(KEYS + " SELECT k, 0 AS position, '<a/' || k || '.h>' AS raw_import FROM o UNION ALL SELECT k, 1, k || '.h' FROM o", raw=True)
def include_extract(spark, d):
    t = text("k", '#include <a/@.h>\n// #include "no.h"\n  #  include "@.h"\n/*\n#include <hidden>\n*/\n#include <a/@.h>\nchar *s = "/*";\n')
    return T.parsed(numbers(spark, d).select("k", t.alias("t")), T.c_includes, ["t"], ["k"], "position int, raw_import string")


@query(KEYS + """ SELECT k, '/w/' || k || '.cpp' AS path, 'cpp' AS language, '/w/inc:/abs:/w/sys' AS includes, 'valid' AS status FROM o UNION ALL SELECT k, '/w/' || k || '.c', 'cpp', '', 'valid' FROM o UNION ALL SELECT k, '/w/b/' || k || '.c', 'c', '', 'valid' FROM o""", raw=True)
def compile_units(spark, d):
    t = text("k", '[{"directory":"/w","file":"src/../@.cpp","command":"clang++ -Iinc -I /abs -isystem sys -c @.cpp"},{"directory":"/w","file":"@.c","arguments":["cc","-x","c++"]},{"directory":"/w/b","file":"@.c","arguments":["cc","-std=c11"]}]')
    got = T.parsed(numbers(spark, d).select("k", t.alias("t")), T.compile_commands, ["t"], ["k"], "path string, language string, includes array<string>, status string")
    return got.withColumn("includes", F.array_join("includes", ":"))


@query("SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value, 'number' AS type FROM events", raw=True)
def config_flatten(spark, d):
    rows = A.table(spark, d, "events").select("event_id", F.lit("p.json").alias("path"), "props")
    return T.parsed(rows, T.config, ["path", "props"], ["event_id"], "key string, value string, type string")


@query(KEYS + """, r AS (SELECT k, unnest([{f: '.env', key: 'A', value: CAST(k AS VARCHAR), type: 'number'}, {f: '.env', key: 'B', value: 'x y', type: 'string'}, {f: 'c.toml', key: 't.a', value: CAST(k AS VARCHAR), type: 'number'}, {f: 'c.toml', key: 't.b.0', value: 'true', type: 'boolean'},
    {f: 'c.yml', key: 'top.n', value: CAST(k AS VARCHAR), type: 'number'}, {f: 'c.yml', key: 'top.s', value: 'q', type: 'string'}]) AS x FROM o) SELECT k, x.f AS path, x.key AS key, x.value AS value, x.type AS type FROM r""", raw=True)
def config_formats(spark, d):
    parts = {".env": "export A=@\n# no\nB='x y'\n", "c.toml": "[t]\na = @\nb = [true]\n", "c.yml": "top:\n  n: @\n  # c\n  s: q\n", "bad.json": "{@"}
    rows = numbers(spark, d).select("k", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), text("k", t).alias("t")) for p, t in parts.items()])).alias("x")).select("k", "x.*")
    return T.parsed(rows, T.config, ["path", "t"], ["k", "path"], "key string, value string, type string")


@query(KEYS + """ SELECT k, 'file://x/' || k AS uri, CAST(k % 9 AS INTEGER) AS line, 'def f' || k AS hover FROM o""", raw=True)
def hover_and_definition(spark, d):
    t = F.concat(text("k", '{"d":[{"targetUri":"file://x/@","targetSelectionRange":{"start":{"line":'), (F.col("k") % 9).cast("string"), text("k", ',"character":1}}}],"h":[{"language":"py","value":"```py\\ndef f@\\n```"},""]}'))

    def read(text: str) -> list[dict]:
        import json

        both = json.loads(text)
        return [{"uri": T.definition_of(both["d"])["uri"], "line": T.definition_of(both["d"])["line"], "hover": T.hover_text(both["h"])}]

    return T.parsed(numbers(spark, d).select("k", t.alias("t")), read, ["t"], ["k"], "uri string, line int, hover string")


# --- files


@query("""SELECT CASE WHEN k % 13 = 0 AND e THEN 'n' ELSE 'f' END || k AS path, CASE WHEN e THEN 'created' WHEN k % 11 = 0 THEN 'deleted' ELSE 'changed' END AS change
    FROM (SELECT c_custkey AS k, false AS e FROM customer UNION ALL SELECT c_custkey, true FROM customer WHERE c_custkey % 13 = 0) WHERE e OR k % 11 = 0 OR k % 7 = 0""", raw=True)
def snapshot_changes(spark, d):
    k = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    old = W.snapshot(k.select(text("k", "f@").alias("path"), text("k", "s@").alias("source")))
    new = k.where("k % 11 <> 0").select(text("k", "f@").alias("path"), F.when(F.col("k") % 7 == 0, "new").otherwise(text("k", "s@")).alias("source"))
    return W.changes(old, W.snapshot(new.unionByName(k.where("k % 13 = 0").select(text("k", "n@").alias("path"), F.lit("x").alias("source")))))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS last_hash, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes FROM documents", raw=True)
def snapshot_hashes(spark, d):
    return W.snapshot(A.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source"))).select("doc_id", "last_hash", "size_bytes")


_EXT = [".c", ".C", ".c++", ".zsh", ".jl", ".mm", ".h++", ".PY", ".txt", ".tsx", ".kts", ".exs", ".mli", ".sc"]
_LANG = ["c", "cpp", "cpp", "bash", "julia", "objc", "cpp", "python", None, "typescript", "kotlin", "elixir", "ocaml", "scala"]


def _paths(spark, d):
    return numbers(spark, d).select("k", F.concat(text("k", "src/a.b/f@"), F.element_at(F.array(*map(F.lit, _EXT)), (F.col("k") % len(_EXT) + 1).cast("int"))).alias("path"))


@query(KEYS + f" SELECT k, list_extract([{', '.join('NULL' if x is None else repr(x) for x in _LANG)}], CAST(k % {len(_LANG)} + 1 AS INTEGER)) AS language FROM o", raw=True)
def languages_by_extension(spark, d):
    return _paths(spark, d).select("k", W.language_of("path").alias("language"))


@query("SELECT id FROM files WHERE NOT (starts_with(path, '/building/') AND id % 2 = 0) AND id % 3 <> 0")
def excluded_paths(spark, d):
    f = A.files(spark, d).withColumn("path", F.when(F.col("path").startswith("/building/") & (F.col("id") % 2 == 0), F.concat(F.lit("x/node_modules"), "path")).when(F.col("id") % 3 == 0, F.concat(F.lit("x/.git"), "path")).otherwise(F.concat(F.lit("x/building"), "path")))
    return f.where(~W.excluded("path")).select("id")


@query("SELECT id FROM files WHERE (starts_with(path, '/building/') OR regexp_matches(path, '^/machinery/n[0-9]/[^/]*\\.py$')) AND NOT ends_with(path, '7.py')")
def glob_selection(spark, d):
    return A.files(spark, d).where(K.selected("path", ["/building/**", "/{machinery,none}/n?/*.py"], ["**/*7.py"])).select("id")


@query(KEYS + f" SELECT DISTINCT language FROM (SELECT list_extract([{', '.join('NULL' if x is None else repr(x) for x in _LANG)}], CAST(k % 7 + 1 AS INTEGER)) AS language FROM o UNION ALL SELECT unnest(['python', 'go', 'javascript']))", raw=True)
def project_languages(spark, d):
    # half of the extensions one directory deep, all of them two deep, where they don't count
    near = numbers(spark, d).select(F.concat(text("k", "d@/f"), F.element_at(F.array(*map(F.lit, _EXT[:7])), (F.col("k") % 7 + 1).cast("int"))).alias("path"))
    rows = _paths(spark, d).select("path").unionByName(spark.createDataFrame([("package.json",), ("go.mod",), ("src/x.py",), ("node_modules/y.rs",), (".hidden/z.rb",), ("a/b/c.java",), ("deep/go.mod",)], "path string"))
    return W.project_languages(rows.unionByName(near))


@query("SELECT CAST(l AS VARCHAR) AS layer, generation, n FROM (SELECT 'baseline' AS l, CAST(2 AS BIGINT) AS generation, count(*) AS n FROM files WHERE id % 2 = 0 UNION ALL SELECT 'overlay', CAST(0 AS BIGINT), count(*) FROM files WHERE id % 50 = 0)")
def index_generations(spark, d):
    from graphmill.storage import Index, scratch

    index = Index(spark, scratch(spark, "-index"))
    f = A.files(spark, d).drop("layer", "generation")
    a, b = index.reserve("main"), index.reserve("main")
    index.write("files", f, "baseline", a)
    index.promote("main", a)
    index.write("files", f.where("id % 2 = 0"), "baseline", b)
    index.promote("main", b)
    assert not index.promote("main", a)
    index.mark_dirty(["x"], "main", 1)
    index.write("files", f.where("id % 50 = 0"), "overlay", 0)
    index.clean_up()
    return index.raw("files").groupBy("layer", "generation").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE path END AS path FROM files WHERE id % 2 = 0 UNION ALL SELECT id, 'new' FROM files WHERE id % 2 = 1 AND id % 3 = 0")
def upsert_replace(spark, d):
    f = A.files(spark, d).select("id", "path")
    return replace(f.where("id % 2 = 0"), f.where("id % 3 = 0").withColumn("path", F.lit("new")), ["id"])


@query("SELECT id, CASE WHEN id % 2 = 0 THEN path ELSE 'new' END AS path FROM files WHERE id % 2 = 0 OR id % 3 = 0")
def upsert_ignore(spark, d):
    f = A.files(spark, d).select("id", "path")
    return ignore(f.where("id % 2 = 0"), f.where("id % 3 = 0").withColumn("path", F.lit("new")), ["id"])


@query("SELECT id, path FROM files WHERE id > 100 ORDER BY id LIMIT 37")
def keyset_page(spark, d):
    return L.page(A.files(spark, d), "id", 100, 37).select("id", "path")


@query("SELECT CAST(o_orderkey AS BIGINT) AS symbol_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS summary FROM orders WHERE o_orderkey % 2 = 0", raw=True)
def summaries_ingested(spark, d):
    s = numbers(spark, d).where("k % 2 = 0").select(F.col("k").alias("symbol_id"), F.lit("old").alias("summary"))
    return B.ingest_summary(s, s.where("symbol_id % 4 = 0").withColumn("summary", F.lit("new")))


@query("SELECT sha FROM commits WHERE CAST(sha AS BIGINT) % 5 = 0")
def new_commits(spark, d):
    c = A.commits(spark, d)
    return B.new_commits(c, c.where("cast(sha as long) % 5 <> 0")).select("sha")


@query("SELECT commit_sha, ref_name FROM commit_refs WHERE CAST(commit_sha AS BIGINT) % 5 <> 0")
def known_refs(spark, d):
    return B.known_refs(A.commit_refs(spark, d), A.commits(spark, d).where("cast(sha as long) % 5 <> 0")).select("commit_sha", "ref_name")


# --- lookups


@query("SELECT id, path FROM files WHERE id = 42")
def file_by_id(spark, d):
    return L.file_by_id(A.files(spark, d), 42, "main").select("id", "path")


@query("SELECT id + 10000000 AS id, path FROM files WHERE id = 20")
def file_by_path(spark, d):
    f = A.layered_files(spark, d)
    path = f.where("id = 20").first()["path"]
    return L.file_by_path(f, path).select("id", "path")


@query("SELECT id, path FROM files ORDER BY path, branch, id LIMIT 25")
def files_listed(spark, d):
    return L.list_files(A.files(spark, d), 25, "main").select("id", "path")


@query("SELECT s.id, s.name, f.path AS file_path, p.name AS parent_name, s.start_line + 1 AS start_line FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN symbols p ON p.id = s.parent_symbol_id WHERE s.id = 33")
def symbol_by_id(spark, d):
    return K.presented(L.symbol_by_id(A.symbols(spark, d), A.files(spark, d), 33), "start_line").select("id", "name", "file_path", "parent_name", "start_line")


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS symbol_name FROM part WHERE starts_with(lower(p_name), 'small') ORDER BY p_brand, p_name, p_type, p_partkey LIMIT 40", raw=True)
def external_lookup(spark, d):
    x = A.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("package_name"), F.col("p_name").alias("symbol_name"), F.col("p_type").alias("symbol_kind"), F.lit("sig").alias("signature"))
    return L.external_by_name(x, "SMALL", "prefix", 40).select("id", "symbol_name")


def _annotations(spark, d):
    return A.symbols(spark, d).select(F.col("id"), "file_id", F.when(F.col("id") % 2 == 0, "todo").otherwise("fixme").alias("kind"), F.col("start_line").alias("line"), F.col("id").alias("symbol_id"))


@query("SELECT s.id, f.path AS file_path, s.start_line AS line, s.name AS symbol_name FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.id % 2 = 0 ORDER BY f.path, s.start_line, s.id LIMIT 60")
def annotations_listed(spark, d):
    return L.list_annotations(_annotations(spark, d), A.files(spark, d), A.symbols(spark, d), kind="todo", limit=60).select("id", "file_path", "line", "symbol_name")


@query("SELECT s.id AS symbol_id, s.name, CAST(s.id % 40 AS INTEGER) AS cyclomatic FROM symbols s WHERE s.id % 40 >= 10 ORDER BY 3 DESC, 1 LIMIT 150")
def metrics_listed(spark, d):
    m = A.symbols(spark, d).select(F.col("id").alias("symbol_id"), (F.col("id") % 40).cast("int").alias("cyclomatic"), F.lit(0).alias("layer"), F.lit(0).alias("generation"))
    return L.metrics(m, A.symbols(spark, d), A.files(spark, d), 10, 150).select("symbol_id", "name", "cyclomatic")


@query("SELECT sha FROM commits WHERE ts >= TIMESTAMP '1995-03-01' AND ts < TIMESTAMP '1995-04-02' AND contains(lower(author_email), 'building')")
def commits_in_window(spark, d):
    return A.commits(spark, d).where(C.window_filter("1995-03-01", "1995-04-01", "BUILDING@")).select("sha")


@query("SELECT path, branch, count(*) AS count FROM (SELECT path, branch FROM files UNION ALL SELECT path, branch FROM files WHERE id % 9 = 0) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_paths(spark, d):
    f = A.files(spark, d)
    return E.duplicate_paths(f.unionByName(f.where("id % 9 = 0")))


@query("SELECT branch, min(indexed_at) AS oldest, max(indexed_at) AS newest, count(*) AS files, count(*) FILTER (WHERE layer = 'overlay') AS overlay_files FROM layered_files GROUP BY 1")
def branch_freshness(spark, d):
    return H.branch_freshness(A.layered_files(spark, d)).withColumn("overlay_files", F.col("overlay_files").cast("long"))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 10 = 0) AS failed, count(*) FILTER (WHERE o_orderkey % 10 = 1) AS skipped, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS fallback, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS files_without_symbols FROM orders", raw=True)
def degradation(spark, d):
    runs = numbers(spark, d).select(F.when(F.col("k") % 10 == 0, "failed").when(F.col("k") % 10 == 1, "skipped").otherwise("success").alias("status"), (F.col("k") % 4 == 0).alias("fallback"))
    return H.degraded(runs, A.files(spark, d), A.symbols(spark, d))


@query(KEYS + """ SELECT count(*) FILTER (WHERE k % 5 IN (0, 1)) AS errors, count(*) FILTER (WHERE k % 5 = 2) AS warnings, count(*) FILTER (WHERE k % 5 = 3) AS notes, count(*) FILTER (WHERE k % 5 = 4) AS failed_units FROM o""", raw=True)
def compiler_diagnostics(spark, d):
    kinds = [": error: e", ":7: fatal error: f", ":3: warning: w", ": note: n"]
    line = F.when(F.col("k") % 5 == 4, F.lit("Failed to compile x"))
    for i, s in enumerate(kinds):
        line = line.when(F.col("k") % 5 == i, text("k", "src/x.c:@" + s))
    got = H.diagnostics(numbers(spark, d).select(line.alias("value")))[0]
    return got.select(*[F.col(c).cast("long").alias(c) for c in got.columns])


@query("SELECT e.event_id AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS n FROM events e UNION ALL SELECT -1 - event_id, NULL FROM events", raw=True)
def json_details(spark, d):
    e = A.table(spark, d, "events")
    both = e.select(F.col("event_id").alias("k"), "props").unionByName(e.select((-1 - F.col("event_id")).alias("k"), F.lit("{broken").alias("props")))
    return both.select("k", H.numeric_detail("props", "k").alias("n"))


@query("SELECT id, raw_import FROM imports WHERE resolved_id IS NULL AND (id % 2 = 0 OR id % 3 = 0)")
def internal_imports(spark, d):
    i = A.imports(spark, d)
    known = A.files(spark, d).limit(1).select(F.lit("/src/known.py").alias("path"))
    i = i.select("id", "resolved_id", F.col("raw_import").alias("was"), F.when(F.col("id") % 2 == 0, "./a").when(F.col("id") % 3 == 0, "known.py").otherwise("os").alias("raw_import"))
    return H.internal_imports(i, known).select("id", F.col("was").alias("raw_import"))


@query(KEYS + """, w AS (SELECT k, CASE k % 17 WHEN 0 THEN 'missing line coordinate' WHEN 1 THEN 'negative line coordinate' WHEN 2 THEN 'negative start character' WHEN 3 THEN 'negative end character' WHEN 4 THEN 'end precedes start' WHEN 5 THEN 'end character precedes start'
    WHEN 6 THEN 'line coordinate is outside the stored source snapshot' WHEN 7 THEN 'start character is outside the UTF-16 line length' WHEN 8 THEN 'end character is outside the UTF-16 line length' WHEN 9 THEN 'selection line is outside the symbol span' WHEN 10 THEN 'negative selection character'
    WHEN 11 THEN 'selection character has no selection line' WHEN 12 THEN 'selection character is outside the UTF-16 line length' WHEN 13 THEN 'selection character precedes the symbol span' WHEN 14 THEN 'selection character follows the symbol span' END AS reason FROM o) SELECT k AS id, reason FROM w WHERE reason IS NOT NULL""", raw=True)
def span_rules(spark, d):
    #        start, char, end, char, selection, char; lines of 5, 4 (a pair of surrogates counts twice) and 0 characters
    rules = [(None, 0, 1, 0, None, None), (-1, 0, 1, 0, None, None), (0, -1, 1, 0, None, None), (0, 0, 1, -2, None, None), (1, 0, 0, 0, None, None), (0, 4, 0, 3, None, None), (0, 0, 3, 0, None, None), (1, 5, 2, 0, None, None), (0, 0, 1, 5, None, None), (0, 0, 1, 0, 2, 0), (0, 0, 1, 0, 0, -1), (0, 0, 1, 0, None, 3), (0, 0, 2, 0, 1, 5), (0, 3, 1, 0, 0, 2), (0, 0, 1, 2, 1, 3), (0, 0, 1, 4, 0, 5), (0, 0, 2, 0, 2, 0)]
    names = ("start_line", "start_character", "end_line", "end_character", "selection_line", "selection_character")
    rule = F.element_at(F.array(*[F.struct(*[F.lit(v).cast("int").alias(n) for n, v in zip(names, r)]) for r in rules]), (F.col("k") % len(rules) + 1).cast("int"))
    rows = numbers(spark, d).select(F.col("k").alias("id"), F.col("k").alias("file_id"), rule.alias("x")).select("id", "file_id", "x.*")
    f = numbers(spark, d).select(F.col("k").alias("id"), F.lit("abcde\r\na😀b\n").alias("source"))
    return H.invalid_spans(rows, f).select("id", "reason")


# --- column functions


@query(KEYS + """ SELECT k, 'T' || k AS a, 'Q' || k AS b, 'U' || k AS c, '' AS f, 'm' || k AS m FROM o""", raw=True)
def type_names(spark, d):
    n = numbers(spark, d)
    t = lambda s: K.bare_type(text("k", s))
    return n.select("k", t("const ns::T@<int> &").alias("a"), t("&'a mut pkg.Q@").alias("b"), t("struct U@ *[]").alias("c"), t("void (*)(@)").alias("f"), K.member_name(text("k", "a.b. m@")).alias("m"))


@query(KEYS + " SELECT k, 'R' || k AS a, 'S' || k AS b, 'V' || k AS c, CAST(NULL AS VARCHAR) AS n FROM o", raw=True)
def return_types(spark, d):
    t = lambda s: K.return_type(text("k", s))
    return numbers(spark, d).select("k", t("\n  f(x: int): R@ ").alias("a"), t("fn f(x) -> S@").alias("b"), t("let y: V@\nz: W").alias("c"), t("plain @").alias("n"))


@query("SELECT id, starts_with(path, '/building/') AS below, ends_with(path, '1.py') AND id = 1 AS tail FROM files")
def path_scopes(spark, d):
    return A.files(spark, d).select("id", K.in_scope("path", F.lit("./building/")).alias("below"), K.in_scope("path", F.lit("1.py")).alias("tail"))


@query("SELECT id, signature || chr(10) || name AS t, CAST(ceil(length(signature || chr(10) || name) / 4) AS BIGINT) AS n FROM symbols")
def embedding_texts(spark, d):
    got = S.symbol_texts(A.symbols(spark, d).withColumn("resolved_return_type", F.col("signature")))
    return got.select("id", F.col("text").alias("t"), K.token_estimate("text").cast("long").alias("n"))


@query(KEYS + " SELECT k, 5 AS plain, CASE WHEN k % 2 = 0 THEN 3 ELSE 4 END AS utf8, 4 AS utf32 FROM o", raw=True)
def utf16_columns(spark, d):
    n = numbers(spark, d).select("k", F.lit("abcdefgh").alias("p"), F.when(F.col("k") % 2 == 0, "aéb€").otherwise("a😀bc").alias("u"), F.lit("a😀bc").alias("w"), F.lit(5).alias("plain"), F.when(F.col("k") % 2 == 0, 4).otherwise(6).alias("utf8"), F.lit(3).alias("utf32"))
    n = N.converted_columns(N.converted_columns(N.converted_columns(n, "p", "plain", "utf-8"), "u", "utf8", "utf-8"), "w", "utf32", "utf-32")
    return n.select("k", "plain", "utf8", "utf32")


@query(KEYS + " SELECT k AS point_id, CASE WHEN k % 2 = 0 THEN CAST(k % 9 + 2 AS INTEGER) END AS end_line FROM o", raw=True)
def brace_spans(spark, d):
    f = numbers(spark, d).select(F.col("k").alias("id"), F.when(F.col("k") % 2 == 0, F.concat(F.lit('int f(int a)\n{ char *s = "}"; /* } */'), F.repeat(F.lit("\n x();"), (F.col("k") % 9).cast("int")), F.lit("\n}\nint g;"))).otherwise("int f(int a);\nint g() { }").alias("source"))
    return N.body_spans(numbers(spark, d).select(F.col("k").alias("point_id"), F.col("k").alias("file_id"), F.lit(0).alias("line")), f).select("point_id", "end_line")


# --- ingest


def _occurrences(spark, d):
    k = F.col("k")
    i = lambda *c: F.array(*[x.cast("int") for x in c])
    none = F.array().cast("array<int>")
    n = numbers(spark, d)
    a = n.select(k.alias("file_id"), i(k % 90, F.lit(4), F.lit(9)).alias("range"), text("k", "s m p v C@#`a b`().").alias("symbol"), F.lit(1).alias("symbol_roles"), i(k % 90, F.lit(0), k % 90 + 5, F.lit(1)).alias("enclosing_range"), F.lit(0).alias("syntax_kind"))
    b = n.select(k.alias("file_id"), i(k % 90 + 2, F.lit(3), F.lit(6)).alias("range"), text("k", "s m p v D@#").alias("symbol"), F.lit(0).alias("symbol_roles"), none.alias("enclosing_range"), F.lit(0).alias("syntax_kind"))
    c = n.select(k.alias("file_id"), i(k % 90 + 3, F.lit(3), F.lit(6)).alias("range"), text("k", "s m p v x@.").alias("symbol"), F.lit(0).alias("symbol_roles"), none.alias("enclosing_range"), F.when(k % 2 == 0, 15).otherwise(0).alias("syntax_kind"))
    e = n.select(k.alias("file_id"), i(k % 90, F.lit(0), F.lit(1)).alias("range"), text("k", "local @").alias("symbol"), F.lit(1).alias("symbol_roles"), none.alias("enclosing_range"), F.lit(0).alias("syntax_kind"))
    return a.unionByName(b).unionByName(c).unionByName(e)


@query(KEYS + """ SELECT k AS file_id, 'a b' AS name, CASE WHEN k % 3 = 0 THEN 'constructor' ELSE 'method' END AS kind, CAST(k % 90 AS INTEGER) AS start_line, CAST(k % 90 + 5 AS INTEGER) AS end_line, CAST(k % 90 AS INTEGER) AS selection_line, 4 AS selection_character,
    's m p v C' || k || '#' AS parent_symbol, CASE WHEN k % 3 = 0 THEN 'def a' || k END AS signature FROM o""", raw=True)
def scip_definitions(spark, d):
    infos = numbers(spark, d).where("k % 3 = 0").select(text("k", "s m p v C@#`a b`().").alias("symbol"), F.array(text("k", "```py\ndef a@\n```"), F.lit("more")).alias("documentation"), F.lit("").alias("display_name"), F.lit(9).alias("kind"))
    return N.definitions(_occurrences(spark, d), infos).select("file_id", "name", "kind", "start_line", "end_line", "selection_line", "selection_character", "parent_symbol", "signature")


@query(KEYS + """ SELECT k AS file_id, CAST(k % 90 + 2 AS INTEGER) AS line, 'type' AS kind, k AS caller_id FROM o UNION ALL SELECT k, CAST(k % 90 + 3 AS INTEGER), 'call', k FROM o WHERE k % 2 = 0""", raw=True)
def scip_references(spark, d):
    own = numbers(spark, d).select(F.col("k").alias("id"), F.col("k").alias("file_id"), (F.col("k") % 90).cast("int").alias("start_line"), (F.col("k") % 90 + 5).cast("int").alias("end_line"))
    return N.references(_occurrences(spark, d), own).select("file_id", "line", "kind", "caller_id")


@query(KEYS + " SELECT 's m p' || (k % 7) || ' v C' || k || '#' AS symbol FROM o WHERE k % 7 > 2", raw=True)
def external_packages(spark, d):
    n = numbers(spark, d).select(F.concat(F.lit("s m p"), (F.col("k") % 7).cast("string"), text("k", " v C@#")).alias("symbol"))
    own = spark.createDataFrame([(f"s m p{i} v X#",) for i in range(3)], "symbol string")
    return N.external_symbols(n, own)


@query("""SELECT id, path, CASE WHEN id % 3 = 0 THEN 0 WHEN id NOT IN (SELECT file_id FROM symbols WHERE id % 2 = 0) THEN 1 END AS reason FROM files WHERE id % 3 = 0 OR id NOT IN (SELECT file_id FROM symbols WHERE id % 2 = 0) ORDER BY reason, path LIMIT 300""")
def supplement_plan(spark, d):
    f = A.files(spark, d)
    return N.supplement_plan(f, A.symbols(spark, d).where("id % 2 = 0"), f.where("id % 3 <> 0"), 300).select("id", "path", F.col("reason").cast("int").alias("reason"))


def _served(spark, d, shift: int):
    k = F.col("k")
    n = numbers(spark, d).where("k % 2 = 0")
    return n.select((k * 10 + shift).alias("id"), F.floor(k / 4).cast("long").alias("file_id"), F.lit("f").alias("name"), F.lit("function").alias("kind"), (k % 4 * 10).cast("int").alias("start_line"), F.lit(0).alias("start_character"), (k % 4 * 10 + 3).cast("int").alias("end_line"), (k % 4 * 10).cast("int").alias("selection_line"), F.lit(4).alias("selection_character"), text("k", "def f(@)").alias("signature"), F.lit(None).cast("string").alias("parent_name"))


@query(KEYS + " SELECT k // 4 AS file_id, k * 10 AS indexed_id, k * 10 + 1 AS served_id, 10000 + 6000 + 4000 + 500 + 200 + 100 AS score FROM o WHERE k % 2 = 0", raw=True)
def stable_matches(spark, d):
    return N.matched(_served(spark, d, 0), _served(spark, d, 1))


@query(KEYS + " SELECT k * 10 + 1 AS id FROM o WHERE k % 2 = 0 AND k % 3 = 0", raw=True)
def missing_supplements(spark, d):
    have = _served(spark, d, 0).where("(id div 10) % 3 <> 0")
    gone = _served(spark, d, 0).where("(id div 10) % 3 = 0").withColumns({"start_line": F.lit(900), "end_line": F.lit(901), "selection_line": F.lit(900)})
    return N.supplements(_served(spark, d, 1), have.unionByName(gone)).select("id")


@query(KEYS + " SELECT k AS point_id, k * 10 AS symbol_id FROM o WHERE k % 2 = 0", raw=True)
def exact_callees(spark, d):
    s = _served(spark, d, 0)
    f = s.select(F.col("file_id").alias("id")).distinct().select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit("main").alias("branch"))
    pts = s.select((F.col("id") / 10).cast("long").alias("point_id"), F.concat(F.lit("p"), F.col("file_id").cast("string")).alias("path"), F.lit("main").alias("branch"), "name", "kind", F.col("selection_line").alias("line"), F.lit(4).alias("character"))
    off = pts.withColumns({"point_id": -F.col("point_id") - 1, "character": F.lit(7)})
    return N.exact_callee(pts.unionByName(off), s, f)


@query("SELECT id, CASE WHEN id % 2 = 0 AND resolution_method = 'unresolved' THEN 'filled' END AS resolved_type_signature FROM calls")
def enrich_open(spark, d):
    c = A.calls(spark, d).withColumns({"resolved_type_signature": F.lit(None).cast("string"), "definition_path": F.lit(None).cast("string")}).select("id", "resolution_method", "definition_path", "resolved_type_signature")
    facts = c.where("id % 2 = 0").select("id", F.lit("filled").alias("resolved_type_signature"))
    return N.enriched(c, facts, ["resolved_type_signature"], only_open=True).select("id", "resolved_type_signature")


@query(KEYS + " SELECT k AS point_id, k + 5 AS function_id FROM o WHERE k % 3 = 0 AND k % 2 = 0", raw=True)
def forward_declarations(spark, d):
    k = F.col("k")
    refs = numbers(spark, d).select(k.alias("point_id"), k.alias("file_id"), F.when(k % 3 == 0, "a.hpp").otherwise("a.cpp").alias("path"), F.when(k % 2 == 0, 50).otherwise(5).alias("line"), text("k", "s@").alias("symbol"))
    fns = numbers(spark, d).select(text("k", "s@").alias("symbol"), (k + 5).alias("id"))
    bodies = numbers(spark, d).select(k.alias("file_id"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    return N.header_declarations(refs, fns, bodies).select("point_id", "function_id")


@query(KEYS + " SELECT k AS file_id, CASE WHEN k % 2 = 0 THEN 'matched' ELSE 'text' END AS origin FROM o WHERE k % 2 = 0 OR k % 3 <> 0", raw=True)
def macro_supplements(spark, d):
    k = F.col("k")
    m = numbers(spark, d).select(k.alias("file_id"), F.lit("M").alias("name"), F.lit(3).alias("line"), F.lit(4).alias("end_line"), F.when(k % 3 == 0, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("conditions"))
    s = numbers(spark, d).where("k % 2 = 0").select(k.alias("file_id"), F.lit("M").alias("name"), F.lit(4).alias("start_line"), k.alias("id"))
    return N.macro_symbols(m, s).select("file_id", "origin")


@query(KEYS + " SELECT k AS point_id, CASE k % 3 WHEN 0 THEN k * 10 WHEN 1 THEN k * 10 + 1 ELSE k * 10 + 2 END AS occ_id FROM o", raw=True)
def nearest_occurrences(spark, d):
    k = F.col("k")
    pts = numbers(spark, d).select(k.alias("point_id"), k.alias("file_id"), F.when(k % 3 == 2, 6).otherwise(1).alias("line"), F.when(k % 3 == 0, 12).when(k % 3 == 1, 23).otherwise(50).alias("character"))
    occ = numbers(spark, d).select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(n) for n, v in zip(("start_line", "start_character", "end_line", "end_character"), r)]) for i, r in enumerate([(1, 10, 1, 15), (1, 20, 1, 22), (4, 0, 9, 0)])])).alias("x")).select(k.alias("file_id"), (k * 10 + F.col("x.i")).alias("occ_id"), "x.*")
    return R.nearest_occurrence(pts, occ)


@query(KEYS + """ SELECT 'p' || (k // 2) AS path, 1 AS occurrences, 1 AS symbols, CAST(len(['x', 'y']) AS INTEGER) AS docs FROM o WHERE k % 2 = 0""", raw=True)
def merged_documents(spark, d):
    i = lambda *c: F.array(*[F.lit(x) for x in c])
    k = F.col("k")
    occ = F.array(F.struct(i(1, 2, 3).alias("range"), text("k", "s").alias("symbol"), F.lit(1).alias("symbol_roles"), F.when(k % 2 == 0, i(1, 0, 9)).otherwise(F.array().cast("array<int>")).alias("enclosing_range"), F.lit(0).alias("syntax_kind")))
    sym = F.array(F.struct(F.lit("s").alias("symbol"), F.when(k % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))).alias("documentation"), F.array().cast("array<string>").alias("relationships")))
    docs = numbers(spark, d).select(F.concat(F.lit("p"), F.floor(k / 2).cast("string")).alias("path"), occ.alias("occurrences"), sym.alias("symbols"))
    return W.merged_documents(docs).select("path", F.size("occurrences").alias("occurrences"), F.size("symbols").alias("symbols"), F.size(F.element_at("symbols", 1)["documentation"]).alias("docs"))


# --- resolution


@query("SELECT id, callee_id, resolution_method FROM calls")
def resolve_member_calls(spark, d):
    raw = A.raw_calls(spark, d).withColumn("callee_name", F.concat(F.lit("self.x."), "callee_name"))
    return R.resolve_calls(raw, A.symbols(spark, d), A.files(spark, d), A.dirty_files(spark, d).limit(0)).select("id", "callee_id", "resolution_method")


@query("""SELECT t.id, CASE WHEN b.k = 1 THEN b.own WHEN a.n = 1 OR (a.n > 1 AND a.nf = 1) THEN a.first END AS type_id, CASE WHEN b.k = 1 THEN 'name_same_file' WHEN a.n = 1 THEN 'name_unique' WHEN a.n > 1 AND a.nf = 1 THEN 'name_single_file' ELSE 'unresolved' END AS resolution_method
    FROM type_uses t LEFT JOIN by_name a ON a.name = t.type_name LEFT JOIN by_file b ON b.name = t.type_name AND b.file_id = t.file_id""")
def resolve_bare_types(spark, d):
    none = F.lit(None)
    raw = A.type_uses(spark, d).withColumns({"type_id": none.cast("long"), "resolution_method": F.lit("unresolved"), "type_name": F.concat(F.lit("const std::"), "type_name", F.lit("<int> &")), "definition_path": none.cast("string"), "definition_line": none.cast("int"), "definition_character": none.cast("int")})
    return R.resolve_types(raw, A.symbols(spark, d), A.files(spark, d), A.dirty_files(spark, d).limit(0)).select("id", "type_id", "resolution_method")


def _headers(spark, d):
    f = A.files(spark, d).select("id", F.regexp_replace("path", "py$", "h").alias("path"), "branch", F.lit("c").alias("language"))
    common = f.select(F.regexp_extract("path", "^(/[^/]+)/", 1).alias("s")).distinct().select((F.lit(10**9) + F.ascii(F.substring("s", 2, 1)) * 256 + F.ascii(F.substring("s", 3, 1))).cast("long").alias("id"), F.concat("s", F.lit("/common.h")).alias("path"), F.lit("main").alias("branch"), F.lit("c").alias("language"))
    return f, f.unionByName(common)


@query("""SELECT id * 2 AS id, id AS t, 'include_suffix_unique' AS m FROM files UNION ALL SELECT id * 2 + 1, 1000000000 + ascii(path[2:2]) * 256 + ascii(path[3:3]), 'include_basename_nearest' FROM files""")
def include_suffixes(spark, d):
    own, every = _headers(spark, d)
    imports = own.select((F.col("id") * 2).alias("id"), "path", F.concat(F.lit('"./'), F.regexp_extract("path", r"^/[^/]+/(.*)$", 1), F.lit('"')).alias("raw")).unionByName(own.select((F.col("id") * 2 + 1).alias("id"), "path", F.lit("<common.h>").alias("raw")))
    return R.by_include(imports, every)


@query("""SELECT id * 4 + j AS id, CASE WHEN j < 3 THEN id END AS resolved_id, CASE WHEN j < 3 THEN 'filesystem_exact' ELSE 'external_dependency' END AS resolution_method FROM files, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE id % 4 IN (0, 1) OR j IN (0, 3)""")
def resolve_imports(spark, d):
    # python, typescript, java and c files that import themselves in all their ways, and one thing outside
    n = F.col("id") % 4
    ext = F.element_at(F.array(*map(F.lit, ("py", "ts", "java", "c"))), (n + 1).cast("int"))
    f = A.files(spark, d).select("id", F.concat(F.lit("/r"), F.when(n == 2, "/src/main/java").otherwise(""), F.regexp_replace("path", "py$", ""), ext).alias("path"), F.element_at(F.array(*map(F.lit, ("python", "typescript", "java", "c"))), (n + 1).cast("int")).alias("language"), "branch", F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("s"), F.regexp_extract("path", r"^/(.*)\.py$", 1).alias("whole"))
    dot = lambda c: F.translate(c, "/", ".")
    ways = (
        F.when(n == 0, F.array(F.concat(F.lit("."), "s"), F.concat(F.lit(".."), F.regexp_extract(dot("whole"), r"\.(n.*)$", 0), F.lit("")), dot("whole"), F.lit("os")))
        .when(n == 1, F.array(F.concat(F.lit("./"), "s"), F.concat(F.lit("./"), "s", F.lit(".js")), F.concat(F.lit("./x/../"), "s", F.lit(".ts")), F.lit("react")))
        .when(n == 2, F.array(dot("whole"), F.lit(None), F.lit(None), F.lit("java.util.List")))
        .otherwise(F.array(F.concat("s", F.lit(".c")), F.lit(None), F.lit(None), F.lit("<stdio.h>")))
    )
    i = f.select("id", F.posexplode(ways).alias("j", "raw_import")).where("raw_import is not null")
    i = i.select((F.col("id") * 4 + F.col("j")).alias("id"), F.col("id").alias("file_id"), F.regexp_replace("raw_import", r"^\.\.\.", "..").alias("raw_import"), F.lit(None).cast("long").alias("resolved_id"), F.lit("unresolved").alias("resolution_method"))
    return R.resolve_imports(i, f.select("id", "path", "language", "branch"), root="/r").select("id", "resolved_id", "resolution_method")


@query(KEYS + " SELECT k AS file_id, 0 AS position, '/i' || (k // 10 * 10) AS dir FROM o WHERE k % 10 <> 9 UNION ALL SELECT k, 0, '/i9' FROM o WHERE k % 10 = 9", raw=True)
def include_lists(spark, d):
    k = F.col("k")
    at = F.concat(F.lit("/w/d"), F.floor(k / 10).cast("string"))
    f = numbers(spark, d).select(k.alias("id"), F.when(k % 10 == 9, text("k", "/v/u@/a.c")).otherwise(F.concat(at, text("k", "/f@.c"))).alias("path"))
    units = numbers(spark, d).where("k % 10 = 0").select(F.concat(at, text("k", "/f@.c")).alias("path"), F.array(text("k", "/i@")).alias("includes"))
    own = numbers(spark, d).where("k % 10 = 9").select(text("k", "/v/u@/a.c").alias("path"), F.array(F.lit("/i9")).alias("includes"))
    return R.include_lists(units.unionByName(own), f)


@query(KEYS + " SELECT '/h/f' || k || '.h' AS path, CASE k % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'cpp' WHEN 2 THEN 'mixed' ELSE 'ambiguous' END AS language FROM o", raw=True)
def header_languages(spark, d):
    k = F.col("k")
    n = numbers(spark, d)
    heads = n.select(text("k", "/h/f@.h").alias("path"), F.lit("c").alias("language"))
    units = spark.createDataFrame([("/s/a.c", "c"), ("/s/b.cpp", "cpp")], "path string, language string")
    e = n.select(F.explode(F.when(k % 4 == 0, F.array(F.lit("/s/a.c"))).when(k % 4 == 1, F.array(F.lit("/s/b.cpp"))).when(k % 4 == 2, F.array(F.lit("/s/a.c"), F.lit("/s/b.cpp"))).otherwise(F.array().cast("array<string>"))).alias("src"), text("k", "/h/f@.h").alias("dst"))
    return R.header_language(heads.unionByName(units), e)


# --- graph


def _blocks(spark, d):
    """Rings of six nodes, and chains of six in every second block."""
    k = F.col("k")
    return numbers(spark, d).select(k.alias("src"), F.when(k % 12 < 6, k - k % 6 + (k + 1) % 6).when(k % 6 < 5, k + 1).alias("dst")).where("dst is not null")


@query(KEYS + """, e AS (SELECT k AS a, CASE WHEN k % 12 < 6 THEN k - k % 6 + (k + 1) % 6 WHEN k % 6 < 5 THEN k + 1 END AS b FROM o), r(a, b) AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b WHERE e.b IS NOT NULL)
    SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1""", raw=True)
def ring_components(spark, d):
    return G.strong_components(_blocks(spark, d), driver_edges=100)


@query(""", e AS (SELECT DISTINCT source_symbol_id AS a, target_symbol_id AS b FROM relationships WHERE target_symbol_id IS NOT NULL), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    bad AS (SELECT a FROM r WHERE a = b UNION SELECT r.a FROM r JOIN r q ON q.a = r.b AND q.b = r.b), l(node, depth) AS (SELECT id, 0 FROM symbols WHERE id NOT IN (SELECT a FROM bad) UNION SELECT e.a, depth + 1 FROM l JOIN e ON e.b = l.node WHERE e.a NOT IN (SELECT a FROM bad))
    SELECT node, max(depth) AS level FROM l GROUP BY 1""")
def topo_levels(spark, d):
    return G.topological_levels(A.symbols(spark, d).select(F.col("id").alias("node")), _sparse(spark, d))


@query(""", m AS (SELECT DISTINCT language FROM files), e AS (SELECT source_symbol_id AS a, target_symbol_id AS b FROM relationships WHERE target_symbol_id IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(node, seen) AS (SELECT a, a FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.seen),
    g AS (SELECT node, min(seen) AS c FROM w GROUP BY 1), r(a, b) AS (SELECT DISTINCT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), z AS (SELECT x.a AS node, min(least(x.a, x.b)) AS c FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1)
    SELECT 'files' AS measure, count(*) AS value FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'modules', count(*) FROM m
    UNION ALL SELECT 'module_dependencies', count(DISTINCT f.language || '>' || h.language) FROM e JOIN symbols s ON s.id = e.a JOIN files f ON f.id = s.file_id JOIN symbols t ON t.id = e.b JOIN files h ON h.id = t.file_id WHERE f.language <> h.language
    UNION ALL SELECT 'components', count(*) FROM (SELECT c FROM g GROUP BY c HAVING count(*) > 1) UNION ALL SELECT 'cycles', count(DISTINCT c) FROM z""")
def codebase_summary(spark, d):
    s, f = A.symbols(spark, d), A.files(spark, d)
    mods = f.select("language").distinct().select(F.abs(F.xxhash64("language")).alias("id"), F.col("language").alias("name"))
    owners = f.select(F.col("id").alias("file_id"), F.abs(F.xxhash64("language")).alias("module_id"))
    got = G.summary(s, f, _sparse(spark, d), owners, mods)
    return spark.createDataFrame([(k, len(v) if isinstance(v, list) else v) for k, v in got.items()], "measure string, value long")


@query(KEYS + """, t(node, depth, path) AS (SELECT CAST(0 AS BIGINT), 0, [CAST(0 AS BIGINT)] UNION ALL SELECT o.k, depth + 1, list_append(path, o.k) FROM t JOIN o ON o.k > 0 AND (o.k - 1) // 4 = t.node WHERE depth < 4)
    SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INTEGER) AS place, node AS symbol_id, depth FROM t""", raw=True)
def trace_tree(spark, d):
    k = F.col("k")
    e = numbers(spark, d).where("k > 0").select(F.floor((k - 1) / 4).cast("long").alias("src"), k.alias("dst"), ((k - 1) % 4).cast("int").alias("line"), F.lit("m").alias("method"))
    steps, _ = G.trace(e, 0, 4)
    return spark.createDataFrame([(i, s["symbol_id"], s["depth"]) for i, s in enumerate(steps)], "place int, symbol_id long, depth int")


@query("WITH RECURSIVE p(node, place) AS (SELECT CAST(max(o_orderkey) AS BIGINT), 0 FROM orders UNION ALL SELECT node // 2, place + 1 FROM p WHERE node > 0) SELECT node, place FROM p", raw=True)
def shortest_path(spark, d):
    n = numbers(spark, d)
    e = n.where("k > 0").select(F.col("k").alias("src"), F.floor(F.col("k") / 2).cast("long").alias("dst"))
    path = G.shortest_path(e, n.agg(F.max("k")).first()[0], 0, 40)
    return spark.createDataFrame(list(zip(path, range(len(path)))), "node long, place int")


DIRECTORIES = "WITH o AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)"


def _pairs(spark, d):
    n = A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    sample = F.array().cast("array<string>").alias("sample_files")
    a = n.select(text("k", "a@").alias("from_dir"), text("k", "b@").alias("to_dir"), F.lit(3).cast("long").alias("count"), sample)
    return a.unionByName(n.select(text("k", "b@").alias("from_dir"), text("k", "a@").alias("to_dir"), (F.col("k") + 1).alias("count"), sample))


@query(DIRECTORIES + " SELECT 'a' || k || ',b' || k AS directories, k + 4 AS edge_count FROM o ORDER BY 2 DESC, 1 LIMIT 20", raw=True)
def directory_cycles(spark, d):
    return spark.createDataFrame([(",".join(c["directories"]), c["edge_count"]) for c in G.directory_cycles(_pairs(spark, d))], "directories string, edge_count long")


@query(DIRECTORIES + " SELECT 'b' || k AS from_dir, 'a' || k AS to_dir, CAST(2 * (row_number() OVER (ORDER BY 'a' || k) - 1) AS INTEGER) AS from_rank, CAST(2 * row_number() OVER (ORDER BY 'a' || k) - 1 AS INTEGER) AS to_rank, k + 1 AS edge_count FROM o ORDER BY edge_count DESC, 1 LIMIT 20", raw=True)
def layer_violations(spark, d):
    return spark.createDataFrame([(v["from_dir"], v["to_dir"], v["from_rank"], v["to_rank"], v["edge_count"]) for v in G.layer_violations(_pairs(spark, d))], "from_dir string, to_dir string, from_rank int, to_rank int, edge_count long")


@query("""SELECT caller_id AS src, callee_id AS dst, 'call' AS kind, resolution_method AS method FROM calls WHERE callee_id IS NOT NULL UNION ALL SELECT symbol_id, type_id, 'type', resolution_method FROM type_uses WHERE type_id IS NOT NULL
    UNION ALL SELECT source_symbol_id, target_symbol_id, 'inheritance', resolution_method FROM relationships WHERE target_symbol_id IS NOT NULL""")
def symbol_edges(spark, d):
    return E.symbol_edges(A.calls(spark, d), A.type_uses(spark, d), A.relationships(spark, d), A.symbols(spark, d), ("call", "type", "inheritance"))


@query("""SELECT c.id, c.caller_id, s.name AS source_name, f.path AS source_path, c.callee_id, t.name AS target_name, g.path AS target_path FROM calls c JOIN symbols s ON s.id = c.caller_id JOIN files f ON f.id = s.file_id
    JOIN symbols t ON t.id = c.callee_id JOIN files g ON g.id = t.file_id""")
def all_call_edges(spark, d):
    return E.calls(A.calls(spark, d), A.symbols(spark, d), A.files(spark, d), resolved_only=True, limit=None).select("id", "caller_id", "source_name", "source_path", "callee_id", "target_name", "target_path")


@query("SELECT c.id, c.symbol_id, s.name AS source_name, c.type_id, t.name AS target_name FROM type_uses c JOIN symbols s ON s.id = c.symbol_id LEFT JOIN symbols t ON t.id = c.type_id")
def all_type_edges(spark, d):
    return E.type_uses(A.type_uses(spark, d), A.symbols(spark, d), A.files(spark, d), limit=None).select("id", "symbol_id", "source_name", "type_id", "target_name")


@query("""WITH RECURSIVE a AS (SELECT file_id, dependent_id, dep_kind FROM (SELECT CAST(l_suppkey AS BIGINT) AS file_id, CAST(l_partkey AS BIGINT) AS dependent_id, 'ref' AS dep_kind FROM lineitem) GROUP BY ALL)
    SELECT * FROM a WHERE file_id % 3 <> 0 AND dependent_id % 3 <> 0 UNION ALL SELECT * FROM a WHERE (file_id % 3 = 0 OR dependent_id % 3 = 0) AND file_id % 2 = 0""", raw=True)
def reverse_deps_refreshed(spark, d):
    old = A.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("file_id"), F.col("l_partkey").cast("long").alias("dependent_id"), F.lit("ref").alias("dep_kind")).distinct()
    ids = old.select(F.col("file_id").alias("id")).union(old.select("dependent_id")).where("id % 3 = 0").distinct()
    return E.refreshed_reverse_deps(old, old.where("file_id % 2 = 0"), ids)


# --- retrieval


@query("SELECT id, 0.0::DOUBLE AS score FROM symbols WHERE starts_with(name, 'fn_1') ORDER BY id LIMIT 30")
def prefix_search(spark, d):
    return S.prefix_fallback(A.symbols(spark, d), "FN_1", 30)


@query("SELECT id, name, kind, resolved_return_type || chr(10) || signature || chr(10) || name AS signature FROM symbols")
def search_documents(spark, d):
    return S.documents(A.symbols(spark, d)).withColumn("signature", F.regexp_replace("signature", "^\n", "")).select("id", "name", "kind", "signature")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE name END AS name FROM symbols WHERE id % 5 <> 0 OR id % 3 = 0")
def search_refresh(spark, d):
    s = A.symbols(spark, d).select("id", "name")
    return S.refreshed(s, s.where("id % 3 = 0").withColumn("name", F.lit("new")), s.where("id % 5 = 0").select("id"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'first' ELSE 'second' END AS src FROM symbols WHERE id % 4 = 0 OR id % 6 = 0")
def preferred_rows(spark, d):
    s = A.symbols(spark, d).select("id")
    return S.preferred(s.where("id % 4 = 0").withColumn("src", F.lit("first")), s.where("id % 6 = 0").withColumn("src", F.lit("second"))).select("id", "src")


@query("""WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 3) SELECT CAST(vec_id AS VARCHAR) AS sha, round(sqrt(list_sum(list_transform(list_zip(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance
    FROM embeddings, q WHERE vec_id % 2 = 1 ORDER BY sqrt(list_sum(list_transform(list_zip(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), sha LIMIT 15""", raw=True)
def commit_neighbours(spark, d):
    v = A.table(spark, d, "embeddings")
    q = v.where("vec_id = 3").first()["embedding"]
    return S.nearest(v.where("vec_id % 2 = 1").select(F.col("vec_id").cast("string").alias("sha"), "embedding"), q, "sha", limit=15).withColumns(r6("distance"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'kept' ELSE 'made' END AS how FROM orders", raw=True)
def embedding_stage(spark, d):
    n = numbers(spark, d).select(F.col("k").alias("id"), text("k", "word@").alias("text"))
    known = n.where("id % 2 = 0").select("id", F.array(F.lit(9.0).cast("float")).alias("embedding"), F.sha2("text", 256).alias("content_hash")).unionByName(n.where("id % 2 = 1").select("id", F.array(F.lit(9.0).cast("float")).alias("embedding"), F.lit("stale").alias("content_hash")))
    got = S.embedded(n, S.HashingProvider(8), known)
    return got.select("id", F.when(F.size("embedding") == 1, "kept").otherwise("made").alias("how"))


# --- streams and health reports


@query("SELECT path, change FROM (SELECT 'f' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE 'created' END AS change FROM customer WHERE c_custkey % 5 <> 0)", raw=True)
def poll_changes(spark, d):
    k = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    old = k.where("k % 3 = 0 or k % 5 = 0").select(text("k", "f@").alias("path"), F.lit(1).cast("long").alias("modified"))
    new = k.select(text("k", "f@").alias("path"), F.when(F.col("k") % 5 == 0, 1).otherwise(2).cast("long").alias("modified"))
    return W.changes(old, new, "modified")


@query("SELECT event_type, CAST(epoch(time_bucket(INTERVAL 30 MINUTES, ts)) AS BIGINT) + 1800 * j AS start, count(*) AS events FROM events, (SELECT unnest([0, -1]) AS j) GROUP BY 1, 2", raw=True)
def sliding_counts(spark, d):
    e = A.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return X.counts(e, ["event_type"], "ts", "1 hour", "30 minutes").select("event_type", F.unix_seconds("start").alias("start"), "events")


@query("SELECT code FROM (SELECT unnest(['DUPLICATE_PATHS', 'STRUCTURAL_INDEX_MISSING', 'SYMBOL_LESS_FILES', 'THRESHOLD_MIN_TYPE_RESOLUTION_RATE', 'THRESHOLD_MAX_SYMBOL_LESS_FILES', 'REQUIRED_GLOB_UNMATCHED', 'REQUIRED_SYMBOL_MISSING', 'PROVENANCE_MISSING', 'DIRTY_FILE_LIMIT', 'BASELINE_TOO_OLD']) AS code) WHERE code <> 'SYMBOL_LESS_FILES'", raw=True)
def health_codes(spark, d):
    from graphmill import schema

    f = A.files(spark, d).withColumn("source", F.repeat(F.lit("x\n"), 500))
    f = f.unionByName(f.where("id = 1")).unionByName(f.where("id = 2").withColumns({"id": F.lit(-5).cast("long"), "language": F.lit("bare"), "path": F.lit("/bare.py")}))
    s = A.symbols(spark, d).where("end_line < 400")
    none = {t: schema.empty(spark, t) for t in ("symbol_refs", "type_refs", "symbol_relationships", "file_imports")}
    policy = H.Policy.of("strict", minima={"minTypeResolutionRate": 0.5}, maxima={"maxSymbolLessFiles": 0}, required_globs=("/nothing/**", "/building/**/*.py"), required_symbols=(("/none.py", "x"),), max_dirty_files=3, max_baseline_age=10)
    got = H.report({"files": f, "symbols": s} | none, policy, freshness=H.Freshness(dirty_files=4, baseline_age=None))
    return spark.createDataFrame(sorted({(i["code"],) for i in got["issues"] if i["code"] not in ("REQUIRED_FILE_SYMBOL_LESS",)}), "code string")


@query("SELECT language, count(*) AS files, sha256(string_agg(path, chr(10) ORDER BY path)) AS digest FROM files WHERE starts_with(path, '/building/') OR starts_with(path, '/machinery/') GROUP BY 1")
def scope_manifest(spark, d):
    return H.scope(A.files(spark, d), None, ["/building/**", "/machinery/**"], [])


@query("SELECT unnest(['SCIP_SCOPE_MISMATCH', 'SCIP_SCOPE_UNCOVERED_FILES', 'SCIP_SCOPE_INDEXER_MISSING', 'SCIP_SCOPE_REQUIRED', 'SCIP_SCOPE_COMPDB_MISSING']) AS code", raw=True)
def scope_codes(spark, d):
    f = A.files(spark, d).select("path", "language")
    cover = f.where("path not like '%7.py'").select("path", "language", F.lit("success").alias("status"), F.lit("baseline").alias("layer"), F.lit(True).alias("current"))
    got = H.scope_issues(f, f.where("path not like '%3.py'"), cover, f.where("language <> 'building'").select("language", F.lit("scip").alias("provider")).distinct(), requested=False, migration_grade=True, c_family=True, compdb=None)
    return spark.createDataFrame([(c,) for c in got], "code string")


@query("""SELECT count(*) AS commits, count(DISTINCT author) AS authors, CAST(sum(c) AS BIGINT) AS churn, CAST((1000000000 - max(timestamp)) // 86400 AS BIGINT) AS days, CASE WHEN (1000000000 - max(timestamp)) // 86400 <= 14 THEN 'high' WHEN (1000000000 - max(timestamp)) // 86400 <= 60 THEN 'medium' ELSE 'low' END AS recency,
    CASE WHEN count(DISTINCT author) >= 5 OR count(DISTINCT author) / count(*) >= 0.6 THEN 'high' WHEN count(DISTINCT author) >= 3 OR count(DISTINCT author) / count(*) >= 0.35 THEN 'medium' ELSE 'low' END AS dispersion, CASE WHEN sum(c) >= 500 OR sum(c) / count(*) >= 120 THEN 'high' WHEN sum(c) >= 150 OR sum(c) / count(*) >= 40 THEN 'medium' ELSE 'low' END AS churn_level
    FROM (SELECT sha, author, timestamp, (SELECT coalesce(sum(coalesce(insertions, 0) + coalesce(deletions, 0)), 0) FROM commit_files WHERE commit_sha = sha) AS c FROM commits WHERE timestamp < 1000000000 AND starts_with(author, 'Customer#00000000'))""")
def risk_levels(spark, d):
    c = A.commits(spark, d).where("timestamp < 1000000000 and author like 'Customer#00000000%'")
    return C.risk(c, A.commit_files(spark, d), 1_000_000_000).select("commits", "authors", "churn", "days", "recency", "dispersion", "churn_level")


_TOOL = "SELECT {} AS n"


@query("SELECT 'lookup' AS tool, count(*) AS n FROM symbols WHERE lower(name) = 'dup_4' UNION ALL SELECT 'files', least(20, count(*)) FROM files WHERE starts_with(path, '/building/n7/') UNION ALL SELECT 'graph', least(1000, count(*)) FROM calls JOIN symbols s ON s.id = caller_id WHERE callee_id IS NOT NULL AND s.name = 'fn_1' UNION ALL SELECT 'history', 7 UNION ALL SELECT 'diff', count(*) FROM (SELECT 1 WHERE false)")
def tool_results(spark, d):
    import json

    from graphmill.plans import tools

    e = tools.Engine({"symbols": A.symbols(spark, d), "files": A.files(spark, d), "symbol_refs": A.calls(spark, d), "commits": A.commits(spark, d), "commit_files": A.commit_files(spark, d), "commit_refs": A.commit_refs(spark, d)})
    asked = {
        "lookup": json.loads(tools.call(e, "lookup", symbol="DUP_4"))["symbols"],
        "files": json.loads(tools.call(e, "lookup", file="/building/n7"))["files"],
        "graph": json.loads(tools.call(e, "graph", source="fn_1"))["edges"],
        "history": json.loads(tools.call(e, "history", limit=7))["commits"],
        "diff": json.loads(tools.call(e, "diff", old="main", new="main"))["added"]["symbols"],
    }
    return spark.createDataFrame([(k, len(v)) for k, v in asked.items()], "tool string, n long")


@query("SELECT symbol_id AS src, min(ref_line) AS line FROM type_uses WHERE type_id = (SELECT type_id FROM type_uses WHERE type_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1")
def type_dependents(spark, d):
    e = A.type_uses(spark, d).where("type_id is not null").select(F.col("symbol_id").alias("src"), F.col("type_id").alias("dst"), F.col("ref_line").alias("line"), F.col("resolution_method").alias("method"))
    top = e.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("node"))
    one = G.reach(e, top, 1, backward=True).where("depth = 1").select(F.col("node").alias("src"))
    return e.join(top.withColumnRenamed("node", "dst"), "dst", "left_semi").join(one, "src", "left_semi").groupBy("src").agg(F.min("line").alias("line"))


@query("SELECT caller_id AS src, callee_id AS dst, 1 AS hop FROM calls WHERE callee_id = (SELECT callee_id FROM calls WHERE callee_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1, 2")
def one_hop_edges(spark, d):
    e = _call_edges(spark, d)
    top = e.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("node"))
    return G.bfs_edges(e, top, 1, 1000, backward=True)


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS f FROM t), g AS (SELECT count(*) AS docs, avg(n) AS a, count(*) FILTER (WHERE f > 0) AS df FROM c)
    SELECT doc_id, round(-ln((docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / a)), 6) AS score FROM c, g WHERE f > 0""", raw=True)
def bm25_postings(spark, d):
    terms, lengths = S.postings(A.table(spark, d, "documents"), ["text"], "doc_id")
    return S.bm25_from(terms, lengths, "License", "doc_id", None).withColumns(r6("score"))


@query("SELECT sha, message AS text FROM commits WHERE CAST(sha AS BIGINT) % 4 = 1")
def commit_embedding_texts(spark, d):
    c = A.commits(spark, d).withColumn("message", F.when(F.expr("cast(sha as long) % 4 = 0"), " ").otherwise(F.col("message")))
    return S.commit_texts(c, c.where("cast(sha as long) % 4 > 1"))


@query("""SELECT n, id FROM (SELECT 0 AS n, vec_id AS id, row_number() OVER (ORDER BY sqrt(list_sum(list_transform(list_zip(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 2)), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), vec_id) AS r FROM embeddings) WHERE r <= 12""", raw=True)
def graph_semantic_nodes(spark, d):
    from graphmill.plans import tools

    v = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id = 2").first()["embedding"]
    e = tools.Engine({"symbols": A.symbols(spark, d), "files": A.files(spark, d), "symbol_refs": A.calls(spark, d)}, vectors=v, embed=lambda _: q)
    got = tools.graph(e, limit=1, mode="semantic", query="x", semantic_limit=12)
    assert got["mode_used"] == "semantic"
    return spark.createDataFrame([(0, r["id"]) for r in got["semantic_nodes"]], "n int, id long")


@query("SELECT 1 AS layer_rows, path, 'b' AS source FROM files WHERE id % 10 = 0 AND id % 30 <> 0 UNION ALL SELECT 1, path, 'a' FROM files WHERE id % 10 <> 0")
def overlay_batches(spark, d):
    from graphmill.storage import Index, scratch

    index = Index(spark, scratch(spark, "-index"))
    f = A.files(spark, d).withColumn("source", F.lit("a")).drop("layer", "generation")
    g = index.reserve("main")
    index.write("files", f.withColumn("last_hash", F.sha2("source", 256)), "baseline", g)
    index.promote("main", g)
    change = lambda df, text, seq, gone: df.select("path", "language", F.lit(text).alias("source"), F.lit(gone).alias("deleted"), F.lit(seq).cast("long").alias("seq"))
    X.update_overlay(index, change(f.where("id % 10 = 0"), "first", 1, False), "main", 5)
    X.update_overlay(index, change(f.where("id % 10 = 0"), "b", 2, False), "main", 6)
    X.update_overlay(index, change(f.where("id % 30 = 0"), None, 3, True), "main", 7)
    return X.visible(index).groupBy("path", "source").agg(F.count("*").cast("int").alias("layer_rows"))
