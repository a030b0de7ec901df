"""Registered queries over the driver's tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill import adapters as A
from graphmill.functions.columns import rename_paths
from graphmill.operators import commits as C
from graphmill.operators import edges as E
from graphmill.operators import graph as G
from graphmill.operators import health as H
from graphmill.operators import lookups as L
from graphmill.operators import resolve as R
from graphmill.operators import retrieval as S
from graphmill.operators import visibility as V
from graphmill.operators.fulltext import FullText
from graphmill.storage import scratch, stored
from graphmill.streaming import changes as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False):
    """Register a function under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if raw else A.sql(sql)
        return f

    return put


def r6(*names: str):
    return {n: F.round(F.col(n).cast("double"), 6) for n in names}


# --- commit history

for _by, _fmt in (("day", "strftime(ts, '%Y-%m-%d')"), ("week", "strftime(ts, '%Y-W%W')"), ("month", "strftime(ts, '%Y-%m')")):

    def _cadence(spark, d, by=_by):
        return C.cadence(A.commits(spark, d), by, 200)

    _cadence.__name__ = f"commit_cadence_{_by}"
    query(f"SELECT {_fmt} AS bucket, count(*) AS commits FROM commits GROUP BY 1 ORDER BY 1 LIMIT 200")(_cadence)


@query("""SELECT sha, timestamp, count(commit_sha) AS files_changed, CAST(coalesce(sum(coalesce(insertions, 0)), 0) AS BIGINT) AS insertions,
    CAST(coalesce(sum(coalesce(deletions, 0)), 0) AS BIGINT) AS deletions FROM commits LEFT JOIN commit_files ON commit_sha = sha GROUP BY 1, 2 ORDER BY timestamp DESC, sha LIMIT 200""")
def commit_sizes(spark, d):
    return C.sizes(A.commits(spark, d), A.commit_files(spark, d), 200)


@query("""SELECT file_path, count(DISTINCT sha) AS commits, CAST(sum(coalesce(insertions, 0)) AS BIGINT) AS insertions, CAST(sum(coalesce(deletions, 0)) AS BIGINT) AS deletions,
    CAST(sum(coalesce(insertions, 0)) + sum(coalesce(deletions, 0)) AS BIGINT) AS churn FROM commits JOIN commit_files ON commit_sha = sha GROUP BY 1 ORDER BY churn DESC, commits DESC, file_path LIMIT 20""")
def churn_by_file(spark, d):
    return C.churn_by_file(A.commits(spark, d), A.commit_files(spark, d))


@query("""SELECT author, author_email, count(DISTINCT sha) AS commits, CAST(sum(coalesce(insertions, 0)) AS BIGINT) AS insertions, CAST(sum(coalesce(deletions, 0)) AS BIGINT) AS deletions,
    CAST(sum(coalesce(insertions, 0)) + sum(coalesce(deletions, 0)) AS BIGINT) AS churn FROM commits LEFT JOIN commit_files ON commit_sha = sha GROUP BY 1, 2 ORDER BY commits DESC, churn DESC, author, author_email LIMIT 20""")
def author_stats(spark, d):
    return C.author_stats(A.commits(spark, d), A.commit_files(spark, d))


@query("SELECT CASE WHEN contains(message, ':') THEN lower(message[1:instr(message, ':')]) ELSE '(other)' END AS prefix, count(*) AS commits FROM commits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def message_prefixes(spark, d):
    return C.message_prefixes(A.commits(spark, d))


@query("SELECT CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS commits FROM commits GROUP BY 1, 2")
def commit_schedule(spark, d):
    return C.schedule(A.commits(spark, d))


@query("SELECT ref_name, ref_type, count(DISTINCT sha) AS commits FROM commits JOIN commit_refs ON commit_sha = sha GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def branch_activity(spark, d):
    return C.branch_activity(A.commits(spark, d), A.commit_refs(spark, d))


@query("""SELECT sha, author, timestamp, message FROM commits WHERE sha IN (SELECT commit_sha FROM commit_files WHERE file_path = 'src/{old => new}/11.py') ORDER BY timestamp DESC, sha LIMIT 200""")
def commits_by_file_rename(spark, d):
    return C.by_file(A.commits(spark, d), A.commit_files(spark, d), "src/new/11.py", 200).select("sha", "author", "timestamp", "message")


@query("SELECT sha, author, timestamp, message FROM commits WHERE contains(lower(author), '#000000001') OR contains(lower(author_email), '#000000001') ORDER BY timestamp DESC, sha LIMIT 200")
def commits_by_author(spark, d):
    return C.by_author(A.commits(spark, d), "#000000001", 200).select("sha", "author", "timestamp", "message")


@query("""SELECT sha, timestamp FROM commits WHERE sha IN (SELECT commit_sha FROM commit_refs WHERE contains(lower(ref_name), 'nation_1')) ORDER BY timestamp DESC, sha LIMIT 200""")
def commits_by_ref(spark, d):
    return C.by_ref(A.commits(spark, d), A.commit_refs(spark, d), "nation_1", 200).select("sha", "timestamp")


@query("SELECT sha, author, message FROM commits WHERE sha = '000000000042'")
def commit_by_sha(spark, d):
    return C.by_sha(A.commits(spark, d), "000000000042").select("sha", "author", "message")


@query("""SELECT sha, (SELECT count(*) FROM commit_files WHERE commit_sha = sha) AS n_files, (SELECT count(*) FROM commit_refs WHERE commit_sha = sha) AS n_refs FROM commits""")
def commit_details(spark, d):
    return C.with_details(A.commits(spark, d), A.commit_files(spark, d), A.commit_refs(spark, d)).select("sha", F.size("files").cast("long").alias("n_files"), F.size("refs").cast("long").alias("n_refs"))


@query("""SELECT commit_sha, unnest([replace(file_path, '{old => new}', 'old'), replace(file_path, '{old => new}', 'new')]) AS path FROM commit_files WHERE contains(file_path, '{')
    UNION ALL SELECT commit_sha, file_path FROM commit_files WHERE NOT contains(file_path, '{')""")
def rename_variants(spark, d):
    return A.commit_files(spark, d).select("commit_sha", F.explode(rename_paths("file_path")).alias("path"))


@query("""SELECT author, author_email, count(*) AS lines, round(count(*) / (SELECT count(*) FROM commits), 6) AS share, count(DISTINCT sha) AS commits FROM commits GROUP BY 1, 2""")
def blame_ownership(spark, d):
    return C.ownership(A.commits(spark, d)).withColumns(r6("share"))


@query("""SELECT count(*) AS commits, count(DISTINCT author) AS authors, CAST(sum(c) AS BIGINT) AS churn, 'high' AS overall FROM (SELECT sha, author, (SELECT coalesce(sum(coalesce(insertions, 0) + coalesce(deletions, 0)), 0) FROM commit_files WHERE commit_sha = sha) AS c FROM commits)""")
def risk_signals(spark, d):
    return C.risk(A.commits(spark, d), A.commit_files(spark, d), 1_700_000_000).select("commits", "authors", "churn", "overall")


# --- visibility and lookups


def _effective(spark, d):
    return V.effective_files(A.layered_files(spark, d), A.dirty_files(spark, d), A.promoted(spark))


@query("SELECT id, path, branch, layer FROM effective_files")
def effective_files(spark, d):
    return _effective(spark, d).select("id", "path", "branch", "layer")


@query("SELECT id, name FROM symbols WHERE file_id IN (SELECT id FROM effective_files)")
def effective_symbols(spark, d):
    return V.effective(A.symbols(spark, d), _effective(spark, d)).select("id", "name")


@query("SELECT id, caller_id FROM raw_calls WHERE file_id IN (SELECT id FROM effective_files)")
def effective_refs(spark, d):
    return V.effective(A.raw_calls(spark, d), _effective(spark, d)).select("id", "caller_id")


@query("SELECT 'mixed' AS source, 1800000000 - min(dirty_since) AS age_seconds, count(*) AS dirty_files FROM dirty_files")
def freshness(spark, d):
    return V.freshness(A.layered_files(spark, d), A.dirty_files(spark, d), 1_800_000_000)


@query("""SELECT i.id, CASE WHEN t.id IS NOT NULL OR i.resolved_id IS NULL THEN i.resolved_id ELSE r.id END AS resolved_id,
    CASE WHEN t.id IS NULL AND i.resolved_id IS NOT NULL AND r.id IS NULL THEN 'overlay_stale' ELSE i.resolution_method END AS resolution_method
    FROM imports i LEFT JOIN effective_files t ON t.id = i.resolved_id LEFT JOIN layered_files h ON h.id = i.resolved_id LEFT JOIN effective_files r ON r.path = h.path AND r.branch = h.branch""")
def reconcile_imports(spark, d):
    return V.reconcile_imports(A.imports(spark, d), A.layered_files(spark, d), _effective(spark, d)).select("id", "resolved_id", "resolution_method")


@query("""SELECT c.id, CASE WHEN s.id IS NOT NULL THEN c.callee_id END AS callee_id, CASE WHEN c.callee_id IS NOT NULL AND s.id IS NULL THEN 'unresolved' ELSE c.resolution_method END AS resolution_method
    FROM calls c LEFT JOIN (SELECT id FROM symbols WHERE file_id IN (SELECT id FROM effective_files)) s ON s.id = c.callee_id""")
def reconcile_targets(spark, d):
    eff = _effective(spark, d)
    return V.reconcile(A.calls(spark, d), "callee_id", V.effective(A.symbols(spark, d), eff), eff).select("id", "callee_id", "resolution_method")


_SYMBOL = "s.id, s.name, s.kind, f.path AS file_path, p.name AS parent_name FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN symbols p ON p.id = s.parent_symbol_id"
_ORDER = "ORDER BY f.path, f.branch, lower(s.name), s.kind, s.start_line, s.end_line, s.id"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "kind", "file_path", "parent_name")


@query(f"SELECT {_SYMBOL} WHERE lower(s.name) = 'dup_4'")
def symbols_exact(spark, d):
    return _shown(L.symbols_by_name(A.symbols(spark, d), A.files(spark, d), "DUP_4"))


@query(f"SELECT {_SYMBOL} WHERE starts_with(lower(s.name), 'fn_12') {_ORDER} LIMIT 1000")
def symbols_prefix(spark, d):
    return _shown(L.symbols_by_name(A.symbols(spark, d), A.files(spark, d), "Fn_12", "prefix"))


@query(f"SELECT {_SYMBOL} WHERE contains(lower(s.name), 'p_1') AND s.kind = 'class' {_ORDER} LIMIT 1000")
def symbols_contains(spark, d):
    return _shown(L.symbols_by_name(A.symbols(spark, d), A.files(spark, d), "P_1", "contains", kind="class"))


@query(f"SELECT {_SYMBOL} WHERE f.language = 'building' {_ORDER} LIMIT 50 OFFSET 20")
def list_symbols_page(spark, d):
    return _shown(L.list_symbols(A.symbols(spark, d), A.files(spark, d), 50, 20, language="building"))


@query("""SELECT w.name, CASE count(s.id) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, count(s.id) AS candidates, CASE WHEN count(s.id) = 1 THEN min(s.id) END AS id
    FROM (SELECT DISTINCT callee_name AS name FROM raw_calls) w LEFT JOIN symbols s ON lower(s.name) = lower(w.name) GROUP BY 1""")
def symbol_range_resolution(spark, d):
    names = A.raw_calls(spark, d).select(F.col("callee_name").alias("name"))
    return L.symbol_ranges(A.symbols(spark, d), A.files(spark, d), names).select("name", "outcome", "candidates", "id")


@query("SELECT id, path FROM files WHERE path = '/building/n7' OR starts_with(path, '/building/n7/')")
def files_by_prefix(spark, d):
    return L.files_by_prefix(A.files(spark, d), " /building/n7/ ").select("id", "path")


@query("""SELECT point_id, symbol_id FROM (SELECT c.id AS point_id, s.id AS symbol_id, row_number() OVER (PARTITION BY c.id ORDER BY s.end_line - s.start_line, s.start_line DESC, s.id) AS r
    FROM calls c LEFT JOIN symbols s ON s.file_id = c.file_id AND c.call_line * 30 BETWEEN s.start_line AND s.end_line) WHERE r = 1""")
def containing_symbol(spark, d):
    p = A.raw_calls(spark, d).select(F.col("id").alias("point_id"), "file_id", (F.col("call_line") * 30).alias("line"))
    return L.narrowest(p, A.symbols(spark, d)).select("point_id", "symbol_id")


# --- edges and aggregates


@query("SELECT id, caller_id, callee_id, callee_name, resolution_method FROM calls")
def name_cascade(spark, d):
    return A.calls(spark, d).select("id", "caller_id", "callee_id", "callee_name", "resolution_method")


@query("""SELECT c.id, c.caller_id, s.name AS source_name, f.path AS source_path, c.callee_id, t.name AS target_name, g.path AS target_path FROM calls c JOIN symbols s ON s.id = c.caller_id JOIN files f ON f.id = s.file_id
    LEFT JOIN symbols t ON t.id = c.callee_id LEFT JOIN files g ON g.id = t.file_id WHERE c.callee_id IS NOT NULL""")
def resolved_edges(spark, d):
    return E.calls(A.calls(spark, d), A.symbols(spark, d), A.files(spark, d), resolved_only=True, limit=None).select("id", "caller_id", "source_name", "source_path", "callee_id", "target_name", "target_path")


@query("""SELECT c.id, c.symbol_id, s.name AS source_name, c.type_id, t.name AS target_name FROM type_uses c JOIN symbols s ON s.id = c.symbol_id LEFT JOIN symbols t ON t.id = c.type_id""")
def type_ref_edges(spark, d):
    return E.type_uses(A.type_uses(spark, d), A.symbols(spark, d), A.files(spark, d), limit=None).select("id", "symbol_id", "source_name", "type_id", "target_name")


@query("""SELECT c.id, s.name AS source_name, c.target_symbol_id, t.name AS target_name FROM relationships c JOIN symbols s ON s.id = c.source_symbol_id LEFT JOIN symbols t ON t.id = c.target_symbol_id WHERE relationship_type = 'extends'""")
def relationship_edges(spark, d):
    return E.relationships(A.relationships(spark, d), A.symbols(spark, d), A.files(spark, d), relationship_type="extends").select("id", "source_name", "target_symbol_id", "target_name")


_PATHS = "FROM calls c JOIN symbols s ON s.id = c.caller_id JOIN files f ON f.id = s.file_id JOIN symbols t ON t.id = c.callee_id JOIN files g ON g.id = t.file_id"
_LEAD = "array_to_string(list_slice(string_split({}, '/'), 1, 2), '/')"


@query(f"""SELECT directory, count(DISTINCT path) AS file_count, CAST(sum(i) AS BIGINT) AS internal_edges, CAST(sum(n) AS BIGINT) AS external_inbound, CAST(sum(o) AS BIGINT) AS external_outbound,
    round(coalesce(sum(i) / nullif(sum(i) + sum(o), 0), 0), 6) AS cohesion, round(coalesce(sum(o) / nullif(sum(n) + sum(o), 0), 0), 6) AS instability
    FROM (SELECT {_LEAD.format("f.path")} AS directory, f.path AS path, CAST({_LEAD.format("f.path")} = {_LEAD.format("g.path")} AS INTEGER) AS i, 0 AS n, CAST({_LEAD.format("f.path")} <> {_LEAD.format("g.path")} AS INTEGER) AS o {_PATHS}
     UNION ALL SELECT {_LEAD.format("g.path")}, g.path, 0, CAST({_LEAD.format("f.path")} <> {_LEAD.format("g.path")} AS INTEGER), 0 {_PATHS}) GROUP BY 1""")
def cohesion(spark, d):
    return E.cohesion(A.calls(spark, d), A.symbols(spark, d), A.files(spark, d), 2, 200).withColumns(r6("cohesion", "instability"))


_DIRS = """, dirs AS (SELECT array_to_string(list_slice(string_split(f.path, '/'), 1, least(3, len(string_split(f.path, '/')) - 1)), '/') AS from_dir,
    array_to_string(list_slice(string_split(g.path, '/'), 1, least(3, len(string_split(g.path, '/')) - 1)), '/') AS to_dir, file_id, resolved_id, f.path || ' → ' || g.path AS sample
    FROM imports JOIN files f ON f.id = file_id JOIN files g ON g.id = resolved_id), dir_graph AS (SELECT from_dir, to_dir, count(*) AS count FROM dirs WHERE from_dir <> to_dir GROUP BY 1, 2)"""


@query(_DIRS + """ SELECT from_dir, to_dir, count, samples FROM dir_graph JOIN (SELECT from_dir, to_dir, string_agg(sample, '|' ORDER BY r) AS samples FROM
    (SELECT *, row_number() OVER (PARTITION BY from_dir, to_dir ORDER BY file_id, resolved_id) AS r FROM dirs WHERE from_dir <> to_dir) WHERE r <= 3 GROUP BY 1, 2) USING (from_dir, to_dir)""")
def dir_graph(spark, d):
    return E.directory_graph(A.imports(spark, d), A.files(spark, d), 3).select("from_dir", "to_dir", "count", F.array_join("sample_files", "|").alias("samples"))


@query(_DIRS.replace("least(3", "least(2") + """ SELECT a.from_dir, a.to_dir, a.count AS edge_count, coalesce(b.count, 0) AS reverse_edge_count FROM dir_graph a LEFT JOIN dir_graph b ON a.from_dir = b.to_dir AND a.to_dir = b.from_dir,
    (SELECT avg(count) AS m, stddev_pop(count) AS s FROM dir_graph) WHERE s > 0 AND a.count < greatest(1, m - s) ORDER BY 3, 1, 2 LIMIT 200""")
def dir_outliers(spark, d):
    return E.outliers(E.directory_graph(A.imports(spark, d), A.files(spark, d), 2), 200).select("from_dir", "to_dir", "edge_count", "reverse_edge_count")


_COVER = """, cover AS (SELECT f.id AS file_id, path, language, coalesce(s.n, 0) AS symbols, coalesce(c.n, 0) AS calls_total, coalesce(c.r, 0) AS calls_resolved, coalesce(t.n, 0) AS types_total, coalesce(t.r, 0) AS types_resolved, coalesce(t.e, 0) AS types_external,
    coalesce(i.n, 0) AS imports_total, coalesce(i.r, 0) AS imports_resolved, coalesce(i.e, 0) AS imports_external FROM files f
    LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) s ON s.file_id = f.id
    LEFT JOIN (SELECT file_id, count(*) AS n, count(callee_id) AS r FROM calls GROUP BY 1) c ON c.file_id = f.id
    LEFT JOIN (SELECT file_id, count(*) AS n, count(type_id) AS r, count(*) FILTER (WHERE type_id IS NULL) AS e FROM type_uses GROUP BY 1) t ON t.file_id = f.id
    LEFT JOIN (SELECT file_id, count(*) AS n, count(resolved_id) AS r, count(*) FILTER (WHERE resolved_id IS NULL) AS e FROM imports GROUP BY 1) i ON i.file_id = f.id)"""


def _coverage(spark, d):
    return E.file_coverage(A.files(spark, d), A.symbols(spark, d), A.calls(spark, d), A.type_uses(spark, d), A.imports(spark, d))


@query(_COVER + " SELECT * FROM cover")
def file_coverage(spark, d):
    return _coverage(spark, d).drop("calls_external")


@query(_COVER + """ SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(extension) = 0 THEN 'extension' ELSE 'all' END AS scope, coalesce(language, extension, '') AS value, count(*) AS files, CAST(sum(symbols) AS BIGINT) AS symbols,
    round(sum(calls_resolved) / nullif(sum(calls_total), 0), 6) AS calls_rate, round(least(sum(types_total), sum(types_resolved) + sum(types_external)) / nullif(sum(types_total), 0), 6) AS types_rate
    FROM (SELECT *, regexp_extract(path, '(\\.[^./]+)$', 1) AS extension FROM cover) GROUP BY GROUPING SETS ((), (language), (extension))""")
def coverage_grouping_sets(spark, d):
    return E.coverage_groups(_coverage(spark, d)).withColumns(r6("calls_rate", "types_rate")).select("scope", "value", "files", "symbols", "calls_rate", "types_rate")


@query("""SELECT entity, method, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY entity), 6) AS share FROM (SELECT 'call' AS entity, resolution_method AS method FROM calls UNION ALL SELECT 'type', resolution_method FROM type_uses
    UNION ALL SELECT 'relationship', resolution_method FROM relationships UNION ALL SELECT 'import', resolution_method FROM imports) GROUP BY 1, 2""")
def resolution_methods(spark, d):
    return E.resolution_methods(A.calls(spark, d), A.type_uses(spark, d), A.relationships(spark, d), A.imports(spark, d)).withColumns(r6("share"))


@query("SELECT name, kind, count(*) AS count FROM symbols GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_symbols(spark, d):
    s = A.symbols(spark, d).select("id", F.lit(0).cast("long").alias("file_id"), "name", "kind", *[F.lit(None).cast("int").alias(c) for c in ("start_line", "start_character", "end_line", "end_character", "selection_line", "selection_character", "parent_symbol_id", "signature")])
    return E.duplicate_symbols(s).select("name", "kind", "count")


@query("""SELECT resolved_id AS file_id, file_id AS dependent_id, 'import' AS dep_kind FROM imports WHERE resolved_id IS NOT NULL AND resolved_id <> file_id
    UNION SELECT s.file_id, c.file_id, 'ref' FROM calls c JOIN symbols s ON s.id = c.callee_id WHERE s.file_id <> c.file_id""")
def reverse_deps(spark, d):
    return E.reverse_deps(A.imports(spark, d), A.calls(spark, d), A.symbols(spark, d))


def _overrides(spark, d):
    return A.relationships(spark, d).where("target_symbol_id is not null and relationship_type = 'implements'").select(F.col("target_symbol_id").alias("interface_id"), F.col("source_symbol_id").alias("concrete_id"))


@query("""SELECT DISTINCT c.caller_id, r.source_symbol_id AS callee_id, c.callee_name, c.call_line FROM calls c JOIN relationships r ON r.target_symbol_id = c.callee_id AND r.relationship_type = 'implements'
    WHERE NOT EXISTS (SELECT 1 FROM calls x WHERE x.caller_id = c.caller_id AND x.callee_id = r.source_symbol_id AND x.call_line = c.call_line)""")
def virtual_dispatch(spark, d):
    return E.virtual_dispatch(A.calls(spark, d), _overrides(spark, d)).select("caller_id", "callee_id", "callee_name", "call_line")


_SIDE = "SELECT path, name, kind, ordinal, signature FROM ordinals WHERE branch = '{}'"


def _diff(spark, d):
    return E.diff(A.branch_symbols(spark, d), A.branch_files(spark, d), "O", "F")


@query(f"SELECT b.* FROM ({_SIDE.format('F')}) b ANTI JOIN ({_SIDE.format('O')}) a USING (path, name, kind, ordinal)")
def diff_added(spark, d):
    return _diff(spark, d)[0].select("path", "name", "kind", "ordinal", "signature")


@query(f"SELECT a.* FROM ({_SIDE.format('O')}) a ANTI JOIN ({_SIDE.format('F')}) b USING (path, name, kind, ordinal)")
def diff_removed(spark, d):
    return _diff(spark, d)[1].select("path", "name", "kind", "ordinal", "signature")


@query(f"SELECT path, name, kind, ordinal, a.signature AS old_signature, b.signature AS new_signature FROM ({_SIDE.format('O')}) a JOIN ({_SIDE.format('F')}) b USING (path, name, kind, ordinal) WHERE a.signature <> b.signature")
def diff_changed(spark, d):
    return _diff(spark, d)[2].select("path", "name", "kind", "ordinal", "old_signature", "new_signature")


# --- graph


def _call_edges(spark, d):
    return A.calls(spark, d).where("callee_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.col("call_line").alias("line"), F.col("resolution_method").alias("method"))


def _stored_calls(spark, d):
    """Call edges, resolved once for a query that goes over them several times."""
    return stored(_call_edges(spark, d))


def _most_called(edges):
    return edges.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("node"))


@query(""", seed AS (SELECT callee_id AS node FROM calls WHERE callee_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    up(node, depth) AS (SELECT node, 0 FROM seed UNION SELECT c.caller_id, depth + 1 FROM up JOIN calls c ON c.callee_id = up.node WHERE depth < 5)
    SELECT node, min(depth) AS depth, min(l) AS line, min(m) AS method FROM up JOIN (SELECT caller_id, min(call_line) AS l, min(resolution_method) AS m FROM calls WHERE callee_id IS NOT NULL GROUP BY 1) ON caller_id = node WHERE depth > 0 GROUP BY node""")
def callers_depth5(spark, d):
    e = _stored_calls(spark, d)
    return G.dependents(e, _most_called(e), 5)


@query(""", up(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT i.file_id, depth + 1 FROM up JOIN imports i ON i.resolved_id = up.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY node""")
def importers_depth3(spark, d):
    e = A.imports(spark, d).where("resolved_id is not null").select(F.col("file_id").alias("src"), F.col("resolved_id").alias("dst"), F.lit(0).alias("line"), F.lit("").alias("method"))
    return G.dependents(e, spark.createDataFrame([(1,)], "node long"), 3).select("node", "depth")


@query(""", ext AS (SELECT DISTINCT source_symbol_id AS src, target_symbol_id AS dst FROM relationships WHERE target_symbol_id IS NOT NULL), seed AS (SELECT dst AS node FROM ext GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    up(node, depth) AS (SELECT node, 0 FROM seed UNION SELECT src, depth + 1 FROM up JOIN ext ON dst = up.node WHERE depth < 5) SELECT node, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY node""")
def subclasses_depth5(spark, d):
    e = A.relationships(spark, d).where("target_symbol_id is not null").select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), "line", F.col("resolution_method").alias("method"))
    seed = e.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("node"))
    return G.dependents(e, seed, 5).select("node", "depth")


@query(""", seed AS (SELECT callee_id AS node FROM calls WHERE callee_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    up(node, depth) AS (SELECT node, 0 FROM seed UNION SELECT c.caller_id, depth + 1 FROM up JOIN calls c ON c.callee_id = up.node WHERE depth < 2)
    SELECT DISTINCT c.caller_id AS src, c.callee_id AS dst, d + 1 AS hop FROM calls c JOIN (SELECT node, min(depth) AS d FROM up GROUP BY 1) ON node = c.callee_id ORDER BY hop, src, dst LIMIT 1000""")
def bfs_edges(spark, d):
    e = _stored_calls(spark, d)
    return G.bfs_edges(e, _most_called(e), 3, 1000, backward=True)


def _sparse(spark, d):
    return A.relationships(spark, d).where("target_symbol_id is not null").select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"))


@query(""", e AS (SELECT source_symbol_id AS a, target_symbol_id AS b FROM relationships WHERE target_symbol_id IS NOT NULL UNION SELECT target_symbol_id, source_symbol_id FROM relationships WHERE target_symbol_id IS NOT NULL),
    walk(node, seen) AS (SELECT a, a FROM e UNION SELECT walk.node, e.b FROM walk JOIN e ON e.a = walk.seen) SELECT node, min(seen) AS component FROM walk GROUP BY node""")
def connected_components(spark, d):
    return G.components(_sparse(spark, d))


@query(""", e AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM calls WHERE callee_id IS NOT NULL), p AS (SELECT b AS n FROM e GROUP BY b ORDER BY count(*) DESC, b LIMIT 1),
    fw(n) AS (SELECT n FROM p UNION SELECT e.b FROM fw JOIN e ON e.a = fw.n), bw(n) AS (SELECT n FROM p UNION SELECT e.a FROM bw JOIN e ON e.b = bw.n), big AS (SELECT n FROM fw INTERSECT SELECT n FROM bw),
    rest AS (SELECT a, b FROM e WHERE a NOT IN (SELECT n FROM big) AND b NOT IN (SELECT n FROM big)), r(a, b) AS (SELECT a, b FROM rest UNION SELECT r.a, rest.b FROM r JOIN rest ON rest.a = r.b)
    SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1
    UNION ALL SELECT n, (SELECT min(n) FROM big) FROM big WHERE (SELECT count(*) FROM big) > 1 OR n IN (SELECT a FROM e WHERE a = b)""")
def symbol_sccs(spark, d):
    return G.strong_components(_call_edges(spark, d))


@query()
def clusters(spark, d):
    s = A.symbols(spark, d).select("id", "file_id", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    e = E.symbol_edges(A.calls(spark, d), A.type_uses(spark, d), A.relationships(spark, d), s)
    got = G.cluster_sizes(*G.cluster_members(s, e))
    return got.select(F.col("id").cast("int").alias("id"), F.col("symbols").cast("int").alias("symbols"), F.col("files").cast("int").alias("files"), "total_lines", F.col("internal_edges").cast("long").alias("internal_edges"), F.col("external_edges").cast("long").alias("external_edges"))


@query()
def trace(spark, d):
    e = _stored_calls(spark, d)
    entry = e.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()["src"]
    steps, _ = G.trace(e, entry, 3)
    return spark.createDataFrame([(s["symbol_id"], s["depth"], s["call_line"], s["resolution_method"]) for s in steps], "symbol_id long, depth int, call_line int, resolution_method string")


# --- retrieval

_INDEXES: dict[tuple, FullText] = {}


def document_index(spark, d) -> FullText:
    """The full-text index of a folder's documents, which its queries share: built by the first of them in an
    application, and again when the table has another age or size."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = (spark.sparkContext.applicationId, d, fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength())
    if mark not in _INDEXES:
        index = FullText(spark, scratch(spark, "-fulltext"), ["text"], "doc_id", buckets=32, slices=2)
        index.build(A.table(spark, d, "documents").select("doc_id", "text"))
        _INDEXES[mark] = index
    return _INDEXES[mark]


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'stupid')) AS f FROM t), g AS (SELECT count(*) AS docs, avg(n) AS a, count(*) FILTER (WHERE f > 0) AS df FROM c)
    SELECT doc_id, round(-ln((docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / a)), 6) AS score FROM c, g WHERE f > 0 ORDER BY -ln((docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / a)), doc_id LIMIT 20""", raw=True)
def bm25_top(spark, d):
    return document_index(spark, d).search("stupid").withColumns(r6("score"))


def _query_vector(spark, d):
    return A.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


@query("""WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM embeddings, q)
    SELECT vec_id, round(dist, 6) AS distance FROM s ORDER BY dist, vec_id LIMIT 20""", raw=True)
def knn_top(spark, d):
    return S.nearest(A.table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id").withColumns(r6("distance"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'stupid')) AS f FROM t), g AS (SELECT count(*) AS docs, avg(n) AS a, count(*) FILTER (WHERE f > 0) AS df FROM c),
    b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY -ln((docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / a)), doc_id) AS r FROM c, g WHERE f > 0 QUALIFY r <= 20),
    q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM embeddings, q),
    v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY dist, vec_id) AS r FROM s QUALIFY r <= 20)
    SELECT id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT 0 AS l, * FROM b UNION ALL SELECT 1, * FROM v) GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, min(l * 1000 + r), id LIMIT 20""", raw=True)
def rrf_fused(spark, d):
    text = document_index(spark, d).search("stupid").withColumnRenamed("doc_id", "id")
    near = S.nearest(A.table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id").withColumnRenamed("vec_id", "id")
    return S.fused(text, near).withColumns(r6("score"))


# --- definitions, spans and health


def _defined(spark, d):
    s = A.symbols(spark, d).select(F.col("id").alias("t"), F.col("name").alias("name"), F.col("file_id").alias("tf"), F.col("start_line").alias("l"))
    f = A.files(spark, d).select(F.col("id").alias("tf"), F.col("path").alias("definition_path"))
    none = F.lit(None)
    e = A.relationships(spark, d).select("id", "file_id", F.col("target_symbol_id").alias("t")).join(s, "t").join(f, "tf")
    return e.select("id", "file_id", none.cast("long").alias("target"), "name", F.lit("unresolved").alias("method"), F.when(F.col("id") % 11 == 0, "/outside.py").otherwise(F.col("definition_path")).alias("definition_path"), (F.col("l") + F.when(F.col("id") % 5 == 0, 40).otherwise(1)).cast("int").alias("definition_line"), none.cast("int").alias("definition_character"))


@query("""SELECT e.id, CASE WHEN e.id % 11 = 0 THEN NULL WHEN m.n = 1 THEN m.t END AS target, CASE WHEN e.id % 11 = 0 THEN 'external_definition' WHEN m.n = 1 THEN 'lsp_definition' WHEN m.n > 1 THEN 'ambiguous_definition' ELSE 'unresolved' END AS method
    FROM (SELECT r.id, s.name, s.file_id AS tf, s.start_line + CASE WHEN r.id % 5 = 0 THEN 40 ELSE 1 END AS l FROM relationships r JOIN symbols s ON s.id = r.target_symbol_id) e
    LEFT JOIN (SELECT id, count(*) AS n, min(t) AS t FROM (SELECT e.id, s.id AS t, s.end_line - s.start_line AS w, min(s.end_line - s.start_line) OVER (PARTITION BY e.id) AS m
      FROM (SELECT r.id, s.name, s.file_id AS tf, s.start_line + CASE WHEN r.id % 5 = 0 THEN 40 ELSE 1 END AS l FROM relationships r JOIN symbols s ON s.id = r.target_symbol_id) e
      JOIN symbols s ON s.file_id = e.tf AND s.name = e.name AND e.l BETWEEN s.start_line AND s.end_line) WHERE w = m GROUP BY id) m ON m.id = e.id""")
def containment_cascade(spark, d):
    dirty = A.dirty_files(spark, d).limit(0)
    return R.by_definition(_defined(spark, d), A.symbols(spark, d), A.files(spark, d), dirty).select("id", "target", "method")


@query("SELECT id, 'line coordinate is outside the stored source snapshot' AS reason FROM symbols WHERE end_line >= file_id % 450 + 1")
def invalid_spans(spark, d):
    f = A.files(spark, d).select("id", F.expr("repeat('ab\n', cast(id % 450 as int))").alias("source"))
    return H.invalid_spans(A.symbols(spark, d), f).select("id", "reason")


@query("SELECT id, 'name' AS by FROM calls WHERE callee_id IS NULL AND lower(callee_name) IN (SELECT lower(name) FROM symbols)")
def internal_unresolved(spark, d):
    return H.internal_unresolved(A.calls(spark, d).withColumn("definition_path", F.lit(None).cast("string")), "callee_id", "callee_name", A.symbols(spark, d), A.files(spark, d)).select("id", "by")


# --- streams


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", raw=True)
def stream_latest_per_key(spark, d):
    return X.latest(A.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS changes FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM
    (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS >= ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run""", raw=True)
def session_quiet_period(spark, d):
    e = A.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return X.quiet_periods(e, ["user_id"], "ts", "6 hours").select("user_id", F.unix_seconds("start").alias("start"), "changes")


@query("SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, count(*) AS events FROM events GROUP BY 1, 2", raw=True)
def tumbling_counts(spark, d):
    e = A.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return X.counts(e, ["event_type"], "ts", "1 hour").select("event_type", F.unix_seconds("start").alias("start"), "events")
