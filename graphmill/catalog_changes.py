"""Registered queries of language-server change sets, supplements by language and nearest vectors of many queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill import adapters as A
from graphmill.catalog import query, r6
from graphmill.catalog_facts import KEYS, numbers
from graphmill.functions import supplements as P
from graphmill.operators import supplement as U
from graphmill.operators.knn import nearest_of_each

# --- language servers: each order key is a symbol of the index; eight make a file, and every other file has an index

def _start():
    return (F.col("k") % 8 * 20).cast("int")


def _file():
    return F.floor(F.col("k") / 8).cast("long").alias("file_id")


def _kind():
    return F.when(F.col("k") % 3 == 0, "function").when(F.col("k") % 3 == 1, "class").otherwise("variable")


def _indexed(spark, d):
    k, none = F.col("k"), F.lit(None).cast("int")
    point = lambda c: F.when(k % 2 == 1, c)
    return numbers(spark, d).select(
        k.alias("id"), _file(), F.concat(F.lit("n"), k.cast("string")).alias("name"), _kind().alias("kind"), _start().alias("start_line"), none.alias("start_character"),
        (_start() + F.when(k % 5 == 0, 0).otherwise(9)).alias("end_line"), none.alias("end_character"), point(_start()).alias("selection_line"), point(F.lit(4)).alias("selection_character"),
        F.lit(None).cast("string").alias("signature"), F.lit(None).cast("long").alias("parent_symbol_id"),
    )


def _served(spark, d):
    """A quarter of the keys are seen as they are; a quarter with a member that is told twice; a quarter under
    another name, with a member that has a member; the rest not at all."""
    k = F.col("k")
    own, other = F.concat(F.lit("n"), k.cast("string")), F.concat(F.lit("u"), k.cast("string"))

    def row(place, parent, depth, name, kind, first, last, column):
        start = _start() + first
        return F.struct(
            F.lit(place).alias("place"), F.lit(parent).cast("int").alias("parent"), F.lit(depth).alias("depth"), name.alias("name"), kind.alias("kind"), start.alias("start_line"), F.lit(0).alias("start_character"),
            (_start() + last).alias("end_line"), F.lit(1).alias("end_character"), start.alias("selection_line"), F.lit(column).alias("selection_character"),
        )

    method, function = F.lit("method"), F.lit("function")
    seen = row(0, None, 0, own, _kind(), 0, 12, 4)
    rows = F.when(k % 4 == 0, F.array(seen)).when(k % 4 == 1, F.array(seen, row(1, 0, 1, F.lit("c"), method, 1, 2, 2), row(2, 0, 1, F.lit("c"), method, 1, 2, 2)))
    rows = rows.when(k % 4 == 2, F.array(row(0, None, 0, other, function, 0, 12, 4), row(1, 0, 1, F.lit("d"), method, 1, 5, 2), row(2, 1, 2, F.lit("e"), function, 2, 3, 2)))
    at = F.col("k") % 8 * 10
    flat = numbers(spark, d).select("k", F.explode(rows).alias("r"))
    return flat.select(_file(), (at + F.col("r.place")).alias("position"), (at + F.col("r.parent")).alias("parent_position"), "r.*", F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("doc_comment")).drop("place", "parent")


def _changes(spark, d):
    sourced = numbers(spark, d).select(_file()).where("file_id % 2 = 0")
    return U.change_set(_indexed(spark, d), _served(spark, d), sourced)


_SEEN = """ , s AS (SELECT k, k // 8 AS file_id, k % 8 * 10 AS p, CAST(k % 8 * 20 AS INTEGER) AS l, CASE k % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'variable' END AS kind,
    CASE WHEN k // 8 % 2 = 1 THEN 'keep' WHEN k % 5 = 0 AND k % 3 <> 2 THEN 'update' ELSE 'fill' END AS action FROM o)"""


@query(KEYS + _SEEN + """ SELECT file_id, p AS position, action, k AS symbol_id, CAST(NULL AS BIGINT) AS parent_id FROM s WHERE k % 4 < 2
    UNION ALL SELECT file_id, p + j, CASE j WHEN 1 THEN 'insert' ELSE 'drop' END, -1, k FROM s, (VALUES (1), (2)) t(j) WHERE k % 4 = 1
    UNION ALL SELECT file_id, p + j, 'insert', -1, CASE WHEN j > 0 THEN -1 END FROM s, (VALUES (0), (1), (2)) t(j) WHERE k % 4 = 2""", raw=True)
def lsp_changes(spark, d):
    old = lambda c: F.when(F.col(c) >= 1 << 62, F.lit(-1).cast("long")).otherwise(F.col(c))
    return _changes(spark, d).select("file_id", "position", "action", old("id").alias("symbol_id"), old("parent_symbol_id").alias("parent_id"))


@query(KEYS + _SEEN + """, t AS (SELECT *, CASE WHEN k % 4 < 2 THEN action ELSE 'keep' END AS a FROM s)
    SELECT file_id, 'n' || k AS name, l AS start_line, CASE WHEN a <> 'keep' THEN 0 END AS start_character, CAST(CASE WHEN a = 'update' THEN l + 12 WHEN k % 5 = 0 THEN l ELSE l + 9 END AS INTEGER) AS end_line,
      CASE WHEN a <> 'keep' THEN 1 END AS end_character, CASE WHEN a <> 'keep' OR k % 2 = 1 THEN l END AS selection_line, CASE WHEN a <> 'keep' OR k % 2 = 1 THEN 4 END AS selection_character FROM t
    UNION ALL SELECT file_id, 'c', CAST(l + 1 AS INTEGER), 0, CAST(l + 2 AS INTEGER), 1, CAST(l + 1 AS INTEGER), 2 FROM s WHERE k % 4 = 1
    UNION ALL SELECT file_id, CASE j WHEN 0 THEN 'u' || k WHEN 1 THEN 'd' ELSE 'e' END, CAST(l + j AS INTEGER), 0, CAST(l + e AS INTEGER), 1, CAST(l + j AS INTEGER), CASE j WHEN 0 THEN 4 ELSE 2 END FROM s, (VALUES (0, 12), (1, 5), (2, 3)) t(j, e) WHERE k % 4 = 2""", raw=True)
def lsp_applied(spark, d):
    return U.applied(_indexed(spark, d), _changes(spark, d)).select("file_id", "name", *U.PLACE)


@query(KEYS + _SEEN + """ SELECT k AS caller_id, file_id, CASE WHEN k % 2 = 1 THEN k END AS callee_id, CASE WHEN k % 2 = 1 THEN 'n' || k WHEN k % 7 = 0 THEN 'far' ELSE 'gone' END AS callee_name, CAST(l + j AS INTEGER) AS call_line,
    CASE WHEN k % 2 = 1 THEN 'lsp_definition' WHEN k % 7 = 0 THEN 'external_definition' ELSE 'unresolved' END AS resolution_method
    FROM s, (VALUES (1), (2)) t(j) WHERE k % 4 < 2 AND k % 3 = 0 AND file_id % 2 = 1""", raw=True)
def lsp_calls(spark, d):
    """Recursion, calls of what no file defines and calls that leave the tree; classes and files with an index call nothing."""
    k = F.col("k")
    changes, have = _changes(spark, d), _indexed(spark, d)
    files = numbers(spark, d).select(_file().alias("id")).distinct().select("id", F.concat(F.lit("/r/"), F.col("id").cast("string"), F.lit(".c")).alias("path"), F.lit("main").alias("branch"))
    own, far = k % 2 == 1, k % 7 == 0
    path = F.when(own, F.concat(F.lit("/r/"), _file().cast("string"), F.lit(".c"))).when(far, "/usr/x.h").otherwise("/r/none.c")
    at = lambda n: F.struct((_start() + n).alias("line"), F.lit(3).alias("character"))
    calls = numbers(spark, d).where("k % 4 < 2").select(
        _file(), (k % 8 * 10).alias("position"), F.when(own, F.concat(F.lit("n"), k.cast("string"))).when(far, "far").otherwise("gone").alias("name"), F.lit("function").alias("kind"),
        path.alias("path"), F.concat(F.lit("file://"), path).alias("uri"), _start().alias("line"), F.lit(4).alias("character"), F.array(at(1), at(2), at(1)).alias("ranges"),
    )
    return U.outgoing_calls(changes, calls, U.applied(have, changes), files, "/r").select("caller_id", "file_id", "callee_id", "callee_name", "call_line", "resolution_method")


# --- supplements by language: every document is a source that begins with its macros


@query("""WITH d AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'cpp' ELSE 'go' END AS language, doc_id FROM documents)
    SELECT id, language, 'D' || doc_id AS name, 0 AS start_line, CAST(doc_id % 2 AS INTEGER) AS end_line, 0 AS conditions, CAST(doc_id AS VARCHAR) AS value FROM d WHERE doc_id % 3 <> 2
    UNION ALL SELECT id, language, 'E', CAST(doc_id % 2 + 2 AS INTEGER), CAST(doc_id % 2 + 2 AS INTEGER), 1, '1' FROM d WHERE doc_id % 3 <> 2""", raw=True)
def supplements_by_language(spark, d):
    k = F.col("doc_id")
    key = k.cast("string")
    first = F.when(k % 2 == 1, F.concat(F.lit("#define D"), key, F.lit(" \\\n"), key)).otherwise(F.concat(F.lit("#define D"), key, F.lit(" "), key))
    quiet = F.translate(F.coalesce("text", F.lit("")), "#\\/*\"'", "      ")  # of the text itself no macro comes
    docs = A.table(spark, d, "documents").select(k.alias("id"), F.when(k % 3 == 0, "c").when(k % 3 == 1, "cpp").otherwise("go").alias("language"), F.concat(first, F.lit("\n#ifdef X\n#define E 1\n#endif\n"), quiet).alias("source"))
    P.register(spark)
    got = spark.sql("SELECT * FROM language_supplements(TABLE({docs}))", docs=docs)
    return got.select("id", "language", "name", "start_line", "end_line", F.size("conditions").alias("conditions"), F.trim("value").alias("value"))


# --- nearest vectors of many queries


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    m AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM m)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 5""", raw=True)
def knn_of_each(spark, d):
    e = A.table(spark, d, "embeddings")
    best, _ = nearest_of_each(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("key").alias("vec_id"), "distance").withColumns(r6("distance"))
