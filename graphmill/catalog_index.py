"""Registered queries of the stored full-text index, of index facts in builds, definition tiers and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill import adapters as A
from graphmill.catalog import document_index, query, r6
from graphmill.operators.fulltext import FullText
from graphmill.operators import resolve as R
from graphmill.storage import scratch
from graphmill.streaming import changes as X

_WORDS = "list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _bm25(corpus: str, hits: str, order: str = "") -> str:
    """SQL of BM25 over documents (doc_id, w) by an expression that counts the query in w."""
    score = "-ln((docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / a))"
    return f"""WITH t AS ({corpus}), c AS (SELECT doc_id, len(w) AS n, {hits} AS f FROM t), g AS (SELECT count(*) AS docs, avg(n) AS a, count(*) FILTER (WHERE f > 0) AS df FROM c)
        SELECT doc_id, round({score}, 6) AS score FROM c, g WHERE f > 0 {order.format(score)}"""


_ALL = f"SELECT doc_id, {_WORDS.format('text')} AS w FROM documents"


@query(f"SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS terms FROM ({_ALL})", raw=True)
def fulltext_build(spark, d):
    index = document_index(spark, d)
    parts = index.state()["parts"]
    terms = index.table("postings", parts).groupBy("key").agg(F.count("*").alias("terms"), F.sum(F.size("positions")).alias("words"))
    out = index.table("documents", parts).join(terms, "key", "left").select(F.col("key").alias("doc_id"), F.col("len").cast("long").alias("words"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("words", F.lit(0)).alias("held"))
    return out.where("words = held").drop("held")


@query(_bm25(_ALL, "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))"), raw=True)
def fulltext_phrase(spark, d):
    return document_index(spark, d).search("Of the", None).withColumns(r6("score"))


# every third document gets a new text, every fifth goes, and all come back under other ids: nothing else is indexed then
_CHANGED = f"""SELECT doc_id, {_WORDS.format("CASE WHEN doc_id % 3 = 0 THEN 'License ' || coalesce(text, '') ELSE text END")} AS w FROM documents WHERE doc_id % 5 <> 1
    UNION ALL SELECT doc_id + 1000000000, {_WORDS.format('text')} FROM documents"""


def _changed(spark, d, merges: tuple[int | None, ...] = ()) -> FullText:
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    index = FullText(spark, scratch(spark, "-fulltext"), ["text"], "doc_id", buckets=8, slices=1)
    index.build(docs)
    index.refresh(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("stale")))
    index.refresh(docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("License "), F.coalesce("text", F.lit("")))), docs.where("doc_id % 5 = 1 and doc_id % 3 <> 0").select("doc_id"))
    index.refresh(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000_000), docs.where("doc_id % 5 = 1").select("doc_id"))
    for last in merges:
        index.merge(last)
    return index


@query(_bm25(_CHANGED, "len(list_filter(w, lambda x: x = 'license'))"), raw=True)
def fulltext_refreshed(spark, d):
    return _changed(spark, d).search("license", None).withColumns(r6("score"))


@query(_bm25(_CHANGED, "len(list_filter(w, lambda x: x = 'license'))", "ORDER BY {}, doc_id LIMIT 50"), raw=True)
def fulltext_merged(spark, d):
    return _changed(spark, d, (2, None)).search("license", 50).withColumns(r6("score"))


# --- relationships and imports of a compiler index in a build


def _facts(spark, d):
    """For each file k a class Ck, which extends the class of file k - 1 and implements an interface from outside, uses
    it as a type, and imports its package and one that no file defines."""
    k, none = F.col("k"), F.array().cast("array<int>")
    files = A.files(spark, d)
    n = files.select(F.col("id").alias("k"))
    name = lambda c: F.concat(F.lit("s m v p"), c.cast("string"), F.lit(" C"), c.cast("string"), F.lit("#"))
    at = lambda *c: F.array(*[F.lit(x).cast("int") if isinstance(x, int) else x.cast("int") for x in c])
    occurrence = lambda rng, symbol, roles, around: n.select(k.alias("file_id"), rng.alias("range"), symbol.alias("symbol"), F.lit(roles).alias("symbol_roles"), around.alias("enclosing_range"), F.lit(0).alias("syntax_kind"))
    occurrences = occurrence(at(k % 50, 6, 9), name(k), 1, at(k % 50, 0, k % 50 + 9, 1)).unionByName(occurrence(at(k % 50, 12, 15), name(k - 1), 2, none)).unionByName(occurrence(at(0, 0, 5), F.lit("s m v away X#"), 2, none))
    flags = lambda symbol, i, t, f: F.struct(symbol.alias("symbol"), F.lit(False).alias("is_reference"), F.lit(i).alias("is_implementation"), F.lit(t).alias("is_type_definition"), F.lit(f).alias("is_definition"))
    relations = F.array(flags(name(k - 1), True, False, False), flags(F.lit("s m v q Away#"), True, False, False), flags(name(k - 1), False, True, False), flags(name(k - 1), False, False, False))
    infos = n.select(k.alias("file_id"), name(k).alias("symbol"), F.array(F.lit("class C")).alias("documentation"), F.lit("").alias("display_name"), F.lit(7).alias("kind"), relations.alias("relationships"))
    return occurrences, infos, files


def _built(spark, d):
    from graphmill.plans import build as B

    occurrences, infos, files = _facts(spark, d)
    return B.ingest_occurrences(occurrences, infos, files), files


@query("""SELECT f.id AS file_id, t.id AS target_file, r.type AS relationship_type, CASE WHEN r.type = 'implements' THEN 'Away' ELSE 'C' || (f.id - 1) END AS target_symbol_name, CAST(f.id % 50 AS INTEGER) AS line,
    CASE WHEN t.id IS NULL THEN 'unresolved' ELSE 'scip_definition' END AS resolution_method, t.path AS definition_path FROM files f CROSS JOIN (SELECT unnest(['extends', 'implements', 'type_definition']) AS type) r
    LEFT JOIN files t ON t.id = f.id - 1 AND r.type <> 'implements' WHERE r.type <> 'extends' OR t.id IS NOT NULL UNION ALL SELECT id, NULL, 'implements', 'C' || (id - 1), CAST(id % 50 AS INTEGER), 'unresolved', NULL FROM files WHERE id - 1 NOT IN (SELECT id FROM files)""")
def build_relationships(spark, d):
    got, _ = _built(spark, d)
    owner = got["symbols"].select(F.col("id").alias("target_symbol_id"), F.col("file_id").alias("target_file"))
    source = got["symbols"].select(F.col("id").alias("source_symbol_id"), F.col("file_id").alias("_own"))
    rows = got["symbol_relationships"].join(owner, "target_symbol_id", "left").join(source, "source_symbol_id").where("_own = file_id")
    return rows.select("file_id", "target_file", "relationship_type", "target_symbol_name", "line", "resolution_method", "definition_path")


@query("""SELECT f.id AS file_id, 'p' || (f.id - 1) AS raw_import, t.id AS resolved_id, CASE WHEN t.id IS NULL THEN 'unresolved' ELSE 'scip_definition' END AS resolution_method FROM files f LEFT JOIN files t ON t.id = f.id - 1
    UNION ALL SELECT id, 'away', NULL, 'unresolved' FROM files""")
def build_imports(spark, d):
    got, _ = _built(spark, d)
    return got["file_imports"].select("file_id", "raw_import", "resolved_id", "resolution_method")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'c' WHEN id % 5 = 1 THEN 'csharp' WHEN id % 5 = 2 THEN 'cpp' WHEN id % 5 = 3 THEN 'python' END AS language FROM files")
def document_languages(spark, d):
    from graphmill.operators.ingest import document_language

    m = F.col("id") % 5
    stated = F.when(m == 0, "C").when(m == 1, "VisualBasic").when(m == 2, "c").when(m == 3, F.when(F.col("id") % 2 == 0, "")).otherwise("klingon")
    path = F.concat("path", F.when(m == 0, ".h").when(m == 1, ".py").when(m == 2, ".cc").when(m == 3, ".py").otherwise(".zzz"))
    return A.files(spark, d).select("id", document_language(stated, path).alias("language"))


# --- definition tiers, and streams as streams


@query("""SELECT id, CASE id % 6 WHEN 0 THEN id * 10 + 2 WHEN 1 THEN id * 10 + 3 WHEN 2 THEN id * 10 + 3 WHEN 3 THEN id * 10 + 1 END AS target, CASE WHEN id % 6 < 4 THEN 'lsp_definition' WHEN id % 6 = 4 THEN 'ambiguous_definition' ELSE 'unresolved' END AS method FROM files""")
def definition_tiers(spark, d):
    # in each file four symbols: the edge's place is a selection, a start, within a span, on its lines, in two equal spans, in none
    files = A.files(spark, d)
    k, none = F.col("id"), F.lit(None).cast("int")
    one = lambda n, name, l0, c0, l1, c1, p0=None, p1=None: F.struct((k * 10 + n).alias("id"), F.lit(name).alias("name"), *(F.lit(v).cast("int").alias(c) for c, v in zip(("start_line", "start_character", "end_line", "end_character", "selection_line", "selection_character"), (l0, c0, l1, c1, p0, p1))))
    made = F.array(one(1, "f", 0, 0, 50, 0), one(2, "f", 10, 0, 20, 1, 10, 4), one(3, "f", 12, 0, 14, 9), one(4, "g", 5, 0, 8, 0), one(5, "g", 5, 0, 8, 0))
    symbols = files.select(k.alias("file_id"), F.explode(made).alias("s")).select("s.id", "file_id", "s.name", F.lit("function").alias("kind"), *(f"s.{c}" for c in ("start_line", "start_character", "end_line", "end_character", "selection_line", "selection_character")))
    m = k % 6
    line = F.when(m == 0, 10).when(m == 1, 12).when(m == 2, 13).when(m == 3, 30).when(m == 4, 5).otherwise(99)
    char = F.when(m == 0, 4).when(m == 1, 0).when(m == 2, 2).when(m == 3, none).otherwise(0)
    edges = files.select("id", k.alias("file_id"), F.lit(None).cast("long").alias("target"), F.when(m == 4, "g").otherwise("f").alias("name"), F.lit("unresolved").alias("method"), F.col("path").alias("definition_path"), line.cast("int").alias("definition_line"), char.cast("int").alias("definition_character"))
    return R.by_definition(edges, symbols, files, A.dirty_files(spark, d).limit(0)).select("id", "target", "method")


def _streamed(spark, d, name: str, change):
    """The last result of a stream over a table's files, run until it has taken all of them."""
    out, at = scratch(spark, "-stream"), scratch(spark, "-progress")
    rows = spark.readStream.schema(A.table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")
    query = change(rows).writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


@query("SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, count(*) AS events FROM events GROUP BY 1, 2", raw=True)
def streamed_counts(spark, d):
    got = _streamed(spark, d, "events", lambda e: X.counts(e.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "ts", "1 hour"))
    return got.select("event_type", F.unix_seconds("start").alias("start"), "events")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", raw=True)
def streamed_latest(spark, d):
    return _streamed(spark, d, "events", lambda e: X.latest(e.select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id")).select("user_id", "event_id", "event_type")
