"""Engine tables made of the driver's tables, as DataFrames and, word for word, as SQL views (WITH ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.storage import small_tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_tasks(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(k: Column) -> Column:
    return F.when(k % 5 == 0, F.concat(F.lit("dup_"), F.floor(k / 10).cast("string"))).otherwise(F.concat(F.lit("fn_"), k.cast("string")))


def files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    seg = F.lower("c_mktsegment")
    return c.select(
        F.col("c_custkey").cast("long").alias("id"),
        F.concat(F.lit("/"), seg, F.lit("/n"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"),
        F.lit("main").alias("branch"),
        seg.alias("language"),
        F.col("c_custkey").cast("long").alias("indexed_at"),
        F.lit("baseline").alias("layer"),
        F.lit(0).cast("long").alias("generation"),
    )


def layered_files(spark: SparkSession, d: str) -> DataFrame:
    base = files(spark, d)
    over = base.where("id % 20 = 0").withColumns({"id": F.col("id") + 10_000_000, "layer": F.lit("overlay")})
    return base.unionByName(over)


def dirty_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where("id % 10 = 0").select("path", "branch", (F.col("id") + 1_700_000_000).alias("dirty_since"))


def promoted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("main", 0)], "branch string, generation long")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").cast("long")
    start = (k % 400).cast("int")
    return o.select(
        k.alias("id"),
        F.col("o_custkey").cast("long").alias("file_id"),
        named(k).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "function").when(F.col("o_orderstatus") == "O", "class").otherwise("macro").alias("kind"),
        start.alias("start_line"),
        (start + (k % 37).cast("int")).alias("end_line"),
        F.lit(None).cast("int").alias("start_character"),
        F.lit(None).cast("int").alias("end_character"),
        F.lit(None).cast("int").alias("selection_line"),
        F.lit(None).cast("int").alias("selection_character"),
        F.concat(F.lit("def "), F.col("o_orderpriority")).alias("signature"),
        F.lit(None).cast("string").alias("resolved_type_signature"),
        F.col("o_orderstatus").alias("resolved_return_type"),
        F.col("o_orderpriority").startswith("1").alias("is_exported"),
        F.when(k % 3 == 0, k - 1).alias("parent_symbol_id"),
    )


def _modulo(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    n = orders.agg(F.count("*").alias("n"))
    return lineitem.crossJoin(F.broadcast(n))  # one row


def raw_calls(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    t = ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % F.col("n")).cast("long")
    line = _modulo(table(spark, d, "lineitem"), o).select(F.col("l_orderkey").cast("long").alias("caller_id"), t.alias("t"), "l_linenumber")
    per = line.repartition("caller_id").groupBy("caller_id", "t").agg(F.min("l_linenumber").cast("int").alias("call_line"))  # where the join needs them
    own = o.select(F.col("o_orderkey").cast("long").alias("caller_id"), F.col("o_custkey").cast("long").alias("file_id"))
    return per.join(own, "caller_id").select(
        (F.col("caller_id") * 10_000_000 + F.col("t")).alias("id"),
        "caller_id",
        "file_id",
        F.lit(None).cast("long").alias("callee_id"),
        named(F.col("t")).alias("callee_name"),
        "call_line",
        F.lit(None).cast("int").alias("call_character"),
        F.lit(None).cast("string").alias("definition_path"),
        F.lit(None).cast("int").alias("definition_line"),
        F.lit(None).cast("int").alias("definition_character"),
        F.lit("unresolved").alias("resolution_method"),
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    from graphmill.operators.resolve import by_name, generic, specific

    return specific(by_name(generic(raw_calls(spark, d), "callee_id", "callee_name"), symbols(spark, d)), "callee_id", "callee_name")


def type_uses(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    t = ((F.col("l_orderkey") * 3 + F.col("l_suppkey")) % F.col("n")).cast("long")
    line = _modulo(table(spark, d, "lineitem").where("l_returnflag = 'R'"), o).select(F.col("l_orderkey").cast("long").alias("symbol_id"), t.alias("t"), F.col("l_suppkey").cast("long").alias("s"), "l_linenumber")
    per = line.groupBy("symbol_id", "s", "t").agg(F.min("l_linenumber").cast("int").alias("ref_line"))
    own = o.select(F.col("o_orderkey").cast("long").alias("symbol_id"), F.col("o_custkey").cast("long").alias("file_id"))
    return per.join(own, "symbol_id").select(
        (F.col("symbol_id") * 10_000_000 + F.col("s")).alias("id"),
        "file_id",
        "symbol_id",
        F.when(F.col("s") % 4 != 0, F.col("t")).alias("type_id"),
        named(F.col("t")).alias("type_name"),
        "ref_line",
        F.when(F.col("s") % 4 != 0, "scip_definition").otherwise("external_definition").alias("resolution_method"),
    )


def relationships(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").cast("long")
    r = _modulo(o, o).where(k % 6 == 1)
    t = (k * 13 + 5) % F.col("n")
    return r.select(
        k.alias("id"),
        F.col("o_custkey").cast("long").alias("file_id"),
        k.alias("source_symbol_id"),
        F.when(k % 7 != 0, t).alias("target_symbol_id"),
        named(t).alias("target_symbol_name"),
        F.when(k % 4 == 1, "extends").otherwise("implements").alias("relationship_type"),
        (k % 400).cast("int").alias("line"),
        F.when(k % 7 != 0, "scip_definition").otherwise("unresolved").alias("resolution_method"),
    )


def imports(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").agg(F.count("*").alias("n"))
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").cast("long").alias("s")).join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("file_id")), "o_orderkey")
    return (
        line.crossJoin(F.broadcast(n))  # one row
        .groupBy("file_id", (F.col("s") % F.col("n")).alias("r"))
        .agg(F.min("s").alias("s"))
        .select((F.col("file_id") * 10_000_000 + F.col("r")).alias("id"), "file_id", F.concat(F.lit("s"), F.col("s").cast("string")).alias("raw_import"), F.when(F.col("s") % 9 != 0, F.col("r")).alias("resolved_id"), F.when(F.col("s") % 9 != 0, "filesystem_exact").otherwise("external_dependency").alias("resolution_method"))
    )


def commits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"), F.concat(F.lower("c_mktsegment"), F.lit("@x.org")).alias("author_email"))
    sha = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    text = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.col("o_orderpriority"), F.lit(": "), F.col("o_orderstatus")))
    return o.join(c, "o_custkey").select(sha.alias("sha"), "author", "author_email", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), text.alias("message"))


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_partkey").cast("long")
    path = F.when(p % 11 == 0, F.concat(F.lit("src/{old => new}/"), p.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("src/d"), (p % 20).cast("string"), F.lit("/"), p.cast("string"), F.lit(".py")))
    per = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("i"), F.sum("l_linenumber").cast("long").alias("deletions"))
    return per.select(F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("commit_sha"), path.alias("file_path"), F.lit("M").alias("change_type"), F.when(p % 13 != 0, F.col("i")).alias("insertions"), "deletions")


def commit_refs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("ref_name"))
    return o.join(c, "c_custkey").join(n, "n_nationkey").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("commit_sha"), "ref_name", F.when(F.col("n_nationkey") % 2 == 0, "branch").otherwise("tag").alias("ref_type"))


def branch_files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p"))
    both = p.select(F.explode(F.array(F.struct((F.col("p") * 2).alias("id"), F.lit("O").alias("branch"), "p"), F.struct((F.col("p") * 2 + 1).alias("id"), F.lit("F").alias("branch"), "p"))).alias("x")).select("x.*")
    return both.select("id", F.concat(F.lit("p/"), F.col("p").cast("string")).alias("path"), "branch")


def branch_symbols(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("p"), "l_linestatus", "l_returnflag", F.col("l_suppkey").cast("long").alias("s"), F.col("l_quantity").cast("long").alias("q"))
    per = line.groupBy("p", "l_linestatus", "l_returnflag", "s").agg(F.min("q").alias("q"))
    return per.select(
        (F.col("p") * 1_000_000 + F.col("s") * 10 + F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) * 2 + (F.col("l_linestatus") == "O").cast("int")).alias("id"),
        (F.col("p") * 2 + (F.col("l_linestatus") == "F").cast("int")).alias("file_id"),
        F.concat(F.lit("f_"), F.col("l_returnflag")).alias("name"),
        F.lit("function").alias("kind"),
        F.col("s").cast("int").alias("start_line"),
        F.lit(True).alias("is_exported"),
        F.concat(F.lit("q"), (F.col("q") % 7).cast("string")).alias("signature"),
    )


def _sql_name(k: str) -> str:
    return f"CASE WHEN {k} % 5 = 0 THEN 'dup_' || ({k} // 10) ELSE 'fn_' || {k} END"


SQL = f"""
WITH RECURSIVE files AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, '/' || lower(c_mktsegment) || '/n' || c_nationkey || '/' || c_custkey || '.py' AS path, 'main' AS branch,
         lower(c_mktsegment) AS language, CAST(c_custkey AS BIGINT) AS indexed_at, 'baseline' AS layer FROM customer),
layered_files AS (SELECT * FROM files UNION ALL SELECT id + 10000000, path, branch, language, indexed_at, 'overlay' FROM files WHERE id % 20 = 0),
dirty_files AS (SELECT path, branch, id + 1700000000 AS dirty_since FROM files WHERE id % 10 = 0),
effective_files AS (
  SELECT * FROM layered_files f WHERE (layer = 'overlay' AND EXISTS (SELECT 1 FROM dirty_files d WHERE d.path = f.path AND d.branch = f.branch))
     OR (layer = 'baseline' AND NOT EXISTS (SELECT 1 FROM dirty_files d WHERE d.path = f.path AND d.branch = f.branch))),
symbols AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS file_id, {_sql_name("o_orderkey")} AS name,
         CASE o_orderstatus WHEN 'F' THEN 'function' WHEN 'O' THEN 'class' ELSE 'macro' END AS kind,
         CAST(o_orderkey % 400 AS INTEGER) AS start_line, CAST(o_orderkey % 400 + o_orderkey % 37 AS INTEGER) AS end_line,
         'def ' || o_orderpriority AS signature, o_orderstatus AS resolved_return_type, starts_with(o_orderpriority, '1') AS is_exported,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey - 1 AS BIGINT) END AS parent_symbol_id FROM orders),
n_orders AS (SELECT count(*) AS n FROM orders),
raw_calls AS (
  SELECT x.caller_id * 10000000 + x.t AS id, x.caller_id, CAST(o.o_custkey AS BIGINT) AS file_id, {_sql_name("x.t")} AS callee_name, x.call_line
  FROM (SELECT CAST(l_orderkey AS BIGINT) AS caller_id, CAST((l_orderkey * 7 + l_partkey) % n AS BIGINT) AS t, CAST(min(l_linenumber) AS INTEGER) AS call_line
        FROM lineitem, n_orders GROUP BY 1, 2) x JOIN orders o ON o.o_orderkey = x.caller_id),
by_name AS (
  SELECT name, count(*) FILTER (WHERE kind <> 'macro') AS n, min(id) FILTER (WHERE kind <> 'macro') AS first,
         count(DISTINCT file_id) FILTER (WHERE kind <> 'macro') AS nf FROM symbols GROUP BY name),
by_file AS (SELECT file_id, name, count(*) AS k, min(id) AS own FROM symbols GROUP BY 1, 2),
calls AS (
  SELECT r.id, r.caller_id, r.file_id, r.callee_name, r.call_line,
         CASE WHEN b.k = 1 THEN b.own WHEN a.n = 1 OR (a.n > 1 AND a.nf = 1) THEN a.first END AS callee_id,
         CASE WHEN b.k = 1 THEN 'name_same_file' WHEN a.n = 1 THEN 'name_unique' WHEN a.n > 1 AND a.nf = 1 THEN 'name_single_file' ELSE 'unresolved' END AS resolution_method
  FROM raw_calls r LEFT JOIN by_name a ON a.name = r.callee_name LEFT JOIN by_file b ON b.name = r.callee_name AND b.file_id = r.file_id),
type_uses AS (
  SELECT x.symbol_id * 10000000 + x.s AS id, CAST(o.o_custkey AS BIGINT) AS file_id, x.symbol_id, CASE WHEN x.s % 4 <> 0 THEN x.t END AS type_id,
         {_sql_name("x.t")} AS type_name, x.ref_line, CASE WHEN x.s % 4 <> 0 THEN 'scip_definition' ELSE 'external_definition' END AS resolution_method
  FROM (SELECT CAST(l_orderkey AS BIGINT) AS symbol_id, CAST(l_suppkey AS BIGINT) AS s, CAST((l_orderkey * 3 + l_suppkey) % n AS BIGINT) AS t, CAST(min(l_linenumber) AS INTEGER) AS ref_line
        FROM lineitem, n_orders WHERE l_returnflag = 'R' GROUP BY 1, 2, 3) x JOIN orders o ON o.o_orderkey = x.symbol_id),
relationships AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS file_id, CAST(o_orderkey AS BIGINT) AS source_symbol_id,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_orderkey * 13 + 5) % n AS BIGINT) END AS target_symbol_id,
         {_sql_name("((o_orderkey * 13 + 5) % n)")} AS target_symbol_name, CASE WHEN o_orderkey % 4 = 1 THEN 'extends' ELSE 'implements' END AS relationship_type,
         CAST(o_orderkey % 400 AS INTEGER) AS line, CASE WHEN o_orderkey % 7 <> 0 THEN 'scip_definition' ELSE 'unresolved' END AS resolution_method
  FROM orders, n_orders WHERE o_orderkey % 6 = 1),
imports AS (
  SELECT file_id * 10000000 + r AS id, file_id, 's' || s AS raw_import, CASE WHEN s % 9 <> 0 THEN r END AS resolved_id,
         CASE WHEN s % 9 <> 0 THEN 'filesystem_exact' ELSE 'external_dependency' END AS resolution_method
  FROM (SELECT CAST(o_custkey AS BIGINT) AS file_id, CAST(l_suppkey % n AS BIGINT) AS r, CAST(min(l_suppkey) AS BIGINT) AS s
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey, (SELECT count(*) AS n FROM customer) GROUP BY 1, 2)),
commits AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS sha, c_name AS author, lower(c_mktsegment) || '@x.org' AS author_email,
         CAST(epoch(o_orderdate) AS BIGINT) AS timestamp, o_orderdate AS ts, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE o_orderpriority || ': ' || o_orderstatus END AS message
  FROM orders JOIN customer ON c_custkey = o_custkey),
commit_files AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS commit_sha,
         CASE WHEN l_partkey % 11 = 0 THEN 'src/{{old => new}}/' || l_partkey || '.py' ELSE 'src/d' || (l_partkey % 20) || '/' || l_partkey || '.py' END AS file_path,
         CASE WHEN l_partkey % 13 <> 0 THEN CAST(sum(l_quantity) AS BIGINT) END AS insertions, CAST(sum(l_linenumber) AS BIGINT) AS deletions
  FROM lineitem GROUP BY l_orderkey, l_partkey),
commit_refs AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS commit_sha, n_name AS ref_name, CASE WHEN n_nationkey % 2 = 0 THEN 'branch' ELSE 'tag' END AS ref_type
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
branch_symbols AS (
  SELECT CAST(p * 1000000 + s * 10 + (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 2 + CAST(l_linestatus = 'O' AS INTEGER) AS BIGINT) AS id,
         'p/' || p AS path, l_linestatus AS branch, 'f_' || l_returnflag AS name, 'function' AS kind, CAST(s AS INTEGER) AS start_line, 'q' || (q % 7) AS signature
  FROM (SELECT CAST(l_partkey AS BIGINT) AS p, l_linestatus, l_returnflag, CAST(l_suppkey AS BIGINT) AS s, min(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2, 3, 4)),
ordinals AS (SELECT *, CAST(row_number() OVER (PARTITION BY name, kind, path, branch ORDER BY start_line, id) AS INTEGER) AS ordinal FROM branch_symbols)
"""


def sql(body: str) -> str:
    return SQL + body
