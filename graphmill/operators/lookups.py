"""Point and list queries over files, symbols and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.columns import ascii_lower, name_matches

MOST_ROWS = 10_000


def clamp(limit: int | None, default: int = 1000, most: int = MOST_ROWS) -> int:
    return default if limit is None else max(1, min(int(limit), most))


def _branch(branch: str | None) -> Column:
    return F.lit(True) if branch is None else F.col("branch") == branch


def file_by_id(files: DataFrame, id: int, branch: str | None = None) -> DataFrame:
    return files.where((F.col("id") == id) & _branch(branch))


def file_by_path(files: DataFrame, path: str, branch: str | None = None) -> DataFrame:
    """The one last indexed, then of the larger id."""
    return files.where((F.col("path") == path) & _branch(branch)).orderBy(F.desc("indexed_at"), F.desc("id")).limit(1)


def list_files(files: DataFrame, limit: int | None = None, branch: str | None = None) -> DataFrame:
    return files.where(_branch(branch)).orderBy("path", "branch", "id").limit(clamp(limit))


def files_by_prefix(files: DataFrame, prefix: str, branch: str | None = None, limit: int | None = None) -> DataFrame:
    """The path itself and what lies below it, all of it without a limit; one slash at its end means nothing."""
    p = prefix.strip().removesuffix("/")
    found = files.where(_branch(branch) & ((F.col("path") == p) | F.col("path").startswith(p + "/")))
    return found if limit is None else found.orderBy("path", "branch", "id").limit(clamp(limit))


def with_context(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their file's path, branch and language and their parent's name."""
    f = files.select(F.col("id").alias("_f"), F.col("path").alias("file_path"), "branch", "language")
    parent = symbols.select(F.col("id").alias("_p"), F.col("name").alias("parent_name"))
    return symbols.join(f, F.col("file_id") == F.col("_f")).join(parent, F.col("parent_symbol_id") == F.col("_p"), "left").drop("_f", "_p")


def symbol_filter(branch: str | None = None, kind: str | None = None, path_prefix: str | None = None, language: str | None = None) -> Column:
    out = F.lit(True)
    for column, value in (("branch", branch), ("kind", kind), ("language", language)):
        if value is not None:
            out = out & (F.col(column) == value)
    if path_prefix is not None:
        out = out & F.col("file_path").startswith(path_prefix)
    return out


def symbol_by_id(symbols: DataFrame, files: DataFrame, id: int) -> DataFrame:
    return with_context(symbols, files).where(F.col("id") == id)


def symbols_by_name(symbols: DataFrame, files: DataFrame, name: str, mode: str = "exact", limit: int | None = None, **filters) -> DataFrame:
    found = with_context(symbols, files).where(name_matches("name", name, mode) & symbol_filter(**filters))
    return in_order(found).limit(clamp(limit))


def in_order(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("file_path", "branch", ascii_lower("name"), "kind", "start_line", "end_line", "id")


def list_symbols(symbols: DataFrame, files: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    return in_order(with_context(symbols, files).where(symbol_filter(**filters))).offset(max(0, offset)).limit(clamp(limit))


def symbol_ranges(symbols: DataFrame, files: DataFrame, names: DataFrame, **filters) -> DataFrame:
    """For each name (column `name`) whether it means one symbol: outcome resolved, missing or ambiguous, the
    number of candidates, and the range of the one that is resolved."""
    f = files.select(F.col("id").alias("_f"), F.col("path").alias("file_path"), "branch", "language")
    found = symbols.join(f, F.col("file_id") == F.col("_f")).where(symbol_filter(**filters)).withColumn("_n", ascii_lower("name"))
    # of one row the minima are its own values; apart they are aggregated by hash, and those that nobody reads aren't kept
    per = found.groupBy("_n").agg(F.count("*").alias("n"), *(F.min(c).alias(f"_{c}") for c in ("id", "file_path", "start_line", "end_line")))
    out = names.select("name").distinct().join(per, ascii_lower("name") == F.col("_n"), "left")
    n = F.coalesce("n", F.lit(0))
    one = lambda c: F.when(n == 1, F.col(f"_{c}")).alias(c)
    return out.select("name", F.when(n == 1, "resolved").when(n == 0, "missing").otherwise("ambiguous").alias("outcome"), n.cast("long").alias("candidates"), one("id"), one("file_path"), one("start_line"), one("end_line"))


def external_by_name(external: DataFrame, name: str, mode: str = "exact", limit: int = 100) -> DataFrame:
    return external.where(name_matches("symbol_name", name, mode)).orderBy("package_name", "symbol_name", "symbol_kind", "signature", "id").limit(limit)


def list_annotations(annotations: DataFrame, files: DataFrame, symbols: DataFrame, kind: str | None = None, path: str | None = None, limit: int = 20) -> DataFrame:
    f = files.select(F.col("id").alias("_f"), F.col("path").alias("file_path"), "branch")
    s = symbols.select(F.col("id").alias("_s"), F.col("name").alias("symbol_name"))
    out = annotations.join(f, F.col("file_id") == F.col("_f")).join(s, F.col("symbol_id") == F.col("_s"), "left")
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if path is not None:
        out = out.where(F.col("file_path") == path)
    return out.drop("_f", "_s").orderBy("file_path", "line", "id").limit(clamp(limit))


def metrics(metrics: DataFrame, symbols: DataFrame, files: DataFrame, least: int = 0, limit: int = 20, branch: str | None = None) -> DataFrame:
    own = with_context(symbols, files).select(F.col("id").alias("symbol_id"), "name", "kind", "file_path", "branch", "start_line", "end_line")
    out = metrics.drop("layer", "generation").join(own, "symbol_id").where((F.col("cyclomatic") >= least) & _branch(branch))
    return out.orderBy(F.desc("cyclomatic"), "symbol_id").limit(max(1, min(limit, 200)))


def page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """Keyset page: rows above a key in its order."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def narrowest(points: DataFrame, symbols: DataFrame, inclusive_end: bool = True) -> DataFrame:
    """For each point (point_id, file_id, line) the narrowest symbol whose lines hold it: by width, then the
    later start, then the smaller id. Points within none keep a null symbol_id.

    Spans are cut into buckets of BUCKET lines, so a file with a great many symbols and points is dealt out
    by bucket rather than compared whole."""
    s = symbols.select("file_id", F.col("id").alias("symbol_id"), "start_line", "end_line").where("end_line >= start_line")
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))))
    p = points.withColumn("bucket", F.floor(F.col("line") / BUCKET))
    best = F.struct((F.col("end_line") - F.col("start_line")).alias("width"), (-F.col("start_line")).alias("start"), F.col("symbol_id"))
    upper = F.col("line") <= F.col("end_line") if inclusive_end else F.col("line") < F.col("end_line")
    found = p.join(s, ["file_id", "bucket"]).where((F.col("line") >= F.col("start_line")) & upper).groupBy("point_id").agg(F.min(best).alias("b")).select("point_id", F.col("b.symbol_id").alias("symbol_id"))
    return points.join(found, "point_id", "left")


BUCKET = 64


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that decides."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
