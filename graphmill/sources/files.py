"""File snapshots: scan, language by extension, hash, comparison and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.columns import base_name, selected

# fixed values: languages by file extension
LANGUAGES = {
    ".c": "c",
    ".C": "cpp",
    ".h": "c",
    ".rs": "rust",
    ".py": "python",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".c++": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".hxx": "cpp",
    ".h++": "cpp",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".go": "go",
    ".java": "java",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".scala": "scala",
    ".sc": "scala",
    ".lua": "lua",
    ".sh": "bash",
    ".bash": "bash",
    ".zsh": "bash",
    ".ex": "elixir",
    ".exs": "elixir",
    ".zig": "zig",
    ".ml": "ocaml",
    ".mli": "ocaml",
    ".hs": "haskell",
    ".jl": "julia",
    ".elm": "elm",
    ".m": "objc",
    ".mm": "objc",
}
EXCLUDED = ("node_modules", ".git", "dist", "build", "coverage", ".next", "target", "__pycache__")
# fixed values: files that mark a project's language at its root
MARKERS = {"package.json": "javascript", "tsconfig.json": "typescript", "go.mod": "go", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "pyproject.toml": "python", "setup.py": "python", "CMakeLists.txt": "cpp", "compile_commands.json": "cpp", "Gemfile": "ruby", "composer.json": "php"}


def language_of(path: Column | str) -> Column:
    """By extension without regard to case, but for `.C`, which is C++; null if unknown."""
    ext = F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1)
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.when(ext == ".C", ext).otherwise(F.lower(ext))]


def excluded(path: Column | str, more: tuple[str, ...] = ()) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(x) for x in (*EXCLUDED, *more)]))


def walk(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, language, size_bytes, last_hash, source, modified) of the known source files below root, paths
    relative to it; hidden and excluded directories are left out. Size and hash are of the file's bytes; bytes
    that are no UTF-8 stand as replacement characters in source. Only files with a known extension are read, and no
    empty ones, which the reader passes over."""
    root = root.rstrip("/")
    names = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in LANGUAGES if e != ".C") + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + _quoted("/" + root.split(":", 1)[-1].strip("/")) + "/", "")
    found = raw.select(rel.alias("path"), "length", "modificationTime", "content").where(~excluded("path") & ~F.col("path").rlike(r"(^|/)\.[^/]"))
    found = found.where(selected("path", include or [], exclude)).withColumn("language", language_of("path")).where("language is not null")
    return found.select("path", "language", F.make_valid_utf8(F.expr("cast(content as string)")).alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("last_hash"))


def _quoted(text: str) -> str:
    import re

    return re.sub(r"([\\.^$+*?()\[\]{}|])", r"\\\1", text)


def snapshot(sources: DataFrame) -> DataFrame:
    return sources.withColumns({"size_bytes": F.octet_length("source").cast("long"), "last_hash": F.sha2("source", 256)})


def project_languages(paths: DataFrame) -> DataFrame:
    """Languages of a project by markers at its root and extensions at most one directory deep."""
    shallow = paths.where((F.size(F.split("path", "/")) <= 2) & ~F.col("path").startswith(".") & ~excluded("path"))
    marks = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    by_mark = shallow.where(~F.col("path").contains("/")).select(marks[F.col("path")].alias("language"))
    return by_mark.unionByName(shallow.select(language_of("path").alias("language"))).where("language is not null").distinct()


def changes(old: DataFrame, new: DataFrame, by: str = "last_hash") -> DataFrame:
    """(path, change): created, changed or deleted between two snapshots, by hash or modification time."""
    a, b = old.select("path", F.col(by).alias("_a")), new.select("path", F.col(by).alias("_b"))
    have = lambda c: F.col(c).isNotNull()
    both = a.withColumn("_x", F.lit(True)).join(b.withColumn("_y", F.lit(True)), "path", "full_outer")
    kind = F.when(~have("_x"), "created").when(~have("_y"), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")


def merged_documents(documents: DataFrame) -> DataFrame:
    """Documents of several indexes (path, occurrences, symbols) by path: equal occurrences (range, symbol,
    roles, syntax_kind) once, the one with the longest enclosing range; of a symbol's information the one with
    most documentation; sorted."""
    o = documents.select("path", F.explode("occurrences").alias("o")).select("path", "o.*")
    key = ["path", "range", "symbol", "symbol_roles", "syntax_kind"]
    occ = o.groupBy(*key).agg(F.max_by("enclosing_range", F.struct(F.size("enclosing_range"), F.to_json("enclosing_range"))).alias("enclosing_range")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("range", "symbol", "symbol_roles", "enclosing_range", "syntax_kind"))).alias("occurrences"))
    s = documents.select("path", F.explode("symbols").alias("s")).select("path", F.col("s.symbol").alias("symbol"), "s")
    rich = F.struct(F.size("s.documentation"), F.size("s.relationships"), F.to_json("s"))
    sym = s.groupBy("path", "symbol").agg(F.max_by("s", rich).alias("s")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("symbol", "s"))).alias("x")).select("path", F.transform("x", lambda v: v["s"]).alias("symbols"))
    return documents.select("path").distinct().join(occ, "path", "left").join(sym, "path", "left")
