"""Index health: span checks, internal references left open, provenance, thresholds and the whole report."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.columns import ascii_lower, line_count, line_lengths, selected
from graphmill.operators import edges as E
from graphmill.operators.resolve import suffixes


def span_reason(lengths: Column | str = "lengths", lines: Column | None = None) -> Column:
    """Why a span is wrong, or null: the first of the rules that fails, against the snapshot's line lengths. lines, if
    given, is their number."""
    # fixed values: the reasons
    n = F.col(lengths) if isinstance(lengths, str) else lengths
    s, e, sc, ec, p, pc = (F.col(c) for c in ("start_line", "end_line", "start_character", "end_character", "selection_line", "selection_character"))
    size = F.coalesce(F.size(n) if lines is None else lines, F.lit(0))
    at = lambda line: F.get(n, line)
    rules = [
        (s.isNull() | e.isNull(), "missing line coordinate"),
        ((s < 0) | (e < 0), "negative line coordinate"),
        (sc < 0, "negative start character"),
        (ec < 0, "negative end character"),
        (e < s, "end precedes start"),
        ((e == s) & (ec < sc), "end character precedes start"),
        ((s >= size) | (e >= size), "line coordinate is outside the stored source snapshot"),
        (sc > at(s), "start character is outside the UTF-16 line length"),
        (ec > at(e), "end character is outside the UTF-16 line length"),
        ((p < s) | (p > e), "selection line is outside the symbol span"),
        (pc < 0, "negative selection character"),
        (pc.isNotNull() & p.isNull(), "selection character has no selection line"),
        (p >= size, "selection line is outside the stored source snapshot"),
        (pc > at(p), "selection character is outside the UTF-16 line length"),
        ((p == s) & (pc < sc), "selection character precedes the symbol span"),
        ((p == e) & (pc > ec), "selection character follows the symbol span"),
    ]
    out = F.lit(None).cast("string")
    for bad, text in reversed(rules):
        out = F.when(bad, text).otherwise(out)
    return out


SPAN = ("start_line", "start_character", "end_line", "end_character", "selection_line", "selection_character")


def spans(symbols: DataFrame, calls: DataFrame, types: DataFrame, relationships: DataFrame) -> DataFrame:
    """(entity, id, file_id, span columns) of all four kinds; a reference's span is its point."""

    def points(df: DataFrame, name: str, line: str, char: str) -> DataFrame:
        c = F.col(char) if char in df.columns else F.lit(None).cast("int")
        none = F.lit(None).cast("int")
        return df.where(F.col(line).isNotNull()).select(F.lit(name).alias("entity"), "id", "file_id", F.col(line).alias("start_line"), c.alias("start_character"), F.col(line).alias("end_line"), c.alias("end_character"), none.alias("selection_line"), none.alias("selection_character"))

    own = symbols.select(F.lit("symbol").alias("entity"), "id", "file_id", *SPAN)
    return own.unionByName(points(calls, "call", "call_line", "call_character")).unionByName(points(types, "type", "ref_line", "ref_character")).unionByName(points(relationships, "relationship", "line", "character"))


def invalid_spans(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with a wrong span and the reason. Only line lengths travel with the join, not the sources, and only to rows
    that name a character; the others need the number of lines. They are shuffled, never broadcast: Spark takes an array
    for a few bytes, whatever the number of lines."""
    own = files.select(F.col("id").alias("file_id"), "source")
    exact = F.coalesce("start_character", "end_character", "selection_character").isNotNull()
    lengths = own.select("file_id", line_lengths("source").alias("lengths")).hint("merge")
    lines = own.select("file_id", line_count("source").alias("lines")).hint("merge")
    with_points = rows.where(exact).join(lengths, "file_id", "left").withColumn("reason", span_reason()).where("reason is not null").drop("lengths")
    none = F.lit(None).cast("array<int>")
    return with_points.unionByName(rows.where(~exact).join(lines, "file_id", "left").withColumn("reason", span_reason(none, F.col("lines"))).where("reason is not null").drop("lines"))


def internal_unresolved(edges: DataFrame, target: str, name: str, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges without a target although their definition's path or their name (by case folded) is indexed."""
    paths = files.select(F.col("path").alias("_p")).distinct()
    names = symbols.select(ascii_lower("name").alias("_n")).distinct()
    open_ = edges.where(F.col(target).isNull())
    return (
        open_.join(paths, F.col("definition_path") == F.col("_p"), "left")
        .join(names, ascii_lower(name) == F.col("_n"), "left")
        .where(F.col("_p").isNotNull() | F.col("_n").isNotNull())
        .withColumn("by", F.when(F.col("_p").isNotNull(), "path").otherwise("name"))
        .drop("_p", "_n")
    )


def internal_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Unresolved imports that are relative or end an indexed path."""
    open_ = imports.where("resolved_id is null").withColumn("_s", F.regexp_replace(F.regexp_replace("raw_import", r'^[<"]|[>"]$', ""), r"^(\.{1,2}/)+", ""))
    ends = files.select(F.explode(suffixes(F.ltrim(F.col("path"), F.lit("/")))).alias("_s")).distinct().withColumn("_known", F.lit(True))
    return open_.join(ends, "_s", "left").where(F.col("raw_import").startswith(".") | F.col("_known")).drop("_s", "_known")


def latest_run(runs: DataFrame, **where) -> DataFrame:
    for k, v in where.items():
        runs = runs.where(F.col(k) == v)
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def degraded(indexer_runs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: failed, skipped and fallback providers, and files without any symbol."""
    bare = files.join(symbols.select(F.col("file_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("files_without_symbols"))
    flag = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    return indexer_runs.agg(flag(F.col("status") == "failed").alias("failed"), flag(F.col("status") == "skipped").alias("skipped"), flag(F.col("fallback")).alias("fallback")).crossJoin(F.broadcast(bare))  # one row each


def branch_freshness(files: DataFrame) -> DataFrame:
    return files.groupBy("branch").agg(F.min("indexed_at").alias("oldest"), F.max("indexed_at").alias("newest"), F.count("*").alias("files"), F.sum((F.col("layer") == "overlay").cast("int")).alias("overlay_files"))


def numeric_detail(details: Column | str, path: str) -> Column:
    """A number within JSON text; null if the text is no JSON or has none there."""
    return F.try_variant_get(F.try_parse_json(details), f"$.{path}", "double")


DIAGNOSTIC = r"^(.*?):(\d+):(?:(\d+):)?\s*(fatal error|error|warning|note):\s*(.*)$"


def diagnostics(log: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Of compiler log lines the counts by severity, with stated totals, and the first 20 findings."""
    part = lambda k: F.regexp_extract(column, DIAGNOSTIC, k)
    rows = log.select(column, part(4).alias("severity"), part(1).alias("file"), part(2).alias("line"), part(5).alias("message"))
    is_ = lambda *s: F.coalesce(F.sum(F.col("severity").isin(*s).cast("int")), F.lit(0))
    stated = F.coalesce(F.max(F.nullif(F.regexp_extract(column, r"(\d+) errors? generated", 1), F.lit("")).cast("int")), F.lit(0))
    failed = F.coalesce(F.sum(F.col(column).rlike(r"(?i)error while processing|failed to (index|compile)").cast("int")), F.lit(0))
    tally = rows.agg(F.greatest(is_("error", "fatal error"), stated).alias("errors"), is_("warning").alias("warnings"), is_("note").alias("notes"), failed.alias("failed_units"))
    return tally, rows.where("severity <> ''").orderBy("file", F.col("line").cast("int"), "message").limit(20)


def scope(files: DataFrame, languages: list[str] | None, include: list[str], exclude: list[str]) -> DataFrame:
    """(language, files, digest) of the files that a run is to cover: SHA-256 of the sorted paths, one a line.

    A language's paths are hashed as a whole, in one task: the manifest is a list of names, some 100 bytes each."""
    own = files.where(selected("path", include, exclude))
    if languages:
        own = own.where(F.col("language").isin(languages))
    return own.groupBy("language").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("path")), "\n"), 256).alias("digest"))


def scope_issues(
    scoped: DataFrame,
    recorded: DataFrame | None,
    coverage: DataFrame,
    providers: DataFrame,
    requested: bool = True,
    migration_grade: bool = False,
    c_family: bool = False,
    compdb: dict | None = None,
    invalid: str | None = None,
) -> list[str]:
    """Codes where a scope (path, language) is not what was recorded (path), or its files (path, language,
    status, layer, current) or languages (language, provider) have no good coverage. requested: whether the
    caller stated a scope; c_family: whether an indexer of C or C++ ran; compdb: recorded and found digests of
    its filtered compilation database; invalid: why the scope can't be verified."""
    if recorded is None:
        return ["SCIP_SCOPE_PROVENANCE_MISSING"]
    out = ["SCIP_SCOPE_REQUIRED"] if migration_grade and not requested else []
    if invalid:
        return [*out, "SCIP_SCOPE_INVALID"]
    a, b = scoped.select("path").distinct(), recorded.select("path").distinct()
    if not a.join(b, "path", "left_anti").isEmpty() or not b.join(a, "path", "left_anti").isEmpty():
        out.append("SCIP_SCOPE_MISMATCH")
    if scoped.isEmpty():
        out.append("SCIP_SCOPE_EMPTY")
    good = coverage.where("status = 'success' and layer = 'baseline' and current")
    if not scoped.join(good, ["path", "language"], "left_anti").isEmpty():
        out.append("SCIP_SCOPE_UNCOVERED_FILES")
    if not scoped.select("language").distinct().join(providers, "language", "left_anti").isEmpty():
        out.append("SCIP_SCOPE_INDEXER_MISSING")
    if compdb is not None and compdb.get("recorded") != compdb.get("found"):
        out.append("SCIP_SCOPE_COMPDB_MISMATCH")
    if c_family and compdb is None:
        out.append("SCIP_SCOPE_COMPDB_MISSING")
    return out


# fixed values: names of the limits
MINIMA = ("minFiles", "minSymbols", "minCallRefs", "minTypeRefs", "minImports", "minSymbolCoverage", "minCallResolutionRate", "minTypeResolutionRate", "minImportResolutionRate")
MAXIMA = ("maxSymbolLessFiles", "maxInvalidSpans", "maxDuplicateSymbols", "maxUnresolvedInternalRefs")


@dataclass(frozen=True)
class Policy:
    """What a healthy index needs. Limits go by the names of MINIMA and MAXIMA."""

    profile: str = "standard"
    minima: dict[str, float] = field(default_factory=dict)
    maxima: dict[str, float] = field(default_factory=dict)
    per_language: dict[str, dict[str, float]] = field(default_factory=dict)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    required_globs: tuple[str, ...] = ()
    required_symbols: tuple[tuple[str, str], ...] = ()
    required_calls: tuple[tuple[str, str], ...] = ()
    structural: bool = False
    valid_spans: bool = False
    indexer_success: bool = False
    provenance: bool = False
    fail_on_warnings: bool = False
    max_dirty_files: int | None = None
    max_baseline_age: int | None = None

    @classmethod
    def of(cls, profile: str = "standard", **more) -> Policy:
        if profile not in ("standard", "strict", "migration-grade"):
            raise ValueError(f"no profile {profile}")
        strict = profile != "standard"
        base = cls(profile, structural=strict, valid_spans=strict, indexer_success=strict, provenance=profile == "migration-grade")
        more["maxima"] = ({"maxSymbolLessFiles": 0} if strict else {}) | more.get("maxima", {})
        unknown = {*more.get("minima", {}), *more["maxima"], *(k for v in more.get("per_language", {}).values() for k in v)} - {*MINIMA, *MAXIMA}
        if unknown:
            raise ValueError(f"no limits {sorted(unknown)}")
        return replace(base, **more)


@dataclass(frozen=True)
class Freshness:
    """State of the index beside its tables: a generation still pending, dirty paths, the baseline's age."""

    pending_generation: int | None = None
    dirty_files: int = 0
    baseline_age: int | None = None
    promoted_generation: int | None = None
    branch: str | None = None
    root: str | None = None


def limit_code(name: str) -> str:
    """THRESHOLD_MIN_FILES of minFiles."""
    return "THRESHOLD_" + re.sub(r"([A-Z])", r"_\1", name).upper()


def thresholds(numbers: dict[str, float | None], limits: dict[str, float], scope: str = "index") -> list[dict]:
    """Issues of a scope's numbers, which go by the limits' names. A minimum isn't met by what is unknown."""
    out = []
    for name, want in limits.items():
        got = numbers.get(name)
        if (got is None or got < want) if name in MINIMA else (got is not None and got > want):
            out.append({"severity": "error", "code": limit_code(name), "scope": scope, "actual": got, "expected": want})
    return out


def missing_globs(files: DataFrame, symbols: DataFrame, globs: tuple[str, ...]) -> list[dict]:
    """Globs that match no file, or files without symbols: one pass for all of them."""
    if not globs:
        return []
    has = files.select("id", "path").join(symbols.select(F.col("file_id").alias("id")).distinct().withColumn("s", F.lit(1)), "id", "left")
    tally = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    row = has.agg(*[F.struct(tally(selected("path", [g])).alias("f"), tally(selected("path", [g]) & F.col("s").isNull()).alias("s")).alias(f"g{i}") for i, g in enumerate(globs)]).first()
    out = []
    for i, g in enumerate(globs):
        if not row[i]["f"]:
            out.append({"severity": "error", "code": "REQUIRED_GLOB_UNMATCHED", "scope": g})
        elif row[i]["s"]:
            out.append({"severity": "error", "code": "REQUIRED_FILE_SYMBOL_LESS", "scope": g, "actual": row[i]["s"], "expected": 0})
    return out


def missing_facts(symbols: DataFrame, calls: DataFrame, files: DataFrame, policy: Policy) -> list[dict]:
    spark = symbols.sparkSession
    out = []
    if policy.required_symbols:
        want = spark.createDataFrame(list(policy.required_symbols), "path string, name string")
        have = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
        out += [{"severity": "error", "code": "REQUIRED_SYMBOL_MISSING", **r.asDict()} for r in want.join(have, ["path", "name"], "left_anti").orderBy("path", "name").collect()]
    if policy.required_calls:
        want = spark.createDataFrame(list(policy.required_calls), "caller string, callee string")
        n = symbols.select("id", "name")
        have = calls.where(F.col("resolution_method").isin(*E.RESOLVED)).join(n.withColumnsRenamed({"id": "caller_id", "name": "caller"}), "caller_id").join(n.withColumnsRenamed({"id": "callee_id", "name": "callee"}), "callee_id")
        out += [{"severity": "error", "code": "REQUIRED_CALL_MISSING", **r.asDict()} for r in want.join(have, ["caller", "callee"], "left_anti").orderBy("caller", "callee").collect()]
    return out


def _languages(row: dict) -> set[str]:
    return set(json.loads(row.get("languages_json") or "[]"))


def indexer_issues(rows: list[dict], languages: set[str], policy: Policy) -> list[dict]:
    """Issues of the indexers' attempts (rows of indexer_runs, a few a run) for the languages at hand."""
    out = []
    hard = lambda yes: "error" if yes else "warning"
    structural = [r for r in rows if r["provider"] in ("scip", "lsp", "compdb")]
    required = policy.profile == "migration-grade" or policy.indexer_success
    skipped = degraded_supplements = 0
    for r in rows:
        details = json.loads(r.get("details_json") or "{}")
        details = details if isinstance(details, dict) else {}
        said = details.get("compilerDiagnostics") or {}
        if r["provider"] == "scip" and _languages(r) & {"c", "cpp"} & languages:
            if said.get("errors") or said.get("failedTranslationUnits") or said.get("skippedTranslationUnits"):
                out.append({"severity": hard(required), "code": "SCIP_COMPILER_ERRORS", "scope": r["run_id"], "actual": said.get("errors", 0)})
            if r["attempted"] and "scip-clang" in str(details.get("command", r["indexer"])) and not (said.get("requested") and said.get("complete")):
                out.append({"severity": hard(required), "code": "SCIP_COMPILER_DIAGNOSTICS_UNVERIFIED", "scope": r["run_id"]})
            elif not r["attempted"] and details.get("source") == "precomputed":
                out.append({"severity": "warning", "code": "SCIP_COMPILER_DIAGNOSTICS_UNVERIFIED", "scope": r["run_id"]})
            if said.get("warnings"):
                out.append({"severity": "warning", "code": "SCIP_COMPILER_WARNINGS", "scope": r["run_id"], "actual": said["warnings"]})
        skipped += int((details.get("positionConversion") or {}).get("skippedMissingSource") or 0)
        own = details.get("supplementation")
        degraded_supplements += bool(own) and (r["status"] == "degraded" or any((own.get(k) or 0) > 0 for k in ("skippedByCap", "sourceMissing", "fileRowsMissing")))
    failed = [r for r in structural if r["status"] in ("failed", "unavailable", "degraded") and (not _languages(r) or _languages(r) & languages)]
    if failed:
        out.append({"severity": hard(policy.indexer_success), "code": "INDEXER_DEGRADED", "scope": ",".join(f"{r['provider']}:{r['indexer']}" for r in failed)})
    if skipped:
        out.append({"severity": hard(policy.indexer_success), "code": "POSITION_CONVERSION_DEGRADED", "actual": skipped, "expected": 0})
    if degraded_supplements:
        out.append({"severity": hard(policy.indexer_success), "code": "SUPPLEMENTATION_DEGRADED", "actual": degraded_supplements, "expected": 0})
    return out


def provenance_issues(run: dict | None, rows: list[dict], languages: set[str], state: Freshness, policy: Policy) -> list[dict]:
    """Issues of the latest baseline run and its indexers."""
    error = lambda code, **more: {"severity": "error", "code": code, **more}
    if run is None:
        return [{"severity": "error" if policy.provenance else "warning", "code": "PROVENANCE_MISSING"}]
    out = []
    if policy.provenance and not any(r["status"] == "succeeded" and r["provider"] in ("scip", "lsp") for r in rows):
        out.append(error("STRUCTURAL_PROVENANCE_MISSING"))
    if policy.profile != "migration-grade":
        return out
    if run["status"] != "succeeded":
        out.append(error("BASELINE_RUN_NOT_SUCCESSFUL", scope=run["id"]))
    if run["completed_at"] is None:
        out.append(error("BASELINE_RUN_INCOMPLETE", scope=run["id"]))
    if run["fallback_degraded"]:
        out.append(error("BASELINE_RUN_FALLBACK_DEGRADED", scope=run["id"]))
    if state.promoted_generation is None or run["generation"] != state.promoted_generation:
        out.append(error("BASELINE_GENERATION_MISMATCH", actual=run["generation"], expected=state.promoted_generation))
    if state.branch is not None and run["branch"] != state.branch:
        out.append(error("BASELINE_BRANCH_MISMATCH", scope=run["branch"]))
    if state.root is not None and run["root_dir"].rstrip("/") != state.root.rstrip("/"):
        out.append(error("BASELINE_ROOT_MISMATCH", scope=run["root_dir"]))
    own = [r for r in rows if r["run_id"] == run["id"] and r["provider"] in ("scip", "lsp") and r["status"] == "succeeded"]
    lacking = sorted(languages - {v for r in own for v in _languages(r)})
    if lacking:
        out.append(error("STRUCTURAL_PROVIDER_MISSING", scope=",".join(lacking)))
    return out


def limits_of(g: dict) -> dict[str, float | None]:
    """A coverage group's numbers by the names of the limits."""
    share = g["with_symbols"] / g["files"] if g["files"] else None
    own = dict(zip(MINIMA, (g["files"], g["symbols"], g["calls_total"], g["types_total"], g["imports_total"], share, g["calls_rate"], g["types_rate"], g["imports_rate"])))
    return own | {"maxSymbolLessFiles": g["files"] - g["with_symbols"]}


def report(tables: dict[str, DataFrame], policy: Policy | None = None, freshness: Freshness | None = None) -> dict:
    """The whole check of an effective index: numbers, issues with severities, and whether it is healthy.
    tables: files (with source), symbols, symbol_refs, type_refs, symbol_relationships, file_imports and, if
    there, index_runs and indexer_runs. Only aggregates and the runs' few rows reach the driver."""
    policy, state = policy or Policy.of(), freshness or Freshness()
    every, symbols, calls, types, rels, imports = (tables[t] for t in ("files", "symbols", "symbol_refs", "type_refs", "symbol_relationships", "file_imports"))
    strict = policy.profile != "standard"
    files = every.where(selected("path", list(policy.include), list(policy.exclude))) if policy.include or policy.exclude else every
    cover = E.file_coverage(files, symbols, calls, types, imports)
    groups = [r.asDict() for r in E.coverage_groups(cover).orderBy("scope", "value").collect()]
    bare = {r["language"]: r["n"] for r in cover.where("symbols = 0").groupBy("language").agg(F.count("*").alias("n")).collect()}
    for g in groups:
        none = bare.get(g["value"], 0) if g["scope"] == "language" else sum(bare.values()) if g["scope"] == "all" else 0
        g["with_symbols"] = (g["files"] or 0) - none
    total = next(g for g in groups if g["scope"] == "all")
    spans_ = invalid_spans(spans(symbols, calls, types, rels), files)
    reasons = {r["reason"]: r["n"] for r in spans_.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").groupBy("reason").agg(F.count("*").alias("n")).collect()}
    numbers = {k: total[k] for k in ("files", "symbols", "calls_rate", "types_rate", "imports_rate")}
    numbers |= {
        "symbol_less_files": sum(bare.values()),
        "invalid_spans": sum(reasons.values()),
        "duplicate_paths": E.duplicate_paths(every).count(),
        "duplicate_symbols": E.duplicate_symbols(symbols).count(),
        "internal_unresolved": internal_unresolved(calls, "callee_id", "callee_name", symbols, files).count(),
        "internal_imports": internal_imports(imports, files).count(),
    }
    issues: list[dict] = []
    add = lambda code, hard, **more: issues.append({"severity": "error" if hard else "warning", "code": code, **more})
    if every.isEmpty():
        add("INDEX_EMPTY", policy.structural)
    elif not numbers["files"]:
        add("SELECTION_EMPTY", True)
    lacking = [g["value"] for g in groups if g["scope"] == "language" and not g["symbols"]]
    if policy.structural and lacking:
        add("STRUCTURAL_INDEX_MISSING", True, scope=",".join(sorted(lacking)))
    if numbers["symbol_less_files"] and "maxSymbolLessFiles" not in policy.maxima:
        add("SYMBOL_LESS_FILES", strict, actual=numbers["symbol_less_files"])
    if numbers["invalid_spans"] and (policy.valid_spans or "maxInvalidSpans" not in policy.maxima):
        add("INVALID_SPANS", policy.valid_spans, actual=numbers["invalid_spans"])
    if numbers["duplicate_paths"]:
        add("DUPLICATE_PATHS", True, actual=numbers["duplicate_paths"])
    if numbers["duplicate_symbols"] and "maxDuplicateSymbols" not in policy.maxima:
        add("DUPLICATE_SYMBOLS", False, actual=numbers["duplicate_symbols"])
    if numbers["internal_unresolved"] and "maxUnresolvedInternalRefs" not in policy.maxima:
        add("UNRESOLVED_INTERNAL_REFS", False, actual=numbers["internal_unresolved"])
    languages = {g["value"] for g in groups if g["scope"] == "language"}
    rows = [r.asDict() for r in tables["indexer_runs"].collect()] if "indexer_runs" in tables else []
    if "indexer_runs" in tables:
        numbers |= degraded(tables["indexer_runs"], files, symbols).first().asDict()
    issues += indexer_issues(rows, languages, policy)
    run = latest_run(tables["index_runs"], layer="baseline").first() if "index_runs" in tables else None
    issues += provenance_issues(run.asDict() if run else None, rows, languages, state, policy)
    if state.pending_generation is not None:
        add("BASELINE_REBUILD_PENDING", strict, actual=state.pending_generation)
    if policy.max_dirty_files is not None and state.dirty_files > policy.max_dirty_files:
        add("DIRTY_FILE_LIMIT", True, actual=state.dirty_files, expected=policy.max_dirty_files)
    if policy.max_baseline_age is not None and (state.baseline_age is None or state.baseline_age > policy.max_baseline_age):
        add("BASELINE_TOO_OLD", True, actual=state.baseline_age, expected=policy.max_baseline_age)
    more = {"maxInvalidSpans": numbers["invalid_spans"], "maxDuplicateSymbols": numbers["duplicate_symbols"], "maxUnresolvedInternalRefs": numbers["internal_unresolved"]}
    issues += thresholds(limits_of(total) | more, policy.minima | policy.maxima)
    for g in groups:
        if g["scope"] == "language" and g["value"] in policy.per_language:
            issues += thresholds(limits_of(g), policy.per_language[g["value"]], g["value"])
    for language in sorted(set(policy.per_language) - languages):
        issues += thresholds({}, policy.per_language[language], language)
    issues += missing_globs(files, symbols, policy.required_globs) + missing_facts(symbols, calls, files, policy)
    bad = {"error", "warning"} if policy.fail_on_warnings else {"error"}
    return {"healthy": not any(i["severity"] in bad for i in issues), "profile": policy.profile, "numbers": numbers, "coverage": groups, "span_reasons": reasons, "issues": issues}


def as_json(report: dict) -> str:
    return json.dumps(report, sort_keys=True, default=str)
