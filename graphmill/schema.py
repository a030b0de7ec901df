"""Engine tables: explicit types, keys, version and validation. Lines and characters are zero-based UTF-16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = 3
_KINDS = {"l": T.LongType(), "i": T.IntegerType(), "s": T.StringType(), "b": T.BooleanType(), "v": T.ArrayType(T.FloatType())}
_LAYER = "layer:s generation:l"
_DEFINITION = "resolved_type_signature:s? resolved_return_type:s? definition_uri:s? definition_path:s? definition_line:i? definition_character:i? resolution_method:s"

#: name -> columns as name:kind, `?` for nullable.
TABLES = {
    "files": f"id:l path:s branch:s language:s size_bytes:l last_hash:s? source:s indexed_at:l {_LAYER}",
    "symbols": f"id:l file_id:l name:s kind:s start_line:i start_character:i? end_line:i end_character:i? selection_line:i? selection_character:i? signature:s? doc_comment:s? resolved_type_signature:s? resolved_return_type:s? definition_uri:s? definition_path:s? is_exported:b parent_symbol_id:l? {_LAYER}",
    "annotations": f"id:l file_id:l kind:s line:i text:s symbol_id:l? author:s? created_at:l? {_LAYER}",
    "file_imports": f"id:l file_id:l raw_import:s resolved_id:l? resolution_method:s {_LAYER}",
    "symbol_refs": f"id:l caller_id:l file_id:l? callee_id:l? callee_name:s call_line:i call_character:i? call_kind:s {_DEFINITION} {_LAYER}",
    "symbol_relationships": f"id:l file_id:l source_symbol_id:l? target_symbol_id:l? target_symbol_name:s relationship_type:s line:i? character:i? {_DEFINITION} {_LAYER}",
    "type_refs": f"id:l file_id:l symbol_id:l? type_id:l? type_name:s type_name_bare:s ref_kind:s ref_line:i ref_character:i? {_DEFINITION} {_LAYER}",
    "external_deps": f"id:l file_id:l package:s version:s? {_LAYER}",
    "external_symbols": "id:l dependency_ecosystem:s source_type:s source_ref:s package_name:s package_version:s? symbol_name:s symbol_kind:s signature:s doc_comment:s? resolved_type_signature:s? resolved_return_type:s? definition_uri:s? definition_path:s?",
    "modules": "id:l name:s kind:s manifest:s?",
    "file_modules": "file_id:l module_id:l",
    "symbol_summaries": "symbol_id:l summary:s model:s created_at:l",
    "symbol_metrics": f"symbol_id:l line_count:i param_count:i cyclomatic:i max_nesting:i {_LAYER}",
    "engine_meta": "key:s value:s",
    "baseline_generations": "branch:s generation:l",
    "index_runs": "id:s mode:s root_dir:s branch:s layer:s generation:l started_at:l completed_at:l? status:s fallback_degraded:b error:s? config_json:s?",
    "indexer_runs": "id:s run_id:s provider:s indexer:s languages_json:s status:s attempted:b fallback:b files:l? symbols:l? call_refs:l? type_refs:l? imports:l? started_at:l? completed_at:l? message:s? details_json:s?",
    "commits": "sha:s author:s author_email:s timestamp:l message:s parents:s",
    "commit_files": "commit_sha:s file_path:s change_type:s insertions:l? deletions:l?",
    "commit_refs": "commit_sha:s ref_name:s ref_type:s",
    "dirty_files": "path:s branch:s dirty_since:l overlay_gen:l",
    "reverse_deps": "file_id:l dependent_id:l dep_kind:s",
    "symbols_fts": "id:l name:s signature:s kind:s",
    "symbol_embeddings": "id:l embedding:v content_hash:s?",
    "commit_embeddings": "sha:s embedding:v",
}

KEYS = {"files": ["path", "branch", "layer", "generation"], "commits": ["sha"], "commit_files": ["commit_sha", "file_path"], "commit_refs": ["commit_sha", "ref_name"], "dirty_files": ["path", "branch"], "baseline_generations": ["branch"], "engine_meta": ["key"], "symbol_summaries": ["symbol_id"], "external_deps": ["file_id", "package"], "reverse_deps": ["file_id", "dependent_id", "dep_kind"]}


def struct(table: str) -> T.StructType:
    fields = []
    for spec in TABLES[table].split():
        name, kind = spec.split(":")
        fields.append(T.StructField(name, _KINDS[kind[0]], kind.endswith("?")))
    return T.StructType(fields)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], struct(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types; absent nullable columns become null."""
    from pyspark.sql import functions as F

    out = []
    for f in struct(table):
        if f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.nullable:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            default = {"layer": "baseline", "generation": 0, "branch": "", "source": "", "size_bytes": 0, "resolution_method": "unresolved", "is_exported": False, "call_kind": "direct", "ref_kind": "other", "call_line": 0}.get(f.name)
            if default is None:
                raise ValueError(f"{table} needs {f.name}")
            out.append(F.lit(default).cast(f.dataType).alias(f.name))
    return df.select(*out)


def inspect(found: dict[str, T.StructType], version: int | None) -> str:
    """missing, outdated, newer or current: of a stored index's tables and version."""
    if version is None or not found:
        return "missing"
    if version > VERSION:
        return "newer"
    if version < VERSION:
        return "outdated"
    for table in TABLES:
        have = {f.name: f.dataType for f in found.get(table, T.StructType())}
        if any(have.get(f.name) != f.dataType for f in struct(table)):
            return "outdated"
    return "current"
