"""What readers see of layered tables: an overlay of changed files over a promoted baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_files(files: DataFrame, dirty: DataFrame, promoted: DataFrame, candidate: tuple[str, int] | None = None) -> DataFrame:
    """Overlay rows of dirty paths, and baseline rows of the promoted generation whose path is not dirty. A
    dirty path without an overlay row is deleted. With a candidate (branch, generation), that hidden
    generation alone is shown. The pointer table has a row for each branch and is joined by Spark's choice."""
    if candidate:
        return files.where((F.col("layer") == "baseline") & (F.col("branch") == candidate[0]) & (F.col("generation") == candidate[1]))
    paths = dirty.select("path", "branch").distinct()
    named = ["path", "branch"]
    if "overlay_gen" in dirty.columns:  # of several overlay batches the one that the path names
        paths_over = dirty.select("path", "branch", F.col("overlay_gen").alias("generation")).distinct()
        named = [*named, "generation"]
    else:
        paths_over = paths
    base = files.where("layer = 'baseline'").join(paths, ["path", "branch"], "left_anti").join(promoted.select("branch", "generation"), ["branch", "generation"], "left_semi")
    over = files.where("layer = 'overlay'").join(paths_over, named, "left_semi")
    return base.select(*files.columns).unionByName(over.select(*files.columns))


def effective(table: DataFrame, files: DataFrame, column: str = "file_id") -> DataFrame:
    """Rows whose file is effective; rows without a file are not."""
    return table.join(files.select(F.col("id").alias(column)), column, "left_semi").select(*table.columns)


def effective_metrics(metrics: DataFrame, symbols: DataFrame) -> DataFrame:
    return effective(metrics, symbols, "symbol_id")


def freshness(files: DataFrame, dirty: DataFrame, now: int) -> DataFrame:
    """One row: source, age_seconds of the oldest dirty path, dirty_files."""
    return dirty.agg(F.count("*").alias("dirty_files"), (F.lit(now) - F.min("dirty_since")).alias("age")).select(F.when(F.col("dirty_files") > 0, "mixed").otherwise("baseline").alias("source"), F.coalesce("age", F.lit(0)).cast("long").alias("age_seconds"), "dirty_files")


def reconcile(edges: DataFrame, target: str, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose target symbol is no longer effective become unresolved; stale edges whose definition's path
    is effective again in the edge's branch are taken up anew."""
    live = symbols.select(F.col("id").alias("_t"))
    back = files.select(F.col("path").alias("_p"), F.col("branch").alias("_b")).distinct().withColumn("_back", F.lit(True))
    own = files.select(F.col("id").alias("_f"), F.col("branch").alias("_own"))
    # only stale edges look for their path: all edges without one would meet in one task
    stale = F.coalesce(F.col(target).isNull() & (F.col("resolution_method") == "overlay_stale") & F.col("definition_path").isNotNull(), F.lit(False))
    kept = edges.where(~stale).join(live, F.col(target) == F.col("_t"), "left").withColumn("_back", F.lit(None).cast("boolean"))
    asked = edges.where(stale).join(own, F.col("file_id") == F.col("_f"), "left").join(back, (F.col("definition_path") == F.col("_p")) & (F.col("_own") == F.col("_b")), "left").withColumn("_t", F.lit(None).cast("long"))
    joined = kept.select(*edges.columns, "_t", "_back").unionByName(asked.select(*edges.columns, "_t", "_back"))
    lost = F.col(target).isNotNull() & F.col("_t").isNull()
    again = F.col("_back").isNotNull()
    return joined.withColumn("resolution_method", F.when(lost | again, "unresolved").otherwise(F.col("resolution_method"))).withColumn(target, F.when(~lost, F.col(target))).select(*edges.columns)


def reconcile_imports(imports: DataFrame, all_files: DataFrame, files: DataFrame) -> DataFrame:
    """Imports of hidden files move to the effective file of the same path and branch, or become stale."""
    hidden = all_files.select(F.col("id").alias("_h"), F.col("path").alias("_hp"), F.col("branch").alias("_hb"))
    live = files.select(F.col("id").alias("_t"))
    there = files.groupBy(F.col("path").alias("_rp"), F.col("branch").alias("_rb")).agg(F.max("id").alias("_r"))
    joined = imports.join(live, F.col("resolved_id") == F.col("_t"), "left").join(hidden, F.col("resolved_id") == F.col("_h"), "left").join(there, (F.col("_hp") == F.col("_rp")) & (F.col("_hb") == F.col("_rb")), "left")
    lost = F.col("resolved_id").isNotNull() & F.col("_t").isNull()
    return joined.withColumn("resolution_method", F.when(lost & F.col("_r").isNull(), "overlay_stale").otherwise(F.col("resolution_method"))).withColumn("resolved_id", F.when(lost, F.col("_r")).otherwise(F.col("resolved_id"))).select(*imports.columns)
