"""What a language server adds to the index: one change set of symbols, applied in one pass, and outgoing calls."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.operators.ingest import exact_callee, in_groups, matched
from graphmill.storage import stored

# fixed values: kinds whose declarations take more than a line, and kinds that call
LONG_KINDS = ("class", "constructor", "enum", "function", "interface", "method", "struct")
CALLABLE = ("function", "method", "constructor")

PLACE = ("start_line", "start_character", "end_line", "end_character", "selection_line", "selection_character")


def needs_repair(kind: Column, start: Column, end: Column) -> Column:
    """Whether a span is missing, negative, reversed, or a single line for a kind that takes more."""
    return F.coalesce(start.isNull() | end.isNull() | (start < 0) | (end < start) | ((end == start) & kind.isin(*LONG_KINDS)), F.lit(False))


def _twins(rows: list[dict]) -> list[dict]:
    """Of the rows of one file, name, kind and owner, by side, id and position: what each candidate repeats, by (id, position); the first
    of known symbols by id, then of earlier candidates that repeat nothing. Points of selection decide where both
    have one; else spans that meet."""
    exact: dict[tuple, tuple] = {}
    vague: list[tuple] = []  # without a point
    every: list[tuple] = []
    out = []
    for r in rows:
        point = None if r["selection_line"] is None or r["selection_character"] is None else (r["selection_line"], r["selection_character"])
        ends = None
        if r["start_line"] is not None and r["end_line"] is not None:
            ends = ((r["start_line"], -1 if r["start_character"] is None else r["start_character"]), (r["end_line"], float("inf") if r["end_character"] is None else r["end_character"]))
        found = None
        if r["side"] == 1:
            near = next((x[0] for x in (every if point is None else vague) if ends and x[1] and ends[0] <= x[1][1] and x[1][0] <= ends[1]), None)
            met = ([exact[point]] if point in exact else []) + ([near] if near else [])
            found = min(met, default=None)
            out.append({"file_id": r["file_id"], "position": r["position"], "twin": found[1] if found else 0, "twin_position": found[2] if found else 0, "new": found is None})
        if found is None:
            me = (len(every), r["id"], r["position"])
            every.append((me, ends))
            if point is None:
                vague.append((me, ends))
            else:
                exact.setdefault(point, me)
    return out


def change_set(indexed: DataFrame, served: DataFrame, sourced: DataFrame) -> DataFrame:
    """One row for each served symbol: file_id, position, id, parent_symbol_id, action, and the columns to write.

    indexed are symbols of the index with parent_symbol_id; served have file_id, position (unique in a file, a
    parent before its children), parent_position, depth (0 at the top), name, kind, signature, doc_comment and
    PLACE; sourced are the files (file_id) that a compiler index covers. Actions:
    - `update`: matched with a symbol of a sourced file whose span needs repair: the server's span, and its
      selection where there is none;
    - `fill`: matched with another symbol of a sourced file: columns that are null there;
    - `keep`: matched in a file without a compiler index: nothing;
    - `drop`: repeats a symbol of the same name, kind and owner, or an earlier insert: nothing is written;
    - `insert`: a new symbol, whose id is a hash of its file, place and name, the same in every run.
    A level of nesting is decided at a time, as an owner's symbol must be known first; levels are as many as
    declarations nest. Null and unknown parents count as none."""
    names = indexed.select(F.col("id").alias("parent_symbol_id"), F.col("name").alias("parent_name"))
    # null keys would meet in one task, so rows without a parent, and below those without a symbol, take no part in a join by it
    top = indexed.where("parent_symbol_id is null").withColumn("parent_name", F.lit(None).cast("string"))
    have = indexed.where("parent_symbol_id is not null").join(names, "parent_symbol_id", "left").unionByName(top)
    above = served.select("file_id", F.col("position").alias("parent_position"), F.col("name").alias("parent_name"))
    own = served.join(above, ["file_id", "parent_position"], "left").withColumn("id", F.col("position"))
    pairs = matched(have, own).select("file_id", F.col("served_id").alias("position"), F.col("indexed_id").alias("id"))
    spans = indexed.select("id", needs_repair(F.col("kind"), F.col("start_line"), F.col("end_line")).alias("_repair"))
    pairs = pairs.join(spans, "id", "left")
    flags = sourced.select("file_id").distinct().withColumn("_sourced", F.lit(True))
    fresh = F.xxhash64("file_id", F.lit("served"), "position", "name", "kind", "start_line", "start_character").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    todo = stored(served.join(pairs, ["file_id", "position"], "left").join(flags, "file_id", "left").withColumn("_fresh", fresh))
    deepest = todo.agg(F.max("depth")).first()[0]
    known = done = None
    for depth in range((-1 if deepest is None else deepest) + 1):
        level = todo.where(F.col("depth") == depth)
        if known is None:
            level = level.withColumn("parent_symbol_id", F.lit(None).cast("long"))
        else:
            level = level.join(known.select("file_id", F.col("position").alias("parent_position"), F.col("id").alias("parent_symbol_id")), ["file_id", "parent_position"], "left")
        owner = F.coalesce(F.col("parent_symbol_id").cast("string"), F.lit("")).alias("owner")
        columns = ["file_id", "name", "kind", owner, *PLACE]
        open_ = level.where("id is null")
        keys = open_.select("file_id", "name", "kind", owner).distinct()
        old = indexed.select(*columns, F.col("id"), F.lit(-1).cast("long").alias("position"), F.lit(0).alias("side"))
        if done is not None:  # inserts of earlier levels are there to be repeated too
            old = old.unionByName(done.where("action = 'insert'").select(*columns, "id", F.lit(-1).cast("long").alias("position"), F.lit(0).alias("side")))
        both = old.join(keys, ["file_id", "name", "kind", "owner"], "left_semi").unionByName(open_.select(*columns, F.lit(0).cast("long").alias("id"), F.col("position").cast("long").alias("position"), F.lit(1).alias("side")))
        twins = in_groups(both, ["file_id", "name", "kind", "owner"], ["side", "id", "position"], _twins, {"file_id": pa.int64(), "position": pa.int64(), "twin": pa.int64(), "twin_position": pa.int64(), "new": pa.bool_()})
        first = level.select("file_id", F.col("position").alias("twin_position"), F.col("_fresh").alias("_first"))
        met = twins.join(first, ["file_id", "twin_position"], "left").select("file_id", "position", "new", F.when(F.col("twin_position") >= 0, F.col("_first")).otherwise(F.col("twin")).alias("twin"))
        got = level.join(met, ["file_id", "position"], "left")
        repair = F.col("_sourced") & F.col("_repair")
        got = got.withColumn("action", F.when(F.col("id").isNotNull(), F.when(F.coalesce(repair, F.lit(False)), "update").when(F.col("_sourced"), "fill").otherwise("keep")).when(F.col("new"), "insert").otherwise("drop"))
        got = stored(got.withColumn("id", F.coalesce("id", F.when(F.col("new"), F.col("_fresh")).otherwise(F.col("twin")))).drop("_repair", "twin", "new", "_fresh"))
        known = got.select("file_id", "position", "id")
        done = got if done is None else done.unionByName(got)
    if done is None:
        done = todo.withColumns({"parent_symbol_id": F.lit(None).cast("long"), "action": F.lit(None).cast("string")}).drop("_fresh", "_repair")
    return done.withColumn("sourced", F.coalesce("_sourced", F.lit(False))).drop("_sourced")


def applied(indexed: DataFrame, changes: DataFrame) -> DataFrame:
    """The symbols after a change set, in one join: updated and filled rows, all others as they are, inserts."""
    w = changes.where("action in ('update', 'fill')").select("id", F.col("action").alias("_a"), *[F.col(c).alias(f"_{c}") for c in PLACE])

    def value(c: str) -> Column:
        kept = F.coalesce(c, f"_{c}")
        if c.startswith("selection"):
            return kept
        repaired = F.when(F.col("_a") == "update", F.col(f"_{c}"))
        return repaired.otherwise(F.col(c) if c.endswith("line") else kept)

    old = indexed.join(w, "id", "left").withColumns({c: value(c) for c in PLACE}).select(*indexed.columns)
    new = changes.where("action = 'insert'")
    return old.unionByName(new.select(*[F.col(c).cast(indexed.schema[c].dataType).alias(c) if c in new.columns else F.lit(None).cast(indexed.schema[c].dataType).alias(c) for c in indexed.columns]))


def outgoing_calls(changes: DataFrame, calls: DataFrame, symbols: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Call references of callables that a server found in files without a compiler index.

    calls have file_id, position (of the caller among the served), name, kind, path, uri, line and character of
    the callee and ranges (array of line, character): a row for each range. The callee is the one symbol at
    exactly that place; without it the call is `unresolved` below root, and else external."""
    callers = changes.where(~F.col("sourced") & F.col("kind").isin(*CALLABLE)).select("file_id", "position", F.col("id").alias("caller_id"))
    branches = files.select(F.col("id").alias("file_id"), "branch")
    made = calls.join(callers, ["file_id", "position"]).join(branches, "file_id").withColumn("point_id", F.xxhash64("branch", "path", "name", "kind", "line", "character"))
    points = made.select("point_id", "path", "branch", "name", "kind", "line", "character").distinct()
    met = made.join(exact_callee(points, symbols, files), "point_id", "left")
    inside = (F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/")
    method = F.when(F.col("symbol_id").isNotNull(), "lsp_definition").when(inside, "unresolved").otherwise("external_definition")
    rows = met.select(
        "caller_id", "file_id", F.col("symbol_id").alias("callee_id"), F.col("name").alias("callee_name"), F.explode("ranges").alias("at"), F.lit("direct").alias("call_kind"), method.alias("resolution_method"),
        F.col("uri").alias("definition_uri"), F.col("path").alias("definition_path"), F.col("line").alias("definition_line"), F.col("character").alias("definition_character"),
    )
    return rows.select(*rows.columns[:4], F.col("at.line").alias("call_line"), F.col("at.character").alias("call_character"), *rows.columns[5:]).distinct()
