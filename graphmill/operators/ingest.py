"""From compiler facts to engine tables: definitions, references, supplements and enrichment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from graphmill.operators.lookups import narrowest
from graphmill.sources.files import language_of

#: Occurrences: (file_id, range array<int>, symbol, symbol_roles, enclosing_range array<int>, syntax_kind).
DEFINITION_ROLE = 1
# fixed values: syntax kinds of identifiers in occurrences
CALL_SYNTAX = (15, 16, 17, 18)
TYPE_SYNTAX = (19, 20)
# fixed values: names of symbol kinds by number, where the index states one
KINDS = {
    7: "class",
    8: "constant",
    9: "constructor",
    11: "enum",
    12: "enum_member",
    15: "property",
    17: "function",
    18: "method",
    21: "interface",
    25: "macro",
    26: "method",
    27: "parameter",
    29: "module",
    30: "module",
    35: "module",
    36: "module",
    37: "parameter",
    38: "parameter",
    41: "property",
    42: "interface",
    44: "parameter",
    45: "method",
    49: "class",
    52: "parameter",
    53: "interface",
    54: "type_alias",
    55: "type_alias",
    56: "type_alias",
    57: "type_alias",
    58: "parameter",
    60: "variable",
    61: "variable",
    64: "module",
    66: "method",
    67: "method",
    68: "method",
    69: "method",
    70: "method",
    71: "method",
    72: "method",
    74: "method",
    75: "class",
    76: "method",
    77: "variable",
    79: "property",
    80: "method",
    81: "property",
    82: "variable",
}


def span(range_: Column, prefix: str) -> list[Column]:
    """Start and end of a range of three (one line) or four numbers, zero-based."""
    four = F.size(range_) >= 4
    at = lambda k: F.get(range_, F.lit(k))
    return [at(0).alias(f"{prefix}start_line"), at(1).alias(f"{prefix}start_character"), F.when(four, at(2)).otherwise(at(0)).alias(f"{prefix}end_line"), F.when(four, at(3)).otherwise(at(2)).alias(f"{prefix}end_character")]


def descriptors(symbol: str) -> list[tuple[str, str]]:
    """Descriptors of a symbol string as (name, suffix); names in backticks may hold anything."""
    parts = symbol.split(" ")
    k, rest = 0, symbol
    while k < 4 and k < len(parts) - 1:
        k += 1
    rest = " ".join(parts[k:]) if not symbol.startswith("local ") else ""
    out, i = [], 0
    while i < len(rest):
        if rest[i] in "([":  # parameters
            close = ")" if rest[i] == "(" else "]"
            end = rest.find(close, i)
            end = len(rest) if end < 0 else end
            out.append((rest[i + 1 : end], rest[i]))
            i = end + 1
            continue
        if rest[i] == "`":
            end = rest.find("`", i + 1)
            while end >= 0 and rest[end + 1 : end + 2] == "`":
                end = rest.find("`", end + 2)
            end = len(rest) if end < 0 else end
            name, i = rest[i + 1 : end].replace("``", "`"), end + 1
        else:
            m = re.compile(r"[\w+\-$]*").match(rest, i)
            name, i = m[0], m.end()
        if i >= len(rest):
            break
        if rest[i] == "(" and (m := re.compile(r"\([^)]*\)\.").match(rest, i)):
            out.append((name, "()."))
            i = m.end()
        else:
            out.append((name, rest[i]))
            i += 1
    return out


# fixed values: kinds by the suffix of a symbol string
SUFFIX_KIND = {"/": "module", "#": "class", ".": "variable", "().": "method", ":": "property", "!": "macro", "(": "parameter", "[": "variable"}


def symbol_parts(symbol: str | None) -> dict:
    """name, parent's symbol, kind by suffix, depth, and the method descriptor of a symbol string."""
    d = descriptors(symbol or "")
    if not d:
        return {"name": symbol or "", "parent": None, "kind": "variable", "depth": 0, "method": None}
    name, suffix = d[-1]
    kind = SUFFIX_KIND.get(suffix, "variable")
    if kind == "method" and not any(s == "#" for _, s in d[:-1]):
        kind = "function"
    tail = {"()": "().", "(": f"({name})", "[": f"[{name}]"}.get(suffix)
    shown = symbol
    if suffix in ("(", "["):
        parent = shown[: -len(tail)]
    else:
        quoted = f"`{name.replace('`', '``')}`"
        cut = re.compile(r"(?:%s|%s)(?:\([^)]*\))?[/#.:!]$" % (re.escape(quoted), re.escape(name)))
        parent = cut.sub("", shown)
    has = len(d) > 1
    return {"name": name, "parent": parent if has else None, "kind": kind, "depth": len(d), "method": name if suffix == "()." else None}


def _parts(symbol: str) -> Column:
    @F.pandas_udf("name string, parent string, kind string, depth int, method string")
    def parts(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([symbol_parts(x) for x in s], columns=["name", "parent", "kind", "depth", "method"])

    return parts(symbol)


def reference_kind(symbol: Column, syntax: Column) -> Column:
    """call, type or skip of a reference by its syntax kind, else by its symbol's suffix."""
    return F.when(syntax.isin(*CALL_SYNTAX), "call").when(syntax.isin(*TYPE_SYNTAX), "type").when(symbol.rlike(r"\)\.$"), "call").when(symbol.endswith("#"), "type").otherwise("skip")


def hinted_kind(stated: Column, by_suffix: Column, doc: Column, symbol: Column) -> Column:
    """The kind of a definition: the index's number, else the suffix of its symbol string; the documentation
    tells interfaces from classes and, without a number, some others."""
    said = lambda word: doc.contains(word)
    interface = said("interface ") | said("trait ")
    types = F.when(interface, "interface").when(said("enum "), "enum").when(said("type "), "type_alias").otherwise("class")
    terms = F.when(said("(enum member)"), "enum_member").when(said("const "), "constant").when(said("(property)"), "property").when(symbol.rlike(r"\([0-9a-f]{8,}\)\.$"), "function").otherwise("variable")
    calls = F.when(said("constructor"), "constructor").otherwise(by_suffix)
    own = F.when(by_suffix.isin("method", "function"), calls).when(by_suffix == "class", types).when((by_suffix == "variable") & symbol.endswith("."), terms).otherwise(by_suffix)
    return F.when((stated == "class") & interface, "interface").otherwise(F.coalesce(stated, own))


def definitions(occurrences: DataFrame, infos: DataFrame) -> DataFrame:
    """Symbols of definition occurrences with spans (the enclosing range, if there), names and kinds. infos are
    (symbol, documentation, display_name, kind). Parts of each distinct symbol string are read once."""
    defs = occurrences.where(F.col("symbol_roles").bitwiseAND(F.lit(DEFINITION_ROLE)) > 0).where(~F.col("symbol").startswith("local "))
    parts = defs.select("symbol").distinct().withColumn("p", _parts("symbol"))
    best = infos.groupBy("symbol").agg(F.max_by(F.struct("documentation", "display_name", "kind"), F.size("documentation")).alias("info"))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    body = F.when(F.size("enclosing_range") >= 3, F.col("enclosing_range")).otherwise(F.col("range"))
    out = defs.join(parts, "symbol").join(best, "symbol", "left")
    doc = F.get(F.col("info.documentation"), F.lit(0))
    return out.select(
        "file_id",
        F.col("symbol").alias("scip_symbol"),
        F.coalesce(F.nullif(F.col("info.display_name"), F.lit("")), F.col("p.name")).alias("name"),
        hinted_kind(kinds[F.col("info.kind")], F.col("p.kind"), F.coalesce(F.array_join("info.documentation", "\n"), F.lit("")), F.col("symbol")).alias("kind"),
        *span(body, ""),
        F.get("range", F.lit(0)).alias("selection_line"),
        F.get("range", F.lit(1)).alias("selection_character"),
        F.regexp_extract(doc, r"(?s)```\w*\n(.*?)\n?```", 1).alias("signature"),
        F.array_join("info.documentation", "\n").alias("doc_comment"),
        F.col("p.parent").alias("parent_symbol"),
        F.col("p.depth").alias("depth"),
        (F.size("enclosing_range") < 3).alias("is_forward"),
    )


def canonical(defs: DataFrame, files: DataFrame) -> DataFrame:
    """Of each symbol string its main definition: with a body first, then by path and place."""
    w = Window.partitionBy("scip_symbol").orderBy("is_forward", "path", "start_line", "start_character")
    return defs.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "path")


def references(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (point_id, file_id, line, character, symbol, kind, caller): calls and type uses, each with
    the narrowest symbol around it. symbols are (id, file_id, start_line, end_line)."""
    refs = occurrences.where(F.col("symbol_roles").bitwiseAND(F.lit(DEFINITION_ROLE)) == 0).where(~F.col("symbol").startswith("local "))
    rows = refs.withColumn("kind", reference_kind(F.col("symbol"), F.col("syntax_kind"))).where("kind <> 'skip'")
    rows = rows.select(F.xxhash64("file_id", "range", "symbol").alias("point_id"), "file_id", F.get("range", F.lit(0)).alias("line"), F.get("range", F.lit(1)).alias("character"), "symbol", "kind").distinct()
    return narrowest(rows, symbols).withColumnRenamed("symbol_id", "caller_id")


#: The role of an occurrence that imports its symbol.
IMPORT_ROLE = 2


def stated_kinds(infos: DataFrame) -> DataFrame:
    """(symbol, kind) of the symbols that an index describes, those of other packages included."""
    best = infos.groupBy("symbol").agg(F.max_by(F.struct("documentation", "kind"), F.size("documentation")).alias("info"))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    doc = F.lower(F.coalesce(F.get("info.documentation", F.lit(0)), F.lit("")))
    return best.withColumn("p", _parts("symbol")).select("symbol", hinted_kind(kinds[F.col("info.kind")], F.col("p.kind"), doc, F.col("symbol")).alias("kind"))


def related(infos: DataFrame, symbols: DataFrame, main: DataFrame, files: DataFrame) -> DataFrame:
    """Relationships that the index states, with their targets: an implementation is `extends` where the index
    describes the target as a class, else `implements`; type definitions and definitions have types of their own,
    references none.

    infos are (file_id, symbol, documentation, kind, relationships); symbols (id, file_id, scip_symbol, start and
    selection); main the canonical ones of each symbol string. The source is the symbol of the same file, else the
    canonical one."""
    flat = infos.select("file_id", F.col("symbol").alias("own"), F.explode("relationships").alias("r")).select("file_id", "own", F.col("r.symbol").alias("symbol"), "r.is_implementation", "r.is_type_definition", "r.is_definition").where("symbol <> '' and own <> ''")
    kinds = stated_kinds(infos).withColumnRenamed("kind", "target_kind")
    kind = F.when(F.col("is_implementation"), F.when(F.col("target_kind") == "class", "extends").otherwise("implements")).when(F.col("is_type_definition"), "type_definition").when(F.col("is_definition"), "defines")
    rows = flat.join(kinds, "symbol", "left").select("file_id", "own", "symbol", kind.alias("relationship_type")).where("relationship_type is not null").distinct()
    here = symbols.groupBy("file_id", F.col("scip_symbol").alias("own")).agg(F.min(F.struct("start_line", "start_character", "id", "selection_line", "selection_character")).alias("here"))
    at = main.select(F.col("scip_symbol").alias("own"), F.struct("id", "selection_line", "selection_character").alias("there"))
    target = main.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("scip_symbol").alias("symbol"), F.col("id").alias("target_symbol_id"), F.col("name").alias("_name"), F.col("path").alias("definition_path"), F.col("selection_line").alias("definition_line"), F.col("selection_character").alias("definition_character"))
    named = rows.select("symbol").distinct().withColumn("_shown", _parts("symbol").getField("name"))
    out = rows.join(here, ["file_id", "own"], "left").join(at, "own", "left").join(target, "symbol", "left").join(named, "symbol", "left")
    return out.select(
        "file_id", F.coalesce("here.id", "there.id").alias("source_symbol_id"), "target_symbol_id", F.coalesce("_name", "_shown").alias("target_symbol_name"), "relationship_type",
        F.coalesce("here.selection_line", "there.selection_line").alias("line"), F.coalesce("here.selection_character", "there.selection_character").alias("character"),
        F.when(F.col("target_symbol_id").isNotNull(), "scip_definition").otherwise("unresolved").alias("resolution_method"), "definition_path", "definition_line", "definition_character",
        "own", "symbol",
    )


def stated_imports(occurrences: DataFrame, main: DataFrame) -> DataFrame:
    """(file_id, raw_import, resolved_id, resolution_method) of occurrences that import a symbol: the package of
    its string, or the whole string without one; once for each file, with the file that defines the first of the
    symbols, by place, that any file does."""
    words = F.split("symbol", " ")
    raw = F.when(F.size(words) >= 4, F.get(words, F.lit(3))).otherwise(F.col("symbol"))
    own = occurrences.where(F.col("symbol_roles").bitwiseAND(F.lit(IMPORT_ROLE)) > 0).where("symbol <> ''").select("file_id", "symbol", "range", raw.alias("raw_import")).where("raw_import <> ''")
    met = own.join(main.select(F.col("scip_symbol").alias("symbol"), F.col("file_id").alias("t")), "symbol", "left")
    first = met.groupBy("file_id", "raw_import").agg(F.min(F.when(F.col("t").isNotNull(), F.struct("range", "t"))).alias("x"))
    return first.select("file_id", "raw_import", F.col("x.t").alias("resolved_id"), F.when(F.col("x.t").isNotNull(), "scip_definition").otherwise("unresolved").alias("resolution_method"))


# fixed values: languages of an index by their names
INDEX_LANGUAGES = {
    "typescript": "typescript",
    "typescriptreact": "typescript",
    "javascript": "javascript",
    "javascriptreact": "javascript",
    "python": "python",
    "java": "java",
    "scala": "scala",
    "kotlin": "kotlin",
    "rust": "rust",
    "c": "c",
    "c++": "cpp",
    "cpp": "cpp",
    "c#": "csharp",
    "csharp": "csharp",
    "visualbasic": "csharp",
    "ruby": "ruby",
    "php": "php",
    "go": "go",
    "dart": "dart",
}


def document_language(stated: Column, path: Column) -> Column:
    """The language of an index's document: as stated, but that the extension decides between C and C++ where it
    has a language; by extension where the statement is empty or unknown; else null."""
    said = F.create_map(*[F.lit(x) for kv in INDEX_LANGUAGES.items() for x in kv])[F.lower(F.coalesce(stated, F.lit("")))]
    by_path = language_of(path)
    plain_header = F.lower(path).endswith(".h")
    return F.when(said.isin("c", "cpp"), F.when(plain_header, said).otherwise(F.coalesce(by_path, said))).otherwise(F.coalesce(said, by_path))


def external_symbols(symbols: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Symbol strings (column symbol) of packages that the index does not define: their first four words are
    no prefix of its own."""
    own = prefixes.select(F.substring_index("symbol", " ", 4).alias("_p")).distinct()
    return symbols.withColumn("_p", F.substring_index("symbol", " ", 4)).join(own, "_p", "left_anti").drop("_p")


def supplement_plan(files: DataFrame, symbols: DataFrame, sourced: DataFrame, most: int = 500) -> DataFrame:
    """Files that a language server should supplement: not sourced by the index, without symbols, or with
    spans of one point; in this order and by path, the first `most`."""
    flat = (F.col("start_line") == F.col("end_line")) & (F.col("start_character") == F.col("end_character"))
    per = symbols.groupBy("file_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(flat, F.lit(False)).cast("int")).alias("flat"))
    known = sourced.select("path").distinct().withColumn("_s", F.lit(True))
    why = F.when(F.col("_s").isNull(), 0).when(F.coalesce("n", F.lit(0)) == 0, 1).when(F.col("flat") > 0, 2)
    return files.join(known, "path", "left").join(per, F.col("id") == F.col("file_id"), "left").select("id", "path", "language", why.alias("reason")).where("reason is not null").orderBy("reason", "path").limit(most)


def normal_signature(text: str | None) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text or "")).rstrip(";")


WEIGHTS = {"selection": 10000, "start": 6000, "signature": 4000, "parent": 1000, "overlap": 500, "kind": 200, "line": 100}


def match_score(a: dict, b: dict) -> int:
    """How well an indexed symbol fits one of the language server; 0 is no candidate."""
    if a["name"] != b["name"]:
        return 0
    s = 0
    if a["selection_line"] is not None and (a["selection_line"], a["selection_character"]) == (b["selection_line"], b["selection_character"]):
        s += WEIGHTS["selection"]
    if (a["start_line"], a["start_character"]) == (b["start_line"], b["start_character"]):
        s += WEIGHTS["start"]
    if a["signature"] and b["signature"] and normal_signature(a["signature"]) == normal_signature(b["signature"]):
        s += WEIGHTS["signature"]
    if a["parent_name"] is not None and a["parent_name"] == b["parent_name"]:
        s += WEIGHTS["parent"]
    if a["start_line"] <= b["end_line"] and b["start_line"] <= a["end_line"]:
        s += WEIGHTS["overlap"]
    if a["kind"] == b["kind"]:
        s += WEIGHTS["kind"]
    if a["start_line"] == b["start_line"]:
        s += WEIGHTS["line"]
    return s


def stable_pairs(left: list[dict], right: list[dict]) -> list[tuple[int, int, int]]:
    """(left id, right id, score) by deferred acceptance. A name that several symbols have on both sides is
    only matched where something beyond name, kind and overlap tells them apart."""
    scores = {(a["id"], b["id"]): match_score(a, b) for a in left for b in right}
    many = {n for n in {a["name"] for a in left} if sum(a["name"] == n for a in left) > 1 and sum(b["name"] == n for b in right) > 1}
    weak = WEIGHTS["overlap"] + WEIGHTS["kind"] + WEIGHTS["line"]
    prefs = {a["id"]: sorted((b["id"] for b in right if scores[a["id"], b["id"]] > (weak if a["name"] in many else 0)), key=lambda r: (-scores[a["id"], r], r)) for a in left}
    taken: dict[int, int] = {}
    free = [a["id"] for a in left][::-1]
    while free:
        a = free.pop()
        while prefs[a]:
            r = prefs[a].pop(0)
            if r not in taken or (scores[a, r], -a) > (scores[taken[r], r], -taken[r]):
                if r in taken:
                    free.append(taken[r])
                taken[r] = a
                break
    return sorted((a, r, scores[a, r]) for r, a in taken.items())


MATCHED = ("id", "name", "kind", "start_line", "start_character", "end_line", "selection_line", "selection_character", "signature", "parent_name")


def in_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[list[dict]], list[dict]], columns: dict[str, pa.DataType]) -> DataFrame:
    """run over the rows of each group, in order: groups are met one after another in sorted partitions, so that
    many small ones cost no call of Spark's each, and one is held at a time."""
    schema = pa.schema(list(columns.items()))

    def go(batches):
        key, held, out = None, [], []
        for b in batches:
            for r in b.to_pylist():
                k = tuple(r[c] for c in keys)
                if k != key and held:
                    out += run(held)
                    held = []
                key = k
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
        if held:
            yield pa.RecordBatch.from_pylist(run(held), schema=schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(go, from_arrow_schema(schema))


def matched(indexed: DataFrame, served: DataFrame) -> DataFrame:
    """(file_id, indexed_id, served_id, score): stable matching within each file and name. Rows meet by file
    and name, which is what bounds a group."""
    left = indexed.select("file_id", F.lit(0).alias("side"), *MATCHED)
    right = served.select("file_id", F.lit(1).alias("side"), *MATCHED)

    def run(rows: list[dict]) -> list[dict]:
        got = stable_pairs([r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1])
        return [{"file_id": rows[0]["file_id"], "indexed_id": a, "served_id": b, "score": s} for a, b, s in got]

    return in_groups(left.unionByName(right), ["file_id", "name"], ["side", "id"], run, {"file_id": pa.int64(), "indexed_id": pa.int64(), "served_id": pa.int64(), "score": pa.int32()})


def supplements(served: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of the language server that the index lacks: none of the same file, name and kind has their
    selection or overlaps them."""
    b = symbols.select(F.col("file_id").alias("_f"), F.col("name").alias("_n"), F.col("kind").alias("_k"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), F.col("selection_line").alias("_l"), F.col("selection_character").alias("_c"))
    same = (F.col("file_id") == F.col("_f")) & (F.col("name") == F.col("_n")) & (F.col("kind") == F.col("_k"))
    place = ((F.col("selection_line") == F.col("_l")) & (F.col("selection_character") == F.col("_c"))) | ((F.col("start_line") <= F.col("_e")) & (F.col("_s") <= F.col("end_line")))
    return served.join(b, same & F.coalesce(place, F.lit(False)), "left_anti")


def exact_callee(points: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(point_id, symbol_id) of points (point_id, path, branch, name, kind, line, character) that hit the
    selection or start of exactly one symbol."""
    s = symbols.join(files.select(F.col("id").alias("file_id"), "path", "branch"), "file_id").select("path", "branch", "name", "kind", F.col("id").alias("symbol_id"), F.explode(F.array_distinct(F.array(F.struct(F.col("selection_line").alias("line"), F.col("selection_character").alias("character")), F.struct(F.col("start_line").alias("line"), F.col("start_character").alias("character"))))).alias("at")).select("path", "branch", "name", "kind", "symbol_id", "at.line", "at.character")
    met = points.join(s, ["path", "branch", "name", "kind", "line", "character"]).groupBy("point_id").agg(F.countDistinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"))
    return met.where("n = 1").select("point_id", "symbol_id")


def enriched(rows: DataFrame, facts: DataFrame, columns: list[str], only_open: bool = False) -> DataFrame:
    """rows with columns filled from facts (id, columns) where it has a value; with only_open just rows that
    are unresolved and without a definition path."""
    f = facts.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    want = (F.col("resolution_method") == "unresolved") & F.col("definition_path").isNull() if only_open else F.lit(True)
    return rows.join(f, "id", "left").withColumns({c: F.when(want, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in columns}).select(*rows.columns)


def header_declarations(references: DataFrame, functions: DataFrame, bodies: DataFrame) -> DataFrame:
    """References in headers to known functions outside of any body: forward declarations. references are
    (point_id, file_id, path, line, symbol); functions (symbol, id); bodies (file_id, start_line, end_line)."""
    heads = references.where(F.col("path").rlike(r"\.(h|hh|hpp)$")).join(functions.withColumnRenamed("id", "function_id"), "symbol")
    b = bodies.select(F.col("file_id").alias("_f"), "start_line", "end_line")
    return heads.join(b, (F.col("file_id") == F.col("_f")) & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")), "left_anti")


def macro_symbols(macros: DataFrame, served: DataFrame) -> DataFrame:
    """Macros (file_id, name, line, end_line, conditions) with the server's symbol on their lines; those under
    a condition stay only if matched. `origin` says where a row comes from."""
    s = served.select(F.col("file_id").alias("_f"), F.col("name").alias("_n"), F.col("start_line").alias("_l"), F.col("id").alias("served_id"))
    met = macros.join(s, (F.col("file_id") == F.col("_f")) & (F.col("name") == F.col("_n")) & (F.col("_l") >= F.col("line")) & (F.col("_l") <= F.col("end_line")), "left")
    return met.where(F.col("served_id").isNotNull() | (F.size("conditions") == 0)).withColumn("origin", F.when(F.col("served_id").isNotNull(), "matched").otherwise("text")).drop("_f", "_n", "_l")


def converted_column(line: str, column: int, encoding: str) -> int:
    """UTF-16 column of a column in UTF-8, UTF-16 or UTF-32 units, clamped to the line and to characters."""
    if line.isascii() or encoding == "utf-16":
        return max(0, min(column, len(line.encode("utf-16-le")) // 2))
    if encoding == "utf-32":
        return len(line[: max(0, column)].encode("utf-16-le")) // 2
    return len(line.encode()[: max(0, column)].decode("utf-8", "ignore").encode("utf-16-le")) // 2


def converted_columns(df: DataFrame, line: str, column: str, encoding: str) -> DataFrame:
    @F.pandas_udf("int")
    def convert(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or t is None else converted_column(t, int(a), encoding) for t, a in zip(text, at)], dtype="Int32")

    return df.withColumn(column, convert(line, column))


def brace_span(source: str, line: int, most_bytes: int = 1 << 20, most_lines: int = 20_000) -> tuple[int, int] | None:
    """Lines (first, last) of the declaration from `line` to the brace that closes its body; None if a
    semicolon ends it first or it exceeds the bounds. Comments, strings and directives are skipped, and an
    initialiser's braces in parentheses or after a colon don't open the body."""
    lines = source.split("\n")
    text = "\n".join(lines[line : line + most_lines])[:most_bytes]
    token = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|^[ \t]*#[^\n]*(?:\\\n[^\n]*)*|[{}();:,]|\n', re.S | re.M)
    depth = parens = row = 0
    initialiser = False
    before = ""
    at = 0
    for m in token.finditer(text):
        between = text[at : m.start()].strip()
        at = m.end()
        before = between or before
        t = m[0]
        if t == "(":
            parens += 1
        elif t == ")":
            parens -= 1
            before = ")"
        elif t == ":" and not depth and not parens and before == ")":
            initialiser = True
        elif t == "{" and not parens:
            if initialiser and not depth and before not in (")", "}") and re.fullmatch(r"[\w:<>, ]+", before or " "):
                depth -= 1000  # a member's braces
            depth += 1
            before = "{"
        elif t == "}" and not parens:
            depth -= 1
            if depth == -1000:
                depth = 0
                before = "}"
                continue
            if depth == 0:
                return line, line + row
            before = "}"
        elif t == ";" and depth == 0 and not parens:
            return None
        row += t.count("\n")
    return None


def macro_span(source: str, line: int, most: int = 4096) -> tuple[int, int]:
    lines, last = source.split("\n"), line
    while last + 1 < len(lines) and last - line < most and lines[last].rstrip("\r").endswith("\\"):
        last += 1
    return line, last


def body_spans(points: DataFrame, files: DataFrame) -> DataFrame:
    """points (point_id, file_id, line) with end_line by braces, null for declarations. Points meet their
    file's source in batches; a source is read for each of its points in a batch."""
    rows = points.join(files.select(F.col("id").alias("file_id"), "source"), "file_id").select("point_id", "file_id", "line", "source")

    def run(batches):
        for b in batches:
            got = [brace_span(s or "", n) for s, n in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([g[1] if g else None for g in got], pa.int32())], names=["point_id", "file_id", "line", "end_line"])

    return rows.select("point_id", "file_id", F.col("line").cast("int"), "source").mapInArrow(run, f"point_id {rows.schema['point_id'].dataType.simpleString()}, file_id long, line int, end_line int")
