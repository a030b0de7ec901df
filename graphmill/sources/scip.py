"""Compiler index files: a reader of their protobuf encoding, by field numbers of the public schema."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "path string, language string, text string, occurrences array<struct<range:array<int>,symbol:string,symbol_roles:int,enclosing_range:array<int>,syntax_kind:int>>, "
    "symbols array<struct<symbol:string,documentation:array<string>,relationships:array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean>>,kind:int,display_name:string>>"
)


def varint(data: bytes, at: int) -> tuple[int, int]:
    shift = out = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def fields(data: bytes):
    """(number, value) of a message: ints, or bytes for what has a length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = struct.unpack_from("<q" if n == 8 else "<i", data, at)[0], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def numbers(value) -> list[int]:
    """Packed or single integers."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = varint(value, at)
        out.append(n)
    return out


def occurrence(data: bytes) -> dict:
    out = {"range": [], "symbol": "", "symbol_roles": 0, "enclosing_range": [], "syntax_kind": 0}
    for k, v in fields(data):
        if k == 1:
            out["range"] += numbers(v)
        elif k == 2:
            out["symbol"] = v.decode()
        elif k == 3:
            out["symbol_roles"] = v
        elif k == 5:
            out["syntax_kind"] = v
        elif k == 7:
            out["enclosing_range"] += numbers(v)
    return out


def relationship(data: bytes) -> dict:
    names = {2: "is_reference", 3: "is_implementation", 4: "is_type_definition", 5: "is_definition"}
    out = {"symbol": "", **dict.fromkeys(names.values(), False)}
    for k, v in fields(data):
        if k == 1:
            out["symbol"] = v.decode()
        elif k in names:
            out[names[k]] = bool(v)
    return out


def information(data: bytes) -> dict:
    out = {"symbol": "", "documentation": [], "relationships": [], "kind": 0, "display_name": ""}
    for k, v in fields(data):
        if k == 1:
            out["symbol"] = v.decode()
        elif k == 3:
            out["documentation"].append(v.decode())
        elif k == 4:
            out["relationships"].append(relationship(v))
        elif k == 5:
            out["kind"] = v
        elif k == 6:
            out["display_name"] = v.decode()
    return out


def document(data: bytes) -> dict:
    out = {"path": "", "language": "", "text": "", "occurrences": [], "symbols": []}
    for k, v in fields(data):
        if k == 1:
            out["path"] = v.decode()
        elif k == 2:
            out["occurrences"].append(occurrence(v))
        elif k == 3:
            out["symbols"].append(information(v))
        elif k == 4:
            out["language"] = v.decode()
        elif k == 5:
            out["text"] = v.decode()
    return out


def documents(spark: SparkSession, path: str, selected: DataFrame | None = None) -> DataFrame:
    """Documents of all index files below a path; with selected, those of its paths only. A document is
    decoded at a time, so a file is held encoded but never decoded as a whole."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.scip").option("recursiveFileLookup", True).load(path).select("content")

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                for k, v in fields(data):
                    if k == 2:
                        yield pa.RecordBatch.from_pylist([document(v)], schema=SCHEMA)

    out = files.mapInArrow(run, DOCUMENT)
    return out if selected is None else out.join(selected.select("path").distinct(), "path", "left_semi")


_RELATION = pa.struct([("symbol", pa.string()), ("is_reference", pa.bool_()), ("is_implementation", pa.bool_()), ("is_type_definition", pa.bool_()), ("is_definition", pa.bool_())])
SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("language", pa.string()),
        ("text", pa.string()),
        ("occurrences", pa.list_(pa.struct([("range", pa.list_(pa.int32())), ("symbol", pa.string()), ("symbol_roles", pa.int32()), ("enclosing_range", pa.list_(pa.int32())), ("syntax_kind", pa.int32())]))),
        ("symbols", pa.list_(pa.struct([("symbol", pa.string()), ("documentation", pa.list_(pa.string())), ("relationships", pa.list_(_RELATION)), ("kind", pa.int32()), ("display_name", pa.string())]))),
    ]
)


def occurrences(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Occurrences by file id, in order of place."""
    own = docs.join(files.select(F.col("id").alias("file_id"), "path"), "path")
    return own.select("file_id", F.explode("occurrences").alias("o")).select("file_id", "o.*")


def informations(docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """What the documents say about symbols; with files, by file id as well."""
    if files is None:
        return docs.select(F.explode("symbols").alias("s")).select("s.*")
    return docs.join(files.select(F.col("id").alias("file_id"), "path"), "path").select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.*")


def precomputed(paths: DataFrame, directory: str, languages: list[str]) -> DataFrame:
    """Of index paths below a directory the one for everything, else those of the wanted languages."""
    d = directory.rstrip("/")
    inside = paths.where(F.col("path").startswith(d + "/") & ~F.col("path").contains("/../"))
    whole = inside.where(F.col("path") == f"{d}/index.scip")
    each = inside.where(F.col("path").isin([f"{d}/{x}.scip" for x in languages]))
    return whole.unionByName(each.join(whole.select(F.lit(1).alias("_w")).limit(1), F.lit(True), "left_anti"))
