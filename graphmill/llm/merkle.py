"""A Merkle manifest of a dataset: one tree for each group of rows, one over the groups, and a proof for each row.

A leaf is the SHA-256 of a row's fields, each `-` if null, else its length in UTF-8 bytes, a colon and the value.
The leaves of a group ascend by id; while there are several nodes, every FAN consecutive ones (the last run may have
fewer, even one) become the SHA-256 of their hexadecimal digests in sequence. What remains is the group's subroot, and the subroots,
by group (null first, bytewise), form the last tree in the same way. A proof is the siblings on the way to the root.

The nodes lie in an external-memory store, Parquet folders `tree=<groups or top>/level=<k>` in the shared folder, whose rows
are runs of FAN nodes with their coordinates (group, number of the run):
1. The leaves' digests, not the texts, are sorted by group and id into ranges, so a large group is spread over
   tasks. Each range streams through one task, which numbers the leaves of each group; only a range's first group
   can have leaves in earlier ones, and how many is one number for each range.
2. A level is made by one sequential read of the level below: nodes of consecutive coordinates stream into runs.
   Runs that a task sees in part, at the ends of its ranges, are the only rows that are shuffled, and put together.
3. Proofs are extracted downwards: the siblings on the way from a run to the root are merged, by coordinate, with
   the runs of the next lower level, which has FAN times as many. So each way is held once for FAN leaves.
Each level is written, so lost executors cost one level at most.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.columns import ascii_lower
from graphmill.llm.common import bounded_batches, drop_stored, scratch, stored

FAN = 16
HEX = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One of this many rows, by its id's CRC-32, is altered in the check of the proofs.
ALTERED = 5


def leaf(fields: list[Column]) -> Column:
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def altered_leaf(docs: DataFrame, fields: tuple[str, ...], id_col: str, text_col: str) -> Column:
    """The leaf with the text's A-Z lower-cased, for the rows chosen by their ids; null for the others."""
    chosen = F.crc32(F.col(id_col).cast("string")) % ALTERED == 0
    return F.when(chosen, leaf([ascii_lower(f) if f == text_col else F.col(f) for f in fields]))


def _ordered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, ...) in this order, stored in sorted files: with part, the range, and place, the number within grp there."""
    names = rows.columns
    at = names.index("grp")

    def number(batches):
        part = TaskContext.get().partitionId()
        last, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            grp = b.column(at)
            new = np.ones(b.num_rows, bool)
            new[1:] = np.asarray(pa.compute.not_equal(grp.slice(1), grp.slice(0, b.num_rows - 1)))
            start = np.flatnonzero(new)
            place = np.arange(b.num_rows) - np.repeat(start, np.diff(np.append(start, b.num_rows)))
            if grp[0].as_py() == last:
                place[: start[1] if len(start) > 1 else b.num_rows] += count
            last, count = grp[b.num_rows - 1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(np.full(b.num_rows, part, np.int32))], names=[*names, "place", "part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{schema}, place long, part int"))


def _positions(ranged: DataFrame) -> DataFrame:
    """_ordered() rows with pos: the place within the range, after the leaves of the same group in earlier ranges."""
    w = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranged.groupBy("grp", "part").agg(F.count("*").alias("n")).select("grp", "part", F.sum("n").over(w).alias("earlier")).where("earlier > 0")
    # one row for each range at most
    return ranged.join(F.broadcast(earlier), ["grp", "part"], "left").select(*(c for c in ranged.columns if c not in ("place", "part")), (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("pos"))


def _into_runs(nodes: DataFrame, held: list[str]) -> DataFrame:
    """Nodes (grp, pos, held...) as runs (grp, run, held as arrays by pos): one pass, runs seen in part put together."""
    cols = ["grp", "pos", *held]
    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = f"grp string, run long, first long, {', '.join(f'{c} array<{types[c]}>' for c in held)}"

    def pack(t: pa.RecordBatch) -> pa.RecordBatch:
        grp, pos = t.column(0), t.column(1).to_numpy()
        new = np.ones(len(pos), bool)
        other = np.asarray(pa.compute.not_equal(grp.slice(1), grp.slice(0, len(pos) - 1)))
        new[1:] = other | (pos[1:] // FAN != pos[:-1] // FAN) | (pos[1:] != pos[:-1] + 1)
        start = np.flatnonzero(new)
        offsets = pa.array(np.append(start, len(pos)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, t.column(2 + k)) for k in range(len(held))]
        return pa.RecordBatch.from_arrays([grp.take(pa.array(start)), pa.array(pos[start] // FAN), pa.array(pos[start]), *lists], names=["grp", "run", "first", *held])

    def stream(batches):
        rest = None
        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0] if b.num_rows else rest
            if not b.num_rows:
                continue
            pos = b.column(1).to_numpy()
            # the last run may go on in the next batch
            last = max(0, len(pos) - FAN)
            same = np.flatnonzero(pos[last:] // FAN != pos[-1] // FAN)
            cut = last + (int(same[-1]) + 1 if len(same) else 0)
            if cut:
                yield pack(b.slice(0, cut))
            rest = b.slice(cut)
        if rest is not None and rest.num_rows:
            yield pack(rest)

    seen = stored(nodes.select(*cols).mapInArrow(stream, schema))
    whole = F.size(held[0]) == FAN
    parts = seen.where(~whole).groupBy("grp", "run").agg(F.array_sort(F.collect_list(F.struct("first", *held))).alias("p"))  # FAN parts at most
    joined = parts.select("grp", "run", *(F.flatten(F.col("p").getField(c)).alias(c) for c in held))
    return seen.where(whole).select("grp", "run", *held).unionByName(joined)


def _parent(digests: str = "digest") -> Column:
    """The node of a run: its digest, or a lone node itself."""
    lone = (F.size(digests) == 1) & (F.col("run") == 0)
    return F.when(lone, F.col(digests)[0]).otherwise(F.sha2(F.concat_ws("", digests), 256))


def _siblings() -> Column:
    """Of an exploded run (digest, own: the number of digests before the own one): the others, concatenated."""
    return F.concat_ws("", F.slice("digest", 1, F.col("own")), F.slice("digest", F.col("own") + 2, FAN))


def _step() -> Column:
    """The run's step of a shape, see folded(): none for a lone node."""
    lone = (F.size("digest") == 1) & (F.col("run") == 0)
    return F.when(lone, F.array().cast("array<int>")).otherwise(F.array(F.col("own") * 2 * FAN + F.size("digest")))


class Tree:
    """The levels of one tree for each grp, from rows (grp, digest, held...) in the given order."""

    def __init__(self, rows: DataFrame, order: list[str], held: list[str], path: str) -> None:
        spark = rows.sparkSession
        ranged = _ordered(rows, order)
        nodes, cols = _positions(ranged), ["digest", *held]
        self.levels: list[DataFrame] = []
        while True:
            at = f"{path}/level={len(self.levels)}"
            _into_runs(nodes, cols).write.option("compression", "zstd").parquet(at)
            level = spark.read.parquet(at)
            self.levels.append(level)
            drop_stored(ranged)
            ranged = None
            if not level.agg(F.max("run")).first()[0]:
                break
            nodes, cols = level.select("grp", F.col("run").alias("pos"), _parent().alias("digest")), ["digest"]

    def tops(self) -> DataFrame:
        """(grp, digest) of the last node of each grp."""
        return self.levels[-1].select("grp", _parent().alias("digest"))

    def ways(self, tops: DataFrame) -> DataFrame:
        """(grp, run, siblings, shape, and what else tops has) of the leaves' runs: the way from the run's node to
        the root. tops: (grp, siblings, shape, ...) of the last nodes. siblings are concatenated; shape has, for each
        step, FAN * 2 * the number of digests before the own one + the number of digests in all."""
        ways = tops.withColumn("run", F.lit(0).cast("long"))
        for level in reversed(self.levels[1:]):
            ways = level.select("grp", "run", "digest").join(ways, ["grp", "run"]).select(*ways.columns, "digest", F.posexplode("digest").alias("own", "_")).withColumn("pos", F.col("run") * FAN + F.col("own"))
            ways = ways.withColumns({"siblings": F.concat(_siblings(), "siblings"), "shape": F.concat(_step(), "shape"), "run": F.col("pos")}).drop("digest", "own", "_", "pos")
        return ways


class Manifest:
    """The manifest of docs: trees by source and over the sources. See proofs() and audit().

    Rows with a null source are a group of their own, the first. A null id comes first within its group, and is
    never altered; rows of equal group and id follow by their leaves, so that repeated rows, which have equal
    leaves, give the same tree in any order. A null or empty text, or any null field, is a value of its own. A
    text of any length is hashed where it is read. Columns that are no fields are not read. An empty table has
    no root, and no rows."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> None:
        bounded_batches(docs.sparkSession)
        self.path = scratch(docs.sparkSession)
        grp = F.coalesce(F.concat(F.lit("1"), F.col(group_col)), F.lit("0"))
        leaves = stored(docs.select(grp.alias("grp"), F.col(id_col).cast("long").alias("id"), leaf([F.col(f) for f in fields]).alias("digest"), altered_leaf(docs, fields, id_col, text_col).alias("altered")))
        self.groups = Tree(leaves, ["grp", "id", "digest"], ["id", "altered"], f"{self.path}/tree=groups")
        drop_stored(leaves)
        tops = self.groups.tops().select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest")
        self.top = Tree(tops, ["id"], ["id"], f"{self.path}/tree=top")

    def subroots(self) -> DataFrame:
        """(source, subroot)."""
        return self.groups.tops().select(F.when(F.col("grp") != "0", F.substring("grp", 2, 1 << 30)).alias("source"), F.col("digest").alias("subroot"))

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return self.top.tops().select(F.col("digest").alias("root"))

    def _runs(self) -> DataFrame:
        """The leaves' runs with the way to the root: grp, run, id, digest, altered, subroot, root, siblings, shape."""
        none = F.array().cast("array<int>")
        ways = self.top.ways(self.top.tops().select("grp", F.lit("").alias("siblings"), none.alias("shape"), F.col("digest").alias("root")))
        # the subroots are the leaves of the top tree
        runs = self.top.levels[0].join(ways, ["grp", "run"]).select("run", "root", "siblings", "shape", "digest", F.posexplode("id").alias("own", "of"))
        tops = runs.select(F.col("of").alias("grp"), F.concat(_siblings(), "siblings").alias("siblings"), F.concat(_step(), "shape").alias("shape"), "root", F.element_at("digest", F.col("own") + 1).alias("subroot"))
        return self.groups.levels[0].join(self.groups.ways(tops), ["grp", "run"])

    def proofs(self) -> DataFrame:
        """Per row: id, leaf, subroot, root, siblings (the digests on the way, concatenated), shape (see folded())."""
        rows = self._runs().select("run", "id", "digest", "subroot", "root", "siblings", "shape", F.posexplode("digest").alias("own", "leaf"))
        return rows.select(F.element_at("id", F.col("own") + 1).alias("id"), "leaf", "subroot", "root", F.concat(_siblings(), "siblings").alias("siblings"), F.concat(_step(), "shape").alias("shape"))

    def audit(self, id_col: str = "doc_id") -> DataFrame:
        """Per row: id, leaf, subroot, root, proof_sha256 (of the siblings), folded_root (from the altered leaf of
        the rows chosen, else from the leaf), verified (whether that is the root)."""
        names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

        def run(batches):
            for b in batches:
                out: list[list] = [[] for _ in names]
                for r in b.to_pylist():
                    digests, siblings, shape = r["digest"], r["siblings"].encode(), r["shape"]
                    n, memo = len(digests), {}
                    for k, (id_, own, altered) in enumerate(zip(r["id"], digests, r["altered"])):
                        others = "".join(digests[:k] + digests[k + 1 :]).encode()
                        first = [] if n == 1 and r["run"] == 0 else [k * 2 * FAN + n]
                        up = folded(altered or own, others, first)
                        if up not in memo:
                            memo[up] = folded(up, siblings, shape)
                        row = (id_, own, r["subroot"], r["root"], sha256(others + siblings).hexdigest(), memo[up], memo[up] == r["root"])
                        for c, v in zip(out, row):
                            c.append(v)
                types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

        schema = f"{id_col} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return self._runs().select("run", "id", "digest", "altered", "subroot", "root", "siblings", "shape").mapInArrow(run, schema)


def folded(own: str, siblings: bytes, shape: list[int]) -> str:
    """The digest that `own` and its siblings lead to: each step of shape is 2 * FAN * (digests before) + digests in all."""
    at = 0
    for step in shape:
        before, n = divmod(step, 2 * FAN)
        end = at + HEX * (n - 1)
        own = sha256(siblings[at : at + HEX * before] + own.encode() + siblings[at + HEX * before : end]).hexdigest()
        at = end
    return own


def audit_sql(levels: int = 5) -> str:
    """DuckDB SQL of audit() over documents, for up to FAN ** levels rows of a source, and sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    lower = "array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' AND strlen(c) = 1 THEN lower(c) ELSE c END), '')"
    digest = lambda text: "sha256(" + " || ".join(text if f == "text" else field(f) for f in FIELDS) + ")"
    # CRC-32 by bits, over the characters of a decimal number
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), "
           "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")  # fmt: skip
    node = "CASE WHEN len(l) = 1 AND p = 0 THEN l[1] ELSE sha256(array_to_string(l, '')) END"
    sql = [
        f"h AS (SELECT doc_id, source, {digest(field('text'))} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % {ALTERED} = 0 THEN {digest('t')} END AS altered FROM (SELECT *, {field(lower)} AS t FROM documents))",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS d FROM h)",
    ]
    for k in range(levels):
        sql += [f"r{k} AS (SELECT source, p // {FAN} AS p, list(d ORDER BY p) AS l FROM n{k} GROUP BY source, n{k}.p // {FAN})", f"n{k + 1} AS (SELECT source, p, {node} AS d FROM r{k})"]
    sql.append(f"t0 AS (SELECT source, d AS subroot, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p FROM n{levels})")
    for k in range(levels):
        sql += [f"s{k} AS (SELECT p // {FAN} AS p, list(d ORDER BY p) AS l FROM t{k} GROUP BY t{k}.p // {FAN})", f"t{k + 1} AS (SELECT p, {node} AS d FROM s{k})"]
    sql.append("f0 AS (SELECT n.doc_id, n.leaf, t0.subroot, n.p, t0.p AS q, n.source, coalesce(n.altered, n.leaf) AS x, '' AS proof FROM n0 n JOIN t0 ON n.source IS NOT DISTINCT FROM t0.source)")
    for k in range(2 * levels):
        runs, on, at = (f"r{k}", f"r.source IS NOT DISTINCT FROM f.source AND r.p = f.p // {FAN}", "f.p") if k < levels else (f"s{k - levels}", f"r.p = f.q // {FAN}", "f.q")
        before, after = f"l[:{at} % {FAN}]", f"l[{at} % {FAN} + 2:]"
        up = f"CASE WHEN len(l) = 1 AND r.p = 0 THEN x ELSE sha256(array_to_string({before} || [x] || {after}, '')) END"
        p, q = ("r.p", "q") if k < levels else ("f.p", "r.p")
        sql.append(f"f{k + 1} AS (SELECT doc_id, leaf, subroot, {p} AS p, {q} AS q, f.source, {up} AS x, proof || array_to_string({before} || {after}, '') AS proof FROM f{k} f JOIN {runs} r ON {on})")
    return (
        f"WITH {', '.join(sql)} SELECT doc_id, leaf, subroot, (SELECT d FROM t{levels}) AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = (SELECT d FROM t{levels}) AS verified FROM f{2 * levels}"
    )
