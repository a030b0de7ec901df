"""SimHash near-duplicates: fingerprints of 64 bits, linked where at most DIFFER of their bits differ.

A text's A-Z are lower-cased; its words are runs without ASCII white space, its shingles three words in sequence, repeats
included, one space apart (fewer words: the whole sequence). A bit is 1 if it is set in over half of the shingles'
XXH64 values (seed 42); a text without words has fingerprint zero.

The search is a byte-position inverted index with count filtering. A fingerprint has eight positional bytes, and
two that differ in at most three bits share at least SHARED = 5 of them.
1. Documents of equal fingerprints form a class, represented by its smallest id; only classes are indexed.
2. A plain posting list, of one byte at one position, would hold one in 256 of all classes. Lists of four
   positions are kept instead, each the intersection of four plain ones: those of QUADS, the 14 sets of four
   positions whose numbers have exclusive or zero. They are a Steiner system S(3, 4, 8) that holds the complement of each of its sets:
   any three positions lie in one set, and its complement is a set without them. So any two fingerprints
   that share five bytes meet in a list.
3. In a list the shared bytes of each pair are tallied; pairs with SHARED are verified on all bits. A list of over PAIRWISE
   classes is divided by a fifth byte, at each other position, so that all pairs within a part have reached the
   tally. A part has 24 free bits: at most 2 ** 24 classes, and those within three bits are looked up in a
   table of these bits, in work linear in the part. Lists that hold over one in HOT_SHARE of all entries are
   divided in this way before they are shuffled.
4. A list gives each class with the smallest of those it is linked with there, not all pairs; these links form
   the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from graphmill.llm.common import HOT_SHARE, bounded_batches, drop_stored, join_skewed, stored
from graphmill.operators import graph

SHINGLE = 3
SEED = 42
#: Bits in which linked fingerprints may differ, and positional bytes that they share then at least.
DIFFER = 3
SHARED = 8 - DIFFER
QUADS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
QUINTS = list(combinations(range(8), SHARED))
#: Lists and parts up to this size are tallied pair by pair, up to SMALL all of a batch at once.
PAIRWISE = 1024
SMALL = 8
#: A list of fewer entries is never divided before the shuffle.
LEAST_HOT = 2000
#: Shingles whose bits are counted at a time.
SHINGLES_AT_ONCE = 1 << 16

I64, U64 = np.int64, np.uint64
_FLIPS = [sum(1 << b for b in c) for k in range(1, DIFFER + 1) for c in combinations(range(24), k)]


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = (ends - np.array([len(w) for w in words])).tolist()
    k = min(SHINGLE, len(words))
    ends = ends[k - 1 :].tolist()
    ones = np.zeros(64, I64)
    for at in range(0, len(ends), SHINGLES_AT_ONCE):
        h = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(begins[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE])]
        ones += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=I64)
    return int.from_bytes(np.packbits(2 * ones > len(ends), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint as a signed long): one row per row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = [fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, U64).view(I64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, fp long")


def _byte(p: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long"))


def _list_key(kind: int, positions: tuple[int, ...]) -> Column:
    """The list of the bytes at these positions: 40 bits of them, and the kind above."""
    key = F.lit(kind << 40).cast("long")
    for k, p in enumerate(positions):
        key = key.bitwiseOR(F.shiftleft(_byte(p), 8 * k))
    return key


def postings(classes: DataFrame) -> DataFrame:
    """(list, fp, rep) of classes (fp, rep): one entry for each quad, or, in its place where the quad's list is
    hot, one for each fifth position. Which lists are hot is counted; they are HOT_SHARE at most, and broadcast."""
    entries = classes.select("fp", "rep", F.posexplode(F.array(*(_list_key(k, q) for k, q in enumerate(QUADS)))).alias("quad", "list"))
    most = max(len(QUADS) * classes.count() // HOT_SHARE, LEAST_HOT)
    hot = F.broadcast(stored(entries.groupBy("list").count().where(F.col("count") > most).select("list", F.lit(True).alias("hot"))))
    fifths = [F.array(*(_list_key(len(QUADS) + k, c) for k, c in enumerate(QUINTS) if set(q) <= set(c))) for q in QUADS]
    divided = F.element_at(F.array(*fifths), F.col("quad") + 1)
    return entries.join(hot, "list", "left").select(F.explode(F.when(F.col("hot"), divided).otherwise(F.array("list"))).alias("list"), "fp", "rep")


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[k] and b[k] for each k; root holds each place's smallest place and stays flat."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def tally(fp: np.ndarray, root: np.ndarray) -> None:
    """Unite the pairs of a list that share SHARED positional bytes and differ in at most DIFFER bits."""
    block = max(1, (1 << 20) // len(fp))
    for i in range(0, len(fp), block):
        x = fp[i : i + block, None] ^ fp[None, :]
        shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(2)
        a, b = np.nonzero(shared >= SHARED)
        near = np.bitwise_count(x[a, b]) <= DIFFER
        _unite(root, a[near] + i, b[near])


class Neighbours:
    """Unites fingerprints that share five bytes, by a table of the other 24 bits."""

    def __init__(self) -> None:
        self.table: np.ndarray | None = None

    def unite(self, free: np.ndarray, at: np.ndarray, root: np.ndarray) -> None:
        """free: the other 24 bits, all different, of the places `at`."""
        if self.table is None:
            self.table = np.full(1 << 24, -1, np.int32)
        self.table[free] = np.arange(len(free))
        for k, flip in enumerate(_FLIPS):
            if k % 64 == 0 and (root[at] == root[at[0]]).all():
                break
            other = self.table[free ^ flip]
            mine = np.flatnonzero(other >= 0)
            _unite(root, at[mine], at[other[mine]])
        self.table[free] = -1


def links_of_list(fp: np.ndarray, near: Neighbours) -> np.ndarray:
    """For each of a list's fingerprints, all different, the place of the first that it is linked with there."""
    root = np.arange(len(fp))
    if len(fp) <= PAIRWISE:
        tally(fp, root)
        return root
    octets = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)
    common = (octets == octets[0]).all(0)
    quad = [p for p in range(8) if common[p]][:SHARED]  # four, or five where the list was divided before
    for p in range(8):
        if len(quad) < SHARED and p in quad or len(quad) == SHARED and p != quad[-1]:
            continue
        order = np.argsort(octets[:, p], kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(octets[order, p])) + 1):
            if 1 < len(part) <= PAIRWISE:
                own = np.arange(len(part))
                tally(fp[part], own)
                _unite(root, part, part[own])
            elif len(part) > 1:
                rest = [r for r in range(8) if r not in quad and r != p][:3]
                free = sum(octets[part, r].astype(I64) << (8 * k) for k, r in enumerate(rest))
                near.unite(free, part, root)
    return root


def links(entries: DataFrame) -> DataFrame:
    """(a, b) of postings: the smallest ids of classes that are linked, directly or by others of the same list."""

    def of_lists(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, near: Neighbours) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
        key, fp, rep = key[new], fp[new], rep[new]  # a divided list may come from two hot ones
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        small = np.repeat(size <= SMALL, size)
        for d in range(1, SMALL):
            i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
            x = fp[i] ^ fp[i + d]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            i = i[(shared >= SHARED) & (np.bitwise_count(x) <= DIFFER)]
            yield rep[i], rep[i + d]
        for s, n in zip(start[size > SMALL], size[size > SMALL]):
            root = links_of_list(fp[s : s + n], near)
            i = np.flatnonzero(root != np.arange(n))
            yield rep[s + i], rep[s + root[i]]

    def run(batches):
        near = Neighbours()
        rest: list[pa.RecordBatch] = []
        for b in batches:
            key = b.column(0).to_numpy()
            if not len(key):
                continue
            # whole lists only: the batch's last list may go on in the next one
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (rest and rest[-1].column(0)[0].as_py() != key[0]):
                yield from flush([*rest, b.slice(0, cut)], near)
                rest = []
            rest.append(b.slice(cut))
        if rest:
            yield from flush(rest, near)

    def flush(parts: list[pa.RecordBatch], near: Neighbours):
        key, fp, rep = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in range(3))
        for a, b in of_lists(key, fp.view(U64), rep, near) if len(key) > 1 else ():
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = entries.repartition("list").sortWithinPartitions("list", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable, its own included).

    Null and empty texts and texts without words have fingerprint zero and are linked like any other. Rows that
    share an id are one document with all their fingerprints. Rows with a null id are linked with nothing, and
    their component_id is null. A very long text is one row's work, in bounded parts. Other columns are not read. An empty table gives an
    empty result."""
    prof = stored(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    live = prof.where("id is not null")
    classes = stored(live.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    edges = links(postings(classes.select("fp", "rep")))
    if not live.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").isEmpty():
        total = prof.count()
        edges = edges.unionByName(join_skewed(live, classes, ["fp"], total).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comps = graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = stored(classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "m", F.coalesce("component", "rep").alias("component_id")))
    out = join_skewed(live, named, ["fp"], prof.count()).unionByName(prof.where("id is null").withColumns({"m": F.lit(0).cast("long"), "component_id": F.lit(None).cast("long")}))
    drop_stored(classes)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
