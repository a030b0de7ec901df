"""Near-duplicate groups by min-max hashing.

Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of
five words (with fewer words: the whole sequence). Each of PERMUTATIONS hash functions gives two signature
values, the minimum and the maximum over the set, so half as many evaluations as values. The values form
bands; documents that agree in a band are candidates, and a link is confirmed on the full sets.

Stages, all distributed:
1. One pass over the texts: set size, a 128-bit cryptographic digest of the full sorted set, and the bands' keys.
2. Documents with equal sets, as that digest confirms, form a class, represented by its smallest id.
3. Representatives that share a band: each is compared with one leader, the one of its buckets' most central
   members that it meets most centrally; confirmed links are contracted, and buckets that lie in one component
   drop out. Two such rounds join large groups with about one comparison a document and round.
4. Buckets that still touch several components are compared completely. Documents that such buckets connect
   are dealt out in blocks bounded in rows and text, every two blocks that may hold a new link meet in a group
   of their own (small clusters share one, up to the same bound), and the pairs that share a bucket, but no
   component, are counted there on the full sets. A group gives the links that it confirms, not its pairs;
   nothing is capped.

Buckets and classes that hold many rows are joined by broadcast of their keys, whose number is bounded, so that
no task gets all rows of one.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import SLICE_BYTES, bloom_filter, bounded_batches, drop_stored, join_skewed, slices, stored, text_buffer
from graphmill.operators import graph

SHINGLE = 5
#: Percent of the union that two sets share at least.
SIMILAR = 75
PERMUTATIONS = 64
ROWS = 4  # values in a band: a pair at 0.75 misses all 32 bands with a chance of 6e-6
BANDS = 2 * PERMUTATIONS // ROWS
#: Rounds of leader comparisons before the exact rest.
LEADER_ROUNDS = 2
#: Bounds of a block in the exact rest, where two blocks meet.
BLOCK = 4096
BLOCK_BYTES = 12 << 20
#: Blocks that are filled by one running sum.
COARSE = 64

U64 = np.uint64
PRIME = U64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


_INVERSE = pow(int(PRIME), -1, 1 << 64)
_KEPT: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1); those for a usual slice are kept."""
    have = _KEPT.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size == SLICE_BYTES + 1:
            _KEPT[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of consecutive texts, and each text's first word (n + 1 offsets)."""
    if not len(raw):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    text = LOWER[raw]
    blank = BLANK[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    edge = at[1:-1]
    edge = edge[edge < len(raw)]
    first[edge] = ~blank[edge]  # a text's start ends the word before it
    start = np.flatnonzero(first)
    last = ~blank
    last[:-1] &= blank[1:]
    edge = at[1:-1]
    edge = edge[edge > 0]
    last[edge - 1] = ~blank[edge - 1]
    end = np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((text.astype(U64) + U64(1)) * _powers(len(raw), int(PRIME)), out=sums[1:])
    words = (sums[end] - sums[start]) * _powers(len(raw), _INVERSE)[start]
    return mix(words + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)), np.searchsorted(start, at)


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, end to end, with n + 1 offsets."""
    words, of = word_hashes(raw, at)
    n = np.diff(of)
    mult = U64(0xA24BAED4963EE407)
    hashes = np.zeros(len(words), U64)
    padded = np.concatenate([words, np.zeros(size, U64)])
    for k in range(size):
        hashes = hashes * mult + padded[k : k + len(words)]
    hashes = mix(hashes)
    out, sizes = [], []
    for i in range(len(n)):
        if n[i] >= size:
            own = np.sort(hashes[of[i] : of[i + 1] - size + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n[i]:
            x = U64(0)
            with np.errstate(over="ignore"):
                for w in words[of[i] : of[i + 1]]:
                    x = x * mult + w
                own = mix(np.array([x + U64(int(n[i])) * U64(0x632BE59BD9B4E019)], U64))
        else:
            own = np.zeros(0, U64)
        out.append(own)
        sizes.append(len(own))
    return np.concatenate(out) if out else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 2**63, PERMUTATIONS, U64) * U64(2) + U64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, U64)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of 2 * PERMUTATIONS values: per permutation the smallest and the largest. Empty sets get zeros."""
    out = np.zeros((len(at) - 1, 2 * PERMUTATIONS), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        starts = at[full]
        for k in range(PERMUTATIONS):
            h = ((sets * _A[k] + _B[k]) >> U64(32)).astype(np.uint32)
            out[full, 2 * k] = np.minimum.reduceat(h, starts)
            out[full, 2 * k + 1] = np.maximum.reduceat(h, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for each band."""
    keys = np.zeros((len(sig), BANDS), U64)
    values = sig.reshape(len(sig), BANDS, ROWS).astype(U64)
    for k in range(ROWS):
        keys = (keys + values[:, :, k]) * PRIME
        keys ^= keys >> U64(29)
    return mix(keys + np.arange(BANDS, dtype=U64) * U64(0x94D049BB133111EB))


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(values.reshape(-1)))


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, fp_a, fp_b (fingerprint of the set), bands: one row per document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(id_col, text_col)

    def run(batches):
        for b in batches:
            raw, at = text_buffer(b.column(1))
            for i, j in slices(at):
                sets, of = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                sig = signatures(sets, of)
                n = np.diff(of)
                fp = np.frombuffer(b"".join(blake2b(sets[of[k] : of[k + 1]], digest_size=16).digest() for k in range(j - i)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array(fp[:, 0]),
                        pa.array(fp[:, 1]),
                        _lists(band_keys(sig).view(np.int64)),
                    ],
                    names=[id_col, "n_shingles", "fp_a", "fp_b", "bands"],
                )

    return rows.mapInArrow(run, f"{id_col} long, n_shingles long, fp_a long, fp_b long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over edges (a, b). Only nodes with edges appear."""
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("component", "comp")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of pairs (a, b) of ids, those whose full sets are similar."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wide = (
        pairs.join(text.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(text.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            raw_a, at_a = text_buffer(batch.column(2))
            raw_b, at_b = text_buffer(batch.column(3))
            a_ids = batch.column(0).to_numpy()
            before, own = None, None
            for i, j in slices(at_b):
                sets, of = shingle_sets(raw_b[at_b[i] : at_b[j]], at_b[i : j + 1] - at_b[i])
                for k in range(i, j):
                    if before is None or a_ids[k] != before:
                        x = raw_a[at_a[k] : at_a[k + 1]]
                        before, own = a_ids[k], shingle_sets(x, np.array([0, len(x)]))[0]
                    other = sets[of[k - i] : of[k - i + 1]]
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    keep[k] = common > 0 and 100 * common >= SIMILAR * (len(own) + len(other) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return wide.mapInArrow(run, "a long, b long").distinct()


def _relabel(bands: DataFrame, comps: DataFrame | None) -> DataFrame:
    """bands with the component of each id: its own id where it has no link yet."""
    if comps is None:
        return bands.withColumn("comp", F.col("id"))
    return bands.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id, kept.

    Null and empty texts and texts without words have an empty set and are linked with nothing. Rows that
    share an id count as one document with every one of their sets: they are linked with each other. Rows
    with a null id are linked with nothing: component_id is null and kept is true. Other columns are not
    read. An empty table gives an empty result."""
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    prof = stored(profiles(docs, id_col, text_col))
    base = prof.select(F.col(id_col).alias("id"), "n_shingles", "fp_a", "fp_b")
    live = base.where("id is not null and n_shingles > 0")
    total = prof.count()
    fp = ["fp_a", "fp_b", "n_shingles"]
    classes = stored(live.groupBy(*fp).agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    # one row of bands for each class, from the rows of its representative
    reps = (
        prof.where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0))
        .join(classes.select(F.col("rep").alias(id_col), *fp), [id_col, *fp], "left_semi")
    )
    keyed = reps.select(F.col(id_col).alias("id"), F.explode("bands").alias("key"))
    # ids of a bucket may repeat where rows share an id; such a bucket is not shared by that alone
    shared = stored(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("key", "m"))
    held = stored(join_skewed(keyed, shared, ["key"], BANDS * total).select("key", "id", "m"))
    rows = held.count()
    # documents of several classes under one id, or of a class with another smallest id, are tied by id
    ties = join_skewed(live, classes, fp, total).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    twice = live.groupBy("id").agg(F.min("fp_a").alias("x"), F.max("fp_a").alias("y")).where("x <> y").limit(1).count() > 0

    # the texts of documents that share a bucket; the filter's false positives do no harm
    may_share = bloom_filter(held.select("id").distinct())
    texts = stored(docs.where(may_share(F.col(id_col))))

    # how central a document is: the sizes of its buckets together
    degree = held.groupBy("id").agg(F.sum("m").alias("deg"))
    bands = stored(held.join(degree, "id").select("key", "id", "deg"))
    drop_stored(shared, held)

    links: DataFrame | None = None
    comps: DataFrame | None = None
    tried: DataFrame | None = None
    for _ in range(LEADER_ROUNDS):
        labelled = _relabel(bands, comps)
        lead = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("deg", F.col("id"), "comp")).alias("lead"), F.count("*").alias("m")).where("lo < hi")
        lead = stored(graph.gathered(lead.select("key", "m", F.col("lead.id").alias("a"), F.col("lead.comp").alias("a_comp"), F.col("lead.deg").alias("lead_deg")), rows))
        met = join_skewed(labelled.select("key", "id", "comp"), lead, ["key"], rows).where("comp <> a_comp")
        pairs = met.groupBy("a", F.col("id").alias("b")).agg(F.max("lead_deg").alias("deg"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(graph.gathered(pairs.groupBy("b").agg(F.max(F.struct("deg", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"), rows))
        drop_stored(lead)
        if pairs.isEmpty():
            break
        found = stored(graph.gathered(confirmed(pairs, texts, id_col, text_col), rows))
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        before, comps = comps, stored(components(links))
        drop_stored(before)
    found = _rest(bands, comps, texts, rows, id_col, text_col)
    drop_stored(bands, texts)
    if found is not None:
        links = found if links is None else links.unionByName(found)
    if twice:  # rows that share an id join all their classes
        links = ties if links is None else links.unionByName(ties)
    if links is not None:
        comps = stored(components(links))
    # each class gets its component before the documents get their class, so no key of theirs is shuffled but fp
    if comps is not None:
        named = classes.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    else:
        named = classes.withColumn("comp", F.lit(None).cast("long"))
    out = join_skewed(live, named, fp, total).select("id", "n_shingles", "rep", "comp")
    none = F.lit(None).cast("long")
    out = out.unionByName(base.where("id is null or n_shingles = 0").select("id", "n_shingles", none.alias("rep"), none.alias("comp")))
    # rep is the smallest id of the class, comp the smallest of the component
    comp = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.coalesce("comp", "rep"))
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.cast("long").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )


def _rest(bands: DataFrame, comps: DataFrame | None, texts: DataFrame, total: int, id_col: str, text_col: str) -> DataFrame | None:
    """All links between documents of different components that share a bucket, but for some that follow from
    others of the same group."""
    dealt = dealt_out(bands, comps, texts, total, id_col, text_col)
    if dealt is None:
        return None

    def meet(t: pa.Table) -> pa.Table:
        cluster, i, j = (t.column(c).to_numpy() for c in ("cluster", "i", "j"))
        order = np.lexsort((j, i, cluster))
        new = np.flatnonzero(np.any(np.diff(np.stack([cluster[order], i[order], j[order]])), axis=0)) + 1
        out: list[tuple[int, int]] = []
        for at in np.split(order, new):
            out += new_links(t.take(pa.array(at)))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return stored(graph.gathered(dealt.groupBy("bundle", "i", "j").applyInArrow(meet, "a long, b long").distinct(), total))


def dealt_out(bands: DataFrame, comps: DataFrame | None, texts: DataFrame, total: int, id_col: str, text_col: str) -> DataFrame | None:
    """The rows (bundle, cluster, i, j, own, id, comp, keys, text) of what is left to compare, or None.

    A cluster of few rows and little text is one block and meets itself; a hash packs such clusters into bundles
    of about half a block, so that with clusters of a sixteenth of a block at most a bundle stays within a
    block. Any other cluster is a bundle of its own, and each two of its blocks a group. So a group has about
    two blocks at most, each of BLOCK rows and BLOCK_BYTES, or one longer text."""
    labelled = _relabel(bands, comps)
    still = stored(graph.gathered(labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("first"), F.count("*").alias("m")).where("lo < hi").select("key", "first", "m"), total))
    members = stored(graph.gathered(join_skewed(labelled, still, ["key"], total).select("key", "first", "id", "comp").distinct(), total))
    drop_stored(still)
    if members.isEmpty():
        return None
    cluster = components(members.select(F.col("id").alias("a"), F.col("first").alias("b"))).select(F.col("node").alias("id"), F.col("comp").alias("cluster"))
    rows = members.groupBy("id", "comp").agg(F.collect_set("key").alias("keys")).join(cluster, "id")  # a document has BANDS keys at most
    text = texts.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = stored(rows.join(text, "id").select("cluster", "id", "comp", "keys", "text"))
    drop_stored(members)
    # what something fills of a block; a block takes rows up to a load of one and the row that exceeds it
    load = lambda n, size: F.greatest(n / BLOCK, size / BLOCK_BYTES) * 4 / 3
    light = stored(graph.gathered(rows.groupBy("cluster", "id", "comp").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")), total))
    # of each cluster the largest component is dealt out by itself: its blocks needn't meet one another
    per = light.groupBy("cluster", "comp").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("m"))
    sizes = per.groupBy("cluster").agg(F.max(F.struct("n", "comp", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("m").alias("m"))
    coarse = lambda n, size: F.ceil(load(n, size) / COARSE).cast("int")
    deal = stored(
        graph.gathered(sizes, total).select(
            "cluster", "m", (load(F.col("n"), F.col("size")) <= 1 / 16).alias("small"), load(F.col("n"), F.col("size")).alias("load"), F.col("top.comp").alias("main"),
            coarse(F.col("top.n"), F.col("top.size")).alias("cp"), F.greatest(F.lit(1), coarse(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"))).alias("cq"),
            (load(F.col("top.n"), F.col("top.size")) <= 1).alias("lp"), (load(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")) <= 1).alias("lq"),
        )
    )
    filled = deal.where("small").agg(F.sum("load")).first()[0] or 0.0
    bundles = max(1, int(2 * filled) + 1)
    # rows are dealt by a hash into parts of some COARSE blocks, and by running sums into blocks within these
    h = F.xxhash64("id")
    main = (F.col("comp") == F.col("main")) & ~F.col("small")
    w = Window.partitionBy("cluster", "side", "coarse", "apart").orderBy(h, "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_skewed(light, deal.drop("load"), ["cluster"], light.count()).withColumn("side", F.when(main, 0).otherwise(1))
    placed = placed.withColumn("coarse", F.pmod(h, F.when(main, F.col("cp")).otherwise(F.col("cq"))))
    # what fits in one block needs no sum: its rows have the place 0 each by itself, and don't meet in one task
    placed = placed.withColumn("apart", F.when(F.col("small") | F.when(main, F.col("lp")).otherwise(F.col("lq")), h))
    at = F.when(F.col("apart").isNull(), F.floor(F.coalesce(F.sum(load(F.col("n"), F.col("size"))).over(w), F.lit(0.0)))).otherwise(0).cast("int")
    placed = stored(graph.gathered(placed.withColumn("place", at).select("cluster", "small", "side", "coarse", "place", "id"), total))
    parts = placed.groupBy("cluster", "side", "coarse").agg((F.max("place") + 1).alias("blocks"))
    v = Window.partitionBy("cluster")
    parts = parts.select("cluster", "side", "coarse", F.coalesce(F.sum("blocks").over(v.orderBy("side", "coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"), F.sum(F.col("blocks") * (1 - F.col("side"))).over(v).alias("p"), F.sum(F.col("blocks") * F.col("side")).over(v).alias("q"))
    own = stored(placed.join(parts, ["cluster", "side", "coarse"]).select("id", "small", (F.col("off") + F.col("place")).cast("int").alias("own"), F.col("p").cast("int").alias("p"), F.col("q").cast("int").alias("q")))
    drop_stored(light, deal, placed)
    others = F.when(F.col("q") > 0, F.sequence(F.col("p"), F.col("p") + F.col("q") - 1)).otherwise(F.array().cast("array<int>"))
    return (
        rows.join(own, "id")
        .withColumn("other", F.explode(F.when((F.col("own") < F.col("p")) | (F.col("p") == 0), others).otherwise(F.concat(F.sequence(F.lit(0), F.col("p") - 1), others))))
        .withColumn("bundle", F.when(F.col("small"), -1 - F.pmod(F.xxhash64("cluster"), F.lit(bundles))).otherwise(F.col("cluster")))
        .select("bundle", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", "keys", "text")
    )


def new_links(t: pa.Table) -> list[tuple[int, int]]:
    """Confirmed links between components of a table (own, i, j, id, comp, keys, text) of two blocks."""
    ids, own = t.column("id").to_numpy(), t.column("own").to_numpy()
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    _, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
    root = np.arange(comp.max() + 1)
    if len(root) < 2:
        return []
    keys = t.column("keys").combine_chunks()
    flat, of = keys.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(keys.offsets.to_numpy()))
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    raw, at = text_buffer(t.column("text"))
    parts, sizes = [], []
    for x, y in slices(at):
        sets, ends = shingle_sets(raw[at[x] : at[y]], at[x : y + 1] - at[x])
        parts.append(sets)
        sizes.append(np.diff(ends))
    n = np.concatenate(sizes)
    _, shingle = np.unique(np.concatenate(parts), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(int(shingle.max()) + 1, bool)
    out = []
    ask = np.flatnonzero(own == j)
    mine = keys.offsets.to_numpy()
    values = keys.flatten().to_numpy()
    for x in ask:
        k = values[mine[x] : mine[x + 1]]
        lo, hi = np.searchsorted(flat, k, "left"), np.searchsorted(flat, k, "right")
        near = np.unique(np.concatenate([of[a:b] for a, b in zip(lo, hi)]))
        near = near[(own[near] == i) if i != j else near > x]
        near = near[(root[comp[near]] != root[comp[x]]) & (100 * np.minimum(n[near], n[x]) >= SIMILAR * np.maximum(n[near], n[x]))]
        if not len(near):
            continue
        held = shingle[begin[x] : begin[x + 1]]
        mark[held] = True
        for part in np.array_split(near, int(n[near].sum()) // 2_000_000 + 1):
            place = np.repeat(begin[part], n[part]) + np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            common = np.add.reduceat(mark[shingle[place]].astype(np.int64), np.cumsum(n[part]) - n[part])
            for y in part[100 * common >= SIMILAR * (n[part] + n[x] - common)]:
                if root[comp[y]] != root[comp[x]]:
                    out.append((int(ids[x]), int(ids[y])))
                    root[root == root[comp[y]]] = root[comp[x]]
        mark[held] = False
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that near_duplicates() keeps, with all their columns. Documents with a null id stay."""
    dropped = stored(near_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("_dropped")).distinct())
    hit = bloom_filter(dropped.select(F.col("_dropped").alias("id")))(F.col(id_col).cast("long"))
    rest = docs.where(hit).join(dropped, F.col(id_col).cast("long") == F.col("_dropped"), "left_anti")
    return docs.where(~hit).unionByName(rest)
