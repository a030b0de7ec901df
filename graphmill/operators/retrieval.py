"""Full-text, vector and fused search."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.columns import ascii_lower, structural_text

K1, B = 1.2, 0.75
ROOT = 60


def _folding() -> tuple[str, str]:
    """Latin letters with marks, and the letters without them."""
    pairs = [(chr(c), d) for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c))[0]) != chr(c) and d.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folding()
_MARKS = str.maketrans(MARKED, PLAIN)


def tokens(c: Column | str) -> Column:
    """Words of letters and digits in lower case, without marks on Latin letters, as an array; anything else
    separates."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(F.translate(F.regexp_replace(c, r"[\u0300-\u036F]", ""), MARKED, PLAIN)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_tokens(text: str) -> list[str]:
    plain = re.sub("[\u0300-\u036f]", "", text).translate(_MARKS).lower()
    return [t for t in re.split(r"[\W_]+", plain) if t]


def postings(docs: DataFrame, columns: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(term, key, positions) and (key, len) of documents: what bm25_from needs, made once for all queries.
    Columns follow one another with a gap, so that no phrase reaches from one into the next."""
    words = F.concat(*[x for c in columns for x in (tokens(F.coalesce(c, F.lit(""))), F.array(F.lit("")))])
    flat = docs.select(key, F.posexplode(words).alias("pos", "term"))
    length = docs.select(key, sum((F.size(tokens(F.coalesce(c, F.lit("")))) for c in columns), F.lit(0)).alias("len"))
    return flat.where("term <> ''").groupBy("term", key).agg(F.array_sort(F.collect_list("pos")).alias("positions")), length


def bm25_from(terms: DataFrame, lengths: DataFrame, query: str, key: str = "id", limit: int | None = 20) -> DataFrame:
    """bm25() over postings: only the rows of the query's terms are read, which Parquet that is sorted by term
    prunes; a phrase's places come from its terms' positions."""
    want = query_tokens(query)
    if not want:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    hits = None
    for k, term in enumerate(want):
        own = terms.where(F.col("term") == term).select(key, F.transform("positions", lambda p: p - k).alias(f"p{k}"))
        hits = own if hits is None else hits.join(own, key)
    places = F.col("p0")
    for k in range(1, len(want)):
        places = F.array_intersect(places, F.col(f"p{k}"))
    found = hits.select(key, F.size(places).alias("f")).where("f > 0")
    total = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    df = found.agg(F.count("*").alias("df"))
    return _scored(found.join(lengths, key).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(df)), key, limit)  # one row each


def bm25_score(n: Column, df: Column, f: Column, length: Column, avg: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    return -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / avg))


def _scored(rows: DataFrame, key: str, limit: int | None) -> DataFrame:
    out = rows.select(key, bm25_score(*(F.col(c) for c in ("n", "df", "f", "len", "avg"))).alias("score"))
    return out.orderBy("score", key).limit(limit) if limit else out


def documents(symbols: DataFrame) -> DataFrame:
    """(id, name, signature, kind): a symbol's searchable text."""
    text = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("resolved_type_signature", "resolved_return_type", "signature", "name")])
    return symbols.select("id", "name", text.alias("signature"), "kind")


def refreshed(index: DataFrame, current: DataFrame, gone: DataFrame) -> DataFrame:
    """index without the ids of current and gone, and with current."""
    ids = current.select("id").unionByName(gone.select("id")).distinct()
    return index.join(ids, "id", "left_anti").unionByName(current)


def bm25(docs: DataFrame, query: str, columns: list[str], key: str = "id", limit: int | None = 20) -> DataFrame:
    """(key, score): the query as one phrase, over all columns together; scores are negative, best first.

    One scan tokenises in the JVM and counts the phrase; only key, length and count are kept, and the corpus
    numbers are one aggregated row."""
    want = query_tokens(query)
    if not want:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    length, hits = F.lit(0), F.lit(0)
    for c in columns:
        t = tokens(F.coalesce(c, F.lit("")))
        length = length + F.size(t)
        if len(want) == 1:
            hits = hits + F.size(F.filter(t, lambda x: x == want[0]))
        else:
            joined = F.concat(F.lit(" "), F.array_join(t, "  "), F.lit(" "))
            phrase = " " + "  ".join(want) + " "
            hits = hits + ((F.length(joined) - F.length(F.replace(joined, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")
    own = docs.select(key, length.alias("len"), hits.alias("f"))
    total = own.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), F.sum((F.col("f") > 0).cast("int")).alias("df"))
    return _scored(own.where("f > 0").crossJoin(F.broadcast(total)), key, limit)  # total: one row


def prefix_fallback(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in query)
    return symbols.where(ascii_lower("name").startswith(low)).select("id", F.lit(0.0).alias("score")).orderBy("id").limit(limit)


def squared_distance(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], key: str = "id", column: str = "embedding", limit: int = 20, metric: str = "l2", most: float | None = None) -> DataFrame:
    """(key, distance) of the nearest vectors, ties by key. Filters belong before it: the search is exact.

    Runs in the JVM and ends in a top-k that each task cuts first."""
    if metric == "l2":
        d = F.sqrt(squared_distance(F.col(column), query))
    else:
        q = F.array(*[F.lit(float(x)) for x in query])
        dot = F.aggregate(F.zip_with(column, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        d = 1 - F.try_divide(dot, norm * F.lit(math.sqrt(sum(x * x for x in query))))
    out = vectors.where(F.col(column).isNotNull() & (F.size(column) == len(query))).select(key, d.alias("distance")).where("distance is not null")
    if most is not None:
        out = out.where(F.col("distance") <= most)
    return out.orderBy("distance", key).limit(limit)


def fused(first: DataFrame, second: DataFrame, key: str = "id", order_first: str = "score", order_second: str = "distance", limit: int = 20, k: int = ROOT) -> DataFrame:
    """Reciprocal rank fusion of two short lists: (key, score), ties to the first list, then its rank. The
    lists are top-k results, so ranking each in one task is bounded by k."""

    def ranked(df: DataFrame, order: str, which: int) -> DataFrame:
        w = Window.orderBy(order, key)
        return df.select(key, F.row_number().over(w).alias("r"), F.lit(which).alias("l"))

    both = ranked(first, order_first, 0).unionByName(ranked(second, order_second, 1))
    return both.groupBy(key).agg(F.sum(F.lit(1.0) / (k + F.col("r"))).alias("score"), F.min(F.struct("l", "r")).alias("_o")).orderBy(F.desc("score"), "_o", key).limit(limit).select(key, "score")


def preferred(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the first, then those of the second whose key it does not have; `place` keeps the order."""
    return first.withColumn("place", F.lit(0)).unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns).withColumn("place", F.lit(1)))


class HashingProvider:
    """A deterministic embedding without a model: hashed words, at length one. For tests and offline use."""

    def __init__(self, dims: int = 64):
        self.dims, self.model = dims, f"hashing-{dims}"

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            for w in query_tokens(unicodedata.normalize("NFKC", t)):
                h = zlib.crc32(w.encode())
                out[i, h % self.dims] += 1 if h & 0x10000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def batches_by_tokens(sizes: list[int], most_tokens: int = 32_768, most_items: int = 512) -> list[tuple[int, int]]:
    """Greedy runs of items under both bounds; an item over the bound is a run of its own."""
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and (total + n > most_tokens or i - at >= most_items):
            out.append((at, i))
            at, total = i, 0
        total += n
    return [*out, (at, len(sizes))] if sizes else out


def embedded(texts: DataFrame, provider, known: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(key, embedding, content_hash) of texts (key, text): known rows whose hash is the same stay, the others
    are computed by the provider in token-bounded batches on the executors."""
    hashed = texts.where("text <> ''").select(key, "text", F.sha2("text", 256).alias("content_hash"))
    todo = hashed.join(known.select(key, "content_hash"), [key, "content_hash"], "left_anti") if known is not None else hashed
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            text = b.column(1).to_pylist()
            vectors = [provider.embed(text[i:j]) for i, j in batches_by_tokens([-(-len(t) // 4) for t in text])]
            flat = np.concatenate(vectors) if vectors else np.zeros((0, provider.dims), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(flat), pa.list_(pa.float32())), b.column(2)], names=[key, "embedding", "content_hash"])

    new = todo.select(key, "text", "content_hash").mapInArrow(run, f"{key} {kind}, embedding array<float>, content_hash string")
    if known is None:
        return new
    same = known.join(hashed.select(key, "content_hash"), [key, "content_hash"], "left_semi").select(key, "embedding", "content_hash")
    return same.unionByName(new)


def symbol_texts(symbols: DataFrame) -> DataFrame:
    """(id, text) of symbols that have any signature or type."""
    some = F.coalesce("signature", "resolved_type_signature", "resolved_return_type").isNotNull()
    return symbols.where(some).select("id", structural_text("signature", "resolved_type_signature", "resolved_return_type", "name").alias("text"))


def commit_texts(commits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(sha, text) of commits whose message is not blank and which have no vector yet."""
    own = commits.where(F.trim("message", F.lit(" \t\r\n")) != "").select("sha", F.col("message").alias("text"))
    return own if known is None else own.join(known.select("sha"), "sha", "left_anti")


class QueryCache:
    """Embeddings of recent queries, bounded in number and age."""

    def __init__(self, embed: Callable[[str], list[float]], clock: Callable[[], float], most: int = 1000, age: float = 3600):
        self.embed, self.clock, self.most, self.age = embed, clock, most, age
        self.kept: OrderedDict[str, tuple[float, list[float]]] = OrderedDict()

    def __call__(self, text: str) -> list[float]:
        now = self.clock()
        hit = self.kept.pop(text, None)
        if hit is None or now - hit[0] > self.age:
            hit = (now, self.embed(text))
        self.kept[text] = hit
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return hit[1]


def search(docs: DataFrame, vectors: DataFrame | None, query: str, vector: list[float] | None, mode: str = "structural", limit: int = 20, index=None) -> tuple[DataFrame, str]:
    """Results (id, score) and the mode used: without vectors, semantic and fused fall back to structural. index:
    a FullText of the documents, which is read in place of them; docs then say which of its ids may be found."""
    text = bm25(docs, query, ["name", "signature", "kind"], limit=limit) if index is None else index.search(query, limit, docs)
    if mode == "structural" or vectors is None or vector is None:
        return text, "structural" if mode == "structural" else f"structural (fallback from {mode})"
    near = nearest(vectors, vector, limit=limit)
    if mode == "semantic":
        return near.withColumnRenamed("distance", "score"), "semantic"
    return fused(text, near, limit=limit), "fused"
