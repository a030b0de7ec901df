import random
import re
from itertools import combinations

import pytest

from graphmill.llm import minhash

SCHEMA = "doc_id long, text string, lang string, component_id string, id int"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations([(d, s) for (d, _), s in zip(rows, sets) if d is not None and s], 2):
        n = len(a & b)
        if i == j or 100 * n >= 75 * (len(a) + len(b) - n):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    out = []
    for (i, _), s in zip(rows, sets):
        c = None if i is None else find(i) if s else i
        out.append((i, len(s), c, c is None or c == i))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in minhash.near_duplicates(df).collect()], key=str)


def words(r, n, vocab=400):
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def test_edges_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "one two"), (7, "a b c d e"), (7, "a b c d e"), (8, "x" * 200_000), (9, "É a b c d"), (10, "é a b c d")]
    assert run(spark, rows) == brute(rows)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_groups_chains_and_near_misses(spark):
    r = random.Random(3)
    rows, k = [], 0
    for _ in range(12):
        base = words(r, r.randint(30, 200))
        for c in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
            rows.append((k := k + 1, " ".join(w)))
    chain = words(r, 120)
    for _ in range(25):  # each is near the one before, the ends are apart
        rows.append((k := k + 1, " ".join(chain)))
        chain = chain[4:] + words(r, 4, 9999)
    shared = words(r, 60)  # a passage in many documents that are not near
    rows += [((k := k + 1), " ".join(shared + words(r, 30, 99999))) for _ in range(60)]
    r.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_small_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 0)
    test_groups_chains_and_near_misses(spark)


def test_groups_of_the_exact_rest_are_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(minhash, "BLOCK_BYTES", 20_000)
    r = random.Random(4)
    shared = words(r, 60)
    rows = [(k, " ".join(shared + words(r, 500, 99999))) for k in range(60)]  # few but large
    rows += [(1000 + k, " ".join(words(random.Random(k // 3), 30, 9999) + words(r, 8, 9999))) for k in range(300)]  # many small
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands = docs.select(F.col("doc_id").alias("id"), F.explode(F.when(F.col("doc_id") < 1000, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.floor((F.col("doc_id") - 1000) / 3) + 10))).alias("key")).select("key", "id", F.lit(1).alias("deg"))
    dealt = minhash.dealt_out(bands, None, docs, bands.count(), "doc_id", "text")
    size = dealt.groupBy("bundle", "i", "j").agg(F.sum(F.octet_length("text")).alias("b"), F.countDistinct("cluster").alias("c"))
    most = size.agg(F.max("b"), F.max("c"), F.count("*")).first()
    assert most[0] < 2 * minhash.BLOCK_BYTES and most[1] > 1 and most[2] > 20
    # every two documents of a cluster meet
    met = {(x.a, x.b) for x in dealt.alias("x").join(dealt.alias("y"), ["bundle", "i", "j", "cluster"]).where("x.id < y.id and (x.own <> y.own or x.i = x.j)").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()}
    assert met >= {(a, b) for a in range(60) for b in range(a + 1, 60)} and met >= {(1000 + k, 1001 + k) for k in range(0, 300, 3)}


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    from graphmill.llm import common

    left = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(6000)] + [(None, -1), (99, -2)], "k long, v long")
    right = left.where("k < 50").groupBy("k").count().withColumnRenamed("count", "m")
    plain = lambda how: sorted(map(str, left.join(right, "k", how).select("k", "v", "m").collect()))
    for how in ("inner", "left"):
        assert sorted(map(str, common.join_skewed(left, right, ["k"], 6000, how=how).select("k", "v", "m").collect())) == plain(how)


def test_kept_documents(spark):
    rows = [(1, "a b c d e f g", "en"), (2, "a b c d e f g", "fr"), (3, "other words stand here alone", "en"), (None, "a b c d e f g", None), (4, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(str, (r.doc_id for r in minhash.one_of_each(df).collect()))) == ["1", "3", "4", "None"]


@pytest.mark.parametrize("seed", [1, 2])
def test_sets_and_signatures(seed):
    import numpy as np

    r = random.Random(seed)
    texts = ["", "A b", *(" ".join(words(r, r.randint(1, 40), 8)) + r.choice(["", " ", "\n"]) for _ in range(50)), ""]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    sets, of = minhash.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), at)
    assert np.diff(of).tolist() == [len(shingles(t)) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        both = set(sets[of[i] : of[i + 1]].tolist()) & set(sets[of[j] : of[j + 1]].tolist())
        assert len(both) == len(shingles(texts[i]) & shingles(texts[j]))
