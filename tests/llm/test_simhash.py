import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphmill.llm import simhash

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """pairs (id, fingerprint) -> {id: smallest reachable id}."""
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(pairs, 2):
        if bin(x ^ y).count("1") <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_every_pair_within_three_bits_meets_in_a_quad():
    for c in combinations(range(8), 5):
        assert any(set(q) <= set(c) for q in simhash.QUADS)


def test_fingerprints_equal_the_definition_and_sparks_xxh64(spark):
    texts = ["", None, " \t\n", "One", "ONE two", "a b c", "Äpfel ÄPFEL x Z", "a b c d " * 50, "a\x0bb\x0cc\x1cd e", "w " * 70000]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    one = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert got[5] == one % (1 << 64)


def crowd(rng, n):
    """Fingerprints with chains and groups a few bits apart."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(4 * n):
        x = rng.choice(out)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 5])):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("pairwise, hot", [(1024, 2000), (8, 2000), (8, 10), (1024, 10)])
def test_components_equal_brute_force(spark, monkeypatch, pairwise, hot):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(simhash, "LEAST_HOT", hot)
    monkeypatch.setattr(simhash, "HOT_SHARE", 10**6)
    rng = random.Random(pairwise + hot)
    fps = list(dict.fromkeys(crowd(rng, 40) + [(0xABCD << 48) | rng.getrandbits(10) << 20 | rng.getrandbits(5) for _ in range(150)]))
    pairs = list(enumerate(fps))
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in pairs], "fp long, rep long")
    found = simhash.links(simhash.postings(classes)).collect()
    by = dict(pairs)
    want = brute_components(pairs)
    root = {i: i for i in by}
    for _ in range(len(by)):
        for r in found:
            root[r.a] = root[r.b] = min(root[r.a], root[r.b])
    assert root == want
    assert len(found) < 14 * len(by) * 4


def test_tables_of_free_bits_unite_what_pairs_unite():
    rng = np.random.default_rng(3)
    near = simhash.Neighbours()
    for n in (2, 50, 3000):
        fp = np.unique(rng.integers(0, 1 << 24, n).astype(np.int64) & ~np.int64(0xFF00 if n == 50 else 0))
        a, b = np.arange(len(fp)), np.arange(len(fp))
        simhash.tally(fp.astype(np.uint64), a)
        near.unite(fp, np.arange(len(fp)), b)
        assert np.array_equal(a, b)


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base + " end"), (9, base), (7, None), (8, ""), (2, " \n"), (11, "quite different words here"), (None, base), (None, None),
            (20, "alpha beta gamma delta"), (20, base), (20, base), (21, "alpha beta gamma delta"), (30, base.upper())]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], SCHEMA + ", fp string, component_id long")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    known = [(i, brute_fingerprint(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in known}
    for _ in known:
        for (a, x), (b, y) in combinations(known, 2):
            if bin(x ^ y).count("1") <= 3 or a == b:
                root[a] = root[b] = min(root[a], root[b])
    want = sorted(((i, format(brute_fingerprint(t), "016x"), root.get(i)) for i, t in rows), key=str)
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
