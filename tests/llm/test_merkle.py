import zlib
from hashlib import sha256

import duckdb
import pytest

from graphmill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, digest string"


def h(s):
    return sha256(s.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, text):
    return h("".join(field(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def climb(nodes):
    """The last node, and for each node its siblings and its steps (digests before and after)."""
    ways = [[] for _ in nodes]
    of = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, members = [], []
        for s in range(0, len(nodes), 16):
            run = nodes[s : s + 16]
            for k in range(len(run)):
                for i in of[s + k]:
                    ways[i].append((run[:k], run[k + 1 :]))
            up.append(h("".join(run)))
            members.append([i for g in of[s : s + 16] for i in g])
        nodes, of = up, members
    return nodes[0], ways


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((own, *climb([leaf(r, r["text"]) for r in own])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (own, sub, ways), top in zip(trees, tops):
        for r, way in zip(own, ways):
            one, text = leaf(r, r["text"]), r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            x = leaf(r, text)
            for a, b in way + top:
                x = h("".join(a) + x + "".join(b))
            out.append((r["doc_id"], one, sub, root, h("".join("".join(a + b) for a, b in way + top)), x, x == root))
    return sorted(out, key=str)


def table(n, sources):
    return [dict(doc_id=i * 7 % n, text=f"Text {i} É", lang="en", source=sources[i % len(sources)], n_chars=i, grp="g", digest="d") for i in range(n)]


def odd():
    """Nulls in each column, repeated rows, ids of several rows, one-row sources, a very long text."""
    rows = table(320, ["a", "a", "a", None, "Z", "é", ""]) + table(300, ["a"])[:290]
    rows += [dict(rows[3]), dict(rows[3]), dict(rows[40], text=None), dict(rows[41], lang=None), dict(rows[42], n_chars=None)]
    rows += [dict(rows[0], doc_id=None, text=t) for t in ("X", "Y", None, "X")] + [dict(rows[0], source=f"s{k}") for k in range(20)]
    return [*rows, dict(rows[0], doc_id=10**12, text="Long TEXT " * 300_000, source="only")]


@pytest.mark.parametrize("rows", [odd(), table(1, ["a"]), table(16, ["a"]), table(17, [None]), table(273, ["a", "b"])], ids=["odd", "1", "16", "17", "273"])
def test_audit_equals_brute_force_and_sql(spark, rows):
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars", "grp", "digest")) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in merkle.Manifest(docs).audit().collect()), key=str)
    want = brute(rows)
    assert got == want
    assert len(rows) < 100 or {r[6] for r in want} == {True, False}
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(db.execute(f"SELECT {', '.join(names)} FROM ({merkle.audit_sql()})").fetchall(), key=str) == want


def test_proofs_lead_to_the_root_and_an_empty_table_has_none(spark):
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars", "grp", "digest")) for r in table(300, ["a", "a", "b"])], SCHEMA)
    m = merkle.Manifest(docs)
    rows = m.proofs().collect()
    assert len(rows) == 300 and {merkle.folded(r.leaf, r.siblings.encode(), r["shape"]) for r in rows} == {m.root().first().root}
    assert sorted(r.source for r in m.subroots().collect()) == ["a", "b"]
    bare = merkle.Manifest(docs.limit(0))
    assert bare.audit().collect() == [] == bare.proofs().collect() == bare.root().collect()
