import numpy as np

from graphmill.operators.knn import nearest_of_each


def brute(vectors, queries, limit):
    out = []
    for q, v in queries:
        got = sorted((float(np.linalg.norm(np.array(x) - np.array(v))), k) for k, x in vectors if k != q)[:limit]
        out += [(q, n + 1, k, round(d, 9)) for n, (d, k) in enumerate(got)]
    return sorted(out)


def rows(df):
    return sorted((r.query, r.rank, r.key, round(r.distance, 9)) for r in df.collect())


def test_clustered_vectors_like_brute_force(spark, monkeypatch):
    from graphmill.operators import knn

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 10, (12, 8))
    at = np.concatenate([centres[i % 12] + rng.normal(0, 0.5, 8) for i in range(1200)]).reshape(1200, 8)
    at[1100:1110] = at[0]  # ties
    vectors = [(i, x.tolist()) for i, x in enumerate(at)]
    queries = [vectors[i] for i in range(0, 1200, 40)] + [(-5, [100.0] * 8)]
    df = lambda r: spark.createDataFrame(r, "id long, embedding array<double>")
    best, looked = nearest_of_each(df(vectors), df(queries), limit=6)
    want = brute(vectors, queries, 6)
    assert rows(best) == want
    n = {r.query: r.looked for r in looked.collect()}
    assert set(n) == {q for q, _ in queries} and sum(n.values()) < 0.5 * len(queries) * len(vectors)
    # small blocks give the same
    monkeypatch.setattr(knn, "BLOCK_VECTORS", 50)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 3)
    assert rows(nearest_of_each(df(vectors), df(queries), limit=6, pivots=5)[0]) == want


def test_few_odd_and_no_vectors(spark):
    df = lambda r: spark.createDataFrame(r, "id long, embedding array<double>")
    odd = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [0.0, 1.0])]
    got = rows(nearest_of_each(df(odd), df(odd), limit=5)[0])
    assert got == brute([odd[0], odd[1], odd[7]], [odd[0], odd[1], odd[7]], 5)
    assert nearest_of_each(df([]), df([]), limit=5)[0].collect() == [] == nearest_of_each(df([]), df(odd), limit=5)[0].collect()
    assert nearest_of_each(df(odd), df([]), limit=5)[0].collect() == []
