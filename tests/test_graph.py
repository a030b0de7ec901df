import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from graphmill.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def plain_scc(n, pairs):
    out = {i: set() for i in range(n)}
    for a, b in pairs:
        out[a].add(b)

    def reach(x):
        seen, todo = set(), deque(out[x])
        while todo:
            y = todo.popleft()
            if y not in seen:
                seen.add(y)
                todo += out[y]
        return seen

    r = {i: reach(i) for i in range(n)}
    return {i: min({i} | {j for j in r[i] if i in r[j]}) for i in range(n) if i in r[i]}


@pytest.mark.parametrize("hub", [0, 2500])
def test_components_of_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(G, "HUB_LEAST", 50)
    around = [x for x in range(2500 + 1) if x != hub]  # the hub is the smallest or the largest node
    pairs = [(hub, x) for x in around] + [(3000 + x, x) for x in range(1, 300)] + [(5000 + x, 5001 + x) for x in range(5)]
    want = {x: 0 for x in range(2501)} | {3000 + x: 0 for x in range(1, 300)} | {5000 + x: 5000 for x in range(6)}
    assert dict(G.components(edges(spark, pairs)).collect()) == want


def test_components_of_hubs_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_EDGES", 0)
    test_components_of_hubs(spark, monkeypatch, 2500)


def test_a_round_of_few_edges_is_a_handful_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(spark, "_rounds", [], raising=False)
    keep = G.stored
    monkeypatch.setattr(G, "stored", lambda df: spark._rounds.append(df.rdd.getNumPartitions()) or keep(df))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = dict(G.components(edges(spark, [(x, x + 1) for x in range(20)])).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {x: 0 for x in range(21)}
    assert max(spark._rounds[1:]) <= G.FEW_PARTITIONS


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 40
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(45)]
    want = plain_scc(n, pairs)
    assert dict(G.strong_components(edges(spark, pairs)).collect()) == want


def test_strong_components_distributed(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (5, 7), (8, 1)]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert dict(G.strong_components(edges(spark, pairs), driver_edges=0).collect()) == want


@pytest.mark.parametrize("seed", [4, 5])
def test_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    up = {x: x for e in pairs for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert dict(G.components(edges(spark, pairs)).collect()) == {x: find(x) for x in up}


def test_reach_reports_a_seed_on_a_cycle(spark):
    seed = spark.createDataFrame([(1,)], "node long")
    got = sorted(tuple(r) for r in G.reach(edges(spark, [(1, 2), (2, 1), (2, 3)]), seed, 3).collect())
    assert got == [(1, 0), (1, 2), (2, 1), (2, 3), (3, 2)]


def test_shortest_path(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)])
    assert G.shortest_path(e, 1, 5, 5) == [1, 2, 4, 5]
    assert G.shortest_path(e, 5, 1, 5) == [] and G.shortest_path(e, 1, 5, 2) == []
    assert G.shortest_path(e, 2, 2, 5) == [2]


def test_trace_is_preorder_by_line(spark):
    e = spark.createDataFrame([(1, 3, 5, "m"), (1, 2, 1, "m"), (2, 4, 1, "m"), (4, 1, 1, "m"), (3, 5, 0, "m"), (5, 6, 0, "m")], "src long, dst long, line int, method string")
    steps, truncated = G.trace(e, 1, 2)
    assert [(s["symbol_id"], s["depth"], s["call_line"]) for s in steps] == [(1, 0, None), (2, 1, 2), (4, 2, 2), (3, 1, 6), (5, 2, 1)]
    assert truncated


def test_topological_levels_leave_cycles_out(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    got = dict(G.topological_levels(nodes, edges(spark, [(1, 2), (2, 3), (4, 5), (5, 4), (6, 4)])).collect())
    assert got == {3: 0, 2: 1, 1: 2}


def test_clusters(spark):
    s = spark.createDataFrame([(1, 1, 100), (2, 1, 100), (3, 2, 450), (4, 3, 10), (5, 4, 200)], "id long, file_id long, lines int")
    got = G.clusters(s, edges(spark, [(1, 2), (4, 1), (5, 3)]))
    assert [(c["symbol_ids"], c["total_lines"]) for c in got] == [([3], 450), ([1, 2, 4], 210), ([5], 200)]


def plain_clusters(rows, links, most_lines=500, least_lines=30):
    """The greedy order, one join after another."""
    rows = sorted(rows)
    known = {i for i, _, _ in rows}
    links = sorted(e for e in links if e[0] in known and e[1] in known)
    cycle = G.tarjan(links) if links else {}
    group = G.Union()
    lines: Counter = Counter()
    start = {i: cycle.get(i, i) for i, _, _ in rows}
    for i, _, n in rows:
        lines[start[i]] += n

    def join(a: int, b: int) -> bool:
        a, b = group.find(a), group.find(b)
        if a == b or lines[a] + lines[b] > most_lines:
            return False
        a, b = min(a, b), max(a, b)
        group.up[b] = a
        lines[a] += lines.pop(b)
        return True

    by_file: dict[int, list[int]] = defaultdict(list)
    for i, f, _ in rows:
        by_file[f].append(start[i])
    for f in sorted(by_file):
        for other in dict.fromkeys(by_file[f]):
            join(by_file[f][0], other)
    weight: Counter = Counter()
    for a, b in links:
        a, b = group.find(start[a]), group.find(start[b])
        if a != b:
            weight[min(a, b), max(a, b)] += 1
    for (a, b), _ in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
        join(a, b)
    for root in sorted({group.find(start[i]) for i, _, _ in rows}):
        if group.find(root) != root or lines[root] >= least_lines:
            continue
        near: dict[int, int] = {}
        for a, b in links:
            a, b = group.find(start[a]), group.find(start[b])
            for x, y in ((a, b), (b, a)):
                if x == root and y != root and lines[x] + lines[y] <= most_lines:
                    near[y] = weight.get((min(x, y), max(x, y)), 1)  # weights are those before folding
        if near:
            join(root, min(near, key=lambda y: (-near[y], y)))
    members: dict[int, list] = defaultdict(list)
    for i, f, n in rows:
        members[group.find(start[i])].append((i, f, n))
    of = {i: r for r, m in members.items() for i, _, _ in m}
    inside: Counter = Counter()
    across: Counter = Counter()
    for a, b in links:
        if of[a] == of[b]:
            inside[of[a]] += 1
        else:
            across[of[a]] += 1
            across[of[b]] += 1
    out = [{"symbol_ids": [i for i, _, _ in m], "file_ids": sorted({f for _, f, _ in m}), "total_lines": sum(n for _, _, n in m), "internal_edges": inside[r], "external_edges": across[r]} for r, m in members.items()]
    return [{"id": k, **c} for k, c in enumerate(sorted(out, key=lambda c: (-c["total_lines"], c["symbol_ids"][0])))]


@pytest.mark.parametrize("seed,driver_edges", [(1, 0), (2, 0), (5, 5), (6, 10_000)])
def test_clusters_in_rounds_like_the_greedy_order(spark, seed, driver_edges):
    r = random.Random(seed)
    n = 120
    rows = [(i, r.randrange(n // 3), r.choice([2, 8, 20, 40, 90])) for i in range(n)]
    links = [(r.randrange(n + 5), r.randrange(n + 5)) for _ in range(150)] + [(1, 2)] * 3
    s = spark.createDataFrame(rows, "id long, file_id long, lines int")
    assert G.clusters(s, edges(spark, links), 200, 30, driver_edges) == plain_clusters(rows, links, 200, 30)


def test_all_symbols_are_clustered(spark):
    from graphmill import catalog

    d = "/root/testdata/sf0.001"
    got = catalog.QUERIES["clusters"](spark, d)
    assert got.agg({"symbols": "sum"}).first()[0] == catalog.A.symbols(spark, d).count()


def test_directory_cycles_and_layers(spark):
    g = spark.createDataFrame([("a", "b", 3, ["x"]), ("b", "a", 1, ["y"]), ("b", "c", 2, ["z"])], "from_dir string, to_dir string, count long, sample_files array<string>")
    assert G.directory_cycles(g) == [{"directories": ["a", "b"], "edge_count": 4}]
    v = G.layer_violations(g)
    assert [(x["from_dir"], x["to_dir"]) for x in v] == [("b", "a")]


def test_empty_graphs(spark):
    e = edges(spark, [])
    assert G.components(e).collect() == [] and G.strong_components(e).collect() == []


def test_rounds_of_strong_components_grow_slowly_with_the_way(spark):
    n = 150
    k = F.col("id")
    ring = spark.range(n).select((k * 7919 % n).alias("src"), ((k + 1) % n * 7919 % n).alias("dst"))
    rounds = []
    got = G.strong_components(ring, 0, rounds)
    assert got.count() == n and got.where("component = 0").count() == n and len(rounds) < 20


def test_levels_of_chains_trees_and_random_graphs(spark):
    k = F.col("id")
    n = 3000
    chain = spark.range(1, n).select((k * 7 % n).alias("src"), ((k - 1) * 7 % n).alias("dst"))  # a chain in a mixed order
    rounds = []
    got = G.topological_levels(spark.range(n).select(k.alias("node")), chain, rounds)
    assert got.where(f"node = level * 7 % {n}").count() == n and len(rounds) < 25
    r = random.Random(8)
    pairs = [(a, r.randrange(a)) for a in range(1, 40)] + [tuple(sorted(r.sample(range(40), 2), reverse=True)) for _ in range(15)] + [(50, 51), (51, 50), (52, 51), (53, 52), (53, 3), (54, 54)]
    deps = defaultdict(set)
    for a, b in pairs:
        deps[a].add(b)
    want = {}
    for a in range(40):
        want[a] = 1 + max((want[b] for b in deps[a]), default=-1)
    nodes = spark.createDataFrame([(i,) for i in [*range(40), *range(50, 55)]], "node long")
    assert dict(map(tuple, G.topological_levels(nodes, edges(spark, pairs)).collect())) == want


def test_directory_cycles_are_not_gathered_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(G, "DRIVER_EDGES", 10)
    k = F.col("id").cast("string")
    pair = lambda a, b, n: F.struct(F.concat(F.lit(a), k).alias("from_dir"), F.concat(F.lit(b), k).alias("to_dir"), n.cast("long").alias("count"))
    g = spark.range(20).select(F.explode(F.array(pair("a", "b", F.lit(1)), pair("b", "a", F.col("id")), pair("b", "c", F.lit(100)), pair("d", "d", F.lit(3)))).alias("x")).select("x.*")
    got = G.directory_cycles(g, 22)
    assert got[:2] == [{"directories": ["a19", "b19"], "edge_count": 20}, {"directories": ["a18", "b18"], "edge_count": 19}]
    assert [c["directories"] for c in got[-5:]] == [["a2", "b2"], ["d0"], ["d1"], ["d10"], ["d11"]] and {c["edge_count"] for c in got[-5:]} == {3}


def test_labels_of_many_nodes_are_not_broadcast(spark, monkeypatch):
    e = spark.range(20).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    least = e.select("a", F.col("b").alias("m"), F.lit(1).alias("n"))
    plan = lambda edges: G._with_least(e, least, 10, edges)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(G.BROADCAST_EDGES + 1) and "SortMergeJoin" not in plan(20)
    monkeypatch.setattr(G, "BROADCAST_EDGES", 0)
    ring = spark.range(40).select(F.col("id").alias("src"), F.when(F.col("id") % 4 < 3, F.col("id") + 1).otherwise(F.col("id") - 3).alias("dst"))
    got = {r.node: r.component for r in G.strong_components(ring, driver_edges=0).collect()}
    assert got == {k: k - k % 4 for k in range(40)}


def test_short_ways_are_gone_before_labels(spark):
    rounds = []
    pairs = [(6 * b + i, 6 * b + (i + 1) % 6) for b in range(0, 8, 2) for i in range(6)] + [(6 * b + i, 6 * b + i + 1) for b in range(1, 8, 2) for i in range(5)]
    got = dict(G.strong_components(edges(spark, pairs), driver_edges=0, rounds=rounds).collect())
    assert got == {6 * b + i: 6 * b for b in range(0, 8, 2) for i in range(6)}
    assert set(rounds) == {0}


@pytest.mark.parametrize("seed,steps", [(1, 100), (2, 100), (3, 2)])
def test_the_large_component_is_taken_from_a_pivot(spark, monkeypatch, seed, steps):
    monkeypatch.setattr(G, "BROADCAST_EDGES", 20)
    monkeypatch.setattr(G, "PIVOT_STEPS", steps)
    r = random.Random(seed)
    pairs = [(r.randrange(30), r.randrange(30)) for _ in range(90)]  # one large component and what leads to and from it
    small = [(40, 41), (41, 42), (42, 40), (43, 44), (44, 43), (45, 45), (5, 40), (41, 43), (46, 6), (46, 47), (47, 46)]
    rounds = []
    got = dict(G.strong_components(edges(spark, pairs + small), driver_edges=11, rounds=rounds).collect())
    assert got == plain_scc(48, pairs + small)
    assert bool(rounds) == (steps == 2)  # the rest has few edges and goes to the driver, unless the ways are too long


def test_a_pivot_without_a_component(spark, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_EDGES", 0)
    bridge = [(i, (i + 1) % 5) for i in range(5)] + [(i, 20) for i in range(5)] + [(20, i) for i in range(10, 15)] + [(i, 10 + (i - 9) % 5) for i in range(10, 15)]
    assert dict(G.strong_components(edges(spark, bridge), driver_edges=0).collect()) == {i: i // 10 * 10 for i in (*range(5), *range(10, 15))}
    monkeypatch.setattr(G, "PIVOT_TRIAL", 2)
    ring = [(i, (i + 1) % 12) for i in range(12)]
    assert dict(G.strong_components(edges(spark, ring), driver_edges=0).collect()) == {i: 0 for i in range(12)}
