"""Reachability, paths, cycles, components, orders and clusters over edges (src, dst).

Frontiers are joins; whatever loops to a fixed point stores its state each round, so that plans stay short
and a lost executor costs one round. Preorder traces are sequential and run on the driver over subgraphs whose
size is checked first; greedy clustering runs in rounds of joins that can't depend on each other.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.storage import drop_stored, stored

#: Edges that the driver takes for algorithms that are sequential by nature.
DRIVER_EDGES = 200_000
#: A node is a hub if it has over one in HUB_SHARE of all edges, and HUB_LEAST edges at least.
HUB_SHARE = 2000
HUB_LEAST = 1000
#: Frames with a row for each node of up to this many edges may be broadcast, if Spark takes them for small.
BROADCAST_EDGES = 200_000
#: Partitions of such frames.
FEW_PARTITIONS = 8
#: Steps from a pivot in either direction after which its component is left to the labels: at most, and where the steps
#: have met fewer nodes than PIVOT_WIDTH each.
PIVOT_STEPS = 100
PIVOT_TRIAL = 15
PIVOT_WIDTH = 100


def spread(df: DataFrame, edges: int) -> DataFrame:
    """df, a row for each node, to be joined by a shuffle if there are many edges. Spark goes by the bytes of the files, and
    sorted or equal labels of millions of nodes compress to a few MB."""
    return df.hint("merge") if edges > BROADCAST_EDGES else df


def gathered(df: DataFrame, edges: int) -> DataFrame:
    """df, a row for each node or edge, in few partitions if there are few edges, so that a round of small frames isn't
    a round of empty tasks."""
    return df.coalesce(FEW_PARTITIONS) if edges <= BROADCAST_EDGES else df


def reach(edges: DataFrame, seeds: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """(node, depth) for each length 0 to depth of walks from the seeds (column node), distinct. A seed on a
    cycle comes again at a larger depth."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node is not null and next is not null").distinct()
    level = seeds.select("node").distinct()
    out = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(steps, "node").select(F.col("next").alias("node")).distinct()
        if 1 < d < depth:  # each level once, not again for all levels behind it
            level = stored(level)
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out


def reachable(edges: DataFrame, seeds: DataFrame, backward: bool = False) -> DataFrame:
    """(node, depth) of all nodes that can be reached from the seeds, with the least depth. Each round stores
    the new nodes only, and ends where there are none."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node is not null and next is not null").distinct())
    seen = frontier = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    d = 0
    while True:
        d += 1
        new = frontier.select("node").join(steps, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = stored(new.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            drop_stored(steps)
            return seen
        seen, old = stored(seen.unionByName(frontier)), seen
        drop_stored(old)


def dependents(edges: DataFrame, seeds: DataFrame, depth: int = 5, line: str = "line") -> DataFrame:
    """Nodes that reach a seed within depth: (node, depth, line, method), depth and the others smallest. line
    and method are over all edges that leave the node, whether they lead to the seed or not."""
    found = reach(edges, seeds, depth, backward=True).where("depth > 0").groupBy("node").agg(F.min("depth").alias("depth"))
    own = edges.groupBy(F.col("src").alias("node")).agg(F.min(line).alias(line), F.min("method").alias("method"))
    return found.join(own, "node", "left")


def bfs_edges(edges: DataFrame, anchor: DataFrame, hops: int, limit: int = 1000, backward: bool = False) -> DataFrame:
    """Edges met within `hops` of the anchor nodes, each (src, dst) once with the hop of its first meeting."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    pairs = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    nodes = reach(pairs, anchor, hops - 1, backward).groupBy("node").agg(F.min("depth").alias("d"))
    return pairs.join(nodes.withColumnRenamed("node", a), a).select("src", "dst", (F.col("d") + 1).alias("hop")).orderBy("hop", "src", "dst").limit(limit)


def shortest_path(edges: DataFrame, start: int, goal: int, depth: int) -> list[int]:
    """Nodes of a shortest path of at most depth edges; of equal ones that by smaller predecessors. Empty if
    there is none. Only the path itself reaches the driver."""
    spark = edges.sparkSession
    steps = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = spark.createDataFrame([(start, None, 0)], "node long, parent long, depth int")
    frontier = seen
    for d in range(1, depth + 1):
        if start == goal:
            break
        new = frontier.select(F.col("node").alias("src")).join(steps, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = stored(new.join(seen.select("node"), "node", "left_anti").select("node", "parent", F.lit(d).alias("depth")))
        if frontier.isEmpty():
            return []
        seen = stored(seen.unionByName(frontier))
        if not frontier.where(F.col("node") == goal).isEmpty():
            break
    path, at = [], goal
    while at is not None:
        row = seen.where(F.col("node") == at).first()
        if row is None:
            return []
        path.append(at)
        at = row["parent"]
    return path[::-1]


def trace(edges: DataFrame, entry: int, depth: int = 5) -> tuple[list[dict], bool]:
    """Preorder walk of callees by call line from an entry, each node once, and whether a node at the last
    depth has callees. Edges are (src, dst, line, method); the subgraph within depth must fit DRIVER_EDGES."""
    depth = max(1, min(depth, 10))
    spark = edges.sparkSession
    seed = spark.createDataFrame([(entry,)], "node long")
    nodes = reach(edges, seed, depth).select("node").distinct()
    sub = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst", "line", "method").orderBy("src", "line", "dst").limit(DRIVER_EDGES + 1).collect()
    if len(sub) > DRIVER_EDGES:
        raise ValueError(f"the trace covers over {DRIVER_EDGES} edges")
    out: dict[int, list] = defaultdict(list)
    for r in sub:
        out[r["src"]].append(r)
    steps, seen, truncated = [], set(), False
    stack = [(entry, 0, None, None)]
    while stack:
        node, d, line, method = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        steps.append({"symbol_id": node, "depth": d, "call_line": line, "resolution_method": method})
        if d == depth:
            truncated |= bool(out[node])
            continue
        stack += [(r["dst"], d + 1, None if r["line"] is None else r["line"] + 1, r["method"]) for r in reversed(out[node]) if r["dst"] not in seen]
    return steps, truncated


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges in either direction, of nodes with edges.
    Rounds of large and small stars; hubs are aggregated in part before each shuffle, and those of over one in
    HUB_SHARE edges, some HUB_SHARE at most as no round adds edges, are broadcast, so that no task gets all edges of one."""
    all_ = stored(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a is not null and b is not null").distinct())
    alone = all_.where("a = b").select("a")
    e = all_.where("a <> b")
    edges = all_.count()
    many = max(edges // HUB_SHARE, HUB_LEAST)
    before = None
    while not _stars(e, edges):
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = _with_least(both.where("b > a"), least, many, edges).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        e = stored(gathered(_with_least(large, least, many, edges).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct(), edges))
        drop_stored(before)
        before = e
    star = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    hubs = gathered(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct(), edges)
    loops = alone.select(F.col("a").alias("node"), F.col("a").alias("component"))
    known = star.unionByName(hubs).select("node")
    return star.unionByName(hubs).unionByName(loops.join(F.broadcast(known) if edges <= BROADCAST_EDGES else known, "node", "left_anti"))


def _with_least(e: DataFrame, least: DataFrame, many: int, edges: int) -> DataFrame:
    """Edges (a, b) with the m of a; `least` has (a, m, n), n the number of a's edges. Hubs of over `many` edges
    are broadcast; their edges go on by a and b, so that they spread, and find no other partner. Of few edges all of
    `least` is broadcast, and no edge is shuffled."""
    if edges <= BROADCAST_EDGES:
        return e.join(F.broadcast(gathered(least.select("a", "m"), edges)), "a", "left").select("a", "b", "m")
    hub = F.broadcast(least.where(F.col("n") > many).select("a", F.col("m").alias("of_hub")))
    marked = e.join(hub, "a", "left").withColumn("spread", F.when(F.col("of_hub").isNull(), F.lit(0)).otherwise(F.xxhash64("b")))
    zero = F.least("n", F.lit(0)).alias("spread")  # no constant, which the optimiser would take out of the key
    return marked.join(spread(least.select("a", zero, "m"), edges), ["a", "spread"], "left").select("a", "b", F.coalesce("of_hub", "m").alias("m"))


def _stars(e: DataFrame, edges: int) -> bool:
    """Whether every node of edges (a, b) has one edge up, or only edges from below."""
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))).alias("x")).select("x.*")
    return gathered(ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up > 0 and low > 0)"), edges).isEmpty()


def tarjan(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Node -> smallest node of its strongly connected component. Iterative."""
    out: dict[int, list[int]] = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    on: set[int] = set()
    stack: list[int] = []
    comp: dict[int, int] = {}
    for root in sorted({x for e in edges for x in e}):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    comp.update((m, least) for m in members)
    return comp


def _labels(e: DataFrame, turn: int, rounds: list[int] | None) -> DataFrame:
    """(node, f, b) of edges (src, dst): f the first node, in an order by a hash, that reaches the node, b the first
    that it reaches, itself included; each as (h, node).

    A round takes the labels over one edge, and then from the node that the label names: what reaches that
    one reaches this one too. So labels travel further with each round, about half as far again, and the number
    of rounds grows with the logarithm of the longest way. Nodes of many edges and labels of many nodes are
    broadcast, some HUB_SHARE at most, so that no task gets all rows of one."""
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    own = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")
    labels = stored(ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).select("node", "o", "i", own.alias("f"), own.alias("b")))
    edges = e.count()
    many = max(edges // HUB_SHARE, HUB_LEAST)

    def over_edges(labels: DataFrame, label: str, a: str, b: str, degree: str) -> DataFrame:
        least = labels.select(F.col("node").alias("a"), F.col(label).alias("m"), F.col(degree).alias("n"))
        return _with_least(e.select(F.col(a).alias("a"), F.col(b).alias("b")), least, many, edges).groupBy(F.col("b").alias("node")).agg(F.min("m").alias(f"n{label}"))

    def from_named(labels: DataFrame, label: str) -> DataFrame:
        named = labels.select(F.col(f"{label}.node").alias("a"), F.col("node").alias("b"))
        least = labels.select(F.col("node").alias("a"), F.col(label).alias("m")).join(spread(named.groupBy("a").agg(F.count("*").alias("n")), edges), "a")
        return _with_least(named, least, many, edges).select(F.col("b").alias("node"), F.col("m").alias(f"n{label}"))

    while True:
        met = labels.join(spread(over_edges(labels, "f", "src", "dst", "o"), edges), "node", "left").join(spread(over_edges(labels, "b", "dst", "src", "i"), edges), "node", "left")
        step = stored(met.select("node", "o", "i", F.least("f", F.coalesce("nf", "f")).alias("f"), F.least("b", F.coalesce("nb", "b")).alias("b"), (F.coalesce(F.col("nf") < F.col("f"), F.lit(False)) | F.coalesce(F.col("nb") < F.col("b"), F.lit(False))).alias("moved")))
        drop_stored(labels)
        if rounds is not None:
            rounds.append(turn)
        if step.where("moved").isEmpty():
            return step.select("node", "f", "b")
        labels = stored(step.drop("moved").join(spread(from_named(step, "f"), edges), "node").join(spread(from_named(step, "b"), edges), "node").select("node", "o", "i", F.col("nf").alias("f"), F.col("nb").alias("b")))
        drop_stored(step)


def _pivot_component(e: DataFrame, edges: int) -> tuple[DataFrame | None, DataFrame]:
    """(node, component) of the strong component of the node with the most edges both in and out, None for a node alone,
    and those edges (src, dst) of the others that may still lie on a cycle: both ends are reached from the pivot or both
    are not, and both reach it or both do not.

    Most large graphs have one large component of short ways. A step from the pivot takes the edges of the nodes met last,
    so all steps together take each edge once in either direction, where a round of labels takes all edges. A component of
    long or narrow ways is left as it is."""
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degree = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    pivot = degree.where("o > 0 and i > 0").orderBy(F.desc(F.least("o", "i")), "node").limit(1)
    side = lambda df, k: df.select("node", F.lit(k).alias("side"))
    new = stored(pivot.select("node", F.explode(F.array(F.lit(1), F.lit(2))).alias("side")))
    met, all_ = [new], (n := new.count())
    while n and len(met) <= PIVOT_STEPS and (len(met) <= PIVOT_TRIAL or all_ >= PIVOT_WIDTH * len(met)):
        of = lambda k, end: spread(new.where(F.col("side") == k).select(F.col("node").alias(end)), n)
        ahead = side(e.join(of(1, "src"), "src", "left_semi").select(F.col("dst").alias("node")), 1)
        back = side(e.join(of(2, "dst"), "dst", "left_semi").select(F.col("src").alias("node")), 2)
        seen = reduce(DataFrame.unionByName, met)
        new = stored(gathered(ahead.unionByName(back).distinct().join(spread(seen, edges), ["node", "side"], "left_anti"), edges))
        n = new.count()
        all_ += n
        met.append(new)
    if n:
        drop_stored(*met)
        return None, e
    sides = stored(reduce(DataFrame.unionByName, met).groupBy("node").agg(F.sum("side").alias("c")))
    drop_stored(*met)
    of = lambda end, c: spread(sides.select(F.col("node").alias(end), F.col("c").alias(c)), edges)
    left = e.join(of("src", "ca"), "src", "left").where("ca is null or ca <> 3").join(of("dst", "cb"), "dst", "left")
    left = stored(left.where("ca <=> cb").select("src", "dst"))
    own = sides.where("c = 3").select("node")
    row = own.agg(F.count("*"), F.min("node")).first()
    return own.withColumn("component", F.lit(row[1])) if row[0] > 1 else None, left


def strong_components(edges: DataFrame, driver_edges: int = DRIVER_EDGES, rounds: list[int] | None = None) -> DataFrame:
    """(node, component) of nodes on cycles: the smallest node of the strongly connected component, for
    components of several nodes and for nodes with an edge to themselves.

    If many edges are left, the component of one node of many edges is taken first. Then in each turn every node is
    labelled with the first node that reaches it and the first that it reaches, in an order by a hash; where both are
    the same node, that is in its component, so that many components are found at once. Of the others only edges within
    equal labels can lie on a cycle. `driver_edges` edges or fewer go to the driver. rounds, if given, gets an entry for each round of labels."""
    spark = edges.sparkSession
    e = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    n, e, before = e.count(), e.where("src <> dst"), None
    out, turn, all_ = None, 0, n
    tried = False
    while True:
        # nodes without an incoming or outgoing edge are on no cycle; they go as long as that takes a tenth of the edges each
        # time, which all in all costs no more than ten times the first; longer ways are left to the labels
        while True:
            e = stored(e.join(spread(e.select(F.col("dst").alias("src")).distinct(), n), "src", "left_semi").join(spread(e.select(F.col("src").alias("dst")).distinct(), n), "dst", "left_semi").select("src", "dst"))
            drop_stored(before)
            before, had, n = e, n, e.count()
            if n <= driver_edges or 10 * n > 9 * had:
                break
        if not n:
            break
        if n <= driver_edges:
            comp = tarjan([(r[0], r[1]) for r in e.collect()])
            size = Counter(comp.values())
            rows = [(k, v) for k, v in comp.items() if size[v] > 1]
            part = spark.createDataFrame(rows, "node long, component long")
            out = part if out is None else out.unionByName(part)
            break
        if n > BROADCAST_EDGES and not tried:
            out, e = _pivot_component(e, n)
            n, tried = e.count(), True
            if e is not before:
                drop_stored(before)
                before = e
                continue
        labels = _labels(e, turn, rounds)
        found = labels.where("f = b").select("node", F.col("f.node").alias("root"))
        groups = found.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("k")).where("k > 1")
        out = stored(found.join(groups, "root").select("node", "component") if out is None else out.unionByName(found.join(groups, "root").select("node", "component")))
        left = labels.where("f <> b")
        inside = e.join(spread(left.select(F.col("node").alias("src"), F.col("f").alias("fa"), F.col("b").alias("ba")), n), "src").join(spread(left.select(F.col("node").alias("dst"), F.col("f").alias("fb"), F.col("b").alias("bb")), n), "dst")
        e = inside.where("fa = fb and ba = bb").select("src", "dst")
        turn += 1
    if out is None:
        return loops
    return out.unionByName(loops.join(spread(out, all_), "node", "left_anti"))


def topological_levels(nodes: DataFrame, edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, level): nodes whose dependencies (dst) all have lower levels, level 0 without any; nodes on or behind
    cycles are left out. The order by level and node is a topological one.

    A round takes away the nodes without open dependencies, and then contracts those with a single one: such a node's level
    is the larger of a number known so far and that of its dependency plus a number, and such rules compose, so a
    way of single dependencies of any length is followed in steps that double. Trees and chains take a
    number of steps that grows with the logarithm of their size; other graphs at most a round for each level. Contracted nodes get
    their levels in the end, in reverse order. rounds, if given, gets an entry for each step."""
    note = (lambda k: None) if rounds is None else rounds.append
    e = stored(edges.select("src", "dst", F.lit(1).alias("w")).where("src is not null and dst is not null").distinct())
    left = stored(nodes.select("node").unionByName(e.select(F.explode(F.array("src", "dst")).alias("node"))).distinct().withColumn("base", F.lit(0)))
    known = nodes.select("node").distinct()
    done: list[DataFrame] = []
    chains: list[DataFrame] = []
    turn = 0
    while True:
        note(turn)
        degree = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("dst"), F.min("w").alias("w"))
        rows = stored(left.join(degree, "node", "left"))
        ready = stored(rows.where("n is null").select("node", F.col("base").alias("level")))
        single = stored(rows.where("n = 1").select("node", F.col("dst").alias("to"), "base", F.col("w").alias("add")))
        if ready.isEmpty() and single.isEmpty():
            break
        done.append(ready)
        # follow single dependencies: the rule of a node and that of what it depends on, as one
        steps = 0
        most = max(single.count(), 1).bit_length() + 1
        while steps < most:
            further = single.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("base").alias("_b"), F.col("add").alias("_a"))
            met = single.join(further, "to", "left")
            step = stored(met.select("node", F.coalesce("_to", "to").alias("to"), F.greatest("base", F.coalesce(F.col("_b") + F.col("add"), "base")).alias("base"), (F.col("add") + F.coalesce("_a", F.lit(0))).alias("add"), F.col("_to").isNotNull().alias("moved")))
            single = step.drop("moved")
            steps += 1
            note(turn)
            if step.where("moved").isEmpty():
                break
        # what still leads to a contracted node after that many steps is on or behind a cycle
        single = stored(single.join(single.select(F.col("node").alias("to")), "to", "left_anti"))
        chains.append(single)
        open_ = rows.where("n > 1").select("node", "base")
        over = e.join(open_.select(F.col("node").alias("src")), "src", "left_semi")
        through = over.join(single.select(F.col("node").alias("dst"), "to", F.col("base").alias("b"), "add"), "dst", "left").select("src", F.coalesce("to", "dst").alias("dst"), (F.col("w") + F.coalesce("add", F.lit(0))).alias("w"), (F.col("w") + F.col("b")).alias("b"))
        met = stored(through.join(ready.withColumnRenamed("node", "dst"), "dst", "left"))
        gained = met.groupBy(F.col("src").alias("node")).agg(F.max(F.greatest(F.coalesce(F.col("w") + F.col("level"), F.lit(0)), F.coalesce("b", F.lit(0)))).alias("g"))
        before = (left, e)
        left = stored(open_.join(gained, "node", "left").select("node", F.greatest("base", F.coalesce("g", F.lit(0))).alias("base")))
        e = stored(met.where("level is null").groupBy("src", "dst").agg(F.max("w").alias("w")))
        drop_stored(rows, met, *before)
        turn += 1
    if not done:
        return known.withColumn("level", F.lit(0)).limit(0)
    levels = done[0]
    for part in done[1:]:
        levels = levels.unionByName(part)
    for chain in reversed(chains):
        found = chain.join(levels.withColumnRenamed("node", "to"), "to").select("node", F.greatest("base", F.col("add") + F.col("level")).alias("level"))
        levels = stored(levels.unionByName(found))
    return levels.join(known, "node", "left_semi").select("node", F.col("level").cast("int").alias("level"))


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, a: int, b: int, lines: dict[int, int], most_lines: int) -> None:
        """Join two groups under the smaller name if they have most_lines at most together."""
        a, b = sorted((self.find(a), self.find(b)))
        if a != b and lines[a] + lines[b] <= most_lines:
            self.up[b] = a
            lines[a] += lines.pop(b)


def cluster_members(symbols: DataFrame, edges: DataFrame, most_lines: int = 500, least_lines: int = 30, driver_edges: int = DRIVER_EDGES) -> tuple[DataFrame, DataFrame]:
    """Symbols grouped by cycles, then files, then call weight, under a bound of lines, clusters that are too
    small folded into their heaviest neighbour: (id, file_id, lines, cluster), a cluster being named by its
    smallest group, and the edges (src, dst) between symbols. Symbols are (id, file_id, lines), lines not
    negative. Ties go to the smaller numbers.

    The result is that of the greedy order, one join after another; all symbols and edges stay in Spark. Joins
    that no longer fit never fit again and are dropped; the driver takes what is left of them once that is
    driver_edges or fewer."""
    s = stored(symbols.select("id", "file_id", F.col("lines").cast("long").alias("lines")))
    ids = s.select("id")
    links = edges.select("src", "dst").where("src is not null and dst is not null")
    links = stored(links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    cycle = strong_components(links, driver_edges).withColumnRenamed("node", "id")
    own = stored(s.join(cycle, "id", "left").select("id", "file_id", "lines", F.coalesce("component", "id").alias("root")))
    size = stored(own.groupBy(F.col("root").alias("node")).agg(F.sum("lines").alias("lines")))

    moved = _joined_in_files(own, size, most_lines, driver_edges)
    own, size = _moved(own, size, moved)
    of = own.select("id", "root")
    ends = links.join(of.withColumnsRenamed({"id": "src", "root": "x"}), "src").join(of.withColumnsRenamed({"id": "dst", "root": "y"}), "dst").where("x <> y")
    pairs = stored(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("w")))

    moved = _joined(size, pairs.select("a", "b", F.struct((-F.col("w")).alias("p"), F.col("a").alias("q"), F.col("b").alias("r")).alias("o")), most_lines, driver_edges)
    own, size = _moved(own, size, moved)
    to = moved.select(F.col("node"), F.col("root").alias("to"))
    near = pairs.join(to.withColumnsRenamed({"node": "a", "to": "x"}), "a", "left").join(to.withColumnsRenamed({"node": "b", "to": "y"}), "b", "left")
    # weights are those before joining, of groups that still go by the same name
    near = near.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"), F.when(F.col("x").isNull() & F.col("y").isNull(), F.col("w")).otherwise(1).alias("w"))
    own, size = _moved(own, size, _folded(size, near, most_lines, least_lines, driver_edges))
    return own.withColumnRenamed("root", "cluster"), links


def _moved(own: DataFrame, size: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and groups' lines after groups have moved (node, root)."""
    to = moved.select(F.col("node"), F.col("root").alias("to"))
    own = stored(own.join(to.withColumnRenamed("node", "root"), "root", "left").select("id", "file_id", "lines", F.coalesce("to", "root").alias("root")))
    size = stored(size.join(to, "node", "left").groupBy(F.coalesce("to", "node").alias("node")).agg(F.sum("lines").alias("lines")))
    return own, size


def _joined_in_files(own: DataFrame, size: DataFrame, most_lines: int, driver_edges: int) -> DataFrame:
    """(node, root) of the groups that move when those of each file, by file, join the file's first one."""
    part = own.groupBy("file_id", F.col("root").alias("node")).agg(F.min("id").alias("at")).join(size, "node")
    first = part.groupBy("file_id").agg(F.min_by(F.struct("node", "lines"), "at").alias("f")).where(F.col("f.lines") <= most_lines)
    part = stored(part.where(F.col("lines") <= most_lines).join(first, "file_id").select("file_id", "at", "node", "lines", F.col("f.node").alias("first")))
    # files without a group of another file's are worked one by one in a stream
    tied = stored(part.join(part.groupBy("node").count().where("count > 1"), "node", "left_semi").select("file_id").distinct())

    def run(batches):
        file, total, got = object(), 0, []
        for b in batches:
            node, root = [], []
            for f, n, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if f != file:
                    node += got
                    root += [min(got)] * len(got) if got else []
                    file, total, got = f, k, [n]
                elif total + k <= most_lines:
                    total += k
                    got.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array([min(got)] * len(got), pa.int64())], names=["node", "root"])

    alone = part.join(tied, "file_id", "left_anti").repartition("file_id").sortWithinPartitions("file_id", "at").select("file_id", "node", "lines")
    alone = stored(alone.mapInArrow(run, "node long, root long").where("node <> root"))
    joins = part.join(tied, "file_id", "left_semi").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.struct(F.col("file_id").alias("p"), F.col("at").alias("q"), F.lit(0).alias("r")).alias("o"))
    return alone.unionByName(_joined(size, joins, most_lines, driver_edges))


def _relabelled(e: DataFrame, step: DataFrame) -> DataFrame:
    """Edges (a, b, la, lb, ...) after the joins (node, root, lines); `same` tells whether both names stay."""
    to = step.select("node", F.col("root").alias("to"), "lines").unionByName(step.select(F.col("root").alias("node"), F.col("root").alias("to"), "lines"))
    for k in ("a", "b"):
        e = e.join(to.withColumnsRenamed({"node": k, "to": f"to_{k}", "lines": f"lines_{k}"}), k, "left")
    e = e.withColumns({"same": (F.coalesce("to_a", "a") == F.col("a")) & (F.coalesce("to_b", "b") == F.col("b")), "la": F.coalesce("lines_a", "la"), "lb": F.coalesce("lines_b", "lb"), "a": F.coalesce("to_a", "a"), "b": F.coalesce("to_b", "b")})
    return e.drop("to_a", "to_b", "lines_a", "lines_b")


def _fitting(e: DataFrame, most_lines: int, *measures) -> DataFrame:
    """Edges (a, b, la, lb) whose ends are two groups that fit together, each pair once with a < b."""
    e = e.where("a <> b").where(F.col("la") + F.col("lb") <= most_lines)
    turned = F.col("a") > F.col("b")
    e = e.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b"), "la": F.when(turned, F.col("lb")).otherwise(F.col("la")), "lb": F.when(turned, F.col("la")).otherwise(F.col("lb"))})
    return e.groupBy("a", "b").agg(F.first("la").alias("la"), F.first("lb").alias("lb"), *measures)


def _sized(e: DataFrame, size: DataFrame) -> DataFrame:
    return e.join(size.withColumnsRenamed({"node": "a", "lines": "la"}), "a").join(size.withColumnsRenamed({"node": "b", "lines": "lb"}), "b")


def _followed(moved: DataFrame | None, step: DataFrame) -> DataFrame:
    """Moves (node, root) and then those of a step."""
    step = step.select("node", "root")
    if moved is None:
        return step
    return stored(moved.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(step))


def _on_driver(spark, group: Union) -> DataFrame:
    return spark.createDataFrame([(x, group.find(x)) for x in group.up], "node long, root long")


def _joined(size: DataFrame, joins: DataFrame, most_lines: int, driver_edges: int) -> DataFrame:
    """(node, root) of the groups that move when joins (a, b, o) are tried by o, as long as the lines of both
    are most_lines at most. A join that comes first at both of its groups doesn't depend on any other: each
    round makes all of those."""
    spark, moved = size.sparkSession, None
    first = F.min("o").alias("o")
    e = stored(_fitting(_sized(joins, size), most_lines, first))
    while (n := e.count()) > driver_edges:
        best = e.select(F.col("a").alias("g"), "o").unionByName(e.select(F.col("b").alias("g"), "o")).groupBy("g").agg(F.min("o").alias("m"))
        now = e.join(best.withColumnsRenamed({"g": "a", "m": "ma"}), "a").where("o = ma").join(best.withColumnsRenamed({"g": "b", "m": "mb"}), "b").where("o = mb")
        step = stored(now.select(F.col("b").alias("node"), F.col("a").alias("root"), (F.col("la") + F.col("lb")).alias("lines")))
        moved = _followed(moved, step)
        e = stored(_fitting(_relabelled(e, step), most_lines, first))
    group, lines = Union(), {}
    if n:
        rows = e.orderBy("o").collect()
        for r in rows:
            lines[r["a"]], lines[r["b"]] = r["la"], r["lb"]
        for r in rows:
            group.join(r["a"], r["b"], lines, most_lines)
    return _followed(moved, _on_driver(spark, group))


def _folded(size: DataFrame, near: DataFrame, most_lines: int, least_lines: int, driver_edges: int) -> DataFrame:
    """(node, root) of the groups that move when those under least_lines are folded, by their number, into the
    neighbour (a, b, w) of the largest weight that they fit with. What a group meets depends only on smaller
    ones at two edges' distance: each round folds all that have none of those left."""
    spark, moved = size.sparkSession, None
    heaviest = F.max("w").alias("w")
    small = F.col("lines") < least_lines
    left = stored(size.where(small).select("node"))

    def of_left(e):  # edges with an end that is still to be folded
        for k in ("a", "b"):
            e = e.join(left.withColumn(f"left_{k}", F.lit(True)).withColumnRenamed("node", k), k, "left")
        return e.where("left_a or left_b")

    e = stored(of_left(_fitting(_sized(near, size), most_lines, heaviest)))
    while (n := e.count()) > driver_edges:
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u"), F.col("left_a").alias("lv"), F.col("left_b").alias("lu"), "w", F.col("la").alias("nv"), F.col("lb").alias("nu"))
        both = both.unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u"), F.col("left_b").alias("lv"), F.col("left_a").alias("lu"), "w", F.col("lb").alias("nv"), F.col("la").alias("nu")))
        one = both.groupBy("v").agg(F.least(F.min(F.when(F.col("lu"), F.col("u"))), F.min(F.when(F.col("lv"), F.col("v")))).alias("m"))
        two = both.where("lv").join(one.withColumnsRenamed({"v": "u", "m": "mu"}), "u").groupBy("v").agg(F.min("mu").alias("m"), F.min_by(F.struct("u", "nv", "nu"), F.struct((-F.col("w")).alias("w"), F.col("u").alias("u"))).alias("x"))
        now = stored(two.join(one.withColumnRenamed("m", "m1"), "v").where("m >= v and m1 >= v").select("v", "x.*"))
        step = stored(now.select(F.greatest("v", "u").alias("node"), F.least("v", "u").alias("root"), (F.col("nv") + F.col("nu")).alias("lines")))
        moved = _followed(moved, step)
        gone = now.select(F.col("v").alias("node")).unionByName(step.select("node"))
        left = stored(left.join(gone, "node", "left_anti"))
        e = _relabelled(e.drop("left_a", "left_b"), step).withColumn("w", F.when(F.col("same"), F.col("w")).otherwise(1))
        e = stored(of_left(_fitting(e, most_lines, heaviest)))
    group, lines, others, weight = Union(), {}, defaultdict(set), {}
    if n:
        for r in e.collect():
            a, b = r["a"], r["b"]
            lines[a], lines[b], weight[a, b] = r["la"], r["lb"], r["w"]
            if r["left_a"]:
                others[a].add(b)
            if r["left_b"]:
                others[b].add(a)
    for x in sorted(others):
        if group.find(x) == x:
            found = {group.find(y) for y in others[x]} - {x}
            fit = [y for y in found if lines[x] + lines[y] <= most_lines]
            if fit:
                group.join(x, min(fit, key=lambda y: (-weight.get((min(x, y), max(x, y)), 1), y)), lines, most_lines)
    return _followed(moved, _on_driver(spark, group))


def cluster_sizes(own: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster, symbols, files, total_lines, internal_edges, external_edges) of what cluster_members gives,
    numbered from 0 by lines, most first, then the smallest symbol."""
    per = own.groupBy("cluster").agg(F.count("*").alias("symbols"), F.sum("lines").alias("total_lines"), F.min("id").alias("first"))
    files = own.select("cluster", "file_id").distinct().groupBy("cluster").agg(F.count("file_id").alias("files"))
    of = own.select("id", "cluster")
    ends = stored(links.join(of.withColumnsRenamed({"id": "src", "cluster": "x"}), "src").join(of.withColumnsRenamed({"id": "dst", "cluster": "y"}), "dst").groupBy("x", "y").agg(F.count("*").alias("n")))
    inside = ends.where("x = y").select(F.col("x").alias("cluster"), F.col("n").alias("i"), F.lit(0).alias("o"))
    across = ends.where("x <> y")
    sums = inside.unionByName(across.select(F.col("x").alias("cluster"), F.lit(0).alias("i"), F.col("n").alias("o"))).unionByName(across.select(F.col("y").alias("cluster"), F.lit(0).alias("i"), F.col("n").alias("o"))).groupBy("cluster").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    out = per.join(files, "cluster").join(sums, "cluster", "left").orderBy(F.desc("total_lines"), "first")
    out = stored(out.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    before, at = [], 0
    for r in out.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("low")).orderBy("part").collect():  # a row per partition
        before.append((r["part"], at - r["low"]))
        at += r["n"]
    before = out.sparkSession.createDataFrame(before, "part int, shift long")
    return out.join(F.broadcast(before), "part").select((F.col("place") + F.col("shift")).alias("id"), "cluster", "symbols", "files", "total_lines", F.coalesce("i", F.lit(0)).alias("internal_edges"), F.coalesce("o", F.lit(0)).alias("external_edges"))


def clusters(symbols: DataFrame, edges: DataFrame, most_lines: int = 500, least_lines: int = 30, driver_edges: int = DRIVER_EDGES) -> list[dict]:
    """The clusters with their symbols and files as a list, which is as long as there are symbols; without
    those, cluster_sizes."""
    own, links = cluster_members(symbols, edges, most_lines, least_lines, driver_edges)
    ids = own.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("symbol_ids"), F.array_sort(F.collect_set("file_id")).alias("file_ids"))
    rows = cluster_sizes(own, links).join(ids, "cluster").orderBy("id").toLocalIterator()
    return [{k: r[k] for k in ("id", "symbol_ids", "file_ids", "total_lines", "internal_edges", "external_edges")} for r in rows]


def directory_cycles(graph: DataFrame, limit: int = 20) -> list[dict]:
    """Cycles of directories with the imports inside, those with the most imports first, then by directories. Only the
    cycles that are returned reach the driver."""
    e = stored(graph.select("from_dir", "to_dir", "count"))
    names = stored(e.select(F.explode(F.array("from_dir", "to_dir")).alias("name")).distinct().withColumn("node", F.monotonically_increasing_id()))
    numbered = e.join(names.withColumnsRenamed({"name": "from_dir", "node": "src"}), "from_dir").join(names.withColumnsRenamed({"name": "to_dir", "node": "dst"}), "to_dir")
    numbered = stored(numbered.select("src", "dst", "count"))
    of = stored(strong_components(numbered))
    inside = numbered.join(of.withColumnsRenamed({"node": "src", "component": "c"}), "src").join(of.withColumnsRenamed({"node": "dst", "component": "d"}), "dst").where("c = d")
    sums = inside.groupBy(F.col("c").alias("component")).agg(F.sum("count").alias("edge_count"))
    dirs = of.join(names, "node").groupBy("component").agg(F.array_sort(F.collect_list("name")).alias("directories"))
    rows = dirs.join(sums, "component").orderBy(F.desc("edge_count"), "directories").limit(limit).collect()
    return [{"directories": r["directories"], "edge_count": r["edge_count"]} for r in rows]


def layer_violations(graph: DataFrame, limit: int = 20) -> list[dict]:
    """Directory imports that lead back to one on the path of a depth-first walk from those imported least;
    ranks are the order of finishing."""
    rows = sorted(_small(graph), key=lambda r: (r["from_dir"], r["to_dir"]))
    out: dict[str, list] = defaultdict(list)
    into: Counter = Counter()
    names = set()
    for r in rows:
        out[r["from_dir"]].append(r)
        into[r["to_dir"]] += 1
        names |= {r["from_dir"], r["to_dir"]}
    rank: dict[str, int] = {}
    seen: set[str] = set()
    path: set[str] = set()
    found = []
    for root in sorted(names, key=lambda d: (into[d], d)):
        if root in seen:
            continue
        work = [(root, iter(out[root]))]
        seen.add(root)
        path.add(root)
        while work:
            d, it = work[-1]
            for r in it:
                if r["to_dir"] not in seen:
                    seen.add(r["to_dir"])
                    path.add(r["to_dir"])
                    work.append((r["to_dir"], iter(out[r["to_dir"]])))
                    break
                if r["to_dir"] in path:
                    found.append(r)
            else:
                work.pop()
                path.discard(d)
                rank[d] = len(rank)
    got = [{"from_dir": r["from_dir"], "to_dir": r["to_dir"], "from_rank": rank[r["from_dir"]], "to_rank": rank[r["to_dir"]], "edge_count": r["count"], "sample_files": list(r["sample_files"])} for r in found]
    return sorted(got, key=lambda v: (-v["edge_count"], v["from_dir"], v["to_dir"]))[:limit]


def _small(graph: DataFrame) -> list:
    rows = graph.limit(DRIVER_EDGES + 1).collect()
    if len(rows) > DRIVER_EDGES:
        raise ValueError(f"the graph has over {DRIVER_EDGES} edges; use a smaller depth")
    return rows


def summary(symbols: DataFrame, files: DataFrame, edges: DataFrame, file_modules: DataFrame, modules: DataFrame) -> dict:
    """Totals, modules with their sizes, dependencies between modules, components and cycles."""
    owner = file_modules.join(modules.select(F.col("id").alias("module_id"), "name"), "module_id")
    per = owner.join(symbols.groupBy("file_id").agg(F.count("*").alias("s")), "file_id", "left").groupBy("name").agg(F.countDistinct("file_id").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("symbols"))
    at = symbols.select("id", "file_id").join(owner.select("file_id", "name"), "file_id").select("id", "name")
    deps = edges.join(at.withColumnsRenamed({"id": "src", "name": "from_module"}), "src").join(at.withColumnsRenamed({"id": "dst", "name": "to_module"}), "dst").where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count("*").alias("edges"))
    comp = components(edges).groupBy("component").count().where("count > 1")
    cycles = strong_components(edges).groupBy("component").count()
    return {
        "files": files.count(),
        "symbols": symbols.count(),
        "edges": edges.count(),
        "modules": [r.asDict() for r in per.orderBy("name").collect()],
        "module_dependencies": [r.asDict() for r in deps.orderBy(F.desc("edges"), "from_module", "to_module").collect()],
        "components": comp.count(),
        "cycles": cycles.count(),
    }
