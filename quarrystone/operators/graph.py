"""Graphs as edge tables: co-occurrence, ties, forests, rings, components, layers, roll-ups and interval trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.session import cut


def cooccurrence(mentions: DataFrame, place: str, name: str, doc: str) -> DataFrame:
    """(a, b, n, docs) of names that stand in one place, a < b."""
    m = mentions.select(F.col(place).alias("p"), F.col(name).alias("x"), F.col(doc).alias("d")).distinct()
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, ["p", "d"]).filter("a.x < b.x").groupBy(F.col("a.x").alias("a"), F.col("b.x").alias("b")).agg(F.count("*").alias("n"), F.count_distinct("d").alias("docs"))


def nest_by_ties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, parent, w): the neighbour of higher rank with the strongest tie, null for roots. nodes (node, rank), edges (a, b, w)."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("parent"), "w").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("parent"), "w"))
    r = both.join(nodes.select("node", F.col("rank").alias("rn")), "node").join(nodes.select(F.col("node").alias("parent"), F.col("rank").alias("rp")), "parent")
    up = r.filter((F.col("rp") > F.col("rn")) | ((F.col("rp") == F.col("rn")) & (F.col("parent") < F.col("node"))))
    w = Window.partitionBy("node").orderBy(F.desc("w"), F.desc("rp"), "parent")
    best = up.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("node", "parent", "w")
    return nodes.select("node").join(best, "node", "left")


def depths(forest: DataFrame, most: int = 64) -> DataFrame:
    """(node, root, depth) of a forest (node, parent), by doubling: each round doubles the reach, so depth d takes log2 d
    rounds. A node whose ancestors run in a circle is not returned."""
    forest = cut(forest.select("node", "parent"), "forest")
    x = cut(forest.select("node", F.coalesce("parent", "node").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "depths")
    k = 1
    while k < most:
        y = x.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        x = cut(x.join(y, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth")), "depths")
        k *= 2
        if not x.join(forest.filter("parent is not null").select(F.col("node").alias("up")), "up", "left_semi").limit(1).count():
            break
    roots = forest.filter("parent is null").select(F.col("node").alias("up"))
    return x.join(roots, "up", "left_semi").select("node", F.col("up").alias("root"), "depth")


def roll_up(edges: DataFrame, rep: DataFrame) -> DataFrame:
    """(a, b, w): ties summed between representatives (node, rep), those within one dropped."""
    j = edges.join(rep.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b").filter("ra <> rb")
    return j.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.sum("w").alias("w"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of undirected edges (src, dst): the smallest node each can reach.

    Alternating large-star and small-star steps: every round is two groupings of the edges, stars only ever get flatter, and
    a hub is grouped by its many neighbours' side, so no node's neighbours are put together twice. Ends when nothing moves."""
    e = cut(edges.filter("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "edges")
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        j = both.join(low, "src")
        if large:
            out = j.filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        else:
            out = j.select("dst", "low").filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))
        return out.filter("src <> dst").distinct()

    sign = None
    for _ in range(rounds):
        e = cut(star(star(e, True), False), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).head()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    return nodes.join(e.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def rings(edges: DataFrame, centre, most: int) -> DataFrame:
    """(node, ring): steps from a centre over undirected edges, up to ``most``. The frontier is joined on, never collected."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = both.sparkSession.createDataFrame([(centre, 0)], f"node {dict(edges.dtypes)['src']}, ring int")
    edge = seen
    for k in range(1, most + 1):
        edge = cut(both.join(edge.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("ring", F.lit(k)), "ring")
        seen = seen.unionByName(edge)
    return seen


def layers(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, layer): longest path from a root of a DAG. Raises if edges still move things after ``most`` rounds (a circle)."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    cur = cut(nodes.withColumn("layer", F.lit(0)), "layers")
    for _ in range(most):
        up = edges.join(cur.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg((F.max("layer") + 1).alias("l"))
        nxt = cut(cur.join(up, "node", "left").select("node", F.coalesce("l", F.lit(0)).alias("layer"), (F.coalesce("l", F.lit(0)) != F.col("layer")).alias("moved")), "layers")
        cur = nxt.select("node", "layer")
        if not nxt.filter("moved").limit(1).count():
            return cur
    raise ValueError("the graph has a circle")


def back_edges(edges: list[tuple], weight: dict | None = None) -> list[tuple]:
    """The edges to drop so that a small graph (on the driver) has no circle: of each circle the one that bears least."""
    left, dropped = set(edges), []
    w = weight or {}

    def circle():
        out: dict = {}
        for a, b in sorted(left):
            out.setdefault(a, []).append(b)
        state: dict = {}
        for root in sorted(out):
            if state.get(root):
                continue
            path, its = [root], [iter(out.get(root, ()))]
            state[root] = 1
            while its:
                nxt = next(its[-1], None)
                if nxt is None:
                    state[path.pop()] = 2
                    its.pop()
                elif state.get(nxt) == 1:
                    c = path[path.index(nxt) :] + [nxt]
                    return list(zip(c, c[1:]))
                elif not state.get(nxt):
                    state[nxt] = 1
                    path.append(nxt)
                    its.append(iter(out.get(nxt, ())))
        return None

    while c := circle():
        e = min(c, key=lambda x: (w.get(x, 1), x))
        left.discard(e)
        dropped.append(e)
    return dropped


def topological(edges: list[tuple]) -> list:
    """An order of a small DAG's nodes, smallest first where free."""
    import heapq

    nodes = {x for e in edges for x in e}
    need = {n: 0 for n in nodes}
    out: dict = {n: [] for n in nodes}
    for a, b in set(edges):
        out[a].append(b)
        need[b] += 1
    heap = [n for n in nodes if not need[n]]
    heapq.heapify(heap)
    order = []
    while heap:
        n = heapq.heappop(heap)
        order.append(n)
        for m in out[n]:
            need[m] -= 1
            if not need[m]:
                heapq.heappush(heap, m)
    if len(order) < len(nodes):
        raise ValueError("the graph has a circle")
    return order


def interval_parents(units: DataFrame, by: str) -> DataFrame:
    """(id, parent) of spans (id, by, s, e, level): the smallest span of a coarser level (lower number) that holds each whole.
    Nested starts are found by one order of starts and a carried stack of levels: for each coarser level the last start at or
    before is the only candidate, as spans of one level don't overlap."""
    levels = sorted(r[0] for r in units.select("level").distinct().collect())  # a handful of unit types
    w = Window.partitionBy(by).orderBy("s", "level", F.desc("e")).rowsBetween(Window.unboundedPreceding, 0)
    me = F.struct(F.col("id").alias("id"), F.col("s").alias("s"), F.col("e").alias("e"))
    x = units
    for l in levels:
        x = x.withColumn(f"__l{l}", F.last(F.when(F.col("level") == l, me), ignorenulls=True).over(w))
    cands = [F.when((F.col("level") > l) & (F.col(f"__l{l}.s") <= F.col("s")) & (F.col(f"__l{l}.e") >= F.col("e")), F.struct((F.col(f"__l{l}.e") - F.col(f"__l{l}.s")).alias("n"), F.lit(-l).alias("l"), F.col(f"__l{l}.id").alias("id"))) for l in levels]
    best = F.array_min(F.array_compact(F.array(*cands)))
    return x.select("id", best["id"].alias("parent"))


def folder_counts(folders: DataFrame, sources: DataFrame) -> DataFrame:
    """(folder, direct, subtree) of folders (node, parent) and sources (source, folder)."""
    anc = cut(folders.select("node", F.col("node").alias("anc")), "anc")
    edge, seen = anc, anc
    up = folders.filter("parent is not null").select(F.col("node").alias("anc"), F.col("parent").alias("p"))
    while True:
        edge = cut(edge.join(up, "anc").select("node", F.col("p").alias("anc")).join(seen, ["node", "anc"], "left_anti"), "anc")
        if not edge.limit(1).count():
            break
        seen = seen.unionByName(edge)
    direct = sources.groupBy(F.col("folder").alias("node")).agg(F.count("*").alias("direct"))
    sub = seen.join(direct, "node", "left").groupBy("anc").agg(F.coalesce(F.sum("direct"), F.lit(0)).alias("subtree"))
    return folders.select("node").join(direct, "node", "left").join(sub.withColumnRenamed("anc", "node"), "node").select(F.col("node").alias("folder"), F.coalesce("direct", F.lit(0)).alias("direct"), "subtree")
