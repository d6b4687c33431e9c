"""Graphs made of the tables."""

from pyspark.sql import functions as F

from quarrystone.operators import graph as gr
from quarrystone.queries.registry import SQL, query


@query("""WITH m AS (SELECT DISTINCT token, name FROM signers) SELECT a.name AS a, b.name AS b, count(*) AS n, count(DISTINCT a.token) AS docs FROM m a JOIN m b ON a.token=b.token AND a.name<b.name GROUP BY 1,2""")
def cooccurrence_edges(t):
    """Signers of one contract."""
    return gr.cooccurrence(t.signers, "token", "name", "token")


def ties(t):
    return gr.cooccurrence(t.lineitem.select("l_orderkey", "l_suppkey", (F.col("l_orderkey") % 7).alias("d")), "l_orderkey", "l_suppkey", "d").select("a", "b", F.col("n").alias("w"))


TIES = "WITH m AS (SELECT DISTINCT l_orderkey AS p, l_suppkey AS x FROM lineitem), e AS (SELECT a.x AS a, b.x AS b, count(*) AS w FROM m a JOIN m b ON a.p=b.p AND a.x<b.x GROUP BY 1,2), r AS (SELECT s_suppkey AS node, s_acctbal AS rank FROM supplier), u AS (SELECT a AS node, b AS parent, w FROM e UNION ALL SELECT b, a, w FROM e), f AS (SELECT r.node, q.parent, q.w FROM r LEFT JOIN (SELECT u.node, u.parent, u.w, row_number() OVER (PARTITION BY u.node ORDER BY u.w DESC, p.rank DESC, u.parent) AS k FROM u JOIN r c ON c.node=u.node JOIN r p ON p.node=u.parent WHERE p.rank>c.rank OR (p.rank=c.rank AND u.parent<u.node)) q ON q.node=r.node AND k=1)"


def forest(t):
    return gr.nest_by_ties(t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("rank")), ties(t))


@query(f"""{TIES} SELECT node, parent, w FROM f""")
def nest_parent(t):
    """Suppliers under their strongest neighbour of higher rank."""
    return forest(t)


@query(TIES.replace("WITH m", "WITH RECURSIVE m") + """, d AS (SELECT node, node AS root, 0 AS depth FROM f WHERE parent IS NULL UNION ALL SELECT f.node, d.root, d.depth+1 FROM f JOIN d ON f.parent=d.node) SELECT node, root, depth FROM d""")
def forest_depths(t):
    return gr.depths(forest(t))


@query(f"""{TIES} SELECT least(a.s_nationkey,b.s_nationkey) AS a, greatest(a.s_nationkey,b.s_nationkey) AS b, CAST(sum(w) AS BIGINT) AS w FROM e JOIN supplier a ON a.s_suppkey=e.a JOIN supplier b ON b.s_suppkey=e.b WHERE a.s_nationkey<>b.s_nationkey GROUP BY 1,2""")
def rollup_edges(t):
    """Ties between suppliers as ties between nations."""
    return gr.roll_up(ties(t), t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("rep")))


LINKS = "SELECT DISTINCT o_custkey AS src, 1000000+l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey=o_orderkey WHERE l_quantity=50 AND l_discount<0.02"


# The queries named ..._all run over all order lines; those without it keep to large orders, as their SQL does.
LINKS_ALL = LINKS.replace(" WHERE l_quantity=50 AND l_discount<0.02", "")


def links(t, where="l_quantity = 50 and l_discount < 0.02"):
    l = t.lineitem.filter(where).select("l_orderkey", (F.col("l_suppkey") + 1000000).alias("dst"))
    return l.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src")), "l_orderkey").select("src", "dst").distinct()


@query(f"""WITH RECURSIVE l AS ({LINKS}), e AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), r AS (SELECT src AS node, src AS seen FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src=r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def components(t):
    """Customers and suppliers that large orders join, by the smallest of each component."""
    return gr.components(links(t))


@query()
def components_all(t):
    """The same over all order lines."""
    return gr.components(links(t, "true"))


@query(f"""WITH l AS ({LINKS}), e AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), a AS (SELECT 1000001 AS node, 0 AS ring), b AS (SELECT DISTINCT dst AS node FROM e WHERE src=1000001), c AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM b)), d AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM c)) SELECT CAST(node AS BIGINT) AS node, CAST(min(ring) AS INTEGER) AS ring FROM (SELECT * FROM a UNION ALL SELECT node, 1 FROM b UNION ALL SELECT node, 2 FROM c UNION ALL SELECT node, 3 FROM d) GROUP BY 1""")
def bfs_rings(t):
    """Three steps round one supplier."""
    return gr.rings(links(t), 1000001, 3)


@query(SQL["bfs_rings"].replace(LINKS, LINKS_ALL))
def bfs_rings_all(t):
    """The same over all order lines."""
    return gr.rings(links(t, "true"), 1000001, 3)


@query("""SELECT node, layer FROM (SELECT CAST(r_regionkey AS INTEGER) AS node, 0 AS layer FROM region UNION ALL SELECT 100+n_nationkey, 1 FROM nation UNION ALL SELECT DISTINCT CAST(1000+s_suppkey AS INTEGER), 2 FROM supplier) WHERE node IN (SELECT n_regionkey FROM nation) OR node>=100""")
def dag_layers(t):
    """Longest paths: region, nation, supplier."""
    e = t.nation.select(F.col("n_regionkey").alias("src"), (F.col("n_nationkey") + 100).alias("dst")).unionAll(t.supplier.select((F.col("s_nationkey") + 100).alias("src"), (F.col("s_suppkey") + 1000).cast("int").alias("dst")))
    l = gr.layers(e)
    return l.join(e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct(), "node", "left_semi")


@query("""WITH u AS (SELECT id, token AS doc, a AS s, b AS e FROM chunks WHERE a<b), k AS (SELECT token AS doc, min(a) AS s, max(b) AS e FROM chunks WHERE a<b GROUP BY 1) SELECT u.id, k.doc AS parent FROM u JOIN k ON k.doc=u.doc AND k.s<=u.s AND k.e>=u.e""")
def interval_parents(t):
    """Spans under the smallest coarser span that holds them: chunks within their text."""
    c = t.chunks.filter("a < b")
    top = c.groupBy(F.col("token").alias("doc")).agg(F.min("a").alias("s"), F.max("b").alias("e")).select(F.col("doc").alias("id"), "doc", "s", "e", F.lit(0).alias("level"))
    low = c.select(F.col("id").cast("string"), F.col("token").alias("doc"), F.col("a").alias("s"), F.col("b").alias("e"), F.lit(1).alias("level"))
    return gr.interval_parents(top.unionByName(low), "doc").filter("parent is not null").select(F.col("id").cast("bigint").alias("id"), "parent")


@query("""WITH s AS (SELECT n_regionkey AS folder, count(*) AS n FROM supplier JOIN nation ON n_nationkey=s_nationkey GROUP BY 1) SELECT folder, CAST(0 AS BIGINT) AS direct, CAST(n AS BIGINT) AS subtree FROM s UNION ALL SELECT 100+n_nationkey, coalesce(k,0), CAST(coalesce(k,0) AS BIGINT) FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) ON s_nationkey=n_nationkey""")
def folder_counts(t):
    """A tree of regions and nations with suppliers in it: direct and in all below."""
    f = t.nation.select((F.col("n_nationkey") + 100).alias("node"), F.col("n_regionkey").alias("parent")).unionAll(t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"), "left_semi").select(F.col("r_regionkey").alias("node"), F.lit(None).cast("int").alias("parent")))
    return gr.folder_counts(f, t.supplier.select(F.col("s_suppkey").alias("source"), (F.col("s_nationkey") + 100).alias("folder")))


@query("""SELECT rel, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM (SELECT l_returnflag AS rel, l_suppkey AS src, l_partkey AS dst FROM lineitem) GROUP BY 1""")
def graph_stats(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("rel")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("sources"), F.count_distinct("l_partkey").alias("targets"))
