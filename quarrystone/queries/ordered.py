"""Runs, sessions, smoothing and other computations in order."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.operators import ordered as od
from quarrystone.queries.registry import query


def since_epoch(c: str, unit: str = "SECOND"):
    """Units of a zone-free time since 1970: the same in any session time zone."""
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def cues(t):
    return t.events.select("user_id", "event_id", "event_type", "value", (since_epoch("ts", "MICROSECOND") / 1e6).alias("s"))


X = "SELECT user_id, event_id, event_type, value, epoch_us(ts)/1e6 AS s FROM events"


@query(f"""WITH x AS ({X}), y AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), z AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, event_id) AS i FROM y) SELECT user_id, event_type, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM z GROUP BY user_id, i, event_type""")
def islands_runs(t):
    """Runs of one kind of event of a user."""
    return od.islands(cues(t), ["user_id"], ["s", "event_id"], "event_type", "event_id", "event_id").select("user_id", "event_type", "start", "end", "n")


@query("""SELECT o_orderkey, o_custkey, CAST((SELECT v FROM (SELECT unnest(a) AS v) GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) AS INTEGER) AS smoothed FROM (SELECT o_orderkey, o_custkey, list(CAST(left(o_orderpriority,1) AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM orders)""")
def mode5_smooth(t):
    """The most frequent of five neighbours, ties to the smallest."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.left("o_orderpriority", F.lit(1)).cast("int").alias("p"))
    return od.majority(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "p", 2).select("o_orderkey", "o_custkey", "smoothed")


@query(f"""WITH x AS ({X}), y AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 3600 THEN 0 ELSE 1 END AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), z AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS session FROM y) SELECT user_id, session, count(*) AS n, round(sum(value),4) AS total FROM z GROUP BY 1,2""")
def session_gaps(t):
    """Sessions of a user: a gap of more than an hour begins a new one."""
    s = od.sessions(cues(t), ["user_id"], F.col("s"), 3600.0, ["s", "event_id"])
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH x AS ({X}), y AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nx FROM x WHERE event_type='view'), z AS (SELECT user_id, list_sort(list(nx-s) FILTER (nx IS NOT NULL)) AS g FROM y GROUP BY 1) SELECT event_id, y.user_id, round(coalesce(nx, s + g[CAST(len(g)//2 AS INTEGER)+1]),3) AS "end" FROM y JOIN z ON y.user_id=z.user_id""")
def lead_cue_ends(t):
    """Ends of marks: the next mark, the last after the upper median gap."""
    return od.cue_ends(cues(t).filter("event_type = 'view'"), ["user_id"], "s").select("event_id", "user_id", F.round("end", 3).alias("end"))


@query("""SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS clamped FROM orders""")
def running_clamp(t):
    return od.clamp(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "clamped")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS w, CASE WHEN l_linenumber % 3 = 1 THEN l_extendedprice END AS v FROM lineitem),
d AS (SELECT *, sum(w) OVER b - w AS c, last_value(CASE WHEN v IS NOT NULL THEN {'v':v,'c':0.0} END IGNORE NULLS) OVER b AS p FROM x WINDOW b AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, w ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN c END IGNORE NULLS) OVER b AS pc, first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN c END IGNORE NULLS) OVER a AS nc FROM d WINDOW b AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, w ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(coalesce(v, p.v+(nv-p.v)*((c-pc)/nullif(nc-pc,0)), p.v, nv)*1000) AS BIGINT) AS filled FROM e""")
def gap_interpolation(t):
    """Prices known for every third line, spread between by quantity."""
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("w"), F.when(F.col("l_linenumber") % 3 == 1, F.col("l_extendedprice")).alias("v"))
    return od.interpolate(x, ["l_orderkey"], ["l_linenumber", "l_partkey", "w"], "v", "w").select("l_orderkey", "l_linenumber", "l_partkey", F.floor(F.col("filled") * 1000).alias("filled"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN lag(o_orderstatus) OVER w = o_orderstatus THEN 0 ELSE 1 END AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), y AS (SELECT x.*, sum(n) OVER (PARTITION BY x.o_custkey ORDER BY o.o_orderdate, x.o_orderkey) AS i FROM x JOIN orders o ON o.o_orderkey=x.o_orderkey), z AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, i) AS reps FROM y) SELECT o_custkey, o_orderkey, o_orderstatus, reps FROM z WHERE n=1""")
def repeat_collapse(t):
    """Orders in a row with the same status, kept once with their number."""
    return od.collapse_repeats(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus").drop("o_orderdate")


@query(f"""WITH x AS ({X}) SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS r FROM x) WHERE r=1""")
def first_seen(t):
    return od.first_seen(cues(t), ["user_id"], ["s", "event_id"], ["event_type"]).select("user_id", "event_type", "event_id")


@query(f"""WITH x AS ({X}), y AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS before FROM x) SELECT event_id, before, round(log2(abs(value/before)),6) AS log_ratio FROM y WHERE before<>0 AND abs(value/before-1)>=0.005""")
def figure_revisions(t):
    return od.revisions(cues(t), ["user_id", "event_type"], ["s", "event_id"], "value").select("event_id", "before", F.round("log_ratio", 6).alias("log_ratio"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority AS p, list(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS b FROM orders) SELECT o_orderkey, NOT list_contains(coalesce(b,[]), p) AS enters FROM x""")
def sliding_picture(t):
    """Whether something is new to the last 25 rows before it."""
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.array("o_orderpriority").alias("items"))
    return od.sliding_sets(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "items").select("o_orderkey", (F.size("entering") > 0).alias("enters"))


@query("""SELECT o_custkey, o_orderkey AS best, o_totalprice - nx AS gap FROM (SELECT *, row_number() OVER w AS r, lead(o_totalprice) OVER w AS nx FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE r=1""")
def runner_up_gap(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    x = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("r"), F.lead("o_totalprice").over(w).alias("nx"))
    return x.filter("r = 1").select("o_custkey", F.col("o_orderkey").alias("best"), (F.col("o_totalprice") - F.col("nx")).alias("gap"))


@query("""SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value),4) AS total, max(abs(value)) AS peak FROM events GROUP BY 1,2""")
def tumbling_sum(t):
    """Events by hour: count, sum and peak."""
    w = F.window("ts", "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max(F.abs("value")).alias("peak")).select(since_epoch("w.start").alias("hour"), "event_type", "n", "total", "peak")


@query("""SELECT CAST(epoch(b - INTERVAL (k) HOUR) AS BIGINT) AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events), range(0,3) r(k) GROUP BY 1""")
def sliding_counts(t):
    """Events in windows of three hours that begin every hour."""
    w = F.window("ts", "3 hours", "1 hour")
    return t.events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(since_epoch("w.start").alias("start"), "n")


@query()
def surprise_pass(t):
    """Excess of each line over what its order's lines before it said."""
    c = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"), (F.col("l_returnflag") == "R").alias("neg"), F.lit("price").alias("measure"), F.col("l_extendedprice").alias("value"))
    return od.surprise_pass(c)


@query()
def weighted_draws(t):
    """Parts drawn in proportion to their price, five per brand, the same on any cluster."""
    return od.cumulative_draws(t.part.select("p_brand", "p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 5, 3, ["p_brand"])
