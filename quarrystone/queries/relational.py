"""Filters, plans, joins, aggregates and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.functions import scalars as sc
from quarrystone.operators import aggregates as ag
from quarrystone.operators import joins as jn
from quarrystone.operators import oplog, ordered
from quarrystone.operators import search as se
from quarrystone.plans import filters as ft
from quarrystone.plans import plan as pl
from quarrystone.queries.registry import SQL, query
from quarrystone.sources import tabular as tb

BAND = "CASE WHEN coalesce(g.amount,0)=0 THEN 'none' WHEN g.amount<10000 THEN '<10k' WHEN g.amount<50000 THEN '10-50k' WHEN g.amount<250000 THEN '50-250k' WHEN g.amount<1000000 THEN '250k-1M' ELSE '1M+' END"


def band(a):
    return F.when(F.coalesce(a, F.lit(0.0)) == 0, "none").when(a < 10000, "<10k").when(a < 50000, "10-50k").when(a < 250000, "50-250k").when(a < 1000000, "250k-1M").otherwise("1M+")


@query("""SELECT r, c, level, value FROM (SELECT n_name AS r, CAST(year(o_orderdate) AS VARCHAR) AS c, CAST(grouping(n_name, CAST(year(o_orderdate) AS VARCHAR)) AS INTEGER) AS level, count(*) AS value
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY CUBE (n_name, CAST(year(o_orderdate) AS VARCHAR)))""")
def pivot_nation_year(t):
    """Orders by nation and year with all totals."""
    o = t.orders.select("o_custkey", "o_orderdate").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return ag.pivot_totals(o, F.col("n_name"), F.year("o_orderdate").cast("string"), F.count("*"))


MEASURES = "count(*) AS n, round(sum(coalesce(g.amount,0)),2) AS amount, round(avg(nullif(g.amount,0)),2) AS mean, round(max(g.amount),2) AS top, count(DISTINCT c.party) AS vendors"


@query(f"""SELECT coalesce(nullif(c.status,''),'unknown') AS status, {BAND} AS band, {MEASURES} FROM contracts c LEFT JOIN gist g ON g.token=c.token GROUP BY 1,2""")
def measures_by_band(t):
    j = jn.enrich(t.contracts.select("token", "status", "party"), t.gist.select("token", "amount"), "token")
    a = F.col("amount")
    return j.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status"), band(a).alias("band")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.coalesce(a, F.lit(0.0))), 2).alias("amount"), F.round(F.avg(F.nullif(a, F.lit(0.0))), 2).alias("mean"), F.round(F.max(a), 2).alias("top"), F.count_distinct("party").alias("vendors")
    )


@query("""SELECT token, number, party, department, expires, status, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY fetched_at DESC, number DESC NULLS LAST, party DESC NULLS LAST, department DESC NULLS LAST, description DESC NULLS LAST, expires DESC NULLS LAST, status DESC NULLS LAST) AS r FROM contracts WHERE trim(coalesce(token,''))<>'') WHERE r=1""")
def contracts_refresh(t):
    """The last fetch of each contract."""
    return tb.refresh_by_key(t.contracts.select("token", "number", "party", "department", "description", "expires", "status", "fetched_at"), "token", "fetched_at").drop("description")


@query(f"""SELECT c.token, CASE WHEN regexp_matches(rtrim(coalesce(c.expires,'')),'[12][09][0-9][0-9]$') THEN right(rtrim(c.expires),4) ELSE 'unknown' END AS year, coalesce(nullif(c.status,''),'unknown') AS status,
CASE coalesce(g.read,'') WHEN 'ledger' THEN 'clauses' WHEN 'text' THEN 'text' ELSE 'unread' END AS reading, {BAND} AS band, CASE WHEN regexp_matches(coalesce(c.number,''),'^[A-Za-z]') THEN upper(substr(c.number,1,1)) ELSE 'numeric' END AS series
FROM contracts c LEFT JOIN gist g ON g.token=c.token""")
def derived_dims(t):
    j = t.contracts.join(t.gist.select("token", "read", "amount"), "token", "left")
    read = F.coalesce("read", F.lit(""))
    return j.select(
        "token", sc.expiry_year("expires").alias("year"), F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status"),
        F.when(read == "ledger", "clauses").when(read == "text", "text").otherwise("unread").alias("reading"), band(F.col("amount")).alias("band"),
        F.when(F.coalesce("number", F.lit("")).rlike("^[A-Za-z]"), F.upper(F.substring("number", 1, 1))).otherwise("numeric").alias("series"),
    )


TREE = ft.group("and", ft.condition("department", "isnot", "LAW"), ft.group("or", ft.condition("status", "is", "active"), ft.condition("party", "contains", "services"), ft.condition("", "is", "x")), ft.condition("expires", "notempty"), ft.group("or"))


@query("""SELECT token, party, status, fetched_at FROM contracts WHERE lower(trim(coalesce(department,'')))<>'law' AND (lower(trim(coalesce(status,'')))='active' OR contains(lower(trim(coalesce(party,''))),'services')) AND trim(coalesce(expires,''))<>''""")
def filter_tree_nested(t):
    """A nested tree with an unfinished condition and an empty group, which filter nothing."""
    return ft.apply(t.contracts, TREE).select("token", "party", "status", "fetched_at")


@query("""SELECT trim(department) AS value, count(*) AS n FROM contracts WHERE trim(coalesce(department,''))<>'' GROUP BY 1""")
def facet_counts(t):
    return ft.facet(t.contracts, "department")


@query("""SELECT trim(status) AS value, count(*) AS n FROM contracts WHERE trim(coalesce(status,''))<>'' AND lower(trim(coalesce(department,'')))='water' GROUP BY 1""")
def facet_without(t):
    """Counts of a field under the rest of the filter."""
    return ft.facet(t.contracts, "status", ft.group("and", ft.condition("department", "is", "water"), ft.condition("status", "is", "Active")))


@query("""SELECT department, count(*) AS n FROM contracts WHERE department<>'' GROUP BY 1""")
def department_counts(t):
    return t.contracts.filter("department <> ''").groupBy("department").agg(F.count("*").alias("n")).orderBy(F.lower("department"))


@query("""SELECT l_returnflag, round(sum(l_extendedprice),2) AS value FROM lineitem WHERE l_quantity>=10 AND l_quantity<40 GROUP BY 1""")
def plan_aggregate(t):
    p = pl.Plan.from_json('{"type":"lineitem","intent":"aggregate","filters":[{"field":"l_quantity","op":"gte","value":"10"},{"field":"l_quantity","op":"lt","value":"40"}],"agg":{"fn":"sum","field":"l_extendedprice","groupBy":"l_returnflag"}}')
    return pl.compile_plan(p, {"lineitem": t.lineitem}).withColumn("value", F.round("value", 2))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE contains(lower(trim(o_orderpriority)),'urgent') ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def plan_sort_limit(t):
    """A top list, as a plan."""
    p = pl.Plan(type="orders", filters=[{"field": "o_orderpriority", "op": "contains", "value": "urgent"}], sort={"field": "o_totalprice", "dir": "desc"}, limit=25)
    return pl.compile_plan(p, {"orders": t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")}).select("o_orderkey", "o_totalprice")


@query("""SELECT token, party FROM contracts WHERE department IN ('WATER','PARKS') AND coalesce(nullif(status,''),'unknown')='Active' AND token IN (SELECT token FROM obs WHERE contains(lower(verbatim),'hydrant'))""")
def where_clause(t):
    """Departments, a dimension and a text query's match set together."""
    hits = t.obs.filter(F.contains(F.lower("verbatim"), F.lit("hydrant"))).select("token")
    c = t.contracts.filter(F.col("department").isin("WATER", "PARKS") & (F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")) == "Active"))
    return jn.semi_match(c, hits, "token").select("token", "party")


@query("""SELECT o_orderkey, o_totalprice, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey""")
def left_enrich(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return jn.enrich(t.orders.select("o_orderkey", "o_totalprice"), n, "o_orderkey")


@query("""SELECT DISTINCT token FROM obs WHERE kind='amount' UNION SELECT token FROM contracts WHERE contains(lower(coalesce(description,'')),'lease')""")
def semi_match_union(t):
    """A match set: header hits and observation hits."""
    return t.obs.filter("kind = 'amount'").select("token").union(t.contracts.filter(F.contains(F.lower("description"), F.lit("lease"))).select("token")).distinct()


@query("""SELECT DISTINCT token FROM obs WHERE token NOT IN (SELECT token FROM contracts WHERE token IS NOT NULL) AND token IS NOT NULL""")
def anti_diff(t):
    return t.obs.select("token").filter("token is not null").distinct().join(t.contracts.select("token"), "token", "left_anti")


@query("""WITH x AS (SELECT DISTINCT token, email FROM signers WHERE email<>''), n AS (SELECT email, count(*) AS k FROM x GROUP BY 1) SELECT x.token, x.email AS attribute, k AS group_size FROM x JOIN n ON n.email=x.email""")
def shared_signer_groups(t):
    """Contracts of one signer, one row per contract and address."""
    return jn.shared_groups(t.signers, "token", F.col("email"))


@query("""SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS prior, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lineage_prior_next(t):
    return jn.prior_next(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_orderkey").select("o_orderkey", "o_custkey", "prior", "next")


@query("""WITH s AS (SELECT user_id, ts, max(event_id) AS state FROM events WHERE event_type='signup' GROUP BY 1,2), f AS (SELECT event_id, user_id, ts FROM events WHERE event_type='purchase')
SELECT f.event_id, f.user_id, s.state FROM f ASOF LEFT JOIN s ON f.user_id=s.user_id AND f.ts>=s.ts""")
def asof_role(t):
    """Each purchase with the user's last signup at or before it."""
    e = t.events
    s = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("state"))
    f = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return jn.as_of(f, s, ["user_id"], "ts", "since", "state").select("event_id", "user_id", "state")


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id=b.user_id AND a.event_type='view' AND b.event_type='click' AND abs(epoch_us(a.ts)-epoch_us(b.ts))<=600000000""")
def band_join_events(t):
    """Views and clicks of a user within ten minutes of each other."""
    e = t.events.select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    a = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("a"), F.col("s").alias("sa"))
    b = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("b"), F.col("s").alias("sb"))
    return jn.band(a, b, ["user_id"], "sa", "sb", 600.0).select("a", "b")


@query("""SELECT o.id AS obs_id, c.id AS chunk_id FROM obs o JOIN chunks c ON o.token=c.token AND o.a<c.b AND c.a<o.b AND o.a<o.b AND c.a<c.b""")
def span_overlap(t):
    """Observations and the chunks of the same text they stand in."""
    o = t.obs.filter("a < b").select("token", F.col("id").alias("obs_id"), F.col("a").alias("oa"), F.col("b").alias("ob"))
    c = t.chunks.filter("a < b").select("token", F.col("id").alias("chunk_id"), F.col("a").alias("ca"), F.col("b").alias("cb"))
    return jn.bucketed_range(o, c, ["token"], "oa", "ob", "ca", "cb", 1000.0).select("obs_id", "chunk_id")


CUES = "SELECT user_id, event_id, epoch_us(ts)/1e6 AS s, epoch_us(ts)/1e6+value*60 AS e, event_type FROM events"


@query(f"""WITH x AS ({CUES}) SELECT p.event_id AS cue_a, q.event_id AS cue_b FROM x p JOIN x q ON p.user_id=q.user_id AND p.event_type='view' AND q.event_type='error' AND p.s<q.e AND q.s<p.e AND least(p.e,q.e)-greatest(p.s,q.s)>=0.5*least(p.e-p.s,q.e-q.s)""")
def interval_overlap(t):
    """Cues of two kinds that overlap by half of the shorter."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    x = t.events.select("user_id", "event_id", "event_type", s.alias("s"), (s + F.col("value") * 60).alias("e"))
    a = x.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("cue_a"), F.col("s").alias("sa"), F.col("e").alias("ea"))
    b = x.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("cue_b"), F.col("s").alias("sb"), F.col("e").alias("eb"))
    return jn.aligned_cues(a, b, ["user_id"], 7200.0).select("cue_a", "cue_b")


@query("""SELECT p_partkey, p_name, CAST(list_count(list_filter(string_split(lower(p_name),' '), lambda w: length(w)>=4)) AS INTEGER) AS words, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS place FROM part""")
def plan_projection(t):
    """A projection with a row number."""
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return t.part.select("p_partkey", "p_name", F.size(F.filter(F.split(F.lower("p_name"), " "), lambda x: F.length(x) >= 4)).alias("words"), F.row_number().over(w).cast("bigint").alias("place"))


@query("""WITH x AS (SELECT token, party, try_strptime(trim(coalesce(expires,'')), '%m/%d/%Y') AS d, list_distinct(regexp_extract_all(lower(coalesce(description,'')),'[a-z]{4,}')) AS w FROM (SELECT DISTINCT token, party, expires, description FROM contracts) WHERE party<>''),
y AS (SELECT token, w, lead(token) OVER o AS successor, lead(w) OVER o AS n FROM x WHERE d IS NOT NULL WINDOW o AS (PARTITION BY party ORDER BY d, token, w))
SELECT token, successor FROM y WHERE list_has_any(w, n) AND successor<>token""")
def successor_chain(t):
    """The next contract of a party whose description shares a word."""
    x = t.contracts.select("token", "party", "expires", "description").distinct().filter("party <> ''")
    x = x.withColumn("d", sc.us_date("expires")).withColumn("w", F.array_distinct(F.regexp_extract_all(F.lower(sc.text_of("description")), F.lit("[a-z]{4,}"), F.lit(0))))
    w = Window.partitionBy("party").orderBy("d", "token", "w")
    y = x.filter("d is not null").select("token", "w", F.lead("token").over(w).alias("successor"), F.lead("w").over(w).alias("n"))
    return y.filter(F.arrays_overlap("w", "n") & (F.col("successor") != F.col("token"))).select("token", "successor")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey=o_orderkey WHERE l_quantity>48), f AS (SELECT DISTINCT s_suppkey AS src, s_nationkey+100000 AS dst FROM supplier), g AS (SELECT * FROM e UNION SELECT * FROM f)
SELECT x.src AS a, y.dst AS c, count(*) AS ways FROM g x JOIN g y ON x.dst=y.src WHERE x.src<>y.dst AND x.src<>x.dst AND y.src<>y.dst GROUP BY 1,2""")
def two_hop_compose(t, where="l_quantity > 48"):
    e = t.lineitem.filter(where).select("l_orderkey", F.col("l_suppkey").alias("dst")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src")), "l_orderkey").select("src", "dst")
    f = t.supplier.select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + 100000).cast("bigint").alias("dst"))
    return jn.two_hop(e.unionByName(f).distinct())


@query(SQL["two_hop_compose"].replace(" WHERE l_quantity>48", ""))
def two_hop_compose_all(t):
    """The same over all order lines."""
    return two_hop_compose(t, "true")


@query("""WITH l AS (SELECT token, amount FROM gist WHERE read='ledger'), r AS (SELECT DISTINCT token FROM obs WHERE kind='amount') SELECT l.token AS left_id, r.token AS right_id, CASE WHEN r.token IS NULL THEN 'left' WHEN l.token IS NULL THEN 'right' ELSE 'both' END AS side FROM l FULL JOIN r ON l.token=r.token""")
def seam(t):
    """Two sides paired: both, left only, right only."""
    l, r = t.gist.filter("read = 'ledger'").select(F.col("token").alias("id")), t.obs.filter("kind = 'amount'").select(F.col("token").alias("id")).distinct()
    return jn.full_seam(l, r, l.join(r, "id").select(F.col("id").alias("left_id"), F.col("id").alias("right_id")))


@query("""WITH n AS (SELECT party, trim(regexp_replace(lower(party),'[^\\p{L}\\p{N}]+',' ','g')) AS t FROM (SELECT DISTINCT party FROM contracts WHERE party IS NOT NULL)) SELECT a.party AS whole, b.party AS part FROM n a JOIN n b ON a.party<>b.party AND b.t<>'' AND length(a.t)>length(b.t) AND contains(' '||a.t||' ', ' '||b.t||' ')""")
def title_containment(t):
    """Names that hold another whole name."""
    return jn.contained_titles(t.contracts.select("party").filter("party is not null").distinct(), "party", "party")


@query("""WITH f AS (SELECT DISTINCT o_orderkey FROM orders), x AS (SELECT o_orderkey, o_orderpriority AS grp FROM orders), a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag='R'), s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus='O')
SELECT grp, count(*) AS found, count(*) FILTER (a.k IS NOT NULL) AS archived, count(*) FILTER (a.k IS NULL AND s.k IS NOT NULL) AS queue, count(*) FILTER (a.k IS NULL AND s.k IS NULL) AS backlog, round(100.0*count(*) FILTER (a.k IS NOT NULL)/count(*),4) AS pct_archived
FROM x LEFT JOIN a ON a.k=x.o_orderkey LEFT JOIN s ON s.k=x.o_orderkey GROUP BY 1""")
def funnel_by_priority(t):
    found = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("grp"), "o_orderdate")
    l = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_linestatus")
    return ag.funnel(found, l.filter("l_linestatus = 'O'"), l.filter("l_returnflag = 'R'"), "k", "grp", "o_orderdate")


@query("""WITH f AS (SELECT token FROM contracts WHERE token IS NOT NULL), x AS (SELECT token FROM gist WHERE token IS NOT NULL), a AS (SELECT token FROM obs WHERE kind='amount' AND token IS NOT NULL)
SELECT 'archived' AS bucket, count(DISTINCT token) AS n FROM a UNION ALL SELECT 'queue', count(*) FROM (SELECT token FROM x EXCEPT SELECT token FROM a) UNION ALL SELECT 'backlog', count(*) FROM (SELECT token FROM f EXCEPT SELECT token FROM x EXCEPT SELECT token FROM a) UNION ALL SELECT 'outside', count(*) FROM ((SELECT token FROM x UNION SELECT token FROM a) EXCEPT SELECT token FROM f)""")
def reconcile_sets(t):
    return ag.reconcile_sets(t.contracts, t.gist, t.obs.filter("kind = 'amount'"), "token")


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT count(*) FILTER (ts > now - INTERVAL 6000 MINUTE) AS n, count(*) FILTER (ts > now - INTERVAL 6000 MINUTE)/6000.0 AS per_min, round(1000000/nullif(count(*) FILTER (ts > now - INTERVAL 6000 MINUTE)/6000.0,0)/60,6) AS eta_hours FROM events, m""")
def windowed_rate_eta(t):
    e = t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))
    return ag.rate_eta(e, "ts", F.col("now"), 6000, F.lit(1000000))


@query("""SELECT regexp_replace(trim(regexp_replace(verbatim,'\\s+',' ','g')),'[0-9]+','#','g')[:40] AS kind, count(*) AS n FROM obs WHERE verbatim IS NOT NULL GROUP BY 1""")
def reason_histogram(t):
    k = F.substring(F.regexp_replace(F.trim(F.regexp_replace("verbatim", r"\s+", " ")), "[0-9]+", "#"), 1, 40)
    return t.obs.filter("verbatim is not null").groupBy(k.alias("kind")).agg(F.count("*").alias("n"))


FIELDS = ["token", "number", "party", "department", "expires", "status", "fetched_at", "archive_url"]


def _profile(f):
    t = f"trim(coalesce({f},''))"
    a = lambda p: f"coalesce(bool_and(CASE WHEN {t}<>'' THEN regexp_full_match({t},'{p}') END),false)"
    return f"""SELECT '{f}' AS field, count(*) FILTER ({t}<>'') AS filled, count(DISTINCT CASE WHEN {t}<>'' THEN {t} END) AS n_distinct, round(count(*) FILTER ({t}<>'')/count(*),6) AS coverage, round(avg(CASE WHEN {t}<>'' THEN length({t}) END),4) AS mean_length,
CASE WHEN count(*) FILTER ({t}<>'')=0 THEN 'empty' WHEN {a("-?[0-9]+([.][0-9]+)?")} THEN 'number' WHEN {a("(?i)(true|false)")} THEN 'boolean' WHEN {a("[0-9]{4}-[0-9]{2}(-[0-9]{2})?")} THEN 'date' WHEN {a("https?://[^ ]+")} THEN 'url' WHEN {a("[(]?[-+]?[$]?[-+]?[0-9][0-9,]*([.][0-9]+)?%?[)]?")} AND count(*) FILTER ({t}<>'')>=3 THEN 'number in text'
WHEN count(*) FILTER ({t}<>'')>=4 AND count(DISTINCT CASE WHEN {t}<>'' THEN {t} END)<=greatest(2,round(sqrt(count(*) FILTER ({t}<>'')))) AND count(DISTINCT CASE WHEN {t}<>'' THEN {t} END)<=40 AND count(DISTINCT CASE WHEN {t}<>'' THEN {t} END)<count(*) FILTER ({t}<>'') THEN 'select' WHEN avg(CASE WHEN {t}<>'' THEN length({t}) END)>140 THEN 'longtext' ELSE 'text' END AS kind FROM contracts"""


@query(" UNION ALL ".join(map(_profile, FIELDS)))
def profile_fields(t):
    """The schema that contract rows show."""
    return ag.profile_fields(t.contracts, FIELDS)


@query("""WITH e AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS src, o_orderpriority AS dst FROM orders), o AS (SELECT src, count(*) AS k FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS k FROM e GROUP BY 1)
SELECT 'customer' AS from_type, 'ordered at' AS rel, 'priority' AS to_type, CAST((SELECT sum(k) FROM o) AS BIGINT) AS n, (SELECT max(k) FROM o) AS out_max, (SELECT max(k) FROM i) AS in_max, (CASE WHEN (SELECT max(k) FROM i)>1 THEN 'many' ELSE 'one' END)||'-to-'||(CASE WHEN (SELECT max(k) FROM o)>1 THEN 'many' ELSE 'one' END) AS cardinality""")
def link_cardinality(t):
    return ag.link_cardinality(t.orders.select(F.col("o_custkey").cast("string").alias("src"), F.lit("customer").alias("from_type"), F.lit("ordered at").alias("rel"), F.col("o_orderpriority").alias("dst"), F.lit("priority").alias("to_type")))


@query("""SELECT DISTINCT token AS subject, relation, object FROM (SELECT token, 'department' AS relation, trim(coalesce(department,'')) AS object FROM contracts UNION ALL SELECT token, 'status', trim(coalesce(status,'')) FROM contracts UNION ALL SELECT token, 'party', trim(coalesce(party,'')) FROM contracts) WHERE token IS NOT NULL AND object<>''""")
def unpivot_triples(t):
    return ag.unpivot_triples(t.contracts, "token", ["department", "status", "party"])


@query("""WITH x AS (SELECT DISTINCT token AS subject, relation, object FROM (SELECT token, 'department' AS relation, trim(coalesce(department,'')) AS object FROM contracts UNION ALL SELECT token, 'status', trim(coalesce(status,'')) FROM contracts) WHERE token IS NOT NULL AND object<>'') SELECT relation, object, count(*) AS n, list_aggregate(list_sort(list(subject)),'string_agg',',') AS subjects FROM x GROUP BY 1,2""")
def value_provenance(t):
    p = ag.provenance(ag.unpivot_triples(t.contracts, "token", ["department", "status"]))
    return p.withColumn("subjects", F.array_join("subjects", ","))


@query("""WITH x AS (SELECT DISTINCT token AS subject, relation FROM (SELECT token, 'department' AS relation, trim(coalesce(department,'')) AS object FROM contracts UNION ALL SELECT token, 'status', trim(coalesce(status,'')) FROM contracts UNION ALL SELECT token, 'party', trim(coalesce(party,'')) FROM contracts) WHERE token IS NOT NULL AND object<>'') SELECT characteristics, count(*) AS n FROM (SELECT subject, list_aggregate(list_sort(list(relation)),'string_agg',',') AS characteristics FROM x GROUP BY 1) GROUP BY 1""")
def entity_kinds(t):
    return ag.kinds(ag.unpivot_triples(t.contracts, "token", ["department", "status", "party"]))


@query("""SELECT party, kind, n FROM (SELECT c.party, o.kind, count(*) AS n, row_number() OVER (PARTITION BY c.party ORDER BY count(*) DESC, o.kind) AS r FROM obs o JOIN (SELECT DISTINCT token, party FROM contracts) c ON c.token=o.token WHERE o.kind NOT IN ('') GROUP BY 1,2) WHERE r=1""")
def dominant_relation(t):
    j = t.obs.join(t.contracts.select("token", "party").distinct(), "token")
    return ag.dominant(j.filter("kind is not null"), ["party"], "kind", [""])


@query("""SELECT token, coalesce(max(TRY_CAST(replace(regexp_extract(coalesce(CASE WHEN json_valid(fields) THEN json_extract_string(fields,'$.amount') END,''),'[$][ ]?([0-9,]+([.][0-9]+)?)',1),',','') AS DOUBLE)),0) AS amount FROM obs GROUP BY 1""")
def max_figure(t):
    """The largest amount of each contract's observations; broken JSON counts as none."""
    return ag.max_amount(t.obs, "token", "fields")


@query("""WITH x AS (SELECT token, verbatim, row_number() OVER (PARTITION BY token ORDER BY a NULLS FIRST, id) AS r FROM obs WHERE verbatim IS NOT NULL) SELECT token, trim(regexp_replace(string_agg(verbatim,' ' ORDER BY r),'\\s+',' ','g'))[:1600] AS gist FROM x WHERE r<=14 GROUP BY 1""")
def first_k_gist(t):
    """The first 14 observations of each contract, joined and cut."""
    return ag.first_k(t.obs, "token", ["a", "id"], "verbatim", 14)


@query("""WITH s AS (SELECT o_orderpriority AS label, o_orderstatus AS format, count(*) AS n FROM orders GROUP BY 1,2) SELECT label, arg_max(format, n) AS format, CAST(sum(n) AS BIGINT) AS support, round(max(n)/sum(n),6) AS confidence FROM s GROUP BY 1 HAVING max(n)/sum(n)>=0.3""")
def rule_learning(t):
    """The majority format of a label, where it is clear enough."""
    return ag.learn_rules(t.orders.select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("format")), 3, 0.3)


@query("""WITH r AS (SELECT DISTINCT token AS doc, 'status' AS label, status AS value FROM contracts WHERE status='Active'), t AS (SELECT DISTINCT token AS doc, 'status' AS label, status AS value FROM contracts WHERE department='WATER'), h AS (SELECT count(*) AS hits FROM r JOIN t USING (doc,label,value)) SELECT hits, round(hits/(SELECT count(*) FROM t),6) AS recall, round(hits/(SELECT count(*) FROM r),6) AS precision FROM h""")
def score_read(t):
    x = t.contracts.select(F.col("token").alias("doc"), F.lit("status").alias("label"), F.col("status").alias("value"), "department")
    return ag.score_read(x.filter("value = 'Active'"), x.filter("department = 'WATER'"))


@query("""SELECT l_partkey AS key, count(DISTINCT l_suppkey) AS witnesses, count(DISTINCT l_returnflag) AS n_values, CASE WHEN count(DISTINCT l_suppkey)<2 THEN 'single' WHEN count(DISTINCT l_returnflag)=1 THEN 'agreement' ELSE 'conflict' END AS verdict FROM lineitem GROUP BY 1""")
def reconcile_claims(t):
    return ag.reconcile_claims(t.lineitem.select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("value"), F.col("l_suppkey").alias("eye")))


@query("""SELECT least(o_custkey % 97, l_suppkey % 97) AS a, greatest(o_custkey % 97, l_suppkey % 97) AS b, count(*) FILTER (l_returnflag<>'R') AS pos, count(*) FILTER (l_returnflag='R') AS neg FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1,2 HAVING count(*) FILTER (l_returnflag<>'R')>0 AND count(*) FILTER (l_returnflag='R')>0""")
def contests_polarity(t):
    """Pairs of keys (97 classes of each) that edges both affirm and deny."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return ag.contests(j.select((F.col("o_custkey") % 97).alias("src"), (F.col("l_suppkey") % 97).alias("dst"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("polarity")))


@query("""SELECT o_orderpriority, o_orderstatus, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL""")
def merge_counts(t):
    """Readings merged: partial counts summed by key."""
    part = t.orders.groupBy("o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 7).alias("reading")).agg(F.count("*").alias("n"))
    return ag.merge_counts(part, ["o_orderpriority", "o_orderstatus"], ["n"])


@query("""SELECT name AS key, count(*) AS mentions, count(DISTINCT token) AS sources, 10*count(*)+count(DISTINCT token) AS score FROM signers GROUP BY 1 ORDER BY score DESC, key LIMIT 3000""")
def ranked_cast(t):
    """Names by mentions and sources; the reader's list holds 3000."""
    cast = t.signers.groupBy(F.col("name").alias("key")).agg(F.count("*").alias("mentions"), F.count_distinct("token").alias("sources"))
    return oplog.ranked_cast(cast)


@query("""SELECT token, path, value FROM (SELECT token, path, value, row_number() OVER (PARTITION BY token, path ORDER BY fetched_at DESC, value DESC) AS r FROM (SELECT token, fetched_at, 'party' AS path, party AS value FROM contracts UNION ALL SELECT token, fetched_at, 'status', status FROM contracts) WHERE token IS NOT NULL) WHERE r=1 AND value IS NOT NULL""")
def oplog_latest_state(t):
    """Entities folded from an operator log: the last value of each path."""
    e = t.contracts.select("token", "fetched_at", F.explode(F.array(F.struct(F.lit("party").alias("path"), F.col("party").alias("value")), F.struct(F.lit("status").alias("path"), F.col("status").alias("value")))).alias("x"))
    s = oplog.fold_entities(e.select(F.col("token").alias("anchor"), "x.path", "x.value", F.col("fetched_at").alias("ts"), F.coalesce("x.value", F.lit("")).alias("event_id")))
    return s.select(F.col("anchor").alias("token"), "path", "value")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 'current' ELSE 'superseded' END AS status, lead(o_orderkey) OVER w AS successor FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def supersede_latest(t):
    return ordered.superseded(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").drop("o_orderdate")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type<>'error') WHERE r=1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type='error' AND value>200)""")
def tombstone_fold(t):
    """The last row of each user that was never removed."""
    e = t.events
    return oplog.tombstoned(e.filter("event_type <> 'error'"), e.filter("event_type = 'error' and value > 200").select("user_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("""SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1""")
def latest_event(t):
    """One row: the last event."""
    return oplog.latest_event(t.events.select("ts", "event_id", "event_type", "value"), "ts").select("event_id", "event_type", "value")


@query("""WITH d AS (SELECT event_id % 1000 AS id, arg_max(event_type, event_id) AS decision FROM events WHERE event_type IN ('click','purchase') GROUP BY 1) SELECT o.id, coalesce(d.decision,'open') AS decision FROM obs o LEFT JOIN d ON d.id=o.id""")
def link_decisions(t):
    """Links with the last decision on each."""
    dec = t.events.filter("event_type in ('click', 'purchase')").select((F.col("event_id") % 1000).alias("id"), F.col("event_type").alias("decision"), F.lit(None).cast("string").alias("relation"), F.col("event_id").alias("ts"), "event_id")
    return oplog.resolve_links(t.obs.select("id", F.lit("same").alias("relation")), dec).select("id", "decision")


@query("""SELECT event_id, CASE WHEN n IS NULL THEN 'no role then' WHEN role NOT IN ('click','view') THEN 'role was '||role END AS why FROM (SELECT f.event_id, s.role, s.user_id AS n FROM (SELECT event_id, user_id, ts FROM events WHERE event_type='purchase') f ASOF LEFT JOIN (SELECT user_id, ts, max(event_type) AS role FROM events WHERE event_type<>'purchase' GROUP BY 1,2) s ON f.user_id=s.user_id AND f.ts>=s.ts)""")
def event_gate(t):
    """Events by whether the sender's state then allowed them, with the reason."""
    e = t.events
    led = e.filter("event_type <> 'purchase'").select(F.col("user_id").alias("sender"), F.col("ts").alias("since"), F.col("event_type").alias("role"))
    return oplog.gate(e.filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("sender"), "ts"), led, ["click", "view"]).select("event_id", "why")


@query("""SELECT token, party, number FROM (SELECT DISTINCT token, party, number FROM contracts) ORDER BY lower(party) NULLS FIRST, number, token LIMIT 40 OFFSET 20""")
def paged_search(t):
    """A page in the order of names, case aside."""
    return se.paged(t.contracts.select("token", "party", "number").distinct(), [F.lower("party").asc_nulls_first(), F.col("number").asc_nulls_last(), F.col("token")], 20, 40)[1]


@query("""SELECT token, expires FROM contracts ORDER BY right(coalesce(expires,''),4) DESC, coalesce(expires,'') DESC, token, fetched_at""")
def named_sorts(t):
    """Contracts in the order of expiry years, then texts; tests/test_core.py looks at the order."""
    return t.contracts.orderBy(F.right(sc.text_of("expires"), F.lit(4)).desc(), sc.text_of("expires").desc(), "token", "fetched_at").select("token", "expires")


@query("""SELECT kind, status, count(*) AS n, count(DISTINCT o.token) AS tokens FROM obs o LEFT JOIN (SELECT token, max(status) AS status FROM contracts GROUP BY 1) c ON c.token=o.token GROUP BY 1,2""")
def source_rollup(t):
    c = t.contracts.groupBy("token").agg(F.max("status").alias("status"))
    return jn.enrich(t.obs, c, "token").groupBy("kind", "status").agg(F.count("*").alias("n"), F.count_distinct("token").alias("tokens"))


@query("""SELECT CAST(o_custkey % 50 AS BIGINT) AS doc, count(*) AS links, count(*) FILTER (l_returnflag='R') AS differs FROM (SELECT DISTINCT o_custkey, l_suppkey, l_returnflag FROM orders JOIN lineitem ON l_orderkey=o_orderkey) GROUP BY 1""")
def link_tally(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", "l_returnflag").distinct()
    return j.groupBy((F.col("o_custkey") % 50).alias("doc")).agg(F.count("*").alias("links"), F.count_if(F.col("l_returnflag") == "R").alias("differs"))


@query("""SELECT least(l_suppkey,o_custkey) AS a, greatest(l_suppkey,o_custkey) AS b, l_returnflag AS relation, count(*) AS n FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1,2,3 HAVING count(*)>=2""")
def pattern_bundles(t):
    """The same relation between the same two, twice or more."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.least("l_suppkey", "o_custkey").alias("a"), F.greatest("l_suppkey", "o_custkey").alias("b"), F.col("l_returnflag").alias("relation")).agg(F.count("*").alias("n")).filter("n >= 2")
