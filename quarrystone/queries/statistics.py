"""Keyness, support, pairs and other evidence."""

from pyspark.sql import functions as F

from quarrystone.functions import scalars as sc
from quarrystone.operators import contradictions as cd
from quarrystone.operators import evidence as ev
from quarrystone.operators import nulls as nl
from quarrystone.operators import pairs as pr
from quarrystone.queries.registry import SQL, query
from quarrystone.session import cut

W = "SELECT id, token AS doc, lower(w) AS stem FROM (SELECT id, token, unnest(regexp_extract_all(lower(coalesce(verbatim,'')),'[a-z]{4,}')) AS w FROM obs)"


def words(t):
    return t.obs.select("id", F.col("token").alias("doc"), F.explode(F.regexp_extract_all(F.lower(sc.text_of("verbatim")), F.lit("[a-z]{4,}"), F.lit(0))).alias("stem"))


@query(f"""WITH w AS ({W}), c AS (SELECT stem, count(*) AS n FROM w GROUP BY 1) SELECT stem, round((n+1)/((SELECT sum(n) FROM c)+(SELECT count(*) FROM c)+1),9) AS p FROM c""")
def background_model(t):
    c = words(t).groupBy("stem").agg(F.count("*").alias("n"))
    return ev.background(c).withColumn("p", F.round("p", 9))


@query(f"""WITH w AS ({W}), c AS (SELECT stem, count(*) AS n FROM w GROUP BY 1), b AS (SELECT stem, (n+1)/((SELECT sum(n) FROM c)+(SELECT count(*) FROM c)+1) AS p FROM c), d AS (SELECT doc, stem, count(*) AS n FROM w GROUP BY 1,2), l AS (SELECT doc, sum(n) AS len FROM d GROUP BY 1) SELECT d.doc, round(sum(CASE WHEN n>len*p THEN 2*(n*ln(n/(len*p))-(n-len*p)) ELSE 0 END),4) AS g FROM d JOIN l ON l.doc IS NOT DISTINCT FROM d.doc JOIN b ON b.stem=d.stem WHERE d.doc IS NOT NULL GROUP BY 1""")
def keyness_g(t):
    """How far each contract's words exceed the whole's."""
    w = words(t)
    bg = ev.background(w.groupBy("stem").agg(F.count("*").alias("n")))
    d = w.filter("doc is not null").groupBy("doc", "stem").agg(F.count("*").alias("n"))
    return ev.keyness(d, bg).withColumn("g", F.round("g", 4))


@query("""WITH s AS (SELECT name, count(DISTINCT token) AS s FROM signers GROUP BY 1) SELECT (SELECT count(DISTINCT token) FROM signers) AS n, (SELECT count(*) FROM s WHERE s=1) AS f1, (SELECT count(*) FROM s WHERE s=1)/(SELECT count(DISTINCT token) FROM signers) AS unseen""")
def good_turing_f1(t):
    """Signers: how many contracts, single ones, and the share still unseen."""
    return ev.good_turing(t.signers, "name", "token")


@query("""WITH d AS (SELECT DISTINCT name, token FROM signers), s AS (SELECT name, count(*) AS s FROM d GROUP BY 1), l AS (SELECT token, count(*) FILTER (s=1) AS own, count(*) FILTER (s=2) AS two FROM d JOIN s ON s.name=d.name GROUP BY 1), n AS (SELECT count(DISTINCT token) AS n FROM d), f AS (SELECT count(*) FILTER (s=1) AS f1 FROM s) SELECT n, round(max((f1-own+two)/(n-1)),9) AS worst, CASE WHEN n<3 THEN 'untestable' WHEN max((f1-own+two)/(n-1))<1 THEN 'saturated' ELSE 'open' END AS verdict FROM l,n,f GROUP BY n""")
def loo_saturation(t):
    return ev.saturation(t.signers, "name", "token")


@query("""WITH p AS (SELECT name, count(DISTINCT token) AS p FROM signers WHERE token<'5' GROUP BY 1), b AS (SELECT name, count(DISTINCT token) AS b FROM signers WHERE token>='5' GROUP BY 1), j AS (SELECT coalesce(p,0) AS p, coalesce(b,0) AS b FROM p FULL JOIN b ON p.name=b.name) SELECT count(*) FILTER (p=1) AS via_corpus, count(*) FILTER (p=0) AS via_batch FROM j WHERE b>0 AND p<2 AND p+b>=2""")
def earned_gain(t):
    s = t.signers
    return ev.earned_gain(s.filter("token < '5'"), s.filter("token >= '5'"), "name", "token")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(1-exp(lc),9) AS p FROM (SELECT l_orderkey, l_linenumber, l_partkey, list_sum(list_transform(range(1, least(m,n-k-m)+1), lambda i: ln((n-k-least(m,n-k-m)+i)/i))) - list_sum(list_transform(range(1, least(m,n-m)+1), lambda i: ln((n-least(m,n-m)+i)/i))) AS lc FROM (SELECT l_orderkey, l_linenumber, l_partkey, 60+l_linenumber AS n, CAST(1+l_quantity%9 AS BIGINT) AS k, CAST(1+l_partkey%15 AS BIGINT) AS m FROM lineitem))""")
def hyper_tail(t):
    """The chance that some of m drawn are marked."""
    n, k, m = 60 + F.col("l_linenumber"), (1 + F.col("l_quantity") % 9).cast("bigint"), 1 + F.col("l_partkey") % 15
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(ev.hyper_at_least_one(n, k, m), 9).alias("p"))


@query("""WITH x AS (SELECT l_partkey AS id, exp(-avg(l_quantity)) AS p FROM lineitem GROUP BY 1), y AS (SELECT *, p <= 0.05/(count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1) AS ok FROM x) SELECT id, bool_and(ok) OVER (ORDER BY p, id) AS kept FROM y""")
def holm_adjust(t):
    x = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.exp(-F.avg("l_quantity")).alias("p"))
    return ev.holm(x).select("id", "kept")


@query("""SELECT user_id, k, n, round(list_sum(list_transform(range(k,n+1), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)-n*ln(2)))),7) AS tail FROM (SELECT user_id, count(*) FILTER (event_type='view') AS k, count(*) AS n FROM events WHERE event_type IN ('view','click') GROUP BY 1)""")
def paired_order_tail(t):
    """The chance of so many views among views and clicks at even odds."""
    e = t.events.filter("event_type in ('view', 'click')").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("k"), F.count("*").alias("n"))
    return e.withColumn("tail", F.round(ev.binomial_tail(F.col("k"), F.col("n")), 7))


@query("""WITH c AS (SELECT event_type AS w, CAST(user_id%20 AS BIGINT) AS c, count(*) AS n FROM events GROUP BY 1,2) SELECT w, c, round(ln(n*(SELECT sum(n) FROM c)/(sum(n) OVER (PARTITION BY w)*sum(n) OVER (PARTITION BY c))),6) AS ppmi FROM c QUALIFY n*(SELECT sum(n) FROM c)>(sum(n) OVER (PARTITION BY w)*sum(n) OVER (PARTITION BY c))""")
def ppmi_pairs(t):
    c = t.events.groupBy(F.col("event_type").alias("w"), (F.col("user_id") % 20).alias("c")).agg(F.count("*").alias("n"))
    return ev.ppmi(c).withColumn("ppmi", F.round("ppmi", 6))


@query("""WITH f AS (SELECT DISTINCT l_partkey AS item, l_suppkey AS witness, l_returnflag<>'R' AS vote FROM lineitem) SELECT item, count(*) FILTER (vote) AS for_, count(*) FILTER (NOT vote) AS against, CASE WHEN count(*) FILTER (vote)>0 AND count(*) FILTER (NOT vote)>0 THEN 'contested' WHEN count(*) FILTER (vote)>0 THEN 'stands' ELSE 'falsified' END AS standing FROM f GROUP BY 1""")
def witness_votes(t):
    return ev.votes(t.lineitem.select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("witness"), (F.col("l_returnflag") != "R").alias("vote")))


@query("""WITH c AS (SELECT source AS genre, lower(w) AS word, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text),'[a-z]{4,}')) AS w FROM documents WHERE source IS NOT NULL) GROUP BY 1,2), x AS (SELECT genre, word, CAST(n AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY word)-n AS DOUBLE) AS b, CAST(sum(n) OVER (PARTITION BY genre)-n AS DOUBLE) AS c, CAST((SELECT sum(n) FROM c)-sum(n) OVER (PARTITION BY genre)-sum(n) OVER (PARTITION BY word)+n AS DOUBLE) AS d FROM c)
SELECT genre, word, round(2*(CASE WHEN a>0 THEN a*ln(a/((a+b)*(a+c)/(a+b+c+d))) ELSE 0 END+CASE WHEN b>0 THEN b*ln(b/((a+b)*(b+d)/(a+b+c+d))) ELSE 0 END+CASE WHEN c>0 THEN c*ln(c/((c+d)*(a+c)/(a+b+c+d))) ELSE 0 END+CASE WHEN d>0 THEN d*ln(d/((c+d)*(b+d)/(a+b+c+d))) ELSE 0 END),3) AS g2 FROM x WHERE a/(a+c) > b/greatest(1,b+d)""")
def register_prior(t):
    """Words over-represented in a kind of source, by log-likelihood."""
    w = t.documents.filter("source is not null").select(F.col("source").alias("genre"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return ev.register_prior(w.groupBy("genre", "word").agg(F.count("*").alias("n"))).withColumn("g2", F.round("g2", 3))


@query("""WITH f AS (SELECT source AS genre, lang AS fact, count(*) AS n FROM documents GROUP BY 1,2) SELECT genre, fact, round(-log2((n+0.5)/(sum(n) OVER (PARTITION BY genre)+0.5*(SELECT count(DISTINCT fact) FROM f))),6) AS bits FROM f WHERE genre IS NOT NULL""")
def perspective_bits(t):
    f = t.documents.groupBy(F.col("source").alias("genre"), F.col("lang").alias("fact")).agg(F.count("*").alias("n"))
    return ev.perspective_bits(f).withColumn("bits", F.round("bits", 6))


SH = "SELECT id, token AS doc, unnest(list_distinct(regexp_extract_all(lower(coalesce(verbatim,'')),'[a-z]{5,}'))) AS token FROM obs WHERE kind IN ('notice','date','party') AND length(verbatim)>=12 AND token IS NOT NULL"


# The queries named ..._all run over the statements of every kind; those without it keep to three kinds, as their SQL does.
SH_ALL = SH.replace("kind IN ('notice','date','party') AND ", "")


def shared_tokens(t, kinds=("notice", "date", "party")):
    o = t.obs.filter("length(verbatim) >= 12 and token is not null")
    o = o.filter(F.col("kind").isin(*kinds)) if kinds else o
    return o.select("id", F.col("token").alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("verbatim"), F.lit("[a-z]{5,}"), F.lit(0)))).alias("token"))


@query(f"""WITH t AS ({SH}) SELECT token, count(*) AS df, round(log2(((SELECT count(DISTINCT id) FROM t)+1)/count(*)),6) AS idf FROM t GROUP BY 1""")
def idf_bits(t):
    return pr.idf_bits(shared_tokens(t)).withColumn("idf", F.round("idf", 6))


@query(SQL["idf_bits"].replace(SH, SH_ALL))
def idf_bits_all(t):
    return pr.idf_bits(shared_tokens(t, None)).withColumn("idf", F.round("idf", 6))


PAIRS = f"""WITH t AS ({SH}), n AS (SELECT count(DISTINCT id) AS n FROM t), f AS (SELECT token, count(*) AS df, log2(((SELECT n FROM n)+1)/count(*)) AS idf FROM t GROUP BY 1 HAVING count(*)>=2 AND count(*)<=greatest(2,ceil(sqrt((SELECT n FROM n))))), b AS (SELECT t.*, idf FROM t JOIN f ON f.token=t.token), s AS (SELECT x.id AS a, y.id AS b, x.doc AS doc_a, y.doc AS doc_b, count(*) AS shared, sum(x.idf) AS score FROM b x JOIN b y ON x.token=y.token AND x.id<y.id AND x.doc<>y.doc GROUP BY ALL)"""


@query(f"""{PAIRS} SELECT a, b, shared, round(score,4) AS score FROM s""")
def pair_idf_score(t):
    """Statements of different contracts by the rare words they share."""
    return pr.pair_scores(pr.blocked_tokens(shared_tokens(t))).select("a", "b", "shared", F.round("score", 4).alias("score"))


@query(SQL["pair_idf_score"].replace(SH, SH_ALL))
def pair_idf_score_all(t):
    """The same over statements of every kind."""
    return pr.pair_scores(pr.blocked_tokens(shared_tokens(t, None))).select("a", "b", "shared", F.round("score", 4).alias("score"))


@query(f"""{PAIRS} SELECT doc_a, doc_b, count(DISTINCT token) AS shared FROM (SELECT x.doc AS doc_a, y.doc AS doc_b, x.token FROM b x JOIN b y ON x.token=y.token AND x.doc<y.doc) GROUP BY 1,2""")
def pair_proposals(t):
    return pr.proposals(pr.blocked_tokens(shared_tokens(t)))


@query(SQL["pair_proposals"].replace(SH, SH_ALL))
def pair_proposals_all(t):
    return pr.proposals(pr.blocked_tokens(shared_tokens(t, None)))


@query(f"""{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sc DESC) AS ra, lead(sc) OVER (PARTITION BY a ORDER BY sc DESC) AS na, row_number() OVER (PARTITION BY b ORDER BY sc DESC) AS rb, lead(sc) OVER (PARTITION BY b ORDER BY sc DESC) AS nb FROM (SELECT a, b, round(score,6) AS sc FROM s)) SELECT a, b FROM r WHERE ra=1 AND rb=1 AND (na IS NULL OR sc>na) AND (nb IS NULL OR sc>nb)""")
def mutual_best(t, kinds=("notice", "date", "party")):
    s = pr.pair_scores(pr.blocked_tokens(shared_tokens(t, kinds))).select("a", "b", F.round("score", 6).alias("score"))
    from quarrystone.operators.joins import mutual_best

    return mutual_best(s).select("a", "b")


@query(SQL["mutual_best"].replace(SH, SH_ALL))
def mutual_best_all(t):
    return mutual_best(t, None)


@query("""WITH v AS (SELECT DISTINCT o_custkey AS id, o_orderstatus AS key, year(o_orderdate) AS value FROM orders), p AS (SELECT DISTINCT o_custkey AS a, o_custkey+1 AS b FROM orders), j AS (SELECT p.a, p.b, bool_or(x.value=y.value) AS eq, bool_or(x.value<>y.value) AS cf FROM p JOIN v x ON x.id=p.a JOIN v y ON y.id=p.b AND y.key=x.key GROUP BY 1,2), n AS (SELECT id, count(*) AS n FROM v GROUP BY 1)
SELECT p.a, p.b, CASE WHEN cf AND NOT eq THEN 'differs' WHEN eq THEN 'same' WHEN coalesce(x.n,0)<>coalesce(y.n,0) THEN 'extends' ELSE 'none' END AS verdict FROM p LEFT JOIN j ON j.a=p.a AND j.b=p.b LEFT JOIN n x ON x.id=p.a LEFT JOIN n y ON y.id=p.b""")
def value_verdict(t):
    """What two neighbours' values of one key say to each other."""
    o = t.orders
    v = o.select(F.col("o_custkey").alias("id"), F.lit("fig").alias("kind"), F.col("o_orderstatus").alias("key"), F.year("o_orderdate").alias("value"))
    p = o.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1).alias("b")).distinct()
    return pr.value_verdicts(p, v)


@query("""SELECT l_returnflag AS unit, l_partkey AS referent, count(DISTINCT l_quantity) AS n_values, count(DISTINCT l_suppkey) AS docs, CASE WHEN count(DISTINCT l_suppkey)>1 AND count(DISTINCT l_quantity)>1 THEN 'contradiction' WHEN count(DISTINCT l_suppkey)>1 THEN 'agreement' ELSE 'single source' END AS verdict FROM lineitem GROUP BY 1,2""")
def contradiction_values(t):
    return pr.contradictions(t.lineitem.select(F.col("l_returnflag").alias("unit"), F.col("l_partkey").alias("referent"), F.col("l_quantity").alias("value"), F.col("l_suppkey").alias("doc")))


@query(f"""WITH w AS ({W}), t AS (SELECT id, stem AS term, count(*) AS tf FROM w GROUP BY 1,2) SELECT id, term, round(tf*ln(1+(SELECT count(DISTINCT id) FROM t)/count(*) OVER (PARTITION BY term)),6) AS w FROM t""")
def tfidf_vectors(t):
    x = words(t).groupBy("id", F.col("stem").alias("term")).agg(F.count("*").alias("tf"))
    return pr.tfidf(x).withColumn("w", F.round("w", 6))


@query()
def near_copies(t):
    """Documents by class of near copies: five words a shingle, 0.8 alike or more."""
    return pr.shingle_jaccard(t.documents.select("doc_id", "text"), "doc_id", "text")


@query("""WITH n AS (SELECT DISTINCT party AS n FROM contracts WHERE party IS NOT NULL AND length(party)>=4) SELECT a.n AS a, b.n AS b, CAST(damerau_levenshtein(lower(a.n),lower(b.n)) AS INTEGER) AS d FROM n a JOIN n b ON a.n<b.n AND damerau_levenshtein(lower(a.n),lower(b.n))<=2""")
def near_spellings(t):
    """Parties' names within two edits of each other."""
    return pr.near_spellings(t.contracts.filter("party is not null"), "party")


@query()
def signer_ties(t):
    """Pairs of signers that share more contracts than chance would have it."""
    n = t.signers.select("token").distinct().count()
    return ev.ties(t.signers.filter("name is not null"), "name", "token", n)


@query()
def keyword_relevance(t):
    """Contracts for which a question's words are key beyond every draw."""
    w = words(t)
    bg = ev.background(w.groupBy("stem").agg(F.count("*").alias("n"))).filter(F.col("stem").isin("hydrant", "federal", "lease"))
    return ev.relevance(w.filter("doc is not null").groupBy("doc", "stem").agg(F.count("*").alias("n")), bg)


@query("""WITH c AS (SELECT token, party, department, coalesce(CASE WHEN status='Active' THEN 1.0 ELSE CASE WHEN status IS NULL THEN NULL ELSE 0.0 END END, NULL) AS h FROM contracts) SELECT DISTINCT token, round(CASE WHEN count(*) OVER (PARTITION BY party, department)>=20 THEN avg(h) OVER (PARTITION BY party, department) WHEN count(*) OVER (PARTITION BY department)>=20 THEN avg(h) OVER (PARTITION BY department) WHEN count(*) OVER ()>=20 THEN avg(h) OVER () END,6) AS normal_rate, CASE WHEN count(*) OVER (PARTITION BY party, department)>=20 THEN 'party' WHEN count(*) OVER (PARTITION BY department)>=20 THEN 'department' WHEN count(*) OVER ()>=20 THEN 'everywhere' END AS region FROM c""")
def normal_rates(t):
    """The share of active contracts in the smallest region that is large enough."""
    c = t.contracts.select("token", "party", "department", F.lit("all").alias("everywhere"), (F.col("status") == "Active").alias("hit"))
    return ev.region_rate(c, ["party", "department", "everywhere"], "hit").select("token", F.round("normal_rate", 6).alias("normal_rate"), "region").distinct()


@query()
def permutation_rate(t):
    """How often status and flag agree, against shuffles."""
    j = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("a")).join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("b")), "k")
    return ev.permutation_rate(j, "k", "a", "b")


@query()
def region_rate(t):
    """The share of active contracts in the smallest region whose rate chance doesn't give it."""
    c = t.contracts.select("party", "department", F.lit("all").alias("everywhere"), (F.col("status") == "Active").alias("hit"))
    return nl.ladder_rate(c, ["party", "department", "everywhere"], "hit")


@query()
def phrase_keyness(t):
    """Signers' names that the contracts' texts say more than their words would by chance."""
    n = t.signers.filter("name is not null").select("name", F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}]+"), F.lit(0)).alias("stems")).distinct()
    d = t.obs.filter("verbatim is not null").select("id", F.regexp_extract_all(F.lower("verbatim"), F.lit(r"[\p{L}]+"), F.lit(0)).alias("stems"))
    w = d.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))
    return nl.phrase_keyness(n, d, ev.background(w))


def proposed(t, measure):
    """Statements of different contracts that share rare words, with a likeness of all their words."""
    tok = cut(shared_tokens(t, None), "tokens")
    n = tok.groupBy("id").agg(F.count("*").alias("n"))
    p = pr.pair_scores(pr.blocked_tokens(tok)).select("a", "b")
    x, y = tok.select(F.col("id").alias("a"), "token"), tok.select(F.col("id").alias("b"), "token")
    k = p.join(x, "a").join(y, ["b", "token"]).groupBy("a", "b").agg(F.count("*").alias("k"))
    j = k.join(n.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    like = F.col("k") / (F.col("na") + F.col("nb") - F.col("k")) if measure == "jaccard" else F.col("k") / F.sqrt(F.col("na") * F.col("nb"))
    return nl.beats_floor(j.select("a", "b", like.alias("score")), tok, measure=measure, draws=199)


@query()
def echo_jaccard_null(t):
    """Statements of different contracts whose words overlap more than in any of 199 draws of their sizes."""
    return proposed(t, "jaccard")


@query()
def echo_cosine_null(t):
    """The same by cosine."""
    return proposed(t, "cosine")


AMOUNTS = r"\$([0-9][0-9,]*(?:\.[0-9]+)?)"


@query("""WITH v AS (SELECT token AS doc, regexp_extract(verbatim,'[$]([0-9][0-9,]*(?:[.][0-9]+)?)',1) AS raw, ' '||trim(regexp_replace(lower(verbatim),'[^a-z0-9]+',' ','g'))||' ' AS w FROM obs WHERE regexp_matches(coalesce(verbatim,''),'[$][0-9]') AND regexp_full_match(verbatim,'[\\x00-\\x7f]*')),
x AS (SELECT doc, raw, TRY_CAST(replace(raw,',','') AS DOUBLE) AS value, CASE WHEN contains(w,' paid ') OR contains(w,' invoiced ') THEN 'paid' WHEN contains(w,' exceed ') THEN 'exceed' END AS key FROM v),
y AS (SELECT *, CASE WHEN doc IS NULL OR value IS NULL THEN 'incomplete' WHEN key IS NULL THEN 'no referent near' END AS why FROM x), o AS (SELECT key, doc, min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS k FROM y WHERE why IS NULL GROUP BY 1,2)
SELECT CASE WHEN count(*)=1 THEN 'gap' WHEN max(hi)>min(lo) THEN 'contradiction' ELSE 'agreement' END AS part, 'dollars' AS unit, key AS referent, (SELECT count(DISTINCT value) FROM y WHERE y.key=o.key AND why IS NULL) AS n_values, count(*) AS n_docs, CASE WHEN count(*)=1 THEN 'a single source' END AS why FROM o GROUP BY key
UNION ALL SELECT 'unstable', 'dollars', key, max(k), count(*), 'one source states several' FROM o WHERE k>1 GROUP BY key
UNION ALL SELECT 'refusal', 'dollars', NULL, count(DISTINCT value), count(DISTINCT doc), why FROM y WHERE why IS NOT NULL GROUP BY why""")
def contradiction_records(t):
    """What contracts say was paid and must not be exceeded, and what is left out of that."""
    o = t.obs.filter(F.col("verbatim").rlike(r"\$[0-9]") & F.col("verbatim").rlike(r"\A[\x00-\x7f]*\z"))
    raw = F.regexp_extract("verbatim", AMOUNTS, 1)
    v = o.select("id", F.col("token").alias("doc"), raw.alias("raw"), F.regexp_replace(raw, ",", "").try_cast("double").alias("value"), F.lit("dollars").alias("unit"), F.lit(None).cast("string").alias("referent"), F.col("verbatim").alias("window"))
    return cd.contradiction_records(v, "How much was paid, how much did exceed?", {"paid": ["invoiced"]})
