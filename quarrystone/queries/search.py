"""Text search over observations, chunks and documents."""

from pyspark.sql import functions as F

from quarrystone.functions import scalars as sc
from quarrystone.operators import search as se
from quarrystone.operators import vectors as vc
from quarrystone.queries.registry import query

TOK = "regexp_extract_all(lower(coalesce({0},'')),'[\\p{{L}}\\p{{N}}_]+')"
IX = f"WITH d AS (SELECT id, token, {TOK.format('verbatim')} AS w FROM obs), x AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d), ix AS (SELECT id, dl, term, count(*) AS tf FROM x GROUP BY ALL)"


@query(f"""{IX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM ix GROUP BY 1""")
def tokens_df(t):
    """The inverted index of observations, by term."""
    ix = se.inverted(t.obs, "id", "verbatim")
    return ix.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"""{IX} SELECT id FROM ix WHERE term='federal' OR starts_with(term,'insp') GROUP BY id HAVING bool_or(term='federal') AND bool_or(starts_with(term,'insp'))""")
def fts_and_prefix(t):
    """All terms, the last a prefix."""
    return se.match_all(se.inverted(t.obs, "id", "verbatim"), "id", "federal insp")


@query(f"""{IX}, m AS (SELECT DISTINCT id FROM ix WHERE starts_with(term,'hydrant')) SELECT o.id, o.token, c.department FROM m JOIN obs o ON o.id=m.id JOIN (SELECT token, max(department) AS department FROM contracts GROUP BY 1) c ON c.token=o.token""")
def fts_joined(t):
    """Index hits joined to their rows and the contract's header."""
    m = se.match_all(se.inverted(t.obs, "id", "verbatim"), "id", "hydrant")
    return m.join(t.obs.select("id", "token"), "id").join(t.contracts.groupBy("token").agg(F.max("department").alias("department")), "token").select("id", "token", "department")


@query(f"""{IX}, st AS (SELECT count(*) AS docs, avg(dl) AS avg_len FROM (SELECT DISTINCT id, dl FROM ix)), r AS (SELECT * FROM ix WHERE term IN ('hydrant','lease','federal')), f AS (SELECT term, count(*) AS df FROM r GROUP BY 1)
SELECT id, round(sum(ln(1+(docs-df+0.5)/(df+0.5))*(tf*2.2/(tf+1.2*(0.25+0.75*dl/avg_len)))),5) AS score FROM r JOIN f ON f.term=r.term, st GROUP BY id""")
def bm25_scores(t):
    ix = se.inverted(t.obs, "id", "verbatim")
    return se.bm25(ix, "id", ["hydrant", "lease", "federal"]).withColumn("score", F.round("score", 5))


@query("""SELECT id, CASE WHEN regexp_matches(v,'(?i)federal\\s+inspector') THEN 'phrase' WHEN regexp_matches(v,'(?i)(^|[^a-zA-Z0-9_])federal([^a-zA-Z0-9_]|$)') AND regexp_matches(v,'(?i)(^|[^a-zA-Z0-9_])inspector([^a-zA-Z0-9_]|$)') THEN 'together' ELSE 'family' END AS kind
FROM (SELECT id, coalesce(verbatim,'') AS v FROM obs) WHERE regexp_matches(v,'(?i)(^|[^a-zA-Z0-9_])(federal([^a-zA-Z0-9_]|$)|inspector([^a-zA-Z0-9_]|$)|federal|inspector)')""")
def match_kinds(t):
    """How texts hold a query's words."""
    k = se.classify("verbatim", "federal inspector")
    return t.obs.select("id", k.alias("kind")).filter("kind is not null")


@query("""SELECT id, substr(verbatim, greatest(1, strpos(lower(verbatim),'hydrant')-110), 227) AS snippet FROM obs WHERE contains(lower(coalesce(verbatim,'')),'hydrant')""")
def snippets(t):
    return t.obs.select("id", se.snippet("verbatim", "hydrant").alias("snippet")).filter("snippet is not null")


@query("""WITH k AS (SELECT id, token, CASE WHEN contains(lower(verbatim),'annual hydrant') THEN 'phrase' ELSE 'word' END AS kind, length(verbatim) AS score FROM obs WHERE contains(lower(coalesce(verbatim,'')),'hydrant')) SELECT token, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY CASE kind WHEN 'phrase' THEN 0 ELSE 1 END, score DESC, id) AS r FROM k) WHERE r<=3""")
def explain_top3(t):
    """The three best passages of each contract."""
    o = t.obs.filter(F.contains(F.lower("verbatim"), F.lit("hydrant")))
    k = o.select("id", "token", F.when(F.contains(F.lower("verbatim"), F.lit("annual hydrant")), "phrase").otherwise("word").alias("kind"), (F.length("verbatim") - F.col("id") / 1e9).alias("score"))
    return se.explain(k, "token", "kind", "score").select("token", "id", "kind")


@query("""SELECT id FROM (SELECT id, lower(coalesce(text,'')) AS t FROM chunks) WHERE strpos(t,'hydrant')>0 AND strpos(t,'federal')>0 AND greatest(strpos(t,'hydrant')+7,strpos(t,'federal')+7)-least(strpos(t,'hydrant'),strpos(t,'federal'))<=400""")
def proximity_together(t):
    return t.chunks.filter(se.proximity("text", ["hydrant", "federal"])).select("id")


@query("""WITH f AS (SELECT token, translate(lower(coalesce(party,'')),'1|i!0','llllo') AS t FROM contracts), g AS (SELECT token, unnest(list_distinct([substr(t,i,3) for i in range(1,length(t)-1)])) AS trigram FROM f WHERE length(t)>=3) SELECT trigram, count(DISTINCT token) AS df FROM g GROUP BY 1""")
def trigram_df(t):
    """Trigrams of folded names and how many contracts have them."""
    return se.trigram_index(t.contracts, "token", "party").groupBy("trigram").agg(F.count_distinct("token").alias("df"))


@query("""SELECT id, CASE WHEN contains(b,'section 1') THEN 'exact' ELSE 'folded' END AS kind FROM (SELECT id, regexp_replace(lower(coalesce(verbatim,'')),'\\s+',' ','g') AS b, regexp_replace(translate(lower(coalesce(verbatim,'')),'1|i!0','llllo'),'\\s+',' ','g') AS f FROM obs) WHERE contains(b,'section 1') OR contains(f,'sectlon l')""")
def substring_folded(t):
    """A substring, and what scanners make of it."""
    return se.substring_search(t.obs, "id", "verbatim", "section 1").select("id", "kind")


@query("""SELECT DISTINCT party AS name, CASE WHEN p='ashmere water and sewer services' THEN 0 WHEN starts_with(p,'ashmere water and sewer services') THEN 1 WHEN contains(p,'ashmere water and sewer services') THEN 2 ELSE 3 END AS rank FROM (SELECT party, lower(party) AS p FROM contracts WHERE party IS NOT NULL) WHERE contains(p,'ashmere water and sewer services') OR levenshtein(p,'ashmere water and sewer services')<=2""")
def referent_search(t):
    return se.referent_search(t.contracts.filter("party is not null"), "party", "Ashmere Water and Sewer Services")


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id=0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),CAST(v AS DOUBLE[])),5) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]),CAST(v AS DOUBLE[])) DESC, vec_id LIMIT 10""")
def cosine_topk(t):
    """The ten nearest vectors to the first."""
    q = t.embeddings.filter("vec_id = 0").select("embedding").head()[0]
    return se.vector_topk(t.embeddings, "vec_id", "embedding", q, 10).withColumn("score", F.round("score", 5))


@query("""WITH c AS (SELECT q.vec_id AS query, e.vec_id AS key, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank, q.label AS ql, e.label AS el FROM embeddings q JOIN embeddings e ON q.vec_id<>e.vec_id WHERE q.vec_id % 100 = 0) SELECT query, count(*) AS k, count(*) FILTER (ql=el) AS same FROM c WHERE rank<=10 GROUP BY 1""")
def query_neighbours(t):
    """Searches: every vector whose id is divisible by 100 against all, in blocks, with how many of the ten nearest share its
    label."""
    e = t.embeddings
    hits = vc.search(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    lab = e.select("vec_id", "label")
    j = hits.join(lab.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(lab.select(F.col("vec_id").alias("key"), "label"), "key")
    return j.groupBy("query").agg(F.count("*").alias("k"), F.count_if(F.col("label") == F.col("ql")).alias("same"))


@query()
def vector_lift(t):
    """The best score against seeded random vectors: what a real hit must beat."""
    q = t.embeddings.filter("vec_id = 0").select("embedding").head()[0]
    return se.vector_null(t.embeddings, "vec_id", len(q), q, 500)


@query()
def fuzzy_verify(t):
    """Texts that hold a misspelt phrase within its number of edits."""
    return se.fuzzy_search(t.chunks, "id", "text", "is governcd bv the")


@query()
def widening_contract_search(t):
    return se.widening_search(t.chunks, "id", "token", "text", "approved inspecti0n")


@query("""WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(coalesce(verbatim,'')),'[a-z0-9]{3,}')) AS m FROM obs) SELECT id, CAST(len(list_intersect(m, ['annual','federal','hydrant','inspector'])) AS INTEGER) AS shared FROM w WHERE len(list_intersect(m, ['annual','federal','hydrant','inspector']))>0""")
def memory_recall(t):
    return se.recall_terms(t.obs, "verbatim", "Which federal inspector saw the annual hydrant?", {"which", "saw", "the"}).select("id", "shared")


@query("""SELECT doc_id, strpos(lower(text),'escrow') AS at FROM documents WHERE contains(lower(coalesce(text,'')),'escrow')""")
def lexical_scan(t):
    at = F.instr(F.lower("text"), "escrow")
    return t.documents.select("doc_id", at.cast("bigint").alias("at")).filter("at > 0")


@query()
def name_resolution(t):
    """The one person a part of a name stands for, if there is just one."""
    n = t.signers.select("name").distinct()
    return se.resolve(n.withColumn("ref", sc.referent_key("name")), "name", "ref", "Nadia Renshter")


@query()
def stems_df(t):
    """The inverted index of observations, by Porter stem."""
    return se.inverted_stems(t.obs, "id", "verbatim").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query()
def fts_stems(t):
    """Observations that hold the stems of every word asked for."""
    return se.match_stems(se.inverted_stems(t.obs, "id", "verbatim"), "id", "federal inspections")
