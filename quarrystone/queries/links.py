"""Links, readings and logs over the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.functions import scalars as sc
from quarrystone.operators import aggregates as ag
from quarrystone.operators import alignment as al
from quarrystone.operators import evidence as ev
from quarrystone.operators import links as lk
from quarrystone.operators import nulls as nl
from quarrystone.operators import oplog as ol
from quarrystone.operators import pairs as pr
from quarrystone.operators import repair as rp
from quarrystone.operators import search as se
from quarrystone.operators import vectors as vc
from quarrystone.queries.registry import SQL, query
from quarrystone.queries.statistics import PAIRS, SH, SH_ALL, shared_tokens

NEG = "(list_has_any(regexp_extract_all(l,'[0-9A-Za-z_]+'),['not','never','none','nothing','without','neither','nor','cannot','disclaim','disclaims','prohibit','prohibits','prohibited']) OR contains(regexp_replace(l,'[a-z0-9_]n[''’]t\\b',chr(1)),chr(1)) OR len(regexp_extract_all(l,'\\bno\\b'))>len(regexp_extract_all(l,'\\bno\\b[.]?\\s*[0-9]')))"


def scores(t):
    return pr.pair_scores(pr.blocked_tokens(shared_tokens(t)))


@query(f"""{PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY a, doc_b ORDER BY round(score,6) DESC, b) AS r FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score,6) DESC, doc_b) AS k FROM o WHERE r=1) SELECT a AS q, doc_b AS doc, b AS id FROM p WHERE k<=3""")
def best_per_source(t):
    """The best statement of each other source, three sources at most."""
    s = scores(t).select(F.col("a").alias("q"), F.col("doc_b").alias("doc"), F.col("b").alias("id"), F.round("score", 6).alias("score"))
    return lk.best_per_source(s).select("q", "doc", "id")


@query(SQL["best_per_source"].replace(SH, SH_ALL))
def best_per_source_all(t):
    """The same over statements of every kind."""
    s = pr.pair_scores(pr.blocked_tokens(shared_tokens(t, None))).select(F.col("a").alias("q"), F.col("doc_b").alias("doc"), F.col("b").alias("id"), F.round("score", 6).alias("score"))
    return lk.best_per_source(s).select("q", "doc", "id")


@query(f"""{PAIRS}, ng AS (SELECT id, {NEG} AS n FROM (SELECT id, lower(coalesce(verbatim,'')) AS l FROM obs)), x AS (SELECT CASE WHEN u.n THEN a ELSE b END AS denial, CASE WHEN u.n THEN b ELSE a END AS id, CASE WHEN u.n THEN doc_b ELSE doc_a END AS doc, round(score,6) AS sc FROM s JOIN ng u ON u.id=a JOIN ng v ON v.id=b WHERE u.n<>v.n)
SELECT denial, id FROM (SELECT *, row_number() OVER (PARTITION BY denial, doc ORDER BY sc DESC, id) AS r FROM x) WHERE r<=3""")
def polarity_links(t):
    """Denials and the statements of other sources nearest to them that don't deny."""
    return lk.polarity_links(t.obs.select("id", F.col("verbatim").alias("text")), shared_tokens(t)).select("denial", "id")


@query(SQL["polarity_links"].replace(SH, SH_ALL))
def polarity_links_all(t):
    """The same over statements of every kind."""
    return lk.polarity_links(t.obs.select("id", F.col("verbatim").alias("text")), shared_tokens(t, None)).select("denial", "id")


@query("""WITH s AS (SELECT id, token AS doc, lower(coalesce(verbatim,'')) AS t FROM obs WHERE regexp_full_match(coalesce(verbatim,''),'[\\x00-\\x7f]*')), d AS (SELECT DISTINCT id, doc, unnest(regexp_extract_all(t,'["]([^"]{3,60})["]\\s+(?:means|shall mean|refers to|is defined as)',1)) AS phrase FROM s)
SELECT min(d.id) AS definition, s.id, d.phrase FROM d JOIN s ON s.doc<>d.doc AND contains(s.t, d.phrase) GROUP BY s.id, d.phrase""")
def defined_links(t):
    """Statements that use a phrase another contract defines."""
    s = t.obs.filter(F.coalesce("verbatim", F.lit("")).rlike(r"\A[\x00-\x7f]*\z")).select("id", F.col("token").alias("doc"), F.col("verbatim").alias("text"))
    return lk.defined_links(s)


@query()
def defined_links_all(t):
    """The same over all statements, whatever their letters."""
    return lk.defined_links(t.obs.select("id", F.col("token").alias("doc"), F.col("verbatim").alias("text")))


@query("""SELECT c.token AS id, c.party AS value, n.name FROM contracts c JOIN (SELECT trim(lower(party)) AS k, min(party) AS name FROM contracts WHERE regexp_matches(party,'^[A-Z][a-z]+ [A-Z][a-z]+$') GROUP BY 1) n ON n.k=trim(lower(c.party)) WHERE regexp_full_match(c.party,'[ -~]+')""")
def named_cells(t):
    """Cells that are a known name, case aside."""
    c = t.contracts.filter(F.col("party").rlike("^[ -~]+$"))
    n = t.contracts.filter(F.col("party").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$")).select(F.col("party").alias("name"))
    return lk.named_cells(c.select(F.col("token").alias("id"), F.col("party").alias("value")), n)


@query("""WITH p AS (SELECT token AS doc, count(DISTINCT id) AS pages FROM chunks GROUP BY 1), l AS (SELECT DISTINCT token AS doc, id, trim(x,' ') AS line FROM (SELECT token, id, unnest(string_split(coalesce(text,''),chr(10))) AS x FROM chunks)), c AS (SELECT doc, line, count(*) AS n FROM l WHERE length(line) BETWEEN 3 AND 60 AND len(string_split_regex(line,'\\s+'))<=6 AND (regexp_matches(line,'(?i)\\b(confidential|draft|copy|approved|received|filed|page|exhibit|original|void|sample)\\b') OR (upper(line)=line AND regexp_matches(line,'[A-Z]'))) GROUP BY 1,2) SELECT c.doc, line, n FROM c JOIN p ON p.doc=c.doc WHERE n>=greatest(3,ceil(pages/2))""")
def ignore_rules(t):
    """Stamps: short lines that stand on half of a contract's pages or more."""
    return lk.ignore_rules(t.chunks.select(F.col("token").alias("doc"), F.col("id").alias("page"), "text"))


@query("""SELECT event_type AS type, count(*) AS n FROM events WHERE contains(lower(props),'6') GROUP BY 1""")
def drive_chips(t):
    """Entries of a list by type, before a type is chosen."""
    e = t.events.select(F.col("event_id").alias("id"), F.col("props").alias("name"), F.col("event_type").alias("type"), F.col("ts").alias("modified"), F.col("value").alias("size"), F.col("user_id").alias("people"))
    return lk.drive_rows(e.withColumn("name", F.col("name")), "6", "view", "recent")[1]


@query("""WITH c AS (SELECT l_suppkey AS doc, CAST(l_partkey%50 AS VARCHAR) AS name, l_returnflag AS frame, l_tax-l_discount AS stance FROM lineitem), n AS (SELECT doc, name, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, name) AS r FROM c GROUP BY 1,2), f AS (SELECT doc, frame, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, frame) AS r FROM c GROUP BY 1,2)
SELECT s.doc, s.stance, (SELECT string_agg(name,'|' ORDER BY r) FROM n WHERE n.doc=s.doc AND r<=5) AS names, (SELECT string_agg(frame,'|' ORDER BY r) FROM f WHERE f.doc=s.doc AND r<=3) AS frames FROM (SELECT doc, CAST(sign(sum(round(stance*100))) AS INTEGER) AS stance FROM c GROUP BY 1) s""")
def conclusion_profile(t):
    """What each source's claims come to: names, frames and stance."""
    c = t.lineitem.select(F.col("l_suppkey").alias("doc"), (F.col("l_partkey") % 50).cast("string").alias("name"), F.col("l_returnflag").alias("frame"), F.round((F.col("l_tax") - F.col("l_discount")) * 100).alias("stance"))
    return lk.conclusions(c)


@query("""WITH c AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderstatus AS name FROM orders), p AS (SELECT a.doc, a.seq, b.name, count(*) AS n, max(b.seq) AS last FROM c a JOIN c b ON a.doc=b.doc AND b.seq<=a.seq GROUP BY 1,2,3), q AS (SELECT doc, seq, name, row_number() OVER (PARTITION BY doc, seq ORDER BY n DESC, last) AS r FROM p) SELECT q.doc, min(q.seq) FILTER (q.name<>f.name) AS depth FROM q JOIN c f ON f.doc=q.doc AND f.seq=1 WHERE r=1 GROUP BY 1""")
def departure_depth(t):
    """How far one must read before the most said thing is another."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    c = t.orders.select(F.col("o_custkey").alias("doc"), F.row_number().over(w).cast("bigint").alias("seq"), F.col("o_orderstatus").alias("name"))
    return lk.departure_depth(c)


HEAD = "SELECT token AS doc, id, CAST(i AS BIGINT) AS seq, x AS heading FROM (SELECT token, id, unnest(string_split(coalesce(text,''),chr(10))) AS x, generate_subscripts(string_split(coalesce(text,''),chr(10)),1) AS i FROM chunks) WHERE regexp_full_match(x,'[0-9]+[.] [A-Z ]+')"


def headings(t):
    l = t.chunks.select(F.col("token").alias("doc"), "id", F.posexplode(F.split(sc.text_of("text"), "\n")).alias("seq", "heading"))
    return l.filter(F.col("heading").rlike(r"\A[0-9]+[.] [A-Z ]+\z"))


@query(f"""WITH h AS ({HEAD}) SELECT norm, count(DISTINCT doc) AS docs, string_agg(DISTINCT heading,'|' ORDER BY heading) AS surfaces FROM (SELECT doc, heading, trim(regexp_replace(trim(regexp_replace(lower(heading),'[^a-z ]+',' ','g'),' '),'\\s+',' ','g'),' ') AS norm FROM h) WHERE norm<>'' GROUP BY 1""")
def section_lexicon(t):
    """Headings by normal form, with how many contracts have them."""
    return lk.section_lexicon(headings(t).select("doc", "heading"))


@query(f"""WITH h AS ({HEAD}), n AS (SELECT id, regexp_replace(heading,'^[0-9]+[.] ','') AS name, lead(regexp_replace(heading,'^[0-9]+[.] ','')) OVER (PARTITION BY id ORDER BY seq) AS next FROM h) SELECT name, next, count(*) AS n FROM n WHERE next IS NOT NULL GROUP BY 1,2""")
def structure_bigrams(t):
    """Which heading follows which."""
    h = headings(t).select(F.col("id").alias("doc"), "seq", F.regexp_replace("heading", r"^[0-9]+[.] ", "").alias("name"))
    return lk.structure_bigrams(h)


@query("""SELECT page, eye, text FROM (SELECT token AS page, kind AS eye, verbatim AS text, row_number() OVER (PARTITION BY token ORDER BY length(regexp_replace(coalesce(verbatim,''),'\\s','','g'))*(CASE WHEN kind='clause' THEN 1.15 ELSE 1 END) DESC, kind, id) AS r FROM (SELECT DISTINCT token, kind, min(id) AS id, verbatim FROM obs WHERE token IS NOT NULL AND kind<>'' AND regexp_full_match(verbatim,'[ -~\\n]*') GROUP BY 1,2,4)) WHERE r=1""")
def page_choice(t, texts=r"\A[ -~\n]*\z"):
    """Of several readings the fullest, with a margin for the preferred eye."""
    o = t.obs.filter("token is not null and kind <> ''").filter(F.col("verbatim").rlike(texts)).groupBy("token", "kind", "verbatim").agg(F.min("id").alias("id"))
    o = o.select(F.col("token").alias("page"), F.col("kind").alias("eye"), F.col("verbatim").alias("text"), "id")
    n = F.length(F.regexp_replace("text", r"\s", ""))
    w = Window.partitionBy("page").orderBy((n * F.when(F.col("eye") == "clause", 1.15).otherwise(1.0)).desc(), "eye", "id")
    return o.withColumn("r", F.row_number().over(w)).filter("r = 1").select("page", "eye", "text")


@query()
def page_choice_all(t):
    """The same over all readings that have a text, whatever its signs."""
    return page_choice(t, "")


WORDS = "SELECT id AS doc, CAST(0 AS INTEGER) AS page, CAST(i-1 AS INTEGER) AS seq, w AS word FROM (SELECT id, unnest(regexp_extract_all(coalesce(verbatim,''),'[A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all(coalesce(verbatim,''),'[A-Za-z]+'),1) AS i FROM obs)"


@query(f"""WITH w AS ({WORDS}) SELECT a.doc, a.page, a.seq FROM w a JOIN w b ON b.doc=a.doc AND b.seq=a.seq+1 WHERE lower(a.word)='section' AND lower(b.word)='the' UNION ALL SELECT a.doc, a.page, a.seq FROM w a JOIN w b ON b.doc=a.doc AND b.seq=a.seq+1 WHERE lower(a.word)='shall' AND lower(b.word)='not'""")
def phrase_places(t):
    """Where phrases begin on a page."""
    w = t.obs.select(F.col("id").alias("doc"), F.lit(0).alias("page"), F.posexplode(F.regexp_extract_all(sc.text_of("verbatim"), F.lit("[A-Za-z]+"), F.lit(0))).alias("seq", "word"))
    return lk.phrase_places(w, ["section", "the"]).unionAll(lk.phrase_places(w, ["shall", "not"]))


@query("""WITH e AS (SELECT DISTINCT a.name AS src, b.name AS dst FROM signers a JOIN signers b ON a.token=b.token AND a.name<>b.name), q AS (SELECT DISTINCT name AS r FROM signers WHERE starts_with(name,'Nadia')), n AS (SELECT DISTINCT dst AS r FROM e WHERE src IN (SELECT r FROM q) AND dst NOT IN (SELECT r FROM q)), h AS (SELECT r, 0 AS hops FROM q UNION ALL SELECT r, 1 FROM n) SELECT token AS passage, CAST(min(hops) AS INTEGER) AS hops FROM signers JOIN h ON h.r=name WHERE token NOT IN (SELECT token FROM gist WHERE read='text') GROUP BY 1""")
def activation_retrieval(t):
    """Passages that mention a question's names or their neighbours, without those seen."""
    s = t.signers.select("token", "name").distinct()
    e = s.join(s.select("token", F.col("name").alias("dst")), "token").filter("name <> dst").select(F.col("name").alias("src"), "dst").distinct()
    q = s.filter(F.col("name").startswith("Nadia")).select(F.col("name").alias("referent")).distinct()
    return lk.activation(s.select(F.col("token").alias("passage"), F.col("name").alias("referent")), q, e, t.gist.filter("read = 'text'").select(F.col("token").alias("passage")))


@query("""WITH x AS (SELECT o_custkey AS q, o_orderstatus AS v, o_orderkey AS d, o_orderpriority='5-LOW' AS r FROM orders UNION ALL SELECT c_custkey, NULL, NULL, NULL FROM customer) SELECT q AS question, CASE WHEN count(d)=0 THEN 'void' WHEN bool_and(coalesce(r,false)) THEN 'refuted' WHEN count(DISTINCT v)>1 OR bool_or(coalesce(r,false)) THEN 'contested' WHEN count(DISTINCT d)<2 THEN 'single' ELSE 'supported' END AS status FROM x GROUP BY 1""")
def answer_status(t):
    """How well questions are answered by their evidence."""
    e = t.orders.select(F.col("o_custkey").alias("question"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("doc"), (F.col("o_orderpriority") == "5-LOW").alias("refuted"))
    c = t.customer.select(F.col("c_custkey").alias("question"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("doc"), F.lit(None).cast("boolean").alias("refuted"))
    return lk.answer_status(e.unionAll(c))


@query("""WITH m AS (SELECT DISTINCT l_orderkey%10 AS doc, l_orderkey AS stmt, l_suppkey AS name FROM lineitem), k AS (SELECT name FROM m GROUP BY 1 HAVING count(DISTINCT doc)>=9), n AS (SELECT * FROM m WHERE name IN (SELECT name FROM k)) SELECT a.name AS a, b.name AS b, 4*count(DISTINCT a.doc)+count(*) AS weight FROM n a JOIN n b ON a.stmt=b.stmt AND a.doc=b.doc AND a.name<b.name GROUP BY 1,2""")
def corpus_map(t):
    """Names of enough sources that stand together, 4 per source and 1 per statement."""
    m = t.lineitem.select((F.col("l_orderkey") % 10).alias("doc"), F.col("l_orderkey").alias("stmt"), F.col("l_suppkey").alias("name"))
    return lk.corpus_map(m, 9)


@query("""WITH p AS (SELECT DISTINCT token AS prior, w AS term FROM (SELECT token, unnest(regexp_extract_all(lower(coalesce(description,'')),'[a-z]{4,}')) AS w FROM contracts)), s AS (SELECT DISTINCT id, w AS term FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(verbatim,'')),'[a-z]{4,}')) AS w FROM obs)), n AS (SELECT prior, count(*) AS n FROM p GROUP BY 1), c AS (SELECT p.prior, s.id, count(*)/min(n) AS coverage FROM p JOIN s ON s.term=p.term JOIN n ON n.prior=p.prior GROUP BY 1,2 HAVING count(*)/min(n)>=0.5) SELECT prior, id, round(coverage,6) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY prior ORDER BY coverage DESC, id) AS r FROM c) WHERE r=1""")
def prior_attestation(t):
    """The observation that covers most of a contract's description, if half or more."""
    words = lambda c: F.regexp_extract_all(F.lower(sc.text_of(c)), F.lit("[a-z]{4,}"), F.lit(0))
    p = t.contracts.select(F.col("token").alias("prior"), words("description").alias("terms")).groupBy("prior").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    return lk.attest_sets(p, t.obs.select("id", words("verbatim").alias("terms"))).withColumn("coverage", F.round("coverage", 6))


@query("""WITH m AS (SELECT DISTINCT name, token FROM signers), s AS (SELECT name, count(*) AS sources FROM m GROUP BY 1) SELECT lower(name) AS name, CAST(sum(k) AS BIGINT) AS sources, min(surface) AS shown FROM (SELECT name, name AS surface, count(DISTINCT token) AS k FROM signers GROUP BY 1,2) GROUP BY 1""")
def referent_support(t):
    """Names by distinct sources, with the way they are mostly written."""
    m = t.signers.select(F.lower("name").alias("name"), F.col("token").alias("doc"), F.col("name").alias("surface")).filter("name is not null")
    return ag.earned(m).select("name", "sources", "shown")


@query("""WITH o AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'click' THEN 'INS' WHEN 'purchase' THEN 'INS' WHEN 'view' THEN 'CON' ELSE 'REC' END AS op FROM events) SELECT CAST(user_id%40 AS VARCHAR) AS key, count(*) AS mentions, count(DISTINCT event_type) AS sources, arg_min(event_type, event_id) AS first FROM o WHERE op='INS' GROUP BY 1""")
def delta_fold_cast(t):
    """A reading's operations folded: the cast, with who had each first."""
    op = F.when(F.col("event_type").isin("click", "purchase"), "INS").when(F.col("event_type") == "view", "CON").otherwise("REC")
    l = t.events.select(F.col("event_type").alias("source"), F.col("event_id").alias("seq"), op.alias("operator"), (F.col("user_id") % 40).cast("string").alias("key"), (F.col("user_id") % 7).cast("string").alias("other"))
    return ol.fold_reading(l)["cast"]


@query("""SELECT least(CAST(user_id%40 AS VARCHAR), CAST(event_id%7 AS VARCHAR)) AS a, greatest(CAST(user_id%40 AS VARCHAR), CAST(event_id%7 AS VARCHAR)) AS b, count(*) AS mentions, count(DISTINCT event_type) AS sources, count(*)+3*count(DISTINCT event_type) AS score FROM events WHERE event_type IN ('view','error') GROUP BY 1,2""")
def delta_fold_bonds(t):
    l = t.events.select(F.col("event_type").alias("source"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("view", "error"), "CON").otherwise("INS").alias("operator"), (F.col("user_id") % 40).cast("string").alias("key"), (F.col("event_id") % 7).cast("string").alias("other"))
    return ol.ranked_bonds(ol.fold_reading(l)["bonds"]).select("a", "b", "mentions", "sources", "score")


@query("""SELECT token, count(*) FILTER (f='uncertain') AS uncertain, count(*) FILTER (f='attributed') AS attributed, count(*) FILTER (f='plan') AS plan, count(*) FILTER (f='fact') AS fact FROM (SELECT token, CASE WHEN regexp_matches(l,'\\b(may|might|could|possibly|perhaps|likely|unclear|appears to|seems)\\b') THEN 'uncertain' WHEN regexp_matches(l,'\\b(said|says|told|reported|estimated|according to|wants|claims?|claimed|argued|believes?)\\b') THEN 'attributed' WHEN regexp_matches(l,'\\b(will|plans? to|should|expected to|expects?|intends?|proposed?|aims? to|scheduled)\\b') THEN 'plan' ELSE 'fact' END AS f FROM (SELECT token, lower(coalesce(verbatim,'')) AS l FROM obs)) GROUP BY 1""")
def frames_by_source(t):
    """Statements of each source by frame, one row per source."""
    p = t.obs.select("token", sc.frame_of("verbatim").alias("f")).groupBy("token").pivot("f", ["uncertain", "attributed", "plan", "fact"]).count()
    return p.select("token", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("uncertain", "attributed", "plan", "fact")])


@query("""SELECT regexp_replace(lower(regexp_extract(coalesce(url,''),'^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]*)',1)),'^www[.]','') AS site, coalesce(published,'')[:4] AS year, count(*) AS n, count(DISTINCT publisher) AS publishers FROM documents GROUP BY 1,2""")
def slices(t):
    """Documents by site and year."""
    return t.documents.groupBy(sc.url_host("url").alias("site"), F.substring(sc.text_of("published"), 1, 4).alias("year")).agg(F.count("*").alias("n"), F.count_distinct("publisher").alias("publishers"))


@query("""WITH m AS (SELECT DISTINCT name, token FROM signers), s AS (SELECT name, count(*) AS k FROM m GROUP BY 1) SELECT token, count(*) FILTER (k>=2) AS earned, count(*) FILTER (k=1) AS only_here FROM m JOIN s ON s.name=m.name GROUP BY 1""")
def per_source_rollup(t):
    """Per source: names that others have too, and its own."""
    m = t.signers.select("name", "token").filter("name is not null").distinct()
    s = m.groupBy("name").agg(F.count("*").alias("k"))
    return m.join(s, "name").groupBy("token").agg(F.count_if(F.col("k") >= 2).alias("earned"), F.count_if(F.col("k") == 1).alias("only_here"))


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)<=25""")
def trimmed_per_source(t):
    """The 25 longest documents of each source, as an index keeps of its maps."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t.documents.select("doc_id", F.row_number().over(w).alias("place")).filter("place <= 25")


@query("""WITH a AS (SELECT event_id%500 AS id, max(event_id) AS v FROM events WHERE event_type IN ('view','click') GROUP BY 1) SELECT id, v FROM a WHERE id NOT IN (SELECT event_id%500 FROM events WHERE event_type='error' AND value>150)""")
def merge_devices(t):
    """Two devices' rows as one; what was removed never comes back."""
    e = t.events.select((F.col("event_id") % 500).alias("id"), F.col("event_id").alias("v"), "event_type", "value")
    a, b = e.filter("event_type = 'view'").select("id", "v"), e.filter("event_type = 'click'").select("id", "v")
    return ol.merge_devices(a, b, e.filter("event_type = 'error' and value > 150"), "id", ["v"])


@query("""WITH q AS (SELECT id AS query, token, a, b, unnest(list_distinct(regexp_extract_all(lower(verbatim),'[a-z]{5,}'))) AS term FROM obs), c AS (SELECT id AS key, unnest(list_distinct(regexp_extract_all(lower(text),'[a-z]{5,}'))) AS term FROM chunks), h AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, key) AS rank FROM q JOIN c ON c.term=q.term GROUP BY 1,2), g AS (SELECT DISTINCT q.id AS query, c.id AS key FROM obs q JOIN chunks c ON c.token=q.token AND q.a<c.b AND c.a<q.b)
SELECT count(*) AS queries, CAST(sum(hit) AS BIGINT) AS found, round(avg(hit),6) AS recall FROM (SELECT g.query, max(CASE WHEN h.rank<=10 THEN 1 ELSE 0 END) AS hit FROM g LEFT JOIN h ON h.query=g.query AND h.key=g.key GROUP BY 1)""")
def span_recall(t):
    """Whether a chunk that holds a quoted passage by its place is among the ten that share most words with it."""
    q = t.obs
    terms = lambda x: F.regexp_extract_all(F.lower(sc.text_of(x)), F.lit("[a-z]{5,}"), F.lit(0)).alias("terms")
    c = t.chunks.select(F.col("id").alias("key"), "token", F.col("a").alias("ca"), F.col("b").alias("cb"))
    truth = q.join(c, "token").filter("a < cb and ca < b").select(F.col("id").alias("query"), "key")
    return se.passage_recall(q.select(F.col("id").alias("query"), terms("verbatim")), t.chunks.select(F.col("id").alias("key"), terms("text")), truth, 10)


@query()
def companions_of_first(t):
    """Vectors nearer to the first than the 95th percentile of random pairs."""
    return ev.companions(t.embeddings, "vec_id", "embedding", 0)


@query()
def summary_ladder(t):
    """Statements of each contract chosen for worth and difference; every prefix is a summary."""
    w = t.obs.filter("verbatim is not null and token is not null")
    terms = w.select("id", F.col("token").alias("doc"), F.explode(F.regexp_extract_all(F.lower("verbatim"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term")).groupBy("id", "doc", "term").agg(F.count("*").alias("tf"))
    v = pr.tfidf(terms.select("id", "term", "tf")).join(terms.select("id", "doc", "term"), ["id", "term"])
    r = v.groupBy("doc", "id").agg(F.sum("w").alias("worth"), F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"))
    return pr.summary_select(r.withColumn("worth", F.col("worth") / 100), 5)


@query()
def read_across(t):
    """Mutually best pairs of statements of two contracts that beat chance."""
    o = t.obs.filter("token is not null").select("id", F.col("token").alias("doc"), F.col("verbatim").alias("text"))
    return pr.read_across(o, rare=False)


@query()
def read_statements(t):
    """Statements of the documents with their spans, names, figures and years."""
    return al.read_statements(t.documents, "doc_id", "text")


@query()
def register_sniff(t):
    """The kind of writing of each document by its vocabulary."""
    w = t.documents.filter("source is not null").select(F.col("source").alias("genre"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0))).alias("word"))
    g = ev.register_prior(w.groupBy("genre", "word").agg(F.count("*").alias("n"))).select("genre", "word", F.log1p("g2").alias("weight"))
    return lk.register_sniff(t.documents, "doc_id", "text", g)


@query()
def prose_or_record(t):
    """Documents whose structure exceeds every one of 199 peers'."""
    o = t.obs.filter("verbatim is not null").select("id", F.col("verbatim").alias("text"))
    return lk.prose_test(t.documents.select(F.col("doc_id").alias("id"), "text"), o)


@query()
def null_floor(t):
    """The score chance reaches, by size of a statement."""
    tok = shared_tokens(t, None)
    n = tok.groupBy("id").agg(F.count("*").alias("na")).select("na", F.col("na").alias("nb")).distinct()
    return nl.floors(tok, n).select(F.col("na").alias("size"), "floor")


@query()
def drive_state(t):
    """Folders of each workspace after all events."""
    e = t.events.select((F.col("user_id") % 20).cast("string").alias("workspace"), "ts", "event_id", F.element_at(F.array(*[F.lit(x) for x in ("folder", "rename", "move", "trash", "place")]), (F.col("event_id") % 5 + 1).cast("int")).alias("op"), (F.col("event_id") % 11).cast("string").alias("id"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 7).cast("string")).alias("parent"))
    return ol.drive_state(e)


@query()
def discussion(t):
    """Comments after edits and deletions by those who may."""
    e = t.events.select(F.col("event_id").cast("string").alias("event_id"), "ts", F.col("user_id").cast("string").alias("sender"), F.when(F.col("event_type") == "view", "comment").when(F.col("event_type") == "click", "edit").otherwise("resolve").alias("op"), F.when(F.col("event_type") == "view", "thread").otherwise((F.col("event_id") - 1).cast("string")).alias("target"), F.col("props").alias("body"))
    led = t.events.groupBy(F.col("user_id").cast("string").alias("sender")).agg(F.min("ts").alias("since"), F.lit("editor").alias("role"))
    return ol.fold_talk(e, led, "1")[0]


@query("""WITH c AS (SELECT DISTINCT id, token AS doc, unnest(regexp_extract_all(verbatim,'Section ([0-9]+)[.]',1)) AS num FROM obs), o AS (SELECT token AS doc, min(id) AS id, regexp_extract(x,'^([0-9]+)[.]',1) AS num, x FROM (SELECT token, id, unnest(string_split(coalesce(text,''),chr(10))) AS x FROM chunks) WHERE regexp_full_match(x,'[0-9]+[.] [A-Z ]+') GROUP BY token, x), t AS (SELECT doc, num, count(*) AS n, min(id) AS target FROM o GROUP BY 1,2)
SELECT c.id, c.num, CASE WHEN n=1 THEN target END AS target, CASE WHEN n IS NULL THEN 'nothing opens with it' WHEN n>1 THEN 'several open with it' END AS why FROM c LEFT JOIN t ON t.doc=c.doc AND t.num=c.num""")
def citation_resolution(t):
    """Cited sections led to the only heading that opens with their number, or the reason why not."""
    c = t.obs.select("id", F.col("token").alias("doc"), F.explode(F.regexp_extract_all("verbatim", F.lit(r"Section ([0-9]+)[.]"), F.lit(1))).alias("num")).distinct()
    h = headings(t).groupBy("doc", "heading").agg(F.min("id").alias("id"))
    return pr.resolve_citations(c, h.select("doc", "id", F.regexp_extract("heading", r"^([0-9]+)[.]", 1).alias("num"))).select("id", "num", "target", "why")


@query("""WITH t AS (SELECT id, token AS doc, unnest(list_distinct(regexp_extract_all(lower(coalesce(verbatim,'')),'[a-z]{5,}'))) AS term FROM obs WHERE kind='notice' AND token IS NOT NULL), n AS (SELECT id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM t x JOIN t y ON x.term=y.term AND x.id<y.id AND x.doc<>y.doc GROUP BY 1,2) SELECT a, b, round(k/sqrt(p.n*q.n),6) AS cosine FROM s JOIN n p ON p.id=a JOIN n q ON q.id=b WHERE k/sqrt(p.n*q.n)>=0.3""")
def echo_cosine(t, where="kind = 'notice'"):
    """Notices of different contracts that say nearly the same."""
    o = t.obs.filter("token is not null").filter(where)
    x = o.select("id", F.col("token").alias("doc"), F.regexp_extract_all(F.lower(sc.text_of("verbatim")), F.lit("[a-z]{5,}"), F.lit(0)).alias("terms"))
    return pr.echo_sets(x, 0.3 - 1e-12).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(SQL["echo_cosine"].replace("kind='notice' AND ", ""))
def echo_cosine_all(t):
    """Statements of every kind, of different contracts, that say nearly the same."""
    return echo_cosine(t, "true")


@query()
def candidate_binding(t):
    """Parties as candidates for the contracts whose text names them: bound if words speak for them and nothing against."""
    g = t.contracts.select(F.col("token").alias("id"), F.split(F.lower(sc.text_of("party")), r"\W+").alias("words"), F.lit("party").alias("kind"), F.lit(2020).alias("year")).dropDuplicates(["id"])
    s = t.signers.filter("name is not null").select(F.col("name").alias("cand"), F.col("token").alias("id"), F.split(F.lower("name"), r"\W+").alias("words"), F.lit("party").alias("kind"), F.lit(None).cast("int").alias("since"), F.lit(None).cast("int").alias("until")).distinct()
    return lk.bind_candidates(g, s).select("id", "cand", "shared", "verdict")


@query()
def polarity_beaten(t):
    """Denials and statements of other sources nearer to them than chance brings any of their sizes."""
    return lk.polarity_links(t.obs.select("id", F.col("verbatim").alias("text")), shared_tokens(t, None), null=True).select("denial", "id")


@query()
def misread_words(t):
    """Words of the contracts' texts that the corpus hardly knows, and what they are mended to or why not."""
    return rp.repairs(t.chunks, "id", "text")
