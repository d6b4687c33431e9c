"""Functions of texts: formats, frames, words, statements, readers of forms and markup."""

from pyspark.sql import functions as F

from quarrystone.functions import scalars as sc
from quarrystone.operators import aggregates as ag
from quarrystone.queries.registry import query
from quarrystone.sources import markup as mk
from quarrystone.sources import tabular as tb


def fmt(x):
    """The formats as one SQL expression; the patterns are fixed values that stand with the function."""
    s = f"trim(coalesce({x},''))"
    tests = [f"WHEN regexp_full_match({s},'{p.replace(chr(39), chr(39) * 2)}') AND length({s})>={sc.SHORTEST.get(name, 0)} THEN '{name}'" for name, p in sc.FORMATS]
    return f"CASE WHEN {s}='' THEN 'empty' {' '.join(tests)} WHEN length({s})>{sc.FREE} THEN 'free-text' ELSE 'text' END"


VALUES = "SELECT number AS v FROM contracts UNION ALL SELECT party FROM contracts UNION ALL SELECT expires FROM contracts UNION ALL SELECT fetched_at FROM contracts UNION ALL SELECT CASE WHEN json_valid(fields) THEN json_extract_string(fields,'$.amount') END FROM obs UNION ALL SELECT email FROM signers"


@query(f"""SELECT v, {fmt("v")} AS format, count(*) AS n FROM ({VALUES}) GROUP BY 1,2""")
def value_format(t):
    """What values of several columns look like."""
    c = t.contracts
    v = [c.select(F.col(x).alias("v")) for x in ("number", "party", "expires", "fetched_at")] + [t.obs.select(F.get_json_object("fields", "$.amount").alias("v")), t.signers.select(F.col("email").alias("v"))]
    u = v[0]
    for x in v[1:]:
        u = u.unionAll(x)
    return u.groupBy("v", sc.value_format("v").alias("format")).agg(F.count("*").alias("n"))


FRAME = "CASE WHEN regexp_matches(l,'\\b(may|might|could|possibly|perhaps|likely|unclear|appears to|seems)\\b') THEN 'uncertain' WHEN regexp_matches(l,'\\b(said|says|told|reported|estimated|according to|wants|claims?|claimed|argued|believes?)\\b') THEN 'attributed' WHEN regexp_matches(l,'\\b(will|plans? to|should|expected to|expects?|intends?|proposed?|aims? to|scheduled)\\b') THEN 'plan' ELSE 'fact' END"


@query(f"""SELECT kind, {FRAME} AS frame, count(*) AS n, count(*) FILTER (list_has_any(regexp_extract_all(l,'[0-9A-Za-z_]+'),['not','never','none','nothing','without','neither','nor','cannot','disclaim','disclaims','prohibit','prohibits','prohibited']) OR contains(regexp_replace(l,'[a-z0-9_]n[''’]t\\b',chr(1)),chr(1)) OR len(regexp_extract_all(l,'\\bno\\b'))>len(regexp_extract_all(l,'\\bno\\b[.]?\\s*[0-9]'))) AS negated FROM (SELECT kind, lower(coalesce(verbatim,'')) AS l FROM obs) GROUP BY 1,2""")
def frame_counts(t):
    """Statements by frame, and how many deny."""
    return t.obs.groupBy("kind", sc.frame_of("verbatim").alias("frame")).agg(F.count("*").alias("n"), F.count_if(sc.negated("verbatim")).alias("negated"))


@query("""SELECT doc_id, trim(regexp_replace(coalesce(title,''),'\\s+',' ','g')) AS clean, regexp_replace(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9]+','_','g'),'^_+|_+$','','g') AS snake, sha256(coalesce(url,'')) AS sha, CASE WHEN length(trim(regexp_replace(coalesce(title,''),'\\s+',' ','g')))>20 THEN rtrim(trim(regexp_replace(coalesce(title,''),'\\s+',' ','g'))[:19])||'…' ELSE trim(regexp_replace(coalesce(title,''),'\\s+',' ','g')) END AS short FROM documents""")
def shaped_text(t):
    return t.documents.select("doc_id", sc.clean("title").alias("clean"), sc.snake("title").alias("snake"), F.sha2(sc.text_of("url"), 256).alias("sha"), sc.cut("title", 20).alias("short"))


@query("""SELECT doc_id, regexp_replace(lower(regexp_extract(regexp_replace(coalesce(url,''),'^[a-z]+://',''),'^([^/]*)',1)),'^www[.]','')||regexp_extract(regexp_replace(regexp_replace(regexp_replace(coalesce(url,''),'^[a-z]+://',''),'[#?].*$',''),'/+$',''),'^[^/]*(.*)$',1) AS key FROM documents""")
def url_keys(t):
    return t.documents.select("doc_id", sc.norm_url("url").alias("key"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split_regex(coalesce(text,''),'\\n+')) AS l FROM documents), p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(l,'([.!?])[\\s\\x0b]+','\\1\ue000','g'),'\ue000')) AS x FROM s) SELECT doc_id, count(*) AS n, CAST(sum(length(trim(x,' '))) AS BIGINT) AS chars FROM p WHERE trim(x,' ')<>'' GROUP BY 1""")
def statement_counts(t):
    """Statements of each document and their length."""
    s = t.documents.select("doc_id", F.explode(sc.statements("text")).alias("x"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("chars"))


@query("""SELECT id, unnest(regexp_extract_all(verbatim,'(?i)(?:§+|\\b(?:sections?|secs?\\.|articles?|art\\.|clauses?|cl\\.|chapters?|ch\\.|paragraphs?|par\\.))\\s*([0-9]+(?:\\.[0-9]+)*)',1)) AS num FROM obs""")
def citation_parse(t):
    return t.obs.select("id", F.explode(sc.citations("verbatim")).alias("num"))


@query("""SELECT unit, value, count(*) AS n, count(DISTINCT token) AS docs FROM (SELECT token, CASE WHEN starts_with(m,'$') THEN 'dollars' ELSE 'percent' END AS unit, CAST(replace(replace(replace(m,'$',''),'%',''),',','') AS DOUBLE) AS value FROM (SELECT token, unnest(regexp_extract_all(verbatim,'[$][0-9][0-9,]*(?:[.][0-9]+)?|[0-9]+(?:[.][0-9]+)?%')) AS m FROM obs)) GROUP BY 1,2""")
def figures_by_unit(t):
    """Amounts and percentages with how often and in how many contracts they stand."""
    m = t.obs.select("token", F.explode(F.regexp_extract_all("verbatim", F.lit(r"[$][0-9][0-9,]*(?:[.][0-9]+)?|[0-9]+(?:[.][0-9]+)?%"), F.lit(0))).alias("m"))
    v = m.select("token", F.when(F.col("m").startswith("$"), "dollars").otherwise("percent").alias("unit"), F.regexp_replace("m", "[$%,]", "").cast("double").alias("value"))
    return v.groupBy("unit", "value").agg(F.count("*").alias("n"), F.count_distinct("token").alias("docs"))


@query("""WITH l AS (SELECT token, trim(x) AS line FROM (SELECT token, unnest(string_split(coalesce(text,''),chr(10))) AS x FROM chunks)) SELECT token, line, count(*) AS n FROM l WHERE length(line) BETWEEN 3 AND 60 AND len(string_split(line,' '))<=6 GROUP BY 1,2 HAVING count(*)>=3""")
def repeated_lines(t):
    """Short lines that come again and again in a contract: what an ignore rule would blank."""
    l = t.chunks.select("token", F.explode(F.split(sc.text_of("text"), "\n")).alias("x")).select("token", F.trim("x").alias("line"))
    return l.filter((F.length("line").between(3, 60)) & (F.size(F.split("line", " ")) <= 6)).groupBy("token", "line").agg(F.count("*").alias("n")).filter("n >= 3")


@query("""SELECT token, regexp_replace(lower(party),'^the\\s+','') AS key, levenshtein(lower(party),'kenneth amblobridge') AS d, round(1-levenshtein(lower(party),'kenneth amblobridge')/greatest(length(party),19),6) AS sim FROM contracts WHERE regexp_full_match(party,'[ -~]+') AND NOT contains(party,'  ') AND trim(party)=party""")
def name_similarity(t, where=r"party rlike r'^[ -~]+$' and not contains(party, '  ') and trim(party) = party"):
    p = t.contracts.filter(where)
    l = F.lower("party")
    return p.select("token", sc.referent_key("party").alias("key"), F.levenshtein(l, F.lit("kenneth amblobridge")).cast("bigint").alias("d"), F.round(sc.similarity(l, F.lit("kenneth amblobridge")), 6).alias("sim"))


@query()
def name_similarity_all(t):
    """The same over all parties, whatever their letters and blanks."""
    return name_similarity(t, "party is not null")


@query("""SELECT event_id, CASE WHEN v//3600>0 THEN (v//3600)||':'||lpad(CAST((v//60)%60 AS VARCHAR),2,'0')||':'||lpad(CAST(v%60 AS VARCHAR),2,'0') ELSE (v//60)||':'||lpad(CAST(v%60 AS VARCHAR),2,'0') END AS clock FROM (SELECT event_id, CAST(floor(value*30) AS BIGINT) AS v FROM events)""")
def clock_format(t):
    return t.events.select("event_id", sc.clock(F.col("value") * 30).alias("clock"))


@query("""SELECT id, CAST(s AS INTEGER) AS s, substr(verbatim, CAST(s AS INTEGER)+1, 60) AS text FROM (SELECT id, verbatim, unnest(range(0, CAST(greatest(0, ceil((length(verbatim)-60)/45.0))*45+1 AS BIGINT), 45)) AS s FROM obs WHERE length(verbatim)>0)""")
def fixed_chunks(t):
    """Pieces of 60 characters that overlap by a quarter."""
    return tb.fixed_chunks(t.obs, "id", "verbatim", 60, 0.25).select("id", "s", "text")


@query("""SELECT token, 'contract: '||concat_ws('; ', CASE WHEN trim(coalesce(number,''))<>'' THEN 'number '||trim(number) END, CASE WHEN trim(coalesce(party,''))<>'' THEN 'party '||trim(party) END, CASE WHEN trim(coalesce(status,''))<>'' THEN 'status '||trim(status) END)||'.' AS sentence FROM contracts""")
def row_sentences(t):
    c = t.contracts
    return c.select("token", tb.row_sentences(c, "contract", ["number", "party", "status"]).alias("sentence"))


@query("""WITH w AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(coalesce(verbatim,'')),'[a-z]{5,}'))) AS word FROM obs) SELECT CASE WHEN ends_with(word,'ations') AND length(word)-6>=4 THEN left(word,length(word)-6) WHEN ends_with(word,'ation') AND length(word)-5>=4 THEN left(word,length(word)-5) WHEN ends_with(word,'ing') AND length(word)-3>=4 THEN left(word,length(word)-3) WHEN ends_with(word,'ed') AND length(word)-2>=4 THEN left(word,length(word)-2) WHEN ends_with(word,'s') AND length(word)-1>=4 THEN left(word,length(word)-1) ELSE word END AS stem, count(*) AS n FROM w GROUP BY 1""")
def suffix_stems(t):
    w = t.obs.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(sc.text_of("verbatim")), F.lit("[a-z]{5,}"), F.lit(0)))).alias("word"))
    return w.groupBy(sc.stem("word", ("ations", "ation", "ing", "ed", "s")).alias("stem")).agg(F.count("*").alias("n"))


@query("""SELECT md5(coalesce(text,'')) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1""")
def dedupe_docs_hash(t):
    return t.documents.groupBy(F.md5(sc.text_of("text")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text,'')),'\\bthe\\b')) AS INTEGER) AS n FROM documents WHERE regexp_full_match(text,'[\\x00-\\x7f]*')""")
def surface_counts(t):
    return t.documents.filter(F.col("text").rlike(r"\A[\x00-\x7f]*\z")).select("doc_id", sc.surface_count("text", "the").alias("n"))


@query()
def surface_counts_all(t):
    """The same over all documents that have a text, whatever its letters."""
    whole = r"(?<![\p{L}\p{M}\p{N}_])the(?![\p{L}\p{M}\p{N}_])"
    return t.documents.filter("text is not null").select("doc_id", F.regexp_count(F.lower("text"), F.lit(whole)).alias("n"))


@query("""WITH x AS (SELECT o_orderkey, 'A '||CAST(o_totalprice AS VARCHAR) AS s, o_totalprice AS v FROM orders) SELECT o_orderkey, v>=50000 AS big, left(s,1) AS head FROM x""")
def columns_projected(t):
    """A plain projection, pruned to two columns."""
    return t.orders.select("o_orderkey", (F.col("o_totalprice") >= 50000).alias("big"), F.lit("A").alias("head"))


@query()
def signers_scan(t):
    """Signers read out of completion certificates."""
    return tb.signer_table(t.chunks, "token", "text")


@query()
def form_field_lines(t):
    """Labels and values of the forms within chunks, each once per contract."""
    return mk.over(t.chunks.filter("text is not null"), "id", "text", tb.form_fields, "label string, value string")


@query()
def chunk_overlap(t):
    """Documents in overlapping pieces that end at blanks."""
    return tb.chunk_table(t.documents, "doc_id", "text").select("doc_id", "a", "b", F.length("text").alias("n"))


@query()
def field_priors(t):
    """The usual format of each label."""
    f = mk.over(t.chunks.filter("text is not null"), "id", "text", tb.form_fields, "label string, value string")
    return ag.learn_rules(f.select(sc.snake("label").alias("label"), sc.value_format("value").alias("format")), 3, 0.6)


@query()
def caption_cues(t):
    """Cues of the captions among the documents."""
    d = t.documents.filter(F.col("text").startswith("WEBVTT"))
    return mk.over(d, "doc_id", "text", mk.captions, "start double, end double, text string")


@query()
def email_headers(t):
    """Headers of the mail among the documents."""
    d = t.documents.filter(F.col("text").startswith("From:"))
    return mk.over(d, "doc_id", "text", mk.read_email, "subject string, from string, to string, date string, text string")
