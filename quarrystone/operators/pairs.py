"""Pairs of statements across documents: shared-token scores, mutual best, near copies, verdicts on what they say, and near
spellings. Pairs are only ever formed through shared tokens that are rare enough, never each with each."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.scalars import bigrams, draw, words
from quarrystone.operators.blocks import BLOCK, Given, Weighed, hashes, in_blocks, past
from quarrystone.session import cut


def token_table(sts: DataFrame, key: str = "id", doc: str = "doc", text: str = "text", with_pairs: bool = True) -> DataFrame:
    """(id, doc, token): distinct tokens of statements of 12 characters or more."""
    # The words are a column of their own first: within the pairs' lambda they would be taken apart anew for every pair.
    w = sts.filter(F.length(text) >= 12).select(F.col(key).alias("id"), F.col(doc).alias("doc"), words(text).alias("w"))
    t = F.array_union(F.array_distinct("w"), F.array_distinct(bigrams(F.col("w")))) if with_pairs else F.array_distinct("w")
    return w.select("id", "doc", F.explode(t).alias("token"))


def idf_bits(tokens: DataFrame) -> DataFrame:
    """(token, df, idf): log2((N + 1) / df), N the statements."""
    n = tokens.agg(F.count_distinct("id").alias("n"))
    return tokens.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("token", "df", F.log2((F.col("n") + 1) / F.col("df")).alias("idf"))


def blocked_tokens(tokens: DataFrame, rare: bool = True) -> DataFrame:
    """tokens + idf of those that stand in 2 to max(2, ceil(sqrt N)) statements: the only ones pairs are formed through. A
    token's pairs are then at most N, so skewed words cost nothing. Without ``rare``, of all that can be shared: in 2 statements or more."""
    n = tokens.agg(F.count_distinct("id").alias("n"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).filter("df >= 2")
    df = df.filter(F.col("df") <= F.greatest(F.lit(2), F.ceil(F.sqrt("n")))) if rare else df
    # Counted with partial sums, so no word is put together in one task; written once: both sides of every pair join read this
    # small table, not the texts.
    return cut(tokens.join(df.select("token", F.log2((F.col("n") + 1) / F.col("df")).alias("idf")), "token").select(*tokens.columns, "idf"), "blocked")


def pair_scores(blocked: DataFrame) -> DataFrame:
    """(a, b, doc_a, doc_b, shared, score) of statements of different documents, a < b, by the idf of the rare tokens they share."""
    x, y = blocked.alias("x"), blocked.alias("y")
    return (
        x.join(y, "token")
        .filter("x.id < y.id and x.doc <> y.doc")
        .groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.doc").alias("doc_a"), F.col("y.doc").alias("doc_b"))
        .agg(F.count("*").alias("shared"), F.sum("x.idf").alias("score"))
    )


def proposals(blocked: DataFrame) -> DataFrame:
    """(doc_a, doc_b, shared): document pairs by the rare tokens both hold."""
    d = blocked.select("doc", "token").distinct()
    x, y = d.alias("x"), d.alias("y")
    return x.join(y, "token").filter("x.doc < y.doc").groupBy(F.col("x.doc").alias("doc_a"), F.col("y.doc").alias("doc_b")).agg(F.count("*").alias("shared"))


#: Different sizes of statements up to which all floors are at hand in every task; scores that a task holds at once.
SIZES, CELLS = 500, 4_000_000


def read_across(sts: DataFrame, null: bool = True, block: int = BLOCK // 4, sizes: int = SIZES, rare: bool = True, cells: int = CELLS) -> DataFrame:
    """Mutually best pairs of statements of two documents, scored, per pair of documents; with ``null`` only those whose score exceeds
    what random bags of their sizes reach (see ``nulls.floors``). With ``rare`` only tokens of ``blocked_tokens`` count, without it all
    that two share, as in the floors. Whole documents run past blocks of whole documents, so what is best either way is
    decided within a task and no other pair leaves it. Scores alike to nine digits are ties."""
    from quarrystone.operators.nulls import beats_floor, floors

    tokens = cut(token_table(sts), "tokens")
    n = tokens.groupBy("id").agg(F.count("*").cast("int").alias("n"))
    # Multiples of a power of two, so that sums are exact in whatever order they are made.
    w = F.rint(F.col("idf") * F.lit(2.0**43)) * F.lit(2.0**-43)
    x = blocked_tokens(tokens, rare).filter("doc is not null").select("id", "doc", F.struct(F.xxhash64("token").alias("c"), w.alias("idf")).alias("x")).groupBy("id", "doc").agg(F.sort_array(F.collect_list("x")).alias("x"))
    rows = cut(x.join(n.hint("merge"), "id").select("id", "doc", "n", F.col("x.c").alias("cs"), F.col("x.idf").alias("ws")), "rows")
    kinds = dict(rows.dtypes)
    have = rows.select("n").distinct()
    early = null and have.count() <= sizes
    bar = None
    if early:  # at most sizes x sizes numbers
        both = have.select(F.col("n").alias("na")).crossJoin(have.select(F.col("n").alias("nb"))).filter("na <= nb")
        got = floors(tokens, both).toPandas()
        ns = np.unique(got["na"].to_numpy())
        i, j, least = np.searchsorted(ns, got["na"]), np.searchsorted(ns, got["nb"]), np.zeros((len(ns), len(ns)))
        least[i, j] = least[j, i] = got["floor"]
        bar = rows.sparkSession.sparkContext.broadcast((ns, least))
    docs = rows.groupBy("doc").agg(F.collect_list(F.struct("id", "n", "cs", "ws")).alias("sts"))
    names = ["a", "b", "doc_a", "doc_b", "shared", "score"] + ["floor"] * early

    def best(b, frames):
        s = Weighed(b)
        ends = np.append(np.flatnonzero(np.diff(b.docs)) + 1, len(b.docs))
        begins = np.append(0, ends[:-1])
        ns, least = bar.value if bar is not None else (None, None)
        theirs = None if bar is None else np.searchsorted(ns, b.n)
        for f in frames:
            out, held = [], 0
            for doc, members in zip(f["doc"], f["sts"]):
                lo = int(np.searchsorted(b.docs, bisect_right(b.doc_names, doc)))  # two documents meet once
                g = Given(b, members)
                if lo == len(b.docs) or not len(g.ks):
                    continue
                mine = None if bar is None else np.searchsorted(ns, g.n)
                while lo < len(b.docs):
                    fit = np.searchsorted(ends, lo + cells // len(members), side="right")
                    hi = int(ends[max(fit - 1, np.searchsorted(ends, lo, side="right"))])
                    at_once = max(1, cells // (hi - lo))
                    i, c, w = s.best(g, lo, hi, at_once)
                    floor = None if bar is None else least[mine[i], theirs[lo + c]]
                    if floor is not None:
                        ok = w > floor
                        i, c, w, floor = i[ok], c[ok], w[ok], floor[ok]
                    if len(c):
                        d = b.docs[lo + c]
                        ok = s.leads(g, i, c, w, lo, hi, at_once, begins[d] - lo, ends[d] - lo)
                        i, y, w = i[ok], lo + c[ok], w[ok]
                        p, q, dp, dq = g.ids[i], b.ids[y], np.full(len(i), doc, object), b.doc_names[b.docs[y]]
                        turn = p > q
                        out.append((np.where(turn, q, p), np.where(turn, p, q), np.where(turn, dq, dp), np.where(turn, dp, dq), s.shared(g, i, y), w, *(() if floor is None else (floor[ok],))))
                        held += len(i)
                    lo = hi
                    if held > 100_000:
                        yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))
                        out, held = [], 0
            if held:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))

    schema = f"a {kinds['id']}, b {kinds['id']}, doc_a {kinds['doc']}, doc_b {kinds['doc']}, shared bigint, score double" + ", floor double" * early
    got = past(docs, in_blocks(rows, "doc", block), best, schema)
    return beats_floor(got, tokens) if null and not early else got


def shingle_jaccard(df: DataFrame, key: str, text: str, least: float = 0.8, n: int = 5) -> DataFrame:
    """(key, class, links): near copies by word shingles. Exact copies (of the same words) are one class member each; texts
    of different words are compared by the shingles of their rarest-first prefix, which any pair of the similarity must share.

    One row per document: its class (the smallest document of its component) and the number of differing texts it is linked
    to; texts of fewer than n words are classes of their own copies."""
    from quarrystone.operators.graph import components

    # The words are a column of their own first: within the shingles' lambda they would be split anew for every shingle.
    w = F.col("w")
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    df = df.select(key, F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ")).alias("w"))
    sh = F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(n)), " "))))).otherwise(F.array().cast("array<bigint>"))
    docs = df.select(F.col(key).alias("k"), F.md5(F.array_join(w, " ")).alias("m"), sh.alias("sh"))
    reps = docs.groupBy("m").agg(F.min("k").alias("rep"), F.first("sh").alias("sh"))
    reps = cut(reps, "reps")
    freq = reps.select(F.explode("sh").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    ordered = reps.select("rep", F.size("sh").alias("size"), F.explode("sh").alias("s")).join(freq, "s")
    ranked = ordered.groupBy("rep", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "s"))), lambda x: x["s"]).alias("order"))
    prefix = cut(ranked.select("rep", "size", F.posexplode(F.slice("order", F.lit(1), (F.col("size") - F.ceil(F.col("size") * least) + 1).cast("int"))).alias("at", "s")), "prefix")
    x, y = prefix.alias("x"), prefix.alias("y")
    # Sizes must be alike, and what can still be shared from the two places on must be enough: all shingles are in one order.
    enough = 1 + F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) - 1 + F.least("x.at", "y.at") >= least / (1 + least) * (F.col("x.size") + F.col("y.size"))
    cand = x.join(y, "s").filter((F.col("x.rep") < F.col("y.rep")) & (F.least("x.size", "y.size") >= least * F.greatest("x.size", "y.size")) & enough).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    sa, sb = reps.select(F.col("rep").alias("a"), F.col("sh").alias("xa")), reps.select(F.col("rep").alias("b"), F.col("sh").alias("xb"))
    inter = F.size(F.array_intersect("xa", "xb"))
    links = cut(cand.join(sa, "a").join(sb, "b").withColumn("i", inter).filter(F.col("i") >= least * (F.size("xa") + F.size("xb") - F.col("i"))).select("a", "b"), "links")
    comp = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    r = reps.select("m", "rep").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    r = r.select("m", F.coalesce("component", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    return docs.select("k", "m").join(r, "m").select(F.col("k").alias(key), "class", "links")


def value_verdicts(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (a, b) + verdict: differs if some figure of one kind and key conflicts and none agrees, same if any agrees,
    extends if one states more than the other, none if neither states any. values: (id, kind, key, value)."""
    v = values.select("id", "kind", "key", "value").distinct()
    x = pairs.select("a", "b").distinct().join(v.withColumnRenamed("id", "a").withColumnRenamed("value", "va"), "a")
    j = x.join(v.withColumnRenamed("id", "b").withColumnRenamed("value", "vb"), ["b", "kind", "key"])
    e = j.groupBy("a", "b").agg(F.bool_or(F.col("va") == F.col("vb")).alias("equal"), F.bool_or(F.col("va") != F.col("vb")).alias("conflict"))
    n = v.groupBy("id").agg(F.count("*").alias("n"))
    out = pairs.join(e, ["a", "b"], "left").join(n.select(F.col("id").alias("a"), F.col("n").alias("na")), "a", "left").join(n.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b", "left")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    verdict = F.when(F.col("conflict") & ~F.col("equal"), "differs").when(F.col("equal"), "same").when(na != nb, "extends").otherwise("none")
    return out.withColumn("verdict", verdict).select(*pairs.columns, "verdict")


def contradictions(values: DataFrame) -> DataFrame:
    """(unit, referent, n_values, docs, verdict): figures of one referent and unit across documents; they contradict where
    two documents or more state different ones."""
    g = values.groupBy("unit", "referent").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("doc").alias("docs"))
    return g.withColumn("verdict", F.when((F.col("docs") > 1) & (F.col("n_values") > 1), "contradiction").when(F.col("docs") > 1, "agreement").otherwise("single source"))


def resolve_citations(cites: DataFrame, openings: DataFrame) -> DataFrame:
    """cites (id, doc, num) + target, why: the only statement of another place that opens with that number in the same
    document, else unresolved with the reason."""
    t = openings.groupBy("doc", "num").agg(F.count("*").alias("n"), F.min("id").alias("target"))
    j = cites.join(t, ["doc", "num"], "left")
    return j.select("id", "doc", "num", F.when(F.col("n") == 1, F.col("target")).alias("target"), F.when(F.col("n").isNull(), "nothing opens with it").when(F.col("n") > 1, "several open with it").alias("why"))


def osa(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment: an adjacent swap is one edit; most + 1 beyond most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a):
        cur = [i + 1]
        for j, y in enumerate(b):
            v = min(cur[j] + 1, prev[j + 1] + 1, prev[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                v = min(v, prev2[j - 1] + 1)
            cur.append(v)
        prev2, prev = prev, cur
    return min(prev[-1], most + 1)


def near_spellings(names: DataFrame, name: str, least: int = 4) -> DataFrame:
    """(a, b, d): distinct names within two edits (adjacent swaps count one), through shared deletions. Every bucket is
    compared whole: a name has few deletions, and names stand once, so buckets are small whatever the names' frequency."""

    def keys(frames):
        for f in frames:
            rows = []
            for at, n in zip(f["at"], f["n"]):
                w = n.lower()
                one = {w[:i] + w[i + 1 :] for i in range(len(w))}
                rows += [(at, k) for k in {w} | one | {v[:i] + v[i + 1 :] for v in one for i in range(len(v))}]
                if len(rows) > 100_000:  # a frame of names has a few hundred times as many deletions
                    yield pd.DataFrame(rows, columns=["at", "k"])
                    rows = []
            yield pd.DataFrame(rows, columns=["at", "k"])

    # Of each deletion only hashes are moved, of each name its number. The optimizer takes the index for as small as the names
    # it is made of and would broadcast it, so the join is told not to.
    all_ = cut(names.select(F.col(name).alias("n")).filter(F.length("n") >= least).distinct().withColumn("at", F.monotonically_increasing_id()), "names")
    ix = all_.mapInPandas(keys, "at bigint, k string").select("at", F.xxhash64("k").alias("k"))
    x, y = ix.alias("x"), ix.alias("y").hint("merge")
    near = cut(x.join(y, "k").filter("x.at < y.at").select(F.col("x.at").alias("p"), F.col("y.at").alias("q")).distinct(), "near")
    both = near.join(all_.select(F.col("at").alias("p"), F.col("n").alias("u")), "p").join(all_.select(F.col("at").alias("q"), F.col("n").alias("v")), "q")
    pairs = both.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))

    @F.pandas_udf("int")
    def dist(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(p.lower(), q.lower()) for p, q in zip(a, b)], dtype="int32")

    return pairs.withColumn("d", dist("a", "b")).filter("d <= 2")


def echo_cosine(items: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine) of sparse vectors (id, doc, term, w) of different documents."""
    norm = items.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    u = items.join(norm, "id").select("id", "doc", "term", F.try_divide(F.col("w"), F.col("norm")).alias("u"))
    x, y = u.alias("x"), u.alias("y")
    s = x.join(y, "term").filter("x.id < y.id and x.doc <> y.doc").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.sum(F.col("x.u") * F.col("y.u")).alias("cosine"))
    return s.filter(F.col("cosine") >= least)


def echo_sets(rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine) of sets (id, doc, terms) of different documents, a < b. Frequent terms make all pairs candidates, so none is moved:
    rows run past blocks of rows, and only what reaches ``least`` leaves a task."""
    kind = dict(rows.dtypes)["id"]
    x = cut(rows.filter("id is not null and doc is not null").select("id", "doc", hashes("terms").alias("cs")).filter(F.size("cs") > 0), "sets")

    def near(b, frames):
        for f in frames:
            out, n = [], 0
            for i, doc, cs in zip(f["id"], f["doc"], f["cs"]):
                r, k, _ = b.meet(cs, start=int(np.searchsorted(b.ids, i, side="right")))
                c = k / np.sqrt(len(cs) * b.sizes[r])
                ok = (c >= least) & (b.docs[r] != b.doc_of.get(doc, -1))
                if ok.any():
                    out.append((i, b.ids[r[ok]], c[ok]))
                    n += len(out[-1][1])
                if n > 200_000:
                    yield flat(out)
                    out, n = [], 0
            yield flat(out)

    def flat(out):
        if not out:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        return pd.DataFrame({"a": np.repeat([i for i, _, _ in out], [len(b) for _, b, _ in out]), "b": np.concatenate([b for _, b, _ in out]), "cosine": np.concatenate([c for _, _, c in out])})

    return past(x.repartition("id"), in_blocks(x, "id", block), near, f"a {kind}, b {kind}, cosine double")


def tfidf(terms: DataFrame) -> DataFrame:
    """(id, term, w) of (id, term, tf): tf * ln(1 + N / df)."""
    n = terms.agg(F.count_distinct("id").alias("n"))
    df = terms.groupBy("term").agg(F.count_distinct("id").alias("df"))
    return terms.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", (F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("w"))


def select_mmr(rows: pd.DataFrame, k: int, lam: float) -> pd.DataFrame:
    """Greedy choice of k statements of one document: worth against likeness to what is chosen. rows: (id, worth, terms, ws)."""
    vec = {r.id: dict(zip(r.terms, r.ws)) for r in rows.itertuples()}
    worth = dict(zip(rows["id"], rows["worth"]))

    def cos(p, q):
        num = sum(w * q[t] for t, w in p.items() if t in q)
        den = (sum(w * w for w in p.values()) * sum(w * w for w in q.values())) ** 0.5
        return num / den if den else 0.0

    # Likeness only grows, so a stale score is an upper bound: the best of a heap is brought up to date and put back until it stays.
    chosen: list = []
    heap = [(-lam * worth[i], n, i, 0) for n, i in enumerate(sorted(worth))]
    heapify(heap)
    near: dict = defaultdict(float)
    while heap and len(chosen) < k:
        _, n, i, known = heappop(heap)
        if known < len(chosen):
            near[i] = max([near[i], *(cos(vec[i], vec[c]) for c in chosen[known:])])
            heappush(heap, (-(lam * worth[i] - (1 - lam) * near[i]), n, i, len(chosen)))
        else:
            chosen.append(i)
    doc = rows["doc"].iloc[0]
    return pd.DataFrame({"doc": doc, "id": chosen, "place": range(1, len(chosen) + 1)})


def summary_select(rows: DataFrame, k: int, lam: float = 0.6) -> DataFrame:
    """(doc, id, place) of rows (doc, id, worth, terms, ws): every prefix is the choice of that size, so one run gives a ladder."""
    t = dict(rows.dtypes)
    return rows.groupBy("doc").applyInPandas(lambda f: select_mmr(f, k, lam), f"doc {t['doc']}, id {t['id']}, place int")


def hash_sample(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Rows whose key's draw is under the share: the same rows on any cluster."""
    return df.filter(draw(F.lit(seed), F.col(key)) < share)


def shared_terms(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))
