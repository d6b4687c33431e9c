"""Statistics that decide what is kept: keyness, support, saturation, exact tails, and nulls by repeatable draws. Draws are
hashes of seed, key and number, so results don't hang on partitions."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.scalars import draw

DRAWS = 199


def background(counts: DataFrame, key: str = "stem", n: str = "n") -> DataFrame:
    """(stem, p): add-one smoothed shares."""
    t = counts.agg(F.sum(n).alias("total"), F.count("*").alias("vocab"))
    return counts.crossJoin(F.broadcast(t)).select(key, ((F.col(n) + 1) / (F.col("total") + F.col("vocab") + 1)).alias("p"))


def keyness_term(c: Column, e: Column) -> Column:
    """2 (c ln(c / E) - (c - E)) where c exceeds E, else 0."""
    return F.when(c > e, 2 * (c * F.log(c / e) - (c - e))).otherwise(0.0)


def keyness(counts: DataFrame, bg: DataFrame, doc: str = "doc", stem: str = "stem") -> DataFrame:
    """(doc, g): how far a document's counts (doc, stem, n) exceed what the background (stem, p) has at its length."""
    length = counts.groupBy(doc).agg(F.sum("n").alias("len"))
    j = counts.join(length, doc).join(bg, stem)
    return j.groupBy(doc).agg(F.sum(keyness_term(F.col("n").cast("double"), F.col("len") * F.col("p"))).alias("g"))


def g2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Dunning's log-likelihood of a 2 x 2 table: a of a + c here, b of b + d elsewhere."""
    n = a + b + c + d
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    return 2 * (term(a, (a + b) * (a + c) / n) + term(b, (a + b) * (b + d) / n) + term(c, (c + d) * (a + c) / n) + term(d, (c + d) * (b + d) / n))


def register_prior(counts: DataFrame) -> DataFrame:
    """(genre, word, g2) of (genre, word, n): one genre against the rest, words over-represented only."""
    by_g = counts.groupBy("genre").agg(F.sum("n").alias("ng"))
    by_w = counts.groupBy("word").agg(F.sum("n").alias("nw"))
    all_ = counts.agg(F.sum("n").alias("nn"))
    j = counts.join(by_g, "genre").join(by_w, "word").crossJoin(F.broadcast(all_))
    a, b = F.col("n").cast("double"), (F.col("nw") - F.col("n")).cast("double")
    c, d = (F.col("ng") - F.col("n")).cast("double"), (F.col("nn") - F.col("ng") - F.col("nw") + F.col("n")).cast("double")
    return j.filter(a / F.col("ng") > b / F.greatest(F.lit(1), F.col("nn") - F.col("ng"))).select("genre", "word", g2(a, b, c, d).alias("g2"))


def relevance(counts: DataFrame, bg: DataFrame, doc: str = "doc", stem: str = "stem", draws: int = DRAWS, seed: int = 3) -> DataFrame:
    """(doc, g, null_max, relevant): whether a document's keyness for the background's stems exceeds every one of the draws, in
    which each stem's count is Poisson at its expected number. One vectorised pass over documents; the stems are the question's,
    a handful, and are broadcast with their shares."""
    stems = [(r[0], float(r[1])) for r in bg.select(stem, "p").collect()]  # the question's own terms
    names, ps = [s for s, _ in stems], np.array([p for _, p in stems])
    length = counts.groupBy(doc).agg(F.sum("n").alias("len"))
    wanted = counts.filter(F.col(stem).isin(names)).groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct(stem, F.col("n").cast("double")))).alias("c"))
    j = length.join(wanted, doc, "left")

    def run(frames):
        for f in frames:
            rows = []
            for k, n, c in zip(f[doc], f["len"], f["c"]):
                have = dict(c) if c is not None else {}
                x, e = np.array([have.get(s, 0.0) for s in names]), n * ps
                g = float(np.where(x > e, 2 * (x * np.log(np.maximum(x, 1e-300) / e) - (x - e)), 0).sum())
                rng = np.random.default_rng([seed, zlib.crc32(str(k).encode())])
                z = rng.poisson(e, size=(draws, len(e))).astype(float)
                null = np.where(z > e, 2 * (z * np.log(np.maximum(z, 1e-300) / e) - (z - e)), 0).sum(1).max()
                rows.append((k, g, float(null), bool(g > null)))
            yield pd.DataFrame(rows, columns=[doc, "g", "null_max", "relevant"])

    return j.select(doc, "len", "c").mapInPandas(run, f"{doc} {dict(j.dtypes)[doc]}, g double, null_max double, relevant boolean")


def good_turing(mentions: DataFrame, item: str, doc: str) -> DataFrame:
    """(n, f1, unseen): sources, items that only one has, and the items one more source would be expected to bring."""
    support = mentions.select(item, doc).distinct().groupBy(item).agg(F.count("*").alias("s"))
    return support.agg(F.count_if(F.col("s") == 1).alias("f1")).crossJoin(mentions.agg(F.count_distinct(doc).alias("n"))).select("n", "f1", F.try_divide(F.col("f1"), F.col("n")).alias("unseen"))


def saturation(mentions: DataFrame, item: str, doc: str) -> DataFrame:
    """(n, worst, verdict): the largest f1 / (n - 1) with one source left out: saturated below 1, untestable under 3 sources.
    Without a source its own singles go, and items of two sources it was one of become singles."""
    d = mentions.select(item, doc).distinct()
    s = d.groupBy(item).agg(F.count("*").alias("s"))
    n = d.agg(F.count_distinct(doc).alias("n"))
    f1 = s.agg(F.count_if(F.col("s") == 1).alias("f1"))
    loo = d.join(s, item).groupBy(doc).agg(F.count_if(F.col("s") == 1).alias("own"), F.count_if(F.col("s") == 2).alias("two"))
    w = loo.crossJoin(n).crossJoin(f1).agg(F.first("n").alias("n"), F.max((F.col("f1") - F.col("own") + F.col("two")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("worst"))
    return w.select("n", F.round("worst", 9).alias("worst"), F.when(F.col("n") < 3, "untestable").when(F.col("worst") < 1, "saturated").otherwise("open").alias("verdict"))


def earned_gain(prior: DataFrame, batch: DataFrame, item: str, doc: str) -> DataFrame:
    """(via_corpus, via_batch): items that a batch lifts to two sources, with a source of the corpus, or within the batch."""
    p = prior.select(item, doc).distinct().groupBy(item).agg(F.count("*").alias("p"))
    b = batch.select(item, doc).distinct().groupBy(item).agg(F.count("*").alias("b"))
    j = p.join(b, item, "full").select(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("b", F.lit(0)).alias("b")).filter("b > 0 and p < 2 and p + b >= 2")
    return j.agg(F.count_if(F.col("p") == 1).alias("via_corpus"), F.count_if(F.col("p") == 0).alias("via_batch"))


def log_choose(n: Column, k: Column) -> Column:
    """ln C(n, k) as a sum of logarithms."""
    kk = F.least(k, n - k)
    return F.when(kk <= 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), kk.cast("int")), F.lit(0.0), lambda s, i: s + F.log((n - kk + i) / i)))


def hyper_at_least_one(n: Column, k: Column, m: Column) -> Column:
    """The chance that m of n drawn hold at least one of k marked: 1 - C(n - k, m) / C(n, m)."""
    return F.when(m > n - k, 1.0).otherwise(1 - F.exp(log_choose(n - k, m) - log_choose(n, m)))


def binomial_tail(k: Column, n: Column) -> Column:
    """The chance of k or more of n at even odds."""
    return F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.lit(0.0), lambda s, i: s + F.exp(log_choose(n, i) - n * math.log(2)))


def holm(tests: DataFrame, p: str = "p", key: str = "id", alpha: float = 0.05, parts: int = 4096) -> DataFrame:
    """Tests with kept: Holm's step-down at alpha; once one fails all larger p fail. A p over alpha (or null) can't be kept.

    Of equal p the first has the strictest bar, so a p stands or falls as one, and all that is asked of the order is how many
    tests have a smaller p: sums of ``parts`` ranges, and within a range of its distinct p. No order runs over all tests."""
    m = tests.agg(F.count("*").alias("m"))
    d = tests.filter(F.col(p) <= alpha).groupBy(F.col(p).alias("v")).agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("v") / alpha * parts))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over parts + 1 rows at most
    sums = d.groupBy("part").agg(F.sum("n").alias("k")).withColumn("below", F.coalesce(F.sum("k").over(whole), F.lit(0))).select("part", "below")
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    x = d.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, "part").crossJoin(F.broadcast(m))
    fail = x.filter(F.col("v") > F.lit(alpha) / (F.col("m") - F.col("below") - F.col("inside"))).agg(F.min("v").alias("__fail"))
    return tests.crossJoin(F.broadcast(fail)).withColumn("kept", F.coalesce((F.col(p) <= alpha) & (F.col("__fail").isNull() | (F.col(p) < F.col("__fail"))), F.lit(False))).drop("__fail")


def overlap_null(sizes: DataFrame, n: int, draws: int = DRAWS, seed: int = 5) -> DataFrame:
    """(na, nb, null_max): the largest overlap of random sets of na and nb of n in so many draws; computed once per size pair."""

    def run(frames):
        for f in frames:
            out = []
            for a, b in zip(f["na"], f["nb"]):
                rng = np.random.default_rng([seed, int(a), int(b), n])
                out.append(int(rng.hypergeometric(int(a), n - int(a), int(b), draws).max()) if a and b else 0)
            yield pd.DataFrame({"na": f["na"], "nb": f["nb"], "null_max": out})

    return sizes.select("na", "nb").distinct().mapInPandas(run, "na bigint, nb bigint, null_max int")


def ties(mentions: DataFrame, name: str, stmt: str, n: int) -> DataFrame:
    """(a, b, k, null_max, tied): pairs of names that share more statements than random names of their frequencies would."""
    from quarrystone.operators.graph import cooccurrence

    c = mentions.select(name, stmt).distinct().groupBy(name).agg(F.count("*").alias("c"))
    e = cooccurrence(mentions.withColumn("__d", F.lit(1)), stmt, name, "__d").select("a", "b", F.col("n").alias("k"))
    j = e.join(c.select(F.col(name).alias("a"), F.col("c").alias("na")), "a").join(c.select(F.col(name).alias("b"), F.col("c").alias("nb")), "b")
    return j.join(overlap_null(j.select("na", "nb"), n), ["na", "nb"]).select("a", "b", "k", "null_max", (F.col("k") > F.col("null_max")).alias("tied"))


def permutation_rate(df: DataFrame, key: str, left: str, right: str, draws: int = 1000, seed: int = 9, exact: int = 64) -> DataFrame:
    """(observed, p999, expected): the rate of rows whose two sides agree, the 99.9th percentile of it under shuffles of the right
    side, and its mean there.

    How many rows agree under a shuffle hangs only on how often each value stands on either side. The ``exact`` values with most
    agreements to expect are drawn from the multivariate hypergeometric law of these margins; what is left over agrees by so
    many small chances that their sum is Poisson."""
    obs = df.agg(F.avg((F.col(left) == F.col(right)).cast("double")).alias("observed"), F.count("*").alias("n"))
    a, b = (df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias(x)) for c, x in ((left, "l"), (right, "r")))
    m = a.filter("v is not null").join(b, "v", "full").select("v", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    top = m.orderBy((-F.col("l") * F.col("r").cast("double")), "v").limit(exact)
    few = top.agg(F.sort_array(F.collect_list(F.struct("v", "l", "r"))).alias("few"), F.coalesce(F.sum(F.col("l") * F.col("r").cast("double")), F.lit(0.0)).alias("in_few"))
    both = m.agg(F.coalesce(F.sum(F.col("l") * F.col("r").cast("double")), F.lit(0.0)).alias("all"))
    x = obs.crossJoin(few).crossJoin(both)

    def run(frames):
        for f in frames:
            for o, n, values, inside, every in zip(f["observed"], f["n"], f["few"], f["in_few"], f["all"]):
                rng, n = np.random.default_rng(seed), int(n)
                ls, rs = [int(v["l"]) for v in values], [int(v["r"]) for v in values]
                z = rng.poisson((every - inside) / max(1, n), draws)
                for d in range(draws):
                    pool = np.array([*rs, n - sum(rs)], np.int64)
                    for i, l in enumerate(ls):
                        got = rng.multivariate_hypergeometric(pool, l, method="marginals") if l else 0 * pool
                        z[d] += got[i]
                        pool = pool - got
                z = np.sort(z) / max(1, n)
                yield pd.DataFrame({"observed": [o], "p999": [float(z[int(0.999 * (draws - 1))])], "expected": [float(every / max(1, n) ** 2)]})

    return x.mapInPandas(run, "observed double, p999 double, expected double")


def companions(vectors: DataFrame, key: str, vector: str, one, pairs: int = 2000, seed: int = 2) -> DataFrame:
    """(key, cosine): what is nearer to one item than the 95th percentile of random pairs."""
    from quarrystone.functions.scalars import cosine

    v = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    few = v.orderBy(draw(F.lit(seed), "k"), "k").limit(2 * pairs)
    small = few.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(draw(F.lit(seed), "k"), "k")))
    a, b = small.filter("i % 2 = 1").select(F.col("i").alias("j"), F.col("v").alias("va")), small.filter("i % 2 = 0").select((F.col("i") - 1).alias("j"), F.col("v").alias("vb"))
    bar = a.join(b, "j").agg(F.percentile_approx(cosine("va", "vb"), 0.95, 10000).alias("bar"))
    me = v.filter(F.col("k") == one).select(F.col("v").alias("me"))
    return v.filter(F.col("k") != one).crossJoin(me).withColumn("cosine", cosine("v", "me")).crossJoin(bar).filter("cosine > bar").select(F.col("k").alias(key), "cosine")


def ppmi(pairs: DataFrame) -> DataFrame:
    """(w, c, ppmi) of co-occurrence counts (w, c, n): positive ln(n N / (row column))."""
    r, k = pairs.groupBy("w").agg(F.sum("n").alias("nr")), pairs.groupBy("c").agg(F.sum("n").alias("nc"))
    t = pairs.agg(F.sum("n").alias("nt"))
    v = F.log(F.col("n") * F.col("nt") / (F.col("nr") * F.col("nc")))
    return pairs.join(r, "w").join(k, "c").crossJoin(F.broadcast(t)).select("w", "c", v.alias("ppmi")).filter("ppmi > 0")


def lower_quantile(values: Column, q: float, convention: str = "floor_n") -> Column:
    """A quantile of an array by place: floor_n takes sorted[floor(n q)], floor_n1 sorted[floor(q (n - 1))], upper_median
    sorted[n / 2]."""
    s = F.array_sort(values)
    n = F.size(s)
    at = {"floor_n": F.least(n - 1, F.floor(n * q)), "floor_n1": F.floor((n - 1) * q), "upper_median": F.floor(n / 2)}[convention]
    return F.get(s, at.cast("int"))


def region_rate(df: DataFrame, levels: list[str], hit: str, least: int = 20) -> DataFrame:
    """Rows with the rate of the smallest region (levels from fine to coarse) that has ``least`` rows or more, and its name.
    Rates come from aggregates that combine before any exchange, so a coarse region is never put together in one task; null is
    a region of its own."""
    x, rate, name = df, F.lit(None).cast("double"), F.lit(None).cast("string")
    for l in reversed(levels):
        keys = levels[levels.index(l) :]
        a = df.groupBy(*[F.col(k).alias(f"__{l}_{k}") for k in keys]).agg(F.count("*").alias(f"__n_{l}"), F.avg(F.col(hit).cast("double")).alias(f"__a_{l}"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{l}_{k}"))
        x = x.join(a, same, "left").drop(*[f"__{l}_{k}" for k in keys])
        ok = F.col(f"__n_{l}") >= least
        rate, name = F.when(ok, F.col(f"__a_{l}")).otherwise(rate), F.when(ok, F.lit(l)).otherwise(name)
    return x.withColumn("normal_rate", rate).withColumn("region", name).drop(*[f"__{c}_{l}" for l in levels for c in "na"])


def votes(flags: DataFrame) -> DataFrame:
    """(item, for_, against, standing) of (item, witness, vote): stands, falsified, or contested."""
    f = flags.select("item", "witness", "vote").distinct().groupBy("item").agg(F.count_if("vote").alias("for_"), F.count_if(~F.col("vote")).alias("against"))
    return f.withColumn("standing", F.when((F.col("for_") > 0) & (F.col("against") > 0), "contested").when(F.col("for_") > 0, "stands").otherwise("falsified"))


def perspective_bits(facts: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(genre, fact, bits) of counts (genre, fact, n): surprise under a Dirichlet-smoothed genre."""
    t = facts.groupBy("genre").agg(F.sum("n").alias("total"))
    v = facts.agg(F.count_distinct("fact").alias("vocab"))
    return facts.join(t, "genre").crossJoin(F.broadcast(v)).select("genre", "fact", (-F.log2((F.col("n") + alpha) / (F.col("total") + alpha * F.col("vocab")))).alias("bits"))
