"""Nulls that decide: what chance alone reaches, by draws that hang on seed, key and number only. A pair, a rate or a name is
kept if it exceeds every draw."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.evidence import DRAWS, keyness_term
from quarrystone.operators.ordered import cumulative_draws
from quarrystone.operators.pairs import idf_bits
from quarrystone.session import cut


def bags(tokens: DataFrame, most: int, draws: int, seed: int) -> DataFrame:
    """(try, side, bag): two bags a draw of ``most`` tokens each with their idf, drawn by how often tokens stand; a bag of fewer is
    the beginning of one. 2 x draws rows, whatever the corpus."""
    idf = idf_bits(tokens)
    most = max(1, most)
    pool = cumulative_draws(idf.select("token", F.col("df").cast("double").alias("w")), "token", "w", 2 * draws * most, seed)
    at = F.col("draw") - 1
    p = pool.join(idf, "token").select((F.floor(at / (2 * most))).alias("try"), (F.floor(at / most) % 2).alias("side"), F.struct((at % most).alias("place"), "token", "idf").alias("x"))
    return p.groupBy("try", "side").agg(F.sort_array(F.collect_list("x")).alias("bag"))


def floors(tokens: DataFrame, sizes: DataFrame, measure: str = "idf", draws: int = 40, seed: int = 11) -> DataFrame:
    """(na, nb, floor) for rows (na, nb) of sizes: the most that two random bags of these sizes reach in ``draws`` tries. measure: idf
    (the sum of the shared tokens' idf), jaccard, or cosine. Bags of a size are beginnings of the same draws, so a floor is the
    same whichever other sizes are asked for with it."""
    s = sizes.select(F.col("na").cast("int"), F.col("nb").cast("int")).distinct()
    most = int(s.agg(F.max(F.greatest("na", "nb"))).head()[0] or 0)  # one number
    top = 1
    while top < most:
        top *= 2  # so that the draws don't hang on the largest size exactly
    # 2 x draws bags of at most twice the largest size: their size hangs on the longest statement, not on the corpus.
    drawn: dict[int, dict[int, list]] = {}
    for r in bags(tokens, top, draws, seed).collect():
        drawn.setdefault(r["try"], {})[r["side"]] = [(x["token"], x["idf"]) for x in r["bag"]]
    ready = tokens.sparkSession.sparkContext.broadcast([met(d.get(0, []), d.get(1, [])) for _, d in sorted(drawn.items())])

    def run(frames):
        for f in frames:
            na, nb = f["na"].to_numpy(), f["nb"].to_numpy()
            best = np.zeros(len(f))
            for i, j, w, x, y in ready.value:
                both = (i[None, :] < na[:, None]) & (j[None, :] < nb[:, None])
                if measure == "idf":
                    got = both @ w
                else:
                    k, dx, dy = both.sum(1), x[np.minimum(na, len(x) - 1)], y[np.minimum(nb, len(y) - 1)]
                    got = k / np.maximum(1, dx + dy - k) if measure == "jaccard" else k / np.sqrt(np.maximum(1, dx * dy))
                best = np.maximum(best, got)
            yield f.assign(floor=best)

    return s.mapInPandas(run, "na int, nb int, floor double")


def met(x: list[tuple[str, float]], y: list[tuple[str, float]]) -> tuple[np.ndarray, ...]:
    """Of two bags in order: where each shared token first stands in either, its idf, and how many different tokens the beginnings hold."""
    first: list[dict[str, int]] = [{}, {}]
    counts = []
    for side, bag in zip(first, (x, y)):
        n = [0]
        for at, (t, _) in enumerate(bag):
            side.setdefault(t, at)
            n.append(len(side))
        counts.append(np.array(n))
    idf = dict(x)
    both = sorted(first[0].keys() & first[1].keys())
    return np.array([first[0][t] for t in both], int), np.array([first[1][t] for t in both], int), np.array([idf[t] for t in both], float), *counts


def beats_floor(pairs: DataFrame, tokens: DataFrame, score: str = "score", measure: str = "idf", draws: int = 40, seed: int = 11) -> DataFrame:
    """pairs (a, b, ..., score) + floor of those whose score exceeds what random bags of the two sizes reach."""
    n = tokens.groupBy("id").agg(F.count("*").cast("int").alias("n"))
    j = pairs.join(n.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    # Sizes are taken in either order as one.
    j = cut(j.withColumns({"na": F.least("na", "nb"), "nb": F.greatest("na", "nb")}), "sized")
    return j.join(floors(tokens, j.select("na", "nb"), measure, draws, seed), ["na", "nb"]).filter(F.col(score) > F.col("floor")).select(*pairs.columns, "floor")


def seeded(seed: int, *key) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32("|".join(map(str, key)).encode())])


def ladder_rate(df: DataFrame, levels: list[str], hit: str, draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """One row per innermost region (levels from fine to coarse; a null is a region of its own): rate and region, the first that has a rate of its own:
    whose hits are outside all draws of as many rows from the next larger region; else the outermost. Nulls of ``hit`` are no
    occurrences. Counts come from aggregates that combine before any exchange."""
    rows = df.groupBy(*levels).agg(F.count_if(F.col(hit)).alias("k0"), F.count(hit).alias("n0"))
    x = rows
    for i in range(1, len(levels)):
        keys = levels[i:]
        up = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("k0").alias(f"k{i}"), F.sum("n0").alias(f"n{i}"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        x = x.join(up, same).drop(*[f"__{k}" for k in keys])
    kinds = dict(df.dtypes)

    def run(frames):
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                ladder = [(l, int(getattr(row, f"k{i}")), int(getattr(row, f"n{i}"))) for i, l in enumerate(levels)]
                ladder = [s for s in ladder if s[2] > 0]
                rate = region = None
                for i, (l, k, n) in enumerate(ladder):
                    larger = next(((pk, pn) for _, pk, pn in ladder[i + 1 :] if pn > n), None)
                    if larger:
                        z = seeded(seed, l, k, n, *larger).hypergeometric(larger[0], larger[1] - larger[0], n, draws)
                        if z.min() <= k <= z.max():
                            continue  # indistinguishable from the larger region at this size
                    rate, region = k / n, l
                    break
                out.append((*[getattr(row, l) for l in levels], rate, region))
            yield pd.DataFrame(out, columns=[*levels, "rate", "region"]).astype({"rate": float, "region": object})

    return x.mapInPandas(run, ", ".join(f"{l} {kinds[l]}" for l in levels) + ", rate double, region string")


def phrase_keyness(names: DataFrame, docs: DataFrame, bg: DataFrame, draws: int = DRAWS, seed: int = 13) -> DataFrame:
    """(name, count, expected, g, null_max, outside): whether the corpus says a name far more than the background's words (stem, p) would
    put its stems side by side. names: (name, stems), docs: (id, stems), arrays in order. A name with a stem that the background
    lacks expects nothing and is left out, as is one without stems."""
    n = names.filter(F.size("stems") > 0).select("name", "stems", F.size("stems").alias("k"), F.concat_ws(" ", "stems").alias("key")).dropDuplicates(["name"])
    widths = [r[0] for r in n.select("k").distinct().collect()]  # a few small numbers
    total = docs.agg(F.sum(F.size("stems")).cast("double").alias("len"))
    wanted = n.select("key", "k").distinct()
    said = None
    for k in widths:
        runs = docs.filter(F.size("stems") >= k).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("stems") - (k - 1)), lambda i: F.concat_ws(" ", F.slice("stems", i, F.lit(k))))).alias("key"))  # noqa: B023
        c = runs.groupBy("key").agg(F.count("*").alias("count")).join(wanted.filter(F.col("k") == k).select("key"), "key")
        said = c if said is None else said.unionByName(c)
    e = n.select("name", "k", "key", F.explode("stems").alias("stem")).join(bg.select("stem", "p"), "stem").groupBy("name", "k", "key").agg(F.sum(F.log("p")).alias("lp"), F.count("*").alias("have")).filter("have = k")
    e = e.crossJoin(total).select("name", "key", (F.col("len") * F.exp("lp")).alias("expected"))
    e = e.withColumn("count", F.lit(0).cast("bigint")) if said is None else e.join(said, "key", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    x = e.select("name", "count", "expected", keyness_term(F.col("count").cast("double"), F.col("expected")).alias("g"))

    def run(frames):
        for f in frames:
            high = []
            for name, mean in zip(f["name"], f["expected"]):
                z = seeded(seed, name).poisson(mean, draws).astype(float)
                high.append(float(np.where(z > mean, 2 * (z * np.log(np.maximum(z, 1e-300) / max(mean, 1e-300)) - (z - mean)), 0).max()))
            yield f.assign(null_max=high, outside=f["g"] > np.array(high))

    return x.mapInPandas(run, "name string, count bigint, expected double, g double, null_max double, outside boolean")
