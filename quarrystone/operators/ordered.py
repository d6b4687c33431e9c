"""Ordered computations: runs, sessions, smoothing, clamping, interpolation, first-seen and running novelty. Ties are broken by
the order columns given; the caller names enough of them to make the order total."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], value: str, start: str, end: str) -> DataFrame:
    """Runs of equal neighbours: (by, value, start, end, n). Nulls are equal to each other."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    x = df.withColumn("__new", new)
    x = x.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*by, "__i", value).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__i")


def absorb_short(runs: DataFrame, by: list[str], value: str, least_n: int = 4, least_s: float = 1.5) -> DataFrame:
    """Runs too short (frames or seconds) go to the run before them (a first one to the run after), equal neighbours merge."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    full = (F.col("n") >= least_n) & (F.col("end") - F.col("start") >= least_s)
    kept = F.when(full, F.col(value))
    x = runs.withColumn("__v", F.coalesce(F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(kept, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col(value)))
    x = x.withColumn("__new", F.when(F.lag("__v").over(w).eqNullSafe(F.col("__v")) & (F.row_number().over(w) > 1), 0).otherwise(1))
    x = x.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*by, "__i", F.col("__v").alias(value)).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("__i")


def majority(df: DataFrame, by: list[str], order: list[str], value: str, reach: int = 2, name: str = "smoothed") -> DataFrame:
    """The most frequent value within ``reach`` rows either way; of equally frequent ones the smallest."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)
    vs = F.collect_list(value).over(w)
    best = lambda a: F.array_max(F.transform(F.array_distinct(a), lambda v: F.struct(F.size(F.filter(a, lambda x: x == v)).alias("n"), (-v).alias("v"))))
    return df.withColumn("__a", vs).withColumn(name, -best(F.col("__a"))["v"]).drop("__a")


def sessions(df: DataFrame, by: list[str], at: Column, gap: float, order: list[str]) -> DataFrame:
    """Rows with a session number: a gap longer than ``gap`` (in at's unit) begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumn("__t", at)
    x = x.withColumn("__new", F.when(F.col("__t") - F.lag("__t").over(w) <= gap, 0).otherwise(1))
    return x.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__t", "__new")


def cue_ends(df: DataFrame, by: list[str], at: str, duration: str | None = None) -> DataFrame:
    """Each mark with its end: the next mark; the last ends at the duration, or after the upper median gap."""
    w = Window.partitionBy(*by).orderBy(at)
    x = df.withColumn("__next", F.lead(at).over(w)).withColumn("__gap", F.col("__next") - F.col(at))
    gaps = F.array_sort(F.filter(F.collect_list("__gap").over(Window.partitionBy(*by)), lambda g: g.isNotNull()))
    mid = F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))
    last = F.coalesce(F.col(duration) if duration else F.lit(None).cast("double"), F.col(at) + mid)
    return x.withColumn("end", F.coalesce("__next", last)).drop("__next", "__gap")


def clamp(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "clamped") -> DataFrame:
    """A value that never runs backward."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def interpolate(df: DataFrame, by: list[str], order: list[str], value: str, weight: str, name: str = "filled") -> DataFrame:
    """Missing values spread between their neighbours in proportion to weight; before the first and after the last known one
    they take that one's."""
    w = Window.partitionBy(*by).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = df.withColumn("__c", F.sum(weight).over(back) - F.col(weight))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("__c").alias("c")))
    x = x.withColumn("__p", F.last(known, ignorenulls=True).over(back)).withColumn("__n", F.first(known, ignorenulls=True).over(ahead))
    share = F.try_divide(F.col("__c") - F.col("__p.c"), F.col("__n.c") - F.col("__p.c"))
    out = F.coalesce(F.col(value), F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * share, F.col("__p.v"), F.col("__n.v"))
    return x.withColumn(name, out).drop("__c", "__p", "__n")


def collapse_repeats(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that repeat the one before are dropped; the one kept says how often it stood there (reps)."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumn("__new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    x = x.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("reps", F.count("*").over(Window.partitionBy(*by, "__i")))
    return x.filter("__new = 1").drop("__new", "__i")


def collapse_loops(tokens: list[str], most_unit: int = 6, floor: int = 4) -> list[tuple[str, int]]:
    """Units of up to six tokens said over and over, back to back, kept once with their count. A unit must stand there more
    often than chance would have it: max(4, ln N / -sum ln p) times."""
    n, freq = len(tokens), Counter(tokens)
    out, i = [], 0
    while i < n:
        best = (1, 1)
        for u in range(1, min(most_unit, n - i) + 1):
            unit, k = tokens[i : i + u], 1
            while tokens[i + k * u : i + (k + 1) * u] == unit:
                k += 1
            if k > 1:
                rarity = -sum(math.log(freq[t] / n) for t in unit)
                need = max(floor, math.ceil(math.log(n) / rarity)) if rarity > 0 else floor
                if k >= need and k * u > best[0] * best[1]:
                    best = (u, k)
        u, k = best
        out += [(t, k) for t in tokens[i : i + u]]
        i += u * k
    return out


def first_seen(df: DataFrame, by: list[str], order: list[str], key: list[str]) -> DataFrame:
    """The first row of each key in a group's order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by, *key).orderBy(*order))).filter("__r = 1").drop("__r")


def revisions(df: DataFrame, by: list[str], order: list[str], value: str, least: float = 0.005) -> DataFrame:
    """Rows whose figure differs from the one before it of the same measure by 0.5 % or more: before, and the log2 ratio."""
    x = df.withColumn("before", F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))
    return x.filter((F.col("before") != 0) & (F.abs(F.try_divide(F.col(value), F.col("before")) - 1) >= least)).withColumn("log_ratio", F.log2(F.abs(F.try_divide(F.col(value), F.col("before")))))


def sliding_sets(df: DataFrame, by: list[str], order: list[str], items: str, reach: int = 25) -> DataFrame:
    """Each row with the set of items the rows before it (at most ``reach``) hold, and which of its own are new to them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, -1)
    x = df.withColumn("picture", F.array_distinct(F.flatten(F.collect_list(items).over(w))))
    return x.withColumn("entering", F.array_except(items, "picture"))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key in an order."""
    w = Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def superseded(df: DataFrame, key: list[str], order: list[str], id_: str) -> DataFrame:
    """All rows with a status: current for the last of its key, superseded (by the next) for the others."""
    w = Window.partitionBy(*key).orderBy(*order)
    x = df.withColumn("successor", F.lead(id_).over(w))
    return x.withColumn("status", F.when(F.col("successor").isNull(), "current").otherwise("superseded"))


def cumulative_draws(items: DataFrame, key: str, weight: str, draws: int, seed: int, by: list[str] = ()) -> DataFrame:
    """``draws`` keys per group drawn with probability in proportion to weight: cumulative sums, and for each draw the last key
    that begins at or before its number, found in one order of keys and draws."""
    from quarrystone.functions.scalars import draw

    by, slots = list(by), 512
    kind = dict(items.dtypes)[key]
    # Any fixed order of keys will do: slots by hash, keys within them, so no order runs over all keys in one task. The totals
    # of slots, 512 a group, say where each begins.
    x = items.select(*by, key, F.col(weight).cast("double").alias("w"), F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot"))
    o = Window.partitionBy(*by, "slot").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__at", F.sum("w").over(o) - F.col("w"))
    t = x.groupBy(*by, "slot").agg(F.sum("w").alias("sw"))
    g = Window.partitionBy(*(by or [F.lit(0)])).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("lo", F.sum("sw").over(g) - F.col("sw")).withColumn("total", F.sum("sw").over(Window.partitionBy(*(by or [F.lit(0)]))))
    d = t.select(*by, "total").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    d = d.withColumn("u", draw(F.lit(seed), *[F.col(b) for b in by], F.col("draw")) * F.col("total")).drop("total")
    # Each draw finds its slot in one order of slots and draws, and its key in one order of keys and draws within the slot.
    both = t.select(*by, F.col("lo").alias("u"), "slot", "lo", F.lit(None).cast("int").alias("draw")).unionByName(d.select(*by, "u", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("double").alias("lo"), "draw"))
    f = Window.partitionBy(*(by or [F.lit(0)])).orderBy("u", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("slot", F.last("slot", ignorenulls=True).over(f)).withColumn("lo", F.last("lo", ignorenulls=True).over(f)).filter("draw is not null")
    within = placed.select(*by, "slot", (F.col("u") - F.col("lo")).alias("__at"), F.lit(None).cast(kind).alias(key), "draw")
    keys = x.select(*by, "slot", "__at", key, F.lit(None).cast("int").alias("draw"))
    o2 = Window.partitionBy(*by, "slot").orderBy("__at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return keys.unionByName(within).withColumn(key, F.last(key, ignorenulls=True).over(o2)).filter("draw is not null").select(*by, "draw", key)


def surprise(frames):
    """Excess of each claim (doc, seq, a, b, neg, measure, value) over all before it in its document: new names and bonds,
    turned polarities, revised figures. Frames hold whole documents one after the other, in order; a document may go on in
    the next frame, so its state is carried over."""
    doc = object()
    names: Counter = Counter()
    bonds: dict = {}
    figures: dict = {}
    for f in frames:
        out = []
        for d, a, b, neg, measure, value in zip(f["doc"], f["a"], f["b"], f["neg"], f["measure"], f["value"]):
            if d != doc:
                doc, names, bonds, figures = d, Counter(), {}, {}
            a, b = (a, b) if str(a) <= str(b) else (b, a)
            score = 0.0
            if (a, b) not in bonds:
                lo, hi = sorted((names[a], names[b]))
                score += 1 + 0.5 * math.log2(1 + lo) if lo >= 2 else 1.0 if not hi else 0.3 + 0.1 * math.log2(1 + hi)
            elif bonds[a, b] != bool(neg):
                score += 1.5
            bonds[a, b] = bool(neg)
            names[a] += 1
            names[b] += 1
            if measure is not None and value is not None and value == value:
                old = figures.get(measure)
                if old and abs(value / old - 1) >= 0.005:
                    score += 2 + (min(2.0, abs(math.log2(abs(value / old)))) if value else 0.0)
                figures[measure] = float(value)
            out.append(score)
        yield pd.DataFrame({"doc": f["doc"], "seq": f["seq"], "excess": out})


def surprise_pass(claims: DataFrame) -> DataFrame:
    """(doc, seq, excess) of claims (doc, seq, a, b, neg, measure, value): one exchange and sort, then one pass."""
    t = dict(claims.dtypes)
    x = claims.select("doc", "seq", "a", "b", "neg", "measure", "value").repartition("doc").sortWithinPartitions("doc", "seq")
    return x.mapInPandas(surprise, f"doc {t['doc']}, seq {t['seq']}, excess double")
