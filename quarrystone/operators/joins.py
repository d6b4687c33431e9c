"""Joins beyond plain equality. Equality and ranges go to Catalyst as they are; as-of joins are one sort per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Left outer equi join with a side that has at most one row per key. The size of either side is Catalyst's and AQE's to
    judge; nothing is broadcast by hint."""
    return left.join(right, on, "left")


def semi_match(df: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a match set, each once."""
    return df.join(matches.select(key).distinct(), key, "left_semi")


def same_attribute(df: DataFrame, key: str, attribute: Column, keep: list[str]) -> DataFrame:
    """(a, b, attribute) of different keys that share an attribute, a < b. Blank attributes join nothing.

    Pairs of one attribute grow with its square: for reports on hot attributes use ``shared_groups``."""
    x = df.select(F.col(key).alias("k"), attribute.alias("attribute"), *keep).filter("attribute <> ''").distinct()
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, "attribute").filter("a.k < b.k").select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), "attribute")


def shared_groups(df: DataFrame, key: str, attribute: Column) -> DataFrame:
    """(key, attribute, group_size): one row per key and attribute, with how many keys share it."""
    x = df.select(F.col(key).alias(key), attribute.alias("attribute")).filter("attribute <> ''").distinct()
    n = x.groupBy("attribute").agg(F.count("*").alias("group_size"))
    return x.join(n, "attribute").select(key, "attribute", "group_size")


def prior_next(df: DataFrame, by: list[str], order: str, key: str, value: str) -> DataFrame:
    """Each row with the value of the row before and after it in its group; ties in order of key. Null orders are left out."""
    w = Window.partitionBy(*by).orderBy(order, key)
    return df.filter(F.col(order).isNotNull()).select("*", F.lag(value).over(w).alias("prior"), F.lead(value).over(w).alias("next"))


def as_of(facts: DataFrame, states: DataFrame, by: list[str], at: str, since: str, value: str) -> DataFrame:
    """Each fact with the latest state at or before it (null where there is none); of states at one time the greatest wins.

    One exchange on the key and one sort: the states and facts are put in one order and the last state is carried on."""
    s = states.groupBy(*by, F.col(since).alias("__t")).agg(F.max(value).alias(value)).withColumn("__fact", F.lit(0))
    f = facts.withColumn("__t", F.col(at)).withColumn("__fact", F.lit(1))
    w = Window.partitionBy(*by).orderBy("__t", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    both = f.unionByName(s, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("__fact = 1").drop("__t", "__fact")


def bucketed_range(left: DataFrame, right: DataFrame, by: list[str], ls: str, le: str, rs: str, re: str, width: float) -> DataFrame:
    """Pairs of rows of equal keys whose spans [ls, le) and [rs, re) overlap, each once, without comparing all of a key's rows:
    spans are put in buckets of ``width`` they touch, and a pair is kept in the bucket where the later of the two starts."""
    lb = left.withColumn("__b", F.explode(F.sequence(F.floor(F.col(ls) / width), F.floor(F.greatest(F.col(ls), F.col(le) - 1e-9) / width))))
    rb = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(rs) / width), F.floor(F.greatest(F.col(rs), F.col(re) - 1e-9) / width))))
    j = lb.join(rb, [*by, "__b"]).filter((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)))
    return j.filter(F.col("__b") == F.floor(F.greatest(ls, rs) / width)).drop("__b")


def band(left: DataFrame, right: DataFrame, by: list[str], lt: str, rt: str, most: float) -> DataFrame:
    """Pairs of rows of equal keys at most ``most`` apart, found through buckets of that width."""
    lb = left.withColumn("__b", F.explode(F.array(*[F.floor(F.col(lt) / most) + d for d in (-1, 0, 1)])))
    rb = right.withColumn("__b", F.floor(F.col(rt) / most))
    return lb.join(rb, [*by, "__b"]).filter(F.abs(F.col(lt) - F.col(rt)) <= most).drop("__b")


def aligned_cues(left: DataFrame, right: DataFrame, by: list[str], width: float = 10.0) -> DataFrame:
    """Cues (cue_a, sa, ea) and (cue_b, sb, eb) of one recording that overlap by at least half of the shorter."""
    j = bucketed_range(left, right, by, "sa", "ea", "sb", "eb", width)
    shared = F.least("ea", "eb") - F.greatest("sa", "sb")
    return j.withColumn("shared", shared).filter(F.col("shared") >= 0.5 * F.least(F.col("ea") - F.col("sa"), F.col("eb") - F.col("sb")))


def point_lookup(points: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, value: str) -> DataFrame:
    """The value of the last mark at or before each point (offset to time, time to offset)."""
    return as_of(points, marks, by, at, mark, value)


def full_seam(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, side): paired, left only and right only rows of two documents."""
    p = pairs.select("left_id", "right_id")
    la = a.select(F.col("id").alias("left_id")).join(p, "left_id", "left")
    rb = b.select(F.col("id").alias("right_id")).join(p, "right_id", "left_anti").withColumn("left_id", F.lit(None).cast(dict(la.dtypes)["left_id"]))
    out = la.unionByName(rb)
    side = F.when(F.col("right_id").isNull(), "left").when(F.col("left_id").isNull(), "right").otherwise("both")
    return out.select("left_id", "right_id", side.alias("side"))


def contained_titles(df: DataFrame, key: str, title: str) -> DataFrame:
    """(whole, part): title of whole holds the whole title of part as words. A part is looked up by its rarest word, so titles
    are compared only where they share it, not each with each."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    t = df.select(F.col(key).alias("k"), norm.alias("t")).filter("t <> ''")
    words = t.select("k", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    freq = words.groupBy("w").agg(F.count("*").alias("n"))
    rare = words.join(freq, "w").groupBy("k", "t").agg(F.min(F.struct("n", "w")).alias("r")).select(F.col("k").alias("part"), F.col("t").alias("pt"), F.col("r.w").alias("w"))
    hit = rare.join(words.select(F.col("k").alias("whole"), F.col("t").alias("wt"), "w"), "w")
    inside = F.contains(F.concat(F.lit(" "), "wt", F.lit(" ")), F.concat(F.lit(" "), F.col("pt"), F.lit(" ")))
    return hit.filter(inside & (F.col("whole") != F.col("part")) & (F.length("wt") > F.length("pt"))).select("whole", "part")


def successor_chain(df: DataFrame, by: list[str], order: str, key: str, text: str) -> DataFrame:
    """(key, successor): the next row of its group by order, if the two texts share a word of four letters or more."""
    w = Window.partitionBy(*by).orderBy(order, key)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]{4,}"), F.lit(0)))
    x = df.filter(F.col(order).isNotNull()).withColumn("__w", words)
    x = x.select(key, "__w", F.lead(key).over(w).alias("successor"), F.lead("__w").over(w).alias("__n"))
    return x.filter(F.arrays_overlap("__w", "__n") & (F.col("successor") != F.col(key))).select(key, "successor")


def two_hop(edges: DataFrame) -> DataFrame:
    """(a, via, c, ways): compositions a -> via -> c of an edge table (src, dst, rel), ends different."""
    x, y = edges.select("src", "dst").distinct().alias("x"), edges.select("src", "dst").distinct().alias("y")
    j = x.join(y, F.col("x.dst") == F.col("y.src")).filter("x.src <> y.dst and x.src <> x.dst and y.src <> y.dst")
    return j.groupBy(F.col("x.src").alias("a"), F.col("y.dst").alias("c")).agg(F.count("*").alias("ways"))


def mutual_best(scores: DataFrame, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """Pairs that are each other's best, both strictly better than the runner-up; ties refuse."""
    out = scores
    for side, name in ((a, "a"), (b, "b")):
        w = Window.partitionBy(side).orderBy(F.desc(score))
        out = out.withColumn(f"__r{name}", F.row_number().over(w)).withColumn(f"__n{name}", F.lead(score).over(w))
    ok = lambda n: (F.col(f"__r{n}") == 1) & (F.col(f"__n{n}").isNull() | (F.col(score) > F.col(f"__n{n}")))
    return out.filter(ok("a") & ok("b")).drop("__ra", "__rb", "__na", "__nb")
