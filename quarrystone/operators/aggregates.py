"""Aggregations: pivots with all totals in one pass, profiles of fields and links, funnels, histograms, triples, rule learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.scalars import coerce_number, text_of


def pivot_totals(df: DataFrame, rows: Column, cols: Column, measure: Column) -> DataFrame:
    """(r, c, level, value): the cells, row totals, column totals and grand total of a pivot, in one pass over the data.
    level is 0 for cells, 1 for row totals, 2 for column totals, 3 for the grand total; blanks among the labels stay apart
    from totals by it."""
    x = df.withColumn("r", rows).withColumn("c", cols)
    return x.cube("r", "c").agg(measure.alias("value"), F.grouping_id().cast("int").alias("level")).select("r", "c", "level", "value")


def pivot_page(df: DataFrame, rows: Column, cols: Column, measure: Column, most_rows: int = 300, most_cols: int = 24) -> tuple[DataFrame, DataFrame]:
    """The pivot cut to the largest rows and columns, and a one-row table that says whether anything was cut."""
    p = pivot_totals(df, rows, cols, measure)
    top = lambda lvl, k, most: p.filter(F.col("level") == lvl).orderBy(F.desc_nulls_last("value"), k).limit(most).select(k, F.lit(True).alias(f"__{k}"))
    top_r, top_c = top(1, "r", most_rows), top(2, "c", most_cols)
    cells = p.join(top_r, p.r.eqNullSafe(top_r.r), "left").drop(top_r.r).join(top_c, p.c.eqNullSafe(top_c.c), "left").drop(top_c.c)
    keep = cells.filter((F.col("level").isin(2, 3) | F.col("__r")) & (F.col("level").isin(1, 3) | F.col("__c"))).drop("__r", "__c")
    flags = p.agg((F.count_if(F.col("level") == 1) > most_rows).alias("rows_cut"), (F.count_if(F.col("level") == 2) > most_cols).alias("cols_cut"))
    return keep, flags


def first_k(df: DataFrame, by: str, order: list[str], text: str, k: int, sep: str = " ", most: int = 1600) -> DataFrame:
    """(by, gist): the first k texts of a group in order, joined, white space collapsed, at most ``most`` characters."""
    w = Window.partitionBy(by).orderBy(*order)
    top = df.filter(F.col(text).isNotNull()).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(text).alias("__t")))), lambda s: s["__t"]), sep)
    return top.groupBy(by).agg(F.substring(F.trim(F.regexp_replace(joined, r"\s+", " ")), 1, most).alias("gist"))


def profile_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per field: filled, distinct, coverage, mean length and the type that all its values fit.

    Types in order: empty, number, boolean, date, url, number in text, select, longtext, text. One pass: every test is a
    conjunction over all values."""
    tests, out = [], []
    for i, f in enumerate(fields):
        t = F.trim(text_of(f))
        full = t != ""
        all_ = lambda c: F.coalesce(F.bool_and(F.when(full, c)), F.lit(False))  # noqa: B023,E731
        tests += [
            F.count_if(full).alias(f"n{i}"), F.count_distinct(F.when(full, t)).alias(f"d{i}"), F.avg(F.when(full, F.length(t))).alias(f"l{i}"),
            all_(t.rlike(r"^-?\d+(\.\d+)?$")).alias(f"num{i}"), all_(F.lower(t).isin("true", "false")).alias(f"bool{i}"),
            all_(t.rlike(r"^\d{4}-\d{2}(-\d{2})?$")).alias(f"date{i}"), all_(t.rlike(r"^https?://\S+$")).alias(f"url{i}"),
            all_(coerce_number(t).isNotNull()).alias(f"money{i}"),
        ]
    one = df.agg(F.count("*").alias("rows"), *tests)
    for i, f in enumerate(fields):
        n, d = F.col(f"n{i}"), F.col(f"d{i}")
        kind = (
            F.when(n == 0, "empty").when(F.col(f"num{i}"), "number").when(F.col(f"bool{i}"), "boolean").when(F.col(f"date{i}"), "date").when(F.col(f"url{i}"), "url")
            .when(F.col(f"money{i}") & (n >= 3), "number in text")
            .when((n >= 4) & (d <= F.greatest(F.lit(2), F.round(F.sqrt(n)))) & (d <= 40) & (d < n), "select")
            .when(F.col(f"l{i}") > 140, "longtext").otherwise("text")
        )
        out.append(F.struct(F.lit(f).alias("field"), n.alias("filled"), d.alias("n_distinct"), F.round(F.try_divide(n, F.col("rows")), 6).alias("coverage"), F.round(F.col(f"l{i}"), 4).alias("mean_length"), kind.alias("kind")))
    return one.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def label_field(profile: DataFrame) -> str | None:
    """The field that names a record: title, name, label or body, else the text with most distinct values, else the first."""
    p = profile.select("field", "kind", "n_distinct").collect()  # one row per field
    by_name = [r for n in ("title", "name", "label", "body") for r in p if r["field"].lower() == n]
    texts = sorted((r for r in p if r["kind"] in ("text", "longtext")), key=lambda r: -r["n_distinct"])
    return (by_name or texts or p or [{"field": None}])[0]["field"]


def link_cardinality(links: DataFrame) -> DataFrame:
    """(from_type, rel, to_type, n, out_max, in_max, cardinality) of links (src, from_type, rel, dst, to_type)."""
    k = ["from_type", "rel", "to_type"]
    e = links.select("src", "dst", *k).distinct()
    o = e.groupBy(*k, "src").count().groupBy(*k).agg(F.max("count").alias("out_max"), F.sum("count").alias("n"))
    i = e.groupBy(*k, "dst").count().groupBy(*k).agg(F.max("count").alias("in_max"))
    side = lambda c: F.when(F.col(c) > 1, "many").otherwise("one")
    return o.join(i, k).withColumn("cardinality", F.concat_ws("-to-", side("in_max"), side("out_max"))).select(*k, "n", "out_max", "in_max", "cardinality")


def contests(edges: DataFrame) -> DataFrame:
    """(a, b, pos, neg): unordered pairs that both affirming and denying edges (src, dst, polarity) join."""
    return (
        edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.count_if(F.col("polarity") == "+").alias("pos"), F.count_if(F.col("polarity") == "-").alias("neg"))
        .filter("pos > 0 and neg > 0")
    )


def earned(mentions: DataFrame, name: str = "name", doc: str = "doc", surface: str = "surface", least: int = 2) -> DataFrame:
    """(name, sources, shown, standing): support by distinct documents, the most written surface (ties: the smallest)."""
    modal = mentions.groupBy(name, surface).count().groupBy(name).agg(F.max_by(surface, F.struct("count", F.expr(f"-1 * length({surface})"), surface)).alias("shown"))
    return mentions.groupBy(name).agg(F.count_distinct(doc).alias("sources")).join(modal, name).withColumn("standing", F.when(F.col("sources") >= least, "earned").otherwise("seen"))


def funnel(found: DataFrame, fetched: DataFrame, archived: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """Per group: found keys, each counted once under its first row, split into archived, queue and backlog."""
    first = found.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(group, order).alias(group))
    j = first.join(fetched.select(key).distinct().withColumn("__f", F.lit(1)), key, "left").join(archived.select(key).distinct().withColumn("__a", F.lit(1)), key, "left")
    a, f = F.col("__a").isNotNull(), F.col("__f").isNotNull()
    return j.groupBy(group).agg(
        F.count("*").alias("found"), F.count_if(a).alias("archived"), F.count_if(~a & f).alias("queue"), F.count_if(~a & ~f).alias("backlog"),
        F.round(100.0 * F.count_if(a) / F.count("*"), 4).alias("pct_archived"),
    )


def reconcile_sets(found: DataFrame, fetched: DataFrame, archived: DataFrame, key: str) -> DataFrame:
    """(bucket, n): queue, backlog and outside of three key sets, by one grouping instead of six anti joins."""
    u = found.select(key, F.lit(1).alias("b")).unionByName(fetched.select(key, F.lit(2).alias("b"))).unionByName(archived.select(key, F.lit(4).alias("b")))
    m = u.filter(F.col(key).isNotNull()).distinct().groupBy(key).agg(F.sum("b").alias("m"))
    n = lambda name, c: F.struct(F.lit(name).alias("bucket"), F.count_if(c).alias("n"))
    k = F.col("m")
    one = m.agg(F.array(n("archived", k >= 4), n("queue", k.isin(2, 3)), n("backlog", k == 1), n("outside", ~k.isin(1, 3, 5, 7))).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


def reason(x: Column) -> Column:
    """A failure message without what differs per item: addresses, tokens, numbers; at most 80 characters."""
    t = F.regexp_replace(F.regexp_replace(text_of(x), r"https?://\S+", "<url>"), r"\b(?=\w*\d)\w{6,}\b", "<id>")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(t, r"\d+", "#"), r"\s+", " ")), 1, 80)


def rate_eta(df: DataFrame, at: str, now: Column, minutes: int, remaining: Column) -> DataFrame:
    """(n, per_min, eta_hours): events within the last minutes, their rate, and hours left at it (null at rate 0)."""
    inside = F.col(at) > now - F.expr(f"INTERVAL {minutes} MINUTES")
    n = F.count_if(inside)
    return df.agg(n.alias("n"), (n / minutes).alias("per_min"), F.round(remaining / F.nullif(n / minutes, F.lit(0.0)) / 60, 6).alias("eta_hours"))


def unpivot_triples(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(subject, relation, object) of every filled field of every record, each once."""
    x = df.select(F.col(key).cast("string").alias("subject"), F.explode(F.array(*[F.struct(F.lit(f).alias("relation"), F.trim(text_of(f)).alias("object")) for f in fields])).alias("t"))
    return x.select("subject", "t.relation", "t.object").filter("subject is not null and object <> ''").distinct()


def dominant(df: DataFrame, by: list[str], what: str, stop: list[str] = ()) -> DataFrame:
    """The value of ``what`` seen most often per group (ties: the smallest), with its count; stop values count nothing."""
    c = df.filter(~F.col(what).isin(list(stop)) if stop else F.lit(True)).groupBy(*by, what).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), what)
    return c.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def provenance(triples: DataFrame) -> DataFrame:
    """(relation, object, n, subjects): the records that carry a value, in order, for values of more than none."""
    return triples.groupBy("relation", "object").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("subject")).alias("subjects"))


def kinds(triples: DataFrame) -> DataFrame:
    """(characteristics, n): kinds of subjects by the set of relations they have."""
    s = triples.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("characteristics"))
    return s.groupBy("characteristics").agg(F.count("*").alias("n"))


def learn_rules(obs: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """Rules label -> format of observations (label, format): the majority, if seen often and clearly enough."""
    c = obs.groupBy("label", "format").agg(F.count("*").alias("n"))
    t = c.groupBy("label").agg(F.sum("n").alias("support"), F.max_by("format", F.struct("n", "format")).alias("format"), F.max("n").alias("top"))
    return t.withColumn("confidence", F.round(F.col("top") / F.col("support"), 6)).filter((F.col("support") >= least) & (F.col("confidence") >= share)).select("label", "format", "support", "confidence")


def score_read(read: DataFrame, truth: DataFrame) -> DataFrame:
    """(hits, recall, precision) of (doc, label, value) readings against the truth, each distinct."""
    k = ["doc", "label", "value"]
    r, t = read.select(k).distinct(), truth.select(k).distinct()
    n = r.agg(F.count("*").alias("read")).crossJoin(t.agg(F.count("*").alias("true"))).crossJoin(r.join(t, k, "left_semi").agg(F.count("*").alias("hits")))
    return n.select("hits", F.round(F.col("hits") / F.nullif(F.col("true"), F.lit(0)), 6).alias("recall"), F.round(F.col("hits") / F.nullif(F.col("read"), F.lit(0)), 6).alias("precision"))


def reconcile_claims(claims: DataFrame) -> DataFrame:
    """(key, witnesses, n_values, verdict) of claims (key, value, eye): agreement, conflict, or a single witness."""
    a = claims.groupBy("key").agg(F.count_distinct("eye").alias("witnesses"), F.count_distinct("value").alias("n_values"))
    v = F.when(F.col("witnesses") < 2, "single").when(F.col("n_values") == 1, "agreement").otherwise("conflict")
    return a.withColumn("verdict", v)


def merge_counts(df: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    """Readings merged: counts of one key summed."""
    return df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in counts])


def max_amount(df: DataFrame, by: str, json: str, name: str = "amount") -> DataFrame:
    """(by, amount): the largest amount in a JSON field of a group's rows, 0 where none."""
    raw = F.regexp_extract(F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit("")), r"\$\s?([\d,]+(?:\.\d+)?)", 1)
    return df.groupBy(by).agg(F.coalesce(F.max(F.regexp_replace(raw, ",", "").try_cast("double")), F.lit(0.0)).alias("amount"))
