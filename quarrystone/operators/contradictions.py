"""Contradiction records: what sources say of the thing that a question asks for. Values of one unit are set against each other
only where they stand for the same referent under that question; what is left out is a row with its reason.

A referent is read off the measure phrase a value stands under, or where there is none off the words around it. Forms that the
asker declares alike (synonyms) come before the question's own words, so that "lives saved" and "lives lost" stay apart though
both are lives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words with which a question asks rather than names.
ASKING = set("how many much what when where who whom whose which why did do does was were is are be been being has have had the a an and or of in on at by for from with about to this that these those it its they them their he she his her there here total number figure value count".split())


def vocabulary(question: str, synonyms: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(form, referent) in the order in which forms are looked for: declared forms that answer the question, then its own words."""
    terms = [w for w in re.findall(r"[^\W_]+", question.lower()) if w not in ASKING]
    out: list[tuple[str, str]] = []
    for key, forms in (synonyms or {}).items():
        every = [" ".join(re.findall(r"[^\W_]+", x.lower())) for x in (key, *forms)]
        if any(f in terms for f in every):
            out += [(f, every[0]) for f in every if f]
    have = {f for f, _ in out}
    return out + [(t, t) for t in dict.fromkeys(terms) if t not in have]


def referent_of(phrase: Column, forms: list[tuple[str, str]]) -> Column:
    """The referent of the first form that a phrase holds as whole words; null if it holds none."""
    p = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(phrase, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.coalesce(*[F.when(p.contains(f" {f} "), F.lit(k)) for f, k in forms], F.lit(None).cast("string"))


def read_values(values: DataFrame, question: str, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """values (id, doc, raw, value, unit, referent, window) + key, why: the referent under the question, or why there is none: the value
    is incomplete, is of another referent (it stands under a phrase that isn't asked for), or nothing near it is asked for."""
    forms = vocabulary(question, synonyms)
    declared = F.trim(F.coalesce("referent", F.lit(""))) != ""
    key = referent_of(F.when(declared, F.col("referent")).otherwise(F.col("window")), forms) if forms else F.lit(None).cast("string")
    whole = F.col("doc").isNotNull() & F.col("value").isNotNull() & (F.trim(F.coalesce("raw", F.lit(""))) != "")
    why = F.when(F.lit(not forms), "the question names nothing").when(~whole, "incomplete").when(F.col("key").isNull() & declared, "another referent").when(F.col("key").isNull(), "no referent near")
    return values.select("*", F.when(whole, key).alias("key")).withColumn("why", why)


def contradiction_records(values: DataFrame, question: str, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(part, unit, referent, n_values, n_docs, why). part: contradiction (two sources or more state different values), agreement, gap
    (a single source), unstable (one source states several values), refusal (values left out, by reason). A source that is
    unstable makes no contradiction by itself; a null unit is one unit. Grouped by unit and referent with partial sums, no pairs."""
    x = read_values(values, question, synonyms).withColumn("unit", F.coalesce("unit", F.lit("?")))
    kept = x.filter("why is null")
    own = kept.groupBy("unit", "key", "doc").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("value").alias("k"))
    n = kept.groupBy("unit", "key").agg(F.count_distinct("value").alias("n_values"))
    g = own.groupBy("unit", "key").agg(F.count("*").alias("n_docs"), F.max("lo").alias("top"), F.min("hi").alias("low"), F.max("hi").alias("most"), F.min("lo").alias("least")).join(n, ["unit", "key"])
    # Two sources differ in what they say unless all values are one; if each holds several, any two differ.
    part = F.when(F.col("n_docs") == 1, "gap").when(F.col("most") > F.col("least"), "contradiction").otherwise("agreement")
    why = F.when(F.col("n_docs") == 1, "a single source")
    groups = g.select(part.alias("part"), "unit", F.col("key").alias("referent"), "n_values", "n_docs", why.alias("why"))
    shaky = own.filter("k > 1").groupBy("unit", "key").agg(F.max("k").alias("n_values"), F.count("*").alias("n_docs")).select(F.lit("unstable").alias("part"), "unit", F.col("key").alias("referent"), "n_values", "n_docs", F.lit("one source states several").alias("why"))
    out = x.filter("why is not null").groupBy("unit", "why").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("doc").alias("n_docs"))
    refused = out.select(F.lit("refusal").alias("part"), "unit", F.lit(None).cast("string").alias("referent"), "n_values", "n_docs", "why")
    return groups.unionByName(shaky).unionByName(refused)


def field_values(df: DataFrame, doc: str, fields: list[str], unit: str = "count") -> DataFrame:
    """Columns of records as values: a field's name is what its value stands under."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("referent"), F.col(f).cast("string").alias("raw"), F.col(f).cast("double").alias("value")) for f in fields])).alias("x")
    return df.select(F.monotonically_increasing_id().alias("id"), F.col(doc).cast("string").alias("doc"), each).select("id", "doc", "x.raw", "x.value", F.lit(unit).alias("unit"), F.regexp_replace("x.referent", "_", " ").alias("referent"), F.lit(None).cast("string").alias("window"))
