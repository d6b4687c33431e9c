"""Repair of misread words without a model: a word the corpus hardly knows becomes the one word it does know that is a single
edit away, if the words beside it bear witness.

A candidate must be the only one; an ending that the corpus adds to many words (learned, not listed) makes a form of a known
word, not a misreading; and a known neighbour must have been read beside the candidate in another document, or the document
itself must read the candidate elsewhere. What is refused is a row with its reason."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.pairs import osa
from quarrystone.session import cut

#: Documents a word must stand in to be known; letters it must have to be judged; words an ending must be added to.
KNOWN, LETTERS, ENDING = 3, 4, 5


def word_places(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, at, word): the words of each text by place, in lower case."""
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)?"), F.lit(0))
    return df.select(F.col(key).alias("doc"), F.posexplode(w).alias("at", "word"))


def known_words(places: DataFrame) -> DataFrame:
    """(word, docs) of words that stand in ``KNOWN`` documents or more."""
    return places.groupBy("word").agg(F.count_distinct("doc").alias("docs")).filter(F.col("docs") >= KNOWN)


def endings(known: DataFrame) -> DataFrame:
    """(ending): up to three letters that make one known word of another, for ``ENDING`` words or more."""
    k = known.select("word")
    cut_off = k.filter(F.length("word") > LETTERS).select("word", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("word") - LETTERS))).alias("n"))
    x = cut_off.select(F.expr("left(word, length(word) - n)").alias("base"), F.expr("right(word, n)").alias("ending"))
    return x.join(k.withColumnRenamed("word", "base"), "base").groupBy("ending").agg(F.count("*").alias("n")).filter(F.col("n") >= ENDING).select("ending")


def keyed(words: DataFrame, name: str) -> DataFrame:
    """(name, k): each word under itself and itself less one letter."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(w, k) for w in f["w"] for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}], columns=[name, "k"])

    return words.select(F.col("word").alias("w")).mapInPandas(run, f"{name} string, k string")


def repairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, at, word, candidate, verdict): every word that the corpus hardly knows and that has a known word one edit away. verdict:
    repaired, several candidates, a form of a known word, or no witness. Null and empty texts have no words."""
    places = cut(word_places(df, key, text), "places")
    known = cut(known_words(places), "known")
    rare = places.join(known, "word", "left_anti").filter(F.length("word") >= LETTERS)
    odd = rare.select("word").distinct()

    def near(frames):
        for f in frames:
            yield f[[osa(a, b, 1) == 1 for a, b in zip(f["word"], f["candidate"])]]

    pairs = keyed(odd, "word").join(keyed(known.filter(F.length("word") >= LETTERS), "candidate"), "k").select("word", "candidate").distinct().mapInPandas(near, "word string, candidate string")
    # A form of a known word: one of the two is the other and a learned ending.
    e = endings(known)
    more = F.when(F.length("word") > F.length("candidate"), F.struct(F.col("word").alias("l"), F.col("candidate").alias("s"))).otherwise(F.struct(F.col("candidate").alias("l"), F.col("word").alias("s")))
    form = pairs.withColumn("x", more).filter(F.col("x.l").startswith(F.col("x.s"))).select("word", F.expr("substring(x.l, length(x.s) + 1)").alias("ending")).join(e, "ending").select("word").distinct().withColumn("form", F.lit(True))
    one = pairs.groupBy("word").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate")).join(form, "word", "left")
    w = Window.partitionBy("doc").orderBy("at")
    beside = places.select("doc", "at", "word", F.lag("word").over(w).alias("l"), F.lead("word").over(w).alias("r"))
    bigrams = beside.filter("r is not null").select("doc", F.col("word").alias("p"), F.col("r").alias("q")).distinct().groupBy("p", "q").agg(F.count("*").alias("docs"))
    x = beside.join(one, "word")
    left = bigrams.select(F.col("p").alias("l"), F.col("q").alias("candidate"), F.lit(True).alias("lw"))
    right = bigrams.select(F.col("p").alias("candidate"), F.col("q").alias("r"), F.lit(True).alias("rw"))
    own = places.select("doc", F.col("word").alias("candidate")).distinct().withColumn("own", F.lit(True))
    x = x.join(left, ["l", "candidate"], "left").join(right, ["r", "candidate"], "left").join(own, ["doc", "candidate"], "left")
    witness = F.coalesce("lw", F.lit(False)) | F.coalesce("rw", F.lit(False)) | F.coalesce("own", F.lit(False))
    verdict = F.when(F.coalesce("form", F.lit(False)), "a form of a known word").when(F.col("n") > 1, "several candidates").when(~witness, "no witness").otherwise("repaired")
    return x.select("doc", "at", "word", "candidate", verdict.alias("verdict"))
