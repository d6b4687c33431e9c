"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), over the distinct words of a column: each word is
stemmed once, however often it stands."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published suffixes and what they become, by step.
STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def sounds(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """How many times vowels are followed by consonants."""
    return len(re.findall("v+c+", sounds(stem)))


def short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y at the end."""
    return sounds(stem).endswith("cvc") and stem[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    w = word
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    elif (s := longest(w, ("ed", "ing"))) and "v" in sounds(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and sounds(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and short_end(w):
            w += "e"
    if w.endswith("y") and "v" in sounds(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (s := longest(w, table)) and measure(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    if (s := longest(w, STEP4)) and measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def with_stems(df: DataFrame, word: str, name: str = "stem") -> DataFrame:
    """df + the stem of a column of lower-case words; null for null."""

    def run(frames):
        for f in frames:
            yield f.assign(__s=[porter(w) for w in f["__w"]])

    v = df.select(F.col(word).alias("__w")).filter("__w is not null").distinct().mapInPandas(run, "__w string, __s string")
    return df.join(v.withColumnRenamed("__s", name), F.col(word) == F.col("__w"), "left").drop("__w")


def stems_of(words: pd.Series) -> pd.Series:
    return words.map(porter)
