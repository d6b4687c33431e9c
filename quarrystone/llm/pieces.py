"""Splitting oversized items at natural boundaries.

One regular expression with bounded quantifiers cuts a text into consecutive cores. Its alternatives stand in the order of
boundary strength (paragraph, line, sentence, clause, word) and each consumes as much as the limit lets it; the last takes
single characters, so a text without any boundary is cut at the limit. A piece is the tail of the core before it (the overlap)
and its own core. All of it is Spark's own string and array functions.

Nulls give no piece, an empty or fitting text gives itself as one piece. Offsets are code points. A piece's ``a`` and ``b``
are null where the item's own ``a`` is null; ``start`` and ``stop`` count within the item and are always there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a core ends with, strongest boundary first, and how many characters that takes at most.
BOUNDARIES = ((r"\n[ \t]{0,8}\n", 10), (r"\n", 1), (r"[.!?][\"')\]]?\s", 3), (r"[;:,]\s", 2), (r"\s", 1))


def core_pattern(limit: int, overlap: int) -> str:
    """Cores of at most ``limit`` characters at the start of a text and ``limit - overlap`` after it, each longer than half
    of that where it ends at a boundary, so that no core but the last is shorter than the overlap."""
    if not 0 <= overlap <= limit // 3 or limit < 30:
        raise ValueError("the limit must be at least 30 and the overlap at most a third of it")

    def run(most: int, anchor: str) -> str:
        least = max(overlap, most // 2)
        ends = "|".join(f".{{{least},{most - n}}}{b}" for b, n in BOUNDARIES)
        return f"{anchor}(?:.{{1,{most}}}+\\z|{ends}|.{{{most}}})"

    return "(?s)" + run(limit, r"\A") + "|" + run(limit - overlap, "")


def cores(text: Column, limit: int, overlap: int) -> Column:
    return F.regexp_extract_all(text, F.lit(core_pattern(limit, overlap)), F.lit(0))


def split_items(df: DataFrame, text: str = "text", a: str = "a", limit: int = 1200, overlap: int = 200) -> DataFrame:
    """All columns of df but text, a and b, and per piece: piece_no, n_pieces, a, b, start, stop, overlap, piece."""
    t = F.col(text)
    others = [c for c in df.columns if c not in (text, "a", "b", a, "piece_no", "n_pieces", "start", "stop", "overlap", "piece")]
    fits = F.length(t) <= limit
    parts = F.when(fits, F.array(t)).otherwise(cores(t, limit, overlap))
    sums = F.aggregate(
        F.transform("__parts", F.length),
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    each = F.transform(
        "__parts",
        lambda core, i: F.struct(
            F.get(F.col("__at"), i).alias("at"),
            F.when(i == 0, F.lit("")).otherwise(F.right(F.get(F.col("__parts"), i - 1), F.lit(overlap))).alias("before"),
            core.alias("core"),
        ),
    )
    cut = (
        df.filter(t.isNotNull())
        .select(*others, F.col(a).cast("bigint").alias("__a"), parts.alias("__parts"))
        .withColumn("__at", sums)
        .select(*others, "__a", F.size("__parts").alias("n_pieces"), F.posexplode(each).alias("piece_no", "__p"))
    )
    back = F.length("__p.before")
    start = (F.col("__p.at") - back).cast("bigint")
    stop = (F.col("__p.at") + F.length("__p.core")).cast("bigint")
    return cut.select(
        *others, "piece_no", "n_pieces",
        (F.col("__a") + start).alias("a"), (F.col("__a") + stop).alias("b"),
        start.alias("start"), stop.alias("stop"), back.alias("overlap"),
        F.concat("__p.before", "__p.core").alias("piece"),
    )


def oversized(df: DataFrame, key: str, text: str = "text", limit: int = 1200, overlap: int = 200) -> DataFrame:
    """The keys of the items that the splitter cuts into more than one piece."""
    cut = split_items(df.select(key, text, F.lit(None).cast("bigint").alias("a")), text, "a", limit, overlap)
    return cut.filter(F.col("piece_no") == 1).select(key)
