"""Long exact spans shared between records.

Seed: every text gives winnowed anchors, the smallest hashes of its ``K``-character windows within each ``WINDOW`` neighbours.
Two texts that share a run of ``LEAST`` = K + WINDOW - 1 or more characters share an anchor inside that run, at the same place
of it, so no such pair is missed. Extend: for each pair of records of different owners that share an anchor, the match grows
both ways, character by character, to the maximal repeat; those of ``LEAST`` or more characters are kept. Hashes only propose,
the characters decide.

Rows of one text are one class: anchors, candidate pairs and matches are formed between classes only, however many rows repeat a
text, and an anchor's owners are brought down to the least and the greatest before anything is put together. Only anchors that
stand under two owners go on, and only texts with such an anchor are moved, once for each pair of classes. The report per
record is computed from classes, their owners and counts; rows are only paired where pairs are what is asked for.

Null, empty and short texts have no anchors. Rows of one owner are never compared. Nulls as owner count as one owner.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.session import cut

LEAST = 200
K = 120

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over each w neighbours, by running op from both ends of blocks of w."""
    n = len(x)
    y = np.concatenate([x, np.full((-n) % w + w, fill, np.uint64)]).reshape(-1, w)
    head = op.accumulate(y, axis=1).ravel()
    tail = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


class Winnower:
    """Anchors of texts; the powers are computed once for the longest text seen."""

    def __init__(self, k: int = K, least: int = LEAST):
        self.k, self.w = k, least - k + 1
        self.grow(4096)

    def grow(self, n: int) -> None:
        for name, base in (("up", MULTIPLIER), ("down", INVERSE)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            setattr(self, name, np.multiply.accumulate(x))

    def anchors(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places. Of equal hashes side by side (a run of one character) the first and the last place stand for
        all: any match through the run can be moved to one of them without getting shorter."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, k, w = len(c), self.k, self.w
        if n < k + w - 1:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if n >= len(self.up):
            self.grow(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((c + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least = sliding(h, w, np.minimum, (1 << 64) - 1)
        edge = np.zeros(w - 1, np.uint64)
        at = np.nonzero(sliding(np.concatenate([edge, least, edge]), w, np.maximum, 0) == h)[0]
        if len(at) > 2:
            same = (h[at[1:]] == h[at[:-1]]) & (at[1:] == at[:-1] + 1)
            inner = np.zeros(len(at), bool)
            inner[1:-1] = same[:-1] & same[1:]
            at = at[~inner]
        return h[at], at


def members(df: DataFrame, key: str, owner: str, text: str, least: int) -> DataFrame:
    """(id, own, cls): records long enough to share a run, with the code of their owner and the class of their text."""
    return df.select(F.col(key).alias("id"), F.xxhash64(F.col(owner)).alias("own"), F.md5(F.col(text)).alias("cls"), F.length(text).alias("n")).filter(F.col("n") >= least)


def anchor_rows(df: DataFrame, key: str, owner: str, text: str, k: int, least: int) -> DataFrame:
    """(anchor, id, own, at)."""
    src = df.select(F.col(key).alias("id"), F.xxhash64(F.col(owner)).alias("own"), F.col(text).alias("text")).filter(F.length("text") >= least)

    def run(frames):
        win = Winnower(k, least)
        for f in frames:
            ids, owns, hashes, places, counts = f["id"].to_numpy(), f["own"].to_numpy(), [], [], []
            for t in f["text"]:
                h, at = win.anchors(t)
                hashes.append(h), places.append(at), counts.append(len(at))
            if sum(counts):
                yield pd.DataFrame({"anchor": np.concatenate(hashes).view(np.int64), "id": np.repeat(ids, counts), "own": np.repeat(owns, counts), "at": np.concatenate(places).astype(np.int32)})

    return src.mapInPandas(run, f"anchor bigint, id {df.schema[key].dataType.simpleString()}, own bigint, at int")


def extend(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], k: int, least: int) -> list[tuple[int, int, int]]:
    """Maximal matches (start in a, start in b, length) through the seeds, of at least ``least``."""
    lines = defaultdict(list)
    for i, j in seeds:
        lines[i - j].append(i)
    out = []
    for d, places in lines.items():
        done = -1
        for i in sorted(set(places)):
            if i < done:
                continue
            j = i - d
            m = min(len(a) - i, len(b) - j)
            off = np.nonzero(a[i : i + m] != b[j : j + m])[0]
            right = int(off[0]) if len(off) else m
            m = min(i, j)
            off = np.nonzero(a[i - m : i][::-1] != b[j - m : j][::-1])[0]
            left = int(off[0]) if len(off) else m
            if right >= 1:
                done = i + right
            if left + right >= least and right:
                out.append((i - left, j - left, left + right))
    return out


class Shared:
    """members (id, own, cls); spans between classes (ca, cb, start_a, start_b, length), ca <= cb: ca = cb stands for whole texts under
    several owners."""

    def __init__(self, rows: DataFrame, spans: DataFrame):
        self.members, self.spans = rows, spans


def shared_classes(df: DataFrame, key: str = "id", owner: str = "token", text: str = "text", k: int = K, least: int = LEAST) -> Shared:
    """Every maximal shared run between classes of texts that have records of different owners."""
    rows = cut(members(df, key, owner, text, least), "members")
    every = cut(anchor_rows(df, key, owner, text, k, least), "anchors")
    both = every.groupBy("anchor").agg(F.min("own").alias("l"), F.max("own").alias("h")).filter("l <> h")
    # Only what stands under two owners is joined on, and only that is brought down to classes.
    some = every.join(both.select("anchor"), "anchor", "left_semi").join(rows.select("id", "cls"), "id")
    hot = cut(some.groupBy("anchor", "cls", "at").agg(F.min("own").alias("lo"), F.max("own").alias("hi")), "hot")
    a, b = hot.alias("a"), hot.alias("b")
    # Two classes of one and the same single owner are no pair.
    pairs = (
        a.join(b, "anchor")
        .filter("a.cls < b.cls and not (a.lo = a.hi and a.lo = b.lo and b.lo = b.hi)")
        .groupBy(F.col("a.cls").alias("ca"), F.col("b.cls").alias("cb"))
        .agg(F.collect_set(F.struct(F.col("a.at").alias("i"), F.col("b.at").alias("j"))).alias("seeds"))
    )
    one = rows.join(hot.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id"))
    texts = cut(df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(one, "id").filter(F.md5("text") == F.col("cls")).groupBy("cls").agg(F.first("text").alias("text")), "texts")
    full = pairs.join(texts.select(F.col("cls").alias("ca"), F.col("text").alias("text_a")), "ca").join(texts.select(F.col("cls").alias("cb"), F.col("text").alias("text_b")), "cb")

    def run(frames):
        for f in frames:
            out = []
            for ca, cb, seeds, ta, tb in zip(f["ca"], f["cb"], f["seeds"], f["text_a"], f["text_b"]):
                x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (ta, tb))
                out += [(ca, cb, *s) for s in extend(x, y, [(e["i"], e["j"]) for e in seeds], k, least)]
            yield pd.DataFrame(out, columns=["ca", "cb", "start_a", "start_b", "length"])

    between = full.select("ca", "cb", "seeds", "text_a", "text_b").mapInPandas(run, "ca string, cb string, start_a int, start_b int, length int")
    zero = F.lit(0)
    whole = rows.groupBy("cls").agg(F.min("own").alias("l"), F.max("own").alias("h"), F.first("n").alias("n")).filter("l <> h")
    return Shared(rows, cut(between.unionByName(whole.select(F.col("cls").alias("ca"), F.col("cls").alias("cb"), zero.alias("start_a"), zero.alias("start_b"), F.col("n").alias("length"))), "spans"))


def expanded(shared: Shared, what: DataFrame) -> DataFrame:
    """Rows of ``what`` (ca, cb, ...) for every two records of different owners in the two classes, the smaller id first."""
    m = shared.members
    x = what.join(m.select(F.col("cls").alias("ca"), F.col("id").alias("ia"), F.col("own").alias("oa")), "ca").join(m.select(F.col("cls").alias("cb"), F.col("id").alias("ib"), F.col("own").alias("ob")), "cb")
    return x.filter("oa <> ob and (ca <> cb or ia < ib)")


def shared_spans(df: DataFrame, key: str = "id", owner: str = "token", text: str = "text", k: int = K, least: int = LEAST) -> DataFrame:
    """(id_a, id_b, start_a, start_b, length): every maximal shared run between records of different owners, id_a < id_b."""
    shared = shared_classes(df, key, owner, text, k, least)
    x = expanded(shared, shared.spans)
    first = F.col("ia") < F.col("ib")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return x.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), pick("start_a", "start_b").alias("start_a"), pick("start_b", "start_a").alias("start_b"), "length")


def shared_pairs(shared: Shared) -> DataFrame:
    """(id_a, id_b): records of different owners that share a run. Pairs of classes are distinct, so are those of records."""
    x = expanded(shared, shared.spans.select("ca", "cb").distinct())
    return x.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def shared_report(df: DataFrame, shared: Shared, key: str = "id", text: str = "text") -> DataFrame:
    """One row per record: its length, how many of its characters also stand under another owner, and with how many records; from
    classes and their owners' counts alone, no pair of records is formed."""
    ends = shared.spans.select(
        F.explode(
            F.array(
                F.struct(F.col("ca").alias("cls"), F.col("cb").alias("other"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")),
                F.struct(F.col("cb").alias("cls"), F.col("ca").alias("other"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e")),
            )
        ).alias("x")
    ).select("x.*")
    owned = shared.members.groupBy("cls", "own").agg(F.count("*").alias("k"))
    total = owned.groupBy("cls").agg(F.sum("k").alias("all"), F.min("own").alias("lo"), F.max("own").alias("hi"))
    other = total.select(F.col("cls").alias("other"), "all", "lo", "hi")
    # Each class' owners see the spans with classes that others own too.
    mine = owned.select("cls", "own")
    seen = ends.distinct().join(other, "other").join(mine, "cls").filter("lo <> own or hi <> own")
    w = Window.partitionBy("cls", "own").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        seen.withColumn("reach", F.coalesce(F.max("e").over(w), F.lit(0)))
        .withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reach")))
        .groupBy("cls", "own")
        .agg(F.sum("new").alias("shared_chars"))
    )
    links = seen.select("cls", "own", "other", "all").distinct().join(owned.select(F.col("cls").alias("other"), "own", "k"), ["other", "own"], "left")
    partners = links.groupBy("cls", "own").agg(F.sum(F.col("all") - F.coalesce("k", F.lit(0))).alias("partners"))
    got = shared.members.join(covered, ["cls", "own"]).join(partners, ["cls", "own"]).select("id", "shared_chars", "partners")
    return (
        df.select(F.col(key).alias("id"), F.length(text).cast("bigint").alias("n_chars"))
        .join(got, "id", "left")
        .select("id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("partners", F.lit(0)).alias("partners"))
    )
