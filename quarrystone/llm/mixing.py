"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. The mix is as large as the scarcest source allows at the targets: a source of T tokens
with share s and at most r repeats can carry a mix of r * T / s tokens. Each document of a source then gets the same fractional
number of copies; its whole part is certain, and the rest is settled by pivotal dependent rounding: two documents with open
probabilities trade mass, in tokens, until one of them is decided, so the tokens of a source stay what they were, and each
document's chance stays its probability. Groups of documents (a hash bucket of one source) settle alone, each leaves at most
one document open, and the open ones combine in a reduction tree of ``FAN`` groups a step down to one per source, which a last
draw decides. A source is thus off its target by less than its largest document.

Defined results: null, empty and untokenised texts weigh 0, and get no copies; documents of sources without a target get none;
a target without documents stays at 0 and its share is spread over the others in proportion. Draws are hashes of document,
step and seed, so a lost executor's work comes out the same. Null ids share their draws.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.bpe import DEFAULT_VOCABULARY, count_frame
from quarrystone.session import cut

#: Documents a first group holds on average, and open documents that one group of a later step takes.
GROUP, FAN = 20_000, 64


def draw(seed: int, step: int, a: int, b: int) -> float:
    h = hashlib.blake2b(f"{seed}|{step}|{a}|{b}".encode(), digest_size=8).digest()
    return int.from_bytes(h, "big") / 2**64


def settle(ids: list, weights: list[float], open_: list[float], step: int, seed: int) -> tuple[list[int], int, float]:
    """Pivotal rounding of one group: (1 or 0 for each, place still open or -1, its probability)."""
    out, at, p, tiny = [0] * len(ids), -1, 0.0, 1e-12
    for j, q in enumerate(open_):
        if q <= tiny or q >= 1 - tiny:
            out[j] = int(q > 0.5)
            continue
        if at < 0:
            at, p = j, q
            continue
        wi, wj = weights[at], weights[j]
        up = min((1 - p) * wi, q * wj)  # tokens that i can gain from j
        down = min(p * wi, (1 - q) * wj)  # and j from i
        gain = up if draw(seed, step, ids[at], ids[j]) * (up + down) < down else -down
        p, q = p + gain / wi, q - gain / wj
        done_i, done_j = not tiny < p < 1 - tiny, not tiny < q < 1 - tiny
        if done_i:
            out[at] = int(p > 0.5)
        if done_j:
            out[j] = int(q > 0.5)
        if done_i and done_j:
            at = -1
        elif done_i:
            at, p = j, q
    return out, at, p


def plan(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: its tokens, share of the mix, and copies per document. A row per source, so it is small."""
    per = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    t = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    j = t.filter(F.col("source").isNotNull()).join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    live = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    total = j.agg(F.sum(F.when(live, F.col("target_share"))).alias("live_share"))
    j = j.crossJoin(F.broadcast(total)).withColumn("want", F.when(live, F.col("target_share") / F.col("live_share")).otherwise(0.0))
    size = j.agg(F.min(F.when(live, F.col("max_repeats") * F.col("tokens") / F.col("want"))).alias("mix_tokens"))
    return j.crossJoin(F.broadcast(size)).withColumn(
        "copies", F.when(live, F.least(F.col("max_repeats").cast("double"), F.col("want") * F.col("mix_tokens") / F.col("tokens"))).otherwise(0.0)
    )


def sized(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens), encoded once and kept as a written stage."""
    return cut(count_frame(docs, ["doc_id", "source"], "text", vocabulary), "sizes")


def mix(tokens: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents used at least once."""
    tokens = tokens.select("doc_id", "source", "n_tokens")
    p = plan(tokens, targets).select("source", "copies", "docs")
    rows = tokens.filter("n_tokens > 0").join(F.broadcast(p.filter("copies > 0")), "source")
    whole = F.floor(F.col("copies") + 1e-9).cast("int")
    rows = rows.select(
        "doc_id", "source", "n_tokens", whole.alias("sure"), F.greatest(F.lit(0.0), F.col("copies") - whole).alias("p"),
        F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("docs") / GROUP))).cast("int").alias("grp"),
    )
    schema = "doc_id bigint, source string, n_tokens bigint, sure int, p double, grp int, up int, open boolean"

    def step(no: int):
        def run(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(["n_tokens", "doc_id"], kind="stable").reset_index(drop=True)
            out, at, left = settle(f["doc_id"].tolist(), f["n_tokens"].astype(float).tolist(), f["p"].tolist(), no, seed)
            f["up"], f["open"] = out, False
            if at >= 0:
                f.loc[at, ["p", "open"]] = [left, True]
            return f[["doc_id", "source", "n_tokens", "sure", "p", "grp", "up", "open"]]

        return run

    def go(df: DataFrame, no: int) -> DataFrame:
        return cut(df.groupBy("source", "grp").applyInPandas(step(no), schema), f"settled{no}")

    biggest = p.agg(F.max("docs")).head()[0] or 1  # one number: how deep the tree must be
    groups, no = max(1, math.ceil(biggest / GROUP)), 0
    done = go(rows, 0)
    parts = [done.filter("not open")]
    while groups > 1:
        groups, no = math.ceil(groups / FAN), no + 1
        again = done.filter("open").select("doc_id", "source", "n_tokens", "sure", "p", F.floor(F.col("grp") / FAN).cast("int").alias("grp"))
        done = go(again, no)
        parts.append(done.filter("not open"))
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    parts.append(done.filter("open").withColumn("up", (u < F.col("p")).cast("int")))
    all_ = parts[0]
    for x in parts[1:]:
        all_ = all_.unionByName(x)
    return all_.select("doc_id", "source", "n_tokens", (F.col("sure") + F.col("up")).alias("copies")).filter("copies > 0")


def shares(tokens: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per source with a target or a document: target and reached share, documents used, copies and tokens."""
    used = mixed.groupBy("source").agg(
        F.count("*").alias("docs_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens")
    )
    have = tokens.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    t = targets.select("source", "target_share", "max_repeats")
    j = t.join(have, t.source.eqNullSafe(have.source), "full").select(F.coalesce(t.source, have.source).alias("source"), "target_share", "max_repeats", "source_tokens")
    k = used.withColumnRenamed("source", "s2")
    out = j.join(k, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    out = out.crossJoin(F.broadcast(mixed.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("all_tokens"))))
    z = F.lit(0)
    return out.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", F.coalesce("source_tokens", z).alias("source_tokens"),
        *[F.coalesce(c, z).alias(c) for c in ("docs_used", "copies", "most_copies", "mix_tokens")],
        F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
    )
