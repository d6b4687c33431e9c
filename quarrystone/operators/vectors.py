"""Exact vector search of a stated query set in blocks: rows and queries are packed into matrices, each pair of blocks is one
matrix product with a local top k, and the local lists are merged per query. No vector is compared row by row in an expression,
and nothing is collected."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block. A block of rows times one of queries gives at most their product in scores, held once.
ROWS, QUERIES = 4096, 1024


def pack(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(n, dim, keys, data): unit vectors in blocks, as they come within a partition; nulls and zero vectors are left out. One
    dimension per block: vectors of another start a block of their own."""

    def run(frames):
        for f in frames:
            by: dict[int, list] = {}
            for k, v in zip(f["k"], f["v"]):
                if v is not None and len(v):
                    x = np.asarray(v, np.float64)
                    n = np.linalg.norm(x)
                    if n > 0:
                        by.setdefault(len(x), []).append((k, x / n))
            for dim, rows in by.items():
                for i in range(0, len(rows), size):
                    part = rows[i : i + size]
                    yield pd.DataFrame({"n": [len(part)], "dim": [dim], "keys": [np.array([k for k, _ in part], np.int64).tobytes()], "data": [np.stack([x for _, x in part]).tobytes()]})

    return df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")).mapInPandas(run, "n int, dim int, keys binary, data binary")


def search(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, itself: bool = False) -> DataFrame:
    """(query, key, score, rank): the k nearest rows of every query by cosine, ties to the smaller key; a row is no answer to
    itself unless asked for."""
    a = pack(rows, key, vector, ROWS)
    b = pack(queries, key, vector, QUERIES).select(F.col("dim"), F.col("keys").alias("qkeys"), F.col("data").alias("qdata"))

    def run(frames):
        for f in frames:
            for dim, ks, d, qs, q in zip(f["dim"], f["keys"], f["data"], f["qkeys"], f["qdata"]):
                ids, qids = np.frombuffer(ks, np.int64), np.frombuffer(qs, np.int64)
                s = np.frombuffer(q, np.float64).reshape(-1, dim) @ np.frombuffer(d, np.float64).reshape(-1, dim).T
                if not itself:
                    s[qids[:, None] == ids[None, :]] = -np.inf
                m = min(k, s.shape[1])
                # All that tie with the last place stay in, so that ties are settled among all blocks.
                bar = np.partition(s, -m, axis=1)[:, -m][:, None]
                i, j = np.nonzero((s >= bar) & np.isfinite(s))
                yield pd.DataFrame({"query": qids[i], "key": ids[j], "score": s[i, j]})

    local = a.join(b, "dim").mapInPandas(run, "query bigint, key bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "key")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
