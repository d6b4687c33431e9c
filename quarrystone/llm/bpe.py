"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern. A piece is merged over a contiguous array of part boundaries and the ranks of
adjacent parts: find the smallest rank, delete the boundary, refresh the two neighbouring ranks. Pieces longer than
``SHORT`` bytes (long runs) go through a heap over linked parts instead, with the same result in n log n.
Nulls and empty texts give an empty list; a blank text is encoded as it stands.
"""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The pattern published with the vocabulary, its white space spelled out so that both engines agree.
WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WS + r"\p{L}\p{N}]+|[" + WS + r"]+(?![^" + WS + r"])|[" + WS + r"]+"
)
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

SHORT = 256
NONE = 1 << 30
CACHE = 400_000


def load_ranks(path: str = DEFAULT_VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Contiguous arrays; quadratic, and fastest on the short words that make up text."""
    get = ranks.get
    bound = list(range(len(word) + 1))
    rank = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == NONE:
            break
        i = rank.index(least)
        del bound[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[bound[i] : bound[i + 2]], NONE)
        if i:
            rank[i - 1] = get(word[bound[i - 1] : bound[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bound, bound[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap of (rank, place); stale entries are skipped."""
    n, get = len(word), ranks.get
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or right[i] >= n:
            continue
        j = right[i]
        if get(word[i : right[j]], NONE) != r:
            continue
        alive[j] = False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            if (q := get(word[i : right[right[i]]], NONE)) != NONE:
                heapq.heappush(heap, (q, i))
        if (p := left[i]) >= 0 and (q := get(word[p : right[i]], NONE)) != NONE:
            heapq.heappush(heap, (q, p))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : right[i]]])
        i = right[i]
    return out


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    one = ranks.get(word)
    if one is not None:
        return [one]
    return merge_short(word, ranks) if len(word) <= SHORT else merge_long(word, ranks)


class PieceCache(dict):
    """Piece to its ids as int32 bytes; emptied when full, so memory is bounded and results never change."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        got = np.array(merge(piece.encode(), self.ranks), np.int32).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = got
        return got


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.cache = PieceCache(ranks)
        self.ascii = re.compile(ASCII_PIECES).findall
        self.full = regex.compile(PIECES).findall

    def bytes_of(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.cache.__getitem__, (self.ascii if text.isascii() else self.full)(text)))

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.bytes_of(text), np.int32).tolist()


def encode_frame(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): one row per row of df. The driver reads the vocabulary (50k entries, a fixed size) and broadcasts it."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    src = df.select(F.col(key), F.col(text).alias("text"))
    kind = src.schema[key].dataType.simpleString()

    def run(batches):
        enc = Encoder(ranks.value)
        for b in batches:
            got = [enc.bytes_of(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in got], out=ends[1:])
            ids = pa.array(np.frombuffer(b"".join(got), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], names=[key, "ids"])

    return src.mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_frame(df: DataFrame, keep: list[str], text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """keep + n_tokens, without shipping the ids back."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    src = df.select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        enc = Encoder(ranks.value)
        for b in batches:
            n = [len(enc.bytes_of(t)) // 4 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return src.mapInArrow(run, f"{kinds}, n_tokens bigint")
