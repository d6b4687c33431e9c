"""Table and log sources and sinks: JSON lines, delimited files, chunk and signer scans, vectors, exports."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.scalars import text_of


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): JSON lines, plain or compressed (.gz, .zst by suffix); a line that is no JSON is kept as text, with why."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    ok = F.expr("try_parse_json(value)").isNotNull()
    return raw.filter(ok).select(F.from_json("value", schema).alias("x")).select("x.*"), raw.filter(~ok).select(F.col("value").alias("line"), F.lit("not JSON").alias("why"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def refresh_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows without a key are left out."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(c) for c in rows.columns if c not in (key, order)])
    return rows.filter(F.trim(text_of(key)) != "").withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def incremental(new: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """New rows that are not there yet."""
    return new.join(have.select(*key).distinct(), key, "left_anti")


def changed_chunks(files: DataFrame, known: DataFrame, chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after an incremental build: files (token, size, mtime) that are unknown or changed have theirs replaced by the
    fresh ones, all others keep theirs; files that are gone lose them."""
    same = files.join(known, ["token", "size", "mtime"], "left_semi").select("token")
    changed = files.join(same, "token", "left_anti").select("token")
    return chunks.join(same, "token", "left_semi").unionByName(fresh.join(changed, "token", "left_semi"))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file with a header; the sign is taken from the first line (tab, semicolon or comma). Quoted cells may hold
    line ends; blank rows are dropped."""
    if sep is None:
        head = spark.read.text(path).limit(1).head()
        line = head[0] if head else ""
        sep = max("\t;,", key=line.count)
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return df.filter(F.concat_ws("", *[text_of(F.col(f"`{c}`")) for c in df.columns]) != "")


def row_sentences(df: DataFrame, title: str, fields: list[str] | None = None) -> Column:
    """A row as a sentence: 'title: field value; field value.' without empty cells."""
    cells = [F.when(F.trim(text_of(c)) != "", F.concat(F.lit(f"{c} "), F.trim(text_of(c)))) for c in (fields or df.columns)]
    return F.concat(F.lit(f"{title}: "), F.concat_ws("; ", *cells), F.lit("."))


def export_csv(df: DataFrame, path: str, most: int = 100_000) -> bool:
    """At most ``most`` rows as one CSV file with a header and a byte order mark; says whether rows were left out."""
    over = df.limit(most + 1).count() > most
    first, *rest = df.columns
    # The mark goes before the header's first letter, which is the file's first.
    df.limit(most).coalesce(1).select(F.col(first).alias("\ufeff" + first), *rest).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return over


def overlapping_chunks(text: str, size: int = 1200, step: int = 1000, look: int = 120) -> list[tuple[int, int]]:
    """Spans of a text in pieces of ``size`` that overlap, ended at the last blank of their final ``look`` characters."""
    out, a, n = [], 0, len(text or "")
    while a < n:
        b = min(n, a + size)
        if b < n:
            cut = text.rfind(" ", b - look, b)
            b = cut if cut > a else b
        out.append((a, b))
        if b >= n:
            break
        a = max(a + 1, b - (size - step))
    return out


def chunk_table(df: DataFrame, key: str, text: str, size: int = 1200, step: int = 1000) -> DataFrame:
    """(key, a, b, text)."""

    def run(frames):
        for f in frames:
            rows = [(k, a, b, t[a:b]) for k, t in zip(f["k"], f["t"]) if t for a, b in overlapping_chunks(t, size, step)]
            yield pd.DataFrame(rows, columns=["k", "a", "b", "text"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {dict(df.dtypes)[key]}, a bigint, b bigint, text string").withColumnRenamed("k", key)


def fixed_chunks(df: DataFrame, key: str, text: str, size: int, overlap: float) -> DataFrame:
    """(key, s, e, text) in steps of size x (1 - overlap), the last cut at the end."""
    step = max(1, int(size * (1 - overlap)))
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int") * step)
    return df.filter(n > 0).select(key, F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("s"), F.col(text).alias("__t")).select(
        key, "s", F.least(F.col("s") + size, F.length("__t")).alias("e"), F.substring("__t", F.col("s") + 1, F.lit(size)).alias("text")
    )


MAIL = re.compile(r"^[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+$")
SIGN_STOP = re.compile(r"(?i)^(?:in person signer|editor delivery|agent delivery|intermediary delivery|certified delivery|carbon copy|witness|notary|envelope summary|payment) events?\b")
SIGN_SKIP = re.compile(r"(?i)^(?:signed|using ip|security|timestamp|signature|sent|viewed|title|company|electronic record)\b|^\s*$|^[\d/:\s]+$")


def signers_of(text: str | None) -> list[tuple[str, str]]:
    """(name, e-mail) of the signer blocks of a completion certificate: a name line above an e-mail line."""
    out, on, name = [], False, ""
    for line in (text or "").splitlines():
        s = line.strip()
        if re.match(r"(?i)^signer events\b", s):
            on, name = True, ""
        elif on and SIGN_STOP.match(s):
            on = False
        elif on and MAIL.match(s):
            if name:
                out.append((name, s))
            name = ""
        elif on and not SIGN_SKIP.match(s):
            name = s
    return out


def signer_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, email), each once."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(k, n, e) for k, t in zip(f["k"], f["t"]) for n, e in signers_of(t)], columns=["k", "name", "email"])

    got = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.contains("t", F.lit("Signer Events"))).mapInPandas(run, f"k {dict(df.dtypes)[key]}, name string, email string")
    return got.withColumnRenamed("k", key).distinct()


def to_half(vectors: pd.Series) -> pd.Series:
    """Vectors as 16-bit floats in bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, np.float16).tobytes())


def from_half(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, np.float16).astype(np.float32))


def pack_vectors(df: DataFrame, vector: str) -> DataFrame:
    """The vector column as half floats: half the size in storage; read back with ``unpack_vectors``."""
    return df.withColumn(vector, F.pandas_udf(to_half, "binary")(vector))


def unpack_vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, F.pandas_udf(from_half, "array<float>")(vector))


def fold_index(rows: DataFrame) -> dict[str, DataFrame]:
    """The current view of an index log (kind, id, seq, payload): the last row per kind and id whose id has no tombstone after it."""
    last = rows.filter("kind <> 'tombstone'").groupBy("kind", "id").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))
    dead = rows.filter("kind = 'tombstone'").groupBy("id").agg(F.max("seq").alias("dead"))
    live = last.join(dead, "id", "left").filter("dead is null or seq > dead").select("kind", "id", "payload")
    return {k: live.filter(F.col("kind") == k).drop("kind") for k in ("doc", "chunk", "vector")}


LINK = re.compile(r'<([^>]+)>;\s*rel="([^"]*)"(?:;\s*datetime="([^"]*)")?(?:;\s*status="?(\d+)"?)?(?:;\s*length="?(\d+)"?)?')


def parse_timemap(text: str | None) -> list[tuple[str, str, str | None, int | None]]:
    """(uri, datetime, status, length) of the mementos of a link-format timemap."""
    return [(m[1], m[3], m[4], int(m[5]) if m[5] else None) for m in LINK.finditer(text or "") if "memento" in m[2] and m[3]]


def score_memento(status: Column, length: Column, when: Column, now: Column) -> Column:
    """Better with status 200, more text and less age."""
    ok = F.when(status == "200", 3.0).when(status.startswith("3"), 1.0).when(status.isNull(), 2.0).otherwise(0.0)
    return ok + F.log10(F.greatest(F.lit(1.0), F.coalesce(length.cast("double"), F.lit(1.0)))) - F.datediff(now, when) / 3650.0


def form_fields(text: str | None) -> list[tuple[str, str]]:
    """(label, value) of a form's lines: 'label: value', two blanks or a dash between; labels of at most six words, no digit."""
    out = []
    for line in (text or "").split("\n"):
        s = line.strip()
        at = s.find(":")
        if len(s) < 4:
            continue
        if 1 < at <= 40:
            label, value = s[:at], s[at + 1 :]
        elif m := re.match(r"([A-Za-z][A-Za-z ./()&#,\-]{1,40}?)(?:\s{2,}|\s+[-–—]\s+)(\S.*)$", s):
            label, value = m[1], m[2]
        else:
            continue
        label, value = re.sub(r"[\s.:\-–—]+$", "", label).strip(), value.strip()
        if len(label) < 2 or len(label.split()) > 6 or re.search(r"\d", label) or not re.search(r"[A-Za-z]", label) or not re.search(r"[^\W_]", value):
            continue
        out.append((label, value[:220]))
    return out


def grid_from_text(text: str | None) -> list[list[str]]:
    """Rows of cells parted by two blanks or more or a tab, at least two cells each."""
    rows = [[c.strip() for c in re.split(r"\t|\s{2,}", l.strip()) if c.strip()] for l in (text or "").split("\n")]
    return [r for r in rows if len(r) > 1]


def grid_from_elements(df: DataFrame, by: str, height: float = 8.0) -> DataFrame:
    """(by, row, col, text) of words (x, y, text): rows are islands of y, the first row the header, columns the nearest header
    word in x."""
    w = Window.partitionBy(by).orderBy("y", "x")
    x = df.withColumn("__new", F.when(F.col("y") - F.lag("y").over(w) < height, 0).otherwise(1)).withColumn("row", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    heads = x.filter("row = 1").select(F.col(by), F.col("x").alias("hx"), F.row_number().over(Window.partitionBy(by).orderBy("x")).alias("col"))
    near = x.join(heads, by).groupBy(by, "row", "x", "y", "text").agg(F.min_by("col", F.abs(F.col("x") - F.col("hx"))).alias("col"))
    return near.groupBy(by, "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " ").alias("text"))
