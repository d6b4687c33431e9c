"""Queries of the training-data problems and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.llm import bpe, mixing, personal, pieces, scans, spans, spellings, stuffing
from quarrystone.session import table


def p1_found(spark, d):
    return spans.shared_pairs(spans.shared_classes(table(spark, d, "chunks", "id", "token", "text")))


def p1_shared(spark, d):
    chunks = table(spark, d, "chunks", "id", "token", "text")
    return spans.shared_report(chunks, spans.shared_classes(chunks))


def p1_spans(spark, d):
    return spans.shared_spans(table(spark, d, "chunks", "id", "token", "text"))


def quoted(spark, d):
    """Both tables with free text as one: (tbl, id, token, text)."""
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("tbl"), "id", "token", "text")
    return chunks.unionByName(table(spark, d, "obs").select(F.lit("obs").alias("tbl"), "id", "token", F.col("verbatim").alias("text")))


def keyed(df):
    return df.select(F.struct("tbl", "id").alias("k"), "text")


def p2_found(spark, d):
    got = personal.personal_spans(keyed(quoted(spark, d)), "k", "text")
    return got.select("k.tbl", "k.id", "kind", "start_char").distinct()


def p2_redacted(spark, d):
    return personal.redact(keyed(quoted(spark, d)), "k", "text").select("k.tbl", "k.id", "redacted", "n_items")


def p3_found(spark, d):
    return pieces.oversized(table(spark, d, "chunks", "id", "text"), "id")


def p3_pieces(spark, d):
    return pieces.split_items(table(spark, d, "chunks", "id", "token", "a", "text"))


def p4_found(spark, d):
    return spellings.variant_pairs(table(spark, d, "contracts", "party"))


def p4_entities(spark, d):
    return spellings.entities(table(spark, d, "contracts", "party"))


def scanned(spark, d):
    both = quoted(spark, d)
    return scans.scan_noise(both, ["tbl", "id"], scans.learn(both.filter(F.length("text") > 0)))


def p5_found(spark, d):
    return scanned(spark, d).select("tbl", "id", F.explode("kinds").alias("kind")).distinct()


def p5_repaired(spark, d):
    return scanned(spark, d).select("tbl", "id", "repaired")


def p6_ids(spark, d):
    return bpe.encode_frame(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p7_mix(spark, d):
    return mixing.mix(mixing.sized(table(spark, d, "documents", "doc_id", "source", "text")), table(spark, d, "mix_targets"))


def p7_shares(spark, d):
    sizes, targets = mixing.sized(table(spark, d, "documents", "doc_id", "source", "text")), table(spark, d, "mix_targets")
    return mixing.shares(sizes, targets, mixing.mix(sizes, targets))


def p8_found(spark, d):
    return stuffing.stuffed_pages(table(spark, d, "documents", "doc_id", "text"))


def p8_scores(spark, d):
    return stuffing.page_scores(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_shared, p1_spans, p2_found, p2_redacted, p3_found, p3_pieces, p4_found, p4_entities, p5_found, p5_repaired, p6_ids, p7_mix, p7_shares, p8_found, p8_scores)}

SQL = {
    "p3_found": "SELECT id FROM chunks WHERE length(text) > 1200",
}
