"""Keyword-stuffed pages, link lists and tag lists.

Each text is cut into blocks (paragraphs). A block's compression ratio is divided by the usual ratio of prose blocks of its
language and length, learned over the whole corpus; a block is flagged where that leaves extreme redundancy. Two things are
evened out before compressing, so that the ratio measures what is said rather than how it is set: signs between words count
for nothing, and a link, a hashtag, a labelled tag, a trail of menus, a counted label or a stock number stands as one and the
same sign. A list of links is then the most redundant text there is, and prose with a link in it stays prose. Low density
of sentence punctuation confirms: only ends of real sentences count, that is of units of some length that don't merely repeat
the block's keyword. A document is a case if more than half of its words stand in flagged blocks.

Null, empty and blank texts have no words and are no case. Repeated rows each get their own result. Language is read off the
text (script and function words), as the stored one may be null or wrong.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.session import cut

#: A block is extremely redundant below this share of the usual ratio.
EXTREME = 0.85
#: Real sentence ends per word, at most.
SENTENCES = 0.02
#: Prose blocks that a language and length need for a usual ratio of their own; below, all languages of the length tell.
ENOUGH = 20

NEWLINE = r"(?:\r\n?|[\n\x85\u2028\u2029])"
PARAGRAPH = re.compile(NEWLINE + r"[^\S\n\r]*(?:" + NEWLINE + r"[^\S\n\r]*)+")
PLAIN = re.compile(r"\n[ \t\x0b\f]*(?:\n[ \t\x0b\f]*)+")
CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
END = re.compile(r"(?:(?<![.!?؟])[.!?؟]++[\"'”’)\]]*+(?=\s|$)|[。！？]+)")
#: What counts as one link or tag, in lower-case text: Markdown and HTML links and other markup, addresses with a remark,
#: hashtags, labelled tags, stock numbers with their goods, counted labels, trails of menus.
LINKS = re.compile(
    r"\[[^\]\n]{0,300}\]\([^)\s]{0,2000}\)|<a\s[^>]{0,2000}>[^<]{0,300}</a>|<[^>]{0,200}>|(?:https?://|www\.)\S+(?:\s+\([^)\n]{0,300}\))?|#\w+"
    r"|\b(?:tags?|category|label):\S+|\bsku \d+(?: [^\W\d]+){0,3}(?: \d+\w*)?|\b[^\W\d]++(?: [^\W\d]++)? \(\d+\)"
    r"|(?<![^\s|,;>])(?:[^\s>|,;]{1,40}+ ){1,3}>(?: [^\s>|,;]{1,40}+){1,3}(?: >(?: [^\s>|,;]{1,40}+){1,3})*+"
)
LISTING = re.compile(r"://|www\.|[#<>(]|\b(?:tags?|category|label):|\bsku ")
ONE = "\x01"
#: What stands between words, with the plural s before it; the sign of a link is a word of its own.
BETWEEN, BETWEEN_LINKS = re.compile(r"s?[\W_]+"), re.compile(r"s?[^\w\x01]+")
# Frequent function words by language, to tell languages of one script apart.
FUNCTION_WORDS = {
    "en": {"the", "of", "and", "to", "in", "that", "is", "for", "was", "with"},
    "es": {"el", "los", "que", "por", "una", "las", "del", "según", "para", "se"},
    "fr": {"le", "les", "des", "est", "pour", "du", "et", "une", "pas", "sera"},
    "de": {"der", "die", "und", "das", "ist", "wird", "nicht", "den", "wurde", "bis"},
    "pt": {"os", "não", "uma", "com", "ao", "dos", "foi", "são", "pelo", "mais"},
    "it": {"il", "gli", "che", "non", "della", "sono", "di", "per", "una", "nel"},
}
LANGUAGE_OF = {w: k for k, ws in FUNCTION_WORDS.items() for w in ws}


NOT_LATIN = re.compile(r"[\u0370-\u1dff\u2c00-\ud7ff]")
SCRIPTS = ((0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"))
KANA = re.compile("[\u3040-\u30ff]")


def language(text: str, words: set[str]) -> str:
    """A key for the language: the script, and of Latin script the language whose function words stand most."""
    if not text.isascii() and (m := NOT_LATIN.search(text)):
        script = [k for at, k in SCRIPTS if at <= ord(m[0])][-1]
        return "kana" if script == "han" and KANA.search(text) else script
    k = max(FUNCTION_WORDS, key=lambda k: len(FUNCTION_WORDS[k] & words))
    return k if FUNCTION_WORDS[k] & words else "latin"


def redundancy(low: str, plain: str) -> tuple[int, float]:
    """(bytes of the words, what compression leaves of them once links are one sign) of a block in lower case and its plain words."""
    data = plain.encode("utf-8", "replace")
    folded = BETWEEN_LINKS.sub(" ", LINKS.sub(ONE, low)).encode("utf-8", "replace") if LISTING.search(low) else data
    return len(data), len(zlib.compress(folded, 6)) / max(1, len(data))


def keyword(words: list[str]) -> set[str]:
    """The words of a block's keyword: its commonest pair, said three times or more, and a long word that every eighth is."""
    body = [w for w in words if len(w) > 2 and w.isalpha()]
    if len(body) - len(set(body)) < 2:
        return set()  # nothing is said three times
    best, k = Counter(zip(body, body[1:])).most_common(1)[0]
    key = set(best) if k > 2 else set()
    longest = Counter([w for w in body if len(w) > 4]).most_common(1)
    if longest and longest[0][1] > 2 and longest[0][1] / len(words) > 0.12:
        key.add(longest[0][0])
    return key - LANGUAGE_OF.keys()


def block_features(block: str) -> tuple | None:
    """(language, length class, compression ratio, words, real sentence ends per word)."""
    raw = block.lower().split()
    cjk = 0 if block.isascii() else len(CJK.findall(block))
    n = len(raw) + cjk // 2
    if not n:
        return None
    low = block.lower()
    plain = BETWEEN.sub(" ", low)
    size, ratio = redundancy(low, plain)
    real = at = 0
    key = None
    for m in END.finditer(block):
        unit = low[at : m.start()] if len(low) == len(block) else block[at : m.start()].lower()
        at = m.end()
        if cjk and CJK.search(unit):
            real += len(unit) >= 8
            continue
        ws = unit.split()
        if len(ws) < 5:
            continue
        if key is None:
            key = keyword(plain.split())
        if not key or sum(w in key for w in BETWEEN.sub(" ", unit + " ").split()) / len(ws) <= 0.22:
            real += 1
    return (language(block, set(raw)), int(math.log2(max(2, size)) * 2), ratio, n, real / n)


def blocks_of(text: str) -> list[str]:
    """Paragraphs; short ones without a sentence that follow each other (a list with blank lines) are one block."""
    out: list[str] = []
    short = False
    for p in (PLAIN if text.isascii() and "\r" not in text else PARAGRAPH).split(text):
        if not p or p.isspace():
            continue
        now = len(p) < 120 and len(p.split()) < 12 and not END.search(p)
        if now and short:
            out[-1] += "\n" + p
        else:
            out.append(p)
        short = now
    return out


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = []
            for k, t in zip(f["key"], f["text"]):
                for b in blocks_of(t):
                    x = block_features(b)
                    if x:
                        rows.append((k, *x))
            yield pd.DataFrame(rows, columns=["key", "lang", "size", "ratio", "words", "sentences"])

    src = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    return src.mapInPandas(run, f"key {kind}, lang string, size int, ratio double, words int, sentences double")


def page_scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words, stuffed_words, share): one row per document that has words. The table of usual ratios has a row per
    language and length class, a few hundred at any size of corpus, so it is broadcast."""
    b = cut(blocks(df, key, text), "blocks")
    prose = b.filter(F.col("sentences") > SENTENCES)
    usual = prose.groupBy("lang", "size").agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual"), F.count("*").alias("n"))
    by_size = prose.groupBy("size").agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual_any"))
    scored = (
        b.join(F.broadcast(usual.filter(F.col("n") >= ENOUGH).drop("n")), ["lang", "size"], "left")
        .join(F.broadcast(by_size), "size", "left")
        .withColumn("redundancy", F.col("ratio") / F.coalesce("usual", "usual_any", F.lit(0.6)))
    )
    return (
        scored.withColumn("bad", (F.col("redundancy") < EXTREME) & (F.col("sentences") <= SENTENCES))
        .groupBy(F.col("key").alias(key))
        .agg(F.sum("words").alias("words"), F.sum(F.when(F.col("bad"), F.col("words")).otherwise(0)).alias("stuffed_words"))
        .withColumn("share", F.col("stuffed_words") / F.col("words"))
    )


def stuffed_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return page_scores(df, key, text).filter("share > 0.5").select(key)
