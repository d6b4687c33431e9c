"""Links between statements of different sources: best answers per source, defined phrases, denials, entity candidates, ignore
rules, corpus maps, and verdicts that rest on several witnesses. Pairs are formed through shared rare tokens or phrases."""

from __future__ import annotations

import pickle
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.scalars import fold, negated, text_of
from quarrystone.operators.blocks import BLOCK, hashes, in_blocks, past
from quarrystone.operators.pairs import blocked_tokens, pair_scores
from quarrystone.session import cut


def best_per_source(scores: DataFrame, most: int = 3) -> DataFrame:
    """(q, doc, id, score) of candidate rows: the best statement of each source for each sentence, then the best sources."""
    one = Window.partitionBy("q", "doc").orderBy(F.desc("score"), "id")
    top = scores.withColumn("__r", F.row_number().over(one)).filter("__r = 1").drop("__r")
    return top.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))).filter(F.col("__r") <= most).drop("__r")


def margins(sentences: DataFrame, best: DataFrame) -> DataFrame:
    """Every sentence with its best answers; one without any is kept, unanswered."""
    return sentences.select("q").join(best, "q", "left").withColumn("answered", F.col("id").isNotNull())


DEFINES = r"[\"“]([^\"”]{3,60})[\"”]\s+(?:means|shall mean|refers to|is defined as)"


def definitions(sts: DataFrame) -> DataFrame:
    """(id, doc, phrase): phrases that a statement defines, folded."""
    return sts.select("id", "doc", F.explode(F.regexp_extract_all(text_of("text"), F.lit(DEFINES), F.lit(1))).alias("p")).select("id", "doc", fold("p").alias("phrase")).distinct()


#: Defined phrases for which a filter has room, 16 bits each. With more of them it lets more through, which costs time: the result is the same.
PHRASES = 16_000_000
#: Characters of a phrase that are looked for first, and characters of texts that are looked through at once.
HEAD, AT_ONCE = 6, 1 << 18
#: Odd factors of the hashes that give a phrase's bits in the filter.
TIMES = (1, 0xBF58476D1CE4E5B9)
#: Tasks that share the texts of one phrase.
TURNS = 8


def defined_links(sts: DataFrame, at_once: int = PHRASES) -> DataFrame:
    """(definition, id, phrase): statements of other sources that hold a defined phrase, the first definition of each. Of a phrase
    only the first definition and the first of another source can be asked for. Texts stay where they are: each is looked
    through once, by a filter of bits that an executor makes, and what it lets through is held against the phrases themselves.
    Through the driver goes the filter alone, never phrases: 42 MB at most."""
    d = definitions(sts).filter("doc is not null and id is not null")
    least = d.groupBy("phrase").agg(F.min(F.struct("id", "doc")).alias("x"))
    d = d.join(least.hint("merge"), "phrase").groupBy("phrase", "x").agg(F.min(F.when(F.col("doc") != F.col("x.doc"), F.col("id"))).alias("second"))
    d = d.select("phrase", F.struct(F.col("x.doc").cast("string").alias("doc"), F.col("x.id").alias("first"), "second").alias("x"))
    d = cut(d, "phrases")
    bits = max(6, (16 * min(d.count(), at_once) - 1).bit_length())
    made = d.select("phrase").mapInPandas(phrase_slots(bits), "head int, size int, bit0 int, bit1 int").groupBy().applyInPandas(phrase_filter(bits), "filter binary").head()
    ready = sts.sparkSession.sparkContext.broadcast(bytes(made[0]) if made else b"")
    kind = dict(sts.dtypes)["id"]
    texts = sts.filter("doc is not null").select(F.col("id").cast("string").alias("id"), F.col("doc").cast("string").alias("doc"), fold("text").alias("t"))
    hit = texts.mapInPandas(phrase_finder(ready), "id string, doc string, phrase string").select("phrase", F.col("id").cast(kind).alias("id"), "doc", F.lit(True).alias("said"))
    rows = hit.withColumn("turn", F.pmod(F.hash("id"), F.lit(TURNS)))
    for turn in range(TURNS):
        rows = rows.unionByName(d.select("phrase", "x", F.lit(False).alias("said"), F.lit(turn).alias("turn")), allowMissingColumns=True)
    x = F.first("x", ignorenulls=True).over(Window.partitionBy("phrase", "turn").orderBy("said"))
    out = rows.withColumn("x", x).filter("said and (doc <> x.doc or x.second is not null)")
    return out.groupBy("id", "phrase", "turn").agg(F.min(F.when(F.col("doc") != F.col("x.doc"), F.col("x.first")).otherwise(F.col("x.second"))).alias("definition")).select("definition", "id", "phrase")


class Spans:
    """Hashes of 64 bits of any spans of texts, which stand one behind the other."""

    base, mix = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def __init__(self, texts):
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        power, back = (np.full(len(codes) + 1, x, np.uint64) for x in (self.base, pow(self.base, -1, 1 << 64)))
        power[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(self.mix) * np.cumprod(power)[:-1], out=self.sums[1:])

    def slots(self, at, size, bits: int, times: int = 1):
        """The spans of ``size`` from ``at`` on, by the upper bits of their hashes, or of an odd multiple of these."""
        return ((self.sums[at + size] - self.sums[at]) * self.back[at] * np.uint64(times)) >> np.uint64(64 - bits)


def head_bits(bits: int) -> int:
    return min(bits - 2, 20)


def phrase_slots(bits: int):
    """Where each phrase stands in the filter."""

    def run(frames):
        for f in frames:
            x = Spans(f["phrase"].tolist())
            head = x.slots(x.starts, np.minimum(x.sizes, HEAD), head_bits(bits))
            yield pd.DataFrame({"head": head.astype(np.int32), "size": x.sizes.astype(np.int32)} | {f"bit{k}": x.slots(x.starts, x.sizes, bits, times).astype(np.int32) for k, times in enumerate(TIMES)})

    return run


def phrase_filter(bits: int):
    """The filter: for the first characters of phrases, or all of shorter ones, their lengths; for whole phrases, two bits; all lengths."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        heads, whole, size = np.zeros(1 << head_bits(bits), np.uint64), np.zeros(1 << (bits - 3), np.uint8), f["size"].to_numpy()
        np.bitwise_or.at(heads, f["head"].to_numpy(), np.uint64(1) << (size % 64).astype(np.uint64))
        for w in (f["bit0"].to_numpy(), f["bit1"].to_numpy()):
            np.bitwise_or.at(whole, w >> 3, np.uint8(1) << (w & 7).astype(np.uint8))
        return pd.DataFrame({"filter": [pickle.dumps((bits, heads, whole, np.unique(size)), protocol=5)]})

    return run


def phrase_finder(ready):
    """By a broadcast filter: the phrases that texts (id, doc, t) may hold, wherever in a word they begin or end."""

    def look(texts, bits, heads, whole, sizes):
        x = Spans(texts)
        row = np.repeat(np.arange(len(texts)), x.sizes)
        end = (x.starts + x.sizes)[row]
        found, last = set(), None
        for n in sizes.tolist():
            if last != min(n, HEAD):
                last = min(n, HEAD)
                at = np.arange(max(0, len(row) - last + 1))
                lengths = heads[x.slots(at, last, head_bits(bits))]
                some = np.flatnonzero(lengths)
                lengths = lengths[some]
            at = some[(lengths >> np.uint64(n % 64)) & np.uint64(1) > 0]
            at = at[at + n <= end[at]]
            for times in TIMES:
                w = x.slots(at, n, bits, times)
                at = at[(whole[w >> np.uint64(3)] >> (w & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            for r, i in zip(row[at].tolist(), (at - x.starts[row[at]]).tolist()):
                found.add((r, texts[r][i : i + n]))
        return found

    def run(frames):
        state = pickle.loads(ready.value) if ready.value else None
        for f in frames if state else ():
            rows, own, pieces, size = set(), [], [], 0
            texts = f["t"].tolist()
            for r, t in enumerate(texts):
                for at in range(0, len(t), AT_ONCE):  # pieces of a long text overlap by the longest phrase
                    own.append(r)
                    pieces.append(t[at : at + AT_ONCE + int(state[-1][-1]) - 1])
                    size += len(pieces[-1])
                    if size >= AT_ONCE:
                        rows |= {(own[k], p) for k, p in look(pieces, *state)}
                        own, pieces, size = [], [], 0
            rows |= {(own[k], p) for k, p in look(pieces, *state)}
            r = np.array([r for r, _ in rows], np.int64)
            yield pd.DataFrame({"id": f["id"].to_numpy()[r], "doc": f["doc"].to_numpy()[r], "phrase": pd.Series([p for _, p in rows], dtype=object)})

    return run


def polarity_links(sts: DataFrame, tokens: DataFrame, most: int = 3, null: bool = False) -> DataFrame:
    """(denial, id, doc, score): statements of other sources closest to one that denies, where only one of the two does; with ``null``
    only those whose score exceeds what random bags of their sizes reach."""
    from quarrystone.operators.nulls import beats_floor

    neg = sts.select("id", negated("text").alias("n"))
    s = pair_scores(blocked_tokens(tokens))
    s = beats_floor(s, tokens) if null else s
    j = s.join(neg.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(neg.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b").filter("na <> nb")
    x = j.select(F.when(F.col("na"), F.col("a")).otherwise(F.col("b")).alias("denial"), F.when(F.col("na"), F.col("b")).otherwise(F.col("a")).alias("id"), F.when(F.col("na"), F.col("doc_b")).otherwise(F.col("doc_a")).alias("doc"), "score")
    w = Window.partitionBy("denial", "doc").orderBy(F.round("score", 6).desc(), "id")
    return x.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).select("denial", "id", "doc", "score")


def named_cells(cells: DataFrame, names: DataFrame) -> DataFrame:
    """Table cells (id, value) that are a known name, folded and trimmed."""
    n = names.select(F.trim(fold("name")).alias("k"), F.col("name")).groupBy("k").agg(F.min("name").alias("name"))
    return cells.withColumn("k", F.trim(fold("value"))).filter("k <> ''").join(n, "k").select("id", "value", "name")


def bind_candidates(ground: DataFrame, cands: DataFrame) -> DataFrame:
    """(id, cand, shared, attacks, verdict): a candidate is bound if nothing speaks against it (its window of years, its kind) and
    two words speak for it, one of them rare, or one of much weight. ground (id, words, kind, year), cands (cand, id, words,
    kind, since, until), weights are idf within the candidates."""
    n = cands.select("cand").distinct().agg(F.count("*").alias("n"))
    df = cands.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    weight = df.crossJoin(F.broadcast(n)).select("w", F.log2((F.col("n") + 1) / F.col("df")).alias("weight"))
    j = ground.join(cands.withColumnRenamed("words", "cwords").withColumnRenamed("kind", "ckind"), "id")
    for_ = j.select("id", "cand", F.explode(F.array_intersect("words", "cwords")).alias("w")).join(weight, "w").groupBy("id", "cand").agg(F.count("*").alias("shared"), F.max("weight").alias("top"))
    attack = F.array_compact(F.array(
        F.when((F.col("year") < F.col("since")) | (F.col("year") > F.col("until")), "window"),
        F.when(F.col("kind").isNotNull() & F.col("ckind").isNotNull() & (F.col("kind") != F.col("ckind")), "kind"),
    ))
    x = j.join(for_, ["id", "cand"], "left").withColumn("attacks", attack)
    shared, top = F.coalesce("shared", F.lit(0)), F.coalesce("top", F.lit(0.0))
    support = ((shared >= 2) & (top >= 1)) | (top >= 4)
    return x.select("id", "cand", shared.alias("shared"), "attacks", F.when(F.size("attacks") > 0, "refused").when(support, "bound").otherwise("open").alias("verdict"))


STAMP = r"(?i)\b(confidential|draft|copy|approved|received|filed|page|exhibit|original|void|sample)\b"


def ignore_rules(pages: DataFrame) -> DataFrame:
    """(doc, line, n) of short lines that stand on max(3, half) of a document's pages or more and look like stamps: all capitals,
    or with a stamp's word. pages (doc, page, text)."""
    n = pages.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    l = pages.select("doc", "page", F.explode(F.split(text_of("text"), "\n")).alias("x")).select("doc", "page", F.trim("x").alias("line")).distinct()
    short = (F.length("line").between(3, 60)) & (F.size(F.split("line", r"\s+")) <= 6)
    stamp = F.col("line").rlike(STAMP) | ((F.upper("line") == F.col("line")) & F.col("line").rlike("[A-Z]"))
    c = l.filter(short & stamp).groupBy("doc", "line").agg(F.count("*").alias("n"))
    return c.join(n, "doc").filter(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") / 2))).select("doc", "line", "n")


def blank_lines(text: Column, lines: Column) -> Column:
    """The text with the given lines as blanks of the same length, so that every offset still holds."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda l: F.when(F.array_contains(F.coalesce(lines, F.array().cast("array<string>")), F.trim(l)), F.rpad(F.lit(""), F.length(l), " ")).otherwise(l)), "\n")


def structure_share(text: Column) -> Column:
    """The share of a text's characters that structure it: digits, signs and line ends."""
    t = text_of(text)
    return F.when(F.length(t) == 0, 0.0).otherwise(F.try_divide(F.length(F.regexp_replace(t, r"[\p{L}\s&&[^\n]]", "")), F.length(t)))


def prose_test(texts: DataFrame, peers: DataFrame, peers_n: int = 199, seed: int = 13) -> DataFrame:
    """texts (id, text) with record: whether the structuring share exceeds every one of 199 peers' (drawn by hash)."""
    from quarrystone.functions.scalars import draw

    top = peers.select("id", structure_share("text").alias("s")).orderBy(draw(F.lit(seed), "id"), "id").limit(peers_n).agg(F.max("s").alias("bar"))
    return texts.select("id", structure_share("text").alias("share")).crossJoin(F.broadcast(top)).select("id", "share", (F.col("share") > F.col("bar")).alias("record"))


def drive_rows(df: DataFrame, query: str, type_: str | None, sort: str) -> tuple[DataFrame, DataFrame]:
    """(rows, chips): entries (id, name, type, modified, size, people) by tokens of a query and type, in one of six orders with
    the id to break ties; chips count types before the type is chosen."""
    hit = F.lit(True)
    for w in re.findall(r"\w+", query.lower()):
        hit = hit & F.contains(F.lower(text_of("name")), F.lit(w))
    found = df.filter(hit)
    chips = found.groupBy("type").agg(F.count("*").alias("n"))
    order = {"recent": F.desc("modified"), "oldest": F.asc("modified"), "name": F.lower("name"), "name desc": F.lower("name").desc(), "size": F.desc("size"), "people": F.desc("people")}[sort]
    return (found if type_ is None else found.filter(F.col("type") == type_)).orderBy(order, "id"), chips


def conclusions(claims: DataFrame) -> DataFrame:
    """(doc, names, frames, stance): the five names and three frames most said, and the sign of the stances' sum, of claims
    (doc, name, frame, stance)."""
    def top(c: str, k: int):
        n = claims.filter(F.col(c).isNotNull()).groupBy("doc", c).agg(F.count("*").alias("n"))
        r = n.withColumn("__r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), c))).filter(F.col("__r") <= k)
        return r.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", c))), lambda x: x[c]), "|").alias(f"{c}s"))

    s = claims.groupBy("doc").agg(F.signum(F.coalesce(F.sum("stance"), F.lit(0.0))).cast("int").alias("stance"))
    return s.join(top("name", 5), "doc", "left").join(top("frame", 3), "doc", "left")


def departure_depth(claims: DataFrame) -> DataFrame:
    """(doc, depth): the shortest prefix (seq) of a document's claims (doc, seq, name) whose most said name is no longer what it
    was after the first; null if it never changes."""
    w = Window.partitionBy("doc").orderBy("seq")
    x = claims.withColumn("__c", F.count("*").over(Window.partitionBy("doc", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__top", F.max(F.struct(F.col("__c"), (-F.col("seq")).alias("o"), "name")).over(w.rowsBetween(Window.unboundedPreceding, 0))["name"]).withColumn("__first", F.first("name").over(w))
    return x.groupBy("doc").agg(F.min(F.when(F.col("__top") != F.col("__first"), F.col("seq"))).alias("depth"))


def section_lexicon(headings: DataFrame) -> DataFrame:
    """(norm, docs, surfaces): headings (doc, heading) by their normal form, in how many documents, and how they are written."""
    norm = F.trim(F.regexp_replace(fold("heading"), r"[^a-z ]+", " "))
    return headings.select("doc", "heading", F.regexp_replace(norm, r"\s+", " ").alias("norm")).filter("norm <> ''").groupBy("norm").agg(F.count_distinct("doc").alias("docs"), F.array_join(F.array_sort(F.collect_set("heading")), "|").alias("surfaces"))


def structure_bigrams(units: DataFrame) -> DataFrame:
    """(name, next, n): which unit follows which, of units (doc, seq, name)."""
    x = units.withColumn("next", F.lead("name").over(Window.partitionBy("doc").orderBy("seq")))
    return x.filter("next is not null").groupBy("name", "next").agg(F.count("*").alias("n"))


def witness_verdict(shape: Column, rarity: Column, context: Column, together: Column) -> Column:
    """What several witnesses say of two spellings: the edit is a plausible slip, one is rare beside the other, their contexts are
    alike, and (against) both stand in one document. likely, contested, doubtful or open."""
    for_ = shape.cast("int") + rarity.cast("int") + context.cast("int")
    return F.when((for_ >= 2) & ~together, "likely").when((for_ >= 2) & together, "contested").when(together, "doubtful").otherwise("open")


def page_choice(pages: DataFrame, prefer: str, margin: float = 0.15) -> DataFrame:
    """(page, eye, text): of several readings of a page the one with most text, unless the preferred eye's is within the margin."""
    n = F.length(F.regexp_replace(text_of("text"), r"\s", ""))
    x = pages.withColumn("__n", n * F.when(F.col("eye") == prefer, 1 + margin).otherwise(1.0))
    return x.withColumn("__r", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("__n"), "eye"))).filter("__r = 1").select("page", "eye", "text")


def amount_readings(text: str | None) -> list[tuple[str, float, int, int]]:
    """(reading, value, s, e): the ways an amount can be meant: as it stands, per each with its count, or as a total of parts."""
    out = []
    t = text or ""
    for m in re.finditer(r"\$\s?(\d[\d,]*(?:\.\d+)?)(?:\s*(million|billion|thousand))?", t):
        v = float(m[1].replace(",", "")) * {"million": 1e6, "billion": 1e9, "thousand": 1e3}.get(m[2] or "", 1)
        out.append(("stated", v, m.start(), m.end()))
        if re.match(r"\s*(?:each|per|apiece)\b", t[m.end() : m.end() + 12]) and (q := re.search(r"(\d[\d,]*)\s+(?:\w+\s+){0,2}(?:at|@|for)?\s*$", t[max(0, m.start() - 40) : m.start()])):
            out.append(("total", v * float(q[1].replace(",", "")), m.start(), m.end()))
    return out


def phrase_places(words: DataFrame, phrase: list[str]) -> DataFrame:
    """(doc, page, seq): where a phrase begins among words (doc, page, seq, word): one ordered pass."""
    w = Window.partitionBy("doc", "page").orderBy("seq")
    c = F.lit(True)
    for i, p in enumerate(phrase):
        c = c & (F.lower(F.lead("word", i).over(w) if i else F.col("word")) == p.lower())
    return words.withColumn("__h", c).filter("__h").select("doc", "page", "seq")


def activation(passages: DataFrame, question: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """(passage, hops): passages (passage, referent) that mention a question's referents (0) or their neighbours (1), without
    those seen."""
    near = edges.join(question.select(F.col("referent").alias("src")), "src", "left_semi").select(F.col("dst").alias("referent")).distinct().join(question, "referent", "left_anti").withColumn("hops", F.lit(1))
    r = question.select("referent").distinct().withColumn("hops", F.lit(0)).unionByName(near)
    return passages.join(r, "referent").groupBy("passage").agg(F.min("hops").alias("hops")).join(seen.select("passage"), "passage", "left_anti")


def answer_status(evidence: DataFrame) -> DataFrame:
    """(question, status): of evidence (question, value, doc, refuted): void, contested, refuted, single or supported."""
    g = evidence.groupBy("question").agg(F.count("doc").alias("n"), F.count_distinct("value").alias("v"), F.count_distinct("doc").alias("d"), F.bool_or(F.coalesce("refuted", F.lit(False))).alias("r"), F.bool_and(F.coalesce("refuted", F.lit(False))).alias("all"))
    return g.select("question", F.when(F.col("n") == 0, "void").when(F.col("all"), "refuted").when((F.col("v") > 1) | F.col("r"), "contested").when(F.col("d") < 2, "single").otherwise("supported").alias("status"))


def corpus_map(mentions: DataFrame, level: int = 2) -> DataFrame:
    """(a, b, weight) between names of ``level`` sources or more that stand in one statement: 4 per source and 1 per statement.
    mentions (doc, stmt, name)."""
    ok = mentions.groupBy("name").agg(F.count_distinct("doc").alias("k")).filter(F.col("k") >= level).select("name")
    m = mentions.join(ok, "name", "left_semi").distinct()
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, ["doc", "stmt"]).filter("a.name < b.name").groupBy(F.col("a.name").alias("a"), F.col("b.name").alias("b")).agg((4 * F.count_distinct("doc") + F.count("*")).alias("weight"))


def admit_types(scores: np.ndarray, cuts: list[int], draws: int = 1000, seed: int = 1) -> float | None:
    """The share of random placements of as many cuts whose mean score reaches that at the cuts; null under 20 places."""
    if len(scores) < 20 or not cuts:
        return None
    rng = np.random.default_rng(seed)
    got = scores[cuts].mean()
    hits = sum(scores[rng.choice(len(scores), len(cuts), replace=False)].mean() >= got for _ in range(draws))
    return (1 + hits) / (1 + draws)


def fixed_point(vectors: np.ndarray, start: list[int], bar: float, rounds: int = 10) -> list[int]:
    """Members licensed by their likeness to the centroid, until the set no longer changes."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    now = sorted(start)
    for _ in range(rounds):
        c = unit[now].mean(0)
        nxt = [int(i) for i in np.nonzero(unit @ (c / max(np.linalg.norm(c), 1e-12)) >= bar)[0]]
        if nxt == now or not nxt:
            return now
        now = nxt
    return now


def token_spans(text: str | None) -> list[tuple[str, str, int, int]]:
    """(token, class, s, e): words, numbers, punctuation and signs by their Unicode class; every other character is a blank."""
    import unicodedata

    out = []
    for m in re.finditer(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,]\d+)*|[^\w\s]|_", text or ""):
        c = unicodedata.category(m[0][0])
        out.append((m[0], {"L": "word", "N": "number", "P": "punctuation"}.get(c[0], "sign"), m.start(), m.end()))
    return out


def moods(text: str | None) -> list[tuple[str, int, int]]:
    """(mood, s, e) of sentences: asks, exclaims, trails or states; and spans in brackets and quotation marks as contained."""
    from quarrystone.operators.alignment import statement_spans

    out = []
    for s, e in statement_spans(text):
        x = text[s:e].rstrip("\"'”’)]")
        out.append(("asks" if x.endswith("?") else "exclaims" if x.endswith("!") else "trails" if x.endswith(("...", "…")) else "states", s, e))
    out += [("contained", m.start(), m.end()) for m in re.finditer(r"\([^()\n]*\)|“[^”\n]*”|\"[^\"\n]*\"", text or "")]
    return out


def plural(word: str, n: int) -> str:
    """An English noun for n things, by the regular endings."""
    if n == 1:
        return word
    if re.search(r"(?:s|x|z|ch|sh)$", word):
        return word + "es"
    return word[:-1] + "ies" if re.search(r"[^aeiou]y$", word) else word + "s"


def parse_clip(text: str | None) -> dict:
    """A sentence about a clip: {video, start, end, name}: 'abcdefghijk from 1:05 to 2:10 as intro'."""
    t = text or ""
    v = re.search(r"(?:v=|youtu\.be/|\b)([\w-]{11})\b", t)
    at = re.search(r"(?:from\s+)?((?:\d+:)?\d{1,2}:\d{2}(?:\.\d+)?)\s*(?:-|–|to|until)\s*((?:\d+:)?\d{1,2}:\d{2}(?:\.\d+)?)", t)
    name = re.search(r"\b(?:as|called|named)\s+[\"“]?([^\"”\n]+?)[\"”]?\s*$", t)

    def sec(x: str) -> float:
        n = 0.0
        for p in x.split(":"):
            n = n * 60 + float(p)
        return n

    return {"video": v[1] if v else None, "start": sec(at[1]) if at else None, "end": sec(at[2]) if at else None, "name": name[1].strip() if name else None}


def form_alignment(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> list[tuple[str, str, float]]:
    """(label of a, label of b, weight): the fields of two forms paired greedily by the likeness of their labels' letter pairs."""
    grams = lambda s: {s.lower()[i : i + 2] for i in range(len(s) - 1)}
    dice = lambda x, y: 2 * len(grams(x) & grams(y)) / max(1, len(grams(x)) + len(grams(y)))
    pairs = sorted(((dice(x, y), i, j) for i, (x, _) in enumerate(a) for j, (y, _) in enumerate(b)), key=lambda p: (-p[0], p[1], p[2]))
    used_a, used_b, out = set(), set(), []
    for w, i, j in pairs:
        if w >= 0.5 and i not in used_a and j not in used_b:
            used_a.add(i), used_b.add(j)
            out.append((a[i][0], b[j][0], round(w, 4)))
    return out


def register_sniff(df: DataFrame, key: str, text: str, prior: DataFrame, least: int = 60) -> DataFrame:
    """(key, register, p, thin): the kind of writing by vocabulary: squared shares of a prior (genre, word, weight) over the words
    of a text, normalised; thin where the first leads by under 0.1; texts of fewer than 60 words are left out."""
    w = df.select(key, F.explode(F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"[\p{L}]{3,}"), F.lit(0))).alias("word"))
    n = w.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    s = w.join(prior, "word").groupBy(key, "genre").agg(F.sum("weight").alias("s")).join(n, key).select(key, "genre", F.pow(F.col("s") / F.col("n"), 2).alias("a"))
    p = s.withColumn("p", F.try_divide(F.col("a"), F.sum("a").over(Window.partitionBy(key))))
    r = p.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "genre"))).withColumn("__n", F.lead("p").over(Window.partitionBy(key).orderBy(F.desc("p"), "genre")))
    return r.filter("__r = 1").select(key, F.col("genre").alias("register"), F.round("p", 6).alias("p"), (F.col("p") - F.coalesce("__n", F.lit(0.0)) < 0.1).alias("thin"))


def worth(claims: DataFrame) -> DataFrame:
    """claims (id, excess, figures, centrality, resolver) with their worth to a summary."""
    v = 0.55 * F.col("excess") / (1 + F.col("figures")) + 0.30 * F.log2(1 + F.col("centrality")) + 0.15 * F.least(F.lit(2.0), F.col("resolver").cast("double"))
    return claims.withColumn("worth", v)


def attest(prior: DataFrame, sts: DataFrame, least: float = 0.5) -> DataFrame:
    """(prior, id, coverage): the statement that covers most of a prior's terms, if half or more; prior (prior, term), sts (id, term)."""
    of = lambda df, key: df.groupBy(key).agg(F.collect_set("term").alias("terms"))
    return attest_sets(of(prior, "prior"), of(sts, "id"), least)


def attest_sets(prior: DataFrame, sts: DataFrame, least: float = 0.5, block: int = 4 * BLOCK) -> DataFrame:
    """The same of (prior, terms) and (id, terms), one row a key. Statements are blocks of bits a term, which priors run past: no pair of
    a prior and a statement is ever written, and of each block only the best statement leaves a task."""
    rows = cut(sts.select("id", F.lit(None).cast("string").alias("doc"), hashes("terms").alias("cs")).filter(F.size("cs") > 0), "statements")
    p = cut(prior.select("prior", hashes("terms").alias("cs")).filter(F.size("cs") > 0), "priors").repartition("prior")
    kinds = dict(prior.dtypes) | dict(sts.dtypes)

    def best(b, frames):
        bits: dict = {}
        words = -(-len(b.ids) // 64)

        def places(k):
            got = bits.get(k)
            if got is None:
                if len(bits) * words > 8_000_000:
                    bits.clear()
                z = np.zeros(64 * words, np.uint8)
                z[b.postings(k)] = 1
                got = bits[k] = np.packbits(z, bitorder="little").view("<u8")
            return got

        for f in frames:
            out = []
            for who, cs in zip(f["prior"], f["cs"]):
                planes: list[np.ndarray] = []  # how many of the terms each statement holds, as bits of that number
                for k in b.places(cs)[0]:
                    carry = places(k)
                    for i, x in enumerate(planes):
                        planes[i], carry = x ^ carry, x & carry
                    if carry.any():
                        planes.append(carry)
                most, top = 0, None
                for i in reversed(range(len(planes))):
                    x = planes[i] if top is None else top & planes[i]
                    if x.any():
                        most, top = most | 1 << i, x
                if top is not None and most / len(cs) >= least:
                    w = int((top != 0).argmax())
                    v = int(top[w])
                    out.append((who, b.ids[64 * w + (v & -v).bit_length() - 1], most / len(cs)))
            yield pd.DataFrame(out, columns=["prior", "id", "coverage"])

    got = past(p, in_blocks(rows, "id", block), best, f"prior {kinds['prior']}, id {kinds['id']}, coverage double")
    return got.withColumn("__r", F.row_number().over(Window.partitionBy("prior").orderBy(F.desc("coverage"), "id"))).filter("__r = 1").select("prior", "id", "coverage")


def over_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, class, s, e)."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(k, *x) for k, t in zip(f["k"], f["t"]) for x in token_spans(t)], columns=["k", "token", "class", "s", "e"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {dict(df.dtypes)[key]}, token string, class string, s int, e int").withColumnRenamed("k", key)


def referent_of(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, key): the referent a value (id, text) is about: of the vocabulary's terms (term, key, priority) that its text holds
    the one of least priority number; ties to the smaller key. The vocabulary comes from a question and its synonyms, so it is
    joined on words, not broadcast by hint."""
    w = values.select("id", F.explode(F.array_distinct(F.regexp_extract_all(fold("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("term"))
    return w.join(vocabulary, "term").groupBy("id").agg(F.min(F.struct("priority", "key"))["key"].alias("key"))


def findings(pairs: DataFrame) -> DataFrame:
    """pairs with a finding: what two statements come to by their verdict, their polarity and the terms they share."""
    f = (
        F.when(F.col("verdict") == "differs", "differs")
        .when(F.col("neg_a") != F.col("neg_b"), "one denies")
        .when(F.col("verdict") == "same", "says the same")
        .when(F.size("shared") >= 2, F.concat(F.lit("both on "), F.array_join(F.slice(F.array_sort("shared"), 1, 4), ", ")))
        .otherwise("apart")
    )
    return pairs.withColumn("finding", f)


def gist_by_genre(degrees: DataFrame, prior: DataFrame, most: int) -> DataFrame:
    """(doc, name, degree): a source's names by degree without those its genre is full of anyway. degrees (doc, genre, name,
    degree), prior (genre, name)."""
    own = degrees.join(prior.select("genre", "name").distinct(), ["genre", "name"], "left_anti")
    w = Window.partitionBy("doc").orderBy(F.desc("degree"), "name")
    return own.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).select("doc", "name", "degree")


def code_length(tokens: list[str], counts: dict | None = None) -> float:
    """Bits an adaptive code needs for tokens, after what counts have seen."""
    seen = dict(counts or {})
    total, kinds, bits = sum(seen.values()), len(seen), 0.0
    for t in tokens:
        bits -= float(np.log2((seen.get(t, 0) + 1) / (total + kinds + 1)))
        kinds += t not in seen
        seen[t] = seen.get(t, 0) + 1
        total += 1
    return bits


def structure_gain(tokens: list[str], cuts: list[int], draws: int = 40, seed: int = 1) -> list[tuple[int, float, bool]]:
    """(cut, bits, clears): the bits that a fresh start at each cut saves, and whether more than at any random place."""

    def gain(c: int) -> float:
        left, right = tokens[:c], tokens[c:]
        counts: dict = {}
        for t in left:
            counts[t] = counts.get(t, 0) + 1
        return code_length(right, counts) - code_length(right)

    if len(tokens) < 4:
        return [(c, 0.0, False) for c in cuts]
    rng = np.random.default_rng(seed)
    others = [gain(int(c)) for c in rng.integers(1, len(tokens), draws) if int(c) not in set(cuts)]
    return [(c, gain(c), bool(gain(c) > max(others, default=0.0))) for c in cuts]
