"""Variant spellings of names typed by people.

A value is read into its words (legal forms and articles dropped, trades by their usual names), its number and its kind (body,
person, or undecided). Values of the same words are one reading. A symmetric-delete index over the distinct words finds small
edit distances: two words are neighbours if they share a string reached by deleting a character or two from each. Readings
that share two such words, or one and the beginning or the outline of another, are candidates; each two are aligned by
optimal assignment of all their words, where an initial may stand for a name, a short form for its name, and a word cut
short or with letters left out for its full form; a trade or a middle initial may be missing. Numbers must agree.

What is only misspelt is joined at once. A reading that leaves something out or shortens a word joins the group it fits best,
and only if there is just one such group: "K. Amblobridge" stays by itself between a Kenneth and a Karen.

Nulls, empties and placeholders for no or many parties are left out. Values are compared as stored, case and blanks included.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.graph import components
from quarrystone.session import cut

# Trades with the ways they are shortened; any word of a line stands for its first.
TRADES = """
architects architect archt archts arch archs architecture
associates associate assoc assocs assn
construction construct constr const constrn cons contracting
consulting consultants consult conslt consltg consltng consulting cnsltg
electric electrical elec elect
engineering engineers eng engr engrg engnrg engineer
environmental environment env envtl environ enviro
equipment equip eqpt eqp equipt
international intl internat internatl int
landscaping landscape lndscpg landsc lndscp landscpg
management mgmt mgt mngmt manag
manufacturing mfg manufact manufg mfr mfrs
mechanical mech mechan mechl
paving pvg pav pavg
services service svcs svc serv servs srvcs
supply sply sup suppl supplies
technologies technology tech techs technol
transportation transp trans transport transpn
development dev devel devt
industries industry ind inds
solutions solution soln solns
systems system sys syst
properties property prop props
utility util utilities utl
"""
TRADE = {w: line.split()[0] for line in TRADES.strip().splitlines() for w in line.split()}
# Legal forms, articles and joining words, none of which tell bodies apart.
FORMS = set("llc pllc lp llp inc incorporated corp corporation co company ltd limited plc pc liability partnership pllp na the and of branch office".split())
BODIES = {"utility", "fire", "drainage", "water", "sewer", "school", "sanitary", "park", "library", "hospital", "levee", "irrigation"}
DISTRICT = {"district", "dist", "distr", "authority", "auth"}
# Short forms of given names.
SHORT_FORMS = """
abigail abby gail
alexander alex sandy xander
andrew andy drew
anthony tony
barbara barb babs
benjamin ben benny
catherine cathy cate
charles charlie chuck chas
christopher chris kit
daniel dan danny
david dave davey
deborah deb debbie
dorothy dot dottie dolly
edward ed eddie ted ned
elizabeth liz beth betty eliza lizzie betsy
frances fran frannie frankie francie
francis frank
gerald gerry jerry
gregory greg
harold hal harry
henry hank harry
henry hank
isabella bella izzy isa
jacob jake
james jim jimmy jamie
jennifer jen jenny
john jack johnny
jonathan jon
joseph joe joey
joshua josh
katherine kate kathy katie kay kitty
kenneth ken kenny
lawrence larry laurie
margaret peggy maggie meg
matthew matt
michael mike mick mickey
nathaniel nate nat nathan
nicholas nick nicky
oliver ollie
ophelia phila phelia
patricia pat patty trish
patrick paddy
peter pete
philip phil
quentin quent
raymond ray
rebecca becky
richard rick dick rich richie
robert bob rob bobby robbie bert
ronald ron ronnie
samantha sam
samuel sammy
stephen steve
susan sue susie suzy
theodore theo teddy ted
thomas tom tommy
timothy tim timmy
ulysses lys uly
victoria vicky vicki tori
vincent vince vinnie
virginia ginny
walter walt wally
william will bill billy willy
yolanda yoli yola
zachary zach zack zak
"""
#: A short form may stand for several names; the first listed is what it means where nothing else tells.
GIVEN: dict[str, list[str]] = {}
for _line in SHORT_FORMS.strip().splitlines():
    for _w in _line.split():
        GIVEN.setdefault(_w, []).append(_line.split()[0])
PLACEHOLDERS = set("na n/a none null tbd tba unknown multiple various see attached varies misc test not applicable multiple vendors various vendors pending blank nil to be determined see list see exhibit".split()) | {
    "various vendors", "multiple vendors", "multiple parties", "various parties", "see attached", "see attachment", "see list", "see exhibit", "see contract", "not applicable", "to be determined", "to be announced", "no vendor", "not available", "various", "multiple", "several", "same as above", "as attached", "not stated", "not specified", "no party", "none listed", "not listed", "all vendors", "see below", "see file", "see description",
}
NOISE = re.compile(r"\((?:[^()]*\b(?:office|branch|division|div|region|location|site)\b[^()]*)\)|,\s*[\w .'’-]+\s+(?:branch|office|division)\s*$|\s+[-–]\s+[A-Z][\w'’]+\s*$|\b(?:d/?b/?a|attn|c/o)\b.*$", re.I)
DOTTED = re.compile(r"\b(?:[A-Za-z]\.){2,}(?:[A-Za-z]\b)?")
NUMBER = re.compile(r"(?:#|\bno\b\.?|\bnum(?:ber)?\b\.?|\bnr\b\.?)?\s*#?\s*(\d+)\b", re.I)


def clean(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("’", "'")


def read(value: str | None) -> dict | None:
    """What a value says; None for no or many parties."""
    if not value or not value.strip():
        return None
    flat = re.sub(r"\s+", " ", clean(value)).strip()
    bare = re.sub(r"[^a-z/ ]", "", flat.lower()).strip()
    if not re.search(r"[a-z]", bare) or bare in PLACEHOLDERS or re.sub(r"[/ ]", "", bare) in PLACEHOLDERS:
        return None
    if re.match(r"(?i)(?:various|multiple|several)\b", bare) and len(bare.split()) <= 3:
        return None
    flat = NOISE.sub("", flat).strip()
    flat = DOTTED.sub(lambda m: m[0].replace(".", "") if len(m[0].replace(".", "")) > 2 or m[0].replace(".", "").lower() in ("lp", "pc", "co", "na") else m[0].replace(".", ". "), flat)
    flat = re.sub(r"(?i)\bint'l\b", "intl", flat)
    flat = re.sub(r"(?i)\b([a-z]+)'([a-z])\b", r"\1\2", flat)
    number = ""
    if m := NUMBER.search(flat):
        number, flat = m[1].lstrip("0") or "0", flat[: m.start()] + " " + flat[m.end() :]
    comma = [re.findall(r"[a-z]+", p.lower()) for p in flat.split(",")]
    joined = bool(re.search(r"[&/]|\band\b|[A-Za-z]-[A-Za-z]", flat, re.I))
    words = [w for p in comma for w in p]
    district = any(w in DISTRICT for w in words)
    trades, own, form = [], [], False
    for w in words:
        if w in FORMS and w not in ("na", "of"):
            form |= w not in ("the", "and", "of")
        elif district and (w in DISTRICT or TRADE.get(w, w) in BODIES):
            trades.append("district" if w in DISTRICT else TRADE.get(w, w))
        elif w in TRADE and len(w) > 2:
            trades.append(TRADE[w])
        elif len(w) > 6 and (t := near_word(w, TRADE_DELETES)):
            trades.append(TRADE[t])
        else:
            own.append(w)
    if not own:
        own, trades = words, []
    return {"own": own, "trades": sorted(set(trades)), "form": form, "number": number, "joined": joined, "comma": len(comma) > 1 and len(comma[1]) > 0, "comma_at": len(comma[0])}


def osa(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            row.append(c)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def deletes(word: str, depth: int = 1) -> set[str]:
    out, edge = {word}, {word}
    for _ in range(depth):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w)) if len(w) > 2}
        out |= edge
    return out


def optimal(d: list[list[float]]) -> list[int]:
    """The column of each row in a cheapest assignment of a square matrix: shortest augmenting paths, row by row."""
    n = len(d)
    u, v, row = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row[0], j = i, 0
        least, way, used = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while row[j]:
            used[j] = True
            for k in range(1, n + 1):
                if not used[k] and (c := d[row[j] - 1][k - 1] - u[row[j]] - v[k]) < least[k]:
                    least[k], way[k] = c, j
            to = min((k for k in range(1, n + 1) if not used[k]), key=least.__getitem__)
            step = least[to]
            for k in range(n + 1):
                if used[k]:
                    u[row[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = to
        while j:
            row[j], j = row[way[j]], way[j]
    out = [0] * n
    for k in range(1, n + 1):
        out[row[k] - 1] = k - 1
    return out


def near_word(word: str, index: dict[str, set[str]]) -> str | None:
    """The only word of the index within one edit, if there is just one."""
    got = {v for k in deletes(word) for v in index.get(k, ()) if osa(word, v, 1) <= 1}
    return got.pop() if len(got) == 1 else None


def delete_index(words) -> dict[str, set[str]]:
    out: dict[str, set[str]] = defaultdict(set)
    for w in words:
        for k in deletes(w):
            out[k].add(w)
    return out


TRADE_DELETES = delete_index(w for w in TRADE if len(w) > 6)
GIVEN_DELETES = delete_index(w for w in GIVEN if len(w) > 4)


def given_of(word: str) -> str | None:
    return word if word in GIVEN else near_word(word, GIVEN_DELETES) if len(word) > 4 else None


def person(x: dict) -> tuple[str, list[str]] | None:
    """(surname, given parts) if the value reads as a person's name: initials are single letters, the rest known names."""
    own = x["own"]
    if x["trades"] or x["form"] or x["number"] or x["joined"] or not 2 <= len(own) <= 4:
        return None
    parts = [w if len(w) == 1 else given_of(w) for w in own]
    if x["comma"] and x["comma_at"] == 1 and parts[1]:
        return own[0], [p for p in parts[1:] if p]
    if parts[0] and len(own[-1]) > 2:
        return own[-1], [p for p in parts[:-1] if p]
    if all(parts[1:]) and len(own[0]) > 2:
        return own[0], parts[1:]
    return None


#: What aligned words cost: a short form, an initial or abbreviation, something left out, an edit; more than MOST is no variant.
NICK, SHORT, LEFT_OUT, MIDDLE, MOST = 0.4, 0.5, 0.6, 0.2, 3.0
NEVER = 99.0


def abbreviates(a: str, b: str) -> bool:
    """Whether the shorter word is the other cut short, or its outline: first and last letter and some between, in order."""
    a, b = sorted((a, b), key=len)
    if len(a) < 2 or len(b) - len(a) < 2 or a[0] != b[0]:
        return False
    if len(a) > 2 and b.startswith(a):
        return True
    rest = iter(b)
    return all(c in rest for c in a) and (a[-1] == b[-1] or not set(a[1:]) & set("aeiouy"))


def word_cost(a: str, b: str) -> float:
    """What it costs that two words stand for each other; trades begin with a star."""
    if a == b:
        return 0.0
    trade = (a[0] == "*") + (b[0] == "*")
    if trade == 2:
        return NEVER
    x, y = a.lstrip("*"), b.lstrip("*")
    if len(x) == 1 or len(y) == 1:
        return SHORT if not trade and any(p[0] == q[0] for p in GIVEN.get(x, [x]) for q in GIVEN.get(y, [y])) else NEVER
    if not trade and set(GIVEN.get(x, [x])) & set(GIVEN.get(y, [y])):
        return NICK
    if x in GIVEN and y in GIVEN:
        return NEVER  # both are names of their own
    if min(len(x), len(y)) > 3 and (d := osa(x, y, 2)) <= (2 if min(len(x), len(y)) > 7 else 1):
        return float(d)
    return SHORT if abbreviates(x, y) else NEVER


def align(a: list[str], b: list[str]) -> tuple[float, bool] | None:
    """(cost, whether something is shortened or left out) of the optimal assignment of the words of two values, or None if they
    don't stand for the same. At least one own word must be there on both sides, and most of the shorter side."""
    if len(a) > len(b):
        a, b = b, a
    no_trade = [not any(w[0] == "*" for w in x) for x in (a, b)]

    def alone(w: str, other: int) -> float:
        return MIDDLE if len(w) == 1 else LEFT_OUT if w[0] == "*" and no_trade[other] else NEVER

    d = [[min(word_cost(x, y), alone(x, 1) + alone(y, 0)) for y in b] for x in a]
    d += [[alone(y, 0) for y in b] for _ in range(len(b) - len(a))]
    to = optimal(d)
    total = sum(d[i][j] for i, j in enumerate(to))
    if total > MOST:
        return None
    loose, own, met = False, 0, 0
    for i, x in enumerate(a):
        y = b[to[i]]
        c = word_cost(x, y)
        if c >= NEVER or c > d[i][to[i]]:
            loose |= x[0] == "*" or y[0] == "*"
            continue
        met += 1
        own += x[0] != "*" and y[0] != "*" and min(len(x), len(y)) > 2 and c not in (SHORT, NICK)
        loose |= c in (SHORT, NICK)
    loose |= any(b[j][0] == "*" for j in to[len(a) :])
    singles = sum(len(w) == 1 for w in a + b)
    if not own or met < min(2, len([w for w in b if w[0] != "*"])) or singles and met < 2:
        return None
    return total, loose


def readings(df: DataFrame, party: str) -> DataFrame:
    """(value, reading, words, number, kind): one row per distinct value that names one party. kind: b a body, p a person, u either."""

    def run(frames):
        for f in frames:
            rows = []
            for v in f["value"]:
                x = read(v)
                if not x:
                    continue
                body = x["trades"] or x["form"] or x["number"] or x["joined"]
                kind = "b" if body else "p" if person(x) else "u"
                words = sorted(x["own"]) + ["*" + t for t in x["trades"]]
                rows.append((v, " ".join([kind, x["number"], *words]), words, x["number"], kind))
            yield pd.DataFrame(rows, columns=["value", "reading", "words", "number", "kind"])

    values = df.select(F.col(party).alias("value")).filter(F.trim("value") != "").distinct()
    return values.mapInPandas(run, "value string, reading string, words array<string>, number string, kind string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, lead, d): for each word itself, and the neighbours that lead it. One edit leads to a word as frequent or more;
    two edits only lead a word hardly used to one used ``FAR`` times as often. Words stand once here, however often they are
    used, so no bucket of the index grows with the use of a word."""

    def keys(frames):
        for f in frames:
            rows = []
            for w, n in zip(f["word"], f["n"]):
                if len(w) > 3:
                    one = deletes(w)
                    rows += [(w, n, k, k in one) for k in (deletes(w, 2) if len(w) >= 8 else one)]
            yield pd.DataFrame(rows, columns=["word", "n", "key", "one"])

    ix = words.mapInPandas(keys, "word string, n bigint, key string, one boolean")
    a, b = ix.alias("a"), ix.alias("b")
    more = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.word") < F.col("a.word")))
    # Two edits only lead to a far more frequent word, and words one edit apart share a key that one deletion reaches.
    near = (F.col("a.one") & F.col("b.one")) | ((F.col("a.n") <= RARE) & (F.col("b.n") >= FAR * F.col("a.n")))
    pairs = a.join(b, "key").filter((F.col("a.word") != F.col("b.word")) & more & near).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("lead"), F.col("b.n").alias("m")).distinct()

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa(p, q, 2) for p, q in zip(x, y)], dtype="int32")

    pairs = pairs.withColumn("d", distance("word", "lead"))
    pairs = pairs.filter((F.col("d") == 1) | ((F.col("d") == 2) & (F.col("n") <= RARE) & (F.col("m") >= FAR * F.col("n")))).select("word", "lead", "d")
    return pairs.unionByName(words.select("word", F.col("word").alias("lead"), F.lit(0).alias("d")))


RARE, FAR = 2, 8


RARE, FAR = 2, 8


def candidate_keys(words: list[str], leads: list[list[tuple[str, int]]]):
    """(key, length of the second word, whether that is an initial) under which a reading meets others: two words by their leads; or one
    own word by its leads with another's initial, beginning or outline."""
    led = []
    for w, ls in zip(words, leads):
        more = [(g, 0) for g in GIVEN.get(w, [])] if w[0] != "*" else []
        led.append({l: d for l, d in sorted([*ls, *more, (w, 0)], key=lambda x: -x[1])})
    strict = {f"{min(x, y)} {max(x, y)}" for i, j in combinations(range(len(words)), 2) for x, dx in led[i].items() for y, dy in led[j].items() if dx + dy <= MOST}
    for i, w in enumerate(words):
        if w[0] == "*" or len(w) < 3:
            continue
        if sum(x[0] != "*" for x in words) == 1:
            strict |= {f"{x}" for x in led[i]}
        for j, other in enumerate(words):
            if i == j:
                continue
            for o in {other, *(GIVEN.get(other, []) if other[0] != "*" else [])}:
                o = o.lstrip("*")
                for x in led[i]:
                    yield f"{x} i {o[0]}", len(o), len(o) == 1
                    if len(o) > 1:
                        yield f"{x} o {o[0]}{o[-1]}", len(o), False
                        yield f"{x} p {o[:2]}", len(o), False
    for k in strict:
        yield k, 0, True


def reading_pairs(read_: DataFrame) -> DataFrame:
    """(a, b, cost, loose): readings that may stand for the same."""
    w = read_.select("value", F.explode(F.filter("words", lambda x: ~x.startswith("*"))).alias("word"))
    near = cut(near_words(w.groupBy("word").agg(F.count_distinct("value").alias("n"))), "near")
    distinct = cut(read_.groupBy("reading").agg(F.first("words").alias("words"), F.first("number").alias("number"), F.first("kind").alias("kind")), "distinct")
    leads = (
        distinct.select("reading", F.posexplode("words").alias("pos", "word"))
        .join(near, "word", "left")
        .groupBy("reading")
        .agg(F.collect_list(F.struct("pos", "lead", "d")).alias("leads"))
    )

    def keys(frames):
        for f in frames:
            rows = []
            for r, words, number, leads_ in zip(f["reading"], f["words"], f["number"], f["leads"]):
                by = [[] for _ in words]
                for x in leads_:
                    if x["lead"] is not None:
                        by[x["pos"]].append((x["lead"], x["d"]))
                rows += [(r, f"{number} {k}", n, s) for k, n, s in set(candidate_keys(list(words), by))]
            yield pd.DataFrame(rows, columns=["reading", "key", "n", "initial"])

    ix = cut(distinct.join(leads, "reading").select("reading", "words", "number", "leads").mapInPandas(keys, "reading string, key string, n int, initial boolean"), "keys")
    # Of what meets by an initial one side has no more than that; of what meets by outlines one is the shorter by two letters.
    meet = (F.col("a.initial") | F.col("b.initial")) | ((F.abs(F.col("a.n") - F.col("b.n")) > 1) & ~F.col("key").rlike(" i .$"))
    pairs = ix.alias("a").join(ix.alias("b"), "key").filter((F.col("a.reading") < F.col("b.reading")) & meet).select(F.col("a.reading").alias("a"), F.col("b.reading").alias("b")).distinct()
    full = pairs.join(distinct.select(F.col("reading").alias("a"), F.col("words").alias("wa"), F.col("kind").alias("ka")), "a").join(distinct.select(F.col("reading").alias("b"), F.col("words").alias("wb"), F.col("kind").alias("kb")), "b")

    def aligned(frames):
        for f in frames:
            rows = []
            for a, b, wa, wb in zip(f["a"], f["b"], f["wa"], f["wb"]):
                if got := align(list(wa), list(wb)):
                    rows.append((a, b, *got))
            yield pd.DataFrame(rows, columns=["a", "b", "cost", "loose"])

    some = full.filter((F.col("ka") == F.col("kb")) | (F.col("ka") == "u") | (F.col("kb") == "u"))
    return some.select("a", "b", "wa", "wb").mapInPandas(aligned, "a string, b string, cost double, loose boolean")


def entities(df: DataFrame, party: str = "party") -> DataFrame:
    """(value, entity): one row per distinct value that names one party."""
    read_ = cut(readings(df, party), "readings")
    links = cut(reading_pairs(read_), "aligned")
    group = grouped(read_.select("reading").distinct(), links.filter("not loose").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    for _ in range(ROUNDS):
        group = cut(attached(group, links), "groups")
    return read_.join(group, "reading").select("value", F.col("entity"))


ROUNDS = 2


def grouped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(reading, entity): the smallest reading that each is joined with."""
    c = components(edges)
    return nodes.join(c.select(F.col("node").alias("reading"), F.col("component").alias("entity")), "reading", "left").select("reading", F.coalesce("entity", "reading").alias("entity"))


def attached(group: DataFrame, links: DataFrame) -> DataFrame:
    """Groups joined with the one that says more and that they fit best, where there is just one such."""
    g = lambda k: group.select(F.col("reading").alias(k), F.col("entity").alias(f"e{k}"))
    x = links.join(g("a"), "a").join(g("b"), "b").filter("ea <> eb")
    # The side with fewer letters leaves something out; of equals the later in order.
    less = F.struct(F.length("a"), F.col("b")) < F.struct(F.length("b"), F.col("a"))
    x = x.select(F.when(less, F.col("ea")).otherwise(F.col("eb")).alias("src"), F.when(less, F.col("eb")).otherwise(F.col("ea")).alias("dst"), "cost")
    best = x.groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    one = best.groupBy("src").agg(F.min_by("dst", "cost").alias("dst"), F.sort_array(F.collect_list("cost")).alias("costs"))
    only = one.filter((F.size("costs") == 1) | (F.get("costs", F.lit(0)) < F.get("costs", F.lit(1)))).select("src", "dst")
    c = components(only).select(F.col("node").alias("entity"), "component")
    return group.join(c, "entity", "left").select("reading", F.coalesce("component", "entity").alias("entity"))


def variant_pairs(df: DataFrame, party: str = "party") -> DataFrame:
    """(party_a, party_b): every two different values of one entity, in code point order."""
    e = cut(entities(df, party), "entities")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, "entity").filter("a.value < b.value").select(F.col("a.value").alias("party_a"), F.col("b.value").alias("party_b"))
