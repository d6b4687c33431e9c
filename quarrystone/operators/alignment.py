"""Sequences within one document: alignment of transcripts, fusion of two readings, cuts between paragraphs, statements with
offsets, typed key-values and units. Each is a function of one text, run over many by ``over_docs``."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spoken(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that increases in both places."""
    pairs = sorted(pairs)
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
        back[k] = ends[at - 1] if at else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def lcs(a: list[str], b: list[str], same: Callable[[str, str], bool] = lambda x, y: x == y) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    n, m = len(a), len(b)
    d = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            d[i, j] = d[i + 1, j + 1] + 1 if same(a[i], b[j]) else max(d[i + 1, j], d[i, j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if same(a[i], b[j]) and d[i, j] == d[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif d[i + 1, j] >= d[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def prefix_lengths(a: list[str], b: list[str]) -> list[int]:
    """The length of a longest common subsequence of a and each beginning of b, by bit vectors: one big addition a word of a."""
    where: dict[str, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        m = v & where.get(w, 0)
        v = (v + m | v - m) & full
    out, n = [0], 0
    for bit in reversed(format(v, f"0{len(b)}b")) if b else "":
        n += bit == "0"
        out.append(n)
    return out


def common(a: list[str], b: list[str], small: int = 40_000) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of lists of any length: a is halved, b is cut where both halves' lengths add up to
    most, and what is small enough goes through the plain table."""
    if not a or not b:
        return []
    if len(a) * len(b) <= small or len(a) == 1:
        return lcs(a, b)
    h = len(a) // 2
    x, y = prefix_lengths(a[:h], b), prefix_lengths(a[h:][::-1], b[::-1])
    j = max(range(len(b) + 1), key=lambda k: x[k] + y[len(b) - k])
    return common(a[:h], b[:j], small) + [(i + h, k + j) for i, k in common(a[h:], b[j:], small)]


def match_words(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists: three-word runs that stand once in each pin it, what lies between pins is aligned by
    longest common subsequence, however long it is."""

    def once(x):
        c = Counter(zip(x, x[1:], x[2:]))
        return {g: i for i, g in enumerate(zip(x, x[1:], x[2:])) if c[g] == 1}

    p, q = once(a), once(b)
    pins = increasing([(p[g], q[g]) for g in p.keys() & q.keys()])
    pins = increasing(sorted({(i + k, j + k) for i, j in pins for k in range(3)}))
    out, i, j = [], 0, 0
    for x, y in [*pins, (len(a), len(b))]:
        out += [(i + u, j + v) for u, v in common(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def align(given: list[str], heard: list[tuple[float, float, str]]) -> pd.DataFrame:
    """Given segments with the times of what was heard: (seg, start, end, matched, words, status). ok from 0.7, weak from 0.25
    of the words; fewer than four words need all."""
    words = [(k, w) for k, s in enumerate(given) for w in spoken(s)]
    times = [(s + (e - s) * i / max(1, len(ws)), s + (e - s) * (i + 1) / max(1, len(ws)), w) for s, e, t in heard for ws in [spoken(t)] for i, w in enumerate(ws)]
    hits: dict[int, list] = {}
    for i, j in match_words([w for _, w in words], [w for _, _, w in times]):
        hits.setdefault(words[i][0], []).append(times[j])
    rows, last = [], 0.0
    for k, s in enumerate(given):
        n, h = len(spoken(s)), hits.get(k, [])
        share = len(h) / n if n else 0.0
        status = "ok" if n and (share == 1 if n < 4 else share >= 0.7) else "weak" if n >= 4 and share >= 0.25 else "none"
        start = max(last, h[0][0]) if h and status != "none" else None
        last = start if start is not None else last
        rows.append((k, start, h[-1][1] if h and status != "none" else None, len(h), n, status))
    return pd.DataFrame(rows, columns=["seg", "start", "end", "matched", "words", "status"])


def fuse(a: str, b: str, known: set[str], strict: bool = False) -> str:
    """Two readings of one page as one: where they agree, that; else the side with more known words; digits of either are
    never lost. Strict keeps only what both or the known words carry."""
    x, y = a.split(), b.split()
    out, i, j = [], 0, 0
    for u, v in [*lcs(x, y), (len(x), len(y))]:
        p, q = x[i:u], y[j:v]
        score = lambda ws: sum(w.strip(".,;:").lower() in known for w in ws) + 0.5 * sum(any(c.isdigit() for c in w) for w in ws)
        best = p if score(p) >= score(q) else q
        out += [w for w in best if not strict or w.strip(".,;:").lower() in known or any(c.isdigit() for c in w)]
        if u < len(x):
            out.append(x[u])
        i, j = u + 1, v + 1
    return " ".join(out)


def depths(bags: list[Counter], width: int) -> list[float]:
    """How deep the likeness of the words left and right of each gap lies below the peaks beside it; windows of ``width`` words."""

    def window(k: int, step: int) -> Counter:
        out: Counter = Counter()
        while 0 <= k < len(bags) and sum(out.values()) < width:
            out.update(bags[k])
            k += step
        return out

    sims = []
    for g in range(1, len(bags)):
        l, r = window(g - 1, -1), window(g, 1)
        den = math.sqrt(sum(v * v for v in l.values()) * sum(v * v for v in r.values()))
        sims.append(sum(v * r[w] for w, v in l.items()) / den if den else 0.0)
    out = []
    for i, s in enumerate(sims):
        lo = hi = i
        while lo > 0 and sims[lo - 1] >= sims[lo]:
            lo -= 1
        while hi < len(sims) - 1 and sims[hi + 1] >= sims[hi]:
            hi += 1
        out.append(sims[lo] + sims[hi] - 2 * s)
    return out


def paragraph_cuts(statements: list[str], draws: int = 60, seed: int = 1) -> list[int]:
    """Gaps (statement numbers) where the vocabulary shifts more than in any of the seeded shuffles, at three widths."""
    bags = [Counter(w for w in spoken(s) if len(w) > 3) for s in statements]
    total = sum(sum(b.values()) for b in bags)
    if len(bags) < 4 or not total:
        return []
    rng = np.random.default_rng(seed)
    base = max(2, round(math.sqrt(total)))
    found: set[int] = set()
    for width in (base, 2 * base, 4 * base):
        d = depths(bags, width)
        bar = max(max(depths([bags[i] for i in rng.permutation(len(bags))], width), default=0.0) for _ in range(draws))
        found |= {i + 1 for i, x in enumerate(d) if x > bar}
    return sorted(found)


ABBREVIATIONS = {"mr", "mrs", "ms", "dr", "st", "no", "inc", "co", "ltd", "corp", "jr", "sr", "vs", "etc", "art", "sec", "fig", "dept", "gov", "hon", "ave", "rd", "blvd", "apt", "ste"}


def statement_spans(text: str | None) -> list[tuple[int, int]]:
    """Spans of statements: lines, cut after sentence ends that aren't those of abbreviations or initials. text[s:e] is the
    statement."""
    out = []
    for m in re.finditer(r"[^\n]+", text or ""):
        line, at = m[0], 0
        for e in re.finditer(r"[.!?][\"'”’)\]]*(?=\s+[\"'“‘(\[]?[A-Z0-9])", line):
            word = re.search(r"([\w.]+)[.!?]$", line[: e.start() + 1])
            last = word[1].lower().split(".")[-1] if word else ""
            if line[e.start()] == "." and (last in ABBREVIATIONS or len(last) == 1 and last.isalpha()):
                continue
            out.append((m.start() + at, m.start() + e.end()))
            at = e.end()
        out.append((m.start() + at, m.end()))
    trimmed = []
    for s, e in out:
        t = text[s:e]
        a, b = s + len(t) - len(t.lstrip()), e - (len(t) - len(t.rstrip()))
        if a < b:
            trimmed.append((a, b))
    return trimmed


# What multiplies a number, what signs of money are called, and words behind a number that are no unit of it.
TIMES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "billion": 1e9, "bn": 1e9}
CURRENCY = {"$": "dollars", "£": "pounds", "€": "euros"}
NO_UNIT = set("am pm a an the and or of in on at to by for was were is are th st nd rd s time times shall".split())
# Months, and small words that stand within names.
MONTHS = "January February March April May June July August September October November December".split()
WITHIN = set("of the de del la von van der &".split())
DATE = re.compile(rf"\b(1[0-9]{{3}}|20[0-9]{{2}}|{'|'.join(MONTHS)})\b")
WORD = re.compile(r"&|[^\W_][\w'’&.\-]*")
PART = re.compile(r"(?P<number>\d+(?:,\d{3})*(?:\.\d+)?)|(?P<word>[a-z]+)|(?P<sign>[^\s\w])|(?P<other>\w)")


def names_in(t: str) -> list[tuple[str, int, int]]:
    """(name, s, e): words with a capital that follow each other over blanks, small words between two of them included. A single word
    that opens a statement is no name, nor is a single letter; a closing possessive or stop is shed."""
    words = [(m[0], m.start(), m.end()) for m in WORD.finditer(t)]
    out, i = [], 0
    while i < len(words):
        if not words[i][0][0].isupper():
            i += 1
            continue
        last = i
        for k in range(i + 1, len(words)):
            if t[words[k - 1][2] : words[k][1]].strip() or not (words[k][0][0].isupper() or words[k][0] in WITHIN):
                break
            if words[k][0][0].isupper():
                last = k
        s, name = words[i][1], t[words[i][1] : words[last][2]]
        name = name.rstrip(".,;:'’-")
        if name.endswith(("'s", "’s")):
            name = name[:-2]
        opens = not t[:s].strip(" \"'“‘([")
        if sum(c.isalpha() for c in name) > 1 and (" " in name or not opens):
            out.append((name, s, s + len(name)))
        i = last + 1
    return out


def figures_in(t: str) -> list[tuple[str, float, str, int, int]]:
    """(raw, value, unit, s, e) of numbers that count something: a sign of money stands before them, or a percent sign or a word that
    names what is counted behind, with a multiplier between. A bare year is no figure, nor is a number inside a word or a time."""
    parts = [(m.lastgroup, m[0], m.start(), m.end()) for m in PART.finditer(t)]
    out = []
    for i, (kind, raw, s, e) in enumerate(parts):
        if kind != "number" or s and (t[s - 1].isalnum() or t[s - 1] in ":."):
            continue
        value, unit, start, k = float(raw.replace(",", "")), "", s, i + 1
        follows = lambda: parts[k] if k < len(parts) and not t[e : parts[k][2]].strip() else ("", "", 0, 0)  # noqa: B023, E731
        if i and parts[i - 1][1] in CURRENCY and parts[i - 1][3] == s:
            unit, start = CURRENCY[parts[i - 1][1]], parts[i - 1][2]
        times = 1.0
        if follows()[1] in TIMES:
            times, e, k = TIMES[follows()[1]], follows()[3], k + 1
        group, word, _, end = follows()
        if not unit and times == 1.0 and raw.isdigit() and len(raw) == 4 and 1000 <= value <= 2099:
            continue
        if word in ("%", "percent"):
            unit, e = unit or "percent", end
        elif group == "word" and word not in NO_UNIT:
            unit, e = unit or word.removesuffix("s"), end
        if unit:
            out.append((t[start:e], value * times, unit, start, e))
    return out


def dates_in(t: str) -> list[tuple[str, int | None, int, int]]:
    return [(m[1], int(m[1]) if m[1].isdigit() else None, m.start(), m.end()) for m in DATE.finditer(t)]


def figure_table(text: str | None) -> list[tuple[str, str, str, str]]:
    """(section, key, value, kind) of a text's key-value lines; a heading line names the section of what follows."""
    out, section = [], ""
    for line in (text or "").split("\n"):
        s = line.strip()
        m = re.match(r"([A-Za-z][\w ,/&()'-]{1,60}?)\s*(?::|\.{3,}|\s{2,}|\t)\s*(\S.*)$", s)
        if m:
            v = m[2].strip()
            kind = "amount" if re.match(r"[$£€]?\s?\(?[\d,]+(?:\.\d+)?\)?$", v) and re.search(r"\d", v) else "percent" if re.match(r"[\d.]+\s?%$", v) else "date" if re.match(r"(?:\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d\d-\d\d|[A-Z][a-z]+ \d{1,2}, \d{4})$", v) else "text"
            out.append((section, m[1].strip(), v, kind))
        elif s and len(s) <= 60 and (s.isupper() or s.istitle()) and not s.endswith("."):
            section = s
    return out


def blocks(text: str | None) -> list[tuple[str, int, int]]:
    """(type, s, e) of a text's blocks: table, list, heading or prose."""
    out = []
    for m in re.finditer(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*", text or ""):
        lines = m[0].split("\n")
        tabs = sum("\t" in l or l.count("  ") >= 2 or l.count("|") >= 2 for l in lines)
        bullets = sum(bool(re.match(r"\s*(?:[-*•]|\d+[.)])\s", l)) for l in lines)
        kind = "table" if len(lines) > 1 and tabs >= 0.6 * len(lines) else "list" if bullets >= 0.6 * len(lines) and len(lines) > 1 else "heading" if len(lines) == 1 and len(m[0]) <= 60 and not re.search(r"[.!?]$", m[0].strip()) else "prose"
        out.append((kind, m.start(), m.end()))
    return out


def hang(text: str | None) -> str:
    """code, prose, grid or undecided: a strict winner among the lines that witness for each."""
    c: Counter = Counter()
    for l in (text or "").split("\n"):
        c["code"] += bool(re.search(r"[{};]\s*$|^\s*(?:def|class|import|return|if|for|function|const|var|let)\b.*[:{(]|=>|==", l))
        c["grid"] += l.count("\t") >= 1 or bool(re.search(r"\S\s{2,}\S+\s{2,}\S", l)) or l.count(",") >= 3 and len(l) < 80 and not re.search(r"[a-z]{3,} [a-z]{2,} [a-z]{2,}", l)
        c["prose"] += len(re.findall(r"\b[a-z]{2,}\b", l)) >= 6 and bool(re.search(r"[.,;]", l))
    top = c.most_common(2)
    return top[0][0] if top and top[0][1] > 0 and (len(top) < 2 or top[0][1] > top[1][1]) else "undecided"


def reads_as_words(text: str | None, lexicon: set[str], floor: float = 0.5) -> bool:
    """Whether at least half of a text's tokens are words."""
    w = spoken(text or "")
    return bool(w) and sum(x in lexicon for x in w) / len(w) >= floor


def over_docs(df: DataFrame, key: str, text: str, f: Callable, columns: str) -> DataFrame:
    """(key, columns) of every tuple that f gives for a text."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames):
        for x in frames:
            yield pd.DataFrame([(k, *r) for k, t in zip(x["k"], x["t"]) for r in f(t)], columns=["k", *names])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").mapInPandas(run, f"k {dict(df.dtypes)[key]}, {columns}").withColumnRenamed("k", key)


def read_statements(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, s, e, text, names, figures, years): every statement with what it states; text is the source's [s, e)."""

    def f(t):
        for s, e in statement_spans(t):
            x = t[s:e]
            yield s, e, x, [n for n, _, _ in names_in(x)], [f"{v:g} {u}" for _, v, u, _, _ in figures_in(x)], [y for _, y, _, _ in dates_in(x) if y]

    return over_docs(df, key, text, f, "s int, e int, text string, names array<string>, figures array<string>, years array<int>")
