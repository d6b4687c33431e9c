"""Documents in markup and timed text: HTML, e-mail, captions, transcripts. Plain functions of one text, and a wrapper that runs
them over a column in Arrow batches."""

from __future__ import annotations

import email
import email.policy
import json
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JUNK = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "iframe", "button"}
BLOCK = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track", "param"}


class Tree(HTMLParser):
    """Blocks with the path of boxes they stand in, tables with caption and nearest heading, and metadata."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, int]] = []
        self.count = 0
        self.junk = 0
        self.blocks: list[tuple[str, str, tuple]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.tables: list[dict] = []
        self.heading = ""
        self.meta: dict[str, str] = {}
        self.ld: list[str] = []
        self.in_ld = False
        self.title = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (k := a.get("property") or a.get("name")) and a.get("content"):
            self.meta.setdefault(k.lower(), a["content"])
        if tag == "script" and a.get("type") == "application/ld+json":
            self.in_ld = True
        if tag in VOID:
            if tag == "br" and self.open:
                self.open[-1][1].append("\n")
            return
        self.count += 1
        self.path.append((tag, self.count))
        self.junk += tag in JUNK
        if tag == "table":
            self.tables.append({"rows": [], "caption": "", "heading": self.heading, "open": True})
        if tag == "tr" and self.tables and self.tables[-1]["open"]:
            self.tables[-1]["rows"].append([])
        if tag in BLOCK or tag in ("title", "caption"):
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag == "script":
            self.in_ld = False
        if not any(t == tag for t, _ in self.path):
            return
        while self.path:
            t, _ = self.path.pop()
            self.junk -= t in JUNK
            if self.open and self.open[-1][0] == t:
                kind, parts = self.open.pop()
                text = re.sub(r"[ \t\r\f]+", " ", "".join(parts)).strip()
                self.close(kind, text)
            if t == "table" and self.tables:
                self.tables[-1]["open"] = False
            if t == tag:
                break

    def close(self, kind: str, text: str) -> None:
        if kind == "title":
            self.title = self.title or text
        elif kind == "caption" and self.tables:
            self.tables[-1]["caption"] = text
        elif kind in ("td", "th"):
            if self.tables and self.tables[-1]["open"] and self.tables[-1]["rows"]:
                self.tables[-1]["rows"][-1].append((kind, text))
        elif text and not self.junk:
            if kind[0] == "h" and kind[1:].isdigit():
                self.heading = text
            self.blocks.append((kind, text, tuple(n for _, n in self.path)))

    def handle_data(self, data):
        if self.in_ld:
            self.ld.append(data)
        elif self.open and (not self.junk or self.open[-1][0] in ("td", "th", "title", "caption")):
            self.open[-1][1].append(data)


def tree(html: str | None) -> Tree:
    t = Tree()
    t.feed(html or "")
    return t


def main_content(html: str | None) -> str:
    """The blocks of the box that holds most paragraph text, weighing each box it lies in by half per level up."""
    t = tree(html)
    score: dict[int, float] = {}
    for kind, text, path in t.blocks:
        if kind in ("p", "pre", "blockquote", "li", "dd"):
            for up, n in enumerate(reversed(path)):
                score[n] = score.get(n, 0.0) + len(text) * (0.9**up if up < 3 else 0.5 * 0.9**up)
    if not score:
        return "\n\n".join(x for _, x, _ in t.blocks)
    best = max(score, key=lambda n: (score[n], n))
    return "\n\n".join(text for _, text, path in t.blocks if best in path)


def metadata(html: str | None) -> dict[str, str | None]:
    """title, author, published and publisher as the page states them: JSON-LD first, then meta tags; never inferred."""
    t = tree(html)
    ld: dict = {}
    for part in ("".join(t.ld),):
        try:
            got = json.loads(part)
            got = got[0] if isinstance(got, list) and got else got
            ld = got if isinstance(got, dict) else {}
        except ValueError:
            pass

    def name(x):
        x = x[0] if isinstance(x, list) and x else x
        return x.get("name") if isinstance(x, dict) else x if isinstance(x, str) else None

    m = t.meta
    return {
        "title": ld.get("headline") or m.get("og:title") or t.title or None,
        "author": name(ld.get("author")) or m.get("author") or m.get("article:author"),
        "published": ld.get("datePublished") or m.get("article:published_time") or m.get("date"),
        "publisher": name(ld.get("publisher")) or m.get("og:site_name"),
    }


def html_tables(html: str | None, least_cols: int = 2, most_cols: int = 14, least_rows: int = 2, mean_cell: int = 220) -> list[dict]:
    """Tables worth having: {name, header, rows}. The name is the caption or the nearest heading before."""
    out = []
    for x in tree(html).tables:
        rows = [r for r in x["rows"] if r]
        if len(rows) < least_rows + 1:
            continue
        head, body = [c for _, c in rows[0]], [[c for _, c in r] for r in rows[1:]]
        n = len(head)
        cells = [c for r in body for c in r]
        if not least_cols <= n <= most_cols or not cells or sum(map(len, cells)) / len(cells) > mean_cell:
            continue
        names: list[str] = []
        for i, h in enumerate(head):
            h = h or f"column {i + 1}"
            names.append(h if h not in names else f"{h} {sum(y.startswith(h) for y in names) + 1}")
        out.append({"name": x["caption"] or x["heading"], "header": names, "rows": [(r + [""] * n)[:n] for r in body]})
    return out


def table_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, name, header_key, row, column, value): cells of all tables; equal header keys are one table in many pages."""

    def run(frames):
        for f in frames:
            rows = []
            for k, h in zip(f["k"], f["h"]):
                for i, t in enumerate(html_tables(h)):
                    hk = "|".join(c.strip().lower() for c in t["header"])
                    rows += [(k, i, t["name"], hk, r, c, v) for r, row in enumerate(t["rows"]) for c, v in zip(t["header"], row)]
            yield pd.DataFrame(rows, columns=["k", "table_no", "name", "header_key", "row", "column", "value"])

    s = f"k {dict(df.dtypes)[key]}, table_no int, name string, header_key string, row int, column string, value string"
    return df.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, s).withColumnRenamed("k", key)


STAMP = re.compile(r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*(?:-->|,)\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})")


def seconds(clock: str) -> float:
    total = 0.0
    for p in clock.replace(",", ".").split(":"):
        total = total * 60 + float(p)
    return total


def captions(raw: str | None) -> list[tuple[float, float, str]]:
    """(start, end, text) of WebVTT, SRT, SBV, segment JSON or json3 captions."""
    s = (raw or "").lstrip("\ufeff").strip()
    if s[:1] in "[{" and s:
        try:
            return json_captions(json.loads(s))
        except (ValueError, TypeError):
            return []
    out = []
    for block in re.split(r"\r?\n\s*\r?\n", s):
        m = STAMP.search(block)
        if not m:
            continue
        text = re.sub(r"<[^>]+>|\{[^}]*\}", "", block[m.end() :].partition("\n")[2] if "\n" in block[m.end() :] else "")
        text = re.sub(r"\s+", " ", text).strip()
        if text:
            out.append((seconds(m[1]), seconds(m[2]), text))
    return out


def json_captions(x) -> list[tuple[float, float, str]]:
    out = []
    if isinstance(x, dict) and "events" in x:  # json3
        for e in x["events"]:
            text = re.sub(r"\s+", " ", "".join(g.get("utf8", "") for g in e.get("segs", ()))).strip()
            if text:
                a = e.get("tStartMs", 0) / 1000
                out.append((a, a + e.get("dDurationMs", 0) / 1000, text))
        return out
    for g in x.get("segments", []) if isinstance(x, dict) else x:
        a = float(g.get("start", 0))
        b = float(g["end"]) if "end" in g else a + float(g.get("duration", 0))
        if str(g.get("text", "")).strip():
            out.append((a, b, re.sub(r"\s+", " ", g["text"]).strip()))
    return out


CLOCK = re.compile(r"^\s*[\[(]?((?:\d{1,2}:)?\d{1,2}:\d{2}(?:\.\d+)?)[\])]?\s*[-–—:]?\s*")


def transcript(raw: str | None) -> list[tuple[float | None, str]]:
    """(start or none, text) of a plain transcript's blocks; a clock may open a block."""
    out = []
    for b in re.split(r"\n\s*\n", raw or ""):
        m = CLOCK.match(b)
        text = re.sub(r"\s+", " ", b[m.end() :] if m else b).strip()
        if text:
            out.append((seconds(m[1]) if m else None, text))
    return out


def markdown_transcript(raw: str | None) -> list[tuple[float | None, str]]:
    """The same of Markdown: headings, emphasis, links, lists and fences are undone first."""
    t = re.sub(r"(?m)^```.*$", "", raw or "")
    t = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", t)
    t = re.sub(r"(?m)^[ \t]*(?:#{1,6}|[-*+]|>|\d+\.)[ \t]+", "", t)
    return transcript(re.sub(r"(\*\*|__|\*|_|`)(?=\S)(.+?)(?<=\S)\1", r"\2", t))


def read_email(raw: str | bytes | None) -> dict[str, str | None]:
    """subject, from, to, date and the text of a message: folded headers, encoded words, quoted-printable and base64 undone."""
    m = email.message_from_bytes(raw if isinstance(raw, bytes) else (raw or "").encode(), policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    try:
        text = body.get_content() if body else ""
    except (LookupError, ValueError):
        text = (body.get_payload(decode=True) or b"").decode("utf-8", "replace")
    if body is not None and body.get_content_type() == "text/html":
        text = main_content(text)
    return {k: (str(m[k]) if m[k] else None) for k in ("subject", "from", "to", "date")} | {"text": text.strip()}


def over(df: DataFrame, key: str, text: str, read: Callable, columns: str) -> DataFrame:
    """(key, columns): one row per item that read gives for each text (a list of tuples, or one dict)."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames):
        for f in frames:
            rows = []
            for k, t in zip(f["k"], f["t"]):
                got = read(t)
                rows += [(k, *[got[n] for n in names])] if isinstance(got, dict) else [(k, *x) for x in got]
            yield pd.DataFrame(rows, columns=["k", *names])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, {columns}").withColumnRenamed("k", key)
