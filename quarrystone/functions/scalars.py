"""Scalar functions as column expressions: nothing here leaves the JVM. Nulls give null unless a docstring says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_of(x) -> Column:
    """A null counts as an empty text."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


# ---- shaping text


def clean(x) -> Column:
    """White space collapsed and trimmed; empty for null."""
    return F.trim(F.regexp_replace(text_of(x), r"\s+", " "))


def cut(x, n: int) -> Column:
    """At most n characters, the last an ellipsis where something was cut off."""
    t = clean(x)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(t)


# Latin letters with marks and the letters they are marked forms of, in the same places.
MARKED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçšžčřďťňěůłøđ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncszcrdtneulod"


def fold(x) -> Column:
    """Lower case without marks on Latin letters."""
    return F.translate(F.lower(text_of(x)), MARKED, PLAIN)


def referent_key(x) -> Column:
    """Folded, blanks collapsed, a leading article shed."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(x), r"\s+", " "), r"^the\s+", ""))


def snake(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_of(x)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def title_line(x, n: int = 60) -> Column:
    """The first line with something in it, at most n characters."""
    lines = F.filter(F.transform(F.split(text_of(x), "\n"), lambda z: F.trim(z)), lambda l: l != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, n)


# Suffixes that are shed, longest first where one contains another; at least four letters must remain.
SUFFIXES = tuple("ifications ification ifying ified ifies ify ations ation ings ing ies ied es ed s".split())


def stem(x, suffixes: tuple[str, ...] = SUFFIXES, least: int = 4) -> Column:
    w = F.lower(col(x))
    return reduce(
        lambda rest, s: F.when(w.endswith(s) & (F.length(w) - len(s) >= least), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(rest),
        reversed(suffixes),
        w,
    )


def stem5(x) -> Column:
    return F.substring(fold(x), 1, 5)


def ocr_fold(x) -> Column:
    """Lower case with signs that scanners confuse as one; the length stays."""
    return F.translate(F.lower(text_of(x)), "1|i!0", "llllo")


def surface_count(text, surface: str) -> Column:
    """Whole-word occurrences of a surface, or plain ones where it begins or ends with no word character."""
    import re

    s = re.escape(surface)
    whole = re.match(r"\w.*\w$|\w$", surface)
    return F.regexp_count(F.lower(text_of(text)), F.lit((rf"\b{s}\b" if whole else s).lower()))


# ---- reading values


# What values look like, tried in this order; results must equal these patterns.
FORMATS = (
    ("currency", r"[$€£]\s?\d[\d,]*\.?\d{0,2}"),
    ("date", r"\d{4}-\d{2}(-\d{2})?"),
    ("date", r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}"),
    ("date", r"(0[1-9]|1[0-2])[0-2]\d(19|20)\d{2}"),
    ("time", r"(?i)\d{1,2}:\d{2}(\s?[ap]\.?m\.?)?"),
    ("email", r"[^@\s]+@[^@\s]+\.[^@\s]+"),
    ("phone", r"\+?1?[\s.\-()]*\d{3}[\s.\-()]*\d{3}[\s.\-]*\d{4}"),
    ("choice", r"(?i)yes|no|true|false|s[ií]"),
    ("identifier", r"\d[A-Za-z0-9\-/.]*[A-Za-z][A-Za-z0-9\-/.]*|[A-Za-z][A-Za-z0-9\-/.]*\d[A-Za-z0-9\-/.]*"),
    ("integer", r"\d+"),
    ("decimal", r"\d[\d,]*\.\d+"),
    ("name", r"[A-Za-z][A-Za-z.'\-]+( [A-Za-z][A-Za-z.'\-]+){1,3}"),
)
#: How long a value must be to be of a format, and from where on it is free text.
SHORTEST, FREE = {"identifier": 4}, 60


def value_format(x) -> Column:
    """What a value looks like: empty, the first of ``FORMATS`` that fits it whole, free-text if it is long, else text."""
    s = F.trim(text_of(x))
    tests = [("empty", s == "")] + [(name, s.rlike(rf"^(?:{p})$") & (F.length(s) >= SHORTEST.get(name, 0))) for name, p in FORMATS]
    return F.coalesce(*[F.when(fits, name) for name, fits in tests], F.when(F.length(s) > FREE, "free-text"), F.lit("text"))


def shape_of(x) -> Column:
    """amount, date, id, phone or text by the classes of characters alone."""
    s = F.trim(text_of(x))
    return (
        F.when(s.rlike(r"^[\p{Sc}]\s?\p{Nd}[\p{Nd}.,]*$|^\p{Nd}[\p{Nd}.,]*\s?[\p{Sc}]$|^\p{Nd}{1,3}(,\p{Nd}{3})+(\.\p{Nd}+)?$"), "amount")
        .when(s.rlike(r"^\p{Nd}{1,4}[/.\-]\p{Nd}{1,2}[/.\-]\p{Nd}{1,4}$"), "date")
        .when(s.rlike(r"^[+(]?[\p{Nd}() .\-]{7,}$") & (F.length(F.regexp_replace(s, r"\P{Nd}", "")) >= 7), "phone")
        .when(s.rlike(r"\p{Nd}") & s.rlike(r"^[\p{L}\p{Nd}\-/.#]+$"), "id")
        .otherwise("text")
    )


def coerce_number(x) -> Column:
    """A number written as people write them: currency signs, thousands commas, percent, brackets for minus. Null if none."""
    s = F.trim(text_of(x))
    body = F.regexp_replace(s, r"[$€£,%\s()]", "")
    ok = s.rlike(r"^\(?\s*[-+]?[$€£]?\s*[-+]?\d[\d,]*(\.\d+)?\s*%?\s*\)?$")
    value = body.try_cast("double")
    return F.when(ok, F.when(s.startswith("("), -value).otherwise(value))


def money(x) -> Column:
    """The first dollar amount in a text, thousands, millions and billions counted out."""
    s = text_of(x)
    pat = r"(?i)\$\s?(\d[\d,]*(?:\.\d+)?)(?:\s*(million|billion|thousand))?"
    number = F.regexp_replace(F.regexp_extract(s, pat, 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(s, pat, 2))
    return number * F.when(unit == "million", 1e6).when(unit == "billion", 1e9).when(unit == "thousand", 1e3).otherwise(1.0)


def us_date(x) -> Column:
    """A date of a text M/D/YYYY, or null."""
    return F.to_date(F.try_to_timestamp(F.trim(text_of(x)), F.lit("M/d/yyyy")))


def expiry_year(x) -> Column:
    """The four digits a text ends in if they can be a year, else unknown."""
    s = F.rtrim(text_of(x))
    return F.when(s.rlike(r"[12][09][0-9][0-9]$"), F.right(s, F.lit(4))).otherwise("unknown")


def json_field(x, name: str) -> Column:
    """A field of a JSON text as text; null for broken JSON."""
    return F.get_json_object(col(x), f"$.{name}")


# ---- statements

# The words that mark a statement's frame, in the order in which they win.
FRAMES = (
    ("uncertain", r"\b(may|might|could|possibly|perhaps|likely|unclear|appears to|seems)\b"),
    ("attributed", r"\b(said|says|told|reported|estimated|according to|wants|claims?|claimed|argued|believes?)\b"),
    ("plan", r"\b(will|plans? to|should|expected to|expects?|intends?|proposed?|aims? to|scheduled)\b"),
)


def frame_of(x) -> Column:
    """uncertain, attributed, plan or fact."""
    l = F.lower(text_of(x))
    out = F.lit("fact")
    for name, pat in reversed(FRAMES):
        out = F.when(l.rlike(pat), name).otherwise(out)
    return out


# Words by which a statement denies.
DENIALS = "not never none nothing without neither nor cannot disclaim disclaims prohibit prohibits prohibited".split()


def negated(x) -> Column:
    """Whether a statement denies: by a word of ``DENIALS``, a verb shortened with n't, or a "no" that is not a number's (No. 5)."""
    l = F.lower(text_of(x))
    said = F.regexp_extract_all(l, F.lit(r"\w+(?:['’]t\b)?"), F.lit(0))
    short = F.exists(said, lambda w: w.rlike(".n['’]t$"))
    return F.arrays_overlap(said, F.array(*[F.lit(w) for w in DENIALS])) | short | (F.regexp_count(l, F.lit(r"\bno\b")) > F.regexp_count(l, F.lit(r"\bno\b\.?\s*\d")))


def statements(x) -> Column:
    """A text's statements: lines, and sentences within them."""
    lines = F.split(text_of(x), r"\n+")
    parts = F.flatten(F.transform(lines, lambda l: F.split(l, r"(?<=[.!?])\s+")))
    return F.filter(F.transform(parts, lambda z: F.trim(z)), lambda s: s != "")


def words(x) -> Column:
    """Lower-case words of two characters or more, small bare numbers left out, plural s shed from longer words."""
    raw = F.regexp_extract_all(F.lower(text_of(x)), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*"), F.lit(0))
    trimmed = F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(w, r"['’\-]+$", ""), r"['’]s$", ""))
    kept = F.filter(trimmed, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d{1,2}$"))
    return F.transform(kept, lambda w: F.when((F.length(w) > 4) & w.rlike(r"[^s]s$") & ~w.rlike(r"(ss|us|is)$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.get(tokens, i), F.lit(" "), F.get(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def bag(x) -> Column:
    """The distinct words and word pairs of a statement."""
    w = words(x)
    return F.array_union(F.array_distinct(w), F.array_distinct(bigrams(w)))


CITATION = r"(?i)(?:§+|\b(?:sections?|secs?\.|articles?|art\.|clauses?|cl\.|chapters?|ch\.|paragraphs?|par\.))\s*(\d+(?:\.\d+)*)"


def citations(x) -> Column:
    """Numbers of the sections, articles and clauses a statement cites."""
    return F.regexp_extract_all(text_of(x), F.lit(CITATION), F.lit(1))


# ---- comparing


def similarity(a, b) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    m = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(m == 0, 1.0).otherwise(1 - F.try_divide(F.levenshtein(col(a), col(b)), m))


def jaccard(a, b) -> Column:
    x, y = col(a), col(b)
    u = F.size(F.array_union(x, y))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), u), F.lit(0.0))


def name_raise(a, b, least: float = 0.5) -> Column:
    """Whether a candidate's label is near a name: word overlap of half or more, or one contains the other."""
    x, y = fold(a), fold(b)
    wx, wy = F.array_distinct(F.split(x, r"\W+")), F.array_distinct(F.split(y, r"\W+"))
    return (jaccard(wx, wy) >= least) | x.contains(y) | y.contains(x)


def overlap(s1, e1, s2, e2) -> Column:
    """Whether two half-open spans share a place."""
    return (col(s1) < col(e2)) & (col(s2) < col(e1))


def windows_overlap(s1, e1, s2, e2) -> Column:
    """The same for time windows with open ends: a null start or end bounds nothing."""
    return (F.coalesce(col(s1) <= col(e2), F.lit(True))) & (F.coalesce(col(s2) <= col(e1), F.lit(True)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b) -> Column:
    """Null where a vector is null or zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), n)


# ---- identities and formats


def fnv1a32(x) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes."""
    hexes = F.regexp_extract_all(F.hex(F.encode(text_of(x), "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.aggregate(hexes, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("bigint")) * 16777619).bitwiseAND(F.lit(4294967295)))


def stable_id(*parts) -> Column:
    """A deterministic id of parts; nulls are told apart from empty texts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(col(p).cast("string"), F.lit("\0")) for p in parts])), 256)


def draw(*parts) -> Column:
    """A uniform number in [0, 1) that depends on its parts only, never on partitions. Portable: the first 13 hex digits of
    an MD5."""
    h = F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16**13)


def clock(seconds) -> Column:
    """Seconds as m:ss or h:mm:ss."""
    t = F.floor(col(seconds)).cast("bigint")
    h, m, s = F.floor(t / 3600), F.floor(t / 60) % 60, t % 60
    two = lambda v: F.lpad(v.cast("bigint").cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(m.cast("bigint").cast("string"), F.lit(":"), two(s)))


def clock_seconds(x) -> Column:
    """h:mm:ss, m:ss or plain seconds, with fractions, as seconds."""
    p = F.split(F.regexp_replace(F.trim(text_of(x)), ",", "."), ":")
    v = F.transform(p, lambda y: y.try_cast("double"))
    return F.aggregate(v, F.lit(0.0), lambda s, y: s * 60 + y)


def human_size(n) -> Column:
    v = col(n).cast("double")
    units = ("B", "kB", "MB", "GB", "TB")
    out = F.concat(F.round(v / 1000**4, 1).cast("string"), F.lit(" TB"))
    for i in reversed(range(4)):
        out = F.when(v < 1000 ** (i + 1), F.concat(F.round(v / 1000**i, 0 if i == 0 else 1).cast("bigint" if i == 0 else "double").cast("string"), F.lit(f" {units[i]}"))).otherwise(out)
    return out


def usd(n) -> Column:
    return F.concat(F.lit("$"), F.format_number(col(n).cast("double"), 2))


def ago(then, now) -> Column:
    """How long ago: now, minutes, hours, days."""
    s = F.unix_timestamp(col(now)) - F.unix_timestamp(col(then))
    n = lambda k, u: F.concat(F.floor(s / k).cast("string"), F.lit(f" {u} ago"))
    return F.when(s < 60, "now").when(s < 3600, n(60, "min")).when(s < 86400, n(3600, "h")).otherwise(n(86400, "d"))


def norm_url(x) -> Column:
    """A key for one address: no scheme, no www, no fragment or query, no final slash, lower-case host."""
    s = F.regexp_replace(F.trim(text_of(x)), r"(?i)^[a-z][a-z0-9+.\-]*://", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[#?].*$", ""), r"/+$", "")
    host = F.lower(F.regexp_extract(s, r"^([^/]*)", 1))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_extract(s, r"^[^/]*(.*)$", 1))


def url_host(x) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(text_of(x), r"^(?i:[a-z][a-z0-9+.\-]*://)?([^/?#:]*)", 1)), r"^www\.", "")


def pattern(term: str) -> str:
    """A term as a regular expression: /expression/flags as it stands, * and ? as wildcards within words, else whole words."""
    import re

    if m := re.fullmatch(r"/(.+)/([a-z]*)", term.strip()):
        return (f"(?{''.join(c for c in m[2] if c in 'ims')})" if m[2] else "") + m[1]
    body = "".join({"*": r"\w*", "?": r"\w"}.get(c, re.escape(c)) for c in term.strip())
    return rf"(?i)(?<!\w){body}(?!\w)"
