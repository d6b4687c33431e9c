"""Personal information inside free text: find it and put typed placeholders in its place.

Regular expressions propose spans of five kinds (email, phone, id_number, address, name). Checksum validators confirm them or
refuse them, each by raising or lowering the span's score: the issuing rules for social security numbers, Luhn, mod-97, mod-23
and mod-11 for the identity numbers of other countries, the numbering plan's rules for telephone numbers; a span that lies in a
payment card's (Luhn) or bank account's (mod-97) number is none of the five. Words near a span move its score up or down, and
spans that reach ``ACCEPT`` stand. Of overlapping spans the earlier kind in ``KINDS`` wins.

A name is a run of capitalised words. What speaks for it: a courtesy title, a word before or after it that goes with persons, an
identity number, address or telephone number that was accepted right behind it, a common given name in it; what speaks against it:
an article before it, or a word in or behind it that goes with bodies and places. No list decides alone: given names are also
learned from the corpus, as first words of runs that stand where only persons do, before three surnames or more.

Words cut at a line end are joined and white space is evened out before matching; offsets are mapped back to the stored text.
Null, empty and blank texts have no spans. Repeated rows each get theirs. Offsets are code points, counted from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "id_number", "phone", "address", "name")
ACCEPT = 0.5

# Given names common in English-language registers and among their immigrant communities, with short forms.
GIVEN = set(
    """Aaron Adam Aisha Alan Albert Alexander Ali Alice Amy Ana Anaïs Andre Andrew Angela Ann Anna Anthony Antonio Arthur
    Barbara Ben Benjamin Beth Bill Brian Carl Carlos Carmen Carol Catherine Charles Charlotte Chris Christopher Chuck
    Daniel David Dennis Diana Diane Donald Dorothy Dottie Douglas Edward Elena Elizabeth Emily Emma Eric Eva Fatima
    Frances Francis Frank Gabriel George Gerald Gordon Grace Gregory Hannah Harold Harriet Harry Hector Helen Henry
    Ian Ingrid Isabella Ivan Jack Jacob James Jane Janet Jason Jean Joan John Jonathan Jorge Jose Joseph José Juan
    Judith Julia Julian Karen Kate Katherine Keith Ken Kenneth Kenny Kevin Larry Laura Lawrence Lewis Liam Linda Louis
    Luis Maggie Marcus Margaret Maria Marie Mark Martha Martin Mary Matthew Mei Michael Miguel Nadia Nancy Nathan
    Nathaniel Nicholas Olga Oliver Olivia Omar Ophelia Oscar Patricia Patrick Paul Peter Philip Priya Quentin Ralph
    Raymond Richard Robert Rosa Russell Ruth Samantha Samuel Sandra Sara Sarah Soren Stephen Steven Sue Susan Søren
    Tamara Theodore Thomas Timothy Tom Tony Ulysses Victor Victoria Vincent Walter William Yolanda Yuki Yvonne Zachary
    Zack Zoe Zoë""".split()
)
GIVEN_KEYS = {w.lower() for w in GIVEN}
TITLES = set("mr mrs ms miss dr hon prof rev sir judge capt lt sgt madam mx".split())
PARTICLES = set("de van von der den del la le di da dos du bin al ter st".split())
STREET = "Street|St|Close|Grove|Gardens|Mews|Quay|Walk|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Boulevard|Blvd|Pike|Way|Terrace|Ter|Parkway|Pkwy|Place|Pl|Circle|Cir|Trail|Trl|Highway|Hwy|Square|Sq|Loop|Alley|Plaza|Row|Run|Crescent|Hill|Turnpike"
# Words after which a capitalised pair is a body, a place or a heading rather than a person.
NO_SURNAME = {w.lower() for w in STREET.split("|")} | set(
    """library bridge clinic park hospital school church center centre university college
    committee board authority commission council alliance department office division association associates construction
    company co corp corporation inc incorporated llc pllc llp lp ltd limited partnership services service supply engineering
    consulting electric mechanical paving landscaping equipment management transportation international technologies
    manufacturing architects environmental group partners holdings bank trust foundation district county city state government
    metro metropolitan section article exhibit page form rev agreement contract lease purchase master notice notices events
    vice president managing manager member general counsel chief operating officer director treasurer superintendent project deputy
    assistant secretary chairman chair clerk attorney engineer administrator partner principal mayor executive senior owner contract
    water sewer energy power health police fire library museum contact notify attention dear tenant owner witness call please
    january february march april may june july august september october november december monday tuesday wednesday thursday
    friday saturday sunday the this that and or of for to in on at by with as is are shall may if upon when where no not any every
    each should neither before after under jr sr ii iii iv signed using title date dated address telephone phone fax cell tel
    avenue north south east west suite unit apt creek gate mill ridge bend hollow taxes safety permits warranties
    confidentiality delivery""".split()
)
ORG_AFTER = set("library bridge clinic committee board authority commission council alliance associates construction company corp corporation inc llc pllc lp ltd services supply engineering consulting electric mechanical paving landscaping equipment management transportation international technologies manufacturing architects environmental foundation hospital school street avenue road".split())

CUT = re.compile(r"(?<=[\w@.+)])[-\xad¬‐] ?\r?\n(?=[\w(@])")
SPACE = {c: " " for c in (9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029, 0x2009, 0x202F)}
GLYPH = str.maketrans("1!|05", "lilos")

LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
LOCAL = r"[\w.+%'\-]*\w"
EMAIL = re.compile(
    rf"(?<![\w.+%'\-]){LOCAL}(?:@ ?| @ | ?[\[(] ?at ?[\])] ?){LABEL}(?:(?:\.| ?[\[(] ?dot ?[\])] ?){LABEL})*(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z]{{2,}}", re.I
)
PHONE = re.compile(
    r"(?<![\w$#.\-/@+(])(?:"
    r"\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,5}){1,4}"
    r"|(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}[ .\-]?)\d{3}[ .\-]?\d{4}"
    r"|\d{3}[\-.]\d{4}"
    r")(?![\w]|[\-./]\d)"
)
SSN = re.compile(r"(?<![\w$#.\-/+])\d{3}(?:([ .\-])\d{2}\1\d{4}|\d{6})(?![\w]|[\-./]\d)")
DOCUMENT = re.compile(r"(?<![\w$#.\-/])(?:[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{6,9}|[XYZ\d]\d{7}[A-Z]|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}|\d{7,12})(?![\w]|-\d)")
NUMBERED = re.compile(
    rf"(?<![\w$#.,\-/:])\d{{1,5}}(?:-?[A-Z])?(?:,)? (?:(?:[NSEW]|North|South|East|West|NE|NW|SE|SW)\.? )?(?:[A-Z][\w'’\-]+ ){{1,4}}(?:{STREET})\b\.?"
)
ABROAD = re.compile(
    r"\b(?:(?:Calle|Avenida|Rue|Via|Viale|Rua|Piazza|Plaza|Am|An der|Im|Zum|Zur|Boulevard|Place)(?: (?:de|del|du|des|la|le|los|las|di|da|dos|der|l'))* [A-ZÀ-Þ][\w'’\-]+"
    r"|[A-ZÄÖÜ][\wäöüß\-]{1,40}(?:weg|stra(?:ß|ss)e|str\.|gasse|platz|allee|ufer|damm|ring|laan|straat))(?: [A-ZÀ-Þ][\w'’\-]+)? \d{1,4}[a-z]?(?=, \d{4,5}\b|\b)"
)
#: The number first, then a street named the French, Spanish, Italian or Portuguese way.
NUMBER_FIRST = re.compile(r"(?<![\w$#.,\-/:])\d{1,4}(?: (?:bis|ter))?,? (?:Rue|Calle|Avenida|Via|Viale|Rua|Piazza|Plaza|Place|Quai|Chemin|Impasse|All[ée]e)(?: (?:de|del|du|des|la|le|los|las|di|da|dos|l'))* [A-ZÀ-Þ][\w'’\-]+")
#: A digit misread as a letter inside a number.
MISREAD_DIGIT = re.compile(r"(?<=[\d\-. ()])[lIO|!oSBZb](?=[\d\-])|(?<=\d)[lIO|!oSBZb](?![\w])")
DIGIT = str.maketrans("lIO|!oSBZb", "1101105826")
TITLE_GAP = re.compile(r"\.? {1,2}((?:(?:de|van|von|del|di|da|du|la|le|der|den) )*)")
WORD = re.compile(r"[A-ZÀ-ÖØ-ÞŁŠŽĆČŚŻ](?:[\w'’\-!|]*[\w|])?")

ID_WORDS = re.compile(r"(?i)\b(?:ssn|social security|passport|identity|identification|id card|national id|driv\w+(?:'s)? licen[cs]e|licen[cs]e no|tax id of the)\b")
PASS_WORDS = re.compile(r"(?i)passport|identity|licen[cs]e|id card|id no")
SSN_WORDS = re.compile(r"(?i)\bssn\b|social security|identity|licen[cs]e")
NO_WORDS = re.compile(r"(?i)(?:serial|account|order|part no\.?|lot|parcel|ein|invoice|sku|hours?|weekdays;|ip address:?|tax|item|case|ref(?:erence)?\.?|po|no\.)[ :#]*$")
CALL_WORDS = re.compile(r"(?i)\b(?:tel(?:ephone)?|phone|fax|cell|mobile|call|line|office|contact|alternate|desk|at|ext)\b")
#: What stands right after a person: a suffix, an office, what only people do, what only people have.
PERSON_AFTER = re.compile(
    r"(?i)^(?:,? (?:jr|sr|ii|iii|iv|esq|phd|md)\b\.?)?(?:,? (?:who|whose|himself|herself)\b| \((?:ssn|born|age)|,? (?:holds|holding|born|aged|resides|residing|living|employed|acting)\b"
    r"|,? (?:said|says|told|asked|stated|testified|spoke|wrote|replied|explained|signed|attended|moved that|seconded)\b| (?:will|shall|may|did|could|would) (?:attend|sign|speak|testify|appear|resign|retire|reply)\b"
    r"|,? as (?:its|his|her|their)\b|, (?:fax|phone|tel|cell|e-?mail)\b| <|, (?:(?:vice|deputy|assistant|chief|general|managing|senior|project|contract|executive|operating|financial) )*"
    r"(?:treasurer|owner|counsel|superintendent|manager|member|director|officer|president|chairman|chairwoman|chair|secretary|clerk|attorney|engineer|administrator|partner|principal|mayor|tenant)\b)"
)
#: What stands right before a person.
PERSON_BEFORE = re.compile(
    r"(?i)(?:\b(?:contact|notify|call|calls|dear|attn|attention|c/o|signed(?: by)?|(?:prepared|submitted|represented|witnessed|executed|introduced|approved|written|accompanied|reviewed|sworn|made) by|copies to|sent to|according to|spoke (?:with|to)|met with"
    r"|hand,|witness|tenant|owner|name|applicant|employee|from|cc|designates|appoints|appointed|named|hired|alternate|operator|my name is|between|by order of|thanks to|interviewed|asked)[:;,.]? ?)$"
)
ARTICLE = re.compile(r"(?i)\b(?:the|a|an|this|that|each|every|any|our|its|near)\W?$")


#: A given name and a surname where only persons stand, for learning given names (read by the JVM).
LEARN = (
    r"\b(?:(?:Mr|Ms|Mrs|Dr|Hon|Prof)\.?|Attention:|Attn:?|c/o|Dear|Copies\sto|[Ss]igned\sby|[Cc]ontact)\s([A-Z][a-zà-ÿ'’]+)\s(?:[A-Z]\.\s)?([A-Z][a-zà-ÿ'’]+)"
    r"|\b([A-Z][a-zà-ÿ'’]+)\s(?:[A-Z]\.\s)?([A-Z][a-zà-ÿ'’]+)(?:,\s(?:who\s|holds\s|as\s(?:its|his|her)\s|Jr\b|Sr\b)|\s\(SSN)"
)
#: Surnames behind a word that make it a given name; given names that are learned at most, those before most surnames.
SURNAMES, KNOWN = 3, 100_000


def learn_given(df: DataFrame, text: str) -> frozenset[str]:
    """Given names of the corpus, in lower case, with those of the fixed list. What goes beyond ``KNOWN`` is judged by shape and
    context alone, as any unknown name."""
    part = lambda i: F.regexp_extract("m", LEARN, i)
    m = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(LEARN), F.lit(0))).alias("m"))
    x = m.select(F.lower(F.concat(part(1), part(3))).alias("given"), F.lower(F.concat(part(2), part(4))).alias("surname")).filter(~F.col("given").isin(*NO_SURNAME, *TITLES) & ~F.col("surname").isin(*NO_SURNAME, *TITLES))
    n = x.distinct().groupBy("given").agg(F.count("*").alias("n")).filter(F.col("n") >= SURNAMES)
    return frozenset(r["given"] for r in n.orderBy(F.desc("n"), "given").limit(KNOWN).collect()) | frozenset(GIVEN_KEYS)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an international account number's check digits hold."""
    a = re.sub(r"\W", "", account).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", a):
        return False
    return int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1


def card_or_account(text: str, s: int, e: int) -> bool:
    """Whether the span lies within a payment card's or a bank account's number."""
    a, b = s, e
    while a and (text[a - 1].isalnum() or text[a - 1] in " -" and a > 1 and text[a - 2].isdigit()) and s - a < 34:
        a -= 1
    while b < len(text) and (text[b].isalnum() or text[b] in " -" and b + 1 < len(text) and text[b + 1].isdigit()) and b - e < 34:
        b += 1
    run = text[a:b].strip()
    digits = re.sub(r"\D", "", run)
    return mod97(run) or (13 <= len(digits) <= 19 and digits.isdigit() and not re.search(r"[A-Za-z]", run) and luhn(digits))


def national_id(text: str) -> bool:
    """Whether a number's own check digits hold for one of the personal numbers that have such: nine to twelve digits by Luhn,
    nine by mod 11, eight and a letter by mod 23, thirteen and two by mod 97."""
    x = re.sub(r"[^0-9A-Za-z]", "", text).upper()
    if re.fullmatch(r"[XYZ\d]\d{7}[A-Z]", x):
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(x[:8].translate(str.maketrans("XYZ", "012"))) % 23] == x[8]
    if not x.isdigit():
        return False
    if len(x) == 15:
        return (97 - int(x[:13]) % 97) == int(x[13:])
    eleven = len(x) == 9 and sum(int(d) * w for d, w in zip(x, (9, 8, 7, 6, 5, 4, 3, 2, -1))) % 11 == 0
    return len(x) in (9, 10, 11, 12) and (luhn(x) or eleven)


def plan_ok(number: str) -> bool:
    """Rules of the North American plan, or a length that international numbers have."""
    d = re.sub(r"\D", "", number)
    if number.startswith("+"):
        return 8 <= len(d) <= 15 and (not d.startswith("1") or len(d) == 11 and d[1] not in "01" and d[4] not in "01")
    if len(d) == 11 and d[0] == "1":
        d = d[1:]
    if len(d) == 10:
        return d[0] not in "01" and d[3] not in "01" and d[1:3] != "11"
    return len(d) == 7 and d[0] not in "01"


def ssn_ok(number: str) -> bool:
    d = re.sub(r"\D", "", number)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"


def numbers(t: str) -> list[tuple[float, str, int, int]]:
    out = []
    for m in SSN.finditer(t):
        before = t[max(0, m.start() - 48) : m.start()]
        valid = 0.3 if ssn_ok(m[0]) else 0.15 if national_id(m[0]) else -0.5
        score = valid + (0.2 if m[1] else -0.2) + 0.5 * bool(SSN_WORDS.search(before)) - 0.6 * bool(NO_WORDS.search(before) and not SSN_WORDS.search(before[-28:])) - 0.6 * card_or_account(t, *m.span())
        out.append((score, "id_number", m.start(), m.end()))
    for m in DOCUMENT.finditer(t):
        before = t[max(0, m.start() - 36) : m.start()]
        shape = 0.3 if re.fullmatch(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{3}-\d{4}-\d{4}", m[0]) else 0.2 if m[0][0].isalpha() else 0.1
        near = 0.5 if PASS_WORDS.search(before) else 0.3 if ID_WORDS.search(before) or ID_WORDS.search(t[m.end() : m.end() + 30]) else 0.0
        score = shape + near + 0.2 * national_id(m[0]) - 0.6 * bool(NO_WORDS.search(before) and near < 0.5) - 0.6 * card_or_account(t, *m.span())
        out.append((score, "id_number", m.start(), m.end()))
    for m in PHONE.finditer(t):
        s, e, x = m.start(), m.end(), m[0]
        before = t[max(0, s - 40) : s]
        shape = (0.2 if plan_ok(x) else -0.6) - 0.9 * card_or_account(t, s, e) + (0.3 if x[0] in "+(" or re.search(r"\d[ .\-]\d", x) and len(x) > 9 else 0.0)
        near = bool(CALL_WORDS.search(before)) or bool(re.match(r" ?(?:ext|x ?\d)", t[e : e + 5]))
        score = shape + 0.4 * near - 0.6 * bool(NO_WORDS.search(before)) - 0.5 * bool(SSN_WORDS.search(before[-24:]))
        if re.fullmatch(r"\d{3}[-.]\d{4}", x) and x.startswith("555"):
            score += 0.3
        out.append((score, "phone", s, e))
    return out


def addresses(t: str) -> list[tuple[float, str, int, int]]:
    out = []
    for m in NUMBERED.finditer(t):
        before = t[max(0, m.start() - 12) : m.start()]
        score = 0.7 - 0.5 * bool(re.search(r"(?i)(?:section|exhibit|page|article|no\.|item) ?$", before))
        out.append((score, "address", m.start(), m.end()))
    for m in NUMBER_FIRST.finditer(t):
        out.append((0.6 - 0.5 * bool(re.search(r"(?i)(?:section|exhibit|page|article|no\.|item) ?$", t[max(0, m.start() - 12) : m.start()])), "address", m.start(), m.end()))
    for m in ABROAD.finditer(t):
        town = bool(re.match(r", \d{4,5} [A-ZÀ-Þ]", t[m.end() : m.end() + 12]))
        out.append((0.3 + 0.5 * town + 0.2 * bool(re.search(r"(?i)(?:at|to|resides|c/o|unit)\W*$", t[max(0, m.start() - 10) : m.start()])), "address", m.start(), m.end()))
    return out


def plain(word: str) -> str:
    w = word.lower()
    return w if w.isalpha() else w.translate(GLYPH)


def surname_like(word: str) -> bool:
    w = word.lower().strip(".'’")
    return len(w) > 2 and w not in NO_SURNAME and w not in TITLES and not w.isdigit()


def names(t: str, items: list[tuple[float, str, int, int]] = (), given: frozenset[str] | set[str] = GIVEN_KEYS) -> list[tuple[float, str, int, int]]:
    tok = [(m.start(), m.end(), m[0]) for m in WORD.finditer(t)]
    n, out, i = len(tok), [], 0
    marks = sorted((s, k) for _, k, s, _ in items)

    def has_item(e: int) -> float:
        """What is worth an accepted item right behind a name: identity numbers are persons', bodies have telephones too."""
        j = bisect_right(marks, (e, ""))
        if j == len(marks) or marks[j][0] - e > 30 or re.search(r"[.;!?]", t[e : marks[j][0]]):
            return 0.0
        return 0.35 if marks[j][1] == "id_number" else 0.15

    def last_of(k: int) -> int:
        """The end of the run of capitalised words that k stands in."""
        while k + 1 < n and gap(k) == " " and surname_like(tok[k + 1][2]) and len(tok[k + 1][2]) > 1 and tok[k + 1][2].isupper() == tok[k][2].isupper():
            k += 1
        return k

    def gap(k: int) -> str:
        return t[tok[k][1] : tok[k + 1][0]] if k + 1 < n else ""

    def surname_from(k: int) -> int:
        """The place of the surname when the given part ends at k: past initials and particles; -1 if none follows."""
        while k + 1 < n and gap(k)[:1] in (" ", "."):
            g, w = gap(k), tok[k + 1][2]
            if g[0] == ".":
                if len(tok[k][2]) > 1:
                    return -1
                g = g[1:]
            if any(x.lower() not in PARTICLES for x in g.split()):
                return -1
            if len(w) == 1 and t[tok[k + 1][1] : tok[k + 1][1] + 1] == "." or w.lower() in PARTICLES and k + 2 < n:
                k += 1
                continue
            return k + 1 if surname_like(w) else -1
        return -1

    def body_follows(k: int) -> bool:
        return k + 1 < n and gap(k).strip(" ,") == "" and tok[k + 1][2].lower() in ORG_AFTER or gap(k).strip() in ("&",)

    while i < n:
        s, e, w = tok[i]
        key = plain(w)
        if key in TITLES and i + 1 < n and (between := TITLE_GAP.fullmatch(gap(i))):
            k = i + 1
            if plain(tok[k][2]) in TITLES:
                i += 1
                continue
            last = surname_from(k) if plain(tok[k][2]) in given or len(tok[k][2]) == 1 else -1
            if last < 0 and surname_like(tok[k][2]) and k + 1 < n and gap(k) == " " and surname_like(tok[k + 1][2]) and re.match(r"\s*(?:[,;.(]|$)", t[tok[k + 1][1] : tok[k + 1][1] + 4]):
                last = k + 1
            if last < 0 and k + 1 < n and gap(k).strip() == "," and plain(tok[k + 1][2]) in given:
                last = k + 1
            if last < 0 and surname_like(tok[k][2]):
                last = min(last_of(k), k + 2)  # all of the name, else a part of it would be left in the text
            if last >= 0 and len(tok[last][2]) > 1:
                out.append((0.9, "name", tok[k][0] - len(between[1]), tok[last][1]))
                i = last + 1
                continue
        elif key in given:
            last = surname_from(i)
            if last > 0 and not body_follows(last):
                score = 0.7 + 0.3 * bool(PERSON_AFTER.match(t[tok[last][1] : tok[last][1] + 40])) - 0.5 * bool(ARTICLE.search(t[max(0, s - 8) : s]))
                out.append((score, "name", s, tok[last][1]))
                i = last + 1
                continue
        elif len(w) > 2 and i + 1 < n and gap(i) == ", " and plain(tok[i + 1][2]) in given and surname_like(w):
            k = i + 1
            follows = surname_from(k)
            initial = k + 1 < n and gap(k) == " " and len(tok[k + 1][2]) == 1 and t[tok[k + 1][1] : tok[k + 1][1] + 1] == "."
            if initial or follows < 0:
                at = i
                if at and tok[at - 1][2].lower() in PARTICLES and gap(at - 1) == " ":
                    at -= 1
                start = tok[at][0]
                m = re.search(r"\b(?:(?:de|van|von|del|di|da|du|la|le|der|den) )+$", t[max(0, start - 12) : start])
                if m:
                    start -= len(m[0])
                out.append((0.7, "name", start, tok[k][1]))
                i = k + 1
                continue
        elif len(w) == 1 and gap(i) in (". ", "."):
            last = surname_from(i)
            if last > 0 and not body_follows(last) and not re.search(r"[A-Za-z]\.$", t[max(0, s - 2) : s]):
                upper = tok[last][2].isupper()
                before = t[max(0, s - 24) : s]
                after = t[tok[last][1] : tok[last][1] + 40]
                score = 0.35 + 0.1 * (last - i > 1) + 0.4 * bool(PERSON_AFTER.match(after)) - 0.2 * upper
                score += 0.2 * bool(re.search(r"(?i)(?:to|by|as|and|that|hand,|attention:|tenant:|c/o|designates|call|alternate|operator,|\w,) $", before)) + 0.15 * (not before.strip() or before.rstrip()[-1] in ".;:")
                out.append((score, "name", s, tok[last][1]))
                if score >= ACCEPT:
                    i = last + 1
                    continue
        elif len(w) > 2 and surname_like(w) and not (i and gap(i - 1) == " " and surname_like(tok[i - 1][2])):
            last = surname_from(i)
            if last > 0:
                last = last_of(last)
                before, e = t[max(0, s - 24) : s], tok[last][1]
                if last - i <= 3 and not body_follows(last) and not (last == i + 1 and tok[last][2].isupper() != w.isupper()):
                    score = 0.25 + 0.3 * bool(PERSON_BEFORE.search(before)) + 0.3 * bool(PERSON_AFTER.match(t[e : e + 40])) + has_item(e) - 0.5 * bool(ARTICLE.search(before))
                    out.append((score, "name", s, e))
                    if score >= ACCEPT:
                        i = last + 1
                        continue
        i += 1
    return out


def blanked(t: str, spans: list[tuple[float, str, int, int]]) -> str:
    """The text with blanks for spans."""
    if not spans:
        return t
    out, at = [], 0
    for s, e in sorted((s, e) for _, _, s, e in spans):
        s = max(s, at)
        if e > s:
            out += [t[at:s], " " * (e - s)]
            at = e
    return "".join(out) + t[at:]


def find(text: str | None, given: frozenset[str] | set[str] = GIVEN_KEYS) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the accepted spans, in order; given: known given names in lower case."""
    if not text or text.isspace():
        return []
    gone, t = [], text
    if "\n" in text:
        parts, at, lost = [], 0, 0
        for m in CUT.finditer(text):
            parts.append(text[at : m.start()])
            gone.append((m.start() - lost, m.end() - m.start()))
            lost += m.end() - m.start()
            at = m.end()
        t = "".join(parts) + text[at:] if parts else text
    t = t.translate(SPACE)
    got = []
    if "@" in t or "at)" in t or "at]" in t or "AT)" in t:
        got += [(1.0, "email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    masked = blanked(t, got)
    if any(c.isdigit() for c in masked):
        read = MISREAD_DIGIT.sub(lambda m: m[0].translate(DIGIT), masked)
        found = [x for x in numbers(read) if x[0] >= ACCEPT]
        got += found
        found = [x for x in addresses(masked) if x[0] >= ACCEPT]
        got += found
        masked = blanked(masked, found)
    got += [x for x in names(masked, got, given) if x[0] >= ACCEPT]
    got.sort(key=lambda x: (KINDS.index(x[1]), -x[0], x[2]))
    held: list[tuple[int, int, str]] = []  # in order, free of overlaps
    for _, kind, s, e in got:
        i = bisect_right(held, (s, len(t) + 1, ""))
        if (not i or held[i - 1][1] <= s) and (i == len(held) or held[i][0] >= e):
            held.insert(i, (s, e, kind))
    taken = [(k, s, e) for s, e, k in held]
    if gone:
        at = [p for p, _ in gone]
        add = [0]
        for _, n in gone:
            add.append(add[-1] + n)
        taken = [(k, s + add[bisect_right(at, s)], e + add[bisect_right(at, e - 1)]) for k, s, e in taken]
    return sorted(taken, key=lambda x: x[1])


def replaced(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with [KIND] in place of each span."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def personal_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start_char, end_char): one row per item."""
    kind = df.schema[key].dataType.simpleString()
    given = df.sparkSession.sparkContext.broadcast(learn_given(df, text))

    def run(frames):
        for f in frames:
            rows = [(k, *x) for k, t in zip(f["key"], f["text"]) for x in find(t, given.value)]
            yield pd.DataFrame(rows, columns=["key", "kind", "start_char", "end_char"])

    got = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    return got.mapInPandas(run, f"key {kind}, kind string, start_char bigint, end_char bigint").withColumnRenamed("key", key)


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, redacted, n_items): every row of df; a null text stays null."""
    kind = df.schema[key].dataType.simpleString()
    given = df.sparkSession.sparkContext.broadcast(learn_given(df, text))

    def run(frames):
        for f in frames:
            found = [find(t, given.value) for t in f["text"]]
            yield pd.DataFrame({"key": f["key"], "redacted": [replaced(t, x) for t, x in zip(f["text"], found)], "n_items": [len(x) for x in found]})

    got = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return got.mapInPandas(run, f"key {kind}, redacted string, n_items int").withColumnRenamed("key", key)
