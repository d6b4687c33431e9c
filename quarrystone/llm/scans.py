"""Noise in text from scanned pages: words cut at line ends, misread characters, running headers and page numbers.

Learned from the whole corpus, as tables joined by key:

* counts of all words, of hyphenated compounds and of what stands on either side of line ends with a hyphen;
* skip-gram vectors with negative sampling: the counts of each word beside the ``CONTEXTS`` most used words, ``SPAN`` places
  either way, are summed in one exchange, and the skip-gram objective over these sums is followed to its maximum by full
  gradients (what stochastic passes over the text estimate). The context vectors are fitted on all words: each task keeps its
  share of them, and only the contexts' gradients are told from task to task. ``CONTEXTS`` is the width of the model: neighbours
  beyond them are not counted;
* links of rare words to frequent neighbours: words whose letters are made of the same strokes meet in one bucket, a glyph
  alignment counts the misreadings between them, and the link stands if the frequent word's vector explains the contexts of
  the rare one well enough for how much more frequent it is. Without a vector there is no link;
* the folded shapes of lines that stand at page breaks.

Then, record by record: page numbers and running headers are found and taken out, also within a sentence; words cut at a line
end are joined unless the corpus writes them with a hyphen; misread words are replaced by the linked word whose vector fits
the words around best, misread digits by digits; and lines are joined into paragraphs.

Up to ``AT_ONCE`` entries the links, breaks and shapes are broadcast; beyond, each record's words are joined with them. Both
ways give the same. Nulls give no kinds and stay null; empty and blank texts come out empty.
"""

from __future__ import annotations

import re
import secrets
import socket
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.session import cut

CONTEXTS, DIM, SPAN, NEGATIVE = 256, 32, 2, 5
#: Words whose gradients are made at once; tasks that fit at most, as each is told of all others' gradients; what one unit of
#: a told gradient is worth: sums of whole numbers are the same in whatever order and however many tasks.
BUCKET, TASKS, UNIT = 500, 16, 2.0**-32
#: How many times as frequent, and how often used, a word must be to be what another was misread from.
MORE, LEAST = 2, 6
#: What a link must reach (see ``link_score``): words of letters, words of up to 3 letters, words that hold other signs.
BAR, BAR_SHORT, BAR_ODD = 1.5, 4.5, -1.0
#: Misreadings within one word, at most; what a second one takes off the score; what a letter beyond four adds.
MISREADINGS, SECOND, LETTER = 2, 1.0, 1.0
#: A printed line's width: what is longer is no running line.
WIDTH = 120
#: Entries of links, breaks and shapes that are broadcast at most, and the words kept at hand as known to be fine beyond that.
AT_ONCE, FINE = 200_000, 50_000

# What a scanner reads, and what may have stood there.
MISREAD = {
    "c": "e", "e": "c", "f": "t", "t": "f", "1": "i l", "!": "i l", "|": "l i", "l": "i", "i": "l", "0": "o", "5": "s", "8": "b",
    "6": "b", "9": "g", "b": "h", "h": "b", "q": "g", "g": "q", "y": "v", "v": "y", "u": "n", "n": "u", "m": "rn in", "d": "cl",
    "w": "vv", "$": "s", "@": "a", "2": "z", "ri": "n", "cl": "d", "ii": "u", "rn": "m", "vv": "w", "li": "h", "nn": "rm",
    "ä": "a", "á": "a", "à": "a", "â": "a", "å": "a", "ó": "o", "ò": "o", "ö": "o", "ô": "o", "é": "e", "è": "e", "ê": "e", "ë": "e",
    "í": "i", "ì": "i", "ï": "i", "ú": "u", "ù": "u", "ü": "u", "ñ": "n", "ç": "c",
}
MISREAD = {k: v.split() for k, v in MISREAD.items()}
#: Letters by strokes: whatever may be read for each other has the same. Fixed values, they follow from MISREAD.
STROKES = {"e": "c", "f": "t", "i": "l", "1": "l", "!": "l", "|": "l", "r": "l", "n": "ll", "u": "ll", "h": "ll", "b": "ll", "8": "ll", "6": "ll", "m": "lll", "d": "cl", "w": "vv", "y": "v", "q": "g", "9": "g", "5": "s", "$": "s", "@": "a", "2": "z", "0": "o"}
STROKES |= {k: STROKES.get(v[0], v[0]) for k, v in MISREAD.items() if not k.isascii()}
STROKES = str.maketrans(STROKES)
DIGIT = str.maketrans("OoDQlI|!iZzSsbBgq", "00001111122556899")

TOKEN = re.compile(r"[!|]?[^\W_]+(?:[!|$]+[^\W_]+)*\|?")
CHAIN = re.compile(r"[!|]?[^\W_]+(?:[!|$\-]+[^\W_]+)*\|?")
BREAK = re.compile(r"([-\xad¬]) ?\n+(?=[^\W\d_])")
#: The word at a line end that a hyphen cuts, hyphens within it included.
LEFT = re.compile(r"([^\W_](?:[\w!|\-]*[\w!|])?)[-\xad¬] ?$")
HEAD = re.compile(r"[^\W_]+(?:[!|]+[^\W_]+)*")
#: A letter that no text holds, for line ends within words: what is joined by it is no word that the corpus wrote.
JOINT, CUT_AT = "\ufb17", re.compile(r"[-\xad¬] ?\n+")
SKIP = re.compile(r"(?<!\S)(?:\S*(?:@|\[at\]|\(at\)|://|www\.)\S*|\S+\s?\[dot\]\s?\S+|\S+ (?:\[at\]|@) \S+)")
NUMBERISH = re.compile(r"(?<![\w@])[$(#+]{0,3}[\dOolIZSbB|][\dOolIZSbB|,./():%\-]*(?![\w@])")
LEGIT_NUMBER = re.compile(r"\d{1,5}-?[A-D]|[A-Z]\d{6,9}|[A-Z]{1,2}\d{6}[A-D]|\d+(?:st|nd|rd|th|s)|[A-Z]{1,2}\d{1,2}|[lISobBZO|.,()/:%\-]+")
PAGE_LINE = re.compile(r"(?i)\s*(?:[-–—~\[(*]\s?\d{1,4}\s?[-–—~\])*]|p(?:q|g|aq[ec]|ag[ec])?\.? ?\d{1,4}(?: [o0][ft] \d{1,4})?|\d{1,4} ?\| ?p ?a ?[gq] ?[ec]|p ?a ?[gq] ?[ec] \d{1,4}(?: ?[o0][ft] ?\d{1,4}|/\d{1,4})?)\s*")
PAGE_TAIL = re.compile(r"(?i)[.\s|–—-]+p ?[aä] ?[gq] ?[ec]\.? \d{1,4}(?: [o0óö][ft] \d{1,4})?\s*$")
EMPTY_LINE = re.compile(r"\n[ \t]*\n+")
ALIKE = re.compile(r"[\dlIO|ZSB]+")
BARE = re.compile(r"\s*\d{1,4}\s*")
SECTION = re.compile(r"\s*(?:\d{1,3}|[IVX]+|SECTION|ARTICLE|EXHIBIT)\b[.\s:)]+[^a-z]*$")
FOLDS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"))
FOLD = str.maketrans("e1!|io0öóò5$8h9qfyäàáâåéèëüúùï", "clllloooooss" + "bbggtvaaaaaccc" + "uuul")


def digits(token: str) -> str:
    return token.translate(DIGIT)


def number_misread(token: str) -> bool:
    """Whether a token is a number with letters read for digits."""
    core = token.strip("().,;:$#+%[]~\"'")
    if not core or core.isdigit() or not any(c.isdigit() for c in core) or not any(c.isalpha() or c in "|!" for c in core):
        return False
    if LEGIT_NUMBER.fullmatch(core) and not re.fullmatch(r"(?:[lIOoZSb|]\d+|\d+[lIOoZS|]\d*)", core):
        return False
    if re.search(r"-[A-D]$", core) or re.fullmatch(r"[A-Z]\d{6,}|[A-Z]{2}\d{6}[A-D]", core):
        return False
    return bool(re.fullmatch(r"[\d,./:()%\-]+", digits(core))) and not re.search(r"[A-Za-z]{2,}", re.sub(r"[lIOoZSbB]", "", core))


def fold(line: str) -> str:
    """A line's shape: numbers and references as one sign, letters that scanners confuse as one letter, case and blanks out."""
    s = PAGE_TAIL.sub(" #page", line.replace("\x0c", " "))
    s = re.sub(r"\b[A-Z]{1,4}-[\dOolIZSbB|]+(?: A[\dlI])?", "@", s)
    out = []
    for w in s.split():
        d = digits(w) if any(c.isdigit() for c in w) or len(w) < 4 else w
        if re.fullmatch(r"[(\[]*[\d,./()\-]+[)\].,]*", d):
            out.append("9")
            continue
        w = w.lower()
        for a, b in FOLDS:
            w = w.replace(a, b)
        out.append(w.translate(FOLD))
    return " ".join(out)


def misreads(read: str, meant: str, most: int = MISREADINGS) -> int:
    """How many misreadings make one word of the other; most + 1 beyond. No rule begins with the letter it stands for, so equal
    letters may be passed over at once."""
    i = j = 0
    while i < len(read) and j < len(meant) and read[i] == meant[j]:
        i, j = i + 1, j + 1
    if i == len(read) and j == len(meant):
        return 0
    best = most + 1
    if most:
        for n in (1, 2):
            for r in MISREAD.get(read[i : i + n], ()) if i + n <= len(read) else ():
                if meant.startswith(r, j):
                    best = min(best, 1 + misreads(read[i + n :], meant[j + len(r) :], most - 1))
    return best


def is_odd(word: str) -> bool:
    """Letters and other signs in one word."""
    return not word.isalpha() and any(c.isalpha() for c in word)


# ------------------------------------------------------------------ learning


def lines_of(text: str) -> list[str]:
    return re.sub(r"\r\n?", "\n", text).split("\n")


def break_shapes(lines: list[str]):
    """(shape, the words before and after, whether it stands at a page break) of lines that are capitalised rather than flowing."""
    n = len(lines)
    for i in range(1, n - 1):
        s = lines[i].strip()
        if not 6 <= len(s) <= WIDTH or not (s[0].isupper() or s[0].isdigit() or s[0] in "|![") or "@" in s or "\t" in s:
            continue
        words = s.split()
        alpha = [w for w in words if w[0].isalpha()]
        if len(words) > 14 or s[-1] in ",;" or sum(w[0].isupper() for w in alpha) < 0.65 * len(alpha) or SECTION.fullmatch(s):
            continue
        before, after = lines[i - 1].rstrip(), lines[i + 1].lstrip()
        at = (
            "\x0c" in lines[i]
            or bool(PAGE_LINE.fullmatch(digits_line(before)) or PAGE_LINE.fullmatch(digits_line(after)) or PAGE_TAIL.search(s))
            or bool(before) and before[-1] not in ".:;!?_" and after[:1].islower()
        )
        yield fold(s), f"{before.split()[-1] if before.split() else ''} {after.split()[0] if after.split() else ''}", at


def digits_line(line: str) -> str:
    """A short line with its numbers read as digits."""
    if len(line) > 24:
        return line
    return re.sub(r"[\dOolIZSbB|]*\d[\dOolIZSbB]*|(?<=[\-~\[ ])[lIOoSZB]{1,3}(?=[\-~\] ]|$)", lambda m: digits(m[0]), line)


def take_apart(between: Counter, chains: Counter) -> None:
    for raw, n in between.items():
        for c in CHAIN.findall(raw):
            chains[c] += n
    between.clear()


def page_breaks(lines: list[str]):
    """(left, right) of words that a hyphen at a line end may cut, with up to three lines of furniture between."""
    for i, line in enumerate(lines):
        if line.endswith(("-", "- ")) and (left := LEFT.search(line)):
            for k in range(i + 1, min(i + 5, len(lines))):
                if right := HEAD.match(lines[k]):
                    yield left[1], right[0]
                if len(lines[k]) > WIDTH:
                    break


def learn_counts(df: DataFrame) -> DataFrame:
    """(what, key, n, m, places): w a word's uses (0 if it only stands cut in two), h a compound's, b a word cut by a hyphen at a
    line end (m: whether anything but the corpus' use speaks for keeping the hyphen), s a shape's lines, those at page breaks,
    and between how many different words they stand there (a passage that is copied has one place, however often)."""

    def run(frames):
        chains: Counter = Counter()
        between: Counter = Counter()  # what stands between blanks: few enough to take apart once each
        shapes: dict = defaultdict(lambda: [0, 0])
        cuts: dict = defaultdict(lambda: [0, 0])
        for f in frames:
            for t in f["text"]:
                if "\n" in t or "\r" in t:
                    lines = lines_of(t)
                    for k, place, at in break_shapes(lines):
                        x = shapes[k, place]
                        x[0] += 1
                        x[1] += at
                    for left, right in page_breaks(lines):
                        x = cuts[f"{left}-{right}".lower()]
                        x[0] += 1
                        x[1] |= right[:1].isupper() or not left.isalpha() and "-" not in left
                    t = CUT_AT.sub(JOINT, t)
                between.update(t.split())
            if len(between) > 500_000:
                take_apart(between, chains)
        take_apart(between, chains)
        words: Counter = Counter()
        compounds: Counter = Counter()
        for c, n in chains.items():
            c = c.lower()
            if JOINT in c:
                words[c.replace(JOINT, "").rpartition("-")[2]] += 0
            elif "-" in c:
                c = c.strip("!|")
                compounds[c] += n
                for p in c.split("-"):
                    words[p] += n
            else:
                words[c] += n
        rows = [("w", w, None, n, 0) for w, n in words.items() if not w.isdigit()]
        rows += [("h", w, None, n, 0) for w, n in compounds.items() if not any(c.isdigit() for c in w)]
        rows += [("b", w, None, n, m) for w, (n, m) in cuts.items()]
        rows += [("s", k, p, n, m) for (k, p), (n, m) in shapes.items()]
        yield pd.DataFrame(rows, columns=["what", "key", "place", "n", "m"]).astype({"place": object})

    got = df.select("text").mapInPandas(run, "what string, key string, place string, n bigint, m bigint")
    return cut(got.groupBy("what", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count_distinct(F.when(F.col("m") > 0, F.col("place"))).alias("places")), "counts")


class Tokens(dict):
    """What stands between blanks to its words; emptied when full."""

    def __missing__(self, raw: str) -> list[str]:
        got = [w for c in CHAIN.findall(raw.lower()) for w in (c.strip("!|").split("-") if "-" in c else (c,))]
        if len(raw) <= 40:
            if len(self) > 500_000:
                self.clear()
            self[raw] = got
        return got


def context_counts(df: DataFrame, basis: list[str]) -> DataFrame:
    """(word, cs, ns): how often each word stands beside each of the basis, by its number there. At most as many entries a word as
    the basis has."""
    size = len(basis)

    def run(frames):
        place = {w: i for i, w in enumerate(basis)}
        number: dict[str, int] = {}
        tokens = Tokens()
        part: list[int] = []
        sums: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush():
            x = np.array(part, np.int64)
            part.clear()
            names = np.array([place.get(w, -1) for w in number] or [-1], np.int64)
            c = np.where(x >= 0, names[x], -1)
            keys = []
            for d in range(1, SPAN + 1):
                for a, b in ((x[:-d], c[d:]), (x[d:], c[:-d])):
                    ok = (a >= 0) & (b >= 0)
                    keys.append(a[ok] * size + b[ok])
            k, n = np.unique(np.concatenate(keys), return_counts=True)
            sums.append(k), counts.append(n)
            if len(sums) > 8:
                fold_in()

        def fold_in():
            k, at = np.unique(np.concatenate(sums), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            sums[:], counts[:] = [k], [n]

        for f in frames:
            for t in f["text"]:
                for raw in CUT_AT.sub("", t).split():
                    for w in tokens[raw]:
                        part.append(number.setdefault(w, len(number)) if not w.isdigit() else -1)
                part.extend([-1] * SPAN)
                if len(part) > 2_000_000:
                    flush()
        if len(part) > SPAN:
            flush()
        if sums:
            fold_in()
            names = list(number)
            yield pd.DataFrame({"word": [names[i] for i in sums[0] // size], "c": (sums[0] % size).astype(np.int32), "n": counts[0]})

    pairs = df.select("text").mapInPandas(run, "word string, c int, n bigint").groupBy("word", "c").agg(F.sum("n").alias("n"))
    rows = pairs.groupBy("word").agg(F.collect_list(F.struct("c", "n")).alias("x"))
    return cut(rows.select("word", F.col("x.c").alias("cs"), F.col("x.n").alias("ns")), "contexts")


def dense(cs, ns, size: int) -> np.ndarray:
    x = np.zeros((len(cs), size), np.float32)
    for i, (c, n) in enumerate(zip(cs, ns)):
        x[i, np.asarray(c, np.int64)] = n
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Climb:
    """Follows gradients upwards (Adam), in place."""

    def __init__(self, part: np.ndarray, rate: float):
        self.part, self.rate, self.m, self.s, self.t = part, rate, np.zeros_like(part), np.zeros_like(part), 0

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.s = 0.99 * self.s + 0.01 * g * g
        self.part += self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.s / (1 - 0.99**self.t)) + 1e-8)


def pull(p: np.ndarray, v: np.ndarray, u: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The objective's slope by v u, for each word and context."""
    q = sigmoid(v @ u.T)
    q *= p + NEGATIVE * noise
    return np.subtract(p, q, out=q)


def whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x.astype(np.float64) / UNIT).astype(np.int64)


def train(buckets: list[tuple[int, np.ndarray]], size: int, total=lambda x: x, steps: int = 150, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(context vectors, noise): skip-gram with negative sampling over the summed counts of words (rows) beside contexts: for each
    word the mean over its uses of log s(v u) and of NEGATIVE draws of log s(-v u), draws by counts to the power 3/4. buckets:
    (number, counts) of the words that are here; total sums whole numbers over wherever other words are."""
    words = []
    beside, weights = np.zeros(size, np.int64), np.zeros(1, np.int64)
    for k, x in buckets:
        n = x.sum(1, keepdims=True)
        beside += x.sum(0, dtype=np.float64).astype(np.int64)
        weight = (n / (n + 50)).astype(np.float32)
        weights += whole(weight.sum(dtype=np.float64, keepdims=True)[0])
        v = 0.1 * np.random.default_rng([seed, k]).standard_normal((len(x), DIM)).astype(np.float32)
        words.append((x / np.maximum(n, 1), weight, Climb(v, 0.05)))
    sums = total(np.concatenate([beside, weights]))
    noise = sums[:size] ** 0.75
    noise = (noise / max(noise.sum(), 1e-9)).astype(np.float32)
    scale = size / max(1.0, float(sums[size]) * UNIT)
    up = Climb(0.1 * np.random.default_rng(seed).standard_normal((size, DIM)).astype(np.float32), 0.05)
    for _ in range(steps):
        u = up.part
        gu = np.zeros((size, DIM), np.int64)
        for p, weight, c in words:
            g = pull(p, c.part, u, noise)
            gu += whole(g.T @ (weight * c.part))
            c.step(g @ u - 0.002 * c.part)
        up.step((total(gu) * (UNIT * scale)).astype(np.float32) - 0.002 * u)
    return up.part, noise


class Together:
    """Sums arrays of whole numbers over the tasks of a barrier stage: the others send theirs to the first, which sends back the
    sum. Spark's own exchange is only used to tell where that one listens, as each of its rounds waits for a second."""

    def __init__(self):
        ctx = BarrierTaskContext.get()
        tasks = ctx.getTaskInfos()
        self.first, self.ends, said = ctx.partitionId() == 0, [], ""
        if self.first:
            server, token = socket.create_server(("", 0)), secrets.token_hex(16)
            said = f"{tasks[0].address.partition(':')[0]} {server.getsockname()[1]} {token}"
        host, port, token = ctx.allGather(said)[0].split()
        if not self.first:
            end = socket.create_connection((host, int(port)), 60)
            end.sendall(token.encode())
            self.add(end, end.makefile("rb"))
            return
        server.settimeout(60)
        while len(self.ends) < len(tasks) - 1:
            end, _ = server.accept()
            end.settimeout(60)
            if (got := end.makefile("rb")).read(len(token)) == token.encode():
                self.add(end, got)
        server.close()

    def add(self, end: socket.socket, reader) -> None:
        end.settimeout(None)
        end.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.ends.append((end, reader))

    def read(self, reader, like: np.ndarray) -> np.ndarray:
        got = reader.read(like.nbytes)
        if len(got) < like.nbytes:
            raise ConnectionError("a task of the fit has ended")
        return np.frombuffer(got, like.dtype).reshape(like.shape)

    def total(self, x: np.ndarray) -> np.ndarray:
        if self.first:
            x = sum((self.read(reader, x) for _, reader in self.ends), x)
        for end, _ in self.ends:
            end.sendall(x.tobytes())
        return x if self.first else self.read(self.ends[0][1], x)


def tasks_at_once(spark) -> int:
    """Half of the tasks that can run at the same time, so that they find room again when an executor is lost; 1 where executors come
    and go, as tasks that wait for each other aren't possible there."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    jsc = sc._jsc.sc()
    return max(1, jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile()) // 2)


def fit_contexts(ctx: DataFrame, size: int, tasks: int = TASKS) -> tuple[np.ndarray, np.ndarray]:
    """What ``train`` gives for all words of ctx (word, cs, ns). Words fall into buckets by hash and stay where they are; the
    tasks take each step together, and how many there are makes no difference."""
    n = ctx.count()
    if not n:
        return np.zeros((size, DIM), np.float32), np.zeros(size, np.float32)
    buckets = -(-n // BUCKET)
    tasks = min(tasks, buckets, tasks_at_once(ctx.sparkSession))

    def run(frames):
        mine: dict[int, list] = defaultdict(list)
        for f in frames:
            for k, w, cs, ns in zip(f["b"], f["word"], f["cs"], f["ns"]):
                mine[k].append((w, cs, ns))
        ready = []
        for k in sorted(mine):
            rows = sorted(mine.pop(k), key=lambda r: r[0])
            ready.append((k, dense([r[1] for r in rows], [r[2] for r in rows], size)))
        u, noise = train(ready, size, Together().total if tasks > 1 else lambda x: x)
        if tasks == 1 or BarrierTaskContext.get().partitionId() == 0:
            yield pd.DataFrame({"c": range(size), "vec": list(u), "noise": noise})

    at = ctx.select("word", "cs", "ns", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int").alias("b")).repartitionById(tasks, "b")
    got = at.mapInPandas(run, "c int, vec array<float>, noise float", barrier=tasks > 1).toPandas().sort_values("c")
    return np.stack(got["vec"].to_numpy()).astype(np.float32), got["noise"].to_numpy(np.float32)


def vectors(x: np.ndarray, u: np.ndarray, noise: np.ndarray, steps: int = 30) -> np.ndarray:
    """Vectors of words by the same objective with the contexts held."""
    v = np.zeros((len(x), u.shape[1]), np.float32)
    for i in range(0, len(x), BUCKET):
        p = x[i : i + BUCKET] / np.maximum(x[i : i + BUCKET].sum(1, keepdims=True), 1)
        c = Climb(v[i : i + BUCKET], 0.1)
        for _ in range(steps):
            c.step(pull(p, c.part, u, noise) @ u - 0.002 * c.part)
    return v


def link_score(word: str, n: int, f: int, k: int, counts: np.ndarray, fit: np.ndarray, own: np.ndarray) -> float:
    """How well a word used f times explains one used n times, k misreadings away: the logarithm of their ratio; a letter's worth for
    each letter beyond four, as long words are seldom alike by chance; and the evidence of the frequent word's vector for the
    contexts of the rare one (v u + log NEGATIVE estimates how much likelier a context is beside it than anywhere), per root
    of their number, as contexts that are copied tell nothing new. Minus infinity where the word's own uses ask for a vector
    of its own, by clearly more than what as many numbers cost."""
    c = max(1.0, float(counts.sum()))
    if counts @ (own - fit) > 1.5 * DIM * np.log(c) + DIM:
        return -np.inf
    return float(np.log(f / max(1, n)) + LETTER * max(0, len(word) - 4) - SECOND * (k - 1) + (counts @ (fit + np.log(NEGATIVE))) / np.sqrt(c))


def word_links(counts: DataFrame, ctx: DataFrame, u: np.ndarray, noise: np.ndarray) -> DataFrame:
    """(word, links): what each word may have been misread from: target, misreadings k, score and, where there are several, vector."""

    def keyed(frames):
        for f in frames:
            f = f[[len(w) > 1 for w in f["word"]]]
            yield f.assign(key=[w.translate(STROKES) for w in f["word"]])

    words = counts.filter("what = 'w'").select(F.col("key").alias("word"), "n").mapInPandas(keyed, "word string, n bigint, key string")
    often = words.filter((F.col("n") >= LEAST) & ~F.col("word").rlike(r"[^\p{L}]")).select(F.col("word").alias("target"), F.col("n").alias("f"), "key")
    pairs = words.join(often, "key").filter((F.col("word") != F.col("target")) & (F.col("f") >= MORE * F.greatest("n", F.lit(1))))

    def near(frames):
        for f in frames:
            yield f.assign(k=[misreads(a, b) for a, b in zip(f["word"], f["target"])]).query(f"k <= {MISREADINGS}")

    pairs = cut(pairs.select("word", "n", "target", "f").mapInPandas(near, "word string, n bigint, target string, f bigint, k int"), "glyphs")

    def vector(frames):
        for f in frames:
            yield pd.DataFrame({"target": f["word"], "vec": list(vectors(dense(f["cs"], f["ns"], len(u)), u, noise))})

    targets = ctx.join(pairs.select(F.col("target").alias("word")).distinct(), "word").mapInPandas(vector, "target string, vec array<float>")

    def scored(frames):
        for f in frames:
            if not len(f):
                continue
            x = dense(f["cs"], f["ns"], len(u))
            fits, owns = np.stack(f["vec"].to_numpy()) @ u.T, vectors(x, u, noise) @ u.T
            got = [link_score(w, int(n), int(m), int(k), x[i], fits[i], owns[i]) for i, (w, n, m, k) in enumerate(zip(f["word"], f["n"], f["f"], f["k"]))]
            bars = [BAR_ODD if is_odd(w) else BAR if len(w) > 3 else BAR_SHORT for w in f["word"]]
            yield f.assign(score=got)[["word", "target", "k", "score", "vec"]][np.array(got) >= np.array(bars)]

    none = F.array().cast("array<int>")
    full = pairs.join(targets, "target").join(ctx, "word", "left").withColumns({"cs": F.coalesce("cs", none), "ns": F.coalesce("ns", none.cast("array<bigint>"))})
    links = full.select("word", "n", "target", "f", "k", "cs", "ns", "vec").mapInPandas(scored, "word string, target string, k int, score double, vec array<float>")
    g = links.groupBy("word").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "target", "k", "vec"))).alias("links"))
    return g.withColumn("links", F.when(F.size("links") > 1, F.col("links")).otherwise(F.transform("links", lambda x: x.withField("vec", F.lit(None).cast("array<float>")))))


def break_verdicts(counts: DataFrame) -> DataFrame:
    """(key, cut): of words with a hyphen at a line end (left-right), whether the corpus writes them as one rather than with a hyphen;
    only those for which that differs from what is done without it: a hyphen kept, or a join in spite of capitals or odd signs."""
    b = counts.filter("what = 'b'").select("key", F.col("m").alias("odd"), F.regexp_replace("key", "-(?=[^-]*$)", "").alias("whole"), F.regexp_extract("key", "([^-]*)-([^-]*)$", 1).alias("l"), F.substring_index("key", "-", -1).alias("r"))
    w = counts.filter("what = 'w' and n > 0").select(F.col("key").alias("one"), F.col("n").alias("n1"))
    h = counts.filter("what = 'h'").select(F.col("key").alias("two"), F.col("n").alias("n2"))

    def strokes(frames):
        for f in frames:
            yield f.assign(k=[x.translate(STROKES) for x in f.iloc[:, 0]])

    x = (
        b.join(w, F.concat("l", "r") == F.col("one"), "left")
        .join(h.select(F.col("two").alias("t3"), F.col("n2").alias("n3")), F.col("whole") == F.col("t3"), "left")
        .join(h, F.col("key") == F.col("two"), "left")
        .select("key", "odd", F.greatest(F.coalesce("n1", F.lit(0)), F.coalesce("n3", F.lit(0))).alias("joined"), F.coalesce("n2", F.lit(0)).alias("kept"))
    )
    # A compound whose halves were misread still looks like one.
    def same(frames):
        for f in frames:
            yield f[[misreads(a, c) <= MISREADINGS for a, c in zip(f["key"], f["two"])]][["key", "n2"]]

    odd = x.filter("kept = 0").select("key").mapInPandas(strokes, "key string, k string").join(h.mapInPandas(strokes, "two string, n2 bigint, k string"), "k").select("key", "two", "n2")
    like = odd.mapInPandas(same, "key string, n2 bigint").groupBy("key").agg(F.max("n2").alias("alike"))
    y = x.join(like, "key", "left").withColumn("kept", F.greatest("kept", F.coalesce("alike", F.lit(0))))
    return y.filter("kept + joined > 0 and (kept >= joined or odd > 0)").select("key", (F.col("joined") > F.col("kept")).alias("cut"))


class Learned:
    """What the corpus taught: entries (what, key, cut, links) as a written table, the basis and its vectors."""

    def __init__(self, entries: DataFrame, fine: DataFrame, basis: list[str], u: np.ndarray):
        self.entries, self.fine, self.basis, self.u = entries, fine, basis, u


def learn(df: DataFrame) -> Learned:
    """df: a column text, not null."""
    c = learn_counts(df)
    words = c.filter("what = 'w' and n > 0").select(F.col("key").alias("word"), "n")
    basis = [r["word"] for r in words.filter(~F.col("word").rlike(r"[^\p{L}]")).orderBy(F.desc("n"), "word").limit(CONTEXTS).collect()]
    ctx = context_counts(df, basis)
    u, noise = fit_contexts(ctx, len(basis))
    links = cut(word_links(c, ctx, u, noise), "links")
    none = F.lit(None).cast(links.schema["links"].dataType)
    entries = (
        links.select(F.lit("w").alias("what"), F.col("word").alias("key"), F.lit(None).cast("boolean").alias("cut"), "links")
        .unionByName(break_verdicts(c).select(F.lit("b").alias("what"), "key", "cut", none.alias("links")))
        .unionByName(c.filter("what = 's' and places >= 3 and m >= 0.5 * n").select(F.lit("s").alias("what"), "key", F.lit(None).cast("boolean").alias("cut"), none.alias("links")))
    )
    return Learned(cut(entries, "entries"), words.join(links, "word", "left_anti"), basis, u)


WORDS = re.compile(r"[^\W\d_]+")


class Model:
    """Entries at hand: of the whole corpus, or those that one record asks for."""

    def __init__(self, entries, basis: list[str], u: np.ndarray):
        self.words, self.breaks, self.shapes = {}, {}, set()
        for what, key, cut_, links in entries:
            if what == "w":
                self.words[key] = list(links)
            elif what == "b":
                self.breaks[key] = cut_
            else:
                self.shapes.add(key)
        self.place, self.u = {w: i for i, w in enumerate(basis)}, u
        self.fine: set[str] = set()
        self.starts = {k.split(" ")[0] for k in self.shapes}
        self.may_start: dict[str, bool] = {}

    def starts_line(self, word: str) -> bool:
        got = self.may_start.get(word)
        if got is None:
            if len(self.may_start) > 100_000:
                self.may_start.clear()
            got = self.may_start[word] = fold(word) in self.starts
        return got

    def suspects(self, text: str) -> set[str]:
        """Tokens of a text that may be misread. What stands between blanks and was found fine is remembered as it stands, so most
        of a text costs one look into a set."""
        out = set()
        fine = self.fine
        for raw in set(text.split()) - fine:
            bad = False
            for t in TOKEN.findall(raw):
                if t.isdigit() or len(t) < 2:
                    continue
                if t.lower() in self.words or any(c.isdigit() for c in t) and digits(t).isdigit():
                    out.add(t)
                    bad = True
            if not bad and len(raw) <= 40:
                if len(fine) > 500_000:
                    fine.clear()
                fine.add(raw)
        return out

    def pick(self, links: list, around: list[str]) -> str:
        """The linked word that fits the words around it best."""
        if len(links) == 1:
            return links[0]["target"]
        at = [i for w in around if (i := self.place.get(w)) is not None]

        def fit(x):
            return -x["less"] + (float((self.u[at] @ np.asarray(x["vec"], np.float32)).sum()) if at else 0.0)

        return max(links, key=fit)["target"]

    def is_cut(self, left: str, right: str, mark: str) -> bool:
        """Whether left and right are one word cut at a line end rather than a compound with its own hyphen there."""
        if mark != "-":
            return True
        left = left.strip("-")
        got = self.breaks.get(f"{left}-{right}".lower())
        if got is not None:
            return got
        if not left.isalpha() and "-" not in left:
            return False
        return not right[:1].isupper() or left.isupper() and right.isupper()


# ------------------------------------------------------------------ repairing


def furniture(lines: list[str], model: Model) -> dict[int, set[str]]:
    """Places of lines that are page numbers or running headers, with their kinds."""
    out: dict[int, set[str]] = {}
    n = len(lines)
    for i, line in enumerate(lines):
        s = line.replace("\x0c", " ").strip()
        if not s or len(s) > WIDTH or "\t" in s:
            continue
        short = digits(s) if len(s) <= 3 and ALIKE.fullmatch(s) else digits_line(s)
        if len(s) <= 24 and PAGE_LINE.fullmatch(short):
            out[i] = {"page_number"}
        elif len(s) <= 6 and BARE.fullmatch(short) and 0 < i < n - 1 and not lines[i - 1].rstrip().endswith((":", "....")):
            out[i] = {"page_number"}
        elif len(s) >= 6 and not s[0].islower() and s[-1] not in ",;" and model.starts_line(s.split(None, 1)[0]) and fold(s) in model.shapes:
            out[i] = {"header"} | ({"page_number"} if PAGE_TAIL.search(digits_tail(s)) else set())
    return out


def digits_tail(s: str) -> str:
    return s[:-16] + re.sub(r"(?<= )[\dOolIZSbB|]+(?= |$)", lambda m: digits(m[0]), s[-16:])


def repair(text: str | None, model: Model) -> tuple[str | None, set[str]]:
    """(the text as paragraphs, the kinds of noise found in it)."""
    if text is None:
        return None, set()
    if not text.strip():
        return "", set()
    kinds: set[str] = set()
    lines = lines_of(text)
    if len(lines) > 1:
        gone = furniture(lines, model)
        for i, k in gone.items():
            kinds |= k
            if misread_tokens(lines[i], model, header=True):
                kinds.add("misread")
        body = "\n".join(line.replace("\x0c", "").rstrip() for i, line in enumerate(lines) if i not in gone)
        pieces, at = [], 0
        for m in BREAK.finditer(body):
            start = m.start()
            while start and (body[start - 1] == "-" or body[start - 1].isalnum() or body[start - 1] in "!|"):
                start -= 1
            left, right = body[start : m.start()], HEAD.match(body, m.end())[0]
            if not left or not any(c.isalpha() for c in left):
                continue
            pieces.append(body[at : m.start()])
            if model.is_cut(left, right, m[1]):
                kinds.add("hyphenation")
            else:
                pieces.append("-")
            at = m.end()
        body = "".join(pieces) + body[at:]
        body = "\n\n".join(" ".join([l.strip(" \t") for l in p.split("\n")]) if "\t" not in p and ".... " not in p else p for p in EMPTY_LINE.split(body))
    else:
        body = text
    fixes = misread_tokens(body, model)
    if fixes:
        kinds.add("misread")
        out, at = [], 0
        for s, e, r in fixes:
            out += [body[at:s], r]
            at = e
        body = "".join(out) + body[at:]
    return body.strip(), kinds


def misread_tokens(text: str, model: Model, header: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of words and numbers with misread characters. The first and last word of a record may be
    cut off and are judged only if they hold other signs than letters."""
    suspects = model.suspects(text)
    if not suspects:
        return []
    out: list[tuple[int, int, str]] = []
    skip: list[tuple[int, int]] = []
    if "@" in text or "[at]" in text or "(at)" in text or "www." in text or "://" in text:
        skip = [(m.start(), m.end()) for m in SKIP.finditer(text)]
    n, k = len(text), 0
    for m in TOKEN.finditer(text):
        w = m[0]
        if w not in suspects:
            continue
        s, e = m.start(), m.end()
        while k < len(skip) and skip[k][1] <= s:
            k += 1
        if k < len(skip) and skip[k][0] < e:
            continue
        low = w.lower()
        if any(c.isdigit() for c in w) or digits(w).isdigit():
            at = number_start(text, s)
            if (mm := NUMBERISH.match(text, at)) and mm.end() >= e and number_misread(mm[0]) and not (at == 0 and w[0].isalpha() and not header):
                if not out or out[-1][1] <= mm.start():
                    out.append((mm.start(), mm.end(), digits(mm[0])))
                continue
        if not header and (s == 0 or e == n) and w.isalpha():
            continue
        got = model.words.get(low)
        if not got or is_odd(low) and re.fullmatch(r"[a-z]{1,2}\d+|\d+[a-z]{1,2}", low) and len(low) <= 4:
            continue
        around = [x.lower() for x in WORDS.findall(text[max(0, s - 30) : s])[-2:] + WORDS.findall(text[e : e + 30])[:2]]
        r = model.pick(got, around)
        out.append((s, e, r.upper() if w.isupper() and len(w) > 1 else r.capitalize() if w[0].isupper() else r))
    return out


def number_start(text: str, s: int) -> int:
    while s and text[s - 1] in "0123456789OolIZSbB|,./():%-$#+" and not text[s - 1].isspace():
        s -= 1
    return s


def wanted(text: str) -> set[tuple[str, str]]:
    """The entries that a text may ask for."""
    out = {("w", t.lower()) for t in TOKEN.findall(text)}
    lines = lines_of(text)
    if len(lines) > 1:
        out |= {("w", t.lower()) for t in TOKEN.findall(CUT_AT.sub("", text))}
        for left, right in page_breaks(lines):
            out |= {("b", f"{left.strip('-')}-{right}".lower()), ("w", f"{left.rpartition('-')[2]}{right}".lower())}
        out |= {("s", fold(s)) for x in lines if 6 <= len(s := x.replace("\x0c", " ").strip()) <= WIDTH}
    return out


def scan_noise(df: DataFrame, keys: list[str], learned: Learned, at_once: int | None = None) -> DataFrame:
    """keys + kinds, repaired: every row of df (with a column text)."""
    spark = df.sparkSession
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    basis, u, entries = learned.basis, learned.u, learned.entries

    def mended(f: pd.DataFrame, got: list) -> pd.DataFrame:
        out = f[keys].copy()
        out["kinds"], out["repaired"] = [sorted(k) for _, k in got], [t for t, _ in got]
        return out

    if entries.count() <= (AT_ONCE if at_once is None else at_once):
        shared = spark.sparkContext.broadcast([(r["what"], r["key"], r["cut"], r["links"] and [x.asDict() for x in r["links"]]) for r in entries.collect()])

        def run(frames):
            model = Model(shared.value, basis, u)
            for f in frames:
                yield mended(f, [repair(t, model) for t in f["text"]])

        return df.select(*keys, "text").mapInPandas(run, f"{schema}, kinds array<string>, repaired string")

    # Too many to broadcast: each record's words, breaks and lines are joined with the entries. The most used words without
    # a link, a bounded set, needn't be asked for.
    fine = spark.sparkContext.broadcast({r["word"] for r in learned.fine.orderBy(F.desc("n"), "word").limit(FINE).collect()})

    def ask(frames):
        for f in frames:
            rows = [(*k, what, key) for *k, t in f[[*keys, "text"]].itertuples(index=False) if t for what, key in wanted(t) if what != "w" or key not in fine.value]
            yield pd.DataFrame(rows, columns=[*keys, "what", "key"])

    asked = df.select(*keys, "text").mapInPandas(ask, f"{schema}, what string, key string").distinct()
    got = asked.join(entries, ["what", "key"]).groupBy(*keys).agg(F.collect_list(F.struct("what", "key", "cut", "links")).alias("entries"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"g.{k}"))
    full = df.alias("d").join(got.alias("g"), same, "left").select(*[f"d.{k}" for k in keys], "d.text", "g.entries")

    def run_each(frames):
        for f in frames:
            yield mended(f, [repair(t, Model([(e["what"], e["key"], e["cut"], e["links"]) for e in es] if es is not None else [], basis, u)) for t, es in zip(f["text"], f["entries"])])

    return full.mapInPandas(run_each, f"{schema}, kinds array<string>, repaired string")
