"""Links, ignore rules and the smaller readers."""

import pytest
from pyspark.sql import functions as F

from quarrystone.functions.stems import with_stems
from quarrystone.operators import links as lk
from quarrystone.operators import nulls as nl
from quarrystone.operators import pairs as pr
from quarrystone.operators import repair as rp
from quarrystone.operators import search as se


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_definitions_reach_other_sources(spark):
    s = spark.createDataFrame([(1, "a", 'As used here, "Harbor Fee" means a charge.'), (2, "b", "The harbor fee is due."), (3, "a", "The harbor fee again."), (4, "c", None)], "id int, doc string, text string")
    assert rows(lk.defined_links(s)) == [(1, 2, "harbor fee")]


def broadcasts(df):
    """Whether the plan would broadcast a side, as the optimizer sees it before anything runs."""
    return "Broadcast" in df._jdf.queryExecution().sparkPlan().toString()


def test_definitions_move_no_texts(spark):
    s = spark.createDataFrame([(1, "a", 'The "Fee" means a charge.'), (5, "b", 'A "fee" means a toll, "(b) dues" means a sum.'), (2, "b", "No fee, coffees or tofeel."), (3, "c", "A coffee and (b) dues."), (4, None, "fee"), (None, "d", "fee")], "id int, doc string, text string")
    want = {(1, 2, "fee"), (1, 3, "fee"), (1, 5, "fee"), (5, 1, "fee"), (5, 3, "(b) dues"), (1, None, "fee")}
    assert {tuple(r) for r in lk.defined_links(s).collect()} == want
    assert {tuple(r) for r in lk.defined_links(s, at_once=1).collect()} == want  # in several passes
    plan = lk.defined_links(s)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # statements used to be written out for each word, and broadcast


def test_definitions_of_any_letters_move_no_texts(spark):
    from types import SimpleNamespace

    from quarrystone.queries import links as ql

    o = spark.createDataFrame([(1, "a", "The “Жilet Fee” means a charge."), (2, "b", "Prežilet. The жilet fees."), (3, "a", "жilet fee"), (4, "c", None)], "id long, token string, verbatim string")
    df = ql.defined_links_all(SimpleNamespace(obs=o))
    assert rows(df) == [(1, 2, "жilet fee")]
    assert not broadcasts(df) and "Generate" not in df._jdf.queryExecution().sparkPlan().toString()


def test_phrases_do_not_go_through_the_driver(spark, monkeypatch):
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("abжß𝔘é ") for _ in range(r.randint(1, 9))) + r.choice("xy")
    said = ["".join(word() + " " for _ in range(r.randint(1, 6)))[: r.randint(3, 60)] for _ in range(150)]
    said = [x if len(x) > 2 else x + "abc" for x in said] + ["q" * 60, "İ" * 40]
    texts = [f'The "{x}" means a sum. ' + "".join(word() for _ in range(40)) + r.choice(said).upper() + r.choice(said) for x in said] + ["", "İ" * 40, None, "fee " * 400]
    s = spark.createDataFrame([(i, f"d{i % 5}", t) for i, t in enumerate(texts)], "id int, doc string, text string")
    low = {x.id: x.t for x in s.select("id", lk.fold("text").alias("t")).collect()}
    meant = {}
    for x in lk.definitions(s).collect():
        meant.setdefault(x.phrase, []).append(x.id)
    want = set()
    for p, ids in meant.items():
        for i, t in low.items():
            if p in t and (other := [j for j in ids if j % 5 != i % 5]):
                want.add((min(other), i, p))
    assert len(want) > 200
    came, real = [], type(s).collect
    with monkeypatch.context() as m:
        m.setattr(type(s), "collect", lambda df: came.append(real(df)) or came[-1])
        df = lk.defined_links(s)
    assert sum(map(len, came)) <= 1  # all phrases used to be collected
    assert rows(df) == sorted(want)
    monkeypatch.setattr(lk, "AT_ONCE", 70)  # texts in pieces
    assert rows(lk.defined_links(s, at_once=1)) == sorted(want)  # and a filter that lets nearly all through
    assert rows(lk.defined_links(s.filter("id > 152"))) == []


def test_deletions_of_names_are_not_broadcast(spark, monkeypatch):
    made = []
    monkeypatch.setattr(pr, "cut", lambda df, what="stage", real=pr.cut: made.append((what, broadcasts(df))) or real(df, what))
    names = spark.createDataFrame([("Harbor Co",), ("Harbro Co",), ("harbor co",), ("Harbour Cos",), ("Pier",), ("Peir",), ("abc",)], "n string")
    assert rows(pr.near_spellings(names, "n")) == [("Harbor Co", "Harbour Cos", 2), ("Harbor Co", "Harbro Co", 1), ("Harbor Co", "harbor co", 0), ("Harbour Cos", "harbor co", 2), ("Harbro Co", "harbor co", 1), ("Peir", "Pier", 1)]
    assert not dict(made).get("near", True)


def texts_of(n, seed, words=30, least=0, most=7):
    import random

    r = random.Random(seed)
    return [[f"w{int(words * r.random() ** 2)}" for _ in range(r.randint(least, most))] for _ in range(n)]


def test_attestation_writes_no_pairs(spark):
    prior, sts = texts_of(40, 1), texts_of(150, 2)
    p = spark.createDataFrame([(f"p{i}", x) for i, x in enumerate(prior)], "prior string, terms array<string>")
    s = spark.createDataFrame([(i, x) for i, x in enumerate(sts)], "id long, terms array<string>")
    want = []
    for i, x in enumerate(prior):
        best = min(((-len({*x} & {*y}) / len({*x}), j) for j, y in enumerate(sts)), default=None) if x else None
        if best and -best[0] >= 0.5:
            want.append((f"p{i}", best[1], -best[0]))
    for block in (1000, 40):  # one block and several
        got = lk.attest_sets(p, s, block=block)
        assert rows(got) == sorted(want)
        assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()  # pairs used to be joined and grouped
    one = lambda df, key: df.select(key, F.explode("terms").alias("term"))
    assert rows(lk.attest(one(p, "prior"), one(s, "id"))) == sorted(want)


def test_echoes_write_no_pairs(spark):
    sets = texts_of(120, 3)
    x = spark.createDataFrame([(i, f"d{i % 9}" if i % 11 else None, t) for i, t in enumerate(sets)], "id long, doc string, terms array<string>")
    docs = [f"d{i % 9}" if i % 11 else None for i in range(len(sets))]
    want = set()
    for i, p in enumerate(sets):
        for j, q in enumerate(sets[:i]):
            k = len({*p} & {*q})
            if k and docs[i] and docs[j] and docs[i] != docs[j] and k / (len({*p}) * len({*q})) ** 0.5 >= 0.3:
                want.add((j, i))
    for block in (1000, 30):
        got = pr.echo_sets(x, 0.3 - 1e-12, block=block)
        assert {(r.a, r.b) for r in got.collect()} == want and got.count() == len(want)
        assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()


def test_recall_moves_no_hits(spark):
    q, c = texts_of(60, 4, least=0), texts_of(200, 5, most=25)
    truth = [(i, (7 * i + j) % 200) for i in range(60) for j in range(i % 3)]
    qs = spark.createDataFrame([(i, x) for i, x in enumerate(q)], "query long, terms array<string>")
    cs = spark.createDataFrame([(i, x) for i, x in enumerate(c)], "key long, terms array<string>")
    tr = spark.createDataFrame(truth, "query long, key long")
    hits = []
    for i, x in enumerate(q):
        n = sorted((-len({*x} & {*y}), j) for j, y in enumerate(c) if {*x} & {*y})
        hits += [(i, j, r) for r, (_, j) in enumerate(n, 1)]
    want = rows(se.span_recall(spark.createDataFrame(hits, "query long, key long, rank int"), tr, 10))
    assert 0 < want[0][1] < want[0][0]
    for block in (1000, 20):
        got = se.passage_recall(qs, cs, tr, 10, block=block)
        assert rows(got) == want
        assert "Window" not in got._jdf.queryExecution().sparkPlan().toString()  # all hits used to be ranked


def test_recall_asks_for_all_passages(spark):
    from types import SimpleNamespace

    from quarrystone.queries import links as ql

    # Many passages hold the words of some quotes, so that true ones fall behind; ids are not multiples of a hundred.
    words = [[f"harbor{w[1:].translate(str.maketrans('0123456789', 'abcdefghij'))}" for w in x] for x in texts_of(150, 11, words=14, least=1, most=9)]
    chunks = [(i, f"d{i % 6}", 10 * (i // 6), 10 * (i // 6) + 10, " ".join(x)) for i, x in enumerate(words)]
    obs = [(1000 * i + 7, c[1], c[2] + 1, c[2] + 8 + i % 4, " ".join(words[i][: 1 + i % 4] + ["pierhead"] * (i % 5 == 0))) for i, c in enumerate(chunks)]
    t = SimpleNamespace(obs=spark.createDataFrame([*obs, (3, "d1", 0, 9, None), (4, None, 0, 9, "harbora")], "id long, token string, a int, b int, verbatim string"), chunks=spark.createDataFrame(chunks, "id long, token string, a int, b int, text string"))
    found = 0
    for _, doc, a, b, text in obs:
        x = {*text.split()}
        rank = [j for _, j in sorted((-len(x & {*y}), j) for j, y in enumerate(words) if x & {*y})][:10]
        found += any(chunks[j][1] == doc and a < chunks[j][3] and chunks[j][2] < b for j in rank)
    assert 10 < found < len(obs) - 10
    assert rows(ql.span_recall(t)) == [(len(obs) + 1, found, round(found / (len(obs) + 1), 6))]


def test_reading_across_moves_no_pairs(spark):
    texts = [" ".join(["harbor"] * (not x), ) + " ".join(f"{w}word" for w in x) for x in texts_of(90, 6, words=60, least=3)]
    doc = lambda i: f"d{i * 7 % 11}"  # noqa: E731  # documents' statements lie between each other
    s = spark.createDataFrame([(i, doc(i), x) for i, x in enumerate(texts)], "id long, doc string, text string")
    like = {(r.a, r.b): round(r.score, 9) for r in pr.pair_scores(pr.blocked_tokens(pr.token_table(s))).collect()}
    want = set()
    for (a, b), x in like.items():
        others = [y for (p, q), y in like.items() if (p, q) != (a, b) and {doc(p), doc(q)} == {doc(a), doc(b)} and {p, q} & {a, b}]
        if all(y < x for y in others):
            want.add((a, b, doc(a), doc(b), x))
    assert want
    for block in (1000, 25):
        got = pr.read_across(s, null=False, block=block)
        assert {(r.a, r.b, r.doc_a, r.doc_b, r.score) for r in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()
    beaten = rows(pr.read_across(s).select("a", "b"))
    assert beaten == rows(pr.read_across(s, sizes=0).select("a", "b")) and {*beaten} < {w[:2] for w in want}


def test_reading_across_counts_all_shared_words(spark):
    from types import SimpleNamespace

    from quarrystone.queries import links as ql

    texts = [" ".join(f"{w}word" for w in x) for x in texts_of(120, 8, words=25, least=2, most=9)]
    doc = lambda i: f"d{i * 7 % 13}" if i % 31 else None
    o = spark.createDataFrame([(i, doc(i), x) for i, x in enumerate(texts)], "id long, token string, verbatim string")
    s = o.select("id", F.col("token").alias("doc"), F.col("verbatim").alias("text")).filter("doc is not null")
    bags = {}
    for r in pr.token_table(s).collect():
        bags.setdefault(r.id, set()).add(r.token)
    idf = {r.token: r.idf for r in pr.idf_bits(pr.token_table(s)).collect()}
    assert sum(sum(t in b for b in bags.values()) > len(bags) ** 0.5 + 1 for t in idf) > 5  # words that used to be left out
    like = {(a, b): round(sum(idf[t] for t in bags[a] & bags[b]), 9) for a in bags for b in bags if a < b and doc(a) != doc(b) and bags[a] & bags[b]}
    want = {}
    for (a, b), x in like.items():
        others = [y for (p, q), y in like.items() if (p, q) != (a, b) and {doc(p), doc(q)} == {doc(a), doc(b)} and {p, q} & {a, b}]
        if all(y < x for y in others):
            want[a, b] = (doc(a), doc(b), len(bags[a] & bags[b]), x)
    for block, cells in ((1000, 4_000_000), (1000, 100), (25, 30)):  # one block and several; documents at once and in parts
        got = pr.read_across(s, null=False, block=block, rare=False, cells=cells)
        assert sorted(got.collect()) == sorted((*k, *v) for k, v in want.items())
    sizes = spark.createDataFrame([(len(p), len(q)) for p in bags.values() for q in bags.values() if len(p) <= len(q)], "na int, nb int")
    floor = {(r.na, r.nb): r.floor for r in nl.floors(pr.token_table(s), sizes).collect()}
    beaten = {(a, b) for (a, b), v in want.items() if v[3] > floor[tuple(sorted((len(bags[a]), len(bags[b]))))]}
    assert beaten and {(r.a, r.b) for r in ql.read_across(SimpleNamespace(obs=o)).collect()} == beaten


def test_candidates_need_support_and_no_attack(spark):
    g = spark.createDataFrame([(1, ["port", "of", "tarrow"], "place", 1950)], "id int, words array<string>, kind string, year int")
    c = spark.createDataFrame([("x", 1, ["port", "tarrow"], "place", 1900, 2000), ("y", 1, ["port", "tarrow"], "ship", 1900, 2000), ("z", 1, ["port"], None, None, None), ("w", 1, ["tarrow", "port"], "place", 1960, None)], "cand string, id int, words array<string>, kind string, since int, until int")
    got = {r.cand: (r.verdict, r.attacks) for r in lk.bind_candidates(g, c.unionAll(spark.createDataFrame([(f"o{i}", 9, [f"q{i}"], None, None, None) for i in range(6)], c.schema))).collect()}
    assert got["x"] == ("bound", []) and got["y"] == ("refused", ["kind"]) and got["z"][0] == "open" and got["w"] == ("refused", ["window"])


def test_blanking_keeps_offsets(spark):
    t = "one\nDRAFT COPY\ntwo"
    d = spark.createDataFrame([(t, ["DRAFT COPY"]), (t, None)], "t string, l array<string>")
    got = [r[0] for r in d.select(lk.blank_lines(F.col("t"), F.col("l"))).collect()]
    assert got == ["one\n          \ntwo", t]


def test_stamps_on_half_of_the_pages(spark):
    p = spark.createDataFrame([("d", i, f"line {i}\nDRAFT\nsame words here") for i in range(4)], "doc string, page int, text string")
    assert rows(lk.ignore_rules(p)) == [("d", "DRAFT", 4)]


def test_answers_by_source_keep_unanswered(spark):
    s = spark.createDataFrame([(1, "a", 5, 2.0), (1, "a", 6, 3.0), (1, "b", 7, 1.0)], "q int, doc string, id int, score double")
    q = spark.createDataFrame([(1,), (2,)], "q int")
    got = rows(lk.margins(q, lk.best_per_source(s)).select("q", "doc", "id", "answered").withColumn("doc", F.coalesce("doc", F.lit(""))).withColumn("id", F.coalesce("id", F.lit(0))))
    assert got == [(1, "a", 6, True), (1, "b", 7, True), (2, "", 0, False)]


def test_referents_by_priority(spark):
    v = spark.createDataFrame([(1, "Passengers saved from the ship"), (2, "Crew lost"), (3, None)], "id int, text string")
    w = spark.createDataFrame([("saved", "rescued", 1), ("crew", "crew", 2), ("lost", "drowned", 1)], "term string, key string, priority int")
    assert rows(lk.referent_of(v, w)) == [(1, "rescued"), (2, "drowned")]


def test_findings(spark):
    p = spark.createDataFrame([("differs", False, False, []), ("none", True, False, []), ("same", False, False, []), ("none", False, False, ["b", "a"]), ("none", False, False, [])], "verdict string, neg_a boolean, neg_b boolean, shared array<string>")
    assert [r.finding for r in lk.findings(p).collect()] == ["differs", "one denies", "says the same", "both on a, b", "apart"]


def test_genre_names_are_left_out(spark):
    d = spark.createDataFrame([("d", "g", "n1", 5), ("d", "g", "n2", 9), ("d", "g", "n3", 1)], "doc string, genre string, name string, degree int")
    assert rows(lk.gist_by_genre(d, spark.createDataFrame([("g", "n2")], "genre string, name string"), 1)) == [("d", "n1", 5)]


def test_fresh_starts_pay_only_where_words_change():
    t = ["a", "b", "c", "d"] * 12 + ["w", "x", "y", "z"] * 12
    (c, bits, clears), (_, low, no) = lk.structure_gain(t, [48, 24])
    assert c == 48 and bits > low and clears and not no


def test_clips_plurals_tokens_moods():
    assert lk.parse_clip("abcdefghijk from 1:05 to 2:10 as intro") == {"video": "abcdefghijk", "start": 65.0, "end": 130.0, "name": "intro"}
    assert [lk.plural(w, 2) for w in ("city", "box", "day")] == ["cities", "boxes", "days"] and lk.plural("city", 1) == "city"
    assert [(t, c) for t, c, _, _ in lk.token_spans("It's $5, ok")] == [("It's", "word"), ("$", "sign"), ("5", "number"), (",", "punctuation"), ("ok", "word")]
    assert [m for m, _, _ in lk.moods("Why? Stop! (A note) It is…")] == ["asks", "exclaims", "trails", "contained"] and lk.moods(None) == []


def test_amounts_can_be_meant_in_two_ways():
    assert [(r, v) for r, v, _, _ in lk.amount_readings("67 units at $21,434.64 each; $3 million")] == [("stated", 21434.64), ("total", pytest.approx(67 * 21434.64)), ("stated", 3e6)]


def test_forms_align_by_label():
    assert lk.form_alignment([("Total due", "1"), ("Name", "x")], [("Names", "y"), ("Total  due", "2")]) == [("Total due", "Total  due", pytest.approx(0.9412, abs=0.06)), ("Name", "Names", pytest.approx(0.8571))]


def test_admission_needs_places():
    import numpy as np

    s = np.r_[np.zeros(30), [5.0, 6.0]]
    assert lk.admit_types(s, [30, 31]) < 0.02 and lk.admit_types(s, [1, 2]) > 0.2 and lk.admit_types(s[:10], [1]) is None


def test_null_rises_with_size(spark):
    tok = spark.createDataFrame([(i, f"d{i}", f"w{(i * 7 + j * j) % 37}") for i in range(60) for j in range(8)], "id int, doc string, token string").distinct()
    f = {r.na: r.floor for r in nl.floors(tok, spark.createDataFrame([(2, 2), (8, 8)], "na int, nb int")).collect()}
    assert f[8] > f[2] >= 0


def test_pairs_of_every_kind(spark):
    from types import SimpleNamespace

    from quarrystone.queries import links as ql
    from quarrystone.queries import statistics as qs

    texts = [("clause", "a", "hydrant meadow fixture rental"), ("clause", "b", "hydrant meadow fixture council"), ("term", "c", "council lantern window pavement"), ("amount", "d", "lantern window nothing granted"), ("notice", "a", "pavement harbour signage ladder"), ("notice", "b", "harbour signage without ladder"), (None, "c", "rental hydrant gravel orchard"), ("clause", None, "hydrant meadow fixture rental")]
    t = SimpleNamespace(obs=spark.createDataFrame([(i, d, k, x) for i, (k, d, x) in enumerate(texts)], "id bigint, token string, kind string, verbatim string"))
    bags = {i: (d, {w for w in x.split() if len(w) >= 5}) for i, (_, d, x) in enumerate(texts) if d}
    df = {w: sum(w in b for _, b in bags.values()) for _, b in bags.values() for w in b}
    rare = {w for w, n in df.items() if 2 <= n <= 3}
    want = {(a, b): len(bags[a][1] & bags[b][1] & rare) for a in bags for b in bags if a < b and bags[a][0] != bags[b][0]}
    assert {(r.a, r.b): r.shared for r in qs.pair_idf_score_all(t).collect()} == {k: n for k, n in want.items() if n}
    assert {(r.denial, r.id) for r in ql.polarity_links_all(t).collect()} >= {(3, 2), (5, 4)}
    assert {r.token: r.df for r in qs.idf_bits_all(t).collect()} == df
    cos = {(a, b): len(bags[a][1] & bags[b][1]) / (len(bags[a][1]) * len(bags[b][1])) ** 0.5 for a, b in want}
    assert {(r.a, r.b) for r in ql.echo_cosine_all(t).collect()} == {k for k, c in cos.items() if c >= 0.3}
    o = t.obs.filter("token is not null").select("id", F.col("token").alias("doc"), F.col("verbatim").alias("text"))
    assert (0, 1) in {(r.a, r.b) for r in pr.read_across(o, null=False).collect()}


def test_rows_of_any_letters(spark):
    from types import SimpleNamespace

    from quarrystone.queries import links as ql
    from quarrystone.queries import texts as qt

    obs = [(1, "a", "clause", 'The "Жilet Fee" means a charge – once.'), (2, "b", "notice", "A жilet fee “is” due"), (3, "b", "clause", "short")]
    t = SimpleNamespace(
        documents=spark.createDataFrame([(1, "The “the” naïve the"), (2, "éthe thé theж the"), (3, "the"), (4, None)], "doc_id bigint, text string"),
        contracts=spark.createDataFrame([("a", "Kenneth  Amblobridge"), ("b", " Kenneth Amblobridge"), ("c", "Kenneth Amblöbridge"), ("d", None)], "token string, party string"),
        obs=spark.createDataFrame(obs, "id bigint, token string, kind string, verbatim string"),
    )
    assert rows(qt.surface_counts_all(t)) == [(1, 3), (2, 1), (3, 1)]
    assert [(r.token, r.d) for r in qt.name_similarity_all(t).orderBy("token").collect()] == [("a", 1), ("b", 1), ("c", 1)]
    assert rows(ql.defined_links_all(t)) == [(1, 2, "жilet fee")]
    assert rows(ql.page_choice_all(t)) == [("a", "clause", obs[0][3]), ("b", "notice", obs[1][3])]


# ---- nulls that decide


def worded(spark):
    """Documents of random words; the first two statements share far more than chance, the others do not."""
    import random

    rnd = random.Random(3)
    vocab = [f"{a}{b}word" for a in "bcdfghklmnpr" for b in "aeiou"]
    rows = [(i, f"d{i % 30}", w) for i in range(300) for w in {rnd.choice(vocab) for _ in range(6)}]
    twin = ["zilch", "quartz", "vortex", "jacket", "wyvern"]
    return spark.createDataFrame(rows + [(900, "x", w) for w in twin] + [(901, "y", w) for w in twin], "id int, doc string, token string").distinct()


@pytest.mark.parametrize("measure", ["idf", "jaccard", "cosine"])
def test_only_what_beats_chance_is_kept(spark, measure):
    tok = worded(spark)
    own = {}
    for r in tok.collect():
        own.setdefault(r.id, set()).add(r.token)
    like = {"idf": lambda a, b: 5.0 * len(a & b), "jaccard": lambda a, b: len(a & b) / len(a | b), "cosine": lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5}[measure]
    pairs = [(900, 901, float(like(own[900], own[901]) * (9 if measure == "idf" else 1))), (0, 1, 0.01), (2, 3, 0.02)]
    df = spark.createDataFrame(pairs, "a int, b int, score double")
    assert {(r.a, r.b) for r in nl.beats_floor(df, tok, measure=measure, draws=40).collect()} == {(900, 901)}
    f = {(r.na, r.nb): r.floor for r in nl.floors(tok, spark.createDataFrame([(2, 2), (5, 5), (3, 6)], "na int, nb int"), measure).collect()}
    g = {(r.na, r.nb): r.floor for r in nl.floors(tok.repartition(7), spark.createDataFrame([(5, 5), (6, 6)], "na int, nb int"), measure).collect()}
    assert f[5, 5] == pytest.approx(g[5, 5]) and all(x >= 0 for x in f.values())
    assert nl.beats_floor(df.limit(0), tok, measure=measure).count() == 0


def test_a_region_needs_a_rate_of_its_own(spark):
    rows = [("p1", "d1", "all", i < 57) for i in range(60)] + [("p2", "d1", "all", i % 2 == 0) for i in range(60)] + [("p3", "d2", "all", i % 2 == 0) for i in range(400)] + [(None, "d2", "all", None), ("p4", None, "all", True), ("p4", None, "all", None)]
    df = spark.createDataFrame(rows, "party string, dept string, every string, hit boolean")
    got = {(r.party, r.dept): (r.rate, r.region) for r in nl.ladder_rate(df, ["party", "dept", "every"], "hit").collect()}
    n, k = 521, 57 + 30 + 200 + 1
    assert got["p1", "d1"] == (57 / 60, "party") and got["p3", "d2"] == (0.5, "party") and got["p4", None] == (k / n, "every") and len(got) == 5
    assert nl.ladder_rate(df.limit(0), ["party", "dept", "every"], "hit").count() == 0


def test_names_said_more_than_their_words_would_be(spark):
    docs = spark.createDataFrame([(i, ("the road to old town and the new bridge " * 3 + ("mary lee " if i % 2 else "see ")).split()) for i in range(60)], "id int, stems array<string>")
    bg = docs.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))
    bg = bg.select("stem", (F.col("n") / 1740).alias("p"))
    names = spark.createDataFrame([("Mary Lee", ["mary", "lee"]), ("Road Bridge", ["road", "bridge"]), ("Nobody", ["nobody"]), ("", [])], "name string, stems array<string>")
    got = {r.name: (r["count"], r.outside) for r in nl.phrase_keyness(names, docs, bg).collect()}
    assert got == {"Mary Lee": (30, True), "Road Bridge": (0, False)}


# ---- stems and repair


def test_porter(spark):
    want = dict(x.split(":") for x in "caresses:caress ponies:poni cats:cat feed:feed agreed:agre bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat rational:ration digitizer:digit triplicate:triplic formalize:formal hopeful:hope goodness:good revival:reviv allowance:allow airliner:airlin replacement:replac adjustment:adjust dependent:depend adoption:adopt effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil a:a é:é".split())
    df = spark.createDataFrame([(w,) for w in want] + [(None,)], "w string")
    assert {r.w: r.stem for r in with_stems(df, "w").collect()} == want | {None: None}
    d = spark.createDataFrame([(1, "Federal inspections were made"), (2, "the federal inspector"), (3, None), (4, "inspected federally")], "id int, t string")
    assert {r.id for r in se.match_stems(se.inverted_stems(d, "id", "t"), "id", "federal inspection").collect()} == {1, 4}


def test_misread_words_need_a_witness(spark):
    base = ["the council shall inspect the hydrant", "inspect the hydrant and the grant", "the council shall grant the hydrant", "walk walked talk talked call called jump jumped look looked ask asked", "walk walked talk talked call called jump jumped look looked ask asked", "walk walked talk talked call called jump jumped look looked ask asked"]
    rows = [(i, t) for i, t in enumerate(base * 3)] + [(90, "the counci shall inspect"), (91, "nobody near hydrart here"), (92, "they granted it"), (93, None), (94, ""), (95, "jumpe of it")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {(r.doc, r.word): (r.candidate, r.verdict) for r in rp.repairs(df, "id", "t").collect()}
    assert got[90, "counci"] == ("council", "repaired") and got[91, "hydrart"] == ("hydrant", "no witness") and got[95, "jumpe"][1] in ("no witness", "several candidates")
    assert rp.repairs(df.limit(0), "id", "t").count() == 0


def test_contradictions_of_one_referent(spark):
    from quarrystone.operators import contradictions as cd

    said = [("british", "711", "saved"), ("british", "2201", "on board"), ("marshall", "705", "saved"), ("marshall", "1635", "lost"), ("beesley", "705", "rescued"), ("beesley", "1503", "drowned"), ("senate", "500", "needlessly sacrificed"), (None, "9", "saved"), ("x", None, "saved")]
    v = spark.createDataFrame([(i, d, r, float(r) if r else None, "count", f, "lives") for i, (d, r, f) in enumerate(said)], "id int, doc string, raw string, value double, unit string, referent string, window string")
    alike = {"saved": ["rescued"], "lost": ["drowned", "perished"]}
    got = {(r.part, r.referent, r.n_values, r.n_docs, r.why) for r in cd.contradiction_records(v, "How many lives were saved?", alike).collect()}
    assert got == {("contradiction", "saved", 2, 3, None), ("refusal", None, 4, 4, "another referent"), ("refusal", None, 1, 1, "incomplete")}
    lost = {(r.part, r.referent, r.n_values) for r in cd.contradiction_records(v, "How many lives were lost?", alike).filter("part <> 'refusal'").collect()}
    assert lost == {("contradiction", "lost", 2)}
    assert {(r.part, r.why) for r in cd.contradiction_records(v, "How many?").collect()} == {("refusal", "the question names nothing")}
    more = spark.createDataFrame([(0, "a", "5", 5.0, None, None, "five boats"), (1, "a", "6", 6.0, None, None, "six boats"), (2, "b", "7", 7.0, "t", None, "boats"), (3, "c", "7", 7.0, "t", None, "Boats!")], v.schema)
    assert {(r.part, r.unit) for r in cd.contradiction_records(more, "How many boats?").collect()} == {("gap", "?"), ("unstable", "?"), ("agreement", "t")}
    f = spark.createDataFrame([("s1", 3, 4), ("s2", 3, 9)], "src string, boats_saved int, boats_lost int")
    assert {(r.part, r.referent) for r in cd.contradiction_records(cd.field_values(f, "src", ["boats_saved", "boats_lost"]), "How many were lost?").filter("part <> 'refusal'").collect()} == {("contradiction", "lost")}


def test_common_words_of_any_length():
    import random

    from quarrystone.operators import alignment as al

    rnd = random.Random(8)
    for _ in range(60):
        a, b = ([rnd.choice("abcdefg") for _ in range(rnd.randint(0, 60))] for _ in range(2))
        got = al.common(a, b, 16)
        assert len(got) == len(al.lcs(a, b)) and all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    long = [rnd.choice(["to", "be", "or", "not"]) for _ in range(4000)]
    assert len(al.match_words(long, long[200:] + long[:200])) >= 3700
