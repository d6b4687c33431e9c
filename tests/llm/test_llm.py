"""The training-data operators against brute force, round trips and small worlds with known answers."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import bpe, mixing, personal, pieces, scans, spans, spellings, stuffing
from quarrystone.llm.queries import QUERIES, SQL

WORDS = "the lease shall be governed by council federal hydrant under every notice upon annual grant with dock above rental and of a signage".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 9)) for _ in range(n))


# ---- 1


def test_shared_runs_against_brute_force(spark):
    rnd = random.Random(1)
    shared = [prose(rnd, 80)[:n] for n in (199, 200, 201, 320)]
    rows = []
    for i in range(24):
        t = prose(rnd, 60) + "§" + rnd.choice(shared) + "§" + prose(rnd, 60)
        rows.append((i, f"t{i % 6}", t))
    rows += [(50, "a", "." * 900), (51, "b", "x" * 50 + "." * 700), (52, "c", "ab" * 300), (53, "d", "ba" * 250), (60, "a", None), (61, "b", ""), (62, None, rows[0][2]), (63, "t0", rows[0][2]), (64, "e", "😀" * 250), (65, "f", "y😀" + "😀" * 230)]

    def share(a, b):
        grams = {a[i : i + 200] for i in range(len(a) - 199)}
        return any(b[j : j + 200] in grams for j in range(len(b) - 199))

    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1] and x[2] and y[2] and share(x[2], y[2]))
    df = spark.createDataFrame(rows, "id bigint, token string, text string")
    shared = spans.shared_classes(df)
    assert sorted(map(tuple, spans.shared_pairs(shared).collect())) == want and want
    s = spans.shared_spans(df).collect()
    assert sorted({(r.id_a, r.id_b) for r in s}) == want
    for r in s:
        a, b = (next(x[2] for x in rows if x[0] == i) for i in (r.id_a, r.id_b))
        assert a[r.start_a : r.start_a + r.length] == b[r.start_b : r.start_b + r.length] and r.length >= 200
        assert r.start_a == 0 or r.start_b == 0 or a[r.start_a - 1] != b[r.start_b - 1]
    rep = {r.id: r for r in spans.shared_report(df, shared).collect()}
    assert rep[60].shared_chars == 0 and rep[62].shared_chars >= 200 and len(rep) == len(rows)
    for i, _, t in rows:
        held = {c for r in s for own, at in ((r.id_a, r.start_a), (r.id_b, r.start_b)) if own == i for c in range(at, at + r.length)}
        assert rep[i].shared_chars == len(held) and rep[i].partners == sum(i in p for p in want) and rep[i].n_chars == (None if t is None else len(t))


def test_a_passage_in_a_third_of_all_rows(spark):
    """Copies of one text under many owners are one class: what is reported comes from counts, no pairs of rows are formed."""
    rnd = random.Random(21)
    hot = prose(rnd, 60)
    rows = [(i, f"t{i % 700}", hot) for i in range(3000)] + [(9000 + i, f"u{i}", prose(rnd, 40) + f"§{i}§" + hot) for i in range(20)] + [(10000 + i, f"v{i}", prose(rnd, 50) + str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, token string, text string")
    shared = spans.shared_classes(df)
    assert shared.spans.count() == 1 + 20 + 190
    rep = {r.id: r for r in spans.shared_report(df, shared).collect()}
    same = sum(1 for i in range(3000) if i % 700 == 5)
    assert rep[5].shared_chars == len(hot) and rep[5].partners == 3000 - same + 20 and rep[9001].partners == 3000 + 19 and rep[10001].partners == 0


def test_no_records_no_spans(spark):
    df = spark.createDataFrame([], "id bigint, token string, text string, anchor string")
    assert spans.shared_spans(df).count() == 0 and spans.shared_report(df, spans.shared_classes(df)).count() == 0


# ---- 2


def kinds_of(text):
    return [(k, text[s:e]) for k, s, e in personal.find(text)]


def test_items_of_every_kind():
    t = "Attention: Ms. Ann Q. Lee-Roe, fax (615) 555-0123, who resides at 12-B N. Birch Creek Rd, Apt. 4; ann.lee+x@mail.example. Lee, Peter (SSN 912-34-5678) holds passport Z12345678."
    assert kinds_of(t) == [("name", "Ann Q. Lee-Roe"), ("phone", "(615) 555-0123"), ("address", "12-B N. Birch Creek Rd"), ("email", "ann.lee+x@mail.example"), ("name", "Lee, Peter"), ("id_number", "912-34-5678"), ("id_number", "Z12345678")]
    assert personal.replaced(t, personal.find(t)).startswith("Attention: Ms. [NAME], fax [PHONE], who resides at [ADDRESS], Apt. 4; [EMAIL].")


@pytest.mark.parametrize("t", ["The Victor 3120 pump and the Grace elevator line", "Parcel 081-04-0-103.00 and federal EIN 82-0112756", "Serial 447113690", "order 615-44170-22", "Using IP Address: 192.0.2.187", "follow @ashmerelease for more", "crates @ $62,923.58 each", "Crews closed Birch Creek Road", "between Ashmere and Peter Lee Construction LLC", "card 4111 1111 1111 1111", "", " \n ", None])
def test_what_is_no_item(t):
    assert personal.find(t) == []


def test_validators():
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")
    assert personal.mod97("GB82 WEST 1234 5698 7654 32") and not personal.mod97("GB82 WEST 1234 5698 7654 33")
    assert personal.plan_ok("615-555-0123") and not personal.plan_ok("115-555-0123") and not personal.ssn_ok("000-12-3456")


def test_names_of_no_list():
    for t, name in [("Please contact Rafael Quint before May.", "Rafael Quint"), ("Signed by Giovanni Berretti on Monday", "Giovanni Berretti"), ("Kwame Mensah will attend.", "Kwame Mensah"), ("Thandeka Moyo (SSN 612-34-5678)", "Thandeka Moyo")]:
        assert not {w.lower() for w in name.split()} & personal.GIVEN_KEYS and ("name", name) in kinds_of(t), t
    assert kinds_of("Ms. Kwame Mensah will attend.") == [("name", "Kwame Mensah")]
    for t in ("Crews met at the Kalmera Depot.", "near the Tessu Viaduct", "Contact Kalmera Paving LLC", "The Project Manager signed", "Call the Metro Council"):
        assert kinds_of(t) == [], t


def test_given_names_are_learned(spark):
    rows = ["Ms. Wanjiru Otieno met us", "Attention: Wanjiru Mutua", "Wanjiru Kamau, who resides there", "the plan of Wanjiru Njoroge was kept", "Dr. Amina Bello", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id bigint, text string")
    assert personal.learn_given(df, "text") - personal.GIVEN_KEYS == {"wanjiru"}
    got = {(r.id, rows[r.id][r.start_char : r.end_char]) for r in personal.personal_spans(df, "id", "text").collect()}
    assert (3, "Wanjiru Njoroge") in got and (4, "Amina Bello") in got


def test_addresses_of_other_kinds():
    assert kinds_of("moved to 5 Elm Close and 12 Rue de Rivoli, Paris") == [("address", "5 Elm Close"), ("address", "12 Rue de Rivoli")]


def test_validators_confirm(monkeypatch):
    """A number that its check digits confirm needs less from the words around it; without validators it is not accepted."""
    assert personal.national_id("12345678Z") and not personal.national_id("12345678A") and personal.national_id("046 454 286") and personal.national_id("2 55 08 14 168 025 38")
    sure = ["national id 12345678Z", "id card 046454286", "his file 912-34-5678", "fax 615-555-0123"]
    assert [k for t in sure for k, _, _ in personal.find(t)] == ["id_number"] * 3 + ["phone"]
    assert personal.find("national id 12345678A") == [] and personal.find("his file 000-34-5678") == [] and personal.find("fax 115-555-0123") == []
    for f in ("national_id", "ssn_ok", "plan_ok"):
        monkeypatch.setattr(personal, f, lambda x: False)
    assert [personal.find(t) for t in sure if "id card" not in t] == [[], [], []]


def test_offsets_through_cut_lines():
    t = "According to Samuel Hathor-\nshaw, call 615-\n555-0123 or write to ann.le-\ne@mail.example now"
    assert [(k, s) for k, s, _ in personal.find(t)] == [("name", 13), ("phone", 39), ("email", 65)]


def test_redaction_keeps_all_rows(spark):
    df = spark.createDataFrame([(1, "call 615-555-0123", 9), (2, None, 9), (3, "", 9)], "id bigint, text string, kind int")
    assert sorted(map(tuple, personal.redact(df, "id", "text").collect())) == [(1, "call [PHONE]", 1), (2, None, 0), (3, "", 0)]


# ---- 3


def test_pieces_join_to_the_text(spark):
    rnd = random.Random(3)
    texts = [prose(rnd, 900), "x" * 5000, "a" * 1200, "a" * 1201, "😀" * 3000, "Line one.\n\n" * 400, "", " " * 2500, ". ".join(prose(rnd, 12) for _ in range(60)), None, "\r\n" * 900, "é" * 1199 + " " + "z" * 700]
    df = spark.createDataFrame([(i, t, 100 if i % 2 else None, "p") for i, t in enumerate(texts)], "id bigint, text string, a bigint, piece string")
    got = {}
    for r in pieces.split_items(df).collect():
        got.setdefault(r.id, []).append(r)
    for i, t in enumerate(texts):
        if t is None:
            assert i not in got
            continue
        ps = sorted(got[i], key=lambda r: r.piece_no)
        assert "".join(p.piece[p.overlap :] for p in ps) == t and all(len(p.piece) <= 1200 for p in ps)
        assert (len(ps) > 1) == (len(t) > 1200) and all(p.overlap == 200 for p in ps[1:]) and ps[0].overlap == 0
        assert all(t[p.start : p.stop] == p.piece and p.a == (None if i % 2 == 0 else 100 + p.start) for p in ps)
    over = [r.id for r in pieces.oversized(df, "id").collect()]
    assert sorted(over) == [i for i, t in enumerate(texts) if t and len(t) > 1200]


def test_cuts_prefer_strong_boundaries(spark):
    t = "w " * 450 + "end.\n\n" + "v " * 600
    df = spark.createDataFrame([(1, t, 0)], "id bigint, text string, a bigint")
    assert pieces.split_items(df).filter("piece_no = 0").head().piece.endswith("end.\n\n")


# ---- 4


def test_variants_of_bodies_and_persons(spark):
    same = [
        ["Huxursted-Ilthewhurst Paving PLLC", "Paving, Huxursteed-Ilthewhurst", "HUXURSTED ILTHEWHURST PVG", "The Ilthewhurst & Huxursted P.L.L.C.", "Huxursted/Ilthewhiurst Pvg (Eastlow office)"],
        ["Drayiscott Fennurwick Utility District No. 2", "Dratiscott Fennurwick UTILITY DIST. #2"],
        ["Drayiscott Fennurwick Utility District No. 9", "Drayiscott Fennurwick UTILITY DISTRICT 9"],
        ["Kenneth Amblobridge", "AMBLOBRIDGE Kenneth", "Amblobridge, Kenny", "K. Amblobridge", "Kenneth P. Amblobridge", "Kenneth Amblobrigde"],
        ["Susan Amblobridge", "Sue Amblobridge"],
        ["Lundale Corvitt Supply, Inc."], ["Ashmere Water and Sewer Services"],
    ]
    values = [v for g in same for v in g] + [None, "", "  ", "N/A", "VARIOUS VENDORS", "See attached", "TBD", same[0][0]]
    df = spark.createDataFrame([(v, 1) for v in values], "party string, entity int")
    want = sorted((min(a, b), max(a, b)) for g in same for i, a in enumerate(g) for b in g[:i])
    assert sorted(map(tuple, spellings.variant_pairs(df).collect())) == want
    assert spellings.variant_pairs(df.limit(0)).count() == 0


def test_words_are_assigned_best():
    from itertools import permutations

    a, b = "greater nashville regional senior health alliance".split(), "greater bashville regional senior health alliance".split()
    assert spellings.align(sorted(a), sorted(b)) == (1.0, False)
    rnd = random.Random(11)
    for _ in range(200):
        n = rnd.randint(1, 6)
        d = [[rnd.choice([0, 0.5, 1, 2, 50]) for _ in range(n)] for _ in range(n)]
        got = spellings.optimal(d)
        assert sorted(got) == list(range(n)) and sum(d[i][j] for i, j in enumerate(got)) == min(sum(d[i][j] for i, j in enumerate(p)) for p in permutations(range(n)))


def test_alignment_of_two_values():
    al = lambda x, y: spellings.align(sorted(x.split()), sorted(y.split()))
    assert al("ferrow brothers roofing", "bros ferrow rfg") == (1.0, True) and al("giovanni berr", "berr gio") == (0.5, True) and al("giovanni berr", "g berr") == (0.5, True)
    assert al("kenneth amblobridge", "amblobrigde kenneth p") == (1.2, False) and al("kenneth amblobridge", "karen amblobridge") is None and al("k amblobridge", "amblobridge *paving") is None
    assert al("ferrow *paving", "ferrow") == (0.6, True) and al("ferrow *paving", "ferrow *roofing") is None and al("ferrow", "ferrow kalmora") is None and al("eric stone", "erica stone") is not None
    assert spellings.abbreviates("mgmt", "management") and spellings.abbreviates("constr", "construction") and not spellings.abbreviates("pat", "port") and not spellings.abbreviates("cat", "concert hall")


def linked(spark, values):
    return set(map(tuple, spellings.variant_pairs(spark.createDataFrame([(v,) for v in values], "party string")).collect()))


def test_names_of_no_list_are_linked(spark):
    groups = [["Ferrow Brothers Roofing", "Ferrow Bros Rfg", "FERROW BROS. ROOFING"], ["Giovanni Berr", "Gio Berr", "G. Berr"], ["Ferrow Paving LLC"], ["Wanjiru Otieno", "Otieno, Wanjiru"]]
    want = {(min(a, b), max(a, b)) for g in groups for i, a in enumerate(g) for b in g[:i]}
    assert linked(spark, [v for g in groups for v in g]) == want


def test_more_rows_take_no_link_away(spark):
    few = ["Kalmora Paving LLC", "Kalmera Paving LLC"]
    assert linked(spark, few) == {("Kalmera Paving LLC", "Kalmora Paving LLC")}
    more = ["Kalmrax Supply Inc", "Kalmrax Electric Co", "Kalmira Water Inc", "Kalm Bridge LLC", "Kalmoro Bank"]
    assert ("Kalmera Paving LLC", "Kalmora Paving LLC") in linked(spark, few + more)


def test_assignment_decides(spark, monkeypatch):
    """Pairs of the same keys are no variants by themselves: without the optimal assignment the result is another."""
    values = ["Ferrow Brothers Roofing", "Rfg. Ferrow Bros", "Ferrow Bridge Rafting", "Lundale Corvitt Paving", "Corvit Lundale Pvg", "Corvitt Dales Paving", "William Carrow", "Bill Carrow"]
    want = {("Ferrow Brothers Roofing", "Rfg. Ferrow Bros"), ("Bill Carrow", "William Carrow"), ("Corvit Lundale Pvg", "Lundale Corvitt Paving")}
    assert linked(spark, values) == want
    monkeypatch.setattr(spellings, "optimal", lambda d: list(range(len(d))))  # words in the order in which they stand
    assert linked(spark, values) != want


def test_every_near_word_is_compared(spark):
    rnd = random.Random(12)
    words = {"marlin": 1, "maplin": 1, "malina": 2} | {"".join(rnd.choice("abc") for _ in range(rnd.randint(4, 9))): rnd.choice([1, 1, 1, 2, 9, 30]) for _ in range(150)}
    got = {(r.word, r.lead): r.d for r in spellings.near_words(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert got["marlin", "maplin"] == 1
    for a, n in words.items():
        for b, m in words.items():
            if a != b and (m, a) > (n, b) and spellings.osa(a, b, 1) == 1:
                assert got[a, b] == 1
    assert all(d == spellings.osa(a, b, 2) and (d < 2 or words[b] >= spellings.FAR * words[a]) for (a, b), d in got.items())


# ---- 5


def page(n, ref):
    return f"- {n} -\nMetropolitan Board / {ref}\n"


def scanned(spark):
    rnd = random.Random(5)
    body = "the council shall inspect the hydrant and the long-term notice of the annual rental within the dock of the federal grant".split()
    rows = []
    for i in range(80):
        words = [rnd.choice(body) for _ in range(60)]
        lines = [" ".join(words[k : k + 10]) for k in range(0, 60, 10)]
        rows.append((i, "\n".join(lines[:3]) + "\n" + page(i % 30 + 1, f"L-{1000 + i}") + "\n".join(lines[3:])))
    rows += [
        (100, "the council sh!all inspect the hydrant".replace("sh!all", "sha1l")), (101, "the coun-\ncil shall inspect"), (102, "of the long-\nterm notice"),
        (103, "the hydrant shall be inspected within 3O days of the notice"), (104, "plain words of the council shall inspect the dock"), (105, None), (106, ""), (107, " \n "),
        (108, "the annual\n- l2 -\nMetropolitan Bo4rd / L-1007\nrental of the dock"), (109, "the annual fed-\n- 9 -\nMetropolitan Board / L-1009\neral grant"),
    ]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "id bigint, text string, repaired string")


def test_noise_is_found_and_mended(spark):
    df = scanned(spark)
    m = scans.learn(df.filter(F.length("text") > 0))
    got = {r.id: (set(r.kinds), r.repaired) for r in scans.scan_noise(df, ["id"], m).collect()}
    assert len(got) == df.count()
    assert got[100] == ({"misread"}, "the council shall inspect the hydrant") and got[101] == ({"hyphenation"}, "the council shall inspect")
    assert got[102] == (set(), "of the long-term notice") and got[103][0] == {"misread"} and "30 days" in got[103][1]
    assert got[104][0] == set() and got[105] == (set(), None) and got[106] == (set(), "") and got[107] == (set(), "")
    assert {"page_number", "misread"} <= got[108][0] and got[109] == ({"page_number", "header", "hyphenation"}, "the annual federal grant")
    assert got[3][0] == {"page_number", "header"} and "Metropolitan" not in got[3][1] and "\n" not in got[3][1]


def test_learning_from_nothing(spark):
    e = spark.createDataFrame([], "id bigint, text string")
    assert scans.scan_noise(e, ["id"], scans.learn(e)).count() == 0


def test_misreadings_share_their_strokes():
    for read, meant in scans.MISREAD.items():
        for m in meant:
            assert read.translate(scans.STROKES) == m.translate(scans.STROKES), (read, m)
            assert scans.misreads("x" + read + "p", "x" + m + "p") == 1 and not m.startswith(read[0])
    assert scans.misreads("siimmarv", "summary") == 2 and scans.misreads("hand", "hand") == 0 and scans.misreads("hydrant", "hydrate") == 3
    assert scans.misreads("a" * 5000 + "rn" + "b" * 900, "a" * 5000 + "m" + "b" * 900) == 1


def test_both_ways_of_looking_up_agree(spark):
    df = scanned(spark).filter("text is not null")
    m = scans.learn(df.filter(F.length("text") > 0))
    at_hand = sorted(map(str, scans.scan_noise(df, ["id"], m).collect()))
    assert at_hand == sorted(map(str, scans.scan_noise(df, ["id"], m, 0).collect()))


def vector_world(spark):
    """modem is read for modern beside roofs; modem is also a word of its own, beside networks."""
    rnd = random.Random(15)
    roof = "the modern roof and the modern beam of a tower stand over the street".split()
    net = "with one router each modem joins our network so every modem sends data".split()
    rows = [" ".join(rnd.choice(roof) for _ in range(40)) for _ in range(150)] + [" ".join(rnd.choice(net) for _ in range(40)) for _ in range(12)]
    rows += ["the modcrn roof and the beam"] * 3
    return spark.createDataFrame(list(enumerate(rows)), "id bigint, text string")


def test_vectors_decide_what_is_a_misreading(spark, monkeypatch):
    """A rare word is linked to a glyph neighbour only where that one's vector explains its contexts: with the vectors taken out,
    a word of its own is rewritten."""
    df = vector_world(spark)
    kinds = lambda: {r.id: r.kinds for r in scans.scan_noise(df, ["id"], scans.learn(df)).collect()}
    got = kinds()
    assert got[162] == ["misread"] and not any(got[i] for i in range(150, 162))
    monkeypatch.setattr(scans, "vectors", lambda x, u, noise, steps=30: np.zeros((len(x), u.shape[1]), np.float32))
    assert any(kinds()[i] for i in range(150, 162))


def test_every_word_fits_the_contexts(spark):
    """What the rarest of over 4,000 words stand beside moves the context vectors: the two worlds differ in that only."""
    def world(beside):
        rows = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} {'a b c d'.split()[i % 4]}a" for i in range(4100)] * 2
        return spark.createDataFrame([(t,) for t in rows + [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)} {beside(i)}" for i in range(200)]], "text string")

    one, other = (scans.learn(world(b)) for b in (lambda i: "aa" if i < 100 else "ba", lambda i: "aa" if i % 2 else "ba"))
    assert one.basis == other.basis and not np.array_equal(one.u, other.u)


def test_tasks_that_fit_together_agree(spark):
    """The fit is the same in one task, in several, and over plain arrays."""
    rnd = random.Random(8)
    rows = [(f"w{i}", sorted(rnd.sample(range(20), 3)), [rnd.randint(1, 90) for _ in range(3)]) for i in range(3 * scans.BUCKET)]
    ctx = spark.createDataFrame(rows, "word string, cs array<int>, ns array<bigint>").repartition(5)
    u, noise = scans.fit_contexts(ctx, 20, 1)
    for x, y in zip((u, noise), scans.fit_contexts(ctx, 20, 3)):
        assert np.array_equal(x, y)
    words = ctx.selectExpr("word", "cs", "ns", "pmod(xxhash64(word), 3) as b").toPandas().sort_values("word")
    plain, _ = scans.train([(k, scans.dense(g["cs"], g["ns"], 20)) for k, g in words.groupby("b")], 20)
    assert np.allclose(u, plain, atol=1e-4)
    empty = ctx.filter("false")
    assert scans.fit_contexts(empty, 4)[0].shape == (4, scans.DIM)


def test_headers_beyond_any_number_of_shapes(spark):
    """Running lines of very many files: each is found, however many other shapes are used more."""
    rows = [(i, f"the council shall inspect\n- {i % 9 + 1} -\nNotice Board {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'klmnopqrst'[i // 100]}\nthe hydrant {chr(97 + i % 26)}{i}") for i in range(1000) for _ in range(2)]
    rows += [(5000 + i, f"word{i} then the\n- {i} -\nLast Header Line\nend{i} of it") for i in range(1, 4)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {r.id: r.kinds for r in scans.scan_noise(df, ["id"], scans.learn(df), 0).collect()}
    assert all("header" in got[5000 + i] for i in range(1, 4))


# ---- 6


@pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary here")
def test_ids_equal_the_reference_library(spark, small):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    tk.encode_special_tokens = True
    rnd = random.Random(6)
    odd = ["", " ", "\n\n  x", "a" * 3000, "." * 900, "it's we'll I'M", "\x1c\x1d\x85   　z", "😀👍🏽 é ﬁ", "<|endoftext|>", "١٢٣ ½ Ⅷ", "日本語の文 中文。", "﻿x\t\r\n"]
    odd += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x2FFF), 32, 10])) for _ in range(rnd.randint(1, 80))) for _ in range(200)]
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts = odd + docs
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in bpe.encode_frame(df, "doc_id", "text").collect()}
    want = [e.ids for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want and got[len(texts)] == []
    n = {r.doc_id: r.n_tokens for r in bpe.count_frame(df, ["doc_id"], "text").collect()}
    assert n == {k: len(v) for k, v in got.items()}


def test_both_ways_of_merging_agree():
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 300, b"abab": 301, b"ba": 302, b"aa": 303, b"bab": 304}
    rnd = random.Random(0)
    for _ in range(500):
        w = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40)))
        assert bpe.merge_short(w, ranks) == bpe.merge_long(w, ranks)


# ---- 7


def test_mix_meets_its_targets(spark):
    rnd = random.Random(7)
    docs = [(i, s, rnd.randint(0, 400)) for i, s in enumerate(rnd.choice(["a"] * 20 + ["b"] * 5 + ["c", None, "unlisted"]) for _ in range(3000))]
    tokens = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(tokens, targets).collect()
    assert len({r.doc_id for r in m}) == len(m)
    most = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r.copies <= most[r.source] for r in m)
    total = sum(r.copies * r.n_tokens for r in m)
    for s, want in (("a", 0.4 / 0.9), ("b", 0.3 / 0.9), ("c", 0.2 / 0.9)):
        assert abs(sum(r.copies * r.n_tokens for r in m if r.source == s) - want * total) <= 800
    assert sorted(map(tuple, mixing.mix(tokens.repartition(7), targets).collect())) == sorted(map(tuple, m))
    sh = {r.source: r for r in mixing.shares(tokens, targets, mixing.mix(tokens, targets)).collect()}
    assert sh["gone"].reached_share == 0 and sh["unlisted"].copies == 0 and None in sh and abs(sum(r.reached_share for r in sh.values()) - 1) < 1e-9
    assert mixing.mix(tokens.limit(0), targets).count() == 0


def test_settling_keeps_the_mass():
    rnd = random.Random(8)
    for _ in range(200):
        n = rnd.randint(1, 30)
        w, p = [rnd.uniform(1, 50) for _ in range(n)], [rnd.random() for _ in range(n)]
        up, at, left = mixing.settle(list(range(n)), w, p, 0, 1)
        after = sum(x * y for x, y in zip(up, w)) + (left * w[at] if at >= 0 else 0)
        assert after == pytest.approx(sum(x * y for x, y in zip(p, w)), abs=1e-6)


def test_chances_are_kept():
    hits = sum(mixing.settle([1, 2, 3], [5.0, 5.0, 5.0], [0.2, 0.3, 0.5], 0, s)[0][2] for s in range(4000))
    assert hits / 4000 == pytest.approx(0.5, abs=0.03)


# ---- 8


def test_stuffed_pages_and_their_doubles(spark):
    rnd = random.Random(9)
    adj, noun = "annual federal outer minor public joint final upper".split(), "dock lease grant valve audit fence pump roof board trail".split()

    def sentence():
        return f"The {rnd.choice(adj)} {rnd.choice(noun)} was {rnd.choice(['paved', 'signed', 'moved', 'kept'])} by {rnd.randint(2, 99)} members because no {rnd.choice(noun)} could {rnd.choice(['wait', 'hold', 'open'])} before {rnd.choice(['May', 'June', 'winter'])}."

    text = lambda n: " ".join(sentence() for _ in range(n))
    docs = [(i, text(rnd.randint(4, 14))) for i in range(300)]
    spam = {
        900: " ... ".join(["roof repair"] * 60), 901: "\n".join(f"https://x.example/{rnd.choice(noun)}/{rnd.randint(1, 9999)}" for _ in range(40)),
        902: " ".join(f"#{rnd.choice(adj)}{rnd.choice(noun)}" for _ in range(60)), 903: "\n\n".join(rnd.choice(["roof repair", "roof repair Tarrow", "cheap roof repair"]) for _ in range(60)),
        904: sentence() + "\n\n" + ", ".join(rnd.choice(["cheap ", "best ", ""]) + "roof repair" + rnd.choice([" Tarrow", ""]) for _ in range(50)),
        905: " ".join(f"Our {a} roof repair Tarrow team does {a} roof repair, roof repair Tarrow." for a in adj * 3),
    }
    fine = {800: text(12) + "\n\n" + "roof repair, roof repair, roof repair", 801: "Schedule\n" + "\n".join(f"{i}  {rnd.choice(adj)} {rnd.choice(noun)}  {rnd.randint(9, 999)} EA  ${rnd.randint(100, 99999):,}" for i in range(30)), 802: None, 803: "", 804: "  \n ", 805: "word"}
    df = spark.createDataFrame([*docs, *spam.items(), *fine.items()], "doc_id bigint, text string").withColumn("ratio", F.lit(1))
    assert {r.doc_id for r in stuffing.stuffed_pages(df).collect()} == set(spam)
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


def test_would_be_sentences_are_no_prose():
    t = 'Cheap gutter repair Nashville. Best gutter repair Nashville, call today! Need gutter repair? Ask us! Gutter repair, Nashville: fast work. Honest gutter repair; "Nashville" prices! Gutter repair (Nashville) open late.'
    assert stuffing.block_features(t)[4] <= stuffing.SENTENCES
    prose = "The council met in May to hear the annual report. Members asked whether the dock would open before winter. No answer was given that day."
    assert stuffing.block_features(prose)[4] > stuffing.SENTENCES


def test_a_link_is_one_sign_to_the_compressor():
    links, words = "https://a.example/x https://b.example/y https://c.example/z", "two plain words of this length and nothing else, they say"
    ratio = lambda t: stuffing.redundancy(t, stuffing.BETWEEN.sub(" ", t))[1]
    assert ratio(links) < 0.5 * ratio(words)
    for t in ("tag:dock-lease tag:pump-roof", "dock > lease > roof\npump > audit > fence", "roof (12), dock (4), fence (77)", "#dock #roof #lease", "[a](http://x.y/z) [b](http://x.y/w)"):
        assert stuffing.LINKS.sub(stuffing.ONE, t).count(stuffing.ONE) >= 2


def test_compression_decides(spark, monkeypatch):
    """With the ratio taken out no page is found; with the punctuation taken out schedules and rolls come in."""
    rnd = random.Random(19)
    nouns = "dock lease grant valve audit fence pump roof board trail permit storm".split()
    docs = [(i, " ".join(f"The {rnd.choice(nouns)} near the {rnd.choice(nouns)} was moved by {rnd.randint(2, 99)} people before the {rnd.choice(nouns)} could open." for _ in range(rnd.randint(3, 9)))) for i in range(200)]
    spam = [(900 + i, "\n".join(f"https://x.example/{rnd.choice(nouns)}/{rnd.randint(1, 9999)}" for _ in range(30))) for i in range(5)]
    said_again = [(950, " ".join(["The dock was moved by nine people before the roof could open."] * 40))]
    df = spark.createDataFrame(docs + spam + said_again, "doc_id bigint, text string")
    found = lambda: {r.doc_id for r in stuffing.stuffed_pages(df).collect()}
    monkeypatch.setattr(stuffing, "keyword", lambda words: set())  # so that what is said again counts as sentences
    assert found() == {i for i, _ in spam}
    monkeypatch.setattr(stuffing, "SENTENCES", 99)
    monkeypatch.setattr(stuffing, "EXTREME", 0.0)
    assert found() == set()


# ---- all


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_and_keep_their_columns(spark, small, name):
    df = QUERIES[name](spark, small)
    want = {"p1_found": ["id_a", "id_b"], "p2_found": ["tbl", "id", "kind", "start_char"], "p3_found": ["id"], "p4_found": ["party_a", "party_b"], "p5_found": ["tbl", "id", "kind"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    rows = df.collect()
    assert df.columns == want.get(name, df.columns)
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)


def test_sql_agrees(spark, small):
    import duckdb

    c = duckdb.connect()
    for t in ("chunks", "documents", "contracts"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name, sql in SQL.items():
        assert sorted(map(tuple, QUERIES[name](spark, small).collect())) == sorted(c.execute(sql).fetchall())


# ---- very long texts, runs and empty tables


LONG = {
    "letters": "A" * 120_000, "dots": "." * 120_000 + "a", "blanks": " " * 120_000, "hyphens": "A-" * 60_000, "mails": "x@y.example, " * 8_000, "titles": "Mr. Roe " * 8_000,
    "hex": "0123456789abcdef" * 8_000, "brackets": "[(<a " * 20_000, "lines": "cut-\nting of words\n" * 6_000, "one word": "word " * 25_000, "quotes": "a'" * 60_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_texts_take_time_in_proportion(name):
    import time

    t = LONG[name]
    model = scans.Model([("w", "vvord", None, [{"target": "word", "less": -9.0, "vec": None}]), ("s", "worcl", None, None)], [], np.zeros((0, scans.DIM), np.float32))
    began = time.time()
    personal.find(t)
    [stuffing.block_features(b) for b in stuffing.blocks_of(t)]
    scans.repair(t, model)
    spans.Winnower().anchors(t)
    bpe.Encoder({bytes([i]): i for i in range(256)} | {b"wo": 300}).ids(t)
    assert time.time() - began < 15


def test_long_texts_are_cut(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(LONG.values())], "id bigint, text string, a bigint")
    n = pieces.split_items(df).agg(F.sum(F.length("piece") - F.col("overlap"))).head()[0]
    assert n == sum(map(len, LONG.values()))


def test_empty_tables_give_empty_results(spark):
    e = spark.createDataFrame([], "id bigint, text string, a bigint, ids string, key string")
    assert personal.personal_spans(e, "id", "text").count() == personal.redact(e, "id", "text").count() == pieces.split_items(e).count() == bpe.encode_frame(e, "id", "text").count() == 0


def test_extra_columns_with_clashing_names(spark):
    t = spark.createDataFrame([(1, "a", 10, 5, 7.0), (2, "a", 20, 5, 7.0)], "doc_id bigint, source string, n_tokens bigint, copies int, docs double")
    g = spark.createDataFrame([("a", 1.0, 1, 9)], "source string, target_share double, max_repeats int, tokens int")
    assert sorted(r.copies for r in mixing.mix(t, g).collect()) == [1, 1]
    d = spark.createDataFrame([(1, "one two", "x", 3)], "doc_id bigint, text string, ids string, n_tokens int")
    assert bpe.encode_frame(d, "doc_id", "text").columns == ["doc_id", "ids"]
    s = spark.createDataFrame([(1, "t", "x" * 300, 4, 5), (2, "u", "x" * 300, 4, 5)], "id bigint, token string, text string, own int, at int")
    assert spans.shared_pairs(spans.shared_classes(s)).count() == 1
