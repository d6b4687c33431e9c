"""Operators on small worlds with known answers, their controls and their edges."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import scalars as sc
from quarrystone.operators import aggregates as ag
from quarrystone.operators import alignment as al
from quarrystone.operators import evidence as ev
from quarrystone.operators import graph as gr
from quarrystone.operators import joins as jn
from quarrystone.operators import oplog as ol
from quarrystone.operators import ordered as od
from quarrystone.operators import pairs as pr
from quarrystone.operators import search as se
from quarrystone.plans import filters as ft
from quarrystone.plans import plan as pl
from quarrystone.sources import binary, markup, tabular


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- filters and plans


@pytest.fixture
def depts(spark):
    return spark.createDataFrame([(1, "FINANCE", "A", "2026"), (2, "FINANCE", "B", ""), (3, "LAW", None, "2026"), (4, "PARKS", "A", "2026")], "id int, dept string, vendor string, exp string")


def test_nested_filter(depts):
    t = ft.group("and", ft.condition("exp", "is", "2026"), ft.group("or", ft.condition("dept", "is", "finance"), ft.condition("dept", "is", "Parks ")))
    assert [r.id for r in ft.apply(depts, t).collect()] == [1, 4]


def test_unfinished_conditions_filter_nothing(depts):
    t = ft.group("and", ft.condition(), ft.condition("dept", "is", "  "), ft.group("or"))
    assert ft.apply(depts, t).count() == 4 and ft.active_count(t) == 0


def test_tree_edits_leave_the_tree_alone():
    t = ft.group("and", ft.condition("a", "is", "1"))
    u = ft.add(t, [], ft.group("or", ft.condition("b", "gt", "2")))
    assert len(t["items"]) == 1 and ft.active_count(u) == 2
    assert ft.patch(u, [1, 0], field="c")["items"][1]["items"][0] == ft.condition("c", "is", "")
    assert ft.remove(u, [0])["items"] == u["items"][1:] and ft.set_op(u, [1], "and")["items"][1]["op"] == "and"
    assert ft.active_count(ft.without(u, "b")) == 1 and [p for p, _ in ft.flatten(u)] == [(), (0,), (1,), (1, 0)]


def test_facet_counts_under_the_rest(depts):
    t = ft.group("and", ft.condition("dept", "is", "FINANCE"), ft.condition("exp", "is", "2026"))
    assert rows(ft.facet(depts, "dept", t)) == [("FINANCE", 1), ("LAW", 1), ("PARKS", 1)]


def test_empty_ops_and_numbers(spark):
    d = spark.createDataFrame([("1",), ("$2,000",), (None,), ("",), ("x",)], "v string")
    assert ft.apply(d, ft.group("and", ft.condition("v", "gt", "10"))).count() == 2  # 2,000 as a number, x as a text
    assert ft.apply(d, ft.group("and", ft.condition("v", "empty"))).count() == 2


def test_plan_is_checked(depts):
    with pytest.raises(pl.PlanError):
        pl.compile_plan(pl.Plan(type="x"), {"d": depts})
    with pytest.raises(pl.PlanError):
        pl.compile_plan(pl.Plan(type="d", filters=[{"field": "nope", "op": "eq"}]), {"d": depts})
    p = pl.Plan.from_json(json.dumps({"type": "d", "agg": {"fn": "count", "groupBy": "dept"}, "sort": {"field": "value", "dir": "desc"}, "limit": 1, "junk": 1}))
    assert pl.Plan.from_json(p.to_json()) == p and [tuple(r) for r in pl.compile_plan(p, {"d": depts}).collect()] == [("FINANCE", 2)]


# ---- joins and ordered


def test_as_of_takes_the_last_at_or_before(spark):
    f = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, None, 5)], "id int, k string, t int")
    s = spark.createDataFrame([("u", 2, "a"), ("u", 5, "b"), ("u", 5, "c"), ("v", 1, "z")], "k string, since int, role string")
    assert {r.id: r.role for r in jn.as_of(f, s, ["k"], "t", "since", "role").collect()} == {1: "c", 2: None, 3: None}


def test_range_join_finds_each_overlap_once(spark):
    rnd = random.Random(3)
    a = [(i, 1, float(s), float(s + rnd.randint(1, 40))) for i in range(40) for s in [rnd.randint(0, 200)]]
    b = [(i, 1, float(s), float(s + rnd.randint(1, 40))) for i in range(40) for s in [rnd.randint(0, 200)]]
    l, r = spark.createDataFrame(a, "i int, k int, s double, e double"), spark.createDataFrame(b, "j int, k int, s2 double, e2 double")
    want = sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])
    assert rows(jn.bucketed_range(l, r, ["k"], "s", "e", "s2", "e2", 10.0).select("i", "j")) == want


def test_mutual_best_refuses_ties(spark):
    s = spark.createDataFrame([(1, 9, 2.0), (1, 8, 1.0), (2, 9, 1.0), (3, 7, 5.0), (3, 6, 5.0)], "a int, b int, score double")
    assert rows(jn.mutual_best(s).select("a", "b")) == [(1, 9)]


def test_islands_and_short_runs(spark):
    d = spark.createDataFrame([("s", i, float(i), float(i + 1), v) for i, v in enumerate("aaaabaaaacccccc")], "k string, i int, s double, e double, v string")
    runs = od.islands(d, ["k"], ["i"], "v", "s", "e")
    assert sorted((r.start, r.v, r.n) for r in runs.collect()) == [(0.0, "a", 4), (4.0, "b", 1), (5.0, "a", 4), (9.0, "c", 6)]
    assert sorted((r.start, r.v, r.n) for r in od.absorb_short(runs, ["k"], "v").collect()) == [(0.0, "a", 9), (9.0, "c", 6)]


def test_loops_need_more_than_chance():
    assert od.collapse_loops("a b a b a b a b a b c".split()) == [("a", 5), ("b", 5), ("c", 1)]
    assert od.collapse_loops("a a b".split()) == [("a", 1), ("a", 1), ("b", 1)]


def test_surprise_carries_over_frames():
    import pandas as pd

    d = pd.DataFrame({"doc": [1, 1, 1, 2], "seq": [1, 2, 3, 1], "a": list("xxxx"), "b": list("yyyy"), "neg": [False, True, True, False], "measure": [None] * 4, "value": [None] * 4})
    whole = pd.concat(od.surprise([d]))["excess"].tolist()
    assert whole == pd.concat(od.surprise([d[:1], d[1:2], d[2:]]))["excess"].tolist() == [1.0, 1.5, 0.0, 1.0]


def test_interpolation_by_weight(spark):
    d = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, None, 1.0), (1, 3, None, 2.0), (1, 4, 8.0, 1.0), (1, 5, None, 1.0)], "k int, i int, v double, w double")
    assert [r.filled for r in od.interpolate(d, ["k"], ["i"], "v", "w").orderBy("i").collect()] == [0.0, 2.0, 4.0, 8.0, 8.0]


def test_draws_do_not_hang_on_partitions(spark):
    d = spark.createDataFrame([(i, float(i + 1)) for i in range(50)], "k bigint, w double")
    a, b = (rows(od.cumulative_draws(d.repartition(n), "k", "w", 30, 5)) for n in (1, 7))
    assert a == b and len(a) == 30


# ---- aggregates and evidence


def test_pivot_totals_keep_blank_labels_apart(spark):
    d = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "r string, c string")
    got = {(r.r, r.c, r.level): r.value for r in ag.pivot_totals(d, F.col("r"), F.col("c"), F.count("*")).collect()}
    assert got[(None, None, 3)] == 3 and got[("a", None, 0)] == 1 and got[("a", None, 1)] == 2 and got[(None, "x", 2)] == 2
    page, flags = ag.pivot_page(d, F.col("r"), F.col("c"), F.count("*"), most_rows=1)
    assert flags.head() == (True, False) and page.filter("level = 1").count() == 1


def test_profile_of_an_empty_table(spark):
    p = ag.profile_fields(spark.createDataFrame([], "a string, b int"), ["a", "b"])
    assert {r.kind for r in p.collect()} == {"empty"} and ag.label_field(p) == "a"


def test_saturation_matches_leaving_out(spark):
    m = [("a", 1), ("a", 2), ("b", 1), ("c", 3), ("d", 2), ("d", 3), ("e", 1), ("a", 1)]
    d = spark.createDataFrame(m, "item string, doc int")
    docs = {x for _, x in m}

    def f1(skip):
        s = {}
        for i, x in set(m):
            if x != skip:
                s.setdefault(i, set()).add(x)
        return sum(len(v) == 1 for v in s.values())

    assert ev.saturation(d, "item", "doc").head().worst == pytest.approx(max(f1(x) / (len(docs) - 1) for x in docs))


def test_exact_tail_against_counting(spark):
    from math import comb

    d = spark.createDataFrame([(n, k, m) for n in (5, 9) for k in range(0, 5) for m in range(0, 5)], "n int, k int, m int")
    for r in d.withColumn("p", ev.hyper_at_least_one(F.col("n"), F.col("k"), F.col("m"))).collect():
        assert r.p == pytest.approx(1 - comb(r.n - r.k, r.m) / comb(r.n, r.m), abs=1e-9)


def test_holm_stops_at_the_first_failure(spark):
    d = spark.createDataFrame([(1, 0.001), (2, 0.04), (3, 0.03), (4, 0.2)], "id int, p double")
    assert [r.id for r in ev.holm(d).filter("kept").collect()] == [1]


def test_ordinary_text_rarely_clears_the_null(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    counts = [(d, w, rnd.randint(0, 3)) for d in range(150) for w in words]
    c = spark.createDataFrame([x for x in counts if x[2]], "doc int, stem string, n int")
    bg = ev.background(c.groupBy("stem").agg(F.sum("n").alias("n"))).filter("stem in ('w1', 'w2', 'w3')")
    assert ev.relevance(c, bg).filter("relevant").count() <= 3
    loud = c.unionAll(spark.createDataFrame([(999, "w1", 60), (999, "w9", 20)], "doc int, stem string, n int"))
    assert 999 in {r.doc for r in ev.relevance(loud, bg).filter("relevant").collect()}


def test_sets_reconcile(spark):
    s = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert dict(rows(ag.reconcile_sets(s(1, 2, 3, 4), s(2, 3), s(3, 9), "k"))) == {"archived": 2, "queue": 1, "backlog": 2, "outside": 1}


# ---- graphs and logs


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    e = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(500, 600 + i) for i in range(80)]
    to = {x: x for p in e for x in p}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in e:
        a, b = sorted((root(a), root(b)))
        to[b] = a
    got = {r.node: r.component for r in gr.components(spark.createDataFrame(e, "src int, dst int")).collect()}
    assert got == {x: root(x) for p in e if p[0] != p[1] for x in p}


def test_graphs_of_all_order_lines(spark):
    from collections import Counter
    from types import SimpleNamespace

    from quarrystone.queries import graphs as qg
    from quarrystone.queries import relational as qr

    orders = [(i, 10 + i // 2) for i in range(8)]
    lines = [(0, 1, 3.0, 0.05), (1, 2, 50.0, 0.01), (2, 2, 7.0, 0.05), (4, 3, 49.0, 0.0), (6, 4, 1.0, 0.1), (7, 3, 2.0, 0.1), (7, 3, 2.0, 0.1)]
    t = SimpleNamespace(
        orders=spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint"),
        lineitem=spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_quantity double, l_discount double"),
        supplier=spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "s_suppkey bigint, s_nationkey int"),
    )
    edges = {(dict(orders)[o], s) for o, s, _, _ in lines}
    assert {r.node: r.component for r in qg.components_all(t).collect()} == {10: 10, 11: 10, 12: 12, 13: 12, 1000001: 10, 1000002: 10, 1000003: 12, 1000004: 12}
    assert {r.node: r.ring for r in qg.bfs_rings_all(t).collect()} == {1000001: 0, 10: 1, 1000002: 2, 11: 3}
    assert {(r.a, r.c): r.ways for r in qr.two_hop_compose_all(t).collect()} == Counter((c, s % 2 + 100000) for c, s in edges)


def test_layers_raise_on_a_circle(spark):
    assert dict(rows(gr.layers(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src int, dst int")))) == {1: 0, 2: 1, 3: 2}
    with pytest.raises(ValueError):
        gr.layers(spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int"), 5)


def test_circles_lose_their_weakest_edge():
    e = [(1, 2), (2, 3), (3, 1), (3, 4)]
    assert gr.back_edges(e, {(2, 3): 0.5}) == [(2, 3)] and gr.topological([x for x in e if x != (2, 3)]) == [3, 1, 2, 4]


def test_drive_undo_restores(spark):
    rnd = random.Random(7)
    for _ in range(200):
        s = {"folders": {}, "places": {}}
        for _ in range(rnd.randint(1, 8)):
            s = ol.apply_drive(s, step(rnd))
        e = step(rnd)
        t = ol.apply_drive(s, e)
        for back in ol.inverse_drive(s, e):
            t = ol.apply_drive(t, back)
        assert shown(t) == shown(s), (s, e, t)


def shown(s):
    """What is visible: what stands in a folder that is gone stands nowhere."""
    f = s["folders"]
    return {i: {**x, "parent": x["parent"] if x["parent"] in f else None} for i, x in f.items()}, {i: p if p in f else None for i, p in s["places"].items()}


def step(rnd):
    op = rnd.choice(["folder", "rename", "move", "trash", "restore", "place", "forget"])
    i = rnd.choice("abc") if op not in ("place",) else rnd.choice("xy")
    return {"op": op, "id": i, "name": rnd.choice(["n", "m"]), "parent": rnd.choice([None, "a", "b"])}


def test_folders_never_run_in_circles():
    s = ol.fold_drive([{"op": "folder", "id": "a"}, {"op": "folder", "id": "b", "parent": "a"}, {"op": "move", "id": "a", "parent": "b"}])
    assert s["folders"]["a"]["parent"] is None


def test_talk_refuses_with_reason(spark):
    ev_ = spark.createDataFrame([(1, 1, "ann", "comment", "t", "hi"), (2, 2, "bob", "edit", "1", "hacked"), (3, 3, "ann", "edit", "1", "hi!"), (4, 4, "eve", "comment", "t", "x")], "event_id string, ts int, sender string, op string, target string, body string")
    led = spark.createDataFrame([("ann", 0, "editor"), ("bob", 0, "viewer")], "sender string, since int, role string")
    c, no = ol.fold_talk(ev_, led, "ann")
    assert [(r.id, r.body) for r in c.collect()] == [("1", "hi!")] and dict(rows(no)) == {"2": "not the author", "4": "no role then"}


def test_edits_say_why_they_are_skipped():
    to, skipped = ol.apply_edits(["a", "b", "c"], [{"op": "SYN", "a": "a", "b": "b"}, {"op": "SYN", "a": "a", "b": "b"}, {"op": "SEG", "a": "b"}, {"op": "SYN", "a": "z", "b": "a"}])
    assert to == {"a": "a", "b": "b", "c": "c"} and [s["why"] for s in skipped] == ["already one", "no such referent"]


# ---- search and pairs


def test_all_terms_last_a_prefix(spark):
    d = spark.createDataFrame([(1, "Federal inspection of the dock"), (2, "inspector federal"), (3, "federal dock"), (4, None), (5, "")], "id int, t string")
    assert rows(se.match_all(se.inverted(d, "id", "t"), "id", "federal insp")) == [(1,), (2,)]
    assert rows(se.match_all(se.inverted(d, "id", "t"), "id", "")) == [] and se.terms_of("a b c d e f g h i")[1]


def table_of(p, t):
    """Approximate occurrences by the plain table."""
    col, best = list(range(len(p) + 1)), (len(p), 0)
    for j, c in enumerate(t, 1):
        last, col[0] = col[0], 0
        for i, q in enumerate(p, 1):
            last, col[i] = col[i], min(col[i] + 1, col[i - 1] + 1, last + (q != c))
        best = min(best, (col[-1], j))
    return best


def test_bits_give_what_the_table_gives():
    rnd = random.Random(9)
    for _ in range(400):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(2))
        assert se.sellers(p, t * 2) == table_of(p, t * 2)


def test_fuzzy_has_no_false_dismissals(spark):
    rnd = random.Random(5)
    q = "governing lease of the dock"
    texts = []
    for i in range(60):
        s = list("xx yy " + q + " zz ww")
        for _ in range(rnd.randint(0, 6)):
            s[rnd.randrange(6, 6 + len(q))] = rnd.choice("abcdefgh")
        texts.append((i, "".join(s)))
    d = spark.createDataFrame(texts, "id int, t string")
    fold = str.maketrans("1|i!0", "llllo")
    want = sorted(i for i, t in texts if table_of(q.translate(fold), t.translate(fold))[0] <= se.edits_allowed(q))
    assert [r[0] for r in rows(se.fuzzy_search(d, "id", "t", q))] == want


def test_resolution_refuses_two_referents(spark):
    n = spark.createDataFrame([("Ann Lee", "1"), ("Ann Roe", "2"), ("Bob Lee", "3")], "name string, ref string")
    assert se.resolve(n, "name", "ref", "ann").count() == 0 and se.resolve(n, "name", "ref", "bob").head().referent == "3"


def test_swaps_count_one():
    assert pr.osa("abcd", "abdc") == 1 and pr.osa("abcd", "badc") == 2 and pr.osa("abc", "xyz") == 3


def test_near_copies_keep_every_link(spark):
    rnd = random.Random(6)
    base = [[rnd.choice("abcdefghijklmnop") * 3 + str(rnd.randint(0, 30)) for _ in range(60)] for _ in range(4)]
    docs = []
    for i in range(40):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = "zz" + str(rnd.randint(0, 99))
        docs.append((i, " ".join(w)))
    docs += [(100, docs[0][1]), (101, None), (102, ""), (103, "one two")]

    def sh(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    S = {i: sh(t) for i, t in docs}
    text = dict(docs)
    want = {i: len({text[j] for j in S if text[j] != text[i] and S[i] and S[j] and len(S[i] & S[j]) >= 0.8 * len(S[i] | S[j])}) for i in S}
    got = {r.id: r.links for r in pr.shingle_jaccard(spark.createDataFrame(docs, "id int, t string"), "id", "t").collect()}
    assert got == want


# ---- scalars


def test_scalars_take_nulls_and_empties(spark):
    d = spark.createDataFrame([(None,), ("",), ("  The Café\tat 1999 ",), ("😀" * 5,)], "x string")
    fs = [sc.clean, sc.fold, sc.snake, sc.title_line, sc.ocr_fold, sc.value_format, sc.shape_of, sc.coerce_number, sc.money, sc.frame_of, sc.negated, sc.statements, sc.words, sc.bag, sc.citations, sc.norm_url, sc.url_host, sc.fnv1a32, sc.referent_key]
    got = d.select(*[f("x").alias(f.__name__) for f in fs]).collect()
    assert got[2].clean == "The Café at 1999" and got[2].fold.strip().startswith("the cafe") and got[0].words == []


def test_formats(spark):
    want = {"$1,200.50": "currency", "2020-01-02": "date", "1/2/2020": "date", "10:30 pm": "time", "a@b.c": "email", "(615) 555-0100": "phone", "Yes": "choice", "P-22441": "identifier", "42": "integer", "4.2": "decimal", "Ann Lee": "name", "x" * 61: "free-text", "?!": "text", "": "empty"}
    d = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r.v: r.f for r in d.select("v", sc.value_format("v").alias("f")).collect()} == want


def test_fnv_and_clock(spark):
    r = spark.range(1).select(sc.fnv1a32(F.lit("a")).alias("h"), sc.clock(F.lit(3725.9)).alias("c"), sc.clock_seconds(F.lit("1:02:05.5")).alias("s"), sc.human_size(F.lit(1536)).alias("z")).head()
    assert r.h == 0xE40C292C and r.c == "1:02:05" and r.s == 3725.5 and r.z == "1.5 kB"


# ---- sources


def test_statement_spans_are_slices():
    t = "Mr. Smith met Dr. Jones. They spoke!\n  New line here. \n"
    assert [t[s:e] for s, e in al.statement_spans(t)] == ["Mr. Smith met Dr. Jones.", "They spoke!", "New line here."]


def test_html_reading():
    h = "<html><head><title>T</title></head><body><nav><p>menu menu menu</p></nav><div><h2>Fees</h2><p>First paragraph that matters a lot.</p><p>Second.</p><table><tr><th>A</th><th>A</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table></div></body></html>"
    assert markup.main_content(h) == "Fees\n\nFirst paragraph that matters a lot.\n\nSecond."
    assert markup.html_tables(h) == [{"name": "Fees", "header": ["A", "A 2"], "rows": [["1", "2"], ["3", ""]]}]
    assert markup.main_content(None) == "" and markup.html_tables("<table><tr><td>x") == []


def test_captions_of_all_kinds():
    assert markup.captions("WEBVTT\n\n00:01.000 --> 00:02.500\n<b>Hello</b> you") == markup.captions('{"segments":[{"start":1,"end":2.5,"text":"Hello you"}]}') == [(1.0, 2.5, "Hello you")]
    assert markup.captions(None) == [] and markup.captions("{broken") == []


def test_chunks_cover_the_text():
    rnd = random.Random(2)
    t = " ".join("w" * rnd.randint(1, 30) for _ in range(900)) + "y" * 3000
    c = tabular.overlapping_chunks(t)
    assert c[0][0] == 0 and c[-1][1] == len(t) and all(b - a <= 1200 for a, b in c) and all(x[1] >= y[0] for x, y in zip(c, c[1:]))
    assert tabular.overlapping_chunks("") == []


def test_wav_windows():
    import io
    import wave

    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(b"\x00\x40" * 2 * 8000 * 3)
    got = binary.pcm_windows(b.getvalue(), 2.0)
    assert [(i, n) for i, _, n, _, _ in got] == [(0, 32000), (1, 16000)] and got[0][3] == pytest.approx(0.5)


def test_sniff_by_bytes(spark):
    d = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n0"),), (bytearray(b"hello there"),), (bytearray(b"RIFF....WAVEfmt "),), (bytearray(b""),), (bytearray(b"\x00\x01\x02"),)], "c binary")
    assert [r[0] for r in d.select(binary.sniff(F.col("c"))).collect()] == ["png", "text", "wav", "empty", "unknown"]


def test_broken_files_are_gaps(spark):
    d = spark.createDataFrame([("a", bytearray(b"no zip"))], "path string, content binary")
    r = binary.over_files(d, binary.xlsx, "sheet string, row int, col string, value string").head()
    assert r.sheet is None and "BadZipFile" in r.gap


def test_half_floats_round_trip(spark):
    d = spark.createDataFrame([(1, [0.5, -1.25, 2.0]), (2, None)], "id int, v array<float>")
    assert rows(tabular.unpack_vectors(tabular.pack_vectors(d, "v"), "v").filter("id = 1")) == [(1, [0.5, -1.25, 2.0])]


def test_jsonl_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    good, bad = tabular.read_jsonl(spark, str(tmp_path), "a int")
    assert rows(good) == [(1,), (2,)] and bad.head().line == "{broken"


def test_index_log_tombstones(spark):
    d = spark.createDataFrame([("doc", "a", 1, "x"), ("doc", "a", 2, "y"), ("tombstone", "b", 3, None), ("doc", "b", 1, "z"), ("doc", "c", 9, "w"), ("tombstone", "c", 3, None)], "kind string, id string, seq int, payload string")
    assert rows(tabular.fold_index(d)["doc"]) == [("a", "y"), ("c", "w")]


def test_alignment_of_what_was_heard():
    a = al.align(["hello there my dear friends", "nobody said any of this at all", "we meet again today now"], [(0, 2, "hello there my friends"), (2, 5, "so we meet again today now")])
    assert a["status"].tolist() == ["ok", "none", "ok"] and a["start"].dropna().is_monotonic_increasing


def test_cuts_only_where_words_shift():
    two = ["apple pear plum fruit orchard"] * 5 + ["engine wheel brake motor gears"] * 5
    assert al.paragraph_cuts(two) == [5] and al.paragraph_cuts(two[:5]) == []


def test_sorts_by_expiry(spark, small):
    from quarrystone.queries import QUERIES

    got = [r.expires or "" for r in QUERIES["named_sorts"](spark, small).collect()]
    assert got == sorted(got, key=lambda x: (x[-4:], x), reverse=True)


def test_blocked_vectors_against_all_pairs(spark):
    import numpy as np

    from quarrystone.operators import vectors as vc

    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = [(i, v[i].tolist()) for i in range(300)] + [(900, None), (901, []), (902, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    n = np.linalg.norm(v, axis=1)
    want = []
    for q in range(0, 300, 50):
        if n[q]:
            s = [(-round(float(v[q] @ v[i] / n[q] / n[i]), 12), i) for i in range(300) if i != q and n[i]]
            want += [(q, i, r) for r, (_, i) in enumerate(sorted(s)[:7], 1)]
    got = rows_of(vc.search(df.repartition(5), df.filter("id % 50 = 0"), "id", "v", 7).select("query", "key", "rank"))
    assert got == sorted(want)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_draws_follow_weights(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "k string, w double")
    got = [r.k for r in od.cumulative_draws(d, "k", "w", 2000, 1).collect()]
    assert len(got) == 2000 and abs(got.count("b") / 2000 - 0.75) < 0.04 and "c" not in got


def test_stages_are_written_and_purged(spark):
    import os

    from quarrystone.session import cut, purge, shared_dir

    d = cut(spark.range(10), "x")
    assert d.count() == 10 and os.listdir(os.path.join(shared_dir(spark), "quarrystone"))
    purge(spark)
    assert not os.path.exists(os.path.join(shared_dir(spark), "quarrystone"))


def test_stages_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from quarrystone.session import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: d)
    sc = SimpleNamespace(getConf=lambda: conf, applicationId="none", master="spark://h:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=conf))


# ---- what was said, and how sure chance is


def test_denials(spark):
    yes = ["It shall not open", "They didn't agree", "There is no dock", "neither of them", "It can’t hold", "No, 5 were left", "the lease prohibits it", "no no. 5"]
    no = ["No. 5 is open", "see no 12", "notable knots", "the note", "", "annotated", "nobody"]
    d = spark.createDataFrame([(x,) for x in yes + no], "t string")
    assert [r[0] for r in d.select(sc.negated("t")).collect()] == [True] * len(yes) + [False] * len(no)


def test_names_and_figures_of_statements():
    from quarrystone.operators.alignment import figures_in, names_in

    t = "Then it was said that the Bank of Ashmere and Mary-Ann Lee's firm paid $1,200.50, 3 million dollars and 12% of 40 trucks in 1998 at 10:30 am, on the 5th."
    assert [n for n, _, _ in names_in(t)] == ["Bank of Ashmere", "Mary-Ann Lee"] and all(t[s:e] == n for n, s, e in names_in(t))
    assert [(v, u) for _, v, u, _, _ in figures_in(t)] == [(1200.5, "dollars"), (3e6, "dollar"), (12.0, "percent"), (40.0, "truck")]
    assert all(t[s:e] == raw for raw, _, _, s, e in figures_in(t)) and names_in("Ashmere paid") == [] and figures_in("in 1998, 7") == []


def test_permutation_rate_against_shuffles(spark):
    from quarrystone.operators.evidence import permutation_rate

    rnd = np.random.default_rng(4)
    l, r = rnd.choice(list("abc"), 900, p=[0.6, 0.3, 0.1]), rnd.choice(list("abd"), 900, p=[0.5, 0.3, 0.2])
    df = spark.createDataFrame([(i, str(x), str(y)) for i, (x, y) in enumerate(zip(l, r))], "k int, l string, r string")
    got = permutation_rate(df, "k", "l", "r").head()
    real = np.sort([(l == rnd.permutation(r)).mean() for _ in range(4000)])
    assert got.observed == pytest.approx((l == r).mean()) and got.p999 == pytest.approx(real[int(0.999 * 3999)], abs=0.01) and got.expected == pytest.approx(real.mean(), abs=0.003)
    few = permutation_rate(df, "k", "l", "r", exact=1).head()
    assert few.p999 == pytest.approx(got.p999, abs=0.02)


def test_chosen_statements_equal_the_plain_greedy():
    import pandas as pd

    from quarrystone.operators.pairs import select_mmr

    rnd = np.random.default_rng(6)
    n = 40
    rows = pd.DataFrame({"doc": "d", "id": range(n), "worth": rnd.random(n), "terms": [list(map(str, rnd.choice(12, 4, replace=False))) for _ in range(n)], "ws": [list(rnd.random(4)) for _ in range(n)]})
    vec = [dict(zip(t, w)) for t, w in zip(rows["terms"], rows["ws"])]
    cos = lambda p, q: sum(w * q.get(t, 0) for t, w in p.items()) / (sum(w * w for w in p.values()) * sum(w * w for w in q.values())) ** 0.5
    left, want = list(range(n)), []
    while left and len(want) < 9:
        best = max(left, key=lambda i: (0.6 * rows["worth"][i] - 0.4 * max([0, *(cos(vec[i], vec[c]) for c in want)]), -i))
        want.append(best)
        left.remove(best)
    assert list(select_mmr(rows, 9, 0.6)["id"]) == want
