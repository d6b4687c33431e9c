"""Readers and sinks on files of their own."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from quarrystone.operators import alignment as al
from quarrystone.operators import oplog as ol
from quarrystone.sources import binary, markup, tabular


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_delimited_with_quotes_and_blank_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"two; with ""quotes"""\n;\n3;"line\nbreak"\n')
    d = tabular.read_delimited(spark, str(tmp_path / "a.csv"))
    assert rows(d) == [("1", 'two; with "quotes"'), ("3", "line\nbreak")]


def test_export_says_what_it_left_out(spark, tmp_path):
    d = spark.range(5).select(F.col("id").alias("n"), F.lit("ä").alias("t"))
    assert tabular.export_csv(d, str(tmp_path / "o"), most=3) and not tabular.export_csv(d, str(tmp_path / "p"))
    text = next((tmp_path / "p").glob("part*")).read_text("utf-8")
    assert text.startswith("﻿") or text.startswith('"﻿') and text.count("\n") == 6


def test_changed_files_replace_their_chunks(spark):
    s = "token string, size int, mtime int"
    files, known = spark.createDataFrame([("a", 1, 1), ("b", 2, 9)], s), spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 1, 1)], s)
    chunks, fresh = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "token string, t string"), spark.createDataFrame([("a", "new"), ("b", "new")], "token string, t string")
    assert rows(tabular.changed_chunks(files, known, chunks, fresh)) == [("a", "old"), ("b", "new")]


def test_refresh_drops_rows_without_a_key(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (" ", 4, "w")], "k string, t int, v string")
    assert rows(tabular.refresh_by_key(d, "k", "t")) == [("a", 2, "y")]


def test_zstd_lines(spark, tmp_path):
    import zstandard

    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.compress(b'{"a": 1}\n{"a": 2}\n'))
    assert rows(tabular.read_jsonl(spark, str(tmp_path), "a int")[0]) == [(1,), (2,)]


def test_timemap():
    t = '<http://a/>; rel="original",\n<http://m/1>; rel="first memento"; datetime="Tue, 01 Jan 2019 00:00:00 GMT"; status="200"; length="5000"'
    assert tabular.parse_timemap(t) == [("http://m/1", "Tue, 01 Jan 2019 00:00:00 GMT", "200", 5000)] and tabular.parse_timemap(None) == []


def test_grids(spark):
    assert tabular.grid_from_text("Item   Qty\nbolt   2\n\nplain line") == [["Item", "Qty"], ["bolt", "2"]]
    w = [("p", 0.0, 0.0, "Item"), ("p", 50.0, 1.0, "Qty"), ("p", 2.0, 20.0, "big"), ("p", 8.0, 21.0, "bolt"), ("p", 51.0, 20.0, "2")]
    got = rows(tabular.grid_from_elements(spark.createDataFrame(w, "page string, x double, y double, text string"), "page"))
    assert got == [("p", 1, 1, "Item"), ("p", 1, 2, "Qty"), ("p", 2, 1, "big bolt"), ("p", 2, 2, "2")]


def test_spreadsheet():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hi</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>4.5</v></c><c r="C1"/></row></sheetData></worksheet>')
    assert binary.xlsx(b.getvalue()) == [("S", 1, "A", "hi"), ("S", 1, "B", "4.5")]


def test_notations():
    track = b"\x00\x90\x3c\x40\x60\x3e\x40\x00\xff\x2f\x00"
    assert binary.midi(b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(track)) + track) == [(0, 0, 0, 60), (0, 96, 0, 62)]
    assert binary.musicxml(b'<s><part id="P"><measure number="1"><note><pitch><step>C</step><alter>1</alter><octave>4</octave></pitch></note><note><rest/></note></measure></part></s>') == [("P", 1, "C#4")]
    assert binary.abc('T:Air\nM:3/4\nK:D\n"G"abc d2|') == {"title": "Air", "metre": "3/4", "key": "D", "notes": 4}
    assert binary.tex_text(r"\section{Hello} world $x^2$ % no" + "\n" + r"\textbf{bold}") == "Hello world bold"
    assert binary.mathml_text("<math><mi>x</mi><mo>+</mo><mn>1</mn></math>") == "x + 1" and binary.strings(b"\x00abcd\x01ab") == ["abcd"]


def test_markdown_and_metadata():
    assert markup.markdown_transcript("# Title\n\n- [0:05] **bold** [link](http://x)") == [(None, "Title"), (5.0, "bold link")]
    m = markup.metadata('<meta property="og:title" content="T"><script type="application/ld+json">{"author":{"name":"Ann"}}</script>')
    assert m["title"] == "T" and m["author"] == "Ann" and m["published"] is None


def test_tables_of_one_header_are_one(spark):
    h = "<table><caption>C</caption><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    got = markup.table_cells(spark.createDataFrame([(1, h), (2, h), (3, None)], "id int, html string"), "id", "html")
    assert got.select("header_key").distinct().count() == 1 and got.count() == 8


def test_key_values_keep_their_section():
    assert al.figure_table("FEES\nRent: $1,200\nShare: 5%\nDue: 1/2/2020\nNote  see below") == [("FEES", "Rent", "$1,200", "amount"), ("FEES", "Share", "5%", "percent"), ("FEES", "Due", "1/2/2020", "date"), ("FEES", "Note", "see below", "text")]
    assert al.hang("def f(x):\n    return x;") == "code" and al.hang("") == "undecided" and al.reads_as_words("the dock", {"the", "dock"})


def test_schema_events_and_violations(spark):
    e = spark.createDataFrame([("1", "x", "ins", 1), ("2", "x", "rec", 2), ("3", "x", "def", 3)], "event_id string, anchor string, op string, ts int")
    assert rows(ol.order_violations(e)) == [("3", "x", "def", "rec")]
    p = spark.createDataFrame([("f", 3, 2, "text")], "field string, filled long, n_distinct long, kind string")
    assert rows(ol.schema_events(p)) == [("def", "_schema.f", "type", "text", "3 filled, 2 distinct")]
    s = spark.createDataFrame([("a", "p", "1", 1, "e1"), ("a", "p", "2", 2, "e2"), ("a", "q", None, 3, "e3")], "anchor string, path string, value string, ts int, event_id string")
    assert rows(ol.entity_table(ol.fold_entities(s), ["p", "q"])) == [("a", "2", None)]


def test_inbox(spark):
    c = spark.createDataFrame([("1", 1, "ann", "t", "hi @bob", False, False), ("2", 5, "ann", "t", "x", False, True), ("3", 6, "bob", "t", "y", False, False)], "id string, ts int, author string, thread string, body string, deleted boolean, resolved boolean")
    m = spark.createDataFrame([("t", "bob", 2), ("t", "bob", 1)], "thread string, me string, up_to int")
    pick = lambda w: [r.id for r in ol.inbox(c, m, "bob", w).orderBy("id").collect()]
    assert pick("unread") == ["2"] and pick("mentions") == ["1"] and pick("mine") == ["3"] and pick("resolved") == ["2"] and pick("open") == ["1", "3"]
