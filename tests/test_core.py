"""The engine's own operators: figures, units, tables, sections, terms, risk, review, and the catalogue against DuckDB."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerlens.functions import text as tx
from ledgerlens.functions.figures import FIGURE, figures, raw_figures, spans
from ledgerlens.functions.units import UNIT, chinese_numeral, unit_from_note
from ledgerlens.operators import glossary, numdiff, retrieval, review, risk, sections, tables, translate
from ledgerlens.operators.keep import writer
from ledgerlens.plans import catalogue
from ledgerlens.sources import html_tables, layout

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(names) == sorted(got.columns)
    key = sorted(names)
    assert sorted(str([r[c] for c in key]) for r in rows) == sorted(str([r[names.index(c)] for c in key]) for r in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20


def test_spans_equal_finditer(spark):
    texts = ["", "a1b22", "(1,234.5) and -3.5% of .5, 2022-2023", "1,2345 12,34 é７ (5%) (7 )", "x" * 50 + "9" * 20]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans(F.col("t")).alias("s")).collect()
    for r in got:
        assert [(s["raw"], s["start"], s["end"]) for s in r["s"]] == [(m[0], *m.span()) for m in re.finditer(FIGURE, r["t"])]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("revenue of 1,234.5 million", [(1234.5, "money", 1e6)]),
        ("up 12.5%", [(12.5, "ratio", 0.01)]),
        ("(1,234)", [(-1234.0, "unknown", 1.0)]),
        ("(5%)", [(5.0, "ratio", 0.01)]),
        ("RMB'000", []),
        ("300万元", [(300.0, "money", 1e4)]),
        ("$5", [(5.0, "money", 1.0)]),
        ("100 shares at 20 bps", [(100.0, "count", 1.0), (20.0, "ratio", 1e-4)]),
        ("5k and 5 km", [(5.0, "money", 1e3), (5.0, "unknown", 1.0)]),
        ("ratio 0.25", [(0.25, "ratio", 1.0)]),
    ],
)
def test_figures(spark, text, want):
    got = figures(spark.createDataFrame([(1, text)], "id int, t string"), "t", ["id"]).orderBy("ordinal").collect()
    assert [(r["value"], r["dimension"], r["multiplier"]) for r in got] == want


def test_figures_inherit_the_hint(spark):
    df = spark.createDataFrame([(1, "10"), (2, None)], "id int, t string")
    [r] = figures(df, "t", ["id"], unit_from_note(F.lit("in millions"))).collect()
    assert r["inherited"] and r["base_value"] == 1e7


def test_units_and_numerals(spark):
    notes = {"RMB'000": 1e3, "RMB million": 1e6, "单位：千元": 1e3, "单位：人民币百万元": 1e6, "none": None, None: None}
    for note, m in notes.items():
        r = spark.range(1).select(unit_from_note(F.lit(note).cast("string")).alias("u")).first()["u"]
        assert (r["multiplier"] if r else None) == m
    for numeral, value in {"一": 1, "十": 10, "二十三": 23, "一千二百三十四": 1234, "三万五千": 35000, "一亿": 10**8, "零": None, "abc": None}.items():
        assert spark.range(1).select(chinese_numeral(F.lit(numeral))).first()[0] == value
    assert spark.range(1).select(F.lit(None).cast(UNIT)).first()[0] is None


def fig(spark, rows):
    return spark.createDataFrame([(1, "unknown", float(v), str(v), i) for i, v in enumerate(rows)], "t int, dimension string, base_value double, raw string, ordinal int")


@pytest.mark.parametrize(("s", "t", "want", "near"), [([1, 2, 2], [2, 1, 2], (3, 0, 0), 0), ([12345], [12354], (0, 1, 1), 1), ([1], [], (0, 1, 0), 0), ([], [7], (0, 0, 1), 0), ([100, 200], [101, 900], (0, 2, 2), 1), ([5], [50], (0, 1, 1), 0)])
def test_number_diff(spark, s, t, want, near):
    m = numdiff.match_exact(fig(spark, s), fig(spark, t), ["t"]).cache()
    assert tuple(m.where(F.col("bucket") == b).count() for b in ("matched", "missing", "added")) == want
    got = numdiff.match_near(m, ["t"]).collect()
    assert len(got) >= near and (near or not got)


CELLS = "table_id int, row int, col int, text string, row_span int, col_span int"


def test_table_html_round_trip(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a<b", 2, 1), (1, 0, 1, "c&d", 1, 2), (1, 1, 1, "e", 1, 1), (1, 1, 2, "f\ng", 1, 1), (1, 2, 0, "x", 1, 1), (1, 2, 2, "1,200", 1, 1)], CELLS)
    assert [(r["row"], r["col"]) for r in tables.holes(cells).collect()] == [(2, 1)]
    full = cells.union(spark.createDataFrame([(1, 2, 1, "2", 1, 1)], CELLS))
    html = tables.to_html(full, tables.header_rows(full))
    again = html_tables.html_cells(html, "table_id", "rendered").select("table_id", "row", "col", "text", "row_span", "col_span")
    assert sorted(again.collect()) == sorted(full.collect())


def test_grid_from_noisy_boxes(spark):
    rows = [(1, 3 * r + c, f"{r},{c}", 100.0 * c + j, 30.0 * r - j, 100.0 * (c + 1) + j, 30.0 * (r + 1) - j) for r in range(4) for c in range(3) for j in [(r * 7 + c * 5) % 6 - 3.0] if (r, c) != (0, 1)]
    rows[0] = (1, 0, "0,0", 1.0, 2.0, 199.0, 31.0)
    got = tables.place_by_boxes(spark.createDataFrame(rows, "table_id int, ord int, text string, x0 double, y0 double, x1 double, y1 double"))
    for r in got.collect():
        assert f"{r['row']},{r['col']}" == r["text"] and (r["row_span"], r["col_span"]) == ((1, 2) if r["ord"] == 0 else (1, 1))
    twice = got.where("ord in (0, 2)").withColumn("row", F.lit(0)).withColumn("col", F.lit(0))
    assert tables.conflicts(twice).count() == 1


def test_sections_equal_a_stack(spark):
    import random

    rng, rows, want = random.Random(1), [], {}
    for doc in range(20):
        stack = []
        for pos in range(40):
            level = rng.choice([None, None, 1, 2, 3, 4, 5, 6])
            rows.append((doc, pos, level, f"t{pos}"))
            if level:
                stack = [s for s in stack if s[0] < level] + [(level, f"t{pos}")]
            want[doc, pos] = [t for _, t in stack]
    got = sections.section_paths(spark.createDataFrame(rows, "doc int, pos int, level int, title string"), ["doc"], "pos")
    assert {(r["doc"], r["pos"]): r["path"] for r in got.collect()} == want


def test_chunk_tail_joins_the_chunk_before(spark):
    rows = [(1, i, n) for i, n in enumerate([50, 60, 70, 5])] + [(2, 0, 500)]
    got = sections.pack_chunks(spark.createDataFrame(rows, "doc int, pos int, n int"), "doc", "pos", "n", 120, 10)
    assert sorted((r["doc"], r["pos"], r["chunk"]) for r in got.collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 0, 0)]


@pytest.mark.parametrize(("text", "level", "rule"), [("第三章 讨论", 1, "cn-chapter"), ("1.2.3 Results", 3, "numbered"), ("Appendix A", 2, "appendix"), ("OVERVIEW OF RESULTS", 2, "allcaps"), ("（一）收入", 3, "cn-paren"), ("An ordinary sentence that goes on.", None, None), ("", None, None)])
def test_headings(spark, text, level, rule):
    h = spark.range(1).select(sections.heading(F.lit(text)).alias("h")).first()["h"]
    assert (h["level"], h["rule"]) == (level, rule) if level else h is None


def test_terms(spark):
    events = spark.createDataFrame([(1, "EBITDA", "a", "seed", 1), (2, "ebitda", "b", "curated", 2), (3, "EBITDA", "b", "model", 5), (4, "x", "y", "seed", 1)], "seq int, source string, target string, authority string, frequency int")
    won, lost = glossary.merge(events)
    assert {(r["key"], r["target"], r["frequency"]) for r in won.collect()} == {("ebitda", "b", 7), ("x", "y", 1)}
    assert [(r["dropped"], r["reason"]) for r in lost.collect()] == [("a", "lower authority")]
    texts = spark.createDataFrame([(1, "净利润（Net profit）及 Gross margin（毛利率）"), (2, None)], "id int, t string")
    assert {(r["source"], r["target"]) for r in glossary.bilingual_pairs(texts, "id", "t").collect()} == {("Net profit", "净利润"), ("Gross margin", "毛利率")}
    keys = spark.createDataFrame([("net profit",), ("profit",)], "key string")
    assert {(r["key"], r["position"]) for r in glossary.hits(texts.withColumn("t", F.lit("The Net profit, net profits")), keys, "t").where("id = 1").collect()} == {("net profit", 2), ("profit", 3)}


def test_vector_search_checks_its_queries(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, e array<float>")
    q = v.select(F.col("id").alias("q"), F.col("e").alias("vector"))
    assert retrieval.vector_search(v, q, "id", "e", "q").where("q = 1 and id = 2").first()["score"] == 0
    with pytest.raises(ValueError, match="more than 1"):
        retrieval.vector_search(v, q, "id", "e", "q", max_queries=1)


@pytest.mark.parametrize(("features", "risk_", "band"), [({"number_drift": 0.4, "number_mismatch": 2, "unknown_terms": 3}, 1.0, "review"), ({"number_added": 1, "unknown_terms": 4}, 0.205, "watch"), ({"numeric_density": 0.1423, "unknown_terms": 1}, 0.0512, "auto"), ({"grid_hole": 1, "table_warning": 1, "unknown_terms": 1}, 0.1725, "auto"), ({}, 0.0, "auto")])
def test_risk_of_known_runs(spark, features, risk_, band):
    columns = [F.lit(float(features.get(n, 0))).alias(n) for n in risk.WEIGHTS]
    r = risk.score(spark.range(1).select(*columns), list(risk.WEIGHTS), financial=F.lit(band != "review")).first()
    assert abs(r["risk"] - risk_) < 0.0002 and r["band"] == band
    assert risk.score(spark.range(1), [], hard=F.lit(True)).first()["band"] == "blocked"


def test_review_keeps_and_reopens_decisions(spark):
    old = spark.createDataFrame([("a", "c1", 0.5, "t", "approved", ""), ("b", "c2", 0.5, "t", "approved", ""), ("g", "c3", 0.1, "t", "rejected", "")], "item_id string, chunk_id string, risk double, target_text string, status string, note string")
    new = spark.createDataFrame([("a", "c1", 0.5, "t"), ("b", "c2", 0.5, "t2"), ("n", "c4", 0.9, "t")], "item_id string, chunk_id string, risk double, target_text string")
    got = review.upsert(old, new)
    assert {r["item_id"]: (r["status"], r["note"]) for r in got.collect()} == {"a": ("approved", ""), "b": ("pending", "reopened on re-run: evidence changed (risk was 0.50, previously approved)"), "g": ("rejected", ""), "n": ("pending", "")}
    with pytest.raises(ValueError, match="zz"):
        review.decide(got, spark.createDataFrame([("zz", "approved")], "item_id string, status string"))
    done = review.decide(got, spark.createDataFrame([("n", "edited")], "item_id string, status string"))
    assert done.where("status = 'edited'").count() == 1
    assert review.sheet(done).count() == 4


def test_chunks_that_share_an_identifier(spark, tmp_path):
    """Identifiers hold 40 bits: orders 130586 and 8540885 share one."""
    named = spark.createDataFrame([("130586", "a"), ("8540885", "b")], "chunk_id string, target_text string").withColumn("item_id", review.item_id(F.col("chunk_id"))).withColumn("risk", F.lit(0.5))
    shared = named.first()["item_id"]
    assert named.where(F.col("item_id") == shared).count() == 2
    old = named.withColumn("status", F.when(F.col("chunk_id") == "130586", "approved").otherwise("pending")).withColumn("note", F.lit(""))
    q = review.upsert(old, named)
    assert {(r["chunk_id"], r["target_text"], r["status"]) for r in q.collect()} == {("130586", "a", "approved"), ("8540885", "b", "pending")} and q.count() == 2
    with pytest.raises(ValueError, match="name the chunk"):
        review.decide(q, q.limit(1).select("item_id", F.lit("edited").alias("status")))
    done = review.decide(q, q.where("chunk_id = '8540885'").select("item_id", "chunk_id", F.lit("edited").alias("status")))
    assert {(r["chunk_id"], r["status"]) for r in done.collect()} == {("130586", "approved"), ("8540885", "edited")} and done.count() == 2
    review.write_bundle(done, f"{tmp_path}/b")
    assert spark.read.text(f"{tmp_path}/b/review.csv").count() == 3 and review.full_sheet(done).count() == 3
    assert layout.read_queue(spark, f"{tmp_path}/b/review.jsonl").count() == 2


def test_sheet_has_every_item(spark):
    rows = [(f"rv-{i * 7919 % 2500:04d}", None if i == 5 else (i % 3) / 2, "pending") for i in range(2500)]
    got = review.sheet(spark.createDataFrame(rows, "item_id string, risk double, status string")).orderBy("n").collect()
    order = sorted(rows, key=lambda r: (9 if r[1] is None else -r[1], r[0]))
    assert [r["n"] for r in got] == list(range(1, 2501)) and [r["line"].split()[1] for r in got] == [r[0] for r in order]


def test_faults_are_exactly_as_many_and_are_found(spark):
    df = spark.createDataFrame([(i, f"value {i + 1}") for i in range(30)], "k int, t string")
    for n in (0, 1, 5):
        got = translate.corrupt(df, "k", "t", n)
        assert got.where("t <> target_text").count() == n


def test_replies_and_mock(spark):
    replies = ['```json\n{"a": 1,}\n```', "no", 'so {x} {"a": 2} end', None]
    got = html_tables.parse_replies(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string"), "r", "a int").orderBy("i").collect()
    assert [r["parsed"]["a"] if r["parsed"] else None for r in got] == [1, None, 2, None]
    out = sections.map_batches(spark.createDataFrame([("net profit",), ("x",)], "prompt string"), translate.mock_model({"profit": "P", "net profit": "NP"}), "prompt string, reply string")
    assert {r["reply"] for r in out.collect()} == {"NP", "[tr] x"}


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.normalize_whitespace(F.lit(" a \r\n\n\n\n b　c "), True)) == "a\n\nb c"
    assert one(tx.slugify(F.lit("--"))) == "unnamed" and one(tx.truncate(F.lit("abcdef"), 5)) == "ab..."
    assert one(tx.tokenize(F.lit("Net 12.5 利润率"))) == ["net", "12.5", "利", "润", "率", "利润", "润率"]
    for t, want in {"-": True, "1,234": True, "(5.0)": True, "12%": True, "abc": False, "": False, "$ 5": False, "1,234 %": True, "12,34": True, "2023-12": True}.items():
        assert one(tx.looks_numeric(F.lit(t))) == want


def test_readers(spark, tmp_path):
    import json

    cell = [{"text": "a", "bbox": [0, 0, 10, 5]}, {"text": "b", "bbox": [10, 0, 20, 5]}]
    (tmp_path / "d.json").write_text(json.dumps({"pages": [{"page": 1, "regions": [{"type": "table", "units": "RMB'000", "cells": cell}, {"label": "text", "content": "hello"}]}]}))
    regions = layout.read_layouts(spark, str(tmp_path / "d.json"))
    assert [(r["label"], r["text"], r["units_note"]) for r in regions.orderBy("pos").collect()] == [("table", None, "RMB'000"), ("text", "hello", None)]
    assert tables.place_by_boxes(layout.region_cells(regions)).count() == 2
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    (tmp_path / "p.png").write_bytes(png)
    assert layout.read_images(spark, str(tmp_path / "*.png")).select("width", "height").first() == (640, 480)
    (tmp_path / "q.jsonl").write_text('{"item_id":"a","seq":1,"status":"pending"}\n{"item_id":"a","seq":2,"status":"approved"}\n')
    assert [r["status"] for r in layout.read_queue(spark, str(tmp_path / "q.jsonl")).collect()] == ["approved"]


def test_image_sizes_of_all_forms(spark, tmp_path):
    frame = b"\xff\xc2\x00\x0b\x08" + (33).to_bytes(2, "big") + (55).to_bytes(2, "big") + b"\x01\x01\x11\x00"
    riff = lambda form, rest: b"RIFF\0\0\0\0WEBP" + form + b"\0\0\0\0" + rest
    files = {
        "a.jpg": b"\xff\xd8\xff\xe0\x00\x06\xff\xc0ab\xff" + frame,
        "b.jpg": b"\xff\xd8\xff\xda\x00\x02" + bytes(20),
        "c.webp": riff(b"VP8X", bytes(4) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")),
        "d.webp": riff(b"VP8L", b"\x2f" + ((3 << 28) | 99 | (199 << 14)).to_bytes(4, "little")),
        "e.webp": riff(b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + (0x4000 | 320).to_bytes(2, "little") + (240).to_bytes(2, "little")),
        "f.gif": b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little"),
        "g.bin": b"\xff",
        "h.bin": b"",  # no row
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = layout.read_images(spark, str(tmp_path)).select(F.regexp_extract("path", "[^/]*$", 0), "width", "height").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {"a.jpg": (55, 33), "b.jpg": (None, None), "c.webp": (640, 480), "d.webp": (100, 200), "e.webp": (320, 240), "f.gif": (7, 9), "g.bin": (None, None)}


def test_chart_points(spark, tmp_path):
    import json

    series = [{"name": "Revenue", "points": {"2022": 1.5, "2023": "n/a"}}, {"label": "Cost", "value": 3}]
    (tmp_path / "c.json").write_text(json.dumps({"pages": [{"page": 2, "regions": [{"label": "chart", "chart": {"chart_type": "bar", "series": series}}, {"label": "text"}]}]}))
    got = layout.chart_points(layout.read_layouts(spark, str(tmp_path))).collect()
    assert {(r["page_index"], r["series"], r["category"], r["value"]) for r in got} == {(2, "Revenue", "2022", 1.5), (2, "Cost", None, 3.0)}


def test_term_candidates_and_small_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    text = F.lit("EBITDA and IFRS of the Deferred Tax Asset; EBITDA again, Deferred Tax Asset")
    assert one(glossary.candidates(text, ("IFRS",))) == ["EBITDA", "Deferred Tax Asset"]
    assert one(glossary.candidates(F.lit(None).cast("string"))) == []
    pairs = F.array(F.struct(F.lit("a").alias("source"), F.lit("b").alias("target")))
    assert one(glossary.prompt_block(pairs)).endswith("\n- a => b") and one(glossary.prompt_block(F.slice(pairs, 1, 0))) == ""
    for v, want in {1234567.0: "1,234,567", 1234.5: "1,234.5", -0.25: "-0.25", 100.0: "100", 0.12345: "0.1235"}.items():
        assert one(tx.format_number(F.lit(v))) == want
    assert one(tx.format_number(F.lit(None).cast("double"))) == "-"
    assert one(tx.unescape_html(F.lit("a &amp; &eacute;&#x27;"))) == "a & é'" and one(tx.unescape_html(F.lit(None).cast("string"))) is None
    assert one(tx.display_width(F.lit("ab利Ａ"))) == 5 and one(tx.display_width(F.lit(None).cast("string"))) == 0


def test_sides_meet_where_they_lie(spark):
    """Sides that are dealt out by table already are compared without another exchange, with the rows of a full outer join."""
    rows = [(1, 0, "a"), (1, 0, "b"), (1, 1, None), (None, 0, "n"), (2, 0, "x")]
    s = spark.createDataFrame(rows, "t int, r int, a string")
    t = spark.createDataFrame([(1, 0, "c"), (1, 0, "d"), (None, 0, "m"), (3, 0, "y"), (1, 1, None)], "t int, r int, b string")
    got = numdiff.outer(s, t, ["t", "r"]).select("t", "r", "__s.a", "__t.b")
    want = s.join(t, ["t", "r"], "full_outer")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    slots = spark.range(40).selectExpr("id div 8 as table_id", "cast(id % 8 as int) as row", "0 as col", "cast(id as string) as text").repartition(4, "table_id")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert plan(numdiff.check_tables(slots, slots)) == 2  # those of the sides themselves


def test_equal_slots_need_no_pairing(spark):
    """Slots of equal texts, repeated and without figures too, give what comparing their figures gives."""
    cell = "table_id int, row int, col int, text string"
    s = spark.createDataFrame([(1, 0, 0, "7 and 7 and 8"), (1, 0, 1, None), (1, 1, 0, "12.50"), (1, 1, 1, "a"), (1, 2, 0, "5"), (1, 2, 0, "6")], cell)
    t = spark.createDataFrame([(1, 0, 0, "7 and 7 and 8"), (1, 0, 1, None), (1, 1, 0, "12.60"), (1, 1, 1, "a 3"), (1, 2, 0, "5"), (1, 3, 0, "9")], cell)
    shape = spark.createDataFrame([(1, 4, 2, "")], "table_id int, n_rows int, n_cols int, units_note string")
    got = numdiff.report(numdiff.check_table_pairs(s, t, shape, shape), ["table_id"], shape).first()
    assert (got["matched"], got["mismatched"], got["missing"], got["added"], got["structural"]) == (4, 2, 0, 1, 1)


ODD_TEXTS = ["12.50", "1,234", "(1,234.5)", "-7", "5)", "7\n", "1,2345", "'000", "5 '000", "'\n12", "a", "", None, "１２", "十二万元", "3万", "5 of 7", "1.2.3", " 8 ", "(5", "二", ".5", "+4%"]


def test_raw_figures_are_those_of_figures(spark):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id int, text string")
    rows = {}
    for r in figures(df, "text", ["id"]).orderBy("id", "ordinal").collect():
        rows.setdefault(r["id"], []).append(r["raw"])
    got = df.select("id", raw_figures(F.coalesce("text", F.lit(""))).alias("raws")).collect()
    assert {r["id"]: r["raws"] for r in got if r["raws"]} == rows


def test_a_pair_of_figures_needs_no_python(spark):
    """One figure a side gives what pair_figures gives."""
    some = [None, *[{"ordinal": 0, "raw": d, "dimension": n, "base_value": v, "digits": d} for n in ("money", "count", "unknown") for v, d in ((0.0, "0"), (100.0, "100"), (101.0, "101"), (900.0, "900"), (999.0, "999"), (20.0, ""), (1234.0, "1234"), (5678.0, "5678"))]]
    kind = "struct<ordinal: int, raw: string, dimension: string, base_value: double, digits: string>"
    df = spark.createDataFrame([(s, t) for s in some for t in some], f"s {kind}, t {kind}")
    for r in df.withColumn("f", numdiff.pair_of_figures(F.col("s"), F.col("t"))).collect():
        side = lambda c: [r[c].asDict()] if r[c] else []  # noqa: B023, E731
        assert [f.asDict() for f in r["f"] or []] == numdiff.pair_figures(side("s"), side("t")), r


def test_rows_meet_whole(spark):
    """Tables by rows give the findings of their cells: rows of one side, unlike lengths, repeated rows, keys with null, notes, several shapes of a table."""
    row = "table_id int, row int, texts array<string>"
    odd = lambda i: [(1, n, ODD_TEXTS[n + i : n + i + 4]) for n in range(18)]
    s = spark.createDataFrame([*odd(0), (2, 1, ["5", "6 and 7", None]), (2, 1, ["5", "8"]), (2, 2, []), (2, 3, None), (2, None, ["4"]), (3, 0, ["100", "7%"]), (4, 0, ["1"]), (5, 0, ["9", "12.50"]), (None, 0, ["1"])], row)
    t = spark.createDataFrame([*odd(0)[:6], *odd(1)[6:], (2, 1, ["5", "6 and 9"]), (2, 2, ["3"]), (2, 3, ["4", "5"]), (2, None, ["4"]), (3, 0, ["100", "7%"]), (3, 1, ["2"]), (5, 0, ["9", "12.60", "x"]), (None, 0, ["1"])], row)
    shape = "table_id int, n_rows int, n_cols int, units_note string"
    left = spark.createDataFrame([(1, 18, 4, None), (2, 4, 3, ""), (3, 1, 2, "RMB'000"), (5, 1, 2, ""), (5, 2, 2, "RMB'000")], shape)
    right = spark.createDataFrame([(1, 18, 4, ""), (2, 4, 3, ""), (3, 2, 2, "million"), (5, 1, 2, "")], shape)
    cells = lambda df: df.select("table_id", "row", F.posexplode("texts").alias("col", "text"))
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(numdiff.check_table_pairs(cells(s), cells(t), left, right))
    assert len(want) > 80 and rows(numdiff.check_row_pairs(s, t, left, right)) == want
    assert rows(numdiff.check_row_pairs(s, t, left, right, keep=writer(spark))) == want


def test_table_pairs_meet_once(spark, sf):
    """Both sides are written where they have met; what reads them sorts and numbers no line again."""
    plan = catalogue.q_table_pairs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "lineitem" in plan  # the tables' keys


def test_slots_are_read_once(spark):
    """Renderings of a table with holes, a span and a slot claimed twice; texts are bound once, not looked up in a map for each slot."""
    cell = "table_id int, row int, col int, row_span int, col_span int, text string, ord int"
    c = spark.createDataFrame([(1, 0, 0, 1, 2, "a", 1), (1, 0, 1, 1, 1, "lost", 2), (1, 2, 1, 1, 1, "b|<", 3), (1, 2, 1, 1, 1, "later", 4)], cell)
    assert tables.to_tsv(c).first()["rendered"] == "a\ta\n\t\n\tb|<"
    assert tables.to_markdown(c).first()["rendered"] == "| a | a |\n| --- | --- |\n|  |  |\n|  | b\\|< |"
    assert "map" not in dict(tables.slots(c).dtypes)["texts"]
    html = tables.to_html(c.where("ord in (1, 3)"), spark.createDataFrame([(1, 1)], "table_id int, n_header int")).first()["rendered"]
    gap = '<td data-empty="1"></td>'
    assert html == f'<table><thead><tr><th colspan="2">a</th></tr></thead><tbody><tr>{gap}{gap}</tr><tr>{gap}<td>b|&lt;</td></tr></tbody></table>'
    assert tables.preview(c.where("ord in (1, 3)")).first()["rendered"] == "a |\n  |\n  | b|<"


def test_a_small_dictionary_is_broadcast(spark):
    """The pieces of the texts are not shuffled where the terms are few."""
    texts = spark.createDataFrame([(1, "of a gross margin here")], "k int, text string")
    names = spark.createDataFrame([("gross margin", "x")], "source string, target string")
    found = glossary.term_rows(texts, ["k"], "text", names)
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin [piece") > 0 and found.count() == 1


def test_missing_terms_are_those_of_a_pair(spark):
    """Pairs of one key, and of none, are judged one by one; where names have few lengths, no text is joined with what it has met."""
    pairs = spark.createDataFrame([(1, "net PROFIT \U0001f600rose", "up"), (1, "a cost", "the cost"), (1, None, None), (None, "net profit", "net profit, a Cost")], "k int, s string, t string")
    names = spark.createDataFrame([("profit", "profit"), ("\U0001f600rose", "up"), ("a cost", "a cost"), ("net", "net")], "source string, target string")
    for terms in (names, names.union(spark.createDataFrame([("x" * n, "x" * n) for n in range(1, 40)], names.schema))):
        for context in (False, True):
            found = glossary.missing_terms(pairs, ["k"], "s", "t", terms, context=context)
            assert sorted((r["k"], r["source"]) for r in found.collect()) == [(1, "a cost"), (1, "net"), (1, "profit")]
    assert {r["context"] for r in glossary.missing_terms(pairs, ["k"], "s", "t", names).where("source = 'net'").collect()} == {"net PROFIT \U0001f600rose"}
    assert "Join [__text" not in glossary.term_rows(pairs, ["k"], "s", names)._jdf.queryExecution().executedPlan().toString()
