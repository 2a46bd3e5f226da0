"""From regions to review: tables, chunks, terms, translation, risk, queue and reports."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerlens import cli
from ledgerlens.functions.figures import figures, fingerprint, is_numeric_cell
from ledgerlens.functions.units import unit_from_note
from ledgerlens.operators import agents, chunks, documents, glossary, models, numdiff, perception, report, review, risk, tables
from ledgerlens.sources import documents as sources
from ledgerlens.sources import html_tables, layout

cloudpickle.register_pickle_by_value(sys.modules[__name__])
BOX = "table_id string, ord int, text string, x0 double, y0 double, x1 double, y1 double"
TERMS = "source string, target string, aliases array<string>"


@pytest.fixture(scope="module")
def parsed(spark):
    p = sources.parse(sources.demo_regions(spark))
    return {k: v.cache() for k, v in p.items()}


@pytest.fixture(scope="module")
def outcome(spark, parsed):
    terms = spark.createDataFrame([("Revenue", "营业收入", []), ("Gross profit", "毛利", [])], TERMS)
    model = models.MockModel({"Revenue": "营业收入", "rose by": "增长", "Statement": "报表", "Item": "项目", "Cost of sales": "销售成本", "Gross profit": "毛利", "Financial Summary": "财务摘要"})
    return report.run(parsed, model, terms) | {"cells": parsed["cells"], "tables": parsed["tables"]}


def test_chinese_figures(spark):
    d = spark.createDataFrame([(1, "收入一千二百万元，增长百分之12.4，共三万股；一、二；1.234 百万元；百分之五")], "id int, t string")
    got = [(r["raw"], r["dimension"], r["base_value"]) for r in figures(d, "t", ["id"]).collect()]
    assert got == [("一千二百万", "money", 1.2e7), ("12.4", "ratio", pytest.approx(0.124)), ("三万", "count", 3e4), ("1.234", "money", pytest.approx(1.234e6))]


@pytest.mark.parametrize(("note", "multiplier"), [("RMB'000", 1e3), ("for 2000, RMB million", 1e6), ("单位：人民币千元", 1e3), ("in thousands", 1e3), ("", None), ("plain words", None)])
def test_notes(spark, note, multiplier):
    got = spark.range(1).select(unit_from_note(F.lit(note)).alias("u")).first()["u"]
    assert (got and got["multiplier"]) == multiplier


def test_numeric_cells_and_fingerprints(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["1,234", "(5)", "12.5%", "FY 2023", "Revenue 2023", "", "—", "3 million"])], "id int, t string")
    got = [r["n"] for r in d.select("id", is_numeric_cell(F.col("t")).alias("n")).orderBy("id").collect()]
    assert got == [True, True, True, True, False, False, False, False]
    d = spark.createDataFrame([(1, "5 and 7%"), (2, "7% and 5"), (3, "5 and 7")], "id int, t string")
    f = {r["id"]: r["fingerprint"] for r in fingerprint(d, "t", ["id"]).collect()}
    assert f[1] == f[2] != f[3]


@pytest.mark.parametrize(
    ("s", "t", "note", "want"),
    [
        ("revenue 1,234,567", "revenue 1,934,567", "", (0, 1, 0, 0, 0)),
        ("5 million", "5,000 thousand", "", (1, 0, 0, 0, 0)),
        ("5 of 7", "7", "", (1, 0, 1, 0, 0)),
        ("5", "5 6", "", (1, 0, 0, 1, 0)),
        ("100", "100", "RMB'000", (1, 0, 0, 0, 1)),
        ("100", "100 千元", "RMB'000", (1, 0, 0, 0, 0)),
        ("12.5%", "12.5", "", (0, 1, 0, 0, 0)),
        ("USD 9", "9", "", (1, 0, 0, 0, 0)),
        ("", "", "", (0, 0, 0, 0, 0)),
        ("1000000", "1010000", "", (0, 1, 0, 0, 0)),
        ("1234", "5678", "", (0, 0, 1, 1, 0)),
    ],
)
def test_text_check(spark, s, t, note, want):
    pairs = spark.createDataFrame([(1, s, t, note)], "id int, s string, t string, n string")
    r = numdiff.report(numdiff.check_texts(pairs, ["id"], "s", "t", "n"), ["id"], pairs).first()
    assert (r["matched"], r["mismatched"], r["missing"], r["added"], r["structural"]) == want
    assert r["ok"] == (want[1] + want[2] + want[4] == 0) and 0 <= r["drift"] <= 1


def test_table_check(spark):
    cells = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, "1,234"), ("a", 1, 0, "y"), ("a", 1, 1, "99")], "table_id string, row int, col int, text string")
    target = spark.createDataFrame([("a", 0, 0, "z"), ("a", 0, 1, "1,284"), ("a", 2, 0, "y")], "table_id string, row int, col int, text string")
    shapes = lambda r, n: spark.createDataFrame([("a", r, 2, n)], "table_id string, n_rows int, n_cols int, units_note string")
    got = {(r["row"], r["col"], r["kind"], r["reason"]) for r in numdiff.check_table_pairs(cells, target, shapes(2, "RMB'000"), shapes(3, "")).collect()}
    assert (0, 1, "mismatched", "digit slip (edit distance 1)") in got
    assert (1, 1, "structural", "cell exists in the source but not the target") in got and (2, 0, "structural", "cell exists in the target but not the source") in got
    assert (None, None, "structural", "shape changed 2x2 -> 3x2") in got and (None, None, "structural", "table unit note dropped in the target: RMB'000") in got
    assert len(got) == 6


def test_tables_from_boxes_hints_and_neither(spark):
    raw = spark.createDataFrame([("t", 0, "Head", 0.0, 0.0, 240.0, 40.0), ("t", 1, "a", 0.0, 40.0, 120.0, 80.0), ("t", 2, "1", 121.0, 41.0, 240.0, 80.0), ("t", 3, "frag", 0.0, 1.0, 120.0, 39.0), ("t", 4, "b", 0.0, 80.0, 120.0, 120.0)], BOX)
    built, cells, conflicts = tables.build_tables(raw)
    t = built.first()
    assert (t["n_rows"], t["n_cols"], t["n_conflicts"]) == (3, 2, 1) and "1 uncovered slot" in t["warnings"][0]
    assert conflicts.first().asDict() == {"table_id": "t", "row": 0, "col": 0, "kept": "Head", "dropped": "frag", "reason": "duplicate_fragment"}
    assert {(c["text"], c["row"], c["col"], c["row_span"], c["col_span"], c["is_header"]) for c in cells.collect()} == {("Head", 0, 0, 1, 2, True), ("a", 1, 0, 1, 1, False), ("1", 1, 1, 1, 1, False), ("b", 2, 0, 1, 1, False)}
    hinted = spark.createDataFrame([("h", 0, "x", 0, 0, 1, 2), ("h", 1, "dup", 0, 1, 1, 1), ("h", 2, "2023", 1, 0, 1, 1)], "table_id string, ord int, text string, row int, col int, row_span int, col_span int")
    built, cells, conflicts = tables.build_tables(hinted)
    assert conflicts.first()["reason"] == "duplicate_origin" and cells.count() == 2 and built.first()["n_cols"] == 2
    built, cells, _ = tables.build_tables(spark.createDataFrame([("n", 0, "p"), ("n", 1, "q")], "table_id string, ord int, text string"))
    assert (built.first()["n_rows"], built.first()["n_cols"]) == (2, 1) and "degraded" in built.first()["warnings"][0]


def test_notes_of_tables(spark):
    raw = spark.createDataFrame([("t", 0, "单位：人民币千元", 0, 0), ("t", 1, "5", 1, 0), ("u", 0, "x", 0, 0), ("v", 0, "a (in millions)", 0, 0)], "table_id string, ord int, text string, row int, col int")
    given = spark.createDataFrame([("u", "HK$'000 of it", None), ("t", None, None), ("v", "", "given")], "table_id string, caption string, units_note string")
    got = {r["table_id"]: r["units_note"] for r in tables.build_tables(raw, given)[0].collect()}
    assert got == {"t": "单位:人民币千元", "u": "HK$'000", "v": "given"}


def test_renderings_with_holes(spark):
    cells = spark.createDataFrame([("t", 0, 0, 1, 3, "H|1"), ("t", 1, 0, 1, 1, "d"), ("t", 1, 2, 1, 1, "f"), ("t", 2, 0, 1, 1, "")], "table_id string, row int, col int, row_span int, col_span int, text string")
    assert tables.to_tsv(cells).first()["rendered"] == "H|1\tH|1\tH|1\nd\t\tf\n\t\t"
    notes = spark.createDataFrame([("t", "RMB'000")], "table_id string, units_note string")
    assert tables.to_markdown(cells, notes=notes).first()["rendered"] == "*RMB'000*\n\n| H\\|1 | H\\|1 | H\\|1 |\n| --- | --- | --- |\n| d |  | f |\n|  |  |  |"
    heads = tables.header_rows(cells)
    html = tables.to_html(cells, heads, data=True, captions=spark.createDataFrame([("t", "Cap & x")], "table_id string, caption string"))
    text = html.first()["rendered"]
    assert "<caption>Cap &amp; x</caption>" in text and text.count('data-empty="1"') == 3
    back = html_tables.html_cells(html, "table_id", "rendered").select("row", "col", "row_span", "col_span", "text")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.select("row", "col", "row_span", "col_span", "text").collect()))
    assert html_tables.html_captions(html, "table_id", "rendered").first()["caption"] == "Cap & x"
    assert {(r["row"], r["field"], r["text"]) for r in tables.to_records(cells, heads).collect()} == {(1, "H|1", "d"), (1, "H|1", "f")}
    assert tables.preview(cells, rows=2).first()["rendered"] == "H|1 |  |\nd   |  | f\n... 1 more row(s)"


def test_header_flags_and_problems(spark):
    kinds = "table_id string, row int, col int, row_span int, col_span int, text string, is_header boolean"
    cells = spark.createDataFrame([("t", 0, 0, 1, 1, "2023", True), ("t", 1, 0, 1, 1, "x", False), ("t", 1, 0, 1, 2, "y", False), ("t", 0, -1, 1, 1, "lost", False), ("t", 0, 1, 0, 1, "thin", False)], kinds)
    assert tables.header_rows(cells.where("row = 0 and col = 0 or row = 1")).first()["n_header"] == 1
    shape = spark.createDataFrame([("t", 2, 1), ("none", 0, 0)], "table_id string, n_rows int, n_cols int")
    got = {r["problem"] for r in tables.problems(shape, cells).collect()}
    assert "degenerate table shape 0x0" in got and "cell lost has no place" in got and "cell at 0,1 has a span that is not positive" in got and "cell at 1,0 span 1x2 overflows 2x1" in got
    assert any(p.startswith("duplicate origin at 1,0") for p in got)


@pytest.mark.parametrize(("label", "want"), [("table", "table"), ("Table_Body", "table"), ("my figure 3", "chart"), ("图片", "image"), (None, "text"), ("??", "text"), ("page title", "text")])
def test_kinds(spark, label, want):
    assert spark.range(1).select(documents.kind_of(F.lit(label).cast("string")).alias("k")).first()["k"] == want


def test_boxes(spark):
    forms = ['[1,2,3,4]', '{"x0":1,"y0":2,"x1":3,"y1":4}', '{"left":1,"top":2,"right":3,"bottom":4}', '{"x":1,"y":2,"w":2,"h":2}', '{"bbox":[1,2,3,4]}', '{"bbox_2d":[1,2,3,4]}', '{"bbox":{"x":1,"y":2,"width":2,"height":2}}', '[1,2]', 'no']
    got = [r["b"] for r in spark.createDataFrame([(f,) for f in forms], "f string").select(documents.box_of(F.col("f")).alias("b")).collect()]
    assert [b and tuple(b) for b in got] == [(1, 2, 3, 4)] * 7 + [None] * 2
    a, b = (F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)]) for box in ((0, 0, 4, 4), (2, 2, 6, 6)))
    r = spark.range(1).select(documents.box_meet(a, b).alias("m"), documents.box_iou(a, b).alias("i"), documents.box_contains(a, b).alias("c"), documents.box_contains(a, b, 2.0).alias("t"), documents.box_union(a, b).alias("u")).first()
    assert (r["m"], r["i"], r["c"], r["t"], tuple(r["u"])) == (4.0, 4 / 28, False, True, (0, 0, 6, 6))


def test_blocks_of_regions(spark, parsed):
    got = parsed["blocks"].orderBy("pos").collect()
    assert [b["kind"] for b in got] == ["text", "text", "table", "chart"] and got[2]["rendered"].startswith("[TABLE] Statement\nRMB'000\n| RMB'000 |")
    s = documents.document_stats(parsed["blocks"], parsed["cells"], parsed["tables"]).first()
    assert (s["tables"], s["charts"], s["cells"], s["merged_cells"], s["holes"], s["unit_notes"], s["charts_unresolved"]) == (1, 1, 13, 1, 0, ["RMB'000"], 0)
    assert documents.parse_stats(sources.demo_regions(spark)).first()["raw_cells"] == 13
    md = documents.document_markdown(parsed["blocks"]).first()["markdown"]
    assert md.startswith("<!-- page 1 -->\n\nFinancial Summary") and "[CHART] Revenue and profit" in md
    points = layout.chart_points(sources.demo_regions(spark)).withColumn("ord", F.monotonically_increasing_id())
    told = documents.chart_narrative(parsed["blocks"].withColumn("pos", F.col("pos")), points).first()["narrative"]
    assert "| 2023 | 1,234.567 | - |" in told and told.startswith("**Revenue and profit**")
    empty = parsed["blocks"].withColumn("chart", F.lit(None).cast(layout.CHART))
    assert "could not be extracted" in documents.chart_narrative(empty, points.where("false")).first()["narrative"]


def test_noise_and_replay(spark):
    regions = sources.demo_regions(spark)
    noisy = documents.perturb(regions, jitter=2.5)
    assert documents.layout_tables(noisy)[0].first()["n_rows"] == 5
    fewer = documents.perturb(regions, drop_cells=0.5).where("label = 'table'").select(F.size("cells")).first()[0]
    assert 1 < fewer < 13 and fewer == documents.perturb(regions, drop_cells=0.5).where("label = 'table'").select(F.size("cells")).first()[0]
    pages = spark.createDataFrame([("demo", 0, None, "text layer")], "doc_id string, page_index int, image binary, text_layer string")
    assert perception.analyze(pages, "replay", recording=regions).count() == 4  # by place
    with pytest.raises(ValueError, match="unknown analyzer"):
        perception.analyze(pages, "nothing")


class Seer:
    def __init__(self, replies):
        self.replies = replies

    def complete(self, system, user, image=None):
        for key, reply in self.replies.items():
            if key in user:
                if reply is None:
                    raise models.ModelError("down")
                return reply
        return "no json"


def test_vision_degrades_and_remembers(spark):
    reply = json.dumps({"regions": [{"label": "text", "bbox": [0, 0, 1, 1], "text": "seen"}, {"label": "text", "text": "no box"}]})
    pages = spark.createDataFrame([("d", 1, bytearray(b"x"), "first page"), ("d", 2, bytearray(b"x"), "second page"), ("d", 3, None, "third")], "doc_id string, page_index int, image binary, text_layer string")
    got = {(r["page_index"], r["text"], r["analyzer"]) for r in perception.analyze(pages, "vlm", model=Seer({"first page": "```json\n" + reply + "\n```", "second page": None})).collect()}
    assert got == {(1, "seen", "vlm"), (2, "second page", "degraded"), (3, "third", "degraded")}
    assert "PREVIOUS PAGES" in perception.page_prompt("page 1", "t") and len(perception.page_prompt("x" * 5000, "y" * 9000)) < 4500
    charts = sources.demo_regions(spark).where("label = 'chart'").withColumn("chart", F.lit(None).cast(layout.CHART))
    read = perception.read_charts(charts, pages.withColumn("doc_id", F.lit("demo")), Seer({"Caption": '{"chart_type": "bar", "series": [{"name": "a", "points": {"x": 1}}], "confidence": 0.2}'})).first()
    assert read["chart"]["series"][0]["name"] == "a" and read["chart_warning"] == "low confidence 0.20"
    items = spark.createDataFrame([("d", 1, 0, "table", "[0,0,9,9]", [], "<table><tr><td>a</td><td>1</td></tr></table>"), ("d", 1, 1, "text", '{"x":0,"y":9,"w":5,"h":5}', ["p", " ", "q"], None)], "doc_id string, page_index int, pos int, label string, box string, lines array<string>, html string")
    ocr = {r["pos"]: r for r in perception.analyze(pages, "paddle", items=items).collect()}
    assert len(ocr[0]["cells"]) == 2 and ocr[1]["text"] == "p\nq" and ocr[1]["bbox"] == [0, 9, 5, 14]
    assert perception.page_digests(sources.demo_regions(spark)).first()["digest"] == ""


def test_structured_documents_round_trip(spark, parsed, tmp_path):
    sources.write_documents(sources.to_documents(parsed["blocks"], parsed["tables"], parsed["cells"], parsed["conflicts"]), f"{tmp_path}/d")
    blocks, built, cells, conflicts = sources.document_parts(sources.read_document_lines(spark, f"{tmp_path}/d"))
    names = ["pos", "kind", "text", "caption"]
    assert sorted(map(tuple, blocks.select(names).collect())) == sorted(map(tuple, parsed["blocks"].select(names).collect()))
    cell = ["row", "col", "row_span", "col_span", "text", "is_header"]
    assert sorted(map(tuple, cells.select(cell).collect())) == sorted(map(tuple, parsed["cells"].select(cell).collect()))
    assert built.first()["units_note"] == "RMB'000" and conflicts.count() == 0
    one = spark.read.text(f"{tmp_path}/d").first()[0]
    (tmp_path / "one.json").write_text(one, encoding="utf-8")
    assert sources.looks_structured(spark, f"{tmp_path}/one.json") and sources.read_any(spark, f"{tmp_path}/one.json")["blocks"].count() == 4
    sources.record(sources.demo_regions(spark), f"{tmp_path}/r")
    again = layout.read_layouts(spark, f"{tmp_path}/r/*/*.txt")
    assert again.count() == 4 and documents.layout_tables(again)[1].count() == 13
    with pytest.raises(FileNotFoundError):
        sources.read_any(spark, f"{tmp_path}/absent.json")
    with pytest.raises(ValueError, match="no reader"):
        sources.load_pages(spark, f"{tmp_path}/x.docx")


def test_pages_settings_and_sandbox(spark, tmp_path, monkeypatch):
    folder = tmp_path / "scan"
    folder.mkdir()
    for i in range(3):
        (folder / f"p{i}.gif").write_bytes(b"GIF89a" + (10 + i).to_bytes(2, "little") + (20).to_bytes(2, "little"))
    pages = sources.load_pages(spark, str(folder), first_page=1, max_pages=1).collect()
    assert [(p["page_index"], p["width"], p["mime"], p["doc_id"]) for p in pages] == [(1, 11, "image/gif", "scan")]
    s = sources.page_stats(sources.load_pages(spark, str(folder))).first()
    assert (s["pages"], s["with_image"], s["with_text_layer"]) == (3, 3, 0)
    assert [r["batch"] for r in sources.page_batches(sources.load_pages(spark, str(folder)), 2).orderBy("page_index").collect()] == [0, 0, 1]
    (tmp_path / ".env").write_text("# c\nLL_A=1\nexport LL_B='two'\nLL_C=3\n")
    monkeypatch.setenv("LL_C", "kept")
    monkeypatch.delenv("LL_A", raising=False)
    monkeypatch.delenv("LL_B", raising=False)
    assert sources.settings(tmp_path / ".env") == {"LL_A": "1", "LL_B": "two"}
    assert sources.inside(folder, "p0.gif").name == "p0.gif"
    with pytest.raises(ValueError, match="no such fixture"):
        sources.inside(folder, "../.env")


def test_chunk_plan():
    b = lambda span, tokens, table=False, level=None: {"span": span, "tokens": tokens, "table": table, "level": level}
    plan = lambda *blocks: chunks.plan(list(blocks), 100, 10, 2, 0.5)
    assert plan(b(0, 60), b(0, 60), b(1, 5)) == [(0, 0), (0, 1), (1, 0)]
    assert plan(b(0, 10), b(0, 60, True), b(0, 10)) == [(0, 0), (0, 1), (0, 1)]
    assert plan(b(0, 300, True), b(0, 10), b(0, 200, True)) == [(0, 0), (0, 1), (0, 2)]
    assert plan(b(0, 10, level=1), b(0, 85), b(0, 1)) == [(0, 0), (0, 1), (0, 1)]
    assert plan(b(0, 10), b(0, 10, level=2), b(0, 10)) == [(0, 0), (0, 1), (0, 1)]


def test_chunks(spark, outcome):
    c = outcome["chunks"].first()
    assert c["chunk_id"].startswith("c000-00-financial-summary") and c["is_financial"] and c["n_tables"] == 1 and c["table_positions"] == [2]
    assert [t["source"] for t in c["terms"]] == ["Gross profit", "Revenue"]
    s = chunks.stats(outcome["chunks"]).first()
    assert s["chunks"] == 1 and s["with_tables"] == 1
    blocks = spark.createDataFrame([("d", i, i, "text", t, 0.0, lv, t, None) for i, (t, lv) in enumerate([("Intro words", None), ("Part one", 1), ("a " * 40, None), ("Sub", 2), ("b " * 400, None), ("tail", None)])], "doc_id string, pos int, page_index int, kind string, text string, font_size double, heading_level int, rendered string, table_id string")
    sectioned = chunks.in_sections(blocks)
    made, placed = chunks.build(sectioned, max_tokens=120, min_tokens=5)
    got = made.orderBy("chunk_no").collect()
    assert [list(r["path"]) for r in got][:2] == [[], ["Part one"]] and got[1]["prefix_context"] == "Intro words"
    assert "".join(r["source_text"] for r in got).replace("\n", "") == "".join(r["rendered"] for r in blocks.orderBy("pos").collect()) and placed.count() == 6
    assert [r["line"] for r in chunks.outline(sectioned).orderBy("pos").collect()] == ["Part one", "Part one > Sub"]


def test_terms_by_substring(spark):
    terms = spark.createDataFrame([("Net profit", "净利润", ["bottom line"]), ("商誉", "goodwill", []), ("profit", "利润", [])], TERMS)
    texts = spark.createDataFrame([(1, "The BOTTOM LINE and 商誉减值"), (2, "netprofits"), (3, None)], "id int, t string")
    got = {r["id"]: [f["source"] for f in r["found"]] for r in glossary.text_terms(texts, ["id"], "t", terms).collect()}
    assert got == {1: ["Net profit", "商誉"], 2: ["profit"]}
    assert {(r["id"], r["source"]) for r in glossary.term_rows(texts, ["id"], "t", terms, every=1).collect()} == {(1, "Net profit"), (1, "商誉"), (2, "profit")}
    pairs = spark.createDataFrame([(1, "our profit rose", "利润上升"), (2, "our profit rose", "上升")], "id int, s string, t string")
    assert [(r["id"], r["context"]) for r in glossary.missing_terms(pairs, ["id"], "s", "t", terms).collect()] == [(2, "our profit rose")]


def test_terms_by_their_rarest_piece(spark):
    """200,000 names of any length and script against brute force, with nothing gathered on the driver but the lengths of pieces, four at most."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß收入利润商誉") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    texts = [(i, None if i == 7 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(3, "e"), (3, "e"), (99, "lorem Ipsum " * 2_000 + "the very long NAME of a thing indeed")]
    names = {t[i : i + n] for _, t in texts[:40] if t for i in range(0, len(t), 3) for n in (1, 2, 3, 5, 8, 9, 15, 40)} | {"very long name of a thing", "lorem ipsum lorem ipsum lorem", "Collect set", ""}
    names |= {"".join(rng.choice("abcdexyz") for _ in range(rng.randint(6, 12))) for _ in range(200_000 - len(names))}
    terms = spark.createDataFrame([(n, "x", [n[::-1]] if len(n) == 9 else None) for n in names], TERMS)
    df = spark.createDataFrame(texts, "id int, t string").repartition(4)
    collect, frame, seen = type(df).collect, type(df), []
    frame.collect = lambda self: seen.append(self) or collect(self)
    try:
        found = glossary.term_rows(df, ["id"], "t", terms)
        assert [f.columns for f in seen] == [["collect_set(length)"]]
    finally:
        frame.collect = collect
    rows = [(r["id"], r["source"]) for r in found.collect()]
    lows = [(i, (t or "").lower()) for i, t in texts]
    want = set()
    for n in names:
        forms = {n.lower(), n[::-1].lower()} - {""} if len(n) == 9 else {n.lower()} - {""}
        want |= {(i, n) for i, t in lows if any(f in t for f in forms)}
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert glossary.term_rows(df, ["id"], "t", terms.where("false")).count() == 0 and glossary.term_rows(df.where("false"), ["id"], "t", terms).count() == 0


def test_glossary_fold_and_build(spark, tmp_path):
    ev = spark.createDataFrame(
        [(1, "EBITDA", "a", "seed", 1, ["x"]), (2, "ebitda", "a", "curated", 2, ["y"]), (3, "EBITDA", "b", "model", 1, []), (4, "EBITDA", "c", "curated", 1, []), (5, "EBITDA", "d", "source_gloss", 1, []), (6, "EBITDA", "d", "source_gloss", 4, [])],
        "seq int, source string, target string, authority string, frequency int, aliases array<string>",
    )
    entries, clashes = glossary.fold(ev)
    e = entries.first()
    assert (e["target"], e["authority"], e["frequency"]) == ("d", "source_gloss", 5)
    assert [r["reason"] for r in clashes.collect()] == ["superseded by higher authority", "equal-authority disagreement; kept first entry", "replaced curated with higher-authority source_gloss"]
    assert glossary.fold(ev.where("seq <= 2"))[0].first().asDict() == {"key": "ebitda", "source": "EBITDA", "target": "a", "authority": "curated", "frequency": 3, "aliases": ["x", "y"]}
    seeds = spark.createDataFrame([("Revenue", "收入"), ("Goodwill", "商誉")], "source string, target string")
    texts = spark.createDataFrame([("d", 1, "Revenue grew"), ("d", 2, "Revenue（营业收入） and revenue"), ("d", 3, "revenue")], "doc_id string, seq int, t string")
    built, clash = glossary.build(texts, "doc_id", "t", seeds)
    # the lexicon stands once, under a null document
    got = {(r["doc_id"], r["source"]): (r["target"], r["authority"], r["frequency"]) for r in built.collect()}
    assert got == {("d", "Revenue"): ("营业收入", "source_gloss", 1), (None, "Revenue"): ("收入", "seed", 1), (None, "Goodwill"): ("商誉", "seed", 1)} and clash.count() == 1
    assert {(r["doc_id"], r["source"], r["target"]) for r in glossary.of_document(built, "doc_id", "d").collect()} == {("d", "Revenue", "营业收入"), ("d", "Goodwill", "商誉")}
    assert glossary.prune(built, drop_seed=True).count() == 1 and {r["authority"]: r["n"] for r in glossary.by_authority(glossary.of_document(built, "doc_id", "d")).collect()} == {"source_gloss": 1, "seed": 1}
    looked = glossary.lookup(spark.createDataFrame([("d", "REVENUE"), ("e", "REVENUE"), ("d", "goodwill"), ("d", "other")], "doc_id string, w string"), "w", built, ["doc_id"])
    assert {(r["doc_id"], r["w"], r["translation"]) for r in looked.collect()} == {("d", "REVENUE", "营业收入"), ("e", "REVENUE", "收入"), ("d", "goodwill", "商誉"), ("d", "other", "other")}
    built = glossary.of_document(built, "doc_id", "d")
    assert {r["translation"] for r in glossary.lookup(looked.where("doc_id = 'd'").select("w"), "w", built.drop("doc_id")).collect()} == {"营业收入", "商誉", "other"}
    cover = glossary.coverage(spark.createDataFrame([(1, "EPS and IFRS9 of XYZ"), (2, "plain")], "id int, t string"), ["id"], "t", spark.createDataFrame([("eps", "x")], "source string, target string"))
    assert {r["id"]: r["coverage"] for r in cover.collect()} == {1: 0.5, 2: 1.0}
    glossary.save(built.drop("doc_id"), clash, f"{tmp_path}/g")
    assert {r["source"] for r in glossary.load(spark, f"{tmp_path}/g/entries").collect()} == {"Revenue", "Goodwill"}
    for name, text in (("a.json", '[{"term": "x", "translation": "y"}]'), ("b.json", '{"entries": [{"source": "x", "target": "y"}]}')):
        (tmp_path / name).write_text(text)
        assert [(r["source"], r["target"], r["authority"]) for r in glossary.load(spark, f"{tmp_path}/{name}").collect()] == [("x", "y", "curated")]


def test_bilingual_forms(spark):
    t = "EBITDA（息税折旧摊销前利润）。归属于母公司股东的净利润（“归母净利润”）。每股收益 (EPS)。见附注（Note 5）。and Revenue (营业收入)。"
    got = {(r["source"], r["target"]) for r in glossary.bilingual_pairs(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").collect()}
    assert ("EBITDA", "息税折旧摊销前利润") in got and ("EPS", "每股收益") in got and ("Revenue", "营业收入") in got and not any("Note" in s for s, _ in got)


def test_run(spark, outcome):
    r = outcome["results"].first()
    assert (r["mismatched"], r["missing"], r["structural"], r["labels_missing"], r["terms_after"]) == (0, 0, 1, 0, 0) or r["structural"] == 0
    assert r["labels_translated"] == r["tables_translated"] * 5 and r["figures_copied"] >= 6 and not r["errors"]
    texts = {(c["row"], c["col"]): c["text"] for c in outcome["target_cells"].collect()}
    assert texts[2, 0] == "营业收入" and texts[2, 1] == "1,234,567" and texts[4, 0] == "毛利"
    b = {x["pos"]: x for x in outcome["target_blocks"].collect()}
    assert b[0]["text"] == "财务摘要" and "营业收入 增长" in b[1]["text"]
    s = report.summary(outcome).first()
    assert s["chunks"] == 1 and s["number_drift"] == 0 and s["numbers_source"] == s["numbers_matched"]
    md = report.target_markdown(outcome).first()["markdown"]
    assert md.startswith("# Financial Summary\n<!-- c000-00-financial-summary risk=") and "<table>" in md
    assert "<div class=\"page\"" in report.source_html(outcome["blocks"], outcome["target_cells"]).first()["html"] and "band-" in report.target_html(outcome).first()["html"]
    assert "chunks=1" in report.console(outcome)
    asked = outcome["tables"].withColumn("terms", F.array().cast(agents.TERM))
    payloads = agents.table_payloads(outcome["cells"], asked)
    assert payloads.first()["n_labels"] == 5 and agents.leak_audit(payloads, outcome["cells"]).count() == 0


def test_failures_and_repairs(spark, parsed):
    down = report.run(parsed, models.MockModel({}, fail_on=("SOURCE:",)))
    r = down["scored"].first()
    assert r["band"] == "blocked" and r["risk"] == 1.0 and any("prose call failed" in e for e in r["errors"])
    assert down["queue"].count() == 1
    calls = {x["step"]: (x["n_calls"], x["n_failed"]) for x in models.usage(down["calls"]).collect()}
    assert calls["translate"] == (1, 1) and calls["translate-labels"] == (1, 0)

    class Half(models.MockModel):
        def complete(self, system, user, image=None):
            reply = super().complete(system, user, image)
            if user.startswith("Translate these table labels"):
                return json.dumps({"cells": json.loads(reply)["translations"][:2]})
            return reply

    cells, results, calls = agents.translate_tables(parsed["cells"], parsed["tables"].withColumn("terms", F.array().cast(agents.TERM)), Half({"Revenue": "R"}))
    assert results.first()["n_missing"] == 0 and {c["step"] for c in calls.collect()} == {"translate-labels", "retry-missing-labels"}
    _, results, _ = agents.translate_tables(parsed["cells"], parsed["tables"].withColumn("terms", F.array().cast(agents.TERM)), Half({}), agents.Options(retry=False))
    assert 0 < results.first()["coverage"] < 0.6
    prose = spark.createDataFrame([("d", "c", "profit 5", "got 5"), ("d", "e", "profit 7", "got 7")], "doc_id string, chunk_id string, prose string, target_text string")
    made = spark.createDataFrame([("d", "c", [("profit", "利润")]), ("d", "e", [("profit", "利润 8")])], f"doc_id string, chunk_id string, terms {agents.TERM}")
    fixed, left, _ = agents.repair_terms(prose, made, models.MockModel())
    assert {r["chunk_id"]: r["target_text"] for r in fixed.collect()} == {"c": "got 5 (利润)", "e": "got 7 (利润 8)"} and left.count() == 0

    class Bad:
        def complete(self, system, user, image=None):
            return '{"fixed": "利润 9"}'

    fixed, left, _ = agents.repair_terms(prose, made, Bad())
    assert {r["target_text"] for r in fixed.collect()} == {"got 5", "got 7"} and left.count() == 2


def test_paragraphs(spark):
    blocks = spark.createDataFrame([("d", "c", i, "text", f"s{i}") for i in range(3)], "doc_id string, chunk_id string, pos int, kind string, text string")
    for target, want in (("a\n\nb\n\nc", ["a", "b", "c"]), ("a\n\nb", ["a", "b", "s2"]), ("a\n\nb\n\nc\n\nd", ["a", "b", "c\n\nd"]), ("", ["s0", "s1", "s2"])):
        prose = spark.createDataFrame([("d", "c", target)], "doc_id string, chunk_id string, target_text string")
        assert [r["target_text"] for r in agents.paragraphs_to_blocks(prose, blocks).orderBy("pos").collect()] == want


def test_http_model():
    sent, waits = [], []

    def transport(url, headers, body, timeout):
        sent.append((url, headers, json.loads(body)))
        return [(503, "busy"), (200, json.dumps({"choices": [{"message": {"content": "hi"}}]}))][min(len(sent) - 1, 1)]

    assert models.HttpModel("http://x/v1", "m", "k", transport=transport, sleep=waits.append).complete("s", "u") == "hi"
    assert len(sent) == 2 and waits == [0.5] and sent[0][1]["Authorization"] == "Bearer k"
    with pytest.raises(models.ModelError, match="HTTP 400: bad key"):
        models.HttpModel("http://x", "m", transport=lambda *a: (400, '{"error": {"message": "bad key"}}')).complete("s", "u")
    with pytest.raises(models.TransientError):
        models.HttpModel("http://x", "m", transport=lambda *a: (429, "no"), sleep=waits.append).complete("s", "u")
    assert isinstance(models.make_model("auto"), models.MockModel)
    with pytest.raises(ValueError, match="key is needed"):
        models.make_model("openai-compat")
    with pytest.raises(ValueError, match="unknown model"):
        models.make_model("other")


def test_weights_and_explanations(spark):
    df = spark.createDataFrame([(1.0, 2)], "number_drift double, number_mismatch int")
    r = risk.explain(risk.score(df, ["number_drift", "number_mismatch"], weights={"number_drift": 0.1, "number_mismatch": 0.0})).first()
    assert r["risk"] == pytest.approx(0.1) and [x["name"] for x in r["reasons"]] == ["number_drift"] and r["explanation"].startswith("risk=0.10 threshold=0.45 band=auto\n  +0.10 number_drift: 100.0% of source")
    r = risk.score(df, [], errors=F.array(F.lit("gone"))).first()
    assert (r["band"], r["risk"], r["reasons"][0]["detail"]) == ("blocked", 1.0, "gone")


def queue_of(spark):
    rows = [("rv-1", "c1", 0.9, "t1", "approved", "", "ann", True, 1, 2, ["A", "B"], "s1"), ("rv-2", "c2", 0.25, "t2", "pending", "", None, False, 3, 3, [], "s2"), ("rv-3", "c2", 0.5, 't"3', "rejected", "n", None, False, 3, 3, [], "s3\nx")]
    return spark.createDataFrame(rows, "item_id string, chunk_id string, risk double, target_text string, status string, note string, reviewer string, is_financial boolean, page_start int, page_end int, section_path array<string>, source_text string")


def test_queue(spark, tmp_path):
    q = queue_of(spark)
    new = spark.createDataFrame([("rv-1", "c1", 0.8, "t1"), ("rv-3", "c2", 0.5, 't"3'), ("rv-4", "c4", 0.1, "t4")], "item_id string, chunk_id string, risk double, target_text string")
    got = {r["item_id"]: r for r in review.upsert(q, new).collect()}
    assert got["rv-1"]["note"] == "reopened on re-run: evidence changed (risk was 0.90, previously approved by ann)" and got["rv-1"]["status"] == "pending"
    assert (got["rv-3"]["status"], got["rv-3"]["note"], got["rv-2"]["status"], got["rv-4"]["status"]) == ("rejected", "n", "pending", "pending")
    s = review.stats(q).first()
    assert (s["total"], s["pending"], s["approved"], s["edited"], s["financial_pending"], s["max_risk"]) == (3, 1, 1, 0, 0, 0.9)
    ids = spark.createDataFrame([("rv-2",), ("c1",), ("c2",), ("zz",)], "id string")
    assert {r["id"]: r["item_id"] for r in review.resolve(ids, q).collect()} == {"rv-2": "rv-2", "c1": "rv-1", "c2": None, "zz": None}
    assert [r["item_id"] for r in review.listing(q, limit=2).collect()] == ["rv-1", "rv-3"] and review.with_status(q, "pending").count() == 1
    done = review.decide(q, spark.createDataFrame([("rv-2", "edited", "bob")], "item_id string, status string, reviewer string"))
    assert {r["item_id"]: (r["status"], r["reviewer"]) for r in done.collect()}["rv-2"] == ("edited", "bob")
    rows = {r["item_id"]: r for r in review.csv_rows(q, include_text=True).collect()}
    assert (rows["rv-1"]["pages"], rows["rv-1"]["section"], rows["rv-1"]["financial"], rows["rv-1"]["risk"]) == ("1-2", "A > B", "yes", "0.900")
    md = {r["item_id"]: r["text"] for r in review.item_markdown(q).collect()}
    assert "### `c1` — risk 0.90 (?)" in md["rv-1"] and "> s3\n> x" in md["rv-3"]
    review.write_bundle(q, f"{tmp_path}/b")
    text = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/b/review.md").collect())
    assert text.startswith("# Human review sheet") and text.index("`c1`") < text.index("rv-3") < text.index("rv-2")
    html = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/b/review.html").collect())
    assert html.startswith("<!DOCTYPE html>") and html.endswith("</body></html>") and html.count("<section") == 3
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/b/review.csv").collect()]
    assert lines[0].lstrip("﻿").startswith("item_id,chunk_id,status,risk") and '"t""3"' in "\n".join(lines)
    review.append(q.limit(1).withColumn("status", F.lit("edited")).withColumn("seq", F.lit(9)), f"{tmp_path}/b/review.jsonl")
    assert {r["item_id"]: r["status"] for r in layout.read_queue(spark, f"{tmp_path}/b/review.jsonl").collect()}["rv-1"] == "edited"
    review.save(q, f"{tmp_path}/array", "json")
    assert json.loads("\n".join(r[0] for r in spark.read.text(f"{tmp_path}/array").collect()))[0]["item_id"] == "rv-1"


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["demo", "--faults", "3"]) == 0
    assert "caught 3 of 3" in capsys.readouterr().out
    assert cli.main(["parse", f"{tmp_path}/none.json"]) == 2
    queue_of(spark).write.json(f"{tmp_path}/q")
    assert cli.main(["review", f"{tmp_path}/q", "--approve", "rv-2", "--reviewer", "me"]) == 0
    assert "approved" in capsys.readouterr().out
