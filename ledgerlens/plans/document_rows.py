"""Queries of what stands around tables: text forms, blocks, renderings, sections, terms, reports and queues; registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions import text as tx
from ledgerlens.functions.figures import figures, is_numeric_cell
from ledgerlens.functions.units import chinese_numeral, parse_unit
from ledgerlens.operators import chunks, documents, glossary, numdiff, review, risk, sections, tables
from ledgerlens.plans.catalogue import _CELLS, _EVENTS, _LEVEL, _QUEUE, _RISK, cells, lines, money, queues, query, scored, table, term_events, with_header
from ledgerlens.sources import html_tables

_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR)"

# ---- text and figures


@query(f"""WITH n AS (SELECT o_orderkey, {_PRICE} || ' 收入' AS narrow FROM orders)
  SELECT o_orderkey, narrow, round(2.0::DOUBLE / (length(narrow) - 1), 6) AS ratio, (length(narrow) + 2)::INT AS width, trunc(2 / 1.5::DOUBLE + (length(narrow) - 2) / 4.0::DOUBLE + (length(narrow) - 3) * 0.35::DOUBLE)::INT + 1 AS tokens FROM n""")
def q_cjk_text(spark, sf):
    """Totals in full-width digits with two Chinese characters: made narrow, their share of Chinese, display width and tokens."""
    wide = F.concat(F.translate(money("o_totalprice"), "0123456789.", "０１２３４５６７８９．"), F.lit("　收入"))
    d = table(spark, sf, "orders").select("o_orderkey", tx.normalize_width(wide).alias("narrow"))
    return d.select("o_orderkey", "narrow", F.round(tx.cjk_ratio(F.col("narrow")), 6).alias("ratio"), tx.display_width(F.col("narrow")).alias("width"), tx.estimate_tokens(F.col("narrow")).alias("tokens"))


_NUMERAL = "concat(substr('一二三四五六七八九', {k} % 9 + 1, 1), '千', substr('一二三四五六七八九', {k} // 9 % 9 + 1, 1), '百', substr('一二三四五六七八九', {k} // 81 % 9 + 1, 1), '十', substr('一二三四五六七八九', {k} // 729 % 9 + 1, 1))"


def numeral(k):
    """A Chinese numeral of four digits, none of them zero, out of a key."""
    digit = lambda i: F.substr(F.lit("一二三四五六七八九"), (F.floor(F.col(k) / 9**i) % 9 + 1).cast("int"), F.lit(1))
    return F.concat(digit(0), F.lit("千"), digit(1), F.lit("百"), digit(2), F.lit("十"), digit(3))


_FOUR = "((o_orderkey % 9 + 1) * 1000 + (o_orderkey // 9 % 9 + 1) * 100 + (o_orderkey // 81 % 9 + 1) * 10 + o_orderkey // 729 % 9 + 1)"


@query(f"SELECT o_orderkey, {_NUMERAL.format(k='o_orderkey')} AS numeral, CASE o_orderkey % 4 WHEN 0 THEN {_FOUR} WHEN 1 THEN {_FOUR} * 10000 WHEN 2 THEN {_FOUR} * 100000000 END::BIGINT AS value FROM orders")
def q_cn_numeral(spark, sf):
    """Numerals of four digits by themselves, in ten thousands, in hundred millions, and spoilt by a letter."""
    scale = F.element_at(F.array(F.lit(""), F.lit("万"), F.lit("亿"), F.lit("x")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", numeral("o_orderkey").alias("numeral"), scale.alias("scale")).select("o_orderkey", "numeral", chinese_numeral(F.concat("numeral", "scale")).alias("value"))


@query(f"SELECT o_orderkey, {_NUMERAL.format(k='o_orderkey')} AS raw, {_FOUR}::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 10000 ELSE 1 END AS base_value, CASE WHEN o_orderkey % 2 = 0 THEN 'money' ELSE 'count' END AS dimension FROM orders")
def q_cn_figures(spark, sf):
    """Figures in Chinese numerals within a sentence, with the unit after them."""
    unit = F.when(F.col("o_orderkey") % 2 == 0, "万元").otherwise("股")
    o = table(spark, sf, "orders").withColumn("t", F.concat(F.lit("共计"), numeral("o_orderkey"), unit, F.lit("。")))
    return figures(o, "t", ["o_orderkey"]).select("o_orderkey", F.regexp_replace("raw", "[万元股]+$", "").alias("raw"), "base_value", "dimension")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '万元' WHEN 1 THEN 'million' WHEN 2 THEN '%' WHEN 3 THEN 'shares' WHEN 4 THEN 'usd' END AS unit, CASE o_orderkey % 6 WHEN 0 THEN 'money' WHEN 1 THEN 'money' WHEN 2 THEN 'ratio' WHEN 3 THEN 'count' WHEN 4 THEN 'money' END AS dimension,
  CASE o_orderkey % 6 WHEN 0 THEN 10000 WHEN 1 THEN 1000000 WHEN 2 THEN 0.01 WHEN 3 THEN 1 WHEN 4 THEN 1 END::DOUBLE AS multiplier FROM orders""")
def q_parse_unit(spark, sf):
    said = F.element_at(F.array(*[F.lit(x) for x in ("(万元)", "in Million", "of %", "no. of Shares", "USD", "plain")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", parse_unit(F.concat(F.lit("for 7 "), said)).alias("u")).select("o_orderkey", "u.unit", "u.dimension", "u.multiplier")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN format('{:,}', p_partkey * 37) ELSE format('{:,}', p_partkey * 37) || rtrim(substr(printf('%.4f', (p_partkey % 8) / 8.0::DOUBLE), 2), '0') END AS shown FROM part""")
def q_format_number(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.format_number(F.col("p_partkey") * 37 + (F.col("p_partkey") % 8) / F.lit(8.0)).alias("shown"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def q_unescape_html(spark, sf):
    """Whole texts escaped and read back."""
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.unescape_html(tx.escape_html(F.col("text")))).alias("digest"))


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 3) AS footnote, o_orderkey % 7 <> 5 AS numeric_cell FROM orders")
def q_footnotes(spark, sf):
    mark = F.element_at(F.array(*[F.lit(x) for x in ("Note: ", " 注：", "Notice ", "(* ", "see Note: ")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    cell = F.element_at(F.array(*[F.concat(F.lit(a), money("o_totalprice"), F.lit(b)) for a, b in (("", ""), ("(", ")"), ("", "%"), ("up ", ""), ("", " to 5"), ("rose by ", ""), ("x", "y"))]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", tx.is_footnote(F.concat(mark, F.lit("x"))).alias("footnote"), is_numeric_cell(cell).alias("numeric_cell"))


# ---- regions, boxes and blocks


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'table' WHEN 'click' THEN 'chart' WHEN 'purchase' THEN 'image' ELSE 'text' END AS kind FROM events")
def q_region_kinds(spark, sf):
    names = {"view": " Table_Body ", "click": "figure 7", "purchase": "Company Logo", "signup": "section_header", "error": "unheard of"}
    label = F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("event_type")]
    return table(spark, sf, "events").select("event_id", documents.kind_of(label).alias("kind"))


_MEET = "(greatest(0, least(q, 30) - 10) * 10.0::DOUBLE)"


@query(f"WITH b AS (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INT AS row, l_orderkey AS table_id, l_quantity::DOUBLE AS q FROM lineitem) SELECT table_id, row, round({_MEET}, 6) AS meet, round({_MEET} / (q * 20 + 400 - {_MEET}), 6) AS iou, q >= 30 AND false AS holds, greatest(q, 30) AS right_edge FROM b")
def q_boxes(spark, sf):
    """A box as wide as each line's quantity against one from 10 to 30, which is half as far down."""
    b = lines(spark, sf).select("table_id", "row", F.col("q").cast("double").alias("w"))
    box = lambda *v: F.struct(*[(x if not isinstance(x, float) else F.lit(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    a, c = box(0.0, 0.0, F.col("w"), 20.0), box(10.0, 10.0, 30.0, 30.0)
    return b.select("table_id", "row", F.round(documents.box_meet(a, c), 6).alias("meet"), F.round(documents.box_iou(a, c), 6).alias("iou"), documents.box_contains(a, c).alias("holds"), documents.box_union(a, c)["x1"].alias("right_edge"))


def order_blocks(spark, sf):
    """Documents of each customer's orders: a heading, a text, a table (the order's lines), a chart and an image in turn; five blocks a page."""
    o = table(spark, sf, "orders").withColumn("pos", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("text", "text", "table", "chart", "image")]), F.col("pos") % 5 + 1)
    chart = F.struct(F.when(F.col("pos") % 10 == 3, F.concat(F.lit("of "), "o_orderpriority")).otherwise("").alias("description"), F.array().cast("array<int>").alias("series"))
    return o.select(
        F.col("o_custkey").alias("doc_id"), "pos", F.floor(F.col("pos") / 5).cast("int").alias("page_index"), kind.alias("kind"), F.concat("o_orderstatus", F.lit(" "), "o_orderpriority").alias("text"), F.when(F.col("pos") % 5 == 0, F.lit(2)).alias("heading_level"),
        F.when(F.col("pos") % 5 == 2, F.col("o_orderkey")).alias("table_id"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit("No. "), "o_orderkey")).otherwise("").alias("caption"), F.lit("").alias("units_note"), chart.alias("chart"),
    )


_BLOCKS = _CELLS + """, ob AS MATERIALIZED (SELECT o_custkey AS doc_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS pos, o_orderkey, o_orderstatus || ' ' || o_orderpriority AS text, o_orderpriority FROM orders),
  md AS (SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS grid FROM (SELECT table_id, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' || CASE WHEN row = 1 THEN chr(10) || '| --- | --- | --- | --- | --- |' ELSE '' END AS line FROM cells GROUP BY table_id, row) GROUP BY table_id),
  blocks AS MATERIALIZED (SELECT doc_id, pos, pos // 5 AS page_index, CASE WHEN pos % 3 = 0 THEN 'No. ' || o_orderkey ELSE '' END AS caption, o_orderkey, o_orderpriority, text, grid FROM ob LEFT JOIN md ON md.table_id = ob.o_orderkey),
  rendered AS (SELECT doc_id, pos, page_index, CASE pos % 5 WHEN 0 THEN '## ' || text WHEN 1 THEN text WHEN 2 THEN CASE WHEN caption <> '' THEN '[TABLE] ' || caption || chr(10) ELSE '' END || coalesce(grid, '')
    WHEN 3 THEN trim('[CHART] ' || caption) || CASE WHEN pos % 10 = 3 THEN chr(10) || 'of ' || o_orderpriority ELSE '' END ELSE trim('[IMAGE] ' || caption) END AS rendered FROM blocks)"""


def rendered_blocks(spark, sf):
    b = order_blocks(spark, sf)
    body = cells(spark, sf).withColumn("row", F.col("row") - 1)
    return documents.block_text(b, body, body.select("table_id", F.lit("").alias("units_note")).distinct())


@query("WITH " + _BLOCKS + " SELECT doc_id, pos, rendered FROM rendered")
def q_block_text(spark, sf):
    return rendered_blocks(spark, sf).select("doc_id", "pos", "rendered")


@query("WITH " + _BLOCKS + " SELECT doc_id, string_agg(CASE WHEN pos % 5 = 0 THEN '<!-- page ' || page_index || ' -->' || chr(10) || chr(10) ELSE '' END || rendered, chr(10) || chr(10) ORDER BY pos) || chr(10) AS markdown FROM rendered GROUP BY doc_id")
def q_document_markdown(spark, sf):
    return documents.document_markdown(rendered_blocks(spark, sf))


_STATS = """s AS (SELECT doc_id, count(DISTINCT page_index) AS pages, count(*) AS blocks, count(*) FILTER (pos % 5 < 2) AS texts, count(*) FILTER (pos % 5 = 2) AS tables, count(*) FILTER (pos % 5 = 3) AS charts, count(*) FILTER (pos % 5 = 4) AS images, sum(length(text))::BIGINT AS chars FROM blocks GROUP BY doc_id),
  n AS (SELECT b.doc_id, count(c.table_id) AS cells FROM blocks b LEFT JOIN cells c ON c.table_id = b.o_orderkey WHERE b.pos % 5 = 2 GROUP BY b.doc_id)"""


@query("WITH " + _BLOCKS + ", " + _STATS + " SELECT s.*, charts AS charts_unresolved, coalesce(cells, 0) AS cells FROM s LEFT JOIN n ON n.doc_id = s.doc_id")
def q_document_stats(spark, sf):
    body = cells(spark, sf).withColumn("row", F.col("row") - 1)
    built = body.select("table_id", F.lit(0).alias("n_conflicts"), F.array().cast("array<string>").alias("warnings"), F.lit("").alias("units_note")).distinct()
    s = documents.document_stats(order_blocks(spark, sf), body, built)
    return s.select("doc_id", "pages", "blocks", "texts", "tables", "charts", "images", "chars", "charts_unresolved", "cells")


def event_points(spark, sf):
    e = table(spark, sf, "events").where("user_id is not null and value is not null")
    return e.select(F.col("user_id").alias("doc_id"), F.lit(0).alias("pos"), F.col("event_type").alias("series"), F.concat(F.lit("m"), F.month("ts")).alias("category"), F.floor("value").alias("value"), F.col("event_id").alias("ord"))


@query("""WITH p AS MATERIALIZED (SELECT user_id AS doc_id, event_type AS series, 'm' || month(ts) AS category, floor(value)::BIGINT AS value, event_id AS ord FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
  last AS (SELECT doc_id, category, series, arg_max(value, ord) AS value FROM p GROUP BY ALL), s AS (SELECT doc_id, series, min(ord) AS o FROM p GROUP BY ALL), c AS (SELECT doc_id, category, min(ord) AS o FROM p GROUP BY ALL),
  body AS (SELECT c.doc_id, c.o, '| ' || c.category || ' | ' || string_agg(coalesce(format('{:,}', value), '-'), ' | ' ORDER BY s.o) || ' |' AS line FROM c JOIN s ON s.doc_id = c.doc_id LEFT JOIN last l ON l.doc_id = c.doc_id AND l.category = c.category AND l.series = s.series GROUP BY c.doc_id, c.category, c.o),
  head AS (SELECT doc_id, '|  | ' || string_agg(series, ' | ' ORDER BY o) || ' |' || chr(10) || '| --- | ' || string_agg('---', ' | ') || ' |' AS head FROM s GROUP BY doc_id)
  SELECT b.doc_id, '**by month**' || chr(10) || chr(10) || head || chr(10) || string_agg(line, chr(10) ORDER BY o) AS narrative FROM body b JOIN head h ON h.doc_id = b.doc_id GROUP BY b.doc_id, head""")
def q_chart_narrative(spark, sf):
    p = event_points(spark, sf)
    charts = p.select("doc_id", "pos", F.lit("chart").alias("kind"), F.lit("by month").alias("caption"), F.struct(F.lit("").alias("description")).alias("chart")).distinct()
    return documents.chart_narrative(charts, p).select("doc_id", "narrative")


@query("""WITH p AS (SELECT user_id AS doc_id, event_type AS series, 'm' || month(ts) AS category, floor(value)::BIGINT AS value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY series, category, value) - 1)::INT AS ordinal, value::VARCHAR AS raw, value::DOUBLE AS base_value, category AS context FROM p""")
def q_chart_figures(spark, sf):
    p = event_points(spark, sf).withColumn("value", F.col("value").cast("double"))
    return numdiff.chart_figures(p, ["doc_id"]).select("doc_id", "ordinal", "raw", "base_value", "context")


# ---- tables


_SHOWN = """g AS (SELECT table_id, row - 1 AS row, col, substr(text, 1, 20) AS text FROM cells), w AS (SELECT table_id, col, max(length(text)) AS w FROM g WHERE row < 5 GROUP BY table_id, col),
  l AS (SELECT g.table_id, g.row, rtrim(string_agg(rpad(text, w.w::INT, ' '), ' | ' ORDER BY g.col)) AS line FROM g JOIN w ON w.table_id = g.table_id AND w.col = g.col WHERE g.row < 5 GROUP BY g.table_id, g.row), n AS (SELECT table_id, max(row) + 1 AS n FROM g GROUP BY table_id)"""


@query("WITH " + _CELLS + ", " + _SHOWN + " SELECT l.table_id, string_agg(line, chr(10) ORDER BY row) || CASE WHEN n > 5 THEN chr(10) || '... ' || (n - 5) || ' more row(s)' ELSE '' END AS rendered FROM l JOIN n ON n.table_id = l.table_id GROUP BY l.table_id, n")
def q_table_preview(spark, sf):
    return tables.preview(cells(spark, sf).withColumn("row", F.col("row") - 1))


@query("WITH " + _CELLS + " SELECT table_id, row, col, 1 AS row_span, 1 AS col_span, false AS is_header, text FROM cells UNION ALL SELECT k.table_id, 0, c, 1, s, true, t FROM (SELECT DISTINCT table_id FROM cells) k CROSS JOIN (VALUES (0, 1, 'Item'), (1, 2, 'Amounts | net'), (3, 2, 'Rates & taxes')) h(c, s, t)")
def q_html_round_trip(spark, sf):
    """Tables rendered as HTML and read back, spans and headers and all."""
    c = with_header(cells(spark, sf))
    return html_tables.html_cells(tables.to_html(c, tables.header_rows(c), data=True), "table_id", "rendered")


@query(f"SELECT o_orderkey, {_PRICE} AS total, o_orderstatus AS status FROM orders")
def q_model_replies(spark, sf):
    """Objects out of a model's replies, with prose and code fences around them, commas too many, and braces before them."""
    body = F.concat(F.lit('{"total": "'), money("o_totalprice"), F.lit('", "status": "'), "o_orderstatus", F.lit('",}'))
    reply = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("{so} "), body, F.lit(" {}"))).otherwise(body)
    o = html_tables.parse_replies(table(spark, sf, "orders").select("o_orderkey", reply.alias("r")), "r", "total string, status string")
    return o.select("o_orderkey", "parsed.total", "parsed.status")


# ---- sections


_PATHS = "b AS (SELECT *, " + _LEVEL + " AS level FROM events WHERE user_id IS NOT NULL), w AS (SELECT user_id, event_id, event_type, " + ", ".join(f"last_value(CASE WHEN level <= {k} THEN level END IGNORE NULLS) OVER p AS l{k}, last_value(CASE WHEN level <= {k} THEN event_id END IGNORE NULLS) OVER p AS t{k}" for k in (1, 2, 3)) + ", row_number() OVER p AS pos FROM b WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), paths AS (SELECT user_id, event_id, event_type, pos, list_filter([" + ", ".join(f"CASE WHEN l{k} = {k} THEN t{k}::VARCHAR END" for k in (1, 2, 3)) + "], lambda x: x IS NOT NULL) AS path FROM w)"


def event_sections(spark, sf):
    b = table(spark, sf, "events").where("user_id is not null").withColumn("level", F.expr(_LEVEL)).withColumn("title", F.col("event_id").cast("string"))
    b = b.withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return sections.section_paths(b.withColumnRenamed("user_id", "doc_id"), ["doc_id"], "at", 3).withColumnRenamed("at", "pos")


@query("WITH " + _PATHS + " SELECT user_id AS doc_id, array_to_string(path[1:2], ' > ') AS line, min(pos)::INT AS pos FROM paths WHERE len(path) > 0 GROUP BY ALL")
def q_outline(spark, sf):
    return chunks.outline(event_sections(spark, sf))


@query("WITH " + _PATHS + " SELECT event_id AS table_id, array_to_string(path, ' / ') AS path FROM paths WHERE event_type = 'view'")
def q_table_sections(spark, sf):
    s = event_sections(spark, sf).withColumn("table_id", F.when(F.col("event_type") == "view", F.col("event_id")))
    return chunks.table_sections(s).select("table_id", F.array_join("path", " / ").alias("path"))


_CHUNKS = "sized AS (SELECT user_id, event_id, pos, CASE WHEN level IS NOT NULL THEN event_id END AS head, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS span, level, 1 + event_id % 50 AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM b)), led AS (SELECT *, coalesce(max(CASE WHEN level IS NOT NULL THEN tokens END) OVER (PARTITION BY user_id, span), 0) AS heading FROM sized)"


@query("WITH RECURSIVE b AS (SELECT *, " + _LEVEL + " AS level FROM events WHERE user_id IS NOT NULL), " + _CHUNKS.replace(" AS (", " AS MATERIALIZED (") + """, f AS (SELECT user_id, pos, event_id, span, 0 AS part, heading + tokens AS used, 1 AS held FROM led WHERE pos = 1
  UNION ALL SELECT l.user_id, l.pos, l.event_id, l.span, CASE WHEN l.span <> f.span THEN 0 WHEN f.used + l.tokens > 120 THEN f.part + 1 ELSE f.part END,
    CASE WHEN l.span <> f.span OR f.used + l.tokens > 120 THEN l.heading + l.tokens ELSE f.used + l.tokens END, CASE WHEN l.span <> f.span OR f.used + l.tokens > 120 THEN 1 ELSE f.held + 1 END FROM f JOIN led l ON l.user_id = f.user_id AND l.pos = f.pos + 1)
  SELECT user_id AS doc_id, pos::INT AS pos, part FROM f""")
def q_chunk_plan(spark, sf):
    """Blocks of 1 to 50 tokens packed into chunks of at most 120 within their sections; a section begins charged with its heading."""
    s = event_sections(spark, sf).withColumn("kind", F.lit("text")).withColumn("heading_level", F.col("level") + 2)
    size = F.expr("cast(1 + event_id % 50 as int)")
    placed = chunks.pack(s.withColumn("rendered", size.cast("string")), max_tokens=120, counter=lambda c: c.cast("int"))
    return placed.select("doc_id", "pos", "part")


# ---- terms


@query("WITH e AS (SELECT lower(p_name) || ' ' || p_partkey % 500 AS key, ['source_gloss', 'curated', 'seed', 'model'][(p_partkey % 4 + 1)::INT] AS authority, p_partkey % 4 AS rank, p_partkey AS seq FROM part), w AS (SELECT key, arg_min(authority, (rank, seq)) AS authority FROM e GROUP BY key) SELECT authority, count(*) AS n FROM w GROUP BY authority")
def q_glossary_authorities(spark, sf):
    named = term_events(spark, sf).drop("source").join(table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.concat("p_name", F.lit(" "), F.col("p_partkey") % 500).alias("source")), "seq")
    return glossary.by_authority(glossary.merge(named)[0])


@query("WITH " + _EVENTS + " SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'no ' || p_type ELSE w.target END AS translation FROM part LEFT JOIN win w ON w.key = lower(p_type)")
def q_glossary_lookup(spark, sf):
    entries = glossary.merge(term_events(spark, sf))[0]
    asked = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("no "), "p_type")).otherwise(F.upper("p_type")).alias("term"))
    return glossary.lookup(asked, "term", entries).select("p_partkey", "translation")


@query("SELECT p_partkey, trim(p_type) AS source, '类' || CASE WHEN p_size < 10 THEN '甲' ELSE '乙' END AS target FROM part")
def q_bilingual_pairs(spark, sf):
    """Both names of a thing out of sentences that give them, in the three forms with brackets."""
    name = F.concat(F.lit("类"), F.when(F.col("p_size") < 10, "甲").otherwise("乙"))
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.trim("p_type"), F.lit("（"), name, F.lit("）。"))).when(k == 1, F.concat(name, F.lit(" ("), F.trim("p_type"), F.lit(")"))).otherwise(F.concat(name, F.lit("（“"), F.trim("p_type"), F.lit("”）")))
    return glossary.bilingual_pairs(table(spark, sf, "part").select("p_partkey", t.alias("t")), "p_partkey", "t")


@query("WITH t AS (SELECT DISTINCT text AS name FROM benchmark WHERE text <> '') SELECT doc_id, md5(name) AS name FROM documents JOIN t ON contains(lower(documents.text), lower(name))")
def q_terms_whole(spark, sf):
    """The whole benchmark texts in documents, whatever the case."""
    names = table(spark, sf, "benchmark").where("text <> ''").select(F.col("text").alias("source"), F.lit("x").alias("target")).distinct()
    return glossary.term_rows(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", names).select("doc_id", F.md5("source").alias("name"))


@query("""WITH t AS (SELECT DISTINCT substr(text, 3, 9) AS name FROM benchmark WHERE length(text) > 12)
  SELECT doc_id, name AS source FROM documents JOIN t ON contains(lower(documents.text), lower(name)) WHERE NOT contains(substr(documents.text, length(documents.text) // 2 + 1), name)""")
def q_terms_missing(spark, sf):
    """Terms that a document holds but its second half, as its translation, does not."""
    names = table(spark, sf, "benchmark").where("length(text) > 12").select(F.substring("text", 3, 9).alias("source")).distinct().withColumn("target", F.col("source"))
    d = table(spark, sf, "documents").select("doc_id", "text", F.expr("substring(text, cast(floor(char_length(text) / 2) as int) + 1)").alias("half"))
    return glossary.missing_terms(d, ["doc_id"], "text", "half", names, context=False).select("doc_id", "source")


# ---- reports, risk and queue


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 50 AS part, {_PRICE} AS p FROM orders), x AS (SELECT part, count(*) FILTER (k % 5 > 0) AS matched, count(*) FILTER (k % 5 = 0) AS missing FROM o GROUP BY part)
  SELECT part, matched, missing, matched + missing AS source_total, matched AS target_total, round(missing::DOUBLE / (matched + missing), 6) AS drift, missing = 0 AS ok FROM x""")
def q_merged_reports(spark, sf):
    """Reports of orders, every fifth of which has lost its total, added up by part."""
    pairs = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("total of "), money("o_totalprice")).alias("s"), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("sum "), money("o_totalprice"))).otherwise("none").alias("t"))
    reports = numdiff.report(numdiff.check_texts(pairs, ["o_orderkey"], "s", "t"), ["o_orderkey"], pairs).withColumn("part", F.col("o_orderkey") % 50)
    return numdiff.merge_reports(reports, ["part"]).select("part", "matched", "missing", "source_total", "target_total", F.round("drift", 6).alias("drift"), "ok")


@query("WITH " + _RISK + " SELECT count(*) AS n, 0::BIGINT AS blocked, count(*) FILTER (band = 'review') AS review, count(*) FILTER (band = 'watch') AS watch, count(*) FILTER (band = 'auto') AS auto, max(risk) AS max_risk, round(avg(risk), 6) AS mean_risk FROM scored")
def q_risk_summary(spark, sf):
    return risk.batch_summary(scored(spark, sf)).withColumn("mean_risk", F.round("mean_risk", 6))


@query("WITH " + _RISK + """, r AS (SELECT table_id, unnest([{'c': f1, 'n': 'number_drift'}, {'c': f2, 'n': 'number_mismatch'}, {'c': f3, 'n': 'number_structural'}], recursive := true) FROM parts)
  SELECT p.table_id, coalesce(string_agg(n, ',' ORDER BY c DESC, n) FILTER (c > 0), '') AS reasons FROM parts p JOIN r ON r.table_id = p.table_id GROUP BY p.table_id""")
def q_top_reasons(spark, sf):
    return scored(spark, sf).select("table_id", F.array_join(review.top_reasons(F.col("reasons")), ",").alias("reasons"))


@query("WITH " + _QUEUE + " SELECT item_id, chunk_id, risk FROM queue WHERE status = 'pending' ORDER BY risk DESC, item_id LIMIT 20")
def q_review_listing(spark, sf):
    """Top-k report: the 20 riskiest items that are pending."""
    return review.listing(review.upsert(*queues(spark, sf)), "pending").select("item_id", "chunk_id", "risk")


@query("WITH " + _QUEUE + " SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'edited') AS edited, count(*) FILTER (status = 'pending' AND chunk_id % 2 = 0) AS financial_pending, round(max(risk), 4) AS max_risk FROM queue")
def q_review_stats(spark, sf):
    q = review.upsert(*queues(spark, sf)).withColumn("is_financial", F.col("chunk_id") % 2 == 0)
    return review.stats(q).select("total", "pending", "approved", "rejected", "edited", "financial_pending", "max_risk")


@query("WITH " + _QUEUE + " SELECT CASE chunk_id % 3 WHEN 0 THEN item_id WHEN 1 THEN chunk_id::VARCHAR ELSE 'no ' || chunk_id END AS id, CASE WHEN chunk_id % 3 < 2 THEN item_id END AS item_id FROM queue")
def q_review_resolve(spark, sf):
    """Items named by their identifier, by their chunk, or by neither."""
    q = review.upsert(*queues(spark, sf))
    k = F.col("chunk_id") % 3
    return review.resolve(q.select(F.when(k == 0, F.col("item_id")).when(k == 1, F.col("chunk_id").cast("string")).otherwise(F.concat(F.lit("no "), "chunk_id")).alias("id")), q)


@query("WITH " + _QUEUE + """ SELECT item_id, concat('### `', chunk_id, '` — risk ', printf('%.2f', risk), ' (?)', chr(10), chr(10), '- **Section**: (none)', chr(10), '- **Pages**: ', chr(10), '- **Financial summary**: no', chr(10), '- **Status**: `', status, '`', chr(10), chr(10),
  '**Source**', chr(10), chr(10), '> _(empty)_', chr(10), chr(10), '**Target**', chr(10), chr(10), '> ', target_text, chr(10), chr(10), '<!-- item_id: ', item_id, ' -->', chr(10)) AS text FROM queue""")
def q_item_markdown(spark, sf):
    return review.item_markdown(review.upsert(*queues(spark, sf)))


@query("WITH " + _QUEUE + ", d AS (SELECT item_id, chunk_id, CASE WHEN chunk_id % 4 = 0 THEN 'edited' ELSE status END AS status FROM queue) SELECT item_id, status FROM d")
def q_review_decide(spark, sf):
    q = review.upsert(*queues(spark, sf))
    return review.decide(q, q.where("chunk_id % 4 = 0").select("item_id", "chunk_id", F.lit("edited").alias("status"))).select("item_id", "status")

