"""Queries over the driver's tables, one or more for each family of operators, with the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import text as tx
from ledgerlens.functions.figures import figures
from ledgerlens.functions.units import UNIT, unit_from_note
from ledgerlens.operators import glossary, numdiff, retrieval, review, risk, sections, tables, translate
from ledgerlens.operators.keep import shared_folder, writer
from ledgerlens.streaming import review_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- relations that the queries share: statement tables rendered from line items


def money(c: str):
    return F.col(c).cast("decimal(15,2)").cast("string")


LINE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
COLUMNS = ["concat(l_linestatus, ' ', l_returnflag)", "q", "p", "d", "t"]


def lines(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(*LINE)
    out = table(spark, sf, "lineitem").withColumn("row", F.row_number().over(w))
    return out.select(F.col("l_orderkey").alias("table_id"), "row", "l_linestatus", "l_returnflag", "l_extendedprice", money("l_quantity").alias("q"), money("l_extendedprice").alias("p"), money("l_discount").alias("d"), money("l_tax").alias("t"))


def rows(spark, sf):
    """Body rows: table_id, row (from 1), texts (of columns 0 to 4)."""
    return lines(spark, sf).select("table_id", "row", F.array(*[F.expr(c) for c in COLUMNS]).alias("texts"))


def cells(spark, sf):
    """Body cells: table_id, row (from 1), col (0 to 4), text, row_span, col_span."""
    body = rows(spark, sf).select("table_id", "row", F.posexplode("texts").alias("col", "text"))
    return body.withColumn("row_span", F.lit(1)).withColumn("col_span", F.lit(1))


def with_header(body):
    head = F.array(*[F.struct(F.lit(0).alias("row"), F.lit(c).alias("col"), F.lit(t).alias("text"), F.lit(1).alias("row_span"), F.lit(s).alias("col_span")) for c, t, s in ((0, "Item", 1), (1, "Amounts | net", 2), (3, "Rates & taxes", 2))])
    return body.union(body.select("table_id").distinct().select("table_id", F.inline(head)))


def target_cells(spark, sf):
    """A flawed copy: every 11th table has digits changed in its prices, every 13th lacks row 1."""
    c = cells(spark, sf).where("not (table_id % 13 = 0 and row = 1)")
    return c.withColumn("text", F.when((F.col("table_id") % 11 == 0) & (F.col("col") == 2), F.translate("text", "15", "51")).otherwise(F.col("text")))


def target_rows(spark, sf):
    """The same flawed copy by rows."""
    slipped = F.transform("texts", lambda x, i: F.when(i == 2, F.translate(x, "15", "51")).otherwise(x))
    return rows(spark, sf).where("not (table_id % 13 = 0 and row = 1)").withColumn("texts", F.when(F.col("table_id") % 11 == 0, slipped).otherwise(F.col("texts")))


_LINES = """lines AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INT AS row,
  l_linestatus || ' ' || l_returnflag AS label, l_extendedprice, CAST(CAST(l_quantity AS DECIMAL(15,2)) AS VARCHAR) AS q, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS p, CAST(CAST(l_discount AS DECIMAL(15,2)) AS VARCHAR) AS d, CAST(CAST(l_tax AS DECIMAL(15,2)) AS VARCHAR) AS t FROM lineitem)"""
_CELLS = _LINES + """, cells AS (SELECT table_id, row, 0 AS col, label AS text FROM lines UNION ALL SELECT table_id, row, 1, q FROM lines UNION ALL SELECT table_id, row, 2, p FROM lines UNION ALL SELECT table_id, row, 3, d FROM lines UNION ALL SELECT table_id, row, 4, t FROM lines)"""
_TARGET = _CELLS + """, target AS (SELECT table_id, row, col, CASE WHEN table_id % 11 = 0 AND col = 2 THEN translate(text, '15', '51') ELSE text END AS text FROM cells WHERE NOT (table_id % 13 = 0 AND row = 1))"""
_HEADS = """heads(row, col, text) AS (VALUES (0, 0, 'Item'), (0, 1, 'Amounts | net'), (0, 2, 'Amounts | net'), (0, 3, 'Rates & taxes'), (0, 4, 'Rates & taxes'))"""
_GRID = _CELLS + ", " + _HEADS + """, grid AS (SELECT table_id, row, col, text FROM cells UNION ALL SELECT k.table_id, h.row, h.col, h.text FROM (SELECT DISTINCT table_id FROM cells) k CROSS JOIN heads h)"""
_CHECK = _TARGET + """, chk AS (SELECT coalesce(s.table_id, t.table_id) AS table_id, coalesce(s.row, t.row) AS row, coalesce(s.col, t.col) AS col, s.text AS source_text, t.text AS target_text,
  CASE WHEN t.table_id IS NULL THEN 'missing' WHEN s.table_id IS NULL THEN 'extra' WHEN s.text = t.text THEN 'same' ELSE 'changed' END AS finding FROM cells s FULL JOIN target t ON s.table_id = t.table_id AND s.row = t.row AND s.col = t.col)"""
_COUNTS = _CHECK + """, counts AS (SELECT table_id, count(*) FILTER (finding = 'same') AS matched, count(*) FILTER (finding = 'missing') AS missing, count(*) FILTER (finding = 'changed') AS mismatched FROM chk GROUP BY table_id),
  drifts AS (SELECT *, CASE WHEN matched + missing + mismatched = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (missing + mismatched)::DOUBLE / (matched + missing + mismatched)) END AS drift FROM counts)"""
_RISK = _COUNTS + """, parts AS (SELECT *, least(1, drift) * 1.0 AS f1, least(1, mismatched / 2.0::DOUBLE) * 0.55::DOUBLE AS f2, least(1, missing / 3.0::DOUBLE) * 0.30::DOUBLE AS f3 FROM drifts),
  risks AS (SELECT table_id, round(least(1.0::DOUBLE, f1 + f2 + f3), 6) AS risk, CASE WHEN table_id % 2 = 0 THEN 0.30::DOUBLE ELSE 0.45::DOUBLE END AS threshold FROM parts),
  scored AS (SELECT table_id, risk, threshold, CASE WHEN risk >= threshold THEN 'review' WHEN risk >= 0.6::DOUBLE * threshold THEN 'watch' ELSE 'auto' END AS band FROM risks)"""


def counts(spark, sf):
    check = numdiff.check_tables(cells(spark, sf), target_cells(spark, sf))
    by = lambda f: F.count_if(F.col("finding") == f)
    return numdiff.drift(check.groupBy("table_id").agg(by("same").alias("matched"), by("missing").alias("missing"), by("changed").alias("mismatched")))


def scored(spark, sf):
    features = counts(spark, sf).withColumnsRenamed({"drift": "number_drift", "mismatched": "number_mismatch", "missing": "number_structural"})
    return risk.score(features, ["number_drift", "number_mismatch", "number_structural"], financial=F.col("table_id") % 2 == 0)


# ---- text


@query("SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY lang")
def q_doc_stats(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("bigint").alias("longest"), F.sum(F.size(F.split("text", "\n"))).alias("lines"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def q_norm_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.normalize_whitespace(F.col("text"))).alias("digest"))


@query("SELECT item_id, lower(substr(trim(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g'), '-'), 1, 24)) AS slug, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS short FROM benchmark")
def q_slug_truncate(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.slugify(F.col("text"), 24).alias("slug"), tx.truncate(F.col("text"), 40).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE trunc(length(text) / 4.0::DOUBLE + length(regexp_replace(text, '[^0-9,.%]', '', 'g')) * 0.35::DOUBLE)::INT + 1 END AS tokens, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text)::DOUBLE, 6) AS density FROM documents")
def q_token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"), F.round(tx.numeric_density(F.col("text")), 6).alias("density"))


@query("SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def q_escape_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.escape_html(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("escaped"))


@query("WITH " + _CELLS + " SELECT table_id, count(*) FILTER (regexp_matches(text, '^-?[0-9]+([.][0-9]+)?$'))::BIGINT AS n_numeric FROM cells GROUP BY table_id")
def q_looks_numeric(spark, sf):
    return cells(spark, sf).groupBy("table_id").agg(F.count_if(tx.looks_numeric(F.col("text"))).alias("n_numeric"))


# ---- figures


_FIG = r"\(?[-+−]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+|\.[0-9]+|[0-9]+)(?:\s*\))?"


@query(f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{_FIG}') AS f FROM documents), x AS (SELECT doc_id, unnest(f) AS raw, unnest(range(len(f)))::INT AS ordinal FROM m)
  SELECT doc_id, ordinal, raw, CASE WHEN raw LIKE '%-%' OR raw LIKE '%−%' OR (raw LIKE '(%' AND raw LIKE '%)') THEN -1.0 ELSE 1.0 END::DOUBLE * regexp_replace(raw, '[^0-9.]', '', 'g')::DOUBLE AS value FROM x""")
def q_extract_numbers(spark, sf):
    return figures(table(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id", "ordinal", "raw", "value")


@query("""SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS raw, CASE o_orderkey % 5 WHEN 0 THEN 'money' WHEN 1 THEN 'money' WHEN 2 THEN 'ratio' WHEN 3 THEN 'count' ELSE 'money' END AS dimension,
  CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS value, CASE o_orderkey % 5 WHEN 0 THEN 1000000.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.01 WHEN 3 THEN 1.0 ELSE 1000.0 END::DOUBLE AS multiplier FROM orders""")
def q_units_resolve(spark, sf):
    n = money("o_totalprice")
    k = F.col("o_orderkey") % 5
    o = table(spark, sf, "orders").withColumn("t", F.when(k == 0, F.concat(F.lit("of "), n, F.lit(" million"))).when(k == 1, F.concat(F.lit("USD "), n)).when(k == 2, F.concat(F.lit("up "), n, F.lit("%"))).when(k == 3, F.concat(n, F.lit(" shares"))).otherwise(n))
    hint = F.when(k == 4, unit_from_note(F.lit("RMB'000"))).otherwise(F.lit(None).cast(UNIT))
    return figures(o.withColumn("h", hint), "t", ["o_orderkey"], F.col("h")).select("o_orderkey", "raw", "dimension", "value", "multiplier")


@query("WITH " + _LINES + " SELECT table_id, md5(string_agg(p, ',' ORDER BY p)) AS fingerprint FROM lines GROUP BY table_id")
def q_fingerprint(spark, sf):
    return lines(spark, sf).groupBy("table_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("p")), ",")).alias("fingerprint"))


def prices(c):
    return c.where("col = 2").select("table_id", F.lit("unknown").alias("dimension"), F.col("text").cast("double").alias("base_value"), F.col("text").alias("raw"), F.col("row").alias("ordinal"))


@query("WITH " + _TARGET + """, s AS (SELECT table_id, text, count(*) AS n FROM cells WHERE col = 2 GROUP BY ALL), t AS (SELECT table_id, text, count(*) AS n FROM target WHERE col = 2 GROUP BY ALL),
  j AS (SELECT coalesce(s.table_id, t.table_id) AS table_id, coalesce(s.n, 0) AS a, coalesce(t.n, 0) AS b FROM s FULL JOIN t ON s.table_id = t.table_id AND s.text = t.text)
  SELECT table_id, sum(least(a, b))::BIGINT AS matched, sum(greatest(a - b, 0))::BIGINT AS missing, sum(greatest(b - a, 0))::BIGINT AS added FROM j GROUP BY table_id""")
def q_number_diff_strict(spark, sf):
    m = numdiff.match_exact(prices(cells(spark, sf)), prices(target_cells(spark, sf)), ["table_id"])
    return m.groupBy("table_id").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("matched", "missing", "added")])


@query("WITH RECURSIVE " + _TARGET.replace(" AS (", " AS MATERIALIZED (") + """, s AS (SELECT table_id, text, row, row_number() OVER (PARTITION BY table_id, text ORDER BY row) AS n FROM cells WHERE col = 2), t AS (SELECT table_id, text, row, row_number() OVER (PARTITION BY table_id, text ORDER BY row) AS n FROM target WHERE col = 2),
  missing AS (SELECT s.* FROM s ANTI JOIN t ON s.table_id = t.table_id AND s.text = t.text AND s.n = t.n), added AS (SELECT t.* FROM t ANTI JOIN s ON s.table_id = t.table_id AND s.text = t.text AND s.n = t.n),
  d AS (SELECT m.table_id, m.row AS si, a.row AS ti, m.text AS source_raw, a.text AS target_raw, levenshtein(replace(m.text, '.', ''), replace(a.text, '.', '')) AS edits, abs(m.text::DOUBLE - a.text::DOUBLE) / greatest(abs(m.text::DOUBLE), 1e-12) AS change
    FROM missing m JOIN added a ON m.table_id = a.table_id AND length(replace(m.text, '.', '')) = length(replace(a.text, '.', ''))),
  p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY edits, change, si, ti) AS i FROM d WHERE edits <= 2 OR change <= 0.02),
  g AS (SELECT table_id, 0::BIGINT AS i, []::INT[] AS ss, []::INT[] AS ts, false AS taken FROM (SELECT DISTINCT table_id FROM p)
    UNION ALL SELECT g.table_id, p.i, CASE WHEN list_contains(ss, si) OR list_contains(ts, ti) THEN ss ELSE list_append(ss, si) END, CASE WHEN list_contains(ss, si) OR list_contains(ts, ti) THEN ts ELSE list_append(ts, ti) END, NOT (list_contains(ss, si) OR list_contains(ts, ti))
    FROM g JOIN p ON p.table_id = g.table_id AND p.i = g.i + 1)
  SELECT p.table_id, source_raw, target_raw, edits::INT AS edits FROM g JOIN p ON p.table_id = g.table_id AND p.i = g.i WHERE taken""")
def q_number_diff_near(spark, sf):
    m = numdiff.match_exact(prices(cells(spark, sf)), prices(target_cells(spark, sf)), ["table_id"])
    return numdiff.match_near(m, ["table_id"]).select("table_id", "source_raw", "target_raw", "edits")


# ---- tables


@query("WITH " + _CHECK.replace(" AS (", " AS MATERIALIZED (") + " SELECT table_id, row, col, source_text, target_text, finding FROM chk WHERE finding <> 'same'")
def q_table_check(spark, sf):
    return numdiff.check_tables(cells(spark, sf), target_cells(spark, sf)).where("finding <> 'same'")


@query("WITH " + _COUNTS + " SELECT table_id, matched, missing, mismatched, round(drift, 6) AS drift FROM drifts")
def q_drift(spark, sf):
    return counts(spark, sf).withColumn("drift", F.round("drift", 6))


@query("WITH " + _GRID + " SELECT table_id, row, col, text FROM grid")
def q_table_grid(spark, sf):
    return tables.grid(with_header(cells(spark, sf))).select("table_id", "row", "col", "text")


@query("WITH " + _CELLS + " SELECT table_id, row, col FROM cells WHERE (table_id + row) % 7 = 0 AND col = 3")
def q_table_holes(spark, sf):
    return tables.holes(with_header(cells(spark, sf).where("not ((table_id + row) % 7 = 0 and col = 3)")))


@query("WITH " + _GRID + ", l AS (SELECT table_id, row, string_agg(text, chr(9) ORDER BY col) AS line FROM grid GROUP BY table_id, row) SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS rendered FROM l GROUP BY table_id")
def q_table_tsv(spark, sf):
    return tables.to_tsv(with_header(cells(spark, sf)))


@query("WITH " + _GRID + ", l AS (SELECT table_id, row, '| ' || string_agg(replace(text, '|', '\\|'), ' | ' ORDER BY col) || ' |' || CASE WHEN row = 0 THEN chr(10) || '| --- | --- | --- | --- | --- |' ELSE '' END AS line FROM grid GROUP BY table_id, row) SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS rendered FROM l GROUP BY table_id")
def q_table_markdown(spark, sf):
    return tables.to_markdown(with_header(cells(spark, sf)))


@query("WITH " + _CELLS + ", l AS (SELECT table_id, row, '<tr>' || string_agg('<td>' || text || '</td>', '' ORDER BY col) || '</tr>' AS line FROM cells GROUP BY table_id, row) SELECT table_id, '<table><thead><tr><th>Item</th><th colspan=\"2\">Amounts | net</th><th colspan=\"2\">Rates &amp; taxes</th></tr></thead><tbody>' || string_agg(line, '' ORDER BY row) || '</tbody></table>' AS rendered FROM l GROUP BY table_id")
def q_table_html(spark, sf):
    c = with_header(cells(spark, sf))
    return tables.to_html(c, tables.header_rows(c))


@query("WITH " + _CELLS + " SELECT table_id, row, CASE col WHEN 0 THEN 'Item' WHEN 1 THEN 'Amounts | net' WHEN 2 THEN 'Amounts | net' ELSE 'Rates & taxes' END AS field, text FROM cells")
def q_table_records(spark, sf):
    c = with_header(cells(spark, sf))
    return tables.to_records(c, tables.header_rows(c))


@query("WITH " + _CELLS + " SELECT DISTINCT table_id, 1 AS n_header FROM cells")
def q_header_rows(spark, sf):
    return tables.header_rows(with_header(cells(spark, sf)))


def boxes(spark, sf):
    j = F.expr("(table_id + row * 3 + col) % 5 - 2")
    return cells(spark, sf).select("table_id", "text", F.col("row").alias("r"), F.col("col").alias("c"), (F.col("col") * 120.0 + j).alias("x0"), (F.col("row") * 40.0 + j).alias("y0"), (F.col("col") * 120.0 + 120.0 + j).alias("x1"), (F.col("row") * 40.0 + 40.0 + j).alias("y1"))


_BOXES = _CELLS + ", boxes AS (SELECT table_id, text, row, col, col * 120.0::DOUBLE + (table_id + row * 3 + col) % 5 - 2 AS x0, row * 40.0::DOUBLE + (table_id + row * 3 + col) % 5 - 2 AS y0 FROM cells)"


@query("WITH " + _BOXES + """, e AS (SELECT table_id, x0 AS v FROM boxes UNION ALL SELECT table_id, x0 + 120 FROM boxes), g AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY table_id ORDER BY v) > 42 THEN 1 ELSE 0 END AS nw FROM e),
  h AS (SELECT table_id, v, sum(nw) OVER (PARTITION BY table_id ORDER BY v RANGE UNBOUNDED PRECEDING)::INT AS idx FROM g) SELECT table_id, idx, round(avg(v), 4) AS line FROM h GROUP BY table_id, idx""")
def q_boundaries(spark, sf):
    return tables.boundaries(boxes(spark, sf), "x0", "x1").withColumn("line", F.round("line", 4))


@query("WITH " + _CELLS + ", b AS (SELECT *, row - min(row) OVER (PARTITION BY table_id) AS r0 FROM cells) SELECT table_id, r0::INT AS row, col, 1 AS row_span, 1 AS col_span, text FROM b")
def q_grid_rebuild(spark, sf):
    return tables.place_by_boxes(boxes(spark, sf)).select("table_id", "row", "col", "row_span", "col_span", "text")


@query("WITH " + _BOXES + " SELECT table_id, row, col, row_number() OVER (PARTITION BY table_id ORDER BY round_even(y0 / 6.0::DOUBLE, 0), x0, row * 10 + col)::INT AS rank FROM boxes")
def q_reading_order(spark, sf):
    b = boxes(spark, sf).withColumn("ord", F.col("r") * 10 + F.col("c"))
    return tables.reading_order(b, ["table_id"]).select("table_id", F.col("r").alias("row"), F.col("c").alias("col"), "rank")


# ---- sections and chunks


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 END::INT AS level,
  CASE p_partkey % 6 WHEN 0 THEN 'numbered' WHEN 1 THEN 'en-part' WHEN 2 THEN 'appendix' WHEN 3 THEN 'allcaps' WHEN 4 THEN 'cn-chapter' END AS rule FROM part""")
def q_headings(spark, sf):
    k = F.col("p_partkey") % 6
    t = F.when(k == 0, F.concat(F.lit("1.2.3 item "), "p_partkey")).when(k == 1, F.concat(F.lit("PART IV "), "p_partkey")).when(k == 2, F.concat(F.lit("Appendix "), "p_partkey")).when(k == 3, F.lit("FINANCIAL SUMMARY")).when(k == 4, F.lit("第三章 管理层讨论")).otherwise(F.concat(F.lit("the sentence of part "), "p_partkey", F.lit(" goes on.")))
    return table(spark, sf, "part").select("p_partkey", sections.heading(t).alias("h")).select("p_partkey", "h.level", "h.rule")


_LEVEL = "CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END"


@query("WITH b AS (SELECT *, " + _LEVEL + " AS level FROM events), w AS (SELECT event_id, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER p AS span, " + ", ".join(f"last_value(CASE WHEN level <= {k} THEN level END IGNORE NULLS) OVER p AS l{k}, last_value(CASE WHEN level <= {k} THEN event_id END IGNORE NULLS) OVER p AS t{k}" for k in (1, 2, 3)) + " FROM b WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, span::INT AS span, concat_ws(' / ', " + ", ".join(f"CASE WHEN l{k} = {k} THEN t{k}::VARCHAR END" for k in (1, 2, 3)) + ") AS path FROM w")
def q_sections(spark, sf):
    b = table(spark, sf, "events").withColumn("level", F.expr(_LEVEL)).withColumn("title", F.col("event_id").cast("string")).withColumn("pos", F.struct("ts", "event_id"))
    return sections.section_paths(b, ["user_id"], "pos", 3).select("event_id", "span", F.array_join("path", " / ").alias("path"))


@query("SELECT p_brand, list_sort(list(p_size))[count(*) // 2 + 1]::DOUBLE AS body_font FROM part WHERE p_size > 0 GROUP BY p_brand")
def q_font_median(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("font_size"), F.lit("short").alias("text"))
    return sections.body_font(p, ["p_brand"])


def doc_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("tokens", tx.estimate_tokens(F.col("line")))


_DOCLINES = """docl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS pos FROM documents),
  tok AS (SELECT doc_id, pos, CASE WHEN length(line) = 0 THEN 0 ELSE trunc(length(line) / 4.0::DOUBLE + length(regexp_replace(line, '[^0-9,.%]', '', 'g')) * 0.35::DOUBLE)::INT + 1 END AS tokens FROM docl),
  pack AS (SELECT doc_id, pos, tokens, 0 AS chunk, tokens AS held FROM tok WHERE pos = 0 UNION ALL SELECT t.doc_id, t.pos, t.tokens, CASE WHEN p.held > 0 AND p.held + t.tokens > 400 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.held > 0 AND p.held + t.tokens > 400 THEN t.tokens ELSE p.held + t.tokens END FROM pack p JOIN tok t ON t.doc_id = p.doc_id AND t.pos = p.pos + 1)"""


@query("WITH RECURSIVE " + _DOCLINES + " SELECT doc_id, pos, chunk FROM pack")
def q_chunks(spark, sf):
    return sections.pack_chunks(doc_lines(spark, sf), "doc_id", "pos", "tokens", 400, 0)


@query("WITH RECURSIVE " + _DOCLINES + ", c AS (SELECT doc_id, chunk, sum(tokens) AS n FROM pack GROUP BY ALL) SELECT count(*) AS n_chunks, min(n)::BIGINT AS least, max(n)::BIGINT AS most, round(avg(n), 4) AS mean FROM c")
def q_chunk_stats(spark, sf):
    d = doc_lines(spark, sf)
    c = sections.pack_chunks(d, "doc_id", "pos", "tokens", 400, 0).join(d, ["doc_id", "pos"]).groupBy("doc_id", "chunk").agg(F.sum("tokens").alias("n"))
    return c.agg(F.count(F.lit(1)).alias("n_chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


@query("SELECT conv_id, turn, right(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), ''), 120) AS prefix FROM conversations")
def q_prefix_context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf, "conversations").withColumn("p", F.lag("text").over(w)).select("conv_id", "turn", F.expr("right(coalesce(p, ''), 120)").alias("prefix"))


# ---- terms


@query("SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS terms FROM (SELECT doc_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(regexp_extract_all(regexp_replace(text, '[^ -~]', '#', 'g'), '\\b[A-Z]{2,6}\\b'), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered FROM documents)")
def q_acronyms(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(glossary.acronyms(F.regexp_replace("text", "[^ -~]", "#")), "|").alias("terms"))


_EVENTS = "e AS (SELECT p_partkey AS seq, p_type AS source, lower(p_type) AS key, p_brand AS target, ['source_gloss', 'curated', 'seed', 'model'][(p_partkey % 4 + 1)::INT] AS authority, (p_partkey % 4 + 1)::INT AS rank, 1 + p_partkey % 3 AS frequency FROM part), win AS (SELECT key, arg_min(source, (rank, seq)) AS source, arg_min(target, (rank, seq)) AS target, arg_min(authority, (rank, seq)) AS authority, min(rank) AS rank FROM e GROUP BY key)"


def term_events(spark, sf):
    names = F.array(*[F.lit(a) for a in glossary.AUTHORITIES])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("source"), F.col("p_brand").alias("target"), names[(F.col("p_partkey") % 4).cast("int")].alias("authority"), (1 + F.col("p_partkey") % 3).alias("frequency"))


@query("WITH " + _EVENTS + " SELECT w.key, w.source, w.target, w.authority, sum(e.frequency)::BIGINT AS frequency FROM win w JOIN e ON e.key = w.key AND e.target = w.target GROUP BY ALL")
def q_glossary_merge(spark, sf):
    return glossary.merge(term_events(spark, sf))[0]


@query("WITH " + _EVENTS + " SELECT DISTINCT e.key, w.target AS kept, e.target AS dropped, CASE WHEN e.rank = w.rank THEN 'same authority, later' ELSE 'lower authority' END AS reason FROM win w JOIN e ON e.key = w.key AND e.target <> w.target")
def q_glossary_conflicts(spark, sf):
    return glossary.merge(term_events(spark, sf))[1]


_TERMS = "terms AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:2], ' ') AS key FROM benchmark)"
_NORMAL = "' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' '"


def terms(spark, sf):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf, "benchmark").select(F.array_join(F.slice(w, 1, 2), " ").alias("key")).distinct()


@query("WITH " + _TERMS + ", d AS (SELECT doc_id, " + _NORMAL + " AS t FROM documents) SELECT doc_id, key FROM d JOIN terms ON contains(d.t, ' ' || key || ' ')")
def q_glossary_hits(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return glossary.hits(d, terms(spark, sf), "text").select("doc_id", "key")


@query("WITH " + _TERMS + ", d AS (SELECT doc_id, " + _NORMAL + " AS t, text FROM documents) SELECT doc_id, key FROM d JOIN terms ON contains(d.t, ' ' || key || ' ') WHERE NOT contains(lower(text), right(key, 4))")
def q_term_violations(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.col("text").alias("target"))
    return glossary.violations(d, terms(spark, sf).withColumn("target_term", F.expr("right(key, 4)")), "text", "target").select("doc_id", "key")


_TOK = "list_concat(regexp_extract_all(lower(text), '[a-z][a-z0-9''.-]+'), regexp_extract_all(lower(text), '[0-9]+(?:\\.[0-9]+)?'))"


@query(f"""WITH p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS token FROM documents) GROUP BY ALL), q AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_TOK}) AS token FROM benchmark) GROUP BY ALL),
  n AS (SELECT count(DISTINCT doc_id) AS n FROM p), idf AS (SELECT token, ln((1 + max(n.n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM p, n GROUP BY token), dw AS (SELECT doc_id, token, tf * idf AS w FROM p JOIN idf USING (token)), qw AS (SELECT item_id, token, tf * coalesce(idf, 1.0) AS w FROM q LEFT JOIN idf USING (token)),
  dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY item_id), s AS (SELECT item_id, doc_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw USING (token) GROUP BY ALL),
  r AS (SELECT item_id, doc_id, round(dot / (dn.n * qn.n), 6) AS score FROM s JOIN dn USING (doc_id) JOIN qn USING (item_id)), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0) SELECT item_id, doc_id, score, rank FROM k WHERE rank <= 5""")
def q_tfidf_topk(spark, sf):
    d = retrieval.postings(table(spark, sf, "documents"), "doc_id", tx.tokenize(F.col("text")))
    q = retrieval.postings(table(spark, sf, "benchmark"), "item_id", tx.tokenize(F.col("text")))
    return retrieval.tfidf_search(d, q, "doc_id", "item_id").select("item_id", "doc_id", "score", "rank")


_VECTORS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 6) AS score FROM v, v q WHERE q.vec_id % 100 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 5"""


def vector_queries(vectors):
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(_VECTORS)
def q_vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieval.vector_search(e, vector_queries(e), "vec_id", "embedding", "query_id").select("query_id", "vec_id", "score", "rank")


@query(_VECTORS)
def q_vector_index(spark, sf):
    """The same through an inverted-file index, with a second round over the lists that may hold better vectors."""
    e = table(spark, sf, "embeddings")
    index, centroids = retrieval.vector_index(e, "vec_id", "embedding")
    return retrieval.index_search(writer(spark)(index), centroids, vector_queries(e), "vec_id", "query_id", exact=True).select("query_id", "vec_id", "score", "rank")


# ---- model payloads


@query("WITH " + _CELLS + " SELECT table_id, count(*) FILTER (col = 0) AS n_labels, count(*) FILTER (col > 0) AS n_numeric FROM cells GROUP BY table_id")
def q_payload_labels(spark, sf):
    return translate.payload(cells(spark, sf)).select("table_id", "n_labels", "n_numeric")


@query("SELECT 0::BIGINT AS n_leaks")
def q_leak_audit(spark, sf):
    c = cells(spark, sf)
    return translate.leaks(c, translate.payload(c)).agg(F.count(F.lit(1)).alias("n_leaks"))


@query("WITH " + _CELLS + " SELECT table_id, row, CASE WHEN row = 1 THEN 'first: ' || text ELSE text END AS target_text FROM cells WHERE col = 0")
def q_apply_translation(spark, sf):
    c = cells(spark, sf).where("col = 0")
    t = c.where("row <= 2").select("table_id", "row", F.when(F.col("row") == 1, F.concat(F.lit("first: "), "text")).otherwise(" ").alias("translated"))
    return translate.apply_translations(c, t, ["table_id", "row"]).select("table_id", "row", "target_text")


@query("""WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS t FROM orders), e AS (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR), o_orderkey)::INT AS fault FROM o WHERE regexp_matches(t, '[1-9]'))
  SELECT o_orderkey, t, regexp_replace(t, '[1-9]', translate(regexp_extract(t, '[1-9]'), '123456789', '234567891')) AS target_text, fault FROM e WHERE fault <= 25""")
def q_fault_budget(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", money("o_totalprice").alias("t"))
    return translate.corrupt(o, "o_orderkey", "t", 25).where("fault is not null").select("o_orderkey", "t", "target_text", "fault")


# ---- risk and review


@query("WITH " + _RISK + " SELECT table_id, risk, threshold, band FROM scored")
def q_risk_score(spark, sf):
    return scored(spark, sf).select("table_id", "risk", "threshold", "band")


@query("WITH " + _RISK + " SELECT band, count(*) AS n, max(risk) AS most FROM scored GROUP BY band")
def q_risk_bands(spark, sf):
    return scored(spark, sf).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("risk").alias("most"))


@query("WITH " + _RISK + ", f AS (SELECT 'number_drift' AS reason FROM parts WHERE f1 > 0 UNION ALL SELECT 'number_mismatch' FROM parts WHERE f2 > 0 UNION ALL SELECT 'number_structural' FROM parts WHERE f3 > 0) SELECT reason, count(*) AS n FROM f GROUP BY reason")
def q_findings_histogram(spark, sf):
    return scored(spark, sf).select(F.explode("reasons.name").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _RISK + " SELECT table_id, risk, band FROM scored ORDER BY risk DESC, table_id LIMIT 20")
def q_top_tables(spark, sf):
    """Top-k report: the 20 tables of the highest risk."""
    return scored(spark, sf).select("table_id", "risk", "band").orderBy(F.desc("risk"), "table_id").limit(20)


def queues(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("target_text"), F.round(F.col("o_orderkey") % 97 / F.lit(97.0), 2).alias("risk"))
    o = o.withColumn("item_id", review.item_id(F.col("chunk_id")))
    status = F.when(F.col("chunk_id") % 3 == 0, "approved").otherwise("pending")
    old = o.where("chunk_id % 10 <> 1").withColumn("status", status).withColumn("note", F.lit(""))
    new = o.where("chunk_id % 10 <> 2").withColumn("target_text", F.when(F.col("chunk_id") % 7 == 0, F.concat("target_text", F.lit("!"))).otherwise(F.col("target_text")))
    return old, new


_QUEUE = """o AS (SELECT o_orderkey AS k, 'rv-' || left(sha1(o_orderkey::VARCHAR), 10) AS item_id, round((o_orderkey % 97) / 97.0::DOUBLE, 2) AS risk, o_orderpriority AS t FROM orders),
  queue AS (SELECT item_id, k AS chunk_id, risk, CASE WHEN k % 7 = 0 AND k % 10 <> 2 THEN t || '!' ELSE t END AS target_text, CASE WHEN k % 10 <> 1 AND k % 3 = 0 AND (k % 7 <> 0 OR k % 10 = 2) THEN 'approved' ELSE 'pending' END AS status,
  CASE WHEN k % 10 <> 1 AND k % 10 <> 2 AND k % 7 = 0 AND k % 3 = 0 THEN printf('reopened on re-run: evidence changed (risk was %.2f, previously approved)', risk) ELSE '' END AS note FROM o)"""


@query("WITH " + _QUEUE + " SELECT item_id, chunk_id, risk, target_text, status, note FROM queue")
def q_review_upsert(spark, sf):
    return review.upsert(*queues(spark, sf))


@query("WITH " + _QUEUE + " SELECT s.status, count(q.item_id) AS n, max(q.risk) AS most FROM (VALUES ('pending'), ('approved'), ('rejected'), ('edited')) s(status) LEFT JOIN queue q ON q.status = s.status GROUP BY s.status")
def q_queue_stats(spark, sf):
    q = review.upsert(*queues(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("risk").alias("most"))
    return spark.createDataFrame([(s,) for s in review.STATUSES], "status string").join(q, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), "most")


@query("WITH " + _QUEUE + " SELECT item_id, chunk_id, status, printf('%.3f', risk) AS risk, '' AS band, '' AS financial, '' AS pages, '' AS section, '' AS reasons, '' AS reviewer, note, '' AS source_text, left(target_text, 500) AS target_text FROM queue")
def q_review_csv(spark, sf):
    return review.csv_rows(review.upsert(*queues(spark, sf)), include_text=True)


@query("SELECT user_id AS chunk_id, max(value) AS risk, arg_min(event_id, (-value, event_id)) AS ord FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id")
def q_dedupe_items(spark, sf):
    e = table(spark, sf, "events").where("value is not null and user_id is not null").select(F.col("user_id").alias("chunk_id"), F.col("value").alias("risk"), F.col("event_id").alias("ord"))
    return review.dedupe(e)


@query("SELECT date_trunc('month', ts)::DATE AS month, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("view", "signup", "error", "click", "purchase")) + " FROM events GROUP BY 1")
def q_chart_pivot(spark, sf):
    kinds = ["view", "signup", "error", "click", "purchase"]
    p = table(spark, sf, "events").withColumn("month", F.to_date(F.date_trunc("month", "ts"))).groupBy("month").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@query("SELECT user_id::VARCHAR AS item_id, arg_max(event_type, (ts, event_id::VARCHAR)) AS decision, arg_max(event_id, (ts, event_id::VARCHAR))::VARCHAR AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def s_review_stream(spark, sf):
    """The decision stream over the events: each user's latest decision as the stream's state ends."""
    root = shared_folder(spark) + "/stream-" + uuid.uuid4().hex
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf.rstrip('/')}/events.parquet*")
    decisions = stream.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("decision"), "ts", "event_id")
    # files are in no order of time: nothing is late
    changes = review_stream.latest_decisions(decisions, watermark="100 years")
    review_stream.decision_sink(changes, root + "/out", root + "/checkpoint").awaitTermination()
    return review_stream.decisions_of(spark, root + "/out").select("item_id", "decision", "event_id")


# ---- whole comparisons, tables with holes, terms in any script


_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_NEAR = f"(levenshtein({_DIGITS.format('p')}, {_DIGITS.format('q')}) <= 2 OR abs(q::DOUBLE - p::DOUBLE) / abs(p::DOUBLE) <= 0.02)"


@query(f"""WITH o AS (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS p FROM orders), x AS (SELECT k, p, CASE k % 7 WHEN 0 THEN translate(p, '15', '51') WHEN 1 THEN NULL ELSE p END AS q, (k % 7 = 2)::BIGINT AS more FROM o),
  c AS (SELECT *, coalesce(q = p, false)::BIGINT AS same, coalesce(q <> p AND {_NEAR}, false)::BIGINT AS near FROM x)
  SELECT k AS o_orderkey, same AS matched, near AS mismatched, 1 - same - near AS missing, CASE WHEN q IS NULL THEN 0 ELSE 1 - same - near END + more AS added, (1 - same)::DOUBLE AS drift, same = 1 AS ok FROM c""")
def q_text_check(spark, sf):
    """Every order's total in a sentence against a copy in which some are changed, lost or joined by another figure."""
    k, p = F.col("o_orderkey"), money("o_totalprice")
    said = F.when(k % 7 == 0, F.translate(p, "15", "51")).when(k % 7 == 1, "").otherwise(p)
    pairs = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("total of "), p).alias("s"), F.concat(F.lit("sum "), said, F.when(k % 7 == 2, " and 5 more").otherwise("")).alias("t"))
    return numdiff.report(numdiff.check_texts(pairs, ["o_orderkey"], "s", "t"), ["o_orderkey"], pairs).select("o_orderkey", "matched", "mismatched", "missing", "added", "drift", "ok")


@query("WITH " + _TARGET + f""", b AS (SELECT s.table_id, s.text AS p, t.text AS q FROM cells s JOIN target t ON s.table_id = t.table_id AND s.row = t.row AND s.col = t.col WHERE s.col > 0),
  c AS (SELECT table_id, (p = q)::BIGINT AS same, (p <> q AND {_NEAR})::BIGINT AS near FROM b), f AS (SELECT table_id, sum(same) AS matched, sum(near) AS mismatched, sum(1 - same - near) AS missing FROM c GROUP BY table_id),
  k AS (SELECT table_id, count(*) FILTER (table_id % 13 = 0 AND row = 1) AS structural FROM cells GROUP BY table_id)
  SELECT k.table_id, coalesce(matched, 0)::BIGINT AS matched, coalesce(mismatched, 0)::BIGINT AS mismatched, coalesce(missing, 0)::BIGINT AS missing, coalesce(missing, 0)::BIGINT AS added, structural::BIGINT AS structural FROM k LEFT JOIN f ON f.table_id = k.table_id""")
def q_table_pairs(spark, sf):
    """Every statement table against its flawed copy, figure by figure in each slot, and what slots are gone."""
    r = rows(spark, sf)
    shape = r.groupBy("table_id").agg((F.count(F.lit(1)) + 1).cast("int").alias("n_rows"), F.lit(5).alias("n_cols")).withColumn("units_note", F.lit(""))
    found = numdiff.check_row_pairs(r, target_rows(spark, sf), shape, shape, keep=writer(spark))
    return numdiff.report(found, ["table_id"], shape).select("table_id", "matched", "mismatched", "missing", "added", "structural")


_GAPS = _CELLS + ", g AS (SELECT * FROM cells WHERE (table_id + row * 5 + col) % 17 <> 0), shape AS (SELECT table_id, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols FROM g GROUP BY table_id)"


def cells_with_gaps(spark, sf):
    return cells(spark, sf).where("(table_id + row * 5 + col) % 17 <> 0")


@query("WITH " + _GAPS + """, r AS (SELECT table_id, n_cols, unnest(range(n_rows)) AS row FROM shape), s AS (SELECT table_id, row, unnest(range(n_cols)) AS col FROM r),
  l AS (SELECT s.table_id, s.row, string_agg(coalesce(g.text, ''), chr(9) ORDER BY s.col) AS line FROM s LEFT JOIN g ON g.table_id = s.table_id AND g.row = s.row AND g.col = s.col GROUP BY ALL) SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS rendered FROM l GROUP BY table_id""")
def q_tsv_holes(spark, sf):
    return tables.to_tsv(cells_with_gaps(spark, sf))


@query("WITH " + _GAPS + """, n AS (SELECT table_id, count(*) AS n, count(*) FILTER (row = 1 AND col = 1 AND table_id % 5 = 0) AS dup FROM g GROUP BY table_id)
  SELECT s.table_id, n_rows::INT AS n_rows, n_cols::INT AS n_cols, dup::INT AS n_conflicts, (n_rows * n_cols - n)::INT AS holes FROM shape s JOIN n ON n.table_id = s.table_id""")
def q_table_build(spark, sf):
    """Tables built from cells with stated places, some of them claimed twice and some by none."""
    raw = cells_with_gaps(spark, sf).withColumn("ord", F.expr("cast(row * 10 + col as int)"))
    raw = raw.union(raw.where("row = 1 and col = 1 and table_id % 5 = 0").withColumn("ord", F.col("ord") + 1000))
    built, _, _ = tables.build_tables(raw)
    gaps = F.regexp_extract(F.array_join("warnings", " "), r"grid has (\d+) uncovered", 1)
    return built.select("table_id", "n_rows", "n_cols", "n_conflicts", F.coalesce(F.nullif(gaps, F.lit("")).cast("int"), F.lit(0)).alias("holes"))


@query("WITH t AS (SELECT DISTINCT substr(text, 3, 9) AS name FROM benchmark WHERE length(text) > 12) SELECT doc_id, name AS source FROM documents JOIN t ON contains(lower(documents.text), lower(name))")
def q_terms_anywhere(spark, sf):
    """Terms (a piece of each benchmark text, words cut or not) that stand anywhere in a document, whatever the case."""
    names = table(spark, sf, "benchmark").where("length(text) > 12").select(F.substring("text", 3, 9).alias("source"), F.lit("x").alias("target")).distinct()
    return glossary.term_rows(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", names).select("doc_id", "source")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every statement table against its flawed copy, slot by slot, ranked by risk."""
    return q_top_tables(spark, sf_dir)


from ledgerlens.plans import document_rows  # noqa: E402, F401 (it registers its queries here)
