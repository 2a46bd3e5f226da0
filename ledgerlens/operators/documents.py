"""Documents: layout regions to typed blocks, their text, statistics and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import format_number, is_footnote, normalize_whitespace
from ledgerlens.operators import tables

#: Names of regions by kind, in the order in which they are looked for within other names.
REGION_NAMES = {
    "table": "table", "表格": "table", "table_body": "table", "text": "text", "paragraph": "text", "正文": "text", "title": "text", "section_header": "text", "heading": "text", "list": "text", "caption": "text", "footnote": "text",
    "chart": "chart", "figure": "chart", "图表": "chart", "plot": "chart", "diagram": "chart", "image": "image", "picture": "image", "photo": "image", "图片": "image", "logo": "image", "stamp": "image",
}


def kind_of(label: Column) -> Column:
    """Kind of a region (text, table, chart, image) by its name, or by the first known name within it; text without one."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    kinds = F.create_map(*[F.lit(x) for pair in REGION_NAMES.items() for x in pair])
    within = F.get(F.filter(F.array(*[F.lit(n) for n in REGION_NAMES]), lambda n: F.contains(low, n)), F.lit(0))
    return F.coalesce(F.try_element_at(kinds, low), F.try_element_at(kinds, within), F.lit("text"))


# ---- boxes: structs of x0, y0, x1, y1 on one page


def box_contains(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    return (a["x0"] - tolerance <= b["x0"]) & (a["y0"] - tolerance <= b["y0"]) & (a["x1"] + tolerance >= b["x1"]) & (a["y1"] + tolerance >= b["y1"])


def box_area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a["x1"] - a["x0"]) * F.greatest(F.lit(0.0), a["y1"] - a["y0"])


def box_meet(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")


def box_iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; zero where both are empty."""
    joint = box_area(a) + box_area(b) - box_meet(a, b)
    return F.when(joint > 0, box_meet(a, b) / joint).otherwise(F.lit(0.0))


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def box_of(value: Column) -> Column:
    """Box from a JSON string in any of its forms: a list of four, or an object of x0.., left.., x/y/w/h or width/height, or one within bbox or bbox_2d; null for others."""
    num = lambda path: F.get_json_object(value, path).cast("double")
    forms = []
    for at in ("$", "$.bbox", "$.bbox_2d"):
        forms.append([num(f"{at}[{i}]") for i in range(4)])
        forms += [[num(f"{at}.{n}") for n in names] for names in (("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"))]
        x, y = num(f"{at}.x"), num(f"{at}.y")
        forms.append([x, y, x + F.coalesce(num(f"{at}.w"), num(f"{at}.width")), y + F.coalesce(num(f"{at}.h"), num(f"{at}.height"))])
    struct = lambda f: F.when(f[0].isNotNull() & f[1].isNotNull() & f[2].isNotNull() & f[3].isNotNull(), F.struct(*[c.alias(n) for c, n in zip(f, ("x0", "y0", "x1", "y1"), strict=True)]))
    return F.coalesce(*[struct(f) for f in forms])


# ---- regions to blocks


def to_blocks(regions: DataFrame) -> DataFrame:
    """Blocks of read_layouts' regions in reading order: doc_id, page_index, pos, table_id, kind, text, caption, units_note, font_size, heading_level, chart, box.

    Within a page regions are ordered by bands of their upper edge, then left edge, then as they came; those without a box last. A table region
    without cells becomes its text, or caption; texts that are blank are left out. pos numbers a document's blocks over all pages from 0.
    """
    r = regions.withColumn("kind", kind_of(F.col("label"))).withColumn("box", F.when(F.size("bbox") == 4, F.col("bbox")))
    r = r.withColumn("kind", F.when((F.col("kind") == "table") & (F.coalesce(F.size("cells"), F.lit(0)) <= 0), "text").otherwise(F.col("kind")))
    is_table = kind_of(F.col("label")) == "table"
    said = F.coalesce(F.when(is_table, F.coalesce(F.nullif("text", F.lit("")), "caption")).otherwise(F.col("text")), F.lit(""))
    r = r.withColumn("text", F.when(F.col("kind") == "text", normalize_whitespace(said, True)).otherwise(""))
    r = r.where("kind <> 'text' or text <> '' ")
    y, x = F.when(F.col("box").isNull(), float("inf")).otherwise(F.bround(F.col("box")[1] / 6.0)), F.when(F.col("box").isNull(), float("inf")).otherwise(F.col("box")[0])
    order = Window.partitionBy("doc_id").orderBy("page_index", y, x, "pos")
    return r.select(
        "doc_id", "page_index", (F.row_number().over(order) - 1).alias("pos"), F.when(F.col("kind") == "table", F.concat_ws("/", "doc_id", "page_index", "pos")).alias("table_id"), "kind", "text",
        F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("units_note", F.lit("")).alias("units_note"), F.coalesce("font_size", F.lit(0.0)).alias("font_size"), F.lit(None).cast("int").alias("heading_level"), "chart", "box",
    )


def layout_tables(regions: DataFrame, trust_hints: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, cells, conflicts) of the table regions, built from their cells' boxes or hints; table_id is that of to_blocks."""
    t = regions.where((kind_of(F.col("label")) == "table") & (F.size("cells") > 0)).withColumn("table_id", F.concat_ws("/", "doc_id", "page_index", "pos"))
    c = t.select("table_id", F.posexplode("cells").alias("ord", "c"))
    corner = lambda i: F.when(F.size("c.bbox") == 4, F.col("c.bbox")[i])
    raw = c.select(
        "table_id", "ord", F.coalesce("c.text", F.lit("")).alias("text"), *[corner(i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.coalesce("c.row", F.lit(-1)).alias("row"), F.coalesce("c.col", F.lit(-1)).alias("col"),
        F.coalesce("c.row_span", "c.rowspan", F.lit(1)).alias("row_span"), F.coalesce("c.col_span", "c.colspan", F.lit(1)).alias("col_span"), F.coalesce("c.is_header", F.lit(False)).alias("is_header"),
    )
    return tables.build_tables(raw, t.select("table_id", "caption", "units_note"), trust_hints=trust_hints)


def perturb(regions: DataFrame, jitter: float = 0.0, drop_cells: float = 0.0, shuffle: bool = False, seed: int = 7) -> DataFrame:
    """Regions as a worse perception would give them: boxes of cells moved by up to `jitter` (then without hints), a share of cells missing, regions in another order.

    All by hashes of seed and place: alike in every run and for any partitioning.
    """
    key = F.concat_ws("/", F.lit(str(seed)), "doc_id", "page_index", "pos")
    unit = lambda *more: F.pmod(F.xxhash64(key, *more), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def moved(c: Column, i: Column) -> Column:
        shake = F.transform(c["bbox"], lambda v, k: v + (unit(i, k) * 2 - 1) * jitter)
        out = c.withField("bbox", F.when(F.size(c["bbox"]) == 4, shake).otherwise(c["bbox"]))
        none = F.lit(None).cast("int")
        for name in ("row", "col", "row_span", "col_span", "rowspan", "colspan"):
            out = out.withField(name, F.when(F.size(c["bbox"]) == 4, none).otherwise(c[name]))
        return out

    cells = F.col("cells")
    if drop_cells:
        cells = F.filter(cells, lambda c, i: unit(i, F.lit("drop")) >= drop_cells)
    if jitter:
        cells = F.transform(cells, moved)
    out = regions.withColumn("cells", cells)
    if shuffle:
        w = Window.partitionBy("doc_id", "page_index").orderBy(unit(F.lit("order")), "pos")
        out = out.withColumn("pos", F.row_number().over(w) - 1)
    return out


def pages_with_layouts(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """Pages (doc_id, page_index, ...) left-joined to layouts on the page's index, else on its place among the document's pages."""
    w = Window.partitionBy("doc_id").orderBy("page_index")
    p = pages.withColumn("__n", F.row_number().over(w))
    found = layouts.select("doc_id", "page_index").distinct()
    l_ = found.withColumn("__n", F.row_number().over(w))
    exact = p.join(l_.select("doc_id", "page_index", F.col("page_index").alias("exact")), ["doc_id", "page_index"], "left")
    placed = exact.join(l_.select("doc_id", "__n", F.col("page_index").alias("placed")), ["doc_id", "__n"], "left")
    return placed.withColumn("layout_page", F.coalesce("exact", "placed")).drop("__n", "exact", "placed")


# ---- text, statistics, Markdown


def block_text(blocks: DataFrame, cells: DataFrame, notes: DataFrame) -> DataFrame:
    """blocks with `rendered`: headings with #, tables with caption, note and grid, charts and images with their marks."""
    grids = tables.to_markdown(cells).withColumnRenamed("rendered", "__grid")
    notes = notes.select("table_id", F.col("units_note").alias("__note"))
    b = blocks.join(grids, "table_id", "left").join(notes, "table_id", "left")
    note = F.coalesce(F.nullif("__note", F.lit("")), F.nullif("units_note", F.lit("")))
    mark = F.when(F.col("heading_level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), "heading_level")), F.lit(" "))).otherwise("")
    captioned = lambda m: F.trim(F.concat(F.lit(m), F.lit(" "), "caption"))
    table = F.concat_ws("\n", F.when(F.col("caption") != "", F.concat(F.lit("[TABLE] "), "caption")), note, F.coalesce("__grid", F.lit("")))
    chart = F.concat_ws("\n", captioned("[CHART]"), F.nullif("chart.description", F.lit("")))
    text = F.when(F.col("kind") == "text", F.concat(mark, "text")).when(F.col("kind") == "table", table).when(F.col("kind") == "chart", chart).otherwise(captioned("[IMAGE]"))
    return b.withColumn("rendered", text).withColumn("units_note", F.coalesce(note, F.lit(""))).drop("__grid", "__note")


def document_stats(blocks: DataFrame, cells: DataFrame, built: DataFrame) -> DataFrame:
    """One row for each document: pages, blocks and each kind's number, footnotes, chars, cells, merged cells, conflicts, warnings, holes, unit notes, charts without data."""
    of = blocks.where("table_id is not null").select("doc_id", "table_id")
    per = cells.groupBy("table_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.expr("row_span > 1 or col_span > 1")).alias("merged_cells"))
    gaps = tables.holes(cells).groupBy("table_id").agg(F.count(F.lit(1)).alias("holes"))
    t = of.join(built.select("table_id", "n_conflicts", F.size("warnings").alias("w"), F.nullif("units_note", F.lit("")).alias("note")), "table_id", "left").join(per, "table_id", "left").join(gaps, "table_id", "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    t = t.groupBy("doc_id").agg(total("cells", "cells"), total("merged_cells", "merged_cells"), total("n_conflicts", "merge_conflicts"), total("w", "table_warnings"), total("holes", "holes"), F.array_sort(F.collect_set("note")).alias("unit_notes"))
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("text", "table", "chart", "image")]
    unresolved = F.count_if(F.expr("kind = 'chart' and coalesce(size(chart.series), 0) <= 0"))
    b = blocks.groupBy("doc_id").agg(F.count_distinct("page_index").alias("pages"), F.count(F.lit(1)).alias("blocks"), *kinds, F.count_if(is_footnote(F.col("text"))).alias("footnotes"), F.sum(F.length("text")).alias("chars"), unresolved.alias("charts_unresolved"))
    return b.join(t, "doc_id", "left").na.fill(0, ["cells", "merged_cells", "merge_conflicts", "table_warnings", "holes"])


def parse_stats(regions: DataFrame) -> DataFrame:
    """One row for each document: pages, regions, cells that perception gave, and pages of a degraded analysis (column analyzer, if there is one)."""
    degraded = F.contains("analyzer", F.lit("degraded")) if "analyzer" in regions.columns else F.lit(False)
    return regions.groupBy("doc_id").agg(
        F.count_distinct("page_index").alias("pages"), F.count(F.lit(1)).alias("regions"), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("cells"), F.lit(0)))).alias("raw_cells"), F.count_distinct(F.when(degraded, F.col("page_index"))).alias("degraded_pages")
    )


#: What an axis tick is: a number as printed.
TICK = r"^[-+]?[$€£¥]?\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*%?$"


def chart_narrative(blocks: DataFrame, points: DataFrame, most: int = 40) -> DataFrame:
    """(doc_id, pos, narrative) of the charts: caption, description, and a grid of category by series (the first `most` categories; a dash where there is none).

    points: doc_id, pos, series, category, value, ord (order of appearance). A chart without points says that its data could not be taken.
    """
    keys = ["doc_id", "pos"]
    p = points.withColumn("category", F.coalesce("category", F.lit("")))
    last = p.groupBy(*keys, "category", "series").agg(F.max_by("value", "ord").alias("value"))
    rank = lambda c: p.groupBy(*keys, c).agg(F.min("ord").alias("o")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", c))), lambda x: x[c]).alias(f"all_{c}"))
    cells = last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "category", "series"), format_number(F.col("value"))))).alias("cells"))
    grid = cells.join(rank("category"), keys).join(rank("series"), keys)
    line = lambda first, rest: F.concat(F.lit("| "), F.array_join(F.concat(F.array(first), rest), " | "), F.lit(" |"))
    body = F.transform(F.slice("all_category", 1, most), lambda c: line(c, F.transform("all_series", lambda s: F.coalesce(F.try_element_at("cells", F.concat_ws("\x1f", c, s)), F.lit("-")))))
    rule = F.transform("all_series", lambda s: F.lit("---"))
    grid = grid.withColumn("grid", F.array_join(F.concat(F.array(line(F.lit(""), F.col("all_series")), line(F.lit("---"), rule)), body), "\n")).select(*keys, "grid")
    charts = blocks.where("kind = 'chart'").join(grid, keys, "left")
    said = F.nullif(F.coalesce("chart.description", F.lit("")), F.lit(""))
    title = F.when(F.col("caption") != "", F.concat(F.lit("**"), "caption", F.lit("**")))
    return charts.select(*keys, F.concat_ws("\n\n", title, said, F.coalesce("grid", F.lit("[chart data could not be extracted; see review queue]"))).alias("narrative"))


def numeric_ticks(labels: Column) -> Column:
    """Of an axis' labels those that are numbers; they are never translated."""
    return F.filter(labels, lambda v: F.trim(v).rlike(TICK))


def chart_labels(charts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label): names of series, categories and axis labels of charts (column chart, as layout.CHART), each once; figures on axes are none."""
    series = F.transform("chart.series", lambda s: F.concat(F.array(s["name"]), F.coalesce(F.map_keys(s["points"]), F.array().cast("array<string>"))))
    axes = F.flatten(F.map_values("chart.axis_labels"))
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce(F.flatten(series), none), F.coalesce(axes, none)))
    return charts.select(*keys, F.explode(F.filter(every, lambda v: v.isNotNull() & (F.trim(v) != "") & ~F.trim(v).rlike(TICK))).alias("label"))


def translate_chart_labels(charts: DataFrame, keys: list[str], translations: DataFrame) -> DataFrame:
    """charts with the labels of their series, categories and axes in the target language, in place; values and figures on axes stay.

    translations: (label, translation), and any of `keys` where they hold for some charts alone. The labels of all charts meet them by one join; a chart's own (few) are brought back as a map. Of two categories
    that one translation names, the value of the later stands. Labels without a translation stay; so does a chart without any.
    """
    scope = [k for k in keys if k in translations.columns]
    first = translations.where("label is not null and translation is not null").groupBy(*scope, "label").agg(F.min("translation").alias("translation"))
    said = chart_labels(charts, keys).join(first, [*scope, "label"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "translation"))).alias("__said"))
    out = charts.join(said, keys, "left")
    to = lambda v: F.coalesce(F.try_element_at("__said", v), v)

    def points(p: Column) -> Column:
        entries = F.transform(F.map_entries(p), lambda e: F.struct(to(e["key"]).alias("key"), e["value"].alias("value")))
        names = F.transform(entries, lambda e: e["key"])
        last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
        return F.map_from_entries(last)

    series = F.transform("chart.series", lambda s: s.withField("name", to(s["name"])).withField("points", F.when(s["points"].isNotNull(), points(s["points"]))))
    axes = F.transform_values("chart.axis_labels", lambda _, labels: F.transform(labels, to))
    chart = F.col("chart").withField("series", series).withField("axis_labels", axes)
    return out.withColumn("chart", F.when(F.col("__said").isNull(), F.col("chart")).otherwise(chart)).drop("__said")


def document_markdown(rendered: DataFrame) -> DataFrame:
    """(doc_id, markdown) of blocks with `rendered`: a comment at each page's begin, then its blocks in order."""
    first = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("pos")) == 1
    part = F.concat(F.when(first, F.format_string("<!-- page %d -->\n\n", "page_index")).otherwise(""), "rendered")
    parts = rendered.select("doc_id", "pos", part.alias("part"))
    return parts.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n\n"), F.lit("\n")).alias("markdown"))
