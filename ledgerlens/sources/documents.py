"""Whole documents in and out: recordings, structured documents, folders of page images, and settings."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators import documents, tables
from ledgerlens.sources import layout

CELL = "struct<text: string, row: int, col: int, row_span: int, col_span: int, is_header: boolean>"
BLOCK = f"struct<kind: string, text: string, caption: string, units_note: string, heading_level: int, font_size: double, bbox: array<double>, n_rows: int, n_cols: int, cells: array<{CELL}>, conflicts: array<struct<row: int, col: int, kept: string, dropped: string, reason: string>>, warnings: array<string>, chart_type: string, description: string, axis_labels: map<string, array<string>>, series: array<struct<name: string, label: string, points: map<string, string>, value: string>>, image_ref: string, alt_text: string>"
DOCUMENT = f"doc_id string, source string, parser_version string, pages array<struct<index: int, width: double, height: double, blocks: array<{BLOCK}>>>, metadata map<string, string>, warnings array<string>"
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff")


def read_document_json(spark: SparkSession, path: str) -> DataFrame:
    """Structured documents, one JSON object a file, as they are nested."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("doc_id", F.coalesce("doc_id", F.col("_metadata.file_name")))


def document_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(blocks, tables, cells, conflicts) of structured documents, in the forms that to_blocks and build_tables give."""
    pages = docs.select("doc_id", F.explode("pages").alias("p"))
    b = pages.select("doc_id", F.col("p.index").alias("page_index"), F.posexplode("p.blocks").alias("i", "b"))
    b = b.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "i")) - 1)
    is_table = F.col("b.kind") == "table"
    b = b.withColumn("table_id", F.when(is_table, F.concat_ws("/", "doc_id", "page_index", "i")))
    chart = F.struct(F.col("b.chart_type").alias("chart_type"), F.col("b.description").alias("description"), F.col("b.series").alias("series"), F.col("b.axis_labels").alias("axis_labels"))
    text = lambda c: F.coalesce(f"b.{c}", F.lit("")).alias(c)
    blocks = b.select("doc_id", "page_index", "pos", "table_id", F.coalesce("b.kind", F.lit("text")).alias("kind"), text("text"), text("caption"), text("units_note"), F.coalesce("b.font_size", F.lit(0.0)).alias("font_size"), "b.heading_level", chart.cast(layout.CHART).alias("chart"), F.col("b.bbox").alias("box"))
    t = b.where(is_table)
    cells = t.select("table_id", F.posexplode("b.cells").alias("ord", "c")).select(
        "table_id", "ord", "c.row", "c.col", F.greatest(F.coalesce("c.row_span", F.lit(1)), F.lit(1)).alias("row_span"), F.greatest(F.coalesce("c.col_span", F.lit(1)), F.lit(1)).alias("col_span"), F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.is_header", F.lit(False)).alias("is_header")
    )
    none = F.array().cast("array<double>")
    built = t.select("table_id", "b.n_rows", "b.n_cols", none.alias("row_lines"), none.alias("col_lines"), F.coalesce("b.warnings", F.array().cast("array<string>")).alias("warnings"), F.greatest(F.lit(0), F.coalesce(F.size("b.conflicts"), F.lit(0))).alias("n_conflicts"), text("caption"), text("units_note"))
    return blocks, built, cells, t.select("table_id", F.inline("b.conflicts"))


def to_documents(blocks: DataFrame, built: DataFrame, cells: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Structured documents (doc_id, pages), nested again; what is empty becomes null, which the writer leaves out."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    by = lambda df, *names: df.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*names))), lambda x: x).alias("x"))
    c = by(cells, "row", "col", "row_span", "col_span", "text", "is_header").withColumnRenamed("x", "cells")
    k = by(conflicts, "row", "col", "kept", "dropped", "reason").withColumnRenamed("x", "conflicts")
    t = built.select("table_id", "n_rows", "n_cols", F.nullif("warnings", F.array().cast("array<string>")).alias("warnings"), some("units_note").alias("note"))
    b = blocks.join(t, "table_id", "left").join(c, "table_id", "left").join(k, "table_id", "left")
    block = F.struct(
        "kind", some("text").alias("text"), some("caption").alias("caption"), F.coalesce("note", some("units_note")).alias("units_note"), "heading_level", F.when(F.col("font_size") > 0, F.col("font_size")).alias("font_size"), F.col("box").alias("bbox"),
        "n_rows", "n_cols", "cells", "conflicts", "warnings", F.nullif("chart.chart_type", F.lit("")).alias("chart_type"), F.nullif("chart.description", F.lit("")).alias("description"), F.col("chart.axis_labels").alias("axis_labels"), F.col("chart.series").alias("series"),
    )
    pages = b.groupBy("doc_id", "page_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(block).alias("j")))), lambda x: x["j"]).alias("bs"))
    page = F.concat(F.lit('{"index":'), F.col("page_index").cast("string"), F.lit(',"blocks":['), F.array_join("bs", ","), F.lit("]}"))
    texts = pages.select("doc_id", "page_index", page.alias("page"))
    whole = texts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "page"))), lambda x: x["page"]).alias("ps"))
    return whole.select("doc_id", F.concat(F.lit('{"doc_id":'), F.to_json(F.array("doc_id")).substr(F.lit(2), F.length(F.to_json(F.array("doc_id"))) - 2), F.lit(',"pages":['), F.array_join("ps", ","), F.lit("]}")).alias("json"))


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents (of to_documents) as JSON Lines, one for each document."""
    docs.select("json").write.mode("overwrite").text(path)


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path)


def record(regions: DataFrame, path: str) -> None:
    """Regions (of read_layouts) as recordings that read_layouts reads again, one JSON document for each doc_id, in folders by doc_id."""
    names = ["label", "text", "caption", "units_note", "font_size", "bbox", "cells", "chart"]
    pages = regions.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("pos", F.to_json(F.struct(*names)).alias("j")))).alias("rs"))
    page = F.concat(F.lit('{"page":'), F.col("page_index").cast("string"), F.lit(',"regions":['), F.array_join(F.transform("rs", lambda r: r["j"]), ","), F.lit("]}"))
    whole = pages.select("doc_id", "page_index", page.alias("page")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "page"))), lambda x: x["page"]), ",").alias("ps"))
    whole.select("doc_id", F.concat(F.lit('{"pages":['), "ps", F.lit("]}")).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def looks_structured(spark: SparkSession, path: str) -> bool:
    """Whether the first file's pages hold blocks (a structured document) rather than regions (a recording)."""
    first = spark.read.option("multiLine", True).schema("pages array<struct<blocks: array<string>, regions: array<string>>>").json(path).select(F.explode_outer("pages").alias("p")).select("p.*").first()
    return bool(first and first["blocks"] is not None)


def read_any(spark: SparkSession, path: str, trust_hints: bool = False) -> dict[str, DataFrame]:
    """blocks, tables, cells, conflicts and pages of whatever the path holds: JSON (recordings or structured documents), page images or a folder of them.

    A local path that does not exist, and a file of another kind, are errors.
    """
    if "://" not in path and not any(c in path for c in "*?[{") and not Path(path).exists():
        raise FileNotFoundError(path)
    if path.endswith((".json", ".jsonl")):
        if looks_structured(spark, path):
            blocks, built, cells, conflicts = document_parts(read_document_json(spark, path))
        else:
            regions = layout.read_layouts(spark, path)
            built, cells, conflicts = documents.layout_tables(regions, trust_hints)
            blocks = documents.to_blocks(regions)
        return {"blocks": blocks, "tables": built, "cells": cells, "conflicts": conflicts}
    return {"pages": load_pages(spark, path)}


def load_pages(spark: SparkSession, path: str, first_page: int = 0, max_pages: int | None = None) -> DataFrame:
    """Pages (doc_id, page_index, path, mime, length, width, height, text_layer, image) of an image, a folder of images (in the order of their names) or a PDF.

    doc_id is the folder's name; first_page and max_pages limit each document's pages.
    """
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix == "pdf":
        return rasterise(spark, path, first_page, max_pages)
    if suffix and suffix not in IMAGES:
        raise ValueError(f"no reader for .{suffix}; known: pdf, {', '.join(IMAGES)} and folders of them")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join([*IMAGES, *(i.upper() for i in IMAGES)]) + "}").load(path)
    sizes = layout.read_images(spark, path).select("path", "width", "height")
    pages = files.join(sizes, "path").withColumn("doc_id", F.element_at(F.split("path", "/"), -2))
    pages = pages.withColumn("page_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1)
    pages = pages.where(F.col("page_index") >= first_page)
    if max_pages is not None:
        pages = pages.where(F.col("page_index") < first_page + max_pages)
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    mime = F.concat(F.lit("image/"), F.when(kind == "jpg", "jpeg").when(kind == "tif", "tiff").otherwise(kind))
    return pages.select("doc_id", "page_index", "path", mime.alias("mime"), "length", "width", "height", F.lit("").alias("text_layer"), F.col("content").alias("image"))


def rasterise(spark: SparkSession, path: str, first_page: int = 0, max_pages: int | None = None, dpi: int = 180) -> DataFrame:
    """Pages of PDF files as PNG with their text layer, each file in its task; the PyMuPDF library must be there on driver and executors."""
    import fitz  # noqa: F401

    def run(batches):
        import fitz
        import pandas as pd

        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                with fitz.open(stream=bytes(data), filetype="pdf") as pdf:
                    for i in range(first_page, len(pdf) if max_pages is None else min(len(pdf), first_page + max_pages)):
                        shot = pdf[i].get_pixmap(dpi=dpi)
                        image = shot.tobytes("png")
                        yield pd.DataFrame([(name.rsplit("/", 1)[-1], i + 1, name, "image/png", len(image), shot.width, shot.height, pdf[i].get_text(), image)], columns=["doc_id", "page_index", "path", "mime", "length", "width", "height", "text_layer", "image"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, "doc_id string, page_index int, path string, mime string, length bigint, width int, height int, text_layer string, image binary")


def page_stats(pages: DataFrame) -> DataFrame:
    """One row for each document: pages, with_image, with_text_layer."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.length("image") > 0).alias("with_image"), F.count_if(F.length("text_layer") > 0).alias("with_text_layer"))


def page_batches(pages: DataFrame, size: int) -> DataFrame:
    """pages with `batch`: each document's pages in batches of `size`."""
    return pages.withColumn("batch", F.expr(f"cast((row_number() over (partition by doc_id order by page_index) - 1) div {int(size)} as int)"))


#: A page of a made-up statement, for trials without any input.
DEMO_TABLE = [("Item", "2023", "2022"), ("Revenue", "1,234,567", "1,100,000"), ("Cost of sales", "(812,345)", "(745,120)"), ("Gross profit", "422,222", "354,880")]


def demo_regions(spark: SparkSession) -> DataFrame:
    """Regions of one made-up page: a heading, a paragraph, a statement with a merged head, and a chart."""
    cells = [{"text": t, "bbox": [120.0 * c, 40.0 * r, 120.0 * (c + 1), 40.0 * (r + 1)]} for r, row in enumerate(DEMO_TABLE, 1) for c, t in enumerate(row)]
    cells.insert(0, {"text": "RMB'000", "bbox": [0.0, 0.0, 360.0, 40.0]})
    series = [{"name": n, "points": p} for n, p in (("Revenue", {"2022": "1100", "2023": "1234.567"}), ("Profit", {"2022": "354.88"}))]
    rows = [
        ("demo", 1, 0, "title", "Financial Summary", "", "", 18.0, [0.0, 0.0, 400.0, 20.0], None, None),
        ("demo", 1, 1, "text", "Revenue rose by 12.2% to RMB 1,234,567 thousand in the year ended 31 December 2023.", "", "", 10.0, [0.0, 30.0, 400.0, 60.0], None, None),
        ("demo", 1, 2, "table", "", "Statement", "RMB'000", 0.0, [0.0, 70.0, 400.0, 300.0], cells, None),
        ("demo", 1, 3, "chart", "", "Revenue and profit", "", 0.0, [0.0, 310.0, 400.0, 500.0], None, {"chart_type": "bar", "description": "Revenue grew to 1,234.567 million.", "series": series}),
    ]
    kinds = f"doc_id string, page_index int, pos int, label string, text string, caption string, units_note string, font_size double, bbox array<double>, cells array<{layout.CELL}>, chart {layout.CHART}"
    return spark.createDataFrame(rows, kinds)


def fixture(spark: SparkSession, source=None) -> DataFrame:
    """Regions of a trial: the made-up page without a source, a recording's path, or a DataFrame of regions as it is."""
    if source is None:
        return demo_regions(spark)
    return source if isinstance(source, DataFrame) else layout.read_layouts(spark, str(source))


def inside(root: str | Path, name: str) -> Path:
    """A file of a folder by name; a name that leads out of the folder, or to no file, is an error."""
    found, base = (Path(root) / name).resolve(), Path(root).resolve()
    if base not in found.parents or not found.is_file():
        raise ValueError(f"no such fixture: {name}")
    return found


def settings(path: str | Path) -> dict[str, str]:
    """KEY=VALUE lines of a file put into the environment, where a key is not set yet; what was put there."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            key, value = (p.strip() for p in line.split("=", 1))
            if key and key not in os.environ:
                os.environ[key] = out[key] = value.strip("\"'")
    return out


def parse(regions: DataFrame, trust_hints: bool = False) -> dict[str, DataFrame]:
    """blocks (with their text rendered), tables, cells and conflicts of regions."""
    built, cells, conflicts = documents.layout_tables(regions, trust_hints)
    blocks = documents.block_text(documents.to_blocks(regions), cells, built)
    return {"blocks": blocks, "tables": built, "cells": cells, "conflicts": conflicts}


def table_html(cells: DataFrame, built: DataFrame) -> DataFrame:
    """(table_id, rendered): HTML of built tables with their captions, header rows as flagged or inferred."""
    return tables.to_html(cells, tables.header_rows(cells), captions=built)
