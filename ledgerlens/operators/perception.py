"""Perception behind one interface: what makes layout regions of pages, by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import documents, models
from ledgerlens.sources import html_tables, layout

REGIONS = f"doc_id string, page_index int, pos int, label string, text string, caption string, units_note string, font_size double, bbox array<double>, cells array<{layout.CELL}>, chart {layout.CHART}, analyzer string"
REPLY = f"struct<regions: array<{layout.REGION}>>"
TASK = "Find the regions of the page. Reply with JSON: regions, a list of label (text, table, chart, image), bbox, text, caption, units_note, cells (text, bbox) and chart. Copy every figure as printed."
#: name -> function of pages (as load_pages gives them) and options that makes regions.
ANALYZERS: dict[str, Callable[..., DataFrame]] = {}
ALIASES = {"fixture": "mock", "replay": "mock", "vl": "vlm", "vision": "vlm", "paddle": "ocr"}


def register(name: str):
    """Decorator that makes an analyzer known by name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ANALYZERS[name] = f
        return f

    return add


def analyze(pages: DataFrame, name: str = "mock", **options) -> DataFrame:
    """Regions of pages by the analyzer of that name or alias; an unknown name is an error."""
    found = ANALYZERS.get(ALIASES.get(name, name))
    if found is None:
        raise ValueError(f"unknown analyzer {name!r}; known: {', '.join(sorted({*ANALYZERS, *ALIASES}))}")
    return found(pages, **options)


@register("mock")
def replay(pages: DataFrame, recording: DataFrame, **noise) -> DataFrame:
    """Regions of a recording for each page, by page index or else by place; noise as in documents.perturb."""
    placed = documents.pages_with_layouts(pages.select("doc_id", "page_index"), recording.select("doc_id", "page_index")).select("doc_id", "page_index", "layout_page")
    rows = recording.withColumnRenamed("page_index", "layout_page").join(placed, ["doc_id", "layout_page"]).drop("layout_page")
    return documents.perturb(rows, **noise) if noise else rows


def page_prompt(digest: str, text_layer: str) -> str:
    """What is asked of a page: what came before (up to 1,200 characters) and the text layer (up to 3,000), which beats any reading of the image."""
    parts = [f"PREVIOUS PAGES:\n{digest[-1200:]}" if digest else "", f"TEXT LAYER:\n{text_layer[:3000]}" if text_layer else "", "Describe the regions of this page."]
    return "\n\n".join(p for p in parts if p)


@register("vlm")
def vision(pages: DataFrame, model, retries: int = 2, remember: int = 6) -> DataFrame:
    """Regions by a vision model, page after page of a document, since each prompt tells what the `remember` pages before held.

    A reply that is no JSON is asked for again; regions without a box are left out; a page that fails for good is its text layer as one region, marked degraded.
    """

    def run(doc: pd.DataFrame) -> pd.DataFrame:
        out, digest = [], []
        for page in doc.sort_values("page_index").itertuples():
            image = bytes(page.image) if page.image is not None else None
            prompt, reply = page_prompt("\n".join(digest[-remember:]), page.text_layer or ""), None
            for _ in range(retries + 1):
                try:
                    reply = html_tables.reply_json(model.complete(TASK, prompt, image))
                except models.ModelError:
                    reply = None
                if reply is not None:
                    break
            out.append((page.doc_id, page.page_index, reply, page.text_layer or ""))
            digest.append(f"page {page.page_index}: {(reply or '')[:160]}")
        return pd.DataFrame(out, columns=["doc_id", "page_index", "reply", "text_layer"])

    said = pages.select("doc_id", "page_index", "image", "text_layer").groupBy("doc_id").applyInPandas(run, "doc_id string, page_index int, reply string, text_layer string")
    return regions_of(said)


def regions_of(said: DataFrame) -> DataFrame:
    """Regions of replies (doc_id, page_index, reply, text_layer); without a usable reply the text layer, as one degraded region."""
    parsed = said.withColumn("p", F.from_json("reply", REPLY))
    good = F.coalesce(F.size("p.regions"), F.lit(-1)) >= 0
    r = parsed.where(good).select("doc_id", "page_index", F.posexplode("p.regions").alias("pos", "r")).where("size(r.bbox) = 4")
    whole = r.select(
        "doc_id", "page_index", "pos", F.coalesce("r.label", "r.type").alias("label"), F.coalesce("r.text", "r.content").alias("text"), "r.caption", F.coalesce("r.units_note", "r.units").alias("units_note"), "r.font_size", "r.bbox", "r.cells", "r.chart", F.lit("vlm").alias("analyzer")
    )
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema}
    degraded = parsed.where(~good | F.col("p").isNull()).where("text_layer <> ''")
    told = {"doc_id": F.col("doc_id"), "page_index": F.col("page_index"), "pos": F.lit(0).alias("pos"), "label": F.lit("text").alias("label"), "text": F.col("text_layer").alias("text"), "analyzer": F.lit("degraded").alias("analyzer")}
    return whole.unionByName(degraded.select(*[told.get(n, c) for n, c in none.items()]))


@register("ocr")
def ocr_regions(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Regions of what an OCR engine gave (doc_id, page_index, pos, label, box JSON, lines array, html of a table); an engine itself is not part of this library.

    Boxes may have any of their forms; tables come as HTML; a chart's data is not read, so that it counts as unresolved.
    """
    at = ["doc_id", "page_index", "pos"]
    key = F.to_json(F.struct(*at))
    i = items.join(pages.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"]).withColumn("__k", key)
    found = html_tables.html_cells(i.where("html is not null"), "__k", "html")
    cell = F.struct("text", F.lit(None).cast("array<double>").alias("bbox"), "row", "col", "row_span", "col_span", F.lit(None).cast("int").alias("rowspan"), F.lit(None).cast("int").alias("colspan"), "is_header")
    per = found.groupBy("__k").agg(F.collect_list(cell).cast(f"array<{layout.CELL}>").alias("cells"))
    box = documents.box_of(F.col("box"))
    bbox = F.when(box.isNotNull(), F.array(box["x0"], box["y0"], box["x1"], box["y1"]))
    return i.join(per, "__k", "left").select(
        *at, "label", F.array_join(F.filter("lines", lambda x: F.trim(x) != ""), "\n").alias("text"), F.lit("").alias("caption"), F.lit("").alias("units_note"), F.lit(0.0).alias("font_size"), bbox.alias("bbox"), "cells", F.lit(None).cast(layout.CHART).alias("chart"), F.lit("ocr").alias("analyzer")
    )


CHART_TASK = "Read the data of the chart. Reply with JSON: chart_type, description, series (name, points) and confidence."


def read_charts(regions: DataFrame, pages: DataFrame, model, least: float = 0.5) -> DataFrame:
    """regions with the data of their charts read by a model where they have none yet and the page has an image; `chart_warning` tells of low confidence and of failures."""
    chart = documents.kind_of(F.col("label")) == "chart"
    empty = F.coalesce(F.size("chart.series"), F.lit(-1)) <= 0
    asked = regions.where(chart & empty).join(pages.select("doc_id", "page_index", "image").where("image is not null"), ["doc_id", "page_index"]).select("doc_id", "page_index", "pos", F.coalesce("caption", F.lit("")).alias("caption"), "bbox", "image")

    def run(batches):
        for batch in batches:
            replies = []
            for caption, box, image in zip(batch["caption"], batch["bbox"], batch["image"], strict=True):
                try:
                    replies.append(html_tables.reply_json(model.complete(CHART_TASK, f"Caption: {caption}", crop(bytes(image), None if box is None else list(box)))))
                except models.ModelError:
                    replies.append(None)
            yield batch[["doc_id", "page_index", "pos"]].assign(reply=replies)

    kinds = dict(regions.dtypes)
    said = asked.mapInPandas(run, f"doc_id {kinds['doc_id']}, page_index int, pos int, reply string")
    read = said.withColumn("c", F.from_json("reply", layout.CHART)).withColumn("confidence", F.get_json_object("reply", "$.confidence").cast("double")).select("doc_id", "page_index", "pos", "c", "confidence")
    out = regions.join(read, ["doc_id", "page_index", "pos"], "left")
    warning = F.when(chart & empty & F.col("c").isNull(), "chart data could not be read").when(F.col("confidence") < least, F.format_string("low confidence %.2f", "confidence"))
    return out.withColumn("chart_warning", warning).withColumn("chart", F.coalesce("c", "chart")).drop("c", "confidence")


def crop(image: bytes, box: list[float] | None, margin: float = 8.0) -> bytes:
    """The part of an image within a box and a margin, as PNG; the whole image without a box or without the Pillow library."""
    try:
        from PIL import Image
    except ModuleNotFoundError:
        return image
    if not box or len(box) != 4:
        return image
    import io

    with Image.open(io.BytesIO(image)) as whole:
        x0, y0, x1, y1 = max(0, box[0] - margin), max(0, box[1] - margin), min(whole.width, box[2] + margin), min(whole.height, box[3] + margin)
        out = io.BytesIO()
        whole.crop((int(x0), int(y0), int(x1), int(y1))).save(out, "PNG")
    return out.getvalue()


def page_digests(regions: DataFrame, remember: int = 6) -> DataFrame:
    """(doc_id, page_index, digest): the first words of the `remember` pages before each page."""
    first = regions.groupBy("doc_id", "page_index").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " "), 1, 160).alias("d"))
    w = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(-remember, -1)
    return first.select("doc_id", "page_index", F.array_join(F.collect_list(F.format_string("page %d: %s", "page_index", "d")).over(w), "\n").alias("digest"))
