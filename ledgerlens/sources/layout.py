"""Readers: recorded layouts, page images, review queues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "struct<text: string, bbox: array<double>, row: int, col: int, row_span: int, col_span: int, rowspan: int, colspan: int, is_header: boolean>"
CHART = "struct<chart_type: string, description: string, series: array<struct<name: string, label: string, points: map<string, string>, value: string>>, axis_labels: map<string, array<string>>>"
REGION = f"struct<label: string, type: string, bbox: array<double>, text: string, content: string, caption: string, font_size: double, units: string, units_note: string, cells: array<{CELL}>, chart: {CHART}>"
PAGE = f"struct<page: int, page_index: int, width: double, height: double, regions: array<{REGION}>>"
LAYOUT = f"pages array<{PAGE}>"


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """Recordings (one JSON document a file): doc_id, page_index, pos, label, text, caption, units_note, font_size, bbox, cells, chart. Alias names are folded."""
    raw = spark.read.schema(LAYOUT).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("doc_id"), F.explode("pages").alias("p"))
    regions = raw.select("doc_id", F.coalesce("p.page", "p.page_index").alias("page_index"), F.posexplode("p.regions").alias("pos", "r"))
    return regions.select(
        "doc_id", "page_index", "pos", F.coalesce("r.label", "r.type").alias("label"), F.coalesce("r.text", "r.content").alias("text"), "r.caption", F.coalesce("r.units_note", "r.units").alias("units_note"), "r.font_size", "r.bbox", "r.cells", "r.chart",
    )


def region_cells(regions: DataFrame) -> DataFrame:
    """Cells with boxes of the table regions: table_id, ord, text, x0, y0, x1, y1."""
    tables = regions.where("size(cells) > 0").withColumn("table_id", F.concat_ws("/", "doc_id", "page_index", "pos"))
    cells = tables.select("table_id", F.posexplode("cells").alias("ord", "c")).where("size(c.bbox) = 4")
    return cells.select("table_id", "ord", F.coalesce("c.text", F.lit("")).alias("text"), *[F.col("c.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def chart_points(regions: DataFrame) -> DataFrame:
    """Points of the chart regions: doc_id, page_index, pos, series, category, value.

    A series holds a map of points, or one value (its category is null), or both; what is no number is left out.
    """
    s = regions.select("doc_id", "page_index", "pos", F.explode("chart.series").alias("s"))
    s = s.withColumn("series", F.coalesce("s.label", "s.name", F.lit("")))
    keys = ["doc_id", "page_index", "pos", "series"]
    many = s.select(*keys, F.explode("s.points").alias("category", "value"))
    one = s.where("s.value is not null").select(*keys, F.lit(None).cast("string").alias("category"), F.col("s.value").alias("value"))
    return many.union(one).withColumn("value", F.expr("try_cast(value as double)")).where("value is not null")


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of the first frame header of a JPEG file, found by the lengths of the segments before it."""
    at = 2
    while at + 9 <= len(data):
        mark = data[at + 1]
        if data[at] != 0xFF or mark == 0xFF:
            at += 1
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:  # these have no length
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        elif mark in (0xD9, 0xDA):
            return None
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def _jpeg_sizes(files: pd.Series) -> pd.DataFrame:
    found = [(None if f is None else jpeg_size(f)) or (None, None) for f in files]
    return pd.DataFrame(found, columns=["width", "height"], dtype="Int32")


def _number(data, start: int, size: int, little: bool = False):
    part = F.hex(F.substring(data, start, size))
    if little:
        part = F.concat(*[F.substring(part, 2 * i - 1, 2) for i in range(size, 0, -1)])
    return F.conv(part, 16, 10).cast("bigint")


def _webp(data, width: bool):
    """Width or height in a WEBP header: 24 bits less one (VP8X), 14 bits less one (VP8L), or 14 bits (VP8)."""
    form = F.hex(F.substring(data, 13, 4))
    packed = _number(data, 22, 4, True)
    lossless = F.shiftright(packed, 0 if width else 14).bitwiseAND(F.lit(0x3FFF)) + 1
    lossy = _number(data, 27 if width else 29, 2, True).bitwiseAND(F.lit(0x3FFF))
    return F.when(form == "56503858", _number(data, 25 if width else 28, 3, True) + 1).when(form == "5650384C", lossless).when(form == "56503820", lossy).cast("int")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with width and height from PNG, GIF, BMP, WEBP and JPEG headers (null for others). Spark's reader gives no row for a file of no bytes."""
    files = spark.read.format("binaryFile").load(path)
    d = F.col("content")
    head = F.hex(F.substring(d, 1, 4))
    webp = (head == "52494646") & (F.hex(F.substring(d, 9, 4)) == "57454250")
    files = files.withColumn("jpeg", F.pandas_udf(_jpeg_sizes, "width int, height int")(F.when(head.startswith("FFD8FF"), d)))

    def side(png: int, gif: int, bmp: int, width: bool):
        found = F.when(head == "89504E47", _number(d, png, 4)).when(head.startswith("474946"), _number(d, gif, 2, True)).when(head.startswith("424D"), _number(d, bmp, 4, True))
        return F.coalesce(found.when(webp, _webp(d, width)).cast("int"), F.col("jpeg.width" if width else "jpeg.height"))

    return files.select("path", "length", side(17, 7, 19, True).alias("width"), side(21, 9, 23, False).alias("height"))


QUEUE = (
    "item_id string, chunk_id string, risk double, target_text string, status string, note string, reviewer string, created_at string, decided_at string, band string, is_financial boolean, page_start int, page_end int, section_path array<string>, source_text string, "
    "reasons array<struct<name: string, contribution: double, detail: string, severity: string>>, measures map<string, bigint>, errors array<string>, tables array<struct<caption: string, units_note: string, target_html: string>>, seq bigint"
)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Review items of JSON Lines, or of one JSON array with an item on each line; of repeated items (by item_id and chunk_id) the last counts, by seq where it is given, then by the time of the files and the order of the lines."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^\[|[,\]]$", "").alias("v"), F.struct(F.col("_metadata.file_modification_time").alias("t"), F.monotonically_increasing_id().alias("i")).alias("at"))
    rows = lines.where("v <> ''").select(F.from_json("v", QUEUE).alias("r"), "at").where("r.item_id is not null")
    return rows.groupBy("r.item_id", "r.chunk_id").agg(F.max_by("r", F.struct(F.coalesce("r.seq", F.lit(0)), "at")).alias("r")).select("r.*")
