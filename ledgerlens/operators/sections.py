"""Headings, sections and token-budgeted chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import normalize_whitespace

#: Fixed values, most reliable first: rule, pattern, level (none: by the depth of the number).
HEADINGS = (
    ("cn-part", r"^第[一二三四五六七八九十百]+[篇部分编]", 1),
    ("cn-chapter", r"^第[一二三四五六七八九十百]+章", 1),
    ("en-part", r"^(?:PART|Part)\s+[IVXLC\d]+\b", 1),
    ("cn-section", r"^第[一二三四五六七八九十百]+节", 2),
    ("appendix", r"^(?i)(?:附录|附注|Appendix|Annex|Schedule|Notes?\s+to\s+the)\b", 2),
    ("numbered", r"^(\d+(?:\.\d+)*)[\s、．.]\s*\S", None),
    ("cn-paren", r"^[（(]\s*[一二三四五六七八九十]+\s*[）)]", 3),
    ("cn-dun", r"^[一二三四五六七八九十]+\s*[、．]\s*\S", 2),
    ("roman", r"^[IVXLC]{1,5}[.、]\s+\S", 2),
    ("allcaps", r"^[A-Z][A-Z0-9 ,&/'\-()]{4,70}$", 2),
)


def heading(text: Column, font: Column | None = None, body_font: Column | None = None) -> Column:
    """Struct (level, rule, confidence) or null: the first rule that fits a text of up to 140 characters; else a font of 1.25 times the body's."""
    t = normalize_whitespace(text)
    none = F.lit(None).cast("struct<level: int, rule: string, confidence: double>")
    entry = lambda level, rule, c: F.struct(level.cast("int").alias("level"), F.lit(rule).alias("rule"), F.lit(c).alias("confidence"))
    out = none
    if font is not None:
        out = F.when((font >= 1.25 * body_font) & (F.length(t) <= 60), entry(F.lit(2), "font-size", 0.6)).otherwise(none)
    for rule, pattern, level in reversed(HEADINGS):
        depth = F.lit(level) if level else F.least(F.lit(6), F.length(F.regexp_replace(F.regexp_extract(t, r"^[\d.]*\d", 0), r"[^.]", "")) + 1)
        fits = t.rlike(pattern) & (F.length(t) <= 80)
        if rule == "numbered":  # with a comma at its begin and no dot it is an item of a list
            start = F.substring(t, 1, 12)
            fits &= ~(F.contains(start, F.lit(",")) & ~F.contains(start, F.lit(".")))
        out = F.when(fits, entry(depth, rule, 0.75 if rule in ("allcaps", "numbered") else 1.0)).otherwise(out)
    refused = (t == "") | (F.length(t) > 140) | ((F.length(t) > 24) & t.rlike("[.;:。；：]$"))
    return F.when(refused, none).otherwise(out)


def section_paths(blocks: DataFrame, doc: list[str], pos: str, depth: int = 6) -> DataFrame:
    """Adds span (running number of headings) and path (the titles that are open at each block): one sort by window, no stack."""
    w = Window.partitionBy(*doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumn("span", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w).cast("int"))
    parts = []
    for k in range(1, depth + 1):
        last = F.last(F.when(F.col("level") <= k, F.struct("level", "title")), ignorenulls=True).over(w)
        parts.append(F.when(last["level"] == k, last["title"]))
    return out.withColumn("path", F.array_compact(F.array(*parts)))


def body_font(blocks: DataFrame, doc: list[str]) -> DataFrame:
    """Upper median font size of blocks of over 60 characters (of all, if there are none)."""
    sized = blocks.where("font_size > 0")
    mid = lambda a: F.element_at(a, F.expr("cast(1 as int)") + (F.size(a) / 2).cast("int"))
    long, every = F.array_sort(F.collect_list(F.when(F.length("text") > 60, F.col("font_size")))), F.array_sort(F.collect_list("font_size"))
    return sized.groupBy(*doc).agg(F.when(F.size(long) > 0, mid(long)).otherwise(mid(every)).alias("body_font"))


def pack_chunks(blocks: DataFrame, doc: str, pos: str, tokens: str, max_tokens: int = 1400, min_tokens: int = 60) -> DataFrame:
    """(doc, pos, chunk): blocks of a document in order, a new chunk where the budget would be passed; a block is never split, and a tail of
    under `min_tokens` joins the chunk before it if both fit. Greedy packing is a fold over a document's block sizes, so these (two numbers
    a block, no texts) are gathered by document and folded in Arrow batches of many documents."""

    def fold(sizes: list[int]) -> list[int]:
        chunk, held, before, out = 0, 0, None, []
        for n in sizes:
            if held and held + n > max_tokens:
                chunk, held, before = chunk + 1, 0, held
            held += n
            out.append(chunk)
        if before is not None and held < min_tokens and before + held <= max_tokens:
            out = [min(c, chunk - 1) for c in out]
        return out

    @F.pandas_udf("array<int>")
    def folded(sizes: pd.Series) -> pd.Series:
        return sizes.map(fold)

    gathered = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(tokens).cast("int").alias("n")))).alias("b"))
    packed = gathered.select(doc, F.col("b.p").alias("p"), folded(F.col("b.n")).alias("c"))
    return packed.select(doc, F.explode(F.arrays_zip("p", "c")).alias("x")).select(doc, F.col("x.p").alias(pos), F.col("x.c").alias("chunk"))


def map_batches(df: DataFrame, call, schema: str) -> DataFrame:
    """Rows through a batch function of a model client (call: pandas frame to pandas frame)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield call(batch)

    return df.mapInPandas(run, schema)
