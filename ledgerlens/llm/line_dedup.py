"""Line deduplication by a log-template tree of fixed depth."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlens.llm.common import Scratch, counted_join, spare_names

VARIABLE = re.compile(r"\d")
MARK = "<*>"
#: Hashes in the sketch of a document's other lines, of which ALIKE are equal in near copies: at a similarity of 0.68 of the word pairs all but 1 in 100,000, at 0.01 1 in 1,000.
SAMPLES, ALIKE = 16, 3
NOTHING = np.uint64((1 << 64) - 1)
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
MIXES = np.array([0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1 for i in range(SAMPLES)], dtype=np.uint64)


def templates(line: str, lead: int = 3, hole_tokens: int = 8) -> list[int]:
    """Template numbers of a line: leaves of the tree that it belongs to; none without a token that is no variable field.

    The first level of the tree is the token count, the next `lead` levels are the leading tokens, a token with a
    digit standing as a variable field. Below, the first template has the other tokens as they are (variable fields again
    masked); for lines of `hole_tokens` or more, two more templates have the first or the second half of the rest
    generalised to fields whose values are open, of which only the lengths in tokens count.
    """
    tokens = line.split()
    n = len(tokens)
    masked = [MARK if VARIABLE.search(t) else t for t in tokens] if VARIABLE.search(line) else tokens
    if all(t is MARK for t in masked):
        return []
    digest = lambda s: xxhash.xxh64_intdigest(s) - (1 << 63)
    head = f"{n} {' '.join(masked[:lead])}"
    out = [digest(f"{head}|{' '.join(masked[lead:])}")]
    if n >= hole_tokens:
        middle = lead + (n - lead) // 2
        out += [digest(f"{head}|{MARK}|{' '.join(masked[middle:])}"), digest(f"{head}|{' '.join(masked[lead:middle])}|{MARK}")]
    return out


def line_minima(lines: list[list[str]]) -> np.ndarray:
    """(SAMPLES, lines): the smallest hash of each line's word pairs (its words, at its end) under each of SAMPLES mixes; NOTHING for a line without words."""
    out = np.full((SAMPLES, len(lines)), NOTHING)
    full = [i for i, words in enumerate(lines) if words]
    if full:
        h = np.array([crc32(w.encode("utf-8", "surrogatepass")) for i in full for w in lines[i]], dtype=np.uint64)
        ends = np.cumsum([len(lines[i]) for i in full])
        follower = np.append(h[1:], np.uint64(0))
        follower[ends - 1] = 0
        x = ((h << np.uint64(32) | follower)[None, :] ^ MIXES[:, None]) * MULTIPLIER
        x ^= x >> np.uint64(32)
        x *= MULTIPLIER
        out[:, full] = np.minimum.reduceat(x ^ x >> np.uint64(29), np.concatenate([[0], ends[:-1]]), axis=1)
    return out


def rest_sketches(lines: list[list[str]], held: dict[int, set[int]]) -> dict[int, tuple[int, int]]:
    """For each template, of which `held` has the line numbers, a sketch of all other lines: a byte of each smallest hash, in two longs."""
    minima = line_minima(lines)
    at, rows = minima.argmin(axis=1), np.arange(SAMPLES)
    first, second = minima[rows, at], minima.copy()
    second[rows, at] = NOTHING
    second = second.min(axis=1)
    pack = lambda m: tuple((m & np.uint64(255)).astype(np.uint8).view("<i8").tolist())
    whole, one, out = pack(first), {}, {}
    deciding = set(at.tolist())
    for template, without in held.items():
        if deciding.isdisjoint(without):
            out[template] = whole
        elif len(without) == 1:
            (i,) = without
            if i not in one:
                one[i] = pack(np.where(at == i, second, first))
            out[template] = one[i]
        else:
            out[template] = pack(np.delete(minima, list(without), axis=1).min(axis=1, initial=NOTHING))
    return out


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lines, keys, lows, highs = [], [], [], []
        for text in batch["text"]:
            split = text.split("\n")
            found = [(i, t) for i, line in enumerate(split) for t in templates(line)]
            held: dict[int, set[int]] = {}
            for i, t in found:
                held.setdefault(t, set()).add(i)
            rest = rest_sketches([line.split() for line in split], held) if held else {}
            lines.append([i for i, _ in found])
            keys.append([t for _, t in found])
            lows.append([rest[t][0] for _, t in found])
            highs.append([rest[t][1] for _, t in found])
        yield pd.DataFrame({"doc": batch["doc"], "lines": lines, "templates": keys, "low": lows, "high": highs})


def alike(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether two sketches have ALIKE bytes or more in common."""
    same = [(F.shiftrightunsigned(a.bitwiseXOR(b), s).bitwiseAND(F.lit(255)) == 0).cast("int") for a, b in ((low, other_low), (high, other_high)) for s in range(0, 64, 8)]
    return reduce(operator.add, same) >= ALIKE


@F.pandas_udf(StringType())
def _without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, dropped, strict=True):
        gone = set() if gone is None else set(gone)
        out.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def recurring_lines(documents: DataFrame, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, dropped): for documents that have any, the line numbers (from 0) whose template recurs.

    doc is a hash of identifier and text. A template recurs if at least `min_docs` documents hold it of which no two are
    alike in their other lines, at whatever size of the table: a line that only copies and near copies share is theirs,
    and near-dedup's matter. Of each template's holders the one of the smallest sketch is taken and those alike to it go, and so
    on `min_docs` times; each round is a smallest value by template and a join in which templates of very many holders stay in place.
    """
    if min_docs < 2:
        raise ValueError("a line recurs in two documents at least")
    scratch = Scratch(documents.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("doc"), text.alias("text"))
    keyed = scratch.table(rows.mapInPandas(_keys, "doc bigint, lines array<int>, templates array<bigint>, low array<bigint>, high array<bigint>"))
    left = keyed.select(F.explode(F.arrays_zip("templates", "low", "high")).alias("x")).select(F.col("x.templates").alias("template"), "x.low", "x.high")
    counts = None
    for _ in range(min_docs - 1):
        ends = left.groupBy("template").agg(F.min(F.struct("low", "high")).alias("m"), F.max(F.struct("low", "high")).alias("n"), F.count(F.lit(1)).alias("rows"))
        # holders of one sketch, as of most templates, have no unlike one
        taken = scratch.table(ends.where("m <> n").select("template", F.col("m.low").alias("l"), F.col("m.high").alias("h"), "rows"))
        left = counted_join(left, taken, ["template"], "rows").where(~alike(F.col("low"), F.col("high"), F.col("l"), F.col("h"))).select("template", "low", "high")
        left = scratch.table(left)
        counts = taken.select("template", "rows") if counts is None else counts
    # counts are of all rows, so those of the templates that recur too
    recurring = scratch.table(left.select("template").distinct().join(counts, "template"))
    at = keyed.select("doc", F.explode(F.arrays_zip("lines", "templates")).alias("x")).select("doc", F.col("x.lines").alias("line"), F.col("x.templates").alias("template"))
    return counted_join(at, recurring, ["template"], "rows").groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def drop_recurring_lines(documents: DataFrame, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", report_col: str = "dropped") -> DataFrame:
    """documents with all their columns, recurring lines cut out of the text, and array column `report_col` with their numbers.

    A document of which no word would be left stays whole (whole documents are near-dedup's matter). Cases: a null text
    stays null; empty lines and lines of which all words are variable fields are never dropped; repeated rows count once and are treated alike; null identifiers are
    kept; a very long text is read whole; an empty table gives no rows; a column named as `report_col` is replaced, and no other name clashes.
    """
    doc, gone, cut = spare_names(documents, "doc", "gone", "cut")
    found = recurring_lines(documents, min_docs, id_col, text_col).toDF(doc, gone)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = documents.withColumn(doc, F.xxhash64(F.col(id_col).cast("string"), text)).join(found, doc, "left")
    out = out.withColumn(cut, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_without(text, F.col(gone))))
    whole = F.trim(F.regexp_replace(cut, r"\s+", " ")) == ""
    out = out.withColumn(report_col, F.when(whole | F.col(gone).isNull(), F.array().cast("array<int>")).otherwise(F.col(gone)))
    return out.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(F.col(cut))).drop(doc, gone, cut)


def line_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (their numbers, comma-joined), text (what stays)."""
    lines = documents.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint"))
    out = drop_recurring_lines(lines)
    return out.select("doc_id", "n_lines", F.size("dropped").cast("bigint").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"), "text")
