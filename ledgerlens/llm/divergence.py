"""Source divergence: how unlike the sources of a language use its terms, by joint histograms of their counts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TO_LOWER = {c: c + 32 for c in range(65, 91)}
#: Terms of its groups that a task counts up before it hands them on.
HELD = 300_000
COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the occurrences and of the documents of each (lang, source, term), added up over as many texts as hold HELD terms."""
    counts, documents = defaultdict(Counter), defaultdict(Counter)

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            terms = list(found)
            columns = [[lang] * len(terms), [source] * len(terms), terms, list(found.values()), list(map(documents[lang, source].__getitem__, terms))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        documents.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            found = TERM.findall(text.lower() if text.isascii() else text.translate(TO_LOWER))
            counts[lang, source].update(found)
            documents[lang, source].update(set(found))
            if sum(map(len, counts.values())) > HELD:
                yield from handed_on()
    yield from handed_on()


def kept_terms(documents: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, term, lang_n, cells (source, n; by source): terms of at least `least` documents of their language; nulls are empty strings.

    One shuffle, by language and term, of what the tasks have counted up: it serves both groupings. A term has a cell for each source of its language at most.
    """
    read = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = read.mapInArrow(_count_terms, COUNTED).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"))
    return terms.where(F.col("docs") >= least).drop("docs")


def share(n: Column, total: Column, terms: Column, scale: int = 10**9, prior: int = 2) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * terms)), in decimals, which hold scale * n of any corpus."""
    whole = F.lit(scale).cast("decimal(10,0)") * (n + prior).cast("decimal(19,0)")
    return 1 + F.call_function("div", whole, (total + prior * terms).cast("decimal(20,0)"))


def unlikeness(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are under 2^31, so no product leaves 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(documents: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows for each other source of the language, `term` rows for the `top` terms that a source uses more than its language.

    Terms are runs of letters and other non-ASCII characters, A-Z lower-cased; a language keeps those of at least `least` documents. Pairs go by joint count histograms: terms of the same counts
    in all sources of their language (its profile) are tallied first, then each pair of a profile's sources adds its number of terms to the pair's cell (count, count). Cells with one zero are what is
    left of a source's own histogram of counts, the cell of two zeros is what is left of the vocabulary. The measure is taken once for each cell, times its number of terms. So the work grows with the
    distinct profiles and with the pairs of sources, of which the result has a row each; no pair of sources is formed for each term.

    Cases: null texts, languages and sources are empty strings; a source without terms has its rows all the same (a language that keeps none has pairs of value 0, no terms); repeated rows are documents of
    their own; ties go by the item's UTF-8 bytes; very long texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession)
    terms = scratch.table(kept_terms(documents, least, text_col, lang_col, source_col))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    own = terms.select("lang", F.explode("cells").alias("cell")).select("lang", "cell.source", "cell.n")
    own = scratch.table(own.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")))  # a source's histogram of counts
    occurring = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sums = own.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    groups = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("bigint")
    groups = scratch.table(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total")]))
    pairs = _pairs(scratch, terms, own, groups)
    used = terms.select("lang", "term", "lang_n", F.explode("cells").alias("cell")).select("lang", "cell.source", "term", F.col("cell.n").alias("n"), "lang_n")
    used = used.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v")))
    used = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), unlikeness(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # the tasks keep `top` of each group before they are brought together
    used = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("item"), "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(used)


def _pairs(scratch: Scratch, terms: DataFrame, own: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source), value: the measure summed over all kept terms."""
    profiles = terms.groupBy("lang", "cells").agg(F.count(F.lit(1)).alias("terms"))
    first = profiles.select("lang", "cells", "terms", F.posexplode("cells").alias("at", "a"))
    both = first.select("lang", "terms", "a", F.explode(F.expr("slice(cells, at + 2, size(cells))")).alias("b"))
    joint = both.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.n").alias("n"), F.col("b.n").alias("m")).agg(F.sum("terms").alias("terms"))
    joint = scratch.table(joint)
    joint = joint.unionByName(joint.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("m").alias("n"), F.col("n").alias("m"), "terms"))  # both ways
    # each ordered pair of sources, as the result has them
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    pairs = groups.select("lang", "source", "total", "v").join(other, "lang").where("source != item")
    met = joint.groupBy("lang", "source", "item", "n").agg(F.sum("terms").alias("met"))
    alone = own.join(pairs.select("lang", "source", "item"), ["lang", "source"]).join(met, ["lang", "source", "item", "n"], "left")
    alone = alone.select("lang", "source", "item", "n", F.lit(0).cast("bigint").alias("m"), (F.col("terms") - F.coalesce("met", F.lit(0))).alias("terms"), F.lit(True).alias("turns"))
    cells = joint.withColumn("turns", F.lit(False)).unionByName(alone.where("terms > 0"))
    cells = cells.join(pairs, ["lang", "source", "item"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("m"), F.col("item_total"), F.col("v"))
    cells = cells.withColumn("value", unlikeness(p, q) * F.col("terms"))
    # a cell (count, 0) is the turned pair's (0, count), and the measure is the same both ways
    turned = cells.where("turns").select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "terms", "value")
    sums = cells.select("lang", "source", "item", "terms", "value").unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("terms").alias("seen"), F.sum("value").alias("value"))
    none = share(F.lit(0).cast("bigint"), F.col("total"), F.col("v")), share(F.lit(0).cast("bigint"), F.col("item_total"), F.col("v"))
    rest = F.when(F.col("v") > 0, unlikeness(*none) * (F.col("v") - F.coalesce("seen", F.lit(0)))).otherwise(0)
    return pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + rest).cast("bigint").alias("value"))
