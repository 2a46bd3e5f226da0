"""Translation of chunks: tables by their labels, charts, prose, terms, figures, and reassembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.figures import is_numeric_cell
from ledgerlens.functions.text import normalize_whitespace
from ledgerlens.operators import glossary, models, numdiff
from ledgerlens.sources.html_tables import parse_replies

CHUNK = ["doc_id", "chunk_id"]
TERM = "array<struct<source: string, target: string>>"
LABELS = "struct<translations: array<struct<r: int, c: int, row: int, col: int, text: string, translation: string>>, cells: array<struct<r: int, c: int, row: int, col: int, text: string, translation: string>>>"
CHARTS = "struct<charts: array<struct<i: int, index: int, caption: string, description: string>>>"
LABEL_TASK = "Translate the label cells of a financial table into {language}. Reply with JSON: translations, a list of r, c and text. Never add figures."
CHART_TASK = "Translate chart captions and descriptions into {language}. Reply with JSON: charts, a list of i, caption and description. Keep every figure."
PROSE_TASK = "Translate the source into {language}. Keep every figure, paragraph and approved term."
TERM_TASK = "Put the approved terms into the translation and change nothing else. Reply with JSON: fixed."


@dataclass(frozen=True)
class Options:
    language: str = "Chinese"
    terms: int = 60
    retry: bool = True
    coverage_floor: float = 0.6
    charts: bool = True
    enforce_terms: bool = True
    near: float = numdiff.NEAR


def _terms_map(terms: Column) -> Column:
    return F.map_from_entries(F.array_distinct(terms))


def table_payloads(cells: DataFrame, tables: DataFrame, table: str = "table_id") -> DataFrame:
    """(table, payload, n_labels, n_numeric): JSON with caption, unit note, shape, terms and the label cells alone. Figures are copied by code and never sent.

    tables: (table, n_rows, n_cols, caption, units_note, terms).
    """
    label = (F.trim("text") != "") & ~is_numeric_cell(F.col("text"))
    c = cells.withColumn("__label", label)
    slot = F.struct(F.col("row").alias("r"), F.col("col").alias("c"), "text")
    per = c.groupBy(table).agg(F.array_sort(F.collect_list(F.when(F.col("__label"), slot))).alias("cells"), F.count_if("__label").alias("n_labels"), F.count_if((F.trim("text") != "") & ~F.col("__label")).alias("n_numeric"))
    body = F.struct(F.col("caption").alias("table_caption"), "units_note", F.array("n_rows", "n_cols").alias("shape"), "cells", F.when(F.size("terms") > 0, _terms_map(F.col("terms"))).alias("glossary"))
    return per.join(tables, table).select(table, F.to_json(body).alias("payload"), "n_labels", "n_numeric")


def label_replies(calls: DataFrame, table: str = "table_id") -> DataFrame:
    """(table, row, col, translated) of replies, whatever their names for row, column and text; what has no place or text is left out."""
    entries = F.explode(F.coalesce("parsed.translations", "parsed.cells"))
    e = parse_replies(calls, "reply", LABELS).select(table, entries.alias("e"))
    e = e.select(table, F.coalesce("e.r", "e.row").alias("row"), F.coalesce("e.c", "e.col").alias("col"), F.coalesce("e.text", "e.translation").alias("translated")).where("row >= 0 and col >= 0 and translated is not null")
    return e.groupBy(table, "row", "col").agg(F.last("translated").alias("translated"))


def translate_tables(cells: DataFrame, tables: DataFrame, model, options: Options = Options(), table: str = "table_id", keep=lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(target cells, results, calls). results: table, n_labels, n_numeric, n_translated, n_missing, coverage.

    Labels that the reply lacks are asked for once more. A blank or missing translation leaves the source text. Spans, places and figures are copied.
    `keep` writes what must not be computed twice, the model's replies, and reads it again; without it a call may be made more than once.
    """
    task = LABEL_TASK.format(language=options.language)
    sent = table_payloads(cells, tables, table)
    first = sent.select(table, F.when(F.col("n_labels") > 0, F.concat(F.lit("Translate these table labels.\n"), "payload")).alias("prompt"))
    calls = keep(models.ask(first, model, task)).withColumn("step", F.lit("translate-labels"))
    got = label_replies(calls, table)
    labels = cells.where((F.trim("text") != "") & ~is_numeric_cell(F.col("text"))).select(table, "row", "col", "text")
    if options.retry:
        lacking = labels.join(got, [table, "row", "col"], "left_anti")
        again = table_payloads(lacking, tables, table).where("n_labels > 0").select(table, F.concat(F.lit("Some labels were missing. Return ONLY these.\n"), "payload").alias("prompt"))
        second = keep(models.ask(again, model, task)).withColumn("step", F.lit("retry-missing-labels"))
        calls = calls.unionByName(second)
        got = got.unionByName(label_replies(second, table).join(got, [table, "row", "col"], "left_anti"))
    target = cells.join(got, [table, "row", "col"], "left").withColumn("text", F.coalesce(F.nullif(normalize_whitespace(F.col("translated"), True), F.lit("")), "text")).drop("translated")
    met = labels.join(got.withColumn("__hit", F.lit(1)), [table, "row", "col"], "left").groupBy(table).agg(F.count("__hit").alias("n_translated"))
    results = sent.drop("payload").join(met, table, "left").withColumn("n_translated", F.coalesce("n_translated", F.lit(0)))
    results = results.withColumn("n_missing", F.col("n_labels") - F.col("n_translated")).withColumn("coverage", F.when(F.col("n_labels") > 0, F.col("n_translated") / F.col("n_labels")).otherwise(1.0))
    return target, results, calls


def translate_charts(blocks: DataFrame, chunks: DataFrame, model, options: Options = Options(), keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(charts, calls): doc_id, chunk_id, pos, source and target of caption and description. One call for each chunk; what the reply lacks keeps its source. Ticks, series and values are data and not sent."""
    charts = blocks.where("kind = 'chart'").select(*CHUNK, "pos", "caption", F.coalesce("chart.description", F.lit("")).alias("description"))
    charts = charts.withColumn("i", F.row_number().over(Window.partitionBy(*CHUNK).orderBy("pos")) - 1)
    item = F.struct("i", "caption", "description")
    per = charts.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(item)).alias("charts")).join(chunks.select(*CHUNK, "terms"), CHUNK)
    body = F.struct("charts", F.when(F.size("terms") > 0, _terms_map(F.col("terms"))).alias("glossary"))
    asked = per.select(*CHUNK, F.concat(F.lit("Translate these chart captions and descriptions.\n"), F.to_json(body)).alias("prompt"))
    calls = keep(models.ask(asked, model, CHART_TASK.format(language=options.language))).withColumn("step", F.lit("translate-charts"))
    got = parse_replies(calls, "reply", CHARTS).select(*CHUNK, F.explode("parsed.charts").alias("e")).select(*CHUNK, F.coalesce("e.i", "e.index").alias("i"), F.col("e.caption").alias("tc"), F.col("e.description").alias("td"))
    got = got.where("i >= 0").groupBy(*CHUNK, "i").agg(F.last("tc").alias("tc"), F.last("td").alias("td"))
    out = charts.join(got, [*CHUNK, "i"], "left")
    target = lambda t, s: normalize_whitespace(F.coalesce(t, s))
    return out.select(*CHUNK, "pos", "caption", "description", target("tc", "caption").alias("target_caption"), target("td", "description").alias("target_description")), calls


def prose_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, prose, suppressed, n_texts): a chunk's text blocks alone, and how many other blocks it has."""
    said = F.when((F.col("kind") == "text") & (F.trim("rendered") != ""), F.struct("pos", "rendered"))
    return blocks.groupBy(*CHUNK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["rendered"]), "\n\n").alias("prose"), F.count_if(F.col("kind") != "text").alias("suppressed"), F.count_if(F.col("kind") == "text").alias("n_texts"))


def units_hint(blocks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, units_hint): the first unit note of a chunk's tables; empty without one."""
    noted = F.when((F.col("kind") == "table") & (F.coalesce("units_note", F.lit("")) != ""), F.struct("pos", "units_note"))
    return blocks.groupBy(*CHUNK).agg(F.coalesce(F.min(noted)["units_note"], F.lit("")).alias("units_hint"))


def prose_prompt(limit: int) -> Column:
    """Section, context not to be translated, terms, and the source, of a chunk's columns; null without prose."""
    section = F.when(F.size("path") > 0, F.concat(F.lit("Section: "), F.array_join("path", " > ")))
    context = F.when(F.col("prefix_context") != "", F.concat(F.lit("PRECEDING CONTEXT (for continuity only -- do NOT translate or repeat this):\n"), "prefix_context"))
    lines = F.transform(F.slice("terms", 1, limit), lambda t: F.concat(F.lit("- "), t["source"], F.lit(" => "), t["target"]))
    approved = F.when(F.size("terms") > 0, F.concat(F.lit("Approved terminology (must be used verbatim):\n"), F.array_join(lines, "\n")))
    return F.when(F.trim("prose") != "", F.concat_ws("\n\n", section, context, approved, F.concat(F.lit("SOURCE:\n"), "prose", F.lit("\n---"))))


def translate_prose(chunks: DataFrame, blocks: DataFrame, model, options: Options = Options(), keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(prose, calls): doc_id, chunk_id, prose, target_text, failed. A call that fails leaves the source text, and says so."""
    rows = chunks.join(prose_of(blocks), CHUNK)
    asked = rows.select(*CHUNK, "prose", prose_prompt(options.terms).alias("prompt"))
    calls = keep(models.ask(asked, model, PROSE_TASK.format(language=options.language)))
    out = calls.select(*CHUNK, "prose", F.coalesce("reply", "prose").alias("target_text"), F.col("error").alias("failed"))
    return out, calls.drop("prose").withColumn("step", F.lit("translate"))


def repair_terms(prose: DataFrame, chunks: DataFrame, model, options: Options = Options(), keep=lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prose with the repaired target_text, terms still missing after, calls).

    Terms of a chunk that its source has and its target lacks are asked for in one call; the reply counts only if the figures have not drifted further by it.
    A target of over 4,000 characters, more than a call takes, stays as it is, and its terms are still missing after.
    """
    terms = chunks.select(*CHUNK, F.explode("terms").alias("t")).select(*CHUNK, "t.source", "t.target")

    def lacking(p: DataFrame) -> DataFrame:
        both = p.select(*CHUNK, "prose", "target_text").join(terms, CHUNK)
        both = both.where((F.trim("target_text") != "") & (F.col("source") != "") & (F.col("target") != "") & F.contains(F.lower("prose"), F.lower("source")) & ~F.contains("target_text", F.col("target")))
        at = F.position(F.lower("source"), F.lower("prose"))
        start = F.greatest(at - 40, F.lit(1))
        return both.select(*CHUNK, "source", "target", normalize_whitespace(F.substr("prose", start, at - start + F.length("source") + 40)).alias("context"))

    pairs = lacking(prose).groupBy(*CHUNK).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "source", F.lit(" => "), "target"))), "\n").alias("pairs"))
    text = F.concat(F.lit("Approved terms that are missing from the translation:\n"), "pairs", F.lit("\n\nSOURCE:\n"), F.substring("prose", 1, 2000), F.lit("\n\nCURRENT TRANSLATION:\n"), F.substring("target_text", 1, 4000), F.lit("\n"))
    asked = prose.join(pairs, CHUNK).where("length(target_text) <= 4000").select(*CHUNK, text.alias("prompt"))
    calls = keep(models.ask(asked, model, TERM_TASK)).withColumn("step", F.lit("repair"))
    fixed = parse_replies(calls, "reply", "struct<fixed: string>").select(*CHUNK, F.col("parsed.fixed").alias("fixed")).where("trim(fixed) <> ''")
    tried = prose.join(fixed, CHUNK)
    drift = lambda target, name: numdiff.report(numdiff.check_texts(tried, CHUNK, "prose", target, near=options.near), CHUNK, tried).select(*CHUNK, F.col("drift").alias(name))
    good = fixed.join(drift("target_text", "before"), CHUNK).join(drift("fixed", "after"), CHUNK).where("after <= before").select(*CHUNK, "fixed")
    out = prose.join(good, CHUNK, "left").withColumn("target_text", F.coalesce("fixed", "target_text")).drop("fixed")
    return out, lacking(out), calls


def paragraphs_to_blocks(prose: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, target_text) of the text blocks: the target's paragraphs in order; those beyond the blocks' number join the last block, and a block without one keeps its text."""
    texts = blocks.where("kind = 'text'").withColumn("k", F.row_number().over(Window.partitionBy(*CHUNK).orderBy("pos")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*CHUNK)))
    units = F.filter(F.transform(F.split(normalize_whitespace(F.col("target_text"), True), "\n\n"), F.trim), lambda p: p != "")
    t = texts.select(*CHUNK, "pos", "k", "n", "text").join(prose.select(*CHUNK, units.alias("units")), CHUNK, "left")
    last = F.array_join(F.slice("units", F.col("k") + 1, F.greatest(F.size("units"), F.lit(1))), "\n\n")
    own = F.when(F.col("k") == F.col("n") - 1, F.nullif(last, F.lit(""))).otherwise(F.get("units", F.col("k")))
    return t.select("doc_id", "pos", F.coalesce(own, "text").alias("target_text"))


def translate(chunks: DataFrame, blocks: DataFrame, cells: DataFrame, tables: DataFrame, model, options: Options = Options(), keep=lambda df: df) -> dict[str, DataFrame]:
    """A whole run over the chunks of documents. Returns

    results (doc_id, chunk_id, target_text, report of figures, labels, figures copied, terms_before, terms_after, errors, ok), findings, target_cells, target_blocks, calls.

    chunks, blocks: of chunks.build; cells, tables: of tables.build_tables. Tables come first, then charts, prose, terms; figures of prose, tables and charts
    are compared after all that; blocks are reassembled in the source's order. `keep` as in translate_tables.
    """
    owner = blocks.where("table_id is not null").select(*CHUNK, "table_id")
    asked = tables.join(owner, "table_id").join(chunks.select(*CHUNK, "terms"), CHUNK).select("table_id", "n_rows", "n_cols", "caption", "units_note", "terms")
    target_cells, labels, calls = translate_tables(cells, asked, model, options, keep=keep)
    target_cells = keep(target_cells)
    per_table = numdiff.check_table_pairs(cells, target_cells, tables, tables, near=options.near)
    thin = numdiff.structural(labels.where(F.col("coverage") < options.coverage_floor), ["table_id"], F.format_string("only %.0f%% of label cells were translated; table may be partially untranslated", F.col("coverage") * 100))
    table_findings = per_table.drop("row", "col").unionByName(thin).join(owner, "table_id").drop("table_id")
    prose, more = translate_prose(chunks, blocks, model, options, keep)
    calls = calls.select("step", "prompt", "reply", "error", "seconds").unionByName(more.select("step", "prompt", "reply", "error", "seconds"))
    none = chunks.select(*CHUNK).where("false").withColumn("n", F.lit(0))
    before = after = none
    if options.enforce_terms:
        wanted = prose
        prose, left, more = repair_terms(prose, chunks, model, options, keep)
        prose = keep(prose)
        calls = calls.unionByName(more.select("step", "prompt", "reply", "error", "seconds"))
        asked_for = chunks.select(*CHUNK, F.explode("terms").alias("t")).join(wanted, CHUNK).where(F.contains(F.lower("prose"), F.lower("t.source")) & ~F.contains("target_text", F.col("t.target")))
        before, after = asked_for.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("n")), left.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("n"))
    noted = prose.join(units_hint(blocks), CHUNK, "left")
    findings = numdiff.check_texts(noted, CHUNK, "prose", "target_text", "units_hint", options.near).unionByName(table_findings)
    said = paragraphs_to_blocks(prose, blocks)
    target_blocks = blocks.join(said, ["doc_id", "pos"], "left").withColumn("text", F.coalesce("target_text", "text")).drop("target_text")
    if options.charts:
        charts, more = translate_charts(blocks, chunks, model, options, keep)
        charts = keep(charts)
        calls = calls.unionByName(more.select("step", "prompt", "reply", "error", "seconds"))
        both = lambda a, b: F.concat_ws("\n", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
        texts = charts.select(*CHUNK, "pos", both(F.col("caption"), F.col("description")).alias("s"), both(F.col("target_caption"), F.col("target_description")).alias("t"))
        findings = findings.unionByName(numdiff.check_texts(texts.where("trim(s) <> ''"), [*CHUNK, "pos"], "s", "t", near=options.near).drop("pos"))
        target_blocks = target_blocks.join(charts.select("doc_id", "pos", "target_caption", "target_description"), ["doc_id", "pos"], "left")
        target_blocks = target_blocks.withColumn("caption", F.coalesce("target_caption", "caption")).withColumn("chart", F.when(F.col("target_description").isNotNull(), F.col("chart").withField("description", F.col("target_description"))).otherwise(F.col("chart")))
        target_blocks = target_blocks.drop("target_caption", "target_description")
    findings = keep(findings)
    sums = labels.join(owner, "table_id").groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("tables_translated"), F.sum("n_translated").alias("labels_translated"), F.sum("n_numeric").alias("figures_copied"), F.sum("n_missing").alias("labels_missing"))
    results = numdiff.report(findings, CHUNK, chunks).join(prose.select(*CHUNK, "prose", "target_text", "failed"), CHUNK, "left").join(sums, CHUNK, "left")
    results = results.join(before.withColumnRenamed("n", "terms_before"), CHUNK, "left").join(after.withColumnRenamed("n", "terms_after"), CHUNK, "left")
    counts = ["tables_translated", "labels_translated", "figures_copied", "labels_missing", "terms_before", "terms_after"]
    results = results.na.fill(0, counts)
    empty = F.when((F.trim(F.coalesce("target_text", F.lit(""))) == "") & (F.col("tables_translated") == 0), F.lit("chunk produced no output"))
    results = results.withColumn("errors", F.array_compact(F.array(empty, F.when(F.col("failed").isNotNull(), F.concat(F.lit("prose call failed: "), "failed"))))).drop("failed")
    return {"results": keep(results.withColumn("ok", F.col("ok") & (F.size("errors") == 0))), "findings": findings, "target_cells": target_cells, "target_blocks": target_blocks, "calls": calls, "labels": labels}


def leak_audit(payloads: DataFrame, cells: DataFrame, table: str = "table_id") -> DataFrame:
    """(table, row, col, text): figures' cells whose text stands as a label in their table's payload; none, if figures are never sent."""
    numeric = cells.where(is_numeric_cell(F.col("text")))
    return numeric.join(payloads.select(table, "payload"), table).where(F.contains("payload", F.concat(F.lit('"text":"'), "text", F.lit('"')))).select(table, "row", "col", "text")
