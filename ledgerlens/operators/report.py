"""Runs from regions to review queue, and what is reported of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import escape_html
from ledgerlens.operators import agents, chunks, documents, review, risk, tables
from ledgerlens.operators.keep import writer

KEY = ["doc_id", "chunk_id"]


def run(parsed: dict[str, DataFrame], model, terms: DataFrame | None = None, options: agents.Options = agents.Options(), weights=None, saturation=None, threshold: float = risk.THRESHOLD, keep=None, **packing) -> dict[str, DataFrame]:
    """Blocks, tables and cells (of sources.documents.parse) to chunks, translation, risk and review items; all of agents.translate's results and chunks, blocks, scored, queue.

    What is read more than once is kept by `keep`, in tables of the shared folder if none is given.
    """
    keep = keep or writer(parsed["blocks"].sparkSession)
    parsed = {k: keep(parsed[k]) for k in ("blocks", "tables", "cells")}
    sectioned = keep(chunks.in_sections(parsed["blocks"]))
    made, blocks = chunks.build(sectioned, terms, **packing)
    blocks = keep(blocks)
    made = keep(made)
    out = agents.translate(made, blocks, parsed["cells"], parsed["tables"], model, options, keep)
    measured = keep(risk.features(out["results"], made, blocks, parsed["tables"], parsed["cells"]))
    scored = keep(risk.score_chunks(measured, weights, saturation, threshold))
    return out | {"chunks": made, "blocks": blocks, "scored": scored, "queue": items(scored, out["target_cells"], parsed["tables"], blocks)}


def items(scored: DataFrame, target_cells: DataFrame, built: DataFrame, blocks: DataFrame) -> DataFrame:
    """Review items of the chunks that need review, in the form that review.upsert takes."""
    html = tables.to_html(target_cells, tables.header_rows(target_cells)).withColumnRenamed("rendered", "target_html")
    shown = blocks.where("table_id is not null").select(*KEY, "pos", "table_id").join(built.select("table_id", "caption", "units_note"), "table_id").join(html, "table_id", "left")
    shown = shown.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "caption", "units_note", "target_html"))), lambda t: F.struct(t["caption"].alias("caption"), t["units_note"].alias("units_note"), t["target_html"].alias("target_html"))).alias("tables"))
    names = [F.lit(x) for m in review.MEASURES for x in (m,)]
    measures = F.map_from_arrays(F.array(*names), F.array(*[F.col(m).cast("bigint") for m in review.MEASURES]))
    chunk = F.concat_ws("/", *KEY)
    return scored.where("needs_review").join(shown, KEY, "left").select(
        review.item_id(chunk).alias("item_id"), chunk.alias("chunk_id"), "risk", "target_text", "band", "is_financial", "page_start", "page_end", F.col("path").alias("section_path"), "source_text", "reasons", measures.alias("measures"), "errors", "tables"
    )


def summary(outcome: dict[str, DataFrame]) -> DataFrame:
    """One row for each document: chunks, ok and failed ones, tables, labels and figures copied, figures compared and their drift, bands, and items to review."""
    s = outcome["scored"].groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if("ok").alias("ok_chunks"), F.count_if(F.size("errors") > 0).alias("failed_chunks"), F.sum("source_total").alias("numbers_source"), F.sum("matched").alias("numbers_matched"), F.sum("numbers_mismatched").alias("numbers_mismatched"),
        F.sum("numbers_missing").alias("numbers_missing"), *[F.count_if(F.col("band") == b).alias(b) for b in ("blocked", "review", "watch", "auto")], F.max("risk").alias("max_risk"), F.count_if("needs_review").alias("to_review"),
    )
    r = outcome["results"].groupBy("doc_id").agg(F.sum("tables_translated").alias("tables_translated"), F.sum("labels_translated").alias("label_cells_translated"), F.sum("figures_copied").alias("numeric_cells_copied"))
    bad = F.col("numbers_mismatched") + F.col("numbers_missing")
    return s.join(r, "doc_id", "left").withColumn("number_drift", F.when(F.col("numbers_source") > 0, F.round(F.least(F.lit(1.0), bad / F.col("numbers_source")), 4)).otherwise(0.0))


def target_markdown(outcome: dict[str, DataFrame], points: DataFrame | None = None, notes: bool = True) -> DataFrame:
    """(doc_id, markdown): the translated documents. Tables are HTML, which keeps their spans; charts are their data; figures that changed or are missing are noted after their chunk."""
    b = outcome["target_blocks"]
    html = tables.to_html(outcome["target_cells"], tables.header_rows(outcome["target_cells"])).withColumnRenamed("rendered", "__html")
    b = b.join(html, "table_id", "left")
    if points is not None:
        b = b.join(documents.chart_narrative(b, points), ["doc_id", "pos"], "left")
    else:
        b = b.withColumn("narrative", F.lit(None).cast("string"))
    bold = F.when(F.col("caption") != "", F.concat(F.lit("**"), "caption", F.lit("**\n"))).otherwise("")
    level = F.when(F.col("heading_level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.col("heading_level") + 1)), F.lit(" "))).otherwise("")
    chart = F.coalesce("narrative", F.concat_ws("\n\n", F.when(F.col("caption") != "", F.concat(F.lit("**"), "caption", F.lit("**"))), F.nullif("chart.description", F.lit(""))))
    image = F.when(F.col("caption") != "", F.concat(F.lit("*[image] "), "caption", F.lit("*"))).otherwise("*[image]*")
    part = F.when(F.col("kind") == "text", F.concat(level, "text")).when(F.col("kind") == "table", F.concat(bold, F.coalesce("__html", F.lit("")))).when(F.col("kind") == "chart", chart).otherwise(image)
    body = b.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    c = outcome["scored"].select(*KEY, "chunk_no", "risk", "path").join(body, KEY)
    if notes:
        f = outcome["findings"]
        told = F.when(F.col("kind") == "mismatched", F.concat(F.lit("> ⚠ figure changed: `"), "source_raw", F.lit("` → `"), "target_raw", F.lit("` ("), "reason", F.lit(")"))).when(F.col("kind") == "missing", F.concat(F.lit("> ⚠ figure missing in target: `"), "source_raw", F.lit("`"))).when(F.col("kind") == "structural", F.concat(F.lit("> ⚠ "), "reason"))
        foot = f.select(*KEY, told.alias("n")).where("n is not null").groupBy(*KEY).agg(F.concat(F.lit("\n\n"), F.array_join(F.array_sort(F.collect_list("n")), "\n")).alias("foot"))
        c = c.join(foot, KEY, "left").withColumn("body", F.concat("body", F.coalesce("foot", F.lit(""))))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no")) == 1
    title = F.when(first & (F.size("path") > 0), F.concat(F.lit("# "), F.array_join("path", " > "), F.lit("\n"))).otherwise("")
    parts = c.select("doc_id", "chunk_no", F.concat(title, F.lit("<!-- "), "chunk_id", F.format_string(" risk=%.2f -->\n", "risk"), "body").alias("t"))
    return parts.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "t"))), lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("markdown"))


def source_html(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, html): a document's pages, each a div with its blocks."""
    return _html(blocks, cells, "page_index", "page")


def target_html(outcome: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, html): a translated document's chunks, each a div classed by its band, with its blocks."""
    band = outcome["scored"].select(*KEY, "chunk_no", "band")
    return _html(outcome["target_blocks"].join(band, KEY), outcome["target_cells"], "chunk_no", "chunk", F.col("band"))


def _html(blocks: DataFrame, cells: DataFrame, group: str, name: str, mark: Column | None = None) -> DataFrame:
    html = tables.to_html(cells, tables.header_rows(cells)).withColumnRenamed("rendered", "__html")
    b = blocks.join(html, "table_id", "left").withColumn("__mark", F.lit("") if mark is None else F.concat(F.lit(" band-"), mark))
    tag = F.when(F.col("heading_level").isNotNull(), F.concat(F.lit("h"), F.least(F.lit(6), "heading_level").cast("string"))).otherwise("p")
    text = F.concat(F.lit("<"), tag, F.lit(">"), F.replace(escape_html(F.col("text")), F.lit("\n"), F.lit("<br/>")), F.lit("</"), tag, F.lit(">"))
    titled = F.when(F.col("caption") != "", F.concat(F.lit("<p><b>"), escape_html(F.col("caption")), F.lit("</b></p>"))).otherwise("")
    said = F.concat(titled, F.lit("<p>"), escape_html(F.coalesce("chart.description", F.lit(""))), F.lit("</p>"))
    part = F.when(F.col("kind") == "text", text).when(F.col("kind") == "table", F.concat(titled, F.coalesce("__html", F.lit("")))).otherwise(said)
    rows = b.groupBy("doc_id", group, "__mark").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "").alias("t"))
    div = F.concat(F.lit(f'<div class="{name}'), "__mark", F.lit(f'" data-{name}="'), F.col(group).cast("string"), F.lit('">'), "t", F.lit("</div>"))
    return rows.select("doc_id", group, div.alias("t")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(group, "t"))), lambda x: x["t"]), "\n").alias("html"))


def write_run(outcome: dict[str, DataFrame], path: str, points: DataFrame | None = None) -> None:
    """A run's outputs in folders under path: target.md (one file line group for each document), report.json (summary by document), chunks.json, findings.json, and the review bundle."""
    md = target_markdown(outcome, points).orderBy("doc_id").withColumn("n", F.monotonically_increasing_id()).select("n", "markdown")  # ranges of documents, no single task
    review.write_lines(md, f"{path}/target.md")
    summary(outcome).write.mode("overwrite").json(f"{path}/report.json")
    outcome["scored"].write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/chunks.json")
    outcome["findings"].write.mode("overwrite").json(f"{path}/findings.json")
    review.write_bundle(review.full(outcome["queue"]), path)


def verdict(findings: DataFrame, applied: int) -> tuple[bool, str]:
    """Whether a trial with `applied` injected faults caught them all: as many figures changed or missing as were injected, and some were."""
    caught = findings.where("kind in ('mismatched', 'missing')").count()
    ok = applied > 0 and caught >= applied
    return ok, f"caught {min(caught, applied)} of {applied} injected fault(s)"


def console(outcome: dict[str, DataFrame], most: int = 20) -> str:
    """Summary, the riskiest items and the first findings, as lines (top-k reports of bounded size)."""
    lines = [" ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in summary(outcome).orderBy("doc_id").limit(most).collect()]
    lines += [f"{r['risk']:.2f} {r['band']:8} {r['chunk_id']}: {', '.join(r['why'])}" for r in outcome["scored"].select("risk", "band", "chunk_id", review.top_reasons(F.col("reasons"), 3).alias("why")).orderBy(F.desc("risk"), "chunk_id").limit(most).collect()]
    lines += [f"{r['kind']}: {r['source_raw']} -> {r['target_raw']} {r['reason']}" for r in outcome["findings"].where("kind <> 'matched'").orderBy("kind", "source_raw").limit(most).collect()]
    return "\n".join(lines)
