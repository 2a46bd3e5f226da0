"""The review queue: identifiers, upserts that keep decisions, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import escape_html

STATUSES = ("pending", "approved", "rejected", "edited")


def item_id(chunk_id: Column) -> Column:
    return F.concat(F.lit("rv-"), F.substring(F.sha1(chunk_id.cast("string")), 1, 10))


#: What a queue holds beside item_id, chunk_id, risk, target_text, status and note; queues may lack any of it.
OPTIONAL = {
    "reviewer": "string", "created_at": "string", "decided_at": "string", "band": "string", "is_financial": "boolean", "page_start": "int", "page_end": "int", "section_path": "array<string>", "source_text": "string",
    "reasons": "array<struct<name: string, contribution: double, detail: string, severity: string>>", "measures": "map<string,bigint>", "errors": "array<string>", "tables": "array<struct<caption: string, units_note: string, target_html: string>>",
}


def full(queue: DataFrame) -> DataFrame:
    """queue with every optional column, null where it has none."""
    for name, kind in OPTIONAL.items():
        if name not in queue.columns:
            queue = queue.withColumn(name, F.lit(None).cast(kind))
    for name in ("status", "note"):
        if name not in queue.columns:
            queue = queue.withColumn(name, F.lit("pending" if name == "status" else ""))
    return queue


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Queue after a new run: item_id, chunk_id, risk, target_text, status, note and whatever optional columns either side has.

    An item whose risk and target text are as before keeps its decision; a changed one is open again, and a note says what it was; items
    that the run does not mention stay, and so does the time at which an item first came. One full outer join on item_id and chunk_id: the
    identifier holds 40 bits of a digest, so in a queue of millions some chunks share one.
    """
    mine = ("status", "note", "reviewer", "decided_at", "created_at")
    extra = [c for c in OPTIONAL if c in existing.columns or c in incoming.columns]
    e, i = full(existing), full(incoming)
    names = ["chunk_id", "risk", "target_text", *[c for c in extra if c not in mine]]
    e = e.select(F.col("item_id").alias("e_item"), *[F.col(c).alias(f"e_{c}") for c in (*names, *mine)], F.lit(True).alias("e_here"))
    i = i.select(F.col("item_id").alias("i_item"), *[F.col(c).alias(f"i_{c}") for c in (*names, "created_at")], F.lit(True).alias("i_here"))
    j = e.join(i, (F.col("e_item") == F.col("i_item")) & F.col("e_chunk_id").eqNullSafe(F.col("i_chunk_id")), "full_outer").withColumn("item_id", F.coalesce("e_item", "i_item"))
    gone, new = F.col("i_here").isNull(), F.col("e_here").isNull()
    same = F.col("e_risk").eqNullSafe(F.col("i_risk")) & F.col("e_target_text").eqNullSafe(F.col("i_target_text"))
    keep, decided = gone | same, F.col("e_status") != "pending"
    by = F.when(F.coalesce("e_reviewer", F.lit("")) != "", F.concat(F.lit(" by "), "e_reviewer")).otherwise("")
    reopened = F.when(decided, F.concat(F.format_string("reopened on re-run: evidence changed (risk was %.2f, previously ", F.col("e_risk").cast("double")), "e_status", by, F.lit(")"))).otherwise("")
    out = [F.when(gone, F.col(f"e_{c}")).otherwise(F.col(f"i_{c}")).alias(c) for c in names]
    out += [F.when(new, "pending").when(keep, F.col("e_status")).otherwise("pending").alias("status"), F.when(new, "").when(gone | (same & decided), F.col("e_note")).otherwise(F.when(same, "").otherwise(reopened)).alias("note")]
    kept = {"reviewer": F.when(keep, F.col("e_reviewer")), "decided_at": F.when(keep, F.col("e_decided_at")), "created_at": F.coalesce("e_created_at", "i_created_at")}
    return j.select("item_id", *out, *[v.alias(k) for k, v in kept.items() if k in extra])


def decide(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue with decisions (item_id, status, and chunk_id, reviewer, note, decided_at if given) applied, all or none: an unknown item or status is an error, and so is an item_id without chunk_id that several chunks share."""
    key = ["item_id", "chunk_id"] if "chunk_id" in decisions.columns else ["item_id"]
    bad = decisions.where(~F.col("status").isin(*STATUSES)).select("item_id").union(decisions.join(queue, key, "left_anti").select("item_id"))
    if named := [r[0] for r in bad.limit(5).collect()]:
        raise ValueError(f"unknown items or statuses: {named}")
    if "chunk_id" in queue.columns and "chunk_id" not in decisions.columns:
        shared = queue.join(decisions.select("item_id").distinct(), "item_id", "left_semi").groupBy("item_id").agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).where("a <> b")
        if named := [r[0] for r in shared.limit(5).collect()]:
            raise ValueError(f"items of several chunks, name the chunk too: {named}")
    given = [c for c in ("status", "reviewer", "note", "decided_at") if c in decisions.columns]
    for c in given:
        if c not in queue.columns:
            queue = queue.withColumn(c, F.lit(None).cast("string"))
    d = decisions.select(*key, *[F.col(c).alias(f"__{c}") for c in given])
    out = queue.join(d, key, "left")
    for c in given:
        out = out.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out


def resolve(ids: DataFrame, queue: DataFrame) -> DataFrame:
    """ids (id) with item_id: the item of that identifier, else the only item of the chunk of that name; null where neither is."""
    chunks = queue.groupBy(F.col("chunk_id").cast("string").alias("id")).agg(F.min("item_id").alias("by_chunk"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    items = queue.select(F.col("item_id").alias("id"), F.col("item_id").alias("by_item")).distinct()
    return ids.join(items, "id", "left").join(chunks, "id", "left").select("id", F.coalesce("by_item", "by_chunk").alias("item_id"))


def with_status(queue: DataFrame, status: str) -> DataFrame:
    return queue.where(F.col("status") == status)


def by_risk(queue: DataFrame) -> DataFrame:
    """Items in the order of falling risk, then of their identifiers."""
    return queue.orderBy(F.desc_nulls_last("risk"), "item_id")


def listing(queue: DataFrame, status: str | None = None, limit: int = 20) -> DataFrame:
    """The `limit` riskiest items, of one status if it is given (a top-k report)."""
    return by_risk(queue if status is None else with_status(queue, status)).limit(limit)


def stats(queue: DataFrame) -> DataFrame:
    """One row: total, one column for each status, financial_pending, max_risk."""
    q = full(queue)
    by = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return q.agg(F.count(F.lit(1)).alias("total"), *by, F.count_if((F.col("status") == "pending") & F.coalesce("is_financial", F.lit(False))).alias("financial_pending"), F.round(F.coalesce(F.max(F.col("risk").cast("double")), F.lit(0.0)), 4).alias("max_risk"))


def top_reasons(reasons: Column, most: int = 4) -> Column:
    """Names of the reasons of the largest contributions."""
    order = F.array_sort(reasons, lambda a, b: F.when(a["contribution"] > b["contribution"], -1).when(a["contribution"] < b["contribution"], 1).otherwise(0))
    return F.transform(F.slice(order, 1, most), lambda r: r["name"])


def save(queue: DataFrame, path: str, form: str = "jsonl") -> None:
    """The whole queue as JSON Lines; with form "json" as one array, its items in the lines between."""
    if form == "jsonl":
        queue.write.mode("overwrite").option("ignoreNullFields", False).json(path)
        return
    q = numbered(queue).select("n", F.to_json(F.struct(*[F.col(c) for c in queue.columns])).alias("j"))
    last = queue.count()
    lines = q.select("n", F.concat(F.when(F.col("n") == 1, "[").otherwise(""), "j", F.when(F.col("n") == last, "]").otherwise(",")).alias("value"))
    write_lines(lines, path)


def append(items: DataFrame, path: str) -> None:
    """Items added to a queue of JSON Lines, without rewriting it; the reader takes the last of an item."""
    items.write.mode("append").option("ignoreNullFields", False).json(path)


def dedupe(items: DataFrame) -> DataFrame:
    """Of each chunk the item of the highest risk, the first among equals (ord)."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc("risk"), "ord")
    return items.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def csv_rows(queue: DataFrame, include_text: bool = False, cut: int = 500, more: tuple[str, ...] = ()) -> DataFrame:
    """Text columns of the CSV export, and the queue's columns `more`; write by_risk of it, with a header."""
    q = full(queue)
    words = lambda c, sep: F.array_join(F.coalesce(c, F.array().cast("array<string>")), sep)
    named = F.transform("reasons", lambda r: r.withField("contribution", F.coalesce(r["contribution"], F.lit(0.0))))
    columns = [
        "item_id", "chunk_id", "status", F.format_string("%.3f", F.col("risk").cast("double")).alias("risk"), F.coalesce("band", F.lit("")).alias("band"), F.when(F.col("is_financial"), "yes").otherwise("").alias("financial"),
        F.when(F.col("page_start").isNotNull(), F.format_string("%d-%d", "page_start", "page_end")).otherwise("").alias("pages"), words(F.col("section_path"), " > ").alias("section"), words(top_reasons(named), " | ").alias("reasons"),
        F.coalesce("reviewer", F.lit("")).alias("reviewer"), F.coalesce("note", F.lit("")).alias("note"),
    ]
    if include_text:
        columns += [F.substring(F.coalesce(c, F.lit("")), 1, cut).alias(c) for c in ("source_text", "target_text")]
    return q.select(*columns, *more)


def numbered(queue: DataFrame, parts: int = 64) -> DataFrame:
    """queue with n, the rank of each item by risk, then identifier, from 1.

    Numbered within ranges of (risk, item_id) that begin at the `parts` rows of the smallest hashes, and on from the ranges' sizes.
    """
    q = queue.withColumns({"__r": F.coalesce(F.col("risk").cast("double"), F.lit(float("-inf"))), "__i": F.coalesce(F.col("item_id").cast("string"), F.lit(""))})
    begins = q.select("__r", "__i").distinct().orderBy(F.xxhash64("__i", "__r"), "__i", "__r").limit(parts).collect()  # bounded by parts
    starts = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(i).alias("i")) for r, i in begins]) if begins else None
    before = lambda b: (b["r"] > F.col("__r")) | ((b["r"] == F.col("__r")) & (b["i"] <= F.col("__i")))
    q = q.withColumn("__part", F.lit(0) if starts is None else F.size(F.filter(starts, before)))
    sizes = dict(q.groupBy("__part").count().collect())  # at most parts + 1 rows
    base = F.element_at(F.array(*[F.lit(sum(n for p, n in sizes.items() if p < part)).cast("bigint") for part in range(parts + 1)]), F.col("__part") + 1)
    w = Window.partitionBy("__part").orderBy(F.desc("__r"), "__i")
    return q.withColumn("n", base + F.row_number().over(w)).drop("__r", "__i", "__part")


def sheet(queue: DataFrame) -> DataFrame:
    """A Markdown line for each item, by rank of risk."""
    return numbered(queue).select("n", F.format_string("## %s (risk %.3f, %s)", "item_id", F.col("risk").cast("double"), "status").alias("line"))


#: Measures of a chunk that a reviewer is shown, with what is said of each.
MEASURES = {
    "numbers_mismatched": "figure(s) changed value", "numbers_missing": "source figure(s) missing from the target", "number_structural": "structural issue(s) (e.g. dropped unit note)", "table_merge_conflicts": "table merge conflict(s)",
    "table_holes": "uncovered table slot(s)", "untranslated_label_cells": "untranslated label cell(s)", "charts_unresolved": "chart(s) with no recovered data",
}


def _findings(line) -> Column:
    """Lines for the measures above zero, then for the errors."""
    count = lambda k: F.coalesce(F.try_element_at("measures", F.lit(k)), F.lit(0))
    said = [F.when(count(k) > 0, line(F.concat(count(k).cast("string"), F.lit(f" {text}")))) for k, text in MEASURES.items()]
    failed = F.transform(F.coalesce("errors", F.array().cast("array<string>")), lambda e: line(F.concat(F.lit("ERROR: "), e)))
    return F.concat(F.array_compact(F.array(*said)), failed)


def _by_weight(reasons: str) -> Column:
    none = F.array().cast(OPTIONAL["reasons"])
    return F.array_sort(F.coalesce(reasons, none), lambda a, b: F.when(a["contribution"] > b["contribution"], -1).when(a["contribution"] < b["contribution"], 1).otherwise(0))


def item_markdown(queue: DataFrame) -> DataFrame:
    """(item_id, text): each item with its section, pages, reasons by weight, figures to look at, source and target quoted, and tables as HTML."""
    return _markdown(queue, "item_id")


def _markdown(queue: DataFrame, *columns: str) -> DataFrame:
    q = full(queue)
    lines = lambda head, body: F.when(F.size(body) > 0, F.concat(F.lit(f"**{head}**\n\n"), F.array_join(body, "\n"), F.lit("\n\n"))).otherwise("")
    reasons = F.transform(_by_weight("reasons"), lambda r: F.concat(F.format_string("- `+%.2f` **", r["contribution"]), r["name"], F.lit("** — "), F.coalesce(r["detail"], F.lit(""))))
    quoted = lambda head, c: F.concat(F.lit(f"**{head}**\n\n> "), F.coalesce(F.nullif(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit("\n> ")), F.lit("")), F.lit("_(empty)_")), F.lit("\n\n"))
    one = lambda t, i: F.concat(F.format_string("**Table %d: ", i + 1), F.coalesce(F.nullif(t["caption"], F.lit("")), F.lit("(untitled)")), F.lit("**\n\n- units note: `"), F.coalesce(F.nullif(t["units_note"], F.lit("")), F.lit("(none)")), F.lit("`\n\n```html\n"), F.trim(F.coalesce(t["target_html"], F.lit(""))), F.lit("\n```\n\n"))
    section = F.coalesce(F.nullif(F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > "), F.lit("")), F.lit("(none)"))
    pages = F.when(F.col("page_start").isNotNull(), F.format_string("%d–%d", "page_start", "page_end")).otherwise("")
    reviewer = F.when(F.coalesce("reviewer", F.lit("")) != "", F.concat(F.lit(" · reviewer `"), "reviewer", F.lit("`"))).otherwise("")
    text = F.concat(
        F.lit("### `"), F.col("chunk_id").cast("string"), F.format_string("` — risk %.2f (", F.coalesce(F.col("risk").cast("double"), F.lit(0.0))), F.coalesce("band", F.lit("?")), F.lit(")\n\n- **Section**: "), section, F.lit("\n- **Pages**: "), pages,
        F.lit("\n- **Financial summary**: "), F.when(F.coalesce("is_financial", F.lit(False)), "yes — lowered threshold applies").otherwise("no"), F.lit("\n- **Status**: `"), F.col("status"), F.lit("`"), reviewer, F.lit("\n\n"),
        lines("Why it was flagged", reasons), lines("Figures that need attention", _findings(lambda t: F.concat(F.lit("- "), t))), quoted("Source", "source_text"), quoted("Target", "target_text"),
        F.array_join(F.transform(F.coalesce("tables", F.array().cast(OPTIONAL["tables"])), one), ""), F.lit("<!-- item_id: "), "item_id", F.lit(" -->\n"),
    )
    return q.select(*columns, text.alias("text"))


def item_html(queue: DataFrame) -> DataFrame:
    """(item_id, text): each item as a section with source and target side by side, classed by its band."""
    return _html(queue, "item_id")


def _html(queue: DataFrame, *columns: str) -> DataFrame:
    q = full(queue)
    safe = lambda c: escape_html(F.coalesce(c, F.lit("")))
    items = lambda body: F.when(F.size(body) > 0, F.concat(F.lit("<ul>"), F.array_join(body, ""), F.lit("</ul>"))).otherwise("")
    reasons = F.transform(_by_weight("reasons"), lambda r: F.concat(F.format_string("<li><b>+%.2f</b> ", r["contribution"]), safe(r["name"]), F.lit(": "), safe(r["detail"]), F.lit("</li>")))
    found = _findings(lambda t: F.concat(F.lit("<li>"), escape_html(t), F.lit("</li>")))
    side = lambda name, c: F.concat(F.lit(f'<div class="{name}"><h4>{name}</h4><pre>'), safe(F.col(c)), F.lit("</pre></div>"))
    shown = F.array_join(F.transform(F.coalesce("tables", F.array().cast(OPTIONAL["tables"])), lambda t: F.coalesce(t["target_html"], F.lit(""))), "")
    text = F.concat(
        F.lit('<section class="item band-'), safe(F.coalesce("band", F.lit("none"))), F.lit('" id="'), safe(F.col("item_id")), F.lit('"><h3>'), safe(F.col("chunk_id").cast("string")), F.format_string(" <small>risk %.2f</small></h3>", F.coalesce(F.col("risk").cast("double"), F.lit(0.0))),
        F.lit("<p>"), safe(F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")), F.lit(" · "), safe(F.col("status")), F.lit("</p>"), items(reasons), items(found),
        F.lit('<div class="pair">'), side("source", "source_text"), side("target", "target_text"), F.lit("</div>"), shown, F.lit("</section>"),
    )
    return q.select(*columns, text.alias("text"))


def full_sheet(queue: DataFrame, html: bool = False, title: str = "Human review sheet") -> DataFrame:
    """(n, text): the review sheet in parts: its head with the queue's statistics at n 0, every item by risk after it; write with write_lines."""
    parts = (_html if html else _markdown)(numbered(queue), "n")
    s = stats(queue)
    told = F.format_string("%d flagged chunk(s) · %d pending · %d touching financial statements · highest risk %.2f", "total", "pending", "financial_pending", "max_risk")
    nothing = F.when(F.col("total") == 0, "Nothing requires review.").otherwise("")
    if html:
        style = ".pair{display:flex;gap:1em}.pair div{flex:1}pre{white-space:pre-wrap}.band-blocked,.band-review{border-left:4px solid #c00}.band-watch{border-left:4px solid #c90}"
        head = F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>{style}</style></head><body><h1>{title}</h1><p>'), told, F.lit("</p><p>"), nothing, F.lit("</p>"))
        end = s.select(F.lit(1 << 62).alias("n"), F.lit("</body></html>").alias("text"))
        return s.select(F.lit(0).cast("bigint").alias("n"), head.alias("text")).union(parts.select("n", "text")).union(end)
    head = F.concat(F.lit(f"# {title}\n\n_"), told, F.lit("_\n\nItems are ordered by risk, highest first. Figures were compared by code, not by the model judging its own output.\n\n---\n"), F.when(nothing != "", F.concat(F.lit("\n_"), nothing, F.lit("_"))).otherwise(""))
    return s.select(F.lit(0).cast("bigint").alias("n"), head.alias("text")).union(parts.select("n", F.concat("text", F.lit("\n---\n"))))


def write_lines(parts: DataFrame, path: str) -> None:
    """Texts in the order of n, in text files whose names sort in that order."""
    c = [c for c in parts.columns if c != "n"][0]
    ranged = parts.repartitionByRange("n").sortWithinPartitions("n").select(c)
    ranged.write.mode("overwrite").text(path)


def write_bundle(queue: DataFrame, path: str) -> None:
    """The queue for reviewers: review.md, review.html, review.csv (with a byte order mark, so that spreadsheets read it as UTF-8) and review.jsonl, each a folder under path."""
    write_lines(full_sheet(queue), f"{path}/review.md")
    write_lines(full_sheet(queue, html=True), f"{path}/review.html")
    rows = csv_rows(numbered(queue), include_text=True, more=("n",))
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    columns = [c for c in rows.columns if c != "n"]
    lines = rows.select("n", F.array_join(F.array(*[cell(c) for c in columns]), ",").alias("line"))
    head = queue.sparkSession.createDataFrame([(0, "\ufeff" + ",".join(columns))], "n bigint, line string")
    write_lines(head.union(lines), f"{path}/review.csv")
    save(queue, f"{path}/review.jsonl")


def histogram(queue: DataFrame) -> DataFrame:
    """(reason, n): how many items have each reason; order by n, falling."""
    return queue.select(F.explode("reasons.name").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
