"""Chunks of documents: sections packed within a token budget, with terms and context attached."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import estimate_tokens, normalize_whitespace, numeric_density, slugify, tokenize
from ledgerlens.operators import glossary, retrieval, sections

#: What tells that a section is one whose figures are quoted.
FINANCIAL = (
    "财务摘要", "主要财务数据", "主要会计数据", "财务概要", "五年财务", "经营业绩", "综合损益表", "合并损益表", "合并资产负债表", "合并现金流量表", "财务状况表", "每股收益", "股息", "分部资料", "管理层讨论", "经营讨论与分析",
    "financial summary", "financial highlights", "key financial", "consolidated statement", "statement of financial position", "statement of profit or loss", "statement of cash flows",
    "management discussion and analysis", "earnings per share", "segment information", "five-year summary",
)


def is_financial(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether any title of a section path names a part whose figures are quoted."""
    low = F.lower(F.array_join(path, " "))
    return F.exists(F.array(*[F.lit(k.lower()) for k in (*FINANCIAL, *extra)]), lambda k: F.contains(low, k))


def in_sections(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, pos, kind, text, font_size, heading_level, ...) with level, title, rule, span and path.

    A level that the block came with stands before any that its text suggests.
    """
    body = sections.body_font(blocks.where("kind = 'text'"), ["doc_id"])
    b = blocks.join(body, "doc_id", "left")
    sized = (F.col("font_size") > 0) & (F.coalesce("body_font", F.lit(0.0)) > 0)
    found = sections.heading(F.col("text"), F.when(sized, F.col("font_size")), F.when(sized, F.col("body_font")))
    b = b.withColumn("__h", F.when((F.col("kind") == "text") & F.col("heading_level").isNull(), found))
    given = (F.col("kind") == "text") & F.col("heading_level").isNotNull()
    b = b.withColumn("level", F.coalesce(F.when(given, F.col("heading_level")), "__h.level")).withColumn("rule", F.when(given, "prelabelled").otherwise(F.col("__h.rule")))
    b = b.withColumn("title", F.when(F.col("level").isNotNull(), normalize_whitespace(F.col("text"))))
    return sections.section_paths(b.drop("__h", "body_font"), ["doc_id"], "pos")


def outline(sectioned: DataFrame, depth: int = 2) -> DataFrame:
    """(doc_id, line, pos): the path prefixes of up to `depth` titles, each once, in order."""
    line = F.array_join(F.slice("path", 1, depth), " > ")
    return sectioned.select("doc_id", line.alias("line"), "pos").where("line <> ''").groupBy("doc_id", "line").agg(F.min("pos").alias("pos"))


def table_sections(sectioned: DataFrame) -> DataFrame:
    return sectioned.where("table_id is not null").select("table_id", "path")


def plan(blocks: list[dict], max_tokens: int, min_tokens: int, split_level: int, large: float) -> list[tuple[int, int]]:
    """(span, chunk within it) of each block of a document, in order; blocks hold span, path, table, level (given ones only), tokens.

    A span begins charged with its heading. A table stays whole: one of more than `large` of the budget begins a chunk, one beyond the budget is a
    chunk of its own. A given heading of `split_level` or above begins a chunk; so does what would pass the budget.
    """
    out: list[tuple[int, int]] = []
    span, chunk, used, held, heading = None, 0, 0, 0, 0
    for b in blocks:
        if b["span"] != span:
            span, chunk, held = b["span"], 0, 0
            heading = next((x["tokens"] for x in blocks if x["span"] == span and x["level"] is not None), 0)
            used = heading
        cost = b["tokens"]
        major = not b["table"] and b["level"] is not None and b["level"] <= split_level
        if held and (b["table"] and cost > max_tokens * large or major or used + cost > max_tokens):
            chunk, used, held = chunk + 1, heading, 0
        out.append((span, chunk))
        used, held = used + cost, held + 1
        if b["table"] and held == 1 and cost > max_tokens:
            chunk, used, held = chunk + 1, heading, 0
    return out


def _placed(docs: pa.Array, planner) -> pa.Array:
    """The (span, chunk) of each document's blocks. Blocks become Python's objects one document at a time: a batch holds thousands of documents."""
    ends, spans, numbers = [0], [], []
    for doc in docs:
        for span, number in planner(doc.as_py()):
            spans.append(span)
            numbers.append(number)
        ends.append(len(spans))
    places = pa.StructArray.from_arrays([pa.array(spans, pa.int32()), pa.array(numbers, pa.int32())], ["span", "chunk"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)


def pack(sectioned: DataFrame, max_tokens: int = 1400, min_tokens: int = 60, split_level: int = 2, large: float = 0.5, counter=estimate_tokens) -> DataFrame:
    """Blocks (of in_sections, with `rendered`) with chunk_no and chunk_id of their document.

    Packing is a fold over a document's block sizes: these few numbers a block (no texts) are gathered by document, and folded in Arrow batches of
    many documents. `counter` makes a Column of tokens of a Column of text.
    """
    sized = sectioned.select("doc_id", "pos", "span", "path", (F.col("kind") == "table").alias("table"), F.when(F.col("kind") == "text", F.col("heading_level")).alias("level"), counter(F.col("rendered")).cast("int").alias("tokens"))
    facts = F.struct("pos", "span", "table", "level", "tokens")
    gathered = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(facts)).alias("b"))

    @F.arrow_udf("array<struct<span: int, chunk: int>>")
    def planned(docs: pa.Array) -> pa.Array:
        return _placed(docs, lambda blocks: plan(blocks, max_tokens, min_tokens, split_level, large))

    placed = gathered.select("doc_id", F.explode(F.arrays_zip(F.col("b.pos").alias("pos"), planned("b").alias("c"))).alias("x")).select("doc_id", "x.pos", F.col("x.c.chunk").alias("part"))
    out = sectioned.join(placed, ["doc_id", "pos"])
    # spans count from 0, whether or not blocks stand before the first heading
    ordinal = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("span")) - 1
    name = slugify(F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("section")), 24)
    return out.withColumn("span_no", ordinal).withColumn("chunk_id", F.concat(F.format_string("c%03d-%02d-", "span_no", "part"), name))


def _merge(chunks: list[dict], min_tokens: int, max_tokens: int) -> list[int]:
    """For each chunk the place of the one that it is folded into: a small one without tables joins the one before it in the same section if both fit."""
    out, kept, size = [], -1, 0
    for i, c in enumerate(chunks):
        same = kept >= 0 and chunks[kept]["path"] == c["path"]
        if same and c["tokens"] < min_tokens and not c["tables"] and size + c["tokens"] <= max_tokens:
            size += c["tokens"]
        else:
            kept, size = i, c["tokens"]
        out.append(kept)
    return out


def build(sectioned: DataFrame, terms: DataFrame | None = None, max_tokens: int = 1400, min_tokens: int = 60, context: int = 480, counter=estimate_tokens, retrieve: int = 0, **options) -> tuple[DataFrame, DataFrame]:
    """(chunks, blocks with their chunk_id): doc_id, chunk_no, chunk_id, path, page_start, page_end, source_text, tokens, density, is_financial, n_tables, table_positions, prefix_context, terms, unknown_terms.

    Small chunks join the one before; the last `context` characters before are context that is not translated; of `terms` (key, source, target, aliases) a
    chunk has those in its text, the longest first, then with `retrieve` those of the so many nearest ones by TF-IDF that are not, 40 at most; or else those of the chunk before that has any.
    """
    packed = pack(sectioned, max_tokens, min_tokens, counter=counter, **options)
    first = packed.groupBy("doc_id", "chunk_id").agg(F.min("pos").alias("at"), F.first("path").alias("path"), F.bool_or(F.col("kind") == "table").alias("tables"), counter(_joined("rendered")).cast("int").alias("tokens"))
    gathered = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "path", "tables", "tokens"))).alias("c"))

    @F.pandas_udf("array<int>")
    def merged(docs: pd.Series) -> pd.Series:
        return pd.Series([_merge([dict(c) | {"path": list(c["path"])} for c in d], min_tokens, max_tokens) for d in docs], dtype=object)

    into = gathered.select("doc_id", "c", F.posexplode(merged("c")).alias("i", "k")).select("doc_id", F.get("c", F.col("i"))["chunk_id"].alias("chunk_id"), F.get("c", F.col("k"))["chunk_id"].alias("into"), F.col("k").alias("chunk_order"))
    blocks = packed.join(into, ["doc_id", "chunk_id"]).withColumn("chunk_id", F.col("into")).drop("into")
    within = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("pos")) - 1
    blocks = blocks.withColumn("place", within)
    c = blocks.groupBy("doc_id", "chunk_id", "chunk_order").agg(
        F.first("path").alias("path"), F.min("page_index").alias("page_start"), F.max("page_index").alias("page_end"), _joined("rendered").alias("source_text"), F.count_if(F.col("kind") == "table").alias("n_tables"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "table", F.col("place")))).alias("table_positions"),
    )
    w = Window.partitionBy("doc_id").orderBy("chunk_order")
    c = c.withColumn("chunk_no", F.row_number().over(w) - 1).drop("chunk_order")
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    before = F.lag("source_text").over(w)
    c = c.withColumn("tokens", counter(F.col("source_text"))).withColumn("density", numeric_density(F.col("source_text"))).withColumn("is_financial", is_financial(F.col("path")))
    c = c.withColumn("prefix_context", F.coalesce(normalize_whitespace(F.right(before, F.lit(context)), True), F.lit("")))
    none = F.array().cast("array<struct<source: string, target: string>>")
    if terms is None:
        return c.withColumn("terms", none).withColumn("unknown_terms", F.slice(glossary.candidates(F.col("source_text")), 1, 30)), blocks
    key = ["doc_id", "chunk_no"]
    found = glossary.text_terms(c.select(*key, "source_text"), key, "source_text", terms)
    c = c.join(found, key, "left")
    if retrieve:
        near = retrieved_terms(c, terms, retrieve).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("source", "target").alias("t")))), lambda x: x["t"]).alias("near"))
        c = c.join(near, key, "left").withColumn("found", F.concat(F.coalesce("found", none), F.coalesce("near", none))).drop("near")
    own = F.nullif(F.slice("found", 1, 40), none)
    c = c.withColumn("terms", F.coalesce(own, F.last(own, ignorenulls=True).over(w), none))
    seen = F.coalesce(F.col("found.source"), F.array().cast("array<string>"))
    return c.withColumn("unknown_terms", F.array_except(F.slice(glossary.candidates(F.col("source_text"), known=seen), 1, 30), seen)).drop("found"), blocks


def retrieved_terms(chunks: DataFrame, terms: DataFrame, k: int = 8) -> DataFrame:
    """(doc_id, chunk_no, source, target, rank): of the k terms that are nearest to a chunk's section and first 400 characters by TF-IDF, those whose source and aliases are not in its text."""
    aliases = F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ") if "aliases" in terms.columns else F.lit("")
    named = terms.groupBy("source").agg(F.min("target").alias("target"), F.first(aliases).alias("aliases"))
    corpus = retrieval.postings(named, "source", tokenize(F.concat_ws(" ", "source", "target", "aliases")))
    asked = chunks.select(F.xxhash64("doc_id", "chunk_no").alias("__q"), F.concat_ws(" ", F.array_join("path", " "), F.substring("source_text", 1, 400)).alias("t"))
    near = retrieval.tfidf_search(corpus, retrieval.postings(asked, "__q", tokenize(F.col("t"))), "source", "__q", k)
    held = chunks.select("doc_id", "chunk_no", F.xxhash64("doc_id", "chunk_no").alias("__q"), F.coalesce("found.source", F.array().cast("array<string>")).alias("held"))
    out = held.join(near, "__q").where(~F.array_contains("held", F.col("source"))).join(named, "source")
    return out.select("doc_id", "chunk_no", "source", "target", "rank")


def _joined(column: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", column))), lambda x: x[column]), "\n\n")


def stats(chunks: DataFrame) -> DataFrame:
    """One row for each document: chunks, token_min, token_max, token_mean, with_tables, financial, mean_density, sections, unknown_terms."""
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.min("tokens").alias("token_min"), F.max("tokens").alias("token_max"), F.round(F.avg("tokens"), 1).alias("token_mean"), F.count_if(F.col("n_tables") > 0).alias("with_tables"),
        F.count_if("is_financial").alias("financial"), F.round(F.avg("density"), 4).alias("mean_density"), F.count_distinct("path").alias("sections"), F.sum(F.size("unknown_terms")).alias("unknown_terms"),
    )
