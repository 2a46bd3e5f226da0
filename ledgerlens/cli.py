"""Command line: python -m ledgerlens.cli parse|chunk|translate|review|inspect|demo."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import agents, chunks, documents, models, report, review, tables, translate
from ledgerlens.sources import documents as sources
from ledgerlens.sources import layout


def _session() -> SparkSession:
    return SparkSession.builder.appName("ledgerlens").getOrCreate()


def _show(df: DataFrame, most: int = 20) -> None:
    for row in df.limit(most).collect():
        print(json.dumps(row.asDict(True), ensure_ascii=False, default=str))


def _parsed(spark: SparkSession, source: str | None) -> dict[str, DataFrame]:
    if source is None:
        return sources.parse(sources.fixture(spark))
    found = sources.read_any(spark, source)
    if "blocks" not in found:
        raise ValueError("page images need an analyzer: use the library's perception.analyze first")
    return found | {"blocks": documents.block_text(found["blocks"], found["cells"], found["tables"])}


def parse(a, spark) -> None:
    p = _parsed(spark, a.source)
    _show(documents.document_stats(p["blocks"], p["cells"], p["tables"]))
    for r in tables.preview(p["cells"]).limit(a.limit).collect():
        print(f"{r['table_id']}\n{r['rendered']}")
    if a.out:
        sources.write_documents(sources.to_documents(p["blocks"], p["tables"], p["cells"], p["conflicts"]), a.out)


def chunk(a, spark) -> None:
    made, _ = chunks.build(chunks.in_sections(_parsed(spark, a.source)["blocks"]), max_tokens=a.max_tokens)
    _show(chunks.stats(made))
    _show(made.select("doc_id", "chunk_id", "path", "tokens", "n_tables", "is_financial").orderBy("doc_id", "chunk_id"), a.limit)


def run_translation(a, spark) -> None:
    outcome = report.run(_parsed(spark, a.source), models.make_model(a.llm), options=agents.Options(language=a.language), threshold=a.threshold)
    print(report.console(outcome, a.limit))
    if a.out:
        report.write_run(outcome, a.out)


def review_queue(a, spark) -> None:
    queue = review.full(layout.read_queue(spark, a.source))
    if a.approve or a.reject:
        asked = spark.createDataFrame([(i, "approved") for i in a.approve or []] + [(i, "rejected") for i in a.reject or []], "id string, status string")
        named = review.resolve(asked.select("id"), queue).join(asked, "id")
        queue = review.decide(queue, named.select(F.coalesce("item_id", "id").alias("item_id"), "status", F.lit(a.reviewer).alias("reviewer")))
        review.save(queue, a.out or a.source.rstrip("/") + ".decided")
    _show(review.stats(queue))
    _show(review.listing(queue, a.status, a.limit).select("item_id", "chunk_id", "risk", "status"))


def inspect(a, spark) -> None:
    p = _parsed(spark, a.source)
    for r in p["tables"].limit(a.limit).collect():
        print(r["table_id"], f"{r['n_rows']}x{r['n_cols']}", r["units_note"], list(r["warnings"]))
    _show(tables.problems(p["tables"], p["cells"]), a.limit)
    _show(p["conflicts"], a.limit)


def demo(a, spark) -> int:
    """Injects faults into the figures of a document's tables and tells whether the comparison finds them all."""
    p = _parsed(spark, a.source)
    cells = p["cells"].withColumn("key", F.concat_ws("/", "table_id", "row", "col"))
    bad = translate.corrupt(cells, "key", "text", a.faults)
    applied = bad.where("fault is not null").count()
    from ledgerlens.operators import numdiff

    found = numdiff.check_table_pairs(p["cells"], bad.withColumn("text", F.col("target_text")), p["tables"], p["tables"])
    ok, text = report.verdict(found, applied)
    print(text)
    return 0 if ok else 1


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="ledgerlens")
    sub = top.add_subparsers(dest="command", required=True)
    for name, call in (("parse", parse), ("chunk", chunk), ("translate", run_translation), ("review", review_queue), ("inspect", inspect), ("demo", demo)):
        c = sub.add_parser(name)
        c.set_defaults(call=call)
        c.add_argument("source", nargs=None if name == "review" else "?")
        c.add_argument("--out")
        c.add_argument("--limit", type=int, default=20)
        if name == "chunk":
            c.add_argument("--max-tokens", type=int, default=1400)
        elif name == "translate":
            c.add_argument("--llm", default="auto")
            c.add_argument("--language", default="Chinese")
            c.add_argument("--threshold", type=float, default=0.45)
        elif name == "review":
            c.add_argument("--status")
            c.add_argument("--approve", nargs="*")
            c.add_argument("--reject", nargs="*")
            c.add_argument("--reviewer", default="")
        elif name == "demo":
            c.add_argument("--faults", type=int, default=2)
    a = top.parse_args(argv)
    sources.settings(".env")
    try:
        return a.call(a, _session()) or 0
    except (FileNotFoundError, ValueError, KeyError, models.ModelError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
