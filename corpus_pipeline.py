"""The corpus pipeline: documents to packed training sequences, stage by stage over Parquet.

Every stage reads the columns of documents by name; further columns, clashing names among them, are left out. In all stages a null text is
judged as an empty one and stays null, null identifiers are kept (they can't be told apart, so near_dup keeps all of them), repeated rows are treated
alike, very long texts are read whole, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.catalogue import table
from ledgerlens.llm.common import Scratch, passing
from ledgerlens.llm.line_dedup import drop_recurring_lines
from ledgerlens.llm.mixing import apply_mix
from ledgerlens.llm.packing import pack
from ledgerlens.llm.simhash import near_dedup
from ledgerlens.llm.toxicity import drop_toxic, fit_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go; equal texts share their score, and empty ones stay."""
    docs = docs.select(COLUMNS)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return drop_toxic(docs, model).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut out of the texts; n_chars follows. A document of which nothing would be left stays whole."""
    cut = drop_recurring_lines(docs.select(COLUMNS))
    return cut.selectExpr("doc_id", "text", "lang", "source", "if(size(dropped) > 0, cast(char_length(text) as bigint), n_chars) as n_chars")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, agreement 0.8 or more) the smallest doc_id stays; of rows that repeat it, the one with the smallest text."""
    return near_dedup(docs.select(COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as their fitted rates say; rows of equal doc_id and text alike."""
    return apply_mix(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; an empty text is one token."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dup", near_dup), ("mixing", mixing), ("packing", packing)]

#: A classifier, a fitted labeller and a fingerprint search are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each is written as Parquet in the shared folder and read again, and what it needed meanwhile goes."""
    scratch, written = Scratch(spark), []
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with passing():
            written.append(docs := scratch.table(stage(spark, docs, sf_dir)))
        scratch.drop(*written[:-1])
        del written[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
