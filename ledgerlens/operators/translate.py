"""Model payloads and replies: what may be sent, what comes back, and a deterministic test double."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.figures import MONTH
from ledgerlens.functions.text import looks_numeric

#: What marks a text as one with a date.
DATED = "[年月日号]|" + MONTH


def payload(cells: DataFrame, table: str = "table_id") -> DataFrame:
    """(table, payload, n_labels, n_numeric): JSON of the label cells alone; figures are copied by code and never sent."""
    label = (~looks_numeric(F.col("text"))) & (F.trim("text") != "")
    slots = F.array_sort(F.collect_list(F.when(label, F.struct("row", "col", "text"))))
    return cells.groupBy(table).agg(F.to_json(slots).alias("payload"), F.count_if(label).alias("n_labels"), F.count_if(looks_numeric(F.col("text"))).alias("n_numeric"))


def leaks(cells: DataFrame, payloads: DataFrame, table: str = "table_id") -> DataFrame:
    """Numeric cells whose text stands as a text in the payload of their table."""
    numeric = cells.where(looks_numeric(F.col("text")) & F.col("text").rlike("[0-9]"))
    return numeric.join(payloads.select(table, "payload"), table).where(F.contains("payload", F.concat(F.lit('"text":"'), "text", F.lit('"')))).select(table, "row", "col", "text")


def apply_translations(cells: DataFrame, translations: DataFrame, keys: list[str]) -> DataFrame:
    """Adds target_text: the translation, or the source text where it is blank or missing."""
    t = translations.select(*keys, F.col("translated").alias("__t"))
    return cells.join(t, keys, "left").withColumn("target_text", F.coalesce(F.nullif(F.trim("__t"), F.lit("")), "text")).drop("__t")


def corrupt(texts: DataFrame, key: str, text: str, faults: int) -> DataFrame:
    """Adds target_text, in which one digit of a figure is changed, for the `faults` eligible rows of the smallest hash (MD5 of the key); and fault.

    Eligible are texts with a digit above 0 in a figure that is no part of a date.
    """
    eligible = F.col(text).rlike("[1-9]") & ~F.col(text).rlike(DATED)
    order = Window.orderBy(F.md5(F.col(key).cast("string")), key)
    chosen = texts.where(eligible).select(key).orderBy(F.md5(F.col(key).cast("string")), key).limit(faults).withColumn("fault", F.row_number().over(order))
    first = F.regexp_extract(text, "[1-9]", 0)
    changed = F.regexp_replace(F.col(text), F.lit("^([^1-9]*)[1-9]"), F.concat(F.lit("$1"), F.translate(first, "123456789", "234567891")))
    out = texts.join(chosen, key, "left")
    return out.withColumn("target_text", F.when(F.col("fault").isNotNull(), changed).otherwise(F.col(text)))


def replace_terms(text: Column, lexicon: dict[str, str]) -> Column:
    """Literal replacement of the lexicon's terms, the longest first."""
    for source in sorted(lexicon, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(source), F.lit(lexicon[source]))
    return text


def mock_model(lexicon: dict[str, str], mark: str = "[tr] "):
    """A batch function for sections.map_batches: `reply` is the prompt with terms replaced, marked where none was found."""

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        def reply(text: str) -> str:
            out = text
            for source in sorted(lexicon, key=lambda s: (-len(s), s)):
                out = out.replace(source, lexicon[source])
            return out if out != text else mark + text

        return batch.assign(reply=[reply(t) for t in batch["prompt"]])

    return call
