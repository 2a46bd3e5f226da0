"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, lower_ascii

KEY = ["digest", "check64", "n_bytes"]


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Method. Each input partition makes a run: one entry for each digest, sorted, with the identifier to
    keep and the number of copies. Runs then meet in rounds of a binomial tree (of order `fan_in`): in
    round r, runs whose numbers agree without their r lowest digits are merged, so that a text that a
    third of all rows hold brings one entry from each run and at most `fan_in` to any merge. An entry is
    verified at every level: entries merge only if SHA-256, XXH64 and byte length all agree. The winners
    then go back down the same tree, level by level, so no join meets a hot key either. Only digests are
    shuffled, never texts.

    `keep` is "smallest" or "largest" identifier. Cases: a null text is an empty one; texts that differ
    only in A-Z against a-z are equal; a null identifier loses to any other; of repeated rows (equal
    identifier and text) one is kept; an empty table gives no rows; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    scratch = Scratch(df.sparkSession)
    text = lower_ascii(F.col("t"))
    rows = scratch.table(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        .select("id", text.alias("t"))
        .select(
            "id",
            F.unhex(F.sha2("t", 256)).alias("digest"),
            F.xxhash64("t").alias("check64"),
            F.octet_length("t").alias("n_bytes"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    if keep == "largest":
        best = F.max(F.struct("id", -F.col("row")))
        merge = F.max("best")
    else:
        order = F.struct(F.col("id").isNull().alias("null"), "id", "row")
        best = F.min(order)
        merge = F.min("best")
    level = rows.groupBy("run", *KEY).agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    levels = [scratch.table(level.sortWithinPartitions("run", "digest"))]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        up = levels[-1].withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
        up = up.groupBy("run", *KEY).agg(merge.alias("best"), F.sum("size").alias("size"))
        levels.append(scratch.table(up.sortWithinPartitions("run", "digest")))
        runs = -(-runs // fan_in)
    down = levels[-1]
    for below in reversed(levels[:-1]):
        winners = down.withColumnRenamed("run", "parent")
        down = below.select("run", *KEY, F.expr(f"run div {fan_in}").cast("int").alias("parent")).join(winners, ["parent", *KEY]).drop("parent")
    sign = -1 if keep == "largest" else 1
    row = f"best.{'col2' if keep == 'largest' else 'row'}"
    out = rows.join(down, ["run", *KEY])
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == sign * F.col(row)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
