"""Secret scanning with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, salted_join

#: Base kinds in their order, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
# a run of the class is matched whole from its first place, so the least length may stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds beyond the base ones.
MORE = {
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    # begins a run and takes runs whole, so that each character is looked at a few times at most
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    "hosting": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "url": re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{3,100}@"),
}
KINDS = ["assign", "access", "hex", *MORE]
BASE = KINDS[:3]
RULE_VERSION = "2"


def scan(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) in code points, by start, then by kind as listed."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, pattern in MORE.items():
        spans += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in batch["text"]]
        yield pd.DataFrame({"blob": batch["blob"], "rule_version": RULE_VERSION, "spans": found})


LEDGER = "blob string, rule_version string, spans array<struct<kind: string, start: bigint, end: bigint>>"


def scan_versions(versions: DataFrame, ledger_path: str | None = None, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each version (row): path, blob, spans.

    Each content is addressed by its SHA-256. Only (blob, rule version) pairs that the ledger does not
    have are scanned, once each however many paths hold the blob; their findings are appended to the ledger,
    a Parquet folder, and joined back to all paths. Without `ledger_path` the ledger begins empty, in the
    shared folder. A blob that many paths share is joined in salted parts.

    Cases: a null content is an empty one; a very long one is scanned whole, in time that grows as its length; a null path stays null; repeated rows each get their row; an empty
    table gives no rows; other columns are ignored.
    """
    spark = versions.sparkSession
    scratch = Scratch(spark)
    texts = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = scratch.table(texts.select("path", "blob", F.monotonically_increasing_id().alias("row")))
    ledger_path = ledger_path or f"{scratch.root}/ledger"
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)
    known = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
    # one path stands for each unseen blob: identifiers are shuffled here, not texts
    unseen = paths.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
    unseen = unseen.withColumnRenamed("path", "chosen").withColumnRenamed("blob", "chosen_blob")
    content = texts.join(unseen, F.col("path").eqNullSafe(F.col("chosen")) & (F.col("blob") == F.col("chosen_blob")), "left_semi")
    found = content.select("blob", "text").mapInPandas(_scan_batches, LEDGER)
    found.write.mode("append").parquet(ledger_path)
    # a blob whose row is repeated was scanned more than once, with equal findings
    findings = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == RULE_VERSION).groupBy("blob").agg(F.first("spans").alias("spans"))
    return salted_join(paths, findings, ["blob"]).select("path", "blob", "spans")


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def secrets_report(documents: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; cases as in scan_versions."""
    found = scan_versions(documents, ledger_path)
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)")
    base = ", ".join(f"'{k}'" for k in BASE)
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(f"filter(spans, s -> s.kind in ({base}))"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
