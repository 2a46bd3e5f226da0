"""Packing token sequences into fixed windows by non-negative least squares over a length histogram."""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch

WINDOW = 2048
END_ID = 1


def encoder(name: str = "byte_bpe_50k"):
    """The byte-level vocabulary of the tokenizers library's <name>.json, run from the same vocabulary's ranks.

    The ids are equal (the tests hold them against the tokenizers library) and come 2.5 times as fast as
    from the library itself, which re-encodes each of the many words that occur once. The added tokens of <name>.json are
    special ones here: encode with allowed_special="all" to find them in texts, as the library does.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in special.values()}, special_tokens=special)


def _pieces(vocabulary: str, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = functools.partial(encoder(vocabulary).encode_to_numpy, allowed_special="all")
        seen = [0] * (window + 1)
        for batch in batches:
            out = []
            for key, text, part in zip(batch["doc_id"], batch["text"], batch["part"], strict=True):
                ids = np.append(encode(text), END_ID).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    out.append((key, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local"])

    return run


def fill_combinations(lengths: np.ndarray, window: int, coarse: int = 48) -> list[tuple[int, ...]]:
    """Shallow combinations of the given lengths that fill the window exactly: one, two, or three, the largest of three from a grid of `coarse` lengths."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    out = [(window,)] if have[window] else []
    for a in lengths[lengths * 2 >= window]:
        if a < window and have[window - a]:
            out.append((int(a), int(window - a)))
    third = lengths[lengths * 3 >= window]
    third = third[third < window - 1]
    for a in third[np.unique(np.linspace(0, len(third) - 1, min(coarse, len(third))).astype(int))] if len(third) else []:
        for b in lengths[(lengths <= a) & (lengths * 2 >= window - a)]:
            c = window - a - b
            if c > 0 and c <= b and have[c]:
                out.append((int(a), int(b), int(c)))
    return out


def nonnegative_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 200) -> np.ndarray:
    """x >= 0 that brings the lengths used by x repeats of the patterns near the histogram in least squares (multiplicative steps)."""
    rows = np.concatenate([np.array(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    h = histogram.astype(float)
    target = np.bincount(cols, h[rows], len(patterns))
    x = np.full(len(patterns), h.sum() / max(1, len(rows)))
    for _ in range(steps):
        used = np.bincount(rows, x[cols], len(h))
        x *= target / np.maximum(np.bincount(cols, used[rows], len(patterns)), 1e-12)
    return x


def plan_windows(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a window, repeats)] that use up the histogram (index: length, 0 to window) exactly.

    Repeats of exact fillings come from least squares, rounded down; what is left is packed greedily: the
    longest piece first, then ever the longest that still fits, as often as all its lengths last. Each
    greedy step uses up a length, so there are at most `window` of them.
    """
    left = histogram.astype(np.int64).copy()
    plan = []
    patterns = fill_combinations(np.nonzero(left)[0], window)
    if patterns:
        x = nonnegative_counts(patterns, left)
        for k in np.argsort(-x, kind="stable"):
            lengths, uses = np.unique(patterns[k], return_counts=True)
            times = int(min(np.floor(x[k] + 1e-9), (left[lengths] // uses).min()))
            if times > 0:
                left[lengths] -= times * uses
                plan.append((patterns[k], times))
    while left.any():
        gap, chosen, spare = window, [], left.copy()
        while gap > 0 and (fits := np.nonzero(spare[: gap + 1])[0]).size:
            best = int(fits[-1])
            times = min(int(spare[best]), gap // best)
            chosen += [best] * times
            spare[best] -= times
            gap -= best * times
        lengths, uses = np.unique(chosen, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        plan.append((tuple(chosen), times))
    return plan


def _place(plan: list[tuple[tuple[int, ...], int]], window: int):
    """Column function (length, number among the pieces of that length): where a piece goes."""
    begin, first_sequence, offset, used, sequence = [], [], [], np.zeros(window + 1, dtype=np.int64), 0
    for lengths, times in plan:
        at = 0
        for n in lengths:
            begin.append((n << 44) + used[n])
            first_sequence.append(sequence)
            offset.append(at)
            used[n] += times
            at += n
        sequence += times
    order = np.argsort(begin, kind="stable") if begin else np.array([], dtype=int)
    begin, first_sequence, offset = (np.array(v, dtype=np.int64)[order] for v in (begin, first_sequence, offset))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << 44) + number.to_numpy(np.int64)
        slot = np.searchsorted(begin, key, side="right") - 1
        return pd.DataFrame({"sequence_id": first_sequence[slot] + key - begin[slot], "offset": offset[slot]})

    return place


def partitioned_texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (string), text, part: the number of the partition read, which is one call's own even where a task goes through several (after coalesce)."""
    return documents.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))


def pack(documents: DataFrame, window: int = WINDOW, vocabulary: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are tokenised once and cut at multiples of the window; each task numbers its pieces of each length as it makes them, and
    the tasks' totals, summed up in the order of the tasks, number all pieces of a length without sorting any. The histogram of piece lengths (at
    most `window` numbers, whatever the input) goes to the driver, which plans windows from it; a piece's number gives sequence and offset.

    Cases: a null text is an empty one (the closing id alone); a very long one fills windows of its own; a null identifier stays null; repeated rows are
    documents of their own; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession)
    kind = dict(documents.dtypes)[id_col]
    pieces = partitioned_texts(documents, id_col, text_col).mapInPandas(_pieces(vocabulary, window), "doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, local bigint")
    placed = place_pieces(scratch, scratch.table(pieces.withColumn("doc_id", F.col("doc_id").cast(kind))), window)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def place_pieces(scratch: Scratch, pieces: DataFrame, window: int) -> DataFrame:
    """pieces (a table that is read twice: length, part, local and more; local numbers a part's pieces of one length from 0) with sequence_id and offset."""
    # one row for each length and task
    totals = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = scratch.table(totals.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in totals.groupBy("length").agg(F.sum("n")).collect():  # at most window rows
        histogram[length] = n
    place = _place(plan_windows(histogram, window), window)
    placed = pieces.join(totals.select("length", "part", "base"), ["length", "part"]).withColumn("at", place("length", F.col("base") + F.col("local")))
    return placed.select(*[c for c in pieces.columns if c not in ("part", "local")], F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))
