"""SimHash near-duplicates, compared bit-sliced: planes of bits against carry-save counters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, salted_join
from ledgerlens.llm.graph import components

SEED = 42
LANES = 64
#: Shingle samples that a document is looked up by, where the radius is too wide for bit blocks.
SAMPLES = 6


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words of the text, A-Z lower-cased, repeats included; of the whole if it has fewer."""
    # bytes: lower() and split() keep to ASCII there
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(w) - words + 1)
    last = ends[len(w) - k :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:k].tolist(), last, strict=True)), dtype=np.uint64, count=k)


def mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th of further hashes made from each hash; the hashes themselves for 0."""
    if i == 0:
        return hashes
    x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * i & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def fingerprint(hashes: np.ndarray, width: int = 1) -> list[int]:
    """`width` words; each bit is 1 if it is set in over half of the (mixed) hashes, and all are zero without any."""
    out = []
    for i in range(width):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = mixed(hashes[at : at + (1 << 16)], i).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]) if len(hashes) else 0)
    return out


def numbered(hashes: np.ndarray) -> np.ndarray:
    """The hashes, the second and further ones of equal hashes changed by their number: as a set they stand for the multiset that a fingerprint is made of."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    if new.all():
        return hashes
    first = np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
    out = hashes.copy()
    out[order] = sorted_ + (np.arange(len(hashes)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out


def sample_keys(hashes: np.ndarray) -> list[int]:
    """The smallest of the numbered hashes under each of SAMPLES mixes; two documents share one with the similarity of their multisets of shingles as chance."""
    if not len(hashes):
        return [0] * SAMPLES
    hashes = numbered(hashes)
    return [int(mixed(hashes, 100 + i).min().astype(np.int64)) for i in range(SAMPLES)]


def _fingerprints(words: int, width: int, keys: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = (shingle_hashes(text, words) for text in batch["text"])
            found = [(fingerprint(h, width), sample_keys(h) if keys else None) for h in hashes]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "bits": [f for f, _ in found], "keys": [k for _, k in found]})

    return run


def fingerprints(documents: DataFrame, words: int, width: int = 1, keys: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bits (`width` signed longs), fp (the bits, or a hash of them if they are more than one long), keys (sampled shingles, if asked for)."""
    kind = dict(documents.dtypes)[id_col]
    rows = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInPandas(_fingerprints(words, width, keys), "doc_id string, bits array<bigint>, keys array<bigint>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("fp", F.col("bits")[0] if width == 1 else F.xxhash64("bits"))


class Sliced:
    """Fingerprints as vertical bit planes; element i has its bits in lane i // width of word i % width, so that
    the planes of elements i + d are the same planes, moved by d // width lanes and d % width words."""

    def __init__(self, prints: np.ndarray, same: np.ndarray, order: list[int]):
        self.n = len(prints)
        self.width = max(1, -(-self.n // LANES))
        self.planes = [self._pack((prints[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1) == 1) for b in order]
        # groups are told apart by their number's bits, one plane each
        self.group = [self._pack(same >> b & 1 == 1) for b in range(max(1, int(same.max(initial=0)).bit_length()))]
        self.live = self._pack(np.ones(self.n, dtype=bool))

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        grid = np.zeros((LANES, self.width), dtype=bool)
        grid.ravel()[: self.n] = bits
        plane = np.packbits(np.ascontiguousarray(grid.T), axis=1, bitorder="little").view("<u8").ravel()
        # the words after the last are those of the next lane
        return np.concatenate([plane, plane >> np.uint64(1)])

    def within(self, d: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (i, i + d) of one group whose fingerprints differ in at most `radius` bits."""
        lanes, step = divmod(d, self.width)
        lanes = np.uint64(lanes)
        alive = self.live[: self.width] & (self.live[step : step + self.width] >> lanes)
        for g in self.group:
            alive &= ~(g[: self.width] ^ (g[step : step + self.width] >> lanes))
        words = np.nonzero(alive)[0]
        alive = alive[words]
        digits = [np.zeros(len(words), dtype=np.uint64) for _ in range((radius + 1).bit_length())]
        start = (1 << len(digits)) - radius - 1
        for b in range(len(digits)):  # counters begin so high that the bit after the radius carries out
            if start >> b & 1:
                digits[b][:] = ~np.uint64(0)
        for k, plane in enumerate(self.planes):
            if not len(words):
                break
            carry = plane[words] ^ (plane[words + step] >> lanes)
            for b in range(len(digits)):
                digits[b], carry = digits[b] ^ carry, digits[b] & carry
            alive = alive & ~carry
            if k % 8 == 7:  # abandon blocks in which no lane is within the radius any more
                keep = alive != 0
                if not keep.all():
                    words, alive, digits = words[keep], alive[keep], [x[keep] for x in digits]
        word, lane = np.nonzero(np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i = lane * self.width + words[word]
        return i, i + d


def link_groups(prints: np.ndarray, groups: np.ndarray, radius: int, bits: list[int]) -> np.ndarray:
    """For each element the place of the first element of its group that it is linked with over any chain.

    The elements of a group lie together; `bits` are those that may differ within a group. Every pair of a group
    is compared, distance by distance for all groups at once; groups in which all are linked are left out from then on.
    """
    label = np.arange(len(prints))
    cuts = np.nonzero(np.diff(groups, prepend=groups[:1] - 1))[0]
    sizes = np.diff(np.append(cuts, len(prints)))

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    d, index, sliced = 1, np.zeros(0, dtype=int), None
    while True:
        if sliced is None or d & (d - 1) == 0:  # at powers of two, take up only what is not yet done
            while not np.array_equal(flat := label[label], label):
                label[:] = flat
            apart = np.maximum.reduceat(label, cuts) != np.minimum.reduceat(label, cuts) if len(cuts) else np.zeros(0, dtype=bool)
            open_groups = np.nonzero(apart & (sizes > d))[0]
            if not len(open_groups):
                return label
            most = int(sizes[open_groups].max())
            number = np.repeat(np.arange(len(open_groups)), sizes[open_groups])
            index = np.concatenate([np.arange(cuts[g], cuts[g] + sizes[g]) for g in open_groups])
            sliced = Sliced(prints[index], number, bits)
        if d >= most:
            while not np.array_equal(flat := label[label], label):
                label[:] = flat
            return label
        i, j = (index[x] for x in sliced.within(d, radius))
        new = label[i] != label[j]
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            ra, rb = root(a), root(b)
            label[max(ra, rb)] = min(ra, rb)
        d += 1


def bit_masks(radius: int, blocks: int) -> list[int]:
    """Bits that must agree in at least one choice: of `blocks` parts of 64 bits, those that `radius` differing bits leave whole."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int, crowd: int = 32) -> int:
    """The fewest blocks, radius + 2 at least, of which a choice has bits enough to leave `crowd` of n random fingerprints to a bucket; at most radius + 8."""
    return next((b for b in range(radius + 2, radius + 8) if n <= crowd << 64 * (b - radius) // b), radius + 8)


def _linker(radius: int, masks: list[int] | None):
    names = ["choice", "key", "low", "high"]

    def links(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for choice, rows in part.groupby("choice", sort=False):
            change = (rows[names].to_numpy()[1:] != rows[names].to_numpy()[:-1]).any(axis=1)
            groups = np.concatenate([[0], np.cumsum(change)])
            prints = np.stack(rows["bits"].to_numpy()).astype(np.int64).view(np.uint64)
            bits = [b for b in range(64 * prints.shape[1]) if masks is None or not masks[choice] >> b & 1]
            label = link_groups(prints, groups, radius, bits)
            linked, nodes = label != np.arange(len(label)), rows["fp"].to_numpy(np.int64)
            out.append(pd.DataFrame({"a": nodes[label[linked]], "b": nodes[linked]}))
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n >= 1 << 16:
                rows = pd.concat(held, ignore_index=True)
                last = (rows[names] != rows[names].iloc[-1]).any(axis=1).to_numpy()
                cut = int(np.nonzero(last)[0].max(initial=-1)) + 1  # the last group may go on
                if cut:
                    yield links(rows.iloc[:cut])
                held, n = [rows.iloc[cut:]], len(rows) - cut
        if n:
            yield links(pd.concat(held, ignore_index=True))

    return run


def link_fingerprints(keyed: DataFrame, radius: int, masks: list[int] | None, scratch: Scratch, bucket: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints of a bucket (choice, key) which differ in at most `radius` bits.

    A bucket of more than `bucket` fingerprints is cut into parts, and each two parts meet in a task of their
    own, so that no task holds more than about two parts, and no link is lost. Of the pairs only a spanning
    set of links comes out.
    """
    keyed = scratch.table(keyed.distinct())
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = keyed.join(sizes, ["choice", "key"]).withColumn("k", F.ceil(F.col("n") / F.lit(bucket)).cast("int"))
    parts = parts.withColumn("c", F.expr("cast(pmod(xxhash64(fp, 7), k) as int)")).withColumn("j", F.explode(F.expr("sequence(0, k - 1)")))
    parts = parts.select("choice", "key", F.least("c", "j").alias("low"), F.greatest("c", "j").alias("high"), "fp", "bits")
    names = ["choice", "key", "low", "high"]
    dealt = parts.repartition(*[F.col(c) for c in names]).sortWithinPartitions(*names)
    return dealt.mapInPandas(_linker(radius, masks), "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, words: int = 5, radius: int = 51, width: int = 4, blocks: int | str | None = None, bucket: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, fingerprint (16 hex digits for each of `width` words), component_id (the smallest doc_id reachable over links).

    Fingerprints link if they differ in at most `radius` of 64 x `width` bits; the default is an agreement of 0.8, and
    256 bits tell it with half the error of 64. With `blocks` (more than the radius; width 1) the search is exact: two such fingerprints agree in at least `blocks` - `radius` of the blocks, and those that agree in
    a choice of blocks are compared, all with all, bit-sliced. More blocks make more but smaller buckets, which a
    larger corpus needs: "auto" takes the fewest that leave some dozens of random fingerprints to a bucket (exact at any number). Without `blocks`, for a radius that no blocks can serve, those are compared that share one of SAMPLES sampled shingles (repeats counted, as in the fingerprints), which two documents
    of shingle similarity s miss with chance (1 - s) ** SAMPLES (0.00006 at 0.8); the tests measure the share of all pairs within the radius that is found.

    Equal fingerprints are one in all that is compared, and copies are joined back in salted parts. Cases: a null
    text is an empty one, with fingerprint zero, linked like any other; a text of fewer words is one shingle; a very long one is read whole; a null
    identifier is never the smallest; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession)
    docs = scratch.table(fingerprints(documents, words, width, blocks is None, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    prints = docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("bits").alias("bits"))
    if blocks == "auto":
        blocks = blocks_for(prints.count(), radius)
    if blocks is None:
        masks = None
        keyed = docs.select("fp", "bits", F.posexplode("keys").alias("choice", "key"))
    else:
        masks = bit_masks(radius, blocks)
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
        keyed = prints.select("fp", "bits", F.explode(keys).alias("x")).select("fp", "bits", "x.choice", "x.key")
    found = components(link_fingerprints(keyed.select("choice", "key", "fp", "bits"), radius, masks, scratch, bucket), scratch)
    found = found.withColumnRenamed("node", "fp")
    roots = scratch.table(prints.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")))
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = salted_join(roots.select("fp", "root"), smallest, ["root"])
    out = salted_join(docs.select("doc_id", "fp", "bits", "row"), named.select("fp", "component_id"), ["fp"])
    return out.select("doc_id", F.array_join(F.transform("bits", lambda b: F.lower(F.lpad(F.hex(b), 16, "0"))), "").alias("fingerprint"), "component_id")


def near_dedup(documents: DataFrame, words: int = 5, radius: int = 51, width: int = 4) -> DataFrame:
    """The rows of documents with all columns, one for each component of near_duplicates: the one with the smallest doc_id.

    Cases: a null text is an empty one in all comparisons and stays null; empty texts are copies of one another; rows without doc_id can't be
    named and all stay; of rows that repeat the smallest doc_id, the one with the smallest text stays (of equal texts any one); a very long text is
    read whole; an empty table gives no rows; no column name clashes with the operator's own.
    """
    keepers = near_duplicates(documents, words, radius, width, bucket=2048).where("doc_id = component_id").select("doc_id").distinct()
    kept = documents.join(keepers, "doc_id", "left_semi")
    kept = kept.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(c) for c in documents.columns]), F.struct(F.col("text").isNull(), "text")).alias("row")).select("row.*")
    return kept.unionByName(documents.where(F.col("doc_id").isNull()))
