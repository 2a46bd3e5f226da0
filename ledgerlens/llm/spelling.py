"""Spelling variants: each word's near words (one inserted, deleted or replaced code point) counted and ranked without forming pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, lower_ascii

RUN = "[a-zÀ-ÿ]+"  # after lower-casing
#: Words of so many code points or more are keyed by digests of their wildcard forms, not by the forms, whose total length is quadratic.
LONG = 48
#: Primes under 2**31 with a base each: a digest has one sum modulo each of them, 124 bits in all.
FIELDS = ((2147483647, 1_000_003), (2147483629, 69_069), (2147483587, 1_664_525), (2147483579, 22_695_477))


def words_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199) -> DataFrame:
    """word, one row for each run of letters: lower-cased (A-Z only); a run whose crc32 of `<id>:<run>` is divisible by `every` lacks a code point."""
    text, key = lower_ascii(F.col(text_col)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = documents.select(key.alias("key"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.encode(F.concat("key", F.lit(":"), "run"), "UTF-8"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    return runs.withColumn("h", h).withColumn("at", at).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n, id: the words of at least `shortest` code points and `least` occurrences; ids ascend in code-point order (write the table before it is read twice)."""
    counted = words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counted.orderBy("word").withColumn("id", F.monotonically_increasing_id())


def _powers(base: int, p: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), p) % p])
    return out[:n]


def long_digests(word: str) -> tuple[str, list[str], list[str]]:
    """Digests of a word, of its wildcard forms (each position left out but counted), and of its deletions, all in time linear in the word's length."""
    codes = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    whole, holes, cuts = [], [], []
    for p, base in FIELDS:
        powers = _powers(base, p, len(codes))
        terms = codes * powers % p
        moved = np.concatenate([[0], codes[1:] * powers[:-1] % p])  # as they stand once the code point before is gone
        total = int(terms.sum() % p)
        whole.append(total)
        holes.append((total - terms) % p)
        before = np.concatenate([[0], np.cumsum(terms)[:-1]])
        after = moved.sum() - np.cumsum(moved)
        cuts.append((before + after) % p)
    text = "{:08x}{:08x}{:08x}{:08x}".format
    return text(*whole), [text(*v) for v in zip(*holes, strict=True)], [text(*v) for v in zip(*cuts, strict=True)]


def _long_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for word, n, number in zip(batch["word"], batch["n"], batch["id"], strict=True):
            size = len(word)
            _, holes, cuts = long_digests(word)
            out = [("hole", f"{size}:{i}:{hole}") for i, hole in enumerate(holes)]
            # of equal neighbours either deletion gives the same word: the first counts
            first = [i for i in range(size) if i == 0 or word[i] != word[i - 1]]
            # the one length at which a deletion is a short word again
            out += [("cut", word[:i] + word[i + 1 :] if size == LONG else f"{size - 1}:{cuts[i]}") for i in first]
            yield pd.DataFrame(out, columns=["kind", "key"]).assign(id=number, n=n)[["id", "n", "kind", "key"]]


def _own_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": [f"{len(w)}:{long_digests(w)[0]}" for w in batch["word"]], "short": batch["id"], "short_n": batch["n"]})


def wildcard_keys(vocabulary: DataFrame) -> DataFrame:
    """id, n, kind, key: a `hole` key for each (position, prefix, suffix) group of a word, a `cut` key for each word that a deletion leaves."""
    size = F.char_length("word")
    short = vocabulary.where(size < LONG).select("id", "n", "word", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    prefix, suffix = F.expr("substring(word, 1, i - 1)"), F.expr("substring(word, i + 1)")
    first = (F.col("i") == 1) | (F.expr("substring(word, i, 1)") != F.expr("substring(word, i - 1, 1)"))
    both = F.array(F.struct(F.lit("hole").alias("kind"), F.concat(prefix, F.lit("*"), suffix).alias("key")), F.struct(F.when(first, F.lit("cut")).alias("kind"), F.concat(prefix, suffix).alias("key")))
    keyed = short.select("id", "n", F.inline(both)).where(F.col("kind").isNotNull())
    return keyed.unionByName(vocabulary.where(size >= LONG).mapInPandas(_long_keys, "id bigint, n bigint, kind string, key string"))


def _rank(n: str, number: str) -> Column:
    """Least for the word that ranks first: the largest n, then the smallest word."""
    return F.struct((-F.col(n)).alias("less"), F.col(number).alias("id"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """id, n_near, best (less: its negative n, id): for those of `vocabulary` (word, n, id; a table) that have near words.

    Replacements: a (position, prefix, suffix) group holds words that differ in that position alone, no more than the alphabet has letters; it keeps its size and its top two,
    and each member takes size - 1 and the top word that is not itself. Two words share one such group at most. Insertions and deletions: a word's deletions meet the vocabulary
    by equality. Both sides of such a link take 1 and the other's rank. All of it is summed up by word: no pair of a group is formed.
    """
    keys = wildcard_keys(vocabulary)
    groups = keys.where("kind = 'hole'").groupBy("key").agg(F.array_sort(F.collect_list(_rank("n", "id"))).alias("members")).where(F.size("members") > 1)
    replaced = groups.select((F.size("members") - 1).cast("bigint").alias("near"), F.slice("members", 1, 2).alias("top"), F.explode("members.id").alias("id"))
    replaced = replaced.select("id", "near", F.when(F.col("top")[0]["id"] == F.col("id"), F.col("top")[1]).otherwise(F.col("top")[0]).alias("best"))
    size = F.char_length("word")
    whole = vocabulary.where(size < LONG).select(F.col("word").alias("key"), F.col("id").alias("short"), F.col("n").alias("short_n"))
    whole = whole.unionByName(vocabulary.where(size >= LONG).mapInPandas(_own_keys, "key string, short bigint, short_n bigint"))
    links = keys.where("kind = 'cut'").select("key", "id", "n").join(whole, "key")
    ends = links.select(F.inline(F.array(F.struct("id", _rank("short_n", "short").alias("best")), F.struct(F.col("short").alias("id"), _rank("n", "id").alias("best")))))
    both = replaced.unionByName(ends.select("id", F.lit(1).cast("bigint").alias("near"), "best"))
    return both.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """One row for each word of the vocabulary: word, form, root, n, n_near, form_n.

    A word's form is its near word of the largest n (ties: the smallest in code-point order), if that n is at least `ratio` times the word's. root follows forms to the last: n grows
    `ratio`-fold by each step, so the largest n bounds the steps, and pointers that double need their logarithm in joins.

    Words of LONG code points or more are grouped by 124-bit digests of their wildcard forms; two different forms are taken for one with a chance of about 2**-100 at 10**7 such words.

    Cases: a null or empty text has no words; a null identifier counts as an empty one in the checksum; a repeated row counts again; very long texts and words are taken whole; ties
    go by code point; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession)
    words = scratch.table(vocabulary(words_of(documents, id_col, text_col, every), shortest, least))
    n = -F.col("best.less")
    has = n >= ratio * F.col("n")
    known = words.join(near_words(words), "id", "left")
    known = scratch.table(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.id")).alias("form_id"), F.when(has, n).alias("form_n")))
    largest = known.agg(F.max("form_n")).first()[0]
    roots = known.where("form_id is not null").select("id", F.col("form_id").alias("root_id"))
    steps = math.log(largest / least, ratio) + 1e-9 if largest else 0
    reach = 1
    while reach < steps:
        onward = roots.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        roots = scratch.table(roots.join(onward, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id")))
        reach *= 2
    names = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    named = known.join(roots, "id", "left").join(names, "root_id", "left")
    named = named.join(words.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
