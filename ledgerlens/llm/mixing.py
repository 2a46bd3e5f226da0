"""Mixing to target weights by soft membership: domain posteriors and nonnegative document rates."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, counted_join, spare_names

LETTERS = re.compile(r"[^\W\d_]+")
#: Target share of expected tokens for each domain of the label table.
DEFAULT_TARGETS = {"good": 0.97, "poor": 0.03}


def shape_features(text: str) -> list[float]:
    """What the classifier sees of a whole text: counts and ratios of words, letters, marks and repeats."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    unique = set(words)
    letters = 1 - len(LETTERS.sub("", text)) / chars
    upper = sum(w.isupper() and len(w) > 1 for w in unique) / max(1, len(unique))
    marks = {m: text.count(m) for m in ("!!", "$$$", "***", "###", "&&&", "%%%", " | ", "http")}
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    marked = sum(marks[m] for m in ("$$$", "***", "###", "&&&", "%%%")) / n
    return [
        1.0, np.log(n), np.log(len(unique) or 1) - np.log(n), repeats, letters, upper, min(2, 10 * marks["!!"] / n), marked, marks[" | "] / n,
        marks["http"] / n, text.count("\n") / n, min(3, sum(map(len, unique)) / max(1, len(unique)) / 8), float(n < 5), text.count(".") / n, text.count(",") / n,
    ]


def fit_domains(x: np.ndarray, y: np.ndarray, k: int, steps: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a softmax regression by accelerated gradient steps, on scaled features (the scale is folded in)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], scale[0] = 0, 1
    z, target = (x - mean) / scale, np.eye(k)[y]
    w, before = np.zeros((x.shape[1], k)), np.zeros((x.shape[1], k))
    for i in range(steps):
        ahead = w + i / (i + 3) * (w - before)
        p = softmax(z @ ahead)
        before, w = w, ahead - 2.0 / z.shape[1] * (z.T @ (p - target) / len(z) + ridge * ahead)
    out = w / scale[:, None]
    out[0] -= mean @ (w / scale[:, None])
    return out


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def label_domain() -> Column:
    """Domain of a row of the label table: good or poor; none for an unknown quality."""
    return F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def fit_posteriors(documents: DataFrame, labels: DataFrame, domains: list[str], domain: Column, max_rows: int = 8000) -> np.ndarray:
    """Weights of the domain classifier, fitted on at most `max_rows` labelled documents (those of the smallest hash)."""
    known = labels.select("doc_id", domain.alias("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("domain", "text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"domain": batch["domain"], "x": [[float(v) for v in shape_features(t)] for t in batch["text"]]})

    got = rows.mapInPandas(features, "domain string, x array<double>").collect()  # bounded by max_rows
    if not got:
        return np.zeros((len(shape_features("")), len(domains)))
    return fit_domains(np.array([r["x"] for r in got]), np.array([domains.index(r["domain"]) for r in got]), len(domains))


def posteriors(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc (hash of identifier and text), tokens (words), p (posterior of each domain)."""
    text = F.coalesce("text", F.lit(""))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array([shape_features(t) for t in batch["text"]])
                yield pd.DataFrame({"doc_id": batch["doc_id"], "doc": batch["doc"], "tokens": np.maximum(1, np.round(np.exp(x[:, 1]))).astype("int64"), "p": list(softmax(x @ weights))})

    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("doc"), text.alias("text"))
    return rows.mapInPandas(predict, "doc_id string, doc bigint, tokens bigint, p array<double>").withColumn("doc_id", F.col("doc_id").cast(kind))


def fit_rates(members: DataFrame, targets: np.ndarray, pull: float = 1e-4, tolerance: float = 1e-7, limit: int = 500) -> tuple[Column, np.ndarray]:
    """(rate column over p, missed share of each domain): rates r >= 0 that minimise |e|^2 + pull * sum_d n_d (r_d - 1)^2 / N, with the missed shares e = sum_d r_d n_d p_d / N - targets.

    N is the number of tokens. Projected gradient steps: at the minimum a document's rate is 1 - p.e / pull, projected onto the nonnegative numbers, so the rates of all documents follow
    from the k missed shares, along which the steps go. Each step is one distributed sum of k + 1 numbers; its direction is the gradient in the metric of the Gram matrix of all posteriors, which bounds
    the curvature from above, and its length is spectral (the curvature met by the step before, in that metric), halved until the value falls below the largest of the last ten.
    No state is kept for a document, so a lost executor costs nothing but its part of a sum. Steps end when the gradient is below `tolerance`; more than `limit` sums are an error.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = members.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]) for i, j in pairs]).first()
    total, metric = float(first[0] or 1), np.eye(k)
    for (i, j), v in zip(pairs, first[1:], strict=True):
        metric[i, j] += (v or 0.0) / total / pull
        metric[j, i] = metric[i, j]

    def rate(e: np.ndarray) -> Column:
        inner = F.aggregate(F.zip_with("p", F.array(*[F.lit(float(v)) for v in e]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.greatest(F.lit(0.0), 1 - inner / pull)

    def measured(e: np.ndarray) -> tuple[float, np.ndarray]:
        """What the steps bring down, |e|^2 / 2 + targets.e + pull / 2 * sum_d n_d r_d^2 / N, and its gradient: zero where the rates of e miss the targets by e."""
        r, n, p = F.col("r"), F.col("tokens"), F.col("p")
        sums = members.withColumn("r", rate(e)).agg(F.sum(n * r * r), *[F.sum(n * r * p[i]) for i in range(k)]).first()
        sums = np.array([(v or 0.0) / total for v in sums])
        return float(e @ e / 2 + targets @ e + pull / 2 * sums[0]), e + targets - sums[1:]

    e, used, curvature = np.zeros(k), 1, 1.0
    value, gradient = measured(e)
    values = [value]
    while np.abs(gradient).max() > tolerance:
        way, size = -np.linalg.solve(metric, gradient) / curvature, 1.0
        while True:
            if used == limit:
                raise RuntimeError(f"rates not settled after {limit} sums; gradient {np.abs(gradient).max()}")
            found, used = measured(e + size * way), used + 1
            # near the minimum the value's rounding hides its fall
            if found[0] <= max(values[-10:]) + 1e-4 * size * (gradient @ way) + 1e-14:
                break
            size /= 2
        moved = size * way
        curvature = min(1.0, max(1e-6, moved @ (found[1] - gradient) / (moved @ metric @ moved)))
        e, (value, gradient) = e + moved, found
        values.append(value)
    return rate(e), e


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: Column | None = None, seed: int = 17, max_rows: int = 8000, warn_above: float = 0.005) -> DataFrame:
    """One row for each row: doc_id, doc, tokens, p (posteriors, in the order of the targets), rate, copies.

    A classifier fitted on the label table gives each document its posteriors over the domains; nonnegative least squares
    (projected gradient steps to its minimum) gives it a rate, so that the expected tokens of each domain come near their target share of all tokens while
    rates stay near 1; a warning names the shares if one is over `warn_above` from its target. copies is the rate rounded up or down by a hash of the document, so that it is the rate in expectation, and alike in every run.

    Cases: a null text is an empty one (one token); without labels all posteriors are equal; null identifiers stay null;
    repeated rows each get their row; an empty table gives no rows; other columns are ignored.
    """
    targets = targets or DEFAULT_TARGETS
    domains = list(targets)
    scratch = Scratch(documents.sparkSession)
    weights = fit_posteriors(documents, labels, domains, label_domain() if domain is None else domain, max_rows)
    members = scratch.table(posteriors(documents, weights))
    shares = np.array(list(targets.values())) / sum(targets.values())
    rate, missed = fit_rates(members, shares)
    if np.abs(missed).max() > warn_above:
        warnings.warn("mixing misses its targets: " + ", ".join(f"{d} {t + e:.4f} for {t:.4f}" for d, t, e in zip(domains, shares, missed, strict=True)), stacklevel=2)
    chance = F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return members.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def mix_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tokens, p_good, p_poor, rate, copies."""
    out = mix(documents, labels)
    return out.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DEFAULT_TARGETS)], "rate", "copies")


def apply_mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """documents with all columns, each row as often as its copies say.

    Cases: as in mix; rows of equal identifier and text repeat alike; null texts stay null; no column name clashes with the operator's own.
    """
    doc, key, copies, i, rows = spare_names(documents, "doc", "key", "copies", "i", "rows")
    # the identifier stands beside its hash with the text, so that hashes that fall together do no harm; rows of one key, as of null identifiers with one text, may be many
    by_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    mixed = mix(documents, labels, targets).groupBy("doc", by_id).agg(F.first("copies"), F.count(F.lit(1))).toDF(doc, key, copies, rows)
    text = F.coalesce("text", F.lit(""))
    keyed = documents.withColumn(doc, F.xxhash64(F.col("doc_id").cast("string"), text)).withColumn(key, by_id)
    out = counted_join(keyed, mixed.where(F.col(copies) > 0), [doc, key], rows)
    return out.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(doc, key, copies, i)
