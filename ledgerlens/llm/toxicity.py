"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch

LOG = logging.getLogger(__name__)

#: Words of abuse, by kind. Each kind is a voter, as is each pattern below.
LEXICONS = {
    "wits": "idiot idiots moron morons stupid dumb dumbass imbecile fool fools ignorant cretin dunce halfwit nitwit retard retarded".split(),
    "standing": "clown loser losers pathetic worthless useless coward creep freak".split(),
    "dirt": "scum trash garbage filth filthy".split(),
    "beast": "vermin pig pigs rat rats parasite parasites worm subhuman".split(),
    "disgust": "disgusting disgrace degenerate".split(),
    "hate": "hate hated hateful despise loathe racist bigot nazi bastard bastards".split(),
    "profane": "fuck fucking fucked fucker shit shitty bullshit asshole assholes bitch bitches crap damn dick whore slut cunt piss".split(),
    "threat": "kill die murder hang shoot beat destroy burn rape strangle".split(),
    "german": "arschloch scheisse scheiße dumm dummkopf trottel hurensohn abschaum blödmann vollidiot".split(),
    "french": "connard connasse merde salaud salope crétin imbécile abruti ordure pute débile".split(),
    "spanish": "idiota estúpido estúpida imbécil mierda puta puto cabrón gilipollas basura pendejo asqueroso".split(),
}
PATTERNS = {
    "you_are": re.compile(r"\byou(?:'re| are)? (?:an? |such |so |all |nothing )"),
    "shout": re.compile(r"!{2,}|\?!"),
    "masked": re.compile(r"\b[a-z]{1,2}\*{2,}[a-z]*"),
    "go_away": re.compile(r"\b(?:shut up|go to hell|get lost|drop dead|nobody likes)\b"),
    "leet": re.compile(r"\b(?:1d10t|id1ot|m0ron|l0ser|stup1d|tr4sh|sh1t|fvck|b1tch)\b"),
}
TERMS = {w: i for i, w in enumerate(sorted({w for words in LEXICONS.values() for w in words}))}
GROUPS = {name: np.array([TERMS[w] for w in words]) for name, words in LEXICONS.items()}
WORD = re.compile(r"[^\W\d_]+")
#: Voters that abstain unless they find something; a voter pair correlates beyond the label above this.
CORRELATED = 0.6
#: Rows on which two voters must both vote for half of their correlation to count.
FEW = 20
#: Standard deviations by which an induced term is over-represented in toxic rows at least, and the lexicons that such terms are dealt to.
Z_TELLING, LISTS = 5.5, 4


def counts_of(text: str, terms: dict[str, int], learned: dict[str, int]) -> np.ndarray:
    """Occurrences of each lexicon term, learned term and pattern in the whole text, then its number of words."""
    low = text.lower()
    out = np.zeros(len(terms) + len(learned) + len(PATTERNS) + 1)
    n = 0
    for w in WORD.findall(low):
        n += 1
        if w in terms:
            out[terms[w]] += 1
        if w in learned:
            out[len(terms) + learned[w]] += 1
    at = len(terms) + len(learned)
    for i, pattern in enumerate(PATTERNS.values()):
        out[at + i] = sum(1 for _ in pattern.finditer(low))
    out[-1] = n
    return out


def votes_of(counts: np.ndarray, n_terms: int, lists: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, 0 clean, -1 none) of the voters, one column each.

    Lexicon kinds, patterns and the LISTS induced lexicons (`lists` names each induced term's) vote for toxic when found, and abstain
    else; the last voter votes for clean where no term at all is found.
    """
    terms, learned, patterns = counts[:, :n_terms] > 0, counts[:, n_terms : n_terms + len(lists)] > 0, counts[:, n_terms + len(lists) : -1] > 0
    found = [terms[:, g].any(axis=1) for g in GROUPS.values()] + list(patterns.T) + [learned[:, lists == k].any(axis=1) for k in range(LISTS)]
    votes = [np.where(f, 1, -1) for f in found]
    votes.append(np.where(terms.any(axis=1) | learned.any(axis=1), -1, 0))
    return np.stack(votes, axis=1)


def label_model(votes: np.ndarray, prior: float = 0.1, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic for each row, accuracy of each voter, correlation matrix of the voters), from the votes alone.

    A latent label, toxic for a share `prior` of the rows, makes each vote; no known label enters, and an abstention tells nothing. A
    voter for toxic is right as often as the other voters, without it, find its rows toxic: one that nobody bears out has the prior as
    its accuracy and moves no posterior. A voter for clean is right by the posteriors. Voters that agree beyond what the label
    explains (their residuals then correlate by more than CORRELATED) share their weight: each is divided by one plus its excess correlations.
    """
    n, voters = votes.shape
    prior = min(max(prior, 0.01), 0.99)
    base = np.log(prior / (1 - prior))
    toxic, fired = (votes == 1).any(axis=0), (votes >= 0).astype(float)
    for_toxic = (votes == 1).astype(float)
    own = np.where(toxic, 2.0, -2.0)
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    logit = base + fired @ own
    post, accuracy, given_toxic, given_clean = squash(logit), *(np.full(voters, p) for p in (prior, prior, 1 - prior))
    for _ in range(rounds):
        others = squash(logit[:, None] - own[None, :])
        borne_out = ((others * for_toxic).sum(axis=0) + 2 * prior) / (for_toxic.sum(axis=0) + 2)  # two rows more at the prior
        given_toxic = (post @ fired + 2 * prior) / (post.sum() + 2)
        given_clean = ((1 - post) @ fired + 2 * (1 - prior)) / ((1 - post).sum() + 2)
        accuracy = np.where(toxic, borne_out, given_clean * (1 - prior) / (given_clean * (1 - prior) + given_toxic * prior))
        own = np.clip(np.where(toxic, np.log(borne_out / (1 - borne_out)) - base, np.log(given_toxic / given_clean)), -5, 5)
        logit = base + fired @ own
        before, post = post, squash(logit)
        if np.abs(post - before).max(initial=0) < 1e-6:
            break
    rest = fired - (post[:, None] * given_toxic + (1 - post)[:, None] * given_clean)
    rest /= np.sqrt((rest**2).mean(axis=0)) + 1e-9
    # agreement on a few rows tells little: a correlation counts by the rows that both voters vote on
    both = fired.T @ fired
    corr = rest.T @ rest / max(1, n) * both / (both + FEW)
    np.fill_diagonal(corr, 0)
    weight = 1 / (1 + np.where(corr > CORRELATED, corr, 0).sum(axis=1))
    return squash(base + fired @ (own * weight)), accuracy, corr


def voting(votes: np.ndarray) -> np.ndarray:
    """Which voters vote for toxic, or clean, on some row but not alike on all: the others tell nothing and are left out."""
    return (votes != votes[:1]).any(axis=0) if len(votes) else np.ones(votes.shape[1], dtype=bool)


def features_of(counts: np.ndarray, n_terms: int, n_learned: int) -> np.ndarray:
    """Inputs of the linear classifier: presence of terms, hits and their density, patterns; no metadata."""
    terms, learned, patterns, n = counts[:, :n_terms], counts[:, n_terms : n_terms + n_learned], counts[:, n_terms + n_learned : -1], np.maximum(counts[:, -1:], 1)
    sums = [terms.sum(axis=1, keepdims=True), (terms > 0).sum(axis=1, keepdims=True), learned.sum(axis=1, keepdims=True), (learned > 0).sum(axis=1, keepdims=True)]
    dense = [np.minimum(100 * s / n, 5) for s in (sums[0], sums[2])]
    kinds = [(terms[:, g].sum(axis=1, keepdims=True) > 0).astype(float) for g in GROUPS.values()]
    return np.hstack([np.log1p(s) for s in sums] + dense + [np.minimum(s, 2) for s in sums] + kinds + [np.log1p(patterns), np.ones((len(counts), 1))])


def fit_linear(x: np.ndarray, soft: np.ndarray, steps: int = 60, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the ridge is one for each row, so that small tables are not shrunk more than large ones."""
    w, ridge = np.zeros(x.shape[1]), ridge * max(1, len(x))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - soft) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    """learned: induced terms; weights: of the linear classifier; agreement: share of the fitted rows whose posterior and known label agree (measured, not used)."""

    learned: dict[str, int]
    weights: np.ndarray
    agreement: float | None = None

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        counts = np.stack([counts_of(t, TERMS, self.learned) for t in texts])
        return 1 / (1 + np.exp(-np.clip(features_of(counts, len(TERMS), len(self.learned)) @ self.weights, -30, 30)))


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_learned: int = 300, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on at most `max_rows` labelled rows (those whose hash is smallest) outside the held-out third.

    The voters' accuracies and correlations, and the posteriors, come from their votes alone. The known labels serve for the share
    of toxic rows, for inducing lexicons in whatever language (words of 4 letters or more that are over-represented in the toxic rows by
    Z_TELLING standard deviations or more and stand mostly there), and afterwards to measure how far posteriors agree with them.
    With no usable row the model falls back on the lexicons: its labels are the votes.
    """
    labels = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    labels = labels.where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most max_rows pairs of numbers: their size is bounded by that parameter
    rows = texts.join(F.broadcast(chosen), "id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    rows = Scratch(documents.sparkSession).table(rows)
    totals = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_terms = len(TERMS)
    if not totals[1]:  # one made-up row for each outcome of the lexicon
        counts = np.zeros((40, n_terms + len(PATTERNS) + 1))
        counts[:, -1] = 100
        for i in range(20):
            counts[i, i : i + 3] = 1
        return ToxicityModel({}, fit_linear(features_of(counts, n_terms, 0), np.repeat([1.0, 0.0], 20)))
    prior = min(max(totals[0] / totals[1], 0.01), 0.99)
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)))).alias("w"))
    tally = words.groupBy("w").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).where("t >= 3 and 2 * t >= n")
    z = (F.col("t") - F.col("n") * prior) / F.sqrt(F.col("n") * prior * (1 - prior))
    telling = tally.withColumn("z", z).where(F.col("z") >= Z_TELLING).where(~F.col("w").isin(sorted(TERMS))).orderBy(F.desc("z"), "w").limit(max_learned).collect()
    learned, lists = {r["w"]: i for i, r in enumerate(telling)}, np.array([crc32(r["w"].encode()) % LISTS for r in telling], dtype=int)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                counts = np.stack([counts_of(t, TERMS, learned) for t in part["text"]])
                votes, x = votes_of(counts, n_terms, lists).astype(np.int8), features_of(counts, n_terms, len(learned)).astype("<f8")
                yield pd.DataFrame({"toxic": part["toxic"], "votes": [v.tobytes() for v in votes], "x": [v.tobytes() for v in x]})

    # bounded by max_rows: some 300 bytes for each, whatever the number of terms, whose counts stay on the executors
    got = rows.mapInPandas(describe, "toxic int, votes binary, x binary").collect()
    gold, votes, x = np.array([r["toxic"] for r in got]), *(np.frombuffer(b"".join(r[c] for r in got), kind).reshape(len(got), -1) for c, kind in (("votes", np.int8), ("x", "<f8")))
    post, _, _ = label_model(votes[:, voting(votes)], prior)
    agreement = float(((post > 0.5) == (gold == 1)).mean())
    LOG.info("posteriors of %d rows agree with their known labels on %.4f", len(gold), agreement)
    return ToxicityModel(learned, fit_linear(x, post), agreement)


def score_toxicity(documents: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    The whole text alone makes the score. Cases: a null text is an empty one and gets a score; a null
    identifier stays null and is not held out; a very long text is read whole; equal texts have equal scores; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(documents.dtypes)[id_col]
    rows = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [model.score(batch["text"].iloc[i : i + 512].tolist()) for i in range(0, len(batch), 512)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.concatenate(out) if out else []})

    scored = rows.mapInPandas(score, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of documents, with all columns, whose score is under the threshold.

    Cases: a null text is scored as an empty one and stays null; a very long text is read whole; null identifiers and repeated rows are
    judged by their texts alike; an empty table gives no rows; no column name clashes with the operator's own.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [model.score(texts.iloc[i : i + 512].tolist()) for i in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    name = "__score" + "_" * sum(c.startswith("__score") for c in documents.columns)
    return documents.withColumn(name, score(F.coalesce(F.col(text_col), F.lit("")))).where(F.col(name) < threshold).drop(name)
