"""Retrieval: TF-IDF by postings, and vectors by blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.keep import writer


def postings(texts: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token, tf). The texts are dealt out by key, so that a text's tokens are counted where it lies, and postings are not shuffled."""
    return texts.repartition(key).select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_search(corpus: DataFrame, queries: DataFrame, doc: str, query: str, k: int = 5, block: int = 200_000, max_postings: int = 2_000_000, keep=None) -> DataFrame:
    """Top k documents of each query by cosine of tf * idf, idf = ln((1 + N) / (1 + df)) + 1: query, doc, score, rank.

    corpus and queries are postings. A token that no document has counts with idf 1 in the query's norm. The queries are a stated set of checked size (`max_postings`; more are an error: run them in parts) and
    go to all tasks. The postings are dealt out by ranges of documents (hashed, so many that a range has some `block` postings), so a very frequent token is spread over all ranges; a range scores its
    documents for all queries in arrays and hands on k of each query. So no row is made for a query and a document that share a token but for k in each range. Only postings of tokens of queries go to the ranges; those of
    others only count in their document's norm. Postings and idf are read more than once and written by `keep` (tables of the shared folder).
    """
    keep = keep or writer(corpus.sparkSession)
    corpus = keep(corpus)
    sizes = corpus.agg(F.count_distinct(doc).alias("n"), F.count(F.lit(1)).alias("postings"))
    n, postings_ = sizes.first()
    df = corpus.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = keep(df.select("token", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))
    q = queries.join(idf, "token", "left").select(query, "token", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("qw"), "idf")
    rows = q.limit(max_postings + 1).collect()  # bounded by max_postings
    if len(rows) > max_postings:
        raise ValueError(f"more than {max_postings} postings of queries: run them in parts")
    wanted: dict = {}
    for name, token, weight, _ in rows:
        wanted.setdefault(name, []).append((token, weight))
    known = {token: w for _, token, _, w in rows if w is not None}
    numbers = {t: i for i, t in enumerate(sorted({t for r in wanted.values() for t, _ in r}))}
    asked = []
    for name, parts in wanted.items():
        weights = np.array([w for _, w in parts])
        asked.append((name, np.array([numbers[t] for t, _ in parts]), weights / np.sqrt((weights**2).sum())))
    kinds = dict(corpus.dtypes)[doc], dict(queries.dtypes)[query]

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        docs, at = np.unique(rows[doc].to_numpy(), return_inverse=True)
        number, weight = rows["number"].to_numpy(np.int64), rows["weight"].to_numpy()
        norm, own = np.ones(len(docs)), number < 0
        norm[at[own]] = weight[own]
        number, at, weight = number[~own], at[~own], weight[~own] / norm[at[~own]]
        order = np.argsort(number, kind="stable")
        number, at, weight = number[order], at[order], weight[order]
        begin = np.searchsorted(number, np.arange(len(numbers) + 1))
        out = []
        for name, tokens, weights in asked:
            slices = [slice(begin[t], begin[t + 1]) for t in tokens]
            found = np.concatenate([at[s] for s in slices]) if slices else at[:0]
            if not len(found):
                continue
            scores = np.round(np.bincount(found, np.concatenate([weight[s] * w for s, w in zip(slices, weights, strict=True)]), len(docs)), 6)
            best = np.flatnonzero(scores > 0)
            if len(best) > k:  # all that tie with the k-th stay until they are put in order
                best = best[scores[best] >= np.partition(scores[best], -k)[-k]]
            best = best[np.lexsort((docs[best], -scores[best]))][:k]
            out += [(name, docs[i], scores[i]) for i in best]
        return pd.DataFrame(out, columns=[query, doc, "score"])

    ranges = max(1, -(-postings_ // block))
    # of tokens in one document of a thousand, there are at most a thousand times those of a mean document; the rest of the postings meet their tokens in a shuffle
    common = F.col("df") * 1000 >= n
    often = F.broadcast(idf.where(common).select("token", "idf"))
    square = (F.col("tf") * F.col("idf") * (F.col("tf") * F.col("idf"))).alias("square")
    rest = corpus.join(often.select("token"), "token", "left_anti").join(idf.where(~common).select("token", "idf"), "token")
    norms = corpus.join(often, "token").select(doc, square).unionByName(rest.select(doc, square)).groupBy(doc).agg(F.sqrt(F.sum("square")).alias("weight"))
    # only tokens of queries go on, as numbers; a document's norm has number -1
    asked_for = F.broadcast(corpus.sparkSession.createDataFrame([(t, i, known[t]) for t, i in numbers.items() if t in known], "token string, number bigint, idf double"))
    weighed = corpus.join(asked_for, "token").select(doc, "number", (F.col("tf") * F.col("idf")).alias("weight"))
    parts = weighed.unionByName(norms.select(doc, F.lit(-1).cast("bigint").alias("number"), "weight")).withColumn("range", F.pmod(F.xxhash64(doc), F.lit(ranges)))
    scored = parts.groupBy("range").applyInPandas(score, f"{query} {kinds[1]}, {doc} {kinds[0]}, score double")
    w = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _doubles(vector: str) -> Column:
    """The vector in double precision; null if a null is in it."""
    return F.when(~F.exists(vector, lambda x: x.isNull()), F.transform(vector, lambda x: x.cast("double")))


#: Scores of a block of queries and vectors that a task holds at a time.
BLOCK = 4_000_000


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up in the order of the dimensions, as SQL does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _matrix(vectors: Iterable, size: int) -> np.ndarray:
    """Vectors as rows; a null or empty vector is zero. One of another length than `size` is an error."""
    rows = [np.zeros(size) if v is None or not len(v) else v for v in vectors]
    if any(len(r) != size for r in rows):
        raise ValueError(f"vectors of other lengths than {size}")
    return np.array(rows, dtype=float).reshape(len(rows), size)


class _Nearest:
    """The k vectors nearest to each of the queries (a matrix) by cosine rounded to six digits, then by key, among those that it is given.

    Cosines by matrix products in single precision only choose whom to score: all that they put no lower than the k-th so far, less what they may be wrong by. Scores are sums in double precision in the order of the
    dimensions. `floor`: scores below which a query needs nothing.
    """

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.q, self.k, self.norms, self.units = queries, k, np.sqrt(_dots(queries, queries)), _unit(queries).astype(np.float32)
        self.slack = 3e-6 + 2.4e-7 * queries.shape[1]
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.copy()
        self.who, self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, keys: np.ndarray, v: np.ndarray, who: np.ndarray | None = None) -> None:
        """Vectors v for all queries, or for those numbered."""
        who = np.arange(len(self.q)) if who is None else who
        if not len(who) or not len(v):
            return
        # of equal vectors, only the first k by key can be among the nearest
        same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((np.unique(keys, return_inverse=True)[1].ravel(), same))
        order = order[_places(same[order]) < self.k]
        keys, v = keys[order], v[order]
        norms, units = np.sqrt(_dots(v, v)), _unit(v).astype(np.float32)
        step = max(self.k + 1, BLOCK // len(who))
        for i in range(0, len(v), step):
            cosine = self.units[who] @ units[i : i + step].T
            least = self.floor[who] - self.slack
            hopeful = ~(cosine < least[:, None])
            if hopeful.sum() > 4 * self.k * len(who) and cosine.shape[1] > self.k:
                kth = np.partition(cosine, -self.k, axis=1)[:, -self.k]
                hopeful = ~(cosine < np.fmax(least, kth - 2 * self.slack)[:, None])
            asked, found = np.nonzero(hopeful)
            for j in range(0, len(asked), BLOCK // 8):
                self._take(who[asked[j : j + BLOCK // 8]], i + found[j : j + BLOCK // 8], keys, v, norms)

    def _take(self, who: np.ndarray, found: np.ndarray, keys: np.ndarray, v: np.ndarray, norms: np.ndarray) -> None:
        norm = norms[found] * self.norms[who]
        with np.errstate(all="ignore"):
            raw = np.where(norm <= 0, 0.0, _dots(v[found], self.q[who]) / norm)
            scores = np.copysign(np.floor(np.abs(raw) * 1e6 + 0.5), raw) / 1e6 + 0.0
        keep = ~(scores < self.floor[who])
        who, scores, taken = who[keep], scores[keep], keys[found[keep]]
        touched = np.isin(self.who, who)
        who, scores = np.concatenate([self.who[touched], who]), np.concatenate([self.scores[touched], scores])
        taken = taken if self.keys is None else np.concatenate([self.keys[touched], taken])
        order = np.lexsort((np.unique(taken, return_inverse=True)[1].ravel(), -np.where(np.isnan(scores), np.inf, scores), who))
        place = _places(who[order])
        order, place = order[place < self.k], place[place < self.k]
        last = order[place == self.k - 1]
        self.floor[who[last]] = np.fmax(self.floor[who[last]], scores[last])
        rest = ~touched
        self.keys = taken[order] if self.keys is None else np.concatenate([self.keys[rest], taken[order]])
        self.who, self.scores = np.concatenate([self.who[rest], who[order]]), np.concatenate([self.scores[rest], scores[order]])


def _places(group: np.ndarray) -> np.ndarray:
    """Each row's place within its group, from 0; rows lie by group."""
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)]))


def _asked(queries: DataFrame, query: str) -> tuple[np.ndarray, np.ndarray]:
    """(names, matrix) of a bounded set of queries (query, vector)."""
    rows = queries.select(query, _doubles("vector").alias("v")).collect()
    names = np.empty(len(rows), dtype=object)
    names[:] = [r[query] for r in rows]
    return names, _matrix([r["v"] for r in rows], max((len(r["v"] or []) for r in rows), default=0) or 1)


def _ranked(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, k: int = 5, max_queries: int = 10_000) -> DataFrame:
    """Top k vectors of each query by cosine: query, key, score, rank; a zero vector has score 0.

    The queries are a stated set, of checked size, that goes to all tasks and is met with all vectors, block by block in matrix products; each task hands on k of its own for each query (see `_Nearest`).
    """
    if queries.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"more than {max_queries} queries: run them in parts")
    kinds = dict(queries.dtypes)[query], dict(vectors.dtypes)[key]
    names, matrix = _asked(queries, query)  # at most max_queries rows

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = _Nearest(matrix, k)
        for rows in batches:
            # without a query that is not zero, all scores are
            nearest.add(rows["__key"].to_numpy(), _matrix(rows["vector"] if matrix.any() else [None] * len(rows), matrix.shape[1]))
        if nearest.keys is not None:
            yield pd.DataFrame({query: names[nearest.who], key: nearest.keys, "score": nearest.scores})

    rows = vectors.select(F.col(key).alias("__key"), _doubles(vector).alias("vector"))
    return _ranked(rows.mapInPandas(search, f"{query} {kinds[0]}, {key} {kinds[1]}, score double"), query, key, k)


# ---- an index that grows


def index_texts(texts: DataFrame, key: str, tokens: Column, path: str) -> DataFrame:
    """Postings (key, token, tf) of the texts, kept under path: only texts whose key is not there yet are tokenised, and their postings are added.

    A run's postings go to a folder named by what it adds, so a run that is made again replaces its own. A text that has changed must come under a new key.
    """
    spark = texts.sparkSession
    kind = dict(texts.dtypes)[key]
    have = load_postings(spark, path, key, kind)
    new = texts if have is None else texts.join(have.select(key).distinct(), key, "left_anti")
    added = postings(new, key, tokens)
    # a text without tokens is remembered by an empty one, so that it is not taken up again; readers leave it out
    bare = new.select(key).distinct().join(added.select(key).distinct(), key, "left_anti").select(key, F.lit("").alias("token"), F.lit(0).cast("bigint").alias("tf"))
    n, digest = new.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64(key), F.lit(1 << 31)))).first()
    if n:
        added.unionByName(bare).write.mode("overwrite").parquet(f"{path.rstrip('/')}/added-{n}-{digest or 0:x}")
    found = load_postings(spark, path, key, kind)
    return added if found is None else found.where("tf > 0")


def load_postings(spark, path: str, key: str, kind: str) -> DataFrame | None:
    """All postings kept under path, those of texts without tokens (tf 0) too; none if there are none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder) or not files.listStatus(folder):
        return None
    return spark.read.schema(f"{key} {kind}, token string, tf bigint").parquet(f"{path.rstrip('/')}/added-*")


# ---- an inverted-file index over vectors


def embed_texts(texts: DataFrame, key: str, text_col: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """(key, vector) of texts by a callable that makes a vector of each of a list of texts; it is called for `batch` texts at a time, null texts as empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "vector": [list(map(float, v)) for v in embed(part["text"].tolist())]})

    rows = texts.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, vector array<double>")


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _closest(units: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, cosine to it) of unit vectors; a block of them at a time, so that memory has a bound."""
    step = max(1, BLOCK // max(1, len(centroids)))
    nearest, cosine = np.zeros(len(units), np.int64), np.zeros(len(units))
    for i in range(0, len(units), step):
        all_ = units[i : i + step] @ centroids.T
        nearest[i : i + step] = all_.argmax(axis=1)
        cosine[i : i + step] = all_[np.arange(len(all_)), nearest[i : i + step]]
    return nearest, cosine


def fit_centroids(vectors: DataFrame, key: str, vector: str, lists: int, max_rows: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Unit centroids of `lists` clusters by spherical k-means, fitted on at most `max_rows` vectors (those whose key has the smallest hash)."""
    sample = vectors.where(F.size(vector) > 0).where(~F.exists(vector, lambda x: x.isNull())).orderBy(F.xxhash64(key), key).limit(max_rows).select(_doubles(vector).alias("v"))
    rows = [r["v"] for r in sample.collect()]  # bounded by max_rows
    if not rows:
        return np.zeros((0, 0))
    x = _unit(np.array(rows, dtype=float))
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        nearest, _ = _closest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids = np.where((sums != 0).any(axis=1, keepdims=True), _unit(sums), centroids)
    return centroids


def vector_index(vectors: DataFrame, key: str, vector: str, lists: int | None = None, max_rows: int = 20_000) -> tuple[DataFrame, np.ndarray]:
    """(index, centroids): every vector (key, vector) with its list, that of the nearest centroid, and its angle to it; write the index partitioned or bucketed by list.

    lists: the square root of the number of vectors if not given, 4,096 at most, so the centroids that go to all tasks have a bound. A null vector is in no list; a zero vector has angle pi / 2 to all.
    """
    lists = lists or int(min(4096, max(1, vectors.count() ** 0.5)))
    centroids = fit_centroids(vectors, key, vector, lists, max_rows)
    kind = dict(vectors.dtypes)[key]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                nearest, cosine = _closest(_unit(_matrix(rows["vector"], centroids.shape[1])), centroids)
                angle = np.arccos(np.clip(cosine, -1, 1))
                yield pd.DataFrame({key: rows[key], "vector": rows["vector"], "list": nearest.astype("int32"), "angle": angle})

    rows = vectors.where(F.col(vector).isNotNull()).select(key, _doubles(vector).alias("vector"))
    return rows.mapInPandas(assign, f"{key} {kind}, vector array<double>, list int, angle double"), centroids


def index_search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, key: str, query: str, k: int = 5, probes: int = 8, exact: bool = False, part: int = 100_000, asked: int = 10_000) -> DataFrame:
    """Top k vectors of each query (query, vector) by cosine, out of its `probes` nearest lists: query, key, score, rank.

    The queries go to the lists some `asked` at a time, any number of them. The index is dealt out by list, a list of more than `part` vectors in parts of that size; a list meets the queries that it is to be searched for in
    matrix products, and each task hands on k of its own for each query. With `exact`, a second round searches the lists that may hold better vectors than the k-th of the first round: an angle to a vector is at least the
    angle to its centroid less the list's widest. The result then equals a search of all vectors (`index` must be a table: it is read more than once).
    """
    kinds = dict(queries.dtypes)[query], dict(index.dtypes)[key]
    schema = f"{query} {kinds[0]}, {key} {kinds[1]}, score double"
    if not len(centroids):
        return _ranked(index.sparkSession.createDataFrame([], schema), query, key, k)
    stats = index.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("widest"))
    widest = np.zeros(len(centroids))
    for r in stats.collect():  # a row for each list
        widest[r["list"]] = r["widest"]
    parts = F.ceil(F.col("size") / part).cast("int")
    stored = index.select(F.col(key).alias("__key"), "vector", "list").join(F.broadcast(stats.select("list", parts.alias("parts"))), "list")
    dealt = stored.repartition("list", F.pmod(F.xxhash64("__key"), F.col("parts"))).sortWithinPartitions("list").drop("parts")

    def meet(names: np.ndarray, matrix: np.ndarray, probed: np.ndarray, worst: np.ndarray | None) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nearest, units = _Nearest(matrix, k, worst), _unit(matrix)
            for rows in batches:
                v, keys = _matrix(rows["vector"], matrix.shape[1]), rows["__key"].to_numpy()
                for n, at in rows.groupby("list").indices.items():
                    who = (probed == n).any(axis=1)
                    if worst is not None:
                        near = np.arccos(np.clip(units @ centroids[n], -1, 1))
                        # a little more than what rounding to six digits hides
                        who = ~who & ~(np.cos(np.maximum(0.0, near - widest[n])) + 2e-6 < nearest.floor)
                    nearest.add(keys[at], v[at], np.flatnonzero(who))
            if nearest.keys is not None:
                yield pd.DataFrame({query: names[nearest.who], key: nearest.keys, "score": nearest.scores})

        return dealt.mapInPandas(search, schema)

    def some(queries: DataFrame) -> DataFrame:
        names, matrix = _asked(queries, query)  # `asked` rows or so
        if not matrix.any():
            matrix = np.zeros((len(names), centroids.shape[1]))
        units = _unit(matrix)
        probed = np.zeros((len(names), min(probes, len(centroids))), np.int32)
        for i in range(0, len(names), step := max(1, BLOCK // len(centroids))):
            probed[i : i + step] = np.argsort(-(units[i : i + step] @ centroids.T), axis=1, kind="stable")[:, : probed.shape[1]]
        first = _ranked(meet(names, matrix, probed, None), query, key, k)
        if not exact:
            return first
        first = writer(index.sparkSession)(first)
        worst = {r[0]: r[1] for r in first.groupBy(query).agg(F.min("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()}
        worst = np.nan_to_num(np.array([worst.get(n, -np.inf) for n in names], dtype=float), nan=-np.inf, neginf=-np.inf)
        return _ranked(first.drop("rank").unionByName(meet(names, matrix, probed, worst)), query, key, k)

    groups = max(1, -(-queries.count() // asked))
    found = [some(queries.where(F.pmod(F.xxhash64(query), F.lit(groups)) == i)) for i in range(groups)]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]
