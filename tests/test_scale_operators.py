"""Near pairing, searches, the vector index and the decision stream against brute force at hostile sizes."""

import math
import random
import sys
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerlens.operators import numdiff, retrieval
from ledgerlens.operators.keep import writer
from ledgerlens.streaming import review_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def greedy(missing, added):
    pairs = []
    for i, a in missing:
        for j, b in added:
            da, db = a.replace(".", ""), b.replace(".", "")
            if len(da) == len(db):
                e, c = edits(da, db), abs(float(a) - float(b)) / max(abs(float(a)), 1e-12)
                if e <= 2 or c <= 0.02:
                    pairs.append((e, c, i, j))
    s, t, out = set(), set(), set()
    for e, _, i, j in sorted(pairs):
        if i not in s and j not in t:
            s.add(i)
            t.add(j)
            out.add((i, j, e))
    return out


def test_near_pairs_of_one_large_owner(spark):
    rng = random.Random(2)
    figures = lambda n: [(i, rng.choice(["0", "7", "42", "43", "5.5", "1e-0"[:1]]) if i % 9 == 0 else f"{rng.randint(1, 10 ** rng.randint(1, 9))}.{rng.randint(0, 99):02d}") for i in range(n)]
    for n in (3, 400):
        missing, added = figures(n), figures(n)
        added = [(j, v if j % 3 else missing[j][1][:-1] + str(rng.randint(0, 9))) for j, v in added]
        rows = [("o", "money", float(v), "missing", v, i, None, None) for i, v in missing] + [("o", "money", float(v), "added", None, None, v, j) for j, v in added] + [("o", "money", 1.0, "matched", "1", 0, "1", 0)]
        df = spark.createDataFrame(rows, "owner string, dimension string, base_value double, bucket string, source_raw string, source_ordinal int, target_raw string, target_ordinal int")
        got = [(r["source_ordinal"], r["target_ordinal"], r["edits"]) for r in numdiff.match_near(df.repartition(3), ["owner"]).collect()]
        assert len(got) == len(set(got)) and set(got) == greedy(missing, added) and (n < 10 or len(got) > 100)
    assert numdiff.match_near(df.where("false"), ["owner"]).count() == 0
    with pytest.raises(ValueError, match="2 edits"):
        numdiff.near_pairs(df, df, ["owner"], max_edits=3)


def test_tfidf_in_ranges(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = {i: [rng.choice(words[: rng.choice([3, 60])]) for _ in range(rng.randint(0, 30))] for i in range(200)} | {500: ["w0"] * 40, 501: ["w0"] * 40}
    asked = {100: ["w0", "w0", "w5", "none"], 101: ["none"], 102: ["w7", "w8"], 103: ["w0"]}
    postings = lambda d, k: spark.createDataFrame([(i, t, n) for i, ws in d.items() for t, n in Counter(ws).items()], f"{k} bigint, token string, tf bigint")
    corpus, queries = postings(texts, "doc").repartition(4), postings(asked, "q")
    held = {i: w for i, w in texts.items() if w}
    df = Counter(t for w in held.values() for t in set(w))
    idf = {t: math.log((1 + len(held)) / (1 + n)) + 1 for t, n in df.items()}
    vector = lambda ws: {t: n * idf.get(t, 1.0) for t, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = set()
    for q, ws in asked.items():
        v = vector(ws)
        scores = sorted((-round(sum(v[t] * d.get(t, 0) for t in v) / norm(v) / norm(d), 6), i) for i, d in ((i, vector(w)) for i, w in held.items()))
        want |= {(q, i, -s, k + 1) for k, (s, i) in enumerate([x for x in scores if x[0] < 0][:5])}
    for block in (10**6, 50):  # one range and very many
        got = retrieval.tfidf_search(corpus, queries, "doc", "q", block=block)
        assert {(r["q"], r["doc"], round(r["score"], 6), r["rank"]) for r in got.collect()} == want
    assert retrieval.tfidf_search(corpus.where("false"), queries, "doc", "q").count() == 0 and retrieval.tfidf_search(corpus, queries.where("false"), "doc", "q").count() == 0
    with pytest.raises(ValueError, match="more than 3"):
        retrieval.tfidf_search(corpus, queries, "doc", "q", max_postings=3)


def test_tfidf_writes_postings_once(spark):
    """Texts meet their key before they become postings, only postings and idf are written, and rare tokens (less than one document of a thousand) count in the norms."""
    rng = random.Random(8)
    texts = {i: [f"c{rng.randint(0, 20)}" for _ in range(4)] + [f"r{i}", f"s{i // 2}"] for i in range(2500)}
    df = spark.createDataFrame([(i, w[a::2]) for i, w in texts.items() for a in (0, 1)], "doc int, w array<string>").repartition(3)  # two rows for each
    asked = {1: ["c1", "r7", "none"], 2: ["s40"]}
    corpus, queries = retrieval.postings(df, "doc", F.col("w")), retrieval.postings(spark.createDataFrame(list(asked.items()), "q int, w array<string>"), "q", F.col("w"))
    assert not [x for x in corpus._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and "token" in x]
    kept = []
    keep = writer(spark)
    got = retrieval.tfidf_search(corpus, queries, "doc", "q", keep=lambda d: kept.append(d.columns) or keep(d))
    n = Counter(t for w in texts.values() for t in set(w))
    vector = lambda ws: {t: k * (math.log((1 + len(texts)) / (1 + n[t])) + 1 if n[t] else 1.0) for t, k in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = set()
    for q, ws in asked.items():
        v = vector(ws)
        scores = sorted((-round(sum(v[t] * d.get(t, 0) for t in v) / norm(v) / norm(d), 6), i) for i, d in ((i, vector(w)) for i, w in texts.items()))
        want |= {(q, i, -x, k + 1) for k, (x, i) in enumerate([x for x in scores if x[0] < 0][:5])}
    assert {(r["q"], r["doc"], round(r["score"], 6), r["rank"]) for r in got.collect()} == want and len(kept) == 2


def test_vector_index_against_all_vectors(spark):
    rng = np.random.default_rng(4)
    middles = rng.standard_normal((30, 24))
    rows = [(i, (middles[i % 30 if i % 3 else 0] + 0.35 * rng.standard_normal(24)).tolist()) for i in range(3000)] + [(5000, [0.0] * 24), (5001, None), (5002, middles[3].tolist()), (5003, middles[3].tolist())]
    v = spark.createDataFrame(rows, "id bigint, e array<double>").repartition(4)
    queries = v.where("id % 100 = 0 and e is not null").select(F.col("id").alias("q"), F.col("e").alias("vector"))
    exact = {(r["q"], r["id"], r["score"], r["rank"]) for r in retrieval.vector_search(v.where("e is not null"), queries, "id", "e", "q").collect()}
    index, centroids = retrieval.vector_index(v, "id", "e", max_rows=1000)
    index = writer(spark)(index)
    assert index.count() == 3003 and len(centroids) == 54
    got = retrieval.index_search(index, centroids, queries, "id", "q", probes=6, part=100).collect()  # a third of all are in few lists, dealt out in parts
    recall = len({(r["q"], r["id"]) for r in got} & {x[:2] for x in exact}) / len(exact)
    assert recall >= 0.9
    again = retrieval.index_search(index, centroids, queries, "id", "q", probes=2, exact=True, part=500).collect()
    assert {(r["q"], r["id"], r["score"], r["rank"]) for r in again} == exact
    none = retrieval.vector_index(v.where("false"), "id", "e")
    assert retrieval.index_search(*none, queries, "id", "q").count() == 0


def test_vector_index_recall_on_the_embeddings(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    exact = {(r["q"], r["vec_id"]) for r in retrieval.vector_search(e, queries, "vec_id", "embedding", "q").collect()}
    index, centroids = retrieval.vector_index(e, "vec_id", "embedding")
    got = retrieval.index_search(writer(spark)(index), centroids, queries, "vec_id", "q", probes=len(centroids) * 3 // 4).collect()
    assert len({(r["q"], r["vec_id"]) for r in got} & exact) / len(exact) >= 0.9


def test_vector_search_with_many_equal_vectors(spark):
    """More copies and near copies than there are places, null, empty and partly null vectors, keys that are texts, against all pairs; no row is made for a pair."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 12)).astype(np.float32)
    x[100:300], x[300:400], x[400:420] = x[5], x[6] + 1e-7 * rng.standard_normal((100, 12)), 0
    rows = [(f"k{i * 7 % 900}", v.tolist()) for i, v in enumerate(x)] + [("n0", None), ("n1", []), ("n2", [None] + [1.0] * 11)]
    v = spark.createDataFrame(rows, "id string, e array<float>").repartition(3)
    asked = [(i, x[i].tolist()) for i in (5, 6, 150, 350, 410, 700)] + [(1000, None)]
    got = retrieval.vector_search(v, spark.createDataFrame(asked, "q int, vector array<float>"), "id", "e", "q")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    of = lambda e: np.array(e if e and None not in e else [0.0] * 12, dtype=np.float32).astype(float)
    want = set()
    for q, e in asked:
        scores = []
        for key, w in rows:
            a, b = of(e), of(w)
            dot = lambda a, b: sum((p * r for p, r in zip(a.tolist(), b.tolist(), strict=True)), 0.0)
            norm = math.sqrt(dot(b, b)) * math.sqrt(dot(a, a))
            scores.append((-round(dot(b, a) / norm if norm else 0.0, 6), key))
        want |= {(q, key, -s, i + 1) for i, (s, key) in enumerate(sorted(scores)[:5])}
    assert {(r["q"], r["id"], r["score"], r["rank"]) for r in got.collect()} == want
    with pytest.raises(Exception, match="other lengths"):
        retrieval.vector_search(v, spark.createDataFrame([(1, [1.0])], "q int, vector array<float>"), "id", "e", "q").collect()


def test_index_search_takes_any_number_of_queries(spark):
    """Queries go to the lists some at a time, and no row is made for a query and a list."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    index, centroids = retrieval.vector_index(e, "vec_id", "embedding")
    index = writer(spark)(index)
    rows = lambda df: {(r["q"], r["vec_id"], r["score"], r["rank"]) for r in df.collect()}
    want = rows(retrieval.vector_search(e, queries, "vec_id", "embedding", "q"))
    for asked in (7, 10_000):
        got = retrieval.index_search(index, centroids, queries, "vec_id", "q", exact=True, asked=asked)
        assert rows(got) == want and len(want) == 5 * queries.count()


def test_embedding_by_a_callable(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, "aab")], "id int, t string")
    got = {r["id"]: list(r["vector"]) for r in retrieval.embed_texts(texts, "id", "t", lambda ts: [[t.count("a"), len(t)] for t in ts], batch=2).collect()}
    assert got == {1: [1.0, 3.0], 2: [0.0, 0.0], 3: [2.0, 3.0]}


def run_stream(spark, tmp_path, files, **options):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, review_stream.DECISION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema(review_stream.DECISION).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = review_stream.decision_sink(review_stream.latest_decisions(stream, **options), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    assert query.exception() is None
    return review_stream.decisions_of(spark, f"{tmp_path}/out")


def test_stream_equals_the_batch_for_shuffled_and_repeated_decisions(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(f"i{rng.randint(0, 12)}", rng.choice(["approved", "rejected", "edited"]), start + timedelta(hours=rng.randint(0, 100)), f"e{k:03d}") for k in range(90)] + [(None, "approved", start, "x"), ("n", "approved", None, None)]
    dealt = rows + rng.sample(rows, 40)
    rng.shuffle(dealt)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = run_stream(spark, tmp_path, [dealt[i::3] for i in range(3)], watermark="20000 days")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want = {(r["item_id"], r["decision"], r["event_id"]) for r in review_stream.latest_of(spark.createDataFrame(rows, review_stream.DECISION).na.fill("", ["event_id"])).collect()}
    assert {(r["item_id"], r["decision"], r["event_id"]) for r in got.collect()} == want


def test_decisions_settle_and_late_ones_are_left_out(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    files = [[("a", "approved", day(0), "1"), ("b", "approved", day(19), "2")], [("b", "rejected", day(20), "3")], [("c", "approved", day(21), "4")], [("a", "edited", day(1), "5"), ("b", "edited", day(20), "6")]]
    got = {r["item_id"]: (r["decision"], r["settled"]) for r in run_stream(spark, tmp_path, files, watermark="2 days", settle_ms=3 * 86_400_000).collect()}
    # a was settled, and its late decision does not open it again; b's later event of the same time counts
    assert got["a"] == ("approved", True) and got["b"][0] == "edited" and got["c"][0] == "approved"


def test_queue_versions(spark, tmp_path, monkeypatch):
    from ledgerlens.operators.queue_table import Conflict, QueueTable

    item = "item_id string, chunk_id string, risk double, target_text string"
    run = lambda n, text="t": spark.createDataFrame([(f"rv-{i}", f"c{i}", i / 10, text) for i in range(n)], item)
    q = QueueTable(spark, f"file://{tmp_path}/queue")
    assert q.latest() is None and q.read() is None
    assert q.upsert(run(3), token="run 1") == 1 and q.upsert(run(3), token="run 1") == 1  # made again: nothing changes
    assert q.decide(spark.createDataFrame([("rv-1", "approved")], "item_id string, status string")) == 2
    assert q.upsert(run(4, "t2")) == 3
    states = lambda v=None: {r["item_id"]: (r["status"], r["target_text"]) for r in q.read(v).collect()}
    assert states(1)["rv-1"] == ("pending", "t") and states(2)["rv-1"] == ("approved", "t") and states()["rv-1"] == ("pending", "t2") and len(states()) == 4
    # a writer that is killed after it has written its items leaves the last version as it was
    monkeypatch.setattr(QueueTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        q.upsert(run(9))
    monkeypatch.undo()
    assert q.versions() == [1, 2, 3] and len(states()) == 4
    # another writer commits while this one makes its change: the change is made anew of what the other has left
    made = []

    def change(old):
        if not made:
            QueueTable(spark, q.path).append(spark.createDataFrame([("rv-x", "cx", 0.5, "x", "pending", "")], item + ", status string, note string"))
        made.append(old.count())
        return old

    assert q.commit(change) == 5 and made == [4, 5] and len(states()) == 5
    with pytest.raises(Conflict):
        q._commit(5, [], "z")
    q.append(spark.createDataFrame([("rv-x", "cx", 0.7, "later", "edited", "")], item + ", status string, note string"))
    assert states()["rv-x"] == ("edited", "later") and len(q.manifest(6)["folders"]) == 2
    assert q.compact() == 7 and len(q.manifest(7)["folders"]) == 1 and states()["rv-x"] == ("edited", "later")
    q.expire(keep=2)
    assert q.versions() == [6, 7] and states(6) == states(7) and len(list((tmp_path / "queue" / "data").iterdir())) == 3


def test_index_grows_by_what_is_new(spark, tmp_path):
    from ledgerlens.functions.text import tokenize

    texts = spark.createDataFrame([(i, f"word{i % 7} common {i}.5" if i % 5 else None) for i in range(40)], "id int, t string")
    path = f"file://{tmp_path}/index"
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(retrieval.postings(texts, "id", tokenize(F.col("t"))))
    assert rows(retrieval.index_texts(texts.where("id < 10"), "id", tokenize(F.col("t")), path)) == [r for r in whole if r[0] < 10]
    assert rows(retrieval.index_texts(texts, "id", tokenize(F.col("t")), path)) == whole
    before = sorted(p.name for p in (tmp_path / "index").iterdir())
    assert rows(retrieval.index_texts(texts, "id", tokenize(F.lit("never read again")), path)) == whole
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == before and len(before) == 2


def test_chart_labels_in_place(spark):
    from ledgerlens.operators import documents
    from ledgerlens.sources import layout

    chart = '{"chart_type": "bar", "series": [{"name": "Revenue", "points": {"North": "1", "Nord": "2", "2023": "3"}}, {"name": null, "points": null}], "axis_labels": {"x": ["North", "2023", "Other"], "y": ["100%"]}}'
    df = spark.createDataFrame([(1, chart), (2, chart), (3, None)], "id int, j string").select("id", F.from_json("j", layout.CHART).alias("chart"))
    names = spark.createDataFrame([(1, "Revenue", "收入"), (1, "North", "北"), (1, "Nord", "北"), (1, "2023", "never"), (3, "Revenue", "x")], "id int, label string, translation string")
    got = {r["id"]: r["chart"] for r in documents.translate_chart_labels(df, ["id"], names).collect()}
    assert [s["name"] for s in got[1]["series"]] == ["收入", None] and got[1]["series"][0]["points"] == {"北": "2", "2023": "3"} and got[1]["axis_labels"] == {"x": ["北", "2023", "Other"], "y": ["100%"]}
    assert got[2] == df.where("id = 2").first()["chart"] and got[3] is None


def test_chunks_take_near_terms(spark):
    from ledgerlens.operators import chunks, glossary

    c = spark.createDataFrame([("d", 0, ["Goodwill"], "The impairment of the asset; EPS, IFRS and XYZ. Deferred Tax Asset", [("asset", "资产")])], "doc_id string, chunk_no int, path array<string>, source_text string, found array<struct<source: string, target: string>>")
    terms = spark.createDataFrame([("asset", "资产", None), ("Goodwill", "商誉", None), ("Revenue", "收入", ["turnover"])], "source string, target string, aliases array<string>")
    assert [(r["source"], r["rank"]) for r in chunks.retrieved_terms(c, terms).collect()] == [("Goodwill", 1)] or [r["source"] for r in chunks.retrieved_terms(c, terms).collect()] == ["Goodwill"]
    text = F.col("source_text")
    assert c.select(glossary.candidates(text)).first()[0] == ["XYZ", "Deferred Tax Asset"]
    assert c.select(glossary.candidates(text, known=F.col("found.source"))).first()[0] == ["XYZ", "asset", "Deferred Tax Asset"]
    blocks = spark.createDataFrame([("d", i, i, "text", t, 0.0, lv, t, None) for i, (t, lv) in enumerate([("Goodwill", 1), ("The impairment of the asset", None)])], "doc_id string, pos int, page_index int, kind string, text string, font_size double, heading_level int, rendered string, table_id string")
    made = chunks.build(chunks.in_sections(blocks), terms, retrieve=8)[0].first()
    assert [t["source"] for t in made["terms"]][:2] == ["Goodwill", "asset"]


def test_replies_of_hostile_length():
    import time

    from ledgerlens.sources.html_tables import reply_json

    assert reply_json('{"a": "x,}", "b": [1, 2, ], }') == '{"a": "x,}", "b": [1, 2]}' and reply_json('it "{" {"q": "\\"}"}') == '{"q": "\\"}"}' and reply_json('{"a": {"b": 1}') == '{"b": 1}'
    for text in ("{" * 200_000, '{"a":' * 60_000, '{"a":' * 60_000 + "}" * 60_000, "{x" * 50_000 + "}" * 50_000, "{" + ", " * 200_000, '{"' * 100_000):
        began = time.time()
        assert reply_json(text) is None and time.time() - began < 5


def test_conflicts_of_a_saved_glossary(spark, tmp_path):
    from ledgerlens.operators import glossary

    ev = spark.createDataFrame([(1, "EBITDA", "a", "seed", 1), (2, "ebitda", "b", "seed", 1)], "seq int, source string, target string, authority string, frequency int")
    glossary.save(*glossary.fold(ev), f"{tmp_path}/g")
    assert [(r["source"], r["incoming"]) for r in glossary.load_conflicts(spark, f"{tmp_path}/g/conflicts").collect()] == [("EBITDA", "b")]
    (tmp_path / "one.json").write_text('{"entries": [{"source": "x", "target": "y"}, {"source": "z", "target": "w"}], "conflicts": [{"source": "x", "existing": "y", "incoming": "q", "reason": "r"}]}')
    assert glossary.load_conflicts(spark, f"{tmp_path}/one.json").first()["incoming"] == "q"
    assert [(r["seq"], r["source"]) for r in glossary.load(spark, f"{tmp_path}/one.json").orderBy("seq").collect()] == [(0, "x"), (1, "z")]

def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_figures_of_a_cell_are_read_once(spark):
    from ledgerlens.functions.figures import is_numeric_cell

    cells = spark.createDataFrame([("(1,200)",), ("12% to 5",), ("rose by 7",), (None,)], "t string").select("t", is_numeric_cell(F.col("t")).alias("n"))
    assert [r["n"] for r in cells.collect()] == [True, True, False, False]
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 4


def test_html_is_gathered_once(spark):
    from ledgerlens.operators import tables

    kinds = "table_id int, row int, col int, text string, row_span int, col_span int"
    cells = spark.createDataFrame([(1, 0, 0, "a&", 2, 1), (1, 0, 2, None, 1, 1), (1, 3, 1, "7", 1, 1)], kinds)
    html = tables.to_html(cells, spark.createDataFrame([(1, 1)], "table_id int, n_header int"))
    gap = '<td data-empty="1"></td>'
    rows = [f'<tr><th rowspan="2">a&amp;</th>{gap}<th></th></tr>', f"<tr>{gap * 2}</tr>", f"<tr>{gap * 3}</tr>", f"<tr>{gap}<td>7</td>{gap}</tr>"]
    assert html.first()["rendered"] == f"<table><thead>{rows[0]}</thead><tbody>{''.join(rows[1:])}</tbody></table>"
    assert "LeftAnti" not in _plan(html)


def test_plain_pages_need_no_parser(monkeypatch):
    from ledgerlens.sources import html_tables

    pages = ['<table><caption>c &amp; d</caption><tr><th rowspan="2" data-r="0" data-c="0">a &lt b<br/>x</th><td colspan="2">&#49;</td></tr><tr><td>2</td><td data-empty="1"></td></tr></table> &amp', "<tr><td>1<td>2</table><table><td>3", "no <b>table</b><table><td><i>x</i></td></table>"]
    want = []
    for page in pages:
        parser = html_tables._FirstTable()
        parser.feed(page)
        parser.close()
        parser._close()
        want.append(parser.cells)
    assert [html_tables.parse_table(p) for p in pages] == want
    monkeypatch.setattr(html_tables._FirstTable, "feed", lambda *a: 1 / 0)
    assert html_tables.parse_table(pages[0]) == want[0]


def test_boxes_are_placed_by_one_gathering(spark):
    from ledgerlens.operators import tables

    rows = [(1, c * 10.0, r * 5.0, c * 10.0 + 10, r * 5.0 + 5, r, c) for r in range(3) for c in range(4)] + [(2, 1.0, 1.0, 1.0, 1.0, 0, 0)]
    placed = tables.place_by_boxes(spark.createDataFrame(rows, "table_id int, x0 double, y0 double, x1 double, y1 double, r int, c int"))
    assert placed.where("row = r and col = c and row_span = 1 and col_span = 1").count() == placed.count() == 12
    assert "Window" not in _plan(placed)


def test_raw_cells_through_arrow():
    import pyarrow as pa

    from ledgerlens.operators import tables

    lists = [[{"ord": 1, "text": "a", "x0": None}], [], [{"ord": 2, "text": None, "x0": 1.5}, {"ord": None, "text": "c", "x0": 2.0}]]
    whole = pa.array(lists, pa.list_(pa.struct([("ord", pa.int32()), ("text", pa.string()), ("x0", pa.float64())])))
    assert tables._from_arrow(whole) == lists and tables._from_arrow(whole[1:]) == lists[1:]
    cell = {"ord": 0, "text": "x", "row": 0, "col": 1, "row_span": 1, "col_span": 1, "is_header": None} | dict.fromkeys(("x0", "y0", "x1", "y1"))
    built = [tables.build_one([cell, cell | {"ord": 1}]), tables.build_one([])]
    assert tables._to_arrow(built).to_pylist() == built


def test_slots_are_sorted_natively(spark):
    from ledgerlens.operators import tables

    cells = spark.createDataFrame([(1, 0, 0, "a", 1, 1), (1, 1, 1, "b", 1, 1)], "table_id int, row int, col int, text string, row_span int, col_span int")
    rendered = tables.to_tsv(cells)
    assert rendered.first()["rendered"] == "a\t\n\tb"
    assert "array_sort" not in rendered._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_planned_a_document_at_a_time():
    import pyarrow as pa

    from ledgerlens.operators import chunks

    docs = [[{"pos": i, "span": i // 3, "table": i % 4 == 0, "level": None, "tokens": 40} for i in range(n)] for n in (7, 0, 2)]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("span", pa.int32()), ("table", pa.bool_()), ("level", pa.int32()), ("tokens", pa.int32())]))
    planner = lambda blocks: chunks.plan(blocks, 100, 10, 2, 0.5)
    placed = chunks._placed(pa.array(docs, kind), planner).to_pylist()
    assert placed == [[{"span": s, "chunk": c} for s, c in planner(d)] for d in docs]
