"""The pipeline, stage by stage, against brute force over small tables with odd rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline as P
from ledgerlens.llm import mixing, packing, simhash, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, dropped string, __doc string, copies int, rate string"


def write(folder, spark, rows):
    spark.createDataFrame([(*r, None, "x", "y", 1, "z") for r in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, int("idiot" in (t or ""))) for i, t, *_ in rows if i is not None and i % 3] + [(None, 1, 0), (10**9, None, None)]
    spark.createDataFrame(labels if rows else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrst"))
    words = lambda n: " ".join("".join(rng.choice(letters, 9)) for _ in range(n))
    passage = words(55)
    rows = []
    for i in range(60):
        text = "\n".join(words(25) for _ in range(4)) + (f"\n{passage}" if i % 6 == 0 else "")
        text += " you are a pathetic idiot and a moron\nstupid worthless clown" if i % 7 == 3 else ""
        rows.append((i, text, "en", "s"))
    rows += [(100 + i, rows[0][1].replace(" ", "  ", i), "en", "s") for i in range(4)]
    edited = rows[1][1].split(" ")
    edited[30] = "changed"
    rows += [(110, " ".join(edited), None, None), (111, None, None, None), (112, "", "en", None), (113, "a" * 50_000 + " " + words(30), "en", "s"), (2, rows[2][1], "en", "s"), (None, words(20), "en", "s"), (None, None, None, None)]
    return write(tmp_path_factory.mktemp("sf"), spark, rows)


@pytest.fixture(scope="module")
def stages(spark, odd):
    docs, out = spark.read.parquet(f"{odd}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = stage(spark, docs, odd).cache()
        out.append((name, docs, after))
        docs = after
    return {n: (b.collect(), a.collect(), b, a) for n, b, a in out}


def test_columns(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name][3].columns == P.COLUMNS


def test_toxicity(spark, odd, stages):
    before, after, docs, _ = stages["toxicity"]
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{odd}/labels.parquet"))
    clean = [r["doc_id"] for r in before if model.score([r["text"] or ""])[0] < 0.7]
    assert Counter(r["doc_id"] for r in after) == Counter(clean)
    assert not any("idiot" in (r["text"] or "") for r in after) and {i for i in range(60) if i % 7 != 3} <= set(clean)


def test_line_dedup(stages):
    before, after, _, _ = stages["line_dedup"]
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
    texts = defaultdict(list)
    for r in before:
        texts[r["doc_id"]].append(r["text"])
    for r in after:
        if r["doc_id"] is not None and r["doc_id"] < 60:
            lines = texts[r["doc_id"]][0].split("\n")
            assert r["text"] == "\n".join(lines[:4])
        if r["text"] is None:
            assert None in texts[r["doc_id"]]


def test_near_dup(stages):
    before, after, _, _ = stages["near_dup"]
    prints = [simhash.fingerprint(simhash.shingle_hashes(r["text"] or "", 5), 4) for r in before]
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if sum((a ^ b & -1).bit_count() if a ^ b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= 51:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    least = {}
    for r, c in zip(before, root, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert Counter(r["doc_id"] for r in after if r["doc_id"] is not None) == Counter(least.values())
    assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)
    assert not {100, 101, 102, 103, 110} & {r["doc_id"] for r in after}


def test_mixing(spark, odd, stages):
    before, after, docs, _ = stages["mixing"]
    want = Counter()
    for r in mixing.mix(docs, spark.read.parquet(f"{odd}/labels.parquet")).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in after) == +want and len(before) > 10


def test_packing(stages):
    before, after, _, _ = stages["packing"]
    encode = packing.encoder().encode_ordinary
    tokens = sum(len(encode(r["text"] or "")) + 1 for r in before)
    assert sum(r["length"] for r in after) == tokens
    ends = defaultdict(int)
    for r in after:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048 and len({(r["sequence_id"], r["offset"]) for r in after}) == len(after)


def test_run_and_empty_tables(spark, odd, tmp_path):
    assert __spark_entry__.queries()["pipeline"](spark, odd).count() > 10
    assert P.run(spark, write(tmp_path, spark, [])).count() == 0


def test_very_long_word():
    assert len(packing.encoder().encode_ordinary("a" * 300_000)) > 1000


def test_sampled_keys_of_no_words():
    assert simhash.sample_keys(np.zeros(0, dtype=np.uint64)) == [0] * simhash.SAMPLES
