"""Pattern packing, spelling variants and source divergence against brute force, and their edge cases."""

import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import catalogue, divergence, pattern_packing, spelling

DOCS = "doc_id bigint, text string, lang string, source string, word string, n string, term string, part string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], DOCS)


ODD = ["", None, "A B\tc\n\nd", "it's WE'LL 'S x'd 123,45 -- éÉ ΣΣ İ", "<|startoftext|>a<|endoftext|> b", "a\x1cb\x85c\xa0d e　f​g\x0bh", "中文汉字" * 40, "\U0001f600\U0001f600 ﬁ ẛ̣", "x" * 300, "\x00\x01 \x7f", "\r\n \r", "end ́̂ marks"]


def test_chunks_have_the_ids_of_the_whole_text(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = pattern_packing.word_encoder("word_bpe_49k")
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = [t or "" for t in [*ODD, *texts]]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [64, 4096])
def test_pattern_packing(spark, sf, window):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, t, None, None) for i, t in enumerate(ODD)] + [(1, "a b", None, None), (1, "a b", None, None), (None, "c", None, None), (99, "lorem ipsum " * 5000, None, None)]
    rows += [(1000 + r["doc_id"], r["text"], "en", "s") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    # tasks that go through several partitions each
    got = pattern_packing.pattern_pack(docs_of(spark, rows).repartition(9).coalesce(2), window).collect()
    want, sizes = Counter(), []
    for i, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), window)):
            piece = np.array(ids[at : at + window], dtype="<u4")
            want[i, k, at, len(piece), zlib.crc32(piece.tobytes())] += 1
            sizes.append(len(piece))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    least = max(-(-sum(sizes) // window), sum(2 * s > window for s in sizes))
    assert len(sequences) <= 1.02 * least + 2


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, every, shortest, least, ratio):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    by_size, form, out = defaultdict(list), {}, {}
    for w in n:
        by_size[len(w)].append(w)
    for w in n:
        others = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size[size] if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = len(others)
    roots = {}
    for w in n:
        roots[w] = w
        while form[roots[w]] is not None:
            roots[w] = form[roots[w]]
    return {(w, form[w], roots[w], n[w], out[w], n.get(form[w])) for w in n}


def test_spelling_against_brute_force(spark):
    rng = np.random.default_rng(3)
    letters = list("abABéÀ")
    words = ["".join(rng.choice(letters, rng.integers(3, 7))) for _ in range(300)]
    long = ["ab" * 23 + "a", "ab" * 24, "ab" * 24 + "b", "ab" * 20 + "c" + "ab" * 4, "b" * 49, "b" * 50, "z" * 30_000, "z" * 29_999 + "y", "z" * 29_999]
    weights = rng.pareto(0.7, len(words)) + 0.01
    rows = [(i, " ".join(rng.choice(words, 60, p=weights / weights.sum())), "en", "s") for i in range(100)]
    rows += [(200 + i, " ".join(long[: i % len(long) + 1]) + "; 12×÷x_", None, None) for i in range(40)]
    rows += [(None, "ababé ABABÉ aba-aba", None, None), (None, None, None, None), (7, "", "en", None), (7, rows[0][1], "en", "s"), (7, rows[0][1], "en", "s")]
    for every, shortest, least, ratio in ((5, 3, 2, 2), (199, 4, 1, 1.5)):
        got = spelling.spelling_variants(docs_of(spark, rows).repartition(3), every=every, shortest=shortest, least=least, ratio=ratio).collect()
        want = variants(rows, every, shortest, least, ratio)
        assert len(got) == len(want)
        assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
        assert any(r["root"] != r["form"] and r["form"] for r in got) and any(len(r["word"]) > spelling.LONG and r["n_near"] for r in got)


def test_long_digests_tell_forms_apart():
    word = "abca" * 20
    _, holes, cuts = spelling.long_digests(word)
    shorter = [spelling.long_digests(word[:i] + word[i + 1 :])[0] for i in range(len(word))]
    assert cuts == shorter and len(set(cuts)) == 1 + sum(a != b for a, b in zip(word, word[1:], strict=False))
    other = spelling.long_digests(word[:7] + "z" + word[8:])[1]
    assert [i for i in range(len(word)) if holes[i] == other[i]] == [7]


def divergences(rows, least, top):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(w for w, n in docs[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        total = lambda c: sum(c[w] for w in kept)
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (total(c) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        of, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(sum(f(of[s][w], of[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(of[s][w], q[w]), w) for w in kept if counts[lang, s][w] and of[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda v: (-v[0], v[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top}
    return out


def test_divergence_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(w) for w in product("abCé中", repeat=2)] + ["'", "1 2", "x1y", "’", "q" * 70_000]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40))), str(rng.choice(["en", "de"])), f"s{rng.integers(5)}") for i in range(120)]
    rows += [(200, "en only Here", "xx", "a"), (201, "", "xx", "b"), (202, None, "xx", None), (203, "ab", None, None), (204, "ab ab", None, "s1"), (None, None, None, None), (5, "1 2 3", "en", "silent"), (6, "ab", "en", "s1"), (6, "ab", "en", "s1")]
    monkeypatch.setattr(divergence, "HELD", 7)  # counts are handed on many times
    for least, top in ((10, 3), (1, 10)):
        got = divergence.source_divergence(docs_of(spark, rows).repartition(4), least, top).collect()
        want = divergences(rows, least, top)
        assert len(got) == len(want)
        assert {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got} == want


def test_shares_of_very_large_counts(spark):
    df = spark.createDataFrame([(9 * 10**17, 10**18, 10**9), (0, 0, 1)], "n bigint, total bigint, v bigint")
    got = [r[0] for r in df.select(divergence.share(df.n, df.total, df.v)).collect()]
    assert got == [1 + 10**9 * (9 * 10**17 + 2) // (10**18 + 2 * 10**9), 10**9 + 1]


def test_empty_tables(spark):
    none = docs_of(spark, [(1, "a", "b", "c")]).where("false")
    for run in (pattern_packing.pattern_pack, spelling.spelling_variants, divergence.source_divergence):
        assert run(none).collect() == []
    silent = docs_of(spark, [(None, None, None, None), (1, "", "en", "a"), (2, "..", "en", "b")])
    assert len(pattern_packing.pattern_pack(silent).collect()) == 3
    assert spelling.spelling_variants(silent).collect() == []
    assert {(r["source"], r["item"], r["value"]) for r in divergence.source_divergence(silent).collect()} == {("a", "b", 0), ("b", "a", 0)}


def test_executors_need_not_have_the_package(tmp_path):
    """Every query of this subpackage, on workers that can't import it."""
    script = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {str(Path(catalogue.__file__).parents[2])!r})
from ledgerlens.llm import catalogue
def there(batches):
    import importlib.util
    for batch in batches:
        batch["there"] = importlib.util.find_spec("ledgerlens") is not None
        yield batch[["there"]]
assert not spark.range(1).mapInPandas(there, "there boolean").first()[0]
for name, query in catalogue.QUERIES.items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
"""
    (tmp_path / "run.py").write_text(script)
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("ran ") == len(catalogue.QUERIES), done.stderr[-3000:]
