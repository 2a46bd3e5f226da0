"""Terminology: candidates, authority merge, hits and violations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import cjk_ratio, normalize_whitespace
from ledgerlens.operators.keep import writer

#: Authorities by rank, the strongest first.
AUTHORITIES = ("source_gloss", "curated", "seed", "model")
TITLE = r"(?:[A-Z][a-z]+(?: (?:of|and|the|for))? ){1,4}[A-Z][a-z]+"


def rank_of(authority: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(a) for a in AUTHORITIES]), authority), F.lit(0))


def merge(events: DataFrame, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(glossary, conflicts) of events (seq, source, target, authority, frequency), keyed by the lower-cased source.

    The strongest authority wins, the earliest among equals; frequencies of the winning target add up; every other target is a
    conflict. Window sums by key: the outcome is the same for any partitioning.
    """
    key = [*(scope or []), "key"]
    e = events.withColumn("key", F.lower("source")).withColumn("rank", rank_of(F.col("authority")))
    w = Window.partitionBy(*key)
    first = F.first(F.struct("source", "target", "authority", "rank")).over(w.orderBy("rank", "seq"))
    e = e.withColumn("win", first)
    won = e.where(F.col("target") == F.col("win.target"))
    glossary = won.groupBy(*key).agg(F.first("win").alias("win"), F.sum("frequency").alias("frequency")).select(*key, "win.source", "win.target", "win.authority", "frequency")
    lost = e.where(F.col("target") != F.col("win.target"))
    reason = F.when(F.col("rank") == F.col("win.rank"), "same authority, later").otherwise("lower authority")
    conflicts = lost.select(*key, F.col("win.target").alias("kept"), F.col("target").alias("dropped"), reason.alias("reason")).distinct()
    return glossary, conflicts


def acronyms(text: Column) -> Column:
    """Upper-case abbreviations of 2 to 6 letters, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,6}\b"), F.lit(0)))


def title_phrases(text: Column) -> Column:
    """Title-case phrases of 6 to 60 characters, each once, in order."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(TITLE), F.lit(0))), lambda p: F.length(p).between(6, 60))


#: Abbreviations that are no terms, and those that a Chinese report keeps in Latin script.
NO_TERMS = (
    "THE", "AND", "FOR", "NOT", "ALL", "ANY", "OUR", "ITS", "YOU", "MAY", "CAN", "HK", "US", "UK", "EU", "PRC", "LTD", "PLC", "INC", "CO", "NO", "VS", "ESG", "AGM", "EGM", "PDF", "HTML", "URL", "API", "ID", "OK", "N", "A",
)
PRESERVED = (
    "IFRS", "HKFRS", "IFRIC", "GAAP", "RMB", "CNY", "HKD", "USD", "EUR", "JPY", "IPO", "REIT", "ETF", "SPV", "JV", "MOU", "NDA", "SLA", "KPI", "ROI", "CEO", "CFO", "COO", "CTO", "CIO", "MD", "VP", "HR", "IT", "R&D",
    "EBIT", "EBITDA", "EPS", "ROE", "ROA", "ROIC", "NAV", "NTA", "PE", "PB", "CAGR", "TSR", "WACC", "DCF", "NPV", "IRR", "PPE", "VAT", "CIT", "EIT", "Q1", "Q2", "Q3", "Q4", "H1", "H2", "FY", "YTD", "YOY", "MOM", "QOQ",
    "AI", "ML", "SaaS", "IaaS", "PaaS", "CRM", "ERP", "IoT", "API", "A", "H", "B", "X", "N", "T", "M", "U", "DRA",
)
#: What an abbreviation and a phrase of capitalised words are; neither may stand within a word of any script.
ACRONYM = r"(?<![\p{L}\p{N}_])[A-Z]{2,8}(?:/[A-Z]{2,4})?(?![\p{L}\p{N}_])"
PHRASE = r"(?<![\p{L}\p{N}_])[A-Z][a-z]{2,}(?:\s+(?:of|and|the|for)?\s*[A-Z][a-z]{2,}){1,3}(?![\p{L}\p{N}_])"


def candidates(text: Column, stop: tuple[str, ...] = NO_TERMS + PRESERVED, limit: int = 400, known: Column | None = None) -> Column:
    """Term candidates of a text: abbreviations that are not in `stop`, then the `known` terms that the text holds (an array, if given), then phrases of capitalised words of 6 to 60 characters; each once whatever its case, at most `limit`."""
    every = lambda pattern: F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    short = every(ACRONYM)
    if stop:
        short = F.filter(short, lambda a: ~a.isin(*stop))
    held = F.array().cast("array<string>") if known is None else F.coalesce(known, F.array().cast("array<string>"))
    found = F.concat(short, held, F.filter(every(PHRASE), lambda p: F.length(p).between(6, 60)))
    low = F.transform(found, F.lower)
    first = F.filter(found, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    return F.coalesce(F.slice(first, 1, limit), F.array().cast("array<string>"))


def prompt_block(pairs: Column, limit: int = 60) -> Column:
    """Text block of the first `limit` pairs (struct of source, target), one line for each; empty without any."""
    lines = F.transform(F.slice(pairs, 1, limit), lambda p: F.concat(F.lit("- "), p["source"], F.lit(" => "), p["target"]))
    head = F.lit("Approved terminology (use these exact translations):\n")
    return F.when(F.size(lines) > 0, F.concat(head, F.array_join(lines, "\n"))).otherwise("")


def hits(texts: DataFrame, terms: DataFrame, text_col: str, cap: int | None = None) -> DataFrame:
    """Terms that occur in texts as whole words: texts' columns without the text, term columns, position.

    The terms meet the texts through an equi-join on n-grams, of the lengths that terms really have, not by trying all terms on
    all texts. `terms` has column key: lower-case words with one space between. With `cap` a text keeps its longest terms.
    """
    low = F.regexp_extract_all(F.lower(text_col), F.lit(r"[a-z0-9]+"), F.lit(0))
    rest = [c for c in texts.columns if c != text_col]
    lengths = sorted(terms.agg(F.collect_set(F.size(F.split("key", " ")))).first()[0])  # a few numbers
    out = None
    for n in lengths:
        t = texts.select(*rest, low.alias("w")).where(F.size("w") >= n)
        gram = "w[i]" if n == 1 else "concat_ws(' ', " + ", ".join(f"w[i + {k}]" for k in range(n)) + ")"
        at = t.select(*rest, F.posexplode(F.expr(f"transform(sequence(0, size(w) - {n}), i -> {gram})")).alias("position", "key"))
        found = at.join(terms.where(F.size(F.split("key", " ")) == n), "key").groupBy(*rest, *terms.columns).agg((F.min("position") + 1).alias("position"))
        out = found if out is None else out.union(found)
    if out is None:
        return texts.select(*rest).crossJoin(terms.limit(0)).withColumn("position", F.lit(0)).limit(0)
    if cap is None:
        return out
    w = Window.partitionBy(*rest).orderBy(F.desc(F.length("key")), "key")
    return out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def violations(pairs: DataFrame, terms: DataFrame, source: str, target: str) -> DataFrame:
    """Terms (key, target_term) whose source occurs but whose target is not in the target text: pairs' columns and key."""
    row = "__row"
    rows = pairs.withColumn(row, F.xxhash64(source, target))
    found = hits(rows.select(row, source).distinct(), terms.select("key", "target_term"), source)
    rest = [c for c in pairs.columns if c != source]
    return rows.select(row, *rest).join(found, row).where(~F.contains(F.lower(target), F.lower("target_term"))).drop(row)


#: Forms in which a text gives both names of a thing, the groups being the first and the second name; and what in brackets is no name.
BILINGUAL = (
    r"([A-Za-z][A-Za-z0-9 ,&/'\-]{1,60}?)\s*[（(]\s*([一-鿿][一-鿿0-9A-Za-z、，,\.\-]{0,40}?)\s*[）)]",
    r"([一-鿿][一-鿿0-9、，,\.\-]{1,30}?)\s*[（(]\s*[\"'“”]([^)\"'“”]{1,30})[\"'“”]\s*[）)]",
    r"([一-鿿][一-鿿0-9、，,\.\-]{1,30}?)\s*[（(]\s*([A-Z][A-Za-z0-9 ,&/'\-]{1,60}?)\s*[）)]",
    r"([一-鿿]{2,30}?)\s*[（(]\s*([A-Z]{2,8})\s*[）)]",
)
NO_NAME = r"(?i)^(?:注|note|see|第|共|单位|元|%|rmb|in\s|as\s|以下|上述|[0-9])"


def bilingual_pairs(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, source, target): Latin name and CJK name that stand together, one of them in brackets; of a source the first target counts, in the order of the forms.

    Names of under two characters, cross-references, units and numbers are none; both names must not be of one script. "and", "or" and "nor" before a name go.
    """
    parts = []
    for i, pattern in enumerate(BILINGUAL):
        first, second = (F.regexp_extract_all(text_col, F.lit(pattern), F.lit(g)) for g in (1, 2))
        pair = texts.select(key, F.lit(i).alias("form"), F.posexplode(F.arrays_zip(first.alias("a"), second.alias("b"))).alias("at", "x"))
        left = F.regexp_replace(F.trim(normalize_whitespace(F.col("x.a")), F.lit(" -–—:：")), r"^(?i:and|or|nor)\s+", "")
        parts.append(pair.select(key, "form", "at", left.alias("a"), F.trim(normalize_whitespace(F.col("x.b")), F.lit(" -–—:：“”\"'")).alias("b")))
    both = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    both = both.where("length(a) >= 2 and length(b) >= 2").where(~F.col("a").rlike(NO_NAME) & ~F.col("b").rlike(NO_NAME))
    a_cjk, b_cjk = cjk_ratio(F.col("a")) > 0.5, cjk_ratio(F.col("b")) > 0.5
    both = both.where(a_cjk != b_cjk).select(key, "form", "at", F.when(a_cjk, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(a_cjk, F.col("a")).otherwise(F.col("b")).alias("target"))
    w = Window.partitionBy(key, F.lower("source")).orderBy("form", "at")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").select(key, "source", "target")


# ---- terms in texts, by substrings


#: Lengths of the pieces by which names meet texts; a name is met by a piece of the largest length that it has.
PIECES = (8, 4, 2, 1)
#: Names of no more lengths than there are in PIECES, and none longer than this, are met whole.
WHOLE = 32


def _with_aliases(terms: DataFrame) -> DataFrame:
    aliases = F.col("aliases") if "aliases" in terms.columns else F.array().cast("array<string>")
    return terms.select("source", "target", F.coalesce(aliases, F.array().cast("array<string>")).alias("aliases"))


def pieces(text: Column, n: int) -> Column:
    """The distinct pieces of n characters of a text, in time linear in its length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def dictionary(names: DataFrame, low: DataFrame, every: int = 64) -> tuple[DataFrame, list[int], bool]:
    """((name, piece), lengths of pieces, whether the pieces are the whole names): each name with the piece that the fewest texts hold, by the texts of one in `every` hashes, then the fewest names.

    Which piece stands for a name bears on the speed alone: every text that holds the name holds each of its pieces. Where names have few lengths (see `WHOLE`), a name is its own piece.
    """
    sized = names.withColumn("length", F.least(F.char_length("name"), F.lit(WHOLE + 1)))
    lengths = sorted(sized.agg(F.collect_set("length")).first()[0])  # WHOLE + 1 numbers at most
    if not lengths or (len(lengths) <= len(PIECES) and lengths[-1] <= WHOLE):
        return names.select("name", F.col("name").alias("piece")), lengths, True
    lengths = sorted({max(n for n in PIECES if n <= size) for size in lengths})
    own = F.coalesce(*[F.when(F.char_length("name") >= n, pieces(F.col("name"), n)) for n in PIECES])
    every_piece = names.select("name", F.posexplode(own).alias("at", "piece"))
    shared = every_piece.groupBy("piece").agg(F.count(F.lit(1)).alias("names"))
    some = low.where(F.pmod(F.xxhash64("__low"), F.lit(every)) == 0)
    seen = some.select(F.explode(F.flatten(F.array(*[pieces(F.col("__low"), n) for n in lengths]))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("texts"))
    weighed = every_piece.join(shared.join(seen, "piece", "left"), "piece")
    rank = F.struct(F.coalesce("texts", F.lit(0)), "names", "at")
    return weighed.groupBy("name").agg(F.min_by("piece", rank).alias("piece")), lengths, False


def holdings(texts: DataFrame, names: DataFrame, every: int = 64) -> DataFrame:
    """(__text, name), some of them repeated: the names (not empty, each once) that stand in the texts (__text, __low), case as it is; __text names a text.

    Nothing is gathered and nothing is tried out on all texts: each name has one piece, the rarest of its characters in a row (see `dictionary`), and meets the texts by an equi-join on that piece. A
    name that is its piece is found by that, and no text is shuffled; a longer one is looked for in the texts that it has met, which are brought to their hits by one join. The dictionary is written first, so that its size is
    known: where it is small Spark broadcasts it, and the texts' pieces are not shuffled; otherwise both sides are shuffled by piece, of which adaptive execution splits those that are very frequent.
    """
    held, lengths, entire = dictionary(names, texts, every)
    held = writer(texts.sparkSession)(held)
    if not lengths:
        return texts.select("__text", F.lit("").alias("name")).where("false")
    met = texts.select("__text", F.explode(F.flatten(F.array(*[pieces(F.col("__low"), n) for n in lengths]))).alias("piece")).join(held, "piece")
    if entire:
        return met.select("__text", "name")
    whole = met.where(F.char_length("name") == F.char_length("piece")).select("__text", "name")
    longer = met.where(F.char_length("name") > F.char_length("piece")).select("__text", "name").join(texts, "__text").where(F.contains("__low", "name")).select("__text", "name")
    return whole.unionByName(longer)


def _names(terms: DataFrame) -> DataFrame:
    """(source, target, name): each of a term's names in lower case, but for empty ones."""
    return _with_aliases(terms).select("source", "target", F.explode(F.array_distinct(F.transform(F.concat(F.array("source"), "aliases"), F.lower))).alias("name")).where("name <> ''").distinct()


def term_rows(texts: DataFrame, keys: list[str], text_col: str, terms: DataFrame, every: int = 64) -> DataFrame:
    """(keys, source, target), each once: the terms (source, target, aliases) of which the source or an alias stands anywhere in a text, whatever the case and the script.

    By `holdings`. Null texts are empty; an empty name is in no text.
    """
    named = _names(terms)
    low = texts.select(*keys, F.lower(F.coalesce(text_col, F.lit(""))).alias("__low")).where("__low <> ''")
    # keys may be repeated and null
    low = low.select(F.struct(*keys, F.xxhash64("__low").alias("__hash")).alias("__text"), "__low")
    found = holdings(low, named.select("name").distinct(), every).join(named, "name")
    return found.select(*[F.col("__text")[k].alias(k) for k in keys], "source", "target").distinct()


def text_terms(texts: DataFrame, keys: list[str], text_col: str, terms: DataFrame) -> DataFrame:
    """(keys, found): array of (source, target) in each text, the longest source first; texts without a term are left out."""
    found = F.array_sort(F.collect_list(F.struct((-F.length("source")).alias("n"), F.struct("source", "target").alias("t"))))
    return term_rows(texts, keys, text_col, terms).groupBy(*keys).agg(F.transform(found, lambda x: x["t"]).alias("found"))


def missing_terms(pairs: DataFrame, keys: list[str], source: str, target: str, terms: DataFrame, around: int = 40, context: bool = True) -> DataFrame:
    """(keys, source, target, context): terms in the source text whose target does not stand in the target text, with what is around the first place; each once for a pair of texts.

    Both texts are searched by `holdings`, and what they hold is compared: no text goes to another task but to take its context, which can be left out.
    """
    named = _names(terms).where("source <> '' and target <> ''")
    row = F.struct(*keys, F.xxhash64(F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))).alias("__hash"))
    text = lambda c: pairs.select(row.alias("__text"), F.coalesce(c, F.lit("")).alias("__low")).where("__low <> ''")
    found = holdings(text(F.lower(source)), named.select("name").distinct()).join(named, "name").select("__text", "source", "target").distinct()
    there = holdings(text(F.col(target)), named.select(F.col("target").alias("name")).distinct()).select("__text", F.col("name").alias("target"))
    lost = found.join(there, ["__text", "target"], "left_anti").select("__text", "source", "target")
    if not context:
        return lost.select(*[F.col("__text")[k].alias(k) for k in keys], "source", "target")
    lost = lost.join(pairs.select(row.alias("__text"), F.col(source).alias("__s")).dropDuplicates(["__text"]), "__text")
    at = F.position(F.lower("source"), F.lower("__s"))
    start = F.greatest(at - around, F.lit(1))
    around_it = F.when(at > 0, normalize_whitespace(F.substr("__s", start, at - start + F.length("source") + around))).otherwise("")
    return lost.select(*[F.col("__text")[k].alias(k) for k in keys], "source", "target", around_it.alias("context"))


# ---- the glossary as a table


def fold_events(events: list[dict]) -> dict:
    """What a term's events (target, authority, frequency, aliases), in order, come to: the entry that stands, and conflicts.

    Agreement adds frequencies and aliases and keeps the stronger authority; a stronger authority replaces; otherwise the first stands. Every clash is recorded.
    """
    rank = {a: i for i, a in enumerate(AUTHORITIES)}
    held, clashes = None, []
    for e in events:
        e = dict(e) | {"aliases": list(e["aliases"] if e["aliases"] is not None else [])}
        strength = rank.get(e["authority"], 99)
        if held is None:
            held = e
            continue
        standing = rank.get(held["authority"], 99)
        if held["target"] == e["target"]:
            if strength < standing:
                held["authority"] = e["authority"]
            held["frequency"] += e["frequency"]
            held["aliases"] += [a for a in e["aliases"] if a not in held["aliases"]]
        elif strength < standing:
            clashes.append({"existing": held["target"], "incoming": e["target"], "reason": f"replaced {held['authority']} with higher-authority {e['authority']}"})
            held = e
        else:
            why = "superseded by higher authority" if strength > standing else "equal-authority disagreement; kept first entry"
            clashes.append({"existing": held["target"], "incoming": e["target"], "reason": why})
    return {k: held[k] for k in ("source", "target", "authority", "frequency", "aliases")} | {"conflicts": clashes}


def fold(events: DataFrame, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, conflicts) of events (seq, source, target, authority, frequency, aliases), keyed by the lower-cased source, folded in order of seq within scope.

    Exact repeats in a row of one key first become one event with their frequencies' sum, so that a term of very many events is no large group.
    """
    key = [*(scope or []), "key"]
    e = events.withColumn("key", F.lower("source"))
    if "aliases" not in e.columns:
        e = e.withColumn("aliases", F.array().cast("array<string>"))
    w = Window.partitionBy(*key).orderBy("seq")
    same = F.struct("target", "authority", F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))))
    e = e.withColumn("__same", same).withColumn("__new", (~F.lag("__same").over(w).eqNullSafe(F.col("__same"))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    runs = e.groupBy(*key, "__run").agg(F.min("seq").alias("seq"), F.min_by("source", "seq").alias("source"), F.first("target").alias("target"), F.first("authority").alias("authority"), F.sum("frequency").cast("bigint").alias("frequency"), F.first("aliases").alias("aliases"))
    gathered = runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "source", "target", "authority", "frequency", "aliases"))).alias("e"))

    @F.pandas_udf("source string, target string, authority string, frequency bigint, aliases array<string>, conflicts array<struct<existing: string, incoming: string, reason: string>>")
    def folded(keys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fold_events(list(k)) for k in keys], columns=["source", "target", "authority", "frequency", "aliases", "conflicts"])

    out = gathered.select(*key, folded("e").alias("f")).select(*key, "f.*")
    return out.drop("conflicts"), out.select(*key, "source", F.inline("conflicts"))


def build(texts: DataFrame, doc: str, text_col: str, seeds: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(entries, conflicts) of the texts (doc, seq, text): the seed lexicon (source, target), pairs that the texts give themselves, and a count for each text that holds a seed.

    Entries of a document are those of terms that its texts hold or give. The lexicon itself stands once, under a null document: what it says holds for each
    document that has no entry of its own (see `lookup` and `of_document`). A seed counts only while no stronger authority has taken its place, so counts of seeds whose pair the document gives are left out from then on.
    """
    t = texts.withColumn("__id", F.struct(doc, "seq"))
    given = bilingual_pairs(t.select("__id", text_col), "__id", text_col).select(F.col(f"__id.{doc}").alias(doc), F.col("__id.seq").cast("double").alias("seq"), "source", "target", F.lit("source_gloss").alias("authority"))
    counted = term_rows(t, [doc, "seq"], text_col, seeds).select(doc, (F.col("seq") + 0.5).alias("seq"), "source", "target", F.lit("seed").alias("authority"))
    taken = given.groupBy(doc, F.lower("source").alias("k")).agg(F.min("seq").alias("from"))
    held = counted.withColumn("k", F.lower("source")).join(taken, [doc, "k"], "left").where("from is null or seq < from").drop("k", "from")
    # the lexicon's own event comes first in each document that has any other of its term
    lexicon = seeds.select("source", "target", F.lower("source").alias("k"), F.lit("seed").alias("authority"))
    touched = counted.unionByName(given).select(doc, F.lower("source").alias("k")).distinct()
    base = touched.join(lexicon, "k").select(doc, F.lit(-1.0).alias("seq"), "source", "target", "authority")
    shared = lexicon.select(F.lit(None).cast(dict(texts.dtypes)[doc]).alias(doc), F.lit(-1.0).alias("seq"), "source", "target", "authority")
    entries, clashes = fold(base.unionByName(shared).unionByName(given).unionByName(held).withColumn("frequency", F.lit(1)), [doc])
    return prune(entries, least), clashes


def of_document(entries: DataFrame, doc: str, value) -> DataFrame:
    """All entries that hold for a document: its own, and those of the lexicon that it has none of its own for."""
    own = entries.where(F.col(doc).eqNullSafe(F.lit(value)))
    return own.unionByName(entries.where(F.col(doc).isNull()).join(own.select("key"), "key", "left_anti")).withColumn(doc, F.lit(value))


def prune(entries: DataFrame, least: int = 1, drop_seed: bool = False) -> DataFrame:
    """Entries of at least this frequency, and without those of the seed lexicon if asked for."""
    return entries.where((F.col("frequency") >= least) & (F.lit(not drop_seed) | (F.col("authority") != "seed")))


def lookup(df: DataFrame, term: str, entries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """df with `translation`: the target of the entry for column `term`, whatever its case; the term itself without one.

    With a scope (the document of `build`'s entries) a row takes the entry of its own scope, else the lexicon's, which is the one of a null scope.
    """
    e = entries.select(*(scope or []), F.lower("source").alias("__k"), F.col("target").alias("__t"))
    out = df.withColumn("__k", F.lower(term))
    if not scope:
        return out.join(e, "__k", "left").withColumn("translation", F.coalesce("__t", term)).drop("__k", "__t")
    shared = e.where(" and ".join(f"{c} is null" for c in scope)).select("__k", F.col("__t").alias("__shared"))
    out = out.join(e, [*scope, "__k"], "left").join(shared, "__k", "left")
    return out.withColumn("translation", F.coalesce("__t", "__shared", term)).drop("__k", "__t", "__shared")


def coverage(texts: DataFrame, keys: list[str], text_col: str, entries: DataFrame) -> DataFrame:
    """(keys, coverage): share of a text's candidates (terms of entries that it holds among them) that have an entry; 1 without candidates."""
    held = term_rows(texts, keys, text_col, entries).groupBy(*keys).agg(F.array_sort(F.collect_set("source")).alias("__held"))
    c = texts.join(held, keys, "left").select(*keys, F.explode_outer(candidates(F.col(text_col), known=F.col("__held"))).alias("term"))
    known = c.join(entries.select(F.lower("source").alias("k"), F.lit(1).alias("hit")).distinct(), F.lower("term") == F.col("k"), "left")
    return known.groupBy(*keys).agg(F.coalesce(F.count("hit") / F.nullif(F.count("term"), F.lit(0)), F.lit(1.0)).alias("coverage"))


def by_authority(entries: DataFrame) -> DataFrame:
    return entries.groupBy("authority").agg(F.count(F.lit(1)).alias("n"))


def save(entries: DataFrame, clashes: DataFrame, path: str) -> None:
    """Entries (sorted by source) and conflicts as JSON Lines, in two folders under path."""
    entries.orderBy("source").write.mode("overwrite").json(f"{path}/entries")
    clashes.write.mode("overwrite").json(f"{path}/conflicts")


ENTRY = "struct<source: string, term: string, target: string, translation: string, authority: string, frequency: bigint, aliases: array<string>>"


def load(spark, path: str) -> DataFrame:
    """Events (seq, source, target, authority, frequency, aliases) of a glossary: a folder that `save` wrote, or JSON files that are a list of entries or an object with `entries`."""
    raw = spark.read.text(path, wholetext=False) if path.rstrip("/").endswith("entries") else spark.read.text(path, wholetext=True)
    at = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    entries = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{ENTRY}>")).when(F.get_json_object("value", "$.entries").isNotNull(), F.from_json("value", f"struct<entries: array<{ENTRY}>>")["entries"]).otherwise(F.array(F.from_json("value", ENTRY)))
    e = raw.select(at.alias("at"), F.posexplode(entries).alias("i", "e"))
    e = e.orderBy("at", "i").withColumn("seq", F.monotonically_increasing_id())  # ranges in the order of the files, numbered without one task for all
    return e.select(
        "seq", F.trim(F.coalesce("e.source", "e.term", F.lit(""))).alias("source"), F.trim(F.coalesce("e.target", "e.translation", F.lit(""))).alias("target"), F.coalesce("e.authority", F.lit("curated")).alias("authority"),
        F.coalesce("e.frequency", F.lit(1)).alias("frequency"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"),
    )


def load_conflicts(spark, path: str) -> DataFrame:
    """Conflicts (source, existing, incoming, reason) of a saved glossary: the folder that `save` wrote, or JSON files that are an object with `conflicts`; none where there are none."""
    clash = "source string, key string, existing string, incoming string, reason string"
    if path.rstrip("/").endswith("conflicts"):
        rows = spark.read.schema(clash).json(path)
    else:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "conflicts array<struct<" + clash.replace(" string", ": string") + ">>")["conflicts"].alias("c"))
        rows = whole.select(F.inline("c"))
    return rows.select(F.coalesce("source", "key").alias("source"), "existing", "incoming", "reason")
