"""Comparison of figures between a source and a target, and of tables slot by slot."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.figures import figures, raw_figures
from ledgerlens.functions.units import UNKNOWN, mentions_note, unit_from_note
from ledgerlens.operators.keep import writer

#: Digits of a slip at most, and relative change up to which two figures are one that was changed.
SLIP, NEAR = 2, 0.02
FINDING = "array<struct<kind: string, source_at: int, target_at: int, edits: int, change: double>>"
KINDS = ("matched", "mismatched", "missing", "added")


def outer(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """source and target fully outer-joined on key: key, __s and __t (structs of the other columns of each side, null where a side has no row), and __alone: whether no side has a second row of that key.

    Both sides go through one sort by key rather than a join, so that rows that are dealt out by a part of the key already stay where they are. Rows with a null in the key meet none, as in a join.
    """
    s = F.struct(*[c for c in source.columns if c not in key])
    t = F.struct(*[c for c in target.columns if c not in key])
    left, right = source.select(*key, s.alias("__s")), target.select(*key, t.alias("__t"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = left.select("*", none(right, "__t")).union(right.select(*key, none(left, "__s"), "__t"))
    whole = F.expr("true")
    for k in key:
        whole = whole & F.col(k).isNotNull()
    w = Window.partitionBy(*key)
    own = F.array(F.col("__t"))  # of one side alone: its row as it is
    met = both.withColumn("__ts", F.collect_list("__t").over(w)).withColumn("__n", F.count("__s").over(w)).where(F.col("__s").isNotNull() | (F.col("__n") == 0) | ~whole)
    targets = F.when(F.col("__s").isNull() | ~whole, own).when(F.size("__ts") == 0, own).otherwise(F.col("__ts"))
    alone = (F.size("__ts") <= 1) & (F.col("__n") <= 1)
    return met.select(*key, "__s", F.explode(targets).alias("__t"), alone.alias("__alone"))


def match_exact(source: DataFrame, target: DataFrame, owner: list[str]) -> DataFrame:
    """Multiset join of figures on (owner, dimension, base_value): owner, bucket (matched, missing, added), source and target raw text and ordinal.

    Equal figures of an owner are numbered on both sides, so each source figure meets one target figure at most, by two sorts and one equi-join.
    """
    key = [*owner, "dimension", "base_value"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))
    s = source.select(*key, F.col("raw").alias("source_raw"), F.col("ordinal").alias("source_ordinal"), number.alias("n"))
    t = target.select(*key, F.col("raw").alias("target_raw"), F.col("ordinal").alias("target_ordinal"), number.alias("n"))
    joined = outer(s, t, [*key, "n"]).select(*key, F.col("__s.source_raw").alias("source_raw"), F.col("__s.source_ordinal").alias("source_ordinal"), F.col("__t.target_raw").alias("target_raw"), F.col("__t.target_ordinal").alias("target_ordinal"))
    bucket = F.when(F.col("target_raw").isNull(), "missing").when(F.col("source_raw").isNull(), "added").otherwise("matched")
    return joined.withColumn("bucket", bucket)


#: Width of a value band: values within a relative 0.02 are at most one band apart.
BAND = 0.0203


def _shortened(digits: Column) -> Column:
    """What two deletions leave of a string of digits, each once. Strings of one length at an edit distance of two or less have one of these in common: two replacements, or an insertion with a deletion, leave all but two digits as they are."""
    n = F.char_length(digits)
    cut = lambda i, j: F.concat(F.substr(digits, F.lit(1), i - 1), F.substr(digits, i + 1, j - i - 1), F.substr(digits, j + 1))
    every = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: cut(i, j))))
    return F.when(n <= 2, F.array(F.lit(""))).otherwise(F.array_distinct(every))


def near_pairs(missing: DataFrame, added: DataFrame, owner: list[str], max_edits: int = 2, relative: float = 0.02) -> DataFrame:
    """Pairs of figures (owner, dimension, ordinal, raw, value) of two sides that differ by a slip: owner, source_ordinal, target_ordinal, source_raw, target_raw, edits, change.

    Digits must be as many; edits at most `max_edits` (two at most) or values within `relative` (0.02 at most). Figures meet by equal keys, not each with each: what two deletions leave of their digits, and bands of
    their values' logarithms, the source's with both its neighbours.
    """
    if max_edits > SLIP or relative > NEAR:
        raise ValueError(f"keys are made for {SLIP} edits and a relative change of {NEAR}")
    # owners may have any names
    digits = lambda df: df.withColumn("__digits", F.regexp_replace("raw", "[^0-9]", "")).withColumn("__n", F.length("__digits"))
    band = F.floor(F.log(F.greatest(F.abs("value"), F.lit(1e-12))) / BAND).cast("int")
    keys = lambda df, spread: df.withColumn("__key", F.explode(F.concat(F.transform(_shortened(F.col("__digits")), lambda k: F.concat(F.lit("d"), k)), F.transform(F.array(*[band + i for i in spread]), lambda v: F.concat(F.lit("v"), v.cast("string"))))))
    met = [*owner, "dimension", "__n", "__key"]
    figure = lambda name: F.struct("ordinal", "raw", "value", F.col("__digits").alias("digits")).alias(name)
    pairs = keys(digits(missing), (-1, 0, 1)).select(*met, figure("__s")).join(keys(digits(added), (0,)).select(*met, figure("__t")), met).select(*owner, "__s", "__t").distinct()
    change = F.abs(F.col("__s.value") - F.col("__t.value")) / F.greatest(F.abs("__s.value"), F.lit(1e-12))
    pairs = pairs.withColumn("edits", F.levenshtein("__s.digits", "__t.digits")).withColumn("change", change).where((F.col("edits") <= max_edits) | (F.col("change") <= relative))
    return pairs.select(*owner, F.col("__s.ordinal").alias("source_ordinal"), F.col("__t.ordinal").alias("target_ordinal"), F.col("__s.raw").alias("source_raw"), F.col("__t.raw").alias("target_raw"), "edits", "change")


def match_near(unmatched: DataFrame, owner: list[str], max_edits: int = 2, relative: float = 0.02, keep=None) -> DataFrame:
    """Pairs of missing and added figures of an owner and dimension that differ by a slip (see near_pairs), each figure once: owner, source_ordinal, target_ordinal, source_raw, target_raw, edits.

    The closest first, by edits, relative change and place: a pair is taken if it is the best of both its figures, and figures that are taken leave the others' pairs, in rounds until no pair is left. That is what going
    through all pairs in their order would take, but a round is two windows over single figures, so an owner of any size is spread over tasks. Rounds are written by `keep` (tables of the shared folder).
    """
    keep = keep or writer(unmatched.sparkSession)
    unmatched = unmatched.where("bucket in ('missing', 'added')")
    side = lambda bucket, p: unmatched.where(F.col("bucket") == bucket).select(*owner, "dimension", F.col(f"{p}_ordinal").alias("ordinal"), F.col(f"{p}_raw").alias("raw"), F.col("base_value").alias("value"))
    left = keep(near_pairs(side("missing", "source"), side("added", "target"), owner, max_edits, relative))
    order = ["edits", "change", "source_ordinal", "target_ordinal"]
    taken = []
    while not left.isEmpty():
        best = lambda c: F.row_number().over(Window.partitionBy(*owner, c).orderBy(*order)) == 1
        marked = left.withColumn("__s", best("source_ordinal")).withColumn("__t", best("target_ordinal"))
        chosen = keep(marked.where("__s and __t").drop("__s", "__t"))
        taken.append(chosen)
        rest = left
        for c in ("source_ordinal", "target_ordinal"):
            rest = rest.join(chosen.select(*owner, c), [*owner, c], "left_anti")
        left = keep(rest)
    out = left
    for chosen in taken:
        out = out.unionByName(chosen)
    return out.select(*owner, "source_ordinal", "target_ordinal", "source_raw", "target_raw", "edits")


def drift(counts: DataFrame) -> DataFrame:
    """Adds drift = (missing + mismatched) / source figures, one at most, zero without any."""
    total = F.col("matched") + F.col("missing") + F.col("mismatched")
    return counts.withColumn("drift", F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), (F.col("missing") + F.col("mismatched")) / total)))


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def pair_figures(source: list[dict], target: list[dict], near: float = NEAR) -> list[dict]:
    """Findings of the figures (dimension, base_value, digits) of an owner.

    Equal values meet in order, whatever the dimension if one is unknown; what is left meets what has the same dimension and as many
    digits, the closest first; the rest is missing or added. Targets are looked up by value, and only leftovers are compared with each other.
    """
    waiting: dict[float, list[int]] = defaultdict(list)
    for j in range(len(target) - 1, -1, -1):
        waiting[target[j]["base_value"]].append(j)
    out, left, free = [], [], set(range(len(target)))
    for i, s in enumerate(source):
        same = waiting[s["base_value"]]
        k = next((k for k in range(len(same) - 1, -1, -1) if s["dimension"] == target[same[k]]["dimension"] or UNKNOWN in (s["dimension"], target[same[k]]["dimension"])), None)
        if k is None:
            left.append(i)
        else:
            j = same.pop(k)
            free.discard(j)
            out.append({"kind": "matched", "source_at": i, "target_at": j, "edits": 0, "change": 0.0})
    alike = defaultdict(list)
    for j in sorted(free):
        alike[target[j]["dimension"], len(target[j]["digits"])].append(j)
    close = []
    for i in left:
        s = source[i]
        for j in alike[s["dimension"], len(s["digits"])]:
            a, b = s["base_value"], target[j]["base_value"]
            change = abs(b - a) / abs(a) if a else (float("inf") if b else 0.0)
            edits = _edits(s["digits"], target[j]["digits"])
            if edits <= SLIP or change <= near:
                close.append((edits, change, i, j))
    met = set()
    for edits, change, i, j in sorted(close):
        if i not in met and j in free:
            met.add(i)
            free.discard(j)
            out.append({"kind": "mismatched", "source_at": i, "target_at": j, "edits": edits, "change": change})
    out += [{"kind": "missing", "source_at": i, "target_at": None, "edits": None, "change": None} for i in left if i not in met]
    return out + [{"kind": "added", "source_at": None, "target_at": j, "edits": None, "change": None} for j in sorted(free)]


def pair_of_figures(source: Column, target: Column, near: float = NEAR) -> Column:
    """What pair_figures gives for one figure a side, or none (null), without Python."""
    a, b = source["base_value"], target["base_value"]
    at, no = F.lit(0), F.lit(None).cast("int")
    finding = lambda kind, s, t, edits, change: F.struct(F.lit(kind).alias("kind"), s.alias("source_at"), t.alias("target_at"), edits.alias("edits"), change.cast("double").alias("change"))
    change = F.when(a != 0, F.abs(b - a) / F.abs(a)).when(b != 0, F.lit(float("inf"))).otherwise(0.0)
    edits = F.levenshtein(source["digits"], target["digits"])
    missing, added = finding("missing", at, no, no, no), finding("added", no, at, no, no)
    equal = (a == b) & ((source["dimension"] == target["dimension"]) | source["dimension"].eqNullSafe(F.lit(UNKNOWN)) | target["dimension"].eqNullSafe(F.lit(UNKNOWN)))
    alike = (source["dimension"] == target["dimension"]) & (F.length(source["digits"]) == F.length(target["digits"])) & ((edits <= SLIP) | (change <= near))
    met = F.when(equal, F.array(finding("matched", at, at, F.lit(0), F.lit(0.0)))).when(alike, F.array(finding("mismatched", at, at, edits, change))).otherwise(F.array(missing, added))
    return F.when(source.isNotNull() & target.isNotNull(), met).when(source.isNotNull(), F.array(missing)).when(target.isNotNull(), F.array(added)).cast(FINDING)


def compare(source: DataFrame, target: DataFrame, owner: list[str], near: float = NEAR) -> DataFrame:
    """Findings (owner, kind, source_raw, target_raw, reason) of all figures of two sides, as pair_figures gives them.

    An owner is one text or one slot, so its figures are few; they are gathered by owner (one exchange a side) and paired in Arrow batches of many owners.
    """
    side = lambda df, name: df.groupBy(*owner).agg(F.array_sort(F.collect_list(_facts())).alias(name))
    return _findings(side(source, "s").join(side(target, "t"), owner, "full_outer"), owner, near)


def _facts() -> Column:
    return F.struct("ordinal", "raw", "dimension", "base_value", "digits")


def _findings(both: DataFrame, owner: list[str], near: float) -> DataFrame:
    """Findings of owners with the figures of both sides (s and t, null for none)."""
    kind = "array<struct<ordinal: int, raw: string, dimension: string, base_value: double, digits: string>>"

    @F.pandas_udf(FINDING)
    def paired(source: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([pair_figures(list(s), list(t), near) for s, t in zip(source, target, strict=True)], dtype=object)

    none = F.array().cast(kind)
    both = both.select(*owner, F.coalesce("s", none).cast(kind).alias("s"), F.coalesce("t", none).cast(kind).alias("t")).withColumn("few", (F.size("s") <= 1) & (F.size("t") <= 1))
    several = lambda c: F.when(F.col("few"), none).otherwise(F.col(c))
    both = both.withColumn("paired", paired(several("s"), several("t")))
    found = both.select(*owner, "s", "t", F.explode(F.when(F.col("few"), pair_of_figures(F.get("s", F.lit(0)), F.get("t", F.lit(0)), near)).otherwise(F.col("paired"))).alias("f"))
    slip = F.format_string("digit slip (edit distance %d)", "f.edits")
    reason = F.when(F.col("f.kind") != "mismatched", "").when(F.col("f.edits") <= SLIP, slip).otherwise(F.format_string("value changed by %.3f%%", F.col("f.change") * 100))
    return found.select(*owner, "f.kind", F.get("s", F.col("f.source_at"))["raw"].alias("source_raw"), F.get("t", F.col("f.target_at"))["raw"].alias("target_raw"), reason.alias("reason"))


def structural(df: DataFrame, owner: list[str], reason: Column) -> DataFrame:
    return df.select(*owner, F.lit("structural").alias("kind"), F.lit(None).cast("string").alias("source_raw"), F.lit(None).cast("string").alias("target_raw"), reason.alias("reason"))


def check_texts(pairs: DataFrame, keys: list[str], source: str, target: str, note: str | None = None, near: float = NEAR) -> DataFrame:
    """Findings (keys, kind, source_raw, target_raw, reason) of texts against their counterparts.

    The note of a table about (column `note`) gives both sides' bare figures their unit. A note that the target's first 200 characters
    do not state, and that has no equivalent in the target, is a structural finding: all bare figures may be rescaled.
    """
    rows = pairs.select(*keys, F.coalesce(source, F.lit("")).alias("s"), F.coalesce(target, F.lit("")).alias("t"), (F.coalesce(F.col(note), F.lit("")) if note else F.lit("")).alias("n"))
    hint = unit_from_note(F.col("n"))
    found = compare(figures(rows, "s", keys, hint), figures(rows, "t", keys, hint), keys, near)
    if not note:
        return found
    lost = rows.where((F.trim("n") != "") & hint.isNotNull() & unit_from_note(F.substring("t", 1, 200)).isNull() & ~mentions_note(F.col("t"), F.col("n")))
    return found.union(structural(lost, keys, F.concat(F.lit("unit note not found in the target: "), F.col("n"))))


def check_table_pairs(source: DataFrame, target: DataFrame, source_tables: DataFrame, target_tables: DataFrame, table: str = "table_id", near: float = NEAR, keep=lambda df: df) -> DataFrame:
    """Findings (table, row, col, kind, source_raw, target_raw, reason) of tables against their counterparts, slot by slot.

    cells: (table, row, col, text); tables: (table, n_rows, n_cols, units_note). Structural findings (null row and col for those of a whole table):
    another shape, a slot of one side only, a dropped unit note. Figures are compared in each slot that both have; the target's take its own note, else the source's.
    A slot of equal texts under equal units has equal figures on both sides, each of which pair_figures matches with itself: they are read once and need no pairing.
    `keep` writes what has met, which is read twice, and reads it again; without it both sides meet twice.
    """
    slot = [table, "row", "col"]
    met = outer(source.select(*slot, "text"), target.select(*slot, "text"), slot)
    met = met.select(*slot, F.col("__s.text").alias("s"), F.col("__t.text").alias("t"), F.col("__s").isNotNull().alias("in_s"), F.col("__t").isNotNull().alias("in_t"), F.col("__alone").alias("alone"))
    return _check(met, lambda df: df, source_tables, target_tables, table, near, keep)


def check_row_pairs(source: DataFrame, target: DataFrame, source_tables: DataFrame, target_tables: DataFrame, table: str = "table_id", near: float = NEAR, keep=lambda df: df) -> DataFrame:
    """What check_table_pairs finds, for tables kept by rows: (table, row, texts), the texts being those of the columns from 0 on; no cell stands beyond their end.

    Rows meet whole, so that a sort has one entry for a row and not one for each of its cells; their slots are parted after that.
    """
    row = [table, "row"]
    met = outer(source.select(*row, "texts"), target.select(*row, "texts"), row)
    texts = lambda side: F.coalesce(F.col(side)["texts"], F.array().cast("array<string>"))
    met = met.select(*row, texts("__s").alias("s"), texts("__t").alias("t"), F.col("__alone").alias("alone"))

    def slots(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in ("s", "t")]
        parted = df.select(*rest, F.size("s").alias("__sn"), F.size("t").alias("__tn"), F.posexplode(F.arrays_zip("s", "t")).alias("col", "x"))
        return parted.select(*rest, "col", "x.s", "x.t", (F.col("col") < F.col("__sn")).alias("in_s"), (F.col("col") < F.col("__tn")).alias("in_t"))

    return _check(met, slots, source_tables, target_tables, table, near, keep)


def _check(met: DataFrame, slots, source_tables: DataFrame, target_tables: DataFrame, table: str, near: float, keep) -> DataFrame:
    """Findings of what has met: its rows (table, s, t, alone) become slots (table, row, col, s, t, in_s, in_t) by `slots`.

    Slots that need no pairing are told in one pass, those that do in another, which leaves out equal rows before they are parted.
    """
    slot = [table, "row", "col"]
    shape = lambda df, p: df.select(table, F.col("n_rows").alias(f"{p}r"), F.col("n_cols").alias(f"{p}c"), F.trim(F.coalesce("units_note", F.lit(""))).alias(f"{p}n"))
    shapes = shape(source_tables, "s").join(shape(target_tables, "t"), table)
    # several cells of a side in one slot, or several shapes of a table, are compared all together, as one owner
    notes = shapes.select(table, "sn", "tn", (F.count(F.lit(1)).over(Window.partitionBy(table)) == 1).alias("once"))
    s_note, t_note = F.col("sn"), F.coalesce(F.nullif("tn", F.lit("")), "sn")
    same = F.col("only") & F.col("s").eqNullSafe(F.col("t"))
    met = met.join(notes, table).withColumn("only", F.col("alone") & F.col("once") & (s_note == t_note)).drop("alone", "once")
    met = keep(met.withColumn("equal", same).withColumn("t", F.when(~F.col("equal"), F.col("t")))).withColumn("t", F.when(F.col("equal"), F.col("s")).otherwise(F.col("t")))
    gone = F.when(~F.col("in_t"), "cell exists in the source but not the target").when(~F.col("in_s"), "cell exists in the target but not the source")
    own = slots(met).select(*slot, gone.alias("gone"), F.when(F.col("in_s") & F.col("in_t") & same, raw_figures(F.coalesce("s", F.lit("")))).alias("raws"))
    # outer, or a filter on what is found would find it twice
    own = own.select(*slot, "gone", F.explode_outer("raws").alias("raw")).where("gone is not null or raw is not null")
    kind = F.when(F.col("gone").isNotNull(), "structural").otherwise("matched")
    found = own.select(*slot, kind.alias("kind"), F.col("raw").alias("source_raw"), F.col("raw").alias("target_raw"), F.coalesce("gone", F.lit("")).alias("reason"))
    sides = F.array(F.struct(F.lit(True).alias("first"), F.col("s").alias("text"), s_note.alias("note")), F.struct(F.lit(False).alias("first"), F.col("t").alias("text"), t_note.alias("note")))
    told = slots(met.where("not equal")).where(F.col("in_s") & F.col("in_t") & ~same).select(*slot, F.inline(sides))
    per_side = lambda first: F.array_sort(F.collect_list(F.when(F.col("first") == first, _facts())))
    found = found.union(_findings(figures(told, "text", [*slot, "first"], unit_from_note(F.col("note"))).groupBy(*slot).agg(per_side(True).alias("s"), per_side(False).alias("t")), slot, near))
    whole = shapes.withColumn("row", F.lit(None).cast("int")).withColumn("col", F.lit(None).cast("int"))
    changed = whole.where("sr <> tr or sc <> tc")
    dropped = whole.where("sn <> '' and tn = ''")
    parts = [
        structural(changed, slot, F.format_string("shape changed %dx%d -> %dx%d", "sr", "sc", "tr", "tc")),
        structural(dropped, slot, F.concat(F.lit("table unit note dropped in the target: "), F.col("sn"))),
    ]
    for part in parts:
        found = found.union(part)
    return found


def report(findings: DataFrame, owner: list[str], every: DataFrame | None = None) -> DataFrame:
    """One row for each owner (for each of `every`, too): matched, mismatched, missing, added, structural, source_total, target_total, drift, ok, note.

    Reports of parts add up to the report of the whole, drift being taken of the sums. Added figures alone never fail a report; a note names them.
    """
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    out = findings.groupBy(*owner).agg(*[count(k) for k in (*KINDS, "structural")])
    if every is not None:
        out = every.select(*owner).distinct().join(out, owner, "left").na.fill(0, [*KINDS, "structural"])
    out = drift(out).withColumn("source_total", F.col("matched") + F.col("mismatched") + F.col("missing")).withColumn("target_total", F.col("matched") + F.col("mismatched") + F.col("added"))
    out = out.withColumn("ok", F.expr("missing + mismatched + structural = 0"))
    extra = F.expr("missing + mismatched = 0 and added > 0")
    return out.withColumn("note", F.when(extra, "counts differ only by extra figures in the target; check for duplicated values").otherwise(""))


def merge_reports(reports: DataFrame, owner: list[str]) -> DataFrame:
    """Reports of parts added up by owner."""
    sums = [F.sum(k).alias(k) for k in (*KINDS, "structural", "source_total", "target_total")]
    return drift(reports.groupBy(*owner).agg(*sums)).withColumn("ok", F.expr("missing + mismatched + structural = 0"))


def chart_figures(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points of charts (keys, series, category, value) as figures of unknown unit, so that charts join the same comparison."""
    w = Window.partitionBy(*keys).orderBy("series", "category", "value")
    raw = F.regexp_replace(F.format_string("%.6f", "value"), r"\.?0+$", "")
    return points.select(*keys, (F.row_number().over(w) - 1).alias("ordinal"), raw.alias("raw"), F.lit(UNKNOWN).alias("dimension"), F.col("value").alias("base_value"), F.regexp_replace(raw, "[^0-9]", "").alias("digits"), F.col("category").alias("context"))


def check_tables(source: DataFrame, target: DataFrame, table: str = "table_id") -> DataFrame:
    """Slot by slot: table, row, col, source_text, target_text, finding (same, changed, missing, extra)."""
    slot = [table, "row", "col"]
    joined = outer(source.select(*slot, "text"), target.select(*slot, "text"), slot)
    finding = F.when(F.col("__t").isNull(), "missing").when(F.col("__s").isNull(), "extra").when(F.col("__s.text").eqNullSafe(F.col("__t.text")), "same").otherwise("changed")
    return joined.select(*slot, F.col("__s.text").alias("source_text"), F.col("__t.text").alias("target_text"), finding.alias("finding"))
