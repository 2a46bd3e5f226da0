"""Figures in text: extraction with spans, values and units, without Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import normalize_whitespace, normalize_width
from ledgerlens.functions.units import RATIO, UNIT, UNITS, chinese_numeral, resolve_unit

#: The forms of a figure, the longest first; a Chinese numeral; and what makes one a figure when it follows.
FIGURE = r"\(?[-+−]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+|\.[0-9]+|[0-9]+)(?:\s*\))?"
CN_NUMERAL = "[零一二三四五六七八九十百千万亿两]+"
CN_FOLLOWERS = r"^(?:[千百％]|\s*[元万亿个股人家名倍%])"
#: A numeral that ends in, or whose following characters make it, a unit of the table of units, with a bar between the two.
CN_UNIT = "^(?:" + "|".join(f"{u[:k]}\\|{u[k:]}" for u in UNITS for k in range(1, len(u) + 1) if re.fullmatch(CN_NUMERAL, u[:k])) + ")"
#: What before a figure makes it a scale mark.
SCALE_MARK = "['’′]$"
#: A text that is one figure from end to end, and what a text without any figure has none of.
PLAIN, SIGN = r"^\(?[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?\)?\z", CN_NUMERAL[:-2] + "0-9０-９]"
#: What stands beside a figure of a date.
DATE_AFTER, DATE_BEFORE, MONTH = r"^\s*(?:月|日|号|年|月份)", r"(?:年|月|日|号|第)\s*$", r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)"


def _let(value: Column, use) -> Column:
    """use(value), worked out once: what stands in a lambda by its expression is worked out again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str = FIGURE) -> Column:
    """Array of (raw, start, end): the matches of the pattern in order, offsets from 0."""
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    span = lambda raw, start: F.struct(raw.alias("raw"), start.alias("start"), (start + F.length(raw)).alias("end"))

    def placed(x: Column) -> Column:
        start = lambda i: length(F.slice(x["between"], F.lit(1), i + 1)) + length(F.slice(x["found"], F.lit(1), i))
        return F.transform(x["found"], lambda raw, i: _let(start(i), lambda at: span(raw, at)))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")), placed)


def chinese_spans(text: Column, digits: Column) -> Column:
    """Spans of the Chinese numerals of a text that are figures: with a scale in them or a unit after; not the begin of a unit or a fraction, and not within one of the spans of digits."""
    after = lambda c, n: F.substr(text, c["end"] + 1, F.lit(n))
    unit = lambda c: F.concat(c["raw"], F.lit("|"), after(c, 3)).rlike(CN_UNIT)
    real = lambda c: c["raw"].rlike("[十百千万亿]") | after(c, 6).rlike(CN_FOLLOWERS)
    free = lambda c: ~F.exists(digits, lambda d: (d["start"] <= c["start"]) & (c["start"] < d["end"]))
    found = F.filter(spans(text, CN_NUMERAL), lambda c: real(c) & ~unit(c) & ~after(c, 1).eqNullSafe(F.lit("分")) & free(c) & chinese_numeral(c["raw"]).isNotNull())
    return F.when(text.rlike(CN_NUMERAL), found).otherwise(F.array().cast("array<struct<raw: string, start: int, end: int>>"))


def value_of(raw: Column) -> Column:
    """Signed value: a minus, or brackets on both sides, make it negative."""
    negative = raw.rlike(r"[-−]") | (raw.startswith("(") & raw.endswith(")"))
    return F.when(negative, -1.0).otherwise(1.0) * F.regexp_replace(raw, r"[^0-9.]", "").cast("double")


def figures(df: DataFrame, text_col: str, keys: list[str], hint: Column | None = None) -> DataFrame:
    """One row for each figure: keys, ordinal, raw, start, end, value, unit, dimension, multiplier, base_value, inherited, is_date, digits, context.

    Figures are digits, or Chinese numerals that are no mere list mark. A figure right after an apostrophe is a scale mark ('000) and no figure. `hint` is the unit of the text's table, if any.
    """
    text = normalize_width(F.coalesce(F.col(text_col), F.lit("")))
    hint = F.lit(None).cast(UNIT) if hint is None else hint
    rows = df.select(*keys, text.alias("__text"), hint.alias("__hint")).withColumn("__digits", spans(F.col("__text")))
    both = F.array_sort(F.concat(_tagged(F.col("__digits"), False), _tagged(chinese_spans(F.col("__text"), F.col("__digits")), True)))
    rows = rows.select(*keys, "__text", "__hint", F.posexplode(both).alias("ordinal", "f")).select("*", "f.*").drop("f")
    window = lambda at, n: F.substr("__text", at, n)
    before = window(F.greatest(F.col("start") - 9, F.lit(1)), F.least(F.col("start"), F.lit(10)))
    rows = rows.withColumn("__before", before).withColumn("__after", window(F.col("end") + 1, F.when(F.col("cn"), 6).otherwise(12)))
    rows = rows.where(~F.col("__before").rlike(SCALE_MARK) | F.col("cn"))
    rows = rows.withColumn("__unit", resolve_unit(F.col("raw"), F.when(F.col("cn"), "").otherwise(F.col("__before")), F.col("__after"), F.col("__hint")))
    value = F.when(F.col("cn"), chinese_numeral(F.col("raw")).cast("double")).otherwise(value_of(F.col("raw")))
    round_ = F.when(F.col("cn"), 10).otherwise(14)
    date = F.col("__after").rlike(DATE_AFTER) | F.col("__before").rlike(DATE_BEFORE) | F.ltrim("__after").rlike("^(?:" + MONTH + ")") | F.col("__before").rlike(MONTH)
    return rows.select(
        *keys, "ordinal", F.trim("raw").alias("raw"), "start", "end", value.alias("value"), F.col("__unit.unit").alias("unit"), F.col("__unit.dimension").alias("dimension"), F.col("__unit.multiplier").alias("multiplier"),
        (value * F.col("__unit.multiplier")).alias("base_value"), F.coalesce(F.col("__unit") == F.col("__hint"), F.lit(False)).alias("inherited"), date.alias("is_date"), F.regexp_replace("raw", "[^0-9]", "").alias("digits"),
        normalize_whitespace(window(F.greatest(F.col("start") - round_ + 1, F.lit(1)), F.col("end") - F.greatest(F.col("start") - round_, F.lit(0)) + round_)).alias("context"),
    )


def _tagged(found: Column, cn: bool) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"), F.lit(cn).alias("cn")))


def raw_figures(text: Column) -> Column:
    """Array of the raw figures of a text, just those that figures() has for it. Texts without any, or that are one plain figure, need no search."""

    def found(t: Column) -> Column:
        own = lambda s: s["cn"] | ~F.substr(t, F.greatest(s["start"] - 9, F.lit(1)), F.least(s["start"], F.lit(10))).rlike(SCALE_MARK)
        both = lambda d: F.array_sort(F.concat(_tagged(d, False), _tagged(chinese_spans(t, d), True)))
        return F.transform(F.filter(_let(spans(t), both), own), lambda s: F.trim(s["raw"]))

    none = F.array().cast("array<string>")
    return F.when(text.rlike(PLAIN), F.array(text)).when(text.rlike(SIGN), _let(normalize_width(text), found)).otherwise(none)


def figure_list(text: Column) -> Column:
    """Array of the raw figures of a text, digits and Chinese numerals, as figures() finds them but for scale marks."""
    return _let(text, _figures_of)


def _figures_of(text: Column) -> Column:
    digits = F.filter(spans(text), lambda s: ~((s["start"] > 0) & F.substr(text, s["start"], F.lit(1)).isin("'", "’", "′")))
    both = lambda d: F.sort_array(F.concat(_tagged(d, False), _tagged(chinese_spans(text, d), True)))
    return F.transform(_let(digits, both), lambda s: F.trim(s["raw"]))


def is_numeric_cell(text: Column) -> Column:
    """A cell of figures and little else: at most three characters stay when figures and marks around are taken out; such cells are copied, never sent."""

    def lone(x: Column) -> Column:
        rest = F.aggregate(x["found"], x["text"], lambda s, f: F.replace(s, f, F.lit(" ")))
        rest = F.regexp_replace(normalize_whitespace(rest), r"^[ .,;:()\[\]%+\-–—/\\|'\"]+|[ .,;:()\[\]%+\-–—/\\|'\"]+$", "")
        return (F.size(x["found"]) > 0) & (F.length(rest) <= 3)

    cell = lambda t: F.struct(t.alias("text"), _figures_of(t).alias("found"))
    return _let(normalize_width(F.coalesce(text, F.lit(""))), lambda t: _let(cell(t), lone))


def fingerprint(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, fingerprint): the sorted dimensions and values of all figures of a text; equal for texts with the same figures in any order."""
    found = figures(df, text_col, keys)
    key = F.struct("dimension", F.when(F.col("dimension") == RATIO, F.round("base_value", 6)).otherwise(F.round("base_value", 4)).alias("value"))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(key)).alias("fingerprint"))
