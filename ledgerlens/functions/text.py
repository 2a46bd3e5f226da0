"""Text primitives as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


def normalize_width(text: Column) -> Column:
    """Full-width forms to ASCII, one character for one."""
    return F.translate(text, WIDE, NARROW)


def normalize_whitespace(text: Column, keep_newlines: bool = False) -> Column:
    """Runs of blanks to one space, trimmed; line breaks too unless kept (then each line trimmed and at most one empty line). Null stays null."""
    text = normalize_width(text)
    if not keep_newlines:
        return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t\xa0]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def cjk_ratio(text: Column) -> Column:
    solid = F.regexp_count(text, F.lit(r"(?U)\S"))
    return F.when(solid > 0, F.regexp_count(text, F.lit(CJK)) / solid).otherwise(F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    """CJK characters / 1.5 + others / 4 + figures' characters x 0.35, cut to a whole number, plus one; none for empty text."""
    cjk, digits = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit(r"[0-9,.%]"))
    return F.when(F.length(text) == 0, 0).otherwise((cjk / 1.5 + (F.length(text) - cjk) / 4 + digits * F.lit(0.35)).cast("int") + 1)


def slugify(text: Column, max_len: int = 40) -> Column:
    slug = F.trim(F.regexp_replace(text, r"[^A-Za-z0-9\x{4E00}-\x{9FFF}]+", "-"), F.lit("-"))
    return F.when(slug == "", "unnamed").otherwise(F.lower(F.substring(slug, 1, max_len)))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def numeric_density(text: Column) -> Column:
    """Share of digits among characters."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit("[0-9]")) / F.length(text)).otherwise(F.lit(0.0))


def tokenize(text: Column) -> Column:
    """Lower-cased Latin words of two or more letters, numbers, CJK characters and their bigrams."""
    low = F.lower(normalize_width(text))
    words, runs = F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9'.-]+"), F.lit(0)), F.regexp_extract_all(low, F.lit(CJK + "+"), F.lit(0))
    numbers = F.regexp_extract_all(low, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    grams = lambda n: F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substr(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))
    return F.concat(words, numbers, grams(1), grams(2))


NIL = ("-", "–", "—", "/", "N/A", "n/a", "不适用", "无")


#: Fixed value: what a cell with a figure alone consists of.
NUMERIC_CELL = r"^[\s\-+()]*[0-9,.\u2014\u2013%-]+[\s%()]*$"
FOOTNOTES = ("注：", "注:", "Note:", "Notes:", "(*", "（*")


def looks_numeric(text: Column) -> Column:
    """A lone figure, with sign, brackets or percent, or a mark for none."""
    t = F.trim(normalize_width(F.coalesce(text, F.lit(""))))
    return t.isin(*NIL) | t.rlike(NUMERIC_CELL) & t.rlike("[0-9]")


def is_footnote(text: Column) -> Column:
    t = F.ltrim(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for mark in FOOTNOTES:
        out |= t.startswith(mark)
    return out


def format_number(value: Column) -> Column:
    """Grouped digits: whole numbers without a fraction, others with up to four places, no closing zeros; a dash for null."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    digits = F.when(whole, F.format_number(value, 0)).otherwise(F.regexp_replace(F.format_number(value, 4), r"\.?0+$", ""))
    return F.coalesce(digits, F.lit("-"))


def unescape_html(text: Column) -> Column:
    """All character references of HTML decoded (the table of names is the standard library's)."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return decode(text)


def display_width(text: Column) -> Column:
    """Columns on a terminal: wide characters count two, full-width forms as their ASCII; 0 for null."""

    @F.pandas_udf("int")
    def width(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in t)).astype("int32")

    return width(F.coalesce(normalize_width(text), F.lit("")))
