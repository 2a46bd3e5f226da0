"""Units of figures: fixed values, and their resolution as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import normalize_width

MONEY, COUNT, RATIO, UNKNOWN = "money", "count", "ratio", "unknown"

#: Unit -> (dimension, multiplier to yuan, pieces or fractions).
UNITS: dict[str, tuple[str, float]] = {
    "元": (MONEY, 1.0), "人民币元": (MONEY, 1.0), "千元": (MONEY, 1e3), "万元": (MONEY, 1e4), "百万元": (MONEY, 1e6), "亿元": (MONEY, 1e8), "万": (MONEY, 1e4), "亿": (MONEY, 1e8),
    "thousand": (MONEY, 1e3), "thousands": (MONEY, 1e3), "k": (MONEY, 1e3), "'000": (MONEY, 1e3), "mn": (MONEY, 1e6), "million": (MONEY, 1e6), "millions": (MONEY, 1e6), "bn": (MONEY, 1e9), "billion": (MONEY, 1e9), "trillion": (MONEY, 1e12),
    "%": (RATIO, 0.01), "percent": (RATIO, 0.01), "percentage point": (RATIO, 0.01), "percentage points": (RATIO, 0.01), "个百分点": (RATIO, 0.01), "bp": (RATIO, 1e-4), "bps": (RATIO, 1e-4), "基点": (RATIO, 1e-4),
    "股": (COUNT, 1.0), "shares": (COUNT, 1.0), "share": (COUNT, 1.0), "个": (COUNT, 1.0), "名": (COUNT, 1.0), "人": (COUNT, 1.0), "家": (COUNT, 1.0),
}
#: Marks of a currency.
CURRENCIES = ("人民币", "港元", "美元", "欧元", "rmb", "cny", "hkd", "usd", "hk$", "us$", "eur", "¥", "￥", "$", "€", "£", "元")
#: What a Chinese numeral is made of.
CN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_SMALL = {"十": 10, "百": 100, "千": 1000}
CN_BIG = {"万": 10_000, "亿": 100_000_000}

UNIT = "struct<unit: string, dimension: string, multiplier: double>"


def _entry(unit: str, dimension: str, multiplier: float) -> Column:
    return F.struct(F.lit(unit).alias("unit"), F.lit(dimension).alias("dimension"), F.lit(multiplier).alias("multiplier"))


def _first(chain: list[tuple[Column, Column]]) -> Column:
    out = F.lit(None).cast(UNIT)
    for when, then in reversed(chain):
        out = F.when(when, then).otherwise(out)
    return out


LONGEST = sorted(UNITS, key=lambda u: (-len(u), u))


def _units() -> Column:
    """Map from each unit to its entry, a constant."""
    return F.create_map(*[x for u in UNITS for x in (F.lit(u), _entry(u, *UNITS[u]))])


def parse_unit(text: Column) -> Column:
    """The longest unit that occurs anywhere in the text (one letter only as a word), else a currency mark, else null."""
    low = F.lower(normalize_width(F.coalesce(text, F.lit(""))))
    held = lambda u: F.when(u == "k", low.rlike("(?<![a-z])k(?![a-z])")).otherwise(F.contains(low, u))
    unit = F.get(F.filter(F.array(*[F.lit(u) for u in LONGEST]), held), F.lit(0))
    mark = F.get(F.filter(F.array(*[F.lit(c) for c in CURRENCIES]), lambda c: F.contains(low, c)), F.lit(0))
    money = F.struct(mark.alias("unit"), F.lit(MONEY).alias("dimension"), F.lit(1.0).alias("multiplier"))
    return F.coalesce(F.try_element_at(_units(), unit), F.when(mark.isNotNull(), money))


def unit_from_note(note: Column) -> Column:
    """The unit that a table's note states for its figures; null without one."""
    note = normalize_width(F.coalesce(note, F.lit("")))
    thousand, million = note.rlike(r"'\s*000") | note.rlike(r"\b000\b"), note.rlike(r"(?i)\bmillion\b")
    return F.when(note != "", _first([(thousand, _entry("thousand", MONEY, 1e3)), (million, _entry("million", MONEY, 1e6)), (F.lit(True), parse_unit(note))]))


#: What tells, in the other language, that a note of this multiplier is kept.
EQUIVALENTS = {1e3: ("千元", "千", "thousand", "'000", "000"), 1e4: ("万元", "万"), 1e6: ("百万元", "million", "mn"), 1e8: ("亿元", "亿"), 1.0: ("元", "yuan", "rmb")}


def mentions_note(target: Column, note: Column) -> Column:
    """Whether a text holds a unit note, or an equivalent of its multiplier; a note without a unit counts as held."""
    unit = unit_from_note(note)
    out = F.lit(False)
    for multiplier, marks in EQUIVALENTS.items():
        found = F.lit(False)
        for mark in marks:
            found |= F.contains(target, F.lit(mark))
        out |= (unit["multiplier"] == multiplier) & found
    return unit.isNull() | F.contains(target, F.trim(note)) | out


#: The units as alternatives, the longest first; `k` only before what is no letter or digit.
LEADING = r"^\s*(" + "|".join("k(?![A-Za-z0-9])" if u == "k" else re.escape(u) for u in LONGEST) + ")"


def leading_unit(after: Column) -> Column:
    """The longest unit that the text after a figure begins with; case counts."""
    return F.try_element_at(_units(), F.nullif(F.regexp_extract(after, LEADING, 1), F.lit("")))


def resolve_unit(raw: Column, before: Column, after: Column, hint: Column) -> Column:
    """Unit of a figure: percent, basis points, a unit right after, a currency mark before (with the hint's scale), the hint, a small decimal as a ratio, or unknown."""
    scale = F.when(hint["dimension"] == MONEY, hint["multiplier"]).otherwise(F.lit(1.0))
    small = F.contains(raw, F.lit(".")) & (F.abs(F.try_to_number(F.regexp_replace(raw, r"[^0-9.]", ""), F.lit("999999999999.999999"))) < 1000)
    money = F.struct(F.lit("currency").alias("unit"), F.lit(MONEY).alias("dimension"), scale.alias("multiplier"))
    marks = "(?i)" + "|".join(re.escape(c) for c in CURRENCIES)
    none = F.struct(F.lit("").alias("unit"), F.when(small, RATIO).otherwise(UNKNOWN).alias("dimension"), F.lit(1.0).alias("multiplier"))
    percent = F.when(after.rlike(r"(?i)^\s*(?:%|％|percent|per cent)") | before.rlike(r"百分之\s*$"), _entry("%", RATIO, 0.01))
    points = F.when(after.rlike(r"(?i)^\s*(?:bps?|个?基点)(?![A-Za-z0-9])"), _entry("bp", RATIO, 1e-4))
    bare = (before == "") & (after == "")  # nothing to search
    return F.when(bare, F.coalesce(hint, none)).otherwise(F.coalesce(percent, points, leading_unit(after), F.when(before.rlike(marks), money), hint, none))


def chinese_numeral(text: Column) -> Column:
    """Value of a Chinese numeral as a long; null if it is zero or has another character."""
    digits = F.create_map(*[F.lit(x) for kv in CN_DIGITS.items() for x in kv])
    small, big = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (CN_SMALL, CN_BIG))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("section"), F.lit(0).cast("bigint").alias("digit"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        d, k, b = digits[c], small[c], big[c]
        section = F.when(k.isNotNull(), s["section"] + F.when(s["digit"] == 0, 1).otherwise(s["digit"]) * k).when(b.isNotNull(), 0).otherwise(s["section"])
        whole = s["section"] + s["digit"]
        # a higher scale also multiplies what stands before it (one hundred million after ten thousand)
        total = F.when(b.isNotNull(), F.when((s["total"] > 0) & (s["total"] < b), (s["total"] + whole) * b).otherwise(s["total"] + F.greatest(whole, F.lit(1)) * b)).otherwise(s["total"])
        return F.struct(total.cast("bigint").alias("total"), section.cast("bigint").alias("section"), F.when(d.isNotNull(), d).otherwise(0).cast("bigint").alias("digit"), (s["ok"] & (d.isNotNull() | k.isNotNull() | b.isNotNull())).alias("ok"))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = F.aggregate(chars, start, step, lambda s: F.when(s["ok"], s["total"] + s["section"] + s["digit"]))
    return F.when(value > 0, value)
