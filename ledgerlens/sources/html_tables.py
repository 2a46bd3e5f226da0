"""Tables out of HTML, and JSON out of model replies."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed value: spans beyond it count as this in HTML (colspan to 1,000; rowspan is kept to the same, so that a row of a hostile page takes bounded memory).
MOST = 1000


def _whole(value: str | None) -> int:
    try:
        return max(1, int(value or 1))
    except ValueError:
        return 1


class _FirstTable(HTMLParser):
    """Cells of the first table, by a cursor that skips slots taken by spans; nested tables count as text of their cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[dict] = []
        self.depth, self.row, self.col, self.done = 0, -1, 0, False
        self.taken: set[tuple[int, int]] = set()
        self.open: dict | None = None
        self.caption, self.in_caption = "", False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if self.done or self.depth != 1:
            return
        given = dict(attrs)
        if tag == "tr":
            self._close()
            self.row, self.col = self.row + 1, 0
        elif tag in ("td", "th"):
            self._close()
            self.row = max(self.row, 0)
            while (self.row, self.col) in self.taken:
                self.col += 1
            rows, cols = (min(MOST, _whole(given.get(n))) for n in ("rowspan", "colspan"))
            if rows > 1:  # the cursor itself passes what a cell takes of its own row
                self.taken |= {(self.row + r, self.col + c) for r in range(1, rows) for c in range(cols)}
            row, col = (int(given[n]) if (given.get(n) or "").isdigit() else None for n in ("data-r", "data-c"))
            placed = row is not None and col is not None  # a stated place wins over the cursor
            self.open = {"row": row if placed else self.row, "col": col if placed else self.col, "row_span": rows, "col_span": cols, "is_header": tag == "th", "text": "", "empty": "data-empty" in given}
            self.col += cols
        elif tag == "caption":
            self.in_caption = True
        elif tag == "br" and self.open:
            self.open["text"] += "\n"

    def handle_endtag(self, tag):
        if tag == "caption":
            self.in_caption = False
        if tag in ("td", "th", "tr") and self.depth == 1:
            self._close()
        elif tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self._close()
                self.done = True

    def handle_data(self, data):
        if self.in_caption and not self.done and self.open is None:
            self.caption += data
        if self.open is not None and not self.done:
            self.open["text"] += data

    def _close(self):
        if self.open is not None:
            empty = self.open.pop("empty")
            self.open["text"] = self.open["text"].strip()
            if not empty:  # a hole stays a hole
                self.cells.append(self.open)
        self.open = None


#: A tag of a table in its plainest form, and an attribute; what else a page may hold is the parser's.
TAG = re.compile(r'<(/?)(table|caption|thead|tbody|tr|td|th|br)((?: [a-z-]+="[^"<>]*")*)(/?)>')
ATTRIBUTE = re.compile(r' ([a-z-]+)="([^"]*)"')


def _plain(page: str, parser: _FirstTable) -> bool:
    """Whether the page is but texts and plain tags; if so, the parser has been told of them as its own reading would have, without its slower search."""
    found, at = [], 0
    for m in TAG.finditer(page):
        found.append((page[at : m.start()], m))
        at = m.end()
    if any("<" in text for text, _ in found) or "<" in page[at:]:
        return False
    for text, m in found:
        if text:
            parser.handle_data(html.unescape(text) if "&" in text else text)
        end, tag, given, empty = m.groups()
        if end:
            if given or empty:
                return False
            parser.handle_endtag(tag)
        else:
            parser.handle_starttag(tag, [(n, html.unescape(v)) for n, v in ATTRIBUTE.findall(given)] if given else [])
            if empty:
                parser.handle_endtag(tag)
    if page[at:]:
        parser.handle_data(html.unescape(page[at:]))
    return True


def parse_table(page: str) -> list[dict]:
    parser = _FirstTable()
    if not _plain(page, parser):
        parser = _FirstTable()
        parser.feed(page)
        parser.close()
    parser._close()
    return parser.cells


def html_captions(df: DataFrame, key: str, html_col: str) -> DataFrame:
    """(key, caption) of the first table of each row's HTML; empty without one."""

    @F.pandas_udf("string")
    def caption(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            parser = _FirstTable()
            parser.feed(page)
            out.append(" ".join(parser.caption.split()))
        return pd.Series(out, dtype=object)

    return df.select(key, caption(F.coalesce(F.col(html_col), F.lit(""))).alias("caption"))


def html_cells(df: DataFrame, key: str, html_col: str) -> DataFrame:
    """Cells of the first table of each row's HTML: key, row, col, row_span, col_span, is_header, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse_table(h) for h in batch["html"]]
            keys = batch[key].repeat([len(cells) for cells in found]).reset_index(drop=True)
            facts = {n: [c[n] for cells in found for c in cells] for n in ("row", "col", "row_span", "col_span", "is_header", "text")}
            yield pd.DataFrame({key: keys, **facts})

    kind = dict(df.dtypes)[key]
    return df.select(key, F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInPandas(run, f"{key} {kind}, row int, col int, row_span int, col_span int, is_header boolean, text string")


#: A string of JSON, or outside of strings a comma before a closing bracket, or a brace; and how an object begins.
STRAY = re.compile(r'"(?:[^"\\]|\\.)*+"|,(?=\s*[}\]])', re.DOTALL)
OBJECT = re.compile(r'\{\s*(?:\}|"(?:[^"\\]|\\.)*+"\s*:)', re.DOTALL)
BRACE = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}]', re.DOTALL)


def reply_json(text: str | None) -> str | None:
    """The first JSON object of a model's reply, without code fences and without commas before a closing bracket (outside of strings); null if there is none.

    Commas and matching braces are found in one pass each from the first brace on, and only a brace that is matched is tried; if none of these begins an object (a quote in the prose may turn strings inside out), every
    brace is tried as it stands. A trial ends at the first fault, so time grows as the reply's length times the depth of what is broken; an object too deep for the parser counts as none.
    """
    text = re.sub(r"```[a-z]*", "", text or "")
    clean = STRAY.sub(lambda m: "" if m[0] == "," else m[0], text[text.find("{") :]) if "{" in text else ""
    waiting, matched = [], []
    for m in BRACE.finditer(clean):
        if m[0] == "{":
            waiting.append(m.start())
        elif m[0] == "}" and waiting:
            matched.append(waiting.pop())
    decoder = json.JSONDecoder()
    for given, places in ((clean, sorted(matched)), (text, (m.start() for m in re.finditer(r"\{", text)))):
        for at in places:
            if not OBJECT.match(given, at):
                continue
            try:
                found, _ = decoder.raw_decode(given, at)
            except ValueError:
                continue
            except RecursionError:
                return None
            return json.dumps(found, ensure_ascii=False)
    return None


def parse_replies(df: DataFrame, reply_col: str, schema: str) -> DataFrame:
    """Adds `parsed` (from_json of the reply's object; null where there is none)."""

    @F.pandas_udf("string")
    def extract(replies: pd.Series) -> pd.Series:
        return replies.map(reply_json)

    return df.withColumn("parsed", F.from_json(extract(F.col(reply_col)), schema))
