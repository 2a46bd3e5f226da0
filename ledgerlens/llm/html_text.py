"""Main text of web pages: a recurrent labeller judges every block in the context of its whole page."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag: quotes count only as the begin of a value; a quote that is not closed is part of the value.
REST = re.compile(r"""((?>[^>=]+|=\s*+(?:"[^"]*"|'[^']*')|=)*+)>""")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements whose content is not text of the page, elements without content, and so on.
SCRIPTS = frozenset(("script", "style"))
ASIDE = frozenset(("noscript", "template", "svg", "iframe", "object", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img map".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PATH_DIMS, WORD_DIMS, EXTRA = 96, 32, 8
HIDDEN = 20


class Dims(dict):
    """Dimension of each word, its lower-cased checksum modulo `dims`; remembered for up to `most` words, and sent to executors without them."""

    def __init__(self, dims: int, most: int = 200_000):
        super().__init__()
        self.dims, self.most = dims, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = crc32(word.lower().encode("utf-8", "surrogatepass")) % self.dims
        return found

    def __reduce__(self):
        return Dims, (self.dims, self.most)


_mark_dim, _word_dim = Dims(PATH_DIMS, 20_000), Dims(WORD_DIMS)


class Block:
    __slots__ = ("path", "leaf", "text", "linked")

    def __init__(self, path: bytes, leaf: str, text: str, linked: int):
        self.path, self.leaf, self.text, self.linked = path, leaf, text, linked


class OpenTags:
    """The elements that are open, and their names and marks hashed: how many different ones each dimension has, two at most.

    Opening and closing change what an element itself brings, so that depth costs nothing.
    """

    def __init__(self):
        self.stack: list[tuple[str, set[str]]] = []
        self.names: dict[str, int] = {}
        self.held: dict[str, int] = {}
        self.counts, self.path = [0] * PATH_DIMS, bytearray(PATH_DIMS)

    @property
    def leaf(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def _hold(self, mark: str, by: int) -> None:
        before = self.held.get(mark, 0)
        self.held[mark] = before + by
        if not before or not before + by:
            d = _mark_dim[mark]
            self.counts[d] += by
            self.path[d] = min(2, self.counts[d])

    def open(self, name: str, marks: set[str]) -> None:
        self.stack.append((name, marks))
        self.names[name] = self.names.get(name, 0) + 1
        for mark in (name, *marks):
            self._hold(mark, 1)

    def close(self) -> str:
        name, marks = self.stack.pop()
        self.names[name] -= 1
        for mark in (name, *marks):
            self._hold(mark, -1)
        return name


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of all that is markup, in order, in time that grows as the page's length; the name is empty for what only is to be passed over.

    That is comments, declarations, and elements whose content is no text of the page: scripts and styles (to the end of the page, if
    not closed) and, if they are closed, ASIDE and head. A `<` that begins no tag is text, and so is a tag that never ends.
    """
    at, ends, quotes, absent = 0, True, True, set()
    while ends and (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        named = NAME.match(page, at)
        if not named and not page.startswith(("<!", "<?"), at):
            at += 1
            continue
        rest = REST.match(page, named.end()) if named and quotes else None
        if rest is None:
            # no end outside quoted values, here or in any later tag: from here on the next > ends a tag
            quotes = quotes and not named
            end = page.find(">", at)
            ends = end >= 0
            if not ends:
                return
            end, attributes = end + 1, page[named.end() : end] if named else ""
        else:
            end, attributes = rest.end(), rest[1]
        name = named[1].lower() if named else ""
        closing = page[at + 1] == "/"
        if not closing and name in SCRIPTS:
            end, name = _after(page, name, end) or len(page), ""
        elif not closing and name in ASIDE and attributes.endswith("/"):
            name = ""  # an empty drawing or frame within the text
        elif not closing and (name in ASIDE or name == "head") and name not in absent:
            if (found := _after(page, name, end)) is None:
                absent.add(name)
            else:
                end, name = found, ""
        yield at, end, name, closing, attributes
        at = end


#: What ends an element whose content is passed over; a head ends where the body begins, too.
CLOSING = {name: re.compile(rf"</{name}\s*>|(?=<body[\s>])" if name == "head" else rf"</{name}(?=[\s/>])[^>]*+>", re.IGNORECASE) for name in (*SCRIPTS, *ASIDE, "head")}


def _after(page: str, name: str, at: int) -> int | None:
    """Where the element that is open at `at` has ended."""
    found = CLOSING[name].search(page, at)
    return found.end() if found else None


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order: references decoded, white space inside turned into one space."""
    out: list[Block] = []
    tags = OpenTags()
    text: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(bytes(tags.path), tags.leaf, whole, linked))
            text.clear()
        linked = 0

    at = 0
    for start, end, name, closing, attributes in tags_of(page):
        if start > at:
            text.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        if not name:
            continue
        if name == "br":
            text.append(" ")
        elif name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
        elif closing:
            flush()
            if tags.names.get(name):
                while tags.close() != name:
                    pass
                in_link = 0
        else:
            flush()
            if name in CLOSES_P and tags.leaf == "p" or name == tags.leaf and name in ("li", "dt", "dd", "td", "th", "option"):
                tags.close()
            if name == "tr" and tags.leaf in ("td", "th"):
                tags.close()
            if name not in VOID:
                tags.open(name, {f".{w}" for _, a, b, c in NAMES.findall(attributes) for w in PART.findall((a or b or c).lower())} if attributes else set())
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block: hashed tag path, all its words hashed (counts, scaled to length one), and its shape (length, links, marks, place)."""
    out = np.zeros((len(blocks), PATH_DIMS + WORD_DIMS + EXTRA), dtype=np.float32)
    if blocks:
        paths = np.frombuffer(b"".join(b.path for b in blocks), dtype=np.uint8).reshape(len(blocks), PATH_DIMS).copy()
        paths[np.arange(len(blocks)), [_mark_dim[f"leaf {b.leaf}"] for b in blocks]] += 1
        out[:, :PATH_DIMS] = np.minimum(paths, 2)
    for i, b in enumerate(blocks):
        row = out[i]
        words = b.text.split(" ")
        counts = np.bincount([_word_dim[w] for w in words], minlength=WORD_DIMS)
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.sqrt((counts**2).sum())
        n = len(b.text)
        row[-EXTRA:] = (np.log1p(n) / 6, min(1.0, b.linked / n), len(words) < 4, b.text[-1] in ".!?", b.text.count(",") / len(words), i / len(blocks), 1 / (1 + i), 1.0)
    return out


class Labeller:
    """Bidirectional LSTM in numpy with one output for each block: the chance that it is main text."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = PATH_DIMS + WORD_DIMS + EXTRA
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for way in "fb":
            self.p |= {f"W{way}": init(d, 4 * HIDDEN), f"U{way}": init(HIDDEN, 4 * HIDDEN), f"b{way}": np.repeat(np.array([0, 1, 0, 0], dtype=np.float32), HIDDEN)}
        self.p |= {"V": init(2 * HIDDEN + d, 1), "c": np.zeros(1, dtype=np.float32)}

    def _run(self, x: np.ndarray, way: str, keep: bool):
        u = self.p[f"U{way}"]
        z_all = x @ self.p[f"W{way}"] + self.p[f"b{way}"]
        h = c = np.zeros((len(x), HIDDEN), dtype=np.float32)
        out, trace = np.empty((*x.shape[:2], HIDDEN), dtype=np.float32), []
        for t in range(x.shape[1]):
            z = z_all[:, t] + h @ u
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            h = o * np.tanh(c)
            out[:, t] = h
            if keep:
                trace.append((before, i, f, o, g, c))
        return out, trace

    @staticmethod
    def _turn(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence backwards within its length."""
        t = np.arange(x.shape[1])[None, :]
        order = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
        return np.take_along_axis(x, order[:, :, None], 1)

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        f, ft = self._run(x, "f", keep)
        b, bt = self._run(self._turn(x, lengths), "b", keep)
        joint = np.concatenate([f, self._turn(b, lengths), x], axis=2)
        logit = (joint @ self.p["V"])[:, :, 0] + self.p["c"]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (joint, ft, bt)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        mask = (np.arange(x.shape[1])[None, :] < lengths[:, None]).astype(np.float32)
        p, (joint, ft, bt) = self.forward(x, lengths, True)
        d_logit = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        grads = {"V": np.einsum("btk,bto->ko", joint, d_logit), "c": d_logit.sum(axis=(0, 1))}
        d_joint = d_logit @ self.p["V"].T
        for way, trace, inputs, d_out in (("f", ft, x, d_joint[:, :, :HIDDEN]), ("b", bt, self._turn(x, lengths), self._turn(d_joint[:, :, HIDDEN : 2 * HIDDEN], lengths))):
            u = self.p[f"U{way}"]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            dh = dc = np.zeros((len(x), HIDDEN), dtype=np.float32)
            du = np.zeros_like(u)
            for t in range(x.shape[1] - 1, -1, -1):
                (h0, c0), i, f, o, g, c = trace[t]
                dh = dh + d_out[:, t]
                tc = np.tanh(c)
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dz_all[:, t] = dz
                du += h0.T @ dz
                dh, dc = dz @ u.T, dc * f
            grads |= {f"W{way}": np.einsum("btd,btk->dk", inputs, dz_all, optimize=True), f"U{way}": du, f"b{way}": dz_all.sum(axis=(0, 1))}
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, batch: int = 25, rate: float = 0.01, seed: int = 6) -> None:
        """Adam on cross-entropy over whole pages."""
        rng, m, v, k = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(pages), batch):
                chosen = [pages[i] for i in order[at : at + batch]]
                x, lengths = pad([c[0] for c in chosen])
                y = np.zeros(x.shape[:2], dtype=np.float32)
                for i, (_, label) in enumerate(chosen):
                    y[i, : len(label)] = label
                words = slice(PATH_DIMS, PATH_DIMS + WORD_DIMS)
                x[:, :, words] *= rng.random((*x.shape[:2], 1)) < 0.5  # words tell less than places do
                k += 1
                for name, g in self.gradients(x, lengths, y).items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                    step = rate * (1 - epoch / epochs) * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)
                    self.p[name] = (self.p[name] * (1 - 1e-4) - step).astype(np.float32)

    def label(self, pages: list[list[Block]], cells: int = 40_000) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * len(pages[order[at + n]]) <= cells:
                n += 1
            part = order[at : at + n]
            x, lengths = pad([vectors(pages[i]) for i in part])
            p, _ = self.forward(x, lengths)
            for row, i in enumerate(part):
                out[i] = p[row, : lengths[row]] > 0.5
            at += n
        return out


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), lengths.max(), rows[0].shape[1]), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x, lengths


#: Names by which made-up training pages mark their regions.
_REGIONS = {
    "nav": (["nav", "ul", "div", "menu"], ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "main-menu", "toc", "pagination", "pager"]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "banner", "top", "logo", "branding", "topbar", "page-header"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "page-footer"]),
    "aside": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "aside", "recommended", "popular", "tags", "share", "social", "author-box", "more", "teaser", "newsletter"]),
    "notice": (["div", "section", "p"], ["notice", "cookie", "cookies", "alert", "banner", "consent", "cookie-banner", "warning", "gdpr", "message", "popup", "modal", "overlay", "subscribe"]),
    "ad": (["div", "section", "p", "aside"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "banner-ad", "adsense", "advertising"]),
    "form": (["form", "div"], ["form", "search", "login", "signup", "contact-form", "newsletter", "search-form"]),
    "comments": (["section", "div", "ol"], ["comments", "comment", "comment-list", "replies", "discussion", "responses", "disqus", "reader-comments", "commentlist"]),
}
_BODIES = [("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article"), ("div", "post"), ("div", "entry-content"), ("div", "story"), ("section", "article-body"), ("div", "main"), ("div", "post-content"), ("section", "content"), ("div", "article-text"), ("div", "body")]
_MENU = "Home About Contact News Archive Login Products Services Blog Sport Help Terms Privacy Next Previous Search Share Subscribe Accept Reply Submit Send Copyright Rights Advertisement Sponsored Menu".split()


#: Stands before each block of main text in made-up pages, until they are labelled.
_KEPT = "\ue000"


def made_page(rng: np.random.Generator) -> str:
    """A made-up page; _KEPT begins each block of its main text."""
    syllables = ["th", "er", "an", "in", "re", "on", "ti", "es", "or", "la", "de", "ch", "ung", "ción", "eau", "ment", "ó", "ü", "st", "ou"]
    vocabulary = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(120)]

    def words(low: int, high: int, menu: float = 0.0) -> str:
        return " ".join(str(rng.choice(_MENU)) if rng.random() < menu else vocabulary[int(len(vocabulary) * rng.random() ** 2)] for _ in range(rng.integers(low, high)))

    def sentence(low: int = 1, high: int = 40) -> str:
        return words(low, high).capitalize() + ("." if rng.random() < 0.85 else "")

    def mark(name: str, label: str) -> str:
        return f"<{name}>" if not label else f'<{name} {"id" if rng.random() < 0.3 else "class"}="{label}{" x" * int(rng.integers(0, 2))}">'

    def region(kind: str) -> str:
        tags, names = _REGIONS[kind]
        tag = str(rng.choice(tags))
        plain = tag in ("nav", "header", "footer", "aside", "form", "menu") and rng.random() < 0.5
        opened = mark(tag, "" if plain else str(rng.choice(names)))
        inner = []
        for _ in range(rng.integers(1, 8)):
            if kind in ("nav", "header", "aside", "footer") and rng.random() < 0.7:
                inner.append(f'<li><a href="/{words(1, 2)}">{words(1, 4, 0.4)}</a></li>')
            elif kind == "form":
                inner.append(f"<label>{words(1, 4, 0.3)}</label><input><button>{words(1, 3, 0.5)}</button>")
            elif kind == "comments":
                inner.append(f'<{"li" if tag == "ol" else "div"} class="comment"><span class="by">{words(1, 3)}</span><p>{sentence()}</p></{"li" if tag == "ol" else "div"}>')
            else:
                inner.append(rng.choice([f"<p>{sentence(1, 25)}</p>", f"<h3>{words(1, 5, 0.2)}</h3>", f"<div>{sentence(1, 15)}</div>", sentence(2, 20)]))
        if kind in ("ad", "notice"):
            inner = [sentence(1, 25)] if tag == "p" else inner[:2]
        return opened + "".join(map(str, inner)) + f"</{tag}>"

    body = []
    for k in range(rng.integers(0, rng.choice([6, 14, 40])) + 1):
        kind = rng.random()
        s = _KEPT + sentence(1, int(rng.choice([3, 12, 60])))
        if k == 0 and rng.random() < 0.7:
            body.append(f"<h1>{s}</h1>")
        elif kind < 0.68:
            body.append(f"<p>{s}</p>" if rng.random() < 0.8 else f"<p><b>{s}<br>")
        elif kind < 0.76:
            body.append(f"<h{rng.integers(2, 4)}>{s}</h2>")
        elif kind < 0.86:
            more = [_KEPT + sentence(1, 12) for _ in range(rng.integers(0, 4))]
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in [*more, s]) + "</ul>")
        elif kind < 0.90:
            body.append(f"<blockquote>{s}</blockquote>")
        elif kind < 0.93:
            body.append(f"<table><tr><td>{s}</td></tr></table>")
        else:
            body.append(f"<div>{s}</div>")
        if rng.random() < 0.05:
            body.append(region(str(rng.choice(["ad", "aside", "notice", "form", "nav"]))))
    tag, label = _BODIES[rng.integers(len(_BODIES))] if rng.random() < 0.7 else _BODIES[0]
    article = mark(tag, label) + "".join(body) + f"</{tag}>"
    before = [region(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.4]
    after = [region(k) for k in ("comments", "aside", "ad", "form", "nav", "notice") if rng.random() < 0.35]
    if rng.random() < 0.8:
        after.append(region("footer"))
    page = "".join(before) + article + "".join(after)
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(["wrapper", "page", "container", "site"])}">{page}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body>{page}</body></html>"


def training_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        blocks = blocks_of(made_page(rng))
        out.append((blocks, np.array([b.text.startswith(_KEPT) for b in blocks], dtype=np.float32)))
        for b in blocks:
            b.text = b.text.replace(_KEPT, "") or "."
    return out


@functools.cache
def trained(pages: int = 1200, seed: int = 11) -> Labeller:
    """The labeller, trained on made-up pages; the same in every run."""
    out = Labeller()
    out.fit([(vectors(b), y) for b, y in training_pages(pages, seed)])
    return out


def extract(pages: list[str], labeller: Labeller) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    return ["\n".join(b.text for b, is_main in zip(bs, keep, strict=True) if is_main) for bs, keep in zip(blocks, labeller.label(blocks), strict=True)]


def main_text(pages: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row: page_id, url, text, n_chars (code points).

    The page is cut into leaf blocks; the labeller reads their tag paths, hashed words and shapes both ways and
    keeps those of the main text, which are joined by a line feed in page order.

    Cases: null html is an empty page, with empty text; a page without markup is one block; broken markup is read as
    far as it goes, without loss of text; a very long page takes time as its length; null identifiers and urls stay null; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
    """
    labeller = labeller or trained()
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t for i in range(0, len(batch), 256) for t in extract(batch["html"].iloc[i : i + 256].tolist(), labeller)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    out = rows.mapInPandas(run, "page_id string, url string, text string").withColumn("page_id", F.col("page_id").cast(kind))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
