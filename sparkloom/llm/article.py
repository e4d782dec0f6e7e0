"""Main text of web pages from flat text blocks.

A page is cut into text blocks at its block-level tags.  A block is described by its own and its neighbours' word counts and
link densities and by where it stands (inside an article; inside something that a page names as menu, advert, form, reader
comments and so on).  A decision tree, grown on a small labelled table of blocks, tells content from the rest.

Defined results: a null or empty html, and a page without content, give an empty text; null urls and page_ids stay; pages
may be cut off anywhere; repeated rows give equal rows; other columns pass through ``extract`` unchanged; no rows give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features of a block, in the order of the labelled table's columns.
FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "inside", "named")

#: The labelled table: features, then 1 for content.  ``words`` count up to 100; ``links`` is the share of link text.
LABELLED = (
    # menus, link lists and breadcrumbs, named or not
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0), (6, 0.9, 5, 1.0, 7, 1.0, 0, 0, 0), (12, 1.0, 9, 1.0, 40, 0.0, 0, 0, 0), (20, 0.8, 30, 0.7, 25, 0.9, 0, 0, 0),
    (8, 1.0, 70, 0.0, 9, 1.0, 1, 0, 0), (10, 1.0, 8, 1.0, 0, 0.0, 1, 0, 0), (4, 0.9, 50, 0.0, 60, 0.0, 1, 0, 0), (15, 0.9, 12, 0.9, 14, 1.0, 1, 0, 0),
    # headers, footers, adverts, notices, sidebars and forms that the page names
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0), (30, 0.0, 2, 1.0, 60, 0.0, 0, 1, 0), (100, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0), (12, 0.1, 80, 0.0, 0, 0.0, 0, 1, 0),
    (45, 0.0, 40, 0.0, 45, 0.0, 1, 1, 0), (5, 0.0, 90, 0.0, 60, 0.0, 1, 1, 0), (70, 0.0, 70, 0.0, 70, 0.0, 1, 1, 0), (100, 0.0, 100, 0.0, 30, 0.0, 1, 1, 0),
    (3, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0), (2, 0.0, 20, 0.0, 2, 0.0, 1, 1, 0), (9, 0.5, 40, 0.0, 9, 0.5, 1, 1, 0), (25, 0.2, 25, 0.2, 25, 0.2, 0, 1, 0),
    # short unnamed pieces that stand apart from running text
    (6, 0.0, 1, 1.0, 5, 0.0, 0, 0, 0), (4, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0), (5, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0), (9, 0.2, 3, 1.0, 4, 1.0, 0, 0, 0),
    (7, 0.0, 6, 0.0, 2, 0.0, 0, 0, 0), (8, 0.0, 2, 1.0, 6, 0.0, 0, 0, 0), (3, 0.0, 9, 0.0, 0, 0.0, 0, 0, 0), (10, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0),
    # the text of articles: headings, long, short and linked paragraphs
    (6, 0.0, 8, 0.0, 60, 0.0, 1, 0, 1), (9, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1), (1, 0.0, 40, 0.0, 30, 0.0, 1, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1),
    (3, 0.0, 90, 0.0, 12, 0.0, 1, 0, 1), (60, 0.0, 9, 0.0, 40, 0.0, 1, 0, 1), (100, 0.0, 100, 0.0, 100, 0.0, 1, 0, 1), (35, 0.1, 70, 0.0, 20, 0.1, 1, 0, 1),
    (25, 0.3, 40, 0.0, 60, 0.2, 1, 0, 1), (12, 0.4, 30, 0.0, 50, 0.0, 1, 0, 1), (5, 0.0, 6, 0.0, 8, 0.0, 1, 0, 1), (80, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    (2, 0.0, 100, 0.0, 11, 0.0, 1, 0, 1), (100, 0.0, 5, 0.0, 14, 0.1, 1, 0, 1), (40, 0.5, 60, 0.0, 60, 0.0, 1, 0, 1), (7, 0.0, 5, 1.0, 5, 1.0, 1, 0, 1),
    # running text on pages that mark no article
    (40, 0.0, 1, 1.0, 50, 0.0, 0, 0, 1), (100, 0.0, 80, 0.0, 90, 0.0, 0, 0, 1), (25, 0.1, 60, 0.0, 40, 0.0, 0, 0, 1), (60, 0.1, 5, 0.0, 0, 0.0, 0, 0, 1),
    (30, 0.0, 30, 0.0, 6, 0.0, 0, 0, 1), (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1), (5, 0.0, 70, 0.0, 50, 0.0, 0, 0, 1), (9, 0.0, 40, 0.0, 80, 0.0, 0, 0, 1),
    (3, 0.0, 60, 0.0, 45, 0.0, 0, 0, 1), (20, 0.2, 25, 0.0, 30, 0.0, 0, 0, 1), (80, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1), (45, 0.0, 50, 0.0, 8, 1.0, 0, 0, 1),
)

#: Rows of a user's labelled table that are fetched, and how deep a tree may grow.
MAX_LABELLED = 10_000
MAX_DEPTH = 8
_MOST_WORDS = 100

_HIDDEN = {"script", "style", "template", "noscript", "head", "title", "svg", "math", "iframe", "object", "canvas", "select", "button", "textarea", "option", "datalist", "audio", "video", "map"}
_BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NAMED = set("nav footer aside form dialog menu fieldset".split())
_ARTICLE = {"article", "main"}
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words in class and id that name what is not the article (fixed list of common names).
_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager toolbar sidebar side widget widgets related recommended recommendations footer foot colophon masthead topbar cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing social comment comments commentlist "
    "respond reply replies disqus discussion form search skip copyright legal disclaimer".split()
)
#: Of these, the ones that say so only as the last part of a name ("login-form", not "form-factor"), and those of reader comments.
_LAST = {"form"}
_COMMENTS = set("comment comments commentlist respond reply replies disqus discussion".split())
_PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
#: What a head may hold; any other tag ends it.  Tags that end an open one of the second set, up to the third.
_IN_HEAD = set("base link meta title script style noscript template head html".split())
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tr", "tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tr", "tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, hidden, inside, named
        self.here = (False, False, False)
        self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, float, bool, bool]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            size = len(re.sub(r"\s", "", text))
            self.blocks.append((text, min(1.0, self.linked / size), self.here[1], self.here[2]))
        self.text, self.linked = [], 0

    def _marks(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
        hidden, inside, named = self.here
        given = {k: v or "" for k, v in attrs}
        if tag in _HIDDEN or "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
            hidden = True
        if tag in _ARTICLE or given.get("role") in ("main", "article") or given.get("itemprop") == "articleBody":
            inside = True
        if tag in _NAMED or given.get("role") in _ROLES or tag == "header" and not inside:
            named = True
        elif tag not in ("html", "body"):
            words = set()
            for name in (given.get("class", "") + " " + given.get("id", "")).split():
                parts = [w.lower() for w in _PARTS.findall(name)]
                words |= {w for w in parts[:-1] if w not in _LAST} | set(parts[-1:])
            names = _COMMENTS if tag in _ARTICLE else _NAMES
            named = named or bool(words & names) or "header" in words and not inside and tag not in _ARTICLE
        return hidden, inside, named

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _IN_HEAD:
            self._end({"head"}, {"body"})
        if tag in _BLOCKS:
            self.flush()
            self._end({"p"}, _BLOCKS - {"p"})
        if tag in _IMPLIED:
            self._end(*_IMPLIED[tag])
        if tag in ("br", "td", "th"):
            self.text.append(" ")
        if tag == "a":
            self.links += 1
        if tag not in _VOID:
            marks = self._marks(tag, attrs)
            self.stack.append((tag, *self.here))
            self.here = marks

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _end(self, tags: set[str], up_to: set[str]) -> None:
        """Close the outermost open element of ``tags`` above the innermost one of ``up_to``."""
        at = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                at = i
            elif self.stack[i][0] in up_to:
                break
        if at is not None:
            self._pop(at)

    def _pop(self, to: int) -> None:
        for tag, *_ in self.stack[to:]:
            if tag == "a":
                self.links -= 1
        self.here = tuple(self.stack[to][1:])
        del self.stack[to:]

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                break
            if tag not in _BLOCKS and self.stack[i][0] in _BLOCKS:
                break  # an inline tag does not close blocks

    def handle_data(self, data: str) -> None:
        if not self.here[0]:
            self.text.append(data)
            if self.links:
                self.linked += len(re.sub(r"\s", "", data))


def blocks(html: str | None) -> list[tuple[str, float, bool, bool]]:
    """Text, link density, inside and named of every block of a page, in order."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def features(found: list[tuple[str, float, bool, bool]]) -> np.ndarray:
    own = np.array([(min(_MOST_WORDS, len(t.split())), l) for t, l, _, _ in found], dtype=float).reshape(-1, 2)
    zero = np.zeros((1, 2))
    where = np.array([(i, n) for _, _, i, n in found], dtype=float).reshape(-1, 2)
    return np.hstack([own, np.vstack([zero, own[:-1]])[: len(own)], np.vstack([own[1:], zero])[: len(own)], where])


class Tree:
    """A binary decision tree: the split of least Gini impurity at each node, until a node is pure or as deep as allowed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH) -> None:
        self.value = float(y.mean()) if len(y) else 0.0
        self.left = self.right = None
        if depth == 0 or self.value in (0.0, 1.0):
            return
        best = (np.inf, 0, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            for i in np.flatnonzero(v[1:] > v[:-1]):
                n, k = i + 1, ones[i]
                m, r = len(y) - n, ones[-1] - k
                impurity = k * (n - k) / n + r * (m - r) / m
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, (v[i] + v[i + 1]) / 2)
        if best[0] == np.inf:
            return
        _, self.feature, self.cut = best
        low = x[:, self.feature] <= self.cut
        self.left, self.right = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        out = np.empty(len(x))
        low = x[:, self.feature] <= self.cut
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def trained(labelled: DataFrame | None = None) -> Tree:
    """A tree of a labelled table (the features' columns and ``label``; at most ``MAX_LABELLED`` rows), by default the one above."""
    if labelled is None:
        table = np.array(LABELLED, dtype=float)
    else:
        rows = labelled.select(*FEATURES, "label").dropna().limit(MAX_LABELLED).collect()
        table = np.array(rows, dtype=float).reshape(-1, len(FEATURES) + 1)
    return Tree(table[:, :-1], table[:, -1])


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Replaces ``html`` by ``text``: the content blocks, joined by two line feeds.  One scan, no shuffle."""
    tree = tree or trained()
    fields = [f for f in pages.schema.names if f not in ("html", "text")]
    schema = pages.select(*fields, F.lit("").alias("text")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("html"))
            keep = [batch.column(batch.schema.get_field_index(f)) for f in fields]
            for a in range(0, batch.num_rows, 200):
                found = [blocks(x) for x in column[a : a + 200].to_pylist()]
                sizes = [len(x) for x in found]
                content = tree.predict(np.vstack([features(x) for x in found])) > 0.5
                texts, at = [], 0
                for x, n in zip(found, sizes):
                    texts.append("\n\n".join(b[0] for b, c in zip(x, content[at : at + n]) if c))
                    at += n
                yield pa.RecordBatch.from_arrays([*(k[a : a + 200] for k in keep), pa.array(texts, pa.string())], [*fields, "text"])

    return pages.mapInArrow(read, schema)


def op7(pages: DataFrame) -> DataFrame:
    """The contract's columns, a row per page."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
