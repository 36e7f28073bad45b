"""Structure of a page as a token text, and the distance of two of them."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HEAD_ONLY = frozenset("base link meta script style title".split())
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul".split()
)
CLOSED_BY = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
}


class _Outline(HTMLParser):
    """Collects one token per element, with brackets around its children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = None
        self.open = []

    def _append(self, tag, stays_open):
        node = (tag, [])
        if self.open:
            self.open[-1][1].append(node)
        else:
            self.root = node
        if stays_open:
            self.open.append(node)

    def _place(self, tag):
        """Open the html, head and body wrappers a tag implies."""
        if self.root is None and tag != "html":
            self._append("html", True)
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self.open.pop()
        if not self.open:
            self.open.append(self.root)
        if len(self.open) == 1 and tag not in ("html", "head", "body", "frameset"):
            has_body = any(child[0] == "body" for child in self.root[1])
            if has_body:
                self.open.append(self.root[1][-1])
            else:
                self._append("head" if tag in HEAD_ONLY else "body", True)
        elif self.open[-1][0] == "head" and tag not in HEAD_ONLY:
            self.open.pop()
            if tag != "body":
                self._append("body", True)

    def _start(self, tag, stays_open):
        if tag == "html" and self.root is None:
            self._append("html", True)
            return
        if tag in ("html", "body", "head") and any(n[0] == tag for n in self.open):
            return
        self._place(tag)
        self._append(tag, stays_open)

    def handle_starttag(self, tag, attrs):
        self._start(tag, tag not in VOID)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, False)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return


def page_outline(html: str | None) -> str | None:
    """Space-separated tokens such as ``html ( head body ( p ) )``.

    Text and attributes play no part. NULL when the page has no element. Broken
    markup is repaired by a few fixed rules, not by a browser's.
    """
    if not html:
        return None
    parser = _Outline()
    parser.feed(html)
    parser.close()
    if parser.root is None:
        return None
    tokens, todo = [], [parser.root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            tokens.append(node)
            continue
        tokens.append(node[0])
        if node[1]:
            tokens.append("(")
            todo.append(")")
            todo.extend(reversed(node[1]))
    return " ".join(tokens)


def _common_length(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence, one big-integer row per token. Common ends belong to
    it and are cut off first."""
    head, least = 0, min(len(left), len(right))
    while head < least and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < least - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    ends = head + tail
    left, right = left[head : len(left) - tail], right[head : len(right) - tail]
    full = (1 << len(left)) - 1
    where: dict[str, int] = {}
    for i, token in enumerate(left):
        where[token] = where.get(token, 0) | (1 << i)
    row = full
    for token in right:
        hits = row & where.get(token, 0)
        row = ((row + hits) | (row - hits)) & full
    return ends + len(left) - row.bit_count()


def outline_distance(left: str | None, right: str | None) -> float | None:
    """One minus twice the common subsequence over both lengths."""
    if not isinstance(left, str) or not isinstance(right, str):
        return None
    a, b = left.split(" "), right.split(" ")
    return 1.0 - 2.0 * _common_length(a, b) / (len(a) + len(b))


@F.pandas_udf(T.StringType())
def outline_udf(html: pd.Series) -> pd.Series:
    return html.map(page_outline, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def outline_distance_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    pairs = zip(left, right)
    return pd.Series([outline_distance(a, b) for a, b in pairs], dtype="float64")
