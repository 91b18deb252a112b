"""Text, importance spans, links and canonical addresses of web pages (Python standard library, behind Arrow UDFs)."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.config import IMPORTANCE

#: Elements without content, and for some elements those open ones that they end when they start.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "section", "article", "header", "footer", "pre", "form"}
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
INLINE = {"b", "strong", "i", "em", "u", "a", "span", "font", "small"}
SKIPPED = ("#", "javascript:", "mailto:")


class _Page(HTMLParser):
    """String nodes in order with the importance of the nearest element that has one; and the links."""

    def __init__(self, aside: bool):
        super().__init__(convert_charrefs=True)
        self.aside = aside  # also the text of scripts, styles, comments and the document type
        self.open: list[str] = []
        self.parts: list[tuple[str, int]] = []
        self.links: list[str] = []
        self.held: list[str] = []

    def flush(self) -> None:
        text = "".join(self.held).strip()
        self.held = []
        if text and (self.aside or not (self.open and self.open[-1] in ("script", "style"))):
            self.parts.append((text, next((IMPORTANCE[t] for t in reversed(self.open) if t in IMPORTANCE), 0)))

    def handle_starttag(self, tag, attrs):
        self.flush()
        # a block that starts ends an open paragraph (or item, cell) with the inline elements left open in it
        for i in range(len(self.open) - 1, -1, -1):
            if tag in ENDED_BY.get(self.open[i], ()):
                del self.open[i:]
                break
            if self.open[i] not in INLINE:
                break
        if tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                self.links.append(href.strip())
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        self.held.append(data)

    def _aside(self, text):
        self.flush()
        if self.aside and text.strip():
            self.held = [text]
            self.flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = _aside


def parsed(html: str, aside: bool = True) -> _Page:
    page = _Page(aside)
    page.feed(html)
    page.close()
    page.flush()
    return page


def extract_text(html: str | None, aside: bool = True) -> tuple[str, list[tuple[int, int, int]]]:
    """String nodes joined by one space, and (start, end, importance) of each in characters."""
    spans, at = [], 0
    parts = parsed(html, aside).parts if html else []
    for text, importance in parts:
        spans.append((at, at + len(text), importance))
        at += len(text) + 1
    return " ".join(t for t, _ in parts), spans


def normalize_url(url: str | None) -> str:
    if not url:
        return ""
    p = urlparse(url)
    path = p.path.rstrip("/") or "/"
    return f"{p.scheme or 'https'}://{p.netloc.lower()}{path}" + (f"?{p.query}" if p.query else "")


def out_links(html: str | None, base: str | None) -> list[str]:
    """Distinct canonical targets in order; links that cannot be resolved are left out."""
    found: dict[str, None] = {}
    for href in parsed(html).links if html else []:
        if href and not href.startswith(SKIPPED):
            try:
                canon = normalize_url(urljoin(base or "", href).split("#")[0].strip())
            except ValueError:
                continue
            if canon:
                found[canon] = None
    return list(found)


# types as objects: a string would need a session when this module is imported
SPANS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "importance")]))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)]))
def extract_text_udf(html: pd.Series) -> pd.DataFrame:
    rows = [extract_text(h) for h in html]
    return pd.DataFrame({"text": [t for t, _ in rows], "spans": [[{"start": a, "end": b, "importance": c} for a, b, c in s] for _, s in rows]})


@F.pandas_udf(T.StringType())
def normalize_url_udf(url: pd.Series) -> pd.Series:
    def one(u):
        try:
            return normalize_url(u)
        except ValueError:
            return ""

    return url.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def out_links_udf(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([out_links(h, b) for h, b in zip(html, base)])
