"""HTML to text, lists and sections, with the standard library's parser behind Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Fixed values of HTML.
_CHROME = {"script", "style", "nav", "header", "footer", "noscript", "aside", "form", "svg", "iframe", "button", "template"}
_LINES = {"p", "div", "li", "ul", "ol", "table", "tr", "section", "article", "main", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dt", "dd"}
_VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
HEADINGS = ("h1", "h2", "h3", "h4")
#: Pages of an Arrow batch that are Python objects at a time.
STEP = 128


class _Walker(HTMLParser):
    """Lines (tag, depth of list, region, text); region: main, article, body or none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.rows: list[tuple[str, int, frozenset, str]] = []
        self.text: list[str] = []
        self.cells: list[str] | None = None
        self.tag = "body"

    def flush(self) -> None:
        t = " ".join("".join(self.text).split())
        self.text = []
        if not t:
            return
        if self.cells is not None:
            self.cells.append(t)
            return
        self.rows.append((self.tag, sum(x in ("ul", "ol") for x in self.stack), frozenset(self.stack) & {"main", "article", "body"}, t))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _LINES or tag in ("td", "th"):
            self.flush()
            self.tag = tag
        if tag == "tr":
            self.cells = []
        if tag not in _VOID:
            if tag in ("p", "li", "td", "th", "tr") and tag in self.stack and self.stack[-1] == tag:
                self.stack.pop()
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        if tag in _LINES or tag in ("td", "th"):
            self.flush()
        if tag == "tr" and self.cells is not None:
            cells, self.cells = self.cells, None
            if cells:
                self.rows.append(("tr", 0, frozenset(self.stack) & {"main", "article", "body"}, " | ".join(cells)))
        while self.stack and self.stack.pop() != tag:
            pass
        self.tag = next((x for x in reversed(self.stack) if x in _LINES), "body")

    def handle_data(self, data: str) -> None:
        if not _CHROME.intersection(self.stack) and "title" not in self.stack:
            self.text.append(data)


def rows_of(html: str | None) -> list[tuple[str, int, str]]:
    """(tag, list depth, text) of a page's lines: of its main element, else its article, else its body."""
    w = _Walker()
    w.feed(html or "")
    w.close()
    w.flush()
    for region in ("main", "article"):
        if found := [(t, d, x) for t, d, r, x in w.rows if region in r]:
            return found
    return [(t, d, x) for t, d, _, x in w.rows]


def _each(html: pa.Array, one: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """``one`` of each page, a few pages at a time, so that a batch's texts and results aren't Python objects together."""
    out = [pa.array([one(h) for h in html.slice(i, STEP).to_pylist()], kind) for i in range(0, len(html), STEP)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


@arrow_udf(StringType())
def to_text(html: pa.Array) -> pa.Array:
    """Text lines of the page without its surroundings."""
    return _each(html, lambda h: "\n".join(x for _, _, x in rows_of(h)), pa.string())


@arrow_udf(StringType())
def to_text_with_lists(html: pa.Array) -> pa.Array:
    """As T79, list items as ``- item``, indented by depth."""
    return _each(html, lambda h: "\n".join("  " * max(0, d - 1) + "- " + x if t == "li" else x for t, d, x in rows_of(h)), pa.string())


@arrow_udf(ArrayType(StructType([StructField("title", StringType()), StructField("body", StringType())])))
def to_sections(html: pa.Array) -> pa.Array:
    """Heading-delimited sections of 50 signs or more; tables as rows with bars."""

    def one(h: str | None) -> list[dict]:
        out, title, parts = [], "Overview", []
        for t, _, x in [*rows_of(h), ("h1", 0, "")]:
            if t in HEADINGS:
                if len(body := "\n".join(parts)) >= 50:
                    out.append({"title": title, "body": body})
                title, parts = x, []
            elif len(x) > 10:
                parts.append(f"- {x}" if t == "li" else x)
        return out

    return _each(html, one, pa.list_(pa.struct([("title", pa.string()), ("body", pa.string())])))


def json_ld(html: Column) -> Column:
    """The first ``ld+json`` block of a page, or null."""
    found = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    return F.when(found != "", F.trim(found))


def json_ld_text(html: Column) -> Column:
    """Headline and the parts' texts of a page's JSON-LD; null without."""
    part = "struct<headline:string,text:string,description:string>"
    x = F.from_json(json_ld(html), f"headline string, name string, description string, text string, hasPart array<{part}>")
    inner = F.transform(F.coalesce(x["hasPart"], F.array().cast(f"array<{part}>")), lambda p: F.concat_ws("\n", p["headline"], p["text"]))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.concat_ws("\n", F.coalesce(x["headline"], x["name"]), x["description"], x["text"], F.array_join(inner, "\n")), r"<[^>]*>", " "), r"[ \t]+", " "))
    return F.when(json_ld(html).isNotNull() & (clean != ""), clean)


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by name or property."""
    return F.regexp_extract(html, rf"""(?i)<meta[^>]*(?:name|property)=["']{re.escape(name)}["'][^>]*content=["']([^"']*)""", 1)


def links(html: Column, pattern: str = "") -> Column:
    """Distinct link targets in order, filtered by a pattern."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"'#]+)"""), 1))
    return F.filter(found, lambda x: x.rlike(pattern)) if pattern else found
