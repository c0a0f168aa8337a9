"""HTML to text, links, tables and sections with the standard library's parser, as Arrow UDFs."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED = frozenset("script style noscript template sly header footer nav".split())
#: Classes of what isn't content.
SKIPPED_CLASSES = frozenset("cmp-breadcrumb cmp-navigation website-survey cmp-cookie".split())
BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 tr table section article br".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE = "array<struct<caption: string, headers: array<string>, rows: array<array<string>>>>"
LINKS = "array<struct<text: string, url: string>>"
SECTIONS = "array<struct<heading: string, level: int, content: string>>"


class _Reader(HTMLParser):
    """Collects a page's lines, links, tables and sections in one pass."""

    def __init__(self, base: str, whole: bool = False):
        super().__init__(convert_charrefs=True)
        self.base, self.whole = base, whole
        self.lines: list[str] = [""]
        self.links: list[tuple[str, str]] = []
        self.tables: list[dict] = []
        self.sections: list[dict] = []
        self.skipping: list[str] = []
        self.anchor: list | None = None
        self.cell: list[str] | None = None
        self.head: list | None = None

    def _skips(self, tag: str, attrs: dict) -> bool:
        if tag in ("script", "style", "template", "noscript", "title"):
            return True
        return not self.whole and (tag in SKIPPED or not SKIPPED_CLASSES.isdisjoint((attrs.get("class") or "").split()))

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if self.skipping or (self._skips(tag, given) and tag not in VOID):
            if tag not in VOID:
                self.skipping.append(tag)
            return
        if tag in BLOCKS:
            self.lines.append("- " if tag == "li" else "")
        if tag == "a" and (given.get("href") or "").strip() and not given["href"].startswith("#"):
            self.anchor = [urljoin(self.base, given["href"].strip()), ""]
        elif tag == "table":
            self.tables.append({"caption": "", "headers": [], "rows": []})
        elif tag == "tr" and self.tables:
            self.tables[-1]["rows"].append([])
        elif tag in ("td", "th", "caption") and self.tables:
            self.cell = [tag, ""]
        elif tag in HEADINGS:
            self.head = [int(tag[1]), ""]

    def handle_endtag(self, tag):
        if self.skipping:
            if tag in self.skipping:
                del self.skipping[len(self.skipping) - 1 - self.skipping[::-1].index(tag) :]
            return
        if tag == "a" and self.anchor:
            url, text = self.anchor
            text = " ".join(text.split())
            self.links.append((text, url))
            if text:
                self.lines[-1] += f"[{text}]({url})"
            self.anchor = None
        elif tag in ("td", "th", "caption") and self.cell and self.tables:
            kind, text = self.cell[0], " ".join(self.cell[1].split())
            table = self.tables[-1]
            if kind == "caption":
                table["caption"] = text
            elif table["rows"]:
                table["rows"][-1].append(text)
                if kind == "th":
                    table["headers"].append(text)
            self.cell = None
        elif tag in HEADINGS and self.head:
            self.sections.append({"heading": " ".join(self.head[1].split()), "level": self.head[0], "at": len(self.lines)})
            self.head = None
        if tag in BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.skipping:
            return
        if self.cell is not None:
            self.cell[1] += data
        if self.head is not None:
            self.head[1] += data
        if self.anchor is not None:
            self.anchor[1] += data
        else:
            self.lines[-1] += data

    def text(self, start: int = 0, end: int | None = None) -> str:
        lines = (" ".join(x.split()) for x in self.lines[start:end])
        return "\n".join(x for x in lines if x and x != "-")


def read(html: str | None, base: str | None = "", whole: bool = False) -> _Reader:
    reader = _Reader(base or "", whole)
    reader.feed(html or "")
    reader.close()
    return reader


def _distinct(pairs: list[tuple[str, str]]) -> list[dict]:
    return [{"text": t, "url": u} for t, u in dict.fromkeys(pairs)]


def closed_text(html: str | None, base: str | None = "") -> str:
    """The text of a page whose character references count with their semicolon only; browsers also take &amp or &copy without it."""
    html = html or ""
    mark = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in html), "\ufdd0")  # noncharacters
    known = lambda m: m.group() if m[1] and (m[1][0] == "#" or f"{m[1]};" in html5) else mark + m.group()[1:]
    return read(re.sub("&(?:(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)?", known, html), base).text().replace(mark, "&")


def page_text(html: Column, base: Column, closed: bool = False) -> Column:
    """Lines of text with links as markdown, without the page's chrome. closed: as closed_text()."""
    of = closed_text if closed else lambda p, b: read(p, b).text()

    @F.pandas_udf("string")
    def text(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([of(p, b) for p, b in zip(pages, bases)])

    return text(html, base)


def page_links(html: Column, base: Column) -> Column:
    """Distinct links (text, url) of the whole page, resolved."""

    @F.pandas_udf(LINKS)
    def links(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([_distinct(read(p, b, whole=True).links) for p, b in zip(pages, bases)])

    return links(html, base)


def page_tables(html: Column) -> Column:
    @F.pandas_udf(TABLE)
    def tables(pages: pd.Series) -> pd.Series:
        return pd.Series([[t | {"rows": [r for r in t["rows"] if r]} for t in read(p).tables] for p in pages])

    return tables(html)


def page_sections(html: Column, base: Column) -> Column:
    """Headings with their level and the text up to the next heading."""

    @F.pandas_udf(SECTIONS)
    def sections(pages: pd.Series, bases: pd.Series) -> pd.Series:
        out = []
        for p, b in zip(pages, bases):
            r = read(p, b)
            ends = [s["at"] for s in r.sections[1:]] + [None]
            out.append([{"heading": s["heading"], "level": s["level"], "content": r.text(s["at"], e if e is None else e - 1)} for s, e in zip(r.sections, ends)])
        return pd.Series(out)

    return sections(html, base)
