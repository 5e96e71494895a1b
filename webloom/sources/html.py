"""HTML pages to columns: title, links, headings, images, dates, directives and visible text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds on what one page may contribute.
ANCHORS, ANCHOR_TEXT, IMAGES, IMAGE_TEXT = 1024, 256, 32, 160
_HIDDEN = {"script", "style", "noscript", "template"}
_BLOCKS = {"p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "ul", "ol", "table"}
SCHEMA = (
    "url string, title string, text string, headings array<string>, links array<string>, local_links int, anchors array<struct<url:string,text:string,nofollow:boolean>>, "
    "images array<struct<url:string,alt:string>>, canonical string, language string, description string, author string, robots string, published string, date_confidence double"
)


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.title: list[str] = []
        self.text: list[str] = []
        self.headings: list[str] = []
        self.anchors: list[dict] = []
        self.images: list[dict] = []
        self.meta: dict[str, str] = {}
        self.dates: list[tuple[float, str]] = []
        self.canonical = self.language = None
        self._hidden: list[str] = []
        self._in: list[str] = []
        self._link: dict | None = None
        self._json: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _HIDDEN:
            self._hidden.append(tag)
            if tag == "script" and "ld+json" in a.get("type", ""):
                self._json = []
        if tag in _BLOCKS:
            self.text.append("\n")
        if tag == "html" and a.get("lang"):
            self.language = a["lang"].lower()
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or a.get("itemprop") or "").lower()
            if name and name not in self.meta:
                self.meta[name] = a.get("content", "")
            if a.get("itemprop", "").lower() in ("datepublished", "datemodified"):
                self.dates.append((0.9, a.get("content", "")))
        elif tag == "link" and "canonical" in a.get("rel", "").lower():
            self.canonical = urljoin(self.url, a.get("href", ""))
        elif tag == "img" and a.get("src") and len(self.images) < IMAGES:
            self.images.append({"url": urljoin(self.url, a["src"]), "alt": a.get("alt", "")[:IMAGE_TEXT]})
        elif tag == "a" and a.get("href") and len(self.anchors) < ANCHORS:
            target = urljoin(self.url, a["href"])
            if urlsplit(target).scheme in ("http", "https"):
                self._link = {"url": target.split("#")[0], "text": "", "nofollow": bool(re.search(r"nofollow|ugc|sponsored", a.get("rel", "").lower()))}
                self.anchors.append(self._link)
        self._in.append(tag)
        if re.fullmatch("h[1-6]", tag):
            self.headings.append("")

    def handle_endtag(self, tag):
        if tag in _HIDDEN and self._hidden:
            self._hidden.pop()
            if self._json is not None:
                self._linked_data("".join(self._json))
                self._json = None
        if tag == "a":
            self._link = None
        if tag in _BLOCKS:
            self.text.append("\n")
        if tag in self._in:
            while self._in.pop() != tag:
                pass

    def handle_data(self, data):
        if self._json is not None:
            self._json.append(data)
            return
        if self._hidden:
            return
        if "title" in self._in and "body" not in self._in:
            self.title.append(data)
            return
        if "head" in self._in:
            return
        self.text.append(data)
        if self._link is not None:
            self._link["text"] = (self._link["text"] + data)[:ANCHOR_TEXT]
        if self.headings and any(re.fullmatch("h[1-6]", t) for t in self._in):
            self.headings[-1] += data

    def _linked_data(self, raw: str) -> None:
        try:
            stack = [json.loads(raw)]
        except ValueError:
            return
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += node
            elif isinstance(node, dict):
                for key, value in node.items():
                    if key in ("datePublished", "dateModified") and isinstance(value, str):
                        self.dates.append((1.0, value))
                    elif isinstance(value, (dict, list)):
                        stack.append(value)


def parse_page(url: str, body: str) -> dict:
    page = _Page(url or "")
    page.feed(body or "")
    page.close()
    host = urlsplit(url or "").hostname
    links = list(dict.fromkeys(a["url"] for a in page.anchors))
    for name in ("article:published_time", "date", "dc.date"):
        if page.meta.get(name):
            page.dates.append((0.8, page.meta[name]))
    best = max(page.dates, key=lambda d: d[0], default=(0.0, None))
    lines = [" ".join(line.split()) for line in "".join(page.text).split("\n")]
    return {
        "url": url,
        "title": " ".join("".join(page.title).split()) or None,
        "text": "\n".join(line for line in lines if line),
        "headings": [" ".join(h.split()) for h in page.headings],
        "links": links,
        "local_links": sum(urlsplit(x).hostname == host for x in links),
        "anchors": page.anchors,
        "images": page.images,
        "canonical": page.canonical,
        "language": page.language,
        "description": page.meta.get("description"),
        "author": page.meta.get("author"),
        "robots": page.meta.get("robots"),
        "published": best[1],
        "date_confidence": best[0],
    }


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([parse_page(u, b) for u, b in zip(batch["url"], batch["html"])], columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])


def read_pages(pages: DataFrame) -> DataFrame:
    """url and html to SCHEMA, in Arrow batches."""
    return pages.select("url", "html").mapInPandas(_rows, SCHEMA)


def main_content(text: Column, least: int = 80) -> Column:
    """Lines that are long or end a sentence; the whole text where none is."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.length(x) >= least) | F.trim(x).rlike("[.!?]$"))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(text)


def robots_directives(value: Column) -> Column:
    """noindex and nofollow of a header or meta value; none means both."""
    low = F.lower(F.coalesce(value, F.lit("")))
    nothing = F.contains(low, F.lit("none"))
    return F.struct((F.contains(low, F.lit("noindex")) | nothing).alias("noindex"), (F.contains(low, F.lit("nofollow")) | nothing).alias("nofollow"))
