"""Extraction from raw captures: pages, captions, plain text; dispatch by type."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import paragraphs, without_controls
from ..operators.vectors import optional

# Tags whose text is left out, and tags that begin and end a paragraph.
SKIPPED = ("script", "style", "noscript", "svg")
BLOCKS = (
    "article", "blockquote", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
)


class Page(HTMLParser):
    """Paragraphs of a page, its title apart, links in order and the published date."""

    def __init__(self, base: str = ""):
        super().__init__(convert_charrefs=True)
        self.base, self.paragraphs, self.links, self.title, self.published = base, [], [], "", None
        self._skip, self._in_title, self._parts = 0, False, []

    def flush(self) -> None:
        if text := " ".join(" ".join(self._parts).split()):
            self.paragraphs.append(text)
        self._parts = []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        self._skip += tag in SKIPPED
        self._in_title |= tag == "title"
        if tag in BLOCKS or tag == "br":
            self.flush()
        if tag == "a" and own.get("href"):
            self.links.append(urljoin(self.base, own["href"]))
        if tag == "meta" and "published_time" in (own.get("property") or own.get("name") or ""):
            self.published = own.get("content")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self._skip = max(0, self._skip - 1)
        if tag == "title":
            self._in_title = False
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._skip and data.strip():
            self._parts.append(data)


def parse_page(html: str, base: str = "") -> Page:
    page = Page(base)
    page.feed(html or "")
    page.close()
    page.flush()
    page.title = " ".join(page.title.split())
    return page


def parse_pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, title, text (paragraphs between blank lines), n_links, published."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, url, html in zip(batch[id_col], batch[url_col], batch[html_col]):
                page = parse_page(html, url or "")
                rows.append((i, page.title, "\n\n".join(page.paragraphs), len(page.links), page.published))
            yield pd.DataFrame(rows, columns=[id_col, "title", "text", "n_links", "published"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, url_col, html_col).mapInPandas(run, f"{id_col} {kind}, title string, text string, n_links long, published string")


def srt_captions(text: Column) -> Column:
    """array<struct<place, locator, text>> of caption blocks; the place counts blocks that give nothing too."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    block = F.transform(
        F.split(unix, r"\n\s*\n+"),
        lambda b, i: F.struct(
            (i + 1).alias("place"),
            F.regexp_extract(b, r"(?m)^\s*([0-9:,.]+)\s*-->\s*([0-9:,.]+)", 1).alias("lo"),
            F.regexp_extract(b, r"(?m)^\s*([0-9:,.]+)\s*-->\s*([0-9:,.]+)", 2).alias("hi"),
            F.trim(F.regexp_replace(F.regexp_extract(b, r"-->[^\n]*\n([\s\S]*)$", 1), r"\s+", " ")).alias("text"),
        ),
    )
    return F.transform(F.filter(block, lambda b: (b.lo != "") & (b.text != "")), lambda b: F.struct(b.place.alias("place"), F.concat(F.lit("time "), b.lo, F.lit("-"), b.hi).alias("locator"), b.text.alias("text")))


def milliseconds(time: Column) -> Column:
    """hh:mm:ss,mmm as a number."""
    parts = F.split(F.regexp_replace(time, ",", "."), ":")
    return ((parts[0].cast("long") * 60 + parts[1].cast("long")) * 60000 + F.round(parts[2].cast("double") * 1000)).cast("long")


def kind_of(content_type: Column, url: Column) -> Column:
    """Which extractor takes a capture: media before pdf, srt, html and text."""
    mime, path = F.lower(F.coalesce(F.substring_index(content_type, ";", 1), F.lit(""))), F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""))
    return (
        F.when(mime.rlike("^(audio|video)/") | path.rlike(r"\.(mp3|mp4|m4a|wav|mov|webm)$"), "media")
        .when((mime == "application/pdf") | path.endswith(".pdf"), "pdf")
        .when(mime.isin("application/x-subrip", "text/srt") | path.endswith(".srt"), "srt")
        .when(mime.isin("text/html", "application/xhtml+xml") | path.rlike(r"\.html?$"), "html")
        .otherwise("text")
    )


def pdf_text(content: bytes) -> str:
    reader = optional("pypdf", "PDF text needs pypdf")
    import io

    pages = [" ".join((p.extract_text() or "").split()) for p in reader.PdfReader(io.BytesIO(content)).pages]
    return "\n\n".join(f"[PDF page {k}] {p}" for k, p in enumerate(pages, 1) if p)


def pdf_texts(captures: DataFrame, id_col: str, content: str) -> DataFrame:
    """id and text of each PDF, or what went wrong with it. Needs pypdf."""
    optional("pypdf", "PDF text needs pypdf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, raw in zip(batch[id_col], batch[content]):
                try:
                    rows.append((i, pdf_text(bytes(raw)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[id_col, "text", "error"])

    kind = captures.schema[id_col].dataType.simpleString()
    return captures.select(id_col, content).mapInPandas(run, f"{id_col} {kind}, text string, error string")


def transcript(text: Column, title: Column) -> Column:
    """A given transcript as paragraphs, its title first; NULL without words."""
    body = F.array_join(paragraphs(without_controls(text)), "\n\n")
    name = F.trim(F.coalesce(title, F.lit("")))
    return F.when(body != "", F.when(name != "", F.concat(name, F.lit("\n\n"), body)).otherwise(body))


def locator(start: Column, end: Column) -> Column:
    """Where a segment is: one place, or the first and the last."""
    return F.when((end == "") | (start == end), start).otherwise(F.concat(start, F.lit(" -> "), end))


def sentence_place(where: Column) -> Column:
    """paragraph and sentence of such a locator, 0 where it is none."""
    form = r"^paragraph (\d+) sentence (\d+)$"
    number = lambda k: F.coalesce(F.regexp_extract(where, form, k).try_cast("int"), F.lit(0))
    return F.struct(number(1).alias("paragraph"), number(2).alias("sentence"))


def search_links(body: Column) -> Column:
    """Addresses in a site search's JSON answer, a list of objects with url or link; what isn't one has none."""
    rows = F.from_json(body, "array<struct<url: string, link: string>>")
    return F.array_distinct(F.array_compact(F.coalesce(F.transform(rows, lambda r: F.coalesce(r.url, r.link)), F.array().cast("array<string>"))))


def shared_views(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """id and cells map<string, string> of each row of each shared table view."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, list(r.items())) for i, raw in zip(batch[id_col], batch[payload]) for r in shared_view_rows(raw)]
            yield pd.DataFrame(rows, columns=[id_col, "cells"])

    kind = df.schema[id_col].dataType.simpleString()
    made = df.select(id_col, payload).mapInPandas(run, f"{id_col} {kind}, cells array<struct<key: string, value: string>>")
    return made.withColumn("cells", F.map_from_entries("cells"))


def sitemap_locations(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def feed_links(xml: Column) -> Column:
    """Links of feed items: <item><link>…</link> and <entry><link href="…">."""
    rss = F.regexp_extract_all(xml, F.lit(r"(?is)<item\b.*?<link>\s*(.*?)\s*</link>"), F.lit(1))
    atom = F.regexp_extract_all(xml, F.lit(r'(?is)<entry\b.*?<link[^>]*href="([^"]*)"'), F.lit(1))
    return F.concat(rss, atom)


def cdx_rows(body: Column) -> Column:
    """Rows of a capture index's JSON answer, whose first row is the header."""
    rows = F.from_json(body, "array<array<string>>")
    return F.when(F.size(rows) > 1, F.slice(rows, F.lit(2), F.size(rows) - 1)).otherwise(F.array().cast("array<array<string>>"))


def shared_view_rows(payload: str) -> list[dict[str, str]]:
    """A shared table view's rows: column ids to names, select ids to labels, lists joined by ' | '."""
    import json

    table = json.loads(payload)["data"]["table"]
    columns = {c["id"]: c for c in table["columns"]}

    def plain(column: dict, value) -> str:
        choices = (column.get("typeOptions") or {}).get("choices", {})
        if isinstance(value, list):
            return " | ".join(plain(column, v) for v in value)
        if isinstance(value, dict):
            return str(value.get("foreignRowDisplayName", ""))
        return str(choices[value]["name"]) if value in choices else "" if value is None else str(value)

    return [{c["name"]: plain(c, row.get("cellValuesByColumnId", {}).get(i)) for i, c in columns.items()} for row in table["rows"]]


def sections(text: Column, marker: str) -> Column:
    """A page cut before each marker; what stands before the first goes."""
    parts = F.split(text, f"(?={re.escape(marker)})")
    return F.filter(parts, lambda p: p.startswith(marker))
