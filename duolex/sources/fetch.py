"""Fetching with an injected function: provenance rows, live-then-archive fallback, bounded crawls. Failures are rows, not exceptions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import parse_page

#: Takes an address, returns (final address, content type, content).
Fetcher = Callable[[str], tuple[str, str, bytes]]
CAPTURE = "key string, url string, final_url string, content_type string, content binary, byte_count long, sha256 string, retrieved_at string, error string"
# Marks of pages that only ask for a proof, and the bytes at a page's beginning that are looked at.
CHALLENGES = ("/.well-known/sgcaptcha/", "cf-chl-", "cloudflare ray id", "<title>just a moment")
CHALLENGE_BYTES = 16_384


def challenged(html: Column) -> Column:
    """Whether a page's beginning has one of CHALLENGES."""
    start = F.lower(F.substring(html, 1, CHALLENGE_BYTES))
    return reduce(or_, (F.contains(start, F.lit(c)) for c in CHALLENGES))


def http_fetcher(agent: str, timeout: float) -> Fetcher:
    def get(url: str) -> tuple[str, str, bytes]:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            return r.geturl(), r.headers.get_content_type(), r.read()

    return get


def capture(key: str, urls: list[str], fetcher: Fetcher) -> tuple:
    """The first address that gives a page and no challenge; else the last error."""
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    error = "no address"
    for url in urls:
        if not url:
            continue
        try:
            final, kind, content = fetcher(url)
            if kind in ("text/html", "application/xhtml+xml") and any(c.encode() in content[:CHALLENGE_BYTES].lower() for c in CHALLENGES):
                raise ValueError("access challenge")
            return key, url, final, kind, content, len(content), hashlib.sha256(content).hexdigest(), now, None
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
    return key, urls[0] if urls else None, None, None, None, None, None, now, error


def fetch(queue: DataFrame, key: str, urls: list[str], fetcher: Fetcher, tasks: int = 8) -> DataFrame:
    """A capture row for each queue row; urls are columns in order of preference (live, then archive)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([capture(str(r[0]), list(r[1:]), fetcher) for r in batch.itertuples(index=False)], columns=[c.split()[0] for c in CAPTURE.split(", ")])

    return queue.select(key, *urls).repartition(tasks).mapInPandas(run, CAPTURE)


def crawl(sites: DataFrame, key: str, home: str, fetcher: Fetcher, wanted: Callable[[str], bool], pages: int, tasks: int = 8) -> DataFrame:
    """Each site's home page and then up to pages wanted pages of the same host, breadth first; the last capture of an address counts."""
    from urllib.parse import urlsplit

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for site, start in batch.itertuples(index=False):
                seen, queue = {start}, [start]
                host = urlsplit(start).netloc.removeprefix("www.")
                while queue and len(seen) - len(queue) <= pages:
                    url = queue.pop(0)
                    got = capture(str(site), [url], fetcher)
                    rows.append(got)
                    if got[4] is not None and "html" in (got[3] or ""):
                        for link in parse_page(got[4].decode("utf-8", "replace"), url).links:
                            if link not in seen and urlsplit(link).netloc.removeprefix("www.") == host and wanted(link):
                                seen.add(link)
                                queue.append(link)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE.split(", ")])

    found = sites.select(key, home).repartition(tasks).mapInPandas(run, CAPTURE)
    return found.groupBy("key", "url").agg(F.max_by(F.struct(*found.columns), "retrieved_at").alias("r")).select("r.*")


_LOCATION = re.compile(r"(?is)<loc>\s*(.*?)\s*</loc>")
_FEED = re.compile(r"""(?is)<item\b.*?<link>\s*(.*?)\s*</link>|<entry\b.*?<link[^>]*href="([^"]*)\"""")
#: Where a site's own lists of pages are.
LISTS = ("sitemap.xml", "sitemap_index.xml", "feed", "rss.xml")


def discover(sites: DataFrame, key: str, domain: str, fetcher: Fetcher, wanted: Callable[[str], bool], pages: int, urls: int, archive: Callable[[str], list[str]] | None = None, tasks: int = 8) -> DataFrame:
    """key, url, found_by: addresses of each domain that are wanted, at most urls a stage: from its home page, sitemaps (one level of nesting), feeds and up to pages of those found, then from an archive's index.

    archive gives a domain's archived addresses within the window that counts.
    A domain is one task's; a failure gives nothing and ends no other stage.
    """
    from urllib.parse import urlsplit

    def read(url: str) -> str:
        got = capture("", [url], fetcher)
        return got[4].decode("utf-8", "replace") if got[4] is not None else ""

    def stages(host: str) -> Iterator[tuple[str, str]]:
        own = lambda u: urlsplit(u).netloc.lower().removeprefix("www.") == host.removeprefix("www.")
        home = f"https://{host}/"
        links = [u for u in parse_page(read(home), home).links if own(u)]
        yield from ((u, "home") for u in links)
        for name in LISTS:
            body = read(home + name)
            listed = _LOCATION.findall(body)
            for nested in [u for u in listed if u.endswith(".xml")][:urls]:
                listed += _LOCATION.findall(read(nested))
            yield from ((u.replace("&amp;", "&"), "sitemap") for u in listed if own(u) and not u.endswith(".xml"))
            yield from ((a or b, "feed") for a, b in _FEED.findall(body) if own(a or b))
        for page in [u for u in dict.fromkeys(links) if wanted(u)][:pages]:
            yield from ((u, "page") for u in parse_page(read(page), page).links if own(u))
        if archive is not None:
            try:
                yield from ((u, "archive") for u in archive(host))
            except Exception:  # noqa: BLE001
                return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: dict[tuple[str, str], tuple[str, str, str]] = {}
            for site, host in batch.itertuples(index=False):
                count: dict[str, int] = {}
                for url, stage in stages(host.lower()):
                    if wanted(url) and (site, url) not in rows and count.get(stage, 0) < urls:
                        rows[site, url] = (str(site), url, stage)
                        count[stage] = count.get(stage, 0) + 1
            yield pd.DataFrame([*rows.values()], columns=["key", "url", "found_by"])

    return sites.select(key, domain).repartition(tasks).mapInPandas(run, "key string, url string, found_by string")
