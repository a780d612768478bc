"""Text and links of raw web pages, in Arrow batches with the standard parser."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose text is dropped, and elements that never close.
DROPPED = frozenset({"script", "style", "nav", "footer", "header", "form", "aside"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})


class _Reader(HTMLParser):
    """Collects text outside dropped elements, and anchors with their text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.anchor: tuple[str, list[str]] | None = None

    def finish_anchor(self) -> None:
        if self.anchor:
            self.links.append((self.anchor[0], " ".join(" ".join(self.anchor[1]).split())))
            self.anchor = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.finish_anchor()
            href = dict(attrs).get("href")
            self.anchor = None if href is None else (href, [])
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.finish_anchor()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if self.anchor:
            self.anchor[1].append(data)
        if not DROPPED.intersection(self.open):
            self.text.append(data)


def _read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.finish_anchor()
    return reader


def visible_text(html: Column) -> Column:
    """Visible text of an HTML column with single spaces, in Arrow batches; null gives an empty text."""

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda h: " ".join(" ".join(_read(h).text).split()))

    return read(html)


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text): visible text with single spaces."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            text = [" ".join(" ".join(_read(h).text).split()) for h in batch[html]]
            yield batch[[key]].assign(text=text)

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, text string")


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, position, link, title): anchors with text, links made absolute."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [
                (k, i, urljoin(u or "", href), title)
                for k, u, h in zip(batch[key], batch[url], batch[html])
                for i, (href, title) in enumerate(_read(h).links)
                if title
            ]
            yield pd.DataFrame(rows, columns=[key, "position", "link", "title"])

    schema = f"{key} {pages.schema[key].dataType.simpleString()}, position int, link string, title string"
    return pages.select(key, url, html).mapInPandas(run, schema)


def select_links(links: DataFrame, key: str = "page_id", keywords: Sequence[str] = (), suffix: str | None = None) -> DataFrame:
    """Links that fit the suffix and any keyword, each once per index page, first title kept."""
    keep = F.lit(True)
    if suffix:
        keep = keep & F.lower("link").endswith(suffix)
    if keywords:
        both = F.lower(F.concat_ws(" ", "link", "title"))
        hit = F.lit(False)
        for word in keywords:
            hit = hit | F.contains(both, F.lit(word))
        keep = keep & hit
    return links.where(keep).groupBy(key, "link").agg(F.min_by("title", "position").alias("title"), F.min("position").alias("position"))
