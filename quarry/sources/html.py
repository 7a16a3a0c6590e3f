"""Links of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def hrefs(html: Column) -> Column:
    """Targets of quoted href attributes of anchors."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            self.found.append([href, ""])
            self.inside = True

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "a"

    def handle_data(self, data):
        if self.inside:
            self.found[-1][1] += data


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page_id, html in zip(batch["page_id"], batch["html"]):
            parser = _Anchors()
            parser.feed(html or "")
            rows += [(page_id, k, href, " ".join(text.split())) for k, (href, text) in enumerate(parser.found)]
        yield pd.DataFrame(rows, columns=["page_id", "position", "href", "text"])


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, text) of every anchor with a target."""
    return pages.select("page_id", "html").mapInPandas(_parsed, "page_id long, position int, href string, text string")


def last_by_target(links: DataFrame) -> DataFrame:
    """One row for each target of a page: the last one wins."""
    w = Window.partitionBy("page_id", "href").orderBy(F.desc("position"))
    return links.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
