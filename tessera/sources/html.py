"""Layout elements from HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "p": "text", "li": "list_item", "td": "cell", "th": "cell", "figcaption": "caption"}
SKIPPED = {"script", "style", "nav", "footer", "noscript"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.kind: str | None = None
        self.text: list[str] = []
        self.skipping = 0

    def close_element(self) -> None:
        text = " ".join("".join(self.text).split())
        if self.kind and text:
            self.out.append((self.kind, text))
        self.kind, self.text = None, []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SKIPPED:
            self.skipping += 1
        elif tag in KINDS:
            self.close_element()
            self.kind = KINDS[tag]

    def handle_endtag(self, tag) -> None:
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag in KINDS:
            self.close_element()

    def handle_data(self, data) -> None:
        if not self.skipping and self.kind:
            self.text.append(data)


def elements_of(html: str | None) -> list[tuple[str, str]]:
    """(type, text) of the elements of a page, in order; menus, scripts and footers are left out."""
    if not html:
        return []
    reader = _Reader()
    reader.feed(html)
    reader.close_element()
    return reader.out


def page_elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per element: key, order_no, type, text.  A null or empty page has none."""
    kind = dict(pages.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, t, x) for k, h in zip(pdf[key], pdf[html]) for n, (t, x) in enumerate(elements_of(h))]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "order_no", "type", "text"])

    return pages.select(key, html).mapInPandas(work, f"{key} {kind}, order_no int, type string, text string")
