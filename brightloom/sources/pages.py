"""Web pages: title, description, visible text and links."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HIDDEN = {"script", "style", "noscript"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.description, self.text, self.links, self.hidden, self.in_title = "", "", [], [], 0, False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.hidden += tag in _HIDDEN
        self.in_title = self.in_title or tag == "title"
        if tag == "a" and attrs.get("href"):
            self.links.append(attrs["href"])
        if tag == "meta" and (attrs.get("name") or "").lower() == "description":
            self.description = attrs.get("content") or ""

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden and data.strip():
            self.text.append(" ".join(data.split()))


_PAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "description", "text")] + [T.StructField("links", T.ArrayType(T.StringType()))])


@F.pandas_udf(_PAGE)
def parse_html(html: pd.Series) -> pd.DataFrame:
    """What a page shows; a parser's state spans the page, so no expression does it exactly."""
    out = []
    for source in html:
        page = _Page()
        page.feed(source or "")
        page.close()
        out.append((page.title.strip(), page.description, " ".join(page.text), page.links))
    return pd.DataFrame(out, columns=["title", "description", "text", "links"])


def page_text_links(pages: DataFrame, max_text: int | None = None, max_links: int | None = None) -> DataFrame:
    """``page_id, url, title, description, text, links`` of ``pages(page_id, url, html)``.

    Everything unless a caller sets how many characters and links it wants.
    """
    found = pages.select("page_id", "url", parse_html("html").alias("p")).select("page_id", "url", "p.*")
    if max_text is not None:
        found = found.withColumn("text", F.left("text", F.lit(max_text)))
    if max_links is not None:
        found = found.withColumn("links", F.slice("links", 1, max_links))
    return found
