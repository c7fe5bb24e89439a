"""Pages of HTML to text: long paragraphs outside navigation, parsed by the standard library's parser in an Arrow UDF."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.columns import replace, strip

# Elements whose text is left out.
LEFT_OUT = frozenset("script style nav footer header aside form".split())
# Elements that end an open paragraph.
BLOCKS = frozenset("p div ul ol li table h1 h2 h3 h4 h5 h6 section article blockquote pre main".split())


class Paragraphs(HTMLParser):
    """Collects the texts of p elements; an unclosed p ends at the next block or at the end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped, self.open, self.done = 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag in LEFT_OUT:
            self.skipped += 1
        elif tag in BLOCKS:
            self.finish()
            if tag == "p" and not self.skipped:
                self.open = []

    def handle_endtag(self, tag):
        if tag in LEFT_OUT:
            self.skipped = max(0, self.skipped - 1)
        elif tag in BLOCKS:
            self.finish()

    def handle_data(self, data):
        if self.open is not None and not self.skipped:
            self.open.append(data)

    def finish(self) -> None:
        if self.open is not None:
            self.done.append(self.open)
            self.open = None


def paragraphs_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Paragraphs()
    parser.feed(html)
    parser.close()
    parser.finish()
    long = (p for p in parser.done if len("".join(p)) > 60)
    return " ".join(" ".join(s for s in map(str.strip, p) if s) for p in long)


@F.pandas_udf(T.StringType())
def _text(html: pd.Series) -> pd.Series:
    return html.map(paragraphs_text)


def domain(url: Column) -> Column:
    """The third piece between slashes; empty without a double slash."""
    return F.when(F.contains(url, F.lit("//")), F.coalesce(F.get(F.split(url, "/"), F.lit(2)), F.lit(""))).otherwise("")


def is_skipped(url: Column) -> Column:
    """Whether a listed site is part of the domain, as a substring."""
    out = F.lit(False)
    for site in L.SKIPPED_SITES:
        out = out | F.contains(domain(url), F.lit(site))
    return out


def page_text(pages: DataFrame, max_chars: int = 3000) -> DataFrame:
    """(page_id, url, text): skipped sites give ''; the text is cut before its white space is collapsed."""
    html = F.when(~is_skipped(F.col("url")), F.col("html"))
    return pages.select("page_id", "url", strip(replace(F.substring(_text(html), 1, max_chars), r"(?U)\s+", " ")).alias("text"))
