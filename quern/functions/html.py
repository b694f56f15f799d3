"""Text and links of HTML pages (Arrow batches; the parser is in the standard library)."""

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Elements whose text is no content, and elements that end a line.
SKIPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside", "head", "template"}
BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "pre", "blockquote"}
PAGE = StructType([StructField("text", StringType()), StructField("links", ArrayType(StringType()))])


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.links = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.depth += 1
        elif tag in BREAKS:
            self.parts.append("\n")
        href = dict(attrs).get("href")
        if tag == "a" and href and not self.depth:
            self.links.append(href)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.depth = max(0, self.depth - 1)
        elif tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def page(html: str | None) -> tuple[str | None, list[str]]:
    if html is None:
        return None, []
    p = _Page()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x), p.links


@pandas_udf(PAGE)
def page_text(values: pd.Series) -> pd.DataFrame:
    """(text, links) of a page: text outside of scripts, styles and navigation, entities decoded, one line a block."""
    return pd.DataFrame([page(v) for v in values], columns=["text", "links"])
