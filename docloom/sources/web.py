"""Web pages as sources: text, links, crawl."""

from __future__ import annotations

from fnmatch import translate
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions.text import collapse
from ..operators.cut import cut


def stripped(html: Column) -> Column:
    """The text of a page by patterns alone: no scripts and styles, tags as blanks, white space collapsed."""
    html = F.regexp_replace(html, r"(?is)<script.*?>.*?</script>", " ")
    html = F.regexp_replace(html, r"(?is)<style.*?>.*?</style>", " ")
    return collapse(F.regexp_replace(html, r"(?s)<[^>]+>", " "))


class _Reader(HTMLParser):
    """Text or markdown of a page, its title and link targets."""

    SKIP = ("script", "style", "noscript")
    BREAKS = ("p", "div", "br", "li", "tr", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table")

    def __init__(self, markdown: bool = False):
        super().__init__(convert_charrefs=True)
        self.markdown, self.skipping, self.in_title = markdown, 0, False
        self.out, self.links, self.title = [], [], ""

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipping += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]
        if tag in self.BREAKS:
            self.out.append("\n")
            if self.markdown and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                self.out.append("#" * int(tag[1]) + " ")
            elif self.markdown and tag == "li":
                self.out.append("- ")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipping = max(0, self.skipping - 1)
        elif tag == "title":
            self.in_title = False
        if tag in self.BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skipping:
            self.out.append(" ".join(data.split()) if data.strip() else " ")


def _read(html: str | None, markdown: bool = False) -> _Reader:
    reader = _Reader(markdown)
    reader.feed(html or "")
    reader.close()
    return reader


def _lines(reader: _Reader) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(reader.out).split("\n")) if x)


def plain(html: str | None) -> str:
    """The text of one page or part of one, a line for each block."""
    return _lines(_read(html))


@F.pandas_udf(StringType())
def markdown(html: pd.Series) -> pd.Series:
    """The page as markdown: headers and list items marked, other blocks as lines."""
    return html.map(lambda x: _lines(_read(x, True)))


@F.pandas_udf(StringType())
def dom_text(html: pd.Series) -> pd.Series:
    """The page's text by its elements, a line for each block."""
    return html.map(lambda x: _lines(_read(x)))


@F.pandas_udf(StringType())
def page_title(html: pd.Series) -> pd.Series:
    return html.map(lambda x: " ".join(_read(x).title.split()) or None)


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def page_parts(html: pd.Series) -> pd.DataFrame:
    """page_title and dom_text of a page that is read once."""
    pages = [_read(x) for x in html]
    return pd.DataFrame({"title": [" ".join(r.title.split()) or None for r in pages], "text": [_lines(r) for r in pages]})


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def resolve(base: str, link: str) -> str | None:
    """``link`` on page ``base`` without its fragment; null unless it is http or https."""
    try:
        url = urldefrag(urljoin(base, link.strip())).url
        return url if urlparse(url).scheme in ("http", "https") else None
    except ValueError:
        return None


@F.pandas_udf(ArrayType(StringType()))
def links(urls: pd.Series, html: pd.Series) -> pd.Series:
    """The distinct pages that a page links to, in order."""
    return pd.Series([list(dict.fromkeys(u for u in (resolve(b, x) for x in _read(h).links) if u)) for b, h in zip(urls, html, strict=True)])


@F.pandas_udf(BooleanType())
def allowed(rules: pd.Series, urls: pd.Series, agents: pd.Series) -> pd.Series:
    """Whether robots rules (null: none) let an agent read a page; each text of rules is read once a batch."""
    known: dict[str, RobotFileParser] = {}

    def one(text: str | None, url: str, agent: str) -> bool:
        if not text:
            return True
        if text not in known:
            known[text] = RobotFileParser()
            known[text].parse(text.splitlines())
        return known[text].can_fetch(agent, url)

    return pd.Series([one(t, u, a) for t, u, a in zip(rules, urls, agents, strict=True)])


def crawl(pages: DataFrame, start: DataFrame, depth: int = 1, same_domain: bool = True, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_pages: int | None = None, robots: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """(url, depth) of the pages that are reached from ``start`` (url) by links, breadth first, each once at its least depth.

    ``pages`` (url, html) stands for the network. Each depth is one join of the frontier with the pages and
    an anti join with what is known, and is written to the checkpoint folder, so that no page is read for more
    than one depth. ``max_pages`` keeps the first by depth and address. ``robots`` (host, text) are the rules of hosts: pages that they
    close to ``agent`` are not entered; a host without rules, or with broken ones, is open.
    """
    known = start.select("url").distinct().join(pages.select("url"), "url", "left_semi").withColumn("depth", F.lit(0))
    known = frontier = cut(known)
    for k in range(1, depth + 1):
        out = frontier.select("url").join(pages, "url").select(F.col("url").alias("base"), F.explode(links(F.col("url"), F.col("html"))).alias("url"))
        if same_domain:
            out = out.where(F.parse_url("base", F.lit("HOST")) == F.parse_url("url", F.lit("HOST")))
        for patterns, keep in ((include, True), (exclude, False)):
            if patterns:
                hit = F.col("url").rlike("|".join(translate(p).replace("\\Z", "$").replace("\\z", "$") for p in patterns))
                out = out.where(hit if keep else ~hit)
        if robots is not None:
            host = F.lower(F.parse_url("url", F.lit("HOST")))
            rules = robots.select(F.lower("host").alias("__host"), F.col("text").alias("__rules"))
            out = out.join(rules, host == F.col("__host"), "left").where(allowed(F.col("__rules"), F.col("url"), F.lit(agent))).drop("__host", "__rules")
        frontier = out.select("url").distinct().join(pages.select("url"), "url", "left_semi").join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(k))
        frontier = cut(frontier)
        known = known.unionByName(frontier)
        if not frontier.head(1) or max_pages and known.count() >= max_pages:
            break
    return known.orderBy("depth", "url").limit(max_pages) if max_pages else known
