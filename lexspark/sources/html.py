"""HTML pages: titles, dates, summaries, links. Column expressions only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from lexspark.functions.text import slug, squeeze
from lexspark.operators.rows import explode_rows
from lexspark.session import cut_lineage

_OPEN, _CLOSE = "\x01", "\x02"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def without_code(html: Column) -> Column:
    c = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", ""), r"(?s)<!--.*?-->", "")


def plain(fragment: Column) -> Column:
    """Tags dropped, common entities resolved, whitespace collapsed."""
    c = F.regexp_replace(fragment, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


def paragraph_texts(html: Column) -> Column:
    """Texts of the p elements; one ends at its end tag or at the next p."""
    marked = F.regexp_replace(html, r"(?i)<p(?:\s[^>]*)?>", _OPEN)
    marked = F.regexp_replace(marked, r"(?i)</p>", _CLOSE)
    return F.transform(F.regexp_extract_all(marked, F.lit(f"{_OPEN}([^{_OPEN}{_CLOSE}]*)"), F.lit(1)), plain)


def _div(html: Column, name: str) -> Column:
    found = F.regexp_extract(html, rf'(?is)<div[^>]*class="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</div>', 1)
    return F.nullif(plain(found), F.lit(""))


def extract_page(pages: DataFrame) -> DataFrame:
    """(url, title, date, summary) from (url, html)."""
    rows = pages.select("url", without_code(F.col("html")).alias("h"))
    rows = rows.withColumn("ps", paragraph_texts(F.col("h")))
    first = F.try_element_at("ps", F.lit(1))
    dated = F.when(first.rlike(r"[0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}"), first)
    return rows.select(
        "url", plain(F.regexp_extract("h", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("title"), F.coalesce(_div(F.col("h"), "date"), dated).alias("date"),
        F.coalesce(_div(F.col("h"), "headnote"), F.array_join(F.slice("ps", 1, 2), " ")).alias("summary"))


def absolute_url(base: Column, href: Column) -> Column:
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*)?/)", 1)
    return (
        F.when(href.rlike(r"^https?://"), href)
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), href))
    )


def links(pages: DataFrame) -> DataFrame:
    """Distinct (url, link): absolute targets of the anchors of a page."""
    rows = explode_rows(pages, ["url"], F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1)), "href").where("href <> '' AND href NOT IN ('./', '../') AND NOT startswith(href, '#')")
    return rows.select("url", absolute_url(F.col("url"), F.col("href")).alias("link")).distinct()


def link_path(link: Column) -> Column:
    return F.regexp_extract(link, r"^https?://[^/?#]+([^?#]*)", 1)


def canonical_links(found: DataFrame, path_pattern: str) -> DataFrame:
    """Links whose path fits a pattern and carries no date at its end."""
    path = link_path(F.col("link"))
    return found.where(path.rlike(path_pattern) & ~path.rlike(r"/\d{4}-\d{2}-\d{2}/?$")).select("link").distinct()


def case_links(found: DataFrame) -> DataFrame:
    return found.where(F.contains("link", F.lit("/cases/")) & F.lower("link").endswith(".html")).select("link").distinct()


def pdf_link(pages: DataFrame) -> DataFrame:
    """(url, link): the first anchor of a page that ends in .pdf."""
    hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*\.pdf)"'), F.lit(1))
    first = pages.select("url", F.try_element_at(hrefs, F.lit(1)).alias("href")).where("href IS NOT NULL")
    return first.select("url", absolute_url(F.col("url"), F.col("href")).alias("link"))


def reachable(starts: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """(url, depth) of pages reached from the start urls over at most depth
    links; the links are extracted once, each level is written out and known pages
    are removed from it."""
    found = cut_lineage(found)
    seen = starts.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.select("url").join(found, "url").select(F.col("link").alias("url")).distinct()
        frontier = cut_lineage(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


@F.pandas_udf(StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def title_slug(title: Column) -> Column:
    return slug(nfkd(title))


def download_name(title: Column, url: Column) -> Column:
    """File name of a linked document: from its title, else from its URL."""
    last = F.regexp_extract(url, r"([^/]*)$", 1)
    named = F.when(F.lower(last).endswith(".pdf"), last).otherwise(F.concat(F.when(last == "", "part").otherwise(last), F.lit(".pdf")))
    return F.coalesce(F.concat(F.nullif(title_slug(title), F.lit("")), F.lit(".pdf")), slug(named))
