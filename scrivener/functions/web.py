"""Links, urls, boards and payloads of crawled pages as Columns."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Keywords that mark committee and speaker pages
COMMITTEE = "organi[a-z]+|committee[a-z]*|prog[a-z]*|chair|about|people"
SPEAKERS = "author[s]*|speaker[a-z]*|tutorial|workshop"
#: an element with a link: its name, the link, and its first own text
LINK = (
    r"(?is)<([a-z][a-z0-9]*)\s(?:[^>]*?\s)?href\s*=\s*[\"']?([^\"'\s>]*)[\"']?[^>]*>"
    r"\s*(?:<(?:img|br|hr|wbr|input)\b[^>]*>\s*|<(?:b|i|u|em|strong|span|font|small)\b[^>]*>[^<]*</[^>]*>\s*)*([^<]*)"
)
NO_TEXT = ("link", "base", "area")
#: separators of board pages by publisher
BOARD_SPLIT = {"springer": "<br>|</p><p>|<p></p>|<p>|</p>", "acm": "div", "ieee": "</?div[^>]*>|<br */?>|</?p[^>]*>"}


def classify_link(text: Column, url: Column) -> Column:
    """'org', 'speakers' or 'unk' by url and link text; null counts as empty."""
    t, u = (F.lower(F.coalesce(c, F.lit(""))) for c in (text, url))
    hit = lambda p: F.rlike(u, F.lit(p)) | F.rlike(t, F.lit(p))
    return F.when(hit(COMMITTEE), "org").when(hit(SPEAKERS), "speakers").otherwise("unk")


def authority(url: Column) -> Column:
    """Host and port; empty for relative and mail links."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def same_domain(home: Column, link: Column) -> Column:
    a = authority(link)
    return (a == "") | (a == authority(home))


@F.pandas_udf(StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """Link resolved against its page; null where either is."""

    def join(b, x):
        try:
            return None if b is None or x is None else urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([join(b, x) for b, x in zip(base, link)])


def links_of(html: Column) -> Column:
    """array<struct<url, text>> of all elements of a page that have a link.

    ``text`` is the element's first own text: behind images and whole inline
    elements, empty where there is none and for elements that cannot hold text.
    """
    parts = [F.regexp_extract_all(html, F.lit(LINK), F.lit(k)) for k in (1, 2, 3)]
    own = lambda z: F.when(F.lower(z["0"]).isin(*NO_TEXT), "").otherwise(z["2"])
    return F.transform(F.arrays_zip(*(p.alias(str(k)) for k, p in enumerate(parts))), lambda z: F.struct(z["1"].alias("url"), F.trim(own(z)).alias("text")))


def access_url(accessible: Column, url: Column, wayback: Column) -> Column:
    """The url to crawl, null to drop: the page itself if reachable and dated, else its archive."""
    own = (accessible == "Accessible URL") & F.rlike(url, F.lit(r"\d{2}"))
    return F.when(own, url).when(wayback != "Not Available", wayback)


def is_accessible(c: Column) -> Column:
    return F.contains(F.coalesce(c, F.lit("")), F.lit("Accessible"))


def content_type(header: Column) -> Column:
    return F.when(F.contains(F.coalesce(header, F.lit("")), F.lit("application/pdf")), "pdf").otherwise("html")


def wayback_url(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.archived_snapshots.closest.url"), F.lit("Not Available"))


def board_lines(html: Column, publisher: str) -> Column:
    """Pieces of a board page; all but Springer's need a letter."""
    from scrivener.functions.text import has_letter, space_markup

    pieces = F.transform(F.split(html, BOARD_SPLIT[publisher], -1), space_markup)
    return pieces if publisher == "springer" else F.filter(pieces, has_letter)


def ieee_journal_numbers(html: Column) -> Column:
    """Distinct publication numbers in page order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('punumber=([0-9][^"]*)'), F.lit(1)))


def springer_journals(html: Column) -> Column:
    """array<struct<code, title>> from a product list."""
    pieces = F.split(html, "product-information", -1)
    blocks = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(b: Column) -> Column:
        code = F.element_at(F.split(F.element_at(F.split(b, "com/", -1), 2), '"', -1), 1)
        title = F.element_at(F.split(F.element_at(F.split(b, "</a></h3>", -1), 1), ">", -1), -1)
        return F.struct(code.alias("code"), F.replace(title, F.lit("amp;"), F.lit("")).alias("title"))

    return F.transform(F.filter(blocks, lambda b: F.contains(b, F.lit("com/")) & F.contains(b, F.lit("</a></h3>"))), one)


def acm_journals(links: Column, titles: Column) -> Column:
    """Links and titles by position, as many as the shorter list."""
    n = F.least(F.size(links), F.size(titles))
    return F.zip_with(F.slice(links, 1, n), F.slice(titles, 1, n), lambda a, b: F.struct(a.alias("url"), b.alias("title")))


def ieee_board_link(hrefs: Column, own: Column) -> Column:
    """First link about editors or the board, else the page itself."""
    return F.coalesce(F.try_element_at(F.filter(hrefs, lambda h: F.rlike(h, F.lit("(?i)editor|board"))), F.lit(1)), own)


def title_before_bar(title: Column) -> Column:
    return F.element_at(F.split(title, r" \|", -1), 1)


def acl_series(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\(\d+\)", ""))


def acl_year(title: Column) -> Column:
    found = F.regexp_extract(title, r"(\d+)", 1)
    return F.when(found != "", found.cast("int"))
