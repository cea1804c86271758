"""Sources: crawled tables, lexicons, column files, page HTML to lines, conference pages.

Fetching is outside the engine: pages arrive as rows (url, html).  HTML is
parsed with the standard library in Arrow batches; parsing never raises, a page
without a body has the status 'Error'.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators.sequence import conll_tokens

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: an opening tag ends open elements of these kinds, as browsers do
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("div p ul ol table h1 h2 h3 h4 h5 h6 section article header footer".split())


class Node:
    __slots__ = ("tag", "line", "attrs", "children", "parent")

    def __init__(self, tag: str, line: int, attrs: dict[str, str], parent: Node | None):
        self.tag, self.line, self.attrs, self.parent = tag, line, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def texts(self) -> list[str]:
        return [s for c in self.children if isinstance(c, str) and (s := c.strip())]

    def all(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.elements())

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return "".join(out)


class Tree(HTMLParser):
    """A forgiving tree: unknown closings are ignored, open elements end with their parents."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", 0, {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
        if self.now.tag in ends:
            self.now = self.now.parent
        node = Node(tag, self.getpos()[0], {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.now = self.now.parent

    def handle_endtag(self, tag: str) -> None:
        n = self.now
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.now = n.parent

    def handle_data(self, data: str) -> None:
        # text runs that only a reference split belong together
        if self.now.children and isinstance(self.now.children[-1], str):
            self.now.children[-1] += data
        else:
            self.now.children.append(data)


def page_lines(page: str) -> list[tuple[int, str, str, int]] | None:
    """(source line, text, tag, indentation) of a page's body; null without a body.

    Elements of a mixed node come before its own texts; with <br> the node is cut
    at each, a piece taking the line before its <br> (the last one's for the rest).
    Elements between breaks are one level deeper, as are those of a node without text.
    """
    body = next((n for n in Tree(page).root.all() if n.tag == "body"), None)
    if body is None:
        return None
    out: list[tuple[int, str, str, int]] = []
    work: list = [(body, 0)]
    while work:  # a stack of nodes and of finished rows, in output order
        node, depth = work.pop()
        if isinstance(node, tuple):
            out.append(node)
            continue
        if node.tag in ("script", "style"):
            continue
        inner, own = node.elements(), node.texts()
        if not inner:
            out += [(node.line, t, node.tag, depth) for t in own]
        elif not own:
            work += [(c, depth + 1) for c in reversed(inner)]
        elif not any(c.tag == "br" for c in inner):
            rows = [((node.line, t, node.tag, depth), 0) for t in own]
            work += reversed([(c, depth) for c in inner] + rows)
        else:
            plan, held, texts, line = [], [], [], 0
            for c in [*node.children, None]:
                if c is None or isinstance(c, Node) and c.tag == "br":
                    line = c.line - 1 if c is not None else line
                    plan += [(x, depth + 1) for x in held] + [((line, t, node.tag, depth), 0) for t in texts]
                    held, texts = [], []
                elif isinstance(c, Node):
                    held.append(c)
                elif c.strip():
                    texts.append(c.strip())
            work += reversed(plan)
    return out


def lines_of_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, pos, line_num, line_text, tag, indentation, status); one row with status 'Error' for a page without a body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, page in zip(b["page_id"], b["html"]):
                found = page_lines(page or "")
                if found is None:
                    rows.append((i, -1, None, None, None, None, "Error"))
                else:
                    rows += [(i, k, *r, "Yes") for k, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "line_num", "line_text", "tag", "indentation", "status"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInPandas(run, "page_id long, pos int, line_num int, line_text string, tag string, indentation int, status string")


def pages_to_process(pages: DataFrame) -> DataFrame:
    return pages.where(~F.col("processed").eqNullSafe("Yes") & (F.col("content_type") == "html"))


def parse_conference(page: str) -> tuple[str, str | None, dict[str, str], list[str]] | None:
    """(title, link, timetable, categories) of a conference page with fixed table places; null if it has none.

    A page without a link has its later rows one place earlier.
    """
    root = Tree(page).root
    sec = next((n for n in root.all() if n.tag == "div" and "contsec" in n.attrs.get("class", "")), None)
    table = next((n for n in sec.all() if n.tag == "table"), None) if sec else None
    if table is None:
        return None
    trs = [r for c in table.elements() for r in ([c] if c.tag == "tr" else c.elements() if c.tag == "tbody" else []) if r.tag == "tr"]
    if len(trs) < 4:
        return None
    title = next((n.text().strip() for n in trs[1].all() if n.tag == "span" and "v:description" in n.attrs.get("property", "")), None)
    link = next((n.attrs["href"].strip() for n in trs[2].all() if n.tag == "a" and n.attrs.get("href")), None)
    at = 4 if link else 3
    if title is None or len(trs) <= at:
        return None
    times: dict[str, str] = {}
    for row in trs[at].all():
        head = next((c for c in row.elements() if c.tag == "th"), None) if row.tag == "tr" else None
        cell = next((c for c in row.elements() if c.tag == "td"), None) if head else None
        if cell is not None:
            start = next((n.text() for n in cell.all() if n.tag == "span" and n.attrs.get("property") == "v:startDate"), None)
            times[head.text().strip()] = (start if start is not None else " ".join(cell.texts())).strip()
    topics = [n.text().strip() for n in trs[at].all() if n.tag == "a" and "call" in n.attrs.get("href", "")]
    return title, link, times, topics


def conferences_of_pages(pages: DataFrame) -> DataFrame:
    """(url, title, link, timetable, year, categories, status) of conference pages (url, html)."""
    from scrivener.functions.text import year_of

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, page in zip(b["url"], b["html"]):
                found = parse_conference(page or "")
                rows.append((url, *(found or (None, None, {}, [])), "Yes" if found else "Error"))
            yield pd.DataFrame(rows, columns=["url", "title", "link", "timetable", "categories", "status"])

    out = pages.select("url", "html").mapInPandas(run, "url string, title string, link string, timetable map<string,string>, categories array<string>, status string")
    return out.withColumn("year", year_of(F.col("timetable")["When"]))


def read_lexicon(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(type, content) of a text file, one entry a line; blank entries dropped, surnames lower-cased."""
    content = F.lower("value") if kind == "surname" else F.col("value")
    return spark.read.text(path).where("trim(value) <> ''").select(F.lit(kind).alias("type"), content.alias("content")).distinct()


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of 'word TAG' files; each file is split by its own lines."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), "value")
    return conll_tokens(files.select("doc", F.posexplode(F.split("value", "\n", -1)).alias("n", "line")))


def read_columns(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """Column files without quoting, escaped by a backslash."""
    return spark.read.csv(path, sep=sep, schema=schema, quote="", escape="\\")
