"""Pages as a table of nodes, and page rules as joins and windows over it.

`node_table` reads a page once and gives a row per element and per piece of text, numbered in document order: `pre` is a node's own
number, `last` that of the last node below it. So a node lies within another one exactly if its number lies between these two; siblings
share `parent`. Ancestor rules are equi-joins by page with a range, sibling rules are windows over (page, parent): a stored table
serves any number of rules, and the pages need not be read again for a new one.

Both sides of these joins grow with the pages. The size Spark expects of them does not say so (a page becomes many nodes), so they are
merge joins by name: none is broadcast through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from briefloom.sources.html import MAX_CHARS, MAX_ROWS
from briefloom.sources.html_tree import HEADINGS, SILENT, Node, build

SCHEMA = "page_id BIGINT, url STRING, pre INT, last INT, parent INT, depth INT, tag STRING, attrs MAP<STRING, STRING>, text STRING"
_COLUMNS = ["page_id", "url", "pre", "last", "parent", "depth", "tag", "attrs", "text"]


def _rows(html: str) -> Iterator[tuple]:
    """(pre, last, parent, depth, tag, attrs, text): elements have a tag, texts have none; what is no page text is left out."""
    root = build(html)
    count, out = 0, []
    # (node, parent's number, depth) to enter, or the place of a row whose nodes have all been entered
    stack: list = [(root, None, 0)]
    while stack:
        at = stack.pop()
        if isinstance(at, int):
            out[at][1] = count - 1
            continue
        node, parent, depth = at
        if isinstance(node, str):
            if node.strip():
                out.append([count, count, parent, depth, None, None, node.strip()])
                count += 1
            continue
        own = count
        out.append([own, own, parent, depth, node.tag, dict(node.attrs), None])
        count += 1
        stack.append(len(out) - 1)
        if node.tag not in SILENT:
            stack.extend((c, own, depth + 1) for c in reversed(node.children))
        else:
            stack.extend((c, own, depth + 1) for c in reversed(node.children) if isinstance(c, Node))
    return iter(map(tuple, out))


def node_table(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) rows to node rows. A null page is an empty one: its root alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                for row in _rows(html or ""):
                    rows.append((page_id, url, *row))
                    size += len(row[6] or "")
                    if len(rows) >= MAX_ROWS or size >= MAX_CHARS:
                        yield _frame(rows)
                        rows, size = [], 0
            if rows:
                yield _frame(rows)

    return pages.select("page_id", "url", "html").mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    for name in ("pre", "last", "parent", "depth"):
        out[name] = out[name].astype("Int32")
    return out


def with_texts(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add `shown`, the whole text of each element: the pieces within it, in order, joined by blanks."""
    pieces = nodes.filter("tag IS NULL").select(F.col("page_id").alias("_page"), F.col("pre").alias("_at"), F.col("text").alias("_piece"))
    inside = (F.col("page_id") == F.col("_page")) & F.col("_at").between(F.col("pre"), F.col("last"))
    # an element's number names it within its page
    texts = elements.select("page_id", "pre", "last").distinct().join(pieces.hint("merge"), inside).groupBy("page_id", "pre").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_piece"))), lambda p: p["_piece"]), " ").alias("shown"))
    return elements.join(texts.hint("merge"), ["page_id", "pre"], "left").withColumn("shown", F.coalesce("shown", F.lit("")))


def within(inner: DataFrame, outer: DataFrame, name: str, innermost: bool = True) -> DataFrame:
    """Inner elements which lie in an outer one, with the innermost such, or with each, as `name` (its columns)."""
    box = outer.select(F.col("page_id").alias("_page"), F.struct(*outer.columns).alias(name))
    inside = (F.col("page_id") == F.col("_page")) & (F.col("pre") > F.col(f"{name}.pre")) & (F.col("pre") <= F.col(f"{name}.last"))
    met = inner.join(box.hint("merge"), inside).drop("_page")
    return met if not innermost else met.groupBy("page_id", "pre").agg(F.max_by(F.struct(*inner.columns, name), F.col(f"{name}.pre")).alias("_r")).select("_r.*")


def with_heading(nodes: DataFrame, tags: Sequence[str] = HEADINGS) -> DataFrame:
    """Add `heading` to elements: the number of the last heading before each among its siblings (null: none, or it is one itself)."""
    before = Window.partitionBy("page_id", "parent").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    is_heading = F.col("tag").isin(*tags)
    elements = nodes.filter("tag IS NOT NULL")
    found = elements.withColumn("heading", F.last(F.when(is_heading, F.col("pre")), ignorenulls=True).over(before))
    return found.withColumn("heading", F.when(~is_heading, F.col("heading")))


def section_bullets(nodes: DataFrame) -> DataFrame:
    """Bullets of the lists which follow a heading: page_id, url, pre, text, href (of their first link), heading_id, heading_text.

    The same bullets as `read_pages(…, ("li",))` gives, from a stored table: one in lists of two headings is a bullet of both.
    """
    marked = with_heading(nodes)
    lists = marked.filter(F.col("tag").isin("ul", "ol") & F.col("heading").isNotNull()).select("page_id", "pre", "last", "heading")
    bullets = within(nodes.filter("tag = 'li'").select("page_id", "url", "pre", "last"), lists, "list", innermost=False)
    links = nodes.filter("tag = 'a' AND map_contains_key(attrs, 'href')").select(
        F.col("page_id").alias("_page"), F.col("pre").alias("_link"), F.col("attrs")["href"].alias("_href"))
    first = bullets.join(links.hint("merge"), (F.col("page_id") == F.col("_page")) & F.col("_link").between(F.col("pre"), F.col("last")))
    hrefs = first.groupBy("page_id", "pre").agg(F.min_by("_href", "_link").alias("href"))
    headings = with_texts(nodes.filter(F.col("tag").isin(*HEADINGS)).select("page_id", "pre", "last", F.col("attrs")["id"].alias("heading_id")), nodes)
    headings = headings.select("page_id", F.col("pre").alias("heading"), "heading_id", F.col("shown").alias("heading_text"))
    shown = with_texts(bullets.withColumn("heading", F.col("list.heading")).drop("list"), nodes)
    return shown.join(hrefs.hint("merge"), ["page_id", "pre"], "left").join(headings.hint("merge"), ["page_id", "heading"]).select(
        "page_id", "url", "pre", F.col("shown").alias("text"), "href", "heading_id", "heading_text")
