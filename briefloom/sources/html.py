"""Landed web pages to node rows.

One narrow Arrow pass reads each page and emits only the nodes a rule asks for, each with the context the rules need
(section heading, nearby dates, first link). Everything after that is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from briefloom.sources.html_tree import page_nodes

NODES = (
    "page_id BIGINT, url STRING, node_pos INT, kind STRING, text STRING, href STRING, "
    "near ARRAY<STRUCT<attrs: ARRAY<STRING>, time_at: STRING, time_text: STRING, text_date: STRING>>, "
    "parent_text STRING, previous_heading STRING, "
    "heading STRUCT<node_pos: INT, id: STRING, text: STRING, dates: ARRAY<STRING>>, "
    "badge STRING, tags ARRAY<STRING>"
)
MAX_ROWS, MAX_CHARS = 5_000, 16_000_000
KINDS = ("page", "a", "li", "p", "card")


def read_pages(df: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """`(page_id, url, html)` rows to node rows of the given kinds.

    page: whole text. a: link with nearby date candidates. li, p: entry of a section with its heading.
    card: dated change-log card (`badge` is its date text, `tags` its labels).
    """
    wanted = tuple(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [
            "page_id", "url", "node_pos", "kind", "text", "href", "near", "parent_text", "previous_heading", "heading",
            "badge", "tags",
        ]
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                found = page_nodes(html or "", wanted)
                rows.extend((page_id, url, *node) for node in found)
                size += sum(len(node[2]) for node in found)
                # hand over in small pieces, whatever the size of the pages
                if len(rows) >= MAX_ROWS or size >= MAX_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return df.select("page_id", "url", "html").mapInPandas(run, NODES)
