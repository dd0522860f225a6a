"""The node table beside the page reader, on broken, deep and empty pages."""

import random

from briefloom.sources import nodes
from briefloom.sources.html import read_pages
from pyspark.sql import functions as F


def table(spark, *pages):
    return spark.createDataFrame([(i, "https://e.com/", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")


def random_page(rng):
    tags = ["div", "p", "ul", "ol", "li", "li", "h2", "h3", "a", "b", "br", "section"]
    out = []
    for _ in range(60):
        t = rng.choice(tags)
        out.append(rng.choice([f"<{t}>", f"<{t} id='{rng.randint(0, 9)}' href='/x{rng.randint(0, 9)}'>", f"</{t}>", "<h3 id='q'>head <b>x</b></h3>", "<ul><li>one <a href='/l'>two</a><li>three</ul>", "<script>var s</script>", f"w{rng.randint(0, 99)} ", " ", "&amp;", "<!-- no -->"]))
    return "".join(out)


def test_numbers_are_nested(spark):
    web = table(spark, "<div><p>a<b>c</b></p>d</div>", None, "", "<i>" * 3000 + "deep")
    rows = nodes.node_table(web).orderBy("page_id", "pre").collect()
    first = [(r.pre, r.last, r.parent, r.depth, r.tag, r.text) for r in rows if r.page_id == 0]
    assert first == [(0, 6, None, 0, "[document]", None), (1, 6, 0, 1, "div", None), (2, 5, 1, 2, "p", None), (3, 3, 2, 3, None, "a"), (4, 5, 2, 3, "b", None),
                     (5, 5, 4, 4, None, "c"), (6, 6, 1, 2, None, "d")]
    assert [len([r for r in rows if r.page_id == i]) for i in (1, 2)] == [1, 1]
    assert max(r.depth for r in rows) == 3001 and rows[-1].text == "deep"


def test_bullets_and_texts_equal_the_page_reader(spark):
    rng = random.Random(5)
    web = table(spark, *[random_page(rng) for _ in range(60)], "<h2 id='a'>H<br>x</h2><ul><li>1<ul><li>2</li></ul></li></ul>").repartition(3)
    laid = nodes.node_table(web).cache()
    key = lambda r: tuple(str(x) for x in r)
    want = [(r.page_id, r.text, r.href, r.heading.id, r.heading.text) for r in read_pages(web, ("li",)).collect()]
    got = nodes.section_bullets(laid).select("page_id", "text", "href", "heading_id", "heading_text").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(want) > 40
    whole = nodes.with_texts(laid.filter("parent IS NULL").select("page_id", "pre", "last"), laid).select("page_id", "shown").collect()
    assert sorted(map(tuple, whole)) == sorted((r.page_id, r.text) for r in read_pages(web, ("page",)).collect())
    laid.unpersist()


def test_innermost_ancestor(spark):
    laid = nodes.node_table(table(spark, "<div id='o'><div id='i'><a>x</a></div><a>y</a></div><a>z</a>"))
    boxes = laid.filter("tag = 'div'").select("page_id", "pre", "last", F.col("attrs")["id"].alias("id"))
    out = nodes.within(laid.filter("tag = 'a'").select("page_id", "pre", "last"), boxes, "box").orderBy("pre").collect()
    assert [r.box.id for r in out] == ["i", "o"]


def test_nodes_are_never_broadcast(spark):
    laid = nodes.node_table(table(spark, "<h2 id='a'>x</h2><ul><li>1 <a href='/l'>two</a></li></ul>")).cache()
    boxes = laid.filter("tag = 'ul'").select("page_id", "pre", "last")
    for found in (nodes.section_bullets(laid), nodes.within(laid.filter("tag = 'li'").select("page_id", "pre", "last"), boxes, "box")):
        assert len(found.collect()) == 1
        assert "Broadcast" not in found._jdf.queryExecution().toString()
    laid.unpersist()
