"""Extraction in one pass against the element table, and trees as HTML5 builds them."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import extract
from gleaner.sources import fused, html

PAGE = """<html lang=en-GB><head><title> T &amp; x </title></head><body class="a b"><div id=top><p>one<p class=x>two <b>bold<p>three</b> end</div>
<ul id=l><li>1<li class=on>2<li>3<li class="on off">4</ul><div lang=de><h2>kopf</h2><p title="a-b c">vier</p><p></p></div>
<table><caption>cap</caption><tr><td>a<td><i>b<tr><th>c<td></table><form><img src=" i.png "><input disabled></form></body></html>"""
SELECTORS = [
    "*", "p", "div p", "div > p", "#top", ".x", "body.a.b", "li:nth-child(2n)", "li:nth-child(-n+2)", "li:nth-last-child(1)", "li.on", "li.on:not(.off)", "[title]", "[title~=c]", "[title^=a]", "[title$=c]", "[title*=b]",
    "[title|=a]", "p:first-child", "p:last-child", "p:only-of-type", "td:first-of-type", "li + li", "li.on ~ li", "h2 + p", "p:contains(two)", "p:empty", "h2:lang(de)", "html:root", "table td", "tbody > tr > td", "p b", "li, h2", "input[disabled]", "b:visited", "li:nth-of-type(odd)", "div > p ~ p",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>x")], "k int, html string")


def test_the_same_elements_as_from_the_table(spark, pages):
    nodes = html.nodes(pages, "k").cache()
    for selector in SELECTORS:
        one = fused.matches(pages, "k", selector, {"v": "", "t": "title"}).select("k", "node", "v", "t")
        two = html.select(nodes, "k", selector).select("k", "node", html.text().alias("v"), html.attribute("title").alias("t"))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())), selector


def test_fields_of_items(spark, pages):
    wanted = {"own": ("", "", False), "bold": ("b", "", False), "on": (".x", "", True), "none": ("em", "", False)}
    got = [tuple(r) for r in fused.records(pages, "k", "p", wanted).orderBy("k", "pos").collect()]
    assert got[:3] == [(1, 0, "one", None, None, None), (1, 1, "two bold", "bold", None, None), (1, 2, "three end", "three", None, None)]
    whole = {r.k: r for r in fused.firsts(pages, "k", {"title": ("title", "", False), "src": ("form img", "src", False), "on": ("li.on", "", True), "no": ("em", "", False)}).collect()}
    assert tuple(whole[1])[1:] == ("T & x", "i.png", "1", None) and sorted(whole) == [1, 4]
    listed = fused.matches(pages, "k", "ul > li", {"v": ""})
    assert [r.pos for r in listed.orderBy("pos").collect()] == [0, 1, 2, 3]


def test_nested_items_are_read_to_their_end(spark):
    page = spark.createDataFrame([(1, "<div class=i><div class=i><b>in</b></div><b>out</b></div>")], "k int, html string")
    assert [r.b for r in fused.records(page, "k", "div.i", {"b": ("b", "", False)}).orderBy("pos").collect()] == ["in", "in"]


def test_steps_take_the_nearest_and_stay_with_it(spark):
    page = spark.createDataFrame([(1, "<div class=a></div><div class=b></div><span></span><i></i><span></span><b></b>")], "k int, html string")
    assert fused.matches(page, "k", "span + b", {}).count() == 1
    assert fused.matches(page, "k", "div.b ~ span + b", {}).count() == 1
    assert fused.matches(page, "k", "i + span ~ b", {}).count() == 1
    assert fused.matches(page, "k", "div.b + span ~ b", {}).count() == 0  # the nearest span is the second


def test_labelled_rows(spark):
    page = spark.createDataFrame([(1, "<p><b>Kind</b> <i>x,</i><i>y</i></p><p><i>z</i></p><p><b> Size </b>7</p>")], "k int, html string")
    rows = fused.labelled(page, "k", "p", "b", "i")
    assert [(r.row_pos, r.label, r.value) for r in rows.orderBy("value_pos").collect()] == [(0, "Kind", "x,"), (0, "Kind", "y")]
    assert {(r.field, tuple(r["values"])) for r in extract.label_values(fused.labelled(page, "k", "p", "b"), "k", {"a": ["kind", "none"], "b": ["SIZE", "Kind"]}).collect()} == {("a", ("Kind x,y",)), ("b", ("Kind x,y", "Size 7"))}


def shape(text):
    page = fused.Page(text)
    tell = lambda i: page.tags[i] + (f"({','.join(map(tell, page.kids[i]))})" if i in page.kids else "")
    return tell(page.kids[page.by_tag["body"][0]][0]), {page.tags[i]: page.text(i) for i in range(len(page.tags))}


@pytest.mark.parametrize(
    ("text", "tree", "said"),
    [
        ("<table><tr><td>a<td>b<tr><th>c</table>", "table(tbody(tr(td,td),tr(th)))", {}),
        ("<table><td>a</table>", "table(tbody(tr(td)))", {}),
        ("<table><thead><tr><th>h<tbody><tr><td>c<tfoot><tr><td>f</table>", "table(thead(tr(th)),tbody(tr(td)),tfoot(tr(td)))", {"tfoot": "f"}),
        ("<table><tr><td><table><tr><td>in</table>out</table>", "table(tbody(tr(td(table(tbody(tr(td)))))))", {}),
        ("<div><p><b>x<p>y</b>z<p>w</div>", "div(p(b),p(b),p)", {"b": "y", "p": "w"}),
        ("<div><table><tr><td><i>c<td>d</table>e</div>", "div(table(tbody(tr(td(i),td))))", {"i": "c"}),
        ("<div><a href=1>x<a href=2>y</a>z</div>", "div(a,a)", {"a": "y"}),
        ("<div><p><b>1<b>1<b>1<b>1<p>q</div>", "div(p(b(b(b(b)))),p(b(b(b))))", {}),
        ("<div><b><p>x</b>y</p>z</div>", "div(b(p))", {"p": "xy", "b": "x"}),
        ("<ul><li><em>a<li>b</ul>", "ul(li(em),li(em))", {}),
    ],
)
def test_trees(text, tree, said):
    found, texts = shape(text)
    assert found == tree and {k: texts[k] for k in said} == said


def test_deep_pages_give_rows_of_what_was_asked_for(spark):
    deep = "<div>" * 3000 + "x" * 10_000 + "<a href=y>z</a>" + "</div>" * 3000
    page = spark.createDataFrame([(1, deep)], "k int, html string")
    got = fused.matches(page, "k", "div > a", {"href": "href", "v": ""}).select(F.struct("*")).collect()
    assert [tuple(r[0]) for r in got] == [(1, 0, 3002, "y", "z")]
