import pytest
from pyspark.sql import functions as F

from gleaner.operators import extract
from gleaner.sources import html, responses

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><script>var x = "</p>";</script></head><body>
<ul id="list"><li class="x first"><a href="/1">One</a><li class="x"><a href="/2">Two</a></li><li><span>Three</span></li></ul>
<p>open<p class="last" data-n="a-b">Über</p><img src="i.png"><div></div><h2>h</h2><p>after</p><p>more</p></body></html>"""

CASES = [
    ("li", 3), ("ul > li > a", 2), ("body a", 2), ("#list .x", 2), ("li.x.first", 1), ("[data-n]", 1), ("[data-n='a-b']", 1), ("[data-n|=a]", 1), ("[class~=first]", 1),
    ("a[href^='/']", 2), ("a[href$='2']", 1), ("a[href*='1']", 1), ("li:first-child", 1), ("li:last-child", 1), ("li:nth-child(odd)", 2), ("li:nth-child(n+2)", 2),
    ("li:nth-last-child(1)", 1), ("p:nth-of-type(2)", 1), ("p:last-of-type", 1), ("h2:only-of-type", 1), ("li:not(.x)", 1), ("div:empty", 1), ("a:link", 2), ("a:visited", 0),
    ("li:contains(Two)", 1), ("p::before", 0), ("html:root", 1), ("li, h2", 4), ("h2 + p", 1), ("h2 ~ p", 2), ("p:lang(en)", 4), ("title", 1), ("li:nth-child(foo)", 0), ("div > a", 0),
]


@pytest.fixture(scope="module")
def nodes(spark):
    table = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain words")], "id long, html string")
    return html.nodes(table, "id").cache()


@pytest.mark.parametrize("selector, n", CASES)
def test_selectors(nodes, selector, n):
    assert html.select(nodes.where("id = 1"), "id", selector).count() == n


@pytest.mark.parametrize("selector", ["a:has(b)", "a:is(b)", "li >", "[", "a:contains('x')"])
def test_unsupported_selectors_raise(selector):
    with pytest.raises((ValueError, NotImplementedError)):
        html.read_selector(selector)


def test_tree(nodes):
    found = {r["tag"]: r["text"] for r in nodes.where("id = 1").collect()}
    assert found["title"] == "T & t"
    assert found["script"] == 'var x = "</p>";'
    texts = [r["text"] for r in nodes.where("id = 1 and tag = 'p'").orderBy("node").collect()]
    assert texts == ["open", "Über", "after", "more"]
    assert nodes.where("id in (2, 3)").count() == 0
    assert [r["tag"] for r in nodes.where("id = 4").orderBy("node").collect()] == ["html", "body"]


def test_fields(nodes):
    one = nodes.where("id = 1")
    assert extract.first_of(one, "id", "li > a", attr="href").first()["value"] == "/1"
    assert extract.texts_of(one, "id", "a").first()["values"] == ["One", "Two"]
    assert extract.present(one, "id", "h5").first()["present"] == ""
    items = extract.unnest(one, "id", "li")
    assert [(r["pos"], r["text"]) for r in extract.inside(one, "id", items, "a").orderBy("pos").collect()] == [(0, "One"), (1, "Two")]


def test_bodies(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, X'FFD8FF00'), (2, X'89504E47'), (3, X'EFBBBF0A3C'), (4, X''), (5, X'5249464600000000574542500A'), (6, X'0102') AS t(i, b)")
    kinds = [r["k"] for r in rows.select("i", responses.body_kind("b").alias("k")).orderBy("i").collect()]
    assert kinds == ["jpeg", "png", "wall", "wall", "webp", "unknown"]
    latin = spark.sql("SELECT X'3C6D65746120636861727365743D69736F2D383835392D313EE9' AS b")
    assert latin.select(responses.decoded("b", F.lit("")).alias("t")).first()["t"].endswith("é")


def test_index(spark):
    files = spark.createDataFrame([('[{"name":"b","pkg":"p","sources":["x"]},{"name":"c","pkg":"q","sources":[]}]',), ('{"name":"a","pkg":"r","sources":["y"]}',), ("{broken",)], "value string")
    assert sorted(r["name"] for r in responses.index_entries(files).collect()) == ["a", "b"]
    twice = spark.createDataFrame([("p", "n", "x"), ("p", "m", "y")], "pkg string, name string, content string")
    with pytest.raises(Exception, match="package twice"):
        responses.build_index(twice).collect()


def test_markdown_and_icons(spark):
    lines = spark.createDataFrame([("| id | b | c | d | e | f | status | notes |",), ("|---|---|---|---|---|---|---|---|",), ("| s1 | b | c | d | e | f | ✅ works | fine |",), ("text",)], "value string")
    assert [tuple(r) for r in responses.catalog_rows(lines).collect()] == [("s1", "works", "fine")]
    page = spark.createDataFrame([(1, '<link rel="icon" sizes="16x16" href="/a"><link rel="apple-touch-icon" href="/b"><meta name="msapplication-TileImage" content="/c"><link rel="icon" sizes="32x32" href="/d">')], "id long, html string")
    assert [r["href"] for r in responses.icon_candidates(page, "id").orderBy("rank").collect()] == ["/b", "/d", "/a", "/c"]


def test_what_stands_after_an_item_is_not_inside_it(spark):
    page = spark.createDataFrame([(1, "<ul><li><a>in</a><ul><li><a>nested</a></li></ul></li></ul><div><section><p><a>out</a></p></section></div>")], "id long, html string")
    nodes = html.nodes(page, "id")
    found = extract.inside(nodes, "id", extract.unnest(nodes, "id", "li"), "a").orderBy("node").collect()
    assert [(r["pos"], r["text"]) for r in found] == [(0, "in"), (1, "nested")]


def test_mask_icons_are_no_icons_and_blanks_around_charset(spark):
    page = spark.createDataFrame([(1, '<link rel="mask-icon" href="/m"><link rel="shortcut icon" href="/s"><link rel="apple-touch-icon-precomposed" href="/p">')], "id long, html string")
    assert [r["href"] for r in responses.icon_candidates(page, "id").orderBy("rank").collect()] == ["/p", "/s"]
    row = spark.sql("SELECT X'E9' AS b").select(responses.decoded("b", F.lit("text/html; charset = latin1")).alias("t"))
    assert row.first()["t"] == "é"


def test_challenge_pages(spark):
    rows = spark.createDataFrame([(1, "<script>window.__cf_chl_x</script>"), (2, "Checking your browser"), (3, "Just a moment...")], "id long, body string")
    headers = F.create_map(F.lit("server"), F.lit("Cloudflare"))
    assert [r["c"] for r in rows.orderBy("id").select(responses.is_challenge(F.lit(503), headers, F.col("body")).alias("c")).collect()] == [True, False, True]
