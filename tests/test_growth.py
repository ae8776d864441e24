"""Queries against their SQL on tables that are longer or odder than the given ones."""

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner import registry
from gleaner.operators import induce
from gleaner.plans import adapters
from gleaner.plans.steps import Locator
from gleaner.sources import fused, html, responses
from gleaner.sources.html import Tree
from tests.test_queries import rows_of


@pytest.fixture
def same(spark):
    """Whether a query over a folder of tables gives what its SQL does; the rows."""

    def compare(name, folder, *tables):
        duck = duckdb.connect()
        for table in tables:
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        got, want = registry.queries()[name](spark, str(folder)).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
        assert rows_of(got) == rows_of(want)
        return got

    return compare


@pytest.fixture
def parts(spark, tmp_path):
    """A folder with n parts of so many brands."""

    def made(n, brands):
        columns = ["id AS p_partkey", "concat('name ', id % 64) AS p_name", f"concat('Brand#', id % {brands}) AS p_brand", "'LARGE' AS p_type", "CAST(id % 50 + 1 AS INT) AS p_size"]
        spark.range(n).selectExpr(*columns).write.parquet(f"{tmp_path}/part.parquet")
        return tmp_path

    return made


@pytest.mark.parametrize("name", ["adapter_search", "adapter_api_search", "adapter_post_search"])
def test_a_brand_of_more_than_98_pages(same, parts, name):
    assert len(same(name, parts(995, 1), "part"))


@pytest.fixture
def captured(spark, tmp_path):
    """A folder with these pages."""

    def made(documents):
        rows = [(i, f"https://x.test/{i}", d) for i, d in enumerate(documents)]
        spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
        return tmp_path

    return made


def test_elements_leave_in_bounded_batches():
    schema = to_arrow_schema(T.StructType([T.StructField("k", T.IntegerType()), *html._NODE]))
    long = "<main id='m' class='wide shelf'>" + "<div class='card'><p><b>some words</b></p></div>" * 40_000 + "</main>"
    small = ["<ul>" + "<li><a href='/x'>y</a>" * 20 + "</ul>"] * 3000
    rows = 0
    for batch in html._batches(enumerate([long, *small]), "k", schema, False):
        rows += batch.num_rows
        assert batch.nbytes < 4 * html.BATCH
    assert rows == 2 + 1 + 3 * 40_000 + 3000 * (2 + 1 + 40)


@pytest.mark.parametrize("name", ["html_links_from_elements", "html_attribute_prefix", "repeating_groups", "html_exists", "html_genres", "html_lang", "url_resolve", "label_rows"])
def test_pages_of_many_batches(same, captured, name):
    links = lambda n: "".join(f'<li><a href="/t{i}">name {i}</a></li>' for i in range(n))
    documents = [f'<html lang="de"><head><title>t</title></head><body><nav><ul>{links(3000 if i % 3 else 5)}</ul></nav><div class="ad">x</div><h1>h</h1></body></html>' for i in range(6)]
    assert len(same(name, captured(documents), "pages"))


ODD = ["the&amp;&amp;&amp", "a&copy b &quot;c&quot; &ampd; &", "x &amp;quot; &copy; &middot; &quo"]


@pytest.mark.parametrize("name", ["html_details", "html_details_from_elements"])
def test_references_without_an_end_stay(same, captured, name):
    pages = captured([f'<html lang="en"><head><title>{t}</title></head><body><nav><ul></ul></nav></body></html>' for t in ODD])
    assert sorted(same(name, pages, "pages")["title"]) == ['a&copy b "c" &ampd; &', "the&&&amp", "x &quot; © · &quo"]


def test_ended_leaves_other_markup_alone():
    html = "<p title='a&amp b&amp;'>x&amp<script>a&b&amp;</script>&lt;&#65;&#65 &nosuch; <i&a>z"
    ended, plain = Tree.of(html, ended=True), Tree.of(html)
    assert ended.tags == plain.tags and "".join(plain.pieces) == "x&a&b&amp;<AA &nosuch; z"
    assert "".join(ended.pieces) == "x&amp" + "a&b&amp;" + "<A&#65 &nosuch; z"
    assert ended.attrs[ended.tags.index("p")] == {"title": "a&amp b&"}


def test_elements_are_counted_in_the_parse(spark):
    documents = ["<p>a<p>b", "<p>a<p>b", "", None, "<!-- -->", "<ul><li>x</ul>"]
    pages = spark.createDataFrame([(i, d, "<i>") for i, d in enumerate(documents)], "k int, a string, b string")
    found = fused.counts(pages, "k", ["a", "b"])
    assert {tuple(r) for r in found.collect()} == {(0, 4, 3), (1, 4, 3), (5, 4, 3)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    wanted = html.nodes(pages, "k", "a").groupBy("k").count()
    assert {tuple(r) for r in wanted.collect()} == {(0, 4), (1, 4), (5, 4)}


@pytest.mark.parametrize("name", ["hydration_by_count"])
def test_counts_of_pages_without_a_shuffle(spark, same, parts, name):
    folder = parts(200, 3)
    same(name, folder, "part")
    assert "Exchange" not in registry.queries()[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()


def test_a_feed_is_asked_for_no_more_than_twice_its_pages(spark, monkeypatch):
    """Feeds of 1 to 40 pages, one with a gap: all pages up to the end or the gap are told, and few more are asked for."""
    feeds = [(k, page) for k in range(1, 41) for page in range(1, k + 1) if (k, page) != (30, 17)]
    body = lambda k, page: '{"data":[%s],"n":%d}' % (",".join(f'{{"id":"{i}"}}' for i in range(page * 2 - 1, page * 2 + 1)), k * 2)
    rows = [("GET", f"http://x.test/{k}/{page}", "", "plain", 200, None, body(k, page)) for k, page in feeds]
    known = spark.createDataFrame(rows, "method string, url string, body_key string, transport string, status int, headers map<string,string>, body string")
    items = spark.createDataFrame([(k, str(k)) for k in range(0, 41)], "k int, url string")
    asked, fetch = [], responses.fetch
    monkeypatch.setattr(responses, "fetch", lambda requests, *a: asked.append(requests.count()) or fetch(requests, *a))
    found = adapters.api_chapters(items, "k", "{url}/{page}", "data", {"url": Locator(path="id")}, known, "http://x.test/", 2, "n")
    told = {k: [r["url"] for r in sorted(rs, key=lambda r: r["pos"])] for k, rs in itertools.groupby(sorted(found.collect(), key=lambda r: r["k"]), lambda r: r["k"])}
    assert told == {k: [str(i) for i in range(1, 2 * (16 if k == 30 else k) + 1)] for k in range(1, 41)}
    assert sum(asked) <= 2 * len(rows) + 41


@pytest.mark.parametrize("name", ["induce_rows"])
def test_pages_are_parsed_once_for_all_that_is_tried_on_them(spark, same, parts, name):
    folder = parts(60, 3)
    assert len(same(name, folder, "part"))
    plan = registry.queries()[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and len(plan) < 30_000


def test_fields_are_found_in_nested_roots_without_comparing_all_with_all(spark):
    body = '<main><div class="card"><b>x</b><div class="card"><i>z</i><b>y</b></div></div><div class="card"><b>w</b></div><b>v</b></main>'
    nodes = html.nodes(spark.createDataFrame([(1, body)], "k int, html string"), "k").withColumn("ask", F.lit("a")).cache()
    roots = html.select(nodes, "k", "div.card").select("k", "ask", "node", "last")
    clicks = html.select(nodes, "k", "i + b").select("k", "ask", "node")
    found = induce.field_selectors(nodes, "k", roots, clicks)
    # The click lies in the outer card, too, whose first b is another; so no proposal wins.
    assert [tuple(r) for r in found.select("selector", "matched", "items", "preview").collect()] == [("b", 2, 3, "y")]
    first = induce.field_selectors(nodes, "k", roots, html.select(nodes, "k", "div.card:first-child > b").select("k", "ask", "node").groupBy("k", "ask").agg(F.min("node").alias("node")))
    assert [tuple(r) for r in first.select("selector", "matched", "items", "preview").collect()] == [("b", 3, 3, "x")]
    assert "<= until" not in first._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["induce_field", "induce_items"])
def test_shelves_of_one_brand(same, parts, name):
    assert len(same(name, parts(700, 1), "part"))
