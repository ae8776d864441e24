import base64

import pytest
from pyspark.sql import functions as F

from gleaner.plans import steps
from gleaner.plans.steps import Locator, Output, Step

KNOWN = "method string, url string, body_key string, transport string, status int, headers map<string,string>, body string"
LISTING = '<div class="item"><a href="/t/1"> One </a><i>1</i></div><div class="item"><a href="/t/2">Two</a></div><p><i>9</i></p><a class="next" href="?page=2">next</a>'


@pytest.fixture(scope="module")
def known(spark):
    pages = {"http://x/l": LISTING, "http://x/id": "var id = 'k7';", "http://x/d/k7": '{"title":"T","tags":[{"n":"a"},{"n":"b"},{}]}', "http://x/broken": "{no"}
    return spark.createDataFrame([("GET", u, "", "plain", 200, None, b) for u, b in pages.items()] + [("GET", "http://x/gone", "", "plain", 404, None, "")], KNOWN)


def _runs(spark, **urls):
    return spark.createDataFrame([(k, {"url": u}) for k, u in urls.items()], "k string, vars map<string,string>")


def test_listing_with_meta_and_missing_responses(spark, known):
    config = {"path": "{url}", "itemSelector": "div.item", "titleSelector": "a", "urlSelector": "a", "nextSelector": "a.next"}
    runs = _runs(spark, a="l", b="gone", c="nowhere")
    found = steps.run(runs, "k", steps.listing_steps(config), known, "http://x/").orderBy("pos").collect()
    assert [(r["k"], r["pos"], r["title"], r["url"], r["has_next"]) for r in found] == [("a", 0, "One", "/t/1", "1"), ("a", 1, "Two", "/t/2", "1")]


def test_defaults_and_fields_within_their_item(spark, known):
    out = Output(Locator(selector="div.item"), {"n": Locator(selector="i", default="none")})
    found = steps.run(_runs(spark, a="l"), "k", [Step(url="l", output=out)], known, "http://x/").orderBy("pos").collect()
    assert [r["n"] for r in found] == ["1", "none"]


def test_captures_reach_later_requests_and_bodies_are_reused(spark, known):
    chain = [
        Step(url="id", capture={"id": Locator(regex="id = '(\\w+)'")}),
        Step(url="d/{id}", parse="json", capture={"title": Locator(path="title")}),
        Step(parse="json", output=Output(Locator(path="tags"), {"value": Locator(path="n", default="-")})),
    ]
    found = steps.run(_runs(spark, a="l"), "k", chain, known, "http://x/").orderBy("pos").collect()
    assert [r["value"] for r in found] == ["a", "b", "-"]
    told = steps.run_body(_runs(spark, a="l"), "k", chain[:2], known, "http://x/").first()
    assert told["vars"] == {"url": "l", "id": "k7", "title": "T"} and told["body"].startswith('{"title"')


def test_unreadable_bodies_and_no_output_give_no_rows(spark, known):
    out = Output(Locator(path="tags"), {"value": Locator(path="n")})
    assert steps.run(_runs(spark, a="broken"), "k", [Step(url="{url}", parse="json", output=out)], known, "http://x/").count() == 0
    assert steps.run(_runs(spark, a="l"), "k", [Step(url="l")], known, "http://x/").count() == 0
    with pytest.raises(ValueError):
        Step(parse="xml")


def test_json_of_scripts_and_unset_names(spark):
    inlined = base64.b64encode(b'go({"a":1})').decode()
    rows = spark.createDataFrame([('x go({"a":2}) y',), (f'<script src="data:text/javascript;base64,{inlined}">',), ("none",)], "body string")
    assert [r["j"] for r in rows.select(steps.regex_json("body", r"go\((\{.*?\})\)").alias("j")).collect()] == ['{"a":2}', '{"a":1}', ""]
    row = spark.range(1).select(F.create_map(F.lit("a"), F.lit("1")).alias("vars"))
    assert row.select(steps.substituted("/{a}/{b}").alias("u")).first()["u"] == "/1/{b}"


def test_script_steps_need_a_runtime_and_capture_its_result(spark, known):
    step = Step(script=steps.Script("up", {"a": "{url}"}, capture="out"))
    with pytest.raises(RuntimeError):
        steps.run_body(_runs(spark, a="l"), "k", [step], known)
    told = steps.run_body(_runs(spark, a="l"), "k", [step], known, runtime=lambda code, args: F.concat(F.lit(f" {code}:"), F.get_json_object(args, "$.a"), F.lit(" ")))
    assert told.first()["vars"] == {"url": "l", "out": "up:l"}


def test_pages_end_at_their_last_number_or_at_a_gap(spark):
    body = lambda n, last: f'{{"data":[{{"v":"{n}"}}],"at":"{n}","last":"{last}"}}'
    pages = [("a/1", body(1, 2)), ("a/2", body(2, 2)), ("a/3", body(3, 9)), ("b/1", body(1, 9)), ("b/3", body(3, 9))]
    known = spark.createDataFrame([("GET", f"http://x/{u}", "", "plain", 200, None, b) for u, b in pages], KNOWN)
    out = Output(Locator(path="data"), {"value": Locator(path="v")}, {"at": Locator(path="at"), "last": Locator(path="last")})
    ask = [Step(url="{url}/{page}", parse="json", output=out)]
    found, last = steps.paged(_runs(spark, a="a", b="b"), "k", ask, known, "http://x/", steps.Pagination(current_page_meta="at", last_page_meta="last", max_pages=4))
    assert sorted((r["k"], r["page"], r["value"]) for r in found.collect()) == [("a", 1, "1"), ("a", 2, "2"), ("b", 1, "1")]
    assert sorted((r["k"], r["page"]) for r in last.collect()) == [("a", 2), ("b", 1)]
