"""Stores, attempts and the ways of the planner that queries don't show."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import jsonpath, text
from gleaner.plans import feeds, steps
from gleaner.plans.steps import Decrypt, Locator, Output, Step
from gleaner.sources import responses, store

KNOWN = "method string, url string, body_key string, transport string, status int, headers map<string,string>, body string"


def known(spark, *rows, more="", method="GET"):
    return spark.createDataFrame([(method, url, "", "plain", status, None, body, *rest) for url, status, body, *rest in rows], KNOWN + more)


def runs(spark, **vars):
    return spark.createDataFrame([("r", vars)], "k string, vars map<string,string>")


def test_fetch_answers_each_request_once(spark):
    asked = known(spark, ("a", 200, "x")).select(*responses.KEY).unionByName(known(spark, ("b", 200, "x")).select(*responses.KEY))
    answers = known(spark, ("a", 500, "z"), ("a", 200, "y"), ("a", 200, "x"))
    got = {r.url: (r.status, r.body) for r in responses.fetch(asked, answers).collect()}
    assert got == {"a": (200, "x"), "b": (None, None)}


@pytest.mark.parametrize(
    ("statuses", "status", "attempt"),
    [([500, None, 200], 200, 3), ([500, 404, 200], 404, 2), ([429, 429, 429, 200], 429, 3), ([503, 500], 500, 2), ([200, 500], 200, 1), ([None], None, 1)],
)
def test_settled_follows_the_retry_rule(spark, statuses, status, attempt):
    rows = [("a", s, str(i), f"2026-01-01 00:00:0{i}") for i, s in enumerate(statuses, 1)] + [("a", 200, "old", "2025-01-01 00:00:00")]
    rows = known(spark, *rows, more=", at string").withColumn("fetched_at", F.to_timestamp("at")).drop("at")
    [got] = responses.settled(rows).collect()
    assert (got.status, got.body) == (status, str(attempt))
    [old] = responses.settled(rows, as_of=F.to_timestamp(F.lit("2025-06-01"))).collect()
    assert old.body == "old"


def test_a_challenge_ends_a_visit(spark):
    rows = known(spark, ("a", 503, "Just a moment", "2026-01-01 00:00:01"), ("a", 200, "x", "2026-01-01 00:00:02"), more=", at string")
    rows = rows.withColumn("headers", F.create_map(F.lit("server"), F.lit("cloudflare"))).withColumn("fetched_at", F.to_timestamp("at"))
    assert [r.status for r in responses.settled(rows).collect()] == [503]


def test_form_headers(spark):
    row = spark.range(1).select(
        responses.form_headers(F.create_map(F.lit("A"), F.lit("b")), F.lit("x=1")).alias("a"),
        responses.form_headers(F.create_map(F.lit("content-TYPE"), F.lit("b")), F.lit("x=1")).alias("b"),
        responses.form_headers(F.create_map(F.lit("A"), F.lit("b")), F.lit("")).alias("c"),
    )
    [r] = row.collect()
    assert r.a == {"A": "b", "Content-Type": "application/x-www-form-urlencoded; charset=UTF-8"} and r.b == {"content-TYPE": "b"} and r.c == {"A": "b"}


def test_captures_of_unreadable_bodies_leave_variables(spark):
    step = Step(url="/x", parse="json", capture={"id": Locator(path="id"), "seen": Locator(regex="(n)")})
    for body, want in (("none", {"id": "7", "seen": "n"}), ('{"n":1}', {"id": "", "seen": "n"}), ('{"id":"9"}', {"id": "9", "seen": ""})):
        [got] = steps.run_body(runs(spark, id="7"), "k", [step], known(spark, ("http://x/x", 200, body)), "http://x/").collect()
        assert got.vars == want


def test_captures_from_variables_are_escaped(spark):
    step = Step(url="/x", capture={"id": Locator(regex="id=(.*)", source="link", encode=True), "name": Locator(selector="b", encode=True)})
    [got] = steps.run_body(runs(spark, link="id=a b/c"), "k", [step], known(spark, ("http://x/x", 200, "<b>ü &amp; x</b>")), "http://x/").collect()
    assert got.vars == {"link": "id=a b/c", "id": "a%20b%2Fc", "name": "%C3%BC%20%26%20x"}


def test_substitution_fills_what_it_brings(spark):
    [got] = runs(spark, a="{b}", b="x", value="old").select(steps.substituted("{a}-{b}-{c}-{value}", "vars", value=F.lit("new")).alias("t")).collect()
    assert got.t == "x-x-{c}-new"


def test_flat_lists_leave_out_empty_values_and_open_strings(spark):
    step = Step(url="/x", parse="json", output=Output(Locator(path="d"), {"value": Locator(template="{value}{id}")}))
    answers = known(spark, ("http://x/x", 200, '"{\\"d\\":[\\"a\\",\\"\\",null,\\"c\\"]}"'))
    got = steps.run(runs(spark, id="!"), "k", [step], answers, "http://x/").orderBy("pos").collect()
    assert [(r.pos, r.value) for r in got] == [(0, "a!"), (1, "c!")]
    keyed = Step(url="/x", parse="json", output=Output(Locator(values=True), {"value": Locator(path="n")}))
    answers = known(spark, ("http://x/x", 200, '{"p":{"n":1},"q":{"n":2}}'))
    assert [r.value for r in steps.run(runs(spark), "k", [keyed], answers, "http://x/").orderBy("pos").collect()] == ["1", "2"]


def test_a_wrong_password_gives_nothing(spark):
    step = Step(decrypt=Decrypt("{blob}", "{key}"), parse="json", output=Output(fields={"value": Locator()}))
    assert steps.run(runs(spark, blob='{"ct":"AA==","iv":"00","s":"00"}', key="k"), "k", [step], known(spark), "http://x/").count() == 0


def test_no_page_is_asked_beyond_the_last(spark, monkeypatch):
    answers = [(f"http://x/{p}", 200, f'{{"d":["{p}"],"on":"{"1" if p < 4 else ""}"}}') for p in range(1, 9)]
    asked = []
    fetch = responses.fetch
    monkeypatch.setattr(responses, "fetch", lambda r, k: asked.append([x.url for x in r.collect()]) or fetch(r, k))
    step = Step(url="/{page}", parse="json", output=Output(Locator(path="d"), {"value": Locator()}, {"on": Locator(path="on")}))
    once = Step(url="/8", parse="json", capture={"first": Locator(path="d[0]")})
    found, last = steps.paged(runs(spark), "k", [once, step], known(spark, *answers), "http://x/", steps.Pagination(has_next_meta="on"))
    assert sorted(r.value for r in found.collect()) == ["1", "2", "3", "4"] and last.collect()[0].page == 4
    assert asked == [["http://x/8"], *[[f"http://x/{p}"] for p in range(1, 5)]]
    seeded, _ = steps.paged(runs(spark, page="3"), "k", [step], known(spark, *answers), "http://x/", steps.Pagination(has_next_meta="on", max_pages=2))
    assert [(r.page, r.value) for r in seeded.orderBy("page").collect()] == [(1, "3"), (2, "2")]


def test_a_strict_json_pipeline_fails_on_a_broken_body(spark):
    answers = known(spark, ("http://x/x", 200, "{"))
    with pytest.raises(Exception, match="MALFORMED"):
        steps.run_json(runs(spark), "k", [Step(url="/x")], answers, "http://x/").selectExpr("to_json(root)").collect()
    assert steps.run_json(runs(spark), "k", [Step(url="/x")], answers, "http://x/", strict=False).where("root IS NULL").count() == 1


def test_following_has_no_bound_on_rows_and_one_on_pages(spark):
    links = spark.range(200).selectExpr("'p' || id AS url", "'p' || (id + 1) AS next")
    start = spark.createDataFrame([("p0",), ("p0",), ("p190",)], "url string")
    got = feeds.follow(start, links, 50).groupBy("origin").agg(F.count("*").alias("n"), F.max("page").alias("last"), F.countDistinct("url").alias("urls")).collect()
    assert {r.origin: (r.n, r.last, r.urls) for r in got} == {"p0": (50, 50, 50), "p190": (11, 11, 11)}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "url string, next string")
    assert feeds.follow(spark.createDataFrame([("a",)], "url string"), loop, 7).count() == 7
    assert feeds.follow(start, links, 1).count() == 2


def test_writing_twice_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/h"
    rows = spark.createDataFrame([(s, r, s * 100 + r) for s in range(5) for r in range(8)], "s int, r int, at int")
    for _ in range(2):
        store.append_history(rows, path, "s", "r", [F.desc("at")], keep=3, buckets=4)
    assert sorted((x.s, x.r) for x in store.read(spark, path, rows.schema).collect()) == [(s, r) for s in range(5) for r in (5, 6, 7)]
    assert store.read(spark, f"{tmp_path}/none", rows.schema).count() == 0


def test_what_is_taken_out_is_gone_even_if_it_was_all(spark, tmp_path):
    path = f"{tmp_path}/r"
    rows = spark.createDataFrame([(i, str(i)) for i in range(6)], "k int, v string")
    store.remove(rows, path, ["k"], rows.schema)
    store.upsert(rows, path, ["k"], buckets=4)
    store.remove(rows.where("k < 3"), path, ["k"], rows.schema, buckets=4)
    assert sorted(r.k for r in store.read(spark, path, rows.schema).collect()) == [3, 4, 5]
    store.remove(rows, path, ["k"], rows.schema, buckets=4)
    assert store.read(spark, path, rows.schema).count() == 0
    store.upsert(rows.where("k = 1"), path, ["k"], buckets=4)
    assert [tuple(r) for r in store.read(spark, path, rows.schema).collect()] == [(1, "1")]


def test_what_was_not_found_is_asked_again(spark, tmp_path):
    asks = spark.createDataFrame([("a",), ("b",)], "k string")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
    seen = []

    def find(missing):
        seen.append(sorted(r.k for r in missing.collect()))
        return missing.where("k = 'a'").withColumn("v", F.lit(f"{len(seen)}"))

    at = F.lit("2026-01-01").cast("timestamp")
    ask = lambda now: sorted(tuple(r) for r in store.remembered(asks, f"{tmp_path}/m", "k", now, find, schema, "1 hour").collect())
    assert ask(at) == [("a", "1")] and ask(at + F.expr("INTERVAL 1 MINUTE")) == [("a", "1")]
    assert ask(at + F.expr("INTERVAL 2 HOURS")) == [("a", "3")]
    assert seen == [["a", "b"], ["b"], ["a", "b"]]


@pytest.mark.parametrize(
    ("before", "names", "value", "after"),
    [("{}", ["a"], "1", '{"a":1}'), ('{"a":5,"b":"5"}', ["a", "c"], '"x"', '{"a":{"c":"x"},"b":"5"}'), ('{"k\\"":[1,{"z":null}]}', ["n"], "{}", '{"k\\"":[1,{"z":null}],"n":{}}'), ("broken", ["a", "b"], "true", '{"a":{"b":true}}'), ("{}", [], "7", "7")],
)
def test_with_path(spark, before, names, value, after):
    [got] = spark.createDataFrame([(before,)], "j string").select(jsonpath.with_path("j", names, F.lit(value)).alias("j")).collect()
    assert got.j == after


def test_a_digit_may_follow_a_group_reference(spark):
    [got] = spark.range(1).select(text.rewrite(F.lit("ab-cd"), pattern="([a-z])([a-z])", replace="$21$1\\$").alias("t")).collect()
    assert got.t == "b1a\\$-d1c\\$"
