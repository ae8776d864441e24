import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import crypto, jsonpath, text, urls
from gleaner.plans import config, feeds
from gleaner.streaming import limiter


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "path, want",
    [
        ("data[1].title", "two"), ("data[9].title", None), ("data[type=b].title", "two"), ("data[type=z]", None), ("names.*", "first"), ("total", "50"),
        ("missing.deep", None), ("total.deep", None), ("data.title", None),
    ],
)
def test_json_path(spark, path, want):
    doc = '{"data":[{"type":"a","title":"one"},{"type":"b","title":"two"}],"names":{"z":"first","a":"second"},"total":50}'
    assert value(spark, jsonpath.path(F.lit(doc), path)) == want


def test_json_path_of_the_whole_and_of_broken_text(spark):
    assert value(spark, jsonpath.path(F.lit('{"a":1}'), "")) == '{"a":1}'
    assert value(spark, jsonpath.path(F.lit("{oops"), "a")) is None


@pytest.mark.parametrize(
    "reference, want",
    [
        ("", ""), ("https://b.net/x", "https://b.net/x"), ("//cdn.net/i", "https://cdn.net/i"), ("/m", "https://a.org/m"), ("?p=2", "https://a.org/s/t?p=2"),
        ("../c", "https://a.org/c"), ("d/./e", "https://a.org/s/d/e"), ("data:x", "data:x"), ("#f", "https://a.org/s/t?q=1#f"),
    ],
)
def test_resolve(spark, reference, want):
    assert value(spark, urls.resolve(F.lit("https://a.org/s/t?q=1"), F.lit(reference))) == want


def test_encodings(spark):
    given = "a b*c~'(é)!"
    assert value(spark, urls.encode_query(F.lit(given))) == "a+b%2Ac~%27%28%C3%A9%29%21"
    assert value(spark, urls.encode_component(F.lit(given))) == "a%20b*c~'(%C3%A9)!"


def test_rewrites(spark):
    assert value(spark, text.rewrite(F.lit("a.b.c"), find=".", replace="$1")) == "a$1b$1c"
    assert value(spark, text.rewrite(F.lit("x1y2"), pattern="([a-z])([0-9])", replace="$2$1")) == "1x2y"
    assert value(spark, text.replace_first(F.lit("aXbX"), "X", "_", "!")) == "a_bX!"
    assert value(spark, text.replace_first(F.lit("ab"), "X", "_", "!")) == "ab!"
    assert value(spark, text.expand_groups(F.lit("k=7"), "k=(\\d)", "<$1$2>")) == "<7>"
    assert value(spark, text.capture(F.lit("a\nb"), "a(.)b")) == "\n"
    assert value(spark, text.capture(F.lit("ab"), "ab")) == ""


def test_substitution_and_templates_differ(spark):
    later = {"a": F.lit("{b}"), "b": F.lit("x")}
    assert value(spark, text.substitute("{a}{c}", later)) == "x{c}"
    assert value(spark, text.render("{a}", later)) == "{b}"
    assert value(spark, text.render("{a}{c}", later)) is None


@pytest.mark.parametrize(
    "given, want",
    [
        ("1700000000", dt.datetime(2023, 11, 14, 22, 13, 20)), ("1700000000000", dt.datetime(2023, 11, 14, 22, 13, 20)),
        ("2024-01-05T06:00:00+02:00", dt.datetime(2024, 1, 5, 4)), ("2 days ago", None), ("", None),
    ],
)
def test_source_date(spark, given, want):
    assert value(spark, text.source_date(F.lit(given)).cast("timestamp_ntz")) == want


@pytest.mark.parametrize("given, want", [(None, False), ("", False), ("0", False), ("false", False), ("[]", True), ("x", True), ("0.0", False)])
def test_truthy(spark, given, want):
    assert value(spark, text.truthy(F.lit(given).cast("string"))) is want


def test_generated_never_cuts_numbers(spark):
    assert value(spark, text.generated(F.lit(3), "{n}", start=99, pad=2)) == ["99", "100", "101"]
    assert value(spark, text.generated(F.lit(0), "{n}")) == []


def test_envelope_failures_are_empty(spark):
    assert value(spark, crypto.decrypt_envelope(F.lit('{"ct":"AAAA","iv":"00","s":"00"}'), "p")) == ""
    assert value(spark, crypto.decrypt_envelope(F.lit("no json"), "p")) == ""


def test_empty_parameters_are_dropped_by_name(spark):
    assert value(spark, urls.drop_empty_params(F.lit("http://a/?q=&p=&p=1#f"))) == "http://a/?p=&p=1#f"
    assert value(spark, urls.drop_empty_params(F.lit("http://a/?q="))) == "http://a/"


def test_offsets(spark):
    at = lambda total: value(spark, feeds.offsets(F.lit(total).cast("int"), 400))
    assert at(900) == [0, 400, 800]
    assert at(None) == [0, 400, 800]
    assert at(0) == []
    assert len(at(50_000)) == 25


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=40), st.integers(1, 4), st.integers(1, 60))
def test_admissions_keep_the_rate(arrivals, requests, period):
    arrivals = sorted(arrivals)
    out, _ = limiter.admit(arrivals, [], requests, period)
    assert out == sorted(out) and all(o >= a for o, a in zip(out, arrivals, strict=True))
    assert all(b - a >= period for a, b in zip(out, out[requests:], strict=False))
    half = len(arrivals) // 2
    first, state = limiter.admit(arrivals[:half], [], requests, period)
    assert first + limiter.admit(arrivals[half:], state, requests, period)[0] == out


def test_configuration_round_trip_and_lint():
    data = {"id": "a", "name": "A", "baseUrl": "http://a", "popular": {"path": "/p", "itemSelector": "li > a"}}
    assert config.Source.from_json(data | {"odd": 1}).to_json() == data
    assert config.Source.from_json(data).listing().url_attr == "href"
    with pytest.raises(KeyError):
        config.Source.from_json({"id": "a"})
    assert config.lint(data) == []
    found = config.lint(data | {"odd": 1, "chapters": {"itemSelector": "a:has(b)"}})
    assert len(found) == 2


def test_rate_limited_stream_equals_batch(spark, tmp_path):
    rows = [(k, 10 * i + k, i) for i in range(30) for k in (1, 2)]
    frame = spark.createDataFrame(rows, "source long, arrived_ms long, request_id long")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = limiter.rate_limited_stream(stream, "source", 3, 100).writeStream.format("memory").queryName("admitted").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("admitted").collect())) == sorted(map(tuple, limiter.rate_limited(frame, "source", 3, 100).collect()))


def test_first_value_then_index(spark):
    rows = spark.createDataFrame([('{"a":[7,8],"b":[9]}',), ("[[1,2],[3]]",), ('{"a":{"c":5}}',)], "j string")
    found = rows.select(jsonpath.path("j", "*[0]").alias("x"), jsonpath.path("j", "*.c").alias("y"), jsonpath.path("j", "a[0").alias("z")).collect()
    assert [tuple(r) for r in found] == [("7", None, None), ("1", None, None), (None, "5", None)]


def test_plain_text_decodes_only_markup(spark):
    given = ["a &amp; b", "<p>caf&eacute; &#233;&#xe9; &amp;lt; &#0;</p><p>x</p>", "1 < 2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", text.plain_text("t").alias("p"))
    assert [r["p"] for r in rows.orderBy("i").collect()] == ["a &amp; b", "café éé &lt; �\nx", "1 < 2"]


def test_schedules_go_from_batch_to_batch(spark):
    rows = [(k, 10 * i, 100 * k + i, 25) for k in (1, 2) for i in range(40)]
    given = spark.createDataFrame(rows, "k long, arrived_ms long, request_id long, took_ms long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for n in ("7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            frames = limiter.rate_limited(given, "k", 2, 100), limiter.gated(given, "k", 2)
            found.append([sorted(tuple(r) for r in f.collect()) for f in frames])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1]
    assert [r[3] for r in found[0][0][:5]] == [0, 10, 100, 110, 200]
    assert [r[3] for r in found[0][1][:5]] == [0, 10, 25, 35, 50]
