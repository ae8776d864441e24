"""Queries over what is kept between runs, and over answers that were fetched more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import jsonpath
from gleaner.plans import adapters
from gleaner.q_adapters import SITE, _string, _text
from gleaner.q_steps import _known, table
from gleaner.sources import responses, store

QUERIES: dict = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _new_store(spark, name):
    return f"{store.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fetches(spark, sf_dir):
    """Events as answers to their user's requests of a type: 200 for most, 503 and 429 for some, a lost connection for others."""
    kind = F.col("event_id") % 5
    status = F.when(kind == 0, 503).when(kind == 1, 429).when(kind == 2, F.lit(None).cast("int")).when(F.col("event_id") % 11 == 0, 404).otherwise(200)
    body = F.when(status == 200, _string("event_id")).otherwise(_text("busy ", _string("event_id")))
    key = [F.lit("GET").alias("method"), _text("/", F.col("event_type"), "/", (F.col("user_id") % 50).cast("string")).alias("url"), F.lit("").alias("body_key"), F.lit("plain").alias("transport")]
    none = F.lit(None).cast("map<string,string>")
    # Times are apart by event, so that visits are of several answers and their order is that of the events.
    at = F.timestamp_seconds(F.floor(F.col("event_id") / 40) * 3600 + F.col("event_id") % 40)
    return table(spark, sf_dir, "events").select(*key, status.alias("status"), none.alias("headers"), body.alias("body"), at.alias("fetched_at"))


_FETCHED = """WITH f AS (SELECT '/' || event_type || '/' || user_id % 50 AS url, CASE event_id % 5 WHEN 0 THEN 503 WHEN 1 THEN 429 WHEN 2 THEN NULL ELSE CASE WHEN event_id % 11 = 0 THEN 404 ELSE 200 END END AS status, event_id, event_id // 40 AS hour FROM events),
  v AS (SELECT *, row_number() OVER (PARTITION BY url, hour ORDER BY event_id) AS attempt, max(hour) OVER (PARTITION BY url) AS last FROM f WHERE {0}),
  s AS (SELECT *, least(coalesce(min(CASE WHEN status IN (200, 404) THEN attempt END) OVER w, 3), count(*) OVER w, 3) AS stop FROM v WHERE hour = last WINDOW w AS (PARTITION BY url, hour))
  SELECT url, coalesce(status, 0) AS status, CASE WHEN status = 200 THEN '' ELSE 'busy ' END || event_id AS body FROM s WHERE attempt = stop"""


@query(_FETCHED.format("true"))
def settled_attempts(spark, sf_dir):
    """One answer for each request from all that were fetched: of the last visit the first that another try would not mend, at most the third."""
    known = _fetches(spark, sf_dir)
    return responses.fetch(known.select(*responses.KEY).distinct(), known).select("url", F.coalesce("status", F.lit(0)).alias("status"), "body")


@query(_FETCHED.format("hour < (SELECT max(event_id) // 80 FROM events)"))
def answers_as_of(spark, sf_dir):
    """The same as it was in the middle of the time: later answers are not seen, and requests first made later have none."""
    known = _fetches(spark, sf_dir)
    middle = table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 80).alias("h")).first()["h"]
    found = responses.fetch(known.select(*responses.KEY).distinct(), known, as_of=F.timestamp_seconds(F.lit(middle * 3600 - 1)))
    return found.where("body IS NOT NULL").select("url", F.coalesce("status", F.lit(0)).alias("status"), "body")


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("ran_at"), F.col("event_type").alias("outcome"))


@query("SELECT user_id AS source_id, event_id AS run_id, event_type AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def history_store(spark, sf_dir):
    """Runs written in three batches, the second of them twice: the store holds each run once and the last five of a source."""
    runs, path = _runs(spark, sf_dir), _new_store(spark, "history")
    for batch in (0, 1, 1, 2):
        store.append_history(runs.where(F.col("run_id") % 3 == batch), path, "source_id", "run_id", [F.desc("ran_at")], keep=5, buckets=16)
    return store.read(spark, path, runs.schema).select("source_id", "run_id", "outcome")


@query("SELECT o_custkey AS source_id, o_orderkey AS step, o_orderstatus AS body FROM orders WHERE o_custkey % 2 = 1 OR o_orderstatus <> 'F'")
def examples_store(spark, sf_dir):
    """Examples of every customer, then those of every other customer again, without some: the latest of each customer stand."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("step"), F.col("o_orderstatus").alias("body"))
    again = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "F").alias("n"))
    path = _new_store(spark, "examples")
    store.replace_groups(rows, path, "source_id", buckets=16)
    left = rows.where("source_id % 2 = 0 AND body <> 'F'")
    # A customer all of whose orders are of that kind has a run without examples, which is an empty one.
    none = again.where("n = 0").select(F.col("o_custkey").alias("source_id"), F.lit(None).cast("bigint").alias("step"), F.lit("").alias("body"))
    for _ in range(2):
        store.replace_groups(left.unionByName(none), path, "source_id", buckets=16)
    return store.read(spark, path, rows.schema).where("step IS NOT NULL")


@query("SELECT c_custkey AS pkg, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 4 <> 0")
def uninstalled_store(spark, sf_dir):
    """Packages put in and taken out again by segment, then those of every fourth, some of which are gone already."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pkg"), F.col("c_name").alias("name"), "c_mktsegment")
    rows, path = customer.select("pkg", "name"), _new_store(spark, "uninstalled")
    store.upsert(rows, path, ["pkg"], buckets=16)
    for gone in (customer.where("c_mktsegment = 'BUILDING'"), rows.where("pkg % 4 = 0")):
        store.remove(gone, path, ["pkg"], rows.schema, buckets=16)
    return store.read(spark, path, rows.schema)


@query("SELECT c_custkey AS pkg, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer")
def installed_store(spark, sf_dir):
    """Packages put in, then every third in a newer version."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pkg"), F.col("c_name").alias("name"), F.lit(1).alias("version"))
    path = _new_store(spark, "installed")
    store.upsert(rows, path, ["pkg"], buckets=16)
    store.upsert(rows.where("pkg % 3 = 0").withColumn("version", F.lit(2)), path, ["pkg"], buckets=16)
    return store.read(spark, path, rows.schema)


@query("""SELECT r_regionkey, n_nationkey::VARCHAR AS option_id, n_name AS label, 1 AS ask FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 2
  UNION ALL SELECT r_regionkey, n_nationkey::VARCHAR, n_name, 2 FROM region JOIN nation ON n_regionkey = r_regionkey""")
def remembered_filters(spark, sf_dir):
    """Options found once are not looked for again: the second ask has answers for one region alone, which the first found nothing for."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    option = lambda s: _text('<option value="', s["n_nationkey"].cast("string"), '">', s["n_name"], "</option>")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), option), "")
    known = _known(nation.groupBy("n_regionkey").agg(listed.alias("html")), _text(SITE, "r/", _string("n_regionkey")), F.col("html"))
    asks, path = region.select("r_regionkey", _text("r/", _string("r_regionkey")).alias("url")), _new_store(spark, "filters")
    schema = T.StructType([T.StructField("r_regionkey", region.schema["r_regionkey"].dataType), T.StructField("option_id", T.StringType()), T.StructField("label", T.StringType())])
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    ask = lambda answers, now: store.remembered(asks, path, "r_regionkey", now, lambda missing: adapters.scraped_options(missing, "r_regionkey", "option", "value", answers, SITE), schema)
    first = ask(known.where(~F.col("url").endswith("/2")), at)
    second = ask(known.where(F.col("url").endswith("/2")), at + F.expr("INTERVAL 1 HOUR"))
    return first.withColumn("ask", F.lit(1)).unionByName(second.withColumn("ask", F.lit(2)))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, '{"new \\"one\\"":' || event_id || CASE WHEN event_id % 2 = 0 THEN '}' ELSE ',"z":"1"}' END AS b, CASE WHEN event_id % 2 = 1 THEN '[1.5,"x",null]' END AS c FROM events""")
def seed_patch(spark, sf_dir):
    """A value put deep into JSON text, beside what is there or into objects that are made for it."""
    props = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('{"a":{"b":{"z":"1"},"c":[1.5,"x",null]},'), F.substring("props", 2, 1 << 20)))
    seeds = table(spark, sf_dir, "events").select("event_id", props.alias("seed"))
    patched = seeds.select("event_id", jsonpath.with_path("seed", ["a", "b", 'new "one"'], _string("event_id")).alias("seed"))
    return patched.select("event_id", *[F.get_json_object("seed", at).alias(name) for name, at in (("k", "$.k"), ("b", "$.a.b"), ("c", "$.a.c"))])
