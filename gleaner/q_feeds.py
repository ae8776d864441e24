"""Queries over listings, chapters, probes, requests and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import extract
from gleaner.plans import feeds
from gleaner.sources import responses
from gleaner.streaming import limiter

QUERIES: dict = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT p_brand, p_partkey, (rn - 11)::INT AS pos, n > 20 AS has_next FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rn BETWEEN 11 AND 20""")
def catalog_page(spark, sf_dir):
    return feeds.catalog_page(table(spark, sf_dir, "part"), ["p_brand"], ["p_name", "p_partkey"], page=2, page_size=10).select("p_brand", "p_partkey", "pos", "has_next")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 10 < 200 WHEN p_size % 3 = 1 THEN p_size >= 10 ELSE p_size % 2 = 0 END AS has_next FROM part")
def has_next(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_size") % 3
    found = feeds.has_next(F.when(kind == 0, F.lit("200")), size, F.lit(10), F.when(size % 2 == 0, "1").otherwise(""), size, kind == 2)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("has_next"))


@query("""SELECT conv_id, (n - rn)::INT AS pos, CASE WHEN role = 'assistant' THEN 'Chapter ' || rn ELSE role END AS name FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def chapters_reversed(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("name", F.when(F.col("role") != "assistant", F.col("role")).otherwise(""))
    return feeds.chapters(rows, "conv_id", ["turn"], url="text").select("conv_id", "pos", "name")


@query("SELECT conv_id, unnest(range(0, least(n, 10000), 3)) AS at FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def api_chapter_feed(spark, sf_dir):
    totals = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return totals.select("conv_id", F.explode(feeds.offsets(F.col("n"), 3)).alias("at"))


@query("""WITH RECURSIVE r AS (SELECT conv_id || '/' || turn AS origin, conv_id || '/' || turn AS url, conv_id, turn, 1 AS page FROM conversations WHERE turn = 0
  UNION ALL SELECT origin, c.conv_id || '/' || c.turn, c.conv_id, c.turn, page + 1 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1 WHERE page < 50) SELECT origin, url, page FROM r""")
def paginate_recursive(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    at = lambda c, t: F.concat(c.cast("string"), F.lit("/"), t.cast("string"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), at(F.col("conv_id"), F.col("turn")).alias("next"))
    known = turns.join(after, ["conv_id", "turn"], "left").select(at(F.col("conv_id"), F.col("turn")).alias("url"), F.coalesce("next", F.lit("")).alias("next"))
    return feeds.follow(turns.where("turn = 0").select(at(F.col("conv_id"), F.col("turn")).alias("url")), known)


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def dependent_fetch(spark, sf_dir):
    """Orders ask for their customer's page, what that captures asks for the nation's."""
    url = lambda kind, k: F.concat(F.lit(f"/{kind}/"), F.col(k).cast("string"))
    page = lambda df, kind, k, *fields: df.select(F.lit("GET").alias("method"), url(kind, k).alias("url"), F.lit("").alias("body_key"), F.lit("plain").alias("transport"), F.lit(200).alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), F.to_json(F.struct(*fields)).alias("body"))
    known = page(table(spark, sf_dir, "customer"), "c", "c_custkey", "c_name", "c_nationkey").unionByName(page(table(spark, sf_dir, "nation"), "n", "n_nationkey", "n_name"))
    first = responses.fetch(responses.request(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), url("c", "o_custkey")), known)
    captured = first.where("status = 200").select("o_orderkey", F.get_json_object("body", "$.c_name").alias("c_name"), F.get_json_object("body", "$.c_nationkey").alias("nation"))
    second = responses.fetch(responses.request(captured, url("n", "nation")), known)
    return second.where("status = 200").select("o_orderkey", "c_name", F.get_json_object("body", "$.n_name").alias("n_name"))


@query("SELECT DISTINCT '/' || event_type || '?k=' || json_extract_string(props, '$.k') AS url FROM events")
def shared_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("/"), F.col("event_type"), F.lit("?k="), F.get_json_object("props", "$.k")).alias("url"), F.lit("plain").alias("transport"), F.create_map(F.lit("A"), F.lit("1"), F.lit("b"), F.lit("2")).alias("headers"))
    return responses.shared_requests(rows).select("url")


@query("""SELECT user_id, strftime(hour, '%Y-%m-%d %H') AS hour FROM (SELECT user_id, date_trunc('hour', ts) AS hour, list(DISTINCT event_type) AS tags FROM events GROUP BY ALL) WHERE list_has_all(tags, ['click', 'view']) AND NOT list_has_any(tags, ['error'])""")
def tag_browse(spark, sf_dir):
    tags = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.collect_set("event_type").alias("tags"))
    return tags.where(feeds.tagged(F.col("tags"), ["click", "view"], ["error"])).select("user_id", "hour")


@query("""SELECT group_id, (row_number() OVER (ORDER BY CASE WHEN group_id = 'r2' THEN 0 ELSE 1 END, seen, group_id))::INT AS group_pos, options FROM (SELECT 'r' || n_regionkey AS group_id, min(n_nationkey) AS seen, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_name, n_nationkey::VARCHAR) AS options FROM nation GROUP BY ALL HAVING true)""".replace(" GROUP BY ALL HAVING true", " GROUP BY n_regionkey"))
def filter_groups(spark, sf_dir):
    options = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("group_id"), F.col("n_nationkey").cast("string").alias("option_id"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("seen"))
    return feeds.filter_groups(options, ["r2"]).withColumn("options", F.array_join("options", ","))


@query("""SELECT c_nationkey, c_custkey, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM (SELECT c_nationkey, c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL)) WHERE rn <= 5 AND n > 0) WHERE k = 1""")
def first_candidate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    customers = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_nationkey", "c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
    return feeds.first_candidate(customers, "c_nationkey", "c_custkey", "n")


@query("""SELECT c_custkey, CASE WHEN n = 0 THEN 'chapters' ELSE NULL END AS failed_stage, CASE WHEN n > 0 THEN list_distinct([0, n // 2, n - 1]) ELSE [] END AS n_positions FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""".replace("list_distinct([0, n // 2, n - 1])", "len(list_distinct([0, n // 2, n - 1]))").replace("ELSE [] END", "ELSE 0 END"))
def probe_funnel(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("int"))
    status = feeds.probe_status([("popular", F.lit(1)), ("chapters", F.col("n"))])
    return rows.select("c_custkey", status.alias("failed_stage"), F.size(feeds.sample_positions(F.col("n"))).cast("long").alias("n_positions"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50")
def history_topk(spark, sf_dir):
    return feeds.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn > 50")
def retention_anti(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kept = feeds.latest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 50)
    return events.join(kept.select("event_id"), "event_id", "left_anti").select("event_id")


@query("SELECT key, min_by(name, o) AS name FROM (SELECT c_custkey AS key, c_name AS name, 0 AS o FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) GROUP BY key")
def union_distinct_sources(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return feeds.first_of_each([customers, suppliers], "key")


@query("""SELECT p_partkey, CASE WHEN n > 1 OR src LIKE 'data:%' OR src = '' THEN p_name ELSE src END AS image FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, src) AS n FROM (SELECT *, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'data:x' ELSE p_type || p_size END AS src FROM part))""")
def lazy_image_placeholder(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").withColumn("src", F.when(size % 4 == 0, "").when(size % 4 == 1, "data:x").otherwise(F.concat("p_type", size.cast("string"))))
    return rows.select("p_partkey", extract.lazy_source(F.col("src"), F.col("p_name"), "p_brand").alias("image"))


@query("SELECT 'p' || p_partkey AS pkg, p_name AS name, substr(sha256(p_name || p_brand), 1, 16) AS version FROM part")
def index_build(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("pkg"), F.col("p_name").alias("name"), F.concat("p_name", "p_brand").alias("content"))
    return responses.build_index(entries).select("pkg", "name", "version")


@query("SELECT p_partkey, p_name AS title FROM part WHERE p_size % 2 = 1")
def complete_items(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).alias("url"))
    return feeds.complete(rows).select("p_partkey", "title")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS a, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
  r AS (SELECT user_id, event_id, rn, a AS t1, a AS t2, 1 AS c FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.rn, greatest(e.a, r.t1, CASE WHEN r.c >= 2 THEN r.t2 + 3600000 ELSE 0 END), r.t1, 2 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
  SELECT user_id, event_id AS request_id, t1::BIGINT AS admitted_ms FROM r""")
def rate_limit_schedule(spark, sf_dir):
    arrivals = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrived_ms"), F.col("event_id").alias("request_id"))
    return limiter.rate_limited(arrivals, "user_id", 2, 3_600_000).select("user_id", "request_id", "admitted_ms")


@query()
def concurrency_schedule(spark, sf_dir):
    arrivals = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrived_ms"), F.col("event_id").alias("request_id"), F.lit(60_000).cast("long").alias("took_ms"))
    return limiter.gated(arrivals, "user_id", 3)


@query("SELECT p_type, string_agg(p_brand, '|' ORDER BY p_brand) AS brands FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_brand <> '') GROUP BY p_type")
def joined_values(spark, sf_dir):
    brands = table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("b"))
    return brands.select("p_type", text.first_filled(F.array_join("b", "|")).alias("brands"))
