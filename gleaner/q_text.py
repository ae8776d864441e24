"""Queries over scalars, JSON and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import crypto, jsonpath, text, urls
from gleaner.sources import responses

QUERIES: dict = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", jsonpath.path("props", "k").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'n' || event_type AS first FROM events")
def json_path_filter(spark, sf_dir):
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("x").alias("type"), F.lit("no").alias("v")), F.struct(F.lit("y").alias("type"), F.get_json_object("props", "$.k").alias("v"))).alias("rel"), F.array(F.concat(F.lit("n"), F.col("event_type"))).alias("list")))
    rows = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return rows.select("event_id", jsonpath.path("doc", "rel[type=y].v").alias("k"), jsonpath.path("doc", "list[0]").alias("first"))


@query("SELECT event_id, event_type AS v FROM events")
def json_path_star(spark, sf_dir):
    doc = F.concat(F.lit('{"title":{"z":"'), F.col("event_type"), F.lit('","a":"other"}}'))
    return table(spark, sf_dir, "events").select("event_id", jsonpath.path(doc, "title.*").alias("v"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'none' END || '/' || p_type AS v FROM part")
def json_template(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    item = F.to_json(F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("none").alias("brand")))
    return part.select("p_partkey", jsonpath.template("{brand}/{kind}", item, root=F.to_json(F.struct(F.col("p_type").alias("kind")))).alias("v"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '-' WHEN p_size % 3 = 1 THEN '<' || p_name || '>' ELSE '<' || p_type || '>' END AS v FROM part")
def json_value_spec(spark, sf_dir):
    item = F.to_json(F.struct(F.when(F.col("p_size") % 3 == 1, F.col("p_name")).alias("a"), F.when(F.col("p_size") % 3 == 2, F.col("p_type")).alias("b")))
    return table(spark, sf_dir, "part").select("p_partkey", jsonpath.value_of(item, ["a", "b"], fill="<{value}>", default="-").alias("v"))


@query("SELECT p_partkey, p_brand || ' ' || p_type AS v FROM part")
def json_name_spec(spark, sf_dir):
    item = F.to_json(F.struct("p_brand", F.lit("").alias("none"), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", jsonpath.name_of(item, ["p_brand", "none", "missing", "p_type"]).alias("v"))


ORDER_LINES = """SELECT l_orderkey, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS parts FROM lineitem GROUP BY l_orderkey"""


def order_documents(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select("l_orderkey", F.to_json(F.struct(F.transform("lines", lambda e: F.struct(e["l_partkey"].alias("part"), e["l_linenumber"].alias("n"))).alias("data"))).alias("doc"))


@query(f"SELECT l_orderkey, array_to_string(parts, ',') AS parts FROM ({ORDER_LINES})")
def json_list_spec(spark, sf_dir):
    return order_documents(spark, sf_dir).select("l_orderkey", F.array_join(jsonpath.list_of(F.col("doc"), "data", "part"), ",").alias("parts"))


@query(f"SELECT l_orderkey, (unnest(range(len(parts))))::INT AS pos, unnest(parts) AS part FROM ({ORDER_LINES})")
def json_record_list(spark, sf_dir):
    rows = order_documents(spark, sf_dir).select("l_orderkey", F.posexplode(jsonpath.items(jsonpath.path("doc", "data"))).alias("pos", "item"))
    return rows.select("l_orderkey", "pos", jsonpath.path("item", "part").alias("part"))


@query("SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS pos, n_name AS name FROM nation")
def object_keyed(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    doc = F.concat(F.lit("{"), F.array_join(F.transform("n", lambda e: F.concat(F.lit('"'), e["n_nationkey"].cast("string"), F.lit('":{"name":"'), e["n_name"], F.lit('"}'))), ","), F.lit("}"))
    rows = nation.select("n_regionkey", F.posexplode(jsonpath.items(doc, values=True)).alias("pos", "item"))
    return rows.select("n_regionkey", "pos", jsonpath.path("item", "name").alias("name"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def nested_json(spark, sf_dir):
    twice = F.to_json(F.struct(F.to_json(F.struct(F.col("props").alias("v"))).alias("v")))
    wrapped = F.get_json_object(twice, "$.v")
    rows = table(spark, sf_dir, "events").select("event_id", F.regexp_extract(wrapped, r'^\{"v":(.*)\}$', 1).alias("doc"))
    return rows.select("event_id", jsonpath.path(jsonpath.unwrapped(F.col("doc")), "k").alias("k"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_brand ELSE '' END AS v FROM part")
def fallback_chain(spark, sf_dir):
    a, b = F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", text.first_filled(a, b).alias("v"))


@query("SELECT p_partkey, '/list/' || ((p_size - 1) * 24) || '/' || p_brand AS v FROM part")
def sequential_substitution(spark, sf_dir):
    values = {"query": F.lit("{brand}"), "brand": F.col("p_brand")} | text.page_values(F.col("p_size"), 24, F.lit("{brand}"))
    return table(spark, sf_dir, "part").select("p_partkey", text.substitute("/list/{offset}/{query}", {k: values[k] for k in ("offset", "query", "brand")}).alias("v"))


@query("""SELECT o_orderkey, CASE WHEN n > 0 THEN array_to_string(['p-' || lpad(x::VARCHAR, 3, '0') || '.jpg' FOR x IN range(1, n + 1)], ' ') ELSE '' END AS urls FROM (SELECT o_orderkey, (o_orderkey % 5)::BIGINT AS n FROM orders)""")
def generate_pages(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.generated(F.col("o_orderkey") % 5, "p-{n}.jpg", pad=3), " ").alias("urls"))


@query("SELECT o_orderkey, o_orderdate AS d, make_timestamp(o_orderkey * 1000000) AS e FROM orders")
def source_date(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.source_date(iso).cast("timestamp_ntz").alias("d"), text.source_date(F.col("o_orderkey").cast("string")).cast("timestamp_ntz").alias("e"))


@query("SELECT event_id, NOT (json_extract_string(props, '$.k') IN ('0')) AS t FROM events")
def truthy(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.truthy(jsonpath.path("props", "k")).alias("t"))


@query("SELECT event_id, trunc(value)::BIGINT AS n FROM events")
def lenient_int(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.lenient_int(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("n"))


@query("SELECT p_partkey, regexp_extract(p_brand, '(\\d+)', 1)::INT AS n FROM part")
def first_digits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.first_digits("p_brand").alias("n"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ongoing' ELSE 'unknown' END AS s FROM orders")
def status_map(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.status(F.concat(F.lit(" "), F.lower("o_orderstatus")), {"F": "completed", "O": "ongoing"}).alias("s"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS version FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash("text").alias("version"))


@query("SELECT c_custkey, 'customer-' || lpad(c_custkey::VARCHAR, 9, '0') AS slug FROM customer")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug("c_name").alias("slug"))


@query("SELECT p_partkey, replace(p_name, ' ', '+') || '%26%21' AS q, replace(p_name, ' ', '%20') || '%26!' AS c FROM part")
def url_encoding(spark, sf_dir):
    given = F.concat(F.col("p_name"), F.lit("&!"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.encode_query(given).alias("q"), urls.encode_component(given).alias("c"))


@query("SELECT p_partkey, 'a, b' AS v FROM part")
def tidy_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.tidy(F.lit("  a,\n  b ; ")).alias("v"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'included' WHEN 1 THEN 'excluded' ELSE 'off' END AS state FROM part")
def tri_state(spark, sf_dir):
    now = F.when(F.col("p_size") % 3 == 0, "off").when(F.col("p_size") % 3 == 1, "included").otherwise("excluded")
    return table(spark, sf_dir, "part").select("p_partkey", text.tri_state(now).alias("state"))


@query("SELECT n_nationkey, 'plain ' || n_name AS txt FROM nation")
def decrypt_envelope(spark, sf_dir):
    """Envelopes are sealed here with Spark's own encryption, so the query is a round trip."""
    salt, iv = F.unhex(F.substring(F.md5("n_name"), 1, 16)), F.unhex(F.md5(F.concat(F.col("n_name"), F.lit("iv"))))
    sealed = F.aes_encrypt(F.encode(F.concat(F.lit("plain "), F.col("n_name")), "UTF-8"), crypto.key_of(F.lit("pass"), salt), F.lit("CBC"), F.lit("PKCS"), iv)
    ct = F.base64(F.substring(sealed, 17, 1 << 20))
    doc = F.to_json(F.struct(ct.alias("ct"), F.lower(F.hex(iv)).alias("iv"), F.lower(F.hex(salt)).alias("s")))
    return table(spark, sf_dir, "nation").select("n_nationkey", crypto.decrypt_envelope(doc, "pass").alias("txt"))


@query("SELECT n_nationkey, 'b' AS accept, n_name AS agent FROM nation")
def header_layers(spark, sf_dir):
    layers = responses.layered({"accept": "a", "agent": "x"}, F.create_map(F.lit("agent"), F.col("n_name")), {"accept": "b"})
    return table(spark, sf_dir, "nation").select("n_nationkey", layers["accept"].alias("accept"), layers["agent"].alias("agent"))


@query("""SELECT p_partkey, trim(regexp_replace(p_name, ' +', ' ', 'g')) || CASE WHEN p_size % 3 = 0 THEN ',' ELSE '' END || ' x' || CASE WHEN p_size % 3 = 2 THEN ';' ELSE '' END AS v FROM part""")
def tidy_texts(spark, sf_dir):
    """White space of all kinds as one blank, and one closing comma or semicolon gone, of two the last."""
    space = F.when(F.col("p_size") % 2 == 0, "\n\t ").otherwise("\u00a0\u2003")
    middle = F.when(F.col("p_size") % 3 == 0, ",").otherwise("")
    end = F.when(F.col("p_size") % 3 == 2, ";,").when(F.col("p_size") % 3 == 1, ",").otherwise("")
    whole = F.concat(space, F.regexp_replace("p_name", " ", F.lit(" \n ")), middle, space, F.lit("x"), end, space)
    return table(spark, sf_dir, "part").select("p_partkey", text.tidy(whole).alias("v"))
