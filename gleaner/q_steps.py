"""Queries that run whole pipelines of steps over captured responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import crypto
from gleaner.plans import steps
from gleaner.plans.steps import Decrypt, Locator, Output, Pagination, Script, Step, Transform

QUERIES: dict = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _known(df, url, body, sent=None):
    """Captured plain GET responses, or those of POST with the hash of what was sent."""
    none = F.lit(None).cast("map<string,string>")
    return df.select(F.lit("GET" if sent is None else "POST").alias("method"), url.alias("url"), (F.lit("") if sent is None else sent).alias("body_key"), F.lit("plain").alias("transport"), F.lit(200).alias("status"), none.alias("headers"), body.alias("body"))


def _runs(df, key, name):
    return df.select(key, F.create_map(F.lit(name), F.col(key).cast("string")).alias("vars"))


@query("SELECT n_nationkey, (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1)::INT AS pos, s_name AS title, '/s/' || s_suppkey AS url, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def pipeline_records(spark, sf_dir):
    """Two requests: a nation's page names its region's page; that is captured, and the nation's suppliers are the records."""
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    own = F.array_sort(F.collect_list(F.when(F.col("s_suppkey").isNotNull(), F.struct("s_suppkey", "s_name"))))
    listed = nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg(own.alias("data"))
    site = F.lit("http://x.test/")
    nations = _known(listed, F.concat(site, F.lit("n/"), F.col("n_nationkey").cast("string")), F.to_json(F.struct("n_regionkey", "data")))
    regions = _known(region, F.concat(site, F.lit("r/"), F.col("r_regionkey").cast("string")), F.to_json(F.struct("r_name")))
    fields = {"title": Locator(path="s_name"), "url": Locator(path="s_suppkey", template="/s/{value}")}
    first = Step(url="n/{nation}", parse="json", capture={"region_key": Locator(path="n_regionkey")})
    second = Step(url="r/{region_key}", parse="json", capture={"region": Locator(path="r_name")})
    third = Step(url="n/{nation}", parse="json", output=Output(Locator(path="data"), fields))
    known, runs = nations.unionByName(regions), _runs(nation, "n_nationkey", "nation")
    captured = steps.run_body(runs, "n_nationkey", [first, second], known, "http://x.test/")
    records = steps.run(captured, "n_nationkey", [third], known, "http://x.test/")
    return records.join(captured.select("n_nationkey", F.element_at("vars", F.lit("region")).alias("region")), "n_nationkey")


_LINKS = """SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS url, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS name,
  unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">'))))::INT AS pos, regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS track FROM pages"""


@query(f"SELECT page_id, pos, trim(name) AS title, url, track FROM ({_LINKS})")
def pipeline_listing(spark, sf_dir):
    """A listing described in short, over captured pages, with a capture by pattern beside it."""
    pages = table(spark, sf_dir, "pages")
    url = F.concat(F.lit("http://x.test/p/"), F.col("page_id").cast("string"))
    known, runs = _known(pages, url, F.col("html")), _runs(pages, "page_id", "page")
    [step] = steps.listing_steps({"path": "/p/{page}", "itemSelector": "nav ul > li > a", "urlAttr": "href"})
    found = steps.run(runs, "page_id", [step], known, "http://x.test/")
    told = steps.run_body(runs, "page_id", [Step(url="/p/{page}", capture={"track": Locator(regex=r"track\(([0-9]+)\)")})], known, "http://x.test/")
    return found.join(told.select("page_id", F.element_at("vars", F.lit("track")).alias("track")), "page_id")


@query("SELECT p_partkey, i::INT AS pos, '/img/' || p_brand || '-' || i AS value FROM part, range(3) AS r(i)")
def pipeline_script_pages(spark, sf_dir):
    """Page images from a JSON list inside a script; for every other part the script is inlined as base64."""
    images = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(F.col("p_brand"), F.lit("-"), i.cast("string")).alias("u"))).alias("images")))
    script = F.concat(F.lit("reader.run("), images, F.lit(");"))
    inlined = F.concat(F.lit('<script src="data:text/javascript;base64,'), F.regexp_replace(F.base64(script), r"\s", ""), F.lit('"></script>'))
    body = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<script>"), script, F.lit("</script>"))).otherwise(inlined)
    parts = table(spark, sf_dir, "part")
    known = _known(parts, F.concat(F.lit("http://x.test/c/"), F.col("p_partkey").cast("string")), body)
    wanted = steps.pages_steps({"url": "/c/{part}", "scriptRegex": r"reader\.run\((\{.*?\})\)", "path": "images", "valuePath": "u", "template": "/img/{value}"})
    return steps.run(_runs(parts, "p_partkey", "part"), "p_partkey", wanted, known, "http://x.test/")


@query(f"SELECT page_id, pos, url AS value FROM ({_LINKS})")
def pipeline_html_in_json(spark, sf_dir):
    """A fragment inside a JSON envelope, read as a flat list of links."""
    pages = table(spark, sf_dir, "pages")
    known = _known(pages, F.concat(F.lit("http://x.test/j/"), F.col("page_id").cast("string")), F.to_json(F.struct(F.struct("html").alias("data"))))
    step = Step(url="j/{page}", parse="jsonHtml", html_from="data.html", output=Output(Locator(selector="nav ul > li > a"), {"value": Locator(attr="href")}))
    return steps.run(_runs(pages, "page_id", "page"), "page_id", [step], known, "http://x.test/")


def _site(kind, key):
    return F.concat(F.lit(f"http://x.test/{kind}/"), F.col(key).cast("string"))


@query("SELECT p_partkey, i::INT AS pos, '/' || p_partkey || '/' || p_brand || '/p' || lpad((i + 3)::VARCHAR, 3, '0') || '.jpg' AS value FROM part, range(4) AS r(i) WHERE i < p_size % 5")
def pipeline_generate(spark, sf_dir):
    """Pages made from a count, by a pattern over the raw body for every other part, by a JSON path for the rest; a count that is none makes no page."""
    parts = table(spark, sf_dir, "part")
    n = F.when(F.col("p_size") % 5 < 4, (F.col("p_size") % 5).cast("string")).otherwise(F.lit("4"))
    script = F.concat(F.lit("<script>go({total: "), n, F.lit(", of: '"), F.col("p_brand"), F.lit("'})</script>"))
    body = F.when(F.col("p_partkey") % 2 == 0, script).otherwise(F.to_json(F.struct(F.struct(n.alias("n")).alias("chapter"), F.col("p_brand").alias("of"))))
    known = _known(parts, _site("c", "p_partkey"), body)
    value = {"value": Locator(template="/{part}/{of}/p{n}.jpg")}
    even = [Step(url="/c/{part}", capture={"of": Locator(regex=r"of: '([^']*)'")}), Step(output=Output(fields=value, count=Locator(regex=r"total: ([0-9]+)"), start=3, pad=3))]
    odd = [Step(url="/c/{part}", parse="json", capture={"of": Locator(path="of")}), Step(parse="json", output=Output(fields=value, count=Locator(path="chapter.n"), start=3, pad=3))]
    runs = _runs(parts, "p_partkey", "part")
    split = [steps.run(runs.where(F.col("p_partkey") % 2 == i), "p_partkey", at, known, "http://x.test/") for i, at in enumerate((even, odd))]
    return split[0].unionByName(split[1])


@query("SELECT n_nationkey, i::INT AS pos, n_name || '-' || i AS value FROM nation, range(2) AS r(i)")
def pipeline_decrypt(spark, sf_dir):
    """A captured envelope, opened with a captured password; its plain text, JSON in a JSON string, is read like a body."""
    nation = table(spark, sf_dir, "nation")
    salt, iv = F.unhex(F.substring(F.md5("n_name"), 1, 16)), F.unhex(F.md5(F.concat(F.col("n_name"), F.lit("iv"))))
    plain = F.to_json(F.array(F.to_json(F.array(*[F.concat("n_name", F.lit(f"-{i}")) for i in range(2)]))))
    plain = F.regexp_extract(plain, r"(?s)^\[(.*)\]$", 1)
    sealed = F.aes_encrypt(F.encode(plain, "UTF-8"), crypto.key_of(F.concat(F.lit("pass"), F.col("n_regionkey").cast("string")), salt), F.lit("CBC"), F.lit("PKCS"), iv)
    envelope = F.to_json(F.struct(F.base64(F.substring(sealed, 17, 1 << 20)).alias("ct"), F.lower(F.hex(iv)).alias("iv"), F.lower(F.hex(salt)).alias("s")))
    html = F.concat(F.lit("<script>var key='pass"), F.col("n_regionkey").cast("string"), F.lit("'; var blob="), envelope, F.lit(";</script>"))
    known = _known(nation, _site("n", "n_nationkey"), html)
    seen = Step(url="/n/{nation}", capture={"blob": Locator(regex=r"blob=(\{.*?\});"), "key": Locator(regex="key='([^']*)'")})
    opened = Step(decrypt=Decrypt("{blob}", "{key}"), parse="json", output=Output(fields={"value": Locator()}))
    return steps.run(_runs(nation, "n_nationkey", "nation"), "n_nationkey", [seen, opened], known, "http://x.test/")


@query("""SELECT c_custkey, 0 AS pos, 'c/' || c_custkey || '/' || replace(c_name, 'Customer#', 'No ') AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none of ' || c_custkey END AS url, CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '' END AS flag,
  'json' AS kind FROM customer UNION ALL SELECT c_custkey, 0, 'c/' || c_custkey || '/' || replace(c_name, 'Customer#', 'No '), CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none of ' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '' END, 'html' FROM customer""")
def pipeline_templates(spark, sf_dir):
    """Templates over run variables, rewrites, fallbacks and presence, the same over JSON and over markup."""
    customer = table(spark, sf_dir, "customer")
    segment, flag = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, F.lit("x"))
    listed = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("t"), segment.alias("s"), flag.alias("f"))).alias("data"), F.struct(F.lit("none").alias("s")).alias("root")))
    item = F.concat(F.lit("<li><b> "), F.col("c_name"), F.lit("</b>"), F.when(segment.isNotNull(), F.concat(F.lit("<i>"), segment, F.lit("</i>"))).otherwise(""), F.when(flag.isNotNull(), "<u></u>").otherwise(""), F.lit("<s>none</s></li>"))
    known = _known(customer, _site("j", "c_custkey"), listed).unionByName(_known(customer, _site("h", "c_custkey"), item))
    rewrite = ("", "^Customer#", "No ")
    spelled = ("", "Customer#", "No ")
    json = {"title": Locator(path="t", template="c/{id}/{value}", rewrite=spelled), "url": Locator(path="s", otherwise=(Locator(path="t", template="{root.s} of {id}"),)), "flag": Locator(path="f", exists=True)}
    html = {"title": Locator(selector="b", template="c/{id}/{value}", rewrite=spelled), "url": Locator(selector="i", otherwise=(Locator(selector="s", rewrite=rewrite, template="{value} of {id}"),)), "flag": Locator(selector="u", exists=True)}
    runs = _runs(customer, "c_custkey", "id")
    first = steps.run(runs, "c_custkey", [Step(url="/j/{id}", parse="json", output=Output(Locator(path="data"), json))], known, "http://x.test/")
    second = steps.run(runs, "c_custkey", [Step(url="/h/{id}", output=Output(Locator(selector="li"), html))], known, "http://x.test/")
    return first.withColumn("kind", F.lit("json")).unionByName(second.withColumn("kind", F.lit("html")))


@query("SELECT p_partkey, 0 AS pos, p_brand AS value FROM part WHERE p_size % 3 <> 2")
def pipeline_bad_scripts(spark, sf_dir):
    """Inlined scripts that are no base64, or no text, are skipped; a page that has only such ones gives nothing and harms no other."""
    parts = table(spark, sf_dir, "part")
    inlined = lambda text: F.concat(F.lit('<script src="data:text/javascript;base64,'), text, F.lit('"></script>'))
    good = F.regexp_replace(F.base64(F.concat(F.lit('go({"a":["'), F.col("p_brand"), F.lit('"]})'))), r"\s", "")
    bad = F.concat(inlined(F.lit("A")), inlined(F.lit("/w==")))
    body = F.when(F.col("p_size") % 3 == 0, F.concat(bad, inlined(good))).when(F.col("p_size") % 3 == 1, F.concat(inlined(good), bad)).otherwise(bad)
    known = _known(parts, _site("c", "p_partkey"), body)
    step = Step(url="/c/{part}", parse="regexJson", regex=r"go\((\{.*?\})\)", output=Output(Locator(path="a"), {"value": Locator()}))
    return steps.run(_runs(parts, "p_partkey", "part"), "p_partkey", [step], known, "http://x.test/")


@query("""SELECT o_orderkey, 0 AS step, 'GET' AS method, 'http://x.test/c/' || o_custkey AS url, 'nation=' || CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS captured, false AS terminal, least(length(c_name) * 30, 501) AS seen FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT o_orderkey, 1, 'POST', 'http://x.test/n', '', true, 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 <> 0""")
def pipeline_trace(spark, sf_dir):
    """What each step asked, captured and saw: orders ask for their customer, what that captures is posted; those that capture nothing are not answered."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    page = F.concat(F.repeat("c_name", 30), F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("<b>"), F.col("c_nationkey").cast("string"), F.lit("</b>"))).otherwise(""))
    known = _known(customer, _site("c", "c_custkey"), F.concat(F.lit("  "), page))
    posted = table(spark, sf_dir, "nation").select(F.lit("POST").alias("method"), F.lit("http://x.test/n").alias("url"), F.sha2(F.concat(F.lit("n="), F.col("n_nationkey").cast("string")), 256).alias("body_key"), F.lit("plain").alias("transport"), F.lit(200).alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit("y").alias("body"))
    runs = orders.select("o_orderkey", F.create_map(F.lit("k"), F.col("o_custkey").cast("string")).alias("vars"))
    at = [Step(url="/c/{k}", capture={"nation": Locator(selector="b")}), Step(url="/n", method="post", body="n={nation}", output=Output(Locator(selector="p"), {"value": Locator()}))]
    told = steps.trace(runs, "o_orderkey", at, known.unionByName(posted), "http://x.test/")
    captured = F.array_join(F.transform(F.map_entries("captured"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    seen = F.when(F.col("step") == 0, F.least(F.length(F.regexp_replace("preview", "<b>.*", "")), F.lit(501))).otherwise(F.length("preview"))
    return told.select("o_orderkey", "step", "method", "url", captured.alias("captured"), "terminal", seen.cast("long").alias("seen"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k') END AS k, event_id % 4 = 0 AS malformed FROM events")
def pipeline_json(spark, sf_dir):
    """Bodies as VARIANT; where the query is lenient a malformed one has a null root, as has a path that is not there."""
    events = table(spark, sf_dir, "events")
    body = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    found = steps.run_json(_runs(events, "event_id", "e"), "event_id", [Step(url="/e/{e}", parse="json")], _known(events, _site("e", "event_id"), body), "http://x.test/", strict=False)
    return found.select("event_id", F.try_variant_get("root", "$.k", "string").alias("k"), F.col("root").isNull().alias("malformed"))


@query("""SELECT s_suppkey, 'http://x.test/a/' || s_suppkey || '.html' AS request, 'x=' || s_suppkey || '&y=7' AS sent, s_name AS value, 0 AS pos FROM supplier""")
def pipeline_transform(spark, sf_dir):
    """A request made from an address: its first match replaced, a suffix, a body with the match's groups, an id found before and escaped, one read from a variable."""
    supplier = table(spark, sf_dir, "supplier")
    first = _known(supplier, _site("s", "s_suppkey"), F.concat(F.lit("<b data-id='"), F.col("s_suppkey").cast("string"), F.lit("&y=7'>x</b>")))
    answer = supplier.select(F.lit("POST").alias("method"), F.concat(_site("a", "s_suppkey"), F.lit(".html")).alias("url"), F.sha2(F.concat(F.lit("x="), F.col("s_suppkey").cast("string"), F.lit("&y=7")), 256).alias("body_key"), F.lit("plain").alias("transport"), F.lit(200).alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), F.concat(F.lit("<i>"), F.col("s_name"), F.lit("</i>")).alias("body"))
    runs = supplier.select("s_suppkey", F.create_map(F.lit("page"), F.concat(F.lit("/s/"), F.col("s_suppkey").cast("string"))).alias("vars"))
    seen = Step(base="page", capture={"id": Locator(selector="b", attr="data-id")})
    made = Step(base="page", method="POST", transform=Transform(r"/s/(\d+)$", "/a/$1", ".html", body="x={id}"), output=Output(Locator(selector="i"), {"value": Locator()}))
    told = steps.trace(runs, "s_suppkey", [seen, made], first.unionByName(answer), "http://x.test/").where("step = 1")
    found = steps.run(runs, "s_suppkey", [seen, made], first.unionByName(answer), "http://x.test/")
    sent = F.concat(F.lit("x="), F.col("s_suppkey").cast("string"), F.lit("&y=7"))
    return found.join(told.select("s_suppkey", F.col("url").alias("request")), "s_suppkey").withColumn("sent", sent)


@query("""SELECT conv_id, turn::INT + 1 AS page, role AS value, 0 AS pos, upper('c' || conv_id) AS token FROM conversations""")
def pipeline_paged(spark, sf_dir):
    """Every turn a page of its own: a script step before the first page is run once, then each conversation asks on until its last page says so."""
    turns = table(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    body = F.to_json(F.struct(F.array("role").alias("data"), (F.col("turn") + 1).alias("at"), (F.col("last") + 1).alias("of")))
    known = _known(turns.join(last, "conv_id"), F.concat(F.lit("http://x.test/C"), F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") + 1).cast("string")), body)
    runtime = lambda code, args: F.upper(F.get_json_object(args, "$.of"))
    signed = Step(script=Script("upper", {"of": "c{conv}"}, capture="token"))
    listed = Step(url="/{token}/{page}", parse="json", output=Output(Locator(path="data"), {"value": Locator()}, {"at": Locator(path="at"), "of": Locator(path="of"), "token": Locator(path="none", otherwise=(Locator(template="{token}"),))}))
    found, told = steps.paged(_runs(last, "conv_id", "conv"), "conv_id", [signed, listed], known, "http://x.test/", Pagination(current_page_meta="at", last_page_meta="of"), runtime)
    return found.join(told.select("conv_id", "token"), "conv_id")
