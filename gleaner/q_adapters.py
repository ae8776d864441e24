"""Queries that ask described sites, whose responses are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.plans import adapters, feeds, probe, steps
from gleaner.plans.steps import Locator, Script, Step
from gleaner.q_steps import _known, table

QUERIES: dict = {}
SITE = "http://x.test/"


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _string(name):
    return F.col(name).cast("string")


def _brand_pages(parts, size):
    """brand, page, last page and the page's parts in order."""
    by = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = parts.withColumns({"rn": F.row_number().over(by) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("p_brand"))})
    rows = rows.withColumn("page", F.floor(F.col("rn") / size).cast("int") + 1)
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size")))
    return rows.groupBy("p_brand", "page").agg(F.max("n").alias("n"), listed.alias("parts"))


def _asks(parts, size=10):
    """Of each brand the first two pages and the one after its last, which nothing answers."""
    after = F.greatest(F.ceil(F.count(F.lit(1)) / size).cast("int") + 1, F.lit(3))
    pages = parts.groupBy("p_brand").agg(after.alias("after")).select("p_brand", F.explode(F.array(F.lit(1), F.lit(2), F.col("after"))).alias("page"))
    return pages.select(F.concat_ws("/", "p_brand", "page").alias("ask"), "page", F.col("p_brand").alias("query"))


_BRANDS = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
  p AS (SELECT *, rn // 10 + 1 AS page FROM r), q AS (SELECT * FROM p WHERE page IN (1, 2))"""


@query(_BRANDS + """ SELECT p_brand || '/' || page AS ask, (row_number() OVER (PARTITION BY p_brand, page ORDER BY p_partkey) - 1)::INT AS pos, p_name AS title, 'http://x.test/p/' || p_partkey AS url,
  CASE WHEN p_size % 2 = 0 THEN 'http://x.test/c/' || p_partkey || '.png' ELSE '' END AS cover, page * 10 < n AS has_next FROM q WHERE p_size % 7 <> 0""")
def adapter_search(spark, sf_dir):
    """A search in markup, two pages of each brand: untitled items go, a next control says whether a page follows."""
    parts = table(spark, sf_dir, "part")
    item = lambda s: _text('<div class="item"><a href="/p/', s["p_partkey"].cast("string"), '">', F.when(s["p_size"] % 7 == 0, "").otherwise(s["p_name"]), "</a>", F.when(s["p_size"] % 2 == 0, _text('<img src="c/', s["p_partkey"].cast("string"), '.png">')).otherwise(""), "</div>")
    html = _text("<main>", F.array_join(F.transform("parts", item), ""), "</main>", F.when(F.col("page") * 10 < F.col("n"), '<a class="next">more</a>').otherwise(""))
    known = _known(_brand_pages(parts, 10), _text(SITE, "find?q=", urls.encode_query("p_brand"), "&page=", _string("page")), html)
    config = {"path": "find?q={query}&page={page}", "itemSelector": "div.item", "titleSelector": "a", "urlSelector": "a", "coverSelector": "img", "nextSelector": "a.next"}
    return adapters.listing(_asks(parts), "ask", config, known, SITE).select("ask", "has_next", F.posexplode("items").alias("pos", "i")).select("ask", "pos", "i.*", "has_next")


@query(_BRANDS + """ SELECT p_brand || '/' || page AS ask, (row_number() OVER (PARTITION BY p_brand, page ORDER BY p_partkey) - 1)::INT AS pos, p_name AS title, '/p/' || p_partkey AS url,
  CASE WHEN n % 2 = 0 THEN page * 10 < n ELSE count(*) OVER (PARTITION BY p_brand, page) >= 10 END AS has_next FROM q""")
def adapter_api_search(spark, sf_dir):
    """The same over JSON: a total that is a number decides whether a page follows, one that is text does not."""
    parts = table(spark, sf_dir, "part")
    numeric, worded = F.to_json(F.struct(F.col("parts").alias("data"), F.col("n").alias("total"))), F.to_json(F.struct(F.col("parts").alias("data"), _string("n").alias("total")))
    known = _known(_brand_pages(parts, 10), _text(SITE, "find?q=", urls.encode_query("p_brand"), "&page=", _string("page")), F.when(F.col("n") % 2 == 0, numeric).otherwise(worded))
    spec = {"title": Locator(path="p_name"), "url": Locator(path="p_partkey", template="/p/{value}")}
    found = adapters.api_listing(_asks(parts), "ask", "find?q={query}&lang=&page={page}", "data", spec, known, SITE, 10, "total")
    return found.select("ask", "has_next", F.posexplode("items").alias("pos", "i")).select("ask", "pos", "i.title", "i.url", "has_next")


@query("SELECT n_nationkey::INT AS ask, s_suppkey AS supplier, (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1)::INT AS pos FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0")
def adapter_tag(spark, sf_dir):
    """Tag pages: the first tag in the path, all tags and exclusions as parameters; an ask without a tag has no page."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    html = F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: _text('<li><a href="/s/', k.cast("string"), '">s ', k.cast("string"), "</a></li>")), "")
    own = nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(html.alias("html"))
    name = urls.encode_component("n_name")
    known = _known(own, _text(SITE, "t/", name, "?tag=", urls.encode_query("n_name"), "&tag=all&not=x"), F.col("html"))
    tags = F.when(F.col("n_nationkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("n_name", F.lit("all")))
    asks = nation.select(F.col("n_nationkey").cast("int").alias("ask"), F.lit(1).alias("page"), tags.alias("included"))
    params = adapters.selection_params(F.col("included"), F.array(F.lit("x")), "tag", "not")
    config = {"path": "t/{query}", "itemSelector": "li", "titleSelector": "a", "urlSelector": "a"}
    found = adapters.listing(adapters.tag_asks(asks), "ask", config, known, SITE, path_safe=True, params=params)
    return found.select("ask", F.posexplode("items").alias("pos", "i")).select("ask", "pos", F.regexp_extract("i.url", r"/s/(\d+)$", 1).cast("bigint").alias("supplier"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'old' ELSE c_name END AS title, CASE WHEN c_custkey % 5 = 0 THEN 'old' WHEN c_custkey % 2 = 0 THEN 'A, B' ELSE '' END AS author,
  CASE WHEN c_custkey % 5 = 0 THEN 'old' WHEN c_custkey % 2 = 0 THEN 'http://a' ELSE 'http://b' END AS cover, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment || '|x' END AS genres FROM customer""")
def adapter_details(spark, sf_dir):
    """Details in markup: an empty title keeps the old one, covers by a chain, labelled rows before locators; unanswered asks stay."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    html = _text("<h1>", F.when(key % 3 == 0, "").otherwise(F.col("c_name")), "</h1>", F.when(key % 2 == 0, '<img class="a" src="http://a">').otherwise(""), '<img class="b" src="http://b"><ul><li>', F.col("c_mktsegment"), "</li><li>x</li></ul>", F.when(key % 2 == 0, "<p><b>Author(s)</b> <i>A,</i><i> B </i></p>").otherwise(""))
    known = _known(customer.where("c_custkey % 5 <> 0"), _text(SITE, "c/", _string("c_custkey")), html)
    items = customer.select("c_custkey", _text("c/", _string("c_custkey")).alias("url"), *[F.lit("old").alias(n) for n in ("title", "author", "cover")])
    fields = {"title": Locator(selector="h1"), "author": Locator(selector="span.author"), "cover": steps.cover_locator([("img.a", "src"), ("img.b", "src")])}
    rows = {"row": "p", "label": "b", "value": "i", "labels": {"author": ["author"]}}
    found = adapters.details(items, "c_custkey", known, SITE, fields, ("li", ""), rows)
    return found.select("c_custkey", "title", F.coalesce("author", F.lit("")).alias("author"), "cover", F.array_join("genres", "|").alias("genres"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'old' ELSE c_name END AS title, CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE c_mktsegment END AS author FROM customer")
def adapter_api_details(spark, sf_dir):
    """Details in JSON: no item leaves all as it was, an empty title the title."""
    customer = table(spark, sf_dir, "customer")
    item = F.struct(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("t"), F.col("c_mktsegment").alias("a"))
    known = _known(customer, _text(SITE, "c/", _string("c_custkey")), F.to_json(F.struct(F.when(F.col("c_custkey") % 5 != 0, item).alias("data"))))
    items = customer.select("c_custkey", _string("c_custkey").alias("url"), F.lit("old").alias("title"), F.lit("old").alias("author"))
    spec = {"title": Locator(path="t"), "author": Locator(path="a")}
    return adapters.api_details(items, "c_custkey", "c/{url}", "data", spec, known, SITE).select("c_custkey", "title", "author")


def _turn_pages(spark, sf_dir, size):
    """conv_id, page, n and the page's turns in order; conversations without text are kept."""
    turns = table(spark, sf_dir, "conversations")
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"rn": F.row_number().over(by) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))})
    rows = rows.withColumn("page", F.floor(F.col("rn") / size).cast("int") + 1)
    return rows.groupBy("conv_id", "page").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))


@query("""SELECT conv_id, (count(*) OVER (PARTITION BY conv_id) - row_number() OVER w)::INT AS pos, 'http://x.test/t/' || conv_id || '/' || turn AS url, CASE WHEN role = 'assistant' THEN 'Chapter ' || row_number() OVER w ELSE role END AS name,
  turn % 2 = 1 AS locked, turn % 3 = 0 AS official FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def adapter_chapters(spark, sf_dir):
    """Chapters in markup over all pages of a list, newest first; an id from the first page asks for the list."""
    listed = _turn_pages(spark, sf_dir, 3)
    item = lambda s: _text('<li><a href="/t/', _string("conv_id"), "/", s["turn"].cast("string"), '">', F.when(s["role"] == "assistant", "").otherwise(s["role"]), "</a>", F.when(s["turn"] % 2 == 1, "<s>closed</s>").otherwise(""), '<i data-by="', F.when(s["turn"] % 3 == 0, "the official one").otherwise("fans"), '"></i></li>')
    html = _text("<ol>", F.array_join(F.transform("turns", item), ""), "</ol>", F.when(F.col("page") * 3 < F.col("n"), '<a class="next">more</a>').otherwise(""))
    convs = listed.select("conv_id").distinct()
    known = _known(convs, _text(SITE, "c/", _string("conv_id")), _text('<b data-id="k', _string("conv_id"), '"></b>')).unionByName(_known(listed, _text(SITE, "list/k", _string("conv_id"), "/", _string("page")), html))
    config = {"idSelector": "b", "idAttr": "data-id", "path": "/list/{id}/{page}", "itemSelector": "ol > li", "urlSelector": "a", "nameSelector": "a", "lockedSelector": "s", "officialSelector": "i", "officialAttr": "data-by", "officialValue": "official"}
    [lookup, chapters] = steps.chapters_steps(config)
    out = steps.Output(chapters.output.items, chapters.output.fields, {"more": Locator(selector="a.next", exists=True)})
    runs = convs.select("conv_id", F.create_map(F.lit("url"), _text(SITE, "c/", _string("conv_id"))).alias("vars"))
    found, _ = steps.paged(runs, "conv_id", [lookup, Step(url=chapters.url, output=out)], known, SITE, steps.Pagination(has_next_meta="more"))
    return adapters.told_chapters(found, "conv_id", config, SITE).select("conv_id", "pos", "url", "name", "locked", "official")


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, '/t/' || turn AS url, CASE WHEN turn % 2 = 0 THEN turn::DOUBLE ELSE -1 END AS number FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
  WHERE role <> 'system' AND (conv_id % 3 <> 1 OR rn <= 6)""")
def adapter_api_chapters(spark, sf_dir):
    """A paged JSON feed whose total is a number, text or missing; without one at most two pages are asked; some items are skipped."""
    listed = _turn_pages(spark, sf_dir, 3)
    total = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(F.col("n").alias("total")))).when(F.col("conv_id") % 3 == 1, F.lit("{}")).otherwise(F.to_json(F.struct(_string("n").alias("total"))))
    item = lambda s: F.struct(s["turn"].alias("id"), F.when(s["turn"] % 2 == 0, s["turn"]).alias("n"), F.when(s["role"] == "system", "1").alias("external"))
    body = _text('{"data":', F.to_json(F.transform("turns", item)), ',"meta":', total, "}")
    known = _known(listed, _text(SITE, "f/", _string("conv_id"), "?offset=", ((F.col("page") - 1) * 3).cast("string")), body)
    items = listed.select("conv_id", _string("conv_id").alias("url")).distinct()
    spec = {"url": Locator(path="id", template="/t/{value}"), "number": Locator(path="n")}
    return adapters.api_chapters(items, "conv_id", "f/{url}?offset={offset}", "data", spec, known, SITE, 3, "meta.total", "external", max_items=6).select("conv_id", "pos", "url", "number")


@query("SELECT p_partkey, i::INT AS pos, 'http://x.test/' || CASE WHEN p_size % 3 = 0 THEN 'plain' ELSE 'script' END || '/' || p_partkey || '-' || i AS value FROM part, range(2) AS r(i)")
def adapter_pages(spark, sf_dir):
    """Images from a script's list, or from the markup where that gives none."""
    part = table(spark, sf_dir, "part")
    both = lambda kind, around: F.array_join(F.transform(F.array(F.lit("0"), F.lit("1")), lambda i: around(_text(kind, "/", _string("p_partkey"), "-", i))), ",")
    listed = F.when(F.col("p_size") % 3 == 0, "").otherwise(both("script", lambda v: _text('"/', v, '"')))
    html = _text("<script>go({", '"images":[', listed, "]})</script>", both("plain", lambda v: _text('<img class="p" src="', v, '">')))
    known = _known(part, _text(SITE, "c/", _string("p_partkey")), html)
    items = part.select("p_partkey", _text("/c/", _string("p_partkey")).alias("url"))
    return adapters.pages(items, "p_partkey", {"scriptRegex": r"go\((\{.*?\})\)", "path": "images", "imageSelector": "img.p"}, known, SITE)


@query("SELECT p_partkey, i::INT AS pos, 'http://img.test/' || p_brand || '/' || p_partkey || '-' || i || '.png' AS value FROM part, range(2) AS r(i)")
def adapter_api_pages(spark, sf_dir):
    """Images by a template over fields of the element and of the body."""
    part = table(spark, sf_dir, "part")
    files = F.transform(F.array(F.lit("0"), F.lit("1")), lambda i: F.struct(_text(_string("p_partkey"), "-", i).alias("f")))
    known = _known(part, _text(SITE, "c/", _string("p_partkey")), F.to_json(F.struct(F.lit("http://img.test").alias("host"), F.struct(F.col("p_brand").alias("hash"), files.alias("data")).alias("chapter"))))
    items = part.select("p_partkey", _string("p_partkey").alias("url"))
    return adapters.api_pages(items, "p_partkey", "c/{url}", "chapter.data", "{host}/{chapter.hash}/{f}.png", known, SITE)


@query("""SELECT r_regionkey, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1)::INT AS pos, n_nationkey::VARCHAR AS option_id, n_name AS label FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey > 0
  UNION ALL SELECT 0, 0, 'all', 'Everything'""")
def adapter_filters(spark, sf_dir):
    """Options scraped from a page, in order of their labels; a page without any leaves the described ones."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    option = lambda s: _text('<option value="', s["n_nationkey"].cast("string"), '">', s["n_name"], "</option>")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), option), "")
    known = _known(nation.where("n_regionkey > 0").groupBy("n_regionkey").agg(listed.alias("html")), _text(SITE, "r/", _string("n_regionkey")), F.col("html"))
    asks = region.select("r_regionkey", _text("r/", _string("r_regionkey")).alias("url"))
    static = region.select("r_regionkey", F.lit(0).alias("pos"), F.lit("all").alias("option_id"), F.lit("Everything").alias("label"))
    return adapters.scraped_options(asks, "r_regionkey", "option", "value", known, SITE, static=static)


@query("SELECT n_nationkey, upper(n_name) AS token, 'T-' || n_nationkey AS id, (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1)::INT AS pos, s_suppkey::VARCHAR AS value FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def pipeline_script_step(spark, sf_dir):
    """A script step between requests, its runtime an expression: the result's paths are variables of the next request."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    own = supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("data"))
    known = _known(own, _text(SITE, "T-", _string("s_nationkey")), F.to_json(F.struct("data")))
    runtime = lambda code, args: F.to_json(F.struct(F.upper(F.get_json_object(args, "$.name")).alias("token"), F.concat(F.lit(code), F.get_json_object(args, "$.key")).alias("id")))
    signed = Step(script=Script("T-", {"name": "{name}", "key": "{key}"}, capture_json={"token": "token", "id": "id"}))
    last = Step(url="{id}", parse="json", output=steps.Output(Locator(path="data"), {"value": Locator()}))
    runs = nation.select("n_nationkey", F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), _string("n_nationkey")).alias("vars"))
    told = steps.run_body(runs, "n_nationkey", [signed], known, SITE, runtime)
    found = steps.run(told, "n_nationkey", [last], known, SITE)
    return found.join(told.select("n_nationkey", F.col("vars")["token"].alias("token"), F.col("vars")["id"].alias("id")), "n_nationkey")


@query("""SELECT c_custkey, CASE WHEN n = 0 THEN 'chapters' END AS full_run, NULL::VARCHAR AS without_chapters, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'first' END AS tag
  FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""")
def probe_stages(spark, sf_dir):
    """A probe's first failed stage with and without its chapters, and the tag that it tries."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    stages = [("popular", F.lit(1)), ("chapters", F.col("n")), ("pages", F.col("n"))]
    genres = F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    tag = feeds.guessed_tag(genres, F.array(F.lit("first"), F.lit("second")))
    return rows.select("c_custkey", feeds.probe_status(stages).alias("full_run"), feeds.probe_status(stages, ["chapters"]).alias("without_chapters"), tag.alias("tag"))


@query("""WITH i AS (SELECT p_partkey, i, CASE (p_size + i) % 4 WHEN 0 THEN '' WHEN 1 THEN 'data:image/png;base64,AA' WHEN 2 THEN '/spinner.gif' ELSE '/' || p_partkey || '-' || i || '.png' END AS src, CASE WHEN p_size % 9 = 0 THEN '' ELSE '/real/' || p_partkey || '-' || i || '.png' END AS real FROM part, range(6) AS r(i)),
  v AS (SELECT *, CASE WHEN src = '' OR src LIKE 'data:%' OR count(*) OVER (PARTITION BY p_partkey, src) > 1 THEN real ELSE src END AS v FROM i)
  SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1)::INT AS pos, 'http://x.test' || v AS value FROM v WHERE v <> ''""")
def adapter_lazy_pages(spark, sf_dir):
    """Images that load late: no source, inline data or a picture that several share give way to data-src; without one the image goes."""
    part = table(spark, sf_dir, "part")
    numbers = F.sequence(F.lit(0), F.lit(5))
    name = lambda i: _text(_string("p_partkey"), "-", i.cast("string"), ".png")
    src = lambda i: F.when((F.col("p_size") + i) % 4 == 0, "").when((F.col("p_size") + i) % 4 == 1, ' src=" data:image/png;base64,AA "').when((F.col("p_size") + i) % 4 == 2, ' src="/spinner.gif"').otherwise(_text(' src="/', name(i), '"'))
    image = lambda i: _text("<img", src(i), F.when(F.col("p_size") % 9 == 0, "").otherwise(_text(' data-src="/real/', name(i), '"')), ">")
    known = _known(part, _text(SITE, "c/", _string("p_partkey")), _text("<main>", F.array_join(F.transform(numbers, image), ""), "</main>"))
    items = part.select("p_partkey", _text("/c/", _string("p_partkey")).alias("url"))
    return adapters.pages(items, "p_partkey", {"imageSelector": "main img"}, known, SITE)


@query(_BRANDS + """ SELECT p_brand || '/' || page AS ask, (row_number() OVER (PARTITION BY p_brand, page ORDER BY p_partkey) - 1)::INT AS pos, p_name AS title, 'http://x.test/p/' || p_partkey AS url,
  'http://x.test/' || CASE WHEN p_size % 2 = 0 THEN 'b/' ELSE 'c/' END || p_partkey || '.png' AS cover, count(*) OVER (PARTITION BY p_brand, page) >= 10 AS has_next FROM q""")
def adapter_post_search(spark, sf_dir):
    """A search by POST: queries by a map or with their words joined, titles from an attribute, covers by a chain; a full page says that one follows."""
    parts = table(spark, sf_dir, "part")
    first = parts.agg(F.min("p_brand")).first()[0]
    wanted = F.when(F.col("p_brand") == first, "the first").otherwise(F.regexp_replace("p_brand", "#", "_"))
    item = lambda s: _text('<div class="item"><a href="p/', s["p_partkey"].cast("string"), '" title=" ', s["p_name"], ' ">x</a>', F.when(s["p_size"] % 2 == 0, _text('<img class="big" src="b/', s["p_partkey"].cast("string"), '.png">')).otherwise(""), '<img src="c/', s["p_partkey"].cast("string"), '.png"></div>')
    sent = F.sha2(_text("q=", urls.encode_query(wanted), "&from=", ((F.col("page") - 1) * 10).cast("string")), 256)
    known = _known(_brand_pages(parts, 10).withColumn("sent", sent), F.lit(SITE + "find"), F.array_join(F.transform("parts", item), ""), F.col("sent"))
    config = {"path": "find", "method": "POST", "body": "q={query}&from={offset}", "itemSelector": "div.item", "titleSelector": "a", "titleAttr": "title", "urlSelector": "a", "coverChain": [("img.big", "src"), ("img", "src")], "queryMap": {first.upper(): "the first"}, "queryReplace": ("", "#", "_")}
    return adapters.listing(_asks(parts), "ask", config, known, SITE, 10).select("ask", "has_next", F.posexplode("items").alias("pos", "i")).select("ask", "pos", "i.*", "has_next")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'old' WHEN c_custkey % 2 = 0 THEN 'http://x.test/a.png' ELSE 'http://x.test/b/' || c_custkey || '.png' END AS cover, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'old' ELSE 'http://x.test/banner' END AS banner,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'A|B C' ELSE c_mktsegment || '|x' END AS genres, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'ongoing' WHEN c_custkey % 4 = 2 THEN 'unknown' END AS status,
  CASE WHEN c_custkey % 5 = 0 THEN -1 WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS unlisted FROM customer""")
def adapter_details_rows(spark, sf_dir):
    """Details by labelled rows: genres stay a list, the first status is mapped, covers are resolved, an empty banner keeps the old one, a number of unlisted chapters."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    labelled = F.when(key % 2 == 0, _text("<p><b>Genre(s)</b> <i>A,</i><i> B\n C; </i></p><p><b>State</b><i>", F.when(key % 4 == 0, "Still Running").otherwise("who knows"), "</i><i>completed</i></p><em>and ", _string("c_custkey"), " more of 99</em>")).otherwise("<em>none</em>")
    html = _text(F.when(key % 2 == 0, '<img class="a" src="/a.png">').otherwise(""), '<img class="b" src="b/', _string("c_custkey"), '.png">', F.when(key % 3 == 0, "").otherwise('<div data-bg="banner"></div>'), "<ul><li>", F.col("c_mktsegment"), "</li><li>x</li></ul>", labelled)
    known = _known(customer.where("c_custkey % 5 <> 0"), _text(SITE, "c/", _string("c_custkey")), html)
    items = customer.select("c_custkey", _text("c/", _string("c_custkey")).alias("url"), F.lit("old").alias("cover"), F.lit("old").alias("banner"))
    fields = {"cover": steps.cover_locator([("img.a", "src"), ("img.b", "src")]), "banner": Locator(selector="div", attr="data-bg")}
    rows = {"row": "p", "label": "b", "value": "i", "labels": {"genres": ["genre"], "status": ["state"]}}
    found = adapters.details(items, "c_custkey", known, SITE, fields, ("li", ""), rows, statuses={"still running": "ongoing"}, unlisted=("em", ""))
    return found.select("c_custkey", "cover", "banner", F.array_join("genres", "|").alias("genres"), "status", F.coalesce(F.col("unlisted").cast("long"), F.lit(-1)).alias("unlisted"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'old' ELSE 'A line' || chr(10) || 'and & ' || c_mktsegment END AS description, CASE WHEN c_custkey % 5 IN (0, 1) OR c_custkey % 3 = 0 THEN 'kept' ELSE c_mktsegment || '|x' END AS genres FROM customer""")
def adapter_api_about(spark, sf_dir):
    """Details in JSON: descriptions lose their markup, an empty list of genres keeps the old one, an item without an address changes nothing."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    tags = F.when(key % 3 == 0, F.from_json(F.lit("[]"), "array<struct<n:string>>")).otherwise(F.array(F.struct(F.col("c_mktsegment").alias("n")), F.struct(F.lit("").alias("n")), F.struct(F.lit("x").alias("n"))))
    item = F.struct(F.when(key % 5 == 1, "").otherwise(_string("c_custkey")).alias("id"), _text("<p>A line<br>and &amp; ", F.col("c_mktsegment"), "</p>").alias("d"), tags.alias("tags"))
    known = _known(customer, _text(SITE, "c/", _string("c_custkey")), F.to_json(F.struct(F.when(key % 5 != 0, item).alias("data"))))
    items = customer.select("c_custkey", _string("c_custkey").alias("url"), F.lit("old").alias("description"), F.array(F.lit("kept")).alias("genres"))
    spec = {"url": Locator(path="id"), "description": Locator(path="d")}
    return adapters.api_details(items, "c_custkey", "c/{url}", "data", spec, known, SITE, genres=("tags", "n")).select("c_custkey", "description", F.array_join("genres", "|").alias("genres"))


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, CASE WHEN role = 'system' THEN 'no name' ELSE role || ' - ' || turn END AS name, turn % 2 = 1 AS locked, turn % 3 = 0 AS official, 86400000000 * turn AS uploaded_us FROM conversations""")
def adapter_api_flags(spark, sf_dir):
    """Chapters in JSON: names joined of parts, dates in seconds, flags that are booleans, numbers or texts."""
    listed = _turn_pages(spark, sf_dir, 100)
    truth = lambda t: F.when(t % 2 == 1, "true").otherwise("0")
    item = lambda s: _text('{"id":', s["turn"].cast("string"), F.when(s["role"] == "system", "").otherwise(_text(',"r":"', s["role"], '","t":"', s["turn"].cast("string"), '"')), ',"l":', truth(s["turn"]), ',"o":"', F.when(s["turn"] % 3 == 0, "yes").otherwise(""), '","at":', (s["turn"] * 86400).cast("string"), "}")
    known = _known(listed, _text(SITE, "f/", _string("conv_id")), _text('{"data":[', F.array_join(F.transform("turns", item), ","), "]}"))
    items = listed.select("conv_id", _string("conv_id").alias("url")).distinct()
    spec = {"url": Locator(path="id", template="/t/{value}"), "date": Locator(path="at")}
    found = adapters.api_chapters(items, "conv_id", "f/{url}", "data", spec, known, SITE, 100, name_parts=["r", "t"], join=" - ", default="no name", locked="l", official="o")
    return found.select("conv_id", "pos", "name", "locked", "official", F.unix_micros("uploaded").alias("uploaded_us"))


@query("""WITH s AS (SELECT n_nationkey, s_suppkey AS s, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS r, count(*) OVER (PARTITION BY n_nationkey) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey),
  e AS (SELECT *, s % 7 = 0 OR s % 11 = 0 OR s % 3 > 0 AS ends FROM s WHERE r < 5), c AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY ends DESC, CASE WHEN ends THEN r END, r DESC) = 1),
  b AS (SELECT *, CASE WHEN s % 7 = 0 THEN 'details' WHEN s % 11 = 0 THEN 'chapters' END AS broken, CASE WHEN s % 11 = 0 THEN 0 ELSE s % 3 END AS chapters FROM c),
  p AS (SELECT *, CASE WHEN broken IS NULL AND chapters > 0 THEN CASE WHEN chapters = 2 OR s % 2 = 1 THEN 1 ELSE 0 END END AS pages, CASE WHEN broken IS NULL THEN CASE WHEN s % 2 = 0 THEN 'g' || n_nationkey ELSE 'first' END END AS tag FROM b)
  SELECT n.n_nationkey, coalesce(p.n, 0) AS n_popular, coalesce('http://x.test/s/' || s, '') AS candidate, coalesce(chapters, -1) AS n_chapters, CASE WHEN pages = 1 THEN 'http://x.test/ch/' || s || '-' || CASE WHEN s % 2 = 1 THEN 0 ELSE 1 END ELSE '' END AS chapter,
  coalesce(pages, CASE WHEN broken IS NOT NULL AND chapters > 0 THEN 0 ELSE -1 END) AS n_pages, coalesce(tag, '') AS tag, CASE WHEN tag LIKE 'g%' THEN 2 ELSE -1 END AS n_tag,
  CASE WHEN p.n IS NULL THEN 'popular' WHEN broken IS NOT NULL THEN broken WHEN chapters = 0 THEN 'chapters' WHEN pages = 0 THEN 'pages' ELSE '' END AS failed_stage FROM nation n LEFT JOIN p ON p.n_nationkey = n.n_nationkey""")
def probe_run(spark, sf_dir):
    """A probe of a site for each nation: its suppliers are listed, some don't answer, some have no chapters, some chapters no pages."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    card = lambda k: _text('<div class="item"><a href="/s/', k.cast("string"), '">s</a></div>')
    s, key = _string("s_suppkey"), F.col("s_suppkey")
    listed = supplier.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), card), "").alias("html"))
    about = _text("<h1>x</h1>", F.when(key % 2 == 0, _text("<i>g", _string("s_nationkey"), "</i><i>other</i>")).otherwise(""))
    # Listed newest first, so the last comes first.
    rows = F.array_join(F.transform(F.reverse(F.slice(F.array(F.lit("0"), F.lit("1")), 1, (key % 3).cast("int"))), lambda i: _text('<li><a href="/ch/', s, "-", i, '">c</a></li>')), "")
    pages = supplier.select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    known = _known(listed, _text(SITE, "n/", _string("s_nationkey")), F.col("html"))
    known = known.unionByName(_known(supplier.where("s_suppkey % 7 <> 0"), _text(SITE, "s/", s), about)).unionByName(_known(supplier.where("s_suppkey % 11 <> 0"), _text(SITE, "s/", s, "/list"), rows))
    known = known.unionByName(_known(pages, _text(SITE, "ch/", s, "-", _string("i")), F.when((key + F.col("i")) % 2 == 1, '<img src="/1.png">').otherwise("<p></p>")))
    known = known.unionByName(_known(nation, _text(SITE, "t/g", _string("n_nationkey")), F.concat(card(F.lit(1)), card(F.lit(2)))))
    listing = {"itemSelector": "div.item", "titleSelector": "a", "urlSelector": "a"}
    config = {"popular": {"path": "n/{query}", **listing}, "tag": {"path": "t/{query}", **listing}, "details": {"genres": ("i", "")}, "chapters": {"transform": steps.Transform(suffix="/list"), "itemSelector": "li", "urlSelector": "a"}, "pages": {"imageSelector": "img"}}
    found = probe.probed(nation.select("n_nationkey", _string("n_nationkey").alias("query")), "n_nationkey", config, known, SITE, first_option="first")
    filled = {n: F.coalesce(n, F.lit(0 if n == "n_popular" else -1)).cast("long") for n in ("n_popular", "n_chapters", "n_pages", "n_tag")}
    return found.withColumns(filled | {n: F.coalesce(n, F.lit("")) for n in ("candidate", "chapter", "tag", "failed_stage")})


@query("SELECT n_nationkey, (row_number() OVER (PARTITION BY n_nationkey ORDER BY r_regionkey) - 1)::INT AS pos, r_name AS title, 'http://x.test/r/' || r_regionkey AS url FROM nation, region")
def adapter_root_listing(spark, sf_dir):
    """A listing without a path is the site itself, asked for once however many ask."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    item = F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda s: _text('<li><a href="/r/', s["r_regionkey"].cast("string"), '">', s["r_name"], "</a></li>"))
    known = _known(region.agg(F.array_join(item, "").alias("html")), F.lit(SITE), F.col("html"))
    asks = nation.select("n_nationkey", F.lit(1).alias("page"), F.lit("").alias("query"))
    found = adapters.listing(asks, "n_nationkey", {"path": "", "itemSelector": "li", "titleSelector": "a", "urlSelector": "a"}, known, SITE)
    return found.select("n_nationkey", F.posexplode("items").alias("pos", "i")).select("n_nationkey", "pos", "i.title", "i.url")
