"""Captured responses as a table: request keys, fetching by join, and what a response amounts to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import col
from gleaner.functions.urls import once, sorted_headers

RESPONSES = (
    "source_id string, method string, url string, body_key string, transport string, status int, "
    "headers map<string,string>, body binary, fetched_at timestamp"
)
KEY = ["method", "url", "body_key", "transport"]

# What a challenge page says, and the first bytes of image formats.
CHALLENGE_MARKS = ("Just a moment", "/cdn-cgi/challenge-platform", "challenge-platform", "__cf_chl", "cf_chl_opt", "cf-chl")
MAGIC = (("jpeg", 1, "FFD8FF"), ("png", 1, "89504E47"), ("gif", 1, "47494638"), ("webp", 9, "57454250"), ("bmp", 1, "424D"), ("avif", 5, "66747970"), ("jxl", 1, "FF0A"), ("jxl", 1, "0000000C4A584C20"))


def request(df: DataFrame, url: Column, method: str = "GET", body: Column | None = None, transport: Column | None = None) -> DataFrame:
    """df with the request's key columns; a body's key is its hash."""
    return df.withColumns(
        {
            "method": F.lit(method),
            "url": url,
            "body_key": F.sha2(body, 256) if body is not None else F.lit(""),
            "transport": transport if transport is not None else F.lit("plain"),
        }
    )


def transient(status: Column) -> Column:
    """Whether another try may help: no answer at all, 429 or 5xx."""
    return status.isNull() | (status == 429) | (status >= 500)


def visits(responses: DataFrame, gap: str = "1 minute") -> DataFrame:
    """responses with visit and attempt: answers to one request no more than gap apart are attempts of one visit, in their order."""
    by = Window.partitionBy(*KEY).orderBy("fetched_at", F.col("status").desc_nulls_first())
    begins = F.lag("fetched_at").over(by).isNull() | (F.col("fetched_at") > F.lag("fetched_at").over(by) + F.expr(f"INTERVAL {gap}"))
    rows = responses.withColumn("visit", F.sum(begins.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(*KEY, "visit").orderBy("fetched_at", F.col("status").desc_nulls_first())))


def settled(responses: DataFrame, as_of: Column | None = None, attempts: int = 3, gap: str = "1 minute") -> DataFrame:
    """One answer a request: of its last visit (begun by as_of) the first attempt that trying again would not mend, at most the third.

    A challenge (403, or 503 by its marks) ends a visit, too. What was fetched after as_of is not seen.
    """
    rows = visits(responses if as_of is None else responses.where(F.col("fetched_at") <= as_of), gap)
    rows = rows.withColumn("_last", F.max("visit").over(Window.partitionBy(*KEY))).where("visit = _last").drop("_last")
    header = "headers" in responses.columns and "body" in responses.columns
    text = F.col("body").cast("string") if header else None
    again = transient(F.col("status")) & (~F.coalesce(is_challenge(F.col("status"), F.col("headers"), text), F.lit(False)) if header else F.lit(True))
    by = Window.partitionBy(*KEY)
    rows = rows.withColumn("_stop", F.least(F.coalesce(F.min(F.when(~again, F.col("attempt"))).over(by), F.lit(attempts)), F.max("attempt").over(by), F.lit(attempts)))
    return rows.where("attempt = _stop").drop("_stop")


def fetch(requests: DataFrame, responses: DataFrame, as_of: Column | None = None, attempts: int = 3) -> DataFrame:
    """requests with status, headers and body of their response; equal requests are looked up once and answered once.

    Responses with a time (fetched_at) are attempts and versions of an answer, see settled. Without one, of several answers
    to a request one of status 200 counts, the least body first.
    """
    wanted = requests.select(*KEY).distinct()
    timed = "fetched_at" in responses.columns
    got = wanted.join(responses.select(*KEY, "status", "headers", "body", *(["fetched_at"] if timed else [])), KEY)
    if timed:
        got = settled(got, as_of, attempts).drop("fetched_at", "visit", "attempt")
    else:
        order = Window.partitionBy(*KEY).orderBy(F.coalesce(F.col("status") == 200, F.lit(False)).desc(), "status", "body")
        got = got.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return requests.join(got, KEY, "left")


def form_headers(headers: Column, body: Column) -> Column:
    """Headers of a POST: a form's content type where a body has none of its own."""
    named = F.exists(F.map_keys(headers), lambda k: F.lower(k) == "content-type")
    form = F.create_map(F.lit("Content-Type"), F.lit("application/x-www-form-urlencoded; charset=UTF-8"))
    return F.when((F.coalesce(body, F.lit("")) != "") & ~named, F.map_concat(form, headers)).otherwise(headers)


def shared_requests(requests: DataFrame, headers: str = "headers") -> DataFrame:
    """One row for each distinct request: url, transport and headers in any order."""
    return requests.withColumn("headers_key", sorted_headers(headers)).dropDuplicates(["url", "transport", "headers_key"])


def transport(op: Column, wants_document: Column, method: Column, rendered_ops: list[str], challenges: bool = False, session: bool = False, available: bool = True) -> Column:
    """rendered where a browser is available, the step wants a document by GET, and the operation or the site asks for it."""
    asked = op.isin(*rendered_ops) if rendered_ops else F.lit(False)
    rendered = F.lit(available) & wants_document & (method == "GET") & (asked | F.lit(challenges and not session))
    return F.when(rendered, "rendered").otherwise("plain")


def layered(*headers: Column | Mapping[str, str]) -> Column:
    """Headers of several layers, later ones winning."""
    maps = [h if isinstance(h, Column) else F.create_map(*[F.lit(x) for kv in h.items() for x in kv]) if h else F.expr("map()").cast("map<string,string>") for h in headers]

    def latest(entries: Column) -> Column:
        return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))

    return F.map_from_entries(once(F.concat(*[F.map_entries(m) for m in maps]), latest))


def is_challenge(status: Column, headers: Column, body: Column) -> Column:
    """A bot challenge: 403 or 503 with a challenge header, or from such a server with a page that says so."""
    header = lambda name: F.coalesce(F.lower(F.element_at(headers, F.lit(name))), F.lit(""))
    page = F.lit(False)
    for mark in CHALLENGE_MARKS:
        page = page | F.contains(body, F.lit(mark))
    return status.isin(403, 503) & ((header("cf-mitigated") == "challenge") | (F.contains(header("server"), F.lit("cloudflare")) & F.coalesce(page, F.lit(False))))


def body_kind(body: Column | str) -> Column:
    """An image format by its first bytes; wall for an empty body, markup or JSON; else unknown."""
    head = F.substring(col(body), 1, 32)
    digits = F.hex(head)
    out = F.lit("unknown")
    text = F.regexp_replace(digits, "^(?:EFBBBF)?(?:20|09|0A|0D)*", "")
    out = F.when(text.rlike("^(?:3C|7B|5B)"), "wall").otherwise(out)
    for kind, at, magic in reversed(MAGIC):
        out = F.when(F.substring(digits, 2 * at - 1, len(magic)) == magic, kind).otherwise(out)
    return F.when(col(body).isNull() | (F.length(col(body)) == 0), "wall").otherwise(out)


def outcome(status: Column, challenge: Column, attempt: Column, attempts: int = 3) -> Column:
    """ok, challenge, retry or failed: transport errors (null status), 429 and 5xx are tried again."""
    again = transient(status)
    return F.when(status == 200, "ok").when(challenge, "challenge").when(again & (attempt < attempts), "retry").otherwise("failed")


def backoff_ms(attempt: Column, first_ms: int = 400) -> Column:
    return (F.lit(first_ms) * F.pow(F.lit(2), attempt - 1)).cast("long")


def image_outcome(status: Column, challenge: Column, kind: Column, empty: Column) -> Column:
    """bytes, browser (a wall or challenge), empty or http_error."""
    return F.when(challenge, "browser").when(status.isNull(), "browser").when(status != 200, "http_error").when(empty, "empty").when(kind == "wall", "browser").otherwise("bytes")


def decoded(body: Column | str, content_type: Column) -> Column:
    """Text by the charset of the header, of a meta tag in the first 1024 bytes, or UTF-8; broken bytes are replaced."""
    head = F.make_valid_utf8(F.substring(col(body), 1, 1024).cast("string"))
    name = F.lower(F.coalesce(F.nullif(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([\w-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([\w-]+)", 1), F.lit("")), F.lit("utf-8")))
    plain = F.make_valid_utf8(col(body).cast("string"))
    return F.when(name.isin("iso-8859-1", "latin1", "windows-1252"), F.decode(col(body), "ISO-8859-1")).when(name == "us-ascii", F.decode(col(body), "US-ASCII")).when(name == "utf-16", F.decode(col(body), "UTF-16")).otherwise(plain)


def declared_hosts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct lower-cased hosts of absolute URLs."""
    from gleaner.functions.urls import host

    return urls.select(host(url).alias("host")).where(F.col("host").isNotNull()).distinct()


def index_entries(files: DataFrame, text: str = "value") -> DataFrame:
    """Entries of index files that hold a list or one entry; entries without sources go, corrupt files are skipped."""
    entry = "array<struct<name string, pkg string, version string, lang string, nsfw int, sources array<string>>>"
    whole = F.when(F.startswith(F.ltrim(F.col(text)), F.lit("[")), F.col(text)).otherwise(F.concat(F.lit("["), F.col(text), F.lit("]")))
    return files.select(F.inline(F.from_json(whole, entry))).where(F.size("sources") > 0)


def build_index(entries: DataFrame, content: str = "content") -> DataFrame:
    """Entries with a content hash as version, one for each package, by lower-cased name; a repeated package is an error."""
    copies = F.count(F.lit(1)).over(Window.partitionBy("pkg"))
    checked = F.when(copies > 1, F.raise_error(F.concat(F.lit("package twice: "), F.col("pkg"))).cast("string")).otherwise(F.substring(F.sha2(content, 256), 1, 16))
    return entries.withColumn("version", checked).orderBy(F.lower("name"), "pkg")


def icon_candidates(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Icon links of each page, touch icons first, then by size, tile images last: key, rank, href."""
    tags = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), 1)).alias("pos", "tag"))
    attr = lambda n: F.regexp_extract("tag", rf"(?i)\b{n}=[\"']?([^\"'\s>]*)", 1)
    rows = tags.select(key, "pos", F.lower(F.regexp_extract("tag", r"(?i)\brel=[\"']?([^\"'>]*)", 1)).alias("rel"), F.lower(attr("name")).alias("name"), attr("href").alias("link"), attr("content").alias("content"), attr("sizes").alias("sizes"))
    names = F.split("rel", r"\s+")
    touch, tile = F.arrays_overlap(names, F.array(F.lit("apple-touch-icon"), F.lit("apple-touch-icon-precomposed"))), F.col("name") == "msapplication-tileimage"
    rows = rows.where(touch | F.array_contains(names, "icon") | tile)
    order = Window.partitionBy(key).orderBy(F.when(touch, 0).when(tile, 2).otherwise(1), F.desc(F.coalesce(F.regexp_extract("sizes", r"(\d+)", 1).try_cast("int"), F.lit(0))), "pos")
    return rows.select(key, F.row_number().over(order).alias("rank"), F.when(tile, F.col("content")).otherwise(F.col("link")).alias("href"))


def catalog_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """id, status, notes from table rows of eight cells in a markdown file; a leading symbol of the status goes."""
    cells = F.transform(F.split(F.trim(F.col(line)), r"\|"), lambda c: F.trim(c))
    rows = lines.select(cells.alias("c")).where((F.size("c") == 10) & ~F.get("c", F.lit(1)).rlike("^:?-+:?$") & (F.get("c", F.lit(1)) != "id"))
    return rows.select(F.get("c", F.lit(1)).alias("id"), F.regexp_replace(F.get("c", F.lit(7)), r"^[^\p{L}\p{N}]+", "").alias("status"), F.get("c", F.lit(8)).alias("notes"))
