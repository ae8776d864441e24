"""What users ask of a described site: listings, searches, tags, details, chapters, pages, filters.

Each function takes a table of asks and the table of known responses and answers all asks in one plan: a join for each
request, expressions for the rest. Functions come in pairs, over markup and over JSON. A listing is a row for each asked
page, with its items in an array, as a page is one response; all else is a row for an item.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import jsonpath, text, urls
from gleaner.operators import extract
from gleaner.plans import feeds, steps
from gleaner.plans.steps import Locator
from gleaner.sources import fused, responses
from gleaner.sources.store import cut

Params = Sequence[tuple[str, Column, str | None]]
ITEM = "struct<title:string,url:string,cover:string>"


def page_urls(asks: DataFrame, path: str, base: str, page_size: int = 0, api: bool = False, path_safe: bool = False, params: Params = ()) -> DataFrame:
    """asks(page, query) with _url: {page}, {offset}, {start} and {query} filled in, then the params of filters and tags.

    Over markup the path is resolved against base, and an empty path is base itself; over JSON it follows base as it is
    and parameters without a value go. path_safe encodes the query for a path segment. Each step is a column of its own,
    so that no expression holds the one before many times.
    """
    out = asks.withColumn("_url", urls.encode_component("query") if path_safe else urls.encode_query("query"))
    out = out.withColumn("_url", text.substitute(F.lit(path), text.page_values(F.col("page"), page_size, F.col("_url"))))
    if api:
        out = out.withColumn("_url", F.concat(F.lit(base), "_url")).withColumn("_url", urls.drop_empty_params("_url"))
    else:
        out = out.withColumn("_url", urls.resolve(F.lit(base), "_url") if path else F.lit(base))
    return out.withColumn("_url", urls.append_params("_url", params)) if params else out


def selection_params(included: Column, excluded: Column, param: str, exclude_param: str = "", join: str | None = None) -> Params:
    """A filter's selection as parameters, repeated or joined; without an exclude_param exclusions are not asked for."""
    return [(param, included, join), *([(exclude_param, excluded, join)] if exclude_param else [])]


def _fetched(asks: DataFrame, url: Column, known: DataFrame) -> DataFrame:
    got = responses.fetch(responses.request(asks, url), known).where("status = 200")
    return got.drop(*responses.KEY, "status", "headers")


def asked_for(query: Column | str, config: Mapping) -> Column:
    """A query as the site wants it: by its queryMap, else as it is, then through queryReplace (find, pattern, replacement)."""
    whole = F.coalesce(text.lookup(query, config.get("queryMap", {})), text.col(query)) if config.get("queryMap") else text.col(query)
    if config.get("queryReplace"):
        find, pattern, put = config["queryReplace"]
        whole = text.rewrite(whole, find=find or None, pattern=pattern or None, replace=put)
    return text.trim(whole)


def listing(asks: DataFrame, key: str, config: Mapping, known: DataFrame, base: str, page_size: int = 0, path_safe: bool = False, params: Params = ()) -> DataFrame:
    """asks(key, page, query) of a listing in markup: key, items (title, url, cover) that have address and title, has_next.

    has_next: by the total where totalSelector finds one, by a full page where no nextSelector is named, else by that. With a
    method POST the body is sent, filled like the path.
    """
    asks = page_urls(asks.withColumn("query", asked_for("query", config)), config.get("path", ""), base, page_size, path_safe=path_safe, params=params)
    query = urls.encode_component("query") if path_safe else urls.encode_query("query")
    post = config.get("method", "GET").upper() == "POST"
    body = text.substitute(F.lit(config.get("body", "") if post else ""), text.page_values(F.col("page"), page_size, query))
    described = steps.listing_steps({**config, "path": "{listing}", "body": "{body}" if post and config.get("body") else ""})[0]
    meta = dict(described.output.meta)
    if config.get("totalSelector"):
        meta["total"] = Locator(selector=config["totalSelector"])
    step = replace(described, output=steps.Output(described.output.items, described.output.fields, meta))
    runs = asks.select(key, F.create_map(F.lit("listing"), F.col("_url"), F.lit("body"), body).alias("vars"))
    found, told = steps.run_parts(runs, key, [step], known, base)
    cover = F.col("cover") if "cover" in found.columns else F.lit("")
    kept = feeds.complete(found).select(key, "pos", F.struct("title", urls.resolve(F.lit(base), "url").alias("url"), urls.resolve(F.lit(base), cover).alias("cover")).cast(ITEM).alias("item"))
    items = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"]).alias("items"))
    pages = asks.select(key, "page").join(told, key).join(items, key, "left").withColumn("items", F.coalesce("items", F.array().cast(f"array<{ITEM}>")))
    total = F.nullif(F.col("total"), F.lit("")) if "total" in meta else F.lit(None).cast("string")
    flag = F.col("has_next") if "has_next" in meta else F.lit("")
    follows = feeds.has_next(total, F.col("page"), F.lit(page_size), flag, F.size("items"), F.lit("has_next" in meta))
    return pages.select(key, "items", F.coalesce(follows, F.lit(False)).alias("has_next"))


def api_item(item: Column, root: Column, spec: Mapping[str, Locator]) -> Column:
    """A struct of a JSON item's fields by their locators."""
    return F.struct(*[jsonpath.value_of(item, [one.path for one in at.chain()], at.template, at.default, root).alias(name) for name, at in spec.items()])


def api_listing(asks: DataFrame, key: str, path: str, items: str, spec: Mapping[str, Locator], known: DataFrame, base: str, page_size: int = 0, total: str = "", path_safe: bool = False, params: Params = ()) -> DataFrame:
    """asks(key, page, query) of a JSON listing: key, items with the fields of spec that have an address, has_next.

    A total counts if it is a JSON number; text does not, and a full page decides instead.
    """
    asks = page_urls(asks, path, base, page_size, api=True, path_safe=path_safe, params=params)
    got = _fetched(asks.select(key, "page", "_url"), F.col("_url"), known)
    found = F.transform(jsonpath.items(jsonpath.path("body", items)), lambda e: api_item(e, F.col("body"), spec))
    kept = F.coalesce(F.filter(found, lambda s: F.coalesce(s["url"], F.lit("")) != ""), F.array())
    got = got.withColumn("items", kept)
    full = F.lit(page_size > 0) & (F.size("items") >= page_size)
    number = jsonpath.number("body", total) if total else F.lit(None).cast("double")
    return got.select(key, "items", F.when(number.isNotNull(), F.col("page") * page_size < number).otherwise(full).alias("has_next"))


def tag_asks(asks: DataFrame, included: str = "included") -> DataFrame:
    """Asks of a tag page as listing asks: the first included tag is the query; an ask without one has no page."""
    return asks.where(F.size(included) > 0).withColumn("query", F.get(included, F.lit(0)))


def details(
    items: DataFrame, key: str, known: DataFrame, base: str, fields: Mapping[str, Locator], genres: tuple[str, str] | None = None, rows: Mapping | None = None, kept: Sequence[str] = ("title", "cover", "banner", "background"),
    absolute: Sequence[str] = ("cover", "banner", "background"), statuses: Mapping[str, str] | None = None, unlisted: tuple[str, str] | None = None,
) -> DataFrame:
    """items(key, url and columns of the fields) with what their pages say; without a response an item stays as it is.

    An empty finding keeps the old value of the columns in kept and empties the others; those in absolute are resolved. rows
    names selectors row, label and value, and labels and joins by field: what labelled rows say of a field goes before its
    locator, the first of them for status, which is mapped by statuses, and all of them for genres. genres are a list;
    unlisted (selector, attribute) gives a column of the first number there, 0 without one.
    """
    got = _fetched(items.select(key, "url"), urls.resolve(F.lit(base), "url"), known)
    pages = got.select(key, F.col("body").alias("html"))
    wanted = {**fields, **({"unlisted": Locator(selector=unlisted[0], attr=unlisted[1])} if unlisted else {})}
    found = fused.firsts(pages, key, steps._markup(wanted))
    found = got.select(key).join(found, key, "left").select(key, *[steps._chained(name, at).alias(f"_{name}") for name, at in wanted.items()])
    found = found.withColumns({f"_{name}": urls.resolve(F.lit(base), f"_{name}") for name in absolute if name in fields})
    if unlisted:
        found = found.withColumn("_unlisted", text.first_digits("_unlisted"))
    if genres:
        told = fused.matches(pages, key, genres[0], {"v": genres[1]}).where("v <> ''")
        told = told.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("_genres"))
        found = found.join(told, key, "left").withColumn("_genres", F.coalesce("_genres", F.array().cast("array<string>")))
    labels = rows["labels"] if rows else {}
    if labels:
        told = extract.label_values(fused.labelled(pages, key, rows["row"], rows["label"], rows.get("value", "")), key, labels)
        told = told.groupBy(key).agg(*[F.max(F.when(F.col("field") == name, F.col("values"))).alias(f"_row_{name}") for name in labels])
        found = found.join(told, key, "left")
        for name in labels:
            joined = F.array_join(f"_row_{name}", (rows.get("joins") or {}).get(name, ", "))
            own = F.col(f"_row_{name}") if name == "genres" else text.status(F.get(f"_row_{name}", F.lit(0)), statuses) if name == "status" else joined
            first = F.when(F.col(f"_row_{name}").isNotNull(), own)
            found = found.withColumn(f"_{name}", F.coalesce(first, *([F.col(f"_{name}")] if f"_{name}" in found.columns else [])))
    named = [*dict.fromkeys([*wanted, *(["genres"] if genres else []), *labels])]
    out = items.join(found.withColumn("_read", F.lit(True)), key, "left")
    for name in named:
        old = F.col(name) if name in items.columns else F.lit(None)
        new = F.col(f"_{name}")
        if name in kept:
            new = F.coalesce(F.nullif(new, F.lit("")), old)
        elif name in labels and name not in fields and not (name == "genres" and genres):
            new = F.coalesce(new, old)
        out = out.withColumn(name, F.when(F.col("_read"), new).otherwise(old))
    return out.select(*items.columns, *[n for n in named if n not in items.columns])


def api_details(items: DataFrame, key: str, path: str, at: str, spec: Mapping[str, Locator], known: DataFrame, base: str, kept: Sequence[str] = ("title", "cover"), genres: tuple[str, str] | None = None) -> DataFrame:
    """items(key, url, columns of spec) with what JSON details say: {url} in path; no item leaves them as they are.

    Nor does an item change anything whose url, where spec names one, is empty. description loses its markup; genres, a list
    and the value in its elements, replace the old ones unless there are none.
    """
    got = _fetched(items.select(key, "url"), F.concat(F.lit(base), text.substitute(F.lit(path), {"url": F.col("url")})), known)
    item = jsonpath.path("body", at) if at else F.col("body")
    got = got.withColumn("_item", item).where("_item IS NOT NULL").select(key, api_item(F.col("_item"), F.col("body"), spec).alias("_new"), *([jsonpath.list_of(F.col("_item"), *genres).alias("_genres")] if genres else []))
    if "url" in spec:
        got = got.where(F.coalesce("_new.url", F.lit("")) != "")
    out = items.join(got, key, "left")
    for name in spec:
        new, old = F.col(f"_new.{name}"), F.col(name)
        new = text.plain_text(new) if name == "description" else new
        if name != "url":
            out = out.withColumn(name, F.when(F.col("_new").isNull(), old).otherwise(F.coalesce(F.nullif(new, F.lit("")), old) if name in kept else new))
    if genres:
        old = F.col("genres") if "genres" in items.columns else F.array().cast("array<string>")
        out = out.withColumn("genres", F.when(F.size(F.coalesce("_genres", F.array().cast("array<string>"))) > 0, F.col("_genres")).otherwise(old))
    return out.select(*items.columns, *(["genres"] if genres and "genres" not in items.columns else []))


def chapters(items: DataFrame, key: str, config: Mapping[str, str], known: DataFrame, base: str, newest_first: bool = True) -> DataFrame:
    """Chapters of items(key, url) in markup: key, pos, url, name, uploaded, locked, official; newest_first turns pos round."""
    runs = items.select(key, F.create_map(F.lit("url"), urls.resolve(F.lit(base), "url")).alias("vars"))
    wanted = steps.chapters_steps(config)
    found = steps.run(runs, key, wanted, known, base).withColumn("page", F.lit(1))
    return told_chapters(found, key, config, base, newest_first)


def told_chapters(found: DataFrame, key: str, config: Mapping[str, str], base: str, newest_first: bool = True) -> DataFrame:
    """Records of a chapters pipeline (key, page, pos, url and more) as chapters."""
    field = lambda name: F.col(name) if name in found.columns else F.lit("")
    official = F.contains(field("official"), F.lit(config["officialValue"])) if config.get("officialValue") else F.lit(False)
    rows = found.select(key, "page", F.col("pos").alias("_pos"), "url", field("name").alias("name"), text.source_date(field("date")).alias("uploaded"), (field("locked") == "1").alias("locked"), official.alias("official"))
    told = feeds.chapters(rows, key, ["page", "_pos"], newest_first=newest_first)
    return told.select(key, "pos", urls.resolve(F.lit(base), "url").alias("url"), "name", "uploaded", "locked", "official")


def api_chapters(items: DataFrame, key: str, path: str, at: str, spec: Mapping[str, Locator], known: DataFrame, base: str, page_size: int, total: str = "", skip_if: str = "", max_items: int = 1000, ceiling: int = 10_000, name_parts: Sequence[str] = (), join: str = " ", default: str = "", locked: str = "", official: str = "") -> DataFrame:
    """Chapters of items(key, url) in a JSON feed: key, pos and the fields of spec, number as a double (-1 without one).

    A name may be joined from name_parts, paths of the item; a date of spec becomes the time uploaded; locked and official
    are paths whose value counts as true unless it is false, zero or empty.

    Pages follow until one is empty, the total (at most ceiling; max_items where none is told) is reached, or no total is
    told and a page is short. Each round asks for as many pages as all before, of the feeds that go on, so for no more than
    twice as many as there are and one; there are as many rounds as the longest feed's pages have binary digits.
    """

    def asked(feed: DataFrame, numbers: Column) -> DataFrame:
        each = feed.select(key, "url", F.explode(numbers).alias("page"))
        offset = (F.col("page") - 1) * page_size
        filled = text.substitute(F.lit(path), {"url": F.col("url"), "page": F.col("page").cast("string"), "offset": offset.cast("string")})
        got = _fetched(each.select(key, "page", F.concat(F.lit(base), filled).alias("_asked")), F.col("_asked"), known)
        got = got.withColumns({"data": F.coalesce(jsonpath.items(jsonpath.path("body", at)), F.array().cast("array<string>")), "total": text.lenient_int(jsonpath.path("body", total)) if total else F.lit(None).cast("bigint")})
        limit = F.when(F.col("total").isNull(), F.lit(max_items)).otherwise(F.least("total", F.lit(ceiling)))
        ends = (F.size("data") == 0) | (F.col("page") * page_size >= limit) | (F.col("total").isNull() & (F.size("data") < page_size))
        return got.select(key, "page", "data", "body", ends.alias("ends"))

    # Pages 1, 2 and 3, 4 to 7 and so on, each time of the feeds that answered all before and go on.
    found, going, begin, most = None, items, 1, -(-max(max_items, ceiling) // page_size) + 1
    by = Window.partitionBy(key)
    while True:
        until = min(2 * begin - 1, most)
        told = asked(going, F.sequence(F.lit(begin), F.lit(until)))
        told = told.withColumns({"_n": F.row_number().over(by.orderBy("page")), "_end": F.min(F.when(F.col("ends"), F.col("page"))).over(by)})
        told = cut(told.where((F.col("_n") == F.col("page") - begin + 1) & (F.col("page") <= F.coalesce("_end", F.col("page")))).drop("_n", "_end"))
        found = told if found is None else found.unionByName(told)
        on = told.where((F.col("page") == until) & ~F.col("ends"))
        if until == most or on.isEmpty():
            break
        going, begin = items.join(on.select(key), key, "left_semi"), until + 1
    rows = found.select(key, "page", "body", F.posexplode("data").alias("_pos", "item"))
    if skip_if:
        rows = rows.where(jsonpath.path("item", skip_if).isNull())
    more = {"name": jsonpath.name_of(F.col("item"), list(name_parts), join, default)} if name_parts else {}
    more |= {name: text.truthy(jsonpath.path("item", at)) for name, at in (("locked", locked), ("official", official)) if at}
    rows = rows.select(key, "page", "_pos", api_item(F.col("item"), F.col("body"), spec).alias("c"), *[c.alias(name) for name, c in more.items()])
    rows = rows.select(key, "page", "_pos", "c.*", *more).where("url <> ''")
    if "date" in spec:
        rows = rows.withColumn("uploaded", text.source_date("date")).drop("date")
    if "number" in spec:
        rows = rows.withColumn("number", text.number_or("number"))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("page", "_pos")) - 1
    return rows.withColumn("pos", pos.cast("int")).drop("page", "_pos")


def pages(items: DataFrame, key: str, config: Mapping[str, str], known: DataFrame, base: str) -> DataFrame:
    """Images of items(key, url): key, pos, value; where a script gives none, those of imageSelector if it is named."""
    runs = items.select(key, F.create_map(F.lit("url"), urls.resolve(F.lit(base), "url")).alias("vars"))
    found = steps.run(runs, key, steps.pages_steps(config), known, base)
    if config.get("scriptRegex") and config.get("imageSelector"):
        plain = {k: v for k, v in config.items() if k != "scriptRegex"}
        without = runs.join(found.select(key).distinct(), key, "left_anti")
        found = found.unionByName(steps.run(without, key, steps.pages_steps(plain), known, base))
    return found.where("value <> ''").select(key, "pos", urls.resolve(F.lit(base), "value").alias("value"))


def api_pages(items: DataFrame, key: str, path: str, at: str, template: str, known: DataFrame, base: str) -> DataFrame:
    """Images of items(key, url) in JSON: key, pos, value by a template over {value}, the element and the body. No list is an error."""
    got = _fetched(items.select(key, F.concat(F.lit(base), text.substitute(F.lit(path), {"url": F.col("url")})).alias("_asked")), F.col("_asked"), known)
    listed = jsonpath.items(jsonpath.path("body", at))
    listed = F.coalesce(listed, F.raise_error(F.lit("no list of pages in a response")).cast("array<string>"))
    each = got.select(key, "body", F.posexplode(listed).alias("pos", "item"))
    value = jsonpath.template(template, F.col("item"), F.col("body"), value=F.col("item"))
    return each.select(key, "pos", urls.resolve(F.lit(base), value).alias("value"))


def scraped_options(asks: DataFrame, key: str, selector: str, value_attr: str, known: DataFrame, base: str, label: str = "", static: DataFrame | None = None) -> DataFrame:
    """Options of a filter on the pages of asks(key, url), by label: key, pos, option_id, label (the id without one).

    Asks whose page gives none get the options of static(key, pos, option_id, label).
    """
    got = _fetched(asks.select(key, "url"), urls.resolve(F.lit(base), "url"), known)
    found = fused.records(got.select(key, F.col("body").alias("html")), key, selector, {"option_id": ("", value_attr, False), "label": (label, "", False)})
    found = found.where("option_id <> ''").withColumn("label", text.first_filled("label", "option_id"))
    by = Window.partitionBy(key).orderBy("label", "option_id", "pos")
    found = found.select(key, (F.row_number().over(by) - 1).cast("int").alias("pos"), "option_id", "label")
    if static is None:
        return found
    return found.unionByName(static.join(found.select(key).distinct(), key, "left_anti").select(key, "pos", "option_id", "label"))
