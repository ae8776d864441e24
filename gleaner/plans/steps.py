"""Pipelines of steps: each step asks for a response, reads values from it, and the first with an output ends the run.

All runs go through a step together: a request is a join with captured responses, a capture adds to a run's variables, an
output explodes a run into rows. Nothing loops over runs. A step without a request reads the body of the one before. A
response that is missing or not 200 ends its run without rows; a body that cannot be read gives no values, and its captures
leave the variables as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import crypto, jsonpath, text, urls
from gleaner.operators import extract
from gleaner.sources import fused, responses
from gleaner.sources.store import cut

Runtime = Callable[[str, Column], Column]
PARSES = ("html", "json", "regexJson", "jsonHtml")
# Fixed value: how scripts are inlined in pages.
_SCRIPT = r"data:text/javascript;base64,([A-Za-z0-9+/=]+)"
PREVIEW = 500


@dataclass(frozen=True)
class Locator:
    """Where a value stands: a pattern over the body, a selector with an attribute, or a JSON path.

    A filled value goes through the template, over {value} and the run's variables (in JSON also paths of the item and the
    body), and through rewrite, (find, pattern, replacement). exists gives '1' or '' for whether anything is there; otherwise
    are locators to try in order where nothing is found. Of captures, source names a variable that the pattern reads instead
    of the body, and encode escapes the value as a part of a path. Of flat lists, lazy takes data-src where the attribute is
    missing, inline data, or that of several items. Of items, values takes those of an object, too.
    """

    path: str = ""
    template: str = ""
    selector: str = ""
    attr: str = ""
    regex: str = ""
    default: str = ""
    exists: bool = False
    otherwise: tuple[Locator, ...] = ()
    rewrite: tuple[str, str, str] | None = None
    source: str = ""
    encode: bool = False
    lazy: bool = False
    values: bool = False

    def chain(self) -> list[Locator]:
        return [self, *[later for one in self.otherwise for later in one.chain()]]


@dataclass(frozen=True)
class Script:
    """Code for a script runtime: args are filled from the variables; the trimmed result is captured, or paths of its JSON."""

    code: str
    args: Mapping[str, str] = field(default_factory=dict)
    capture: str = ""
    capture_json: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Decrypt:
    """An envelope and its password, filled from the variables; the plain text is captured, or read as the step's body."""

    data: str
    password: str
    capture: str = ""


@dataclass(frozen=True)
class Transform:
    """A request made from the variable that the step names as base: its first match replaced and a suffix, or a url with {id}.

    The body's group references are filled from the match; {id} is the variable of that name.
    """

    pattern: str = ""
    replace: str = ""
    suffix: str = ""
    url: str = ""
    body: str = ""


@dataclass(frozen=True)
class Pagination:
    """How a pipeline is run page after page: by a meta that says a page follows, or by a current and a last number."""

    page_var: str = "page"
    current_page_meta: str = ""
    last_page_meta: str = ""
    has_next_meta: str = ""
    max_pages: int = 50


@dataclass(frozen=True)
class Output:
    """One row for each item, with its fields; no items: one row for a body. A single field named value makes a flat list.

    Flat lists leave out empty values. With a count they are not read but made: the value's template once for each number
    {n} from start, padded with zeros.
    """

    items: Locator = field(default_factory=Locator)
    fields: Mapping[str, Locator] = field(default_factory=dict)
    meta: Mapping[str, Locator] = field(default_factory=dict)
    count: Locator | None = None
    start: int = 1
    pad: int = 0

    @property
    def flat(self) -> bool:
        return list(self.fields) == ["value"]


@dataclass(frozen=True)
class Step:
    """A request, by url or base, or a script or decryption instead; how its body is read; what is captured or put out."""

    url: str | None = None
    method: str = "GET"
    body: str = ""
    parse: str = "html"
    regex: str = ""
    html_from: str = ""
    capture: Mapping[str, Locator] = field(default_factory=dict)
    output: Output | None = None
    script: Script | None = None
    decrypt: Decrypt | None = None
    base: str = ""
    transform: Transform | None = None
    headers: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.parse not in PARSES:
            raise ValueError(f"parse is one of {PARSES}, not {self.parse!r}")

    @property
    def asks(self) -> bool:
        return self.url is not None or bool(self.base) or self.transform is not None

    def templates(self) -> list[str]:
        """All texts that are filled from variables."""
        at = [*self.capture.values(), *(self.output.fields.values() if self.output else ()), *(self.output.meta.values() if self.output else ())]
        filled = [one.template for found in at for one in found.chain()] + [f"{{{one.source}}}" for one in self.capture.values() if one.source]
        made = [*self.script.args.values()] if self.script else [self.decrypt.data, self.decrypt.password] if self.decrypt else []
        return [self.url or "", self.body, f"{{{self.base}}}", *self.headers.values(), *filled, *made, *(["{id}"] if self.transform else [])]


def added(known: Column, new: Column) -> Column:
    """Variables with new ones, which replace those of their name in its place; a new one that is null changes nothing."""
    kept = F.transform(F.map_entries(known), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.element_at(new, e["key"]), e["value"]).alias("value")))
    later = F.filter(F.map_entries(new), lambda e: e["value"].isNotNull() & ~F.map_contains_key(known, e["key"]))
    return F.map_from_entries(F.concat(kept, later))


def substituted(template: str, variables: Column | str = "vars", **more: Column) -> Column:
    """{name} replaced by the run's variable, one name after the other, so later ones fill what earlier ones brought in."""
    if "{" not in template:
        return F.lit(template)
    entries = F.map_entries(text.col(variables))
    if more:
        entries = F.concat(F.filter(entries, lambda e: ~e["key"].isin(*more)), F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in more.items()]))
    return F.aggregate(entries, F.lit(template), lambda out, e: F.replace(out, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def regex_json(body: Column | str, pattern: str) -> Column:
    """The JSON text of the pattern's first group, looked for in the body and then in its inlined data scripts; broken ones are skipped."""
    scripts = F.transform(F.regexp_extract_all(text.col(body), F.lit(_SCRIPT), 1), lambda s: F.try_to_binary(s, F.lit("base64")).cast("string"))
    whole = F.filter(scripts, lambda s: s.isNotNull() & F.is_valid_utf8(s))
    return text.first_filled(text.capture(body, pattern), text.capture(F.array_join(whole, "\n"), pattern))


def _json(step: Step) -> Column:
    """The body's JSON text, unwrapped where it is a JSON text in a JSON string; null if it is none."""
    whole = regex_json("body", step.regex) if step.parse == "regexJson" else F.col("body")
    return F.when(F.try_parse_json(whole).isNotNull(), jsonpath.unwrapped(F.trim(whole)))


def _pages(rows: DataFrame, key: str, step: Step) -> DataFrame:
    lifted = jsonpath.path("body", step.html_from) if step.parse == "jsonHtml" else F.col("body")
    return rows.select(key, lifted.alias("html"))


def _request(step: Step) -> tuple[Column, Column | None]:
    """Where a step's request goes, before it is resolved, and its body."""
    body = substituted(step.body) if step.body else None
    if step.transform is not None:
        t = step.transform
        src, own = (F.coalesce(F.element_at("vars", F.lit(name)), F.lit("")) for name in (step.base, "id"))
        made = F.lit(t.url) if t.url else text.replace_first(src, t.pattern, t.replace, t.suffix) if t.pattern else F.concat(src, F.lit(t.suffix))
        if t.body:
            body = F.replace(text.expand_groups(src, t.pattern, t.body) if t.pattern else F.lit(t.body), F.lit("{id}"), own)
        return F.replace(made, F.lit("{id}"), own), body
    return substituted(step.url) if step.url else F.coalesce(F.element_at("vars", F.lit(step.base)), F.lit("")), body


def _asked(rows: DataFrame, step: Step, known: DataFrame, base: str) -> DataFrame:
    """rows with the body of their response and, for a trace, asked_url; what is not answered by 200 goes."""
    url, body = _request(step)
    rows = rows.drop("body", "asked_url", "asked_headers").withColumn("_reference", url)
    asked = responses.request(rows, urls.resolve(F.lit(base), "_reference"), step.method.upper(), body)
    sent = F.create_map(*[x for n, t in step.headers.items() for x in (F.lit(n), substituted(t))]) if step.headers else F.create_map().cast("map<string,string>")
    got = responses.fetch(asked, known).where("status = 200").withColumns({"asked_url": F.col("url"), "asked_headers": sent})
    return got.drop(*responses.KEY, "status", "headers", "_reference")


def _markup(wanted: Mapping[str, Locator]) -> dict[str, tuple[str, str, bool]]:
    """The alternatives of all locators, named name_0, name_1 and so on; lazy ones also by their data-src."""
    out = {}
    for name, at in wanted.items():
        for i, one in enumerate(at.chain()):
            out[f"{name}_{i}"] = (one.selector, one.attr, one.exists)
            if one.lazy:
                out[f"{name}_{i}_lazy"] = (one.selector, "data-src", False)
    return out


def _filled(value: Column, one: Locator, variables: Column | str | None) -> Column:
    """A markup value through its locator's template and rewrite; nothing stays nothing."""
    if one.exists:
        return value
    found = F.nullif(value, F.lit(""))
    if one.template and one.template != "{value}":
        found = F.when(found.isNotNull(), substituted(one.template, variables if variables is not None else F.create_map().cast("map<string,string>"), value=found))
    return text.rewrite(found, find=one.rewrite[0] or None, pattern=one.rewrite[1] or None, replace=one.rewrite[2]) if one.rewrite else found


def _chained(name: str, at: Locator, variables: Column | str | None = None, within: str | None = None) -> Column:
    tried = []
    for i, one in enumerate(at.chain()):
        value = F.col(f"{name}_{i}")
        if one.lazy and within is not None:
            value = extract.lazy_source(value, F.col(f"{name}_{i}_lazy"), within)
        tried.append(_filled(value, one, variables))
    return text.first_filled(*tried, F.lit(at.default))


def _in_json(item: Column, at: Locator, root: Column | None = None, variables: Column | None = None) -> Column:
    tried = []
    for one in at.chain():
        node = jsonpath.path(item, one.path) if one.path else item
        if one.exists:
            tried.append(F.when(node.isNotNull(), "1"))
            continue
        found = F.nullif(node, F.lit(""))
        if one.template and one.template != "{value}":
            found = F.when(found.isNotNull(), jsonpath.template(one.template, item, root, variables, found))
        if one.rewrite:
            found = text.rewrite(found, find=one.rewrite[0] or None, pattern=one.rewrite[1] or None, replace=one.rewrite[2])
        tried.append(found)
    return text.first_filled(*tried, F.lit(at.default))


def _found(rows: DataFrame, key: str, step: Step, wanted: Mapping[str, Locator], missing: Column | None = None) -> DataFrame:
    """rows with a column for each locator over the whole body; patterns read it as it is, whatever the parse mode.

    What is to be read in JSON and stands in a body that is none becomes missing.
    """
    markup = {name: at for name, at in wanted.items() if not at.regex and (step.parse == "html" or (step.parse == "jsonHtml" and not at.path))}
    columns = {}
    for name, at in wanted.items():
        if at.regex:
            read = F.coalesce(F.element_at("vars", F.lit(at.source)), F.lit("")) if at.source else F.col("body")
            columns[name] = text.first_filled(text.capture(read, at.regex), F.lit(at.default))
        elif name not in markup:
            value = _in_json(F.col("_json"), at, F.col("_json"), F.col("vars"))
            columns[name] = F.when(F.col("_json").isNotNull(), value).otherwise(F.lit("") if missing is None else missing)
    out = rows.withColumn("_json", _json(step)).withColumns(columns).drop("_json") if columns else rows
    if markup:
        out = out.join(fused.firsts(_pages(rows, key, step), key, _markup(markup)), key, "left")
        out = out.withColumns({name: _chained(name, at, "vars") for name, at in markup.items()}).drop(*_markup(markup))
    for name, at in wanted.items():
        if at.encode:
            out = out.withColumn(name, urls.encode_component(name))
    return out


def _with(rows: DataFrame, got: Mapping[str, Column]) -> DataFrame:
    """rows with further variables, and those alone in got, for a trace."""
    new = F.create_map(*[x for name, value in got.items() for x in (F.lit(name), value)]) if got else F.create_map().cast("map<string,string>")
    return rows.withColumn("got", new).withColumn("vars", added(F.col("vars"), F.col("got")))


def _captured(rows: DataFrame, key: str, step: Step) -> DataFrame:
    found = _found(rows, key, step, {f"_c_{name}": at for name, at in step.capture.items()}, F.lit(None).cast("string"))
    return _with(found, {name: F.col(f"_c_{name}") for name in step.capture}).select(*dict.fromkeys([*rows.columns, "got"]))


def _scripted(rows: DataFrame, script: Script, runtime: Runtime | None) -> DataFrame:
    if runtime is None:
        raise RuntimeError("a script step needs a runtime")
    args = F.to_json(F.create_map(*[x for name, t in script.args.items() for x in (F.lit(name), substituted(t))])) if script.args else F.lit("{}")
    rows = rows.withColumn("_result", text.trim(runtime(script.code, args)))
    got = {script.capture: F.col("_result")} if script.capture else {}
    for name, path in script.capture_json.items():
        got[name] = F.coalesce(jsonpath.path("_result", path) if path else F.col("_result"), F.lit(""))
    return _with(rows, got).drop("_result")


def _decrypted(rows: DataFrame, decrypt: Decrypt) -> DataFrame:
    rows = rows.withColumns({"_data": substituted(decrypt.data), "_password": substituted(decrypt.password)})
    rows = rows.withColumn("body", crypto.decrypt_envelope("_data", F.col("_password"))).drop("_data", "_password")
    return _with(rows, {decrypt.capture: F.col("body")}) if decrypt.capture else rows


def _made(rows: DataFrame, key: str, step: Step, out: Output) -> DataFrame:
    """A flat list by a count: a row for each number."""
    at = out.count
    counted = _found(rows, key, step, {"_count": replace(at, template="", rewrite=None)})
    counted = counted.withColumn("_n", F.coalesce(text.strict_int("_count") if not at.path else text.lenient_int("_count"), F.lit(0)))
    numbers = text.generated(F.col("_n"), "{n}", out.start, out.pad)
    each = counted.select(key, "vars", F.posexplode(numbers).alias("pos", "_i"))
    return each.select(key, "pos", substituted(out.fields["value"].template, "vars", n=F.col("_i")).alias("value"))


def _records(rows: DataFrame, key: str, step: Step, out: Output) -> DataFrame:
    if out.count is not None:
        return _made(rows, key, step, out)
    if step.parse in ("html", "jsonHtml"):
        found = fused.records(_pages(rows, key, step), key, out.items.selector, _markup(out.fields))
        if any(one.template for at in out.fields.values() for one in at.chain()):
            found = found.join(rows.select(key, "vars"), key)
        known = F.col("vars") if "vars" in found.columns else None
        found = found.select(key, "pos", *[_chained(name, at, known, key if out.flat else None).alias(name) for name, at in out.fields.items()])
    else:
        whole = rows.select(key, "vars", _json(step).alias("root"))
        items = jsonpath.items(jsonpath.path("root", out.items.path) if out.items.path else F.col("root"), out.items.values)
        items = whole.select(key, "vars", "root", F.posexplode(items).alias("pos", "item"))
        found = items.select(key, "pos", *[_in_json(F.col("item"), at, F.col("root"), F.col("vars")).alias(name) for name, at in out.fields.items()])
    if out.flat:
        place = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
        return found.where("value <> ''").withColumn("pos", place.cast("int"))
    return found


def _begun(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "vars", *([F.col("body")] if "body" in rows.columns else [F.lit("").alias("body")]))


def _advanced(rows: DataFrame, key: str, step: Step, known: DataFrame, base: str, runtime: Runtime | None) -> DataFrame:
    """rows after a step's script or decryption, request and captures."""
    rows = rows.drop("got", "asked_url", "asked_headers")
    if step.script is not None:
        rows = _scripted(rows, step.script, runtime)
    if step.decrypt is not None:
        rows = _decrypted(rows, step.decrypt)
    if step.asks:
        rows = _asked(rows, step, known, base)
    return _captured(rows, key, step) if step.capture else rows


def _reached(rows: DataFrame, key: str, steps: Sequence[Step], known: DataFrame, base: str, runtime: Runtime | None) -> tuple[DataFrame, Step | None]:
    """rows at the first step with an output, and that step."""
    rows = _begun(rows, key)
    for step in steps:
        rows = _advanced(rows, key, step, known, base, runtime)
        if step.output is not None:
            return rows.select(key, "vars", "body"), step
    return rows.where(F.lit(False)), None


def _told(rows: DataFrame, key: str, step: Step | None) -> tuple[DataFrame, DataFrame]:
    if step is None:
        return rows.select(key, F.lit(0).alias("pos")), rows.select(key)
    told = {f"_m_{name}": at for name, at in step.output.meta.items()}
    meta = _found(rows, key, step, told) if told else rows
    return _records(rows, key, step, step.output), meta.select(key, *[F.col(f"_m_{name}").alias(name) for name in step.output.meta])


def run_parts(rows: DataFrame, key: str, steps: Sequence[Step], known: DataFrame, base: str = "", runtime: Runtime | None = None) -> tuple[DataFrame, DataFrame]:
    """The records of the first output, and key with its meta for every run that reached it, records or none."""
    rows, step = _reached(rows, key, steps, known, base, runtime)
    return _told(rows, key, step)


def run(rows: DataFrame, key: str, steps: Sequence[Step], known: DataFrame, base: str = "", runtime: Runtime | None = None) -> DataFrame:
    """rows(key, vars) through the steps over known responses: key, pos, the fields and the meta of the first output.

    known has the request's key columns, status, headers and body as text. Without an output there are no rows. A script
    step calls runtime(code, args as JSON text), a column expression such as a Pandas UDF; without one it is an error.
    """
    found, meta = run_parts(rows, key, steps, known, base, runtime)
    return found.join(meta, key) if len(meta.columns) > 1 else found


def _lasting(steps: Sequence[Step], page_var: str) -> int:
    """How many steps at the beginning say the same on every page: none of their texts names the page, and none puts out."""
    for i, step in enumerate(steps):
        if step.output is not None or any(f"{{{page_var}}}" in t for t in step.templates()):
            return i
    return len(steps)


def paged(rows: DataFrame, key: str, steps: Sequence[Step], known: DataFrame, base: str = "", pages: Pagination | None = None, runtime: Runtime | None = None) -> tuple[DataFrame, DataFrame]:
    """The records of all pages of each run (key, page, pos, fields), and the meta of its last page (key, page, meta).

    Steps that don't name the page are done once. Then the runs that go on ask for their next page, all in one join, page
    after page, until none does: no run asks for more than one page beyond its last. A run that brings a page along begins
    there; its later pages are 2, 3 and so on. Each page's rows are cut off, so no plan holds the pages before.
    """
    pages = pages or Pagination()
    if pages.has_next_meta:
        follows = F.col(pages.has_next_meta) == "1"
    elif pages.current_page_meta and pages.last_page_meta:
        follows = F.coalesce(text.strict_int(pages.current_page_meta) < text.strict_int(pages.last_page_meta), F.lit(False))
    else:
        follows = F.lit(False)
    first = _lasting(steps, pages.page_var)
    going = cut(run_body(rows, key, steps[:first], known, base, runtime))
    found = last = None
    for page in range(1, pages.max_pages + 1):
        named = F.create_map(F.lit(pages.page_var), F.lit(str(page)))
        at = going.withColumn("vars", added(named, F.col("vars")) if page == 1 else added(F.col("vars"), named))
        answered, step = _reached(at, key, steps[first:], known, base, runtime)
        records, meta = _told(cut(answered), key, step)
        records, meta = records.withColumn("page", F.lit(page)), cut(meta.withColumns({"page": F.lit(page), "_on": follows}))
        found = records if found is None else found.unionByName(records)
        last = meta if last is None else last.unionByName(meta)
        on = meta.where("_on")
        if page == pages.max_pages or on.isEmpty():
            break
        going = cut(going.join(on.select(key), key, "left_semi"))
    names = [c for c in last.columns if c not in (key, "_on")]
    last = last.groupBy(key).agg(F.max_by(F.struct(*names), "page").alias("_l")).select(key, *[f"_l.{c}" for c in names])
    return found.select(key, "page", *[c for c in found.columns if c not in (key, "page")]), last


def run_body(rows: DataFrame, key: str, steps: Sequence[Step], known: DataFrame, base: str = "", runtime: Runtime | None = None) -> DataFrame:
    """key, vars and the last body, for those who read it themselves."""
    rows = _begun(rows, key)
    for step in steps:
        rows = _advanced(rows, key, step, known, base, runtime)
    return rows.select(key, "vars", "body")


def run_json(rows: DataFrame, key: str, steps: Sequence[Step], known: DataFrame, base: str = "", runtime: Runtime | None = None, strict: bool = True) -> DataFrame:
    """key, vars and root, the last body as a VARIANT. A body that is no JSON is an error, or a null root where not strict."""
    body = run_body(rows, key, steps, known, base, runtime)
    return body.select(key, "vars", (F.parse_json("body") if strict else F.try_parse_json("body")).alias("root"))


def trace(rows: DataFrame, key: str, steps: Sequence[Step], known: DataFrame, base: str = "", runtime: Runtime | None = None) -> DataFrame:
    """What each step of each run did: key, step (from 0), method, url, headers, captured, preview, body, terminal.

    A run has no row for a step that was not answered, nor for later ones. preview is the first PREVIEW characters of the
    body, or of the code of a script. All steps' rows come from one chain of joins, read once more for each step.
    """
    rows, out = _begun(rows, key), None
    none = F.create_map().cast("map<string,string>")
    for i, step in enumerate(steps):
        rows = _advanced(rows, key, step, known, base, runtime)
        shown = F.ltrim(F.lit(step.script.code) if step.script is not None else F.col("body"))
        one = rows.select(
            key, F.lit(i).alias("step"), F.lit(step.method.upper() if step.asks else "GET").alias("method"), (F.col("asked_url") if step.asks else F.lit(None).cast("string")).alias("url"),
            (F.col("asked_headers") if step.asks else none).alias("headers"), (F.col("got") if "got" in rows.columns else none).alias("captured"),
            F.when(F.length(shown) > PREVIEW, F.concat(F.substring(shown, 1, PREVIEW), F.lit("…"))).otherwise(shown).alias("preview"), "body", F.lit(step.output is not None or i == len(steps) - 1).alias("terminal"),
        )
        out = one if out is None else out.unionByName(one)
        if step.output is not None:
            break
    return out


def listing_steps(config: Mapping) -> list[Step]:
    """The one step of a short listing description: items with title, url and, where named, cover; has_next is '1' or ''.

    A cover is named by coverSelector and coverAttr or by coverChain, pairs of these to try in order; a method POST sends body.
    """
    fields = {
        "title": Locator(selector=config.get("titleSelector", ""), attr=config.get("titleAttr", "")),
        "url": Locator(selector=config.get("urlSelector", ""), attr=config.get("urlAttr", "href")),
    }
    if config.get("coverChain"):
        fields["cover"] = cover_locator(config["coverChain"])
    elif config.get("coverSelector"):
        fields["cover"] = cover_locator([(config["coverSelector"], config.get("coverAttr", "src"))])
    meta = {"has_next": Locator(selector=config["nextSelector"], exists=True)} if config.get("nextSelector") else {}
    out = Output(Locator(selector=config["itemSelector"]), fields, meta)
    return [Step(url=config["path"], method=config.get("method", "GET"), body=config.get("body", ""), headers=config.get("headers", {}), output=out)]


def cover_locator(chain: Sequence[tuple[str, str]]) -> Locator:
    """The first of several (selector, attribute) that gives anything."""
    (selector, attr), *rest = chain
    return Locator(selector=selector, attr=attr, otherwise=(cover_locator(rest),) if rest else ())


def chapters_steps(config: Mapping) -> list[Step]:
    """The steps of a short chapters description: where idSelector is named, a first step captures {id} for the request.

    The list is asked for by path, or by a Transform of the address.
    """
    fields = {"url": Locator(selector=config.get("urlSelector", ""), attr=config.get("urlAttr", "href"))}
    if config.get("nameSelector") or config.get("nameAttr"):
        fields["name"] = Locator(selector=config.get("nameSelector", ""), attr=config.get("nameAttr", ""))
    if config.get("dateSelector"):
        fields["date"] = Locator(selector=config["dateSelector"], attr=config.get("dateAttr", ""))
    if config.get("lockedSelector"):
        fields["locked"] = Locator(selector=config["lockedSelector"], exists=True)
    if config.get("officialSelector"):
        fields["official"] = Locator(selector=config["officialSelector"], attr=config.get("officialAttr", ""))
    lookup = Step(base="url", capture={"id": Locator(selector=config.get("idSelector", ""), attr=config.get("idAttr", ""))})
    out = Output(Locator(selector=config["itemSelector"]), fields)
    made = {"base": "url", "transform": config["transform"]} if config.get("transform") else {"url": config.get("path", "{url}"), "body": config.get("body", "")}
    listed = Step(method=config.get("method", "GET"), headers=config.get("headers", {}), output=out, **made)
    return [lookup, listed] if config.get("idSelector") or config.get("idAttr") else [listed]


def pages_steps(config: Mapping[str, str]) -> list[Step]:
    """The one step of a short pages description: images of the document, lazy ones by data-src, or of a JSON list inside a script."""
    if config.get("scriptRegex"):
        out = Output(Locator(path=config.get("path", "")), {"value": Locator(path=config.get("valuePath", ""), template=config.get("template", ""))})
        return [Step(url=config.get("url", "{url}"), parse="regexJson", regex=config["scriptRegex"], output=out)]
    value = Locator(attr=config.get("imageAttr", "src"), lazy=True)
    return [Step(url=config.get("url", "{url}"), output=Output(Locator(selector=config["imageSelector"]), {"value": value}))]
