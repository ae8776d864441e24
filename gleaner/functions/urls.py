"""URL functions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import col


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) for a use that reads value many times: bound once, so that nested expressions don't multiply in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encode_query(value: Column | str) -> Column:
    """Form encoding: blanks become +, all but letters, digits and -._~ is escaped."""
    return F.replace(F.replace(F.url_encode(col(value)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def encode_component(value: Column | str) -> Column:
    """Component encoding: blanks become %20, and -_.!~*'() stay."""
    out = F.replace(F.url_encode(col(value)), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def host(url: Column | str) -> Column:
    """The lower-cased host of an absolute URL, else null."""
    return F.nullif(F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda done, p: F.when(p == ".", done).when(p == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.array_append(done, p))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def resolve(base: Column | str, reference: Column | str) -> Column:
    """A reference against an absolute base URL; an empty reference stays empty."""
    return once(col(reference), lambda ref: _resolved(col(base), ref))


def _resolved(base: Column, ref: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    ref_path, ref_rest = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_extract(base_path, r"^(.*/)", 1))
    return (
        F.when(ref == "", "")
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(origin, base_path, base_query, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(origin, base_path, ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(origin, without_dots(ref_path), ref_rest))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, ref_path)), ref_rest))
    )


def _split(url: Column) -> tuple[Column, Column, Column]:
    return F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)


def _with_query(head: Column, query: Column, fragment: Column) -> Column:
    return F.concat(head, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), fragment)


def drop_empty_params(url: Column | str) -> Column:
    """Without the parameters none of whose values is filled."""
    return once(col(url), _without_empty)


def _without_empty(url: Column) -> Column:
    head, query, fragment = _split(url)
    parts = F.split(query, "&")
    name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    filled = F.transform(F.filter(parts, lambda p: p.rlike("=.")), name)
    kept = F.filter(parts, lambda p: F.array_contains(filled, name(p)))
    return _with_query(head, F.array_join(kept, "&"), fragment)


def _entry(name: str):
    return lambda v: F.concat(encode_query(F.lit(name)), F.lit("="), encode_query(v))


def append_params(url: Column | str, entries: Sequence[tuple[str, Column, str | None]]) -> Column:
    """Add (name, values, join): values repeated, or joined where join is given; no values add nothing."""
    return once(col(url), lambda one: _appended(one, entries))


def _appended(url: Column, entries: Sequence[tuple[str, Column, str | None]]) -> Column:
    head, query, fragment = _split(url)
    added = []
    for name, values, join in entries:
        values = F.coalesce(values, F.array().cast("array<string>"))
        one = F.when(F.size(values) > 0, F.array(F.array_join(values, join))).otherwise(F.array().cast("array<string>")) if join is not None else values
        added.append(F.transform(one, _entry(name)))
    every = F.concat(F.filter(F.split(query, "&"), lambda p: p != ""), *added)
    return _with_query(head, F.array_join(every, "&"), fragment)


def sorted_headers(headers: Column | str) -> Column:
    """Headers as one key, in name order whatever their case."""
    pairs = F.transform(F.map_entries(col(headers)), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), "&")
