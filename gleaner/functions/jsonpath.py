"""Dotted JSON paths as Spark columns over JSON text.

Segments: ``key``, ``key[3]``, ``key[name=value]`` (the first element whose name has that value), ``*`` (the first value
of an object in document order, or the first element); selectors may follow each other and ``*``. An empty segment stands
for the value itself. Any miss is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import col, first_filled, joined, render

OBJECT, LIST, OBJECTS = "map<string,string>", "array<string>", "array<map<string,string>>"


def _is(node: Column, opening: str) -> Column:
    return F.startswith(F.ltrim(node), F.lit(opening))


def items(node: Column, values: bool = False) -> Column:
    """Elements of a JSON list as JSON text; with values also the values of an object, in order. Null otherwise."""
    found = F.when(_is(node, "["), F.from_json(node, LIST))
    return F.coalesce(found, F.when(_is(node, "{"), F.map_values(F.from_json(node, OBJECT)))) if values else found


def _key(node: Column, key: str) -> Column:
    return F.when(_is(node, "{"), F.element_at(F.from_json(node, OBJECT), F.lit(key)))


def _pick(node: Column, selector: str) -> Column:
    if re.fullmatch(r"\d+", selector):
        return F.get(items(node), F.lit(int(selector)))
    name, equals, value = selector.partition("=")
    if not equals:
        return F.lit(None).cast("string")
    objects = F.when(_is(node, "["), F.from_json(node, LIST))
    return F.get(F.filter(objects, lambda e: F.element_at(F.from_json(e, OBJECT), F.lit(name)) == value), F.lit(0))


def _selectors(text: str) -> Iterator[str]:
    """The contents of "[a][b]..."; brackets that don't pair are an error."""
    while text:
        inner, closing, text = text[1:].partition("]")
        if not closing or "[" in inner or text[:1] not in ("", "["):
            raise ValueError("unpaired brackets")
        yield inner


def path(node: Column | str, dotted: str) -> Column:
    out = col(node)
    for segment in dotted.split("."):
        name, opening, rest = segment.partition("[")
        try:
            selectors = list(_selectors(opening + rest))
        except ValueError:
            return F.lit(None).cast("string")
        if "]" in name:
            return F.lit(None).cast("string")
        if name == "*":
            out = F.get(items(out, values=True), F.lit(0))
        elif name:
            out = _key(out, name)
        for selector in selectors:
            out = _pick(out, selector)
    return out


def scalar(node: Column) -> Column:
    """The value as template text; null for objects and lists, which templates refuse."""
    return F.when(_is(node, "{") | _is(node, "["), None).otherwise(node)


def template(text: str, item: Column, root: Column | None = None, variables: Mapping[str, Column] | Column | None = None, value: Column | None = None) -> Column:
    """{value}, {variable}, {path in item} or {path in root}, in that order of preference; null if one is missing.

    variables are columns by name, or one map column whose names are only known by row.
    """
    found: dict[str, Column] = {}
    for name in re.findall(r"\{([^{}]*)\}", text):
        if name == "value" and value is not None:
            found[name] = value
        elif isinstance(variables, Mapping) and name in variables:
            found[name] = variables[name]
        else:
            own = [scalar(path(item, name)), *([scalar(path(root, name))] if root is not None else [])]
            found[name] = F.coalesce(*([F.element_at(variables, F.lit(name))] if isinstance(variables, Column) else []), *own)
    return render(text, found)


def value_of(item: Column, paths: list[str], fill: str = "", default: str = "", root: Column | None = None) -> Column:
    """The first filled path, put through a template; the default if every path misses."""
    found = F.nullif(first_filled(*[path(item, p) for p in paths]), F.lit("")) if paths else F.lit("")
    shown = template(fill, item, root, value=found) if fill else found
    return F.when(found.isNull(), F.lit(default)).otherwise(shown)


def list_of(item: Column, at: str, value: str) -> Column:
    """A filled value of each element of the list at a path."""
    return F.filter(F.transform(items(path(item, at)), lambda e: F.coalesce(path(e, value), F.lit(""))), lambda v: v != "")


def name_of(item: Column, parts: list[str], join: str = " ", default: str = "") -> Column:
    return joined([path(item, p) for p in parts], join, default)


def unwrapped(node: Column, times: int = 5) -> Column:
    """JSON text that is itself a JSON string, unwrapped up to so many times."""
    inner = lambda n: F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), n, F.lit("}")), "$.v"), n)
    return F.aggregate(F.array_repeat(F.lit(0), times), node, lambda n, _: F.when(_is(n, '"'), inner(n)).otherwise(n))


def number(node: Column | str, dotted: str) -> Column:
    """The number at a path of keys and positions; null for anything else, digits inside a JSON string included."""
    whole = F.try_variant_get(F.try_parse_json(col(node)), "$." + dotted, "variant")
    return F.when(F.schema_of_variant(whole).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(F.try_parse_json(col(node)), "$." + dotted, "double"))


def with_path(node: Column | str, names: list[str], value: Column) -> Column:
    """JSON text with value (JSON text) put at a path of keys; objects that are missing there, or are none, are made.

    Everything else stays, numbers and texts each as what they are; the keys of changed objects are in order of their names.
    """
    if not names:
        return value
    name, *rest = names

    def put(whole: Column) -> Column:
        entries = F.coalesce(F.map_entries(F.try_variant_get(F.try_parse_json(whole), "$", "map<string,variant>")), F.expr("map_entries(cast(map() as map<string,variant>))"))
        told = F.transform(entries, lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))
        inner = F.get(F.transform(F.filter(told, lambda e: e["k"] == name), lambda e: e["v"]), F.lit(0))
        new = F.array(F.struct(F.lit(name).alias("k"), with_path(inner, rest, value).alias("v")))
        every = F.array_sort(F.concat(F.filter(told, lambda e: e["k"] != name), new))
        quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
        return F.concat(F.lit("{"), F.array_join(F.transform(every, lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))

    return F.get(F.transform(F.array(col(node)), put), F.lit(0))
