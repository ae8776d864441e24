"""Scalar functions on extracted text, as Spark columns. Missing text is the empty string throughout."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space besides ASCII's that trimming removes.
SPACES = "\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
STATUSES = ("unknown", "ongoing", "completed", "hiatus", "cancelled")


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim(value: Column | str) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(col(value), f"^[{SPACES}]+|[{SPACES}]+$", "")


def tidy(value: Column | str) -> Column:
    """White space collapsed to single blanks, ends trimmed, one closing comma or semicolon dropped."""
    single = trim(F.regexp_replace(col(value), f"[{SPACES}]+", " "))
    return trim(F.regexp_replace(single, "[,;]$", ""))


def first_filled(*values: Column | str) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(col(v), F.lit("")) for v in values], F.lit(""))


def n_groups(pattern: str) -> int:
    return len(re.findall(r"(?<!\\)\((?!\?(?:[:=!>]|<[=!]))", pattern))


def capture(value: Column | str, pattern: str) -> Column:
    """Group 1 of the first match, the dot matching line ends; empty without a match or group."""
    if not n_groups(pattern):
        return F.lit("")
    return F.coalesce(F.regexp_extract(col(value), f"(?s){pattern}", 1), F.lit(""))


def _java_replacement(replacement: str) -> str:
    """$0 to $9 stay group references of one digit, all else is literal, a digit straight after a reference included."""
    literal = lambda p: re.sub(r"^(?=[0-9])", r"\\", p.replace("\\", "\\\\").replace("$", "\\$"))
    return "".join(p if re.fullmatch(r"\$[0-9]", p) else literal(p) for p in re.split(r"(\$[0-9])", replacement))


def rewrite(value: Column | str, find: str | None = None, pattern: str | None = None, replace: str = "") -> Column:
    """Replace every literal find, or without one every match of pattern, with group references in replace."""
    if find:
        return F.replace(col(value), F.lit(find), F.lit(replace))
    if not pattern:
        return col(value)
    return F.regexp_replace(col(value), pattern, _java_replacement(replace))


def expand_groups(value: Column | str, pattern: str, template: str) -> Column:
    """template with $1 to $9 filled from the first match of pattern; template as it is without a match."""
    parts = [p for p in re.split(r"(\$[1-9])", template) if p]
    have = n_groups(pattern)
    fill = lambda p: F.regexp_extract(col(value), pattern, int(p[1])) if int(p[1]) <= have else F.lit("")
    filled = F.concat(*[fill(p) if re.fullmatch(r"\$[1-9]", p) else F.lit(p) for p in parts]) if parts else F.lit("")
    return F.when(col(value).rlike(pattern), filled).otherwise(F.lit(template))


def replace_first(value: Column | str, pattern: str, replace: str, suffix: str = "") -> Column:
    """Only the first match replaced, group references filled from it; then the suffix, match or not."""
    whole = col(value)
    found = F.regexp_substr(whole, F.lit(pattern))
    at = F.regexp_instr(whole, F.lit(pattern))
    head = F.substring(whole, F.lit(1), at - 1)
    tail = F.substring(whole, at + F.length(found), F.length(whole))
    changed = F.concat(head, expand_groups(whole, pattern, replace), tail)
    return F.concat(F.when(found.isNull(), whole).otherwise(changed), F.lit(suffix))


def substitute(template: Column | str, values: Mapping[str, Column]) -> Column:
    """Placeholders {name} replaced one name after the other, so later names see earlier values; unknown ones stay."""
    start = F.lit(template) if isinstance(template, str) else template
    return reduce(lambda text, item: F.replace(text, F.lit("{" + item[0] + "}"), item[1]), values.items(), start)


def render(template: str, resolve: Mapping[str, Column]) -> Column:
    """Placeholders {name} filled in a single pass; null if one has no value."""
    parts = [p for p in re.split(r"(\{[^{}]*\})", template) if p]
    if not parts:
        return F.lit("")
    missing = F.lit(None).cast("string")
    return F.concat(*[resolve.get(p[1:-1], missing) if p[0] == "{" and p[-1] == "}" else F.lit(p) for p in parts])


def page_values(page: Column, page_size: int, query: Column) -> dict[str, Column]:
    """The paging placeholders of a listing: page, offset, start and query."""
    offset = (page - 1) * page_size
    return {"page": page.cast("string"), "offset": offset.cast("string"), "start": (offset + 1).cast("string"), "query": query}


def lookup(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """The mapped value of a text, matched exactly but for case and blanks around it; null without one."""
    key = F.lower(trim(col(value)))
    out = F.lit(None).cast("string")
    for name, mapped in reversed(list(mapping.items())):
        out = F.when(key == name.lower().strip(), F.lit(mapped)).otherwise(out)
    return out


def status(value: Column | str, mapping: Mapping[str, str] | None = None) -> Column:
    """A publication status: the mapped one, the text's own if it names one, else unknown."""
    own = F.lower(trim(col(value)))
    return F.coalesce(lookup(value, mapping or {}), F.when(own.isin(*STATUSES), own), F.lit("unknown"))


def ended(value: Column | str) -> Column:
    return col(value).isin("completed", "cancelled")


def source_date(value: Column | str) -> Column:
    """A UTC timestamp from epoch seconds (below 10^12), epoch milliseconds or an ISO date; else null."""
    text = trim(col(value))
    number = text.try_cast("bigint")
    millis = F.when(F.abs(number) < 1_000_000_000_000, number * 1000).otherwise(number)
    return F.when(text.rlike(r"^[+-]?\d+$"), F.timestamp_millis(millis)).otherwise(F.try_to_timestamp(text))


def lenient_int(value: Column | str) -> Column:
    """An integer from an integer or decimal text; null otherwise."""
    text = trim(col(value))
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").cast("bigint"))


def strict_int(value: Column | str) -> Column:
    text = trim(col(value))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def number_or(value: Column | str, default: float = -1.0) -> Column:
    return F.coalesce(trim(col(value)).try_cast("double"), F.lit(default))


def first_digits(value: Column | str) -> Column:
    """The first run of digits as an integer, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(col(value), r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def truthy(value: Column | str) -> Column:
    """False for null, '', false and zero; true for anything else, as JSON text."""
    text = col(value)
    zero = F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return ~(text.isNull() | (text == "") | (text == "false") | (text == "null") | zero)


def holds(value: Column | str, needle: str) -> Column:
    return F.contains(col(value), F.lit(needle)) if needle else F.lit(False)


def _entities(text: Column) -> Column:
    """&eacute;, &#233; and &#xE9; as their characters, each kind once over; the ampersand's own reference comes last.

    Names are those of HTML5 that end in a semicolon; unknown ones stay.
    """

    def character(entity: Column) -> Column:
        digits = F.regexp_extract(entity, "([0-9a-fA-F]+);", 1)
        code = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    names = sorted(n for n in html5 if n.endswith(";"))
    known = F.map_from_arrays(F.lit(names), F.lit([html5[n] for n in names]))
    meant = lambda e: F.when(F.startswith(e, F.lit("&#")), character(e)).otherwise(F.coalesce(F.element_at(known, F.substring(e, F.lit(2), F.length(e))), e))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("(&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[A-Za-z][A-Za-z0-9]*);)"), 1))
    last = F.array_sort(F.transform(found, lambda e: F.struct((e == "&amp;").alias("last"), e.alias("e"))))
    return F.when(F.contains(text, F.lit("&")), F.aggregate(last, text, lambda t, s: F.replace(t, s["e"], meant(s["e"])))).otherwise(text)


def plain_text(value: Column | str) -> Column:
    """Text of an HTML fragment: breaks and block ends become line ends, tags go, entities are decoded. Text without tags stays as it is."""
    text = F.regexp_replace(col(value), r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6])>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = F.get(F.transform(F.array(text), _entities), F.lit(0))
    text = trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))
    return F.when(col(value).rlike("<[a-zA-Z/!]"), text).otherwise(col(value))


def content_hash(value: Column | str) -> Column:
    return F.substring(F.sha2(col(value), 256), 1, 16)


def slug(value: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(value)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def data_uri(image: Column | str, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(col(image)))


def joined(values: Sequence[Column], separator: str, default: str = "") -> Column:
    """Non-empty values joined; the default if there is none."""
    kept = F.filter(F.array(*values), lambda v: v.isNotNull() & (v != ""))
    return first_filled(F.array_join(kept, separator), F.lit(default))


def generated(count: Column, template: str, start: int = 1, pad: int = 0) -> Column:
    """template once for each of count numbers from start, {n} left-padded with zeros but never cut."""
    text = lambda n: F.when(F.length(n.cast("string")) >= pad, n.cast("string")).otherwise(F.lpad(n.cast("string"), max(pad, 1), "0"))
    numbers = F.when(count > 0, F.sequence(F.lit(start).cast("bigint"), F.lit(start) + count.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda n: F.replace(F.lit(template), F.lit("{n}"), text(n)))


def tri_state(current: Column, excludable: bool = True) -> Column:
    """The next state of a filter: off, included, excluded where that is supported, off again."""
    after_included = "excluded" if excludable else "off"
    return F.when(current == "off", "included").when(current == "included", after_included).otherwise("off")
