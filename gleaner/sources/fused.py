"""Selectors compiled into the parse: only what they find leaves the worker.

``html.nodes`` gives every element with its text and ancestors, for whatever may be asked of them later. Where the selectors
are known beforehand, the functions here read a document once and give its matches alone, or a row with the fields of each
item, in document order. There is no join and no shuffle in them, and a row holds no more than what was asked for.

A step of a selector takes the nearest fitting ancestor or earlier sibling and never reconsiders it. Items are read to the
end of their element, items within them included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.functions.text import trim
from gleaner.sources.html import NEVER, Step, Tree, an_b, read_selector

Wanted = Mapping[str, tuple[str, str, bool]]


class Page:
    """A parsed document with the places that selectors ask for."""

    def __init__(self, html: str, ended: bool = False):
        self.tree = Tree.of(html, ended)
        tags, parents = self.tree.tags, self.tree.parents
        self.tags, self.attrs, self.parents = tags, self.tree.attrs, parents
        n = len(tags)
        self.nth, self.before, self.of_type = [0] * n, [-1] * n, [0] * n
        self.kids: dict[int, list[int]] = {}
        self.by_tag: dict[str, list[int]] = {}
        self.last = list(range(n))
        same: dict[tuple[int, str], int] = {}
        for i, (tag, p) in enumerate(zip(tags, parents, strict=True)):
            own = self.kids.setdefault(p, [])
            self.before[i] = own[-1] if own else -1
            own.append(i)
            self.nth[i] = len(own)
            same[p, tag] = self.of_type[i] = same.get((p, tag), 0) + 1
            self.by_tag.setdefault(tag, []).append(i)
        self.same = same
        for i in range(n - 1, 0, -1):
            if (p := parents[i]) >= 0:
                self.last[p] = max(self.last[p], self.last[i])

    def text(self, i: int) -> str:
        return "".join(self.tree.pieces[self.tree.begins[i] : self.tree.ends[i]])

    def classes(self, i: int) -> list[str]:
        return self.attrs[i].get("class", "").split()


def _place(test: tuple[int, int] | None) -> Callable[[int], bool]:
    if test is None:
        return lambda n: False
    a, b = test
    return (lambda n: n == b) if a == 0 else lambda n: (n - b) % abs(a) == 0 and (n - b) * (1 if a > 0 else -1) >= 0


def _language(page: Page, i: int) -> str:
    while i >= 0 and "lang" not in page.attrs[i]:
        i = page.parents[i]
    return page.attrs[i]["lang"] if i >= 0 else ""


def _test(s: dict) -> Callable[[Page, int], bool]:
    """One simple selector as a test of an element."""
    if "tag" in s:
        tag = s["tag"].lower()
        return (lambda p, i: True) if tag == "*" else lambda p, i: p.tags[i] == tag
    if "id" in s:
        return lambda p, i: p.attrs[i].get("id") == s["id"]
    if "cls" in s:
        name = s["cls"].replace("\\", "")
        return lambda p, i: name in p.classes(i)
    if "attr" in s:
        name, want = s["attr"].lower(), s.get("value", "")
        tests = {
            None: lambda v: True, "=": lambda v: v == want, "~=": lambda v: want in v.split(" "), "|=": lambda v: v == want or v.startswith(want + "-"),
            "^=": lambda v: v.startswith(want), "$=": lambda v: v.endswith(want), "*=": lambda v: want in v,
        }
        test = tests[s.get("op")]
        return lambda p, i: name in p.attrs[i] and test(p.attrs[i][name])
    name, arg = s["pseudo"], s.get("arg", "")
    if name in NEVER or name == "visited":
        return lambda p, i: False
    if name == "not":
        inner = [_test(x) for x in read_selector(arg)[0][-1].simple]
        return lambda p, i: not all(t(p, i) for t in inner)
    from_end = lambda p, i: len(p.kids[p.parents[i]]) + 1 - p.nth[i]
    type_from_end = lambda p, i: p.same[p.parents[i], p.tags[i]] + 1 - p.of_type[i]
    at = _place(an_b(arg)) if name.startswith("nth-") else None
    return {
        "root": lambda p, i: p.parents[i] < 0,
        "empty": lambda p, i: i not in p.kids and not p.text(i),
        "first-child": lambda p, i: p.nth[i] == 1,
        "last-child": lambda p, i: from_end(p, i) == 1,
        "only-child": lambda p, i: len(p.kids[p.parents[i]]) == 1,
        "first-of-type": lambda p, i: p.of_type[i] == 1,
        "last-of-type": lambda p, i: type_from_end(p, i) == 1,
        "only-of-type": lambda p, i: p.same[p.parents[i], p.tags[i]] == 1,
        "link": lambda p, i: "href" in p.attrs[i],
        "contains": lambda p, i: arg in p.text(i),
        "lang": lambda p, i: _language(p, i).startswith(arg),
        "nth-child": lambda p, i: at(p.nth[i]),
        "nth-last-child": lambda p, i: at(from_end(p, i)),
        "nth-of-type": lambda p, i: at(p.of_type[i]),
        "nth-last-of-type": lambda p, i: at(type_from_end(p, i)),
    }[name]


class Selector:
    """A selector as tests, to be asked for its matches among the elements first to last of a page."""

    def __init__(self, text: str):
        self.ways = [self._way(steps) for steps in read_selector(text)]

    @staticmethod
    def _way(steps: list[Step]) -> tuple[str | None, list[tuple[str, list[Callable]]]]:
        """The tag that the element itself has, if the selector names one; and (combinator, tests) from the inside out."""
        tag = next((s["tag"].lower() for s in steps[-1].simple if s.get("tag", "*") != "*"), None)
        return tag, [(step.combinator, [_test(s) for s in step.simple]) for step in reversed(steps)]

    def _holds(self, page: Page, i: int, way: list[tuple[str, list[Callable]]]) -> bool:
        combinator = ""
        for step, tests in way:
            if combinator in ("+", ">"):
                i = page.before[i] if combinator == "+" else page.parents[i]
                if i < 0 or not all(t(page, i) for t in tests):
                    return False
            elif combinator:
                up = page.before if combinator == "~" else page.parents
                i = up[i]
                while i >= 0 and not all(t(page, i) for t in tests):
                    i = up[i]
                if i < 0:
                    return False
            elif not all(t(page, i) for t in tests):
                return False
            combinator = step
        return True

    def among(self, page: Page, first: int, last: int):
        """Matches between two elements, in order."""
        if len(self.ways) == 1:
            tag, way = self.ways[0]
            for i in page.by_tag.get(tag, ()) if tag else range(first, last + 1):
                if first <= i <= last and self._holds(page, i, way):
                    yield i
            return
        for i in range(first, last + 1):
            if any((tag is None or page.tags[i] == tag) and self._holds(page, i, way) for tag, way in self.ways):
                yield i


def _read(pages: DataFrame, key: str, html: str, fields: list[T.StructField], tell: Callable[[Page], list[tuple]], ended: bool = False) -> DataFrame:
    """key and tell's rows of every document; null and empty documents have none."""
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(k, *r) for r in tell(Page(text, ended))] if text else []
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return pages.select(key, html).mapInArrow(run, schema)


def _value(page: Page, i: int, attr: str) -> str:
    return page.attrs[i].get(attr, "") if attr else page.text(i)


def matches(pages: DataFrame, key: str, selector: str, values: Mapping[str, str], html: str = "html") -> DataFrame:
    """A row for each match: key, pos (from 0), node and, by name, its trimmed text ('') or an attribute of it."""
    found = Selector(selector)

    def tell(page: Page) -> list[tuple]:
        hits = found.among(page, 0, len(page.tags) - 1)
        return [(pos, i, *(_value(page, i, at) for at in values.values())) for pos, i in enumerate(hits)]

    fields = [T.StructField(n, T.IntegerType()) for n in ("pos", "node")] + [T.StructField(n, T.StringType()) for n in values]
    out = _read(pages, key, html, fields, tell)
    return out.select(key, "pos", "node", *[trim(n).alias(n) for n in values])


def _fields(wanted: Wanted) -> list[tuple[Selector | None, str, bool]]:
    return [(Selector(selector) if selector else None, attr, exists) for selector, attr, exists in wanted.values()]


def _first(page: Page, own: int, below: tuple[int, int], at: tuple[Selector | None, str, bool]) -> str | None:
    selector, attr, exists = at
    i = own if selector is None else next(iter(selector.among(page, *below)), None)
    return None if i is None else "1" if exists else _value(page, i, attr)


def firsts(pages: DataFrame, key: str, wanted: Wanted, html: str = "html", ended: bool = False) -> DataFrame:
    """For name: (selector, attribute or '', presence only), each document's first match: key and the names, null without one.

    With ended, references without their semicolon stay as they are.
    """
    fields = _fields(wanted)
    told = lambda page: [tuple(_first(page, 0, (0, len(page.tags) - 1), at) for at in fields)] if page.tags else []
    out = _read(pages, key, html, [T.StructField(n, T.StringType()) for n in wanted], told, ended)
    return out.select(key, *[trim(n).alias(n) for n in wanted])


def records(pages: DataFrame, key: str, items: str, wanted: Wanted, html: str = "html") -> DataFrame:
    """The same within each match of items: key, pos (from 0) and the names; without a selector the item itself is read."""
    found, fields = Selector(items), _fields(wanted)

    def tell(page: Page) -> list[tuple]:
        hits = found.among(page, 0, len(page.tags) - 1)
        return [(pos, *(_first(page, i, (i + 1, page.last[i]), at) for at in fields)) for pos, i in enumerate(hits)]

    out = _read(pages, key, html, [T.StructField("pos", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in wanted]], tell)
    return out.select(key, "pos", *[trim(n).alias(n) for n in wanted])


def labelled(pages: DataFrame, key: str, row: str, label: str, value: str = "", html: str = "html") -> DataFrame:
    """Rows for label_values: key, row_pos, label, value_pos, value of every row with a label; without a value selector, the row's text."""
    rows, labels, values = Selector(row), [(Selector(label), "", False)], Selector(value) if value else None

    def tell(page: Page) -> list[tuple]:
        out = []
        for pos, i in enumerate(rows.among(page, 0, len(page.tags) - 1)):
            below = (i + 1, page.last[i])
            name = _first(page, i, below, labels[0])
            if name:
                out += [(pos, name, j, page.text(j)) for j in (values.among(page, *below) if values else (i,))]
        return out

    fields = [T.StructField("row_pos", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("value_pos", T.IntegerType()), T.StructField("value", T.StringType())]
    return _read(pages, key, html, fields, tell).withColumn("label", trim("label")).where("label <> ''")


def counts(pages: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """How many elements the documents in each of the columns have: key and the columns. Rows without any in one of them go.

    A worker parses equal documents once: it remembers their counts by a digest, 100,000 of them at most.
    """
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in columns]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen: dict[bytes, int] = {}

        def count(html: pa.Scalar) -> int:
            if not html.is_valid:
                return 0
            mark = hashlib.blake2b(html.as_buffer(), digest_size=16).digest()
            if mark not in seen:
                if len(seen) >= 100_000:
                    seen.clear()
                text = html.as_py()
                seen[mark] = len(Tree.of(text).tags) if text else 0
            return seen[mark]

        for batch in batches:
            told = [pa.array([count(x) for x in batch.column(i + 1)], f.type) for i, f in enumerate(list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *told], schema=arrow)

    found = pages.select(key, *columns).mapInArrow(run, schema)
    for n in columns:
        found = found.where(F.col(n) > 0)
    return found
