"""HTML documents as a table of element rows, and selectors as filters on it.

``nodes`` reads each document once and gives a row an element, with its attributes, text, places among its siblings, the
chain of its ancestors and above, their nodes. Everything after that is relational: a selector is a column over one row's element and its
ancestors, so selecting neither joins nor shuffles; only sibling combinators join elements of one parent.

Elements that HTML leaves open are closed by tag (p, li, option, table parts, dt and dd); html, head, body, tbody and tr are
implied. Formatting elements that a block closes are opened again in the text after it, until their end tag or, in a cell, its
end. An end tag of a formatting element that stands around an open block ends the element and leaves the block open.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import trim

# Elements without content, those that belong in the head, and what each opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link style base".split())
BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
CLOSES = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, **{part: {"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"} for part in ("thead", "tbody", "tfoot")}} | {b: {"p"} for b in BLOCKS}
STRUCTURE = frozenset("html head body script style template frameset frame center dir menu search hgroup figure figcaption details summary dialog optgroup".split())
SECTIONS = frozenset("thead tbody tfoot".split())
TABLE_PARTS = SECTIONS | {"table", "tr", "colgroup"}
CELLS = frozenset("td th caption".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
FENCES = frozenset("ul ol select table dl body html article section div nav td th".split())

# What stands for an ampersand that begins no reference while a document is parsed; no valid text holds half a surrogate pair.
HELD = "\udc26"
_REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([A-Za-z][A-Za-z0-9]*;))?")


def held(html: str) -> str:
    """html with the ampersands held that begin no reference ended by a semicolon."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else HELD + m[0][1:], html)

_ELEMENT = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        *(T.StructField(n, T.IntegerType()) for n in ("nth", "siblings", "nth_of_type", "of_type")),
    ]
)
_NODE = [
    T.StructField("node", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    *_ELEMENT.fields,
    T.StructField("text", T.StringType()),
    T.StructField("children", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("ancestors", T.ArrayType(_ELEMENT)),
    T.StructField("above", T.ArrayType(T.IntegerType())),
]


class Tree(HTMLParser):
    """Elements in document order with parents and text pieces.

    formats are the formatting elements that are to be opened again, each with its open element, and None where a cell began.
    As HTML5 has it, old names are references without their semicolon, too; with ended, none is.
    """

    def __init__(self, ended: bool = False):
        super().__init__(convert_charrefs=True)
        self.ended = ended
        self.tags, self.attrs, self.pieces = [], [], []
        self.parents, self.begins, self.ends = array("i"), array("i"), array("i")
        self.alike: dict[tuple, dict] = {}
        self.open: list[int] = []
        self.formats: list[int | None] = []

    @classmethod
    def of(cls, html: str, ended: bool = False) -> Tree:
        tree = cls(ended)
        tree.feed(held(html) if ended else html)
        tree.close()
        tree._pop(0)
        return tree

    def _push(self, tag: str, attrs: dict) -> None:
        self.tags.append(sys.intern(tag))
        self.attrs.append(self._shared(attrs))
        self.parents.append(self.open[-1] if self.open else -1)
        self.begins.append(len(self.pieces))
        self.ends.append(len(self.pieces))
        self.open.append(len(self.tags) - 1)

    def _shared(self, attrs: dict) -> dict:
        """Equal attributes, such as those of a list's items, as one object; nothing changes it later."""
        if len(self.alike) > 1000:
            self.alike.clear()
        return self.alike.setdefault(tuple(attrs.items()), attrs)

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            i = self.open.pop()
            self.ends[i] = len(self.pieces)
            if self.tags[i] in CELLS:
                while self.formats and self.formats.pop() is not None:
                    pass

    def _reopen(self) -> None:
        """Open the formatting elements again that a block has closed since."""
        if not self.formats or self.formats[-1] is None or self.formats[-1] in self.open or not self.open or self.tags[self.open[-1]] in TABLE_PARTS:
            return
        at = len(self.formats)
        while at and self.formats[at - 1] is not None and self.formats[at - 1] not in self.open:
            at -= 1
        for k in range(at, len(self.formats)):
            old = self.formats[k]
            self._push(self.tags[old], self.attrs[old])
            self.formats[k] = len(self.tags) - 1

    def _format(self) -> None:
        """Keep the element just opened, and of its equals since the last cell the last three."""
        new = len(self.tags) - 1
        equal = []
        for k in range(len(self.formats) - 1, -1, -1):
            if (old := self.formats[k]) is None:
                break
            if (self.tags[old], self.attrs[old]) == (self.tags[new], self.attrs[new]):
                equal.append(k)
        if len(equal) > 2:
            del self.formats[equal[-1]]
        self.formats.append(new)

    def _unformat(self, tag: str) -> bool:
        """End the last formatting element of this tag; whether there was one."""
        for k in range(len(self.formats) - 1, -1, -1):
            if (i := self.formats[k]) is None:
                return False
            if self.tags[i] == tag:
                del self.formats[k]
                if i in self.open:
                    at = self.open.index(i)
                    if any(self.tags[j] in BLOCKS or self.tags[j] in FENCES or self.tags[j] == "li" for j in self.open[at + 1 :]):
                        self.ends[i] = len(self.pieces)
                        del self.open[at]
                    else:
                        self._pop(at)
                return True
        return False

    def _imply_parts(self, tag: str) -> None:
        """A table's rows stand in a section, and its cells in a row."""
        here = self.tags[self.open[-1]] if self.open else ""
        if tag in ("tr", "td", "th") and here == "table":
            self._push("tbody", {})
            here = "tbody"
        if tag in ("td", "th") and here in SECTIONS:
            self._push("tr", {})

    def _imply(self, tag: str) -> None:
        if not self.open:
            self._push("html", {})
        names = [self.tags[i] for i in self.open]
        if tag in ("head", "body") or len(names) > 2 or (len(names) == 2 and names[1] == "body"):
            return
        into_head = tag in HEAD or (tag == "script" and "body" not in self.tags)
        if into_head and "body" not in self.tags:
            if len(names) == 1 and "head" not in self.tags:
                self._push("head", {})
        elif names[-1] != "body" and not (len(names) == 2 and names[1] == "head" and into_head):
            self._pop(1)
            if "body" in self.tags:
                self.open.append(self.tags.index("body"))
            else:
                self._push("body", {})

    def handle_starttag(self, tag, attrs):
        found = {}
        if self.ended:
            tag, attrs = tag.replace(HELD, "&"), [(name.replace(HELD, "&"), (value or "").replace(HELD, "&")) for name, value in attrs]
        for name, value in attrs:
            found.setdefault(name, value or "")
        if tag in ("html", "body", "head") and tag in self.tags:
            self.attrs[self.tags.index(tag)] = found | self.attrs[self.tags.index(tag)]
            return
        if tag != "html":
            self._imply(tag)
        if tag == "body":
            self._pop(1)
        for i in range(len(self.open) - 1, -1, -1):
            name = self.tags[self.open[i]]
            if name in CLOSES.get(tag, ()):
                self._pop(i)
            elif name in FENCES:
                break
        if tag == "a" and any(i is not None and self.tags[i] == "a" for i in self.formats[self._cell() :]):
            self._unformat("a")
        if tag in FORMATTING or not (tag in CLOSES or tag in TABLE_PARTS or tag in CELLS or tag in HEAD or tag in STRUCTURE):
            self._reopen()
        self._imply_parts(tag)
        self._push(tag, found)
        if tag in VOID:
            self._pop(len(self.open) - 1)
        elif tag in FORMATTING:
            self._format()
        elif tag in CELLS:
            self.formats.append(None)

    def _cell(self) -> int:
        """Where the formats of the current cell begin."""
        return max((k + 1 for k, i in enumerate(self.formats) if i is None), default=0)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.ended:
            tag = tag.replace(HELD, "&")
        if tag in FORMATTING and self._unformat(tag):
            return
        for i in range(len(self.open) - 1, 0 if tag not in ("html",) else -1, -1):
            if self.tags[self.open[i]] == tag:
                if tag not in ("body", "html"):
                    self._pop(i)
                return

    def handle_data(self, data):
        if self.ended:
            data = data.replace(HELD, "&")
        if len(self.open) <= 1:
            if not data.strip():
                return
            self._imply("#text")
        self._reopen()
        self.pieces.append(data)


# Bytes of text and ancestors that a batch of elements holds, about.
BATCH = 1 << 22


def _places(tree: Tree) -> dict[str, array]:
    """For each element its nth, siblings, nth_of_type, of_type, how many children it has, and the last element inside it."""
    n = len(tree.tags)
    out = {name: array("i", [0]) * n for name in ("nth", "siblings", "nth_of_type", "of_type", "children")}
    last = out["last"] = array("i", range(n))
    first, after, newest = array("i", [-1]) * (n + 1), array("i", [-1]) * n, array("i", [-1]) * (n + 1)
    for i, p in enumerate(tree.parents):
        if newest[p] < 0:
            first[p] = i
        else:
            after[newest[p]] = i
        newest[p] = i
        if p >= 0:
            out["children"][p] += 1
    for p in range(-1, n):
        i, total, nth = first[p], {}, 0
        while i >= 0:
            nth += 1
            total[tree.tags[i]] = out["nth_of_type"][i] = total.get(tree.tags[i], 0) + 1
            out["nth"][i], i = nth, after[i]
        i = first[p]
        while i >= 0:
            out["siblings"][i], out["of_type"][i], i = nth, total[tree.tags[i]], after[i]
    for i in range(n - 1, -1, -1):
        if (p := tree.parents[i]) >= 0:
            last[p] = max(last[p], last[i])
    return out


def _path(parents: array, i: int) -> list[int]:
    """An element's ancestors and itself, the root first; nothing for -1."""
    out = []
    while i >= 0:
        out.append(i)
        i = parents[i]
    return out[::-1]


class _Elements:
    """Rows of elements on their way into a batch. An element that is the ancestor of many rows stands in the pool once."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.clear()

    def clear(self) -> None:
        self.rows = {name: [] for name in self.schema.names if name not in ("ancestors", *_ELEMENT.fieldNames())}
        self.pool, self.weights, self.own, self.above, self.ends, self.size = [], [], [], [], [0], 0

    def batch(self) -> pa.RecordBatch:
        element = self.schema.field("ancestors").type.value_type
        columns = list(zip(*self.pool, strict=True))
        pool = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, element, strict=True)], fields=list(element))
        own = pool.take(pa.array(self.own, pa.int32()))
        made = {name: own.field(name) for name in _ELEMENT.fieldNames()}
        made["ancestors"] = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pool.take(pa.array(self.above, pa.int32())), type=self.schema.field("ancestors").type)
        out = [made[f.name] if f.name in made else pa.array(self.rows[f.name], f.type) for f in self.schema]
        self.clear()
        return pa.RecordBatch.from_arrays(out, schema=self.schema)


def _batches(documents: Iterable[tuple], key: str, schema: pa.Schema, ended: bool) -> Iterator[pa.RecordBatch]:
    """The elements of (key, document) in batches of bounded size: a document may fill many, and many may share one."""
    out = _Elements(schema)
    for k, html in documents:
        tree = Tree.of(html, ended)
        places = _places(tree)
        at: dict[int, int] = {}
        path: list[int] = []
        for i, p in enumerate(tree.parents):
            while path and path[-1] != p:
                path.pop()
            if not path:
                path = _path(tree.parents, p)
            path.append(i)
            for j in path:
                if j not in at:
                    at[j] = len(out.pool)
                    out.pool.append((tree.tags[j], list(tree.attrs[j].items()), *(places[name][j] for name in ("nth", "siblings", "nth_of_type", "of_type"))))
                    out.weights.append(50 + sum(len(n) + len(v) + 10 for n, v in tree.attrs[j].items()))
            text = "".join(tree.pieces[tree.begins[i] : tree.ends[i]])
            for name, value in ((key, k), ("node", i), ("parent", p), ("text", text), ("children", places["children"][i]), ("last", places["last"][i]), ("above", path[:-1])):
                out.rows[name].append(value)
            above = [at[j] for j in path]
            out.own.append(above.pop())
            out.above += above
            out.ends.append(len(out.above))
            out.size += len(text) + 50 + sum(out.weights[x] for x in (*above, out.own[-1]))
            if out.size >= BATCH:
                yield out.batch()
                at.clear()
    if out.own:
        yield out.batch()


def nodes(pages: DataFrame, key: str, html: str = "html", ended: bool = False) -> DataFrame:
    """A row for every element of every document: key and the columns of _NODE. Null documents have no elements.

    With ended, references without their semicolon stay as they are.
    """
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), *_NODE])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        documents = ((k.as_py(), text.as_py()) for batch in batches for k, text in zip(batch.column(0), batch.column(1), strict=True))
        yield from _batches(((k, text) for k, text in documents if text), key, to_arrow_schema(schema), ended)

    return pages.select(key, html).mapInArrow(run, schema)


# Pseudo-classes that filters support.
PLAIN_PSEUDO = ("root", "empty", "first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "link", "visited")
FUNCTION_PSEUDO = ("not", "contains", "lang", "nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")
NEVER = ("before", "after", "first-line", "first-letter")

_SIMPLE = re.compile(
    r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>(?:[\w-]|\\.)+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<q>[\"']?)(?P<value>.*?)(?P=q)\s*)?\]"
    r"|::?(?P<pseudo>[\w-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?"
)


@dataclass
class Step:
    """A combinator ('' for the last element) and the simple selectors that its element meets."""

    combinator: str
    simple: list[dict] = field(default_factory=list)


def an_b(text: str) -> tuple[int, int] | None:
    """(a, b) of an An+B argument; None if it is none."""
    text = text.strip().lower().replace(" ", "")
    if text in ("odd", "even"):
        return 2, int(text == "odd")
    if re.fullmatch(r"[+-]?\d+", text):
        return 0, int(text)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", text)
    return (int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)) if m else None


def read_selector(text: str) -> list[list[Step]]:
    """Alternatives, each a list of steps from the outermost to the element itself."""
    out, steps, at, combinator = [], [], 0, ""
    text = text.strip()
    current = Step("")
    while at < len(text):
        m = re.match(r"\s*([>+~,])\s*|\s+", text[at:])
        if m:
            if not current.simple:
                raise ValueError(f"selector {text!r}: nothing before {m[0]!r}")
            steps.append(current)
            combinator = m[1] or " "
            if combinator == ",":
                out.append(steps)
                steps, combinator = [], ""
            current = Step(combinator)
            at += m.end()
            continue
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector {text!r}: cannot read {text[at:]!r}")
        simple = {k: v for k, v in m.groupdict().items() if v is not None}
        name = simple.get("pseudo")
        if name and name not in (*PLAIN_PSEUDO, *NEVER) and not (name in FUNCTION_PSEUDO and "arg" in simple):
            raise NotImplementedError(f"selector {text!r}: :{name}")
        if name == "contains" and simple["arg"][:1] in "\"'":
            raise ValueError(f"selector {text!r}: :contains takes its text without quotes")
        current.simple.append(simple)
        at = m.end()
    if not current.simple:
        raise ValueError(f"selector {text!r} ends in a combinator")
    return [*out, [*steps, current]]


def _nth(place: Column, text: str) -> Column:
    found = an_b(text)
    if not found:
        return F.lit(False)
    a, b = found
    return place == b if a == 0 else (F.pmod(place - b, F.lit(abs(a))) == 0) & ((place - b) * (1 if a > 0 else -1) >= 0)


def _meets(e, s: dict, own: bool) -> Column:
    """Whether element e, a row or a struct, meets one simple selector."""
    if "tag" in s:
        return F.lit(True) if s["tag"] == "*" else e["tag"] == s["tag"].lower()
    attrs = e["attrs"]
    value = lambda name: F.element_at(attrs, F.lit(name))
    if "id" in s:
        return F.coalesce(value("id") == s["id"], F.lit(False))
    if "cls" in s:
        return F.coalesce(F.array_contains(F.split(value("class"), r"\s+"), s["cls"].replace("\\", "")), F.lit(False))
    if "attr" in s:
        v, op, want = value(s["attr"].lower()), s.get("op"), F.lit(s.get("value", ""))
        tests = {None: v.isNotNull(), "=": v == want, "~=": F.array_contains(F.split(v, " "), want), "|=": (v == want) | F.startswith(v, F.concat(want, F.lit("-")))}
        tests |= {"^=": F.startswith(v, want), "$=": F.endswith(v, want), "*=": F.contains(v, want)}
        return F.coalesce(tests[op], F.lit(False))
    name, arg = s["pseudo"], s.get("arg", "")
    if name in NEVER or name == "visited":
        return F.lit(False)
    if name == "not":
        return ~_all(e, read_selector(arg)[0][-1].simple, own)
    if name in ("contains", "empty", "lang") and not own:
        raise NotImplementedError(f":{name} on an ancestor; fused.matches reads it")
    last, last_of_type = e["siblings"] + 1 - e["nth"], e["of_type"] + 1 - e["nth_of_type"]
    if name == "lang":
        chain = F.transform(F.array_append(e["ancestors"], F.struct(e["tag"].alias("tag"), attrs.alias("attrs"), *(e[n].alias(n) for n in ("nth", "siblings", "nth_of_type", "of_type")))), lambda a: F.element_at(a["attrs"], F.lit("lang")))
        return F.coalesce(F.startswith(F.element_at(F.filter(chain, lambda v: v.isNotNull()), -1), F.lit(arg)), F.lit(False))
    return {
        "root": lambda: F.size(e["ancestors"]) == 0 if own else e["tag"] == "html",
        "empty": lambda: (e["children"] == 0) & (e["text"] == ""),
        "first-child": lambda: e["nth"] == 1,
        "last-child": lambda: last == 1,
        "only-child": lambda: e["siblings"] == 1,
        "first-of-type": lambda: e["nth_of_type"] == 1,
        "last-of-type": lambda: last_of_type == 1,
        "only-of-type": lambda: e["of_type"] == 1,
        "link": lambda: F.element_at(attrs, F.lit("href")).isNotNull(),
        "contains": lambda: F.contains(e["text"], F.lit(arg)),
        "nth-child": lambda: _nth(e["nth"], arg),
        "nth-last-child": lambda: _nth(last, arg),
        "nth-of-type": lambda: _nth(e["nth_of_type"], arg),
        "nth-last-of-type": lambda: _nth(last_of_type, arg),
    }[name]()


def _all(e, simple: list[dict], own: bool) -> Column:
    out = F.lit(True)
    for s in simple:
        out = out & _meets(e, s, own)
    return out


class _Row:
    """The element columns of a row, read like a struct's fields."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def _hit(simple: list[dict]):
    return lambda i: _all(F.get("ancestors", i), simple, False)


def matches(selector: str) -> Column:
    """Whether a row's element matches. Each step takes the nearest fitting ancestor and never reconsiders it."""
    out = F.lit(False)
    for steps in read_selector(selector):
        fits = _all(_Row(), steps[-1].simple, True)
        at = F.size("ancestors")
        for outer, inner in zip(reversed(steps[:-1]), reversed(steps[1:]), strict=True):
            if inner.combinator not in (" ", ">"):
                raise NotImplementedError("sibling combinators need select()")
            hit = _hit(outer.simple)
            if inner.combinator == ">":
                at = F.when((at > 0) & hit(at - 1), at - 1)
            else:
                at = F.when(at > 0, F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(at - 1, F.lit(0))), hit)))
            fits = fits & at.isNotNull()
        out = out | fits
    return out


def has_siblings(selector: str) -> bool:
    return any(s.combinator in ("+", "~") for steps in read_selector(selector) for s in steps)


def select(table: DataFrame, key: str, selector: str) -> DataFrame:
    """Rows of the elements that match, in document order by node within a document."""
    parts = [steps for steps in read_selector(selector)]
    if not has_siblings(selector):
        return table.where(matches(selector))
    found = []
    for steps in parts:
        rows = table.where(_all(_Row(), steps[0].simple, True))
        for step in steps[1:]:
            inner = table.where(_all(_Row(), step.simple, True))
            left, right = rows.select(key, F.col("node").alias("_n"), F.col("parent").alias("_p"), F.col("nth").alias("_i"), F.col("last").alias("_l")).distinct().alias("l"), inner.alias("r")
            same = F.col(f"l.{key}") == F.col(f"r.{key}")
            rule = {"+": (F.col("r.parent") == F.col("_p")) & (F.col("r.nth") == F.col("_i") + 1), "~": (F.col("r.parent") == F.col("_p")) & (F.col("r.nth") > F.col("_i"))}
            rule |= {">": F.col("r.parent") == F.col("_n"), " ": (F.col("r.node") > F.col("_n")) & (F.col("r.node") <= F.col("_l"))}
            rows = right.join(left, same & rule[step.combinator], "left_semi")
        found.append(rows)
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out.dropDuplicates([key, "node"])


def attribute(name: str) -> Column:
    """A trimmed attribute of a row's element; empty if it has none."""
    return F.coalesce(trim(F.element_at("attrs", F.lit(name))), F.lit(""))


def text() -> Column:
    return trim(F.col("text"))
