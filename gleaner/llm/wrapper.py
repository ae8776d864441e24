"""Main text of pages by wrapper induction: what pages of one host share is template, what varies is content.

A page is read into a tree of its block elements, whose leaves are runs of text; inline markup only tells link text apart.
Siblings of one tag and class fold into one node, so a page's tree has the size of its layout. Pages of a host are aligned
by simple tree matching: equal roots are matched, and their children by the order-keeping pairing that matches most nodes
below. Aligned nodes merge; others stay as optional ones. A merged leaf knows on how many pages it stands and whether its
text was ever another. A leaf that says the same on most pages of a host, and of LEAST different pages at least, is template; one of several
folded siblings, such as a paragraph, never is, as lines that articles share are content.

The content is read in a page's articles, else in its main element, else in the lowest node of the host's tree that holds
SHARE of its varying text outside links; there, leaves of mostly link text go as well. What marks itself as something else goes
anyway: by its tag (nav, aside, footer, form, header outside an article, scripts), by its role, by being hidden, by the words of
its classes or id, and articles within articles, which are readers' comments.

Trees are merged within tasks first, by structure, then in rounds of groups of about FAN of a host, so no host, however many
pages it has, comes together in one task; then pages are read again, beside the tree of their host. Nothing is sampled.

Defined results: a null or empty html gives an empty text; a page without a host, or whose host has few pages, keeps what its
own marks leave; equal rows are answered each; a row of table cells is one block; elements nested over DEPTH deep are read as
flat blocks; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.functions.urls import host
from gleaner.llm.common import cut, text_bytes
from gleaner.sources.html import CLOSES, FENCES, VOID

LEAST, SHARE, FAN, WIDE, DEPTH = 3, 0.7, 64, 16, 150
HELD, BROADCAST_BYTES = 4000, 8 << 20
TREE = "host string, bucket long, tree string"

# Block elements; elements that are no content; roles and words of classes and ids that say the same, words that
# turn them round (with-sidebar), and whose header a content's own is.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th".split())
FLOW = frozenset("p li h2 h3 h4 h5 h6 tr dd dt blockquote pre ul ol dl table hr figure #".split())
DROPPED = frozenset("head script style noscript template nav aside footer form button select textarea iframe object svg canvas audio video dialog menu search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
TALK = frozenset("comment comments commentlist disqus respond replies".split())
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead "
    "share sharing social cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login related recommended recommendations "
    "pagination pager toolbar search widget skip disclaimer copyright".split()
)
QUALIFIERS = frozenset("with has no without is".split())
OWN_HEADS = frozenset("article post entry content story page".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def names_of(value: str) -> list[list[str]]:
    """The words of each class or id."""
    return [re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) for name in value.split()]


def says(attrs: dict[str, str], words: frozenset[str]) -> bool:
    named = names_of(f"{attrs.get('class', '')} {attrs.get('id', '')}")
    own_head = lambda one: words & {*one} == {"header"} and OWN_HEADS & {*one}
    return any(words & {*one} and not QUALIFIERS & {*one} and not own_head(one) for one in named)


class Node:
    """A block element or a run of text ('#'): its tag, its signature, what stands in it, and whether it may be an aside."""

    __slots__ = ("tag", "sign", "kids", "text", "links", "aside", "whole")

    def __init__(self, tag: str, sign: str, aside: bool = False):
        self.tag, self.sign, self.aside = tag, sign, aside
        self.kids: list[Node] = []
        self.text, self.links, self.whole = [], 0, False


class Reader(HTMLParser):
    """The tree of a page without what is no content by its own marks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "html")
        self.path = [self.root]
        self.open: list[tuple[str, bool]] = []
        self.dropping, self.link = 0, 0

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def _drops(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag in DROPPED or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
            return True
        within = {n.tag for n in self.path}
        return says(attrs, TALK) or (tag == "article" and "article" in within) or (tag == "header" and not within & {"article", "main"})

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self._space(tag)
            return
        if self.dropping:
            self.dropping += 1
            self.open.append((tag, False))
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in CLOSES.get(tag, ()):
                self._close(i)
            elif self.open[i][0] in FENCES:
                break
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")
        if self._drops(tag, known):
            self.dropping = 1
            self._space(tag)
            self.open.append((tag, False))
            return
        aside = tag not in ("html", "body", "main", "article") and says(known, ASIDE)
        inline = tag not in BLOCKS and not aside
        made = not inline and len(self.path) < DEPTH
        self._space(tag)
        if made:
            role = "main" if known.get("role") == "main" else "article" if known.get("itemprop") == "articleBody" else tag
            sign = " ".join([tag, *sorted(known.get("class", "").split())])
            self.path[-1].kids.append(node := Node(role, sign, aside))
            self.path.append(node)
        elif inline:
            self.link += tag == "a"
        self.open.append((tag, made))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return
            if self.open[i][0] in ("article", "main", "body", "td") and tag not in BLOCKS:
                return

    def _close(self, to: int) -> None:
        while len(self.open) > to:
            tag, made = self.open.pop()
            if self.dropping:
                self.dropping -= 1
            elif made:
                node = self.path.pop()
                self._space(tag)
                if node.aside and not node.whole:
                    self.path[-1].kids.pop()
                else:
                    self.path[-1].whole |= node.whole or node.tag in ("article", "main")
            elif tag == "a" and self.link:
                self.link -= 1
            else:
                self._space(tag)

    def _space(self, tag: str) -> None:
        """White space at line breaks and cells; where a block begins or ends, the end of the run before it."""
        if not self.dropping and (tag in BLOCKS or tag in SPACED) and (kids := self.path[-1].kids) and kids[-1].sign == "#":
            kids[-1].text.append(" ")
            kids[-1].whole |= tag in BLOCKS

    def handle_data(self, data):
        if self.dropping:
            return
        kids = self.path[-1].kids
        if not kids or kids[-1].sign != "#" or kids[-1].whole:
            if not data.strip():
                return
            kids.append(Node("#", "#"))
        kids[-1].text.append(data)
        kids[-1].links += len(data) if self.link else 0


def read(html: str) -> Node:
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader._close(0)
    for node in _walk(reader.root):
        if node.sign == "#":
            node.text = " ".join("".join(node.text).split())
    return reader.root


def _walk(node: Node):
    yield node
    for kid in node.kids:
        yield from _walk(kid)


class Folded:
    """Nodes of a page of one signature and one place: sign, tag, the nodes, and their children folded."""

    __slots__ = ("sign", "tag", "members", "kids")

    def __init__(self, members: list[Node]):
        self.sign, self.tag, self.members = members[0].sign, members[0].tag, members
        groups: list[list[Node]] = []
        flow: dict[str, list[Node]] = {}
        many: dict[str, int] = {}
        for member in members:
            at = 0
            for kid in member.kids:
                if kid.tag in FLOW or many.get(kid.sign, 0) >= WIDE:
                    if kid.sign not in flow:
                        flow[kid.sign] = [kid]
                        groups.append(flow[kid.sign])
                    else:
                        flow[kid.sign].append(kid)
                    continue
                # The next group of this signature after the last that was filled; adjacent ones with a class fold.
                if at and groups[at - 1][0].sign == kid.sign and " " in kid.sign:
                    groups[at - 1].append(kid)
                    continue
                for i in range(at, len(groups)):
                    if groups[i][0].sign == kid.sign and groups[i] is not flow.get(kid.sign):
                        groups[i].append(kid)
                        at = i + 1
                        break
                else:
                    many[kid.sign] = many.get(kid.sign, 0) + 1
                    groups.append([kid])
                    at = len(groups)
        self.kids = [Folded(group) for group in groups]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).digest())


def tree_of(folded: Folded) -> list:
    """A page's tree as a template of one page: sign, tag, pages, least and largest hash of the text, plain and link characters, children."""
    low = high = plain = links = 0
    if folded.sign == "#":
        hashes = [_hash(m.text) for m in folded.members]
        low, high = min(hashes), max(hashes)
        links = sum(m.links for m in folded.members)
        plain = max(0, sum(len(m.text) for m in folded.members) - links)
    return [folded.sign, folded.tag, 1, low, high, plain, links, [tree_of(kid) for kid in folded.kids]]


def shape(tree: list) -> str:
    return f"{tree[0]}({','.join(shape(kid) for kid in tree[7])})"


def matching(a: list, b: list, known: dict) -> tuple[int, list[tuple[int, int]]]:
    """Nodes matched in two trees whose roots are equal, and which children are paired. Equal texts count once more."""
    if (id(a), id(b)) in known:
        return known[id(a), id(b)]
    best = [[0] * (len(b[7]) + 1) for _ in range(len(a[7]) + 1)]
    gain: dict[tuple[int, int], int] = {}
    for i, x in enumerate(a[7]):
        for j, y in enumerate(b[7]):
            most = max(best[i][j + 1], best[i + 1][j])
            if x[0] == y[0]:
                gain[i, j] = matching(x, y, known)[0]
                most = max(most, best[i][j] + gain[i, j])
            best[i + 1][j + 1] = most
    pairs, i, j = [], len(a[7]), len(b[7])
    while i and j:
        if (i - 1, j - 1) in gain and best[i][j] == best[i - 1][j - 1] + gain[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    same = a[0] == "#" and a[3:5] == b[3:5]
    known[id(a), id(b)] = 1 + same + best[-1][-1], pairs[::-1]
    return known[id(a), id(b)]


def merged(a: list, b: list, known: dict) -> list:
    pairs = matching(a, b, known)[1]
    kids, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[7]), len(b[7]))]:
        kids += a[7][i:x] + b[7][j:y]
        if x < len(a[7]) and y < len(b[7]):
            kids.append(merged(a[7][x], b[7][y], known))
        i, j = x + 1, y + 1
    return [a[0], a[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4]), a[5] + b[5], a[6] + b[6], kids]


def _added(a: list, b: list) -> list:
    """merged for trees of one shape."""
    return [a[0], a[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4]), a[5] + b[5], a[6] + b[6], [_added(x, y) for x, y in zip(a[7], b[7], strict=True)]]


class Induced:
    """The tree of some pages of a host and the least hashes of their texts, by which LEAST different pages are told."""

    def __init__(self, tree: list, marks: list[int]):
        self.tree, self.marks = tree, marks

    def with_other(self, other: Induced, same_shape: bool = False) -> Induced:
        tree = _added(self.tree, other.tree) if same_shape else merged(self.tree, other.tree, {})
        return Induced(tree, sorted({*self.marks, *other.marks})[:LEAST])

    def text(self) -> str:
        return json.dumps([self.tree, self.marks], ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def of(cls, text: str) -> Induced:
        return cls(*json.loads(text))

    def constant(self, node: list) -> bool:
        return node[0] == "#" and node[3] == node[4] and len(self.marks) >= LEAST and node[2] >= LEAST and 2 * node[2] > self.tree[2]

    def mass(self, node: list) -> int:
        own = 0 if node[0] != "#" or self.constant(node) or node[6] > node[5] else node[5]
        return own + sum(self.mass(kid) for kid in node[7])

    def centre(self) -> list[int]:
        """The way, by child numbers, to the lowest node that holds SHARE of the varying text."""
        node, way, whole = self.tree, [], self.mass(self.tree)
        while whole:
            held = [(self.mass(kid), i) for i, kid in enumerate(node[7])]
            most, i = max(held, default=(0, 0))
            if most < SHARE * whole or node[7][i][1] in FLOW:
                break
            way.append(i)
            node = node[7][i]
        return way


def _of_page(html: str) -> tuple[Folded, Induced]:
    folded = Folded([read(html)])
    tree = tree_of(folded)
    return folded, Induced(tree, [_hash("\n".join(n.text for n in _walk(folded.members[0]) if n.sign == "#"))])


def _tops(folded: Folded, tag: str) -> list[Folded]:
    if folded.tag == tag:
        return [folded]
    return [found for kid in folded.kids for found in _tops(kid, tag)]


def main_text(html: str, template: Induced | None) -> str:
    """The blocks of a page that its host's template leaves, joined by line ends."""
    if not html:
        return ""
    folded, own = _of_page(html)
    template = template or own
    known: dict = {}
    gone: set[int] = set()
    centre: list[Folded] = []
    articles = _tops(folded, "article") or _tops(folded, "main")

    def align(page: Folded, tree: list, node: list, way: list[int] | None) -> None:
        if way == []:
            centre.append(page)
        pairs = dict(matching(tree, node, known)[1])
        for i, kid in enumerate(page.kids):
            if i not in pairs:
                continue
            j = pairs[i]
            other = node[7][j]
            if template.constant(other) or (not articles and other[0] == "#" and other[6] > other[5]):
                gone.update(map(id, kid.members))
            align(kid, tree[7][i], other, way[1:] if way and way[0] == j else None)

    align(folded, own.tree, template.tree, template.centre())
    if not articles and not centre:
        at = folded
        for i in own.centre():
            at = at.kids[i]
        centre = [at]
    wanted = {id(m) for one in articles or centre for m in one.members}
    out: list[str] = []

    def tell(node: Node, inside: bool) -> None:
        inside = inside or id(node) in wanted
        if node.sign == "#" and inside and node.text and id(node) not in gone:
            out.append(node.text)
        for kid in node.kids:
            tell(kid, inside)

    tell(folded.members[0], False)
    return "\n".join(out)


def _bucket(shape: str) -> int:
    return int.from_bytes(hashlib.blake2b(shape.encode("utf-8", "replace"), digest_size=7).digest())


def templates(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The tree of each host with all its pages: host, tree."""

    def induce(batches):
        held: dict[tuple[str, str], Induced] = {}

        def told():
            rows = [(name, _bucket(form), found.text()) for (name, form), found in held.items()]
            held.clear()
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["host", "bucket", "tree"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _of_page(text)[1]
                at = (name, shape(own.tree))
                held[at] = held[at].with_other(own, same_shape=True) if at in held else own
                if len(held) >= HELD:
                    yield told()
        yield told()

    def join(group: pa.Table) -> pa.Table:
        found = None
        for text in group.sort_by("tree")["tree"].to_pylist():
            one = Induced.of(text)
            found = one if found is None else found.with_other(one, shape(found.tree) == shape(one.tree))
        return pa.table({"host": group["host"].slice(0, 1), "bucket": pa.array([group["bucket"][0].as_py()], pa.int64()), "tree": [found.text()]})

    rows = pages.where(F.col(key).isNotNull() & (F.length(html) > 0)).select(key, html).mapInArrow(induce, TREE)
    rows = cut(rows)
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        most = -(-most // FAN)
        rows = cut(rows.withColumn("bucket", F.pmod("bucket", F.lit(most))).groupBy("host", "bucket").applyInArrow(lambda g: join(g), TREE))
    return rows.select("host", "tree")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with _host and text, the main text of html."""
    rows = pages.withColumn("_host", host(url))
    found = templates(rows, "_host", html).withColumnRenamed("host", "_host")
    small = text_bytes(found, "tree") <= BROADCAST_BYTES
    names = [c for c in pages.columns if c != html]
    rows = rows.select(*names, "_host", html).join(F.broadcast(found) if small else found, "_host", "left")
    schema = rows.select(*names).withColumn("text", F.lit("")).schema
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        known: dict[str, Induced] = {}
        for batch in batches:
            trees, texts = batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()
            out = []
            for tree, text in zip(trees, texts, strict=True):
                if tree is not None and tree not in known:
                    if len(known) >= HELD:
                        known.clear()
                    known[tree] = Induced.of(tree)
                out.append(main_text(text, known.get(tree)))
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(columns, kinds, strict=False)), pa.array(out, pa.string())], names=[*names, "text"])

    return rows.select(*names, html, "tree").mapInArrow(run, schema)
