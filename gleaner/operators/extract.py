"""Locators over the element table: unnesting, fields, label rows, genres, lazy images and page facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import tidy, trim
from gleaner.sources.html import attribute, has_siblings, matches, select, text

Wanted = Mapping[str, tuple[str, str, bool]]


def unnest(nodes: DataFrame, key: str, selector: str) -> DataFrame:
    """Matching elements with their position (from 0) in the document."""
    found = select(nodes, key, selector)
    return found.withColumn("pos", (F.row_number().over(Window.partitionBy(key).orderBy("node")) - 1).cast("int"))


def first_of(nodes: DataFrame, key: str, selector: str, attr: str | None = None, name: str = "value") -> DataFrame:
    """The trimmed text or attribute of each document's first match: key, name."""
    value = attribute(attr) if attr else text()
    return select(nodes, key, selector).groupBy(key).agg(F.min_by(value, F.col("node")).alias(name))


def _first(selector: str, attr: str, exists: bool, name: str) -> Column:
    """Over a group of elements: the first match's value, or '1' where only its presence is asked; no selector takes all."""
    hit = matches(selector) if selector else F.lit(True)
    if exists:
        return F.max(F.when(hit, "1")).alias(name)
    return F.min_by(attribute(attr) if attr else text(), F.when(hit, F.col("node"))).alias(name)


def firsts(nodes: DataFrame, key: str, wanted: Wanted) -> DataFrame:
    """For name: (selector, attribute or '', presence only), each document's first match, in one pass: key and the names.

    A selector with sibling combinators needs a pass of its own. Documents without any match have no row.
    """
    plain = {name: at for name, at in wanted.items() if not has_siblings(at[0])}
    out = nodes.where(matches(", ".join(at[0] for at in plain.values()))).groupBy(key).agg(*[_first(*at, name) for name, at in plain.items()]) if plain else None
    for name, (selector, attr, exists) in wanted.items():
        if name not in plain:
            value = F.max(F.lit("1")) if exists else F.min_by(attribute(attr) if attr else text(), F.col("node"))
            one = select(nodes, key, selector).groupBy(key).agg(value.alias(name))
            out = one if out is None else out.join(one, key, "full")
    return out.select(key, *wanted)


def item_fields(nodes: DataFrame, key: str, items: DataFrame, wanted: Wanted) -> DataFrame:
    """The same within each item of unnest: key, pos and the names; no selector reads the item's own element.

    All fields without sibling combinators share one join and one grouping by item.
    """
    out = items.select(key, "pos")
    own = {name: at for name, at in wanted.items() if not at[0]}
    plain = {name: at for name, at in wanted.items() if at[0] and not has_siblings(at[0])}
    if own:
        out = items.select(key, "pos", *[(F.lit("1") if exists else attribute(attr) if attr else text()).alias(name) for name, (_, attr, exists) in own.items()])
    if plain:
        within = inside(nodes, key, items, ", ".join(at[0] for at in plain.values()))
        out = out.join(within.groupBy(key, "pos").agg(*[_first(*at, name) for name, at in plain.items()]), [key, "pos"], "left")
    for name, (selector, attr, exists) in wanted.items():
        if name not in own and name not in plain:
            value = F.max(F.lit("1")) if exists else F.min_by(attribute(attr) if attr else text(), F.col("node"))
            out = out.join(inside(nodes, key, items, selector).groupBy(key, "pos").agg(value.alias(name)), [key, "pos"], "left")
    return out.select(key, "pos", *wanted)


def label_table(nodes: DataFrame, key: str, row: str, label: str, value: str = "") -> DataFrame:
    """Rows for label_rows: every value of every row element that has a label; without a value selector, the row's text."""
    rows = unnest(nodes, key, row)
    labels = item_fields(nodes, key, rows, {"label": (label, "", False)}).where("label <> ''")
    values = inside(nodes, key, rows, value) if value else rows
    return labels.join(values.select(key, "pos", F.col("node").alias("value_pos"), F.col("text").alias("value")), [key, "pos"]).withColumnRenamed("pos", "row_pos")


def texts_of(nodes: DataFrame, key: str, selector: str, attr: str | None = None, name: str = "values") -> DataFrame:
    """All filled texts or attributes of each document's matches, in order."""
    rows = select(nodes, key, selector).select(key, "node", (attribute(attr) if attr else text()).alias("v")).where("v <> ''")
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "v"))), lambda s: s["v"]).alias(name))


def present(nodes: DataFrame, key: str, selector: str, name: str = "present") -> DataFrame:
    """'1' or '' for each document: whether anything matches."""
    hits = select(nodes, key, selector).select(key).distinct().withColumn("_hit", F.lit("1"))
    return nodes.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("_hit", F.lit("")).alias(name))


def inside(nodes: DataFrame, key: str, items: DataFrame, selector: str) -> DataFrame:
    """Elements that match an item or within it (item_node, pos of items); what stands in a nested item is that item's."""
    below = select(nodes, key, selector)
    item = items.select(key, F.col("node").alias("item_node"), F.col("last").alias("item_last"), "pos")
    nxt = item.withColumn("until", F.coalesce(F.lead("item_node").over(Window.partitionBy(key).orderBy("item_node")), F.lit(2**31 - 1)))
    return below.join(nxt, key).where((F.col("node") >= F.col("item_node")) & (F.col("node") < F.col("until")) & (F.col("node") <= F.col("item_last")))


def label_values(rows: DataFrame, key: str, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """rows(key, row_pos, label, value_pos, value) gathered by field: key, field, values of all rows whose label holds one of the field's.

    Values are tidied and in order; empty ones are dropped. All fields share one grouping.
    """
    fields = F.filter(F.array(*[F.when(F.exists(F.array(*[F.lit(w.lower()) for w in wanted]), lambda w: F.contains(F.lower("label"), w)), F.lit(name)) for name, wanted in labels.items()]), lambda f: f.isNotNull())
    each = rows.select(key, "row_pos", "value_pos", tidy("value").alias("v"), F.explode(fields).alias("field")).where("v <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_pos", "value_pos", "v"))), lambda s: s["v"])
    return each.groupBy(key, "field").agg(ordered.alias("values"))


def label_rows(rows: DataFrame, key: str, labels: Mapping[str, Sequence[str]], joins: Mapping[str, str] | None = None) -> DataFrame:
    """label_values as one text a field: key, field, value, joined by the field's separator."""
    separator = F.coalesce(*[F.when(F.col("field") == name, F.lit(j)) for name, j in (joins or {}).items()], F.lit(", "))
    return label_values(rows, key, labels).select(key, "field", F.array_join("values", "\x00").alias("_v"), separator.alias("_j")).select(key, "field", F.replace("_v", F.lit("\x00"), F.col("_j")).alias("value"))


def lazy_source(source: Column, lazy: Column, within: str) -> Column:
    """An image's source, or its lazy one where the source is missing, inline data, or repeated in its document."""
    src = F.coalesce(trim(source), F.lit(""))
    repeated = F.count(F.lit(1)).over(Window.partitionBy(within, src)) > 1
    return F.when((src == "") | F.startswith(src, F.lit("data:")) | repeated, F.coalesce(trim(lazy), F.lit(""))).otherwise(src)


def hydrated(plain_count: Column, rendered_count: Column) -> Column:
    """Whether a page fills itself by script: over 30 elements and half as many again when rendered."""
    return (rendered_count > plain_count + 30) & (rendered_count > plain_count * 1.5)


def repeating_groups(nodes: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Likely item groups: elements of one parent that share a tag and classes: key, parent, tag, classes, n, selector."""
    classes = F.array_sort(F.array_distinct(F.filter(F.split(attribute("class"), r"\s+"), lambda c: c != "")))
    groups = nodes.select(key, "parent", "tag", "node", classes.alias("classes")).groupBy(key, "parent", "tag", "classes").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node")).where(F.col("n") >= least)
    return groups.withColumn("selector", F.concat("tag", F.array_join(F.transform("classes", lambda c: F.concat(F.lit("."), F.regexp_replace(c, r"([^\w-])", r"\\$1"))), "")))


def shared_classes(nodes: DataFrame, key: str) -> DataFrame:
    """Classes that all elements of a (key, parent, tag) group have."""
    classes = F.filter(F.split(attribute("class"), r"\s+"), lambda c: c != "")
    total = nodes.groupBy(key, "parent", "tag").agg(F.count(F.lit(1)).alias("n"))
    each = nodes.select(key, "parent", "tag", F.explode(F.array_distinct(classes)).alias("cls")).groupBy(key, "parent", "tag", "cls").agg(F.count(F.lit(1)).alias("m"))
    return each.join(total, [key, "parent", "tag"]).where("m = n").groupBy(key, "parent", "tag").agg(F.array_sort(F.collect_list("cls")).alias("classes"))
