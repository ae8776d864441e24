"""The queries users call, over tables of items: listings, tags, details, chapters, pages, filters, probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import first_filled
from gleaner.sources.store import cut


def catalog_page(items: DataFrame, key: Sequence[str], order: Sequence[Column | str], page: int, page_size: int) -> DataFrame:
    """One page of every listing, with pos (from 0) and whether a page follows."""
    by = Window.partitionBy(*key).orderBy(*order)
    total = F.count(F.lit(1)).over(Window.partitionBy(*key))
    rows = items.withColumns({"_row": F.row_number().over(by) - 1, "_total": total})
    start = (page - 1) * page_size
    rows = rows.where((F.col("_row") >= start) & (F.col("_row") < start + page_size))
    return rows.withColumns({"pos": (F.col("_row") - start).cast("int"), "has_next": F.col("_total") > page * page_size}).drop("_row", "_total")


def has_next(total: Column, page: Column, page_size: Column, next_flag: Column, kept: Column, has_next_control: Column) -> Column:
    """A total decides if the site gives one, then a full page where there is no next control, then the control."""
    by_total = total.isNotNull() & (page_size > 0)
    number = F.coalesce(total.try_cast("int"), F.lit(0))
    return F.when(by_total, page * page_size < number).when(~has_next_control & (page_size > 0), kept >= page_size).otherwise(next_flag == "1")


def complete(items: DataFrame) -> DataFrame:
    """Items that have both an address and a title."""
    return items.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))


def chapters(items: DataFrame, key: str, order: Sequence[Column | str], name: str = "name", url: str = "url", newest_first: bool = True) -> DataFrame:
    """Chapters with an address, numbered in the site's order; unnamed ones are 'Chapter N'; newest_first turns pos round."""
    rows = items.where(F.coalesce(F.col(url), F.lit("")) != "")
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("_n", n).withColumn(name, first_filled(F.col(name), F.concat(F.lit("Chapter "), F.col("_n").cast("string"))))
    pos = F.count(F.lit(1)).over(Window.partitionBy(key)) - F.col("_n") if newest_first else F.col("_n") - 1
    return rows.withColumn("pos", pos.cast("int")).drop("_n")


def offsets(total: Column, page_size: int, max_items: int = 1000, ceiling: int = 10_000) -> Column:
    """Offsets of a feed's pages: up to its total (at most the ceiling), or up to max_items where it gives none."""
    limit = F.when(total.isNull(), F.lit(max_items)).otherwise(F.least(total, F.lit(ceiling))).cast("bigint")
    return F.when(limit > 0, F.sequence(F.lit(0).cast("bigint"), limit - 1, F.lit(page_size).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def tagged(tags: Column, included: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """All of included and none of excluded; nothing included selects nothing."""
    if not included:
        return F.lit(False)
    has = F.forall(F.array(*map(F.lit, included)), lambda t: F.array_contains(tags, t))
    return has & ~F.arrays_overlap(tags, F.array(*map(F.lit, excluded))) if excluded else has


def filter_groups(options: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """options(group_id, option_id, label, seen) by group: named order first, then as found, options by label."""
    listed = {name: i for i, name in enumerate(order)}
    place = F.coalesce(*[F.when(F.col("group_id") == k, F.lit(v)) for k, v in listed.items()], F.lit(len(listed)))
    groups = options.where(F.coalesce("option_id", F.lit("")) != "").groupBy("group_id").agg(
        F.min("seen").alias("first_seen"), F.array_sort(F.collect_list(F.struct("label", "option_id"))).alias("options")
    )
    by = Window.orderBy(place, "first_seen", "group_id")
    return groups.select("group_id", F.row_number().over(by).alias("group_pos"), F.transform("options", lambda o: o["option_id"]).alias("options"))


def first_candidate(candidates: DataFrame, key: str, order: str, size: str, limit: int = 5) -> DataFrame:
    """Of each key's first candidates the first that has anything: a probe's choice."""
    top = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= limit)
    return top.where(F.col(size) > 0).groupBy(key).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != key]), F.col(order)).alias("c")).select(key, "c.*")


def sample_positions(n: Column) -> Column:
    """First, middle and last position of n items, each once."""
    return F.when(n > 0, F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), (n - 1).cast("int")))).otherwise(F.array().cast("array<int>"))


def probe_status(stages: Sequence[tuple[str, Column]], skip: Sequence[str] = ()) -> Column:
    """The first stage whose count is 0 or null; null if all passed. Stages in skip are left out; pages need chapters."""
    left_out = {*skip, "pages"} if "chapters" in skip else set(skip)
    stages = [(name, n) for name, n in stages if name not in left_out]
    return F.lit(None).cast("string") if not stages else F.coalesce(*[F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(name)) for name, n in stages])


def guessed_tag(genres: Column, options: Column) -> Column:
    """The tag a probe tries: the first genre of its candidate, else the first option of the first filter."""
    return F.coalesce(F.get(genres, F.lit(0)), F.get(options, F.lit(0)))


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The last rows of each key: history kept and history shown."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def first_of_each(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several tables, one for each key: the earliest table wins, then the smallest row."""
    names = tables[0].columns
    rows = None
    for i, t in enumerate(tables):
        one = t.select(*names).withColumn("_load", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.min(F.struct("_load", *[c for c in names if c != key])).alias("r")).select(key, *[f"r.{c}" for c in names if c != key])


def follow(start: DataFrame, responses: DataFrame, max_pages: int = 50) -> DataFrame:
    """Pages reached from start(url) by responses(url, next): origin, url, page, at most max_pages a chain; next null or '' ends one.

    Links are joined with themselves, so that they lead 1, 2, 4 and more pages on, and each round doubles what is reached:
    as many rounds as max_pages has binary digits, without any bound on rows. Repeated starts and links count once.
    """
    reached = start.select(F.col("url").alias("origin"), "url", F.lit(1).alias("page")).distinct()
    leap = responses.where("next <> ''").select("url", "next").distinct()
    step = 1
    while step < max_pages:
        far = reached.where(F.col("page") + step <= max_pages).join(leap, "url").select("origin", F.col("next").alias("url"), (F.col("page") + step).alias("page"))
        reached = cut(reached.unionByName(far))
        step *= 2
        if step < max_pages:
            again = leap.select(F.col("url").alias("next"), F.col("next").alias("_then"))
            leap = cut(leap.join(again, "next").select("url", F.col("_then").alias("next")))
    return reached
