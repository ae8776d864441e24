"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become lower-cased words. In the template form numbers, units after numbers and names (capitalised words inside a
sentence) become typed placeholders. Windows of ``WORDS`` consecutive words are hashed in both forms and joined with the
benchmark's windows, so a copied question is found with its wording, and one with other numbers or names by its template.
Matches of a row and an item at one alignment form a candidate. Windows with equal wording always count; template windows
need consistent slots: one benchmark name always stands against one document name, else none of the candidate's template
windows counts. Equal numbers or units of an item may be different quantities, so where they stand against several values
only the windows with the less usual ones don't count (of equally usual values the smallest stays). A document leaks an
item if ``least`` different windows of the item (all, if it has fewer) count.

Template windows of placeholders alone are left out. The matched windows of a leak hold together ``LITERAL`` different
words of the item that are no placeholders, or all the item has, and ``FEWEST`` at least; all words of a wording window
count. So a question dense in numbers is found, but common phrases of few words and many numbers aren't. Items shorter
than a window are looked up with windows of their own length, down to ``SHORTEST`` words; shorter ones, which cannot be told
from common phrases, are leaked by documents whose whole text has just their words.

Defined results: null text counts as empty; the windows of a doc_id's rows count together, slots are compared by row; of
the texts of a repeated item_id the best covered is given; a null item_id is kept as it is; no documents, no benchmark and items without words
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut

WORDS, LITERAL, FEWEST, SHORTEST = 8, 5, 3, 4
NAME, POINT = "", ""
SLOTS = ("<name>", "<num>", "<unit>")
#: Units of measure, money and time.
UNITS = (
    "%", "percent", "mm", "cm", "m", "km", "meter", "meters", "metre", "metres", "inch", "inches", "ft", "feet", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "lb", "lbs", "pound", "pounds", "oz", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres",
    "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "cent", "cents", "mph", "kmh", "hz", "khz", "mhz", "kb", "mb", "gb",
)

#: Windows that may be sent to every task; a larger benchmark is joined by shuffling.
BROADCAST_WINDOWS = 500_000
#: Windows that may stand in the plan as a list, so that documents without any of them are passed over before the join.
LISTED_WINDOWS = 20_000
BROADCAST_DOCUMENTS = 500_000


def _marked(text: Column) -> Column:
    """A name starts with NAME, POINT stands for the point or comma inside a number. What few places have is looked for first."""
    text = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;:]\s)", NAME)
    return F.when(text.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", POINT), r"(?<=[0-9])(?=[\p{L}%])", " ")).otherwise(text)


def _words(marked: Column) -> Column:
    return F.array_remove(F.split(F.lower(marked), rf"[^a-z0-9\p{{L}}\p{{N}}%{NAME}{POINT}]+|%(?:(?![\s.,;:!?)]|$)|(?<![0-9] %))"), "")


def marked_words(text: Column) -> Column:
    """Lower-cased words; a name starts with NAME, POINT stands for the point or comma inside a number."""
    return _words(_marked(text))


def _number(word: Column) -> Column:
    """Whether a word starts with one of 0 to 9."""
    return (word >= "0") & (word < ":")


def plain(words: Column) -> Column:
    return F.transform(words, lambda w: F.replace(w, F.lit(NAME), F.lit("")))


def template(words: Column, name: object = SLOTS[0], number: object = SLOTS[1], unit: object = SLOTS[2], other: Callable[[Column], Column] = lambda w: w) -> Column:
    """The words with typed placeholders, or what stands for either."""

    def slot(w: Column, i: Column) -> Column:
        after_number = F.coalesce(_number(F.get(words, i - 1)), F.lit(False))
        return F.when(F.startswith(w, F.lit(NAME)), name).when(_number(w), number).when(w.isin(*UNITS) & after_number, unit).otherwise(other(w))

    return F.transform(words, slot)


def _slots(words: Column) -> Column:
    return F.exists(words, lambda w: F.startswith(w, F.lit(NAME)) | _number(w))


def _codes(words: Column, slots: Column) -> Column:
    """A number for each word of the wording (plain) and, where there may be placeholders, of the template (shape, else null)."""
    wording = F.transform(words, lambda w: F.xxhash64(F.replace(w, F.lit(NAME), F.lit(""))))
    shape = template(words, *[F.xxhash64(F.lit(s)) for s in SLOTS], other=F.xxhash64)
    plain = F.when(slots, wording).otherwise(F.transform(words, lambda w: F.xxhash64(w)))
    return F.struct(plain.alias("plain"), F.when(slots, shape).alias("shape"))


def _once(value: Column) -> Column:
    """The value behind a generator of one row, which the optimiser doesn't copy into the lambdas that use it."""
    return F.explode(F.array(value))


def _prepared(table: DataFrame, *key: str) -> DataFrame:
    """key, words, and where there are placeholders their template (else null)."""
    words = table.select(*key, _once(marked_words(F.coalesce("text", F.lit("")))).alias("words"))
    return words.select(*key, "words", F.when(_slots(F.col("words")), template(F.col("words"))).alias("template"))


def _windows(codes: Column, n: int) -> Column:
    """Hashes of every n consecutive codes."""
    count = F.greatest(F.size(codes) - (n - 1), F.lit(0))
    return F.transform(F.slice(codes, 1, count), lambda first, i: F.xxhash64(first, *[F.get(codes, i + j) for j in range(1, n)]))


def _literal(template: Column, words: Column) -> Column:
    """1 for every word that is no placeholder, else 0."""
    return F.when(template.isNull(), F.transform(words, lambda w: F.lit(1))).otherwise(F.transform(template, lambda w: F.when(w.isin(*SLOTS), 0).otherwise(1)))


def windows(table: DataFrame, n: int, *key: str, wanted: list[int] | None = None) -> DataFrame:
    """The key columns, pos, hash of every window of n words in wording, and of every window of the template where there are placeholders.

    Words and placeholders have different codes, so a window that holds a placeholder never equals one in wording, and a
    template window without any is the same as in wording. Of rows with none of the wanted hashes, if given, no windows are returned.
    """
    marked = table.select(*key, _once(_marked(F.coalesce("text", F.lit("")))).alias("marked"))
    slots = F.contains("marked", F.lit(NAME)) | F.col("marked").rlike("[0-9]")
    words = marked.select(*key, slots.alias("slots"), _once(_words(F.col("marked"))).alias("words"))
    coded = words.select(*key, _once(_codes(F.col("words"), F.col("slots"))).alias("c"))
    wording = _windows(F.col("c.plain"), n)
    both = F.when(F.col("c.shape").isNull(), wording).otherwise(F.concat(wording, _windows(F.col("c.shape"), n)))
    hashed = coded.select(*key, (F.size("c.plain") - (n - 1)).alias("count"), _once(both).alias("hashes"))
    if wanted is not None:
        listed = ", ".join(f"{h}L" for h in wanted) or "NULL"  # as text: a column for each of thousands takes the driver a second
        hashed = hashed.where(f"exists(hashes, h -> h IN ({listed}))")
    placed = hashed.select(*key, "count", F.posexplode("hashes").alias("at", "hash"))
    return placed.select(*key, (F.col("at") % F.col("count")).alias("pos"), "hash")


def forms(items: DataFrame, n: int) -> DataFrame:
    """item_row, item_pos, form (0 wording, 1 template), hash of the windows to look for. Template windows without a placeholder or without any other word are left out."""
    slots = F.transform("template", lambda w: F.when(w.isin(*SLOTS), 1).otherwise(0))
    words = _prepared(items, "item_row").select("item_row", "words", slots.alias("slots"))
    told = words.select("item_row", "slots", _once(_codes(F.col("words"), F.col("slots").isNotNull())).alias("c")).select("item_row", "slots", "c.*")
    used = F.aggregate(F.slice("slots", F.col("item_pos") + 1, n), F.lit(0), lambda a, b: a + b)
    wording = told.select("item_row", F.posexplode(_windows(F.col("plain"), n)).alias("item_pos", "hash"), F.lit(0).alias("form"))
    shaped = told.where(F.col("shape").isNotNull()).select("item_row", "slots", F.posexplode(_windows(F.col("shape"), n)).alias("item_pos", "hash"), F.lit(1).alias("form"))
    shaped = shaped.where((used > 0) & (used < n))
    columns = ["item_row", "item_pos", "form", "hash"]
    return wording.select(*columns).unionByName(shaped.select(*columns))


def matches(documents: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """doc_id, doc_row, item_row, pos, item_pos, form of equal windows."""
    wanted = cut(forms(items, n))
    count = wanted.count()
    few = [r["hash"] for r in wanted.select("hash").distinct().collect()] if count <= LISTED_WINDOWS else None
    if count <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    found = windows(documents, n, "doc_id", "doc_row", wanted=few).join(wanted, "hash")
    return found.select("doc_id", "doc_row", "item_row", "pos", "item_pos", "form").distinct()


def _consistent(found: DataFrame, documents: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The template windows of found whose slots are consistent within their alignment, and whether any value differs."""
    found = found.where("form = 1")
    rows = found.select("doc_row").distinct()
    if rows.count() <= BROADCAST_DOCUMENTS:
        rows = F.broadcast(rows)
    side = documents.join(rows, "doc_row", "left_semi").dropDuplicates(["doc_row"])
    own = _prepared(side, "doc_row").select("doc_row", F.col("words").alias("doc_words"))
    theirs = _prepared(items, "item_row").where(F.col("template").isNotNull()).select("item_row", F.col("words").alias("item_words"), F.col("template").alias("item_template"))
    at = lambda name, pos: F.slice(name, F.col(pos) + 1, n)
    place = ["doc_id", "doc_row", "item_row", "align"]
    pairs = (
        found.join(theirs, "item_row")
        .join(own, "doc_row")
        .select(*place, "item_pos", F.explode(F.arrays_zip(at("item_template", "item_pos").alias("kind"), plain(at("item_words", "item_pos")).alias("theirs"), plain(at("doc_words", "pos")).alias("own"))).alias("s"))
        .select(*place, "item_pos", "s.*")
        .where(F.col("kind").isin(*SLOTS))
    )
    uses = F.count(F.lit(1)).over(Window.partitionBy(*place, "kind", "theirs", "own"))
    usual = F.first("own").over(Window.partitionBy(*place, "kind", "theirs").orderBy(F.desc("uses"), "own"))
    judged = pairs.repartition(*place).withColumn("uses", uses).withColumn("odd", F.col("own") != usual)
    judged = judged.withColumn("mistaken", F.max(F.col("odd") & (F.col("kind") == "<name>")).over(Window.partitionBy(*place)))
    kept = judged.groupBy(*place, "item_pos").agg(F.max(F.col("odd") | F.col("mistaken")).alias("odd"), F.max(F.col("own") != F.col("theirs")).alias("other_values"))
    return kept.where(~F.col("odd")).select("doc_id", "item_row", "item_pos", F.lit(1).alias("form"), "other_values")


def _telling(n: int) -> Column:
    """Whether the seen windows hold words enough that are no placeholders; all words of a wording window count."""
    places = lambda w: F.sequence(w["item_pos"], w["item_pos"] + (n - 1))
    each = F.transform("seen", lambda w: F.when(w["form"] == 0, places(w)).otherwise(F.filter(places(w), lambda p: F.get("literal", p) == 1)))
    all_of_them = F.aggregate("literal", F.lit(0), lambda a, b: a + b)
    return F.size(F.array_distinct(F.flatten(each))) >= F.greatest(F.lit(FEWEST), F.least(F.lit(LITERAL), all_of_them))


def _whole(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks of items of few words: documents with the same words and no others."""
    run, gap = r"[\p{L}\p{N}][\p{L}\p{N}%.,]*+", r"[^\p{L}\p{N}]*+"
    said = lambda table: F.array_join(plain(marked_words(table["text"])), " ").alias("said")
    few = documents.where(F.col("text").rlike(rf"^{gap}(?:{run}{gap}){{1,{SHORTEST - 1}}}$"))  # at least those that can match
    both = few.select("doc_id", said(few)).join(items.select("item_id", said(items)), "said")
    one = F.lit(1).cast("long")
    return both.select("doc_id", "item_id", one.alias("n_windows"), one.alias("item_windows"), F.lit(1.0).alias("coverage"), F.lit(False).alias("reparameterised"))


def leaks(documents: DataFrame, benchmark: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, coverage, reparameterised of every leak."""
    documents = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_row"))
    size = F.size(marked_words(F.coalesce("text", F.lit(""))))
    items = benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("item_row")).dropDuplicates(["item_row"])
    items = cut(items.withColumn("n", F.least(size, F.lit(WORDS)).cast("int")).withColumn("item_windows", (size - F.col("n") + 1).cast("long")).where("n > 0"))
    short, items = items.where(F.col("n") < SHORTEST), items.where(F.col("n") >= SHORTEST)
    sizes = [r["n"] for r in items.select("n").distinct().orderBy("n").collect()]  # at most WORDS - SHORTEST + 1 rows
    out = None
    for n in sizes or [WORDS]:
        own = items.where(F.col("n") == n)
        found = cut(matches(documents, own, n).withColumn("align", F.col("pos") - F.col("item_pos")))
        wording = found.where("form = 0").select("doc_id", "item_row", "item_pos", "form", F.lit(False).alias("other_values"))
        kept = wording.unionByName(_consistent(found, documents, own, n))
        seen = F.collect_set(F.struct("item_pos", "form")).alias("seen")
        counted = kept.groupBy("doc_id", "item_row").agg(F.count_distinct("item_pos").alias("n_windows"), seen, F.max("other_values").alias("reparameterised"))
        about = _prepared(own, "item_row", "item_id", "item_windows").select("item_row", "item_id", "item_windows", _literal(F.col("template"), F.col("words")).alias("literal"))
        one = counted.join(about, "item_row").where((F.col("n_windows") >= F.least(F.lit(least), F.col("item_windows"))) & _telling(n))
        one = one.select("doc_id", "item_id", "n_windows", "item_windows", F.least(F.col("n_windows") / F.col("item_windows"), F.lit(1.0)).alias("coverage"), "reparameterised")
        out = one if out is None else out.unionByName(one)
    if not short.isEmpty():
        out = out.unionByName(_whole(documents, short))
    columns = ["coverage", "n_windows", "item_windows", "reparameterised"]
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct(*columns)).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.item_windows", "best.coverage", "best.reparameterised")
