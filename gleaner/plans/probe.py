"""A whole probe of described sites as one plan: does a listing lead to an item, its chapters and their pages?

All sources go through a stage together, and so do all candidates of a source: what they would ask for one after the other
is looked up at once, and what the probe would have stopped at is picked afterwards. Each stage is cut off, as several later
ones read it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.plans import adapters, feeds, steps
from gleaner.plans.steps import Step
from gleaner.sources import fused
from gleaner.sources.store import cut

RESULT = "n_popular", "candidate", "n_chapters", "chapter", "n_pages", "tag", "n_tag", "failed_stage"


def probed(sources: DataFrame, key: str, config: Mapping[str, Mapping], known: DataFrame, base: str, candidates: int = 5, first_option: str = "", skip: tuple[str, ...] = ()) -> DataFrame:
    """key and RESULT for each source(key, query): the first stage that failed, null if none did, and what was found until then.

    config has a listing as popular and, where these are probed, details (genres: selector and attribute), chapters, pages
    and tag, another listing. Of the first candidates of the listing the probe takes the first whose details and chapters
    are answered and that has chapters; one without an answer ends it. Of the candidate's first, middle and last chapter the
    first that has pages counts. The tag is the candidate's first genre, or first_option; a tag that fails fails no probe.
    Stages in skip are left out, and pages with chapters.
    """
    asks = sources.select(key, F.lit(1).alias("page"), "query")
    popular = cut(adapters.listing(asks, key, config["popular"], known, base).select(key, "items", F.size("items").alias("n_popular")))
    tried = popular.select(key, F.posexplode(F.slice("items", 1, candidates)).alias("place", "item")).select(F.struct(key, "place").alias("_c"), F.col("item.url").alias("url"))
    runs = tried.select("_c", F.create_map(F.lit("url"), F.col("url")).alias("vars"))

    found = tried.withColumns({"has_details": F.lit(True), "has_chapters": F.lit(True), "n_chapters": F.lit(None).cast("long"), "genre": F.lit(None).cast("string")})
    chapters = None
    if "details" not in skip:
        body = cut(steps.run_body(runs, "_c", [Step(base="url")], known, base))
        genres = fused.matches(body.select("_c", F.col("body").alias("html")), "_c", config["details"]["genres"][0], {"v": config["details"]["genres"][1]}).where("v <> ''")
        genres = genres.groupBy("_c").agg(F.min_by("v", "pos").alias("_genre"))
        found = found.join(body.select("_c", F.lit(True).alias("_read")), "_c", "left").join(genres, "_c", "left")
        found = found.withColumns({"has_details": F.coalesce("_read", F.lit(False)), "genre": F.col("_genre")}).drop("_read", "_genre")
    if "chapters" not in skip:
        records, reached = steps.run_parts(runs, "_c", steps.chapters_steps(config["chapters"]), known, base)
        chapters, reached = cut(adapters.told_chapters(records.withColumn("page", F.lit(1)), "_c", config["chapters"], base)), cut(reached)
        counted = reached.select("_c", F.lit(True).alias("_read")).join(chapters.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")), "_c", "left")
        found = found.join(counted, "_c", "left").withColumns({"has_chapters": F.coalesce("_read", F.lit(False)), "n_chapters": F.coalesce("_n", F.lit(0).cast("long"))}).drop("_read", "_n")

    # The candidate at which the probe ends: broken off, with chapters, or else the last.
    ends = ~F.col("has_details") | ~F.col("has_chapters") | (F.lit(True) if "chapters" in skip else F.col("n_chapters") > 0)
    order = Window.partitionBy("_c." + key).orderBy(F.desc("ends"), F.when(F.col("ends"), F.col("_c.place")), F.desc("_c.place"))
    chosen = found.withColumn("ends", ends).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    broken = F.when(~F.col("has_details"), "details").when(~F.col("has_chapters"), "chapters")
    chosen = cut(chosen.select(F.col(f"_c.{key}").alias(key), F.col("_c.place").alias("place"), F.col("url").alias("candidate"), "n_chapters", "genre", broken.alias("broken")))
    out = sources.select(key).join(popular.select(key, "n_popular"), key, "left").join(chosen, key, "left")

    none = {"chapter": F.lit(None).cast("string"), "n_pages": F.lit(None).cast("long"), "n_tag": F.lit(None).cast("long")}
    if chapters is not None and "pages" not in skip:
        sampled = chosen.where("broken IS NULL AND n_chapters > 0").select(F.struct(key, "place").alias("_c"), F.posexplode(feeds.sample_positions(F.col("n_chapters"))).alias("turn", "pos"))
        sampled = cut(sampled.join(chapters.select("_c", "pos", "url"), ["_c", "pos"]).select(F.struct("_c", "turn").alias("_p"), "url"))
        images = adapters.pages(sampled, "_p", config["pages"], known, base).groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
        best = sampled.join(images, "_p").groupBy(F.col(f"_p._c.{key}").alias(key)).agg(F.min_by(F.struct(F.col("url").alias("chapter"), F.col("n").alias("n_pages")), "_p.turn").alias("b"))
        out = out.join(cut(best.select(key, "b.*")), key, "left").withColumn("n_pages", F.when(F.col("n_chapters") > 0, F.coalesce("n_pages", F.lit(0).cast("long"))))
        none = {"n_tag": none["n_tag"]}
    tag = F.nullif(F.coalesce("genre", F.lit(first_option)), F.lit("")) if config.get("tag") else F.lit(None).cast("string")
    out = out.withColumns(none).withColumn("tag", F.when(F.col("broken").isNull() & (F.coalesce("n_popular", F.lit(0)) > 0), tag))
    if config.get("tag"):
        out = cut(out)
        tagged = adapters.listing(out.where("tag IS NOT NULL").select(key, F.lit(1).alias("page"), F.col("tag").alias("query")), key, config["tag"], known, base, path_safe=True)
        out = out.drop("n_tag").join(tagged.select(key, F.size("items").cast("long").alias("n_tag")), key, "left")
    stages = [("popular", F.col("n_popular")), *([("chapters", F.col("n_chapters")), ("pages", F.col("n_pages"))] if "chapters" not in skip else [])]
    status = feeds.probe_status(stages, [*skip])
    failed = F.when(F.coalesce("n_popular", F.lit(0)) > 0, F.coalesce("broken", status)).otherwise("popular")
    return out.select(key, *[failed.alias(n) if n == "failed_stage" else n for n in RESULT])
