"""The corpus pipeline: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes and returns documents (doc_id, text, lang, source, n_chars); the last returns the packed pieces. run
writes every stage's rows to the shared folder and reads them back as the next stage's input.

Defined results, beyond the operators' own: a document without any letter or of uncertain language is rejected; of a
class of near copies the smallest doc_id stays, and of rows with one doc_id in it the one whose other columns sort
first; a document of which nothing but white space is left after repeats are cut goes; a null doc_id is a copy of none. Every stage decides by
row, so different texts with one doc_id, or with none, each stay or go by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontam, langid, neardup, packing, suffixdedup
from gleaner.llm.common import cut, new_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.4
REPEAT_BYTES = 250


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the byte network names with some certainty."""
    docs = docs.select(*COLUMNS)
    net = langid.fit(docs.select("text", "lang"))
    named = langid.identify(docs, net)
    return named.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def with_row(docs: DataFrame) -> DataFrame:
    """docs with _row, a hash of all columns that is never null: equal for equal rows only."""
    missing = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in COLUMNS])
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS, missing).alias("_row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    docs = with_row(docs)
    classes = neardup.near_duplicate_classes(docs.select(F.col("_row").alias("doc_id"), "text"))
    classes = cut(classes.where("class_size > 1").select(F.col("doc_id").alias("_row"), "class_id").distinct())
    known = docs.where(F.col("doc_id").isNotNull())
    first = known.join(classes, "_row").groupBy("class_id").agg(F.min(F.struct(*COLUMNS)).alias("first")).select("first.*")
    alone = known.join(classes, "_row", "left_anti").select(*COLUMNS)
    return alone.unionByName(first).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of REPEAT_BYTES or more, about 40 words, that stands in two places."""
    left = suffixdedup.without_repeats(docs.select(*COLUMNS), REPEAT_BYTES, keep=COLUMNS[2:])
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).where(F.col("text").rlike(r"\S")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that leak no benchmark item."""
    docs = with_row(docs)
    leaking = decontam.leaks(docs.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    return docs.join(leaking, "_row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("benchmark_leaks", benchmark_leaks),
    ("pack", pack),
]

#: SQL can express none of the learned and iterative stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), new_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
