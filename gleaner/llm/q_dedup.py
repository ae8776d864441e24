"""op4 and op7: repeated bytes and near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import neardup, suffixdedup
from gleaner.llm.common import table


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removal_digests(table(spark, sf_dir, "documents"), threshold=400)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"), threshold=0.8)
