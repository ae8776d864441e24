"""op10: documents that leak benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontam
from gleaner.llm.common import table


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
