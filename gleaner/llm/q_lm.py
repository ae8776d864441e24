"""op8: language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import lmscore
from gleaner.llm.common import table


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_texts(table(spark, sf_dir, "documents"))
