"""op9: graded quality of all documents. Grades: 0 toxic, 1 poor, 2 good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import quality
from gleaner.llm.common import table


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = quality.fit(documents, quality.graded(labels, grade), n_grades=3)
    return quality.rate(documents, model).withColumn("selected", F.col("p_at_least_1") >= 0.5)
