"""op13: hard negatives of every hundredth vector, after a seventh of the labels were moved on by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import vptree
from gleaner.llm.common import table


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vptree.usable(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vptree.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """WITH e AS (SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.i, a.vec_id AS anchor_id, a.label = b.label AS same, b.i AS j, b.vec_id, list_inner_product(a.x, b.x)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.i <> b.i AND len(a.x) = len(b.x)),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id, j) <= 5)
  SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.i = p.i AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score WINDOW w AS (PARTITION BY p.i, p.j ORDER BY s.score DESC, s.vec_id, s.j) QUALIFY row_number() OVER w <= 10"""
