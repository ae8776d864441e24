"""op2: the language of every document, learned from the documents that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import langid
from gleaner.llm.common import crc_mod, table


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = langid.fit(documents.where(crc_mod("doc_id", 3) != 1).select("text", "lang"))
    found = langid.identify(documents.select("doc_id", "text"), net)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
