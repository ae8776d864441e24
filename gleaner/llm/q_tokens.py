"""op3 and op5: packing and token files of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import packing, tokenfile
from gleaner.llm.common import new_path, table


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path)
    return tokenfile.read_index(spark, path)
