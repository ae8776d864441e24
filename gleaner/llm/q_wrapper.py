"""op11: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import wrapper
from gleaner.llm.common import table


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The blocks of the only article that each page of the given tables has, which hold no other markup than b and br.
_BLOCKS = r"string_split(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:h1|p)>', chr(1), 'g'), chr(1))"
_PLAIN = "replace(replace(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&amp;?', chr(2), 'g'), '&quot;', chr(34)), chr(2), '&')"
ORACLE = rf"""SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, array_to_string([t FOR t IN [trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g')) FOR b IN {_BLOCKS}] IF t <> ''], chr(10)) AS text FROM pages)"""
