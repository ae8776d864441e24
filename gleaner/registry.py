"""Queries of the extraction engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner import q_adapters, q_feeds, q_html, q_induce, q_steps, q_stores, q_text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for module in (q_html, q_text, q_feeds, q_steps, q_adapters, q_induce, q_stores) for name, (q, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in (q_html, q_text, q_feeds, q_steps, q_adapters, q_induce, q_stores) for name, (_, sql) in module.QUERIES.items() if sql}
