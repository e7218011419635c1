"""The registered queries of the data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_queries, data_queries, more_queries  # noqa: F401  (they register their queries)
from .base import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word overlap of each conversation's answers with its last question."""
    return chat_queries.h14_word_jaccard(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
