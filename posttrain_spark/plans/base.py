"""Registration of queries with their SQL, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL of the same result if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id`` and its ``messages`` in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: t["m"]).alias("messages"))


#: The same in SQL: roles and texts in order.
CHATS = "chats AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)"


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def sql_r6(c: Column | str) -> Column:
    """Half up on the product with a million, as DuckDB rounds doubles of 0 or more; ``round`` goes by the shortest decimal form, which differs at some ties."""
    p = (F.col(c) if isinstance(c, str) else c) * 1e6
    return (F.floor(p) + (p - F.floor(p) >= 0.5).cast("int")) / 1e6


#: Responses with tags, the same expression in Spark and DuckDB.
RESPONSE = """CASE WHEN doc_id % 4 = 0 THEN concat('<think>', source, '</think><answer>', lang, '!</answer>')
 WHEN doc_id % 4 = 1 THEN concat('<think>', lang, '</think> no answer')
 WHEN doc_id % 4 = 2 THEN concat('x <answer>', upper(source), '</answer> y </answer>')
 ELSE concat('plain ', source) END"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(RESPONSE).alias("response"))


RESPONSES = f"responses AS (SELECT doc_id, lang, source, {RESPONSE} AS response FROM documents)"


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rollouts: the user is the prompt, the value in whole units up to 7 the reward, a purchase is correct."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("prompt"), F.least(F.floor("value"), F.lit(7)).cast("double").alias("reward"), (F.col("event_type") == "purchase").cast("int").alias("correct"), "event_type", "ts")


ROLLOUTS = "rollouts AS (SELECT event_id, user_id AS prompt, least(floor(value), 7)::DOUBLE AS reward, (event_type = 'purchase')::INT AS correct, event_type, ts FROM events)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a metric series: the type by day of 2024, with whole-number daily counts as values."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("metric"), F.dayofyear("ts").cast("long").alias("step")).agg(F.count(F.lit(1)).cast("double").alias("value"))


SERIES = "series AS (SELECT event_type AS metric, dayofyear(ts)::BIGINT AS step, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"
