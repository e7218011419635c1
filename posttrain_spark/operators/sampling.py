"""Seeded samples, quotas, splits, batches. Random choices are orders by ``md5(seed|key)``, so they repeat anywhere."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import free_name, materialize


#: Rows that a split sorts at most, and rows of a range of the global order.
SORTED_ROWS, RANGE_ROWS = 100_000, 1_000_000


def hash_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows, the first in hash order (ties by key); fewer if there are fewer."""
    return rows.orderBy(hash_order(seed, key), key).limit(n)


def sample_exactly(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """As ``sample``; asking for more than there are is an error."""
    if n > (total := rows.count()):
        raise ValueError(f"{n} rows asked for, {total} there")
    return sample(rows, n, seed, key)


def drawn_indices(total: int, n: int, seed: int = 67) -> list[int]:
    """Line numbers as Python's own generator draws them, ascending; for small n only, on the driver."""
    if n > total:
        raise ValueError(f"{n} lines asked for, {total} there")
    return sorted(random.Random(seed).sample(range(total), n))


def quota_sample(rows: DataFrame, quotas: dict[str, int | None], stratum: str, key: str, seed: int, strict: bool = False) -> DataFrame:
    """Per stratum the first rows in hash order up to its quota, all for None; strata without a quota are dropped.

    ``strict``: a stratum that is missing or has too few rows is an error. Within a stratum the rank is needed
    only up to its quota, which Spark's window group limit applies before the shuffle.
    """
    spark = rows.sparkSession
    if strict:
        have = {r[stratum]: r["count"] for r in rows.filter(F.col(stratum).isin(list(quotas))).groupBy(stratum).count().collect()}
        short = {k: q for k, q in quotas.items() if have.get(k, 0) < max(1, q or 0)}
        if short:
            raise ValueError(f"too few rows for {short}")
    out = rows.filter(F.col(stratum).isin([k for k, q in quotas.items() if q is None])) if any(q is None for q in quotas.values()) else rows.limit(0)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, key), key))
    bounded = {k: q for k, q in quotas.items() if q is not None}
    if bounded:
        quota, nth = free_name(rows, "quota"), free_name(rows, "nth")
        table = F.broadcast(spark.createDataFrame(list(bounded.items()), f"`{stratum}` string, `{quota}` long"))
        ranked = rows.join(table, stratum).withColumn(nth, rank).filter(F.col(nth) <= max(bounded.values())).filter(F.col(nth) <= F.col(quota))
        out = out.unionByName(ranked.select(*rows.columns))
    return out


def split(rows: DataFrame, validation: float, seed: int, key: str) -> DataFrame:
    """Adds ``split``: the first ceil(n * validation) in hash order are for validation.

    The cut is found by counting hash prefixes, four digits longer each time, until few rows share the prefix in which
    it lies; only these are sorted.
    """
    n = math.ceil(rows.count() * validation)
    if n <= 0:
        return rows.withColumn("split", F.lit("train"))
    h = hash_order(seed, key)
    hashes, prefix, left = rows.select(h.alias("h"), F.col(key).alias("k")), "", n
    for digits in range(4, 33, 4):
        # At most 65,536 prefixes of so many digits begin with the one that is known.
        counts = hashes.filter(F.col("h").startswith(prefix)).groupBy(F.substring("h", 1, digits).alias("p")).count().orderBy("p").collect()
        for r in counts:
            if left <= r["count"]:
                prefix, size = r["p"], r["count"]
                break
            left -= r["count"]
        if size <= SORTED_ROWS:
            break
    edge = hashes.filter(F.col("h").startswith(prefix)).orderBy("h", "k").limit(left).agg(F.max(F.struct("h", "k")).alias("s")).first()["s"]
    inside = (h < edge["h"]) | ((h == edge["h"]) & (F.col(key) <= edge["k"]))
    return rows.withColumn("split", F.when(inside, "validation").otherwise("train"))


def ranged(rows: DataFrame, order: list[str], part: str) -> DataFrame:
    """The rows in ranges of the global order, of about ``RANGE_ROWS`` each, written; ``part``: which range."""
    buckets = max(partitions(rows.sparkSession), rows.count() // RANGE_ROWS + 1)
    # Written, since the ranges must not change between two readings.
    return materialize(rows.repartitionByRange(buckets, *order).withColumn(part, F.spark_partition_id()), "ranges")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """0, 1, ... in the global order, without one task for all rows: ranks within ranges, offset by the ranges' sizes."""
    part, before = free_name(rows, "part"), free_name(rows, "before")
    dealt = ranged(rows, order, part)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offset = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(before)).withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn(name, rank.cast("long")).join(F.broadcast(offset), part).withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def chunks(rows: DataFrame, workers: int, order: list[str]) -> DataFrame:
    """Contiguous chunks of ceil(n / workers) rows: ``chunk``; there may be fewer chunks than workers."""
    size = max(1, math.ceil(rows.count() / workers))
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("row_index") / size))


def batches(rows: DataFrame, batch_size: int, seed: int, key: str, drop_last: bool = True, resume_after: int = 0) -> DataFrame:
    """Shuffled batches: ``batch`` from 1; the same seed gives the same ones, so a run resumes after any batch."""
    total = rows.count()
    h = free_name(rows, "h")
    out = numbered(rows.withColumn(h, hash_order(seed, key)), [h, key]).drop(h).withColumn("batch", F.floor(F.col("row_index") / batch_size) + 1)
    if drop_last:
        out = out.filter(F.col("batch") <= total // batch_size)
    return out.filter(F.col("batch") > resume_after).drop("row_index")


def first_groups(rows: DataFrame, group: str, target: int, seed: int) -> DataFrame:
    """The rows of the first ``target`` groups in hash order: accumulating groups until a batch is full."""
    kept = rows.select(group).distinct().orderBy(hash_order(seed, group), group).limit(target)
    return rows.join(kept, group, "left_semi")
