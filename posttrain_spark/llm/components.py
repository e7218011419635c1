"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


#: Parts that the links of one node are dealt to, so that a hub is no single task's.
SALTS = 16


def _with_lowest(links: DataFrame, low: DataFrame) -> DataFrame:
    """``links`` (a, b) with the value m that ``low`` (a, m) has for a; the links of a hub are dealt to ``SALTS`` parts."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["a", "salt"]).select("a", "b", "m")


def _largest(edges: DataFrame) -> DataFrame:
    """Large star: every node links its larger neighbours to its smallest one (itself included)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_lowest(both.filter("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _smallest(edges: DataFrame) -> DataFrame:
    """Small star: every node links its smaller neighbours, and itself, to the smallest one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_lowest(down, low).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of the links (``a``, ``b``), both long.

    Rounds of large star and small star until nothing changes: O(log n) rounds in practice, each two
    aggregations with map-side minima, so a hub costs no more than its links. Nothing is collected but one
    checksum a round, and each round is a written table in the shared folder. Self links, links in either
    direction and repeated links are fine; null ends are ignored.
    """
    edges = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "links")
    state = None
    while True:
        new = materialize(_smallest(_largest(edges)).filter("a <> b").distinct(), "links")
        release(edges)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(edges.select("b", "b").distinct().toDF("node", "component"))
