"""Set operations over JSON lines and tables: canonical keys, difference, first occurrences, unions, repeats."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.storage import free_name
from .sampling import numbered, ranged


def is_object(line: Column) -> Column:
    """Whether a line is a JSON object; false for blank, invalid and other JSON lines."""
    v = F.try_parse_json(line)
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def canonical_json(line: Column) -> Column:
    """Sorted keys, no spaces; null if invalid. Whole floats lose their ``.0`` (see ``exact_key``)."""
    return F.to_json(F.try_parse_json(line))


def canonical_text(line: str) -> str | None:
    """The exact canonical form of one line: a string ``dataset`` left out, numbers as written by Python, non-ASCII kept; null unless an object."""
    try:
        row = json.loads(line)
    except ValueError:
        return None
    if not isinstance(row, dict):
        return None
    if isinstance(row.get("dataset"), str):
        del row["dataset"]
    return json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def exact_key(lines: pd.Series) -> pd.Series:
    """``canonical_text`` of each line: 1 and 1.0 differ, as Python's own JSON tells them apart."""
    return lines.map(lambda x: None if x is None else canonical_text(x))


def exact_keyed(lines: DataFrame, column: str = "line", name: str = "key") -> DataFrame:
    return lines.withColumn(name, exact_key(F.col(column)))


def without_field(line: Column, field: str) -> Column:
    """The canonical form without one field if that is a string."""
    v = F.try_parse_json(line)
    as_map = F.from_json(F.to_json(v), "map<string,variant>")
    kept = F.map_filter(as_map, lambda k, x: ~((k == field) & (F.schema_of_variant(x) == "STRING")))
    return F.when(is_object(line), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))))


def first_occurrence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order. Only (key, order) is ranked where a hot key would hold whole rows: the minimum is found by aggregation, which combines before the shuffle."""
    at, name = F.struct(*order), free_name(rows, "first")
    first = rows.groupBy(*keys).agg(F.min(at).alias(name))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    joined = rows.alias("r").join(first.alias("f"), reduce(lambda a, b: a & b, same) & (F.struct(*(F.col(f"r.{c}") for c in order)) == F.col(f"f.{name}")))
    return joined.select(*(F.col(f"r.{c}") for c in rows.columns))


def set_minus(a: DataFrame, b: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of A whose key isn't in B, the first of each key; rows without a key (invalid) go."""
    left = a.filter(F.col(key).isNotNull()).join(b.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*a.columns)
    return first_occurrence(left, [key], order)


def set_minus_statistics(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``kept``, ``excluded``, ``duplicates`` and ``invalid`` rows of A."""
    counts = a.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    other = b.select(F.col(key).alias("k"), F.lit(True).alias("found")).filter("k is not null").distinct()
    marked = counts.join(other, F.col("key") == F.col("k"), "left")
    valid, excluded = F.col("key").isNotNull(), F.col("found").isNotNull()
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0).cast("long"))
    return marked.agg(
        total(valid & ~excluded, F.lit(1).cast("long")).alias("kept"),
        total(valid & excluded, F.col("n")).alias("excluded"),
        total(valid & ~excluded, F.col("n") - 1).alias("duplicates"),
        total(~valid, F.col("n")).alias("invalid"),
    )


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), tables)


def repeat(rows: DataFrame, n: int, name: str | None = None) -> DataFrame:
    """Every row n times, as a generator within the row's task: no shuffle and no join."""
    copy = name or free_name(rows, "copy")
    out = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else rows.limit(0).withColumn(copy, F.lit(0))
    return out if name else out.drop(copy)


def stamp(rows: DataFrame, value: str, name: str = "dataset") -> DataFrame:
    """A constant column; an existing one keeps its place."""
    if not value.strip():
        raise ValueError("the value must not be blank")
    return rows.withColumn(name, F.lit(value))


def lookup(rows: DataFrame, table: DataFrame, key: str, max_rows: int = 10_000) -> DataFrame:
    """Joins a dimension table; a key it lacks is an error. Broadcast if it has at most ``max_rows`` (counted)."""
    found = free_name(rows.join(table, key), "found")
    marked = table.withColumn(found, F.lit(True))
    side = F.broadcast(marked) if marked.count() <= max_rows else marked
    out = rows.join(side, key, "left")
    return out.filter(F.when(F.col(found).isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop(found)


def zipped(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of two tables side by side by their place in an order; the longer one's rest goes. Column names must differ."""
    at = free_name(a.join(b.limit(0), F.lit(True)), "place")
    return numbered(a, order_a, at).join(numbered(b, order_b, at), at).drop(at)


def merge_counters(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Union of keys with both values, missing ones as 0."""
    x, y = a.select(key, F.col(value).alias("start")), b.select(key, F.col(value).alias("end"))
    return x.join(y, key, "full_outer").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("start", "end")))


def conversation_hash(messages: list[dict]) -> int:
    """BLAKE2b-512 over the number of fields, and each stripped key and value with its length; keys sorted; values that are no strings are empty."""
    import hashlib

    size = lambda n: n.to_bytes(8, "little")
    h = hashlib.blake2b(size(len(messages)), digest_size=64)
    for m in messages:
        h.update(size(len(m)))
        for field in sorted(m):
            value = m[field] if isinstance(m[field], str) else ""
            for part in (field.strip().encode(), value.strip().encode()):
                h.update(size(len(part)) + part)
    return int.from_bytes(h.digest(), "little")


def with_conversation_hash(rows: DataFrame, messages: str, name: str = "hash") -> DataFrame:
    """The conversation hash as decimal text, by Arrow batches."""
    schema = StructType([*rows.schema.fields, StructField(name, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: [str(conversation_hash([dict(m) for m in ms])) for ms in pdf[messages]]})

    return rows.mapInPandas(run, schema)


def occurrence(rows: DataFrame, key: str, order: list[str], name: str = "nth") -> DataFrame:
    """1, 2, ... within each key. A key of many rows is ranked range by range and offset by what the ranges before hold of it."""
    part, before = free_name(rows, "part"), free_name(rows, "before")
    dealt = ranged(rows, [key, *order], part)
    rank = F.row_number().over(Window.partitionBy(part, key).orderBy(*order))
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a range and key
    offset = dealt.groupBy(key, part).agg(F.count(F.lit(1)).alias(before)).withColumn(before, F.sum(before).over(earlier)).filter(F.col(before).isNotNull())
    offset = offset.select(F.col(key).alias(f"{before}_key"), F.col(part).alias(f"{before}_part"), before)  # only keys that reach over ranges
    ranked = dealt.withColumn(name, rank)
    joined = ranked.join(offset, (F.col(part) == F.col(f"{before}_part")) & F.col(key).eqNullSafe(F.col(f"{before}_key")), "left")
    return joined.select(*rows.columns, (F.col(name) + F.coalesce(before, F.lit(0))).cast("int").alias(name))
