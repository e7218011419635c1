"""Metric series (``metric``, ``step``, ``value``), counters, timings and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(points: DataFrame, fail_on_conflict: bool = False) -> DataFrame:
    """One value a (metric, step): that of the latest file (``mtime``, then ``pos``). Optionally an error where values differ."""
    out = points.groupBy("metric", "step").agg(F.max_by("value", F.struct("mtime", "pos")).alias("value"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    if fail_on_conflict:
        clash = F.concat(F.lit("conflict in "), F.col("metric"), F.lit(" at "), F.col("step").cast("string"))
        out = out.filter(F.when(F.col("_lo") < F.col("_hi"), F.raise_error(clash).cast("boolean")).otherwise(True))
    return out.drop("_lo", "_hi")


def as_json(series: DataFrame) -> DataFrame:
    """``metric`` and its steps as a JSON object with ascending steps."""
    pairs = F.array_sort(F.collect_list(F.struct("step", "value")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["step"].cast("string"), F.lit('":'), p["value"].cast("string"))), ",")
    return series.groupBy("metric").agg(F.concat(F.lit("{"), text, F.lit("}")).alias("steps"))


def bounds(series: DataFrame) -> DataFrame:
    """Number of steps of each metric, and steps before the run resumed (``offset``)."""
    return series.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), (F.max("step") - F.count(F.lit(1))).alias("offset"))


def in_range(series: DataFrame, start: int = 1, end: int = 0) -> DataFrame:
    """Steps from start to end (exclusive), 1-based; a negative start and an end of at most 0 count from the last step."""
    b = bounds(series)
    lo = F.lit(start) + (F.col("n") + 1 + F.col("offset") if start < 0 else 0)
    hi = F.lit(end) + (F.col("n") + 1 + F.col("offset") if end <= 0 else 0)
    return series.join(b, "metric").filter((F.col("step") >= lo) & (F.col("step") < hi)).select("metric", "step", "value")


def trimmed_mean(series: DataFrame, start: int = 1, end: int = 0, ignore_top_p: float = 0.0) -> DataFrame:
    """Mean over a range without the largest share; at least one value stays."""
    if not 0.0 <= ignore_top_p <= 1.0:
        raise ValueError("ignore_top_p must be between 0 and 1")
    rows = in_range(series, start, end)
    if ignore_top_p > 0:
        w = Window.partitionBy("metric")
        n = F.count(F.lit(1)).over(w)
        keep = F.greatest(F.floor(n * (1.0 - ignore_top_p)), F.lit(1))
        rows = rows.withColumn("_keep", keep).withColumn("_r", F.row_number().over(w.orderBy("value", "step"))).filter("_r <= _keep")
    return rows.groupBy("metric").agg(F.avg("value").alias("mean"))


def medians(series: DataFrame, start: int = 1, end: int = 0) -> DataFrame:
    return in_range(series, start, end).groupBy("metric").agg(F.median("value").alias("median"))


def extremes(series: DataFrame, threshold: float) -> DataFrame:
    """``min``, ``max`` and the share of values of at least a threshold."""
    return series.groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg((F.col("value") >= threshold).cast("double")).alias("ratio_above"))


#: What a check may compute.
HELPERS = {"min": lambda s, **k: s.groupBy("metric").agg(F.min("value").alias("value")), "max": lambda s, **k: s.groupBy("metric").agg(F.max("value").alias("value")), "mean": lambda s, **k: trimmed_mean(s, **k).withColumnRenamed("mean", "value"), "median": lambda s, **k: medians(s, **k).withColumnRenamed("median", "value"), "ratio_above": lambda s, threshold: extremes(s, threshold).select("metric", F.col("ratio_above").alias("value"))}
COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b}


def checks(series: DataFrame, wanted: list[dict]) -> DataFrame:
    """``check``, ``passed``, ``value``, ``message`` for checks given as dicts of ``metric``, ``helper``, ``op``, ``limit`` and ``args``; an unknown metric or helper fails."""
    spark = series.sparkSession
    out = None
    for i, c in enumerate(wanted):
        text = f"{c['helper']}({c['metric']}) {c['op']} {c['limit']}"
        one = spark.range(1).select(F.lit(i).alias("check"), F.lit(text).alias("text"))
        if c["helper"] in HELPERS:
            value = HELPERS[c["helper"]](series.filter(F.col("metric") == c["metric"]), **c.get("args", {})).agg(F.max("value").alias("value"))
            one = value.select(F.lit(i).alias("check"), F.lit(text).alias("text"), "value")
        else:
            one = one.withColumn("value", F.lit(None).cast("double"))
        out = one if out is None else out.unionByName(one)
        out = out if i else one
    ok = F.lit(False)
    for i, c in enumerate(wanted):
        ok = F.when(F.col("check") == i, F.coalesce(COMPARE[c["op"]](F.col("value"), F.lit(c["limit"])), F.lit(False))).otherwise(ok)
    return out.withColumn("passed", ok).select("check", "passed", "value", F.concat(F.when(F.col("passed"), "PASS: ").otherwise("FAIL: "), "text").alias("message"))


def summary(series: DataFrame, shown: int = 3) -> DataFrame:
    """``count``, ``min``, ``max``, ``mean`` and the first and last steps when there are more than twice that."""
    steps = F.array_sort(F.collect_list("step"))
    n = F.count(F.lit(1))
    some = F.when(n > 2 * shown, F.concat(F.slice(steps, 1, shown), F.slice(steps, -shown, shown))).otherwise(steps)
    return series.groupBy("metric").agg(n.alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.array_join(F.transform(some, lambda s: s.cast("string")), ",").alias("steps"))


def worker_counters(rows: DataFrame, wanted: str = "spec_decode") -> DataFrame:
    """Sums over workers of counters whose name holds ``wanted``: ``metric``, ``position`` (1-based for lists, null for single values), ``value``; rows have ``value`` or ``vector``."""
    named = rows.filter(F.col("metric").contains(wanted))
    single = named.filter("value is not null").select("metric", F.lit(None).cast("int").alias("position"), "value")
    listed = named.filter("vector is not null").select("metric", F.posexplode("vector").alias("p", "value")).select("metric", (F.col("p") + 1).alias("position"), "value")
    return single.unionByName(listed).groupBy("metric", "position").agg(F.sum("value").alias("value"))


def acceptance(drafts: Column, draft_tokens: Column, accepted: Column) -> tuple[Column, Column]:
    """Acceptance length (1 without drafts) and rate (0 without draft tokens)."""
    return F.when(drafts > 0, 1 + accepted / drafts).otherwise(F.lit(1.0)), F.when(draft_tokens > 0, accepted / draft_tokens).otherwise(F.lit(0.0))


def position_rates(positions: Column, drafts: Column) -> Column:
    """Accepted at each position over drafts."""
    return F.transform(positions, lambda v: F.when(drafts > 0, v / drafts).otherwise(F.lit(0.0)))


def layer_means(rows: DataFrame, scale: float) -> DataFrame:
    """``metric``, its scaled mean over layers and the scaled layers, from rows of (metric, layers array)."""
    scaled = F.transform("layers", lambda v: v * scale)
    return rows.select("metric", (F.aggregate(scaled, F.lit(0.0), lambda a, v: a + v) / F.size("layers")).alias("mean"), scaled.alias("layers"))


def acceptance_percent(correct: Column, total: Column) -> Column:
    return correct / F.greatest(total, F.lit(1)) * 100


#: A line of a timing report: name and seconds.
TIMING = r"^\s*•?\s*([\w_/]+):\s*([\d.]+)\s*s"


def timing_line(line: Column) -> tuple[Column, Column]:
    """Metric and seconds; nulls for other lines."""
    found = line.rlike(TIMING)
    return F.when(found, F.regexp_extract(line, TIMING, 1)), F.when(found, F.regexp_extract(line, TIMING, 2).try_cast("double"))


def timing_blocks(lines: DataFrame, file: str = "file", pos: str = "pos", line: str = "line") -> DataFrame:
    """``file``, ``block``, ``metric``, ``seconds`` of a training log: "Logged data to" ends a block, "Timing:" opens its section; the last value of a name counts."""
    before = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(file).orderBy(pos)
    ends, opens = F.col(line).contains("Logged data to").cast("int"), F.col(line).contains("Timing:").cast("int")
    at = lines.withColumn("block", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    section = Window.partitionBy(file, "block").orderBy(pos)
    at = at.withColumn("_open", F.sum(opens).over(section)).filter("_open > 0")
    name, seconds = timing_line(F.col(line))
    named = at.select(file, "block", pos, name.alias("metric"), seconds.alias("seconds")).filter("metric is not null and seconds is not null")
    del upto
    return named.groupBy(file, "block", "metric").agg(F.max_by("seconds", pos).alias("seconds"))


def timing_summary(blocks: DataFrame, keys: list[str], total: str = "total_step_time") -> DataFrame:
    """Per metric mean, sample deviation (0 for one value), steps and share of the mean step total; the logged total is left out."""
    parts = blocks.filter(F.col("metric") != total)
    mean_total = parts.groupBy(*keys).agg(F.sum("seconds").alias("t")).agg(F.avg("t")).first()[0] or 1.0
    return parts.groupBy("metric").agg(F.avg("seconds").alias("mean"), F.coalesce(F.stddev_samp("seconds"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("steps")).withColumn("share", F.col("mean") / F.lit(mean_total))


def logprob_error(a: Column, b: Column) -> Column:
    return F.avg(F.exp(F.abs(a - b)))


def best_checkpoints(rows: DataFrame, metric: str, k: int, higher_is_better: bool = True, tie: str = "step") -> DataFrame:
    return rows.orderBy(F.desc(metric) if higher_is_better else F.asc(metric), F.desc(tie)).limit(k)
