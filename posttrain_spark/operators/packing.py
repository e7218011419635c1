"""Ragged arrays: padding, collation, packing into bins, and statistics of a packing."""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.storage import free_name


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("long")


def padded(ids: Column, width: Column, pad: int = 0) -> Column:
    """Right-padded to a width; longer ones stay."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width.cast("int") - F.size(ids), F.lit(0))))


def well_padded(ids: Column, length: Column, pad: int) -> Column:
    """Whether the length fits and all later positions hold the pad value."""
    return (length <= F.size(ids)) & F.forall(F.slice(ids, length + 1, F.greatest(F.size(ids) - length, F.lit(0))), lambda x: x == pad)


def double_bos(ids: Column, bos: int) -> Column:
    """Whether the first two ids are both the start id."""
    return F.coalesce((F.get(ids, 0) == bos) & (F.get(ids, 1) == bos), F.lit(False))


def trimmed(ids: Column, length: Column) -> Column:
    return F.slice(ids, 1, length)


def cumulative(lengths: Column) -> Column:
    """Running totals with a leading 0."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def unpacked(row: Column, lengths: Column) -> Column:
    """A packed row cut by lengths."""
    starts = cumulative(lengths)
    return F.transform(lengths, lambda n, i: F.slice(row, F.get(starts, i) + 1, n))


def positions(lengths: Column) -> Column:
    """Positions that start again with each sequence."""
    return F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))


def causal(i: Column, j: Column) -> Column:
    """Whether position i of a packed row sees position j: one triangle over the whole row."""
    return j <= i


def flat_ids(messages: Column, field: str = "token_ids") -> Column:
    """Ids of all messages in turn."""
    return F.flatten(F.transform(messages, lambda m: m[field]))


def filled_generation(messages: Column, eos: list[int]) -> Column:
    """Assistant turns without tokens get the smallest end id, log-probability 0.0 and a flag; other turns stay."""
    if not eos:
        return messages
    empty = lambda m: (m["role"] == "assistant") & (F.size(m["token_ids"]) == 0)
    return F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.when(empty(m), F.array(F.lit(min(eos)).cast("long"))).otherwise(m["token_ids"].cast("array<bigint>")).alias("token_ids"),
            F.when(empty(m), F.array(F.lit(0.0).cast("float"))).otherwise(m["generation_logprobs"].cast("array<float>")).alias("generation_logprobs"),
            empty(m).alias("was_empty"),
        ),
    )


def eos_ids(config: str | int | list[int] | None) -> list[int]:
    """End ids from a number, a list or comma-separated text; anything else is an error."""
    if config is None:
        return []
    if isinstance(config, str):
        config = [int(x) for x in config.split(",")]
    return [config] if isinstance(config, int) else [int(x) for x in config]


def collate(rows: DataFrame, batch: str, length: str) -> DataFrame:
    """Adds ``batch_max_length``, joined from an aggregate."""
    return rows.join(rows.groupBy(batch).agg(F.max(length).alias("batch_max_length")), batch)


def collate_preferences(rows: DataFrame, batch: str, chosen: str, rejected: str, carry: list[str], multiple: int = 1, pad: int = 0) -> DataFrame:
    """Two rows a pair, chosen first (``side`` 0, 1), ids padded to the batch width rounded up; ``length`` before padding."""
    both = rows.select(batch, *carry, F.posexplode(F.array(chosen, rejected)).alias("side", "ids")).withColumn("length", F.size("ids"))
    wide = both.join(both.groupBy(batch).agg(round_up(F.max("length"), multiple).alias("width")), batch)
    return wide.withColumn("ids", padded(F.col("ids"), F.col("width"), pad))


def final_turn_mask(messages: Column, field: str = "token_ids") -> Column:
    """1 on the tokens of the last turn if the assistant speaks it, else 0."""
    n = F.size(messages)
    return F.flatten(F.transform(messages, lambda m, i: F.transform(m[field], lambda t: F.when((i == n - 1) & (m["role"] == "assistant"), 1).otherwise(0))))


def group_and_concat(rows: DataFrame, order: str, ids: str, sizes: list[int], pad: int, min_width: int = 0) -> DataFrame:
    """Consecutive arrays joined by group sizes and padded to the widest (at least ``min_width``): ``group``, ``ids``."""
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    nth = free_name(rows, "nth")
    at = F.col(nth)
    group = F.lit(None).cast("int")
    for g in reversed(range(len(ends))):
        group = F.when(at <= ends[g], g).otherwise(group)
    ranked = rows.withColumn(nth, F.row_number().over(Window.orderBy(order))).filter(at <= total) if total else rows.limit(0).withColumn(nth, F.lit(0))
    joined = ranked.groupBy(group.alias("group")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(nth), F.col(ids).alias("x")))), lambda s: s["x"])).alias("ids"))
    width = joined.agg(F.greatest(F.max(F.size("ids")), F.lit(min_width))).first()[0] or min_width
    return joined.withColumn("ids", padded(F.col("ids"), F.lit(width), pad))


class Rooms:
    """Room left in bins, as a tree of maxima that finds the first bin with enough."""

    def __init__(self, rooms: list[int]):
        self.size = 1 << max(0, len(rooms) - 1).bit_length()
        self.free = [0] * self.size + rooms + [-1] * (self.size - len(rooms))
        for k in range(self.size - 1, 0, -1):
            self.free[k] = max(self.free[2 * k], self.free[2 * k + 1])

    def first(self, n: int) -> int | None:
        if self.free[1] < n:
            return None
        k = 1
        while k < self.size:
            k = 2 * k if self.free[2 * k] >= n else 2 * k + 1
        return k - self.size

    def take(self, b: int, n: int) -> None:
        k = b + self.size
        self.free[k] -= n
        while k := k >> 1:
            self.free[k] = max(self.free[2 * k], self.free[2 * k + 1])


def _first_fit(lengths: list[int], order: list[int], capacity: int) -> list[list[int]]:
    """First bin with room for each item in turn."""
    rooms = Rooms([capacity] * len(lengths))
    bins: list[list[int]] = []
    for i in order:
        if (b := rooms.first(lengths[i])) is None:
            raise ValueError(f"an item of {lengths[i]} is longer than the capacity {capacity}")
        bins += [[] for _ in range(b + 1 - len(bins))]
        bins[b].append(i)
        rooms.take(b, lengths[i])
    return bins


def concatenative(lengths: list[int], capacity: int, seed: int = 0) -> list[list[int]]:
    """Items in order; a new bin when the next doesn't fit."""
    bins, room = [], -1
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= n
    return bins


def first_fit_decreasing(lengths: list[int], capacity: int, seed: int = 0) -> list[list[int]]:
    return _first_fit(lengths, sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)), capacity)


def first_fit_shuffle(lengths: list[int], capacity: int, seed: int = 0) -> list[list[int]]:
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    return _first_fit(lengths, order, capacity)


def modified_first_fit_decreasing(lengths: list[int], capacity: int, seed: int = 0) -> list[list[int]]:
    """Johnson and Garey's variant: bins of large items (over half) first take, from the least full on, a small pair (a sixth to a third) where two fit; the rest go first fit decreasing."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    large = [i for i in order if 2 * lengths[i] > capacity]
    medium = [i for i in order if capacity < 3 * lengths[i] and 2 * lengths[i] <= capacity]
    small = [i for i in order if capacity < 6 * lengths[i] and 3 * lengths[i] <= capacity]
    tiny = [i for i in order if 6 * lengths[i] <= capacity]
    bins = [[i] for i in large]
    room = [capacity - lengths[i] for i in large]

    def put(b: int, i: int) -> None:
        bins[b].append(i)
        room[b] -= lengths[i]

    def largest(pool: list[int], n: int) -> int:
        """Place of the largest item that fits in n; the pool's size if none does."""
        return bisect_left(pool, -n, key=lambda i: -lengths[i])

    for b in range(len(bins)):
        if (k := largest(medium, room[b])) < len(medium):
            put(b, medium.pop(k))
    for b in reversed(range(len(bins))):
        if len(bins[b]) == 1 and len(small) >= 2 and lengths[small[-1]] + lengths[small[-2]] <= room[b]:
            put(b, small.pop())
            put(b, small.pop(largest(small, room[b])))
    rooms, rest = Rooms(room), []
    for i in sorted([*medium, *small, *tiny], key=lambda i: (-lengths[i], i)):
        b = rooms.first(lengths[i]) if bins else None
        if b is None:
            rest.append(i)
        else:
            bins[b].append(i)
            rooms.take(b, lengths[i])
    left = _first_fit([lengths[i] for i in rest], list(range(len(rest))), capacity)
    return bins + [[rest[j] for j in g] for g in left if g]


PACKERS: dict[str, Callable[..., list[list[int]]]] = {
    "concatenative": concatenative,
    "first_fit_decreasing": first_fit_decreasing,
    "first_fit_shuffle": first_fit_shuffle,
    "modified_first_fit_decreasing": modified_first_fit_decreasing,
}


def get_packer(name: str) -> Callable[..., list[list[int]]]:
    if name.lower() not in PACKERS:
        raise ValueError(f"unknown packer {name!r}; known: {sorted(PACKERS)}")
    return PACKERS[name.lower()]


def pack(rows: DataFrame, batch: str, key: str, length: str, capacity: int, packer: str = "first_fit_decreasing", seed: int = 0) -> DataFrame:
    """``batch``, ``key``, ``length``, ``bin``: each batch packed by itself (a batch is bounded by its definition). A sequence over the capacity is an error."""
    f = get_packer(packer)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        if (pdf[length] > capacity).any():
            raise ValueError(f"a sequence is longer than the capacity {capacity}")
        bin_of = {i: b for b, group in enumerate(f(pdf[length].tolist(), capacity, seed)) for i in group}
        return pdf.assign(bin=[bin_of[i] for i in range(len(pdf))])

    kept = rows.select(batch, key, length)
    return kept.groupBy(batch).applyInPandas(one, StructType([*kept.schema.fields, StructField("bin", IntegerType())]))


def dynamic_batches(rows: DataFrame, group: str, key: str, length: str, budget: int, multiple: int = 1) -> DataFrame:
    """Micro-batches by ascending length: a new one when the widest rounded length times the rows would exceed the budget. Adds ``micro_batch``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, key], kind="stable").reset_index(drop=True)
        out, n, b = [], 0, 0
        for size in pdf[length]:
            wide = -(-int(size) // multiple) * multiple
            if n and wide * (n + 1) > budget:
                b, n = b + 1, 0
            n += 1
            out.append(b)
        return pdf.assign(micro_batch=out)

    kept = rows.select(group, key, length)
    return kept.groupBy(group).applyInPandas(one, StructType([*kept.schema.fields, StructField("micro_batch", IntegerType())]))


def packing_statistics(loads: DataFrame, capacity: int, by: list[str] | None = None) -> DataFrame:
    """The ten figures of a packing, from rows of (``bin``, ``length``): one row, or one for each ``by``; zeros without a bin."""
    by = by or []
    bins = loads.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("load"))
    spread = F.stddev_samp(F.col("load") / capacity)
    s = bins.groupBy(*by).agg(F.sum("n").alias("num_sequences"), F.count(F.lit(1)).alias("num_bins"), F.sum("load").alias("total_sequence_length"), spread.alias("_s"))
    zero = F.lit(0).cast("long")
    s = s.withColumns({c: F.coalesce(c, zero) for c in ("num_sequences", "num_bins", "total_sequence_length")})
    s = s.withColumn("total_bin_capacity", F.col("num_bins") * capacity)
    s = s.withColumn("total_waste", F.col("total_bin_capacity") - F.col("total_sequence_length"))
    some = F.col("num_bins") > 0
    share = lambda x: F.when(some, x / F.col("total_bin_capacity")).otherwise(F.lit(0.0))
    s = s.withColumn("average_utilization", share(F.col("total_sequence_length"))).withColumn("waste_ratio", share(F.col("total_waste")))
    s = s.withColumn("bin_balance", F.when(F.col("num_bins") > 1, 1.0 - F.col("_s") / F.col("average_utilization")).when(some, 1.0).otherwise(0.0))
    s = s.withColumn("theoretical_min_bins", F.ceil(F.col("total_sequence_length") / capacity))
    return s.withColumn("bin_efficiency", F.when(some, F.col("theoretical_min_bins") / F.col("num_bins")).otherwise(0.0)).drop("_s")


def aggregated_statistics(solutions: DataFrame, time: str | None = None) -> DataFrame:
    """Totals and ranges over rows of ``packing_statistics``; minima start at 1.0 and maxima at 0.0."""
    least = lambda c: F.least(F.min(c), F.lit(1.0))
    most = lambda c: F.greatest(F.max(c), F.lit(0.0))
    mean_capacity = F.sum("total_bin_capacity") / F.sum("num_bins")
    extra = [F.avg(time).alias("average_packing_time")] if time else []
    return solutions.agg(
        F.sum("num_sequences").alias("total_sequences"),
        F.sum("num_bins").alias("total_bins"),
        (F.sum("total_sequence_length") / F.sum("total_bin_capacity")).alias("average_utilization"),
        least("average_utilization").alias("min_utilization"),
        most("average_utilization").alias("max_utilization"),
        (F.sum("total_waste") / F.sum("total_bin_capacity")).alias("average_waste_ratio"),
        least("waste_ratio").alias("min_waste_ratio"),
        most("waste_ratio").alias("max_waste_ratio"),
        F.avg("num_bins").alias("average_bin_count"),
        (F.ceil(F.sum("total_sequence_length") / mean_capacity) / F.sum("num_bins")).alias("bin_efficiency"),
        *extra,
    )


class PackedTensor:
    """A list of optional ragged pieces as ``array<array<..>>``; pieces are packed along one dimension, equal for all that are joined."""

    def __init__(self, pieces: Column, dim_to_pack: int = 0):
        self.pieces, self.dim_to_pack = pieces, dim_to_pack

    def _same(self, others: list[PackedTensor]) -> None:
        if any(o.dim_to_pack != self.dim_to_pack for o in others):
            raise ValueError("dimensions to pack differ")

    def concat(self, *others: PackedTensor) -> PackedTensor:
        """All pieces in one list."""
        self._same(list(others))
        return PackedTensor(F.concat(self.pieces, *(o.pieces for o in others)), self.dim_to_pack)

    def flattened_concat(self, *others: PackedTensor) -> PackedTensor:
        """One piece of each, its pieces joined; null if all are."""
        self._same(list(others))
        one = lambda p: F.when(F.exists(p, lambda x: x.isNotNull()), F.flatten(F.filter(p, lambda x: x.isNotNull())))
        return PackedTensor(F.array(one(self.pieces), *(one(o.pieces) for o in others)), self.dim_to_pack)

    def slice(self, indices: list[int]) -> PackedTensor:
        return PackedTensor(F.array(*(F.get(self.pieces, i) for i in indices)), self.dim_to_pack)

    def empty_like(self) -> PackedTensor:
        return PackedTensor(F.transform(self.pieces, lambda x: F.lit(None).cast("array<int>")), self.dim_to_pack)

    def packed(self) -> Column:
        return F.flatten(F.filter(self.pieces, lambda x: x.isNotNull()))


def concatenate_and_chunk(rows: DataFrame, order: str, length: str, size: int) -> DataFrame:
    """Which chunks of ``size`` tokens each document of a running text falls in: ``first_chunk``, ``last_chunk``, ``offset``."""
    from .sampling import numbered

    at = numbered(rows, [order])
    blocks = at.withColumn("_b", F.floor(F.col("row_index") / 4096))
    sums = blocks.groupBy("_b").agg(F.sum(length).alias("_n"))
    before = sums.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_n")
    inner = F.coalesce(F.sum(length).over(Window.partitionBy("_b").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    out = blocks.join(before, "_b").withColumn("offset", inner + F.col("_base"))
    last = F.greatest(F.col("offset") + F.col(length) - 1, F.col("offset"))
    return out.withColumn("first_chunk", F.floor(F.col("offset") / size)).withColumn("last_chunk", F.floor(last / size)).drop("_b", "_base", "row_index")


def stream_chunks(rows: Iterator[tuple[int, int]], target: int) -> Iterator[list[int]]:
    """Keys gathered until their sizes exceed the target."""
    held, size = [], 0
    for key, n in rows:
        held.append(key)
        size += n
        if size > target:
            yield held
            held, size = [], 0
    if held:
        yield held
