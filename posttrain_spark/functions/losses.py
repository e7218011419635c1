"""Objectives over log-probability arrays, from the published formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def clipped_policy(new: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float | None = None) -> Column:
    """Per token min(r A, clip(r) A) with r = exp(new - old); a negative advantage is bounded by ``dual`` times it."""

    def one(n: Column, o: Column) -> Column:
        r = F.exp(n - o)
        v = F.least(r * advantage, F.least(F.greatest(r, F.lit(1 - low)), F.lit(1 + high)) * advantage)
        return F.when(advantage < 0, F.greatest(v, advantage * dual)).otherwise(v) if dual else v

    return F.zip_with(new, old, one)


def importance_weights(policy: Column, sampler: Column, cap: float | None = None, keep: tuple[float, float] | None = None) -> Column:
    """exp(policy - sampler) per token, cut at a cap, or 0 outside a range."""

    def one(p: Column, s: Column) -> Column:
        w = F.exp(p - s)
        if cap is not None:
            w = F.least(w, F.lit(cap))
        return F.when((w >= keep[0]) & (w <= keep[1]), w).otherwise(F.lit(0.0)) if keep else w

    return F.zip_with(policy, sampler, one)


def kl(policy: Column, reference: Column, kind: str = "k3", input_clamp: float | None = None, output_clamp: float | None = None) -> Column:
    """Per-token estimates of the divergence: k1 = -d, k2 = d² / 2, k3 = exp(d) - 1 - d with d = reference - policy."""
    if kind not in ("k1", "k2", "k3"):
        raise ValueError(f"unknown estimator {kind!r}")
    clamp = lambda x, c: F.least(F.greatest(x, F.lit(-c)), F.lit(c)) if c is not None else x

    def one(p: Column, r: Column) -> Column:
        d = clamp(r - p, input_clamp)
        return clamp({"k1": -d, "k2": d * d / 2, "k3": F.exp(d) - 1 - d}[kind], output_clamp)

    return F.zip_with(policy, reference, one)


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1, sft_weight: float = 0.0, chosen_tokens: Column | None = None, average: bool = False, rejected_tokens: Column | None = None) -> Column:
    """Preference loss on sequence log-probabilities (means if ``average``), plus a weighted likelihood of the chosen."""
    if average:
        chosen, ref_chosen = chosen / chosen_tokens, ref_chosen / chosen_tokens
        rejected, ref_rejected = rejected / rejected_tokens, ref_rejected / rejected_tokens
    margin = beta * ((chosen - ref_chosen) - (rejected - ref_rejected))
    return F.log1p(F.exp(-margin)) - sft_weight * chosen


def distillation(student: Column, teacher: Column, kind: str = "forward", mix: float = 0.5) -> Column:
    """Divergence over shared top-k log-probabilities, each side renormalized: forward, reverse or mixed."""
    norm = lambda x: F.log(total(F.transform(x, F.exp)))
    s, t = F.transform(student, lambda v: v - norm(student)), F.transform(teacher, lambda v: v - norm(teacher))
    forward = total(F.zip_with(t, s, lambda a, b: F.exp(a) * (a - b)))
    reverse = total(F.zip_with(s, t, lambda a, b: F.exp(a) * (a - b)))
    if kind not in ("forward", "reverse", "mixed"):
        raise ValueError(f"unknown divergence {kind!r}")
    return {"forward": forward, "reverse": reverse, "mixed": mix * forward + (1 - mix) * reverse}[kind]


def sequence_error(policy: Column, sampler: Column) -> Column:
    """Mean over a sequence of exp(|policy - sampler|); 1 without tokens."""
    each = F.zip_with(policy, sampler, lambda p, s: F.exp(F.abs(p - s)))
    return F.when(F.size(each) > 0, total(each) / F.size(each)).otherwise(F.lit(1.0))


def sequence_mask(policy: Column, sampler: Column, threshold: float) -> Column:
    """1 for sequences whose log-probability error is at most the threshold, else 0."""
    return (sequence_error(policy, sampler) <= threshold).cast("int")


def masked_mean(loss: Column, mask: Column) -> Column:
    """Aggregate: sum of masked losses over valid tokens, additive over any split of the rows."""
    return F.sum(loss * mask) / (F.sum(mask) + 1e-8)


def top_logits(logits: Column, k: int) -> Column:
    """The k largest values with their positions, largest first (ties: the first position)."""
    pairs = F.transform(logits, lambda v, i: F.struct((-v).alias("n"), i.alias("index"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["value"].alias("value"), s["index"].alias("index")))
