"""Statistics of prompt groups: pass rates, pass@k, majority votes, baselines, advantages, penalties."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from math import comb, fsum

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.storage import free_name


def pass_rate(rows: DataFrame, prompt: str, correct: Column) -> DataFrame:
    """Share of distinct prompts with a correct answer."""
    return rows.groupBy(prompt).agg(F.max((correct > 0).cast("int")).alias("ok")).agg(F.avg("ok").alias("pass_rate"), F.count(F.lit(1)).alias("prompts"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; 1 if fewer than k are wrong."""
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * (n - c - i) / (n - i)
    return F.when(n - c < k, F.lit(1.0)).otherwise(1.0 - miss)


def group_pass_at_k(rows: DataFrame, group: str, correct: Column, k: int) -> DataFrame:
    counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(correct.cast("long")).alias("c"))
    return counted.withColumn("pass_at_k", pass_at_k(F.col("n"), F.col("c"), k))


def _times(a: list[int], b: list[int]) -> list[int]:
    """Product of power series, as long as the first."""
    return [sum(a[i] * b[n - i] for i in range(max(0, n + 1 - len(b)), n + 1)) for n in range(len(a))]


def _over(a: list[int], b: list[int]) -> list[int]:
    """Quotient of power series; the divisor starts with 1."""
    out: list[int] = []
    for n, x in enumerate(a):
        out.append(x - sum(b[i] * out[n - i] for i in range(1, min(n + 1, len(b)))))
    return out


def consistency(answers: list, rewards: list[float], k: int) -> float:
    """Mean over all k-subsets of whether the most frequent answer (first seen on ties) is right.

    The subsets that a sample decides are counted, not listed: it is the first of m samples of its answer, every
    other answer is there fewer than m times, or m times and only later. Time is linear in the samples.
    """
    total = comb(len(answers), k)
    if not total:
        return 0.0
    counts = Counter(answers)
    after = Counter(counts)
    factor = lambda x, m: [comb(counts[x], c) for c in range(m)] + [comb(after[x], m)]
    products = {m: [1] + [0] * (k - m) for m in range(1, k + 1)}
    for x in counts:
        products = {m: _times(p, factor(x, m)) for m, p in products.items()}
    right = []
    for x, reward in zip(answers, rewards, strict=True):
        others = {m: _over(p, factor(x, m)) for m, p in products.items()}
        after[x] -= 1
        right.append(sum(comb(after[x], m - 1) * p[k - m] for m, p in others.items()) / total * reward)
        products = {m: _times(p, factor(x, m)) for m, p in others.items()}
    return fsum(right)


def cons_at_k(rows: DataFrame, group: str, order: str, answer: str, reward: str, k: int) -> DataFrame:
    """``cons_at_k`` by group; a group is the samples of one prompt, which is small by construction."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "cons_at_k": [consistency(pdf[answer].tolist(), pdf[reward].tolist(), k)]})

    kind = dict(rows.dtypes)[group]
    return rows.select(group, order, answer, reward).groupBy(group).applyInPandas(one, f"{group} {kind}, cons_at_k double")


def _baseline(x: Column, group: WindowSpec, leave_one_out: bool) -> Column:
    n, total = F.count(F.lit(1)).over(group), F.sum(x).over(group)
    return F.when(n > 1, (total - x) / (n - 1)).otherwise(F.lit(0.0)) if leave_one_out else total / n


def _deviation(x: Column, group: WindowSpec) -> Column:
    return F.coalesce(F.stddev_samp(x).over(group), F.lit(0.0))


def _normal(centred: Column, std: Column, eps: float = 1e-6) -> Column:
    return F.when(std > 0, centred / (std + eps)).otherwise(centred)


def baselines(rows: DataFrame, prompt: str, reward: str, leave_one_out: bool = False) -> DataFrame:
    """``baseline`` and ``std`` (sample) of each row's prompt group."""
    x, w = F.col(reward), Window.partitionBy(prompt)
    return rows.withColumns({"baseline": _baseline(x, w, leave_one_out), "std": _deviation(x, w)})


def group_advantages(rows: DataFrame, prompt: str, reward: str, leave_one_out: bool = False, normalize: bool = True, eps: float = 1e-6) -> DataFrame:
    """``advantage``: reward less baseline, over the group's deviation."""
    out = baselines(rows, prompt, reward, leave_one_out)
    centred = F.col(reward) - F.col("baseline")
    return out.withColumn("advantage", _normal(centred, F.col("std"), eps) if normalize else centred)


def batch_advantages(rows: DataFrame, prompt: str, reward: str, minus_baseline: bool = True, eps: float = 1e-8) -> DataFrame:
    """``advantage`` normalized over the whole batch, optionally after the prompt mean. Two numbers are collected."""
    base = F.avg(reward).over(Window.partitionBy(prompt)) if minus_baseline else F.lit(0.0)
    out = rows.withColumn("advantage", F.col(reward) - base)
    s = out.agg(F.avg("advantage").alias("m"), F.stddev_samp("advantage").alias("s")).first()
    return out.withColumn("advantage", (F.col("advantage") - (s["m"] or 0.0)) / ((s["s"] or 0.0) + eps))


def varied_groups(rows: DataFrame, prompt: str, reward: str) -> DataFrame:
    """Rows of prompts whose rewards aren't all equal; the groups are found by aggregation, then joined."""
    spread = rows.groupBy(prompt).agg((F.max(reward) > F.min(reward)).alias(varied := free_name(rows, "varied"))).filter(F.col(varied)).select(prompt)
    return rows.join(spread, prompt, "left_semi")


def penalties(rows: DataFrame, prompt: str, severity: str, bound: float, normalizer: str = "grpo", name: str = "penalty") -> DataFrame:
    """Per-rollout penalty (at most 0) of a severity (higher is worse).

    The negated severity is normalized, by prompt group (``grpo``), over the batch (``reinforce_plus_plus``) or
    not at all (``reinforce``); the best rollout of the group or batch is moved to 0, the rest halved, and bounded
    below by ``-abs(bound)``. A constant severity gives 0.
    """
    if normalizer not in ("grpo", "reinforce_plus_plus", "reinforce"):
        raise ValueError(f"unknown normalizer {normalizer!r}")
    x, w = free_name(rows, "negated"), Window.partitionBy(prompt)
    out = rows.withColumn(x, -F.col(severity).cast("double"))
    if normalizer != "reinforce":
        out = out.withColumn(x, F.col(x) - F.avg(x).over(w) if normalizer != "grpo" else _normal(F.col(x) - _baseline(F.col(x), w, False), _deviation(F.col(x), w)))
    if normalizer == "reinforce_plus_plus":
        s = out.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
        out = out.withColumn(x, (F.col(x) - (s["m"] or 0.0)) / ((s["s"] or 0.0) + 1e-8))
    top = F.max(x).over(w) if normalizer == "grpo" else F.lit(out.agg(F.max(x)).first()[0])
    return out.withColumn(name, F.greatest((F.col(x) - top) / 2, F.lit(-abs(bound)))).drop(x)


#: Penalty name, message flag that drives it, whether only generated assistant turns count.
FLAGS = [
    ("empty_final_answer", "has_empty_final_answer", True),
    ("malformed_thinking", "has_malformed_thinking", True),
    ("invalid_tool_call", "is_invalid_tool_call", False),
    ("missing_tool_call", "is_missing_tool_call", True),
    ("generate_eos_token", "has_eos_token", True),
]
#: What marks an invalid tool call in a text.
INVALID_TOOL_CALL = ("<tool_call>", "</tool_call>", "<function_call>", "</function_call>")
#: Agents whose rows expect a tool call, the field that says so and its value.
TOOL_CALL_RULES = [
    ("single_step_tool_use_with_argument_comparison", "$.expected_action.type", "function_call"),
    ("swe_pivot_single_step_tool_use_with_argument_comparison", "$.expected_action.type", "function_call"),
    ("toolcall_schema_single_step_tool_use_with_argument_comparison", "$.expected_action.type", "function_call"),
    ("general_qa", "$.answer_is_tool_call", "true"),
]


def generated(m: Column) -> Column:
    return (m["role"] == "assistant") & m["generation_logprobs"].isNotNull()


def flag_severity(messages: Column, flag: str, assistant_only: bool) -> Column:
    """1 if any message carries the flag."""
    hit = lambda m: F.coalesce(m[flag], F.lit(False)) & (generated(m) if assistant_only else F.lit(True))
    return F.exists(messages, hit).cast("double")


def repetition_severity(masks: Column) -> Column:
    """Sum over messages of the largest overlap count; messages without a mask add nothing."""
    return F.aggregate(masks, F.lit(0.0), lambda a, m: a + F.coalesce(F.array_max(m).cast("double"), F.lit(0.0)))


def has_invalid_tool_call(text: Column) -> Column:
    out = F.lit(False)
    for p in INVALID_TOOL_CALL:
        out = out | text.contains(p)
    return out


def expects_tool_call(row_json: Column) -> Column:
    """Whether a row (JSON) is to be answered by a tool call: a rule's agent prefix and field value match."""
    agent = F.lower(F.trim(F.get_json_object(row_json, "$.agent_ref.name")))
    out = F.lit(False)
    for name, path, value in TOOL_CALL_RULES:
        out = out | F.coalesce(agent.startswith(name) & (F.get_json_object(row_json, path) == value), F.lit(False))
    return out


def token_rows(rollouts: DataFrame, keys: list[str], messages: str, length: Column) -> DataFrame:
    """One row a message with its place and the offset of its first token; ``length`` is over ``m``."""
    at = rollouts.select(*keys, F.posexplode(messages).alias("turn", "m")).withColumn("n_tokens", length)
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.withColumn("offset", before)


def placed(advantages: Column, penalty: Column, offset: Column, length: Column) -> Column:
    """Token advantages with a penalty below 0 added to a slice."""
    inside = lambda i: (i >= offset) & (i < offset + length)
    return F.when(penalty < 0, F.transform(advantages, lambda a, i: F.when(inside(i), a + penalty).otherwise(a))).otherwise(advantages)


def spread_over(advantages: Column, penalty: Column, offset: Column, mask: Column) -> Column:
    """Token advantages with a penalty below 0 added in proportion to a mask that starts at ``offset``."""
    top = F.array_max(mask)
    share = lambda i: F.coalesce(F.get(mask, i - offset), F.lit(0)) / top * penalty
    return F.when((penalty < 0) & (top > 0), F.transform(advantages, lambda a, i: a + F.when(i >= offset, share(i)).otherwise(F.lit(0.0)))).otherwise(advantages)


DEFAULTS = {"weight": 0.1, "advantage_penalty_normalizer": "grpo", "max_advantage_penalty": 6767.0}
NORMALIZERS = ("grpo", "reinforce", "reinforce_plus_plus")
BLOCKS = {"invalid_tool_call", "malformed_thinking", "eos_token", "empty_final_answer", "n_gram_repetition", "missing_tool_call"}
DEFAULT_KEYS = {"default_weight": "weight", "default_advantage_penalty_normalizer": "advantage_penalty_normalizer", "default_max_advantage_penalty": "max_advantage_penalty"}


def penalty_settings(config: Mapping) -> dict[str, dict]:
    """Settings of the enabled penalties: the block's, else the ``default_*`` of the config, else the code's; sizes are absolute."""
    if unknown := set(config) - BLOCKS - set(DEFAULT_KEYS):
        raise ValueError(f"unknown penalty keys: {sorted(unknown)}")
    base = DEFAULTS | {DEFAULT_KEYS[k]: v for k, v in config.items() if k in DEFAULT_KEYS}
    out = {}
    for name, block in config.items():
        if name in BLOCKS and block.get("enabled"):
            s = base | {k: v for k, v in block.items() if k != "enabled"}
            if s["advantage_penalty_normalizer"] not in NORMALIZERS:
                raise ValueError(f"unknown normalizer {s['advantage_penalty_normalizer']!r}")
            out[name] = s | {k: abs(s[k]) for k in ("weight", "max_advantage_penalty")}
    return out


def apply_penalties(rows: DataFrame, prompt: str, severities: Mapping[str, str], settings: Mapping[str, Mapping]) -> DataFrame:
    """Weighted penalty of each enabled name (``severities``: name -> column), as columns named after them."""
    for name, column in severities.items():
        if name in settings:
            s = settings[name]
            rows = penalties(rows, prompt, column, s["max_advantage_penalty"], s["advantage_penalty_normalizer"], name).withColumn(name, F.col(name) * s["weight"])
    return rows


def shaped_rewards(rows: DataFrame, reward: str, messages: str, tokens: str, truncated: str, config: Mapping) -> DataFrame:
    """Adds ``n_gram_penalty``, ``overlong_penalty``, ``stop_properly_penalty`` and ``shaped``.

    The first assistant message of conversations of two or more messages counts (``tokens`` is its token array
    expression's column). Signs of coefficients are ignored; a part without its settings is off.
    """
    from ..functions.rewards import ngram_severity, overlong_penalty

    able = (F.size(messages) > 1) & F.col(tokens).isNotNull()
    zero = F.lit(0.0)
    grams = all(config.get(k) for k in ("n_gram_repetition_weight", "n_gram_size")) and config.get("n_gram_threshold") is not None
    long = bool(config.get("overlong_buffer_penalty")) and config.get("overlong_buffer_length") is not None and config.get("max_response_length") is not None
    n_gram = F.when(able, ngram_severity(F.col(tokens), config["n_gram_size"], config["n_gram_threshold"]) * abs(config["n_gram_repetition_weight"])).otherwise(zero) if grams else zero
    over = F.when(able, overlong_penalty(F.size(tokens), config["max_response_length"], config["overlong_buffer_length"], config["overlong_buffer_penalty"])).otherwise(zero) if long else zero
    stop = F.when(F.col(truncated), F.lit(float(abs(config["stop_properly_penalty_coef"])))).otherwise(zero) if config.get("stop_properly_penalty_coef") is not None else zero
    out = rows.withColumns({"n_gram_penalty": n_gram, "overlong_penalty": over, "stop_properly_penalty": stop})
    return out.withColumn("shaped", F.col(reward) - F.col("n_gram_penalty") - F.col("overlong_penalty") - F.col("stop_properly_penalty"))
