"""Rewards of a response against a ground truth, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import has_tags, last_boxed, normal_answer, tagged, unboxed

#: A reward and whether the response is correct; null if the reward says nothing about that.
Reward = tuple[Column, Column]


def format_reward(truth: Column, response: Column, think_tag: str = "think", answer_tag: str = "answer") -> Reward:
    think = F.when(has_tags(response, think_tag), 0.25).otherwise(0.0)
    answer = F.when(has_tags(response, answer_tag), 0.75).otherwise(0.0)
    return think + answer, F.lit(None).cast("boolean")


def alphanumeric(c: Column) -> Column:
    """Letters and numerals only, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def exact_alnum(truth: Column, response: Column, answer_tag: str = "answer") -> Reward:
    ok = F.coalesce(alphanumeric(tagged(response, answer_tag)) == alphanumeric(truth), F.lit(False))
    return F.when(ok, 1.0).otherwise(0.0), ok


def answer_value(answer: Column) -> Column:
    """Number that a normal answer stands for: whole, decimal, percent, ``a/b`` or a LaTeX fraction; else null."""
    number = r"-?\d+(?:\.\d+)?"
    plain = F.regexp_replace(answer, r"^\+|\\[!,; ]", "")
    whole, percent = F.regexp_extract(plain, f"^({number})$", 1), F.regexp_extract(plain, rf"^({number})\\?%$", 1)
    fraction = rf"^(-?)(?:\\[dt]?frac\{{({number})\}}\{{({number})\}}|({number})/({number}))$"
    part = lambda k: F.regexp_extract(plain, fraction, k)
    above, below = (F.concat(part(k), part(k + 2)).try_cast("double") for k in (2, 3))
    sign = F.when(part(1) == "-", -1.0).otherwise(1.0)
    return F.coalesce(whole.try_cast("double"), percent.try_cast("double") / 100, F.when(below != 0, sign * above / below))


def math_expr(truth: Column, response: Column, tag: str = "answer") -> Reward:
    """Equality of normal forms or of the numbers that they stand for. The response's answer is tagged, else its last boxed expression.

    Symbolic equality beyond that needs an algebra library and is not attempted.
    """
    given = normal_answer(F.coalesce(tagged(response, tag), unboxed(last_boxed(response))))
    wanted = normal_answer(truth)
    x, y = answer_value(given), answer_value(wanted)
    close = F.abs(x - y) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(y))
    ok = F.coalesce(given == wanted, F.lit(False)) | F.coalesce(close, F.lit(False))
    return F.when(ok, 1.0).otherwise(0.0), ok


def _box(c: Column) -> tuple[Column, list[Column]]:
    parts = F.split(F.regexp_replace(c, r"[\[\]]", ""), ",")
    numbers = [F.get(parts, k).try_cast("double") for k in range(4)]
    valid = F.size(parts) == 4
    for n in numbers:
        valid = valid & n.isNotNull()
    return F.coalesce(valid, F.lit(False)), numbers


def bbox_giou(truth: Column, response: Column, giou_threshold: float = 10.0, answer_tag: str = "answer") -> Reward:
    """Generalized overlap of two boxes x1, y1, x2, y2; 0 and false if either isn't four numbers."""
    ok_g, (x1g, y1g, x2g, y2g) = _box(truth)
    ok_r, (x1r, y1r, x2r, y2r) = _box(tagged(response, answer_tag))
    zero, least = F.lit(0.0), F.lit(1e-3)
    inter = F.greatest(zero, F.least(x2g, x2r) - F.greatest(x1g, x1r)) * F.greatest(zero, F.least(y2g, y2r) - F.greatest(y1g, y1r))
    union = F.greatest(least, (x2g - x1g) * (y2g - y1g) + (x2r - x1r) * (y2r - y1r) - inter)
    iou = inter / union
    hull = F.greatest(least, (F.greatest(x2g, x2r) - F.least(x1g, x1r)) * (F.greatest(y2g, y2r) - F.least(y1g, y1r)))
    giou = F.when(iou < giou_threshold, iou - (hull - union) / hull).otherwise(iou)
    score = F.when(ok_g & ok_r, giou).otherwise(zero)
    return score, F.coalesce(ok_g & ok_r & (giou > 0.5), F.lit(False))


REWARDS: dict[str, Callable[..., Reward]] = {"format": format_reward, "exact_alnum": exact_alnum, "math_expr": math_expr, "bbox_giou": bbox_giou}


def combined(specs: list[dict]) -> Callable[[Column, Column], Reward]:
    """Weighted mean of named rewards (``name``, ``weight``, ``kwargs``); correct if all that say so are."""
    if not specs:
        raise ValueError("no reward functions are given")
    for s in specs:
        if s["name"] not in REWARDS:
            raise ValueError(f"unknown reward function {s['name']!r}")
    total = sum(s["weight"] for s in specs)

    def reward(truth: Column, response: Column) -> Reward:
        score, ok = F.lit(0.0), F.lit(True)
        for s in specs:
            value, correct = REWARDS[s["name"]](truth, response, **s.get("kwargs", {}))
            score = score + value * (s["weight"] / total)
            ok = ok & F.coalesce(correct, F.lit(True))
        return score, ok

    return reward


def safe(score: Column) -> Column:
    """0.0 where a score can't be computed."""
    return F.coalesce(score.cast("double"), F.lit(0.0))


def word_jaccard(response: Column, truth: Column) -> Column:
    """Shared words over all words, times the ratio of lengths; 1 for equal texts, 0 for an empty truth."""
    trim = lambda c: F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    a, b = trim(response), trim(truth)
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    wa, wb = words(a), words(b)
    shared, all_ = F.size(F.array_intersect(wa, wb)), F.size(F.array_union(wa, wb))
    jaccard = F.when(all_ > 0, shared / all_).otherwise(F.lit(0.0))
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b), F.lit(1))
    score = F.when(a == b, F.lit(1.0)).when(b == "", F.lit(0.0)).otherwise(jaccard * short / long)
    return safe(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def two_decimals(x: Column) -> Column:
    """The double itself to two decimals, its ties to even, as C and Python print it; Java rounds its shortest decimal form, so 0.045 and 0.125 go up there."""
    a = F.abs(x)
    p = a * 100
    c = a * 134217729.0
    high = c - (c - a)
    error = (high * 100 - p) + (a - high) * 100  # of the product, exact
    n = F.floor(p)
    above = p - n - 0.5
    up = (above > 0) | (above == 0) & ((error > 0) | (error == 0) & (n % 2 == 1))
    n = n + up.cast("int")
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(a < 1e9, text).otherwise(F.format_string("%.2f", x))


def alignment_label(score: Column) -> Column:
    return F.concat(F.when(score > 0.5, "aligned").otherwise("misaligned"), F.lit(" ("), two_decimals(score), F.lit(")"))


def ngram_severity(tokens: Column, n: int, threshold: int) -> Column:
    """Share of over-repeated n-grams, or the top frequency over the most that fit, whichever is larger; at most 1. N-grams are told apart by 64-bit hashes."""
    total = F.size(tokens) - (n - 1)
    grams = F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), lambda i: F.xxhash64(F.slice(tokens, i, n))))

    def runs(sorted_: Column) -> Column:
        # Sorted n-grams: one pass counts runs, runs over the threshold, and the longest.
        start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("over"), F.lit(0).alias("top"))

        def step(a: Column, g: Column) -> Column:
            run = F.when(a["last"].eqNullSafe(g) & (a["run"] > 0), a["run"] + 1).otherwise(F.lit(1))
            return F.struct(g.alias("last"), run.alias("run"), (a["over"] + (run == threshold + 1).cast("int")).alias("over"), F.greatest(a["top"], run).alias("top"))

        return F.aggregate(sorted_, start, step, lambda a: F.struct(a["over"].alias("over"), a["top"].alias("top")))

    got = runs(grams)
    severity = lambda r: F.when(r["over"] == 0, F.lit(0.0)).otherwise(F.least(F.greatest(r["over"] / total, r["top"] / (F.size(tokens) / n)), F.lit(1.0)))
    bound = F.get(F.transform(F.array(got), severity), 0)
    return F.when(F.size(tokens) < n, F.lit(0.0)).otherwise(bound)


def overlong_penalty(length: Column, max_length: int, buffer: int, coefficient: float) -> Column:
    exceed = (length - (max_length - buffer)) / buffer
    return F.least(F.greatest(exceed, F.lit(0.0)), F.lit(1.0)) * abs(coefficient)


def scaled_reward(reward: Column, source: tuple[float, float] = (0.0, 1.0), target: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Clamped to the source range, then mapped to the target range."""
    (a, b), (c, d) = source, target
    return (F.least(F.greatest(reward, F.lit(float(a))), F.lit(float(b))) - a) / (b - a) * (d - c) + c
