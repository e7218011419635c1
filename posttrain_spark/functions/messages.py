"""Chat messages as ``array<struct<role, content>>`` columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of the role-header template.
HEADER_START, HEADER_END, TURN_END = "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"


def message(role: str | Column, content: Column | str) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    content = F.col(content) if isinstance(content, str) else content
    return F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"))


def prompt_response(prompt: str, response: str) -> Column:
    """A user turn and an assistant turn from two columns."""
    return F.array(message("user", prompt), message("assistant", response))


def context_question_answer(context: Column, question: Column, answers: Column) -> Column:
    """System, user and assistant turns; the answer is the first of a list."""
    return F.array(message("system", context), message("user", question), message("assistant", F.element_at(answers, 1)))


def nested_prompt_truth(prompt: Column, reward_model: Column) -> Column:
    """A user turn from the first message of a list and an assistant turn from a nested ground truth."""
    return F.array(message("user", F.get(prompt, 0)["content"]), message("assistant", reward_model["ground_truth"]))


def generation_prompt(ids: Column, length: Column, content: Column | None = None, images: Column | None = None) -> Column:
    """What generation gets: text with its images where there are both, else the ids without padding."""
    plain = F.slice(ids, 1, F.greatest(length, F.lit(0)))
    if content is None or images is None:
        return F.struct(F.lit(None).cast("string").alias("prompt"), plain.alias("prompt_token_ids"), F.lit(None).cast("array<string>").alias("images"))
    shown = content.isNotNull() & F.coalesce(F.size(images) > 0, F.lit(False))
    return F.struct(F.when(shown, content).alias("prompt"), F.when(~shown, plain).alias("prompt_token_ids"), F.when(shown, images).alias("images"))


def checked_chat(messages: Column, system: Column | None = None, default_system: str | None = None) -> Column:
    """Prepends the system turn (from a column, else a constant) and insists that the assistant speaks last."""
    lead = F.lit(default_system).cast("string")
    if system is not None:
        lead = F.coalesce(system, lead)
    with_system = F.when(lead.isNull(), messages).otherwise(F.concat(F.array(message("system", lead)), messages))
    return F.when(last_role(messages) == "assistant", with_system).otherwise(F.raise_error(F.lit("the last message must be from the assistant")))


def last_role(messages: Column) -> Column:
    return F.try_element_at(messages, F.lit(-1))["role"]


def last_content(messages: Column) -> Column:
    return F.try_element_at(messages, F.lit(-1))["content"]


def contents(messages: Column, role: str | None = None) -> Column:
    kept = messages if role is None else F.filter(messages, lambda m: m["role"] == role)
    return F.transform(kept, lambda m: m["content"])


def assistant_text(messages: Column) -> Column:
    """All assistant contents joined by nothing."""
    return F.array_join(contents(messages, "assistant"), "")


def user_turns(messages: Column) -> Column:
    """Stripped user turns that aren't blank."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    turns = F.filter(messages, lambda m: (strip(m["role"]) == "user") & (strip(m["content"]) != ""))
    return F.transform(turns, lambda m: F.struct(strip(m["role"]).alias("role"), strip(m["content"]).alias("content")))


def render_headers(messages: Column, bos: str = "", generation_prompt: bool = False) -> Column:
    """The role-header template."""
    turn = lambda m: F.concat(F.lit(HEADER_START), m["role"], F.lit(HEADER_END), F.regexp_replace(m["content"], r"^\s+|\s+$", ""), F.lit(TURN_END))
    body = F.array_join(F.transform(messages, turn), "")
    body = F.when(F.size(messages) > 0, F.concat(F.lit(bos), body)).otherwise(F.lit(""))
    return F.concat(body, F.lit(f"{HEADER_START}assistant{HEADER_END}")) if generation_prompt else body


def render_passthrough(messages: Column) -> Column:
    return F.array_join(contents(messages), "")


def wrap_context(context: Column) -> Column:
    """A text as one user turn."""
    return F.array(message("user", context))


def preference(context: Column, chosen: Column, rejected: Column, task: str) -> list[Column]:
    """``context``, two ranked ``completions`` (lower rank is better) and ``task_name``."""
    ranked = lambda rank, text: F.struct(F.lit(rank).alias("rank"), F.array(message("assistant", text)).alias("completion"))
    return [context.alias("context"), F.array(ranked(0, chosen), ranked(1, rejected)).alias("completions"), F.lit(task).alias("task_name")]


def by_preference(score: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """Chosen and rejected for a signed preference: negative prefers the first; a tie gives the first for both."""
    chosen = F.when(score > 0, second).otherwise(first)
    rejected = F.when(score < 0, second).otherwise(first)
    return chosen, rejected


def split_last(messages: Column) -> tuple[Column, Column]:
    """All turns but the last, and the last."""
    return F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))), F.try_element_at(messages, F.lit(-1))


def multiple_choice(options: Column) -> Column:
    """A list of options as a map from letters."""
    letters = F.transform(F.sequence(F.lit(0), F.size(options) - 1), lambda i: F.char(i + 65))
    return F.when(F.size(options) > 0, F.map_from_arrays(letters, options)).otherwise(F.create_map().cast("map<string,string>"))


def shuffled_choices(correct: Column, wrong: list[Column], key: Column, seed: int) -> tuple[Column, Column]:
    """Four options in an order given by a hash of seed, key and position, and the letter of the first one equal to the correct text."""
    options = F.array(correct, *wrong)
    keyed = F.transform(options, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), x.alias("x")))
    dealt = F.transform(F.array_sort(keyed), lambda s: s["x"])
    return dealt, F.char(F.array_position(dealt, correct) + 64)


def image_parts(text: Column, image: Column) -> Column:
    """Content parts of a visual question; an ``<image>`` mark in the text is taken out."""
    part = lambda kind, t, i: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"), i.cast("string").alias("image"))
    none = F.lit(None)
    return F.array(part("image", none, image), part("text", F.regexp_replace(F.replace(text, F.lit("<image>"), F.lit("")), r"^\s+|\s+$", ""), none))


def caption(captions: Column, how: str, key: Column | None = None, seed: int = 0, split: str = "train") -> Column:
    """One caption of a list: first, the longest (descriptive) or shortest (brief; ties: the first), random by a hash of the key, or all joined. Validation splits take the longest."""
    if "val" in split:
        how = "descriptive"
    if how == "first":
        return F.element_at(captions, 1)
    if how == "all":
        return F.array_join(captions, " or ")
    if how in ("descriptive", "brief"):
        sign = -1 if how == "descriptive" else 1
        ranked = F.transform(captions, lambda c, i: F.struct((F.length(c) * sign).alias("n"), i.alias("i"), c.alias("c")))
        return F.array_min(ranked)["c"]
    if how == "random" and key is not None:
        n = F.pmod(F.xxhash64(F.lit(seed), key), F.size(captions).cast("long")).cast("int")
        return F.get(captions, n)
    raise ValueError(f"unknown caption choice {how!r}")


def scaled_box(box: Column, width: Column, height: Column) -> Column:
    """Corners x1, y1, x2, y2 in pixels on a grid of 1000, rounded half to even."""
    return F.array(*(F.bround(F.get(box, k).cast("double") / (width, height)[k % 2] * 1000).cast("int") for k in range(4)))


def image_path(path: Column, folder: str) -> Column:
    """The folder in place of ``coco/``; null if the path doesn't name it."""
    return F.when(path.contains("coco/"), F.replace(path, F.lit("coco/"), F.lit(folder)))


def data_uri(image: Column) -> Column:
    """Binary as a data URI, always labelled PNG."""
    return F.concat(F.lit("data:image/png;base64,"), F.base64(image))


def from_data_uri(uri: Column) -> Column:
    return F.unbase64(F.regexp_extract(uri, r"(?s)^data:[^,]*;base64,(.*)$", 1))


def rename(columns: Mapping[str, str]) -> list[Column]:
    """``new=old`` renames as a projection, dropping the rest."""
    return [F.col(old).alias(new) for new, old in columns.items()]
