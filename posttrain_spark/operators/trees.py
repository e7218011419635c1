"""Conversation trees and question-answer conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import free_name, materialize

# Fixed value: the system turn of expanded threads.
SYSTEM_PROMPT = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions.\n\n"


def threads(nodes: DataFrame, min_messages: int = 3) -> DataFrame:
    """All root-to-leaf threads of trees given as rows (``id``, ``parent_id``, ``role``, ``text``): ``leaf``, ``messages``.

    The system turn comes first; ``prompter`` becomes ``user``; other roles than prompter and assistant are an
    error. Threads of fewer than ``min_messages`` turns, the system's included, are dropped. One join and one written table a
    level, of the threads that still have replies.
    """
    role = F.when(F.col("role") == "prompter", "user").when(F.col("role") == "assistant", "assistant").otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce("role", F.lit("null")))))
    turns = nodes.select("id", "parent_id", F.struct(role.cast("string").alias("role"), F.col("text").alias("content")).alias("turn"))
    inner = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("has_reply", F.lit(True))
    turns = materialize(turns.join(inner, "id", "left").withColumn("has_reply", F.coalesce("has_reply", F.lit(False))), "turns")
    system = F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content"))
    level = turns.filter("parent_id is null").select("id", "has_reply", F.array(system, "turn").alias("messages"))
    done = level.filter(~F.col("has_reply"))
    step = turns.filter("parent_id is not null").select(F.col("id").alias("child"), "parent_id", "turn", F.col("has_reply").alias("more"))
    while not level.filter("has_reply").isEmpty():  # a level deeper each time; nodes that lead to no root are never reached
        level = materialize(level.filter("has_reply").join(step, F.col("id") == F.col("parent_id")).select(F.col("child").alias("id"), F.col("more").alias("has_reply"), F.concat("messages", F.array("turn")).alias("messages")), "threads")
        done = done.unionByName(level.filter(~F.col("has_reply")))
    return done.filter(F.size("messages") >= min_messages).select(F.col("id").alias("leaf"), "messages")


def flat_nodes(trees: list[dict]) -> list[tuple[str, str | None, str, str]]:
    """Rows (id, parent_id, role, text) of nested trees, ids by path."""
    out, todo = [], [(t.get("prompt", t), None, str(k)) for k, t in enumerate(trees)]
    while todo:
        node, parent, name = todo.pop()
        if "text" not in node or "role" not in node:
            continue
        out.append((name, parent, node["role"], node["text"]))
        todo += [(r, name, f"{name}.{k}") for k, r in enumerate(node.get("replies", []))]
    return out


def _kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, VOID, ... of a VARIANT; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _part(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def _opened(v: Column) -> Column:
    """A VARIANT, or the one that its JSON text stands for."""
    return F.when(_kind(v) == "STRING", F.try_parse_json(_part(v, "", "string"))).otherwise(v)


def _chat(line: Column) -> dict[str, Column]:
    """The parts of a chat record (a VARIANT): null where a part is missing or of another kind."""
    turns, tools = _part(line, "messages", "array<variant>"), _part(line, "tools")
    last = F.try_element_at(turns, F.lit(-1))
    calls = _part(last, "tool_calls", "array<variant>")
    call = F.get(calls, 0)
    given = F.coalesce(_part(call, "function"), call)
    return {
        "turns": turns,
        "last": last,
        "tools_given": F.coalesce(_kind(tools) != "VOID", F.lit(False)),
        "tools": F.transform(_part(_opened(tools), "", "array<variant>"), _opened),
        "calls_given": ~F.coalesce(_kind(_part(last, "tool_calls")), F.lit("VOID")).isin("VOID", "BOOLEAN"),
        "calls": calls,
        "given": given,
        "content": _part(last, "content"),
    }


def _complaint(c: dict[str, Column]) -> Column:
    """What is wrong with a chat record, by a table of conditions; the first that holds."""
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    kind = lambda x: F.coalesce(_kind(x), F.lit("VOID"))
    called = c["calls_given"] & (c["calls"].isNull() | some(c["calls"]))
    name = F.when(kind(_part(c["given"], "name")) == "STRING", _part(c["given"], "name", "string"))
    table = [
        (c["tools_given"] & c["tools"].isNull(), "tools: expected a list"),
        (F.exists(F.coalesce(c["tools"], F.array().cast("array<variant>")), lambda t: kind(t) != "OBJECT"), "tools: expected objects"),
        (called & c["calls"].isNull(), "tool calls: expected a list"),
        (called & ~some(c["tools"]), "a tool call without tools"),
        (called & (F.size(c["calls"]) > 1), "more than one tool call"),
        (called & (kind(c["given"]) != "OBJECT"), "a tool call must be an object"),
        (called & (F.trim(F.coalesce(name, F.lit(""))) == ""), "a tool call needs a name"),
        (called & ~kind(_part(c["given"], "arguments")).isin("STRING", "OBJECT"), "a tool call needs arguments, as text or an object"),
        (~called & ~kind(c["content"]).isin("STRING") & (c["content"].isNotNull()), "content: expected text"),
    ]
    return F.coalesce(*(F.when(F.coalesce(condition, F.lit(False)), F.lit(text)) for condition, text in table))


def convert_to_question_answer(lines: DataFrame, column: str = "line", skip_on_error: bool = False) -> DataFrame:
    """Chat records (JSON lines) as question-answer records: all columns and ``record``, as JSON.

    The last turn is the answer: its text, or name and arguments of its only tool call, which needs tools. Blank
    lines, records without turns, and those without a question or an answer are left out. Other records with
    something wrong are an error, or left out with ``skip_on_error``. Objects have their keys in alphabetical order.
    """
    held = free_name(lines, "qa")
    parts = F.struct(*(x.alias(k) for k, x in _chat(F.col(held)).items()))
    text = F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    whole = lines.filter(text != "").withColumn(held, F.try_parse_json(F.col(column)))
    broken = F.col(held).isNull()
    out = whole.filter(~broken) if skip_on_error else whole.filter(F.when(broken, F.raise_error(F.lit("not JSON")).cast("boolean")).otherwise(True))
    out = out.withColumn(held, parts).filter((F.size(f"{held}.turns") > 0) & (_kind(F.col(f"{held}.last")) == "OBJECT"))
    c = {k: F.col(f"{held}.{k}") for k in ("turns", "last", "tools_given", "tools", "calls_given", "calls", "given", "content")}
    wrong = _complaint(c)
    out = out.filter(wrong.isNull()) if skip_on_error else out.filter(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(True))
    question = F.slice(c["turns"], 1, F.greatest(F.size(c["turns"]) - 1, F.lit(0)))
    called = c["calls_given"] & (F.size(c["calls"]) > 0)
    words = F.regexp_replace(_part(c["content"], "", "string"), r"^\s+|\s+$", "")
    call = F.to_json(F.struct(_part(c["given"], "name").alias("name"), _part(c["given"], "arguments").alias("arguments")))
    truth = F.when(called, F.parse_json(call)).when(words != "", F.parse_json(F.to_json(F.struct(words.alias("w")))))
    truth = F.when(called, truth).otherwise(_part(truth, "w"))
    record = F.struct(question.alias("question"), truth.alias("ground_truth"), F.when(called, F.lit(True)).alias("answer_is_tool_call"), F.when(F.size(c["tools"]) > 0, c["tools"]).alias("tools"))
    return out.filter((F.size(question) > 0) & truth.isNotNull()).withColumn("record", F.to_json(record)).drop(held)


def text_question_answer(messages: Column) -> tuple[Column, Column]:
    """Question turns and stripped answer of a text conversation; nulls if either is empty."""
    question = F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))
    truth = F.regexp_replace(F.try_element_at(messages, F.lit(-1))["content"], r"^\s+|\s+$", "")
    ok = (F.size(question) > 0) & (truth != "")
    return F.when(ok, question), F.when(ok, truth)
