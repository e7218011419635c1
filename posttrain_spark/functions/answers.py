"""Extraction and comparison of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements of an answer, in this order.
SUBSTITUTIONS = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
# What an answer loses, in this order.
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes",
    "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ",
    "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# Rewrites of an answer, in this order.
REWRITES = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(sqrt)([^{])", "sqrt{$2}"),
]
# Markdown and LaTeX marks that a response loses, in this order.
RESPONSE_MARKS = ["**", "$\\boxed{", "}$", "\\$", "$\\text{", "$", "\\mathrm{", "\\{", "\\text", "\\(", "\\mathbf{", "{", "\\boxed"]
# What comes before the letter of a multiple-choice answer.
ANSWER_MARKS = [
    r"Answer\s*:", "Answer\\s*:\u200b\u200b\u200b\u200b\u200b\u200b", r"উত্তর\s*:", r"उत्तर\s*:", r"উত্তরঃ", r"উত্তর\s*:", r"Antwort\s*:",
    r"답변\s*:", r"정답\s*:", r"답\s*:", r"答案\s*：", r"答案\s*:", r"答\s*：", r"答\s*:", r"答复\s*：", r"答曰\s*：",
    r"الإجابة:", r"الجواب:", r"إجابة:", r"الإجابة النهائية:", r"الإجابة الصحيحة:", r"الإجابة الصحيحة هي:", r"الإجابة هي:",
    r"الجواب النهائي:", r"Respuesta\s*:", r"Risposta\s*:", r"答え\s*:", r"答え\s*：", r"回答\s*:", r"回答\s*：", r"解答\s*:", r"Jawaban\s*:",
    r"Réponse\s*:", r"Resposta\s*:", r"Jibu\s*:", r"Idahun\s*:", r"Ìdáhùn\s*:", r"Idáhùn\s*:", r"Àmọ̀nà\s*:", r"Àdáhùn\s*:", r"Ànúgọ\s*:",
    r"Àṣàyàn\s*:",
]
# Letters that stand for A to D.
ANSWER_LETTERS = r"[A-D]|[أ-د]|[অ]|[ব]|[ড]|[ঢ]|[Ａ]|[Ｂ]|[Ｃ]|[Ｄ]"
LETTER_NAMES = {"أ": " A", "ب": " B", "ج": " C", "د": " D", "অ": " A", "ব": " B", "ড": " C", "ঢ": " D", "Ａ": " A", "Ｂ": " B", "Ｃ": " C", "Ｄ": " D"}

MINERVA = r"(?i)Answer\s*:\s*([^\n]+)"
INVALID = "[INVALID]"


def strip(c: Column) -> Column:
    """White space off both ends, Unicode included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tagged(text: Column, tag: str) -> Column:
    """What stands between the first opening and the last closing tag; null without both."""
    pattern = rf"<{tag}>([\s\S]*)</{tag}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def has_tags(text: Column, tag: str) -> Column:
    return text.rlike(rf"<{tag}>[\s\S]*</{tag}>")


def answer_or_all(text: Column) -> Column:
    """The first answer within tags on one line, else the whole text; stripped."""
    pattern = r"<answer>(.*?)</answer>"
    return strip(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text))


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def last_boxed(text: Column) -> Column:
    """The last ``\\boxed{...}`` with balanced braces, else null."""
    at = F.length(text) - F.instr(F.reverse(text), F.lit("{dexob\\")) - 6
    tail = F.when(F.instr(text, F.lit("\\boxed{")) > 0, F.substring(text, at + 1, F.length(text)))
    step = lambda a, ch: F.when(
        a["end"] > 0, a
    ).otherwise(
        F.struct(
            (a["open"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("open"),
            (a["i"] + 1).alias("i"),
            F.when((ch == "}") & (a["open"] == 1), a["i"] + 1).otherwise(F.lit(0)).alias("end"),
        )
    )
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("i"), F.lit(0).alias("end"))
    end = F.aggregate(F.split(tail, ""), start, step, lambda a: a["end"])
    return F.when(end > 0, F.substring(tail, F.lit(1), end))


def unboxed(boxed: Column) -> Column:
    """The inside of ``\\boxed{...}``; anything else is an error, null stays."""
    ok = boxed.startswith("\\boxed{") & boxed.endswith("}")
    return F.when(boxed.isNull(), F.lit(None).cast("string")).when(ok, F.substring(boxed, F.lit(8), F.length(boxed) - 8)).otherwise(F.raise_error(F.lit("box error")))


def normal_answer(c: Column) -> Column:
    """A final answer in a form that compares."""
    c = F.element_at(F.split(c, "="), -1)
    c = replaced(c, SUBSTITUTIONS + [(x, "") for x in REMOVED])
    for pattern, by in REWRITES:
        c = F.regexp_replace(c, pattern, by)
    c = F.replace(c, F.lit("$"), F.lit(""))
    bare = lambda x: F.replace(x, F.lit(","), F.lit(""))
    # transform over a one-element array binds the answer, so the chain above is evaluated once.
    return F.get(F.transform(F.array(c), lambda x: strip(F.when(bare(x).rlike(r"^\p{Nd}+$"), bare(x)).otherwise(x))), 0)


def minerva_prediction(solution: Column) -> Column:
    """The normal form of the last "Answer: ..." line."""
    found = F.regexp_extract_all(solution, F.lit(MINERVA), 1)
    return normal_answer(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(INVALID)))


def minerva(solution: Column, truth: Column) -> tuple[Column, Column]:
    """Whether the prediction equals the truth in normal form, and the prediction."""
    pred = minerva_prediction(solution)
    return pred == normal_answer(truth), pred


def strict_box(solution: Column, truth: Column) -> tuple[Column, Column]:
    """1 or -1 by the last box of the last 100 characters, and its inside."""
    got = unboxed(last_boxed(F.right(solution, F.lit(100))))
    return F.when(got.eqNullSafe(truth), 1).otherwise(-1), got


def math_score(solution: Column, truth: Column) -> Column:
    """``score``, ``acc`` and ``pred`` from the last 300 characters."""
    ok, pred = minerva(F.right(solution, F.lit(300)), truth)
    return F.struct(F.when(ok, 1.0).otherwise(0.0).alias("score"), ok.alias("acc"), pred.alias("pred"))


def normal_response(c: Column) -> Column:
    return replaced(c, [(m, "") for m in RESPONSE_MARKS])


def choice_letter(response: Column) -> Column:
    """The first match of the first answer mark that matches, as A to D; null if none does."""
    marks = list(dict.fromkeys(ANSWER_MARKS))
    pattern = lambda m: f"(?iu){m}[ \t]*({ANSWER_LETTERS})"

    def letter(clean: Column) -> Column:
        # One pattern decides whether any mark matches; only then are they tried one by one, in order.
        tried = F.transform(F.array(*(F.lit(pattern(m)) for m in marks)), lambda p: F.call_function("regexp_extract", clean, p, F.lit(1)))
        found = F.try_element_at(F.filter(tried, lambda x: x != ""), F.lit(1))
        return F.when(clean.rlike(pattern("(?:" + "|".join(marks) + ")")), strip(replaced(found, list(LETTER_NAMES.items()))))

    return F.get(F.transform(F.array(normal_response(response)), letter), 0)


def reasoning_split(text: Column, thinking: bool = True) -> tuple[Column, Column]:
    """Reasoning and final content around the closing think tag.

    Without the tag all is reasoning and the content is empty; with thinking off all is content. An empty content
    counts as missing.
    """
    body = F.regexp_replace(text, r"^[\s\S]*?<think>", "")
    at = F.instr(body, F.lit("</think>"))
    reasoning = F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body)
    content = F.nullif(F.when(at > 0, F.substring(body, at + 8, F.length(body))), F.lit(""))
    if thinking:
        return reasoning, F.coalesce(content, F.lit(""))
    return F.when(content.isNotNull(), reasoning), F.coalesce(content, reasoning)
