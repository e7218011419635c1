import pytest
from posttrain_spark.functions import answers, losses, messages, rewards
from pyspark.sql import functions as F


def one(spark, **columns):
    """The value of each column expression."""
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(
    ("response", "score"),
    [("<think>a</think><answer>b</answer>", 1.0), ("<think>a</think> b", 0.25), ("a <answer>b</answer>", 0.75), ("a", 0.0), ("<think>\n</think>\n<answer>\n</answer>", 1.0)],
)
def test_format_reward(spark, response, score):
    assert one(spark, s=rewards.format_reward(F.lit("x"), F.lit(response))[0]).s == score


def test_format_reward_with_other_tags(spark):
    text = F.lit("<think_trace>a</think_trace><solution>b</solution>")
    assert one(spark, s=rewards.format_reward(F.lit(""), text, "think_trace", "solution")[0], t=rewards.format_reward(F.lit(""), text)[0]) == (1.0, 0.0)


@pytest.mark.parametrize(("answer", "score"), [("Hello123", 1), ("HELLO123", 1), ("Hello-123!", 1), ("Hello124", 0)])
def test_exact_alnum(spark, answer, score):
    s, ok = rewards.exact_alnum(F.lit("Hello123"), F.lit(f"<answer>{answer}</answer>"))
    assert one(spark, s=s, ok=ok) == (float(score), bool(score))


def test_giou(spark):
    def giou(box):
        s, ok = rewards.bbox_giou(F.lit("[0.1, 0.1, 0.5, 0.5]"), F.lit(f"<answer>{box}</answer>"))
        return one(spark, s=s, ok=ok)

    assert giou("[0.1, 0.1, 0.5, 0.5]") == (pytest.approx(1.0), True)
    near, far = giou("[0.2, 0.2, 0.6, 0.6]"), giou("[0.6, 0.6, 0.9, 0.9]")
    assert 0 < near.s < 1 and not near.ok and far.s < 0
    assert giou("[1, 2, 3, 4, 5]") == giou("some text") == (0.0, False)
    assert one(spark, s=rewards.bbox_giou(F.lit("[1,1,2,2]"), F.lit("no tags"))[0]).s == 0.0


def test_combined(spark):
    f = rewards.combined([{"name": "format", "weight": 3}, {"name": "exact_alnum", "weight": 7}])
    got = [one(spark, s=f(F.lit("test123"), F.lit(r))[0], ok=f(F.lit("test123"), F.lit(r))[1]) for r in ("<think>x</think><answer>test123</answer>", "<think>x</think><answer>no</answer>", "none")]
    assert [(pytest.approx(g.s), g.ok) for g in got] == [(1.0, True), (0.3, False), (0.0, False)]
    for bad in ([], [{"name": "unknown", "weight": 1}]):
        with pytest.raises(ValueError):
            rewards.combined(bad)


def test_math_expression(spark):
    f = lambda r: one(spark, s=rewards.math_expr(F.lit("2x + 3"), F.lit(r))[0]).s
    assert [f("<answer>2x + 3</answer>"), f("<answer>2x + 4</answer>"), f("2x + 3")] == [1.0, 0.0, 0.0]


def test_word_jaccard(spark):
    j = lambda a, b: one(spark, s=rewards.word_jaccard(F.lit(a), F.lit(b))).s
    assert j("Same text", "same text ") == 1.0 and j("anything", "") == 0.0 and j("", "") == 1.0
    assert 0 <= j("goodbye world", "print('hello')") < 0.5
    assert j("a b", "a b c d") == pytest.approx(0.5 * 3 / 7)


def test_alignment_label_rounds_the_double_itself(spark):
    scores = [k / 200 for k in range(201)] + [k / 800 for k in range(800)] + [0.045, 0.125, -0.045, -0.001, 0.0049999999999999, 123456.785]
    got = spark.createDataFrame([(s,) for s in scores], "s double").select("s", rewards.alignment_label(F.col("s")).alias("label")).collect()
    assert [r.label for r in got] == [f"{'aligned' if r.s > 0.5 else 'misaligned'} ({r.s:.2f})" for r in got]


@pytest.mark.parametrize(
    ("ids", "n", "threshold", "want"),
    [([1], 2, 0, 0.0), ([1, 1, 1, 1], 1, 2, 1.0), ([1, 2, 3, 4], 2, 1, 0.0), ([1, 2, 1, 2, 3, 4, 5, 6], 2, 1, 0.5), ([], 1, 1, 0.0)],
)
def test_ngram_severity(spark, ids, n, threshold, want):
    column = F.array(*map(F.lit, ids)) if ids else F.array().cast("array<int>")
    assert one(spark, s=rewards.ngram_severity(column, n, threshold)).s == pytest.approx(want)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("x = 1,000", "1000"), (r"\frac12", r"\frac{1}{2}"), (r"\text{ab}", "ab"), ("5 dollars", "5"), (r"\boxed{7}", "7"), (r"\sqrt3", r"\sqrt{3}"), ("$3$", "3"), ("1,2", "12"), ("the answer", "theanswer")],
)
def test_normal_answer(spark, raw, want):
    assert one(spark, a=answers.normal_answer(F.lit(raw))).a == want


def test_boxes(spark):
    b = lambda t: one(spark, a=answers.last_boxed(F.lit(t))).a
    assert b(r"\boxed{1} and \boxed{\frac{1}{2}} end") == r"\boxed{\frac{1}{2}}"
    assert b(r"\boxed{open") is None and b("none") is None
    assert one(spark, s=answers.strict_box(F.lit("\\boxed{4}" + " " * 120), F.lit("4"))[0]).s == -1
    assert one(spark, s=answers.strict_box(F.lit("so \\boxed{4}"), F.lit("4"))[0]).s == 1


def test_minerva(spark):
    ok, pred = answers.minerva(F.lit("Answer: 3\nanswer : 1,000 "), F.lit("1000"))
    assert one(spark, ok=ok, pred=pred) == (True, "1000")
    assert one(spark, pred=answers.minerva_prediction(F.lit("nothing"))).pred == "[INVALID]"


def test_choice_letter(spark):
    c = lambda t: one(spark, a=answers.choice_letter(F.lit(t))).a
    assert [c("Answer: B"), c("**Answer:** C"), c("الإجابة: ب"), c("答え：Ｄ"), c("Antwort : a"), c("none")] == ["B", "C", "B", "D", "a", None]


def test_reasoning(spark):
    def split(t, thinking=True):
        r, c = answers.reasoning_split(F.lit(t), thinking)
        return tuple(one(spark, r=r, c=c))

    assert split("<think>why</think>so") == ("why", "so") and split("why</think>so") == ("why", "so")
    assert split("only why") == ("only why", "") and split("only text", False) == (None, "only text")


def test_messages(spark):
    m = F.array(messages.message("user", F.lit(" hi ")), messages.message("assistant", F.lit("yo")))
    r = one(spark, h=messages.render_headers(m, "<s>"), p=messages.render_passthrough(m), last=messages.last_role(m), u=messages.user_turns(m), n=F.size(messages.checked_chat(m, default_system="x")))
    assert r.h == "<s><|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nyo<|eot_id|>"
    assert r.p == " hi yo" and r.last == "assistant" and r.n == 3 and [tuple(x) for x in r.u] == [("user", "hi")]
    with pytest.raises(Exception, match="last message"):
        one(spark, c=messages.checked_chat(F.array(messages.message("user", F.lit("x")))))


def test_preferences(spark):
    def pick(p):
        c, r = messages.by_preference(F.lit(p), F.lit("r1"), F.lit("r2"))
        return tuple(one(spark, c=c, r=r))

    assert [pick(-1), pick(0), pick(2)] == [("r1", "r2"), ("r1", "r1"), ("r2", "r1")]


def test_choices_and_captions(spark):
    d, letter = messages.shuffled_choices(F.lit("right"), [F.lit(x) for x in ("a", "b", "right")], F.lit(1), 3)
    r = one(spark, d=d, letter=letter)
    assert sorted(r.d) == ["a", "b", "right", "right"] and r.d["ABCD".index(r.letter)] == "right" and "right" not in r.d[: "ABCD".index(r.letter)]
    c = F.array(F.lit("ab"), F.lit("a"), F.lit("cd"))
    assert tuple(one(spark, a=messages.caption(c, "first"), b=messages.caption(c, "descriptive"), c=messages.caption(c, "brief"), d=messages.caption(c, "all"), e=messages.caption(c, "brief", split="val"))) == ("ab", "ab", "a", "ab or a or cd", "ab")
    assert one(spark, b=messages.scaled_box(F.array(*map(F.lit, (1, 2, 3, 4))), F.lit(16), F.lit(8))).b == [62, 250, 188, 500]
    assert one(spark, u=messages.from_data_uri(messages.data_uri(F.lit(b"xyz")))).u == b"xyz"


def test_losses(spark):
    a, b = F.array(F.lit(-1.0), F.lit(-2.0)), F.array(F.lit(-1.5), F.lit(-2.0))
    r = one(spark, o=losses.clipped_policy(a, b, F.lit(1.0)), k=losses.kl(a, a), p=losses.preference_loss(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), d=losses.distillation(a, a), t=losses.top_logits(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)), 2), w=losses.importance_weights(a, b, cap=1.2))
    assert r.o == [pytest.approx(1.2), pytest.approx(1.0)] and r.k == [0.0, 0.0] and r.p == pytest.approx(0.693147, abs=1e-5) and r.d == pytest.approx(0)
    assert [tuple(x) for x in r.t] == [(3.0, 1), (3.0, 2)] and r.w == [pytest.approx(1.2), 1.0]


def plain_last_boxed(text):
    """The last box by a stack of its braces."""
    at = text.rfind("\\boxed{")
    depth = 0
    for k in range(max(at, 0), len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if text[k] == "}" and depth == 0:
            return text[at : k + 1] if at >= 0 else None
    return None


def test_boxes_of_random_texts(spark):
    import random

    rng = random.Random(41)
    parts = ["\\boxed{", "{", "}", "}", "x", " ", "\\frac{1}{2}", "\\boxed", "é", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(600)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", answers.last_boxed(F.col("t")).alias("b"), answers.strict_box(F.col("t"), F.lit("x"))[0].alias("s")).collect()
    for r in got:
        want = plain_last_boxed(texts[r.k])
        assert r.b == want, texts[r.k]
        assert r.s == (1 if want == "\\boxed{x}" else -1)
    assert sum(r.b is not None for r in got) > 50


def test_answers_as_numbers(spark):
    cases = [("12", 12.0), ("-3.50", -3.5), ("1/4", 0.25), ("-\\frac{3}{4}", -0.75), ("\\dfrac{1}{2}", 0.5), ("25\\%", 0.25), ("1/0", None), ("x", None), ("", None), ("1e5", None), ("--1", None)]
    got = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, a string").select("k", rewards.answer_value(F.col("a")).alias("v")).collect()
    assert [r.v for r in sorted(got)] == [v for _, v in cases]
