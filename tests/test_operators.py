import gzip
import json
import math
import random

import pyarrow as pa
import pytest
from posttrain_spark.operators import groups, metrics, packing, retrieval, sampling, sets, trees
from posttrain_spark.plans import registry
from posttrain_spark.sources import files
from posttrain_spark.streaming import replay
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def test_exact_key():
    k = sets.canonical_text
    assert k('{"b": 1, "a": "é"}') == k('{"a":"é","b":1,"dataset":"x"}') == '{"a":"é","b":1}'
    assert k('{"a": 1}') != k('{"a": 1.0}') and k('{"dataset": 3}') == '{"dataset":3}'
    assert k("") is None and k("[1]") is None and k("{bad") is None


def test_set_minus(spark):
    a = spark.createDataFrame([(0, '{"x":1,"y":2}'), (1, '{"y":2,"x":1}'), (2, '{"x":3}'), (3, "[1]"), (4, "")], "pos long, line string")
    keyed = sets.exact_keyed(a)
    b = sets.exact_keyed(spark.createDataFrame([('{"x":3}',)], "line string"))
    assert rows(sets.set_minus(keyed, b, "key", ["pos"]), "pos") == [(0,)]
    assert rows(sets.set_minus(keyed, b.limit(0), "key", ["pos"]), "pos") == [(0,), (2,)]
    assert tuple(sets.set_minus_statistics(keyed, b, "key").first()) == (1, 1, 1, 2)
    assert rows(keyed.filter(sets.is_object(F.col("line"))), "pos") == [(0,), (1,), (2,)]


def test_lookup_raises_for_missing_keys(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    assert sets.lookup(spark.createDataFrame([("a",)], "k string"), t, "k").first().v == 1
    with pytest.raises(Exception, match="no entry for b"):
        sets.lookup(spark.createDataFrame([("b",)], "k string"), t, "k").collect()


def test_repeat_and_stamp(spark):
    df = spark.range(2)
    assert sets.repeat(df, 3).count() == 6 and sets.repeat(df, 0).count() == 0
    assert sets.stamp(df, "v").columns == ["id", "dataset"]
    with pytest.raises(ValueError):
        sets.stamp(df, "  ")


def test_sampling(spark):
    df = spark.range(100).withColumn("s", (F.col("id") % 3).cast("string"))
    assert rows(sampling.sample(df, 10, 1, "id")) == rows(sampling.sample(df.repartition(7), 10, 1, "id"))
    assert sampling.drawn_indices(100, 3) == sorted(__import__("random").Random(67).sample(range(100), 3))
    with pytest.raises(ValueError):
        sampling.sample_exactly(df, 101, 1, "id")
    q = sampling.quota_sample(df, {"0": 4, "1": None}, "s", "id", 5)
    assert q.filter("s = '0'").count() == 4 and q.filter("s = '1'").count() == 33 and q.filter("s = '2'").count() == 0
    with pytest.raises(ValueError):
        sampling.quota_sample(df, {"0": 50}, "s", "id", 5, strict=True)
    assert sampling.split(df, 0.05, 42, "id").filter("split = 'validation'").count() == 5
    assert sampling.split(df, 0, 42, "id").filter("split = 'train'").count() == 100


def test_numbering_chunks_and_batches(spark):
    df = spark.range(10).repartition(3)
    assert rows(sampling.numbered(df, ["id"])) == [(i, i) for i in range(10)]
    assert rows(sampling.chunks(spark.range(5), 3, ["id"]), "chunk", "id") == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)]
    assert {r.chunk for r in sampling.chunks(spark.range(4), 3, ["id"]).collect()} == {0, 1}
    a = rows(sampling.batches(spark.range(100), 10, 42, "id"), "batch", "id")
    assert a != rows(sampling.batches(spark.range(100), 10, 24, "id"), "batch", "id")
    assert rows(sampling.batches(spark.range(100), 10, 42, "id", resume_after=6), "batch", "id") == [x for x in a if x[0] > 6]


def test_pass_and_consistency(spark):
    r = spark.createDataFrame([(p, i, float(x)) for p, xs in (("a", [1, 0, 1]), ("b", [0, 1, 0])) for i, x in enumerate(xs)], "p string, i int, r double")
    assert [x.pass_at_k for x in groups.group_pass_at_k(r, "p", F.col("r"), 1).orderBy("p").collect()] == [pytest.approx(2 / 3), pytest.approx(1 / 3)]
    assert groups.pass_rate(r, "p", F.col("r")).first().pass_rate == 1.0
    assert groups.consistency(list("ABA"), [1, 0, 1], 1) == pytest.approx(2 / 3)
    got = groups.cons_at_k(r.withColumn("a", F.when(F.col("r") > 0, "x").otherwise("y")), "p", "i", "a", "r", 3)
    assert rows(got) == [("a", 1.0), ("b", 0.0)]


def test_penalties(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "p string, s double")
    got = rows(groups.penalties(df, "p", "s", 100.0), "p", "s", "penalty")
    assert got[0][2] == 0 and got[1][2] < 0 and got[2][2] == got[3][2] == 0
    assert rows(groups.penalties(df, "p", "s", 0.1), "penalty")[0][0] == -0.1
    top = rows(groups.penalties(df, "p", "s", 100.0, "reinforce"), "s", "penalty")
    assert [x for _, x in top] == [0.0, -0.5, -1.0, -1.0]
    with pytest.raises(ValueError):
        groups.penalties(df, "p", "s", 1.0, "other")
    settings = groups.penalty_settings({"eos_token": {"enabled": True, "weight": -2}, "malformed_thinking": {"enabled": False}, "default_max_advantage_penalty": -3})
    assert settings == {"eos_token": {"weight": 2, "advantage_penalty_normalizer": "grpo", "max_advantage_penalty": 3}}
    for bad in ({"nope": {}}, {"eos_token": {"enabled": True, "advantage_penalty_normalizer": "x"}}):
        with pytest.raises(ValueError):
            groups.penalty_settings(bad)


def test_placement(spark):
    base = F.array(*(F.lit(1.0) for _ in range(4)))
    r = spark.range(1).select(groups.placed(base, F.lit(-0.5), F.lit(1), F.lit(2)).alias("a"), groups.spread_over(base, F.lit(-1.0), F.lit(2), F.array(F.lit(1), F.lit(2))).alias("b")).first()
    assert r.a == [1.0, 0.5, 0.5, 1.0] and r.b == [1.0, 1.0, 0.5, 0.0]


def test_expects_tool_call(spark):
    lines = ['{"agent_ref":{"name":" General_QA_x"},"answer_is_tool_call":true}', '{"agent_ref":{"name":"general_qa"},"answer_is_tool_call":false}', '{"agent_ref":{"name":"single_step_tool_use_with_argument_comparison"},"expected_action":{"type":"function_call"}}', '{"agent_ref":{"name":"other"}}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    assert [r.e for r in df.select("i", groups.expects_tool_call(F.col("line")).alias("e")).orderBy("i").collect()] == [True, False, True, False]


@pytest.mark.parametrize("name", sorted(packing.PACKERS))
def test_packers(name):
    lengths = [7, 5, 5, 3, 3, 2, 10, 1, 6, 4, 4, 2]
    bins = packing.get_packer(name)(lengths, 10, 3)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 10 for b in bins)
    if name != "concatenative":
        assert len(bins) <= 7
    assert packing.get_packer(name)([], 10, 3) == []
    with pytest.raises(ValueError):
        packing.get_packer("other")


def test_packing_statistics(spark):
    df = spark.createDataFrame([(0, 6), (0, 4), (1, 5)], "bin int, length int")
    r = packing.packing_statistics(df, 10).first()
    assert (r.average_utilization, r.total_waste, r.theoretical_min_bins) == (0.75, 5, 2)
    assert packing.packing_statistics(df.filter("bin = 1"), 10).first().bin_balance == 1.0
    assert set(packing.packing_statistics(df.limit(0), 10).first()) == {0}
    with pytest.raises(Exception, match="longer than"):
        packing.pack(spark.createDataFrame([(0, 1, 11)], "b int, k int, n int"), "b", "k", "n", 10).collect()


def test_ragged(spark):
    g = packing.group_and_concat(spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [4, 5, 6]), (3, [7])], "i int, ids array<int>"), "i", "ids", [2, 2], -1)
    assert rows(g) == [(0, [1, 2, 3, -1]), (1, [4, 5, 6, 7])]
    r = spark.range(1).select(packing.positions(F.array(F.lit(2), F.lit(0), F.lit(3))).alias("p"), packing.unpacked(F.array(*map(F.lit, range(5))), F.array(F.lit(2), F.lit(3))).alias("u"), packing.eos_ids and packing.round_up(F.lit(17), 16).alias("n")).first()
    assert r.p == [0, 1, 0, 1, 2] and r.u == [[0, 1], [2, 3, 4]] and r.n == 32
    assert packing.eos_ids("2, 11") == [2, 11] and packing.eos_ids(None) == []
    with pytest.raises(ValueError):
        packing.eos_ids("abc")
    schema = "m array<struct<role:string,token_ids:array<bigint>,generation_logprobs:array<float>>>"
    df = spark.createDataFrame([([("user", [5], None), ("assistant", [], []), ("assistant", [7], [0.5])],)], schema)
    m = df.select(packing.filled_generation(F.col("m"), [11, 2]).alias("m")).first().m
    assert [(x.token_ids, x.was_empty) for x in m] == [([5], False), ([2], True), ([7], False)] and m[1].generation_logprobs == [0.0]
    p = packing.PackedTensor(F.array(F.array(F.lit(1)), F.lit(None)))
    q = spark.range(1).select(p.concat(p).pieces.alias("c"), p.flattened_concat(p.empty_like()).pieces.alias("f"), p.packed().alias("p")).first()
    assert q.c == [[1], None, [1], None] and q.f == [[1], None] and q.p == [1]
    with pytest.raises(ValueError):
        p.concat(packing.PackedTensor(F.array(), 1))


def test_preference_collate(spark):
    df = spark.createDataFrame([(0, 1, [1] * 7, [2] * 5), (0, 0, [3] * 6, [4] * 7)], "b int, w int, c array<int>, r array<int>")
    out = packing.collate_preferences(df, "b", "c", "r", ["w"], multiple=16).collect()
    assert sorted((r.length, r.width, len(r.ids), r.w) for r in out) == [(5, 16, 16, 1), (6, 16, 16, 0), (7, 16, 16, 0), (7, 16, 16, 1)]


def test_concatenate_and_chunk(spark):
    out = packing.concatenate_and_chunk(spark.createDataFrame([(0, 3), (1, 0), (2, 8), (3, 2)], "i int, n long"), "i", "n", 5)
    assert rows(out, "i", "offset", "first_chunk", "last_chunk") == [(0, 0, 0, 0), (1, 3, 0, 0), (2, 3, 0, 2), (3, 11, 2, 2)]
    assert list(packing.stream_chunks(iter([(0, 3), (1, 3), (2, 9), (3, 1)]), 5)) == [[0, 1], [2], [3]]


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "cats purr"), (1, "dogs bark at cats"), (2, "fish swim")], "id long, text string")
    q = spark.createDataFrame([(9, "cats purr"), (8, "birds")], "q long, text string")
    index = retrieval.Bm25(docs, "id", "text")
    got = rows(index.search(q, "q", "text", 2), "query", "rank", "doc")
    assert got == [(8, 1, 0), (8, 2, 1), (9, 1, 0), (9, 2, 1)]
    with pytest.raises(ValueError):
        index.search(q, "q", "text", 4)
    turns = spark.createDataFrame([(1, "x <retrieve>fish</retrieve>"), (2, "nothing")], "k long, t string")
    a = {r.k: r for r in retrieval.answers(turns, index, "k", "t", 1).collect()}
    assert a[1].content == "<result>\n<1>\nfish swim\n</1>\n</result>\n" and a[2].content == retrieval.NO_QUERY and a[1].reward == 0.0


def plain_bm25(docs, text, k):
    """Best ids and scores of one query, by the formula; rows of one id are one document, null ids count but are not found."""
    texts = {}
    for i, t in docs:
        texts[i] = texts.get(i, []) + (t or "").split()
    mean = sum(map(len, texts.values())) / len(docs)
    out = []
    for i, ws in texts.items():
        score = 0.0
        for w in text.split():
            df, tf = sum(w in x for x in texts.values()), ws.count(w)
            score += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / mean))
        if score and i is not None:
            out.append((-round(score, 9), i))
    return [(i, -x) for x, i in sorted(out)[:k]]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_TERMS": 5, "HELD": 4, "AT_ONCE": 3}])
def test_bm25_against_plain_version(spark, monkeypatch, limits):
    """Copies, repeated and null ids, empty texts; in one part and in many. What is written has the size of the queries, not of the corpus."""
    for name, value in limits.items():
        monkeypatch.setattr(retrieval, name, value)
    written, write = [], retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, tag: (written.append((tag, (out := write(df, tag)).count())), out)[1])
    rng = random.Random(8)
    docs = [(i % 97 if i % 50 else None, " ".join(rng.choices("abcdefghij", [2**k for k in range(10)], k=rng.randrange(12)))) for i in range(300)]
    docs += [(1000 + i, "a b c") for i in range(20)] + [(2000, None)]
    queries = [(0, "a b c"), (1, "j i"), (2, "a a j"), (3, "d e f g h"), (4, ""), (5, "zebra")]
    index = retrieval.Bm25(spark.createDataFrame(docs, "id long, text string").repartition(5), "id", "text")
    got = index.search(spark.createDataFrame(queries, "q long, text string"), "q", "text", 7).collect()
    for q, text in queries[:4]:
        want = plain_bm25(docs, text, 7)
        mine = sorted((r.rank, r.doc, r.score) for r in got if r.query == q)
        assert [x[:2] for x in mine] == [(n + 1, i) for n, (i, _) in enumerate(want)] and [x[2] for x in mine] == pytest.approx([x for _, x in want])
    assert all([r.doc for r in sorted(got, key=lambda r: r.rank) if r.query == q] == list(range(7)) for q in (4, 5))
    assert max(n for _, n in written) <= 28


def test_metric_series(spark):
    s = spark.createDataFrame([("m", i, float(i)) for i in range(5, 11)], "metric string, step long, value double")
    assert rows(metrics.in_range(s, -2, 0), "step") == [(9,), (10,)]
    assert rows(metrics.in_range(s, 1, 6), "step") == [(5,)]
    assert metrics.trimmed_mean(s, 1, 0, 0.5).first()["mean"] == 6.0 and metrics.trimmed_mean(s, 1, 0, 1.0).first()["mean"] == 5.0
    assert metrics.medians(s).first()["median"] == 7.5
    points = spark.createDataFrame([("m", 1, 1.0, 1, 0), ("m", 1, 2.0, 2, 0), ("m", 2, 3.0, 1, 1)], "metric string, step long, value double, mtime int, pos int")
    assert rows(metrics.merged(points), "step", "value") == [(1, 2.0), (2, 3.0)]
    with pytest.raises(Exception, match="conflict in m at 1"):
        metrics.merged(points, fail_on_conflict=True).collect()
    c = metrics.checks(s, [{"metric": "m", "helper": "max", "op": "<", "limit": 11.0}, {"metric": "x", "helper": "max", "op": "<", "limit": 11.0}, {"metric": "m", "helper": "eval", "op": "<", "limit": 0}]).orderBy("check").collect()
    assert [r.passed for r in c] == [True, False, False] and c[0].message == "PASS: max(m) < 11.0"


def test_counters(spark):
    df = spark.createDataFrame([("spec_decode_a", 100.0, None), ("spec_decode_a", 150.0, None), ("other_metric", 9.0, None), ("spec_decode_p", None, [1.0, 2.0]), ("spec_decode_p", None, [3.0, 4.0])], "metric string, value double, vector array<double>")
    assert sorted((r.metric, r.position, r.value) for r in metrics.worker_counters(df).filter("position is not null").collect()) == [("spec_decode_p", 1, 4.0), ("spec_decode_p", 2, 6.0)]
    length, rate = metrics.acceptance(F.lit(100.0), F.lit(300.0), F.lit(240.0))
    assert tuple(spark.range(1).select(length.alias("l"), rate.alias("r")).first()) == (pytest.approx(3.4), pytest.approx(0.8))
    assert rows(metrics.layer_means(spark.createDataFrame([("a", [1.0, 3.0])], "metric string, layers array<double>"), 0.5)) == [("a", 1.0, [0.5, 1.5])]


def test_timing_log(spark):
    text = ["noise: 1s", "Timing:", "  • step/a: 1.5s", "total_step_time: 9s", "Logged data to x", "Timing:", "• step/a: 2.5s", "• b: 1.0 s", "Logged data to y"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, pos int, line string")
    blocks = metrics.timing_blocks(lines)
    assert rows(blocks, "block", "metric", "seconds") == [(0, "step/a", 1.5), (0, "total_step_time", 9.0), (1, "b", 1.0), (1, "step/a", 2.5)]
    s = {r.metric: r for r in metrics.timing_summary(blocks, ["file", "block"]).collect()}
    assert s["step/a"].mean == 2.0 and s["b"]["std"] == 0.0 and s["step/a"].share == pytest.approx(2 / 2.5) and "total_step_time" not in s


def test_trees(spark):
    tree = {"prompt": {"role": "prompter", "text": "q", "replies": [{"role": "assistant", "text": "a", "replies": []}, {"role": "assistant", "text": "b", "replies": [{"role": "prompter", "text": "c", "replies": []}]}]}}
    alone = {"prompt": {"role": "prompter", "text": "only", "replies": []}}
    schema = "id string, parent_id string, role string, text string"
    got = trees.threads(spark.createDataFrame(trees.flat_nodes([tree, alone]), schema))
    assert sorted([m.content for m in r.messages[1:]] for r in got.collect()) == [["q", "a"], ["q", "b", "c"]]
    with pytest.raises(Exception, match="unknown role robot"):
        trees.threads(spark.createDataFrame([("0", None, "robot", "x")], schema)).collect()


def test_question_answer(spark):
    chat = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": " a\n"}]}
    call = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "tool_calls": [{"function": {"name": "f", "arguments": "{}"}}]}], "tools": '["{}"]'}
    with_last = lambda **x: chat | {"messages": [chat["messages"][0], {"role": "assistant"} | x]}
    with_call = lambda *x: with_last(tool_calls=list(x)) | {"tools": [{"name": "f"}]}
    asked = {"question": [{"role": "user", "content": "q"}]}
    cases = [  # a record, and the record that it becomes, None if it is left out, or its error
        (chat, asked | {"ground_truth": "a"}),
        (chat | {"tools": []}, asked | {"ground_truth": "a"}),
        (call, asked | {"ground_truth": {"name": "f", "arguments": "{}"}, "answer_is_tool_call": True, "tools": [{}]}),
        (with_call({"name": "g", "arguments": {"x": [1, None]}}), asked | {"ground_truth": {"name": "g", "arguments": {"x": [1, None]}}, "answer_is_tool_call": True, "tools": [{"name": "f"}]}),
        (with_last(content="a", tool_calls=[]), asked | {"ground_truth": "a"}),
        (with_last(content="a", tool_calls=None), asked | {"ground_truth": "a"}),
        ({"messages": []}, None),
        ({"other": 1}, None),
        ({"messages": [{"role": "assistant", "content": "a"}]}, None),
        (with_last(content="  "), None),
        (with_last(), None),
        ({"messages": [{"role": "user", "content": "q"}, "a"]}, None),
        (call | {"tools": None}, "without tools"),
        (call | {"tools": "3"}, "expected a list"),
        (call | {"tools": ["3"]}, "expected objects"),
        (with_call({"name": "f", "arguments": "{}"}, {"name": "f", "arguments": "{}"}), "more than one tool call"),
        (with_call("f"), "must be an object"),
        (with_call({"name": " ", "arguments": "{}"}), "needs a name"),
        (with_call({"name": 3, "arguments": "{}"}), "needs a name"),
        (with_call({"name": "f"}), "needs arguments"),
        (with_call({"name": "f", "arguments": [1]}), "needs arguments"),
        (with_last(content=3), "expected text"),
    ]
    rows = [(k, json.dumps(x), "qa", "record") for k, (x, _) in enumerate(cases)] + [(100, "  ", "", ""), (101, None, "", "")]
    lines = spark.createDataFrame(rows, "k int, line string, qa string, qa_ string")
    good = {k: w for k, (_, w) in enumerate(cases) if not isinstance(w, str)}
    got = {r.k: json.loads(r.record) for r in trees.convert_to_question_answer(lines.filter(F.col("k").isin([*good, 100, 101])), "line").collect()}
    assert got == {k: w for k, w in good.items() if w}
    assert {r.k for r in trees.convert_to_question_answer(lines, skip_on_error=True).collect()} == set(got)
    for k, (_, w) in enumerate(cases):
        if isinstance(w, str):
            with pytest.raises(Exception, match=w):
                trees.convert_to_question_answer(lines.filter(F.col("k") == k)).collect()
    with pytest.raises(Exception, match="not JSON"):
        trees.convert_to_question_answer(spark.createDataFrame([("{",)], "line string")).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('q,a\n"x, y",1\n')
    (tmp_path / "b.jsonl").write_text('{"q": "x"}\n[1]\n\n{"q": 2, "z": null}\n')
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"q": "z"}\n')
    (tmp_path / "d.txt").write_text("one\ntwo\n")
    table = pa.table({"n": [1, 2, 3]})
    with pa.OSFile(str(tmp_path / "e.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    load = lambda name, **k: files.load_table(spark, str(tmp_path / name), **k)
    assert rows(load("a.csv", schema="q string, a int")) == [("x, y", 1)]
    assert rows(load("c.jsonl.gz")) == [("z",)] and rows(load("d.txt")) == [("one",), ("two",)] and rows(load("e.arrow")) == [(1,), (2,), (3,)]
    assert files.load_objects(spark, str(tmp_path / "b.jsonl")).count() == 2
    lines = files.load_lines(spark, str(tmp_path / "b.jsonl"))
    files.write_lines(lines.filter("line <> ''"), "line", str(tmp_path / "out"))
    assert sorted(r.text for r in spark.read.text(str(tmp_path / "out")).toDF("text").collect()) == ['[1]', '{"q": "x"}', '{"q": 2, "z": null}']
    files.replace_folder(spark.range(1), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"id":0}']
    assert files.task_name("/data/sets/my.train.jsonl") == "sets-my"
    assert files.resolve(spark, [str(tmp_path / "*.csv"), str(tmp_path / "a.*")]) == [f"file:{tmp_path}/a.csv"]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.csv").write_text("")
    assert files.resolve(spark, [f"{tmp_path}/**/a.csv"]) == [f"file:{tmp_path}/a.csv", f"file:{tmp_path}/deep/er/a.csv"]
    with pytest.raises(FileNotFoundError):
        files.resolve(spark, [str(tmp_path / "zz*")])
    for bad in (tmp_path / "x.json", tmp_path / "b.jsonl"):
        with pytest.raises((ValueError, FileExistsError)):
            files.checked_output(spark, str(bad))
    mock = files.mock_rows(spark, 4, 6)
    assert mock.select("text").distinct().count() == 1 and len(mock.first().text.split()) == 6 and files.mock_candidate([9, 12, 11], 10) == 0


def test_registry_and_config(spark):
    r = registry.Registry("thing")
    r.register("a", 1)
    for f in (lambda: r.register("a", 2), lambda: r.get("b")):
        with pytest.raises(ValueError):
            f()
    configs = {"base": {"x": {"a": 1, "b": 2}, "y": [1]}, "top": {"defaults": "base", "x": {"b": 3}, "y": [2]}, "own": {"defaults": ["base"], "x": {"_override_": True, "c": 1}}}
    assert registry.inherited(configs, "top") == {"x": {"a": 1, "b": 3}, "y": [2]}
    assert registry.inherited(configs, "own") == {"x": {"c": 1}, "y": [1]}
    assert registry.resolve({"a": 2, "b": "${mul:${a},3}", "c": "${max:1,${b}}", "d": "${add:1,2}"}) == {"a": 2, "b": 6, "c": 6, "d": 3}
    assert registry.deep_merge({"a": {"b": 1}, "c": 1}, {"a": {"d": 2}, "c": {"e": 1}}) == {"a": {"b": 1, "d": 2}, "c": {"e": 1}}
    assert registry.lookup_path({"a": {"b": 1}}, "a.b") == 1 and registry.lookup_path({}, "a.b") is None
    df = spark.createDataFrame([("t", 1)], "task_name string, v int")
    assert registry.process_by_task(df, {"t": lambda x: x.withColumn("v", F.col("v") + 1)}).first().v == 2
    with pytest.raises(Exception, match="no processor for t"):
        registry.process_by_task(df, {"u": lambda x: x}).collect()


def test_rank_layout(spark):
    g = registry.RankLayout({"dp": 2, "tp": 3})
    assert g.coords(4) == {"dp": 1, "tp": 1} and g.ranks_by_coord(tp=2) == [2, 5] and g.ranks_by_coord(tp=9) == [] and g.ranks(dp=1, tp=0) == 3 and g.ranks(dp=1).names == ["tp"]
    assert g.table(spark).count() == 6
    with pytest.raises(IndexError):
        g.ranks(tp=9)
    with pytest.raises(ValueError):
        g.ranks(pp=0)


def test_replay(spark):
    df = spark.createDataFrame([(i, i % 6) for i in range(60)], "k long, weight_version int")
    assert {r.weight_version for r in replay.usable(df, 4, 1).collect()} == {3, 4}
    assert replay.replay(df, 4, 2, 3, "k").count() == replay.buffer_size(3, 2) == 12


def test_consistency_counts_all_subsets():
    import random
    from collections import Counter
    from itertools import combinations

    rng = random.Random(8)
    for _ in range(200):
        n, k = rng.randrange(0, 9), rng.randrange(1, 6)
        answers, rewards = [rng.choice("ABCD") for _ in range(n)], [rng.randrange(3) for _ in range(n)]
        right = []
        for subset in combinations(range(n), k):
            counts = Counter(answers[i] for i in subset)
            right.append(next(rewards[i] for i in subset if counts[answers[i]] == max(counts.values())))
        assert groups.consistency(answers, rewards, k) == pytest.approx(sum(right) / max(1, len(right)))
    assert groups.consistency(["a", "b"] * 1000, [1.0, 0.0] * 1000, 3) == pytest.approx(0.5, abs=0.01)


def test_cons_at_k_query_reads_every_rollout(spark, tmp_path):
    from posttrain_spark.plans.data_queries import e3_cons_at_k

    kinds = ["view"] * 6 + ["purchase"] * 14
    rows = [(i, 1, 1.0, k) for i, k in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double, event_type string").selectExpr("*", "timestamp'2024-01-01' AS ts").write.parquet(str(tmp_path / "events.parquet"))
    got = [r.cons_at_k for r in e3_cons_at_k(spark, str(tmp_path)).collect()]
    assert got == [pytest.approx((364 + 91 * 6) / 1140)]
