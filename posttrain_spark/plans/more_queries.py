"""Queries over sources and sinks, mappers of single datasets, gates and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses, messages, rewards
from ..operators import metrics, packing, sets, trees
from ..sources import files
from ..sources.storage import fresh_path
from ..streaming import replay
from .base import CHATS, ROLLOUTS, chats, query, r6, rollouts, table


@query("SELECT item_id, md5(text) AS digest FROM benchmark")
def a4_gzip_json_lines(spark, d):
    """JSON lines in gzip files, read by suffix (A4)."""
    at = fresh_path(spark, "gzip") + ".jsonl.gz"
    files.write_json_lines(table(spark, d, "benchmark").select("item_id", "text"), at, compression="gzip")
    return files.load_table(spark, at, schema="item_id long, text string").select("item_id", F.md5("text").alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'conv_id,text,turn' ELSE 'conv_id,turn' END AS fields FROM conversations")
def a6_kept_fields(spark, d):
    """Objects of different fields keep just theirs."""
    at = fresh_path(spark, "objects")
    files.write_json_lines(table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text")), at)
    row = F.from_json(F.to_json("row"), "map<string,string>")
    return files.load_objects(spark, at).select(row.alias("r")).select(F.col("r.conv_id").cast("long").alias("conv_id"), F.col("r.turn").cast("int").alias("turn"), F.array_join(F.array_sort(F.map_keys("r")), ",").alias("fields"))


RAW = """concat('{ "id" : ', doc_id, ' ,"source":  "', source, '" }')"""


@query(f"SELECT {RAW} AS line FROM documents")
def a11_lines_as_they_are(spark, d):
    """Lines written as they were read, spaces and all."""
    at, again = fresh_path(spark, "raw"), fresh_path(spark, "raw")
    files.write_lines(table(spark, d, "documents").select(F.expr(RAW).alias("line")), "line", at)
    kept = files.load_lines(spark, at).filter(sets.is_object(F.col("line")))
    files.write_lines(kept, "line", again)
    return files.load_lines(spark, again).select("line")


@query("SELECT event_type AS metric, dayofyear(ts)::BIGINT AS step, value::DOUBLE AS value, concat('user', user_id) AS source_file FROM events")
def a14_metric_points(spark, d):
    """Metric points as a long table."""
    e = table(spark, d, "events")
    return files.metric_points(e, F.col("event_type"), F.dayofyear("ts"), F.col("value"), F.concat(F.lit("user"), F.col("user_id")))


@query(
    """WITH e AS (SELECT event_id, user_id % 7 AS run, event_type, floor(value)::DOUBLE AS seconds, coalesce(sum((event_id % 5 = 0)::INT) OVER (PARTITION BY user_id % 7 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block FROM events)
SELECT run::BIGINT AS run, block, event_type AS metric, arg_max(seconds, event_id) AS seconds FROM e GROUP BY ALL"""
)
def f3_timing_log(spark, d):
    """Blocks, sections and lines of a training log, the last value of a name in a block."""
    e = table(spark, d, "events")
    timing = F.concat(F.lit("  \u2022 "), F.col("event_type"), F.lit(": "), F.floor("value").cast("string"), F.lit("s (1.0%)"))
    lines = F.array(F.lit("Timing:"), timing, F.when(F.col("event_id") % 5 == 0, F.lit("Logged data to logs/x")))
    log = e.select((F.col("user_id") % 7).cast("long").alias("run"), "event_id", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("i", "line")).withColumn("pos", F.col("event_id") * 10 + F.col("i"))
    return metrics.timing_blocks(log, file="run").select("run", "block", "metric", "seconds")


@query("SELECT item_id, md5(text) AS problem, item_id % 100 AS answer FROM benchmark")
def b2_problem_answer(spark, d):
    """Problem and answer columns of any name as prompt and response (B2)."""
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("problem"), (F.col("item_id") % 100).cast("string").alias("answer"))
    m = rows.select("item_id", messages.prompt_response("problem", "answer").alias("m"))
    return m.select("item_id", F.md5(F.col("m")[0]["content"]).alias("problem"), F.col("m")[1]["content"].cast("long").alias("answer"))


@query("SELECT doc_id, md5(text) AS question, source AS truth, 'user,assistant' AS roles FROM documents")
def b3_nested_rekey(spark, d):
    """Question in a list of messages, ground truth in a struct."""
    rows = table(spark, d, "documents").select("doc_id", F.array(F.struct(F.col("text").alias("content"))).alias("prompt"), F.struct(F.col("source").alias("ground_truth")).alias("reward_model"))
    m = rows.select("doc_id", messages.nested_prompt_truth(F.col("prompt"), F.col("reward_model")).alias("m"))
    return m.select("doc_id", F.md5(F.col("m")[0]["content"]).alias("question"), F.col("m")[1]["content"].alias("truth"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT doc_id, md5(concat_ws('|', text, source, lang)) AS digest, 'system,user,assistant' AS roles FROM documents")
def b4_context_question_answer(spark, d):
    """Context, question and the first of several answers."""
    m = messages.context_question_answer(F.col("text"), F.col("source"), F.array("lang", "source"))
    return table(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", F.md5(F.array_join(messages.contents(F.col("m")), "|")).alias("digest"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


@query(f"WITH {CHATS} SELECT conv_id, len(texts)::INT AS n, md5(array_to_string(texts, '|')) AS digest, 'sft' AS task_name FROM chats WHERE roles[-1] = 'assistant'")
def b6_checked_chats(spark, d):
    """Chats that end with the assistant, nothing but messages and task kept."""
    rows = chats(spark, d).filter(messages.last_role(F.col("messages")) == "assistant")
    m = rows.select("conv_id", messages.checked_chat(F.col("messages")).alias("m"))
    return m.select("conv_id", F.size("m").alias("n"), F.md5(F.array_join(messages.contents(F.col("m")), "|")).alias("digest"), F.lit("sft").alias("task_name"))


@query("SELECT doc_id, lang AS chosen, source AS rejected, 'pairs' AS task_name FROM documents")
def b11_preference_as_it_is(spark, d):
    return sets.stamp(table(spark, d, "documents").select("doc_id", F.col("lang").alias("chosen"), F.col("source").alias("rejected")), "pairs", "task_name")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) END AS prompt, CASE WHEN doc_id % 3 <> 0 THEN n_chars % 50 END AS n_ids, CASE WHEN doc_id % 3 = 0 THEN 1 + doc_id % 2 END AS n_images FROM documents")
def b24_generation_prompts(spark, d):
    """Ids without their padding, or text with images."""
    rows = table(spark, d, "documents").select("doc_id", "text", (F.col("n_chars") % 50).cast("int").alias("n"))
    ids = packing.padded(F.array_repeat(F.lit(5), F.col("n")), F.lit(64))
    images = F.when(F.col("doc_id") % 3 == 0, F.array_repeat(F.lit("img"), (1 + F.col("doc_id") % 2).cast("int"))).otherwise(F.array().cast("array<string>"))
    p = rows.select("doc_id", messages.generation_prompt(ids, F.col("n"), F.when(F.col("doc_id") % 3 != 1, F.col("text")), images).alias("p"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return p.select("doc_id", F.md5("p.prompt").alias("prompt"), size("p.prompt_token_ids").alias("n_ids"), size("p.images").alias("n_images"))


@query(
    f"""WITH {CHATS}, t AS (SELECT *, trim(texts[-1], ' ' || chr(9) || chr(10) || chr(13)) AS last, conv_id % 3 = 0 AS called FROM chats)
SELECT conv_id, (len(texts) - 1)::INT AS n_question, md5(texts[1]) AS first, CASE WHEN called THEN concat('f', conv_id) END AS name, CASE WHEN called THEN md5(texts[-1]) ELSE md5(last) END AS answer, CASE WHEN called THEN 1 END AS n_tools
FROM t WHERE len(texts) > 1 AND (called OR last <> '')"""
)
def c5_question_answer_records(spark, d):
    """Chat records as question-answer records, a third of them answered by a tool call; tools as JSON text in JSON text."""
    called = F.col("conv_id") % 3 == 0
    last = F.element_at("messages", -1)["content"]
    call = F.struct(F.struct(F.concat(F.lit("f"), F.col("conv_id")).alias("name"), last.alias("arguments")).alias("function"))
    answer = F.struct(F.lit("assistant").alias("role"), F.when(~called, last).alias("content"), F.when(called, F.array(call)).alias("tool_calls"))
    turns = F.transform(F.slice("messages", 1, F.size("messages") - 1), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("array<struct<function:struct<name:string,arguments:string>>>").alias("tool_calls")))
    record = F.struct(F.concat(turns, F.array(answer)).alias("messages"), F.when(called, F.lit('["{\\"name\\": \\"f\\"}"]')).alias("tools"))
    lines = chats(spark, d).select("conv_id", F.to_json(record).alias("line"))
    r = trees.convert_to_question_answer(lines).select("conv_id", F.try_parse_json("record").alias("r"))
    get = lambda path, kind: F.try_variant_get("r", path, kind)
    text = F.when(F.col("conv_id") % 3 == 0, get("$.ground_truth.arguments", "string")).otherwise(get("$.ground_truth", "string"))
    return r.select("conv_id", F.size(get("$.question", "array<variant>")).alias("n_question"), F.md5(get("$.question[0].content", "string")).alias("first"), get("$.ground_truth.name", "string").alias("name"), F.md5(text).alias("answer"), F.when(get("$.tools", "variant").isNotNull(), F.size(get("$.tools", "array<variant>"))).alias("n_tools"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'assistant' AND length(text) % 3 = 0) AS filled, sum(CASE WHEN role = 'assistant' AND length(text) % 3 = 0 THEN 1 ELSE length(text) % 3 END)::BIGINT AS n_ids FROM conversations GROUP BY conv_id")
def c13_filled_generations(spark, d):
    """Assistant turns without tokens get the smallest end id."""
    n = lambda m: (F.length(m["content"]) % 3).cast("int")
    m = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.array_repeat(F.lit(9).cast("long"), n(m)).alias("token_ids"), F.array_repeat(F.lit(-1.0).cast("float"), n(m)).alias("generation_logprobs")))
    rows = chats(spark, d).select("conv_id", m.alias("m")).select("conv_id", packing.filled_generation(F.col("m"), packing.eos_ids("7,2")).alias("m"))
    count = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["was_empty"].cast("long"))
    return rows.select("conv_id", count.alias("filled"), F.size(packing.flat_ids(F.col("m"))).cast("long").alias("n_ids"))


@query(
    """WITH e AS (SELECT vec_id, list_avg(list_transform(range(1, len(embedding)), lambda i: exp(abs(embedding[i]::DOUBLE - embedding[i + 1]::DOUBLE)))) AS e FROM embeddings)
SELECT vec_id, round(e, 6) AS error, (e <= 1.15)::INT AS mask FROM e"""
)
def c16_sequence_masks(spark, d):
    """Sequences whose log-probabilities differ too much between policy and sampler are masked."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p, s = F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1)
    return e.select("vec_id", r6(losses.sequence_error(p, s)).alias("error"), losses.sequence_mask(p, s, 1.15).alias("mask"))


@query(
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents), b AS (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS i FROM events)
SELECT doc_id, event_id FROM a JOIN b USING (i)"""
)
def d4_positional_zip(spark, d):
    """Rows of two tables side by side by place."""
    down = table(spark, d, "events").select("event_id", (-F.col("event_id")).alias("down"))
    return sets.zipped(table(spark, d, "documents").select("doc_id"), down, ["doc_id"], ["down"]).select("doc_id", "event_id")


@query(
    """WITH v AS (SELECT doc_id, n_chars % 60 AS a, 1 + doc_id % 12 AS b, doc_id % 5 AS k, (n_chars + doc_id) % 60 AS t FROM documents)
SELECT doc_id, (abs(CASE k WHEN 0 THEN a WHEN 1 THEN a / b::DOUBLE WHEN 2 THEN a / b::DOUBLE WHEN 3 THEN a / 100.0 ELSE a + 0.5 END - CASE WHEN doc_id % 2 = 0 THEN CASE k WHEN 0 THEN a WHEN 3 THEN a / 100.0 WHEN 4 THEN a + 0.5 ELSE a / b::DOUBLE END ELSE t END) < 1e-9)::INT::DOUBLE AS score FROM v"""
)
def h5_math_values(spark, d):
    """Answers as numbers, fractions, percentages and decimals against whole numbers or fractions (H5)."""
    v = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 60).alias("a"), (1 + F.col("doc_id") % 12).alias("b"), (F.col("doc_id") % 5).alias("k"), ((F.col("n_chars") + F.col("doc_id")) % 60).alias("t"))
    tag = lambda *x: F.concat(F.lit("so <answer>"), *x, F.lit("</answer>"))
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    frac = F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}"))
    response = F.when(F.col("k") == 0, F.concat(F.lit("thus \\boxed{"), a, F.lit("}"))).when(F.col("k") == 1, tag(frac)).when(F.col("k") == 2, tag(a, F.lit("/"), b)).when(F.col("k") == 3, tag(a, F.lit("\\%"))).otherwise(tag(a, F.lit(".50")))
    own = F.when(F.col("k") == 0, a).when(F.col("k") == 3, F.concat(a, F.lit("/100"))).when(F.col("k") == 4, F.concat((2 * F.col("a") + 1).cast("string"), F.lit("/2"))).otherwise(F.concat(a, F.lit("/"), b))
    truth = F.when(F.col("doc_id") % 2 == 0, own).otherwise(F.col("t").cast("string"))
    return v.select("doc_id", rewards.math_expr(truth, response)[0].alias("score"))


def streamed(rows):
    """A stream of the rows as they are now."""
    at = fresh_path(rows.sparkSession, "source")
    rows.write.parquet(at)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(at)


@query(
    """WITH t AS (SELECT user_id % 4 + 5 AS target_version, event_id AS trajectory_id, user_id % 11 AS v FROM events), r AS (
 SELECT *, row_number() OVER (PARTITION BY target_version ORDER BY trajectory_id) - 1 AS i, count(*) OVER (PARTITION BY target_version) AS n FROM t WHERE v BETWEEN target_version - 2 AND target_version)
SELECT target_version, trajectory_id, i // 16 + 1 AS batch, false AS expired FROM r WHERE i // 16 < n // 16 UNION ALL SELECT target_version, trajectory_id, -1, true FROM t WHERE v NOT BETWEEN target_version - 2 AND target_version"""
)
def k2_buffered_trajectories(spark, d):
    """Trajectories wait in the stream's state until a batch is full; those of the wrong age go (K2, K3)."""
    u = F.col("user_id")
    rows = table(spark, d, "events").select((u % 4 + 5).alias("target_version"), F.col("event_id").alias("trajectory_id"), (u % 11).alias("weight_version"))
    out, state = fresh_path(spark, "batches"), fresh_path(spark, "stream")
    replay.buffered(streamed(rows), 16, 2).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH {ROLLOUTS} SELECT prompt, round(stddev_samp(reward), 6) AS reward_std FROM rollouts GROUP BY prompt HAVING stddev_samp(reward) > 0")
def k5_gathered_groups(spark, d):
    """Groups of varied reward from a stream, here as many as there are (K5)."""
    rows = rollouts(spark, d).groupBy("prompt").agg(F.stddev_samp("reward").alias("reward_std"))
    varied, at = rows.filter("reward_std > 0").count(), fresh_path(spark, "groups")
    stream = streamed(rows)
    replay.accumulate(stream, max(1, varied), 1_000, at).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return replay.gathered(spark, at, stream.schema).select("prompt", r6("reward_std").alias("reward_std"))
