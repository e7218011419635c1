"""Queries over messages, mappers, filters and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, messages, rewards
from ..operators import packing, retrieval, trees
from ..operators.groups import expects_tool_call, has_invalid_tool_call
from ..sources.files import load_lines, load_table, write_json_lines
from ..sources.storage import fresh_path
from .base import CHATS, RESPONSES, chats, query, r6, responses, sql_r6, table


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars >= 1000")
def a1_load_by_suffix(spark, d):
    """A file source by suffix; the filter and the three columns reach the scan."""
    return load_table(spark, f"{d}/documents.parquet").filter("n_chars >= 1000").select("doc_id", "lang", "n_chars")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def a5_json_lines_round_trip(spark, d):
    """JSONL sink, raw-line source and fields read from the lines."""
    at = fresh_path(spark, "lines")
    write_json_lines(table(spark, d, "conversations"), at)
    row = F.from_json("line", "conv_id long, turn long, role string, text string").alias("r")
    return load_lines(spark, at).select(row).select("r.conv_id", "r.turn", "r.role", F.md5("r.text").alias("digest"))


@query("SELECT item_id, md5(text) AS problem_md5, item_id % 7 AS expected_answer FROM benchmark")
def a7_csv_evaluation_set(spark, d):
    """CSV evaluation set with problem and solution columns, rekeyed."""
    at = fresh_path(spark, "eval") + ".csv"
    table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), (F.col("item_id") % 7).alias("solution")).write.option("header", True).option("escape", '"').csv(at)
    rows = load_table(spark, at, schema="item_id long, question string, solution long").select("item_id", *messages.rename({"problem": "question", "expected_answer": "solution"}))
    return rows.select("item_id", F.md5("problem").alias("problem_md5"), "expected_answer")


@query("SELECT doc_id, 2 AS n, 'user,assistant' AS roles, md5(concat(source, '|', text)) AS digest, 'documents' AS task_name FROM documents")
def b1_prompt_response(spark, d):
    m = messages.prompt_response("source", "text")
    return table(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.md5(F.array_join(messages.contents(F.col("m")), "|")).alias("digest"), F.lit("documents").alias("task_name"))


@query(f"WITH {CHATS} SELECT conv_id, (len(texts) + 1)::INT AS n, 'system' AS first_role, md5(concat('Be brief.|', array_to_string(texts, '|'))) AS digest FROM chats WHERE roles[-1] = 'assistant'")
def b5_chat_with_system(spark, d):
    """Conversations that end with the assistant, a system turn in front."""
    rows = chats(spark, d).filter(messages.last_role(F.col("messages")) == "assistant")
    m = messages.checked_chat(F.col("messages"), default_system="Be brief.")
    return rows.select("conv_id", m.alias("m")).select("conv_id", F.size("m").alias("n"), F.col("m")[0]["role"].alias("first_role"), F.md5(F.array_join(messages.contents(F.col("m")), "|")).alias("digest"))


@query("SELECT doc_id, CASE WHEN quality - toxic > 0 THEN d.source ELSE d.lang END AS chosen, CASE WHEN quality - toxic < 0 THEN d.source ELSE d.lang END AS rejected FROM documents d JOIN labels l USING (doc_id)")
def b8_signed_preference(spark, d):
    """Chosen and rejected by a signed preference; a tie gives the first for both."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    chosen, rejected = messages.by_preference(F.col("quality") - F.col("toxic"), F.col("lang"), F.col("source"))
    return rows.select("doc_id", chosen.alias("chosen"), rejected.alias("rejected"))


@query("SELECT doc_id, concat('user:', lang) AS context, concat('0:', source, '|1:', lang) AS completions, 'pairs' AS task_name FROM documents")
def b9_binary_preference(spark, d):
    rows = table(spark, d, "documents").select("doc_id", *messages.preference(messages.wrap_context(F.col("lang")), F.col("source"), F.col("lang"), "pairs"))
    text = F.array_join(F.transform("completions", lambda c: F.concat(c["rank"].cast("string"), F.lit(":"), c["completion"][0]["content"])), "|")
    return rows.select("doc_id", F.concat(F.col("context")[0]["role"], F.lit(":"), F.col("context")[0]["content"]).alias("context"), text.alias("completions"), "task_name")


@query(f"WITH {CHATS} SELECT conv_id, len(texts) - 1 AS n_context, md5(array_to_string(texts[1:len(texts) - 1], '|')) AS context, md5(texts[-1]) AS last FROM chats")
def b10_split_last_turn(spark, d):
    rows = chats(spark, d)
    context, last = messages.split_last(F.col("messages"))
    return rows.select("conv_id", F.size(context).cast("long").alias("n_context"), F.md5(F.array_join(messages.contents(context), "|")).alias("context"), F.md5(last["content"]).alias("last"))


#: Four options from the whole text: its quarters.
QUARTERS = "{0}(substr(text, 1, q), substr(text, q + 1, q), substr(text, 2 * q + 1, q), substr(text, 3 * q + 1))"
OPTIONS = f"options AS (SELECT item_id, {QUARTERS.format('list_value')} AS o FROM (SELECT *, length(text) // 4 AS q FROM benchmark))"


def options(spark, d):
    return table(spark, d, "benchmark").withColumn("q", F.floor(F.length("text") / 4).cast("int")).select("item_id", F.expr(QUARTERS.format("array")).alias("o"))



@query(f"WITH {OPTIONS} SELECT item_id, concat('A=', o[1], ';B=', o[2], ';C=', o[3], ';D=', o[4]) AS choices FROM options")
def b14_lettered_options(spark, d):
    """Options as a map from letters."""
    o = options(spark, d)
    pairs = F.transform(F.array_sort(F.map_entries(messages.multiple_choice(F.col("o")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return o.select("item_id", F.array_join(pairs, ";").alias("choices"))


@query(
    f"""WITH {OPTIONS}, dealt AS (
 SELECT item_id, o[1] AS correct, list_transform(list_sort(list_transform(range(0, 4), lambda i: concat(md5(concat_ws('|', '7', item_id::VARCHAR, i::VARCHAR)), '/', o[i + 1]))), lambda s: s[34:]) AS choices FROM options)
SELECT item_id, array_to_string(choices, ';') AS choices, chr((64 + list_position(choices, correct))::INT) AS answer FROM dealt"""
)
def b15_shuffled_choices(spark, d):
    """Choices in hash order and the letter of the correct one."""
    o = options(spark, d)
    dealt, letter = messages.shuffled_choices(F.col("o")[0], [F.col("o")[k] for k in (1, 2, 3)], F.col("item_id"), 7)
    return o.select("item_id", F.array_join(dealt, ";").alias("choices"), letter.alias("answer"))


@query("SELECT conv_id, turn, md5(trim(replace(concat(text, ' <image>'), '<image>', ''), ' ' || chr(9) || chr(10) || chr(13))) AS text_part, 'image,text' AS parts FROM conversations WHERE role = 'user'")
def b16_image_parts(spark, d):
    """Visual question parts with the image mark taken out."""
    parts = messages.image_parts(F.concat("text", F.lit(" <image>")), F.lit("data:image/png;base64,AA=="))
    rows = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", parts.alias("p"))
    return rows.select("conv_id", "turn", F.md5(F.col("p")[1]["text"]).alias("text_part"), F.array_join(F.transform("p", lambda x: x["type"]), ",").alias("parts"))


@query(
    """SELECT doc_id, CASE WHEN length(source) > length(lang) THEN source ELSE lang END AS caption, concat(lang, ' or ', source) AS joined,
 concat_ws(',', CAST(round_even(n_chars % 100 / 640.0 * 1000, 0) AS INT), CAST(round_even(n_chars % 70 / 480.0 * 1000, 0) AS INT), CAST(round_even(n_chars % 300 / 640.0 * 1000, 0) AS INT), CAST(round_even(n_chars % 200 / 480.0 * 1000, 0) AS INT)) AS box FROM documents"""
)
def b17_captions_and_boxes(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("c"), F.array(*(F.col("n_chars") % k for k in (100, 70, 300, 200))).alias("b"))
    box = messages.scaled_box(F.col("b"), F.lit(640), F.lit(480))
    return rows.select("doc_id", messages.caption(F.col("c"), "descriptive").alias("caption"), messages.caption(F.col("c"), "all").alias("joined"), F.array_join(F.transform(box, lambda x: x.cast("string")), ",").alias("box"))


@query(f"WITH {CHATS} SELECT conv_id, len(texts) - 1 AS n_question, md5(trim(texts[-1], ' ' || chr(9) || chr(10) || chr(13))) AS truth FROM chats WHERE len(texts) > 1 AND trim(texts[-1], ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def b18_question_answer(spark, d):
    """Conversations as question and ground truth, text answers."""
    question, truth = trees.text_question_answer(F.col("messages"))
    rows = chats(spark, d).select("conv_id", question.alias("q"), truth.alias("t")).filter("q is not null and t is not null")
    return rows.select("conv_id", F.size("q").cast("long").alias("n_question"), F.md5("t").alias("truth"))


@query("SELECT doc_id, lang, 'train-v1' AS dataset FROM documents")
def b19_stamp(spark, d):
    from ..operators.sets import stamp

    return stamp(table(spark, d, "documents").select("doc_id", "lang"), "train-v1")


@query("SELECT conv_id, count(*) AS n_user, md5(string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '|' ORDER BY turn)) AS digest FROM conversations WHERE trim(role) = 'user' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY conv_id")
def b20_user_turns(spark, d):
    rows = chats(spark, d).select("conv_id", messages.user_turns(F.col("messages")).alias("m")).filter(F.size("m") > 0)
    return rows.select("conv_id", F.size("m").cast("long").alias("n_user"), F.md5(F.array_join(messages.contents(F.col("m")), "|")).alias("digest"))


@query(f"WITH {CHATS} SELECT c.conv_id, md5(coalesce(a.t, '')) AS assistant, md5(texts[-1]) AS last FROM chats c LEFT JOIN (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id) a ON a.conv_id = c.conv_id")
def b21_assistant_text(spark, d):
    """Assistant contents joined, and the last message."""
    return chats(spark, d).select("conv_id", F.md5(messages.assistant_text(F.col("messages"))).alias("assistant"), F.md5(messages.last_content(F.col("messages"))).alias("last"))


@query(
    """SELECT conv_id, md5(concat('<s>', string_agg(concat('<|start_header_id|>', role, '<|end_header_id|>', chr(10), chr(10), trim(text, ' ' || chr(9) || chr(10) || chr(13)), '<|eot_id|>'), '' ORDER BY turn), '<|start_header_id|>assistant<|end_header_id|>', chr(10), chr(10))) AS rendered,
 md5(string_agg(text, '' ORDER BY turn)) AS plain FROM conversations GROUP BY conv_id"""
)
def b25_chat_template(spark, d):
    m = F.col("messages")
    return chats(spark, d).select("conv_id", F.md5(messages.render_headers(m, bos="<s>", generation_prompt=True)).alias("rendered"), F.md5(messages.render_passthrough(m)).alias("plain"))


@query("SELECT conv_id, sum(len(list_filter(string_split(text, ' '), lambda x: x <> '')))::BIGINT AS length, max(turn) + 1 AS turns FROM conversations GROUP BY conv_id")
def b29_encode_turns(spark, d):
    """Word tokens of all turns in one sequence and their number."""
    ids = lambda m: F.filter(F.split(m["content"], " "), lambda w: w != "")
    rows = chats(spark, d).select("conv_id", F.flatten(F.transform("messages", ids)).alias("ids"), F.size("messages").cast("long").alias("turns"))
    return rows.select("conv_id", F.size("ids").cast("long").alias("length"), "turns")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('/data/', doc_id, '.jpg') END AS path FROM documents")
def b30_image_paths(spark, d):
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("coco/"), "doc_id", F.lit(".jpg"))).otherwise(F.concat(F.lit("x/"), "doc_id"))
    return table(spark, d, "documents").select("doc_id", messages.image_path(path, "/data/").alias("path"))


JSON_LINE = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat('[', props, ']') WHEN 2 THEN substr(props, 2) WHEN 3 THEN concat('  ', props, ' ') WHEN 4 THEN concat('{"a": {"b": [', props, ', null, 1.5]}}') ELSE event_type END"""


@query(f"WITH l AS (SELECT event_id, {JSON_LINE} AS line FROM events) SELECT event_id FROM l WHERE CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END")
def c1_json_objects(spark, d):
    """Lines that are JSON objects: whole, nested and padded ones, not lists, pieces and words."""
    from ..operators.sets import is_object

    return table(spark, d, "events").select("event_id", F.expr(JSON_LINE).alias("line")).filter(is_object(F.col("line"))).select("event_id")


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 2")
def c2_min_turns(spark, d):
    return chats(spark, d).filter(F.size("messages") > 2).select("conv_id", F.size("messages").cast("long").alias("n"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS length, CASE WHEN sum(length(text)) <= 2000 THEN 1.0 ELSE 0.0 END::DOUBLE AS loss_multiplier FROM conversations GROUP BY conv_id")
def c3_overlong(spark, d):
    """Rows over a length are kept with a loss multiplier of 0."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("length"))
    return rows.withColumn("loss_multiplier", (F.col("length") <= 2000).cast("double"))


AGENT = """CASE doc_id % 6 WHEN 0 THEN ' General_QA_v2 ' WHEN 1 THEN 'general_qa' WHEN 2 THEN 'my general_qa' WHEN 3 THEN 'SWE_pivot_single_step_tool_use_with_argument_comparison-1' WHEN 4 THEN 'single_step_tool_use_with_argument_comparison' ELSE source END"""
ACTION = "CASE doc_id % 4 WHEN 0 THEN 'function_call' WHEN 1 THEN 'message' WHEN 2 THEN 'function_call ' END"


@query(
    f"""WITH t AS (SELECT doc_id, lower(trim({AGENT})) AS agent, {ACTION} AS action, lang = 'en' AS called FROM documents)
SELECT doc_id, coalesce(starts_with(agent, 'general_qa') AND called, false) OR coalesce((starts_with(agent, 'single_step_tool_use_with_argument_comparison') OR starts_with(agent, 'swe_pivot_single_step_tool_use_with_argument_comparison') OR starts_with(agent, 'toolcall_schema_single_step_tool_use_with_argument_comparison')) AND action = 'function_call', false) AS expects FROM t"""
)
def c10_tool_call_expected(spark, d):
    """Rows as agent JSON; rules by agent prefix and field."""
    row = F.struct(F.struct(F.expr(AGENT).alias("name")).alias("agent_ref"), F.struct(F.expr(ACTION).alias("type")).alias("expected_action"), (F.col("lang") == "en").alias("answer_is_tool_call"))
    return table(spark, d, "documents").select("doc_id", F.to_json(row).alias("row")).select("doc_id", expects_tool_call(F.col("row")).alias("expects"))


MARKED = """concat(substr(text, 1, 50 + CAST(doc_id % 40 AS INT)), CASE doc_id % 7 WHEN 0 THEN '<tool_call>' WHEN 1 THEN '</tool_call>' WHEN 2 THEN '<function_call>' WHEN 3 THEN '</function_call' WHEN 4 THEN '< tool_call>' WHEN 5 THEN '</function_call>' ELSE '' END, text)"""


@query(f"WITH t AS (SELECT doc_id, {MARKED} AS t FROM documents) SELECT doc_id, contains(t, '<tool_call>') OR contains(t, '</tool_call>') OR contains(t, '<function_call>') OR contains(t, '</function_call>') AS invalid FROM t")
def c12_invalid_tool_call(spark, d):
    """Marks of a tool call within whole texts, and what only looks like one."""
    return table(spark, d, "documents").select("doc_id", has_invalid_tool_call(F.expr(MARKED)).alias("invalid"))


@query(
    """WITH t AS (SELECT doc_id, n_chars % 8 + 1 AS n, list_transform(range(0, 9), lambda i: CASE WHEN doc_id % 3 = 0 AND i = doc_id % 9 THEN 3 WHEN i < n_chars % 8 + 1 THEN 5 ELSE 0 END) AS ids, [doc_id % 3, n_chars % 3] AS starts FROM documents)
SELECT doc_id, n <= 9 AND len(list_filter(ids[n + 1:9], lambda x: x <> 0)) = 0 AS ok, len(list_filter(starts, lambda x: x = 1)) = 2 AS double_start FROM t"""
)
def c14_padding_checks(spark, d):
    """Right padding and doubled start ids (C14, C15): a third of the rows have another id somewhere."""
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 8 + 1).cast("int").alias("n"), F.array(F.col("doc_id") % 3, F.col("n_chars") % 3).alias("starts"))
    ids = packing.padded(F.array_repeat(F.lit(5), F.col("n")), F.lit(9))
    odd = F.transform(ids, lambda x, i: F.when((F.col("doc_id") % 3 == 0) & (i == F.col("doc_id") % 9), 3).otherwise(x))
    return rows.select("doc_id", packing.well_padded(odd, F.col("n"), 0).alias("ok"), packing.double_bos(F.col("starts"), 1).alias("double_start"))


JACCARD = f"""WITH {CHATS}, pairs AS (
 SELECT c.conv_id, coalesce((SELECT string_agg(text, '' ORDER BY turn) FROM conversations x WHERE x.conv_id = c.conv_id AND role = 'assistant'), '') AS response,
  coalesce((SELECT arg_max(text, turn) FROM conversations x WHERE x.conv_id = c.conv_id AND role = 'user'), '') AS truth FROM chats c
), clean AS (
 SELECT conv_id, regexp_replace(lower(response), '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(lower(truth), '^\\s+|\\s+$', '', 'g') AS b FROM pairs
), sets AS (
 SELECT conv_id, a, b, list_distinct(list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '')) AS wa, list_distinct(list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '')) AS wb FROM clean
), scored AS (
 SELECT conv_id, CASE WHEN a = b THEN 1.0 WHEN b = '' THEN 0.0 WHEN len(list_distinct(wa || wb)) = 0 THEN 0.0
  ELSE len(list_intersect(wa, wb))::DOUBLE / len(list_distinct(wa || wb)) * least(length(a), length(b)) / greatest(length(a), length(b), 1) END::DOUBLE AS score FROM sets
)"""


def jaccard_scores(spark, d):
    """``conv_id`` and the word overlap of its assistant text with the last user turn; one shuffle, on the conversation."""
    m = F.col("messages")
    user = messages.contents(m, "user")
    truth = F.coalesce(F.try_element_at(user, F.lit(-1)), F.lit(""))
    return chats(spark, d).select("conv_id", rewards.word_jaccard(messages.assistant_text(m), truth).alias("score"))


@query(JACCARD + " SELECT conv_id, round(score, 6) AS score, concat(CASE WHEN score > 0.5 THEN 'aligned' ELSE 'misaligned' END, printf(' (%.2f)', score)) AS label FROM scored")
def h14_word_jaccard(spark, d):
    return jaccard_scores(spark, d).select("conv_id", sql_r6("score").alias("score"), rewards.alignment_label(F.col("score")).alias("label"))


@query(JACCARD + " SELECT round(avg((score > 0.5)::INT), 6) AS alignment_rate, round(avg(score), 6) AS mean_score, round(avg((score > 0.8)::INT), 6) AS high_rate FROM scored")
def e5_jaccard_metrics(spark, d):
    s = jaccard_scores(spark, d)
    rate = lambda t: r6(F.avg((F.col("score") > t).cast("int")))
    return s.agg(rate(0.5).alias("alignment_rate"), r6(F.avg("score")).alias("mean_score"), rate(0.8).alias("high_rate"))


@query(f"WITH {RESPONSES} SELECT doc_id, nullif(regexp_extract(response, '<answer>([\\s\\S]*)</answer>', 1), '') AS greedy, CASE WHEN regexp_matches(response, '<answer>(.*?)</answer>') THEN trim(regexp_extract(response, '<answer>(.*?)</answer>', 1)) ELSE trim(response) END AS lazy FROM responses")
def h1_tag_extraction(spark, d):
    """Greedy and lazy tag extraction (H1, H2)."""
    r = F.col("response")
    return responses(spark, d).select("doc_id", answers.tagged(r, "answer").alias("greedy"), answers.answer_or_all(r).alias("lazy"))


@query(
    f"""WITH {RESPONSES}, s AS (SELECT doc_id, lang, response, regexp_matches(response, '<think>[\\s\\S]*</think>') AS t, regexp_matches(response, '<answer>[\\s\\S]*</answer>') AS a, regexp_extract(response, '<answer>([\\s\\S]*)</answer>', 1) AS x FROM responses)
SELECT doc_id, (CASE WHEN t THEN 0.25 ELSE 0 END + CASE WHEN a THEN 0.75 ELSE 0 END)::DOUBLE AS format, (CASE WHEN a AND lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')) = lang THEN 1 ELSE 0 END)::DOUBLE AS exact,
 round(0.3 * (CASE WHEN t THEN 0.25 ELSE 0 END + CASE WHEN a THEN 0.75 ELSE 0 END) + 0.7 * CASE WHEN a AND lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')) = lang THEN 1 ELSE 0 END, 6)::DOUBLE AS combined,
 a AND lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')) = lang AS correct FROM s"""
)
def h3_format_and_exact_rewards(spark, d):
    """Format, exact alphanumeric and combined rewards (H3, H4, H7)."""
    truth, r = F.col("lang"), F.col("response")
    score, ok = rewards.combined([{"name": "format", "weight": 0.3}, {"name": "exact_alnum", "weight": 0.7}])(truth, r)
    return responses(spark, d).select("doc_id", rewards.format_reward(truth, r)[0].alias("format"), rewards.exact_alnum(truth, r)[0].alias("exact"), r6(score).alias("combined"), ok.alias("correct"))


@query(
    """WITH b AS (SELECT doc_id, doc_id % 50 / 100.0 AS x1, n_chars % 40 / 100.0 AS y1, doc_id % 50 / 100.0 + 0.3 AS x2, n_chars % 40 / 100.0 + 0.4 AS y2, doc_id % 9 = 0 AS bad FROM documents
), o AS (SELECT *, greatest(0, least(x2, 0.7) - greatest(x1, 0.2)) * greatest(0, least(y2, 0.6) - greatest(y1, 0.1)) AS i FROM b
), u AS (SELECT *, greatest(0.001, 0.5 * 0.5 + (x2 - x1) * (y2 - y1) - i) AS u, greatest(0.001, (greatest(x2, 0.7) - least(x1, 0.2)) * (greatest(y2, 0.6) - least(y1, 0.1))) AS c FROM o
) SELECT doc_id, CASE WHEN bad THEN 0.0 ELSE round(i / u - (c - u) / c, 6) END::DOUBLE AS giou, NOT bad AND i / u - (c - u) / c > 0.5 AS correct FROM u"""
)
def h6_bbox_giou(spark, d):
    rows = table(spark, d, "documents")
    x, y = F.col("doc_id") % 50 / 100.0, F.col("n_chars") % 40 / 100.0
    box = F.concat(F.lit("<answer>["), F.concat_ws(", ", x, y, x + 0.3, y + 0.4), F.lit("]</answer>"))
    response = F.when(F.col("doc_id") % 9 == 0, F.lit("<answer>[1, 2, 3]</answer>")).otherwise(box)
    score, ok = rewards.bbox_giou(F.lit("[0.2, 0.1, 0.7, 0.6]"), response)
    return rows.select("doc_id", r6(score).alias("giou"), ok.alias("correct"))


MATH = """CASE doc_id % 6 WHEN 0 THEN concat('So x = ', n_chars, ',000 dollars') WHEN 1 THEN concat('\\frac12 + ', n_chars) WHEN 2 THEN concat('\\text{', lang, '}') WHEN 3 THEN concat('$', n_chars, '$ cm') WHEN 4 THEN concat('\\boxed{', n_chars, '}') ELSE concat('a ', source, ' \\sqrt3') END"""


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat(n_chars, '000') WHEN 1 THEN concat('\\frac{1}{2}+', n_chars) WHEN 2 THEN lang WHEN 3 THEN concat(n_chars, '') WHEN 4 THEN concat(n_chars, '') ELSE concat(source, '\\sqrt{3}') END AS answer FROM documents"""
)
def h10_normal_answer(spark, d):
    """Answers of six shapes in normal form; the SQL states the wanted forms."""
    return table(spark, d, "documents").select("doc_id", answers.normal_answer(F.expr(MATH.replace("\\", "\\\\"))).alias("answer"))


@query(
    """SELECT doc_id, (doc_id % 3 = 0)::INT::DOUBLE AS score, doc_id % 3 = 0 AS acc, CASE doc_id % 3 WHEN 0 THEN concat(n_chars, '') WHEN 1 THEN concat(n_chars + 1, '') ELSE '[INVALID]' END AS pred FROM documents"""
)
def h13_math_score(spark, d):
    """Score by the last answer line of the last 300 characters."""
    solution = F.expr("CASE doc_id % 3 WHEN 0 THEN concat(text, '\n Answer: 5\nanswer : $', n_chars, '$') WHEN 1 THEN concat('Answer: ', n_chars + 1) ELSE concat('Answer: 3\n', repeat('x', 300)) END")
    s = answers.math_score(solution, F.col("n_chars").cast("string"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.score", "s.acc", "s.pred")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('\\boxed{a{', lang, '}}') END AS boxed, CASE WHEN doc_id % 2 = 0 THEN concat('a{', lang, '}') END AS inside, CASE WHEN doc_id % 2 = 0 AND lang = 'en' THEN 1 ELSE -1 END AS strict FROM documents")
def h8_boxed(spark, d):
    """Last boxed expression with balanced braces, its inside, and the strict check."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\\boxed{1} so \\boxed{a{"), "lang", F.lit("}} }"))).otherwise(F.lit("\\boxed{open {x"))
    rows = table(spark, d, "documents").select("doc_id", "lang", text.alias("t"))
    boxed = answers.last_boxed(F.col("t"))
    return rows.select("doc_id", boxed.alias("boxed"), answers.unboxed(boxed).alias("inside"), answers.strict_box(F.col("t"), F.lit("a{en}"))[0].alias("strict"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'A' END AS letter, concat('1', lang) AS plain FROM documents")
def h16_choice_letters(spark, d):
    """Multiple-choice letters in several languages, and responses without marks."""
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(lang, ' **Answer: B**') WHEN 1 THEN '答案：Ｃ' WHEN 2 THEN concat('Réponse : ', '$\\\\boxed{', 'A}$') ELSE 'no idea' END")
    plain = F.concat(F.lit("**1**$"), "lang", F.lit("\\boxed{"))
    return table(spark, d, "documents").select("doc_id", answers.choice_letter(text).alias("letter"), answers.normal_response(plain).alias("plain"))


TOOL_TEXT = """CASE doc_id % 5 WHEN 0 THEN concat('a <retrieve>', text, '</retrieve> b</retrieve> c') WHEN 1 THEN concat(lang, '<code>', text, '</code>', source) WHEN 2 THEN text WHEN 3 THEN concat('</code>', source, '<code>x</code>', chr(10), text) ELSE concat('<retrieve>', source, '</retrieve><code></code>') END"""


@query(
    f"""WITH t AS (SELECT *, {TOOL_TEXT} AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '<retrieve>.*</retrieve>', 's') THEN md5(regexp_extract(t, '<retrieve>(.*)</retrieve>', 1, 's')) END AS query, CASE WHEN regexp_matches(t, '<code>.*</code>', 's') THEN md5(regexp_extract(t, '<code>(.*)</code>', 1, 's')) END AS code, CASE WHEN regexp_matches(t, '<code>.*</code>', 's') THEN md5(split_part(t, '</code>', -1)) END AS rest,
 md5(concat('<result>', chr(10), '<1>', chr(10), lang, chr(10), '</1>', chr(10), '<2>', chr(10), text, chr(10), '</2>', chr(10), '</result>', chr(10))) AS result FROM t"""
)
def h25_tool_texts(spark, d):
    """Retrieval queries, code blocks and result messages in whole texts."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "text", F.expr(TOOL_TEXT).alias("t"))
    code, rest = retrieval.code_block(F.col("t"))
    return rows.select("doc_id", F.md5(retrieval.retrieve_query(F.col("t"))).alias("query"), F.md5(code).alias("code"), F.md5(rest).alias("rest"), F.md5(retrieval.result_text(F.array("lang", "text"))).alias("result"))


THINKING = """CASE doc_id % 5 WHEN 0 THEN concat(text, '</think>', source) WHEN 1 THEN concat('<think>', text, '</think>', text) WHEN 2 THEN text WHEN 3 THEN concat(lang, '<think>', text, '</think>') ELSE concat(text, '</think>', lang, '</think>x') END"""


@query(
    f"""WITH b AS (SELECT doc_id, regexp_replace({THINKING}, '^[\\s\\S]*?<think>', '') AS b FROM documents), s AS (SELECT doc_id, CASE WHEN contains(b, '</think>') THEN split_part(b, '</think>', 1) ELSE b END AS r, CASE WHEN contains(b, '</think>') THEN nullif(substr(b, strpos(b, '</think>') + 8), '') END AS c FROM b)
SELECT doc_id, md5(r) AS reasoning, md5(coalesce(c, '')) AS final, md5(coalesce(c, r)) AS final_off FROM s"""
)
def h31_reasoning_split(spark, d):
    """Reasoning and content of whole texts with and without tags."""
    reasoning, final = answers.reasoning_split(F.col("t"))
    rows = table(spark, d, "documents").select("doc_id", F.expr(THINKING).alias("t"))
    return rows.select("doc_id", F.md5(reasoning).alias("reasoning"), F.md5(final).alias("final"), F.md5(answers.reasoning_split(F.col("t"), thinking=False)[1]).alias("final_off"))


CODE, RESULT = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN source END", "CASE WHEN doc_id % 4 < 2 THEN lang WHEN doc_id % 4 = 2 THEN text END"


@query(
    f"""WITH t AS (SELECT doc_id, {CODE} AS c, {RESULT} AS r FROM documents)
SELECT doc_id, md5(CASE WHEN r IS NULL THEN '' WHEN coalesce(contains(c, chr(10)), false) OR contains(r, chr(10)) THEN concat(chr(10), chr(10), '<result>', chr(10), r, chr(10), '</result>') ELSE concat('<result>', r, '</result>') END) AS shown FROM t"""
)
def h35_code_results(spark, d):
    """Code results as they are shown, code and results being whole texts, short ones or missing."""
    return table(spark, d, "documents").select("doc_id", F.md5(retrieval.code_result(F.expr(CODE), F.expr(RESULT))).alias("shown"))


@query("SELECT doc_id, coalesce(try_cast(regexp_extract(source, '[0-9]+') AS DOUBLE), 0.0) AS score, CASE WHEN n_chars % 2 <> 0 THEN 'correct' ELSE 'incorrect' END AS label, CAST(ceil(n_chars / 64.0) * 64 AS BIGINT) AS rounded FROM documents")
def h36_safe_scores(spark, d):
    """Scores that can't be computed become 0; reward labels; lengths rounded up."""
    score = rewards.safe(F.regexp_extract("source", "[0-9]+", 0).try_cast("double"))
    label = F.when(F.col("n_chars") % 2 != 0, "correct").otherwise("incorrect")
    return table(spark, d, "documents").select("doc_id", score.alias("score"), label.alias("label"), packing.round_up(F.col("n_chars"), 64).alias("rounded"))


@query("SELECT doc_id, round((least(greatest(n_chars / 1000.0, 0.5), 2.0) - 0.5) / 1.5 * 3 - 1, 6)::DOUBLE AS scaled FROM documents")
def h20_scaled_reward(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(rewards.scaled_reward(F.col("n_chars") / 1000.0, (0.5, 2.0), (-1.0, 2.0))).alias("scaled"))


@query(
    """WITH w AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS t FROM documents
), g AS (SELECT doc_id, len(t) AS n, array_to_string(t[i:i + 1], ' ') AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM w)
), c AS (SELECT doc_id, any_value(n) AS n, gram, count(*) AS c FROM g GROUP BY doc_id, gram
), s AS (SELECT doc_id, any_value(n) AS n, max(c) AS top, count(*) FILTER (WHERE c > 3) AS over FROM c GROUP BY doc_id
) SELECT w.doc_id, round(CASE WHEN coalesce(over, 0) = 0 THEN 0.0 ELSE least(greatest(over / (n - 1.0), top / (n / 2.0)), 1.0) END, 6)::DOUBLE AS severity FROM w LEFT JOIN s ON s.doc_id = w.doc_id"""
)
def h18_ngram_repetition(spark, d):
    """Repetition severity of word pairs."""
    tokens = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", tokens.alias("t"))
    return rows.select("doc_id", r6(rewards.ngram_severity(F.col("t"), 2, 3)).alias("severity"))
