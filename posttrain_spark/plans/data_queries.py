"""Queries over sets, samples, groups, packing, retrieval, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import losses
from ..operators import groups, metrics, packing, retrieval, sampling, sets
from ..streaming import replay
from .base import CHATS, ROLLOUTS, SERIES, chats, query, r6, rollouts, series, table

LINES = "lines AS (SELECT doc_id, concat('{\"text\":\"', md5(text), '\",\"lang\":\"', lang, '\"}') AS key FROM documents)"


def doc_lines(spark, d):
    """Documents as JSON lines with keys in two orders and a ``dataset`` stamp, which the key leaves out."""
    text, lang = F.md5("text").alias("text"), F.col("lang")
    a = F.to_json(F.struct(text, lang, F.lit("s1").alias("dataset")))
    b = F.to_json(F.struct(lang, text))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, a).otherwise(b).alias("line"))


@query(f"WITH {LINES} SELECT min(doc_id) AS doc_id FROM lines WHERE key NOT IN (SELECT key FROM lines WHERE doc_id % 10 = 0) GROUP BY key")
def g1_set_minus(spark, d):
    """Lines of A that aren't in B by canonical JSON, the first of each."""
    a = doc_lines(spark, d).withColumn("key", sets.without_field(F.col("line"), "dataset"))
    return sets.set_minus(a, a.filter("doc_id % 10 = 0"), "key", ["doc_id"]).select("doc_id")


@query(f"WITH {LINES} SELECT min(doc_id) AS doc_id FROM lines GROUP BY key")
def g2_self_dedup(spark, d):
    a = sets.exact_keyed(doc_lines(spark, d))
    return sets.first_occurrence(a, ["key"], ["doc_id"]).select("doc_id")


@query(
    f"""WITH {LINES}, b AS (SELECT DISTINCT key FROM lines WHERE doc_id % 10 = 0), v AS (SELECT doc_id, key, key IN (SELECT key FROM b) AS ex, doc_id % 7 = 0 AS bad FROM lines)
SELECT count(DISTINCT key) FILTER (WHERE NOT bad AND NOT ex) AS kept, count(*) FILTER (WHERE NOT bad AND ex) AS excluded, count(*) FILTER (WHERE NOT bad AND NOT ex) - count(DISTINCT key) FILTER (WHERE NOT bad AND NOT ex) AS duplicates, count(*) FILTER (WHERE bad) AS invalid FROM v"""
)
def e21_set_minus_statistics(spark, d):
    a = doc_lines(spark, d).withColumn("key", sets.without_field(F.col("line"), "dataset"))
    return sets.set_minus_statistics(a.withColumn("key", F.when(F.col("doc_id") % 7 != 0, F.col("key"))), a.filter("doc_id % 10 = 0"), "key")


@query("SELECT item_id AS id, text, 'benchmark' AS origin FROM benchmark UNION ALL SELECT doc_id, source, 'documents' FROM documents")
def g4_union_all(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("origin"))
    b = table(spark, d, "documents").select(F.col("source").alias("text"), F.col("doc_id").alias("id"), F.lit("documents").alias("origin"))
    return sets.union_all(a, b)


@query("SELECT item_id, r::INT AS copy FROM benchmark, range(0, 3) t(r)")
def g5_repeat(spark, d):
    """Every row three times, in place."""
    return sets.repeat(table(spark, d, "benchmark").select("item_id"), 3, "copy")


@query("SELECT doc_id FROM documents ORDER BY md5(concat('67|', doc_id)), doc_id LIMIT 50")
def g7_sample(spark, d):
    """A fixed-size sample in hash order (G7, F10); the limit is the operator."""
    return sampling.sample(table(spark, d, "documents").select("doc_id"), 50, 67, "doc_id")


@query(
    """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('5|', doc_id)), doc_id) AS r FROM documents)
WHERE source = 'src1' AND r <= 10 OR source = 'src2' AND r <= 3 OR source = 'src3'"""
)
def g8_quota_sample(spark, d):
    """Per-source quotas, all for one, the rest dropped."""
    return sampling.quota_sample(table(spark, d, "documents").select("doc_id", "source"), {"src1": 10, "src2": 3, "src3": None}, "source", "doc_id", 5)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('42|', doc_id)), doc_id) <= ceil(count(*) OVER () * 0.05) THEN 'validation' ELSE 'train' END AS split FROM documents")
def g9_split(spark, d):
    return sampling.split(table(spark, d, "documents").select("doc_id"), 0.05, 42, "doc_id")


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents) WHERE split = 'train' GROUP BY split")
def g10_select_split(spark, d):
    rows = table(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train"))
    return rows.filter("split = 'train'").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT lang, source FROM documents")
def g11_unique_rows(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // (SELECT ceil(count(*) / 7.0)::BIGINT FROM documents) AS chunk FROM documents")
def g12_worker_chunks(spark, d):
    return sampling.chunks(table(spark, d, "documents").select("doc_id"), 7, ["doc_id"]).select("doc_id", "chunk")


@query()
def g13_conversation_hash(spark, d):
    """BLAKE2b of conversations; no SQL function for it."""
    return sets.with_conversation_hash(chats(spark, d), "messages").select("conv_id", "hash")


@query(
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('24|', doc_id)), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, i // 32 + 1 AS batch FROM o WHERE i // 32 + 1 <= n // 32 AND i // 32 + 1 > 6"""
)
def g15_resumed_batches(spark, d):
    """Shuffled batches of 32 after a resume at batch 6."""
    return sampling.batches(table(spark, d, "documents").select("doc_id"), 32, 24, "doc_id", resume_after=6).select("doc_id", "batch")


@query(f"WITH {ROLLOUTS}, v AS (SELECT prompt FROM rollouts GROUP BY prompt HAVING max(reward) > min(reward)), k AS (SELECT prompt FROM v ORDER BY md5(concat('3|', prompt)), prompt LIMIT 40) SELECT event_id, prompt FROM rollouts WHERE prompt IN (SELECT prompt FROM k)")
def g16_dynamic_sampling(spark, d):
    """Prompts of varied reward until the batch is full."""
    kept = groups.varied_groups(rollouts(spark, d), "prompt", "reward")
    return sampling.first_groups(kept, "prompt", 40, 3).select("event_id", "prompt")


@query("SELECT doc_id, l.quality, coalesce(l.quality, -1) AS filled FROM documents d JOIN labels l USING (doc_id)")
def d2_lookup(spark, d):
    """Lookup join; a missing key is an error, so only labelled rows ask."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    rows = table(spark, d, "documents").select("doc_id").join(labels.select("doc_id"), "doc_id", "left_semi")
    return sets.lookup(rows, labels, "doc_id").withColumn("filled", F.coalesce("quality", F.lit(-1)))


@query("SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) AS start, coalesce(b.n, 0) AS end FROM (SELECT event_type, count(*) n FROM events WHERE event_id % 2 = 0 AND event_type <> 'view' GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) n FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' GROUP BY 1) b ON a.event_type = b.event_type")
def d7_merge_counters(spark, d):
    e = table(spark, d, "events")
    count = lambda x: x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return sets.merge_counters(count(e.filter("event_id % 2 = 0 AND event_type <> 'view'")), count(e.filter("event_id % 2 = 1 AND event_type <> 'error'")), "event_type", "n")


@query(f"WITH {ROLLOUTS} SELECT round(avg(ok), 6) AS pass_rate, count(*) AS prompts FROM (SELECT max(correct) AS ok FROM rollouts GROUP BY prompt)")
def e1_pass_rate(spark, d):
    out = groups.pass_rate(rollouts(spark, d), "prompt", F.col("correct"))
    return out.select(r6("pass_rate").alias("pass_rate"), "prompts")


@query(f"WITH {ROLLOUTS}, g AS (SELECT prompt, count(*) AS n, sum(correct)::BIGINT AS c FROM rollouts GROUP BY prompt) SELECT prompt, n, c, round(CASE WHEN n - c < 3 THEN 1.0 ELSE 1 - ((n - c) / n::DOUBLE) * ((n - c - 1) / (n - 1)::DOUBLE) * ((n - c - 2) / (n - 2)::DOUBLE) END, 6)::DOUBLE AS pass_at_k FROM g")
def e2_pass_at_k(spark, d):
    out = groups.group_pass_at_k(rollouts(spark, d), "prompt", F.col("correct"), 3)
    return out.withColumn("pass_at_k", r6("pass_at_k"))


@query(
    f"""WITH {ROLLOUTS}, r AS (SELECT prompt, event_type AS a, correct::DOUBLE AS w, row_number() OVER (PARTITION BY prompt ORDER BY event_id) AS i FROM rollouts
), t AS (SELECT x.prompt, CASE WHEN y.a = z.a AND x.a <> y.a THEN y.w ELSE x.w END AS w FROM r x JOIN r y ON x.prompt = y.prompt AND x.i < y.i JOIN r z ON y.prompt = z.prompt AND y.i < z.i)
SELECT p.prompt, round(coalesce(any_value(s.m), 0), 6) AS cons_at_k FROM (SELECT DISTINCT prompt FROM r) p LEFT JOIN (SELECT prompt, avg(w) AS m FROM t GROUP BY prompt) s ON s.prompt = p.prompt GROUP BY p.prompt"""
)
def e3_cons_at_k(spark, d):
    """Majority vote over all subsets of three of each prompt's rollouts; the SQL lists the subsets."""
    rows = rollouts(spark, d).withColumn("right", F.col("correct").cast("double"))
    return groups.cons_at_k(rows, "prompt", "event_id", "event_type", "right", 3).withColumn("cons_at_k", r6("cons_at_k"))


@query(
    f"""WITH {ROLLOUTS}, b AS (SELECT *, (reward >= 7)::INT * (event_id % 5 <> 0)::INT AS r, event_id % 5 <> 0 AS is_end FROM rollouts)
SELECT round(avg(r), 6) AS accuracy, (SELECT round(avg(x), 6) FROM (SELECT max(r) AS x FROM b GROUP BY prompt)) AS pass_at_samples, round(avg(is_end::INT), 6) AS fraction_ended, count(*) AS n, round(avg(event_id % 100), 6) AS generation_lengths, round(coalesce(avg(event_id % 100 - prompt % 10) FILTER (WHERE r = 1), 0), 6) AS correct_lengths FROM b"""
)
def e4_batch_metrics(spark, d):
    """Accuracy, pass rate, ended share and lengths of a rollout batch; unended rollouts score 0."""
    ended = F.col("event_id") % 5 != 0
    b = rollouts(spark, d).withColumn("r", F.when(ended & (F.col("reward") >= 7), 1).otherwise(0))
    solved = b.groupBy("prompt").agg(F.max("r").alias("x")).agg(r6(F.avg("x")).alias("pass_at_samples"))
    length = F.col("event_id") % 100
    out = b.agg(r6(F.avg("r")).alias("accuracy"), r6(F.avg(ended.cast("int"))).alias("fraction_ended"), F.count(F.lit(1)).alias("n"), r6(F.avg(length)).alias("generation_lengths"), r6(F.coalesce(F.avg(F.when(F.col("r") == 1, length - F.col("prompt") % 10)), F.lit(0.0))).alias("correct_lengths"))
    return out.join(F.broadcast(solved), F.lit(True)).select("accuracy", "pass_at_samples", "fraction_ended", "n", "generation_lengths", "correct_lengths")


@query(
    f"""WITH {ROLLOUTS}, s AS (SELECT *, count(*) OVER w AS n, sum(reward) OVER w AS t, coalesce(stddev_samp(reward) OVER w, 0) AS sd FROM rollouts WINDOW w AS (PARTITION BY prompt))
SELECT event_id, round(CASE WHEN n > 1 THEN (t - reward) / (n - 1) ELSE 0 END, 6)::DOUBLE AS leave_one_out, round(CASE WHEN sd > 0 THEN (reward - t / n) / (sd + 1e-6) ELSE reward - t / n END, 6)::DOUBLE AS advantage FROM s"""
)
def e6_group_advantages(spark, d):
    """Leave-one-out baseline and normalized advantage of each rollout."""
    loo = groups.baselines(rollouts(spark, d), "prompt", "reward", leave_one_out=True).withColumnRenamed("baseline", "loo").drop("std")
    out = groups.group_advantages(loo, "prompt", "reward")
    return out.select("event_id", r6("loo").alias("leave_one_out"), r6("advantage").alias("advantage"))


@query(f"WITH {ROLLOUTS}, c AS (SELECT event_id, reward - avg(reward) OVER (PARTITION BY prompt) AS a FROM rollouts) SELECT event_id, round((a - (SELECT avg(a) FROM c)) / ((SELECT stddev_samp(a) FROM c) + 1e-8), 5)::DOUBLE AS advantage FROM c")
def e7_batch_advantages(spark, d):
    out = groups.batch_advantages(rollouts(spark, d), "prompt", "reward")
    return out.select("event_id", F.round("advantage", 5).alias("advantage"))


@query(
    f"""WITH {ROLLOUTS}, s AS (SELECT *, -reward AS x FROM rollouts), n AS (SELECT *, avg(x) OVER w AS m, coalesce(stddev_samp(x) OVER w, 0) AS sd FROM s WINDOW w AS (PARTITION BY prompt)
), a AS (SELECT *, CASE WHEN sd > 0 THEN (x - m) / (sd + 1e-6) ELSE x - m END AS adv FROM n)
SELECT event_id, round(0.1 * greatest((adv - max(adv) OVER (PARTITION BY prompt)) / 2, -1.5), 6)::DOUBLE AS penalty FROM a"""
)
def e8_group_penalties(spark, d):
    """Severity as a weighted, bounded penalty by prompt group."""
    settings = groups.penalty_settings({"n_gram_repetition": {"enabled": True, "max_advantage_penalty": -1.5}})
    out = groups.apply_penalties(rollouts(spark, d), "prompt", {"n_gram_repetition": "reward"}, settings)
    return out.select("event_id", r6("n_gram_repetition").alias("penalty"))


@query(f"WITH {CHATS} SELECT conv_id, (list_contains(roles, 'assistant') AND conv_id % 3 = 0)::INT::DOUBLE AS flagged, list_sum(list_transform(texts, lambda t: length(t) % 5))::DOUBLE AS repetition FROM chats")
def e9_rollout_severity(spark, d):
    """Flag and repetition severity of conversations."""
    m = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), F.array(F.lit(0.0)).alias("generation_logprobs"), (F.col("conv_id") % 3 == 0).alias("has_malformed_thinking")))
    masks = F.transform("messages", lambda x: F.array(F.lit(0), F.length(x["content"]) % 5))
    return chats(spark, d).select("conv_id", groups.flag_severity(m, "has_malformed_thinking", True).alias("flagged"), groups.repetition_severity(masks).alias("repetition"))


@query(
    """WITH s AS (SELECT doc_id, n_chars AS n, doc_id % 16 AS bin FROM documents), b AS (SELECT bin, count(*) AS k, sum(n) AS load FROM s GROUP BY bin
), t AS (SELECT sum(k) AS ns, count(*) AS nb, sum(load) AS len, stddev_samp(load / 4000000.0) AS sd FROM b)
SELECT ns::BIGINT AS num_sequences, nb AS num_bins, len::BIGINT AS total_sequence_length, nb * 4000000 AS total_bin_capacity, (nb * 4000000 - len)::BIGINT AS total_waste, round(len / (nb * 4000000.0), 6)::DOUBLE AS average_utilization, round(1 - len / (nb * 4000000.0), 6)::DOUBLE AS waste_ratio, round(1 - sd / (len / (nb * 4000000.0)), 6)::DOUBLE AS bin_balance, ceil(len / 4000000.0)::BIGINT AS theoretical_min_bins, round(ceil(len / 4000000.0) / nb, 6)::DOUBLE AS bin_efficiency FROM t"""
)
def e10_packing_statistics(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 16).alias("bin"), F.col("n_chars").alias("length"))
    s = packing.packing_statistics(rows, 4_000_000)
    return s.select(*(r6(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in s.dtypes))


@query(
    """WITH s AS (SELECT doc_id % 4 AS g, doc_id % 16 AS bin, n_chars AS n FROM documents), b AS (SELECT g, bin, sum(n) AS load, count(*) AS k FROM s GROUP BY g, bin), t AS (SELECT g, sum(k) AS ns, count(*) AS nb, sum(load) AS len FROM b GROUP BY g)
SELECT sum(ns)::BIGINT AS total_sequences, sum(nb)::BIGINT AS total_bins, round(sum(len) / (sum(nb) * 4000000.0), 6)::DOUBLE AS average_utilization, round(least(1.0, min(len / (nb * 4000000.0))), 6)::DOUBLE AS min_utilization, round(greatest(0, max(len / (nb * 4000000.0))), 6)::DOUBLE AS max_utilization, round(avg(nb), 6)::DOUBLE AS average_bin_count, round(ceil(sum(len) / 4000000.0) / sum(nb), 6)::DOUBLE AS bin_efficiency FROM t"""
)
def e11_packing_totals(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 4).alias("g"), (F.col("doc_id") % 16).alias("bin"), F.col("n_chars").alias("length"))
    s = packing.aggregated_statistics(packing.packing_statistics(rows, 4_000_000, ["g"]))
    return s.select("total_sequences", "total_bins", *(r6(c).alias(c) for c in ("average_utilization", "min_utilization", "max_utilization", "average_bin_count", "bin_efficiency")))


@query(
    """WITH t AS (SELECT dayofyear(ts) AS step, event_type AS metric, sum(value) AS seconds FROM events WHERE NOT (event_type = 'view' AND dayofyear(ts) % 2 = 0) GROUP BY ALL), p AS (SELECT * FROM t WHERE metric <> 'error'), m AS (SELECT avg(x) AS a FROM (SELECT sum(seconds) AS x FROM p GROUP BY step))
SELECT metric, round(avg(seconds), 4) AS mean, round(coalesce(stddev_samp(seconds), 0), 4) AS std, count(*) AS steps, round(avg(seconds) / any_value(a), 6) AS share FROM p, m GROUP BY metric"""
)
def e12_timing_summary(spark, d):
    """Mean, deviation and share of each part over the steps it is in, without the logged total."""
    e = table(spark, d, "events").filter("NOT (event_type = 'view' AND dayofyear(ts) % 2 = 0)")
    t = e.groupBy(F.dayofyear("ts").alias("step"), F.col("event_type").alias("metric")).agg(F.sum("value").alias("seconds"))
    out = metrics.timing_summary(t, ["step"], total="error")
    return out.select("metric", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "steps", r6("share").alias("share"))


@query(
    f"""WITH {SERIES}, b AS (SELECT metric, count(*) AS n, max(step) - count(*) AS o FROM series GROUP BY metric), r AS (SELECT s.* FROM series s JOIN b USING (metric) WHERE step >= -10 + n + 1 + o AND step < n + 1 + o
), k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, step) AS r, count(*) OVER (PARTITION BY metric) AS c FROM r)
SELECT a.metric, a.lo, a.hi, a.above, t.mean, m.med AS median FROM (SELECT metric, min(value) AS lo, max(value) AS hi, round(avg((value >= 65)::INT), 6) AS above FROM series GROUP BY metric) a
 JOIN (SELECT metric, round(avg(value), 6) AS mean FROM k WHERE r <= greatest(floor(c * (1 - 0.2)), 1) GROUP BY metric) t ON t.metric = a.metric JOIN (SELECT metric, median(value) AS med FROM r GROUP BY metric) m ON m.metric = a.metric"""
)
def e13_metric_helpers(spark, d):
    """Minimum, maximum, ratio, trimmed mean and median of the last ten steps."""
    s = series(spark, d)
    a = metrics.extremes(s, 65).select("metric", F.col("min").alias("lo"), F.col("max").alias("hi"), r6("ratio_above").alias("above"))
    t = metrics.trimmed_mean(s, -10, 0, 0.2).withColumn("mean", r6("mean"))
    return a.join(t, "metric").join(metrics.medians(s, -10, 0), "metric")


@query(f"WITH {SERIES} SELECT metric, step, value + 1000 * (step % 2) AS value FROM series")
def e14_metric_merge(spark, d):
    """Two files of points; the later file wins where both have a step."""
    s = series(spark, d)
    first = s.withColumn("mtime", F.lit(1)).withColumn("pos", F.lit(0))
    second = s.filter("step % 2 = 1").withColumn("value", F.col("value") + 1000).withColumn("mtime", F.lit(2)).withColumn("pos", F.lit(0))
    return metrics.merged(first.unionByName(second))


@query(f"WITH {SERIES} SELECT metric, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, concat_ws(',', list_sort(list(step))[1], list_sort(list(step))[2], list_sort(list(step))[3], list_sort(list(step))[-3], list_sort(list(step))[-2], list_sort(list(step))[-1]) AS steps FROM series GROUP BY metric")
def e15_metric_summary(spark, d):
    out = metrics.summary(series(spark, d))
    return out.withColumn("mean", r6("mean"))


@query(f"WITH {SERIES} SELECT metric, concat('{{', string_agg(concat('\"', step, '\":', value::BIGINT), ',' ORDER BY step), '}}') AS steps FROM series GROUP BY metric")
def a15_metric_json(spark, d):
    """Metric series as JSON objects with ascending steps."""
    return metrics.as_json(series(spark, d).withColumn("value", F.col("value").cast("long")))


@query("SELECT concat('spec_decode_', event_type) AS metric, position, sum(v)::BIGINT AS value FROM (SELECT event_type, CASE WHEN event_type = 'view' THEN p::INT END AS position, CASE WHEN event_type = 'view' THEN user_id % (p + 1) ELSE user_id END AS v FROM events, range(1, 4) t(p) WHERE event_type IN ('view', 'click') AND (event_type = 'view' OR p = 1)) GROUP BY ALL")
def e16_worker_counters(spark, d):
    """Counters over workers, lists by position."""
    e = table(spark, d, "events")
    rows = e.select(
        F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("spec_decode_"), "event_type")).otherwise(F.lit("other_metric")).alias("metric"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("value"),
        F.when(F.col("event_type") == "view", F.array(*(F.col("user_id") % (p + 1) for p in (1, 2, 3)))).alias("vector"),
    )
    return metrics.worker_counters(rows)


@query("WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS drafts, count(*) AS tokens, count(*) FILTER (WHERE event_type = 'click') AS accepted FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN drafts > 0 THEN 1 + accepted / drafts::DOUBLE ELSE 1 END, 6)::DOUBLE AS length, round(CASE WHEN tokens > 0 THEN accepted / tokens::DOUBLE ELSE 0 END, 6)::DOUBLE AS rate, round(accepted / greatest(tokens, 1)::DOUBLE * 100, 6)::DOUBLE AS percent FROM c")
def e17_acceptance(spark, d):
    """Acceptance length and rate of counters."""
    count = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    c = table(spark, d, "events").groupBy("user_id").agg(count("view").alias("drafts"), F.count(F.lit(1)).alias("tokens"), count("click").alias("accepted"))
    length, rate = metrics.acceptance(F.col("drafts"), F.col("tokens"), F.col("accepted"))
    return c.select("user_id", r6(length).alias("length"), r6(rate).alias("rate"), r6(metrics.acceptance_percent(F.col("accepted"), F.col("tokens"))).alias("percent"))


@query(f"WITH {SERIES} SELECT metric, round(0.5 * avg(value), 6) AS mean FROM series GROUP BY metric")
def e18_layer_metrics(spark, d):
    """Scaled means over layers (E18); days stand for layers."""
    rows = series(spark, d).groupBy("metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda s: s["value"]).alias("layers"))
    return metrics.layer_means(rows, 0.5).select("metric", r6("mean").alias("mean"))


@query("WITH q(agent) AS (VALUES ('src1'), ('src2'), ('none')) SELECT agent, count(doc_id) AS n, (SELECT count(*) FROM documents) AS total FROM q LEFT JOIN documents ON source = agent GROUP BY agent")
def e19_agent_counts(spark, d):
    docs = table(spark, d, "documents")
    asked = spark.createDataFrame([("src1",), ("src2",), ("none",)], "agent string")
    counts = docs.groupBy(F.col("source").alias("agent")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(asked), "agent", "right").select("agent", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.lit(docs.count()).cast("long").alias("total"))


@query(f"WITH {ROLLOUTS} SELECT event_type, round(sum(reward * correct) / (sum(correct) + 1e-8), 6) AS loss FROM rollouts GROUP BY event_type")
def e23_masked_loss(spark, d):
    return rollouts(spark, d).groupBy("event_type").agg(r6(losses.masked_mean(F.col("reward"), F.col("correct"))).alias("loss"))


@query("SELECT dayofyear(ts)::BIGINT AS step, round(avg(value), 6) AS mean_value, max(value) AS max_time, round(avg(exp(abs(value % 1 - 0.5))), 6) AS logprob_error FROM events GROUP BY 1")
def e24_rank_reduce(spark, d):
    """Means of metrics, maxima of timings and log-probability error by step."""
    e = table(spark, d, "events").groupBy(F.dayofyear("ts").cast("long").alias("step"))
    return e.agg(r6(F.avg("value")).alias("mean_value"), F.max("value").alias("max_time"), r6(metrics.logprob_error(F.col("value") % 1, F.lit(0.5))).alias("logprob_error"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS nth FROM documents")
def f1_occurrence_index(spark, d):
    return sets.occurrence(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"])


@query("WITH t AS (SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n_tokens FROM conversations) SELECT conv_id, turn, n_tokens, coalesce(sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM t")
def f4_running_offsets(spark, d):
    """Token offset of each message."""
    n = F.size(F.filter(F.split("m.content", " "), lambda w: w != "")).cast("long")
    return groups.token_rows(chats(spark, d), ["conv_id"], "messages", n).select("conv_id", F.col("turn").cast("long").alias("turn"), "n_tokens", "offset")


@query(f"WITH {ROLLOUTS} SELECT event_id, reward FROM rollouts ORDER BY reward DESC, event_id DESC LIMIT 5")
def f13_best_checkpoints(spark, d):
    """The k best by a metric; the limit is the operator."""
    return metrics.best_checkpoints(rollouts(spark, d).select("event_id", "reward"), "reward", 5, tie="event_id")


@query("SELECT vec_id, concat_ws(',', list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'n': -embedding[i], 'i': i}))[1:4], lambda s: (s.i - 1)::VARCHAR)[1], list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'n': -embedding[i], 'i': i}))[1:4], lambda s: (s.i - 1)::VARCHAR)[2], list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'n': -embedding[i], 'i': i}))[1:4], lambda s: (s.i - 1)::VARCHAR)[3], list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'n': -embedding[i], 'i': i}))[1:4], lambda s: (s.i - 1)::VARCHAR)[4]) AS top FROM embeddings")
def f14_top_logits(spark, d):
    """Positions of the four largest values."""
    rows = table(spark, d, "embeddings").select("vec_id", losses.top_logits(F.col("embedding"), 4).alias("t"))
    return rows.select("vec_id", F.array_join(F.transform("t", lambda s: s["index"].cast("string")), ",").alias("top"))


@query("SELECT doc_id, doc_id // 8 AS batch, n_chars, max(n_chars) OVER (PARTITION BY doc_id // 8) AS batch_max_length FROM documents")
def j1_collate(spark, d):
    """Batches with their longest length."""
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), "n_chars")
    return packing.collate(rows, "batch", "n_chars").select("doc_id", "batch", "n_chars", "batch_max_length")


@query(
    """WITH p AS (SELECT doc_id, doc_id // 8 AS batch, side, CASE side WHEN 0 THEN n_chars % 30 ELSE n_chars % 20 END AS length FROM documents, range(0, 2) t(side)), w AS (SELECT batch, CAST(ceil(max(length) / 16.0) * 16 AS BIGINT) AS width FROM p GROUP BY batch)
SELECT doc_id, side::INT AS side, length::INT AS length, width, CASE side WHEN 0 THEN 7 * length ELSE 8 * length END AS total FROM p JOIN w USING (batch)"""
)
def j3_preference_collate(spark, d):
    """Chosen and rejected interleaved and padded to a multiple of 16."""
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), F.array_repeat(F.lit(7), (F.col("n_chars") % 30).cast("int")).alias("c"), F.array_repeat(F.lit(8), (F.col("n_chars") % 20).cast("int")).alias("r"))
    out = packing.collate_preferences(rows, "batch", "c", "r", ["doc_id"], multiple=16)
    return out.filter(F.size("ids") == F.col("width")).select("doc_id", "side", "length", "width", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    """WITH b AS (SELECT item_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark
), g AS (SELECT i // 7 AS g, flatten(list(ids ORDER BY i)) AS ids FROM b GROUP BY 1), w AS (SELECT max(len(ids)) AS w FROM g)
SELECT g::INT AS "group", array_to_string(list_concat(ids, list_transform(range(0, (w - len(ids))::BIGINT), lambda x: -1)), ',') AS ids FROM g, w"""
)
def j6_group_and_concat(spark, d):
    """Consecutive arrays joined by sevens and padded to the widest."""
    b = table(spark, d, "benchmark")
    rows = b.select("item_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    n = b.count()
    sizes = [min(7, n - k) for k in range(0, n, 7)]
    return packing.group_and_concat(rows, "item_id", "ids", sizes, -1).select("group", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    """WITH t AS (SELECT conv_id, list(length(text) % 7 ORDER BY turn) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(flatten(list_transform(n, lambda x: range(0, x))), ',') AS positions, concat_ws(',', 0, list_sum(n[1:1])::BIGINT, list_sum(n)::BIGINT) AS marks FROM t"""
)
def j7_packed_positions(spark, d):
    """Positions that start again with each sequence, and running lengths."""
    rows = chats(spark, d).select("conv_id", F.transform("messages", lambda m: F.length(m["content"]) % 7).alias("n"))
    c = packing.cumulative(F.col("n"))
    marks = F.concat_ws(",", F.get(c, 0).cast("string"), F.get(c, 1).cast("string"), F.element_at(c, -1).cast("string"))
    return rows.select("conv_id", F.array_join(F.transform(packing.positions(F.col("n")), lambda x: x.cast("string")), ",").alias("positions"), marks.alias("marks"))


@query("WITH t AS (SELECT conv_id, list(turn ORDER BY turn) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, len(n) AS parts, array_to_string(list_transform(n, lambda x: (x + 1)::VARCHAR), ',') AS sizes FROM t")
def j8_unpack(spark, d):
    """A packed row cut back into its sequences."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    lengths = F.transform("t", lambda x: (x + 1).cast("int"))
    packed = packing.PackedTensor(F.transform("t", lambda x: F.array_repeat(x, (x + 1).cast("int")))).packed()
    rows = turns.select("conv_id", lengths.alias("n"), packed.alias("p"))
    cut = packing.unpacked(F.col("p"), F.col("n"))
    return rows.select("conv_id", F.size(cut).cast("long").alias("parts"), F.array_join(F.transform(cut, lambda x: F.size(x).cast("string")), ",").alias("sizes"))


@query()
def j9_bin_packing(spark, d):
    """Bins as large as the longest document (8192 at least) by batch of 64, first fit decreasing; sequential, so no SQL."""
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 64).alias("batch"), F.col("n_chars").alias("length"))
    longest = rows.agg(F.max("length")).first()[0] or 0
    return packing.pack(rows, "batch", "doc_id", "length", max(8192, longest), "modified_first_fit_decreasing")


@query()
def j10_dynamic_batches(spark, d):
    """Micro-batches within a token budget; sequential, so no SQL."""
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 64).alias("batch"), "n_chars")
    return packing.dynamic_batches(rows, "batch", "doc_id", "n_chars", 65536, 64)


@query("SELECT conv_id, turn, position, (CASE WHEN turn % 2 = 1 THEN 1.0 - 0.25 ELSE 1.0 END)::DOUBLE AS advantage FROM (SELECT conv_id, turn, unnest(range(0, length(text) % 4)) AS position FROM conversations)")
def j12_penalty_placement(spark, d):
    """A penalty on the tokens of the assistant's second, fourth, ... message, one row a token."""
    n = (F.length("m.content") % 4).cast("long")
    rows = groups.token_rows(chats(spark, d), ["conv_id"], "messages", n)
    each = rows.select("conv_id", "turn", groups.placed(F.array_repeat(F.lit(1.0), F.col("n_tokens").cast("int")), F.when(F.col("turn") % 2 == 1, -0.25).otherwise(0.0), F.lit(0), F.col("n_tokens")).alias("a"))
    return each.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.posexplode("a").alias("position", "advantage")).withColumn("position", F.col("position").cast("long"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS stop, round(least(greatest((len(string_split(text, ' ')) - 300) / 200.0, 0), 1) * 0.4, 6)::DOUBLE AS overlong FROM documents"""
)
def h19_reward_shaping(spark, d):
    """Overlong and stop-properly penalties."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(1.0).alias("reward"), F.split("text", " ").alias("t"), F.array(F.lit(1), F.lit(2)).alias("m"), (F.col("doc_id") % 5 == 0).alias("cut"))
    out = groups.shaped_rewards(docs, "reward", "m", "t", "cut", {"overlong_buffer_penalty": -0.4, "overlong_buffer_length": 200, "max_response_length": 500, "stop_properly_penalty_coef": -0.5})
    return out.select("doc_id", F.col("stop_properly_penalty").alias("stop"), r6("overlong_penalty").alias("overlong"))


BM25 = """words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id
), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM dl) / (SELECT count(*) FROM documents)::DOUBLE AS avg
), idf AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, st GROUP BY term)"""


@query(
    f"""WITH {BM25}, q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) GROUP BY ALL
), s AS (SELECT item_id, tf.doc_id, sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg)) * qtf * idf) AS score FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT item_id, rank, doc_id AS doc, round(score, 5) AS score FROM r WHERE rank <= 5"""
)
def bm25_search(spark, d):
    """The five best documents for each benchmark item (§2.12, D5, F8); k is the operator's."""
    out = retrieval.Bm25(table(spark, d, "documents"), "doc_id", "text").search(table(spark, d, "benchmark"), "item_id", "text", 5)
    return out.select(F.col("query").alias("item_id"), F.col("rank").cast("long").alias("rank"), "doc", F.round("score", 5).alias("score"))


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def e22_document_frequency(spark, d):
    out = retrieval.Bm25(table(spark, d, "documents"), "doc_id", "text").idf()
    return out.select("term", "df", r6("idf").alias("idf"))


@query("SELECT event_id, user_id % 12 AS weight_version FROM events WHERE user_id % 12 BETWEEN 5 AND 7 ORDER BY user_id % 12 DESC, event_id LIMIT 200")
def k3_replay_buffer(spark, d):
    """Trajectories young enough, newest first, as many as the buffer holds (K3, K4); the limit is the operator."""
    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 12).alias("weight_version"))
    return replay.replay(rows, 7, 2, 50, "event_id")


@query(
    f"""WITH {SERIES}, v AS (SELECT avg(value) AS mean, max(value) AS top FROM series WHERE metric = 'view')
SELECT 0 AS "check", mean > 1 AS passed, round(mean, 6) AS value, concat(CASE WHEN mean > 1 THEN 'PASS' ELSE 'FAIL' END, ': mean(view) > 1.0') AS message FROM v
UNION ALL SELECT 1, top < 0, top, concat(CASE WHEN top < 0 THEN 'PASS' ELSE 'FAIL' END, ': max(view) < 0.0') FROM v UNION ALL SELECT 2, false, NULL, 'FAIL: min(missing) > 0.0'"""
)
def c17_metric_checks(spark, d):
    """Named checks on the metric series: passed, value and message (C17)."""
    wanted = [{"metric": "view", "helper": "mean", "op": ">", "limit": 1.0}, {"metric": "view", "helper": "max", "op": "<", "limit": 0.0}, {"metric": "missing", "helper": "min", "op": ">", "limit": 0.0}]
    return metrics.checks(series(spark, d), wanted).withColumn("value", r6("value"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:len(embedding) // 2], lambda v: v::DOUBLE) AS a, list_transform(embedding[len(embedding) // 2 + 1:len(embedding) // 2 * 2], lambda v: v::DOUBLE) AS b FROM embeddings
), n AS (SELECT *, ln(list_sum(list_transform(a, lambda v: exp(v)))) AS na, ln(list_sum(list_transform(b, lambda v: exp(v)))) AS nb FROM e
), p AS (SELECT vec_id, a, b, list_zip(list_transform(a, lambda v: v - na), list_transform(b, lambda v: v - nb)) AS st, list_zip(a, b) AS ab FROM n)
SELECT vec_id, round(list_sum(list_transform(ab, lambda z: least(exp(z[1] - z[2]), least(greatest(exp(z[1] - z[2]), 0.8), 1.2)))), 6) AS objective, round(list_sum(list_transform(ab, lambda z: exp(z[2] - z[1]) - 1 - (z[2] - z[1]))), 6) AS kl,
 round(ln(1 + exp(-0.1 * (list_sum(a) - list_sum(b)))), 6) AS preference, round(list_sum(list_transform(st, lambda z: 0.5 * exp(z[2]) * (z[2] - z[1]) + 0.5 * exp(z[1]) * (z[1] - z[2]))), 6) AS distillation FROM p"""
)
def h21_policy_objective(spark, d):
    """Clipped objective, divergences and preference loss between the halves of whole embeddings (H21-H24); published formulas."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, half).cast("array<double>").alias("a"), F.slice("embedding", half + 1, half).cast("array<double>").alias("b"))
    a, b = F.col("a"), F.col("b")
    return e.select("vec_id", r6(losses.total(losses.clipped_policy(a, b, F.lit(1.0)))).alias("objective"), r6(losses.total(losses.kl(a, b))).alias("kl"), r6(losses.preference_loss(losses.total(a), losses.total(b), F.lit(0.0), F.lit(0.0))).alias("preference"), r6(losses.distillation(a, b, "mixed")).alias("distillation"))


@query("SELECT concat_ws('.', conv_id, count(*)) AS leaf, (count(*) + 1)::INT AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id HAVING count(*) >= 2")
def b27_thread_expansion(spark, d):
    """Conversations as chains of a tree, expanded to threads."""
    from ..operators.trees import threads

    c = table(spark, d, "conversations").filter("role <> 'system'")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    key = lambda n: F.concat_ws(".", "conv_id", n.cast("string"))
    rows = c.withColumn("n", nth).select(key(F.col("n")).alias("id"), F.when(F.col("n") > 1, key(F.col("n") - 1)).alias("parent_id"), F.when(F.col("role") == "user", "prompter").otherwise("assistant").alias("role"), "text")
    return threads(rows).select("leaf", F.size("messages").alias("n"))
