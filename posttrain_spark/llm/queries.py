"""The registered queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text under unigrams and under the backoff automaton."""
    from .lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), order=3)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: plain patterns and literals assigned to sensitive names."""
    from .secrets import scan_documents

    return scan_documents(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, by its inferred mixture of languages."""
    from .langid import identify, train

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op4_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, written as wavelet matrix shards and read back."""
    from .wavelet import encode_to_shards

    return encode_to_shards(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)[0]


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or paraphrased, with the item and the evidence."""
    from .decontam import find_leaks, train

    docs = _table(spark, sf_dir, "documents")
    return find_leaks(docs, train(docs, _table(spark, sf_dir, "benchmark")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document, with the verdict on its host."""
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents")).drop("host_rate")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every text."""
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of every text and what they decode to, by digest."""
    from .bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share, by digest."""
    from pyspark.sql import functions as F

    from .linededup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, keep="none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate class of every document."""
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_secret_scan, op3_language_id, op4_wavelet_ids, op5_benchmark_leaks, op6_quality_rules, op7_license_scan, op8_bpe_codec, op9_line_dedup, op10_simhash_classes)}


OP9_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs
), keyed AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.key = hot.key
GROUP BY r
"""


OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3))) AS i FROM docs)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM windows) WHERE c >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT docs.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines ON lines.doc_id = docs.doc_id LEFT JOIN covered ON covered.doc_id = docs.doc_id
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > n_words * 0.25 OR n_dup_lines > n_lines * 0.5 AS any_failed
  FROM counts
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE any_failed) AS f FROM failed GROUP BY source
), overall AS (
  SELECT sum(f) / sum(n) AS m, sum(n) AS n, count(*) AS h, sum(n::DOUBLE * n) AS q FROM hosts
), spread AS (
  SELECT any_value(overall.m) AS m, any_value(overall.n) AS n, any_value(overall.h) AS h, any_value(overall.q) AS q,
         sum(hosts.n * (f / hosts.n - m) * (f / hosts.n - m)) AS s FROM hosts, overall
), prior AS (
  SELECT m, CASE WHEN m * (1 - m) <= 0 THEN 1e6
                 WHEN s / (m * (1 - m)) - (h - 1) <= 0 OR n - q / n - (h - 1) <= 0 THEN 1e6
                 ELSE least(1e6, greatest(1.0, (n - q / n - (h - 1)) / (s / (m * (1 - m)) - (h - 1)) - 1)) END AS k FROM spread
), rates AS (
  SELECT source, (f + m * k) / (n + k) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate < 0.75 AS kept
FROM failed JOIN rates ON failed.source IS NOT DISTINCT FROM rates.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": OP6_SQL, "op9_line_dedup": OP9_SQL}
