"""Quality rules with host-level verdicts, in DataFrame expressions only.

Every document gets counts and rule failures from its own text in one pass. Failures are added up by host; a
host's rate is shrunk towards the mean of all hosts by a beta prior whose strength is fitted to the spread of the
host rates beyond what chance alone would give hosts of their sizes (moments of the beta-binomial), so a host with
three documents is not condemned by two of them. The verdicts join back to the documents. Only digests (no texts) are written and shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize

WINDOW = 5
#: Shares beyond which a document fails a soft rule; soft rules count for the host only.
SYMBOLS_PER_WORD, DUPLICATE_LINES = 0.25, 0.5
#: A host is rejected if its shrunk failure rate reaches this.
HOST_LIMIT = 0.75
#: Host tables of up to so many rows (counted first) are broadcast; larger ones are joined by shuffle.
BROADCAST_HOSTS = 200_000


def words(text: Column) -> Column:
    """Runs of anything but the six ASCII white-space characters."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _covered(hashes: Column) -> Column:
    """Number of words in windows whose hash occurs twice or more in the array."""
    located = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twin = lambda x, j: same(F.get(s, j - 1), x) | same(F.get(s, j + 1), x)
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    # transform over a one-element array binds the sorted array, so it is evaluated once.
    at = F.get(F.transform(F.array(located), repeated), 0)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    grow = lambda a, p: F.struct((a["n"] + (p + WINDOW - F.greatest(p, a["end"]))).cast("long").alias("n"), (p + WINDOW).alias("end"))
    return F.aggregate(at, start, grow, lambda a: a["n"])


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and the counts of each text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    split = base.withColumn("w", words(F.col("t"))).withColumn("n_words", F.size("w").cast("long"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id",
        "source",
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("h"),
    )
    return counted.select(
        "doc_id",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0).cast("long")).otherwise(_covered(F.col("h"))).alias("n_repeat_words"),
    )


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Counts, base verdict and final verdict of every document.

    Returns ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long),
    ``base_failed`` (under 10 words, or over a fifth of the words in repeated windows of five), ``host_rate``
    (the host's shrunk failure rate) and ``kept``: not failed and of a host below ``host_limit``. The host is
    ``source``; a null source is a host of its own. Null and empty texts have no words and fail. Repeated rows
    count as often as they occur. A text of any length is counted whole, its words in the memory of one task.
    """
    soft = (F.col("n_symbols") > F.col("n_words") * SYMBOLS_PER_WORD) | (F.col("n_dup_lines") > F.col("n_lines") * DUPLICATE_LINES)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    digest = materialize(text_counts(docs).withColumn("base_failed", base).withColumn("failed", base | soft).drop("n_lines"), "quality")
    hosts = materialize(digest.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("f")), "hosts")
    rate = F.col("f") / F.col("n")
    total = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).first()
    mean = float(total["f"]) / total["n"] if total["n"] else 0.0
    spread = hosts.agg(F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("v")).first()["v"]
    strength = prior_strength(mean, float(spread or 0.0), total["hosts"], total["n"] or 0, total["squares"] or 0.0)
    judged = hosts.select(F.col("source").alias("host"), ((F.col("f") + mean * strength) / (F.col("n") + strength)).alias("host_rate"))
    if total["hosts"] <= BROADCAST_HOSTS:
        judged = F.broadcast(judged)
    both = digest.join(judged, digest.source.eqNullSafe(judged.host), "left")
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") < host_limit)).alias("kept"), "host_rate")


def prior_strength(mean: float, spread: float, hosts: int, docs: int, squares: float) -> float:
    """Pseudo-documents of the beta prior; between 1 and a million.

    ``spread``: sum over hosts of documents times the squared distance of the rate from the mean; ``squares``: sum of
    squared numbers of documents. The spread is expected to be ``mean * (1 - mean)`` times
    ``(hosts - 1) * (1 - r) + r * (docs - squares / docs)``, r being the correlation of two documents of a host; the
    strength is ``1 / r - 1``. Hosts of one document each, or a single host, tell nothing of r: they are pooled.
    """
    chance = mean * (1 - mean)
    if docs == 0 or chance <= 0:
        return 1e6
    above, most = spread / chance - (hosts - 1), docs - squares / docs - (hosts - 1)
    if above <= 0 or most <= 0:
        return 1e6
    return min(1e6, max(1.0, most / above - 1))
