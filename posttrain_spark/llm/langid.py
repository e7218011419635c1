"""Language ID as inference of a mixture of languages.

Each language is a smoothed multinomial over hashed character n-grams of words (padded by a space at both
ends). A document is a mixture: each word comes from one language, and expectation-maximisation estimates the
proportions from the words' n-gram likelihoods, until no share moves by ``TOLERANCE`` or more. Which languages are in
the mixture is chosen by penalised likelihood, the log likelihood less ``penalty * ln(words)`` a language. All learned
languages are there at first. Those go together whose words, by a bound, the others explain at a loss below the
penalties saved. Then the language of the smallest share is left out again and again, down to one, and the best set
is kept.

All documents of an Arrow batch are fitted together, by their different words and how often these occur; words seen
before are not hashed again.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, keep_rows, map_batches, prepare

UNKNOWN = "und"
#: Hash buckets of n-grams, and the n-gram lengths.
BUCKETS, GRAMS = 1 << 17, (2, 3)
#: The fit uses about so many labelled documents of each language, chosen by a hash of the id.
PER_LANGUAGE = 4_000
MAX_LANGUAGES = 512
#: Different n-grams that a language must show before texts can be found to be in no learned language.
DISTINCT = 256
#: The largest change of a share in the last step of a fit.
TOLERANCE = 1e-4
#: Different words times languages that are fitted at once, and bytes of words and their rows remembered by each Python worker.
AT_ONCE, CACHE = 1 << 21, 64 << 20

_WORD = re.compile(r"[^\W\d_]+")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def learned_from(doc_id: int | None) -> bool:
    """crc32 of the id as text doesn't leave 2 when divided by 4. A null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 != 2


def tokens(text: str) -> list[str]:
    """Words: runs of letters, lower-cased; characters that are numerals but not digits don't make a word alone."""
    found = _WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isascii() or any(map(str.isalpha, w))]


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, and the index of the word that each belongs to."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []
    for n in GRAMS:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, np.uint64(n))
        for k in range(n):
            h = (h ^ chars[k : len(chars) - n + 1 + k]) * _FACTORS[k]
            h ^= h >> np.uint64(17)
        whole = word[: len(h)] == word[n - 1 :]
        buckets.append((h[whole] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(word[: len(h)][whole])
    return np.concatenate(buckets), np.concatenate(owners)


class Part:
    """Words of some documents: likelihoods by language, and how often each occurs in its document."""

    def __init__(self, like: np.ndarray, counts: np.ndarray, first: np.ndarray, sizes: np.ndarray, whole: bool = False):
        at = slice(None) if whole else np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        self.like, self.counts, self.sizes = like[at], counts[at].astype(np.float64), sizes
        self.first = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.words = np.add.reduceat(self.counts, self.first)

    def fit(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares by expectation-maximisation from these on, and the log likelihood; documents that have settled are left out."""
        share, moving, part = share.copy(), np.arange(len(share)), self
        while len(moving):
            now = share[moving]
            joint = part.like * now[part.doc]
            new = np.add.reduceat(joint * (part.counts / joint.sum(1))[:, None], part.first, axis=0) / part.words[:, None]
            share[moving] = new
            more = np.abs(new - now).max(1) >= TOLERANCE
            if more.sum() < 0.7 * len(more):
                moving = moving[more]
                if len(moving):
                    part = Part(part.like, part.counts, part.first[more], part.sizes[more])
        total = (self.like * share[self.doc]).sum(1)
        return share, np.add.reduceat(self.counts * np.log(total), self.first)

    def expendable(self, share: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """The most languages, those of the smallest shares, that surely cost less likelihood than their penalties; not the largest.

        Words whose posterior for these languages is r lose at most -ln(1 - r) without them.
        """
        by = share.argsort(1, kind="stable")
        joint = self.like * share[self.doc]
        among = np.cumsum(np.take_along_axis(joint, by[self.doc], 1), axis=1) / joint.sum(1, keepdims=True)
        loss = -np.add.reduceat(self.counts[:, None] * np.log(np.maximum(1 - among[:, :-1], 1e-300)), self.first, axis=0)
        saved = cost[:, None] * np.cumsum(np.take_along_axis(share, by, 1) > 0, axis=1)[:, :-1]
        fine = loss <= saved
        most = np.where(fine.any(1), fine.shape[1] - fine[:, ::-1].argmax(1), 0)
        drop = np.zeros(share.shape, bool)
        np.put_along_axis(drop, by, np.arange(share.shape[1]) < most[:, None], 1)
        return drop


class Model:
    """Log probabilities of n-gram buckets by language (sorted by name)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        # Smoothed by the buckets of all languages, so that rare n-grams say little.
        pooled = counts.sum(0) + 0.5
        prior = pooled / pooled.sum() * min(2_000.0, max(1.0, counts.sum() / max(1, len(languages)) / 50))
        p = counts + prior
        self.log = np.ascontiguousarray(np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32))
        # Only languages fitted on enough n-grams can tell that a text is in none of them.
        self.settled = bool(languages) and counts.sum(1).min() >= BUCKETS and (counts > 0).sum(1).min() >= DISTINCT
        self.memory: dict[str, int] = {}
        self.held = 0
        self.rows = np.zeros((0, len(languages)), np.float32)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word by language."""
        memory = self.memory
        new = [w for w in dict.fromkeys(words) if w not in memory]
        if new:
            size = sum(map(len, new)) + len(new) * (200 + 4 * len(self.languages))
            if self.held + size > CACHE:
                self.memory, self.rows, self.held = memory, _, _ = {}, self.rows[:0], 0
                new = list(dict.fromkeys(words))
                size = sum(map(len, new)) + len(new) * (200 + 4 * len(self.languages))
            buckets, owners = gram_buckets(new)
            order = np.argsort(owners, kind="stable")
            made = np.add.reduceat(self.log[buckets[order]], np.searchsorted(owners[order], np.arange(len(new))), axis=0)
            base = len(self.rows)
            memory.update((w, base + k) for k, w in enumerate(new))
            self.rows = np.concatenate([self.rows, made])
            self.held += size
        return self.rows[[memory[w] for w in words]]

    def mixtures(self, sizes: np.ndarray, rows: np.ndarray, counts: np.ndarray, penalty: float = 1.0) -> np.ndarray:
        """Proportions by document; ``sizes``: different words of each (at least one), ``rows`` and ``counts``: of these in turn."""
        n, k = len(sizes), len(self.languages)
        first = np.cumsum(sizes) - sizes
        like = np.exp(np.maximum(rows - rows.max(1, keepdims=True), -600).astype(np.float64))
        words = np.add.reduceat(counts, first).astype(np.float64)
        cost = penalty * np.log(words + 1.0)
        share = np.full((n, k), 1.0 / k)
        best, best_score = share.copy(), np.full(n, -np.inf)
        left, all_in = np.arange(n), True
        while len(left):
            part = Part(like, counts, first[left], sizes[left]) if len(left) < n else Part(like, counts, first, sizes, whole=True)
            now, fit = part.fit(share[left])
            score = fit - cost[left] * (now > 0).sum(1)
            better = score >= best_score[left]
            best[left[better]], best_score[left[better]] = now[better], score[better]
            drop = np.arange(k) == np.where(now > 0, now, 2).argmin(1)[:, None]
            if all_in:
                if k > 2:
                    drop |= part.expendable(now, cost[left])
                all_in = False
            share[left] = np.where(drop, 0, now)
            left = left[(share[left] > 0).any(1)]
            share[left] /= share[left].sum(1, keepdims=True)
        return best

    def fitted(self, texts: list[str | None], penalty: float) -> Iterator[tuple[int, Counter, np.ndarray, np.ndarray]]:
        """Of each text with a word, as many at a time as ``AT_ONCE`` says: its place, its words, their log likelihoods by language, and the proportions."""
        limit = max(1, AT_ONCE // len(self.languages))
        part: list[tuple[int, Counter]] = []
        n = 0
        for k, text in enumerate([*texts, None]):
            ws = Counter(tokens(text)) if text else Counter()
            if part and (k == len(texts) or n + len(ws) > limit):
                rows = self.word_rows([w for _, c in part for w in c])
                sizes = np.array([len(c) for _, c in part])
                share = self.mixtures(sizes, rows, np.array([x for _, c in part for x in c.values()]), penalty)
                ends = np.cumsum(sizes)
                for (p, c), a, z, s in zip(part, ends - sizes, ends, share, strict=True):
                    yield p, c, rows[a:z], s
                part, n = [], 0
            if ws:
                part.append((k, ws))
                n += len(ws)

    def identified(self, texts: list[str | None], penalty: float = 1.0) -> list[bool]:
        """Whether some word of a text is likelier in a language of its mixture than if all n-grams were alike; any word will do unless ``settled``."""
        if not self.settled:
            return [bool(t and tokens(t)) for t in texts]
        out = [False] * len(texts)
        for p, words, rows, share in self.fitted(texts, penalty):
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
            grams = sum(np.maximum(lengths - n + 1, 0) for n in GRAMS)
            out[p] = bool((rows[:, share > 0].max(1) > -grams * np.log(BUCKETS)).any())
        return out

    def predict(self, texts: list[str | None], penalty: float = 1.0) -> list[tuple[str, float, str]]:
        """Language of the largest share (ties: the first by name), that share, and all shares of at least a hundredth."""
        out: list[tuple[str, float, str]] = [(UNKNOWN, 0.0, "")] * len(texts)
        if not self.languages:
            return out
        for p, _, _, s in self.fitted(texts, penalty):
            b = int(s.argmax())
            mix = ",".join(f"{self.languages[j]}:{s[j]:.2f}" for j in np.nonzero(s >= 0.01)[0])
            out[p] = (self.languages[b], min(1.0, float(s[b])), mix)
        return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits the n-gram tables on about ``per_language`` labelled, non-held-out documents of each language.

    The documents are chosen by a hash of their id against a rate for each language, so no group of rows is
    ranked or gathered. Rows with a null text or language teach nothing. At most ``MAX_LANGUAGES`` labels.
    """
    spark = docs.sparkSession
    prepare(spark)
    crc = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc % 4 != 2))
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    rate = F.lit(0.0)
    for name in languages:
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / sizes[name]))).otherwise(rate)
    unit = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(unit < rate).select("lang", "text").repartition(16)
    schema = arrow_schema("lang string, counts binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ws := tokens(text):
                    total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total[lang] += np.bincount(gram_buckets(ws)[0], minlength=BUCKETS)
        pack = zstandard.ZstdCompressor(level=1).compress
        for lang, c in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [pack(c.tobytes())]}, schema=schema)

    # 16 tasks with one compressed table a language each: bounded by the parameters, not by the corpus.
    table = np.zeros((len(languages), BUCKETS), np.float64)
    for lang, c in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        table[languages.index(lang)] += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(c)), np.int64)
    return Model(languages, table)


def identify(docs: DataFrame, model: Model, penalty: float = 1.0) -> DataFrame:
    """Predicts the language of every whole text from its text alone.

    Returns ``doc_id``, ``held_out``, ``lang_pred`` (``und`` for null texts, texts without a letter, and if no
    language was learned), ``score``, the share of that language, and ``mixture``, all shares from 0.01 on. Texts of
    any length are fitted whole; of equal shares the first language by name counts. Repeated rows are alike.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        got = shared.value.predict(batch.column(1).to_pylist(), penalty)
        return {
            "doc_id": batch.column(0),
            "held_out": [not learned_from(i) for i in batch.column(0).to_pylist()],
            "lang_pred": [x for x, _, _ in got],
            "score": [x for _, x, _ in got],
            "mixture": [x for _, _, x in got],
        }

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, mixture string")


def keep_identified(docs: DataFrame, model: Model, penalty: float = 1.0) -> DataFrame:
    """The documents, with all their columns, that are in some learned language or in a mixture of several.

    The mixture of every whole text is fitted as in ``identify``. Null texts, texts without a letter and those whose
    words no language of their mixture explains (``Model.identified``) go. If no language was learned, or one from few
    texts, every text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: shared.value.identified(texts, penalty))
