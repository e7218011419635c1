"""N-gram language model as a weighted backoff automaton.

Every context with a count in the training documents is a state, every n-gram with a count an arc of its context's
state. A state ``h`` has a failure arc to the state of its longest proper suffix, of weight ``m / (c(h) + m)``; an arc
for word ``w`` weighs ``(c(hw) + m * p(w | suffix)) / (c(h) + m)``, so what follows a failure arc is exactly the share
left to unseen words and each state's outgoing probabilities sum to one. The root's arcs are the add-half unigrams,
one of them for all unknown words. A text is read once from left to right: failure arcs are taken until the state has
an arc for the next word, the log weights are added up, and the arc's target is carried on.

The mass ``m`` of a context length is estimated from all counts: with it, the failure arcs of the training tokens
(each left out of its own context) weigh on average what Good and Turing estimate for unseen words, the share of
n-grams found once.

No table of the model is ever held whole. The corpus is written once as chunks of coded tokens. A chunk asks for the
counts of its own distinct n-grams: their hashes, sorted, with its training counts, cut by value into ``PARTS`` rows a
length. A bucket adds up what all chunks have and answers each in the same order. Frequent words cost one key a chunk,
so no key is hot. Where a bucket would hold more than ``BUCKET_KEYS`` keys, ``FAN`` chunks are merged first and the
merged keys cut ``PARTS`` times finer, again and again; so a chunk costs a constant number of rows a level, and the
levels grow with the logarithm of the corpus. With the answers each chunk builds the part of the automaton that its
texts can reach, and scores them.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, doc_texts, materialize, partitions, prepare, release

#: Token codes of a chunk: 0 is the end of a text, words follow; the start of a text is only a context.
END, START = 0, -1
CHUNK_TOKENS = 3 << 18
#: Rows a chunk and n-gram length (a power of two), keys of a bucket, and sources merged where a bucket would hold more.
PARTS, BUCKET_KEYS, FAN = 64, 1 << 22, 64
#: A hash of an n-gram has so many bits more than the number of n-grams; words have all 64.
SPARE_BITS = 16
#: Tokens of a text that are read as one lane; a lane first reads the words that decide its state.
LANE = 512

_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def held_out(doc_id: int | None) -> bool:
    """Not learned from: crc32 of the id as text leaves 1 when divided by 5. A null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit key for the pair (x, y)."""
    h = (x ^ (y * _GOLD)) * _MIX
    h ^= h >> np.uint64(29)
    h = (h + y) * _GOLD
    return h ^ (h >> np.uint64(32))


def _pack(a: np.ndarray) -> bytes:
    """Bytes by significance, compressed: sorted keys and small counts have empty planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


CHUNK = "chunk string, doc_ids array<long>, sizes binary, words binary, tokens binary"


def write_chunks(docs: DataFrame) -> DataFrame:
    """The corpus as chunks: ids and lengths of the texts, hashes of the chunk's words, and the coded tokens."""
    out = arrow_schema(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        sizes: list[int] = []
        codes: list[np.ndarray] = []
        code: defaultdict[bytes, int] = defaultdict()
        code.default_factory = lambda: len(code) + 1
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal n
            hashes = np.fromiter([1] + [xxhash.xxh64_intdigest(w) for w in code], np.uint64, len(code) + 1)
            row = {"chunk": [uuid.uuid4().hex], "doc_ids": [list(ids)], "sizes": [_pack(np.array(sizes, np.int32))], "words": [hashes.tobytes()], "tokens": [_pack(np.concatenate(codes))]}
            ids.clear(), sizes.clear(), codes.clear(), code.clear()
            n = 0
            return pa.RecordBatch.from_pydict(row, schema=out)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(text)
                coded = np.fromiter([code[w] for w in ws] + [END], np.int32, len(ws) + 1)
                ids.append(doc)
                sizes.append(len(coded))
                codes.append(coded)
                n += len(coded)
                if n >= CHUNK_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return materialize(doc_texts(docs).mapInArrow(run, CHUNK), "lm-chunks")


class Chunk:
    """A chunk's distinct n-grams by length, and where they stand.

    By length (from 1): ``keys`` (hashes, ``bits`` of them but for words), ``counts`` in training texts, ``head`` (the
    n-gram without its last word, START for the start of a text), ``tail`` (the last word), ``suffix`` (the n-gram
    without its first word), as indices among the n-grams of one word less.
    """

    def __init__(self, doc_ids: list[int | None], sizes: bytes, hashes: bytes, tokens: bytes, order: int, bits: int = 64):
        self.doc_ids, self.order = doc_ids, order
        self.sizes = _unpack(sizes, "i4").astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.out = np.array([held_out(d) for d in doc_ids], bool)
        train = np.repeat(~self.out, self.sizes)
        words = np.frombuffer(hashes, np.uint64)
        self.token = _unpack(tokens, "i4").astype(np.int64)
        self.keys, self.counts = [words], [np.bincount(self.token[train], minlength=len(words))]
        self.head, self.tail, self.suffix = [None], [None], [None]
        place = np.arange(len(self.token)) - np.repeat(self.first, self.sizes)
        wide = words
        index = self.token
        for k in range(1, order):
            # An n-gram of k + 1 words ends k - 1 words after the first of its text, or later: the start is one of them.
            at = np.flatnonzero(place >= k - 1)
            before = np.where(place[at] > 0, index[at - 1], START) if k == 1 else index[at - 1]
            distinct, where, inverse = np.unique((before + 1) * len(words) + self.token[at], return_index=True, return_inverse=True)
            head, tail = np.divmod(distinct, len(words))
            head -= 1
            self.head.append(head)
            self.tail.append(tail)
            self.suffix.append(index[at][where])
            # As a context the start of a text has a key of its own.
            wide = mix(np.where(head < 0, np.uint64(2), wide[head]), words[tail] + np.uint64(k))
            self.keys.append(wide >> np.uint64(64 - bits) << np.uint64(64 - bits))
            self.counts.append(np.bincount(inverse[train[at]], minlength=len(distinct)))
            index = np.full(len(self.token), START)
            index[at] = inverse

    def asks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(length, part, keys, counts), keys ascending."""
        for k in range(self.order):
            by = np.argsort(self.keys[k], kind="stable")
            for part, lo, hi in parts(self.keys[k][by], 1):
                yield k + 1, part, self.keys[k][by[lo:hi]], self.counts[k][by[lo:hi]].astype(np.uint64)

    def totals(self, answers: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
        """Answers by length, part after part, as counts in the order of the n-grams."""
        out = []
        for k in range(self.order):
            total = np.zeros(len(self.keys[k]), np.float64)
            if k + 1 in answers:
                total[np.argsort(self.keys[k], kind="stable")] = np.concatenate(answers[k + 1])
            out.append(total)
        return out


def parts(keys: np.ndarray, level: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of ascending keys by their highest bits: ``PARTS`` to the power of ``level`` parts."""
    part = keys >> np.uint64(64 - level * (PARTS.bit_length() - 1))
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    yield from ((int(part[lo]), int(lo), int(hi)) for lo, hi in zip(cut, cut[1:], strict=False))


def _grouped(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with the same key of a sorted partition."""
    held, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and tuple(row[k] for k in key) != held:
                yield held, rows
                rows = []
            held = tuple(row[k] for k in key)
            rows.append(row)
    if rows:
        yield held, rows


ASK = "src string, length int, part long, keys binary, counts binary"
GIVE = "src string, length int, part long, totals binary, sums binary"
_ASK = pa.schema([("src", pa.string()), ("length", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_GIVE = pa.schema([("src", pa.string()), ("length", pa.int32()), ("part", pa.int64()), ("totals", pa.binary()), ("sums", pa.binary())])
#: Classes of counts: about 16 to each doubling; with the number of n-grams and the sum of their counts.
CLASSES = 16 * 64


def _ask(src: str, length: int, part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    row = {"src": [src], "length": [length], "part": [part], "keys": [_pack(np.diff(keys, prepend=np.uint64(0)))], "counts": [_pack(counts)]}
    return pa.RecordBatch.from_pydict(row, schema=_ASK)


def _give(src: str | None, length: int, part: int, totals: np.ndarray | None, sums: np.ndarray | None) -> pa.RecordBatch:
    row = {"src": [src], "length": [length], "part": [part], "totals": [None if totals is None else _pack(totals)], "sums": [None if sums is None else sums.tobytes()]}
    return pa.RecordBatch.from_pydict(row, schema=_GIVE)


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of some asks, their counts, and where each ask's keys are among them."""
    keys = [np.cumsum(_unpack(r["keys"], "u8"), dtype=np.uint64) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    # Sums of at most 2^53 are exact in the weights of bincount.
    total = np.bincount(at, weights=np.concatenate([_unpack(r["counts"], "u8") for r in rows]), minlength=len(distinct)).astype(np.uint64)
    return distinct, total, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


def count_classes(total: np.ndarray) -> np.ndarray:
    """Tokens, types, n-grams found once, then the number of n-grams and the sum of their counts by class of count."""
    total = total[total > 0].astype(np.float64)
    kind = np.minimum((np.log2(total) * 16).astype(np.int64), CLASSES - 1)
    return np.concatenate([[total.sum(), len(total), (total == 1).sum()], np.bincount(kind, minlength=CLASSES), np.bincount(kind, weights=total, minlength=CLASSES)])


def resolve(asks: DataFrame, keys: float, sources: int, level: int = 1) -> DataFrame:
    """The corpus counts that answer every ask (``GIVE``); rows without a source have the sums of a bucket.

    ``keys``: about the keys of one length in all asks; ``sources``: about the different ``src``.
    """
    spark = asks.sparkSession
    if sources <= 1 or keys / PARTS**level <= BUCKET_KEYS:

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (length, part), rows in _grouped(batches, "length", "part"):
                _, total, at = _merged(rows)
                for r, k in zip(rows, at, strict=True):
                    yield _give(r["src"], length, part, total[k], None)
                yield _give(None, length, part, None, count_classes(total))

        return materialize(asks.repartition(partitions(spark), "length", "part").sortWithinPartitions("length", "part").mapInArrow(answer, GIVE), "lm-counts")
    fewer = -(-sources // FAN)
    asks = materialize(asks.withColumn("to", F.concat(F.lit(f"{level}."), F.pmod(F.xxhash64("src"), F.lit(fewer)).cast("string"))), "lm-asks")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (to, length, _), rows in _grouped(batches, "to", "length", "part"):
            keys, total, _ = _merged(rows)
            for part, lo, hi in parts(keys, level + 1):
                yield _ask(to, length, part, keys[lo:hi], total[lo:hi])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, length, part), rows in _grouped(batches, "to", "length", "part"):
            given = np.concatenate([_unpack(r["totals"], "u8") for r in rows if r["src"] is None])
            own = [r for r in rows if r["src"] is not None]
            for r, k in zip(own, _merged(own)[2], strict=True):
                yield _give(r["src"], length, part, given[k], None)

    key = ["to", "length", "part"]
    above = resolve(asks.repartition(partitions(spark), *key).sortWithinPartitions(*key).mapInArrow(merge, ASK), keys, fewer, level + 1)
    back = above.filter("src is not null").select(F.lit(None).cast("string").alias("src"), "length", F.expr(f"part div {PARTS}").alias("part"), "totals", F.col("src").alias("to"), F.col("part").alias("finer"))
    both = asks.unionByName(back, allowMissingColumns=True).repartition(partitions(spark), *key).sortWithinPartitions(*key, "finer")
    out = materialize(both.mapInArrow(share, GIVE).unionByName(above.filter("src is null")), "lm-counts")
    release(asks)
    release(above)
    return out


def corpus_sums(counts: DataFrame, order: int) -> np.ndarray:
    """``count_classes`` of the whole corpus by n-gram length; the buckets of a task are added up there."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[length] = total.get(length, 0.0) + np.frombuffer(x, np.float64)
        if total:
            yield pa.RecordBatch.from_pydict({"length": list(total), "sums": [x.tobytes() for x in total.values()]}, schema=schema)

    schema = arrow_schema("length int, sums binary")
    out = np.zeros((order + 1, 3 + 2 * CLASSES))
    for r in counts.filter("src is null").select("length", "sums").mapInArrow(add, "length int, sums binary").collect():
        out[r["length"]] += np.frombuffer(bytes(r["sums"]), np.float64)
    return out


def mass_of(sums: np.ndarray, once: float) -> float:
    """The mass at which the failure arcs of contexts with these sums weigh as much as the n-grams found once."""
    n, total = sums[3 : 3 + CLASSES], sums[3 + CLASSES :]
    n, total = n[n > 0], total[n > 0]
    mean = total / n
    lo, hi = 1e-3, 1e6
    for _ in range(80):
        m = (lo * hi) ** 0.5
        lo, hi = (m, hi) if (total * m / (mean - 1 + m)).sum() < once else (lo, m)
    return float((lo * hi) ** 0.5)


class Automaton:
    """The part of the automaton that a chunk's texts can reach.

    State 0 is the root, 1 the start of a text, then come the words and the longer contexts; those without a count
    have no arc to them. ``fail`` and ``back``: target and log10 weight of each state's failure arc. ``arc``: state and
    word of each arc, ascending, with its log10 weight and target. The root has an arc for every word.
    """

    def __init__(self, chunk: Chunk, totals: list[np.ndarray], tokens: int, types: int, mass: list[float]):
        self.words = len(totals[0])
        share = (totals[0] + 0.5) / (tokens + 0.5 * (types + 1))
        base = 2 + np.r_[0, np.cumsum([len(t) for t in totals])]
        self.root = np.log10(share)
        self.root_next = np.where(totals[0] > 0, 2 + np.arange(self.words), 0)
        self.fail, self.back = np.zeros(base[len(totals) - 1], np.int64), np.zeros(base[len(totals) - 1])
        arcs, weights, targets = [], [], []
        count = np.r_[totals[0], totals[0][END]]  # the last stands for START, which is -1
        for k in range(1, len(totals)):
            head, tail, suffix, total = chunk.head[k], chunk.tail[k], chunk.suffix[k], totals[k]
            m = mass[k - 1]
            n = count[head]
            # An n-gram of two words has a word as suffix; the suffix's probability is that of the shorter context.
            share = (total + m * share[suffix]) / (n + m)
            states = np.unique(head)
            source = np.where(states == START, 1, base[k - 1] + states) if k == 1 else base[k - 1] + states
            self.back[source] = np.log10(m / (count[states] + m))
            seen = np.flatnonzero(total > 0)
            arcs.append((np.where(head == START, 1, base[k - 1] + head) if k == 1 else base[k - 1] + head)[seen] * self.words + tail[seen])
            weights.append(np.log10(share[seen]))
            if k + 1 < len(totals):  # an n-gram that is a context itself
                targets.append(base[k] + seen)
                self.fail[base[k] + seen] = base[k - 1] + suffix[seen]
            else:
                targets.append((base[k - 1] + suffix[seen]) if k > 0 else np.zeros(len(seen), np.int64))
            count = total
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        arc = join(arcs, np.int64)
        by = np.argsort(arc, kind="stable")
        self.arc, self.weight, self.target = np.r_[arc[by], np.iinfo(np.int64).max], join(weights, np.float64)[by], join(targets, np.int64)[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the log10 weight of the way there, for many states and words."""
        state, score, after = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.flatnonzero(state)
        top = state == 0
        while len(todo):
            key = state[todo] * self.words + word[todo]
            at = np.searchsorted(self.arc, key)
            hit = self.arc[at] == key
            found, at = todo[hit], at[hit]
            score[found] += self.weight[at]
            after[found] = self.target[at]
            todo = todo[~hit]
            score[todo] += self.back[state[todo]]
            state[todo] = self.fail[state[todo]]
            top[todo[state[todo] == 0]] = True
            todo = todo[state[todo] > 0]
        score[top] += self.root[word[top]]
        after[top] = self.root_next[word[top]]
        return after, score

    def read(self, token: np.ndarray, first: np.ndarray, sizes: np.ndarray, order: int, lane: int = LANE) -> np.ndarray:
        """Log10 weight of each text, read from left to right.

        Long texts are read in several lanes at once. The state before a lane is decided by the ``order - 1`` words
        before it, which the lane reads first without adding them up.
        """
        if order == 1:
            return np.add.reduceat(self.root[token], first)
        pieces = -(-sizes // lane)
        text = np.repeat(np.arange(len(sizes)), pieces)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * lane
        warm = np.minimum(offset, order - 1)
        begin, length = first[text] + offset - warm, np.minimum(lane, sizes[text] - offset) + warm
        by = np.argsort(-length, kind="stable")
        begin, length, warm = begin[by], length[by], warm[by]
        state = np.where(offset[by] == warm, 1, 0)  # at the start of the text, or after words that decide the state
        total = np.zeros(len(by))
        ends = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for k, n in enumerate(ends.tolist()):
            state[:n], score = self.step(state[:n], token[begin[:n] + k])
            total[:n] += np.where(warm[:n] <= k, score, 0.0)
        return np.bincount(text[by], weights=total, minlength=len(sizes))


def score_documents(docs: DataFrame, order: int = 3, mass: list[float] | None = None) -> DataFrame:
    """Scores every whole text with a model learned from the texts that are not held out.

    Returns ``doc_id``, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-half unigrams) and ``score`` (the automaton), both log10. Null and
    empty texts are one end token. Repeated rows count and are scored each; without training texts every token
    has probability one in the base. A text of any length is one row of a chunk and read in lanes. ``mass``: of the
    contexts of one word and up, else estimated. Words are told apart by a 64-bit hash.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    prepare(spark)
    chunks = write_chunks(docs)
    sources = chunks.count()
    bits = min(64, (sources * CHUNK_TOKENS * order).bit_length() + SPARE_BITS)
    names = [f.name for f in chunks.schema if f.name != "chunk"]

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (row,) in _grouped(batches, "chunk"):
            for ask in Chunk(*(row[x] for x in names), order, bits).asks():
                yield _ask(row["chunk"], *ask)

    counts = resolve(chunks.mapInArrow(request, ASK), sources * CHUNK_TOKENS, sources)
    sums = corpus_sums(counts, order)
    tokens, types = int(sums[1][0]), int(sums[1][1])
    mass = mass or [mass_of(sums[k], sums[k + 1][2]) for k in range(1, order)]
    mass = [*mass, *[mass[-1]] * order] if mass else []
    union = chunks.unionByName(counts.filter("src is not null").select(F.col("src").alias("chunk"), "length", "part", "totals"), allowMissingColumns=True)
    dealt = union.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "length", "part")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (head, *rows) in _grouped(batches, "chunk"):
            c = Chunk(*(head[x] for x in names), order, bits)
            answers: dict[int, list[np.ndarray]] = {}
            for r in rows:
                answers.setdefault(r["length"], []).append(_unpack(r["totals"], "u8"))
            totals = c.totals(answers)
            model = Automaton(c, totals, tokens, types, mass)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": c.doc_ids,
                    "held_out": c.out,
                    "n_tokens": c.sizes,
                    "n_known": np.add.reduceat((totals[0][c.token] > 0).astype(np.int64), c.first),
                    "train_tokens": np.full(len(c.sizes), tokens),
                    "base_score": np.add.reduceat(model.root[c.token], c.first),
                    "score": model.read(c.token, c.first, c.sizes, order),
                },
                schema=out,
            )

    return dealt.mapInArrow(run, schema)
