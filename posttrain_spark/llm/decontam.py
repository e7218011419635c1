"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters, digits and other signs beyond ASCII, in lower case; ASCII signs, white space and the
common signs of three bytes and less part them, and a character from U+3040 to U+D7FF (kana, Han, Hangul) is a word alone. Documents and items go through the
same code, and a word is the 64-bit hash of its bytes from then on.

1. Corpus statistics: in how many documents each word occurs (words hashed to ``FEATURES``), over all documents.
2. A randomised SVD (Gaussian range finder, power steps) of TF-IDF passages gives one latent space of ``RANK``
   dimensions. Its rows are all passages of all documents and of the benchmark (these with more weight), its products
   are distributed, the table of words by dimensions stays in the shared folder until it is the space, and its words are those of benchmark rows or of ``ROWS`` document rows. Words that stand together in
   documents point the same way there, so a paraphrase by other words is near its source.
3. Every document is projected whole, in windows of 16, 32 and 64 words at every eighth word. A passage of the
   benchmark is compared with all windows of the size next to its own; a latent cosine of ``COSINE`` or more makes a
   candidate. One goes on if its surroundings hold ``RARE`` of the passage's rarer words (fewer for short passages),
   as every region does that step 4 accepts for that passage.
   Beside that, items are searched by pairs of neighbouring words and items of fewer than ``RUN`` words as they stand,
   which finds exact copies that are shorter than a window.
4. A candidate region is a leak if the longest common subsequence of words with the item, or with the passage that
   matched, is long enough, or is fairly long and the region also holds its answer terms: its rarest words by document
   frequency. ``RUN`` consecutive words of an item are a leak alone.

The benchmark is worked off in blocks of about ``BLOCK_WORDS`` words: what is broadcast at a time is one block and the
space, whose size is fixed by the parameters, whatever the benchmark and the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, doc_texts, fresh_path, keep_rows, map_batches, materialize, prepare, release

FEATURES = 1 << 18
SLICES = 16
PASSAGE, STRIDE = 48, 24
#: Words of the items that are searched together; an item is never split.
BLOCK_WORDS = 1 << 20
#: Dimensions of the latent space, and those that the range finder has beside them; power steps.
RANK, OVERSAMPLE, POWER = 64, 8, 2
#: Rows of documents that a word must be in to have a vector, unless a benchmark row holds it.
ROWS = 3
#: Tasks that multiply with the rows of the fit, at least, and the rows of a task beyond that.
FITTING, FIT_ROWS = 4, 1 << 19
#: Rows of the fit that are written together, and the bytes of a row group of them, which Spark's reader unpacks at once.
WRITTEN, GROUP_BYTES = 1 << 10, 16 << 20
#: Rows that are multiplied together, and words of them that are gathered at once.
TOGETHER, GATHERED = 1 << 16, 1 << 13
#: Deletes the shuffled parts of a sum when it is there.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Weight of a benchmark row in the fit beside four document rows of weight 1 for each of up to so many documents; its
#: square goes with the rows there are, so that the benchmark's share doesn't fall as a corpus grows.
EMPHASIS, BESIDE = 3.0, 8_192
#: Words of a step; steps of the windows, and the words of the passages that each window size is for, at most.
STEP = 8
SCALES = {2: 20, 4: 40, 8: PASSAGE}
#: Steps around a window that belong to its surroundings.
AROUND = 3
#: Steps searched at once.
AT_ONCE = 4_096
COSINE = 0.6
#: Common subsequence as a share of the item's words: enough alone; enough with this share of the answer terms.
LCS_ALONE, LCS_WITH, ANSWER_TERMS, ANSWER_SHARE = 0.7, 0.5, 5, 0.8
#: Rarer words of a passage that a candidate's surroundings must hold: four of five answer terms, or of the rarest words.
RARE = 4
#: Consecutive words of an item that are a leak alone; the whole of a shorter one.
RUN = 13
#: Passages of fewer words have no pairs left to tell a changed copy by.
PAIRED = 8
#: Bytes whose words are hashed together.
PIECE = 1 << 16

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True
#: A word's hash is the sum of its bytes' values times powers of an odd number, taken from running sums over a piece.
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            table = np.full(max(n, PIECE), base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS


def _separators(raw: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Takes signs of two and three bytes out of ``word``; returns where characters start that are words alone."""
    high = np.flatnonzero(raw >= 0xC2)
    if not len(high):
        return high
    lead, second, third = raw[high], raw[np.minimum(high + 1, len(raw) - 1)], raw[np.minimum(high + 2, len(raw) - 1)]
    two = high[(lead == 0xC2) & (second != 0xAA) & (second != 0xB5) & (second != 0xBA)]
    # U+2000 to U+206F, U+3000 to U+303F, and the full-width signs before the digits.
    three = high[(lead == 0xE2) & ((second == 0x80) | (second == 0x81) & (third < 0xB0)) | (lead == 0xE3) & (second == 0x80) | (lead == 0xEF) & (second == 0xBC) & (third < 0x90)]
    for at, n in ((two, 2), (three, 3)):
        for k in range(n):
            word[at + k] = False
    return high[(lead >= 0xE3) & (lead <= 0xED) & word[high]]


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, and the number of words of each text."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    if not len(low) or low.buffers()[2] is None:
        return np.zeros(0, np.uint64), np.zeros(len(low), np.int64)
    at = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
    raw = np.frombuffer(low.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word = _WORD[raw]
    alone = _separators(raw, word)
    edge = np.ones(len(raw) + 1, bool)
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    edge[at] = edge[alone] = edge[np.minimum(alone + 3, len(raw))] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = word[starts]
    starts, ends = starts[real], ends[real]
    out, sums = np.empty(len(starts), np.uint64), np.zeros(1, np.uint64)
    k = 0
    while k < len(starts):  # whole words of about PIECE bytes at a time
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, side="right")))
        lo, hi = int(starts[k]), int(ends[j - 1])
        power, back = _powers(hi - lo + 1)
        if len(sums) <= hi - lo:
            sums = np.zeros(hi - lo + 1, np.uint64)
        part = sums[1 : hi - lo + 1]
        np.take(_VALUE, raw[lo:hi], out=part)
        part *= power[: hi - lo]
        np.cumsum(part, out=part)
        a = starts[k:j] - lo
        out[k:j] = (sums[ends[k:j] - lo] - sums[a]) * back[a]
        k = j
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out, np.diff(np.searchsorted(starts, at))


def text_words(text: str) -> np.ndarray:
    return batch_words(pa.array([text], pa.large_string()))[0]


def features(words: np.ndarray) -> np.ndarray:
    """1 to FEATURES - 1, by the highest bits; 0 is for what is no word."""
    return np.maximum(words >> np.uint64(64 - FEATURES.bit_length() + 1), np.uint64(1)).astype(np.int64)


def _pack(x: np.ndarray) -> dict:
    return {"part": [zstandard.ZstdCompressor(level=1).compress(x.tobytes())], "kind": [x.dtype.str]}


def _unpack(part: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(part)), kind)


def _sum_slices(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], last: Callable[[np.ndarray], dict], fields: str) -> dict[int, Row]:
    """The arrays, of equal shape, that ``part`` makes of each task's rows are cut into ``SLICES`` along the first axis,
    which as many tasks add up. The driver gets what ``last`` makes of each slice's flat sum, nothing if no array is made.
    """
    ddl = "slice int, part binary, kind string"
    between, schema = arrow_schema(ddl), arrow_schema(f"slice int, {fields}")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = part(batches)
        if made is not None:
            yield from (pa.RecordBatch.from_pydict({"slice": [k]} | _pack(x), schema=between) for k, x in enumerate(np.array_split(made, SLICES)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[k] = total[k] + _unpack(x, kind) if k in total else _unpack(x, kind)
        yield from (pa.RecordBatch.from_pydict({"slice": [k]} | last(x), schema=schema) for k, x in total.items())

    conf = rows.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return {r["slice"]: r for r in rows.mapInArrow(make, ddl).repartition(SLICES, "slice").mapInArrow(add, f"slice int, {fields}").collect()}
    finally:
        conf.set(CLEANUP, before)


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """Sum of the one-dimensional arrays, of equal length, that ``part`` makes of each task's rows; None if none is made."""
    got = _sum_slices(rows, part, _pack, "part binary, kind string")
    return np.concatenate([_unpack(got[k]["part"], got[k]["kind"]) for k in range(SLICES)]) if got else None


def weights(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency of each feature over the whole table; 0 for what is no word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total, docs = np.zeros(FEATURES, np.int64), 0
        last = np.zeros(FEATURES, np.int64)
        for batch in batches:
            words, sizes = batch_words(batch.column(0))
            docs += len(sizes)
            codes, place, at = features(words), np.arange(len(words)), 0
            for n in sizes.tolist():
                f, here = codes[at : at + n], place[at : at + n]
                last[f] = here
                total[f[last[f] == here]] += 1  # one place of each feature
                at += n
        total[0] = docs  # no word has this feature
        return total if docs else None

    frequency = summed(texts.select("text"), scan)
    if frequency is None:
        frequency = np.zeros(FEATURES, np.int64)
    idf = np.log((frequency[0] + 1) / (frequency + 1)) + 1e-3
    idf[0] = 0
    return idf


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine-word-parallel step for each word of b."""
    at: dict = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = at.get(w, 0)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def rarest(words: np.ndarray, idf: np.ndarray) -> set[int]:
    """The answer terms of some words; ties by hash."""
    distinct = np.unique(words)
    return set(distinct[np.lexsort((distinct, -idf[features(distinct)]))[:ANSWER_TERMS]].tolist())


def passages_of(words: np.ndarray) -> list[np.ndarray]:
    """The different passages of an item."""
    cut = (words[lo : lo + PASSAGE] for lo in range(0, max(1, len(words) - PASSAGE + STRIDE), STRIDE))
    return list({p.tobytes(): p for p in cut}.values())


class Space:
    """The latent space: the vector of each feature (0: none), times the word's weight."""

    def __init__(self, idf: np.ndarray, row: np.ndarray, vectors: np.ndarray):
        """``row``: of each feature in ``vectors``, of which the first is that of no vector."""
        self.idf = idf.astype(np.float32)
        self.row, self.vectors = row, vectors
        held = np.flatnonzero(row)
        for at in np.array_split(held, max(1, len(held) // GATHERED)):  # no second table beside it
            vectors[row[at]] *= self.idf[at][:, None]

    def sums(self, feats: np.ndarray) -> np.ndarray:
        """Sums of the vectors of each row of features."""
        out, step = np.empty((len(feats), self.vectors.shape[1]), np.float32), max(1, GATHERED // feats.shape[1])
        held, ones = np.empty((step, feats.shape[1], out.shape[1]), np.float32), np.ones((1, feats.shape[1]), np.float32)
        for a in range(0, len(feats), step):
            row = self.row[feats[a : a + step]]
            np.take(self.vectors, row, axis=0, mode="clip", out=held[: len(row)])  # any other mode gathers in a second table
            np.matmul(ones, held[: len(row)], out=out[a : a + step, None])
        return out

    def of(self, feats: np.ndarray) -> np.ndarray:
        """Direction of a passage; zeros if none of its words has a vector."""
        v = self.vectors[self.row[feats]].sum(0)
        return v / max(float(np.linalg.norm(v)), 1e-12)


def fit(rows: DataFrame, idf: np.ndarray, rank: int = RANK) -> Space:
    """Randomised SVD of TF-IDF rows as ``_passages`` packs them, with ``emphasis double``, their weight, and ``item boolean``.

    Every product with the rows is a distributed job, which leaves the table of words by dimensions in the shared folder.
    """
    spark = rows.sparkSession
    n = rows.agg(F.sum("passages")).first()[0] or 0
    rows = rows.coalesce(max(FITTING, n // FIT_ROWS))  # each task makes a table of words by dimensions

    def held(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(FEATURES, np.int64)
        for words, sizes, _, item in _grouped(batches, 1):
            first = np.r_[True, words[1:] != words[:-1]]  # a row's words are sorted
            first[np.cumsum(sizes[:-1])] = True
            total += np.bincount(words[first], np.repeat(np.where(item, ROWS, 1), sizes)[first], FEATURES).astype(np.int64)
        return total if total.any() else None

    count = summed(rows, held)
    used = np.flatnonzero(count >= ROWS) if count is not None else np.zeros(0, np.int64)
    used = used[np.argsort(-count[used], kind="stable")] if len(used) else used  # common words lie together in memory
    place = np.zeros(FEATURES, np.int32)  # the first row of a table stands for words without a vector
    place[used] = np.arange(1, len(used) + 1)
    nothing = Space(idf, place, np.zeros((len(used) + 1, 1), np.float32))
    if not len(used):
        return nothing
    shape = len(used), min(len(used), rank + OVERSAMPLE)
    shared = spark.sparkContext.broadcast((place, idf[used].astype(np.float32)[:, None]))
    table = None
    for _ in range(POWER + 1):

        def product(batches: Iterator[pa.RecordBatch], table=table) -> np.ndarray | None:
            q = total = None
            row, weight = shared.value
            for words, sizes, scale, _ in _grouped(batches, TOGETHER):
                if q is None:
                    q = table.read() if table else np.random.default_rng(5).standard_normal((shape[0] + 1, shape[1]), np.float32)
                    q[0] = 0
                    q[1:] *= weight
                    total = np.zeros_like(q)
                add_product(q, row[words], sizes, scale, total)
            if total is None or not total[1:].any():
                return None
            total[1:] *= weight
            return total[1:]

        made = orthonormal_table(rows, product, table.turn.shape[1] if table else shape[1])
        if table:
            table.release()
        if made is None:
            return nothing
        table = made
    shared.destroy()
    space = Space(idf, place, table.read(rank))
    table.release()
    return space


class Table:
    """Words by dimensions, in as many files of the shared folder as ``SLICES``; each row is to be multiplied by ``turn`` yet."""

    def __init__(self, folder: str, names: list[str], rows: list[int], turn: np.ndarray):
        self.folder, self.names, self.rows, self.turn = folder, names, rows, turn

    def part(self, k: int, turn: np.ndarray) -> np.ndarray:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_stream(f"{root}/{self.names[k]}") as f:
            x = np.frombuffer(f.read(), np.float32).reshape(self.rows[k], len(turn))
        return (x @ turn).astype(np.float32)

    def read(self, dimensions: int | None = None) -> np.ndarray:
        """All rows, after one of zeros."""
        turn = self.turn[:, :dimensions]
        out = np.zeros((sum(self.rows) + 1, turn.shape[1]), np.float32)
        at = 1
        for k, n in enumerate(self.rows):
            out[at : at + n] = self.part(k, turn)
            at += n
        return out

    def release(self) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        fs.delete_dir(root)


def _kept(folder: str, x: np.ndarray) -> dict:
    """Writes rows to a file that no other attempt names; its name, the number of rows and the products of the columns."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{root}/{name}") as f:
        f.write(np.ascontiguousarray(x, np.float32))
    return {"name": [name], "n": [len(x)], "gram": [gram(x).tobytes()]}


def orthonormal_table(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], columns: int) -> Table | None:
    """``orthonormal`` of the sum of the arrays that ``part`` makes of each task's rows; None if none is made.

    Tasks write the slices; the driver gets the products of their columns only.
    """
    spark = rows.sparkSession
    fields = "name string, n long, gram binary"
    schema = arrow_schema(f"slice int, {fields}")
    folders = fresh_path(spark, "table"), fresh_path(spark, "table")

    def table(folder: str, got: dict[int, Row], dimensions: int, again: bool) -> Table:
        g = sum(np.frombuffer(bytes(got[k]["gram"])).reshape(dimensions, dimensions) for k in range(SLICES))
        return Table(folder, [got[k]["name"] for k in range(SLICES)], [got[k]["n"] for k in range(SLICES)], turning(g, again))

    got = _sum_slices(rows, part, lambda x: _kept(folders[0], x.reshape(-1, columns)), fields)
    if not got:
        return None
    first = table(folders[0], got, columns, False)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"slice": [k]} | _kept(folders[1], first.part(k, first.turn)), schema=schema)

    got = {r["slice"]: r for r in spark.range(0, SLICES, 1, SLICES).mapInArrow(turned, f"slice int, {fields}").collect()}
    first.release()
    return table(folders[1], got, first.turn.shape[1], True)


def gram(x: np.ndarray) -> np.ndarray:
    """The products of the columns, in double precision."""
    step = 1 << 14
    return sum((p.T @ p for p in (x[a : a + step].astype(np.float64) for a in range(0, len(x), step))), np.zeros((x.shape[1],) * 2))


def turning(g: np.ndarray, again: bool) -> np.ndarray:
    """What makes columns of these products orthonormal, the largest first, but for those of no length; ``again``: rounding is taken out, and nothing turned."""
    w, v = np.linalg.eigh(g)
    keep = w > w[-1] * 1e-12
    turn = v[:, keep] / np.sqrt(w[keep])
    return turn @ v[:, keep].T if again else turn[:, ::-1]


def orthonormal(x: np.ndarray) -> np.ndarray:
    """The left singular vectors of ``x``, the largest first, but for those of no length, from the products of columns."""
    for again in (False, True):
        x = (x @ turning(gram(x), again)).astype(np.float32)
    return x


def _grouped(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Words in turn, and the size, the weight over length and the kind of each row, of ``least`` rows or somewhat more at a time."""
    held, n = [], 0
    for batch in batches:
        for count, words, sizes, scale, emphasis, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            weight = (np.frombuffer(scale, np.float32) * np.float64(emphasis)).astype(np.float32)
            held.append((np.frombuffer(words, np.int32), np.frombuffer(sizes, np.int32), weight, np.full(count, item)))
            n += count
            if n >= least:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def add_product(q: np.ndarray, words: np.ndarray, sizes: np.ndarray, scale: np.ndarray, total: np.ndarray) -> None:
    """Adds X'Xq to ``total``; X has ``scale`` for each of the ``words`` of a row, of which there are ``sizes``, one at least."""
    latent = np.zeros((len(sizes), q.shape[1]), np.float32)
    _add_runs(q, words, np.cumsum(sizes) - sizes, sizes, latent, np.arange(len(sizes)))
    latent *= (scale * scale)[:, None]
    word = words.astype(np.int64) << 32 | np.repeat(np.arange(len(sizes)), sizes)
    word.sort()
    row = word & 0xFFFFFFFF
    word >>= 32
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    _add_runs(latent, row, first, np.diff(np.r_[first, len(word)]), total, word[first])


def _add_runs(table: np.ndarray, index: np.ndarray, first: np.ndarray, counts: np.ndarray, out: np.ndarray, place: np.ndarray) -> None:
    """Adds to ``out[place[k]]`` the rows of ``table`` that ``index`` names from ``first[k]`` on, ``counts[k]`` of them; no place occurs twice.

    A run is the sum of pieces of the powers of two in its length; those of one length are gathered together.
    """
    held, ones = np.empty((GATHERED, table.shape[1]), table.dtype), np.ones((1, GATHERED), table.dtype)
    longest = GATHERED.bit_length() - 1
    for bit in range(min(longest + 1, int(counts.max(initial=0)).bit_length())):
        n = 1 << bit
        times = counts >> bit if bit == longest else counts >> bit & 1  # a long run has several of the longest, one gathered at a time
        k = np.repeat(np.arange(len(counts)), times)
        start = first[k] + (counts[k] & n - 1) + n * (np.arange(len(k)) - (np.cumsum(times) - times)[k])
        step = GATHERED >> bit
        for a in range(0, len(k), step):
            at = index[start[a : a + step, None] + np.arange(n)]
            rows = held[: at.size].reshape(*at.shape, -1)
            np.take(table, at, axis=0, mode="clip", out=rows)
            out[place[k[a : a + step]]] += np.matmul(ones[:, :n], rows)[:, 0] if n > 1 else rows[:, 0]


class Seeds:
    """Word pairs of items and passages, to find copies whatever the words weigh."""

    def __init__(self, items: list[np.ndarray], passages: list[np.ndarray], owners: list[int]):
        #: By the words of a run: the items that hold it, each with a place of it.
        self.runs: dict[tuple[int, ...], dict[int, int]] = {}
        self.owners = np.array(owners, np.int64)
        keys = [np.zeros(0, np.int64)]
        for k, words in enumerate(items):
            codes = features(words)
            n = min(RUN, len(codes))
            keys.append(pair_keys(codes))
            for lo in range(len(codes) - n + 1):
                self.runs.setdefault(tuple(codes[lo : lo + n].tolist()), {}).setdefault(k, lo)
        self.lone = np.array([x[0] for x in self.runs if len(x) == 1], np.int64)
        self.keys = np.unique(np.concatenate(keys))
        self.bits = min(26, max(20, (64 * len(self.keys)).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.keys)] = True
        # A changed word breaks two pairs: a copy with LCS_ALONE of n words has n - 1 - 2 * changed of them.
        sizes = np.array([len(p) for p in passages], np.int64)
        changed = sizes - np.ceil(LCS_ALONE * sizes - 1e-9).astype(np.int64)
        self.needed, self.reach = np.maximum(1, sizes - 1 - 2 * changed), sizes + changed
        held = [(np.searchsorted(self.keys, np.unique(pair_keys(features(p)))), k) for k, p in enumerate(passages) if len(p) >= PAIRED]
        pair = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in held]])
        order = np.argsort(pair, kind="stable")
        self.posted = np.concatenate([np.zeros(0, np.int64), *[np.full(len(x), k) for x, k in held]])[order]
        self.post_at = np.searchsorted(pair[order], np.arange(len(self.keys) + 1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_ODD)) >> np.uint64(64 - self.bits)

    def pairs(self, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known pairs, and which they are; ``owner``: text of each word."""
        if len(codes) < 2 or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = pair_keys(codes)
        at = np.nonzero(self.table[self._slot(keys)])[0]
        at = at[owner[at + 1] == owner[at]]
        which = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        known = self.keys[which] == keys[at]
        return at[known], which[known]

    def find_runs(self, codes: np.ndarray, owner: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, place in ``codes``, place in the item, length) of every run."""
        out = []
        for n in {len(x) for x in self.runs}:
            if n == 1:
                whole = np.nonzero(np.isin(codes, self.lone))[0]
            else:  # n - 1 pairs in a row: the (n - 2)th after this one is as many places on
                whole = at[: len(at) - n + 2][at[n - 2 :] - at[: len(at) - n + 2] == n - 2] if len(at) > n - 2 else at[:0]
            for i in whole.tolist():
                for item, lo in self.runs.get(tuple(codes[i : i + n].tolist()), {}).items():
                    out.append((int(owner[i]), item, i, lo, n))
        return out

    def find_changed(self, owner: np.ndarray, at: np.ndarray, which: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first place, end place, passage) of regions with enough of a passage's pairs."""
        counts = self.post_at[which + 1] - self.post_at[which]
        first = np.repeat(self.post_at[which] - np.cumsum(counts) + counts, counts)
        passage, place = self.posted[first + np.arange(len(first))], np.repeat(at, counts)
        order = np.lexsort((place, passage))
        passage, place = passage[order], place[order]
        last = np.arange(len(place)) + self.needed[passage] - 1
        start = np.nonzero(last < len(place))[0]
        last = last[start]
        near = (passage[last] == passage[start]) & (place[last] - place[start] <= self.reach[passage[start]]) & (owner[place[last]] == owner[place[start]])
        start, last = start[near], last[near]
        return list(zip(*(x.tolist() for x in (owner[place[start]], self.owners[passage[start]], place[start], place[last] + 2, passage[start])), strict=True))


def pair_keys(codes: np.ndarray) -> np.ndarray:
    return codes[:-1] * FEATURES + codes[1:]


def holds(words: list, part: list, at: int) -> int:
    """Where ``part`` stands in ``words``, first looked for at ``at``; -1 if nowhere."""
    n = len(part)
    if words[at : at + n] == part:
        return at
    return next((k for k in range(len(words) - n + 1) if words[k] == part[0] and words[k : k + n] == part), -1)


class Block:
    """Some items, what is needed to find them, and the check of what is found."""

    def __init__(self, ids: list[int | None], items: list[np.ndarray], space: Space):
        self.ids, self.items = ids, [x.tolist() for x in items]
        cut = [passages_of(x) for x in items]
        passages = [p for ps in cut for p in ps]
        self.owners = [k for k, ps in enumerate(cut) for _ in ps]
        self.answers = [rarest(x, space.idf) for x in items]
        self.passages = [(p.tolist(), rarest(p, space.idf)) for p in passages]
        self.seeds = Seeds(items, passages, self.owners)
        latent = np.array([space.of(features(p)) for p in passages], np.float32)
        sizes = np.array([len(p) for p in passages])
        found = np.abs(latent).sum(1) > 0
        #: By window size: the passages it is for, and their directions.
        self.sides = {}
        least = 0
        for scale, most in SCALES.items():
            k = np.flatnonzero(found & (sizes > least) & (sizes <= most))
            self.sides[scale] = (k, np.ascontiguousarray(latent[k].T))
            least = most
        # Of n words that agree but for a share, all but the commonest n - agreeing + needed hold at least ``needed``. The
        # passages of an item in several agree in half of their words at least when the item is a leak without answers.
        alone = np.array([len(ps) == 1 for ps in cut for _ in ps], bool)
        agreeing = np.ceil(np.where(alone, LCS_ALONE, LCS_WITH) * sizes - 1e-9).astype(np.int64)
        terms = np.array([len(answer) for _, answer in self.passages])
        self.needed = np.minimum(np.minimum(RARE, agreeing), np.ceil(ANSWER_SHARE * terms - 1e-9).astype(np.int64))
        rare = []
        for k, (p, (_, answer)) in enumerate(zip(passages, self.passages, strict=True)):
            f = features(p)
            f = f[np.argsort(-space.idf[f], kind="stable")[: len(p) - agreeing[k] + self.needed[k]]]
            rare.append(np.union1d(f, features(np.array(sorted(answer), np.uint64))))
        owner, f = np.repeat(np.arange(len(rare)), [len(x) for x in rare]), np.concatenate(rare)
        self.bits = max(16, (32 * len(f)).bit_length())
        self.rare = np.zeros(1 << self.bits, bool)
        self.rare[self._slot(owner, f)] = True
        self.some = np.zeros(FEATURES, bool)
        self.some[f] = True

    def _slot(self, passage: np.ndarray, f: np.ndarray) -> np.ndarray:
        return ((passage.astype(np.uint64) << np.uint64(32) | f.astype(np.uint64)) * np.uint64(_ODD)) >> np.uint64(64 - self.bits)

    def near(self, space: Space, codes: np.ndarray, sizes: np.ndarray, agreeing: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, passage, first word, end word, cosine) of all windows near a passage, as arrays; words count from the text's start.

        ``agreeing``: only those whose surroundings hold enough of the passage's rarer words.
        """
        widest = max(SCALES)
        steps = -(-sizes // STEP)
        # Between texts lie as many empty steps (feature 0: no weight) as windows and their surroundings reach.
        base = AROUND + np.r_[0, np.cumsum(steps + widest + AROUND)]
        flat = np.zeros((int(base[-1]) + AT_ONCE + widest) * STEP, np.int64)
        flat[np.arange(len(codes)) + np.repeat(base[:-1] * STEP - (np.cumsum(sizes) - sizes), sizes)] = codes
        marked = self.some[flat]
        rare, some = flat[marked], np.r_[0, np.cumsum(marked.reshape(-1, STEP).sum(1))]
        flat = flat.reshape(-1, STEP)
        for a in range(AROUND, int(base[-1]), AT_ONCE):
            window = space.sums(flat[a : a + AT_ONCE + widest])
            starts = flat[a : a + AT_ONCE, 0] > 0
            width = 1
            while width < widest:
                window = window[:-width] + window[width:]
                width *= 2
                if width not in self.sides or not len(self.sides[width][0]):
                    continue
                which, directions = self.sides[width]
                x = window[:AT_ONCE]
                length = np.sqrt(np.einsum("ij,ij->i", x, x))
                length[~starts | (length < 1e-9)] = np.inf
                product = x @ directions
                at = np.flatnonzero(product >= (COSINE * length)[:, None])
                i, j = np.divmod(at, len(which))
                cosine, j, i = product.ravel()[at] / length[i], which[j], i + a
                if agreeing:
                    good = self._agree(rare, some[i - AROUND], some[i + width + AROUND], j)
                    i, j, cosine = i[good], j[good], cosine[good]
                if len(i):
                    text = np.searchsorted(base, i, side="right") - 1
                    lo = (i - base[text]) * STEP
                    yield text, j, lo, np.minimum(lo + width * STEP, sizes[text]), cosine

    def _agree(self, rare: np.ndarray, lo: np.ndarray, hi: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Windows whose surroundings, which have the rarer words from ``lo`` to ``hi``, hold enough of those of their passage."""
        out = [np.zeros(0, np.int64)]
        enough = np.flatnonzero(hi - lo >= self.needed[j])
        for k in range(0, len(enough), 1 << 14):
            at = enough[k : k + (1 << 14)]
            counts = hi[at] - lo[at]
            which = np.repeat(np.arange(len(at)), counts)
            f = rare[np.repeat(lo[at] - (np.cumsum(counts) - counts), counts) + np.arange(len(which))]
            hits = np.bincount(which[self.rare[self._slot(j[at][which], f)]], minlength=len(at))
            out.append(at[hits >= self.needed[j[at]]])
        return np.concatenate(out)

    def verify(self, words: list[int], own: list[int], answer: set[int], lo: int, hi: int) -> tuple[float, float]:
        """Common subsequence and answer terms, as shares, of the region and the words of an item or passage."""
        region = words[max(0, lo - len(own)) : hi + len(own)]
        return lcs(own, region) / len(own), len(answer.intersection(region)) / max(1, len(answer))

    def leaks(self, space: Space, texts: pa.Array) -> list[list[dict]]:
        """For each text its leaked items with the best evidence; the cosine is 0 if no window was near."""
        hashes, sizes = batch_words(texts)
        codes = features(hashes)
        start = np.r_[0, np.cumsum(sizes)]
        found: dict[tuple[int, int], list[tuple[int, int, float, int]]] = {}
        for part in self.near(space, codes, sizes):
            for t, passage, lo, hi, cosine in zip(*(x.tolist() for x in part), strict=True):
                found.setdefault((t, self.owners[passage]), []).append((lo, hi, cosine, passage))
        runs: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        owner = np.repeat(np.arange(len(sizes)), sizes)
        places, which = self.seeds.pairs(codes, owner)
        for t, item, lo, hi, passage in self.seeds.find_changed(owner, places, which):
            found.setdefault((t, item), []).append((lo - int(start[t]), hi - int(start[t]), 0.0, passage))
        for t, item, at, lo, n in self.seeds.find_runs(codes, owner, places):
            runs.setdefault((t, item), []).append((at - int(start[t]), lo, n))
        out: list[list[dict]] = [[] for _ in texts]
        split: dict[int, list[int]] = {}
        for t, item in sorted({*found, *runs}):
            if t not in split:
                split[t] = hashes[start[t] : start[t + 1]].tolist()
            words, spans, own = split[t], found.get((t, item), []), self.items[item]
            best = self._best(words, own, self.answers[item], [x[:3] for x in spans])
            if not best and len(own) > PASSAGE:  # a part of a long item
                parts = (self._best(words, *self.passages[p], [x[:3] for x in spans if x[3] == p]) for p in sorted({x[3] for x in spans}))
                best = max(filter(None, parts), default=None)
            if not best:
                for at, lo, n in runs.get((t, item), ()):
                    if (k := holds(words, own[lo : lo + n], at)) >= 0:
                        share, answer = self.verify(words, own, self.answers[item], k, k + n)
                        best = (share, answer, max((x[2] for x in spans), default=0.0), k, k + n)
                        break
            if best:
                out[t].append(dict(zip(("lcs", "answer", "cosine", "start_word", "end_word"), best, strict=True)) | {"item_id": self.ids[item]})
        return out

    def _best(self, words: list[int], own: list[int], answer_terms: set[int], spans: list[tuple[int, int, float]]) -> tuple | None:
        """The best region of some spans that is a leak of ``own``."""
        regions: list[list] = []
        for lo, hi, c in sorted(spans):
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = max(hi, regions[-1][1])
                regions[-1][2] = max(c, regions[-1][2])
            else:
                regions.append([lo, hi, c])
        best = None
        for lo, hi, c in regions:
            share, answer = self.verify(words, own, answer_terms, lo, hi)
            if share >= LCS_ALONE or share >= LCS_WITH and answer >= ANSWER_SHARE:
                best = max(best or (0.0,), (share, answer, c, lo, min(hi, len(words))))
        return best


class Detector:
    """The latent space and the benchmark, a block at a time."""

    def __init__(self, space: Space, items: DataFrame, block_words: int):
        self.space, self.items, self.block_words = space, items, block_words

    def blocks(self) -> Iterator[Block]:
        """Items in the order of id and text; one of more words than a block has one to itself."""
        ids, held, n = [], [], 0
        # One task: the benchmark is read here a partition after the other, each a job of its own.
        for r in self.items.coalesce(1).sortWithinPartitions("item_id", "text").toLocalIterator():
            words = text_words(r["text"])
            if not len(words):
                continue
            if held and n + len(words) > self.block_words:
                yield Block(ids, held, self.space)
                ids, held, n = [], [], 0
            ids.append(r["item_id"])
            held.append(words)
            n += len(words)
        if held:
            yield Block(ids, held, self.space)


def train(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block_words: int = BLOCK_WORDS) -> Detector:
    """Corpus statistics and the latent space, both of all documents and the whole benchmark.

    Items with a null text or without a word are left out; items of equal id are told apart and reported under
    that id. Repeated rows count as often as they occur.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = doc_texts(docs)
    idf = weights(texts)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    shared = spark.sparkContext.broadcast(idf)
    packed = {"parquet.block.size": GROUP_BYTES}
    kept = materialize(_passages(texts, shared, _wholes), "passages", packed)
    marked = materialize(_passages(items, shared, _cuts), "marked", packed)
    count = kept.agg(F.sum("passages")).first()[0] or 0
    emphasis = EMPHASIS * (count / (4 * max(1, min(texts.count(), BESIDE)))) ** 0.5 or EMPHASIS
    rows = kept.withColumns({"emphasis": F.lit(1.0), "item": F.lit(False)}).unionByName(marked.withColumns({"emphasis": F.lit(float(emphasis)), "item": F.lit(True)}))
    space = fit(rows, idf, rank)
    release(kept)
    release(marked)
    return Detector(space, items, block_words)


def whole(words: np.ndarray) -> list[np.ndarray]:
    """All words, in as few passages as can be, of about equal length."""
    return np.split(words, np.cumsum(_whole_sizes(np.array([len(words)])))[:-1])


def _whole_sizes(counts: np.ndarray) -> np.ndarray:
    """The words of each passage of texts of so many words; 0 for a text without any."""
    parts = np.maximum(1, -(-counts // PASSAGE))
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(counts // parts, parts) + (place < np.repeat(counts % parts, parts))


def _wholes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words, _whole_sizes(counts)


def _cuts(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = [p for x in np.split(words, np.cumsum(counts)[:-1]) for p in passages_of(x)]
    return np.concatenate([words[:0], *cut]), np.array([len(p) for p in cut], np.int64)


def _passages(texts: DataFrame, idf: Broadcast, cut: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The passages of all texts, packed as arrays, ``WRITTEN`` at a time: their number, the features of each in ascending
    order with repeats, how many these are, and ``scale``, one over the length of a passage's TF-IDF row.

    ``cut`` makes the passages' words in turn, and the size of each, of those of the texts.
    """

    def run(batch: pa.RecordBatch) -> dict:
        words, counts = batch_words(batch.column(0))
        words, sizes = cut(features(words), counts)
        sizes = sizes[sizes > 0]
        bits = FEATURES.bit_length() - 1
        key = np.repeat(np.arange(len(sizes)) << bits, sizes) | words
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        times = np.diff(np.r_[first, len(key)])
        length = np.sqrt(np.bincount(key[first] >> bits, (times * idf.value[key[first] & FEATURES - 1]) ** 2, len(sizes)))
        flat, at = (key & FEATURES - 1).astype(np.int32), np.r_[0, np.cumsum(sizes)]
        sizes, scale = sizes.astype(np.int32), (1 / np.maximum(length, 1e-12)).astype(np.float32)
        cuts = [(a, min(a + WRITTEN, len(sizes))) for a in range(0, len(sizes), WRITTEN)]
        return {
            "passages": [z - a for a, z in cuts],
            "words": [flat[at[a] : at[z]].tobytes() for a, z in cuts],
            "sizes": [sizes[a:z].tobytes() for a, z in cuts],
            "scale": [scale[a:z].tobytes() for a, z in cuts],
        }

    return map_batches(texts.select("text"), run, "passages long, words binary, sizes binary, scale binary")


def find_leaks(docs: DataFrame, detector: Detector) -> DataFrame:
    """One row for each document and item found in it: ``doc_id``, ``item_id``, ``lcs``, ``answer``, ``cosine`` and the region's ``start_word`` and ``end_word``.

    Null and empty texts hold nothing; a text of any length is searched whole, by itself. Repeated rows repeat their
    finds. Of several regions with the same item the one of the largest shares counts, of equal ones the last. An
    empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    fields = ("lcs", "answer", "cosine", "start_word", "end_word")
    ddl = "doc_id long, item_id long, lcs double, answer double, cosine double, start_word long, end_word long"
    texts = doc_texts(docs)
    space = spark.sparkContext.broadcast(detector.space)
    out = None
    for block in detector.blocks():
        shared = spark.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> dict:
            found = [(d, x) for d, xs in zip(batch.column(0).to_pylist(), shared.value.leaks(space.value, batch.column(1)), strict=True) for x in xs]
            return {"doc_id": [d for d, _ in found]} | {f: [x[f] for _, x in found] for f in ("item_id", *fields)}

        part = map_batches(texts, run, ddl)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], ddl)


def drop_leaks(docs: DataFrame, detector: Detector) -> DataFrame:
    """The documents in which no item is found, with all their columns; a null text holds nothing."""
    context = docs.sparkSession.sparkContext
    space = context.broadcast(detector.space)
    for block in detector.blocks():
        shared = context.broadcast(block)
        docs = keep_rows(docs, lambda texts, shared=shared: [not x for x in shared.value.leaks(space.value, pa.array([t or "" for t in texts], pa.large_string()))])
    return docs
