"""Line dedup with two Bloom filters.

Pass 1 hashes every line key. Each task keeps the hashes it saw once and those it saw twice or more as two
Bloom filters, sent as 64 segments of packed bits. Filters of two tasks merge without false negatives:
``once = o1 | o2`` and ``twice = t1 | t2 | (o1 & o2)``. Filters have ``LINE_BITS`` bits for every line of the corpus
(counted first), rounded up to a power of two, up to ``MOST_BITS`` (64 MB), which bounds what is collected and broadcast.

Pass 2 reads the lines again. Only lines whose hash is in the twice filter are shuffled, as SHA-256 digests
of their keys, and counted exactly, so a false positive costs a shuffled row and never changes the result. In a
corpus of more lines than the largest filter is made for, more lines are shuffled, up to all of them: the plain way.

Confirmed digests of up to ``broadcast_rows`` rows (counted first) are broadcast; beyond that they are joined
to the documents that hold them. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, arrow_schema, doc_texts, lower_az, map_batches, materialize, partitions, prepare

SEGMENTS = 64
PROBES = 2
#: Bits for a line; the fewest and the most bits of a filter.
LINE_BITS, LEAST_BITS, MOST_BITS = 10, 1 << 20, 1 << 29
#: Confirmed digests that are broadcast (some 130 bytes each in a worker).
BROADCAST_LINES = 1 << 18
#: Hashes that a task holds before it folds them into its bits.
FOLD = 1 << 20


def line_keys(text: str) -> list[str]:
    """The key of each line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(SPACE) for line in lower_az(text).split("\n")]


def key_hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 7)


def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bit positions of each hash, one array a probe; all in the segment of the hash's top bits."""
    per = bits // SEGMENTS
    base = (hashes >> np.uint64(58)) * np.uint64(per)
    return [(base + (hashes >> np.uint64(28 * k)) % np.uint64(per)).astype(np.int64) for k in range(PROBES)]


class Twin:
    """The two filters of one task or of a merge."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits >> 3, np.uint8)
        self.twice = np.zeros(bits >> 3, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        values, counts = np.unique(hashes, return_counts=True)
        at = probes(values, self.bits)
        seen = np.ones(len(values), bool)
        for p in at:
            seen &= (self.once[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        again = seen | (counts > 1)
        for p in at:
            np.bitwise_or.at(self.twice, p[again] >> 3, (np.uint8(1) << (p[again] & 7).astype(np.uint8)))
            np.bitwise_or.at(self.once, p >> 3, (np.uint8(1) << (p & 7).astype(np.uint8)))


def filter_size(texts: DataFrame) -> int:
    """Bits of a filter for all lines of these texts: a power of two."""
    lines = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (LINE_BITS * lines - 1).bit_length() if lines else 0))


def twice_filter(texts: DataFrame, filter_bits: int) -> Broadcast:
    """The merged twice filter over the line keys of all texts, broadcast."""
    spark = texts.sparkSession
    per = filter_bits // SEGMENTS >> 3
    out = arrow_schema("segment int, once binary, twice binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twin, held, n = None, [], 0

        def fold() -> None:
            nonlocal twin, held, n
            if n:
                twin = twin or Twin(filter_bits)
                twin.add(np.concatenate(held))
                held, n = [], 0

        for batch in batches:
            for text in batch.column(0).to_pylist():
                # Equal keys within a document count once: the threshold is on documents.
                keys = set(line_keys(text))
                keys.discard("")
                if keys:
                    held.append(np.fromiter(map(key_hash, keys), np.uint64, len(keys)))
                    n += len(keys)
            if n > FOLD:
                fold()
        fold()
        if twin:
            pack = zstandard.ZstdCompressor(level=1).compress
            for s in range(SEGMENTS):
                cut = slice(s * per, (s + 1) * per)
                yield pa.RecordBatch.from_pydict({"segment": [s], "once": [pack(twin.once[cut].tobytes())], "twice": [pack(twin.twice[cut].tobytes())]}, schema=out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for s, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = (np.frombuffer(unpack(x), np.uint8) for x in (o, t))
                if s in kept:
                    a, b = kept[s]
                    once, twice = a | once, b | twice | (a & once)
                kept[s] = once, twice
        pack = zstandard.ZstdCompressor(level=1).compress
        for s, (_, twice) in kept.items():
            yield pa.RecordBatch.from_pydict({"segment": [s], "twice": [pack(twice.tobytes())]}, schema=merged)

    merged = arrow_schema("segment int, twice binary")
    rows = texts.select("text").mapInArrow(scan, "segment int, once binary, twice binary").repartition(min(SEGMENTS, partitions(spark)), "segment").mapInArrow(merge, "segment int, twice binary").collect()
    whole = np.zeros(filter_bits >> 3, np.uint8)
    for s, t in rows:
        whole[s * per : (s + 1) * per] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(t)), np.uint8)
    return spark.sparkContext.broadcast(whole.tobytes())


def _suspects(keys: list[str], bits: np.ndarray, n_bits: int) -> list[bool]:
    """Which keys may occur again."""
    if not keys:
        return []
    at = probes(np.fromiter(map(key_hash, keys), np.uint64, len(keys)), n_bits)
    out = np.ones(len(keys), bool)
    for p in at:
        out &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out.tolist()


def digest(key: str) -> bytes:
    return hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()


def confirmed_lines(texts: DataFrame, min_docs: int, min_chars: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """The suspected (document, line) rows, and the digests of keys found in at least ``min_docs`` documents with their first occurrence."""
    shared = twice_filter(texts, filter_bits)

    def run(batch: pa.RecordBatch) -> dict:
        bits = np.frombuffer(shared.value, np.uint8)
        ids, digests, lines = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first: dict[str, int] = {}
            for k, key in enumerate(line_keys(text)):
                if len(key) >= min_chars and key:
                    first.setdefault(key, k)
            for (key, k), hit in zip(first.items(), _suspects(list(first), bits, filter_bits), strict=True):
                if hit:
                    ids.append(doc)
                    digests.append(digest(key))
                    lines.append(k)
        return {"doc_id": ids, "digest": digests, "line": lines}

    suspects = map_batches(texts, run, "doc_id long, digest binary, line int")
    counted = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return suspects, counted.filter(F.col("n_docs") >= min_docs)


def _stripped(doc: int | None, text: str, drop: dict[bytes, int | None], keep: str, min_chars: int) -> tuple[int, int, str]:
    """Lines before, lines dropped, and what stays, of one document."""
    lines = text.split("\n")
    left, seen = [], set()
    for line, key in zip(lines, line_keys(text), strict=True):
        if len(key) >= min_chars and (d := digest(key)) in drop:
            if keep == "none" or drop[d] != doc or d in seen:
                continue
            seen.add(d)
        left.append(line)
    return len(lines), len(lines) - len(left), "\n".join(left)


def _map_stripped(docs: DataFrame, make, schema: str, min_docs: int, min_chars: int, keep: str, filter_bits: int | None, broadcast_rows: int) -> DataFrame:
    """``make(batch, results)`` for all batches of ``docs``, the results being those of ``_stripped``."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    spark = docs.sparkSession
    prepare(spark)
    least = max(1, min_chars)
    suspects, confirmed = confirmed_lines(doc_texts(docs), min_docs, least, filter_bits or filter_size(doc_texts(docs)))
    confirmed = materialize(confirmed, "repeated-lines")
    names = docs.columns
    at, id_at = names.index("text"), names.index("doc_id")
    columns = lambda batch: (batch.column(id_at).to_pylist(), [t or "" for t in batch.column(at).to_pylist()])
    if confirmed.count() <= broadcast_rows:
        shared = spark.sparkContext.broadcast({bytes(d): f for d, f in confirmed.select("digest", "first_doc").collect()})

        def run(batch: pa.RecordBatch) -> dict | pa.RecordBatch:
            return make(batch, [_stripped(i, t, shared.value, keep, least) for i, t in zip(*columns(batch), strict=True)])

        return map_batches(docs, run, schema)

    # Few digests a document; the join on the digest is skewed by hot lines, which adaptive execution splits.
    name = "_" * max(map(len, names)) + "hits"  # longer than any column's
    hits = suspects.join(confirmed, "digest").groupBy("doc_id").agg(F.collect_list(F.struct("digest", "first_doc")).alias(name))
    both = docs.join(hits, docs.doc_id.eqNullSafe(hits.doc_id), "left").select(*(docs[c] for c in names), hits[name])

    def run_joined(batch: pa.RecordBatch) -> dict | pa.RecordBatch:
        drops = [{h["digest"]: h["first_doc"] for h in hs or ()} for hs in batch.column(len(names)).to_pylist()]
        return make(batch, [_stripped(i, t, d, keep, least) for i, t, d in zip(*columns(batch), drops, strict=True)])

    return map_batches(both, run_joined, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", filter_bits: int | None = None, broadcast_rows: int = BROADCAST_LINES) -> DataFrame:
    """Drops lines whose key occurs in at least ``min_docs`` documents (rows; a key counts once in each).

    ``keep="none"`` drops them everywhere; ``keep="first"`` leaves the first occurrence: the first such line of
    the document with the smallest ``doc_id`` (of every row with that id, if ids repeat; a null id is never
    first unless all are null). Keys shorter than ``min_chars`` code points, and empty keys, always stay. Null
    and empty texts are one empty line; a text of any length is split whole. Returns ``doc_id``, ``n_lines`` (before), ``n_dropped`` and ``kept``,
    the remaining lines joined by a newline ("" if none remain).
    """

    def make(batch: pa.RecordBatch, got: list[tuple[int, int, str]]) -> dict:
        return {"doc_id": batch.column(0), "n_lines": [x for x, _, _ in got], "n_dropped": [x for _, x, _ in got], "kept": [x for _, _, x in got]}

    return _map_stripped(doc_texts(docs), make, "doc_id long, n_lines long, n_dropped long, kept string", min_docs, min_chars, keep, filter_bits, broadcast_rows)


def strip_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", filter_bits: int | None = None, broadcast_rows: int = BROADCAST_LINES) -> DataFrame:
    """The documents, with all their columns, without the lines that ``dedup_lines`` drops. A null text becomes empty."""
    names = docs.columns
    at = names.index("text")

    def make(batch: pa.RecordBatch, got: list[tuple[int, int, str]]) -> pa.RecordBatch:
        kept = pa.array([x for _, _, x in got], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([kept if k == at else batch.column(k) for k in range(len(names))], names)

    return _map_stripped(docs, make, docs.schema, min_docs, min_chars, keep, filter_bits, broadcast_rows)
