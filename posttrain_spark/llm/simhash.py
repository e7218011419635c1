"""SimHash fingerprints and near-duplicate classes by covering locality-sensitive hashing.

Each of the 64 bit positions gets one of the 2^(r+1) - 1 nonzero vectors of r + 1 bits, in turn. Mask v keeps the
positions whose vector has an odd product with v. Any r positions span at most r dimensions, so some nonzero v
is orthogonal to all of them: for two fingerprints that differ in at most r bits, one of the 2^(r+1) - 1 masks
hides every difference, and the pair meets in that table (for r = 2: 7 tables of 36 or 37 bits). No pair within
the radius is missed.

Equal fingerprints are one row before anything is paired. A bucket never emits all its pairs: it emits the links
of a spanning forest of its pairs within the radius; buckets beyond ``BLOCK`` are cut again by the positions
that the mask hides, r + 1 parts of which one must agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, doc_texts, map_batches, materialize, partitions, prepare
from .components import components

BITS = 64
BLOCK = 1024
#: Shingles whose bits are spread out at once.
CHUNK = 1 << 15


def shingle_hashes(text: str, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    if not ws:
        return np.zeros(0, np.uint64)
    f = xxhash.xxh64_intdigest
    if len(ws) < words:
        return np.array([f(b" ".join(ws), seed)], np.uint64)
    join = b" ".join
    return np.fromiter([f(join(s), seed) for s in zip(*(ws[k:] for k in range(words)), strict=False)], np.uint64, len(ws) - words + 1)


def fingerprint(text: str, words: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(h: np.ndarray) -> int:
    """Bit k is set if it is set in over half of the shingle hashes; 0 for a text without words."""
    n = len(h)
    if not n:
        return 0
    total = np.zeros(BITS, np.int64)
    for lo in range(0, n, CHUNK):
        part = h[lo : lo + CHUNK].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def masks(radius: int) -> list[int]:
    """The covering masks for pairs within ``radius`` differing bits."""
    vectors = [1 + k % (2 ** (radius + 1) - 1) for k in range(BITS)]
    return [sum(1 << k for k, p in enumerate(vectors) if (p & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, hidden: list[int], radius: int, parent: dict[int, int], index: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the pairs within the radius; ``hidden``: positions in which these may differ."""

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(fp) > BLOCK and len(hidden) > radius:
        size = -(-len(hidden) // (radius + 1))
        for lo in range(0, len(hidden), size):
            part = hidden[lo : lo + size]
            key = fp & np.uint64(sum(1 << k for k in part))
            order = np.argsort(key, kind="stable")
            cuts = np.nonzero(np.diff(key[order]))[0] + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    rest = [k for k in hidden if k not in part]
                    yield from _forest(fp[group], rest, radius, parent, index[group])
        return
    for lo in range(0, len(fp), BLOCK):
        a = fp[lo : lo + BLOCK]
        for start in range(lo, len(fp), BLOCK):
            near = np.bitwise_count(a[:, None] ^ fp[None, start : start + BLOCK]) <= radius
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                x, y = int(index[lo + i]), int(index[start + j])
                if x < y and (p := root(x)) != (q := root(y)):
                    parent[p] = q
                    yield x, y


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (``a``, ``b``) between rows of (``fp``, ``rep``: both long, fp unique) such that linked prints are connected exactly if a chain of steps within the radius connects them."""
    spark = prints.sparkSession
    table = [signed(m) for m in masks(radius)]
    hidden = [[k for k in range(BITS) if not m >> k & 1] for m in masks(radius)]
    keyed = prints.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in table])).alias("t", "key"))
    dealt = keyed.repartition(partitions(spark), "t", "key").sortWithinPartitions("t", "key")
    out = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # batches of a bucket that goes on
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("fp", "rep", "t", "key")]
            last = held[-1] if held else cols
            new = np.nonzero((np.diff(cols[2], prepend=last[2][-1 if held else 0]) != 0) | (np.diff(cols[3], prepend=last[3][-1 if held else 0]) != 0))[0]
            if len(new):
                whole = [np.concatenate(x) for x in zip(*held, [c[: new[-1]] for c in cols], strict=True)]
                before = sum(len(h[0]) for h in held)
                cuts = new[:-1] + before
                yield pairs(whole, cuts[cuts > 0])
                held, cols = [], [c[new[-1] :] for c in cols]
            held.append(cols)
        if held:
            yield pairs([np.concatenate(x) for x in zip(*held, strict=True)], np.zeros(0, np.int64))

    def pairs(cols: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
        fp, rep, t, _ = cols
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(fp)]
        links: list[tuple[int, int]] = []
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            if hi - lo > 1:
                links += _forest(fp[lo:hi].astype(np.int64).view(np.uint64), hidden[t[lo]], radius, {}, rep[lo:hi])
        return pa.RecordBatch.from_pydict({"a": [x for x, _ in links], "b": [y for _, y in links]}, schema=out)

    return dealt.mapInArrow(run, "a long, b long")


def simhash(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long. Null and empty texts have fingerprint 0."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": [signed(fingerprint(t, words)) for t in batch.column(1).to_pylist()]}

    return map_batches(doc_texts(docs), run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Class of every document under links between fingerprints that differ in at most ``radius`` bits.

    Returns ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``: the smallest ``doc_id`` reachable.
    Texts without words have fingerprint zero and link like any other. Repeated rows and repeated ids are kept
    row by row; a null id keeps its row and links others, but never names a class; a class of null ids only has a null
    id. A text of any length is read whole.
    """
    prints = materialize(simhash(docs, words), "fingerprints")
    # Fingerprints are the nodes: one that only rows of null ids have links others too.
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    found = materialize(components(near_links(reps.select("fp", F.col("fp").alias("rep")), radius)), "linked-prints")
    lows = reps.join(found, reps.fp == found.node).groupBy("component").agg(F.min("rep").alias("low"))
    linked = found.join(lows, "component").select("node", "low")
    named = reps.join(linked, reps.fp == linked.node, "left").select("fp", F.when(F.col("node").isNotNull(), F.col("low")).otherwise(F.col("rep")).alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids of dropped documents that are broadcast at most (counted first; 8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1 << 22


def keep_representatives(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One document of each class stays, the one of the smallest ``doc_id``, with all its columns.

    Rows that share an id count as one document; rows of a null id stay.
    """
    classes = materialize(near_duplicates(docs, words, radius).filter("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id")).distinct(), "dropped")
    if classes.count() <= BROADCAST_IDS:
        classes = F.broadcast(classes)
    return docs.join(classes, docs.doc_id == classes.dropped_id, "left_anti")
