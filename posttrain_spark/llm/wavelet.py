"""Token ids as wavelet matrices, one compressed file a shard.

A shard holds the ids of consecutive documents. Bit-plane ``b`` holds bit ``b`` of all ids, in the order that the
planes above left: each plane moves the ids with a zero bit before those with a one, stably. With ranks of the
planes (a count every 512 bits) an id, the number of occurrences of an id in a range and the place of its k-th
occurrence take one step a plane.

File: ``WAVEMTX2``, a little-endian uint32 with the length of the header, the header (JSON: number of ids and
documents, number of planes, zeros of each plane, offset and length of each section), and the sections: ``docs`` (int64
ids of the documents), ``nulls`` (one byte a document: id is null), ``sizes`` (int64 number of ids of each),
``index<b>`` (uint64: where each frame of plane b starts in its section, and the end; then the ones before each frame),
each a zstd frame, and ``plane<b>``, a zstd frame for every 2^19 bits of the plane, which holds the ones of the frame
before each block of 512 bits (uint32) and the bits, least significant first. A reader fetches the header, the index of
a plane and the frames that it needs: an access reads one frame a plane.

Shards are written by executors to a folder that all share. Every attempt of a task names its files anew and nothing is
replaced or moved; the rows that the written table holds say which files count, so a task that is stopped at any point
or runs again leaves whole shards for every row (and files that no row names, which ``sweep`` deletes).
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, doc_texts, fresh_path, map_batches, materialize, partitions, prepare, workspace

MAGIC = b"WAVEMTX2"
#: Bits between ranks, and of a frame.
BLOCK, FRAME = 512, 1 << 19
#: Frames that a reader keeps.
FRAMES = 256
#: Ids of a shard, but for a document that has more.
SHARD_IDS = 1 << 22
#: Bytes of text that are encoded together.
AT_ONCE = 12 << 20
#: Bytes of pieces of text and their ids remembered by each Python worker, with what a dictionary's entry takes.
CACHE, ENTRY = 200 << 20, 160


def _kind(planes: int) -> type:
    return np.uint16 if planes <= 16 else np.uint32


def write_wavelet(ids: np.ndarray, sizes: np.ndarray, docs: list[int | None], planes: int) -> bytes:
    """The file for the ids of documents in turn."""
    pack = zstandard.ZstdCompressor(level=1).compress
    sections = {
        "docs": pack(np.array([d or 0 for d in docs], "<i8").tobytes()),
        "nulls": pack(np.array([d is None for d in docs], np.uint8).tobytes()),
        "sizes": pack(sizes.astype("<i8").tobytes()),
    }
    zeros = []
    row = ids.astype(_kind(planes))
    for b in range(planes - 1, -1, -1):
        bit = (row & row.dtype.type(1 << b)) != 0
        packed = np.packbits(bit, bitorder="little")
        padded = np.zeros(-(-max(1, len(packed)) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        frames, starts, before = [], [0], [0]
        for lo in range(0, len(ones), FRAME // BLOCK):
            part = ones[lo : lo + FRAME // BLOCK]
            ranks = np.cumsum(part, dtype="<u4") - part
            frames.append(pack(ranks.astype("<u4").tobytes() + padded[lo * BLOCK // 8 : (lo + len(part)) * BLOCK // 8].tobytes()))
            starts.append(starts[-1] + len(frames[-1]))
            before.append(before[-1] + int(part.sum()))
        sections[f"index{b}"] = pack(np.array([*starts, *before], "<u8").tobytes())
        sections[f"plane{b}"] = b"".join(frames)
        low = row[~bit]
        zeros.append(len(low))
        row = np.concatenate([low, row[bit]])
    at, table = 0, {}
    for name, body in sections.items():
        table[name] = [at, len(body)]
        at += len(body)
    head = json.dumps({"ids": len(ids), "docs": len(docs), "planes": planes, "zeros": zeros, "sections": table}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections.values()])


class Wavelet:
    """Reader of one shard; positions and counts are within the shard."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (n,) = struct.unpack("<I", file.read(4))
        self.head = json.loads(file.read(n))
        self.start = len(MAGIC) + 4 + n
        self.n, self.planes = self.head["ids"], self.head["planes"]
        self._held: dict[str, np.ndarray] = {}
        self._frames: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def section(self, name: str, kind: str) -> np.ndarray:
        if name not in self._held:
            at, size = self.head["sections"][name]
            self.file.seek(self.start + at)
            self._held[name] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(size)), kind)
        return self._held[name]

    @cached_property
    def sizes(self) -> np.ndarray:
        return self.section("sizes", "<i8")

    @cached_property
    def docs(self) -> list[int | None]:
        return [None if z else d for d, z in zip(self.section("docs", "<i8").tolist(), self.section("nulls", "u1").tolist(), strict=True)]

    def _index(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the frames of plane b start, and the ones before each; both with the end."""
        return tuple(np.split(self.section(f"index{b}", "<u8").astype(np.int64), 2))

    def _frame(self, b: int, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and bytes of a frame."""
        if (b, f) not in self._frames:
            starts, _ = self._index(b)
            self.file.seek(self.start + self.head["sections"][f"plane{b}"][0] + int(starts[f]))
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(int(starts[f + 1] - starts[f]))), np.uint8)
            blocks = len(raw) // (BLOCK // 8 + 4)
            if len(self._frames) >= FRAMES:
                self._frames.clear()
            self._frames[b, f] = raw[: 4 * blocks].view("<u4").astype(np.int64), raw[4 * blocks :]
        return self._frames[b, f]

    def _ones(self, b: int, i: int) -> int:
        """Ones of plane b before position i."""
        before = self._index(b)[1]
        f, i = divmod(i, FRAME)
        ranks, bits = self._frame(b, f) if f + 1 < len(before) else (np.zeros(0, np.int64), None)
        k = i // BLOCK
        if k >= len(ranks):  # the end of the last frame
            return int(before[min(f + 1, len(before) - 1)])
        inside = bits[k * BLOCK // 8 : -(-i // 8)]
        total = int(before[f]) + int(ranks[k]) + int(np.bitwise_count(inside).sum())
        return total - (int(inside[-1]) >> (i % 8)).bit_count() if i % 8 and len(inside) else total

    def _levels(self) -> Iterator[tuple[int, int]]:
        return zip(range(self.planes - 1, -1, -1), self.head["zeros"], strict=True)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for b, zeros in self._levels():
            bit = int(self._frame(b, i // FRAME)[1][i % FRAME >> 3]) >> (i & 7) & 1
            out = out << 1 | bit
            ones = self._ones(b, i)
            i = zeros + ones if bit else i - ones
        return out

    def _range(self, x: int, i: int, j: int) -> tuple[int, int]:
        for b, zeros in self._levels():
            p, q = self._ones(b, i), self._ones(b, j)
            i, j = (zeros + p, zeros + q) if x >> b & 1 else (i - p, j - q)
        return i, j

    def count(self, x: int, i: int = 0, j: int | None = None) -> int:
        """Occurrences of id x at positions i to j (exclusive)."""
        if x >> self.planes:
            return 0
        lo, hi = self._range(x, i, self.n if j is None else j)
        return hi - lo

    def select(self, x: int, k: int) -> int:
        """Position of the k-th occurrence of id x, from 0."""
        lo, hi = self._range(x, 0, self.n) if 0 <= x < 1 << self.planes else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        return int(self._up(x, np.array([lo + k]))[0])

    def positions(self, x: int) -> np.ndarray:
        """All positions of id x, ascending, in one pass over the planes."""
        lo, hi = self._range(x, 0, self.n) if 0 <= x < 1 << self.planes else (0, 0)
        return self._up(x, np.arange(lo, hi))

    def _up(self, x: int, at: np.ndarray) -> np.ndarray:
        """Positions in the shard of ascending places below the last plane, all of id x."""
        for b, zeros in reversed(list(self._levels())):
            one = bool(x >> b & 1)
            at = self._find(b, at - zeros if one else at, one)
        return at

    def _find(self, b: int, k: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the ones (or zeros) of plane b with these ascending numbers; each frame is read once."""
        before = self._index(b)[1]
        if not one:
            before = np.arange(len(before)) * FRAME - before
            before[-1] = np.iinfo(np.int64).max
        frame = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        for f in np.unique(frame).tolist():
            mine = frame == f
            ranks, bits = self._frame(b, f)
            if not one:
                ranks = np.arange(len(ranks)) * BLOCK - ranks
            number = k[mine] - before[f]
            block = np.searchsorted(ranks, number, side="right") - 1
            first, last = int(block[0]), int(block[-1]) + 1
            places = np.flatnonzero(np.unpackbits(bits[first * BLOCK // 8 : last * BLOCK // 8], bitorder="little") == one)
            out[mine] = f * FRAME + first * BLOCK + places[number - int(ranks[first])]
        return out

    def all_ids(self) -> np.ndarray:
        """The ids in order, by undoing the planes from the last to the first."""
        row = np.zeros(self.n, _kind(self.planes))
        for b, zeros in reversed(list(self._levels())):
            starts, _ = self._index(b)
            self.file.seek(self.start + self.head["sections"][f"plane{b}"][0])
            raw, inflate = self.file.read(int(starts[-1])), zstandard.ZstdDecompressor().decompress
            frames = [np.frombuffer(inflate(raw[i:j]), np.uint8) for i, j in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
            plane = np.concatenate([f[len(f) // (BLOCK // 8 + 4) * 4 :] for f in frames])
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            before = np.empty_like(row)
            before[~bit] = row[:zeros]
            before[bit] = row[zeros:] | row.dtype.type(1 << b)
            row = before
        return row.astype(np.uint32)


class PieceEncoder:
    """Ids of texts by the ``tokenizers`` library, for byte-level files that split before a single space.

    In these files a word takes the one space before it along, so the ids of a text are those of its pieces
    between single spaces, each encoded with that space; a piece seen before is not encoded again.
    """

    _CUT = re.compile(r"(?<=\S) (?=\S)")
    _ODD = re.compile(r" \s|\s |^\s|\s$")
    #: White space other than the space and the newline.
    _RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    #: Marks that may follow the letters of a piece; they are a word of their own in these files.
    _MARKS = ".,;:!?"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"]
        self.by_piece_ok = spec["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.planes = max(1, max(self.tokenizer.get_vocab().values()).bit_length())
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_piece_ok &= len(newline) == 1
        self.newline = newline[0]
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.room = CACHE

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of many pieces (each after ``lead``) from few calls: a newline between two pieces is a word of its own."""
        out: list[bytes] = [b""] * len(pieces)
        joined, alone = [], []
        for k, p in enumerate(pieces):
            (alone if not p or "\n" in p or "<|" in p or p[0].isspace() or p[-1].isspace() else joined).append(k)
        for lo in range(0, len(joined), 4096):
            part = joined[lo : lo + 4096]
            (e,) = self.tokenizer.encode_batch_fast(["\n".join([lead + pieces[k] for k in part])], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            raw = ids.tobytes()
            cuts = (4 * np.nonzero(ids == self.newline)[0]).tolist()
            for k, a, b in zip(part, [0, *[c + 4 for c in cuts]], [*cuts, len(raw)], strict=True):
                out[k] = raw[a:b]
        for k, x in zip(alone, self._ids([lead + pieces[k] for k in alone]), strict=True):
            out[k] = x
        return out

    def _learn(self, memory: dict[str, bytes], pieces: list[str], lead: str) -> dict[str, bytes]:
        """Ids of pieces that aren't remembered; remembered from now on while there is room, the frequent ones coming early."""
        split = {}
        for p in pieces:
            word = p.rstrip(self._MARKS)
            split[p] = word if word != p and word.isalpha() else p
        need = [w for w in set(split.values()) if w not in memory]
        got = dict(zip(need, self._ids_of_pieces(need, lead), strict=True))
        marks = [m for m in {p[len(w) :] for p, w in split.items()} if m and m not in self.marks]
        self.marks.update(zip(marks, self._ids(marks), strict=True))
        out = {p: (got[w] if w in got else memory[w]) + (self.marks[p[len(w) :]] if p != w else b"") for p, w in split.items()}
        if self.room > 0:
            more = got | out
            self.room -= sum(map(len, more)) + sum(map(len, more.values())) + ENTRY * len(more)
            memory.update(more)
        if len(self.marks) > 10_000:  # not many and short, but any run of marks is one
            self.marks = {"": b""}
        return out

    def _of(self, memory: dict[str, bytes], pieces: list[str], lead: str) -> list[bytes]:
        got = list(map(memory.get, pieces))
        unknown = [k for k, x in enumerate(got) if x is None]
        new = self._learn(memory, [pieces[k] for k in unknown], lead)
        for k in unknown:
            got[k] = new[pieces[k]]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_piece_ok:
            return self._ids(texts)
        odd = [k for k, t in enumerate(texts) if self._odd(t)]
        # Lists of pieces in Arrow: each distinct piece of the batch becomes a Python string once.
        column = pa.array(["" if self._odd(t) else t for t in texts] if odd else texts, pa.large_string())
        lists = pc.split_pattern(column, " ")
        cuts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        firsts = lists.values.take(pa.array(cuts[:-1])).to_pylist()
        ids = self._of(self.later, pieces, " ") + self._of(self.first, firsts, "")
        which = coded.indices.to_numpy().astype(np.int64)
        which[cuts[:-1]] = len(pieces) + np.arange(len(texts))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[which]
        ends = np.cumsum(each)
        flat = np.frombuffer(b"".join(ids), "<u4")[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[which] - (ends - each), each)].tobytes()
        bounds = np.r_[0, ends][cuts].tolist()
        out = [flat[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in odd:
            first, *rest = self._CUT.split(texts[k])
            out[k] = b"".join([*self._of(self.first, [first], ""), *self._of(self.later, rest, " ")])
        return out

    @classmethod
    def _odd(cls, t: str) -> bool:
        """Whether some single space doesn't stand between two other characters that are no white space."""
        if not t or t[0].isspace() or t[-1].isspace() or "  " in t or " \n" in t or "\n " in t:
            return True
        return any(c in t for c in cls._RARE) and cls._ODD.search(t) is not None


def loaded(path: str) -> PieceEncoder:
    held = workspace("wavelet")
    if path not in held:
        held[path] = PieceEncoder(path)
    return held[path]


def write_shards(docs: DataFrame, path: str, at: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes the shards to the folder ``at`` in ascending ``doc_id`` order (nulls first).

    Returns one row a shard: ``part`` and ``seq`` (their order), ``file``, ``n_docs`` and ``n_ids``.
    """
    spark = docs.sparkSession
    prepare(spark)
    tie = F.xxhash64("text").alias("tie")  # equal ids keep one order and can be dealt to several tasks
    ordered = doc_texts(docs).select("doc_id", "text", tie).repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = "part int, seq int, file string, n_docs long, n_ids long"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        coder = loaded(path)
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal n, seq
            flat = np.frombuffer(b"".join(held), "<u4")
            body = write_wavelet(flat, np.array([len(h) // 4 for h in held], np.int64), ids, max(coder.planes, int(end_id).bit_length()))
            name = f"shard-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.wmx"
            put(at, name, body)
            row = {"part": [part], "seq": [seq], "file": [name], "n_docs": [len(ids)], "n_ids": [len(flat)]}
            ids.clear(), held.clear()
            n, seq = 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=out)

        # Several batches are encoded together: their common pieces are looked up once.
        for docs_, texts in gathered(batches, AT_ONCE):
            for doc, x in zip(docs_, coder.encode(texts), strict=True):
                ids.append(doc)
                held.append(x + end)
                n += len(x) // 4 + 1
                if n >= shard_ids:
                    yield flush()
        if ids:
            yield flush()

    return materialize(ordered.mapInArrow(run, schema), "shards")


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """The two columns of consecutive batches of about so many bytes together."""
    docs, texts, n = [], [], 0
    for batch in batches:
        docs += batch.column(0).to_pylist()
        texts += batch.column(1).to_pylist()
        n += batch.nbytes
        if n >= size:
            yield docs, texts
            docs, texts, n = [], [], 0
    if docs:
        yield docs, texts


def put(folder: str, name: str, body: bytes) -> None:
    """Writes a file to a folder on any file system."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as f:
        f.write(body)


def sweep(shards: DataFrame, at: str) -> int:
    """Deletes the files that stopped attempts have left in the folder: those that no row of ``shards`` names; how many."""
    fs, root = pafs.FileSystem.from_uri(at)
    there = shards.sparkSession.createDataFrame([(f.base_name,) for f in fs.get_file_info(pafs.FileSelector(root))], "file string")
    gone = [r["file"] for r in there.join(shards, "file", "left_anti").toLocalIterator()]
    for name in gone:
        fs.delete_file(f"{root}/{name}")
    return len(gone)


def open_shard(folder: str, name: str) -> Wavelet:
    fs, root = pafs.FileSystem.from_uri(folder)
    return Wavelet(fs.open_input_file(f"{root}/{name}"))


def read_shards(shards: DataFrame, at: str, end_id: int = 0) -> DataFrame:
    """Per document of the shards: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, ``shard_ends``.

    The last is the number of end ids in the document's shard, counted by the ranks of the planes.

    The offset of a part is summed on the driver, one number a part; that of a shard in its part by a window.
    """
    spark = shards.sparkSession
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for p in sorted(sums):
        base[p] = total
        total += sums[p]
    offsets = spark.sparkContext.broadcast(base)
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    dealt = shards.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0).cast("long"))).select("part", "file", "before").repartition(partitions(spark))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard_ends long"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, name, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = open_shard(at, name)
                raw = shard.all_ids().astype("<u4").tobytes()
                ends = np.cumsum(shard.sizes)
                starts = ends - shard.sizes
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": shard.docs, "start": starts + (offsets.value[part] + before), "n_tokens": shard.sizes, "ids_crc32": crcs, "shard_ends": [shard.count(end_id)] * len(crcs)}, schema=out)

    return dealt.mapInArrow(run, schema)


def encode_to_shards(docs: DataFrame, path: str, at: str | None = None, end_id: int = 0) -> tuple[DataFrame, str]:
    """Writes all texts as shards (to a new folder of the shared one unless ``at`` is given) and reads them back.

    Returns ``read_shards`` of them and the folder. Null and empty texts are one end id. Rows of equal id stand
    together, in the order of a hash of their text. An empty table writes no shard.
    """
    at = at or fresh_path(docs.sparkSession, "wavelet")
    return read_shards(write_shards(docs, path, at, end_id), at, end_id), at


def count_id(shards: DataFrame, at: str, x: int) -> DataFrame:
    """Occurrences of id x by shard, from the planes alone: ``file``, ``n``."""

    def run(batch: pa.RecordBatch) -> dict:
        names = batch.column(0).to_pylist()
        return {"file": names, "n": [open_shard(at, f).count(x) for f in names]}

    return map_batches(shards.select("file"), run, "file string, n long")
