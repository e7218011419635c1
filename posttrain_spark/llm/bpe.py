"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Every word keeps its symbols in a doubly linked list. Leaf ``i`` of the tree holds ``rank << 20 | i`` for the
pair that starts at symbol ``i`` (or infinity), inner nodes the minimum of their children, so the root is the
leftmost merge of lowest rank. A merge changes at most three leaves; each change is one walk to the root. The
loop ends when the root is infinite. Words up to ``WIDE`` symbols are merged together, one NumPy lane a word;
longer ones one at a time with the same tree in plain lists, so that a text without spaces costs n log n.

Encoding follows the ``tokenizers`` library for a word-level BPE file with this pipeline: NFC, white-space runs
to one space, lower case by character, a split pattern whose matches are the words, bytes as characters, and an
end-of-word suffix. Special tokens named in the file are found in the raw text first, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_texts, map_batches, prepare, workspace

WIDE = 64
_SHIFT = 20
_INF = np.int64(1) << 62
#: Bytes of words and pieces remembered by each Python worker, with what a dictionary's entry takes: the first ones it
#: meets, among them the frequent ones.
CACHE, ENTRY = 160 << 20, 330


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    extra = 256
    for b in range(256):
        if not out[b]:
            out[b] = chr(extra)
            extra += 1
    return out


class PairTable:
    """Rank and merged symbol of a pair of symbols, looked up for arrays or one at a time."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], n_symbols: int):
        self.width = n_symbols
        keys = np.array([a * n_symbols + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], np.int64)[order]
        self.merged = np.array([m for _, m in pairs.values()], np.int64)[order]
        self.one = pairs
        # An open-addressing table: one or two probes instead of a binary search.
        bits = max(4, int(len(pairs) * 4).bit_length())
        self.mask = (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        left = np.arange(len(self.keys))
        at = self._slot(self.keys)
        self.probes = 0
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            stay = self.slots[at] != left
            left, at = left[stay], (at[stay] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B97F4A7C1)) >> np.int64(24)) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair, or -1."""
        keys = a * self.width + b
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[todo])
            out[todo[hit]] = got[hit]
            more = (got >= 0) & ~hit
            if not more.any():
                break
            todo, at = todo[more], (at[more] + 1) & self.mask
        return out


def merge_one(symbols: list[int], table: PairTable) -> list[int]:
    """All merges of one word, by a segment tree in plain lists."""
    n = len(symbols)
    if n < 2:
        return list(symbols)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    inf = int(_INF)
    sym, pairs = list(symbols), table.one
    nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
    shift = max(_SHIFT, n.bit_length())
    tree = [inf] * (2 * size)
    for i in range(n - 1):
        if got := pairs.get((sym[i], sym[i + 1])):
            tree[size + i] = got[0] << shift | i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int) -> None:
        j = nxt[i]
        got = pairs.get((sym[i], sym[j])) if j >= 0 and sym[i] >= 0 else None
        k = size + i
        tree[k] = got[0] << shift | i if got else inf
        k >>= 1
        while k:
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
            k >>= 1

    low = (1 << shift) - 1
    while tree[1] < inf:
        i = tree[1] & low
        j = nxt[i]
        sym[i] = pairs[sym[i], sym[j]][1]
        sym[j] = -1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        nxt[j] = -1
        if j < n - 1:
            put(j)
        if i < n - 1:
            put(i)
        if prv[i] >= 0:
            put(prv[i])
    return [s for s in sym if s >= 0]


def merge_many(sym: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """All merges of many words at once. ``sym``: one row a word, padded with -1; returned with -1 for what merged away."""
    n, width = sym.shape
    if width < 2:
        return sym
    size = 1 << (width - 2).bit_length() if width > 2 else 1
    rows, cols = np.arange(n), np.arange(width)
    nxt = np.where(cols[None, :] + 1 < lengths[:, None], cols[None, :] + 1, -1)
    prv = np.broadcast_to(cols - 1, (n, width)).copy()
    tree = np.full((n, 2 * size), _INF)
    r, c = np.nonzero(nxt[:, : width - 1] >= 0)
    got = table.find(sym[r, c], sym[r, c + 1])
    ok = got >= 0
    tree[r[ok], size + c[ok]] = table.ranks[got[ok]] << _SHIFT | c[ok]
    k = size
    while k > 1:
        half = k >> 1
        tree[:, half:k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k = half

    def put(r: np.ndarray, c: np.ndarray) -> None:
        """Sets the leaves c of the words r anew and walks to the roots."""
        value = np.full(len(r), _INF)
        j = nxt[r, c]
        has = np.nonzero((j >= 0) & (sym[r, c] >= 0))[0]
        got = table.find(sym[r[has], c[has]], sym[r[has], j[has]])
        ok = got >= 0
        value[has[ok]] = table.ranks[got[ok]] << _SHIFT | c[has[ok]]
        k = size + c
        tree[r, k] = value
        while size > 1 and k[0] > 1:
            k = k >> 1
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

    live = rows
    while len(live := live[tree[live, 1] < _INF]):
        i = tree[live, 1] & ((1 << _SHIFT) - 1)
        j = nxt[live, i]
        got = table.find(sym[live, i], sym[live, j])
        sym[live, i] = table.merged[got]
        sym[live, j] = -1
        after = nxt[live, j]
        nxt[live, i] = after
        nxt[live, j] = -1
        has = after >= 0
        prv[live[has], after[has]] = i[has]
        for r, c in ((live, j), (live, i)):
            inner = c < size
            if inner.any():
                put(r[inner], c[inner])
        before = prv[live, i]
        has = before >= 0
        if has.any():
            put(live[has], before[has])
    return sym


class WordBpe:
    """Encoder and decoder for a word-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        parts = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(parts["pattern"]["Regex"]).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.table = PairTable(pairs, max(self.token) + 1)
        chars = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in chars], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in chars], np.int64)
        self.by_word: dict[str, tuple[str, str]] = {}
        self.by_piece: dict[str, tuple[str, str]] = {}
        self.room = CACHE

    @staticmethod
    def normal(piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", piece))

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        raw = [w.encode() for w in words]
        out: list[list[int]] = [[]] * len(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        floor = 0
        for width in (2, 4, 8, 12, 16, 24, 32, WIDE):
            at = np.nonzero((sizes > floor) & (sizes <= width))[0]
            floor = width
            for lo in range(0, len(at), 32768):
                part = at[lo : lo + 32768]
                lengths = sizes[part]
                flat = np.frombuffer(b"".join([raw[k] for k in part]), np.uint8)
                cols = np.arange(width)
                inside = cols[None, :] < lengths[:, None]
                sym = np.full((len(part), width), -1, np.int64)
                sym[inside] = self.inner[flat]
                ends = lengths - 1
                sym[np.arange(len(part)), ends] = self.last[flat[np.cumsum(lengths) - 1]]
                sym = merge_many(sym, lengths, self.table)
                keep = sym >= 0
                ids, cuts = sym[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
                start = 0
                for k, end in zip(part.tolist(), cuts, strict=True):
                    out[k] = ids[start:end]
                    start = end
        for k in np.nonzero(sizes > WIDE)[0].tolist():
            w = raw[k]
            out[k] = merge_one([*self.inner[list(w[:-1])].tolist(), int(self.last[w[-1]])], self.table)
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library decodes when the file names no decoder: tokens joined by a space."""
        return " ".join([self.token[i] for i in ids if i in self.token])

    def _learn(self, pieces: set[str]) -> dict[str, tuple[str, str]]:
        """Ids and decoded text of pieces that aren't remembered."""
        split = {p: self.words(self.normal(p)) for p in pieces}
        new = list({w for ws in split.values() for w in ws} - self.by_word.keys())
        made = {w: (" ".join(map(str, ids)), self.decode(ids)) for w, ids in zip(new, self.merge(new), strict=True)}
        out = {}
        for p, ws in split.items():
            got = [made[w] if w in made else self.by_word[w] for w in ws]
            out[p] = got[0] if len(got) == 1 else (" ".join([x for x, _ in got]), " ".join([y for _, y in got]))
        for memory, more in ((self.by_word, made), (self.by_piece, out)):
            if self.room > 0:
                self.room -= sum(len(k) + len(ids) + len(text) + ENTRY for k, (ids, text) in more.items())
                memory.update(more)
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids, as decimals joined by a space, and what they decode to.

        White space only ever separates words, so a text is the sequence of its space-free pieces; a
        piece seen before is not encoded again.
        """
        split: list[list[str]] = []
        for t in texts:
            if self.cut and "<|" in t and self.cut.search(t):
                # Odd parts are special tokens; a NUL-led key cannot be a piece of normal text for them.
                split.append([("\0" + x if k % 2 else p) for k, x in enumerate(self.cut.split(t)) for p in ([x] if k % 2 else x.split(" "))])
            else:
                split.append(t.split(" "))
        need: set[str] = set()
        for ps in split:
            need.update(ps)
        memory = {p: self.by_piece[p] for p in need if p in self.by_piece}
        memory |= {p: (str(self.special[p[1:]]), p[1:]) for p in need if p[:1] == "\0" and p[1:] in self.special}
        memory |= self._learn(need - memory.keys())
        out = []
        for ps in split:
            got = [memory[p] for p in ps]
            out.append((" ".join([x for x, _ in got if x]), " ".join([y for x, y in got if x])))
        return out


def loaded(path: str) -> WordBpe:
    """One encoder a worker process and file."""
    held = workspace("bpe")
    if path not in held:
        held[path] = WordBpe(path)
    return held[path]


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns ``doc_id``, ``n_tokens`` and the SHA-256 of the ids (decimals joined by a space) and of the decoded
    text; with ``ids`` also the ids as ``array<int>``. Null and empty texts have no tokens and the digest of
    the empty string. Texts are encoded row by row, so hot sources and repeated rows cost no shuffle.
    """
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        got = loaded(path).encode_batch(batch.column(1).to_pylist())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out = {
            "doc_id": batch.column(0),
            "n_tokens": [x.count(" ") + 1 if x else 0 for x, _ in got],
            "ids_sha256": [sha(x) for x, _ in got],
            "decoded_sha256": [sha(y) for _, y in got],
        }
        if ids:
            flat = [np.fromstring(x, np.int32, sep=" ") for x, _ in got]
            out["ids"] = pa.ListArray.from_arrays(np.cumsum([0, *map(len, flat)], dtype=np.int32), np.concatenate(flat))
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_batches(doc_texts(docs), run, schema)
