import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from posttrain_spark.llm import wavelet as w
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("frame", [1 << 10, 1 << 19])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1024, 3000])
def test_wavelet_queries(n, frame, monkeypatch):
    monkeypatch.setattr(w, "FRAME", frame)
    rng = random.Random(n)
    ids = np.array([rng.randrange(300) for _ in range(n)], np.uint32)
    m = w.Wavelet(io.BytesIO(w.write_wavelet(ids, np.array([n]), [None], 9)))
    assert (m.all_ids() == ids).all() and m.docs == [None]
    assert [m.access(i) for i in range(0, n, 7)] == ids[::7].tolist()
    for x in (0, 5, 299, 511, 9999):
        assert m.positions(x).tolist() == np.nonzero(ids == x)[0].tolist()
        assert [m.select(x, k) for k in range(m.count(x))] == np.nonzero(ids == x)[0].tolist()
        assert m.count(x, n // 4, n // 2) == int((ids[n // 4 : n // 2] == x).sum())
    with pytest.raises(IndexError):
        m.access(n)
    with pytest.raises(IndexError):
        m.select(5, n + 1)


def test_pieces_equal_the_library(odd):
    lib, coder = Tokenizer.from_file(PATH), w.PieceEncoder(PATH)
    rng = random.Random(0)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "B", "'s", "é", "日", "\x1c", "\x85", "　", "<|endoftext|>", "12", ".", "x y"]
    texts = [t or "" for _, t in odd] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2000)]
    for t, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip_through_files(make, odd):
    docs = make(odd)
    out, at = w.encode_to_shards(docs, PATH)
    lib = Tokenizer.from_file(PATH)
    rows = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[1])
    assert [r[:4] for r in got] == want
    assert all(r[4] >= 1 for r in got)


def test_counts_and_small_shards(make, spark):
    docs = make([(i, "the cat the") for i in range(50)])
    at = w.fresh_path(spark, "t")
    shards = w.write_shards(docs, PATH, at, shard_ids=20)
    assert shards.count() > 4
    x = Tokenizer.from_file(PATH).encode(" the", add_special_tokens=False).ids[0]
    assert sum(r.n for r in w.count_id(shards, at, x).collect()) == 50
    assert sorted(r.start for r in w.read_shards(shards, at).collect()) == list(range(0, 200, 4))


def test_access_reads_few_bytes():
    """One access of a large shard reads a frame a plane, not the planes."""

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.taken += len(out)
            return out

    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 16, 4 << 20).astype(np.uint32)
    body = w.write_wavelet(ids, np.array([len(ids)]), [1], 16)
    m = w.Wavelet(Counting(body))
    assert m.access(3_000_000) == ids[3_000_000]
    assert Counting.taken < len(body) / 5
    x = int(ids[77])
    assert m.positions(x).tolist() == np.nonzero(ids == x)[0].tolist()


def test_stopped_attempts_leave_whole_shards(make, spark):
    """Files that earlier attempts left, whole or cut short, change nothing: rows name the files that count."""
    docs = make([(i, f"the cat number {i}") for i in range(50)])
    at = w.fresh_path(spark, "t")
    first = w.write_shards(docs, PATH, at, shard_ids=40)
    names = [r.file for r in first.collect()]
    w.put(at, names[0].rsplit("-", 1)[0] + "-0.wmx", b"WAVEMTX2 cut short")
    second = w.write_shards(docs, PATH, at, shard_ids=40)  # every task again, beside the files of the first run
    assert not set(names) & {r.file for r in second.collect()}
    rows = sorted(map(tuple, w.read_shards(first, at).collect()))
    assert rows == sorted(map(tuple, w.read_shards(second, at).collect())) and len(rows) == 50
    assert w.sweep(second, at) == len(names) + 1
    assert rows == sorted(map(tuple, w.read_shards(second, at).collect()))


def test_empty_table(make):
    assert w.encode_to_shards(make([]), PATH)[0].count() == 0
