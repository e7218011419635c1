import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from posttrain_spark.llm import decontam as dc

from .conftest import prose


@pytest.fixture
def data(spark, make, vocabulary):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randrange(14, 70), vocabulary)) for k in range(30)] + [(90, None), (91, "  ")]
    docs = [(i, prose(rng, rng.randrange(20, 400), vocabulary)) for i in range(120)]
    leaks = set()
    for i in range(0, 60, 3):
        k = i % 30
        ws = items[k][1].split()
        if i % 2:  # a paraphrase: some words changed
            ws = [w if rng.random() > 0.15 else rng.choice(vocabulary) for w in ws]
        at = docs[i][1].split()
        cut = rng.randrange(len(at))
        docs[i] = (i, " ".join(at[:cut] + ws + at[cut:]).upper() if i % 4 == 0 else " ".join(at[:cut] + ws + at[cut:]))
        leaks.add((i, k))
    docs += [(1000, None), (1001, ""), (1002, "x"), (None, items[3][1]), (1003, items[4][1]), (1003, items[4][1])]
    leaks |= {(None, 3), (1003, 4)}
    return make(docs), spark.createDataFrame(items, "item_id long, text string"), leaks, docs, items


def test_finds_all_and_only_leaks(data):
    docs, bench, leaks, *_ = data
    detector = dc.train(docs, bench)
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, detector).collect()}
    assert got == leaks
    kept = dc.drop_leaks(docs, detector)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {i for i, _ in leaks}


def brute_words(text):
    """The words by their definition."""
    text = "".join(x.lower() if len(x.lower()) == 1 else x.lower()[0] for x in text)
    out, word = [], ""
    for x in text + " ":
        c = ord(x)
        part = x.isascii() and not x.isalnum() or 0x80 <= c < 0xC0 and x not in "ªµº" or 0x2000 <= c < 0x2070 or 0x3000 <= c < 0x3040 or 0xFF00 <= c < 0xFF10
        alone = 0x3040 <= c < 0xD800
        if (part or alone) and word:
            out.append(word)
            word = ""
        if alone:
            out.append(x)
        elif not part:
            word += x
    return out


def test_words(odd):
    texts = [t or "" for _, t in odd] + ["Don't «stop» at “signs” — or… at\u00a0spaces, ªº 日本語のテスト, １２！", "é" * 9 + "。x", "ΣΑΣ İstanbul", "", "a"]
    got, sizes = dc.batch_words(pa.array(texts))
    names: dict[int, str] = {}
    at = 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        want = brute_words(text)
        assert n == len(want)
        for h, w in zip(got[at : at + n].tolist(), want, strict=True):
            assert names.setdefault(h, w) == w
        at += n
    assert len(set(names.values())) == len(names)
    assert (dc.batch_words(pa.array(["zz", *texts]).slice(1))[0] == got).all()
    whole = dc.PIECE
    dc.PIECE = 50
    try:
        assert (dc.batch_words(pa.array(texts))[0] == got).all()
    finally:
        dc.PIECE = whole


def tf_idf(words, idf):
    out = {}
    for w in words:
        out[w] = out.get(w, 0.0) + idf[dc.features(np.array([w], np.uint64))[0]]
    return out


def cosine(a, b):
    n = lambda x: sum(v * v for v in x.values()) ** 0.5
    return sum(v * b.get(w, 0.0) for w, v in a.items()) / max(1e-9, n(a) * n(b))


def windows(detector, texts, agreeing=True):
    """(text, item, first word) of the windows that are near a passage, block by block."""
    out = set()
    for block in detector.blocks():
        words, sizes = dc.batch_words(pa.array(texts))
        for part in block.near(detector.space, dc.features(words), sizes, agreeing):
            out |= {(t, block.ids[block.owners[p]], lo) for t, p, lo in zip(*(x.tolist() for x in part[:3]), strict=True)}
    return out


def test_latent_recall_against_brute_force(spark, make, vocabulary):
    """Windows with a full TF-IDF cosine (word counts in both norms) of 0.5 or more: nine in ten are near in a space of 16 dimensions."""
    rng = random.Random(11)
    weighted = [w for k, w in enumerate(vocabulary) for _ in range(1 + 200 // (k + 1))]
    items = [(k, prose(rng, rng.randrange(14, 100), weighted)) for k in range(40)]
    docs = [(k, prose(rng, 150, weighted)) for k in range(150)]
    for k in range(0, 150, 3):
        ws = [w if rng.random() > 0.25 else rng.choice(weighted) for w in items[k % 40][1].split()]
        docs[k] = (k, f"{docs[k][1]} {' '.join(ws)} {docs[k][1]}")
    docs += [(200, " ".join([*["rareword"] * 3, *prose(rng, 13, weighted).split()])), (201, "rareword " * 16)]
    items.append((90, "rareword " * 15))  # repeated words count in the norms
    detector = dc.train(make(docs), spark.createDataFrame(items, "item_id long, text string"), rank=16)
    texts, idf = [t for _, t in docs], detector.space.idf
    assert detector.space.vectors.shape[1] == 16
    found = windows(detector, texts)
    passages = [(k, tf_idf(p.tolist(), idf), len(p)) for k, t in items for p in dc.passages_of(dc.text_words(t))]
    hits = total = 0
    for t, text in enumerate(texts):
        words = dc.text_words(text).tolist()
        for scale, most in dc.SCALES.items():
            least = max((m for m in dc.SCALES.values() if m < most), default=0)
            for lo in range(0, len(words), dc.STEP):
                window = tf_idf(words[lo : lo + scale * dc.STEP], idf)
                for item, p, n in passages:
                    if least < n <= most and cosine(window, p) >= 0.5:
                        total += 1
                        hits += (t, item, lo) in found
    assert total > 100 and hits / total >= 0.9
    assert (151, 90, 0) in found and (150, 90, 0) in windows(detector, texts, agreeing=False)


def test_words_that_stand_together_are_near(spark, make):
    """An item with half or all of its words replaced by words that always stand beside them is found in the space, though not by its words."""
    rng = random.Random(31)
    pair = [(f"a{k}q", f"b{k}z") for k in range(200)]
    docs = []
    for k in range(400):
        topic = rng.sample(range(200), 30)
        docs.append((k, " ".join(w for i in topic for w in pair[i])))
    item = rng.sample(range(200), 32)
    half = " ".join(pair[i][k % 2] for k, i in enumerate(item))
    whole = " ".join(pair[i][1] for i in item)
    unlike = " ".join(pair[i][1] for i in range(200) if i not in item)
    bench = spark.createDataFrame([(1, " ".join(pair[i][0] for i in item))], "item_id long, text string")
    detector = dc.train(make(docs), bench)
    got = windows(detector, [half, whole, unlike], agreeing=False)
    assert {(0, 1, 0), (1, 1, 0)} <= got and not any(t == 2 for t, _, _ in got)
    assert (0, 1, 0) in windows(detector, [half])


def test_other_alphabets_in_capitals(spark, make):
    text = "ΣΑΣ ΕΊΔΑ ΣΤΗΝ ΑΓΟΡΆ ΚΑΙ İstanbul ŞEHİR ÇOK BÜYÜK БЫЛ ХОЛОДНЫЙ ДЕНЬ КОГДА Я ВЫШЕЛ"
    bench = spark.createDataFrame([(1, text), (2, "日本語の文章をここに置いて調べる")], "item_id long, text string")
    docs = make([(1, text.title()), (2, "x " + text), (3, text.lower()), (4, "前 日本語の文章をここに置いて調べる。"), (5, "日本の別の文章")])
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, dc.train(docs, bench)).collect()}
    assert {(2, 1), (4, 2)} <= got and not any(d == 5 for d, _ in got)


def test_blocks(data):
    """A benchmark in many blocks gives the same finds, and no block grows with the benchmark."""
    docs, bench, leaks, _, items = data
    detector = dc.train(docs, bench, block_words=200)
    sizes = [sum(map(len, b.items)) for b in detector.blocks()]
    assert len(sizes) > 5 and max(sizes) <= 200
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, detector).collect()} == leaks
    assert {r.doc_id for r in dc.drop_leaks(docs, detector).collect()} == {r.doc_id for r in docs.collect()} - {i for i, _ in leaks}
    twice = bench.unionAll(bench)
    assert max(sum(map(len, b.items)) for b in dc.train(docs, twice, block_words=200).blocks()) <= 200


def test_odd_rows(spark, make, odd):
    """Every odd text that is an item itself is found under each of its rows."""
    items = [(k, t) for k, (_, t) in enumerate(odd)] + [(50, "another line"), (50, "another line")]
    docs = make(odd)
    got = sorted((r.doc_id or 0, r.item_id) for r in dc.find_leaks(docs, dc.train(docs, spark.createDataFrame(items, "item_id long, text string"))).collect())
    own = {(d or 0, k) for k, (d, t) in enumerate(odd) if t and len(dc.text_words(t))}
    assert own <= set(got)
    assert got.count((5, 50)) == 4 and got.count((1, 50)) == 2 and (0, 50) in got


def test_lcs():
    rng = random.Random(9)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        row = [0] * (len(b) + 1)
        for x in a:
            row = next_row(row, x, b)
        assert dc.lcs(a, b) == row[-1]


def next_row(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_empty_tables(spark, make):
    bench = spark.createDataFrame([], "item_id long, text string")
    detector = dc.train(make([(1, "a b c")]), bench)
    assert dc.find_leaks(make([(1, "a b c")]), detector).count() == 0
    some = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert dc.find_leaks(make([]), dc.train(make([]), some)).count() == 0


def test_hot_words_and_long_text(spark, make):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    rows = [(i, "the the the " * 50) for i in range(30)] + [(100, "filler " * 30_000 + " ".join(f"w{i}" for i in range(40)))]
    docs = make(rows)
    got = [(r.doc_id, r.item_id) for r in dc.find_leaks(docs, dc.train(docs, bench)).collect()]
    assert got == [(100, 1)]


def test_excerpts_of_long_items(spark, make):
    """Consecutive words of an item are found, whatever share of the item they are."""
    rng = random.Random(21)
    words = [f"v{i}" for i in range(3000)]
    items = [(1, prose(rng, 200, words)), (2, prose(rng, 59, words))]
    long, short = items[0][1].split(), items[1][1].split()
    pad = lambda: prose(rng, 150, words)
    parts = [(1, long[70:120]), (1, long[:13]), (1, long[140:200]), (2, short[20:45])]
    rows = [(k, f"{pad()} {' '.join(x)} {pad()}") for k, (_, x) in enumerate(parts)] + [(k, pad()) for k in range(50, 90)]
    changed = [w if i % 9 else "other" for i, w in enumerate(long[48:96])]  # an excerpt with words changed
    rows.append((10, f"{pad()} {' '.join(changed)} {pad()}"))
    docs = make(rows)
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, dc.train(docs, spark.createDataFrame(items, "item_id long, text string"))).collect()}
    assert got == {(k, i) for k, (i, _) in enumerate(parts)} | {(10, 1)}


def test_recall_of_planted_copies(spark, make):
    """Exact copies of items of 1 to 20 words among rarer words, hot items included, against a search for the words themselves."""
    rng = random.Random(22)
    rare = lambda n: " ".join(f"r{rng.randrange(10**6)}" for _ in range(n))
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 21)]
    rows = []
    for n, text in items:
        # 12, 16 and 18 words: hot, in a third of the documents, at every offset of a step
        rows += [(len(rows) + k, f"{rare(40 + k % 8)} {text} {rare(40)}") for k in range(100 if n in (12, 16, 18) else 8)]
    docs = make(rows)
    detector = dc.train(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, detector).collect()}
    assert got == {(d, i) for d, t in rows for i, x in items if f" {x} " in f" {t} "}
    assert len(got) == len(rows)


def test_changed_copies_of_hot_items(spark, make):
    """Changed copies (a word in five) of items that a third of all documents hold."""
    rng = random.Random(23)
    rare = lambda n: " ".join(f"r{rng.randrange(10**6)}" for _ in range(n))
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (10, 15, 30)]
    rows, leaks = [], set()
    for n, text in items:
        for k in range(60):
            ws = [w if k < 50 or i % 5 != k % 5 else rare(1) for i, w in enumerate(text.split())]
            leaks.add((len(rows), n))
            rows.append((len(rows), f"{rare(40 + k % 8)} {' '.join(ws)} {rare(40)}"))
    docs = make(rows)
    detector = dc.train(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, detector).collect()} == leaks


def test_space_is_fitted_on_all_documents(spark, make):
    """Every word in three documents of twenty thousand has a vector, every word of every text is in a passage."""
    docs = [(i, f"common words stand here r{i % 6000:04d}x r{i % 5900:04d}y") for i in range(18_000)]
    bench = spark.createDataFrame([(1, "other words of a benchmark")], "item_id long, text string")
    space = dc.train(make(docs), bench, rank=8).space
    rare = [w for i in range(0, 6000, 7) for w in dc.text_words(f"r{i:04d}x")]
    assert (space.row[dc.features(np.array(rare, np.uint64))] > 0).all()
    for n in (0, 1, 48, 49, 60, 1000):
        words = np.arange(n)
        parts = dc.whole(words)
        assert np.concatenate(parts).tolist() == words.tolist() and max(map(len, parts)) <= dc.PASSAGE


def test_product_against_dense_rows(monkeypatch):
    monkeypatch.setattr(dc, "GATHERED", 7)
    rng = np.random.default_rng(6)
    sizes, q = rng.integers(1, 12, 40), rng.standard_normal((30, 5)).astype(np.float32)
    words, scale = rng.integers(0, 30, sizes.sum()).astype(np.int32), rng.random(40).astype(np.float32)
    rows = np.zeros((40, 30))
    np.add.at(rows, (np.repeat(np.arange(40), sizes), words), 1)
    rows *= scale[:, None]
    total = np.ones_like(q)
    dc.add_product(q, words, sizes, scale, total)
    assert np.allclose(total, 1 + rows.T @ (rows @ q), atol=1e-3)


def test_orthonormal_against_svd():
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((500, 12)) * 10.0 ** -np.arange(12)[rng.permutation(12)][None, :] ** 0.5).astype(np.float32)
    x[:, 3] = 0
    want, got = np.linalg.svd(x.astype(float))[0][:, :11], dc.orthonormal(x)
    assert got.shape == (500, 11) and np.allclose(np.abs((got * want).sum(0)), 1, atol=1e-3) and np.allclose(got.T @ got, np.eye(11), atol=1e-5)


def test_driver_holds_no_table_of_the_fit(spark, make, monkeypatch):
    """Nothing that the fit broadcasts or collects has the size of words by dimensions."""
    rng = random.Random(41)
    vocabulary = [f"d{i}" for i in range(24_000)]
    docs = []
    for _ in range(3):
        rng.shuffle(vocabulary)
        docs += [" ".join(vocabulary[a : a + 400]) for a in range(0, len(vocabulary), 400)]
    docs, bench = make(list(enumerate(docs))), spark.createDataFrame([(1, "d1 d2 d3 d4")], "item_id long, text string")
    broadcast, collect, seen = type(spark.sparkContext).broadcast, type(docs).collect, {"sent": 0, "got": 0}

    def sending(context, value):
        seen["sent"] = max(seen["sent"], len(pickle.dumps(value, 5)))
        return broadcast(context, value)

    def collecting(rows):
        out = collect(rows)
        seen["got"] = max(seen["got"], len(pickle.dumps([tuple(r) for r in out], 5)))
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", sending)
    monkeypatch.setattr(type(docs), "collect", collecting)
    table = dc.train(docs, bench).space.vectors.nbytes
    assert table > 5 << 20 and max(seen.values()) < table // 2, seen


def test_packed_passages_against_plain_ones(spark, make, monkeypatch):
    """Every word of every text is in a packed passage, with the length of its TF-IDF row; few rows hold them all."""
    monkeypatch.setattr(dc, "WRITTEN", 100)
    rng = random.Random(43)
    words = [f"v{i}" for i in range(300)]
    texts = [prose(rng, rng.choice((1, 2, 47, 48, 49, 96, 97, 500)), words) for _ in range(60)] + ["", " .", "x " * 200]
    idf = np.random.default_rng(2).random(dc.FEATURES)
    shared = spark.sparkContext.broadcast(idf)
    for cut, plain in ((dc._wholes, dc.whole), (dc._cuts, dc.passages_of)):
        rows = dc._passages(make(list(enumerate(texts))).coalesce(1), shared, cut).collect()
        got = []
        for r in rows:
            sizes = np.frombuffer(bytes(r.sizes), np.int32)
            assert r.passages == len(sizes) <= 100
            got += zip((tuple(x) for x in np.split(np.frombuffer(bytes(r.words), np.int32).tolist(), np.cumsum(sizes)[:-1])), np.frombuffer(bytes(r.scale), np.float32), strict=True)
        want = [np.sort(dc.features(p)) for t in texts for p in plain(dc.text_words(t)) if len(p)]
        assert len(rows) < 10 and sorted(x for x, _ in got) == sorted(tuple(p) for p in want)
        for x, scale in got:
            f, times = np.unique(x, return_counts=True)
            assert abs(scale * np.linalg.norm(times * idf[f.astype(int)]) - 1) < 1e-5
