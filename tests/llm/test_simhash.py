import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from posttrain_spark.llm import simhash as sh
from posttrain_spark.llm.components import components


def plain_fingerprint(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(prints):
    """Smallest id reachable by steps of at most two bits, by brute force; prints: (id, fp)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, f"{fp:016x}", low.get(root(i))) for i, (d, fp) in enumerate(prints)), key=repr)


def test_fingerprints(odd):
    for _, t in odd:
        assert sh.fingerprint(t or "") == plain_fingerprint(t)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = sh.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in combinations(range(64), radius):
        diff = sum(1 << b for b in bits)
        assert any(not m & diff for m in masks)


@pytest.mark.parametrize("block", [1024, 8])
def test_links_against_brute_force(spark, monkeypatch, block):
    rng = random.Random(11)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(12)):
            x ^= 1 << rng.randrange(64) if rng.random() < 0.7 else (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(x)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (k << 20) for k in range(200)}
    prints = [(i * 3 + 1, fp) for i, fp in enumerate(sorted(fps))]
    table = spark.createDataFrame([(sh.signed(fp), i) for i, fp in prints], "fp long, rep long")
    monkeypatch.setattr(sh, "BLOCK", block)
    links = [(r.a, r.b) for r in sh.near_links(table).collect()]
    by_id = dict(prints)
    assert all((by_id[a] ^ by_id[b]).bit_count() <= 2 for a, b in links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert sorted(((i, f"{fp:016x}", found.get(i, i)) for i, fp in prints), key=repr) == classes(prints)


def test_forest_cuts_large_buckets(monkeypatch):
    monkeypatch.setattr(sh, "BLOCK", 16)
    rng = random.Random(2)
    hidden = list(range(0, 28))
    fps = sorted({sum(1 << k for k in hidden if rng.random() < 0.2) for _ in range(300)})
    links = list(sh._forest(np.array(fps, np.uint64), hidden, 2, {}, np.arange(len(fps))))
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert root(a) != root(b)  # a forest
        parent[root(a)] = root(b)
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            assert root(i) == root(j)


def test_table(make, odd, vocabulary):
    rng = random.Random(3)
    base = [rng.choice(vocabulary) for _ in range(400)]
    rows = list(odd)
    for i in range(30):
        ws = list(base)
        ws[rng.randrange(400)] = "changed"
        rows.append((200 + i, " ".join(ws)))
    docs = make(rows)
    got = sorted((tuple(r) for r in sh.near_duplicates(docs).collect()), key=repr)
    want = classes([(i, plain_fingerprint(t)) for i, t in rows])
    assert got == want
    assert len({c for i, _, c in got if i and i >= 200}) < 30
    kept = sh.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _, c in want if i is None or i == c), key=repr)
    assert sh.near_duplicates(make([])).count() == 0


def test_rows_without_an_id_link_others(spark, make, monkeypatch):
    """Two documents that are near only a row of null id are of one class, named by the smallest id."""
    prints = [(9, 0b1111), (None, 0b0011), (5, 0), (None, 0xFF << 40), (7, 0xFFFF00), (7, 0xFFFF00)]
    monkeypatch.setattr(sh, "simhash", lambda docs, words: spark.createDataFrame(prints, "doc_id long, fp long"))
    got = sorted(((r.doc_id, r.component_id) for r in sh.near_duplicates(make([])).collect()), key=repr)
    assert got == sorted([(9, 5), (None, 5), (5, 5), (None, None), (7, 7), (7, 7)], key=repr)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 101), (7, 3)] + [(500, 500 + k) for k in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {500 + k: 500 for k in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
