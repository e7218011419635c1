import math
import random
from collections import Counter

import numpy as np
import pytest
from posttrain_spark.llm import lm

from .conftest import prose


MASS = [12.0, 4.0]


def brute(rows, order, mass=MASS):
    texts = [(i, (t or "").encode("utf-8", "surrogatepass").lower().split() + [None]) for i, t in rows]
    c, starts = Counter(), 0
    for i, ws in texts:
        if lm.held_out(i):
            continue
        starts += 1
        seq = ["<s>", *ws]
        for k in range(1, order + 1):
            c.update(tuple(seq[j : j + k]) for j in range(len(seq) - k + 1))
    c[("<s>",)] = starts
    single = {g: n for g, n in c.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(single.values()), len(single)
    out = []
    for i, ws in texts:
        seq, base, score = ["<s>", *ws], 0.0, 0.0
        for j in range(1, len(seq)):
            p = (c[(seq[j],)] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                if j - k + 1 < 0:
                    break
                h = tuple(seq[j - k + 1 : j])
                m = mass[min(k - 2, len(mass) - 1)]
                p = (c[(*h, seq[j])] + m * p) / (c[h] + m)
            score += math.log10(p)
        out.append((i, lm.held_out(i), len(ws), sum(c[(w,)] > 0 for w in ws), n, base, score))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[2])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(make, odd, vocabulary, order):
    rng = random.Random(order)
    rows = odd + [(100 + i, prose(rng, rng.randrange(1, 60), vocabulary[:50])) for i in range(40)]
    got = sorted((tuple(r) for r in lm.score_documents(make(rows), order=order, mass=MASS).collect()), key=key)
    want = sorted(brute(rows, order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=1e-6, rel=1e-9)


@pytest.mark.parametrize("small", [{}, {"BUCKET_KEYS": 4, "FAN": 3}])
def test_chunks_share_counts(make, vocabulary, monkeypatch, small):
    """Several chunks, answered by one bucket a part or over several levels of merged chunks."""
    for name, value in small.items():
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(5)
    rows = [(i, prose(rng, 30, vocabulary[:20])) for i in range(60)]
    want = sorted(brute(rows, 3))
    docs = make(rows).repartition(7)
    got = sorted(tuple(r) for r in lm.score_documents(docs, mass=MASS).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], abs=1e-6)


def automaton(texts, order, mass):
    """A chunk whose texts are all learned, with its own counts as totals."""
    code = {}
    coded = [[code.setdefault(w, len(code) + 1) for w in t.split()] + [lm.END] for t in texts]
    hashes = np.arange(1, len(code) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sizes, tokens = np.array([len(x) for x in coded], np.int32), np.concatenate([np.array(x, np.int32) for x in coded])
    ids = [i for i in range(10 * len(texts)) if not lm.held_out(i)][: len(texts)]
    chunk = lm.Chunk(ids, lm._pack(sizes), hashes.tobytes(), lm._pack(tokens), order)
    totals = [c.astype(float) for c in chunk.counts]
    return chunk, lm.Automaton(chunk, totals, int(totals[0].sum()), int((totals[0] > 0).sum()), mass)


def test_probabilities_sum_to_one():
    """From every state the weights of the ways to all words, and of the unknown word, sum to one."""
    chunk, model = automaton(["a b a c a", "b a b a", "c c b a"], 3, MASS)
    states = {1} | set(model.target.tolist()) | set(model.root_next.tolist())
    ends = set((2 + np.array([lm.END])).tolist()) | {s for s in states if s >= 2 + model.words and chunk.tail[1][s - 2 - model.words] == lm.END}
    for state in sorted(states - ends):
        _, score = model.step(np.full(model.words, state), np.arange(model.words))
        unknown, s = 0.0, state
        while s:  # an unknown word has no arc: all failure arcs, then the root's arc of count zero
            unknown += model.back[s]
            s = model.fail[s]
        n = sum(c.sum() for c in chunk.counts[:1])
        unknown += math.log10(0.5 / (n + 0.5 * (model.words + 1)))
        assert (10**score).sum() + 10**unknown == pytest.approx(1)


def test_failure_arcs_are_followed():
    """A text is read through failure arcs, and reads otherwise if they lead straight to the root or weigh nothing."""
    chunk, model = automaton(["a b c", "b d", "a b", "x b c b d"], 3, MASS)
    right = model.read(chunk.token, chunk.first, chunk.sizes, 3)
    code = {w: k + 1 for k, w in enumerate(dict.fromkeys("a b c b d a b x b c b d".split()))}
    state = 1
    for w in "ab":
        state, _ = (x[0] for x in model.step(np.array([state]), np.array([code[w]])))
    after, score = model.step(np.array([state]), np.array([code["d"]]))  # a b d is new, b d is not
    b = model.fail[state]
    assert state >= 2 + model.words and b == 2 + code["b"]
    direct, alone = model.step(np.array([b]), np.array([code["d"]]))
    assert after[0] == direct[0] and score[0] == pytest.approx(model.back[state] + alone[0])
    fail = model.fail
    model.fail = np.zeros_like(fail)
    assert model.step(np.array([state]), np.array([code["d"]]))[1][0] != pytest.approx(score[0])
    model.fail = fail
    assert model.read(chunk.token, chunk.first, chunk.sizes, 3, lane=1) == pytest.approx(right)


def test_mass_matches_the_share_of_new_words():
    rng = random.Random(8)
    counts = [1 + int(rng.expovariate(0.1)) for _ in range(500)]
    sums = lm.count_classes(np.array(counts, np.float64))
    assert sums[:3].tolist() == [sum(counts), 500, counts.count(1)]
    m = lm.mass_of(sums, 900)
    assert sum(c * m / (c - 1 + m) for c in counts) == pytest.approx(900, rel=0.02)


def test_empty_and_untrained(make):
    assert lm.score_documents(make([])).count() == 0
    only = [i for i in range(100) if lm.held_out(i)][:2]
    got = lm.score_documents(make([(i, "a b") for i in only])).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 2
